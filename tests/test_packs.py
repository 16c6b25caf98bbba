"""Stateful processors take and hand on packs of rows: as row by row, whatever the micro-batches."""

import random

import pyarrow as pa
from pyspark.sql import Row

from ledgerline.streaming import packs as P
from ledgerline.streaming.fanout import DeliveryProcessor


LOG = pa.schema([("arrival", pa.int64()), ("op", pa.string()), ("view_seq", pa.int64())])


class Value:
    value = None
    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, v):
        self.value = v


class Handle:
    getValueState = lambda self, name, schema: Value()


def one_by_one(rows, max_lag):
    full, newest, streak = False, None, 0
    for arrival, op, seq in rows:
        if op == "take":
            yield (arrival, op, "taken" if newest is not None else "nothing", newest, False)
            full, newest, streak = False, None, 0
        else:
            streak = streak + 1 if full else 0
            cut = max_lag is not None and streak >= max_lag
            yield (arrival, op, "supersedes" if full else "delivered", None, cut)
            full, newest = True, newest if seq is None else seq
            if cut:
                return


def test_delivery_in_packs():
    """A consumer's batch of many rows comes as few values and is handed on as few, and each outcome is right."""
    r = random.Random(5)
    for case in range(200):
        log = [(2 * i + (op == "take"), op, None if op == "take" or r.random() < 0.1 else i) for i, op in ((i, "take" if r.random() < 0.3 else "publish") for i in range(r.randint(1, 60)))]
        lag = r.choice([None, 0, 1, 3, 6])
        processor, out = DeliveryProcessor(lag), []
        processor.init(Handle())
        cuts = sorted(r.sample(range(len(log) + 1), min(3, len(log))))
        for a, b in zip([0, *cuts], [*cuts, len(log)]):
            part = log[a:b]
            if part:
                r.shuffle(part)
                half = len(part) // 2
                given = [Row(pack=P.pack(pa.Table.from_pylist([dict(zip(LOG.names, x)) for x in p], schema=LOG))) for p in (part[:half], part[half:]) if p]
                handed = list(processor.handleInputRows(("v", "s", 1), iter(given), None))
                assert len(handed) <= 1
                assert all((h["venue"], h["symbol"], h["consumer"]) == ("v", "s", 1) for h in handed)
                out += [row for h in handed for row in P.unpack(h["pack"]).to_pylist()]
        got = [(x["arrival"], x["op"], x["outcome"], x["got_seq"], x["disconnected"]) for x in out]
        assert got == list(one_by_one(log, None if lag is None else max(lag, 1))), case


def test_packs_hold_all_rows(spark):
    """Every row is in a pack of its key, null keys too."""
    rows = spark.range(1000).selectExpr("case when id % 7 = 0 then null else cast(id % 7 as string) end k", "id", "array(id, id + 1) l")
    packs = P.packed(rows.coalesce(1), ["k"]).collect()
    assert len(packs) == 7
    assert sorted((str(p["k"]), x["id"], *x["l"]) for p in packs for x in P.unpack(p["pack"]).to_pylist()) == sorted(("None" if i % 7 == 0 else str(i % 7), i, i, i + 1) for i in range(1000))


def test_replay_state_in_few_calls():
    """A feed with a small book costs one read and one write of the state a batch; its rows leave in packs, not all at once."""
    from ledgerline.operators import replay as R
    from ledgerline.streaming.replay import SMALL, ReplayProcessor

    calls = []

    class Counted:
        def __init__(self):
            self.value, self.map = None, {}

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "update":
                    self.value = args[0]
                elif name == "updateValue":
                    self.map[args[0]] = args[1]
                elif name == "removeKey":
                    del self.map[args[0]]
                return {"get": self.value, "exists": self.value is not None, "iterator": iter(list(self.map.items()))}.get(name)

            return call

    class Store:
        def __getattr__(self, _):
            return lambda *_: Counted()

    row = lambda kind, seq, bids: Row(kind=kind, arrival=seq, received_ns=0, first_seq=seq, last_seq=seq, bids=[Row(price=p, size=s) for p, s in bids], asks=[], checksum=None, error=None, queued=False, sub=0, max_depth=None)
    processor = ReplayProcessor(R.Options(policy="in_log", depth=1000), packs=True)
    processor.init(Store())
    fold = lambda rows: [P.unpack(h["pack"]) for h in processor.handleInputRows(("v", "s"), iter(rows), None)]
    last = lambda tables: [x for t in tables for x in t.to_pylist() if x["what"] == "view"][-1]
    fold([row("snapshot", 0, [(1, 1)])])
    assert sorted(calls) == ["get", "update"]
    calls.clear()
    many = fold([row("delta", i, [(1 + i % 3, i)]) for i in range(1, 2501)])
    assert sorted(calls) == ["get", "update"] and len(many) == 3 and sum(t.num_rows for t in many) == 2501
    # a book grows out of the numbers into maps, and goes on there
    fold([row("delta", 2500 + i, [(10 + i, 1)]) for i in range(1, SMALL + 1)])
    assert "updateValue" in calls
    view = last(fold([row("delta", 2501 + SMALL, [(1, 0)])]))
    assert len(view["bids"]) == SMALL + 2 and view["bids"][-1] == {"price": 2, "size": 2500}


def test_replay_of_packs_is_that_of_rows():
    """Packs in any order give what rows give, with rows that share an arrival and ids above 2^53."""
    from ledgerline.operators import replay as R
    from ledgerline.streaming.replay import in_columns, one_by_one

    big = 2**53 + 1
    r = random.Random(2)
    level = pa.list_(pa.struct([("price", pa.int64()), ("size", pa.int64())]))
    schema = pa.schema([("arrival", pa.int64()), ("received_ns", pa.int64()), ("kind", pa.string()), ("first_seq", pa.int64()), ("last_seq", pa.int64()), ("bids", level), ("asks", level), ("checksum", pa.int64()), ("error", pa.string()), ("queued", pa.bool_()), ("sub", pa.int64()), ("max_depth", pa.int32())])
    rows = [dict(arrival=big + i // 3, received_ns=10**18 + i, kind="delta", first_seq=big + i, last_seq=big + i, bids=[{"price": i, "size": 1}], asks=[], checksum=None, error=None, queued=i == 5, sub=i % 3, max_depth=None if i < 7 else 4) for i in range(20_000)]
    r.shuffle(rows)
    window, fresh = in_columns(pa.Table.from_pylist(rows, schema=schema))
    plain = [Row(**{**x, "bids": [Row(**v) for v in x["bids"]]}) for x in rows]
    assert (window, list(fresh)) == (4, list(one_by_one(plain)[1])) and one_by_one(plain)[0] == 4
