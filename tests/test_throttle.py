"""Throttled values as a stream: feeds share states, and each feed is as it is alone."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import Row

from ledgerline.streaming import packs as P
from ledgerline.streaming.live import SHOWN, ThrottleProcessor

LOG = pa.schema([("venue", pa.string()), ("symbol", pa.string()), ("ord", pa.int64()), ("t_ms", pa.int64()), ("value", pa.string())])


class Store:
    """A state of one value with timers, and the calls it got."""

    def __init__(self):
        self.calls, self.value, self.timers = [], None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.calls.append("register")
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls.append("delete")
        self.timers.remove(at)


class Clock:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now


def by_one(rows, gap):
    """(ord, shown_ms) of one feed, a row at a time; held values come when their slot ends."""
    free = held = None
    for ord_, t in rows:
        while held is not None and t >= free:
            yield held, free
            free, held = free + gap, None
        if free is not None and t < free:
            held = ord_
        else:
            yield ord_, t
            free = t + gap
    if held is not None:
        yield held, free


def play(batches, gap):
    """What a group shows of batches, with the watermark at the newest time before each and at the end."""
    store, processor, out, newest = Store(), ThrottleProcessor(gap), [], 0
    processor.init(store)
    taken = lambda handed: [tuple(x.values()) for h in handed for x in P.unpack(h["pack"]).to_pylist()]
    calls = []
    for rows in [*batches, None, None]:
        clock = Clock(newest)
        if rows:
            half = len(rows) // 2
            given = [Row(pack=P.pack(pa.Table.from_pylist([dict(zip(LOG.names, x)) for x in part], schema=LOG))) for part in (rows[:half], rows[half:]) if part]
            store.calls.clear()
            out += taken(processor.handleInputRows((0,), iter(given), clock))
            calls.append(list(store.calls))
            newest = max(newest, max(x[3] for x in rows))
        else:
            newest = 10**9  # the end of all time
        for at in [t for t in store.timers if t <= clock.getCurrentWatermarkInMs()]:
            due = Clock(at)
            out += taken(processor.handleExpiredTimer((0,), clock, due))
            store.timers.discard(at)
        assert len(store.timers) <= 1
    return out, calls


def test_throttle_by_groups():
    """Feeds of one group, null names too, cut into any micro-batches: each shows what it shows alone."""
    r = random.Random(3)
    for case in range(150):
        gap, feeds = r.choice([1, 50, 300]), {("v", "a"): [], ("v", None): [], ("w", "a"): [], (None, "a"): []}
        for feed, log in feeds.items():
            t = 1
            for i in range(r.randint(0, 25)):
                t += r.choice([0, 1, 30, 70, 500])
                log.append((i, t))
        rows = [(t, i, feed) for feed, log in feeds.items() for i, t in log]
        ends = sorted({t for t, *_ in rows})
        cuts = sorted(r.sample(ends, min(3, len(ends))))
        batches = [[x for x in rows if a < x[0] <= b] for a, b in zip([0, *cuts], [*cuts, 10**9])]
        batches = [[(*feed, i, t, f"{feed}{i}") for t, i, feed in b] for b in batches if b]
        for b in batches:
            r.shuffle(b)
        out, _ = play(batches, gap)
        for feed, log in feeds.items():
            own = [(x[2], x[5]) for x in out if x[:2] == feed]
            assert sorted(own) == sorted(by_one(log, gap)), case
        assert all(x[4] == f"{x[:2]}{x[2]}" for x in out)


def test_throttle_costs_calls_a_group():
    """A thousand feeds of a group cost one read and one write of its state a batch, and one timer."""
    batch = lambda t: [("v", str(f), t + k, 100 * t + k, "x") for f in range(1000) for k in range(2)]
    _, calls = play([batch(1), batch(2)], 1000)
    assert [sorted(c) for c in calls] == [["get", "register", "update"], ["get", "update"]]


def test_throttle_drops_what_is_late():
    """A row behind the watermark that the group saw last is lost, as it would come after what was shown since."""
    out, _ = play([[("v", "a", 0, 1000, "x"), ("v", "a", 1, 1100, "y")], [("v", "b", 0, 5000, "x")], [("v", "b", 1, 5500, "y")], [("v", "a", 2, 1050, "z"), ("v", "a", 3, 6000, "w")]], 500)
    assert [(x[2], x[5]) for x in out if x[1] == "a"] == [(0, 1000), (1, 1500), (3, 6000)]


@pytest.mark.parametrize("groups", [1, 7])
def test_throttled_stream_of_groups(spark, groups):
    """The stream over a table gives what the batch form gives, up to the newest time; all packs are of whole rows."""
    from ledgerline.operators import views as V
    from ledgerline.plans import queries as Q
    from ledgerline.schema import KEY
    from ledgerline.streaming.live import throttled_stream
    from ledgerline.streaming.replay import use_rocksdb

    rows = spark.range(600).selectExpr("'v' venue", "cast(id % 9 as string) symbol", "id ord", "(id * 7919) % 6000 + 1 t_ms", "cast(id as string) value").selectExpr("venue", "symbol", "row_number() over (partition by symbol order by t_ms, ord) ord", "t_ms", "value").selectExpr("venue", "symbol", "cast(ord as bigint) ord", "t_ms", "value")
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    use_rocksdb(spark)
    shown = Q.streamed(throttled_stream(Q.in_order(rows, "t_ms"), 250, groups=groups), "append")
    assert shown.drop("batch").schema.simpleString() == spark.createDataFrame([], SHOWN).schema.simpleString()
    newest = max(x["t_ms"] for x in rows.collect())
    want = [tuple(x) for x in V.throttled(rows, 250, KEY).select("venue", "symbol", "ord", "t_ms", "value", "shown_ms").collect() if x["shown_ms"] <= newest]
    assert sorted(tuple(x) for x in shown.select("venue", "symbol", "ord", "t_ms", "value", "shown_ms").collect()) == sorted(want)


def test_parts_are_dealt_to_tasks(spark):
    """A part of a stream's log that has several files is dealt by several tasks, and no row is lost."""
    import glob

    from ledgerline.plans import queries as Q

    rows = spark.range(4000).selectExpr("'v' venue", "cast(id % 5 as string) symbol", "id arrival")
    had = set(glob.glob(f"{spark.sparkContext.getCheckpointDir()}/stream-parts-*".replace("file:", "")))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream = Q.in_order(rows, "arrival", file_rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    made = set(glob.glob(f"{spark.sparkContext.getCheckpointDir()}/stream-parts-*".replace("file:", ""))) - had
    assert len(made) == 1
    parts = glob.glob(f"{made.pop()}/_part=*")
    assert len(parts) == 3 and all(len(glob.glob(f"{p}/*.parquet")) > 1 for p in parts)
    assert Q.streamed(stream, "append").count() == 4000
