"""The stream gives what the batch job gives, however the log is cut into batches."""

from pyspark.sql import functions as F

from ledgerline.operators import replay as R
from ledgerline.plans.feeds import as_events, level_rows
from ledgerline.schema import COUNTER_NAMES, FEED_EVENTS
from ledgerline.streaming.replay import replay_stream, use_rocksdb

from .conftest import SF
from .test_replay import random_log
import random


def run(spark, log, options, cuts, tmp_path):
    use_rocksdb(spark)
    src = str(tmp_path / "in")
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 10**9])):
        part = log.where((F.col("arrival") >= a) & (F.col("arrival") < b)).coalesce(1)
        part.write.mode("append").parquet(src)
    stream = spark.readStream.schema(FEED_EVENTS).option("maxFilesPerTrigger", 1).parquet(src)
    name = f"out_{abs(hash(str(tmp_path))) % 10**8}"
    q = replay_stream(stream, None, options).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_stream_equals_batch(spark, tmp_path):
    log = spark.createDataFrame(random_log(random.Random(3), 200), FEED_EVENTS)
    options = R.Options(policy="in_log", depth=3)
    out = run(spark, log, options, [60, 61, 150], tmp_path)
    batch = R.replay(log, None, options).cache()
    rows = lambda df, c: [tuple(r) for r in df.orderBy(c).collect()]
    assert rows(R.views(out), "gen") == rows(R.views(batch), "gen")
    latest = {r["id"]: tuple(r) for r in sorted(R.faults(out).collect(), key=lambda r: (r["id"], r["duration_ms"]))}
    assert latest == {r["id"]: tuple(r) for r in R.faults(batch).collect()}
    last = R.counters(out).orderBy(F.desc("gens"), F.desc("resyncs")).select(*COUNTER_NAMES).first()
    assert last == R.counters(batch).select(*COUNTER_NAMES).first()


def test_many_feeds(spark, tmp_path):
    rows = level_rows(spark, SF, "user_id").where(F.col("symbol").cast("bigint") < 5)
    e = as_events(rows).drop("event_id")
    first = e.where("arrival = 1").withColumns({"kind": F.lit("snapshot"), "arrival": F.lit(0).cast("bigint"), "last_seq": F.lit(0).cast("bigint")})
    log = e.unionByName(first)
    options = R.Options(policy="in_log", depth=5)
    out = run(spark, log, options, [10], tmp_path)
    assert R.views(out).count() == R.views(R.replay(log, None, options)).count()


def test_large_numbers_beside_queued_snapshots(spark, tmp_path):
    """Ids above 2^53 stay exact when snapshots and updates come in one batch, or rows wait for the snapshot."""
    from ledgerline.schema import SNAPSHOTS

    big = 2**53 + 1
    events = spark.createDataFrame([("v", "s", big + i, 10**18 + i, "delta", big + i, big + i, [(big + 2 * i, 1)], [], None) for i in range(4)], FEED_EVENTS)
    snaps = spark.createDataFrame([("v", "s", 0, 0, big - 1, [], [], None, None)], SNAPSHOTS)
    want = sorted((r["gen"], r["last_seq"], r["bids"][0]["price"]) for r in R.views(R.replay(events, snaps)).where("gen > 1").collect())
    use_rocksdb(spark)
    for first in ("both", "events"):
        e, s = str(tmp_path / first / "e"), str(tmp_path / first / "s")
        events.coalesce(1).write.parquet(e)
        (snaps if first == "both" else snaps.limit(0)).coalesce(1).write.parquet(s)
        stream = replay_stream(spark.readStream.schema(FEED_EVENTS).parquet(e), spark.readStream.schema(SNAPSHOTS).parquet(s))
        name = f"big_{first}"
        q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / first / "cp")).outputMode("append").start()
        q.processAllAvailable()
        if first == "events":
            assert R.views(spark.table(name)).count() == 0
            snaps.coalesce(1).write.mode("append").parquet(s)
            q.processAllAvailable()
        q.stop()
        got = sorted((r["gen"], r["last_seq"], r["bids"][0]["price"]) for r in R.views(spark.table(name)).where("gen > 1").collect())
        assert got == want and got[-1][1] == big + 3


def test_queued_snapshots_over_batches(spark, tmp_path):
    """Faults and fetches in every batch, snapshots that wait in the state, and a window: as the batch job has them."""
    from ledgerline.schema import SNAPSHOTS

    from .test_stretches import random_feed

    events, snaps = random_feed(random.Random(8), "s", 240, 0.1)
    e, s = spark.createDataFrame(events, FEED_EVENTS), spark.createDataFrame(snaps, SNAPSHOTS)
    window = spark.createDataFrame([("v", "s", 7)], "venue string, symbol string, max_depth int")
    options = R.Options(depth=4)
    use_rocksdb(spark)
    for i, (a, b) in enumerate([(0, 50), (50, 51), (51, 130), (130, 10**9)]):
        e.where((F.col("arrival") >= a) & (F.col("arrival") < b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "e"))
    s.coalesce(1).write.parquet(str(tmp_path / "s"))
    stream = replay_stream(spark.readStream.schema(FEED_EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e")), spark.readStream.schema(SNAPSHOTS).parquet(str(tmp_path / "s")), options, window)
    q = stream.writeStream.format("memory").queryName("queued").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    out, batch = spark.table("queued"), R.replay(e, s, options, window).cache()
    rows = lambda df, c: [tuple(r) for r in df.orderBy(c).collect()]
    assert rows(R.views(out), "gen") == rows(R.views(batch), "gen")
    latest = {r["id"]: tuple(r) for r in sorted(R.faults(out).collect(), key=lambda r: (r["id"], r["duration_ms"]))}
    assert latest == {r["id"]: tuple(r) for r in R.faults(batch).collect()} and len(latest) > 10


def test_state_writes_follow_changed_levels():
    """A batch of one update to a book of many levels writes that level, and reads no snapshot that is not fetched."""
    from ledgerline.streaming.replay import ReplayProcessor
    from pyspark.sql import Row

    class Value:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, v):
            self.value = v

    class Map(dict):
        writes = 0
        iterator = lambda self: iter(list(self.items()))
        getValue = dict.__getitem__
        removeKey = lambda self, k: self.pop(k)

        def updateValue(self, k, v):
            self.writes += 1
            self[k] = v

    class Handle:
        made = {}
        getValueState = lambda self, name, schema: Value()
        getListState = lambda self, name, schema: Value()

        def getMapState(self, name, *schemas):
            return self.made.setdefault(name, Map())

    row = lambda kind, arrival, seq, bids, queued=False: Row(kind=kind, arrival=arrival, received_ns=0, first_seq=seq, last_seq=seq, bids=[Row(price=p, size=s) for p, s in bids], asks=[], checksum=None, error=None, queued=queued, sub=0, max_depth=None)
    processor, handle = ReplayProcessor(R.Options()), Handle()
    processor.init(handle)
    list(processor.handleInputRows(("v", "s"), iter([row("snapshot", 0, 0, [(p, 1) for p in range(1, 5001)], True), row("snapshot", 0, 5, [(1, 1)], True), row("delta", 1, 1, [(7, 2)])]), None))
    book = handle.made["book_bids"]
    assert len(book) == 5000 and len(handle.made["snapshots"]) == 1
    book.writes = 0
    out = list(processor.handleInputRows(("v", "s"), iter([row("delta", 2, 2, [(9, 3), (10, 0)])]), None))
    assert book.writes == 1 and book[(9,)] == (3,) and (10,) not in book and out[0]["last_seq"] == 2


def test_last_ticks_are_sent(spark):
    """The frames of the ticks that are open at the end of the recording, and a long log in batches no larger."""
    from ledgerline.plans import queries as Q
    from ledgerline.streaming.live import merged, PARTS
    import pyarrow as pa

    rows = level_rows(spark, SF)
    hour = F.expr("received_ns div 3600000000000 * 3600000")
    want = {(r["symbol"], r["t"]): r["seq"] for r in rows.groupBy("symbol", hour.alias("t")).agg(F.max("arrival").alias("seq")).collect()}
    assert {(r["symbol"], r["t"]): r["seq"] for r in Q.h9_stream(spark, SF).collect()} == want
    stream = Q.in_order(rows.select("venue", "symbol", "arrival"), "arrival", feed_rows=10)
    seen = []
    q = stream.writeStream.foreachBatch(lambda df, i: seen.append(df.groupBy("symbol").count().agg(F.max("count")).first()[0])).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(seen) > 3 and max(seen) <= 10
    # parts list the newest 16 events of a tick, whatever the order in which they are merged
    e = lambda i: {"id": i, "kind": "gap", "at_ms": i, "expected_seq": 0, "got_seq": 0, "reason": None, "duration_ms": 0}
    part = [{"venue": None, "symbol": "a", "tick_ms": 0, "at_ms": i, "seq": None, "gaps": 1, "resyncs": 1, "disconnects": 0, "would_crosses": 0, "e": e(i)} for i in range(40)]
    table = merged(merged(pa.Table.from_pylist(part, schema=spark.createDataFrame([], PARTS).toArrow().schema)))
    assert sorted(x["id"] for x in table.column("e").to_pylist() if x) == list(range(24, 40)) and sum(table.column("gaps").to_pylist()) == 40
