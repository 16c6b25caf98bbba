"""Streams from raw lines to tables, stopped before and after every write."""

from pyspark.sql import functions as F

from ledgerline.operators import replay as R
from ledgerline.plans import queries as Q
from ledgerline.shared import shared_path
from ledgerline.streaming import ingest as IN

from .conftest import SF


def test_stops_lose_and_double_nothing(spark, monkeypatch):
    windows = Q.instruments(spark, SF).cache()
    text = Q.recording(spark, SF, 2)
    rows = lambda df: sorted(map(str, df.collect()))

    def run(tables, stops):
        """Runs both jobs to their end, each stopped at writes number `stops`, and started again."""
        seen, plain = [0], IN.Tables._put

        def put(self, df, path):
            seen[0] += 1
            if seen[0] in stops:
                raise RuntimeError("stopped before a write")
            plain(self, df, path)
            if -seen[0] in stops:
                raise RuntimeError("stopped after a write")

        monkeypatch.setattr(IN.Tables, "_put", put)
        for job, start in (("ingest", IN.ingest), ("replay", IN.replayed)):
            state = shared_path(spark, "state")
            while True:
                try:
                    start(text, windows, tables, state).awaitTermination()
                    break
                except Exception as e:
                    assert "stopped" in str(e)
        monkeypatch.setattr(IN.Tables, "_put", plain)
        return {name: rows(tables.read("replay" if name in ("views", "faults") else "ingest", name)) for name in IN.TABLES}

    whole = run(IN.Tables(spark, shared_path(spark, "whole")), ())
    assert all(whole.values())
    # 4 writes a batch of the first job, 3 of the second
    assert run(IN.Tables(spark, shared_path(spark, "stopped")), {1, -3, 6, 9, -10, 13, 17, -19, 20, -22}) == whole


def test_tables_are_what_batches_make(spark):
    """The streams' tables hold what the batch jobs give over the same lines; torn lines and unknown types are quarantined."""
    windows = Q.instruments(spark, SF).cache()
    text = spark.createDataFrame([('{"venue":"EVT","symbol":"click","arrival":5,"received_ns":1,"type":"odd","raw":"x"}',), ("no line",), (None,)], "value string")
    got = IN.decoded(IN.lines(text), windows, IN.FR.binance_frames, IN.FR.binance_snapshots)["rejects"].collect()
    assert sorted((r["reason"], r["raw"] or "") for r in got) == [("not a line of a recording", ""), ("not a line of a recording", "no line"), ("unknown type", "x")]
    stream = Q.recording(spark, SF, 3)
    tables = IN.Tables(spark, shared_path(spark, "tables"))
    for start in (IN.ingest, IN.replayed):
        start(stream, windows, tables, shared_path(spark, "state")).awaitTermination()
    batch = R.replay(tables.read("ingest", "feed_events"), tables.read("ingest", "snapshots"), R.Options(), windows).cache()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(R.views(batch)) == rows(tables.read("replay", "views"))
    assert rows(R.faults(batch)) == rows(tables.read("replay", "faults"))
    assert tables.read("ingest", "rejects").where(F.col("reason") == "not a line of a recording").count() == 3


def test_longer_recordings_take_more_batches(spark):
    """A micro-batch has at most so many lines of a feed, whatever the length of the log, and a torn line of its own."""
    seen = []
    count = lambda rows, _: seen.append({r["symbol"]: r["count"] for r in IN.lines(rows).groupBy("symbol").count().collect()})
    Q.recording(spark, SF, 3, 40).writeStream.foreachBatch(count).option("checkpointLocation", shared_path(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) > 3 and all(batch.pop(None) == 1 and max(batch.values()) <= 40 for batch in seen)
    assert sum(sum(batch.values()) for batch in seen) == Q.level_rows(spark, SF).count() + len(set().union(*seen))
