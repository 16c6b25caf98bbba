"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: each once to warm up, then the median of RUNS; one JSON line."""

from __future__ import annotations

import functools
import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from ledgerline.operators import book as B
from ledgerline.operators import latency as L
from ledgerline.operators import replay as R
from ledgerline.operators import stretches as T
from ledgerline.plans import queries as Q
from ledgerline.plans.feeds import as_events, empty_snapshots, level_rows, lineitem_rows
from ledgerline.schema import KEY
from ledgerline.shared import shared_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def replay_many(spark):
    """One feed a supplier of all order lines: scan, order, fold, a view for every update."""
    rows = lineitem_rows(spark, SF_DIR)
    return R.replay(as_events(rows), empty_snapshots(rows), R.Options(depth=10))


@functools.cache
def recorded(segments: bool) -> str:
    """All order lines as one feed's recorded log; with segments, every 20,000th row is a snapshot."""
    spark = SparkSession.getActiveSession()
    rows = lineitem_rows(spark, SF_DIR, hot=True)
    e = as_events(rows).drop("event_id")
    if segments:
        snap = (F.col("arrival") == 1) | (F.col("arrival") % 20000 == 0)
        lv = lambda p: F.array(F.struct(F.lit(p).cast("bigint").alias("price"), F.lit(1).cast("bigint").alias("size")))
        e = e.withColumns({"bids": F.when(snap, lv(1)).otherwise(F.col("bids")), "asks": F.when(snap, lv(2500)).otherwise(F.col("asks")), "kind": F.when(snap, "snapshot").otherwise(F.col("kind"))})
    path = shared_path(spark, "recorded")
    e.repartition(16, "arrival").write.parquet(path)
    return path


def replay_hot(spark):
    """One feed's log of all order lines: counters and last view, in the feed's order."""
    log = spark.read.parquet(recorded(False))
    return R.replay(log, empty_snapshots(log), R.Options(views_every=0))


def replay_hot_segments(spark):
    """The same feed with a snapshot in its log at every 20,000th update, a segment at a time."""
    return R.replay_segments(spark.read.parquet(recorded(True)), R.Options(policy="in_log", views_every=0))


def replay_hot_stretches(spark):
    """The first feed by stretches of 65,536 arrivals, without a snapshot in its log."""
    log = spark.read.parquet(recorded(False))
    return T.replay_stretches(log, empty_snapshots(log), R.Options(views_every=0))


def replay_end_to_end(spark):
    """The first feed from the table of order lines on: scan, order, fold."""
    rows = lineitem_rows(spark, SF_DIR, hot=True)
    return R.replay(as_events(rows), empty_snapshots(rows), R.Options(views_every=0))


@functools.cache
def recorded_long() -> str:
    """One feed's log ten times as long: every order line as ten updates of prices next to each other."""
    spark = SparkSession.getActiveSession()
    log = spark.read.parquet(recorded(False))
    moved = lambda side: F.transform(side, lambda x: F.struct((x["price"] + F.col("_j")).alias("price"), x["size"].alias("size")))
    long = log.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(9).cast("bigint"))))
    at = F.col("arrival") * 10 + F.col("_j") - 9
    long = long.withColumns({"bids": moved(F.col("bids")), "asks": F.transform(moved(F.col("asks")), lambda x: F.struct((x["price"] + 1000).alias("price"), x["size"].alias("size"))), "first_seq": at, "last_seq": at}).withColumn("arrival", at).drop("_j")
    path = shared_path(spark, "recorded")
    long.repartition(16, "arrival").write.parquet(path)
    return path


def replay_long(spark):
    log = spark.read.parquet(recorded_long())
    return R.replay(log, empty_snapshots(log), R.Options(views_every=0))


def replay_long_stretches(spark):
    log = spark.read.parquet(recorded_long())
    return T.replay_stretches(log, empty_snapshots(log), R.Options(views_every=0), 262_144)


@functools.cache
def recorded_frames() -> str:
    """Raw frames of eight bids and eight asks, one for every event: what an exchange's recorder has on disk."""
    spark = SparkSession.getActiveSession()
    rows = level_rows(spark, SF_DIR)
    side = lambda base: F.to_json(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.array(F.format_string("%d.%02d", F.lit(base) + (F.col("c") + i * 7) % 300, (F.col("c") * (i + 3)) % 100), F.format_string("%d.%03d", (F.col("c") + i) % 5, F.col("c") % 1000))))
    n = F.col("arrival").cast("string")
    raw = F.concat(F.lit('{"e":"depthUpdate","E":1,"s":"'), "symbol", F.lit('","U":'), n, F.lit(',"u":'), n, F.lit(',"b":'), side(100), F.lit(',"a":'), side(500), F.lit("}"))
    path = shared_path(spark, "frames")
    rows.select(*KEY, "arrival", "received_ns", raw.alias("raw")).repartition(16).write.parquet(path)
    return path


def frames16_to_book(spark):
    """Recorded frames of 16 levels, decoded, normalized and routed, to the latest book."""
    from ledgerline.sources import frames as FR

    routed = FR.binance_frames(spark.read.parquet(recorded_frames()), Q.instruments(spark, SF_DIR))
    return B.latest(B.delta_levels(FR.to_deltas(routed)))


def latest_book(spark):
    return B.latest(B.delta_levels(as_events(lineitem_rows(spark, SF_DIR))))


def histogram(spark):
    rows = lineitem_rows(spark, SF_DIR).select(*KEY, (F.col("price") * 1000 + F.col("size")).alias("ns"))
    return L.quantiles(L.histogram(rows, KEY), KEY, {"p50": 0.5, "p99": 0.99, "p999": 0.999})


def frames_to_book(spark):
    """Raw frames, decoded, normalized and routed, to the latest book."""
    from ledgerline.sources import frames as FR

    routed = FR.binance_frames(Q._raw(spark, SF_DIR, False), Q.instruments(spark, SF_DIR))
    return B.latest(B.delta_levels(FR.to_deltas(routed)))


JOBS = {"replay_many": replay_many, "replay_hot": replay_hot, "replay_hot_segments": replay_hot_segments, "replay_hot_stretches": replay_hot_stretches, "replay_end_to_end": replay_end_to_end, "latest_book": latest_book, "histogram": histogram, "frames_to_book": frames_to_book, "frames16_to_book": frames16_to_book}
#: Run once: they take long.
LONG = {"replay_long": replay_long, "replay_long_stretches": replay_long_stretches}
NAMED = ["top_book", "c4_classify", "e1_replay", "g4_depth_points", "h1_merged_events", "i1_conflation", "k3_quantiles"]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    jobs = dict(JOBS) | LONG | {n: (lambda s, n=n: Q.QUERIES[n](s, SF_DIR)) for n in NAMED}
    level_rows(spark, SF_DIR).count()
    took = {}
    only = [x for x in os.environ.get("BENCH_ONLY", "").split(",") if x]
    if only:
        jobs = {k: v for k, v in jobs.items() if k in only}
    recorded(False), recorded(True), recorded_long(), recorded_frames()  # outside the timer
    for name, job in jobs.items():
        times = []
        for _ in range(1 if name in LONG else RUNS + 1):
            began = time.time()
            job(spark).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times[1:] or times), 3)
    n = lineitem_rows(spark, SF_DIR).count()
    frames = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    sizes = {"frames_to_book": frames, "frames16_to_book": frames, "replay_long": 10 * n, "replay_long_stretches": 10 * n} | dict.fromkeys(("replay_many", "replay_hot", "replay_hot_segments", "replay_hot_stretches", "replay_end_to_end", "latest_book"), n)
    rates = {k: round(size / took[k]) for k, size in sizes.items() if k in took}
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "updates": n, "per_second": rates, "statistic": f"median of {RUNS} after a warm-up"}))


if __name__ == "__main__":
    main()
