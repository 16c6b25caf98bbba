"""Latency distributions: mergeable log histograms, quantiles from them, tails, and open-loop figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import drop_written, written

#: Growth of a bucket, and the largest value told apart (an hour).
GROWTH = 1.02
MAX_NS = 3_600_000_000_000
FLOOR_NS = 1000
BINS = 32
#: Bits of a sample that a round of selection tells, and parts that a key's samples are dealt into.
BITS, SALTS = 12, 16


def samples(applied: DataFrame) -> DataFrame:
    """ns of each applied and stamped update (stored_ns less received_ns); negative ones are left out."""
    return applied.where("received_ns is not null and stored_ns >= received_ns").withColumn("ns", F.col("stored_ns") - F.col("received_ns"))


def bucket(ns: Column) -> Column:
    v = F.least(ns, F.lit(MAX_NS))
    return F.when(v <= 1, F.lit(0)).otherwise(F.floor(F.ln(v.cast("double")) / math.log(GROWTH))).cast("int")


def histogram(rows: DataFrame, keys: list[str]) -> DataFrame:
    """n of each bucket, with exact sum and largest value: adds up over parts. About 1,460 buckets a key at most."""
    return rows.where("ns >= 0").groupBy(*keys, bucket(F.col("ns")).alias("bucket")).agg(F.count("*").alias("n"), F.sum("ns").alias("sum_ns"), F.max("ns").alias("max_ns"))


def totals(hist: DataFrame, keys: list[str]) -> DataFrame:
    """count, sum, max and mean (whole) of each key."""
    out = hist.groupBy(*keys).agg(F.sum("n").alias("count"), F.sum("sum_ns").alias("sum_ns"), F.max("max_ns").alias("max_ns"))
    return out.withColumn("mean_ns", F.expr("sum_ns div count"))


def quantiles(hist: DataFrame, keys: list[str], ps: dict[str, float]) -> DataFrame:
    """Quantiles of each key: the middle of the bucket that holds the sample of rank ceil(p * n), 1 at least, cut to whole ns."""
    w = Window.partitionBy(*keys)
    running = F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    rows = hist.withColumns({"_cum": running, "_all": F.sum("n").over(w)})
    value = F.exp(math.log(GROWTH) * (F.col("bucket") + 0.5)).cast("bigint")
    pick = lambda p: F.min(F.when(F.col("_cum") >= F.greatest(F.lit(1), F.ceil(F.lit(float(min(max(p, 0), 1))) * F.col("_all"))), value))
    return rows.groupBy(*keys).agg(*[pick(p).alias(name) for name, p in ps.items()])


def tail(rows: DataFrame, keys: list[str], floor_ns: int = FLOOR_NS) -> DataFrame:
    """Samples above the floor."""
    return rows.where(F.col("ns") > floor_ns)


def selected(rows: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """(keys, name, ns): the sample of a rank from 1 (ranks: keys, name, rank) among a key's samples in order (ns >= 0).

    By rounds: samples are counted in 2^BITS equal cells of the range that is known to hold the one asked for; the cell in
    which the count passes the rank is the next range, until a cell is one value. Samples are counted, never sorted.
    """
    counted = written(rows.groupBy(*keys, "ns").agg(F.count("*").alias("n")), "samples")
    most = counted.agg(F.max("ns")).first()[0] or 0
    shift = BITS * max(0, -(-most.bit_length() // BITS) - 1)
    asked = ranks.select(*keys, "name", "rank", F.lit(0).cast("bigint").alias("cell"))
    while True:
        # few rows a key: a copy for each salt, so that a hot key's samples are dealt out
        salted = asked.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own = counted.withColumn("_s", F.pmod(F.xxhash64("ns"), F.lit(SALTS)).cast("int"))
        inside = own.join(salted, [*keys, "_s"]).where(F.shiftright("ns", shift + BITS) == F.col("cell"))
        cells = inside.groupBy(*keys, "name", "rank", F.shiftright("ns", shift).alias("_cell")).agg(F.sum("n").alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy(*keys, "name").orderBy("_cell"))
        passed = cells.withColumn("_upto", upto).where(F.col("_upto") >= F.col("rank"))
        found = passed.groupBy(*keys, "name").agg(F.min_by(F.struct("_cell", (F.col("rank") - (F.col("_upto") - F.col("_n"))).alias("rank")), "_cell").alias("x"))
        asked = written(found.select(*keys, "name", "x.rank", F.col("x._cell").alias("cell")), "cells")
        if not shift:
            drop_written(counted)
            return asked.select(*keys, "name", F.col("cell").alias("ns"))
        shift -= BITS


def tail_figures(rows: DataFrame, keys: list[str], floor_ns: int = FLOOR_NS) -> DataFrame:
    """Of all samples (rows): p50, p90, p99 of those above the floor (the sample at floor(p * (n - 1)) of n in order), their
    total, and how many are at or under the floor. Keys without a sample above the floor are left out."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(F.col("ns") > floor_ns).alias("above")).where("above > 0")
    names = {"p50_ns": 0.5, "p90_ns": 0.9, "p99_ns": 0.99}
    rank = lambda p: F.floor(F.lit(p) * (F.col("above") - 1)) + 1
    ranks = counts.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(p).alias("rank")) for name, p in names.items()])).alias("r")).select(*keys, "r.*")
    found = selected(tail(rows, keys, floor_ns), keys, ranks).groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("ns"))).alias(name) for name in names])
    return counts.join(found, keys).select(*keys, *names, "total", (F.col("total") - F.col("above")).alias("at_floor"))


def tail_bins(tail_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts in 32 equal bins from zero to the largest sample, and one for what lies beyond by rounding."""
    values = tail_rows.groupBy(*keys, "ns").agg(F.count("*").alias("n"))
    width = F.greatest(F.lit(1), F.expr(f"max(ns) div {BINS}")).alias("_w")
    widths = tail_rows.groupBy(*keys).agg(width).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = values.withColumn("_s", F.pmod(F.xxhash64("ns"), F.lit(SALTS)).cast("int")).join(widths, [*keys, "_s"])
    return rows.groupBy(*keys, F.least(F.expr("ns div _w"), F.lit(BINS)).alias("bin")).agg(F.sum("n").alias("n"))


def bars(p50: Column, p99: Column, p999: Column, most: Column) -> Column:
    """Bar of each value as a whole percent of the largest; values under a microsecond have none."""
    seen = lambda v: F.when(v < FLOOR_NS, F.lit(0)).otherwise(v).cast("bigint")
    values = {"p50": seen(p50), "p99": seen(p99), "p999": seen(p999), "max": seen(most)}
    top = F.greatest(*values.values())
    bar = lambda v: F.when(top == 0, F.lit(0)).otherwise((v * 100 - F.pmod(v * 100, F.greatest(top, F.lit(1)))) / F.greatest(top, F.lit(1))).cast("bigint")
    return F.struct(*[bar(v).alias(k) for k, v in values.items()], F.greatest(p50, p99, p999, most).alias("slowest"))


def open_loop(rows: DataFrame, keys: list[str], interval_ns: int, warmup: int) -> DataFrame:
    """Figures of an open-loop run (k, begun_ns, done_ns relative to the start): event k was due at k * interval.

    Warm-up events are left out of the distributions and counted in late starts. queue_max: events due but not begun.
    """
    due = F.col("k") * interval_ns
    rows = rows.withColumns({"due_ns": F.col("done_ns") - due, "service_ns": F.col("done_ns") - F.col("begun_ns"), "late": F.col("begun_ns") - due > interval_ns, "queued": F.greatest(F.lit(0), F.expr(f"begun_ns div {interval_ns}") - F.col("k"))})
    kept = F.col("k") >= warmup
    return rows.groupBy(*keys).agg(
        F.count_if("late").alias("sender_late"),
        F.count_if(kept & (F.col("service_ns") > interval_ns)).alias("over_interval"),
        F.max(F.when(kept, F.col("queued"))).alias("queue_max"),
        F.max(F.when(kept, F.col("due_ns"))).alias("due_max_ns"),
        F.sum(F.when(kept, F.col("service_ns"))).alias("busy_ns"),
        (F.sum(F.when(kept, F.col("service_ns"))) * 100.0 / (F.count_if(kept) * interval_ns)).alias("util_pct"),
    )


def run_summary(values: DataFrame) -> DataFrame:
    """median (mean of the middle two for an even number), least and largest of each benchmark's metric over its runs."""
    return values.groupBy("benchmark", "metric").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.min("value").alias("low"), F.max("value").alias("high"))


def clock_step(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Upper median of the positive steps between successive clock readings (ord, t_ns)."""
    w = Window.partitionBy(*keys)
    steps = readings.withColumn("step", F.col("t_ns") - F.lag("t_ns").over(w.orderBy("ord"))).where("step > 0")
    ranked = steps.withColumns({"_r": F.row_number().over(w.orderBy("step")), "_n": F.count("*").over(w)})
    return ranked.where(F.expr("_r = _n div 2 + 1")).select(*keys, F.col("step").alias("clock_step_ns"))
