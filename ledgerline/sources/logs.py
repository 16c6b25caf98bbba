"""Benchmark logs, latency captures, and canonical tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import KEY

BENCH_LINE = r"^(Benchmark\w+)-(\d+)\s+(\d+)\s+(.*)$"
CAPTURE = "schema int, venue string, symbol string, start string, window_ns bigint, resolution_ns bigint, total_samples bigint, tail_ns array<bigint>"
RESOLUTION_NS, MAX_TAIL_NS = 1000, 3_600_000_000_000


def bench_lines(text: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts, values, problems) of benchmark logs given as rows (log, line_no, value).

    facts: log, key, fact of header lines. values: log, benchmark, run, metric, value; ns/op is left out. problems: logs
    not to be used, with the reason: an odd number of fields, a bad value, no benchmark line, a tree that is not clean.
    Byte-order marks and carriage returns are tolerated; other lines are skipped.
    """
    rows = text.withColumn("line", F.regexp_replace(F.regexp_replace("value", "^﻿", ""), "\r", ""))
    facts = rows.where(F.col("line").startswith("# ") & F.col("line").contains(": ")).select("log", "line_no", F.regexp_extract("line", r"^# (.*?): ", 1).alias("key"), F.regexp_extract("line", r"^# .*?: (.*)$", 1).alias("fact"))
    hits = rows.where(F.col("line").rlike(BENCH_LINE) & ~F.col("line").startswith("# ")).select("log", "line_no", "line", F.regexp_extract("line", BENCH_LINE, 1).alias("benchmark"), F.split(F.trim(F.regexp_extract("line", BENCH_LINE, 4)), r"\s+").alias("f"))
    odd = hits.where(F.size("f") % 2 == 1).select("log", F.concat(F.lit("odd number of fields: "), "line").alias("problem"))
    runs = hits.where(F.size("f") % 2 == 0).withColumn("run", F.row_number().over(Window.partitionBy("log", "benchmark").orderBy("line_no")))
    pairs = runs.select("log", "benchmark", "run", F.explode(F.expr("transform(sequence(0, size(f) - 2, 2), i -> struct(f[i] as v, f[i + 1] as metric))")).alias("p")).select("log", "benchmark", "run", "p.metric", F.col("p.v").alias("text"), F.col("p.v").try_cast("double").alias("value"))
    bad = pairs.where("value is null").select("log", F.concat(F.lit("bad value: "), "text").alias("problem"))
    values = pairs.where("value is not null and metric != 'ns/op'").drop("text")
    logs = rows.select("log").distinct()
    none = logs.join(hits.select("log").distinct(), "log", "left_anti").select("log", F.lit("no benchmark lines").alias("problem"))
    tree = facts.where("key = 'tree'").groupBy("log").agg(F.min_by("fact", "line_no").alias("tree"))
    dirty = logs.join(tree, "log", "left").where(F.coalesce("tree", F.lit("")) != "clean").select("log", F.lit("tree is not clean").alias("problem"))
    return facts.drop("line_no"), values, odd.unionByName(bad).unionByName(none).unionByName(dirty)


def run_problems(values: DataFrame, runs: int) -> DataFrame:
    """Benchmarks without exactly `runs` runs, or with a run that lacks a metric of the first."""
    got = values.groupBy("log", "benchmark").agg(F.countDistinct("run").alias("n"))
    wrong = got.where(F.col("n") != runs).select("log", "benchmark", F.format_string("%d runs, want %d", F.col("n"), F.lit(runs)).alias("problem"))
    first = values.where("run = 1").select("log", "benchmark", "metric")
    per = values.groupBy("log", "benchmark", "metric").agg(F.countDistinct("run").alias("m"))
    lacks = first.join(per, ["log", "benchmark", "metric"]).join(got, ["log", "benchmark"]).where("m < n").select("log", "benchmark", F.concat(F.lit("a run lacks "), "metric").alias("problem"))
    return wrong.unionByName(lacks)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Latency captures, one JSON document a file."""
    return spark.read.schema(CAPTURE).option("multiLine", True).json(path)


def check_captures(captures: DataFrame) -> DataFrame:
    """problem of each capture, null if it can be used."""
    tail = F.col("tail_ns")
    m = F.greatest(F.size(tail) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(tail, F.lit(1), m).alias("a"), F.slice(tail, F.lit(2), m).alias("b"))
    problem = (
        F.when(~F.coalesce(F.col("schema") == 1, F.lit(False)), "schema is not 1")
        .when(~F.coalesce((F.col("resolution_ns") == RESOLUTION_NS) & (F.col("window_ns") > 0) & (F.col("symbol") != ""), F.lit(False)), "resolution, window or symbol")
        .when(F.coalesce(F.size(tail), F.lit(0)) <= 0, "no sample above the floor")
        .when(F.col("total_samples") < F.size(tail), "fewer samples in total than above the floor")
        .when(~F.forall(tail, lambda x: x > F.col("resolution_ns")) | ~F.forall(pairs, lambda p: p["a"] <= p["b"]), "samples at or under the floor, or out of order")
        .when(F.array_max(tail) > MAX_TAIL_NS, "a sample too large to draw")
    )
    return captures.withColumn("problem", problem)


def capture_samples(captures: DataFrame) -> DataFrame:
    """ns above the floor, a row each, of usable captures, with the number of all samples."""
    return check_captures(captures).where("problem is null").select(*KEY, "total_samples", F.explode("tail_ns").alias("ns"))


def write_table(df: DataFrame, path: str, date: str = "trade_date") -> None:
    """A canonical table as Parquet by venue and day, each file sorted by symbol and arrival."""
    day = F.to_date(F.timestamp_seconds(F.expr("received_ns div 1000000000"))) if "received_ns" in df.columns else F.lit(None).cast("date")
    rows = df if date in df.columns else df.withColumn(date, day)
    rows.repartitionByRange("venue", date, "symbol", "arrival").sortWithinPartitions("venue", date, "symbol", "arrival").write.mode("overwrite").partitionBy("venue", date).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A canonical table; filters on venue and trade_date prune folders."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)
