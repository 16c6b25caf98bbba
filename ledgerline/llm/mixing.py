"""Mixing sources to target weights by weighted fair queueing (native: DataFrame functions only).

Every source is a queue of its documents in seeded-shuffled order, served again from the start up to three times. A
document's virtual finish time is the source's cumulative words up to and with it, over the source's target. The mix
takes the entries of all queues in the order of finish times and stops at the total budget.

Cumulative sums are taken in buckets: of the shuffle digest within a source (see sharding.running, which also spreads
rows that repeat), and of the finish time over all entries. Only the one finish-time bucket in which the budget runs out is summed row by row; the last entry taken (one row) then
decides for every document on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import group_key, power_of_two, read, settle, whole_row, word_count
from .sharding import BUCKETS, ROWS_PER_BUCKET, running

#: No document is taken more often.
EPOCHS = 3


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """Targets of all sources: from (_g, size) to (_g, source_size, target).

    Sources in the order of _g weigh weights[0], weights[1], ... repeating, and share the sum of all sizes. No target is
    above epochs times its source's size: the excess is shared again by weight. In the order of size over weight, the
    sources before some place are full and those after it get one level times their weight; the level is found by
    running sums over one row a source.
    """
    every = Window.partitionBy()
    ranked = sources.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy("_g")) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("size") * epochs).withColumn("_r", F.col("_cap").cast("double") / F.col("_w").cast("double"))
    before = Window.orderBy("_r", "_g").rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))).cast("double")
    ranked = ranked.withColumn("_level", level)
    ranked = ranked.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_r"), F.struct("_r", "_g", "_level"))).over(every)["_level"])
    return ranked.select("_g", F.col("size").alias("source_size"), F.coalesce(F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")), F.col("_cap").cast("double")).alias("target"))


def keyed(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    """doc_id, _g, size, _u and _at of every row of docs, and more columns, as a written table."""
    told = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col("source")).alias("_g"), word_count(F.col("text")).alias("size"), F.md5(told).alias("_u"), *more)
    return settle(rows.withColumn("_at", F.monotonically_increasing_id()), "mix-rows")


def served(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """_at, doc_id, size, source_size, target and times of every row of keyed()."""
    rows = rows.select("doc_id", "_g", "size", "_u", "_at")
    n_rows = rows.count()
    buckets = power_of_two(n_rows // ROWS_PER_BUCKET, BUCKETS)
    # one row a source
    targets = source_targets(rows.groupBy("_g").agg(F.sum("size").alias("size")), weights)
    queued = running(rows, "size", n_rows, ROWS_PER_BUCKET).withColumnRenamed("_end", "_cum").join(targets, "_g")
    queued = settle(queued, "mix-queued")

    finish = lambda e: (e * F.col("source_size") + F.col("_cum")).cast("double") / F.col("target")
    key = lambda e: F.struct(finish(e).alias("f"), F.col("_g").alias("g"), F.col("_u").alias("u"), e.alias("e"))
    wanted = (F.col("size") > 0) & (F.col("target") > 0)
    entries = queued.where(wanted).select("size", "source_size", F.explode(F.array(*[key(F.lit(e)) for e in range(EPOCHS)])).alias("k"))
    entries = entries.withColumn("_t", F.least(F.floor(F.col("k.f") * buckets), F.lit(4 * buckets)).cast("int"))
    budget = queued.agg(F.sum("size")).first()[0] or 0
    totals = entries.groupBy("_t").agg(F.sum("size").alias("_s"))
    totals = totals.withColumn("_end", F.sum("_s").over(Window.orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)))
    last = totals.where(F.col("_end") > budget).orderBy("_t").first()
    if last is None:
        taken = F.lit(EPOCHS)
    else:
        inside = Window.partitionBy("_t").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        within = entries.where(F.col("_t") == last["_t"]).withColumn("_run", F.sum("size").over(inside) + F.lit(last["_end"] - last["_s"]))
        cut = within.where(F.col("_run") <= budget).agg(F.max("k").alias("k")).first()["k"]
        below = [F.least(F.floor(finish(F.lit(e)) * buckets), F.lit(4 * buckets)) < last["_t"] for e in range(EPOCHS)]
        if cut is not None:
            edge = F.struct(F.lit(cut["f"]).alias("f"), F.lit(cut["g"]).alias("g"), F.lit(cut["u"]).alias("u"), F.lit(cut["e"]).alias("e"))
            below = [x | (key(F.lit(e)) <= edge) for e, x in enumerate(below)]
        taken = sum((x.cast("int") for x in below), F.lit(0))
    return queued.select("_at", "doc_id", "size", "source_size", "target", F.when(wanted, taken).otherwise(0).cast("int").alias("times"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "m1") -> DataFrame:
    """How often the mix takes each document: `times` and `taken` (words), with size, source_size and target.

    Sizes are words. Null text or text without words: size 0, taken 0. Null source: a source of its own, last in order.
    Null or repeated doc_id: rows count one by one; equal rows are served one after another. An empty table stays empty.
    Columns other than doc_id, text and source are ignored.
    """
    out = served(keyed(docs, seed), weights)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "m1") -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of docs.

    The mix itself works on keys and sizes; whole texts move once, to meet their row's number of times.
    """
    rows = keyed(docs, seed, whole_row(docs))
    times = served(rows, weights).where("times > 0").select("_at", "times")
    chosen = rows.select("_at", "_row").join(times, "_at")
    return chosen.select(F.explode(F.sequence(F.lit(1), "times")), "_row").select("_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes every document (see mix)."""
    return mix(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
with d as (select doc_id, coalesce('0' || source, '1') g, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) size, md5('m1:' || coalesce(doc_id::varchar, '') || ':' || coalesce(md5(text), '')) u from documents),
s as (select g, sum(size)::bigint size from d group by g),
w as (select *, [1, 2, 3][(row_number() over (order by g) - 1) % 3 + 1]::bigint w, size * 3 cap from s),
r as (select *, cap::double / w::double r from w),
l as (select *, (sum(size) over () - coalesce(sum(cap) over (order by r, g rows between unbounded preceding and 1 preceding), 0))::double
  / (sum(w) over () - coalesce(sum(w) over (order by r, g rows between unbounded preceding and 1 preceding), 0))::double lev from r),
v as (select lev from l where lev <= r order by r, g limit 1),
t as (select g, size source_size, least(cap::double, coalesce((select lev from v) * w, cap::double)) target from l),
q as (select d.*, source_size, target, sum(size) over (partition by d.g order by u rows unbounded preceding)::bigint cum from d join t using (g)),
e as (select doc_id, size, g, u, e, (e * source_size + cum)::double / target f from q, range(3) x(e) where size > 0 and target > 0),
c as (select doc_id, u, size, sum(size) over (order by f, g, u, e rows unbounded preceding) run from e),
k as (select doc_id, count(*) times from c where run <= (select sum(size) from d) group by doc_id)
select d.doc_id, d.size::bigint size, t.source_size, t.target, (d.size * coalesce(k.times, 0))::bigint taken, coalesce(k.times, 0)::int times
from d join t using (g) left join k using (doc_id)
"""
