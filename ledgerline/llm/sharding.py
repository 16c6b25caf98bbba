"""Proportional stratified interleaving into shards (native: DataFrame functions only).

Rows are shuffled within each source by a seeded digest, ranked there, and placed at the fractional rank
(rank - 1 + r) / (rows of the source), r a fixed fraction from the source's digest, so that small sources spread as well;
the order by fractional rank is cut into shards, so that every shard holds every source in the proportion of the whole.

No rank is taken over a whole source or table in one task: the digest (uniform by construction) splits a source into
buckets, the fractional rank (uniform too) splits the table, and ranks are an offset from the buckets' counts plus a
row number within the bucket. Buckets grow in number with the rows, up to 65,536. Rows that are equal in all that the
digest covers are interchangeable; where they are many, they count as one entry of their bucket, and are numbered in
buckets of their own by their place in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import group_key, if_small, power_of_two, read, settle

BUCKETS = 65536
ROWS_PER_BUCKET = 1024


def digest_bucket(digest, buckets: int):
    """Bucket 0..buckets-1 of a hex digest by its first 16 bits; buckets is a power of two up to 65,536."""
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int").bitwiseAND(65535) / F.lit(65536 // buckets)


def running(rows: DataFrame, weight: str, n_rows: int, per_bucket: int) -> DataFrame:
    """Add `_end`: the sum of weight over the rows of the same _g up to and with this one, in the order of _u.

    rows: a written table with _g (not null), _u (hex digest of all that tells rows of a _g apart; equal digests mean
    equal weights) and _at (the row's place). Rows of equal _u follow one another by their place.
    """
    buckets = power_of_two(n_rows // per_bucket, BUCKETS)
    rows = rows.withColumn("_b", F.floor(digest_bucket(F.col("_u"), buckets)).cast("int"))
    sums = rows.groupBy("_g", "_b").agg(F.count("*").alias("_n"), F.sum(weight).alias("_s"))
    before = F.sum("_s").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_g", "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    upto = Window.partitionBy("_g", "_b").orderBy("_u", "_at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("_before") + F.sum(weight).over(upto)
    limit = 8 * per_bucket
    if (sums.agg(F.max("_n")).first()[0] or 0) <= limit:
        return rows.join(offsets, ["_g", "_b"]).withColumn("_end", end).drop("_b", "_before")
    hot = rows.groupBy("_g", "_b", "_u").agg(F.count("*").alias("_m"), F.sum(weight).alias(weight)).where(F.col("_m") > limit // 2)
    hot = settle(hot, "hot-digests")
    keys = if_small(hot.select("_g", "_u", F.lit(True).alias("_hot")), hot.count())
    marked = rows.join(keys, ["_g", "_u"], "left")
    single = marked.where("_hot is null").drop("_hot")
    entries = single.unionByName(hot.withColumn("_whole", F.lit(True)), allowMissingColumns=True)
    ended = entries.join(offsets, ["_g", "_b"]).withColumn("_end", end).drop("_b", "_before")
    spots = ended.where("_whole").select("_g", "_u", (F.col("_end") - F.col(weight)).alias("_from"), "_m")
    spots = settle(spots, "hot-spots")
    many = rows.drop("_b").join(if_small(spots, hot.count()), ["_g", "_u"])
    many = many.withColumn("_sub", F.pmod(F.xxhash64("_at"), F.ceil(F.col("_m") / per_bucket)))
    counts = many.groupBy("_g", "_u", "_sub").agg(F.count("*").alias("_k"))
    earlier = F.sum("_k").over(Window.partitionBy("_g", "_u").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_g", "_u", "_sub", F.coalesce(earlier, F.lit(0)).alias("_skip"))
    number = F.row_number().over(Window.partitionBy("_g", "_u", "_sub").orderBy("_at"))
    many = many.join(counts, ["_g", "_u", "_sub"]).withColumn("_end", F.col("_from") + (F.col("_skip") + number) * F.col(weight))
    return ended.where("_whole is null").drop("_whole", "_m").unionByName(many.drop("_sub", "_skip", "_from", "_m"))


def interleave(rows: DataFrame, shards: int, n_rows: int, seed: str = "s1") -> DataFrame:
    """Add `shard` and `slot` to rows.

    rows: a written table of n_rows rows with _g, _u, _at as running() needs them. Repeated rows get places of their own,
    interchangeable among them. An empty table stays empty.
    """
    buckets = power_of_two(n_rows // ROWS_PER_BUCKET, BUCKETS)
    # a row a source
    sources = rows.groupBy("_g").agg(F.count("*").alias("_n"))
    shift = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("_g"))), 1, 8), 16, 10).cast("long").cast("double") + 0.5) / float(2**32)
    ranked = running(rows.withColumn("_one", F.lit(1)), "_one", n_rows, ROWS_PER_BUCKET).join(sources.withColumn("_shift", shift), "_g")
    placed = ranked.withColumn("_f", ((F.col("_end") - 1).cast("double") + F.col("_shift")) / F.col("_n").cast("double"))
    placed = placed.withColumn("_c", F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1)).cast("int")).drop("_n", "_end", "_one", "_shift")
    # one row for each bucket, 65,536 at most
    starts = placed.groupBy("_c").count().select("_c", F.coalesce(F.sum("count").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.row_number().over(Window.partitionBy("_c").orderBy("_f", "_g", "_u", "_at")) - 1
    out = placed.join(starts, "_c").withColumn("_pos", at.cast("long"))
    out = out.withColumn("shard", F.expr(f"cast(_pos * {shards} div {max(n_rows, 1)} as int)"))
    first = F.expr(f"(shard * {n_rows}L + {shards - 1}) div {shards}")
    return out.withColumn("slot", (F.col("_pos") - first).cast("long")).drop("_c", "_f", "_start", "_pos")


def shard_documents(docs: DataFrame, shards: int = 24, seed: str = "s1") -> DataFrame:
    """Deal all documents into shards by the law `rows`: counts differ by one at most.

    Returns doc_id, size (UTF-8 bytes and 8 more), text_crc32, law, shard, slot, grown_shard (null under this law) and
    source. Null text: no bytes, checksum 0. Null source: a source of its own. Null or repeated doc_id: such rows get
    places like any other; rows equal in every column are interchangeable. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    told = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string"))
    rows = rows.withColumns({"_g": group_key(F.col("source")), "_u": F.md5(told), "_at": F.monotonically_increasing_id()})
    rows = settle(rows, "shard-rows")
    dealt = interleave(rows, shards, rows.count(), seed)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by the law `rows` (see shard_documents)."""
    return shard_documents(read(spark, sf_dir, "documents"))


#: The SQL computes the checksums byte by byte. Rows per bucket do not change the result, so it takes plain windows.
OP5_SQL = r"""
with recursive bits as (select 0 i, range(0, 256)::bigint[] v union all select i + 1, list_transform(v, lambda x: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) from bits where i < 8), crc as (select v from bits where i = 8),
d as (select row_number() over () id, doc_id, source, hex(encode(coalesce(text, ''))) x from documents),
-- a block of 64 bytes at a time, so that no list is as long as a text
b as (select id, 0 pos, 4294967295::bigint c, x from d union all
  select b.id, pos + 64, list_reduce(list_prepend(c, list_transform(range(pos, least(pos + 64, length(x) // 2)), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)), lambda c, b: xor(c // 256, crc.v[((xor(c, b) & 255) + 1)::int])), x from b, crc where pos < length(x) // 2),
s as (select id, xor(arg_max(c, pos), 4294967295) text_crc32 from b group by id),
r as (select doc_id, source, length(x) // 2 + 8 size, text_crc32, coalesce('0' || source, '1') g, md5('s1:' || coalesce(doc_id::varchar, '') || ':' || text_crc32::varchar || ':' || (length(x) // 2 + 8)::varchar) u from d join s using (id)),
f as (select *, ((row_number() over (partition by g order by u) - 1)::double + (('0x' || substr(md5('s1:' || g), 1, 8))::bigint::double + 0.5) / 4294967296.0::double) / (count(*) over (partition by g))::double f from r),
p as (select *, row_number() over (order by f, g, u) - 1 pos, count(*) over () n from f)
select doc_id, size, text_crc32, 'rows' law, (pos * 24 // n)::int shard, pos - ((pos * 24 // n) * n + 23) // 24 slot, null::int grown_shard, source from p
"""
