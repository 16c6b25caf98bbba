"""Books by aggregation: the last writer of a price wins and size zero deletes, so a book needs no replay.

Rows of levels are (venue, symbol, ord, side, price, size): `ord` orders writes of a feed. Exact for feeds that carry the
full book, within one segment; feeds of a fixed window need the replay, where every step evicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import KEY, LEVELS

CHECKSUM_DEPTH = 10


def _entries() -> Column:
    """All levels of a row in the order they are written, bids first: one array, so that a row is read once."""
    side = lambda name, n: F.transform(F.coalesce(F.col(f"{name}s"), F.array().cast(LEVELS)), lambda x, i: F.struct(F.lit(name).alias("side"), F.lit(n).alias("_s"), i.alias("pos"), x["price"].alias("price"), x["size"].alias("size")))
    return F.explode(F.concat(side("bid", 0), side("ask", 1))).alias("l")


def snapshot_levels(snapshots: DataFrame) -> DataFrame:
    """Rows of a snapshot's levels in list order."""
    return snapshots.select(*KEY, "snap_ord", "last_update_id", _entries()).select(*KEY, "snap_ord", "last_update_id", "l.side", "l.pos", "l.price", "l.size")


def delta_levels(deltas: DataFrame) -> DataFrame:
    """Rows of deltas' levels; ord is the struct of arrival, bids before asks, and place in the list."""
    rows = deltas.select(*KEY, "arrival", _entries())
    return rows.select(*KEY, "arrival", F.struct("arrival", "l._s", "l.pos").alias("ord"), "l.side", "l.price", "l.size")


def build(snapshots: DataFrame) -> DataFrame:
    """Level rows of each snapshot's book: of a repeated price the last entry counts, zero sizes are gone."""
    levels = snapshot_levels(snapshots)
    return levels.groupBy(*KEY, "snap_ord", "last_update_id", "side", "price").agg(F.max_by("size", "pos").alias("size")).where("size > 0")


def _place(levels: DataFrame) -> Column:
    """ord as one number: by a struct Spark sorts all rows before it combines any, by a number it hashes them."""
    ord_ = levels.schema["ord"].dataType
    if not isinstance(ord_, StructType) or ord_.names != ["arrival", "_s", "pos"]:
        return F.col("ord")
    # a null arrival comes before all others; 31 bits hold a place in a list
    return F.expr(f"coalesce(cast(ord.arrival as decimal(20,0)), {-(2**63) - 1}) * {2**32} + (ord._s * {2**31} + ord.pos)")


def latest(levels: DataFrame, until: Column | None = None) -> DataFrame:
    """(venue, symbol, side, price, size) of the books after all writes, or after those that `until` lets through."""
    rows = levels if until is None else levels.where(until)
    return rows.groupBy(*KEY, "side", "price").agg(F.max_by("size", _place(rows)).alias("size")).where("size > 0")


def best(book: DataFrame) -> DataFrame:
    """Best bid and ask of each feed, with sizes; null for an empty side."""
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    return book.groupBy(*KEY).agg(
        F.max(F.when(bid, F.col("price"))).alias("bid"),
        F.max_by("size", F.when(bid, F.col("price"))).alias("bid_size"),
        F.min(F.when(ask, F.col("price"))).alias("ask"),
        F.min_by("size", F.when(ask, F.col("price"))).alias("ask_size"),
    )


def top(book: DataFrame, n: int) -> DataFrame:
    """The n best levels of each side with their rank; none for a negative n."""
    better = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    rank = F.row_number().over(Window.partitionBy(*KEY, "side").orderBy(better))
    return book.withColumn("rank", rank).where(F.col("rank") <= n)


def as_views(book: DataFrame) -> DataFrame:
    """A row a feed with sorted arrays of levels."""
    pick = lambda side, sign: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct((sign * F.col("price")).alias("p"), "price", "size"))))
    plain = lambda c: F.transform(c, lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"))).cast(LEVELS)
    return book.groupBy(*KEY).agg(plain(pick("bid", -1)).alias("bids"), plain(pick("ask", 1)).alias("asks"))


def as_snapshot(levels: DataFrame, until: int) -> DataFrame:
    """The full book after sequence `until` of each feed as a snapshot row with that id."""
    return as_views(latest(levels, F.col("ord.arrival") <= until)).withColumn("last_update_id", F.lit(until).cast("bigint"))


def coalesce_deltas(deltas: DataFrame, batch: Column) -> DataFrame:
    """Deltas of a batch merged into one: it covers their ids, and a later entry of a price replaces the earlier in place."""
    rows = deltas.withColumn("batch", batch)
    ids = rows.groupBy(*KEY, "batch").agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))
    levels = delta_levels(rows).join(rows.select(*KEY, "arrival", "batch"), [*KEY, "arrival"])
    merged = levels.groupBy(*KEY, "batch", "side", "price").agg(F.max_by("size", "ord").alias("size"), F.min("ord").alias("at"))
    pick = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("at", "price", "size")))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    lists = merged.groupBy(*KEY, "batch").agg(pick("bid").alias("bids"), pick("ask").alias("asks"))
    return ids.join(lists, [*KEY, "batch"], "left")


def checksum(bids: Column, asks: Column) -> Column:
    """CRC32 over the ten best asks and then bids, price and size of each as plain digits."""
    digits = lambda side: F.transform(F.slice(side, F.lit(1), F.lit(CHECKSUM_DEPTH)), lambda x: F.concat(x["price"].cast("string"), x["size"].cast("string")))
    return F.crc32(F.array_join(F.concat(digits(asks), digits(bids)), "").cast("binary"))


def verify_checksum(views: DataFrame) -> DataFrame:
    """checksum_ok of each view against its published checksum, by the ten best levels whatever the view's depth."""
    return views.withColumn("checksum_ok", checksum(F.col("bids"), F.col("asks")) == F.col("checksum"))


def differences(book: DataFrame, truth: DataFrame) -> DataFrame:
    """Levels in which a book and an independent one differ; empty if they agree."""
    on = [*KEY, "side", "price"]
    both = book.select(*on, "size").join(truth.select(*on, F.col("size").alias("true_size")), on, "full_outer")
    return both.where(~F.col("size").eqNullSafe(F.col("true_size")))
