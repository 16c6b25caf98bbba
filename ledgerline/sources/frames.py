"""Raw venue frames to typed rows: strict integer normalization, routing, and instrument scales.

A frame is one JSON text with its feed and arrival. Frames that cannot be used are `rejected`, frames that are not book
data `ignored`; both keep their row, so nothing is lost silently. All of it is Column code in one pass over the frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import KEY, LEVELS

_BAD = "_corrupt_record string"
#: Fields that differ in case only: they are taken by place, as a name would mean either.
_DIFF = f"e string, U string, u string, b array<array<string>>, a array<array<string>>, {_BAD}"
_DIFF_NAMES = ("_e", "_first", "_last", "_b", "_a", "_bad")
_REST = f"bids array<array<string>>, asks array<array<string>>, {_BAD}"
_KRAKEN_LEVEL = "array<struct<price:decimal(38,18),qty:decimal(38,18)>>"
_KRAKEN = f"channel string, type string, data array<struct<symbol:string,bids:{_KRAKEN_LEVEL},asks:{_KRAKEN_LEVEL},checksum:bigint>>, {_BAD}"
#: Fixed value: number forms that a level must not have: signs, exponents, more than 18 digits that count.
KRAKEN_GUARD = r'"(price|qty)"\s*:\s*"?(-|[0-9.]+[eE]|[0-9]+\.[0-9]{18}[0-9]*[1-9])'
#: A number where a frame of string levels has a price, a size or a further element.
UNQUOTED_LEVEL = r'\[\s*-?[0-9]|"\s*,\s*-?[0-9]'


def _sequence(text: Column) -> Column:
    """An id of a frame; missing counts as 0. Null if it is no 64-bit integer."""
    return F.when(text.isNull(), F.lit(0).cast("bigint")).otherwise(text.try_cast("bigint"))


def _malformed(raw: Column, parsed: Column) -> Column:
    return parsed.isNull() | parsed["_corrupt_record"].isNotNull() | ~F.coalesce(F.trim(raw).startswith("{"), F.lit(False))


def binance_frames(frames: DataFrame, instruments: DataFrame) -> DataFrame:
    """route, first_seq, last_seq, bids, asks and reason of each diff-depth frame; a frame is decoded once."""
    rows = frames.join(instruments.select(*KEY, "price_scale", "size_scale"), KEY, "left")
    f = F.from_json("raw", _DIFF, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    decoded = rows.withColumn("_f", f)
    rows = decoded.select(*rows.columns, "_f.*").toDF(*rows.columns, *_DIFF_NAMES)
    bad = F.col("_bad").isNotNull() | ~F.coalesce(F.trim("raw").startswith("{"), F.lit(False))
    bids, asks = (S.parse_levels(F.col(c), F.col("price_scale"), F.col("size_scale")) for c in ("_b", "_a"))
    rows = rows.withColumns({"bids": bids, "asks": asks, "first_seq": _sequence(F.col("_first")), "last_seq": _sequence(F.col("_last"))})
    unusable = F.col("bids").isNull() | F.col("asks").isNull() | F.col("first_seq").isNull() | F.col("last_seq").isNull() | F.col("raw").rlike(UNQUOTED_LEVEL)
    route = F.when(bad, "rejected").when(~F.coalesce(F.col("_e") == "depthUpdate", F.lit(False)), "ignored").when(unusable, "rejected").otherwise("update")
    return _shaped(rows.withColumn("route", route).withColumn("reason", F.when(F.col("route") == "rejected", F.when(bad, "not decodable").otherwise("bad levels"))))


def binance_snapshots(frames: DataFrame, instruments: DataFrame) -> DataFrame:
    """Snapshot rows of REST depth answers; an answer that does not normalize has route rejected."""
    rows = frames.join(instruments.select(*KEY, "price_scale", "size_scale"), KEY, "left")
    rows = rows.withColumn("f", F.from_json("raw", _REST, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = _malformed(F.col("raw"), F.col("f"))
    bids, asks = (S.parse_levels(F.col(f"f.{c}"), F.col("price_scale"), F.col("size_scale")) for c in ("bids", "asks"))
    rows = rows.withColumns({"bids": bids, "asks": asks, "first_seq": _sequence(F.get_json_object("raw", "$.lastUpdateId"))}).withColumn("last_seq", F.col("first_seq"))
    route = F.when(bad | F.col("bids").isNull() | F.col("asks").isNull() | F.col("first_seq").isNull(), "rejected").otherwise("snapshot")
    return _shaped(rows.withColumn("route", route).withColumn("reason", F.when(F.col("route") == "rejected", F.when(bad, "not decodable").otherwise("bad levels"))))


def kraken_frames(frames: DataFrame, instruments: DataFrame) -> DataFrame:
    """route, bids, asks, checksum and reason of each book message; prices and quantities are JSON numbers (or strings).

    Numbers are read as exact decimals; what a decimal would round or accept beyond plain digits is refused on the text.
    """
    rows = frames.join(instruments.select(*KEY, "price_scale", "size_scale"), KEY, "left")
    rows = rows.withColumn("f", F.from_json("raw", _KRAKEN, {"columnNameOfCorruptRecord": "_corrupt_record"}))
    d = F.get(F.col("f.data"), F.lit(0))
    # decimal(38,18) prints 18 digits; parse_scaled drops the zeros
    levels = lambda c: S.parse_levels(F.transform(F.coalesce(d[c], F.array().cast(_KRAKEN_LEVEL)), lambda x: F.array(x["price"].cast("string"), x["qty"].cast("string"))), F.col("price_scale"), F.col("size_scale"))
    rows = rows.withColumns({"bids": levels("bids"), "asks": levels("asks"), "checksum": d["checksum"], "first_seq": F.lit(None).cast("bigint"), "last_seq": F.lit(None).cast("bigint")})
    bad = _malformed(F.col("raw"), F.col("f"))
    book = F.coalesce(F.get_json_object("raw", "$.channel") == "book", F.lit(False))
    kind = F.coalesce(F.col("f.type"), F.lit(""))
    shape = (F.coalesce(F.size("f.data"), F.lit(0)) <= 0) | ~kind.isin("snapshot", "update")
    refused = F.col("raw").rlike(KRAKEN_GUARD) | F.col("bids").isNull() | F.col("asks").isNull()
    route = F.when(bad, F.when(F.get_json_object("raw", "$.channel").isNotNull() & ~book, "ignored").otherwise("rejected")).when(~book, "ignored").when(shape | refused, "rejected").otherwise(kind)
    reason = F.when(F.col("route") == "rejected", F.when(bad, "not decodable").when(shape, "unknown type or no data").otherwise("bad levels"))
    return _shaped(rows.withColumn("route", route).withColumn("reason", reason))


def _shaped(rows: DataFrame) -> DataFrame:
    used = F.col("route").isin("update", "snapshot")
    checksum = F.col("checksum") if "checksum" in rows.columns else F.lit(None).cast("bigint")
    pick = lambda c, t: F.when(used, F.col(c)).cast(t).alias(c)
    return rows.select(*KEY, "arrival", "received_ns", "route", pick("first_seq", "bigint"), pick("last_seq", "bigint"), pick("bids", LEVELS), pick("asks", LEVELS), checksum.cast("bigint").alias("checksum"), "reason", "raw")


def to_deltas(routed: DataFrame) -> DataFrame:
    """feed_events of accepted updates."""
    return routed.where("route = 'update'").select(*KEY, "arrival", "received_ns", F.lit("delta").alias("kind"), "first_seq", "last_seq", "bids", "asks", "checksum")


def rejects(routed: DataFrame) -> DataFrame:
    """Quarantine rows, with the first 200 characters of the reason."""
    return routed.where("route = 'rejected'").select(*KEY, "arrival", S.cut_text(F.col("reason"), 200).alias("reason"), "raw")


def binance_scales(answers: DataFrame) -> DataFrame:
    """Scales of each feed from exchange information (raw): both PRICE_FILTER and LOT_SIZE of the first symbol needed."""
    info = F.from_json("raw", "symbols array<struct<symbol:string,filters:array<struct<filterType:string,tickSize:string,stepSize:string>>>>")
    rows = answers.select(*KEY, F.get(info["symbols"], F.lit(0))["filters"].alias("filters"))
    rows = rows.select(*KEY, F.posexplode_outer("filters").alias("pos", "x"))
    last = lambda kind, inc: F.max_by(S.scale_of_increment(F.col(inc)), F.when(F.col("x.filterType") == kind, F.col("pos")))
    return rows.groupBy(*KEY).agg(last("PRICE_FILTER", "x.tickSize").alias("price_scale"), last("LOT_SIZE", "x.stepSize").alias("size_scale")).withColumn("ok", F.col("price_scale").isNotNull() & F.col("size_scale").isNotNull())


def kraken_scales(answers: DataFrame) -> DataFrame:
    """Scales of each feed from asset pair information (raw): no error, exactly one pair."""
    rows = answers.withColumn("p", F.from_json("raw", "error array<string>, result map<string,struct<pair_decimals:int,lot_decimals:int>>"))
    fine = F.coalesce((F.coalesce(F.size("p.error"), F.lit(0)) <= 0) & (F.size("p.result") == 1), F.lit(False))
    one = F.get(F.map_values("p.result"), F.lit(0))
    return rows.select(*KEY, F.when(fine, one["pair_decimals"]).alias("price_scale"), F.when(fine, one["lot_decimals"]).alias("size_scale"), fine.alias("ok"))
