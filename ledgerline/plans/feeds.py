"""Feeds derived from the plain test tables, in Spark and as SQL text for the comparison engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scans import SUM, running
from ..schema import LEVELS

#: Scales that the derived feeds are printed with.
PRICE_SCALE, SIZE_SCALE = 2, 3


def level_rows(spark: SparkSession, sf_dir: str, symbol: str = "event_type") -> DataFrame:
    """One level change for each event: prices in two bands that never cross, a quarter of the sizes deletes.

    symbol: `event_type` (a few large feeds) or `user_id` (many small ones, sides by event_id).
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    c = F.floor(F.col("value") * 100 + 0.5).cast("bigint")
    k = F.get_json_object("props", "$.k").cast("bigint")
    bid = (F.col("user_id" if symbol == "event_type" else "event_id") % 2) == 0
    rows = e.select(
        F.lit("EVT").alias("venue"),
        F.col(symbol).cast("string").alias("symbol"),
        "event_id",
        "user_id",
        "event_type",
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("received_ns"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        F.when(bid, 1 + c % 1000).otherwise(1001 + c % 1000).alias("price"),
        F.when(k % 4 == 0, F.lit(0)).otherwise(k).alias("size"),
        c.alias("c"),
    )
    return running(rows, ["venue", "symbol"], "event_id", {"arrival": (SUM, F.lit(1).cast("bigint"))})


def as_events(rows: DataFrame) -> DataFrame:
    """feed_events of level rows, a delta of one level each."""
    level = F.array(F.struct("price", "size"))
    none = F.array().cast(LEVELS)
    return rows.select(
        "venue",
        "symbol",
        "arrival",
        "received_ns",
        F.lit("delta").alias("kind"),
        F.col("arrival").alias("first_seq"),
        F.col("arrival").alias("last_seq"),
        F.when(F.col("side") == "bid", level).otherwise(none).alias("bids"),
        F.when(F.col("side") == "ask", level).otherwise(none).alias("asks"),
        F.lit(None).cast("bigint").alias("checksum"),
        "event_id",
    )


def empty_snapshots(rows: DataFrame) -> DataFrame:
    """An empty book with id 0 for each feed."""
    none = F.array().cast(LEVELS)
    return rows.select("venue", "symbol").distinct().select("venue", "symbol", F.lit(0).cast("bigint").alias("snap_ord"), F.lit(0).cast("bigint").alias("arrival"), F.lit(0).cast("bigint").alias("last_update_id"), none.alias("bids"), none.alias("asks"), F.lit(None).cast("bigint").alias("checksum"), F.lit(None).cast("string").alias("error"))


def lineitem_rows(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    """Level changes from order lines: a feed for each supplier, or one hot feed of all."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    q = F.col("l_quantity").cast("bigint")
    bid = F.col("l_linenumber") % 2 == 0
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = li.select(
        F.lit("LI").alias("venue"),
        (F.lit("ALL") if hot else F.col("l_suppkey").cast("string")).alias("symbol"),
        F.when(bid, "bid").otherwise("ask").alias("side"),
        (F.when(bid, 1).otherwise(1001) + F.col("l_partkey") % 1000).cast("bigint").alias("price"),
        F.when(q % 5 == 0, F.lit(0)).otherwise(q).cast("bigint").alias("size"),
        F.lit(0).cast("bigint").alias("received_ns"),
        *order,
    )
    return rows.withColumn("arrival", F.row_number().over(Window.partitionBy("venue", "symbol").orderBy(*order)).cast("bigint")).withColumn("event_id", F.col("arrival")).drop(*order)


#: The events feed in SQL: ev has a row a level change.
EV = """ev as (
  select 'EVT' venue, event_type symbol, event_id, user_id, event_type, epoch_us(ts) * 1000 received_ns,
    case when user_id % 2 = 0 then 'bid' else 'ask' end side,
    case when user_id % 2 = 0 then 1 else 1001 end + cast(floor(value * 100 + 0.5) as bigint) % 1000 price,
    case when cast(json_extract_string(props, '$.k') as bigint) % 4 = 0 then 0 else cast(json_extract_string(props, '$.k') as bigint) end size,
    cast(floor(value * 100 + 0.5) as bigint) c,
    row_number() over (partition by event_type order by event_id) arrival
  from events)"""

#: The standing book after every row of ev, in SQL: bk has a row a level change with the best prices after it.
LAST = """lv as (
  select venue, symbol, side, price, arg_max(size, arrival) size from ev group by all),
book as (select * from lv where size > 0)"""
