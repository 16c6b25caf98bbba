"""Faults put into a recorded log on a schedule, to test what a replay makes of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import KEY, LEVELS
from .scans import STRETCH, SUM, beside, running

PERIOD, JITTER = 300, 20
#: Fault kinds in their order, with the step of a period at which each may first happen.
PLAN = {"gap": 40, "reorder": 100, "duplicate": 150, "disconnect": 200, "cross": 240, "coalesce": 270}
#: A bid above every ask of the derived feeds.
CROSS_PRICE = 2001


def _spread(x: np.ndarray) -> np.ndarray:
    """SplitMix64's output function after one step of its state."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


@F.pandas_udf(StringType())
def scheduled_fault(seed: pd.Series, step: pd.Series) -> pd.Series:
    """The fault of a step, null if it has none: every kind once a period, at its first step plus a jitter by the seed."""
    at = step.to_numpy(np.int64)
    period = _spread(_spread(seed.to_numpy(np.int64).astype(np.uint64)) + (at // PERIOD).astype(np.uint64))
    out = np.full(len(at), None, object)
    for number, (kind, first) in enumerate(PLAN.items(), start=1):
        jitter = (_spread(period + np.uint64(number)) % np.uint64(JITTER)).astype(np.int64)
        out[(at >= 0) & (at % PERIOD == first + jitter)] = kind
    return pd.Series(out)


def inject(events: DataFrame, fault: Column, with_truth: bool = True, stretch: int = STRETCH) -> DataFrame:
    """The log of single-sequence deltas with faults put in, arrivals numbered anew.

    gap drops the row, duplicate sends it twice, reorder sends it after the next one, disconnect and cross insert an
    event before it (cross: a bid above all asks under the row's own sequence), coalesce merges it with the next row. A
    row that its predecessor's coalesce takes in has no fault of its own. with_truth: every clean delta is in the log
    as a `truth` row too, which replays by the policy `as_of` use. Rows meet by stretches of a feed, never a whole feed in one
    task; the events are read several times.
    """
    next_ = {"_next": F.struct("last_seq", "bids", "asks")}
    rows = beside(events.withColumn("fault", fault), KEY, "arrival", {"_before": F.col("fault")}, next_, stretch)
    rows = rows.withColumn("_joined", F.coalesce(F.col("_before") == "coalesce", F.lit(False)))
    rows = rows.withColumn("fault", F.when(F.col("_joined"), None).otherwise(F.col("fault")))
    f = F.coalesce(F.col("fault"), F.lit(""))
    none = F.array().cast(LEVELS)
    row = lambda where, sub, kind, first, last, bids, asks: F.when(where, F.struct(sub.alias("pos"), F.lit(kind).alias("kind"), first.alias("first_seq"), last.alias("last_seq"), bids.alias("bids"), asks.alias("asks")))
    here = lambda a, b: F.struct((F.col("arrival") + a).alias("a"), F.lit(b).alias("b"))
    c = F.col
    plain = ~c("_joined") & ~f.isin("gap", "reorder", "coalesce")
    # a later level of a price replaces an earlier one
    over = lambda old, new: F.concat(F.filter(old, lambda x: ~F.exists(new, lambda y: y["price"] == x["price"])), new)
    out = [
        row(f == "disconnect", here(0, -1), "disconnect", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), none, none),
        row(f == "cross", here(0, -1), "delta", c("first_seq"), c("last_seq"), F.array(F.struct(F.lit(CROSS_PRICE).cast("bigint").alias("price"), F.lit(1).cast("bigint").alias("size"))), none),
        row(F.lit(with_truth), here(0, 0), "truth", c("first_seq"), c("last_seq"), c("bids"), c("asks")),
        row(plain, here(0, 1), "delta", c("first_seq"), c("last_seq"), c("bids"), c("asks")),
        row(f == "duplicate", here(0, 2), "delta", c("first_seq"), c("last_seq"), c("bids"), c("asks")),
        row(f == "reorder", here(1, 3), "delta", c("first_seq"), c("last_seq"), c("bids"), c("asks")),
        row((f == "coalesce") & c("_next").isNotNull(), here(1, 1), "delta", c("first_seq"), c("_next.last_seq"), over(c("bids"), c("_next.bids")), over(c("asks"), c("_next.asks"))),
        row((f == "coalesce") & c("_next").isNull(), here(0, 1), "delta", c("first_seq"), c("last_seq"), c("bids"), c("asks")),
    ]
    flat = rows.select(*KEY, "received_ns", F.col("arrival").alias("step"), F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("e")).select(*KEY, "received_ns", "step", "e.*")
    numbered = running(flat.select("*", "pos.*"), KEY, "a", {"arrival": (SUM, F.lit(1).cast("bigint"))}, then=("b",), stretch=stretch)
    return numbered.select(*KEY, "arrival", "received_ns", "kind", "first_seq", "last_seq", "bids", "asks", F.lit(None).cast("bigint").alias("checksum"), "step")


def crossing_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots with a bid put at their best ask, bids in order again."""
    low = F.array_min(F.transform("asks", lambda x: x["price"]))
    bids = F.concat(F.array(F.struct(low.alias("price"), F.lit(1).cast("bigint").alias("size"))), F.col("bids"))
    ordered = F.transform(F.array_sort(F.transform(bids, lambda x: F.struct((-x["price"]).alias("k"), x["price"].alias("price"), x["size"].alias("size")))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    return snapshots.withColumn("bids", F.when(low.isNull(), F.col("bids")).otherwise(ordered))


def stale_first(snapshots: DataFrame, older: DataFrame) -> DataFrame:
    """Fetch order in which an older state comes first: its rows get a snap_ord before all others of the feed."""
    return older.withColumn("snap_ord", F.lit(-1).cast("bigint")).unionByName(snapshots)


def expected_counters(faulted: DataFrame) -> DataFrame:
    """What a replay by `as_of` must count for a schedule: reorders show as gaps, gaps, crosses and disconnects resync."""
    f = F.col("fault")
    return faulted.groupBy(*KEY).agg(
        F.count_if(f.isin("gap", "reorder")).alias("gaps"),
        F.count_if(f.isin("gap", "reorder", "disconnect", "cross")).alias("resyncs"),
        F.count_if(f == "disconnect").alias("disconnects"),
        F.count_if(f == "cross").alias("would_crosses"),
        F.lit(0).cast("bigint").alias("snapshot_rejects"),
    )
