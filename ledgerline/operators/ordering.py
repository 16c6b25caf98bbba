"""Order of a feed: sequence numbers, routing, classification of updates, checks on views.

Running figures are taken by stretches of a feed (see scans.py), so that no task has more than a stretch of a hot feed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .scans import MOST, SUM, running


def synthetic_sequence(routed: DataFrame) -> DataFrame:
    """seq for feeds without ids: accepted snapshots and updates count up from 1; other frames take none."""
    taken = F.col("route").isin("snapshot", "update")
    return running(routed.withColumn("_taken", taken.cast("bigint")), KEY, "arrival", {"seq": (SUM, F.col("_taken"))}).withColumn("seq", F.when(F.col("_taken") > 0, F.col("seq"))).drop("_taken")


def route_events(events: DataFrame) -> DataFrame:
    """Where each event goes: deltas to the book, disconnects to a resync, trades nowhere."""
    return events.withColumn("target", F.when(F.col("kind") == "delta", "book").when(F.col("kind") == "disconnect", "resync").otherwise("ignored"))


def rebind_on_snapshots(routed: DataFrame) -> DataFrame:
    """Events of a feed whose snapshots come in its log: snapshot rows gain `kind` disconnect unless the feed's first.

    A snapshot nobody asked for stands for a dropped connection: it rebinds the book where it is. Updates before the
    feed's first snapshot are discarded.
    """
    snap = F.col("route") == "snapshot"
    rows = running(routed.where(F.col("route").isin("snapshot", "update")), KEY, "arrival", {"_n": (SUM, snap.cast("bigint"))}, own=False).fillna(0, ["_n"])
    return rows.where(snap | (F.col("_n") > 0)).withColumn("kind", F.when(snap & (F.col("_n") > 0), "disconnect").when(snap, "bind").otherwise("delta")).drop("_n")


def segments(rows: DataFrame) -> DataFrame:
    """segment: how many snapshot rows a feed has seen; each can be replayed on its own."""
    return running(rows, KEY, "arrival", {"segment": (SUM, (F.col("route") == "snapshot").cast("bigint"))})


def classify(deltas: DataFrame, bind_id: Column | int = 0) -> DataFrame:
    """`stale`, `gap` or `apply` of each delta of a segment, up to and with its first gap; null after it.

    The last applied id is the largest so far: an applied delta ends above it, a stale one at or below it. Exact inside
    one segment; across segments the replay knows.
    """
    bind = F.lit(bind_id).cast("bigint") if isinstance(bind_id, int) else bind_id
    rows = running(deltas, KEY, "arrival", {"applied_before": (MOST, F.col("last_seq"))}, own=False)
    rows = rows.withColumn("applied_before", F.greatest(bind, F.col("applied_before")))
    kind = F.when(F.col("last_seq") <= F.col("applied_before"), "stale").when(F.col("first_seq") > F.col("applied_before") + 1, "gap").otherwise("apply")
    rows = running(rows.withColumn("_k", kind), KEY, "arrival", {"_gaps": (SUM, (F.col("_k") == "gap").cast("bigint"))}, own=False)
    return rows.withColumn("class", F.when(F.coalesce("_gaps", F.lit(0)) == 0, F.col("_k"))).drop("_k", "_gaps")


def snapshot_crossed(bids: Column, asks: Column) -> Column:
    """Highest bid at or above lowest ask in the lists as they came, zero sizes included; one-sided never."""
    top, low = F.array_max(F.transform(bids, lambda x: x["price"])), F.array_min(F.transform(asks, lambda x: x["price"]))
    return F.coalesce(top >= low, F.lit(False))


def view_crossed(bids: Column, asks: Column) -> Column:
    """Best bid at or above best ask of a sorted view."""
    return F.coalesce(F.get(bids, F.lit(0))["price"] >= F.get(asks, F.lit(0))["price"], F.lit(False))


def _steps(levels: Column, rises: bool) -> Column:
    prices = F.transform(levels, lambda x: x["price"])
    pairs = F.arrays_zip(F.slice(prices, F.lit(1), F.greatest(F.size(prices) - 1, F.lit(0))).alias("a"), F.slice(prices, F.lit(2), F.greatest(F.size(prices) - 1, F.lit(0))).alias("b"))
    return F.forall(pairs, lambda p: p["a"] < p["b"] if rises else p["a"] > p["b"])


def view_ordered(bids: Column, asks: Column) -> Column:
    """Not crossed, bids strictly falling, asks strictly rising."""
    return ~view_crossed(bids, asks) & _steps(bids, False) & _steps(asks, True)


def only_new(views: DataFrame) -> DataFrame:
    """Views whose generation is above all earlier ones of the feed, as a publisher may send them."""
    return running(views, KEY, "arrival", {"_t": (MOST, F.col("gen"))}, own=False).where(F.col("_t").isNull() | (F.col("gen") > F.col("_t"))).drop("_t")
