"""Latest-wins delivery of views to consumers, from a log of publishes and takes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import KEY
from .scans import LAST, MOST, SUM, running

CONSUMER = [*KEY, "consumer"]


def consumer_log(publishes: DataFrame, takes: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """One log a consumer: the feed's publishes (KEY, arrival, view_seq) within its subscription, and its own takes.

    subscriptions: CONSUMER, from_arrival, to_arrival. The join is by feed and bounded by the subscription.
    """
    got = publishes.join(subscriptions, KEY).where("arrival between from_arrival and to_arrival").select(*CONSUMER, "arrival", F.lit("publish").alias("op"), "view_seq")
    return got.unionByName(takes.select(*CONSUMER, "arrival", F.lit("take").alias("op"), F.lit(None).cast("bigint").alias("view_seq")))


def conflate(log: DataFrame, max_lag: int | None = None) -> DataFrame:
    """outcome of each row of consumers' logs (CONSUMER, arrival, op, view_seq).

    A publish into an empty slot is `delivered`; onto a view not yet taken it `supersedes` that one, which is dropped. A
    take gets the newest view (`taken`, its sequence in got_seq) or `nothing`. With max_lag, the supersede that is the
    max_lag-th in a row disconnects the consumer; later rows are gone.
    """
    publish, take = F.col("op") == "publish", F.col("op") == "take"
    rows = running(log, CONSUMER, "arrival", {"_made": (SUM, publish.cast("bigint"))}, then=("op",))
    view = F.when(publish & F.col("view_seq").isNotNull(), F.struct("_made", "view_seq"))
    rows = running(rows, CONSUMER, "arrival", {"_taken": (LAST, F.when(take, F.col("_made"))), "_view": (LAST, view)}, then=("op",), own=False)
    taken = F.coalesce("_taken", F.lit(0))  # the publishes up to the last take
    newest = F.when(F.col("_view._made") > taken, F.col("_view.view_seq"))
    rows = rows.withColumn("streak", F.col("_made") - taken - 1)
    rows = rows.withColumn(
        "outcome",
        F.when(publish, F.when(F.col("streak") == 0, "delivered").otherwise("supersedes")).otherwise(F.when(newest.isNull(), "nothing").otherwise("taken")),
    ).withColumn("got_seq", F.when(take, newest)).drop("_made", "_taken", "_view")
    if max_lag is not None:
        cuts = F.when(publish & (F.col("streak") >= max(max_lag, 1)), -F.col("arrival"))
        rows = running(rows, CONSUMER, "arrival", {"_cut": (MOST, cuts)}, then=("op",))
        rows = rows.where(F.col("_cut").isNull() | (F.col("arrival") <= -F.col("_cut")))
        rows = rows.withColumn("disconnected", F.coalesce(F.col("arrival") == -F.col("_cut"), F.lit(False))).drop("_cut")
    return rows


def delivery_stats(outcomes: DataFrame, publishes: DataFrame) -> DataFrame:
    """consumers, delivered (into an empty slot), dropped (a view superseded before its take) and published of each feed;
    publishes count without any consumer."""
    sent = outcomes.groupBy(*KEY).agg(F.countDistinct("consumer").alias("consumers"), F.count_if(F.col("outcome") == "delivered").alias("delivered"), F.count_if(F.col("outcome") == "supersedes").alias("dropped"))
    made = publishes.groupBy(*KEY).agg(F.count("*").alias("published"))
    return made.join(sent, KEY, "left").fillna(0, ["consumers", "delivered", "dropped"])


def latest_views(views: DataFrame) -> DataFrame:
    """The newest view of each feed, as a batch boundary sees it."""
    other = [c for c in views.columns if c not in (*KEY, "gen")]
    return views.groupBy(*KEY).agg(F.max("gen").alias("gen"), F.max_by(F.struct(*other), "gen").alias("_v")).select(*KEY, "gen", "_v.*")
