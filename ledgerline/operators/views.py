"""Figures of views: depth, bars, curve positions, mid history. Views hold string levels [[price, size], ...], best first.

All but the folds over slots at the end are Columns within a row: no shuffle, no Python, exact in decimal(38,0).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import scalars as S
from ..schema import KEY

DEC = "decimal(38,0)"


def _prices(side: Column) -> Column:
    return F.transform(side, lambda x: x[0])


def _sizes(side: Column) -> Column:
    return F.transform(side, lambda x: x[1])


def size_scale(bids: Column, asks: Column) -> Column:
    """The scale that all sizes share; null unless they are plain, positive and of one scale."""
    sizes = F.concat(_sizes(bids), _sizes(asks))
    first = S.scale_of(F.get(sizes, F.lit(0)))
    return F.when((F.size(sizes) > 0) & F.forall(sizes, lambda s: S.is_plain_decimal(s) & (S.scale_of(s) == first) & F.coalesce(S.to_scaled(s) > 0, F.lit(False))), first)


def _ordered(side: Column, rises: bool) -> Column:
    p = F.transform(_prices(side), S.to_scaled)
    m = F.greatest(F.size(p) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(p, F.lit(1), m).alias("a"), F.slice(p, F.lit(2), m).alias("b"))
    return F.forall(pairs, lambda x: x["a"] < x["b"] if rises else x["a"] > x["b"])


def chart_scale(bids: Column, asks: Column) -> Column:
    """size_scale of a view that can be drawn: prices plain and of one scale, sides in order, not crossed; else null."""
    prices = F.concat(_prices(bids), _prices(asks))
    first = S.scale_of(F.get(prices, F.lit(0)))
    fine = F.forall(prices, lambda p: S.is_plain_decimal(p) & (S.scale_of(p) == first))
    apart = F.coalesce(S.to_scaled(F.get(F.get(bids, F.lit(0)), F.lit(0))) < S.to_scaled(F.get(F.get(asks, F.lit(0)), F.lit(0))), F.lit(True))
    return F.when(fine & _ordered(bids, False) & _ordered(asks, True) & apart, size_scale(bids, asks))


def cumulate(side: Column) -> Column:
    """Running totals of size from the best price outward, in size ticks."""
    start = F.array().cast(f"array<{DEC}>")
    return F.aggregate(F.transform(_sizes(side), S.to_scaled), start, lambda acc, x: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x).cast(DEC))))


def cumulate_rows(levels: DataFrame) -> DataFrame:
    """The same on level rows (KEY, side, rank, size): a window, for books too deep for arrays."""
    return levels.withColumn("cum", F.sum("size").over(Window.partitionBy(*KEY, "side").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))


def price_ends(bids: Column, asks: Column) -> Column:
    """Lowest bid (or best ask) and highest ask (or best bid); null for an empty book."""
    price = lambda side, at: F.get(F.try_element_at(side, F.lit(at)), F.lit(0))
    low, high = F.coalesce(price(bids, -1), price(asks, 1)), F.coalesce(price(asks, -1), price(bids, 1))
    return F.when(low.isNotNull() & high.isNotNull(), F.struct(low.alias("low"), high.alias("high")))


def nice_top(most: Column) -> Column:
    """The least 1, 2 or 5 times a power of ten that is `most` at least; null below 1."""
    power = F.rpad(F.lit("1"), F.length(most.cast("string")), F.lit("0")).cast(DEC)
    steps = F.array(*[(power * F.lit(k)).cast(DEC) for k in (1, 2, 5, 10)])
    return F.when(most >= 1, F.array_min(F.filter(steps, lambda x: x >= most)))


def tick_labels(top: Column, scale: Column) -> Column:
    """Labels at a quarter, a half, three quarters and all of top, exact."""
    return F.array(*[S.trim_fraction(S.from_scaled((top * F.lit(25 * q)).cast(DEC), scale + 2)) for q in (1, 2, 3, 4)])


def _div(a: Column, b: Column) -> Column:
    """Quotient of non-negative integers without its fraction."""
    return ((a - F.pmod(a, b)) / b).cast("bigint")


def depth_points(bids: Column, asks: Column) -> Column:
    """Points of the depth curve: side, index, price, cum, left and top in ten-thousandths; null if it cannot be drawn.

    left: place between the lowest and the highest price (5000 if there is one price only); top: cumulative size over
    nice_top of the largest.
    """
    ends = price_ends(bids, asks)
    low, high = S.to_scaled(ends["low"]), S.to_scaled(ends["high"])
    cb, ca = cumulate(bids), cumulate(asks)
    most = F.greatest(F.coalesce(F.try_element_at(cb, F.lit(-1)), F.lit(0)), F.coalesce(F.try_element_at(ca, F.lit(-1)), F.lit(0))).cast(DEC)

    def points(frame: Column) -> Column:
        def side(name: str, levels: Column, cums: Column) -> Column:
            def point(x: Column, i: Column) -> Column:
                price = S.to_scaled(x["l"][0])
                left = F.when(frame["high"] == frame["low"], F.lit(5000).cast("bigint")).otherwise(_div(((price - frame["low"]) * 10000).cast(DEC), F.when(frame["high"] > frame["low"], (frame["high"] - frame["low"]).cast(DEC)).otherwise(F.lit(1).cast(DEC))))
                return F.struct(F.lit(name).alias("side"), i.alias("index"), x["l"][0].alias("price"), x["c"].alias("cum"), left.alias("left"), _div((x["c"] * 10000).cast(DEC), frame["top"]).alias("top"))

            return F.transform(F.arrays_zip(levels.alias("l"), cums.alias("c")), point)

        return F.concat(side("bid", bids, frame["cb"]), side("ask", asks, frame["ca"]))

    frame = F.struct(low.alias("low"), high.alias("high"), nice_top(most).alias("top"), cb.alias("cb"), ca.alias("ca"))
    return F.when(chart_scale(bids, asks).isNotNull(), F.transform(F.array(frame), points)[0])


def mid_place(bids: Column, asks: Column) -> Column:
    """Place of the mid between the lowest and the highest price in ten-thousandths; null unless both sides are there."""
    ends = price_ends(bids, asks)
    low, high = S.to_scaled(ends["low"]), S.to_scaled(ends["high"])
    bid, ask = S.to_scaled(bids[0][0]), S.to_scaled(asks[0][0])
    both = (F.size(bids) > 0) & (F.size(asks) > 0)
    return F.when(both, _div((((bid + ask) * 5 - low * 10) * 10000).cast(DEC), ((high - low) * 10).cast(DEC)))


def nearest_point(points: Column, place: Column) -> Column:
    """The point nearest to a place in ten-thousandths; ties go to the one nearer the best price, then to the bid."""
    ranked = F.transform(points, lambda p: F.struct(F.abs(p["left"] - place).alias("d"), p["index"].alias("i"), F.when(p["side"] == "bid", 0).otherwise(1).alias("s"), p.alias("p")))
    return F.array_min(F.transform(ranked, lambda r: F.struct(r["d"].alias("d"), r["i"].alias("i"), r["s"].alias("s"), r["p"]["price"].alias("price"))))["price"]


def bar_shares(bids: Column, asks: Column) -> Column:
    """Bars of all levels, bids then asks: whole percent of the book's largest size, 2 at least, 0 for a size of zero."""
    sizes = F.concat(_sizes(bids), _sizes(asks))
    scale = F.array_max(F.transform(sizes, S.scale_of))
    pad = lambda s, k: (S.to_scaled(s) * F.rpad(F.lit("1"), k - S.scale_of(s) + 1, F.lit("0")).cast("decimal(19,0)")).cast(DEC)

    def shares(k: Column) -> Column:
        padded = F.transform(sizes, lambda s: pad(s, k))
        largest = F.array_max(padded)
        return F.transform(F.array(F.struct(padded.alias("v"), largest.alias("m"))), lambda z: F.transform(z["v"], lambda v: F.when(v == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(2), _div((v * 100).cast(DEC), F.greatest(z["m"], F.lit(1).cast(DEC)))))))[0]

    return F.when(F.size(sizes) > 0, F.transform(F.array(scale), shares)[0]).otherwise(F.array().cast("array<bigint>"))


# --- series of mids --------------------------------------------------------------------------------------------------

WINDOW_MS, GAP_MS, MAX_POINTS, ENOUGH = 120_000, 500, 240, 10


def kept_points(rows: DataFrame, gap: int, keys: list[str], restarts: bool) -> DataFrame:
    """Add session and slot_ms to rows (keys, ord, t_ms), in the order of ord: the slot that each falls into.

    A slot starts at a row that lies `gap` or more after the start of the last one; rows nearer to it keep its time. With
    restarts, a row before the slot's start, of another `scale` or of another `link` starts a new session; else it falls
    into the slot. Where a slot starts depends on all before it, so this is a fold; it holds one slot for each task.
    """
    schema = StructType([*rows.schema.fields, StructField("session", LongType()), StructField("slot_ms", LongType())])
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "ord")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, session, at, kind, link = None, 0, None, None, None
        for batch in batches:
            n = batch.num_rows
            own = zip(*[batch.column(c).to_pylist() for c in keys])
            kinds = batch.column("scale").to_pylist() if restarts else [None] * n
            links = batch.column("link").to_pylist() if restarts else [None] * n
            sessions, slots = [], []
            for k, t, now, up in zip(own, batch.column("t_ms").to_pylist(), kinds, links):
                if k != key:
                    key, session, at = k, 0, None
                elif restarts and (up != link or t < at or now != kind):
                    session, at = session + 1, None
                if at is None or t >= at + gap:
                    at = t
                kind, link = now, up
                sessions.append(session)
                slots.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sessions, pa.int64()), pa.array(slots, pa.int64())], names=[*batch.schema.names, "session", "slot_ms"])

    return dealt.mapInArrow(folded, schema)


def mid_history(mids: DataFrame) -> DataFrame:
    """The points of every feed's mid history: (KEY, session, t_ms, mid), from mids (KEY, ord, t_ms, mid, optional
    link_breaks: how often the link was not open so far).

    A point keeps the time of its slot's first mid and takes its slot's last one. Time that falls below the last point's
    starts over, as do another scale of the mids and a link that was not open in between. A one-sided view has no mid and
    adds nothing.
    """
    link = F.col("link_breaks") if "link_breaks" in mids.columns else F.lit(0)
    rows = mids.select(*KEY, "ord", "t_ms", "mid", S.scale_of(F.col("mid")).cast("bigint").alias("scale"), link.cast("bigint").alias("link"))
    slotted = kept_points(rows.where("mid is not null"), GAP_MS, KEY, True)
    return slotted.groupBy(*KEY, "session", F.col("slot_ms").alias("t_ms")).agg(F.max_by("mid", "ord").alias("mid"))


def history_figures(points: DataFrame) -> DataFrame:
    """At every point: points in the trailing window, span, change from the oldest one (null for one point), collecting."""
    w = Window.partitionBy(*KEY, "session").orderBy("t_ms")
    within = w.rangeBetween(-WINDOW_MS, 0)
    rows = points.withColumn("_a", F.array_sort(F.collect_list(F.struct("t_ms", "mid")).over(within)))
    rows = rows.withColumn("_a", F.slice("_a", F.greatest(F.size("_a") - MAX_POINTS + 1, F.lit(1)), MAX_POINTS))
    n = F.size("_a")
    return rows.select(*KEY, "session", "t_ms", "mid", n.alias("n_points"), (F.col("t_ms") - F.col("_a")[0]["t_ms"]).alias("span_ms"), F.when(n > 1, S.mid_change(F.col("_a")[0]["mid"], F.col("mid"))).alias("change"), (n < ENOUGH).alias("collecting"))


def spark_shares(points: DataFrame) -> DataFrame:
    """Place of each mid between the session's lowest and highest in thousandths (500 if flat), and of its time."""
    w = Window.partitionBy(*KEY, "session")
    v = S.to_scaled(F.col("mid"))
    rows = points.withColumn("_v", v).withColumns({"_lo": F.min(v).over(w), "_hi": F.max(v).over(w), "_t0": F.min("t_ms").over(w), "_t1": F.max("t_ms").over(w)})
    flat = F.col("_hi") == F.col("_lo")
    y = F.when(flat, F.lit(500).cast("bigint")).otherwise(_div(((F.col("_v") - F.col("_lo")) * 1000).cast(DEC), F.greatest((F.col("_hi") - F.col("_lo")), F.lit(1)).cast(DEC)))
    x = (F.col("t_ms") - F.col("_t0")).cast("double") / F.greatest(F.lit(1), F.col("_t1") - F.col("_t0")).cast("double")
    return rows.withColumns({"y_thousandths": y, "x_share": x}).drop("_v", "_lo", "_hi", "_t0", "_t1")


def rate_limited(rows: DataFrame, gap_ms: int, keys: list[str]) -> DataFrame:
    """Rows that pass a limit of one in gap_ms: the first, then the next one gap_ms or more after the last that passed."""
    slotted = kept_points(rows, gap_ms, keys, False)
    first = F.row_number().over(Window.partitionBy(*keys, "slot_ms").orderBy("ord"))
    return slotted.withColumn("_f", first).where("_f = 1").drop("_f", "session", "slot_ms")


def throttled(rows: DataFrame, gap_ms: int, keys: list[str]) -> DataFrame:
    """What a display shows that changes once in gap_ms at most: a slot's first value at once, and its last one, if it
    came later, when the slot ends (that starts the next slot)."""
    schema = StructType([*rows.schema.fields, StructField("shown_ms", LongType())])
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "ord")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of a key the end of the running slot, and the row that is held to be shown then
        key, free, held = None, None, None
        for batch in batches:
            keep: list[int] = []
            shown: list[int] = []
            at, before = None, held  # what is held: a row of this batch, or of an earlier one
            out: list[pa.RecordBatch] = []
            for i, (k, t) in enumerate(zip(zip(*[batch.column(c).to_pylist() for c in keys]), batch.column("t_ms").to_pylist())):
                if k != key or t >= free:
                    if at is not None:
                        keep.append(at)
                        shown.append(free)
                    elif before is not None:
                        out.append(before.add_column(before.num_columns, "shown_ms", pa.array([free], pa.int64())))
                    held_one = k == key and (at is not None or before is not None)
                    at = before = None
                    if k == key and held_one and t < free + gap_ms:  # showing what was held began another slot
                        free, at = free + gap_ms, i
                        continue
                    keep.append(i)
                    shown.append(t)
                    key, free = k, t + gap_ms
                else:
                    at, before = i, None
            held = batch.slice(at, 1) if at is not None else before
            yield from out
            yield batch.take(pa.array(keep, pa.int64())).add_column(batch.num_columns, "shown_ms", pa.array(shown, pa.int64()))
        if held is not None:
            yield held.add_column(held.num_columns, "shown_ms", pa.array([free], pa.int64()))

    return dealt.mapInArrow(folded, schema)
