"""Running aggregates along a feed of any size, in two levels.

A window over a feed puts all its rows into one task. Here a feed is cut into stretches of its order: each stretch is
reduced to one row, a window over these rows says what came before each stretch, and what it says goes to the head of the
stretch, along which a second window runs. Rows are dealt once, by feed and stretch; only a row a stretch meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps of the order that one stretch covers.
STRETCH = 8192
SUM, MOST, LAST = "sum", "most", "last"


def running(rows: DataFrame, keys: list[str], by: str, values: dict[str, tuple[str, Column]], then: tuple[str, ...] = (), own: bool = True, stretch: int = STRETCH) -> DataFrame:
    """rows with a column for each of values, name: (SUM, MOST or LAST, value): the sum, the largest or the last value that
    is not null, of the rows of a key up to this one (own=False: before it), in the order of `by` (whole numbers, null
    first) and `then`.

    Where no value came yet the result is null. Rows that tie in the order are taken in any order, as by a window. Null keys
    are keys of their own.
    """
    place = {"_stretch": F.coalesce(F.expr(f"`{by}` div {stretch}"), F.lit(-(2**62)))}
    marked = rows.withColumns(place | {f"_v{i}": value for i, (_, value) in enumerate(values.values())})
    order = F.struct(by, *then)
    kinds = [kind for kind, _ in values.values()]
    reduced, carried, within = [], [], []
    upto = Window.partitionBy(*keys, "_stretch").orderBy(F.desc("_head"), by, *then).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    before = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    for i, kind in enumerate(kinds):
        v, r = F.col(f"_v{i}"), F.col(f"_r{i}")
        if kind == SUM:
            reduced.append(F.sum(v).alias(f"_r{i}"))
            carried.append(F.sum(r).over(before).alias(f"_c{i}"))
            within.append(F.sum(v).over(upto))
        elif kind == MOST:
            reduced.append(F.max(v).alias(f"_r{i}"))
            carried.append(F.max(r).over(before).alias(f"_c{i}"))
            within.append(F.max(v).over(upto))
        else:
            reduced.append(F.max_by(v, F.when(v.isNotNull(), order)).alias(f"_r{i}"))
            carried.append(F.last(r, ignorenulls=True).over(before).alias(f"_c{i}"))
            within.append(F.last(v, ignorenulls=True).over(upto))
    heads = marked.groupBy(*keys, "_stretch").agg(*reduced).select(*keys, "_stretch", *carried, F.lit(True).alias("_head"))
    every = marked.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    out = {}
    for i, (name, kind) in enumerate(zip(values, kinds)):
        c, w = F.max(f"_c{i}").over(upto), within[i]
        out[name] = F.when(c.isNull() & w.isNull(), F.lit(None)).otherwise(F.coalesce(c, F.lit(0)) + F.coalesce(w, F.lit(0))) if kind == SUM else F.greatest(c, w) if kind == MOST else F.coalesce(w, c)
    drops = ["_stretch", "_head", *[f"{p}{i}" for p in ("_v", "_c") for i in range(len(kinds))]]
    return every.withColumns(out).where("not _head").drop(*drops)


def beside(rows: DataFrame, keys: list[str], by: str, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, stretch: int = STRETCH) -> DataFrame:
    """rows with columns of the row before (`before`, name: value of that row) and of the next one (`after`) of a key, in the
    order of `by` (whole numbers, no two equal), as by lag and lead; null where there is none.

    A stretch gets copies of the last row of the stretch before it and of the first of the next, so that rows meet a stretch
    at a time.
    """
    before, after = before or {}, after or {}
    marked = rows.withColumn("_stretch", F.coalesce(F.expr(f"`{by}` div {stretch}"), F.lit(-(2**62))))
    marked = marked.withColumns({"_b": F.struct(F.lit(True).alias("_is"), *[v.alias(n) for n, v in before.items()]), "_a": F.struct(F.lit(True).alias("_is"), *[v.alias(n) for n, v in after.items()])})
    feed = Window.partitionBy(*keys).orderBy("_stretch")
    ends = marked.groupBy(*keys, "_stretch").agg(F.max_by("_b", by).alias("_b"), F.min_by("_a", by).alias("_a"))
    sides = ends.select(*keys, "_stretch", F.lag("_b").over(feed).alias("_b"), F.lead("_a").over(feed).alias("_a"))
    copies = sides.select(*keys, "_stretch", "_b", F.lit(0).alias("_at")).unionByName(sides.select(*keys, "_stretch", "_a", F.lit(2).alias("_at")), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "_stretch").orderBy("_at", by)
    every = marked.withColumn("_at", F.lit(1)).unionByName(copies, allowMissingColumns=True)
    every = every.withColumns({"_b": F.lag("_b").over(order), "_a": F.lead("_a").over(order)}).where("_at = 1")
    return every.withColumns({n: F.col(f"_b.{n}") for n in before} | {n: F.col(f"_a.{n}") for n in after}).drop("_stretch", "_at", "_b", "_a")
