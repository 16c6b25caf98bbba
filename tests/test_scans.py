"""Running figures by stretches against plain windows, and selection against sorting."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerline.operators import fanout as FO
from ledgerline.operators import latency as L
from ledgerline.operators import replay as R
from ledgerline.operators.scans import LAST, MOST, SUM, beside, running


def test_running_equals_windows(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["k0", "k1", None]), i - 40, rng.choice([None, rng.randint(-5, 5)])) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, at long, v long").repartition(5)
    for own in (True, False):
        w = Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if own else -1)
        want = df.select("key", "at", F.sum("v").over(w), F.max("v").over(w), F.last("v", ignorenulls=True).over(w))
        got = running(df, ["key"], "at", {"a": (SUM, F.col("v")), "b": (MOST, F.col("v")), "c": (LAST, F.col("v"))}, own=own, stretch=7)
        assert got.columns == [*df.columns, "a", "b", "c"]
        assert sorted(map(str, (tuple(r) for r in got.select("key", "at", "a", "b", "c").collect()))) == sorted(map(str, (tuple(r) for r in want.collect())))
    assert running(df.where("false"), ["key"], "at", {"a": (SUM, F.col("v"))}).count() == 0


def test_beside_equals_lag_and_lead(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["k0", "k1", None]), 3 * i - 90, rng.choice([None, rng.randint(-5, 5)])) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, at long, v long").repartition(5)
    w = Window.partitionBy("key").orderBy("at")
    want = df.select("*", F.lag("v").over(w).alias("b"), F.lead(F.struct("at", "v")).over(w).alias("a"))
    got = beside(df, ["key"], "at", {"b": F.col("v")}, {"a": F.struct("at", "v")}, stretch=7)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert beside(df.where("false"), ["key"], "at", {"b": F.col("v")}).count() == 0


def test_selection_equals_sorting(spark):
    rng = random.Random(2)
    rows = [(k, int(rng.choice([rng.randint(0, 9), rng.lognormvariate(8, 4), 2**40 + rng.randint(0, 2)]))) for k in ("a", "b") for _ in range(500)] + [("c", 0), ("d", 3_000)]
    df = spark.createDataFrame(rows, "key string, ns long").repartition(4)
    got = {r["key"]: r for r in L.tail_figures(df, ["key"]).collect()}
    for k in ("a", "b", "d"):
        above = sorted(v for q, v in rows if q == k and v > 1000)
        pick = lambda p: above[int(p * (len(above) - 1))]
        r = got[k]
        assert (r["p50_ns"], r["p90_ns"], r["p99_ns"]) == (pick(0.5), pick(0.9), pick(0.99))
        assert (r["total"], r["at_floor"]) == (sum(q == k for q, _ in rows), sum(q == k and v <= 1000 for q, v in rows))
    assert "c" not in got
    bins = {(r["key"], r["bin"]): r["n"] for r in L.tail_bins(L.tail(df, ["key"]), ["key"]).collect()}
    for k in ("a", "b"):
        above = [v for q, v in rows if q == k and v > 1000]
        width = max(1, max(above) // 32)
        for b in range(33):
            assert bins.get((k, b), 0) == sum(min(v // width, 32) == b for v in above)


def test_next_binds_at_linear_cost(spark):
    """No window that ends with its partition, which costs the square of a feed; values by brute force."""
    rng = random.Random(3)
    kinds = lambda n: [("v", rng.choice("ab"), rng.choice([None, *range(40), 20000, 20001]), i) for i in range(n)]
    faults, binds = kinds(200), sorted({(v, s, a): t for v, s, a, t in kinds(30)}.items(), key=str)
    f = spark.createDataFrame([(v, s, a, i, i) for v, s, a, i in faults], "venue string, symbol string, arrival long, at_ms long, id long")
    b = spark.createDataFrame([(*k, 7 * t) for k, t in binds], "venue string, symbol string, arrival long, at_ms long")
    got = R.recovery(f, b)
    place = lambda a: -1 if a is None else a
    for r in got.collect():
        own = next(x for x in faults if x[3] == r["id"])
        later = sorted((place(a), 7 * t) for (_, s, a), t in binds if s == own[1] and place(a) >= place(own[2]))
        assert r["duration_ms"] == (max(0, later[0][1] - own[3]) if later else -1)
    snaps = spark.createDataFrame([("v", "a", 1, 5), ("v", "a", 2, 9)], "venue string, symbol string, snap_ord long, last_update_id long")
    deltas = spark.createDataFrame([("v", "a", 1, 4, 5), ("v", "a", 2, 6, 8), ("v", "a", 3, 8, 9)], "venue string, symbol string, arrival long, first_seq long, last_seq long")
    points = R.bind_points(snaps, deltas)
    assert sorted((r["snap_ord"], r["bind_arrival"], r["covers"]) for r in points.collect()) == [(1, 2, True), (2, None, None)]
    for df in (got, points):
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()


def test_conflation_by_stretches(spark):
    """Outcomes of logs that span several stretches as by a plain fold, and no window over a whole consumer's log."""
    rng = random.Random(4)
    log = [("v", "s", c, i * 97, rng.choice(["publish", "publish", "take"]), i) for c in (1, 2) for i in range(300)]
    df = spark.createDataFrame([(*r[:5], r[5] if r[4] == "publish" else None) for r in log], "venue string, symbol string, consumer long, arrival long, op string, view_seq long")
    for lag in (None, 6):
        want = []
        for c in (1, 2):
            slot, streak = None, 0
            for *_, at, op, seq in (r for r in log if r[2] == c):
                if op == "take":
                    want.append((c, at, "nothing" if slot is None else "taken", slot, False))
                    slot, streak = None, 0
                    continue
                streak = 0 if slot is None else streak + 1
                cut = lag is not None and streak >= lag
                want.append((c, at, "delivered" if slot is None else "supersedes", None, cut))
                slot = seq
                if cut:
                    break
        got = FO.conflate(df, lag)
        cut = F.col("disconnected") if lag else F.lit(False)
        assert sorted(map(tuple, got.select("consumer", "arrival", "outcome", "got_seq", cut).collect()), key=str) == sorted(want, key=str)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert all("_stretch" in line for line in plan.splitlines() if "Window [" in line)
