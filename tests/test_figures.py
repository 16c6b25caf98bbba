"""Figures of views, telemetry, fan-out and latency, on small tables."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import fanout as FO
from ledgerline.operators import latency as L
from ledgerline.operators import ordering as O
from ledgerline.operators import telemetry as T
from ledgerline.operators import views as V
from ledgerline.schema import COUNTER_NAMES, KEY, LEVELS

VIEW = "venue string, symbol string, bids array<array<string>>, asks array<array<string>>"


def view(spark, bids, asks):
    return spark.createDataFrame([("v", "s", [list(x) for x in bids], [list(x) for x in asks])], VIEW)


B2, A2 = [("99.0", "1.5"), ("98.0", "2.0")], [("101.0", "0.5"), ("103.0", "4.0")]


def test_depth(spark):
    r = view(spark, B2, A2).select(V.cumulate(F.col("bids")), V.price_ends(F.col("bids"), F.col("asks")), V.depth_points(F.col("bids"), F.col("asks")), V.mid_place(F.col("bids"), F.col("asks")), V.bar_shares(F.col("bids"), F.col("asks"))).first()
    assert [int(x) for x in r[0]] == [15, 35] and tuple(r[1]) == ("98.0", "103.0")
    assert [(p["side"], p["index"], p["left"], p["top"]) for p in r[2]] == [("bid", 0, 2000, 3000), ("bid", 1, 0, 7000), ("ask", 0, 6000, 1000), ("ask", 1, 10000, 9000)]
    assert r[3] == 4000 and r[4] == [37, 50, 12, 100]


@pytest.mark.parametrize("most,top", [(1, 1), (2, 2), (3, 5), (5, 5), (6, 10), (10, 10), (11, 20), (999, 1000), (2001, 5000)])
def test_nice_top(spark, most, top):
    assert int(spark.range(1).select(V.nice_top(F.lit(most).cast("decimal(38,0)"))).first()[0]) == top


def test_tick_labels(spark):
    one = lambda top, scale: spark.range(1).select(V.tick_labels(F.lit(top).cast("decimal(38,0)"), F.lit(scale))).first()[0]
    assert one(5, 0) == ["1.25", "2.5", "3.75", "5"] and one(100, 2) == ["0.25", "0.5", "0.75", "1"]


def test_not_drawable(spark):
    bad = [([("99.0", "0.0")], A2), ([("99.0", "1.0"), ("99.0", "1.0")], A2), ([("102.0", "1.0")], A2), ([("99.00", "1.0")], A2), ([("99.0", "1.00")], A2), ([], []), ([("x", "1.0")], A2)]
    df = view(spark, *bad[0])
    for b in bad[1:]:
        df = df.union(view(spark, *b))
    assert df.select(V.chart_scale(F.col("bids"), F.col("asks")).alias("c")).where("c is not null").count() == 0
    assert view(spark, [], A2).select(V.chart_scale(F.col("bids"), F.col("asks"))).first()[0] == 1


def test_nearest(spark):
    df = view(spark, B2, A2).withColumn("p", V.depth_points(F.col("bids"), F.col("asks")))
    near = lambda place: df.select(V.nearest_point(F.col("p"), F.lit(place))).first()[0]
    assert (near(0), near(1000), near(4000), near(9999)) == ("98.0", "99.0", "99.0", "103.0")


MID = "venue string, symbol string, ord bigint, t_ms bigint, mid string"


def history(spark, points):
    df = spark.createDataFrame([("v", "s", i, t, m) for i, (t, m) in enumerate(points)], MID)
    return [tuple(r) for r in V.mid_history(df).orderBy("session", "t_ms").select("session", "t_ms", "mid").collect()]


def test_history(spark):
    assert history(spark, [(0, "1.00"), (499, "2.00"), (500, "3.00"), (999, "4.00"), (1000, "5.00")]) == [(0, 0, "2.00"), (0, 500, "4.00"), (0, 1000, "5.00")]
    assert history(spark, [(1000, "1.00"), (900, "2.00")]) == [(0, 1000, "1.00"), (1, 900, "2.00")]
    # time may fall below the last row's as long as it does not below the last point's
    assert history(spark, [(1000, "1.00"), (1300, "2.00"), (1200, "3.00"), (1800, "4.00")]) == [(0, 1000, "3.00"), (0, 1800, "4.00")]
    assert history(spark, [(1000, "1.00"), (1300, "2.00"), (999, "3.00"), (1499, "4.00")]) == [(0, 1000, "2.00"), (1, 999, "3.00"), (1, 1499, "4.00")]
    assert history(spark, [(0, "1.00"), (600, "1.0")]) == [(0, 0, "1.00"), (1, 600, "1.0")]


def test_history_ends_with_the_link(spark):
    df = spark.createDataFrame([("v", "s", i, t, "1.00", n) for i, (t, n) in enumerate([(0, 0), (100, 0), (200, 1), (900, 1)])], MID + ", link_breaks bigint")
    assert [(r["session"], r["t_ms"]) for r in V.mid_history(df).orderBy("session", "t_ms").collect()] == [(0, 0), (1, 200), (1, 900)]


def test_history_window(spark):
    df = spark.createDataFrame([("v", "s", i, i * 500, f"{i}.00") for i in range(300)], MID)
    last = V.history_figures(V.mid_history(df)).orderBy(F.desc("t_ms")).first()
    assert (last["n_points"], last["span_ms"], last["change"], last["collecting"]) == (240, 239 * 500, "+239.00", False)


def test_rate_limit_and_throttle(spark):
    df = spark.createDataFrame([("v", "s", i, t, "1") for i, t in enumerate([0, 100, 999, 1000, 1500, 2100, 9000])], MID)
    assert [r["t_ms"] for r in V.rate_limited(df, 1000, KEY).orderBy("ord").collect()] == [0, 1000, 2100, 9000]
    assert [(r["t_ms"], r["shown_ms"]) for r in V.throttled(df, 250, KEY).orderBy("ord").collect()] == [(0, 0), (100, 250), (999, 999), (1000, 1249), (1500, 1500), (2100, 2100), (9000, 9000)]


EVENT = "struct<id:bigint,kind:string,at_ms:bigint,expected_seq:bigint,got_seq:bigint,reason:string,duration_ms:bigint>"
FRAME = f"venue string, symbol string, ord bigint, events array<{EVENT}>, " + ", ".join(f"{c} bigint" for c in COUNTER_NAMES)


def frame(ord_, ids, resyncs=0, duration=-1):
    return ("v", "s", ord_, [(i, "gap", 0, 0, 0, "r", duration) for i in ids], 0, resyncs, 0, 0, 0, 0, 0, 0)


def test_merge(spark):
    df = spark.createDataFrame([frame(0, [1, 2]), frame(1, [2, 3], duration=5), frame(2, [7, 8]), frame(3, [1])], FRAME)
    runs = T.runs(df)
    assert [(r["ord"], r["run"]) for r in runs.orderBy("ord").collect()] == [(0, 0), (1, 0), (2, 0), (3, 1)]
    merged = T.merge_events(runs).where("run = 0").orderBy("rank").collect()
    assert [r["id"] for r in merged] == [8, 7, 3, 2, 1] and [r["duration_ms"] for r in merged] == [-1, -1, 5, 5, -1]
    assert {r["run"]: r["lost"] for r in T.lost_events(runs).collect()} == {0: 3, 1: 0}
    assert {r["run"]: r["new_entries"] for r in T.new_entries(runs).collect()} == {0: 6, 1: 0}


def test_restart_by_counter(spark):
    df = spark.createDataFrame([frame(0, [1], 3), frame(1, [1], 2)], FRAME)
    assert T.runs(df).orderBy(F.desc("ord")).first()["restarted"]


def test_poll_health(spark):
    df = spark.createDataFrame([("v", "s", i, ok, f"s{i}") for i, ok in enumerate([False, False, True, False, False, False, True])], "venue string, symbol string, ord bigint, ok boolean, status string")
    got = [(r["state"], r["shown_status"]) for r in T.poll_health(df).orderBy("ord").collect()]
    assert got == [("loading", None), ("loading", None), ("ok", "s2"), ("degraded", "s2"), ("degraded", "s2"), ("unavailable", "s2"), ("ok", "s6")]


def test_link_and_freshness(spark):
    log = [("connecting", 0, None, None), ("open", 1000, None, None), ("view", 1500, None, None), ("telemetry", 2000, None, None), ("closed", 6000, 2, 9000), ("open", 20000, None, None), ("invalid", 20500, None, None)]
    df = spark.createDataFrame([("v", "s", i, *x) for i, x in enumerate(log)], "venue string, symbol string, ord bigint, type string, now_ms bigint, attempt bigint, retry_at bigint")
    states = T.link_state(df)
    last = states.orderBy(F.desc("ord")).first()
    assert (last["link"], last["tries"], last["view_at"], last["dropped"], last["beat_at"]) == ("open", 0, 0, 1, 20000)
    samples = spark.createDataFrame([("v", "s", t) for t in (500, 1800, 5001, 6500, 20100, 31000)], "venue string, symbol string, now_ms bigint")
    got = [(r["label"], r["detail"]) for r in T.freshness(samples, states).orderBy("now_ms").collect()]
    assert got == [("connecting", None), ("live", "300 ms"), ("no-data", "3 s"), ("reconnecting", "in 3 s · attempt 2"), ("live", None), ("no-data", "11 s")]


LOG = "venue string, symbol string, consumer bigint, arrival bigint, op string, view_seq bigint"


def log(spark, ops):
    return spark.createDataFrame([("v", "s", 1, i, "publish" if o == "p" else "take", i if o == "p" else None) for i, o in enumerate(ops)], LOG)


@pytest.mark.parametrize("ops,delivered,dropped", [("ppt", 1, 1), ("pppt p".replace(" ", ""), 2, 2), ("ptpt", 2, 0)])
def test_fanout(spark, ops, delivered, dropped):
    rows = log(spark, ops)
    publishes = rows.where("op = 'publish'").select(*KEY, "arrival", "view_seq")
    s = FO.delivery_stats(FO.conflate(rows), publishes).first()
    assert (s["delivered"], s["dropped"], s["published"]) == (delivered, dropped, ops.count("p"))


def test_slow_consumer(spark):
    got = FO.conflate(log(spark, "ppppp"), max_lag=2).orderBy("arrival").collect()
    assert [r["outcome"] for r in got] == ["delivered", "supersedes", "supersedes"] and got[-1]["disconnected"]
    assert FO.conflate(log(spark, "pptpptppt"), max_lag=2).where("disconnected").count() == 0
    taken = FO.conflate(log(spark, "ppt")).where("op = 'take'").first()
    assert (taken["outcome"], taken["got_seq"]) == ("taken", 1)


def test_latest(spark):
    df = spark.createDataFrame([("v", "s", g, f"x{g}") for g in (1, 3, 2)], "venue string, symbol string, gen bigint, x string")
    assert FO.latest_views(df).first()["x"] == "x3"


def test_checks(spark):
    df = spark.createDataFrame([([(5, 1), (4, 1)], [(6, 1), (7, 1)]), ([(5, 1), (5, 1)], [(6, 1)]), ([(6, 1)], [(6, 1)]), ([], [(6, 1)])], f"bids {LEVELS}, asks {LEVELS}")
    assert [r[0] for r in df.select(O.view_ordered(F.col("bids"), F.col("asks"))).collect()] == [True, False, False, True]
    assert [r[0] for r in df.select(O.snapshot_crossed(F.col("bids"), F.col("asks"))).collect()] == [False, False, True, False]


def test_open_loop_and_clock(spark):
    df = spark.createDataFrame([("f", k, k * 100 + (250 if k == 5 else 0), k * 100 + 50 + (250 if k == 5 else 0)) for k in range(10)], "feed string, k bigint, begun_ns bigint, done_ns bigint")
    r = L.open_loop(df, ["feed"], 100, 2).first()
    assert (r["sender_late"], r["over_interval"], r["queue_max"], r["due_max_ns"], r["busy_ns"]) == (1, 0, 2, 300, 400) and r["util_pct"] == 50.0
    t = spark.createDataFrame([("f", i, t) for i, t in enumerate([0, 0, 100, 100, 200, 500, 900])], "feed string, ord bigint, t_ns bigint")
    assert L.clock_step(t, ["feed"]).first()["clock_step_ns"] == 300
    b = spark.range(1).select(L.bars(F.lit(500), F.lit(2000), F.lit(4000), F.lit(3000)).alias("b")).first()["b"]
    assert tuple(b) == (0, 50, 100, 75, 4000)
