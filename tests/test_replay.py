import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import book as B
from ledgerline.operators import inject as I
from ledgerline.operators import replay as R
from ledgerline.plans.feeds import as_events, empty_snapshots, level_rows
from ledgerline.schema import COUNTER_NAMES, FEED_EVENTS, KEY, LEVELS, SNAPSHOTS

from .conftest import SF

START = 1_700_000_000_000


def delta(first, last, checksum=None, bids=(), asks=()):
    return R.Row("delta", ms=START, first_seq=first, last_seq=last, bids=list(bids), asks=list(asks), checksum=checksum)


def snap(id_, checksum, bids=(), asks=()):
    return R.Row("snapshot", last_seq=id_, bids=list(bids), asks=list(asks), checksum=checksum)


def test_fault_script():
    """Seven faults of all kinds in one scripted run; every fetch takes 5 ms."""
    # the checksum adds price and size of every level: 99 * 1 + 101 * 1 with their sizes is 202
    good = lambda id_: snap(id_, 202, bids=[(99, 1)], asks=[(101, 1)])
    queue = [good(10), good(20), good(30), snap(20, 0, bids=[(101, 1)], asks=[(100, 1)]), snap(41, 7, bids=[(99, 1)], asks=[(101, 1)]), good(50), R.Row("snapshot", error="transient"), good(60)]
    events = [delta(25, 25, bids=[(99, 1)]), delta(21, 22, bids=[(105, 1)]), R.Row("disconnect", ms=START), delta(51, 52, 999, bids=[(99, 2)])]
    fold = R.fold_rows(R.Options(depth=5, checksum="sum", fetch_ms=5), events, queue)
    assert [tuple(f[:7]) for f in fold.faults] == [
        (1, "gap", START + 5, 11, 25, "sequence gap", 5),
        (2, "cross", START + 10, 0, 22, "delta would cross the book", 5),
        (3, "disconnect", START + 15, 0, 0, "source disconnected", 15),
        (4, "snapshot-reject", START + 20, 0, 20, "snapshot crossed", 0),
        (5, "snapshot-reject", START + 25, 0, 41, "snapshot checksum mismatch", 0),
        (6, "checksum", START + 30, 0, 52, "delta checksum mismatch", 10),
        (7, "snapshot-error", START + 35, 0, 0, "transient snapshot failure", 0),
    ]
    assert fold.counters == dict(gaps=1, resyncs=4, disconnects=1, would_crosses=1, checksum_mismatches=2, snapshot_rejects=2, snapshot_errors=1, rejected=0)


def test_window_evicts_for_good():
    bids = [(100 - i, 1) for i in range(10)]
    fold = R.fold_rows(R.Options(max_depth=10), [delta(11, 11, bids=[(101, 2)]), delta(12, 12, bids=[(101, 0), (90, 4)])], [snap(10, None, bids, [(200, 1)])])
    assert fold.views[-1][3][-1] == (90, 4) and fold.counters["resyncs"] == 0


def test_window_must_hold_the_checksum():
    with pytest.raises(ValueError):
        R.Options(max_depth=9, checksum="crc32")
    assert R.Options(max_depth=10, checksum="crc32").max_depth == 10


@pytest.mark.parametrize("n,state", [(16, "ok"), (17, "stale_snapshot")])
def test_resync_limit(n, state):
    old = [snap(10, None, [], []) for _ in range(n + 2)]
    fold = R.fold_rows(R.Options(), [delta(100 + i, 100 + i) for i in range(n)], old)
    assert fold.status()[0] == state and fold.counters["gaps"] == n
    if state != "ok":
        assert fold.faults[-1][6] == -1


def test_bind_limits():
    crossed = [snap(1, None, [(5, 1)], [(4, 1)]) for _ in range(9)]
    assert R.fold_rows(R.Options(), [delta(1, 1)], crossed[:8]).status()[0] == "snapshot_refused"
    assert R.fold_rows(R.Options(), [delta(2, 2)], [*crossed[:7], snap(1, None, [], [])]).status()[0] == "ok"
    errors = [R.Row("snapshot", error="transient") for _ in range(6)]
    assert R.fold_rows(R.Options(), [delta(2, 2)], [*errors[:5], snap(1, None, [], [])]).status()[0] == "ok"
    assert R.fold_rows(R.Options(), [delta(2, 2)], [*errors, snap(1, None, [], [])]).status()[0] == "snapshot_failed"
    assert R.fold_rows(R.Options(), [delta(2, 2)], [R.Row("snapshot", error="permanent")]).status()[0] == "snapshot_failed"
    assert R.fold_rows(R.Options(), [delta(2, 2)], []).status()[0] == "no_snapshot"


def test_snapshot_keeps_last_of_a_price(spark):
    df = spark.createDataFrame([("v", "s", 0, 0, 7, [(100, 1), (100, 5), (99, 2), (98, 0)], [], None, None)], SNAPSHOTS)
    assert sorted((r["price"], r["size"]) for r in B.build(df).collect()) == [(99, 2), (100, 5)]


#: The levels and the checksum are fixed values: the published example.
def test_published_checksum(spark):
    asks = [(452852, 100000), (452864, 154571953), (452866, 154571109), (452896, 154560911), (452902, 15890660), (452918, 154553491), (452947, 4454749), (452961, 35380000), (452975, 9945542), (452995, 18772827)]
    bids = [(452835, 10000000), (452834, 154582015), (452821, 10000000), (452810, 10000000), (452803, 154592586), (452790, 7990000), (452776, 3310103), (452775, 30000000), (452773, 154602737), (452766, 15445238)]
    df = spark.createDataFrame([(bids, asks)], f"bids {LEVELS}, asks {LEVELS}")
    assert df.select(B.checksum(F.col("bids"), F.col("asks"))).first()[0] == 3310070434 == R.crc_checksum(bids, asks)


#: The published schedule of two seeds.
SCHEDULE = {
    1: "55 gap 103 reorder 150 duplicate 215 disconnect 247 cross 283 coalesce 351 gap 411 reorder 457 duplicate 508 disconnect 543 cross 583 coalesce",
    2: "49 gap 106 reorder 163 duplicate 207 disconnect 245 cross 274 coalesce 354 gap 416 reorder 451 duplicate 504 disconnect 558 cross 570 coalesce",
}


@pytest.mark.parametrize("seed", [1, 2])
def test_schedule(spark, seed):
    df = spark.range(600).select("id", I.scheduled_fault(F.lit(seed).cast("bigint"), F.col("id")).alias("f")).where("f is not null").orderBy("id")
    assert " ".join(f"{r['id']} {r['f']}" for r in df.collect()) == SCHEDULE[seed]


def test_faulted_run_converges(spark):
    """Under the schedule a replay counts what it must and ends in the book of the clean feed."""
    rows = level_rows(spark, SF).withColumn("symbol", F.lit("ALL")).drop("arrival").withColumn("arrival", F.col("event_id") + 1)
    events = as_events(rows)
    fault = I.scheduled_fault(F.lit(1).cast("bigint"), F.col("arrival") - 1)
    marked = events.withColumn("fault", fault)
    out = R.replay(I.inject(events, fault), None, R.Options(policy="as_of", depth=10**6)).cache()
    want, got = I.expected_counters(marked).first(), R.counters(out).first()
    for c in ("gaps", "resyncs", "disconnects", "would_crosses", "snapshot_rejects"):
        assert got[c] == want[c], c
    assert R.status(out).first()["state"] == "ok"
    truth = {(r["side"], r["price"]): r["size"] for r in B.latest(B.delta_levels(events)).collect()}
    last = max(R.views(out).collect(), key=lambda r: r["gen"])
    book = {("bid", p): s for p, s in last["bids"]} | {("ask", p): s for p, s in last["asks"]}
    assert book == truth
    from ledgerline.operators.ordering import view_ordered

    assert R.views(out).where(~view_ordered(F.col("bids"), F.col("asks"))).count() == 0


def test_replay_equals_aggregate(spark):
    rows = level_rows(spark, SF, "user_id")
    out = R.replay(as_events(rows), empty_snapshots(rows), R.Options(depth=10**6, views_every=0)).cache()
    last = R.views(out).withColumn("snap_ord", F.lit(0)).withColumn("last_update_id", F.col("last_seq"))
    replayed = B.snapshot_levels(last).select(*KEY, "side", "price", "size")
    assert B.differences(replayed, B.latest(B.delta_levels(as_events(rows)))).count() == 0


def random_log(rng, n):
    """A log with snapshots in it, gaps, crossed snapshots and crossing updates."""
    seq, out = 0, []
    for a in range(n):
        kind = rng.choice(["snapshot", "bad", "gap", "cross", "stale", "ok", "ok", "ok", "ok", "ok"]) if a else "snapshot"
        if kind in ("snapshot", "bad"):
            out.append(("v", "s", a, a * 10**9, "snapshot", seq, seq, [(50, 1)] if kind == "snapshot" else [(500, 1)], [(100, 1)], None))
            continue
        seq += 2 if kind == "gap" else 0 if kind == "stale" else 1
        bids = [(300, 1)] if kind == "cross" else [(rng.randint(1, 60), rng.randint(0, 3))]
        out.append(("v", "s", a, a * 10**9, "delta", seq, seq, bids, [(rng.randint(90, 150), rng.randint(0, 3))], None))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_segments_equal_whole(spark, seed):
    log = spark.createDataFrame(random_log(random.Random(seed), 400), FEED_EVENTS)
    options = R.Options(policy="in_log", depth=3)
    whole, parts = R.replay(log, None, options).cache(), R.replay_segments(log, options).cache()
    order = lambda df, c: [tuple(r) for r in df.orderBy(c).collect()]
    assert order(R.faults(whole), "id") == order(R.faults(parts), "id")
    assert order(R.views(whole), "gen") == order(R.views(parts), "gen")
    cols = [*COUNTER_NAMES, "gens", "applied"]
    assert R.counters(whole).select(cols).first() == R.counters(parts).select(cols).first()
    assert R.status(whole).first()["state"] == R.status(parts).first()["state"]


def test_segments_bind_next_though_clocks_jump(spark):
    """The rebuild that ends a fault is the next one, not the one of the earliest time."""
    log = [("v", "s", a, ms * 10**6, kind, seq, seq, [(50, 1)], [(100, 1)], None) for a, (kind, ms, seq) in enumerate([("snapshot", 1000, 1), ("delta", 1100, 5), ("snapshot", 9000, 7), ("delta", 9100, 9), ("snapshot", 2000, 9)])]
    df = spark.createDataFrame(log, FEED_EVENTS)
    order = lambda out: [tuple(r) for r in R.faults(out).orderBy("id").collect()]
    assert order(R.replay(df, None, R.Options(policy="in_log"))) == order(R.replay_segments(df, R.Options(policy="in_log")))


def test_segments_end_at_the_limit(spark):
    rows = [("v", "s", a, 0, "snapshot", 0, 0, [(5, 1)], [(4, 1)], None) for a in range(9)]
    log = spark.createDataFrame(rows, FEED_EVENTS)
    options = R.Options(policy="in_log")
    assert R.status(R.replay(log, None, options)).first()["state"] == R.status(R.replay_segments(log, options)).first()["state"] == "snapshot_refused"


def test_fold_holds_a_batch(spark):
    """Feeds of many batches, one after another in a task: the same as folds of whole feeds, without a group a feed."""
    feeds = {f"s{i}": [x for x in random_log(random.Random(i), 150 + i)] for i in range(3)}
    rows = [(v, name, *x) for name, log in feeds.items() for v, _, *x in log]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = R.replay(spark.createDataFrame(rows, FEED_EVENTS).repartition(3), None, R.Options(policy="in_log", depth=3))
        assert "InArrow" in (plan := out._jdf.queryExecution().toString()) and "FlatMapGroups" not in plan
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name, log in feeds.items():
        fold = R.fold_rows(R.Options(policy="in_log", depth=3), [R.Row(x[4], x[2], x[3] // 10**6, x[5], x[6], x[7], x[8], x[9]) for x in log])
        own = [r for r in got if r["symbol"] == name]
        views = sorted((r["n"], r["arrival"], r["last_seq"], [tuple(x) for x in r["bids"]], [tuple(x) for x in r["asks"]]) for r in own if r["what"] == "view")
        assert views == fold.views + fold.last_view()
        faults = sorted([r["n"], r["kind"], r["at_ms"], r["expected_seq"], r["got_seq"], r["reason"], r["duration_ms"], r["arrival"]] for r in own if r["what"] == "fault")
        assert faults == fold.faults and len(faults) > 5
        assert [r["n"] for r in own if r["what"] == "end"] == [fold.gen]


def test_crossed_states_are_counted(spark):
    """A crossed state between two log lines counts."""
    views = spark.createDataFrame([("v", "s", g, g, g, [(105 if g == 7 else 99, 1)], [(101, 1)]) for g in range(1, 12)], f"venue string, symbol string, gen long, arrival long, last_seq long, bids {LEVELS}, asks {LEVELS}")
    faults = spark.createDataFrame([], "venue string, symbol string, arrival long, kind string")
    assert [r["crossed"] for r in R.count_crossed(R.best_series(views, faults)).collect()] == [1] * 11


def test_book_follows_the_true_book():
    """A fetch gives the true book, whatever either wrote since the last one, and writes what differs only."""
    rng = random.Random(5)
    true, own = R.NotedBook([(p, 1) for p in range(1, 2001)]), R.NotedBook()
    own.follow(true)
    for _ in range(60):
        for book in (true, own):
            for _ in range(rng.choice([0, 1, 5, 40])):
                book.apply([(rng.randint(1, 2100), rng.randint(0, 2))], [(rng.randint(3000, 3400), rng.randint(0, 2))])
        copied = rng.random() < 0.1
        if copied:
            own.noted = None
        few = not copied and own.noted is not None and sum(map(len, own.noted)) <= 80
        before = own.prices[0]
        own.follow(true)
        assert own.sizes == true.sizes and own.prices == true.prices and own.sizes[0] is not true.sizes[0]
        assert not few or own.prices[0] is before
    for p in range(1, 6000):
        own.apply([(p, p % 2)], [])
    # notes never outgrow the book
    assert own.noted is None or sum(map(len, own.noted)) <= sum(map(len, own.prices))


@pytest.mark.parametrize("options", [R.Options(policy="as_of"), R.Options(policy="as_of", max_depth=10), R.Options(policy="as_of", checksum="sum")])
def test_as_of_takes_the_true_book(options):
    """A gap fetches the book as the truth rows left it, within the window; its checksum is its own."""
    levels = [(100 - i, 1) for i in range(15)]
    truth = lambda seq, bids: R.Row("truth", ms=START, last_seq=seq, bids=bids)
    rows = [truth(1, levels), delta(1, 1), truth(2, [(100, 7)]), truth(3, [(99, 0)]), delta(3, 3, bids=[(99, 0)])]
    fold = R.fold_rows(options, rows)
    shown = [(100, 7), *levels[2:]]
    assert fold.status()[0] == "ok" and [f[1] for f in fold.faults] == ["gap"]
    assert fold.views[-1][3] == shown[:10] and len(fold.book.prices[0]) == (options.max_depth or len(shown))


def test_waiting_snapshots_become_rows_when_fetched(spark, monkeypatch):
    """Fetches over several Arrow batches and feeds give what a list of snapshots gives; few of them are rows at a time."""
    rng = random.Random(7)
    events, snaps, folds = [], [], {}
    for s in range(3):
        rows, queue = [], []
        for a in range(120):
            gap = rng.random() < 0.5
            seq = 10 * a + 10
            rows.append((f"s{s}", a, seq if gap else seq - 9, seq, [(rng.randint(1, 9), rng.randint(0, 2))]))
        for k in range(150):
            queue.append((k, rng.randint(0, 1200), [(rng.randint(1, 9), 1) for _ in range(rng.choice([0, 1, 30]))], [(50, 1)], rng.choice([None] * 9 + ["transient"])))
        events += [("v", n, a, a * 10**6, "delta", f, l, b, [], None) for n, a, f, l, b in rows]
        snaps += [("v", f"s{s}", k, 0, i, b, x, None, e) for k, i, b, x, e in queue]
        fold = R.fold_rows(R.Options(resync_limit=200), [R.Row("delta", a, a, f, l, b, []) for _, a, f, l, b in rows], [R.Row("snapshot", 0, 0, i, i, b, x, None, e) for _, i, b, x, e in queue])
        folds[f"s{s}"] = fold
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    out = R.replay(spark.createDataFrame(events, FEED_EVENTS), spark.createDataFrame(snaps, SNAPSHOTS), R.Options(resync_limit=200)).cache()
    got = {(r["symbol"], r["gen"]): (r["arrival"], r["last_seq"], [tuple(x) for x in r["bids"]]) for r in R.views(out).collect()}
    status = {r["symbol"]: r["state"] for r in R.status(out).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    out.unpersist()
    assert got == {(s, v[0]): (v[1], v[2], v[3]) for s, f in folds.items() for v in f.views}
    assert status == {s: f.status()[0] for s, f in folds.items()} and sum(f.fetches for f in folds.values()) > 60


def test_latest_book_is_hashed(spark):
    """Order of writes: arrival, nulls first, then the place in the list; no sort of the level rows."""
    row = lambda arrival, bids: ("v", "s", arrival, 0, "delta", 1, 1, bids, [], None)
    big = 2**63 - 1
    df = spark.createDataFrame([row(None, [(1, 9), (2, 9)]), row(-5, [(2, 1), (2, 3)]), row(big, [(3, 1), (3, 4)]), row(big - 1, [(3, 8)]), row(7, [(1, 0)])], FEED_EVENTS)
    book = B.latest(B.delta_levels(df))
    assert sorted((r["price"], r["size"]) for r in book.collect()) == [(2, 3), (3, 4)]
    assert "SortAggregate" not in book._jdf.queryExecution().executedPlan().toString()
