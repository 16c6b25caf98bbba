"""The replay by stretches against one fold, under faults of all kinds."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import inject as I
from ledgerline.operators import replay as R
from ledgerline.operators import stretches as T
from ledgerline.plans.feeds import as_events, empty_snapshots, level_rows
from ledgerline.schema import COUNTER_NAMES, FEED_EVENTS, KEY, SNAPSHOTS

from .conftest import SF


def same(events, snapshots, options, stretch):
    whole = R.replay(events, snapshots, options).cache()
    parts = T.replay_stretches(events, snapshots, options, stretch)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(R.faults(whole)) == rows(R.faults(parts))
    assert rows(R.views(whole)) == rows(R.views(parts))
    cols = [*KEY, *COUNTER_NAMES, "gens", "applied", "last_event_ms"]
    assert rows(R.counters(whole).select(cols)) == rows(R.counters(parts).select(cols))
    assert rows(R.status(whole)) == rows(R.status(parts))
    whole.unpersist()
    return parts


def random_feed(rng, name, n, faults):
    """Events with faults at a rate, and snapshots on request that fit them, some crossed, failing or too old."""
    seq, book, events, snaps = 0, {}, [], []

    def snapshot(error=None, bids=None):
        sides = [[(p, s) for (d, p), s in book.items() if d == side and s] for side in (0, 1)]
        snaps.append(("v", name, len(snaps), 0, seq - (rng.random() < 0.2) * rng.randint(0, 2) if seq else 0, sides[0] if bids is None else bids, sides[1], None, error))

    snapshot()
    for a in range(n):
        kind = rng.choice(["gap", "cross", "stale", "disconnect", "far", "bad"]) if rng.random() < faults else "ok"
        if kind == "disconnect":
            events.append(("v", name, a, a * 10**6, "disconnect", None, None, [], [], None))
        elif kind == "cross":
            events.append(("v", name, a, a * 10**6, "delta", seq + 1, seq + 1, [(300, 1)], [], None))
        else:
            seq += {"gap": 2, "stale": 0, "far": rng.randint(5, 60)}.get(kind, 1)
            bids, asks = [(rng.randint(1, 40), rng.randint(0, 3))], [(rng.randint(90, 150), rng.randint(0, 3))]
            first = seq if kind in ("gap", "far", "bad") else max(0, seq - rng.randint(0, 1))
            events.append(("v", name, a, a * 10**6, rng.choice(["delta"] * 9 + ["trade"]), first, seq, bids, asks, None))
            for side, levels in enumerate((bids, asks)):
                book.update({(side, p): s for p, s in levels})
        if kind != "ok":
            if kind == "bad":
                snapshot("transient")
                snapshot(None, [(500, 1)])
            snapshot()
    return events, snaps


@pytest.mark.parametrize("case", range(2))
def test_random_faults(spark, case):
    """Twenty feeds of a seed each."""
    events, snaps = [], []
    for seed in range(20):
        rng = random.Random(100 * case + seed)
        e, s = random_feed(rng, f"s{seed}", rng.choice([1, 90, 400]), rng.choice([0, 0.004, 0.02, 0.1]))
        events += e
        snaps += s
    e = spark.createDataFrame(events, FEED_EVENTS).coalesce(2)
    s = spark.createDataFrame(snaps, SNAPSHOTS).coalesce(1)
    options = R.Options(depth=3, views_every=case, fetch_ms=2 * case, resync_limit=(16, 2)[case])
    out = same(e, s, options, (50, 16)[case])
    assert R.faults(out).select("kind").distinct().count() >= 5 and R.status(out).select("state").distinct().count() > 1


def test_scheduled_faults(spark):
    """Snapshots of the true book on request, with a fault of each kind in every stretch."""
    rows = level_rows(spark, SF)
    events = as_events(rows)
    log = I.inject(events, I.scheduled_fault(F.lit(1).cast("bigint"), F.col("arrival") - 1)).cache()
    same(log, None, R.Options(policy="as_of", depth=5, fetch_ms=3), 64)
    log.unpersist()


def test_scheduled_faults_injected_by_stretches(spark):
    """Feeds cut into stretches at injection and replay both, of which each third view is kept."""
    rows = as_events(level_rows(spark, SF)).withColumn("fault", I.scheduled_fault(F.lit(1).cast("bigint"), F.col("arrival") - 1)).cache()
    log = I.inject(rows, F.col("fault"), stretch=16).cache()
    assert sorted(map(str, log.collect())) == sorted(map(str, I.inject(rows, F.col("fault")).collect()))
    same(log, None, R.Options(policy="as_of", depth=2, views_every=3), 128)
    rows.unpersist(), log.unpersist()


def test_clean_feeds_take_two_rounds(spark, monkeypatch):
    rows = level_rows(spark, SF)
    events = as_events(rows).drop("event_id").cache()
    folds = []
    fold = T.fold_sorted
    monkeypatch.setattr(T, "fold_sorted", lambda *args: folds.append(args) or fold(*args))
    same(events, empty_snapshots(rows), R.Options(depth=5), 30)
    assert len(folds) == 2
    events.unpersist()


def test_nothing(spark):
    none, snaps = spark.createDataFrame([], FEED_EVENTS), spark.createDataFrame([], SNAPSHOTS)
    assert T.replay_stretches(none, snaps).count() == 0
    one = spark.createDataFrame([("v", "s", None, None, "delta", None, None, [], [], None)], FEED_EVENTS)
    same(one, snaps, R.Options(), 10)
    with pytest.raises(ValueError):
        T.replay_stretches(one, snaps, R.Options(max_depth=5))
