"""The driver's contract: every query runs on the smallest tables, and the SQL beside it names the same columns."""

import importlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

entry_module = importlib.import_module("__spark_entry__")
from .conftest import SF

OWN = [n for n in entry_module.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return con


def test_flagship(spark):
    assert entry_module.entry(spark).count() > 0


@pytest.mark.parametrize("name", OWN)
def test_query(spark, duck, name):
    """Column names, and every value, against the SQL; all queries have one."""
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = df.select(cols).collect()
    assert rows
    got = duck.execute(entry_module.oracle_sql()[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    text = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
    assert sorted(map(text, rows)) == sorted(text([r[i] for i in at]) for r in got.fetchall())


def test_faulted_feeds_show_all_faults(spark):
    rows = entry_module.queries()["e1_faulted_replay"](spark, "/root/testdata/sf0.01").collect()
    for c in ("gaps", "would_crosses", "disconnects", "snapshot_rejects"):
        assert sum(r[c] for r in rows) > 0, c


def test_schedule_counters_agree(spark):
    for r in entry_module.queries()["f1_f4_chaos_counters"](spark, SF).collect():
        for c in ("gaps", "resyncs", "disconnects", "would_crosses", "snapshot_rejects"):
            assert r[c] == r[f"got_{c}"]


def test_no_state_is_crossed(spark):
    assert not any(r["is_crossed"] for r in entry_module.queries()["e13_e14_best_series"](spark, SF).collect())


def test_best_series_is_whole(spark):
    """Every two-sided view of every feed is in the series, and the log line has each 50th view."""
    got = entry_module.queries()["e13_e14_best_series"](spark, SF).collect()
    assert all(r["crossed"] == 0 for r in got)
    lines = entry_module.queries()["e13_log_line"](spark, SF).collect()
    assert lines and all(r["gen"] % 50 == 0 for r in lines)
    both = {(r["symbol"], r["gen"]): r["bid_text"] for r in got}
    for symbol in {r["symbol"] for r in got}:
        gens = sorted(r["gen"] for r in got if r["symbol"] == symbol)
        assert len(gens) > 0.9 * (gens[-1] - gens[0] + 1)
    for r in lines:
        if "-" not in (r["bid"], r["ask"]):
            assert r["bid"].split(" x ")[0] == both[r["symbol"], r["gen"]]


def test_limits(spark):
    states = {r["symbol"]: r["state"] for r in entry_module.queries()["e4_e5_e6_limits"](spark, SF).collect()}
    want = {0: {"ok"}, 1: {"snapshot_refused"}, 2: {"snapshot_failed"}, 3: {"stale_snapshot", "ok"}}
    assert all(state in want[int(s) % 4] for s, state in states.items())


def test_captures_are_bounded(spark, monkeypatch):
    """A feed of many samples becomes several documents with the same bins."""
    from ledgerline.plans import queries as Q
    from ledgerline.plans.feeds import level_rows

    bins = lambda: sorted(map(tuple, Q.a12(spark, SF).collect()))
    one = bins()
    monkeypatch.setattr(Q, "CAPTURE_SAMPLES", 20)
    e = level_rows(spark, SF).select("venue", "symbol", "event_id", F.lit(2000).alias("ns"))
    docs = Q.capture_documents(e).collect()
    assert max(len(r["tail_ns"]) for r in docs) < 60 and sum(r["total_samples"] for r in docs) == e.count()
    assert bins() == one
