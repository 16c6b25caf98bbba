"""Neighbours, URLs and rollups on small tables, and the contract of the registered queries."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import neighbours, queries, rollups, urls
from ledgerline.llm.common import shared_dir

SF = "/root/testdata/sf0.001"


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, q long")


def brute(rows, every, k):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dim = max(sorted({len(v) for _, v in fine}), key=lambda n: sum(len(v) == n for _, v in fine))
    fine = [(i, v) for i, v in fine if len(v) == dim]
    out = {}
    for i, v in fine:
        if i % every == 0:
            scored = sorted(((-float(v @ w) / np.sqrt((v @ v) * (w @ w)), j) for j, w in fine if j != i))[:k]
            out[i] = [(j, -s) for s, j in scored]
    return out


def test_neighbours_match_brute_force(spark):
    """With every cell visited the search is exact, with copies, odd vectors and few candidates."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0, 1) for i in range(200)]
    rows += [(200 + i, rows[7][1], 0, 1) for i in range(20)]  # copies
    rows += [(300, None, 0, 1), (301, [], 0, 1), (302, [0.0] * 8, 0, 1), (303, [1.0, None] * 4, 0, 1), (304, [float("nan")] * 8, 0, 1), (305, [float("inf")] + [1.0] * 7, 0, 1), (310, [1.0] * 4, 0, 1), (None, rows[0][1], 0, 1)]
    got = neighbours.search(vectors(spark, rows), every=10, target=1.0).collect()
    want = brute(rows, 10, 5)
    by_query = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by_query.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(by_query[r["query_id"]])
    assert by_query.keys() == want.keys()
    for q in want:
        assert [j for j, _ in by_query[q]] == [j for j, _ in want[q]]
        assert all(abs(s - w) < 1e-12 for (_, s), (_, w) in zip(by_query[q], want[q]))
    assert [j for j, _ in by_query[200]] == [7, 201, 202, 203, 204]


def test_few_vectors(spark):
    assert neighbours.search(vectors(spark, [])).count() == 0
    assert neighbours.search(vectors(spark, [(0, [1.0, 2.0], 0, 1)])).count() == 0
    got = neighbours.search(vectors(spark, [(0, [1.0, 0.0], 0, 1), (3, [1.0, 1.0], 0, 1), (2, [2.0, 2.0], 0, 1)])).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 2), (0, 3)]


def ranked(spark, rows, every, k=5):
    """Neighbours of every query by brute force in plain double arithmetic, ties to smaller ids, and those of a search
    that visits every cell."""

    def cosine(v, w):
        v, w = (x / 2.0 ** np.frexp(np.abs(x).max())[1] for x in (v, w))
        return (v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))

    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    fine = [(i, np.array(v)) for i, v in rows]
    want = {}
    for i, v in fine:
        if i % every == 0:
            near = sorted((-cosine(v, w), j) for j, w in fine if j != i and len(v) == len(w))[:k]
            if near:
                want[i] = [j for _, j in near]
    got = {}
    for r in sorted(neighbours.search(df, every=every, k=k, target=1.0).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    return got, want


def test_ties_of_scaled_copies(spark):
    """Many multiples of one vector: rounding tells some apart, ids the others."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=6)
    rows = [(i, (base * (1 + i)).tolist()) for i in range(40)] + [(100 + i, (np.array([1.0, 2.0, 3.0, 0, 0, 0]) * 2.0**i).tolist()) for i in range(40)]
    got, want = ranked(spark, rows, 10)
    assert got == want and want[100] == [101, 102, 103, 104, 105]


def test_lengths_and_large_components(spark):
    """Vectors of each length have neighbours among their own; components near 1e160 or 1e-160 have a cosine."""
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=8) * 10.0 ** rng.choice([-160, 0, 160])).tolist()) for i in range(60)]
    rows += [(100 + i, rng.normal(size=3).tolist()) for i in range(7)] + [(200, [1.0])]
    got, want = ranked(spark, rows, 20)
    assert got == want and set(got) == {0, 20, 40, 100}


def test_blocks_hold_every_centroid():
    rng = np.random.default_rng(1)
    counts = np.array([0, 5, 900, 3, 0, 40, 60, 2])
    base, many = neighbours.blocks_of(rng.normal(size=(8, 4)), counts, 4)
    spans = sorted((b, b + m) for b, m in zip(base, many))
    per = -(-counts.sum() // neighbours.BLOCKS)
    load = np.zeros(max(e for _, e in spans))
    for b, m, c in zip(base, many, counts):
        load[b : b + m] += c / m
    assert load.max() <= per and many[2] == -(-900 // per)


def test_walk_passes_in_order():
    rng = np.random.default_rng(0)
    d1, d2, cells = rng.random(6), rng.random(6), rng.integers(0, 5, (6, 6))
    sums = d1[:, None] + d2
    for quota in (1, 5, 20, 60):
        at = neighbours.reach(d1, d2, cells, quota)
        passed = cells[sums <= at + 1e-15].sum()
        assert passed >= min(quota, cells.sum()) and cells[sums < at - 1e-15].sum() < quota


def test_recall_on_the_table(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in t.collect()]
    want = brute(rows, 50, 5)
    got = {}
    for r in neighbours.search(t).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & {j for j, _ in v}) / len(v) for q, v in want.items()]) >= 0.9


URLS = {
    "https://www.A.Example.NET/en/1?x": ("www.a.example.net", "/en/1", "example.net/en/"),
    "https://example.net/de/1": ("example.net", "/de/1", "net/"),
    "http://b.example.com/de/#top": ("b.example.com", "/de/", "example.com/de/"),
    "http://notexample.com/de/": ("notexample.com", "/de/", None),
    "http://x.org/fr/9": ("x.org", "/fr/9", "org/fr/"),
    "http://x.org": ("x.org", "", None),
    "http://net": ("net", "", None),
    "http://x.net": ("x.net", "", None),
    "http://x.org?/fr/": ("x.org", "", None),
    "http://": ("", "", None),
    "x.net/en": ("", "", None),
    "ftp://u://x.net/": ("u:", "//x.net/", None),
    None: ("", "", None),
    "": ("", "", None),
}


def test_url_parts_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(URLS)] + [(0, list(URLS)[0], None, 2)], "page_id long, url string, html string, g long")
    got = urls.judge_urls(pages).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule = list(URLS.values())[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        if rule:
            assert r["verdict"] == ("allow" if rule in urls.ALLOW else "block")
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_urls_learn_from_the_rules(spark):
    rows = [(i, f"https://spam{i}x.net/pills/{i}") for i in range(300)] + [(1000 + i, f"https://museum{i}.org/fr/{i}") for i in range(300)]
    rows += [(5000, "https://spamxx.info/pills/7"), (5001, "https://museumy.info/fr/9")]
    got = {r["page_id"]: r["verdict"] for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[5000] == "block" and got[5001] == "allow"
    only = urls.judge_urls(spark.createDataFrame(rows[:300] + rows[-2:], "page_id long, url string")).where("rule is null")
    assert {r["verdict"] for r in only.collect()} == {"allow"}  # nothing allowed to learn from


CHANGE = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"


def test_rollup(spark):
    r = rollups.Rollup(spark, f"{shared_dir(spark)}/rollup-test")
    one = spark.createDataFrame([("insert", "s", "en", "v1", 10, None), ("insert", "s", "en", "v1", 5, None), ("insert", None, None, "v1", None, None)], CHANGE)
    two = spark.createDataFrame([("delete", "s", "en", "v1", 5, None), ("revise", "s", "en", "v1", 12, 10)], CHANGE)
    r.commit("a", one)
    r.commit("b", two)
    want = {("s", "en", "v1", 1, 12), (None, None, "v1", 1, 0)}
    assert {tuple(x) for x in r.totals().collect()} == want
    r.commit("a", one)
    r.commit("b", two)
    assert {tuple(x) for x in r.totals().collect()} == want
    r.commit("c", one.limit(0))
    assert {tuple(x) for x in r.totals().collect()} == want
    rollups.signed(one).write.parquet(f"{r.path}/deltas/batch_id=torn")  # written, never committed
    assert {tuple(x) for x in r.totals().collect()} == want
    r.commit("d", spark.createDataFrame([("delete", "s", "en", "v1", 12, None), ("delete", None, None, "v1", 0, None)], CHANGE))
    assert r.totals().count() == 0
    with pytest.raises(Exception):
        rollups.signed(spark.createDataFrame([("upsert", "s", "en", "v1", 1, 1)], CHANGE)).collect()


def test_rollup_survives_crashes(spark, monkeypatch):
    """A crash before any write, or after it; the batch comes again, and again once more: every batch counts once."""
    batch = lambda i: spark.createDataFrame([("insert", f"s{i % 3}", "en", "v1", 10 + i, None), ("insert", None, "en", "v1", 1, None)], CHANGE)
    ids = ["a", "b/c=d", "", "%2F 'x\""]
    want = {("s0", "en", "v1", 2, 23), ("s1", "en", "v1", 1, 11), ("s2", "en", "v1", 1, 12), (None, "en", "v1", 4, 4)}
    plain = rollups.Rollup._write
    writes = 0

    def crash_at(n, after):
        seen = 0

        def write(self, df, path):
            nonlocal seen, writes
            seen, writes = seen + 1, writes + 1
            if seen == n and not after:
                raise RuntimeError("crash")
            plain(self, df, path)
            if seen == n:
                raise RuntimeError("crash")

        return write

    for n in (1, 2, 3, 4, 5, 6):
        for after in (False, True):
            r = rollups.Rollup(spark, f"{shared_dir(spark)}/rollup-crash-{n}-{after}", compact=2)
            assert r.totals().count() == 0
            monkeypatch.setattr(rollups.Rollup, "_write", crash_at(n, after))
            for i, name in enumerate(ids):
                try:
                    r.commit(name, batch(i))
                except RuntimeError:
                    monkeypatch.setattr(rollups.Rollup, "_write", plain)
                    r.commit(name, batch(i))
            assert {tuple(x) for x in r.totals().collect()} == want
            assert not any(r.commit(name, batch(i)) for i, name in enumerate(ids))
            assert {tuple(x) for x in r.totals().collect()} == want
            assert len(r._state()[2]) < 4
    with pytest.raises(ValueError):
        r.commit(None, batch(0))


def test_registered(spark):
    names = queries.queries()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in names)] == []
    con = duckdb.connect()
    for table in ("documents", "labels", "pages"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = names[name](spark, SF)
        cols = sorted(df.columns)
        key = lambda r: tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r)
        got = sorted(key(r) for r in df.select(cols).collect())
        res = con.execute(f"select {', '.join(cols)} from ({sql})").fetchall()
        assert sorted(map(key, res)) == got, name


def test_rollup_history_does_not_grow(spark):
    """After many batches: what is read for a commit and what lies in the folder stay small, every id is still known."""
    r = rollups.Rollup(spark, f"{shared_dir(spark)}/rollup-history", compact=2, grace=-1)
    one = spark.createDataFrame([("insert", "s", "en", "v1", 1, None)], CHANGE)
    folders = []
    for i in range(14):
        assert r.commit(f"batch-{i}", one)
        names = {f: len([n for n, _ in rollups.children(spark, f"{r.path}/{f}") if not n.startswith((".", "_"))]) for f in ("heads", "log", "deltas", "totals", "ids")}
        folders.append(names)
    head, _, since = r._state()
    assert len(since) < 2 and len(head.runs) <= 4 and sum(n for _, n in head.runs) == 14
    assert all(n["heads"] == 1 and n["log"] <= 1 and n["deltas"] <= 1 and n["totals"] == 1 and n["ids"] <= 4 for n in folders[3:])
    assert not any(r.commit(f"batch-{i}", one) for i in (0, 7, 13))
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "v1", 14, 14)]
