"""Periodic runs against a brute-force search."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import periodic as P

from ..conftest import SF


def brute_runs(words, min_words=6, exponent=4):
    """(start, length, period) of all runs by trying every period at every place."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(min_words, exponent * q):
                # smallest period of the stretch
                w = words[i : j + q]
                if not any(all(w[k] == w[k + d] for k in range(len(w) - d)) for d in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    drop = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in drop)


def search(texts):
    got = P.search(pa.array(texts, pa.string()))
    runs = [[(r["start"], r["length"], r["period"]) for r in x] for x in got["runs"].to_pylist()]
    return got["n_words"].to_pylist(), runs, got["collapsed"].to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=60), min_size=1, max_size=5))
def test_few_words(texts):
    n, runs, left = search([" ".join(t) for t in texts])
    assert n == [len(t) for t in texts]
    assert runs == [brute_runs(t) for t in texts]
    assert left == [collapsed(t, brute_runs(t)) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.randoms(use_true_random=False))
def test_planted_periods(rng):
    """Stretches with periods of all sizes, broken at random places, runs next to and within runs."""
    words = []
    for _ in range(rng.randint(1, 6)):
        unit = [str(rng.randint(0, rng.choice([1, 3, 50]))) for _ in range(rng.randint(1, 40))]
        words += (unit * rng.randint(1, 9))[: rng.randint(1, 200)]
        if rng.random() < 0.3 and words:
            words[rng.randrange(len(words))] = "x"
    runs = brute_runs(words)
    assert search([" ".join(words)]) == ([len(words)], [runs], [collapsed(words, runs)])


def test_long_text():
    """One text of many batches' size, a run of one word over half of it, a run of a long period after it."""
    unit = [str(k) for k in range(5000)]
    words = ["a"] * 200_000 + ["b"] + unit * 5 + ["c"]
    _, runs, left = search([" ".join(words)])
    assert runs == [[(0, 200_000, 1), (200_001, 25_000, 5000)]]
    assert left == [" ".join(["a", "b", *unit, "c"])]


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    values = rng.permutation(1000)
    tree = P.WaveletTree(values)
    lo = rng.integers(0, 990, 200)
    hi = np.minimum(1000, lo + rng.integers(1, 300, 200))
    x = np.array([values[rng.integers(a, b)] for a, b in zip(lo, hi)])
    last, next_ = tree.around(lo, hi, x)
    for a, b, v, p, q in zip(lo, hi, x, last, next_):
        part = values[a:b]
        assert p == max(part[part < v], default=-1) and q == min(part[part > v], default=-1)


def expected(doc_id, text):
    """The query's row of a document, word by word."""
    words = [w.decode() for w in (text or "").encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").replace(b"\r", b" ").split(b" ") if w]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(collapsed(words, runs)))


COLS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
order = lambda rows: sorted(rows, key=str)


def test_rows(spark):
    """Nulls, empty and blank texts, repeated rows, ids of every remainder, columns that clash."""
    rng = random.Random(3)
    rows = [(None, "a " * 9, 1), (1, None, 1), (2, "", 1), (3, " \t\n\x0b\x0c\r", 1), (4, "é é é é é é é é é", 1), (4, "b b", 2), (4, "b b", 2), (-7, "u v " * 4, 1)]
    rows += [(k, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 90))), k) for k in range(100, 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int").withColumnRenamed("a.b", "runs")
    got = P.run_digest(P.periodic_runs(P.planted(df))).select(*COLS).collect()
    assert order(map(tuple, got)) == order(expected(r[0], r[1]) for r in rows)
    assert P.run_digest(P.periodic_runs(P.planted(df.where("false")))).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 3000").select("doc_id", "text")
    got = P.op12_periodic(spark, SF).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select(*COLS).collect()
    assert order(map(tuple, got)) == order(expected(*r) for r in docs.collect())
