"""Collocations against a count of every phrase, and against SQL."""

import random
import re
from collections import Counter

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerline.llm import collocations as C

from ..conftest import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrase_counts(texts, longest):
    counts = Counter()
    for text in texts:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            for m in range(1, longest + 1):
                counts.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    return counts


def brute(rows, longest, least, top):
    out = []
    for lang in {r[0] if r[0] is not None else "und" for r in rows}:
        f = phrase_counts([t for x, t in rows if (x if x is not None else "und") == lang], longest)
        n = sum(c for p, c in f.items() if len(p) == 1)
        every = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in every.items():
            if any(b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in every.items() if len(q) > len(p)):
                continue
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((" ".join(p), a, f[p[:k]], f[p[k:]], n, score))
        found.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i, *r) for i, r in enumerate(found[:top], 1)]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab.c \tX\n", max_size=40), min_size=1, max_size=6), st.integers(2, 5))
def test_chunks_hold_each_phrase_once(texts, longest):
    """Over all chunks, each phrase counts as often as the texts have it."""
    chunks = C.chunks_of(pa.array(["x"] * len(texts)), pa.array(texts, pa.string()), longest - 1)
    want = phrase_counts(texts, longest)
    for size in range(1, longest + 1):
        got = {p: n for p, n in zip(*(C.phrases_of(chunks, size, None, longest - 1).column(c).to_pylist() for c in ("phrase", "n")))}
        assert got == {" ".join(p): n for p, n in want.items() if len(p) == size}


def documents(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "lang string, text string, phrase string, `a.b` int")


def test_brute_force(spark):
    """All lengths, ties, nulls, empty texts, upper case beyond A-Z, a text without a cut and one of cuts only."""
    rng = random.Random(5)
    words = ["the", "of", "new", "york", "Ärger", "x", "The", "no-one", "\x85", "É"]
    rows = [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(["  ", " ", "\t", ". ", "\n", " "]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), ("fr", "..."), ("one", "a " * 500), ("two", "of new york " * 30), ("two", "of new york " * 30)]
    got = C.collocations(documents(spark, rows), least=4, top=60)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 4, 60)
    assert [t for _, t in got.dtypes] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]


def test_few_bits(spark, monkeypatch):
    """A filter that is full lets everything pass: the counts stay exact."""
    monkeypatch.setattr(C, "BITS", 64)
    rng = random.Random(6)
    rows = [("en", " ".join(f"w{min(rng.randint(0, 40), rng.randint(0, 40))}" for _ in range(100))) for _ in range(40)]
    assert sorted(map(tuple, C.collocations(documents(spark, rows), least=3, top=500).collect())) == brute(rows, 5, 3, 500)


def test_nothing(spark):
    for rows in ([], [("en", None)], [(None, " . ")], [("en", "a b c")]):
        assert C.collocations(documents(spark, rows)).collect() == []


def test_large_numbers(spark):
    """Products beyond 64 bits."""
    df = spark.sql("select 4000000000000L a, 90000000000000000L n, 5000000000000L l, 6000000000000L r")
    expr = "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    assert df.selectExpr(f"{expr} s").first()["s"] == 1000 * 4000000000000 * 90000000000000000 // (5000000000000 * 6000000000000)


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = C.op11_collocations(spark, SF).select(*cols).collect()
    assert got and sorted(map(tuple, got)) == sorted(con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({C.OP11_SQL})").fetchall())
