"""The operators on whole small tables against brute force, with nulls, empty and long texts, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import langid, mixing, near_dups, neighbours, packing, quality, sharding, suffixes, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n string, `key` long, _row long, spans string"
VOCAB = [a + b for a in ("ba", "ke", "li", "mo", "nu", "été", "straße") for b in ("ta", "re", "si", "do", "X", "q,")]


def texts(seed=1, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        ws = [rng.choice(VOCAB) for _ in range(rng.choice([3, 20, 60, 150]))]
        out.append(rng.choice([" ", "  ", "\n"]).join(ws))
    shared = " ".join(rng.choice(VOCAB) for _ in range(60))
    for i in range(0, 20, 2):
        out[i] = out[i] + "\n" + shared + " " + out[i + 1]
    for i in range(5):  # near copies of one text, and exact ones
        ws = WORD.findall(out[40])
        ws[rng.randrange(len(ws))] = "edited"
        out += [" ".join(ws), out[41]]
    return out + [None, "", " \t\n", "one", "ONE", "two words", "x" * 700, "ab" * 400, out[3] * 40, "a.\n\n\n" + "ü" * 150]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, ["en", "de", None][i % 3], [None, "s0", "s0", "s0", "s1", "s2"][i % 6], 0, "n", i, i, "s") for i, t in enumerate(texts())]
    out += [out[5], out[5], (None, out[7][1], "en", "s0", 0, None, None, None, None), (None, "no id here but words", None, None, 0, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text, size=2):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + size]) for i in range(max(len(ws) - size + 1, 1))} if ws else set()


def components_of(rows, size=2):
    sets = [shingles(r[1], size) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if not small or 100 * small < 80 * large:  # the union is the larger set at least
                continue
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (small + large - both):
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(r[0], len(s), r[0] if not s else name[find(i)]) for i, (r, s) in enumerate(zip(rows, sets))]


def test_near_duplicates(docs, rows):
    got = near_dups.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(components_of(rows))


def test_near_duplicates_query(spark):
    """op6 over all documents of a table with planted copies: no link at 0.8 or above is missed."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    want = components_of(rows)
    got = near_dups.op6_near_dups(spark, "/root/testdata/sf0.01").collect()
    assert Counter(map(tuple, got)) == Counter((d, n, c, d == c) for d, n, c in want)
    assert sum(d != c for d, _, c in want) > 10


def test_near_duplicates_by_blocks(docs, rows, monkeypatch):
    """With blocks of two members and without useful hubs the exact rest finds the same components."""
    monkeypatch.setattr(near_dups, "REST_BLOCK", 2)
    monkeypatch.setattr(near_dups, "HUB_ROUNDS", 0)
    pair = lambda df: df.select("doc_id", "n_shingles", "component_id").collect()
    wanted = components_of(rows)
    got = pair(near_dups.near_duplicates(docs))
    # buckets of two meet their hub in the rounds, so only larger groups must agree here
    big = {c for c, k in Counter(x[2] for x in wanted).items() if k > 3}
    assert {tuple(x) for x in got if x[2] in big} == {x for x in wanted if x[2] in big}


def test_blocks_in_any_order(spark, monkeypatch):
    """The two lists of a block's members come in orders of their own; no pair is lost by that."""
    prints = np.arange(10, dtype=np.uint16).tobytes()
    ids = [bytes([9 - i] * 16) for i in range(6)]
    members = spark.createDataFrame([(7, 6, i, i, 10, [7], prints) for i in ids], "key long, c long, cls binary, comp binary, n long, bands array<long>, prints binary")
    frame = type(members)
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **b: plain(self.withColumn("x2", F.reverse("x2")), *a, **b))
    got = [(bytes(r["a"]), bytes(r["b"])) for r in near_dups.rest_pairs(members, 80).collect()]
    assert sorted(got) == sorted((x, y) for x in ids for y in ids if x < y)


def test_without_near_duplicates(docs, rows):
    got = near_dups.without_near_duplicates(docs)
    assert got.columns == docs.columns
    want = {(d, c) for d, n, c in components_of(rows)}
    kept = Counter(r["doc_id"] for r in got.collect())
    assert all(k == 1 for d, k in kept.items() if d is not None)
    assert {d for d in kept if d is not None} == {d for d, c in want if d is not None and d == c}


def test_stage_compares_five_words(spark):
    """Scattered changed words keep a text; one changed word does not. Against brute force with five words."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    changed = lambda at: " ".join("new" + w if i in at else w for i, w in enumerate(base))
    few = ["one", "one two", "one two three four", "one two three four", "one two three", "one two three four five", ""]
    many = [" ".join(rng.choice("abc") for _ in range(300)) for _ in range(4)]  # they share all pairs of words
    every = [" ".join(base), changed(range(10, 400, 25)), changed({200}), changed({200, 390}), *few, *many]

    def five(text):
        ws = text.split()
        return {tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} if ws else set()

    sets, least = [five(t) for t in every], list(range(len(every)))
    for i, s in enumerate(sets):
        for j in range(i):
            if s and sets[j] and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = [new if x == old else x for x in least]
    docs = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, None)
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i, x in enumerate(least) if i == x]
    assert least[1] == 1 and least[2] == least[3] == 0 and least[7] == 6


def brute_gone(texts, length):
    """Each text's bytes, and which of them lie in a window that repeats."""
    count = Counter(b[i : i + length] for t in texts for b in [(t or "").encode()] for i in range(len(b) - length + 1))
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        yield b, gone


def brute_repeats(texts, length):
    out = []
    for b, gone in brute_gone(texts, length):
        starts = int((gone & ~np.concatenate([[False], gone[:-1]])[: len(gone)]).sum()) if len(gone) else 0
        out.append((len(b), int(gone.sum()), starts, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("length,wide", [(200, 20_000), (60, 20_000), (200, 0), (40, 1)])
def test_repeats(docs, rows, monkeypatch, length, wide):
    monkeypatch.setattr(suffixes, "WIDE", wide)
    got = suffixes.cut_digest(suffixes.cut_repeats(docs, length)).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], length))]
    assert Counter(map(tuple, got)) == Counter(want)


def test_long_text_in_segments(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    whole = suffixes.runs_of(data, np.array([5000]), 200)
    monkeypatch.setattr(suffixes, "_SEGMENT", 1000)
    parts = [suffixes.runs_of(data[a:b], np.array([b - a]), 200) for a, b in suffixes.segments(np.array([0, 5000]), 200)]
    base = [a for a, _ in suffixes.segments(np.array([0, 5000]), 200)]
    starts = lambda runs, a: [(s + a, p + a) for _, lo, hi, at, *_ in zip(*runs) for s, p in zip(range(lo, hi + 1), [at] * (hi - lo + 1))]
    assert sorted(starts(whole, 0)) == sorted(x for r, a in zip(parts, base) for x in starts(r, a))


def test_without_repeats(docs, rows):
    got = suffixes.without_repeats(docs)
    assert got.columns == docs.columns
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[23]["text"] == rows[23][1] and by_id[23]["n"] == "n"
    cut = {i for i, b in enumerate(brute_repeats([r[1] for r in rows], 200)) if b[1]}
    assert all((by_id[i]["text"] != rows[i][1]) == (i in cut) for i in by_id if i is not None)
    assert all(by_id[i]["n_chars"] == len(by_id[i]["text"]) for i in by_id if i in cut)


@pytest.mark.parametrize("job", [near_dups.near_duplicates, near_dups.without_near_duplicates, suffixes.without_repeats, mixing.mix, mixing.mixed_documents, sharding.shard_documents, packing.pack, langid.in_known_language])
def test_empty_table(nothing, job):
    assert job(nothing).count() == 0


def test_sharding(docs, rows):
    got = sharding.shard_documents(docs, 7).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    shards = defaultdict(list)
    for r in got:
        shards[r["shard"]].append(r)
    sizes = [len(v) for v in shards.values()]
    assert set(shards) == set(range(7)) and max(sizes) - min(sizes) <= 1
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in shards.values())
    for source, n in Counter(r[3] for r in rows).items():  # the mixture holds in every shard
        per = [sum(r["source"] == source for r in v) for v in shards.values()]
        assert max(per) - min(per) <= 3 and abs(n / 7 - np.mean(per)) < 1e-9


def test_sharding_in_buckets(docs, rows, monkeypatch):
    order = lambda df: sorted((str(r["doc_id"]), r["size"], r["shard"], r["slot"]) for r in df.collect() if r["doc_id"] is not None and r["doc_id"] != 5)
    one = order(sharding.shard_documents(docs, 7))
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 4)
    assert order(sharding.shard_documents(docs, 7)) == one


def brute_targets(sizes):
    total, open_, target = sum(sizes.values()), dict(sizes), {}
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: [1, 2, 3][i % 3] for i, s in enumerate(order)}
    left = total
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / w > 3 * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / w for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
            del open_[s]
        left = total - sum(target.values())
    return target


@pytest.mark.parametrize("bucket", [1024, 2])
def test_mix(docs, rows, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", bucket)
    got = mixing.mix(docs).collect()
    sizes, biggest = defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(WORD.findall(r[1] or ""))
        sizes[r[3]] += n
        biggest[r[3]] = max(biggest[r[3]], n)
    target = brute_targets(sizes)
    assert sorted({round(r["target"], 6) for r in got}) == sorted({round(t, 6) for t in target.values()})
    taken = defaultdict(int)
    for r in got:
        assert r["taken"] == r["size"] * r["times"] <= 3 * r["size"]
        taken[r["source_size"]] += r["taken"]
    for s, n in sizes.items():
        assert abs(taken[n] - target[s]) <= biggest[s] + 1
    assert sum(taken.values()) <= sum(sizes.values())
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() > 0


def test_packing(docs, rows):
    lengths = (8, 16, 64)
    got = packing.pack(docs, lengths, group=10, texts=True).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
        assert len(WORD.findall(r["text"])) == r["n_words"] <= 64
    for v in bins.values():
        v.sort(key=lambda r: r["bin_offset"])
        used = sum(r["n_words"] for r in v)
        assert {r["bin_capacity"] for r in v} == {min(c for c in lengths if c >= used)}
        assert [r["bin_offset"] for r in v] == [sum(x["n_words"] for x in v[:i]) for i in range(len(v))] or len({r["doc_id"] for r in v}) < len(v)
    whole = defaultdict(list)
    for r in got:
        whole[r["doc_id"]].append((r["piece"], r["text"]))
    for i in set(range(60)) - {5}:  # that row is there three times
        assert "".join(t for _, t in sorted(whole[i])) == rows[i][1]
    plain = packing.pack(docs, lengths, group=10)
    assert sum(r["n_words"] for r in got) == plain.agg(F.sum("n_words")).first()[0]


def test_best_fit_fills():
    rng = np.random.default_rng(3)
    sizes = np.sort(rng.integers(1, 500, 3000))[::-1]
    of, at, cap = packing.best_fit(sizes, (256, 512, 1024))
    used = np.bincount(of, sizes)
    assert (used <= cap[np.unique(of, return_index=True)[1]]).all() and used.sum() / cap[np.unique(of, return_index=True)[1]].sum() > 0.99


def brute_measures(text):
    t = text or ""
    ws = WORD.findall(t)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    inside = set()
    for i in range(len(ws) - 2):
        if windows[tuple(ws[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_measures(spark, rows):
    extra = ["a b c a b c", "a b c d\na b c d\na b c d", "#a $b <c> | |", "a a a a", "a b", "l\nl\n\n \nl", "x " * 300]
    docs = spark.createDataFrame([(i, t, None) for i, t in enumerate([r[1] for r in rows] + extra)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality.measures(docs).collect()}
    assert got == {i: brute_measures(t) for i, t in enumerate([r[1] for r in rows] + extra)}


def test_binomial_tail(spark):
    cases = [(0, 100), (1, 400), (3, 900), (10, 2000), (30, 5000), (5, 100), (0, 1), (700, 100000)]
    df = spark.createDataFrame([(i, k, n) for i, (k, n) in enumerate(cases)], "i int, k long, n long").select("i", quality.binomial_tail(F.col("k"), F.col("n"), 0.01).alias("p"))

    def exact(k, n):
        return sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.01) + (n - i) * math.log(0.99)) for i in range(k + 1))

    for r in df.collect():
        k, n = cases[r["i"]]
        assert r["p"] == pytest.approx(1.0 if k > n * 0.01 else exact(k, n), rel=1e-9)


def test_cutoffs_are_certified(spark):
    good = "all fine words here " * 3 + " ".join(f"w{i}" for i in range(60))
    bad = " ".join(f"w{i}$$$" for i in range(60))
    rows = [(i, bad if i % 10 == 0 else good + f" t{i}", "en") for i in range(3000)] + [(9000 + i, bad, "xx") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(3000)] + [(1, 1, 0), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs, labels).collect()}
    assert all(got[i] == (i % 10 != 0) for i in range(3000))
    assert all(got[9000 + i] for i in range(5))  # a stratum without labels certifies no cutoff
    assert quality.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_language(spark):
    rng = random.Random(2)
    tongues = {"aa": ["ban", "tok", "rim", "dol", "sef"], "bb": ["xylo", "quaz", "jive", "oui", "yez"], "cc": ["été", "çou", "naïf", "œuf", "où"]}
    rows = [(i, " ".join(rng.choice(tongues[k]) for _ in range(rng.choice([3, 30, 900]))), k) for i in range(300) for k in [list(tongues)[i % 3]]]
    odd = [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !!", "bb"), (None, rows[0][1], None), (1003, rows[1][1], None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = langid.identify(docs, docs.where("doc_id % 5 != 0")).collect()
    want = {r[0]: r[2] for r in rows} | {1000: "und", 1001: "und", 1002: "und", None: "aa", 1003: "bb"}
    assert all(r["lang_pred"] == want[r["doc_id"]] and 0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in langid.identify(docs, docs.limit(0)).collect()} == {"und"}
    kept = langid.in_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) + 2


def test_phrases_are_longest_matches():
    train, text = b"abcabxabcd", b"abcdabzxabc"
    model = langid.Model({"x": train})
    got = model.phrases(np.frombuffer(text, np.uint8), np.array([len(text)]))[0][0]
    i = n = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in train:
            k += 1
        if text[i : i + 1] not in train:
            k = 1
        n, i = n + 1, i + k
    assert got == n


def phrases_of(text, train):
    """Phrases of bytes by the longest match with train, a byte that is not in it alone."""
    i = n = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and train.find(text[i : i + k + 1]) >= 0:
            k += 1
        n, i = n + 1, i + k
    return n


def fold(text):
    """Lower-case letters and what is beyond ASCII, other runs as one space."""
    return re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", text.lower().encode())


def test_long_texts_are_parsed_as_one():
    """Over segment ends too, and alike in any company: against the parse by search, for several languages."""
    rng = random.Random(9)
    words = ["abra", "kadabra", "abrax", "zzy", "étéé", "kad", "ab"]
    train = {k: " ".join(rng.choice(words) for _ in range(120)).encode() for k in ("p", "q")} | {"r": b"zzzzz"}
    model = langid.Model(train)
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 3, 200, 900, 0, 2500)] + [" abc", "x", "ab" * 1500, "  9  ", "z" * 2000]
    bytes_ = [t.encode() for t in texts]
    got = model.phrases(np.frombuffer(b"".join(bytes_), np.uint8), np.cumsum([len(b) for b in bytes_]))
    for k, lang in enumerate(model.langs):
        assert [int(x) for x in got[k]] == [phrases_of(fold(t), fold(train[lang].decode())) for t in texts]
    for t, b in zip(texts, bytes_):
        alone = model.phrases(np.frombuffer(b, np.uint8), np.array([len(b)]))
        assert alone[:, 0].tolist() == got[:, texts.index(t)].tolist()


def test_language_query_against_search(spark):
    """op9 over all documents of the smallest table: every prediction and score by brute force, and held-out accuracy."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = langid.labelled_text(docs.where("doc_id is not null").where(~langid.held_out(F.col("doc_id"))))
    learned = {k: fold(v.decode(errors="ignore")) for k, v in sorted(text.items())}
    got = {r["doc_id"]: r for r in langid.op9_langid(spark, "/root/testdata/sf0.001").collect()}
    right = []
    for r in docs.collect():
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert g["lang_pred"] == "und"
            continue
        if len(r["text"]) < 3000:
            counts = {k: phrases_of(fold(r["text"]), v) for k, v in learned.items()}
            best = min(counts, key=lambda k: (counts[k], k))
            assert g["lang_pred"] == best and g["score"] == pytest.approx(1 - counts[best] / sorted(counts.values())[1])
        if g["held_out"] and r["lang"]:
            right.append(g["lang_pred"] == r["lang"])
    assert len(right) > 10 and np.mean(right) > 0.95


def test_language_of_long_labelled_texts(spark):
    """Labelled texts of any length are learned from, and rows are judged alike in any partitioning."""
    long = {"aa": "ban tok rim dol " * 30_000, "bb": "xylo quaz jive oui " * 30_000}
    rows = [(i, long[k], k) for i, k in enumerate(["aa", "bb"] * 4)] + [(20 + i, t, None) for i, t in enumerate([" tok ban", "quaz oui", "rim", "  9 tok", "ban"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert langid.in_known_language(docs).count() == len(rows)
    once = [sorted(map(str, langid.identify(docs.repartition(n), docs).collect())) for n in (1, 7)]
    assert once[0] == once[1]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, docs).collect()}
    assert got[20] == "aa" and got[21] == "bb" and got[0] == "aa" and got[1] == "bb"
    none = spark.createDataFrame([(1, "12", "aa"), (2, None, "bb"), (3, "words here", None)], "doc_id long, text string, lang string")
    assert langid.in_known_language(none).count() == 3  # nothing with a letter is labelled: nothing can be judged
    assert {r["lang_pred"] for r in langid.identify(none, none).collect()} == {"und"}


BIG = 2**53 + 1


def test_large_ids_beside_nulls(spark):
    """Ids above 2^53 come out as they went in, with nulls in the same batch."""
    shared = " ".join(f"pass{i}" for i in range(60))
    rows = [(BIG, shared + " own one", "en", "s"), (None, shared + " own two", "en", "s"), (7, "short " + shared, None, None), (BIG + 2, "a b c", None, "s"), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    want = [(r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 200))]
    assert Counter(map(tuple, suffixes.cut_digest(suffixes.cut_repeats(docs, 200)).collect())) == Counter(want)
    ids = Counter(r[0] for r in rows if r[1])
    for texts in (False, True):
        assert Counter(r["doc_id"] for r in packing.pack(docs, texts=texts).collect()) == ids
    assert Counter(r["doc_id"] for r in mixing.mix(docs).collect()) == Counter(r[0] for r in rows)
    assert Counter(r["doc_id"] for r in near_dups.near_duplicates(docs, size=5).collect()) == Counter(r[0] for r in rows)


@pytest.mark.parametrize("wide", [2, 5])
def test_hot_anchor_is_halved(spark, monkeypatch, wide):
    """One passage in many documents with edges of their own, and copies of it: an anchor of many runs."""
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    core, tail = word(150), word(120)
    rows = [(i, word(90) + core + (tail[: 10 * (i % 12)] if i % 3 else "") + word(90)) for i in range(40)] + [(100, core + tail), (100, core + tail), (101, core)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffixes, "WIDE", wide)
    got = suffixes.cut_digest(suffixes.cut_repeats(docs, 200)).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *b) for r, b in zip(rows, brute_repeats([r[1] for r in rows], 200)))


def plain_best_fit(sizes, lengths):
    """The rule of best_fit said plainly: every open bin is looked at, every fragment still to come is counted."""
    price = {c: packing.cost(c, max(lengths)) for c in lengths}
    bins = []
    for i, s in enumerate(sizes):
        left = sorted(sizes[i:], reverse=True)

        def gain(c):
            space = c
            for x in left:
                space -= x if x <= space else 0
            return (c - space) / price[c]

        fitting = [b for b in range(len(bins)) if bins[b][0] - bins[b][1] >= s]
        if fitting:
            least = min(bins[b][0] - bins[b][1] for b in fitting)
            b = max((b for b in fitting if bins[b][0] - bins[b][1] == least), key=lambda b: bins[b][2])  # the last one used
        else:
            bins.append([max((c for c in sorted(lengths) if c >= s), key=lambda c: (gain(c), -c)), 0, i])
            b = len(bins) - 1
        bins[b][1] += s
        bins[b][2] = i
    return [(c, u) for c, u, _ in bins]


def test_best_fit_follows_its_rule():
    rng = random.Random(8)
    for lengths in ((16,), (8, 16, 32), (10, 64)):
        for _ in range(5):
            sizes = sorted((rng.randint(1, max(lengths)) for _ in range(60)), reverse=True)
            of, at, cap = packing.best_fit(np.array(sizes), lengths)
            used = Counter()
            for b, o, s in zip(of.tolist(), at.tolist(), sizes):
                assert used[b] == o
                used[b] += s
            want = Counter((min(c for c in lengths if c >= u), u) for _, u in plain_best_fit(sizes, lengths))
            assert Counter((int(cap[of == b][0]), u) for b, u in used.items()) == want


def total_cost(of, cap, largest):
    return sum(packing.cost(int(cap[of == b][0]), largest) for b in set(of.tolist()))


def test_several_lengths_cost_less():
    rng = np.random.default_rng(4)
    sizes = np.sort(np.minimum(rng.geometric(1 / 90, 2000), 512))[::-1]
    of, _, cap = packing.best_fit(sizes, (64, 128, 256, 512))
    one, _, same = packing.best_fit(sizes, (512,))
    assert total_cost(of, cap, 512) < total_cost(one, same, 512)


def test_packing_query(spark):
    """op3 over all documents of the smallest table: fragments against the texts, bins against the plain rule."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    want = Counter()
    for r in rows:
        n = len(WORD.findall(r["text"] or ""))
        want.update((r["doc_id"], p, 4096 * p, min(4096, n - 4096 * p)) for p in range(-(-n // 4096)))
    got = packing.op3_packing(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["n_words"]) for r in got) == want
    check_bins(got)


def check_bins(got):
    """Bins of packed fragments, group by group, against the plain rule."""
    groups = defaultdict(list)
    for r in got:
        groups[r["bin_id"].split("-")[0]].append(r)
    for own in groups.values():
        bins = defaultdict(list)
        for r in own:
            bins[r["bin_id"], r["bin_capacity"]].append(r)
        for v in bins.values():
            v.sort(key=lambda r: r["bin_offset"])
            assert [r["bin_offset"] for r in v] == [sum(x["n_words"] for x in v[:i]) for i in range(len(v))]
        plain = plain_best_fit(sorted((r["n_words"] for r in own), reverse=True), packing.LENGTHS)
        assert Counter((c, sum(r["n_words"] for r in v)) for (_, c), v in bins.items()) == Counter((min(c for c in packing.LENGTHS if c >= u), u) for _, u in plain)


def test_repeated_ids_spread(spark):
    """A third of all rows with one id, and another third without: they go to all groups, none is lost."""
    rows = [(5 if i % 3 == 0 else None if i % 3 == 1 else i, "one two three four five") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for texts in (False, True):
        got = packing.pack(docs, (8, 16), group=64, texts=texts).collect()
        assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
        sizes = Counter(r["bin_id"].split("-")[0] for r in got)
        assert len(sizes) == 47 and max(sizes.values()) < 130


def test_mix_of_repeated_rows(spark, monkeypatch):
    """Rows of a null id, all equal or not, are taken one by one: the mix of documents has the words that mix() says."""
    rows = [(None, f"w{i % 2} " * 10, "a") for i in range(300)] + [(i, "x y z", "b") for i in range(500)] + [(3, "same text", "b")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    taken = lambda: sorted(tuple(r) for r in mixing.mix(docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text", "source")).collect())
    whole = taken()
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 4)
    assert taken() == whole
    by_source = Counter()
    for r in mixing.mix(docs).collect():
        by_source[r["source_size"]] += r["taken"]
    out = Counter()
    for r in mixing.mixed_documents(docs).collect():
        out[{"a": 3000, "b": 1900}[r["source"]]] += len(WORD.findall(r["text"]))
    assert out == by_source and all(by_source[n] <= t + 10 for n, t in {(r["source_size"], r["target"]) for r in mixing.mix(docs).collect()})


def test_sharding_of_repeated_rows(spark, monkeypatch):
    rows = [(None, "t", "a")] * 700 + [(i, f"t{i}", f"only{i}") for i in range(300)] + [(9, None, None)] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    place = lambda: sorted((r["doc_id"] or -1, r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_documents(docs, 7).collect())
    whole = place()
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 4)
    assert place() == whole
    assert sorted(Counter(x[2] for x in whole).values()) == [157] * 6 + [158]
    assert len({(x[2], x[3]) for x in whole}) == len(rows)
    alone = Counter(x[2] for x in whole if x[0] >= 10)  # sources of one row each lie in all shards
    assert len(alone) == 7 and max(alone.values()) < 80


def test_cutoffs_match_sql(spark):
    """On labels that suffice, both engines certify the same cutoffs, and these reject."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    fine = lambda: " ".join(word() for _ in range(60))
    symbols = lambda: " ".join(word() + "$" * rng.randint(0, 3) for _ in range(60))
    lines = lambda: "\n".join([fine()] * 2 + [fine() for _ in range(rng.randint(1, 6))])
    rows = [(i, [symbols, lines][i // 5 % 2]() if i % 5 == 0 else fine(), "en" if i % 7 else "de") for i in range(9000)]
    docs = spark.createDataFrame(rows + [(None, fine(), "en"), (9001, None, ""), (9002, symbols(), None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(9000)] + [(4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.register("labels", labels.toArrow())
    got = quality.judge(docs, labels)
    cols = sorted(got.columns)
    here = Counter(map(tuple, got.select(cols).collect()))
    assert here == Counter(con.execute(f"select {', '.join(cols)} from ({quality.OP1_SQL})").fetchall())
    verdicts = got.where("not base_failed and stratum = 'en'").groupBy((F.col("doc_id") % 5 == 0).alias("bad")).agg(F.avg((~F.col("kept")).cast("int")).alias("gone")).collect()
    gone = {r["bad"]: r["gone"] for r in verdicts}
    assert gone[True] > 0.5 and gone[False] < 0.04


def known_language(rows, text):
    """The rows that the language stage keeps, by search for phrases in the training text."""
    learned = {k: fold(v.decode(errors="ignore")) for k, v in text.items()}

    def rate(t):
        if t is None or not any(c.isalpha() for c in t):
            return None
        return max(min(phrases_of(fold(t), v) for v in learned.values()) - 1, 0) / len(fold(t))

    rates = [rate(r["text"]) for r in rows]
    aside = sorted(x for r, x in zip(rows, rates) if x is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    limit = max(0.5, 1.5 * aside[math.ceil(0.999 * len(aside)) - 1])
    return [r for r, x in zip(rows, rates) if x is not None and x <= limit]


def test_pipeline(spark):
    """Every stage's rows by brute force on all that its predecessor kept (the mix by its SQL), and run() as a whole."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    stages = [(name, lambda df, stage=stage: stage(spark, df, "/root/testdata/sf0.001")) for name, stage in corpus_pipeline.STAGES[:-1]]
    before, rows = docs, docs.collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    for name, stage in stages:
        out = stage(before)
        assert out.columns == docs.columns, name
        if name == "language":
            text = langid.labelled_text(docs.where(~(F.col("lang").isNotNull() & langid.held_out(F.col("doc_id")))))
            want = known_language(rows, text)
        elif name == "near_duplicates":
            want = [r for r, (d, n, c) in zip(rows, components_of([(r["doc_id"], r["text"]) for r in rows], 5)) if d == c]
        elif name == "repeated_passages":
            want = []
            for r, (b, gone) in zip(rows, brute_gone([r["text"] for r in rows], 200)):
                rest = bytes(np.frombuffer(b, np.uint8)[~gone]).decode(errors="ignore")
                if not gone.any():
                    want.append(r)
                elif WORD.search(rest):
                    want.append(tuple({**r.asDict(), "text": rest, "n_chars": len(rest)}.values()))
        else:
            con = duckdb.connect()
            con.register("documents", before.toArrow())
            times = dict(con.execute(f"select doc_id, times from ({mixing.OP8_SQL})").fetchall())
            want = [r for r in rows for _ in range(times[r["doc_id"]])]
        rows = out.collect()
        assert Counter(map(tuple, rows)) == Counter(map(tuple, want)), name
        before = spark.createDataFrame(rows, docs.schema).repartition(3)
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    fragments = Counter()
    for r in rows:
        at = [m.start() for m in WORD.finditer(r["text"])]
        cuts = [0, *at[4096::4096], len(r["text"])]
        fragments.update((r["doc_id"], p, 4096 * p, min(4096, len(at) - 4096 * p), r["text"][a:b]) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if at)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["n_words"], r["text"]) for r in got) == fragments
    check_bins(got)


# --- wrong or lost rows of earlier rounds ---------------------------------------------------------------------------


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_that_running_sums_confuse(spark):
    """Sums modulo 2^64 give the Thue-Morse word and its complement one hash; nothing in common is no link."""
    one = thue_morse(4096)
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, one), (2, two), (3, f"{one} {two}"), (4, f"{two} {one}"), (5, one)]
    for size in (1, 2, 5):
        got = {r["doc_id"]: r["component_id"] for r in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=size).collect()}
        assert got == {r[0]: c for r, c in zip(rows, [1, 2, 3, 3 if size == 1 else 4, 1])}


def test_long_windows_that_running_sums_confuse(spark):
    """Windows longer than the collisions known of running sums."""
    one = thue_morse(2048)
    rows = [(1, "x" * 40 + one + "y" * 40), (2, "x" * 40 + one.translate(str.maketrans("ab", "ba")) + "y" * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffixes.cut_digest(suffixes.cut_repeats(df, 2048)).collect()}
    assert got == {r[0]: b[:2] for r, b in zip(rows, brute_repeats([r[1] for r in rows], 2048))}


def test_letters_in_part_of_a_text(spark):
    """Letters anywhere in a labelled text are learned, wherever its digest would cut."""
    english = "the quick brown fox jumps over the lazy dog and then it sleeps under the old oak tree for a while"
    french = "le petit chat noir dort sur la grande table de la cuisine pendant que la pluie tombe sur les toits"
    rows = [(i, english + " 0123456789" * 2000, "en") for i in (1, 2, 3)] + [(i, french, "fr") for i in (4, 5, 6)] + [(7, "the old fox sleeps", None), (8, "la pluie tombe", None), (9, english, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, docs).collect()}
    assert got == {1: "en", 2: "en", 3: "en", 4: "fr", 5: "fr", 6: "fr", 7: "en", 8: "fr", 9: "en"}
    assert langid.in_known_language(docs).count() == 9


def test_many_languages(spark):
    """More languages than a wave holds, each with letters of its own: none is left out, and scores do not depend on waves."""
    letters = [chr(0x4E00 + 40 * k + j) for k in range(130) for j in range(8)]
    rows = [(k * 10 + i, " ".join("".join(letters[8 * k + (i + j * m) % 8] for j in range(5)) for m in range(1, 9)), f"l{k:03}") for k in range(130) for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(docs, docs).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {r[0]: r[2] for r in rows}


def test_waves_do_not_matter(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    once = sorted(map(str, langid.identify(docs, docs).collect()))
    monkeypatch.setattr(langid, "WAVE", 1)
    assert sorted(map(str, langid.identify(docs, docs).collect())) == once


def test_odd_column_names(spark):
    """Stages carry columns of any name and type."""
    rows = [(i, f"some plain words number {'abcdefgh'[i]} of this text", "en", "web", (1, "x"), [2]) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `a.b` struct<`n chars`:int,`x.y`:string>, `n ``chars` array<int>")
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() >= 0
    assert langid.in_known_language(docs).count() == 8


def test_repeated_vector_ids(spark):
    """Rows that repeat a vec_id with another vector do not take places from other ids."""
    rng = np.random.default_rng(9)
    near = [1.0, 0.0, 0.01, 0.0]
    rows = [(0, [1.0, 0.0, 0.0, 0.0]), (3, near), (3, [1.0, 0.001, 0.0, 0.0])] + [(i, [float(x) for x in rng.normal(size=4)]) for i in (4, 5, 6, 7, 8)]
    # one id with many vectors, all nearer than any other; an id that shares a vector with it
    many = [(9, [1.0, float(x), 0.0, 0.0]) for x in rng.normal(scale=1e-3, size=400)]
    for data in (rows, rows + many + [(50, many[0][1]), (50, [0.0, 0.0, 0.0, 1.0]), (100, [0.0, 0.0, 1.0, 1.0])]):
        got = neighbours.search(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
        for query in {i for i, _ in data if i % 50 == 0}:
            best = {}
            for own in (np.array(v) for i, v in data if i == query):
                for i, v in data:
                    if i != query:
                        score = float(own @ np.array(v) / np.linalg.norm(own) / np.linalg.norm(v))
                        best[i] = max(best.get(i, -2.0), score)
            want = sorted(best, key=lambda i: (-round(best[i], 12), i))[:5]
            mine = sorted((r for r in got if r["query_id"] == query), key=lambda r: r["rank"])
            assert [r["vec_id"] for r in mine] == want, query
            assert [r["score"] for r in mine] == pytest.approx([best[i] for i in want])


def test_url_column_of_any_name(spark):
    df = spark.createDataFrame([("HTTP://A.b/c?d",), (None,), ("x",)], "address string")
    host, path = urls.url_parts(F.col("address"))
    assert sorted(map(tuple, df.select(host, path).collect())) == [("", ""), ("", ""), ("a.b", "/c")]
