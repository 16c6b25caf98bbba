"""Periodic runs of words, by internal pattern matching.

A run is a stretch that repeats itself with a period: words q apart are the same. A run of MIN_EXPONENT periods or more
holds, for the least power of two b that is q at least, a block of b words that begins at a multiple of b, together with
its next or its last occurrence, q words away. So for every b:

1. each dyadic block asks for its occurrences next to it, on either side, within b words. The suffix array of a batch of
   texts has all occurrences of the block in one range; a wavelet tree over the array answers "the least place above
   mine in this range" (and "the greatest below") in a step for each bit;
2. an occurrence p words away means that words p apart agree along the block. Blocks of one progression, with the same p
   and next to each other, are one candidate;
3. candidates are extended word by word to either side, less than three blocks, and kept if they are long enough.

As b is p at least, and the nearest occurrences are taken, p is the smallest period of what is found. All steps are numpy
over a batch of whole texts, which are kept apart by words that occur nowhere else. A text is never cut, so that runs of
any length are found; memory is linear in the batch, and a text longer than a batch is a batch of its own (about 120 bytes
a word). Words are compared as numbers of a dictionary, not as hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, words
from .textbytes import split_batch, text_buffer, word_bounds, words_at

#: A run has so many words, and so many periods, at least.
MIN_WORDS, MIN_EXPONENT = 6, 4
#: Bytes of text that are searched together.
TOGETHER = 1 << 18


class Bits:
    """A row of bits that tells how many are set before a place."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words)[:-1], dtype=np.int64)])

    def __call__(self, at: np.ndarray) -> np.ndarray:
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 6] + np.bitwise_count(self.words[at >> 6] & low)


class WaveletTree:
    """Order statistics of any range of an array of different whole numbers."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in range(max(1, int(len(values)).bit_length()) - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(one), int(len(one) - one.sum())))
            values = np.concatenate([values[~one], values[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of a range are less than x."""
        n = np.zeros(len(x), np.int64)
        for bit, ones, zeros in self.levels:
            lo1, hi1 = ones(lo), ones(hi)
            up = (x >> bit & 1).astype(bool)
            n += np.where(up, (hi - hi1) - (lo - lo1), 0)
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        return n

    def smallest(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of a range that k others are less than."""
        value = np.zeros(len(k), np.int64)
        for bit, ones, zeros in self.levels:
            lo1, hi1 = ones(lo), ones(hi)
            n0 = (hi - hi1) - (lo - lo1)
            up = k >= n0
            k = np.where(up, k - n0, k)
            value |= up.astype(np.int64) << bit
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        return value

    def around(self, lo: np.ndarray, hi: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range's greatest value below x and its least above x, which is in the range itself; -1 if there is none."""
        k = self.below(lo, hi, x)
        last = self.smallest(lo, hi, np.maximum(k - 1, 0))
        next_ = self.smallest(lo, hi, np.minimum(k + 1, hi - lo - 1))
        return np.where(k > 0, last, -1), np.where(k + 1 < hi - lo, next_, -1)


def suffix_ranges(text: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffix array of a text, sorted as deep as its blocks ask for, and for each block size b the places of blocks
    that occur again with their ranges of the array.

    By doubling: who agrees on b words is sorted by the rank of what follows them. The last word of the text is unique.
    """
    n = len(text)
    array = np.argsort(text, kind="stable")
    new = np.concatenate([[True], text[array][1:] != text[array][:-1]])
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[array] = np.repeat(starts, np.diff(np.append(starts, n)))
    size = np.ones(n, np.int64)
    size[starts] = np.diff(np.append(starts, n))
    out, b = [], 1
    while True:
        if b > 1:
            at = np.arange(0, n - b + 1, b)
            lo = rank[at]
            again = size[lo] > 1
            out.append((b, at[again], lo[again], (lo + size[lo])[again]))
        if longest < 4 * b + MIN_EXPONENT and b > 1:  # no run is that long whose blocks are twice as large
            return array, out
        slots = np.flatnonzero(size[rank[array]] > 1)
        if not len(slots):
            return array, out
        places = array[slots]
        key = rank[places] * n + rank[places + b]
        order = np.argsort(key, kind="stable")
        key, places = key[order], places[order]
        array[slots] = places
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n_same = np.diff(np.append(first, len(slots)))
        rank[places] = np.repeat(slots[first], n_same)
        size[slots] = 1
        size[slots[first]] = n_same
        b *= 2


def extended(text: np.ndarray, a: np.ndarray, e: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges along which text agrees with itself p further on, as far as they reach to either side."""
    a, e = a.copy(), e.copy()
    for step, edge in ((1, e), (-1, a)):
        going, chunk = np.arange(len(edge)), 4
        while len(going):
            offsets = np.arange(chunk) if step > 0 else -1 - np.arange(chunk)
            for part in np.array_split(going, max(1, len(going) * chunk >> 20)):
                at = edge[part][:, None] + offsets
                there = at + p[part][:, None]
                same = (at >= 0) & (there < len(text))
                same &= text[np.where(same, at, 0)] == text[np.where(same, there, 0)]
                edge[part] += step * np.where(same.all(axis=1), chunk, np.argmin(same, axis=1))
            reached = edge[going]
            at = reached if step > 0 else reached - 1
            there = at + p[going]
            more = (at >= 0) & (there < len(text))
            more &= text[np.where(more, at, 0)] == text[np.where(more, there, 0)]
            going = going[more]
            chunk = min(2 * chunk, 1 << 12)
    return a, e


def runs_in(text: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of a text whose stretches of at most `longest` words end in unique ones."""
    array, blocks = suffix_ranges(text, longest)
    tree = WaveletTree(array)
    found = []
    for b, at, lo, hi in blocks:
        last, next_ = tree.around(lo, hi, at)
        p = np.concatenate([next_ - at, at - last])
        a = np.concatenate([at, last])
        near = (p <= b) & (p > (0 if b == 2 else b // 2)) & np.concatenate([next_ >= 0, last >= 0])
        p, a = p[near], a[near]
        order = np.lexsort((a, p))
        p, a = p[order], a[order]
        if not len(p):
            continue
        new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (a[1:] > a[:-1] + b)]))
        p, end, a = p[new], a[np.append(new[1:], len(a)) - 1] + b, a[new]
        a, end = extended(text, a, end, p)
        length = end - a + p
        long = length >= np.maximum(MIN_WORDS, MIN_EXPONENT * p)
        found.append(np.stack([a[long], length[long], p[long]]))
    runs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
    return runs[0], runs[1], runs[2]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def search(texts: pa.Array) -> dict[str, pa.Array]:
    """n_words, runs and collapsed of each text."""
    offsets, data = text_buffer(texts)
    start, end, of = word_bounds(data, offsets)
    found = words_at(data, start, end)
    n = np.bincount(of, minlength=len(texts)).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(n)])
    coded = found.dictionary_encode()
    # after each text a word of its own
    symbols = np.empty(len(start) + len(texts), np.int64)
    symbols[np.arange(len(start)) + of] = coded.indices.to_numpy(zero_copy_only=False)
    symbols[first[1:] + np.arange(len(texts))] = len(coded.dictionary) + np.arange(len(texts))
    at, length, period = runs_in(symbols, int(n.max(initial=0))) if len(start) else (np.zeros(0, np.int64),) * 3
    text = np.searchsorted(first[1:] + np.arange(len(texts)), at, side="left")
    at = at - text
    drops = np.zeros(len(start) + 1, np.int64)
    np.add.at(drops, at + period, 1)
    np.add.at(drops, at + length, -1)
    kept = np.cumsum(drops[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(kept)])[first]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(left.astype(np.int32)), found.filter(pa.array(kept)).cast(pa.string())), " ")
    per = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))]).astype(np.int32)
    runs = pa.ListArray.from_arrays(pa.array(per), pa.StructArray.from_arrays([pa.array(at - first[text]), pa.array(length), pa.array(period)], fields=list(_RUN)))
    return {"n_words": pa.array(n), "runs": runs, "collapsed": collapsed}


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, by start and period) and collapsed of every row of docs (doc_id, text).

    collapsed: the words joined by one space, without those that a run holds after its first period. A run has MIN_WORDS
    and MIN_EXPONENT smallest periods at least and ends where its period does; runs may overlap.

    Null and empty texts, and texts without a word, have no words, no runs and an empty collapsed. Repeated rows and null
    ids are rows like others; columns other than doc_id and text are left out. An empty table stays empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, "text", TOGETHER):
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id")} | search(batch.column("text")))

    return rows.mapInArrow(searched, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), a tenth of which by id repeat a stretch of their words from a place on to their end."""
    w = words(F.col("text"))
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "text", h.alias("_h"), F.when((h % 10 == 0), w).alias("_w"))
    rows = rows.withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.expr("_h div 10"))
    rows = rows.withColumn("_a", F.expr("int(case when _n > 0 then _g % _n else 0 end)"))
    rows = rows.withColumn("_p", F.expr("int(1 + (_n - _a) div (3 + _g % 8))"))
    again = F.expr("array_join(concat(slice(_w, 1, _a), slice(flatten(array_repeat(slice(_w, _a + 1, _p), int((_n - _a + _p - 1) div _p))), 1, int(_n) - _a)), ' ')")
    return rows.select("doc_id", F.when(F.col("_n") > 0, again).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the runs of each document, and its longest run (of equals the first, of the shortest period)."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line: Column = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    period = -F.col("b.period")
    return rows.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), F.col("b.length").alias("length"), period.alias("period"), F.expr("1000 * b.length div -b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every whole document, a tenth of which have one planted, as counts and digests."""
    return run_digest(periodic_runs(planted(read(spark, sf_dir, "documents"))))
