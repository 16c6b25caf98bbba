"""Removal of repeated passages by a depth-limited radix sort of suffixes.

All suffixes of all texts are ordered, but only through their first `length` bytes, by most-significant-digit passes:
after every pass only groups of two suffixes or more go on, and what is still grouped after the last digit are exactly
the windows of `length` bytes that start more than once.

The digits are chosen so that the passes distribute. A window's first digit is its anchor: of the GRAM-byte pieces in
the window the one whose hash is least (the leftmost of equals), a choice that depends on the window's bytes alone, so
equal windows have equal anchors at equal offsets. Neighbouring windows share their anchor, which is why a run of
windows moves as one row, about one for 85 bytes of text:

1. Runs are counted by anchor; an anchor that occurs once ends all its windows' part in the sort.
2. The second digit is the digest of the bytes that a run covers. An anchor all of whose runs agree is done: all its
   windows repeat, as do those of any run that another one equals.
3. The remaining runs (edges of passages, edited copies) are sorted window by window, digits of eight bytes down to the
   depth, in tasks that hold many anchors each.

An anchor with more than WIDE different runs is too much for one task; Spark passes over it first. The windows of a run
are halved by the anchor's offset in them. All windows of one half hold more bytes to the anchor's right, all of the
other more to its left; these bytes are the next digit of their part of the run. Equal parts are done, as in step 2, and
one of them goes on. Groups of WIDE parts at most go to step 3, larger ones are halved again, until a part is one window
and its digits are all of its bytes. So a row stays a run, or a part of one, and no group of any size meets in one task.

Keys of the first passes and of halves are digests of 128 bits; step 3 compares bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, if_small, quoted, read, settle, whole_row
from .textbytes import RangeHash, mix, split_batch, text_buffer

LENGTH = 200
GRAM = 32
#: Runs of a task of the last pass, and different runs of an anchor that one task still sorts: their windows take about
#: 20 MB.
RUNS_PER_TASK = 2000
WIDE = 2000
_POSITION_BITS = 24
_SEGMENT = 1 << 23
_U = np.uint64


def runs_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts that lie end to end: text number, first and last window start, anchor
    position (all in the buffer), anchor key, digest of the bytes covered."""
    gram = min(GRAM, length)
    width = length - gram + 1
    hashes = RangeHash(data)
    grams = hashes.every(gram)
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    low = (grams >> _U(_POSITION_BITS)) << _U(_POSITION_BITS)
    low |= np.arange(len(low), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < width:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    anchor = (low & _U((1 << _POSITION_BITS) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    of = np.repeat(np.arange(len(ends)), np.diff(np.concatenate([[0], ends])))[: len(anchor)]
    inside = start + length <= ends[of]
    start, anchor, of = start[inside], anchor[inside], of[inside]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])])) if len(start) else np.zeros(0, np.int64)
    first = start[new]
    last = start[np.concatenate([new[1:], [len(start)]]).astype(np.int64) - 1] if len(new) else first
    at = anchor[new]
    if length > LENGTH:  # running sums modulo 2^64 have known collisions, from ranges of 1,024 bytes on
        raw = data.tobytes()
        bytes_ = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(first.tolist(), (last + length).tolist())), np.uint64)
    else:
        bytes_ = hashes(first, last + length)
    covered = mix(bytes_ + _U(0x9E3779B97F4A7C15) * (at - first).astype(np.uint64) + _U(0xC2B2AE3D27D4EB4F) * (last - first).astype(np.uint64))
    return of[new], first, last, at, grams[at], covered


def segments(offsets: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Parts of the buffer that hold whole texts, or overlapping parts of one text too long for a part."""
    if offsets[-1] <= _SEGMENT:
        return [(0, int(offsets[-1]))]
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        for s in range(int(a), max(int(a) + 1, int(b) - length + 1), _SEGMENT - length + 1):
            out.append((s, min(int(b), s + _SEGMENT)))
    return out


def find_runs(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, h and arrays over the runs of every text: key, digest, lo, at, hi (window starts and anchor position)."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, "text"):
                offsets, data = text_buffer(batch.column("text"))
                parts = []
                for a, b in segments(offsets, length):
                    inner = offsets[(offsets > a) & (offsets < b)] - a
                    part = runs_of(data[a:b], np.append(inner, b - a), length)
                    base = np.searchsorted(offsets, a + part[1], side="right") - 1
                    parts.append((base, part[1] + a - offsets[base], part[2] + a - offsets[base], part[3] + a - offsets[base], part[4], part[5]))
                of, lo, hi, at, key, digest = (np.concatenate(x) for x in zip(*parts)) if parts else runs_of(data, offsets[1:], length)
                cut = np.searchsorted(of, np.arange(batch.num_rows + 1)).astype(np.int32)
                as_list = lambda v, t: pa.ListArray.from_arrays(pa.array(cut), pa.array(v.view(np.int64) if v.dtype == np.uint64 else v, t))
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "key": as_list(key, pa.int64()), "digest": as_list(digest, pa.int64()), "lo": as_list(lo, pa.int32()), "at": as_list(at, pa.int32()), "hi": as_list(hi, pa.int32())})

    return docs.mapInArrow(found, "doc_id long, h long, key array<long>, digest array<long>, lo array<int>, at array<int>, hi array<int>").where("size(key) > 0")


def repeated_windows(key: np.ndarray, offset: np.ndarray, start: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """Which windows (starts in data) equal another of the same key and offset, by MSD passes of eight bytes."""
    order = np.lexsort((offset, key))
    k, o = key[order], offset[order]
    group = np.cumsum(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])]))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    depth = 0
    while True:
        size = np.bincount(group)
        more = size[group] > 1
        order, group = order[more], group[more]
        if depth >= length or not len(order):
            break
        width = min(8, length - depth)
        digit = np.zeros(len(order), np.uint64)
        for b in range(width):
            digit = (digit << _U(8)) | padded[start[order] + depth + b].astype(np.uint64)
        by = np.lexsort((digit, group))
        order, group, digit = order[by], group[by], digit[by]
        group = np.cumsum(np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]))
        depth += width
    out = np.zeros(len(key), bool)
    out[order] = True
    return out


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Small numbers for a column's values; null is -1."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pc.fill_null(column.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)


def sort_parts(parts: DataFrame, tasks: int, length: int) -> DataFrame:
    """(doc_id, h, lo, last) of the windows of parts that equal a window of another part of the same key.

    parts: key, doc_id, h, c, lo, at, hi, bytes; those with c > 1 are there to compare with. Ids stay in Arrow.
    """

    def sort_runs(table: pa.Table) -> pa.Table:
        names = ("h", "lo", "at", "hi", "c")
        key, doc = codes(table.column("key")), codes(table.column("doc_id"))
        h, lo, at, hi, c = (table.column(x).to_numpy().astype(np.int64) for x in names)
        order = np.lexsort((lo, h, doc, key))
        same = np.concatenate([[False], np.all([x[order][1:] == x[order][:-1] for x in (key, doc, h, lo)], axis=0)])
        rows = np.sort(order[~same])  # repeated rows bring their text twice
        key, lo, at, hi, c = (x[rows] for x in (key, lo, at, hi, c))
        ends, data = text_buffer(table.column("bytes").combine_chunks().take(pa.array(rows)))
        base = ends[:-1]
        n = hi - lo + 1
        run = np.repeat(np.arange(len(rows)), n)
        within = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
        found = repeated_windows(key[run], (at - lo)[run] - within, base[run] + within, data, length)
        found &= (c == 1)[run]
        a = np.flatnonzero(found & np.concatenate([[True], ~found[:-1] | (run[1:] != run[:-1])])) if len(run) else np.zeros(0, int)
        b = np.flatnonzero(found & np.concatenate([~found[1:] | (run[1:] != run[:-1]), [True]])) if len(run) else np.zeros(0, int)
        own = pa.array(rows[run[a]])
        return pa.table({"doc_id": table.column("doc_id").take(own), "h": table.column("h").take(own), "lo": pa.array(lo[run[a]] + within[a], pa.int32()), "last": pa.array(lo[run[b]] + within[b], pa.int32())})

    return parts.groupBy(F.pmod(F.xxhash64("key"), F.lit(tasks)).alias("_task")).applyInArrow(sort_runs, "doc_id long, h long, lo int, last int")


def halved(parts: DataFrame, length: int) -> DataFrame:
    """Parts (with p, q: the offsets of the anchor in their windows are p to q) halved, with the next digit in the key."""
    m = "(p + q) div 2"
    # bytes begin at lo; the anchor's right side is known up to at + length - q, its left side from at - p
    right = f"substring(bytes, at + {length} - q - lo + 1, q - {m})"
    left = f"substring(bytes, at - {m} - lo, {m} + 1 - p)"
    half = lambda side, digit, p, q: F.expr(f"named_struct('key', md5(concat(cast(concat(key, '{side}') as binary), {digit})), 'p', {p}, 'q', {q}, 'lo', greatest(lo, at - ({q})), 'hi', least(hi, at - ({p})))")
    both = F.filter(F.array(half("r", right, "p", f"int({m})"), half("l", left, f"int({m} + 1)", "q")), lambda x: x["lo"] <= x["hi"])
    out = parts.select("doc_id", "h", "c", "at", "bytes", F.col("lo").alias("from"), F.explode(both).alias("x"))
    out = out.select("x.key", "doc_id", "h", "c", "x.lo", "at", "x.hi", F.expr(f"substring(bytes, x.lo - from + 1, x.hi - x.lo + {length})").alias("bytes"), "x.p", "x.q")
    return out.withColumn("digest", F.expr("md5(concat(cast(concat(at - lo, ':') as binary), bytes))"))


def of_equal_kind(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """(doc_id, h, lo, last) of the rows whose kind (key, digest) in the written table kinds has n > 1.

    Rows of kinds with more than WIDE of them meet their kind's one row where they are; the others are dealt out.
    """
    on = ["key", "digest"]
    hot = kinds.where((F.col("n") > 1) & (F.col("n") > WIDE)).select(*on)
    n_hot = hot.count()
    some = kinds.where(F.col("n") > 1).select(*on)
    if n_hot:
        hot = if_small(hot, n_hot)
        out = rows.join(hot, on, "left_anti").join(some, on, "left_semi").unionByName(rows.join(hot, on, "left_semi"))
    else:
        out = rows.join(some, on, "left_semi")
    return out.select("doc_id", "h", "lo", F.col("hi").alias("last"))


def split_wide(parts: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Parts of wide anchors by passes over halves: written tables of parts in groups of WIDE at most, and of
    (doc_id, h, lo, last) of parts that equal another."""
    narrow, repeated = [], []
    cols = ["key", "doc_id", "h", "c", "lo", "at", "hi", "bytes"]
    parts = settle(parts.select(*cols).withColumns({"p": F.lit(0), "q": F.lit(length - min(GRAM, length))}), "wide")
    # a pass for each halving of the offsets, until a part is a window and all of a key are equal
    while True:
        whole = parts.where("p = q").withColumn("digest", F.lit(""))
        halves = settle(halved(parts.where("p < q"), length).unionByName(whole), "wide")
        discard(parts)
        first = F.min_by(F.struct(*cols[1:], "p", "q"), F.struct("doc_id", "h", "lo")).alias("r")
        kinds = halves.groupBy("key", "digest").agg(F.count("*").alias("n"), first)
        kinds = settle(kinds, "wide-kinds")
        repeated.append(settle(of_equal_kind(halves, kinds), "wide-repeated"))
        sizes = settle(kinds.groupBy("key").count().where("count > 1"), "wide-keys")
        big = sizes.where(F.col("count") > WIDE).select("key")
        n_big = big.count()
        # of parts that equal another one goes on, to compare with
        ones = kinds.select("key", "digest", "n", "r.*").withColumn("c", F.greatest("c", "n"))
        rest = ones if not n_big else ones.join(if_small(big, n_big), "key", "left_anti")
        narrow.append(settle(rest.join(sizes.select("key"), "key", "left_semi").select(*cols), "narrow"))
        parts = settle(ones.join(if_small(big, n_big), "key", "left_semi").select(*cols, "p", "q"), "wide") if n_big else None
        discard(halves, kinds, sizes)
        if parts is None:
            return narrow, repeated


def repeated_spans(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, h, spans): the byte ranges (start, end) of windows that repeat, of each text that has any.

    rows: doc_id, h (digest of the text), text. Rows equal in doc_id and h share their spans, and repeat each other.
    """
    runs = settle(find_runs(rows.select("doc_id", "h", "text"), length), "runs")
    flat = runs.select("doc_id", "h", F.inline(F.arrays_zip("key", "digest", "lo", "at", "hi")))
    counted = flat.groupBy("key").agg(F.count("*").alias("_n"), F.min("digest").alias("_a"), F.max("digest").alias("_b")).where("_n > 1")
    # a table of its own, so that the join deals out both sides and can split a hot anchor
    counted = settle(counted.select("key", (F.col("_a") != F.col("_b")).alias("differ")), "run-keys")
    hits = settle(flat.join(counted, "key"), "run-hits")
    # texts that are there more than once under one id: their runs come once
    copies = settle(runs.groupBy("doc_id", "h").count().where("count > 1").select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")), "run-copies")
    discard(runs, counted)
    done = hits.where("not differ").select("doc_id", "h", "lo", F.col("hi").alias("last"))
    open_ = hits.where("differ")
    kinds = open_.groupBy("key", "digest").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h", "lo", "at", "hi")).alias("r"))
    kinds = settle(kinds.select("key", "digest", "n", "r.*"), "run-kinds")
    n_kinds, n_copies = kinds.count(), copies.count()
    twice = of_equal_kind(open_, kinds)
    wide = settle(kinds.groupBy("key").agg(F.count("*").alias("_k")).where(F.col("_k") > WIDE).select("key", F.lit(True).alias("wide")), "wide-anchors")
    n_wide = wide.count()
    asked = kinds.join(if_small(wide, n_wide), "key", "left").groupBy(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("key", F.col("n").alias("c"), "lo", "at", "hi", "wide")).alias("asked"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))
    contexts = rows.join(asked, same).drop("_d", "_h")
    contexts = contexts.select("doc_id", "h", F.col("text").cast("binary").alias("text"), F.explode("asked").alias("x")).select("doc_id", "h", F.col("x.key").cast("string").alias("key"), "x.c", "x.lo", "x.at", "x.hi", F.coalesce("x.wide", F.lit(False)).alias("wide"), F.expr(f"substring(text, x.lo + 1, x.hi - x.lo + {length})").alias("bytes"))
    if n_copies:
        again = if_small(copies, n_copies)
        contexts = contexts.join(again, same, "left_anti").unionByName(contexts.join(again, same, "left_semi").dropDuplicates(["doc_id", "h", "key", "lo"]))
    contexts = settle(contexts, "run-bytes")
    narrow, single = split_wide(contexts.where("wide").drop("wide"), length) if n_wide else ([], [])
    parts = contexts.where("not wide").drop("wide")
    for more in narrow:
        parts = parts.unionByName(more)
    every = done.unionByName(twice).unionByName(sort_parts(parts, max(1, -(-n_kinds // RUNS_PER_TASK)), length))
    for more in single:
        every = every.unionByName(more)
    spans = every.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct(F.col("lo").alias("start"), (F.col("last") + length).alias("end")))).alias("spans"))
    spans = settle(spans, "spans")
    discard(hits, copies, kinds, wide, contexts, *narrow, *single)
    return spans


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """A row (n_bytes, spans, kept, rest, _row, text, doc_id) of every row of docs.

    spans: maximal ranges of bytes that lie in a repeated window; kept: the other bytes; rest: those as text where
    something is cut, else null (a character that a cut splits goes with it); _row: the columns of docs but for text.

    Judged on the input: every place of a repeated window is cut, its first included, within one text or across texts.
    Null text is empty; texts under `length` bytes have no window. Rows that repeat a doc_id and text repeat each other.
    Rows without doc_id take part. An empty table stays empty.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"), whole_row(docs, ("text",)))
    spans = repeated_spans(rows.select("doc_id", "h", F.coalesce("text", F.lit("")).alias("text")), length).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("spans").alias("_spans"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left").drop("_d", "_h", "h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, "text"):
                offsets, data = text_buffer(batch.column("text"))
                found = batch.column("_spans")
                at = found.offsets.to_numpy()
                lo, hi = (found.values.field(c).to_numpy() for c in ("start", "end"))
                kept, spans = [], []
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    text = data[a:b]
                    x, y = lo[at[i] : at[i + 1]], hi[at[i] : at[i + 1]]
                    if len(x):
                        reach = np.maximum.accumulate(y)
                        first = np.concatenate([[True], x[1:] > reach[:-1]])
                        x, y = x[first], reach[np.concatenate([first[1:], [True]])]
                        inside = np.zeros(len(text) + 1, np.int32)
                        inside[x] += 1
                        inside[y] -= 1
                        text = text[np.cumsum(inside[:-1]) == 0]
                    kept.append(text.tobytes())
                    spans.append([{"start": int(s), "end": int(e)} for s, e in zip(x, y)])
                cols = {c: batch.column(c) for c in batch.schema.names if c != "_spans"}
                cols |= {"n_bytes": pa.array(np.diff(offsets)), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), "kept": pa.array(kept, pa.binary()), "rest": pa.array([k.decode(errors="ignore") if x else None for k, x in zip(kept, spans)], pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    added = T.StructType.fromDDL("n_bytes long, spans array<struct<start:int,end:int>>, kept binary, rest string")
    return joined.mapInArrow(cut, T.StructType([*joined.drop("_spans").schema.fields, *added.fields]))


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated passages cut out of text (n_chars follows); documents of which nothing but space is left go.

    Documents without a repeated window stay as they are, null text too.
    """
    cut = cut_repeats(docs, length)
    some = F.size("spans") > 0
    left = cut.where(~some | F.col("rest").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.when(some, F.col("rest")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(some, F.length("rest")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return left.select(*[(new[c] if c in new else F.col(f"_row.{quoted(c)}")).alias(c) for c in docs.columns])


def cut_digest(cut: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its bytes in repeated windows of LENGTH bytes, as counts and a digest (see cut_repeats)."""
    return cut_digest(cut_repeats(read(spark, sf_dir, "documents")))
