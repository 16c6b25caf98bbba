"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is parsed against it greedily: every phrase is
the longest match with the labelled text from where the last phrase ended. The language that needs the fewest phrases
for each byte wins.

Greedy parsing only moves forward, so automaton and restarts make one table: (state, byte class) to the next state and
whether a phrase ended. Texts are parsed in segments of SEGMENT bytes, thousands side by side, first as if a phrase began
at each segment; then segments that the one before enters in another state are parsed again from that state until they
meet the first parse, which they soon do. The result is the parse of the whole text.

Training text is bounded: of each language a slice of TRAIN_SLICE letters of TRAIN_ROWS labelled rows, TRAIN_BYTES in all.
Only this text is collected and broadcast, for WAVE languages at a time; every task builds their tables from it once.
However many languages there are, none is left out: texts are parsed in waves, each of which keeps the two least counts
of phrases so far. All text is parsed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, quoted, read, settle, whole_row
from .textbytes import split_batch, text_buffer

#: Languages whose tables a task holds at a time (about 12 MB each), and whose labelled text is collected at a time.
WAVE = 8
TRAIN_BYTES = 32_768
TRAIN_ROWS = 256
TRAIN_SLICE = 512
SEGMENT = 512
#: Bytes after which a segment that is parsed again is compared with its first parse.
STRIDE = 64


def byte_map() -> np.ndarray:
    """Lower-case letters and bytes above ASCII stay, other ASCII is a space."""
    m = np.arange(256, dtype=np.uint8)
    m[:128] = 32
    m[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return m


FOLD = byte_map()


def folded(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts (lower case) that lie end to end, with bytes folded and runs of spaces within a text cut to one; and their
    ends. A text's bytes do not depend on the texts beside it."""
    out = FOLD[data]
    keep = out != 32
    keep[1:] |= out[:-1] != 32
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    keep[starts[starts < len(out)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], kept[ends]


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings of data; state 0 is the start."""
    steps: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        new = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(steps)
                steps.append(dict(steps[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return steps


def parse_table(steps: list[dict[int, int]], classes: np.ndarray) -> np.ndarray:
    """Flat table: entry state's row start + class holds twice the next state's row start, plus 1 if a phrase begins.

    A phrase begins at the start and wherever the last one cannot go on; a byte that is nowhere in the labelled text is
    a phrase of its own and leads back to the start.
    """
    width = int(classes.max()) + 1
    restart = np.ones(width, np.int32)
    for c, t in steps[0].items():
        restart[classes[c]] = 2 * t * width + 1
    table = np.tile(restart, (len(steps), 1))
    for s, out in enumerate(steps[1:], start=1):
        for c, t in out.items():
            table[s, classes[c]] = 2 * t * width
    return table.ravel()


class Model:
    """Parsing tables of all languages, and the bytes' classes."""

    def __init__(self, text_by_lang: dict[str, bytes]):
        self.langs = sorted(text_by_lang)
        learned = {k: folded(np.frombuffer(text_by_lang[k], np.uint8), np.zeros(1, int))[0] for k in self.langs}
        seen = np.unique(np.concatenate([*learned.values(), np.array([32], np.uint8)]))
        self.classes = np.zeros(256, np.int32)  # class 0: in no labelled text
        self.classes[seen] = np.arange(1, len(seen) + 1)
        self.tables = [parse_table(suffix_automaton(learned[k].tobytes()), self.classes) for k in self.langs]

    def phrases(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of each text for each language; texts lie end to end in data (uint8), ends are their ends."""
        return self.parsed(*folded(data, ends))

    def parsed(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Phrases of folded texts."""
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        parts = -(-(ends - starts) // SEGMENT)
        doc = np.repeat(np.arange(len(ends)), parts)
        if not len(doc):
            return np.zeros((len(self.langs), len(ends)))
        place = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
        first = np.repeat(starts, parts) + place * SEGMENT
        size = np.minimum(first + SEGMENT, ends[doc]) - first
        order = np.argsort(-size, kind="stable")  # long ones first: those still running are a prefix
        at = np.empty(len(order), np.int64)
        at[order] = np.arange(len(order))
        before = np.where(place > 0, at[np.arange(len(order)) - 1], -1)[order]
        first, size, doc = first[order], size[order], doc[order]
        symbols = self.classes[data]
        most = int(size[0])
        grid = np.stack([symbols[np.minimum(first + t, len(symbols) - 1)] for t in range(most)])
        counts = [self.walk(table, grid, size, before) for table in self.tables]
        return np.stack([np.bincount(doc, c, minlength=len(ends)) for c in counts])

    @staticmethod
    def walk(table: np.ndarray, grid: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that begin in each segment. grid: a column of byte classes a segment, of which `size` count (they
        fall); before: the segment before it in its text, or -1."""
        most, n = grid.shape
        running = n - np.searchsorted(size[::-1], np.arange(most), side="right")
        marks = -(-most // STRIDE)
        states, counts = np.zeros((marks, n), np.int32), np.zeros((marks, n), np.int32)
        state, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for t in range(most):
            m = running[t]
            v = table[state[:m] + grid[t, :m]]
            count[:m] += v & 1
            state[:m] = v >> 1
            if (t + 1) % STRIDE == 0 or t + 1 == most:
                states[t // STRIDE], counts[t // STRIDE] = state, count
        entered = np.zeros(n, np.int32)
        while True:
            wanted = np.where(before >= 0, states[-1][before], 0)
            again = np.flatnonzero(wanted != entered)
            if not len(again):
                return counts[-1]
            entered[again] = wanted[again]
            state, count = wanted[again], np.zeros(len(again), np.int32)
            for mark in range(marks):
                for t in range(mark * STRIDE, min((mark + 1) * STRIDE, most)):
                    v = table[state + grid[t, again]]
                    on = t < size[again]
                    count += (v & 1) * on
                    state = np.where(on, v >> 1, state)
                met = state == states[mark, again]
                # from here on the parse is the one known, with another count so far
                counts[mark:, again[met]] += count[met] - counts[mark, again[met]]
                states[mark, again[~met]], counts[mark, again[~met]] = state[~met], count[~met]
                again, state, count = again[~met], state[~met], count[~met]
                if not len(again):
                    break


@functools.lru_cache(maxsize=2)
def model_of(text: tuple[tuple[str, bytes], ...]) -> Model:
    """The model of a training text, built once in a worker."""
    return Model(dict(text))


def labelled_text(docs: DataFrame) -> dict[str, bytes]:
    """Training text for each language, in lower case: slices of labelled rows in the order of a digest.

    A slice is taken from the row's letters, all else folded to spaces first, at a place that the row's digest chooses: a
    labelled row of any length counts if it has a letter anywhere. A language without such a row is not learned.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", "lang").alias("_h"), F.xxhash64("text").alias("_x"))
    letters = known.where(F.col("text").rlike(r"\p{L}")).select("lang", "_h", "_x", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{M}]+", " ").alias("_t"))
    begin = 1 + F.pmod(F.xxhash64("_h", "_x"), F.greatest(F.length("_t") - TRAIN_SLICE, F.lit(0)) + 1)
    slices = letters.select("lang", "_h", "_x", F.substr("_t", begin.cast("int"), F.lit(TRAIN_SLICE)).alias("s"))
    ranked = slices.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "_x"))).where(F.col("_r") <= TRAIN_ROWS)
    ranked = settle(ranked.select("lang", "s", "_r"), "slices")
    langs = [r["lang"] for r in ranked.select("lang").distinct().orderBy("lang").collect()]
    out: dict[str, bytes] = {}
    # bounded: TRAIN_ROWS slices of 8 * WAVE languages at a time, of which TRAIN_BYTES a language stay
    for wave in waves(langs, 8 * WAVE):
        for row in sorted(ranked.where(F.col("lang").isin(wave)).collect(), key=lambda r: (r["lang"], r["_r"])):
            out[row["lang"]] = (out.get(row["lang"], b"") + b"\n" + row["s"].encode())[:TRAIN_BYTES]
    discard(ranked)
    return out


def waves(items: list, size: int) -> list[list]:
    return [items[at : at + size] for at in range(0, len(items), size)]


def identify(docs: DataFrame, training: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and phrase_rate of every row of docs, by the labelled rows of training.

    score: 1 less the winner's rate over the runner-up's, 0 to 1; 1 if only one language was learned. phrase_rate: phrases
    beyond the first for each folded byte in the winning language. Ties go to the language first in order. Null text,
    text without a letter, or nothing learned: `und`, score 0, rate null. doc_id may be null or repeat: rows are judged
    one by one, alike in any company. keep: further columns to carry along; others are ignored.
    """
    return identified(docs, labelled_text(training), keep)


def identified(docs: DataFrame, text: dict[str, bytes], keep: tuple[str, ...] = ()) -> DataFrame:
    """The same by a training text that is at hand."""
    spark = docs.sparkSession
    chosen = docs.select(*dict.fromkeys(("doc_id", *keep)), F.lower(F.col("text").cast("string")).alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    if not text:
        return chosen.drop("_text", "_letters").withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0), "phrase_rate": F.lit(None).cast("double")})
    parts = waves(sorted(text), WAVE)
    found = chosen
    for i, langs in enumerate(parts):
        if i:
            found = settle(found, "parsed")
        found = parsed_by(found, spark.sparkContext.broadcast(tuple((k, text[k]) for k in langs)))
    ok = F.col("_letters")
    # the winner's count comes first; one language alone has no second
    score = F.coalesce(1 - F.col("_least") / F.greatest("_second", F.lit(1e-9)), F.lit(1.0))
    rate = F.greatest(F.col("_least") - 1, F.lit(0.0)) / F.greatest("_size", F.lit(1))
    kept = [F.col(quoted(c)) for c in chosen.columns if c not in ("_text", "_letters")]
    return found.select(*kept, F.when(ok, F.col("_lang")).otherwise("und").alias("lang_pred"), F.when(ok, F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))).otherwise(0.0).alias("score"), F.when(ok, rate).alias("phrase_rate"))


def parsed_by(rows: DataFrame, shared: Broadcast) -> DataFrame:
    """rows (with _text) with the best language so far, its phrases, the second least phrases (null if there are none) and
    the folded size: _lang, _least, _second, _size. Of equals the earlier language stays."""
    again = "_lang" in rows.columns

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for whole in batches:
            for batch in split_batch(whole, "_text"):
                offsets, raw = text_buffer(batch.column("_text"))
                data, ends = folded(raw, offsets[1:])
                counts = model.parsed(data, ends)
                names = np.broadcast_to(np.asarray(model.langs, object)[:, None], counts.shape)
                if again:
                    before = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("_lang", "_least", "_second")]
                    counts = np.concatenate([before[1][None], np.nan_to_num(before[2].astype(float), nan=np.inf)[None], counts])
                    names = np.concatenate([before[0][None], np.full((1, len(before[0])), None, object), names])
                order = np.argsort(counts, axis=0, kind="stable")
                at = np.arange(counts.shape[1])
                second = counts[order[1], at] if len(counts) > 1 else np.full(len(at), np.inf)
                cols = {c: batch.column(c) for c in batch.schema.names if c not in ("_lang", "_least", "_second", "_size")}
                cols |= {"_lang": pa.array(names[order[0], at], pa.string()), "_least": pa.array(counts[order[0], at], pa.float64()), "_second": pa.array(second, pa.float64(), mask=np.isinf(second))}
                cols["_size"] = pa.array(np.diff(np.concatenate([[0], ends])), pa.int64())
                yield pa.RecordBatch.from_pydict(cols)

    old = [f for f in rows.schema if f.name not in ("_lang", "_least", "_second", "_size")]
    new = T.StructType.fromDDL("_lang string, _least double, _second double, _size long")
    return rows.mapInArrow(judged, T.StructType([*old, *new.fields]))


def in_known_language(docs: DataFrame, margin: float = 1.5, least: float = 0.5) -> DataFrame:
    """The rows of docs whose text is in a language that docs labels: und goes, and so does text that needs too many
    phrases a byte in every language.

    The limit is calibrated on labelled rows that nothing is learned from, all of them: margin times the rate that one in
    a thousand of them exceeds, never below `least`. A language all of whose labelled rows are such is learned from them. Where nothing was learned (no label, or no labelled text with a
    letter) nothing can be judged and all rows stay, null text too.
    """
    aside = F.col("lang").isNotNull() & held_out(F.col("doc_id"))
    text = labelled_text(docs.where(aside)) | labelled_text(docs.where(~aside))
    if not text:
        return docs
    rates = identified(docs.where(aside).select("doc_id", "text"), text)
    usual = rates.agg(F.percentile_approx("phrase_rate", 0.999, 100_000)).first()[0]
    found = identified(docs.select("doc_id", "text", whole_row(docs)), text, keep=("_row",))
    return found.where((F.col("lang_pred") != "und") & (F.col("phrase_rate") <= max(least, margin * (usual or 0.0)))).select("_row.*")


def held_out(doc_id: Column) -> Column:
    """The fifth of rows that nothing is learned from: crc32 of the id as text, modulo 5; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from labelled ones with an id that are not held out (see identify)."""
    docs = read(spark, sf_dir, "documents")
    found = identify(docs, docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "phrase_rate")
