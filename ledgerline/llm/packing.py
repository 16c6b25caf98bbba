"""Best-fit packing into sequences of several permitted lengths.

Documents are cut into fragments of the largest length at most, which are dealt by digest into groups of about GROUP
fragments, and every group is packed on its own, longest fragment first: into the open bin that it leaves least room in,
or into a new bin. The size of a new bin is the one whose cost for each word that the group's remaining fragments would
put into it is least, so all lengths compete for each bin; at the end each bin shrinks to the least length that holds its
contents. Rows of a doc_id that repeats (or is null) more often than a group should hold are dealt by their place in a
written table instead, so that they spread over all groups. Ids stay in Arrow: a null beside them changes none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, if_small, read, settle, word_count

WORDS = re.compile(WORD)
LENGTHS = (512, 1024, 2048, 4096)
GROUP = 4096


def cost(length: int, largest: int) -> float:
    """Cost of a sequence: its words, a fixed share for handling it, and attention that grows with the square."""
    return length + 64 + length * length / (8 * largest)


def best_fit(sizes: np.ndarray, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset and capacity of each fragment; sizes fall, each is 1..max(lengths).

    Two bit sets answer the searches: bit r of `room` says that some open bin has r words left, bit s of `left` that a
    fragment of s words is still to come.
    """
    lengths = tuple(sorted(lengths))
    price = {c: cost(c, lengths[-1]) for c in lengths}
    count = np.bincount(sizes, minlength=lengths[-1] + 1).tolist()
    left = sum(1 << s for s, k in enumerate(count) if k)
    open_bins: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    room, free, used = 0, [], []
    of, at = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)

    def gain(capacity: int) -> float:
        """Words that remaining fragments would fill a new bin with, largest fitting first, for its price."""
        space, taken = capacity, {}
        mask = left
        while space and (s := (mask & ((1 << (space + 1)) - 1)).bit_length() - 1) > 0:
            taken[s] = taken.get(s, 0) + 1
            space -= s
            if taken[s] >= count[s]:
                mask &= ~(1 << s)
        return (capacity - space) / price[capacity]

    for i, s in enumerate(sizes.tolist()):
        fitting = room >> s
        if fitting:
            r = s + (fitting & -fitting).bit_length() - 1
            b = open_bins[r].pop()
            if not open_bins[r]:
                room &= ~(1 << r)
        else:
            r = max((c for c in lengths if c >= s), key=lambda c: (gain(c), -c))
            b = len(free)
            free.append(r)
            used.append(0)
        of[i], at[i] = b, used[b]
        used[b] += s
        free[b] = r - s
        if r > s:
            open_bins[r - s].append(b)
            room |= 1 << (r - s)
        count[s] -= 1
        if not count[s]:
            left &= ~(1 << s)
    fits = np.asarray(lengths)[np.searchsorted(lengths, used)]
    return of, at, fits[of]


def pieces_of(sized: DataFrame, largest: int, texts: bool) -> DataFrame:
    """doc_id, piece, start, n_words, _at of every fragment of rows (doc_id, _n words, _at), and its exact slice of the
    text if texts are wanted."""
    sized = sized.where("_n > 0")
    if not texts:
        pieces = sized.select("doc_id", "_n", "_at", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {largest}"))).alias("piece"))
        pieces = pieces.withColumn("start", F.col("piece") * largest)
        return pieces.select("doc_id", "piece", "start", F.least(F.lit(largest).cast("long"), F.col("_n") - F.col("start")).cast("int").alias("n_words"), "_at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, size, text = [], [], [], []
            for i, (n, whole) in enumerate(zip(batch.column("_n").to_pylist(), batch.column("text"))):
                whole = whole.as_py()
                at = [0] if n <= largest else [m.start() for k, m in enumerate(WORDS.finditer(whole)) if k % largest == 0]
                at[0] = 0
                row += [i] * len(at)
                piece += range(len(at))
                size += [min(largest, n - largest * k) for k in range(len(at))]
                text += [whole[x:y] for x, y in zip(at, [*at[1:], len(whole)])]
            own = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(own), "piece": pa.array(piece, pa.int64()), "start": pa.array([largest * k for k in piece], pa.int64()), "n_words": pa.array(size, pa.int32()), "_at": batch.column("_at").take(own), "text": pa.array(text, pa.string())})

    return sized.mapInArrow(cut, "doc_id long, piece long, start long, n_words int, _at long, text string")


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, size: Column | None = None, group: int = GROUP, texts: bool = False) -> DataFrame:
    """A row for each fragment: doc_id, piece, start, n_words, bin_id, bin_capacity, bin_offset; with texts, its text too.

    size: words of a document, counted in its whole text unless given (with texts, always counted). Documents without
    words (null text too) have no fragment. Rows with a null or repeated doc_id are packed one by one, and ids of any size
    come out as they are. A bin's id names its group and its number there. An empty table stays empty. Columns of docs
    other than doc_id and text are ignored.
    """
    largest = max(lengths)
    size = word_count(F.col("text")) if size is None or texts else size
    # a written table, so that a row's place in it is the same whenever it is read
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.cast("long").alias("_n"), *([F.col("text").cast("string").alias("text")] if texts else []))
    rows = settle(rows.withColumn("_at", F.monotonically_increasing_id()), "pack-rows")
    n_pieces = rows.where("_n > 0").agg(F.sum(F.expr(f"(_n - 1) div {largest} + 1"))).first()[0] or 0
    groups = max(1, -(-n_pieces // group))
    often = settle(rows.groupBy("doc_id").count().where(F.col("count") > max(1, group // 16)).select(F.col("doc_id").alias("_id"), F.lit(True).alias("_often")), "pack-often")
    pieces, n_often = pieces_of(rows, largest, texts), often.count()
    plain = F.xxhash64("doc_id", "piece", "n_words")
    if n_often:
        pieces = pieces.join(if_small(often, n_often), F.col("doc_id").eqNullSafe(F.col("_id")), "left")
        plain = F.when(F.col("_often"), F.xxhash64("_at", "piece")).otherwise(plain)
    dealt = pieces.withColumn("_g", F.pmod(plain, F.lit(groups)).cast("int"))
    names = ["doc_id", "piece", "start", "n_words", *(["text"] if texts else [])]

    def packed(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_at", "ascending")])
        of, at, capacity = best_fit(table.column("n_words").to_numpy(), tuple(lengths))
        out = table.select(names)
        for name, column in (("bin_id", pa.array([f"g{key[0].as_py()}-{b}" for b in of], pa.string())), ("bin_capacity", pa.array(capacity, pa.int32())), ("bin_offset", pa.array(at, pa.int32()))):
            out = out.append_column(name, column)
        return out

    schema = f"doc_id long, piece long, start long, n_words int, {'text string, ' if texts else ''}bin_id string, bin_capacity int, bin_offset int"
    return dealt.select("_g", *names, "_at").groupBy("_g").applyInArrow(packed, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of all documents and their places in sequences of LENGTHS (see pack)."""
    return pack(read(spark, sf_dir, "documents"))
