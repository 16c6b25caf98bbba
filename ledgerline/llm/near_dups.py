"""Near-duplicate documents by min-max hashing.

A document's set is its distinct shingles of so many words (op6_near_dups: 2, the pipeline: 5). Every one of
PERMUTATIONS hash functions gives two entries of its signature, the least and the largest value over the set, so a
signature of 2 * PERMUTATIONS entries costs half the hash evaluations. Two permutations' four entries make a band. Documents of equal sets form a class, which is signed once and
linked within itself without any pair. Classes that share a band are candidates: at similarity 0.8 a pair shares none of
the 32 bands with probability 5e-8. All links are confirmed on the full sets, of which every shingle is told by 128 bits that
come from a cryptographic digest of its words.

No bucket is expanded into pairs of its members while they can still be connected cheaply: in each of HUB_ROUNDS rounds
every member of a bucket is compared with one hub, the member that shares most bands (the original, in a group of edited
copies), and links are merged into components. What is left after that, members of one bucket that are still in
different components, is compared in blocks within tasks by 16-bit fingerprints of their shingles, an upper bound that
loses no link; pairs that can reach the similarity are few and are confirmed like the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, read, settle, whole_row
from .components import components
from .textbytes import mix, split_batch, text_buffer, word_digests

PERMUTATIONS = 64
HUB_ROUNDS = 1
#: A bucket's members are dealt into blocks of this size for the exact rest.
REST_BLOCK = 256
_U = np.uint64
_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * _U(2) + _U(1)
_B = _rng.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_C = _rng.integers(1, 2**63, 4, dtype=np.uint64) * _U(2) + _U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of `size` words of all texts, set by set: two digests of 64 bits of each, sets sorted by the first,
    and the sets' offsets.

    A text of fewer words has one shingle, all of it.
    """
    words, of = word_digests(data, offsets)
    n = len(offsets) - 1

    def joined(m: int) -> np.ndarray:  # digests of m successive words, at the place of the first
        out = words[: max(len(words) - m + 1, 0)]
        for j in range(1, m):
            out = mix(out * _C[:2] + words[j : j + len(out)] * _C[2:])
        return out

    same = of[size - 1 :] == of[: max(len(of) - size + 1, 0)]
    runs = joined(size)[same]
    count = np.bincount(of, minlength=n)
    ends = np.concatenate([[0], np.cumsum(np.maximum(count - size + 1, 0))])
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    short = {m: mix(joined(m) * _C[1:3] + _U(m - 1)) for m in range(1, size) if (count == m).any()}
    sets = []
    for i in range(n):
        if count[i] >= size:
            own = runs[ends[i] : ends[i + 1]]
            own = own[np.lexsort((own[:, 1], own[:, 0]))]
            sets.append(own[np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)])])
        elif count[i]:
            sets.append(short[count[i]][first[i] : first[i] + 1])
        else:
            sets.append(np.zeros((0, 2), np.uint64))
    sizes = np.array([len(s) for s in sets], np.int64)
    every = np.concatenate(sets) if sets else np.zeros((0, 2), np.uint64)
    return np.ascontiguousarray(every[:, 0]), np.ascontiguousarray(every[:, 1]), np.concatenate([[0], np.cumsum(sizes)])


def signatures(values: np.ndarray, others: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys (texts by bands) and the two halves of a set digest; of texts with a set only, in order."""
    start = offsets[:-1][np.diff(offsets) > 0]
    entries = np.empty((2 * PERMUTATIONS, len(start)), np.uint64)
    for k in range(PERMUTATIONS):
        x = values * _A[k]
        x += _B[k]
        np.minimum.reduceat(x, start, out=entries[2 * k])
        np.maximum.reduceat(x, start, out=entries[2 * k + 1])
    bands = np.stack([mix(mix(entries[r] * _C[0] + entries[r + 1] * _C[1]) + entries[r + 2] * _C[2] + entries[r + 3] * _C[3] + _U(r)) for r in range(0, 2 * PERMUTATIONS, 4)], axis=1)
    return bands, np.add.reduceat(mix(values), start), np.add.reduceat(mix(others * _C[3]), start)


def sign(docs: DataFrame, size: int = 2) -> DataFrame:
    """doc_id, h (digest of the text), n (size of the set), cls (digest of the set, null if empty), bands."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, "text"):
                offsets, data = text_buffer(batch.column("text"))
                values, others, ends = shingle_sets(data, offsets, size)
                n = np.diff(ends)
                cls, bands = np.full(len(n), None, object), np.full(len(n), None, object)
                if len(values):
                    keys, one, two = signatures(values, others, ends)
                    both = np.stack([one, two], axis=1)
                    full = np.flatnonzero(n)
                    cls[full] = [x.tobytes() for x in both]
                    for i, k in zip(full, keys.view(np.int64)):
                        bands[i] = k
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "h": batch.column("h"), "n": pa.array(n), "cls": pa.array(list(cls), pa.binary()), "bands": pa.array(list(bands), pa.list_(pa.int64()))})

    return rows.mapInArrow(signed, "doc_id long, h long, n long, cls binary, bands array<long>")


def sets_of(docs: DataFrame, wanted: DataFrame, size: int = 2) -> DataFrame:
    """(cls, set, prints) of the wanted classes (cls, doc_id, h): the set's digests in bytes (the sorted first ones, then the
    second ones), and 16 bits of each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.col("text").cast("string").alias("text"))
    picked = rows.join(wanted.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "cls"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select("cls", "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, "text"):
                offsets, data = text_buffer(batch.column("text"))
                values, others, ends = shingle_sets(data, offsets, size)
                yield pa.RecordBatch.from_pydict({"cls": batch.column("cls"), "set": pa.array([values[a:b].tobytes() + others[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()), "prints": pa.array([values[a:b].astype(np.uint16).tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary())})

    return picked.mapInArrow(hashed, "cls binary, set binary, prints binary").dropDuplicates(["cls"])


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("cls").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("set").alias("sb"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                s, t = (v.reshape(2, -1) for v in ((s, t) if len(s) <= len(t) else (t, s)))
                at = np.minimum(np.searchsorted(t[0], s[0]), t.shape[1] - 1)
                both = int(np.count_nonzero((t[:, at] == s).all(axis=0)))
                ok.append(100 * both >= percent * (s.shape[1] + t.shape[1] - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(linked, "a binary, b binary")


def fixed(column: pa.Array, dtype: type) -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column end to end, and where each begins, in items of dtype."""
    offsets, data = text_buffer(column)
    return np.frombuffer(data.tobytes(), dtype), offsets // np.dtype(dtype).itemsize


def rest_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) that may be similar among members of one bucket but of different components; each pair once, by its first
    shared band.

    members: key, c, cls, comp, n, bands, prints. Blocks of a bucket meet each other in one row each, and are compared
    inside the task: common fingerprints are counted, which no common shingle escapes, so their number bounds the
    intersection from above and no link is lost. Only pairs that can reach the similarity come out.
    """
    blocks = F.ceil(F.col("c") / REST_BLOCK).cast("int")
    member = F.struct("cls", "comp", "n", "bands", "prints")
    grouped = members.withColumn("s", F.pmod(F.xxhash64("cls", "key"), blocks).cast("int")).groupBy("key", "s").agg(F.collect_list(member).alias("x"), F.first(blocks).alias("blocks"))
    left = grouped.select("key", F.col("s").alias("s1"), F.col("x").alias("x1"), F.explode(F.expr("sequence(s, blocks - 1)")).alias("s"))
    met = left.join(grouped.select("key", "s", F.col("x").alias("x2")), ["key", "s"]).select("key", (F.col("s") == F.col("s1")).alias("same"), "x1", "x2")

    def side(column: pa.Array) -> dict:
        v = column.values
        cls, _ = fixed(v.field("cls"), np.uint64)
        comp, _ = fixed(v.field("comp"), np.uint64)
        prints, at = fixed(v.field("prints"), np.uint16)
        return {"at": column.offsets.to_numpy(), "cls": cls.reshape(-1, 2), "comp": comp.reshape(-1, 2), "n": v.field("n").to_numpy(), "bands": v.field("bands").flatten().to_numpy().reshape(len(v), -1), "prints": prints, "pat": at}

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << 16, bool)
        for batch in batches:
            x, y = side(batch.column("x1")), side(batch.column("x2"))
            out: list[tuple[np.ndarray, np.ndarray]] = []
            for i, (key, same) in enumerate(zip(batch.column("key").to_pylist(), batch.column("same").to_pylist())):
                p, q = slice(x["at"][i], x["at"][i + 1]), slice(y["at"][i], y["at"][i + 1])
                one, two = x["bands"][p], y["bands"][q]
                small, large = np.minimum(x["n"][p][:, None], y["n"][q]), np.maximum(x["n"][p][:, None], y["n"][q])
                ask = (100 * small >= percent * large) & (x["comp"][p][:, None] != y["comp"][q]).any(axis=2)
                if same:  # the lists of equal blocks need not be in the same order: a pair is told by its digests
                    u, v = x["cls"][p][:, None], y["cls"][q]
                    ask &= (u[..., 0] < v[..., 0]) | ((u[..., 0] == v[..., 0]) & (u[..., 1] < v[..., 1]))
                for e in range(int(np.argmax(one[0] == key))):
                    ask &= one[:, e][:, None] != two[:, e]
                begin, end = y["pat"][q.start], y["pat"][q.stop]
                cat, starts = y["prints"][begin:end], y["pat"][q] - begin
                for r in np.flatnonzero(ask.any(axis=1)):
                    own = x["prints"][x["pat"][p.start + r] : x["pat"][p.start + r + 1]]
                    seen[own] = True
                    hits = np.minimum(np.add.reduceat(seen[cat].astype(np.int32), starts), small[r])
                    seen[own] = False
                    may = np.flatnonzero(ask[r] & (100 * hits >= percent * (x["n"][p][r] + y["n"][q] - hits)))
                    out.append((np.broadcast_to(x["cls"][p.start + r], (len(may), 2)), y["cls"][q][may]))
            if out:
                a, b = (np.concatenate(z) for z in zip(*out))
                yield pa.RecordBatch.from_pydict({"a": pa.array([v.tobytes() for v in a], pa.binary()), "b": pa.array([v.tobytes() for v in b], pa.binary())})

    found = met.mapInArrow(compared, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 2) -> DataFrame:
    """doc_id, h (digest of the text), n_shingles, component_id, kept of every row of docs, by shingles of `size` words.

    component_id is the least doc_id that links reach. Null text, and text without words, has an empty set, links with
    nothing and is kept. Rows that share a doc_id are kept or dropped together. Rows without doc_id take part; their
    component's id is the least doc_id in it, null if there is none (then all its rows are kept, as none can be named).
    An empty table stays empty. Columns other than doc_id and text are ignored.
    """
    signed = settle(sign(docs, size), "signatures")
    classes = signed.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "h")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = settle(classes.select("cls", "least", "rep.doc_id", "rep.h", "n", "bands"), "classes")
    placed = classes.select("cls", "n", F.explode("bands").alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    shared = settle(shared, "shared-bands")
    in_shared = settle(placed.join(shared, "key").select("key", "c", "cls", "n"), "bucket-members")
    popular = settle(in_shared.groupBy("cls").agg(F.sum("c").alias("pop")), "popular")
    placed = settle(in_shared.join(popular, "cls"), "buckets")
    discard(shared, in_shared, popular)
    sets = settle(sets_of(docs, classes.join(placed.select("cls").distinct(), "cls", "left_semi"), size), "sets")

    def alike(x: str, y: str):  # sizes too far apart cannot reach the similarity
        return 100 * F.least(x, y) >= percent * F.greatest(x, y)

    tried = links = None
    done = [placed, sets, classes]
    for round_ in range(HUB_ROUNDS + 1):
        if links is None:
            at = placed.withColumn("comp", F.col("cls"))
        else:
            comp = components(links)
            at = placed.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
        member = F.struct("pop", "cls", "n", "comp")
        keys = at.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.max(member).alias("hub")).where("_lo != _hi")
        keys = settle(keys.select("key", "hub"), "open-buckets")
        done.append(keys)
        if round_ < HUB_ROUNDS:
            if round_:  # the most shared member outside the first hub's component
                other = at.join(keys, "key").where(F.col("comp") != F.col("hub.comp"))
                keys = settle(other.groupBy("key").agg(F.max(member).alias("hub")), "open-buckets")
                done.append(keys)
            met = at.join(keys, "key").where((F.col("comp") != F.col("hub.comp")) & alike("n", "hub.n"))
            pairs = met.select(F.least("cls", "hub.cls").alias("a"), F.greatest("cls", "hub.cls").alias("b"))
        else:
            # buckets of two were compared with their hub
            rest = at.where("c > 2").join(keys.select("key"), "key", "left_semi")
            rest = rest.join(sets.select("cls", "prints"), "cls").join(classes.select("cls", "bands"), "cls")
            pairs = rest_pairs(rest, percent)
        pairs = pairs.distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = settle(pairs, "pairs")
        found = settle(confirm(pairs, sets, percent), "confirmed")
        done += [pairs, found]
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
    comp = components(links)
    labels = classes.select("cls", "least").join(comp.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("component", "cls").alias("comp"))
    named = labels.groupBy("comp").agg(F.min("least").alias("component_id"))
    labels = settle(labels.join(named, "comp").select("cls", "component_id"), "labels")
    discard(*done)
    out = signed.join(labels, "cls", "left").withColumn("component_id", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.coalesce(F.col("doc_id").eqNullSafe(F.col("component_id")), F.lit(False))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, size: int = 2) -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows equal in doc_id and text one stays."""
    on = {"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_z": F.col("doc_id").isNull()}
    keys = near_duplicates(docs, percent, size).where("kept").withColumns(on).select("_k", "_z", F.col("h").alias("_x")).distinct()
    rows = docs.select(*[c.alias(name) for name, c in on.items()], F.xxhash64("text").alias("_x"), whole_row(docs))
    kept = rows.join(keys, ["_k", "_z", "_x"], "left_semi")
    # the window needs the partitions and the order that the join has made
    one = F.row_number().over(Window.partitionBy("_k", "_z", "_x").orderBy("_x"))
    return kept.withColumn("_one", one).where("_one = 1").select("_row.*")


def op6_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component and verdict of every document by two-word shingles (see near_duplicates)."""
    return near_duplicates(read(spark, sf_dir, "documents"), size=2).select("doc_id", "n_shingles", "component_id", "kept")
