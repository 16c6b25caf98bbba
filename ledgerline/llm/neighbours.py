"""Approximate nearest neighbours by cosine with an inverted multi-index.

Vectors are scaled to length one and cut into two halves, each quantised by a codebook of its own; a vector's cell is
the pair of its centroids. A query walks the centroid pairs in the order of summed distance, with a heap, until the
cells passed hold its quota of vectors; the sum it has reached then marks every cell it visits. All vectors of visited
cells are scored exactly.

The quota is calibrated, not fixed: for CALIBRATION query vectors the true neighbours are found by scoring all rows in
blocks, and the quota is what the walk needs for the share TARGET of these neighbours. Well clustered data gets a short
walk, noise a long one, and recall holds for either.

Codebooks are fitted on a bounded sample (SAMPLE vectors in the order of a digest); all vectors are indexed. Equal
vectors are indexed once, with the least ids that a result can hold, so copies of a vector cost nothing more. First-half
centroids lie in blocks, neighbours together; a block holds BLOCK_BYTES of vectors at most, and a centroid with more has
blocks of its own. A query comes once to each block that it reaches, so what is copied grows with queries times blocks,
not with cells.

Within a block the best entries are told by a matrix product, whose rounding is bounded: all entries within that bound
of the k-th best stay, and are then ordered by the exact cosine and their ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, power_of_two, read, settle

SAMPLE = 16_384
CALIBRATION = 128
TARGET = 0.98
#: Queries that come to a block at a time.
CHUNK = 256
#: Vectors of a block, in bytes; blocks that a small table still has, for tasks to run side by side.
BLOCK_BYTES = 4_000_000
BLOCKS = 64
#: Scored entries that a task holds before it reduces them to each query's best.
HELD = 400_000
#: Centroids a half, at most: bounds the table of cells to CENTROIDS squared.
CENTROIDS = 1024


def valid(vector) -> "F.Column":
    """Not null or empty, without null or non-finite components, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(raw: np.ndarray) -> np.ndarray:
    v = raw.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def distances(v: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (v * v).sum(1)[:, None] - 2 * v @ book.T + (book * book).sum(1)


def fit_codebook(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows."""
    book = v[np.linspace(0, len(v) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        of = distances(v, book).argmin(1)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(book)
        np.add.at(sums, of, v)
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


def reach(d1: np.ndarray, d2: np.ndarray, cells: np.ndarray, quota: int) -> float:
    """Summed distance at which a query's walk over centroid pairs has passed quota vectors."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, passed, at = [(s1[0] + s2[0], 0, 0)], 0, 0.0
    while heap and passed < quota:
        at, a, b = heapq.heappop(heap)
        passed += int(cells[o1[a], o2[b]])
        if a + 1 < len(s1):
            heapq.heappush(heap, (s1[a + 1] + s2[b], a + 1, b))
        if a == 0 and b + 1 < len(s2):  # each pair is pushed once: along the first row, then down its column
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))
    return at


def matrix(packed, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(-1, dim)


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two, which is exact, so that no square overflows."""
    _, exponent = np.frexp(np.abs(v).max(axis=1, initial=0.0))
    return np.ldexp(v, -exponent[:, None])


def cosine(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact cosine of paired rows, in double precision."""
    q, v = scaled(q), scaled(v)
    return (q * v).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((v * v).sum(1)))


def slack(dim: int) -> float:
    """Twice the most by which a cosine from unit vectors can be off, of `dim` products and their sum."""
    return 8 * (dim + 8) * np.finfo(np.float64).eps


def blocks_of(book: np.ndarray, counts: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each first-half centroid.

    Centroids are taken in the order of their main direction and share a block while it has room.
    """
    per = int(max(1, min(BLOCK_BYTES // (8 * dim), -(-counts.sum() // BLOCKS))))
    centred = book - book.mean(axis=0)
    order = np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")
    base, many = np.zeros(len(book), np.int64), np.ones(len(book), np.int64)
    block, room = -1, 0
    for i in order:
        if counts[i] > per:
            many[i] = -(-counts[i] // per)
            base[i], block, room = block + 1, block + many[i], 0
        else:
            if counts[i] > room or block < 0:
                block, room = block + 1, per
            base[i] = block
            room -= counts[i]
    return base, many


def search(vectors: DataFrame, every: int = 50, k: int = 5, target: float = TARGET) -> DataFrame:
    """The k nearest of each vector whose vec_id is divisible by every, among all others: query_id, rank, vec_id, score.

    Takes no part: null vec_id; null, empty or zero vectors; null or non-finite components. Vectors of different lengths
    have no cosine: each length has an index of its own, so lengths should be few. Rows that repeat a vec_id with another
    vector are candidates of their own, never neighbours of that vec_id. Equal vectors all count. Score ties go to the
    smaller vec_id. A target of 1 visits every cell. No vectors, no rows. Other columns are ignored.
    """
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")).where(valid(F.col("e")))
    # a row a length
    lengths = [r["n"] for r in rows.groupBy(F.size("e").alias("n")).count().orderBy("n").collect()]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, dim in enumerate(lengths):
        found = search_length(rows.where(F.size("e") == dim), dim, every, k, target)
        out = out.unionByName(found) if i else found
    return out


def search_length(rows: DataFrame, dim: int, every: int, k: int, target: float) -> DataFrame:
    """search() among vectors of one length (vec_id, e)."""
    spark = rows.sparkSession
    least = rows.withColumn("_r", F.dense_rank().over(Window.partitionBy("e").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    asked = rows.where(F.col("vec_id") % every == 0)
    unique = least.groupBy("e").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    unique = unique.join(asked.select("e").distinct().withColumn("asks", F.lit(True)), "e", "left").select("ids", F.coalesce("asks", F.lit(False)).alias("asks"), "e")
    # a number for each vector, as one id may have several: given once, in the written table
    unique = settle(unique.withColumn("uid", F.monotonically_increasing_id()).select("uid", "ids", "asks", "e"), "ann-unique")
    number_of = unique.where("asks").select("e", "uid")

    def pack_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(e=[np.asarray(v, np.float64).tobytes() for v in pdf["e"]])

    unique = settle(unique.mapInPandas(pack_rows, "uid long, ids array<long>, asks boolean, e binary"), "ann-vectors")
    n = unique.count()
    half = max(1, dim // 2)
    order = [F.xxhash64("e"), F.col("ids")[0]]
    # bounded: SAMPLE vectors
    sample = unit(matrix([r["e"] for r in unique.orderBy(*order).select("e").limit(SAMPLE).collect()], dim))
    width = min(len(sample), power_of_two(int(n**0.5 / 2), CENTROIDS))
    books = [fit_codebook(sample[:, :half], width), fit_codebook(sample[:, half:] if dim > 1 else sample, width)]
    shared = spark.sparkContext.broadcast(books)

    def halves(v: np.ndarray, bs) -> tuple[np.ndarray, np.ndarray]:
        u = unit(v)
        return distances(u[:, :half], bs[0]), distances(u[:, half:] if dim > 1 else u, bs[1])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                d1, d2 = halves(matrix(pdf["e"], dim), shared.value)
                yield pdf.assign(i=d1.argmin(1).astype(np.int32), j=d2.argmin(1).astype(np.int32))

    index = settle(unique.mapInPandas(assign, "uid long, ids array<long>, asks boolean, e binary, i int, j int"), "ann-index")
    discard(unique)
    cells = np.zeros((width, width), np.int64)
    for r in index.groupBy("i", "j").count().collect():  # bounded: a row a cell
        cells[r["i"], r["j"]] = r["count"]
    quota = int(cells.sum()) if target >= 1 else calibrate(index, order, cells, halves, shared, dim, k, target)
    base, many = blocks_of(books[0], cells.sum(axis=1), dim)
    table = spark.sparkContext.broadcast((cells, base, many))

    def reached(batches: Iterator[pd.DataFrame], quota: int) -> Iterator[pd.DataFrame]:
        cells, base, many = table.value
        for pdf in batches:
            if len(pdf):
                d1, d2 = halves(matrix(pdf["e"], dim), shared.value)
                limit = np.array([reach(a, b, cells, quota) for a, b in zip(d1, d2)])
                limit += 1e-9 * (1 + np.abs(limit))  # distances are computed again in blocks, and rounded otherwise
                hit = (d1 + d2.min(1)[:, None] <= limit[:, None]) & (cells.sum(axis=1) > 0)
                q, b = [], []
                for p, row in enumerate(hit):
                    own = np.unique(np.concatenate([np.arange(base[i], base[i] + many[i]) for i in np.flatnonzero(row)])) if row.any() else np.zeros(0, np.int64)
                    q.append(np.full(len(own), p))
                    b.append(own)
                q, b = np.concatenate(q), np.concatenate(b)
                yield pd.DataFrame({"b": b.astype(np.int64), "q": pdf["uid"].to_numpy()[q], "qe": pdf["e"].to_numpy()[q], "lim": limit[q]})

    of = lambda values: F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("i") + 1)
    blocks = index.withColumn("b", (of(base) + F.pmod(F.xxhash64("e"), of(many))).cast("long")).groupBy("b").agg(F.collect_list(F.struct("ids", "i", "j", "e")).alias("vs_"))

    def best_of(frames: list[pd.DataFrame]) -> pd.DataFrame:
        """The k + 1 best ids of each query, each by the best of its vectors."""
        every = pd.concat(frames).sort_values(["q", "score", "vec_id"], ascending=[True, False, True])
        return every.drop_duplicates(["q", "vec_id"]).groupby("q").head(k + 1)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for pdf in batches:
            for qs, vs in zip(pdf["qs_"], pdf["vs_"]):
                q, v = matrix([r["qe"] for r in qs], dim), matrix([r["e"] for r in vs], dim)
                ids = np.array([r["q"] for r in qs], np.int64)
                d1, d2 = halves(q, shared.value)
                i, j = np.array([r["i"] for r in vs]), np.array([r["j"] for r in vs])
                near = np.where(d1[:, i] + d2[:, j] <= np.array([r["lim"] for r in qs])[:, None], unit(q) @ unit(v).T, -np.inf)
                # a place for each id of a vector, those of one id side by side: an id is as near as its best vector
                of = np.repeat(np.arange(len(vs)), [len(r["ids"]) for r in vs])
                vec_ids = np.concatenate([r["ids"] for r in vs]).astype(np.int64)
                by_id = np.argsort(vec_ids, kind="stable")
                of, vec_ids = of[by_id], vec_ids[by_id]
                first = np.flatnonzero(np.concatenate([[True], vec_ids[1:] != vec_ids[:-1]]))
                by_place = near[:, of]
                best = by_place if len(first) == len(of) else np.maximum.reduceat(by_place, first, axis=1)
                most = min(len(first), k + 1)
                edge = -np.partition(-best, most - 1, axis=1)[:, most - 1]
                a, b = np.nonzero((by_place >= edge[:, None] - slack(dim)) & (by_place > -np.inf))
                for at in range(0, len(a), HELD):
                    x, y = a[at : at + HELD], b[at : at + HELD]
                    held.append(best_of([pd.DataFrame({"q": ids[x], "vec_id": vec_ids[y], "score": cosine(q[x], v[of[y]])})]))
                    size += len(held[-1])
                if size > HELD:
                    held = [best_of(held)]
                    if len(held[0]) > HELD // 2:
                        yield held.pop()
                    size = sum(map(len, held))
        if held:
            yield best_of(held)

    def nearest(asking: DataFrame, quota: int) -> DataFrame:
        """(q, vec_id, score): the k + 1 best ids of each asking vector (uid, e), its own among them."""
        chunks = max(1, -(-asking.count() // CHUNK))
        queries = asking.select("uid", "e").mapInPandas(lambda batches: reached(batches, quota), "b long, q long, qe binary, lim double")
        queries = queries.groupBy("b", F.pmod(F.xxhash64("q"), F.lit(chunks)).alias("qs")).agg(F.collect_list(F.struct("q", "lim", "qe")).alias("qs_"))
        found = queries.join(blocks, "b").select("qs_", "vs_").mapInPandas(score, "q long, vec_id long, score double")
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
        best = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"))
        return best.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).drop("_r")

    every_ = int(cells.sum())
    asking = index.where("asks")
    listed = settle(nearest(asking, quota), "ann-nearest")
    if quota < every_:
        # a walk among vectors of few ids may not reach enough of them: it goes on to the last cell
        enough = listed.groupBy("q").count().where(F.col("count") > k).select(F.col("q").alias("uid"))
        short = settle(asking.join(enough, "uid", "left_anti").select("uid", "e"), "ann-short")
        if short.limit(1).count():
            listed = listed.join(short.select(F.col("uid").alias("q")), "q", "left_anti").unionByName(nearest(short, every_))
    to_unique = asked.select(F.col("vec_id").alias("query_id"), "e").distinct().join(number_of, "e").select("query_id", F.col("uid").alias("q"))
    pairs = to_unique.join(listed, "q").where("query_id != vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def calibrate(index: DataFrame, order: list, cells: np.ndarray, halves, shared, dim: int, k: int, target: float) -> int:
    """Vectors that a walk must pass to meet the share target of true neighbours, by CALIBRATION query vectors."""
    probes = index.where("asks").orderBy(*order).select("e", "uid").limit(CALIBRATION).collect()
    if not probes:
        return 1
    q = unit(matrix([r["e"] for r in probes], dim))
    ids = np.array([r["uid"] for r in probes])
    probe = index.sparkSession.sparkContext.broadcast((q, ids))

    def top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q, ids = probe.value
        for pdf in batches:
            if len(pdf):
                s = unit(matrix(pdf["e"], dim)) @ q.T
                s[pdf["uid"].to_numpy()[:, None] == ids] = -2
                best = np.argsort(-s, axis=0)[:k]
                p = np.broadcast_to(np.arange(len(ids)), best.shape).ravel()
                b = best.ravel()
                yield pd.DataFrame({"p": p.astype(np.int32), "score": s[b, p], "i": pdf["i"].to_numpy()[b], "j": pdf["j"].to_numpy()[b]})

    best = index.select("uid", "e", "i", "j").mapInPandas(top, "p int, score double, i int, j int")
    truth = best.withColumn("_r", F.row_number().over(Window.partitionBy("p").orderBy(F.desc("score"), "i", "j"))).where(F.col("_r") <= k).collect()
    d1, d2 = halves(matrix([r["e"] for r in probes], dim), shared.value)
    need = []
    for p in range(len(probes)):
        sums = (d1[p][:, None] + d2[p]).ravel()
        by_sum = np.argsort(sums, kind="stable")
        upto = np.empty(len(sums), np.int64)
        upto[by_sum] = np.cumsum(cells.ravel()[by_sum])
        need += [upto[r["i"] * len(d2[p]) + r["j"]] for r in truth if r["p"] == p]
    return int(np.quantile(need, target, method="higher")) if need else int(cells.sum())


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every 50th vector among all others (see search)."""
    return search(read(spark, sf_dir, "embeddings"))
