"""Collocations: phrases whose words come together far more often than chance, by prefix-free parsing.

1. Parsing. Every piece of text is cut where the hash of the next WINDOW words says so, a choice that depends on these
   words alone. A chunk reaches from one cut over the words of the next cut's window, so neighbouring chunks overlap by
   WINDOW words, and the same passage gives the same chunks wherever it stands. Distinct chunks form the dictionary, with
   their frequency in the parse.
2. Counting. A phrase is counted in the chunk in which it starts before the next cut; it is no longer than WINDOW + 1
   words, so it lies within that chunk, and overlaps count once. Phrases of a distinct chunk count as often as the chunk.
   Longer phrases can only be frequent where both parts without their last and first word are: a pass for each length asks a
   filter of the frequent phrases one word shorter (16 bits a phrase, BITS at most, which may let others pass, never the
   reverse), so that few phrases of rare ones move. All counts are of the words themselves, not of hashes.
3. Scoring. The frequent phrases are one table; the parts of every cut find their counts in it by a salted join.

Nothing is gathered by language alone: dictionary and counts are dealt by chunk and phrase, ranks come from parts of a
language first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, if_small, power_of_two, read, settle
from .textbytes import RangeHash, mix, split_batch, text_buffer, words_at

#: Words of a phrase, occurrences of a candidate, phrases of a language that are returned.
LONGEST, LEAST, TOP = 5, 100, 2000
#: One window in CUT ends a chunk.
CUT = 8
#: Most bits of the filter of frequent phrases.
BITS = 1 << 27
#: Bytes of text, and of chunks, that are worked on together.
TEXTS, CHUNKS = 1 << 21, 1 << 21
SALTS = 16
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_GAPS = np.isin(np.arange(256), list(b" \t"))
_FACTORS = np.random.default_rng(11).integers(1, 2**63, 16, dtype=np.uint64) * _U(2) + _U(1)


def closed(texts: pa.Array, end: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts with an end mark each; nulls are empty."""
    large = lambda value: pa.scalar(value, pa.large_string())
    return text_buffer(pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), large("")), large(""), large(end)))


def chunks_of(langs: pa.Array, texts: pa.Array, window: int) -> pa.Table:
    """Distinct chunks of texts: lang, last (whether its piece ends with it), chunk (words joined by a space), n."""
    offsets, data = closed(texts, "\n")
    data = _LOWER[data]
    inside = ~(_ENDS | _GAPS)[data]
    start = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    stop = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    piece = np.cumsum(_ENDS[data])[start]
    of = np.searchsorted(offsets, start, side="right") - 1
    # words of the batch with one space after each
    data[stop] = 32
    inside[stop] = True
    data = data[inside]
    end = np.cumsum(stop - start + 1) - 1
    start = end - (stop - start)
    n = len(start)
    opens = np.concatenate([[True], piece[1:] != piece[:-1]]) if n else np.zeros(0, bool)
    cut = opens.copy()
    if n > window:
        h = RangeHash(data)(start, end)
        seen = sum((h[k : n - window + k + 1] * _FACTORS[k] for k in range(window)), np.zeros(n - window + 1, _U))
        cut[: n - window + 1] |= (mix(seen) % _U(CUT) == 0) & (piece[window - 1 :] == piece[: n - window + 1])
    first = np.flatnonzero(cut)
    next_ = np.append(first[1:], n)[: len(first)]
    last = np.append(opens[first[1:]], True)[: len(first)]
    until = np.where(last, next_, next_ + window)
    chunk = words_at(data, start[first], end[until - 1] if n else end)
    table = pa.table({"lang": langs.take(pa.array(of[first])), "last": pa.array(last), "chunk": chunk.cast(pa.large_string()), "n": pa.array(np.ones(len(first), np.int64))})
    out = table.group_by(["lang", "last", "chunk"]).aggregate([("n", "sum")])
    return pa.table({"lang": out.column("lang"), "last": out.column("last"), "chunk": out.column("chunk").cast(pa.string()), "n": out.column("n_sum")})


def dictionary(docs: DataFrame, window: int = LONGEST - 1) -> DataFrame:
    """(lang, last, chunk, n): distinct chunks of all texts and how often the parse has them."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in split_batch(whole, "text", TEXTS):
                yield from chunks_of(batch.column("lang"), batch.column("text"), window).to_batches()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(parsed, "lang string, last boolean, chunk string, n long").groupBy("lang", "last", "chunk").agg(F.sum("n").alias("n"))


def phrase_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(RangeHash(data)(start, end) ^ lang)


def lang_hash(langs: pa.Array) -> np.ndarray:
    """A hash of each row's language."""
    coded = langs.dictionary_encode()
    offsets, data = text_buffer(coded.dictionary)
    h = RangeHash(data)(offsets[:-1], offsets[1:]) if len(coded.dictionary) else np.zeros(0, _U)
    return h[coded.indices.to_numpy(zero_copy_only=False)]


def phrases_of(table: pa.Table, size: int, frequent: np.ndarray | None, window: int) -> pa.Table:
    """(lang, phrase, n) of the phrases of `size` words that start in chunks, each as often as its chunk.

    frequent: bits of a filter of phrases one word shorter; both such parts of a phrase must be in it.
    """
    langs, last = (table.column(c).combine_chunks() for c in ("lang", "last"))
    offsets, data = closed(table.column("chunk").combine_chunks(), " ")
    end = np.flatnonzero(data == 32)
    start = np.concatenate([[0], end[:-1] + 1])[: len(end)]
    of = np.searchsorted(offsets, start, side="right") - 1
    words = np.bincount(of, minlength=len(offsets) - 1)
    left = np.cumsum(words)[of] - np.arange(len(of))  # words to the end of the chunk
    starts = left >= np.maximum(size, np.where(last.to_numpy(zero_copy_only=False)[of], 1, window + 1))
    at = np.flatnonzero(starts)
    if frequent is not None:
        short = size - 1
        whole = np.flatnonzero(left >= short)
        h = phrase_hash(data, start[whole], end[whole + short - 1], lang_hash(langs)[of[whole]])
        known = np.zeros(len(of) + 1, bool)
        known[whole] = in_filter(frequent, h)
        at = at[known[at] & known[at + 1]]
    phrase = words_at(data, start[at], end[at + size - 1])
    out = pa.table({"lang": langs.take(pa.array(of[at])), "phrase": phrase.cast(pa.large_string()), "n": table.column("n").combine_chunks().take(pa.array(of[at]))})
    out = out.group_by(["lang", "phrase"]).aggregate([("n", "sum")])
    return pa.table({"lang": out.column("lang"), "phrase": out.column("phrase").cast(pa.string()), "n": out.column("n_sum")})


def in_filter(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & _U(len(bits) * 64 - 1)
    return (bits[(place >> _U(6)).astype(np.int64)] >> (place & _U(63)) & _U(1)).astype(bool)


def filter_of(frequent: DataFrame, n_rows: int) -> np.ndarray:
    """A filter of phrases as bits, BITS / 8 bytes at most: a bit for each phrase's hash is set."""
    n_bits = power_of_two(max(1 << 16, 16 * n_rows), BITS)

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(n_bits // 64, _U)
        for batch in batches:
            offsets, data = text_buffer(batch.column("phrase"))
            place = phrase_hash(data, offsets[:-1], offsets[1:], lang_hash(batch.column("lang"))) & _U(n_bits - 1)
            np.bitwise_or.at(bits, (place >> _U(6)).astype(np.int64), _U(1) << (place & _U(63)))
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at), "bits": pa.array(bits[at].view(np.int64))})

    slots = frequent.select("lang", "phrase").mapInArrow(set_bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(n_bits // 64, _U)
    out[slots.column("at").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return out


def count_phrases(chunks: DataFrame, size: int, frequent: np.ndarray | None, window: int) -> DataFrame:
    """(lang, phrase, n) of all phrases of a size whose parts the filter knows."""
    told = None if frequent is None else chunks.sparkSession.sparkContext.broadcast(frequent)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        bits = None if told is None else told.value
        for whole in batches:
            for batch in split_batch(whole, "chunk", CHUNKS):
                held.append(batch)
                n += batch.nbytes
                if n >= CHUNKS:
                    yield from phrases_of(pa.Table.from_batches(held), size, bits, window).to_batches()
                    held, n = [], 0
        if held:
            yield from phrases_of(pa.Table.from_batches(held), size, bits, window).to_batches()

    return chunks.mapInArrow(counted, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(lang, phrase, size, f) of all phrases of `longest` words at most that occur `least` times or more; (lang, n) of all
    words; and the written tables behind them."""
    window = max(1, longest - 1)
    chunks = settle(dictionary(docs, window), "chunks")
    words = settle(count_phrases(chunks, 1, None, window), "words")
    totals = settle(words.groupBy("lang").agg(F.sum("n").alias("n")), "word-totals")
    found = [words.where(F.col("n") >= least)]
    behind = [words, totals]
    for size in range(2, longest + 1):
        n_rows = found[-1].count()
        if not n_rows:
            break
        found.append(settle(count_phrases(chunks, size, filter_of(found[-1], n_rows), window).where(F.col("n") >= least), "phrases"))
        behind.append(found[-1])
    discard(chunks)
    every = None
    for size, table in enumerate(found, 1):
        part = table.select("lang", "phrase", F.lit(size).alias("size"), F.col("n").alias("f"))
        every = part if every is None else every.unionByName(part)
    return every, totals, behind


def look_up(rows: DataFrame, part: str, table: DataFrame, name: str) -> DataFrame:
    """rows with the table's f of (lang, part): rows of a frequent part are dealt over salts, to which the table is copied."""
    salted = table.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(name), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    keyed = rows.withColumn("_k", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int"))
    on = (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_phrase")) & (F.col("_k") == F.col("_s"))
    return keyed.join(salted.hint("merge"), on).drop("_lang", "_phrase", "_s", "_k")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best collocations of each language of docs (lang, text).

    Texts are split into pieces at punctuation and line ends, pieces into words at spaces and tabs; A-Z count as a-z. A
    phrase of 2 to `longest` words that occurs a >= `least` times within pieces is scored at its weakest cut: l and r are
    the occurrences of its parts there, score = floor(1000 * a * n / (l * r)) with n words in the language. Phrases within
    a longer one that occurs as often are left out.

    Null texts are empty, null languages are `und`. Repeated rows count as often as they are there. Phrases that tie in
    score and a come by bytes. Languages without a candidate, empty tables and tables without words give no rows. Other
    columns are left out.
    """
    every, totals, behind = frequent_phrases(docs, longest, least)
    every = settle(every, "frequent")
    discard(behind[0], *behind[2:])
    candidates = every.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("_w"))
    part = lambda a, n: F.array_join(F.slice("_w", a, n), " ")
    cuts = candidates.select("lang", "phrase", "size", "a", "_w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("_left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("_right"))
    cuts = look_up(look_up(cuts, "_left", every, "l"), "_right", every, "r")
    cuts = cuts.join(if_small(totals, totals.count()), "lang")
    # whole decimals of 38 digits: a, n, l and r may have 64 bits
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("c"))
    # who is within a phrase of two words more that occurs as often is so within one of one word more
    within = candidates.where("size > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    within = within.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    left = scored.join(within.hint("merge"), ["lang", "phrase"], "left").where("_longer is null or _longer < a")
    left = left.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*best))
    left = left.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(32))).withColumn("_rank", some).where(F.col("_rank") <= top).drop("_part", "_rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")
    out = left.withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents, by language."""
    return collocations(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
with p as (
  select coalesce(lang, 'und') lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') ws from p),
t as (select lang, sum(len(ws))::bigint n from w group by all),
g as (select lang, unnest(flatten([[array_to_string(ws[i:i + m - 1], ' ') for i in range(1, len(ws) - m + 2)] for m in range(1, 6)])) phrase from w),
f as (select lang, phrase, count(*) f from g group by all having count(*) >= 100),
c as (select lang, phrase, f a, string_split(phrase, ' ') ws from f where contains(phrase, ' ')),
k as (select *, unnest(range(1, len(ws))) k from c),
s as (select k.lang, k.phrase, a, k, x.f l, y.f r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint score
  from k join f x on x.lang = k.lang and x.phrase = array_to_string(ws[1:k], ' ')
    join f y on y.lang = k.lang and y.phrase = array_to_string(ws[k + 1:], ' ') join t on t.lang = k.lang),
b as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1),
i as (select lang, a, unnest(flatten([[array_to_string(ws[i:i + m - 1], ' ') for i in range(1, len(ws) - m + 2)] for m in range(2, len(ws))])) phrase from c),
x as (select lang, phrase, max(a) longer from i group by all)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, n, score
from b left join x using (lang, phrase) where longer is null or longer < a
qualify "rank" <= 2000
"""
