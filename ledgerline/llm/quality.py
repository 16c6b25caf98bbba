"""Risk-controlled quality rules (native: DataFrame functions only).

A rule rejects a document whose rate exceeds a cutoff. Cutoffs are chosen for every stratum (language) on labelled
documents, in two parts by a digest of the id. The choosing part (a quarter) says how far along a rule's grid, from
lenient to strict, it pays to go: to the cutoff that best tells bad documents from good ones, or nowhere if none does.
The other part certifies: a cutoff stands if the number of good labelled documents that it rejects makes a true
false-rejection rate above the allowed one improbable, by the exact binomial tail P(Bin(n, alpha) <= k). The cutoffs are
tested in the grid's order, stopping at the first failure (fixed-sequence testing: the order and its end do not depend on
the certifying part), so one stratum and rule need no further correction; across strata and rules the level is divided
(Bonferroni). With probability 1 - delta no stratum loses more than rules * alpha of its good documents. A stratum with
too few labels certifies nothing and loses nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import group_key, read, settle, words

#: Rates per thousand, each with its grid from lenient to strict.
RULES: dict[str, tuple[str, tuple[int, ...]]] = {
    "symbols": ("1000 * n_symbols div greatest(n_words, 1)", (4000, 3000, 2500, 2000, 1500, 1000, 750, 500, 350, 250, 150, 100, 50)),
    "dup_lines": ("1000 * n_dup_lines div greatest(n_lines, 1)", (900, 800, 700, 600, 500, 400, 350, 300, 250)),
    "repeats": ("1000 * n_repeat_words div greatest(n_words, 1)", (480, 450, 400, 350, 300, 250, 200)),
    "long_words": ("1000 * word_chars div greatest(n_words, 1)", (14000, 12000, 11000, 10000, 9500, 9000, 8500, 8000, 7500, 7000)),
}
ALPHA, DELTA = 0.01, 0.05


def _once(value: Column, f) -> Column:
    """f(value) with value computed once for a row, though f uses it within lambdas."""
    return F.transform(F.array(value), f)[0]


def repeat_words(ws: Column) -> Column:
    """Words that lie in a 3-word window found twice or more among the words ws, the first included.

    Windows are sorted; those equal to a neighbour repeat. Three words a window, less what the next one shares. Texts
    without any repeat, by the number of distinct windows, are not sorted.
    """
    n = F.size(ws)
    windows = F.arrays_zip(F.slice(ws, F.lit(1), n - 2).alias("a"), F.slice(ws, F.lit(2), n - 2).alias("b"), F.slice(ws, F.lit(3), n - 2).alias("c"))
    joined = F.transform(windows, lambda x: F.concat_ws(" ", x["a"], x["b"], x["c"]))

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.arrays_zip(found.alias("w"), F.sequence(F.lit(1), F.size(found)).alias("p")))

        def positions(s: Column) -> Column:
            m = F.size(s)
            beside = F.arrays_zip(s.alias("x"), F.concat(F.array(F.lit(None).cast("string")), F.slice(s["w"], F.lit(1), m - 1)).alias("l"), F.concat(F.slice(s["w"], F.lit(2), m - 1), F.array(F.lit(None).cast("string"))).alias("r"))
            twice = F.filter(beside, lambda y: F.coalesce(y["x"]["w"] == y["l"], F.lit(False)) | F.coalesce(y["x"]["w"] == y["r"], F.lit(False)))
            return F.sort_array(F.transform(twice, lambda y: y["x"]["p"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at"))
        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p - acc["at"])).cast("long").alias("n"), p.alias("at"))
        return F.aggregate(_once(ordered, positions), start, step, lambda acc: acc["n"])

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_once(joined, lambda j: F.when(F.size(F.array_distinct(j)) == F.size(j), F.lit(0).cast("long")).otherwise(covered(j))))


def measures(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the measures of every whole text; null text has no words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), group_key(F.col(stratum)).alias("stratum"), words(F.col("text")).alias("_w"), lines.alias("_l"), (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"))
    out = base.select(
        "doc_id",
        "stratum",
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        repeat_words(F.col("_w")).alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _log_factorial(x: Column) -> Column:
    """ln(x!) of a count: exact up to 20, then Stirling's series, whose error is below 1e-12 there."""
    y = x.cast("double") + 1
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5.0)))
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k) for k <= n * alpha, else 1 (such a k certifies nothing).

    The sum runs down from its largest term; after 40 standard deviations nothing is left to add.
    """
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(alpha) + (n - k) * math.log1p(-alpha)
    terms = F.least(k, F.ceil(40 * F.sqrt(n)) + 40).cast("int")
    one = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc, j):
        t = acc["t"] * ((k - j) * (1 - alpha)) / ((n - k + j + 1) * alpha)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    return F.when(k > n * alpha, F.lit(1.0)).otherwise(F.exp(top) * F.aggregate(F.sequence(F.lit(0), terms), one, add, lambda acc: acc["s"]))


#: First hex digits of an id's digest that put a labelled document into the choosing part.
CHOOSING = "4"


def choose_cutoffs(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) of the certified cutoffs, from the measures of labelled documents with `good`, a row each."""
    part = F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 1) < CHOOSING
    steps = F.array(*[F.struct(F.lit(rule).alias("rule"), F.lit(j).alias("step"), F.lit(t).alias("cutoff"), (F.expr(rate) > t).alias("hit")) for rule, (rate, grid) in RULES.items() for j, t in enumerate(grid)])
    rows = labelled.select("stratum", "good", part.alias("chooses"), F.explode(steps).alias("s")).select("stratum", "good", "chooses", "s.*")
    good, hit, chooses = F.col("good"), F.col("hit"), F.col("chooses")
    counts = rows.groupBy("stratum", "rule", "step", "cutoff").agg(
        F.count_if(good & ~chooses).alias("n"),
        F.count_if(good & ~chooses & hit).alias("k"),
        # bad documents that the cutoff tells from good ones, less good ones that it takes for bad, times both numbers
        (F.count_if(~good & chooses & hit) * F.count_if(good & chooses) - F.count_if(good & chooses & hit) * F.count_if(~good & chooses)).alias("gain"),
    )
    one = Window.partitionBy("stratum", "rule")
    best = F.max(F.when(F.col("gain") > 0, F.struct("gain", (-F.col("step")).alias("s")))).over(one)
    # a row for each stratum and step in one window
    first = (F.col("rule") == next(iter(RULES))) & (F.col("step") == 0) & (F.col("n") > 0)
    strata = F.sum(first.cast("long")).over(Window.partitionBy())
    tested = counts.withColumns({"_strata": strata, "_end": -best["s"]}).where(F.col("step") <= F.col("_end"))
    tested = tested.withColumn("p", F.when(F.col("n") > 0, binomial_tail(F.col("k"), F.col("n"), alpha)).otherwise(1.0))
    failed = F.col("p") > F.lit(delta) / (len(RULES) * F.col("_strata"))
    certified = tested.withColumn("_f", F.min(F.when(failed, F.col("step"))).over(one)).where("_f is null or step < _f")
    return certified.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Measures, base_failed and kept of every document.

    Labelled documents are those that pass the base rules; good ones are those whose labels all say quality 1. Null text:
    no words, so base_failed. Null stratum: a stratum of its own. Null doc_id: never labelled. Repeated rows: judged
    alike, one by one. No labels, or none that are bad: only the base rules reject. Columns of docs other than doc_id,
    text and the stratum are ignored.
    """
    known = settle(measures(docs, stratum), "quality-measures")
    quality = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") == 1).alias("good"))
    cutoffs = choose_cutoffs(known.where("not base_failed").join(quality, "doc_id"), alpha, delta)
    by_stratum = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])
    rejected = [F.coalesce(F.expr(rate) > F.col(f"cut_{rule}"), F.lit(False)) for rule, (rate, _) in RULES.items()]
    ok = ~F.col("base_failed")
    for x in rejected:
        ok = ok & ~x
    joined = known.join(by_stratum, "stratum", "left")
    name = F.when(F.col("stratum").startswith("0"), F.expr("substring(stratum, 2)"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.when(F.col("base_failed"), False).otherwise(ok).alias("kept"), name.alias("stratum"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, with cutoffs by language (see judge)."""
    return judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def _sql() -> str:
    rates = ", ".join(f"({rate.replace(' div ', ' // ')}) {rule}" for rule, (rate, _) in RULES.items())
    grid = ", ".join(f"('{rule}', {j}, {t})" for rule, (_, g) in RULES.items() for j, t in enumerate(g))
    value = "case g.rule " + " ".join(f"when '{r}' then {r}" for r in RULES) + " end"
    over = " or ".join(f"coalesce({r} > (select cut from c where c.stratum = k.stratum and c.rule = '{r}'), false)" for r in RULES)
    return rf"""
with d as (select row_number() over () id, doc_id, coalesce('0' || lang, '1') stratum, coalesce(text, '') t from documents),
w as (select id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) ls, t from d),
u as (select id, unnest(range(1, len(ws) - 1)) p, ws from w where len(ws) >= 3),
g3 as (select id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] w3 from u),
rp as (select id, count(distinct q) n from (select id, unnest([p, p + 1, p + 2]) q from (select *, count(*) over (partition by id, w3) c from g3) where c > 1) group by id),
m as (select d.doc_id, d.stratum, len(ws) n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint word_chars, length(w.t) - length(regexp_replace(w.t, '[#*$%&|<>]', '', 'g')) n_symbols,
  len(ls) - len(list_distinct(ls)) n_dup_lines, len(ls) n_lines, coalesce(rp.n, 0) n_repeat_words from d join w using (id) left join rp using (id)),
k as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed, {rates} from m),
q as (select doc_id, min(quality) = 1 good from labels where doc_id is not null and quality is not null group by doc_id),
lab as (select k.*, q.good, substr(md5(k.doc_id::varchar), 1, 1) < '{CHOOSING}' chooses from k join q using (doc_id) where not base_failed),
g(rule, step, cut) as (values {grid}),
hit as (select stratum, good, chooses, g.rule, g.step, g.cut, {value} > g.cut hit from lab, g),
h as (select stratum, rule, step, cut, count_if(good and not chooses)::bigint n, count_if(good and not chooses and hit)::bigint k,
  count_if(not good and chooses and hit) * count_if(good and chooses) - count_if(good and chooses and hit) * count_if(not good and chooses) gain from hit group by all),
b as (select *, row_number() over (partition by stratum, rule order by gain desc, step) r from h where gain > 0),
e as (select h.* from h join b on b.stratum = h.stratum and b.rule = h.rule and b.r = 1 and h.step <= b.step),
p as (select *, case when n = 0 or k > n * {ALPHA} then 1.0 else list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA})))) end p,
  {DELTA} / ({len(RULES)} * (select count(distinct stratum) from h where n > 0)) lev from e),
f as (select *, min(case when p > lev then step end) over (partition by stratum, rule) bad from p),
c as (select stratum, rule, min(cut) cut from f where bad is null or step < bad group by all)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not ({over}) kept, case when stratum like '0%' then substr(stratum, 2) end stratum from k
"""


OP1_SQL = _sql()
