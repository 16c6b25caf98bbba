"""URL filter by host rules and a character language-model ratio (native: DataFrame functions only).

Two smoothed variable-order Markov models of characters are counted, one over URLs that the rules allow and one over
URLs that they block. A URL that no rule decides is scored by the difference of the two log-likelihoods per character
and blocked beyond a threshold that was calibrated on held-out allowed URLs.

Characters fall into 40 classes, so a model has 40^3 entries at most (three characters), whatever the number of URLs:
this bounds the broadcast table. Contexts of two characters back off to one and none by Witten-Bell weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, settle

#: What is blocked and allowed, as host suffix and path prefix.
BLOCK = ("net/", "example.com/de/")
ALLOW = ("example.net/en/", "org/fr/")
#: One class a character; digits share 0, everything else shares the last.
CLASSES = "abcdefghijklmnopqrstuvwxyz0./:-_?=&%#~+"
OTHER = "*"
SIZE = len(CLASSES) + 1
START = "://"
#: Share of held-out allowed URLs that the calibrated threshold may block, at most.
FALSE_BLOCKS = 0.01
#: Log ratios are summed as whole millionths, so that the order of a sum changes nothing; scores are in steps of 0.001.
UNIT = 1_000_000
SCORE_STEP = 0.001


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: empty for null or a text without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/?[^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple[str, ...]) -> Column:
    """The longest rule that fits; null if none does. A rule's host fits itself and its subdomains."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def codes(url: Column) -> Column:
    """Class numbers of a URL's characters after the scheme, from START on."""
    text = F.concat(F.lit(START), F.regexp_replace(F.lower(url), r"(?s)^.*?://", ""))
    plain = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), f"[^{CLASSES.replace('-', chr(92) + '-')}]", OTHER)
    return F.transform(F.split(plain, ""), lambda c: F.when(F.instr(F.lit(CLASSES), c) > 0, F.instr(F.lit(CLASSES), c) - 1).otherwise(F.lit(SIZE - 1)))


def trigrams(urls: DataFrame) -> DataFrame:
    """A row (…, g) for each character after the first two of a URL: g numbers the three classes."""
    c = urls.withColumn("_c", codes(F.col("url")))
    n = F.size("_c") - 2
    z = F.arrays_zip(F.slice("_c", F.lit(1), n).alias("x"), F.slice("_c", F.lit(2), n).alias("y"), F.slice("_c", F.lit(3), n).alias("z"))
    return c.withColumn("g", F.explode(F.transform(z, lambda t: (t["x"] * SIZE + t["y"]) * SIZE + t["z"]))).drop("_c")


def model(counts: DataFrame) -> DataFrame:
    """(g, llr): the log ratio blocked to allowed of each trigram's smoothed probability, for all trigrams.

    counts: (g, accepted, rejected). Witten-Bell: an order's share is its count over count and distinct followers.
    """
    spark = counts.sparkSession
    grid = spark.range(SIZE**3).select(F.col("id").cast("int").alias("g")).join(F.broadcast(counts), "g", "left").fillna(0)
    grid = grid.withColumn("z", F.col("g") % SIZE).withColumn("yz", F.col("g") % SIZE**2).withColumn("y", F.floor(F.col("yz") / SIZE).cast("int")).withColumn("xy", F.floor(F.col("g") / SIZE).cast("int"))
    sides = ("accepted", "rejected")
    one = grid.groupBy("z").agg(*[F.sum(s).alias(f"{s}_z") for s in sides])
    two = grid.groupBy("yz").agg(*[F.sum(s).alias(f"{s}_yz") for s in sides])
    ctx1 = two.groupBy(F.floor(F.col("yz") / SIZE).cast("int").alias("y")).agg(*[F.sum(f"{s}_yz").alias(f"{s}_y") for s in sides], *[F.sum((F.col(f"{s}_yz") > 0).cast("long")).alias(f"{s}_ty") for s in sides])
    ctx2 = grid.groupBy("xy").agg(*[F.sum(s).alias(f"{s}_xy") for s in sides], *[F.sum((F.col(s) > 0).cast("long")).alias(f"{s}_txy") for s in sides])
    total = one.agg(*[F.sum(f"{s}_z").alias(s) for s in sides], *[F.sum((F.col(f"{s}_z") > 0).cast("long")).alias(f"t_{s}") for s in sides]).first()
    full = grid.join(F.broadcast(one), "z").join(F.broadcast(two), "yz").join(F.broadcast(ctx1), "y").join(F.broadcast(ctx2), "xy")

    def probability(s: str) -> Column:
        n0, t0 = total[s] or 0, total[f"t_{s}"] or 0
        p0 = (F.col(f"{s}_z") + F.lit(t0 + 1.0) / SIZE) / F.lit(n0 + t0 + 1.0)
        p1 = F.when(F.col(f"{s}_y") == 0, p0).otherwise((F.col(f"{s}_yz") + F.col(f"{s}_ty") * p0) / (F.col(f"{s}_y") + F.col(f"{s}_ty")))
        return F.when(F.col(f"{s}_xy") == 0, p1).otherwise((F.col(s) + F.col(f"{s}_txy") * p1) / (F.col(f"{s}_xy") + F.col(f"{s}_txy")))

    return full.select("g", (F.log(probability("rejected")) - F.log(probability("accepted"))).alias("llr"))


def judge_urls(pages: DataFrame, block: tuple[str, ...] = BLOCK, allow: tuple[str, ...] = ALLOW, false_blocks: float = FALSE_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every page.

    The models learn from distinct URLs that a rule decides, four fifths of them by checksum; the remaining allowed ones
    calibrate the threshold: the least score, in steps of 0.001, that blocks no more than false_blocks of them, and never
    below 0, where an allowed URL is as likely. Without
    blocked or allowed examples, or without held-out ones, undecided URLs are allowed. Null url, or one without `://`:
    host and path empty, no rule, score null, allowed. Null or repeated page_id: judged row by row. Other columns are
    ignored.
    """
    host, path = url_parts(F.col("url"))
    every = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule = longest_rule(F.col("host"), F.col("path"), (*block, *allow))
    every = every.withColumn("rule", rule)
    every = settle(every.withColumn("_given", F.when(F.col("rule").isin(*allow), "allow").when(F.col("rule").isNotNull(), "block")), "url-pages")
    # one row for each distinct url: its rule follows from it
    distinct = every.where("host != ''").groupBy("url").agg(F.first("_given").alias("given"))
    held = F.pmod(F.crc32(F.col("url").cast("binary")), F.lit(5)) == 0
    distinct = settle(distinct.withColumn("held", held), "url-distinct")
    counts = trigrams(distinct.where("given is not null and not held")).groupBy("g").agg(F.sum((F.col("given") == "allow").cast("long")).alias("accepted"), F.sum((F.col("given") == "block").cast("long")).alias("rejected"))
    table = settle(model(counts), "url-model")
    scored = trigrams(distinct.where("given is null or (held and given = 'allow')")).join(F.broadcast(table), "g")
    scores = scored.groupBy("url", "given").agg(F.sum(F.round(F.col("llr") * UNIT).cast("long")).alias("_s"), F.count("*").alias("_n"))
    # the nearest step, halves up; no log ratio is below -30
    step = F.expr(f"(2 * _s + _n * {60 * UNIT + UNIT // 1000}) div (2 * _n * {UNIT // 1000}) - {30 * 1000}")
    scores = settle(scores.select("url", "given", step.cast("long").alias("step"), (step * SCORE_STEP).alias("score")), "url-scores")
    seen = distinct.where("not held").agg(F.count_if(F.col("given") == "allow"), F.count_if(F.col("given") == "block")).first()
    # a row for each step of the score: scores of single characters are bounded, so are the steps
    steps = scores.where("given = 'allow'").groupBy("step").count().orderBy(F.desc("step")).collect() if all(seen) else []
    n, over, limit = sum(r["count"] for r in steps), 0, None
    for r in steps:
        if over + r["count"] > false_blocks * n:
            limit = r["step"]
            break
        over += r["count"]
    beyond = F.lit(False) if limit is None else F.col("step") > max(limit, 0)
    # a row for each distinct url: both sides are dealt out, whatever the size of the written file
    judged = every.join(scores.select(F.col("url").alias("_url"), "step", "score").hint("merge"), F.col("url") == F.col("_url"), "left")
    verdict = F.coalesce(F.col("_given"), F.when(F.coalesce(beyond, F.lit(False)), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page (see judge_urls)."""
    return judge_urls(read(spark, sf_dir, "pages"))


def _sql() -> str:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    fits = []
    for rule in sorted((*BLOCK, *ALLOW), key=lambda r: (-len(r), r)):
        h, _, p = rule.partition("/")
        fits.append(f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{rule}'")
    allow = ", ".join(f"'{r}'" for r in ALLOW)

    def probability(s: str) -> str:
        p0 = f"(({s}z.n) + (t{s}.t + 1.0) / {SIZE}) / (t{s}.n + t{s}.t + 1.0)"
        p1 = f"(case when coalesce({s}y.n, 0) = 0 then {p0} else (coalesce({s}yz.n, 0) + {s}y.t * {p0}) / ({s}y.n + {s}y.t) end)"
        p1 = p1.replace(f"({s}z.n)", f"coalesce({s}z.n, 0)")
        return f"(case when coalesce({s}xy.n, 0) = 0 then {p1} else (coalesce({s}g.n, 0) + {s}xy.t * {p1}) / ({s}xy.n + {s}xy.t) end)"

    tables, joins = [], []
    for s, given in (("p", "allow"), ("r", "block")):
        tables.append(f"""{s}g as (select g, count(*) n from tri where given = '{given}' and not held group by g),
{s}z as (select g % {SIZE} z, sum(n)::bigint n from {s}g group by 1), {s}yz as (select g % {SIZE**2} yz, sum(n)::bigint n from {s}g group by 1),
{s}y as (select yz // {SIZE} y, sum(n)::bigint n, count(*) t from {s}yz group by 1), {s}xy as (select g // {SIZE} xy, sum(n)::bigint n, count(*) t from {s}g group by 1),
t{s} as (select coalesce(sum(n), 0)::bigint n, count(*) t from {s}z)""")
        joins.append(f"left join {s}g on {s}g.g = u.g left join {s}z on {s}z.z = u.g % {SIZE} left join {s}yz on {s}yz.yz = u.g % {SIZE**2} left join {s}y on {s}y.y = u.g % {SIZE**2} // {SIZE} left join {s}xy on {s}xy.xy = u.g // {SIZE} cross join t{s}")
    return rf"""
with recursive page as (select page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{up}', '{low}') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path from pages),
ru as (select *, case {' '.join(fits)} end rule from page), gv as (select *, case when rule in ({allow}) then 'allow' when rule is not null then 'block' end given from ru),
bits as (select 0 i, range(0, 256)::bigint[] v union all select i + 1, list_transform(v, lambda x: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) from bits where i < 8), crc as (select v from bits where i = 8),
di as (select distinct url, given from gv where host != ''),
dh as (select url, given, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(url, ''), lambda c: ascii(c)::bigint)), lambda c, b: xor(c // 256, crc.v[((xor(c, b) & 255) + 1)::int])), 4294967295) % 5 = 0 held from di, crc),
co as (select *, list_transform(string_split(regexp_replace('{START}' || regexp_replace(lower(url), '(?s)^.*?://', ''), '[0-9]', '0', 'g'), ''), lambda c: case when instr('{CLASSES}', c) > 0 then instr('{CLASSES}', c) - 1 else {SIZE - 1} end) cs from dh),
tri as (select url, given, held, (cs[p] * {SIZE} + cs[p + 1]) * {SIZE} + cs[p + 2] g from (select *, unnest(range(1, len(cs) - 1)) p from co)),
{', '.join(tables)},
u as (select distinct g from tri), llr as (select u.g, ln({probability('r')}) - ln({probability('p')}) llr from u {' '.join(joins)}),
sc as (select url, given, (2 * sum(round(llr * {UNIT})::bigint) + count(*) * {60 * UNIT + UNIT // 1000})::bigint // (2 * count(*) * {UNIT // 1000}) - {30 * 1000} step from tri join llr using (g) where given is null or (held and given = 'allow') group by url, given),
st as (select step, sum(count(*)) over (order by step desc) upto, sum(count(*)) over () n from sc where given = 'allow' group by step),
li as (select case when (select count(distinct given) from dh where not held and given is not null) = 2 then max(case when upto > {FALSE_BLOCKS} * n then step end) end lim from st)
select page_id, host, path, rule, coalesce(gv.given, case when sc.step > greatest(lim, 0) and lim is not null then 'block' else 'allow' end) verdict, sc.step * {SCORE_STEP}::double score from gv left join sc using (url) cross join li
"""


OP10_SQL = _sql()
