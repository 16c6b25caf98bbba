"""The registered queries, one or more for each operator, each with its SQL where SQL can express it.

All run over feeds that are derived from the whole `events` table (see feeds.py). `query` registers a function under its
name together with its SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import book as B
from ..operators import fanout as FO
from ..operators import inject as I
from ..operators import latency as L
from ..operators import ordering as O
from ..operators import replay as R
from ..operators import stretches as ST
from ..operators import telemetry as T
from ..operators import views as V
from ..schema import COUNTER_NAMES, FEED_EVENTS, KEY, LEVELS
from ..shared import drop_written, shared_path, written
from ..sources import documents as D
from ..sources import frames as FR
from ..sources import logs as LG
from ..streaming import ingest as IN
from ..streaming.fanout import delivery_stream
from ..streaming.live import link_labels, telemetry_stream, throttled_stream
from ..streaming.replay import latest_views_stream, replay_stream, use_rocksdb
from . import chaos
from .feeds import EV, LAST, PRICE_SCALE, SIZE_SCALE, as_events, empty_snapshots, level_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return register


def px(v: str) -> str:
    """SQL text of a price at the feeds' scale."""
    return f"((({v}) // 100)::varchar || '.' || lpad((({v}) % 100)::varchar, 2, '0'))"


def sz(v: str) -> str:
    return f"((({v}) // 1000)::varchar || '.' || lpad((({v}) % 1000)::varchar, 3, '0'))"


def in_case(words: dict[str, str]) -> str:
    """SQL text of the branches of a case."""
    quoted = {k: v.replace("'", "''") for k, v in words.items()}
    return " ".join(f"when '{k}' then '{v}'" for k, v in quoted.items())


def str_list(agg: str) -> str:
    return f"coalesce({agg}, '')"


# The feeds of single users: many small books, sides by event id.
EVU = EV.replace("event_type symbol", "user_id::varchar symbol").replace("user_id % 2", "event_id % 2").replace("partition by event_type", "partition by user_id")
TOP = f"""{EVU}, {LAST},
ranked as (select *, row_number() over (partition by symbol, side order by case when side = 'bid' then -price else price end) rank from book),
top as (select * from ranked where rank <= 10),
best as (select venue, symbol, max(case when side = 'bid' then price end) bid, min(case when side = 'ask' then price end) ask from top group by all)"""


def user_book(spark: SparkSession, d: str) -> DataFrame:
    return B.latest(B.delta_levels(as_events(level_rows(spark, d, "user_id"))))


def user_views(spark: SparkSession, d: str) -> DataFrame:
    """Top-10 views of every user's feed with string levels."""
    v = B.as_views(B.top(user_book(spark, d), 10).drop("rank"))
    return v.select(*KEY, S.levels_as_strings(F.col("bids"), PRICE_SCALE, SIZE_SCALE).alias("bids"), S.levels_as_strings(F.col("asks"), PRICE_SCALE, SIZE_SCALE).alias("asks"))


def first_price(side: str):
    return F.get(F.get(F.col(side), F.lit(0)), F.lit(0))


# --- flagship --------------------------------------------------------------------------------------------------------


@query(
    "top_book",
    f"""with {EV}, {LAST}, r as (select *, row_number() over (partition by symbol, side order by case when side = 'bid' then -price else price end) rank from book),
b as (select symbol, max(case when side = 'bid' then price end) bb, min(case when side = 'ask' then price end) ba from book group by symbol)
select r.venue, r.symbol, side, rank, price, size, {px('ba - bb')} spread, ((bb + ba) * 5 // 1000)::varchar || '.' || lpad(((bb + ba) * 5 % 1000)::varchar, 3, '0') mid
from r join b using (symbol) where rank <= 5""",
)
def top_book(spark: SparkSession, d: str) -> DataFrame:
    """Top-5 book, mid and spread of every feed."""
    book = B.latest(B.delta_levels(as_events(level_rows(spark, d))))
    best = B.best(book)
    bid, ask = S.format_scaled(F.col("bid"), PRICE_SCALE), S.format_scaled(F.col("ask"), PRICE_SCALE)
    figures = best.select(*KEY, S.spread(bid, ask).alias("spread"), S.mid(bid, ask).alias("mid"))
    return B.top(book, 5).join(figures, KEY).select(*KEY, "side", "rank", "price", "size", "spread", "mid")


# --- B. scalars ------------------------------------------------------------------------------------------------------

# decimal strings of many forms out of the events: good ones, long ones, and every kind of bad one
FORMS = "case event_id % 10 when 0 then '.5' when 1 then '5.' when 2 then '-' || c::varchar when 3 then c::varchar || '.50000' when 4 then '9223372036854775' || lpad((event_id % 1000)::varchar, 3, '0') || '.' || '0' when 5 then c::varchar || '.' || lpad((event_id % 100000)::varchar, 5, '0') when 6 then '1e' || (event_id % 9)::varchar when 7 then '' when 8 then c::varchar || '.1.2' else '00' || c::varchar end"
GOOD = "regexp_full_match(s, '[0-9]+(\\.[0-9]+)?')"
FRACTION = "rtrim(case when contains(s, '.') then split_part(s, '.', 2) else '' end, '0')"


def forms(spark: SparkSession, d: str) -> DataFrame:
    e = level_rows(spark, d).select("event_id", F.col("c").cast("string").alias("c"))
    k = F.col("event_id") % 10
    n = F.col("event_id")
    pad = lambda m, w: F.lpad((n % m).cast("string"), w, "0")
    s = (
        F.when(k == 0, ".5").when(k == 1, "5.").when(k == 2, F.concat(F.lit("-"), "c")).when(k == 3, F.concat("c", F.lit(".50000")))
        .when(k == 4, F.concat(F.lit("9223372036854775"), pad(1000, 3), F.lit(".0"))).when(k == 5, F.concat("c", F.lit("."), pad(100000, 5)))
        .when(k == 6, F.concat(F.lit("1e"), (n % 9).cast("string"))).when(k == 7, "").when(k == 8, F.concat("c", F.lit(".1.2"))).otherwise(F.concat(F.lit("00"), "c"))
    )
    return e.select("event_id", s.alias("s"), (n % 21 - 1).cast("int").alias("scale"))


@query(
    "b1_parse_scaled",
    f"""with {EV}, f as (select event_id, {FORMS} s, (event_id % 21 - 1)::int scale from ev),
g as (select *, {FRACTION} fr, split_part(s, '.', 1) w, {GOOD} good from f),
v as (select *, case when scale between 0 and 18 and good and length(fr) <= scale then try_cast(w || rpad(fr, greatest(scale, 0), '0') as bigint) end ticks from g)
select event_id, s, scale, ticks, case when scale < 0 or scale > 18 then 'scale' when not good then 'malformed' when length(fr) > scale then 'precision' when ticks is null then 'overflow' end reason from v""",
)
def b1(spark: SparkSession, d: str) -> DataFrame:
    return forms(spark, d).withColumns({"ticks": S.parse_scaled(F.col("s"), F.col("scale")), "reason": S.parse_reason(F.col("s"), F.col("scale"))})


@query(
    "b2_format_scaled",
    f"""with {EV}, v as (select event_id, case when event_id % 3 = 0 then -c else c end v, (event_id % 23 - 2)::int scale from ev), k as (select *, least(greatest(scale, 0), 18) k, abs(v)::varchar a from v), p as (select *, lpad(a, greatest(length(a), k + 1)::int, '0') z from k)
select event_id, v, scale, case when v < 0 then '-' else '' end || case when k = 0 then z else left(z, length(z) - k) || '.' || right(z, k) end text from p""",
)
def b2(spark: SparkSession, d: str) -> DataFrame:
    rows = level_rows(spark, d).select("event_id", F.when(F.col("event_id") % 3 == 0, -F.col("c")).otherwise(F.col("c")).alias("v"), (F.col("event_id") % 23 - 2).cast("int").alias("scale"))
    return rows.withColumn("text", S.format_scaled(F.col("v"), F.col("scale")))


@query(
    "b3_parse_levels",
    f"""with {EV}, r as (select event_id, c, event_id % 7 = 0 as short, event_id % 11 = 0 as bad from ev)
select event_id, not (short or bad) ok, case when not (short or bad) then c * 2 + 1 end price_sum, case when not (short or bad) then 1500 + c * 1000 end size_sum from r""",
)
def b3(spark: SparkSession, d: str) -> DataFrame:
    """Two raw levels a row, some of them short or malformed: one such level refuses the row."""
    c = F.col("c")
    second = F.when(F.col("event_id") % 7 == 0, F.array(F.lit("1"))).when(F.col("event_id") % 11 == 0, F.array(F.lit("x"), F.lit("1"))).otherwise(F.array(S.format_scaled(c + 1, PRICE_SCALE), c.cast("string"), F.lit("extra")))
    rows = level_rows(spark, d).select("event_id", F.array(F.array(S.format_scaled(c, PRICE_SCALE), F.lit("1.500")), second).alias("raw"))
    lv = S.parse_levels(F.col("raw"), F.lit(PRICE_SCALE), F.lit(SIZE_SCALE))
    rows = rows.withColumn("l", lv)
    return rows.select("event_id", F.col("l").isNotNull().alias("ok"), F.expr("l[0].price + l[1].price").alias("price_sum"), F.expr("l[0].size + l[1].size").alias("size_sum"))


@query(
    "b4_scale_of_increment",
    f"""with {EV}, r as (select event_id, case event_id % 6 when 0 then '0.' || repeat('0', (c % 8)::int) || '1000' when 1 then '1.0000' when 2 then '10' when 3 then '' when 4 then '0.0x1' else '0.' || c::varchar end inc from ev)
select event_id, inc, case event_id % 6 when 0 then c8 + 1 when 1 then 0 when 2 then 0 when 3 then null when 4 then null else length(rtrim(substr(inc, 3), '0')) end as scale from (select *, length(inc) - 6 c8 from r)""",
)
def b4(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("event_id") % 6, F.col("c")
    inc = F.when(k == 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), (c % 8).cast("int")), F.lit("1000"))).when(k == 1, "1.0000").when(k == 2, "10").when(k == 3, "").when(k == 4, "0.0x1").otherwise(F.concat(F.lit("0."), c.cast("string")))
    rows = level_rows(spark, d).select("event_id", inc.alias("inc"))
    return rows.withColumn("scale", S.scale_of_increment(F.col("inc")).cast("bigint"))


@query(
    "b8_decimal_kit",
    f"""with {EV}, r as (select event_id, {FORMS} s from ev), g as (select *, {GOOD} plain from r)
select event_id, s, plain, case when plain then replace(s, '.', '')::decimal(38,0) end scaled, case when contains(s, '.') then length(s) - instr(s, '.') else 0 end as scale, case when plain then case when starts_with(s, '00') then ltrim(substr(s, 1, length(s) - 1), '0') || substr(s, length(s)) else s end end as again from g""",
)
def b8(spark: SparkSession, d: str) -> DataFrame:
    """is_plain_decimal, to_scaled, scale_of, and from_scaled back to the text (without leading zeros)."""
    rows = forms(spark, d).select("event_id", "s")
    s = F.col("s")
    rows = rows.withColumns({"plain": S.is_plain_decimal(s), "scaled": S.to_scaled(s), "scale": S.scale_of(s).cast("bigint")})
    back = S.from_scaled(F.col("scaled"), F.col("scale").cast("int"))
    return rows.withColumn("again", back)


PAIR = f"pr as (select event_id, {px('1 + c % 1000')} bid, case when event_id % 13 = 0 then (c % 50)::varchar when event_id % 17 = 0 then null else {px('900 + c % 300')} end ask, 1 + c % 1000 b, 900 + c % 300 a, event_id % 13 = 0 odd, event_id % 17 = 0 and event_id % 13 != 0 gone, c from ev)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    c, e = F.col("c"), F.col("event_id")
    ask = F.when(e % 13 == 0, (c % 50).cast("string")).when(e % 17 == 0, None).otherwise(S.format_scaled(900 + c % 300, PRICE_SCALE))
    return level_rows(spark, d).select("event_id", S.format_scaled(1 + c % 1000, PRICE_SCALE).alias("bid"), ask.alias("ask"))


@query(
    "b9_spread",
    f"""with {EV}, {PAIR} select event_id, case when gone then null when odd then null else (a - b)::varchar end ticks,
case when gone then null when odd then (c % 50 - b)::varchar else case when a < b then '-' else '' end || {px('abs(a - b)')} end spread, case when gone then null when odd then b >= c % 50 else b >= a end crossed from pr""",
)
def b9(spark: SparkSession, d: str) -> DataFrame:
    """The spread at the ask's scale, and in ticks where both prices have one scale."""
    bid, ask = F.col("bid"), F.col("ask")
    return pairs(spark, d).select("event_id", S.spread_ticks(bid, ask).alias("ticks"), S.spread(bid, ask).alias("spread"), S.crossed(bid, ask).alias("crossed"))


MID3 = "((({0}) // 1000)::varchar || '.' || lpad((({0}) % 1000)::varchar, 3, '0'))"


@query(
    "b10_mid",
    f"""with {EV}, {PAIR}, m as (select event_id, (a + b) * 5 v, case when odd or gone then null else {MID3.format('(a + b) * 5')} end mid from pr),
p as (select *, case when mid is not null then v end mv from m), l as (select *, lag(mv) over (order by event_id) o from p)
select event_id, mid, case when mv is null or o is null then null when mv = o then '0.000' when mv < o then chr(8722) || {MID3.format('o - mv')} else '+' || {MID3.format('mv - o')} end change from l""",
)
def b10(spark: SparkSession, d: str) -> DataFrame:
    """The mid of each pair and its change from the pair before, by event id within ranges that Spark sorts."""
    rows = pairs(spark, d).select("event_id", S.mid(F.col("bid"), F.col("ask")).alias("mid"))
    before = rows.select((F.col("event_id") + 1).alias("event_id"), F.col("mid").alias("_o"))
    return rows.join(before, "event_id", "left").select("event_id", "mid", S.mid_change(F.col("_o"), F.col("mid")).alias("change"))


@query("b11_gap", f"with {TOP} select venue, symbol, case when bid < ask then {px('ask - bid')} end spread, case when bid < ask then {MID3.format('(bid + ask) * 5')} end mid from best")
def b11(spark: SparkSession, d: str) -> DataFrame:
    g = S.gap(F.col("bids"), F.col("asks"))
    return user_views(spark, d).select(*KEY, g["spread"].alias("spread"), g["mid"].alias("mid"))


@query(
    "b12_number_display",
    f"""with {EV}, r as (select event_id, (c * 7919 * (event_id % 5 + 1))::varchar || case when event_id % 3 = 0 then '.' || lpad((c % 1000)::varchar, 3, '0') else '' end s, (c * 7919 * (event_id % 5 + 1)) n from ev)
select event_id, s, format('{{:,}}', n) || case when contains(s, '.') then '.' || split_part(s, '.', 2) else '' end grouped, s ungrouped, split_part(s, '.', 1) whole, case when contains(s, '.') then '.' || split_part(s, '.', 2) else '' end fraction,
case when contains(s, '.') then rtrim(rtrim(s, '0'), '.') else s end kept, substr(s, length(case when contains(s, '.') then rtrim(rtrim(s, '0'), '.') else s end) + 1) muted from r""",
)
def b12(spark: SparkSession, d: str) -> DataFrame:
    c, e = F.col("c"), F.col("event_id")
    s = F.concat((c * 7919 * (e % 5 + 1)).cast("string"), F.when(e % 3 == 0, F.concat(F.lit("."), F.lpad((c % 1000).cast("string"), 3, "0"))).otherwise(""))
    rows = level_rows(spark, d).select("event_id", s.alias("s"))
    s = F.col("s")
    parts, zeros = S.split_fraction(s), S.trim_zeros(s)
    return rows.select("event_id", "s", S.group_thousands(s).alias("grouped"), S.ungroup(S.group_thousands(s)).alias("ungrouped"), parts[0].alias("whole"), parts[1].alias("fraction"), zeros[0].alias("kept"), zeros[1].alias("muted"))


@query(
    "b13_durations",
    f"""with {EV}, r as (select event_id, c * (case event_id % 4 when 0 then 1 when 1 then 997 when 2 then 99991 else 99999989 end) n from ev)
select event_id, n, case when n < 1000 then '<1 µs' when n < 1000000 then (n // 1000)::varchar || '.' || (n % 1000 // 100)::varchar || ' µs' when n < 1000000000 then (n // 1000000)::varchar || '.' || (n % 1000000 // 100000)::varchar || ' ms' else (n // 1000000000)::varchar || '.' || (n % 1000000000 // 100000000)::varchar || ' s' end latency,
case when n < 1000 then n::varchar || ' ms' else (n // 1000)::varchar || '.' || (n % 1000 // 100)::varchar || ' s' end age,
case when n // 1000 < 60 then (n // 1000)::varchar || ' s' when n // 1000 % 60 = 0 then (n // 60000)::varchar || ' min' else (n // 60000)::varchar || ' min ' || (n // 1000 % 60)::varchar || ' s' end span from r""",
)
def b13(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    n = F.col("c") * F.when(k == 0, 1).when(k == 1, 997).when(k == 2, 99991).otherwise(99999989)
    rows = level_rows(spark, d).select("event_id", n.alias("n"))
    return rows.withColumns({"latency": S.format_latency(F.col("n")), "age": S.format_age(F.col("n")), "span": S.format_span(F.col("n"))})


SIG = "(case when {0} < 1000 then floor({0} * power(10.0, 2 - floor(log10({0}))) + 0.5) / power(10.0, 2 - floor(log10({0}))) else floor({0} / power(10.0, floor(log10({0})) - 2) + 0.5) * power(10.0, floor(log10({0})) - 2) end)"
NUM = "(case when {0} = floor({0}) then {0}::decimal(38,0)::varchar else rtrim(rtrim(({0})::decimal(38,12)::varchar, '0'), '.') end)"


@query(
    "b14_metrics",
    f"""with {EV}, r as (select event_id, case event_id % 3 when 0 then 'x-ns' when 1 then 'x-pct' else 'frames' end unit, (c + 1) / 4.0 * case event_id % 5 when 0 then 1 when 1 then 100 else 10000 end v from ev), q as (select event_id, unit, v::double v from r)
select event_id, unit, v, case when unit = 'x-ns' then case when v < 1000 then {NUM.format('v')} || ' ns' when v < 1e6 then {NUM.format(SIG.format('(v / 1e3)'))} || ' µs' else {NUM.format(SIG.format('(v / 1e6)'))} || ' ms' end
when unit = 'x-pct' then {NUM.format(SIG.format('v'))} || ' %' when v < 1000 then {NUM.format('v')} else {NUM.format(SIG.format('v'))} end text from q""",
)
def b14(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("event_id") % 3, F.col("event_id") % 5
    v = (F.col("c") + 1) / F.lit(4.0) * F.when(m == 0, 1).when(m == 1, 100).otherwise(10000)
    rows = level_rows(spark, d).select("event_id", F.when(k == 0, "x-ns").when(k == 1, "x-pct").otherwise("frames").alias("unit"), v.cast("double").alias("v"))
    return rows.withColumn("text", S.format_metric(F.col("unit"), F.col("v")))


@query("b15_base_currency", f"with {EV}, r as (select event_id, case event_id % 3 when 0 then upper(event_type) || '/USD' when 1 then event_type else '/' || event_type end s from ev) select event_id, s, case when instr(s, '/') > 1 then split_part(s, '/', 1) end base from r")
def b15(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("event_id") % 3, F.col("event_type")
    rows = level_rows(spark, d).select("event_id", F.when(k == 0, F.concat(F.upper(t), F.lit("/USD"))).when(k == 1, t).otherwise(F.concat(F.lit("/"), t)).alias("s"))
    return rows.withColumn("base", S.base_currency(F.col("s")))


#: A fault log out of the events: every kind by turns, some still open.
FAULTS = """fl as (select venue, symbol, row_number() over (partition by symbol order by event_id) id, event_id,
  ['gap', 'cross', 'checksum', 'disconnect', 'snapshot-reject', 'snapshot-error'][(event_id % 6 + 1)::int] kind,
  (received_ns // 1000000) at_ms, c % 40 expected_seq, c % 60 got_seq,
  case when event_id % 4 = 0 then 'snapshot checksum mismatch' else 'snapshot crossed' end reason,
  case event_id % 5 when 0 then -1 when 1 then 0 else c end duration_ms, arrival from ev where event_id % 3 = 0 or event_id % 7 = 0)"""
REBUILD = "('gap', 'cross', 'checksum', 'disconnect')"


def fault_log(spark: SparkSession, d: str) -> DataFrame:
    e = level_rows(spark, d).where("event_id % 3 = 0 or event_id % 7 = 0")
    n, c = F.col("event_id"), F.col("c")
    kind = F.element_at(F.array(*map(F.lit, ("gap", "cross", "checksum", "disconnect", "snapshot-reject", "snapshot-error"))), (n % 6 + 1).cast("int"))
    return e.select(*KEY, F.row_number().over(Window.partitionBy(*KEY).orderBy("event_id")).cast("bigint").alias("id"), "event_id", kind.alias("kind"), F.expr("received_ns div 1000000").alias("at_ms"), (c % 40).alias("expected_seq"), (c % 60).alias("got_seq"), F.when(n % 4 == 0, "snapshot checksum mismatch").otherwise("snapshot crossed").alias("reason"), F.when(n % 5 == 0, F.lit(-1).cast("bigint")).when(n % 5 == 1, F.lit(0).cast("bigint")).otherwise(c).alias("duration_ms"), "arrival")


@query(
    "b16_fault_words",
    f"""with {EV}, {FAULTS}, n as (select *, max(case when kind in {REBUILD} then id end) over (partition by symbol) nw from fl),
w as (select *, case when kind not in {REBUILD} then null when duration_ms = -1 and id = nw then 'rebuilding…' when duration_ms = -1 then 'rebuild time not recorded' when duration_ms = 0 then 'rebuilt from a snapshot in under 1 ms' else 'rebuilt from a snapshot in ' || duration_ms::varchar || ' ms' end rebuild,
case kind when 'gap' then case when expected_seq > 0 and got_seq > 0 then 'Expected ' || expected_seq::varchar || ', got ' || got_seq::varchar || '.' else 'An update was missed.' end {in_case(S.FAULT_SENTENCES)} else upper(left(reason, 1)) || substr(reason, 2) || '.' end what from n)
select venue, symbol, id, case kind {in_case(S.FAULT_TITLES)} end title,
case when rebuild is null then what else what || ' ' || upper(left(rebuild, 1)) || substr(rebuild, 2) || case when rebuild = 'rebuilding…' then '' else '.' end end detail, rebuild from w""",
)
def b16(spark: SparkSession, d: str) -> DataFrame:
    return T.describe_faults(fault_log(spark, d)).select(*KEY, "id", "title", "detail", "rebuild")


@query(
    "b17_b18_b19_labels",
    f"""with {EV} select event_id, case when st is null or st = 429 or st >= 500 then 'transient' else 'permanent' end failure, left(p, 7) cut, case when event_id % 4 = 3 then 'unknown' when event_id % 4 = 2 then 'none' when event_id % 4 = 1 then 'demo-chaos' else 'demo' end chip
from (select event_id, case when event_id % 9 = 0 then null when event_id % 9 = 1 then 429 else 396 + c % 210 end st, repeat('é' || event_type, 3) p from ev)""",
)
def b17(spark: SparkSession, d: str) -> DataFrame:
    """Failure class of a status, cut reason text, and the name of a source's mode."""
    n = F.col("event_id")
    st = F.when(n % 9 == 0, None).when(n % 9 == 1, F.lit(429)).otherwise(396 + F.col("c") % 210)
    mode = F.when(n % 4 == 3, "other").when(n % 4 == 2, "live").otherwise("synthetic")
    return level_rows(spark, d).select("event_id", S.failure_class(st).alias("failure"), S.cut_text(F.repeat(F.concat(F.lit("é"), "event_type"), F.lit(3)), 7).alias("cut"), S.mode_chip(mode, n % 4 == 1).alias("chip"))


# --- A. sources and sinks --------------------------------------------------------------------------------------------


def instruments(spark: SparkSession, d: str) -> DataFrame:
    feeds = level_rows(spark, d).select(*KEY).distinct()
    return feeds.select(*KEY, F.lit(PRICE_SCALE).alias("price_scale"), F.lit(SIZE_SCALE).alias("size_scale"), F.lit(0).alias("max_depth"), F.lit(False).alias("has_checksum"))


def _raw(spark: SparkSession, d: str, kraken: bool) -> DataFrame:
    """Raw frames of the events: every 50th cut short, every 53rd an acknowledgement, every 47th a bad number."""
    e = level_rows(spark, d)
    n, p, z = F.col("event_id"), S.format_scaled(F.col("price"), PRICE_SCALE), S.format_scaled(F.col("size"), SIZE_SCALE)
    if kraken:
        price = F.when(n % 47 == 0, F.concat(F.lit("1e"), p)).otherwise(p)
        level = F.concat(F.lit('[{"price":'), price, F.lit(',"qty":'), z, F.lit("}]"))
        bids, asks = F.when(F.col("side") == "bid", level).otherwise("[]"), F.when(F.col("side") == "ask", level).otherwise("[]")
        frame = F.concat(F.lit('{"channel":"book","type":"'), F.when(F.col("arrival") == 1, "snapshot").otherwise("update"), F.lit('","data":[{"symbol":"'), "symbol", F.lit('","bids":'), bids, F.lit(',"asks":'), asks, F.lit(',"checksum":'), (n % 4294967296).cast("string"), F.lit("}]}"))
        ack = F.lit('{"channel":"heartbeat"}')
    else:
        price = F.when(n % 47 == 0, "-1").otherwise(p)
        level = F.concat(F.lit('[["'), price, F.lit('","'), z, F.lit('"]]'))
        bids, asks = F.when(F.col("side") == "bid", level).otherwise("[]"), F.when(F.col("side") == "ask", level).otherwise("[]")
        frame = F.concat(F.lit('{"e":"depthUpdate","E":1,"s":"'), "symbol", F.lit('","U":'), F.col("arrival").cast("string"), F.lit(',"u":'), F.col("arrival").cast("string"), F.lit(',"b":'), bids, F.lit(',"a":'), asks, F.lit("}"))
        ack = F.lit('{"result":null,"id":1}')
    raw = F.when(n % 53 == 0, ack).when(n % 50 == 0, frame.substr(F.lit(1), F.length(frame) - 9)).otherwise(frame)
    return e.select(*KEY, "arrival", "received_ns", raw.alias("raw"))


def _flat(routed: DataFrame) -> DataFrame:
    level = F.coalesce(F.get("bids", F.lit(0)), F.get("asks", F.lit(0)))
    side = F.when(F.size("bids") > 0, "bid").when(F.size("asks") > 0, "ask")
    return routed.select(*KEY, "arrival", "route", "first_seq", side.alias("side"), level["price"].alias("price"), level["size"].alias("size"))


ROUTE = "case when event_id % 53 = 0 then 'ignored' when event_id % 50 = 0 or event_id % 47 = 0 then 'rejected' else '{0}' end"


@query("a1_b6_binance_frames", f"with {EV}, r as (select *, {ROUTE.format('update')} route from ev) select venue, symbol, arrival, route, case when route = 'update' then arrival end first_seq, case when route = 'update' then side end side, case when route = 'update' then price end price, case when route = 'update' then size end size from r")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return _flat(FR.binance_frames(_raw(spark, d, False), instruments(spark, d)))


@query("a3_b7_kraken_frames", f"with {EV}, r as (select *, case when {ROUTE.format('update')} = 'update' and arrival = 1 then 'snapshot' else {ROUTE.format('update')} end route from ev) select venue, symbol, arrival, route, null::bigint first_seq, case when route in ('update', 'snapshot') then side end side, case when route in ('update', 'snapshot') then price end price, case when route in ('update', 'snapshot') then size end size from r")
def a3(spark: SparkSession, d: str) -> DataFrame:
    return _flat(FR.kraken_frames(_raw(spark, d, True), instruments(spark, d)))


@query("a2_b5_binance_snapshots", f"with {EV}, {LAST}, i as (select symbol, max(arrival) id from ev group by symbol) select b.venue, b.symbol, i.id last_update_id, side, price, size from book b join i using (symbol)")
def a2(spark: SparkSession, d: str) -> DataFrame:
    """REST answers rendered from each feed's final book, read back to level rows."""
    rows = level_rows(spark, d)
    views = B.as_views(B.latest(B.delta_levels(as_events(rows)))).join(rows.groupBy(*KEY).agg(F.max("arrival").alias("id")), KEY)
    raw = F.to_json(F.struct(F.col("id").alias("lastUpdateId"), S.levels_as_strings(F.col("bids"), PRICE_SCALE, SIZE_SCALE).alias("bids"), S.levels_as_strings(F.col("asks"), PRICE_SCALE, SIZE_SCALE).alias("asks")))
    frames = views.select(*KEY, F.lit(0).cast("bigint").alias("arrival"), F.lit(0).cast("bigint").alias("received_ns"), raw.alias("raw"))
    snaps = FR.binance_snapshots(frames, instruments(spark, d)).where("route = 'snapshot'")
    levels = B.snapshot_levels(snaps.withColumn("snap_ord", F.lit(0)).withColumnRenamed("last_seq", "last_update_id"))
    return levels.select(*KEY, "last_update_id", "side", "price", "size")


@query(
    "a4_a5_instrument_scales",
    """with f as (select event_type symbol, min(event_id) n, count(*) k from events group by 1)
select 'EVT' venue, symbol, (k % 7 + 1)::int b_price, case when k % 5 = 0 then null else (k % 4)::int end b_size, k % 5 != 0 b_ok, case when k % 3 = 0 then null else (k % 9)::int end k_price, case when k % 3 = 0 then null else (k % 6)::int end k_size, k % 3 != 0 k_ok from f""",
)
def a4(spark: SparkSession, d: str) -> DataFrame:
    """Instrument answers of both venues for each feed, some without a filter or with an error."""
    k = F.col("k")
    f = level_rows(spark, d).groupBy(*KEY).agg(F.count("*").alias("k"))
    tick = F.concat(F.lit("0."), F.repeat(F.lit("0"), (k % 7).cast("int")), F.lit("100"))
    step = F.when(k % 4 == 0, "1.000").otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), (k % 4 - 1).cast("int")), F.lit("1")))
    info = F.concat(F.lit('{"symbols":[{"symbol":"X","filters":[{"filterType":"PRICE_FILTER","tickSize":"'), tick, F.lit('"}'), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(',{"filterType":"LOT_SIZE","stepSize":"'), step, F.lit('"}'))), F.lit("]}]}"))
    pair = F.concat(F.lit('{"error":['), F.when(k % 3 == 0, '"EQuery"').otherwise(""), F.lit('],"result":{"XX":{"pair_decimals":'), (k % 9).cast("string"), F.lit(',"lot_decimals":'), (k % 6).cast("string"), F.lit("}}}"))
    b = FR.binance_scales(f.select(*KEY, info.alias("raw"))).select(*KEY, F.col("price_scale").alias("b_price"), F.col("size_scale").alias("b_size"), F.col("ok").alias("b_ok"))
    q = FR.kraken_scales(f.select(*KEY, pair.alias("raw"))).select(*KEY, F.col("price_scale").alias("k_price"), F.col("size_scale").alias("k_size"), F.col("ok").alias("k_ok"))
    return b.join(q, KEY)


VIEW_TEXT = f"""select 'EVT' venue, symbol, '{{"venue":"EVT","symbol":"' || symbol || '","seq":' || seq::varchar || ',"bids":[' || coalesce(string_agg(case when side = 'bid' then '["' || {px('price')} || '","' || {sz('size')} || '"]' end, ',' order by rank), '') || '],"asks":[' || coalesce(string_agg(case when side = 'ask' then '["' || {px('price')} || '","' || {sz('size')} || '"]' end, ',' order by rank), '') || ']}}' payload
from top join (select symbol, max(arrival) seq from ev group by symbol) using (symbol) group by symbol, seq"""


def user_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = level_rows(spark, d, "user_id")
    v = B.as_views(B.top(B.latest(B.delta_levels(as_events(rows))), 10).drop("rank"))
    v = v.join(rows.groupBy(*KEY).agg(F.max("arrival").alias("last_seq")), KEY).withColumn("gen", F.lit(1).cast("bigint"))
    return D.view_json(v, PRICE_SCALE, SIZE_SCALE).select(*KEY, "payload")


@query("a6_view_json", f"with {TOP} {VIEW_TEXT}")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return user_payloads(spark, d)


@query(
    "a7_view_reader",
    f"""with {TOP}, t as ({VIEW_TEXT}), n as (select symbol, count(case when side = 'bid' then 1 end) nb, count(case when side = 'ask' then 1 end) na from top group by symbol)
select 'EVT' venue, symbol, case when symbol::bigint % 5 in (1, 2, 3) then false else true end ok, case when symbol::bigint % 5 in (1, 2, 3) then null else nb end n_bids, case when symbol::bigint % 5 in (1, 2, 3) then null else na end n_asks from t join n using (symbol)""",
)
def a7(spark: SparkSession, d: str) -> DataFrame:
    """View documents read back, three in five of them damaged: cut short, a missing key, a negative sequence."""
    k = F.col("symbol").cast("bigint") % 5
    p = F.col("payload")
    damaged = F.when(k == 1, p.substr(F.lit(1), F.length(p) - 1)).when(k == 2, F.regexp_replace(p, '"venue":"EVT",', "")).when(k == 3, F.regexp_replace(p, '"seq":', '"seq":-')).otherwise(p)
    rows = D.parse_view(user_payloads(spark, d).withColumn("payload", damaged))
    return rows.select(*KEY, F.col("view").isNotNull().alias("ok"), F.when(F.col("view").isNotNull(), F.size("view.bids").cast("bigint")).alias("n_bids"), F.when(F.col("view").isNotNull(), F.size("view.asks").cast("bigint")).alias("n_asks"))


def status_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a status needs of each user's feed."""
    e = level_rows(spark, d, "user_id")
    return e.groupBy(*KEY).agg(F.count("*").alias("published"), F.count_if(F.col("size") == 0).alias("dropped"), F.max(F.expr("received_ns div 1000000")).alias("last_event_ms"), F.sum("c").alias("c"), F.max("c").alias("mx"))


def status_docs(spark: SparkSession, d: str) -> DataFrame:
    s = status_rows(spark, d)
    feeds = s.select(*KEY, F.lit("live").alias("mode"), F.lit(False).alias("chaos"), F.lit("v1").alias("version"), F.lit(10).alias("depth"), F.lit(1704067200000).alias("started_ms"))
    counters = s.select(*KEY, (F.col("c") % 7).alias("gaps"), (F.col("c") % 11).alias("resyncs"), *[F.lit(0).cast("bigint").alias(c) for c in COUNTER_NAMES[2:]])
    ages = s.select(*KEY, F.lit(1500).cast("bigint").alias("age_ms"))
    delivery = s.select(*KEY, F.lit(1).cast("bigint").alias("consumers"), (F.col("published") - F.col("dropped")).alias("delivered"), "dropped", "published")
    latency = s.where("c % 2 = 0").select(*KEY, F.col("published").alias("count"), F.lit(1986).cast("bigint").alias("p50_ns"), F.lit(50118).cast("bigint").alias("p99_ns"), F.lit(50118).cast("bigint").alias("p999_ns"), F.col("mx").alias("max_ns"))
    return T.status_documents(feeds, counters, ages, delivery, latency)


STATUS_SQL = "st as (select venue, symbol, count(*) published, count(case when size = 0 then 1 end) dropped, max(received_ns // 1000000) last_event_ms, sum(c)::bigint c, max(c) mx from ev group by all)"


@query(
    "h10_status_documents",
    f"""with {EVU}, {STATUS_SQL} select venue, symbol, '{{"schema":1,"mode":"live","chaos":false,"version":"v1","venue":"EVT","symbol":"' || symbol || '","startedAtUnixMs":1704067200000,"depth":10,"lastEventAgeMs":1500,"delivery":{{"consumers":1,"delivered":' || (published - dropped)::varchar || ',"dropped":' || dropped::varchar || ',"published":' || published::varchar || '}},"engine":{{"gaps":' || (c % 7)::varchar || ',"resyncs":' || (c % 11)::varchar || ',"disconnects":0,"wouldCrosses":0,"checksumMismatches":0,"snapshotRejects":0,"snapshotErrors":0,"rejected":0}}' || case when c % 2 = 0 then ',"latency":{{"count":' || published::varchar || ',"p50Ns":1986,"p99Ns":50118,"p999Ns":50118,"maxNs":' || mx::varchar || '}}' else '' end || '}}' as document from st""",
)
def h10(spark: SparkSession, d: str) -> DataFrame:
    return status_docs(spark, d)


@query(
    "a8_status_reader",
    f"""with {EVU}, {STATUS_SQL}, k as (select *, symbol::bigint % 6 k from st) select venue, symbol, k not in (1, 2, 3, 4) ok, case when k not in (1, 2, 3, 4) then published end published, case when k not in (1, 2, 3, 4) then c % 7 end gaps, case when k not in (1, 2, 3, 4) and c % 2 = 0 then mx end max_ns from k""",
)
def a8(spark: SparkSession, d: str) -> DataFrame:
    """Status documents read back; some of another schema, without a counter, with a negative count or a null latency."""
    k, p = F.col("symbol").cast("bigint") % 6, F.col("document")
    plain = F.regexp_replace(p, r',"latency":\{[^}]*\}', "")
    damaged = F.when(k == 1, F.regexp_replace(p, '"schema":1', '"schema":2')).when(k == 2, F.regexp_replace(p, '"resyncs":[0-9]+,', "")).when(k == 3, F.regexp_replace(p, '"dropped":', '"dropped":-1')).when(k == 4, F.regexp_replace(plain, r"\}$", ',"latency":null}')).otherwise(p)
    s = D.parse_status(status_docs(spark, d).withColumn("document", damaged))
    return s.select(*KEY, F.col("status").isNotNull().alias("ok"), F.col("status.delivery.published").alias("published"), F.col("status.engine.gaps").alias("gaps"), F.col("status.latency.maxNs").alias("max_ns"))


@query(
    "a9_telemetry_reader",
    f"""with {EVU}, g as (select venue, symbol, (arrival - 1) // 3 fr, count(*) n, min(event_id) lo, max(event_id) hi from ev group by all)
select venue, symbol, fr, not (hi % 4 = 0 and n > 1 or hi % 7 = 0) ok, case when not (hi % 4 = 0 and n > 1 or hi % 7 = 0) then n end n_events, case when not (hi % 4 = 0 and n > 1 or hi % 7 = 0) then hi end newest from g""",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry frames of three events each, read back; some with ids out of order or a fractional count."""
    e = level_rows(spark, d, "user_id").withColumn("fr", F.expr("(arrival - 1) div 3"))
    ids = e.groupBy(*KEY, "fr").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    hi = F.array_max("ids")
    order = F.when(hi % 4 == 0, F.reverse("ids")).otherwise(F.col("ids"))
    event = lambda i: F.struct(i.alias("id"), F.lit("gap").alias("kind"), F.lit(1700000000000).alias("atUnixMs"), F.lit(1).alias("expectedSeq"), F.lit(2).alias("gotSeq"), F.lit("sequence gap").alias("reason"), F.lit(-1).alias("durationMs"))
    doc = F.struct(F.lit(1700000000000).alias("t"), F.lit(1).alias("seq"), *[F.lit(0).alias(c) for c in D.COUNTS], F.lit(1).alias("consumers"), F.transform(order, event).alias("events"))
    rows = ids.withColumn("document", F.to_json(doc)).withColumn("document", F.when(hi % 7 == 0, F.regexp_replace("document", '"seq":1', '"seq":1.5')).otherwise(F.col("document")))
    t = D.parse_telemetry(rows)
    ok = F.col("telemetry").isNotNull()
    return t.select(*KEY, "fr", ok.alias("ok"), F.when(ok, F.size("telemetry.events").cast("bigint")).alias("n_events"), F.when(ok, F.array_max("telemetry.events.id")).alias("newest"))


@query(
    "a10_metric_lines",
    f"""with {EVU}, {STATUS_SQL} select venue, symbol, unnest(['book_build_info{{version="v1"}} 1', 'book_hub_consumers 1', 'book_hub_delivered_total 0', 'book_engine_gaps_total 0', 'book_engine_resyncs_total 0', 'book_engine_disconnects_total 0', 'book_engine_would_crosses_total 0', 'book_engine_checksum_mismatches_total 0', 'book_engine_snapshot_rejects_total 0', 'book_engine_snapshot_errors_total 0', 'book_source_rejected_frames_total 0', 'book_latency_seconds_sum 0', 'book_latency_seconds_count 0', 'book_hub_published_total ' || published::varchar, 'book_hub_dropped_total ' || dropped::varchar, 'book_feed_info{{mode="live",symbol="' || symbol || '",venue="EVT"}} 1', 'book_engine_last_event_timestamp_seconds ' || rtrim(rtrim((last_event_ms // 1000)::varchar || '.' || lpad((last_event_ms % 1000)::varchar, 3, '0'), '0'), '.')]) line from st""",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    """All metric samples of each user's feed as text; a feed without a start time or latency has no such row."""
    s = status_rows(spark, d)
    zero = F.lit(0).cast("bigint")
    full = s.withColumns({"mode": F.lit("live"), "version": F.lit("v1"), "started_ms": zero, "consumers": F.lit(1), "delivered": zero, "count": zero, "sum_ns": zero, "max_ns": zero, "p50_ns": zero, "p99_ns": zero, "p999_ns": zero, **{c: zero for c in COUNTER_NAMES}})
    return D.metric_lines(D.metric_samples(full)).select(*KEY, "line")


@query(
    "a11_k7_bench_log",
    f"""with {EV}, r as (select event_type benchmark, c v, row_number() over (partition by event_type order by event_id) run from ev)
select 'Benchmark_' || benchmark benchmark, metric, median(x) median, min(x) low, max(x) high from (select benchmark, 'a-ns' metric, v::double x from r union all select benchmark, 'queue-max', (v % 90) / 2.0 from r) group by all""",
)
def a11(spark: SparkSession, d: str) -> DataFrame:
    """A benchmark log written from the events, read and summed up over runs."""
    e = level_rows(spark, d)
    line = F.concat(F.lit("Benchmark_"), "event_type", F.lit("-4 \t 1\t 123 ns/op\t"), F.col("c").cast("string"), F.lit(" a-ns  "), ((F.col("c") % 90) / 2).cast("string"), F.lit(" queue-max\r"))
    text = e.select(F.lit("log").alias("log"), "event_id", line.alias("value")).withColumnRenamed("event_id", "line_no")
    _, values, _ = LG.bench_lines(text)
    return L.run_summary(values)


#: A capture document holds about so many samples.
CAPTURE_SAMPLES = 10_000


def capture_documents(e: DataFrame) -> DataFrame:
    """Captures of samples (KEY, event_id, ns): as many documents a feed as keep each of them small."""
    parts = e.groupBy(*KEY).agg(F.ceil(F.count("*") / CAPTURE_SAMPLES).alias("_parts"))
    dealt = e.join(parts, KEY).withColumn("part", F.pmod(F.xxhash64("event_id"), F.col("_parts")))
    return dealt.groupBy(*KEY, "part").agg(F.array_sort(F.collect_list(F.when(F.col("ns") > 1000, F.col("ns")))).alias("tail_ns"), F.count("*").alias("total_samples"))


@query(
    "a12_k4_captures",
    f"""with {EV}, s as (select venue, symbol, c * 1000 ns from ev), m as (select symbol, count(*) total, max(ns) mx from s group by symbol), t as (select s.*, m.mx, greatest(1, m.mx // 32) w from s join m using (symbol) where ns > 1000)
select venue, symbol, least(ns // w, 32) bin, count(*) n from t group by all""",
)
def a12(spark: SparkSession, d: str) -> DataFrame:
    """Captures written as files of a document each, of bounded size, read back, checked, exploded and binned."""
    docs = capture_documents(level_rows(spark, d).select(*KEY, "event_id", (F.col("c") * 1000).alias("ns")))
    path = shared_path(spark, "captures")
    docs.select(F.lit(1).alias("schema"), "venue", "symbol", F.lit(60_000_000_000).alias("window_ns"), F.lit(1000).alias("resolution_ns"), "total_samples", "tail_ns").write.option("maxRecordsPerFile", 1).json(path)
    captures = LG.read_captures(spark, path)
    return L.tail_bins(L.tail(LG.capture_samples(captures), KEY), KEY)


@query("a13_canonical_tables", f"with {EV} select venue, symbol, (make_timestamp(received_ns // 1000))::date trade_date, count(*) n, min(arrival) first_arrival, max(last) last_seq from (select *, arrival as last from ev) group by all")
def a13(spark: SparkSession, d: str) -> DataFrame:
    """feed_events written by venue and day and read back."""
    path = shared_path(spark, "feed-events")
    LG.write_table(as_events(level_rows(spark, d)), path)
    return LG.read_table(spark, path).groupBy(*KEY, "trade_date").agg(F.count("*").alias("n"), F.min("arrival").alias("first_arrival"), F.max("last_seq").alias("last_seq"))


# --- C. order and predicates -----------------------------------------------------------------------------------------


@query("c1_synthetic_sequence", f"with {EV}, r as (select *, {ROUTE.format('update')} route from ev) select venue, symbol, arrival, case when route = 'update' then count(case when route = 'update' then 1 end) over (partition by symbol order by arrival rows unbounded preceding) end seq from r")
def c1(spark: SparkSession, d: str) -> DataFrame:
    routed = FR.kraken_frames(_raw(spark, d, True), instruments(spark, d))
    return O.synthetic_sequence(routed).select(*KEY, "arrival", "seq")


@query("c2_event_routing", f"with {EV} select venue, symbol, target, count(*) n from (select *, case event_id % 5 when 0 then 'resync' when 1 then 'ignored' else 'book' end target from ev) group by all")
def c2(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id") % 5
    events = level_rows(spark, d).withColumn("kind", F.when(n == 0, "disconnect").when(n == 1, "trade").otherwise("delta"))
    return O.route_events(events).groupBy(*KEY, "target").agg(F.count("*").alias("n"))


SNAPS = "sn as (select *, case when event_id % 40 = 0 then 'snapshot' else 'update' end route from ev)"


def snapshot_log(spark: SparkSession, d: str) -> DataFrame:
    """The events of each feed as a log in which every event_id divisible by 40 is a snapshot row."""
    return level_rows(spark, d).withColumn("route", F.when(F.col("event_id") % 40 == 0, "snapshot").otherwise("update"))


@query(
    "c3_e3_in_log_snapshots",
    f"""with {EV}, {SNAPS}, n as (select *, count(case when route = 'snapshot' then 1 end) over (partition by symbol order by arrival rows unbounded preceding) segment from sn)
select venue, symbol, arrival, segment, case when route = 'snapshot' and segment > 1 then 'disconnect' when route = 'snapshot' then 'bind' else 'delta' end kind from n where segment > 0""",
)
def c3(spark: SparkSession, d: str) -> DataFrame:
    return O.rebind_on_snapshots(O.segments(snapshot_log(spark, d))).select(*KEY, "arrival", "segment", "kind")


@query(
    "c4_classify",
    f"""with {EV}, x as (select *, case when event_id % 9 = 0 then greatest(arrival - 2, 0) else arrival end last_seq, case when event_id % 9 = 0 then greatest(arrival - 3, 0) when arrival = 900 then arrival + 5 else arrival end first_seq from ev where arrival > 5),
l as (select *, greatest(5, coalesce(max(last_seq) over (partition by symbol order by arrival rows between unbounded preceding and 1 preceding), 5)) applied_before from x),
k as (select *, case when last_seq <= applied_before then 'stale' when first_seq > applied_before + 1 then 'gap' else 'apply' end k from l),
g as (select *, min(case when k = 'gap' then arrival end) over (partition by symbol) fg from k)
select venue, symbol, arrival, applied_before, case when fg is null or arrival <= fg then k end "class" from g""",
)
def c4(spark: SparkSession, d: str) -> DataFrame:
    """Updates above snapshot 5: some arrive late, one in each large feed jumps ahead."""
    n, a = F.col("event_id") % 9 == 0, F.col("arrival")
    x = level_rows(spark, d).where("arrival > 5").withColumns({"last_seq": F.when(n, F.greatest(a - 2, F.lit(0))).otherwise(a), "first_seq": F.when(n, F.greatest(a - 3, F.lit(0))).when(a == 900, a + 5).otherwise(a)})
    return O.classify(x, 5).select(*KEY, "arrival", "applied_before", "class")


@query("c5_c6_c7_checks", f"with {TOP} select venue, symbol, symbol::bigint % 3 = 0 and bid is not null and ask is not null raw_crossed, symbol::bigint % 3 = 0 and bid is not null and ask is not null view_crossed, not (symbol::bigint % 3 = 0 and bid is not null and ask is not null) ordered from best")
def c5(spark: SparkSession, d: str) -> DataFrame:
    """Checks on every user's view, a third of them with a bid put above the asks."""
    v = B.as_views(B.top(user_book(spark, d), 10).drop("rank"))
    high = F.array(F.struct(F.lit(5000).cast("bigint").alias("price"), F.lit(1).cast("bigint").alias("size")))
    v = v.withColumn("bids", F.when((F.col("symbol").cast("bigint") % 3 == 0) & (F.size("bids") > 0), F.concat(high, "bids")).otherwise(F.col("bids")))
    return v.select(*KEY, O.snapshot_crossed(F.col("bids"), F.col("asks")).alias("raw_crossed"), O.view_crossed(F.col("bids"), F.col("asks")).alias("view_crossed"), O.view_ordered(F.col("bids"), F.col("asks")).alias("ordered"))


@query("c8_drawable", f"with {TOP}, s as (select symbol, count(*) n from top group by symbol) select b.venue, b.symbol, case when symbol::bigint % 4 = 1 then null else 3 end size_scale, case when symbol::bigint % 4 = 1 or symbol::bigint % 4 = 2 and bid is not null and n > 1 then null else 3 end chart_scale from best b join s using (symbol)")
def c8(spark: SparkSession, d: str) -> DataFrame:
    """Views that can be drawn; one in four has a size of zero, another one a bid price of another scale."""
    k = F.col("symbol").cast("bigint") % 4
    v = user_views(spark, d)
    zero = F.transform("bids", lambda x: F.array(x[0], F.lit("0.000")))
    zero_asks = F.transform("asks", lambda x: F.array(x[0], F.lit("0.000")))
    odd = F.transform("bids", lambda x, i: F.when(i == 0, F.array(F.concat(x[0], F.lit("0")), x[1])).otherwise(x))
    v = v.withColumns({"bids": F.when(k == 1, zero).when(k == 2, odd).otherwise(F.col("bids")), "asks": F.when(k == 1, zero_asks).otherwise(F.col("asks"))})
    return v.select(*KEY, V.size_scale(F.col("bids"), F.col("asks")).alias("size_scale"), V.chart_scale(F.col("bids"), F.col("asks")).alias("chart_scale"))


@query("c9_only_new", f"with {EV}, g as (select *, arrival - case when event_id % 6 = 0 then 4 else 0 end gen from ev), m as (select *, max(gen) over (partition by symbol order by arrival rows between unbounded preceding and 1 preceding) t from g) select venue, symbol, arrival, gen from m where t is null or gen > t")
def c9(spark: SparkSession, d: str) -> DataFrame:
    v = level_rows(spark, d).select(*KEY, "arrival", (F.col("arrival") - F.when(F.col("event_id") % 6 == 0, 4).otherwise(0)).alias("gen"))
    return O.only_new(v)


# --- D. books --------------------------------------------------------------------------------------------------------


@query(
    "d1_build",
    f"""with {EV}, s as (select *, (arrival - 1) // 50 snap_ord, (arrival - 1) % 50 pos from ev), b as (select venue, symbol, snap_ord, snap_ord * 50 last_update_id, side, price, arg_max(size, pos) size from s group by all) select * from b where size > 0""",
)
def d1(spark: SparkSession, d: str) -> DataFrame:
    """Every 50 events of a feed as one raw snapshot, with repeated prices and zero sizes."""
    rows = level_rows(spark, d).withColumn("snap_ord", F.expr("(arrival - 1) div 50"))
    pick = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("arrival", "price", "size")))), lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size")))
    snaps = rows.groupBy(*KEY, "snap_ord").agg(pick("bid").alias("bids"), pick("ask").alias("asks")).withColumn("last_update_id", F.col("snap_ord") * 50)
    return B.build(snaps)


@query("d2_latest_book", f"with {EV}, {LAST} select venue, symbol, side, price, size from book")
def d2(spark: SparkSession, d: str) -> DataFrame:
    return B.latest(B.delta_levels(as_events(level_rows(spark, d))))


@query("d2_book_as_of", f"with {EV}, lv as (select venue, symbol, side, price, arg_max(size, arrival) size from ev where arrival <= 200 group by all) select * from lv where size > 0")
def d2_as_of(spark: SparkSession, d: str) -> DataFrame:
    return B.latest(B.delta_levels(as_events(level_rows(spark, d))), F.col("ord.arrival") <= 200)


@query("d3_best", f"with {EVU}, {LAST} select venue, symbol, max(case when side = 'bid' then price end) bid, arg_max(size, case when side = 'bid' then price end) bid_size, min(case when side = 'ask' then price end) ask, arg_min(size, case when side = 'ask' then price end) ask_size from book group by all")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return B.best(user_book(spark, d))


@query("d4_top", f"with {TOP} select venue, symbol, side, price, size, rank from top")
def d4(spark: SparkSession, d: str) -> DataFrame:
    return B.top(user_book(spark, d), 10)


@query(
    "d5_windowed_feeds",
    f"""with recursive {EVU}, wb as (select symbol, 0::bigint arrival, []::struct(price bigint, size bigint)[] bids, []::struct(price bigint, size bigint)[] asks from (select distinct symbol from ev)
union all select w.symbol, m.arrival, case when side = 'bid' then list_slice(list_reverse_sort(list_concat(list_filter(w.bids, lambda x: x.price != m.price), case when m.size > 0 then [{{'price': m.price, 'size': m.size}}] else [] end)), 1, 2 + m.symbol::bigint % 3) else w.bids end,
 case when side = 'ask' then list_slice(list_sort(list_concat(list_filter(w.asks, lambda x: x.price != m.price), case when m.size > 0 then [{{'price': m.price, 'size': m.size}}] else [] end)), 1, 2 + m.symbol::bigint % 3) else w.asks end
 from wb w join ev m on m.symbol = w.symbol and m.arrival = w.arrival + 1)
select 'EVT' venue, symbol, arrival, array_to_string(list_transform(bids, lambda x: x.price::varchar || ':' || x.size::varchar), ' ') bids, array_to_string(list_transform(asks, lambda x: x.price::varchar || ':' || x.size::varchar), ' ') asks from wb where arrival > 0""",
)
def d5(spark: SparkSession, d: str) -> DataFrame:
    """Every view of user feeds that carry the two to four best levels only: what falls out of a window never comes back."""
    rows = level_rows(spark, d, "user_id")
    windows = rows.select(*KEY).distinct().withColumn("max_depth", (2 + F.col("symbol").cast("bigint") % 3).cast("int"))
    v = R.views(R.replay(as_events(rows), empty_snapshots(rows), R.Options(depth=10), windows))
    text = lambda side: F.array_join(F.transform(side, lambda x: F.concat_ws(":", x["price"].cast("string"), x["size"].cast("string"))), " ")
    return v.where("gen > 1").select(*KEY, "arrival", text("bids").alias("bids"), text("asks").alias("asks"))


@query("d6_snapshot", f"with {EVU}, lv as (select venue, symbol, side, price, arg_max(size, arrival) size from ev where arrival <= 40 group by all), b as (select * from lv where size > 0) select venue, symbol, 40 last_update_id, {str_list('''string_agg(case when side = 'bid' then price || ':' || size end, ' ' order by -price)''')} bids, {str_list('''string_agg(case when side = 'ask' then price || ':' || size end, ' ' order by price)''')} asks from b group by venue, symbol")
def d6(spark: SparkSession, d: str) -> DataFrame:
    s = B.as_snapshot(B.delta_levels(as_events(level_rows(spark, d, "user_id"))), 40)
    text = lambda side: F.array_join(F.transform(side, lambda x: F.concat_ws(":", x["price"].cast("string"), x["size"].cast("string"))), " ")
    return s.select(*KEY, "last_update_id", text("bids").alias("bids"), text("asks").alias("asks"))


@query(
    "d7_coalesce_deltas",
    f"""with {EV}, b as (select *, (arrival - 1) // 20 batch from ev), m as (select venue, symbol, batch, side, price, arg_max(size, arrival) size, min(arrival) fst from b group by all), i as (select venue, symbol, batch, min(arrival) first_seq, max(arrival) last_seq from b group by all)
select i.*, {str_list('''string_agg(case when side = 'bid' then price || ':' || size end, ' ' order by fst)''')} bids, {str_list('''string_agg(case when side = 'ask' then price || ':' || size end, ' ' order by fst)''')} asks from i join m using (venue, symbol, batch) group by all""",
)
def d7(spark: SparkSession, d: str) -> DataFrame:
    out = B.coalesce_deltas(as_events(level_rows(spark, d)), F.expr("(arrival - 1) div 20"))
    text = lambda side: F.array_join(F.transform(side, lambda x: F.concat_ws(":", x["price"].cast("string"), x["size"].cast("string"))), " ")
    return out.select(*KEY, "batch", "first_seq", "last_seq", text("bids").alias("bids"), text("asks").alias("asks"))


@query(
    "d8_d9_checksum",
    f"""with recursive bits as (select 0 i, range(0, 256)::bigint[] v union all select i + 1, list_transform(v, lambda x: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) from bits where i < 8), crc as (select v from bits where i = 8), {TOP},
t as (select venue, symbol, coalesce(string_agg(case when side = 'ask' then price::varchar || size::varchar end, '' order by rank), '') || coalesce(string_agg(case when side = 'bid' then price::varchar || size::varchar end, '' order by rank), '') t from top group by venue, symbol),
c as (select venue, symbol, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(t, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a // 256, crc.v[((xor(a, b) & 255) + 1)::int])), 4294967295) c from t, crc)
select venue, symbol, c + case when symbol::bigint % 3 = 0 then 1 else 0 end checksum, symbol::bigint % 3 != 0 checksum_ok from c""",
)
def d8(spark: SparkSession, d: str) -> DataFrame:
    """CRC32 of every user's view, and its check against a published value that is wrong for every third feed."""
    v = B.as_views(user_book(spark, d))
    v = v.withColumn("checksum", B.checksum(F.col("bids"), F.col("asks")) + F.when(F.col("symbol").cast("bigint") % 3 == 0, 1).otherwise(0))
    return B.verify_checksum(v).select(*KEY, "checksum", "checksum_ok")


@query("d10_convergence", f"with {EV} select 'EVT' venue, symbol, 0 wrong, count(*) levels from (select symbol, side, price, arg_max(size, arrival) size from ev group by all) where size > 0 group by symbol")
def d10(spark: SparkSession, d: str) -> DataFrame:
    """Levels in which the replayed books differ from the aggregated ones: none, of so many."""
    rows = level_rows(spark, d)
    book = B.latest(B.delta_levels(as_events(rows)))
    out = R.replay(as_events(rows), empty_snapshots(rows), R.Options(depth=10**6, views_every=0))
    last = R.views(out).withColumn("snap_ord", F.lit(0)).withColumn("last_update_id", F.col("last_seq"))
    replayed = B.snapshot_levels(last).select(*KEY, "side", "price", "size")
    wrong = B.differences(replayed, book).groupBy(*KEY).agg(F.count("*").alias("wrong"))
    return book.groupBy(*KEY).agg(F.count("*").alias("levels")).join(wrong, KEY, "left").select(*KEY, F.coalesce("wrong", F.lit(0).cast("bigint")).alias("wrong"), "levels")


# --- tables as streams -----------------------------------------------------------------------------------------------


def streamed(out: DataFrame, mode: str) -> DataFrame:
    """All batches of a stream that reads what is there now, as a table with their number in `batch`."""
    spark, sink = out.sparkSession, shared_path(out.sparkSession, "stream-out")

    def keep(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    job = out.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", shared_path(spark, "stream-state"))
    job.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


def as_stream(df: DataFrame, files: int) -> DataFrame:
    """A stream of a table's rows, a file at a time."""
    path = shared_path(df.sparkSession, "stream-in")
    df.repartition(files).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


#: Rows of a feed that a micro-batch takes, about: a stream's processor has them at once. And those that a file of it holds,
#: of a recording's lines, which take longer to decode, fewer.
FEED_ROWS, FILE_ROWS, FILE_LINES = 400_000, 500_000, 50_000


def in_order(df: DataFrame, at: str, batches: int = 3, feed_rows: int = FEED_ROWS, file_rows: int = FILE_ROWS) -> DataFrame:
    """A stream of a table's rows in micro-batches, each of a part of the range of `at`, in its order; more of them than
    asked for where a feed has more rows than so many batches may take, so that a batch is no larger for a longer log."""
    spark, path, parts = df.sparkSession, shared_path(df.sparkSession, "stream-in"), shared_path(df.sparkSession, "stream-parts")
    log = written(df, "stream-log")
    low, high, most = log.groupBy(*KEY).agg(F.min(at).alias("low"), F.max(at).alias("high"), F.count("*").alias("n")).agg(F.min("low"), F.max("high"), F.max("n")).first()
    width = -(-(high + 1 - low) // max(batches, -(-most // feed_rows)))
    dealt = log.withColumn("_part", F.expr(f"({at} - {low}) div {width}")).where("_part is not null")
    sizes = {r["_part"]: r["count"] for r in dealt.groupBy("_part").count().collect()}
    files = {part: -(-n // file_rows) for part, n in sizes.items()}
    # a part is dealt to as many tasks as it has files, else few parts of a long log meet in as few tasks
    share = F.pmod(F.xxhash64(*KEY, at), F.lit(max(files.values())))
    dealt.repartition("_part", share).write.partitionBy("_part").parquet(parts)
    for part in sorted(files):  # the older the earlier; empty files fill up, as a batch takes a number of files
        own = spark.read.schema(df.schema).parquet(f"{parts}/_part={part}")
        for rows in (own.repartition(files[part]), *[own.limit(0)] * (max(files.values()) - files[part])):
            rows.write.mode("append").parquet(path)
    drop_written(log)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(files.values())).parquet(path)


def recording(spark: SparkSession, d: str, batches: int = 3, feed_rows: int = FEED_ROWS) -> DataFrame:
    """A stream of recorded lines in micro-batches, so many or more for a longer log (see in_order): the raw frames of the
    events with the answer of an empty book at each feed's head, and a torn line in each part."""
    frames = _raw(spark, d, False).withColumn("type", F.lit("frame"))
    head = frames.select(*KEY).distinct().select(*KEY, F.lit(0).cast("bigint").alias("arrival"), F.lit(0).cast("bigint").alias("received_ns"), F.lit('{"lastUpdateId":0,"bids":[],"asks":[]}').alias("raw"), F.lit("snapshot").alias("type"))
    log = written(frames.unionByName(head).select(*KEY, "arrival", F.to_json(F.struct(*KEY, "arrival", "received_ns", "type", "raw")).alias("value")), "recording")
    n = log.agg(F.max("arrival")).first()[0] + 1
    none = F.lit(None).cast("string")
    torn = spark.range(0, n, -(-n // max(batches, -(-n // feed_rows)))).select(none.alias("venue"), none.alias("symbol"), F.col("id").alias("arrival"), F.lit('{"venue":"EVT","symb').alias("value"))
    stream = in_order(log.unionByName(torn), "arrival", batches, feed_rows, FILE_LINES)
    drop_written(log)
    return stream.select("value")


@query(
    "a1_a13_ingest_stream",
    f"""with {EV}, r as (select *, {ROUTE.format('update')} route from ev),
m as (select symbol, min(case when route != 'update' then arrival end) lost, max(case when route = 'update' then arrival end) newest, count(case when route = 'update' then 1 end) events, count(case when route = 'rejected' then 1 end) rejects from r group by symbol)
select 'EVT' venue, symbol, events, rejects, 1 snapshots, case when lost is null then events else lost - 1 end + 1 views, (coalesce(newest > lost, false))::bigint faults from m""",
)
def a13_stream(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the canonical tables of every feed after two streams over its recorded lines, in three micro-batches or more each:
    all books end at the first frame that could not be used, as no second snapshot is there."""
    text, tables = recording(spark, d), IN.Tables(spark, shared_path(spark, "canonical"))
    windows = written(instruments(spark, d), "instruments")
    for job, start in (("ingest", IN.ingest), ("replay", IN.replayed)):
        start(text, windows, tables, shared_path(spark, f"{job}-state")).awaitTermination()
    count = lambda job, name, alias: tables.read(job, name).where("symbol is not null").groupBy(*KEY).agg(F.count("*").alias(alias))
    out = count("ingest", "feed_events", "events")
    for job, name in (("ingest", "rejects"), ("ingest", "snapshots"), ("replay", "views"), ("replay", "faults")):
        out = out.join(count(job, name, name), KEY, "left")
    return out.fillna(0)


# --- E. replay -------------------------------------------------------------------------------------------------------


@query("e1_replay", f"with {EV}, {LAST} select venue, symbol, max(arrival) + 1 gens, max(arrival) applied, 0 gaps, 0 resyncs, 'ok' state, max(bb) bid, max(ba) ask from ev join (select symbol, max(case when side = 'bid' then price end) bb, min(case when side = 'ask' then price end) ba from book group by symbol) using (symbol) group by venue, symbol")
def e1(spark: SparkSession, d: str) -> DataFrame:
    """Clean feeds replayed from empty books: counters, generations, and the best prices at the end."""
    rows = level_rows(spark, d)
    out = written(R.replay(as_events(rows), empty_snapshots(rows), R.Options(views_every=0)), "replay")
    last = R.views(out).select(*KEY, F.col("bids")[0]["price"].alias("bid"), F.col("asks")[0]["price"].alias("ask"))
    return R.counters(out).join(R.status(out), KEY).join(last, KEY).select(*KEY, "gens", "applied", "gaps", "resyncs", "state", "bid", "ask")


@query("e1_replay_stretches", SQL["e1_replay"])
def e1_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The same feeds by stretches of 2,000 arrivals, folded side by side."""
    rows = level_rows(spark, d)
    log = written(as_events(rows).drop("event_id"), "log")
    out = ST.replay_stretches(log, empty_snapshots(rows), R.Options(views_every=0), 2000)
    last = R.views(out).select(*KEY, F.col("bids")[0]["price"].alias("bid"), F.col("asks")[0]["price"].alias("ask"))
    return R.counters(out).join(R.status(out), KEY).join(last, KEY).select(*KEY, "gens", "applied", "gaps", "resyncs", "state", "bid", "ask")


@query("e1_stream_replay", SQL["e1_replay"])
def e1_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same feeds through the streaming replay, with an empty snapshot at the head of each feed's log, in three
    micro-batches that hand on books and counters."""
    rows = level_rows(spark, d)
    log = headed(rows)
    use_rocksdb(spark)
    out = streamed(replay_stream(in_order(log, "arrival"), None, R.Options(policy="in_log", views_every=0), hot=True), "append")
    newest = lambda df, at: df.groupBy(*KEY).agg(F.max_by(F.struct(*[c for c in df.columns if c not in KEY]), at).alias("x")).select(*KEY, "x.*")
    last = newest(R.views(out), "gen").select(*KEY, F.col("bids")[0]["price"].alias("bid"), F.col("asks")[0]["price"].alias("ask"))
    closing = out.where("what = 'end'").groupBy(*KEY).agg(F.max_by(F.struct("kind", "counters", "n"), "n").alias("x"))
    at = {c: F.col("x.counters")[i] for i, c in enumerate(COUNTER_NAMES)}
    counts = closing.select(*KEY, F.col("x.n").alias("gens"), F.col("x.counters")[len(COUNTER_NAMES)].alias("applied"), at["gaps"].alias("gaps"), at["resyncs"].alias("resyncs"), F.col("x.kind").alias("state"))
    return counts.join(last, KEY)


def headed(rows: DataFrame) -> DataFrame:
    """feed_events of level rows with an empty snapshot at the head of each feed."""
    none = F.array().cast(LEVELS)
    head = empty_snapshots(rows).select(*KEY, "arrival", F.lit(0).cast("bigint").alias("received_ns"), F.lit("snapshot").alias("kind"), F.col("last_update_id").alias("first_seq"), F.col("last_update_id").alias("last_seq"), none.alias("bids"), none.alias("asks"), "checksum")
    return as_events(rows).drop("event_id").unionByName(head)


@query("d5_windows_stream", SQL["d5_windowed_feeds"])
def d5_stream(spark: SparkSession, d: str) -> DataFrame:
    """Views of feeds with windows of their own by the streaming replay, in three micro-batches."""
    rows = level_rows(spark, d, "user_id")
    windows = rows.select(*KEY).distinct().withColumn("max_depth", (2 + F.col("symbol").cast("bigint") % 3).cast("int"))
    use_rocksdb(spark)
    v = R.views(streamed(replay_stream(in_order(headed(rows), "arrival"), None, R.Options(policy="in_log", depth=10), windows), "append"))
    text = lambda side: F.array_join(F.transform(side, lambda x: F.concat_ws(":", x["price"].cast("string"), x["size"].cast("string"))), " ")
    return v.where("gen > 1").select(*KEY, "arrival", text("bids").alias("bids"), text("asks").alias("asks"))


@query("e1_replay_views", f"""with {EVU}, n as (select a.symbol, a.arrival, b.side, b.price, b.size, b.arrival wrote from ev a join ev b on a.symbol = b.symbol and b.arrival <= a.arrival),
l as (select symbol, arrival, side, price, arg_max(size, wrote) size from n group by all), v as (select * from l where size > 0)
select 'EVT' venue, symbol, arrival, arrival + 1 gen, max(case when side = 'bid' then price end) bid, min(case when side = 'ask' then price end) ask from v group by symbol, arrival""")
def e1_views(spark: SparkSession, d: str) -> DataFrame:
    """Best prices after every update of every user's feed."""
    rows = level_rows(spark, d, "user_id")
    v = R.views(R.replay(as_events(rows), empty_snapshots(rows), R.Options(depth=1)))
    best = lambda side: F.get(side, F.lit(0))["price"]
    return v.where("arrival > 0 and gen > 1").select(*KEY, "arrival", "gen", best(F.col("bids")).alias("bid"), best(F.col("asks")).alias("ask")).where("bid is not null or ask is not null")


def windowed_log(spark: SparkSession, d: str) -> DataFrame:
    """A log with snapshot rows in it: at every 40th event a snapshot of the two bands' outer levels, some of them crossed.

    Between snapshots the feed drops some updates, so that gaps occur.
    """
    rows = snapshot_log(spark, d)
    lv = lambda p, s: F.array(F.struct(F.lit(p).cast("bigint").alias("price"), F.lit(s).cast("bigint").alias("size")))
    e = as_events(rows).join(rows.select(*KEY, "arrival", "route", F.col("event_id").alias("n")), [*KEY, "arrival"])
    e = e.withColumn("_bad", (F.col("route") == "snapshot") & (F.col("n") % 160 == 0))
    snap = F.col("route") == "snapshot"
    e = e.withColumns({"bids": F.when(snap, F.when(F.col("_bad"), lv(3000, 1)).otherwise(lv(1, 5))).otherwise(F.col("bids")), "asks": F.when(snap, lv(2500, 5)).otherwise(F.col("asks")), "kind": F.when(snap, "snapshot").otherwise("delta")})
    return e.where(snap | (F.col("n") % 31 != 0)).drop("_bad", "route", "n", "event_id")


@query("e2_bind_points", f"""with {EVU}, s as (select symbol, snap_ord, snap_ord * 13 id from (select distinct symbol from ev), range(1, 5) t(snap_ord)), x as (select * from ev where arrival % 14 != 0)
select 'EVT' venue, s.symbol, snap_ord, id last_update_id, min(x.arrival) bind_arrival, min(x.arrival) <= id + 1 covers from s left join x on x.symbol = s.symbol and x.arrival > id group by s.symbol, snap_ord, id""")
def e2(spark: SparkSession, d: str) -> DataFrame:
    """Where snapshots at every 13th id bind to a feed that lacks every 14th update."""
    rows = level_rows(spark, d, "user_id")
    snaps = rows.select(*KEY).distinct().withColumn("snap_ord", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("last_update_id", (F.col("snap_ord") * 13).cast("bigint"))
    deltas = as_events(rows).where("arrival % 14 != 0")
    return R.bind_points(snaps.withColumn("snap_ord", F.col("snap_ord").cast("bigint")), deltas)


# the segments of windowed_log: sg its rows, st a row a segment with its first gap (or {0}), whether a snapshot came
# that nobody asked for, and when the next snapshot binds
SEGMENTS = """lg as (select venue, symbol, arrival, event_id, received_ns // 1000000 ms, event_id % 40 = 0 snap, event_id % 160 = 0 bad from ev where event_id % 40 = 0 or event_id % 31 != 0),
sg as (select *, count(case when snap then 1 end) over (partition by symbol order by arrival rows unbounded preceding) seg, lag(arrival) over (partition by symbol order by arrival) prev from lg),
fb as (select symbol, seg, min(arrival) g from sg where seg > 0 and not snap and (prev != arrival - 1{0}) group by all),
se as (select sg.symbol, sg.seg, arrival head, ms head_ms, bad, case when not bad then g end g from sg left join fb on fb.symbol = sg.symbol and fb.seg = sg.seg where snap),
st as (select *, coalesce(lag(not bad) over w and lag(g) over w is null, false) lost, first_value(case when not bad then head_ms end ignore nulls) over (partition by symbol order by seg rows between 1 following and unbounded following) next_ms from se window w as (partition by symbol order by seg))"""


@query(
    "e3_segmented_replay",
    f"""with {EV}, {SEGMENTS.format('')}, fl as (
select symbol, head arrival, 0 o, 'disconnect' kind, head_ms at_ms, 0 expected_seq, 0 got_seq, 'source disconnected' reason, case when not bad then 0 when next_ms is null then -1 else greatest(0, next_ms - head_ms) end duration_ms from st where lost
union all select symbol, head, 1, 'snapshot-reject', head_ms, 0, head, 'snapshot crossed', 0 from st where bad
union all select st.symbol, g, 0, 'gap', ms, prev + 1, g, 'sequence gap', case when next_ms is null then -1 else greatest(0, next_ms - ms) end from st join sg on sg.symbol = st.symbol and sg.arrival = st.g)
select 'EVT' venue, symbol, row_number() over (partition by symbol order by arrival, o) id, kind, at_ms, expected_seq, got_seq, reason, duration_ms, arrival from fl""",
)
def e3(spark: SparkSession, d: str) -> DataFrame:
    """Feeds with snapshots in their log, replayed a segment at a time and stitched: faults of all feeds in order."""
    out = R.replay_segments(windowed_log(spark, d), R.Options(policy="in_log", views_every=0))
    return R.faults(out)


@query(
    "e1_faulted_replay",
    f"""with {EV}, {SEGMENTS.format(' or event_id % 53 = 0')},
ap as (select st.symbol, st.seg, count(case when not st.bad and not snap and (g is null or arrival < g) then 1 end) applied, bool_or(arrival = g and prev != arrival - 1) gap, bool_or(arrival = g and prev = arrival - 1) crosses from st join sg on sg.symbol = st.symbol and sg.seg = st.seg group by all)
select 'EVT' venue, symbol, sum(coalesce(gap, false)::int)::bigint gaps, sum(coalesce(crosses, false)::int)::bigint would_crosses, sum(lost::int)::bigint disconnects, sum(coalesce(gap, false)::int + coalesce(crosses, false)::int + lost::int)::bigint resyncs, sum(bad::int)::bigint snapshot_rejects, sum(applied)::bigint applied, sum(applied + (not bad)::int)::bigint gens, case when arg_max(not bad and g is null, seg) then 'ok' else 'waiting' end state from st join ap using (symbol, seg) group by symbol""",
)
def e1_faulted(spark: SparkSession, d: str) -> DataFrame:
    """Counters and status of feeds with gaps, crossing updates, crossed snapshots and lost connections."""
    log = windowed_log(spark, d).join(level_rows(spark, d).select(*KEY, "arrival", (F.col("event_id") % 53 == 0).alias("_x")), [*KEY, "arrival"])
    high = F.array(F.struct(F.lit(3000).cast("bigint").alias("price"), F.lit(1).cast("bigint").alias("size")))
    log = log.withColumn("bids", F.when(F.col("_x") & (F.col("kind") == "delta"), high).otherwise(F.col("bids"))).drop("_x")
    out = written(R.replay(log, None, R.Options(policy="in_log", views_every=0)), "faulted")
    return R.counters(out).join(R.status(out), KEY).select(*KEY, "gaps", "would_crosses", "disconnects", "resyncs", "snapshot_rejects", "applied", "gens", "state")


@query(
    "e4_e5_e6_limits",
    f"""with {EVU}, u as (select venue, symbol, count(*) n, symbol::bigint % 4 k from ev group by all)
select venue, symbol, case when k = 1 then 'snapshot_refused' when k = 2 then 'snapshot_failed' when k = 3 and n >= 17 then 'stale_snapshot' else 'ok' end state, case when k = 1 then 'snapshot crossed' when k = 2 then 'snapshot failed' when k = 3 and n >= 17 then 'resyncs without an applied update' end reason,
case when k = 3 then least(n, 17) else 0 end gaps, case when k = 3 then least(n, 17) else 0 end resyncs, case when k = 1 then 8 else 0 end snapshot_rejects, case when k = 2 then 4 else 0 end snapshot_errors, case when k = 0 then n + 1 when k = 3 then least(n, 16) + 1 else 0 end gens from u""",
)
def e4(spark: SparkSession, d: str) -> DataFrame:
    """Status and counters of feeds whose queued snapshots fail, are crossed, or are too old, by user."""
    rows = level_rows(spark, d, "user_id")
    k = F.col("symbol").cast("bigint") % 4
    lv = lambda p: F.array(F.struct(F.lit(p).cast("bigint").alias("price"), F.lit(1).cast("bigint").alias("size")))
    none = F.array().cast(LEVELS)
    feeds = rows.select(*KEY).distinct().withColumn("snap_ord", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(20).cast("bigint"))))
    snaps = feeds.select(*KEY, "snap_ord", F.lit(0).cast("bigint").alias("last_update_id"), F.when(k == 1, lv(5000)).otherwise(none).alias("bids"), F.when(k == 1, lv(100)).otherwise(none).alias("asks"), F.lit(None).cast("bigint").alias("checksum"), F.when((k == 2) & (F.col("snap_ord") < 3), "transient").when((k == 2) & (F.col("snap_ord") == 3), "permanent").alias("error"))
    events = as_events(rows).withColumns({"first_seq": F.when(k == 3, F.col("first_seq") + 100).otherwise(F.col("first_seq")), "last_seq": F.when(k == 3, F.col("last_seq") + 100).otherwise(F.col("last_seq"))})
    out = written(R.replay(events, snaps, R.Options(views_every=0)), "limits")
    return R.counters(out).join(R.status(out), KEY).select(*KEY, "state", "reason", "gaps", "resyncs", "snapshot_rejects", "snapshot_errors", "gens")


@query("e7_recovery", f"""with {EV}, {FAULTS}, bd as (select symbol, arrival, received_ns // 1000000 at_ms from ev where event_id % 11 = 0), j as (select f.venue, f.symbol, f.id, f.at_ms, min(b.arrival) ba from fl f left join bd b on b.symbol = f.symbol and b.arrival >= f.arrival group by all)
select j.venue, j.symbol, id, case when b.at_ms is null then -1 else greatest(0, b.at_ms - j.at_ms) end duration_ms from j left join bd b on b.symbol = j.symbol and b.arrival = j.ba""")
def e7(spark: SparkSession, d: str) -> DataFrame:
    binds = level_rows(spark, d).where("event_id % 11 = 0").select(*KEY, "arrival", F.expr("received_ns div 1000000").alias("at_ms"))
    return R.recovery(fault_log(spark, d), binds)


@query("e8_newest_faults", f"with {EV}, {FAULTS}, r as (select *, row_number() over (partition by symbol order by id desc) rn from fl) select venue, symbol, id, kind from r where rn <= 16")
def e8(spark: SparkSession, d: str) -> DataFrame:
    return R.newest_faults(fault_log(spark, d)).select(*KEY, "id", "kind")


COUNTS_SQL = f"""ct as (select venue, symbol, count(case when kind = 'gap' then 1 end) gaps, count(case when kind in {REBUILD} then 1 end) resyncs, count(case when kind = 'disconnect' then 1 end) disconnects, count(case when kind = 'cross' then 1 end) would_crosses,
 count(case when kind = 'checksum' or reason = 'snapshot checksum mismatch' then 1 end) checksum_mismatches, count(case when kind = 'snapshot-reject' then 1 end) snapshot_rejects, count(case when kind = 'snapshot-error' then 1 end) snapshot_errors, (select count(*) from ev e where e.symbol = fl.symbol and e.event_id % 53 != 0 and (e.event_id % 50 = 0 or e.event_id % 47 = 0)) rejected from fl group by venue, symbol)"""


def counter_rows(spark: SparkSession, d: str) -> DataFrame:
    rejects = FR.rejects(FR.binance_frames(_raw(spark, d, False), instruments(spark, d)))
    return R.count_faults(fault_log(spark, d), rejects)


@query("e9_counters", f"with {EV}, {FAULTS}, {COUNTS_SQL} select * from ct")
def e9(spark: SparkSession, d: str) -> DataFrame:
    return counter_rows(spark, d)


@query("e9_counters_rollup", f"with {EV}, {FAULTS}, {COUNTS_SQL} select venue, " + ", ".join(f"sum({c})::bigint {c}" for c in COUNTER_NAMES) + " from ct group by rollup (venue)")
def e9_rollup(spark: SparkSession, d: str) -> DataFrame:
    return R.counters_by_venue(counter_rows(spark, d))


@query("e10_generations", f"with {EV} select venue, symbol, arrival, row_number() over (partition by symbol order by arrival) gen from ev where event_id % 4 != 0")
def e10(spark: SparkSession, d: str) -> DataFrame:
    return R.generations(level_rows(spark, d).where("event_id % 4 != 0").select(*KEY, "arrival"))


@query("e11_downtime", f"with {EV}, {FAULTS}, r as (select venue, symbol, id, at_ms from_ms, case when duration_ms >= 0 then at_ms + duration_ms end to_ms from fl where kind in {REBUILD}) select *, (sum(to_ms - from_ms) over (partition by symbol))::bigint down_ms from r")
def e11(spark: SparkSession, d: str) -> DataFrame:
    return R.downtime(fault_log(spark, d))


@query("e12_last_event_age", f"with {EV} select venue, symbol, max(received_ns // 1000000) last_event_ms, greatest(0, 1704153600000 - max(received_ns // 1000000)) age_ms from ev group by all")
def e12(spark: SparkSession, d: str) -> DataFrame:
    return R.last_event_age(as_events(level_rows(spark, d)), 1704153600000)


def faulted(spark: SparkSession, d: str, **options: int) -> DataFrame:
    """Replays of the feeds under scheduled faults, by stretches."""
    return scheduled_replay(scheduled(spark, d), depth=1, **options)


def scheduled(spark: SparkSession, d: str) -> DataFrame:
    """The feeds' updates with their scheduled fault, as a written table."""
    return written(as_events(level_rows(spark, d)).withColumn("fault", I.scheduled_fault(F.lit(1).cast("bigint"), F.col("arrival") - 1)), "scheduled")


def scheduled_replay(rows: DataFrame, stretch: int = ST.STRETCH, **options: int) -> DataFrame:
    """The replay of scheduled() rows, a stretch at a time, as a written table: no snapshot is in the log, all come on request."""
    log = written(I.inject(rows, F.col("fault")), "log")
    out = ST.replay_stretches(log, None, R.Options(policy="as_of", **options), stretch)
    drop_written(log)
    return out


@query(
    "e13_log_line",
    f"""with {EV}, {chaos.VIEWS} select pv.venue, pv.symbol, gen, pv.seq, case when bid is null then '-' else {px('bid')} || ' x ' || {sz('bid_size')} end bid, case when ask is null then '-' else {px('ask')} || ' x ' || {sz('ask_size')} end ask from pv left join bs on bs.symbol = pv.symbol and bs.seq = pv.seq where gen % 50 = 0""",
)
def e13(spark: SparkSession, d: str) -> DataFrame:
    """Top-of-book log line of every 50th view of replays under faults."""
    v = R.views(faulted(spark, d, views_every=50)).where("gen % 50 = 0")
    level = lambda x: F.concat(S.format_scaled(x["price"], PRICE_SCALE), F.lit(" x "), S.format_scaled(x["size"], SIZE_SCALE))
    best = lambda side: F.coalesce(level(F.get(side, F.lit(0))), F.lit("-"))
    return v.select(*KEY, "gen", F.col("last_seq").alias("seq"), best(F.col("bids")).alias("bid"), best(F.col("asks")).alias("ask"))


@query(
    "e13_e14_best_series",
    f"""with {EV}, {chaos.VIEWS} select pv.venue, pv.symbol, arrival, gen, bid, ask, mark fault, bid >= ask is_crossed, count(case when bid >= ask then 1 end) over (partition by pv.symbol) crossed, {px('bid')} bid_text, {px('ask')} ask_text from pv join bs on bs.symbol = pv.symbol and bs.seq = pv.seq where bid is not null and ask is not null""",
)
def e14(spark: SparkSession, d: str) -> DataFrame:
    """Best prices at every two-sided view of replays under faults, with the faults' places, and each feed's count of
    crossed states over all of them: none."""
    out = faulted(spark, d)
    series = R.count_crossed(R.best_series(R.views(out), R.faults(out)))
    return series.withColumns({"bid_text": S.format_scaled(F.col("bid"), PRICE_SCALE), "ask_text": S.format_scaled(F.col("ask"), PRICE_SCALE)})


# --- F. fault injection ----------------------------------------------------------------------------------------------


@query(
    "f1_f4_chaos_counters",
    f"""with {EV}, {chaos.SCHEDULE}, k as (select venue, symbol, count(case when fault in ('gap', 'reorder') then 1 end) gaps, count(case when fault in ('gap', 'reorder') and arrival < n then 1 end) seen, count(case when fault = 'disconnect' then 1 end) d, count(case when fault = 'cross' then 1 end) x from fa group by all)
select venue, symbol, gaps, gaps + d + x resyncs, d disconnects, x would_crosses, 0 snapshot_rejects, seen got_gaps, seen + d + x got_resyncs, d got_disconnects, x got_would_crosses, 0 got_snapshot_rejects from k""",
)
def f1(spark: SparkSession, d: str) -> DataFrame:
    """Counters that the schedule calls for beside those of a replay under it: equal for every feed, but for a gap at a
    feed's end, which nothing comes after to show."""
    rows = scheduled(spark, d)
    out = scheduled_replay(rows, views_every=0)
    want = I.expected_counters(rows)
    got = R.counters(out).select(*KEY, *[F.col(c).alias(f"got_{c}") for c in ("gaps", "resyncs", "disconnects", "would_crosses", "snapshot_rejects")])
    return want.join(got, KEY)


@query("e1_faulted_stretches", SQL["f1_f4_chaos_counters"])
def e1_faulted_stretches(spark: SparkSession, d: str) -> DataFrame:
    """The same by stretches of 2,000 arrivals, all of which have faults."""
    rows = scheduled(spark, d)
    out = scheduled_replay(rows, 2000, views_every=0)
    got = R.counters(out).select(*KEY, *[F.col(c).alias(f"got_{c}") for c in ("gaps", "resyncs", "disconnects", "would_crosses", "snapshot_rejects")])
    return I.expected_counters(rows).join(got, KEY)


@query(
    "f2_inject",
    f"""with {EV}, f as (select *, case when event_id % 97 = 0 then 'gap' when event_id % 101 = 0 then 'duplicate' when event_id % 103 = 0 then 'reorder' when event_id % 199 = 0 then 'disconnect' when event_id % 211 = 0 then 'cross' else '' end fault from ev),
x as (select venue, symbol, arrival step, arrival a, -1 b, 'disconnect' kind, 0 first_seq from f where fault = 'disconnect' union all select venue, symbol, arrival, arrival, -1, 'delta', arrival from f where fault = 'cross'
union all select venue, symbol, arrival, arrival, 1, 'delta', arrival from f where fault not in ('gap', 'reorder') union all select venue, symbol, arrival, arrival, 2, 'delta', arrival from f where fault = 'duplicate' union all select venue, symbol, arrival, arrival + 1, 3, 'delta', arrival from f where fault = 'reorder')
select venue, symbol, row_number() over (partition by symbol order by a, b) arrival, kind, first_seq, step from x""",
)
def f2(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    fault = F.when(n % 97 == 0, "gap").when(n % 101 == 0, "duplicate").when(n % 103 == 0, "reorder").when(n % 199 == 0, "disconnect").when(n % 211 == 0, "cross")
    return I.inject(as_events(level_rows(spark, d)), fault, with_truth=False).select(*KEY, "arrival", "kind", "first_seq", "step")


@query("f3_bad_snapshots", f"with {TOP} select 'EVT' venue, symbol, case when ask is null then bid else ask end best_bid, bid is not null and ask is not null or ask is not null crossed from best")
def f3(spark: SparkSession, d: str) -> DataFrame:
    """Every user's final book as a snapshot with a bid at its best ask: crossed wherever there is an ask."""
    v = B.as_views(user_book(spark, d))
    c = I.crossing_snapshots(v)
    return c.select(*KEY, F.get("bids", F.lit(0))["price"].alias("best_bid"), O.snapshot_crossed(F.col("bids"), F.col("asks")).alias("crossed"))


@query(
    "f3_stale_first",
    f"""with {EVU}, {LAST}, n as (select venue, symbol, max(arrival) n from ev group by all), b as (select symbol, max(case when side = 'bid' then price end) bid, min(case when side = 'ask' then price end) ask from book group by symbol)
select venue, n.symbol, (n >= 5)::bigint gaps, (n >= 5)::bigint resyncs, case when n >= 5 then n - 3 else 0 end gens, case when n >= 5 then 'ok' else 'waiting' end state, case when n >= 5 then bid end bid, case when n >= 5 then ask end ask from n left join b on b.symbol = n.symbol""",
)
def f3_stale(spark: SparkSession, d: str) -> DataFrame:
    """Every user's feed from its fifth update on, where the first fetch brings an empty book of an older state: a gap, and
    the next fetch has the book at the fifth."""
    rows = level_rows(spark, d, "user_id")
    older = empty_snapshots(rows)
    book = B.as_snapshot(B.delta_levels(as_events(rows)), 5).select(*KEY, F.col("bids").alias("_b"), F.col("asks").alias("_a"))
    newer = older.join(book, KEY, "left").withColumns({"last_update_id": F.lit(5).cast("bigint"), "bids": F.coalesce("_b", "bids"), "asks": F.coalesce("_a", "asks")}).drop("_b", "_a")
    out = written(R.replay(as_events(rows).where("arrival > 4"), I.stale_first(newer, older), R.Options(views_every=0)), "stale")
    best = lambda side: F.get(side, F.lit(0))["price"]
    last = R.views(out).select(*KEY, best(F.col("bids")).alias("bid"), best(F.col("asks")).alias("ask"))
    return R.counters(out).join(R.status(out), KEY).join(last, KEY, "left").select(*KEY, "gaps", "resyncs", "gens", "state", "bid", "ask")


# --- G. figures of views ---------------------------------------------------------------------------------------------


@query("g1_cumulative_depth", f"with {TOP} select venue, symbol, side, rank, sum(size) over (partition by symbol, side order by rank rows unbounded preceding)::bigint cum from top")
def g1(spark: SparkSession, d: str) -> DataFrame:
    v = user_views(spark, d)
    side = lambda name: v.select(*KEY, F.lit(name).alias("side"), F.posexplode(V.cumulate(F.col(f"{name}s"))).alias("p", "cum"))
    return side("bid").unionByName(side("ask")).select(*KEY, "side", (F.col("p") + 1).alias("rank"), F.col("cum").cast("bigint").alias("cum"))


@query("g1_cumulative_depth_rows", f"with {TOP} select venue, symbol, side, rank, sum(size) over (partition by symbol, side order by rank rows unbounded preceding)::bigint cum from top")
def g1_rows(spark: SparkSession, d: str) -> DataFrame:
    return V.cumulate_rows(B.top(user_book(spark, d), 10)).select(*KEY, "side", "rank", F.col("cum").cast("bigint").alias("cum"))


ENDS = "en as (select venue, symbol, max(case when side = 'bid' then price end) bb, min(case when side = 'ask' then price end) ba, coalesce(min(case when side = 'bid' then price end), min(case when side = 'ask' then price end)) lo, coalesce(max(case when side = 'ask' then price end), max(case when side = 'bid' then price end)) hi, greatest(coalesce(sum(case when side = 'bid' then size end), 0), coalesce(sum(case when side = 'ask' then size end), 0))::bigint most from top group by all)"
NICE = "(case when p >= most then p when 2 * p >= most then 2 * p when 5 * p >= most then 5 * p else 10 * p end)"
NICED = f"nt as (select *, {NICE} nice from (select *, (10 ** (length(most::varchar) - 1))::bigint p from en))"


@query("g2_price_ends", f"with {TOP}, {ENDS} select venue, symbol, {px('lo')} low, {px('hi')} high from en")
def g2(spark: SparkSession, d: str) -> DataFrame:
    e = V.price_ends(F.col("bids"), F.col("asks"))
    return user_views(spark, d).select(*KEY, e["low"].alias("low"), e["high"].alias("high"))


def _label(q: int) -> str:
    v = f"(nice * {25 * q})"
    return f"rtrim(rtrim(({v} // 100000)::varchar || '.' || lpad(({v} % 100000)::varchar, 5, '0'), '0'), '.')"


@query("g3_axis", f"with {TOP}, {ENDS}, {NICED} select venue, symbol, nice top, {_label(1)} || ' ' || {_label(2)} || ' ' || {_label(3)} || ' ' || {_label(4)} labels from nt")
def g3(spark: SparkSession, d: str) -> DataFrame:
    """The size axis of every view: its top and the labels at its quarters."""
    v = user_views(spark, d)
    last = lambda side: F.coalesce(F.try_element_at(V.cumulate(F.col(side)), F.lit(-1)), F.lit(0))
    v = v.withColumn("most", F.greatest(last("bids"), last("asks")).cast("decimal(38,0)")).withColumn("t", V.nice_top(F.col("most")))
    return v.select(*KEY, F.col("t").cast("bigint").alias("top"), F.array_join(V.tick_labels(F.col("t"), F.lit(SIZE_SCALE)), " ").alias("labels"))


POINTS = f"""{TOP}, {ENDS}, {NICED}, pt as (select t.venue, t.symbol, side, rank - 1 "index", price, case when hi = lo then 5000 else (price - lo) * 10000 // (hi - lo) end "left", (sum(size) over (partition by t.symbol, side order by rank rows unbounded preceding))::bigint * 10000 // nice "top", lo, hi, bb, ba from top t join nt using (symbol))"""


@query("g4_depth_points", f'with {POINTS} select venue, symbol, side, "index", {px("price")} price, "left", "top", case when bb is not null and ba is not null then ((bb + ba) * 5 - lo * 10) * 10000 // ((hi - lo) * 10) end mid_place from pt')
def g4(spark: SparkSession, d: str) -> DataFrame:
    v = user_views(spark, d)
    p = v.select(*KEY, V.mid_place(F.col("bids"), F.col("asks")).alias("mid_place"), F.explode(V.depth_points(F.col("bids"), F.col("asks"))).alias("p"))
    return p.select(*KEY, "p.side", "p.index", "p.price", "p.left", "p.top", "mid_place")


@query("g5_nearest_point", f"""with {POINTS}, r as (select *, row_number() over (partition by symbol order by abs("left" - symbol::bigint % 11 * 1000), "index", case when side = 'bid' then 0 else 1 end) rn from pt) select venue, symbol, {px('price')} price from r where rn = 1""")
def g5(spark: SparkSession, d: str) -> DataFrame:
    v = user_views(spark, d).withColumn("p", V.depth_points(F.col("bids"), F.col("asks")))
    return v.select(*KEY, V.nearest_point(F.col("p"), F.col("symbol").cast("bigint") % 11 * 1000).alias("price"))


@query("g6_size_bars", f"with {TOP}, m as (select symbol, max(size) mx from top group by symbol) select venue, symbol, side, rank, greatest(2, size * 100 // mx) share from top join m using (symbol)")
def g6(spark: SparkSession, d: str) -> DataFrame:
    v = user_views(spark, d).withColumn("s", V.bar_shares(F.col("bids"), F.col("asks")))
    rows = v.select(*KEY, F.size("bids").alias("n"), F.posexplode("s").alias("p", "share"))
    bid = F.col("p") < F.col("n")
    return rows.select(*KEY, F.when(bid, "bid").otherwise("ask").alias("side"), F.when(bid, F.col("p") + 1).otherwise(F.col("p") - F.col("n") + 1).alias("rank"), "share")


def mids(spark: SparkSession, d: str) -> DataFrame:
    """A series of mids for each user, a few to a slot; time goes back a little often and far now and then; scales change.
    One view in eleven is one-sided and has none."""
    e = level_rows(spark, d, "user_id")
    t = F.col("arrival") * 170 + F.col("c") % 400 - F.when(F.col("event_id") % 97 == 0, 7200000).otherwise(0)
    text = F.when(F.expr("arrival div 7") % 5 == 4, S.format_scaled(F.col("c"), 2)).otherwise(S.format_scaled(F.col("c") * 5, 3))
    return e.select(*KEY, F.col("arrival").alias("ord"), t.alias("t_ms"), F.when(F.col("event_id") % 11 != 3, text).alias("mid"))


# mids in order (rn), and the slots and sessions that they fall into; sl has the last value of each slot
MIDS = f"""ma as (select symbol, arrival ord, arrival rn, event_id % 11 != 3 two_sided, arrival * 170 + c % 400 - case when event_id % 97 = 0 then 7200000 else 0 end t_ms, arrival // 7 % 5 = 4 coarse, case when arrival // 7 % 5 = 4 then c else c * 5 end v, case when arrival // 7 % 5 = 4 then {px('c')} else {MID3.format('c * 5')} end mid from ev),
md as (select * replace (case when two_sided then mid end as mid) from ma), mt as (select * replace (row_number() over (partition by symbol order by ord) as rn) from ma where two_sided)"""
HISTORY = f"""fo as (select symbol, rn, t_ms slot, coarse, 0::bigint session from mt where rn = 1
union all select m.symbol, m.rn, case when m.t_ms < f.slot or m.coarse != f.coarse or m.t_ms >= f.slot + {V.GAP_MS} then m.t_ms else f.slot end, m.coarse, f.session + (m.t_ms < f.slot or m.coarse != f.coarse)::bigint from fo f join mt m on m.symbol = f.symbol and m.rn = f.rn + 1),
pt as (select f.symbol, f.session, f.slot t_ms, arg_max(mid, f.rn) mid, arg_max(v, f.rn) v, any_value(f.coarse) coarse from fo f join mt using (symbol, rn) group by all)"""


@query(
    "g7_g8_mid_history",
    f"""with recursive {EVU}, {MIDS}, {HISTORY},
wd as (select *, count(*) over w n_points, min(t_ms) over w t0, first_value(v) over w v0 from pt window w as (partition by symbol, session order by t_ms range between {V.WINDOW_MS} preceding and current row)),
ch as (select *, v - v0 df from wd)
select 'EVT' venue, symbol, session, t_ms, mid, n_points::int n_points, t_ms - t0 span_ms, case when n_points = 1 then null else case when df < 0 then chr(8722) when df > 0 then '+' else '' end || case when coarse then {px('abs(df)')} else {MID3.format('abs(df)')} end end change, n_points < {V.ENOUGH} collecting from ch""",
)
def g7(spark: SparkSession, d: str) -> DataFrame:
    """Every point of each user's mid history with its figures."""
    return V.history_figures(V.mid_history(mids(spark, d)))


@query("g9_spark_shares", f"""with {EVU}, m as (select venue, symbol, arrival, received_ns // 1000000 t, c from ev), w as (select *, min(c) over (partition by symbol) lo, max(c) over (partition by symbol) hi, min(t) over (partition by symbol) t0, max(t) over (partition by symbol) t1 from m)
select venue, symbol, t t_ms, {px('c')} mid, case when hi = lo then 500 else (c - lo) * 1000 // (hi - lo) end y_thousandths, (t - t0)::double / greatest(1, t1 - t0)::double x_share from w""")
def g9(spark: SparkSession, d: str) -> DataFrame:
    p = level_rows(spark, d, "user_id").select(*KEY, F.lit(0).cast("bigint").alias("session"), F.expr("received_ns div 1000000").alias("t_ms"), S.format_scaled(F.col("c"), PRICE_SCALE).alias("mid"))
    return V.spark_shares(p).select(*KEY, "t_ms", "mid", "y_thousandths", "x_share")


@query(
    "g10_rate_limit",
    f"""with recursive {EVU}, {MIDS}, tm as (select symbol, rn, mid, rn * 211000 % 6000 + rn * 200000 t_ms from md),
ps as (select symbol, rn, t_ms last, true passes from tm where rn = 1 union all select t.symbol, t.rn, case when t.t_ms >= p.last + 600000 then t.t_ms else p.last end, t.t_ms >= p.last + 600000 from ps p join tm t on t.symbol = p.symbol and t.rn = p.rn + 1)
select 'EVT' venue, symbol, rn ord, t_ms, mid from ps join tm using (symbol, rn) where passes""",
)
def g10(spark: SparkSession, d: str) -> DataFrame:
    """Which events of each user a limit of one in ten minutes lets through."""
    return V.rate_limited(mids(spark, d).withColumn("t_ms", F.col("ord") * 211000 % 6000 + F.col("ord") * 200000), 600000, KEY)


@query(
    "g11_throttle",
    f"""with recursive {EVU}, {MIDS}, tm as (select symbol, rn, mid, rn * 211000 t_ms, lead(rn * 211000) over (partition by symbol order by rn) nx from md),
th as (select symbol, rn, t_ms + 600000 free, t_ms shown_ms from tm where rn = 1
union all select t.symbol, t.rn, case when t.t_ms >= h.free then t.t_ms + 600000 when t.nx is null or t.nx >= h.free then h.free + 600000 else h.free end, case when t.t_ms >= h.free then t.t_ms when t.nx is null or t.nx >= h.free then h.free end from th h join tm t on t.symbol = h.symbol and t.rn = h.rn + 1)
select 'EVT' venue, symbol, rn ord, t_ms, mid, shown_ms from th join tm using (symbol, rn) where shown_ms is not null""",
)
def g11(spark: SparkSession, d: str) -> DataFrame:
    """What a display of each user's mids shows that changes once in ten minutes at most."""
    return V.throttled(mids(spark, d).withColumn("t_ms", F.col("ord") * 211000), 600000, KEY)


# every value is shown by then but those that are held at the end of all time that was seen
@query("g11_throttle_stream", f"with z as ({SQL['g11_throttle']}) select venue, symbol, ord, t_ms, mid, shown_ms from z where shown_ms <= (select max(t_ms) from z)")
def g11_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream with timers, in three micro-batches by time: held values come when their slot has ended."""
    rows = mids(spark, d).select(*KEY, "ord", (F.col("ord") * 211000).alias("t_ms"), F.col("mid").alias("value"))
    use_rocksdb(spark)
    out = streamed(throttled_stream(in_order(rows, "t_ms"), 600000), "append")
    return out.select(*KEY, "ord", "t_ms", F.col("value").alias("mid"), "shown_ms")


# --- H. telemetry ----------------------------------------------------------------------------------------------------

FRAMES = """fr as (select venue, symbol, (arrival - 1) // 4 ord, min(case when event_id % 3 = 0 then arrival end) lo, max(case when event_id % 3 = 0 then arrival end) hi, max(arrival) top, count(*) n, max(case when event_id % 131 = 0 then 1 else 0 end) again from ev group by all)"""


def telemetry_log(spark: SparkSession, d: str) -> DataFrame:
    """A telemetry frame for every four events of a user: events are its arrivals with event_id divisible by three, the
    resyncs counter is the largest arrival so far, and falls back to zero where an event_id is divisible by 131."""
    e = level_rows(spark, d, "user_id").withColumn("ord", F.expr("(arrival - 1) div 4"))
    event = F.struct(F.col("arrival").alias("id"), F.when(F.col("event_id") % 2 == 0, "gap").otherwise("snapshot-error").alias("kind"), F.expr("received_ns div 1000000").alias("at_ms"), F.col("c").alias("expected_seq"), F.col("c").alias("got_seq"), F.lit("r").alias("reason"), F.col("c").alias("duration_ms"))
    rows = e.groupBy(*KEY, "ord").agg(F.array_sort(F.collect_list(F.when(F.col("event_id") % 3 == 0, event))).alias("events"), F.max("arrival").alias("top"), F.max(F.when(F.col("event_id") % 131 == 0, 1).otherwise(0)).alias("again"))
    return rows.select(*KEY, "ord", "events", F.when(F.col("again") == 1, F.lit(0).cast("bigint")).otherwise(F.col("top")).alias("resyncs"), *[F.lit(0).cast("bigint").alias(c) for c in COUNTER_NAMES if c != "resyncs"])


RUNS = f"""{EVU}, {FRAMES}, ff as (select *, case when again = 1 then 0 else top end resyncs, coalesce(hi, 0) nid from fr), rs as (select *, coalesce(resyncs < lag(resyncs) over (partition by symbol order by ord), false) or coalesce(nid < lag(nid) over (partition by symbol order by ord), false) restarted from ff), rn as (select *, (sum(restarted::int) over (partition by symbol order by ord rows unbounded preceding))::bigint run from rs)"""


@query("h2_restarts", f"with {RUNS} select venue, symbol, ord, restarted, run from rn")
def h2(spark: SparkSession, d: str) -> DataFrame:
    return T.runs(telemetry_log(spark, d)).select(*KEY, "ord", "restarted", "run")


@query("h1_merged_events", f"""with {RUNS}, x as (select rn.venue, rn.symbol, rn.run, e.arrival id, e.c duration_ms, row_number() over (partition by rn.symbol, rn.run order by e.arrival desc) rank from rn join ev e on e.symbol = rn.symbol and (e.arrival - 1) // 4 = rn.ord and e.event_id % 3 = 0) select venue, symbol, run, rank, id, duration_ms from x where rank <= 16""")
def h1(spark: SparkSession, d: str) -> DataFrame:
    return T.merge_events(T.runs(telemetry_log(spark, d))).select(*KEY, "run", "rank", "id", "duration_ms")


@query("h1_lost_events", f"with {RUNS}, k as (select *, max(hi) over (partition by symbol, run order by ord rows between unbounded preceding and 1 preceding) known from rn where lo is not null) select venue, symbol, run, sum(coalesce(greatest(0, lo - known - 1), 0))::bigint lost from k group by all")
def h1_lost(spark: SparkSession, d: str) -> DataFrame:
    return T.lost_events(T.runs(telemetry_log(spark, d)))


@query("h4_new_entries", f"with {RUNS} select venue, symbol, run, max(nid) newest, arg_min(nid, ord) baseline, greatest(0, max(nid) - arg_min(nid, ord)) new_entries from rn group by all")
def h4(spark: SparkSession, d: str) -> DataFrame:
    return T.new_entries(T.runs(telemetry_log(spark, d)))


@query("h3_fault_summary", f"""with {EV}, {FAULTS}, n as (select venue, symbol, max(case when kind in {REBUILD} then id end) nid, count(case when kind in {REBUILD} then 1 end) resyncs from fl group by all) select n.venue, n.symbol, greatest(0, resyncs - (duration_ms = -1)::int) repaired, duration_ms = -1 in_progress, nid latest_id, kind latest_kind from n join fl on fl.symbol = n.symbol and fl.id = n.nid""")
def h3(spark: SparkSession, d: str) -> DataFrame:
    log = fault_log(spark, d)
    return T.fault_summary(R.count_faults(log), log)


@query("h5_view_checks", f"with {EV}, v as (select venue, symbol, event_id % 8 != 0 two, c % 500 >= (c * 7) % 500 bad from ev) select venue, symbol, count(case when two then 1 end) checked, count(case when two and bad then 1 end) refused from v group by all")
def h5(spark: SparkSession, d: str) -> DataFrame:
    one = lambda p: F.array(F.array(S.format_scaled(p, PRICE_SCALE), F.lit("1.000")))
    c = F.col("c")
    v = level_rows(spark, d).select(*KEY, one(c % 500).alias("bids"), F.when(F.col("event_id") % 8 == 0, F.array().cast("array<array<string>>")).otherwise(one(c * 7 % 500)).alias("asks"))
    return T.view_checks(v)


@query("h6_poll_health", f"""with {EVU}, p as (select venue, symbol, arrival ord, event_type != 'error' and event_type != 'view' ok, event_type st from ev), l as (select *, max(case when ok then ord end) over (partition by symbol order by ord rows unbounded preceding) last_ok from p),
f as (select *, count(case when not ok then 1 end) over (partition by symbol, last_ok order by ord rows unbounded preceding) failures from l) select f.venue, f.symbol, f.ord, failures, case when f.ok then 'ok' when failures >= 3 then 'unavailable' when last_ok is null then 'loading' else 'degraded' end state, g.st shown_status from f left join p g on g.symbol = f.symbol and g.ord = last_ok""")
def h6(spark: SparkSession, d: str) -> DataFrame:
    p = level_rows(spark, d, "user_id").select(*KEY, F.col("arrival").alias("ord"), (~F.col("event_type").isin("error", "view")).alias("ok"), F.col("event_type").alias("status"))
    return T.poll_health(p).select(*KEY, "ord", "failures", "state", "shown_status")


LINKS = """lk as (select venue, symbol, arrival ord, ['connecting', 'open', 'transient', 'closed', 'telemetry', 'view', 'invalid', 'open'][(c % 8 + 1)::int] type, received_ns // 1000000 now_ms, c % 5 attempt, received_ns // 1000000 + c retry_at from ev)"""
_U = "over (partition by symbol order by ord rows unbounded preceding)"
LINK_STATES = f"""{EVU}, {LINKS}, ls as (select *, coalesce(last_value(case when type in ('connecting', 'open', 'transient', 'closed') then type end ignore nulls) {_U}, 'connecting') link, count(case when type = 'open' then 1 end) {_U} opens,
coalesce(last_value(case when type = 'open' then 0 when type = 'closed' then attempt end ignore nulls) {_U}, 0) tries, coalesce(last_value(case when type = 'open' then now_ms end ignore nulls) {_U}, 0) open_at, coalesce(last_value(case when type in ('open', 'telemetry') then now_ms end ignore nulls) {_U}, 0) beat_at,
count(case when type = 'invalid' then 1 end) {_U} dropped, last_value(case when type in ('connecting', 'open', 'transient') then -1 when type = 'closed' then retry_at end ignore nulls) {_U} retry from lk),
lt as (select *, coalesce(last_value(case when type = 'view' then now_ms end ignore nulls) over (partition by symbol, opens order by ord rows unbounded preceding), 0) view_at from ls)"""


def link_log(spark: SparkSession, d: str) -> DataFrame:
    types = ("connecting", "open", "transient", "closed", "telemetry", "view", "invalid", "open")
    now = F.expr("received_ns div 1000000")
    return level_rows(spark, d, "user_id").select(*KEY, F.col("arrival").alias("ord"), F.element_at(F.array(*map(F.lit, types)), (F.col("c") % 8 + 1).cast("int")).alias("type"), now.alias("now_ms"), (F.col("c") % 5).alias("attempt"), (now + F.col("c")).alias("retry_at"))


@query("h7_link_state", f"with {LINK_STATES} select venue, symbol, ord, link, opens > 0 ever_opened, tries, open_at, beat_at, view_at, dropped, case when retry >= 0 then retry end retry_at from lt")
def h7(spark: SparkSession, d: str) -> DataFrame:
    return T.link_state(link_log(spark, d)).select(*KEY, "ord", "link", "ever_opened", "tries", "open_at", "beat_at", "view_at", "dropped", "retry_at")


@query("h8_freshness", f"""with {LINK_STATES}, sa as (select venue, symbol, ord, now_ms + 1 + c2 at_ from (select *, (ord * 2777) % 16000 c2 from lt) where ord % 3 = 0), j as (select s.venue, s.symbol, s.at_, max(l.ord) lo from sa s join lt l on l.symbol = s.symbol and l.now_ms <= s.at_ group by all),
x as (select j.*, l.link, l.opens > 0 eo, l.tries, case when l.retry >= 0 then l.retry end retry_at, greatest(0, j.at_ - l.beat_at) beat, l.beat_at, l.view_at, greatest(0, j.at_ - case when l.view_at > 0 then l.view_at else l.open_at end) vw from j join lt l on l.symbol = j.symbol and l.ord = j.lo)
select venue, symbol, at_ now_ms, case link when 'connecting' then case when eo then 'reconnecting' else 'connecting' end when 'transient' then 'transient' when 'closed' then 'reconnecting' else case when beat_at > 0 and beat > 3000 then 'no-data' when vw >= 10000 then 'quiet' else 'live' end end as label,
case when link = 'closed' then 'in ' || least(30, greatest(0, ceil((coalesce(retry_at, at_) - at_) / 1000.0)))::int::varchar || ' s · attempt ' || tries::varchar when link = 'open' and beat_at > 0 and beat > 3000 then (beat // 1000)::varchar || ' s' when link = 'open' and vw >= 10000 then 'market quiet' when link = 'open' and view_at > 0 then case when vw < 1000 then vw::varchar || ' ms' else (vw // 1000)::varchar || '.' || (vw % 1000 // 100)::varchar || ' s' end end detail from x""")
def h8(spark: SparkSession, d: str) -> DataFrame:
    states = T.link_state(link_log(spark, d))
    samples = states.where("ord % 3 = 0").select(*KEY, (F.col("now_ms") + 1 + F.col("ord") * 2777 % 16000).alias("now_ms"))
    return T.freshness(samples, states)


def _label(t: str) -> str:
    """SQL text of a link's label at a time."""
    return f"case link when 'connecting' then case when opens > 0 then 'reconnecting' else 'connecting' end when 'transient' then 'transient' when 'closed' then 'reconnecting' else case when beat_at > 0 and {t} - beat_at > {T.NO_DATA_MS} then 'no-data' when {t} - case when view_at > 0 then view_at else open_at end >= {T.QUIET_MS} then 'quiet' else 'live' end end"


@query(
    "h8_labels_stream",
    f"""with {LINK_STATES}, nx as (select *, lead(now_ms) over (partition by symbol order by ord) next_ms, max(now_ms) over () seen from lt),
fl as (select *, unnest([beat_at + {T.NO_DATA_MS} + 1, case when view_at > 0 then view_at else open_at end + {T.QUIET_MS}]) t from nx where link = 'open'),
pt as (select venue, symbol, ord, 0 o, now_ms t, {_label('now_ms')} as label, 'event' cause from nx union all select venue, symbol, ord, 1, t, {_label('t')}, 'silence' from fl where t > now_ms and t <= seen and (next_ms is null or t < next_ms)),
ch as (select *, lag(label) over (partition by symbol order by ord, o, t) prior from pt)
select venue, symbol, t at_ms, label, cause from ch where prior is distinct from label""",
)
def h8_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every change of the label of each user's link, by events or by silence, from a stream with timers in three
    micro-batches by time."""
    use_rocksdb(spark)
    return streamed(link_labels(in_order(link_log(spark, d), "now_ms")), "append").select(*KEY, "at_ms", "label", "cause")


@query("h9_telemetry_frames", f"""with {EV}, {FAULTS}, rg as (select min(received_ns // 1000000) lo, max(received_ns // 1000000) hi from ev), tk as (select unnest(range(lo, hi + 1, 3600000)) t from rg), fe as (select distinct venue, symbol from ev)
select fe.venue, fe.symbol, t, coalesce((select max(arrival) from ev where ev.symbol = fe.symbol and ev.received_ns // 1000000 <= t), 0) seq, (select count(case when kind = 'gap' then 1 end) from fl where fl.symbol = fe.symbol and at_ms <= t) gaps, (select count(case when kind in {REBUILD} then 1 end) from fl where fl.symbol = fe.symbol and at_ms <= t) resyncs, (select least(count(*), 16) from fl where fl.symbol = fe.symbol and at_ms <= t) listed, (select coalesce(max(id), 0) from fl where fl.symbol = fe.symbol and at_ms <= t) newest from fe, tk""")
def h9(spark: SparkSession, d: str) -> DataFrame:
    """A frame of every feed for each hour that the table spans."""
    rows = level_rows(spark, d)
    v = rows.select(*KEY, F.expr("received_ns div 1000000").alias("at_ms"), F.col("arrival").alias("gen"), F.col("arrival").alias("last_seq"))
    first, last = rows.agg(F.min(F.expr("received_ns div 1000000")), F.max(F.expr("received_ns div 1000000"))).first()
    f = T.telemetry_frames(fault_log(spark, d), v, first, last, 3600000)
    return f.select(*KEY, "t", "seq", "gaps", "resyncs", F.size("events").cast("bigint").alias("listed"), F.coalesce(F.array_max(F.transform("events", lambda e: e["id"])), F.lit(0)).alias("newest"))


@query("h9_telemetry_stream", f"""with {EV}, {FAULTS}, x as (select venue, symbol, at_ms // 3600000 * 3600000 t, id, kind, null::bigint seq from fl union all select venue, symbol, received_ns // 1000000 // 3600000 * 3600000, null, null, arrival from ev)
select venue, symbol, t, coalesce(max(seq), 0) seq, count(case when kind = 'gap' then 1 end) gaps, count(case when kind in {REBUILD} then 1 end) resyncs, least(count(id), 16) listed, coalesce(max(id), 0) newest from x group by venue, symbol, t""")
def h9_stream(spark: SparkSession, d: str) -> DataFrame:
    """What happened to every feed in each hour, by a stream over faults and views in three micro-batches or more; a row of
    no feed, two hours after the last, ends the recording."""
    log = fault_log(spark, d)
    views = level_rows(spark, d).select(*KEY, F.expr("received_ns div 1000000").alias("at_ms"), F.col("arrival").alias("last_seq"))
    end = views.agg(((F.expr("max(at_ms) div 3600000") + 2) * 3600000).alias("at_ms"))
    both = in_order(log.withColumn("last_seq", F.lit(None).cast("bigint")).unionByName(views, allowMissingColumns=True).unionByName(end, allowMissingColumns=True), "at_ms", feed_rows=1_000_000)
    use_rocksdb(spark)
    frames = streamed(telemetry_stream(both.where("id is not null"), both.where("id is null"), 3600000, "0 seconds"), "append")
    return frames.select(*KEY, F.col("tick_ms").alias("t"), F.coalesce("seq", F.lit(0)).alias("seq"), "gaps", "resyncs", F.size("events").cast("bigint").alias("listed"), F.coalesce(F.get("events", F.lit(0))["id"], F.lit(0)).alias("newest"))


# --- I. fan-out ------------------------------------------------------------------------------------------------------


def delivery_log(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Publishes of each feed (all its rows) and the log of three consumers: consumer j takes at event_id % (j + 2) = 0."""
    e = level_rows(spark, d)
    publishes = e.select(*KEY, (F.col("arrival") * 2).alias("arrival"), F.col("arrival").alias("view_seq"))
    js = F.explode(F.array(*[F.lit(j).cast("bigint") for j in (1, 2, 3)])).alias("consumer")
    takes = e.select(*KEY, js, (F.col("arrival") * 2 + 1).alias("arrival"), "event_id").where(F.col("event_id") % (F.col("consumer") + 2) == 0).drop("event_id")
    subs = e.select(*KEY).distinct().select(*KEY, js).withColumns({"from_arrival": F.col("consumer") * 10, "to_arrival": F.lit(2**62)})
    return publishes, FO.consumer_log(publishes, takes, subs)


LOG = """pb as (select venue, symbol, arrival * 2 at_, arrival view_seq from ev), cs as (select unnest([1, 2, 3]) consumer), lg as (select venue, symbol, consumer, at_, 'publish' op, view_seq from pb, cs where at_ >= consumer * 10 union all select venue, symbol, consumer, arrival * 2 + 1, 'take', null from ev, cs where event_id % (consumer + 2) = 0),
ep as (select *, coalesce(count(case when op = 'take' then 1 end) over (partition by symbol, consumer order by at_ rows between unbounded preceding and 1 preceding), 0) ep from lg), sk as (select *, count(case when op = 'publish' then 1 end) over (partition by symbol, consumer, ep order by at_ rows unbounded preceding) - 1 streak, last_value(view_seq ignore nulls) over (partition by symbol, consumer, ep order by at_ rows unbounded preceding) newest from ep),
oc as (select *, case when op = 'publish' then case when streak = 0 then 'delivered' else 'supersedes' end when newest is null then 'nothing' else 'taken' end outcome from sk)"""


@query("i1_conflation", f"with {EV}, {LOG} select venue, symbol, consumer, at_ arrival, outcome, case when op = 'take' then newest end got_seq from oc")
def i1(spark: SparkSession, d: str) -> DataFrame:
    _, log = delivery_log(spark, d)
    return FO.conflate(log).select(*KEY, "consumer", "arrival", "outcome", "got_seq")


@query("i2_delivery_stats", f"with {EV}, {LOG} select venue, symbol, count(distinct consumer) consumers, count(case when outcome = 'delivered' then 1 end) delivered, count(case when outcome = 'supersedes' then 1 end) dropped, (select count(*) from pb where pb.symbol = oc.symbol) published from oc group by venue, symbol")
def i2(spark: SparkSession, d: str) -> DataFrame:
    publishes, log = delivery_log(spark, d)
    return FO.delivery_stats(FO.conflate(log), publishes)


@query("i3_slow_consumers", f"with {EV}, {LOG}, cut as (select symbol, consumer, min(at_) at_ from oc where op = 'publish' and streak >= 9 group by all) select oc.venue, oc.symbol, oc.consumer, count(*) n, max(case when oc.at_ = cut.at_ then oc.at_ end) cut_at from oc left join cut on cut.symbol = oc.symbol and cut.consumer = oc.consumer where cut.at_ is null or oc.at_ <= cut.at_ group by all")
def i3(spark: SparkSession, d: str) -> DataFrame:
    _, log = delivery_log(spark, d)
    return FO.conflate(log, max_lag=9).groupBy(*FO.CONSUMER).agg(F.count("*").alias("n"), F.max(F.when(F.col("disconnected"), F.col("arrival"))).alias("cut_at"))


def delivered_stream(spark: SparkSession, d: str, max_lag: int | None) -> DataFrame:
    """Outcomes of the same publishes and takes by a stream in three micro-batches."""
    e = level_rows(spark, d)
    _, log = delivery_log(spark, d)
    takes = log.where("op = 'take'").select(*FO.CONSUMER, "arrival")
    publishes = e.select(*KEY, (F.col("arrival") * 2).alias("arrival"), F.col("arrival").alias("view_seq"), F.lit("publish").alias("op"))
    js = F.explode(F.array(*[F.lit(j).cast("bigint") for j in (1, 2, 3)])).alias("consumer")
    subs = written(e.select(*KEY).distinct().select(*KEY, js).withColumns({"from_arrival": F.col("consumer") * 10, "to_arrival": F.lit(2**62)}), "subscriptions")
    # publishes and takes of one range of arrivals come together
    both = in_order(publishes.select(*KEY, "arrival", "view_seq", "op", F.lit(None).cast("bigint").alias("consumer")).unionByName(takes.select(*KEY, "arrival", F.lit(None).cast("bigint").alias("view_seq"), F.lit("take").alias("op"), "consumer")), "arrival")
    use_rocksdb(spark)
    return streamed(delivery_stream(FO.consumer_log(both.where("op = 'publish'").drop("consumer", "op"), both.where("op = 'take'").drop("view_seq", "op"), subs), max_lag), "append")


@query("i1_conflation_stream", SQL["i1_conflation"])
def i1_stream(spark: SparkSession, d: str) -> DataFrame:
    return delivered_stream(spark, d, None).select(*FO.CONSUMER, "arrival", "outcome", "got_seq")


@query("i3_slow_consumers_stream", SQL["i3_slow_consumers"])
def i3_stream(spark: SparkSession, d: str) -> DataFrame:
    return delivered_stream(spark, d, 9).groupBy(*FO.CONSUMER).agg(F.count("*").alias("n"), F.max(F.when(F.col("disconnected"), F.col("arrival"))).alias("cut_at"))


@query("i4_latest_views", f"with {EVU} select venue, symbol, max(arrival) gen, arg_max(price, arrival) price from ev group by all")
def i4(spark: SparkSession, d: str) -> DataFrame:
    return FO.latest_views(level_rows(spark, d, "user_id").select(*KEY, F.col("arrival").alias("gen"), "price"))


@query("i4_latest_views_stream", f"with {EVU} select venue, symbol, max(arrival) gen, arg_max(price, arrival) price from ev group by all")
def i4_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream over four files: the last that each user's consumer was shown."""
    views = level_rows(spark, d, "user_id").select(*KEY, F.col("arrival").alias("gen"), "price")
    shown = streamed(latest_views_stream(as_stream(views, 4)), "update")
    newest = shown.groupBy(*KEY).agg(F.max_by(F.struct("gen", "view"), "batch").alias("x"))
    return newest.select(*KEY, "x.gen", "x.view.price")


# --- K. latency ------------------------------------------------------------------------------------------------------


def latency_rows(spark: SparkSession, d: str) -> DataFrame:
    return level_rows(spark, d).select(*KEY, (F.col("c") * 1000).alias("ns"), "event_id", "arrival")


@query("k1_samples", f"with {EV} select venue, symbol, arrival, c * 1000 - 50000 ns from ev where event_id % 5 != 0 and c * 1000 >= 50000")
def k1(spark: SparkSession, d: str) -> DataFrame:
    rows = level_rows(spark, d).select(*KEY, "arrival", F.when(F.col("event_id") % 5 != 0, F.lit(50000)).alias("received_ns"), (F.col("c") * 1000).alias("stored_ns"))
    return L.samples(rows).select(*KEY, "arrival", "ns")


HIST = "hs as (select venue, symbol, case when c * 1000 <= 1 then 0 else floor(ln((c * 1000)::double) / ln(1.02))::int end bucket, count(*) n, sum(c * 1000)::bigint sum_ns, max(c * 1000) max_ns from ev group by all)"


@query("k2_histogram", f"with {EV}, {HIST} select * from hs")
def k2(spark: SparkSession, d: str) -> DataFrame:
    return L.histogram(latency_rows(spark, d), KEY)


@query("k2_totals", f"with {EV} select venue, symbol, count(*) count, sum(c * 1000)::bigint sum_ns, max(c * 1000) max_ns, (sum(c * 1000)::bigint // count(*)) mean_ns from ev group by all")
def k2_totals(spark: SparkSession, d: str) -> DataFrame:
    return L.totals(L.histogram(latency_rows(spark, d), KEY), KEY)


def _q(p: float, name: str) -> str:
    return f"min(case when cum >= greatest(1, ceil({p} * total)) then floor(exp(ln(1.02) * (bucket + 0.5)))::bigint end) {name}"


@query("k3_quantiles", f"with {EV}, {HIST}, cm as (select *, sum(n) over (partition by symbol order by bucket rows unbounded preceding) cum, sum(n) over (partition by symbol) total from hs) select venue, symbol, {_q(0.5, 'p50_ns')}, {_q(0.99, 'p99_ns')}, {_q(0.999, 'p999_ns')} from cm group by all")
def k3(spark: SparkSession, d: str) -> DataFrame:
    return L.quantiles(L.histogram(latency_rows(spark, d), KEY), KEY, {"p50_ns": 0.5, "p99_ns": 0.99, "p999_ns": 0.999})


@query("k4_tail", f"""with {EV}, t as (select venue, symbol, c * 1000 ns, count(*) over (partition by symbol) total from ev), a as (select *, row_number() over (partition by symbol order by ns) place, count(*) over (partition by symbol) above from t where ns > 1000)
select venue, symbol, max(case when place = floor(0.5 * (above - 1)) + 1 then ns end) p50_ns, max(case when place = floor(0.9 * (above - 1)) + 1 then ns end) p90_ns, max(case when place = floor(0.99::double * (above - 1)) + 1 then ns end) p99_ns, max(total) total, max(total) - max(above) at_floor from a group by all""")
def k4(spark: SparkSession, d: str) -> DataFrame:
    return L.tail_figures(latency_rows(spark, d), KEY)


@query("k5_latency_bars", f"with {EVU}, g as (select venue, symbol, min(c) * 10 a, max(c) * 5 b, max(c) * 7 m, max(c) * 6 z from ev group by all), s as (select *, case when a < 1000 then 0 else a end sa, case when b < 1000 then 0 else b end sb, case when m < 1000 then 0 else m end sm, case when z < 1000 then 0 else z end sz from g), t as (select *, greatest(sa, sb, sm, sz) tp from s) select venue, symbol, case when tp = 0 then 0 else sa * 100 // tp end p50, case when tp = 0 then 0 else sb * 100 // tp end p99, case when tp = 0 then 0 else sm * 100 // tp end p999, case when tp = 0 then 0 else sz * 100 // tp end \"max\", greatest(a, b, m, z) slowest from t")
def k5(spark: SparkSession, d: str) -> DataFrame:
    g = level_rows(spark, d, "user_id").groupBy(*KEY).agg((F.min("c") * 10).alias("a"), (F.max("c") * 5).alias("b"), (F.max("c") * 7).alias("m"), (F.max("c") * 6).alias("z"))
    return g.select(*KEY, L.bars(F.col("a"), F.col("b"), F.col("m"), F.col("z")).alias("x")).select(*KEY, "x.*")


@query("k6_open_loop", f"""with {EV}, r as (select venue, symbol, arrival - 1 k, (arrival - 1) * 200000 + c * 10 begun, (arrival - 1) * 200000 + c * 10 + c * 15 done from ev), f as (select *, done - k * 200000 due, done - begun svc, begun - k * 200000 > 200000 late, greatest(0, begun // 200000 - k) q from r)
select venue, symbol, count(case when late then 1 end) sender_late, count(case when k >= 100 and svc > 200000 then 1 end) over_interval, max(case when k >= 100 then q end) queue_max, max(case when k >= 100 then due end) due_max_ns, sum(case when k >= 100 then svc end)::bigint busy_ns, sum(case when k >= 100 then svc end)::bigint * 100.0::double / (count(case when k >= 100 then 1 end) * 200000) util_pct from f group by all""")
def k6(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("arrival") - 1, F.col("c")
    rows = level_rows(spark, d).select(*KEY, k.alias("k"), (k * 200000 + c * 10).alias("begun_ns"), (k * 200000 + c * 25).alias("done_ns"))
    return L.open_loop(rows, KEY, 200000, 100)


@query("k8_clock_step", f"with {EVU}, s as (select venue, symbol, received_ns - lag(received_ns) over (partition by symbol order by arrival) step from ev), r as (select *, row_number() over (partition by symbol order by step) rn, count(*) over (partition by symbol) n from s where step > 0) select venue, symbol, step clock_step_ns from r where rn = n // 2 + 1")
def k8(spark: SparkSession, d: str) -> DataFrame:
    return L.clock_step(level_rows(spark, d, "user_id").select(*KEY, F.col("arrival").alias("ord"), F.col("received_ns").alias("t_ns")), KEY)
