"""JSON documents at the edge: views, statuses and telemetry frames, written exactly and read with every rule checked.

Readers give a row a document: null in the parsed column means refused, for the caller to quarantine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import KEY

MAX_COUNT = 2**53 - 1
COUNTS = ("gaps", "resyncs", "disconnects", "wouldCrosses", "checksumMismatches", "snapshotRejects", "snapshotErrors", "rejected")
_INT = r"^-?[0-9]+$"


def view_json(views: DataFrame, price_scale: Column | int, size_scale: Column | int) -> DataFrame:
    """The payload of each view: prices and sizes as decimal strings of the feed's scales."""
    doc = F.struct("venue", "symbol", F.col("last_seq").alias("seq"), S.levels_as_strings(F.col("bids"), price_scale, size_scale).alias("bids"), S.levels_as_strings(F.col("asks"), price_scale, size_scale).alias("asks"))
    return views.select(*KEY, "gen", F.to_json(doc).alias("payload"))


def _count(raw: Column, path: str) -> Column:
    """A count at a path: a JSON integer from 0 to 2^53 - 1; null else."""
    text = F.get_json_object(raw, path)
    n = F.when(text.rlike(_INT), text.try_cast("bigint"))
    return F.when((n >= 0) & (n <= MAX_COUNT), n)


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def _levels_ok(levels: Column, rises: bool) -> Column:
    scale = lambda i: F.forall(levels, lambda x: S.scale_of(x[i]) == S.scale_of(levels[0][i]))
    plain = F.forall(levels, lambda x: (F.size(x) == 2) & S.is_plain_decimal(F.get(x, F.lit(0))) & S.is_plain_decimal(F.get(x, F.lit(1))))
    p = F.transform(levels, lambda x: S.to_scaled(F.get(x, F.lit(0))))
    m = F.greatest(F.size(p) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(p, F.lit(1), m).alias("a"), F.slice(p, F.lit(2), m).alias("b"))
    order = F.forall(pairs, lambda x: x["a"] < x["b"] if rises else x["a"] > x["b"])
    return F.when(levels.isNull(), False).when(F.size(levels) == 0, True).otherwise(F.coalesce(plain & scale(0) & scale(1) & order, F.lit(False)))


def parse_view(docs: DataFrame, column: str = "payload") -> DataFrame:
    """view of each document: venue, symbol, seq, bids, asks; null unless all rules hold.

    Plain decimals, pairs of exactly two, one scale for each column of a side and for both best prices, bids strictly
    falling and asks strictly rising. A size may be zero; crossing is not tested here.
    """
    raw = F.col(column)
    rows = docs.withColumn("_v", F.from_json(raw, "venue string, symbol string, bids array<array<string>>, asks array<array<string>>"))
    v = F.col("_v")
    texts = [F.get_json_object(raw, "$.venue").isNotNull(), F.get_json_object(raw, "$.symbol").isNotNull(), ~raw.rlike(r'"(venue|symbol)"\s*:\s*[^"\s]'), ~raw.rlike(r"\[\s*\[\s*[^\"\s\]]|\"\s*,\s*-?[0-9][^\"]*\]")]
    best = F.get(F.get(v["bids"], F.lit(0)), F.lit(0)), F.get(F.get(v["asks"], F.lit(0)), F.lit(0))
    one_scale = F.coalesce(S.scale_of(best[0]) == S.scale_of(best[1]), F.lit(True))
    fine = _all([*texts, _count(raw, "$.seq").isNotNull(), _levels_ok(v["bids"], False), _levels_ok(v["asks"], True), one_scale])
    return rows.withColumn("view", F.when(fine, F.struct(v["venue"].alias("venue"), v["symbol"].alias("symbol"), _count(raw, "$.seq").alias("seq"), v["bids"].alias("bids"), v["asks"].alias("asks")))).drop("_v")


def parse_status(docs: DataFrame, column: str = "document") -> DataFrame:
    """status of each document (schema 1 only): null unless every required field holds. Unknown fields are ignored; the
    latency block may be absent, but not null or partial."""
    raw = F.col(column)
    delivery, latency = ("consumers", "delivered", "dropped", "published"), ("count", "p50Ns", "p99Ns", "p999Ns", "maxNs")
    text = lambda k: raw.rlike(rf'"{k}"\s*:\s*"')
    age = F.when(F.get_json_object(raw, "$.lastEventAgeMs").rlike(_INT), F.get_json_object(raw, "$.lastEventAgeMs").try_cast("bigint"))
    conditions = [
        F.get_json_object(raw, "$.schema") == "1",
        F.get_json_object(raw, "$.mode").isin("synthetic", "live", "unknown"),
        F.get_json_object(raw, "$.chaos").isin("true", "false") & ~text("chaos"),
        *[F.get_json_object(raw, f"$.{k}").isNotNull() & text(k) for k in ("version", "venue", "symbol")],
        _count(raw, "$.startedAtUnixMs").isNotNull(),
        _count(raw, "$.depth").isNotNull(),
        (age >= -1) & (age <= MAX_COUNT),
        *[_count(raw, f"$.delivery.{k}").isNotNull() for k in delivery],
        *[_count(raw, f"$.engine.{k}").isNotNull() for k in COUNTS],
    ]
    has = F.coalesce(F.array_contains(F.json_object_keys(raw), "latency"), F.lit(False))
    conditions.append(~has | _all([_count(raw, f"$.latency.{k}").isNotNull() for k in latency]))
    fields = [F.get_json_object(raw, f"$.{k}").alias(k) for k in ("mode", "version", "venue", "symbol")] + [(F.get_json_object(raw, "$.chaos") == "true").alias("chaos"), _count(raw, "$.startedAtUnixMs").alias("started_ms"), _count(raw, "$.depth").alias("depth"), age.alias("age_ms")]
    fields += [F.struct(*[_count(raw, f"$.delivery.{k}").alias(k) for k in delivery]).alias("delivery"), F.struct(*[_count(raw, f"$.engine.{k}").alias(k) for k in COUNTS]).alias("engine"), F.when(has, F.struct(*[_count(raw, f"$.latency.{k}").alias(k) for k in latency])).alias("latency")]
    return docs.withColumn("status", F.when(_all(conditions), F.struct(*fields)))


def parse_telemetry(docs: DataFrame, column: str = "document") -> DataFrame:
    """telemetry of each frame: null unless counts are counts and event ids strictly rise."""
    raw = F.col(column)
    event = "struct<id:string,kind:string,atUnixMs:string,expectedSeq:string,gotSeq:string,reason:string,durationMs:string>"
    rows = docs.withColumn("_e", F.from_json(F.get_json_object(raw, "$.events"), f"array<{event}>"))
    n = lambda x: F.when(x.rlike(_INT), x.try_cast("bigint"))
    ok = lambda x: F.coalesce((n(x) >= 0) & (n(x) <= MAX_COUNT), F.lit(False))
    ids = F.transform("_e", lambda e: n(e["id"]))
    events_ok = F.forall("_e", lambda e: ok(e["id"]) & ok(e["atUnixMs"]) & ok(e["expectedSeq"]) & ok(e["gotSeq"]) & e["kind"].isNotNull() & e["reason"].isNotNull() & F.coalesce((n(e["durationMs"]) >= -1) & (n(e["durationMs"]) <= MAX_COUNT), F.lit(False)))
    rises = F.array_sort(F.array_distinct(ids)) == ids
    counts = ("t", "seq", *COUNTS, "consumers")
    fine = _all([F.col("_e").isNotNull(), *[_count(raw, f"$.{k}").isNotNull() for k in counts], events_ok, rises])
    events = F.transform("_e", lambda e: F.struct(n(e["id"]).alias("id"), e["kind"].alias("kind"), n(e["atUnixMs"]).alias("at_ms"), n(e["expectedSeq"]).alias("expected_seq"), n(e["gotSeq"]).alias("got_seq"), e["reason"].alias("reason"), n(e["durationMs"]).alias("duration_ms")))
    return rows.withColumn("telemetry", F.when(fine, F.struct(*[_count(raw, f"$.{k}").alias(k) for k in counts], events.alias("events")))).drop("_e")


# --- metrics as Prometheus text ----------------------------------------------------------------------------------------


def seconds(n: Column, digits: int) -> Column:
    """A count of 10^-digits seconds as seconds, by integers only."""
    unit = 10**digits
    n = n.cast("bigint")
    rest = F.pmod(n, F.lit(unit))
    whole = ((n - rest) / unit).cast("bigint").cast("string")
    return F.when(rest == 0, whole).otherwise(F.concat(whole, F.lit("."), F.regexp_replace(F.lpad(rest.cast("string"), digits, "0"), "0+$", "")))


def metric_samples(status: DataFrame, prefix: str = "book") -> DataFrame:
    """Samples (KEY, name, labels, value) of feeds: a value that a feed does not have is no row.

    status: KEY, mode, version, started_ms, last_event_ms, delivery and engine counters, latency figures.
    """
    p = lambda name: F.lit(f"{prefix}_{name}")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    s = lambda name, value, labels=none: F.struct(p(name).alias("name"), labels.alias("labels"), value.cast("string").alias("value"))
    moment = lambda ms: F.when(ms > 0, seconds(ms, 3))
    some = F.col("count") > 0
    items = [
        s("build_info", F.lit("1"), F.create_map(F.lit("version"), F.col("version"))),
        s("feed_info", F.lit("1"), F.create_map(F.lit("mode"), F.coalesce("mode", F.lit("unknown")), F.lit("symbol"), F.col("symbol"), F.lit("venue"), F.col("venue"))),
        s("start_time_seconds", moment(F.col("started_ms"))),
        s("engine_last_event_timestamp_seconds", moment(F.col("last_event_ms"))),
        s("hub_consumers", F.col("consumers")),
        *[s(f"hub_{c}_total", F.col(c)) for c in ("delivered", "dropped", "published")],
        *[s(f"engine_{c}_total", F.col(c)) for c in ("gaps", "resyncs", "disconnects", "would_crosses", "checksum_mismatches", "snapshot_rejects", "snapshot_errors")],
        s("source_rejected_frames_total", F.col("rejected")),
        *[s("latency_seconds", F.when(some, seconds(F.col(c), 9)), F.create_map(F.lit("quantile"), F.lit(q))) for q, c in (("0.5", "p50_ns"), ("0.99", "p99_ns"), ("0.999", "p999_ns"))],
        s("latency_seconds_sum", seconds(F.col("sum_ns"), 9)),
        s("latency_seconds_count", F.col("count")),
        s("latency_max_seconds", F.when(some, seconds(F.col("max_ns"), 9))),
    ]
    return status.select(*KEY, F.posexplode(F.array(*items)).alias("place", "m")).select(*KEY, "place", "m.*").where("value is not null")


def metric_lines(samples: DataFrame) -> DataFrame:
    """One text line a sample; backslash, quote and line feed of label values are escaped."""
    escaped = lambda v: F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), ",")
    return samples.withColumn("line", F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), "value"))
