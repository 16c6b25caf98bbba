"""Exact decimals as Columns: parsing and printing scaled integers, and decimal strings of any width.

All functions are null for null and for text outside the grammar `digits[.digits]`; none uses floating point.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = r"^[0-9]+(\.[0-9]+)?$"
MAX_SCALE = 18


def _whole(s: Column) -> Column:
    return F.substring_index(s, ".", 1)


def _fraction(s: Column) -> Column:
    return F.when(F.instr(s, ".") > 0, F.substring_index(s, ".", -1)).otherwise("")


def _strip_zeros(fraction: Column) -> Column:
    return F.regexp_replace(fraction, "0+$", "")


def parse_scaled(s: Column, scale: Column | int) -> Column:
    """A decimal string as an integer at a scale of 0 to 18; null unless it is exact and fits 64 bits."""
    scale = F.lit(scale) if isinstance(scale, int) else scale
    fraction = _strip_zeros(_fraction(s))
    fits = s.rlike(PLAIN) & (scale >= 0) & (scale <= MAX_SCALE) & (F.length(fraction) <= scale)
    return F.when(fits, F.concat(_whole(s), F.rpad(fraction, F.greatest(scale, F.lit(0)), F.lit("0"))).try_cast("bigint"))


def parse_reason(s: Column, scale: Column | int) -> Column:
    """Why parse_scaled refuses: `malformed`, `scale`, `precision` or `overflow`; null if it does not."""
    scale = F.lit(scale) if isinstance(scale, int) else scale
    return (
        F.when((scale < 0) | (scale > MAX_SCALE), "scale")
        .when(s.isNull() | ~s.rlike(PLAIN), "malformed")
        .when(F.length(_strip_zeros(_fraction(s))) > scale, "precision")
        .when(parse_scaled(s, scale).isNull(), "overflow")
    )


def format_scaled(v: Column, scale: Column | int) -> Column:
    """A scaled integer with exactly `scale` digits after the point; a scale below 1 prints an integer, above 18 counts as 18."""
    scale = F.lit(scale) if isinstance(scale, int) else scale
    k = F.least(F.greatest(scale, F.lit(0)), F.lit(MAX_SCALE))
    digits = F.replace(v.cast("string"), F.lit("-"), F.lit(""))
    padded = F.lpad(digits, F.greatest(F.length(digits), k + 1), F.lit("0"))
    point = F.length(padded) - k
    body = F.when(k == 0, padded).otherwise(F.concat(padded.substr(F.lit(1), point), F.lit("."), padded.substr(point + 1, k)))
    return F.concat(F.when(v < 0, "-").otherwise(""), body)


def scale_of_increment(increment: Column) -> Column:
    """Digits after the point that an increment such as 0.01000000 uses; null for an empty or malformed one."""
    fraction = F.regexp_extract(F.regexp_replace(increment, "0+$", ""), r"^[^.]*\.?((?s:.*))$", 1)
    return F.when(F.length(increment) > 0, F.when(fraction.rlike("^[0-9]*$"), F.length(fraction)))


def is_plain_decimal(s: Column) -> Column:
    return F.coalesce(s.rlike(PLAIN), F.lit(False))


def to_scaled(s: Column) -> Column:
    """The digits of a plain decimal as decimal(38,0), at the scale it is written with."""
    return F.when(s.rlike(PLAIN), F.replace(s, F.lit("."), F.lit("")).try_cast("decimal(38,0)"))


def scale_of(s: Column) -> Column:
    """How many characters follow the first point."""
    at = F.instr(s, ".")
    return F.when(at > 0, F.length(s) - at).when(s.isNotNull(), 0)


def from_scaled(v: Column, scale: Column | int) -> Column:
    """A non-negative integer with `scale` digits after the point."""
    scale = F.lit(scale) if isinstance(scale, int) else scale
    digits = v.cast("string")
    padded = F.lpad(digits, F.greatest(F.length(digits), scale + 1), F.lit("0"))
    point = F.length(padded) - scale
    return F.when(scale == 0, padded).otherwise(F.concat(padded.substr(F.lit(1), point), F.lit("."), padded.substr(point + 1, scale)))


def trim_fraction(s: Column) -> Column:
    """A decimal with a point, without the zeros at its end (and without the point if nothing is left after it)."""
    return F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", "")


def parse_levels(raw: Column, price_scale: Column, size_scale: Column) -> Column:
    """[[price, size, ...], ...] strings as integer levels; null if any level is short or malformed. Missing: no levels."""
    raw = F.coalesce(raw, F.array().cast("array<array<string>>"))
    levels = F.transform(raw, lambda x: F.struct(parse_scaled(F.get(x, F.lit(0)), price_scale).alias("price"), parse_scaled(F.get(x, F.lit(1)), size_scale).alias("size")))
    fine = lambda l: F.forall(l, lambda x: x["price"].isNotNull() & x["size"].isNotNull())
    # bound as a lambda's argument, the levels are parsed once for both uses
    return F.transform(F.array(levels), lambda l: F.when(fine(l), l))[0]


def levels_as_strings(levels: Column, price_scale: Column | int, size_scale: Column | int) -> Column:
    return F.transform(levels, lambda x: F.array(format_scaled(x["price"], price_scale), format_scaled(x["size"], size_scale)))


# --- figures of a book, from decimal strings -------------------------------------------------------------------------


def crossed(bid: Column, ask: Column) -> Column:
    """Best bid at or above best ask (a locked book counts)."""
    return to_scaled(bid) >= to_scaled(ask)


def spread(bid: Column, ask: Column) -> Column:
    """Ask less bid at the ask's scale."""
    gap = to_scaled(ask) - to_scaled(bid)
    return F.concat(F.when(gap < 0, "-").otherwise(""), from_scaled(F.abs(gap), scale_of(ask)))


def spread_ticks(bid: Column, ask: Column) -> Column:
    return F.when(is_plain_decimal(bid) & is_plain_decimal(ask) & (scale_of(bid) == scale_of(ask)), (to_scaled(ask) - to_scaled(bid)).cast("string"))


def mid(bid: Column, ask: Column) -> Column:
    """Mid price, one digit finer than the prices; null if a side is missing or the scales differ."""
    ok = is_plain_decimal(bid) & is_plain_decimal(ask) & (scale_of(bid) == scale_of(ask))
    return F.when(ok, from_scaled(((to_scaled(bid) + to_scaled(ask)) * F.lit(5)).cast("decimal(38,0)"), scale_of(bid) + 1))


def mid_change(oldest: Column, newest: Column) -> Column:
    """Newest less oldest with its sign (a real minus sign), unsigned if zero; null if the scales differ."""
    ok = is_plain_decimal(oldest) & is_plain_decimal(newest) & (scale_of(oldest) == scale_of(newest))
    diff = to_scaled(newest) - to_scaled(oldest)
    sign = F.when(diff < 0, "−").when(diff > 0, "+").otherwise("")
    return F.when(ok, F.concat(sign, from_scaled(F.abs(diff).cast("decimal(38,0)"), scale_of(oldest))))


def gap(bids: Column, asks: Column) -> Column:
    """Spread and mid of a view of string levels; null if one-sided, crossed or of two scales."""
    bid, ask = F.get(F.get(bids, F.lit(0)), F.lit(0)), F.get(F.get(asks, F.lit(0)), F.lit(0))
    return F.when(~crossed(bid, ask) & mid(bid, ask).isNotNull(), F.struct(spread(bid, ask).alias("spread"), mid(bid, ask).alias("mid")))


# --- display strings -------------------------------------------------------------------------------------------------


def group_thousands(s: Column) -> Column:
    """Commas between every three digits of the whole part; other text as it is."""
    whole = F.regexp_replace(F.regexp_extract(s, r"^-?([0-9]+)", 1), r"(?<=[0-9])(?=([0-9]{3})+$)", ",")
    grouped = F.concat(F.regexp_extract(s, "^(-?)", 1), whole, F.regexp_extract(s, r"(\.[0-9]+)?$", 1))
    return F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), grouped).otherwise(s)


def ungroup(s: Column) -> Column:
    return F.replace(s, F.lit(","), F.lit(""))


def split_fraction(s: Column) -> Column:
    """[whole part, fraction with its point]."""
    at = F.instr(s, ".")
    return F.when(at == 0, F.array(s, F.lit(""))).otherwise(F.array(s.substr(F.lit(1), at - 1), s.substr(at, F.length(s))))


def trim_zeros(size: Column) -> Column:
    """[what to read, zeros at the end of the fraction]: both join back into the size."""
    kept = F.when(F.instr(size, ".") == 0, size).otherwise(trim_fraction(size))
    return F.array(kept, size.substr(F.length(kept) + 1, F.length(size)))


def _tenths(n: Column, unit: int) -> Column:
    return F.concat(((n - n % unit) / unit).cast("bigint").cast("string"), F.lit("."), F.floor((n % unit) / (unit // 10)).cast("string"))


def format_latency(ns: Column) -> Column:
    """Whole nanoseconds in µs, ms or s with one digit, cut; below a microsecond `<1 µs`, unusable `n/a`."""
    return (
        F.when(ns.isNull() | (ns < 0) | (ns > 2**53 - 1), "n/a")
        .when(ns < 1000, "<1 µs")
        .when(ns < 1_000_000, F.concat(_tenths(ns, 1000), F.lit(" µs")))
        .when(ns < 1_000_000_000, F.concat(_tenths(ns, 1_000_000), F.lit(" ms")))
        .otherwise(F.concat(_tenths(ns, 1_000_000_000), F.lit(" s")))
    )


def format_age(ms: Column) -> Column:
    return F.when(ms.isNull() | (ms < 0) | (ms > 2**53 - 1), "n/a").when(ms < 1000, F.concat(ms.cast("string"), F.lit(" ms"))).otherwise(F.concat(_tenths(ms, 1000), F.lit(" s")))


def format_span(ms: Column) -> Column:
    """45 s, 1 min, 1 min 40 s."""
    secs = F.greatest(F.lit(0), F.floor(ms / 1000)).cast("bigint")
    mins, rest = F.floor(secs / 60).cast("string"), (secs % 60).cast("string")
    return F.when(secs < 60, F.concat(secs.cast("string"), F.lit(" s"))).when(secs % 60 == 0, F.concat(mins, F.lit(" min"))).otherwise(F.concat(mins, F.lit(" min "), rest, F.lit(" s")))


def sig3(v: Column) -> Column:
    """Three significant figures, half away from zero."""
    digits = F.floor(F.log10(F.abs(v)))
    small, large = F.pow(F.lit(10.0), 2 - digits), F.pow(F.lit(10.0), digits - 2)
    rounded = F.when(F.abs(v) < 1000, F.floor(F.abs(v) * small + 0.5) / small).otherwise(F.floor(F.abs(v) / large + 0.5) * large)
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * rounded)


def trim_number(v: Column) -> Column:
    """A double of ordinary size without zeros at its end."""
    return F.when(v == F.floor(v), v.cast("decimal(38,0)").cast("string")).otherwise(trim_fraction(v.cast("decimal(38,12)").cast("string")))


def format_metric(unit: Column, v: Column) -> Column:
    """A benchmark figure for its unit: -ns in ns, µs or ms, -pct with a percent sign, counts exact below 1000."""
    ns = F.when(v < 1000, F.concat(trim_number(v), F.lit(" ns"))).when(v < 1e6, F.concat(trim_number(sig3(v / 1e3)), F.lit(" µs"))).otherwise(F.concat(trim_number(sig3(v / 1e6)), F.lit(" ms")))
    other = F.when(F.abs(v) < 1000, trim_number(v)).otherwise(trim_number(sig3(v)))
    return F.when(unit.endswith("-ns"), ns).when(unit.endswith("-pct"), F.concat(trim_number(sig3(v)), F.lit(" %"))).otherwise(other)


def base_currency(symbol: Column) -> Column:
    """What is before the slash; null without one, or with nothing before it."""
    at = F.instr(symbol, "/")
    return F.when(at > 1, symbol.substr(F.lit(1), at - 1))


#: The titles and sentences of fault kinds.
FAULT_TITLES = {
    "gap": "Sequence gap",
    "cross": "Crossing update rejected",
    "checksum": "Checksum mismatch",
    "disconnect": "Feed disconnected",
    "snapshot-reject": "Snapshot refused",
    "snapshot-error": "Snapshot failed",
}
FAULT_SENTENCES = {
    "cross": "It would have put a bid at or above the ask. Discarded.",
    "checksum": "The book no longer matched the exchange's checksum after an update.",
    "disconnect": "The connection to the exchange dropped.",
}
REBUILD_KINDS = ("gap", "cross", "checksum", "disconnect")


def _capital(s: Column) -> Column:
    return F.concat(F.upper(s.substr(1, 1)), s.substr(F.lit(2), F.length(s)))


def fault_title(kind: Column) -> Column:
    out = F.lit("Fault")
    for k, title in FAULT_TITLES.items():
        out = F.when(kind == k, title).otherwise(out)
    return out


def fault_rebuild(kind: Column, id_: Column, duration_ms: Column, newest_rebuild_id: Column) -> Column:
    """How the rebuild went; only the newest one can still be running. Null for kinds that rebuild nothing."""
    took = (
        F.when((duration_ms == -1) & F.coalesce(id_ == newest_rebuild_id, F.lit(False)), "rebuilding…")
        .when(duration_ms == -1, "rebuild time not recorded")
        .when(duration_ms == 0, "rebuilt from a snapshot in under 1 ms")
        .otherwise(F.concat(F.lit("rebuilt from a snapshot in "), duration_ms.cast("string"), F.lit(" ms")))
    )
    return F.when(kind.isin(*REBUILD_KINDS), took)


def fault_detail(kind: Column, expected: Column, got: Column, reason: Column, rebuild: Column) -> Column:
    what = F.when(kind == "gap", F.when((expected > 0) & (got > 0), F.concat(F.lit("Expected "), expected.cast("string"), F.lit(", got "), got.cast("string"), F.lit("."))).otherwise("An update was missed."))
    for k, sentence in FAULT_SENTENCES.items():
        what = what.when(kind == k, sentence)
    what = what.otherwise(F.concat(_capital(reason), F.lit(".")))
    return F.when(rebuild.isNull(), what).otherwise(F.concat(what, F.lit(" "), _capital(rebuild), F.when(rebuild.endswith("…"), "").otherwise(".")))


def failure_class(status: Column) -> Column:
    """Class of a failed snapshot fetch by its HTTP status; no status is a transport error."""
    return F.when(status.isNull() | (status == 429) | (status >= 500), "transient").otherwise("permanent")


def cut_text(s: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(s, 1, max(n, 0))


def mode_chip(mode: Column, chaos: Column) -> Column:
    """What a source is called: demo, demo-chaos, none for live, unknown."""
    return F.when(mode == "synthetic", F.when(chaos, "demo-chaos").otherwise("demo")).when(mode == "live", "none").otherwise("unknown")
