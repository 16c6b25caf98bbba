import pytest
from pyspark.sql import functions as F

from ledgerline.functions import scalars as S

PARSE = [
    ("123.45", 2, 12345), ("1.5", 4, 15000), ("60220.02000000", 2, 6022002), ("5.000", 2, 500), ("9223372036854775807", 0, 9223372036854775807),
    ("9223372036854775808", 0, None), ("1.5", 18, 1500000000000000000), (".5", 2, None), ("5.", 2, None), ("1.50001", 4, None), ("1.2.3", 2, None),
    ("", 2, None), ("-1", 2, None), ("1e3", 2, None), ("1", -1, None), ("1", 19, None), ("007", 0, 7), ("0.0", 0, 0), (None, 2, None),
]
FORMAT = [(5, 4, "0.0005"), (0, 2, "0.00"), (-5, 2, "-0.05"), (5, -1, "5"), (12345, 2, "123.45"), (-(2**63), 0, str(-(2**63))), (1, 1000, "0." + "0" * 17 + "1")]


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_parse_scaled(spark):
    df = spark.createDataFrame([(i, s, k) for i, (s, k, _) in enumerate(PARSE)], "i int, s string, k int").select("i", S.parse_scaled(F.col("s"), F.col("k")), S.parse_reason(F.col("s"), F.col("k")))
    got = sorted(df.collect())
    assert [r[1] for r in got] == [w for _, _, w in PARSE]
    assert all((r[1] is None) == (r[2] is not None) for r in got)


def test_format_scaled(spark):
    df = spark.createDataFrame([(i, v, k) for i, (v, k, _) in enumerate(FORMAT)], "i int, v bigint, k int").select("i", S.format_scaled(F.col("v"), F.col("k")))
    assert [r[1] for r in sorted(df.collect())] == [w for *_, w in FORMAT]


@pytest.mark.parametrize("inc,want", [("0.01000000", 2), ("0.00001000", 5), ("1.00000000", 0), ("10", 0), ("", None), ("0.0x", None), ("1.", 0)])
def test_scale_of_increment(spark, inc, want):
    assert one(spark, S.scale_of_increment(F.lit(inc)))[0] == want


def test_figures(spark):
    r = one(spark, S.spread(F.lit("62721.7"), F.lit("62721.8")), S.mid(F.lit("62721.7"), F.lit("62721.8")), S.spread_ticks(F.lit("1.0"), F.lit("1.25")), S.mid(F.lit("1.0"), F.lit("1.25")), S.mid_change(F.lit("10.00"), F.lit("9.50")), S.mid_change(F.lit("9.50"), F.lit("9.50")), S.crossed(F.lit("2"), F.lit("2")))
    assert tuple(r) == ("0.1", "62721.75", None, None, "−0.50", "0.00", True)


def test_display(spark):
    r = one(spark, S.group_thousands(F.lit("1234567.891")), S.group_thousands(F.lit("-1234")), S.group_thousands(F.lit("n/a")), S.split_fraction(F.lit("62,721.75")), S.trim_zeros(F.lit("0.50000000")), S.trim_zeros(F.lit("2.00000000")), S.trim_zeros(F.lit("10")))
    assert tuple(r) == ("1,234,567.891", "-1,234", "n/a", ["62,721", ".75"], ["0.5", "0000000"], ["2", ".00000000"], ["10", ""])
    r = one(spark, S.format_latency(F.lit(999)), S.format_latency(F.lit(36200)), S.format_latency(F.lit(2530000)), S.format_latency(F.lit(-1)), S.format_age(F.lit(1550)), S.format_span(F.lit(100000)), S.format_span(F.lit(60000)), S.format_span(F.lit(45999)))
    assert tuple(r) == ("<1 µs", "36.2 µs", "2.5 ms", "n/a", "1.5 s", "1 min 40 s", "1 min", "45 s")
    r = one(spark, S.format_metric(F.lit("p50-ns"), F.lit(399.0)), S.format_metric(F.lit("p50-ns"), F.lit(2170.0)), S.format_metric(F.lit("x-ns"), F.lit(2530000.0)), S.format_metric(F.lit("util-pct"), F.lit(19.8)), S.format_metric(F.lit("sender-late"), F.lit(271.5)), S.format_metric(F.lit("over"), F.lit(13340.0)))
    assert tuple(r) == ("399 ns", "2.17 µs", "2.53 ms", "19.8 %", "271.5", "13300")
