"""Frames, documents and logs, by the cases a reader must take or refuse."""

import json

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import latency as L
from ledgerline.operators.ordering import synthetic_sequence
from ledgerline.schema import INSTRUMENTS, RAW_FRAMES
from ledgerline.sources import documents as D
from ledgerline.sources import frames as FR
from ledgerline.sources import logs as LG

#: Documents of the wire format, as its specification gives them.
VIEW = '{"venue":"kraken","symbol":"BTC/USD","seq":5,"bids":[["62721.7","1.35823999"],["62721.6","0.05000000"]],"asks":[["62721.8","0.00114202"],["62721.9","2.50000000"]]}'
STATUS = '{"schema":1,"mode":"live","chaos":false,"version":"v1.2.3","venue":"kraken","symbol":"BTC/USD","startedAtUnixMs":1699999000000,"depth":10,"lastEventAgeMs":1500,"delivery":{"consumers":1,"delivered":2,"dropped":3,"published":5},"engine":{"gaps":1,"resyncs":2,"disconnects":3,"wouldCrosses":4,"checksumMismatches":5,"snapshotRejects":6,"snapshotErrors":7,"rejected":8},"latency":{"count":3,"p50Ns":1986,"p99Ns":50118,"p999Ns":50118,"maxNs":50000}}'
TELEMETRY = '{"t":1700000000000,"seq":4182,"gaps":1,"resyncs":2,"disconnects":3,"wouldCrosses":4,"checksumMismatches":5,"snapshotRejects":6,"snapshotErrors":7,"rejected":9,"consumers":1,"events":[{"id":1,"kind":"gap","atUnixMs":1699999990000,"expectedSeq":4182,"gotSeq":4185,"reason":"sequence gap","durationMs":38},{"id":2,"kind":"disconnect","atUnixMs":1699999995000,"expectedSeq":0,"gotSeq":0,"reason":"source disconnected","durationMs":-1}]}'


def routes(spark, reader, frames, scales=(1, 8)):
    rows = spark.createDataFrame([("v", "s", i, 0, f) for i, f in enumerate(frames)], RAW_FRAMES)
    inst = spark.createDataFrame([("v", "s", *scales, 0, False)], INSTRUMENTS)
    return reader(rows, inst).orderBy("arrival")


def kraken(kind, bids="[]", asks="[]"):
    return f'{{"channel":"book","type":"{kind}","data":[{{"symbol":"BTC/USD","bids":{bids},"asks":{asks},"checksum":7}}]}}'


def test_kraken_routes(spark):
    frames = {
        kraken("snapshot", '[{"price":45283.5,"qty":0.10000000}]', '[{"price":45285.2,"qty":0.00100000}]'): "snapshot",
        kraken("update", '[{"price":45283.5,"qty":0.0}]'): "update",
        '{"channel":"heartbeat"}': "ignored",
        '{"method":"subscribe","success":true}': "ignored",
        '{"method":"pong"}': "ignored",
        '{"channel":"ticker","data":[{"symbol":"x"}]}': "ignored",
        "not json": "rejected",
        kraken("update", '[{"price":1.5,"qty":1}]')[:-8]: "rejected",
        '{"channel":"book","type":"update","data":[]}': "rejected",
        kraken("pong"): "rejected",
        kraken("update", '[{"price":4.5e4,"qty":1}]'): "rejected",
        kraken("update", '[{"price":-0,"qty":1}]'): "rejected",
        kraken("update", '[{"price":45283.55,"qty":1}]'): "rejected",
        kraken("update", '[{"price":"45283.5","qty":"0.00005100"}]'): "update",
        kraken("update", '[{"price":45283.5,"qty":0.00005100}]'): "update",
    }
    got = routes(spark, FR.kraken_frames, list(frames)).collect()
    assert [(r["raw"], r["route"]) for r in got] == list(frames.items())
    assert got[0]["bids"][0]["price"] == 452835 and got[0]["asks"][0]["size"] == 100000 and got[0]["checksum"] == 7
    assert got[-1]["bids"][0]["size"] == 5100


def test_kraken_sequence(spark):
    frames = [kraken("snapshot"), kraken("update"), '{"channel":"heartbeat"}', kraken("update", '[{"price":1e3,"qty":1}]'), kraken("update")]
    got = synthetic_sequence(routes(spark, FR.kraken_frames, frames)).orderBy("arrival").collect()
    assert [r["seq"] for r in got] == [1, 2, None, None, 3]


def test_binance_routes(spark):
    up = lambda b, a="[]", e="depthUpdate": f'{{"e":"{e}","E":5,"s":"X","U":100,"u":101,"b":{b},"a":{a}}}'
    frames = {
        up('[["100.0","1.00000000"]]'): "update",
        up("[]"): "update",
        up('[["100.0","1.0","extra"]]'): "update",
        '{"result":null,"id":1}': "ignored",
        up("[]", e="trade"): "ignored",
        up('[["100.0"]]'): "rejected",
        up('[["x","1"]]'): "rejected",
        up('[[100.0,"1"]]'): "rejected",
        up('[["100.0","1"]]')[:-3]: "rejected",
        "": "rejected",
    }
    got = routes(spark, FR.binance_frames, list(frames)).collect()
    assert [(r["raw"], r["route"]) for r in got] == list(frames.items())
    assert (got[0]["first_seq"], got[0]["last_seq"], got[0]["bids"][0]["price"]) == (100, 101, 1000)


def test_binance_snapshot(spark):
    got = routes(spark, FR.binance_snapshots, ['{"lastUpdateId":100,"bids":[["100.0","1.0"]],"asks":[["101.0","1.0"]]}', '{"lastUpdateId":1,"bids":[["1"]]}']).collect()
    assert [r["route"] for r in got] == ["snapshot", "rejected"] and got[0]["last_seq"] == 100


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, document string")


def test_view_rules(spark):
    bad = [
        VIEW.replace('"seq":5', '"seq":-5'), VIEW.replace('"seq":5', '"seq":1.5'), VIEW.replace('"venue":"kraken",', ""), VIEW.replace('"62721.6"', '"62721.60"'), VIEW.replace('"62721.6"', '"62721.7"'),
        VIEW.replace('"62721.9"', '"62721.8"'), VIEW.replace('"1.35823999"', '"1e3"'), VIEW.replace('"0.05000000"', '"0.5"'), VIEW[:-1], VIEW.replace('"asks"', '"x"'), "null",
        VIEW.replace('["62721.6","0.05000000"]', '["62721.6"]'), VIEW.replace('["62721.6","0.05000000"]', '["62721.6","0.05000000","x"]'),
    ]
    good = [VIEW, VIEW.replace('"0.05000000"', '"0.00000000"'), '{"venue":"v","symbol":"s","seq":0,"bids":[],"asks":[]}', VIEW.replace('["62721.8"', '["62721.0"')]
    got = [r["view"] for r in D.parse_view(docs(spark, good + bad), "document").orderBy("i").collect()]
    assert all(v is not None for v in got[: len(good)]) and all(v is None for v in got[len(good) :])
    assert got[0]["bids"][0] == ["62721.7", "1.35823999"]


def test_status_rules(spark):
    doc = json.loads(STATUS)
    bad = [json.dumps({k: v for k, v in doc.items() if k != key}, separators=(",", ":")) for key in doc if key != "latency"]
    bad += [json.dumps(doc | {"engine": {k: v for k, v in doc["engine"].items() if k != key}}) for key in doc["engine"]]
    bad += [json.dumps(doc | x) for x in ({"schema": 2}, {"mode": "x"}, {"latency": None}, {"latency": {"count": 1}}, {"lastEventAgeMs": -2}, {"depth": -1}, {"depth": 1.5}, {"chaos": "true"}, {"version": 1})]
    good = [STATUS, json.dumps({k: v for k, v in doc.items() if k != "latency"}), json.dumps(doc | {"new": 1}), json.dumps(doc | {"lastEventAgeMs": -1})]
    got = [r["status"] for r in D.parse_status(docs(spark, good + bad)).orderBy("i").collect()]
    assert all(s is not None for s in got[: len(good)])
    assert [b for b, s in zip(bad, got[len(good) :]) if s is not None] == []
    assert got[0]["latency"]["p99Ns"] == 50118 and got[1]["latency"] is None and got[0]["engine"]["rejected"] == 8


def test_telemetry_rules(spark):
    doc = json.loads(TELEMETRY)
    bad = [json.dumps({k: v for k, v in doc.items() if k != key}) for key in doc]
    e = doc["events"]
    bad += [json.dumps(doc | {"events": x}) for x in ([e[1], e[0]], [e[0], e[0]], [{k: v for k, v in e[0].items() if k != "reason"}], [e[0] | {"durationMs": -2}], None)]
    got = [r["telemetry"] for r in D.parse_telemetry(docs(spark, [TELEMETRY, json.dumps(doc | {"events": []})] + bad)).orderBy("i").collect()]
    assert got[0]["events"][1]["duration_ms"] == -1 and got[1]["events"] == [] and all(t is None for t in got[2:])


def test_metric_text(spark):
    row = {"venue": "kraken", "symbol": 'B"T\\C', "mode": None, "version": "v1", "started_ms": 1699999000123, "last_event_ms": 0, "consumers": 1, "delivered": 2, "dropped": 3, "published": 5, "gaps": 1, "resyncs": 2, "disconnects": 3, "would_crosses": 4, "checksum_mismatches": 5, "snapshot_rejects": 6, "snapshot_errors": 7, "rejected": 8, "count": 3, "sum_ns": 53000, "max_ns": 50000, "p50_ns": 1986, "p99_ns": 50118, "p999_ns": 50118}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if k in ('venue', 'symbol', 'mode', 'version') else 'bigint'}" for k in row))
    lines = [r["line"] for r in D.metric_lines(D.metric_samples(df)).orderBy("place").collect()]
    for want in ('book_feed_info{mode="unknown",symbol="B\\"T\\\\C",venue="kraken"} 1', "book_start_time_seconds 1699999000.123", 'book_latency_seconds{quantile="0.5"} 0.000001986', "book_latency_seconds_sum 0.000053", "book_latency_max_seconds 0.00005", "book_hub_dropped_total 3"):
        assert want in lines
    assert not any("last_event" in x for x in lines)


def bench(spark, text):
    df = spark.createDataFrame([("l", i, x) for i, x in enumerate(text.split("\n"))], "log string, line_no int, value string")
    return LG.bench_lines(df)


def test_bench_log(spark):
    text = "﻿# tree: clean\r\n# cpu: x: y\r\ngoos: linux\nBenchmarkA-4 1 5 ns/op 2.5 a-ns 7 late\r\nBenchmarkA-4 1 5 ns/op 3.5 a-ns 9 late\nok"
    facts, values, problems = bench(spark, text)
    assert {(r["key"], r["fact"]) for r in facts.collect()} == {("tree", "clean"), ("cpu", "x: y")}
    assert problems.count() == 0
    got = {r["metric"]: (r["median"], r["low"], r["high"]) for r in L.run_summary(values).collect()}
    assert got == {"a-ns": (3.0, 2.5, 3.5), "late": (8.0, 7.0, 9.0)}
    assert LG.run_problems(values, 2).count() == 0 and LG.run_problems(values, 3).count() == 1


@pytest.mark.parametrize("text", ["# tree: clean\nBenchmarkA-4 1 5 ns/op 2.5", "# tree: clean\nBenchmarkA-4 1 x a-ns", "# tree: clean\nnothing", "# tree: dirty\nBenchmarkA-4 1 1 a-ns", "BenchmarkA-4 1 1 a-ns"])
def test_bench_log_refused(spark, text):
    assert bench(spark, text)[2].count() >= 1


def test_capture(spark, tmp_path):
    ok = {"schema": 1, "venue": "kraken", "symbol": "T", "start": "x", "window_ns": 60, "resolution_ns": 1000, "total_samples": 1000, "tail_ns": list(range(2000, 202000, 1000))}
    bad = [ok | x for x in ({"schema": 2}, {"window_ns": 0}, {"symbol": ""}, {"tail_ns": []}, {"total_samples": 10}, {"tail_ns": [5000, 4000]}, {"tail_ns": [1000]}, {"tail_ns": [4 * 10**12]})]
    for i, d in enumerate([ok, *bad]):
        (tmp_path / f"{i}.json").write_text(json.dumps(d))
    captures = LG.read_captures(spark, str(tmp_path))
    assert LG.check_captures(captures).where("problem is null").count() == 1
    s = LG.capture_samples(captures)
    assert s.count() == 200 and s.first()["total_samples"] - 200 == 800
    t = L.tail_figures(s, ["venue", "symbol"]).first()
    assert t["p50_ns"] == 2000 + 1000 * int(0.5 * 199)


def test_histogram_golden(spark):
    df = spark.createDataFrame([("f", 1000), ("f", 2000), ("f", 50000)], "feed string, ns bigint")
    h = L.histogram(df, ["feed"])
    assert L.totals(h, ["feed"]).first()[1:4] == (3, 53000, 50000)
    q = L.quantiles(h, ["feed"], {"p50": 0.5, "p99": 0.99})
    assert (q.first()["p50"], q.first()["p99"]) == (1986, 50118)
    many = L.quantiles(L.histogram(spark.range(1, 1001).select(F.lit("f").alias("feed"), (F.col("id") * 1000).alias("ns")), ["feed"]), ["feed"], {"a": 0.5, "b": 0.9, "c": 0.99}).first()
    for got, want in zip(many[1:], (500_000, 900_000, 990_000)):
        assert abs(got - want) <= 0.02 * want
