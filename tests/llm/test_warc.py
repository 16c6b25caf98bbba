"""Archives: round trips, splits at every place, look-alikes within records, damage, crashes of the writer."""

import gzip
import hashlib
import io
import os
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import warc as W
from ledgerline.llm.common import shared_dir

from ..conftest import SF


def folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{os.urandom(6).hex()}"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, payload binary, `digest` string, `a.b` int")


def row(page_id, payload, url="http://x/"):
    return (page_id, url, None if payload is None else payload.encode() if isinstance(payload, str) else payload, "clash", 1)


COLS = ("record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
sha = lambda b: hashlib.sha256(b).hexdigest()


def archive(records):
    return b"".join(records)


def one(payload, name="urn:page:1", level=6):
    return W.record_bytes("response", [("WARC-Record-ID", f"<{name}>"), ("Content-Type", "application/http; msgtype=response")], W.http_block(len(payload), payload), level)


def ranges(data, size):
    """The records that tasks of `size` bytes find, in order."""
    out = []
    for at in range(0, len(data), size):
        out += W.Blocks(pa.PythonFile(io.BytesIO(data), "r"), len(data)).records(at, min(len(data), at + size))
    return [(a, b, W.parsed(d)["payload"]) for a, b, d in out]


def split_into(sizes):
    rng = random.Random(1)
    payloads = [rng.randbytes(rng.randint(0, 300)) for _ in range(40)]
    data = archive(one(p) for p in payloads)
    for size in (*sizes, len(data)):
        got = ranges(data, size)
        assert [p for _, _, p in got] == payloads
        assert got[0][0] == 0 and got[-1][1] == len(data) and all(x[1] == y[0] for x, y in zip(got, got[1:]))


def test_every_split():
    """Whatever the ranges, each record has one owner."""
    split_into((*range(1, 12), 25, 39, 100, 333, 1000))


def test_blocks_smaller_than_records(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 7)
    split_into((5, 50, 333, 1000))


def test_look_alikes():
    """Magic bytes, gzip members, and whole archives stored within records are not records."""
    rng = random.Random(2)
    inner = archive(one(rng.randbytes(3000), f"urn:page:{k}") for k in range(3))
    stored = [rng.randbytes(500) + x + rng.randbytes(500) for x in (W.MAGIC * 50, gzip.compress(b"WARC/1.1 is not a header of mine"), gzip.compress(rng.randbytes(900)), inner)]
    payloads = [b"a", *stored, b"b" * 1000, *stored]
    data = archive(one(p, level=0) for p in payloads)
    assert data.count(inner) == 2  # stored as it is
    for size in (15_000, 20_000, 40_000, len(data)):
        assert [p for _, _, p in ranges(data, size)] == payloads


def test_readable_elsewhere(spark):
    """Any gzip reader gets the records one after the other, in the form that the standard asks for."""
    path = folder(spark, "plain")
    W.write_warc(W.deduplicated(pages(spark, [row(1, "x" * 200), row(2, "x" * 200, "http://a/\r\nWARC-Type: warcinfo")]).coalesce(1)), path)
    (name,) = [f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".gz")]
    text = gzip.open(os.path.join(path.removeprefix("file:"), name)).read()
    assert text.count(b"WARC/1.1\r\n") == 3 and text.count(b"\nWARC-Type: warcinfo\r\n") == 1
    assert b"WARC-Refers-To: <urn:page:1>" in text and b"http://a/%0D%0AWARC-Type: warcinfo\r\n" in text


def test_rows(spark):
    """Nulls in every column, empty and short payloads, ties, repeated rows, ids beyond 2^53, payloads of any bytes."""
    big = "y" * 100_000
    rows = [row(1, None), row(2, ""), row(3, "s" * 99), row(4, "s" * 99), row(5, "t" * 100), row(6, "t" * 100), row(6, "t" * 100), row(None, "t" * 100), row(None, "n" * 100), row(None, "n" * 100), row(8, "u" * 100, None), row(8, "u" * 100), row(2**62 + 1, big), row(2**62, big), row(9, bytes(range(256)))]
    got = W.archived(pages(spark, rows), folder(spark, "rows")).select(*COLS).collect()
    urn = lambda k: f"urn:page:{'' if k is None else k}"
    want = []
    for k, _, payload, *_ in rows:
        payload = payload or b""
        ids = [r[0] for r in rows if (r[2] or b"") == payload and r[0] is not None]
        first = min(ids, default=None) if len(payload) >= 100 else None
        again = first is not None and k != first
        want.append((urn(k), "revisit" if again else "response", urn(first) if again else None, len(payload), sha(payload)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    none = W.archived(pages(spark, []), folder(spark, "none"))
    assert none.count() == 0


def test_payload_of_revisits(spark):
    """Revisits get their payload back; a small range splits files among tasks."""
    rng = random.Random(4)
    texts = [bytes(rng.choices(range(97, 123), k=rng.randint(100, 3000))) for _ in range(30)]
    rows = [row(k, texts[min(k % 60, 29)]) for k in range(600)]
    path = folder(spark, "again")
    W.write_warc(W.deduplicated(pages(spark, rows)), path, roll_bytes=20_000)
    found = W.read_warc(spark, path, range_bytes=3000)
    assert W.untiled(found).count() == 0 and found.select("file").distinct().count() > 2
    got = W.resolved(found).where("record_type != 'warcinfo'").select("record_id", "payload").collect()
    assert sorted(map(tuple, got)) == sorted((f"urn:page:{r[0]}", r[2]) for r in rows)
    assert found.where("record_type = 'revisit'").count() == 570


def test_hot_payload(spark, monkeypatch):
    monkeypatch.setattr(W, "HOT", 5)
    rows = [row(k, "h" * 500 if k % 3 else f"{k % 50}" * 200) for k in range(300)]
    got = {r["record_id"]: r["refers_to"] for r in W.deduplicated(pages(spark, rows)).collect()}
    for k, _, payload, *_ in rows:
        first = min(r[0] for r in rows if r[2] == payload)
        assert got[f"urn:page:{k}"] == (None if k == first else f"urn:page:{first}")


def test_damage_shows(spark):
    """A torn file and a wrong payload are not passed over."""
    path = folder(spark, "torn")
    W.write_warc(W.deduplicated(pages(spark, [row(k, f"{k}" * 300) for k in range(50)]).coalesce(1)), path)
    local = path.removeprefix("file:")
    (name,) = [f for f in os.listdir(local) if f.endswith(".gz")]
    data = bytearray(open(os.path.join(local, name), "rb").read())
    data[len(data) // 2] ^= 0xFF
    open(os.path.join(local, name), "wb").write(data)
    assert W.untiled(W.read_warc(spark, path)).count() == 1


def test_failed_job_leaves_nothing(spark):
    path = folder(spark, "failed")
    bad = W.deduplicated(pages(spark, [row(k, f"{k}" * 300) for k in range(50)])).withColumn("payload", F.when(F.col("record_id") == "urn:page:49", F.raise_error(F.lit("no"))).otherwise(F.col("payload")))
    with pytest.raises(Exception):
        W.write_warc(bad, path)
    local = path.removeprefix("file:")
    assert not os.path.isdir(local) or not [f for f in os.listdir(local) if f.endswith(".gz")]


def test_query(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    got = W.op13_warc(spark, SF).select(*cols).collect()
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(f"select {', '.join(cols)} from ({W.OP13_SQL})").fetchall(), key=str)
