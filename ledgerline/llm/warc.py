"""WARC archives as a Spark data source: a writer that commits, and a splittable reader.

An archive is a gzip file whose records are members of their own, so a reader can start at any of them. A reading task
has a byte range of a file. It scans its range for the magic bytes of a member; a candidate counts if the member's first
bytes decode to a WARC header and the whole member decodes with its checksum, and so on for the members behind it, up to
the end of the range. A chain of members that breaks off earlier was no chain of records, but bytes within one that
happen to look like them (say, an archive stored within a record), and the scan goes on after its first byte. A task owns
the records that start in its range and reads the last one to its end. It holds a record and a block of bytes.

What the scan took for records is proven by `untiled`: the records of a file must cover it from its first byte to its
last, each byte once. Damaged files, and archives within records that are longer than a range, show there.

The writer rolls files at a size, into a folder that belongs to the job; the commit moves the files of tasks that ended
well. Files are reached through Arrow's file systems (local, HDFS, S3, GCS), from every executor.
"""

from __future__ import annotations

import hashlib
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import if_small, read, settle, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a reading task's range, of a block read at a time, and of an archive file.
RANGE, BLOCK, ROLL = 32 << 20, 1 << 20, 1 << 30
#: Payloads under so many bytes are stored again and again rather than revisited.
SHORT = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary, file string, file_bytes long, at long, until long"


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


# --- records as bytes -------------------------------------------------------------------------------------------------


def one_line(value: str) -> bytes:
    """A header value; line ends in it are escaped, so that it cannot end the header."""
    return value.replace("\r", "%0D").replace("\n", "%0A").encode()


def record_bytes(kind: str, headers: list[tuple[str, str | None]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member; headers without a value are left out."""
    lines = [b"WARC/1.1", b"WARC-Type: " + kind.encode()]
    lines += [name.encode() + b": " + one_line(value) for name, value in headers if value is not None]
    lines.append(b"Content-Length: %d" % len(block))
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packed.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packed.flush()


def http_block(n_bytes: int, payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes + payload


def header_fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines)
    return {name.strip().decode(errors="replace").lower(): value.strip().decode(errors="replace") for name, _, value in pairs}


def parsed(data: bytes) -> dict:
    """Fields of a record: those of its header, and of the HTTP response within it."""
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = header_fields(head.split(b"\r\n")[1:])
    block = rest[: int(warc["content-length"])]
    bare = lambda name: warc[name].strip("<>") if name in warc else None
    out = {"record_id": bare("warc-record-id"), "record_type": warc.get("warc-type"), "target_uri": warc.get("warc-target-uri"), "date": warc.get("warc-date"), "refers_to": bare("warc-refers-to"), "payload_digest": (warc.get("warc-payload-digest") or "").removeprefix("sha256:") or None, "payload_bytes": None, "payload": None}
    if warc.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = header_fields(http.split(b"\r\n")[1:]).get("content-length")
        if out["record_type"] == "revisit":
            out["payload_bytes"] = int(told) if told else None
        else:
            out |= {"payload": payload, "payload_bytes": len(payload)}
    return out


# --- reading ----------------------------------------------------------------------------------------------------------


class Blocks:
    """Bytes of a file from any place on, a block at a time."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.first, self.data = file, size, 0, b""

    def at(self, place: int) -> bytes:
        """The bytes from place to the end of its block; none at the end of the file."""
        if not self.first <= place < self.first + len(self.data):
            self.first = place
            self.data = self.file.read_at(min(BLOCK, self.size - place), place) if place < self.size else b""
        return self.data[place - self.first :]

    def magic(self, place: int, end: int) -> int:
        """The first place from `place` on, and before `end`, where a member may start; end if there is none."""
        while place < end:
            data = self.at(place)
            if len(data) < len(MAGIC):
                self.first, self.data = place, self.file.read_at(min(BLOCK, self.size - place), place)
                data = self.data
            found = data.find(MAGIC)
            if found >= 0:
                return min(end, place + found)
            if place + len(data) >= self.size:
                return end
            place += max(1, len(data) - len(MAGIC) + 1)
        return end

    def member(self, place: int, keep: bool) -> tuple[int, bytes] | None:
        """Where the member that starts at place ends, and its content if asked for; None if there is no whole record."""
        inflate, kept, seen, began = zlib.decompressobj(31), [], b"", place
        try:
            while not inflate.eof:
                data = self.at(place)
                if not data:
                    return None
                out = inflate.decompress(data)
                if len(seen) < 7:
                    seen += out[:7]
                    if seen[:7] != b"WARC/1."[: len(seen)]:
                        return None
                if keep:
                    kept.append(out)
                place += len(data) - len(inflate.unused_data)
        except zlib.error:
            return None
        return (place, b"".join(kept)) if len(seen) >= 7 and place > began else None

    def chained(self, place: int, end: int) -> bool:
        """Whether records follow each other from place to the end of the range, or of the file."""
        while place < end:
            found = self.member(place, keep=False)
            if found is None:
                return False
            place = found[0]
        return place >= self.size or self.at(place)[:1] == MAGIC[:1]

    def records(self, start: int, end: int) -> Iterator[tuple[int, int, bytes]]:
        """Start, end and content of the records that start in a range."""
        place = self.magic(start, end)
        while place < end and not self.chained(place, end):
            place = self.magic(place + 1, end)
        while place < end:
            found = self.member(place, keep=True)
            if found is None:
                return
            yield place, found[0], found[1]
            place = found[0]


@dataclass
class Range(InputPartition):
    """A byte range of a file."""

    path: str
    size: int
    start: int
    end: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        store, path = located(self.path)
        info = store.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(path))
        named = [f for f in files if f.type == pafs.FileType.File and f.path.endswith((".warc.gz", ".warc"))]
        return [Range(f.path, f.size, at, min(f.size, at + self.size)) for f in named for at in range(0, f.size, self.size)] or [Range("", 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        store, _ = located(self.path)
        rows, held = [], 0
        with store.open_input_file(part.path) as file:
            for at, until, data in Blocks(file, part.size).records(part.start, part.end):
                row = parsed(data)
                if row["payload"] is not None and row["payload_digest"] and hashlib.sha256(row["payload"]).hexdigest() != row["payload_digest"]:
                    raise ValueError(f"payload of {row['record_id']} in {part.path} at {at} does not match its digest")
                rows.append(row | {"file": part.path, "file_bytes": part.size, "at": at, "until": until})
                held += len(data)
                if held > BLOCK:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)


# --- writing ----------------------------------------------------------------------------------------------------------


@dataclass
class Files(WriterCommitMessage):
    """What a task wrote."""

    names: list[str] = field(default_factory=list)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, roll: int, date: str):
        self.path, self.roll, self.date, self.job = path.rstrip("/"), roll, date, f"_job-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Files:
        store, path = located(self.path)
        store.create_dir(f"{path}/{self.job}")
        done, out, size = Files(), None, 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None or size >= self.roll:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{path}/{self.job}/{name}", compression=None)
                        done.names.append(name)
                        info = record_bytes("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", self.date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        out.write(info)
                        size = len(info)
                    data = self.record(row)
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return done

    def record(self, row: dict) -> bytes:
        payload = row["payload"] or b""
        revisit = row["record_type"] == "revisit"
        n = row["payload_bytes"] if revisit else len(payload)
        digest = row["payload_digest"] or hashlib.sha256(payload).hexdigest()
        brackets = lambda x: None if x is None else f"<{x}>"
        headers = [
            ("WARC-Record-ID", brackets(row["record_id"])),
            ("WARC-Date", row.get("date") or self.date),
            ("WARC-Target-URI", row["target_uri"]),
            ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("WARC-Profile", _PROFILE if revisit else None),
            ("WARC-Refers-To", brackets(row["refers_to"]) if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
        ]
        return record_bytes(row["record_type"], headers, http_block(n or 0, b"" if revisit else payload))

    def commit(self, messages: list) -> None:
        store, path = located(self.path)
        for m in messages:
            for name in m.names if m else ():
                store.move(f"{path}/{self.job}/{name}", f"{path}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, path = located(self.path)
        if store.get_file_info(f"{path}/{self.job}").type == pafs.FileType.Directory:
            store.delete_dir(f"{path}/{self.job}")


class WarcSource(DataSource):
    """Format `warc`. Options: path; rangeBytes (reading); rollBytes and date (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options["path"], int(self.options.get("rangeBytes", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to a folder: write in mode append")
        return WarcWriter(self.options["path"], int(self.options.get("rollBytes", ROLL)), self.options.get("date") or time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
ARROW = pa.schema([(name, _TYPES[kind]) for name, kind in (c.strip().split(" ") for c in RECORDS.split(","))])


def read_warc(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """RECORDS of the archives in a folder (or of one), in byte ranges: each with its place in its file.

    A revisit has the size and digest of its full payload but not the payload (see resolved). Records of other types,
    such as warcinfo, come too. A payload that does not match its digest raises an error.
    """
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("rangeBytes", range_bytes).load(path)


def write_warc(records: DataFrame, path: str, roll_bytes: int = ROLL) -> None:
    """Add archives of records (the first eight columns of RECORDS, date may be null) to a folder."""
    records.sparkSession.dataSource.register(WarcSource)
    records.select(*[c for c in ARROW.names[:8]]).write.format("warc").mode("append").option("rollBytes", roll_bytes).save(path)


def untiled(records: DataFrame) -> DataFrame:
    """Files that the records (of read_warc, or their places) do not cover from end to end, each byte once."""
    told = records.groupBy("file", "file_bytes").agg(F.sum(F.col("until") - F.col("at")).alias("covered"), F.min("at").alias("from"), F.max("until").alias("to"))
    return told.where("covered != file_bytes or from != 0 or to != file_bytes")


def resolved(records: DataFrame) -> DataFrame:
    """Records with the payload that revisits refer to. Salted: a response that many refer to is copied, not they sent to it."""
    salts = 16
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("payload").alias("_payload"))
    wanted = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("_id")).distinct()
    responses = responses.dropDuplicates(["_id"]).join(wanted, "_id", "left_semi").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = records.withColumn("_salt", F.pmod(F.xxhash64("file", "at"), F.lit(salts)).cast("int"))
    on = (F.col("refers_to") == F.col("_id")) & (keyed["_salt"] == responses["_salt"])
    joined = keyed.join(responses, on, "left")
    return joined.select(*[(F.coalesce("payload", "_payload") if c == "payload" else keyed[c]).alias(c) for c in records.columns])


def deduplicated(pages: DataFrame, short: int = SHORT) -> DataFrame:
    """Records of pages (page_id, url, payload): of equal payloads of `short` bytes or more one response, the rest revisits.

    The response is the page of the least id; rows that repeat that id and payload are responses too. Rows without an id
    revisit it as others do; where no row of a payload has an id, all are responses. Payloads meet by digest; one that is
    there more than HOT times is told to its rows where they are.
    """
    rows = pages.select("page_id", "url", F.coalesce("payload", F.lit("").cast("binary")).alias("payload")).withColumn("digest", F.sha2("payload", 256))
    long = F.length("payload") >= short
    groups = rows.where(long).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1 and first is not null")
    groups = settle(groups, "warc-copies")
    hot = groups.where(F.col("n") > HOT)
    n_hot = hot.count()
    pick = lambda df, g: df.join(g.select("digest", "first"), "digest", "left")
    if n_hot:
        hot_rows = rows.join(if_small(hot.select("digest"), n_hot), "digest", "left_semi")
        rest = rows.join(if_small(hot.select("digest"), n_hot), "digest", "left_anti")
        marked = pick(hot_rows, if_small(hot, n_hot)).unionByName(pick(rest, groups.where(F.col("n") <= HOT)))
    else:
        marked = pick(rows, groups)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    return marked.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit(None).cast("string").alias("date"),
        F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.col("digest").alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


#: Copies of a payload beyond which its rows do not move to meet.
HOT = 1000


def archived(pages: DataFrame, path: str) -> DataFrame:
    """Pages (page_id, url, payload) written to archives and read back: their records but for the payload, whose bytes and
    digest are those of what was read. Raises an error if the records that were found do not cover the archives."""
    write_warc(deduplicated(pages), path)
    found = read_warc(pages.sparkSession, path).withColumn("payload_digest", F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).otherwise(F.col("payload_digest"))).drop("payload")
    found = settle(found, "warc-records")
    torn = [r["file"] for r in untiled(found).limit(5).collect()]
    if torn:
        raise ValueError(f"records do not cover {torn}")
    return found.where("record_type in ('response', 'revisit')")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages after a round trip through archives."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    found = archived(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    return found.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


OP13_SQL = r"""
with p as (select page_id, strlen(coalesce(html, '')) payload_bytes, sha256(coalesce(html, '')) payload_digest from pages),
f as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) end least from p)
select page_id, payload_bytes, payload_digest, case when least is distinct from page_id and least is not null then 'revisit' else 'response' end record_type,
  case when least is distinct from page_id then least end refers_to
from f
"""
