"""From recorded lines of raw frames to the canonical tables, as streams that can stop anywhere.

A line is a JSON text with the feed, arrival, time, type (frame, or snapshot for an answer to a snapshot request) and the
raw text. `ingest` writes feed_events, snapshots and rejects; `replayed` writes views and faults from the same lines. Every
micro-batch writes a folder of its own for each table and then a mark that it is whole. A batch that was cut short comes
again under its number and writes its folders anew; readers see marked batches only. So nothing is lost and nothing doubled
wherever a job stops, and tables may be read while they grow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..operators import replay as R
from ..schema import FAULTS, FEED, FEED_EVENTS, KEY, SNAPSHOTS, VIEWS
from ..sources import frames as FR
from .replay import replay_stream, use_rocksdb

LINE = f"{FEED}, arrival bigint, received_ns bigint, type string, raw string"
REJECTS = f"{FEED}, arrival bigint, reason string, raw string"
TABLES = {"feed_events": FEED_EVENTS, "snapshots": SNAPSHOTS, "rejects": REJECTS, "views": VIEWS, "faults": FAULTS}
Decoder = Callable[[DataFrame, DataFrame], DataFrame]


class Tables:
    """The canonical tables in a folder, by micro-batches. Jobs that write tables of their own have marks of their own."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, job: str, batch: int, tables: dict[str, DataFrame]) -> None:
        """A batch of a job's tables; the same number again replaces it."""
        for name, df in tables.items():
            self._put(df.select(*self.spark.createDataFrame([], TABLES[name]).columns), f"{name}/batch={batch}")
        self._put(self.spark.createDataFrame([(batch,)], "number bigint").coalesce(1), f"marks/{job}/batch={batch}")

    def _put(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{path}")

    def read(self, job: str, name: str) -> DataFrame:
        """A table as far as its batches are whole. Batches come in order, so the last mark tells."""
        last = self.spark.read.schema("number bigint").parquet(f"{self.path}/marks/{job}").agg(F.max("number")).first()[0]
        rows = self.spark.read.schema(f"{TABLES[name]}, batch bigint").parquet(f"{self.path}/{name}")
        return rows.where(F.col("batch") <= F.lit(-1 if last is None else last)).drop("batch")


def lines(text: DataFrame) -> DataFrame:
    """Typed rows of lines (value), with the line itself for those that do not decode."""
    x = F.from_json("value", f"{LINE}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = text.select(x.alias("x"), "value")
    whole = F.col("x.venue").isNotNull() & F.col("x.symbol").isNotNull() & F.col("x.arrival").isNotNull() & F.col("x._corrupt_record").isNull()
    return rows.select("x.*", F.coalesce(whole, F.lit(False)).alias("whole"), "value").drop("_corrupt_record")


def decoded(rows: DataFrame, instruments: DataFrame, decode: Decoder, snapshots: Decoder) -> dict[str, DataFrame]:
    """feed_events, snapshots and rejects of typed rows."""
    good = rows.where("whole")
    events = decode(good.where("type = 'frame'").select(*KEY, "arrival", "received_ns", "raw"), instruments)
    answers = snapshots(good.where("type = 'snapshot'").select(*KEY, "arrival", "received_ns", "raw"), instruments)
    other = rows.where("not whole or type is null or type not in ('frame', 'snapshot')")
    reason = F.when(F.col("whole"), "unknown type").otherwise("not a line of a recording")
    taken = answers.where("route = 'snapshot'").select(*KEY, F.col("arrival").alias("snap_ord"), "arrival", F.col("last_seq").alias("last_update_id"), "bids", "asks", "checksum", F.lit(None).cast("string").alias("error"))
    torn = other.select(*KEY, "arrival", S.cut_text(reason, 200).alias("reason"), F.coalesce("raw", "value").alias("raw"))
    return {"feed_events": FR.to_deltas(events), "snapshots": taken, "rejects": FR.rejects(events).unionByName(FR.rejects(answers)).unionByName(torn)}


def ingest(text: DataFrame, instruments: DataFrame, tables: Tables, checkpoint: str, decode: Decoder = FR.binance_frames, snapshots: Decoder = FR.binance_snapshots) -> StreamingQuery:
    """Starts the stream that writes feed_events, snapshots and rejects of a stream of lines until what is there is read."""

    def put(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            tables.write("ingest", batch, decoded(rows, instruments, decode, snapshots))
        finally:
            rows.unpersist()

    return lines(text).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replayed(text: DataFrame, instruments: DataFrame, tables: Tables, checkpoint: str, options: R.Options = R.Options(), decode: Decoder = FR.binance_frames, snapshots: Decoder = FR.binance_snapshots) -> StreamingQuery:
    """Starts the stream that writes views and faults of a stream of lines; instruments give the windows. A fault whose
    rebuild ends in a later batch comes again under its id, with its duration."""
    use_rocksdb(tables.spark)
    parts = decoded(lines(text), instruments, decode, snapshots)
    out = replay_stream(parts["feed_events"], parts["snapshots"], options, instruments, hot=True)

    def put(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            tables.write("replay", batch, {"views": R.views(rows), "faults": R.faults(rows)})
        finally:
            rows.unpersist()

    return out.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
