"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def group_key(source: Column) -> Column:
    """A non-null key for a nullable string: values sort by code point, null comes last."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def quoted(name: str) -> str:
    """A column's name as a part of an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame, without: tuple[str, ...] = ()) -> Column:
    """All columns of a row as one struct `_row`, so that none of their names meets a working column's."""
    return F.struct(*[F.col(quoted(c)) for c in df.columns if c not in without]).alias("_row")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint directory.

    A temporary folder is used only if the session names none and runs on one machine; a cluster must name one.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ledgerline-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to a new table in the shared folder and read it back, so that its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def _path(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as Spark sees them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, store = _path(spark, path)
    return store.exists(at)


def children(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Names in a folder and their age in seconds; none if it is not there."""
    at, store = _path(spark, path)
    return [(s.getPath().getName(), time.time() - s.getModificationTime() / 1000) for s in store.listStatus(at)] if store.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    at, store = _path(spark, path)
    store.delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of settle() that nothing reads any more."""
    for df in tables:
        remove(df.sparkSession, df.settled_at)


#: Rows of a few short columns that a broadcast may hold.
BROADCAST_ROWS = 200_000


def if_small(df: DataFrame, n_rows: int) -> DataFrame:
    """df for a join, broadcast only if its counted rows are few enough; else Spark deals out both sides."""
    return F.broadcast(df) if n_rows <= BROADCAST_ROWS else df


def power_of_two(n: int, most: int) -> int:
    """The least power of two that is n at least, within 1 and most."""
    p = 1
    while p < n and p < most:
        p *= 2
    return p
