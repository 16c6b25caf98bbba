"""Token counts kept by deltas: additive totals by source, language and tokenizer version.

A batch of changes is reduced to signed sums for each key and written to a new folder; then one record in the log says
that the batch is committed and where its sums are. A batch in the log is never written again, so delivering it twice
does nothing, and a batch that was cut short has no record and does not count.

Every COMPACT batches the last totals and the sums since are added up into new totals, and one record, a head, puts them in
force: it names the totals, an empty new log, and where the ids of all batches before are. Ids are kept in sorted runs, of
which those that are no larger than the newest are merged with it, so an id is written again a few times as the history
doubles, and a look-up touches a few runs. What no head in force names is deleted after GRACE seconds. So a commit reads
and writes as much after a million batches as after ten, but for the few runs, and a reader adds COMPACT small tables.

A record is one file that Spark moves to its place when its job commits: it is there whole or not at all. Files without a
record are left by a crash, are never read, and go in time. One writer at a time; readers need no care as long as they read
what they were given within GRACE seconds.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import children, exists, read, remove, settle, shared_dir, word_count

KEYS = ("source", "lang", "tokenizer")


def signed(changes: DataFrame) -> DataFrame:
    """Sums for each key of a batch of changes (op, source, lang, tokenizer, tokens, old_tokens).

    insert counts a document and its tokens, delete takes them back, revise adds tokens less old_tokens. Null tokens
    count as 0; null keys are keys of their own. Other ops raise an error, as they would corrupt the totals.
    """
    sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(F.col("op"), F.lit("null")))).cast("int"))
    tokens = F.coalesce(F.col("tokens"), F.lit(0)).cast("long")
    change = F.when(F.col("op") == "revise", tokens - F.coalesce(F.col("old_tokens"), F.lit(0))).otherwise(sign * tokens)
    return changes.groupBy(*KEYS).agg(F.sum(sign.cast("long")).alias("n_docs"), F.sum(change.cast("long")).alias("n_tokens"))


#: Batches after which sums are added up into new totals; seconds that readers may go on with what is no longer in force.
COMPACT, GRACE = 8, 3600
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
RECORD = "batch_id string, attempt string"
HEAD = "generation long, totals string, log string, runs array<struct<run:string,n:long>>"
#: Ids in a file of a run.
RUN_FILE = 1_000_000


@dataclass(frozen=True)
class Head:
    """What is in force: totals (none at first), the log of the batches since, and the runs of ids of those before."""

    generation: int = 0
    totals: str | None = None
    log: str = "first"
    runs: tuple[tuple[str, int], ...] = ()
    file: str | None = None


class Rollup:
    """Totals in a folder that driver and executors share.

    Batch ids are any strings but null; an id counts once, whatever it brings later.
    """

    def __init__(self, spark: SparkSession, path: str, compact: int = COMPACT, grace: float = GRACE):
        self.spark, self.path, self.compact, self.grace = spark, path.rstrip("/"), compact, grace

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.mode("append").option("maxRecordsPerFile", RUN_FILE).parquet(f"{self.path}/{path}")

    def _table(self, folder: str, schema: str) -> DataFrame:
        """The records in a folder, none if it is not there yet."""
        if not exists(self.spark, f"{self.path}/{folder}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")

    def _head(self) -> Head:
        if not exists(self.spark, f"{self.path}/heads"):
            return Head()
        row = self._table("heads", HEAD).select("*", F.col("_metadata.file_path").alias("file")).orderBy(F.desc("generation")).first()
        return Head() if row is None else Head(row["generation"], row["totals"], row["log"], tuple((r["run"], r["n"]) for r in row["runs"]), row["file"])

    def _state(self) -> tuple[Head, list[str], list[tuple[str, str]]]:
        """The head, the attempts of its totals (one or none), and (batch, attempt) of its log."""
        head = self._head()
        # bounded: `compact` batches, and one more for each compaction that was cut short
        since = [(r["batch_id"], r["attempt"]) for r in self._table(f"log/{head.log}", RECORD).orderBy("attempt").collect()]
        return head, [head.totals] if head.totals else [], since

    def _sums(self, head: Head, since: list[tuple[str, str]]) -> DataFrame:
        paths = [f"{self.path}/deltas/{head.log}/{attempt}" for _, attempt in since] + ([f"{self.path}/totals/{head.totals}"] if head.totals else [])
        return self.spark.read.schema(SUMS).parquet(*paths) if paths else self.spark.createDataFrame([], SUMS)

    def _runs(self, runs: tuple[tuple[str, int], ...] | list[tuple[str, int]]) -> DataFrame:
        paths = [f"{self.path}/ids/{run}" for run, _ in runs]
        return self.spark.read.schema("batch_id string").parquet(*paths) if paths else self.spark.createDataFrame([], "batch_id string")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing is done, if it was committed before."""
        if batch_id is None:
            raise ValueError("a batch needs an id")
        head, _, since = self._state()
        # a run is sorted: its files are told by their least and largest ids
        if batch_id in (b for b, _ in since) or head.runs and self._runs(head.runs).where(F.col("batch_id") == batch_id).limit(1).count():
            return False
        attempt = uuid.uuid4().hex
        self._write(signed(changes), f"deltas/{head.log}/{attempt}")
        self._write(self.spark.createDataFrame([(batch_id, attempt)], RECORD).coalesce(1), f"log/{head.log}")
        since.append((batch_id, attempt))
        if len(since) >= self.compact:
            self._fold(head, since)
        return True

    def _fold(self, head: Head, since: list[tuple[str, str]]) -> None:
        """New totals out of the last ones and the sums since; in force once their head is written."""
        name = uuid.uuid4().hex
        self._write(added(self._sums(head, since)), f"totals/{name}")
        runs, taken, n = list(head.runs), [], len(since)
        while runs and runs[-1][1] <= n:
            taken.append(runs.pop())
            n += taken[-1][1]
        new = self.spark.createDataFrame([(b,) for b, _ in since], "batch_id string").coalesce(1)
        self._write(self._runs(taken).unionByName(new).orderBy("batch_id") if taken else new.sortWithinPartitions("batch_id"), f"ids/{name}")
        row = (head.generation + 1, name, name, [*runs, (name, n)])
        self._write(self.spark.createDataFrame([row], HEAD).coalesce(1), "heads")
        self._clean()

    def _clean(self) -> None:
        """Delete what is older than the grace time and not named by the head in force."""
        head = self._head()
        named = {"totals": {head.totals}, "log": {head.log}, "deltas": {head.log}, "ids": {run for run, _ in head.runs}, "heads": {(head.file or "").rsplit("/", 1)[-1]}}
        for folder, names in named.items():
            for name, age in children(self.spark, f"{self.path}/{folder}"):
                if name not in names and not name.startswith("_") and age > self.grace:
                    remove(self.spark, f"{self.path}/{folder}/{name}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over committed batches; keys whose sums are all zero are gone.

        Without any committed batch the result is empty.
        """
        head, _, since = self._state()
        return added(self._sums(head, since))


def added(sums: DataFrame) -> DataFrame:
    """Sums by key, without keys that came to nothing."""
    return sums.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")


def document_counts(docs: DataFrame) -> DataFrame:
    """Counts of every whole text by two tokenizer versions: words, and words with punctuation apart."""
    text = F.coalesce(F.col("text"), F.lit(""))
    apart = F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]"), F.lit(0)))
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), word_count(F.col("text")).alias("words"), apart.cast("long").alias("apart"))


def op7_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of all documents after five batches, two of which are delivered twice, with totals made every third batch.

    All documents come in by both tokenizer versions, the second version's counts are revised to hold an end mark each,
    and documents under 50 words are deleted again from both.
    """
    counts = settle(document_counts(read(spark, sf_dir, "documents")), "rollup-counts")
    rollup = Rollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}", compact=3)
    one = lambda op, version, tokens, old=None, where="true": counts.where(where).select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), tokens.alias("tokens"), (F.lit(None).cast("long") if old is None else old).alias("old_tokens"))
    words, apart = F.col("words"), F.col("apart")
    batches = {
        "1-insert-words": one("insert", "words-1", words),
        "2-insert-apart": one("insert", "apart-2", apart),
        "3-revise-apart": one("revise", "apart-2", apart + 1, apart),
        "4-delete-words": one("delete", "words-1", words, where="words < 50"),
        "5-delete-apart": one("delete", "apart-2", apart + 1, where="words < 50"),
    }
    for batch_id, changes in batches.items():
        rollup.commit(batch_id, changes)
    for again in ("3-revise-apart", "1-insert-words"):
        rollup.commit(again, batches[again])
    return rollup.totals()


OP7_SQL = r"""
with c as (select source, lang, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) w, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) + 1 a from documents),
k as (select * from c where w >= 50)
select source, lang, 'words-1' tokenizer, count(*) n_docs, sum(w)::bigint n_tokens from k group by all
union all select source, lang, 'apart-2', count(*), sum(a)::bigint from k group by all
"""
