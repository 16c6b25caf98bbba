"""The corpus pipeline: documents in, packed training sequences out, in stages that each work on all the last one kept.

All but the last stage return the columns of documents; a document that the mix takes more than once is that many rows.
The last returns the fragments of all documents with their text and their place in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm.common import discard, read, settle
from ledgerline.llm.langid import in_known_language
from ledgerline.llm.mixing import mixed_documents
from ledgerline.llm.near_dups import without_near_duplicates
from ledgerline.llm.packing import pack
from ledgerline.llm.suffixes import without_repeats

STAGES = [
    ("language", lambda spark, docs, sf_dir: in_known_language(docs)),
    ("near_duplicates", lambda spark, docs, sf_dir: without_near_duplicates(docs, size=5)),
    ("repeated_passages", lambda spark, docs, sf_dir: without_repeats(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixed_documents(docs)),
    ("packing", lambda spark, docs, sf_dir: pack(docs, texts=True)),
]

#: Near-duplicate links, suffix sorting and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
