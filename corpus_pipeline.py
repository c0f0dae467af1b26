"""Corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; it is written as Parquet and read again as the next
stage's documents, so a lost executor costs a part of one stage. All but the last keep the columns of documents.

Defined cases: a null or empty text fails the quality rules, so it goes in the first stage; documents without an id pass
like others, equal ones as one; of equal texts the largest id stays, of linked ones the smallest (no id counts as smallest),
of repeated rows one; very long texts are judged, compared, scanned and packed whole; an empty table gives no rows; other
columns pass up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clientlens.llm.bpe import vocabulary_path
from clientlens.llm.common import documents, scratch_path, written
from clientlens.llm.exact_dedup import DigestIndex, deduplicated
from clientlens.llm.jaccard_join import representatives
from clientlens.llm.packing import packed
from clientlens.llm.quality_rules import accepted
from clientlens.llm.secret_scan import redacted


#: Words and chunks that a worker of the last stage remembers: its JVM is as large by then as the stages before made it.
TEXTS_KEPT = 690_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return accepted(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return deduplicated(docs, DigestIndex(spark, scratch_path(spark, "digest-index")))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by five-word shingles at a similarity of 0.8, one stays."""
    return representatives(docs, width=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return packed(docs, vocabulary_path(), texts_kept=TEXTS_KEPT)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("n-gram Jaccard join", jaccard_join),
          ("secret scans", secret_scans), ("packing", packing)]

#: Distances, components and packing are not expressible in SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
