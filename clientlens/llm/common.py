"""Shared pieces of the corpus operators: row keys, folds, Arrow steps, staged tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientlens.session import forget, scratch_path, written

#: Prefix of helper columns, so that columns of the input never clash with them.
OWN = "_llm_"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/labels.parquet")


def content(text: str) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


#: Ids from here on are those of documents; smaller ones stand for missing ids.
LEAST_ID = -(2**62)


def own_id(id_column: str, text: str) -> Column:
    """The id, or for a missing one a number below all ids that depends on the text.

    Beside 32 further bits of the text it tells documents without an id apart, however many there are.
    """
    missing = F.lit(-(2**63)) + F.xxhash64(content(text)).bitwiseAND(F.lit(2**62 - 1))
    return F.coalesce(F.col(id_column).cast("bigint"), missing)


def shown_id(own: Column) -> Column:
    """The id again: NULL for a number that stands for a missing one."""
    return F.when(own >= LEAST_ID, own)


def fold(id_column: str, of: int) -> Column:
    """crc32 of the id's text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % of


def keyed(docs: DataFrame, id_column: str, text: str, *more: Column) -> DataFrame:
    """Row number, id and text under own names; other columns are dropped.

    The number tells repeated rows apart. It is only stable once written, so callers stage it.
    """
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"),
                       content(text).alias("text"), *more)


#: What a Python worker remembers from task to task, by name, and how to drop it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def forget_others(name: str | None) -> None:
    """Drop what steps other than those of ``name`` remember: a worker lives on into the next operator."""
    for other, drop in REMEMBERED.items():
        if other != name:
            drop()


def arrow_step(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, remembers: str | None = None) -> DataFrame:
    """``mapInArrow`` over whole texts: short batches, as Spark counts rows and not bytes.

    ``remembers``: the entry of ``REMEMBERED`` that the step uses; the worker drops the others first.
    """
    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(remembers)
        yield from step(batches)

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return df.mapInArrow(alone, schema)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], limit: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes, or one row."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        size = max(1, int(rows * limit / max(limit, batch.nbytes)))
        for start in range(0, rows, size):
            yield batch.slice(start, size)


__all__ = ["LEAST_ID", "OWN", "REMEMBERED", "arrow_step", "content", "documents", "fold", "forget", "forget_others", "keyed", "labels", "own_id", "pieces", "raw", "scratch_path", "shown_id", "written"]
