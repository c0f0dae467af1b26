"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, its buckets laid out by size and compacted after some
appends. New rows are reduced to one row per digest, anti-joined with the index by sort-merge, and what is new is
appended. Only digests and ids move between executors; the texts stay where they are read.

Texts are equal when they agree after lower-casing A-Z. Defined cases: a null text is the empty text;
all empty texts are one group; of equal texts the row with the largest id stays, a null id counts as
the smallest; of repeated rows (same id, same text) exactly one stays, in no stated choice, as they are alike; very long
texts only cost their digest; an empty table gives no rows; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientlens.llm.common import OWN, content, documents, keyed, scratch_path, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_ID = -(2**63)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; pure ASCII takes the short way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: str) -> Column:
    return F.sha2(ascii_lower(content(text)).cast("binary"), 256)


#: Rows of a bucket that an index is laid out for, and appends after which its files are put together.
BUCKET_ROWS, MOST_APPENDS = 1_000_000, 8
COLUMNS = "digest STRING, keep_id BIGINT, keep_row BIGINT, batch STRING"


class DigestIndex:
    """Digests seen so far, with the row that stands for each; survives the session at ``path``.

    The table below ``path`` is a generation, bucketed and sorted by digest. An append adds a file to each bucket; a
    compaction writes a new generation with one file per bucket, in as many buckets as its rows need, and then
    deletes the old one. Readers take the last complete generation. No entry stays behind in the catalog.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.path, self.least = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._folder = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        self._files = self._folder("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _generation(self) -> tuple[int, int] | None:
        """Number and buckets of the last complete generation."""
        root = self._folder(".")
        names = [f.getPath().getName() for f in self._files.listStatus(root)] if self._files.exists(root) else []
        found = [tuple(map(int, n.split("-")[1::2])) for n in names if n.startswith("generation-") and self._files.exists(self._folder(f"{n}/_SUCCESS"))]
        return max(found, default=None)

    @staticmethod
    def _name(generation: tuple[int, int]) -> str:
        return f"generation-{generation[0]}-buckets-{generation[1]}"

    def files(self) -> int:
        """Data files of the generation."""
        now = self._generation()
        return 0 if now is None else sum(f.getPath().getName().startswith("part-") for f in self._files.listStatus(self._folder(self._name(now))))

    def _entry(self, generation: tuple[int, int]) -> str:
        """A name in the catalog for a generation, which the caller drops."""
        table = f"digest_index_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE TABLE {table} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {generation[1]} BUCKETS "
                       f"LOCATION '{self.path}/{self._name(generation)}'")
        return table

    def read(self) -> DataFrame:
        now = self._generation()
        if now is None:
            return self.spark.createDataFrame([], COLUMNS)
        table = self._entry(now)
        rows = self.spark.table(table)
        rows.schema  # looked up now, while the table has a name
        self.spark.sql(f"DROP TABLE {table}")
        return rows

    def unseen(self, groups: DataFrame) -> DataFrame:
        """Rows whose digest the index lacks."""
        return groups.join(self.read().select("digest").hint("merge"), "digest", "left_anti")

    def _write(self, rows: DataFrame, generation: tuple[int, int]) -> None:
        """One more file per bucket."""
        table = self._entry(generation)
        (rows.select("digest", "keep_id", "keep_row", "batch").repartition(generation[1], "digest").write.format("parquet").mode("append")
         .bucketBy(generation[1], "digest").sortBy("digest").saveAsTable(table))
        self.spark.sql(f"DROP TABLE {table}")

    def _buckets(self, rows: int) -> int:
        return self.least or max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))

    def append(self, rows: DataFrame, expected: int) -> None:
        """Add rows; the first ones lay the index out for ``expected`` rows. Compacts after ``MOST_APPENDS``."""
        now = self._generation() or (0, self._buckets(expected))
        self._write(rows, now)
        if self.files() > MOST_APPENDS * now[1]:
            self.compact()

    def compact(self) -> None:
        """Put the files of each bucket together, in as many buckets as the rows need now."""
        now = self._generation()
        if now is not None:
            # without buckets, as Spark would leave out the exchange and read the files as they are
            rows = self.spark.read.schema(COLUMNS).parquet(f"{self.path}/{self._name(now)}")
            self._write(rows, (now[0] + 1, self._buckets(rows.count())))
            self._files.delete(self._folder(self._name(now)), True)

def _register(rows: DataFrame, index: DigestIndex) -> tuple[DataFrame, str]:
    """Add the batch's new digests; gives the batch's groups with the row that stays, and the batch's name."""
    batch = uuid.uuid4().hex
    groups = rows.groupBy("digest").agg(
        F.max(F.struct(F.coalesce("doc_id", F.lit(LEAST_ID)).alias("id"), "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    new = groups.select("digest", F.nullif(F.col("keeper.id"), F.lit(LEAST_ID)).alias("keep_id"),
                        F.col("keeper.row").alias("keep_row"), F.lit(batch).alias("batch"))
    index.append(index.unseen(new), rows.count())
    stays = index.read().join(groups.select("digest", "group_size").hint("merge"), "digest")
    return written(stays, "digest-groups"), batch


def decisions(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. Appends to the index."""
    rows = written(keyed(docs, id_column, text).select("row", "doc_id", digest("text").alias("digest")), "digests")
    stays, batch = _register(rows, index)
    return rows.join(stays, "digest").select(
        "doc_id", "keep_id", "group_size", ((F.col("batch") == batch) & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"))


def deduplicated(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. Appends to the index.

    Texts move once, keyed by digest and id, so that a large group of copies is spread by its ids.
    """
    rows = written(keyed(docs, id_column, text).select("row", "doc_id", digest("text").alias("digest")), "digests")
    stays, batch = _register(rows, index)
    key = [f"{OWN}digest", f"{OWN}id"]
    wanted = stays.where(F.col("batch") == batch).select(
        F.col("digest").alias(key[0]), F.coalesce("keep_id", F.lit(LEAST_ID)).alias(key[1]))
    named = docs.withColumns({key[0]: digest(text), key[1]: F.coalesce(F.col(id_column).cast("bigint"), F.lit(LEAST_ID))})
    return named.join(wanted, key, "left_semi").dropDuplicates(key).drop(*key)


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Decisions for the whole table against an index that starts empty."""
    return decisions(documents(spark, folder), DigestIndex(spark, scratch_path(spark, "digest-index")))


OP1_SQL = f"""
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)"""
