"""Small document tables with the awkward cases, and helpers to read results."""

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                       T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def docs(spark, texts, ids=None, langs=None, sources=None):
    """A documents table; texts may hold None."""
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    rows = [(ids[i], texts[i], (langs or ["en"] * n)[i], (sources or [f"src{i % 3}" for i in range(n)])[i],
             None if texts[i] is None else len(texts[i])) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def stored(spark, tmp_path, frame, **more):
    """A folder with the frame as its documents table, and further tables by name."""
    frame.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    for name, table in more.items():
        table.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(df):
    return [r.asDict() for r in df.collect()]


def by_id(df, key="doc_id"):
    return {r[key]: r for r in rows(df)}
