import hashlib
import io
import contextlib

from pyspark.sql import functions as F

from clientlens.llm import exact_dedup as ed
from clientlens.session import scratch_path
from tests.compare import connect, differences
from tests.llm.frames import docs, rows


def index(spark):
    return ed.DigestIndex(spark, scratch_path(spark, "index"), 4)


def test_whole_table_agrees_with_sql(spark, data):
    assert differences(ed.op1_exact_dedup(spark, data), connect(data), ed.OP1_SQL) == []


def test_ascii_case_only_and_largest_id_stays(spark):
    table = docs(spark, ["Abc", "aBC", "É", "é", None, "", "x" * 300_000, "X" * 300_000])
    got = {r["doc_id"]: r for r in rows(ed.decisions(table, index(spark)))}
    assert [got[i]["keep_id"] for i in range(8)] == [1, 1, 2, 3, 5, 5, 7, 7]
    assert [got[i]["kept"] for i in range(8)] == [False, True, True, True, False, True, False, True]
    assert got[0]["group_size"] == 2 and got[2]["group_size"] == 1
    assert got[2]["text_sha256"] == hashlib.sha256("É".encode()).hexdigest()


def test_repeated_rows_and_null_ids_leave_one(spark):
    table = docs(spark, ["a", "a", "a", "b", "b"], [3, 3, None, None, None])
    got = rows(ed.decisions(table, index(spark)))
    assert sum(r["kept"] for r in got) == 2 and {r["keep_id"] for r in got} == {3, None}
    left = rows(ed.deduplicated(table, index(spark)))
    assert sorted((r["text"], r["doc_id"]) for r in left) == [("a", 3), ("b", None)]


def test_second_batch_is_judged_by_the_index(spark):
    known = index(spark)
    ed.decisions(docs(spark, ["a", "b"]), known)
    later = ed.decisions(docs(spark, ["A", "c", "c"], [7, 8, 9]), ed.DigestIndex(spark, known.path, 4))
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in rows(later)} == {7: (0, False), 8: (9, False), 9: (9, True)}
    assert known.read().count() == 3
    assert rows(ed.deduplicated(docs(spark, ["B", "d"], [1, 2]), known))[0]["text"] == "d"


def test_other_columns_pass_and_clashing_names_do_no_harm(spark):
    table = docs(spark, ["a", "A", "b"]).withColumns({"digest": F.lit(1), "row": F.lit("r"), "keep_id": F.lit(0.5), "text_sha256": F.lit(None).cast("string")})
    left = ed.deduplicated(table, index(spark))
    assert left.columns == table.columns and sorted(r["doc_id"] for r in rows(left)) == [1, 2]
    assert ed.decisions(table, index(spark)).count() == 3


def test_empty_table(spark):
    assert rows(ed.decisions(docs(spark, []), index(spark))) == []
    assert rows(ed.deduplicated(docs(spark, []), index(spark))) == []


def test_index_side_of_the_anti_join_is_neither_shuffled_nor_broadcast(spark):
    known = index(spark)
    ed.decisions(docs(spark, ["a", "b"]), known)
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        known.unseen(spark.range(5).select(F.col("id").cast("string").alias("digest")).repartition(4, "digest")).explain()
    assert "SortMergeJoin" in text.getvalue() and "Bucketed: true" in text.getvalue() and text.getvalue().count("Exchange hashpartitioning") == 1


def test_appends_and_compaction(spark):
    """One file per bucket again, no exchange and, where Spark may use the files' order, no sort on the index side."""
    tables, known = len(spark.catalog.listTables()), index(spark)
    for k in range(3):
        ed.decisions(docs(spark, [f"t{i}" for i in range(k * 50, k * 50 + 100)]), known)
    assert known.read().count() == 200 and known.files() == 12
    known.compact()
    assert known.read().count() == 200 and known.files() == 4 and len(spark.catalog.listTables()) == tables
    spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    try:
        text = io.StringIO()
        with contextlib.redirect_stdout(text):
            known.unseen(spark.range(5).select(F.col("id").cast("string").alias("digest")).repartition(4, "digest")).explain()
    finally:
        spark.conf.unset("spark.sql.legacy.bucketedTableScan.outputOrdering")
    plan = text.getvalue()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "Bucketed: true" in plan
    later = ed.decisions(docs(spark, ["T7", "new"], [900, 901]), ed.DigestIndex(spark, known.path, 4))
    assert {r["doc_id"]: (r["keep_id"], r["kept"]) for r in rows(later)} == {900: (7, False), 901: (901, True)}


def test_index_is_laid_out_and_compacted_by_size(spark, monkeypatch):
    monkeypatch.setattr(ed, "BUCKET_ROWS", 30)
    monkeypatch.setattr(ed, "MOST_APPENDS", 2)
    known = ed.DigestIndex(spark, scratch_path(spark, "index"))
    for k in range(4):
        ed.decisions(docs(spark, [f"t{i}" for i in range(k * 300, k * 300 + 300)]), known)
    # 300 rows in 10 buckets, compacted after the third append into 30, one more append
    assert known._generation() == (1, 30) and known.files() == 60 and known.read().count() == 1200


def test_a_third_of_all_rows_in_one_group(spark):
    table = docs(spark, [f"t{i}" if i % 3 else "Same" for i in range(3000)])
    got = rows(ed.decisions(table, index(spark)))
    assert sum(r["kept"] for r in got) == 2001 and max(r["group_size"] for r in got) == 1000
