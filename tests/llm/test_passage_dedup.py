import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clientlens.llm import passage_dedup as pd
from tests.llm.frames import docs, rows, stored

LEAST = -(2**63)


def brute(table, window=13):
    """(doc_id, n_words, n_removed, kept) of every row, by listing all windows."""
    first = {}
    split = [(LEAST if i is None else i, (t or "").encode().split()) for i, t in table]
    for i, words in split:
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, words), (shown, _) in zip(split, table):
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            if first[tuple(words[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((shown, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return sorted(out, key=str)


def check(spark, table, window=13, gram=5, parts=3):
    frame = docs(spark, [t for _, t in table], [i for i, _ in table]).repartition(parts)
    got = rows(pd.without_repeats(frame, window, gram))
    for r in got:
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    assert sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), r["kept"]) for r in got), key=str) == brute(table, window)


def test_whole_table_agrees_with_brute_force_and_sql(spark, data, corpus):
    want = {r[0]: (*r[1:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in brute([(r["doc_id"], r["text"]) for r in rows(corpus.select("doc_id", "text"))])}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(pd.op13_passage_dedup(spark, data))}
    assert got == want and any(r[1] for r in got.values())
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert {r[0]: r[1:] for r in db.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({pd.OP13_SQL})").fetchall()} == want


@pytest.mark.parametrize("window,gram,letters", [(13, 5, "abcdefgh"), (6, 2, "ab"), (9, 4, "abc"), (4, 3, "abcd")])
def test_random_texts_with_copied_parts(spark, window, gram, letters):
    draw = random.Random(window)
    parts = [[draw.choice(letters) for _ in range(draw.randint(1, 40))] for _ in range(15)]
    table = []
    for i in range(90):
        words = []
        for _ in range(draw.randint(0, 6)):
            part = draw.choice(parts)
            words += part[draw.randint(0, 5):draw.randint(5, 60)]
            words += [draw.choice(letters) for _ in range(draw.randint(0, 2))]
        table.append((draw.randint(0, 70), " ".join(words)))
    check(spark, table, window, gram)


def test_awkward_rows(spark):
    base = [f"w{k * k % 101}" for k in range(60)]
    text = " ".join(base)
    table = [(5, None), (6, ""), (7, " \t\n"), (8, " ".join(base[:12])), (9, " ".join(base[:13])), (9, text), (9, text), (None, " ".join(base[20:40])),
             (None, " ".join(base[20:40])), (3, "x " + "  ".join(base[1:31])), (2, "\x0b".join(base[30:]) + " É"), (10, text + " " + text), (11, "É " * 40), (12, "é " * 40),
             (13, "z " * 50_000 + text), (14, "z " * 50_000 + text)]
    check(spark, table)
    check(spark, [(1, "a b"), (0, None)])


def test_a_passage_in_most_documents_with_different_surroundings(spark, monkeypatch):
    draw = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(9))
    table = [(i, " ".join([*(draw.choice("abcd") for _ in range(draw.randint(3, 9))), passage, *(draw.choice("abcd") for _ in range(draw.randint(3, 9)))])) for i in range(400)]
    check(spark, table)
    monkeypatch.setattr(pd, "FREQUENT_PART", 1)
    check(spark, table)


def test_many_null_ids(spark):
    table = [(None, " ".join(f"n{(i * 7 + k) % 50}" for k in range(20))) for i in range(3000)] + [(1, " ".join(f"n{k}" for k in range(25)))]
    check(spark, table)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert rows(pd.op13_passage_dedup(spark, stored(spark, tmp_path, docs(spark, [])))) == []
    same = " ".join(f"w{k}" for k in range(20))
    table = docs(spark, [same, "new " + same]).withColumns({c: F.lit(1) for c in ("part", "seq", "doc_ids", "texts", "places", "kept", "spans")})
    assert {r["doc_id"]: r["kept"] for r in rows(pd.without_repeats(table))} == {0: same, 1: "new"}
    with pytest.raises(ValueError):
        pd.without_repeats(table, 13, 13)


def test_settings_and_catalog_come_back(spark):
    before, tables = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), len(spark.catalog.listTables())
    pd.without_repeats(docs(spark, ["a " * 20, "a " * 30]))
    assert len(spark.catalog.listTables()) == tables
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") in (before, "1000")


def test_texts_are_not_shuffled_again(spark, monkeypatch):
    """The join that brings places to the blocks exchanges the places only."""
    plans = []
    whole = pd.Blocks.with_places

    def seen(self, places):
        joined = whole(self, places)
        plans.append(joined._jdf.queryExecution().executedPlan().toString())
        return joined

    monkeypatch.setattr(pd.Blocks, "with_places", seen)
    monkeypatch.setattr(pd, "BLOCK_BYTES", 2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pd.without_repeats(docs(spark, [f"{i} " + "a b c d e f g " * 30 for i in range(200)]).repartition(5))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 2
    for plan in plans:
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


def test_word_hashes_depend_on_the_word_alone():
    draw = random.Random(8)
    words = ["".join(draw.choice("abé ").strip() or "z" for _ in range(draw.choice((1, 2, 3, 9, 64, 65, 200)))) for _ in range(3000)] + ["y" * 300_000, "a", "aa"]
    texts = [" ".join(words), "", None or "", "\n".join(reversed(words)) + " ", "  " + words[0]]
    hashes, counts = pd.word_hashes(pa.array(texts))
    assert counts.tolist() == [len(t.split()) for t in texts]
    seen = {}
    for word, h in zip([w for t in texts for w in t.split()], hashes.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    sliced = pa.array(["x y", *texts])[1:]
    assert pd.word_hashes(sliced)[0].tolist() == hashes.tolist()


def test_extension_settles_what_both_share():
    own = np.array([[1, 2, 3, 0, 7, 8, 9, 0]], dtype=np.uint64)  # three words to the left, three to the right, reach 4
    pivot = np.array([[1, 2, 4, 5, 7, 8, 9, 6]], dtype=np.uint64)
    (lo, hi), rest = pd.extended(np.array([5], dtype=np.uint64), np.array([1]), np.array([3]), own, pivot)
    assert (lo[0], hi[0]) == (1, 2)  # windows with one or two words to the left lie inside the repeat
    assert [(r[2].tolist(), r[3].tolist()) for r in rest] == [([3], [3]), ([], [])]
