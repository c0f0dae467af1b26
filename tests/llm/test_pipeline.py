import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as cp
from clientlens.llm import bpe, jaccard_join, queries, quality_rules as qr
from clientlens.llm.common import documents, forget_others, written
from tests.llm.frames import docs, rows, stored
from tests.llm.test_jaccard_join import brute
from tests.llm.test_packing import check as check_packing

HEX = "0123456789abcdef01234567"


def words(draw, n):
    return " ".join(draw.choice(["the", "of", "and", "to", "in"]) if draw.random() < 0.3 else f"w{draw.randint(0, 9999)}" for _ in range(n))


def corpus(spark):
    draw = random.Random(21)
    texts = [words(draw, 80) for _ in range(20)]
    near = texts[0].split()
    near[40] = "changed"
    texts += [" ".join(near), texts[1].capitalize(), f"{words(draw, 80)} token = \"{HEX}\" end", "too short", None, "### " * 100]
    return texts, docs(spark, texts)


def test_every_stage_takes_effect(spark, tmp_path):
    texts, table = corpus(spark)
    folder, now, left = stored(spark, tmp_path, table), table, []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, now, folder)
        assert out.columns == table.columns, name
        now = written(out, "stage")
        left.append({r["doc_id"] for r in rows(now)})
    everything = set(range(len(texts)))
    assert everything - left[0] == {23, 24, 25}  # quality rules
    assert left[0] - left[1] == {1}  # exact copies: the largest id stays
    assert left[1] - left[2] == {20}  # near copies: the smallest id stays
    assert left[3] == left[2]
    (secret,) = [r for r in rows(now) if r["doc_id"] == 22]
    assert HEX not in secret["text"] and "[secret]" in secret["text"] and secret["n_chars"] == len(secret["text"])
    kept = sorted((r["doc_id"], r["text"]) for r in rows(now))
    got = rows(cp.STAGES[-1][1](spark, now, folder))
    number = {d: i for i, (d, _) in enumerate(kept)}
    check_packing([t for _, t in kept], [{**r, "doc_id": number[r["doc_id"]]} for r in got], 2048)


def test_stages_on_the_test_table(spark, data):
    """Each stage against its own brute force, on what its predecessor kept."""
    table = documents(spark, data)
    kept = written(cp.quality_rules(spark, table, data), "a")
    assert {r["doc_id"] for r in rows(kept)} == {r["doc_id"] for r in rows(qr.judged(table)) if r["kept"]}
    unique = written(cp.exact_dedup(spark, kept, data), "b")
    want = {}
    for r in rows(kept):
        key = "".join(c.lower() if c.isascii() else c for c in r["text"])
        want[key] = max(r["doc_id"], want.get(key, -1))
    assert {r["doc_id"] for r in rows(unique)} == set(want.values())
    single = written(cp.jaccard_join(spark, unique, data), "c")
    items = sorted((r["doc_id"], r["text"]) for r in rows(unique))
    components = brute([d for d, _ in items], [t for _, t in items], 5, 80)
    assert {r["doc_id"] for r in rows(single)} == {c for _, c in components}


def test_run_packs_what_the_stages_keep(spark, tmp_path):
    texts, table = corpus(spark)
    got = rows(cp.run(spark, stored(spark, tmp_path, table)))
    assert {r["doc_id"] for r in got} == set(range(len(texts))) - {23, 24, 25, 1, 20}


def test_empty_table(spark, tmp_path):
    assert rows(cp.run(spark, stored(spark, tmp_path, docs(spark, [])))) == []


def test_extra_columns_and_nulls_pass(spark, tmp_path):
    texts, table = corpus(spark)
    table = table.unionByName(docs(spark, [None, words(random.Random(1), 60)], [None, None], [None, None], [None, None])).withColumn("text_sha256", F.lit("x"))
    now = table
    for _, stage in cp.STAGES[:-1]:
        now = written(stage(spark, now, str(tmp_path)), "stage")
        assert now.columns == table.columns
    assert sum(r["doc_id"] is None for r in rows(now)) == 1


def test_very_long_texts_and_repeated_rows(spark, tmp_path):
    draw = random.Random(31)
    long = words(draw, 60_000)
    near = long.split()
    near[100] = "changed"
    texts = [long, " ".join(near), long, words(draw, 90), words(draw, 90)]
    table = docs(spark, texts, [1, 2, 3, 4, 5])
    table = table.unionByName(table.where("doc_id = 5"))
    got = rows(cp.run(spark, stored(spark, tmp_path, table)))
    # of the equal long texts 3 stays, of it and the near one the smaller id
    assert {r["doc_id"] for r in got} == {2, 4, 5}
    for i in (2, 4, 5):
        mine = [r for r in got if r["doc_id"] == i]
        assert sum(r["length"] for r in mine) == mine[0]["doc_tokens"]


def test_registered_by_number():
    names = list(queries.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(names) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLES) <= set(entry.oracle_sql())
    assert set(queries.ORACLES) == {"op1_exact_dedup", "op12_merkle_manifest", "op13_passage_dedup"}
    assert all(callable(q) for q in entry.queries().values()) and all(isinstance(sql, str) for sql in entry.oracle_sql().values())


def test_a_stage_forgets_what_stages_before_remember():
    """Shingle words and the encoder never fill a worker side by side."""
    bpe.kept(bpe.vocabulary_path())
    jaccard_join.shingles(b"some words of a text", 2)
    forget_others("shingle words")
    assert not bpe._ENCODERS and not bpe._KEPT and jaccard_join._HASHES
    forget_others(None)
    assert not jaccard_join._HASHES
