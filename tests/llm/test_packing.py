import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clientlens.llm import packing as pk
from clientlens.llm.bpe import vocabulary_path
from tests.llm.frames import docs, rows

PATH = vocabulary_path()


def check(texts, got, window):
    """Pieces tile every document and every sequence, and carry the library's ids."""
    library = Tokenizer.from_file(PATH)
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for t in texts]
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(ids[i][at:at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    padding = 0
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding < window
    return len(by_sequence)


def test_whole_table(spark, data, corpus):
    texts = [r["text"] for r in sorted(rows(corpus.select("doc_id", "text")), key=lambda r: r["doc_id"])]
    check(texts, rows(pk.op2_packing(spark, data)), 2048)


def test_small_windows_and_awkward_texts(spark):
    texts = [None, "", "a b c", "a b c d e f g", "word " * 100, "x " * 15, "x " * 16, "y " * 31, "z " * 8000] + ["p q r s t"] * 40 + ["p q r s t u v w x"] * 40
    for window in (4, 16):
        check(texts, rows(pk.packed(docs(spark, texts), PATH, window)), window)


def test_combinations_fill_the_window_exactly():
    sets = pk.combinations(np.append(0, np.ones(11, dtype=np.int64)), 12)
    assert (sets.sum(axis=1) == 12).all() and len({tuple(sorted(s)) for s in sets.tolist()}) == len(sets)
    shapes = {tuple(sorted(n for n in s if n)) for s in sets.tolist()}
    assert {(6, 6), (4, 4, 4), (1, 1, 10), (3, 3, 3, 3), (1, 2, 2, 3, 4)} <= shapes


def test_least_squares_meets_a_histogram_that_combinations_can_meet():
    target = np.zeros(16, dtype=np.int64)
    target[[5, 11, 3, 8]] = [1000, 900, 100, 500]
    sets = pk.combinations(target, 16)
    x = pk.non_negative_least_squares(sets, target, 300)
    assert (x >= 0).all()
    met = sum(np.bincount(sets[:, k], weights=x, minlength=16) for k in range(sets.shape[1]))
    assert abs(met[1:] - target[1:]).max() < 20
    plan = pk.layout(target, 16)
    assert plan.used.sum() > 0.9 * target.sum()


def test_rounding_stays_within_the_histogram():
    left = np.zeros(17, dtype=np.int64)
    left[[4, 8, 12]] = [3, 2, 9]
    sets = np.array([[4, 4, 8, 0, 0], [4, 12, 0, 0, 0], [8, 8, 0, 0, 0]])
    found = list(pk.rounded(sets, np.array([0.4, 7.6, 0.2]), left))
    assert found == [([4, 12], 3), ([8, 8], 1)] and left[[4, 8, 12]].tolist() == [0, 0, 6]


def test_combinations_place_nearly_all_rests_of_the_real_lengths(spark):
    """On the lengths of 10,000 documents, alone and many times over, and on those of a tenth of them."""
    from tokenizers import Tokenizer
    texts = [r["text"] or "" for r in rows(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").orderBy("doc_id"))]
    sizes = np.array([len(e.ids) + 1 for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]) % 2048
    for some, times in ((sizes, 1), (sizes, 25), (sizes, 400), (sizes[::10], 1)):
        histogram = np.bincount(some[some > 0], minlength=2048) * times
        plan = pk.layout(histogram, 2048)
        assert plan.used.sum() >= 0.9 * histogram.sum()
        # each planned sequence is full
        assert (plan.used * np.arange(2049)).sum() == 2048 * plan.combined


def test_rank_is_dense_within_a_length(spark):
    frame = spark.range(5000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).cast("long").alias("n"))
    for r in rows(pk._ranked(frame).groupBy("n").agg(F.count("*").alias("c"), F.min("rank").alias("a"), F.max("rank").alias("b"), F.countDistinct("rank").alias("d"))):
        assert (r["a"], r["b"], r["d"]) == (0, r["c"] - 1, r["c"])


def test_sequences_hold_the_ids(spark):
    table = docs(spark, ["a b c", "d e f g h i j k l m", "n o"])
    got = rows(pk.sequences(table, pk.packed(table, PATH, 8), PATH, 8))
    assert sum(len(r["ids"]) for r in got) == 18 and all(len(r["ids"]) in (1, 2, 4, 8) for r in got)


def test_repeated_rows_null_ids_clashing_columns_and_empty_table(spark):
    table = docs(spark, ["a b", "a b", "c"], [1, 1, None]).withColumns({"n": F.lit(1), "rank": F.lit(2), "row": F.lit(3)})
    assert sum(r["length"] for r in rows(pk.packed(table, PATH, 4))) == 3 + 3 + 2
    assert rows(pk.packed(docs(spark, []), PATH, 4)) == []
