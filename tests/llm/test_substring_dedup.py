import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.llm import substring_dedup as sd
from tests.llm.frames import docs, rows, stored


def brute(texts, length):
    """(n_bytes, n_removed, n_spans, digest) of each text by counting every string."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, dtype=int)
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = 1
        rest = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return out


def check(spark, texts, length, width, ids=None):
    got = rows(sd.removal_digests(docs(spark, texts, ids), length, width))
    want = brute(texts, length)
    if ids is None:
        assert [tuple(r.values())[1:] for r in sorted(got, key=lambda r: r["doc_id"])] == want
    else:
        assert sorted(map(str, (tuple(r.values())[1:] for r in got))) == sorted(map(str, want))


def test_whole_table_agrees_with_brute_force(spark, data, corpus):
    texts = {r["doc_id"]: r["text"] for r in rows(corpus.select("doc_id", "text"))}
    got = {r["doc_id"]: tuple(r.values())[1:] for r in rows(sd.op3_suffix_dedup(spark, data))}
    assert [got[i] for i in texts] == brute(list(texts.values()), 200)
    assert any(r[1] for r in got.values())


def test_random_texts_with_copied_parts(spark):
    draw = random.Random(3)
    for length, width, letters in ((20, 12, "ab"), (24, 16, "abcdefgh"), (40, 32, "abcdéf ")):
        parts = ["".join(draw.choice(letters) for _ in range(draw.randint(1, 90))) for _ in range(12)]
        texts = ["".join(draw.choice(parts)[draw.randint(0, 9):] + draw.choice(letters) * draw.randint(0, 3) for _ in range(draw.randint(0, 6))) for _ in range(60)]
        check(spark, texts, length, width)


def test_awkward_texts(spark):
    base = "".join(chr(97 + (i * i) % 23) for i in range(400))
    texts = [None, "", "a" * 199, "a" * 200, "a" * 201, "ab" * 500, base, base[100:300] + "x", "y" + base[99:299], "é" * 150, "é" * 150, base[:199],
             "z" * 30_000, "q" + base[300:] + base[:100]]
    check(spark, texts, 200, 128)


def test_repeated_rows_and_null_ids(spark):
    base = "".join(chr(97 + (i * 7 + i * i) % 25) for i in range(300))
    check(spark, [base, base, base[:250] + "!", "other " * 5], 200, 128, [5, 5, None, None])
    check(spark, [base, "x" + base], 200, 128, [None, None])


def test_small_segments_change_nothing(spark, monkeypatch):
    base = "".join(chr(97 + (i * 3 + i * i) % 19) for i in range(900))
    text = base + "-" + base[50:700]
    want = [r for r in sd._runs(40, 32)(iter([_batch([text])]))]
    assert sum(b["n"].to_numpy().sum() for b in want) == len(text) - 39
    monkeypatch.setattr(sd, "SEGMENT", 64)
    got = [r for r in sd._runs(40, 32)(iter([_batch([text])]))]
    strings = lambda bs: {(lo + k, lo + at) for b in bs for lo, n, at in zip(b["lo"].to_pylist(), b["n"].to_pylist(), b["at"].to_pylist()) for k in range(n)}
    assert strings(got) == strings(want)


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32()), pa.array(texts)], ["id", "mark", "text"])


def test_anchor_is_the_first_least_gram():
    data = np.frombuffer(b"abcabcabcxyzabcabcabc" * 5, dtype=np.uint8)
    place, gram = sd.anchors(data, 20, 12)
    hashes = sd.gram_hashes(data, 9)
    for i in range(len(place)):
        part = hashes[i:i + 12] & ~sd.PLACE
        assert place[i] == i + int(np.argmin(part)) and gram[i] == hashes[place[i]]


def test_a_passage_that_most_documents_hold(spark):
    draw = random.Random(9)
    passage = "".join(draw.choice("abcdefgh ") for _ in range(300))
    texts = ["".join(draw.choice("ijklmnop ") for _ in range(draw.randint(0, 250))) + passage * (i % 3 > 0) + str(i) for i in range(300)]
    check(spark, texts, 200, 128)


def test_remaining_bytes_clashing_columns_and_empty_table(spark):
    base = "".join(chr(97 + (i * i) % 23) for i in range(300))
    table = docs(spark, [base + "!", base, "abc"]).withColumns({"id": F.lit("x"), "mark": F.lit(1), "spans": F.lit(2), "lo": F.lit(3)})
    assert {r["doc_id"]: bytes(r["kept"]) for r in rows(sd.without_repeats(table))} == {0: b"!", 1: b"", 2: b"abc"}
    assert rows(sd.removal_digests(docs(spark, []))) == []


def test_without_sending_changes_to_the_texts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = "".join(chr(97 + (i * i) % 23) for i in range(300))
        check(spark, [base, base[20:270], "b" * 10], 200, 128)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_grams_of_eight_bytes_at_least(spark):
    with pytest.raises(ValueError):
        sd.repeated_spans(docs(spark, ["a"]), 20, 16)
