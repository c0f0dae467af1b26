import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.llm import interpolated_lm as lm
from tests.llm.frames import docs, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [" end"]


def base(texts, held):
    count = collections.Counter(t for text, h in zip(texts, held) if not h for t in tokens(text))
    n, v = sum(count.values()), len(count)
    out = []
    for text in texts:
        own = tokens(text)
        out.append((len(own), sum(count[t] > 0 for t in own), n, sum(math.log10((count[t] + 1) / (n + v + 1)) for t in own)))
    return out


def model(texts, held):
    """The model by its definition, with EM over single tokens and not over steps."""
    seqs = [tokens(t) for t in texts]
    train = [s for s, h in zip(seqs, held) if not h]
    c1 = collections.Counter(t for s in train for t in s)
    c2 = collections.Counter(p for s in train for p in zip([" start", *s], s))
    ch = collections.Counter(a for s in train for a in [" start", *s[:-1]])
    n, v = sum(c1.values()), len(c1)
    bucket = lambda c: int(math.log2(c)) + 1 if c > 0 else 0
    events = collections.defaultdict(list)
    for s in train:
        for a, b in zip([" start", *s], s):
            h = ch[a] - 1
            events[bucket(h)].append(((c2[a, b] - 1) / h if h else 0, (c1[b] - 1) / (n - 1), 1 / (v + 1)))
    mix = {}
    for b, ev in events.items():
        p, m = np.array(ev), np.array([1 / 3] * 3) if b else np.array([0, 0.5, 0.5])
        for _ in range(60):
            r = p * m
            m = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        mix[b] = m

    def of(b):
        while b not in mix:
            b -= 1
        return mix[b]

    out = []
    for s in seqs:
        total = 0
        for a, b in zip([" start", *s], s):
            m = of(bucket(ch[a]))
            total += math.log10((m[0] * c2[a, b] / ch[a] if ch[a] else 0) + m[1] * c1[b] / n + m[2] / (v + 1))
        out.append(total)
    return out


def held(ids):
    return [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i in ids]


def check(got, ids, texts, with_model=True):
    out = held(ids)
    want = base(texts, out)
    assert [r["doc_id"] for r in got] == ids and [r["held_out"] for r in got] == out
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got] == [w[:3] for w in want]
    assert [r["base_score"] for r in got] == pytest.approx([w[3] for w in want], rel=1e-9)
    if with_model:
        assert [r["score"] for r in got] == pytest.approx(model(texts, out), rel=0.01, abs=0.05)


def test_whole_table_agrees_with_brute_force(spark, data, corpus):
    table = sorted(rows(corpus.select("doc_id", "text")), key=lambda r: r["doc_id"])
    got = sorted(rows(lm.op8_lm_scoring(spark, data)), key=lambda r: r["doc_id"])
    check(got, [r["doc_id"] for r in table], [r["text"] for r in table])
    # the model knows more than single words
    held_out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held_out) > sum(r["base_score"] for r in held_out)


def test_small_blocks_and_many_buckets_change_nothing(spark):
    draw = random.Random(4)
    texts = [" ".join(draw.choice(["a", "B", "b", "cc", "é", "the", "of"]) for _ in range(draw.randint(0, 40))) for _ in range(120)]
    table = docs(spark, texts).repartition(5)
    got = sorted(rows(lm.scored(table, block_bytes=100, bucket_bytes=1)), key=lambda r: r["doc_id"])
    check(got, list(range(120)), texts)


def test_awkward_texts(spark):
    texts = [None, "", " \n", "A a\xa0a", "word " * 20_000, "x" * 100_000, "\x00 \x1c", "É é", "end", "start"] + ["the cat"] * 20
    got = sorted(rows(lm.scored(docs(spark, texts))), key=lambda r: r["doc_id"])
    check(got, list(range(30)), texts)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    table = docs(spark, ["a b", "a b", "c"], [1, 1, None]).withColumns({"kind": F.lit(1), "block": F.lit(2), "held_out": F.lit("x"), "size": F.lit(0)})
    got = sorted(rows(lm.scored(table)), key=lambda r: str(r["doc_id"]))
    check(got, [1, 1, None], ["a b", "a b", "c"], with_model=False)


def test_no_training_rows_and_empty_table(spark):
    got = rows(lm.scored(docs(spark, ["a b"]), F.lit(True)))
    assert (got[0]["n_known"], got[0]["train_tokens"], got[0]["base_score"]) == (0, 0, 0.0) and math.isfinite(got[0]["score"])
    assert rows(lm.scored(docs(spark, []))) == []


def test_weights_sum_to_one_and_trust_frequent_contexts():
    bucket, pair = np.array([1, 1, 9, 9]), np.array([0.0, 0.7, 0.0, 0.7])
    mix = lm.expectation_maximisation(bucket, np.array([9, 1, 1, 9]), pair, np.full(4, 0.01), 50)
    assert np.allclose(mix.sum(axis=1), 1) and mix[9, 0] > mix[1, 0]
