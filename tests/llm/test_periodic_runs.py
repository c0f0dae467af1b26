import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.llm import periodic_runs as pr
from tests.llm.frames import docs, rows, stored


def brute_runs(words, least=6, exponent=4):
    """All runs by comparing the words with themselves at every distance."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([number[w] for w in words], dtype=np.int64)
    best = {}
    for q in range(1, len(x) // exponent + 1):
        same = np.concatenate([[0], (x[q:] == x[:-q]).astype(int), [0]])
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            if b - a + q >= max(least, exponent * q):
                best.setdefault((int(a), int(b - a + q)), q)
    return sorted((s, n, q) for (s, n), q in best.items())


def made_periodic(doc_id, words):
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute(doc_id, text):
    words = made_periodic(doc_id, (text or "").encode().split())
    runs = brute_runs(words)
    keep = [True] * len(words)
    best = (None,) * 4
    for s, n, q in runs:
        keep[s + q:s + n] = [False] * (n - q)
        if best[0] is None or n * best[2] > best[1] * q:
            best = (s, n, q, 1000 * n // q)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for w, k in zip(words, keep) if k)
    return (len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_whole_table_agrees_with_brute_force(spark, data, corpus):
    want = {r["doc_id"]: brute(r["doc_id"], r["text"]) for r in rows(corpus.select("doc_id", "text"))}
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows(pr.op11_periodic_runs(spark, data))}
    assert got == want
    assert sum(r[0] > 0 for r in got.values()) > 10


def found(texts, least=6, exponent=4):
    """Runs of each text, of all texts in one batch."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    codes = np.array([numbers[w] for t in texts for w in t], dtype=np.int64)
    out = [[] for _ in texts]
    for d, s, n, q in zip(*pr.find_runs(codes, np.array([len(t) for t in texts], dtype=np.int64), least, exponent)):
        out[d].append((int(s), int(n), int(q)))
    return out


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefghij"])
@pytest.mark.parametrize("exponent", [3, 4, 6])
def test_random_sequences(letters, exponent):
    draw = random.Random(len(letters) * exponent)
    texts = []
    for _ in range(150):
        text = []
        for _ in range(draw.randint(0, 6)):
            part = [draw.choice(letters) for _ in range(draw.randint(1, 9))]
            text += (part * draw.randint(1, 9))[:draw.randint(1, 60)]
        texts.append(text)
    assert found(texts, 6, exponent) == [brute_runs(t, 6, exponent) for t in texts]


def test_nested_and_long_runs():
    inner = ["a"] * 7 + ["b"]
    texts = [inner * 9, (inner * 5 + ["c"]) * 6, ["x"] * 20_000, [str(i % 997) for i in range(9_000)], [], ["q"] * 5, ["q"] * 6,
             ["a", "b"] * 4, ["a", "b"] * 3, [str(i) for i in range(3_000)]]
    assert found(texts) == [brute_runs(t) for t in texts]


def test_equal_documents_do_not_continue_each_other():
    assert found([["a"] * 6, ["a"] * 6, ["a", "b"] * 5, ["a", "b"] * 5]) == [[(0, 6, 1)], [(0, 6, 1)], [(0, 10, 2)], [(0, 10, 2)]]


def test_grammar_derives_the_sequence_and_extends_exactly():
    draw = random.Random(5)
    sequence = np.array([9] + [draw.randint(0, 2) for _ in range(900)] + [1] * 300 + [10], dtype=np.int64)
    grammar = pr.Grammar(sequence, (9, 11), 11)
    assert len(grammar.symbols) > 5
    for level, first in enumerate(grammar.firsts):
        assert np.all(np.diff(first) > 0) and np.array_equal(np.repeat(np.arange(len(first) - 1), np.diff(first)), grammar.parents[level])
        # equal nodes have equal children
        seen = {}
        for k, symbol in enumerate(grammar.symbols[level + 1].tolist()):
            children = tuple(grammar.symbols[level][first[k]:first[k + 1]].tolist())
            assert seen.setdefault(symbol, children) == children
    a = np.array([draw.randint(1, 1100) for _ in range(3000)])
    b = np.array([draw.randint(1, 1100) for _ in range(3000)])
    a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    x = sequence.tolist()

    def ahead(i, j):
        n = 0
        while x[i + n] == x[j + n]:
            n += 1
        return n

    def back(i, j):
        n = 0
        while x[i - n] == x[j - n]:
            n += 1
        return n

    assert grammar.extension(a, b, True).tolist() == [ahead(i, j) for i, j in zip(a, b)]
    assert grammar.extension(a, b, False).tolist() == [back(i, j) for i, j in zip(a, b)]


def test_awkward_rows(spark, tmp_path):
    texts = [None, "", " \t\n", "one", "É é " * 40, "a  b\u000ba\fb\ra\nb\ta b", "go " * 30_000, "go " * 30_000, "x y z x " * 9, "\x1f a" * 8]
    ids = [3, None, 25, 7, None, 4, 9, 9, 21, 30]
    table = docs(spark, texts, ids).withColumns({c: F.lit(1) for c in ("runs", "best", "start", "collapsed", "words")})
    folder = stored(spark, tmp_path, table)
    got = sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in rows(pr.op11_periodic_runs(spark, folder))), key=str)
    assert got == sorted(((i, *brute(i, t)) for i, t in zip(ids, texts)), key=str)
    assert rows(pr.op11_periodic_runs(spark, stored(spark, tmp_path / "none", docs(spark, [])))) == []


def test_real_outputs(spark):
    got = rows(pr.periodic_runs(docs(spark, ["say " + "no way " * 5 + "now", "calm"])))
    assert [r["collapsed"] for r in got] == ["say no way now", "calm"]
    assert [tuple(x) for x in got[0]["runs"]] == [(1, 10, 2)] and got[1]["runs"] == []
    with pytest.raises(ValueError):
        pr.periodic_runs(docs(spark, []), exponent=2)
