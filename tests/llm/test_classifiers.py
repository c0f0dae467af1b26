import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from clientlens.llm import quality_classifier as qc
from clientlens.llm import toxicity as tx
from tests.llm.frames import by_id, docs, rows

LARGER = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0


def accuracy(spark, module, query, label, folder):
    got = by_id(query(spark, folder))
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == held(i) and 0 <= r["score"] <= 1 for i, r in got.items())
    marks = [r for r in rows(spark.read.parquet(f"{folder}/labels.parquet")) if held(r["doc_id"])]
    return float(np.mean([got[r["doc_id"]]["predicted"] == r[label] for r in marks])), got, marks


def test_toxicity_on_held_out_labels(spark):
    right, got, marks = accuracy(spark, tx, tx.op9_toxicity, "toxic", "/root/testdata/sf0.1")
    assert right > 0.97
    assert np.mean([got[r["doc_id"]]["predicted"] for r in marks if r["toxic"]]) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_quality_on_held_out_labels(spark):
    right, got, _ = accuracy(spark, qc, qc.op10_quality_classifier, "quality", LARGER)
    assert right > 0.95
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def small(spark, n=120):
    draw = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    texts, marks = [], []
    for i in range(n):
        bad = i % 3 == 0
        text = [draw.choice(words) for _ in range(draw.randint(20, 60))]
        if bad:
            for word in ("awful", "nasty") * 2:
                text.insert(draw.randint(0, len(text)), word)
        texts.append(" ".join(text) if not bad else " ".join(text) + " ### " * 20)
        marks.append((i, int(not bad), int(bad)))
    return docs(spark, texts), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("module,label", [(tx, "toxic"), (qc, "quality")])
def test_rows_awkward_and_clashing(spark, module, label):
    table, marks = small(spark)
    more = docs(spark, [None, "", "x" * 200_000, "w1 " * 50_000, "awful nasty awful"], [500, 501, 502, None, 503])
    table = table.unionByName(more).unionByName(more.limit(2)).withColumns({"label": F.lit(1), "id": F.lit("x"), "half": F.lit(0), "score": F.lit(9)})
    marks = marks.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, None), (5, 1, 0), (5, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int"))
    got = rows(module.scored(table, marks, label))
    assert len(got) == 120 + 7 and all(0 <= r["score"] <= 1 for r in got)
    scores = {r["doc_id"]: r["score"] for r in got}
    bad = [scores[i] for i in range(120) if i % 3 == 0]
    good = [scores[i] for i in range(120) if i % 3]
    assert (min(bad) > max(good)) if label == "toxic" else (max(bad) < min(good))


@pytest.mark.parametrize("module,label", [(tx, "toxic"), (qc, "quality")])
def test_labels_of_the_held_out_fold_are_not_used(spark, module, label):
    table, marks = small(spark)
    flipped = marks.withColumn(label, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col(label)).otherwise(F.col(label)))
    assert by_id(module.scored(table, marks, label)) == by_id(module.scored(table, flipped, label))


@pytest.mark.parametrize("module,label", [(tx, "toxic"), (qc, "quality")])
def test_one_class_no_labels_and_no_documents(spark, module, label):
    table, marks = small(spark, 12)
    assert {r["score"] for r in rows(module.scored(table, marks.limit(0), label))} == {0.0}
    assert len({r["score"] for r in rows(module.scored(table, marks.withColumn(label, F.lit(1)), label))}) == 1
    assert rows(module.scored(table.limit(0), marks, label)) == []


def test_pairwise_part_by_its_definition():
    draw = np.random.default_rng(1)
    machine = qc.Machine(0.3, draw.normal(size=qc.SIZE), draw.normal(size=(qc.SIZE, qc.FACTORS)))
    at, x = draw.choice(qc.SIZE, 9, replace=False), draw.normal(size=9)
    value, _ = machine.raw(at, x, np.array([0]))
    pairs = sum(machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j] for i in range(9) for j in range(i))
    assert value[0] == pytest.approx(0.3 + machine.linear[at] @ x + pairs)


def brute_ratios(texts, labels, weight, smooth):
    """Log-ratios of words and pairs from their definition, one text at a time."""
    words = [tx.words_of(t.encode()) for t in texts]
    out = []
    for order in (1, 2):
        count = {}
        for own, label in zip(words, labels):
            for x in set(own) if order == 1 else set(zip(own, own[1:])):
                count.setdefault(x, [0, 0])[label] += 1
        follows = {}
        for own in words:
            for a, b in zip([b"", *own], own):
                follows.setdefault(b, set()).add(a)
        total = [weight * sum(n[0] for n in count.values()), sum(n[1] for n in count.values())]
        z = smooth.z * np.sqrt((total[0] + weight * total[1]) / sum(total))
        least = smooth.d0 if order == 1 else smooth.pair_d0
        found = {}
        for x, (n0, n1) in count.items():
            scale = min(1.0, (len(follows[x]) + 1) / (n0 + n1)) if order == 1 else 1.0
            n0, n1 = n0 * scale * weight, n1 * scale
            e0, e1 = ((n0 + n1) * t / sum(total) for t in total)
            spare = n1 - e1 - (least + z * np.sqrt(e1) + smooth.rho * max(0, total[0] - total[1]) / sum(total) * e1)
            if spare > 0:
                found[x] = np.log((e1 + spare) / total[1]) - np.log(min(e0, n0 + least + z * np.sqrt(e0)) / total[0])
        out.append(found)
    return out


def brute_difference(text, found):
    words, sum_ = tx.words_of(text.encode()), 0.0
    for i, w in enumerate(words):
        sum_ += found[1].get((words[i - 1], w), found[0].get(w, 0.0)) if i else found[0].get(w, 0.0)
    return sum_ / len(words) if words else 0.0


@pytest.mark.parametrize("weight", [1.0, 5.0])
def test_counts_discounts_and_differences_by_their_definition(spark, weight):
    draw = random.Random(11)
    common, bad = [f"w{i}" for i in range(40)], ["awful", "nasty", "vile"]
    texts, labels = [], []
    for i in range(240):
        own = [draw.choice(common) for _ in range(draw.randint(5, 30))]
        if i % 4 == 0:
            own += [draw.choice(bad) for _ in range(3)] + ["you", "fool"] * (i % 8 == 0)
        draw.shuffle(own) if i % 8 else None
        texts.append(" ".join(own) + (" you" if i % 3 == 0 else " fool" if i % 3 == 1 else ""))
        labels.append(int(i % 4 == 0))
    frame = spark.createDataFrame([(i, t, label, i % 2) for i, (t, label) in enumerate(zip(texts, labels))], "id long, text string, label int, half int")
    counted, smooth = tx._counted(frame), tx.Smoothing()
    models = tx.Models(*(tx._ratios(counted, (0, 1), smooth, order, weight) for order in (1, 2)))
    want = brute_ratios(texts, labels, weight, smooth)
    assert b"awful" in want[0] and want[1]
    for got, expected in zip((models.words, models.pairs), want):
        expected = {x: r for x, r in expected.items() if r > 1e-6}
        assert got.keys() == expected.keys() and all(got[x] == pytest.approx(expected[x]) for x in got)
    for t in [*texts[:50], "", "awful", "you fool", "AWFUL, vile! you fool", "unseen words only"]:
        assert models.difference(t.encode()) == pytest.approx(brute_difference(t, want))


def test_shared_expressions_speak_for_neither_class(spark):
    table, marks = small(spark)
    texts = tx.labelled_texts(table, tx.training_rows(marks, "toxic"), "doc_id", "text").withColumn("half", F.lit(0))
    ratios = tx._ratios(tx._counted(texts.withColumn("half", F.pmod("id", F.lit(2)).cast("int"))), (0, 1), tx.Smoothing(), 1)
    assert {b"awful", b"nasty"} <= set(ratios) and not any(w.startswith(b"w") for w in ratios)


def test_sample_bound_takes_the_least_hashes(spark):
    marks = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    chosen = rows(tx.training_rows(marks, "toxic", most=10))
    assert sorted(r["label"] for r in chosen) == [0] * 10 + [1] * 10 and not any(held(r["id"]) for r in chosen)


def test_bound_on_training_rows_keeps_the_odds_of_all_labels(spark):
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randint(0, 400)}" for _ in range(30)) for _ in range(1000)]
    marks = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "doc_id long, toxic int")
    table = docs(spark, texts)
    for most in (1000, 60):
        # the words say nothing, so every score is the share of toxic labels
        scores = [r["score"] for r in rows(tx.scored(table, marks, "toxic", most=most))]
        assert abs(np.mean(scores) - 0.1) < 0.04 and max(scores) < 0.5, most


def test_expected_counts_use_the_shares_of_all_labels(spark):
    def ratios(ordinary, weight):
        texts = [(i, f"plain{i} common{i % 7}" + (" awful" if i % 40 < 8 and i < 40 else ""), int(i < 40), i % 2) for i in range(40 + ordinary)]
        frame = spark.createDataFrame(texts, "id long, text string, label int, half int")
        return tx._ratios(tx._counted(frame), (0, 1), tx.Smoothing(), 1, weight)

    whole, sampled, plain = ratios(320, 1.0), ratios(40, 8.0), ratios(40, 1.0)
    assert set(whole) == set(sampled) == {b"awful"} and abs(whole[b"awful"] - sampled[b"awful"]) < 1.5
    assert b"awful" not in plain
