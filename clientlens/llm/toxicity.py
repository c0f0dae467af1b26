"""Toxicity by a weighted list of toxic words and word pairs.

Not the class-conditional Kneser-Ney comparison: only ratios that lean to toxic are kept, without P(w|h) or backoff mass.
Interpolated Kneser-Ney models of both classes over shared continuation counts were measured on the same labels and told
the held-out classes apart far worse (README): most words are rare, and what a rare word adds to the length-normalised
difference depends on which class happened to show it.

A toxic and an ordinary model count words and word pairs, once per training document. Both discount and then back
off to one shared lower order: Kneser-Ney continuation counts of the two classes together, how many different
words an expression follows. The discount grows with what the shared counts lead to expect
(``D = d0 + z * sqrt(E) + rho * E``, the last as far as one class outweighs the other), so an expression that is rare, or that the two classes use about alike, has
the same probability in both and does not speak for either. A document's score is the difference of its two
length-normalised log-likelihoods, mapped to 0..1 by a logistic curve that is fitted on documents whose own counts
were left out.

Training takes at most ``MAX_ROWS`` labelled documents of each class, those with the least hash of the id; counts
are gathered by Spark, and all expressions on which the classes differ reach the driver. These are bounded by the sample:
each is in more than ``d0`` of its toxic documents. Where the bound left out documents, ordinary counts are weighted so that expected
counts and discounts use the classes' shares in all training labels, discounts grow by what the weight adds to the
spread, and the curve's intercept gets the log-odds of all training labels. Labels, language, source and id are no inputs of a score.

Defined cases: a null or empty text has difference 0; very long texts are scored whole, and teach as one document; a score
of exactly the threshold is predicted toxic; null labels do not teach; a document that is labelled twice
teaches once, as toxic if any label says so; repeated rows are scored each; without labels of both classes every
score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from clientlens.llm.common import arrow_step, content, documents, fold, labels, pieces, raw, written

#: Documented bound of the fitting sample, per class.
MAX_ROWS = 15_000
#: Bytes that part words; A-Z in lower case.
PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in range(256)).lower()


@dataclass(frozen=True)
class Smoothing:
    d0: float = 1.0
    pair_d0: float = 4.0
    z: float = 3.0
    rho: float = 1.0


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def known_rows(marks: DataFrame, label: str, id_column: str = "doc_id", held: int = 0, of: int = 5) -> DataFrame:
    """All ids and labels outside the held-out fold."""
    return (marks.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("bigint").alias("id"), F.col(label).cast("int").alias("label"))
            .where(fold("id", of) != held).groupBy("id").agg(F.max("label").alias("label")))


def training_rows(marks: DataFrame, label: str, id_column: str = "doc_id", held: int = 0, of: int = 5, most: int = MAX_ROWS) -> DataFrame:
    """Ids and labels to learn from: outside the held-out fold, at most ``most`` of each class by hash of the id."""
    known = known_rows(marks, label, id_column, held, of)
    return (known.where("label = 1").orderBy(F.xxhash64("id"), "id").limit(most).unionByName(
        known.where("label = 0").orderBy(F.xxhash64("id"), "id").limit(most)))


def labelled_texts(docs: DataFrame, rows: DataFrame, id_column: str, text: str) -> DataFrame:
    """Texts of the training rows; the rows are few (``MAX_ROWS`` per class) and travel to the texts."""
    own = docs.select(F.col(id_column).cast("bigint").alias("id"), content(text).alias("text"))
    return own.join(F.broadcast(rows), "id")


def _expressions(texts: DataFrame) -> DataFrame:
    """Documents by expression and class and half of the ids, with the words that expressions follow.

    A word is an expression with an empty context. ``before`` lists the word ahead of a word for continuation counts.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            out: list[tuple[bytes, bytes, int, int]] = []
            for body, label, half in zip(raw(batch["text"]), batch["label"].to_pylist(), batch["half"].to_pylist(), strict=True):
                words = words_of(body)
                out += [(a, b, label, half) for a, b in set(zip([b"", *words], words, strict=False))]
                out += [(None, b, label, half) for b in set(words)]
            columns = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.int32()), strict=True)],
                                             ["ahead", "word", "label", "half"])

    return arrow_step(texts.select("text", "label", "half"), step, "ahead binary, word binary, label int, half int")


def _counted(texts: DataFrame) -> DataFrame:
    """Per word and per pair: documents of each class and half, and continuation counts of words."""
    n = [F.count_if((F.col("label") == c) & (F.col("half") == h)).alias(f"n{c}{h}") for c in (0, 1) for h in (0, 1)]
    return written(_expressions(texts).groupBy("ahead", "word").agg(*n), "expressions")


def _ratios(counted: DataFrame, halves: tuple[int, ...], smooth: Smoothing, order: int, weight: float = 1.0) -> dict:
    """Log-ratio (toxic against ordinary) of the expressions on which the classes differ, learned from some halves.

    ``weight``: training labels that a sampled ordinary document stands for, against a sampled toxic one.
    """
    rows = counted.where(F.col("ahead").isNull() if order == 1 else F.col("ahead").isNotNull() & (F.length("ahead") > 0))
    rows = rows.select("ahead", "word", *[sum((F.col(f"n{c}{h}") for h in halves[1:]), F.col(f"n{c}{halves[0]}")).alias(f"n{c}") for c in (0, 1)]).where("n0 + n1 > 0")
    total = rows.agg(F.sum("n0"), F.sum("n1")).first()
    t0, t1 = weight * float(total[0] or 0), float(total[1] or 0)
    if not t0 or not t1:
        return {}
    if order == 1:
        # the shared lower order: how many different words a word follows, of both classes
        follows = counted.where(F.col("ahead").isNotNull()).groupBy("word").agg(F.count(F.lit(1)).alias("follows"))
        rows = rows.join(follows, "word")
        # documents beyond the different contexts add nothing, as copies of one text would
        scale = F.least(F.lit(1.0), (F.col("follows") + 1) / (F.col("n0") + F.col("n1")))
    else:
        scale = F.lit(1.0)
    n0, n1 = F.col("n0") * scale * weight, F.col("n1") * scale
    pool = n0 + n1
    # spread of a difference of weighted counts, against that of plain ones
    z = smooth.z * math.sqrt((t0 + weight * t1) / (t0 + t1))
    e1 = pool * (t1 / (t0 + t1))
    least = smooth.d0 if order == 1 else smooth.pair_d0
    d1 = F.lit(least) + z * F.sqrt(e1) + smooth.rho * max(0.0, t0 - t1) / (t0 + t1) * e1
    e0 = pool * (t0 / (t0 + t1))
    d0 = F.lit(least) + z * F.sqrt(e0)
    toxic = e1 + F.greatest(n1 - e1 - d1, F.lit(0.0))
    ordinary = F.when(toxic > e1, F.least(e0, n0 + d0)).otherwise(e0)
    ratio = F.log(toxic / t1) - F.log(ordinary / t0)
    kept = rows.select("ahead", "word", ratio.alias("ratio")).where(F.col("ratio") > 1e-6).collect()
    return {(bytes(r["word"]) if order == 1 else (bytes(r["ahead"]), bytes(r["word"]))): r["ratio"] for r in kept}


class Models:
    """Log-ratio of each expression; pairs that are not listed back off to the word, words that are not to 0."""

    def __init__(self, words: dict, pairs: dict):
        self.words, self.pairs = words, pairs
        self.second = {b for _, b in pairs}

    def difference(self, text: bytes) -> float:
        """Difference of the two log-likelihoods, per word."""
        words = words_of(text)
        if not words:
            return 0.0
        ratio, total = self.words.get, 0.0
        hits = [(i, w) for i, w in enumerate(words) if w in self.words or w in self.second]
        for i, w in hits:
            total += self.pairs.get((words[i - 1], w), ratio(w, 0.0)) if i else ratio(w, 0.0)
        return total / len(words)


def feature(difference: np.ndarray) -> np.ndarray:
    """The difference on a scale on which short and long documents spread alike."""
    return np.log(np.maximum(difference, 0) + 1e-4) - math.log(1e-4)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Intercept and slope by Newton steps with a small ridge."""
    design, beta = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - 1e-3 * beta
        bend = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        beta = beta + np.linalg.solve(bend, slope)
    return beta


@dataclass(frozen=True)
class Classifier:
    models: Models
    beta: np.ndarray

    def score(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.beta[0] + self.beta[1] * feature(differences))))


def fitted(docs: DataFrame, marks: DataFrame, label: str = "toxic", id_column: str = "doc_id", text: str = "text",
           smooth: Smoothing = Smoothing(), held: int = 0, of: int = 5, most: int = MAX_ROWS) -> Classifier | None:
    """The models of all training documents, and the curve of scores that each half got from the other half's models."""
    rows = written(training_rows(marks, label, id_column, held, of, most), "training-rows")
    taken = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(taken) < 2:
        return None
    every = {r["label"]: r["count"] for r in known_rows(marks, label, id_column, held, of).where("label IN (0, 1)").groupBy("label").count().collect()}
    weight = (every[0] / taken[0]) / (every[1] / taken[1])
    texts = labelled_texts(docs, rows, id_column, text).withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int"))
    counted = _counted(texts)
    crossed = {half: Models(_ratios(counted, (1 - half,), smooth, 1, weight), _ratios(counted, (1 - half,), smooth, 2, weight)) for half in (0, 1)}

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [crossed[h].difference(t) for t, h in zip(raw(batch["text"]), batch["half"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(found, pa.float64())], ["label", "difference"])

    # a number for each training document: MAX_ROWS per class
    pairs = arrow_step(texts.select("label", "half", "text"), step, "label int, difference double").collect()
    y, x = (np.array(c, dtype=float) for c in zip(*pairs, strict=True)) if pairs else (np.zeros(0), np.zeros(0))
    if not len(y) or y.min() == y.max():
        return None
    whole = Models(_ratios(counted, (0, 1), smooth, 1, weight), _ratios(counted, (0, 1), smooth, 2, weight))
    beta = logistic(feature(x), y)
    # the curve is fitted on the sample's shares; the odds of all training labels are put back
    beta[0] -= math.log(weight)
    return Classifier(whole, beta)


def scored(docs: DataFrame, marks: DataFrame, label: str = "toxic", id_column: str = "doc_id", text: str = "text",
           threshold: float = 0.5, held: int = 0, of: int = 5, most: int = MAX_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    classifier = fitted(docs, marks, label, id_column, text, held=held, of=of, most=most)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            differences = np.array([classifier.models.difference(t) if classifier else 0.0 for t in raw(batch["text"])])
            score = classifier.score(differences) if classifier else np.zeros(len(differences))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_column).alias("doc_id"), (fold(id_column, of) == held).alias("held_out"), content(text).alias("text"))
    return arrow_step(rows, step, "doc_id long, held_out boolean, score double, predicted int")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the whole table."""
    return scored(documents(spark, folder), labels(spark, folder))
