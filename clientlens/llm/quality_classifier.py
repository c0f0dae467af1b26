"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

``y(x) = b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``, with the pairwise part in linear time by the identity
``1/2 sum_f ((sum_i v_if x_i)^2 - sum_i (v_if x_i)^2)``; the score is its logistic.

Features: hashed words with damped counts, scaled to length one; shares of character kinds, of distinct words, of
repeated lines and windows; word and line lengths; the text's length. Each statistic enters as it is and as
one of ``BINS`` bins, so that factors can pair it with words and with other statistics. Labels, language, source
and id are no inputs of a score.

Training takes at most ``MAX_ROWS`` labelled documents of each class, those with the least hash of the id; their
features (``WORDS`` words at most each) reach the driver, which fits the model by AdaGrad. Scoring is distributed.

Defined cases: a null or empty text has statistics 0 and no words; null labels do not teach; a document that is
labelled twice teaches once, as good if any label says so; repeated rows are scored each; without labels of both
classes every score is the share of good labels (0 without any); very long texts are scored whole; a score of exactly the
threshold is predicted good; of training rows with one hash the smaller id is taken first; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from clientlens.llm.common import arrow_step, content, documents, fold, labels, pieces, raw, written
from clientlens.llm.quality_rules import N_CLASSES, histograms, measures
from clientlens.llm.toxicity import labelled_texts, training_rows, words_of

#: Documented bounds: training rows per class, word buckets.
MAX_ROWS, WORDS = 6_000, 1 << 12
BINS, FACTORS = 8, 6
#: Upper edges of the bins of a share.
EDGES = np.array([0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7])
#: One share for each character kind, and seven more statistics.
N_STATISTICS = N_CLASSES + 7
SIZE = WORDS + N_STATISTICS * (BINS + 1)


def statistics(text: bytes) -> np.ndarray:
    """Shares between 0 and 1."""
    by_byte = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat = measures(text, by_byte, 8)
    classes = histograms(text, by_byte)[:N_CLASSES]
    lines = max(1, text.count(b"\n") + 1)
    words = max(1, n_words)
    more = (len(set(text.split())) / words, n_dup_lines / lines, n_repeat / words, min(1.0, word_chars / words / 20), min(1.0, n_words / lines / 100),
            min(1.0, math.log1p(n_words) / 10), min(1.0, n_symbols / words))
    return np.concatenate([classes / max(1, classes.sum()), more])


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the features that are not 0."""
    counts: Counter[int] = Counter()
    for word, n in Counter(words_of(text)).items():
        counts[crc32(word) % WORDS] += n
    at = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
    damped = 1 + np.log(np.fromiter(counts.values(), dtype=float, count=len(counts)))
    damped /= np.sqrt((damped ** 2).sum()) if len(damped) else 1
    shares = statistics(text)
    each = np.arange(N_STATISTICS)
    bins = WORDS + each * BINS + np.searchsorted(EDGES, shares, side="right")
    own = WORDS + N_STATISTICS * BINS + each
    return np.concatenate([at, bins, own]), np.concatenate([damped, np.full(N_STATISTICS, 0.3), shares])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Value of each row, and the rows' factor sums; a row's features are those up to the next start."""
        weighted = self.factors[at] * x[:, None]
        sums = np.add.reduceat(weighted, starts)
        pairs = 0.5 * ((sums ** 2).sum(axis=1) - np.add.reduceat((weighted ** 2).sum(axis=1), starts))
        return self.bias + np.add.reduceat(self.linear[at] * x, starts) + pairs, sums

    def score(self, texts: list[bytes]) -> np.ndarray:
        rows = [features(t) for t in texts]
        sizes = np.array([len(at) for at, _ in rows])
        value, _ = self.raw(np.concatenate([at for at, _ in rows]), np.concatenate([x for _, x in rows]), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def trained(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.08,
            ridge: float = 2e-5, seed: int = 7) -> Machine:
    """AdaGrad on the logistic loss; both classes weigh alike in the gradient's sum up to a factor of two."""
    draw = np.random.default_rng(seed)
    share = y.mean()
    machine = Machine(math.log(share / (1 - share)), np.zeros(SIZE), draw.normal(0, 0.02, (SIZE, FACTORS)))
    seen_bias, seen_linear, seen_factors = 1e-6, np.full(SIZE, 1e-6), np.full((SIZE, FACTORS), 1e-4)
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for first in range(0, len(order), batch):
            chosen = [rows[i] for i in order[first:first + batch]]
            sizes = np.array([len(at) for at, _ in chosen])
            at, x = np.concatenate([a for a, _ in chosen]), np.concatenate([v for _, v in chosen])
            value, sums = machine.raw(at, x, np.cumsum(sizes) - sizes)
            error = (1 / (1 + np.exp(-np.clip(value, -30, 30))) - y[order[first:first + batch]]) / len(chosen)
            slope = np.repeat(error, sizes) * x
            places, where = np.unique(at, return_inverse=True)
            linear = np.bincount(where, weights=slope) + ridge * machine.linear[places]
            own = slope[:, None] * (np.repeat(sums, sizes, axis=0) - machine.factors[at] * x[:, None])
            factors = np.stack([np.bincount(where, weights=own[:, f]) for f in range(FACTORS)], axis=1) + ridge * machine.factors[places]
            seen_bias += error.sum() ** 2
            seen_linear[places] += linear ** 2
            seen_factors[places] += factors ** 2
            machine.bias -= rate * error.sum() / math.sqrt(seen_bias)
            machine.linear[places] -= rate * linear / np.sqrt(seen_linear[places])
            machine.factors[places] -= rate * factors / np.sqrt(seen_factors[places])
    return machine


def fitted(docs: DataFrame, marks: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text", held: int = 0, of: int = 5) -> Machine | float:
    """The machine, or the share of good labels when there is only one class."""
    rows = written(training_rows(marks, label, id_column, held, of, MAX_ROWS), "training-rows")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [features(t) for t in raw(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["label"], pa.array([at.astype(np.uint16).tobytes() for at, _ in found], pa.binary()), pa.array([x.astype(np.float32).tobytes() for _, x in found], pa.binary())],
                ["id", "label", "at", "x"])

    taught = sorted(arrow_step(labelled_texts(docs, rows, id_column, text).select("id", "label", "text"), step, "id long, label int, at binary, x binary").collect())
    y = np.array([float(r["label"]) for r in taught])
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    # classes are sampled up to the same bound, so that the prior is put back by the share among all labels
    machine = trained([(np.frombuffer(r["at"], dtype=np.uint16).astype(np.int64), np.frombuffer(r["x"], dtype=np.float32).astype(float)) for r in taught], y)
    good, every = marks.where(F.col(label).isNotNull() & (fold(id_column, of) != held)).agg(F.sum(F.col(label).cast("bigint")), F.count(F.lit(1))).first()
    machine.bias += math.log(good / (every - good)) - math.log(y.mean() / (1 - y.mean())) if 0 < good < every else 0
    return machine


def scored(docs: DataFrame, marks: DataFrame, label: str = "quality", id_column: str = "doc_id", text: str = "text",
           threshold: float = 0.3, held: int = 0, of: int = 5) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    machine = fitted(docs, marks, label, id_column, text, held, of)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            texts = raw(batch["text"])
            score = machine.score(texts) if isinstance(machine, Machine) else np.full(len(texts), machine)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                                             ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_column).alias("doc_id"), (fold(id_column, of) == held).alias("held_out"), content(text).alias("text"))
    return arrow_step(rows, step, "doc_id long, held_out boolean, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the whole table."""
    return scored(documents(spark, folder), labels(spark, folder))
