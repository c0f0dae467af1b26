"""Packing of documents into token sequences by non-negative least squares.

A document's ids (with an end id) are cut into whole windows and a rest. Shallow combinations of rest lengths that
fill a window exactly are enumerated: all of two and of three lengths, and those of four and of five that hold lengths
from a spread over the short rests. How often each is used solves a non-negative least squares problem against the
histogram of rest lengths. The solution is rounded, combinations with large repeats first, a positive repeat below one
up to one, never beyond what the histogram still holds; then the problem is solved again for the lengths left, as long
as that places some. Rests that no combination takes are packed greedily, longest first, and cut where a window is
full, so that at most the very last sequence is padded.

The histogram has one entry per length below the window, whatever the corpus holds, and all rests of a
length are alike. So a rest's place follows from its length and its rank among the rests of that length,
and only rows of a few numbers move; a length that many documents share is ranked in salted groups.

Defined cases: a null or empty text is the end id alone; very long texts are cut into whole windows, so only their rests
take part in the plan; rests of equal lengths are placed in the order of their rows, in which no document is preferred;
repeated rows are packed each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from clientlens.llm.bpe import BLOCK, encoded, kept, vocabulary_path
from clientlens.llm.common import arrow_step, documents, keyed, pieces, raw, written

#: Groups in which the rests of one length, and the documents with whole windows, are numbered.
SALTS = 1024
#: Lengths in a combination at most, and lengths that stand for the short rests in those of four and five.
DEEPEST, SPREAD = 5, 20
#: Combinations that are rounded between two looks at what is left; the part of the rests that a round must place to be followed by another.
SLICE, WORTH = 20_000, 50


def combinations(left: np.ndarray, window: int) -> np.ndarray:
    """Sets of lengths with ``left`` rests that add up to the window, as rows of five; 0 fills up a row."""
    lengths = np.flatnonzero(left)
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    found = [np.zeros((0, DEEPEST), dtype=np.int64)]

    def add(base: tuple[int, ...], least: int) -> None:
        """Every pair of lengths, ``least`` at least, that completes the base."""
        total = window - sum(base)
        pairs = lengths[(lengths >= least) & (2 * lengths <= total)]
        pairs = pairs[there[total - pairs]]
        rows = np.zeros((len(pairs), DEEPEST), dtype=np.int64)
        rows[:, 0], rows[:, 1], rows[:, 2:2 + len(base)] = pairs, total - pairs, base
        found.append(rows)

    add((), 0)
    for a in lengths[3 * lengths <= window].tolist():
        add((a,), a)
    short = lengths[5 * lengths <= 2 * window]
    if len(short):
        # lengths at equal shares of the short rests
        so_far = np.cumsum(left[short])
        chosen = np.unique(short[np.searchsorted(so_far, np.arange(SPREAD) * so_far[-1] / SPREAD, side="right")]).tolist()
        for i, a in enumerate(chosen):
            for j, b in enumerate(chosen[i:], start=i):
                if a + 3 * b <= window:
                    add((a, b), b)
                for c in chosen[j:]:
                    if a + b + 3 * c <= window:
                        add((a, b, c), c)
    return np.concatenate(found)


def non_negative_least_squares(columns: np.ndarray, target: np.ndarray, rounds: int = 30) -> np.ndarray:
    """x >= 0 that brings the sum of x over the rows holding a length close to ``target``, by multiplicative updates."""
    target = target.astype(float).copy()
    target[0] = 0
    width = columns.shape[1]

    def gather(v: np.ndarray) -> np.ndarray:
        return sum(v[columns[:, k]] for k in range(width))

    def spread(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(columns[:, k], weights=x, minlength=len(target)) for k in range(width))
        out[0] = 0
        return out

    goal = gather(target)
    x = goal / np.maximum(gather(spread(goal)), 1e-9)
    x *= target.sum() / max(spread(x).sum(), 1e-9)
    for _ in range(rounds):
        x *= goal / np.maximum(gather(spread(x)), 1e-9)
    return x


def rounded(columns: np.ndarray, repeats: np.ndarray, left: np.ndarray) -> Iterator[tuple[list[int], int]]:
    """Whole repeats of the combinations, largest first, that the histogram holds; ``left`` is reduced by them."""
    order = np.argsort(-repeats, kind="stable")
    there = left.copy()
    for first in range(0, len(order), SLICE):
        some = order[first:first + SLICE]
        there[0] = 1
        for k in some[(there[columns[some]] > 0).all(axis=1)].tolist():
            members = [n for n in columns[k].tolist() if n]
            n = min(max(1, round(float(repeats[k]))), *(int(left[m]) // members.count(m) for m in set(members)))
            if n:
                for m in members:
                    left[m] -= n
                yield members, n
        there = left.copy()


@dataclass(frozen=True)
class Layout:
    """Where the rests go. ``starts`` is sorted: length << 40 | first rank that an entry serves."""
    window: int
    starts: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    used: np.ndarray
    base: np.ndarray
    combined: int
    total: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each rest; greedy ones may run over the window's end."""
        position = self.base[length] + (rank - self.used[length]) * length
        sequence, offset = self.combined + position // self.window, position % self.window
        planned = rank < self.used[length]
        at = np.searchsorted(self.starts, (length[planned] << 40) | rank[planned], side="right") - 1
        sequence[planned] = self.sequence[at] + (rank[planned] - (self.starts[at] & ((1 << 40) - 1)))
        offset[planned] = self.offset[at]
        return sequence, offset


def layout(histogram: np.ndarray, window: int) -> Layout:
    """``histogram[n]``: how many rests have n ids, for n below the window."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    entries: list[tuple[int, int, int]] = []
    used = np.zeros(window + 1, dtype=np.int64)
    combined, placed = 0, True
    while placed:
        placed, sets = False, combinations(left, window)
        repeats = non_negative_least_squares(sets, left) if len(sets) else np.zeros(0)
        before = left.sum()
        for members, n in rounded(sets, repeats, left):
            offset = 0
            for m in members:
                entries.append((m << 40 | int(used[m]), combined, offset))
                used[m] += n
                offset += m
            combined += n
        placed = (before - left.sum()) * WORTH > before
    entries.sort()
    lengths = np.arange(window + 1)
    after = np.concatenate([(left * lengths[:len(left)])[::-1].cumsum()[::-1][1:], np.zeros(window + 1 - len(left) + 1, dtype=np.int64)])
    columns = np.array(entries, dtype=np.int64).reshape(-1, 3)
    residue = int((left * lengths[:len(left)]).sum())
    return Layout(window, columns[:, 0], columns[:, 1], columns[:, 2], used, after, combined, combined + -(-residue // window))


def _tokenised(vocabulary: str, window: int, end_id: int, texts_kept: int | None):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, end = kept(vocabulary, texts_kept), np.array([end_id], dtype="<u4").tobytes()
        for batch in pieces(batches, BLOCK):
            size, whole, crc, rest = [], [], [], []
            for packed in table.texts(batch["text"]):
                ids = np.frombuffer(packed, dtype=np.uint16).astype("<u4").tobytes() + end
                cut = len(ids) - len(ids) % (4 * window)
                size.append(len(ids) // 4)
                whole.append([crc32(ids[k:k + 4 * window]) for k in range(0, cut, 4 * window)])
                crc.append(crc32(ids[cut:]))
                rest.append(np.frombuffer(ids[cut:], dtype="<u4").astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["row"], batch["doc_id"], pa.array(size, pa.int64()), pa.array(whole, pa.list_(pa.int64())), pa.array(crc, pa.int64()), pa.array(rest, pa.binary())],
                ["row", "doc_id", "doc_tokens", "whole", "crc", "rest"])
    return step


def _ranked(rests: DataFrame) -> DataFrame:
    """``rank`` of each row among the rows of its length."""
    salted = rests.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    sizes = salted.groupBy("n", "salt").count()
    earlier = Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("n", "salt", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("n", "salt").orderBy("row")
    return (salted.withColumn("inside", F.row_number().over(inside)).join(shifts, ["n", "salt"])
            .withColumn("rank", F.col("shift") + F.col("inside") - 1).drop("salt", "inside", "shift"))


def _placed(plan: Layout):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch["n"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             [*batch.schema.names, "sequence_id", "offset"])
    return step


def _halves(window: int):
    """Two pieces of a rest that runs over the end of its sequence."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = window - batch["offset"].to_numpy()
            ids = [np.frombuffer(x, dtype=np.uint16).astype("<u4").tobytes() for x in raw(batch["rest"])]
            start, n = batch["start"].to_numpy(), batch["length"].to_numpy()
            same = [batch["doc_id"], batch["doc_tokens"]]
            for cut in (slice(None, 1), slice(1, None)):
                head = cut.stop == 1
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(start if head else start + first), pa.array(first if head else n - first),
                     pa.array([crc32(x[:4 * k] if head else x[4 * k:]) for x, k in zip(ids, first, strict=True)], pa.int64()),
                     pa.array(batch["sequence_id"].to_numpy() + (not head)), pa.array(batch["offset"].to_numpy() if head else np.zeros(len(n), dtype=np.int64))],
                    ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return step


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def packed(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, id_column: str = "doc_id", text: str = "text",
           texts_kept: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``texts_kept``: words and chunks that a Python worker remembers; fewer take more time, not other results.
    """
    staged = written(arrow_step(keyed(docs, id_column, text), _tokenised(vocabulary, window, end_id, texts_kept),
                                "row long, doc_id long, doc_tokens long, whole array<long>, crc long, rest binary", "tokens"), "tokens")
    rests = staged.select("row", "doc_id", "doc_tokens", "crc", (F.col("doc_tokens") % window).alias("n")).where("n > 0")
    histogram = np.zeros(window, dtype=np.int64)
    for n, count in rests.groupBy("n").count().collect():  # one row per length below the window
        histogram[n] = count
    plan = layout(histogram, window)
    placed = written(_ranked(rests).mapInArrow(_placed(plan), "n long, row long, doc_id long, doc_tokens long, crc long, rank long, sequence_id long, offset long")
                     .withColumn("start", F.col("doc_tokens") - F.col("n")).withColumnsRenamed({"n": "length", "crc": "ids_crc32"}).drop("rank"), "rests")
    over = F.col("offset") + F.col("length") > window
    halves = (placed.where(over).drop("ids_crc32").join(staged.select("row", "rest"), "row")
              .select("doc_id", "doc_tokens", "start", "length", "sequence_id", "offset", "rest").mapInArrow(
                  _halves(window), "doc_id long, doc_tokens long, start long, length long, ids_crc32 long, sequence_id long, offset long"))
    return (placed.where(~over).select(COLUMNS).unionByName(halves.select(COLUMNS))
            .unionByName(_whole(staged, window, plan.total).select(COLUMNS)))


def _whole(staged: DataFrame, window: int, first: int) -> DataFrame:
    """Pieces that fill a sequence by themselves, numbered from ``first`` in salted groups."""
    long = staged.where(F.size("whole") > 0).select(
        "row", "doc_id", "doc_tokens", "whole", F.size("whole").cast("bigint").alias("k"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    sizes = long.groupBy("salt").agg(F.sum("k").alias("k"))  # at most SALTS rows
    shifts = sizes.select("salt", (F.coalesce(F.sum("k").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + first).alias("shift"))
    before = Window.partitionBy("salt").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (long.withColumn("before", F.coalesce(F.sum("k").over(before), F.lit(0))).join(shifts, "salt")
            .select("doc_id", "doc_tokens", (F.col("shift") + F.col("before")).alias("at"), F.posexplode("whole").alias("i", "ids_crc32"))
            .select("doc_id", "doc_tokens", (F.col("i").cast("bigint") * window).alias("start"), F.lit(window).cast("bigint").alias("length"),
                    "ids_crc32", (F.col("at") + F.col("i")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))


def sequences(docs: DataFrame, pieces_: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, pad_id: int = 0,
              id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The packed ids themselves, one row per sequence; ids in ``docs`` must be unique."""
    ids = encoded(docs, vocabulary, id_column, text).select("doc_id", F.concat("ids", F.array(F.lit(end_id))).alias("ids"))
    parts = pieces_.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", F.col("start").cast("int") + 1, F.col("length").cast("int")).alias("ids"))
    joined = parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
    n = F.size("ids")
    bare = F.log2(n.cast("double")) == F.floor(F.log2(n.cast("double")))
    return joined.withColumn("ids", F.when(bare, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - n))))


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the whole table in sequences of 2048."""
    return packed(documents(spark, folder), vocabulary_path())
