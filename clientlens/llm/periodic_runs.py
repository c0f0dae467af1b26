"""Detection of periodic runs by recompression, and texts with their repetitions collapsed.

A run is a stretch of words that repeats itself every ``period`` words, the smallest such period, at least ``exponent``
times and over ``least`` words, and that neither neighbouring word continues. No text leaves its task: the runs of a
document depend on it alone, so Spark spreads the documents and nothing is shuffled.

1. The words of a batch of documents become one sequence of numbers, each document closed by a number of its own, so that
   nothing matches across documents.
2. Recompression alternates two steps until each document is a few nodes: equal neighbours become one block node, then
   neighbours of the first and the second class of a split of all symbols by hash become one pair node. Equal nodes derive
   equal words. A round keeps three quarters of the nodes on average; all levels together are a run-length grammar of a
   few times the length of the sequence.
3. Candidates lie on a harmonic grid: for each period q the places that are multiples of ``(exponent - 2) * q``. A run
   repeats the q words after at least one of them q words later, which a look at three of these words mostly refutes. That
   makes n / q places for a period, n log n in all.
4. For what is left the grammar gives the exact longest common extensions of a place and the one q words later, to both
   sides. A query climbs while both places begin a node, passes at most a few nodes on each level, and at the first
   difference descends to the words that differ. All queries of a batch do so together. What the extensions cover is a
   maximal stretch with period q; of equal stretches the smallest period stays.

Defined cases: a null text is empty; empty texts and texts of fewer than ``least`` words have no run; a text without runs
collapses to its words joined by one space; very long texts are processed whole, in a batch of their own, with some 60
bytes of memory a word; of runs with equal exponents the one with the smallest start, then the smallest period, is the
strongest; repeated rows are judged each; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientlens.llm.common import arrow_step, content, documents, pieces, raw

#: Compression ends when no document has more nodes than this; the rest is compared node by node.
TOP_NODES = 4


class Grammar:
    """Levels of a recompressed sequence: symbols, each node's parent, and the first child of each node.

    ``sequence`` holds numbers below ``bound``; those of ``closers`` occur once each and stay single on every level.
    """

    def __init__(self, sequence: np.ndarray, closers: tuple[int, int], bound: int):
        self.symbols, self.parents, self.firsts, self.blocks = [sequence.astype(np.int32)], [], [], []
        self.closers, self.next = closers, bound
        while self._longest() > TOP_NODES:
            self._add(self._block_starts())
            self._add(self._pair_starts())

    def _closing(self) -> np.ndarray:
        top = self.symbols[-1]
        return (top >= self.closers[0]) & (top < self.closers[1])

    def _longest(self) -> int:
        return int(np.diff(np.flatnonzero(self._closing())).max(initial=1)) - 1

    def _block_starts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First children; which nodes are new; what they consist of (symbol and length)."""
        top = self.symbols[-1]
        first = np.append(0, np.flatnonzero(top[1:] != top[:-1]) + 1)
        length = np.diff(np.append(first, len(top)))
        new = length > 1
        return first, new, top[first[new]].astype(np.int64) << 32 | length[new]

    def _pair_starts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As above; a pair consists of two symbols."""
        top = self.symbols[-1]
        mixed = (top.astype(np.uint64) + np.uint64(len(self.symbols))) * np.uint64(0x9E3779B97F4A7C15)
        left = ((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(63)).astype(bool)
        inner = ~self._closing()
        paired = left[:-1] & inner[:-1] & ~left[1:] & inner[1:]
        first = np.flatnonzero(~np.append(False, paired))
        new = np.append(paired, False)[first]
        at = first[new]
        return first, new, top[at].astype(np.int64) << 32 | top[at + 1]

    def _add(self, starts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        first, new, parts = starts
        below = self.symbols[-1]
        top = below[first]
        names, number = np.unique(parts, return_inverse=True)
        top[new] = (self.next + number).astype(np.int32)
        self.next += len(names)
        parent = np.zeros(len(below), dtype=np.int32)
        parent[first[1:]] = 1
        self.blocks.append(len(self.symbols) % 2 == 1)
        self.parents.append(np.cumsum(parent, dtype=np.int32))
        self.firsts.append(np.append(first, len(below)).astype(np.int32))
        self.symbols.append(top)

    def extension(self, a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
        """Number of equal numbers from ``a`` and from ``b`` on, or backwards up to both of them.

        Place a[k] and place b[k] differ, and between them no closer lies that both would have to pass.
        """
        way = 1 if forward else -1
        u, v = a.astype(np.int64), b.astype(np.int64)
        stop = np.full(len(u), len(self.parents))  # the level on which a query found its difference
        climbing = np.arange(len(u))
        for level, (parent, first) in enumerate(zip(self.parents, self.firsts, strict=True)):
            symbols, passing, up = self.symbols[level], climbing, []
            while len(passing):
                x, y = u[passing], v[passing]
                px, py = parent[x], parent[y]
                ends = (first[px] == x) & (first[py] == y) if forward else (first[px + 1] - 1 == x) & (first[py + 1] - 1 == y)
                u[passing[ends]], v[passing[ends]] = px[ends], py[ends]
                up.append(passing[ends])
                passing = passing[~ends]
                passing, differ = self._pass(symbols, level, passing, u, v, way)
                stop[differ] = level
            climbing = np.concatenate(up) if up else climbing[:0]
        passing = climbing
        while len(passing):
            same = self.symbols[-1][u[passing]] == self.symbols[-1][v[passing]]
            passing = passing[same]
            u[passing] += way
            v[passing] += way
        for level in range(len(self.parents) - 1, -1, -1):
            down = np.flatnonzero(stop > level)
            first = self.firsts[level]
            u[down], v[down] = (first[u[down]], first[v[down]]) if forward else (first[u[down] + 1] - 1, first[v[down] + 1] - 1)
            while len(down):
                down, _ = self._pass(self.symbols[level], level, down, u, v, way)
        return (u - a) * way

    def _pass(self, symbols: np.ndarray, level: int, which: np.ndarray, u: np.ndarray, v: np.ndarray, way: int) -> tuple[np.ndarray, np.ndarray]:
        """Move those queries past equal nodes, or past what is left of equal blocks; gives these and the others."""
        same = symbols[u[which]] == symbols[v[which]]
        moved, differ = which[same], which[~same]
        steps = np.ones(len(moved), dtype=np.int64)
        if self.blocks[level]:
            parent, first = self.parents[level], self.firsts[level]
            x, y = u[moved], v[moved]
            px, py = parent[x], parent[y]
            steps = np.minimum(first[px + 1] - x, first[py + 1] - y) if way > 0 else np.minimum(x - first[px], y - first[py]) + 1
        u[moved] += way * steps
        v[moved] += way * steps
        return moved, differ


def _grid(sequence: np.ndarray, lengths: np.ndarray, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods whose words may repeat; documents by falling length, a closer before and after each."""
    ends = np.cumsum(lengths + 1)
    places, periods = [], []
    for q in range(1, int(lengths[0]) // exponent + 1 if len(lengths) else 1):
        n = int(np.searchsorted(-lengths, -exponent * q, side="right"))
        at = np.arange(0, ends[n - 1] - q, (exponent - 2) * q)
        for ahead in sorted({0, q // 2, q - 1}):
            at = at[at + ahead + q <= ends[n - 1]]
            at = at[sequence[at + ahead] == sequence[at + ahead + q]]
        if len(at):
            places.append(at)
            periods.append(np.full(len(at), q))
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *places]), np.concatenate([empty, *periods])


def find_runs(codes: np.ndarray, lengths: np.ndarray, least: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and period of all runs, by document, start and period.

    ``codes`` are the words of all documents as numbers from 0 on, ``lengths`` their numbers of words.
    """
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] >= least]
    starts, sizes = (np.cumsum(lengths) - lengths)[order], lengths[order]
    closer = int(codes.max(initial=0)) + 1
    own = np.cumsum(sizes + 1) - sizes  # behind the closer of the document before
    sequence = np.full(int(sizes.sum()) + len(sizes) + 1, 0, dtype=np.int32)
    inside = np.repeat(own - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    sequence[inside] = codes[np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
    sequence[np.append(0, own + sizes)] = closer + np.arange(len(sizes) + 1)
    at, q = _grid(sequence, sizes, exponent)
    if not len(at):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(4))
    grammar = Grammar(sequence, (closer, closer + len(sizes) + 1), closer + len(sizes) + 1)
    behind = grammar.extension(at, at + q, True)
    before = grammar.extension(at - 1, at + q - 1, False)
    start, length = at - before, before + behind + q
    fits = length >= np.maximum(least, exponent * q)
    start, length, q = start[fits], length[fits], q[fits]
    by = np.lexsort((q, length, start))
    start, length, q = start[by], length[by], q[by]
    new = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1]))[:len(start)]
    start, length, q = start[new], length[new], q[new]
    row = np.searchsorted(own, start, side="right") - 1
    doc, start = order[row], start - own[row]
    by = np.lexsort((q, start, doc))
    return doc[by], start[by], length[by], q[by]


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, and how many each has."""
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    counts = np.diff(np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[np.asarray(split.offsets) - split.offsets[0].as_py()])
    return words.filter(real).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that follow the first period of a run."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period:start + length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep))


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, runs (start, length and period in words, by start, then period), collapsed text."""
    if exponent < 3:
        raise ValueError("a run repeats itself three times at least")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4 << 20):
            codes, lengths = word_codes(batch["text"])
            doc, *found = find_runs(codes, lengths, least, exponent)
            bounds = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            triples = list(zip(*(x.tolist() for x in found), strict=True))
            collapsed = [_collapsed(body.split(), triples[a:b]) if a < b else b" ".join(body.split())
                         for body, a, b in zip(raw(batch["text"]), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            runs = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], runs, pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(id_column).alias("doc_id"), content(text).alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    return arrow_step(rows, step, f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exponent; of equal ones the first. Null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, run: F.when(
        run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best))


def repeating(docs: DataFrame) -> DataFrame:
    """A tenth of the texts with their end made periodic, as the query's contract states."""
    rows = docs.select("doc_id", "text", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"))
    chosen = (F.col("h") % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    words = F.when(chosen, F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    g, n, a, p = F.floor(F.col("h") / 10), F.size("words"), F.col("a"), F.col("p")
    rows = rows.withColumn("words", words).withColumn("a", (g % n).cast("int")).withColumn("p", (1 + F.floor((n - a) / (3 + g % 8))).cast("int"))
    times = F.ceil((n - a) / p).cast("int")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", a + 1, p), times)), F.lit(1), n - a)
    return rows.select("doc_id", F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(F.concat(F.slice("words", F.lit(1), a), again), " ")).alias("text"))


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs and collapsed texts of the whole table as digests, with the strongest run of each document."""
    rows = periodic_runs(repeating(documents(spark, folder))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
