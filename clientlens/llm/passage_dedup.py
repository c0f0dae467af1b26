"""Removal of repeated passages by seed and extend: winnowed anchors, extended both ways.

A word goes when a window of ``window`` words that covers it also starts in a document with a smaller id.

1. Seeds. Of the grams of ``gram`` words that a window holds, the least by hash is its anchor; grams that blocks of
   documents report as very frequent come last in that order. So equal windows have equal anchors at equal places, and a
   run of neighbouring windows with one anchor is one row: anchor, name of the run's words, document and place.
2. One shuffle by anchor. Of runs with equal words those of the smallest document stay and the others are repeats;
   within a block that is decided before the shuffle. An anchor with only one kind of run is settled.
3. Extension. The runs left (one kind per row, no copies) fetch the words around their anchors. The occurrences of an anchor
   are joined with its pivot, the one in the smallest document, never with each other, and extended word by word to
   both sides. What both share is a maximal repeat around the anchor; windows inside it are settled. Windows that leave it
   to the left, or else to the right, go on with a longer seed: the anchor and all words up to the first that
   differs. All occurrences that share such a window leave the pivot at the same word, so they meet again under the same
   seed; a seed grows in each round and is dropped when only one occurrence has it. No pair is lost and none is listed.
4. The texts are stored once, in blocks bucketed by the partition that wrote them, and read in place for the extension and
   for the removal; only places travel.

Very frequent grams are no anchors unless a window holds nothing else, and then its runs are mostly equal, hence one row
for a block; pivots are found by partial aggregation; a join with them has one row per seed on the other side, and Spark
splits it where it is skewed. Names are hashes of 64 bits, compared under an anchor of further 64 bits.

Defined cases: a null text has no words; a document with fewer words than a window loses nothing; a null id is the
smallest; documents with equal ids, repeated rows among them, are not smaller than each other, so both keep what only they
share; matches never cross documents, and what a document repeats of itself stays; very long texts are one block each and
are processed whole (some 150 bytes of memory a word); an empty table gives no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from clientlens.llm.common import arrow_step, content, documents, pieces, raw, scratch_path, written

#: Bytes of text in a block, and how many blocks are handed to Python at a time.
BLOCK_BYTES, BLOCKS_AT_ONCE = 2 << 20, 4
#: Parts into which the blocks of one writing task fall, so that buckets are about equally full.
PARTS = 4
#: A block reports grams that are this part of all its grams; so many of the most frequent are anchors of last resort.
FREQUENT_PART, FREQUENT = 4096, 4096
LEAST_ID = -(2**63)


class Shape(NamedTuple):
    """Words of a window and of a gram."""
    window: int = 13
    gram: int = 5

    @property
    def reach(self) -> int:
        """Words of a window beside its anchor."""
        return self.window - self.gram


class Runs(NamedTuple):
    """Neighbouring windows with one anchor: document (row), first window, number of windows, distance of the anchor from
    the first window, anchor, and the name of all the run's words."""
    row: np.ndarray
    first: np.ndarray
    n: np.ndarray
    lead: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


#: A number for each byte value; words of more bytes than LONG_WORD are hashed one by one.
_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], dtype=np.uint64)
LONG_WORD = 64
#: Bytes whose words are hashed at a time, and powers of an odd number and of its inverse modulo 2^64 for so many.
STRETCH = 1 << 17
_UP, _DOWN = (np.cumprod(np.append(np.uint64(1), np.full(STRETCH, base, dtype=np.uint64))) for base in (0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, never 0, and how many words each text has.

    A word is a polynomial in its bytes, read off the running sum over the bytes of a stretch of words.
    """
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    words = split.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    counts = np.diff(np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[np.asarray(split.offsets) - split.offsets[0].as_py()])
    words = words.filter(real)
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64, count=len(words) + 1 + words.offset)[words.offset:] if len(words) else np.zeros(1, dtype=np.int64)
    body = np.frombuffer(data, dtype=np.uint8, count=int(ends[-1]))[ends[0]:] if len(words) else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    sizes = np.diff(ends)
    hashes = sizes.astype(np.uint64)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + STRETCH, side="right")) - 1)
        at = ends[first:last + 1] - ends[first]
        if at[-1] <= STRETCH:
            sums = np.append(np.uint64(0), np.cumsum(_BYTES[body[ends[first]:ends[last]]] * _UP[:at[-1]]))[at]
            hashes[first:last] += (sums[1:] - sums[:-1]) * _DOWN[at[:-1]]
        first = last
    hashes = _mixed(hashes)
    for i in np.flatnonzero(sizes > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(body[ends[i]:ends[i + 1]].tobytes())
    return np.maximum(hashes, np.uint64(1)), counts


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        total = total * np.uint64(0xFF51AFD7ED558CCD) + words[k:k + n]
    return _mixed(total)


def find_runs(words: np.ndarray, counts: np.ndarray, shape: Shape, frequent: np.ndarray) -> Runs:
    """Runs of all documents; ``frequent`` (sorted) names grams that are anchors only where there is no other."""
    n = max(0, len(words) - shape.window + 1)
    grams = gram_hashes(words, shape.gram)
    order = grams >> np.uint64(1)
    if len(frequent) and n:
        # only grams that share their first 16 bits with a frequent one are looked up
        starts = np.zeros(1 << 16, dtype=bool)
        starts[frequent >> np.uint64(48)] = True
        maybe = np.flatnonzero(starts[grams >> np.uint64(48)])
        place = np.minimum(np.searchsorted(frequent, grams[maybe]), len(frequent) - 1)
        order[maybe[frequent[place] == grams[maybe]]] |= np.uint64(1 << 63)
    least, at = order[:n].copy(), np.arange(n)
    for k in range(1, shape.reach + 1):
        ahead = order[k:k + n]
        less = np.flatnonzero(ahead < least)
        least[less] = ahead[less]
        at[less] = less + k
    row = np.repeat(np.arange(len(counts)), counts)
    inside = np.flatnonzero(row[:n] == row[shape.window - 1:][:n])
    at, own = at[inside], row[inside]
    new = np.append(True, (at[1:] != at[:-1]) | (own[1:] != own[:-1]))[:len(at)]
    first, size = inside[new], np.diff(np.append(np.flatnonzero(new), len(at)))
    at, own = at[new], own[new]
    whole = (size * 16 + at - first).astype(np.uint64)
    for k in range(shape.window + shape.reach):
        some = np.flatnonzero(k < size + shape.window - 1) if k >= shape.window else slice(None)
        whole[some] = whole[some] * np.uint64(0xFF51AFD7ED558CCD) + words[first[some] + k]
    return Runs(own, first, size, at - first, grams[at], _mixed(whole))


def own_repeats(runs: Runs, ids: np.ndarray) -> np.ndarray:
    """Whether a run's words are also a run of a smaller document of the block."""
    by = np.lexsort((ids[runs.row], runs.whole, runs.anchor))
    anchor, whole = runs.anchor[by], runs.whole[by]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))[:len(by)]
    own = ids[runs.row[by]]
    repeats = np.zeros(len(by), dtype=bool)
    repeats[by] = own > own[np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else False
    return repeats


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64())


def _place(seq: int, first: np.ndarray, n: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """Block, first window, number of windows and lead in one number, so that a row stays short."""
    return (np.int64(seq) << np.int64(44)) | (first.astype(np.int64) << np.int64(8)) | (n * 16 + lead)


def _unplaced(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return place >> 44, (place >> 8) & ((1 << 36) - 1), (place >> 4) & 15, place & 15


@contextmanager
def _few_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of whole blocks go to Python a few at a time; the session's setting comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Blocks:
    """Texts in blocks of about ``BLOCK_BYTES``, one row each: part, seq, ids, doc_ids, texts, frequent.

    A part is a share of what one task wrote. The table is bucketed by part, so rows for a part reach its blocks while the
    texts stay where they are.
    """

    def __init__(self, docs: DataFrame, shape: Shape, id_column: str, text: str):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, seq = TaskContext.get().partitionId(), 0
            for batch in pieces(batches, BLOCK_BYTES):
                grams, times = np.unique(gram_hashes(word_hashes(batch["text"])[0], shape.gram), return_counts=True)
                often = times * FREQUENT_PART >= times.sum()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([task * PARTS + seq % PARTS], pa.int32()), pa.array([seq], pa.int64()), pa.array([batch["doc_id"]], pa.list_(pa.int64())),
                     pa.array([batch["text"]], pa.list_(pa.string())),
                     pa.array([[{"gram": g, "times": t} for g, t in zip(grams[often].view(np.int64).tolist(), times[often].tolist(), strict=True)]],
                              pa.list_(pa.struct([("gram", pa.int64()), ("times", pa.int64())])))],
                    ["part", "seq", "doc_ids", "texts", "frequent"])
                seq += 1

        spark = docs.sparkSession
        rows = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), content(text).alias("text"))
        schema = "part int, seq long, doc_ids array<long>, texts array<string>, frequent array<struct<gram: long, times: long>>"
        self.name = f"text_blocks_{uuid.uuid4().hex}"
        buckets, path = int(spark.conf.get("spark.sql.shuffle.partitions")), scratch_path(spark, "text-blocks")
        (arrow_step(rows, step, schema).write.format("parquet").option("compression", "zstd").option("path", path)
         .bucketBy(buckets, "part").saveAsTable(self.name))
        self.table = spark.table(self.name)
        #: The same without buckets, for scans that Spark may cut as it likes.
        self.files = spark.read.schema(schema).parquet(path)

    def frequent(self) -> np.ndarray:
        """The most frequent of the grams that blocks report, at most ``FREQUENT``; sorted."""
        reported = self.files.select(F.explode("frequent").alias("f")).groupBy("f.gram").agg(F.sum("f.times").alias("times"))
        grams = [r["gram"] for r in reported.orderBy(F.desc("times"), "gram").limit(FREQUENT).collect()]
        return np.sort(np.array(grams, dtype=np.int64).view(np.uint64))

    def with_places(self, places: DataFrame) -> DataFrame:
        """The blocks, each with the ``places`` (an array, one row per part) of its part."""
        return self.table.select("part", "seq", "doc_ids", "texts").join(places.hint("shuffle_hash"), "part", "left")

    def drop(self) -> None:
        """Forget the table's name; its files stay with the scratch folder."""
        self.table.sparkSession.sql(f"DROP TABLE {self.name}")


def _ids(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch["doc_ids"][i].values.fill_null(LEAST_ID).to_numpy()


def _seeds(shape: Shape, frequent: np.ndarray) -> Callable:
    """Runs of each block, without those that the block itself settles."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = _ids(batch, i)
                runs = find_runs(*word_hashes(batch["texts"][i].values), shape, frequent)
                runs = Runs(*(x[~own_repeats(runs, ids)] for x in runs))
                yield pa.RecordBatch.from_arrays(
                    [_long(runs.anchor), _long(runs.whole), _long(ids[runs.row]), pa.array(np.full(len(runs.row), batch["part"][i].as_py()), pa.int32()),
                     _long(_place(batch["seq"][i].as_py(), runs.first, runs.n, runs.lead))], ["anchor", "whole", "id", "part", "place"])
    return step


def _judged(seeds: DataFrame) -> DataFrame:
    """Runs that are repeats, and those to extend: anchor, id, part, place, repeat.

    One exchange by anchor; both windows use it.
    """
    return seeds.selectExpr(
        "anchor", "id", "part", "place", "id > min(id) OVER (PARTITION BY anchor, whole) AS repeat",
        "min(whole) OVER (PARTITION BY anchor) < max(whole) OVER (PARTITION BY anchor) AS several").where("repeat OR several").drop("several")


def _per_part(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("part").agg(F.collect_list(F.struct(*columns)).alias("places"))


def _own_places(batch: pa.RecordBatch, i: int, field: str) -> tuple[np.ndarray, pa.StructArray]:
    """Which of the part's places lie in the block, and these places."""
    if not batch["places"][i].is_valid:
        return np.zeros(0, dtype=np.int64), batch["places"].values[:0]
    places = batch["places"][i].values
    mine = np.flatnonzero(places.field(field).to_numpy() >> 44 == batch["seq"][i].as_py())
    return mine, places.take(pa.array(mine))


CONTEXT = "seed long, id long, part int, place long, near int, far int, context binary"


def _contexts(shape: Shape) -> Callable:
    """The words around the anchors: ``far`` ones to the left, nearest first, and as many to the right as windows have there."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mine, places = _own_places(batch, i, "place")
                if not len(mine):
                    continue
                words, _ = word_hashes(batch["texts"][i].values)
                _, first, n, far = _unplaced(places.field("place").to_numpy())
                near, at = far - n + 1, first + far
                around = np.zeros((len(mine), 2 * shape.reach), dtype=np.uint64)
                for k in range(shape.reach):
                    left, right = np.flatnonzero(k < far), np.flatnonzero(k < shape.reach - near)
                    around[left, k] = words[at[left] - 1 - k]
                    around[right, shape.reach + k] = words[at[right] + shape.gram + k]
                yield pa.RecordBatch.from_arrays(
                    [places.field("anchor"), places.field("id"), pa.array(np.full(len(mine), batch["part"][i].as_py()), pa.int32()), places.field("place"),
                     pa.array(near, pa.int32()), pa.array(far, pa.int32()), _binary(around)],
                    ["seed", "id", "part", "place", "near", "far", "context"])
    return step


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * 8
    offsets = np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(-1, width)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many of their first columns two rows agree."""
    return np.cumprod(a == b, axis=1).sum(axis=1)


def _grown(seed: np.ndarray, words: np.ndarray, n: np.ndarray, side: int) -> np.ndarray:
    """The seed with the first ``n`` words of one side."""
    total = _mixed(seed + np.uint64(side)) + n.astype(np.uint64)
    for k in range(words.shape[1]):
        use = k < n
        total[use] = total[use] * np.uint64(0xFF51AFD7ED558CCD) + words[use, k]
    return _mixed(total)


def extended(seed: np.ndarray, near: np.ndarray, far: np.ndarray, own: np.ndarray, pivot: np.ndarray) -> tuple[tuple, list[tuple]]:
    """Compare occurrences with their pivots.

    The windows of an occurrence lie ``near`` to ``far`` words left of the anchor. Gives the windows inside the maximal
    repeat (``near`` above ``far`` for none), and the rest: which occurrences, their longer seeds, and their windows.
    """
    reach = own.shape[1] // 2
    left = np.minimum(_shared(own[:, :reach], pivot[:, :reach]), far)
    right = np.minimum(_shared(own[:, reach:], pivot[:, reach:]), reach - near)
    matched = np.maximum(near, reach - right), np.minimum(far, left)
    rest = []
    which = np.flatnonzero(far > left)
    rest.append((which, _grown(seed[which], own[which, :reach], left[which] + 1, 1), np.maximum(near, left + 1)[which], far[which]))
    last = np.minimum(matched[1], reach - right - 1)
    which = np.flatnonzero(last >= near)
    rest.append((which, _grown(seed[which], own[which, reach:], right[which] + 1, 2), near[which], last[which]))
    return matched, rest


def _extend(shape: Shape) -> Callable:
    """Settled windows (no context) and rows that go on with a longer seed."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, pivot = (_numbers(batch[c], 2 * shape.reach) for c in ("context", "pivot"))
            near, far = (batch[c].to_numpy().astype(np.int64) for c in ("near", "far"))
            seed = batch["seed"].to_numpy().view(np.uint64)
            (lo, hi), rest = extended(seed, near, far, own, pivot)
            found = np.flatnonzero((lo <= hi) & (batch["pivot_id"].to_numpy() < batch["id"].to_numpy()))
            for which, seeds, lo_, hi_, go_on in [(found, seed[found], lo[found], hi[found], False), *((*r, True) for r in rest)]:
                take = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [_long(seeds), *(batch[c].take(take) for c in ("id", "part", "place")), pa.array(lo_, pa.int32()), pa.array(hi_, pa.int32()),
                     batch["context"].take(take) if go_on else pa.nulls(len(which), pa.binary())],
                    ["seed", "id", "part", "place", "near", "far", "context"])
    return step


def _extensions(rows: DataFrame, shape: Shape) -> list[DataFrame]:
    """Windows that pivots settle as repeats (part, place, near, far), one frame for each round."""
    found = []
    while True:
        several = rows.groupBy("seed").agg(F.count(F.lit(1)).alias("times"), F.min_by(F.struct(F.col("id").alias("pivot_id"), F.col("context").alias("pivot")),
                                                                                   F.struct("id", "part", "place")).alias("p")).where("times > 1")
        results = written(rows.join(several.select("seed", "p.*"), "seed").mapInArrow(_extend(shape), CONTEXT), f"round-{len(found)}")
        found.append(results.where("context IS NULL").select("part", "place", "near", "far"))
        rows = results.where("context IS NOT NULL")
        if rows.isEmpty():
            return found


RESULT = "doc_id long, n_words long, spans array<struct<start: long, end: long>>, kept string"


def _without(shape: Shape, frequent: np.ndarray) -> Callable:
    """Words that stay: the block's own repeats are found again, the others come with the block."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                texts = batch["texts"][i].values
                words, counts = word_hashes(texts)
                runs = find_runs(words, counts, shape, frequent)
                own = own_repeats(runs, _ids(batch, i))
                _, places = _own_places(batch, i, "first")
                first, last = (np.concatenate([x, places.field(c).to_numpy() & ((1 << 44) - 1)])
                               for x, c in ((runs.first[own], "first"), ((runs.first + runs.n - 1)[own], "last")))
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, first, 1)
                np.add.at(change, last + shape.window, -1)
                gone = np.cumsum(change[:-1]) > 0
                ends = np.cumsum(counts)
                spans, kept = [], []
                for text, a, b in zip(raw(texts), (ends - counts).tolist(), ends.tolist(), strict=True):
                    mask = gone[a:b]
                    if not mask.any():
                        spans.append([])
                        kept.append(b" ".join(text.split()))
                        continue
                    edges = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()])
                    parts = text.split()
                    kept.append(b" ".join(parts[k] for k in np.flatnonzero(~mask)))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_ids"][i].values, _long(counts), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "spans", "kept"])
    return step


def without_repeats(docs: DataFrame, window: int = 13, gram: int = 5, id_column: str = "doc_id", text: str = "text",
                    keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """One row per document: doc_id, n_words, spans of removed words, and the words kept, joined by one space.

    ``keep`` chooses from these columns before the result is stored.
    """
    if not 0 < gram < window or window - gram > 15:
        raise ValueError("a window holds up to 15 words beside its gram")
    shape, spark = Shape(window, gram), docs.sparkSession
    blocks = Blocks(docs, shape, id_column, text)
    frequent = blocks.frequent()
    seeds = blocks.files.select("part", "seq", "doc_ids", "texts").mapInArrow(_seeds(shape, frequent), "anchor long, whole long, id long, part int, place long")
    with _few_at_once(spark, BLOCKS_AT_ONCE):
        judged = written(_judged(seeds), "judged-runs")
        asked = _per_part(judged.where("NOT repeat"), "anchor", "id", "place")
        contexts = written(blocks.with_places(asked).mapInArrow(_contexts(shape), CONTEXT), "contexts")
    rounds = _extensions(contexts, shape)
    block, at = F.expr("shiftleft(shiftright(place, 44), 44)"), F.expr("shiftright(place, 8) & 68719476735")
    n, lead = F.expr("shiftright(place, 4) & 15"), F.expr("place & 15")
    gone = judged.where("repeat").select("part", (block + at).alias("first"), (block + at + n - 1).alias("last"))
    for found in rounds:
        gone = gone.unionByName(found.select("part", (block + at + lead - F.col("far")).alias("first"), (block + at + lead - F.col("near")).alias("last")))
    with _few_at_once(spark, BLOCKS_AT_ONCE):
        result = written(keep(blocks.with_places(_per_part(gone, "first", "last")).mapInArrow(_without(shape, frequent), RESULT)), "passages-removed")
    blocks.drop()
    return result


def op13_passage_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Removal of repeated passages of 13 words from the whole table, as digests."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return without_repeats(documents(spark, folder), keep=lambda rows: rows.select(
        "doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")))


#: Windows as texts, each with the smallest document that it starts in.
OP13_SQL = """
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM docs)),
firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS i
  FROM windows JOIN firsts USING (w) WHERE doc_id > first),
kept AS (
  SELECT d.doc_id, string_agg(d.word, ' ' ORDER BY d.i) AS kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs) d ANTI JOIN gone USING (doc_id, i)
  GROUP BY d.doc_id)
SELECT docs.doc_id, len(words)::BIGINT AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id)"""
