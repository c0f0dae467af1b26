"""Removal of repeated passages: prefix doubling over sampled positions.

A byte goes when a string of ``length`` bytes that covers it also starts anywhere else. Ranking every byte
position would move some 16 bytes for each byte of text and round. So positions are sampled by content:
of the ``width`` grams of ``length - width + 1`` bytes that a string of ``length`` bytes holds, the one with
the least hash is its anchor. Equal strings have equal anchors at equal places, neighbouring strings mostly
share one, and a run of neighbouring strings with one anchor stands for all of them.

Rounds then compare growing strings, each by its rank so far paired with a hash of the longer string around
the same anchor, grouped and counted by Spark:

1. the gram, common to all strings of a run; unique: none of them is repeated;
2. the whole run; not unique: all of them are repeated, the threshold is passed;
3. blocks of ``BLOCK`` neighbouring strings of the runs left, first what a block has in common, then the whole;
4. single strings of the blocks left.

A settled run or block goes on, once for each different content, as a witness for those of its rank that are
not settled. Counts are aggregated before they are joined back, and the rows of a passage that many documents hold are
dealt out for that join, so it is never one task's list. A stage is deleted once those that read it are written.

Names are 64-bit hashes; a string counts as repeated only when its gram, the common part and the whole agree,
each by its own hash.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; matches never cross documents;
repeated rows (same id, same text) are different documents that repeat each other; documents without an id are told apart
by their texts; of equally small grams the first is the anchor; very long texts are processed whole, in segments; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from clientlens.llm.common import arrow_step, content, documents, forget, own_id, pieces, raw, written
from clientlens.operators.skew import HEAVY_PART, salted_join

BLOCK = 8
#: String starts sampled at a time; also the most positions that fit beside the hash in one number.
SEGMENT = 1 << 22
PLACE = np.uint64((1 << 26) - 1)
#: Tasks over which the rows of a heavy gram or run are dealt.
SALTS = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes (8 at least) from each position on."""
    n = len(data) - size + 1
    eights = np.empty(len(data) - 7, dtype=np.uint64)
    for k in range(min(8, len(eights))):
        eights[k::8] = np.frombuffer(data[k:k + 8 * len(eights[k::8])].tobytes(), dtype="<u8")
    eights = _mixed(eights)
    total = np.zeros(n, dtype=np.uint64)
    for k in (*range(0, size - 7, 8), size - 8):
        total = total * np.uint64(0xFF51AFD7ED558CCD) + eights[k:k + n]
    return _mixed(total)


def anchors(data: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string start the place of its anchor (the first of equal ones), and the gram hash there."""
    hashes = gram_hashes(data, length - width + 1)
    least = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:len(least) - (width - span)], least[width - span:])
    place = (least & PLACE).astype(np.int64)
    return place, hashes[place]


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values, pa.int64())


def _name(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data)


RUN = "id long, mark int, lo long, n int, at int, gram long"


def _runs(length: int, width: int):
    """lo: first string start; n: strings; at: the anchor's distance from lo; gram and whole: names."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            texts = raw(batch["text"])
            sizes = np.array([len(x) for x in texts], dtype=np.int64)
            data, ends = b"".join(texts), sizes.cumsum()
            for first in range(0, len(data) - length + 1, SEGMENT):
                part = np.frombuffer(data, dtype=np.uint8, offset=first, count=min(SEGMENT + length - 1, len(data) - first))
                place, gram = anchors(part, length, width)
                start = np.arange(first, first + len(place))
                doc = np.searchsorted(ends, start, side="right")
                inside = start + length <= ends[doc]
                breaks = np.flatnonzero((place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])) + 1
                lo, hi = np.append(0, breaks), np.append(breaks, len(place))
                real = inside[lo]
                lo, hi = lo[real], hi[real]
                whole = np.fromiter((_name(data[first + a:first + b + length - 1]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)),
                                    dtype=np.uint64, count=len(lo))
                own = pa.array(doc[lo])
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].take(own), batch["mark"].take(own), _long(start[lo] - (ends - sizes)[doc[lo]]), pa.array(hi - lo, pa.int32()),
                     pa.array(place[lo] - lo, pa.int32()), _long(gram[lo]), _long(whole)], ["id", "mark", "lo", "n", "at", "gram", "whole"])
    return step


def _bodies(length: int):
    """The bytes of the runs that a document is asked for."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            for i, text in enumerate(raw(batch["text"])):
                asked = batch["asked"][i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch["id"][i].as_py()] * len(asked), pa.int64()), pa.array([batch["mark"][i].as_py()] * len(asked), pa.int32()),
                     pa.array([r["lo"] for r in asked], pa.int64()), pa.array([r["n"] for r in asked], pa.int32()), pa.array([r["at"] for r in asked], pa.int32()),
                     pa.array([r["gram"] for r in asked], pa.int64()), pa.array([r["settled"] for r in asked], pa.bool_()),
                     pa.array([text[r["lo"]:r["lo"] + r["n"] + length - 1] for r in asked], pa.binary())],
                    ["id", "mark", "lo", "n", "at", "gram", "settled", "body"])
    return step


def _split(length: int, size: int, chosen: bool):
    """Parts of ``size`` strings, counted back from the anchor, with the names of what they share and of the whole part.

    ``chosen``: only the part of ``BLOCK`` strings that the row names, else all of the run.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(10)]
            columns = {name: batch[name].to_pylist() for name in batch.schema.names}
            for i, body in enumerate(columns["body"]):
                id_, mark, lo, n, at = (columns[k][i] for k in ("id", "mark", "lo", "n", "at"))
                far, near = at, at - n + 1  # distances of the run's first and last string start from the anchor
                if chosen:
                    far, near = min(far, (columns["part"][i] + 1) * BLOCK - 1), max(near, columns["part"][i] * BLOCK)
                for part in range(near // size, far // size + 1):
                    a, b = min(far, (part + 1) * size - 1), max(near, part * size)
                    # bytes from the run's start to the string starts at distance a (first) and b (last)
                    first, last = at - a, at - b
                    shared = body[at - part * size:at - (part + 1) * size + 1 + length]
                    for k, value in enumerate((id_, mark, lo, lo + first, a - b + 1, columns["gram"][i], columns["settled"][i], part,
                                               _name(shared), _name(b"%d:" % a + body[first:last + length]))):
                        out[k].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int32()),
                 pa.array(out[5], pa.int64()), pa.array(out[6], pa.bool_()), pa.array(out[7], pa.int32()),
                 _long(np.array(out[8], dtype=np.uint64)), _long(np.array(out[9], dtype=np.uint64))],
                ["id", "mark", "run", "lo", "n", "gram", "settled", "part", "shared", "whole"])
    return step


PART = "id long, mark int, run long, lo long, n int, gram long, settled boolean, part int, shared long, whole long"


def _heavy(counted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with more than a ``HEAVY_PART``-th of the rows, as their counts say: few, however many rows there are."""
    return written(counted.where(F.col("times") * HEAVY_PART > counted.agg(F.sum("times")).scalar()).select(*keys), "heavy")


def _round(rows: DataFrame, rank: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """One round: rows that are repeated as a whole, and those to look at more closely with their witnesses; both stored.

    ``rows`` share at least their ``rank`` with another row or are dropped here. A settled row is one whose
    repeats are known from an earlier round.
    """
    key = [*rank, "whole"]
    classes = written(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("times"), F.bool_or(~F.col("settled")).alias("open")), f"{name}-classes")
    ranks = classes.groupBy(*rank).agg(
        F.sum("times").alias("sharers"), F.bool_or(F.col("open") & (F.col("times") == 1)).alias("unsettled"))
    judged = written(classes.join(ranks, rank).where("sharers > 1 AND (times > 1 OR unsettled)"), f"{name}-judged")
    forget(classes)
    with_rows = written(salted_join(rows, judged.drop("open"), key, _heavy(judged, key), SALTS), f"{name}-rows")
    forget(judged)
    left = with_rows.where("unsettled")
    alone = left.where("times = 1")
    several = left.where("times > 1")
    fields = [F.col(c) for c in rows.columns if c not in key]
    witness = several.groupBy(*key).agg(F.min(F.struct(*fields)).alias("r")).select(*[F.col(k) for k in key], "r.*")
    rest = written(alone.select(rows.columns).unionByName(witness.withColumn("settled", F.lit(True)).select(rows.columns)), f"{name}-rest")
    repeated = written(with_rows.where("times > 1 AND NOT settled").select("id", "mark", "lo", "n"), f"{name}-repeated")
    forget(with_rows)
    return repeated, rest


def _to_texts(texts: DataFrame, changes: DataFrame, how: str) -> DataFrame:
    """Join by document. Only a table below Spark's own threshold travels; otherwise both sides are shuffled, at any size alike."""
    return texts.join(changes, ["id", "mark"], how)


def repeated_spans(docs: DataFrame, length: int = 200, width: int = 128, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document that loses bytes: id, mark (a hash of the text), and the merged spans to remove."""
    if length - width + 1 < 8:
        raise ValueError("grams of eight bytes at least: length - width >= 7")
    texts = _texts(docs, id_column, text)
    runs = arrow_step(texts.select("id", "mark", "text"), _runs(length, width), f"{RUN}, whole long")
    common = written(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "grams")
    shared = written(salted_join(runs, common.select("gram"), ["gram"], _heavy(common, ["gram"]), SALTS).withColumn("settled", F.lit(False)), "runs")
    forget(common)
    found, rest = _round(shared, ["gram"], "whole-runs")
    forget(shared)
    asked = written(rest.groupBy("id", "mark").agg(F.collect_list(F.struct("lo", "n", "at", "gram", "settled")).alias("asked")), "asked")
    forget(rest)
    bodies = written(arrow_step(_to_texts(texts, asked, "inner").select("id", "mark", "text", "asked"), _bodies(length),
                                f"{RUN}, settled boolean, body binary"), "bodies")
    forget(asked)
    blocks = written(bodies.mapInArrow(_split(length, BLOCK, False), PART), "blocks")
    found_blocks, rest_blocks = _round(blocks, ["gram", "part", "shared"], "blocks")
    forget(blocks)
    wanted = rest_blocks.select("id", "mark", F.col("run").alias("lo"), "part", F.col("settled").alias("settled_part"))
    single = bodies.drop("settled").join(wanted, ["id", "mark", "lo"]).withColumnRenamed("settled_part", "settled")
    strings = written(single.mapInArrow(_split(length, 1, True), PART), "strings")
    forget(bodies, rest_blocks)
    found_strings = (strings.join(strings.groupBy("gram", "part", "whole").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), ["gram", "part", "whole"])
                     .where("NOT settled").select("id", "mark", "lo", "n"))
    covered = found.unionByName(found_blocks).unionByName(found_strings).select(
        "id", "mark", F.struct("lo", (F.col("lo") + F.col("n") + length - 1).alias("hi")).alias("span"))
    spans = written(_merged(covered), "spans")
    forget(found, found_blocks, strings)
    return spans


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Id and a hash of the text name a document; rows with both equal share their spans."""
    own = docs.select(F.col(id_column).alias("doc_id"), content(text).alias("text"))
    return own.withColumns({"id": own_id("doc_id", "text"), "mark": F.hash("text")})


def _merged(covered: DataFrame) -> DataFrame:
    """Maximal spans of each document, as two lists."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends = [], []
            for i in range(batch.num_rows):
                spans = batch["spans"][i].values.flatten()
                lo, hi = spans[0].to_numpy(), spans[1].to_numpy()
                order = np.argsort(lo, kind="stable")
                lo, reach = lo[order], np.maximum.accumulate(hi[order])
                new = np.flatnonzero(lo[1:] > reach[:-1]) + 1
                starts.append(lo[np.append(0, new)])
                ends.append(reach[np.append(new - 1, len(lo) - 1)])
            yield pa.RecordBatch.from_arrays([batch["id"], batch["mark"], pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64()))],
                                             ["id", "mark", "starts", "ends"])

    return covered.groupBy("id", "mark").agg(F.collect_set("span").alias("spans")).mapInArrow(step, "id long, mark int, starts array<long>, ends array<long>")


def _kept(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Remaining bytes of each text, with the removed spans."""
    for text, starts, ends in zip(raw(batch["text"]), batch["starts"].to_pylist(), batch["ends"].to_pylist(), strict=True):
        starts, ends = starts or [], ends or []
        yield b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True)), starts, ends


def removal_digests(docs: DataFrame, length: int = 200, width: int = 128, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [(len(rest), sum(b - a for a, b in zip(starts, ends, strict=True)), len(starts), sha256(rest).hexdigest()) for rest, starts, ends in _kept(batch)]
            rest, gone, spans, digest = (list(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([r + g for r, g in zip(rest, gone, strict=True)], pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = repeated_spans(docs, length, width, id_column, text)
    joined = _to_texts(_texts(docs, id_column, text), spans, "left").select("doc_id", "text", "starts", "ends")
    return arrow_step(joined, step, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 200, width: int = 128, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids and remaining bytes of all documents; a cut may fall inside a character, so the bytes stay binary."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x[0] for x in _kept(batch)], pa.binary())], ["doc_id", "kept"])

    spans = repeated_spans(docs, length, width, id_column, text)
    joined = _to_texts(_texts(docs, id_column, text), spans, "left").select("doc_id", "text", "starts", "ends")
    return arrow_step(joined, step, "doc_id long, kept binary")


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Removal of repeated strings of 200 bytes over the whole table."""
    return removal_digests(documents(spark, folder))
