"""Language-model scores: deleted interpolation of n-gram estimates.

``P(w|h) = l2 * c(h,w)/c(h) + l1 * c(w)/N + l0 / (V+1)``, with weights for each bucket of context frequency (the
power of two below c(h)), learned by expectation-maximisation on deleted counts: each training token is predicted
from the counts without itself.

Words recur, so counts travel by block of documents, not by occurrence. A block sends each of its distinct words
(64-bit hash) and word pairs (``PAIR_BITS`` bits besides the bucket's) with its training count to the bucket of
the hash, as packed numbers; a bucket adds up and answers every block in the order it was asked. A frequent word
is one number per block. The block's tokens wait beside the answers, as numbers of its own word list. Buckets
grow in number with the corpus; a bucket, a block and an EM table of bounded size are all that a task holds.

Words are what white space (ASCII) parts, lower-cased A-Z; every document ends in an end token, and the context of
its first word is a start that is seen once per document. Defined cases: a null or empty text is the end token
alone; a null id counts as empty text for the fold; repeated rows are scored (and learned) each; without training
rows every token is unknown; very long texts are scored whole and may be a block of their own; ties cannot arise; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clientlens.llm.common import arrow_step, content, documents, fold, pieces, raw, written

#: Bytes of text in a block, and in a bucket's share of the corpus.
BLOCK_BYTES, BUCKET_BYTES = 12 << 20, 4 << 20
PAIR_BITS = 32
#: Stand for the end and the start; no word has them, as words hold no white space.
END, START = b" end", b" start"
TOKENS, WORDS, PAIRS = 0, 1, 2
#: Steps of a power of two by which EM tells probabilities apart; a cell of equal steps is used by its mean.
FINE = 8
BUCKETS_OF_CONTEXT = 64


def pack(array: np.ndarray) -> bytes:
    """Compressed, all lowest bytes first: small numbers leave long runs of zeros."""
    planes = array.view(np.uint8).reshape(len(array), -1).T if len(array) else array
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(array) else b""


def unpack(data: bytes, size: int, dtype: str) -> np.ndarray:
    if not size:
        return np.zeros(0, dtype)
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, decompressed_size=size * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, size).T).view(dtype).ravel()


def pack_sorted(array: np.ndarray) -> bytes:
    return pack(np.diff(array, prepend=array.dtype.type(0)))


def unpack_sorted(data: bytes, size: int, dtype: str) -> np.ndarray:
    return np.cumsum(unpack(data, size, dtype), dtype=dtype)


class _Numbers(dict):
    """Numbers words in the order of their first appearance."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pairs_of(tokens: np.ndarray, ends: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context of each token (the word list's length for a start), the number of each token's pair, and the pairs' keys, ascending."""
    start = len(names)
    context = np.empty_like(tokens)
    context[1:] = tokens[:-1]
    context[np.append(0, ends[:-1])] = start
    codes, place = np.unique(context.astype(np.int64) * (start + 1) + tokens, return_inverse=True)
    all_names = np.append(names, np.uint64(xxhash.xxh3_64_intdigest(START)))
    keys = _mixed(all_names[codes // (start + 1)] * np.uint64(0x9E3779B97F4A7C15) + _mixed(all_names[codes % (start + 1)]))
    order = np.argsort(keys, kind="stable")
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    return context, number[place], keys[order]


SENT = "kind int, grp long, block long, size long, keys binary, counts binary, more binary"


def _sent(bits: int, block: int, docs: list, lengths: list, numbers: _Numbers, parts: list) -> Iterator[tuple]:
    """Rows of a finished block: its tokens, and what it asks each bucket."""
    names = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in numbers), dtype=np.uint64, count=len(numbers))
    tokens, ends = np.concatenate(parts), np.cumsum(lengths)
    order = np.argsort(-np.bincount(tokens, minlength=len(names)), kind="stable")  # frequent words get small numbers
    number = np.empty(len(order), dtype=np.uint32)
    number[order] = np.arange(len(order), dtype=np.uint32)
    names, tokens = names[order], number[tokens]
    train = np.repeat(~np.array([held for _, held in docs]), lengths)
    yield TOKENS, block, block, len(tokens), pack(tokens), names.tobytes(), pickle.dumps((docs, lengths))
    by_name = np.argsort(names, kind="stable")
    words = np.bincount(tokens[train], minlength=len(names))[by_name]
    _, pair, keys = pairs_of(tokens, ends, names)
    for kind, keys_, counts in ((WORDS, names[by_name], words), (PAIRS, keys, np.bincount(pair[train], minlength=len(keys)))):
        bucket = (keys_ >> np.uint64(64 - bits)).astype(np.int64)
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << 62))
        short = keys_ if kind == WORDS else ((keys_ << np.uint64(bits)) >> np.uint64(64 - PAIR_BITS)).astype(np.uint32)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield kind, int(bucket[a]), block, b - a, pack_sorted(short[a:b]), pack(counts[a:b].astype(np.uint32)), None


def _blocks(bits: int, block_bytes: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0

        def send(*block) -> pa.RecordBatch:
            columns = zip(*_sent(bits, task << 32 | made, *block), strict=True)
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "grp", "block", "size", "keys", "counts", "more"])

        docs, lengths, numbers, parts, size = [], [], _Numbers(), [], 0
        for batch in pieces(batches, 1 << 20):
            for text, doc_id, held in zip(raw(batch["text"]), batch["doc_id"].to_pylist(), batch["held_out"].to_pylist(), strict=True):
                words = text.lower().split()
                words.append(END)
                parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
                docs.append((doc_id, held))
                lengths.append(len(words))
                size += len(text)
                if size >= block_bytes:
                    yield send(docs, lengths, numbers, parts)
                    made += 1
                    docs, lengths, numbers, parts, size = [], [], _Numbers(), [], 0
        if docs:
            yield send(docs, lengths, numbers, parts)
    return step


ANSWERED = "kind int, bucket long, block long, size long, keys binary, counts binary, more binary"


def _answers(table: pa.Table) -> pa.Table:
    """A bucket's sums for every block that asked; tokens go through.

    ``more`` marks the keys for which the block is the first that asked, so that distinct words can be counted.
    """
    kind = table["kind"][0].as_py()
    schema = pa.schema([("kind", pa.int32()), ("bucket", pa.int64()), ("block", pa.int64()), ("size", pa.int64()),
                        ("keys", pa.binary()), ("counts", pa.binary()), ("more", pa.binary())])
    if kind == TOKENS:
        return table.rename_columns(["kind", "bucket", "block", "size", "keys", "counts", "more"]).cast(schema)
    dtype = "<u8" if kind == WORDS else "<u4"
    sizes = table["size"].to_pylist()
    keys = np.concatenate([unpack_sorted(k, n, dtype) for k, n in zip(table["keys"].to_pylist(), sizes, strict=True)])
    counts = np.concatenate([unpack(c, n, "<u4") for c, n in zip(table["counts"].to_pylist(), sizes, strict=True)])
    _, first, place = np.unique(keys, return_index=True, return_inverse=True)
    sums = np.bincount(place, weights=counts).astype(np.int64)[place]
    owner = np.zeros(len(keys), dtype=np.uint8)
    owner[first] = 1
    ends = np.cumsum(sizes)
    parts = [(a - n, a) for a, n in zip(ends.tolist(), sizes, strict=True)]
    return pa.Table.from_arrays(
        [pa.array([kind] * len(sizes), pa.int32()), table["grp"], table["block"], table["size"], pa.array([b""] * len(sizes), pa.binary()),
         pa.array([pack(sums[a:b].astype("<u8")) for a, b in parts], pa.binary()), pa.array([pack(owner[a:b]) if kind == WORDS else b"" for a, b in parts], pa.binary())], schema=schema)


JOINED = "block long, size long, tokens binary, pair_counts binary, n_words long, word_counts binary, docs binary, train_tokens long, distinct long, cells array<struct<cell:long,weight:long,pair:double,word:double>>"


def _steps(p: np.ndarray) -> np.ndarray:
    """0 for 0, else the negative logarithm in steps, from 1."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.rint(-np.log2(np.where(p > 0, p, 1)) * FINE) + 1, 0).astype(np.int64)


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else one more than the power of two below its count."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))) + 1, 0).astype(np.int64)


def _gathered(table: pa.Table) -> pa.Table:
    """A block's tokens with the corpus counts, and its part of the EM table."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["kind"], r["bucket"]))
    own = rows[0]
    names = np.frombuffer(own["counts"], dtype=np.uint64)
    tokens = unpack(own["keys"], own["size"], "<u4")
    docs, lengths = pickle.loads(own["more"])

    def answers(kind: int) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *[unpack(r["counts"], r["size"], "<u8").astype(np.int64) for r in rows if r["kind"] == kind]])

    by_name = np.argsort(names, kind="stable")
    words, pair_sums = np.empty(len(names), dtype=np.int64), answers(PAIRS)
    words[by_name] = answers(WORDS)
    owned = np.concatenate([np.zeros(0, np.uint8), *[unpack(r["more"], r["size"], "u1") for r in rows if r["kind"] == WORDS]])
    context, pair, _ = pairs_of(tokens, np.cumsum(lengths), names)
    pair_counts = pair_sums[pair]
    end = int(tokens[lengths[0] - 1])
    context_counts = np.append(words, words[end])[context]  # as many starts as ends
    train = np.repeat(~np.array([held for _, held in docs]), lengths)
    # deleted estimates: the token itself is taken out of every count
    c2, ch, c1 = pair_counts[train] - 1, context_counts[train] - 1, words[tokens[train]] - 1
    cell = (context_bucket(ch) << 40) | (_steps(np.where(ch > 0, c2 / np.maximum(ch, 1), 0)) << 20) | _steps(c1 / 2.0 ** 48)
    pair_estimate = np.where(ch > 0, c2 / np.maximum(ch, 1), 0)
    cells, place, weights = np.unique(cell, return_inverse=True, return_counts=True)
    means = [np.bincount(place, weights=x, minlength=len(cells)).tolist() for x in (pair_estimate, c1)]
    return pa.Table.from_pylist([{
        "block": own["block"], "size": own["size"], "tokens": pack(tokens),
        "pair_counts": pack(pair_counts.astype("<u8")), "n_words": len(words), "word_counts": pack(words.astype("<u8")), "docs": own["more"],
        "train_tokens": int(train.sum()), "distinct": int(((owned > 0) & (words[by_name] > 0)).sum()),
        "cells": [{"cell": c, "weight": w, "pair": p, "word": q} for c, w, p, q in zip(cells.tolist(), weights.tolist(), *means, strict=True)]}],
        schema=pa.schema([("block", pa.int64()), ("size", pa.int64()), ("tokens", pa.binary()), ("pair_counts", pa.binary()),
                          ("n_words", pa.int64()), ("word_counts", pa.binary()), ("docs", pa.binary()), ("train_tokens", pa.int64()), ("distinct", pa.int64()),
                          ("cells", pa.list_(pa.struct([("cell", pa.int64()), ("weight", pa.int64()), ("pair", pa.float64()), ("word", pa.float64())])))]))


def expectation_maximisation(bucket: np.ndarray, weights: np.ndarray, pair: np.ndarray, word: np.ndarray, v: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights (pair, word, uniform) by bucket of context frequency, from weighted events with their estimates."""
    parts = np.stack([pair, word, np.full(len(pair), 1 / (v + 1))], axis=1)
    out = np.full((BUCKETS_OF_CONTEXT, 3), 1 / 3)
    out[0] = (0, 0.5, 0.5)
    for b in range(BUCKETS_OF_CONTEXT):
        here = bucket == b
        if not here.any():
            out[b] = out[b - 1] if b else out[b]  # as the bucket below
            continue
        mix = out[b]
        for _ in range(rounds):
            share = parts[here] * mix
            share /= share.sum(axis=1, keepdims=True)
            mix = (share * weights[here, None]).sum(axis=0) / weights[here].sum()
            mix = np.maximum(mix, 1e-9 if b else np.array([0, 1e-9, 1e-9]))
            mix /= mix.sum()
        out[b] = mix
    return out


def _scores(n: int, v: int, mix: np.ndarray):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tokens = unpack(row["tokens"], row["size"], "<u4")
                pair_counts, words = unpack(row["pair_counts"], row["size"], "<u8").astype(float), unpack(row["word_counts"], row["n_words"], "<u8").astype(float)
                docs, lengths = pickle.loads(row["docs"])
                starts = np.cumsum(lengths) - lengths
                count = words[tokens]
                # a start is seen as often as an end
                seen = np.append(words[tokens[-1]], count[:-1])
                seen[starts] = words[tokens[-1]]
                weights = mix[context_bucket(seen)]
                with np.errstate(divide="ignore", invalid="ignore"):
                    p = weights[:, 0] * np.where(seen > 0, pair_counts / np.maximum(seen, 1), 0) + weights[:, 1] * count / max(1, n) + weights[:, 2] / (v + 1)
                total = [np.add.reduceat(x, starts) for x in (np.log10((count + 1) / (n + v + 1)), np.log10(p), (count > 0).astype(np.int64))]
                ids, held = zip(*docs, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(lengths, pa.int64()), pa.array(total[2], pa.int64()),
                     pa.array([n] * len(ids), pa.int64()), pa.array(total[0]), pa.array(total[1])],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return step


def scored(docs: DataFrame, held_out: Column | None = None, id_column: str = "doc_id", text: str = "text",
           block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: rows not to learn from; by default those whose fold of seven is 2.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), content(text).alias("text"), (fold(id_column, 7) == 2 if held_out is None else held_out).alias("held_out"))
    size = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(size // bucket_bytes).bit_length())
    sent = arrow_step(rows, _blocks(bits, block_bytes), SENT)
    answered = sent.groupBy("kind", "grp").applyInArrow(_answers, ANSWERED)
    gathered = written(answered.groupBy("block").applyInArrow(_gathered, JOINED), "lm-blocks")
    n, v = (x or 0 for x in gathered.select(F.sum("train_tokens"), F.sum("distinct")).first())
    cells = (gathered.select(F.inline("cells")).groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("weight", "pair", "word")]).collect())
    cell, weight, pair, word = np.array([tuple(r) for r in cells], dtype=float).reshape(-1, 4).T
    mix = expectation_maximisation(cell.astype(np.int64) >> 40, weight, pair / weight, word / weight / max(1, n - 1), v)
    return gathered.select("size", "tokens", "pair_counts", "n_words", "word_counts", "docs").mapInArrow(
        _scores(n, v, mix), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of the whole table."""
    return scored(documents(spark, folder))
