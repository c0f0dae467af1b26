"""BPE encoding and decoding by depth-first traversal of a prefix-sharing trie of words.

The encoding of a prefix is determined by its last token: the rest is the encoding of a shorter prefix.
So a word's distinct prefixes are nodes of a trie, each node keeps one state (its last token), and the
traversal of all distinct words of a block computes the states of shared prefixes once. A token can be
the last one when it ends the prefix and merges never cross the border to the token before it.

Words recur, so a worker keeps what it has encoded: whitespace-free chunks and their words, in two halves of bounded
size. When the newer half is full it becomes the older one, and what recurs moves over, so frequent words stay. Everything else a task holds is one block of texts and the current path.

Defined cases: a null text is empty and has no tokens; repeated rows are encoded each; special tokens
in a text are special tokens; truncation and padding do not happen; very long texts and words are encoded whole; of merges
with one rank the one further left comes first; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from clientlens.llm.common import REMEMBERED, arrow_step, content, documents, pieces, raw

END = "</w>"
#: Fixed value: how the vocabulary splits a text into words.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
ASCII_WORDS = re.compile((CONTRACTIONS + r"|[a-z]+|[0-9]|[^a-z0-9]+").encode())
WORDS = regex.compile(CONTRACTIONS + r"|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+")
#: Chunks and words remembered by a worker, and pairs of tokens.
TEXTS_KEPT, PAIRS_KEPT = 2_600_000, 500_000
#: Lengths that a token can have whatever its end.
SHORT = (2, 1)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable bytes are themselves, the others follow at 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TrieEncoder:
    """Encoder of a vocabulary file with word ends, byte letters and lower case."""

    def __init__(self, path: str):
        self.texts_kept = TEXTS_KEPT
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["end_of_word_suffix"] != END or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("not a vocabulary with word ends")
        if len(model["vocab"]) > 1 << 16:
            raise ValueError("ids are kept in two bytes")
        self.text: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.text |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"].encode(): array("H", [t["id"]]).tobytes() for t in spec["added_tokens"]}
        self.inside: dict[bytes, int] = {}
        self.last: dict[bytes, int] = {}
        for token, i in model["vocab"].items():
            ends = token.endswith(END) and len(token) > len(END)
            key = bytes(letters[c] for c in (token.removesuffix(END) if ends else token))
            (self.last if ends else self.inside)[key] = i
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = model["vocab"][left], model["vocab"][right], model["vocab"][left + right]
            self.merge[a, b] = (rank, whole)
            if whole in self.parts:
                raise ValueError("two merges make one token")
            self.parts[whole] = (rank, a, b)
        self.split_special = re.compile(b"(" + b"|".join(re.escape(s) for s in self.special) + b")")
        self.edges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.sound: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.known: dict[bytes, bytes] = dict(self.special)
        self.older: dict[bytes, bytes] = {}
        # a token that its own text does not encode to can never be a last token
        for tokens in (self.inside, self.last):
            for key in [k for k, i in tokens.items() if not self._reachable(i)]:
                del tokens[key]
        # by the last three bytes, which lengths a token with a word end can have
        lengths: dict[bytes, set[int]] = {}
        for key in self.last:
            if len(key) > 2:
                lengths.setdefault(key[-3:], set(SHORT)).add(len(key))
        self.lengths = {end: tuple(sorted(found, reverse=True)) for end, found in lengths.items()}
        self._suffixes()

    def _suffixes(self) -> None:
        """A trie of the tokens inside words, with the node of each node's longest proper suffix.

        ``longest``: by node, the longest token that ends there; ``shorter``: by token, the next shorter one.
        """
        self.step: dict[int, int] = {}
        token, parent, byte = [None], [0], [0]
        for key, i in sorted(self.inside.items(), key=lambda x: (len(x[0]), x[0])):
            node = 0
            for b in key:
                child = self.step.get(node << 8 | b)
                if child is None:
                    child = self.step[node << 8 | b] = len(token)
                    token.append(None)
                    parent.append(node)
                    byte.append(b)
                node = child
            token[node] = i
        depth = [0] * len(token)
        for node in range(1, len(token)):
            depth[node] = depth[parent[node]] + 1
        self.back = [0] * len(token)
        self.longest = [None] * len(token)
        self.shorter: dict[int, int] = {}
        self.length = {i: len(k) for k, i in self.inside.items()}
        for node in sorted(range(1, len(token)), key=depth.__getitem__):
            if parent[node]:
                up = self.back[parent[node]]
                while up and up << 8 | byte[node] not in self.step:
                    up = self.back[up]
                self.back[node] = self.step.get(up << 8 | byte[node], 0)
            self.longest[node] = self.longest[self.back[node]]
            if token[node] is not None:
                self.shorter[token[node]] = self.longest[node]
                self.longest[node] = token[node]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Symbols at the token's right (2) or left (1) edge from the first letter on, each with the rank at which it goes."""
        key = (token, side)
        if key not in self.edges:
            chain, until = [], 1 << 30
            while token is not None:
                chain.append((token, until))
                rank, *sides = self.parts.get(token, (None, None, None))
                token, until = (sides[side - 1], rank) if rank is not None else (None, 0)
            self.edges[key] = chain[::-1]
        return self.edges[key]

    def _apart(self, a: int, b: int, until: int = 1 << 30) -> bool:
        """Whether no merge with a rank below ``until`` crosses the border between two tokens.

        Of equal ranks the one further left comes first: a merge inside ``a`` beats one across, which beats one inside ``b``.
        """
        left, right, i, j = self._edge(a, 2), self._edge(b, 1), 0, 0
        while True:
            (x, gone), (y, goes) = left[i], right[j]
            found = self.merge.get((x, y))
            if found and found[0] < min(gone, until) and found[0] <= goes:
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if j + 1 == len(right) or (i + 1 < len(left) and gone <= goes):
                i += 1
            else:
                j += 1

    def _reachable(self, token: int) -> bool:
        """Whether the token's own text encodes to it."""
        if token not in self.sound:
            if token in self.parts:
                rank, a, b = self.parts[token]
                self.sound[token] = self._reachable(a) and self._reachable(b) and self._apart(a, b, rank)
            else:
                self.sound[token] = True
        return self.sound[token]

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        """Ids of distinct words. In sorted order the words are the trie's depth-first traversal: a word shares
        the states of the path that it has in common with the word before. A state is a prefix's last token
        and where that token starts, tried from the longest token that ends there; every single byte is a token.
        The word's own end looks among the tokens with a word end."""
        last, lengths, fits, apart = self.last.get, self.lengths, self.fits, self._apart
        step, back, longest, shorter, width = self.step.get, self.back, self.longest, self.shorter, self.length
        states: list[int] = []
        starts: list[int] = []
        nodes: list[int] = []
        before = b""
        for word in sorted(words):
            size = len(word)
            common, top = 0, min(len(states), size - 1)
            while common < top and before[common] == word[common]:
                common += 1
            del states[common:], starts[common:], nodes[common:]
            node = nodes[-1] if nodes else 0
            for end in range(common + 1, size):
                byte = word[end - 1]
                child = step(node << 8 | byte)
                while child is None:
                    node = back[node]
                    child = step(node << 8 | byte)
                node = child
                token = longest[node]
                start = end - width[token]
                while start:
                    pair = states[start - 1] << 16 | token
                    fit = fits.get(pair)
                    if fit is None:
                        fit = fits[pair] = apart(pair >> 16, token)
                    if fit:
                        break
                    token = shorter[token]
                    start = end - width[token]
                nodes.append(node)
                states.append(token)
                starts.append(start)
            for length in lengths.get(word[-3:], SHORT) if size > 2 else SHORT:
                start = size - length
                if start < 0:
                    continue
                token = last(word[start:])
                if token is not None:
                    if not start:
                        break
                    pair = states[start - 1] << 16 | token
                    fit = fits.get(pair)
                    if fit is None:
                        fit = fits[pair] = apart(pair >> 16, token)
                    if fit:
                        break
            else:
                raise ValueError(f"no encoding of {word[:100]!r}")
            states.append(token)
            starts.append(start)
            ids = [states.pop()]
            start = starts.pop()
            while start:
                ids.append(states[start - 1])
                start = starts[start - 1]
            yield word, tuple(ids[::-1])
            before = word
        if len(fits) > PAIRS_KEPT:
            fits.clear()

    @staticmethod
    def split(chunk: bytes) -> list[bytes]:
        """Words of a chunk without ASCII white space, normalised."""
        if chunk.isascii():
            lowered = chunk.lower()
            # letters alone, or letters with one other character behind them, are split by that rule as well
            if lowered.isalpha():
                return [lowered]
            if lowered[:-1].isalpha() and not lowered[-1:].isalpha():
                return [lowered[:-1], lowered[-1:]]
            return ASCII_WORDS.findall(lowered)
        text = unicodedata.normalize("NFC", chunk.decode())
        # letter by letter: a final sigma is an ordinary one
        return [w.encode() for w in WORDS.findall("".join(c.lower() for c in text) if "Σ" in text else text.lower())]

    def encode_chunks(self, chunks: Iterable[bytes]) -> dict[bytes, bytes]:
        """Ids of distinct chunks, two bytes each; they and their words are remembered in ``known``.

        A word in ASCII letters is a chunk of its own, so both share an entry; other words stand behind a blank.
        """
        own = self.split
        split = {chunk: [*self._with_special(chunk)] if b"<|" in chunk else own(chunk) for chunk in chunks}
        words = list(set().union(*split.values()))
        if len(self.known) + len(words) + len(split) > self.texts_kept // 2:
            self.older, self.known = self.known, dict(self.special)
        known = self.known
        remembered = self.recall([w if w.isascii() else b" " + w for w in words])
        for word, ids in self.encode_words([w for w, ids in zip(words, remembered, strict=True) if ids is None]):
            known[word if word.isascii() else b" " + word] = array("H", ids).tobytes()

        def found(word: bytes) -> bytes:
            return known[word if word.isascii() else b" " + word]

        ids = {chunk: found(words[0]) if len(words) == 1 else b"".join(map(found, words)) for chunk, words in split.items()}
        known.update(ids)
        return ids

    def recall(self, keys: list[bytes]) -> list[bytes | None]:
        """What is remembered of each text; what only the older half knew moves to the newer one."""
        known, older = self.known, self.older
        found = list(map(known.get, keys))
        if older:
            for i, ids in enumerate(found):
                if ids is None:
                    again = older.get(keys[i])
                    if again is not None:
                        known[keys[i]] = found[i] = again
        return found

    def _with_special(self, chunk: bytes) -> Iterator[bytes]:
        """Words and special tokens; a word never looks like a special token, whose brackets are no letters."""
        for k, piece in enumerate(self.split_special.split(chunk)):
            yield from [piece] if k % 2 else self.split(piece)

    def decode(self, ids: Iterable[int]) -> str:
        """The file names no decoder, so tokens are joined by a space."""
        return " ".join(self.text[i] for i in ids)


def chunks_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """White-space-free pieces of all texts, and how many each has; in lower case unless that could make a special token."""
    lowered = pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts))
    split = pc.ascii_split_whitespace(lowered.cast(pa.large_string()))
    pieces_ = split.flatten()
    real = pc.greater(pc.binary_length(pieces_), 0)
    counts = np.diff(np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[np.asarray(split.offsets) - split.offsets[0].as_py()])
    return pieces_.filter(real).dictionary_encode(), counts


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One encoder per Python worker, as it keeps words from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(path)
    return _ENCODERS[path]


class Chunks:
    """Two-byte ids of texts, from those of their chunks."""

    def __init__(self, path: str, texts_kept: int | None = None):
        self.encoder = encoder(path)
        self.encoder.texts_kept = TEXTS_KEPT if texts_kept is None else texts_kept

    def texts(self, texts: pa.Array) -> list[bytes]:
        """Two-byte ids of each text of a block: those of its distinct chunks, put one after the other."""
        chunks, counts = chunks_of(texts)
        distinct = raw(chunks.dictionary)
        found = self.encoder.recall(distinct)
        new = [c for c, ids in zip(distinct, found, strict=True) if ids is None]
        if new:
            encoded_ = self.encoder.encode_chunks(new)
            found = [encoded_[c] if ids is None else ids for c, ids in zip(distinct, found, strict=True)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 2
        ids, starts = np.frombuffer(b"".join(found), dtype=np.uint16), np.cumsum(sizes) - sizes
        codes = chunks.indices.to_numpy(zero_copy_only=False)
        n = sizes[codes]
        ends = np.cumsum(n)
        flat = ids[np.repeat(starts[codes] - ends + n, n) + np.arange(n.sum())].tobytes()
        bounds = (2 * np.append(0, ends)[np.append(0, np.cumsum(counts))]).tolist()
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


#: Bytes of text encoded at a time.
BLOCK = 4 << 20
_KEPT: dict[tuple[str, int | None], Chunks] = {}


def kept(path: str, texts_kept: int | None = None) -> Chunks:
    if (path, texts_kept) not in _KEPT:
        _KEPT[path, texts_kept] = Chunks(path, texts_kept)
    return _KEPT[path, texts_kept]


def _drop() -> None:
    _KEPT.clear()
    _ENCODERS.clear()


REMEMBERED["tokens"] = _drop


def _digests(path: str):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, text = kept(path), encoder(path).text
        decimal = {i: str(i).encode() for i in text}
        token = {i: t.encode() for i, t in text.items()}
        for batch in pieces(batches, BLOCK):
            n, ids, decoded = [], [], []
            for packed in table.texts(batch["text"]):
                own = array("H", packed)
                n.append(len(own))
                ids.append(sha256(b" ".join(map(decimal.__getitem__, own))).hexdigest())
                decoded.append(sha256(b" ".join(map(token.__getitem__, own))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return step


def token_digests(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: number of tokens, digest of the decimal ids, digest of the decoded text."""
    return arrow_step(docs.select(docs[id_column].alias("doc_id"), content(text).alias("text")), _digests(vocabulary),
                      "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", "tokens")


def encoded(docs: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its ids and the text that they decode to."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = kept(vocabulary), encoder(vocabulary)
        for batch in pieces(batches, BLOCK):
            ids = [array("H", x) for x in table.texts(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array([own.decode(i) for i in ids], pa.string())],
                                             ["doc_id", "ids", "decoded"])
    return arrow_step(docs.select(docs[id_column].alias("doc_id"), content(text).alias("text")), step, "doc_id long, ids array<int>, decoded string", "tokens")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token digests of the whole table."""
    return token_digests(documents(spark, folder), vocabulary_path())
