import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clientlens.llm import bpe
from clientlens.llm.common import arrow_step
from tests.llm.frames import by_id, docs, rows

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def check(library, texts, got):
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == digest(" ".join(map(str, ids)))
        assert got[i]["decoded_sha256"] == digest(library.decode(ids, skip_special_tokens=False))


def test_whole_table_agrees_with_the_library(spark, corpus, library):
    got = by_id(bpe.token_digests(corpus, PATH))
    texts = {r["doc_id"]: r["text"] for r in rows(corpus.select("doc_id", "text"))}
    assert set(got) == set(texts)
    check(library, texts, got)


def test_awkward_texts(spark, library):
    texts = [None, "", " \n\t", "a", "<|endoftext|>", "x<|startoftext|>Y<|ENDOFTEXT|>", "<|", "it's We'LL 'S", "é é ﬁ İ Σς ſ", "\x1c\x85​　x",
             "१२ Ⅷ ² 中文字", "</w> a</w>", "😀!!—", "\x00", "a" * 50_000, "ab " * 30_000, "!" * 5000]
    got = by_id(bpe.token_digests(docs(spark, texts), PATH))
    check(library, dict(enumerate(texts)), got)


def test_random_words_agree_with_the_library(library):
    own, draw = bpe.TrieEncoder(PATH), random.Random(5)
    words = {"".join(draw.choice("abcehinorst") for _ in range(draw.randint(1, 14))).encode() for _ in range(3000)}
    for word, ids in own.encode_words(words):
        assert list(ids) == library.encode(word.decode(), add_special_tokens=False).ids, word


def test_words_and_chunks_share_what_is_known(library):
    """Each text alone, after texts whose chunks and words look alike in another form."""
    table = bpe.Chunks(PATH)
    parts = ["word", "word,", "e\u0301", "é", "É", "İ", "i̇", "ΣΑΣ", "σας", "'s", "it's", "!'s", "12", "1", "ﬁ", "Å", "Å", "ẞ", "ß", "ǰ", "ᾳ", "ΐ", "<|", "<|endoftext|>"]
    for text in (*parts, *(f"{a} {b}" for a in parts for b in parts), *reversed(parts)):
        (got,) = table.texts(pa.array([text]))
        assert list(bpe.array("H", got)) == library.encode(text, add_special_tokens=False).ids, text


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "TEXTS_KEPT", 3)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 1)
    table = bpe.Chunks(PATH)
    for text in ("the cat sat on the mat", "the dog", "a b c d e f <|endoftext|>"):
        (got,) = table.texts(pa.array([text]))
        assert list(bpe.array("H", got)) == library.encode(text, add_special_tokens=False).ids


def test_encoded_and_repeated_rows_and_clashing_columns(spark, library):
    table = docs(spark, ["The cat", "The cat", None], [1, 1, None]).withColumns({"ids": F.lit(3), "n_tokens": F.lit("x")})
    got = rows(bpe.encoded(table, PATH))
    ids = library.encode("The cat", add_special_tokens=False).ids
    assert sorted((r["ids"], r["decoded"]) for r in got) == [([], ""), (ids, "the</w> cat</w>"), (ids, "the</w> cat</w>")]
    assert bpe.token_digests(docs(spark, []), PATH).count() == 0


def test_recurring_words_stay_when_the_cache_is_full(library, monkeypatch):
    """Each text fills a half of the cache; what all of them hold is encoded once."""
    monkeypatch.setattr(bpe, "TEXTS_KEPT", 60)
    monkeypatch.setattr(bpe, "_ENCODERS", {})
    table, seen = bpe.Chunks(PATH), []
    encode = table.encoder.encode_words
    monkeypatch.setattr(table.encoder, "encode_words", lambda words: (seen.extend(words), encode(words))[1])
    for k in range(20):
        text = "frequent " + " ".join("abcdefghij"[k % 10] + "abcdefghij"[n] * (2 + k // 10) for n in range(10))
        (got,) = table.texts(pa.array([text]))
        assert list(bpe.array("H", got)) == library.encode(text, add_special_tokens=False).ids
        assert len(table.encoder.known) + len(table.encoder.older) <= 60 + 2 * len(table.encoder.special)
    assert seen.count(b"frequent") == 1
    assert len(seen) == 201


def test_a_worker_forgets_the_words_of_an_operator_before(spark):
    """Workers are used again: the next operator does not find the encoder in its memory."""
    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._ENCODERS)] * batch.num_rows, pa.int64())], ["held"])

    table = docs(spark, ["The cat"] * 16).repartition(8)
    assert bpe.token_digests(table, PATH).count() == 16
    assert {r["held"] for r in rows(arrow_step(table.select("text"), held, "held long"))} == {0}
