import collections
import re

import numpy as np
from pyspark.sql import functions as F

from clientlens.llm import quality_rules as qr
from tests.llm.frames import by_id, docs, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    marked = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
            "n_dup_lines": sum(x in lines[:i] for i, x in enumerate(lines)), "n_repeat_words": len(marked),
            "base_failed": len(words) < 20 or 100 * len(marked) > 30 * len(words)}


def check(texts, got):
    for i, text in texts.items():
        want = base(text or "")
        assert {k: got[i][k] for k in want} == want, (i, text[:100])
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_whole_table_agrees_with_brute_force(spark, corpus):
    got = by_id(qr.judged(corpus))
    texts = {r["doc_id"]: r["text"] for r in rows(corpus.select("doc_id", "text"))}
    assert set(got) == set(texts)
    check(texts, got)


def test_verdicts_against_labels(spark, corpus, marks):
    got = by_id(qr.judged(corpus))
    quality = {r["doc_id"]: r["quality"] for r in rows(marks)}
    good = [got[i] for i in quality if quality[i] and not got[i]["base_failed"]]
    assert sum(r["kept"] for r in good) == len(good)
    bad = [got[i] for i in quality if not quality[i]]
    assert sum(not r["kept"] for r in bad) > len(bad) / 3


def test_awkward_texts(spark):
    texts = [None, "", " \n\x0b\x0c\r\t", "a\xa0b c d", "x\n\nx\n x\nx", "é" * 30, " ".join("abcdefgh") + " " + " ".join("abcdefgh"),
             "a " * 40, " ".join(f"w{i}" for i in range(19)), " ".join(f"w{i}" for i in range(20)), "#*$%&|<> " * 9, "w " * 30_000 + "z", "y" * 300_000,
             " ".join(f"w{i % 9}" for i in range(17)), "a\x00b \x1c c"]
    got = by_id(qr.judged(docs(spark, texts)))
    check(dict(enumerate(texts)), got)


def test_distance_by_definition():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([[0.5, 0.5, 0.0], [0.0, 0.0, 1.0], [0.25, 0.25, 0.5]])
    got = qr.distance(p, q)
    assert got[0] == 0 and abs(got[1] - 1) < 1e-12
    m = (p + q[2]) / 2
    want = (0.5 * np.log2(0.5 / m[0]) * 2) / 2 + (0.25 * np.log2(0.25 / m[0]) * 2 + 0.5 * np.log2(0.5 / m[2])) / 2
    assert abs(got[2] - np.sqrt(want)) < 1e-12


def test_symbol_text_is_far_from_its_language_and_short_text_is_guarded(spark):
    clean = ["the cat and the dog ran to a house of the old man with it " * 6 + f"and then number {i} came" for i in range(20)]
    varied = [" ".join(f"{w}{k}" if k % 5 == 0 else w for k, w in enumerate(t.split())) for t in clean]
    junk = " ".join(f"w{i}### &&&{i}%%%" for i in range(60))
    rules = qr.Rules(repeat_percent=1000)
    got = by_id(qr.judged(docs(spark, [*varied, junk, "### &&& " * 11]), rules))
    assert all(got[i]["kept"] for i in range(20)) and not got[20]["kept"] and got[20]["class_distance"] > 0.35
    assert got[21]["class_distance"] == 0 and got[21]["kept"]


def test_text_without_common_words_is_rejected_whatever_its_letters(spark):
    clean = [" ".join(w for k in range(30) for w in (f"house{chr(97 + (i + k) % 26)}{chr(97 + k % 26)}", ("the", "of", "and")[k % 3], f"tree{chr(97 + (i * k) % 26)}")) for i in range(20)]
    uncommon = " ".join(f"gar{chr(97 + k % 26)}den{chr(97 + k // 26)}" for k in range(100))
    few = " ".join(f"the gar{chr(97 + k % 26)}den{chr(97 + k // 26)}" if k % 25 == 0 else f"gar{chr(97 + k % 26)}den{chr(97 + k // 26)}" for k in range(100))
    other = [" ".join(f"ka{chr(97 + (i * k) % 26)}sa{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(100)) for i in range(3)]
    got = by_id(qr.judged(docs(spark, [*clean, uncommon, few, *other], langs=["en"] * 22 + ["xx"] * 3)))
    assert all(got[i]["kept"] for i in range(20))
    for i in (20, 21):
        assert not got[i]["kept"] and not got[i]["base_failed"] and got[i]["class_distance"] < 0.35 and got[i]["word_distance"] < 0.5
    # a language none of whose words are listed has no bound on them
    assert all(got[i]["kept"] for i in (22, 23, 24))


def test_accepted_keeps_rows_whole_and_agrees_with_the_verdicts(spark, corpus):
    table = corpus.withColumns({"kept": F.lit("x"), "n_words": F.lit(None).cast("int")}).unionByName(
        docs(spark, [None, "a"], [None, None], [None, "xx"], [None, None]).withColumns({"kept": F.lit("x"), "n_words": F.lit(1)}))
    out = qr.accepted(table)
    assert out.columns == table.columns
    want = {i for i, r in by_id(qr.judged(table)).items() if r["kept"]}
    assert {r["doc_id"] for r in rows(out)} == want


def test_null_language_takes_the_closest_and_empty_table(spark):
    text = " ".join(f"word{i} the and" for i in range(40))
    got = by_id(qr.judged(docs(spark, [text, text], langs=["en", None])))
    assert got[0]["class_distance"] == got[1]["class_distance"]
    assert rows(qr.judged(docs(spark, []))) == [] and rows(qr.accepted(docs(spark, []))) == []
    assert rows(qr.judged(docs(spark, ["a"], langs=[None])))[0]["kept"] is False


def test_many_languages_are_each_judged_by_their_own(spark):
    draw = np.random.default_rng(3)
    common = [w for words in qr.COMMON for w in words.split()]
    texts, langs = [], []
    for i in range(300):
        # every language has its own mix of classes and of common words
        for _ in range(1 + i % 3):
            words = [*draw.choice(common[i % 40:i % 40 + 30], 60), *["7" * (1 + i % 9)] * (i % 17), *["QZ"] * (i % 11), *draw.choice(["ab", "cd", "ef"], 30)]
            texts.append(" ".join(map(str, draw.permutation(words))))
            langs.append(f"l{i}")
    texts += ["the of and to " * 40, "x y z " * 60]
    langs += [None, None]
    table = docs(spark, texts, langs=langs)
    whole = by_id(qr.judged(table, qr.Rules(sent_languages=1000)))
    for sent in (0, 7, 200):
        got = by_id(qr.judged(table, qr.Rules(sent_languages=sent)))
        assert len(got) == len(texts)
        for i in range(len(texts) - 2):
            assert got[i] == whole[i], (sent, i)
    # a language with one document is at no distance from itself
    assert all(whole[i]["class_distance"] < 1e-7 for i, name in enumerate(langs) if name and langs.count(name) == 1)
    kept = {r["doc_id"] for r in rows(qr.accepted(table, qr.Rules(sent_languages=7)).drop("text"))}
    assert kept == {i for i, r in by_id(qr.judged(table, qr.Rules(sent_languages=7))).items() if r["kept"]}
