import hashlib
import re

from pyspark.sql import functions as F

from clientlens.llm import secret_scan as ss
from tests.llm.frames import by_id, docs, rows

HEX = "0123456789abcdef01234567"
LIVE = "Zx9Qw8Er7Ty6Ui5Op4As3Df2Gh1Jk0LmNb"


def spans(text):
    """Base spans by Python's patterns: (start, order, kind, end)."""
    found = []
    for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m.group(2)) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(found)


def check(table, got):
    texts = {r["doc_id"]: r["text"] or "" for r in rows(table.select("doc_id", "text"))}
    assert set(texts) == set(got)
    for i, text in texts.items():
        want = spans(text)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in want)
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (i, text[:200], joined, got[i])
        assert [got[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(w[2] == k for w in want) for k in ("assign", "access", "hex")]
        assert set(joined.split(",")) <= set(got[i]["listed"].split(",")) or not joined


def test_whole_table_agrees_with_brute_force(spark, corpus):
    check(corpus, by_id(ss.scan(corpus)))


def test_awkward_texts(spark):
    table = docs(spark, [
        None, "", "token=abc", "TOKEN = 'abcdef'", "Api_Key: \"abc.def=\" apikey:abcdef", "secret=token:abcdefgh", "password:passwd:secret1",
        "é😀 token=😀 token=abcdef é " + HEX, "AKIA" + "A1" * 8 + "AKIA", "AKIAAKIA" + "B" * 11, HEX + "g" + HEX * 3, "x" + HEX,
        "toKen\n=abcdef token  =  abcdef", "token=" + HEX + " AKIA" + "Z" * 16, "token=abcdef " * 500, "ſecret=abcdef toKen=abcdef",
        "a" * 200_000, "key = 5 " + "word " * 40_000 + "secret: hunter2x"])
    got = by_id(ss.scan(table))
    check(table, got)
    assert got[14]["n_assign"] == 500


def test_ownership_separates_live_values_from_copied_examples(spark):
    copied = LIVE[::-1]
    table = docs(spark, [f"see {LIVE} here", f"{LIVE}", f"{copied} a", f"b {copied}", "lower" * 10], sources=["a", "a", "a", "b", "c"])
    got = by_id(ss.scan(table))
    assert [got[i]["listed"] for i in range(5)] == ["opaque:4:38", "opaque:0:34", "", "", ""]
    assert [got[i]["n_live"] for i in range(5)] == [1, 1, 0, 0, 0]
    both = by_id(ss.scan(table, live_owners=2))
    assert both[2]["listed"] == "opaque:0:34"


def test_ownership_counts_distinct_repositories_and_owners(spark):
    rows_ = [(1, "a", "s"), (1, "a", "s"), (2, "a", "s"), (3, "b", "s"), (4, "b", "t")]
    got = {r["secret"]: r for r in rows(ss.ownership(spark.createDataFrame(rows_, "row long, owner string, secret string")))}
    assert (got["s"]["repositories"], got["s"]["owners"], got["t"]["owners"]) == (3, 2, 1)


def test_a_value_copied_all_over_one_source_is_an_example(spark):
    copied, moved = LIVE[::-1], LIVE[5:] + LIVE[:5]
    texts = [f"page {i} shows {copied}" for i in range(40)] + [f"whole copy {LIVE}"] * 40 + [f"{moved} {i}" for i in range(16)]
    table = docs(spark, texts, sources=["a"] * 40 + ["b"] * 40 + [None] * 16)
    got = by_id(ss.scan(table))
    assert {got[i]["listed"] for i in range(40)} == {""}
    # copies of one whole text are one repository
    assert {got[i]["listed"] for i in range(40, 80)} == {"opaque:11:45"} and all(got[i]["n_live"] == 1 for i in range(40, 96))
    assert {got[i]["listed"] for i in range(80, 96)} == {"opaque:0:34"}
    assert {r["listed"] for r in rows(ss.scan(table, live_repositories=15)) if r["doc_id"] >= 80} == {""}
    out = by_id(ss.redacted(table))
    assert out[3]["text"] == texts[3] and out[41]["text"] == "whole copy [secret]"


def test_redaction_takes_every_span_and_leaves_the_rest(spark):
    table = docs(spark, [f"é token = \"{HEX}\" end", "clean text", None, f"{HEX} {HEX}", f"{HEX} {HEX}"], [0, 1, None, 3, 3]).withColumns(
        {"row": F.lit(1), "spans": F.lit("s"), "owner": F.lit("o")})
    out = ss.redacted(table)
    assert out.columns == table.columns
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"], r["n_chars"]) for r in rows(out) if r["text"] is not None)
    assert got == [(0, "é [secret]\" end", 15), (1, "clean text", 10), (3, "[secret] [secret]", 17), (3, "[secret] [secret]", 17)]
    assert sum(r["text"] is None for r in rows(out)) == 1


def test_null_owner_and_empty_table(spark):
    table = docs(spark, [LIVE, LIVE], sources=[None, None])
    assert [r["listed"] for r in rows(ss.scan(table))] == ["opaque:0:34"] * 2
    assert rows(ss.scan(docs(spark, []))) == [] and rows(ss.redacted(docs(spark, []))) == []
