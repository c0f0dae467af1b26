import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from clientlens.llm import merkle_manifest as mm
from tests.llm.frames import docs, rows, stored


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)])


def tree(leaves):
    """Root and, for each leaf, its levels of (siblings before, siblings after)."""
    proofs = [[] for _ in leaves]
    level, under = list(leaves), [[i] for i in range(len(leaves))]
    while len(level) > 1:
        parents, below = [], []
        for a in range(0, len(level), 16):
            family = level[a:a + 16]
            for k in range(len(family)):
                for leaf in under[a + k]:
                    proofs[leaf].append(("".join(family[:k]), "".join(family[k + 1:])))
            parents.append(h(*family))
            below.append([x for u in under[a:a + 16] for x in u])
        level, under = parents, below
    return level[0], proofs


def brute(table):
    """Result rows, sorted; ties of repeated rows are interchangeable."""
    by_source = {}
    for r in table:
        by_source.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    found = [tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in sources]
    root, above = tree([f[0] for f in found])
    out = []
    for s, (subroot, proofs), more in zip(sources, found, above):
        for (_, _, leaf, r), own in zip(sorted(by_source[s], key=lambda x: x[:3]), proofs):
            steps, start = own + more, leaf
            if zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0:
                text = r["text"] if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
                start = leaf_of(r, text)
            for before, after in steps:
                start = h(before, start, after)
            out.append((r["doc_id"], leaf, subroot, root, h(*[x for step in steps for x in step]), start, start == root))
    return sorted(out, key=str)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def result(spark, folder):
    return sorted((tuple(r[c] for c in COLUMNS) for r in rows(mm.op12_merkle_manifest(spark, folder))), key=str)


def test_whole_table_agrees_with_brute_force(spark, data, corpus):
    got = result(spark, data)
    assert got == brute(rows(corpus))
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [16], [17], [1, 1], [1] * 17, [300, 1, 16, 257], [2] * 40])
def test_shapes(spark, tmp_path, sizes):
    sources = [f"s{i}" for i, n in enumerate(sizes) for _ in range(n)]
    texts = [f"Text {i} É" for i in range(len(sources))]
    folder = stored(spark, tmp_path, docs(spark, texts, sources=sources).repartition(5))
    assert result(spark, folder) == brute(rows(spark.read.parquet(f"{folder}/documents.parquet")))


def test_nulls_ties_long_texts_and_repeated_rows(spark, tmp_path):
    texts = [None, "", "A", "a", "A", "A", "Long Ä " * 100_000, None] + ["x"] * 30
    ids = [None, None, 3, 3, 3, 3, -5, 10] + [7] * 30
    sources = [None, "b", "b", "b", "b", "b", "", "é"] + ["b"] * 30
    langs = [None, "en"] * 19
    folder = stored(spark, tmp_path, docs(spark, texts, ids, langs, sources))
    got = result(spark, folder)
    assert got == brute(rows(spark.read.parquet(f"{folder}/documents.parquet")))


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert result(spark, stored(spark, tmp_path / "none", docs(spark, []))) == []
    table = docs(spark, [f"T{i}" for i in range(40)]).withColumns({c: F.lit(9) for c in ("row", "leaf", "at", "of", "part", "idx", "tree", "slot", "tampered", "steps")})
    folder = stored(spark, tmp_path / "more", table)
    assert result(spark, folder) == brute(rows(spark.read.parquet(f"{folder}/documents.parquet")))


def test_proofs_verify_rows_one_by_one(spark):
    table = docs(spark, [f"Row {i}" for i in range(700)], sources=["hot" if i % 3 else f"s{i}" for i in range(700)])
    got = rows(mm.proofs(table).withColumn("again", mm.folded(F.col("leaf"), F.col("proof"))))
    assert len(got) == 700 and all(r["again"] == r["root"] for r in got)
    changed = rows(mm.proofs(table.withColumn("text", F.when(F.col("doc_id") == 5, "Row five").otherwise(F.col("text")))))
    assert {r["doc_id"] for r in changed for q in got if q["doc_id"] == r["doc_id"] and q["leaf"] != r["leaf"]} == {5}
    assert changed[0]["root"] != got[0]["root"]


def test_without_sending_ancestors(spark, data, monkeypatch):
    want = result(spark, data)
    monkeypatch.setattr(mm, "SENT_SEGMENTS", 0)
    assert result(spark, data) == want


def test_sql_gives_the_same(spark, data):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(db.sql(f"SELECT {', '.join(COLUMNS)} FROM ({mm.OP12_SQL})").fetchall(), key=str) == result(spark, data)
