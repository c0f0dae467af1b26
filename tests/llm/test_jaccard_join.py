import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from clientlens.llm import jaccard_join as jj
from tests.llm.frames import docs, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(ids, texts, width, percent):
    """(size, smallest id reachable) by comparing all texts that share a shingle."""
    sets = [shingle_set(t, width) for t in texts]
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    seen = set()
    for group in holders.values():
        for a, b in itertools.combinations(group, 2):
            if (a, b) not in seen:
                seen.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(len(sets[i]), least[find(i)]) for i in range(len(ids))]


def check(spark, texts, width, percent):
    got = sorted(rows(jj.component_ids(docs(spark, texts), width, percent)), key=lambda r: r["doc_id"])
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute(range(len(texts)), texts, width, percent)
    return got


def family(draw, size, copies, change):
    words = [f"w{draw.randint(0, 10**6)}" for _ in range(size)]
    out = [" ".join(words)]
    for _ in range(copies):
        out.append(" ".join(w if draw.random() > change else f"x{draw.randint(0, 10**6)}" for w in words))
    return out


def test_whole_table_agrees_with_brute_force(spark, data, corpus):
    table = sorted(rows(corpus.select("doc_id", "text")), key=lambda r: r["doc_id"])
    got = sorted(rows(jj.op4_jaccard_join(spark, data)), key=lambda r: r["doc_id"])
    want = brute([r["doc_id"] for r in table], [r["text"] for r in table], 4, 85)
    assert [(r["n_shingles"], r["component_id"]) for r in got] == want
    assert any(c != r["doc_id"] for r, (_, c) in zip(got, want))


def test_families_around_the_threshold(spark):
    draw = random.Random(11)
    texts = [t for size, change in ((30, 0.01), (60, 0.02), (150, 0.03), (150, 0.01), (300, 0.005)) for t in family(draw, size, 25, change)]
    texts += [" ".join(draw.choice("abcde") for _ in range(draw.randint(1, 14))) for _ in range(80)]
    draw.shuffle(texts)
    got = check(spark, texts, 4, 85)
    assert 10 < len({r["component_id"] for r in got}) < len(texts)
    check(spark, texts[:100], 5, 80)


def test_small_parts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(jj, "PART", 7)
    monkeypatch.setattr(jj, "SENT_ROWS", 0)
    draw = random.Random(12)
    texts = family(draw, 80, 60, 0.01) + family(draw, 80, 30, 0.03)
    check(spark, texts, 4, 85)


def test_a_passage_that_most_documents_hold_links_nothing(spark):
    draw = random.Random(13)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{' '.join(f'u{draw.randint(0, 10**6)}' for _ in range(60))} {passage}" if i % 3 else family(draw, 50, 0, 0)[0] for i in range(240)]
    check(spark, texts, 4, 85)


def test_awkward_texts(spark):
    texts = [None, "", " \n", "a", "A", "a b", "a  b", "a b c", "a b c d", "a b c d a b c d a b c d", "É b c d", "é b c d", "word " * 30_000, "WORD " * 50, "x" * 50_000]
    got = check(spark, texts, 4, 85)
    assert [got[i]["component_id"] for i in (0, 1, 2, 4, 6, 13)] == [0, 1, 2, 3, 5, 12]


def test_tree_keeps_every_pair_that_reaches_the_threshold():
    draw = np.random.default_rng(3)
    base = [np.unique(draw.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in draw.integers(20, 90, 30)]
    sets = [np.unique(np.append(b[draw.random(len(b)) > change], draw.integers(0, 2**63, 2).astype(np.uint64))) for b in base for change in (0, 0.02, 0.05, 0.1, 0.2)]
    sizes = np.array([len(s) for s in sets])
    points = jj.Points([jj.point(s) for s in sets])
    kept = 0
    for i, s in enumerate(sets):
        near = {int(j) for j in range(len(sets)) if points.bound(np.array([i]), np.array([j]))[0] >= jj.least_overlap(sizes[i], sizes[j], 85)}
        for size, members in points.members.items():
            if i in members:
                tree = jj.Tree(sizes[members], points.matrix[size])
                found = set(members[tree.partners(len(s), points.matrix[size][points.place[size][i]], 85)].tolist())
                # the tree leaves out nothing that the bound of a pair allows, given that the sizes fit
                assert {j for j in near if j in members and 100 * min(len(s), sizes[j]) >= 85 * max(len(s), sizes[j]) and size == min(points.own[i], points.own[j])} <= found
        kept += len(near)
        for j, other in enumerate(sets):
            both = len(np.intersect1d(s, other))
            if 100 * both >= 85 * (len(s) + len(other) - both):
                assert j in near
    assert kept < len(sets) ** 2 / 4


def test_full_vectors_bound_nothing_for_very_long_texts():
    usual = np.full(256, 3, dtype=np.uint8).tobytes()
    for n in (5_000_000, 900_000_000):
        sizes = np.array([n, n, 700])
        points = jj.Points([bytes([255]) * 256, bytes([255]) * 256, usual])
        one, two = np.array([0, 0]), np.array([1, 2])
        assert points.bound(one, two)[0] >= jj.least_overlap(sizes[0], sizes[1], 85) and points.bound(one, two)[1] == 768
        tree = jj.Tree(sizes, points.matrix[256])
        assert sorted(tree.partners(n, points.matrix[256][0], 85).tolist()) == [0, 1]
        # also where the counts are folded to half as many groups
        mixed = jj.Points([bytes([255]) * 256, bytes([255]) * 128])
        assert mixed.bound(np.array([0]), np.array([1]))[0] >= jj.least_overlap(n, n, 85)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, 0, i, 0) for i in range(60)] + [(100, 1, 100, 2), (7, 0, 7, 0)], jj.EDGE)
    got = {(r["id"], r["mark"]): (r["root_id"], r["root_mark"]) for r in rows(jj.components(edges, "chain"))}
    assert got == {**{(i, 0): (0, 0) for i in range(61)}, (100, 1): (100, 1), (100, 2): (100, 1)}
    assert rows(jj.components(edges.limit(0), "none")) == []


def test_representatives_stay_whole(spark):
    draw = random.Random(2)
    near = family(draw, 200, 2, 0.003)
    table = docs(spark, [near[1], near[0], near[2], "", "", None, "other text of five words", near[0]], [5, 4, 9, 1, 2, 3, 0, 4]).withColumns(
        {"id": F.lit("x"), "mark": F.lit(0), "n": F.lit(1), "token": F.lit(2), "root_id": F.lit(3)})
    out = jj.representatives(table)
    assert out.columns == table.columns and sorted(r["doc_id"] for r in rows(out)) == [0, 1, 2, 3, 4]


def test_null_ids_and_empty_table(spark):
    got = rows(jj.component_ids(docs(spark, ["a b c d e f", "a b c d e f", "q"], [None, 3, None])))
    assert sorted((r["n_shingles"], r["component_id"]) for r in got if r["n_shingles"] == 2) == [(2, None), (2, None)]
    assert rows(jj.component_ids(docs(spark, []))) == [] and rows(jj.representatives(docs(spark, []))) == []


def test_long_texts_and_mixed_sizes(spark):
    draw = random.Random(15)
    texts = []
    for size in (200, 500, 1500, 4000):
        for _ in range(8):
            texts += family(draw, size, 2, 0.01)
    shared = " ".join(f"s{i}" for i in range(700))
    texts += [f"{shared} {' '.join(f'v{draw.randint(0, 10**6)}' for _ in range(300))}" for _ in range(25)]
    check(spark, texts, 4, 85)


def test_first_ones_of_linked_sets_share_enough():
    draw = random.Random(5)
    for _ in range(300):
        n = draw.randint(1, 200)
        a = set(draw.sample(range(10**6), n))
        b = set(draw.sample(sorted(a), n - draw.randint(0, n // 12))) | set(draw.sample(range(10**6), draw.randint(0, n // 12)))
        both = len(a & b)
        if 100 * both >= 85 * len(a | b):
            first = [set(sorted(s)[:jj.first_ones(len(s), 85)]) for s in (a, b)]
            assert len(first[0] & first[1]) >= min(jj.must_share(len(a)), jj.must_share(len(b)))
            assert len(first[0] & first[1]) >= jj.must_share(-(-85 * len(a) // 100))


def test_many_texts_without_an_id_stay_apart(spark):
    """With 32 bits alone, two of 100,000 different texts would likely be taken for one."""
    n = 100_000
    word = lambda k: F.concat(F.lit("w"), F.xxhash64("id", F.lit(k)).cast("string"))
    table = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", *[word(k) for k in range(6)]).alias("text"))
    copied = table.limit(50).unionByName(spark.createDataFrame([(7, "a b c d e f g"), (None, "a b c d e f g")], "doc_id long, text string"))
    found = jj.component_ids(table.unionByName(copied))
    assert found.count() == n + 52 and found.where("n_shingles <> 2 AND n_shingles <> 3").isEmpty()
    assert rows(found.where("component_id IS NOT NULL")) == []
    kept = jj.representatives(table.unionByName(copied))
    assert kept.count() == n + 1 and kept.where("doc_id = 7").isEmpty()


def test_very_long_texts(spark):
    draw = random.Random(12)
    words = [f"w{draw.randint(0, 10**7)}" for _ in range(60_000)]
    near = list(words)
    for k in range(0, 60_000, 1500):
        near[k] = "changed"
    got = sorted(rows(jj.component_ids(docs(spark, [" ".join(words), " ".join(near), " ".join(words[:20_000]), "a b c"]), 5, 80)), key=lambda r: r["doc_id"])
    assert [r["component_id"] for r in got] == [0, 0, 2, 3] and got[0]["n_shingles"] > 59_000
