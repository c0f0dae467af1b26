"""Merkle manifest of a dataset: a hash tree over its rows and, by pointer jumping, each row's proof.

A row's leaf is the digest of its columns. Per source the leaves ascend by id, and every ``FAN`` consecutive nodes
become the digest of their digests until one is left, the subroot; the subroots, ordered by source, likewise give the
root. A row's proof is the list of its siblings on every level up to the root.

1. Ranks come from one range partitioning: the rows before a partition are counted per source and partition, so that no
   source is ever sorted or numbered by one task.
2. Leaves are gathered in runs of ``FAN``, and levels are built from them, each a grouping by parent.
3. Every node above the runs starts with a pointer to its parent and the segment of its siblings there. A self-join hands
   each node the pointer and the segment of the node it points at: the distance doubles, the segments are put one after the
   other, and after as many rounds as the logarithm of the height all pointers are at the root. The leaves of a run share
   the run's segment and add their own siblings last, so long proofs are moved once per run and not once per row.

Nodes that point at the same ancestor are spread like its descendants; where few ancestors are left, they are sent to all
nodes (``SENT_SEGMENTS``), as a distant ancestor is a hot key and then belongs to a short table.

Digests are lowercase hex sha256; a digest of digests takes them as hex text.

Defined cases: a null field is ``-`` and differs from an empty one; a null id sorts first in its source, a null source first
among sources; equal ids are ordered by digest, and repeated rows, with equal leaves, are separate leaves (their proofs
differ by place, in no stated order); a source with one row has its leaf as subroot, one source has its subroot as root;
very long texts only cost their digest; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clientlens.llm.common import documents, fold, written
from clientlens.llm.exact_dedup import LOWER, UPPER, ascii_lower

FAN = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: So many levels of siblings (a thousand bytes each) at most are sent to all nodes in one round.
SENT_SEGMENTS = 4096
#: Tree of the subroots; the trees of the sources are numbered from 0.
TOP = -1


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def ranked(rows: DataFrame, order: list[str], group: str | None, name: str) -> DataFrame:
    """Adds ``at``, the rank of a row among those of its group, from 0, and ``of``, the number of these.

    One range partitioning by ``order``, which starts with the group; a table of one row per partition and group gives
    the rows before.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slot", F.monotonically_increasing_id())
    slots = written(sorted_, name).withColumn("part", F.shiftright("slot", 33))
    own = F.col(group) if group else F.lit(0)
    counts = slots.groupBy("part", own.alias("own")).agg(F.min("slot").alias("first"), F.count(F.lit(1)).alias("n"))
    same = Window.partitionBy("own")
    before = counts.select(
        F.col("part").alias("in_part"), "own", "first", F.sum("n").over(same).alias("of"),
        F.coalesce(F.sum("n").over(same.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.col("before") + F.col("slot") - F.col("first")
    return (slots.join(before, (F.col("part") == F.col("in_part")) & own.eqNullSafe(F.col("own")))
            .select(*rows.columns, at.alias("at"), "of"))


def _leaves(docs: DataFrame, columns: tuple[str, ...], id_column: str, group: str, also: dict[str, Column]) -> DataFrame:
    """Row, id, source, leaf, and what the caller wants to keep beside them."""
    leaf = digest(*[field(F.col(c)) for c in columns])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), F.col(group).cast("string").alias("source"),
                       leaf.alias("leaf"), F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in also.items()]).alias("also"))
    return written(rows, "leaves")


def _runs(leaves: DataFrame) -> DataFrame:
    """Runs of ``FAN`` leaves: tree, idx, n (runs of the tree), lone (the tree is one leaf), hash, members."""
    placed = written(ranked(leaves, ["source", "doc_id", "leaf", "row"], "source", "sorted-leaves"), "placed-leaves")
    sources = ranked(placed.groupBy("source").agg(F.count(F.lit(1)).alias("rows")), ["source"], None, "sources")
    numbers = sources.select(F.col("source").alias("named"), F.col("at").alias("tree"))
    idx = F.floor(F.col("at") / FAN)
    # few rows per source are joined with the sources' numbers: one per source and run
    runs = placed.groupBy("source", idx.alias("idx")).agg(
        F.sort_array(F.collect_list(F.struct("at", "doc_id", "leaf", "also"))).alias("members"), F.first("of").alias("of"))
    lone = F.col("of") == 1
    return written(runs.join(numbers, F.col("source").eqNullSafe(F.col("named"))).select(
        "tree", "idx", F.ceil(F.col("of") / FAN).alias("n"), lone.alias("lone"),
        F.when(lone, F.col("members")[0]["leaf"]).otherwise(digest(F.array_join("members.leaf", ""))).alias("hash"), "members"), "runs")


def _step(hashes: Column, pos: Column, top: bool) -> Column:
    """The siblings to the left and to the right of the node at ``pos``."""
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), pos), "").alias("before"),
                    F.array_join(F.slice(hashes, pos + 2, F.lit(FAN)), "").alias("after"), F.lit(top).alias("top"))


def _climb(nodes: DataFrame, level: int, top: bool) -> tuple[list[DataFrame], DataFrame]:
    """Pointers to parents of all nodes that have one, and the last node of each tree.

    ``nodes``: id, tree, idx, n (nodes of this level in the tree), hash. One grouping by parent for each level.
    """
    pointers, last = [], []
    while True:
        last.append(nodes.where("n = 1"))
        nodes = nodes.where("n > 1")
        if nodes.isEmpty():
            return pointers, reduce(DataFrame.unionByName, last)
        level += 1
        families = written(nodes.groupBy("tree", F.floor(F.col("idx") / FAN).alias("idx")).agg(
            F.sort_array(F.collect_list(F.struct("idx", "hash", "id"))).alias("members"), F.ceil(F.first("n") / FAN).alias("n")), f"level-{level}")
        up = F.struct(F.col("tree").cast("long").alias("tree"), F.lit(level).alias("level"), F.col("idx").alias("idx"))
        children = families.select(up.alias("up"), F.col("members.hash").alias("hashes"), F.posexplode("members").alias("pos", "m"))
        pointers.append(children.select(F.col("m.id").alias("id"), "up", F.array(_step(F.col("hashes"), F.col("pos"), top)).alias("steps")))
        nodes = families.select(up.alias("id"), "tree", "idx", "n", digest(F.array_join("members.hash", "")).alias("hash"))


def _jumped(pointers: DataFrame, root: Column) -> DataFrame:
    """All nodes below the root with the steps to it: in each round a pointer's distance doubles."""
    nodes, distance = written(pointers, "pointers"), 1
    while True:
        there, way = nodes.where(F.col("up") == root), nodes.where(F.col("up") != root)
        if way.isEmpty():
            return nodes
        far = nodes.join(way.select(F.col("up").alias("id")).distinct(), "id", "left_semi")
        far = far.select(F.col("id").alias("at"), F.col("up").alias("next"), F.col("steps").alias("more"))
        far = written(far, f"ancestors-{distance}")
        if far.limit(SENT_SEGMENTS // distance + 1).count() <= SENT_SEGMENTS // distance:
            far = F.broadcast(far)
        moved = way.join(far, F.col("up") == F.col("at")).select("id", F.col("next").alias("up"), F.concat("steps", "more").alias("steps"))
        nodes, distance = written(there.unionByName(moved), f"jump-{distance}"), 2 * distance


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf has with a proof."""
    return F.aggregate(proof, leaf, lambda found, step: digest(step["before"], found, step["after"]))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def proofs(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_column: str = "doc_id", group: str = "source",
           also: dict[str, Column] | None = None) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof (steps of ``before``, ``after`` and ``top``), and ``also``.

    ``also`` names further columns over ``docs`` that are carried to the result.
    """
    also = also or {}
    runs = _runs(_leaves(docs, columns, id_column, group, also))
    first = F.struct(F.col("tree").cast("long").alias("tree"), F.lit(1).alias("level"), "idx")
    pointers, subroots = _climb(runs.select(first.alias("id"), "tree", "idx", "n", "hash"), 1, False)
    n = subroots.count()
    above, roots = _climb(subroots.select("id", F.lit(TOP).alias("tree"), F.col("tree").alias("idx"), F.lit(n).alias("n"), "hash"), 0, True)
    root = roots.select("id", "hash").first()
    steps = "array<struct<before: string, after: string, top: boolean>>"
    if root is None:
        at, top_hash = F.struct(F.lit(0).cast("long").alias("tree"), F.lit(0).alias("level"), F.lit(0).cast("long").alias("idx")), F.lit(None).cast("string")
    else:
        at, top_hash = F.struct(F.lit(root.id.tree).cast("long").alias("tree"), F.lit(root.id.level).alias("level"), F.lit(root.id.idx).cast("long").alias("idx")), F.lit(root.hash)
    own = runs.withColumn("id", first)
    if pointers or above:
        jumped = _jumped(reduce(DataFrame.unionByName, pointers + above), at)
        own = own.join(jumped.select("id", "steps"), "id", "left")
    else:
        own = own.withColumn("steps", F.lit(None).cast(steps))
    to_root = F.coalesce("steps", F.array().cast(steps))
    per_run = own.select(
        "lone", F.col("members.leaf").alias("leaves"), to_root.alias("steps"),
        folded(F.col("hash"), F.filter(to_root, lambda s: ~s["top"])).alias("subroot"), F.posexplode("members").alias("pos", "m"))
    proof = F.when(F.col("lone"), F.col("steps")).otherwise(F.concat(F.array(_step(F.col("leaves"), F.col("pos"), False)), F.col("steps")))
    return per_run.select(F.col("m.doc_id").alias("doc_id"), F.col("m.leaf").alias("leaf"), "subroot", top_hash.alias("root"), proof.alias("proof"),
                          *[F.col("m.also")[name].alias(name) for name in also])


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all proofs, and the roots found again from rows of which a fifth is tampered with."""
    tampered = F.when(fold("doc_id", 5) == 0, digest(*[field(ascii_lower(F.col(c)) if c == "text" else F.col(c)) for c in COLUMNS]))
    rows = proofs(documents(spark, folder), also={"tampered": tampered})
    found = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    return rows.select("doc_id", "leaf", "subroot", "root", digest(siblings(F.col("proof"))).alias("proof_sha256"), found.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(text if c == "text" else c) for c in COLUMNS) + ")"


#: Levels by recursion over both kinds of trees, steps by windows over the families, roots by folding the steps.
OP12_SQL = f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v
    FROM (SELECT unnest(range(0, 256)) AS i))),
leaves AS (
  SELECT doc_id, source, {_sql_leaf('text')} AS leaf,
    CASE WHEN xor(list_reduce([ascii(ch)::BIGINT for ch in string_split(doc_id::VARCHAR, '')],
                              lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) % 5 = 0
         THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered
  FROM documents, crc),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx
  FROM leaves),
lower AS (
  SELECT tree, 0 AS level, idx, n, leaf AS hash FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(hash, '' ORDER BY idx))
  FROM lower WHERE n > 1 GROUP BY tree, level, idx // {FAN}),
upper AS (
  SELECT 0 AS level, tree AS idx, (SELECT count(DISTINCT tree) FROM placed) AS n, hash FROM lower WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // {FAN}, (any_value(n) + {FAN - 1}) // {FAN}, sha256(string_agg(hash, '' ORDER BY idx))
  FROM upper WHERE n > 1 GROUP BY level, idx // {FAN}),
nodes AS (SELECT tree, level, idx, n, hash FROM lower UNION ALL SELECT {TOP}, level, idx, n, hash FROM upper),
steps AS (
  SELECT tree, level, idx,
    coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY tree, level, idx // {FAN} ORDER BY idx)),
ways AS (
  SELECT p.tree, p.idx, s.tree = {TOP} AS top, s.level, s.before, s.after
  FROM placed p JOIN steps s ON (s.tree = p.tree AND s.idx = p.idx // ({FAN}**s.level)::BIGINT) OR (s.tree = {TOP} AND s.idx = p.tree // ({FAN}**s.level)::BIGINT)),
proofs AS (
  SELECT tree, idx, list(before || '|' || after ORDER BY top, level) AS steps, string_agg(before || after, '' ORDER BY top, level) AS siblings
  FROM ways GROUP BY tree, idx),
results AS (
  SELECT doc_id, leaf, sub.hash AS subroot, (SELECT hash FROM upper WHERE n = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(tampered, leaf), coalesce(steps, [])), lambda found, s: sha256(split_part(s, '|', 1) || found || split_part(s, '|', 2))) AS folded_root
  FROM placed LEFT JOIN proofs USING (tree, idx) JOIN (SELECT tree, hash FROM lower WHERE n = 1) sub USING (tree))
SELECT *, folded_root = root AS verified FROM results"""
