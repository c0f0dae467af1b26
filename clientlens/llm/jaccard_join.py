"""Near-duplicate join on word shingles: count-vector R-trees inside blocks that no link can leave.

Shingle hashes fall into groups; a document's point is its count of shingles in each. Two sets share
at most the sum of the smaller count of every group, and an R-tree over the points, whose nodes keep the largest
counts and the least and largest set size, discards most pairs by that bound. What survives is verified on the sets.

1. Equal sets are one node, so copies cost nothing further.
2. Blocks: linked sets share k shingles among their first ``n - ceil(t * n) + k`` in any common order; sets that share
   fewer go, and the others meet by each shingle. The order puts shingles that a sketch of fixed size saw often
   last, so that shared passages do not make large blocks.
3. In a block, the R-tree finds the pairs that the bound allows. Only a spanning forest of them leaves the task:
   its trees, over all blocks, are clusters outside of which no link exists.
4. Each document's set is sent once to its cluster, whose R-tree gives the pairs to verify; a pair that is already
   connected is skipped. Components of the verified links are the result.

Blocks and clusters beyond ``PART`` members are split into random parts, and every two parts meet in a task of
their own, so no task holds more than two parts. Exact: no pair, partner or candidate is capped.

Defined cases: a null text, or one without words, is the empty set and linked with nothing; with fewer words than a
shingle has, all words are the only shingle; repeated rows are equal sets; a null id is the smallest and its
component is null (so are ids below -2^62); very long texts are sets like others, split into parts where a task would hold
too many shingles; ties of similarity cannot arise, as links only ask for a bound; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from clientlens.llm.common import OWN, REMEMBERED, arrow_step, content, documents, own_id, pieces, raw, shown_id, written

#: Groups of a count vector: a power of two, so that a group counts four shingles on average at most; LEAST at least.
#: MOST in blocks, where a vector travels with each shingle; as many as it takes in clusters, where vectors stay.
LEAST, MOST = 32, 256
#: Count of a group that bounds nothing; two of them fit an unsigned 32-bit integer.
ANY_COUNT = 1 << 30
#: Members that a leaf of the R-tree holds.
LEAF = 48
#: Blocks up to this size are one leaf, whose pairs are bounded without a tree.
SMALL = 12
#: Members that a part of a block or cluster holds at most, on average, and shingles of a cluster's part.
PART, PART_SHINGLES = 4096, 4_000_000
#: Counters of the sketch of frequent shingles, and the pieces in which they are added up.
SKETCH, SKETCH_PIECES = 1 << 18, 64
WORDS_KEPT = 500_000
#: With so many clustered documents at most, their ids are sent to the texts; beyond, both are shuffled.
SENT_ROWS = 200_000


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _Words()
REMEMBERED["shingle words"] = _HASHES.clear


def rolling(text: bytes, width: int) -> np.ndarray:
    """Hash of the shingle from each word on; all words make one when there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    ids = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(ids))
    total = np.full(len(ids) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = total * np.uint64(0xFF51AFD7ED558CCD) + ids[k:k + len(total)]
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(rolling(text, width))


def groups(n: int, most: int) -> int:
    """Groups for a set of n shingles: the sum of smaller counts only tells sets apart when the counts are small."""
    return min(most, max(LEAST, 1 << max(0, int(n) // 4 - 1).bit_length()))


def point(hashes: np.ndarray, most: int = 1 << 16) -> bytes:
    """Shingles in each group, one byte each; counts beyond a byte make all of them as large as can be, which bounds nothing."""
    size = groups(len(hashes), most)
    counts = np.bincount((hashes >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64), minlength=size)
    return (counts if not len(counts) or counts.max() < 256 else np.full(size, 255)).astype(np.uint8).tobytes()


class Points:
    """Count vectors of members by number of groups, each also folded to half as many.

    Sets that can be linked have sizes close enough for their numbers of groups to differ by a factor of two at most.
    """

    def __init__(self, vectors: list[bytes]):
        self.own = np.array([len(v) for v in vectors], dtype=np.int64)
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size in np.unique(self.own).tolist():
            members = np.flatnonzero(self.own == size)
            matrix = np.frombuffer(b"".join([vectors[i] for i in members]), dtype=np.uint8).reshape(len(members), size).astype(np.uint16)
            # a full byte stands for any count: as large as any set, in wider integers where there is one
            full = (matrix == 255).all(axis=1)
            if full.any():
                matrix = matrix.astype(np.uint32)
                matrix[full] = ANY_COUNT
            found.setdefault(size, []).append((members, matrix))
            found.setdefault(size // 2, []).append((members, matrix.reshape(len(members), size // 2, 2).sum(axis=2).astype(matrix.dtype)))
        self.members, self.matrix, self.place = {}, {}, {}
        for size in np.unique(self.own).tolist():
            self.members[size] = np.concatenate([m for m, _ in found[size]])
            self.matrix[size] = np.concatenate([x for _, x in found[size]])
            self.place[size] = np.full(len(vectors), -1, dtype=np.int64)
            self.place[size][self.members[size]] = np.arange(len(self.members[size]))

    def bound(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Most shingles that each pair can share; pairs whose sizes do not fit together get 0."""
        out, size = np.zeros(len(one), dtype=np.int64), np.minimum(self.own[one], self.own[two])
        for g in np.unique(size).tolist():
            here = np.flatnonzero((size == g) & (self.place[g][one] >= 0) & (self.place[g][two] >= 0))
            rows = [self.matrix[g][self.place[g][x[here]]] for x in (one, two)]
            out[here] = np.minimum(*rows).sum(axis=1)
        return out


def must_share(n: int) -> int:
    """Shingles of their first ones that linked sets of n or more shingles share at least (see ``first_ones``)."""
    return 1 + n // 20


def first_ones(n: int, percent: int) -> int:
    """How many shingles, in the common order, two linked sets need to meet: the sets share at least
    ``ceil(t * n)``, so the first k that they share are among the first ``n - ceil(t * n) + k`` of both."""
    return n - -(-percent * n // 100) + must_share(n) if n else 0


def counters(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SKETCH - 1)).astype(np.int64)


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Shared shingles that sets of these sizes need at least."""
    return -(-percent * (a + b) // (100 + percent))


class Tree:
    """R-tree over count vectors, packed in order of size; each level keeps largest counts and size ranges."""

    def __init__(self, sizes: np.ndarray, points: np.ndarray):
        self.order = np.lexsort((*points.T[:4], sizes))
        self.sizes, self.points = sizes[self.order].astype(np.int64), points[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low, high, top = self.sizes, self.sizes, self.points
        while len(low) > 1 or not self.levels:
            cuts = np.arange(0, len(low), LEAF)
            low, high, top = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(top, cuts, axis=0)
            self.levels.append((low, high, top))

    @staticmethod
    def _allowed(size: int, counts: np.ndarray, low: np.ndarray, high: np.ndarray, top: np.ndarray, percent: int) -> np.ndarray:
        """Which nodes (or points) can hold a partner: the size fits, and the bound reaches the least overlap."""
        fits = (100 * np.minimum(high, size) >= percent * np.maximum(low, size))
        fits[fits] = np.minimum(top[fits], counts).sum(axis=1) >= least_overlap(np.maximum(low[fits], -(-percent * size // 100)), size, percent)
        return fits

    def partners(self, size: int, counts: np.ndarray, percent: int) -> np.ndarray:
        """Members that the bound does not exclude."""
        nodes = np.zeros(1, dtype=np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            low, high, top = (x[nodes] for x in self.levels[level])
            nodes = nodes[self._allowed(size, counts, low, high, top, percent)]
            n = len(self.levels[level - 1][0]) if level else len(self.sizes)
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < n]
        near = self.sizes[nodes]
        return self.order[nodes[self._allowed(size, counts, near, near, self.points[nodes], percent)]]


def forest(sizes: np.ndarray, points: Points, part: np.ndarray, percent: int, linked) -> np.ndarray:
    """Smallest connected member of each, over the pairs of the tree that ``linked(i, candidates)`` confirms.

    ``part``: members of equal part -1 or of different parts are compared; equal parts otherwise meet elsewhere.
    """
    label = np.arange(len(sizes))
    for size, members in points.members.items():
        tree, own = Tree(sizes[members], points.matrix[size]), points.own == size
        for i in np.sort(members).tolist():
            near = members[tree.partners(int(sizes[i]), points.matrix[size][points.place[size][i]], percent)]
            near = near[(near < i) & (label[near] != label[i]) & ((part[near] != part[i]) | (part[i] < 0)) & (own[near] | own[i])]
            if len(near):
                near = linked(i, near)
                if len(near):
                    joined = np.unique(np.append(label[near], label[i]))
                    label[np.isin(label, joined)] = joined[0]
    return label


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How often each counter was hit, over all documents, as a level: 0 for ordinary, else the power of two above."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(SKETCH, dtype=np.int64)
        for batch in pieces(batches, 2 << 20):
            # one long text: shingles over its seams, and those repeated in a document, only blur the order
            hits += np.bincount(counters(rolling(b" ".join(raw(batch["text"])), width)), minlength=SKETCH)
        if hits.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(SKETCH_PIECES), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * SKETCH_PIECES, pa.int32()),
                 pa.array([x.tobytes() for x in hits.reshape(SKETCH_PIECES, -1)], pa.binary())], ["piece", "salt", "hits"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH // SKETCH_PIECES, dtype=np.int64)
        for x in table["hits"].to_pylist():
            total += np.frombuffer(x, dtype=np.int64)
        return table.slice(0, 1).set_column(table.schema.get_field_index("hits"), "hits", pa.array([total.tobytes()], pa.binary()))

    schema = "piece int, salt int, hits binary"
    parts = arrow_step(docs.select("text"), count, schema, "shingle words").groupBy("piece", "salt").applyInArrow(add, schema).groupBy("piece").applyInArrow(add, schema)
    rows = sorted(parts.select("piece", "hits").collect())  # SKETCH counters, whatever the corpus
    if not rows:
        return np.zeros(SKETCH, dtype=np.uint8)
    hits = np.concatenate([np.frombuffer(r["hits"], dtype=np.int64) for r in rows])
    usual = np.median(hits)
    over = hits - usual - 6 * np.sqrt(usual + 1)
    return np.where(over > 0, np.log2(np.maximum(hits - usual, 1)) + 1, 0).astype(np.uint8)


def _sets(width: int, percent: int, level: np.ndarray):
    """Per document: size, point, name of the set, and its first shingles in the common order."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            n, points, names, first = [], [], [], []
            for text in raw(batch["text"]):
                own = shingles(text, width)
                wanted = first_ones(len(own), percent)
                often = level[counters(own)]
                usual = own[often == 0]  # hashes ascend, so these are in order
                chosen = usual[:wanted] if len(usual) >= wanted else own[np.lexsort((own, often))[:wanted]]
                n.append(len(own))
                points.append(point(own, MOST))
                names.append(xxhash.xxh3_128_digest(own.tobytes()))
                first.append(chosen.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["id"], batch["mark"], pa.array(n, pa.int64()), pa.array(points, pa.binary()), pa.array(names, pa.binary()), pa.array(first, pa.list_(pa.int64()))],
                ["doc_id", "id", "mark", "n", "point", "name", "first"])
    return step


def _parted(members: DataFrame, parts: Column) -> DataFrame:
    """Each member once for every two parts that meet; ``one`` and ``two`` name the meeting, ``part`` the member's (-1: only one part)."""
    own = F.when(parts <= 1, F.lit(0)).otherwise(F.pmod(F.xxhash64("id", "mark"), parts).cast("int"))
    return (members.withColumn("parts", parts).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts"), F.lit(1)) - 1)))
            .withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")})
            # parts that meet themselves compare all their members
            .withColumn("part", F.when(F.col("one") == F.col("two"), F.lit(-1)).otherwise(F.col("own")))
            .drop("parts", "own", "other"))


EDGE = "a_id long, a_mark int, b_id long, b_mark int"


def _edges(ids: np.ndarray, marks: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[a], pa.int64()), pa.array(marks[a], pa.int32()), pa.array(ids[b], pa.int64()), pa.array(marks[b], pa.int32())],
                                      ["a_id", "a_mark", "b_id", "b_mark"])


def _sorted_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, many groups at a time: tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch[k].to_numpy() for k in key]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        same = bool(held) and all(held[-1][k][-1].as_py() == batch[k][0].as_py() for k in key)
        cut = int(change[-1]) if len(change) else 0
        if not same and held:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _block_forests(percent: int):
    """Spanning forests of the pairs that the bound allows, for blocks in sorted order."""
    key = ["token", "one", "two"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _sorted_groups(batches, key):
            ids, marks, sizes, part = (table[k].to_numpy() for k in ("id", "mark", "n", "part"))
            vectors = table["point"].to_pylist()
            points = Points(vectors)
            starts = np.flatnonzero(np.append(True, np.any([table[k].to_numpy()[1:] != table[k].to_numpy()[:-1] for k in key], axis=0)))
            ends = np.append(starts[1:], len(ids))
            a, b = [], []
            for size in range(2, SMALL + 1):  # most blocks are small; all of one size at a time
                first = starts[ends - starts == size]
                for i, j in zip(*np.triu_indices(size, 1), strict=True):
                    one, two = first + i, first + j
                    fits = (100 * np.minimum(sizes[one], sizes[two]) >= percent * np.maximum(sizes[one], sizes[two])) & ((part[one] != part[two]) | (part[one] < 0))
                    one, two = one[fits], two[fits]
                    fits = points.bound(one, two) >= least_overlap(sizes[one], sizes[two], percent)
                    a.append(one[fits])
                    b.append(two[fits])
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                if e - s > SMALL:
                    label = forest(sizes[s:e], Points(vectors[s:e]), part[s:e], percent, lambda i, near: near)
                    tied = np.flatnonzero(label != np.arange(e - s))
                    a.append(s + label[tied])
                    b.append(s + tied)
            yield _edges(ids, marks, np.concatenate(a), np.concatenate(b))
    return step


def _verified(percent: int):
    """Forests of verified links; a bin holds whole small clusters, or two parts of a large one."""
    def links(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cluster_id", "ascending"), ("cluster_mark", "ascending"), ("id", "ascending"), ("mark", "ascending")])
        ids, marks, sizes, part = (table[k].to_numpy() for k in ("id", "mark", "n", "part"))
        clusters = np.stack([table["cluster_id"].to_numpy(), table["cluster_mark"].to_numpy()])
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table["members"].to_pylist()]
        starts = np.flatnonzero(np.append(True, np.any(clusters[:, 1:] != clusters[:, :-1], axis=0)))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(ids)], strict=True):
            own, n = sets[s:e], sizes[s:e]

            def linked(i: int, near: np.ndarray, own=own, n=n) -> np.ndarray:
                these = np.concatenate([own[j] for j in near])
                at = np.minimum(np.searchsorted(own[i], these), len(own[i]) - 1)
                shared = np.add.reduceat((own[i][at] == these).astype(np.int64), np.cumsum(n[near]) - n[near])
                return near[100 * shared >= percent * (n[near] + n[i] - shared)]

            label = forest(n, Points([point(x) for x in own]), part[s:e], percent, linked)
            tied = np.flatnonzero(label != np.arange(e - s))
            found.append((s + label[tied], s + tied))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.Table.from_batches([_edges(ids, marks, a, b)])
    return links


def components(edges: DataFrame, name: str) -> DataFrame:
    """Smallest node of each node's component, for nodes with an edge: alternating large and small stars.

    Nodes are pairs of id and mark. Neighbour lists are never gathered; each round is a minimum and a join.
    """
    node = lambda side: F.struct(F.col(f"{side}_id").alias("id"), F.col(f"{side}_mark").alias("mark"))
    now = written(edges.select(node("a").alias("u"), node("b").alias("v")).where("u != v").distinct(), name)
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, name)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("v").alias("u"), "v").distinct()
    return now.unionByName(roots).select(F.col("u.id").alias("id"), F.col("u.mark").alias("mark"), F.col("v.id").alias("root_id"), F.col("v.mark").alias("root_mark"))


def _texts(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Id and a hash of the text name a document; rows with both equal have equal sets."""
    own = docs.select(F.col(id_column).alias("doc_id"), content(text).alias("text"))
    return own.withColumns({"id": own_id("doc_id", "text"), "mark": F.hash("text")})


def linked_documents(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, id, mark, n_shingles, name (of the set) and the component's root (id and mark)."""
    texts = _texts(docs, id_column, text)
    level = _sketch(texts, width)
    staged = written(arrow_step(texts, _sets(width, percent, level), "doc_id long, id long, mark int, n long, point binary, name binary, first array<long>", "shingle words"), "shingle-sets")
    nodes = written(staged.where("n > 0").groupBy("name").agg(F.min(F.struct("id", "mark")).alias("node")).select("name", "node.id", "node.mark"), "nodes")
    # rows with equal id and mark are equal texts; one of them stands for all
    own = (staged.join(nodes.select("id", "mark"), ["id", "mark"], "left_semi").select("id", "mark", "n", "first").dropDuplicates(["id", "mark"])
           .select("id", "mark", "n", F.explode("first").alias("token")))
    sharing = _sharing(own, percent)
    # members of a block that fits a task drop out when not even their neighbours by size could be partners
    by_size = Window.partitionBy("token").orderBy("n")
    fits = lambda other: 100 * F.least("n", other) >= percent * F.greatest("n", other)
    near = (sharing.where(F.col("total") <= PART).withColumns({"below": F.lag("n").over(by_size), "above": F.lead("n").over(by_size)})
            .where((F.col("below").isNotNull() & fits(F.col("below"))) | (F.col("above").isNotNull() & fits(F.col("above")))))
    shared = near.select("token", "total", "id", "mark").unionByName(sharing.where(F.col("total") > PART).select("token", "total", "id", "mark"))
    points = staged.select("id", "mark", "n", "point").dropDuplicates(["id", "mark"])
    members = _parted(shared.join(points, ["id", "mark"]), F.ceil(F.col("total") / F.lit(PART)).cast("int"))
    blocks = members.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two").select("token", "one", "two", "part", "id", "mark", "n", "point")
    clusters = components(blocks.mapInArrow(_block_forests(percent), EDGE), "bounds")
    clusters = written(clusters.join(points.select("id", "mark", "n"), ["id", "mark"]), "clusters")
    roots = written(components(_links(texts, clusters, width, percent), "links"), "roots")
    by_name = nodes.join(roots, ["id", "mark"], "left").select("name", F.coalesce("root_id", "id").alias("root_id"), F.coalesce("root_mark", "mark").alias("root_mark"))
    return staged.select("doc_id", "id", "mark", F.col("n").alias("n_shingles"), "name").join(written(by_name, "names"), "name", "left")


def _sharing(own: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """Rows whose shingle another set has among its first ones, of sets that share as many as a link needs.

    A set's partner has ``ceil(t * n)`` shingles at least. Sets that share too few go, then shingles that only they shared.
    """
    partner = F.ceil(F.col("n") * percent / 100)
    for _ in range(rounds):
        several = own.groupBy("token").agg(F.count(F.lit(1)).alias("total")).where("total > 1")
        rows = written(own.join(several, "token"), "sharing")
        enough = rows.groupBy("id", "mark", "n").agg(F.count(F.lit(1)).alias("shares")).where(F.col("shares") >= 1 + F.floor(partner / 20))
        own = rows.join(enough.select("id", "mark"), ["id", "mark"], "left_semi").drop("total")
    several = own.groupBy("token").agg(F.count(F.lit(1)).alias("total")).where("total > 1")
    return written(own.join(several, "token"), "sharing")


def _links(texts: DataFrame, clusters: DataFrame, width: int, percent: int) -> DataFrame:
    """Verified links inside the clusters, as forests."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(PART)), F.ceil(F.sum("n") / F.lit(PART_SHINGLES))).cast("int")
    sizes = clusters.groupBy("root_id", "root_mark").agg(parts.alias("in_parts"))
    wanted = written(clusters.drop("n").join(sizes, ["root_id", "root_mark"]), "clustered")
    count = wanted.count()
    sent = F.broadcast(wanted) if count <= SENT_ROWS else wanted

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2 << 20):
            own = [shingles(t, width) for t in raw(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["mark"], batch["cluster_id"], batch["cluster_mark"], batch["in_parts"], pa.array([len(x) for x in own], pa.int64()),
                 pa.array([x.tobytes() for x in own], pa.binary())], ["id", "mark", "cluster_id", "cluster_mark", "in_parts", "n", "members"])

    chosen = texts.join(sent, ["id", "mark"]).withColumnsRenamed({"root_id": "cluster_id", "root_mark": "cluster_mark"})
    built = arrow_step(chosen.select("id", "mark", "cluster_id", "cluster_mark", "in_parts", "text"), sets,
                       "id long, mark int, cluster_id long, cluster_mark int, in_parts int, n long, members binary", "shingle words")
    bins = max(1, count // 500)
    cluster = F.struct("cluster_id", "cluster_mark")
    binned = _parted(built, F.col("in_parts")).withColumn(
        "bin", F.when(F.col("in_parts") > 1, F.struct(cluster.alias("cluster"), F.lit(-1).cast("bigint").alias("bin"))).otherwise(
            F.struct(F.lit(None).cast("struct<cluster_id:bigint,cluster_mark:int>").alias("cluster"), F.pmod(F.xxhash64("cluster_id", "cluster_mark"), F.lit(bins)).alias("bin"))))
    return binned.groupBy("bin", "one", "two").applyInArrow(_once(_verified(percent)), EDGE)


def _once(links):
    """Rows with equal id and mark are one member; the schema drops to what the verification reads."""
    def step(table: pa.Table) -> pa.Table:
        keys = list(zip(table["id"].to_pylist(), table["mark"].to_pylist(), strict=True))
        first = {k: i for i, k in reversed(list(enumerate(keys)))}
        return links(table.select(["id", "mark", "cluster_id", "cluster_mark", "n", "members", "part"]).take(pa.array(sorted(first.values()))))
    return step


def component_ids(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    linked = linked_documents(docs, width, percent, id_column, text)
    return linked.select("doc_id", "n_shingles", shown_id(F.coalesce("root_id", "id")).alias("component_id"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component (the one with the smallest id), with all its columns; empty sets all stay."""
    linked = linked_documents(docs, width, percent, id_column, text)
    key = [f"{OWN}id", f"{OWN}mark"]
    stays = linked.where("root_id IS NULL OR (id = root_id AND mark = root_mark)").select(
        F.col("id").alias(key[0]), F.col("mark").alias(key[1]), F.col("root_id").isNull().alias(f"{OWN}empty")).distinct()
    named = docs.withColumns({key[0]: own_id(id_column, text), key[1]: F.hash(content(text))}).join(stays, key)
    own = named.where(~F.col(f"{OWN}empty")).dropDuplicates(key).unionByName(named.where(f"{OWN}empty"))
    return own.select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of the whole table: four-word shingles, Jaccard similarity 0.85."""
    return component_ids(documents(spark, folder), width=4, percent=85)
