"""Near duplicates by a chosen-path set similarity join.

A document's set holds its distinct shingles of ``SHINGLE`` words.  Equal sets are merged first.  Each other
set is summarised by ``COORDS`` minwise tokens.  In every tree a document goes down the paths of the
tokens that are smallest under a hash of the node, and of the few more below a threshold, ``1 / similarity``
paths on average; documents that go on together are a node.

A node that fits in a task (``BUNDLE_BYTES`` of sets, ``BUNDLE_ROWS`` documents) goes on branching there by the same rule until nodes hold
``LEAF`` documents.  Those are compared exhaustively by their tokens: members that may be linked (sizes agree, and the estimated
similarity is no more than ``SLACK`` standard errors too low, so one link in three million of exactly the similarity is lost here) are a group.
Nodes that branching does not thin out are groups as a whole.  Members of a group meet with their whole sets; intersections
are counted exactly for all pairs in different components, tile by tile, and only merged components leave the task, at most
one row per document.  A larger node is cut into blocks, which are groups too; if that leaves more than one component in it, it
branches as a Spark stage, ``DEPTH`` levels at most, or, once what lies outside its main component is small, that meets all blocks of the
node.  Trees come in two rounds: groups of the second are compared only if they span two components that the first has found.  So
no group of copies is expanded into its pairs, and nothing is capped.

A link of exactly the similarity meets in a tree's first nodes with about that probability, so ``TREES`` trees miss one in 10^8 or fewer there.
Branching below the first nodes loses more; it starts only beyond ``LEAF`` members.

Null and blank texts have empty sets and are linked with nothing.  Rows of one doc_id are one node, linked by all
their texts; a null doc_id is never linked and stays.  An empty table gives an empty result.  Very long texts are read whole; a set larger
than a bundle is a block of its own.  doc_id must be a whole number that fits 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.llm.common import attach, flat, pieces, saved, text_column
from tabspark.llm.tokens import SOLID, grams, mix, words

SHINGLE = 5
TREES, FIRST, COORDS, LEAF, DEPTH = 12, 4, 128, 128, 4
SLACK = 5
TILE = 512  # documents on a side of an exhaustive comparison
BUNDLE_BYTES, BUNDLE_ROWS = 32 << 20, 16_384  # sets and documents that one task holds at a time
GRAM = 6  # bytes of a shingle hash that are kept to count intersections
COLUMNS = 4096  # shingles that are counted at once
U32, U64 = np.uint32, np.uint64
_SEEDS = mix(np.arange(1, 2 * COORDS + 1, dtype=U64))
_A, _B = (_SEEDS[:COORDS] >> U64(32)).astype(U32) | U32(1), (_SEEDS[COORDS:] >> U64(32)).astype(U32)
_PLACE = (np.arange(COORDS, dtype=U64) + U64(1)) << U64(32)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    w = words(*flat(texts), SOLID)
    g = grams(w.hash, SHINGLE)
    out = []
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        out.append(np.unique(g[a : b - SHINGLE + 1]) if b - a >= SHINGLE else grams(w.hash[a:b], b - a)[:1] if b > a else g[:0])
    return out


def _chosen(tokens: np.ndarray, node: np.ndarray, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """Row and child key of the tokens that each row's node selects: the smallest under its hash, and some below a threshold."""
    rank = mix((tokens + node[:, None]) * U64(0xD6E8FEB86659FD93))
    pick = rank < U64(int(extra / tokens.shape[1] * 2.0**64))
    pick[np.arange(len(tokens)), rank.argmin(axis=1)] = True
    row, col = np.nonzero(pick)
    return row, mix(node[row] * U64(0x9FB21C651E98DF25) + rank[row, col])


def sketches(docs: DataFrame, similarity: float, trees: int) -> DataFrame:
    """doc_id, set size, digest of the set, minwise tokens (16 bits each) and the first node of every path, by round."""
    extra = 1 / similarity - 1

    def run(batches):
        for batch in pieces(batches):
            sets = shingle_sets(text_column(batch, "text"))
            sizes = np.array([len(s) for s in sets])
            full = np.flatnonzero(sizes)
            low = np.zeros((len(sets), COORDS), U32)
            if len(full):
                joined = np.concatenate(sets)
                short = (joined >> U64(32)).astype(U32) ^ joined.astype(U32)
                starts = (np.cumsum(sizes) - sizes)[full]
                for i in range(COORDS):
                    low[full, i] = np.minimum.reduceat(short * _A[i] + _B[i], starts)
            paths: list[list[list[int]]] = [[[] for _ in sets] for _ in range(2)]
            tokens = low.astype(np.uint16)[full].astype(U64) + _PLACE
            for t in range(trees if len(full) else 0):
                row, key = _chosen(tokens, np.full(len(full), mix(np.array([t + 1], U64))[0]), extra)
                for r, k in zip(full[row].tolist(), key.view(np.int64).tolist()):
                    paths[t >= FIRST][r].append(k)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()), "n_shingles": pa.array(sizes, pa.int64()),
                "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                "tokens": pa.array([r.tobytes() for r in low.astype(np.uint16)], pa.binary()), **{f"paths_{k}": pa.array(p, pa.list_(pa.int64())) for k, p in enumerate(paths)}})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, tokens binary, paths_0 array<bigint>, paths_1 array<bigint>")


def _branch(similarity: float):
    extra = 1 / similarity - 1

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, nodes = batch.column("id").to_numpy(), batch.column("node").to_numpy().view(U64)
            tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.uint16).reshape(-1, COORDS).astype(U64) + _PLACE
            row, key = _chosen(tokens, nodes, extra)
            yield pa.RecordBatch.from_pydict({"node": pa.array(key.view(np.int64)), "id": pa.array(ids[row])})

    return run


def _shared(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets with each other, or of ``left`` with ``right``: products of 0/1 matrices over the shingles of two or more sets."""
    sets = left + (right or [])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = n[column] > 1
    row, column = row[keep], (np.cumsum(n > 1) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    k = len(left)
    total = np.zeros((k, len(right) if right else k), np.float64)
    width = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, width, COLUMNS):
        a, b = np.searchsorted(column, [c, c + COLUMNS])
        part = np.zeros((len(sets), min(COLUMNS, width - c)), np.float32)
        part[row[a:b], column[a:b] - c] = 1
        total += part[:k] @ (part[k:] if right else part).T
    return total.astype(np.int64)


class _Bundle:
    """Members of one group with whole sets; finds which of their components are linked."""

    def __init__(self, component: np.ndarray, sets: list[np.ndarray], percent: int):
        self.names, self.label = np.unique(component, return_inverse=True)
        self.sets, self.sizes, self.percent = sets, np.array([len(s) for s in sets]), percent
        self.to = np.arange(len(self.names))  # component that each of the first ones has become
        self.start = self.label.copy()

    def compare(self, i: np.ndarray, j: np.ndarray | None = None) -> None:
        """Link all pairs within ``i``, or across ``i`` and ``j``."""
        both = i if j is None else np.concatenate([i, j])
        if (self.label[both] == self.label[both[0]]).all():
            return
        other = i if j is None else j
        shared = _shared([self.sets[x] for x in i], None if j is None else [self.sets[x] for x in j])
        near = 100 * shared >= self.percent * (self.sizes[i][:, None] + self.sizes[other][None, :] - shared)
        if j is None:
            np.fill_diagonal(near, False)
        for r in np.flatnonzero(near.any(axis=1)):
            a = self.label[i[r]]
            for b in np.unique(self.label[other[near[r]]]):
                if b != a:
                    low, high = min(a, b), max(a, b)
                    self.label[self.label == high] = low
                    a = low

    def dense(self, rows: np.ndarray) -> None:
        """All pairs in different components: tiles on the diagonal first, then what is outside the main component against all."""
        blocks = [rows[a : a + TILE] for a in range(0, len(rows), TILE)]
        for block in blocks:
            self.compare(block)
        found, n = np.unique(self.label[rows], return_counts=True)
        odd = rows[self.label[rows] != found[n.argmax()]]
        for a in range(0, len(odd), TILE):
            for block in blocks:
                self.compare(odd[a : a + TILE], block)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """Old components and the smaller ones they are linked with."""
        self.to[self.start] = self.label
        moved = np.flatnonzero(self.to != np.arange(len(self.to)))
        return self.names[moved], self.names[self.to[moved]]


class _Branches:
    """Members of one node with their tokens; finds the groups that have to be compared."""

    def __init__(self, tokens: np.ndarray, sizes: np.ndarray, similarity: float, leaf: int):
        self.low, self.tokens, self.sizes, self.leaf = tokens, tokens.astype(U64) + _PLACE, sizes, leaf
        self.similarity, self.extra = similarity, 1 / similarity - 1
        self.floor = similarity - SLACK * (similarity * (1 - similarity) / COORDS) ** 0.5
        self.groups: list[np.ndarray] = []

    def visit(self, rows: np.ndarray, node: np.uint64, level: int = 0) -> None:
        if len(rows) <= self.leaf:
            return self.compare(rows)
        if level < DEPTH:
            row, key = _chosen(self.tokens[rows], np.full(len(rows), node, U64), self.extra)
            order = np.argsort(key, kind="stable")
            key, row = key[order], row[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
            sizes = np.diff(cuts).astype(float)
            if (sizes**2).sum() <= len(rows) ** 2 / 2:
                for a in np.flatnonzero(sizes > 1):
                    self.visit(rows[row[cuts[a] : cuts[a + 1]]], key[cuts[a]], level + 1)
                return
        self.groups.append(rows)

    def compare(self, rows: np.ndarray) -> None:
        low, sizes = self.low[rows], self.sizes[rows].astype(float)
        near = np.minimum(sizes[:, None], sizes) >= self.similarity * np.maximum(sizes[:, None], sizes) - 1e-9
        i, j = np.nonzero(np.triu(near, 1))
        hit = (low[i] == low[j]).sum(axis=1) >= self.floor * COORDS
        part = np.arange(len(rows))  # connected candidates are a group: the same copies are the same group in every tree
        for a, b in zip(i[hit].tolist(), j[hit].tolist()):
            if part[a] != part[b]:
                part[part == part[b]] = part[a]
        order = np.argsort(part, kind="stable")
        for g in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            if len(g) > 1:
                self.groups.append(rows[np.sort(g)])


def _by_leaf(rows: DataFrame, solve, schema: str) -> DataFrame:
    """``solve(leaf, batches)`` for the rows of each leaf, which arrive sorted; a task holds one leaf at a time."""
    def run(batches):
        key, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves, done = batch.column("leaf").to_numpy(), []
            cuts = [0, *(np.flatnonzero(np.diff(leaves)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if parts and leaves[a] != key:
                    done.append(solve(key, parts))
                    parts = []
                key = leaves[a]
                parts.append(batch.slice(a, b - a))
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if parts:
            yield solve(key, parts)

    return rows.repartition("leaf").sortWithinPartitions("leaf").mapInArrow(run, schema)


def _groups(nodes: DataFrame, reps: DataFrame, similarity: float, leaf: int) -> DataFrame:
    """(leaf, id) of the distinct groups to compare within the nodes of (node, id)."""
    def solve(key, parts):
        ids = np.concatenate([p.column("id").to_numpy() for p in parts])
        order = np.argsort(ids)
        tokens = np.frombuffer(b"".join(x for p in parts for x in p.column("tokens").to_pylist()), np.uint16).reshape(-1, COORDS)[order]
        sizes = np.concatenate([p.column("n_shingles").to_numpy() for p in parts])[order]
        found = _Branches(tokens, sizes, similarity, leaf)
        found.visit(np.arange(len(ids)), np.array([key], np.int64).view(U64)[0])
        return pa.RecordBatch.from_pydict({"ids": pa.array([ids[order[g]] for g in found.groups], pa.list_(pa.int64()))})

    lists = nodes.groupBy("node").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    met = _listed(lists).join(reps.select("id", "n_shingles", "tokens"), "id").select("leaf", "id", "n_shingles", "tokens")
    return _listed(_by_leaf(met, solve, "ids array<bigint>"))


def _listed(lists: DataFrame) -> DataFrame:
    """(leaf, id) of distinct sorted lists ``ids``."""
    return lists.select(F.xxhash64("ids").alias("leaf"), "ids").dropDuplicates(["leaf"]).select("leaf", F.explode("ids").alias("id"))


def _linked(rows: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of components that the groups in (leaf, id, component) link."""
    def solve(key, parts):
        component = np.concatenate([p.column("component").to_numpy() for p in parts])
        sets = []
        for p in parts:
            for g in p.column("grams").to_pylist():
                wide = np.zeros((len(g) // GRAM, 8), np.uint8)
                wide[:, :GRAM] = np.frombuffer(g, np.uint8).reshape(-1, GRAM)
                sets.append(wide.view(U64).ravel())
        bundle = _Bundle(component, sets, percent)
        bundle.dense(np.arange(len(sets)))
        a, b = bundle.merged()
        return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return _by_leaf(rows.join(grams, "id").select("leaf", "component", "grams"), solve, "a bigint, b bigint")


def _grams(docs: DataFrame, needed: DataFrame, single: bool) -> DataFrame:
    """id and shingle hashes of the sets in ``needed`` (id, doc_id, digest)."""
    def run(batches):
        for batch in pieces(batches):
            sets = shingle_sets(text_column(batch, "text"))
            mine = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == d for s, d in zip(sets, batch.column("digest").to_pylist())]
            grams = [(s >> U64(64 - 8 * GRAM)).view(np.uint8).reshape(-1, 8)[:, :GRAM].tobytes() if ok else None for s, ok in zip(sets, mine)]
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "grams": pa.array(grams, pa.binary())}).filter(pa.array(mine, pa.bool_()))

    found = docs.select("doc_id", "text").join(needed, "doc_id").select("id", "digest", "text").mapInArrow(run, "id bigint, grams binary")
    return found if single else found.dropDuplicates(["id"])


def components(edges: DataFrame) -> DataFrame:
    """id, component (its smallest id) of every id in ``edges`` (a, b).

    Labels move along edges until none changes.  Forests of bounded leaves have small degrees and diameters, so a round
    has no hot key; every fourth round labels also jump to the label of their label, which shortens long chains.
    """
    pairs = edges.where("a <> b")
    both = saved(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels, before, n = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "id")), None, 0
    while True:
        total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total == before:
            return labels
        before, n = total, n + 1
        moved = both.join(labels, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "component").unionByName(labels)
        labels = saved(moved.groupBy("id").agg(F.min("component").alias("component")))
        if n % 4 == 0:
            roots = labels.groupBy("component").agg(F.count("*").alias("__w")).join(labels.select(F.col("id").alias("component"), F.col("component").alias("__to")), "component")
            labels = saved(attach(labels, roots, "component", "__w").select("id", F.least("component", F.coalesce("__to", "component")).alias("component")))


def _split(rows: DataFrame) -> DataFrame:
    """The groups of (leaf, id, component) that span two components."""
    spans = rows.groupBy("leaf").agg(F.collect_set(F.struct("id", "component")).alias("members"), F.min("component").alias("__lo"), F.max("component").alias("__hi"))
    return spans.where("__lo <> __hi").select("leaf", F.explode("members").alias("m")).select("leaf", "m.id", "m.component")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))


def links(docs: DataFrame, percent: int = 85, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, bundle_bytes: int = BUNDLE_BYTES,
          bundle_rows: int = BUNDLE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Per row doc_id, n_shingles, digest; and per digest the component of its set and the number of rows."""
    similarity = percent / 100
    rows = saved(sketches(docs, similarity, trees))
    sets = rows.where("digest is not null and doc_id is not null")
    one = sets.groupBy("digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_rows"))
    reps = sets.select("digest", F.col("doc_id").alias("id"), "n_shingles", "tokens", "paths_0", "paths_1").join(one, ["digest", "id"]).dropDuplicates(["digest"])
    # a doc_id with several texts is several sets: compare the sets under ids of their own
    share = F.greatest(F.col("n_shingles") * (GRAM / bundle_bytes), F.lit(1 / bundle_rows)).alias("share")
    reps = saved(reps.withColumnRenamed("id", "doc_id").withColumn("id", F.monotonically_increasing_id()))
    level = lambda paths: reps.select("id", share, F.explode(F.array_distinct(paths)).alias("node"))
    small, dense = _nodes(level("paths_0"))
    more, dense_more = _nodes(level("paths_1"))
    blocks = _blocks(dense).select(F.xxhash64("node", "block").alias("leaf"), "id")
    early, late = saved(_groups(small, reps, similarity, leaf)), saved(_groups(more, reps, similarity, leaf))
    met = early.select("id").unionByName(late.select("id")).unionByName(dense.select("id")).unionByName(dense_more.select("id")).distinct()
    grams = saved(_grams(docs, met.join(reps.select("id", "doc_id", "digest"), "id"), _unique(rows)))
    first = saved(_linked(early.unionByName(blocks).withColumn("component", F.col("id")), grams, percent).distinct())
    labels = components(first)
    rest = _split(_labelled(late, labels))
    dense = dense.unionByName(dense_more)
    for step in range(depth + 1):
        if dense.isEmpty():
            break
        # a large node within one component is done; if half a bundle is outside its main one, that meets all blocks; else it branches
        marked, main = _main(_blocks(dense), labels)
        last = step == depth
        rest = rest.unionByName(_outside(marked, main.where(F.lit(last) | (F.col("odd") <= 0.5))))
        if last:
            break
        again = dense.join(main.where(F.col("odd") > 0.5).select("node"), "node", "left_semi")
        deeper = again.join(reps.select("id", "tokens"), "id").select("id", "node", "tokens").mapInArrow(_branch(similarity), "node bigint, id bigint").distinct()
        small, dense = _nodes(deeper.join(reps.select("id", share), "id"))
        rest = rest.unionByName(_split(_labelled(_groups(small, reps, similarity, leaf), labels)))
    second = _linked(saved(rest), grams, percent)
    known = labels.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(second)
    # sets of one doc_id belong together
    same = reps.groupBy("doc_id").agg(F.min("id").alias("b"), F.collect_list("id").alias("all")).where(F.size("all") > 1).select(F.explode("all").alias("a"), "b")
    final = components(known.unionByName(same))
    named = reps.select("id", "doc_id", "digest").join(final, "id", "left").withColumn("component", F.coalesce("component", "id"))
    smallest = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("__w"))
    classes = attach(named.select("digest", "component"), smallest, "component", "__w").join(one.select("digest", "n_rows"), "digest")
    return rows.select("doc_id", "n_shingles", "digest"), classes.select("digest", "component_id", "n_rows")


def _unique(rows: DataFrame) -> bool:
    n = rows.agg(F.count("doc_id").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    return n.n == n.d


def _nodes(level: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, id, share) of the nodes that fit in a bundle; and those of larger ones with their ``size`` in bundles.  Lone members are gone."""
    sizes = level.groupBy("node").agg(F.count("*").alias("__w"), F.sum("share").alias("size")).where("__w > 1")
    level = saved(attach(level, sizes, "node", "__w").where("size is not null").select("node", "id", "share", "size"))
    return level.where("size <= 1").drop("size"), level.where("size > 1")


def _blocks(dense: DataFrame) -> DataFrame:
    """Large nodes cut into blocks of about half a bundle; each passes a quarter of its members on to the next block as well."""
    h = F.xxhash64("node", "id")
    cut = dense.select("node", "id", "share", F.ceil(F.col("size") * 2).cast("long").alias("n_blocks"), h.alias("h"))
    own = F.pmod(F.col("h"), F.col("n_blocks"))
    places = F.when(F.pmod(F.shiftright("h", 40), F.lit(4)) == 0, F.array(own, F.pmod(own + 1, F.col("n_blocks")))).otherwise(F.array(own))
    return cut.select("node", "id", "share", "n_blocks", F.explode(F.array_distinct(places)).alias("block"))


def _main(blocks: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of large nodes with their components; and per node the component of most, and the share of a bundle outside it."""
    marked = saved(_labelled(blocks, labels))
    counted = marked.select("node", "id", "component", "share").distinct().groupBy("node", "component").agg(F.sum("share").alias("n"), F.count("*").alias("rows"))
    main = counted.groupBy("node").agg(F.max_by("component", F.struct("n", F.col("component"))).alias("main"), F.sum("rows").alias("size"), F.sum("n").alias("all"), F.max("n").alias("most"))
    spans = counted.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    return marked, saved(main.join(spans, "node").select("node", "main", "size", (F.col("all") - F.col("most")).alias("odd")))


def _outside(marked: DataFrame, main: DataFrame) -> DataFrame:
    """Bundles that bring the members outside a large node's main component together with every block of the node."""
    odd = attach(marked, main, "node", "size").where("component <> main").select("node", "id", "component", "n_blocks", "odd").distinct()
    chunks = odd.withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("odd") * 2).cast("long")))
    spread = chunks.select("node", "chunk", "id", "component", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))
    own = spread.select("node", "block", "chunk").distinct().join(marked.select("node", "block", "id", "component"), ["node", "block"])
    both = spread.select("node", "block", "chunk", "id", "component").unionByName(own.select("node", "block", "chunk", "id", "component"))
    return _split(both.select(F.xxhash64("node", "block", "chunk").alias("leaf"), "id", "component"))


def near_dedup(docs: DataFrame, percent: int = 85, trees: int = TREES) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id linked with it, itself included) and kept."""
    rows, classes = links(docs, percent, trees)
    out = attach(rows, classes, "digest", "n_rows")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """All columns of the rows that stay: of each component the rows of its smallest doc_id; documents with empty sets all stay."""
    found = near_dedup(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
