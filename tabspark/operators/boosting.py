"""Gradient-boosted trees grown on distributed gradient histograms.

Rows are stored once as blocks of binned features.  One Spark job per step of growth adds up, for every open node, class and
feature, the histogram of gradients, hessians and rows, in each task first and then by (class, feature); the best split of a
feature is found where its histograms meet, and the driver receives a handful of numbers per open node.  Margins are carried in
the blocks and refreshed every ``REFRESH`` rounds.  Blocks of at most ``NEAR_BYTES`` of bins go through the same steps in one task,
which grows all rounds: there a job per step would cost more than its work.

Three ways to grow a tree:

``level``      every node of a level splits where that gains
``leaf``       best first: the leaf of greatest gain splits next, until there are ``max_leaves``; the children of all leaves that could
               still be chosen are measured in the same job, so a tree takes about as many jobs as it is deep
``symmetric``  one split for all nodes of a level, chosen by their joint gain

A split's gain is second order: half of T(G)^2 / (H + reg_lambda) of both sides less that of the node, less ``gamma``; T shrinks the
gradient sum by ``reg_alpha``.  Leaves are -T(G) / (H + reg_lambda), times the learning rate.  Category features split by sets of levels, taken in
the order of their gradients; with ``ordered`` statistics a level is a number instead, the mean target of the rows before in a
seeded order.  Several classes are one ensemble with a tree per class and round (softmax).
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.columns import SEED
from tabspark.functions.lookup import lookup
from tabspark.functions.order_stats import column_quantiles
from tabspark.session import shared_scratch

BLOCK_ROWS = 8_192
REFRESH = 10
NEAR_BYTES = 16 << 20  # 4 bytes a row and feature
PREFIX_BITS = 6  # an ordered statistic is summed over 2 ** PREFIX_BITS ranges of the seeded order, so that no level is one task
NO_GAIN = 1e-12


@dataclass(frozen=True)
class Settings:
    growth: str = "level"
    n_estimators: int = 100
    learning_rate: float = 0.1
    max_depth: int = 6  # 0: no limit (best-first growth only)
    max_leaves: int = 0  # 0: no limit
    min_child_weight: float = 0.0  # least hessian sum of a child
    min_child_samples: int = 1
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    gamma: float = 0.0
    path_smooth: float = 0.0
    subsample: float = 1.0
    bagging_temperature: float = 0.0
    colsample_bytree: float = 1.0
    colsample_bylevel: float = 1.0
    scale_pos_weight: float = 1.0
    bins: int = 255
    early_stopping_rounds: int | None = 60
    ordered: bool = False
    seed: int = SEED

    def __post_init__(self):
        if self.growth not in ("level", "leaf", "symmetric"):
            raise ValueError(f"unknown growth {self.growth!r}")
        if self.growth == "leaf" and self.max_leaves < 2 and self.max_depth < 1 or self.growth != "leaf" and self.max_depth < 1:
            raise ValueError("growth needs a limit: max_depth, or max_leaves for best-first growth")
        if not 2 <= self.bins <= 60_000:
            raise ValueError("bins must be between 2 and 60000")


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1.  ``levels`` are the levels of a category that go left; numbers go left up to ``threshold``."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    levels: list[list[int] | None] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    bin: list[int | None] = field(default_factory=list)  # while growing: the last bin that goes left

    def add(self, value: float, cover: float, depth: int) -> int:
        for name, v in (("feature", -1), ("threshold", 0.0), ("levels", None), ("left", -1), ("right", -1), ("value", value), ("cover", cover), ("gain", 0.0), ("depth", depth), ("bin", None)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    @property
    def leaves(self) -> int:
        return self.feature.count(-1)

    def nodes_of(self, n: int, goes_left) -> np.ndarray:
        """The node of each row; ``goes_left(node, rows)`` tells which rows of a split go left."""
        at = np.zeros(n, np.int32)
        waiting = [(0, np.arange(n))]
        while waiting:
            node, rows = waiting.pop()
            at[rows] = node
            if self.feature[node] >= 0 and len(rows):
                ok = goes_left(node, rows)
                waiting += [(self.left[node], rows[ok]), (self.right[node], rows[~ok])]
        return at

    def by_bins(self, bins: np.ndarray) -> np.ndarray:
        def goes_left(node, rows):
            b = bins[rows, self.feature[node]]
            return b <= self.bin[node] if self.bin[node] is not None else np.isin(b, self.levels[node])
        return self.nodes_of(len(bins), goes_left)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def goes_left(node, rows):
            v = x[rows, self.feature[node]]
            return v <= self.threshold[node] if self.levels[node] is None else np.isin(v, self.levels[node])
        return np.asarray(self.value)[self.nodes_of(len(x), goes_left)]


def gradients(task: str, margin: np.ndarray, y: np.ndarray, pos_weight: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradient and hessian of the loss by row and output, and the loss of each row."""
    if task == "squared":
        r = margin[:, 0] - y
        return r[:, None], np.ones_like(r)[:, None], r * r
    if task == "logistic":
        p = 1 / (1 + np.exp(-margin[:, 0]))
        w = np.where(y > 0, pos_weight, 1.0)
        return (w * (p - y))[:, None], (w * np.maximum(p * (1 - p), 1e-16))[:, None], np.logaddexp(0, np.where(y > 0, -margin[:, 0], margin[:, 0]))
    m = margin - margin.max(axis=1, keepdims=True)
    p = np.exp(m)
    p /= p.sum(axis=1, keepdims=True)
    own = np.zeros_like(p)
    own[np.arange(len(y)), y.astype(int)] = 1
    return p - own, np.maximum(p * (1 - p), 1e-16), -np.log(np.maximum(p[np.arange(len(y)), y.astype(int)], 1e-300))


def shrunk(g: np.ndarray | float, alpha: float):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def weight(g: float, h: float, n: float, s: Settings, above: float | None = None) -> float:
    """Value of a leaf; ``path_smooth`` draws small leaves to the value of their parent."""
    w = float(-shrunk(g, s.reg_alpha) / (h + s.reg_lambda)) if h + s.reg_lambda > 0 else 0.0
    if s.path_smooth > 0 and above is not None:
        k = n / s.path_smooth
        w = w * k / (k + 1) + above / (k + 1)
    return w


def split_gains(hist: np.ndarray, s: Settings) -> np.ndarray:
    """Gain of a cut after each bin, from (bins, 3) sums of gradient, hessian and rows; -inf where a side is too small."""
    left = np.cumsum(hist, axis=0)[:-1]
    total = hist.sum(axis=0)
    right = total - left

    def score(x):
        return shrunk(x[..., 0], s.reg_alpha) ** 2 / np.maximum(x[..., 1] + s.reg_lambda, 1e-16)

    gain = (score(left) + score(right) - score(total)) / 2 - s.gamma
    least = max(s.min_child_samples, 1)
    small = (np.minimum(left[:, 2], right[:, 2]) < least - 1e-9) | (np.minimum(left[:, 1], right[:, 1]) < s.min_child_weight)
    return np.where(small, -np.inf, gain)


def best_cut(hist: np.ndarray, category: bool, s: Settings) -> tuple[float, int, list[int] | None, np.ndarray] | None:
    """Best split of one feature in one node: gain, last bin or levels that go left, and the left sums."""
    order = None
    if category:
        present = np.flatnonzero(hist[:, 2] > 0)
        order = present[np.argsort(hist[present, 0] / (hist[present, 1] + s.reg_lambda + 1e-16), kind="stable")]
        hist = hist[order]
    if len(hist) < 2:
        return None
    gains = split_gains(hist, s)
    i = int(np.argmax(gains))
    if not gains[i] > NO_GAIN:
        return None
    return float(gains[i]), i, None if order is None else sorted(order[: i + 1].tolist()), hist[: i + 1].sum(axis=0)


# -- training rows ---------------------------------------------------------------------------------


def ordered_statistics(df: DataFrame, levels: Sequence[str], targets: Mapping[str, Any], held_out: str, seed: int = SEED) -> tuple[DataFrame, dict[str, list]]:
    """Adds ``{level column}__{target}``: (sum of the target over earlier rows of the level + prior) / (their number + 1).

    "Earlier" is the seeded hash order of whole rows.  Rows of ``held_out`` get the statistic of all training rows.
    Also returns, per added column, the prior and the final statistic of each level (a level is a number from 0).
    """
    names = list(targets)
    train = F.when(~F.col(held_out), 1).otherwise(0)
    plain = df.columns
    values = [F.coalesce(targets[t].cast("double"), F.lit(0.0)).alias(f"__t_{t}") for t in names]
    cells = [F.col(f"`{c}`") for c in plain if df.schema[c].dataType.typeName() not in ("map", "variant", "udt", "vectorudt")]
    out = df.select("*", *values, train.alias("__train"), F.xxhash64(F.lit(seed), *cells).alias("__order"))
    out = out.withColumn("__range", F.shiftright("__order", 64 - PREFIX_BITS))
    prior = out.where("__train = 1").agg(*[F.avg(f"__t_{t}").alias(t) for t in names]).first()
    prior = {t: float(prior[t] or 0.0) for t in names}
    final: dict[str, list] = {}
    for c in levels:
        sums = out.where("__train = 1").groupBy(c, "__range").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(f"__t_{t}").alias(f"__s_{t}") for t in names])
        before = Window.partitionBy(c).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(c)
        offsets = sums.select(c, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"), F.sum("__n").over(whole).alias("__n1"), "__n",
                              *[x for t in names for x in (F.coalesce(F.sum(f"__s_{t}").over(before), F.lit(0.0)).alias(f"__a_{t}"), F.sum(f"__s_{t}").over(whole).alias(f"__b_{t}"))])
        totals = sums.groupBy(c).agg(F.sum("__n").alias("__n1"), *[F.sum(f"__s_{t}").alias(f"__b_{t}") for t in names])
        rows = totals.orderBy(c).collect()  # one row per level; levels are limited by the caller
        for t in names:
            final[f"{c}__{t}"] = [prior[t], {r[c] if isinstance(r[c], str) else int(r[c]): (r[f"__b_{t}"] + prior[t]) / (r["__n1"] + 1) for r in rows}]
        here = Window.partitionBy(c, "__range").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
        joined = lookup(out, offsets.drop("__n1", *[f"__b_{t}" for t in names]), [c, "__range"], count_col="__n")
        joined = lookup(joined, totals.withColumn("__w", F.col("__n1")), [c], count_col="__w")
        seen = F.coalesce(F.sum("__train").over(here), F.lit(0)) + F.coalesce("__n0", F.lit(0))
        for t in names:
            own = F.coalesce(F.sum(F.col(f"__t_{t}") * F.col("__train")).over(here), F.lit(0.0)) + F.coalesce(f"__a_{t}", F.lit(0.0))
            full = (F.coalesce(f"__b_{t}", F.lit(0.0)) + prior[t]) / (F.coalesce("__n1", F.lit(0)) + 1)
            joined = joined.withColumn(f"{c}__{t}", F.when(F.col("__train") == 1, (own + prior[t]) / (seen + 1)).otherwise(full))
        made = [f"{d}__{t}" for d in levels[: list(levels).index(c) + 1] for t in names]
        out = joined.select(*[F.col(f"`{x}`") for x in [*plain, *made]], *[F.col(f"__t_{t}") for t in names], "__train", "__order", "__range")
    return out.drop("__train", "__order", "__range", *[f"__t_{t}" for t in names]), final


def edges_of(df: DataFrame, columns: Sequence[str], bins: int) -> dict[str, list[float]]:
    """Cut points of each column: its distinct exact quantiles, the greatest left out (a value goes left up to a cut)."""
    if not columns:
        return {}
    found = column_quantiles(df, columns, [i / bins for i in range(bins + 1)])
    out = {}
    for c in columns:
        values = sorted({float(v) for v in found[c] if v is not None and not math.isnan(v)})
        out[c] = values[:-1]
    return out


def _blocks(df: DataFrame, names: Sequence[str], edges: Mapping[str, list[float]], outputs: int, start: Sequence[float]) -> DataFrame:
    """Rows (x, y, held) as blocks of bins, labels, hold-out marks and margins."""
    cuts = [np.asarray(edges[c]) if c in edges else None for c in names]
    wide = len(names)

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
                bins = np.empty(x.shape, np.int32)
                for j, cut in enumerate(cuts):
                    bins[:, j] = x[:, j] if cut is None else np.searchsorted(cut, x[:, j], side="left")
                margin = np.tile(np.asarray(start, float), (len(x), 1))
                y = part.column("y").to_numpy(zero_copy_only=False)
                key = part.column("key").to_numpy()
                yield pa.RecordBatch.from_pydict({
                    "bins": pa.array([bins.tobytes()], pa.binary()), "y": pa.array([y.tobytes()], pa.binary()), "key": pa.array([key.tobytes()], pa.binary()),
                    "held": pa.array([part.column("held").to_numpy(zero_copy_only=False).tobytes()], pa.binary()), "margin": pa.array([margin.tobytes()], pa.binary())})

    return df.mapInArrow(run, BLOCK_SCHEMA)


BLOCK_SCHEMA = "bins binary, y binary, key binary, held binary, margin binary"


def _written(df: DataFrame) -> DataFrame:
    path = f"{shared_scratch(df.sparkSession)}/blocks.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _rows(batches, wide: int, outputs: int):
    for batch in batches:
        for r in batch.to_pylist():
            yield (np.frombuffer(r["bins"], np.int32).reshape(-1, wide), np.frombuffer(r["y"]), np.frombuffer(r["key"], np.int64),
                   np.frombuffer(r["held"], bool), np.frombuffer(r["margin"]).reshape(-1, outputs), r)


def _advance(bins: np.ndarray, margin: np.ndarray, rounds: list[list[Tree]], rate: float) -> np.ndarray:
    out = margin.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            out[:, k] += rate * np.asarray(tree.value)[tree.by_bins(bins)]
    return out


def _draws(key: np.ndarray, seed: int, n: int) -> np.ndarray:
    """Seeded uniform numbers of rows for a round."""
    x = key.view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + n * 0xD1342543DE82EF95) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53


@dataclass
class _Step:
    """What a task needs to add up the histograms of a step of growth."""

    task: str
    settings: Settings
    wide: int
    sizes: list[int]  # bins of each feature
    recent: list[list[Tree]]  # rounds since the margins were written
    trees: list[Tree]  # the trees that grow, one per output
    open: list[list[int]]  # their nodes to measure
    features: list[list[int]]  # features in play, per output
    round: int
    with_loss: bool


def _measure(step: _Step):
    """output, feature, hist: sums of gradient, hessian and rows by open node and bin; feature -1 holds losses and row counts."""
    def run(batches):
        rows = _histograms(step, _rows(batches, step.wide, len(step.trees)))
        yield pa.RecordBatch.from_pydict({"output": pa.array([r[0] for r in rows], pa.int32()), "feature": pa.array([r[1] for r in rows], pa.int32()), "hist": pa.array([r[2] for r in rows], pa.binary())})

    return run


def _histograms(step: _Step, parts) -> list[tuple[int, int, bytes]]:
    s = step.settings
    sums: dict[tuple[int, int], np.ndarray] = {}
    loss = np.zeros(4)
    for bins, y, key, held, margin, _ in parts:
        now = _advance(bins, margin, step.recent, s.learning_rate)
        g, h, each = gradients(step.task, now, y, s.scale_pos_weight)
        loss += [each[~held].sum(), (~held).sum(), each[held].sum(), held.sum()]
        share = np.ones(len(y))
        if s.subsample < 1 or s.bagging_temperature > 0:
            u = _draws(key, s.seed, step.round)
            share = (u < s.subsample).astype(float) if s.subsample < 1 else share
            if s.bagging_temperature > 0:
                share = share * (-np.log(np.maximum(_draws(key, s.seed + 1, step.round), 1e-300))) ** s.bagging_temperature
        use = np.flatnonzero(~held & (share > 0))
        for k, tree in enumerate(step.trees):
            if not step.open[k]:
                continue
            place = np.full(len(tree.feature), -1)
            place[step.open[k]] = np.arange(len(step.open[k]))
            where = place[tree.by_bins(bins[use])]
            rows, where = use[where >= 0], where[where >= 0]
            for f in step.features[k]:
                size = step.sizes[f]
                code, width = where * size + bins[rows, f], len(step.open[k]) * size
                part = np.stack([np.bincount(code, w, width) for w in (g[rows, k] * share[rows], h[rows, k] * share[rows], np.ones(len(rows)))], axis=1)
                at = (k, f)
                sums[at] = sums[at] + part if at in sums else part
    out = [(k, f, v.tobytes()) for (k, f), v in sums.items()]
    return [*out, (-1, -1, loss.tobytes())] if step.with_loss else out


def _choose(step: _Step, categories: frozenset[int]):
    """Adds up the histograms of one (output, feature) and finds its best split in every open node."""
    s = step.settings

    def run(table: pa.Table) -> pa.Table:
        k, f = table.column("output")[0].as_py(), table.column("feature")[0].as_py()
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("hist").combine_chunks())
        rows = []
        if k < 0:
            rows.append((-1, -1, -1, 0.0, json.dumps(total.tolist())))
        else:
            hist = total.reshape(len(step.open[k]), step.sizes[f], 3)
            if s.growth == "symmetric":
                rows += _joint(step, k, f, hist)
            else:
                for i, node in enumerate(step.open[k]):
                    found = best_cut(hist[i], f in categories, s)
                    if found:
                        gain, cut, levels, left = found
                        rows.append((k, node, f, gain, json.dumps([cut, levels, left.tolist(), hist[i].sum(axis=0).tolist()])))
                    elif node == 0:
                        rows.append((k, node, f, -1.0, json.dumps([0, None, [0, 0, 0], hist[i].sum(axis=0).tolist()])))
        return pa.table({"output": pa.array([r[0] for r in rows], pa.int32()), "node": pa.array([r[1] for r in rows], pa.int32()), "feature": pa.array([r[2] for r in rows], pa.int32()),
                         "gain": pa.array([r[3] for r in rows], pa.float64()), "facts": pa.array([r[4] for r in rows], pa.string())})

    return run


def _joint(step: _Step, k: int, f: int, hist: np.ndarray) -> list[tuple]:
    """One cut for all nodes of a level: nodes that it leaves whole add nothing."""
    s = step.settings
    if hist.shape[1] < 2:
        return [(k, 0, f, -1.0, json.dumps([0, [], hist.sum(axis=1).tolist()]))]
    gains = sum(np.maximum(split_gains(h, s), 0.0) for h in hist)
    i = int(np.argmax(gains))
    left = hist[:, : i + 1].sum(axis=1)
    return [(k, 0, f, float(gains[i]) if gains[i] > NO_GAIN else -1.0, json.dumps([i, left.tolist(), hist.sum(axis=1).tolist()]))]


class Trainer:
    """Rounds of growth over written blocks."""

    refresh = REFRESH

    def __init__(self, blocks: DataFrame, task: str, outputs: int, names: list[str], edges: Mapping[str, list[float]], sizes: list[int], settings: Settings):
        self.blocks, self.task, self.outputs, self.names, self.edges, self.sizes, self.s = blocks, task, outputs, names, edges, sizes, settings
        self.categories = frozenset(j for j, c in enumerate(names) if c not in edges)
        self.rounds: list[list[Tree]] = []
        self.recent: list[list[Tree]] = []
        self.losses: list[tuple[float, float | None]] = []

    def _subset(self, pool: list[int], share: float, *at: int) -> list[int]:
        if share >= 1:
            return pool
        n = max(1, int(round(share * len(pool))))
        return sorted(np.random.default_rng([self.s.seed % (1 << 31), *at]).choice(pool, n, replace=False).tolist())

    def _run(self, trees: list[Tree], nodes: list[list[int]], features: list[list[int]], n: int, with_loss: bool):
        """(output, node) -> (gain, feature, facts) of the best splits; and the loss sums if asked for."""
        step = _Step(self.task, self.s, len(self.names), self.sizes, self.recent, trees, nodes, features, n, with_loss)
        out, loss = {}, None
        for r in self._best(step):  # one row per open node and output
            if r["output"] < 0:
                loss = json.loads(r["b"]["facts"])
            else:
                out[r["output"], r["node"]] = (r["b"]["gain"], r["b"]["feature"], json.loads(r["b"]["facts"]))
        return out, loss

    def _best(self, step: _Step) -> list:
        sums = self.blocks.mapInArrow(_measure(step), "output int, feature int, hist binary")
        found = sums.groupBy("output", "feature").applyInArrow(_choose(step, self.categories), "output int, node int, feature int, gain double, facts string")
        return found.groupBy("output", "node").agg(F.max_by(F.struct("feature", "gain", "facts"), F.struct("gain", -F.col("feature"))).alias("b")).collect()

    def _split(self, tree: Tree, node: int, found) -> tuple[int, int]:
        gain, f, (cut, levels, left, total) = found
        right = [a - b for a, b in zip(total, left)]
        above, depth = tree.value[node], tree.depth[node] + 1
        tree.feature[node], tree.gain[node] = f, gain
        if levels is None:
            tree.bin[node], tree.threshold[node] = cut, self.edges[self.names[f]][cut]
        else:
            tree.levels[node] = levels
        tree.left[node] = tree.add(weight(*left, self.s, above), left[2], depth)
        tree.right[node] = tree.add(weight(*right, self.s, above), right[2], depth)
        return tree.left[node], tree.right[node]

    def grow(self, n: int) -> list[Tree]:
        s = self.s
        trees = [Tree() for _ in range(self.outputs)]
        for t in trees:
            t.add(0.0, 0.0, 0)
        pool = [self._subset(list(range(len(self.names))), s.colsample_bytree, n, k) for k in range(self.outputs)]
        nodes, known = [[0] for _ in trees], [{} for _ in trees]
        drafts = [Tree() for _ in trees]  # best-first growth measures beyond the tree: drafts hold all that was split for measuring
        for d in drafts:
            d.add(0.0, 0.0, 0)
        level = 0
        while any(nodes):
            features = [self._subset(p, s.colsample_bylevel, n, k, 1 + level) for k, p in enumerate(pool)]
            growing = drafts if s.growth == "leaf" else trees
            found, loss = self._run(growing, nodes, features, n, level == 0)
            if level == 0:
                self._note(loss)
                for k, t in enumerate(growing):
                    gain, _, facts = found[k, 0]
                    total = facts[-1][0] if s.growth == "symmetric" else facts[-1]
                    t.value[0], t.cover[0] = weight(*total, s), total[2]
            level += 1
            after: list[list[int]] = []
            for k, t in enumerate(growing):
                mine = {node: found[k, node] for node in nodes[k] if (k, node) in found and found[k, node][0] > 0}
                if s.growth == "symmetric":  # the joint split of a level goes under node 0
                    joint = found.get((k, 0))
                    after.append(self._level(t, nodes[k], joint if nodes[k] and joint and joint[0] > 0 else None))
                elif s.growth == "level":
                    new = [c for node, f in sorted(mine.items()) for c in self._split(t, node, f)]
                    after.append(new if level < s.max_depth else [])
                else:
                    known[k].update(mine)
                    after.append(self._ahead(t, known[k]))
            nodes = after
        if s.growth == "leaf":
            trees = [self._pick(d, known[k]) for k, d in enumerate(drafts)]
        return trees

    def _level(self, tree: Tree, nodes: list[int], found) -> list[int]:
        if found is None:
            return []
        gain, f, (cut, lefts, totals) = found
        out: list[int] = []
        for node, left, total in zip(nodes, lefts, totals):
            out += self._split(tree, node, (gain / len(nodes), f, (cut, None, left, total)))
        return out if tree.depth[out[0]] < self.s.max_depth else []

    def _order(self, draft: Tree, known: dict) -> list[int]:
        """The nodes that best-first growth splits, in its order, as far as gains are known."""
        limit, chosen, leaves = self.s.max_leaves or math.inf, [], [0]
        while len(leaves) < limit:
            able = [x for x in leaves if x in known and (not self.s.max_depth or draft.depth[x] < self.s.max_depth)]
            if not able:
                break
            best = max(able, key=lambda x: (known[x][0], -x))
            chosen.append(best)
            leaves.remove(best)
            if draft.feature[best] < 0:  # its children are not measured yet: what follows may change
                leaves += [-2 * best - 2, -2 * best - 3]
            else:
                leaves += [draft.left[best], draft.right[best]]
        return chosen

    def _ahead(self, draft: Tree, known: dict) -> list[int]:
        """Split, in the draft, every node that growth would choose by what is known, and return the new nodes to measure."""
        out: list[int] = []
        for node in self._order(draft, known):
            if draft.feature[node] < 0:
                out += self._split(draft, node, known[node])
        return [x for x in out if not self.s.max_depth or draft.depth[x] < self.s.max_depth]

    def _pick(self, draft: Tree, known: dict) -> Tree:
        """The tree that best-first growth gives, taken out of the draft."""
        chosen = set(self._order(draft, known))
        tree = Tree()

        def copy(node: int) -> int:
            at = tree.add(draft.value[node], draft.cover[node], draft.depth[node])
            if node in chosen:
                tree.feature[at], tree.threshold[at], tree.levels[at], tree.bin[at], tree.gain[at] = draft.feature[node], draft.threshold[node], draft.levels[node], draft.bin[node], draft.gain[node]
                tree.left[at] = copy(draft.left[node])
                tree.right[at] = copy(draft.right[node])
            return at

        copy(0)
        return tree

    def _note(self, loss: list[float]) -> None:
        train, n, held, m = loss
        self.losses.append((train / max(n, 1), held / m if m else None))

    def _refresh(self) -> None:
        recent, rate, wide, outputs = self.recent, self.s.learning_rate, len(self.names), self.outputs

        def run(batches):
            for bins, _, _, _, margin, row in _rows(batches, wide, outputs):
                yield pa.RecordBatch.from_pylist([row | {"margin": _advance(bins, margin, recent, rate).tobytes()}], schema=pa.schema([(c, pa.binary()) for c in row]))

        self.blocks, self.recent = _written(self.blocks.mapInArrow(run, BLOCK_SCHEMA)), []

    def train(self) -> int:
        """Grow rounds; returns the number of rounds to keep.  The first loss is that of no tree."""
        patience = self.s.early_stopping_rounds
        while True:
            n = len(self.rounds)
            if n == self.s.n_estimators:
                _, loss = self._run([Tree() for _ in range(self.outputs)], [[] for _ in range(self.outputs)], [[] for _ in range(self.outputs)], n, True)
                self._note(loss)
            else:
                trees = self.grow(n)
            held = [v for _, v in self.losses[1:]]  # after round 1, 2, ...
            best = int(np.argmin(held)) + 1 if held and held[0] is not None else n
            if n == self.s.n_estimators or patience and held and held[0] is not None and n - best >= patience:
                return best if patience and held and held[0] is not None else n
            self.rounds.append(trees)
            self.recent.append(trees)
            if len(self.recent) >= self.refresh:
                self._refresh()


class NearTrainer(Trainer):
    """The same steps over the blocks that one task holds."""

    refresh = 1

    def _best(self, step: _Step) -> list:
        best: dict[tuple[int, int], dict] = {}
        choose = _choose(step, self.categories)
        for k, f, hist in _histograms(step, self.blocks):
            for r in choose(pa.table({"output": [k], "feature": [f], "hist": [hist]})).to_pylist():
                at = (r["output"], r["node"])
                if at not in best or (r["gain"], -r["feature"]) > (best[at]["gain"], -best[at]["feature"]):
                    best[at] = r
        return [{"output": k, "b": r, "node": node} for (k, node), r in best.items()]

    def _refresh(self) -> None:
        self.blocks = [(bins, y, key, held, _advance(bins, margin, self.recent, self.s.learning_rate), None) for bins, y, key, held, margin, _ in self.blocks]
        self.recent = []


def _train_near(blocks: DataFrame, task: str, outputs: int, names: list[str], edges: Mapping[str, list[float]], sizes: list[int], settings: Settings) -> tuple[int, list[list[Tree]], list]:
    """Rounds to keep, all rounds and their losses, from one task."""
    def run(batches):
        trainer = NearTrainer(list(_rows(batches, len(names), outputs)), task, outputs, names, edges, sizes, settings)
        keep = trainer.train()
        state = {"keep": keep, "rounds": [[asdict(t) for t in r] for r in trainer.rounds], "losses": trainer.losses}
        yield pa.RecordBatch.from_pydict({"state": [json.dumps(state)]})

    state = json.loads(blocks.coalesce(1).mapInArrow(run, "state string").first()["state"])
    return state["keep"], [[Tree(**t) for t in r] for r in state["rounds"]], [tuple(x) for x in state["losses"]]


# -- the model -------------------------------------------------------------------------------------


class BoostedModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted ensemble as a pipeline stage: features in, margins, probabilities and prediction out."""

    def __init__(self):
        super().__init__()
        self.state = Param(self, "state", "trees and settings as JSON", typeConverter=TypeConverters.toString)

    @classmethod
    def of(cls, task: str, start: Sequence[float], rate: float, rounds: list[list[Tree]], n_features: int, arity: Mapping[int, int], losses: list) -> BoostedModel:
        trees = [[{k: v for k, v in asdict(t).items() if k not in ("bin", "depth")} for t in r] for r in rounds]
        out = cls()
        out._set(state=json.dumps({"task": task, "start": list(start), "rate": rate, "trees": trees, "n_features": n_features, "arity": {str(k): v for k, v in arity.items()}, "losses": losses}))
        return out

    @property
    def facts(self) -> dict:
        if not hasattr(self, "_facts"):
            self._facts = json.loads(self.getOrDefault(self.state))
        return self._facts

    @property
    def rounds(self) -> list[list[Tree]]:
        return [[Tree(**t) for t in r] for r in self.facts["trees"]]

    @property
    def losses(self) -> list[tuple[float, float | None]]:
        """Training and validation loss after 0, 1, ... rounds, those after the kept ones included."""
        return [tuple(x) for x in self.facts["losses"]]

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  the name that other ensembles have
        """Shares of the features in the gain of all splits."""
        total = np.zeros(self.facts["n_features"])
        for r in self.rounds:
            for t in r:
                for f, g in zip(t.feature, t.gain):
                    if f >= 0:
                        total[f] += g
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def margins(self, x: np.ndarray, each: bool = False):
        """(rows, outputs) margins, or one such array after every round."""
        out = np.tile(np.asarray(self.facts["start"], float), (len(x), 1))
        steps = []
        for r in self.rounds:
            for k, t in enumerate(r):
                out[:, k] += self.facts["rate"] * t.predict(x)
            if each:
                steps.append(out.copy())
        return steps if each else out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees, task, start, rate = self.rounds, self.facts["task"], self.facts["start"], self.facts["rate"]

        @F.pandas_udf("array<double>")
        def margin(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            out = np.tile(np.asarray(start, float), (len(rows), 1))
            for r in trees:
                for k, t in enumerate(r):
                    out[:, k] += rate * t.predict(rows)
            return pd.Series(list(out))

        out = dataset.withColumn("rawPrediction", margin(vector_to_array("__features")))
        raw = F.col("rawPrediction")
        if task == "squared":
            return out.withColumn("prediction", raw[0])
        if task == "logistic":
            one = 1 / (1 + F.exp(-raw[0]))
            return out.withColumn("probability", F.array(1 - one, one)).withColumn("prediction", F.when(raw[0] > 0, 1.0).otherwise(0.0))
        top = F.array_max(raw)
        odds = F.transform(raw, lambda m: F.exp(m - top))
        out = out.withColumn("probability", F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda a, v: a + v)))
        return out.withColumn("prediction", (F.array_position(raw, top) - 1).cast("double"))

    def evaluateEachIteration(self, dataset: DataFrame, loss: str | None = None) -> list[float]:  # noqa: N802
        """Mean loss of rows (__features, __label) after every kept round, in one pass."""
        task, margins = self.facts["task"], self.margins

        def run(batches):
            total, n = 0.0, 0
            for pdf in batches:
                if len(pdf):
                    y = pdf["y"].to_numpy(float)
                    total = total + np.array([gradients(task, m, y)[2].sum() for m in margins(np.stack(pdf["x"].to_numpy()), each=True)])
                    n += len(pdf)
            if n:
                yield pd.DataFrame({"i": np.arange(len(total)), "loss": total, "n": n})

        rows = dataset.where("__label IS NOT NULL").select(vector_to_array("__features").alias("x"), F.col("__label").alias("y"))
        found = rows.mapInPandas(run, "i int, loss double, n bigint").groupBy("i").agg((F.sum("loss") / F.sum("n")).alias("loss")).orderBy("i").collect()
        return [r["loss"] for r in found]  # one number per round


def fit(train: DataFrame, names: Sequence[str], categories: Mapping[str, int], task: str, outputs: int, settings: Settings, held: DataFrame | None = None) -> BoostedModel:
    """Fit on rows with ``names`` (numbers; categories as level numbers from 0, with their number of levels) and ``__label``.

    ``held`` are validation rows of the same columns: training stops when they have not improved for ``early_stopping_rounds``
    rounds, and the best round is the last one kept.  Rows without a label are left out.
    """
    names = list(names)
    cells = [F.col(f"`{c}`").cast("double").alias(f"f{j}") for j, c in enumerate(names)]
    rows = train.select(*cells, F.col("__label").alias("y"), F.lit(False).alias("held"))
    if held is not None:
        rows = rows.unionByName(held.select(*cells, F.col("__label").alias("y"), F.lit(True).alias("held")))
    rows = rows.where("y IS NOT NULL")
    own = [f"f{j}" for j in range(len(names))]
    levels = {f"f{names.index(c)}": n for c, n in categories.items()}
    facts = rows.where("NOT held").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), *[F.sum((F.col("y") == k).cast("double")).alias(f"c{k}") for k in range(outputs if task == "softmax" else 2)]).first()
    if not facts["n"]:
        raise ValueError("no training rows with a label")
    if task == "squared":
        start = [facts["mean"]]
    elif task == "logistic":
        p = min(max(facts["mean"], 1e-6), 1 - 1e-6)
        start = [math.log(p / (1 - p))]
    else:
        start = [math.log(max(facts[f"c{k}"] / facts["n"], 1e-6)) for k in range(outputs)]
    final: dict[str, list] = {}
    columns = list(own)
    if settings.ordered and levels:
        classes = range(outputs) if task == "softmax" else [None]
        targets = {("y" if k is None else f"y{k}"): F.col("y") if k is None else (F.col("y") == k).cast("double") for k in classes}
        rows, final = ordered_statistics(rows, list(levels), targets, "held", settings.seed)
        rows = _written(rows)
        columns = [c for c in own if c not in levels] + list(final)
    plain = [c for c in columns if c not in levels]
    edges = edges_of(rows.where("NOT held"), plain, settings.bins)
    sizes = [len(edges[c]) + 1 if c in edges else levels[c] for c in columns]
    data = rows.select(F.array(*[F.col(c) for c in columns]).alias("x"), "y", "held", F.xxhash64(*[F.col(c) for c in columns], "y", F.monotonically_increasing_id()).alias("key"))
    blocks = _written(_blocks(data, columns, edges, outputs, start))
    if blocks.agg(F.sum(F.length("bins"))).first()[0] <= NEAR_BYTES:
        keep, rounds, losses = _train_near(blocks, task, outputs, columns, edges, sizes, settings)
    else:
        trainer = Trainer(blocks, task, outputs, columns, edges, sizes, settings)
        keep, rounds, losses = trainer.train(), trainer.rounds, trainer.losses
    rounds = rounds[:keep]
    for r in rounds:
        for t in r:
            _name_features(t, columns, own, final, levels)
    return BoostedModel.of(task, start, settings.learning_rate, rounds, len(names), {own.index(c): n for c, n in levels.items()}, losses)


def _name_features(tree: Tree, columns: list[str], own: list[str], final: dict[str, list], levels: Mapping[str, int]) -> None:
    """Put splits in terms of the input features: one on a level's statistic becomes the set of levels up to it.

    A level that training never saw has the prior as its statistic.
    """
    for node, f in enumerate(tree.feature):
        if f < 0:
            continue
        name = columns[f].split("__")[0]
        if columns[f] in final:
            prior, value = final[columns[f]]
            tree.levels[node] = [k for k in range(levels[name]) if value.get(k, prior) <= tree.threshold[node]]
        tree.feature[node] = own.index(name)
