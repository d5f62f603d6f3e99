"""Feature contributions of tree ensembles: exact, for every row, in one distributed pass.

A tree is read once into its leaves.  A leaf's path holds, per feature, the share of training rows that
go its way (the weight when the feature is unknown) and the values that lead to it.  The contribution
of a feature is its average over all orders in which features become known, which for a path of d
features is a polynomial of degree d; it is evaluated with numpy for a whole Arrow batch per leaf.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.columns import as_list, col
from tabspark.operators import density
from tabspark.operators.boosting import BoostedModel
from tabspark.operators.correlation import correlation_long
from tabspark.operators.models import FoldModel
from tabspark.operators.target import CLASSIFICATION
from tabspark.session import materialize

MAX_DISPLAY = 20
NO_PARTNER = 1e-10


@dataclass
class Leaf:
    value: np.ndarray  # one number per output
    features: list[int]
    shares: list[float]
    bounds: list[tuple[float, float]]  # low < x <= high, for continuous features
    levels: list[frozenset | None]  # allowed values, for category features


def tree_leaves(root, weight: float, outputs: int, class_tree: bool) -> list[Leaf]:
    """Leaves of a Spark ML tree with the merged conditions of their paths."""
    leaves: list[Leaf] = []

    def value_of(node) -> np.ndarray:
        if not class_tree:
            return np.array([weight * node.prediction()])
        counts = np.array(list(node.impurityStats().stats()), dtype=float)
        return weight * counts / counts.sum()

    def visit(node, path: dict):
        if node.subtreeDepth() == 0:
            items = list(path.items())
            leaves.append(Leaf(value_of(node), [f for f, _ in items], [p[0] for _, p in items], [(p[1], p[2]) for _, p in items], [p[3] for _, p in items]))
            return
        split, total = node.split(), node.impurityStats().count()
        f = split.featureIndex()
        share, low, high, levels = path.get(f, (1.0, -math.inf, math.inf, None))
        for child, is_left in ((node.leftChild(), True), (node.rightChild(), False)):
            part = child.impurityStats().count() / total if total else 0.5
            if split.getClass().getSimpleName() == "ContinuousSplit":
                t = split.threshold()
                step = (share * part, low, min(high, t), levels) if is_left else (share * part, max(low, t), high, levels)
            else:
                allowed = frozenset(split.leftCategories() if is_left else split.rightCategories())
                step = (share * part, low, high, allowed if levels is None else levels & allowed)
            visit(child, {**path, f: step})

    visit(root, {})
    return leaves


def ensemble_leaves(model, labels: Sequence[str] = ()) -> tuple[list[Leaf], int]:
    """(leaves, outputs).  Forests average their trees (class shares for classification); boosted trees
    add up, so boosted classifiers are explained on their margin, one per class if there are several."""
    if isinstance(model, BoostedModel):
        return boosted_leaves(model)
    trees = getattr(model, "trees", None)
    if trees is None:
        raise ValueError(f"{type(model).__name__} is not a tree ensemble")
    class_tree = "Classification" in type(trees[0]).__name__
    outputs = len(labels) if class_tree else 1
    leaves: list[Leaf] = []
    for tree in trees:
        leaves += tree_leaves(tree._call_java("rootNode"), 1.0 / len(trees), outputs, class_tree)
    return leaves, outputs


def boosted_leaves(model: BoostedModel) -> tuple[list[Leaf], int]:
    """Leaves of all rounds; a tree adds to the margin of its own output.  The starting margins are a leaf without conditions."""
    start, rate = np.asarray(model.facts["start"], float), model.facts["rate"]
    arity = {int(k): n for k, n in model.facts["arity"].items()}
    leaves = [Leaf(start, [], [], [], [])]
    for trees in model.rounds:
        for k, t in enumerate(trees):
            own = np.zeros(len(start))
            own[k] = rate
            waiting: list[tuple[int, dict]] = [(0, {})]
            while waiting:
                node, path = waiting.pop()
                f = t.feature[node]
                if f < 0:
                    leaves.append(Leaf(own * t.value[node], list(path), [p[0] for p in path.values()], [(p[1], p[2]) for p in path.values()], [p[3] for p in path.values()]))
                    continue
                share, low, high, levels = path.get(f, (1.0, -math.inf, math.inf, None))
                for child, is_left in ((t.left[node], True), (t.right[node], False)):
                    part = t.cover[child] / t.cover[node] if t.cover[node] else 0.5
                    if t.levels[node] is None:
                        cut = t.threshold[node]
                        step = (share * part, low, min(high, cut), levels) if is_left else (share * part, max(low, cut), high, levels)
                    else:
                        allowed = frozenset(t.levels[node]) if is_left else frozenset(range(arity[f])) - frozenset(t.levels[node])
                        step = (share * part, low, high, allowed if levels is None else levels & allowed)
                    waiting.append((child, {**path, f: step}))
    return leaves, len(start)


def base_value(leaves: list[Leaf], outputs: int) -> np.ndarray:
    """Output with no feature known."""
    return sum((leaf.value * np.prod(leaf.shares) for leaf in leaves), np.zeros(outputs))


def contributions(x: np.ndarray, leaves: list[Leaf], n_features: int, outputs: int) -> np.ndarray:
    """(rows, outputs, features) contributions."""
    out = np.zeros((len(x), outputs, n_features))
    for leaf in leaves:
        d = len(leaf.features)
        if d == 0:
            continue
        taken = np.empty((d, len(x)))
        for j, f in enumerate(leaf.features):
            if leaf.levels[j] is not None:
                taken[j] = np.isin(x[:, f], list(leaf.levels[j]))
            else:
                low, high = leaf.bounds[j]
                # as the tree does, what is not <= the threshold (NaN too) goes right
                ok = np.ones(len(x), dtype=bool) if high == math.inf else x[:, f] <= high
                taken[j] = ok if low == -math.inf else ok & ~(x[:, f] <= low)
        # coefficients by number of known features among the others, weighted by s!(d-1-s)!/d!
        order = np.array([math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)])
        for j, f in enumerate(leaf.features):
            poly = np.zeros((d, len(x)))
            poly[0] = 1.0
            for k in range(d):
                if k != j:
                    poly[1:] = poly[1:] * leaf.shares[k] + poly[:-1] * taken[k]
                    poly[0] = poly[0] * leaf.shares[k]
            weight = (order[:, None] * poly).sum(0) * (taken[j] - leaf.shares[j])
            out[:, :, f] += weight[:, None] * leaf.value[None, :]
    return out


def tree_shap(model: FoldModel, df: DataFrame, key) -> DataFrame:
    """(key..., fold, y_name, output, base, shap: map feature -> contribution, x: map feature -> value).

    All rows, no sampling.  ``output`` is the class explained, null for regression.
    """
    keys = as_list(key)
    leaves, outputs = ensemble_leaves(model.model, model.labels)
    base = base_value(leaves, outputs)
    names = list(model.inputs)
    p = len(names)
    named = [str(v) for v in model.labels] if outputs > 1 or (model.task == CLASSIFICATION and outputs == len(model.labels)) else [None]
    held = df.select(F.struct(*[col(k) for k in keys]).alias("__row"), *[col(c) for c in model.x_names])
    ready = model.chain.apply(held)
    for stage in model.pipeline.stages[:-1]:
        ready = stage.transform(ready)
    ready = ready.select("__row", vector_to_array("__features").alias("__x"))

    def explain(batches):
        for pdf in batches:
            x = np.stack(pdf["__x"].to_numpy()) if len(pdf) else np.zeros((0, p))
            phi = contributions(x, leaves, p, outputs)
            yield pd.DataFrame({"__row": pdf["__row"].to_numpy(), "__x": list(x), "__phi": [list(row.ravel()) for row in phi]})

    row_type = ready.schema["__row"].dataType.simpleString()
    raw = ready.mapInPandas(explain, f"__row {row_type}, __x array<double>, __phi array<double>")
    feature = F.array(*[F.lit(n) for n in names])
    per_output = F.array(*[
        F.struct(F.lit(named[o]).cast("string").alias("output"), F.lit(float(base[o])).alias("base"),
                 F.map_from_arrays(feature, F.slice("__phi", o * p + 1, p)).alias("shap"), F.map_from_arrays(feature, F.col("__x")).alias("x"))
        for o in range(outputs)
    ])
    return raw.select("__row.*", F.lit(model.fold).alias("fold"), F.lit(model.y_name).alias("y_name"), F.inline(per_output))


def explain_folds(models: Sequence[FoldModel], rows_of_fold, key) -> DataFrame:
    """Contributions of every fold model on its own rows (``rows_of_fold(fold)``), put together."""
    parts = [tree_shap(m, rows_of_fold(m.fold), key) for m in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shap_long(shap: DataFrame, key) -> DataFrame:
    """(key..., y_name, output, feature, shap_value, value)."""
    keys = [col(k) for k in as_list(key)]
    exploded = shap.select(*keys, "y_name", "output", "x", F.explode("shap").alias("feature", "shap_value"))
    return exploded.select(*keys, "y_name", "output", "feature", "shap_value", F.col("x")[F.col("feature")].alias("value"))


def shap_summary(long: DataFrame, max_display: int | None = MAX_DISPLAY) -> DataFrame:
    """(y_name, output, feature, importance, rank) by mean absolute contribution; ``max_display`` None keeps every feature."""
    mean = long.groupBy("y_name", "output", "feature").agg(F.avg(F.abs("shap_value")).alias("importance"))
    order = Window.partitionBy("y_name", "output").orderBy(F.desc("importance"), "feature")
    ranked = mean.withColumn("rank", F.row_number().over(order))
    return ranked if max_display is None else ranked.filter(F.col("rank") <= max_display)


def partners(shap: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, partner): the feature whose contributions follow this one's most closely."""
    wide = shap.select(*[F.col("shap")[f].alias(f) for f in features])
    spark = shap.sparkSession
    if len(features) < 2:
        return spark.createDataFrame([(f, None) for f in features], "feature string, partner string")
    found = correlation_long(wide, features, "pearson")
    both = found.select(F.col("col_a").alias("feature"), F.col("col_b").alias("partner"), F.abs("r").alias("r")).unionByName(
        found.select(F.col("col_b").alias("feature"), F.col("col_a").alias("partner"), F.abs("r").alias("r")))
    best = both.filter(F.col("r") >= NO_PARTNER).groupBy("feature").agg(F.min_by("partner", F.struct(-F.col("r"), F.col("partner"))).alias("partner"))
    return spark.createDataFrame([(f,) for f in features], "feature string").join(best, "feature", "left")


@dataclass
class Dependence:
    points: DataFrame  # key..., feature, partner, value, shap_value
    line: DataFrame  # feature, x, smooth
    turns: DataFrame  # feature, turn


def shap_dependence(shap: DataFrame, key, top_n: int | None = 10, frac: float = 0.3, output: str | None = None, y_name: str | None = None) -> Dependence:
    """Value against contribution of the strongest features (all with ``top_n`` None), smoothed, with the steepest zero crossing."""
    one = shap.filter(F.col("output").eqNullSafe(F.lit(output)))
    if y_name is not None:
        one = one.filter(F.col("y_name") == y_name)
    one = materialize(one)  # contributions are worked out once, not in every pass below
    long = shap_long(one, key)
    top = [r["feature"] for r in shap_summary(long, top_n).orderBy("rank").select("feature").collect()]  # top_n rows, or one per feature
    names = [r[0] for r in one.select(F.explode(F.map_keys("shap"))).distinct().collect()]  # one row per feature
    points = long.filter(F.col("feature").isin(top)).join(F.broadcast(partners(one, sorted(names))), "feature", "left")
    line = density.lowess(points, ["feature"], "value", "shap_value", frac).select("feature", "x", "smooth")
    return Dependence(points, line, turning_points(line))


def turning_points(line: DataFrame) -> DataFrame:
    """(feature, turn): where the smoothed line crosses zero most steeply; features without a crossing are left out."""
    order = Window.partitionBy("feature").orderBy("x")
    curve = line.groupBy("feature", "x").agg(F.avg("smooth").alias("smooth"))
    steps = curve.withColumn("x0", F.lag("x").over(order)).withColumn("y0", F.lag("smooth").over(order))
    dx, dy = F.col("x") - F.col("x0"), F.col("smooth") - F.col("y0")
    crossing = ((F.col("y0") < 0) != (F.col("smooth") < 0)) & (F.abs(dx) >= 1e-12) & (F.abs(dy) >= 1e-12)
    at = F.col("x0") - F.col("y0") / F.nullif(dy, F.lit(0.0)) * dx
    found = steps.filter(crossing).select("feature", at.alias("at"), (dy / dx).alias("slope"))
    return found.groupBy("feature").agg(F.max_by("at", F.struct(F.abs("slope"), -F.col("at"))).alias("turn"))


def sample_waterfall(shap: DataFrame, key: str, sample_idx: int = 0, output: str | None = None) -> DataFrame:
    """(step, feature, shap_value, value, start, end) of one row: base value plus contributions by size.

    ``sample_idx`` counts rows in key order and is clamped to the last one.
    """
    one = shap.filter(F.col("output").eqNullSafe(F.lit(output)))
    idx = max(0, sample_idx)
    head = one.select(col(key).alias("k")).orderBy("k").limit(idx + 1)
    chosen = head.agg(F.max("k")).first()[0]
    row = one.filter(col(key) == F.lit(chosen)).orderBy("fold", "y_name").limit(1)
    cells = row.select("base", "x", F.explode("shap").alias("feature", "shap_value"))
    order = Window.partitionBy("base").orderBy(F.desc(F.abs("shap_value")), "feature")
    running = F.sum("shap_value").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return cells.select(
        F.row_number().over(order).alias("step"), "feature", "shap_value", F.col("x")[F.col("feature")].alias("value"),
        (F.col("base") + running - F.col("shap_value")).alias("start"), (F.col("base") + running).alias("end"))
