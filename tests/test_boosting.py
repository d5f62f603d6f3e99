"""Boosted trees against a plain single-process version that tries every split."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import boosting, folds, models, shap, training
from tabspark.operators.boosting import Settings
from tabspark.operators.target import x_y


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.integers(0, 12, n).astype(float), "b": rng.integers(0, 9, n).astype(float), "c": rng.integers(0, 5, n)})
    pdf["y"] = np.round(pdf.a * 2 - (pdf.b > 4) * 6 + np.array([0, 5, -3, 2, 9])[pdf.c] + rng.normal(size=n), 2)
    pdf["cls"] = (pd.qcut(pdf.y, 3, labels=False)).astype(float)
    pdf["two"] = (pdf.y > pdf.y.median()).astype(float)
    return pdf, spark.createDataFrame(pdf).repartition(5).persist()


def best_split(x, kinds, rows, g, h, s):
    """All thresholds of all numbers, all prefixes of category orders: (gain, feature, goes-left mask)."""
    best = None
    score = lambda i: max(abs(g[i].sum()) - s.reg_alpha, 0) ** 2 / (h[i].sum() + s.reg_lambda)
    for f, kind in enumerate(kinds):
        v = x[rows, f]
        if kind == "c":
            levels = sorted(set(v), key=lambda k: g[rows[v == k]].sum() / (h[rows[v == k]].sum() + s.reg_lambda))
            masks = [np.isin(v, levels[: i + 1]) for i in range(len(levels) - 1)]
        else:
            masks = [v <= t for t in sorted(set(v))[:-1]]
        for m in masks:
            left, right = rows[m], rows[~m]
            if min(len(left), len(right)) < s.min_child_samples or min(h[left].sum(), h[right].sum()) < s.min_child_weight:
                continue
            gain = (score(left) + score(right) - score(rows)) / 2 - s.gamma
            if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                best = (gain, f, m)
    return best


def plain_tree(x, kinds, g, h, s):
    """Values per row and the number of leaves of one tree."""
    out, leaves = np.zeros(len(x)), [(np.arange(len(x)), 0)]
    if s.growth == "level":
        for depth in range(s.max_depth):
            grown = []
            for rows, d in leaves:
                found = best_split(x, kinds, rows, g, h, s) if d == depth else None
                grown += [(rows, d)] if found is None else [(rows[found[2]], d + 1), (rows[~found[2]], d + 1)]
            leaves = grown
    else:
        known = {0: best_split(x, kinds, leaves[0][0], g, h, s)}
        live, every = [0], [leaves[0]]
        while len(live) < s.max_leaves:
            able = [i for i in live if known[i] and (not s.max_depth or every[i][1] < s.max_depth)]
            if not able:
                break
            i = max(able, key=lambda i: known[i][0])
            rows, d = every[i]
            for part in (rows[known[i][2]], rows[~known[i][2]]):
                every.append((part, d + 1))
                known[len(every) - 1] = best_split(x, kinds, part, g, h, s)
                live.append(len(every) - 1)
            live.remove(i)
        leaves = [every[i] for i in live]
    for rows, _ in leaves:
        out[rows] = -np.sign(g[rows].sum()) * max(abs(g[rows].sum()) - s.reg_alpha, 0) / (h[rows].sum() + s.reg_lambda)
    return out, len(leaves), max(d for _, d in leaves)


def plain_boost(x, kinds, y, task, s):
    if task == "squared":
        margin = np.full((len(y), 1), y.mean())
    elif task == "logistic":
        margin = np.full((len(y), 1), math.log(y.mean() / (1 - y.mean())))
    else:
        margin = np.tile(np.log([(y == k).mean() for k in range(3)]), (len(y), 1))
    shapes = []
    for _ in range(s.n_estimators):
        if task == "squared":
            g, h = margin - y[:, None], np.ones_like(margin)
        elif task == "logistic":
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(margin) / np.exp(margin).sum(1, keepdims=True)
            g, h = p - (y[:, None] == np.arange(3)), p * (1 - p)
        step = np.zeros_like(margin)
        for k in range(margin.shape[1]):
            step[:, k], n, depth = plain_tree(x, kinds, g[:, k], h[:, k], s)
            shapes.append((n, depth))
        margin = margin + s.learning_rate * step
    return margin, shapes


CASES = [
    ("squared", Settings("level", 4, 0.3, 3, gamma=1.0, reg_alpha=0.5, reg_lambda=2.0, min_child_samples=5)),
    ("squared", Settings("leaf", 12, 0.2, 0, 7, min_child_samples=10, reg_lambda=0.0)),  # more rounds than a refresh
    ("squared", Settings("leaf", 2, 0.5, 4, 31)),
    ("logistic", Settings("level", 3, 0.3, 3, min_child_weight=1.5)),
    ("softmax", Settings("leaf", 3, 0.3, 0, 5, min_child_samples=4)),
]


@pytest.mark.parametrize("task,s", CASES)
def test_equals_every_split_tried(data, task, s):
    pdf, df = data
    y = {"squared": "y", "logistic": "two", "softmax": "cls"}[task]
    model = boosting.fit(df.withColumn("__label", F.col(y)), ["a", "b", "c"], {"c": 6}, task, 3 if task == "softmax" else 1, s)
    x = pdf[["a", "b", "c"]].to_numpy(float)
    want, shapes = plain_boost(x, "nnc", pdf[y].to_numpy(), task, s)
    assert np.allclose(model.margins(x), want, atol=1e-6)
    assert [(t.leaves) for r in model.rounds for t in r] == [n for n, _ in shapes]
    if s.growth == "leaf" and s.max_depth == 0 and task == "squared":
        assert all(n <= s.max_leaves for n, _ in shapes) and any(d > math.ceil(math.log2(s.max_leaves)) for _, d in shapes)  # deeper than a balanced tree
    curve = [v for v, _ in model.losses]
    assert len(curve) == s.n_estimators + 1 and curve[-1] < curve[0]


def test_symmetric_trees_have_one_split_a_level(data):
    pdf, df = data
    s = Settings("symmetric", 5, 0.3, 3, ordered=True, reg_lambda=3.0)
    model = boosting.fit(df.withColumn("__label", F.col("y")), ["a", "b", "c"], {"c": 6}, "squared", 1, s)
    for (t,) in model.rounds:
        assert t.leaves == 8
        level = [0]
        while t.feature[level[0]] >= 0:
            assert len({(t.feature[i], t.threshold[i], tuple(t.levels[i] or ())) for i in level}) == 1
            level = [c for i in level for c in (t.left[i], t.right[i])]
    error = (model.margins(pdf[["a", "b", "c"]].to_numpy(float))[:, 0] - pdf.y) ** 2
    assert error.mean() < 0.35 * pdf.y.var()


def test_ordered_statistics_are_prefix_means(data, spark):
    pdf, df = data
    rows = df.select("a", "c", "y", (F.col("id") % 5 == 0).alias("held"))
    out, final = boosting.ordered_statistics(rows, ["c"], {"y": F.col("y")}, "held", 7)
    h = F.xxhash64(F.lit(7), "a", "c", "y", "held")
    got = out.withColumn("h", h).toPandas().sort_values("h", kind="stable")
    train = got[~got.held]
    prior = train.y.mean()
    sums, counts = train.groupby("c").y.sum(), train.groupby("c").y.count()
    assert final["c__y"][0] == pytest.approx(prior) and final["c__y"][1] == pytest.approx({k: (sums[k] + prior) / (counts[k] + 1) for k in sums.index})
    before = train.groupby("c").y.cumsum() - train.y
    assert np.allclose(train["c__y"], (before + prior) / (train.groupby("c").cumcount() + 1))
    assert np.allclose(got[got.held]["c__y"], [final["c__y"][1][k] for k in got[got.held].c])


def test_early_stop_keeps_the_best_round(data, spark):
    rng = np.random.default_rng(2)
    noise = pd.DataFrame({"a": rng.random(200), "b": rng.random(200), "__label": rng.normal(size=200)})
    train, held = spark.createDataFrame(noise[:100]), spark.createDataFrame(noise[100:])
    s = Settings("level", 60, 0.5, 5, early_stopping_rounds=4, reg_lambda=0.0)
    model = boosting.fit(train, ["a", "b"], {}, "squared", 1, s, held)
    losses = [v for _, v in model.losses]
    best = int(np.argmin(losses[1:])) + 1
    assert len(model.rounds) == best and len(losses) == best + 4 + 1 < 61
    want = ((model.margins(noise[100:][["a", "b"]].to_numpy())[:, 0] - noise[100:]["__label"]) ** 2).mean()
    assert losses[best] == pytest.approx(want)


def test_sampling_is_seeded(data):
    _, df = data
    fit = lambda seed: boosting.fit(df.withColumn("__label", F.col("y")), ["a", "b"], {}, "squared", 1, Settings("level", 2, max_depth=3, subsample=0.5, colsample_bytree=0.5, colsample_bylevel=0.9, seed=seed))
    one = fit(1)
    assert all(len({f for f in t.feature if f >= 0}) == 1 for (t,) in one.rounds)  # one of two columns a tree
    assert 200 < one.rounds[0][0].cover[0] < 400
    with pytest.raises(ValueError):
        Settings("level", max_depth=0)
    with pytest.raises(ValueError):
        Settings("sideways")


@pytest.mark.parametrize("spec", [models.gbt("xgb", n_estimators=3, max_depth=3), models.gbt("lgbm", n_estimators=3, num_leaves=6), models.gbt("cat", n_estimators=3, depth=3)])
def test_multiclass_contributions_add_up_to_each_margin(data, spark, tmp_path, spec):
    pdf, df = data
    wide = df.select("id", "a", "b", F.concat(F.lit("k"), F.col("c").cast("string")).alias("c"), F.concat(F.lit("class"), F.col("cls").cast("int").cast("string")).alias("cls"))
    t = x_y(wide, "cls", keep="id")
    f = folds.k_fold(t.df, "id", 2)
    result = training.cross_validate(t, f, spec)
    assert result.metrics().toPandas().accuracy.min() > 0.6
    m = result.models[0]
    x = shap.tree_shap(m, f.test(0), "id").toPandas()
    assert set(x.output) == {"class0", "class1", "class2"}
    ready = m.chain.apply(f.test(0))
    for stage in m.pipeline.stages:
        ready = stage.transform(ready)
    raw = ready.select("id", "rawPrediction", "probability").toPandas().set_index("id")
    for k in range(3):
        part = x[x.output == f"class{k}"].set_index("id")
        total = part.base + part.shap.map(lambda d: sum(d.values()))
        assert np.allclose(total, raw.loc[part.index].rawPrediction.map(lambda v: v[k]))
    assert np.allclose(raw.probability.map(sum), 1)
    importance = training.feature_importance(result.models).toPandas()
    assert set(importance.feature) == {"a", "b", "c"} and np.allclose(importance.groupby("fold").importance.sum(), 1)
    curve = training.loss_curve(result, f, ("train",)).toPandas()
    assert len(curve) == 6 and (curve.groupby("fold").loss.last() < curve.groupby("fold").loss.first()).all()
    path = models.save_model(m, str(tmp_path), "r")
    again = models.load_model(spark, path)
    assert again.score(f.test(0), "p").orderBy("id").select("p").collect() == m.score(f.test(0), "p").orderBy("id").select("p").collect()


@pytest.mark.parametrize("extra", [{}, {"growth": "leaf", "max_leaves": 6, "subsample": 0.7}, {"growth": "symmetric", "bagging_temperature": 1.0}])
def test_small_tables_grow_the_same_trees_in_one_task(data, monkeypatch, extra):
    pdf, df = data
    s = Settings(n_estimators=3, max_depth=3, bins=20, **extra)
    label, kind, n = ("cls", "softmax", 3) if not extra else ("y", "squared", 1)
    rows = df.select("a", "b", "c", F.col(label).alias("__label"), "id")
    train, held = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    monkeypatch.setattr(boosting.Trainer, "_best", lambda *_: pytest.fail("a job for a step"))
    levels = {} if s.growth == "symmetric" else {"c": 5}
    near = boosting.fit(train, ["a", "b", "c"], levels, kind, n, s, held)
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "NEAR_BYTES", 0)
    far = boosting.fit(train, ["a", "b", "c"], levels, kind, n, s, held)
    assert len(near.losses) == 4 and np.allclose(near.losses, far.losses, rtol=1e-9)
    for a, b in zip(sum(near.rounds, []), sum(far.rounds, []), strict=True):
        assert (a.feature, a.threshold, a.levels, a.left, a.cover) == (b.feature, b.threshold, b.levels, b.left, b.cover) and np.allclose(a.value, b.value)


def test_loss_curve_query_runs_every_round_of_the_preset(spark):
    import __spark_entry__ as entry

    got = entry.queries()["loss_curve"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")).collect()
    assert {(r.type, r.iterations) for r in got} == {(t, models.DEFAULTS["XGB"]["n_estimators"]) for t in ("train", "val")}
