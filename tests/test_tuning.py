"""Proposals from earlier trials, and trials that end early."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from tabspark.operators import folds, models, parzen, training
from tabspark.operators.search import Choice, Range
from tabspark.operators.target import x_y

SPACE = {"rate": Range(0.001, 1.0, "log"), "depth": Range(1, 30), "kind": Choice(["a", "b", "c", "d"]), "fixed": 7}


def cost(p):
    return (math.log10(p["rate"]) + 1.3) ** 2 + ((p["depth"] - 22) / 10) ** 2 + {"a": 1, "b": 0, "c": 2, "d": 1}[p["kind"]]


def adaptive(seed, n=40):
    rng, trials = random.Random(seed), []
    while len(trials) < n:
        new = [training.draw(SPACE, rng) for _ in range(10)] if len(trials) < 10 else parzen.propose(SPACE, trials, rng, 2)
        trials += [(p, cost(p)) for p in new]
    return min(c for _, c in trials), trials


def test_beats_random_draws_at_equal_budget():
    ours = [adaptive(s)[0] for s in range(30)]
    blind = []
    for s in range(30):
        rng = random.Random(s)
        blind.append(min(cost(training.draw(SPACE, rng)) for _ in range(40)))
    assert np.mean(ours) < 0.7 * np.mean(blind) and sum(a <= b for a, b in zip(ours, blind)) >= 18
    assert adaptive(3)[1] == adaptive(3)[1]


def test_proposals_stay_in_the_space():
    _, trials = adaptive(1)
    for p, _ in trials:
        assert 0.001 <= p["rate"] <= 1 and isinstance(p["depth"], int) and 1 <= p["depth"] <= 30 and p["kind"] in "abcd" and p["fixed"] == 7
    steps = parzen.propose({"x": Range(0.0, 1.0, 0.25)}, [({"x": 0.5}, 1.0), ({"x": 0.75}, 2.0)], random.Random(1), 20)
    assert {s["x"] for s in steps} <= {0.0, 0.25, 0.5, 0.75, 1.0}
    u = np.linspace(0, 1, 20001)[:-1] + 0.5 / 20000
    for points in ([], [0.1], [0.2, 0.9, 0.9]):
        assert np.mean([parzen.density(points, x) for x in u]) == pytest.approx(1, abs=1e-3)


def test_halving_ends_poor_trials(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"id": np.arange(120), "a": rng.random(120)})
    pdf["y"] = np.sin(6 * pdf.a) * 10
    t = x_y(spark.createDataFrame(pdf), "y", keep="id")
    f = folds.k_fold(t.df, "id", 4)
    found = training.tune(t, f, models.random_forest(n_estimators=2, max_features="all", max_samples=1.0), {"max_depth": Choice([1, 2, 6])}, n_trials=4, startup=4, halving=2, parallelism=2)
    rows = found.trials.toPandas()
    assert sorted(rows.folds) == [1, 1, 2, 4] and rows.ended_early.sum() == 3
    assert found.score == rows[~rows.ended_early].value.item()
    best = rows[~rows.ended_early].params.item()
    assert dict(best)["max_depth"] == str(found.best.settings["max_depth"])


def test_large_front_and_ties(spark, monkeypatch):
    from pyspark.sql import functions as F
    from tabspark.operators import search

    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": np.arange(900), "a": rng.integers(0, 25, 900), "b": rng.integers(0, 25, 900).astype(float), "c": rng.integers(-6, 6, 900)})
    pdf.loc[5, "b"] = None
    df = spark.createDataFrame(pdf).repartition(6).withColumn("b", F.when(~F.isnan("b"), F.col("b")))
    for names in (["a"], ["a", "b"], ["a", "b", "c"]):
        way = dict(zip(names, ["minimize", "maximize", "minimize"]))
        v = pdf[names].to_numpy(float) * np.array([1 if way[t] == "minimize" else -1 for t in names])
        with np.errstate(invalid="ignore"):
            want = [not np.isnan(r).any() and not any(np.all(o <= r) and np.any(o < r) for o in v) for r in v]
        for rows in (1000, 3):
            monkeypatch.setattr(search, "CELL_ROWS", rows)
            got = search.with_pareto_flag(df, way).toPandas().sort_values("id")
            assert got.pareto.tolist() == want and len(got) == 900
    monkeypatch.setattr(search, "CELL_ROWS", 1000)
    line = spark.range(200_000).select("id", F.col("id").alias("a"), (-F.col("id")).alias("b"))  # no row dominates another
    assert search.with_pareto_flag(line, {"a": "minimize", "b": "minimize"}).filter("pareto").count() == 200_000
