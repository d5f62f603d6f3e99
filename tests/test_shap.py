import os
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import folds, models, shap, training
from tabspark.operators.target import x_y


@pytest.fixture(scope="module")
def fitted(spark):
    rng = np.random.default_rng(12)
    n = 300
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.random(n), "c": rng.choice(list("uvwx"), n)})
    pdf["y"] = 2 * pdf.a * (pdf.b > 0.4) + pdf.c.map({"u": 0, "v": 4, "w": -3, "x": 1})
    pdf["k"] = np.where(pdf.y > 2, "hi", np.where(pdf.y > 0, "mid", "lo"))
    df = spark.createDataFrame(pdf).persist()
    t = x_y(df.select("id", "a", "b", "c", "y"), "y", task="regression", keep="id")
    f = folds.k_fold(t.df, "id", 2)
    return pdf, df, f, t


def brute(x, leaves, p):
    """Average over all orders, straight from the definition."""
    def value(known):
        total = 0.0
        for leaf in leaves:
            w = leaf.value[0]
            for f, s, (lo, hi), lv in zip(leaf.features, leaf.shares, leaf.bounds, leaf.levels):
                ok = (x[f] in lv) if lv is not None else lo < x[f] <= hi
                w *= float(ok) if f in known else s
            total += w
        return total
    phi = np.zeros(p)
    for i in range(p):
        rest = [j for j in range(p) if j != i]
        for r in range(p):
            for s in combinations(rest, r):
                phi[i] += factorial(r) * factorial(p - 1 - r) / factorial(p) * (value({*s, i}) - value(set(s)))
    return phi


@pytest.mark.parametrize("spec", [models.random_forest(n_estimators=5, max_depth=5, max_features="all"), models.gbt(n_estimators=4, max_depth=4)])
def test_contributions_match_the_definition_and_add_up(fitted, spec):
    pdf, df, f, t = fitted
    m = training.cross_validate(t, f, spec).models[0]
    leaves, outputs = shap.ensemble_leaves(m.model)
    out = shap.tree_shap(m, df, "id")
    rows = out.toPandas().set_index("id")
    assert len(rows) == len(pdf)
    pred = m.score(df, "p").toPandas().set_index("id").p
    total = rows["shap"].map(lambda d: sum(d.values())) + rows.base
    assert np.allclose(total.sort_index(), pred.sort_index())
    for i in (0, 7, 31):
        x = np.array([rows.loc[i, "x"][n] for n in m.inputs])
        assert np.allclose([rows.loc[i, "shap"][n] for n in m.inputs], brute(x, leaves, len(m.inputs)))


def test_class_outputs(fitted):
    pdf, df, f, t = fitted
    tc = x_y(df.select("id", "a", "b", "c", "k"), "k", keep="id")
    m = training.cross_validate(tc, folds.k_fold(tc.df, "id", 2), models.random_forest(n_estimators=4)).models[0]
    out = shap.tree_shap(m, df, "id").toPandas()
    assert set(out.output) == set(m.labels) and len(out) == 3 * len(pdf)
    prob = m.score(df, "p", "q").toPandas().set_index("id").q
    for label in m.labels:
        part = out[out.output == label].set_index("id")
        total = part["shap"].map(lambda d: sum(d.values())) + part.base
        assert np.allclose(total.sort_index(), prob.sort_index().map(lambda q: q[m.labels.index(label)]))


def test_tables(fitted, spark):
    pdf, df, f, t = fitted
    r = training.cross_validate(t, f, models.random_forest(n_estimators=5, max_features="all"))
    s = shap.explain_folds(r.models, f.test, "id")
    assert s.count() == len(pdf)
    long = shap.shap_long(s, "id")
    assert long.count() == 3 * len(pdf)
    summary = shap.shap_summary(long).toPandas().sort_values("rank")
    assert summary.importance.is_monotonic_decreasing and len(summary) == 3
    d = shap.shap_dependence(s, "id", top_n=2)
    assert d.points.count() == 2 * len(pdf) and d.line.select("feature").distinct().count() == 2
    assert "a" in {x.feature for x in d.turns.collect()}
    w = shap.sample_waterfall(s, "id", 10**6).toPandas().sort_values("step")
    last = df.agg(F.max("id")).first()[0]
    row = s.filter(F.col("id") == last).first()
    assert w.end.iloc[-1] == pytest.approx(row.base + sum(row["shap"].values()))
    line = spark.createDataFrame([("f", float(x), float(y)) for x, y in enumerate([-1, 0.5, 0.4, -4, -5])], "feature string, x double, smooth double")
    assert shap.turning_points(line).first().turn == pytest.approx(2 + 0.4 / 4.4)


def test_dependence_works_out_contributions_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    cell = F.udf(seen, "double")(F.col("id").cast("double"))
    df = spark.range(60).select("id", F.lit("y").alias("y_name"), F.lit(None).cast("string").alias("output"), F.create_map(F.lit("a"), cell).alias("shap"), F.create_map(F.lit("a"), F.col("id") * 2.0).alias("x"))
    assert shap.shap_dependence(df, "id", top_n=1).line.count() == 60
    assert read.value <= 60


def test_dependence_of_every_feature(spark):
    names = [f"f{j:02d}" for j in range(shap.MAX_DISPLAY + 2)]
    def cells(of):
        return F.create_map(*[x for j, n in enumerate(names) for x in (F.lit(n), of(j))])
    df = spark.range(40).select("id", F.lit("y").alias("y_name"), F.lit(None).cast("string").alias("output"),
                                cells(lambda j: F.sin(F.col("id") * (j + 1.0))).alias("shap"), cells(lambda j: F.col("id") + 0.5 * j).alias("x"))
    d = shap.shap_dependence(df, "id", top_n=None)
    assert {r.feature for r in d.line.select("feature").distinct().collect()} == set(names) == {r.feature for r in d.points.select("feature").distinct().collect()}


def test_dependence_query_covers_every_feature(spark):
    import __spark_entry__ as entry
    from tabspark.plans.catalog_models import FEATURES

    line = entry.queries()["shap_dependence"](spark, os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
    assert {r.feature for r in line.select("feature").distinct().collect()} == set(FEATURES)
