import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import correlation, effects
from tabspark.operators.profile import profile


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    n = 700
    x = np.where(rng.random(n) < 0.35, 4.0, rng.normal(size=n).round(1))
    pdf = pd.DataFrame({"x": x, "y": x + rng.normal(size=n), "z": rng.integers(0, 6, n).astype(float), "c": 1.0})
    pdf.loc[::9, "y"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None)))
    return pdf, df


def brute_tau_b(x, y):
    dx, dy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    return (dx * dy).sum() / math.sqrt((dx != 0).sum() * (dy != 0).sum())


@pytest.mark.parametrize("blocks", [1, 2, 7])
def test_kendall_matches_all_pairs(frame, blocks):
    pdf, df = frame
    pairs = [("x", "y"), ("x", "z"), ("y", "z")]
    got = correlation._kendall(df, pairs, len(pdf), blocks=blocks)
    for a, b in pairs:
        ok = pdf[[a, b]].dropna().to_numpy()
        n, tau, p = got[a, b]
        assert n == len(ok)
        assert tau == pytest.approx(brute_tau_b(ok[:, 0], ok[:, 1]), rel=1e-12)
        assert 0 <= p <= 1


def test_pearson_and_spearman_match_pandas(frame):
    pdf, df = frame
    for method in ("pearson", "spearman"):
        got = {(r.col_a, r.col_b): r for r in correlation.correlation_long(df, ["x", "y", "z", "c"], method).collect()}
        assert set(got) == {("x", "y"), ("x", "z"), ("y", "z")}
        want = pdf.corr(method=method)
        for (a, b), r in got.items():
            assert r.r == pytest.approx(want.loc[a, b], rel=1e-9)
            assert r.n == len(pdf[[a, b]].dropna())


def test_spearman_paths_agree(frame):
    pdf, df = frame
    want = pdf[["x", "z"]].corr(method="spearman").iloc[0, 1]
    for kw in ({}, {"small": 0, "broadcast_rows": 0}):
        assert correlation._spearman_by_column(df, ["x", "z"], [("x", "z")], len(pdf), **kw)["x", "z"][1] == pytest.approx(want)
        assert correlation._spearman_by_pair(df, [("x", "z")], len(pdf), **kw)["x", "z"][1] == pytest.approx(want)


def test_ranks_of_few_values_are_looked_up_in_one_pass(spark, monkeypatch):
    """Ties, signed zeros and NaN; no join of the rows."""
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.integers(-3, 4, 500) * 0.5, "b": rng.normal(size=500), "c": rng.integers(0, 3, 500)})
    pdf.loc[::7, "a"] = -0.0
    pdf["b"] = pdf.b + pdf.a
    df = spark.createDataFrame(pdf).repartition(4).withColumn("b", F.when(F.col("b") > 1.5, float("nan")).otherwise(F.col("b")))
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    joined = correlation._spearman_by_column(df, ["a", "b", "c"], pairs, 500, small=0, broadcast_rows=0)
    monkeypatch.setattr(correlation, "lookup", lambda *_, **__: pytest.fail("a join"))
    near = correlation._spearman_by_column(df, ["a", "b", "c"], pairs, 500)
    want = pdf.assign(b=pdf.b.where(pdf.b <= 1.5, np.inf)).rank().corr()
    for pair in pairs:
        assert near[pair][0] == 500 and near[pair][1] == pytest.approx(joined[pair][1], rel=1e-12) == pytest.approx(want.loc[pair], rel=1e-12)


def test_block_products_equal_jvm_sums(frame):
    pdf, df = frame
    pairs = [("x", "y"), ("x", "z"), ("y", "z")]
    means = pdf.mean().to_dict()
    a = correlation._pearson(df, ["x", "y", "z"], pairs, means)
    b = correlation._pearson_blocks(df, ["x", "y", "z"], pairs, means)
    for k in pairs:
        assert a[k][0] == b[k][0] and a[k][1] == pytest.approx(b[k][1], rel=1e-10)


def test_matrix_and_pairs(frame):
    _, df = frame
    rows = correlation.correlation_matrix(df, ["x", "y", "z"], "pearson", targets="x").collect()
    assert len(rows) == 9 and max(rows, key=lambda r: r.at_a).feature_a == "x"
    assert all(r.r == 1.0 and r.p == 0.0 for r in rows if r.feature_a == r.feature_b)
    near = df.select("x", (F.col("x") * 2 + 0.01 * F.col("z")).alias("x2"), "z")
    pairs = correlation.high_correlation_pairs(near, method="pearson").collect()
    assert [(r.col_a, r.col_b) for r in pairs] == [("x", "x2")]


def test_few_rows_give_zero(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    row = correlation.correlation_long(df, method="pearson").first()
    assert (row.r, row.p) == (0.0, 1.0)


def test_effect_size_numeric(spark):
    pdf = pd.DataFrame({
        "yield_y": [1.0, 1.2, 1.1, 5.0, 5.2, 5.1], "score": [3.0, 3.1, 2.9, 9.0, 9.1, 8.9],
        "grade": list("aaabbb"), "machine": ["m1", "m2"] * 3,
    })
    out = effects.effect_size(spark.createDataFrame(pdf), ["yield_y", "score"], ["grade", "machine"]).toPandas()
    assert len(out) == 8
    grade = out[(out.target == "yield_y") & (out.categorical_col == "grade")]
    assert grade.eta_sq.between(0.9, 1).all() and (grade.cohens_d < -2).all()
    assert (grade.p_value < 0.001).all() and len(effects.top_effects(spark.createDataFrame(out)).collect()) == 3


def test_effect_size_text_uses_the_correction_on_two_by_two(spark):
    rows = [("a", "u")] * 12 + [("a", "v")] * 5 + [("b", "u")] * 4 + [("b", "v")] * 9
    out = effects.effect_size(spark.createDataFrame(rows, "g string, y string"), "y", "g").toPandas()
    o = np.array([[12, 5], [4, 9]], float)
    e = o.sum(1, keepdims=True) * o.sum(0) / o.sum()
    chi2 = ((np.abs(o - e) - 0.5) ** 2 / e).sum()
    assert out.chi2.iloc[0] == pytest.approx(chi2, abs=1e-4)
    assert out.p_value.iloc[0] == pytest.approx(math.erfc(math.sqrt(chi2 / 2)), abs=1e-6)


def test_profile_columns(spark):
    pdf = pd.DataFrame({"uid": list("abcd"), "code": [1, 2, 3, 4], "measure": [0.1, 0.2, 0.3, 0.5], "cat": ["x", "x", "y", None]})
    out = profile(spark.createDataFrame(pdf)).toPandas().set_index("name")
    assert out.is_id.to_dict() == {"uid": True, "code": True, "measure": False, "cat": False}
    assert out.loc["cat", "missing"] == "1 (25.0%)" and out.loc["cat", "top_10"] == {"x": 0.5, "y": 0.25}
    assert out.loc["measure", "skew"] == pytest.approx(pdf.measure.skew(), abs=1e-4)
    assert out.loc["measure", "kurt"] == pytest.approx(pdf.measure.kurt(), abs=1e-4)
    assert out.loc["code", "q25"] == pdf.code.quantile(0.25)
