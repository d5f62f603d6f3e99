import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import diagnose, metrics
from tabspark.functions import order_stats


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(3)
    n = 600
    y = rng.normal(size=n)
    parts = [pd.DataFrame({"model": m, "fold": np.arange(n) % 3, "type": "test", "y_name": "t", "y": y, "y_pred": y + s * rng.normal(size=n)}) for m, s in (("A", .1), ("B", .5))]
    pdf = pd.concat(parts)
    return pdf, spark.createDataFrame(pdf)


def test_regression(regression):
    pdf, df = regression
    got = metrics.regression_metrics(df).toPandas()
    assert len(got) == 6
    for r in got.itertuples():
        p = pdf[(pdf.model == r.model) & (pdf.fold == r.fold)]
        e = p.y_pred - p.y
        assert r.mae == pytest.approx(e.abs().mean()) and r.rmse == pytest.approx(math.sqrt((e ** 2).mean()))
        assert r.r2 == pytest.approx(1 - (e ** 2).sum() / ((p.y - p.y.mean()) ** 2).sum())
        assert r.mape == pytest.approx((e.abs() / p.y.abs()).mean())
    long = metrics.metrics_long(metrics.regression_metrics(df))
    best = metrics.overall_metric(long).toPandas().set_index("model").value
    assert best["A"] < best["B"]
    with pytest.raises(ValueError):
        metrics.overall_metric(long, "mae", "nope")


def brute_auc(y, s):
    pos, neg = s[y], s[~y]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("small", [0, 10**9])
def test_classification(spark, small, monkeypatch):
    monkeypatch.setattr(order_stats, "SMALL_CELLS", small)
    rng = np.random.default_rng(7)
    n, labels = 300, ["a", "b", "c"]
    p = rng.dirichlet([1, 1, 1], n).round(2)
    p[:, 0] = 1 - p[:, 1] - p[:, 2]
    y = np.array([rng.choice(labels, p=np.clip(r, 0, None) / np.clip(r, 0, None).sum()) for r in p])
    pred = np.array(labels)[p.argmax(1)]
    rows = [("m", 0, "test", "t", yy, pp, dict(zip(labels, map(float, np.clip(r, 0, None))))) for yy, pp, r in zip(y, pred, p)]
    df = spark.createDataFrame(rows, "model string, fold int, type string, y_name string, y string, y_pred string, proba map<string,double>")
    got = metrics.classification_metrics(df).first()
    assert got.accuracy == pytest.approx((y == pred).mean())
    f1 = prec = 0.0
    for c in labels:
        tp, sup, prd = ((y == c) & (pred == c)).sum(), (y == c).sum(), (pred == c).sum()
        prec += sup * (tp / prd if prd else 0) / n
        f1 += sup * (2 * tp / (sup + prd) if sup + prd else 0) / n
    assert got.precision == pytest.approx(prec) and got.f1 == pytest.approx(f1) and got.recall == pytest.approx(got.accuracy)
    q = np.clip(p, 0, None)
    auc = sum((y == c).mean() * brute_auc(y == c, q[:, i]) for i, c in enumerate(labels))
    assert got.auc_roc == pytest.approx(auc)
    own = np.clip((q / q.sum(1, keepdims=True))[np.arange(n), [labels.index(v) for v in y]], metrics.EPS, 1)
    assert got.log_loss == pytest.approx(-np.log(own).mean())
    binary = df.select("model", "fold", "type", "y_name", (F.col("y") == "a").cast("int").alias("y"), (F.col("y_pred") == "a").cast("int").alias("y_pred"),
                       F.create_map(F.lit("0"), 1 - F.col("proba")["a"], F.lit("1"), F.col("proba")["a"]).alias("proba"))
    assert metrics.classification_metrics(binary).first().auc_roc == pytest.approx(brute_auc(y == "a", q[:, 0]))


def test_diagnosis(regression):
    pdf, df = regression
    one = df.filter("model = 'A'")
    e = (pdf[pdf.model == "A"].y_pred - pdf[pdf.model == "A"].y).to_numpy()
    got = diagnose.error_distribution(one).first()
    z = (e - e.mean()) / e.std()
    assert got.std == pytest.approx(e.std()) and got.skew == pytest.approx((z ** 3).mean()) and got.kurtosis == pytest.approx((z ** 4).mean())
    assert got.median == pytest.approx(np.median(e))
    assert got.outliers == ((e < got.whisker_low) | (e > got.whisker_high)).sum()
    qq = diagnose.qq_points(one).toPandas().sort_values("sample")
    assert len(qq) == 600 and np.corrcoef(qq["sample"], qq["theoretical"])[0, 1] > 0.99
    assert diagnose.residual_trend(one).count() == 600
    assert diagnose.residual_densities(one).count() == 400
    taylor = diagnose.taylor_stats(df).toPandas().set_index("model")
    assert taylor.loc["A", "rank"] == 1 and taylor.loc["B", "total_rank"] == 2
    a = pdf[pdf.model == "A"]
    assert taylor.loc["A", "correlation"] == pytest.approx(a.y.corr(a.y_pred))
    assert taylor.loc["A", "rmse_norm"] ** 2 + taylor.loc["A", "bias_norm"] ** 2 == pytest.approx(taylor.loc["A", "rmse_total_norm"] ** 2, rel=1e-2)
    with pytest.raises(ValueError):
        diagnose.taylor_stats(one)
    scatter = diagnose.prediction_scatter_stats(df).toPandas()
    assert len(scatter) == 2
    with pytest.raises(ValueError):
        diagnose.predictions_long({"A": one, "B": df.filter("model = 'B' and fold = 0")})
