"""Networks: gradients against finite differences, one block against plain mini-batch descent, heads, early stop."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import folds, models, perceptron, training
from tabspark.operators.perceptron import Head, Network, Settings
from tabspark.operators.target import x_y


@pytest.mark.parametrize("activation", perceptron.ACTIVATIONS)
def test_gradients_equal_finite_differences(activation):
    rng = np.random.default_rng(3)
    net = Network(4, [Head("squared", 1), Head("logistic", 1), Head("softmax", 3)], [5, 3], activation)
    w, x = rng.normal(size=net.length), rng.normal(size=(7, 4))
    y = np.stack([rng.normal(size=7), rng.integers(0, 2, 7), rng.integers(0, 3, 7)], axis=1)
    loss, g = net.gradient(w, x, y)
    assert loss == pytest.approx(net.loss(net.outputs(w, x), y)[0].mean())
    for i in rng.choice(net.length, 25, replace=False):
        e = np.zeros(net.length)
        e[i] = 1e-6
        assert g[i] == pytest.approx((net.gradient(w + e, x, y)[0] - net.gradient(w - e, x, y)[0]) / 2e-6, abs=1e-5)
    a, b = (net.gradient(w, x, y, 0.5, np.random.default_rng(k))[1] for k in (1, 2))
    assert not np.allclose(a, b)  # other units dropped


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(500, 3)), columns=list("abc"))
    pdf["y"] = 100 + 10 * (pdf.a * 2 - pdf.b + np.abs(pdf.c))
    pdf["k"] = (pdf.a > 0).astype(int) + (pdf.b > 0.5).astype(int)
    pdf["id"] = np.arange(500)
    return pdf, spark.createDataFrame(pdf).repartition(4).persist()


def test_several_heads_and_seed(rows):
    pdf, df = rows
    heads = {"y": Head("squared", 1), "k": Head("softmax", 3)}
    s = Settings((16,), dropout=0.0, epochs=12, weight_decay=0.0)
    model = perceptron.fit(df, list("abc"), heads, s)
    out = perceptron.outputs_of(model.facts, pdf[list("abc")].to_numpy())
    assert out.shape == (500, 4)
    assert ((out[:, 0] - pdf.y) ** 2).mean() < 0.15 * pdf.y.var() and (out[:, 1:].argmax(1) == pdf.k).mean() > 0.85
    again = perceptron.fit(df.repartition(7), list("abc"), heads, s)  # the order of rows in the input does not matter
    assert np.allclose(again.facts["weights"], model.facts["weights"])
    with pytest.raises(ValueError):
        Settings(activation="step")


def test_early_stop_keeps_the_best_epoch(rows, spark):
    rng = np.random.default_rng(5)
    noise = spark.createDataFrame(pd.DataFrame({"a": rng.random(80), "b": rng.random(80), "y": rng.normal(size=80)}))
    s = Settings((32,), dropout=0.0, learning_rate=0.05, epochs=30, early_stopping_rounds=3, weight_decay=0.0)
    model = perceptron.fit(noise.limit(40), ["a", "b"], {"y": Head("squared", 1)}, s, noise)
    assert len(model.losses) <= 30 and model.losses[0][1] is not None
    wild = perceptron.fit(noise.where("a < 0.5"), ["a", "b"], {"y": Head("squared", 1)}, s, noise.where("a >= 0.5"))
    held = [v for _, v in wild.losses if v is not None]
    assert len(held) < 30 and held[-4] == min(held)


def test_averaging_over_blocks(rows, spark, monkeypatch):
    pdf, df = rows
    monkeypatch.setattr(perceptron, "BLOCK_ROWS", 100)
    model = perceptron.fit(df, list("abc"), {"y": Head("squared", 1)}, Settings((16,), dropout=0.0, epochs=12, weight_decay=0.0))
    out = perceptron.outputs_of(model.facts, pdf[list("abc")].to_numpy())
    assert ((out[:, 0] - pdf.y) ** 2).mean() < 0.3 * pdf.y.var()


def test_regression_cross_validation(rows, spark, tmp_path):
    pdf, df = rows
    t = x_y(df.select("id", "a", "b", "c", "y"), "y", keep="id")
    f = folds.k_fold(t.df, "id", 2)
    result = training.cross_validate(t, f, models.mlp(hidden=[16], epochs=15, dropout=0.0))
    assert (result.metrics().toPandas().r2 > 0.8).all()
    curve = training.loss_curve(result, f).toPandas()
    assert len(curve) == 30 and set(curve.type) == {"train"}
    path = models.save_model(result.models[0], str(tmp_path), "r")
    a, b = (m.score(f.test(0), "p").orderBy("id").toPandas().p for m in (result.models[0], models.load_model(spark, path)))
    assert np.allclose(a, b)
