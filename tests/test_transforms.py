import numpy as np
import pandas as pd
import pytest

from tabspark.operators import transforms as tr


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.lognormal(size=n), "b": rng.normal(size=n), "c": rng.choice(["x", "y", "z"], n, p=[.6, .3, .1])})
    pdf["y"] = pdf.c.map({"x": 0.0, "y": 5.0, "z": 9.0}) + rng.normal(size=n)
    return pdf, spark.createDataFrame(pdf)


def column(t, df, name):
    return t.apply(df).toPandas().sort_values("id")[name].to_numpy()


def test_scalers(frame):
    pdf, df = frame
    s = column(tr.standard_scaler(df, ["a"]), df, "a")
    assert s.mean() == pytest.approx(0, abs=1e-9) and s.std() == pytest.approx(1)
    m = column(tr.minmax_scaler(df, ["b"], (-1, 2)), df, "b")
    assert (m.min(), m.max()) == (pytest.approx(-1), pytest.approx(2))
    half = df.filter("b < 0")
    assert column(tr.minmax_scaler(half, ["b"], clip=True), df, "b").max() == 1.0
    q = pdf.a.quantile([0.25, 0.5, 0.75]).tolist()
    assert np.allclose(column(tr.robust_scaler(df, ["a"]), df, "a"), (pdf.a - q[1]) / (q[2] - q[0]))


def test_log(frame, spark):
    pdf, df = frame
    assert np.allclose(column(tr.log_transformer(df, ["a"], "2"), df, "a"), np.log2(pdf.a))
    small = spark.createDataFrame([(1, -1.0), (2, 0.0), (3, 1.0)], "id int, v double")
    assert np.allclose(column(tr.log_transformer(small, ["v"], handle_negative="shift"), small, "v"), np.log([1, 2, 3]))
    assert column(tr.log_transformer(small, ["v"], handle_negative="clip"), small, "v").tolist() == [-np.inf, -np.inf, 0.0]
    with pytest.raises(Exception, match="not positive"):
        tr.log_transformer(small, ["v"]).apply(small).collect()


def llf(x, lam):
    y = np.where(x >= 0, np.log1p(np.abs(x)) if lam == 0 else ((np.abs(x) + 1) ** lam - 1) / lam,
                 -((np.abs(x) + 1) ** (2 - lam) - 1) / (2 - lam) if lam != 2 else -np.log1p(np.abs(x)))
    return -len(x) / 2 * np.log(y.var()) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def test_power(frame, spark):
    pdf, df = frame
    t = tr.power_transformer(df, ["a", "b"])
    for c in ("a", "b"):
        lam = t.params["lambda"][c]
        fine = np.linspace(-3, 4, 7001)
        best = fine[np.argmax([llf(pdf[c].to_numpy(), v) for v in fine])]
        assert lam == pytest.approx(best, abs=2e-3)
        out = column(t, df, c)
        assert out.mean() == pytest.approx(0, abs=1e-9) and out.std() == pytest.approx(1)
    box = tr.power_transformer(df, ["a"], "box-cox")
    assert abs(box.params["lambda"]["a"]) < 0.2
    with pytest.raises(ValueError):
        tr.power_transformer(df, ["b"], "box-cox")


def test_binner(frame, spark):
    pdf, df = frame
    small = spark.createDataFrame([(1, -5.0), (2, 5.0), (3, 5.1), (4, None)], "id int, v double")
    assert [r.v for r in tr.numerical_binner(small, ["v"]).apply(small).orderBy("id").collect()] == [0, 1, 2, None]
    want = pd.cut(pdf.b, [-np.inf, *pdf.b.quantile([.25, .5, .75]), np.inf], labels=False)
    assert column(tr.numerical_binner(df, ["b"], "4class"), df, "b").tolist() == want.tolist()
    y = pdf.y.quantile([.25, .5, .75]).tolist()
    assert tr.numerical_binner(df, ["b"], "4class", target="y").params["edges"] == pytest.approx(y)
    with pytest.raises(ValueError):
        tr.numerical_binner(df, ["b"], "custom")


def test_pca(frame, spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2)) @ np.array([[2.0, 1.0, 0.5], [0.0, 0.3, -1.0]]) + 5
    pdf = pd.DataFrame(x, columns=list("uvw")).assign(id=range(300))
    df = spark.createDataFrame(pdf)
    t = tr.pca_reducer(df, ["u", "v", "w"])
    out = t.apply(df).toPandas().sort_values("id")
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    assert t.params["variance"] == pytest.approx((s[:2] ** 2 / 299).tolist())
    assert out[["pca0", "pca1"]].var().tolist() == pytest.approx(t.params["variance"]) and "u" not in out


def test_interactions(spark):
    df = spark.createDataFrame([(1, 4.0, 2.0), (2, 1.0, 0.0), (3, -1.0, 0.0), (4, 0.0, 0.0), (5, None, 2.0)], "id int, a double, b double")
    get = lambda **k: [r[-1] for r in tr.interaction_creator(df, [["a", "b"]], **k).apply(df).orderBy("id").collect()]
    assert get() == [8.0, 0.0, -0.0, 0.0, None]
    assert get(interaction_type="divide") == [2.0, np.inf, -np.inf, None, None]
    assert get(interaction_type="divide", handle_zero_division="nan") == [2.0, None, None, None, None]
    big = np.finfo(float).max
    assert get(interaction_type="divide", handle_zero_division="clip", handle_missing="fill") == [2.0, big, -big, 0.0, 0.0]
    assert tr.interaction_creator(df, [["a", "b"]], "add").apply(df).columns[-1] == "a_plus_b"
    with pytest.raises(ValueError):
        tr.interaction_creator(df, [["a"]])


def test_encoders(frame, spark):
    pdf, df = frame
    one = tr.onehot_encoder(df, ["c"]).apply(df).toPandas().sort_values("id")
    assert (one[["c_x", "c_y", "c_z"]].to_numpy() == pd.get_dummies(pdf.c).to_numpy()).all()
    new = spark.createDataFrame([(1, "q"), (2, None), (3, "y")], "id int, c string")
    assert [tuple(r)[1:] for r in tr.onehot_encoder(df, ["c"]).apply(new).orderBy("id").collect()] == [(0, 0, 0), (0, 0, 0), (0, 1, 0)]
    with pytest.raises(Exception, match="unknown category"):
        tr.onehot_encoder(df, ["c"], handle_unknown="error").apply(new).collect()
    assert "c_x" not in tr.onehot_encoder(df, ["c"], drop_first=True).apply(df).columns
    assert [r.c for r in tr.label_encoder(df, ["c"]).apply(new).orderBy("id").collect()] == [-1, -1, 1]
    assert column(tr.ordinal_encoder(df, ["c"]), df, "c").tolist() == pdf.c.map({"x": 0, "y": 1, "z": 2}).tolist()
    h = tr.hash_encoder(df, ["c"], 4).apply(df).toPandas()
    assert (h[[f"hash{i}" for i in range(4)]].sum(axis=1) == 1).all()


def test_target_encoder(frame, spark):
    pdf, df = frame
    t = tr.target_encoder(df, "y", "id", ["c"])
    new = spark.createDataFrame([(1, "x"), (2, "unseen")], "id int, c string")
    got = [r.c for r in t.apply(new).orderBy("id").collect()]
    part = pdf[pdf.c == "x"].y
    lam = pdf.y.var(ddof=0) * len(part) / (pdf.y.var(ddof=0) * len(part) + part.var(ddof=0))
    assert got[0] == pytest.approx(lam * part.mean() + (1 - lam) * pdf.y.mean())
    assert got[1] == pytest.approx(pdf.y.mean())
    # training rows: refit without the row's inner fold
    inner = df.select("id", tr._inner_fold(["id"], 42).alias("f")).toPandas().set_index("id").f
    rest = pdf[pdf.id.map(inner) != inner[0]]
    part = rest[rest.c == pdf.c[0]].y
    lam = rest.y.var(ddof=0) * len(part) / (rest.y.var(ddof=0) * len(part) + part.var(ddof=0))
    value = t.fit_apply(df).filter("id = 0").first().c
    assert value == pytest.approx(lam * part.mean() + (1 - lam) * rest.y.mean())
    m = tr.target_encoder(df, "y", "id", ["c"], smooth=10.0).apply(new).orderBy("id").first().c
    assert m == pytest.approx((pdf[pdf.c == "x"].y.sum() + 10 * pdf.y.mean()) / ((pdf.c == "x").sum() + 10))


def test_chain_fits_on_training_rows_only(frame):
    pdf, df = frame
    train = df.filter("id < 200")
    chain, out = tr.fit_chain(train, [lambda d: tr.standard_scaler(d, ["a"]), lambda d: tr.onehot_encoder(d, ["c"])])
    assert out.toPandas().a.mean() == pytest.approx(0, abs=1e-9)
    assert abs(chain.apply(df).toPandas().a.mean()) > 1e-6
