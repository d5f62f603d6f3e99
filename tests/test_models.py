import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import folds, metrics, models, search, training, transforms as tr
from tabspark.operators.target import x_y, infer_task, subtask, task_evidence, TaskError
from tabspark.sources import runlog


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(9)
    n = 400
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.random(n) * 10, "c": rng.choice(list("uvw"), n)})
    pdf["y"] = 3 * pdf.a + pdf.c.map({"u": 0, "v": 4, "w": 8}) + 0.1 * rng.normal(size=n)
    pdf["label"] = np.where(pdf.y > 5, "hi", np.where(pdf.y > 2, "mid", "lo"))
    pdf["two"] = (pdf.y > 4).astype(int)
    df = spark.createDataFrame(pdf).persist()
    return pdf, df


STEPS = [
    lambda d, y: tr.standard_scaler(d, ["a", "b"]),
    lambda d, y: tr.interaction_creator(d, [["a", "b"]]),
    lambda d, y: tr.onehot_encoder(d, ["c"]),
]


def test_regression_cv_and_ensemble(data, tmp_path, spark):
    pdf, df = data
    table = x_y(df.select("id", "a", "b", "c", "y"), "y", keep="id")
    assert table.task == "regression"
    f = folds.k_fold(table.df, "id", 2)
    result = training.cross_validate(table, f, models.random_forest(n_estimators=10, max_depth=6, max_features="all"), STEPS, kinds=("train", "test"))
    m = result.metrics().toPandas()
    assert len(m) == 4 and (m[m.type == "test"].r2 > 0.8).all()
    assert result.predictions.filter("type = 'test'").count() == 400
    out = training.ensemble_predict(result.models, df).toPandas().sort_values("id")
    parts = [mm.score(df, "p").toPandas().sort_values("id").p.to_numpy() for mm in result.models]
    assert np.allclose(out.y_pred, np.mean(parts, axis=0)) and len(out) == 400
    for mm in result.models:
        models.save_model(mm, str(tmp_path), "run1")
    again = models.load_models(spark, str(tmp_path), "run1", "RF")
    assert [x.fold for x in again] == [0, 1]
    redo = training.ensemble_predict(again, df).toPandas().sort_values("id")
    assert np.allclose(redo.y_pred, out.y_pred)
    with pytest.raises(ValueError):
        models.load_models(spark, str(tmp_path), "run1", "NOPE")
    imp = training.feature_importance(result.models).toPandas()
    assert "a" in set(imp.feature)
    perm = training.permutation_importance(result.models[0], df, "id", n_repeats=2).toPandas().set_index("feature").importance
    assert perm["a"] > perm["b"] and perm["c"] > perm["b"]
    # a finished run is loaded, a missing one trained or left out
    logdir = str(tmp_path / "log")
    runlog.append_run(spark, logdir, "e", "model", "RF", run_id="run1")
    calls = []
    specs = [models.random_forest(), models.gbt()]
    got = training.reuse_or_train(runlog.run_log(spark, logdir), "e", specs, str(tmp_path), lambda s: calls.append(s.label) or [])
    assert calls == ["XGB"] and len(got["RF"]) == 2
    assert list(training.reuse_or_train(runlog.run_log(spark, logdir), "e", specs, str(tmp_path), None, prune_missing=True)) == ["RF"]


def test_every_transform_survives_saving(data, tmp_path, spark):
    pdf, df = data
    steps = [
        lambda d, y: tr.log_transformer(d, ["b"], handle_negative="clip"), lambda d, y: tr.power_transformer(d, ["a"], rounds=2),
        lambda d, y: tr.minmax_scaler(d, ["a"], clip=True), lambda d, y: tr.robust_scaler(d, ["a"]),
        lambda d, y: tr.interaction_creator(d, [["a", "b"]], "divide"), lambda d, y: tr.numerical_binner(d, ["b"], "custom", [0.5, 1.5]),
        lambda d, y: tr.target_encoder(d.withColumn("k", F.col("c")), y, "id", ["c"]),
        lambda d, y: tr.pca_reducer(d, ["a", "c"], 2),
    ]
    table = x_y(df.select("id", "a", "b", "c", "y"), "y", keep="id")
    f = folds.k_fold(table.df, "id", 2)
    r = training.cross_validate(table, f, models.gbt(n_estimators=3), steps)
    more = [lambda d, y: tr.ordinal_encoder(d, ["c"]), lambda d, y: tr.numerical_binner(d, ["a"], "2class")]
    h = training.cross_validate(table, f, models.gbt("lgbm", n_estimators=3), more)
    h2 = training.cross_validate(table, f, models.gbt("cat", n_estimators=3), [lambda d, y: tr.hash_encoder(d, ["c"], 4)])
    for res in (r, h, h2):
        m = res.models[1]
        back = models.load_model(spark, models.save_model(m, str(tmp_path), "x"))
        a, b = (v.score(df, "p").toPandas().sort_values("id").p for v in (m, back))
        assert np.allclose(a, b) and a.nunique() > 3


def test_classification(data):
    pdf, df = data
    table = x_y(df.select("id", "a", "b", "c", "label"), "label", keep="id")
    assert table.task == "classification" and subtask(df, "label", "classification") == "multiclass"
    f = folds.stratified_k_fold(table.df, "id", "label", 2)
    for spec in (models.random_forest(n_estimators=8), models.gbt(n_estimators=4), models.mlp(hidden=[8], epochs=60)):
        r = training.cross_validate(table, f, spec)
        m = r.metrics().toPandas()
        assert (m.accuracy > 0.6).all() and (m.auc_roc > 0.7).all() and m.log_loss.notna().all()
        p = r.predictions.select(F.aggregate(F.map_values("proba"), F.lit(0.0), lambda a, x: a + x).alias("s")).toPandas()
        assert np.allclose(p.s, 1)
    out = training.ensemble_predict(r.models, df).toPandas()
    assert (out.label_pred == pdf.set_index("id").loc[out.id, "label"].to_numpy()).mean() > 0.6
    reg = x_y(df.select("id", "a", "y"), "y", keep="id")
    assert training.cross_validate(reg, folds.k_fold(reg.df, "id", 2), models.mlp(hidden=[4], epochs=2)).predictions.count() == 400
    with pytest.raises(ValueError):
        models.mlp(layers=3)


def test_loss_curve(data):
    pdf, df = data
    table = x_y(df.select("id", "a", "b", "c", "y"), "y", task="regression", keep="id")
    f = folds.simple_cv(table.df, "id", 0.6, 0.2)
    r = training.cross_validate(table, f, models.gbt(n_estimators=5), kinds=("train", "val", "test"))
    curve = training.loss_curve(r, f).toPandas()
    assert set(curve.type) == {"train", "val"}
    train = curve[curve.type == "train"].sort_values("iteration").loss.to_numpy()
    assert train[-1] < train[0]
    assert training.mean_loss(training.loss_curve(r, f)).count() == len(curve)
    assert training.loss_curve(training.cross_validate(table, f, models.random_forest(n_estimators=2)), f) is None


def test_loss_curve_shows_the_rounds_after_the_best_one(spark):
    """Nothing to learn: validation is best early, and the curve goes on to the last round."""
    noise = spark.range(400).select("id", (F.xxhash64("id") % 1000 / 1000).alias("a"), (F.xxhash64("id", F.lit(7)) % 1000 / 1000).alias("y"))
    table = x_y(noise, "y", task="regression", keep="id")
    f = folds.simple_cv(table.df, "id", 0.6, 0.2)
    r = training.cross_validate(table, f, models.gbt(n_estimators=6, learning_rate=1.0))
    curve = training.loss_curve(r, f).toPandas()
    assert len(r.models[0].model.rounds) < 6
    for kind in ("train", "val"):
        assert sorted(curve[curve.type == kind].iteration) == list(range(6))
    assert training.loss_curve(r, f, ("test",)).count() == len(r.models[0].model.rounds)


def test_tune_prefers_deeper_trees(data):
    pdf, df = data
    table = x_y(df.select("id", "a", "b", "c", "y"), "y", task="regression", keep="id")
    f = folds.simple_cv(table.df, "id")
    t = training.tune(table, f, models.random_forest(n_estimators=4, max_features="all"), {"max_depth": search.Choice([1, 7])}, n_trials=4)
    assert t.best.params["max_depth"] == 7 and t.trials.count() == 4


def test_inverse_search(data):
    pdf, df = data
    table = x_y(df.select("id", "a", "b", "c", "y", "two"), ["y"], task="regression", keep=["id", "two"])
    f = folds.k_fold(table.df, "id", 2)
    ms = training.cross_validate(table, f, models.random_forest(n_estimators=6, max_features="all")).models
    space = search.infer_space(df, ["a", "b", "c"])
    assert space["c"].values == ("u", "v", "w")
    out = search.inverse_search(ms, space, {"y": "maximize"}, rule=lambda p: p["b"] < 5, n_trials=400).toPandas()
    assert out.b.max() < 5 and out.sort_values("rank").y.is_monotonic_decreasing
    assert out.sort_values("rank").iloc[0].c == "w" and out.y.max() > pdf.y.quantile(0.9)
    same = search.inverse_search(ms, space, {"y": "maximize"}, rule=F.col("b") < 5, n_trials=400).toPandas()
    assert sorted(same.id) == sorted(out.id)
    for bad in ({"nope": "maximize"}, {"y": "up"}):
        with pytest.raises(ValueError):
            search.inverse_search(ms, space, bad)
    with pytest.raises(ValueError):
        search.inverse_search(ms, {"a": space["a"]}, {"y": "maximize"})


def test_pareto_flag_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"id": range(300), "p": rng.random(300).round(2), "q": rng.random(300).round(2)})
    got = search.with_pareto_flag(spark.createDataFrame(pdf).repartition(9), {"p": "maximize", "q": "minimize"}).toPandas().sort_values("id")
    c = np.c_[-pdf.p, pdf.q]
    beaten = [(np.all(c <= r, axis=1) & np.any(c < r, axis=1)).any() for r in c]
    assert got.pareto.tolist() == [not b for b in beaten]


def test_sampling_is_reproducible(spark):
    space = {"i": search.Range(1, 9, 2), "f": search.Range(0.0, 1.0), "l": search.Range(1e-3, 10.0, "log"), "c": search.Choice(["a", "b"])}
    one = search.sample_candidates(spark, space, 500, 1).toPandas().sort_values("id").reset_index(drop=True)
    two = search.sample_candidates(spark, space, 500, 1).repartition(3).toPandas().sort_values("id").reset_index(drop=True)
    assert one.equals(two) and set(one.i) == {1, 3, 5, 7, 9} and one.l.between(1e-3, 10).all() and set(one.c) == {"a", "b"}


def test_task_inference(spark):
    df = spark.createDataFrame([(i, float(i) / 3, i % 20, "t", 7 * (i % 20)) for i in range(100)], "id int, r double, k int, s string, seven int")
    got = {r.y_name: r.task for r in task_evidence(df, ["r", "k", "s", "seven"]).collect()}
    assert got == {"r": "regression", "k": "classification", "s": "classification", "seven": "regression"}
    with pytest.raises(TaskError):
        infer_task(df, ["r", "s"])
    assert subtask(df, ["r", "k"], "regression") == "multi-regression"
    with pytest.raises(TaskError):
        subtask(df, ["k", "s"], "classification", boosted=True)


def test_forest_cuts_inside_a_thirtieth_of_the_rows(spark):
    """A pulse of 32 among 4,000 rows: a quarter of one of 32 quantile bins."""
    df = spark.range(4000).select("id", F.col("id").cast("double").alias("x"), F.col("id").between(2000, 2031).cast("double").alias("y"))
    table = x_y(df, "y", task="regression", keep="id")
    model = training.cross_validate(table, folds.k_fold(table.df, "id", 2), models.random_forest(n_estimators=4, max_features="all")).models[0]
    got = model.score(df, "p").agg(F.avg(F.when(F.col("id").between(2008, 2023), F.col("p"))).alias("inside"), F.avg(F.when(F.col("id").between(2050, 2100), F.col("p"))).alias("beside")).first()
    assert got.inside > 0.75 and got.beside < 0.1
