import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import folds, models, transforms as tr
from tabspark.operators.filters import common_filter, strip_units
from tabspark.plans import jobs
from tabspark.sources import runlog
from tabspark.streaming import apply as streams


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    n = 240
    pdf = pd.DataFrame({"id": np.arange(n), "a": rng.normal(size=n), "b": rng.random(n), "c": rng.choice(["u", "v"], n), "const": 1})
    pdf["y"] = 2 * pdf.a + (pdf.c == "v") + 0.05 * rng.normal(size=n)
    path = str(tmp_path_factory.mktemp("in") / "t.csv")
    pdf.to_csv(path, index=False)
    return pdf, path


def test_profile_and_eda(spark, parts):
    pdf, path = parts
    out = jobs.data_profile(spark, path)
    assert {"load_report", "profile", "histogram", "kde", "quartiles", "box_stats", "box_outliers"} == set(out)
    assert out["load_report"].first().dropped == ["const"] and out["profile"].count() == 5
    assert "profile" not in jobs.data_profile(spark, path, skip=["profile", "distribution", "box"])
    e = jobs.eda(spark, path, "y")
    assert set(e) == {"effect_size", "correlation", "trend", "trend_lines", "effect"}
    t = jobs.eda(spark, path, "c")
    assert set(t) == {"correlation", "separation"}
    info = jobs.infer_task_type(spark, path, "y")
    assert (info["task"], info["subtask"]) == ("regression", "regression")


def test_modeling_to_search(spark, parts, tmp_path):
    pdf, path = parts
    out = jobs.modeling(
        spark, path, "y", "id", [models.random_forest(n_estimators=6, max_features="all"), models.gbt(n_estimators=5)],
        clean=[lambda d: common_filter(d, drop="const")], make_folds=lambda d: folds.k_fold(d, "id", 2),
        transforms=[lambda d, y: tr.standard_scaler(d, ["a", "b"])], out_dir=str(tmp_path), experiment="e1")
    assert out["predictions"].count() == 2 * len(pdf) and out["taylor"].count() == 2 and out["ranking"].count() == 2
    log = runlog.run_log(spark, f"{tmp_path}/runs")
    assert runlog.list_runs(log, "e1", "model", 1).count() == 1
    assert {r.module for r in runlog.finished_models(log, "e1").collect()} == {"RF", "XGB"}
    assert runlog.list_run_artifacts(spark, f"{tmp_path}/e1").filter("size_bytes > 0").count() > 0
    scored = jobs.predict(spark, path, f"{tmp_path}/models", runlog.finished_models(log, "e1").filter("module = 'RF'").first().run_id, "RF", out_dir=str(tmp_path / "p"))
    assert scored.count() == len(pdf) and "y_pred" in scored.columns
    ms = out["models"]["RF"]
    found = jobs.inverse_optimization(spark, path, ms, {"y": "maximize"}, columns={"c": __import__("tabspark.operators.search", fromlist=["Choice"]).Choice(["u"])}, n_trials=100)
    assert {r.c for r in found.select("c").distinct().collect()} == {"u"} and found.count() == 100
    table = spark.read.csv(path, header=True, inferSchema=True)
    ex = jobs.explanation(ms, folds.k_fold(table, "id", 2).test, "id")
    assert ex["shap"].count() == len(pdf) and ex["summary"].orderBy("rank").first().feature == "a"

    # the same ensemble and transforms on a stream of files
    src = str(tmp_path / "stream_in")
    table.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(table.schema).parquet(src)
    scaler = tr.standard_scaler(table, ["a"])
    ready = streams.transform_stream(stream.withColumn("w", F.concat(F.col("id"), F.lit(" kg"))), [lambda d: strip_units(d, {"w": "kg"})])
    q = streams.write_stream(streams.score_stream(ready, ms), str(tmp_path / "stream_out"), str(tmp_path / "ck"), available_now=True)
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "stream_out")).toPandas().set_index("id").sort_index()
    want = scored.toPandas().set_index("id").sort_index()
    assert np.allclose(got.y_pred, want.y_pred) and got["w(kg)"].tolist() == [float(i) for i in got.index]
    with pytest.raises(ValueError):
        streams.transform_stream(table, [scaler])


def test_classification_modeling(spark, parts):
    pdf, path = parts
    df = spark.read.csv(path, header=True, inferSchema=True).drop("y")
    out = jobs.modeling(spark, df, "c", "id", [models.random_forest(n_estimators=4)], make_folds=lambda d: folds.stratified_k_fold(d, "id", "c", 2))
    assert out["confusion"].agg(F.sum("n")).first()[0] == len(pdf) and "taylor" not in out
