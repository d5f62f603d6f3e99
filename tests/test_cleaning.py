import gzip
import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import filters, missing, outliers
from tabspark.sources import readers, runlog


def frame(spark, pdf):
    from tabspark.columns import nan_to_null
    return nan_to_null(spark.createDataFrame(pdf))


def test_readers(spark, tmp_path):
    p = str(tmp_path / "a.csv")
    pd.DataFrame({"col1": [1, 2], "col2": [3, 4]}).to_csv(p, index=False, sep=";")
    assert readers.load_csv(spark, p, ";").columns == ["col1", "col2"]
    q = str(tmp_path / "a.parquet")
    pd.DataFrame({"x": [1.0, np.nan], "y": [1, 2]}).to_parquet(q)
    assert readers.load_file(spark, q, columns="x").filter("x IS NULL").count() == 1
    plan = readers.load_parquet(spark, q, "x", where="y > 1")._jdf.queryExecution().toString()
    assert "GreaterThan(y,1)" in plan
    with pytest.raises(ValueError, match=".parquet"):
        readers.load_file(spark, "x.xyz")
    with pytest.raises(TypeError):
        readers.custom_load(spark, lambda s: 1)
    with pytest.raises(TypeError):
        readers.custom_clean(spark.range(1), lambda d: None)
    row = readers.content_hash(spark, p, "md5").first()
    assert row.hash == hashlib.md5(open(p, "rb").read()).hexdigest() and row.size_bytes == len(open(p, "rb").read())
    with pytest.raises(ValueError):
        readers.content_hash(spark, p, "crc")


def test_content_hash_of_files_that_are_not_held_as_one_value(spark, tmp_path):
    noise = np.random.default_rng(3).integers(0, 256, 40_000, np.uint8).tobytes()
    mark = b"\xef\xbb\xbf"
    files = {"a": noise, "b": noise + b"\n", "c": mark + noise, "d": mark + b"\n" + noise + b"\n", "e": b"\n" * 5000, "f": b"x" * 5000, "g [1]*": b"\r\n" * 3000 + b"\r", "h": b"small", "i": mark * 2 + b"\n\n" + noise}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "j.gz").write_bytes(gzip.compress(noise))
    files["j.gz"] = (tmp_path / "j.gz").read_bytes()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
    try:
        for algorithm in ("sha256", "sha1"):
            got = {r.path.rsplit("/", 1)[1]: (r.hash, r.size_bytes) for r in readers.content_hash(spark, str(tmp_path), algorithm, whole_bytes=100).collect()}
            assert got == {name: (hashlib.new(algorithm, data).hexdigest(), len(data)) for name, data in files.items()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("algorithm", ["sha256", "md5"])
def test_content_hash_of_other_file_systems(spark, tmp_path, monkeypatch, algorithm):
    monkeypatch.setattr(readers, "LOCAL", "none:/")
    files = {"a": b"\xef\xbb\xbf" + b"x\n" * 400, "b c": b"small", "d.gz": gzip.compress(bytes(range(256)) * 9)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.hash, r.size_bytes) for r in readers.content_hash(spark, str(tmp_path), algorithm, whole_bytes=100).collect()}
    assert got == {name: (hashlib.new(algorithm, data).hexdigest(), len(data)) for name, data in files.items()}


def test_content_hash_holds_pieces_of_local_files(spark, tmp_path, monkeypatch):
    """No column of contents, whatever the size of a file."""
    monkeypatch.setattr(readers, "PIECE", 1000)
    files = {"a b": bytes(range(256)) * 1000, "[c]*": b"z", "d%20": b"x" * 1000, "e.gz": gzip.compress(b"y" * 5000)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    found = readers.content_hash(spark, str(tmp_path))
    assert "content:binary" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r.path.rsplit("/", 1)[1]: (r.hash, r.size_bytes) for r in found.collect()} == {name: (hashlib.sha256(data).hexdigest(), len(data)) for name, data in files.items()}


def test_json_documents(spark, tmp_path):
    docs = ['[{"a":1,"b":"x"},{"a":2}]', '{"data":[{"a":3}],"results":[{"a":9}]}', '{"items":[{"a":4}]}', '{"a":5,"b":"[z"}', '{"data":"no list","rows":[{"a":6}]}']
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, body string")
    rows = readers.json_records(df, "body", "a int, b string", keep=["id"]).orderBy("id", "a").collect()
    assert [(r.id, r.a, r.b) for r in rows] == [(0, 1, "x"), (0, 2, None), (1, 3, None), (2, 4, None), (3, 5, "[z"), (4, 6, None)]
    with pytest.raises(Exception, match="neither a list nor an object"):
        readers.json_records(spark.createDataFrame([("7",)], "body string"), "body", "a int").collect()
    for i, d in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(d)
    assert readers.load_json_responses(spark, str(tmp_path)).count() == 6


def test_tidy(spark):
    df = frame(spark, pd.DataFrame({"cement": [1.0, 2.0, np.nan], "constant": [1.0, 1.0, np.nan], "empty": [np.nan] * 3}))
    tidy = readers.tidy_on_load(df)
    assert tidy.columns == ["cement"] and tidy.count() == 2
    assert readers.tidy_on_load(df.limit(1)).columns == ["cement", "constant"]


def test_filters(spark):
    df = frame(spark, pd.DataFrame({"a": [1, np.nan, 3, 4], "b": [np.nan] * 3 + [1.0], "t": list("wxyz")}))
    assert filters.drop_missing(df, 0.5).columns == ["a", "t"]
    assert filters.drop_missing(df, 0.5, exclude="b").columns == ["a", "b", "t"]
    assert filters.drop_missing(df, 1.0).columns == ["a", "b", "t"]
    assert filters.common_filter(df, drop=["a", "nope"], remain=["t", "a"]).columns == ["t"]
    v = frame(spark, pd.DataFrame({"c": [1, 1, 1], "v": [1, 2, 3], "t": list("abc")}))
    assert filters.variance_filter(v, 0.01).columns == ["t", "v"]
    assert filters.variance_filter(v, 0.01, {"c": 0.0}).columns == ["t", "c", "v"]
    with pytest.raises(ValueError):
        filters.variance_filter(v, -1)
    rows = frame(spark, pd.DataFrame({"k": ["p", "q", "r"], "x": [1.0, 5.0, np.nan], "y": [1.0, 9.0, 2.0]}))
    assert [r.k for r in filters.row_variance_filter(rows, 0.5, key="k").collect()] == ["q"]
    assert [r.k for r in filters.row_variance_filter(rows, 0.5, {"p": 0.0}, "k").orderBy("k").collect()] == ["p", "q"]


def test_correlation_filter(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=60)
    pdf = pd.DataFrame({"a": a, "b": a * 2 + 0.001 * rng.normal(size=60), "c": rng.normal(size=60), "t": "x"})
    df = spark.createDataFrame(pdf)
    assert filters.correlation_filter(df).columns == ["t", "b", "c"]
    assert filters.correlation_filter(df, priority_features="a").columns == ["t", "a", "c"]
    assert set(filters.correlation_filter(df, exclude="b").columns) == {"a", "b", "c", "t"}


def test_units(spark):
    df = spark.createDataFrame([("5 kg", 1.0), ("7kgk", 2.0), ("bad", 3.0)], "w string, n double")
    out = filters.strip_units(df, {"w": "kg", "n": "m"})
    assert out.columns == ["w(kg)", "n(m)"] and [r[0] for r in out.collect()] == [5.0, 7.0, None]
    with pytest.raises(ValueError):
        filters.strip_units(df, {"zzz": "m"})


def test_report(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id int, t string, v double")
    b = spark.createDataFrame([(2, "y", 5.0), (3, "z", 3.0)], "id int, t string, v double")
    got = {tuple(r) for r in filters.clean_report(a, b, "id").collect()}
    assert got == {("row_removed", "1", None, None, None), ("row_added", "3", None, None, None), ("cell_changed", "2", "v", "2.0", "5.0")}
    assert filters.clean_report(a, b.drop("t"), "id").filter("change = 'column_removed'").count() == 1


def test_outliers(spark):
    df = spark.createDataFrame(pd.DataFrame({"a": list(range(1, 20)) + [200], "b": range(20), "t": "x"}))
    assert outliers.iqr_detector(df, columns="a").count() == 19 and outliers.zscore_detector(df, threshold=2.5).count() == 19
    capped = outliers.iqr_detector(df, "cap").toPandas()
    q1, q3 = np.percentile([*range(1, 20), 200], [25, 75])
    assert capped.a.max() == q3 + 1.5 * (q3 - q1)
    rep = outliers.iqr_detector(df, "replace", columns=["a"], replace_value=-1).toPandas()
    assert (rep[rep.a == -1].b == -1).all() and (rep.a == -1).sum() == 1
    assert outliers.zscore_detector(df, "cap", cap_method="std").toPandas().a.max() < 200
    for bad in (lambda: outliers.iqr_detector(df, "replace"), lambda: outliers.iqr_detector(df, "what")):
        with pytest.raises(ValueError):
            bad()


@pytest.fixture(scope="module")
def gaps():
    rng = np.random.default_rng(6)
    n = 300
    pdf = pd.DataFrame({"o": np.arange(n), "g": np.where(rng.random(n) < .4, "hot", rng.choice(list("abc"), n)), "x": rng.integers(0, 9, n).astype(float),
                        "y": rng.normal(size=n), "t": rng.choice(["p", "q", "r"], n)})
    pdf.loc[rng.random(n) < .3, "x"] = np.nan
    pdf.loc[(rng.random(n) < .5) | (pdf.o < 9) | (pdf.o > 290), "y"] = np.nan
    pdf.loc[rng.random(n) < .2, "t"] = None
    pdf.loc[pdf.g == "c", "x"] = np.nan
    return pdf


def test_fill_constants(spark, gaps):
    df = frame(spark, gaps)
    out = missing.fill_missing(df, "mean", column_strategy={"y": "median", "t": "mode"}).toPandas().sort_values("o")
    assert np.allclose(out.x, gaps.x.fillna(gaps.x.mean())) and np.allclose(out.y, gaps.y.fillna(gaps.y.median()))
    assert out.t.tolist() == gaps.t.fillna(gaps.t.mode()[0]).tolist()
    assert out.x_is_missing.tolist() == gaps.x.isna().astype(int).tolist()
    text = missing.fill_missing(df, "fill", column_fill_value={"t": "none"}, missing_indicator=False).toPandas().sort_values("o")
    assert text.t.tolist() == gaps.t.fillna("none").tolist() and np.allclose(text.x, gaps.x.fillna(gaps.x.median()))
    assert list(text.columns) == list(gaps.columns)


def test_grouped_mode(spark, gaps):
    df = frame(spark, gaps)
    out = missing.fill_missing(df, "fill_grouped_mode", group_by="g").toPandas().sort_values("o")
    modes = gaps.groupby("g").x.agg(lambda s: s.mode()[0] if not s.mode().empty else 1e-8)
    assert np.allclose(out.x, gaps.x.fillna(gaps.g.map(modes)))
    assert out.t.tolist() == gaps.t.fillna(gaps.g.map(gaps.groupby("g").t.agg(lambda s: s.mode()[0]))).tolist()
    assert missing.fill_missing(df, "fill_grouped_mode", group_by=["g", "t"]).count() == len(gaps)
    with pytest.raises(ValueError):
        missing.fill_missing(df, "fill_grouped_mode")


@pytest.mark.parametrize("buckets", [1, 8, 40])
def test_ordered_fills(spark, gaps, buckets):
    df = frame(spark, gaps)
    for how, want in (("forward", lambda s: s.ffill()), ("backward", lambda s: s.bfill()), ("interpolate", lambda s: s.interpolate())):
        out = missing.ordered_fill(df, {"x": how, "y": how}, "o", buckets=buckets).toPandas().sort_values("o")
        assert np.allclose(out.y, want(gaps.y), equal_nan=True) and np.allclose(out.x, want(gaps.x), equal_nan=True)
        parts = missing.ordered_fill(df, {"y": how}, "o", "g", buckets=buckets).toPandas().sort_values("o")
        assert np.allclose(parts.y, gaps.groupby("g").y.transform(want), equal_nan=True)
    with pytest.raises(ValueError):
        missing.fill_missing(df, "forward")


def test_run_log(spark, tmp_path):
    d = str(tmp_path / "log")
    assert runlog.run_log(spark, d).count() == 0
    for i, (m, s) in enumerate([("RF", "FINISHED"), ("RF", "FINISHED"), ("XGB", "FAILED")]):
        from datetime import datetime
        runlog.append_run(spark, d, "e", "model", m, params={"a": {"b": i}, "l": [1, 2]}, metrics={"mae": i}, status=s, run_id=f"r{i}", start_time=datetime(2024, 1, 1 + i))
    log = runlog.run_log(spark, d)
    assert [r.run_id for r in runlog.list_runs(log, "e", limit=2).collect()] == ["r2", "r1"]
    assert runlog.get_run(log, "r0").first().params == {"a.b": "0", "l": "1,2"}
    assert [tuple(r) for r in runlog.finished_models(log, "e").collect()] == [("RF", "r1")]
    with pytest.raises(KeyError):
        runlog.get_run(log, "zzz")


@pytest.mark.parametrize("how", ["backward", "interpolate"])
def test_ordered_fill_has_no_frame_that_is_added_up_anew_for_every_row(spark, how):
    df = spark.range(400).select("id", F.when(F.col("id") % 50 == 7, F.col("id").cast("double")).alias("v"))
    out = missing.ordered_fill(df, {"v": how}, "id", buckets=4)
    assert "unboundedfollowing" not in out._jdf.queryExecution().analyzed().toString().lower()
    want = df.toPandas().sort_values("id").v
    want = want.bfill() if how == "backward" else want.interpolate()
    got = out.toPandas().sort_values("id").v
    assert [None if x != x else x for x in got] == [None if x != x else x for x in want]


def test_ordered_fill_looks_both_ways_in_one_sort_of_even_tasks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = spark.range(24_000).select(F.col("id").alias("o`x y"), F.when(F.col("id") % 3000 == 700, F.col("id").cast("double")).alias("v"), F.lit("k").alias("g.h"))
        out = missing.ordered_fill(df, {"v": "interpolate"}, "o`x y", rows=6_000_000)  # buckets as for so many rows
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max("v")).collect()]
        assert sum(sizes) == 24_000 and max(sizes) < 24_000 / 4
        assert not re.search(r"__at#\d+L? DESC", out._jdf.queryExecution().executedPlan().toString())
        want = df.toPandas().sort_values("o`x y").v.interpolate()
        for filled in (out, missing.ordered_fill(df, {"v": "interpolate"}, "o`x y", "g.h")):
            assert np.allclose(filled.toPandas().sort_values("o`x y").v, want, equal_nan=True)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
