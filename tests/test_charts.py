import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabspark.operators import charts, density


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(2)
    n = 1500
    pdf = pd.DataFrame({"x": rng.normal(size=n), "u": rng.random(n), "label": rng.choice(["a", "b"], n), "k": "only"})
    pdf["y"] = np.sin(2 * pdf.x) + 0.2 * rng.normal(size=n)
    pdf.loc[5, "k"] = "single"
    return pdf, spark.createDataFrame(pdf)


def test_kde_matches_direct_sum(frame):
    pdf, df = frame
    got = charts.numeric_kde(df, ["x"]).toPandas().sort_values("point")
    v = pdf.x.to_numpy()
    h = v.std(ddof=1) * len(v) ** -0.2
    direct = np.exp(-0.5 * ((got.x.to_numpy()[:, None] - v) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
    assert np.allclose(got.density, direct, rtol=5e-3, atol=1e-4)
    assert got.x.min() == pytest.approx(v.min()) and got.x.max() == pytest.approx(v.max())


def test_histogram_is_a_density(frame):
    pdf, df = frame
    got = density.histogram(df, ["x", "u"]).toPandas()
    for c, part in got.groupby("name"):
        assert part.n.sum() == len(pdf)
        assert (part.density * (part.right - part.left)).sum() == pytest.approx(1.0)
        counts, edges = np.histogram(pdf[c], bins="auto")
        full = np.zeros(len(counts), int)
        full[part.bin.to_numpy()] = part.n
        assert full.tolist() == counts.tolist()


def test_groups_of_one_are_skipped(frame):
    _, df = frame
    got = charts.target_effect(df, "y", "k").toPandas()
    assert set(got.category) == {"only"}
    with pytest.raises(charts.SkipChart):
        charts.target_effect(df, "label", "k")
    with pytest.raises(charts.SkipChart):
        charts.target_separation(df, "y")
    assert set(charts.target_separation(df, "label", "x").toPandas()["class"]) == {"a", "b"}


def test_box_stats(frame):
    pdf, df = frame
    row = charts.box_stats(df, ["x"]).first()
    q1, q3 = pdf.x.quantile([0.25, 0.75])
    outside = pdf.x[(pdf.x < q1 - 1.5 * (q3 - q1)) | (pdf.x > q3 + 1.5 * (q3 - q1))]
    assert row.outlier_count == len(outside) and row.median == pytest.approx(pdf.x.median())
    assert sorted(r.value for r in charts.box_outliers(df, ["x"]).collect()) == pytest.approx(sorted(outside))


def plain_lowess(x, y, frac, rounds):
    """Straight loop over the points, as the definition reads."""
    n, k = len(x), max(2, int(frac * len(x) + 1e-10))
    rob, fit = np.ones(n), np.zeros(n)
    for _ in range(rounds + 1):
        for i in range(n):
            d = np.abs(x - x[i])
            r = np.sort(d)[k - 1]
            w = np.clip(1 - (d / r) ** 3, 0, None) ** 3 * rob
            a = np.polyfit(x, y, 1, w=np.sqrt(w))
            fit[i] = np.polyval(a, x[i])
        s = 6 * np.median(np.abs(y - fit))
        rob = np.clip(1 - ((y - fit) / s) ** 2, 0, None) ** 2
    return fit


@pytest.mark.parametrize("copies", [1, 40])
def test_lowess_is_one_algorithm_at_every_size(spark, copies):
    """Few values of x: exact with 60 rows and with 2400, one smoothed value per row."""
    rng = np.random.default_rng(8)
    x = np.repeat(np.arange(20.0), 3 * copies)
    y = np.sin(x / 4) + rng.normal(0, 0.2, len(x))
    y[::17] += 4
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "x": x, "y": y})).repartition(4)
    got = density.lowess(df, ["k"], "x", "y", 0.4).toPandas()
    want = plain_lowess(x, y, 0.4, 3)
    assert len(got) == len(x) and list(got.columns) == ["k", "x", "smooth"]
    assert np.allclose(got.groupby("x").smooth.first(), pd.Series(want).groupby(x).first(), atol=3e-3)  # the median of an even number of residuals is one of the middle two
    assert np.allclose(density.lowess(df.drop("k"), [], "x", "y", 0.4).toPandas().groupby("x").smooth.first(), got.groupby("x").smooth.first())


def test_lowess_of_many_values_follows_the_exact_line(frame):
    pdf, df = frame
    few = pdf.head(150).sort_values("x")
    sub = few[few.k == "only"]
    got = density.lowess(df.sparkSession.createDataFrame(few), ["k"], "x", "y", 0.4).toPandas()
    got = got[got.k == "only"].sort_values("x")
    assert np.allclose(got.smooth, plain_lowess(sub.x.to_numpy(), sub.y.to_numpy(), 0.4, 3), atol=0.02)


@pytest.mark.parametrize("n,bins,atol", [(300, 1_024, 1e-2), (1_500, 256, 5e-2)])
def test_lowess_with_a_far_outlier_follows_the_exact_line(frame, n, bins, atol):
    rng = np.random.default_rng(4)
    x = np.append(rng.uniform(0, 6, n - 1), 6_000.0)
    y = np.sin(x) + rng.normal(0, 0.1, n)
    df = frame[1].sparkSession.createDataFrame(pd.DataFrame({"k": "a", "x": x, "y": y})).repartition(3)
    got = density.lowess(df, ["k"], "x", "y", 0.3, bins=bins).toPandas().sort_values("x")
    want = plain_lowess(np.sort(x), y[np.argsort(x)], 0.3, 3)
    assert np.allclose(got.smooth[:-1], want[:-1], atol=atol)


def test_trend_keeps_the_strongest(frame):
    _, df = frame
    got = charts.target_trend(df, "y", top_k=1).toPandas()
    assert set(got.feature) == {"x"} and len(got) == 1500
    lines = charts.trend_lines(charts.target_trend(df, "y", ["x"]), 0.3)
    assert lines.count() == 1500


def test_association_counts_nulls(spark):
    df = spark.createDataFrame([("a", "u"), ("a", None), (None, "u")], "c string, t string")
    rows = {(r.category, r.value): r.n for r in charts.target_association(df, "t", "c").collect()}
    assert rows == {("a", "u"): 1, ("a", None): 1, (None, "u"): 1}


def test_lowess_reads_its_rows_a_few_times_whatever_the_rounds(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    df = spark.range(300).select(F.lit("a").alias("g"), F.udf(seen, "double")(F.col("id").cast("double")).alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    assert density.lowess(df, ["g"], "x", "y").count() == 300
    assert read.value <= 20 * 300


def test_lowess_of_few_groups_equals_the_joined_way(spark, monkeypatch):
    """Null keys, far values, ties and a group without spread; the rows of few groups are not joined to their intervals."""
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"g": np.where(np.arange(900) % 3 > 0, "a", "b"), "h": 1, "x": np.round(rng.normal(size=900), 2), "y": rng.normal(size=900)})
    pdf.loc[5, "x"], pdf["y"] = 4_000.0, pdf.y + np.sin(pdf.x)
    df = spark.createDataFrame(pdf).repartition(4).withColumn("g", F.when(F.col("g") == "a", "a")).unionByName(spark.sql("SELECT 'flat' AS g, 2L AS h, 1D AS x, CAST(id AS double) AS y FROM range(9)"))
    calls, lookup = [], density.lookup
    monkeypatch.setattr(density, "lookup", lambda *a, **k: calls.append(a) or lookup(*a, **k))
    near = density.lowess(df, ["g", "h"], "x", "y", 0.3, bins=64)
    got = near.toPandas().fillna("null").sort_values(["g", "x"])
    assert len(calls) == 1 and near.columns == ["g", "h", "x", "smooth"] and len(got) == 900
    monkeypatch.setattr(density, "NEAR_GROUPS", 0)
    want = density.lowess(df, ["g", "h"], "x", "y", 0.3, bins=64).toPandas().fillna("null").sort_values(["g", "x"])
    assert list(got.g) == list(want.g) and np.allclose(got.x, want.x) and np.allclose(got.smooth, want.smooth, rtol=1e-9, atol=1e-9)
