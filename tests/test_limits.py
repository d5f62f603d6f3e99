"""Inputs on the far side of former limits: many levels, late fields, equal rows, large whole numbers, signed zeros."""

import pytest
from pyspark.sql import functions as F

from tabspark.functions import lookup as lookups
from tabspark.functions.special import normal_ppf
from tabspark.operators import filters, models, search
from tabspark.operators.profile import profile
from tabspark.operators.target import x_y
from tabspark.sources import readers


@pytest.mark.parametrize("levels", [200, 300])
def test_text_levels_are_never_hashed(spark, levels):
    df = spark.range(levels).select(F.concat(F.lit("v"), "id").alias("t"), F.col("id").cast("double").alias("x"))
    step, numbers, texts = models.input_step(df, ["t", "x"])
    assert (numbers, texts) == (["x"], ["t"]) and step.apply(df).select("t").distinct().count() == levels
    with pytest.raises(ValueError, match="text feature t"):
        models.input_step(df, ["t"], max_levels=100)


def test_json_documents(spark):
    def rows(*texts):
        return spark.createDataFrame([(t,) for t in texts], "body string")

    got = readers.json_records(rows('{"data": "[1,2]", "k": 7}', '[{"k": 1}, {"k": 2}]', '{"data": [{"k": 3}], "rows": [{"k": 4}]}', None, "[]"), "body", "k bigint")
    assert sorted(r.k for r in got.collect()) == [1, 2, 3, 7]
    for bad in ('[{"k": 1}', "7", "null", "text"):
        with pytest.raises(Exception, match="malformed"):
            readers.json_records(rows(bad), "body", "k bigint").collect()
    many = rows(*['{"k": %d}' % i if i < 120 else '{"k": %d, "late": 1.5, "deep": {"a": [true]}}' % i for i in range(150)])
    schema = readers.infer_record_schema(many, "body")
    out = readers.json_records(many, "body", schema)
    assert set(out.columns) == {"k", "late", "deep"} and out.filter("late = 1.5").count() == 30 and out.filter("deep.a[0]").count() == 30


def test_lookup_spreads_equal_rows_and_takes_maps(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.create_map(F.lit("a"), F.lit(1)).alias("m")).unionByName(spark.createDataFrame([("x", {"a": 2}), ("y", {"a": 3})], "k string, m map<string,int>"))
    mapping = spark.createDataFrame([("hot", 9, 4000), ("x", 8, 1), ("z", 7, 1)], "k string, v int, n int")
    out = lookups.lookup(df, mapping, ["k"], "n", broadcast_rows=1)
    assert {(r.k, r.v): r["count"] for r in out.groupBy("k", "v").count().collect()} == {("hot", 9): 4000, ("x", 8): 1, ("y", None): 1}


def test_pareto_of_large_whole_numbers(spark):
    df = spark.createDataFrame([(1, 2**53 + 1, 5.0), (2, 2**53, 5.0), (3, 2**53 + 1, 6.0), (4, 1, 1.0)], "id bigint, gain bigint, cost double")
    out = search.with_pareto_flag(df, {"gain": "maximize", "cost": "minimize"})
    assert {r.id for r in out.filter("pareto").collect()} == {1, 4}


def test_profile_of_zeros_and_no_numbers(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.0,), (float("nan"),)], "x double")
    assert profile(df).first().nunique == 2


def test_correlation_filter_uses_ranks(spark):
    df = spark.range(1, 60).select(F.col("id").cast("double").alias("a"), F.exp("id").alias("b"))
    assert len(filters.correlation_filter(df, 0.95).columns) == 1 and len(filters.correlation_filter(df, 0.95, "pearson").columns) == 2


def test_dates_stay_in_the_modelling_table(spark):
    df = spark.sql("SELECT id, CAST(id AS double) y, date'2024-01-01' AS d, array(id) AS nested FROM range(20)")
    assert x_y(df, "y", task="regression", keep="id").features == ["d", "nested"]


def test_normal_quantile():
    got = normal_ppf([[0.5, 0.975], [0.0, 1.0]])
    assert abs(got[0, 1] - 1.959963984540054) < 1e-12 and got[0, 0] == 0 and list(got[1]) == [float("-inf"), float("inf")]


def test_lookup_takes_more_tasks_for_more_rows(spark, monkeypatch):
    monkeypatch.setattr(lookups, "TASK_ROWS", 100)
    monkeypatch.setattr(lookups, "HOT_KEYS", 2)
    df = spark.range(3000).select("id", F.when(F.col("id") % 10 > 0, (F.col("id") % 700 - 350) / 7).alias("k"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("t"), F.col("id") % 11)).alias("t"))
    mapping = df.groupBy("k", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))
    out = lookups.lookup(df, mapping, ["k", "t"], "n", broadcast_rows=1)
    assert out.rdd.getNumPartitions() == 30
    sums = {(r.k, r.t): r.s for r in mapping.collect()}
    got = out.collect()
    assert len(got) == 3000 and all(r.s == sums[r.k, r.t] for r in got)
