"""One row per column: completeness, cardinality, moments, quartiles and the most frequent values."""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabspark.columns import aggregate_once, col, datetime_columns, float_columns, numeric_columns
from tabspark.functions.order_stats import column_quantiles

TOP = 10
PROFILE_SCHEMA = (
    "name string, dtype string, missing string, nunique bigint, cardinality_ratio double, is_id boolean, "
    "is_constant boolean, top_10 map<string,double>, count bigint, mean double, std double, min double, "
    "q25 double, q50 double, q75 double, max double, skew double, kurt double, first_time string, last_time string"
)


def sample_skewness(value: Column, n: Column) -> Column:
    """Sample-corrected skewness; Spark's own is the population moment."""
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurtosis(value: Column, n: Column) -> Column:
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(name, value, n) of all columns in one shuffle; values as text, nulls left out."""
    def text(c):
        if df.schema[c].dataType.typeName() in ("double", "float"):  # one zero, and no-number is missing
            return F.when(~F.isnan(col(c)), F.when(col(c) == 0, F.lit(0.0)).otherwise(col(c)).cast("string"))
        if df.schema[c].dataType.typeName() == "timestamp":  # two instants can share a local time
            return F.concat(col(c).cast("string"), F.date_format(col(c), "XXX"))
        return col(c).cast("string") if _castable(df, c) else F.to_json(F.struct(col(c)))
    cells = F.array(*[F.struct(F.lit(c).alias("name"), text(c).alias("value")) for c in columns])
    return df.select(F.inline(cells)).filter("value IS NOT NULL").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))


def _castable(df: DataFrame, name: str) -> bool:
    return df.schema[name].dataType.typeName() not in ("array", "map", "struct", "binary")


def top_values(counts: DataFrame, k: int = TOP) -> DataFrame:
    """(name, value, n, rank) of the k most frequent values per column.

    The rank filter is applied before the shuffle as well (window group limit), so no task receives a
    column's whole dictionary.
    """
    order = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_shares(df: DataFrame, columns: list[str], k: int = TOP) -> DataFrame:
    """(name, value, share of all rows), with one ``others`` row per column that has more values."""
    rows = df.count()
    counts = value_counts(df, columns)
    top = top_values(counts, k)
    known = counts.groupBy("name").agg(F.sum("n").alias("all_n"))
    rest = top.groupBy("name").agg(F.sum("n").alias("top_n")).join(known, "name").filter("all_n > top_n")
    both = top.select("name", "value", "n").unionByName(rest.select("name", F.lit("others").alias("value"), (F.col("all_n") - F.col("top_n")).alias("n")))
    return both.select("name", "value", F.round(F.col("n") / F.lit(float(max(rows, 1))), 4).alias("share"))


def rounded(value: float | None) -> float | None:
    """Four digits, halves away from zero, as the SQL ``round`` does."""
    if value is None or not math.isfinite(value):
        return None if value is None or math.isnan(value) else float(value)
    if abs(value) >= 1e15:
        return float(value)
    return float(Decimal(repr(float(value))).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def profile(df: DataFrame, datetime_format: str = "yyyy-MM-dd HH:mm:ss", columns: list[str] | None = None) -> DataFrame:
    """Profile of the table; three jobs whatever the number of columns.

    One wide aggregate for moments, one for quartiles, and one value-count shuffle that gives both the
    distinct counts and the top values.  ``df`` is scanned by each, so persist it if it is expensive.
    """
    spark = df.sparkSession
    names = list(columns or df.columns)
    numbers = [c for c in names if c in numeric_columns(df)]
    times = [c for c in names if c in datetime_columns(df)]
    floats = set(float_columns(df))
    exprs: dict = {("rows", ""): F.count(F.lit(1)), **{("n", c): F.count(col(c)) for c in names}}
    for c in numbers:
        v, n = col(c).cast("double"), F.count(col(c))
        exprs.update({("mean", c): F.avg(v), ("std", c): F.stddev_samp(v), ("min", c): F.min(v), ("max", c): F.max(v),
                      ("skew", c): sample_skewness(v, n), ("kurt", c): sample_kurtosis(v, n)})
    for c in times:
        exprs.update({("first", c): F.date_format(F.min(col(c)), datetime_format),
                      ("last", c): F.date_format(F.max(col(c)), datetime_format)})
    facts = aggregate_once(df, exprs)
    rows = facts["rows", ""]
    quartiles = column_quantiles(df, numbers, [0.25, 0.5, 0.75], rows=rows) if numbers else {}

    counts = value_counts(df, names)
    distinct = counts.groupBy("name").agg(F.count(F.lit(1)).alias("nunique"))
    top = top_values(counts).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("top"))
    # one row per column of the table
    shares = {r["name"]: r for r in distinct.join(top, "name").collect()}

    out = []
    for c in names:
        n = facts["n", c]
        nunique = shares[c]["nunique"] if c in shares else 0
        top_10 = {t["value"]: rounded(t["n"] / rows) for t in shares[c]["top"]} if c in shares else {}
        others = n - sum(t["n"] for t in shares[c]["top"]) if c in shares else 0
        if others:
            top_10["others"] = rounded(others / rows)
        rate = rounded((rows - n) / rows) if rows else 0.0
        q = quartiles.get(c, [None] * 3)
        out.append((
            c, df.schema[c].dataType.simpleString(), f"{rows - n} ({round(rate * 100, 2)}%)", nunique,
            rounded(nunique / math.sqrt(n)) if n else 0.0,
            bool(n and nunique == n and c not in floats), nunique == 1, top_10, n,
            *[rounded(facts.get((k, c))) for k in ("mean", "std", "min")], *[rounded(x) for x in q],
            *[rounded(facts.get((k, c))) for k in ("max", "skew", "kurt")],
            facts.get(("first", c)), facts.get(("last", c)),
        ))
    return spark.createDataFrame(out, PROFILE_SCHEMA)
