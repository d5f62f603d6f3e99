"""The tables behind the analysis figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.columns import aggregate_once, as_list, choose_category, choose_numeric, choose_targets, col, long_form, numeric_columns
from tabspark.functions.order_stats import column_quantiles
from tabspark.operators import density
from tabspark.operators.correlation import correlation_long, correlation_matrix
from tabspark.operators.effects import contingency, shares_within

BOX_SCHEMA = ("name string, min double, q1 double, median double, q3 double, max double, mean double, "
              "whisker_low double, whisker_high double, outlier_count bigint")
WHISKER = 1.5


class SkipChart(ValueError):
    """The targets are not of the kind this chart is for."""


def numeric_quality(df: DataFrame, numerical_cols=None, bins: int | str = "auto") -> dict[str, DataFrame]:
    """{histogram, kde, quartiles} of every numeric column."""
    names = choose_numeric(df, numerical_cols)
    return {
        "histogram": density.histogram(df, names, bins),
        "kde": numeric_kde(df, names),
        "quartiles": quartile_table(df, names),
    }


def numeric_kde(df: DataFrame, numerical_cols=None) -> DataFrame:
    """Densities over the range of the data."""
    return density.kde_curves(long_form(df, choose_numeric(df, numerical_cols)), ["name"], "value", cut=0.0)


def quartile_table(df: DataFrame, numerical_cols=None) -> DataFrame:
    found = column_quantiles(df, choose_numeric(df, numerical_cols), [0.25, 0.5, 0.75])
    return df.sparkSession.createDataFrame([(c, *q) for c, q in found.items()], "name string, q1 double, q2 double, q3 double")


def box_stats(df: DataFrame, numerical_cols=None) -> DataFrame:
    """One row per column; whiskers are quartile +- 1.5 IQR, not clipped to the data."""
    names = choose_numeric(df, numerical_cols)
    value = {c: col(c).cast("double") for c in names}
    basic = aggregate_once(df, {(k, c): f(value[c]) for c in names for k, f in (("min", F.min), ("max", F.max), ("mean", F.avg))})
    quartiles = column_quantiles(df, names, [0.25, 0.5, 0.75])
    fences = {c: (q[0] - WHISKER * (q[2] - q[0]), q[2] + WHISKER * (q[2] - q[0])) for c, q in quartiles.items() if q[0] is not None}
    outside = aggregate_once(df, {c: F.count(F.when((value[c] < lo) | (value[c] > hi), 1)) for c, (lo, hi) in fences.items()})
    rows = [(c, basic["min", c], *quartiles[c], basic["max", c], basic["mean", c], *fences.get(c, (None, None)), outside.get(c, 0)) for c in names]
    return df.sparkSession.createDataFrame(rows, BOX_SCHEMA)


def box_outliers(df: DataFrame, numerical_cols=None) -> DataFrame:
    """(name, value): every value outside its column's whiskers, as rows and never as one list."""
    names = choose_numeric(df, numerical_cols)
    quartiles = {c: q for c, q in column_quantiles(df, names, [0.25, 0.75]).items() if q[0] is not None}
    cells = F.array(*[
        F.when((col(c) < q1 - WHISKER * (q3 - q1)) | (col(c) > q3 + WHISKER * (q3 - q1)),
               F.struct(F.lit(c).alias("name"), col(c).cast("double").alias("value")))
        for c, (q1, q3) in quartiles.items()
    ])
    return df.select(F.inline(F.filter(cells, lambda x: x.isNotNull())))


def correlation_heatmap(df: DataFrame, targets=None, method: str = "spearman", numerical_cols=None) -> DataFrame:
    names = as_list(numerical_cols)
    if names:
        names = [c for c in [*names, *as_list(targets)] if c in numeric_columns(df)]
    return correlation_matrix(df, names or None, method, targets)


def trend_correlations(df: DataFrame, targets, numerical_cols=None, top_k: int = 9, method: str = "spearman",
                       min_sample_size: int = 20) -> DataFrame:
    """(target, feature, r, p) of the strongest features per target (all of them if named)."""
    targets = choose_targets(df, targets)
    targets = [t for t in targets if t in numeric_columns(df)]
    if not targets:
        raise SkipChart("trends need numeric targets")
    features = choose_numeric(df, numerical_cols, exclude=targets)
    filled = aggregate_once(df, {c: F.count(col(c)) for c in features})
    features = [c for c in features if filled[c] >= min_sample_size]
    pairs = [(f, t) for t in targets for f in features]
    found = correlation_long(df, [*features, *targets], method, pairs=pairs) if pairs else correlation_long(df, targets, method, pairs=[])
    ranked = found.select(F.col("col_b").alias("target"), F.col("col_a").alias("feature"), "r", "p")
    if numerical_cols is None:
        order = Window.partitionBy("target").orderBy(F.desc_nulls_last(F.abs("r")), "feature")
        ranked = ranked.withColumn("__k", F.row_number().over(order)).filter(F.col("__k") <= top_k).drop("__k")
    return ranked


def target_trend(df: DataFrame, targets, numerical_cols=None, top_k: int = 9, method: str = "spearman",
                 min_sample_size: int = 20) -> DataFrame:
    """Long scatter table (target, feature, x, y, r, p), complete pairs only."""
    strongest = trend_correlations(df, targets, numerical_cols, top_k, method, min_sample_size)
    chosen = [(r["target"], r["feature"], r["r"], r["p"]) for r in strongest.collect()]  # at most targets x features
    if not chosen:
        return df.sparkSession.createDataFrame([], "target string, feature string, x double, y double, r double, p double")
    cells = F.array(*[
        F.when(col(f).isNotNull() & col(t).isNotNull(),
               F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), col(f).cast("double").alias("x"), col(t).cast("double").alias("y"),
                        F.lit(r).cast("double").alias("r"), F.lit(p).cast("double").alias("p")))
        for t, f, r, p in chosen
    ])
    return df.select(F.inline(F.filter(cells, lambda x: x.isNotNull())))


def trend_lines(trend: DataFrame, frac: float = 0.3) -> DataFrame:
    return density.lowess(trend, ["target", "feature"], "x", "y", frac)


def target_separation(df: DataFrame, targets, numerical_cols=None) -> DataFrame:
    """Density of each numeric feature per class of each text target."""
    targets = choose_targets(df, targets)
    if any(t in numeric_columns(df) for t in targets):
        raise SkipChart(f"class targets must not be numeric: {targets}")
    features = choose_numeric(df, numerical_cols, exclude=targets)
    cells = F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), col(t).cast("string").alias("class"), col(f).cast("double").alias("value"))
        for t in targets for f in features
    ])
    long = df.select(F.inline(cells)).filter("class IS NOT NULL")
    return density.kde_curves(long, ["target", "feature", "class"], "value")


def target_effect(df: DataFrame, targets, categorical_cols=None) -> DataFrame:
    """Density of each numeric target per category."""
    targets = choose_targets(df, targets)
    if any(t not in numeric_columns(df) for t in targets):
        raise SkipChart(f"targets must be numeric: {targets}")
    cats = choose_category(df, categorical_cols, exclude=targets)
    cells = F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(c).alias("categorical_col"), col(c).cast("string").alias("category"), col(t).cast("double").alias("value"))
        for t in targets for c in cats
    ])
    long = df.select(F.inline(cells)).filter("category IS NOT NULL")
    return density.kde_curves(long, ["target", "categorical_col", "category"], "value")


def target_association(df: DataFrame, targets, categorical_cols=None) -> DataFrame:
    """Contingency counts with nulls as a level, and shares within each category."""
    return shares_within(contingency(df, targets, categorical_cols))
