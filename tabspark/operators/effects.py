"""Group statistics and effect sizes of categories on targets, for all combinations at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.columns import choose_category, choose_targets, col, numeric_columns
from tabspark.functions.order_stats import grouped_quantiles
from tabspark.functions.special import chi2_tail, f_tail

COMBO = ["target", "categorical_col"]


def _combinations(df: DataFrame, targets: list[str], cats: list[str], dtype: str) -> DataFrame:
    """(target, categorical_col, category, value), rows without a category left out."""
    cells = F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(c).alias("categorical_col"),
                 col(c).cast("string").alias("category"), col(t).cast(dtype).alias("value"))
        for t in targets for c in cats if c != t
    ])
    return df.select(F.inline(cells)).filter("category IS NOT NULL")


def effect_size(df: DataFrame, targets, categorical_cols=None, rows: int | None = None) -> DataFrame | None:
    """Long table, one row per (target, categorical_col, category).

    Numeric targets: count, mean, std, quartiles, ANOVA F and p, eta squared, Cohen's d for two groups.
    Text targets: count, unique, top, freq, chi-squared and p, Cramer's V.  None without combinations.
    """
    targets = choose_targets(df, targets)
    numbers = [t for t in targets if t in numeric_columns(df)]
    texts = [t for t in targets if t not in numbers]
    try:
        cats = choose_category(df, categorical_cols, exclude=targets)
    except ValueError:
        if categorical_cols is not None:
            raise
        return None
    parts = []
    if numbers:
        parts.append(numeric_effects(df, numbers, cats, rows))
    if texts:
        parts.append(text_effects(df, texts, cats))
    if len(parts) == 2:
        return parts[0].unionByName(parts[1], allowMissingColumns=True)
    return parts[0]


def numeric_effects(df: DataFrame, targets: list[str], cats: list[str], rows: int | None = None) -> DataFrame:
    cells = _combinations(df, targets, cats, "double")
    keys = [*COMBO, "category"]
    moments = cells.groupBy(*keys).agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.var_samp("value").alias("__var"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    cell_rows = None if rows is None else rows * len(targets) * len(cats)
    quartiles = grouped_quantiles(cells, keys, "value", [0.25, 0.5, 0.75], ["q25", "q50", "q75"], rows=cell_rows)
    groups = moments.join(quartiles, keys, "left")

    grand = moments.groupBy(*COMBO).agg((F.sum(F.col("count") * F.col("mean")) / F.nullif(F.sum("count"), F.lit(0))).alias("__grand"))
    filled = moments.filter(F.col("count") > 0).join(grand, COMBO)
    sums = filled.groupBy(*COMBO).agg(
        F.sum(F.col("count") * F.pow(F.col("mean") - F.col("__grand"), 2)).alias("ssb"),
        F.sum(F.coalesce((F.col("count") - 1) * F.col("__var"), F.lit(0.0))).alias("ssw"),
        F.sum("count").alias("n"), F.count(F.lit(1)).alias("k"),
        (F.min_by("mean", "category") - F.max_by("mean", "category")).alias("gap"),
    )
    two_up = F.col("k") >= 2
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    ratio = (F.col("ssb") / df1) / F.nullif(F.col("ssw") / F.nullif(df2, F.lit(0)), F.lit(0.0))
    ratio = F.when((F.col("ssw") == 0) & (F.col("ssb") > 0) & (df2 > 0), F.lit(float("inf"))).otherwise(ratio)
    pooled = F.sqrt(F.col("ssw") / F.nullif(F.col("n") - 2, F.lit(0)))
    effects = sums.select(
        *COMBO,
        F.when(two_up, ratio).alias("__F"), df1.cast("double").alias("__d1"), df2.cast("double").alias("__d2"),
        F.when(two_up, F.round(F.col("ssb") / F.nullif(F.col("ssb") + F.col("ssw"), F.lit(0.0)), 4)).alias("eta_sq"),
        F.when((F.col("k") == 2) & (F.col("n") > 2), F.round(F.col("gap") / F.nullif(pooled, F.lit(0.0)), 4)).alias("cohens_d"),
    ).select(*COMBO, F.round("__F", 4).alias("F"), F.round(f_tail("__F", "__d1", "__d2"), 6).alias("p_value"), "eta_sq", "cohens_d")
    return groups.join(effects, COMBO, "left").select(
        *keys, "count", *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")],
        "F", "p_value", "eta_sq", "cohens_d",
    )


def text_effects(df: DataFrame, targets: list[str], cats: list[str]) -> DataFrame:
    cells = (_combinations(df, targets, cats, "string").groupBy(*COMBO, "category", "value")
             .agg(F.count(F.lit(1)).alias("o")))
    known = F.col("value").isNotNull()
    groups = cells.groupBy(*COMBO, "category").agg(
        F.coalesce(F.sum(F.when(known, F.col("o"))), F.lit(0)).alias("count"),
        F.count("value").alias("unique"),
        F.min_by("value", F.when(known, F.struct(-F.col("o"), F.col("value")))).alias("top"),
        F.max(F.when(known, F.col("o"))).alias("freq"),
    )
    return groups.join(association(cells), COMBO, "left")


def association(cells: DataFrame) -> DataFrame:
    """chi2, p_value, cramers_v per combination from counts (target, categorical_col, category, value, o).

    sum((o-e)^2/e) over all cells equals sum(o^2/e) - n over the occupied ones, so empty cells are never
    built.  A 2 x 2 table gets the continuity correction, which its margins and one cell determine.
    """
    known = cells.filter("value IS NOT NULL")
    by_row = known.groupBy(*COMBO, "category").agg(F.sum("o").alias("r"))
    by_col = known.groupBy(*COMBO, "value").agg(F.sum("o").alias("c"))
    total = by_row.groupBy(*COMBO).agg(F.sum("r").cast("double").alias("n"), F.count(F.lit(1)).alias("rows"),
                                       F.min("r").alias("r1"), F.max("r").alias("r2"))
    total = total.join(by_col.groupBy(*COMBO).agg(F.count(F.lit(1)).alias("cols"), F.min("c").alias("c1"), F.max("c").alias("c2")), COMBO)
    expected = known.join(by_row, [*COMBO, "category"]).join(by_col, [*COMBO, "value"]).join(total.select(*COMBO, "n"), COMBO)
    expected = expected.withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    sums = expected.groupBy(*COMBO).agg(F.sum(F.col("o") * F.col("o") / F.col("e")).alias("oo"),
                                        F.max(F.abs(F.col("o") - F.col("e"))).alias("gap"))
    n, dof = F.col("n"), (F.col("rows") - 1) * (F.col("cols") - 1)
    shrunk = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    corrected = shrunk * shrunk * n * (n / F.col("r1")) * (n / F.col("r2")) / F.col("c1") / F.col("c2")
    chi2 = F.when(dof == 1, corrected).otherwise(F.greatest(F.col("oo") - n, F.lit(0.0)))
    least = F.least("rows", "cols")
    out = total.join(sums, COMBO).filter(least >= 2).select(*COMBO, chi2.alias("x"), dof.cast("double").alias("dof"), "n", least.alias("least"))
    return out.select(
        *COMBO, F.round("x", 4).alias("chi2"), F.round(chi2_tail("x", "dof"), 6).alias("p_value"),
        F.round(F.sqrt(F.col("x") / (F.col("n") * (F.col("least") - 1))), 4).alias("cramers_v"),
    )


def top_effects(effects: DataFrame, n: int = 3) -> DataFrame:
    """Combinations with the smallest p."""
    best = effects.groupBy(*COMBO).agg(F.min("p_value").alias("p_value")).filter("p_value IS NOT NULL")
    return best.orderBy("p_value", *COMBO).limit(n)


def contingency(df: DataFrame, targets, categorical_cols=None) -> DataFrame:
    """(target, categorical_col, category, value, n) with nulls as their own level."""
    targets = choose_targets(df, targets)
    wrong = [t for t in targets if t in numeric_columns(df)]
    if wrong:
        raise ValueError(f"association needs text targets, these are numeric: {wrong}")
    cats = choose_category(df, categorical_cols, exclude=targets)
    cells = F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(c).alias("categorical_col"),
                 col(c).cast("string").alias("category"), col(t).cast("string").alias("value"))
        for t in targets for c in cats
    ])
    return df.select(F.inline(cells)).groupBy(*COMBO, "category", "value").agg(F.count(F.lit(1)).alias("n"))


def shares_within(counts: DataFrame) -> DataFrame:
    """Share of each value within its category."""
    within = Window.partitionBy(*COMBO, "category")
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(within), 4))
