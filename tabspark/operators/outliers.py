"""Outlier handling: bounds come from one small aggregate, rows are treated by plain expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.columns import aggregate_once, as_list, col, numeric_columns
from tabspark.functions.order_stats import column_quantiles

Bounds = dict[str, tuple[float, float]]
STRATEGIES = ("remove", "cap", "replace")


def iqr_bounds(df: DataFrame, columns: list[str], threshold: float = 1.5, rows: int | None = None) -> Bounds:
    found = column_quantiles(df, columns, [0.25, 0.75], rows=rows)
    bounds = {}
    for c, (q1, q3) in found.items():
        if q1 is not None:
            bounds[c] = (q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1))
    return bounds


def std_bounds(df: DataFrame, columns: list[str], threshold: float = 3.0) -> Bounds:
    """mean +- threshold sample deviations; columns without spread have no bounds."""
    stats = aggregate_once(df, {
        **{("m", c): F.avg(col(c).cast("double")) for c in columns},
        **{("s", c): F.stddev_samp(col(c).cast("double")) for c in columns},
    })
    return {c: (stats["m", c] - threshold * stats["s", c], stats["m", c] + threshold * stats["s", c])
            for c in columns if stats["s", c]}


def outlier_mask(bounds: Bounds) -> Column:
    """True where any bounded column lies outside; nulls are never outliers."""
    outside = [F.coalesce((col(c) < F.lit(lo)) | (col(c) > F.lit(hi)), F.lit(False)) for c, (lo, hi) in bounds.items()]
    return reduce(lambda a, b: a | b, outside, F.lit(False))


def cap(df: DataFrame, bounds: Bounds) -> DataFrame:
    def clamp(c):
        lo, hi = bounds[c]
        # least/greatest skip nulls, so a null cell must be kept null explicitly
        return F.when(col(c).isNotNull(), F.least(F.greatest(col(c).cast("double"), F.lit(lo)), F.lit(hi))).alias(c)
    return df.select(*[clamp(c) if c in bounds else col(c) for c in df.columns])


def replace_rows(df: DataFrame, mask: Column, value: float | None) -> DataFrame:
    if value is None:
        raise ValueError("strategy 'replace' needs replace_value")
    numbers = set(numeric_columns(df))
    return df.select(*[
        F.when(mask, F.lit(float(value))).otherwise(col(c).cast("double")).alias(c) if c in numbers else col(c)
        for c in df.columns
    ])


def _usable(df: DataFrame, columns) -> list[str]:
    numbers = numeric_columns(df)
    return numbers if columns is None else [c for c in as_list(columns) if c in numbers]


def iqr_detector(df: DataFrame, strategy: str = "remove", threshold: float = 1.5, columns=None,
                 replace_value: float | None = None) -> DataFrame:
    """``cap`` treats all numeric columns whatever ``columns`` says; the others look at ``columns`` only."""
    if strategy == "cap":
        return cap(df, iqr_bounds(df, numeric_columns(df), threshold))
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    mask = outlier_mask(iqr_bounds(df, _usable(df, columns), threshold))
    return df.filter(~mask) if strategy == "remove" else replace_rows(df, mask, replace_value)


def zscore_detector(df: DataFrame, strategy: str = "remove", threshold: float = 3.0, columns=None,
                    cap_method: str = "iqr", replace_value: float | None = None) -> DataFrame:
    """|x - mean| / sample deviation; capping has its own fixed bounds (1.5 IQR or 3 deviations)."""
    if strategy == "cap":
        if cap_method not in ("iqr", "std"):
            raise ValueError(f"cap_method must be 'iqr' or 'std', got {cap_method!r}")
        numbers = numeric_columns(df)
        return cap(df, iqr_bounds(df, numbers) if cap_method == "iqr" else std_bounds(df, numbers))
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    mask = outlier_mask(std_bounds(df, _usable(df, columns), threshold))
    return df.filter(~mask) if strategy == "remove" else replace_rows(df, mask, replace_value)
