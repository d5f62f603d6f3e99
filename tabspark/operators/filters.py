"""Column and row filters: by name, null rate, variance and correlation."""

from __future__ import annotations

import logging
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.columns import aggregate_once, as_list, choose_numeric, col, numeric_columns

log = logging.getLogger(__name__)


def common_filter(df: DataFrame, drop=None, remain=None) -> DataFrame:
    """Drop first, then keep; unknown names are ignored (missing ``remain`` names are logged)."""
    dropped = set(as_list(drop))
    left = [c for c in df.columns if c not in dropped]
    if remain is not None:
        wanted = as_list(remain)
        absent = [c for c in wanted if c not in left]
        if absent:
            log.warning("columns to keep are not there: %s", absent)
        left = [c for c in wanted if c in left]
    return df.select(*[col(c) for c in left])


def drop_missing(df: DataFrame, threshold: float = 0.6, column_threshold: Mapping[str, float] | None = None,
                 exclude=None) -> DataFrame:
    """Drop columns whose null rate reaches the gate; a gate outside [0, 1) never drops."""
    gates = {c: (column_threshold or {}).get(c, threshold) for c in df.columns if c not in as_list(exclude)}
    gates = {c: g for c, g in gates.items() if 0 <= g < 1}
    rates = aggregate_once(df, {c: F.avg(col(c).isNull().cast("double")) for c in gates})
    gone = {c for c, r in rates.items() if r is not None and r >= gates[c]}
    return df.select(*[col(c) for c in df.columns if c not in gone])


def _check_gates(threshold: float, overrides: Mapping | None) -> None:
    if threshold < 0 or any(v < 0 for v in (overrides or {}).values()):
        raise ValueError("variance thresholds must not be negative")


def variance_filter(df: DataFrame, threshold: float = 0.0, column_thresholds: Mapping[str, float] | None = None) -> DataFrame:
    """Drop numeric columns with sample variance below the gate or undefined; other columns come first."""
    _check_gates(threshold, column_thresholds)
    numbers = numeric_columns(df)
    variance = aggregate_once(df, {c: F.var_samp(col(c).cast("double")) for c in numbers})
    gate = {c: (column_thresholds or {}).get(c, threshold) for c in numbers}
    kept = [c for c in numbers if variance[c] is not None and variance[c] >= gate[c]]
    return df.select(*[col(c) for c in df.columns if c not in numbers], *[col(c) for c in kept])


def row_variance(columns: list[str]) -> Column:
    """Sample variance across the non-null cells of one row (null for fewer than two)."""
    cells = F.filter(F.array(*[col(c).cast("double") for c in columns]), lambda x: x.isNotNull())
    n = F.size(cells)
    mean = F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + x) / n
    squares = F.aggregate(cells, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(n >= 2, squares / (n - 1))


def row_variance_filter(df: DataFrame, threshold: float = 0.0, row_thresholds: Mapping | None = None,
                        key: str | None = None) -> DataFrame:
    """Drop rows whose variance across numeric columns is below the gate; ``key`` names rows with their own gate."""
    _check_gates(threshold, row_thresholds)
    gate = F.lit(float(threshold))
    if row_thresholds:
        if key is None:
            raise ValueError("row_thresholds need the key column they refer to")
        gate = F.coalesce(F.create_map(*[F.lit(x) for kv in row_thresholds.items() for x in (kv[0], float(kv[1]))])[col(key)], gate)
    cells = [c for c in numeric_columns(df) if c != key]
    return df.filter(row_variance(cells) >= gate)


def correlation_filter(df: DataFrame, threshold: float = 0.9, method: str = "spearman", priority_features=None,
                       exclude=None) -> DataFrame:
    """Of every highly correlated pair keep one column.

    Pairs are visited from the strongest down; a priority feature stays, else the larger variance.
    The pass runs over the p x p matrix; the data is only aggregated.
    """
    from tabspark.operators.correlation import correlation_long

    excluded = set(as_list(exclude))
    priority = set(as_list(priority_features))
    numbers = [c for c in numeric_columns(df) if c not in excluded]
    gone: set[str] = set()
    if len(numbers) > 1:
        variance = aggregate_once(df, {c: F.var_samp(col(c).cast("double")) for c in numbers})
        order = {c: i for i, c in enumerate(numbers)}
        pairs = [
            (r["col_a"], r["col_b"], abs(r["r"]))
            for r in correlation_long(df, numbers, method=method).filter(F.abs("r") >= threshold).collect()
            if order[r["col_a"]] < order[r["col_b"]]
        ]
        for a, b, _ in sorted(pairs, key=lambda t: (-t[2], order[t[0]], order[t[1]])):
            if a in gone or b in gone:
                continue
            if (a in priority) != (b in priority):
                loser = b if a in priority else a
            else:
                loser = a if (variance[b] or 0.0) > (variance[a] or 0.0) else b
            gone.add(loser)
    others = [c for c in df.columns if c not in numbers]
    return df.select(*[col(c) for c in others], *[col(c) for c in numbers if c not in gone])


def clean_report(before: DataFrame, after: DataFrame, key: str | list[str]) -> DataFrame:
    """(change, key, column, before, after): rows and columns that came or went, and changed cells.

    One full outer join on the key; with equal shapes the common cells are compared.
    """
    keys = as_list(key)
    shared = [c for c in before.columns if c in after.columns and c not in keys]
    def side(d, tag):
        return d.select(
            *[col(k).alias(f"__{tag}k{i}") for i, k in enumerate(keys)],
            F.lit(True).alias(f"__{tag}"),
            *[col(c).cast("string").alias(f"__{tag}{i}") for i, c in enumerate(shared)],
        )
    left, right = side(before, "l"), side(after, "r")
    on = [left[f"__lk{i}"].eqNullSafe(right[f"__rk{i}"]) for i in range(len(keys))]
    both = left.join(right, on, "full_outer")
    name = F.concat_ws("|", *[F.coalesce(F.col(f"__lk{i}"), F.col(f"__rk{i}")).cast("string") for i in range(len(keys))])
    null = F.lit(None).cast("string")
    def event(kind, column=null, old=null, new=null):
        return F.struct(F.lit(kind).alias("change"), name.alias("key"), column.alias("column"), old.alias("before"), new.alias("after"))
    events = [
        F.when(F.col("__r").isNull(), event("row_removed")),
        F.when(F.col("__l").isNull(), event("row_added")),
        *[
            F.when(F.col("__l") & F.col("__r") & ~F.col(f"__l{i}").eqNullSafe(F.col(f"__r{i}")),
                   event("cell_changed", F.lit(c), F.col(f"__l{i}"), F.col(f"__r{i}")))
            for i, c in enumerate(shared)
        ],
    ]
    rows = both.select(F.inline(F.filter(F.array(*events), lambda e: e.isNotNull())))
    columns = [("column_removed", c) for c in before.columns if c not in after.columns]
    columns += [("column_added", c) for c in after.columns if c not in before.columns]
    if not columns:
        return rows
    extra = before.sparkSession.createDataFrame(
        [(kind, None, c, None, None) for kind, c in columns], "change string, key string, column string, before string, after string")
    return rows.unionByName(extra)


def shape_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """(side, rows, columns) of two tables."""
    def one(d, tag):
        return d.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(tag).alias("side"), "rows", F.lit(len(d.columns)).cast("long").alias("columns"))
    return one(before, "before").unionByName(one(after, "after"))


def strip_units(df: DataFrame, units: Mapping[str, str]) -> DataFrame:
    """``col`` with unit text becomes the number column ``col(unit)``.

    Trailing characters that belong to the unit are cut, blanks trimmed, and what is no number is null.
    """
    from tabspark.columns import require

    require(df, list(units), "unit columns")
    numbers = set(numeric_columns(df))
    out = []
    for c in df.columns:
        if c not in units:
            out.append(col(c))
            continue
        value = col(c) if c in numbers else F.trim(F.rtrim(col(c), F.lit(units[c]))).try_cast("double")
        out.append(value.alias(f"{c}({units[c]})"))
    return df.select(*out)


def selected_numeric(df: DataFrame, names=None) -> DataFrame:
    return df.select(*[col(c) for c in choose_numeric(df, names)])
