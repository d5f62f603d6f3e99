"""Targets: the modelling table and the kind of task its targets call for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.columns import aggregate_once, as_list, category_columns, choose_targets, col, numeric_columns
from tabspark.functions.order_stats import bucket_count, with_range_bucket

REGRESSION, CLASSIFICATION = "regression", "classification"
# share of distinct values that decides the task, and the step tolerance (fixed values)
MANY_DISTINCT, FEW_DISTINCT, STEP_TOLERANCE = 0.5, 0.05, 1e-8


class TaskError(ValueError):
    """Targets that no single task fits."""


@dataclass(frozen=True)
class ModelTable:
    df: DataFrame
    features: list[str]
    targets: list[str]
    task: str


def x_y(df: DataFrame, targets, task: str | None = None, keep=None) -> ModelTable:
    """Rows with all targets present; text features as categories, numeric features as doubles,
    dates and nested features as they are.

    ``keep`` names key columns that travel along without being features.
    """
    targets = choose_targets(df, targets)
    kept = as_list(keep)
    present = df.dropna(subset=targets)
    if present.isEmpty():
        raise TaskError(f"no row has all of the targets {targets}")
    numbers, texts = set(numeric_columns(df)), set(category_columns(df))
    features = [c for c in df.columns if c not in targets and c not in kept]
    table = present.select(
        *[col(k) for k in kept],
        *[(col(c).cast("double") if c in numbers else col(c).cast("string") if c in texts else col(c)).alias(c) for c in features],
        *[col(t) for t in targets],
    )
    return ModelTable(table, features, targets, task or infer_task(present, targets))


def task_evidence(df: DataFrame, targets) -> DataFrame:
    """(y_name, y_type, unique_ratio, task, desc) per target."""
    targets = choose_targets(df, targets)
    numbers = set(numeric_columns(df))
    facts = aggregate_once(df, {
        **{("n", t): F.count(col(t)) for t in targets},
        **{("u", t): F.count_distinct(col(t)) for t in targets},
    })
    rows = []
    for t in targets:
        kind = df.schema[t].dataType.simpleString()
        n, distinct = facts["n", t], facts["u", t]
        ratio = distinct / n if n else 0.0
        if t not in numbers:
            task, why = CLASSIFICATION, "text target"
        elif ratio >= MANY_DISTINCT:
            task, why = REGRESSION, "many distinct values"
        elif ratio < FEW_DISTINCT:
            task, why = CLASSIFICATION, "few distinct values"
        else:
            task, why = _by_steps(df, t)
        rows.append((t, kind, round(ratio, 4), task, why))
    return df.sparkSession.createDataFrame(rows, "y_name string, y_type string, unique_ratio double, task string, desc string")


def _by_steps(df: DataFrame, target: str) -> tuple[str, str]:
    """Gaps between neighbouring distinct values, found inside range buckets and at their borders."""
    values = df.select(col(target).cast("double").alias("v")).filter("v IS NOT NULL").distinct()
    bucketed = with_range_bucket(values, [], "v", bucket_count(values.count()))
    inner = bucketed.withColumn("gap", F.col("v") - F.lag("v").over(Window.partitionBy("__bucket").orderBy("v")))
    edges = bucketed.groupBy("__bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    borders = edges.select((F.col("lo") - F.lag("hi").over(Window.partitionBy(F.lit(0)).orderBy("__bucket"))).alias("gap"))
    gaps = inner.select("gap").unionByName(borders).filter("gap IS NOT NULL")
    off = F.least(F.pmod("gap", F.lit(1.0)), 1 - F.pmod("gap", F.lit(1.0)))
    facts = aggregate_once(gaps, {
        "fractional": F.count(F.when(off > STEP_TOLERANCE, 1)),
        "not_one": F.count(F.when(F.abs(F.col("gap") - 1) > STEP_TOLERANCE, 1)),
    })
    if facts["fractional"]:
        return REGRESSION, "fractional steps"
    if facts["not_one"] == 0:
        return CLASSIFICATION, "consecutive whole numbers"
    return REGRESSION, "uneven whole steps"


def infer_task(df: DataFrame, targets) -> str:
    tasks = {r["task"] for r in task_evidence(df, targets).collect()}  # one row per target
    if len(tasks) != 1:
        raise TaskError(f"targets {as_list(targets)} call for different tasks: {sorted(tasks)}")
    return tasks.pop()


def subtask(df: DataFrame, targets, task: str, boosted: bool = False) -> str:
    """regression / multi-regression / binary / multiclass / multilabel."""
    targets = choose_targets(df, targets)
    if task == REGRESSION:
        return "regression" if len(targets) == 1 else "multi-regression"
    if len(targets) > 1:
        if boosted:
            raise TaskError("boosted trees take one classification target at a time")
        return "multilabel"
    levels = df.agg(F.count_distinct(col(targets[0]))).first()[0]
    return "binary" if levels == 2 else "multiclass"
