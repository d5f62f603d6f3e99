"""Scores from the long prediction table (model, fold, type, y_name, y, y_pred[, proba]).

Everything is an aggregate over the four group columns, so models, folds and targets are scored
together in one pass.  ``proba`` is a map from class label to probability.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.columns import as_list
from tabspark.functions.order_stats import ranked_counts

GROUP = ["model", "fold", "type", "y_name"]
EPS = sys.float_info.epsilon  # floor of denominators and probabilities (fixed value)
REGRESSION_METRICS = ("mae", "rmse", "r2", "mape")
CLASS_METRICS = ("accuracy", "precision", "recall", "f1", "auc_roc", "log_loss")
LOWER_IS_BETTER = {"mae", "rmse", "mape", "log_loss"}
DEFAULT_METRIC = {"regression": "mae", "classification": "f1"}


def lower_is_better(metric: str) -> bool:
    if metric not in REGRESSION_METRICS + CLASS_METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return metric in LOWER_IS_BETTER


def regression_metrics(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    y, p = F.col("y").cast("double"), F.col("y_pred").cast("double")
    error = p - y
    sums = predictions.groupBy(*(by or GROUP)).agg(
        F.avg(F.abs(error)).alias("mae"), F.avg(error * error).alias("__mse"), F.var_pop(y).alias("__var"),
        F.avg(F.abs(error) / F.greatest(F.abs(y), F.lit(EPS))).alias("mape"), F.count(error).alias("__n"),
    )
    flat = F.when(F.col("__mse") == 0, 1.0).otherwise(0.0)
    r2 = F.when(F.col("__n") >= 2, F.when(F.col("__var") == 0, flat).otherwise(1 - F.col("__mse") / F.nullif(F.col("__var"), F.lit(0.0))))
    return sums.select(*(by or GROUP), "mae", F.sqrt("__mse").alias("rmse"), r2.alias("r2"), "mape")


def confusion_counts(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    return predictions.groupBy(*(by or GROUP), F.col("y").cast("string").alias("y"), F.col("y_pred").cast("string").alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))


def label_metrics(predictions: DataFrame) -> DataFrame:
    """accuracy and support-weighted precision, recall, f1 (0 where a class is never predicted)."""
    cells = confusion_counts(predictions)
    hit = F.when(F.col("y") == F.col("y_pred"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    roles = F.array(
        F.struct(F.col("y").alias("label"), F.col("n").alias("support"), none.alias("predicted"), hit.cast("long").alias("tp")),
        F.struct(F.col("y_pred").alias("label"), none.alias("support"), F.col("n").alias("predicted"), none.alias("tp")),
    )
    classes = cells.select(*GROUP, F.inline(roles)).groupBy(*GROUP, "label").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    def rate(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    s = F.col("support")
    precision, recall = rate(F.col("tp"), F.col("predicted")), rate(F.col("tp"), s)
    f1 = rate(2.0 * F.col("tp"), s + F.col("predicted"))
    return classes.groupBy(*GROUP).agg(
        (F.sum("tp") / F.sum(s)).alias("accuracy"), (F.sum(s * precision) / F.sum(s)).alias("precision"),
        (F.sum(s * recall) / F.sum(s)).alias("recall"), (F.sum(s * f1) / F.sum(s)).alias("f1"))


def log_loss(predictions: DataFrame) -> DataFrame:
    total = F.aggregate(F.map_values("proba"), F.lit(0.0), lambda acc, x: acc + x)
    p = F.coalesce(F.col("proba")[F.col("y").cast("string")], F.lit(0.0)) / total
    scored = predictions.filter("proba IS NOT NULL")
    return scored.groupBy(*GROUP).agg(F.avg(-F.ln(F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS)))).alias("log_loss"))


def auc_roc(predictions: DataFrame, rows: int | None = None) -> DataFrame:
    """Exact rank-sum AUC; several classes one against the rest, weighted by support.

    Ranks come from score counts in range buckets, so a score shared by many rows is one row.
    """
    y = F.col("y").cast("string")
    classes = F.map_keys("proba")
    # of two classes only the last one is scored
    scored_classes = F.when(F.size(classes) == 2, F.array(F.array_max(classes))).otherwise(classes)
    cells = predictions.filter("proba IS NOT NULL").select(
        *GROUP, y.alias("__y"), F.col("proba"), F.explode(scored_classes).alias("label"))
    cells = cells.select(*GROUP, "label", F.col("proba")[F.col("label")].alias("score"), (F.col("__y") == F.col("label")).cast("long").alias("hit"))
    ranked = ranked_counts(cells, [*GROUP, "label"], "score", rows=rows, carry={"hits": F.sum("hit")})
    middle = F.col("before") + (F.col("cnt") + 1) / 2
    per_class = ranked.groupBy(*GROUP, "label").agg(
        F.sum(F.col("hits") * middle).alias("r"), F.sum("hits").cast("double").alias("pos"), F.max("total").cast("double").alias("n"))
    neg = F.col("n") - F.col("pos")
    auc = (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2) / F.nullif(F.col("pos") * neg, F.lit(0.0))
    scored = per_class.withColumn("auc", auc).filter("auc IS NOT NULL")
    return scored.groupBy(*GROUP).agg((F.sum(F.col("auc") * F.col("pos")) / F.sum("pos")).alias("auc_roc"))


def classification_metrics(predictions: DataFrame, rows: int | None = None) -> DataFrame:
    labels = label_metrics(predictions)
    if "proba" not in predictions.columns:
        return labels
    return labels.join(auc_roc(predictions, rows), GROUP, "left").join(log_loss(predictions), GROUP, "left")


def evaluate(predictions: DataFrame, task: str, rows: int | None = None) -> DataFrame:
    return regression_metrics(predictions) if task == "regression" else classification_metrics(predictions, rows)


def metrics_long(wide: DataFrame) -> DataFrame:
    """(model, fold, type, y_name, metric, value)."""
    names = [c for c in wide.columns if c not in GROUP]
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])
    return wide.select(*GROUP, F.inline(cells)).filter("value IS NOT NULL")


def overall_metric(long: DataFrame, metric: str | None = None, targets=None, task: str = "regression", kind: str = "test") -> DataFrame:
    """(model, metric, value): mean over folds and chosen targets."""
    metric = metric or DEFAULT_METRIC[task]
    lower_is_better(metric)
    picked = long.filter((F.col("metric") == metric) & (F.col("type") == kind))
    wanted = as_list(targets)
    known = {r["y_name"] for r in picked.select("y_name").distinct().collect()}  # one row per target
    if not known:
        raise ValueError(f"no metric {metric!r} in these results")
    absent = [t for t in wanted if t not in known]
    if absent:
        raise ValueError(f"no results for targets {absent}")
    if wanted:
        picked = picked.filter(F.col("y_name").isin(wanted))
    return picked.groupBy("model", "metric").agg(F.avg("value").alias("value"))
