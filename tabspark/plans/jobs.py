"""End-to-end jobs: files or tables in, named result tables out."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.columns import as_list, category_columns, choose_targets, numeric_columns
from tabspark.operators import charts, diagnose, effects, folds as fold_ops, metrics, search, shap, training
from tabspark.operators.models import FoldModel, ModelSpec, load_models, save_model
from tabspark.operators.profile import profile
from tabspark.operators.target import CLASSIFICATION, REGRESSION, infer_task, subtask, task_evidence, x_y
from tabspark.session import materialize
from tabspark.sources import runlog
from tabspark.sources.readers import load_file, load_report, tidy_on_load

log = logging.getLogger(__name__)

Source = str | DataFrame


def _table(spark: SparkSession, source: Source, tidy: bool = True, **options) -> DataFrame:
    df = load_file(spark, source, **options) if isinstance(source, str) else source
    return tidy_on_load(df) if tidy else df


def data_profile(spark: SparkSession, source: Source, skip: Sequence[str] = (), **options) -> dict[str, DataFrame]:
    """Profile, distributions and box statistics over one checkpointed scan; ``skip`` leaves parts out."""
    raw = load_file(spark, source, **options) if isinstance(source, str) else source
    df = materialize(tidy_on_load(raw))
    out: dict[str, DataFrame] = {}
    if "load" not in skip:
        out["load_report"] = load_report(raw, df)
    if "profile" not in skip:
        out["profile"] = profile(df)
    if numeric_columns(df):
        if "distribution" not in skip:
            out.update(charts.numeric_quality(df))
        if "box" not in skip:
            out["box_stats"] = charts.box_stats(df)
            out["box_outliers"] = charts.box_outliers(df)
    return out


def eda(spark: SparkSession, source: Source, target: str | Sequence[str], cat_cols=None, corr_method: str = "spearman", top_k: int = 9,
        lowess_frac: float = 0.3, **options) -> dict[str, DataFrame]:
    """Everything about how columns relate to the targets; a branch that does not fit the target is left out."""
    df = materialize(_table(spark, source, **options))
    targets = choose_targets(df, target)
    numbers = [t for t in targets if t in numeric_columns(df)]
    texts = [t for t in targets if t not in numbers]
    cats = as_list(cat_cols) or [c for c in category_columns(df) if c not in targets]
    features = [c for c in numeric_columns(df) if c not in targets]
    out: dict[str, DataFrame] = {}
    if cats:
        out["effect_size"] = effects.effect_size(df, targets, cats)
    if features:
        out["correlation"] = charts.correlation_heatmap(df, targets, corr_method)
    if numbers and features:
        out["trend"] = charts.target_trend(df, numbers, top_k=top_k, method=corr_method)
        out["trend_lines"] = charts.trend_lines(out["trend"], lowess_frac)
    if texts and features:
        out["separation"] = charts.target_separation(df, texts)
    if numbers and cats:
        out["effect"] = charts.target_effect(df, numbers, cats)
    if texts and cats:
        out["association"] = charts.target_association(df, texts, cats)
    return out


def infer_task_type(spark: SparkSession, source: Source, target, **options) -> dict[str, Any]:
    """{task, subtask, evidence} of the targets."""
    df = _table(spark, source, tidy=False, **options)
    targets = choose_targets(df, target)
    present = df.dropna(subset=targets)
    task = infer_task(present, targets)
    return {"task": task, "subtask": subtask(present, targets, task), "evidence": task_evidence(present, targets)}


def modeling(spark: SparkSession, source: Source, targets, key, specs: Sequence[ModelSpec], *, clean: Sequence[Callable[[DataFrame], DataFrame]] = (),
             make_folds: Callable[..., fold_ops.Folds] | None = None, transforms=(), task: str | None = None, space: Mapping[str, Mapping[str, Any]] | None = None,
             n_trials: int = 0, scoring: str | None = None, out_dir: str | None = None, experiment: str = "default", parallelism: int = 2,
             keep_columns=(), **options) -> dict[str, Any]:
    """Load, clean, split, train every model and compare them.

    ``make_folds`` is called with the table (default: five folds by key).  With ``space`` (per model name)
    and ``n_trials`` the parameters are tuned first.  With ``out_dir`` models, tables and run rows are kept.
    """
    df = _table(spark, source, **options)
    for step in clean:
        df = step(df)
    table = x_y(df, targets, task, keep=[*as_list(key), *as_list(keep_columns)])
    folds = (make_folds or (lambda d: fold_ops.k_fold(d, key, 5)))(table.df)
    out: dict[str, Any] = {"task": table.task, "folds": folds.summary(), "models": {}, "runs": {}}
    results = {}
    for spec in specs:
        if space and space.get(spec.label) and n_trials > 0:
            tuned = training.tune(table, folds, spec, space[spec.label], n_trials, scoring, transforms, parallelism)
            spec = tuned.best
            out.setdefault("trials", {})[spec.label] = tuned.trials
        result = training.cross_validate(table, folds, spec, transforms, parallelism=parallelism)
        results[spec.label] = result
        out["models"][spec.label] = result.models
        if out_dir:
            out["runs"][spec.label] = _keep_run(spark, out_dir, experiment, spec, result, parallelism)
    predictions = diagnose.predictions_long({k: r.predictions for k, r in results.items()})
    out["predictions"] = predictions
    scores = metrics.metrics_long(metrics.evaluate(predictions, table.task))
    out["metrics"] = scores
    out["ranking"] = metrics.overall_metric(scores, scoring, task=table.task)
    if table.task == REGRESSION:
        out["scatter"] = diagnose.prediction_scatter_stats(predictions)
        out["errors"] = diagnose.error_distribution(predictions, ("model", "y_name"))
        if len(results) > 1:
            out["taylor"] = diagnose.taylor_stats(predictions)
    else:
        out["confusion"] = diagnose.confusion_matrix(predictions)
    if out_dir:
        runlog.write_table(predictions, f"{out_dir}/{experiment}", "prediction", partition_by=["model", "fold"])
    return out


def _keep_run(spark: SparkSession, out_dir: str, experiment: str, spec: ModelSpec, result: training.CVResult, parallelism: int) -> str:
    long = result.long_metrics()
    means = {f"{r['y_name']}.{r['metric']}": r["value"] for r in long.groupBy("y_name", "metric").agg(F.avg("value").alias("value")).collect()}
    run_id = f"{experiment}-{spec.label}-{uuid.uuid4().hex[:12]}"
    for m in result.models:
        save_model(m, f"{out_dir}/models", run_id)
    runlog.append_run(spark, f"{out_dir}/runs", experiment, "model", spec.label, params=spec.settings, metrics=means, run_id=run_id)
    return run_id


def explanation(models: Sequence[FoldModel], rows_of_fold: Callable[[int], DataFrame], key, top_n: int = 10, output: str | None = None,
                y_name: str | None = None) -> dict[str, DataFrame]:
    """Contributions of trained fold models, their ranking and their dependence tables."""
    values = materialize(shap.explain_folds(models, rows_of_fold, key))
    long = shap.shap_long(values, key)
    dependence = shap.shap_dependence(values, key, top_n, output=output, y_name=y_name)
    return {"shap": values, "summary": shap.shap_summary(long), "points": dependence.points, "line": dependence.line, "turns": dependence.turns}


def predict(spark: SparkSession, source: Source, root: str, run_id: str, flavor: str, out_dir: str | None = None, **options) -> DataFrame:
    """Score a table with the fold ensemble of a stored run."""
    df = _table(spark, source, tidy=False, **options)
    out = training.ensemble_predict(load_models(spark, root, run_id, flavor), df)
    if out_dir:
        return spark.read.parquet(runlog.write_table(out, out_dir, "prediction"))
    return out


def inverse_optimization(spark: SparkSession, source: Source | None, models: Sequence[FoldModel], directions: Mapping[str, str],
                         columns: Mapping[str, search.Range | search.Choice] | None = None, rule=None, n_trials: int = 10_000, seed: int = 42,
                         out_dir: str | None = None, **options) -> DataFrame:
    """Search space from a table, overridden per column, then the inverse search."""
    inputs = list(dict.fromkeys(c for m in models for c in m.x_names))
    space: dict[str, search.Range | search.Choice] = {}
    if source is not None:
        df = _table(spark, source, tidy=False, **options)
        space.update(search.infer_space(df, [c for c in inputs if c in df.columns]))
    space.update(columns or {})
    if not space:
        raise ValueError("nothing to search: give a table or column ranges")
    out = search.inverse_search(models, space, directions, rule, n_trials, seed=seed)
    if out_dir:
        return spark.read.parquet(runlog.write_table(out, out_dir, "search_results"))
    return out
