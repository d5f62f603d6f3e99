"""Cross-validated training, tuning, ensembles and importance."""

from __future__ import annotations

import logging
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.columns import SEED, as_list, col
from tabspark.functions.order_stats import with_global_rank
from tabspark.operators import metrics
from tabspark.operators.folds import Folds
from tabspark.operators.models import BOOSTED, FoldModel, ModelSpec, class_labels, fit_model, load_models
from tabspark.operators.parzen import propose
from tabspark.operators.search import Choice, Range
from tabspark.operators.target import CLASSIFICATION, REGRESSION, ModelTable
from tabspark.operators.transforms import fit_chain
from tabspark.session import materialize
from tabspark.sources import runlog

log = logging.getLogger(__name__)

# a fitter for one target: called with the training rows and the target name
TargetFitter = Callable[..., Any]


@dataclass
class CVResult:
    name: str
    task: str
    models: list[FoldModel]
    predictions: DataFrame

    def metrics(self) -> DataFrame:
        return metrics.evaluate(self.predictions, self.task)

    def long_metrics(self) -> DataFrame:
        return metrics.metrics_long(self.metrics())


def cross_validate(table: ModelTable, folds: Folds, spec: ModelSpec, transforms: Sequence[TargetFitter] = (), *,
                   parallelism: int = 2, kinds: Sequence[str] = ("test",), keep: Sequence[str] = (), only: Sequence[int] | None = None) -> CVResult:
    """One model per fold (those in ``only``) and target.  Transforms are fitted on the training rows of the fold only.

    Folds are trained from a small pool of driver threads so that the cluster stays busy.  Every fold
    reads the fold table, so it is persisted until the predictions are written; they are scored once and
    read from the shared checkpoint folder afterwards.
    ``transforms`` are functions (rows, target) -> Transform.
    """
    if spec.flavor == "LGBM" and len(table.targets) > 1:
        raise ValueError("this preset takes a single target")
    labels = {y: class_labels(table.df, y) for y in table.targets} if table.task == CLASSIFICATION else {}
    folds.persist()

    def one(job):
        fold, y = job
        train = folds.train(fold)
        train = train.drop(*[c for c in train.columns if c not in (*table.features, *table.targets, *folds.key)])
        chain, fitted = fit_chain(train, [lambda d, t=t: t(d, y) for t in transforms])
        val = folds.val(fold) if spec.flavor != "RF" else None  # for early stopping
        return fit_model(train, table.features, y, table.task, spec, chain, fitted, fold, labels.get(y), val)

    jobs = [(f, y) for f in (range(folds.n_folds) if only is None else only) for y in table.targets]
    try:
        with ThreadPool(max(1, min(parallelism, len(jobs)))) as pool:
            models = pool.map(one, jobs)
        predictions = materialize(fold_predictions(models, folds, kinds, keep))
    finally:
        folds.unpersist()
    return CVResult(spec.label, table.task, models, predictions)


def fold_predictions(models: Sequence[FoldModel], folds: Folds, kinds: Sequence[str] = ("test",), keep: Sequence[str] = ()) -> DataFrame:
    """(key..., model, fold, type, y_name, y, y_pred[, proba]): every fold model on its own rows."""
    parts = []
    for m in models:
        rows = folds.split(m.fold).filter(F.col("split").isin(list(kinds)))
        scored = m.score(rows, "__pred", "__proba")
        kind = "double" if m.task == REGRESSION else "string"
        proba = []
        if m.task == CLASSIFICATION:
            labels = F.array(*[F.lit(v) for v in m.labels])
            proba = [F.when(F.col("__proba").isNotNull(), F.map_from_arrays(labels, F.col("__proba"))).alias("proba")]
        parts.append(scored.select(
            *[col(k) for k in dict.fromkeys([*folds.key, *keep])], F.lit(m.name or m.flavor).alias("model"), F.lit(m.fold).alias("fold"),
            F.col("split").alias("type"), F.lit(m.y_name).alias("y_name"), col(m.y_name).cast(kind).alias("y"), F.col("__pred").cast(kind).alias("y_pred"), *proba))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@dataclass
class Tuning:
    best: ModelSpec
    score: float
    trials: DataFrame


def draw(space: Mapping[str, Any], rng: random.Random) -> dict[str, Any]:
    """One random setting; plain values stay as they are."""
    return {k: v.draw(rng) if isinstance(v, (Range, Choice)) else v for k, v in space.items()}


def tune(table: ModelTable, folds: Folds, spec: ModelSpec, space: Mapping[str, Any], n_trials: int = 20, scoring: str | None = None,
         transforms: Sequence[TargetFitter] = (), parallelism: int = 2, seed: int = SEED, startup: int = 10, halving: int = 0) -> Tuning:
    """Seeded trials, each scored by the mean over folds and targets.

    The first ``startup`` trials are random, later ones are proposed from the scores so far (``parzen``) in batches of
    ``parallelism``.  With ``halving`` = 2 or more, trials run in rounds of successive halving: all are scored on one fold, the best 1 / halving of
    them on ``halving`` times as many folds, until the rest have run on all; a trial that ended early is marked so and never wins.
    """
    metric = scoring or metrics.DEFAULT_METRIC[table.task]
    sign = 1 if metrics.lower_is_better(metric) else -1
    rng = random.Random(seed)

    def score(params, fold_range):
        part = cross_validate(table, folds, spec.with_params(**params), transforms, parallelism=1, only=fold_range)
        return metrics.overall_metric(part.long_metrics(), metric, task=table.task).first()["value"]

    tried: list[tuple[dict, float, int]] = []  # setting, score, folds it ran on

    def batch(settings):
        with ThreadPool(max(1, min(parallelism, len(settings)))) as pool:
            if halving < 2:
                return [(p, v, folds.n_folds) for p, v in zip(settings, pool.map(lambda p: score(p, range(folds.n_folds)), settings))]
            alive, sums, done, width = list(range(len(settings))), [0.0] * len(settings), 0, 1
            ended = {}
            while True:
                until = min(width, folds.n_folds)
                for i, v in zip(alive, pool.map(lambda i: score(settings[i], range(done, until)), alive)):
                    sums[i] += v * (until - done)
                done = until
                if done == folds.n_folds:
                    return [(p, sums[i] / ended.get(i, done), ended.get(i, done)) for i, p in enumerate(settings)]
                ranked = sorted(alive, key=lambda i: (sign * sums[i], i))
                keep = max(1, len(ranked) // halving)
                ended.update({i: done for i in ranked[keep:]})
                alive, width = sorted(ranked[:keep]), width * halving

    size = max(parallelism, halving**2) if halving >= 2 else max(1, parallelism)
    while len(tried) < n_trials:
        n = min(size if len(tried) >= startup else max(size, startup), n_trials - len(tried))
        known = [(p, sign * v) for p, v, _ in tried if not math.isnan(v)]
        settings = [draw(space, rng) for _ in range(n)] if len(tried) < startup or not known else propose(space, known, rng, n)
        tried += batch(settings)
    whole = [i for i, t in enumerate(tried) if t[2] == folds.n_folds]
    best = min(whole, key=lambda i: (sign * tried[i][1], i))
    rows = [(i, {k: str(v) for k, v in p.items()}, metric, float(s), n, n < folds.n_folds) for i, (p, s, n) in enumerate(tried)]
    trials = table.df.sparkSession.createDataFrame(rows, "trial int, params map<string,string>, metric string, value double, folds int, ended_early boolean")
    return Tuning(spec.with_params(**tried[best][0]), tried[best][1], trials)


def loss_curve(result: CVResult, folds: Folds, kinds: Sequence[str] = ("train", "val")) -> DataFrame | None:
    """(fold, type, y_name, iteration, loss) of boosted models and networks; forests have none.

    Training and validation losses are those of the training run, of every round that ran: early stopping keeps the rounds up to
    the best one, but the curve goes on.  Losses of test rows end with the rounds that were kept.
    """
    rows = []
    for m in result.models:
        final = m.model
        if m.flavor in BOOSTED and hasattr(final, "evaluateEachIteration"):
            noted = list(zip(("train", "val"), zip(*final.losses[1:])))  # the first loss is that of no tree
            rows += [(m.fold, kind, m.y_name, i, float(v)) for kind, values in noted for i, v in enumerate(values) if kind in kinds and v is not None]
            for kind in [k for k in kinds if k not in ("train", "val")]:
                ready = m.chain.apply(folds.test(m.fold))
                for stage in m.pipeline.stages[:-1]:
                    ready = stage.transform(ready)
                y = col(m.y_name).cast("double") if m.task == REGRESSION else \
                    (F.array_position(F.array(*[F.lit(v) for v in m.labels]), col(m.y_name).cast("string")) - 1).cast("double")
                ready = ready.withColumn("__label", y).select("__features", "__label")
                losses = final.evaluateEachIteration(ready, "squared") if m.task == REGRESSION else final.evaluateEachIteration(ready)
                rows += [(m.fold, kind, m.y_name, i, float(v)) for i, v in enumerate(losses)]
        elif m.flavor == "MLP":
            for kind, values in zip(("train", "val"), zip(*final.losses)):
                rows += [(m.fold, kind, m.y_name, i, float(v)) for i, v in enumerate(values) if kind in kinds and v is not None]
    if not rows:
        return None
    spark = SparkSession.getActiveSession()
    return spark.createDataFrame(rows, "fold int, type string, y_name string, iteration int, loss double")


def mean_loss(curve: DataFrame) -> DataFrame:
    return curve.groupBy("type", "y_name", "iteration").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("folds"))


def ensemble_predict(models: Sequence[FoldModel], df: DataFrame, suffix: str = "_pred") -> DataFrame:
    """``{target}_pred`` from all fold models of each target, in one pass over the rows.

    Regression: mean over folds.  Classification: class of the greatest mean probability, or the most
    frequent vote (smallest class on ties) if a fold has no probabilities.  Row-wise, so streams work.
    """
    by_target: dict[str, list[FoldModel]] = {}
    for m in models:
        by_target.setdefault(m.y_name, []).append(m)
    out, names = df, list(df.columns)
    for y, group in by_target.items():
        for i, m in enumerate(group):
            out = m.score(out, f"__p{i}", f"__q{i}" if m.task == CLASSIFICATION else None)
        k = len(group)
        if group[0].task == REGRESSION:
            value = sum((F.col(f"__p{i}") for i in range(1, k)), F.col("__p0")) / k
        else:
            labels = F.array(*[F.lit(v) for v in group[0].labels])
            width = range(len(group[0].labels))
            mean = F.array(*[sum((F.col(f"__q{i}")[j] for i in range(1, k)), F.col("__q0")[j]) / k for j in width])
            by_chance = F.element_at(labels, F.array_position(mean, F.array_max(mean)).cast("int"))
            votes = F.array(*[sum(((F.col(f"__p{i}") == F.lit(v)).cast("int") for i in range(1, k)), (F.col("__p0") == F.lit(v)).cast("int")) for v in group[0].labels])
            by_vote = F.element_at(labels, F.array_position(votes, F.array_max(votes)).cast("int"))
            all_known = F.lit(True)
            for i in range(k):
                all_known = all_known & F.col(f"__q{i}").isNotNull()
            value = F.when(all_known, by_chance).otherwise(by_vote)
        names.append(f"{y}{suffix}")
        out = out.withColumn(f"{y}{suffix}", value).select(*[col(c) for c in names])
    return out


def feature_importance(models: Sequence[FoldModel]) -> DataFrame | None:
    """(model, fold, y_name, feature, importance) of tree models."""
    rows = []
    for m in models:
        found = getattr(m.model, "featureImportances", None)
        if found is not None:
            rows += [(m.name or m.flavor, m.fold, m.y_name, f, float(v)) for f, v in zip(m.inputs, found.toArray())]
    if not rows:
        return None
    return SparkSession.getActiveSession().createDataFrame(rows, "model string, fold int, y_name string, feature string, importance double")


def permutation_importance(model: FoldModel, df: DataFrame, key, metric: str | None = None, n_repeats: int = 30, seed: int = SEED) -> DataFrame:
    """(feature, importance, std): loss of score when one feature is shuffled.

    Rows get one seeded rank.  A repeat gives every row the values of the row a seeded number of ranks further on (round
    the end), another number in each repeat; all repeats and features are scored in one pass, so the number of jobs does not depend on
    ``n_repeats``.  With more repeats than rows less one, shifts come again.
    """
    key = as_list(key)
    metric = metric or metrics.DEFAULT_METRIC[model.task]
    sign = 1.0 if metrics.lower_is_better(metric) else -1.0
    base = df.filter(col(model.y_name).isNotNull()).select(*[col(k) for k in key], *[col(c) for c in model.x_names if c not in key], col(model.y_name))
    n = base.count()
    rng = random.Random(seed)
    shifts = rng.sample(range(1, n), min(n_repeats, n - 1)) if n > 1 else [0]
    shifts = [shifts[i % len(shifts)] for i in range(n_repeats)]
    ranked = materialize(with_global_rank(base, key, seed=seed, rows=n, out="__rank"))
    donor = ranked.select(F.col("__rank").alias("__rank2"), F.struct(*[col(c) for c in model.x_names]).alias("__other"))
    repeats = F.explode(F.array(*[F.struct(F.lit(r).alias("fold"), F.lit(s).cast("bigint").alias("shift")) for r, s in enumerate(shifts)]))
    wanted = ranked.withColumn("__repeat", repeats).withColumn("__rank2", F.pmod(F.col("__rank") + F.col("__repeat.shift"), F.lit(max(n, 1))))
    joined = wanted.join(donor, "__rank2")

    def variant(feature):
        return F.struct(F.lit(feature).alias("y_name"), *[(F.col("__other")[c] if c == feature else col(c)).alias(c) for c in model.x_names])

    rows = joined.select(col(model.y_name).alias("y"), F.col("__repeat.fold").alias("fold"), F.inline(F.array(variant(""), *[variant(c) for c in model.x_names])))
    kind = "double" if model.task == REGRESSION else "string"
    scored = model.score(rows, "y_pred").select(
        F.lit("m").alias("model"), "fold", F.lit("test").alias("type"), "y_name", F.col("y").cast(kind).alias("y"), F.col("y_pred").cast(kind).alias("y_pred"))
    found = metrics.metrics_long(metrics.evaluate(scored, model.task)).filter(F.col("metric") == metric)
    plain = found.filter("y_name = ''").select("fold", F.col("value").alias("plain"))
    loss = found.filter("y_name <> ''").join(F.broadcast(plain), "fold").select(F.col("y_name").alias("feature"), (sign * (F.col("value") - F.col("plain"))).alias("loss"))  # a row per repeat
    return loss.groupBy("feature").agg(F.avg("loss").alias("importance"), F.stddev_pop("loss").alias("std"))


def reuse_or_train(runs: DataFrame, experiment: str, specs: Sequence[ModelSpec], root: str, train: Callable[[ModelSpec], Sequence[FoldModel]],
                   prune_missing: bool = False) -> dict[str, list[FoldModel]]:
    """Models of finished runs are loaded; the others are trained, or left out with ``prune_missing``."""
    spark = runs.sparkSession
    done = {r["module"]: r["run_id"] for r in runlog.finished_models(runs, experiment).collect()}  # one row per model
    out: dict[str, list[FoldModel]] = {}
    for spec in specs:
        if spec.label in done:
            out[spec.label] = load_models(spark, root, done[spec.label], spec.flavor)
        elif prune_missing:
            log.info("%s has no finished run and is left out", spec.label)
        else:
            out[spec.label] = list(train(spec))
    return out
