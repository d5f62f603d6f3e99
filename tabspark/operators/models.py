"""Spark ML models behind one interface: raw feature columns in, prediction and class probabilities out."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.columns import SEED, aggregate_once, category_columns, col, numeric_columns
from tabspark.operators import boosting, perceptron
from tabspark.operators.target import CLASSIFICATION, REGRESSION
from tabspark.operators.transforms import BUILDERS, Chain, TargetEncoding, Transform, builder

FLAVORS = ("RF", "XGB", "LGBM", "CAT", "MLP")
BOOSTED = ("XGB", "LGBM", "CAT")
MAX_LEVELS = 10_000  # default of the documented limit on levels of a text feature
MAX_CLASSES = 1_000
MISSING = "__missing__"

# starting values of each preset (fixed values)
DEFAULTS: dict[str, dict[str, Any]] = {
    "RF": {"n_estimators": 100, "max_depth": 8, "min_samples_leaf": 1, "max_features": "sqrt", "max_samples": 0.8, "max_bin": 256},
    "XGB": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 6, "min_child_weight": 1, "subsample": 1.0, "colsample_bytree": 1.0, "colsample_bylevel": 1.0,
            "gamma": 0.0, "reg_alpha": 0.0, "reg_lambda": 1.0, "grow_policy": "depthwise", "max_leaves": None, "max_bin": 256, "scale_pos_weight": 1.0, "early_stopping_rounds": 60},
    "LGBM": {"n_estimators": 100, "learning_rate": 0.1, "num_leaves": 31, "max_depth": -1, "min_child_samples": 20, "min_split_gain": 0.0, "path_smooth": 0.0, "subsample": 1.0,
             "colsample_bytree": 1.0, "colsample_bynode": 1.0, "reg_alpha": 0.0, "reg_lambda": 0.0, "max_bin": 255, "scale_pos_weight": 1.0, "early_stopping_rounds": 60},
    "CAT": {"n_estimators": 100, "learning_rate": 0.1, "depth": 6, "grow_policy": "SymmetricTree", "l2_leaf_reg": 3.0, "bootstrap_type": "Bayesian", "bagging_temperature": 1.0,
            "subsample": 1.0, "border_count": 254, "early_stopping_rounds": 60},
    "MLP": {"hidden": [64, 32], "activation": "relu", "dropout": 0.1, "optimizer": "adam", "learning_rate": 0.01, "weight_decay": 0.001, "epochs": 100, "batch_size": 32,
            "early_stopping_rounds": None},
}


@dataclass(frozen=True)
class ModelSpec:
    """A preset and its parameters; parameters not given take the preset's starting value."""

    flavor: str
    params: Mapping[str, Any] = field(default_factory=dict)
    seed: int = SEED
    name: str | None = None

    def __post_init__(self):
        if self.flavor not in FLAVORS:
            raise ValueError(f"unknown model {self.flavor!r}; known: {FLAVORS}")
        unknown = set(self.params) - set(DEFAULTS[self.flavor])
        if unknown:
            raise ValueError(f"{self.flavor} has no parameters {sorted(unknown)}; it has {sorted(DEFAULTS[self.flavor])}")

    @property
    def label(self) -> str:
        return self.name or self.flavor

    @property
    def settings(self) -> dict[str, Any]:
        return {**DEFAULTS[self.flavor], **self.params}

    def with_params(self, **params) -> ModelSpec:
        return ModelSpec(self.flavor, {**self.params, **params}, self.seed, self.name)


def random_forest(**params) -> ModelSpec:
    return ModelSpec("RF", params)


def gbt(preset: str = "xgb", **params) -> ModelSpec:
    return ModelSpec(preset.upper(), params)


def mlp(**params) -> ModelSpec:
    return ModelSpec("MLP", params)


def estimator(spec: ModelSpec, task: str, max_arity: int):
    """The Spark ML estimator of a preset; trees need as many bins as the widest category.

    The reference's forest may cut a number between any two values, Spark's between ``max_bin`` quantile bins.
    """
    s = spec.settings
    names = {"featuresCol": "__features", "labelCol": "__label"}
    bins = max(int(s["max_bin"]), max_arity + 1)
    if spec.flavor == "RF":
        kind = RandomForestRegressor if task == REGRESSION else RandomForestClassifier
        return kind(**names, numTrees=int(s["n_estimators"]), maxDepth=int(s["max_depth"]), minInstancesPerNode=int(s["min_samples_leaf"]),
                    featureSubsetStrategy=str(s["max_features"]), subsamplingRate=float(s["max_samples"]), maxBins=bins, seed=spec.seed)
    raise ValueError(f"{spec.flavor} has no estimator of the library: see boosting and perceptron")


def network_settings(spec: ModelSpec) -> perceptron.Settings:
    s = spec.settings
    stop = s["early_stopping_rounds"]
    return perceptron.Settings(tuple(map(int, s["hidden"])), str(s["activation"]), float(s["dropout"]), str(s["optimizer"]), float(s["learning_rate"]), float(s["weight_decay"]),
                               int(s["epochs"]), int(s["batch_size"]), stop and int(stop), spec.seed)


GROWTH = {"depthwise": "level", "lossguide": "leaf", "SymmetricTree": "symmetric", "Depthwise": "level", "Lossguide": "leaf"}


def boosting_settings(spec: ModelSpec) -> boosting.Settings:
    """What a boosted preset means: level by level, best first, or symmetric with ordered category statistics."""
    s = spec.settings
    common = {"n_estimators": int(s["n_estimators"]), "learning_rate": float(s["learning_rate"]), "subsample": float(s["subsample"]),
              "early_stopping_rounds": s["early_stopping_rounds"] and int(s["early_stopping_rounds"]), "seed": spec.seed}
    if spec.flavor == "LGBM":
        return boosting.Settings(growth="leaf", max_leaves=int(s["num_leaves"]), max_depth=max(0, int(s["max_depth"])), min_child_samples=int(s["min_child_samples"]),
                                 gamma=float(s["min_split_gain"]), path_smooth=float(s["path_smooth"]), colsample_bytree=float(s["colsample_bytree"]),
                                 colsample_bylevel=float(s["colsample_bynode"]), reg_alpha=float(s["reg_alpha"]), reg_lambda=float(s["reg_lambda"]), bins=int(s["max_bin"]),
                                 min_child_weight=1e-3, scale_pos_weight=float(s["scale_pos_weight"]), **common)
    if s["grow_policy"] not in GROWTH:
        raise ValueError(f"unknown grow_policy {s['grow_policy']!r}; known: {sorted(GROWTH)}")
    growth = GROWTH[s["grow_policy"]]
    if spec.flavor == "XGB":
        return boosting.Settings(growth=growth, max_depth=int(s["max_depth"]), max_leaves=int(s["max_leaves"] or 0), min_child_weight=float(s["min_child_weight"]),
                                 gamma=float(s["gamma"]), reg_alpha=float(s["reg_alpha"]), reg_lambda=float(s["reg_lambda"]), colsample_bytree=float(s["colsample_bytree"]),
                                 colsample_bylevel=float(s["colsample_bylevel"]), bins=int(s["max_bin"]), scale_pos_weight=float(s["scale_pos_weight"]), **common)
    if s["bootstrap_type"] not in ("Bayesian", "Bernoulli", "No"):
        raise ValueError(f"unknown bootstrap_type {s['bootstrap_type']!r}")
    common["subsample"] = common["subsample"] if s["bootstrap_type"] == "Bernoulli" else 1.0
    return boosting.Settings(growth=growth, max_depth=int(s["depth"]), max_leaves=31 if growth == "leaf" else 0, reg_lambda=float(s["l2_leaf_reg"]), bins=int(s["border_count"]), ordered=True,
                             bagging_temperature=float(s["bagging_temperature"]) if s["bootstrap_type"] == "Bayesian" else 0.0, **common)


def input_step(df: DataFrame, features: Sequence[str], max_levels: int = MAX_LEVELS) -> tuple[Transform, list[str], list[str]]:
    """Last step before the vector: numbers get their mean where missing, texts a level of their own.

    A text with more than ``max_levels`` levels is refused by name: tree bins grow with the levels, and whether to
    hash or encode such a column (``hash_encoder``, ``target_encoder``) is the caller's choice.
    """
    numbers = [f for f in features if f in numeric_columns(df)]
    texts = [f for f in features if f in category_columns(df)]
    facts = aggregate_once(df, {c: F.avg(col(c).cast("double")) for c in numbers})
    for c in texts:
        if df.select(col(c)).distinct().limit(max_levels + 1).count() > max_levels:
            raise ValueError(f"text feature {c} has more than {max_levels} levels: use hash_encoder or target_encoder, or raise max_levels")
    return _build_inputs({}, means={c: float(facts[c] or 0.0) for c in numbers}, texts=texts), numbers, texts


@builder
def _build_inputs(means, texts):
    exprs = {c: F.coalesce(col(c).cast("double"), F.lit(m)) for c, m in means.items()}
    return Transform(exprs | {c: F.coalesce(col(c).cast("string"), F.lit(MISSING)) for c in texts})


@dataclass
class FoldModel:
    """A model of one target fitted on one fold, with everything needed to score raw rows."""

    flavor: str
    fold: int
    y_name: str
    task: str
    chain: Chain
    pipeline: PipelineModel
    x_names: list[str]
    inputs: list[str]
    labels: list[str]
    schema: T.StructType
    name: str = ""

    @property
    def model(self):
        return self.pipeline.stages[-1]

    def features(self, df: DataFrame) -> DataFrame:
        return self.chain.apply(df)

    def score(self, df: DataFrame, pred: str = "y_pred", proba: str | None = None) -> DataFrame:
        """All columns of ``df`` plus the prediction (and the probability array in label order).

        The row travels as one struct beside the features, so scoring needs no join back.
        """
        held = df.select(F.struct(*[col(c) for c in df.columns]).alias("__row"), *[col(c) for c in self.x_names])
        out = self.pipeline.transform(self.chain.apply(held))
        chance = self._probability(out) if self.task == CLASSIFICATION else None
        if self.task == REGRESSION:
            value = F.col("prediction")
        else:
            value = F.element_at(F.array(*[F.lit(v) for v in self.labels]), F.col("prediction").cast("int") + 1)
        extra = [value.alias(pred)]
        if proba is not None:
            extra.append((chance if chance is not None else F.lit(None).cast("array<double>")).alias(proba))
        return out.select("__row", *extra).select("__row.*", *[F.col(pred)], *([F.col(proba)] if proba else []))

    def _probability(self, scored: DataFrame) -> Column | None:
        if "probability" not in scored.columns:
            return None
        p = F.col("probability")
        return p if isinstance(scored.schema["probability"].dataType, T.ArrayType) else vector_to_array(p)


def class_labels(df: DataFrame, y_name: str) -> list[str]:
    found = df.select(col(y_name).cast("string").alias("v")).filter("v IS NOT NULL").distinct().limit(MAX_CLASSES + 1).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{y_name} has more than {MAX_CLASSES} classes")
    values = [r["v"] for r in found]
    try:
        return sorted(values, key=float)
    except ValueError:
        return sorted(values)


def fit_model(train: DataFrame, features: Sequence[str], y_name: str, task: str, spec: ModelSpec, chain: Chain | None = None,
              fitted: DataFrame | None = None, fold: int = 0, labels: list[str] | None = None, val: DataFrame | None = None) -> FoldModel:
    """Fit on training rows.  ``fitted`` are the training rows after ``chain`` (cross-fitted encoders give
    them other values than ``chain.apply``).  Boosted trees stop early by the loss of the rows of ``val``;
    without them they run all their rounds."""
    chain = chain or Chain([])
    rows = chain.apply(train) if fitted is None else fitted
    dropped = set(train.columns) - set(features)
    usable = [c for c in rows.columns if c not in dropped and (c in numeric_columns(rows) or c in category_columns(rows))]
    last, numbers, texts = input_step(rows, usable)
    whole = Chain([*chain.steps, last])
    ready = last.apply(rows)
    labels = [] if task == REGRESSION else labels or class_labels(train, y_name)
    label = col(y_name).cast("double") if task == REGRESSION else \
        (F.array_position(F.array(*[F.lit(v) for v in labels]), col(y_name).cast("string")) - 1).cast("double")
    ready = ready.withColumn("__label", label)
    held = None if val is None else last.apply(chain.apply(val)).withColumn("__label", label)
    stages, arity, inputs = [], 0, []
    if texts:
        indexer = StringIndexer(inputCols=texts, outputCols=[f"__i_{t}" for t in texts], handleInvalid="keep", stringOrderType="alphabetAsc").fit(ready)
        stages.append(indexer)
        ready = indexer.transform(ready)
        held = None if held is None else indexer.transform(held)
        arity = max(len(v) for v in indexer.labelsArray) + 1
    inputs = [*numbers, *[f"__i_{t}" for t in texts]]
    if not inputs:
        raise ValueError("no usable feature columns")
    assembler = VectorAssembler(inputCols=inputs, outputCol="__features", handleInvalid="keep")
    stages.append(assembler)
    ready = assembler.transform(ready)
    n_classes = len(labels)
    if spec.flavor in BOOSTED and task == CLASSIFICATION and n_classes < 2:
        raise ValueError(f"{y_name} has a single class in fold {fold}")
    if spec.flavor in BOOSTED:
        levels = {f"__i_{t}": len(v) + 1 for t, v in zip(texts, indexer.labelsArray)} if texts else {}
        kind = "squared" if task == REGRESSION else "logistic" if n_classes == 2 else "softmax"
        fitted_model = boosting.fit(ready, inputs, levels, kind, n_classes if kind == "softmax" else 1, boosting_settings(spec), held)
    elif spec.flavor == "MLP":
        head = perceptron.Head("squared", 1) if task == REGRESSION else perceptron.Head("logistic", 1) if n_classes <= 2 else perceptron.Head("softmax", n_classes)
        fitted_model = perceptron.fit(ready, inputs, {"__label": head}, network_settings(spec), held)
    else:
        fitted_model = estimator(spec, task, arity).fit(ready.select("__features", "__label"))
    return FoldModel(spec.flavor, fold, y_name, task, whole, PipelineModel([*stages, fitted_model]), list(features),
                     [c.removeprefix("__i_") for c in inputs], labels, train.select(*[col(f) for f in features]).schema, spec.label)


# -- persistence ---------------------------------------------------------------------------------


def save_model(model: FoldModel, root: str, run_id: str) -> str:
    """``root/run_id/flavor_target_fold``: the ML pipeline, the transform chain and one JSON line of facts."""
    spark = SparkSession.getActiveSession()
    path = f"{root.rstrip('/')}/{run_id}/{model.flavor}_{model.y_name}_{model.fold}"
    steps = []
    for i, step in enumerate(model.chain.steps):
        if isinstance(step, TargetEncoding):
            step.table.write.mode("overwrite").parquet(f"{path}/step{i}")
            steps.append({"kind": "target", "columns": step.columns, "labels": step.labels, "prior": step.prior, "key": step.key, "seed": step.seed})
            continue
        if not step.recipe:
            raise ValueError(f"step {i} of the chain was not made by a registered transform and cannot be stored")
        for j, (mapping, *_) in enumerate(step.joins):
            mapping.write.mode("overwrite").parquet(f"{path}/step{i}_{j}")
        steps.append({**step.recipe, "tables": len(step.joins)})
    facts = {"flavor": model.flavor, "fold": model.fold, "y_name": model.y_name, "task": model.task, "x_names": model.x_names,
             "inputs": model.inputs, "labels": model.labels, "schema": json.loads(model.schema.json()), "name": model.name, "steps": steps}
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/facts")
    return path


def load_model(spark: SparkSession, path: str) -> FoldModel:
    facts = json.loads(spark.read.text(f"{path}/facts").first()[0])
    steps: list[Transform] = []
    for i, s in enumerate(facts["steps"]):
        if s["kind"] == "target":
            steps.append(TargetEncoding(spark.read.parquet(f"{path}/step{i}"), s["columns"], s["labels"], s["prior"], s["key"], s["seed"], {}))
        else:
            tables = [spark.read.parquet(f"{path}/step{i}_{j}") for j in range(s["tables"])]
            steps.append(BUILDERS[s["kind"]](tables=tables, **s["values"]))
    return FoldModel(facts["flavor"], facts["fold"], facts["y_name"], facts["task"], Chain(steps), PipelineModel.load(f"{path}/pipeline"),
                     facts["x_names"], facts["inputs"], facts["labels"], T.StructType.fromJson(facts["schema"]), facts["name"])


def load_models(spark: SparkSession, root: str, run_id: str, flavor: str) -> list[FoldModel]:
    """Models of a run, by target and fold."""
    if flavor not in FLAVORS:
        raise ValueError(f"unknown model {flavor!r}; known: {FLAVORS}")
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{run_id}")
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(s.getPath()) for s in fs.listStatus(base)] if fs.exists(base) else []
    wanted = [p for p in found if p.rsplit("/", 1)[1].startswith(f"{flavor}_")]
    if not wanted:
        raise FileNotFoundError(f"run {run_id} has no {flavor} models under {root}")
    return sorted((load_model(spark, p) for p in wanted), key=lambda m: (m.y_name, m.fold))
