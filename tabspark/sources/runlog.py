"""Named result tables and the run log, both plain Parquet folders.

A run is one row: experiment, run_id, step, module, status, start_time, params, metrics, tags.
Rows are only ever appended, so concurrent jobs never rewrite each other's files.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.columns import as_list

RUN_SCHEMA = (
    "experiment string, run_id string, step string, module string, status string, start_time timestamp, "
    "params map<string,string>, metrics map<string,double>, tags map<string,string>"
)
FINISHED = "FINISHED"


def write_table(df: DataFrame, run_dir: str, name: str, mode: str = "overwrite", partition_by: str | list[str] | None = None) -> str:
    path = f"{run_dir.rstrip('/')}/{name}.parquet"
    df.write.mode(mode).parquet(path, partitionBy=as_list(partition_by) or None)
    return path


def flatten_params(params: Mapping[str, Any], prefix: str = "") -> dict[str, str]:
    """Nested parameters as dotted names with text values; empty values are left out."""
    flat: dict[str, str] = {}
    for name, value in params.items():
        if isinstance(value, Mapping):
            flat.update(flatten_params(value, f"{prefix}{name}."))
        elif value is not None:
            flat[f"{prefix}{name}"] = ",".join(map(str, value)) if isinstance(value, (list, tuple, set)) else str(value)
    return flat


def append_run(spark: SparkSession, log_dir: str, experiment: str, step: str, module: str, *,
               params: Mapping[str, Any] | None = None, metrics: Mapping[str, float] | None = None,
               tags: Mapping[str, str] | None = None, status: str = FINISHED,
               run_id: str | None = None, start_time: datetime | None = None) -> str:
    run_id = run_id or uuid.uuid4().hex
    row = (experiment, run_id, step, module, status, start_time or datetime.now(timezone.utc),
           flatten_params(params or {}), {k: float(v) for k, v in (metrics or {}).items()}, dict(tags or {}))
    spark.createDataFrame([row], RUN_SCHEMA).coalesce(1).write.mode("append").parquet(log_dir)
    return run_id


def run_log(spark: SparkSession, log_dir: str) -> DataFrame:
    try:
        return spark.read.schema(RUN_SCHEMA).parquet(log_dir)
    except AnalysisException:
        return spark.createDataFrame([], RUN_SCHEMA)


def list_runs(runs: DataFrame, experiment: str | None = None, steps: str | list[str] | None = None,
              limit: int | None = None) -> DataFrame:
    """Newest first; ``limit`` is the report's length (top-k, not a full sort)."""
    if experiment is not None:
        runs = runs.filter(F.col("experiment") == experiment)
    if steps is not None:
        runs = runs.filter(F.col("step").isin(as_list(steps)))
    ordered = runs.orderBy(F.desc("start_time"), "run_id")
    return ordered.limit(limit) if limit is not None else ordered


def get_run(runs: DataFrame, run_id: str) -> DataFrame:
    found = runs.filter(F.col("run_id") == run_id)
    if found.isEmpty():
        raise KeyError(f"no run {run_id}")
    return found


def list_run_artifacts(spark: SparkSession, run_dir: str) -> DataFrame:
    """(path, size_bytes, modified) per file; the content column is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(run_dir)
    return files.select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def finished_models(runs: DataFrame, experiment: str, step: str = "model") -> DataFrame:
    """(module, run_id): the latest finished run of each module."""
    done = runs.filter((F.col("experiment") == experiment) & (F.col("step") == step) & (F.col("status") == FINISHED))
    return done.groupBy("module").agg(F.max_by("run_id", F.struct("start_time", "run_id")).alias("run_id"))
