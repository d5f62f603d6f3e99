"""Row-wise operators on streams: fitted on a table, applied to an unbounded one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tabspark.operators.models import FoldModel
from tabspark.operators.training import ensemble_predict
from tabspark.operators.transforms import Transform


def transform_stream(stream: DataFrame, steps: Sequence[Transform | Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Fitted transforms and row-wise functions (column filters, unit stripping, hashing) in order."""
    if not stream.isStreaming:
        raise ValueError("not a streaming table; apply the transforms directly")
    for step in steps:
        stream = step.apply(stream) if isinstance(step, Transform) else step(stream)
    return stream


def score_stream(stream: DataFrame, models: Sequence[FoldModel]) -> DataFrame:
    return ensemble_predict(models, stream)


def write_stream(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Append to Parquet; the checkpoint folder makes the sink exactly-once across restarts."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)
