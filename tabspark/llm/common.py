"""Helpers shared by the operators: written intermediates, skew-safe lookups, Arrow batches in bounded pieces."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.session import shared_scratch

HOT_GROUPS = 256  # heaviest groups that are broadcast in attach(); a fixed number of narrow rows
PIECE_BYTES = 2 << 20  # text bytes that a Python worker tokenises at a time; a longer text is a piece of its own


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """Write a table to the shared checkpoint folder and read it back: lineage ends there, and lost executors cost nothing."""
    path = f"{shared_scratch(df.sparkSession)}/t.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def attach(rows: DataFrame, groups: DataFrame, key: str, weight: str) -> DataFrame:
    """Left join of ``groups`` (one row per ``key``) to ``rows`` without sending a hot key to one task.

    The ``HOT_GROUPS`` groups of largest ``weight`` are broadcast; rows that they answer get a salt
    that matches nothing, spread by their position, and all others meet their group in a shuffle join.
    ``key`` must not be null in ``groups``; a null in ``rows`` stays without a group.
    """
    payload = [c for c in groups.columns if c != key]
    hot = groups.orderBy(F.desc(weight), key).limit(HOT_GROUPS)
    hot = hot.select(F.col(key).alias("__hk"), *[F.col(c).alias(f"__h_{c}") for c in payload])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("__hk"), "left")
    salt = F.when(F.col("__hk").isNotNull(), F.lit(1) + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20))).otherwise(F.lit(0).cast("long"))
    marked = marked.withColumn("__salt", salt)
    cold = groups.select(F.col(key).alias("__ck"), *[F.col(c).alias(f"__c_{c}") for c in payload], F.pmod(F.col(weight).cast("long"), F.lit(1)).alias("__cs"))  # zero, but no constant that the optimizer would take out of the join key
    joined = marked.join(cold.hint("shuffle_merge"), (F.col(key) == F.col("__ck")) & (F.col("__salt") == F.col("__cs")), "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(f"__h_{c}"), F.col(f"__c_{c}")).alias(c) for c in payload])


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with 64-bit offsets; null is the empty text."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def pieces(batches: Iterator[pa.RecordBatch], name: str = "text", size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about ``size`` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(text_column(batch, name)).to_numpy(zero_copy_only=False)
        run = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and the offset of each."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Bucketed:
    """A table that grows by appended parts and is bucketed by its key: joins and groups by that key do not shuffle it."""

    def __init__(self, spark: SparkSession, key: list[str], part: str | None = None):
        self.spark, self.key, self.part = spark, key, part
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name, self.path, self.made = f"t_{uuid.uuid4().hex}", f"{shared_scratch(spark)}/t", False

    def append(self, df: DataFrame) -> None:
        out = df.repartition(self.n, *self.key).write.format("parquet").mode("append").option("compression", "zstd").option("path", self.path)
        (out.partitionBy(self.part) if self.part else out).bucketBy(self.n, *self.key).saveAsTable(self.name)
        self.made = True

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Take the name out of the catalogue; the files stay in the scratch folder."""
        if self.made:
            self.spark.sql(f"DROP TABLE {self.name}")


def packed(batch: pa.RecordBatch) -> tuple[bytes, int]:
    """A batch as compressed bytes, and their size before."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    body = sink.getvalue()
    return pa.compress(body, "zstd", asbytes=True), body.size


def unpacked(body: pa.Scalar, n_bytes: int) -> pa.RecordBatch:
    with pa.ipc.open_stream(pa.decompress(body.as_buffer(), n_bytes, "zstd")) as stream:
        return stream.read_next_batch()
