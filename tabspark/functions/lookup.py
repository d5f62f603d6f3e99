"""Joining a fitted mapping back to the rows it was fitted on."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.columns import col

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
HOT_KEYS = 1_000
TASK_ROWS = 1_000_000  # rows that one task of a shuffle join reads, about


def _small(mapping: DataFrame, limit: int) -> bool:
    """At most ``limit`` rows, and at most ``BROADCAST_BYTES`` of texts and fixed cells in them."""
    texts = [F.length(col(c)) for c, t in mapping.dtypes if t in ("string", "binary")]
    size = sum((F.coalesce(x, F.lit(0)) for x in texts), F.lit(16 * len(mapping.columns)))
    r = mapping.limit(limit + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return r["n"] <= limit and r["b"] <= BROADCAST_BYTES


def lookup(df: DataFrame, mapping: DataFrame, keys: Sequence[str], count_col: str | None = None,
           broadcast_rows: int | None = None) -> DataFrame:
    """Left join of a mapping with unique ``keys``; nulls match nulls.

    The mapping is broadcast only if it is counted to be small.  A larger one is split: the
    ``HOT_KEYS`` most frequent keys are broadcast, so no task gets all rows of a hot key, and the
    rest goes through a shuffle join, with more tasks where the frequencies add up to more rows.
    ``count_col`` holds the frequency and is not returned.
    """
    keys = list(keys)
    limit = BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    payload = [c for c in mapping.columns if c not in keys and c != count_col]
    small = mapping.select(*[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[col(p) for p in payload],
                           *([col(count_col).alias("__freq")] if count_col else []))
    on = [col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    out = [*[col(c) for c in df.columns], *[col(p) for p in payload]]
    if _small(small, limit):
        return df.join(F.broadcast(small), on, "left").select(*out)
    if count_col is None:
        return df.join(small.hint("shuffle_merge"), on, "left").select(*out)
    hot = small.orderBy(F.desc("__freq"), *[F.col(f"__k{i}") for i in range(len(keys))]).limit(HOT_KEYS)
    hot = hot.select(*[F.col(f"__k{i}").alias(f"__h{i}") for i in range(len(keys))],
                     F.lit(True).alias("__hot"), *[col(p).alias(f"__p{i}") for i, p in enumerate(payload)])
    marked = df.join(F.broadcast(hot), [col(k).eqNullSafe(F.col(f"__h{i}")) for i, k in enumerate(keys)], "left")
    # rows of hot keys already have their answer: a salt that matches nothing spreads them by position, equal rows too
    salt = F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(1_000_000)) + 1).otherwise(F.lit(0).cast("long"))
    marked = marked.select(*[col(c) for c in df.columns], "__hot", *[f"__p{i}" for i in range(len(payload))], salt.alias("__salt"))
    # a hash of the key deals both sides over a number of tasks that grows with the rows; the keys themselves are compared as ranges,
    # which join planning does not take for keys to shuffle by again
    tasks = math.ceil((small.agg(F.sum("__freq")).first()[0] or 0) / TASK_ROWS)
    marked = marked.withColumn("__hash", F.hash(*[col(k) for k in keys], F.col("__salt")))
    cold = small.drop("__freq").withColumn("__cold", F.hash(*[F.col(f"__k{i}") for i in range(len(keys))], F.lit(0).cast("long")))
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        marked, cold = marked.repartition(tasks, "__hash"), cold.repartition(tasks, "__cold")
    cold = cold.hint("shuffle_merge")
    same = [F.col("__hash") == F.col("__cold"), F.col("__salt") <= 0]
    for i, k in enumerate(keys):
        k, other = col(k), F.col(f"__k{i}")
        same.append(((k <= other) & (k >= other)) | (k.isNull() & other.isNull()))
    joined = marked.join(cold, same, "left")
    return joined.select(
        *[col(c) for c in df.columns],
        *[F.when(F.col("__hot"), F.col(f"__p{i}")).otherwise(col(p)).alias(p) for i, p in enumerate(payload)],
    )
