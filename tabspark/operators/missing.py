"""Filling missing cells.

Whole-column fills come from aggregates.  Fills that follow an order use windows over
(partition, range bucket) and carry the last known value from bucket to bucket, so neither an
unpartitioned table nor one dominant partition key ends up in a single task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.columns import aggregate_once, as_list, category_columns, col, numeric_columns, quoted, require
from tabspark.functions.lookup import lookup
from tabspark.functions.order_stats import bucket_count, column_quantiles, order_code, with_range_bucket

ORDERED = ("forward", "backward", "interpolate")
NUMERIC = ("mean", "median", *ORDERED, "fill_grouped_mode")
TEXT = ("fill", "mode", "fill_grouped_mode")
UNKEYED_BUCKETS = 64  # fewest buckets of an ordered fill without partition keys
EMPTY_GROUP_NUMBER = 1e-8  # value given to a group without any number (fixed value)


def fill_missing(df: DataFrame, strategy: str = "median", *, column_strategy: Mapping[str, str] | None = None,
                 fill_value: str = "Unknown", column_fill_value: Mapping[str, str] | None = None,
                 group_by=None, order_by=None, partition_by=None, missing_indicator: bool = True) -> DataFrame:
    """Fill every numeric and text column that has nulls, by its own or the global strategy.

    A numeric column with a text-only strategy takes its median, a text column with a numeric one the
    fill value.  Ordered strategies need ``order_by`` (unique within ``partition_by``).
    """
    column_strategy, column_fill_value = dict(column_strategy or {}), dict(column_fill_value or {})
    for s in [strategy, *column_strategy.values()]:
        if s not in NUMERIC + TEXT:
            raise ValueError(f"unknown fill strategy {s!r}")
    facts = aggregate_once(df, {"": F.count(F.lit(1)), **{c: F.count(col(c)) for c in df.columns}})
    rows = facts[""]
    holes = [c for c in df.columns if facts[c] < rows]
    numbers, texts = set(numeric_columns(df)), set(category_columns(df))
    plan: dict[str, str] = {}
    for c in holes:
        wanted = column_strategy.get(c, strategy)
        if c in numbers:
            plan[c] = wanted if wanted in NUMERIC else "median"
        elif c in texts:
            plan[c] = wanted if wanted in TEXT else "fill"
    flags = [col(c).isNull().cast("int").alias(f"{c}_is_missing") for c in holes] if missing_indicator else []
    names = [*df.columns, *(f"{c}_is_missing" for c in holes if missing_indicator)]
    out = df.select("*", *flags)

    by = {s: [c for c in plan if plan[c] == s] for s in NUMERIC + TEXT}
    constants: dict[str, object] = {}
    if by["mean"]:
        constants.update(aggregate_once(df, {c: F.avg(col(c).cast("double")) for c in by["mean"]}))
    if by["median"]:
        constants.update({c: q[0] for c, q in column_quantiles(df, by["median"], [0.5], rows=rows).items()})
    constants.update(column_modes(df, by["mode"]))
    constants.update({c: column_fill_value.get(c, fill_value) for c in by["fill"]})
    averaged = set(by["mean"] + by["median"])
    replaced = {
        c: F.coalesce(col(c).cast("double") if c in averaged else col(c).cast("string"), F.lit(v)).alias(c)
        for c, v in constants.items() if v is not None
    }
    if replaced:
        out = out.select(*[replaced.get(c, col(c)) for c in out.columns])
    if by["fill_grouped_mode"]:
        out = _fill_grouped_mode(df, out, by["fill_grouped_mode"], as_list(group_by), numbers,
                                 {c: column_fill_value.get(c, fill_value) for c in by["fill_grouped_mode"]})
    ordered = {c: s for s in ORDERED for c in by[s]}
    if ordered:
        out = ordered_fill(out, ordered, order_by, partition_by, rows=rows)
    return out.select(*[col(c) for c in names])


def column_modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Smallest most frequent value per column, from value counts that combine map-side."""
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("name"), col(c).cast("string").alias("value")) for c in columns])
    counts = df.select(F.inline(cells)).filter("value IS NOT NULL").groupBy("name", "value").count()
    best = counts.groupBy("name").agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("mode"))
    found = {r["name"]: r["mode"] for r in best.collect()}  # one row per column
    return {c: found.get(c) for c in columns}


def grouped_modes(df: DataFrame, columns: list[str], group_by: list[str], numbers: set[str]) -> DataFrame:
    """(group..., one column per filled column, __rows): the mode within each group, null if it has none."""
    kinds = {c: df.schema[c].dataType for c in columns}
    def cell(c):
        return F.struct(
            F.lit(c).alias("name"),
            (col(c).cast("double") if c in numbers else F.lit(None).cast("double")).alias("number"),
            (F.lit(None).cast("string") if c in numbers else col(c).cast("string")).alias("text"),
        )
    keys = [f"__g{i}" for i in range(len(group_by))]
    present = df.dropna(subset=group_by)
    cells = present.select(*[col(g).alias(k) for g, k in zip(group_by, keys)], F.inline(F.array(*[cell(c) for c in columns])))
    counts = cells.groupBy(*keys, "name", "number", "text").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("number").isNotNull() | F.col("text").isNotNull()
    best = counts.groupBy(*keys).agg(
        F.sum(F.when(F.col("name") == columns[0], F.col("n"))).alias("__rows"),
        *[
            F.min_by(F.col("number" if c in numbers else "text"),
                     F.when((F.col("name") == c) & known, F.struct(-F.col("n"), F.col("number"), F.col("text")))).alias(f"__m{i}")
            for i, c in enumerate(columns)
        ],
    )
    return best.select(
        *[F.col(k).alias(g) for k, g in zip(keys, group_by)],
        *[F.col(f"__m{i}").cast(kinds[c] if c not in numbers else "double").alias(f"__mode{i}") for i, c in enumerate(columns)],
        "__rows",
    )


def _fill_grouped_mode(df, out, columns, group_by, numbers, texts) -> DataFrame:
    if not group_by:
        raise ValueError("strategy fill_grouped_mode needs group_by")
    require(df, group_by, "group columns")
    modes = grouped_modes(df, columns, group_by, numbers)
    joined = lookup(out, modes.withColumn("__seen", F.lit(True)), group_by, "__rows")
    filled = {}
    for i, c in enumerate(columns):
        empty = F.lit(EMPTY_GROUP_NUMBER) if c in numbers else F.lit(texts[c])
        # a row without a group stays as it is
        filled[c] = F.coalesce(col(c), F.when(F.col("__seen"), F.coalesce(F.col(f"__mode{i}"), empty))).alias(c)
    return joined.select(*[filled.get(c, col(c)) for c in out.columns])


def ordered_fill(df: DataFrame, strategies: Mapping[str, str], order_by, partition_by=None, *,
                 rows: int | None = None, buckets: int | None = None) -> DataFrame:
    """Forward, backward and linear (by row position) fills along an order."""
    order, keys = as_list(order_by), as_list(partition_by)
    if not order:
        raise ValueError("ordered fills need order_by: rows have no order of their own")
    require(df, [*order, *keys, *strategies])
    if buckets is None:
        # without keys only the buckets part the rows: a dozen of them, dealt by hash, would leave a third of a table to one task
        buckets = bucket_count(df.count() if rows is None else rows, *([] if keys else [UNKEYED_BUCKETS]))
    coded = with_range_bucket(df.withColumn("__code", order_code(df, order[0])), [], "__code", buckets).drop("__code")
    parts = [col(k) for k in keys]
    inside = Window.partitionBy(*parts, "__bucket").orderBy(*[col(o) for o in order])
    back = inside.rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead is a lead over the same sorted rows: a frame that ends at the last row is added up anew for every row
    ahead = f"OVER (PARTITION BY {', '.join([*map(quoted, keys), '__bucket'])} ORDER BY {', '.join(map(quoted, order))})"
    names = list(strategies)
    numbered = coded.withColumn("__at", F.row_number().over(inside).cast("long"))
    spot = numbered.select("*", *[F.when(col(c).isNotNull(), F.struct(F.col("__at").alias("at"), col(c).alias("v"))).alias(f"__cell{i}") for i, c in enumerate(names)])
    local = spot.select(
        "*",
        *[F.last(f"__cell{i}", ignorenulls=True).over(back).alias(f"__prev{i}") for i, c in enumerate(names) if strategies[c] != "backward"],
        *[F.expr(f"lead(__cell{i}) IGNORE NULLS {ahead}").alias(f"__next{i}") for i, c in enumerate(names) if strategies[c] != "forward"],
    )
    # one row per (partition, bucket): size, first and last known cell of each column
    summary = spot.groupBy(*parts, "__bucket").agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.max_by(f"__cell{i}", f"__cell{i}.at").alias(f"__last{i}") for i in range(len(names))],
        *[F.min_by(f"__cell{i}", f"__cell{i}.at").alias(f"__first{i}") for i in range(len(names))],
    )
    across = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
    before, after = (across.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("__bucket", F.desc("__bucket")))
    placed = summary.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    def shifted(x):
        return F.when(F.col(x).isNotNull(), F.struct((F.col(x)["at"] + F.col("__start")).alias("at"), F.col(x)["v"].alias("v")))
    carry = placed.select(
        *[col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__bucket").alias("__b"), "__start",
        *[F.last(shifted(f"__last{i}"), ignorenulls=True).over(before).alias(f"__cprev{i}") for i in range(len(names))],
        *[F.last(shifted(f"__first{i}"), ignorenulls=True).over(after).alias(f"__cnext{i}") for i in range(len(names))],
    )
    on = [F.col("__bucket") == F.col("__b")] + [col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = local.join(carry, on, "left")
    out = []
    for c in df.columns:
        if c not in strategies:
            out.append(col(c))
            continue
        i, how = names.index(c), strategies[c]
        prev = F.coalesce(shifted(f"__prev{i}"), F.col(f"__cprev{i}")) if how != "backward" else None
        follow = F.coalesce(shifted(f"__next{i}"), F.col(f"__cnext{i}")) if how != "forward" else None
        if how == "forward":
            value = F.coalesce(col(c), prev["v"])
        elif how == "backward":
            value = F.coalesce(col(c), follow["v"])
        else:
            low, high = prev["v"].cast("double"), follow["v"].cast("double")
            here = F.col("__at") + F.col("__start")
            between = low + (high - low) * (here - prev["at"]) / F.nullif(follow["at"] - prev["at"], F.lit(0))
            # trailing holes keep the last value, leading ones stay empty
            value = F.coalesce(col(c).cast("double"), between, low)
        out.append(value.alias(c))
    return joined.select(*out)
