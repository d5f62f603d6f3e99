"""Exact ranks, prefix counts and quantiles that never put a whole column into one task.

``percentile`` keeps a map of all distinct values in its final task, which is the fastest exact
way while that map is provably small.  Beyond ``SMALL_CELLS`` values the same numbers come from
range buckets: split points from a sketch, one count per bucket, and ranks inside each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.columns import aggregate_once, col

SMALL_CELLS = 8_000_000
BUCKET_ROWS = 500_000
MAX_BUCKETS = 2_000
SKETCH = 10_000
WIDE_PROBS = 32  # more quantiles than this in one call are found by binary search


def bucket_count(rows: int, floor: int = 8) -> int:
    return max(floor, min(MAX_BUCKETS, math.ceil(rows / BUCKET_ROWS)))


def order_code(df: DataFrame, name: str) -> Column:
    """Number that never decreases when the column grows (equal codes are allowed)."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return col(name).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col(name)).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.StringType):
        # six leading bytes as one 48-bit number, exact in a double
        head = F.substring(F.encode(col(name), "UTF-8"), 1, 6)
        return F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("double")
    raise TypeError(f"cannot order by {name}: {kind.simpleString()}")


def _splits(df: DataFrame, keys: Sequence[str], value: str, buckets: int) -> DataFrame:
    at = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    agg = F.percentile_approx(F.col(value), at, SKETCH).alias("__splits")
    return df.groupBy(*keys).agg(agg) if keys else df.agg(agg)


def count_below(splits: Column, value: Column) -> Column:
    """Number of split points below the value: its place in the sorted array.

    (A lambda over the array would do, but join planning may copy a lambda's outer columns to the
    wrong side of a join.)
    """
    spot = F.array_position(F.sort_array(F.array_append(splits, value)), value) - 1
    return F.coalesce(spot, F.lit(0)).cast("int")


def _literal_bucket(points: list[float], value: Column, first: int = 0) -> Column:
    """The same number for constant split points, as a binary tree of comparisons that stays in codegen."""
    if not points:
        return F.lit(first)
    mid = len(points) // 2
    above = _literal_bucket(points[mid + 1:], value, first + mid + 1)
    return F.when(value > F.lit(float(points[mid])), above).otherwise(_literal_bucket(points[:mid], value, first))


def with_range_bucket(df: DataFrame, keys: Sequence[str], code: str, buckets: int, out: str = "__bucket") -> DataFrame:
    """Bucket number = how many split points of the row's key lie below the code."""
    keys = list(keys)
    splits = _splits(df.filter(F.col(code).isNotNull()), keys, code, buckets)
    if not keys:
        points = (splits.first() or [None])[0] or []
        return df.withColumn(out, _literal_bucket(sorted(set(points)), F.col(code)))
    on = [df[k].eqNullSafe(splits[k]) for k in keys]
    joined = df.join(splits, on, "left")
    for k in keys:
        joined = joined.drop(splits[k])
    return joined.withColumn(out, count_below(F.col("__splits"), F.col(code))).drop("__splits")


def ranked_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None,
                  rows: int | None = None, small: int | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """(keys, value, cnt, before, total): copies of each value, rows with a smaller value, rows of the key.
    ``carry`` adds further aggregates per (keys, value).

    Null values are left out.  Copies are added up map-side first, so a value that holds a third of
    the rows travels as one row per task.
    """
    keys = list(keys)
    small = SMALL_CELLS if small is None else small
    weighted = F.count(F.lit(1)) if weight is None else F.sum(weight)
    carried = list(carry or {})
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        weighted.cast("long").alias("cnt"), *[(carry or {})[c].alias(c) for c in carried])
    if rows is None:
        rows = df.count()
    if rows <= small and keys:
        w = Window.partitionBy(*keys).orderBy(value)
        return counts.select(
            *keys, value, "cnt",
            (F.sum("cnt").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cnt")).alias("before"),
            F.sum("cnt").over(Window.partitionBy(*keys)).alias("total"), *carried,
        )
    coded = counts.withColumn("__code", order_code(counts, value))
    bucketed = with_range_bucket(coded, keys, "__code", bucket_count(rows)).drop("__code")
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # at most MAX_BUCKETS rows per key
    offsets = (
        bucketed.groupBy(*keys, "__bucket").agg(F.sum("cnt").alias("__n"))
        .select(
            *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
            F.col("__bucket").alias("__b"),
            (F.sum("__n").over(whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__offset"),
            F.sum("__n").over(whole).alias("total"),
        )
    )
    on = [bucketed["__bucket"] == offsets["__b"]] + [
        bucketed[k].eqNullSafe(offsets[f"__k{i}"]) for i, k in enumerate(keys)
    ]
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return bucketed.join(offsets, on).select(
        *keys, value, "cnt",
        (F.col("__offset") + F.sum("cnt").over(inside) - F.col("cnt")).alias("before"),
        "total", *carried,
    )


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
                      names: Sequence[str], rows: int | None = None, small: int | None = None) -> DataFrame:
    """One row per key with exact, linearly interpolated quantiles; null keys form their own group."""
    keys = list(keys)
    small = SMALL_CELLS if small is None else small
    if rows is None:
        rows = df.count()
    if rows <= small:
        picked = df.groupBy(*keys).agg(F.percentile(F.col(value), F.array(*[F.lit(float(p)) for p in probs])).alias("__q"))
        return picked.select(*keys, *[F.get("__q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    ranked = ranked_counts(df, keys, value, rows=rows, small=small)
    aggs = []
    for i, p in enumerate(probs):
        spot = (F.col("total") - 1) * F.lit(float(p))
        for tag, index in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("before") <= index) & (index < F.col("before") + F.col("cnt"))
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"__{tag}{i}"))
    wide = ranked.groupBy(*keys).agg(F.max("total").alias("__n"), *aggs)
    out = []
    for i, (p, n) in enumerate(zip(probs, names)):
        spot = (F.col("__n") - 1) * F.lit(float(p))
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        out.append((low + (high - low) * (spot - F.floor(spot))).alias(n))
    return wide.select(*keys, *out)


def column_quantiles(df: DataFrame, columns: Iterable[str], probs: Sequence[float],
                     rows: int | None = None, small: int | None = None) -> dict[str, list[float | None]]:
    """Exact, linearly interpolated quantiles of several columns as {column: [one per probability]}."""
    columns = list(columns)
    small = SMALL_CELLS if small is None else small
    if rows is None:
        rows = df.count()
    if rows * len(columns) <= small:
        at = F.array(*[F.lit(float(p)) for p in probs])
        found = aggregate_once(df, {c: F.percentile(col(c).cast("double"), at) for c in columns})
        return {c: list(v) if v is not None else [None] * len(probs) for c, v in found.items()}
    if len(probs) * len(columns) > WIDE_PROBS:
        return _celled_quantiles(df, columns, list(probs))
    return _bracketed_quantiles(df, columns, list(probs))


def _celled_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """The same for hundreds of probabilities, where an expression for each would cost every row as many comparisons.

    The points of a sketch cut each column into cells.  One pass counts them by binary search, which tells the cell of every wanted
    rank; another takes the rows of those cells, and ranks are exact inside each.
    """
    slack = 2.0 / SKETCH
    at = sorted({min(1.0, max(0.0, p + s)) for p in probs for s in (-slack, slack)})
    cells = df.select(*[col(c).cast("double").alias(f"c{j}") for j, c in enumerate(columns)])
    found = aggregate_once(cells, {j: F.percentile_approx(f"c{j}", F.array(*[F.lit(e) for e in at]), SKETCH) for j in range(len(columns))})
    points = {j: np.unique(np.asarray(v, float)) for j, v in found.items() if v}

    def known(batch, j):
        return batch.column(j).drop_null().to_numpy(zero_copy_only=False)

    def count(batches):
        sums = {j: np.zeros(len(e) + 1, np.int64) for j, e in points.items()}
        for batch in batches:
            for j, e in points.items():
                sums[j] += np.bincount(np.searchsorted(e, known(batch, j)), minlength=len(e) + 1)
        for j, n in sums.items():
            yield pa.RecordBatch.from_pydict({"j": pa.array(np.full(len(n), j, np.int32)), "cell": pa.array(np.arange(len(n), dtype=np.int32)), "n": pa.array(n)})

    sizes = {j: np.zeros(len(e) + 1, np.int64) for j, e in points.items()}
    for r in cells.mapInArrow(count, "j int, cell int, n bigint").groupBy("j", "cell").agg(F.sum("n").alias("n")).collect():  # a row per cell
        sizes[r["j"]][r["cell"]] = r["n"]
    spots, wanted = [], {j: np.zeros(len(e) + 1, bool) for j, e in points.items()}
    for j, n in sizes.items():
        before = np.concatenate([[0], np.cumsum(n)])
        for p in probs:
            for rank in {math.floor((before[-1] - 1) * p), math.ceil((before[-1] - 1) * p)}:
                cell = int(np.searchsorted(before, rank, side="right")) - 1
                wanted[j][cell] = True
                spots.append((j, cell, int(rank), int(rank - before[cell])))

    def pick(batches):
        for batch in batches:
            for j, e in points.items():
                x = known(batch, j)
                cell = np.searchsorted(e, x)
                use = wanted[j][cell]
                yield pa.RecordBatch.from_pydict({"j": pa.array(np.full(int(use.sum()), j, np.int32)), "cell": pa.array(cell[use].astype(np.int32)), "value": pa.array(x[use])})

    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    if not spots:
        return result
    weighted = cells.mapInArrow(pick, "j int, cell int, value double").groupBy("j", "cell", "value").agg(F.count(F.lit(1)).alias("cnt"))
    order = Window.partitionBy("j", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)  # a cell is a few in ten thousand rows, or one value
    ranked = weighted.withColumn("upto", F.sum("cnt").over(order))
    asked = df.sparkSession.createDataFrame(list(set(spots)), "j int, cell int, rank bigint, inside bigint")  # two a probability
    hit = (F.col("upto") - F.col("cnt") <= F.col("inside")) & (F.col("inside") < F.col("upto"))
    exact = {(r["j"], r["rank"]): r["value"] for r in ranked.join(F.broadcast(asked), ["j", "cell"]).filter(hit).select("j", "rank", "value").collect()}
    for j, n in sizes.items():
        for i, p in enumerate(probs):
            spot = (int(n.sum()) - 1) * p
            low, high = exact[j, math.floor(spot)], exact[j, math.ceil(spot)]
            result[columns[j]][i] = low + (high - low) * (spot - math.floor(spot))
    return result


def _bracketed_quantiles(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list[float | None]]:
    """Three scans and a tiny shuffle: a sketch brackets each quantile, then only the rows inside a
    bracket (a few in ten thousand) are ranked exactly."""
    slack = 2.0 / SKETCH
    values = {c: col(c).cast("double") for c in columns}
    exprs = {}
    for c in columns:
        edges = [min(1.0, max(0.0, p + s)) for p in probs for s in (-slack, slack)]
        exprs[("n", c)] = F.count(values[c])
        exprs[("edge", c)] = F.percentile_approx(values[c], F.array(*[F.lit(e) for e in edges]), SKETCH)
        exprs[("min", c)], exprs[("max", c)] = F.min(values[c]), F.max(values[c])
    base = aggregate_once(df, exprs)
    live = [c for c in columns if base[("n", c)]]
    wanted, brackets = {}, {}
    for c in live:
        for i, p in enumerate(probs):
            spot = (base[("n", c)] - 1) * p
            wanted[c, i] = (math.floor(spot), math.ceil(spot), spot - math.floor(spot))
            brackets[c, i] = (base[("edge", c)][2 * i], base[("edge", c)][2 * i + 1])
    below = aggregate_once(df, {
        (side, key): F.count(F.when(test, 1))
        for key, (low, high) in brackets.items()
        for side, test in (("<", values[key[0]] < low), ("<=", values[key[0]] <= high))
    })
    for key, (low, high) in list(brackets.items()):
        first, last, _ = wanted[key]
        if not (below["<", key] <= first and last < below["<=", key]):
            # the sketch missed its error bound: take the whole column, still exact
            brackets[key] = (base[("min", key[0])], base[("max", key[0])])
            below["<", key] = 0
    slots = list(brackets)
    pick = F.array(*[
        F.when(values[c].between(*map(float, brackets[c, i])), F.struct(F.lit(s).alias("slot"), values[c].alias("value")))
        for s, (c, i) in enumerate(slots)
    ])
    candidates = df.select(F.explode(F.filter(pick, lambda x: x.isNotNull())).alias("x")).select("x.*")
    weighted = candidates.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("w"))
    ranked = ranked_counts(weighted, ["slot"], "value", weight="w", rows=SMALL_CELLS + 1)
    targets = F.create_map(*[F.lit(v) for s, key in enumerate(slots)
                             for v in (s, [wanted[key][0] - below["<", key], wanted[key][1] - below["<", key]])]) \
        if slots else None
    result = {c: [None] * len(probs) for c in columns}
    if not slots:
        return result
    spots = F.element_at(targets, F.col("slot"))
    hits = [(F.col("before") <= spots[j]) & (spots[j] < F.col("before") + F.col("cnt")) for j in (0, 1)]
    found = ranked.groupBy("slot").agg(*[F.max(F.when(h, F.col("value"))).alias(n) for h, n in zip(hits, ("lo", "hi"))])
    for row in found.collect():  # one row per (column, probability)
        c, i = slots[row["slot"]]
        result[c][i] = row["lo"] + (row["hi"] - row["lo"]) * wanted[c, i][2]
    return result


def with_global_rank(df: DataFrame, key: Sequence[str], *, order_by: str | Sequence[str] | None = None,
                     seed: int | None = None, within: Sequence[str] = (), rows: int | None = None,
                     out: str = "rank") -> DataFrame:
    """0-based rank over the whole table (or within strata) without a single-partition sort.

    Either a seeded shuffle of the key or a real order.  Rows are spread over buckets, each bucket is
    counted and numbered on its own, and the counts of the buckets before it are added.
    """
    key, within = list(key), list(within)
    if rows is None:
        rows = df.count()
    buckets = bucket_count(rows)
    if order_by is None:
        # rank in order of (bucket, hash, key): any bucket function works for a shuffle
        coded = df.withColumn("__code", F.xxhash64(*[col(k) for k in key], F.lit(0 if seed is None else int(seed))))
        coded = coded.withColumn("__bucket", F.pmod(F.col("__code"), F.lit(buckets)))
        inner_order = [F.col("__code"), *[col(k) for k in key]]
    else:
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        coded = df.withColumn("__code", order_code(df, order[0]))
        coded = with_range_bucket(coded, [], "__code", buckets)
        inner_order = [col(o) for o in order] + [col(k) for k in key if k not in order]
    whole = Window.partitionBy(*[col(w) for w in within]) if within else Window.partitionBy(F.lit(0))
    sizes = coded.groupBy(*[col(w) for w in within], "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(
        *[col(w).alias(f"__w{i}") for i, w in enumerate(within)], F.col("__bucket").alias("__b"),
        (F.sum("__n").over(whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__offset"),
    )
    on = [F.col("__bucket") == F.col("__b")] + [col(w).eqNullSafe(F.col(f"__w{i}")) for i, w in enumerate(within)]
    numbered = coded.join(offsets, on)
    inside = Window.partitionBy(*[col(w) for w in within], "__bucket").orderBy(*inner_order)
    rank = (F.col("__offset") + F.row_number().over(inside) - 1).cast("long")
    return numbered.withColumn(out, rank).select(*[col(c) for c in df.columns], out)
