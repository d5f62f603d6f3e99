"""Pairwise-complete correlation of numeric columns: pearson, spearman and kendall (tau-b).

The result is one row per pair of columns.  Data is only aggregated: pearson by pairwise sums,
spearman by ranks from value counts, kendall by counting discordant pairs block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabspark.columns import aggregate_once, as_list, choose_numeric, col, numeric_columns
from tabspark.functions import special
from tabspark.functions.lookup import lookup
from tabspark.functions.order_stats import count_below, ranked_counts, with_range_bucket
from tabspark.session import materialize

METHODS = ("pearson", "spearman", "kendall")
PAIR_SCHEMA = "col_a string, col_b string, r double, p double, n bigint"
JVM_COLUMNS = 16
KENDALL_BLOCK = 400_000
KENDALL_BLOCKS = 512
NEAR_VALUES = 4_000_000  # distinct values of all columns whose ranks, 16 bytes each, go to every task


def correlation_long(df: DataFrame, columns: Iterable[str] | None = None, method: str = "spearman",
                     pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(col_a, col_b, r, p, n) for every pair of the columns, or for the given pairs.

    Constant columns are left out; fewer than three complete rows give r = 0, p = 1.
    """
    if method not in METHODS:
        raise ValueError(f"unsupported method {method!r}; supported: {METHODS}")
    names = choose_numeric(df, columns)
    facts = aggregate_once(df, {
        ("rows", ""): F.count(F.lit(1)),
        **{("n", c): F.count(col(c)) for c in names},
        **{("mean", c): F.avg(col(c).cast("double")) for c in names},
        **{("varies", c): F.min(col(c)) < F.max(col(c)) for c in names},
    })
    names = [c for c in names if facts["varies", c]]
    if pairs is None:
        pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    else:
        pairs = [(a, b) for a, b in pairs if a in names and b in names and a != b]
    used = [c for c in names if any(c in p for p in pairs)]
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    rows = facts["rows", ""]
    complete = all(facts["n", c] == rows for c in used)
    means = {c: facts["mean", c] for c in used}
    if method == "pearson":
        found = _pearson(df, used, pairs, means)
    elif method == "spearman":
        found = _spearman_by_column(df, used, pairs, rows) if complete else _spearman_by_pair(df, pairs, rows)
    else:
        found = _kendall(df, pairs, rows)
    out = []
    for a, b in pairs:
        n, r, p = found.get((a, b), (0, None, None))
        if n < 3:
            r, p = 0.0, 1.0
        elif p is None and r is not None:
            p = float(special.correlation_p(r, n))
        out.append((a, b, r, p, int(n)))
    return df.sparkSession.createDataFrame(out, PAIR_SCHEMA)


def _bounded(r: float | None) -> float | None:
    return None if r is None or math.isnan(r) else max(-1.0, min(1.0, float(r)))


def _from_sums(n, sx, sy, sxx, syy, sxy) -> tuple:
    """r from sums of values that were shifted by their means."""
    if n < 2:
        return int(n), None, None
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    if vx <= 0 or vy <= 0:
        return int(n), None, None
    return int(n), _bounded((sxy - sx * sy / n) / math.sqrt(vx * vy)), None


def _pearson(df: DataFrame, names: list[str], pairs, means) -> dict:
    if len(names) <= JVM_COLUMNS:
        exprs: dict = {}
        shifted = {c: col(c).cast("double") - F.lit(float(means[c])) for c in names}
        for a, b in pairs:
            x = F.when(col(b).isNotNull(), shifted[a])
            y = F.when(col(a).isNotNull(), shifted[b])
            exprs.update({(0, a, b): F.count(x + y), (1, a, b): F.sum(x), (2, a, b): F.sum(y),
                          (3, a, b): F.sum(x * x), (4, a, b): F.sum(y * y), (5, a, b): F.sum(x * y)})
        sums = aggregate_once(df, exprs)
        return {(a, b): _from_sums(*[sums[i, a, b] or 0 for i in range(6)]) for a, b in pairs}
    return _pearson_blocks(df, names, pairs, means)


def _pearson_blocks(df: DataFrame, names: list[str], pairs, means) -> dict:
    """Many columns: one matrix product per Arrow batch, one row of sums per task."""
    shift = np.array([float(means[c]) for c in names])
    p = len(names)

    def block_sums(batches):
        total = np.zeros((4, p, p))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - shift
            seen = ~np.isnan(x)
            x, m = np.where(seen, x, 0.0), seen.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pd.DataFrame({"sums": [total.ravel()]})

    data = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    partial = data.mapInPandas(block_sums, "sums array<double>")
    cells = partial.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # 4 p^2 numbers
    total = np.zeros(4 * p * p)
    total[cells["at"].to_numpy()] = cells["v"].to_numpy()
    n, s, q, xy = total.reshape(4, p, p)
    at = {c: i for i, c in enumerate(names)}
    return {(a, b): _from_sums(n[at[a], at[b]], s[at[a], at[b]], s[at[b], at[a]], q[at[a], at[b]], q[at[b], at[a]], xy[at[a], at[b]])
            for a, b in pairs}


def _spearman_by_column(df: DataFrame, names: list[str], pairs, rows: int, small: int | None = None,
                        broadcast_rows: int | None = None) -> dict:
    """No nulls: rank each column once, then pearson on the ranks.

    Ranks of few distinct values are sent to the tasks, which look them up in one pass over the rows; those of many are joined
    column by column.
    """
    ranks = df.select(*[col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)])
    cells = F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"v{i}").alias("value")) for i in range(len(names))])
    counts = materialize(ranks.select(F.inline(cells)).groupBy("at", "value").agg(F.count(F.lit(1)).alias("cnt")))
    if counts.count() <= (NEAR_VALUES if broadcast_rows is None else broadcast_rows):
        near = df.sparkSession.sparkContext.broadcast(_near_ranks(counts, len(names), rows))
        found = _rank_products(ranks, near, rows)
        near.destroy()
        at = {c: i for i, c in enumerate(names)}
        return {(x, y): found(at[x], at[y]) for x, y in pairs}
    table = materialize(ranked_counts(counts, ["at"], "value", weight="cnt", rows=rows * len(names), small=small)
                        .select("at", "value", "cnt", (F.col("before") + (F.col("cnt") + 1) / 2).alias("rank")))
    for i in range(len(names)):
        one = table.filter(F.col("at") == i).select(F.col("value").alias(f"v{i}"), F.col("cnt").alias("n"), F.col("rank").alias(f"r{i}"))
        ranks = lookup(ranks, one, [f"v{i}"], "n", broadcast_rows=broadcast_rows).drop(f"v{i}")
    renamed = ranks.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(names)])
    middle = (rows + 1) / 2
    return _pearson(renamed, names, pairs, {c: middle for c in names})


def _near_ranks(counts: DataFrame, wide: int, rows: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted values, mean rank of their copies less the middle rank) of each column, from at most ``NEAR_VALUES`` counts."""
    found = counts.toArrow()
    column, value, cnt = (found.column(c).to_numpy() for c in ("at", "value", "cnt"))
    order = np.lexsort((value, column))
    column, value, cnt = column[order], value[order], cnt[order].astype(float)
    edges = np.searchsorted(column, np.arange(wide + 1))
    return [(value[i:j], np.cumsum(cnt[i:j]) - (cnt[i:j] - 1) / 2 - (rows + 1) / 2) for i, j in zip(edges, edges[1:])]


def _rank_products(df: DataFrame, ranks: Broadcast, rows: int):
    """Sums of products of the ranks in one pass, a matrix product per Arrow batch and a row per task: the correlation of two columns."""
    wide = len(df.columns)

    def run(batches):
        total = np.zeros((wide, wide + 1))
        for batch in batches:
            x = np.ones((wide + 1, batch.num_rows))
            for i, (value, rank) in enumerate(ranks.value):
                cells = batch.column(i).to_numpy(zero_copy_only=False)
                order = np.argsort(cells) if len(value) > len(cells) else slice(None)  # in order a large table is walked through, not jumped about
                x[i, order] = rank[np.searchsorted(value, cells[order])]
            total += x[:wide] @ x.T
        yield pa.RecordBatch.from_pydict({"sums": [total.ravel()]})

    partial = df.mapInArrow(run, "sums array<double>")
    cells = partial.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect()  # p (p + 1) numbers
    total = np.array([r["v"] for r in sorted(cells)]).reshape(wide, wide + 1)
    return lambda i, j: _from_sums(rows, total[i, -1], total[j, -1], total[i, i], total[j, j], total[i, j])


def _pair_cells(df: DataFrame, pairs) -> DataFrame:
    """(pair, x, y, w): copies of each complete value pair."""
    cells = F.array(*[
        F.when(col(a).isNotNull() & col(b).isNotNull(),
               F.struct(F.lit(i).alias("pair"), col(a).cast("double").alias("x"), col(b).cast("double").alias("y")))
        for i, (a, b) in enumerate(pairs)
    ])
    return df.select(F.inline(F.filter(cells, lambda c: c.isNotNull()))).groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w"))


def _spearman_by_pair(df: DataFrame, pairs, rows: int, small: int | None = None, broadcast_rows: int | None = None) -> dict:
    """With nulls the ranks of a column differ from pair to pair."""
    cells = materialize(_pair_cells(df, pairs))
    n_cells = rows * len(pairs)
    for axis in ("x", "y"):
        ranked = ranked_counts(cells, ["pair"], axis, weight="w", rows=n_cells, small=small).select(
            "pair", axis, "cnt", (F.col("before") + (F.col("cnt") + 1) / 2 - (F.col("total") + 1) / 2).alias(f"r{axis}"))
        ranked = materialize(ranked)
        cells = lookup(cells, ranked, ["pair", axis], "cnt", broadcast_rows=broadcast_rows)
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    sums = cells.groupBy("pair").agg(F.sum(w).alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"),
                                     F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"), F.sum(w * rx * ry).alias("sxy"))
    return {pairs[r["pair"]]: _from_sums(r["n"], r["sx"], r["sy"], r["sxx"], r["syy"], r["sxy"]) for r in sums.collect()}  # one row per pair


def weighted_inversions(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Sum of w_i w_j over points with x_i < x_j and y_i > y_j.

    Points are put in x order and the ranks of y are split bit by bit, so each level needs one
    cumulative sum.
    """
    if len(x) < 2:
        return 0.0
    y = np.unique(y, return_inverse=True)[1].astype(np.int64)
    order = np.lexsort((y, x))
    y, w = y[order], w[order].astype(float)
    total = 0.0
    for bit in range(int(y.max()).bit_length() - 1, -1, -1):
        upper = y >> (bit + 1)
        by_prefix = np.argsort(upper, kind="stable")
        upper, ones, weight = upper[by_prefix], (y[by_prefix] >> bit) & 1, w[by_prefix]
        seen = np.cumsum(weight * ones)
        starts = np.r_[True, upper[1:] != upper[:-1]]
        base = np.maximum.accumulate(np.where(starts, np.r_[0.0, seen[:-1]], 0.0))
        total += float(np.sum(np.where(ones == 0, weight * (seen - base), 0.0)))
    return total


def _kendall(df: DataFrame, pairs, rows: int, blocks: int | None = None) -> dict:
    """Exact tau-b without bringing a pair of columns into one task.

    Both axes are cut into blocks.  Discordant pairs in different x and different y blocks follow from
    the block counts; pairs that share an x or a y block are counted inside that block.  A value that
    is a split point gets a block of its own, which holds ties only and needs no counting, so a value
    with a third of the rows cannot overload a task.
    """
    cells = materialize(_pair_cells(df, pairs))
    if blocks is None:
        blocks = min(KENDALL_BLOCKS, math.ceil(cells.count() / len(pairs) / KENDALL_BLOCK))
    placed = cells
    for axis in ("x", "y"):
        if blocks <= 1:
            placed = placed.withColumn(f"b{axis}", F.lit(0))
        else:
            placed = _tie_aware_block(placed, axis, blocks)
    placed = materialize(placed)
    single_x, single_y = F.col("bx") % 2 == 1, F.col("by") % 2 == 1
    tasks = F.array(
        F.when(~single_x, F.struct(F.lit(1).alias("sign"), F.col("bx").alias("i"), F.lit(-1).alias("j"))),
        F.when(~single_y, F.struct(F.lit(1).alias("sign"), F.lit(-1).alias("i"), F.col("by").alias("j"))),
        F.when(~single_x & ~single_y, F.struct(F.lit(-1).alias("sign"), F.col("bx").alias("i"), F.col("by").alias("j"))),
    )
    work = placed.select("pair", "x", "y", "w", F.inline(F.filter(tasks, lambda t: t.isNotNull())))

    def count_block(pdf: pd.DataFrame) -> pd.DataFrame:
        q = weighted_inversions(pdf["x"].to_numpy(), pdf["y"].to_numpy(), pdf["w"].to_numpy())
        return pd.DataFrame({"pair": pdf["pair"].iloc[:1], "q": [float(pdf["sign"].iloc[0]) * q]})

    inner = work.groupBy("pair", "sign", "i", "j").applyInPandas(count_block, "pair int, q double")

    def count_between(pdf: pd.DataFrame) -> pd.DataFrame:
        # at most (2 blocks + 1)^2 counts
        i, j = np.unique(pdf["bx"], return_inverse=True)[1], np.unique(pdf["by"], return_inverse=True)[1]
        grid = np.zeros((i.max() + 1, j.max() + 1))
        np.add.at(grid, (i, j), pdf["w"].to_numpy(dtype=float))
        above = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1]
        above = np.c_[above[:, 1:], np.zeros(len(grid))]
        earlier = np.vstack([np.zeros(grid.shape[1]), np.cumsum(above, axis=0)[:-1]])
        return pd.DataFrame({"pair": pdf["pair"].iloc[:1], "q": [float((grid * earlier).sum())]})

    grid = placed.groupBy("pair", "bx", "by").agg(F.sum("w").alias("w"))
    between = grid.groupBy("pair").applyInPandas(count_between, "pair int, q double")
    discordant = {r["pair"]: r["q"] for r in inner.unionByName(between).groupBy("pair").agg(F.sum("q").alias("q")).collect()}

    def ties(*by):
        t = F.col("t").cast("double")
        grouped = cells.groupBy("pair", *by).agg(F.sum("w").alias("t")).groupBy("pair").agg(
            F.sum("t").alias("n"), F.sum(t * (t - 1) / 2).alias("pairs"),
            F.sum(t * (t - 1) * (t - 2)).alias("third"), F.sum(t * (t - 1) * (2 * t + 5)).alias("spread"))
        return {r["pair"]: r for r in grouped.collect()}  # one row per pair

    tx, ty, txy = ties("x"), ties("y"), ties("x", "y")
    out = {}
    for i, pair in enumerate(pairs):
        if i in tx:
            out[pair] = _tau_b(tx[i]["n"], discordant.get(i, 0.0), tx[i], ty[i], txy[i]["pairs"])
    return out


def _tie_aware_block(df: DataFrame, axis: str, blocks: int) -> DataFrame:
    at = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    splits = df.groupBy("pair").agg(F.array_distinct(F.percentile_approx(axis, at, 10_000)).alias("__s"))
    joined = df.join(F.broadcast(splits), "pair")  # one row per pair of columns
    below = count_below(F.col("__s"), F.col(axis))
    on_split = F.array_contains("__s", F.col(axis)).cast("int")
    return joined.withColumn(f"b{axis}", 2 * below + on_split).drop("__s")


def _tau_b(n: int, dis: float, x, y, both: float) -> tuple:
    total = n * (n - 1) / 2
    if total == x["pairs"] or total == y["pairs"]:
        return n, None, None
    score = total - x["pairs"] - y["pairs"] + both - 2 * dis
    tau = _bounded(score / math.sqrt(total - x["pairs"]) / math.sqrt(total - y["pairs"]))
    if x["pairs"] == 0 and y["pairs"] == 0 and (n <= 33 or min(dis, total - dis) <= 1):
        return n, tau, special.kendall_exact_p(int(n), int(round(dis)))
    m = n * (n - 1.0)
    variance = (m * (2 * n + 5) - x["spread"] - y["spread"]) / 18 + 2 * x["pairs"] * y["pairs"] / m
    if n > 2:
        variance += x["third"] * y["third"] / (9 * m * (n - 2))
    return n, tau, float(special.normal_sf_two_sided(score / math.sqrt(variance)))


def correlation_matrix(df: DataFrame, columns=None, method: str = "spearman", targets=None) -> DataFrame:
    """Full matrix in long form (feature_a, feature_b, r, p, stars), targets last, diagonal r = 1, p = 0."""
    names = choose_numeric(df, columns)
    last = [t for t in as_list(targets) if t in numeric_columns(df)]
    names = [c for c in names if c not in last] + last
    pairs = correlation_long(df, names, method)
    kept = _varying(df, names)
    spark = df.sparkSession
    seen = spark.createDataFrame([(c, i) for i, c in enumerate(kept)], "feature string, at int")
    diagonal = seen.select(F.col("feature").alias("feature_a"), F.col("feature").alias("feature_b"), F.lit(1.0).alias("r"), F.lit(0.0).alias("p"))
    upper = pairs.select(F.col("col_a").alias("feature_a"), F.col("col_b").alias("feature_b"), "r", "p")
    lower = pairs.select(F.col("col_b").alias("feature_a"), F.col("col_a").alias("feature_b"), "r", "p")
    cells = upper.unionByName(lower).unionByName(diagonal)
    a, b = seen.toDF("feature_a", "at_a"), seen.toDF("feature_b", "at_b")
    return cells.join(F.broadcast(a), "feature_a").join(F.broadcast(b), "feature_b").select(
        "feature_a", "feature_b", "at_a", "at_b", "r", "p", significance_stars(F.col("p")).alias("stars"))


def _varying(df: DataFrame, names: list[str]) -> list[str]:
    facts = aggregate_once(df, {c: F.min(col(c)) < F.max(col(c)) for c in names})
    kept = [c for c in names if facts[c]]
    if not kept:
        raise ValueError("all numeric columns are constant")
    return kept


def significance_stars(p):
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def high_correlation_pairs(df: DataFrame, columns=None, method: str = "spearman", threshold: float = 0.85,
                           p_threshold: float = 0.005) -> DataFrame:
    pairs = correlation_long(df, columns, method)
    strong = (F.abs("r") > threshold) & (F.col("p") <= p_threshold)
    return pairs.filter(strong).select("col_a", "col_b", F.round("r", 4).alias("r"))
