"""Fold assignment as columns.

The contract is sizes, coverage, balance and reproducibility for a seed; a shuffle is the order of a
seeded hash of the row key, so it does not depend on how the input is partitioned.  Every assignment
is one column; the train side of a fold is "all other rows" and is never written out per fold unless
``splits`` is asked for.
"""

from __future__ import annotations

import heapq
import logging
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabspark.columns import SEED, as_list, col, require
from tabspark.functions.lookup import lookup
from tabspark.functions.order_stats import with_global_rank
from tabspark.session import materialize

log = logging.getLogger(__name__)

MAX_WRITTEN_FOLDS = 1_000
SIGNATURES_ON_DRIVER = 50_000
LABEL_SETS = 20_000  # different label sets that are dealt; with more, stratification has no meaning


class FoldError(ValueError):
    pass


@dataclass
class Folds:
    """``table`` has the key, ``fold`` (where the row is tested) and, if repeated, ``repeat``; a simple
    split has ``split`` instead of ``fold``.  Unrepeated tables carry all columns of the input."""

    table: DataFrame
    key: list[str]
    n_folds: int
    source: DataFrame
    repeats: int = 1
    simple: bool = False

    @property
    def per_repeat(self) -> int:
        return self.n_folds // self.repeats

    def persist(self) -> Folds:
        self.table = self.table.persist()
        return self

    def unpersist(self) -> None:
        self.table.unpersist()

    def split(self, fold: int) -> DataFrame:
        """All rows of the source with their ``split`` in one fold."""
        if not 0 <= fold < self.n_folds:
            raise FoldError(f"fold {fold} of {self.n_folds}")
        if self.simple:
            return self.table
        side = F.when(F.col("fold") == fold % self.per_repeat, "test").otherwise("train").alias("split")
        if self.repeats == 1:
            return self.table.select(*[col(c) for c in self.source.columns], side)
        one = self.table.filter(F.col("repeat") == fold // self.per_repeat).select(*[col(k) for k in self.key], side)
        return self.source.join(one, self.key)

    def train(self, fold: int) -> DataFrame:
        return self.split(fold).filter("split = 'train'").drop("split")

    def val(self, fold: int) -> DataFrame | None:
        return self.split(fold).filter("split = 'val'").drop("split") if self.simple else None

    def test(self, fold: int) -> DataFrame:
        return self.split(fold).filter("split = 'test'").drop("split")

    def splits(self) -> DataFrame:
        """(key..., fold, split) of all folds: rows x folds, so only for a moderate number of folds."""
        keys = [col(k) for k in self.key]
        if self.simple:
            return self.table.select(*keys, F.lit(0).alias("fold"), "split")
        if self.per_repeat > MAX_WRITTEN_FOLDS:
            raise FoldError(f"{self.n_folds} folds would write every row {self.per_repeat} times; use split(fold)")
        repeat = F.col("repeat") if self.repeats > 1 else F.lit(0)
        long = self.table.select(*keys, repeat.alias("__r"), F.col("fold").alias("__f"),
                                 F.explode(F.sequence(F.lit(0), F.lit(self.per_repeat - 1))).alias("__at"))
        return long.select(*keys, (F.col("__r") * self.per_repeat + F.col("__at")).cast("int").alias("fold"),
                           F.when(F.col("__f") == F.col("__at"), "test").otherwise("train").alias("split"))

    def summary(self) -> DataFrame:
        """(fold, train, val, test) sizes; training sizes follow from the totals."""
        if self.simple:
            def size(s):
                return F.count(F.when(F.col("split") == s, 1)).alias(s)
            return self.table.agg(size("train"), size("val"), size("test")).select(F.lit(0).alias("fold"), "train", "val", "test")
        repeat = F.col("repeat") if self.repeats > 1 else F.lit(0)
        sizes = self.table.groupBy(repeat.alias("r"), "fold").agg(F.count(F.lit(1)).alias("test"))
        totals = sizes.groupBy(F.col("r").alias("r2")).agg(F.sum("test").alias("n"))
        return sizes.join(F.broadcast(totals), F.col("r") == F.col("r2")).select(  # one row per repeat
            (F.col("r") * self.per_repeat + F.col("fold")).cast("int").alias("fold"),
            (F.col("n") - F.col("test")).alias("train"), F.lit(0).cast("long").alias("val"), "test")


def _ranked(df: DataFrame, key, shuffle: bool, seed: int, rows: int, within: Sequence[str] = ()) -> DataFrame:
    key = require(df, as_list(key), "key columns")
    if shuffle:
        return with_global_rank(df, key, seed=seed, within=within, rows=rows, out="__rank")
    return with_global_rank(df, key, order_by=key, within=within, rows=rows, out="__rank")


def _check_k(k: int, rows: int) -> None:
    if k < 2:
        raise FoldError(f"n_splits must be at least 2, got {k}")
    if rows < k:
        raise FoldError(f"cannot split {rows} rows into {k} folds")


def simple_cv(df: DataFrame, key, train_ratio: float = 0.8, val_ratio: float | None = None, shuffle: bool = True,
              seed: int = SEED) -> Folds:
    """train/test, or train/val/test in this order of rank."""
    if not 0 < train_ratio < 1:
        raise FoldError(f"train_ratio must be within (0, 1), got {train_ratio}")
    if val_ratio is not None:
        if not 0 < val_ratio < 1:
            raise FoldError(f"val_ratio must be within (0, 1), got {val_ratio}")
        if train_ratio + val_ratio >= 1:
            raise FoldError(f"train_ratio + val_ratio must be below 1, got {train_ratio + val_ratio}")
    n = df.count()
    if val_ratio is None:
        n_train, n_val = math.floor(train_ratio * n), 0
    else:
        left = n - math.ceil((1 - train_ratio - val_ratio) * n)
        n_val = math.ceil(val_ratio / (train_ratio + val_ratio) * left)
        n_train = left - n_val
    if n_train < 1 or n - n_train - n_val < 1:
        raise FoldError(f"{n} rows are too few for these ratios")
    rank = F.col("__rank")
    side = F.when(rank < n_train, "train").when(rank < n_train + n_val, "val").otherwise("test")
    table = _ranked(df, key, shuffle, seed, n).withColumn("split", side).drop("__rank")
    return Folds(table, as_list(key), 1, df, simple=True)


def _fold_of_rank(n: int, k: int):
    """The first n mod k folds get one row more."""
    size, extra = divmod(n, k)
    cut = extra * (size + 1)
    rank = F.col("__rank")
    later = F.floor((rank - cut) / F.lit(max(size, 1))) + extra
    return F.when(rank < cut, F.floor(rank / F.lit(size + 1))).otherwise(later).cast("int")


def k_fold(df: DataFrame, key, n_splits: int = 5, shuffle: bool = True, seed: int = SEED) -> Folds:
    n = df.count()
    _check_k(n_splits, n)
    table = _ranked(df, key, shuffle, seed, n).withColumn("fold", _fold_of_rank(n, n_splits)).drop("__rank")
    return Folds(table, as_list(key), n_splits, df)


def _repeat_keys(df: DataFrame, columns: list[str], n_repeats: int) -> DataFrame:
    if n_repeats < 1:
        raise FoldError(f"n_repeats must be at least 1, got {n_repeats}")
    return df.select(*[col(c) for c in columns], F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1))).alias("repeat"))


def repeated_k_fold(df: DataFrame, key, n_splits: int = 5, n_repeats: int = 10, seed: int = SEED) -> Folds:
    """Keys only, once per repeat; the hash takes the repeat in, so each repeat has its own order."""
    key, n = as_list(key), df.count()
    _check_k(n_splits, n)
    long = _repeat_keys(df, key, n_repeats)
    ranked = with_global_rank(long, [*key, "repeat"], seed=seed, within=["repeat"], rows=n * n_repeats, out="__rank")
    table = ranked.withColumn("fold", _fold_of_rank(n, n_splits)).drop("__rank")
    return Folds(table, key, n_splits * n_repeats, df, repeats=n_repeats)


def _stratified(df: DataFrame, key: list[str], stratum: str, k: int, shuffle: bool, seed: int, rows: int,
                within: Sequence[str] = ()) -> DataFrame:
    """Deal the rows of each class to the folds in turn; a class starts where the one before it ended."""
    sizes = df.groupBy(*[col(w) for w in within], col(stratum)).agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(*([col(w) for w in within] or [F.lit(0)])).orderBy(col(stratum))
    starts = sizes.withColumn("__start", F.sum("__rows").over(before.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__rows"))
    ranked = with_global_rank(df, key, seed=seed if shuffle else None, order_by=None if shuffle else key,
                              within=[*within, stratum], rows=rows, out="__rank")
    dealt = lookup(ranked, starts, [*within, stratum], "__rows")
    return dealt.withColumn("fold", F.pmod(F.col("__start") + F.col("__rank"), F.lit(k)).cast("int")).drop("__rank", "__start")


def _check_classes(df: DataFrame, target: str, k: int) -> None:
    sizes = df.groupBy(col(target)).count().agg(F.min("count").alias("least"), F.max("count").alias("most")).first()
    if sizes["most"] is None or sizes["most"] < k:
        raise FoldError(f"no class of {target} has {k} rows")
    if sizes["least"] < k:
        log.warning("the rarest class of %s has %d rows, fewer than %d folds", target, sizes["least"], k)


def stratified_k_fold(df: DataFrame, key, targets, n_splits: int = 5, shuffle: bool = True, seed: int = SEED) -> Folds:
    """Per-class balance; several 0/1 targets are dealt label by label, the rarest first (see ``deal_label_sets``)."""
    key, targets = as_list(key), require(df, as_list(targets), "target columns")
    n = df.count()
    _check_k(n_splits, n)
    if not targets:
        raise FoldError("stratified folds need a target")
    if len(targets) == 1:
        _check_classes(df, targets[0], n_splits)
        table = _stratified(df, key, targets[0], n_splits, shuffle, seed, n)
    else:
        table = _by_label_sets(df, key, targets, n_splits, shuffle, seed, n)
    return Folds(table, key, n_splits, df)


def deal_label_sets(sets: dict[tuple[int, ...], int], k: int) -> list[tuple[tuple[int, ...], list[int]]]:
    """How many rows of each label set every fold gets, by iterative stratification.

    Rounds go by the label with the fewest rows left: each of its rows goes to the fold that lacks most of this label, on
    ties of the other labels of the row, and then of rows.  Rows of one set are interchangeable, so a set is dealt at once: all but its
    last rows by arithmetic, these one by one.  Demands are kept in k-ths, so they are whole numbers.
    """
    width = len(next(iter(sets)))
    lack = [[sum(n for s, n in sets.items() if s[j])] * k for j in range(width)]
    room, left, out = [sum(sets.values())] * k, dict(sets), []

    def give(s, n, order):
        given = [0] * k
        sure = n - 2 * k
        if order and sure > 0:
            given = _fill_lightest([-x for x in lack[order[0]]], k, sure)
        elif sure > 0:
            given = _fill_lightest([-x for x in room], k, sure)

        def spend(i, m):
            room[i] -= k * m
            for j in order:
                lack[j][i] -= k * m

        for i, m in enumerate(given):
            spend(i, m)
        for _ in range(n - sum(given)):
            i = max(range(k), key=lambda i: (*[lack[j][i] for j in order], room[i], -i))
            spend(i, 1)
            given[i] += 1
        out.append((s, given))

    while left:
        rows = [sum(n for s, n in left.items() if s[j]) for j in range(width)]
        rarest = min((j for j in range(width) if rows[j]), key=lambda j: (rows[j], j), default=None)
        mine = sorted(s for s in left if rarest is None or s[rarest])
        for s in mine:
            order = sorted((j for j in range(width) if s[j]), key=lambda j: (j != rarest, rows[j], j))
            give(s, left.pop(s), order)
    return out


def _by_label_sets(df: DataFrame, key: list[str], targets: list[str], k: int, shuffle: bool, seed: int, n: int) -> DataFrame:
    """The driver deals the histogram of label sets; rows of a set are numbered on the cluster and take their fold by number."""
    marks = [F.when(col(t) > 0, 1).otherwise(0) for t in targets]
    labelled = df.withColumn("__rows", F.concat_ws("", *[m.cast("string") for m in marks]))
    found = labelled.groupBy("__rows").agg(F.count(F.lit(1)).alias("n")).limit(LABEL_SETS + 1).collect()
    if len(found) > LABEL_SETS:
        raise FoldError(f"more than {LABEL_SETS} different label sets: stratify on fewer labels")
    ranges = []
    for s, given in deal_label_sets({tuple(map(int, r["__rows"])): r["n"] for r in found}, k):
        at = 0
        for fold, m in enumerate(given):
            if m:
                ranges.append(("".join(map(str, s)), at, at + m, fold))
            at += m
    numbered = with_global_rank(labelled, key, seed=seed if shuffle else None, order_by=None if shuffle else key, within=["__rows"], rows=n, out="__at")
    plan = df.sparkSession.createDataFrame(ranges, "__size string, __from bigint, __to bigint, fold int")
    inside = (F.col("__rows") == F.col("__size")) & (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__to"))
    return numbered.join(F.broadcast(plan), inside).drop("__rows", "__at", "__size", "__from", "__to")  # at most LABEL_SETS * k rows


def repeated_stratified_k_fold(df: DataFrame, key, target: str, n_splits: int = 5, n_repeats: int = 10, seed: int = SEED) -> Folds:
    key, n = as_list(key), df.count()
    _check_k(n_splits, n)
    _check_classes(df, target, n_splits)
    long = _repeat_keys(df, [*key, target], n_repeats)
    table = _stratified(long, [*key, "repeat"], target, n_splits, True, seed, n * n_repeats, within=["repeat"])
    return Folds(table.select(*[col(k) for k in key], "repeat", "fold"), key, n_splits * n_repeats, df, repeats=n_repeats)


def _group_columns(df: DataFrame, group_by) -> list[str]:
    groups = [g for g in as_list(group_by) if g]
    if not groups:
        raise FoldError("at least one group column is needed")
    return require(df, groups, "group columns")


def _fill_lightest(loads: list[int], size: int, items: int) -> list[int]:
    """How many of ``items`` equal groups each fold gets when every group goes to the lightest fold.

    Whole rounds are taken by arithmetic, so the cost does not grow with the number of groups.
    """
    k = len(loads)
    given = [0] * k
    if items > 4 * k:
        # fold i takes its j-th group at load L_i + j * size: take all of those below a common level
        low, high = min(loads), max(loads) + size * (items // k + 2)
        while high - low > size:
            level = (low + high) // 2
            if sum(max(0, -(-(level - x) // size)) for x in loads) <= items:
                low = level
            else:
                high = level
        given = [max(0, -(-(low - x) // size)) for x in loads]
    heap = [(loads[i] + given[i] * size, i) for i in range(k)]
    heapq.heapify(heap)
    for _ in range(items - sum(given)):
        load, i = heapq.heappop(heap)
        given[i] += 1
        heapq.heappush(heap, (load + size, i))
    return given


def group_k_fold(df: DataFrame, key, group_by, k: int = 5, seed: int = SEED) -> Folds:
    """Groups stay together; largest groups first, each to the lightest fold.

    Groups of equal size are interchangeable, so the driver works on the histogram of group sizes (at
    most sqrt(2 n) different sizes) and the groups of a size are numbered on the cluster.
    """
    groups = _group_columns(df, group_by)
    _check_k(k, df.count())
    sizes = materialize(df.groupBy(*[col(g) for g in groups]).agg(F.count(F.lit(1)).alias("__rows")))
    histogram = sorted(((r["__rows"], r["n"]) for r in sizes.groupBy("__rows").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    n_groups = sum(n for _, n in histogram)
    if k > n_groups:
        raise FoldError(f"k = {k} exceeds the {n_groups} groups; use leave_one_group_out for one fold per group")
    loads, ranges = [0] * k, []
    for size, items in histogram:
        given = _fill_lightest(loads, size, items)
        start = 0
        for i, g in enumerate(given):
            if g:
                ranges.append((size, start, start + g, i))
            loads[i] += g * size
            start += g
    numbered = with_global_rank(sizes, groups, seed=seed, within=["__rows"], rows=n_groups, out="__at")
    return Folds(_place_groups(df, numbered, ranges, groups), as_list(key), k, df)


def _place_groups(df: DataFrame, numbered: DataFrame, ranges: list[tuple], groups: list[str]) -> DataFrame:
    spark = df.sparkSession
    plan = spark.createDataFrame(ranges, "__size bigint, __from bigint, __to bigint, fold int")
    inside = (F.col("__rows") == F.col("__size")) & (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__to"))
    placed = numbered.join(F.broadcast(plan), inside).select(*[col(g) for g in groups], "__rows", "fold")
    return lookup(df, placed, groups, "__rows")


def stratified_group_k_fold(df: DataFrame, key, target: str, group_by, n_splits: int = 5, seed: int = SEED) -> Folds:
    """Groups stay together while class shares stay even.

    Groups with the same class counts are interchangeable: the driver deals count vectors, most uneven
    first, to the fold where the spread of class shares stays least.  If there are more vectors than
    ``SIGNATURES_ON_DRIVER``, the small groups beyond are dealt in turn within their largest class on
    the cluster.
    """
    groups = _group_columns(df, group_by)
    require(df, [target], "target columns")
    _check_k(n_splits, df.count())
    totals = {r[0]: r[1] for r in df.groupBy(col(target)).count().limit(10_001).collect()}
    if len(totals) > 10_000:
        raise FoldError(f"{target} has too many classes to stratify on")
    classes = sorted(totals, key=str)
    counts = df.groupBy(*[col(g) for g in groups]).agg(
        F.count(F.lit(1)).alias("__rows"),
        F.array(*[F.count(F.when(col(target).eqNullSafe(F.lit(c)), 1)) for c in classes]).alias("__sig"))
    counts = materialize(counts)
    n_groups = counts.count()
    if n_splits > n_groups:
        raise FoldError(f"n_splits = {n_splits} exceeds the {n_groups} groups")
    kinds = counts.groupBy("__sig").agg(F.count(F.lit(1)).alias("n"), F.max("__rows").alias("rows"))
    head = kinds.orderBy(F.desc("rows"), "__sig").limit(SIGNATURES_ON_DRIVER).collect()
    plan = _deal_signatures([(list(r["__sig"]), r["n"]) for r in head], [totals[c] for c in classes], n_splits)
    spark = df.sparkSession
    ranges = spark.createDataFrame(plan, "__size array<bigint>, __from bigint, __to bigint, fold int")
    numbered = with_global_rank(counts, groups, seed=seed, within=["__sig"], rows=n_groups, out="__at")
    inside = (F.col("__sig") == F.col("__size")) & (F.col("__at") >= F.col("__from")) & (F.col("__at") < F.col("__to"))
    placed = numbered.join(F.broadcast(ranges), inside, "left")
    if kinds.count() > len(head):
        largest = placed.withColumn("__top", F.array_position("__sig", F.array_max("__sig")))
        turn = with_global_rank(largest.filter("fold IS NULL"), groups, seed=seed, within=["__top"], rows=n_groups, out="__turn")
        dealt = turn.withColumn("fold", F.pmod(F.col("__turn") + F.col("__top"), F.lit(n_splits)).cast("int"))
        placed = placed.filter("fold IS NOT NULL").select(*groups, "__rows", "fold").unionByName(dealt.select(*groups, "__rows", "fold"))
    return Folds(lookup(df, placed.select(*[col(g) for g in groups], "__rows", "fold"), groups, "__rows"), as_list(key), n_splits, df)


def _deal_signatures(kinds: list[tuple[list[int], int]], totals: list[int], k: int) -> list[tuple]:
    import numpy as np

    kinds = sorted(kinds, key=lambda t: (-float(np.std(t[0])), -sum(t[0]), t[0]))
    load, scale = np.zeros((k, len(totals))), np.array(totals, dtype=float)
    plan = []
    for sig, n in kinds:
        vector = np.array(sig, dtype=float)
        rounds, rest = divmod(n, k)
        given = np.full(k, rounds)
        load += rounds * vector
        for _ in range(rest):
            spread = []
            for i in range(k):
                load[i] += vector
                spread.append((round(float(np.std(load / scale, axis=0).mean()), 12), float(load[i].sum()), i))
                load[i] -= vector
            best = min(spread)[2]
            load[best] += vector
            given[best] += 1
        start = 0
        for i, g in enumerate(given):
            if g:
                plan.append((sig, start, start + int(g), i))
                start += int(g)
    return plan


def leave_one_group_out(df: DataFrame, key, group_by) -> Folds:
    """One fold per group, numbered in group order."""
    groups = _group_columns(df, group_by)
    sizes = materialize(df.groupBy(*[col(g) for g in groups]).agg(F.count(F.lit(1)).alias("__rows")))
    n_groups = sizes.count()
    if n_groups < 2:
        raise FoldError(f"{n_groups} group(s) are too few to leave one out")
    if n_groups > 5:
        log.warning("%d groups give %d folds; group_k_fold needs fewer", n_groups, n_groups)
    numbered = with_global_rank(sizes, groups, order_by=groups, rows=n_groups, out="fold")
    table = lookup(df, numbered.withColumn("fold", F.col("fold").cast("int")), groups, "__rows")
    return Folds(table, as_list(key), n_groups, df)


def leave_one_out(df: DataFrame, key) -> Folds:
    """One fold per row, in key order."""
    n = df.count()
    if n < 2:
        raise FoldError("leave-one-out needs at least two rows")
    table = _ranked(df, key, False, SEED, n).withColumnRenamed("__rank", "fold")
    return Folds(table, as_list(key), n, df)
