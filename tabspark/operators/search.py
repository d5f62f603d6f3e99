"""Search for the inputs that give the best outcome: candidate tables scored in bulk."""

from __future__ import annotations

import logging
import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.columns import SEED, aggregate_once, col, require
from tabspark.functions.lookup import lookup
from tabspark.session import materialize

log = logging.getLogger(__name__)

MAX_CHOICES = 10_000
PARENTS = 50


@dataclass(frozen=True)
class Range:
    """start..end, both included; whole numbers if ``start`` is one; ``step`` a width or "log"."""

    start: float
    end: float
    step: float | str | None = None

    def __post_init__(self):
        if self.end < self.start:
            raise ValueError(f"range ends before it starts: {self}")
        if self.step == "log" and self.start <= 0:
            raise ValueError("a log range needs a positive start")

    @property
    def whole(self) -> bool:
        return isinstance(self.start, int) and not isinstance(self.start, bool)

    def draw(self, rng: random.Random):
        u = rng.random()
        if self.step == "log":
            value = math.exp(math.log(self.start) + u * (math.log(self.end) - math.log(self.start)))
            return min(self.end, round(value)) if self.whole else value
        width = self.step or (1 if self.whole else None)
        if width is None:
            return self.start + u * (self.end - self.start)
        return self.start + width * min(int(u * (math.floor((self.end - self.start) / width + 1e-9) + 1)), math.floor((self.end - self.start) / width + 1e-9))

    def column(self, u: Column) -> Column:
        """Value for a uniform draw in [0, 1)."""
        kind = "bigint" if self.whole else "double"
        if self.step == "log":
            low, high = math.log(self.start), math.log(self.end)
            value = F.exp(F.lit(low) + u * (high - low))
            value = F.round(value) if self.whole else value
            return F.least(F.greatest(value, F.lit(float(self.start))), F.lit(float(self.end))).cast(kind)
        width = self.step or (1 if self.whole else None)
        if width is None:
            return (F.lit(float(self.start)) + u * float(self.end - self.start)).cast(kind)
        steps = math.floor((self.end - self.start) / width + 1e-9)
        return (F.lit(float(self.start)) + F.floor(u * (steps + 1)) * float(width)).cast(kind)

    def near(self, centre: Column, u: Column, reach: float) -> Column:
        """Draw within ``reach`` of the span around a value, on the range's own grid."""
        def position(v):
            if self.step == "log":
                low, high = math.log(self.start), math.log(self.end)
                return (F.ln(v.cast("double")) - low) / ((high - low) or 1.0)
            return (v.cast("double") - float(self.start)) / (float(self.end - self.start) or 1.0)
        moved = F.least(F.greatest(position(centre) + (u - 0.5) * 2 * reach, F.lit(0.0)), F.lit(1.0 - 1e-12))
        return self.column(moved)


@dataclass(frozen=True)
class Choice:
    values: tuple

    def __init__(self, values: Sequence[Any]):
        object.__setattr__(self, "values", tuple(values))
        if not self.values:
            raise ValueError("a choice needs at least one value")

    def draw(self, rng: random.Random):
        return rng.choice(self.values)

    def column(self, u: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in self.values]), (F.floor(u * len(self.values)) + 1).cast("int"))

    def near(self, centre: Column, u: Column, reach: float) -> Column:
        return F.when(u < reach, self.column(u / reach)).otherwise(centre)


Space = Mapping[str, Range | Choice]


def infer_space(df: DataFrame, x_names: Sequence[str] | None = None) -> dict[str, Range | Choice]:
    """Ranges of numeric columns, both values of booleans, distinct texts; other types are skipped."""
    names = require(df, x_names if x_names is not None else df.columns)
    kinds = {c: df.schema[c].dataType for c in names}
    numbers = [c for c in names if isinstance(kinds[c], T.NumericType)]
    facts = aggregate_once(df, {**{("lo", c): F.min(col(c)) for c in numbers}, **{("hi", c): F.max(col(c)) for c in numbers}})
    space: dict[str, Range | Choice] = {}
    for c in names:
        if c in numbers:
            if facts["lo", c] is None:
                continue
            make = int if isinstance(kinds[c], T.IntegralType) else float
            space[c] = Range(make(facts["lo", c]), make(facts["hi", c]))
        elif isinstance(kinds[c], T.BooleanType):
            space[c] = Choice([True, False])
        elif isinstance(kinds[c], T.StringType):
            found = df.select(col(c).alias("v")).filter("v IS NOT NULL").distinct().limit(MAX_CHOICES + 1).collect()
            if len(found) > MAX_CHOICES:
                raise ValueError(f"{c} has more than {MAX_CHOICES} values; give its choices")
            if found:
                space[c] = Choice(sorted(r["v"] for r in found))
        else:
            log.warning("%s of type %s is left out of the search", c, kinds[c].simpleString())
    return space


def _uniform(seed: int, salt: int) -> Column:
    """Draw in [0, 1) that depends on the candidate's id only, not on how the table is cut."""
    return F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), 11).cast("double") * (2.0 ** -53)


def sample_candidates(spark: SparkSession, space: Space, n: int, seed: int = SEED) -> DataFrame:
    return spark.range(n).select("id", *[s.column(_uniform(seed, i)).alias(c) for i, (c, s) in enumerate(space.items())])


def sample_near(spark: SparkSession, space: Space, parents: list[dict], n: int, first_id: int, reach: float, seed: int = SEED) -> DataFrame:
    """Candidates around a short list of good rows."""
    kinds = {c: s.column(F.lit(0.0)) for c, s in space.items()}
    table = F.array(*[F.struct(*[F.lit(p[c]).alias(c) for c in kinds]) for p in parents])
    chosen = spark.range(first_id, first_id + n).withColumn("__p", F.element_at(table, (F.pmod(F.col("id"), F.lit(len(parents))) + 1).cast("int")))
    return chosen.select("id", *[s.near(F.col("__p")[c], _uniform(seed, i), reach).alias(c) for i, (c, s) in enumerate(space.items())])


def apply_rule(candidates: DataFrame, rule: Column | str | Callable[[pd.DataFrame], Any] | None) -> DataFrame:
    """Keep rows for which the rule holds: a boolean column, SQL text, or a function of the candidate table
    (an Arrow batch) that returns one boolean per row.  An exception in the function fails the job."""
    if rule is None:
        return candidates
    if not callable(rule) or isinstance(rule, Column):
        return candidates.filter(rule)
    names = list(candidates.columns)

    def keep(batches):
        for pdf in batches:
            yield pdf[np.asarray(rule(pdf[[c for c in names if c != "id"]]), dtype=bool)]

    return candidates.mapInPandas(keep, candidates.schema)


def inverse_search(models, space: Space, directions: Mapping[str, str], rule=None, n_trials: int = 10_000, rounds: int = 3,
                   seed: int = SEED) -> DataFrame:
    """Inputs, outcomes and ``rank`` (single target) or ``pareto`` (several) of all allowed candidates.

    Half of the candidates are spread over the space, the rest are drawn around the best rows so far with
    a reach that shrinks every round.  Each round is scored in bulk by the fold ensemble.
    """
    from tabspark.operators.training import ensemble_predict

    models = list(models)
    targets = list(dict.fromkeys(m.y_name for m in models))
    inputs = list(dict.fromkeys(c for m in models for c in m.x_names))
    if set(directions) != set(targets):
        raise ValueError(f"directions must name exactly the targets {targets}, got {sorted(directions)}")
    bad = {d for d in directions.values() if d not in ("maximize", "minimize")}
    if bad:
        raise ValueError(f"a direction is maximize or minimize, got {sorted(bad)}")
    absent = [c for c in inputs if c not in space]
    if absent:
        raise ValueError(f"the space does not cover the inputs {absent}")
    extra = [c for c in space if c not in inputs]
    if extra:
        log.warning("columns unknown to the model do not change the outcome: %s", extra)
    spark = SparkSession.getActiveSession()
    outcome = {t: f"{t}_pred" for t in targets}

    def scored(candidates: DataFrame) -> DataFrame:
        out = ensemble_predict(models, apply_rule(candidates, rule))
        return out.select("id", *[col(c) for c in space], *[col(outcome[t]).cast("double").alias(t) for t in targets])

    first = n_trials if rounds < 1 else max(1, n_trials // 2)
    everything = materialize(scored(sample_candidates(spark, space, first, seed)))
    used = first
    for r in range(rounds):
        n = (n_trials - used) // (rounds - r)
        if n < 1:
            break
        parents = _best(everything, targets, directions).limit(PARENTS).collect()  # PARENTS rows at most
        if not parents:
            break
        more = sample_near(spark, space, [p.asDict() for p in parents], n, used, 0.25 * 0.4 ** r, seed + r + 1)
        everything = everything.unionByName(materialize(scored(more)))
        used += n
    if len(targets) == 1:
        return _with_rank(everything, targets[0], directions[targets[0]])
    return with_pareto_flag(everything, directions)


def _order(target: str, direction: str) -> Column:
    return F.desc(target) if direction == "maximize" else F.asc(target)


def _best(df: DataFrame, targets: list[str], directions: Mapping[str, str]) -> DataFrame:
    if len(targets) == 1:
        return df.orderBy(_order(targets[0], directions[targets[0]]), "id")
    return with_pareto_flag(df, directions).filter("pareto").orderBy("id")


def _with_rank(df: DataFrame, target: str, direction: str) -> DataFrame:
    from tabspark.functions.order_stats import with_global_rank

    signed = df.withColumn("__o", F.col(target) * (-1.0 if direction == "maximize" else 1.0))
    ranked = with_global_rank(signed, ["id"], order_by=["__o"])
    return ranked.withColumn("rank", F.col("rank") + 1).drop("__o")


def _beaten(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which of ``rows`` some row of ``others`` dominates: nowhere worse, somewhere better."""
    if rows.shape[1] == 2 and len(others):
        order = np.lexsort((others[:, 1], others[:, 0]))
        first, low = others[order, 0], np.minimum.accumulate(others[order, 1])
        at_most, less = np.searchsorted(first, rows[:, 0], "right"), np.searchsorted(first, rows[:, 0], "left")
        best_up_to = np.where(at_most > 0, low[np.maximum(at_most - 1, 0)], np.iinfo(np.int64).max)
        best_before = np.where(less > 0, low[np.maximum(less - 1, 0)], np.iinfo(np.int64).max)
        return (best_before <= rows[:, 1]) | (best_up_to < rows[:, 1])
    out = np.zeros(len(rows), bool)
    for i in range(0, len(rows), 128):
        part = rows[i : i + 128, None, :]
        for j in range(0, len(others), 4096):
            o = others[None, j : j + 4096, :]
            out[i : i + 128] |= (np.all(o <= part, axis=2) & np.any(o < part, axis=2)).any(axis=1)
    return out


def _skyline(costs: np.ndarray) -> np.ndarray:
    """Rows that no other row beats in all columns (ties in everything stay)."""
    return np.flatnonzero(~_beaten(costs, costs))


def _ranks(values: pd.Series, descending: bool) -> np.ndarray:
    """Dense ranks of a batch, smallest best."""
    codes = np.unique(values.to_numpy(), return_inverse=True)[1].astype(np.int64)
    return -codes if descending else codes


CELL_ROWS = 1_000  # rows that a cell of the grid should hold
CELLS = 20_000  # cells that the driver compares


def with_pareto_flag(df: DataFrame, directions: Mapping[str, str]) -> DataFrame:
    """``pareto`` is true for rows that no other row dominates.

    Outcomes are made distinct and thinned batch by batch; what is left is laid on a grid.  A cell goes as a whole if another
    lies below it in every direction, and its rows are compared with those of cells that lie nowhere above it only.  So
    rows that do not dominate each other never meet in one task, however many they are.
    """
    names = list(directions)
    # the columns' own types: a double could not tell large whole numbers apart
    best_first = [directions[t] == "maximize" for t in names]
    fields = [f"c{i}" for i in range(len(names))]
    # equal outcomes are compared once; adding 0.0 makes the two zeros one
    plain = [F.when(col(t) == 0, F.lit(0).cast(df.schema[t].dataType)).otherwise(col(t)).alias(f) for t, f in zip(names, fields)]
    counts = df.select(*plain).dropna().groupBy(*fields).agg(F.count(F.lit(1)).alias("__n"))

    def ranks(pdf):
        return np.column_stack([_ranks(pdf[f], high) for f, high in zip(fields, best_first)])

    def thin(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.iloc[_skyline(ranks(pdf))]

    front = materialize(counts.mapInPandas(thin, counts.schema))
    n, d = front.count(), len(names)
    if n:
        bins = max(1, min(math.ceil((n / CELL_ROWS / d) ** (1 / max(1, d - 1))), math.floor(CELLS ** (1 / d)) if d > 2 else CELLS // 2))
        signed = front.select(*[(F.col(f).cast("double") * (-1.0 if high else 1.0)).alias(f) for f, high in zip(fields, best_first)])
        cuts = [np.unique(c) for c in signed.approxQuantile(fields, [i / bins for i in range(1, bins)], 0.25 / bins)] if bins > 1 else [np.zeros(0)] * d
        front = materialize(_kept_in_cells(front, fields, best_first, cuts, ranks))
    mark = front.select(*fields, "__n", F.lit(True).alias("__best"))
    keyed = df.select("*", *plain)
    out = lookup(keyed, mark, fields, count_col="__n")
    return out.select(*[col(c) for c in df.columns], F.coalesce("__best", F.lit(False)).alias("pareto"))


def _kept_in_cells(front: DataFrame, fields: list[str], best_first: list[bool], cuts: list[np.ndarray], ranks) -> DataFrame:
    def lay(batches):
        for pdf in batches:
            at = [np.searchsorted(cut, pdf[f].to_numpy(float) * (-1.0 if high else 1.0), side="left") for f, high, cut in zip(fields, best_first, cuts)]
            yield pdf.assign(__cell=[",".join(map(str, c)) for c in zip(*at)])

    laid = materialize(front.mapInPandas(lay, front.drop("__cell").withColumn("__cell", F.lit("")).schema))
    cells = [tuple(map(int, r["__cell"].split(","))) for r in laid.select("__cell").distinct().collect()]  # cells with rows, about CELLS at most
    place = np.array(cells)
    alive = np.array([not np.any(np.all(place < c, axis=1)) for c in place])
    place = place[alive]
    pairs = []
    for c in place:  # a cell that lies below in all directions has removed this one already
        name = ",".join(map(str, c))
        pairs += [(",".join(map(str, o)), name, bool((o == c).all())) for o in place[np.all(place <= c, axis=1)]]
    meets = front.sparkSession.createDataFrame(pairs, "__cell string, __target string, __own boolean")
    dealt = laid.join(F.broadcast(meets), "__cell")  # cells that meet; few per cell on a front

    def settle(pdf):
        own = pdf["__own"].to_numpy(bool)
        cost = ranks(pdf)
        return pdf[own][~_beaten(cost[own], cost)].drop(columns=["__cell", "__target", "__own"])

    return dealt.groupBy("__target").applyInPandas(settle, front.schema)
