"""Feature transforms: ``fit`` is an aggregate over training rows, ``apply`` a set of column expressions.

Columns that a transform does not name pass through.  Row-wise transforms also apply to streams.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabspark.columns import aggregate_once, as_list, choose_category, choose_numeric, col, numeric_columns, require
from tabspark.functions.lookup import lookup
from tabspark.functions.order_stats import column_quantiles, with_global_rank
from tabspark.session import materialize

MAX_ONEHOT = 2_000
INNER_FOLDS = 5
EXPRESSIONS_PER_JOB = 400


@dataclass
class Transform:
    """A fitted transform: new or replaced columns, dropped columns, and mappings to join."""

    exprs: dict[str, Column] = field(default_factory=dict)
    drop: list[str] = field(default_factory=list)
    joins: list[tuple[DataFrame, str, str, Column]] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    recipe: dict = field(default_factory=dict)  # kind and fitted values (plain JSON) that rebuild the expressions

    def apply(self, df: DataFrame) -> DataFrame:
        for mapping, source, out, default in self.joins:
            keyed = mapping.withColumnRenamed("__value", "__k").withColumn("__code", F.col("__code"))
            carried = df.withColumn("__k", col(source).cast("string"))
            joined = lookup(carried, keyed, ["__k"], "__rows").drop("__k")
            value = F.coalesce(F.col("__code"), default)
            names = [*joined.columns[:-1]]
            picked = [value.alias(c) if c == out else col(c) for c in names]
            df = joined.select(*picked, *([] if out in names else [value.alias(out)]))
        kept = [c for c in df.columns if c not in self.drop]
        return df.select(
            *[self.exprs[c].alias(c) if c in self.exprs else col(c) for c in kept],
            *[e.alias(c) for c, e in self.exprs.items() if c not in kept],
        )

    def fit_apply(self, df: DataFrame) -> DataFrame:
        """Values for the training rows; differs from ``apply`` only for cross-fitted encoders."""
        return self.apply(df)


Fitter = Callable[[DataFrame], Transform]
BUILDERS: dict[str, Callable[..., Transform]] = {}


def builder(fn: Callable[..., Transform]) -> Callable[..., Transform]:
    """Register a function of fitted values: what is stored is its name and these values."""
    kind = fn.__name__.removeprefix("_build_")

    def build(params: dict | None = None, tables: Sequence[DataFrame] = (), **values) -> Transform:
        out = fn(*([list(tables)] if tables else []), **values)
        out.recipe, out.params = {"kind": kind, "values": values}, params if params is not None else values
        return out

    BUILDERS[kind] = build
    return build


class Chain(Transform):
    """Several transforms, each fitted on the output of the ones before it."""

    def __init__(self, steps: list[Transform]):
        super().__init__()
        self.steps = steps

    def apply(self, df: DataFrame) -> DataFrame:
        for s in self.steps:
            df = s.apply(df)
        return df


def fit_chain(df: DataFrame, fitters: Iterable[Fitter]) -> tuple[Chain, DataFrame]:
    """Fit on training rows; returns the chain and the transformed training rows."""
    steps = []
    for fit in fitters:
        step = fit(df)
        df = step.fit_apply(df)
        steps.append(step)
    return Chain(steps), df


def _num(c: str) -> Column:
    return col(c).cast("double")


def standard_scaler(df: DataFrame, columns=None) -> Transform:
    """(x - mean) / population deviation, 1 if there is none."""
    names = choose_numeric(df, columns)
    s = aggregate_once(df, {**{("m", c): F.avg(_num(c)) for c in names}, **{("s", c): F.stddev_pop(_num(c)) for c in names}})
    return _build_standard(s, columns={c: [s["m", c], s["s", c] or 1.0] for c in names})


@builder
def _build_standard(columns):
    return Transform({c: (_num(c) - F.lit(m)) / F.lit(d) for c, (m, d) in columns.items()})


def minmax_scaler(df: DataFrame, columns=None, feature_range: tuple[float, float] = (0.0, 1.0), clip: bool = False) -> Transform:
    low, high = map(float, feature_range)
    if low >= high:
        raise ValueError(f"feature_range must grow, got {feature_range}")
    names = choose_numeric(df, columns)
    s = aggregate_once(df, {**{("lo", c): F.min(_num(c)) for c in names}, **{("hi", c): F.max(_num(c)) for c in names}})
    return _build_minmax(s, columns={c: [s["lo", c], s["hi", c]] for c in names if s["lo", c] is not None}, low=low, high=high, clip=clip)


@builder
def _build_minmax(columns, low, high, clip):
    out = {}
    for c, (lo, hi) in columns.items():
        scaled = (_num(c) - lo) / F.lit((hi - lo) or 1.0) * (high - low) + low
        # least/greatest skip nulls: guard them
        out[c] = F.when(col(c).isNotNull(), F.least(F.greatest(scaled, F.lit(low)), F.lit(high))) if clip else scaled
    return Transform(out)


def robust_scaler(df: DataFrame, columns=None, with_centering: bool = True, with_scaling: bool = True,
                  quantile_range: tuple[float, float] = (25.0, 75.0)) -> Transform:
    lo, hi = quantile_range
    if not 0 <= lo <= hi <= 100:
        raise ValueError(f"quantile_range must lie within 0..100, got {quantile_range}")
    names = choose_numeric(df, columns)
    q = column_quantiles(df, names, [lo / 100, 0.5, hi / 100])
    known = [c for c in names if q[c][0] is not None]
    return _build_robust(q, columns={c: [q[c][1] if with_centering else None, ((q[c][2] - q[c][0]) or 1.0) if with_scaling else None] for c in known})


@builder
def _build_robust(columns):
    out = {}
    for c, (centre, scale) in columns.items():
        value = _num(c) if centre is None else _num(c) - centre
        out[c] = value if scale is None else value / F.lit(scale)
    return Transform(out)


_LOGS = {"e": F.ln, "10": F.log10, "2": F.log2}


def log_transformer(df: DataFrame, columns=None, base: str = "e", handle_negative: str = "error") -> Transform:
    """``shift`` adds |min| + 1 to columns that reach zero or below, ``clip`` cuts at 0 (log 0 = -infinity)."""
    if base not in _LOGS:
        raise ValueError(f"base must be one of {sorted(_LOGS)}, got {base!r}")
    if handle_negative not in ("error", "shift", "clip"):
        raise ValueError(f"handle_negative must be error, shift or clip, got {handle_negative!r}")
    names = choose_numeric(df, columns)
    least = aggregate_once(df, {c: F.min(_num(c)) for c in names}) if handle_negative == "shift" else {}
    shifts = {c: abs(least[c]) + 1 if least.get(c) is not None and least[c] <= 0 else 0.0 for c in names}
    return _build_log(least, columns=shifts, base=base, handle_negative=handle_negative)


@builder
def _build_log(columns, base, handle_negative):
    out, log = {}, _LOGS[base]
    for c, shift in columns.items():
        x = _num(c)
        if handle_negative == "shift":
            out[c] = log(x + shift)
        elif handle_negative == "clip":
            out[c] = F.when(x <= 0, F.lit(float("-inf"))).otherwise(log(x))
        else:
            problem = F.raise_error(F.lit(f"column {c} has values that are not positive; use shift or clip")).cast("double")
            out[c] = F.when(x <= 0, problem).otherwise(log(x))
    return Transform(out)


def _power(x: Column, lam: float, method: str) -> Column:
    """The Box-Cox and Yeo-Johnson transforms for one literal exponent."""
    def branch(base: Column, p: float, sign: float) -> Column:
        return sign * F.ln(base) if abs(p) < 1e-12 else sign * (F.pow(base, F.lit(p)) - 1) / p
    if method == "box-cox":
        return branch(x, lam, 1.0)
    return F.when(x >= 0, branch(x + 1, lam, 1.0)).otherwise(branch(1 - x, 2 - lam, -1.0))


def power_transformer(df: DataFrame, columns=None, method: str = "yeo-johnson", standardize: bool = True,
                      points: int = 9, rounds: int = 8) -> Transform:
    """Exponent of greatest likelihood per column.

    Each round evaluates a grid of exponents for many columns in one aggregate and narrows the grid
    around the best one (or moves it, if the best is at its edge).
    """
    if method not in ("yeo-johnson", "box-cox"):
        raise ValueError(f"method must be yeo-johnson or box-cox, got {method!r}")
    names = choose_numeric(df, columns)
    jac = {c: F.sum(F.signum(_num(c)) * F.ln(F.abs(_num(c)) + 1)) if method == "yeo-johnson" else F.sum(F.ln(F.when(_num(c) > 0, _num(c)))) for c in names}
    s = aggregate_once(df, {
        **{("n", c): F.count(col(c)) for c in names}, **{("min", c): F.min(_num(c)) for c in names},
        **{("max", c): F.max(_num(c)) for c in names}, **{("jac", c): jac[c] for c in names},
    })
    if method == "box-cox":
        bad = [c for c in names if s["min", c] is not None and s["min", c] <= 0]
        if bad:
            raise ValueError(f"box-cox needs positive values, not so in {bad}; use yeo-johnson")
    live = [c for c in names if s["n", c] and s["min", c] < s["max", c]]
    centre, half = {c: 1.0 for c in live}, {c: 3.0 for c in live}
    for _ in range(rounds):
        grids = {c: [centre[c] + half[c] * (2 * i / (points - 1) - 1) for i in range(points)] for c in live}
        spread: dict = {}
        cells = [(c, i) for c in live for i in range(points)]
        for at in range(0, len(cells), EXPRESSIONS_PER_JOB):
            spread.update(aggregate_once(df, {(c, i): F.var_pop(_power(_num(c), grids[c][i], method)) for c, i in cells[at:at + EXPRESSIONS_PER_JOB]}))
        for c in live:
            fits = []
            for i, lam in enumerate(grids[c]):
                v = spread[c, i]
                good = v is not None and math.isfinite(v) and v > 0
                fits.append(-0.5 * s["n", c] * math.log(v) + (lam - 1) * s["jac", c] if good else -math.inf)
            best = max(range(points), key=lambda i: fits[i])
            centre[c] = grids[c][best]
            if 0 < best < points - 1:
                half[c] *= 2 / (points - 1)
    lam = {c: round(centre[c], 9) for c in live}
    moments, flat = {}, {}
    if standardize:
        powers = {c: _power(_num(c), lam[c], method) for c in live}
        m = aggregate_once(df, {**{("m", c): F.avg(e) for c, e in powers.items()}, **{("s", c): F.stddev_pop(e) for c, e in powers.items()}})
        moments = {c: [m["m", c], m["s", c] or 1.0] for c in live}
        flat = {c: s["min", c] for c in names if c not in live and s["n", c]}
    return _build_power({"lambda": lam}, exponents=lam, method=method, moments=moments, flat=flat)


@builder
def _build_power(exponents, method, moments, flat):
    out = {c: _power(_num(c), x, method) for c, x in exponents.items()}
    out.update({c: (out[c] - F.lit(m)) / F.lit(d) for c, (m, d) in moments.items()})
    out.update({c: _num(c) - F.lit(low) for c, low in flat.items()})
    return Transform(out)


# edges of the named binning rules (fixed values)
BIN_EDGES = {"3class": [-5.0, 5.0], "2class": [0.0]}


def numerical_binner(df: DataFrame, columns=None, strategy: str = "3class", thresholds: Sequence[float] | None = None,
                     target: str | None = None) -> Transform:
    """Whole-number class 0..n of right-closed intervals; ``4class`` cuts at the pooled quartiles of the
    columns, or at those of ``target``."""
    if target is not None and columns is None:
        raise ValueError("name the columns to bin when the edges come from the target")
    names = choose_numeric(df, columns, exclude=[] if target is None else [target])
    if strategy == "4class":
        from tabspark.columns import long_form

        source = df.select(_num(target).alias("value")) if target else long_form(df, names).select("value")
        edges = column_quantiles(source, ["value"], [0.25, 0.5, 0.75])["value"]
    elif strategy == "custom":
        if not thresholds:
            raise ValueError("strategy custom needs thresholds")
        edges = list(thresholds)
    elif strategy in BIN_EDGES:
        edges = list(thresholds) if thresholds and strategy == "3class" else BIN_EDGES[strategy]
    else:
        raise ValueError(f"unknown binning strategy {strategy!r}")
    if any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError(f"bin edges must grow, got {edges}")
    return _build_bins({"edges": edges}, columns=names, edges=[float(e) for e in edges])


@builder
def _build_bins(columns, edges):
    def code(c):
        return F.when(col(c).isNotNull(), sum(((_num(c) > F.lit(e)).cast("int") for e in edges), F.lit(0)))
    return Transform({c: code(c) for c in columns})


def pca_reducer(df: DataFrame, columns=None, n_components: int | None = None, variance_threshold: float = 0.95,
                prefix: str = "pca") -> Transform:
    """Centred principal components as ``pca0..``; the p x p covariance is the only thing on the driver."""
    names = choose_numeric(df, columns)
    # rows travel as one array and incomplete ones are left out in the batch: a filter over many
    # derived columns makes planning very slow
    rows = df.select(F.array(*[_num(c) for c in names]).alias("__x"))
    n, total = _batch_sums(rows, len(names), lambda x: x.sum(0))
    shift = total / max(n, 1)
    n, product = _batch_sums(rows, len(names) ** 2, lambda x: (x - shift).T @ (x - shift))
    product = product.reshape(len(names), len(names))
    if n < 2:
        raise ValueError("principal components need at least two complete rows")
    values, vectors = np.linalg.eigh(product / (n - 1))
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    # a component's sign is free: its largest loading is made positive
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(names))])
    ratio = values / values.sum() if values.sum() > 0 else np.ones_like(values) / len(values)
    k = n_components or int(np.searchsorted(np.cumsum(ratio), min(variance_threshold, 1.0) - 1e-12) + 1)
    k = min(k, len(names))
    params = {"variance": values[:k].tolist(), "ratio": ratio[:k].tolist(), "components": vectors[:, :k].T.tolist(), "mean": shift.tolist()}
    return _build_components(params, columns=names, mean=params["mean"], components=params["components"], prefix=prefix)


@builder
def _build_components(columns, mean, components, prefix):
    shifted = F.array(*[_num(c) - m for c, m in zip(columns, mean)])
    whole = F.lit(True)
    for c in columns:
        whole = whole & col(c).isNotNull()

    def score(loadings):
        # one literal array per component: a sum of p products would make the plan p x k terms long
        terms = F.zip_with(shifted, F.array(*[F.lit(v) for v in loadings]), lambda x, w: x * w)
        return F.when(whole, F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x))
    return Transform({f"{prefix}{j}": score(x) for j, x in enumerate(components)}, drop=list(columns))


def _batch_sums(rows: DataFrame, width: int, reduce: Callable[[np.ndarray], np.ndarray]) -> tuple[int, np.ndarray]:
    """Number of complete rows ``__x`` and the sum of ``reduce`` over Arrow batches; one row per task."""

    def sums(batches):
        total, n = np.zeros(width), 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["__x"].to_numpy()).astype(float)
                x = x[~np.isnan(x).any(axis=1)]
                total, n = total + reduce(x).ravel(), n + len(x)
        yield pd.DataFrame({"n": [n], "s": [total]})

    parts = rows.mapInPandas(sums, "n bigint, s array<double>")
    cells = parts.select("n", F.posexplode("s").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()  # width numbers
    total = np.zeros(width)
    if cells.empty:
        return 0, total
    total[cells["at"].to_numpy()] = cells["v"].to_numpy()
    return int(cells["n"].iloc[0]), total


# default names of interaction columns (fixed values)
INTERACTION_NAMES = {
    "multiply": "{feature1}_x_{feature2}",
    "divide": "{feature1}_div_{feature2}",
    "add": "{feature1}_plus_{feature2}",
    "subtract": "{feature1}_minus_{feature2}",
}
NEAR_ZERO = 1e-10  # divisors below it are clipped (fixed value)


def interaction_creator(df: DataFrame, interactions: Sequence[Sequence[str]], interaction_type: str = "multiply",
                        template: str | None = None, handle_missing: str = "skip", handle_zero_division: str = "inf") -> Transform:
    if interaction_type not in INTERACTION_NAMES:
        raise ValueError(f"interaction_type must be one of {sorted(INTERACTION_NAMES)}, got {interaction_type!r}")
    if handle_missing not in ("skip", "fill") or handle_zero_division not in ("inf", "nan", "clip"):
        raise ValueError("handle_missing is skip or fill, handle_zero_division is inf, nan or clip")
    pairs = []
    for i, pair in enumerate(interactions):
        if len(pair) != 2:
            raise ValueError(f"interaction {i} must name exactly two features, got {list(pair)}")
        a, b = require(df, pair, "interaction features") if pair[0] != pair[1] else (require(df, pair)[0],) * 2
        pairs.append([(template or INTERACTION_NAMES[interaction_type]).format(feature1=a, feature2=b), a, b])
    return _build_interactions({}, pairs=pairs, kind=interaction_type, fill=handle_missing == "fill", zero=handle_zero_division)


@builder
def _build_interactions(pairs, kind, fill, zero):
    out = {}
    for name, a, b in pairs:
        x, y = _num(a), _num(b)
        if fill:
            x, y = F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))
        out[name] = _combine(x, y, kind, zero)
    return Transform(out)


def _combine(x: Column, y: Column, kind: str, zero: str) -> Column:
    if kind == "multiply":
        return x * y
    if kind == "add":
        return x + y
    if kind == "subtract":
        return x - y
    if zero == "clip":
        return F.when(F.abs(y) > NEAR_ZERO, x / y).when(y.isNotNull(), F.signum(x) * F.lit(np.finfo(np.float64).max))
    infinite = F.when(x > 0, F.lit(float("inf"))).when(x < 0, F.lit(float("-inf"))) if zero == "inf" else F.lit(None).cast("double")
    return F.when(y == 0, infinite).otherwise(x / y)


def _levels(df: DataFrame, column: str, limit: int) -> list[str]:
    found = df.select(col(column).cast("string").alias("v")).filter("v IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} categories, too many for one column each; use hash or target encoding")
    return sorted(r["v"] for r in found)


def onehot_encoder(df: DataFrame, columns=None, drop_first: bool = False, handle_unknown: str = "ignore") -> Transform:
    """``col_category`` 0/1 columns in category order; null has no column; unknown gives zeros or an error."""
    if handle_unknown not in ("ignore", "error"):
        raise ValueError(f"handle_unknown is ignore or error, got {handle_unknown!r}")
    names = choose_category(df, columns)
    levels = {c: _levels(df, c, MAX_ONEHOT) for c in names}
    return _build_onehot({"levels": levels}, levels=levels, drop_first=drop_first, strict=handle_unknown == "error")


@builder
def _build_onehot(levels, drop_first, strict):
    out = {}
    for c, known in levels.items():
        value = col(c).cast("string")
        if strict:
            problem = F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), value)).cast("string")
            value = F.when(value.isNull() | value.isin(known), value).otherwise(problem)
        for v in known[1 if drop_first else 0:]:
            out[f"{c}_{v}"] = F.coalesce((value == v).cast("int"), F.lit(0))
    return Transform(out, drop=list(levels))


def ordinal_encoder(df: DataFrame, columns=None, handle_unknown: str = "value", unknown_value: int = -1) -> Transform:
    """Sorted categories as 0..n; unknown and missing as ``unknown_value`` (or an error if unknown)."""
    if handle_unknown not in ("value", "error"):
        raise ValueError(f"handle_unknown is value or error, got {handle_unknown!r}")
    names = choose_category(df, columns)
    tables = []
    for c in names:
        counts = df.select(col(c).cast("string").alias("__value")).filter("__value IS NOT NULL").groupBy("__value").agg(F.count(F.lit(1)).alias("__rows"))
        counts = materialize(counts)
        tables.append(materialize(with_global_rank(counts, ["__value"], order_by="__value", out="__code")))
    return _build_codes({}, tables, columns=names, strict=handle_unknown == "error", unknown_value=unknown_value)


@builder
def _build_codes(tables, columns, strict, unknown_value):
    joins = []
    for table, c in zip(tables, columns):
        default: Column = F.lit(unknown_value).cast("long")
        if strict:
            default = F.when(col(c).isNull(), default).otherwise(F.raise_error(F.lit(f"unknown category in {c}")).cast("long"))
        joins.append((table, c, c, default))
    return Transform(joins=joins)


def label_encoder(df: DataFrame, columns=None) -> Transform:
    return ordinal_encoder(df, columns)


def hash_encoder(df: DataFrame, columns=None, n_buckets: int = 8, prefix: str = "hash") -> Transform:
    """``hash0..`` counts of the row's "col=value" texts per bucket; nothing is fitted, so streams work too."""
    if n_buckets <= 0:
        raise ValueError(f"n_buckets must be positive, got {n_buckets}")
    names = choose_category(df, columns)
    return _build_buckets({}, columns=names, n_buckets=n_buckets, prefix=prefix)


@builder
def _build_buckets(columns, n_buckets, prefix):
    buckets = [F.pmod(F.xxhash64(F.concat(F.lit(f"{c}="), F.coalesce(col(c).cast("string"), F.lit("None")))), F.lit(n_buckets)) for c in columns]
    return Transform({f"{prefix}{i}": sum(((b == i).cast("int") for b in buckets), F.lit(0)) for i in range(n_buckets)}, drop=list(columns))


class TargetEncoding(Transform):
    """Smoothed category means; training rows get the value fitted without their own inner fold."""

    def __init__(self, table: DataFrame, columns: list[str], labels: list[str], prior: list[float], key: list[str], seed: int, text: dict):
        super().__init__(params={"prior": prior})
        self.table, self.columns, self.labels, self.prior, self.key, self.seed, self.text = table, columns, labels, prior, key, seed, text

    def _encode(self, df: DataFrame, inner: Column) -> DataFrame:
        for i, c in enumerate(self.columns):
            mapping = self.table.filter(F.col("name") == c).select(
                F.col("category").alias("__c"), F.col("inner").alias("__i"), "rows",
                *[F.col(f"e{j}").alias(f"__e{j}") for j in range(len(self.labels))])
            placed = df.withColumn("__c", _category_text(c)).withColumn("__i", inner)
            joined = lookup(placed, mapping, ["__c", "__i"], "rows").drop("__c", "__i")
            names = {j: c if len(self.labels) == 1 else f"{c}_{label}" for j, label in enumerate(self.labels)}
            values = {names[j]: F.coalesce(F.col(f"__e{j}"), F.lit(self.prior[j])).alias(names[j]) for j in names}
            kept = [x for x in df.columns if x != c or x in values]
            df = joined.select(*[values.get(x, col(x)) for x in kept], *[v for n, v in values.items() if n not in kept])
        return df

    def apply(self, df: DataFrame) -> DataFrame:
        return self._encode(df, F.lit(-1))

    def fit_apply(self, df: DataFrame) -> DataFrame:
        return self._encode(df, _inner_fold(self.key, self.seed))


def _inner_fold(key: list[str], seed: int) -> Column:
    return F.pmod(F.xxhash64(*[col(k) for k in key], F.lit(seed)), F.lit(INNER_FOLDS)).cast("int")


def _category_text(c: str) -> Column:
    # a missing value is a category of its own, apart from every text
    return F.coalesce(F.concat(F.lit("="), col(c).cast("string")), F.lit("missing"))


def target_encoder(df: DataFrame, target: str, key, columns=None, smooth: float | str = "auto", seed: int = 42) -> TargetEncoding:
    """One aggregation of (category, inner fold) gives the full encoding and all cross-fitted ones, since
    "all but fold f" is the total minus fold f.  Text targets: one 0/1 mean per class (one for two classes)."""
    require(df, [target], "target columns")
    key = require(df, as_list(key), "key columns")
    names = choose_category(df, columns, exclude=[target, *key])
    if smooth != "auto" and not isinstance(smooth, (int, float)):
        raise ValueError(f"smooth is a number or 'auto', got {smooth!r}")
    known = df.filter(col(target).isNotNull())
    if target in numeric_columns(df):
        labels, values = [target], [_num(target)]
    else:
        classes = _levels(df, target, MAX_ONEHOT)
        labels = classes[1:] if len(classes) == 2 else classes
        values = [(col(target).cast("string") == v).cast("double") for v in labels]
    centre = aggregate_once(known, {i: F.avg(v) for i, v in enumerate(values)})
    cells = known.select(
        _inner_fold(key, seed).alias("inner"), *[(v - F.lit(centre[i])).alias(f"y{i}") for i, v in enumerate(values)],
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), _category_text(c).alias("category")) for c in names])))
    width = range(len(values))
    sums = cells.groupBy("name", "category", "inner").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"y{i}").alias(f"s{i}") for i in width], *[F.sum(F.col(f"y{i}") * F.col(f"y{i}")).alias(f"q{i}") for i in width])
    sums = materialize(sums)
    measures = ["n", *[f"s{i}" for i in width], *[f"q{i}" for i in width]]
    whole = {r["inner"]: r for r in sums.filter(F.col("name") == names[0]).groupBy("inner").agg(*[F.sum(m).alias(m) for m in measures]).collect()}  # INNER_FOLDS rows
    total = {m: sum(r[m] for r in whole.values()) for m in measures}
    scope = {-1: total, **{f: {m: total[m] - whole[f][m] for m in measures} for f in whole}}
    overall = df.sparkSession.createDataFrame(
        [(f, *[float(t[f"s{i}"] / t["n"]) if t["n"] else 0.0 for i in width],
          *[float(max(t[f"q{i}"] / t["n"] - (t[f"s{i}"] / t["n"]) ** 2, 0.0)) if t["n"] else 0.0 for i in width]) for f, t in scope.items()],
        "inner int, " + ", ".join([f"m{i} double" for i in width] + [f"v{i} double" for i in width]))
    per_category = sums.groupBy("name", "category").agg(*[F.sum(m).alias(m) for m in measures], F.collect_list(F.struct("inner", *measures)).alias("parts"))
    # a category has at most INNER_FOLDS parts; folds it does not occur in use the full sums
    folds = F.transform(F.col("parts"), lambda p: F.struct(p["inner"].alias("inner"), *[(F.col(m) - p[m]).alias(m) for m in measures]))
    everything = F.array(F.struct(F.lit(-1).alias("inner"), *[F.col(m).alias(m) for m in measures]))
    rows = per_category.select("name", "category", F.col("n").alias("rows"), F.inline(F.concat(everything, folds)))
    rows = rows.join(F.broadcast(overall), "inner")  # INNER_FOLDS + 1 rows
    def encoding(i):
        n, mean = F.col("n"), F.col(f"s{i}") / F.nullif(F.col("n"), F.lit(0))
        if smooth == "auto":
            inside = F.greatest(F.col(f"q{i}") / F.nullif(n, F.lit(0)) - mean * mean, F.lit(0.0))
            weight = F.col(f"v{i}") * n / F.nullif(F.col(f"v{i}") * n + inside, F.lit(0.0))
            value = F.coalesce(weight * mean + (1 - weight) * F.col(f"m{i}"), F.col(f"m{i}"))
        else:
            value = F.coalesce((F.col(f"s{i}") + float(smooth) * F.col(f"m{i}")) / F.nullif(n + float(smooth), F.lit(0.0)), F.col(f"m{i}"))
        return (value + F.lit(centre[i])).alias(f"e{i}")
    table = materialize(rows.select("name", "category", "inner", "rows", *[encoding(i) for i in width]))
    return TargetEncoding(table, names, labels, [float(centre[i]) for i in width], key, seed, {})


TRANSFORMS: Mapping[str, Callable[..., Transform]] = {
    "standard_scaler": standard_scaler, "minmax_scaler": minmax_scaler, "robust_scaler": robust_scaler,
    "log_transformer": log_transformer, "power_transformer": power_transformer, "numerical_binner": numerical_binner,
    "pca_reducer": pca_reducer, "interaction_creator": interaction_creator, "onehot_encoder": onehot_encoder,
    "ordinal_encoder": ordinal_encoder, "label_encoder": label_encoder, "target_encoder": target_encoder, "hash_encoder": hash_encoder,
}
