"""Column families and the rules that turn a caller's choice into a column list."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 42


class ColumnChoiceError(ValueError):
    """A requested column is missing, of the wrong family, or nothing is left to work on."""


def col(name: str) -> Column:
    """Column reference that survives dots, spaces and parentheses in the name."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_list(value: str | Iterable[str] | None) -> list[str]:
    if value is None:
        return []
    if isinstance(value, str):
        return [value]
    return list(dict.fromkeys(value))


def _of_type(df: DataFrame, *kinds: type) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def numeric_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.NumericType)


def float_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.FloatType, T.DoubleType)


def datetime_columns(df: DataFrame) -> list[str]:
    return _of_type(df, T.DateType, T.TimestampType, T.TimestampNTZType)


def category_columns(df: DataFrame) -> list[str]:
    """Text and booleans; dates are neither numbers nor categories."""
    return _of_type(df, T.StringType, T.BooleanType)


def require(df: DataFrame, names: Iterable[str], what: str = "columns") -> list[str]:
    names = as_list(names)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ColumnChoiceError(f"unknown {what}: {missing}; available: {df.columns}")
    return names


def choose_targets(df: DataFrame, targets: str | Iterable[str]) -> list[str]:
    names = as_list(targets)
    if not names:
        raise ColumnChoiceError("at least one target column is needed")
    return require(df, names, "target columns")


def choose_numeric(df: DataFrame, names=None, exclude: Iterable[str] = ()) -> list[str]:
    return _choose(df, names, exclude, numeric_columns(df), "numeric")


def choose_category(df: DataFrame, names=None, exclude: Iterable[str] = ()) -> list[str]:
    return _choose(df, names, exclude, category_columns(df), "category")


def _choose(df, names, exclude, family: list[str], what: str) -> list[str]:
    exclude = set(exclude)
    if names is None:
        picked = [c for c in family if c not in exclude]
    else:
        picked = [c for c in require(df, names, f"{what} columns") if c not in exclude]
        wrong = [c for c in picked if c not in family]
        if wrong:
            raise ColumnChoiceError(f"not {what} columns: {wrong}")
    if not picked:
        raise ColumnChoiceError(f"no {what} columns to work on")
    return picked


def nan_to_null(df: DataFrame) -> DataFrame:
    """One meaning of missing: aggregates skip null, but NaN would poison them."""
    floats = set(float_columns(df))
    if not floats:
        return df
    return df.select(*[F.nanvl(col(c), F.lit(None)).alias(c) if c in floats else col(c) for c in df.columns])


def aggregate_once(df: DataFrame, exprs: dict) -> dict:
    """Run every expression in ONE global aggregate and return {key: value}.

    The result is a single row whatever the size of the input, so it is safe on the driver.
    """
    if not exprs:
        return {}
    keys = list(exprs)
    row = df.agg(*[exprs[k].alias(f"a{i}") for i, k in enumerate(keys)]).first()
    return {k: row[i] for i, k in enumerate(keys)}


def long_form(df: DataFrame, columns: list[str], name: str = "name", value: str = "value",
              keep: Iterable[str] = (), dtype: str = "double") -> DataFrame:
    """Unpivot ``columns`` to (keep..., name, value) rows of one type."""
    keep = list(keep)
    casted = df.select(*[col(k) for k in keep], *[col(c).cast(dtype).alias(f"__v{i}") for i, c in enumerate(columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"__v{i}").alias(value)) for i, c in enumerate(columns)])
    return casted.select(*[col(k) for k in keep], F.inline(pairs))
