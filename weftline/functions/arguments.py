"""Checks of arguments against a schema, before any plan is built."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import types as T


class StepError(ValueError):
    """A step's arguments don't fit its input."""


def need_columns(df: DataFrame, names, what: str = "step") -> None:
    """Every name must be a column; the error names the closest one."""
    for name in names:
        if name not in df.columns:
            near = difflib.get_close_matches(str(name), df.columns, 1, 0.6)
            raise StepError(f"{what}: no column {name!r}" + (f"; did you mean {near[0]!r}?" if near else "") + f" (columns: {', '.join(df.columns)})")


def need_numeric(df: DataFrame, name: str, what: str) -> None:
    kind = df.schema[name].dataType
    if not isinstance(kind, T.NumericType):
        raise StepError(f"{what} needs a numeric column; {name!r} is {kind.simpleString()}")


def category(kind: T.DataType) -> str:
    """The type's category for contracts; types without one go by their own name."""
    for names, label in (
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"), ((T.FloatType, T.DoubleType), "float"), ((T.BooleanType,), "boolean"), ((T.StringType,), "string"),
        ((T.TimestampType, T.TimestampNTZType, T.DateType), "datetime"),
    ):
        if isinstance(kind, names):
            return label
    return kind.simpleString()
