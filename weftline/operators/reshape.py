"""Pivot, unpivot, deduplication and null filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arguments import StepError, need_columns, need_numeric
from ..sources.shared import cut
from . import ranks

#: Distinct pivot values looked up at most, where none are given.
PIVOT_VALUES = 1000


def pivot(df: DataFrame, index, columns: str, values: str, aggfunc: str = "sum", fill_value=0, pivot_values: Sequence | None = None, order_by: Sequence[str] = ()) -> DataFrame:
    """One row per index, one column per value of ``columns``; missing cells get fill_value. Rows with a null index are dropped."""
    index = [index] if isinstance(index, str) else list(index)
    need_columns(df, [*index, columns, values], "pivot")
    v = F.col(f"`{values}`")
    if aggfunc == "first":
        if not order_by:
            raise StepError("pivot: first needs order_by")
        made = F.min_by(v, F.when(v.isNotNull(), F.struct(*order_by)))
    else:
        known = {"sum": F.sum, "mean": F.avg, "count": F.count, "min": F.min, "max": F.max}
        if aggfunc not in known:
            raise StepError(f"pivot: unknown aggfunc {aggfunc!r}")
        made = known[aggfunc](v)
    df = df.dropna(subset=index)
    if pivot_values is None:
        found = df.where(F.col(f"`{columns}`").isNotNull()).select(columns).distinct().limit(PIVOT_VALUES + 1).collect()
        if len(found) > PIVOT_VALUES:
            raise StepError(f"pivot: {columns!r} has more than {PIVOT_VALUES} values; give pivot_values")
        pivot_values = sorted(r[0] for r in found)
    out = df.groupBy(*index).pivot(columns, list(pivot_values)).agg(made)
    return out if fill_value is None else out.na.fill(fill_value, [c for c in out.columns if c not in index])


def unpivot(df: DataFrame, id_vars: Sequence[str], value_vars: Sequence[str], var_name: str = "variable", value_name: str = "value") -> DataFrame:
    """A row per input row and value column, null values kept."""
    need_columns(df, [*id_vars, *value_vars], "unpivot")
    if both := set(id_vars) & set(value_vars):
        raise StepError(f"unpivot: {', '.join(sorted(both))} in id_vars and value_vars")
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def deduplicate(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first", order_by: Sequence[str] = ()) -> DataFrame:
    """Rows with distinct keys: the first or last of each by order_by, or with keep none only keys that occur once. Nulls are equal.

    first and last are aggregations with map-side combine, so a frequent key costs no more than others.
    """
    if keep not in ("first", "last", "none"):
        raise StepError(f"deduplicate: keep must be first, last or none, not {keep!r}")
    keys = list(subset or df.columns)
    need_columns(df, [*keys, *order_by], "deduplicate")
    if keep != "none" and set(keys) == set(df.columns):
        return df.distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    if keep == "none":
        made = df.groupBy(*[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keys)]).agg(F.count("*").alias("__n"), F.any_value(whole).alias("__row"))
        return made.where("__n = 1").select("__row.*")
    if not order_by:
        raise StepError("deduplicate: keep first or last by a subset needs order_by, as rows have no order")
    order = F.struct(*[F.col(f"`{c}`").alias(f"__o{k}") for k, c in enumerate(order_by)], whole.alias("__row"))
    made = df.groupBy(*[F.col(f"`{c}`").alias(f"__{k}") for k, c in enumerate(keys)]).agg((F.min if keep == "first" else F.max)(order).alias("__best"))
    return made.select("__best.__row.*")


def fill_nulls(df: DataFrame, columns: Sequence[str], strategy: str, constant_value=None, order_by: Sequence[str] = (), partition_by: Sequence[str] = ()) -> DataFrame:
    """Nulls of columns by constant, forward_fill, backward_fill, mean, median or mode. No columns: all that fit.

    forward_fill and backward_fill go by order_by, within the keys of partition_by if given (null keys are a key); rows that tie there are in no order.
    """
    strategy = {"ffill": "forward_fill", "bfill": "backward_fill"}.get(strategy, strategy)
    columns = list(columns) or [f.name for f in df.schema.fields if strategy not in ("mean", "median") or isinstance(f.dataType, T.NumericType)]
    need_columns(df, [*columns, *order_by, *partition_by], "fill_nulls")
    if strategy == "constant":
        if constant_value is None:
            raise StepError("fill_nulls: constant needs constant_value")
        fits = [c for c in columns if isinstance(df.schema[c].dataType, T.StringType if isinstance(constant_value, str) else T.NumericType)]
        return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(constant_value).cast(df.schema[c].dataType)) for c in fits})
    if strategy in ("mean", "median", "mode"):
        for c in columns:
            if strategy != "mode":
                need_numeric(df, c, f"fill_nulls {strategy}")
        if strategy == "median":
            middle = ranks.quantiles(df, {c: [0.5] for c in columns})
            return df.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(middle[c, 0.5]).cast("double")) for c in columns})
        one = ranks.modes(df, columns).toDF(*[f"__{k}" for k in range(len(columns))]) if strategy == "mode" else df.agg(*[F.avg(ranks.values_of(df, c)).alias(f"__{k}") for k, c in enumerate(columns)])  # one row
        filled = df.join(F.broadcast(one))
        out = {c: F.coalesce(F.col(f"`{c}`"), F.col(f"__{k}")) for k, c in enumerate(columns)}
        return filled.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
    if strategy not in ("forward_fill", "backward_fill"):
        raise StepError(f"fill_nulls: unknown strategy {strategy!r}")
    if not order_by:
        raise StepError(f"fill_nulls: {strategy} needs order_by, as rows have no order")
    forward = strategy == "forward_fill"
    # backward is forward in the reverse order: a frame that ends at the last row is summed anew for each row
    turned = (lambda c: F.col(f"`{c}`").asc_nulls_first()) if forward else (lambda c: F.col(f"`{c}`").desc_nulls_last())
    # ranges of key and order, each filled by itself, so that a frequent key is many tasks; what a key's earlier range ends with is carried on
    keys, parts = list(partition_by), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *[F.col(f"`{c}`") for c in [*keys, *order_by]]).withColumn("__part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("__part", *[F.col(f"`{c}`") for c in keys]).orderBy(*[turned(c) for c in order_by]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pick = F.max_by if forward else F.min_by
    key = lambda c: F.when(F.col(f"`{c}`").isNotNull(), F.struct(*order_by))
    names = [f"__g{k}" for k in range(len(keys))]
    ends = ranged.groupBy("__part", *[F.col(f"`{g}`").alias(n) for g, n in zip(keys, names)]).agg(*[pick(F.col(f"`{c}`"), key(c)).alias(f"__{k}") for k, c in enumerate(columns)])
    ends = ends.withColumn("__spread", F.count("*").over(Window.partitionBy(*names))).where("__spread > 1")  # keys on both sides of a bound: at most two rows a range
    over = Window.partitionBy(*names).orderBy(turned("__part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(F.col("__part").alias("__at"), *names, *[F.last(F.col(f"__{k}"), True).over(over).alias(f"__{k}") for k in range(len(columns))])
    same = [F.col("__part") == F.col("__at"), *[F.col(f"`{g}`").eqNullSafe(F.col(n)) for g, n in zip(keys, names)]]
    filled = ranged.withColumns({c: F.last(F.col(f"`{c}`"), True).over(w) for c in columns}).join(F.broadcast(carry), same, "left")
    out = {c: F.coalesce(F.col(f"`{c}`"), F.col(f"__{k}")) for k, c in enumerate(columns)}
    return filled.select(*[out.get(c, F.col(f"`{c}`")).alias(c) for c in df.columns])
