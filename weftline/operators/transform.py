"""Projection, filters, joins, aggregation, sort and samples: one lazy DataFrame expression each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arguments import StepError, need_columns, need_numeric
from . import ranks


def select(df: DataFrame, columns: Sequence[str], mode: str = "include") -> DataFrame:
    """The named columns, or with mode drop/exclude all others."""
    need_columns(df, columns, "select")
    return df.drop(*columns) if mode in ("drop", "exclude") else df.select(*[F.col(f"`{c}`") for c in columns])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    need_columns(df, mapping, "rename")
    after = [mapping.get(c, c) for c in df.columns]
    if clash := {c for c in after if after.count(c) > 1}:
        raise StepError(f"rename: two columns would be called {', '.join(sorted(clash))}")
    return df.withColumnsRenamed(mapping)


def transform(df: DataFrame, expression: str) -> DataFrame:
    """All columns and those of ``expression AS name`` (several with commas)."""
    if not (expression or "").strip():
        raise StepError("transform: expression is empty")
    return df.selectExpr("*", *expression_list(expression))


def expression_list(expression: str) -> list[str]:
    """An expression list at its top-level commas, outside brackets and quotes."""
    out, depth, quote, start = [], 0, "", 0
    for k, ch in enumerate(expression):
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "'\"`":
            quote = ch
        else:
            depth += (ch in "([") - (ch in ")]")
            if ch == "," and not depth:
                out.append(expression[start:k])
                start = k + 1
    return [x.strip() for x in [*out, expression[start:]]]


def literal(df: DataFrame, column: str, value, what: str = "filter") -> Column:
    """value as a literal of the column's type, so that comparisons reach the scan; an error where it doesn't fit."""
    kind = df.schema[column].dataType
    try:
        if isinstance(kind, T.IntegralType):
            number = float(value)
            return F.lit(int(number)) if number == int(number) else F.lit(number)
        if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            return F.lit(float(value))
    except (TypeError, ValueError, OverflowError):
        raise StepError(f"{what}: {value!r} doesn't fit column {column!r} of type {kind.simpleString()}") from None
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.lit(str(value)).cast(kind)
    if isinstance(kind, T.BooleanType):
        if str(value).lower() not in ("true", "false"):
            raise StepError(f"{what}: {value!r} doesn't fit boolean column {column!r}")
        return F.lit(str(value).lower() == "true")
    return F.lit(str(value))


#: Other names of operators.
ALIASES = {"eq": "equals", "neq": "not_equals", "gt": "greater_than", "lt": "less_than"}
COMPARE = {
    "equals": lambda c, v: c == v, "not_equals": lambda c, v: c != v, "greater_than": lambda c, v: c > v,
    "less_than": lambda c, v: c < v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v,
}
TEXT = {
    "contains": lambda c, v: c.contains(v), "not_contains": lambda c, v: ~c.contains(v),
    "starts_with": lambda c, v: c.startswith(v), "ends_with": lambda c, v: c.endswith(v),
}


def filter(df: DataFrame, column: str, operator: str, value=None) -> DataFrame:  # noqa: A001
    """Rows for which the predicate is true; null never is, except with is_null. Text operators match literally."""
    need_columns(df, [column], "filter")
    operator = ALIASES.get(operator, operator)
    c = F.col(f"`{column}`")
    if operator == "is_null":
        return df.where(c.isNull())
    if operator == "is_not_null":
        return df.where(c.isNotNull())
    if value is None:
        raise StepError(f"filter: {operator} needs a value")
    if operator in COMPARE:
        return df.where(COMPARE[operator](c, literal(df, column, value)))
    if operator in TEXT:
        return df.where(TEXT[operator](c.cast("string"), str(value)))
    raise StepError(f"filter: unknown operator {operator!r}")


def join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", null_safe: bool = False) -> DataFrame:
    """Equi-join on one column that both sides have; other common columns get _left and _right. Null keys match only if null_safe."""
    if how not in ("inner", "left", "right", "outer"):
        raise StepError(f"join: how must be inner, left, right or outer, not {how!r}")
    need_columns(left, [on], "join, left side")
    need_columns(right, [on], "join, right side")
    both = [c for c in left.columns if c in right.columns and c != on]
    left = left.withColumnsRenamed({c: f"{c}_left" for c in both})
    right = right.withColumnsRenamed({c: f"{c}_right" for c in both})
    if not null_safe:
        return left.join(right, on, how)
    right = right.withColumnRenamed(on, "__key")
    rest = [c for c in right.columns if c != "__key"]
    key = F.coalesce(F.col(f"`{on}`"), F.col("__key")).alias(on)
    return left.join(right, F.col(f"`{on}`").eqNullSafe(F.col("__key")), how).select(key, *[F.col(f"`{c}`") for c in left.columns if c != on], *[F.col(f"`{c}`") for c in rest])


NUMERIC = ("sum", "mean", "avg", "median", "std", "var", "p50", "p95")


def aggregate_column(df: DataFrame, column: str, function: str, order_by: Sequence[str] = (), approximate: bool = False) -> Column:
    c = ranks.values_of(df, column)
    if function in NUMERIC:
        need_numeric(df, column, f"aggregate {function}")
    if function in ("first", "last"):
        if not order_by:
            raise StepError(f"aggregate: {function} needs order_by, as rows have no order")
        need_columns(df, order_by, "aggregate order_by")
        key = F.when(c.isNotNull(), F.struct(*[F.col(f"`{o}`") for o in order_by], c.alias("__value")))  # among equals the value decides
        return (F.min_by if function == "first" else F.max_by)(c, key)
    simple = {"sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "std": F.stddev_samp, "var": F.var_samp}
    if function in simple:
        return simple[function](c)
    if function in ("median", "p50", "p95"):
        at = 0.95 if function == "p95" else 0.5
        return F.percentile_approx(c, at, 10_000) if approximate else F.percentile(c, at)
    if function == "mode":
        return F.mode(c, True)
    if function == "count_distinct":
        return F.approx_count_distinct(c) if approximate else F.count_distinct(c)
    raise StepError(f"aggregate: unknown function {function!r}")


def aggregate(df: DataFrame, group_by: Sequence[str], aggregations, order_by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Aggregates per group, null keys kept; without group_by one row. Columns are {column}_{function} or the alias.

    aggregations: [{column, function, alias?}] or {column: function}. first/last take the non-null value first/last by order_by; of values that tie there, the least/greatest.
    """
    if isinstance(aggregations, dict):
        aggregations = [{"column": c, "function": f} for c, f in aggregations.items()]
    if not aggregations:
        raise StepError("aggregate: nothing to aggregate")
    need_columns(df, [*group_by, *[a["column"] for a in aggregations]], "aggregate")
    counted = list(dict.fromkeys(a["column"] for a in aggregations if a["function"] == "count_distinct"))
    apart = {} if approximate else _without_groups(df, aggregations, counted) if not group_by else {("count_distinct", c): F.col(f"__d{k}") for k, c in enumerate(counted)} if len(counted) > 1 else {}
    made = {a.get("alias") or f"{a['column']}_{a['function']}": a for a in aggregations}
    plain = [aggregate_column(df, a["column"], a["function"], order_by, approximate).alias(name) for name, a in made.items() if (a["function"], a["column"]) not in apart]
    if not group_by:
        rows = df.agg(*plain or [F.count(F.lit(1)).alias("__rows")])
        return rows.select(*[apart.get((a["function"], a["column"]), F.col(f"`{name}`")).alias(name) for name, a in made.items()])
    keys = [F.col(f"`{g}`") for g in group_by]
    rows = df.groupBy(*keys).agg(*plain or [F.count(F.lit(1)).alias("__rows")])
    if not apart:
        return rows
    held = [f"__g{i}" for i in range(len(group_by))]
    distinct = ranks.distinct_counts(df, counted, group_by).groupBy(*[F.col(f"g{i}").alias(h) for i, h in enumerate(held)]).agg(*[F.max(F.when(F.col("k") == k, F.col("uniques"))).alias(f"__d{k}") for k in range(len(counted))])
    same = [rows[f"`{g}`"].eqNullSafe(distinct[h]) for g, h in zip(group_by, held)]
    return rows.join(distinct, same, "left").select(*keys, *[apart.get((a["function"], a["column"]), F.col(f"`{name}`")).alias(name) for name, a in made.items()])


def _without_groups(df: DataFrame, aggregations: Sequence[dict], counted: Sequence[str]) -> dict:
    """Exact ranks, modes and several distinct counts of the whole table, as literals: their own jobs, in none of which a task sees all values."""
    at = {"median": 0.5, "p50": 0.5, "p95": 0.95}
    wanted: dict[str, list[float]] = {}
    for a in aggregations:
        if a["function"] in at:
            need_numeric(df, a["column"], f"aggregate {a['function']}")
            wanted.setdefault(a["column"], []).append(at[a["function"]])
    found = ranks.quantiles(df, wanted)
    made = {(f, c): F.lit(found[c, p]).cast("double") for f, p in at.items() for c in wanted if (c, p) in found}
    most = list(dict.fromkeys(a["column"] for a in aggregations if a["function"] == "mode"))
    if most:
        row = ranks.modes(df, most).first()
        made |= {("mode", c): F.lit(row[k]).cast(df.schema[c].dataType) for k, c in enumerate(most)}
    if len(counted) > 1:
        uniques = {r["k"]: r["uniques"] for r in ranks.distinct_counts(df, counted).collect()}  # a row for each column
        made |= {("count_distinct", c): F.lit(uniques.get(k, 0)).cast("long") for k, c in enumerate(counted)}
    return made


def sort(df: DataFrame, by, order: str = "asc", ascending=None) -> DataFrame:
    """Global sort; nulls last in either direction. by: a column or several; ascending: one flag or one for each."""
    names = [by] if isinstance(by, str) else list(by)
    if not names:
        return df
    need_columns(df, names, "sort")
    flags = [order != "desc"] * len(names) if ascending is None else [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    flags += [True] * (len(names) - len(flags))
    return df.orderBy(*[F.col(f"`{n}`").asc_nulls_last() if up else F.col(f"`{n}`").desc_nulls_last() for n, up in zip(names, flags)])


def top_k(df: DataFrame, by, k: int, ascending=False) -> DataFrame:
    return sort(df, by, ascending=ascending).limit(k)


def sample(df: DataFrame, n: int | None = None, fraction: float | None = None, stratify_by: str | None = None, random_state: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """n rows, or each with probability fraction; per stratum max(1, its share of the target), if stratify_by is given.

    n rows are those that come first by a seeded hash of the whole row, or of the columns ``by`` that identify it: the same under any partitioning. The hash of
    by is the MD5 of random_state and the columns' texts, joined by |, which other engines repeat; with by, a fraction takes the rows whose first eight digits are below it.
    Each task keeps no more rows of a stratum than it can give.
    """
    if (n is None) == (fraction is None):
        raise StepError("sample: give n or fraction, not both")
    need_columns(df, by, "sample")
    digits = F.md5(F.concat_ws("|", F.lit(str(random_state)), *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in by]).cast("binary"))
    whole = F.xxhash64(F.lit(random_state), *[F.col(f"`{c}`") for c in df.columns])
    key = digits if by else whole
    if stratify_by:
        need_columns(df, [stratify_by], "sample")
        s = F.col(f"`{stratify_by}`")
        counts = df.groupBy(s.alias("__s")).agg(F.count("*").alias("__n")).where("__s is not null")
        total = df.count()
        target = n if n is not None else int(total * min(max(fraction, 0.0), 1.0))
        if n is not None and n > total:
            return df
        quota = F.greatest(F.lit(1), F.floor(F.col("__n") * F.lit(target) / F.lit(max(total, 1))))
        rows = df.withColumn("__key", key).join(counts.withColumn("__quota", quota), s == F.col("__s"))
        # a stratum may hold most rows: first what a slice of it could give at most, then the quota
        slices = rows.withColumn("__slice", F.pmod(whole, F.lit(64)))
        most = max(1, target)  # no quota is above it; a bound that the plan knows lets each task drop the rest before the shuffle
        ties = [F.col(f"`{c}`") for c in df.columns]
        part = slices.withColumn("__rank", F.row_number().over(Window.partitionBy("__s", "__slice").orderBy("__key", *ties))).where(f"__rank <= {most}").where("__rank <= __quota")
        kept = part.withColumn("__rank", F.row_number().over(Window.partitionBy("__s").orderBy("__key", *ties))).where(f"__rank <= {most}").where("__rank <= __quota")
        return kept.select(*[F.col(f"`{c}`") for c in df.columns])
    if n is not None:
        return df.orderBy(key, *[F.col(f"`{c}`") for c in df.columns]).limit(n)
    if by:
        return df.where(F.conv(F.left(digits, F.lit(8)), 16, 10).cast("long") < int(min(max(fraction, 0.0), 1.0) * (1 << 32)))
    return df.sample(min(max(fraction, 0.0), 1.0), random_state)
