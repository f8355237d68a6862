"""Column profiles: one aggregate over all columns, a second for what needs the first."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranks

#: Hints in column names, patterns of values with the share that must match, and flags by name.
NAME_HINTS = {
    "integer_id": ("id", "key", "ref", "code", "num"),
    "currency": ("price", "cost", "revenue", "amount", "salary", "fee", "charge", "payment"),
    "email": ("email", "mail"),
    "phone": ("phone", "mobile", "tel", "contact"),
    "url": ("url", "link", "href", "website"),
    "datetime": ("date", "time", "at", "on", "created", "updated", "modified", "timestamp"),
    "identifier": ("id", "uuid", "guid", "key", "code", "ref", "sku", "hash"),
}
PATTERNS = {
    "email": (r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", 0.8),
    "phone": (r"^[\+\d\-\(\)\s]{7,15}$", 0.7),
    "url": (r"^https?://", 0.5),
    "identifier": (r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", 0.5),
    "likely_email": (r"@.*\.", 0.7),
}
FLAG_HINTS = {
    "likely_pii": (
        "name", "email", "phone", "mobile", "address", "ssn", "passport", "dob", "birthdate", "birth_date", "gender", "sex", "age", "salary", "income", "credit", "bank", "account",
        "ip_address", "ip",
    ),
    "likely_id": ("_id", "id_", "_key", "uuid", "guid"),
    "likely_date": ("date", "time", "at", "_on", "created", "updated", "timestamp"),
}
BOOLEAN_WORDS = ("true", "false", "yes", "no", "1", "0", "t", "f", "y", "n")
DATE_FORMS = ("yyyy-MM-dd", "MM/dd/yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMM yyyy")


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _text(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _long(df: DataFrame, names: list[str], made: dict) -> DataFrame:
    """The one row of aggregates named {measure}__{k} as a row per column."""
    rows = [F.struct(F.lit(name).alias("column"), *[F.col(f"{m}__{k}").cast(t).alias(m) for m, t in made.items()]) for k, name in enumerate(names)]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """column, total, null_count, null_pct, unique_count of every column: exact, from one pass, or (approximate) from sketches. Not-a-number counts as null."""
    if approximate:
        return sketch_counts(sketches(df))
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "k int, column string")  # a row per column
    found = names.join(ranks.distinct_counts(df, df.columns), "k", "left")
    return _shares(found.select("column", *[F.coalesce(F.col(a), F.lit(0)).alias(b) for a, b in (("total", "total"), ("nulls", "null_count"), ("uniques", "unique_count"))]))


def _shares(found: DataFrame) -> DataFrame:
    return found.select("column", "total", "null_count", F.round(100.0 * F.col("null_count") / F.greatest(F.lit(1), "total"), 2).alias("null_pct"), "unique_count")


def sketches(df: DataFrame, log_size: int = 14) -> DataFrame:
    """column, total, null_count, sketch (HyperLogLog, 2^log_size registers: a standard error of about 1.04 / sqrt(2^log_size)) of every column, in one pass.

    Sketches of parts of a table (days, snapshots) can be stored and merged later; a part is read once.
    """
    names = df.columns
    one = df.agg(F.count(F.lit(1)).alias("total"), *[x for k, n in enumerate(names) for x in (F.count(ranks.values_of(df, n)).alias(f"n__{k}"), F.hll_sketch_agg(ranks.as_text(df, n), log_size).alias(f"sketch__{k}"))])
    rows = [F.struct(F.lit(n).alias("column"), "total", (F.col("total") - F.col(f"n__{k}")).alias("null_count"), F.col(f"sketch__{k}").alias("sketch")) for k, n in enumerate(names)]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def merged_sketches(parts: DataFrame) -> DataFrame:
    """The sketches of the whole from those of its parts (a row for each part and column); of one log_size."""
    return parts.groupBy("column").agg(F.sum("total").alias("total"), F.sum("null_count").alias("null_count"), F.hll_union_agg("sketch").alias("sketch"))


def sketch_counts(sketched: DataFrame) -> DataFrame:
    """counts' columns from sketches; unique_count is an estimate."""
    return _shares(sketched.select("column", "total", "null_count", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("unique_count")))


def numeric_stats(df: DataFrame, approximate: bool = False) -> DataFrame:
    """min, max, mean, median, std, p25, p75 (rounded to 6), is_integer of the numeric columns, and outliers beyond 1.5 quartile ranges (a second pass).

    Quartiles are exact (ranks.quantiles), or approximate from one aggregate; not-a-number is no value.
    """
    names, spark = _numeric(df), df.sparkSession
    quarters = (0.25, 0.5, 0.75)
    values = {n: ranks.number(df, n) for n in names}
    aggs = []
    for k, n in enumerate(names):
        c = values[n]
        aggs += [x.alias(f"{m}__{k}") for m, x in (("min", F.min(c)), ("max", F.max(c)), ("mean", F.avg(c)), ("std", F.stddev_samp(c)), ("is_integer", F.bool_and(c == F.floor(c))))]
        aggs += [F.percentile_approx(c, list(quarters), 10_000).alias(f"q__{k}")] if approximate else []
    one = df.agg(*aggs).first().asDict() if names else {}  # one row
    at = {(n, p): (one[f"q__{k}"] or [None] * 3)[i] for k, n in enumerate(names) for i, p in enumerate(quarters)} if approximate else ranks.quantiles(df, dict.fromkeys(names, quarters))
    fence = {n: (2.5 * at[n, 0.25] - 1.5 * at[n, 0.75], 2.5 * at[n, 0.75] - 1.5 * at[n, 0.25]) for n in names if at[n, 0.5] is not None}
    out = df.agg(*[F.count_if((values[n] < fence[n][0]) | (values[n] > fence[n][1])).alias(n) for n in fence]).first().asDict() if fence else {}
    rows = [(n, *(one[f"{m}__{k}"] for m in ("min", "max", "mean")), at[n, 0.5], one[f"std__{k}"], at[n, 0.25], at[n, 0.75], one[f"is_integer__{k}"], out.get(n, 0)) for k, n in enumerate(names)]
    made = ("min", "max", "mean", "median", "std", "p25", "p75")
    stats = spark.createDataFrame(rows, "column string, " + ", ".join(f"{m} double" for m in made) + ", is_integer boolean, outlier_count long")  # a row per column
    return stats.select("column", *[F.round(m, 6).alias(m) for m in made], "is_integer", "outlier_count")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """bin, bin_start, bin_end, count: equal widths between least and largest value, the last bin closed."""
    c = F.col(f"`{column}`").cast("double")
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    ends = ends.select(F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    ends = ends.withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    at = F.least(F.floor((c - F.col("lo")) / F.col("w")), F.lit(bins - 1)).cast("int")
    found = df.where(c.isNotNull()).join(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("count"))  # ends: one row
    every = ends.where("lo is not null").select("lo", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(found, "bin", "left").select("bin", F.round(F.col("lo") + F.col("bin") * F.col("w"), 6).alias("bin_start"), F.round(F.col("lo") + (F.col("bin") + 1) * F.col("w"), 6).alias("bin_end"), F.coalesce("count", F.lit(0)).alias("count"))


def heavy_hitters(df: DataFrame, names: list[str], k: int, tracked: int = 10_000) -> tuple[list[tuple], list[str], dict[str, int]]:
    """Rows (column, value, count, rank) of the k most frequent values where a sketch can prove them, the columns where it can't, and each column's count of values.

    One aggregate makes a frequent-items sketch of each column; what it returns is counted exactly in a second pass. A value that it doesn't return occurs at
    most 2 * 3.5 * rows / map size times (its error bound on both sides). Where the k-th exact count is above that, no other value can be among the first or tie with them.
    """
    size = 1 << math.ceil(math.log2(tracked / 0.75))
    texts = {n: F.col(f"`{n}`").cast("string") for n in names}
    aggs = [x for i, n in enumerate(names) for x in (F.count(F.col(f"`{n}`")).alias(f"n__{i}"), F.call_function("approx_top_k", texts[n], F.lit(tracked), F.lit(tracked)).alias(f"top__{i}"))]
    one = df.agg(F.count(F.lit(1)).alias("total"), *aggs).first()
    error = 3.5 * one["total"] / size
    sought = []
    for i, n in enumerate(names):
        items = sorted(((r["count"], r["item"]) for r in one[f"top__{i}"] or [] if r["item"] is not None), reverse=True)
        if len(items) >= k:
            sought += [(n, value) for count, value in items if count >= items[k - 1][0] - error]
    counted: dict[str, list] = {}
    if sought:
        asked = sorted({n for n, _ in sought})
        long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), texts[n].alias("value")) for n in asked])).alias("r")).select("r.*")
        wanted = df.sparkSession.createDataFrame(sought, "column string, value string")  # at most tracked rows a column
        for r in long.join(F.broadcast(wanted), ["column", "value"]).groupBy("column", "value").agg(F.count("*").alias("count")).collect():
            counted.setdefault(r["column"], []).append((-r["count"], r["value"]))
    proved = {n: sorted(v)[:k] for n, v in counted.items() if -sorted(v)[k - 1][0] > 2 * error}
    rows = [(n, value, -count, rank) for n, found in proved.items() for rank, (count, value) in enumerate(found, 1)]
    return rows, [n for n in names if n not in proved], {n: one[f"n__{i}"] for i, n in enumerate(names)}


def top_values(df: DataFrame, k: int = 5, columns: list[str] | None = None) -> DataFrame:
    """column, value, count, pct, rank: the k most frequent values of the text columns (ties by value), exact.

    From sketches and a recount where these decide (heavy_hitters); only columns whose first values aren't set apart from the others are counted whole.
    """
    names = columns or _text(df)
    rows, rest, totals = heavy_hitters(df, names, k) if names else ([], [], {})
    found = df.sparkSession.createDataFrame(rows, "column string, value string, count long, rank int")
    if rest:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").cast("string").alias("value")) for n in rest])).alias("r")).select("r.*").where("value is not null")
        rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
        whole = long.groupBy("column", "value").agg(F.count("*").alias("count")).withColumn("rank", rank).where(F.col("rank") <= k)
        found = found.unionByName(whole)
    n = df.sparkSession.createDataFrame(list(totals.items()), "column string, n long")  # a row per column
    return found.join(F.broadcast(n), "column").select("column", "value", "count", F.round(100.0 * F.col("count") / F.col("n"), 2).alias("pct"), "rank")


def text_lengths(df: DataFrame) -> DataFrame:
    names = _text(df)
    one = df.agg(*[x for k, n in enumerate(names) for x in (F.avg(F.length(f"`{n}`")).alias(f"avg_length__{k}"), F.max(F.length(f"`{n}`")).alias(f"max_length__{k}"))])
    out = _long(one, names, {"avg_length": "double", "max_length": "long"})
    return out.select("column", F.round("avg_length", 6).alias("avg_length"), "max_length")


def completeness(df: DataFrame) -> DataFrame:
    """completeness_pct: the share of cells that hold a value."""
    nulls = reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in df.columns])
    return df.agg(F.round(100.0 * (1 - F.sum(nulls) / F.greatest(F.lit(1), F.count(F.lit(1)) * len(df.columns))), 4).alias("completeness_pct"))


def semantic_types(df: DataFrame) -> DataFrame:
    """column, semantic_type and flags, from name hints, distinct counts and the share of values that match each pattern.

    One aggregate over all rows and one of distinct counts, no sample. The type of a text column is the first of boolean, email, phone, url, datetime, identifier, categorical that
    fits, else text: each by its name hint or by its pattern (datetime: by hint, and all values must be readable as dates). Texts such as 2024-01-05 fit
    the pattern of phone numbers, which comes first. Flags of an empty table: none.
    """
    aggs = [F.count(F.lit(1)).alias("total")]
    for k, field in enumerate(df.schema.fields):
        c = F.col(f"`{field.name}`")
        aggs += [F.count(c).alias(f"n__{k}")]
        if isinstance(field.dataType, T.StringType):
            share = {m: c.rlike(p) for m, (p, _) in PATTERNS.items()} | {"boolean": F.lower(c).isin(*BOOLEAN_WORDS)}
            if _hinted(field.name, NAME_HINTS["datetime"]):
                share["datetime"] = F.coalesce(c.try_cast("timestamp"), *[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMS]).isNotNull() | c.isNull()
            aggs += [F.avg(x.cast("double")).alias(f"{m}__{k}") for m, x in share.items()]
    got = df.agg(*aggs).first().asDict() | {f"d__{k}": 0 for k in range(len(df.columns))} | {f"d__{r['k']}": r["uniques"] for r in ranks.distinct_counts(df, df.columns).collect()}
    rows = []
    for k, field in enumerate(df.schema.fields):
        of = {m.removesuffix(f"__{k}"): v for m, v in got.items() if m.endswith(f"__{k}")} | {"total": got["total"]}
        rows.append((field.name, _type_of(field, of), _flags_of(field, of)))
    return df.sparkSession.createDataFrame(rows, "column string, semantic_type string, flags array<string>")


def _hinted(name: str, hints: tuple) -> bool:
    return any(x in name.lower() for x in hints)


def _type_of(field: T.StructField, of: dict) -> str:
    name, kind, total = field.name, field.dataType, max(of["total"], 1)
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(kind, T.NumericType):
        if of["n"] and isinstance(kind, T.IntegralType) and of["d"] / total > 0.9 and _hinted(name, NAME_HINTS["integer_id"]):
            return "integer_id"
        return "currency" if of["n"] and _hinted(name, NAME_HINTS["currency"]) else "numeric"
    if not isinstance(kind, T.StringType) or not of["n"]:
        return "text"
    if of["boolean"] == 1.0:
        return "boolean"
    fits = {m: _hinted(name, NAME_HINTS[m]) or of[m] > PATTERNS[m][1] for m in ("email", "phone", "url", "identifier")}
    fits |= {"datetime": of.get("datetime") == 1.0, "categorical": of["d"] / total < 0.05}
    return next((m for m in ("email", "phone", "url", "datetime", "identifier", "categorical") if fits[m]), "text")


def _flags_of(field: T.StructField, of: dict) -> list[str]:
    if not of["total"]:
        return []
    unique, name = of["d"] / of["total"], field.name
    found = {flag: _hinted(name, hints) for flag, hints in FLAG_HINTS.items()}
    found |= {
        "likely_boolean": of["d"] <= 2, "likely_email": (of.get("likely_email") or 0.0) > PATTERNS["likely_email"][1], "likely_phone": (of.get("phone") or 0.0) > PATTERNS["phone"][1],
        "high_cardinality": unique > 0.9, "low_cardinality": unique < 0.01 and of["d"] > 1, "high_null_rate": 1 - of["n"] / of["total"] > 0.2, "constant": of["d"] == 1,
    }
    return [flag for flag, yes in found.items() if yes]


def pii_columns(types: DataFrame) -> list[str]:
    """The columns flagged likely_pii in semantic_types' result, a row per column of one table."""
    return [r["column"] for r in types.where(F.array_contains("flags", "likely_pii")).select("column").collect()]
