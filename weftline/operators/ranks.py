"""Exact order statistics, modes and distinct counts of whole tables, without a task that sees all distinct values."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut_at, discard

#: Longer texts are told apart by their SHA-256.
WHOLE = 64


def number(df: DataFrame, column: str) -> Column:
    """A numeric column as double; not-a-number is none."""
    return F.nanvl(F.col(f"`{column}`").cast("double"), F.lit(None))


def values_of(df: DataFrame, column: str) -> Column:
    """The column's values; not-a-number is none."""
    c = F.col(f"`{column}`")
    return F.nanvl(c, F.lit(None).cast(df.schema[column].dataType)) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c


def quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[tuple[str, float], float | None]:
    """Exact quantiles of numeric columns, interpolated between neighbours: {(column, p): value}, None for a column without values.

    Values are counted (map side first) and dealt in ranges; sums of the ranges say which ones hold the ranks sought, and only those are read again and
    numbered. To the driver come a row for each column and range, and two for each quantile.
    """
    spark, names = df.sparkSession, list(wanted)
    if not names:
        return {}
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), number(df, c).alias("v")) for k, c in enumerate(names)])).alias("x")).select("x.*").where("v IS NOT NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = each.groupBy("k", "v").agg(F.count("*").alias("n")).repartitionByRange(parts, "k", "v").withColumn("part", F.spark_partition_id())
    ranged, path = cut_at(counts, "ranges")
    total, starts = [0] * len(names), {}
    for k, part, n in sorted(tuple(r) for r in ranged.groupBy("k", "part").agg(F.sum("n")).collect()):
        starts[k, part] = total[k]
        total[k] += n
    place = {(c, p): p * (total[k] - 1) for k, c in enumerate(names) for p in wanted[c] if total[k]}
    ranks = {(names.index(c), r) for (c, _), at in place.items() for r in (math.floor(at), math.ceil(at))}
    # the last range that begins at or before a rank holds it
    at_range = {(k, r): max((start, part) for (of, part), start in starts.items() if of == k and start <= r)[1] for k, r in ranks}
    found: dict[tuple[int, int], float] = {}
    if at_range:
        rows = [(k, part, starts[k, part], sorted(r for (of, r), p in at_range.items() if (of, p) == (k, part))) for k, part in sorted({(k, p) for (k, _), p in at_range.items()})]
        sought = spark.createDataFrame(rows, "k int, part int, start long, ranks array<long>")  # at most two rows a quantile
        upto = F.sum("n").over(Window.partitionBy("k", "part").orderBy("v"))
        picked = ranged.where(F.col("part").isin(sorted({r[1] for r in rows}))).join(F.broadcast(sought), ["k", "part"]).withColumn("upto", F.col("start") + upto)
        hit = picked.withColumn("r", F.explode(F.filter("ranks", lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("n")))))
        found = {(r["k"], r["r"]): r["v"] for r in hit.select("k", "r", "v").collect()}
    discard(spark, path)
    made: dict[tuple[str, float], float | None] = {(c, p): None for c in names for p in wanted[c]}
    for (c, p), at in place.items():
        low, high = found[names.index(c), math.floor(at)], found[names.index(c), math.ceil(at)]
        made[c, p] = low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high
    return made


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the most frequent value of each column under its own name, the least of those that tie; null without values.

    Values are counted first; what is compared then is a row for each distinct value, in the tasks that counted it, and one row for each task after that.
    """
    one = None
    for c in columns:
        counted = df.select(values_of(df, c).alias("v")).where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
        top = counted.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias(c))
        one = top if one is None else one.join(F.broadcast(top))  # one row each
    return one


def as_text(df: DataFrame, column: str) -> Column:
    """A text that is equal for equal values of the column only: short ones as they are, long ones by their SHA-256. Null for null and not-a-number; -0.0 is 0.0."""
    c, kind = values_of(df, column), df.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0).cast(kind)).cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        text = F.when(c.isNotNull(), F.to_json(F.struct(c.alias("c"))))
    else:
        text = F.hex(c) if isinstance(kind, T.BinaryType) else c.cast("string")
    return F.when(F.length(text) > WHOLE, F.concat(F.lit("#"), F.sha2(text.cast("binary"), 256))).otherwise(F.concat(F.lit("="), text)) if isinstance(kind, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) else text


def distinct_counts(df: DataFrame, columns: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """k (place in columns), total, nulls, uniques, after the keys of group_by (as g0, g1, ...): exact, from one pass over the rows.

    Each row gives a (column, value) pair for each column; pairs are counted map side and dealt by value, then counted by column. No row is expanded to all columns
    once for each of them, and no column's values meet in one task. A table without rows gives none.
    """
    keys = [F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(group_by)]
    names = [f"g{i}" for i in range(len(keys))]
    pairs = df.select(*keys, F.posexplode(F.array(*[as_text(df, c) for c in columns])).alias("k", "v"))
    counted = pairs.groupBy(*names, "k", "v").agg(F.count("*").alias("n"))
    return counted.groupBy(*names, "k").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("v").alias("uniques"))
