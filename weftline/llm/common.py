"""Helpers shared by the corpus operators: reading, batch sizes, components of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, cut_at, discard

__all__ = ["DOCUMENT_COLUMNS", "components", "cut", "cut_at", "discard", "prepare", "private", "readable", "table", "whole_texts"]

#: Column order of ``documents``; pipeline stages return exactly these.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a Python worker's memory doesn't depend on the partition.

    Only settings that the session hasn't set itself are changed; they must still hold when the caller runs the lazy result.
    """
    for key, value, default in (("spark.sql.execution.arrow.maxRecordsPerBatch", "2000", "10000"), ("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20), str(64 << 20))):
        if spark.conf.get(key, default).removesuffix("B") in (default, "67108864", "64m"):
            spark.conf.set(key, value)


def readable(column: str) -> Column:
    """A text column whose invalid UTF-8 is replaced by U+FFFD: all bytes, lengths and hashes are of that text. Other types are read as text."""
    return F.make_valid_utf8(F.col(column).cast("string")).alias(column)


def whole_texts(docs: DataFrame) -> DataFrame:
    """docs with readable texts; all other columns as they are."""
    return docs.withColumn("text", readable("text"))


def private(columns: list[str], name: str) -> str:
    """name, made longer until no column (in any case) has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph: (id, component), component = smallest id reachable.

    edges: long columns a, b; nodes without an edge to another node don't appear. Alternates
    the large-star and small-star contractions until the edges repeat, however many rounds that takes. Each round is two
    aggregations with map-side combine and two equi-joins, which AQE may split where a hub is hot; rounds are written to
    the shared folder, and each replaces the one before it.
    """
    spark = edges.sparkSession
    now, path = cut_at(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.union(low.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, new_path = cut_at(small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        discard(spark, path)
        now, path = after, new_path
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark or not new[0]:
            break
        mark = new
    roots = now.select(F.col("b").alias("id")).distinct()
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id").union(roots.select("id", F.col("id").alias("component")))
