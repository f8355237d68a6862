"""A catalog of data assets: upserts, classification, walks, search and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .stored import BucketedTable, NameIndex
from .walks import walk


def upsert_assets(assets: DataFrame, seen: DataFrame) -> DataFrame:
    """assets with seen merged in: per (asset_type, namespace, name) the newest metadata and last_seen_at, the first created_at and id.

    seen: the same columns as assets. Grouping is by aggregation with map-side combine.
    """
    both = assets.unionByName(seen)
    newest = F.struct("last_seen_at", "created_at", "id")
    return both.groupBy("asset_type", "namespace", "name").agg(
        F.min_by("id", F.struct("created_at", "id")).alias("id"), F.max_by("metadata", newest).alias("metadata"), F.max_by("owner_id", newest).alias("owner_id"), F.min("created_at").alias("created_at"), F.max("last_seen_at").alias("last_seen_at")
    )


def upsert_edges(edges: DataFrame, seen: DataFrame) -> DataFrame:
    """edges and seen, each (source_id, target_id, relation, pipeline_name, run_id) once."""
    return edges.unionByName(seen).dropDuplicates(["source_id", "target_id", "relation", "pipeline_name", "run_id"])


def classify_node(node: Column, given: Column | None = None) -> Column:
    """The asset type of a node: the given one, else by name: file, topic or column."""
    file = node.rlike(r"\.(csv|json|parquet|xlsx)$") | node.rlike("^(minio|s3)://")
    topic = node.startswith("redpanda://") | node.rlike(r"(-topic|\.topic)$")
    by_name = F.when(file, "file").when(topic, "topic").otherwise("column")
    return by_name if given is None else F.coalesce(F.nullif(given, F.lit("")), by_name)


def classify_edge(step_type: Column, given: Column | None = None) -> Column:
    by_step = F.when(step_type == "load", "reads_from").when(step_type == "save", "writes_to").when(step_type == "join", "joins").otherwise("transforms")
    return by_step if given is None else F.when(given.isin("reads_from", "writes_to", "transforms", "joins"), given).otherwise(by_step)


def reach(edges: DataFrame, start: DataFrame, max_depth: int = 10, upstream: bool = False) -> DataFrame:
    """Assets reached from start (asset_id) with their least depth, start at 0: (asset_id, depth). See walks.walk."""
    a, b = ("target_id", "source_id") if upstream else ("source_id", "target_id")
    graph = edges.select(F.col(a).alias("source"), F.col(b).alias("target"))
    return walk(graph, start.select(F.col("asset_id").alias("node")), max_depth).withColumnRenamed("node", "asset_id")


def blast_radius(edges: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    """asset_id, depth, pipeline_name, runs: a row for each downstream asset and pipeline on its incoming edges from reached assets, and the start at depth 0."""
    got = reach(edges, start, max_depth)
    into = edges.join(got.select(F.col("asset_id").alias("source_id")), "source_id", "left_semi").groupBy(F.col("target_id").alias("asset_id"), "pipeline_name").agg(F.count_distinct("run_id").alias("runs"))
    return got.join(into, "asset_id", "left").select("asset_id", "depth", "pipeline_name", F.coalesce("runs", F.lit(0)).alias("runs"))


def upstream(edges: DataFrame, start: DataFrame, max_depth: int = 10) -> DataFrame:
    return reach(edges, start, max_depth, upstream=True)


def trigrams(text: Column) -> Column:
    """Distinct three-letter windows of each word, with two spaces before and one after it."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, 3)))))


ASSET_KEY = ("asset_type", "namespace", "name")
EDGE_KEY = ("source_id", "target_id", "relation", "pipeline_name", "run_id")


def stored_assets(spark: SparkSession, path: str, buckets: int = 64) -> BucketedTable:
    """Assets at path, upserted bucket by bucket (upsert_assets' rules)."""
    return BucketedTable(spark, path, ASSET_KEY, upsert_assets, buckets)


def stored_edges(spark: SparkSession, path: str, buckets: int = 64) -> BucketedTable:
    return BucketedTable(spark, path, EDGE_KEY, upsert_edges, buckets)


def name_index(spark: SparkSession, path: str, slots: int = 256) -> NameIndex:
    """An index of asset names at path, for search."""
    return NameIndex(spark, path, ASSET_KEY, "name", slots)


def search(assets: DataFrame, query: str, asset_type: str | None = None, limit: int = 20, index: NameIndex | None = None) -> DataFrame:
    """Assets whose name holds the query (any case), most similar first by trigrams; none for fewer than 2 characters.

    With an index only the postings of the query's grams are read for the names; without, every name is.
    """
    query = query.strip()
    if len(query) < 2:
        return assets.select("*", F.lit(0.0).alias("similarity")).limit(0)
    if index:
        hits = index.holding(query)
        found = assets.join(hits, [assets[c].eqNullSafe(hits[c]) for c in ASSET_KEY], "left_semi")
    else:
        found = assets.where(F.contains(F.lower("name"), F.lit(query.lower())))
    found = found.where(F.col("asset_type") == asset_type) if asset_type else found
    mine, theirs = trigrams(F.col("name")), trigrams(F.lit(query))
    score = F.size(F.array_intersect(mine, theirs)) / F.greatest(F.lit(1), F.size(F.array_union(mine, theirs)))
    return found.withColumn("similarity", F.round(score, 4)).orderBy(F.desc("similarity"), "name").limit(limit)


def orphans(assets: DataFrame, now: str, days_inactive: int = 90, limit: int = 100) -> DataFrame:
    """Files and columns unseen for so many days before now, the oldest first."""
    old = F.col("last_seen_at") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days_inactive))
    return assets.where(F.col("asset_type").isin("file", "column") & old).orderBy("last_seen_at", "name").limit(limit)


def catalog_stats(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, n: assets of each type, and the number of edges."""
    return assets.groupBy(F.col("asset_type").alias("kind")).agg(F.count("*").alias("n")).union(edges.agg(F.count("*").alias("n")).select(F.lit("edges"), "n"))


def latest_runs(runs: DataFrame, q: str | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """The newest run of each pipeline name, by name search and status, newest first."""
    runs = runs.where(F.contains(F.lower("name"), F.lit(q.lower()))) if q else runs
    newest = runs.groupBy("name").agg(F.max_by(F.struct(*runs.columns), F.struct("created_at", "id")).alias("r")).select("r.*")
    newest = newest.where(F.col("status") == status) if status else newest
    return newest.orderBy(F.desc("created_at"), "id").limit(limit)
