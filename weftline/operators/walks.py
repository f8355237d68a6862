"""Breadth-first walks over edges that grow with the data: visited nodes are appended hop by hop to one bucketed table."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import discard, new_path


def walk(graph: DataFrame, start: DataFrame, max_depth: int = 10, scope: Sequence[str] = ()) -> DataFrame:
    """Nodes reached from start with their least depth: (scope..., node, depth), start at 0.

    graph: scope columns, source, target; start: scope columns, node. An edge is followed within its scope only. A null node or scope leads nowhere.

    The edges are written once, in buckets by the node that they leave. Each hop is written once, as a partition of a table in the same buckets, and that
    table is all that has been visited: the hop joins its frontier to the edges bucket by bucket, deals the targets (the only shuffle), and leaves out those that
    their bucket holds. Its row count is taken while it is written, so a hop is two jobs. Cycles end, as no node is visited twice. Both tables lie in the
    shared folder; a lost executor costs a repeat of the hop at most.
    """
    spark = graph.sparkSession
    keys, parts = [*scope, "node"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(graph.dtypes)
    edges_path, path = new_path(spark, "edges"), new_path(spark, "visited")
    edges, visited = (f"walk_{k}_{uuid.uuid4().hex}" for k in ("edges", "visited"))

    def append(rows: DataFrame, first: bool = False) -> int:
        seen = Observation()
        rows = rows.select(*keys, "depth").observe(seen, F.count(F.lit(1)).alias("n"))
        if first:
            rows.write.option("path", path).partitionBy("depth").bucketBy(parts, *keys).saveAsTable(visited)
        else:
            rows.write.insertInto(visited)
        return seen.get["n"]

    try:
        leaving = graph.select(*scope, F.col("source").alias("node"), F.col("target").alias("next")).distinct()
        leaving.repartition(parts, *keys).write.option("path", edges_path).bucketBy(parts, *keys).saveAsTable(edges)
        begin = start.select(*[F.col(c).cast(kinds[c]) for c in scope], F.col("node").cast(kinds["source"]), F.lit(0).alias("depth"))
        left = append(begin.distinct(), first=True)
        depth = 0
        while left and depth < max_depth:
            depth += 1
            before = spark.table(visited)
            frontier = before.where(F.col("depth") == depth - 1).select(*keys, "depth")  # the depth is counted on in its column, so that each hop has the same code
            targets = frontier.hint("merge").join(spark.table(edges), keys).select(*scope, F.col("next").cast(kinds["source"]).alias("node"), (F.col("depth") + 1).alias("depth")).groupBy(*keys).agg(F.max("depth").alias("depth"))
            left = append(targets.join(before.select(*keys).hint("merge"), keys, "left_anti"))
    finally:
        for name in (edges, visited):  # the files stay
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    discard(spark, edges_path)
    kind = ", ".join([f"`{c}` {kinds[c]}" for c in scope] + [f"node {kinds['source']}", "depth int"])
    return spark.read.schema(kind).parquet(path).select(*keys, "depth")
