"""Walks against plain breadth-first search, and what a hop costs."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import catalog
from weftline.operators.walks import walk


def bfs(edges, starts, depth):
    seen, at = dict.fromkeys(starts, 0), set(starts)
    for d in range(1, depth + 1):
        at = {b for a, b in edges if a in at} - seen.keys()
        seen |= dict.fromkeys(at, d)
    return seen


@pytest.mark.parametrize("depth", [0, 1, 4, 30])
def test_walk(spark, depth):
    rng = random.Random(depth)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(110)] + [(5, 5), (5, 6), (6, 5), (None, 3), (3, None)]
    graph = spark.createDataFrame(edges, "source long, target long")
    got = walk(graph, spark.createDataFrame([(5,), (5,), (7,)], "node int"), depth)
    reached = {r.node: r.depth for r in got.collect()}
    assert {k: v for k, v in reached.items() if k is not None} == bfs([e for e in edges if None not in e], [5, 7], depth) and got.count() == len(reached)


def test_walk_in_scopes_and_nowhere(spark):
    graph = spark.createDataFrame([("a", "x", "y"), ("b", "x", "z"), ("b", "z", "w"), (None, "x", "q")], "run string, source string, target string")
    got = walk(graph, spark.createDataFrame([("b", "x"), ("c", "x")], "run string, node string"), 5, ["run"])
    assert sorted(map(tuple, got.collect())) == [("b", "w", 2), ("b", "x", 0), ("b", "z", 1), ("c", "x", 0)]
    none = walk(graph, spark.createDataFrame([], "run string, node string"), 5, ["run"])
    assert none.count() == 0 and none.columns == ["run", "node", "depth"]
    assert walk(graph.where("false"), spark.createDataFrame([("b", "x")], "run string, node string"), 5, ["run"]).count() == 1


def test_a_hop_is_two_jobs(spark):
    chain = spark.range(30).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    tracker, jobs = spark.sparkContext.statusTracker(), {}
    for depth in (3, 13):
        spark.sparkContext.setJobGroup(f"walk{depth}", "walk")
        assert walk(chain, spark.range(1).select(F.col("id").alias("node")), depth).count() == depth + 1
        jobs[depth] = len(tracker.getJobIdsForGroup(f"walk{depth}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[13] - jobs[3] <= 20, jobs  # ten hops
    assert not [x for x in spark.catalog.listTables() if x.name.startswith("walk_")]


def test_reach_upstream(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 3)], "source_id long, target_id long").withColumns({"relation": F.lit("r"), "pipeline_name": F.lit("p"), "run_id": F.lit(1)})
    start = spark.createDataFrame([(3,)], "asset_id long")
    assert {tuple(r) for r in catalog.upstream(edges, start).collect()} == {(3, 0), (2, 1), (4, 1), (1, 2)}
    assert {tuple(r) for r in catalog.blast_radius(edges, spark.createDataFrame([(1,)], "asset_id long")).collect()} == {(1, 0, None, 0), (2, 1, "p", 1), (3, 2, "p", 1)}
