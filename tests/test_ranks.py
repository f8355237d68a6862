"""Exact quantiles, modes and distinct counts, and sketches, against numpy and plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import profile, ranks, reshape, transform

NAN = float("nan")


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    made = [(k % 7, rng.choice([None, NAN, 1.5, -0.0, 0.0, float(rng.randint(-50, 50))]), rng.randint(0, 9) ** 3, rng.choice(["a", "b" * 80, "b" * 80 + "c", None]), [k % 3, None]) for k in range(900)]
    return spark.createDataFrame(made, "g int, v double, n int, s string, a array<int>").repartition(6)


def test_quantiles(rows):
    wanted = {"v": [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0], "n": [0.5, 0.999]}
    got = ranks.quantiles(rows, wanted)
    for c, ps in wanted.items():
        values = [r[0] for r in rows.select(c).collect() if r[0] is not None and r[0] == r[0]]
        for p in ps:
            assert got[c, p] == pytest.approx(float(np.quantile(values, p)), abs=1e-12), (c, p)
    assert ranks.quantiles(rows.where("false"), {"v": [0.5]}) == {("v", 0.5): None} and ranks.quantiles(rows, {}) == {}
    one = rows.sparkSession.createDataFrame([(2.0,)] * 5 + [(NAN,)], "v double")
    assert ranks.quantiles(one, {"v": [0.0, 0.3, 1.0]}) == {("v", 0.0): 2.0, ("v", 0.3): 2.0, ("v", 1.0): 2.0}


def test_no_task_reads_all_distinct_values(spark):
    # 4 ranges of 2000 values: what is read to pick the ranks is the ranges that hold them
    many = spark.range(2000).select(F.col("id").cast("double").alias("v"))
    assert ranks.quantiles(many, {"v": [0.1, 0.5]}) == {("v", 0.1): 199.9, ("v", 0.5): 999.5}


def test_modes_and_fills(spark, rows):
    got = ranks.modes(rows, ["v", "n", "s"]).first()
    for c in ("v", "n", "s"):
        seen = Counter(r[0] for r in rows.select(c).collect() if r[0] is not None and r[0] == r[0])
        assert got[c] == min(seen, key=lambda x: (-seen[x], x))
    assert tuple(ranks.modes(rows.where("false"), ["v", "s"]).first()) == (None, None)
    few = spark.createDataFrame([(1, None), (2, 5.0), (3, 6.0), (4, NAN)], "id int, v double")
    assert [r.v for r in reshape.fill_nulls(few, ["v"], "median").where("id = 1").collect()] == [5.5]
    assert [r.v for r in reshape.fill_nulls(few, ["v"], "mode").where("id = 1").collect()] == [5.0]
    assert [r.v for r in reshape.fill_nulls(few, ["v"], "mean").where("id = 1").collect()] == [5.5]
    assert [r.v for r in reshape.fill_nulls(few.where("id = 1"), ["v"], "median").collect()] == [None]


def test_distinct_counts(rows):
    plan = ranks.distinct_counts(rows, rows.columns)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    got = {r.column: (r.total, r.null_count, r.unique_count) for r in profile.counts(rows).collect()}
    for c in rows.columns:
        values = [str(r[0] + 0.0) if isinstance(r[0], float) else str(r[0]) for r in rows.select(c).collect() if r[0] is not None and r[0] == r[0]]
        assert got[c] == (900, 900 - len(values), len(set(values)))
    assert {(r.total, r.unique_count) for r in profile.counts(rows.where("false")).collect()} == {(0, 0)}


def test_many_distinct_counts_in_groups_and_alone(rows):
    asked = [{"column": "v", "function": "count_distinct"}, {"column": "n", "function": "sum"}, {"column": "s", "function": "count_distinct", "alias": "texts"}]
    got = transform.aggregate(rows.withColumn("g", F.when(F.col("g") < 6, F.col("g"))), ["g"], asked)
    assert got.columns == ["g", "v_count_distinct", "n_sum", "texts"]
    plain = rows.groupBy(F.when(F.col("g") < 6, F.col("g"))).agg(F.count_distinct(F.nanvl("v", F.lit(None))), F.sum("n"), F.count_distinct("s"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, plain.collect())))
    alone = transform.aggregate(rows, [], asked)
    assert tuple(alone.first()) == tuple(rows.agg(F.count_distinct(F.nanvl("v", F.lit(None))), F.sum("n"), F.count_distinct("s")).first()) and alone.columns == got.columns[1:]


def test_sketches_add_up(spark):
    rows = spark.range(60_000).select((F.col("id") % 20_000).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("s"), F.lit(None).cast("double").alias("none"))
    whole = {r.column: r for r in profile.sketch_counts(profile.sketches(rows)).collect()}
    parts = profile.sketches(rows.where("k % 2 = 0")).union(profile.sketches(rows.where("k % 2 = 1")))
    merged = {r.column: r for r in profile.sketch_counts(profile.merged_sketches(parts)).collect()}
    for c, exact in (("k", 20_000), ("s", 40_000), ("none", 0)):
        assert merged[c].total == whole[c].total == 60_000 and merged[c].null_count == whole[c].null_count
        assert abs(merged[c].unique_count - exact) <= 5 * 1.04 / 2**7 * exact and abs(whole[c].unique_count - exact) <= 5 * 1.04 / 2**7 * exact
    assert {r.column: r.unique_count for r in profile.counts(rows, approximate=True).collect()} == {c: whole[c].unique_count for c in whole}
