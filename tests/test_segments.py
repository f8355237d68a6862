"""Fills across ranges, repeatable samples, heavy hitters and counts of files against plain Python."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftline.operators import profile, reshape, transform
from weftline.sources import tables


@pytest.mark.parametrize("forward", [True, False])
def test_fills_of_one_key_that_holds_most_rows(spark, forward):
    rng = random.Random(forward)
    rows = [(0 if rng.random() < 0.8 else rng.choice([1, 2, None]), k, rng.choice([None, None, None, float(k)]), rng.choice([None, None, f"s{k}"])) for k in range(1200)]
    df = spark.createDataFrame(rows, "g int, t int, v double, s string").repartition(5)
    got = reshape.fill_nulls(df, ["v", "s"], "forward_fill" if forward else "backward_fill", order_by=["t"], partition_by=["g"])
    last, want = {}, []
    for g, k, v, s in rows if forward else rows[::-1]:
        held = last.setdefault(g, [None, None])
        last[g] = held = [v if v is not None else held[0], s if s is not None else held[1]]
        want.append((g, k, *held))
    assert got.columns == df.columns and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert reshape.fill_nulls(df.limit(0), ["v"], "forward_fill", order_by=["t"], partition_by=["g"]).count() == 0


def test_backward_fill_takes_each_row_once(spark):
    rows = [(None if k % 4 == 0 else k % 9, k, f"s{k}" if k % 5 == 0 else None) for k in range(300)]
    got = reshape.fill_nulls(spark.createDataFrame(rows, "a int, b int, v string").repartition(3), ["v"], "backward_fill", order_by=["a", "b"])
    held, want = None, {}
    for a, b, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True):  # a null comes first
        want[b] = held = v if v is not None else held
    assert {r.b: r.v for r in got.collect()} == want
    assert "currentrow$(), unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower()  # such a frame takes all later rows for each row


def test_samples_that_others_can_repeat(spark):
    df = spark.range(1000).select("id", (F.col("id") % 10 == 0).alias("rare"), F.lit(None).cast("string").alias("none")).repartition(7)
    digest = {k: hashlib.md5(f"7|{k}|".encode()).hexdigest() for k in range(1000)}
    first = sorted(digest, key=digest.get)
    assert {r.id for r in transform.sample(df, n=50, by=["id", "none"], random_state=7).collect()} == set(first[:50])
    assert {r.id for r in transform.sample(df, fraction=0.2, by=["id", "none"], random_state=7).collect()} == {k for k in digest if int(digest[k][:8], 16) < int(0.2 * 2**32)}
    strata = transform.sample(df, n=101, stratify_by="rare", by=["id", "none"], random_state=7)
    assert {r.id for r in strata.collect()} == set([k for k in first if k % 10 == 0][:10] + [k for k in first if k % 10][:90])
    plan = strata._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_heavy_hitters(spark):
    rng = random.Random(1)
    rows = [(rng.choice("aaabbc"), f"u{k}", rng.choice(["x", "y"]) if rng.random() < 0.6 else f"z{rng.randrange(3000)}", None) for k in range(6000)]
    df = spark.createDataFrame(rows, "few string, own string, mixed string, none string").repartition(4)
    proved, rest, totals = profile.heavy_hitters(df, df.columns, 2, tracked=100)
    assert {r[0] for r in proved} == {"few", "mixed"} and rest == ["own", "none"] and totals["none"] == 0
    got = {}
    for r in profile.top_values(df, 2).collect():
        got.setdefault(r.column, []).append((r.rank, r.value, r["count"]))
    for i, c in enumerate(df.columns):
        seen = Counter(r[i] for r in rows if r[i] is not None)
        want = sorted(seen, key=lambda v: (-seen[v], v))[:2]
        assert sorted(got.get(c, [])) == [(k, v, seen[v]) for k, v in enumerate(want, 1)]
    assert profile.top_values(df.limit(0), 2).count() == 0


def test_ties_at_the_last_rank(spark):
    rows = spark.createDataFrame([(v,) for v in "ab" * 500 + "cde" * 400 + "f" * 7], "v string")
    assert [(r.value, r["count"]) for r in profile.top_values(rows, 4).orderBy("rank").collect()] == [("a", 500), ("b", 500), ("c", 400), ("d", 400)]


def test_files_are_counted_from_their_footers(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(10).select("id", F.lit("x").alias("s")).repartition(2).write.parquet(path)
    spark.range(0).select("id", F.lit("x").alias("s")).write.mode("append").parquet(path)
    found = tables.file_metadata(spark, path)
    rows = found.collect()
    assert sorted(r.row_count for r in rows) == [0, 5, 5] and all(r.bytes > 0 and r.columns == ["id", "s"] and r.column_count == 2 for r in rows)
    assert "ReadSchema: struct<>" in found._jdf.queryExecution().executedPlan().toString()
