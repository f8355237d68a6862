"""Stored tables merged by bucket, and the index of names."""

import datetime
import random

from pyspark.sql import functions as F

from weftline.operators import catalog, stored

ASSET = "asset_type string, name string, namespace string, metadata string, id long, owner_id long, created_at timestamp, last_seen_at timestamp"


def assets(spark, rng, n, names):
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(10_000))
    rows = []
    for k in range(n):
        begun = at()
        rows.append((rng.choice(["file", "column", None]), rng.choice(names), rng.choice(["main", None]), f"m{k}", rng.randrange(10**6), k, begun, begun + datetime.timedelta(minutes=5)))
    return spark.createDataFrame(rows, ASSET)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    rng = random.Random(2)
    store = catalog.stored_assets(spark, str(tmp_path / "a"), 16)
    assert store.versions() == {} and store.table(ASSET).count() == 0
    first, second = assets(spark, rng, 300, [f"n{k}" for k in range(60)]), assets(spark, rng, 3, ["n1", "other"])
    store.merge(first)
    before = store.versions()
    touched = store.merge(second)
    after = store.versions()
    assert 0 < len(touched) <= 3 < len(before) and {b for b in after if after[b] == 2} == touched and all(after[b] == before[b] for b in before if b not in touched)
    want = catalog.upsert_assets(first, second)
    assert sorted(map(repr, map(tuple, store.table(ASSET).select(*want.columns).collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert store.merge(second.limit(0)) == set() and store.merge(second) == touched
    assert sorted(map(repr, map(tuple, store.table(ASSET).select(*want.columns).collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_a_failed_merge_changes_nothing(spark, tmp_path):
    rng = random.Random(3)
    store = catalog.stored_assets(spark, str(tmp_path / "a"), 4)
    store.merge(assets(spark, rng, 20, ["a", "b", "c"]))
    held, rows = store.versions(), store.table(ASSET).count()
    try:
        store.merge(assets(spark, rng, 20, ["a", "d"]).withColumn("id", F.raise_error(F.lit("lost")).cast("long")))
        raise AssertionError("the merge should fail")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert store.versions() == held and store.table(ASSET).count() == rows


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    rng = random.Random(4)
    names = ["orders_2024.csv", "Orders Daily", "customer-orders", "a-b", "äpfel und BÄRE", "x", "", "!!", "2024", "rders"] + ["".join(rng.choice("abr_ -12") for _ in range(rng.randint(1, 12))) for _ in range(150)] + [None]
    rows = assets(spark, rng, 500, names)
    index = catalog.name_index(spark, str(tmp_path / "i"), 32)
    for part in (rows.where("id % 2 = 0"), rows, rows.limit(0)):
        index.add(part)
    for query in ("orders", "RDERS", "a-b", "-b", "b", "ab", " a", "s d", "2024", "ärE", "!!", "r_", "1 2", "zzz", "rders_2024.c"):
        scan = sorted(map(repr, map(tuple, catalog.search(rows, query, limit=9999).collect())))
        assert sorted(map(repr, map(tuple, catalog.search(rows, query, limit=9999, index=index).collect()))) == scan, query
    keys = spark.read.parquet(str(tmp_path / "i" / "keys"))
    assert keys.count() == keys.distinct().count() == rows.where("name is not null").select(*catalog.ASSET_KEY).distinct().count()


def test_index_opens_the_querys_folders_only(spark, tmp_path):
    index = catalog.name_index(spark, str(tmp_path / "i"), 64)
    index.add(spark.range(3000).select(F.lit("file").alias("asset_type"), F.lit("main").alias("namespace"), F.concat(F.lit("asset "), F.col("id")).alias("name")))
    plan = index.candidates("sset 1234")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slot" in plan and "PushedFilters: [In(gram" in plan
    assert stored.needed_grams("sset 12") == sorted(["sse", "set", "et ", "  1", " 12"]) and [r.name for r in index.holding("sset 1234").collect()] == ["asset 1234"]
