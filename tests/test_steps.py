"""Argument checks, null cases, pipelines, contracts, lineage and streams on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.arguments import StepError
from weftline.functions.masks import mask
from weftline.operators import contracts, drift, lineage, profile, quality, reshape, sqlstep, transform, udf
from weftline.plans import pipeline
from weftline.sources import tables
from weftline.streaming import streams


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([(1, "Ann", 10.0, "a%b"), (2, None, None, "x_y"), (3, "Bob", 30.0, None), (None, "Cid", -1.0, "it's")], "id int, name string, v double, t string")


def test_missing_column_names_the_closest(people):
    with pytest.raises(StepError, match="did you mean 'name'"):
        transform.select(people, ["nmae"])


def test_filters_drop_nulls_and_match_literally(people):
    assert {r.id for r in transform.filter(people, "name", "not_equals", "Ann").collect()} == {3, None}
    assert [r.id for r in transform.filter(people, "t", "contains", "%").collect()] == [1]
    assert {r.id for r in transform.filter(people, "t", "not_contains", "_").collect()} == {1, None}
    with pytest.raises(StepError):
        transform.filter(people, "v", "gt", "many")


def test_rename_clash(people):
    with pytest.raises(StepError):
        transform.rename(people, {"id": "name"})


def test_first_needs_an_order(people):
    with pytest.raises(StepError):
        transform.aggregate(people, [], {"v": "first"})
    assert transform.aggregate(people, [], {"v": "last"}, order_by=["name"]).first()[0] == -1.0


def test_sum_of_nulls_is_null(people):
    assert transform.aggregate(people.where("id = 2"), [], {"v": "sum"}).first()[0] is None


def test_sample_is_repeatable_and_exact(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    a = {r.id for r in transform.sample(df, n=50).collect()}
    assert len(a) == 50 and a == {r.id for r in transform.sample(df.repartition(7), n=50).collect()}
    assert transform.sample(df, n=5000).count() == 1000
    assert {r.g: r["count"] for r in transform.sample(df, n=30, stratify_by="g").groupBy("g").count().collect()} == {0: 10, 1: 9, 2: 9}


def test_pivot_fills_and_drops_null_index(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "b", 6), (None, "a", 7)], "id int, c string, v int")
    assert {tuple(r) for r in reshape.pivot(df, "id", "c", "v", fill_value=-1).collect()} == {(1, 5, -1), (2, -1, 6)}


def test_global_fill_crosses_partitions(spark):
    rows = [(k, float(k) if k % 50 == 0 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(8)
    got = {r.k: r.v for r in reshape.fill_nulls(df, ["v"], "ffill", order_by=["k"]).collect()}
    assert all(got[k] == k // 50 * 50 for k in range(400))


def test_sql_guard(people):
    assert sqlstep.sql("SELECT 'drop {x}' AS s, count(*) AS n FROM {{input}}", input=people).first().n == 4
    for bad in ("DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM parquet.`/x`", "INSERT INTO t SELECT 1", "SELECT * FROM read_files('/x')"):
        with pytest.raises(StepError):
            sqlstep.check_sql(bad)


def test_compute_errors_become_null(people):
    def f(v):
        if hasattr(v, "sum"):
            raise TypeError("rows only")
        return 1 / v if v > 0 else 1 / 0

    made = udf.compute(people.where("id is null or id = 1"), f, ["v"], "out")
    assert {r.name: r.out for r in made.collect()} == {"Ann": 0.1, "Cid": None}
    assert udf.checked(made).columns == ["id", "name", "v", "t", "out"]


def test_quality_report(people):
    report = quality.validate(people, [{"check": "not_null", "column": "id"}, {"check": "positive", "column": "v", "severity": "warning"}, {"check": "not_null", "column": "zip"}, {"check": "matches_pattern", "column": "t", "pattern": "("}], examples=3)
    assert [r.passed for r in report.orderBy("position").collect()] == [False] * 4
    assert quality.verdict(report) == {"passed": False, "errors": 3, "warnings": 1}


def test_contract(people):
    found = contracts.violations(people, {"columns": {"id": {"type": "string", "nullable": False}, "gone": {}, "v": {"type": "float", "min_value": 0}}, "max_rows": 3}, output=True)
    assert {(r["column"], r["rule"]) for r in found.collect()} == {("id", "type"), ("id", "not_null"), ("gone", "required"), ("v", "min_value"), (None, "max_rows"), ("name", "unexpected"), ("t", "unexpected")}
    assert contracts.breach(found)["blocked"]


def test_masks(spark):
    df = spark.createDataFrame([("ann@x.org",), ("",), (None,), ("abc",)], "v string")
    assert [r[0] for r in df.select(mask(F.col("v"), "email")).collect()] == ["a***@x.org", "", None, "a***"]
    assert [r[0] for r in df.select(mask(F.col("v"))).collect()] == ["an***g", "", None, "***"]


def test_winkler():
    assert round(drift.winkler("martha", "marhta"), 4) == 0.9611
    assert drift.winkler("customer_name", "cust_name") > 0.85 and drift.winkler("", "a") == 0.0


def test_semantic_types(spark):
    rows = [(k, f"u{k}@x.org", "yes" if k % 2 else "no", 1.5 * k, f"+1 555 01{k:02}", f"2024-01-{k % 28 + 1:02}T10:00:00", f"2024-01-{k % 28 + 1:02}", f"{k:08x}-0000-0000-0000-000000000000", "NSEW"[k % 4], None, f"note {k}") for k in range(100)]
    df = spark.createDataFrame(rows, "user_id int, m string, ok string, price double, mobile string, created string, day string, u string, region string, dob string, words string")
    found = {r["column"]: (r["semantic_type"], set(r["flags"])) for r in profile.semantic_types(df).collect()}
    assert {c: kind for c, (kind, _) in found.items()} == {
        "user_id": "integer_id", "m": "email", "ok": "boolean", "price": "currency", "mobile": "phone", "created": "datetime", "day": "phone", "u": "identifier", "region": "categorical", "dob": "text", "words": "text",
    }
    assert {"likely_id", "high_cardinality"} <= found["user_id"][1] and "likely_email" in found["m"][1] and found["ok"][1] == {"likely_boolean"}
    assert {"likely_pii", "likely_phone"} <= found["mobile"][1] and {"likely_pii", "high_null_rate"} <= found["dob"][1] and "likely_date" in found["created"][1]
    assert "dob" in profile.pii_columns(profile.semantic_types(df)) and not any(r["flags"] for r in profile.semantic_types(df.limit(0)).collect())


def test_lineage_edges_and_walk(spark):
    rows = [
        ("r", "load", "load", None, None, None, None, None, None, None, None, None, ["a", "b"]),
        ("r", "named", "rename", ["load"], [["a", "b"]], None, {"a": "x"}, None, None, None, None, None, ["x", "b"]),
        ("r", "sums", "aggregate", ["named"], [["x", "b"]], None, None, None, [("b", "sum")], ["x"], None, None, ["x", "b_sum"]),
    ]
    edge = lineage.edges(spark.createDataFrame(rows, lineage.RECORD))
    assert {r.node for r in lineage.ancestry(edge, "sums", "b_sum").collect()} == {"sums:b_sum", "named:b", "load:b", "file:load:b"}
    assert {r.node for r in lineage.impact(edge, "load", "a").collect()} == {"load:a", "named:x", "sums:x"}


def test_rename_candidates_by_file_are_all_found(spark, tmp_path):
    from weftline.plans.queries import QUERIES

    users = {("view", 1): (1, 2, 5, 61, 70), ("view", 2): (2, 11, 12, 15, 50), ("view", 4): (21, 1, 63), ("click", 1): (3, 33), ("click", 3): (13, 30)}
    rows = [(kind, f"2024-01-0{day}", u) for (kind, day), us in users.items() for u in us]
    spark.createDataFrame(rows, "event_type string, ts string, user_id long").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/events.parquet")
    held = {}
    for kind, day, u in rows:
        held.setdefault(f"{kind}-{u // 40}", {}).setdefault(int(day[-1]), set()).add(f"c{u % 40}")
    want = set()
    for file, days in held.items():
        for a, b in zip(sorted(days), sorted(days)[1:]):
            want |= {(file, b, x, y) for x in days[a] - days[b] for y in days[b] - days[a] if drift.winkler(x, y) >= 0.85}
    got = QUERIES["drf3_rename_candidates_by_file"](spark, str(tmp_path)).collect()
    assert len(want) > 3 and sorted((r.file_id, r.captured_at.day, r.old_name, r.new_name) for r in got) == sorted(want)


def test_lineage_and_joins_take_all_rows(spark, tmp_path):
    from weftline.plans.queries import QUERIES

    sf = str(tmp_path)
    spark.range(40).selectExpr("id AS event_id", "id % 7 AS user_id").write.parquet(f"{sf}/events.parquet")
    spark.range(30).selectExpr("id AS o_custkey", "id AS o_orderkey", "'F' AS o_orderstatus").union(spark.range(110, 113).selectExpr("id", "id", "'O'")).write.parquet(f"{sf}/orders.parquet")
    spark.range(25).selectExpr("id AS c_custkey", "'n' AS c_name", "1.0D AS c_acctbal").write.parquet(f"{sf}/customer.parquet")
    runs = {str(k) for k in range(7)}
    assert QUERIES["lin1_edges"](spark, sf).count() == 40
    assert {r.run_id for r in QUERIES["lin4_column_pairs_all_runs"](spark, sf).collect()} == {r.run_id for r in QUERIES["lin5_openlineage"](spark, sf).collect()} == runs
    links = {(str(k % 7), f"s{k % 4}:c{k // 4 % 3}", f"s{k % 4 + 1}:c{k // 8 % 3}") for k in range(40)}
    for name, start, a, b in (("lin2_ancestry_all_runs", "s4:c0", 2, 1), ("lin3_impact_all_runs", "s0:c1", 1, 2)):
        want = {(x[0], start) for x in links if x[a] == start}
        for _ in range(4):
            want |= {(x[0], x[b]) for x in links if (x[0], x[a]) in want}
        assert {(r.run_id, r.node) for r in QUERIES[name](spark, sf).collect()} == want
    for how, n in (("jn1_inner", 3), ("jn2_left", 33), ("jn3_right", 25), ("jn4_outer", 55)):
        assert QUERIES[f"{how}_join_all_rows"](spark, sf).count() == n


def test_pipeline_check_and_save(spark, people, tmp_path):
    steps = [{"name": "p", "type": "load", "table": "people"}, {"name": "f", "type": "filter", "input": "p", "column": "v", "operator": "gt", "value": 0}]
    made = pipeline.run(steps, {"people": people}, observe=True)
    assert made["f"].frame.count() == 2 and made["f"].rows_out == 2
    assert len(pipeline.check([*steps, {"name": "x", "type": "select", "input": "f", "columns": ["zz"]}], {"people": people})) == 1
    assert not pipeline.trial([*steps, {"name": "x", "type": "sort", "input": "f", "by": "zz"}], {"people": people})["success"]
    report = tables.save(people, str(tmp_path / "out.json"))
    assert report["rows"] == 4 and report["format"] == "json" and tables.load(spark, report["path"], "json").count() == 4


def test_stream_with_dead_letters(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType())])
    source = tmp_path / "in"
    rows = [("t", 0, k, str(k), json.dumps({"id": k, "v": k * 1.0}) if k % 4 else "{broken") for k in range(12)] + [("t", 0, 3, "3", '{"id": 3, "v": 3.0}'), ("t", 0, 99, "n", None)]
    spark.createDataFrame(rows, "topic string, partition int, offset long, key string, value string").coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema("topic string, partition int, offset long, key string, value string").parquet(str(source))
    good, dead = str(tmp_path / "good"), str(tmp_path / "dead")
    steps = [{"name": "in", "type": "stream_consume"}, {"name": "big", "type": "filter", "input": "in", "column": "v", "operator": "gt", "value": 2}, {"name": "out", "type": "stream_publish", "input": "big", "topic": "results", "key_column": "id"}]
    batches = streams.Batches(steps, schema, lambda df, b: df.write.mode("append").parquet(good), lambda df, b: df.write.mode("append").parquet(dead))
    streams.start(stream, batches, str(tmp_path / "checkpoint"), once=True).awaitTermination(120)
    assert {int(r.key) for r in spark.read.parquet(good).collect()} == {3, 5, 6, 7, 9, 10, 11}
    letters = streams.inspect_dead_letters(spark.read.parquet(dead)).collect()
    assert [r.original_offset for r in letters] == [0, 4, 8] and letters[0].original_topic == "t"
    assert batches.stats["dead_letters"] == 3
    with pytest.raises(StepError):
        streams.topic_name("_bad")


def test_save_step_writes_and_reports(spark, tmp_path):
    from weftline.plans import pipeline

    df = spark.createDataFrame([(1, 2.0), (2, float("nan")), (3, None)], "id int, v double")
    for kind, form in (("csv", "csv"), ("json", "json"), ("parquet", "parquet"), ("txt", "csv")):
        path = str(tmp_path / f"out.{kind}")
        steps = [{"name": "in", "type": "load", "table": "t"}, {"name": "some", "type": "filter", "input": "in", "column": "id", "operator": "greater_than", "value": 1}, {"name": "out", "type": "save", "input": "some", "path": path}]
        made = pipeline.run(steps, {"t": df})
        report = made["out"].report
        assert report["rows"] == 2 and report["format"] == form and report["path"] == path and report["bytes"] > 0
        assert (made["some"].rows_in, made["some"].rows_out, made["out"].rows_in, made["out"].rows_out) == (3, 2, 2, 2) and made["out"].seconds > 0
        pipeline.release(made)
        back = spark.read.csv(path, header=True) if form == "csv" else getattr(spark.read, form)(path)
        assert back.count() == 2


def test_healed_runs_are_complete(spark):
    from weftline.operators import lineage

    runs = spark.createDataFrame([("r", "p", "healed", "2024-01-01")], "run_id string, name string, status string, completed_at string")
    edge = spark.createDataFrame([("r", "s1", "sql", "s0", "a", "b", False)], "run_id string, step string, step_type string, in_step string, in_col string, out_col string, is_join_key boolean")
    assert lineage.open_lineage(runs, edge).first().event_type == "COMPLETE"


def test_lag_of_progress():
    source = lambda latest, end: {"sources": [{"latestOffset": latest, "endOffset": end}]}
    assert streams.lag(source({"t": {"0": 10, "1": 7}, "u": {"0": 3}}, {"t": {"0": 4, "1": 9}})) == 9
    assert streams.lag(source(None, {"logOffset": 3})) is None and streams.lag({"sources": []}) is None

    class Report:
        json = '{"sources": [{"latestOffset": {"t": {"0": 5}}, "endOffset": {"t": {"0": 2}}}]}'

    assert streams.lag(Report()) == 3


def test_stream_stops_after_failures_in_a_row(spark, monkeypatch):
    monkeypatch.setattr(streams, "FAILURES", 2)
    steps = [{"name": "in", "type": "stream_consume"}, {"name": "x", "type": "filter", "input": "in", "column": "gone", "operator": "gt", "value": 1}]
    dead = []
    batches = streams.Batches(steps, T.StructType([T.StructField("id", T.LongType())]), lambda df, b: None, lambda df, b: dead.append(df.count()))
    batch = spark.createDataFrame([(bytearray(b"k"), bytearray(b'{"id": 1}'), "t", 0, 0)], "key binary, value binary, topic string, partition int, offset long")
    batches(batch, 0)
    with pytest.raises(StepError):
        batches(batch, 1)
    assert dead == [1] and batches.stats["failed_batches"] == 2


def test_compute_runs_once_and_stops_beyond_the_limit(spark):
    df = spark.range(200).selectExpr("id * 1.0D AS v")
    with pytest.raises(StepError, match="failed on 40 of 200"):
        udf.checked(udf.compute(df, lambda v: 1 / (int(v) % 5), ["v"], "out"))
    calls = spark.sparkContext.accumulator(0)

    def counted(v):
        calls.add(len(v))
        return v + 1

    made = udf.checked(udf.compute(df, counted, ["v"], "out"))
    assert made.agg(F.sum("out")).first()[0] == 20100.0 and made.count() == 200 and calls.value == 200


def test_lineage_event_has_facets(spark):
    runs = spark.createDataFrame([("r", "p", "success", "2024-01-01", 12), ("q", "p", "pending", None, None)], "run_id string, name string, status string, completed_at string, duration_ms int")
    edge = spark.createDataFrame([("r", "s1", "load", "in.csv", "a", "b", False), ("r", "s2", "sql", "s1", "b", "c", False)], "run_id string, step string, step_type string, in_step string, in_col string, out_col string, is_join_key boolean")
    said = {r.run_id: json.loads(r.event) for r in lineage.open_lineage(runs, edge).collect()}
    whole = said["r"]
    assert (whole["eventType"], whole["run"]["facets"]["runMetrics"]["durationMs"], whole["job"]["facets"]["jobType"]["jobType"]) == ("COMPLETE", 12, "PIPELINE")
    (source,), (sink,) = whole["inputs"], whole["outputs"]
    assert (source["namespace"], source["name"], sink["name"]) == ("file", "in.csv", "s2")
    assert source["facets"]["columnLineage"]["fields"] == {"s1:b": {"inputFields": [{"namespace": "file", "name": "in.csv", "field": "a"}]}}
    assert sink["facets"]["columnLineage"]["fields"]["c"]["inputFields"][0]["field"] == "b"
    assert said["q"]["eventType"] == "START" and said["q"]["inputs"] == [] == said["q"]["outputs"]
