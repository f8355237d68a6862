"""Statistics of runs, contracts and rules where values are missing, odd or not numbers."""

import datetime

import pytest
from pyspark.sql import functions as F

from weftline.operators import contracts, quality, runs, transform

NAN = float("nan")


def test_healed_runs_are_completed_ones(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, "healed", at(0), at(2)), (2, "completed", at(0), at(2)), (3, "failed", at(0), at(8)), (4, "pending", None, None)]
    got = runs.run_stats(spark.createDataFrame(rows, "id long, status string, started_at timestamp, completed_at timestamp")).first()
    assert (got.total, got.completed, got.failed, got.pending, got.success_rate, got.avg_duration_ms) == (4, 2, 1, 1, 50.0, 4000)
    none = runs.run_stats(spark.createDataFrame([], "id long, status string, started_at timestamp, completed_at timestamp")).first()
    assert (none.total, none.success_rate, none.avg_duration_ms) == (0, 0.0, 0)


def test_steps_without_input_do_not_count(spark):
    rows = spark.createDataFrame([("join", 10.0, 5), ("join", 30.0, 1), ("join", 99.0, 0), ("join", 99.0, None), ("join", 0.0, 5), ("sort", None, 5)], "step_type string, duration_ms double, rows_in long")
    assert [tuple(r) for r in runs.step_medians(rows).collect()] == [("join", 20.0, 2)]


def test_breaches_are_failed_runs_and_every_tier_is_written(spark):
    at = datetime.datetime(2024, 1, 5)
    rows = spark.createDataFrame([(1, 7, s, at) for s in ("completed", "healed", "failed", "contract_violation")], "id long, schedule_id long, status string, created_at timestamp")
    got = runs.schedule_stats(rows).first()
    assert (got.successful_runs, got.healed_runs, got.failed_runs) == (1, 1, 2)
    written = spark.createDataFrame([(k, 1 << 20, at) for k in ("write_hot", "write_warm", "write_cold", "write", "read_hot")] + [("write_hot", 1 << 20, datetime.datetime(2024, 1, 3))], "event_type string, payload_bytes long, created_at timestamp")
    assert [tuple(r) for r in runs.storage_growth(written, "2024-01-10 00:00:00").collect()] == [(datetime.date(2024, 1, 5), 3.0)]


@pytest.fixture(scope="module")
def holed(spark):
    return spark.createDataFrame([(1, 1.0, "a"), (2, NAN, "b"), (3, None, "b"), (4, 9.0, None)], "id long, v double, s string")


def test_not_a_number_is_no_value(holed):
    report = {r.position: r for r in quality.validate(holed, [{"check": "less_than", "column": "v", "value": 5}, {"check": "between", "column": "v", "min": 0, "max": 5}, {"check": "greater_than", "column": "v", "value": 5}]).collect()}
    assert [report[k].failing for k in range(3)] == [1, 1, 1] and report[0].examples == ["9.0"] and report[2].examples == ["1.0"]
    found = contracts.violations(holed, {"columns": {"v": {"max_value": 5, "min_value": 2}}, "allow_extra": True}).collect()
    assert {r.rule: r.actual for r in found} == {"max_value": "1", "min_value": "1"}
    got = transform.aggregate(holed, [], [{"column": "v", "function": f} for f in ("max", "mean", "count", "sum", "median", "count_distinct")]).first()
    assert tuple(got) == (9.0, 5.0, 2, 10.0, 5.0, 2)


def test_null_rate_is_told_as_it_is(holed):
    got = contracts.violations(holed, {"null_thresholds": {"v": 5, "s": 25}}).where("rule = 'null_rate'").collect()
    assert [(r.column, r.actual, r.expected) for r in got] == [("v", "25", "<= 5 %")]


def test_rules_give_examples_and_unread_patterns_fail_no_row(holed):
    rules = [{"check": "matches_pattern", "column": "s", "pattern": "("}, {"check": "no_duplicates", "column": "s"}, {"check": "not_null", "column": "gone"}, {"check": "in_values", "column": "s", "values": ["a"]}]
    got = quality.validate(holed, rules).orderBy("position").collect()
    assert [(r.passed, r.failing) for r in got] == [(False, 0), (False, 1), (False, 4), (False, 3)]
    assert got[1].examples == ["b"] and set(got[3].examples) == {"b", "None"} and quality.validate(holed, rules, examples=0).where(F.size("examples") > 0).count() == 0
