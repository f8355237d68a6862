"""Statistics of pipeline runs, steps, schedules and storage events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_stats(runs: DataFrame) -> DataFrame:
    """One row: total, completed (healed runs too), failed, running, pending, cancelled, success_rate, avg_duration_ms.

    success_rate: completed runs in percent of all, to one digit; 0 without runs. avg_duration_ms: whole, over all runs with both times; 0 without any.
    """
    status = lambda *s: F.count_if(F.col("status").isin(*s))
    ms = (F.unix_millis(F.col("completed_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp"))).cast("double")
    completed = status("completed", "healed")
    return runs.agg(
        F.count("*").alias("total"), completed.alias("completed"), *[status(s).alias(s) for s in ("failed", "running", "pending", "cancelled")],
        F.when(F.count("*") > 0, F.bround(100.0 * completed / F.count("*"), 1)).otherwise(0.0).alias("success_rate"), F.coalesce(F.bround(F.avg(ms)), F.lit(0.0)).cast("long").alias("avg_duration_ms"),
    )


def top_pipelines(runs: DataFrame, k: int = 5) -> DataFrame:
    return runs.groupBy("name").agg(F.count("*").alias("runs")).orderBy(F.desc("runs"), "name").limit(k)


def recent_activity(runs: DataFrame, k: int = 10) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), "id").limit(k)


def run_timing(steps: DataFrame, run_id) -> DataFrame:
    return steps.where(F.col("run_id") == run_id).select("step_index", "step_name", "step_type", "rows_in", "rows_out", "duration_ms").orderBy("step_index")


def step_medians(steps: DataFrame) -> DataFrame:
    """step_type, median_ms, samples over steps with a duration and input rows above 0."""
    return steps.where("duration_ms > 0 AND rows_in > 0").groupBy("step_type").agg(F.percentile("duration_ms", 0.5).alias("median_ms"), F.count("*").alias("samples"))


def schedule_stats(runs: DataFrame) -> DataFrame:
    """Per schedule: successful, healed and failed runs (breaches of a contract too) and the last status."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    rows = runs.where("schedule_id is not null").groupBy("schedule_id")
    return rows.agg(n("completed").alias("successful_runs"), n("healed").alias("healed_runs"), n("failed", "contract_violation").alias("failed_runs"), F.max_by("status", F.struct("created_at", "id")).alias("last_status"))


def _recent(events: DataFrame, now: str, days: int) -> DataFrame:
    return events.where(F.col("created_at") > F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def storage_by_tier(events: DataFrame, now: str, days: int = 7) -> DataFrame:
    """tier, events, bytes and mean duration (to two digits) of the storage events after so many days before now."""
    return _recent(events, now, days).groupBy("tier").agg(F.count("*").alias("events"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.round(F.avg("duration_ms"), 2), F.lit(0.0)).alias("avg_ms"))


def storage_growth(events: DataFrame, now: str, days: int = 7) -> DataFrame:
    """day, mb (to one digit) of what was written to any tier (write_hot, write_warm, write_cold) on each of the last days."""
    rows = _recent(events, now, days).where(F.col("event_type").like("write_%"))
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(F.round(F.coalesce(F.sum("payload_bytes"), F.lit(0)) / (1024 * 1024), 1).alias("mb"))
