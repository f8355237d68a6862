"""Column lineage of many runs as an edge table, and questions over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .walks import walk

#: Fixed values of the OpenLineage format, and the name that this library gives as its producer.
SCHEMA_URL = "https://openlineage.io/spec/2-0-2/OpenLineage.json"
BASE_FACET, PRODUCER = f"{SCHEMA_URL}#/definitions/BaseFacet", "weftline"

RECORD = "run_id string, step string, step_type string, inputs array<string>, input_columns array<array<string>>, columns array<string>, mapping map<string,string>, join_key string, aggregations array<struct<column: string, function: string>>, group_by array<string>, index array<string>, value_column string, output_columns array<string>"


def edges(records: DataFrame) -> DataFrame:
    """run_id, step, step_type, in_step, in_col, out_col, is_join_key from the step records of any number of runs (RECORD).

    One rule for each kind of step: filter, sort, deduplicate, fill_nulls, sample and save pass columns through; select keeps some; rename maps; join keeps both sides',
    with suffixes on common names; aggregate and pivot derive; unpivot, sql, transform and compute derive every output column from every input column.
    """
    at = records.select("*", F.posexplode_outer("inputs").alias("side", "in_step")).withColumn("cols", F.coalesce(F.try_element_at("input_columns", F.col("side") + 1), F.array().cast("array<string>")))
    other = F.coalesce(F.try_element_at("input_columns", F.when(F.col("side") == 0, 2).otherwise(1)), F.array().cast("array<string>"))
    pair = lambda a, b, key=None: F.struct(a.alias("in_col"), b.alias("out_col"), (F.lit(False) if key is None else key).alias("is_join_key"))
    through = F.transform("cols", lambda c: pair(c, c))
    kept = F.transform(F.filter("cols", lambda c: F.array_contains("columns", c)), lambda c: pair(c, c))
    renamed = F.transform("cols", lambda c: pair(c, F.coalesce(F.try_element_at("mapping", c), c)))
    suffix = F.when(F.col("side") == 0, "_left").otherwise("_right")
    joined = F.transform("cols", lambda c: pair(c, F.when((c != F.col("join_key")) & F.array_contains(other, c), F.concat(c, suffix)).otherwise(c), c == F.col("join_key")))
    grouped = F.concat(F.transform("group_by", lambda c: pair(c, c)), F.transform("aggregations", lambda a: pair(a["column"], F.concat(a["column"], F.lit("_"), a["function"]))))
    new = F.array_except("output_columns", "index")
    pivoted = F.concat(F.transform("index", lambda c: pair(c, c)), F.transform(new, lambda c: pair(F.col("value_column"), c)))
    derived = F.flatten(F.transform("cols", lambda c: F.transform("output_columns", lambda o: pair(c, o))))
    loaded = F.transform("output_columns", lambda c: pair(c, c))
    kind = F.col("step_type")
    rule = (
        F.when(kind == "load", loaded).when(kind == "select", kept).when(kind == "rename", renamed).when(kind == "join", joined).when(kind == "aggregate", grouped)
        .when(kind == "pivot", pivoted).when(kind.isin("unpivot", "sql", "transform", "compute"), derived).otherwise(through)
    )
    out = at.withColumn("e", F.explode(rule))
    return out.select("run_id", "step", "step_type", F.coalesce("in_step", F.concat(F.lit("file:"), "step")).alias("in_step"), "e.in_col", "e.out_col", F.coalesce("e.is_join_key", F.lit(False)).alias("is_join_key"))


def _graph(edge: DataFrame, back: bool) -> DataFrame:
    source = F.concat_ws(":", "in_step", "in_col")
    target = F.concat_ws(":", "step", "out_col")
    return edge.select("run_id", (target if back else source).alias("source"), (source if back else target).alias("target")).distinct()


def ancestry(edge: DataFrame, step: str, column: str, max_depth: int = 50) -> DataFrame:
    """What a column comes from, in every run: (run_id, node step:column, depth)."""
    start = edge.where((F.col("step") == step) & (F.col("out_col") == column)).select("run_id", F.lit(f"{step}:{column}").alias("node"))
    return walk(_graph(edge, True), start, max_depth, ["run_id"])


def impact(edge: DataFrame, step: str, column: str, max_depth: int = 50) -> DataFrame:
    """What a column goes into, in every run."""
    start = edge.where((F.col("in_step") == step) & (F.col("in_col") == column)).select("run_id", F.lit(f"{step}:{column}").alias("node"))
    return walk(_graph(edge, False), start, max_depth, ["run_id"])


def column_pairs(results: DataFrame) -> DataFrame:
    """Lineage from step results alone: every input column with every output column of the step. results: run_id, step_name, columns_in, columns_out."""
    return results.select("run_id", "step_name", F.explode("columns_in").alias("in_col"), "columns_out").select("run_id", "step_name", "in_col", F.explode("columns_out").alias("out_col"))


def _dataset(space, name, fields):
    """An OpenLineage dataset; fields: map of a column to the (namespace, name, field) it has to do with."""
    linked = F.transform_values(fields, lambda _, v: F.struct(v.alias("inputFields")))
    return F.struct(space.alias("namespace"), name.alias("name"), F.struct(F.struct(F.lit(PRODUCER).alias("_producer"), F.lit(BASE_FACET).alias("_schemaURL"), linked.alias("fields")).alias("columnLineage")).alias("facets"))


def _namespace(name):
    file = name.startswith("file:") | name.rlike(r"\.(csv|json|parquet)$")
    topic = name.startswith("kafka://") | name.rlike("[.-]topic$")
    return F.when(file, "file").when(topic, "kafka").otherwise("pipeline")


def open_lineage(runs: DataFrame, edge: DataFrame, namespace: str = "weftline") -> DataFrame:
    """run_id, event_type and the OpenLineage run event as JSON: run and job facets, a dataset per source (step that nothing goes into) and sink with its column lineage.

    runs: run_id, name, status, completed_at and, if known, started_at, duration_ms, output_rows. Statuses: success, completed, healed (and unknown ones) are
    COMPLETE, failed FAIL, cancelled ABORT, running RUNNING, pending START. A run without edges has no datasets.
    """
    links = edge.select("run_id", "step", "in_step", "in_col", "out_col").distinct()
    sources = links.join(links.select("run_id", F.col("step").alias("in_step")).distinct(), ["run_id", "in_step"], "left_anti")
    sinks = links.join(links.select("run_id", F.col("in_step").alias("step")).distinct(), ["run_id", "step"], "left_anti")

    def datasets(rows: DataFrame, owner: str, column, label: str) -> DataFrame:
        """Per run the array of datasets: fields by column, then columns by dataset, then datasets by run."""
        used = F.struct(_namespace(F.col("in_step")).alias("namespace"), F.col("in_step").alias("name"), F.col("in_col").alias("field"))
        fields = rows.groupBy("run_id", owner, column.alias("field")).agg(F.sort_array(F.collect_set(used)).alias("of"))
        whole = fields.groupBy("run_id", owner).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "of")))).alias("fields"))
        made = whole.select("run_id", F.struct(F.col(owner).alias("k"), _dataset(_namespace(F.col(owner)), F.col(owner), F.col("fields")).alias("d")).alias("x"))
        return made.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list("x"), lambda a, b: F.when(a["k"] < b["k"], -1).otherwise(1)), lambda x: x["d"]).alias(label))

    inputs = datasets(sources, "in_step", F.concat_ws(":", "step", "out_col"), "inputs")
    outputs = datasets(sinks, "step", F.col("out_col"), "outputs")
    status = F.lower("status")
    kind = F.when(status == "failed", "FAIL").when(status == "cancelled", "ABORT").when(status == "running", "RUNNING").when(status == "pending", "START").otherwise("COMPLETE")
    known = lambda name, cast: (F.col(name) if name in runs.columns else F.lit(None)).cast(cast)
    base = (F.lit(PRODUCER).alias("_producer"), F.lit(BASE_FACET).alias("_schemaURL"))
    metrics = F.struct(*base, known("duration_ms", "long").alias("durationMs"), known("output_rows", "long").alias("outputRowCount"), known("started_at", "string").alias("startedAt"))
    job_type = F.struct(*base, F.lit("BATCH").alias("processingType"), F.lit("SPARK").alias("integration"), F.lit("PIPELINE").alias("jobType"))
    event = F.to_json(F.struct(
        kind.alias("eventType"), F.coalesce(F.col("completed_at").cast("string"), known("started_at", "string")).alias("eventTime"), F.lit(PRODUCER).alias("producer"), F.lit(SCHEMA_URL).alias("schemaURL"),
        F.struct(F.col("run_id").alias("runId"), F.struct(metrics.alias("runMetrics")).alias("facets")).alias("run"),
        F.struct(F.lit(namespace).alias("namespace"), F.col("name").alias("name"), F.struct(job_type.alias("jobType")).alias("facets")).alias("job"),
        F.coalesce("inputs", F.array()).alias("inputs"), F.coalesce("outputs", F.array()).alias("outputs"),
    ))
    return runs.join(inputs, "run_id", "left").join(outputs, "run_id", "left").select("run_id", kind.alias("event_type"), event.alias("event"))
