"""Registered queries of what steps report: saves, schema rules, profiles by name, trials, lineage events, error limits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contracts, lineage, profile, quality, udf
from ..sources import tables
from ..sources.shared import new_path
from . import pipeline
from .queries import ALL_LINEAGE, HOLED, NOW, REVENUE, RULE_SQL, RULES, add, all_lineage, holed, query, t


# --- sources and sinks ----------------------------------------------------------------------------------------------------
@query("SELECT * FROM supplier")
def src1_infer_csv(spark, sf):
    """Types inferred, then widened to those written, so that a wrong guess would lose values."""
    path, df = f"{new_path(spark, 'infer')}.csv", t(spark, sf, "supplier")
    tables.save(df, path)
    return tables.load(spark, path).select(*[F.col(c).cast(k).alias(c) for c, k in df.dtypes])


@query("SELECT * FROM nation")
def src2_load_json_array(spark, sf):
    """A file that is one array, as other tools write it: for small tables only, since one task writes and reads it."""
    path, df = f"{new_path(spark, 'array')}.json", t(spark, sf, "nation")
    df.agg(F.to_json(F.collect_list(F.struct("*")))).write.text(path)
    return tables.load(spark, path, "json", schema=df.schema, multiline=True)


@query("""SELECT 'orders' AS name, count(*) AS row_count, 6 AS column_count, 'o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority' AS columns FROM orders
UNION ALL SELECT 'customer', count(*), 5, 'c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment' FROM customer""")
def src5_file_columns(spark, sf):
    def of(name: str) -> DataFrame:
        found = tables.file_metadata(spark, f"{sf}/{name}.parquet").groupBy("column_count", F.concat_ws(",", "columns").alias("columns")).agg(F.sum("row_count").alias("row_count"))
        return found.select(F.lit(name).alias("name"), "row_count", "column_count", "columns")

    return of("orders").union(of("customer"))


def _saved(spark, df: DataFrame, kind: str):
    """df through a pipeline's save step: its path and report."""
    path = f"{new_path(spark, 'save')}.{kind}"
    made = pipeline.run([{"name": "in", "type": "load", "table": "t"}, {"name": "out", "type": "save", "input": "in", "path": path}], {"t": df})
    return path, made["out"]


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def snk1_save_unknown_extension_as_csv(spark, sf):
    df = t(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return tables.load(spark, _saved(spark, df, "txt")[0], "csv", schema=df.schema)


@query("SELECT event_id, CASE WHEN event_id % 3 > 0 THEN value END AS value FROM events")
def snk2_save_json_without_nan(spark, sf):
    """Each third value is NaN or infinite before it is saved."""
    bad = F.when(F.col("event_id") % 2 == 0, float("nan")).otherwise(float("-inf"))
    df = t(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, bad).otherwise(F.col("value")).alias("value"))
    return tables.load(spark, _saved(spark, df, "json")[0], "json", schema=df.schema)


@query("SELECT * FROM lineitem")
def snk3_save_parquet(spark, sf):
    df = t(spark, sf, "lineitem")
    return tables.load(spark, _saved(spark, df, "parquet")[0], "parquet", schema=df.schema)


@query(" UNION ALL ".join(f"SELECT '{kind}' AS extension, '{form}' AS format, count(*) AS row_count, true AS has_bytes FROM customer" for kind, form in (("csv", "csv"), ("json", "json"), ("parquet", "parquet"), ("dat", "csv"))))
def snk4_save_report(spark, sf):
    reports = {kind: _saved(spark, t(spark, sf, "customer"), kind)[1].report for kind in ("csv", "json", "parquet", "dat")}
    return spark.createDataFrame([(kind, r["format"], r["rows"], r["bytes"] > 0) for kind, r in reports.items()], "extension string, format string, row_count long, has_bytes boolean")


# --- step results and trials ----------------------------------------------------------------------------------------------
DONE = "(SELECT * FROM orders WHERE o_orderstatus = 'F')"
STEP_ROWS = {
    "orders": ("orders", "orders"), "customers": ("customer", "customer"), "nations": ("nation", "nation"), "done": ("orders", DONE), "keyed": (DONE, DONE), "who": ("customer", "customer"), "where": ("nation", "nation"),
}
JOINED = f"(SELECT * FROM {DONE} JOIN customer ON o_custkey = c_custkey)"
PLACED = f"(SELECT * FROM {JOINED} JOIN nation ON c_nationkey = n_nationkey)"
REPORT = f"(SELECT DISTINCT n_name, c_mktsegment FROM {PLACED})"
COUNT = "(SELECT count(*) FROM {})"
ROWS_SQL = {k: (COUNT.format(a), COUNT.format(b)) for k, (a, b) in STEP_ROWS.items()} | {
    "with_customer": (f"{COUNT.format(DONE)} + {COUNT.format('customer')}", COUNT.format(JOINED)), "with_nation": (f"{COUNT.format(JOINED)} + {COUNT.format('nation')}", COUNT.format(PLACED)),
    "named": (COUNT.format(PLACED), COUNT.format(PLACED)), "revenue": (COUNT.format(PLACED), COUNT.format(REPORT)), "report": (COUNT.format(REPORT), COUNT.format(REPORT)),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS step, ({a})::BIGINT AS rows_in, ({b})::BIGINT AS rows_out, true AS timed" for name, (a, b) in ROWS_SQL.items()))
def pip3_step_results(spark, sf):
    """Rows in and out of every step of the revenue report, counted while the report is made."""
    made = pipeline.run(REVENUE, {"orders": t(spark, sf, "orders"), "customer": t(spark, sf, "customer"), "nation": t(spark, sf, "nation")}, observe=True)
    made["report"].frame.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(name, r.rows_in, r.rows_out, r.seconds >= 0) for name, r in made.items()], "step string, rows_in long, rows_out long, timed boolean")


@query("SELECT 'revenue' AS plan, true AS success, 'nation,segment,o_totalprice_sum,o_orderkey_count' AS columns UNION ALL SELECT 'broken', false, ''")
def drf6_trial(spark, sf):
    held = {"orders": t(spark, sf, "orders"), "customer": t(spark, sf, "customer"), "nation": t(spark, sf, "nation")}
    broken = [*REVENUE[:-1], {**REVENUE[-1], "by": ["no_such_column"]}]
    found = {"revenue": pipeline.trial(REVENUE, held), "broken": pipeline.trial(broken, held)}
    return spark.createDataFrame([(name, r["success"], ",".join(r["columns"])) for name, r in found.items()], "plan string, success boolean, columns string")


# --- rules of schemas and roll-ups ----------------------------------------------------------------------------------------
SCHEMA_CONTRACT = {"columns": {"event_id": {"type": "string"}, "value": {"type": "float"}, "ts": {"type": "datetime"}, "amount": {}, "note": {"required": False}, "user_id": {"type": "any", "nullable": False}}}


def _broken(rule: str):
    return lambda s, d: contracts.violations(holed(s, d), SCHEMA_CONTRACT).where(F.col("rule") == rule).select("column", "rule", "severity", "actual", "expected")


add("ct1_required_columns", _broken("required"), "SELECT 'amount' AS \"column\", 'required' AS rule, 'error' AS severity, NULL::VARCHAR AS actual, 'present' AS expected")
add("ct2_type_categories", _broken("type"), "SELECT 'event_id' AS \"column\", 'type' AS rule, 'error' AS severity, 'integer' AS actual, 'string' AS expected")
add("ct11_unexpected_columns", _broken("unexpected"), "SELECT 'event_type' AS \"column\", 'unexpected' AS rule, 'warning' AS severity, 'string' AS actual, NULL::VARCHAR AS expected")


@query(f"""WITH v AS (SELECT 2 + (count(*) FILTER (user_id IS NULL) > 0)::BIGINT AS errors, 1::BIGINT AS warnings FROM {HOLED})
SELECT 'block' AS severity, errors, warnings, errors > 0 AS blocked FROM v UNION ALL SELECT 'warn', errors, warnings, false FROM v""")
def ct13_breach(spark, sf):
    found = contracts.violations(holed(spark, sf), SCHEMA_CONTRACT).persist()
    rows = [(severity, *contracts.breach(found, severity).values()) for severity in ("block", "warn")]
    found.unpersist()
    return spark.createDataFrame(rows, "severity string, errors long, warnings long, blocked boolean")


ROLL_UP = {kind: " + ".join(f"(({sql}) > 0)::BIGINT" for rule, sql in zip(RULES, RULE_SQL) if rule.get("severity", "error") == kind) for kind in ("error", "warning")}


@query(f"SELECT ({ROLL_UP['error']}) = 0 AS passed, ({ROLL_UP['error']})::BIGINT AS errors, ({ROLL_UP['warning']})::BIGINT AS warnings FROM {HOLED}")
def dq14_verdict(spark, sf):
    found = quality.verdict(quality.validate(holed(spark, sf), RULES))
    return spark.createDataFrame([tuple(found.values())], "passed boolean, errors long, warnings long")


# --- user functions -------------------------------------------------------------------------------------------------------
@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity % 17 <> 0 THEN round(1.0 / (l_quantity % 17), 6) END AS inverse FROM lineitem")
def udf2_error_limit(spark, sf):
    """A scalar function that fails where the remainder is 0: few enough rows to pass."""
    made = udf.compute(t(spark, sf, "lineitem"), lambda q: 1.0 / math.fmod(q, 17.0), ["l_quantity"], "inverse")
    return udf.checked(made).select("l_orderkey", "l_linenumber", F.round("inverse", 6).alias("inverse"))


# --- semantic profiles ----------------------------------------------------------------------------------------------------
KINDS = {"customer": {"c_custkey": "whole", "c_name": "text", "c_nationkey": "whole", "c_acctbal": "number", "c_mktsegment": "text"}, "events": {"event_id": "whole", "ts": "moment", "user_id": "whole", "event_type": "text", "value": "number", "props": "text"}}


def _type_sql(table: str, source: str, c: str, kind: str) -> str:
    """Type and flags of one column; name hints and patterns are those of profile."""
    hint = lambda words: "(" + " OR ".join(f"contains(lower('{c}'), '{w}')" for w in words) + ")"
    named = lambda of: hint(profile.NAME_HINTS[of])
    above = lambda of: f"avg(regexp_matches({c}, '{profile.PATTERNS[of][0]}')::INT) > {profile.PATTERNS[of][1]}"
    unique, n, d, null = f"count(DISTINCT {c}) / count(*)", f"count({c})", f"count(DISTINCT {c})", f"1 - count({c}) / count(*)"
    if kind == "moment":
        made = "'datetime'"
    elif kind in ("whole", "number"):
        made = f"CASE WHEN {n} > 0 AND {kind == 'whole'} AND {unique} > 0.9 AND {named('integer_id')} THEN 'integer_id' WHEN {n} > 0 AND {named('currency')} THEN 'currency' ELSE 'numeric' END"
    else:
        either = lambda of: f"WHEN {named(of)} OR {above(of)} THEN '{of}'"
        made = f"""CASE WHEN {n} = 0 THEN 'text' WHEN bool_and(lower({c}) IN {profile.BOOLEAN_WORDS}) THEN 'boolean' {either('email')} {either('phone')} {either('url')}
WHEN {named('datetime')} AND bool_and(try_cast({c} AS TIMESTAMP) IS NOT NULL) THEN 'datetime' {either('identifier')} WHEN {unique} < 0.05 THEN 'categorical' ELSE 'text' END"""
    share = lambda of: f"coalesce({above(of)}, false)" if kind == "text" else "false"
    flags = {flag: hint(words) for flag, words in profile.FLAG_HINTS.items()} | {
        "likely_boolean": f"{d} <= 2", "likely_email": share("likely_email"), "likely_phone": share("phone"),
        "high_cardinality": f"{unique} > 0.9", "low_cardinality": f"{unique} < 0.01 AND {d} > 1", "high_null_rate": f"{null} > 0.2", "constant": f"{d} = 1",
    }
    shown = ", ".join(f"CASE WHEN {x} THEN '{flag}' END" for flag, x in flags.items())
    return f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", {made} AS semantic_type, concat_ws(',', {shown}) AS flags FROM {source}"


SEMANTIC_SQL = " UNION ALL ".join(_type_sql(table, HOLED.replace("AS value FROM", "AS value, props FROM") if table == "events" else table, c, kind) for table, columns in KINDS.items() for c, kind in columns.items())


def semantic_profiles(s, d):
    events = holed(s, d).join(t(s, d, "events").select("event_id", "props"), "event_id")
    both = [profile.semantic_types(df).select(F.lit(name).alias("table"), "column", "semantic_type", F.concat_ws(",", "flags").alias("flags")) for name, df in (("customer", t(s, d, "customer")), ("events", events))]
    return both[0].union(both[1])


add("prf8_semantic_types_of_tables", lambda s, d: semantic_profiles(s, d).drop("flags"), f"SELECT * EXCLUDE (flags) FROM ({SEMANTIC_SQL})")
add("prf9_semantic_flags", lambda s, d: semantic_profiles(s, d).drop("semantic_type"), f"SELECT * EXCLUDE (semantic_type) FROM ({SEMANTIC_SQL})")


@query(f"SELECT \"column\" FROM ({SEMANTIC_SQL}) WHERE \"table\" = 'customer' AND contains(flags, 'likely_pii')")
def prf12_pii_columns(spark, sf):
    return spark.createDataFrame([(c,) for c in profile.pii_columns(profile.semantic_types(t(spark, sf, "customer")))], "column string")


# --- lineage events -------------------------------------------------------------------------------------------------------
STATUSES = {"completed": "COMPLETE", "healed": "COMPLETE", "failed": "FAIL", "running": "RUNNING", "pending": "START"}


@query(f"""WITH e AS {ALL_LINEAGE}, i AS (SELECT a.run_id, a.in_step AS name, count(DISTINCT (step, out_col)) AS n FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.run_id = a.run_id AND b.step = a.in_step) GROUP BY 1, 2),
o AS (SELECT a.run_id, a.step AS name, count(DISTINCT out_col) AS n FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.run_id = a.run_id AND b.in_step = a.step) GROUP BY 1, 2), r AS (SELECT DISTINCT run_id, ['COMPLETE', 'COMPLETE', 'FAIL', 'RUNNING', 'START'][run_id::BIGINT % 5 + 1] AS event_type FROM e),
x AS (SELECT run_id, string_agg(name || ':' || n, ',' ORDER BY name) AS inputs FROM i GROUP BY 1), y AS (SELECT run_id, string_agg(name || ':' || n, ',' ORDER BY name) AS outputs FROM o GROUP BY 1)
SELECT run_id, event_type, event_type AS event_type_inside, 'p' || run_id AS job, '{NOW}' AS event_time, coalesce(inputs, '') AS inputs, coalesce(outputs, '') AS outputs FROM r LEFT JOIN x USING (run_id) LEFT JOIN y USING (run_id)""")
def lin5_event_parts(spark, sf):
    """What the events of all runs say: each dataset with the number of its linked columns."""
    edge = all_lineage(spark, sf)
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("run_id").cast("long") % 5 + 1).cast("int"))
    runs = edge.select("run_id").distinct().select("run_id", F.concat(F.lit("p"), "run_id").alias("name"), status.alias("status"), F.lit(NOW).alias("completed_at"))
    dataset = "array<struct<name: string, facets: struct<columnLineage: struct<fields: map<string, array<string>>>>>>"
    dataset = dataset.replace("map<string, array<string>>", "map<string, struct<inputFields: array<struct<field: string>>>>")
    said = F.from_json("event", f"eventType string, eventTime string, job struct<name: string>, inputs {dataset}, outputs {dataset}")
    shown = lambda side: F.concat_ws(",", F.transform(F.col(f"e.{side}"), lambda x: F.concat(x["name"], F.lit(":"), F.size(x["facets"]["columnLineage"]["fields"]))))
    return lineage.open_lineage(runs, edge).withColumn("e", said).select("run_id", "event_type", F.col("e.eventType").alias("event_type_inside"), F.col("e.job.name").alias("job"), F.col("e.eventTime").alias("event_time"), shown("inputs").alias("inputs"), shown("outputs").alias("outputs"))
