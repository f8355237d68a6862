"""Registered queries of the tabular operators and their DuckDB twins, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.masks import apply_policies
from ..operators import catalog, contracts, drift, lineage, profile, quality, reshape, runs, sqlstep, transform, udf
from ..sources import tables
from ..sources.shared import new_path
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def add(name: str, f: Query, sql: str) -> None:
    QUERIES[name], SQL[name] = f, sql


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return tables.load(spark, f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Sums of doubles depend on their order beyond some digits; decimals are exact and shown as doubles."""
    return df.select(*[F.round(F.col(f"`{c}`").cast("double"), digits).alias(c) if k == "double" or k.startswith("decimal") else F.col(f"`{c}`") for c, k in df.dtypes])


def exact(df: DataFrame, *columns: str) -> DataFrame:
    """df with money in cents as decimals, whose sums don't depend on their order."""
    return df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in columns})


# --- sources ------------------------------------------------------------------------------------------------------------
def _through(spark, sf, table, kind):
    path = f"{new_path(spark, f'roundtrip-{table}')}.{kind}"
    df = t(spark, sf, table)
    tables.save(df, path)
    return tables.load(spark, path, kind, schema=df.schema)


@query("SELECT * FROM supplier")
def src1_load_csv(spark, sf):
    return _through(spark, sf, "supplier", "csv")


@query("SELECT * FROM customer")
def src2_load_json(spark, sf):
    return _through(spark, sf, "customer", "json")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def src3_load_parquet(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


POLICIES = [
    {"column": "c_acctbal", "action": "redact", "allowed_roles": ["admin"]}, {"column": "c_name", "action": "mask", "mask": "name"}, {"column": "c_mktsegment", "action": "mask", "mask": "custom:2"},
]


@query("SELECT c_custkey, CASE WHEN c_name IS NULL OR c_name = '' THEN c_name ELSE left(c_name, 1) || '***' END AS c_name, c_nationkey, CASE WHEN c_mktsegment IS NULL OR c_mktsegment = '' THEN c_mktsegment ELSE left(c_mktsegment, 2) || '***' END AS c_mktsegment FROM customer")
def src4_load_with_policies(spark, sf):
    return tables.load(spark, f"{sf}/customer.parquet", role="analyst", policies=POLICIES)


@query("SELECT 'orders' AS name, count(*) AS row_count FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def src5_file_metadata(spark, sf):
    names = ("orders", "customer")
    made = [tables.file_metadata(spark, f"{sf}/{n}.parquet").groupBy().agg(F.sum("row_count").alias("row_count")).select(F.lit(n).alias("name"), "row_count") for n in names]
    return made[0].union(made[1])


@query()
def src6_preview(spark, sf):
    return tables.preview(t(spark, sf, "customer"), 20, "analyst", POLICIES)


# --- projection -----------------------------------------------------------------------------------------------------------
add("prj1_select", lambda s, d: transform.select(t(s, d, "part"), ["p_partkey", "p_name"]), "SELECT p_partkey, p_name FROM part")
add("prj2_select_exclude", lambda s, d: transform.select(t(s, d, "part"), ["p_name", "p_brand"], "drop"), "SELECT * EXCLUDE (p_name, p_brand) FROM part")
add("prj3_rename", lambda s, d: transform.rename(t(s, d, "nation"), {"n_name": "nation", "n_nationkey": "id"}), "SELECT * RENAME (n_name AS nation, n_nationkey AS id) FROM nation")
add("prj4_transform", lambda s, d: transform.transform(t(s, d, "lineitem"), "l_quantity * 2 AS twice, upper(l_returnflag) AS flag").select("l_orderkey", "l_linenumber", "twice", "flag"), "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, upper(l_returnflag) AS flag FROM lineitem")

# --- filters ---------------------------------------------------------------------------------------------------------------
for n, (op, column, value, table, where) in enumerate((
    ("equals", "o_orderstatus", "F", "orders", "o_orderstatus = 'F'"), ("not_equals", "o_orderstatus", "F", "orders", "o_orderstatus <> 'F'"), ("greater_than", "l_quantity", "30", "lineitem", "l_quantity > 30"),
    ("less_than", "l_shipdate", "1996-01-01", "lineitem", "l_shipdate < TIMESTAMP '1996-01-01'"), ("gte", "p_size", 25, "part", "p_size >= 25"), ("lte", "p_size", 25, "part", "p_size <= 25"), ("contains", "p_name", "a", "part", "contains(p_name, 'a')"),
    ("not_contains", "p_name", "a", "part", "NOT contains(p_name, 'a')"), ("starts_with", "c_name", "Customer#0000001", "customer", "starts_with(c_name, 'Customer#0000001')"), ("ends_with", "c_name", "7", "customer", "ends_with(c_name, '7')"),
), 1):
    add(f"flt{n}_{op}", lambda s, d, a=(table, column, op, value): transform.filter(t(s, d, a[0]), *a[1:]), f"SELECT * FROM {table} WHERE {where}")


def holed(spark, sf) -> DataFrame:
    """events with nulls: value below 20 and every page view's user."""
    e = t(spark, sf, "events")
    return e.select("event_id", "ts", F.expr("CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id"), F.expr("nullif(event_type, 'click') AS event_type"), F.expr("CASE WHEN value >= 20 THEN value END AS value"))


HOLED = "(SELECT event_id, ts, CASE WHEN event_id % 7 <> 0 THEN user_id END AS user_id, nullif(event_type, 'click') AS event_type, CASE WHEN value >= 20 THEN value END AS value FROM events)"
add("flt11_is_null", lambda s, d: transform.filter(holed(s, d), "value", "is_null"), f"SELECT * FROM {HOLED} WHERE value IS NULL")
add("flt12_is_not_null", lambda s, d: transform.filter(holed(s, d), "value", "is_not_null"), f"SELECT * FROM {HOLED} WHERE value IS NOT NULL")


# --- joins ------------------------------------------------------------------------------------------------------------------
def _sides(s, d):
    left = t(s, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderstatus").alias("name"))
    right = t(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    return left, right


for n, how in enumerate(("inner", "left", "right", "outer"), 1):
    add(f"jn{n}_{how}_join", lambda s, d, how=how: transform.join(*_sides(s, d), "id", how),
        f"SELECT coalesce(l.id, r.id) AS id, o_orderkey, l.name AS name_left, r.name AS name_right, c_acctbal FROM (SELECT o_custkey AS id, o_orderkey, o_orderstatus AS name FROM orders) l {'FULL OUTER' if how == 'outer' else how} JOIN (SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer) r ON l.id = r.id")


def _all_sides(s, d):
    """All orders and all customers; the customers' keys are shifted by 100, so that either side has keys that the other lacks."""
    left = t(s, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_orderstatus").alias("name"))
    right = t(s, d, "customer").select((F.col("c_custkey") + 100).alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    return left, right


for n, how in enumerate(("inner", "left", "right", "outer"), 1):
    add(f"jn{n}_{how}_join_all_rows", lambda s, d, how=how: transform.join(*_all_sides(s, d), "id", how),
        f"SELECT coalesce(l.id, r.id) AS id, o_orderkey, l.name AS name_left, r.name AS name_right, c_acctbal FROM (SELECT o_custkey AS id, o_orderkey, o_orderstatus AS name FROM orders) l {'FULL OUTER' if how == 'outer' else how} JOIN (SELECT c_custkey + 100 AS id, c_name AS name, c_acctbal FROM customer) r ON l.id = r.id")
add("jn5_null_safe_join", lambda s, d: transform.join(holed(s, d).groupBy("user_id").agg(F.count("*").alias("n")), holed(s, d).groupBy("user_id").agg(F.max("value").alias("v")), "user_id", "inner", null_safe=True),
    f"WITH h AS {HOLED} SELECT a.user_id, n, v FROM (SELECT user_id, count(*) AS n FROM h GROUP BY 1) a JOIN (SELECT user_id, max(value) AS v FROM h GROUP BY 1) b ON a.user_id IS NOT DISTINCT FROM b.user_id")

# --- aggregations -------------------------------------------------------------------------------------------------------------
AGGS = {
    "sum": "sum(l_extendedprice)", "mean": "avg(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "count": "count(l_extendedprice)", "median": "median(l_extendedprice)", "std": "stddev_samp(l_extendedprice)", "var": "var_samp(l_extendedprice)",
    "first": "arg_min(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice))", "last": "arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice))", "count_distinct": "count(DISTINCT l_extendedprice)", "p50": "quantile_cont(l_extendedprice, 0.5)", "p95": "quantile_cont(l_extendedprice, 0.95)",
}
for n, (f, sql) in enumerate(AGGS.items(), 1):
    digits = 0 if f == "var" else 4 if f in ("median", "p50") else 2
    add(f"agg{n}_{f}", lambda s, d, f=f, digits=digits: rounded(transform.aggregate(t(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"l_extendedprice": f}, order_by=["l_orderkey", "l_linenumber"]), digits),
        f"SELECT l_returnflag, l_linestatus, {sql if f in ('count', 'count_distinct') else f'round({sql}, {digits})'} AS l_extendedprice_{f} FROM lineitem GROUP BY ALL")
add("agg11_mode", lambda s, d: transform.aggregate(holed(s, d), ["event_type"], {"user_id": "mode"}),
    f"SELECT event_type, user_id AS user_id_mode FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY count(*) DESC, user_id) AS k FROM {HOLED} WHERE user_id IS NOT NULL GROUP BY 1, 2) WHERE k = 1")
add("agg14_alias", lambda s, d: transform.aggregate(holed(s, d), ["event_type"], [{"column": "value", "function": "count", "alias": "n"}, {"column": "event_id", "function": "max"}]), f"SELECT event_type, count(value) AS n, max(event_id) AS event_id_max FROM {HOLED} GROUP BY 1")
add("agg12_many_distinct", lambda s, d: transform.aggregate(holed(s, d), ["event_type"], [{"column": c, "function": "count_distinct"} for c in ("user_id", "value", "ts")] + [{"column": "event_id", "function": "max"}]),
    f"SELECT event_type, count(DISTINCT user_id) AS user_id_count_distinct, count(DISTINCT value) AS value_count_distinct, count(DISTINCT ts) AS ts_count_distinct, max(event_id) AS event_id_max FROM {HOLED} GROUP BY 1")
add("agg6_global_ranks", lambda s, d: rounded(transform.aggregate(t(s, d, "lineitem"), [], [{"column": c, "function": f} for c in ("l_extendedprice", "l_suppkey") for f in ("median", "p95", "mode", "count_distinct", "min")])),
    "SELECT " + ", ".join(f"{'count(DISTINCT ' + c + ')' if f == 'count_distinct' else f'round({made}::DOUBLE, 4)' if c == 'l_extendedprice' or f in ('median', 'p95') else made} AS {c}_{f}" for c in ("l_extendedprice", "l_suppkey") for f, made in (
        ("median", f"median({c})"), ("p95", f"quantile_cont({c}, 0.95)"), ("mode", f"(SELECT arg_min(v, (-n, v)) FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1))"), ("count_distinct", ""), ("min", f"min({c})"))) + " FROM lineitem")
add("agg15_global", lambda s, d: rounded(transform.aggregate(exact(t(s, d, "orders"), "o_totalprice"), [], {"o_totalprice": "sum", "o_orderkey": "count"}), 2), "SELECT round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS o_totalprice_sum, count(o_orderkey) AS o_orderkey_count FROM orders")

# --- sort and samples ---------------------------------------------------------------------------------------------------------
add("srt1_sort", lambda s, d: transform.sort(holed(s, d), "value", "desc"), f"SELECT * FROM {HOLED} ORDER BY value DESC NULLS LAST")
add("srt2_sort_many", lambda s, d: transform.sort(t(s, d, "orders"), ["o_orderstatus", "o_totalprice"], ascending=[True, False]), "SELECT * FROM orders ORDER BY o_orderstatus, o_totalprice DESC")
add("srt3_top_k", lambda s, d: transform.top_k(t(s, d, "orders"), ["o_totalprice", "o_orderkey"], 25), "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 25")
HASH = "md5('42|' || o_orderkey::VARCHAR)"
add("smp1_sample_n", lambda s, d: transform.sample(t(s, d, "orders"), n=100, by=["o_orderkey"]), f"SELECT * FROM orders ORDER BY {HASH} LIMIT 100")
add("smp2_sample_fraction", lambda s, d: transform.sample(t(s, d, "orders"), fraction=0.1, by=["o_orderkey"]), f"SELECT * FROM orders WHERE ('0x' || left({HASH}, 8))::BIGINT < floor(0.1 * 4294967296)")
add("smp3_sample_stratified", lambda s, d: transform.sample(t(s, d, "orders"), n=200, stratify_by="o_orderpriority", by=["o_orderkey"]),
    f"SELECT * EXCLUDE (k, q) FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY {HASH}) AS k, greatest(1, count(*) OVER (PARTITION BY o_orderpriority) * 200 // (SELECT count(*) FROM orders)) AS q FROM orders) WHERE k <= q")

# --- reshape ------------------------------------------------------------------------------------------------------------------
add("pvt1_pivot", lambda s, d: rounded(reshape.pivot(t(s, d, "lineitem"), ["l_returnflag"], "l_linestatus", "l_quantity", pivot_values=["F", "O"]), 2),
    "SELECT l_returnflag, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0), 2) AS F, round(coalesce(sum(l_quantity) FILTER (l_linestatus = 'O'), 0), 2) AS O FROM lineitem GROUP BY 1")
for f, sql in (("mean", "avg(value)"), ("count", "count(value)"), ("min", "min(value)"), ("max", "max(value)"), ("first", "arg_min(value, event_id) FILTER (value IS NOT NULL)")):
    cell = lambda v, sql=sql, f=f: (f"arg_min(value, event_id) FILTER (value IS NOT NULL AND event_type = '{v}')" if f == "first" else f"{sql} FILTER (event_type = '{v}')")
    add(f"pvt2_pivot_{f}", lambda s, d, f=f: rounded(reshape.pivot(holed(s, d).withColumn("event_type", F.coalesce("event_type", F.lit("none"))), "user_id", "event_type", "value", f, fill_value=-1, pivot_values=["none", "view"], order_by=["event_id"]), 8),
        f"SELECT user_id, {', '.join(f'round(coalesce({cell(v)}, -1), 8) AS {v}' if f != 'count' else f'{cell(v)} AS {v}' for v in ('none', 'view'))} FROM (SELECT * REPLACE (coalesce(event_type, 'none') AS event_type) FROM {HOLED}) WHERE user_id IS NOT NULL GROUP BY 1")
SQL["pvt2_pivot_count"] = SQL["pvt2_pivot_count"].replace("count(value) FILTER (event_type = 'none')", "coalesce(nullif(count(*) FILTER (event_type = 'none'), 0) * 0 + count(value) FILTER (event_type = 'none'), -1)").replace("count(value) FILTER (event_type = 'view')", "coalesce(nullif(count(*) FILTER (event_type = 'view'), 0) * 0 + count(value) FILTER (event_type = 'view'), -1)")
add("pvt3_pivot_two_keys", lambda s, d: reshape.pivot(t(s, d, "orders"), ["o_orderpriority", "o_custkey"], "o_orderstatus", "o_orderkey", "max", 0, ["F", "O", "P"]),
    "SELECT o_orderpriority, o_custkey, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'F'), 0) AS F, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'O'), 0) AS O, coalesce(max(o_orderkey) FILTER (o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1, 2")
add("upv1_unpivot", lambda s, d: reshape.unpivot(t(s, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "amount"),
    "SELECT l_orderkey, l_linenumber, unnest(['l_quantity', 'l_discount', 'l_tax']) AS measure, unnest([l_quantity, l_discount, l_tax]) AS amount FROM lineitem")
for n, (keep, where) in enumerate((("first", "event_id = lo"), ("last", "event_id = hi"), ("none", "n = 1")), 1):
    keys = ["user_id", "value"] if keep == "none" else ["user_id", "event_type"]
    add(f"dup{n}_dedup_{keep}", lambda s, d, keep=keep, keys=keys: reshape.deduplicate(holed(s, d), keys, keep, ["event_id"]),
        f"SELECT event_id, ts, user_id, event_type, value FROM (SELECT *, min(event_id) OVER w AS lo, max(event_id) OVER w AS hi, count(*) OVER w AS n FROM {HOLED} WINDOW w AS (PARTITION BY {', '.join(keys)})) WHERE {where}")
add("dup4_distinct", lambda s, d: reshape.deduplicate(holed(s, d).select("user_id", "event_type")), f"SELECT DISTINCT user_id, event_type FROM {HOLED}")
add("nul1_fill_constant", lambda s, d: reshape.fill_nulls(holed(s, d), ["value"], "constant", -1.0), f"SELECT * REPLACE (coalesce(value, -1.0) AS value) FROM {HOLED}")
add("nul2_forward_fill", lambda s, d: reshape.fill_nulls(holed(s, d), ["value"], "ffill", order_by=["ts", "event_id"]), f"SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value) FROM {HOLED}")
add("nul2_forward_fill_by_key", lambda s, d: reshape.fill_nulls(holed(s, d), ["value"], "forward_fill", order_by=["ts", "event_id"], partition_by=["user_id"]), f"SELECT * REPLACE (last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value) FROM {HOLED}")
add("nul3_backward_fill", lambda s, d: reshape.fill_nulls(holed(s, d), ["value"], "bfill", order_by=["ts", "event_id"]), f"SELECT * REPLACE (first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value) FROM {HOLED}")
for n, (f, sql) in enumerate((("mean", "avg(value)"), ("median", "median(value)"), ("mode", "arg_min(value, (-n, value))")), 4):
    source = f"(SELECT value, count(*) AS n FROM {HOLED} WHERE value IS NOT NULL GROUP BY 1)" if f == "mode" else HOLED
    add(f"nul{n}_fill_{f}", lambda s, d, f=f: rounded(reshape.fill_nulls(holed(s, d), ["value"], f)), f"SELECT * REPLACE (round(coalesce(value, (SELECT {sql} FROM {source})), 4) AS value) FROM {HOLED}")

# --- quality and contracts ------------------------------------------------------------------------------------------------------
RULES = [
    {"check": "not_null", "column": "user_id"}, {"check": "not_empty", "column": "event_type"}, {"check": "greater_than", "column": "value", "value": 30}, {"check": "less_than", "column": "value", "value": 60}, {"check": "between", "column": "value", "min": 25, "max": 90},
    {"check": "in_values", "column": "event_type", "values": ["view", "purchase"]}, {"check": "matches_pattern", "column": "event_type", "pattern": "v|p"}, {"check": "no_duplicates", "column": "user_id"}, {"check": "min_rows", "value": 100000000}, {"check": "max_rows", "value": 10},
    {"check": "positive", "column": "value", "severity": "warning"}, {"check": "date_format", "column": "event_type", "format": "%Y-%m-%d"},
]
RULE_SQL = (
    "count(*) FILTER (user_id IS NULL)", "count(*) FILTER (trim(event_type) = '')", "count(*) FILTER (value <= 30)", "count(*) FILTER (value >= 60)", "count(*) FILTER (value < 25 OR value > 90)",
    "count(*) FILTER (NOT coalesce(event_type IN ('view', 'purchase'), false))", "count(*) FILTER (NOT coalesce(regexp_matches(event_type, '^(?:v|p)'), false))", "count(*) - count(DISTINCT user_id) - max((user_id IS NULL)::INT)", "greatest(0, 100000000 - count(*))", "greatest(0, count(*) - 10)",
    "count(*) FILTER (value <= 0)", "count(*) FILTER (event_type IS NOT NULL AND try_strptime(event_type, '%Y-%m-%d') IS NULL)",
)
for n, (rule, sql) in enumerate(zip(RULES, RULE_SQL), 1):
    add(f"dq{n}_{rule['check']}", lambda s, d, rule=rule: quality.validate(holed(s, d), [rule]).select("check", "passed", "failing", "total"),
        f"SELECT '{rule['check']}' AS \"check\", ({sql}) = 0 AS passed, ({sql})::BIGINT AS failing, count(*) AS total FROM {HOLED}")
CONTRACT = {
    "columns": {"user_id": {"nullable": False, "unique": True, "min_value": 50, "max_value": 100}, "event_type": {"allowed_values": ["view"], "pattern": "v.*"}}, "null_thresholds": {"value": 5}, "min_rows": 100000000, "max_rows": 10, "allow_extra": True,
}
CONTRACT_SQL = {
    "ct3_not_null": ("not_null", "count(*) FILTER (user_id IS NULL)"), "ct4_unique": ("unique", "count(user_id) - count(DISTINCT user_id)"), "ct5_min_value": ("min_value", "count(*) FILTER (user_id < 50)"), "ct6_max_value": ("max_value", "count(*) FILTER (user_id > 100)"),
    "ct7_allowed_values": ("allowed_values", "count(*) FILTER (event_type NOT IN ('view'))"), "ct9_min_rows": ("min_rows", "count(*)"), "ct10_max_rows": ("max_rows", "count(*)"), "ct12_pattern": ("pattern", "count(*) FILTER (NOT regexp_full_match(event_type, 'v.*'))"),
}
for name, (rule, sql) in CONTRACT_SQL.items():
    add(name, lambda s, d, rule=rule: contracts.violations(holed(s, d), CONTRACT).where(F.col("rule") == rule).select("rule", F.col("actual").cast("double").alias("actual")), f"SELECT '{rule}' AS rule, ({sql})::DOUBLE AS actual FROM {HOLED} HAVING ({sql}) > 0")
add("ct8_null_rate", lambda s, d: contracts.violations(holed(s, d), CONTRACT).where("rule = 'null_rate'").select("rule", "column", "actual", "expected"), f"SELECT 'null_rate' AS rule, 'value' AS \"column\", format('{{:g}}', 100.0::DOUBLE * count(*) FILTER (value IS NULL) / count(*)) AS actual, '<= 5 %' AS expected FROM {HOLED} HAVING 100.0 * count(*) FILTER (value IS NULL) / count(*) > 5")

# --- SQL step -------------------------------------------------------------------------------------------------------------------
SQL_STEPS = {
    "sql1_windows": ("orders", "SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k, round(avg(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS m FROM {{input}}"),
    "sql2_top_per_group": ("orders", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM {{input}}) SELECT o_orderkey, o_orderpriority, k FROM r WHERE k <= 3"),
    "sql3_cte": ("part", "WITH b AS (SELECT p_brand, count(*) AS n FROM {{input}} GROUP BY p_brand) SELECT p_brand, n FROM b WHERE n > 2"),
    "sql7_aggregate_then_window": ("orders", "SELECT o_custkey, sum(o_orderkey) AS s, rank() OVER (ORDER BY sum(o_orderkey) DESC) AS r FROM {{input}} GROUP BY o_custkey"),
    "sql8_projection_filter": ("lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM {{input}} WHERE l_quantity > 40"),
    "sql9_grouping_sets": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {{input}} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())"),
    "sql9_cube": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {{input}} GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "sql9_rollup": ("orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {{input}} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "sql9_set_operations": ("orders", "SELECT o_custkey FROM {{input}} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {{input}} WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM {{input}} WHERE o_orderstatus = 'P'"),
    "sql9_subquery": ("orders", "SELECT o_orderkey FROM {{input}} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {{input}}) AND o_custkey IN (SELECT o_custkey FROM {{input}} WHERE o_orderstatus = 'P')"),
    "sql10_scalars": ("part", "SELECT p_partkey, upper(p_name) AS u, length(p_name) AS l, substring(p_brand, 1, 5) AS b, abs(p_size - 25) AS a, floor(p_retailprice / 10) * 1.0 AS f, coalesce(nullif(p_size, 10), 0) AS z, concat(p_brand, '-', p_type) AS c FROM {{input}}"),
}
for name, (table, text) in SQL_STEPS.items():
    add(name, lambda s, d, a=(table, text): sqlstep.sql(a[1], input=t(s, d, a[0])), text.replace("{{input}}", table))
SQL["sql10_scalars"] = SQL["sql10_scalars"].replace("floor(p_retailprice / 10) * 1.0", "(floor(p_retailprice / 10) * 1.0)::DECIMAL(20,1)")
QUERIES["sql10_scalars"] = lambda s, d: sqlstep.sql(SQL_STEPS["sql10_scalars"][1].replace("floor(p_retailprice / 10) * 1.0", "cast(floor(p_retailprice / 10) AS double)"), input=t(s, d, "part"))
SQL["sql10_scalars"] = SQL["sql10_scalars"].replace("(floor(p_retailprice / 10) * 1.0)::DECIMAL(20,1)", "floor(p_retailprice / 10)::DOUBLE")
add("sql9_recursive", lambda s, d: sqlstep.sql("WITH RECURSIVE r(k, hop) AS (SELECT n_nationkey, 0 FROM {{nations}} UNION ALL SELECT k - n_regionkey - 1, hop + 1 FROM r JOIN {{nations}} ON n_nationkey = k WHERE k > n_regionkey) SELECT k, hop, count(*) AS customers FROM r JOIN {{customers}} ON c_nationkey = k GROUP BY k, hop", nations=t(s, d, "nation"), customers=t(s, d, "customer")),
    "WITH RECURSIVE r(k, hop) AS (SELECT n_nationkey, 0 FROM nation UNION ALL SELECT k - n_regionkey - 1, hop + 1 FROM r JOIN nation ON n_nationkey = k WHERE k > n_regionkey) SELECT k, hop, count(*) AS customers FROM r JOIN customer ON c_nationkey = k GROUP BY k, hop")
add("sql10_dates", lambda s, d: sqlstep.sql("SELECT event_id, date_trunc('MONTH', ts) AS month, year(ts) AS y, dayofweek(ts) AS dow, datediff(ts, TIMESTAMP '2024-01-01') AS days, date_format(ts, 'yyyy-MM-dd HH:mm') AS shown, ts + INTERVAL 36 HOURS AS later FROM {{input}}", input=t(s, d, "events")),
    "SELECT event_id, date_trunc('month', ts) AS month, year(ts)::INT AS y, (dayofweek(ts) + 1)::INT AS dow, date_diff('day', TIMESTAMP '2024-01-01', ts)::INT AS days, strftime(ts, '%Y-%m-%d %H:%M') AS shown, ts + INTERVAL 36 HOURS AS later FROM events")
add("sql10_arrays_maps_json", lambda s, d: sqlstep.sql("""SELECT event_id, array_max(array(user_id, event_id % 100)) AS top, array_join(array_sort(array(event_type, 'm')), '-') AS joined, size(filter(array(user_id, event_id, 7), x -> x % 2 = 1)) AS odd,
      element_at(map('a', user_id, 'b', event_id), 'b') AS picked, get_json_object(to_json(struct(user_id AS u, event_type AS e)), '$.e') AS e, size(split(event_type, 'e')) AS pieces FROM {{input}}""", input=t(s, d, "events")),
    """SELECT event_id, greatest(user_id, event_id % 100) AS top, array_to_string(list_sort([event_type, 'm']), '-') AS joined, len(list_filter([user_id, event_id, 7], lambda x: x % 2 = 1))::INT AS odd, map {'a': user_id, 'b': event_id}['b'] AS picked,
      json_extract_string(to_json({'u': user_id, 'e': event_type}), '$.e') AS e, len(string_split(event_type, 'e'))::INT AS pieces FROM events""")  # fmt: skip
add("sql4_pivot_clause", lambda s, d: sqlstep.sql("SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM {{input}}) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o))", input=t(s, d, "orders")).na.fill(0),
    "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY 1")
add("sql4_unpivot_clause", lambda s, d: sqlstep.sql("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM {{input}}) UNPIVOT INCLUDE NULLS (v FOR m IN (l_tax, l_discount))", input=t(s, d, "lineitem")),
    "SELECT l_orderkey, l_linenumber, unnest(['l_tax', 'l_discount']) AS m, unnest([l_tax, l_discount]) AS v FROM lineitem")
add("sql5_lateral", lambda s, d: sqlstep.sql("SELECT n_name, x.c FROM {{input}} LEFT JOIN LATERAL (SELECT count(*) AS c FROM {{customers}} WHERE c_nationkey = n_nationkey) x ON true", input=t(s, d, "nation"), customers=t(s, d, "customer")),
    "SELECT n_name, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c FROM nation")
add("sql6_cross_join", lambda s, d: sqlstep.sql("SELECT a.n_name, b.r_name FROM {{input}} a CROSS JOIN (SELECT * FROM {{regions}} ORDER BY r_regionkey LIMIT 2) b", input=t(s, d, "nation"), regions=t(s, d, "region")),
    "SELECT a.n_name, b.r_name FROM nation a CROSS JOIN (SELECT * FROM region ORDER BY r_regionkey LIMIT 2) b")

# --- user function ------------------------------------------------------------------------------------------------------------------
add("udf1_compute", lambda s, d: udf.compute(t(s, d, "lineitem"), lambda price, cut: price * (1 - cut), ["l_extendedprice", "l_discount"], "net").select("l_orderkey", "l_linenumber", F.round("net", 4).alias("net")), "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")

# --- profile ------------------------------------------------------------------------------------------------------------------------
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value")
add("prf1_counts", lambda s, d: profile.counts(holed(s, d)),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) FILTER ({c} IS NULL) AS null_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS unique_count FROM {HOLED}" for c in EVENT_COLUMNS))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) FILTER ({c} IS NULL) AS null_count, true AS near FROM {HOLED}" for c in EVENT_COLUMNS))
def prf1_sketches(s, d):
    """Sketches of odd and even days and of rows without a time, merged; near: the estimate is within five standard errors (0.81 %) of the exact count, or one."""
    rows = holed(s, d)
    parts = [profile.sketches(rows.where(part)) for part in ("day(ts) % 2 = 0", "day(ts) % 2 = 1", "ts IS NULL")]
    merged = profile.sketch_counts(profile.merged_sketches(parts[0].unionAll(parts[1]).unionAll(parts[2])))
    both = merged.join(profile.counts(rows).select("column", F.col("unique_count").alias("exact")), "column")
    return both.select("column", "total", "null_count", (F.abs(F.col("unique_count") - F.col("exact")) <= F.greatest(F.lit(1.0), 5 * 0.0081 * F.col("exact"))).alias("near"))


PARTS = ("p_partkey", "p_size", "p_retailprice")
add("prf2_numeric_stats", lambda s, d: rounded(profile.numeric_stats(t(s, d, "part")).select("column", "min", "max", "mean", "std", "p25", "median", "p75"), 3),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(min({c})::DOUBLE, 3) AS min, round(max({c})::DOUBLE, 3) AS max, round(avg({c}), 3) AS mean, round(stddev_samp({c}), 3) AS std, round(quantile_cont({c}::DOUBLE, 0.25), 3) AS p25, round(quantile_cont({c}::DOUBLE, 0.5), 3) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 3) AS p75 FROM part" for c in PARTS))
add("prf3_outliers", lambda s, d: profile.numeric_stats(t(s, d, "orders").select("o_totalprice", "o_custkey")).select("column", "outlier_count"),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count FROM orders, (SELECT 2.5 * quantile_cont({c}, 0.25) - 1.5 * quantile_cont({c}, 0.75) AS lo, 2.5 * quantile_cont({c}, 0.75) - 1.5 * quantile_cont({c}, 0.25) AS hi FROM orders)" for c in ("o_totalprice", "o_custkey")))
add("prf4_histogram", lambda s, d: profile.histogram(holed(s, d), "value").select("bin", "count"),
    f"SELECT r.bin::INT AS bin, count(v) AS count FROM range(10) r(bin) LEFT JOIN (SELECT value AS v, least(floor((value - lo) / ((hi - lo) / 10)), 9) AS b FROM {HOLED}, (SELECT min(value) AS lo, max(value) AS hi FROM {HOLED}) WHERE value IS NOT NULL) ON b = r.bin GROUP BY 1")
add("prf5_is_integer", lambda s, d: profile.numeric_stats(t(s, d, "part")).select("column", "is_integer"), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", bool_and({c} = floor({c})) AS is_integer FROM part" for c in PARTS))
add("prf6_top_values", lambda s, d: profile.top_values(t(s, d, "orders")).select("column", "value", "count", "rank"),
    " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", {c} AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, {c}) AS rank FROM orders WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5" for c in ("o_orderstatus", "o_orderpriority")))
add("prf6_heavy_hitters", lambda s, d: profile.top_values(t(s, d, "documents").select("source", "lang", F.expr("split(text, ' ')[0]").alias("first_word")), 3).select("column", "value", "count", "rank"),
    " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS \"column\", {v} AS value, count(*) AS count, (row_number() OVER (ORDER BY count(*) DESC, {v}))::INT AS rank FROM documents WHERE {v} IS NOT NULL GROUP BY 2) WHERE rank <= 3" for c, v in (("source", "source"), ("lang", "lang"), ("first_word", "string_split(text, ' ')[1]"))))
add("prf7_text_lengths", lambda s, d: profile.text_lengths(t(s, d, "documents").select("text", "lang")), " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(avg(length({c})), 6) AS avg_length, max(length({c})) AS max_length FROM documents" for c in ("text", "lang")))
add("prf10_completeness", lambda s, d: profile.completeness(holed(s, d)), f"SELECT round(100.0 * (1 - (count(*) FILTER (user_id IS NULL) + count(*) FILTER (event_type IS NULL) + count(*) FILTER (value IS NULL)) / (5.0 * count(*))), 4)::DOUBLE AS completeness_pct FROM {HOLED}")
QUERIES["prf8_semantic_types"] = lambda s, d: profile.semantic_types(t(s, d, "customer"))
SAMPLED = "(SELECT l_orderkey, l_linenumber, l_returnflag, l_suppkey FROM lineitem WHERE ('0x' || left(md5('42|' || l_orderkey::VARCHAR || '|' || l_linenumber::VARCHAR), 8))::BIGINT < floor(0.1 * 4294967296))"
add("prf11_sampled_profile", lambda s, d: profile.counts(transform.sample(t(s, d, "lineitem"), fraction=0.1, by=["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS total, count(*) FILTER ({c} IS NULL) AS null_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct, count(DISTINCT {c}) AS unique_count FROM {SAMPLED}" for c in ("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey")))


# --- drift ----------------------------------------------------------------------------------------------------------------------------
def snapshots(s, d):
    """A snapshot a day of each event type's 'file': the columns are its users, the dtype depends on the day."""
    e = t(s, d, "events").select(F.col("event_type").alias("file_id"), F.to_date("ts").alias("captured_at"), F.concat(F.lit("c"), F.col("user_id") % 40).alias("column"), F.when(F.dayofmonth("ts") % 2 == 0, "int").otherwise("string").alias("dtype"))
    return e.distinct()


SNAPSHOTS = "(SELECT DISTINCT event_type AS file_id, ts::DATE AS captured_at, 'c' || (user_id % 40)::VARCHAR AS \"column\", CASE WHEN day(ts) % 2 = 0 THEN 'int' ELSE 'string' END AS dtype FROM events)"
DRIFT_SQL = "CASE WHEN o.dtype IS NULL THEN 'added' WHEN n.dtype IS NULL THEN 'removed' WHEN o.dtype <> n.dtype THEN 'type_changed' END"


@query(f"""WITH s AS {SNAPSHOTS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY file_id ORDER BY captured_at DESC) AS k FROM s), f AS (SELECT file_id FROM r GROUP BY 1 HAVING max(k) >= 2),
x AS (SELECT coalesce(o.file_id, n.file_id) AS file_id, coalesce(o."column", n."column") AS "column", {DRIFT_SQL} AS change FROM (SELECT * FROM r WHERE k = 2) o FULL OUTER JOIN (SELECT * FROM r WHERE k = 1) n ON o.file_id = n.file_id AND o."column" = n."column")
SELECT file_id, "column", change, CASE change WHEN 'added' THEN 'info' WHEN 'removed' THEN 'breaking' ELSE 'warning' END AS severity FROM x JOIN f USING (file_id) WHERE change IS NOT NULL""")
def drf2_latest_drift(s, d):
    taken = snapshots(s, d).groupBy("file_id", "captured_at").agg(F.map_from_entries(F.collect_list(F.struct("column", "dtype"))).alias("dtypes"))
    return drift.latest_drift(taken).select("file_id", "column", "change", "severity")


@query(f"""WITH s AS {SNAPSHOTS}, o AS (SELECT DISTINCT "column", 'a' AS dtype FROM s WHERE file_id = 'click'), n AS (SELECT DISTINCT "column", CASE WHEN "column" LIKE '%1' THEN 'b' ELSE 'a' END AS dtype FROM s WHERE file_id = 'purchase')
SELECT * FROM (SELECT coalesce(o."column", n."column") AS "column", {DRIFT_SQL} AS change FROM o FULL OUTER JOIN n ON o."column" = n."column") WHERE change IS NOT NULL""")
def drf1_drift(s, d):
    rows = snapshots(s, d)
    old = rows.where("file_id = 'click'").select("column", F.lit("a").alias("dtype")).distinct()
    new = rows.where("file_id = 'purchase'").select("column", F.when(F.col("column").endswith("1"), "b").otherwise("a").alias("dtype")).distinct()
    return drift.drift(old, new).select("column", "change")


FILES = "(SELECT DISTINCT event_type || '-' || (user_id // 40) AS file_id, ts::DATE AS captured_at, 'c' || (user_id % 40)::VARCHAR AS \"column\", CASE WHEN day(ts) % 2 = 0 THEN 'int' ELSE 'string' END AS semantic_type FROM events)"


@query(f"""WITH f AS {FILES}, n AS (SELECT file_id, captured_at, lead(captured_at) OVER (PARTITION BY file_id ORDER BY captured_at) AS next FROM (SELECT DISTINCT file_id, captured_at FROM f)),
o AS (SELECT f.file_id, n.next AS captured_at, f."column", f.semantic_type FROM f JOIN n ON f.file_id = n.file_id AND f.captured_at = n.captured_at WHERE n.next IS NOT NULL),
gone AS (SELECT * FROM o ANTI JOIN f USING (file_id, captured_at, "column")), come AS (SELECT * FROM f ANTI JOIN o USING (file_id, captured_at, "column")),
p AS (SELECT file_id, captured_at, gone."column" AS old_name, come."column" AS new_name, jaro_winkler_similarity(gone."column", come."column") AS s, gone.semantic_type = come.semantic_type AS type_match FROM gone JOIN come USING (file_id, captured_at))
SELECT file_id, captured_at, old_name, new_name, round(s, 4) AS similarity, type_match, round(least(1.0, s * CASE WHEN type_match THEN 1.2 ELSE 1.0 END), 4) AS confidence FROM p WHERE s >= 0.85""")
def drf3_rename_candidates_by_file(s, d):
    """All candidates between each snapshot of a file and the one before it; a file is an event type and a block of 40 users, its columns are the users."""
    e = t(s, d, "events")
    kind = F.when(F.dayofmonth("ts") % 2 == 0, "int").otherwise("string")
    taken = e.select(F.concat_ws("-", "event_type", F.floor(F.col("user_id") / 40).cast("string")).alias("file_id"), F.to_date("ts").alias("captured_at"), F.concat(F.lit("c"), F.col("user_id") % 40).alias("column"), kind.alias("semantic_type")).distinct()
    days = taken.select("file_id", "captured_at").distinct().withColumn("next", F.lead("captured_at").over(Window.partitionBy("file_id").orderBy("captured_at")))
    old = taken.join(days, ["file_id", "captured_at"]).where("next is not null").select("file_id", F.col("next").alias("captured_at"), "column", "semantic_type")
    return drift.rename_candidates(old, taken, ("file_id", "captured_at"))


@query("""WITH q AS (SELECT DISTINCT lower(n_name) AS name FROM nation UNION SELECT DISTINCT n_name || 's' FROM nation), p AS (SELECT q.name, n.n_name AS m, CASE WHEN lower(q.name) = lower(n.n_name) THEN 2.0 ELSE jaro_winkler_similarity(lower(q.name), lower(n.n_name)) END AS s FROM q, nation n)
SELECT q.name, b.m AS "match" FROM q LEFT JOIN (SELECT name, arg_max(m, (s, m)) AS m FROM p WHERE s >= 0.85 GROUP BY 1) b ON b.name = q.name""")
def drf5_match_columns(s, d):
    nations = t(s, d, "nation")
    asked = nations.select(F.lower("n_name").alias("name")).union(nations.select(F.concat("n_name", F.lit("s")))).distinct()
    return drift.match_columns(asked, [r[0] for r in nations.select("n_name").collect()]).select("name", "match")


# --- masks ------------------------------------------------------------------------------------------------------------------------------
def _masked(kind, made):
    source = "concat(lower(replace(c_name, '#', '.')), '@mail-', c_nationkey, '.example') " if kind == "email" else "concat('+1 (', 100 + c_custkey % 900, ') 555-', 1000 + c_custkey % 9000)" if kind in ("phone", "credit_card", "ssn") else "c_mktsegment"
    return lambda s, d: apply_policies(t(s, d, "customer").select("c_custkey", F.expr(source).alias("v")), "analyst", [{"column": "v", "action": "mask", "mask": kind}]), made.replace("$v", f"({source})")


for name, kind, made in (
    ("sec2_mask_email", "email", "left($v, 1) || '***@' || split_part($v, '@', 2)"), ("sec3_mask_phone", "phone", "'***-***-' || right(regexp_replace($v, '\\D', '', 'g'), 4)"), ("sec3_mask_credit_card", "credit_card", "'****-****-****-' || right(regexp_replace($v, '\\D', '', 'g'), 4)"),
    ("sec3_mask_ssn", "ssn", "'***-**-' || right(regexp_replace($v, '\\D', '', 'g'), 4)"), ("sec4_mask_name", "name", "left($v, 1) || '***'"), ("sec5_mask_custom", "custom:3", "left($v, 3) || '***'"),
    ("sec6_mask_default", "default", "CASE WHEN length($v) <= 3 THEN '***' ELSE left($v, 2) || '***' || right($v, 1) END"),
):
    f, sql = _masked(kind, made)
    add(name, f, f"SELECT c_custkey, {sql} AS v FROM customer")
add("sec1_redact", lambda s, d: apply_policies(t(s, d, "customer"), "analyst", POLICIES[:1]), "SELECT * EXCLUDE (c_acctbal) FROM customer")


# --- lineage and catalog ------------------------------------------------------------------------------------------------------------------
def event_edges(s, d):
    """Edges between all users: from each event's user to another one by a rule with three branches, a graph with cycles that grows with the table."""
    e = t(s, d, "events")
    users = e.agg(F.max("user_id") + 1).first()[0] or 1
    return e.select(F.col("user_id").alias("source_id"), ((F.col("user_id") * 7 + F.col("event_id") % 3) % users).alias("target_id"), F.lit("transforms").alias("relation"), F.col("event_type").alias("pipeline_name"), (F.col("event_id") % 50).alias("run_id"))


EDGES = "(SELECT user_id AS source_id, (user_id * 7 + event_id % 3) % (SELECT max(user_id) + 1 FROM events) AS target_id, 'transforms' AS relation, event_type AS pipeline_name, event_id % 50 AS run_id FROM events)"


def _reach_sql(a, b, depth):
    return f"r(asset_id, depth) AS (SELECT 1::BIGINT, 0 UNION SELECT {b}, depth + 1 FROM r JOIN (SELECT DISTINCT source_id, target_id FROM e) g ON g.{a} = r.asset_id WHERE depth < {depth}), least_depth AS (SELECT asset_id, min(depth) AS depth FROM r GROUP BY 1)"


add("cat2_upsert_edges", lambda s, d: catalog.upsert_edges(event_edges(s, d), event_edges(s, d)), f"SELECT DISTINCT * FROM {EDGES}")
add("cat5_blast_radius", lambda s, d: catalog.blast_radius(event_edges(s, d), s.range(1, 2).select(F.col("id").alias("asset_id")), 10),
    f"WITH RECURSIVE e AS {EDGES}, {_reach_sql('source_id', 'target_id', 10)}, i AS (SELECT target_id, pipeline_name, count(DISTINCT run_id) AS runs FROM e WHERE source_id IN (SELECT asset_id FROM least_depth) GROUP BY 1, 2) SELECT asset_id, depth, pipeline_name, coalesce(runs, 0) AS runs FROM least_depth LEFT JOIN i ON target_id = asset_id")
add("cat6_upstream", lambda s, d: catalog.upstream(event_edges(s, d), s.range(1, 2).select(F.col("id").alias("asset_id")), 10), f"WITH RECURSIVE e AS {EDGES}, {_reach_sql('target_id', 'source_id', 10)} SELECT * FROM least_depth")


def event_assets(s, d):
    e = t(s, d, "events")
    kind = F.element_at(F.array(*map(F.lit, ("file", "column", "topic"))), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select(kind.alias("asset_type"), F.concat(F.lit("asset "), "user_id").alias("name"), F.lit("main").alias("namespace"), F.col("event_type").alias("metadata"), F.col("event_id").alias("id"), F.col("user_id").alias("owner_id"), F.col("ts").alias("created_at"), F.col("ts").alias("last_seen_at"))


ASSETS = "(SELECT ['file', 'column', 'topic'][user_id % 3 + 1] AS asset_type, 'asset ' || user_id AS name, 'main' AS namespace, event_type AS metadata, event_id AS id, user_id AS owner_id, ts AS created_at, ts AS last_seen_at FROM events)"
UPSERTED = f"(SELECT asset_type, namespace, name, arg_min(id, (created_at, id)) AS id, arg_max(metadata, (last_seen_at, created_at, id)) AS metadata, min(created_at) AS created_at, max(last_seen_at) AS last_seen_at FROM {ASSETS} GROUP BY 1, 2, 3)"


def upserted(s, d):
    a = event_assets(s, d)
    return catalog.upsert_assets(a.where("id % 2 = 0"), a.where("id % 2 = 1"))


add("cat1_upsert_assets", lambda s, d: upserted(s, d).drop("owner_id"), f"SELECT * FROM {UPSERTED}")
NODE = "concat(event_type, CASE event_id % 5 WHEN 0 THEN '.csv' WHEN 1 THEN '-topic' WHEN 2 THEN '.topic' ELSE '' END)"
add("cat3_classify_node", lambda s, d: t(s, d, "events").select("event_id", catalog.classify_node(F.expr(NODE)).alias("kind")), "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'file' WHEN 1 THEN 'topic' WHEN 2 THEN 'topic' ELSE 'column' END AS kind FROM events")
STEP = "CASE event_id % 4 WHEN 0 THEN 'load' WHEN 1 THEN 'save' WHEN 2 THEN 'join' ELSE 'filter' END"
add("cat4_classify_edge", lambda s, d: t(s, d, "events").select("event_id", catalog.classify_edge(F.expr(STEP)).alias("relation")), "SELECT event_id, ['reads_from', 'writes_to', 'joins', 'transforms'][event_id % 4 + 1] AS relation FROM events")
GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"
def stored_upserts(s, d):
    """The assets merged into a stored table in three batches of the log."""
    a = event_assets(s, d)
    store = catalog.stored_assets(s, new_path(s, "assets"), 16)
    for k in range(3):
        store.merge(a.where(f"id % 3 = {k}"))
    return store.table(a.schema)


def stored_edge_upserts(s, d):
    e = event_edges(s, d)
    store = catalog.stored_edges(s, new_path(s, "edges"), 16)
    for k in range(3):
        store.merge(e.where(f"run_id % 3 <> {k}"))
    return store.table(e.schema)


add("cat1_stored_upserts", lambda s, d: stored_upserts(s, d).drop("owner_id"), f"SELECT * FROM {UPSERTED}")
add("cat2_stored_edges", stored_edge_upserts, f"SELECT DISTINCT * FROM {EDGES}")


def indexed_search(s, d):
    """Names filed in two batches that overlap, then looked up by the query's grams."""
    a = event_assets(s, d)
    index = catalog.name_index(s, new_path(s, "names"), 64)
    index.add(a.where("id % 2 = 0"))
    index.add(a.where("id % 3 > 0"))
    index.add(a)
    return catalog.search(upserted(s, d), "sset 11", limit=1000, index=index).select("name", "similarity")


add("cat7_indexed_search", indexed_search,
    f"SELECT name, round(len(list_intersect({GRAMS.format('name')}, {GRAMS.format(chr(39) + 'sset 11' + chr(39))})) / len(list_distinct(list_concat({GRAMS.format('name')}, {GRAMS.format(chr(39) + 'sset 11' + chr(39))}))), 4)::DOUBLE AS similarity FROM {UPSERTED} WHERE contains(lower(name), 'sset 11') ORDER BY similarity DESC, name LIMIT 1000")
add("cat7_search", lambda s, d: catalog.search(upserted(s, d), "Asset 11", limit=20).select("name", "similarity"),
    f"SELECT name, round(len(list_intersect({GRAMS.format('name')}, {GRAMS.format(chr(39) + 'Asset 11' + chr(39))})) / len(list_distinct(list_concat({GRAMS.format('name')}, {GRAMS.format(chr(39) + 'Asset 11' + chr(39))}))), 4)::DOUBLE AS similarity FROM {UPSERTED} WHERE contains(lower(name), 'asset 11') ORDER BY similarity DESC, name LIMIT 20")
NOW = "2024-01-20 00:00:00"
SEEN_UNTIL = "2024-01-31 12:00:00"
add("cat8_orphans", lambda s, d: catalog.orphans(upserted(s, d), SEEN_UNTIL, 1).select("name", "last_seen_at"), f"SELECT name, last_seen_at FROM {UPSERTED} WHERE asset_type IN ('file', 'column') AND last_seen_at < TIMESTAMP '{SEEN_UNTIL}' - INTERVAL 1 DAY ORDER BY last_seen_at, name LIMIT 100")
add("cat9_stats", lambda s, d: catalog.catalog_stats(upserted(s, d), event_edges(s, d)), f"SELECT asset_type AS kind, count(*) AS n FROM {UPSERTED} GROUP BY 1 UNION ALL SELECT 'edges', count(*) FROM events")


def event_runs(s, d):
    """events as a run log, with healed runs, breaches of contracts, runs without an end or a start, and steps without input rows."""
    i, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "purchase", F.when(i % 3 == 0, "healed").otherwise("completed")).when(kind == "view", "completed").when(kind == "click", F.when(i % 4 == 0, "contract_violation").otherwise("failed")).when(kind == "signup", "running").otherwise("pending")
    ended = F.when(~kind.isin("signup", "error"), F.timestamp_add("SECOND", F.col("value").cast("int"), "ts"))
    rows_in = F.when(i % 7 != 0, i % 5)
    return t(s, d, "events").select(
        i.alias("id"), F.concat(F.lit("p"), F.col("user_id") % 60).alias("name"), status.alias("status"), F.col("ts").alias("created_at"), F.when(kind != "error", F.col("ts")).alias("started_at"), ended.alias("completed_at"), (F.col("user_id") % 9).alias("schedule_id"),
        F.col("value").alias("duration_ms"), (i % 40).alias("run_id"), kind.alias("step_type"), rows_in.alias("rows_in"),
    )


RUNS = """(SELECT event_id AS id, 'p' || (user_id % 60)::VARCHAR AS name, CASE event_type WHEN 'purchase' THEN if(event_id % 3 = 0, 'healed', 'completed') WHEN 'view' THEN 'completed'
  WHEN 'click' THEN if(event_id % 4 = 0, 'contract_violation', 'failed') WHEN 'signup' THEN 'running' ELSE 'pending' END AS status, ts AS created_at, CASE WHEN event_type <> 'error' THEN ts END AS started_at,
  CASE WHEN event_type NOT IN ('signup', 'error') THEN ts + to_seconds(trunc(value)::BIGINT) END AS completed_at, user_id % 9 AS schedule_id, value AS duration_ms, event_id % 40 AS run_id, event_type AS step_type, CASE WHEN event_id % 7 <> 0 THEN event_id % 5 END AS rows_in FROM events)"""
add("cat10_latest_runs", lambda s, d: catalog.latest_runs(event_runs(s, d), limit=50).select("name", "id", "status"), f"SELECT name, id, status FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY created_at DESC, id DESC) AS k FROM {RUNS}) WHERE k = 1 ORDER BY created_at DESC, id LIMIT 50")
COUNTS = ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("failed", "running", "pending", "cancelled"))
add("run1_stats", lambda s, d: runs.run_stats(event_runs(s, d)),
    f"SELECT count(*) AS total, count(*) FILTER (status IN ('completed', 'healed')) AS completed, {COUNTS}, CASE WHEN count(*) > 0 THEN round_even(100.0 * count(*) FILTER (status IN ('completed', 'healed'))::DOUBLE / count(*), 1) ELSE 0 END AS success_rate, coalesce(round_even(avg(epoch_ms(completed_at) - epoch_ms(started_at)) FILTER (started_at IS NOT NULL AND completed_at IS NOT NULL), 0), 0)::BIGINT AS avg_duration_ms FROM {RUNS}")
add("run2_top_pipelines", lambda s, d: runs.top_pipelines(event_runs(s, d)), f"SELECT name, count(*) AS runs FROM {RUNS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
add("run3_recent", lambda s, d: runs.recent_activity(event_runs(s, d)).select("id", "name", "status"), f"SELECT id, name, status FROM {RUNS} ORDER BY created_at DESC, id LIMIT 10")
add("run4_timing", lambda s, d: runs.run_timing(event_runs(s, d).select("run_id", F.col("id").alias("step_index"), F.col("name").alias("step_name"), "step_type", F.lit(1).alias("rows_in"), F.lit(1).alias("rows_out"), "duration_ms"), 7).select("step_index", "step_name", "duration_ms"), f"SELECT id AS step_index, name AS step_name, duration_ms FROM {RUNS} WHERE run_id = 7 ORDER BY id")
add("run5_step_medians", lambda s, d: rounded(runs.step_medians(event_runs(s, d))), f"SELECT step_type, round(median(duration_ms), 4) AS median_ms, count(*) AS samples FROM {RUNS} WHERE duration_ms > 0 AND rows_in > 0 GROUP BY 1")
add("run6_schedules", lambda s, d: runs.schedule_stats(event_runs(s, d)), f"SELECT schedule_id, count(*) FILTER (status = 'completed') AS successful_runs, count(*) FILTER (status = 'healed') AS healed_runs, count(*) FILTER (status IN ('failed', 'contract_violation')) AS failed_runs, arg_max(status, (created_at, id)) AS last_status FROM {RUNS} GROUP BY 1")


def event_storage(s, d):
    """events as storage events: written to each tier (write_hot, write_warm, write_cold), read, and a kind that only begins alike."""
    kind = F.when(F.col("event_type") == "view", "write_hot").when(F.col("event_type") == "click", "write_warm").when(F.col("event_type") == "purchase", "write_cold").when(F.col("event_type") == "signup", "write").otherwise("read_hot")
    return t(s, d, "events").select(kind.alias("event_type"), (F.col("user_id") % 3).alias("tier"), (F.col("event_id") * 1000).alias("payload_bytes"), F.col("value").cast("decimal(18,6)").alias("duration_ms"), F.col("ts").alias("created_at"))


STORAGE = f"""(SELECT CASE event_type WHEN 'view' THEN 'write_hot' WHEN 'click' THEN 'write_warm' WHEN 'purchase' THEN 'write_cold' WHEN 'signup' THEN 'write' ELSE 'read_hot' END AS event_type, user_id % 3 AS tier, event_id * 1000 AS payload_bytes,
  value::DECIMAL(18,6) AS duration_ms, ts AS created_at FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAY)"""
add("run7_storage_by_tier", lambda s, d: rounded(runs.storage_by_tier(event_storage(s, d), NOW)), f"SELECT tier, count(*) AS events, sum(payload_bytes)::BIGINT AS bytes, round(sum(duration_ms)::DOUBLE / count(duration_ms), 2) AS avg_ms FROM {STORAGE} GROUP BY 1")
add("run8_storage_growth", lambda s, d: runs.storage_growth(event_storage(s, d), NOW), f"SELECT created_at::DATE AS day, round(sum(payload_bytes) / 1048576.0, 1)::DOUBLE AS mb FROM {STORAGE} WHERE event_type LIKE 'write_%' GROUP BY 1")


def event_lineage(s, d):
    """Edges of one run per user: steps s0 to s4, each event linking two steps' columns."""
    e = t(s, d, "events")
    step = lambda k: F.concat(F.lit("s"), (F.col("event_id") % 4 + k))
    return e.select(F.col("user_id").cast("string").alias("run_id"), step(1).alias("step"), F.lit("sql").alias("step_type"), step(0).alias("in_step"), F.concat(F.lit("c"), F.floor(F.col("event_id") / 4) % 3).alias("in_col"), F.concat(F.lit("c"), F.floor(F.col("event_id") / 8) % 3).alias("out_col"), F.lit(False).alias("is_join_key"))


LINEAGE = "(SELECT user_id::VARCHAR AS run_id, 's' || (event_id % 4 + 1) AS step, 's' || (event_id % 4) AS in_step, 'c' || ((event_id // 4) % 3) AS in_col, 'c' || ((event_id // 8) % 3) AS out_col FROM events)"


def all_lineage(s, d):
    """Edges of every run (one per user), expanded from a step record for each event: steps s1 and s3 rename, s2 and s4 run SQL."""
    e = t(s, d, "events")
    name = lambda of: F.concat(F.lit("c"), F.floor(F.col("event_id") / of) % 3)
    made = {
        "run_id": F.col("user_id").cast("string"), "step": F.concat(F.lit("s"), F.col("event_id") % 4 + 1), "step_type": F.when(F.col("event_id") % 2 == 0, "rename").otherwise("sql"), "inputs": F.array(F.concat(F.lit("s"), F.col("event_id") % 4)),
        "input_columns": F.array(F.array(name(4))), "mapping": F.create_map(name(4), name(8)), "output_columns": F.array(name(8)),
    }
    kinds = [(f.name, f.dataType) for f in T._parse_datatype_string(lineage.RECORD)]
    return lineage.edges(e.select(*[made.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds]))


ALL_LINEAGE = "(SELECT user_id::VARCHAR AS run_id, 's' || (event_id % 4 + 1) AS step, CASE WHEN event_id % 2 = 0 THEN 'rename' ELSE 'sql' END AS step_type, 's' || (event_id % 4) AS in_step, 'c' || ((event_id // 4) % 3) AS in_col, 'c' || ((event_id // 8) % 3) AS out_col, false AS is_join_key FROM events)"


def _walk_sql(start, a, b, source=LINEAGE):
    return f"WITH RECURSIVE l AS {source}, g AS (SELECT DISTINCT run_id, in_step || ':' || in_col AS a, step || ':' || out_col AS b FROM l), w(run_id, node, depth) AS (SELECT DISTINCT run_id, '{start}', 0 FROM g WHERE {b} = '{start}' UNION SELECT w.run_id, g.{a}, depth + 1 FROM w JOIN g ON g.run_id = w.run_id AND g.{b} = w.node WHERE depth < 10) SELECT run_id, node, min(depth) AS depth FROM w GROUP BY 1, 2"


add("lin2_ancestry", lambda s, d: lineage.ancestry(event_lineage(s, d), "s4", "c0", 10), _walk_sql("s4:c0", "a", "b"))
add("lin3_impact", lambda s, d: lineage.impact(event_lineage(s, d), "s0", "c1", 10), _walk_sql("s0:c1", "b", "a"))
add("lin4_column_pairs", lambda s, d: lineage.column_pairs(event_lineage(s, d).groupBy("run_id", F.col("step").alias("step_name")).agg(F.collect_set("in_col").alias("columns_in"), F.collect_set("out_col").alias("columns_out"))),
    f"WITH l AS {LINEAGE} SELECT DISTINCT a.run_id, a.step AS step_name, a.in_col, b.out_col FROM l a JOIN (SELECT DISTINCT run_id, step, out_col FROM l) b ON a.run_id = b.run_id AND a.step = b.step")
add("lin1_edges", all_lineage, f"SELECT * FROM {ALL_LINEAGE}")
KINDS = ("load", "filter", "select", "rename", "join", "aggregate", "pivot", "unpivot", "deduplicate", "fill_nulls", "sample", "sql", "transform", "compute", "sort", "save")


def lineage_of_every_kind(s, d):
    """A step record for each event, of sixteen kinds in turn, whose columns depend on the user."""
    e = t(s, d, "events")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 16 + 1).cast("int"))
    u, k, z = F.concat(F.lit("c"), F.col("user_id") % 3), F.lit("k"), F.lit("z")
    outputs = F.when(kind == "load", F.array(k, u)).when(kind == "pivot", F.array(k, F.lit("p1"), F.lit("p2"))).when(kind == "unpivot", F.array(k, F.lit("variable"), F.lit("value"))).when(kind == "sql", F.array(F.lit("o"), u)).otherwise(F.array(k, u, z, F.lit("made")))
    made = {
        "run_id": F.col("event_id").cast("string"), "step": F.lit("s"), "step_type": kind, "inputs": F.when(kind == "join", F.array(F.lit("a"), F.lit("b"))).when(kind != "load", F.array(F.lit("a"))),
        "input_columns": F.when(kind == "join", F.array(F.array(k, u, z), F.array(k, u, F.lit("w")))).otherwise(F.array(F.array(k, u, z))), "columns": F.array(u), "mapping": F.create_map(u, F.lit("new")), "join_key": k,
        "aggregations": F.array(F.struct(u.alias("column"), F.lit("sum").alias("function")), F.struct(z.alias("column"), F.lit("max").alias("function"))), "group_by": F.array(k), "index": F.array(k), "value_column": u, "output_columns": outputs,
    }
    kinds = [(f.name, f.dataType) for f in T._parse_datatype_string(lineage.RECORD)]
    return lineage.edges(e.select(*[made[c].cast(of).alias(c) for c, of in kinds]))


def _edge_list(*edges: tuple[str, ...]) -> str:
    """SQL of a list of edges: (from step, column, to column[, key]); u stands for the user's column."""
    text = lambda x: "u" if x == "u" else f"u || '{x[1:]}'" if x.startswith("u_") else f"'{x}'"
    return "[" + ", ".join(f"{{'i': '{i}', 'c': {text(c)}, 'o': {text(o)}, 'j': {bool(key)}}}" for i, c, o, *key in edges) + "]"


def _all_with_all(*outputs: str) -> str:
    return _edge_list(*[("a", c, o) for c in ("k", "u", "z") for o in outputs])


EDGE_RULES = {
    "load": _edge_list(("file:s", "k", "k"), ("file:s", "u", "u")), "select": _edge_list(("a", "u", "u")), "rename": _edge_list(("a", "k", "k"), ("a", "u", "new"), ("a", "z", "z")),
    "join": _edge_list(("a", "k", "k", "key"), ("a", "u", "u_left"), ("a", "z", "z"), ("b", "k", "k", "key"), ("b", "u", "u_right"), ("b", "w", "w")), "aggregate": _edge_list(("a", "k", "k"), ("a", "u", "u_sum"), ("a", "z", "z_max")),
    "pivot": _edge_list(("a", "k", "k"), ("a", "u", "p1"), ("a", "u", "p2")), "unpivot": _all_with_all("k", "variable", "value"), "sql": _all_with_all("o", "u"), "transform": _all_with_all("k", "u", "z", "made"), "compute": _all_with_all("k", "u", "z", "made"),
}
add("lin1_every_kind", lineage_of_every_kind,
    f"SELECT run_id, 's' AS step, kind AS step_type, x.i AS in_step, x.c AS in_col, x.o AS out_col, x.j AS is_join_key FROM (SELECT run_id, kind, unnest(CASE kind {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}' for k, v in EDGE_RULES.items())} ELSE {_edge_list(('a', 'k', 'k'), ('a', 'u', 'u'), ('a', 'z', 'z'))} END) AS x FROM (SELECT event_id::VARCHAR AS run_id, 'c' || (user_id % 3) AS u, {list(KINDS)}[event_id % 16 + 1] AS kind FROM events))")
add("lin2_ancestry_all_runs", lambda s, d: lineage.ancestry(all_lineage(s, d), "s4", "c0", 10), _walk_sql("s4:c0", "a", "b", ALL_LINEAGE))
add("lin3_impact_all_runs", lambda s, d: lineage.impact(all_lineage(s, d), "s0", "c1", 10), _walk_sql("s0:c1", "b", "a", ALL_LINEAGE))
add("lin4_column_pairs_all_runs", lambda s, d: lineage.column_pairs(all_lineage(s, d).groupBy("run_id", F.col("step").alias("step_name")).agg(F.collect_set("in_col").alias("columns_in"), F.collect_set("out_col").alias("columns_out"))),
    f"WITH l AS {ALL_LINEAGE} SELECT DISTINCT a.run_id, a.step AS step_name, a.in_col, b.out_col FROM l a JOIN (SELECT DISTINCT run_id, step, out_col FROM l) b ON a.run_id = b.run_id AND a.step = b.step")
QUERIES["lin5_openlineage"] = lambda s, d: lineage.open_lineage(all_lineage(s, d).select("run_id").distinct().select("run_id", F.concat(F.lit("p"), "run_id").alias("name"), F.lit("completed").alias("status"), F.lit(NOW).alias("completed_at")), all_lineage(s, d))


# --- pipelines --------------------------------------------------------------------------------------------------------------------------
REVENUE = [
    {"name": "orders", "type": "load", "table": "orders"}, {"name": "customers", "type": "load", "table": "customer"}, {"name": "nations", "type": "load", "table": "nation"},
    {"name": "done", "type": "filter", "input": "orders", "column": "o_orderstatus", "operator": "equals", "value": "F"},
    {"name": "keyed", "type": "rename", "input": "done", "mapping": {"o_custkey": "custkey"}}, {"name": "who", "type": "rename", "input": "customers", "mapping": {"c_custkey": "custkey", "c_nationkey": "nationkey"}},
    {"name": "where", "type": "rename", "input": "nations", "mapping": {"n_nationkey": "nationkey", "n_name": "nation"}},
    {"name": "with_customer", "type": "join", "left": "keyed", "right": "who", "on": "custkey"}, {"name": "with_nation", "type": "join", "left": "with_customer", "right": "where", "on": "nationkey"},
    {"name": "named", "type": "rename", "input": "with_nation", "mapping": {"c_mktsegment": "segment"}},
    {"name": "revenue", "type": "aggregate", "input": "named", "group_by": ["nation", "segment"], "aggregations": [{"column": "o_totalprice", "function": "sum"}, {"column": "o_orderkey", "function": "count"}]},
    {"name": "report", "type": "sort", "input": "revenue", "by": ["o_totalprice_sum"], "ascending": [False]},
]


@query("SELECT n_name AS nation, c_mktsegment AS segment, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 2) AS o_totalprice_sum, count(o_orderkey) AS o_orderkey_count FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def pip1_revenue_report(s, d):
    made = pipeline.run(REVENUE, {"orders": exact(t(s, d, "orders"), "o_totalprice"), "customer": t(s, d, "customer"), "nation": t(s, d, "nation")})
    return rounded(made["report"].frame, 2)


def _orders(s, d):
    return exact(t(s, d, "orders"), "o_totalprice").withColumnsRenamed({"o_custkey": "customer_id", "o_totalprice": "amount", "o_orderkey": "order_id", "o_orderstatus": "status"})


def _customers(s, d):
    return t(s, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("tier"))


add("pip4_sales_revenue_report", lambda s, d: rounded(pipeline.run(pipeline.revenue_report("orders", "customers", "F"), {"orders": _orders(s, d), "customers": _customers(s, d)})["report"].frame, 6),
    "SELECT c_nationkey AS region, c_mktsegment AS tier, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 6) AS amount_sum, count(*) AS order_id_count, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*), 6) AS amount_mean FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2")
add("pip4_customer_segmentation", lambda s, d: rounded(pipeline.run(pipeline.segmentation("orders"), {"orders": _orders(s, d)})["segments"].frame, 6),
    "SELECT o_custkey AS customer_id, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE, 6) AS amount_sum, count(*) AS amount_count, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / count(*), 6) AS amount_mean FROM orders GROUP BY 1")
add("pip4_data_quality_audit", lambda s, d: pipeline.run(pipeline.quality_audit("e", ["event_id"]), {"e": holed(s, d)})["audit"].frame, f"SELECT DISTINCT * REPLACE (coalesce(event_type, 'MISSING') AS event_type) FROM {HOLED}")
add("pip4_multi_source_merge", lambda s, d: pipeline.run(pipeline.source_merge("a", "b"), {"a": t(s, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderstatus"), "b": _customers(s, d).select(F.col("customer_id").alias("id"), "tier")})["unique"].frame,
    "SELECT DISTINCT coalesce(o_custkey, c_custkey) AS id, o_orderstatus, c_mktsegment AS tier FROM orders FULL OUTER JOIN customer ON o_custkey = c_custkey")
QUERIES["pip4_weekly_rollup"] = lambda s, d: pipeline.run(pipeline.weekly_rollup("e", ["ts", "event_id"]), {"e": t(s, d, "events")})["rollup"].frame


# --- the published benchmark's five shapes ---------------------------------------------------------------------------------------------------
BENCH = {
    "bench_filter": lambda s, d: t(s, d, "lineitem").where((F.col("l_quantity") > 25) & (F.col("l_returnflag") == "N")),
    "bench_aggregate": lambda s, d: rounded(t(s, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_extendedprice").alias("s"), F.count("*").alias("n"), F.avg("l_extendedprice").alias("a"), F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")), 1),
    "bench_join": lambda s, d: transform.join(t(s, d, "orders").withColumnRenamed("o_custkey", "k"), t(s, d, "customer").withColumnRenamed("c_custkey", "k"), "k", "left"),
    "bench_sort": lambda s, d: transform.sort(t(s, d, "lineitem"), ["l_returnflag", "l_extendedprice"], ascending=[True, False]),
    "bench_projection": lambda s, d: t(s, d, "lineitem").where("l_quantity > 10").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net")),
}
BENCH_SQL = {
    "bench_filter": "SELECT * FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'N'",
    "bench_aggregate": "SELECT l_suppkey, l_returnflag, round(sum(l_extendedprice), 1) AS s, count(*) AS n, round(avg(l_extendedprice), 1) AS a, round(min(l_extendedprice), 1) AS lo, round(max(l_extendedprice), 1) AS hi FROM lineitem GROUP BY 1, 2",
    "bench_join": "SELECT * RENAME (o_custkey AS k) FROM orders LEFT JOIN (SELECT c_custkey AS k, * EXCLUDE (c_custkey) FROM customer) c ON o_custkey = c.k",
    "bench_sort": "SELECT * FROM lineitem ORDER BY l_returnflag, l_extendedprice DESC",
    "bench_projection": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem WHERE l_quantity > 10",
}
BENCH_SQL["bench_join"] = "SELECT o.* RENAME (o_custkey AS k), c.* EXCLUDE (c_custkey) FROM orders o LEFT JOIN customer c ON o_custkey = c_custkey"
for name, f in BENCH.items():
    add(name, f, BENCH_SQL[name])


def queries() -> dict[str, Query]:
    from . import report_queries, stream_queries  # noqa: F401  they register themselves

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
