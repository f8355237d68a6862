"""Data contracts: schema and value rules checked in one pass, violations as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arguments import category

VIOLATION = "column string, rule string, severity string, message string, actual string, expected string"


def violations(df: DataFrame, contract: dict, output: bool = False) -> DataFrame:
    """The contract's violations: column, rule, severity, message, actual, expected.

    contract: columns {name: {type, nullable, unique, min_value, max_value, allowed_values, pattern, required}}, null_thresholds {name: percent},
    min_rows, max_rows, allow_extra. output: the rules for outputs, where null breaks allowed_values, unique is an error and max_rows a
    warning's opposite (error); for steps they are ignored, a warning, a warning.
    """
    spark, kinds = df.sparkSession, {f.name: category(f.dataType) for f in df.schema.fields}
    rows, aggs, later = [], [F.count(F.lit(1)).alias("rows")], []

    def ask(name, rule, severity, count, expected):
        alias = f"v{len(later)}"
        aggs.append(count.alias(alias))
        later.append((alias, name, rule, severity, expected))

    for name, spec in contract.get("columns", {}).items():
        if name not in kinds:
            if spec.get("required", True):
                rows.append((name, "required", "error", f"column {name} is missing", None, "present"))
            continue
        c = F.col(f"`{name}`")
        want = spec.get("type")
        if want and want != "any" and kinds[name] != want:
            rows.append((name, "type", "error", f"column {name} is {kinds[name]}", kinds[name], want))
        if spec.get("nullable") is False:
            ask(name, "not_null", "error", F.count_if(c.isNull()), "0")
        if spec.get("unique"):
            ask(name, "unique", "error" if output else "warning", F.count(c) - F.count_distinct(c), "0")
        if spec.get("min_value") is not None:
            ask(name, "min_value", "error", F.count_if((c < F.lit(spec["min_value"])) & ~_nan(df, name)), f">= {spec['min_value']}")
        if spec.get("max_value") is not None:
            ask(name, "max_value", "error", F.count_if((c > F.lit(spec["max_value"])) & ~_nan(df, name)), f"<= {spec['max_value']}")
        if spec.get("allowed_values") is not None:
            inside = c.cast("string").isin([str(v) for v in spec["allowed_values"]])
            ask(name, "allowed_values", "error", F.count_if(~F.coalesce(inside, F.lit(not output))), ", ".join(map(str, spec["allowed_values"])))
        if spec.get("pattern"):
            ask(name, "pattern", "error", F.count_if(~c.cast("string").rlike(f"^(?:{spec['pattern']})$")), spec["pattern"])
    for name, percent in contract.get("null_thresholds", {}).items():
        if name in kinds:
            rate = 100.0 * F.count_if(F.col(f"`{name}`").isNull()) / F.greatest(F.lit(1), F.count(F.lit(1)))
            ask(name, "null_rate", "warning", F.when(rate > percent, rate), f"<= {percent} %")
    got = df.agg(*aggs).first().asDict()
    n = got["rows"]
    for alias, name, rule, severity, expected in later:
        if got[alias]:
            rows.append((name, rule, severity, f"column {name} breaks {rule}: {got[alias]:g}", f"{got[alias]:g}", expected))
    if contract.get("min_rows") is not None and n < contract["min_rows"]:
        rows.append((None, "min_rows", "error", f"{n} rows", str(n), str(contract["min_rows"])))
    if contract.get("max_rows") is not None and n > contract["max_rows"]:
        rows.append((None, "max_rows", "error" if output else "warning", f"{n} rows", str(n), str(contract["max_rows"])))
    if contract.get("columns") and not contract.get("allow_extra", False):
        rows += [(name, "unexpected", "warning", f"column {name} isn't in the contract", kinds[name], None) for name in kinds if name not in contract["columns"]]
    return spark.createDataFrame(rows, VIOLATION)


def _nan(df: DataFrame, name: str):
    """Not-a-number, which is no value: neither below a minimum nor above a maximum."""
    return F.isnan(F.col(f"`{name}`")) if dict(df.dtypes)[name] in ("double", "float") else F.lit(False)


def breach(found: DataFrame, severity: str = "block") -> dict:
    """Counts by severity; blocked only if the contract blocks and an error exists."""
    n = {r["severity"]: r["n"] for r in found.groupBy("severity").agg(F.count("*").alias("n")).collect()}
    return {"errors": n.get("error", 0), "warnings": n.get("warning", 0), "blocked": severity == "block" and bool(n.get("error"))}
