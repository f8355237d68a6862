"""Data-quality rules: all of them in one pass of conditional counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arguments import StepError

#: Strptime letters and Spark's patterns for them.
FORMATS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%y": "yy", "%j": "DDD", "%p": "a", "%I": "hh", "%%": "%"}


def date_pattern(form: str) -> str:
    """Spark's pattern for a strptime format; letters of the text are quoted."""

    def part(m: re.Match) -> str:
        if m[0].startswith("%"):
            if m[0] not in FORMATS:
                raise StepError(f"date format {form!r}: {m[0]} isn't known")
            return FORMATS[m[0]]
        return f"'{m[0]}'"

    return re.sub(r"%.|[A-Za-z]+", part, form)


def fails(rule: dict) -> Column:
    """True for rows that break a row rule; null counts as kept unless said."""
    c, check = F.col(f"`{rule['column']}`"), rule["check"]
    number = F.nanvl(F.expr(f"try_cast(`{rule['column']}` as double)"), F.lit(None))  # not-a-number is no value
    text = c.cast("string")
    if check == "not_null":
        return c.isNull()
    if check == "not_empty":
        return F.trim(text) == ""
    if check == "greater_than":
        return number <= float(rule["value"])
    if check == "less_than":
        return number >= float(rule["value"])
    if check == "between":
        return (number < float(rule["min"])) | (number > float(rule["max"]))
    if check == "positive":
        return number <= 0
    if check == "in_values":
        return ~F.coalesce(text.isin([str(v) for v in rule["values"]]), F.lit(False))
    if check == "matches_pattern":
        re.compile(rule["pattern"])
        return ~F.coalesce(text.rlike(f"^(?:{rule['pattern']})"), F.lit(False))
    if check == "date_format":
        return F.try_to_timestamp(text, F.lit(date_pattern(rule["format"]))).isNull() & c.isNotNull()
    raise StepError(f"unknown check {check!r}")


def validate(df: DataFrame, rules: list[dict], examples: int = 3) -> DataFrame:
    """A row per rule: position, check, column, severity, passed, failing, total, message and at most ``examples`` failing values.

    A rule on a missing column or with an unknown check is a failed rule on all rows, one with a pattern that can't be read a failed rule on none. The row rules are conditional counts of one aggregate; no_duplicates adds
    distinct counts to it. The table has one row per rule.
    """
    spark = df.sparkSession
    aggs, notes, unread = [F.count(F.lit(1)).alias("total")], {}, set()
    for k, rule in enumerate(rules):
        check = rule.get("check")
        try:
            if check in ("min_rows", "max_rows"):
                continue
            if rule.get("column") not in df.columns:
                notes[k] = f"no column {rule.get('column')!r}"
            elif check == "no_duplicates":
                c = F.col(f"`{rule['column']}`")
                aggs.append((F.count(F.lit(1)) - F.count_distinct(c) - F.max(c.isNull().cast("int"))).alias(f"r{k}"))
            else:
                aggs.append(F.count_if(fails(rule)).alias(f"r{k}"))
        except (StepError, re.error, KeyError, TypeError, ValueError) as e:
            notes[k] = f"{type(e).__name__}: {e}"
            unread.update([k] if isinstance(e, re.error) else [])
    got = df.agg(*aggs).first().asDict()
    total, rows = got["total"], []
    for k, rule in enumerate(rules):
        check = rule.get("check")
        if check == "min_rows":
            failing = max(0, int(rule["value"]) - total)
        elif check == "max_rows":
            failing = max(0, total - int(rule["value"]))
        else:
            failing = 0 if k in unread else total if k in notes else int(got[f"r{k}"] or 0)
        shown: list[str] = []
        if examples and failing and k not in notes and check not in ("min_rows", "max_rows"):
            c = F.col(f"`{rule['column']}`")
            broken = df.groupBy(c.alias("c")).agg(F.count("*").alias("n")).where("n > 1") if check == "no_duplicates" else df.where(fails(rule)).select(c.alias("c"))
            shown = [str(r[0]) for r in broken.select(F.col("c").cast("string")).limit(examples).collect()]
        rows.append((k, check, rule.get("column"), rule.get("severity", "error"), failing == 0 and k not in notes, failing, total, notes.get(k), shown))
    return spark.createDataFrame(rows, "position int, check string, column string, severity string, passed boolean, failing long, total long, message string, examples array<string>")


def verdict(report: DataFrame) -> dict:
    """Failed rules by severity; the step passes if no rule of severity error failed."""
    failed = {r["severity"]: r["n"] for r in report.where("not passed").groupBy("severity").agg(F.count("*").alias("n")).collect()}
    return {"passed": not failed.get("error"), "errors": failed.get("error", 0), "warnings": failed.get("warning", 0)}


