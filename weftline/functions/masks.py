"""Column masks and role policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mask(column: Column, kind: str = "default") -> Column:
    """The column's text masked by kind: email, phone, credit_card, ssn, name, custom:n, anything else the default.

    Nulls and empty texts stay as they are.
    """
    text = column.cast("string")
    digits = F.regexp_replace(text, r"\D", "")
    last = F.right(digits, F.lit(4))
    if kind == "email":
        halves = F.split(text, "@")
        made = F.when(F.size(halves) == 2, F.concat(F.left(halves[0], F.lit(1)), F.lit("***@"), halves[1])).otherwise(F.concat(F.left(text, F.lit(1)), F.lit("***")))
    elif kind == "phone":
        made = F.when(F.length(digits) >= 4, F.concat(F.lit("***-***-"), last)).otherwise(F.lit("***"))
    elif kind == "credit_card":
        made = F.when(F.length(digits) >= 4, F.concat(F.lit("****-****-****-"), last)).otherwise(F.lit("****"))
    elif kind == "ssn":
        made = F.when(F.length(digits) >= 4, F.concat(F.lit("***-**-"), last)).otherwise(F.lit("***-**-****"))
    elif kind == "name":
        made = F.concat(F.left(text, F.lit(1)), F.lit("***"))
    elif kind.startswith("custom:") and kind[7:].isdigit():
        made = F.concat(F.left(text, F.lit(int(kind[7:]))), F.lit("***"))
    else:
        made = F.when(F.length(text) <= 3, F.lit("***")).otherwise(F.concat(F.left(text, F.lit(2)), F.lit("***"), F.right(text, F.lit(1))))
    return F.when(text.isNull() | (text == ""), text).otherwise(made)


def apply_policies(df: DataFrame, role: str, policies: list[dict]) -> DataFrame:
    """Redact (drop) or mask columns unless the role is allowed. A policy: {column, action: redact|mask, mask, allowed_roles}."""
    for policy in policies:
        name = policy["column"]
        if name not in df.columns or role in policy.get("allowed_roles", ()):
            continue
        df = df.drop(name) if policy["action"] == "redact" else df.withColumn(name, mask(F.col(name), policy.get("mask", "default")))
    return df
