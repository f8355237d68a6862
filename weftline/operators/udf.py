"""The user-function step, vectorised: a function of double columns to one double column."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.arguments import StepError, need_columns, need_numeric
from ..sources.shared import cut


def compute(df: DataFrame, function: Callable, input_columns: Sequence[str], output_column: str) -> DataFrame:
    """df with output_column = function(*input_columns) and its errors in __error (null where it worked).

    The function gets pandas Series of doubles. If it fails on a batch, it is called row by row, and rows on which it fails get null.
    """
    need_columns(df, input_columns, "compute")
    for c in input_columns:
        need_numeric(df, c, "compute")

    @F.pandas_udf("value double, error string")
    def call(frame: pd.DataFrame) -> pd.DataFrame:
        columns = [frame[c].astype("float64") for c in frame.columns]
        try:
            return pd.DataFrame({"value": pd.Series(np.broadcast_to(function(*columns), len(frame)), dtype="float64"), "error": pd.Series([None] * len(frame), dtype=object)})
        except Exception:  # noqa: BLE001  the user's function may raise anything
            values, errors = [], []
            for row in zip(*columns):
                try:
                    values.append(float(function(*row)))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            return pd.DataFrame({"value": pd.Series(values, dtype="float64"), "error": pd.Series(errors, dtype=object)})

    made = df.withColumn("__made", call(F.struct(*[F.col(f"`{c}`").cast("double").alias(c) for c in input_columns])))
    return made.select(*[F.col(f"`{c}`") for c in df.columns if c != output_column], F.col("__made.value").alias(output_column), F.col("__made.error").alias("__error"))


def checked(made: DataFrame) -> DataFrame:
    """compute's result without __error; fails if more than max(10, a tenth) of the rows failed.

    The result is written once to the shared folder and counted while it is written, so that the function runs once for the check and for all that reads the result.
    """
    seen = Observation()
    written = cut(made.observe(seen, F.count(F.lit(1)).alias("rows"), F.count("__error").alias("bad")), "compute")
    rows, bad = seen.get["rows"], seen.get["bad"]
    if bad > max(10, rows // 10):
        raise StepError(f"compute: the function failed on {bad} of {rows} rows")
    return written.drop("__error")
