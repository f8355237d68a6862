"""A pipeline: a list of named steps (plain dicts) folded into lazy DataFrames."""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.arguments import StepError
from ..operators import contracts, quality, reshape, sqlstep, transform, udf
from ..sources import tables as tables_io
from ..sources.shared import cut, cut_at, discard


@dataclass
class StepResult:
    name: str
    kind: str
    frame: DataFrame
    columns_in: list[str] = field(default_factory=list)
    seen: Observation | None = None
    inputs: list[StepResult] = field(default_factory=list)
    report: dict | None = None
    seconds: float = 0.0
    path: str | None = None

    @property
    def rows_in(self) -> int:
        """Rows of all the steps that this one reads; a load step reads its own rows."""
        return sum(r.rows_out for r in self.inputs) if self.inputs else self.rows_out

    @property
    def rows_out(self) -> int:
        """Counted while an action ran over the frame; a save step knows it from writing."""
        if self.report:
            return self.report["rows"]
        return self.seen.get["rows"] if self.seen else self.frame.count()


def _keep(step: dict, *names: str) -> dict:
    return {n: step[n] for n in names if n in step}


#: What each kind of step does with its input; the keys it takes are the functions' arguments.
STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "filter": lambda df, s: transform.filter(df, s["column"], s["operator"], s.get("value")),
    "select": lambda df, s: transform.select(df, s["columns"], s.get("mode", "include")),
    "rename": lambda df, s: transform.rename(df, s["mapping"]),
    "transform": lambda df, s: transform.transform(df, s["expression"]),
    "aggregate": lambda df, s: transform.aggregate(df, s.get("group_by", []), s["aggregations"], **_keep(s, "order_by", "approximate")),
    "sort": lambda df, s: transform.sort(df, s["by"], **_keep(s, "order", "ascending")),
    "sample": lambda df, s: transform.sample(df, **_keep(s, "n", "fraction", "stratify_by", "random_state")),
    "pivot": lambda df, s: reshape.pivot(df, s["index"], s["columns"], s["values"], **_keep(s, "aggfunc", "fill_value", "pivot_values", "order_by")),
    "unpivot": lambda df, s: reshape.unpivot(df, s["id_vars"], s["value_vars"], **_keep(s, "var_name", "value_name")),
    "deduplicate": lambda df, s: reshape.deduplicate(df, **_keep(s, "subset", "keep", "order_by")),
    "fill_nulls": lambda df, s: reshape.fill_nulls(df, s.get("columns", []), s["strategy"], **_keep(s, "constant_value", "order_by", "partition_by")),
    "compute": lambda df, s: udf.checked(udf.compute(df, s["function"], s["input_columns"], s["output_column"])),
}


def run(steps: list[dict], tables: dict[str, DataFrame], observe: bool = False) -> dict[str, StepResult]:
    """A StepResult per step, lazy until an action. tables: by the name that load steps give in ``table`` (or file_id).

    A step names its ``input`` (join: left and right); a validate step raises if a rule of severity error fails; ``contract`` on a step
    is checked likewise. A step that several others read is written to the shared folder at once, so that it isn't run again, also after a lost executor; release deletes it. A save step writes its input to ``path`` (or file_name) at once, by
    the file's extension, and its report holds rows, format, bytes and path. seconds: how long a step took to plan, and a save or validate step to run.
    observe: count each step's rows while an action runs. A sort's input is then written first: a sort by ranges reads its input twice, which would count its rows twice.
    """
    made: dict[str, StepResult] = {}
    readers = Counter(x for s in steps for x in (s.get("input"), s.get("left"), s.get("right")) if x)

    def of(name: str, step: dict) -> DataFrame:
        if name not in made:
            raise StepError(f"step {step['name']!r}: no earlier step is called {name!r}")
        return made[name].frame

    for step in steps:
        name, kind = step["name"], step["type"]
        if name in made:
            raise StepError(f"two steps are called {name!r}")
        before: list[str] = []
        began, report = time.monotonic(), None
        if kind == "load":
            source = step.get("table", step.get("file_id"))
            if source not in tables:
                raise StepError(f"step {name!r}: no table {source!r}")
            frame = tables[source]
        elif kind == "join":
            left, right = of(step["left"], step), of(step["right"], step)
            before = left.columns + right.columns
            frame = transform.join(left, right, step["on"], step.get("how", "inner"), step.get("null_safe", False))
        elif kind == "sql":
            first = of(step["input"], step)
            before = first.columns
            frame = sqlstep.sql(step["query"], input=first, **{k: of(v, step) for k, v in step.get("inputs", {}).items()})
        elif kind == "validate":
            frame = of(step["input"], step)
            before = frame.columns
            if not (result := quality.verdict(quality.validate(frame, step["rules"])))["passed"]:
                raise StepError(f"step {name!r}: {result['errors']} rules failed")
        elif kind == "save":
            frame = of(step["input"], step)
            before = frame.columns
            report = tables_io.save(frame, step["path"] if "path" in step else step["file_name"], step.get("mode", "overwrite"))
        elif kind in STEPS:
            source_frame = of(step["input"], step)
            before = source_frame.columns
            if observe and kind == "sort":
                source_frame = cut(source_frame, "before-sort")
            frame = STEPS[kind](source_frame, step)
        else:
            raise StepError(f"step {name!r}: unknown type {kind!r}")
        if step.get("contract"):
            found = contracts.violations(frame, step["contract"]).where("severity = 'error'").first()
            if found:
                raise StepError(f"step {name!r}: {found['message']}")
        seen = None
        if observe:
            seen = Observation(f"step {name}")
            frame = frame.observe(seen, F.count(F.lit(1)).alias("rows"))
        path = None
        if readers[name] > 1 and kind != "load":
            frame, path = cut_at(frame, "reused")
        inputs = [made[x] for x in (step.get("input"), step.get("left"), step.get("right"), *step.get("inputs", {}).values()) if x in made]
        made[name] = StepResult(name, kind, frame, before, seen, inputs, report, time.monotonic() - began, path)
    return made


def release(made: dict[str, StepResult]) -> None:
    """Delete the tables that run wrote for steps with several readers; what reads them can't be run any more."""
    for r in made.values():
        if r.path:
            discard(r.frame.sparkSession, r.path)


def trial(steps: list[dict], tables: dict[str, DataFrame], rows: int = 100) -> dict:
    """The steps on at most ``rows`` rows of each table: success, columns of the last step, error."""
    try:
        made = run(steps, {k: df.limit(rows) for k, df in tables.items()})
        last = next(reversed(made.values())).frame
        last.limit(rows).collect()
        return {"success": True, "columns": last.columns, "error": None}
    except Exception as e:  # noqa: BLE001  the report is the point
        return {"success": False, "columns": [], "error": str(e).splitlines()[0]}


def check(steps: list[dict], schemas: dict[str, DataFrame]) -> list[str]:
    """Errors of a step list found on empty tables, without reading rows; later steps are checked where their inputs exist."""
    errors, good = [], []
    empty = {k: df.limit(0) for k, df in schemas.items()}
    for step in steps:
        try:
            run([*good, step], empty)
            good.append(step)
        except Exception as e:  # noqa: BLE001  all misses are reported at once
            errors.append(f"{step.get('name')}: {str(e).splitlines()[0]}")
    return errors


def revenue_report(orders: str, customers: str, status: str = "completed", status_column: str = "status", key: str = "customer_id", amount: str = "amount", order: str = "order_id", groups=("region", "tier")) -> list[dict]:
    return [
        {"name": "orders", "type": "load", "table": orders}, {"name": "customers", "type": "load", "table": customers},
        {"name": "completed", "type": "filter", "input": "orders", "column": status_column, "operator": "equals", "value": status},
        {"name": "joined", "type": "join", "left": "completed", "right": "customers", "on": key, "how": "inner"},
        {"name": "revenue", "type": "aggregate", "input": "joined", "group_by": list(groups), "aggregations": [{"column": amount, "function": "sum"}, {"column": order, "function": "count"}, {"column": amount, "function": "mean"}]},
        {"name": "report", "type": "sort", "input": "revenue", "by": [f"{amount}_sum"], "ascending": [False]},
    ]


def segmentation(orders: str, key: str = "customer_id", amount: str = "amount") -> list[dict]:
    return [
        {"name": "orders", "type": "load", "table": orders},
        {"name": "metrics", "type": "aggregate", "input": "orders", "group_by": [key], "aggregations": [{"column": amount, "function": f} for f in ("sum", "count", "mean")]},
        {"name": "segments", "type": "sort", "input": "metrics", "by": [f"{amount}_sum", key], "ascending": [False, True]},
    ]


def quality_audit(source: str, by=()) -> list[dict]:
    return [
        {"name": "source", "type": "load", "table": source}, {"name": "unique", "type": "deduplicate", "input": "source", "keep": "first"},
        {"name": "filled", "type": "fill_nulls", "input": "unique", "strategy": "constant", "columns": [], "constant_value": "MISSING"},
        {"name": "audit", "type": "sort", "input": "filled", "by": list(by), "ascending": [True]},
    ]


def source_merge(a: str, b: str, key: str = "id") -> list[dict]:
    return [
        {"name": "a", "type": "load", "table": a}, {"name": "b", "type": "load", "table": b},
        {"name": "merged", "type": "join", "left": "a", "right": "b", "on": key, "how": "outer"},
        {"name": "unique", "type": "deduplicate", "input": "merged", "keep": "first"},
    ]


def weekly_rollup(source: str, by=(), n: int = 10_000) -> list[dict]:
    return [
        {"name": "daily", "type": "load", "table": source}, {"name": "preview", "type": "sample", "input": "daily", "n": n, "random_state": 42},
        {"name": "unique", "type": "deduplicate", "input": "preview", "keep": "first"}, {"name": "rollup", "type": "sort", "input": "unique", "by": list(by), "ascending": [True]},
    ]


TEMPLATES = {"sales_revenue_report": revenue_report, "customer_segmentation": segmentation, "data_quality_audit": quality_audit, "multi_source_merge": source_merge, "weekly_rollup": weekly_rollup}
