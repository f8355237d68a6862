"""The SQL step: one read-only statement over named inputs."""

from __future__ import annotations

import re

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from ..functions.arguments import StepError

#: Words that a statement may not use outside literals, quoted names and comments.
REFUSED = (
    "insert update delete drop create alter truncate merge replace grant revoke attach detach copy export import install load call execute pragma set reset use "
    "vacuum analyze cache uncache refresh add msck repair unset comment lock declare"
).split()
FILE_FUNCTIONS = "read_csv read_json read_parquet read_files read_text input_file_name java_method reflect try_reflect".split()
_HIDDEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.|\"\")*\"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/", re.S)


def check_sql(query: str) -> None:
    """One SELECT or WITH; no writing or admin words, file functions, file tables or addresses outside literals and comments."""
    quoted = _HIDDEN.sub(lambda m: m[0] if m[0].startswith("`") else " ", query)  # without literals and comments, with quoted names
    files = re.findall(r"\b(?:parquet|csv|json|orc|text|binaryfile|avro|delta)\s*\.\s*`", quoted, re.I)
    bare = _HIDDEN.sub(" ", query).strip().rstrip(";").strip()
    if not re.match(r"(?is)\(?\s*(select|with)\b", bare):
        raise StepError("sql: only SELECT or WITH statements are accepted")
    if ";" in bare:
        raise StepError("sql: one statement only")
    words = set(re.findall(r"[a-z_]+", bare.lower()))
    calls = set(re.findall(r"([a-z_]+)\s*\(", bare.lower()))
    starts = set(re.findall(r"(?:^|[(;)]|\bas\b)\s*([a-z]+)", bare.lower()))
    bad = (words & set(REFUSED) - {"replace", "set", "add", "load", "comment", "use", "call", "lock", "import", "export", "copy", "cache", "refresh", "analyze", "truncate"}) | (starts & set(REFUSED))
    if bad - calls:
        raise StepError(f"sql: {', '.join(sorted(bad - calls)).upper()} isn't accepted")
    if files or calls & set(FILE_FUNCTIONS) or "://" in bare:
        raise StepError("sql: files and addresses aren't accepted; name the inputs")


def _parts(seq) -> list:
    return [seq.apply(k) for k in range(seq.size())]


def foreign_relations(spark: SparkSession, text: str, names: set[str]) -> list[str]:
    """Relations in the parsed statement that are neither among names nor a WITH query in whose scope they stand: tables, files, anything else.

    Spark's own parser decides, so that comments, quoting and format names can't hide a relation.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    found: list[str] = []

    def within(node, known: set[str]) -> None:
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            name = [str(x) for x in _parts(node.multipartIdentifier())]
            if len(name) > 1 or name[0].lower() not in known:
                found.append(".".join(name))
        elif kind == "UnresolvedWith":
            for pair in _parts(node.cteRelations()):
                name = {str(pair._1()).lower()}
                within(pair._2(), known | name if node.allowRecursion() else known)
                known = known | name
            within(node.child(), known)
            return
        elif kind == "UnresolvedFunction" and (name := ".".join(map(str, _parts(node.nameParts())))).lower().split(".")[-1] in FILE_FUNCTIONS:
            found.append(f"{name}()")
        elif kind.endswith("WithUnresolvedIdentifier"):
            found.append("IDENTIFIER()")
        for other in [*_parts(node.children()), *(_parts(node.expressions()) if hasattr(node, "expressions") and _is_plan(node) else [])]:
            within(other, known)
        if _is_subquery(node):
            within(node.plan(), known)

    within(plan, {n.lower() for n in names})
    return found


def _is_plan(node) -> bool:
    return _instance(node, "org.apache.spark.sql.catalyst.plans.QueryPlan")


def _is_subquery(node) -> bool:
    return _instance(node, "org.apache.spark.sql.catalyst.expressions.PlanExpression")


def _instance(node, kind: str) -> bool:
    jvm = SparkSession.getActiveSession()._jvm
    return jvm.org.apache.spark.util.Utils.classForName(kind, True, False).isInstance(node)


def sql(query: str, **inputs: DataFrame) -> DataFrame:
    """The query over {{name}} inputs; with one input it is {{input}} in any case. Only the inputs and its own WITH queries can be read."""
    check_sql(re.sub(r"\{\{\s*(\w+)\s*\}\}", r"\1", query))
    first = next(iter(inputs.values()))
    inputs.setdefault("input", first)
    named = set(re.findall(r"\{\{\s*(\w+)\s*\}\}", query))
    if missing := named - set(inputs):
        raise StepError(f"sql: no input called {', '.join(sorted(missing))}")
    try:
        foreign = foreign_relations(first.sparkSession, re.sub(r"\{\{\s*(\w+)\s*\}\}", r"__\1__", query), {f"__{n}__" for n in named})
    except ParseException as e:
        raise StepError(f"sql: {e}") from e
    if foreign:
        raise StepError(f"sql: {', '.join(foreign)} isn't an input; name the inputs")
    text = re.sub(r"\{\{\s*(\w+)\s*\}\}", "\x00\\1\x01", query).replace("{", "{{").replace("}", "}}").replace("\x00", "{").replace("\x01", "}")
    return first.sparkSession.sql(text, **{k: inputs[k] for k in named})
