"""Schema drift, snapshots and likely renames."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names are taken for one another from this similarity on; equal semantic types raise it by BONUS.
THRESHOLD, BONUS = 0.85, 1.2


def drift(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """change (added, removed, type_changed), severity and types of two (column, dtype) tables; key columns keep many tables apart."""
    on = [*key, "column"]
    both = old.withColumnRenamed("dtype", "old_type").join(new.withColumnRenamed("dtype", "new_type"), on, "full_outer")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").when(F.col("old_type") != F.col("new_type"), "type_changed")
    out = both.withColumn("change", change).where("change is not null")
    return out.select(*on, "change", F.when(F.col("change") == "added", "info").when(F.col("change") == "removed", "breaking").otherwise("warning").alias("severity"), "old_type", "new_type")


def schema_rows(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")


def latest_drift(snapshots: DataFrame) -> DataFrame:
    """Drift between the two newest snapshots of every file. snapshots: file_id, captured_at, dtypes map<string,string>."""
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("captured_at")))
    two = snapshots.withColumn("rank", rank).where("rank <= 2")
    have = two.groupBy("file_id").agg(F.count("*").alias("n")).where("n = 2").select("file_id")
    rows = two.join(have, "file_id").select("file_id", "rank", F.explode("dtypes").alias("column", "dtype"))
    return drift(rows.where("rank = 2").drop("rank"), rows.where("rank = 1").drop("rank"), ("file_id",))


def winklers(a: Sequence[str], b: Sequence[str]) -> np.ndarray:
    """Jaro-Winkler similarities (prefix weight 0.1, up to 4 letters, from a Jaro similarity over 0.7 on) of the texts of two lists, place by place.

    All pairs of the lists go letter by letter at once, so the loop is as long as the longest text, not as the lists.
    """
    n = len(a)
    la, lb = (np.fromiter(map(len, x), np.int64, n) for x in (a, b))
    width = max(int(la.max(initial=0)), int(lb.max(initial=0)), 1)
    x, y = (np.frombuffer("".join(t.ljust(width, "\0") for t in of).encode("utf-32-le"), np.uint32).reshape(n, width) for of in (a, b))
    place = np.arange(width)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    in_a, in_b = place < la[:, None], place < lb[:, None]
    free, taken = in_b.copy(), np.zeros((n, width), bool)
    for i in range(width):
        open_ = free & (y == x[:, i : i + 1]) & (np.abs(place - i) <= reach) & in_a[:, i : i + 1]
        hit = open_.any(1)
        taken[:, i] = hit
        rows = np.flatnonzero(hit)
        free[rows, open_.argmax(1)[rows]] = False
    m = taken.sum(1)
    mine = np.take_along_axis(x, np.argsort(~taken, 1, kind="stable"), 1)
    theirs = np.take_along_axis(y, np.argsort(~(in_b & ~free), 1, kind="stable"), 1)
    swaps = ((mine != theirs) & (place < m[:, None])).sum(1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - swaps) / m) / 3, 0.0)
    same = (x == y) & in_a & in_b
    prefix = np.cumprod(same[:, :4], 1).sum(1)
    return np.where((la == lb) & (same.sum(1) == la), 1.0, np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro))


def winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity of two texts."""
    return float(winklers([a], [b])[0])


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(np.concatenate([winklers(a[k : k + 2000].tolist(), b[k : k + 2000].tolist()) for k in range(0, len(a), 2000)]) if len(a) else [], dtype="float64")


def _shared(threshold: float, prefix: int) -> float:
    """What m/|a| + m/|b| is at least, for m shared letters of two names whose similarity is at least threshold and whose common beginning has prefix letters (four: or more)."""
    return 3 * (threshold - 0.1 * prefix) / (1 - 0.1 * prefix) - 1


#: Letters by how often they occur in names of columns, the rare ones first; others are rarer still. Any order finds the same pairs.
RARE_FIRST = "zqjxkvbywgpfmucdlhrsnioate_"


def _described(names: DataFrame, key: tuple[str, ...], side: str) -> DataFrame:
    """Distinct names in lower case with their length and letters; a letter's second occurrence is another letter."""
    low = names.select(*key, F.col("name").alias(f"{side}_name"), F.lower("name").alias("low")).where("low IS NOT NULL AND low <> ''").distinct()
    marked = F.expr(f"transform(split(low, ''), (c, i) -> struct(-size(filter(slice(split(low, ''), 1, i + 1), x -> x = c)) AS nth, instr('{RARE_FIRST}', c) AS place, c))")
    return low.select(*key, f"{side}_name", F.col("low").alias(f"{side}_low"), F.length("low").alias(f"{side}_n"), F.array_sort(marked).alias(f"{side}_letters"))


def similar_names(old: DataFrame, new: DataFrame, key: tuple[str, ...] = (), threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of names (key, name) of old and new within a key whose Jaro-Winkler similarity, in lower case, is at least threshold: key, old_name, new_name, s.

    Exact, and without comparing all with all. A pair of similarity t shares so many letters, depending on its common beginning: with one (of 1 to 4 letters, four
    stand for more) it meets by the first letter; with none it must share more of them, and meets by prefix filtering: with lengths a and b and c letters to be shared, one
    of the first a - c + 1 letters of the one, the rare ones first, is among the first b - c + 1 of the other. Pairs that share too few letters are left out before
    they are scored. threshold: over 0.7. Null and empty names have no partners; equal names are answered once.
    """
    a, b = _described(old, key, "old"), _described(new, key, "new")
    begin = F.expr("case when left(old_low, 4) = left(new_low, 4) and least(old_n, new_n) >= 4 then 4 when left(old_low, 3) = left(new_low, 3) and least(old_n, new_n) >= 3 then 3 when left(old_low, 2) = left(new_low, 2) and least(old_n, new_n) >= 2 then 2 when left(old_low, 1) = left(new_low, 1) then 1 else 0 end")
    share = lambda n: n * (1 / F.col("old_n") + 1 / F.col("new_n")) + 1e-9
    shared = F.size(F.array_intersect("old_letters", "new_letters"))
    columns = [*key, "old_name", "new_name", "old_low", "new_low"]
    first = [d.withColumn("beginning", F.left(F.col(f"{s}_low"), F.lit(1))) for d, s in ((a, "old"), (b, "new"))]
    wanted = F.element_at(F.array(*[F.lit(_shared(threshold, k)) for k in (1, 2, 3, 4)]), begin)
    alike = first[0].join(first[1], [*key, "beginning"]).where((share(F.least("old_n", "new_n")) >= wanted) & (share(shared) >= wanted)).select(*columns)
    need = _shared(threshold, 0)
    ratio = need - 1  # the shorter name's share of the longer one's length

    def dealt(d: DataFrame, mine: str, other: str) -> DataFrame:
        lengths = F.sequence(F.ceil(F.col(f"{mine}_n") * ratio - 1e-9), F.floor(F.col(f"{mine}_n") / ratio + 1e-9))
        each = d.select("*", F.explode(F.transform(lengths, lambda n: n.cast("int"))).alias(f"{other}_n"))
        least = F.ceil(need * F.col("old_n") * F.col("new_n") / (F.col("old_n") + F.col("new_n")) - 1e-9)
        return each.select("*", F.explode(F.slice(f"{mine}_letters", F.lit(1), (F.col(f"{mine}_n") - least + 1).cast("int"))).alias("letter"))

    pairs = dealt(a, "old", "new").join(dealt(b, "new", "old"), [*key, "old_n", "new_n", "letter"]).where(begin == 0)
    apart = pairs.where(share(shared) >= need).select(*columns).distinct()
    return alike.unionAll(apart).withColumn("s", similarity("old_low", "new_low")).where(F.col("s") >= threshold).select(*key, "old_name", "new_name", "s")


def rename_candidates(old: DataFrame, new: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of a removed and an added column that look like one renamed: key, old_name, new_name, similarity, type_match, confidence.

    old, new: (key, column, semantic_type); key columns keep many tables apart, without them old and new are one table. See similar_names.
    """
    removed = old.join(new, [*key, "column"], "left_anti").select(*key, F.col("column").alias("name"), F.col("semantic_type").alias("old_type"))
    added = new.join(old, [*key, "column"], "left_anti").select(*key, F.col("column").alias("name"), F.col("semantic_type").alias("new_type"))
    pairs = similar_names(removed, added, key)
    pairs = pairs.join(removed.withColumnRenamed("name", "old_name"), [*key, "old_name"]).join(added.withColumnRenamed("name", "new_name"), [*key, "new_name"])
    match = F.coalesce(F.col("old_type") == F.col("new_type"), F.lit(False))
    out = pairs.select(*key, "old_name", "new_name", F.round("s", 4).alias("similarity"), match.alias("type_match"), F.round(F.least(F.lit(1.0), F.col("s") * F.when(match, BONUS).otherwise(1.0)), 4).alias("confidence"))
    return out.orderBy(F.desc("confidence"), *key, "old_name", "new_name")


def match_columns(queries: DataFrame, available: list[str] | DataFrame) -> DataFrame:
    """For each name in queries (name): the available column (a list, or rows of name) it means, equal but for case first, else the most similar from THRESHOLD on."""
    have = available if isinstance(available, DataFrame) else queries.sparkSession.createDataFrame([(c,) for c in available], "name string")
    pairs = similar_names(queries.select("name"), have.select("name")).withColumn("score", F.when(F.lower("old_name") == F.lower("new_name"), F.lit(2.0)).otherwise(F.col("s")))
    best = pairs.groupBy(F.col("old_name").alias("name")).agg(F.max_by("new_name", F.struct("score", "new_name")).alias("match"), F.least(F.max("score"), F.lit(1.0)).alias("score"))
    return queries.select("name").distinct().join(best, "name", "left").select("name", "match", F.round("score", 4).alias("score"))
