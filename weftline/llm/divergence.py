"""How the sources of a language differ: term shares as run-length columns, compared run by run."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, prepare, readable

#: Distinct (group, term) entries that a task gathers before it hands them on; cells (rows times sources) of a block of columns.
GATHERED, CELLS = 1 << 19, 1 << 22
#: Bytes as terms have them: A-Z lower-cased, letters and bytes of other alphabets kept, everything else a space.
LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: longest stretches of ASCII letters and characters beyond ASCII; only A-Z are lower-cased."""
    return text.translate(LETTERS).split()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(readable(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, term, source, n, docs): occurrences of each term in each source of a language, and how many documents there hold it.

    A task counts before anything is shuffled; one shuffle by (lang, term) then serves the sums by source here and by language in kept_terms.
    """

    def flush(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            words = list(n)
            for k in range(0, len(words), 50_000):
                some = words[k : k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some)), pa.array([source] * len(some)), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[w] for w in some], pa.int64()), pa.array([df[w] for w in some], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        entries = 0
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                words, before = terms(text), len(n)
                n.update(words)
                df.update(set(words))
                entries += len(n) - before
                if entries >= GATHERED:
                    yield from flush(held)
                    held, entries = {}, 0
        yield from flush(held)

    rows = _named(docs).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, total, counts: source -> n) of the terms that at least least_docs documents of the language hold."""
    by_term = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("counts"))
    return by_term.where(F.col("docs") >= least_docs).drop("docs")


def share(count: Column | str, size: Column | str) -> Column:
    """1 + floor(10^9 * (count + 5) / size), exact: decimals without digits behind the point, divided as integers."""
    exact = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")
    top = (exact(count) + F.lit(5).cast("decimal(19,0)")) * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", top, exact(size))


def run_lengths(values: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A column as runs: (end of each run, its value). ends: where each row of the column ends, counted in terms."""
    last = np.append(values[1:] != values[:-1], True)
    return ends[last], values[last]


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """Sum of the absolute differences of two run-length columns of the same length: their boundaries are merged, and each piece counts with its length."""
    edges = np.union1d(a[0], b[0])
    gap = np.abs(a[1][np.searchsorted(a[0], edges)] - b[1][np.searchsorted(b[0], edges)])
    return int((gap * np.diff(edges, prepend=0)).sum())


def column_distances(columns: DataFrame) -> DataFrame:
    """(lang, a, b, f) for pairs of places a < b of the shares, from rows (lang, shares, weight) that are sorted by lang and shares within partitions.

    f is a partial sum: one row for each pair and block of a partition. A block holds at most CELLS shares.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        lang, shares, weights, held = None, [], [], 0
        for batch in batches:
            for name, row, weight in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                row = row.values.to_numpy()
                if shares and (name != lang or held + len(row) > CELLS):
                    yield lang, np.stack(shares), np.array(weights)
                    shares, weights, held = [], [], 0
                lang = name
                shares.append(row)
                weights.append(weight)
                held += len(row)
        if shares:
            yield lang, np.stack(shares), np.array(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shares, weights in blocks(batches):
            ends = np.cumsum(weights)
            runs = [run_lengths(shares[:, k], ends) for k in range(shares.shape[1])]
            for a in range(len(runs) - 1):
                f = [distance(runs[a], runs[b]) for b in range(a + 1, len(runs))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f)), pa.array([a] * len(f), pa.int32()), pa.array(range(a + 1, len(runs)), pa.int32()), pa.array(f, pa.int64())], ["lang", "a", "b", "f"])

    return columns.mapInArrow(run, "lang string, a int, b int, f long").groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))


def source_divergence(docs: DataFrame, least_docs: int = 30, top: int = 50) -> DataFrame:
    """For each (lang, source): its distance from every other source of the language, and the terms that it has more of than the language.

    lang, source, part, item, value, rank (from 1 by descending value, then item). Part ``pair``: item is another source, value the sum over the kept terms of the
    difference of the two shares. Part ``term``: item is a term that occurs there with a share above the language's, value the difference; at most ``top``.
    A share is 1 + floor(10^9 (n + 5) / (N + 5 V)) for n occurrences of V kept terms with N in all; kept are the terms of at least ``least_docs`` documents
    of the language. All sums are exact integers.

    The vocabulary of a language is put in the order of its shares, the source with the least text first, so that equal counts lie together. Terms that
    are alike in every source become one row with a weight before that sort, so no shared key is hot. Blocks of rows become run-length columns, and
    their partial sums are added. The result itself has a row for each pair of a language's sources; nothing else grows with their square.

    Null text, lang and source count as ''. Each row is a document, repeated ones too; a text without terms makes its group appear; a language
    without kept terms has only ``pair`` rows with value 0; a single source has no pairs. Invalid UTF-8 is replaced; other columns are left aside; an
    empty table gives none. Sources of a language and their shares fit in a row.
    """
    prepare(docs.sparkSession)
    kept = cut(kept_terms(term_counts(docs), least_docs), "kept")
    groups = _named(docs).select("lang", "source").distinct()
    each = kept.select("lang", "term", "total", F.explode("counts").alias("source", "n"))
    in_group = each.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    in_lang = kept.groupBy("lang").agg((F.sum("total") + 5 * F.count("*")).alias("lang_size"), F.count("*").alias("v"))
    sized = groups.join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").select("lang", "source", (F.coalesce("n", F.lit(0)) + 5 * F.coalesce("v", F.lit(0))).alias("size"), "lang_size")
    sized = cut(sized, "groups")  # a row for each (lang, source)
    listed = sized.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("size", "source"))).alias("sources"))

    shares = F.transform("sources", lambda s: share(F.coalesce(F.col("counts")[s["source"]], F.lit(0)), s["size"]))
    alike = kept.join(listed, "lang").select("lang", shares.alias("shares")).groupBy("lang", "shares").agg(F.count("*").alias("weight"))
    sums = column_distances(alike.repartitionByRange("lang", "shares").sortWithinPartitions("lang", "shares"))
    pairs = listed.select("lang", "sources", F.posexplode("sources").alias("a", "s")).select("lang", "a", F.col("s.source").alias("source"), F.posexplode("sources").alias("b", "o")).where("a <> b")
    pairs = pairs.select("lang", "source", F.col("o.source").alias("item"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(sums, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("f", F.lit(0)).alias("value"))

    more = each.join(sized, ["lang", "source"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (share("n", "size") - share("total", "lang_size")).alias("value")).where("value > 0")
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", place).unionByName(more.withColumn("rank", place).where(F.col("rank") <= top))
