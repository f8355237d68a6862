"""Runs: stretches of words that repeat with a period, found by longest common extensions in suffix trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, readable

RUN = T.StructType([T.StructField(name, T.LongType(), False) for name in ("start", "length", "period")])


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of non-negative integers, closed by a symbol of its own that is less than all others.

    first, last: the stretch of the sequence on the edge to each node; child: node * width + symbol -> node. Node 0 is the root;
    suffix holds each leaf's suffix and -1 for inner nodes.
    """

    def __init__(self, sequence: list[int]):
        text = [x + 1 for x in sequence] + [0]
        n, width = len(text), max(text) + 1
        first, last, link, suffix, child = [0], [0], [0], [-1], {}
        node = edge = depth = waiting = leaves = 0
        for i, symbol in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not depth:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    first.append(i), last.append(n), link.append(0), suffix.append(leaves)
                    leaves += 1
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    length = min(last[below], i + 1) - first[below]
                    if depth >= length:
                        node, edge, depth = below, edge + length, depth - length
                        continue
                    at = first[below] + depth
                    if text[at] == symbol:
                        depth += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    inner = len(first)
                    child[key] = inner
                    first.append(first[below]), last.append(at), link.append(0), suffix.append(-1)
                    first[below] = at
                    child[inner * width + text[at]] = below
                    child[inner * width + symbol] = inner + 1
                    first.append(i), last.append(n), link.append(0), suffix.append(leaves)
                    leaves += 1
                    if unlinked:
                        link[unlinked] = inner
                    unlinked = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif depth:
                    depth -= 1
                    edge = i - waiting + 1
        self.size, self.width, self.child, self.suffix = n, width, child, suffix
        self.first, self.last = np.array(first), np.array(last)

    def _families(self, descending: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nodes by parent, where each parent's begin, where they end); symbols descend within a parent, so that a stack pops them ascending."""
        keys, nodes = (np.fromiter(x, np.int64, len(self.child)) for x in (self.child.keys(), self.child.values()))
        parent, symbol = keys // self.width, keys % self.width
        order = np.lexsort((np.where(symbol == 0, self.width, symbol) if descending else -symbol, parent))
        counts = np.bincount(parent, minlength=len(self.first))
        end = np.cumsum(counts)
        return nodes[order], end - counts, end

    def leaves(self, descending: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The Euler tour, children by ascending (or descending) symbol and the closing symbol first: the suffixes in the order of their leaves,
        and the least string depth that the tour passes on its way to each leaf, which is the depth of the lowest common ancestor with the leaf before."""
        nodes, begin, end = self._families(descending)
        nodes, begin, end, suffix = nodes.tolist(), begin.tolist(), end.tolist(), self.suffix
        length = (self.last - self.first).tolist()
        order, low, passed = [], [], 0
        stack = [(0, 0)]
        while stack:
            node, above = stack.pop()
            passed = min(passed, above)
            if suffix[node] >= 0:
                order.append(suffix[node])
                low.append(passed)
                passed = self.size
            else:
                depth = above + length[node]
                stack += [(v, depth) for v in nodes[begin[node] : end[node]]]
        return np.array(order), np.array(low)


class Extensions:
    """Longest common extensions of pairs of suffixes, each in constant time: least depth between two leaves of the tour, from a table of powers of two."""

    def __init__(self, order: np.ndarray, low: np.ndarray):
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.rows = [low.astype(np.int32)]
        while 1 << len(self.rows) <= len(low):
            half, before = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(before[:-half], before[half:]))
        self.log = np.frexp(np.arange(len(low) + 1))[1] - 1

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths for suffixes a and b, pairwise different."""
        x, y = self.rank[a], self.rank[b]
        x, y = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        level, found = self.log[y - x], np.zeros(len(x), np.int64)
        for k in np.unique(level):
            here = level == k
            found[here] = np.minimum(self.rows[k][x[here]], self.rows[k][y[here] - (1 << k)])
        return found


def _next_less(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller rank; the stretch up to there is the longest Lyndon word that begins here."""
    n = len(rank)
    after = [n] * n
    for i in range(n - 2, -1, -1):
        j, mine = i + 1, rank[i]
        while j < n and rank[j] > mine:
            j = after[j]
        after[i] = j
    return after


def runs_within(sequence: np.ndarray, least: int, times: int) -> np.ndarray:
    """All runs of a sequence of small integers: rows (start, length, period), by start, then period.

    Every run has a Lyndon root, which is the longest Lyndon word at its place for one of the two orders of the alphabet. Each such word
    is a candidate: common extensions of its two ends, forwards in the tree and backwards in the reversal's, give the run.
    """
    n = len(sequence)
    tree = SuffixTree(sequence.tolist())
    order, low = tree.leaves()
    forward = Extensions(order, low)
    down = np.empty(n + 1, np.int64)
    down[tree.leaves(descending=True)[0]] = np.arange(n + 1)
    del tree
    begin = np.tile(np.arange(n), 2)
    end = np.array(_next_less(forward.rank[:n].tolist()) + _next_less(down[:n].tolist()))
    fits = (end - begin) * times <= n
    begin, end = begin[fits], end[fits]
    ahead = forward.of(begin, end)
    del forward
    backward = Extensions(*SuffixTree(sequence[::-1].tolist()).leaves())
    behind = backward.of(n - begin, n - end)
    period = end - begin
    found = np.stack([begin - behind, behind + period + ahead, period], 1)
    return np.unique(found[found[:, 1] >= np.maximum(least, times * period)], axis=0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def repetitive_stretches(words: np.ndarray, window: int) -> list[tuple[int, int]]:
    """(begin, end) of the stretches that are covered by windows of words that occur more than once. Hash collisions can only add to them."""
    n = len(words) - window + 1
    if n < 2:
        return []
    have, held = 0, np.zeros(len(words), np.uint64)
    power, step = 1, _mixed(words)
    while have < window:  # the window's hash, from those of its powers of two
        if window & power:
            held = (held * np.uint64(0x9E3779B97F4A7C15))[: len(step) - have] + step[have:] if have else step.copy()
            have += power
        if have < window:
            step = _mixed(step[: len(step) - power] * np.uint64(0x94D049BB133111EB) + step[power:])
        power *= 2
    held = held[:n]
    ordered = np.sort(held)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    hit = np.flatnonzero(np.isin(held, again))
    turn = np.flatnonzero(np.diff(hit) > window)
    return list(zip(hit[np.append(0, turn + 1)].tolist(), (hit[np.append(turn, len(hit) - 1)] + window).tolist()))


def find_runs(words: list, least: int = 24, times: int = 3) -> np.ndarray:
    """Runs of at least ``least`` words and ``times`` periods: rows (start, length, period), by start, then period.

    A run of period q repeats each window of least - least/times words q words later, so every word of it lies in a window that occurs twice. Only
    stretches of such windows, whole ones, get trees; most texts have none.
    """
    if times < 2 or least < times:
        raise ValueError("runs need two periods at least and no fewer words than periods")
    if len(words) < least:
        return np.zeros((0, 3), np.int64)
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    found = []
    for begin, end in repetitive_stretches(ids, least - least // times):
        small = np.unique(ids[begin:end], return_inverse=True)[1]
        found.append(runs_within(small, least, times) + np.array([begin, 0, 0]))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words but those that any run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """Runs of every whole text: doc_id, n_words, runs (start, length, period: in words, by start, then period) and collapsed (the text without repeats).

    Words are separated by ASCII white space. A run is a longest stretch that repeats with its smallest period, of at least ``least`` words and ``times`` periods.
    Null and empty texts have no words, no runs and an empty collapsed text; equal texts give equal rows, repeated rows are answered each; ids of any type
    (null too) are passed on; invalid UTF-8 is replaced; other columns are left aside; an empty table gives none. A text is the work of one
    task; its memory is a few hundred bytes for each word in repetitive stretches.
    """
    prepare(docs.sparkSession)
    list_type = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN.fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, ends, found, texts = [], [0], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                runs = find_runs(words, least, times)
                counts.append(len(words))
                ends.append(ends[-1] + len(runs))
                found.append(runs)
                texts.append(collapse(words, runs))
            flat = np.concatenate([*found, np.zeros((0, 3), np.int64)])
            rows = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, k])) for k in range(3)], fields=list(list_type.value_type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=list_type), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    kept = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)), T.StructField("collapsed", T.StringType())])
    return docs.select("doc_id", readable("text")).mapInArrow(run, kept)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, with periodic text put into each document whose crc32 of the id (null: the empty text) is divisible by ten: from word a on, the p words that begin at a repeat up to the end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", readable("text").alias("text"), h.alias("h"))
    split = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    placed = split.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.expr("1 + (size(words) - a) div (3 + floor(h / 10) % 8)"))
    text = F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")
    return placed.select("doc_id", F.when(F.col("a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The digest columns of periodic_runs' rows: n_runs, the run of the greatest exact length / period (ties: smallest start, then period), hashes."""
    best = F.expr("aggregate(runs, cast(null as struct<start:bigint,length:bigint,period:bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    rows = found.withColumn("best", best)
    lines = F.expr("concat_ws('', transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')))")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
