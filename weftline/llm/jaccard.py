"""N-gram Jaccard join: T-occurrence search (DivideSkip) over inverted lists of word shingles."""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, cut, prepare, private, whole_texts

#: Words of a shingle; documents link from this percentage of common shingles on.
WORDS, PERCENT = 5, 75
#: Documents of an index chunk.
CHUNK = 256
#: Shingle hashes keep this many bits: 6 bytes each in files. Within a pair of documents a collision has probability below 1e-8.
BITS = 48
#: Frequent shingles are found on about so many texts: those in at least COMMON of them, FREQUENT at most. They come last in the order of
#: shingles, whatever their number; any order gives the same links, so the sample bounds work and not results.
SAMPLE, COMMON, FREQUENT = 5000, 20, 100_000
#: The order of shingles is their number's: how many texts hold them (no more than OFTEN is told apart, one more for the frequent), then the hash.
OFTEN = (1 << 63 - BITS) - 2
#: Shingles that a task bundles before it deals them, shingles of a bucket that is counted at once, and texts whose names a task remembers.
BUNDLE, BUCKET, SEEN = 1 << 20, 1 << 22, 1_000_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = np.random.default_rng(20240607).integers(1, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, as bytes: there lower and split know ASCII only."""
    return (text or "").encode().lower().split()


def name_of(words: list[bytes]) -> int | None:
    """A number below 2^63 that texts of equal words share; None without words."""
    return xxhash.xxh3_64_intdigest(b" ".join(words), 1) >> 1 if words else None


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's words; fewer than WORDS words are one shingle; none without words."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(hashes)
    if n < WORDS:
        made = (hashes * _P[:n]).sum(keepdims=True) + np.uint64(n)  # its own family: the length enters
    else:
        made = sum(hashes[k : n - WORDS + 1 + k] * _P[k] for k in range(WORDS))
    return np.unique(_mix(made) >> np.uint64(64 - BITS))


def pack(hashes: np.ndarray) -> bytes:
    """Sorted hashes by byte planes, compressed: the high planes hardly take room."""
    return zstandard.compress(np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : BITS // 8].T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(BITS // 8, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : BITS // 8] = planes.T
    return out.view("<u8").ravel()


class Index:
    """Inverted lists over a chunk of documents; each list holds ascending places of documents.

    sets: the shingles that a document shares with any other one; sizes: the numbers of all its shingles.
    """

    def __init__(self, sets: list[np.ndarray], sizes: list[int] | None = None):
        held = np.fromiter(map(len, sets), np.int64, len(sets))
        self.sizes = held if sizes is None else np.asarray(sizes, np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), held)
        order = np.argsort(flat, kind="stable")
        self.keys, begin = np.unique(flat[order], return_index=True)
        self.begin = np.append(begin, len(flat))
        self.held = owner[order].tolist()

    def lists(self, query: np.ndarray) -> list[tuple[int, int]]:
        """Begin and end of the lists of the query's shingles, short ones first."""
        if not len(self.keys):
            return []
        at = np.searchsorted(self.keys, query)
        at[at == len(self.keys)] = 0
        hit = at[self.keys[at] == query]
        begin, end = self.begin[hit], self.begin[hit + 1]
        order = np.argsort(end - begin, kind="stable")
        return list(zip(begin[order].tolist(), end[order].tolist()))

    def search(self, query: np.ndarray, size: int, skip: Callable[[int], bool]) -> Iterator[int]:
        """Places of the documents that link with the query: those that occur in at least T of its lists.

        DivideSkip: the longest lists are set aside; the short ones are merged by a heap, and a document that occurs there often enough is
        looked up in the long ones by binary search, until it has T or cannot reach it. T depends on the document's size; the smallest T
        that any can have divides the lists. Documents that skip names are passed over. size: the number of all shingles of the query.
        """
        lists = self.lists(query)
        least = -(-PERCENT * size // 100)  # |x & y| >= 0.75 |x | y| >= 0.75 |x|
        if len(lists) < least:
            return
        longest = lists[-1][1] - lists[-1][0]
        aside = min(least - 1, int(least / (0.02 * np.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        for doc, seen in self._heap_merge([self.held[b:e] for b, e in short], least - aside):
            m = int(self.sizes[doc])
            need = -(-PERCENT * (size + m) // (100 + PERCENT))
            if need > min(size, m) or seen + aside < need or skip(doc):
                continue
            for k, (b, e) in enumerate(long):
                if seen >= need or seen + aside - k < need:
                    break
                at = bisect_left(self.held, doc, b, e)
                seen += at < e and self.held[at] == doc
            if seen >= need:
                yield doc

    @staticmethod
    def _heap_merge(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
        """(document, lists that hold it) for those in at least ``least`` of the lists."""
        last, seen = -1, 0
        for doc in heapq.merge(*lists):
            if doc != last:
                if seen >= least and last >= 0:
                    yield last, seen
                last, seen = doc, 0
            seen += 1
        if seen >= least and last >= 0:
            yield last, seen


#: name, label of its class so far, number of all shingles, the largest such number of a text that it can link with, the lists that it is searched in (ascending), the
#: shared shingles (packed; None before they are needed).
Member = tuple[int, int, int, int, list[int], bytes | None]


def comparable(left: list[Member], right: list[Member] | None, here: int) -> Iterator[tuple[int, int]]:
    """(place in right or, if that is None, in left; bits of the places in left) of the pairs to be searched for in list ``here``.

    A pair belongs to the first of its common lists; sizes, the sizes that both can link with and labels must allow a new link.
    """
    elsewhere: dict[int, int] = {}  # earlier list: bits of the places in left that are in it too
    for place, (_, _, _, _, lists, _) in enumerate(left):
        for k in lists:
            if k >= here:
                break
            elsewhere[k] = elsewhere.get(k, 0) | 1 << place
    every = (1 << len(left)) - 1
    same: dict[int, int] = {}  # label: bits of its places in left
    for place, m in enumerate(left):
        same[m[1]] = same.get(m[1], 0) | 1 << place
    order = sorted(range(len(left)), key=lambda p: left[p][2])
    sizes, upto = [left[p][2] for p in order], [0]
    for p in order:
        upto.append(upto[-1] | 1 << p)
    order = sorted(range(len(left)), key=lambda p: left[p][3])
    most, below = [left[p][3] for p in order], [0]
    for p in order:
        below.append(below[-1] | 1 << p)
    for at, (_, label, size, largest, lists, _) in enumerate(left if right is None else right):
        met = same.get(label, 0)
        for k in lists:
            if k >= here:
                break
            met |= elsewhere.get(k, 0)
        bits = every & ~met & upto[bisect_right(sizes, largest)] & ~below[bisect_left(most, size)]
        if right is None:
            bits &= (1 << at) - 1
        if bits:
            yield at, bits


def _places(bits: int) -> Iterator[int]:
    while bits:
        bit = bits & -bits
        bits ^= bit
        yield bit.bit_length() - 1


def link_chunks(left: list[Member], right: list[Member] | None, here: int) -> list[tuple[int, int]]:
    """Links within left (right None) or between left and right, as the edges of a spanning forest.

    Documents whose labels are already joined aren't compared again, so a group of near copies costs about a comparison each.
    """
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while (up := parent.get(k, k)) != k:
            parent[k] = k = parent.get(up, up)
        return k

    index, edges = None, []
    for at, bits in comparable(left, right, here):
        name, label, size, _, _, held = (left if right is None else right)[at]
        wanted = {p for p in _places(bits) if root(left[p][1]) != root(label)}
        if not wanted:
            continue
        index = index or Index([unpack(m[5]) for m in left], [m[2] for m in left])
        for doc in index.search(unpack(held), size, lambda d: d not in wanted or root(left[d][1]) == root(label)):
            a, b = root(left[doc][1]), root(label)
            parent[max(a, b)] = min(a, b)
            edges.append((name, left[doc][0]))
    return edges


def _new(names: list[int | None], seen: set[int]) -> list[bool]:
    """Whether each name is met for the first time in this task (again, if more than SEEN others lie between); None never is."""
    out = []
    for name in names:
        out.append(name is not None and name not in seen)
        if out[-1]:
            if len(seen) >= SEEN:
                seen.clear()
            seen.add(name)
    return out


def _is_in(hashes: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(hashes), bool)
    at = np.searchsorted(sorted_keys, hashes)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == hashes


def text_facts(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, text_name (null without shingles or id) and the text's shingles among ``frequent`` (packed) of every row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, held = [], [], []
            for known, text in zip(batch.column(0).is_valid().to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                made = shingles(words)
                among = made[_is_in(made, frequent)]
                names.append(name_of(words) if known else None)
                sizes.append(len(made))
                held.append(pack(among) if known and len(among) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(held, pa.binary())], ["doc_id", "n_shingles", "text_name", "frequent"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, text_name long, frequent binary")


def _bundles(batches: Iterator[pa.RecordBatch], without: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(names, hashes) of the shingles of rows (text), but for those among ``without``, by ascending hash. A task takes equal texts once."""
    names, held, n, seen = [], [], 0, set()

    def put():
        flat = np.concatenate(held)
        order = np.argsort(flat)
        return np.repeat(np.array(names, np.int64), list(map(len, held)))[order], flat[order]

    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = words_of(text)
            name = name_of(words)
            if _new([name], seen)[0]:
                hashes = shingles(words)
                names.append(name)
                held.append(hashes[~_is_in(hashes, without)])
                n += len(hashes)
                if n >= BUNDLE:
                    yield put()
                    names, held, n = [], [], 0
    if names:
        yield put()


def _deal(names: np.ndarray, hashes: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket of a bundle: steps from hash to hash and places among the row's names, by byte planes, compressed."""
    bucket = ((hashes >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.diff(bucket, prepend=-1))
    rows = []
    for b, e in zip(begin.tolist(), np.append(begin[1:], len(bucket)).tolist()):
        own, place = np.unique(names[b:e], return_inverse=True)
        planes = np.concatenate([np.diff(hashes[b:e], prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, : BITS // 8], place.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]], 1)
        rows.append((zstandard.compress(np.ascontiguousarray(planes.T).tobytes(), 1), own.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(bucket[begin]), *(pa.array(c, pa.binary()) for c in (zip(*rows) if rows else ((), ())))], ["bucket", "shingles", "names"])


def _dealt(shingles_: bytes, names: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(names, hashes) of a row that _deal made."""
    planes = np.frombuffer(zstandard.decompress(shingles_), np.uint8).reshape(BITS // 8 + 3, -1)
    wide = np.zeros((planes.shape[1], 16), np.uint8)
    wide[:, : BITS // 8], wide[:, 8:11] = planes[: BITS // 8].T, planes[BITS // 8 :].T
    both = wide.view("<u8")
    return np.frombuffer(names, np.int64)[both[:, 1].astype(np.int64)], np.cumsum(both[:, 0])


def shared_shingles(docs: DataFrame, without: np.ndarray, total: int) -> DataFrame:
    """(text_name, df, hash) of the shingles, but for those among ``without``, that df > 1 texts with an id hold. total: about how many shingles there are.

    Shingles are dealt by ranges of hashes into buckets of about BUCKET; a task counts a bucket at a time.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(1 << 30, max(parts, -(-total // BUCKET)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, hashes in _bundles(batches, without):
            yield _deal(names, hashes, buckets)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def held():
            key, rows = None, []
            for batch in batches:
                for bucket, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                    if bucket != key:
                        if rows:
                            yield rows
                        key, rows = bucket, []
                    rows.append((x, y))
            if rows:
                yield rows

        for rows in held():
            names, hashes = (np.concatenate(c) for c in zip(*(_dealt(*r) for r in rows)))
            order = np.lexsort((names, hashes))
            names, hashes = names[order], hashes[order]
            new = np.ones(len(names), bool)  # a text may come from several tasks
            new[1:] = (names[1:] != names[:-1]) | (hashes[1:] != hashes[:-1])
            names, hashes = names[new], hashes[new]
            begin = np.flatnonzero(np.diff(hashes, prepend=hashes[:1] + np.uint64(1)))
            df = np.diff(np.append(begin, len(hashes)))
            df = np.repeat(df, df)
            some = df > 1
            yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(df[some].astype(np.int32)), pa.array(hashes[some].astype(np.int64))], ["text_name", "df", "hash"])

    dealt = docs.where("doc_id is not null").select("text").mapInArrow(deal, "bucket long, shingles binary, names binary")
    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(count, "text_name long, df int, hash long")


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles that very many texts hold, by a sample bounded by SAMPLE: at most FREQUENT."""
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30))
    some = docs.where(part < int((1 << 30) * min(1.0, SAMPLE / max(1, docs.count()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes in _bundles(batches, np.zeros(0, np.uint64)):
            yield pa.RecordBatch.from_arrays([pa.array(hashes.astype(np.int64))], ["hash"])

    counts = some.where("doc_id is not null").select("text").mapInArrow(run, "hash long").groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    return np.sort(np.array([r["hash"] for r in counts.orderBy(F.desc("n"), "hash").limit(FREQUENT).collect()], np.int64)).astype(np.uint64)


def shared_sets(docs: DataFrame, facts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """text_name, n, own, prefix, shared of the texts that can link with another one.

    shared: the shingles that at least one other text holds, packed; own: how many others the text has. In the order rare before frequent, a text's
    first n - ceil(0.75 n) + 1 shingles are its prefix: linked texts have one of their prefixes' shingles in common. The text's own
    shingles come first; ``prefix`` are the shared ones among them (their numbers in that order, ascending), and texts without any are left out.
    Shingles are counted in one shuffle, for which the texts are read again: their sets are never written. Those of ``frequent`` stay out of it.
    """

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            yield batch.filter(pa.array(_new(batch.column(0).to_pylist(), seen)))

    heads = facts.where("text_name is not null").select("text_name", "n_shingles", "frequent").mapInArrow(head, "text_name long, n_shingles long, frequent binary")
    total = facts.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    counted = shared_shingles(docs, frequent, total).select("text_name", "df", "hash", F.lit(None).cast("long").alias("n"), F.lit(None).cast("binary").alias("frequent"))
    rows = counted.union(heads.select("text_name", F.lit(0), F.lit(-1).cast("long"), "n_shingles", "frequent"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "text_name").sortWithinPartitions("text_name", F.least("df", F.lit(OFTEN)), "hash")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts():
            name, n, last, held = None, 0, None, []
            for batch in batches:
                names, df, hashes = (batch.column(k).to_numpy() for k in range(3))
                begin = 0
                for end in np.append(np.flatnonzero(np.diff(names)) + 1, len(names)).tolist() if len(names) else ():
                    if names[begin] != name:
                        if name is not None:
                            yield name, n, last, held
                        name, held = int(names[begin]), []
                        n, last = batch.column(3)[begin].as_py(), batch.column(4)[begin].as_py()
                    some = df[begin:end] > 0
                    held.append(np.minimum(df[begin:end][some], OFTEN).astype(np.uint64) << np.uint64(BITS) | hashes[begin:end][some].astype(np.uint64))
                    begin = end
            if name is not None:
                yield name, n, last, held

        rows = []
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
        put = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["text_name", "n", "own", "prefix", "shared"])
        for name, n, last, held in texts():
            order = np.concatenate([*held, unpack(last) | np.uint64(OFTEN + 1 << BITS)] if last else held)
            own = n - len(order)
            first = order[: max(0, n - -(-PERCENT * n // 100) + 1 - own)]
            if len(first):
                rows.append((name, n, own, first.astype(np.int64), pack(np.sort(order & np.uint64((1 << BITS) - 1)))))
                if len(rows) >= 2000:
                    yield put()
                    rows = []
        if rows:
            yield put()

    return rows.mapInArrow(gather, "text_name long, n long, own long, prefix array<long>, shared binary")


def _groups(batches: Iterator[pa.RecordBatch], shared: bool) -> Iterator[tuple[tuple[int, int, int], list[tuple[int, Member]]]]:
    """((key, i, j), [(side, member)]) of sorted rows."""
    key, rows = None, []
    for batch in batches:
        columns = [batch.column(x).to_pylist() for x in ("key", "i", "j", "side", "text_name", "label", "n", "largest", "lists", *(["shared"] if shared else []))]
        for c, i, j, side, *row in zip(*columns):
            if (c, i, j) != key:
                if rows:
                    yield key, rows
                key, rows = (c, i, j), []
            rows.append((side, row if shared else [*row, None]))
    if rows:
        yield key, rows


def _grouped(members: DataFrame) -> DataFrame:
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "text_name")


MEMBERS = "key long, i int, j int, side int, text_name long, label long, n long, largest long, lists array<long>"


def needed_members(members: DataFrame) -> DataFrame:
    """The members that have a pair to be searched for in their group: without the others the shared shingles go to few groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
        put = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in MEMBERS.split(", ")])
        for (key, i, j), rows in _groups(batches, False):
            left, right = [r for side, r in rows if not side], None if i == j else [r for side, r in rows if side]
            first, second = 0, 0
            for at, bits in comparable(left, right, key):
                first |= bits
                second |= 1 << at
            if right is None:
                first |= second
            out += [(key, i, j, 0, *left[p][:5]) for p in _places(first)] + [(key, i, j, 1, *right[p][:5]) for p in _places(second) if right is not None]
            if len(out) >= 2000:
                yield put()
                out = []
        if out:
            yield put()

    return _grouped(members).mapInArrow(run, MEMBERS)


def search_groups(members: DataFrame, live: DataFrame) -> DataFrame:
    """(a, b) links found by T-occurrence search within each group (key, i, j).

    members: key, i, j, side, text_name, label, n, largest, lists; where i = j rows of side 0 are searched among themselves, else those of side 1 among those of
    side 0. The shared shingles are joined here, by shuffle at every size; a group holds two chunks at most.
    """
    held = _grouped(members.join(live.select("text_name", "shared").hint("merge"), "text_name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        put = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])
        for (key, i, j), rows in _groups(batches, True):
            found += link_chunks([r for side, r in rows if not side], None if i == j else [r for side, r in rows if side], key)
            if len(found) >= 5000:
                yield put()
                found = []
        if found:
            yield put()

    return held.mapInArrow(run, "a long, b long")


def _lists(rows: DataFrame) -> DataFrame:
    """One inverted list (s) of each membership, with its rows' number and its leader; lists of one text are left out."""
    leader = F.min(F.struct("own", "text_name", "n"))  # the text with the fewest shingles of its own is most like the others
    about = rows.groupBy("s").agg(F.count("*").alias("texts"), F.bit_xor(F.xxhash64("text_name")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "text_name")).alias("y"), leader.alias("leader"))
    same = about.where("texts > 1").groupBy("texts", "x", "y").agg(F.min(F.struct("s", "leader")).alias("list"))
    return same.select("list.s", "texts", F.col("list.leader.text_name").alias("leader"), F.col("list.leader.n").alias("leader_n"))


def _with_partners(known: DataFrame) -> DataFrame:
    """The rows whose list holds a row of another label with n up to their own ``largest``, and one with ``largest`` from their own n on."""
    each = cut(known.groupBy("s", "label").agg(F.min("n").alias("n"), F.max("largest").alias("largest")), "labels_of_lists")
    ends = each.groupBy("s").agg(F.min(F.struct("n", "label")).alias("low"), F.max(F.struct("largest", "label")).alias("high"))
    others = each.join(ends, "s").groupBy("s", "low", "high").agg(F.min(F.when(F.col("label") != F.col("low.label"), F.col("n"))).alias("low_else"), F.max(F.when(F.col("label") != F.col("high.label"), F.col("largest"))).alias("high_else"))
    others = cut(others.where("low_else is not null"), "mixed")  # as with lists
    low = F.when(F.col("label") == F.col("low.label"), F.col("low_else")).otherwise(F.col("low.n"))
    high = F.when(F.col("label") == F.col("high.label"), F.col("high_else")).otherwise(F.col("high.largest"))
    return known.join(others, "s").where((low <= F.col("largest")) & (high >= F.col("n"))).select(*known.columns)


def text_classes(docs: DataFrame, facts: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(text_name, class) of the texts that link with another one: class = the smallest name reachable.

    Exact for the shingle hashes: linked texts share a prefix shingle, so each pair meets in one of the inverted lists of prefix shingles. First every list's
    leader is searched among the others, a group for each leader; this joins groups of near copies. Then the lists that still hold texts of different classes are
    searched, without the leader; a pair only in the first of its common lists. As the lists are in the order of shingles, such a pair shares none of the shingles
    before that one, so a text with p of them there has at most n - p in common with the other; this bounds the other's size (``largest``), and rows
    without a text of another class in these bounds leave the list. Of a long list, rows of the most frequent class don't meet each other: they are dealt to
    the chunks of the other rows only, so a group of near copies costs about a row for each membership.
    """
    live = cut(shared_sets(docs, facts, frequent), "shared")
    every = live.select(F.posexplode("prefix").alias("at", "s"), "text_name", "n", "own")
    lists = cut(_lists(every), "lists")  # written first: else the join keeps the aggregation's partitions, and AQE can't split a hot list
    rows = cut(every.join(lists, "s").where("text_name <> leader"), "list_rows")

    near = (F.lit(100) * F.least("n", "leader_n")) >= (F.lit(PERCENT) * F.greatest("n", "leader_n"))
    pairs = cut(rows.where(near).select("leader", "leader_n", "text_name", "n").distinct(), "leaders")
    sizes = cut(pairs.groupBy("leader", "leader_n").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "leader_chunks")
    none = F.array().cast("array<long>")
    largest = lambda n: F.floor(F.lit(100) * F.col(n) / PERCENT).cast("long").alias("largest")
    follow = pairs.join(sizes.drop("leader_n"), "leader").select(F.col("leader").alias("key"), F.pmod(F.xxhash64("text_name"), F.col("chunks")).cast("int").alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"), "text_name", F.col("text_name").alias("label"), "n", largest("n"), none.alias("lists"))
    lead = sizes.select(F.col("leader").alias("key"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.lit(-1).alias("j"), F.lit(1).alias("side"), F.col("leader").alias("text_name"), F.col("leader").alias("label"), F.col("leader_n").alias("n"), largest("leader_n"), none.alias("lists"))
    stars = cut(components(search_groups(follow.union(lead), live)).select(F.col("id").alias("text_name"), F.col("component").alias("label")), "stars")

    # 100 c >= 75 (n + m - c) with c <= n - p: the text links with sizes m up to this
    bound = F.expr(f"(({100 + PERCENT}) * (n - own - at) - {PERCENT} * n) DIV {PERCENT}")
    known = rows.where("texts > 2").select("s", "text_name", "own", "n", bound.alias("largest")).join(stars, "text_name", "left").withColumn("label", F.coalesce("label", "text_name"))
    known = cut(known, "labelled_rows")
    rest = cut(_with_partners(known), "mixed_rows")
    top = rest.groupBy("s", "label").agg(F.count("*").alias("k")).groupBy("s").agg(F.max(F.struct("k", "label")).alias("top"))
    long = F.col("texts") > CHUNK
    left = _lists(rest).join(top, "s").select("s", F.when(long, F.col("top.label")).alias("top"), F.when(long, F.ceil(F.col("top.k") / CHUNK)).otherwise(0).cast("int").alias("same"), F.when(long, F.ceil((F.col("texts") - F.col("top.k")) / CHUNK)).otherwise(1).cast("int").alias("others"))
    member = cut(rest.join(cut(left, "mixed_lists"), "s"), "members")
    at = member.groupBy("text_name").agg(F.array_sort(F.collect_list("s")).alias("lists"))  # a text's own, so no more than its shingles
    member = member.join(cut(at, "lists_of_texts"), "text_name").withColumn("is_top", F.col("label").eqNullSafe(F.col("top")))
    place = F.xxhash64("text_name")
    member = member.withColumn("chunk", F.when(F.col("is_top"), F.col("others") + F.pmod(place, F.col("same"))).otherwise(F.pmod(place, F.col("others"))).cast("int"))
    last = F.when(F.col("is_top"), F.col("others")).otherwise(F.col("others") + F.col("same")) - 1
    to = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.least("chunk", k).alias("i"), F.greatest("chunk", k).alias("j")))
    member = member.select(F.col("s").alias("key"), "chunk", F.explode(to).alias("to"), "text_name", "label", "n", "largest", "lists")
    member = member.select("key", "to.i", "to.j", (F.col("chunk") != F.col("to.i")).cast("int").alias("side"), "text_name", "label", "n", "largest", "lists")
    needed = cut(needed_members(member), "needed")
    more = search_groups(needed, live)
    found = components(more.union(stars.select("text_name", "label")))
    return found.select(F.col("id").alias("text_name"), F.col("component").alias("class"))


def _classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, text_name, class of every row; text_name and class are null for rows that link with nothing."""
    docs = whole_texts(docs)
    prepare(docs.sparkSession)
    frequent = frequent_shingles(docs)
    facts = cut(text_facts(docs, frequent), "facts")
    classes = cut(text_classes(docs, facts, frequent), "classes")
    out = facts.select("doc_id", "n_shingles", "text_name").join(classes, "text_name", "left")
    return cut(out.select("doc_id", "n_shingles", "text_name", F.coalesce("class", "text_name").alias("class")), "classified")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: classes of rows linked by 100 * common >= 75 * all of their distinct shingles.

    Rows of equal words are one text from the start, named by 63 bits of a hash of its words (among 10^9 texts two share a name with
    probability 0.06). Texts that can link meet in inverted lists; see text_classes. Links go from row to row, so rows that repeat a doc_id
    with another text have classes of their own.
    doc_id may be of any type that has an order. Null and empty texts have no shingles and link with nothing; a null doc_id keeps a null component and links
    with nothing; rows that repeat are repeated in the result; an empty table gives no rows; other columns are left aside.
    """
    rows = _classes(docs)
    low = cut(rows.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("low")), "lowest")
    return rows.join(low, "class", "left").select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def one_per_class(docs: DataFrame) -> DataFrame:
    """docs without near copies: of each class the row with the smallest doc_id.

    Of rows that repeat both its id and its words, one stays; so of rows that repeat an id without any words. Rows without an id stay. Columns of docs
    keep their names and values whatever they are called.
    """
    docs = whole_texts(docs)
    rows = _classes(docs).where("class is not null")
    kept = cut(rows.groupBy("class").agg(F.min(F.struct("doc_id", "text_name")).alias("kept")), "kept")
    gone = rows.join(kept, "class").where((F.col("doc_id") != F.col("kept.doc_id")) | (F.col("text_name") != F.col("kept.text_name"))).select("doc_id", "text_name").distinct()
    name, tie, id_ = (private(docs.columns, n) for n in ("text_name", "tie", "gone_id"))
    at = docs.columns.index("text")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [name_of(words_of(t)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], [*batch.schema.names, name])

    every = docs.mapInArrow(named, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
    every = every.withColumn(tie, F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)))
    gone = gone.select(F.col("doc_id").alias(id_), F.col("text_name").alias(name + "_gone"))
    left = every.join(gone.hint("merge"), (F.col("doc_id") == F.col(id_)) & (F.col(name) == F.col(name + "_gone")), "left_anti")
    return left.dropDuplicates(["doc_id", name, tie]).select(*docs.columns)
