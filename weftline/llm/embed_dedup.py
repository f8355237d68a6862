"""Near copies among embeddings: spherical k-means cells, blocked cosine products within cells, one kept of each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, prepare

#: Vectors of a cell that cells are planned for, centres at most; vectors that the centres are fitted on at most, and their components in all.
CELL, CENTRES, SAMPLE, SAMPLE_VALUES = 4000, 4096, 20_000, 1 << 23
#: Share of pairs at the very limit of similarity, made from the sample, that must meet in a cell; pairs above the limit meet more often.
MEET = 0.98
#: Rows of a block's side.
BLOCK = 8192
#: Up to so many vectors that occur more than once are broadcast; beyond, they are joined by shuffle.
REPEATED = 200_000


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    scale = np.abs(rows).max(1, keepdims=True)
    rows = rows / scale  # so that squares neither overflow nor vanish
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    return np.array_split(rows, max(1, len(rows) // 4096))


def fit_centres(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means: unit centres, empty ones dropped."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(1) for part in _parts(sample)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        keep = length[:, 0] > 1e-9
        centres = sums[keep] / length[keep]
    return centres


def fit_margin(sample: np.ndarray, centres: np.ndarray, limit: float, meet: float = MEET, pairs: int = 4000, seed: int = 6) -> float:
    """How far below its best a centre's cosine may be for a vector to ask that cell, so that ``meet`` of the pairs at the limit meet.

    The pairs: a vector of the sample and one at exactly the limit's cosine from it, in the direction of another vector of the sample. A pair meets if either asks
    the other's cell.
    """
    rng = np.random.default_rng(seed)
    x, other = (sample[rng.integers(0, len(sample), pairs)] for _ in range(2))
    aside = other - (other * x).sum(1, keepdims=True) * x
    length = np.sqrt((aside * aside).sum(1, keepdims=True))
    keep = length[:, 0] > 1e-6
    if len(centres) < 2 or not keep.any():
        return 0.0
    x = x[keep]
    y = limit * x + np.sqrt(1 - limit * limit) * aside[keep] / length[keep]
    at = np.arange(len(x))
    to_x, to_y = x @ centres.T, y @ centres.T
    short = np.minimum(to_x.max(1) - to_x[at, to_y.argmax(1)], to_y.max(1) - to_y[at, to_x.argmax(1)])
    return float(np.quantile(short, meet)) + 1e-9


def linked_pairs(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """Whether the cosine of each row of a with each of b is at least limit: products in single precision, those near the limit again in double."""
    about = a.astype(np.float32) @ b.astype(np.float32).T
    slack = np.float32(1e-5 + 4e-7 * a.shape[1])
    out = about >= limit + slack
    i, j = np.nonzero((about >= limit - slack) & ~out)
    for p in range(0, len(i), 1 << 16):
        k, m = i[p : p + (1 << 16)], j[p : p + (1 << 16)]
        out[k, m] = (a[k] * b[m]).sum(1) >= limit
    return out


def forest(linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges (a, b) that join what the matrix of links joins; rows and columns are names."""
    left, right = rows.copy(), columns.copy()
    big = np.iinfo(np.int64).max
    some, any_ = linked.any(1), linked.any(0)
    dense = linked[some][:, any_]
    if not dense.size:
        return []
    l, r = left[some], right[any_]
    while True:  # smallest label through links, until nothing changes
        new_l = np.minimum(l, np.where(dense, r[None, :], big).min(1))
        new_r = np.minimum(r, np.where(dense, new_l[:, None], big).min(0))
        if (new_l == l).all() and (new_r == r).all():
            break
        l, r = new_l, new_r
    return [(a, b) for a, b in zip(np.concatenate([rows[some], columns[any_]]).tolist(), np.concatenate([l, r]).tolist()) if a != b]


class Side:
    """Residents of a cell in one chunk: members (those whose own cell it is) and others that ask it."""

    def __init__(self, rows: list[tuple], kind: str):
        seen: set[int] = set()
        rows = [r for r in rows if not (r[0] in seen or seen.add(r[0]))]  # a repeated vector may come from several tasks
        self.name = np.array([r[0] for r in rows], np.int64)
        self.times = np.array([r[1] for r in rows], np.int64)
        self.own = np.array([r[2] for r in rows], np.int64)
        self.asks = [r[3] for r in rows]
        self.unit = unit(np.stack([np.frombuffer(r[4], kind) for r in rows])) if rows else np.zeros((0, 1))

    def part(self, keep: np.ndarray) -> Side:
        out = object.__new__(Side)
        out.name, out.times, out.own, out.unit = self.name[keep], self.times[keep], self.own[keep], self.unit[keep]
        out.asks = [a for a, k in zip(self.asks, keep) if k]
        return out


def compare(members: Side, others: Side, limit: float, counts: dict[int, int]) -> list[tuple[int, int]]:
    """Links between members of the cell and others; adds to counts and returns the edges of a forest.

    others are members too (of another chunk), or ask this cell. A link is counted for both ends here, but where both ask each other's cells it is found
    twice and counted for the asking one each time.
    """
    if not len(members.name) or not len(others.name):
        return []
    linked = linked_pairs(others.unit, members.unit, limit)
    if not linked.any():
        return []
    for name, n in zip(others.name.tolist(), (linked @ members.times).tolist()):
        if n:
            counts[name] = counts.get(name, 0) + n
    cells, own = np.unique(others.own, return_inverse=True)
    asked = np.zeros((len(cells), len(members.name)), bool)  # whether the member asks that cell, where it is then counted
    if members.own[0] != others.own[0] or len(cells) > 1:
        place = {c: k for k, c in enumerate(cells.tolist())}
        for m, asks in enumerate(members.asks):
            for c in asks:
                if c in place and c != members.own[m]:
                    asked[place[c], m] = True
    for name, n in zip(members.name.tolist(), ((linked & ~asked[own]).T @ others.times).tolist()):
        if n:
            counts[name] = counts.get(name, 0) + n
    return forest(linked, others.name, members.name)


def within(members: Side, limit: float, counts: dict[int, int]) -> list[tuple[int, int]]:
    """Links among the members of one chunk."""
    if len(members.name) < 2:
        return []
    linked = linked_pairs(members.unit, members.unit, limit)
    np.fill_diagonal(linked, False)
    for name, n in zip(members.name.tolist(), (linked @ members.times).tolist()):
        if n:
            counts[name] = counts.get(name, 0) + n
    return forest(linked, members.name, members.name)


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def embedding_groups(vectors: DataFrame, limit: float = 0.9, centres: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row: links are pairs found with cosine >= limit, in double precision.

    Equal vectors are one from the start, named by a 64-bit hash. The centres are fitted on at most SAMPLE of them; every vector is a member of
    its nearest centre's cell and asks the cells within a margin that fit_margin takes from the sample. A cell is compared in blocks of at most two chunks of its
    residents; tasks return counts and spanning forests. The vectors themselves are shuffled once, to the cells.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of different length don't link, and those of another than the most
    frequent length are one cell for each length. Rows that repeat a vec_id are counted and grouped each by its own vector; a null vec_id links with nothing and is kept;
    an empty table gives no rows; other columns are left aside.
    """
    spark = vectors.sparkSession
    prepare(spark)
    wide = "f8" if "double" in dict(vectors.dtypes)["embedding"] else "f4"
    good = F.col("vec_id").isNotNull() & usable(F.col("embedding"))
    rows = vectors.select("vec_id", "embedding", F.when(good, F.xxhash64("embedding")).alias("name"))
    facts = cut(rows.select("vec_id", "name", F.size("embedding").alias("width")), "vectors")
    usual = facts.where("name is not null").groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if usual is None:
        return facts.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    widest, total = usual
    repeated = cut(facts.where("name is not null").groupBy("name").agg(F.count("*").alias("times")).where("times > 1"), "repeated")
    few = repeated.count() <= REPEATED
    total -= repeated.agg(F.coalesce(F.sum(F.col("times") - 1), F.lit(0))).first()[0]
    used = rows.where("name is not null")
    used = used.join(F.broadcast(repeated) if few else repeated, "name", "left").select("name", F.coalesce("times", F.lit(1)).alias("times"), "embedding")

    most = max(100, min(SAMPLE, SAMPLE_VALUES // widest))
    part = F.pmod(F.xxhash64("name"), F.lit(1 << 30))

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([np.asarray(e, wide).tobytes() for e in batch.column(0).to_pylist()], pa.binary())], ["v"])

    some = used.where((F.size("embedding") == widest) & (part <= (1 << 30) * min(1.0, 0.9 * most / max(1, total)))).select("embedding").limit(2 * most).mapInArrow(flat, "v binary").collect()
    sample = unit(np.stack([np.frombuffer(v, wide) for v in sorted({bytes(r["v"]) for r in some})])) if some else np.zeros((0, widest))
    k = centres or max(1, min(CENTRES, round(total / CELL)))
    centre = fit_centres(sample, k) if len(sample) else np.zeros((0, widest))
    margin = fit_margin(sample, centre, limit) if len(sample) else 0.0

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """name, times, cell, own, asks, vector: a row for each cell where the vector is a resident. A task takes a repeated vector once."""
        seen: set[int] = set()
        for batch in batches:
            names, times, values = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            keep = []
            for n, (name, t) in enumerate(zip(names, times)):
                if t == 1 or name not in seen:
                    keep.append(n)
                    if t > 1:
                        seen.add(name)
            data = [values[n].values.to_numpy(zero_copy_only=False).astype(wide) for n in keep]
            out = []
            same = [n for n, v in enumerate(data) if len(v) == widest and len(centre)]
            near = unit(np.stack([data[n] for n in same])) @ centre.T if same else np.zeros((0, 1))
            asks = dict(zip(same, near >= near.max(1, keepdims=True) - margin)) if same else {}
            own = dict(zip(same, near.argmax(1).tolist())) if same else {}
            for n, v in enumerate(data):
                to = np.flatnonzero(asks[n]).tolist() if n in asks else [-len(v)]
                mine = own.get(n, -len(v))
                out += [(names[keep[n]], times[keep[n]], c, mine, to, v.tobytes()) for c in to]
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["name", "times", "cell", "own", "asks", "vector"])

    residents = used.mapInArrow(place, "name long, times long, cell int, own int, asks array<int>, vector binary")
    sizes = cut(residents.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks")), "cell_sizes")
    # a row for every cell: at most CENTRES and one for each other length of vectors
    dealt = residents.join(F.broadcast(sizes) if sizes.count() <= 4 * CENTRES else sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("name"), F.col("chunks")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least("chunk", j).alias("i"), F.greatest("chunk", j).alias("j")))
    dealt = dealt.select("cell", "chunk", F.explode(to).alias("to"), "name", "times", "own", "asks", "vector").select("cell", "to.i", "to.j", "chunk", "name", "times", "own", "asks", "vector")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    grouped = dealt.repartition(parts, "cell", "i", "j").sortWithinPartitions("cell", "i", "j", "chunk", "name")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            key, held = None, []
            for batch in batches:
                for c, i, j, chunk, *row in zip(*(batch.column(x).to_pylist() for x in ("cell", "i", "j", "chunk", "name", "times", "own", "asks", "vector"))):
                    if (c, i, j) != key:
                        if held:
                            yield key, held
                        key, held = (c, i, j), []
                    held.append((chunk, row))
            if held:
                yield key, held

        for (cell, i, j), held in blocks():
            counts: dict[int, int] = {}
            sides = [Side([r for chunk, r in held if chunk == at], wide) for at in ((i,) if i == j else (i, j))]
            members = [s.part(s.own == cell) for s in sides]
            asking = [s.part(s.own != cell) for s in sides]
            if i == j:
                edges = within(members[0], limit, counts) + compare(members[0], asking[0], limit, counts)
            else:
                edges = compare(members[0], members[1], limit, counts) + compare(members[0], asking[1], limit, counts) + compare(members[1], asking[0], limit, counts)
            out = [(a, b, 0) for a, b in edges] + [(a, a, n) for a, n in counts.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b", "n"])

    found = cut(grouped.mapInArrow(search, "a long, b long, n long"), "links")
    counts = found.where("n > 0").groupBy(F.col("a").alias("name")).agg(F.sum("n").alias("n"))
    groups = components(found.where("a <> b").select("a", "b")).withColumnsRenamed({"id": "name", "component": "group"})
    about = cut(counts.join(groups, "name", "full").join(repeated, "name", "full"), "about")
    out = cut(facts.join(about, "name", "left").select("vec_id", F.when(F.col("name").isNull(), 0).otherwise(F.coalesce("n", F.lit(0)) + F.coalesce("times", F.lit(1)) - 1).alias("n"), F.coalesce("group", "name").alias("group")), "grouped")
    low = cut(out.where("group is not null").groupBy("group").agg(F.min("vec_id").alias("low")), "lowest")
    component = F.coalesce("low", "vec_id")
    return out.join(low, "group", "left").select("vec_id", F.col("n").cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
