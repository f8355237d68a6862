"""Document fingerprints: a Merkle tree over paragraphs and sections."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import prepare, whole_texts

#: A section ends after a blank line, or after a paragraph whose digest begins below this (1 in 8), so that edits elsewhere don't move it.
SECTION_BELOW = 32
#: A passage (a leaf of the tree) ends where a hash of four code points has these bits clear, at a line's end, and after PASSAGE code points: about 8 code points.
PASSAGE_BITS, PASSAGE = np.uint64(7), 32
#: Leaves that a fingerprint holds at most: those with the smallest digests, of so many bits.
LEAVES, LEAF_BITS = 160, 40
#: Stands for a missing id: it orders last.
LAST = (1 << 63) - 1

_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, step in enumerate((_STEP, _BACK)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, step)]))
    return _powers


class Tree:
    """Digests of the root, the sections, the paragraphs and the passages of a text.

    A paragraph's digest is of its text and its passages' digests, a section's of its paragraphs', the root of the sections'.
    """

    def __init__(self, text: str):
        self.text = text
        lines = text.split("\n")
        code = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
        n = len(code)
        up, down = _power(n + 1)
        near = code * np.uint64(0xD6E8FEB86659FD93)
        near[1:] += code[:-1] * np.uint64(0xA0761D6478BD642F)
        near[2:] += code[:-2] * np.uint64(0xE7037ED1A0B428DB)
        near[3:] += code[:-3] * np.uint64(0x8EBC6AF09C88C6E3)
        ends = np.flatnonzero((((near >> np.uint64(40)) & PASSAGE_BITS) == 0) | (code == 10)) + 1
        if n and (not len(ends) or ends[-1] != n):
            ends = np.append(ends, n)
        if n:  # long passages are cut at equal steps from their start
            pieces = -(-np.diff(ends, prepend=0) // PASSAGE)
            step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
            ends = np.minimum(np.repeat(np.concatenate([[0], ends[:-1]]), pieces) + PASSAGE * step, np.repeat(ends, pieces))
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((code + np.uint64(1)) * up[:n])])
        leaves = (sums[ends] - sums[starts]) * down[starts] if n else np.zeros(0, np.uint64)
        leaves = (leaves ^ (leaves >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        leaves ^= leaves >> np.uint64(29)
        data = leaves.astype("<u8").tobytes()
        line_ends = np.searchsorted(ends, np.flatnonzero(code == 10) + 1) + 1 if n else np.zeros(0, np.int64)  # leaves up to each line's end
        self.paragraphs, at = [], 0
        for k, line in enumerate(lines):
            to = int(line_ends[k]) if k < len(line_ends) else len(leaves)
            self.paragraphs.append(hashlib.sha256(b"\0" + data[8 * at : 8 * to] + line.encode()).digest())
            at = to
        self.sections: list[tuple[bytes, int, int]] = []
        begin = 0
        for k, (line, digest) in enumerate(zip(lines, self.paragraphs), 1):
            if k == len(lines) or not line.strip() or digest[0] < SECTION_BELOW:
                self.sections.append((hashlib.sha256(b"\1" + b"".join(self.paragraphs[begin:k])).digest(), begin, k))
                begin = k
        self.root = hashlib.sha256(b"\2" + b"".join(s[0] for s in self.sections)).hexdigest()
        digest, place = np.unique(leaves >> np.uint64(64 - LEAF_BITS), return_inverse=True)
        size = np.bincount(place, ends - starts, len(digest)) if n else np.zeros(0)
        head = np.ascontiguousarray(digest[:LEAVES].astype("<u8").view(np.uint8).reshape(-1, 8)[:, : LEAF_BITS // 8])
        self.fingerprint = f"{self.root}:{base64.b64encode(bytes([len(digest) > LEAVES]) + head.tobytes() + np.minimum(size[:LEAVES], 65535).astype('<u2').tobytes()).decode()}"

    def first_difference(self, other: Tree) -> tuple[int, int] | None:
        """(section, paragraph) at which the trees first part, going down only where digests differ; None for equal trees."""
        if self.root == other.root:
            return None
        k = next((k for k, (a, b) in enumerate(zip(self.sections, other.sections)) if a[0] != b[0]), min(len(self.sections), len(other.sections)))
        begin = self.sections[k][1] if k < len(self.sections) else len(self.paragraphs)
        mine, theirs = self.paragraphs[begin:], other.paragraphs[begin:]
        return k, begin + next((i for i, (a, b) in enumerate(zip(mine, theirs)) if a != b), min(len(mine), len(theirs)))


def _leaves(fingerprint: str) -> tuple[str, np.ndarray, np.ndarray, int]:
    """Of a fingerprint: root, leaf digests, code points in leaves of each digest, and the digest up to which leaves are all there."""
    root, _, rest = fingerprint.partition(":")
    data = base64.b64decode(rest)
    n = (len(data) - 1) // (LEAF_BITS // 8 + 2)
    digest = np.zeros((n, 8), np.uint8)
    digest[:, : LEAF_BITS // 8] = np.frombuffer(data, np.uint8, n * LEAF_BITS // 8, 1).reshape(n, LEAF_BITS // 8)
    digest = digest.view("<u8").ravel()
    return root, digest, np.frombuffer(data, "<u2", n, 1 + n * LEAF_BITS // 8).astype(np.int64), int(digest[-1]) if data[0] else 1 << LEAF_BITS


def likeness(a: str, b: str) -> float:
    """How alike the texts of two fingerprints are, from the fingerprints alone: 1 for equal roots; else, below 1, twice the code points in leaves
    that both have over those in all leaves. Of texts with more than LEAVES leaves these are the leaves with the smallest digests, so both texts' samples agree.
    """
    (root, x, size, whole), (root_b, y, size_b, whole_b) = _leaves(a), _leaves(b)
    if root == root_b:
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    upto = min(whole, whole_b)
    x, size, y, size_b = x[x <= upto], size[x <= upto], y[y <= upto], size_b[y <= upto]
    total = int(size.sum() + size_b.sum())
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return float(min(2 * np.minimum(size[i], size_b[j]).sum(), total - 1) / total) if total else 0.0


def trees(docs: DataFrame) -> DataFrame:
    """The tree of every text: doc_id, fingerprint (root digest, and leaves for likeness), sections (digest and the digests of their paragraphs).

    A null text counts as empty; an empty text has one section with one empty paragraph; rows with equal texts have equal
    trees; other columns are left aside.
    """
    docs = whole_texts(docs)
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [Tree(t or "") for t in batch.column(1).to_pylist()]
            sections = [[{"digest": d.hex(), "paragraphs": [p.hex() for p in t.paragraphs[a:b]]} for d, a, b in t.sections] for t in made]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.fingerprint for t in made]), pa.array(sections, SECTIONS)], ["doc_id", "fingerprint", "sections"])

    SECTIONS = pa.list_(pa.struct([("digest", pa.string()), ("paragraphs", pa.list_(pa.string()))]))
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint string, sections array<struct<digest: string, paragraphs: array<string>>>")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs' doc_id and text in buckets by ascending id, sorted, each bucket followed by the row that comes next (halo 1).

    The bucket limits are quantiles of the ids; per bucket only its first id goes to the driver (as many as
    partitions). The texts are shuffled once. After the last row comes the first. Equal ids follow by text, null ids come last. Ids are integers of any size; others are refused.
    """
    docs = whole_texts(docs)
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer, as texts are edited by the next id's")
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key_"))
    limits = sorted(set(rows.approxQuantile("key_", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []
    bounds = F.array(*[F.lit(int(x)) for x in limits]).cast("array<long>")
    rows = rows.withColumn("bucket", F.size(F.filter(bounds, lambda b: b <= F.col("key_"))))
    firsts = [(r["bucket"], r["first"]) for r in rows.groupBy("bucket").agg(F.min("key_").alias("first")).orderBy("bucket").collect()]
    if not firsts:
        return rows.select("doc_id", "text", "bucket", F.lit(0).alias("halo"))
    before = F.create_map(*[F.lit(x) for k, (_, first) in enumerate(firsts) for x in (first, firsts[k - 1][0])])
    own = F.struct(F.col("bucket"), F.lit(0).alias("halo"))
    also = F.struct(F.try_element_at(before, F.col("key_")).alias("bucket"), F.lit(1).alias("halo"))
    rows = rows.withColumn("to", F.explode(F.filter(F.array(own, also), lambda x: x["bucket"].isNotNull())))
    return rows.select("doc_id", "text", "key_", "to.*").repartition(parts, "bucket").sortWithinPartitions("bucket", "halo", "key_", "text")


def edited_by_next(text: str, following: str) -> str:
    """text with its last quarter replaced by the first as many code points of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    edit_section, edit_paragraph (where the trees first part; null for equal ones). Null texts count as empty; two empty texts are alike with
    1, an empty and another with 0; repeated rows each get a row; an empty table gives none.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = None  # doc_id, bucket, tree of the row whose next one isn't known yet
        for batch in batches:
            for doc_id, text, bucket, halo in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if halo and (held is None or held[1] != bucket):
                    continue
                tree = Tree(text)
                if held is not None and held[1] == bucket:
                    mine = held[2]
                    edited = edited_by_next(mine.text, text)
                    other = Tree(edited)
                    where = mine.first_difference(other) or (None, None)
                    out.append((held[0], len(mine.text), hashlib.sha256(edited.encode()).hexdigest(), mine.fingerprint, other.fingerprint, likeness(mine.fingerprint, other.fingerprint), likeness(mine.fingerprint, tree.fingerprint), *where))
                held = None if halo else (doc_id, bucket, tree)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []

    kind = dict(docs.dtypes)["doc_id"]
    ids = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = pa.schema([("doc_id", ids), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edit_section", pa.int32()), ("edit_paragraph", pa.int32())])
    rows = with_next(docs).select("doc_id", "text", "bucket", "halo")
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_section int, edit_paragraph int")
