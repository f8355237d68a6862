"""Packing: lexical retrieval. A sharded BM25 index returns unused neighbours of a seed, which fill its window."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, prepare, whole_texts

#: Ids of a sequence, documents of an index shard, BM25's parameters.
WINDOW, SHARD, K1, B = 1024, 512, 1.2, 0.75
#: Fixed value: the id of the special string inside texts, as the tokenizer's file has it. END follows each document.
SPECIAL, SPECIAL_ID, END = "<|endoftext|>", 50256, 0
#: A list that holds a document in so many of its shard is long; long lists are multiplied in blocks of so many terms.
COMMON, BLOCK = 8, 1024
#: Words kept in a worker's table at most.
CACHE = 600_000
#: A space with white space on both sides, or at the end after other white space: there the split pattern looks past the next word.
_ODD = re.compile(r"\s(?: \s| \Z)")


#: Fixed value: the split pattern of byte-level tokenizers of this kind.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_ranks(vocabulary: dict[str, int]) -> dict[bytes, int]:
    """The vocabulary by bytes: byte-level files write printable bytes as themselves and the others, in order, from code point 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(shown))}
    return {bytes(of[c] for c in token): n for token, n in vocabulary.items() if n != SPECIAL_ID}


class Encoder:
    """Ids of texts as little-endian uint32 bytes, equal to the tokenizers library's for the same file.

    A word with the space before it has the same ids wherever it stands, so they are kept; words are merged by the faster
    tiktoken from the file's own vocabulary. Texts with the special string, or whose white space runs on, go through the library whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.words = tiktoken.Encoding("words", pat_str=SPLIT, mergeable_ranks=byte_ranks(self.library.get_vocab(False)), special_tokens={})
        self.seen: dict[str, bytes] = {}

    def _word(self, text: str) -> bytes:
        ids = self.words.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if SPECIAL in t or _ODD.search(t) else t.split(" ") for t in texts]
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        whole = iter(self.library.encode_batch_fast([t for t, words in zip(texts, split) if words is None], add_special_tokens=False))
        out = []
        for words in split:
            if words is None:
                out.append(np.asarray(next(whole).ids, "<u4").tobytes())
                continue
            first = self._word(words[0])
            del words[0]
            for w in set(words).difference(seen):
                seen[w] = self._word(" " + w)
            out.append(first + b"".join(map(seen.__getitem__, words)))
        return out


@lru_cache(1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """The ids of every document and END after them, cut into full windows and a rest.

    doc_id, start, length, ids_crc32, doc_tokens; for the rest (under a window) also its ids and two keys of lexical likeness: the
    smallest hashes of the whole document's pairs of neighbouring ids, under two hash functions. The last piece of a document of a window or more has
    terms: the document's distinct ids and how often each occurs. A vocabulary beyond 65,536 ids is refused.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.asarray([END], "<u4").tobytes()
        step = 4 * window
        for batch in batches:
            out = []
            for doc_id, data in zip(batch.column(0).to_pylist(), encoder(path).encode([t or "" for t in batch.column(1).to_pylist()])):
                data += end
                ids = np.frombuffer(data, "<u4")
                n, short = len(ids), ids.astype("<u2")
                if ids.max() > 65535:
                    raise ValueError(f"packing: id {ids.max()} is beyond 65535")
                terms = packed_terms(short) if n >= window else None
                for at in range(0, len(data) - step + 1, step):
                    last = at + step == len(data)
                    out.append((doc_id, at // 4, window, zlib.crc32(data[at : at + step]), n, None, terms if last else None, None, None))
                if left := n % window:
                    wide = ids.astype(np.uint64)
                    pair = wide[:-1] << np.uint64(17) | wide[1:] if n > 1 else wide
                    keys = [int(((pair + np.uint64(c)) * np.uint64(m)).min() >> np.uint64(24)) for c, m in ((1, 0x9E3779B97F4A7C15), (77, 0xD6E8FEB86659FD93))]
                    out.append((doc_id, n - left, left, zlib.crc32(data[4 * (n - left) :]), n, short[n - left :].tobytes(), terms, *keys))
            if out:
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "terms", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, terms binary, k1 long, k2 long")


def packed_terms(ids: np.ndarray) -> bytes:
    """Distinct ids as uint16, then how often each occurs as uint32: bounded by the vocabulary, however long the document is."""
    term, tf = np.unique(ids, return_counts=True)
    return term.astype("<u2").tobytes() + tf.astype("<u4").tobytes()


def unpacked_terms(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 6
    return np.frombuffer(data, "<u2", n), np.frombuffer(data, "<u4", n, 2 * n)


def document_frequencies(pieces: DataFrame) -> np.ndarray:
    """In how many documents each id occurs, and at the end the number of documents and of their ids: over all whole documents. As many numbers as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(65538, np.int64)
        for batch in batches:
            for data, terms, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                df[unpacked_terms(terms)[0] if terms else np.unique(np.frombuffer(data, "<u2"))] += 1
                df[65536:] += (1, n)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["id", "n"])

    out = np.zeros(65538, np.int64)
    for r in pieces.where("ids is not null or terms is not null").select("ids", "terms", "doc_tokens").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def starts(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal values begins, and how long it is."""
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(ordered) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(ordered)))


class Shard:
    """A BM25 index over the documents of one shard; terms are the ids of a whole document, and its length is theirs; used documents are passed over.

    documents: (ids of the rest, packed terms or None where the rest is the whole document, ids of the whole document).
    """

    def __init__(self, documents: list[tuple], idf: np.ndarray, mean: float):
        n = len(documents)
        sizes = np.array([d[2] for d in documents], np.int64)
        whole = [(k, np.frombuffer(d[0], "<u2")) for k, d in enumerate(documents) if d[1] is None]
        long = [(k, *unpacked_terms(d[1])) for k, d in enumerate(documents) if d[1] is not None]
        # term * n + document: below 2^32 for shards of up to 65,536
        paired = lambda parts: np.concatenate([np.zeros(0, np.uint32), *[x[1].astype(np.uint32) * np.uint32(n) + np.uint32(x[0]) for x in parts]])
        pair, tf = np.unique(paired(whole), return_counts=True)
        pair, tf = np.concatenate([pair, paired(long)]), np.concatenate([tf, *[x[2] for x in long]]).astype(np.int64)
        keep = idf[pair // n] > 0  # terms in half of all documents weigh nothing
        pair, tf = pair[keep], tf[keep]
        order = np.argsort(pair, kind="stable")
        pair, tf = pair[order].astype(np.int64), tf[order]
        term, doc = pair // n, pair % n
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
        begin, width = starts(term)
        place = np.repeat(np.arange(len(begin)), width)
        common = width * COMMON >= n
        # long lists: all pairs of the shard's documents at once, in blocks of terms
        self.base, number, at = np.zeros((n, n)), np.cumsum(common) - 1, np.flatnonzero(common[place])
        for first in range(0, int(common.sum()), BLOCK):
            held = at[(number[place[at]] >= first) & (number[place[at]] < first + BLOCK)]
            block = np.zeros((min(BLOCK, int(common.sum()) - first), n))
            block[number[place[held]] - first, doc[held]] = weight[held]
            self.base += (block > 0).astype(np.float64).T @ block
        # short lists: one by one, for each seed
        rare = np.flatnonzero(~common[place])
        self.weight, self.doc = weight[rare], doc[rare]
        self.begin, width = starts(term[rare])
        self.begin = np.append(self.begin, len(rare))
        order = np.argsort(self.doc.astype(np.uint16) if n <= 65536 else self.doc, kind="stable")  # a document's terms, as places of lists
        self.own = np.repeat(np.arange(len(width)), width)[order]
        self.own_begin = np.searchsorted(self.doc[order], np.arange(n + 1))
        self.n = n

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """Unused documents by falling score for the seed's distinct terms; scores equal to six digits by place."""
        at = self.own[self.own_begin[seed] : self.own_begin[seed + 1]]
        width = self.begin[at + 1] - self.begin[at]
        score = self.base[seed]
        if len(at):
            places = np.repeat(self.begin[at] - np.concatenate([[0], np.cumsum(width)[:-1]]), width) + np.arange(width.sum())
            score = score + np.bincount(self.doc[places], self.weight[places], self.n)
        order = np.argsort(-np.round(score, 6), kind="stable")
        return order[~used[order]]


def fill_windows(rows: Iterator[list[tuple]], idf: np.ndarray, mean: float, first_id: int, window: int = WINDOW) -> Iterator[tuple]:
    """Pieces (row, begin, length, sequence, offset) of the rests in rows, one list for each shard.

    The first unused rest is the seed of a window; its neighbours follow by score while they fit whole; then the best one is cut to fill the window,
    and what is left of it is the next seed. What a shard leaves unfilled goes on with the next shard; the last window is
    cut at powers of two, so that no sequence needs padding.
    """
    sequence, room, held = first_id, window, []  # held: pieces of the open window
    for shard in rows:
        index = Shard([(r[5], r[6], r[4]) for r in shard], idf, mean)
        used = np.zeros(len(shard), bool)
        left = [r[2] for r in shard]
        seed = 0
        while True:
            while seed < len(shard) and used[seed]:
                seed += 1
            if seed == len(shard):
                break
            order = np.concatenate([[seed], index.neighbours(seed, used)])
            order = order[np.r_[True, order[1:] != seed]]
            carry = None
            for k in order.tolist():
                if not room:
                    break
                if left[k] <= room:
                    held.append((shard[k], shard[k][2] - left[k], left[k], window - room))
                    room -= left[k]
                    used[k] = True
                elif carry is None:
                    carry = k
                    if room < window // 8:  # little room: cut now instead of looking for short ones
                        break
            if room and carry is not None:
                held.append((shard[carry], shard[carry][2] - left[carry], room, window - room))
                left[carry] -= room
                room = 0
                seed = min(seed, carry)
            if not room:
                for row, begin, length, offset in held:
                    yield row, begin, length, sequence, offset
                sequence, room, held = sequence + 1, window, []
    rest = window - room
    for row, begin, length, offset in held:
        while length:
            # sequences of the last window: its length's powers of two, largest first
            done, size = 0, 0
            for bit in range(window.bit_length(), -1, -1):
                size = rest & (1 << bit)
                if size and offset < done + size:
                    break
                done += size
            part = min(length, done + size - offset)
            yield row, begin, part, sequence + bin(rest >> bit).count("1") - 1, offset - done
            begin, length, offset = begin + part, length - part, offset + part


def pack_documents(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Full windows of a document are sequences of their own. The rests are put in lexical order (by min-hash keys, then id), dealt by range
    over tasks and taken in shards of SHARD documents; each has a BM25 index of the whole documents, with statistics of all documents, whose neighbours of a
    seed fill its window. Equal texts, however many, go to as many shards as they fill.
    Null and empty texts are the one END id; rows that repeat a doc_id are packed each; ids are handed to tasks as uint16 (the vocabulary is smaller);
    an empty table gives no rows; other columns are left aside. path: the tokenizer's file, readable on every executor.
    """
    docs = whole_texts(docs)
    spark = docs.sparkSession
    prepare(spark)
    kind = dict(docs.dtypes)["doc_id"]
    pieces = cut(token_pieces(docs, path, window), "pieces")
    rests = pieces.where("ids is not null")
    df = document_frequencies(pieces)
    n, mean = max(1, int(df[65536])), max(1.0, df[65537] / max(1, df[65536]))
    idf = np.maximum(0.0, np.log((n - df[:65536] + 0.5) / (df[:65536] + 0.5)))
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // SHARD))
    ordered = rests.repartitionByRange(parts, "k1", "k2", "doc_id").sortWithinPartitions("k1", "k2", "doc_id", "ids_crc32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shards():
            rows: list[tuple] = []
            for batch in batches:
                rows += zip(*(batch.column(k).to_pylist() for k in range(7)))
                while len(rows) >= SHARD:
                    yield rows[:SHARD]
                    rows = rows[SHARD:]
            if rows:
                yield rows

        kinds = (ids_kind, *[pa.int64()] * 6)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        out = []
        for row, begin, length, sequence, offset in fill_windows(shards(), idf, mean, TaskContext.get().partitionId() << 33, window):
            crc = row[3] if length == row[2] else zlib.crc32(np.frombuffer(row[5], "<u2")[begin : begin + length].astype("<u4").tobytes())
            out.append((row[0], row[1] + begin, length, crc, row[4], sequence, offset))
            if len(out) == 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    ids_kind = to_arrow_type(docs.schema["doc_id"].dataType)
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = ordered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "terms").mapInArrow(run, schema)
    full = pieces.where("ids is null").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(full)
