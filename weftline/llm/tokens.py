"""Token counts: pieces are counted once per distinct pre-token and joined to the documents' pre-token frequencies."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare, whole_texts

#: A block of documents ends before it holds more documents or more code points than this (a longer text is a block of its own).
BLOCK_DOCS, BLOCK_CHARS = 4000, 16 << 20
#: Rows that a task of count_pieces gathers before it packs them by block.
GATHERED = 1 << 20

#: Fixed values of the tokenizer's file: its split pattern, in Python's regex syntax, and its special strings.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")
#: Letters and signs for which Python's ``re`` classes agree with the pattern's Unicode classes: ASCII and Latin letters with marks.
PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7eÀ-ÖØ-öø-ɏ]*")
FAST = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


@lru_cache(1)
def _exact():
    import regex

    return regex.compile(SPLIT)


@lru_cache(1)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def normal_words(text: str, path: str) -> list[str]:
    """The text as the tokenizer normalises it, cut at white space; special strings stand alone. No pre-token spans white space."""
    words: list[str] = []
    for part in re.split("(<\\|(?:start|end)oftext\\|>)", text) if "<|" in text else (text,):
        if part in SPECIAL:
            words.append(part)
        elif PLAIN.fullmatch(part):
            words += part.lower().split()
        else:
            words += tokenizer(path).normalizer.normalize_str(unicodedata.normalize("NFC", part)).split(" ")
    return words


def pre_tokens(word: str) -> list[str]:
    """The pre-tokens of a normalised word; a special string is one."""
    if word in SPECIAL:
        return [word]
    return FAST.findall(word) if PLAIN.fullmatch(word) else _exact().findall(word)


def _pack(values: np.ndarray) -> bytes:
    """uint32 values, byte by byte, compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str], pa.DataType]]:
    """(ids, texts, type of the ids) of blocks of BLOCK_DOCS documents and BLOCK_CHARS code points at most."""
    ids, texts, held, kind = [], [], 0, None
    for batch in batches:
        kind = batch.schema.field(0).type
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            text = text or ""
            if texts and (len(texts) == BLOCK_DOCS or held + len(text) > BLOCK_CHARS):
                yield ids, texts, kind
                ids, texts, held = [], [], 0
            ids.append(name)
            texts.append(text)
            held += len(text)
    if texts:
        yield ids, texts, kind


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """Pre-token frequencies, a row for each block of documents. The larger a block, the fewer rows its words take in all.

    block, vocab (the block's distinct pre-tokens), ids, n_bytes, n_distinct (per document), codes (places in vocab, document after
    document) and counts, both packed.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (doc_ids, texts, id_type) in enumerate(in_blocks(batches)):
            words: dict[str, int] = {}
            per_doc = []
            for text in texts:
                mine = normal_words(text, path)
                for w in set(mine).difference(words):
                    words[w] = len(words)
                per_doc.append(np.fromiter(map(words.__getitem__, mine), np.int64, len(mine)))
            # words to pre-tokens, as a ragged array
            vocab: dict[str, int] = {}
            split = [[vocab.setdefault(p, len(vocab)) for p in pre_tokens(w)] for w in words]
            width = np.fromiter(map(len, split), np.int64, len(split))
            begin = np.concatenate([[0], np.cumsum(width)])
            flat = np.fromiter((p for s in split for p in s), np.int64, int(begin[-1]))
            codes, counts, distinct = [], [], []
            for mine in per_doc:
                u, c = np.unique(mine, return_counts=True)
                w = width[u]
                at = np.repeat(begin[u] - np.concatenate([[0], np.cumsum(w)[:-1]]), w) + np.arange(w.sum()) if len(u) else np.zeros(0, np.int64)
                code, back = np.unique(flat[at.astype(np.int64)], return_inverse=True)
                codes.append(code)
                counts.append(np.bincount(back, np.repeat(c, w), len(code)))
                distinct.append(len(code))
            all_codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            order = np.argsort(-np.bincount(all_codes, minlength=len(vocab)), kind="stable")  # frequent ones get small places
            place = np.empty(len(vocab), np.int64)
            place[order] = np.arange(len(vocab))
            names = list(vocab)
            arrays = [
                pa.array([(TaskContext.get().partitionId() << 32) + k]), pa.array([[names[i] for i in order]], pa.list_(pa.string())), pa.array([doc_ids], pa.list_(id_type)),
                pa.array([[len(t.encode()) for t in texts]], pa.list_(pa.int64())), pa.array([distinct], pa.list_(pa.int32())), pa.array([_pack(place[all_codes])]), pa.array([_pack(np.concatenate(counts) if counts else all_codes)]),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["block", "vocab", "ids", "n_bytes", "n_distinct", "codes", "counts"])

    return docs.select("doc_id", "text").mapInArrow(run, f"block long, vocab array<string>, ids array<{kind}>, n_bytes array<long>, n_distinct array<int>, codes binary, counts binary")


def count_pieces(named: DataFrame, path: str) -> DataFrame:
    """(block, counted) for rows (block, place, word): the library's tokens of each word, packed as ascending places' steps, then pieces.

    Rows are dealt and sorted by word, so each distinct word of all blocks is counted once, and its count goes to every block that holds it. A word has at
    most one row in a block, so a frequent word has as many small rows as there are blocks. A task gathers GATHERED rows and packs them by block; a block may
    get several rows from a task.
    """

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        block, place, pieces = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, block))
        block, place, pieces = block[order], place[order], pieces[order]
        begin = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
        end = np.append(begin[1:], len(block))
        made = [_pack(np.concatenate([np.diff(place[b:e], prepend=0), pieces[b:e]])) for b, e in zip(begin.tolist(), end.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(block[begin]), pa.array(made, pa.binary())], ["block", "counted"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_count, held, n = None, 0, [], 0
        for batch in batches:
            words = batch.column(2).dictionary_encode()
            distinct, at = words.dictionary.to_pylist(), words.indices.to_numpy()
            new = [w for w in distinct if w != last]
            made = dict(zip(new, (len(e.ids) for e in tokenizer(path).encode_batch_fast(new, add_special_tokens=False))))
            if last in distinct:
                made[last] = last_count
            counts = np.fromiter((made[w] for w in distinct), np.int32, len(distinct))
            if len(at):
                last, last_count = distinct[at[-1]], int(counts[at[-1]])
                held.append((batch.column(0).to_numpy().copy(), batch.column(1).to_numpy().copy(), counts[at]))
                n += len(at)
            if n >= GATHERED:
                yield packed(held)
                held, n = [], 0
        if held:
            yield packed(held)

    parts = int(named.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return named.select("block", "place", "word").repartition(parts, "word").sortWithinPartitions("word").mapInArrow(run, "block long, counted binary")


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The distinct pre-tokens of all blocks are counted once each, and the counts are joined to the blocks' vocabularies; a
    document's tokens are the sum of frequency times pieces over its pre-tokens. Token ids of texts are never made.
    Null texts count as empty (0 bytes, 0 tokens); special strings inside texts count as the one token that the library makes of them; repeated rows
    are counted each; an empty table gives none; other columns are left aside. path: the tokenizer's file, readable on every executor.
    """
    docs = whole_texts(docs)
    prepare(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    blocks = cut(frequencies(docs, path), "frequencies")
    named = blocks.select("block", F.posexplode("vocab").alias("place", "word"))
    each = count_pieces(named, path).groupBy("block").agg(F.collect_list("counted").alias("counted"))
    rows = blocks.drop("vocab").join(each, "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, n_bytes, n_distinct, codes, counts, counted = (batch.column(name)[k] for name in ("ids", "n_bytes", "n_distinct", "codes", "counts", "counted"))
                held = [_unpack(x).astype(np.int64) for x in counted.as_py() or []]
                table = np.zeros(sum(map(len, held)) // 2, np.int64)
                for x in held:
                    table[np.cumsum(x[: len(x) // 2])] = x[len(x) // 2 :]
                codes, counts, n = _unpack(codes.as_py()), _unpack(counts.as_py()), n_distinct.values.to_numpy()
                sums = np.concatenate([[0], np.cumsum(table[codes] * counts.astype(np.int64))]) if len(codes) else np.zeros(1, np.int64)
                ends = np.cumsum(n)
                tokens = sums[ends] - sums[ends - n]
                yield pa.RecordBatch.from_arrays([ids.values, n_bytes.values, pa.array(tokens, pa.int64()), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
