"""Byte-level BPE by recursive DuckDB queries inside each task: words' merges as joins with the merge table, decoding as an ordered aggregate."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, readable

#: Words and bytes of one recursive query; distinct words that a task remembers; bytes from which a word is long; levels that one query goes down.
WORDS, BYTES, REMEMBERED, LONG, LEVELS = 40_000, 1 << 20, 400_000, 48, 64

#: The leftmost pair of least rank in each word becomes one token, level by level; words without a pair are done. A token's follower begins width bytes on.
ONE_PAIR = f"""
WITH RECURSIVE step(level, word, pos, token, width, done) AS (
  SELECT 0, word, pos, token, 1, false FROM pieces
  UNION ALL
  (WITH live AS MATERIALIZED (SELECT level, word, pos, token, width FROM step WHERE NOT done AND level < {LEVELS}),
   pairs AS (
     SELECT x.word, y.pos AS follower, y.width AS more, made, (made::BIGINT << 32) + x.pos AS place
     FROM live x JOIN live y ON y.word = x.word AND y.pos = x.pos + x.width JOIN merges ON a = x.token AND b = y.token),
   least AS (SELECT word, min(place) AS place, arg_min(follower, place) AS follower, arg_min(more, place) AS more FROM pairs GROUP BY word),
   merged AS (SELECT word, (place & 4294967295)::INT AS spot, (place >> 32)::INT AS made, follower, more FROM least)
   SELECT level + 1, l.word, pos, CASE WHEN pos = spot THEN made ELSE token END, CASE WHEN pos = spot THEN width + more ELSE width END, spot IS NULL
   FROM live l LEFT JOIN merged m ON m.word = l.word WHERE pos IS DISTINCT FROM follower))
SELECT word, pos, token, done FROM step WHERE done OR level = {LEVELS}
"""
#: The same for long words, where one pair a level would take as many levels as there are tokens. A pair whose token never takes part in a merge of lower
#: rank ("steady") stays the least until its last occurrence is gone, so all of its occurrences are merged in one level: from the left, in x x x every other one.
ALL_PAIRS = f"""
WITH RECURSIVE step(level, word, pos, token, done) AS (
  SELECT 0, word, pos, token, false FROM pieces
  UNION ALL
  SELECT level + 1, word, pos, CASE WHEN chosen THEN made ELSE token END, best IS NULL FROM (
    SELECT *, coalesce(lag(chosen) OVER (PARTITION BY word ORDER BY pos), false) AS eaten FROM (
      SELECT *, coalesce(made = best AND CASE WHEN NOT steady THEN pos = leftmost
        ELSE token <> follower OR row_number() OVER (PARTITION BY word, made = best, stretch ORDER BY pos) % 2 = 1 END, false) AS chosen FROM (
        SELECT *, min(pos) FILTER (made = best) OVER (PARTITION BY word) AS leftmost, place - row_number() OVER (PARTITION BY word, made = best ORDER BY pos) AS stretch FROM (
          SELECT s.*, made, steady, min(made) OVER (PARTITION BY word) AS best FROM (
            SELECT *, lead(token) OVER w AS follower, row_number() OVER w AS place FROM step WHERE NOT done AND level < {LEVELS}
            WINDOW w AS (PARTITION BY word ORDER BY pos)) s
          LEFT JOIN merges ON a = token AND b = follower))))
  WHERE NOT eaten)
SELECT word, pos, token, done FROM step WHERE done OR level = {LEVELS}
"""
DECODED = "SELECT doc, unhex(string_agg(digits, '' ORDER BY pos)) AS text FROM ids JOIN vocabulary USING (token) GROUP BY doc"


class Ranks:
    """A rank file's vocabulary and merges as tables of an in-memory DuckDB, one for each worker process, without threads of its own."""

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        if any(bytes([b]) not in self.ids for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.first = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ids[t[:k]], self.ids[t[k:]], made) for t, made in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids]
        a, b, made = (np.array(x, np.int32) for x in zip(*pairs)) if pairs else [np.zeros(0, np.int32)] * 3
        top = max(self.ids.values()) + 1
        lowest = np.full(top, top, np.int32)
        np.minimum.at(lowest, a, made)
        np.minimum.at(lowest, b, made)
        self.sql = duckdb.connect(config={"threads": 1})
        self.sql.register("m", pa.table({"a": a, "b": b, "made": made, "steady": lowest[made] > made}))
        self.sql.execute("CREATE TABLE merges AS SELECT * FROM m")
        self.sql.register("v", pa.table({"token": pa.array(self.ids.values(), pa.int32()), "digits": [t.hex() for t in self.ids]}))
        self.sql.execute("CREATE TABLE vocabulary AS SELECT * FROM v")

    def _merged(self, words: list[bytes], query: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has). ONE_PAIR takes words of fewer than LEVELS bytes, which are done in one query."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        word, pos, token = np.repeat(np.arange(len(words), dtype=np.int32), size), (np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)).astype(np.int32), self.first[flat]
        ended: list[list[np.ndarray]] = []
        while len(word):  # words that aren't done at the last level go into another query, so that the levels' rows don't pile up
            self.sql.register("pieces", pa.table({"word": word, "pos": pos, "token": token}))
            found = self.sql.sql(query).to_arrow_table()
            word, pos, token = (found.column(c).to_numpy() for c in ("word", "pos", "token"))
            done = found.column("done").to_numpy(zero_copy_only=False).astype(bool)
            ended.append([word[done], pos[done], token[done]])
            word, pos, token = word[~done], pos[~done], token[~done]
        word, pos, token = (np.concatenate(x) for x in zip(*ended))
        return token[np.argsort((word.astype(np.int64) << 32) + pos)], np.bincount(word, minlength=len(words))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has): a word that is a token is itself, others are merged. No word is empty."""
        own = np.fromiter([self.ids.get(w, -1) for w in words], np.int64, len(words))
        size, made = (own >= 0).astype(np.int64), []
        length = np.fromiter(map(len, words), np.int64, len(words))
        for query, fits in ((ONE_PAIR, length < LONG), (ALL_PAIRS, length >= LONG)):
            rest = np.flatnonzero((own < 0) & fits)
            while len(rest):
                taken = max(1, min(WORDS, int(np.searchsorted(np.cumsum(length[rest]), BYTES, "right"))))
                ids, size[rest[:taken]] = self._merged([words[k] for k in rest[:taken].tolist()], query)
                made.append((rest[:taken], ids))
                rest = rest[taken:]
        begin = np.cumsum(size) - size
        flat = np.empty(int(size.sum()), np.int32)
        flat[begin[own >= 0]] = own[own >= 0]
        for which, ids in made:
            n = size[which]
            flat[np.repeat(begin[which] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return flat, size

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of documents: ids of all of them, and where each one's begin and end."""
        doc = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
        self.sql.register("ids", pa.table({"doc": doc, "pos": np.arange(len(ids), dtype=np.int64), "token": ids}))
        found = self.sql.sql(DECODED).to_arrow_table()
        texts = [b""] * (len(ends) - 1)
        for k, text in zip(found.column(0).to_pylist(), found.column(1).to_pylist()):
            texts[k] = text
        return texts


@lru_cache(1)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(1)
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


class Words:
    """Encoded words of a task, at most REMEMBERED and those of the batch at hand."""

    def __init__(self, path: str):
        self.path, self.place = path, {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's begin and end) from the texts' words."""
        if len(self.place) > REMEMBERED:
            self.__init__(self.path)
        place, known = self.place, len(self.place)
        codes = [np.fromiter([place.setdefault(w, len(place)) for w in words], np.int64, len(words)) for words in texts]
        flat, size = ranks(self.path).encode_words([w.encode() for w in islice(place, known, None)])
        self.flat, self.size = np.append(self.flat, flat), np.append(self.size, size)
        begin, every = np.cumsum(self.size) - self.size, np.concatenate([*codes, np.zeros(0, np.int64)])
        n = self.size[every]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(begin[every] - (ends - n), n) + np.arange(int(n.sum()))]
        return ids, np.append(0, ends)[np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))]


def _listed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """Token ids of every whole text: doc_id, ids (array of int) and, if asked for, decoded (the bytes that the ids stand for).

    A text is split by ``pattern``; each distinct word of a task is merged once, in recursive queries over rows (word, position, token). No special tokens.
    Null and empty texts have no ids; equal texts have equal ids; repeated rows are answered each; ids of documents may have any type and may be null; invalid
    UTF-8 is replaced; other columns are left aside; an empty table gives none. path: a rank file that every executor can read.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        for batch in batches:
            ids, ends = words.encode([_pattern(pattern).findall(t or "") for t in batch.column(1).to_pylist()])
            more = [pa.array(ranks(path).decode(ids, ends), pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([batch.column(0), _listed(ids, ends), *more], ["doc_id", "ids", "decoded"][: 2 + len(more)])

    fields = [docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())]
    return docs.select("doc_id", readable("text")).mapInArrow(run, T.StructType(fields if decoded else fields[:2]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text (binary) of rows doc_id, ids: the tokens' bytes in order. Null ids count as none; an id outside of the vocabulary raises an error."""
    prepare(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.array(x or [], np.int32) for x in batch.column(1).to_pylist()]
            ids = np.concatenate([*lists, np.zeros(0, np.int32)])
            if not set(np.unique(ids).tolist()) <= set(ranks(path).ids.values()):
                raise ValueError("an id isn't in the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ranks(path).decode(ids, np.append(0, np.cumsum([len(x) for x in lists], dtype=np.int64))), pa.binary())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col("ids").cast("array<int>")).mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("text", T.BinaryType())]))


def encoding_digests(encoded: DataFrame) -> DataFrame:
    """The digest columns of encode's rows (with decoded): n_tokens, hashes of the decimal ids joined by commas and of the decoded bytes."""
    digits = F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
