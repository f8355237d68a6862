"""Runs, source divergence and recursive BPE against brute force, their queries' columns and odd inputs."""

import base64
import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import divergence, periodic, queries, recursive_bpe

PATH = queries.tokenizer_path("byte_bpe_multi_50k.tiktoken")


def brute_runs(w, least, times):
    n, found = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q) and not any(all(w[x] == w[x + p] for x in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j + 1
    return sorted(found)


def test_runs_of_random_words():
    rng, found = random.Random(1), 0
    for _ in range(700):
        n, letters = rng.randint(0, 70), rng.choice([1, 2, 3, 5])
        w = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.5:
            begin, p = rng.randrange(n), rng.randint(1, 9)
            w = [w[begin + (i - begin) % p] if i >= begin and begin + p <= n else w[i] for i in range(n)]
        for least, times in ((2, 2), (6, 3), (24, 3)):
            got = [tuple(r) for r in periodic.find_runs(w, least, times).tolist()]
            assert got == brute_runs(w, least, times)
            found += len(got)
    assert found > 2000
    with pytest.raises(ValueError):
        periodic.find_runs(["a"], 24, 1)


def test_extensions_and_lyndon_words():
    rng = random.Random(2)
    for _ in range(60):
        w = [rng.randrange(3) for _ in range(rng.randint(2, 40))]
        n = len(w)
        order, low = periodic.SuffixTree(w).leaves()
        assert order.tolist() == sorted(range(n + 1), key=lambda k: w[k:])
        assert periodic.SuffixTree(w).leaves(descending=True)[0].tolist() == sorted(range(n + 1), key=lambda k: [-x for x in w[k:]])
        a, b = np.array([(i, j) for i in range(n) for j in range(i + 1, n + 1)]).T
        want = [next((k for k in range(n) if max(i, j) + k >= n or w[i + k] != w[j + k]), n) for i, j in zip(a, b)]
        assert periodic.Extensions(order, low).of(a, b).tolist() == want


def planted_words(doc_id, text):
    w, h = (text or "").encode().split(), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, white, long and repeated texts, ties, clashing names."""
    rng = random.Random(5)
    rows = [[k, " ".join(f"w{chr(97 + int(rng.random() ** 2 * (20 + k % 4)))}" for _ in range(rng.randint(20, 160))), rng.choice(["en", "de"]), f"s{k % 4}", 0, 1, "x", 2.0, "y"] for k in range(150)]
    block = " ".join(f"Größe{k} no-break日本 it's" for k in range(40))
    rows += [[200, None, None, None, None, None, None, None, None], [201, "", "en", "s0", 0, 0, "", 0.0, ""], [202, " \n\x0b\x0c\r\t ", "en", "only", 0, 0, "", 0.0, ""]]
    rows += [[203, f"{block} {block} \n{block} {block}", "fr", "s1", 0, 0, "", 0.0, ""]] * 2 + [[204, "ha " * 3000 + "x" * 3000 + "=" * 400, "en", "s1", 0, 0, "", 0.0, ""], [None, "one two", None, "s1", 0, 0, "", 0.0, ""]]
    rows += [[300 + k, f"shared words ONLY here plus w{k % 3} ÄÖ日", "xx", ("s1", "s2", None)[k % 3], 0, 0, "", 0.0, ""] for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, runs int, ids string, n double, term string")


def test_op11(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    want = []
    for r in odd.collect():
        w = planted_words(r.doc_id, r.text)
        runs = brute_runs(w, 24, 3) if r.doc_id != 204 else [tuple(x) for x in periodic.find_runs(w).tolist()]
        assert r.doc_id != 204 or (0, 3000, 1) in runs or zlib.crc32(b"204") % 10 == 0
        drop = {k for a, length, q in runs for k in range(a + q, a + length)}
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        text = b" ".join(x for k, x in enumerate(w) if k not in drop)
        want.append((r.doc_id, len(runs), *best, best[0] is not None and 1000 * best[1] // best[2] or None, hashlib.sha256("".join("%d,%d,%d\n" % x for x in runs).encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert sum(x[1] for x in want) > 5


def test_runs_keep_ids_and_columns(spark):
    rows = spark.createDataFrame([("a", "b " * 30), ("a", "b " * 30), (None, None)], "doc_id string, text string")
    got = periodic.periodic_runs(rows).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got] == [(None, 0, [], ""), ("a", 30, [(0, 30, 1)], "b"), ("a", 30, [(0, 30, 1)], "b")]
    bad = rows.select(F.col("doc_id"), F.expr("cast(unhex('61ff62') as string)").alias("text"))
    assert {r.collapsed for r in periodic.periodic_runs(bad).collect()} == {"a�b"}
    assert periodic.periodic_runs(rows.limit(0)).count() == 0 and periodic.run_digests(periodic.periodic_runs(rows.limit(0))).count() == 0


def test_op12(spark, odd, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op12_source_divergence(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op12_source_divergence"])
    assert got.columns == [d[0] for d in want.description] and dict(got.dtypes)["rank"] == "int" and dict(got.dtypes)["value"] == "bigint"
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(want.fetchall()) and {r[2] for r in rows} == {"pair", "term"} and any(r[0] == "" for r in rows) and any(r[4] == 0 for r in rows)
    assert divergence.source_divergence(odd.limit(0)).count() == 0


def test_run_length_columns():
    rng = np.random.default_rng(3)
    for _ in range(50):
        weights = rng.integers(1, 5, 30)
        a, b = (np.sort(rng.integers(0, 4, 30)) * 10 for _ in range(2))
        ends = np.cumsum(weights)
        assert divergence.distance(divergence.run_lengths(a, ends), divergence.run_lengths(b, ends)) == int((np.abs(a - b) * weights).sum())
    assert divergence.terms("Äb-C d'E 日1x_y".encode()) == ["Äb".encode(), b"c", b"d", b"e", "日".encode(), b"x", b"y"]


def test_blocks_add_up(spark, odd, monkeypatch):
    whole = sorted(map(tuple, divergence.source_divergence(odd, 2, 5).collect()))
    monkeypatch.setattr(divergence, "CELLS", 40)
    monkeypatch.setattr(divergence, "GATHERED", 100)
    assert sorted(map(tuple, divergence.source_divergence(odd, 2, 5).collect())) == whole


def test_shares_beyond_long(spark):
    n, size = 9 * 10**15, 10**16 + 7
    assert spark.range(1).select(divergence.share(F.lit(n), F.lit(size))).first()[0] == 1 + 10**9 * (n + 5) // size


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op13(spark, odd, library, tmp_path):
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op13_recursive_bpe(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_merges_of_long_words(library):
    rng, ranks = random.Random(3), recursive_bpe.ranks(PATH)
    words = ["a" * n for n in (47, 48, 49, 101, 1000)] + ["".join(rng.choice("abcde") for _ in range(rng.randint(40, 300))) for _ in range(40)]
    words += ["".join(rng.choice("ACGT") for _ in range(2000)), "日本語の文字列" * 30, "=-" * 300, "=" * 777, " " * 333]
    words = [w.encode() for w in words]
    split = lambda found: [x.tolist() for x in np.split(found[0], np.cumsum(found[1])[:-1])]
    assert split(ranks.encode_words(words)) == [library._encode_single_piece(w) for w in words]
    short = [w[: recursive_bpe.LONG - 1] for w in words if w[: recursive_bpe.LONG - 1] not in ranks.ids]
    assert split(ranks._merged(short, recursive_bpe.ALL_PAIRS)) == split(ranks._merged(short, recursive_bpe.ONE_PAIR))


def test_encode_and_decode(spark, library, monkeypatch):
    monkeypatch.setattr(recursive_bpe, "REMEMBERED", 3)
    rows = spark.createDataFrame([("a", "some words, some more"), (None, None), ("c", "<|endoftext|> é日"), ("a", "some words, some more")], "doc_id string, text string")
    got = recursive_bpe.encode(rows, PATH, queries.split_pattern())
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    assert all(r.ids == library.encode_ordinary(texts[r.doc_id]) for r in got.collect()) and got.count() == 4
    assert {r.doc_id: bytes(r.text).decode() for r in recursive_bpe.decode(got, PATH).collect()} == texts
    assert recursive_bpe.encode(rows.limit(0), PATH, queries.split_pattern()).count() == 0
    with pytest.raises(Exception, match="vocabulary"):
        recursive_bpe.decode(spark.sql("SELECT 1 AS doc_id, array(99999999) AS ids"), PATH).collect()
