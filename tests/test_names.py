"""The similarity join of names against all pairs, and the similarity against DuckDB's."""

import random

import duckdb
import numpy as np
import pytest

from weftline.operators import drift


def names(rng, n):
    words = "customer order id key name total amount price date created updated status email phone address city zip_code tax net gross Ünit größe".split()
    made = []
    for _ in range(n):
        w = "_".join(rng.choice(words) for _ in range(rng.randint(1, 3)))
        w = "".join(rng.choice("abcxyz_") if rng.random() < 0.1 else c for c in w if rng.random() > 0.05)
        made.append(w[: rng.randint(1, 30)] if rng.random() < 0.3 else w)
    return [*made, "", "a", "ab", "A", "x" * 70, "X" * 69 + "y"]


def all_pairs(a, b):
    a, b = (sorted({x for x in v if x}) for v in (a, b))
    s = np.concatenate([drift.winklers([x.lower()] * len(b), [y.lower() for y in b]) for x in a]).reshape(len(a), len(b))
    return {(a[i], b[j]): s[i, j] for i, j in zip(*np.nonzero(s >= 0.85))}


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_names(spark, seed):
    rng = random.Random(seed)
    a, b = names(rng, 700), names(rng, 700)
    got = drift.similar_names(*(spark.createDataFrame([(x,) for x in [*v, None]], "name string") for v in (a, b)))
    rows = got.collect()
    want = all_pairs(a, b)
    assert {(r.old_name, r.new_name) for r in rows} == set(want)
    assert len(rows) == len({(r.old_name, r.new_name) for r in rows}) == len(want) > 1000
    assert all(abs(want[r.old_name, r.new_name] - r.s) < 1e-9 for r in rows)


def test_winkler_of_batches():
    rng = random.Random(7)
    a, b = ([" ".join(rng.choice(["ab", "ba", "abc", "xyz", "", "m"]) for _ in range(rng.randint(0, 5))) for _ in range(400)] for _ in range(2))
    want = [duckdb.execute("SELECT jaro_winkler_similarity(?, ?)", [x, y]).fetchone()[0] if x or y else 1.0 for x, y in zip(a, b)]
    assert np.allclose(drift.winklers(a, b), want, atol=1e-12) and len(drift.winklers([], [])) == 0


def test_keys_keep_tables_apart_and_types_raise_confidence(spark):
    old = spark.createDataFrame([("f", "customer_name", "text"), ("g", "customer_name", "text"), ("f", "kept", "text"), (None, "customer_name", "text")], "file string, column string, semantic_type string")
    new = spark.createDataFrame([("f", "customer_names", "text"), ("h", "customer_names", "text"), ("f", "kept", "text"), ("f", "custmer_name", None)], "file string, column string, semantic_type string")
    got = drift.rename_candidates(old, new, ("file",)).collect()
    assert [(r.file, r.old_name, r.new_name, r.type_match, r.confidence == 1.0) for r in got] == [("f", "customer_name", "customer_names", True, True), ("f", "customer_name", "custmer_name", False, False)]
    assert drift.rename_candidates(old.limit(0), new.limit(0)).count() == 0
    matched = drift.match_columns(spark.createDataFrame([("KEPT",), ("customer_nam",), ("zzz",)], "name string"), ["kept", "customer_name"])
    assert {(r.name, r.match) for r in matched.collect()} == {("KEPT", "kept"), ("customer_nam", "customer_name"), ("zzz", None)}
