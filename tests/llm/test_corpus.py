"""The corpus operators against brute force on small fixtures, and their odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import embed_dedup, fingerprints, jaccard, mixing, packing, quality, sharding, tokens, toxicity, urls
from weftline.llm.common import components
from weftline.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"
LONG = " ".join(f"w{k % 977}" for k in range(6000))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = []
    for k in range(60):
        words = [f"word{rng.randint(0, 400)}" for _ in range(rng.randint(1, 90))]
        rows.append([k, " ".join(words), "en", f"s{k % 3}", 0, "x"])
    for k in range(60, 75):  # near copies of one text
        words = rows[7][1].split()
        words[rng.randrange(len(words))] = "changed"
        rows.append([k, " ".join(words), "en", "s0", 0, "x"])
    rows += [[75, None, None, None, None, None], [76, "", "en", None, 0, "x"], [77, LONG, "en", "s1", 0, "x"], [78, LONG, "en", "s1", 0, "x"], [79, " \n", "en", "s1", 0, "x"], [80, "zwei Wörter", "de", "s2", 0, "x"], [81, "zwei WÖrter", "de", "s2", 0, "x"]]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    path = tokenizer_path("byte_bpe_50k.json")
    for df in (fingerprints.fingerprint_edits(none), fingerprints.trees(none), mixing.mix_documents(none), tokens.token_counts(none, tokenizer_path("word_bpe_49k.json")), packing.pack_documents(none, path), sharding.shard_documents(none), jaccard.jaccard_classes(none), quality.score_quality(none, None), toxicity.score_toxicity(none, None)):
        assert df.count() == 0
    assert embed_dedup.embedding_groups(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(docs).collect()}
    ids = sorted(texts)
    for i, k in enumerate(ids):
        edited = fingerprints.edited_by_next(texts[k], texts[ids[(i + 1) % len(ids)]])
        assert got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[k].n_chars == len(texts[k])
        assert 0 <= got[k].near_edited <= 1 and (got[k].fingerprint == got[k].edited_fingerprint) == (edited == texts[k])
    assert got[77].fingerprint == got[78].fingerprint and got[77].near_next == 1.0 and got[78].near_edited > 0.6
    for r in got.values():
        assert r.near_edited == fingerprints.likeness(r.fingerprint, r.edited_fingerprint)


def test_likeness_follows_the_kept_share():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghiäöü") for _ in range(rng.randint(1, 9)))
    for n in (5, 40, 45, 80, 300, 3000, 20_000):
        text, other = (" ".join(word() for _ in range(n)) for _ in range(2))
        for share in (0.25, 0.5):
            cut = int(len(text) * share)
            edited = text[: len(text) - cut] + other[:cut].ljust(cut)
            near = fingerprints.likeness(fingerprints.Tree(text).fingerprint, fingerprints.Tree(edited).fingerprint)
            assert 0 <= near < 1 and (n < 40 or abs(near - (1 - share)) <= 0.15), (n, share, near)
        assert fingerprints.likeness(fingerprints.Tree(text).fingerprint, fingerprints.Tree(other).fingerprint) < 0.2
        assert len(fingerprints.Tree(text).fingerprint) < 1200
    for text in ("a" * 3000, "ab cd\n" * 400, "x " * 900):
        near = fingerprints.likeness(fingerprints.Tree(text).fingerprint, fingerprints.Tree(fingerprints.edited_by_next(text, other)).fingerprint)
        assert abs(near - 0.75) <= 0.15, (text[:5], near)
    empty = fingerprints.Tree("").fingerprint
    assert fingerprints.likeness(empty, empty) == 1 and fingerprints.likeness(empty, fingerprints.Tree("a").fingerprint) == 0


def test_tree_covers_texts_and_locates_edits(docs):
    def by_hand(text):
        tree = fingerprints.Tree(text)
        sections = [hashlib.sha256(b"\1" + b"".join(tree.paragraphs[a:b])).digest() for _, a, b in tree.sections]
        assert [s[0] for s in tree.sections] == sections and tree.sections[0][1] == 0 and tree.sections[-1][2] == len(text.split("\n"))
        return hashlib.sha256(b"\2" + b"".join(sections)).hexdigest()

    lines = [f"line {k} of some text" for k in range(50)]
    text = "\n".join(lines)
    tree = fingerprints.Tree(text)
    assert tree.root == by_hand(text)
    for k in (0, 20, 49):
        changed = "\n".join([*lines[:k], "another", *lines[k + 1 :]])
        section, paragraph = tree.first_difference(fingerprints.Tree(changed))
        assert paragraph == k and tree.sections[section][1] <= k
    assert fingerprints.Tree("a\nb").root != fingerprints.Tree("ab").root != fingerprints.Tree("a\n\nb").root
    rows = {r.doc_id: r for r in fingerprints.trees(docs.union(docs.where("doc_id in (75, 77)"))).collect()}
    assert rows[75].fingerprint == rows[76].fingerprint == fingerprints.Tree("").fingerprint and len(rows[75].sections) == 1


def wanted_targets(sizes):
    """By hand: shares by weight, the excess over three times a source's size reshared until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        free = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        every = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else free * weight[s] / every for s in order}
        above = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("blocks, shards", [(256, 16), (3, 5), (1, 1)])
def test_mix(docs, texts, blocks, shards):
    df = docs.union(docs.where("doc_id = 3"))
    mix = lambda d: mixing.mix_documents(d, blocks=blocks, shards=shards)
    rows = mix(df).collect()
    again = mix(df.repartition(5)).collect()
    assert sorted((r.doc_id, r.placed) for r in rows) == sorted((r.doc_id, r.placed) for r in again)
    by = {r.source: (r.source_size, r.target) for r in rows}
    want = wanted_targets({s: n for s, (n, _) in by.items()})
    for source, (size, target) in by.items():
        mine = [r for r in rows if r.source == source]
        assert sum(r.size for r in mine) == size and target == pytest.approx(want[source])
        assert abs(sum(r.size * len(r.placed) for r in mine) - target) <= max([r.size for r in mine])
    assert all(len(r.placed) <= 3 and set(r.placed) <= set(range(shards)) for r in rows) and {r.size for r in rows if r.doc_id in (75, 76, 79)} == {0}
    written = mixing.mixed_rows(mix(df)).collect()
    assert sorted((r.doc_id, r.shard) for r in written) == sorted((r.doc_id, s) for r in rows for s in r.placed)


def test_split_tree_is_exact_and_disjoint(spark):
    tickets = spark.createDataFrame([(f"s{s}", b, r) for s in range(9) for b in range(40) for r in range(1, 1 + s % 3)], "source string, block int, round int")
    got = mixing.split_tree(tickets, 6, 1).collect()
    counts = [sum(r.shard == k for r in got) for k in range(6)]
    assert len({(r.source, r.block, r.round) for r in got}) == len(got) == tickets.count() and max(counts) - min(counts) <= 2
    share = [sum(r.shard == 0 and r.source == f"s{s}" for r in got) / sum(r.source == f"s{s}" for r in got) for s in (1, 2, 4, 5, 7, 8)]
    assert all(0.02 < x < 0.4 for x in share)


def test_mix_keeps_clashing_columns(docs):
    names = "rounds room whole last shards s_ b_ t_ e_ p_ key block part crc doc n key_ block_ order order_ partial edge_part dealt begin".split()
    wide = docs.select("*", *[F.lit(f"mine-{n}").alias(n) for n in names], *[F.lit("gone").alias(n) for n in ("placed", "target", "copy", "shard")])
    mixed = mixing.mix_documents(wide)
    rows = mixing.mixed_rows(mixed)
    for df in (mixed, rows):
        assert set(names) <= set(df.columns) and len(set(df.columns)) == len(df.columns)
        assert {tuple(r) for r in df.select(*names).distinct().collect()} == {tuple(f"mine-{n}" for n in names)}
    assert dict(rows.dtypes)["shard"] == "int" and rows.count() == mixing.mixed_rows(mixing.mix_documents(docs)).count()


def test_tokens(docs, texts):
    path = tokenizer_path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    for r in tokens.token_counts(docs, path).collect():
        assert r.n_tokens == len(library.encode(texts[r.doc_id], add_special_tokens=False).ids) and r.n_bytes == len(texts[r.doc_id].encode()) and r.over_limit == (r.n_tokens > 2048)
    for text in ("It's<|endoftext|> A\x1cb", "İΣς ²½ Ⅷ", "don't  \u3000x", "é<|startoftext|>é"):
        words = tokens.normal_words(text, path)
        assert sum(len(library.encode(p, add_special_tokens=False).ids) for w in words for p in tokens.pre_tokens(w)) == len(library.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("centres, block", [(1, 8192), (4, 8192), (40, 8192), (4, 50)])
def test_embeddings(spark, monkeypatch, centres, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(300 + k, (base[k % 40] + 0.05 * rng.normal(size=16)).tolist()) for k in range(120)] + [(500 + k, base[0].tolist()) for k in range(30)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None] * 8), (905, [1.0, 2.0]), (906, [1e200] * 16), (None, base[0].tolist())]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], "vec_id long, embedding array<double>, name string")
    got = {r.vec_id: r for r in embed_dedup.embedding_groups(df, centres=centres).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, links = [k for k, _ in rows], x @ x.T >= 0.9
    want = int(links.sum()) - len(rows)
    found = sum(got[k].n_links for k in ids)
    assert 0.97 * want <= found <= want and all(got[k].n_links <= links[i].sum() - 1 for i, k in enumerate(ids))
    if centres == 1:
        assert all(got[k].n_links == links[i].sum() - 1 for i, k in enumerate(ids))
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k, _ in odd[:-1]) and got[None].n_links == 0 and got[None].component_id is None and got[None].kept
    assert got[500].component_id == 0 and not got[500].kept


def test_embeddings_with_repeated_ids_and_double_precision(spark):
    at = lambda cosine: [cosine, float(np.sqrt(1 - cosine * cosine))]
    rows = [("b", [1.0, 0.0]), ("b", [0.0, -1.0]), ("c", at(0.9 + 1e-9)), ("d", at(0.9 - 1e-9)), ("a", [0.0, -2.0]), ("e", [-1.0, 0.01]), ("e", [-1.0, 0.01])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.embedding_groups(spark.createDataFrame(rows, "vec_id string, embedding array<double>")).collect())
    assert got == [("a", 1, "a"), ("b", 1, "a"), ("b", 1, "b"), ("c", 2, "b"), ("d", 1, "b"), ("e", 1, "e"), ("e", 1, "e")]


def test_packing(docs, texts):
    path = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rows = packing.pack_documents(docs, path).collect()
    ids = {k: np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    seen, filled = {k: [] for k in ids}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen[r.doc_id].append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, n in [(sorted(v), len(ids[k])) for k, v in seen.items()] + [(sorted(v), None) for v in filled.values()]:
        at = 0
        for start, length in pieces:
            assert start == at and length > 0
            at += length
        assert at == n if n else at <= 1024 and not at & (at - 1)


@pytest.mark.parametrize("seed", range(4))
def test_bm25_against_the_formula(seed, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 16 if seed % 2 else 1024)
    rng = np.random.default_rng(seed)
    whole = [rng.zipf(1.4, rng.integers(1, 90)) % 400 for _ in range(40)]
    whole[7] = whole[3]
    n, mean = len(whole), float(np.mean([len(x) for x in whole]))
    df = np.bincount(np.concatenate([np.unique(x) for x in whole]), minlength=65536)
    idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))
    # documents of 32 ids and more show the index the rest and their packed terms
    shown = [(x[len(x) - len(x) % 32 :].astype("<u2").tobytes(), packing.packed_terms(x.astype("<u2")) if len(x) >= 32 else None, len(x)) for x in whole]
    index, used = packing.Shard(shown, idf, mean), np.zeros(n, bool)
    used[[2, 5]] = True
    for k, x in enumerate(whole):
        score = []
        for y in whole:
            tf = np.bincount(y, minlength=400)[np.unique(x)]
            score.append(float((idf[np.unique(x)] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(y) / mean))).sum()))
        got = index.neighbours(k, used).tolist()
        assert sorted(got) == [j for j in range(n) if not used[j]]
        assert np.allclose([score[j] for j in got], sorted((score[j] for j in got), reverse=True))


def test_document_frequencies_are_of_whole_documents(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    texts = [" ".join(f"w{k % 9}" for k in range(n)) + tail for n, tail in ((5, " end"), (700, ""), (2500, " last"), (0, ""))]
    pieces = packing.token_pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path)
    ids = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    want = np.zeros(65538, np.int64)
    for x in ids:
        want[list(set(x))] += 1
        want[65536:] += (1, len(x))
    assert (packing.document_frequencies(pieces) == want).all()


def test_shards(docs, texts):
    rows = sharding.shard_documents(docs.union(docs.where("doc_id = 3")).withColumn("shard", F.lit("x")).withColumn("vslot", F.lit("x")), shards=5).collect()
    assert len(rows) == 83
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert {r.law for r in rows} == {"bytes"} and {r.version for r in rows} == {2} and {r.shard for r in rows} <= set(range(5))


def test_stored_slot_map_is_edited_with_few_moves(spark, tmp_path):
    rng = random.Random(8)
    path = str(tmp_path / "map")
    make = lambda ids: spark.createDataFrame([(k, "x" * rng.randint(0, 400)) for k in ids], "doc_id long, text string")
    placed = lambda df, shards: {r.doc_id: (r.shard, r.size, r.vslot, r.version) for r in sharding.shard_documents(df, shards, 256, path).collect()}

    def spread(got, shards):
        loads = [sum(size for s, size, *_ in got.values() if s == k) for k in range(shards)]
        return max(loads) - min(loads), sum(loads) / shards

    df = make(range(900)).persist()
    one = placed(df, 6)
    gap, mean = spread(one, 6)
    assert gap < 0.03 * mean and {v for *_, v in one.values()} == {2}
    again = placed(df, 6)
    assert again == one or max(v for *_, v in again.values()) == 3  # balanced: hardly anything moves
    assert sum(one[k][0] != again[k][0] for k in one) <= 6
    before = again
    more = df.union(make(range(900, 960))).persist()
    after = placed(more, 6)
    need = sum(max(0, sum(x[1] for k, x in after.items() if before.get(k, x)[0] == s) - sum(x[1] for x in after.values()) / 6) for s in range(6))
    moved = sum(after[k][1] for k in before if before[k][0] != after[k][0])
    assert moved <= need + 3000 and all(before[k][2] == after[k][2] for k in before)
    grown = placed(more, 7)
    gap, mean = spread(grown, 7)
    assert gap < 0.05 * mean and {grown[k][0] for k in after if grown[k][0] != after[k][0]} == {6}
    shrunk = placed(more, 5)
    gap, mean = spread(shrunk, 5)
    assert {x[0] for x in shrunk.values()} == set(range(5)) and gap < 0.05 * mean
    versions = {r.version for r in sharding.load_map(spark, path).collect()}
    assert versions == set(range(1, max(versions) + 1)) and sharding.load_map(spark, path).count() == 256 * len(versions)


def test_jaccard_against_brute_force(docs, texts):
    sets = {}
    for k, t in texts.items():
        words = t.encode().lower().split()
        sets[k] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: r for r in jaccard.jaccard_classes(docs).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == {k: (len(sets[k]), root(k)) for k in sets}
    assert {r.doc_id for r in jaccard.one_per_class(docs.union(docs)).collect()} == {k for k in sets if root(k) == k}


def test_jaccard_of_text_ids_repeated_ids_and_clashing_columns(spark):
    rng = random.Random(9)
    a, b = ([f"w{rng.randint(0, 500)}" for _ in range(60)] for _ in range(2))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [("1", " ".join(a)), ("1", " ".join(b)), ("2", near(b)), ("3", near(a)), ("4", "x y"), ("4", "x y"), (None, " ".join(a)), (None, " ".join(a)), ("5", ""), ("6", None)]
    df = spark.createDataFrame([(*r, k, "s") for k, r in enumerate(rows)], "doc_id string, text string, text_name int, class string")
    got = sorted((r.doc_id or "", r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(df).collect())
    assert got == [("", 56, None), ("", 56, None), ("1", 56, "1"), ("1", 56, "1"), ("2", 56, "1"), ("3", 56, "1"), ("4", 1, "4"), ("4", 1, "4"), ("5", 0, "5"), ("6", 0, "6")]
    kept = jaccard.one_per_class(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or "", r.text or "") for r in kept.collect()) == sorted([("", rows[0][1]), ("", rows[0][1]), ("1", rows[0][1]), ("1", rows[1][1]), ("4", "x y"), ("5", ""), ("6", "")])


@pytest.mark.parametrize("common", [3, 50])
def test_jaccard_of_families_against_brute_force(spark, monkeypatch, common):
    """Families around the limit of similarity, passages that many texts share, chunks smaller than the families; frequent shingles few and many."""
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    monkeypatch.setattr(jaccard, "COMMON", common)
    rng = random.Random(common)
    passage = [f"p{k}" for k in range(40)]
    rows = []
    for k in range(260):
        if k % 3 == 0 or not rows:
            words = [f"w{rng.randint(0, 900)}" for _ in range(rng.randint(3, 60))] + (passage if rng.random() < 0.4 else [])
        else:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 900)}"
        rows.append((k, " ".join(words)))
    sets = {k: set(jaccard.shingles(jaccard.words_of(t)).tolist()) for k, t in rows}
    low = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id int, text string").repartition(5)).collect()}
    assert got == low and len(links) > 100


@pytest.mark.parametrize("own_words", [True, False])
def test_jaccard_deals_a_large_family_without_all_pairs_of_chunks(spark, monkeypatch, own_words):
    """Copies of one text with edits around the limit: members of one class don't meet again, and those that nothing can link with leave the lists."""
    monkeypatch.setattr(jaccard, "CHUNK", 10)
    rng = random.Random(own_words)
    base = [f"b{k}" for k in range(140)]
    edits = [(rng.randrange(140), f"e{k}") for k in range(60)]  # without words of their own, texts share their edits
    rows = [(k, base[: 140 - k % 3]) for k in range(6)]
    for k in range(6, 400):
        words = list(base)
        for at, word in [(rng.randrange(140), f"x{k}-{j}") for j in range(rng.randint(1, 6))] if own_words else rng.sample(edits, rng.randint(1, 6)):
            words[at] = word
        rows.append((k, words))
    rows = [(k, " ".join(words)) for k, words in rows]
    sets = {k: set(jaccard.shingles(jaccard.words_of(t)).tolist()) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    low = {k: k for k in sets}
    while any(low[a] != low[b] for a, b in links):
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    dealt, given = [], jaccard.needed_members

    def needed(members):
        dealt.append((members.count(), members.select("key", "text_name").distinct().count()))
        return given(members)

    monkeypatch.setattr(jaccard, "needed_members", needed)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id int, text string").repartition(5)).collect()}
    assert got == low and 1 < len(set(low.values())) < 390
    if own_words:
        assert all(n <= 6 * memberships and n < 10 * len(rows) for n, memberships in dealt)


def test_components_of_a_long_chain(spark):
    rng = random.Random(1)
    ids = rng.sample(range(100_000), 5001)
    got = components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long")).collect()
    assert len(got) == 5001 and {r.component for r in got} == {min(ids)}


@pytest.mark.parametrize("seed", range(5))
def test_divide_skip_finds_what_counting_finds(seed):
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 1 << 40, 60, dtype=np.uint64)
    sets = []
    for _ in range(120):
        base = sets[rng.integers(len(sets))] if sets and rng.random() < 0.6 else rng.integers(0, 1 << 40, rng.integers(1, 90), dtype=np.uint64)
        keep = base[rng.random(len(base)) < rng.uniform(0.7, 1)]
        sets.append(np.unique(np.concatenate([keep, common[: rng.integers(0, 60)] if rng.random() < 0.5 else keep[:0], rng.integers(0, 1 << 40, 2, dtype=np.uint64)])))
    index = jaccard.Index(sets)
    for q in sets:
        want = [k for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 75 * len(np.union1d(q, s))]
        assert sorted(index.search(q, len(q), lambda d: False)) == want


def test_quality_and_toxicity(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice(("an", "the", "in", "or", "re", "sh", "ti")) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(400):
        words = [word() for _ in range(rng.randint(30, 120))]
        bad, toxic = k % 5 == 0, k % 3 == 0
        if bad:
            words = [w + rng.choice(("$$$", "###", "%%%")) for w in words]
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(("moron", "scum", "idiot"))
        rows.append((k, " ".join(words)))
        labels.append((k, int(not bad), int(toxic)))
    rows += [(900, None), (901, "")]
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, None, None)], "doc_id long, quality int, toxic int")
    model, tagger = quality.train(df, known.where("doc_id % 4 <> 0")), toxicity.train(df, known.where("doc_id % 4 <> 0"))
    q = {r.doc_id: r for r in quality.score_quality(df, model).collect()}
    t = {r.doc_id: r for r in toxicity.score_toxicity(df, tagger).collect()}
    held = [x for x in labels if x[0] % 4 == 0]
    assert np.mean([q[k].predicted == y for k, y, _ in held]) > 0.95 and np.mean([t[k].predicted == y for k, _, y in held]) > 0.95
    assert q[900].score == q[901].score and t[900].score == t[901].score and t[901].spans == []
    text = dict(rows)[0]
    assert any(text[s.begin : s.end] in ("moron", "scum", "idiot") for s in t[0].spans)


TOXIC = ("moron", "scum", "idiot")


def planted(spark, n, toxic):
    rng = random.Random(5)
    rows = []
    for k in range(n):
        words = ["".join(rng.choice(("an", "the", "in", "or", "re", "sh", "ti")) for _ in range(rng.randint(1, 3))) for _ in range(60)]
        if k in toxic:
            for at in rng.sample(range(60), 6):
                words[at] = rng.choice(TOXIC)
        rows.append((k, " ".join(words), "en", "s", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_few_toxic_labels_still_drop_toxic_documents(spark, tmp_path):
    import corpus_pipeline

    toxic = [k for k in range(300) if k % 15 == 0]
    df = planted(spark, 300, set(toxic))
    known = [k for k in toxic if zlib.crc32(str(k).encode()) % 3 != 1][:4]  # the stage leaves out a third of the ids
    labels = [(k, 1) for k in known] + [(k, 0) for k in range(300) if k not in toxic]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, df, str(tmp_path)).collect()}
    clean = {r.doc_id for r in df.collect() if not set(r.text.split()) & set(TOXIC)}
    assert not kept - clean and len(kept) >= 0.97 * len(clean)


def test_rare_toxic_labels_are_all_sampled(spark):
    toxic = {k for k in range(600) if k % 60 == 0}
    df = planted(spark, 600, toxic)
    labels = spark.createDataFrame([(k, int(k in toxic)) for k in range(600)], "doc_id long, toxic int")
    got = {r.doc_id for r in toxicity.score_toxicity(df, toxicity.train(df, labels, labelled=20)).collect() if r.predicted}
    assert toxic <= got and len(got - toxic) <= 30


def test_tagger_exists_whenever_both_classes_do(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, None)], "doc_id long, text string")
    for labels in ([(1, 1), (2, 0)], [(3, 1), (4, 0)]):
        tagger = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert tagger is not None and toxicity.score_toxicity(df, tagger).where("score between 0 and 1").count() == 4
    assert toxicity.train(df, spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")) is None


def test_urls(spark):
    rows = [
        (1, "http://A.example.net/en/1?x"), (2, "https://example.net/fr/"), (3, "http://m.example.com/de/3#t"), (4, "http://x.org/fr/x"), (5, "http://network/"), (6, None), (7, "no scheme"),
        (8, "ftp://casinowin.example.com?/en/"), (9, "http://river.example.com/a/b"), (10, "http://net"), (11, "HTTP://CheapPills.shop/x://y"), (12, "http://bigwin.shop/"), (12, "http://bigwin.shop/"),
    ]
    rows += [(100 + k, f"http://river{k % 7}.example.com/en/{k}") for k in range(60)] + [(200 + k, f"http://win{'-' * (k % 2)}casino.example.com/en/{k}") for k in range(6)]
    df = spark.createDataFrame([(*r, "<title>river water</title><script>junk</script><p>big cheap <b>win</b> pills&nbsp;casino", "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r for r in urls.judge_urls(df).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[2].rule == "net/" and got[3].rule == "example.com/de/" and got[4].rule == "org/fr/" and got[5].rule is None
    assert (got[6].host, got[6].path, got[7].verdict) == ("", "", "allow") and (got[10].rule, got[10].path) == (None, "")
    assert got[8].verdict == "block" and got[8].words == ["casino", "win", "example"] and got[8].path == "" and got[9].verdict == "allow" and got[11].verdict == "block"
    assert got[12].words == ["big", "win"] and not set(got[12].words) & set(urls.SEEDS) and got[12].verdict == "block"  # by a word learned from other hosts
    assert urls.judge_urls(df.withColumn("html", F.lit(None).cast("string"))).count() == len(rows)


def test_visible_words_and_names(spark):
    df = spark.createDataFrame([("<html><TITLE>Äb c1d</TITLE><!-- no --><style>no{}</style><p class='no'>e&amp;f<ScRiPt>no</script >g", "a-b1c.d-e.co.uk"), (None, "localhost"), ("", "x.y.com:80"), ("a<b", "www.x.org.")], "html string, host string")
    got = df.select(urls.visible_words(F.col("html")).alias("w"), urls.names_of(F.col("host")).alias("n")).collect()
    assert [r.w for r in got] == [["äb", "c", "d", "e", "f", "g"], None, [], ["a", "b"]]
    assert [r.n for r in got] == [["a", "b", "c", "d", "e"], ["localhost"], ["x", "y"], ["www", "x"]]


@pytest.mark.parametrize("seed", range(30))
def test_viterbi_against_all_splits(seed):
    rng = random.Random(seed)
    name = "".join(rng.choice("ab") for _ in range(rng.randint(1, 9)))
    counts = {"".join(rng.choice("ab") for _ in range(rng.randint(1, 5))): rng.randint(1, 50) for _ in range(8)}
    total = 100.0
    cost = lambda w: min(np.log(total / counts[w]) if w in counts else np.inf, np.log(total) + (len(w) - 1) * np.log(10))
    every = [[name[i:j] for i, j in zip((0, *at), (*at, len(name)))] for k in range(1 << (len(name) - 1)) for at in [[p + 1 for p in range(len(name) - 1) if k >> p & 1]]]
    spans = [(i, j, counts[name[i:j]]) for i in range(len(name)) for j in range(i + 1, len(name) + 1) if name[i:j] in counts]
    got = urls.best_split(name, spans, np.log(total))
    assert "".join(got) == name and np.isclose(sum(map(cost, got)), min(sum(map(cost, s)) for s in every))


def test_segments_of_long_and_unknown_names(spark):
    counts = spark.createDataFrame([("river", 50.0), ("boat", 20.0)], "word string, n double")
    names = ["riverboat", "zzzz", "zzriverzz", "q" * 300, "river" * 40]
    got = {r.name: r.words for r in urls.segment(spark.createDataFrame([(n,) for n in names], "name string"), counts).collect()}
    assert got == {"riverboat": ["river", "boat"], "zzzz": ["zzzz"], "zzriverzz": ["zz", "river", "zz"], "q" * 300: ["q" * 300], "river" * 40: ["river"] * 40}


def test_bayes_against_counts_by_hand(spark):
    hosts = [("h1", ["casino", "win"], 4), ("h2", ["river", "win"], 3), ("h3", ["casino"], 2), ("h4", ["poker", "casino", "river"], 1), ("h5", ["river"], 10), ("h6", [], 5)]
    shapes = [("h1", "en", 4), ("h2", "de", 3), ("h3", "en", 2), ("h4", "", 1), ("h5", "en casino", 10), ("h6", "de", 5)]
    seeds = {"casino", "poker"}
    b, a = {w: 0 for w in seeds}, {w: 0 for w in seeds}
    for _, words, n in hosts:
        for w in words:
            others = set(words) - {w}
            if others & seeds or w not in seeds:
                side = b if others & seeds else a
                side[w] = side.get(w, 0) + n
    label = {h: bool(set(w) & seeds) for h, w, _ in hosts}
    for h, shape, n in shapes:
        for w in shape.split():
            side = b if label[h] else a
            side[w] = side.get(w, 0) + n
    every = set(a) | set(b)
    odds = lambda w: np.log((b.get(w, 0) + (50 if w in seeds else 1)) / (sum(b.values()) + len(every) + 1)) - np.log((a.get(w, 0) + 1) / (sum(a.values()) + len(every) + 1))
    got, prior = urls.token_odds(spark.createDataFrame(hosts, "host string, words array<string>, pages long"), spark.createDataFrame(shapes, "host string, shape string, pages long"), sorted(seeds))
    assert {r.token: pytest.approx(r.odds) for r in got.collect()} == {w: odds(w) for w in every} and prior == pytest.approx(np.log((7 + 1) / (25 - 7 + 1)))


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids, before = {r.doc_id for r in docs.collect()}, docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, sf)
        path = str(tmp_path / name)
        out.write.parquet(path)
        before = spark.read.parquet(path)
        if k < 4:
            assert before.columns == docs.columns and {r.doc_id for r in before.select("doc_id").collect()} <= ids
    assert before.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "mix", "pack"]


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 8):
        for _ in range(5):
            tagger = toxicity.Tagger({}, -1.3, rng.normal(size=(2, 2)))
            emit = np.where(rng.random(n) < 0.5, rng.normal(size=n), 0.0)
            weight, single, double = 0.0, np.zeros(n), {}
            for tags in np.ndindex(*[2] * n):
                score = sum(t * (e + tagger.bias) for t, e in zip(tags, emit)) + sum(tagger.trans[a, b] for a, b in zip(tags, tags[1:]))
                weight += np.exp(score)
                single += np.exp(score) * np.array(tags)
                for k in range(n - 1):
                    double.setdefault(k, np.zeros((2, 2)))[tags[k], tags[k + 1]] += np.exp(score)
            at, p, pairs = tagger.marginals(emit, joint=True)
            assert at.tolist() == np.flatnonzero(emit).tolist() and np.allclose(p, (single / weight)[at])
            for k, (a, b) in enumerate(zip(at, at[1:])):
                if b == a + 1:
                    assert np.allclose(pairs[k], double[a] / weight)
    long = toxicity.Tagger({}, -2.0, np.array([[0.5, -1.0], [-1.0, 0.7]]))
    emit = np.zeros(60_000)
    emit[[0, 50_000]] = 3.0
    assert np.isfinite(long.marginals(emit)[1]).all() and np.allclose(long._run(5000), long._run(50_000))


def test_calibration_of_separable_and_single_valued_data():
    for sums, toxic in (([0.0, 0.0, 5.0, 6.0] * 50, [0, 0, 1, 1] * 50), ([0.0] * 10, [0, 1] * 5), ([0.0, 4.0], [0, 1]), ([4.0, 0.0], [0, 1])):
        a, b = toxicity.calibrate(np.array(sums), np.array(toxic, float))
        assert np.isfinite([a, b]).all() and abs(a) < 50 and abs(b) < 50
    a, b = toxicity.calibrate(np.array([0.0, 0.0, 5.0, 6.0] * 50), np.array([0.0, 0.0, 1.0, 1.0] * 50))
    score = lambda x: 1 / (1 + np.exp(-a - b * np.log(x + 1e-3)))
    assert 0 < score(0) < 0.1 and 0.9 < score(5) < 1
