"""Every stage of the pipeline against a plain computation on what the stage before it kept."""

import itertools
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weftline.llm import quality, toxicity
from weftline.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near_copies(rows):
    """Classes of rows linked by 5-word shingles of similarity 0.75 or more, all pairs compared."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {r.doc_id: WORD.findall((r.text or "").translate(lower)) for r in rows}
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    classes = defaultdict(set)
    for d in sets:
        classes[root(d)].add(d)
    return list(classes.values())


def targets(sizes):
    """Words that each source should get: all words shared by weights 5, 2, 1, repeating, none above three times its size."""
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    fixed, free, rest = {}, dict(sizes), float(sum(sizes.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * free[s]]
        if not over:
            return fixed | share
        for s in over:
            fixed[s] = 3.0 * free.pop(s)
            rest -= fixed[s]
    return fixed


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_against_plain_computation(spark, tmp_path):
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    df, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    before = {}
    for name, stage in corpus_pipeline.STAGES:
        before[name] = df
        stage(spark, df, SF).write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        kept[name] = df.collect()
    ids = lambda rows: sorted(r.doc_id for r in rows)

    tagger = toxicity.train(before["toxicity"], labels.where(quality.fold("doc_id", 3) != 1))
    scored = toxicity.score_toxicity(before["toxicity"], tagger, threshold=0.7).collect()
    assert ids(kept["toxicity"]) == ids(r for r in scored if r.score < 0.7)

    model = quality.train(before["quality"], labels.where(quality.fold("doc_id", 5) != 0))
    score = lambda t: 1 / (1 + np.exp(-(float(np.clip((quality.features(t) - model.mean) / model.scale, -8, 8) @ model.weights) + model.bias)))
    assert ids(kept["quality"]) == ids(r for r in kept["toxicity"] if score(r.text or "") >= 0.3)

    classes = near_copies(kept["quality"])
    assert any(len(c) > 1 for c in classes) and all(len(c & set(ids(kept["near_copies"]))) == 1 for c in classes)
    assert len(kept["near_copies"]) == len(classes)

    size = {r.doc_id: len(WORD.findall(r.text or "")) for r in kept["near_copies"]}
    source = {r.doc_id: r.source for r in kept["near_copies"]}
    copies = Counter(ids(kept["mix"]))
    assert set(copies) <= set(size) and max(copies.values()) <= 3
    of, taken, largest = Counter(), Counter(), Counter()
    for d, n in size.items():
        of[source[d]] += n
        taken[source[d]] += n * copies[d]
        largest[source[d]] = max(largest[source[d]], n)
    for s, want in targets(of).items():
        assert abs(taken[s] - want) <= 3 * largest[s], (s, taken[s], want)
    texts = {r.doc_id: r.text for r in kept["near_copies"]}
    assert all(r.text == texts[r.doc_id] for r in kept["mix"])

    library = tokenizers.Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tokens = {d: [*library.encode(texts[d] or "", add_special_tokens=False).ids, 0] for d in copies}
    held, sequences = Counter(), defaultdict(list)
    for r in kept["pack"]:
        piece = tokens[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length > 0 and r.doc_tokens == len(tokens[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(piece, "<u4").tobytes())
        held.update((r.doc_id, k) for k in range(r.start, r.start + r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert held == Counter({(d, k): n for d, n in copies.items() for k in range(len(tokens[d]))})
    for pieces in sequences.values():
        ends = list(itertools.accumulate((n for _, n in sorted(pieces)), initial=0))
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 1024
