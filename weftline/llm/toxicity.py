"""Toxicity: a linear-chain conditional random field tags toxic tokens; their marginals give document scores and spans."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, prepare, whole_texts
from .quality import sampled

#: Letters of a token's beginnings that are features besides the token itself.
PREFIXES = (3, 4, 5, 6)
#: Words kept in a worker's table at most.
CACHE = 300_000
_NOT_WORD = re.compile(r"[\W_]+")
#: Features of a token whose neighbour before or after it has an indicative feature.
AFTER, BEFORE = "\tafter", "\tbefore"


def token_features(token: str) -> list[str]:
    """Of a lower-cased token: its words (split at signs) and their beginnings."""
    out = []
    for word in _NOT_WORD.split(token):
        if word:
            out.append("=" + word)
            out += [word[:n] for n in PREFIXES if len(word) > n]
    return out


@dataclass
class Tagger:
    """A chain of two states, clean and toxic. weights: of the toxic state, by feature; bias: of the toxic state, for each token.

    Tokens without a weighted feature all have the same potentials, so a run of k of them is one matrix power.
    """

    weights: dict[str, float]
    bias: float
    trans: np.ndarray  # 2 x 2 log potentials
    a: float = 0.0
    b: float = 1.0
    _seen: dict[str, float] = field(default_factory=dict)
    _runs: dict[int, np.ndarray] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "_seen": {}, "_runs": {}}

    def emissions(self, tokens: list[str]) -> np.ndarray:
        seen, get = self._seen, self.weights.get
        if len(seen) > CACHE:
            seen.clear()
        for token in set(tokens).difference(seen):
            seen[token] = sum(get(f, 0.0) for f in set(token_features(token)))
        emit = np.fromiter(map(seen.__getitem__, tokens), np.float64, len(tokens))
        at = np.flatnonzero(emit)
        if len(at):
            np.add.at(emit, at[at > 0] - 1, get(BEFORE, 0.0))
            np.add.at(emit, at[at < len(emit) - 1] + 1, get(AFTER, 0.0))
        return emit

    def _run(self, k: int) -> np.ndarray:
        """trans, then k tokens without features each followed by trans; scaled to a largest entry of 1."""
        found = self._runs.get(k)
        if found is None:
            t = np.exp(self.trans)
            step = np.array([[1.0], [np.exp(self.bias)]]) * t
            found = t @ np.linalg.matrix_power(step / np.abs(np.linalg.eigvals(step)).max(), k)  # largest eigenvalue 1: powers neither overflow nor vanish
            found = found / found.max()
            if len(self._runs) < 10_000:
                self._runs[k] = found
        return found

    def marginals(self, emit: np.ndarray, joint: bool = False) -> tuple:
        """(places of the tokens with features, probability that each is toxic), by forward-backward over the whole text.

        joint: also the 2 x 2 probabilities of each such token and the next one.
        """
        at = np.flatnonzero(emit)
        pairs = np.zeros((max(0, len(at) - 1), 2, 2))
        if not len(at):
            return (at, np.zeros(0), pairs) if joint else (at, np.zeros(0))
        gaps = np.diff(at, prepend=-1, append=len(emit)) - 1
        local = np.stack([np.ones(len(at)), np.exp(np.clip(emit[at] + self.bias, -30, 30))], 1)
        edge = np.ones(2)
        fwd = np.empty((len(at), 2))
        left = edge if gaps[0] == 0 else edge * np.array([1.0, np.exp(self.bias)]) @ self._run(gaps[0] - 1)
        for k in range(len(at)):
            f = left * local[k]
            fwd[k] = f / f.sum()
            left = fwd[k] @ self._run(gaps[k + 1])
        back = self._run(gaps[-1] - 1) @ (edge * np.array([1.0, np.exp(self.bias)])) if gaps[-1] else edge
        p = np.empty(len(at))
        for k in range(len(at) - 1, -1, -1):
            both = fwd[k] * back
            p[k] = both[1] / both.sum()
            if joint and k:
                pairs[k - 1] = fwd[k - 1][:, None] * self._run(gaps[k]) * (back * local[k])
                pairs[k - 1] /= pairs[k - 1].sum()
            back = self._run(gaps[k]) @ (back * local[k])
            back /= back.max()
        return (at, p, pairs) if joint else (at, p)

    def document(self, text: str, spans: bool = True) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of the whole text and the toxic spans (begin, end in code points, probability)."""
        tokens = text.lower().split()
        at, p = self.marginals(self.emissions(tokens))
        score = float(1 / (1 + np.exp(-np.clip(self.a + self.b * np.log(p.sum() + 1e-3), -30, 30))))
        found = []
        if spans and len(p) and p.max() >= 0.5:
            want = {int(i): float(q) for i, q in zip(at, p) if q >= 0.5}
            found = [(m.start(), m.end(), want[k]) for k, m in enumerate(re.finditer(r"\S+", text)) if k in want]
        return score, found


def one_of_each_family(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of labelled documents of a class that share their smallest hash of four words in a row, one: copies of a text mustn't vote often.

    A family with labels of both classes keeps one of each, so that no class is lost here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            families = []
            for text in batch.column(0).to_pylist():
                w = (text or "").lower().split()
                families.append(min(map(xxhash.xxh3_64_intdigest, {" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))})) >> 1)
            yield pa.RecordBatch.from_arrays([pa.array(families, pa.int64()), batch.column(1), batch.column(2)], ["family", "doc_id", "toxic"])

    rows = docs.join(F.broadcast(labels), "doc_id").select("text", "doc_id", "toxic").mapInArrow(run, f"family long, doc_id {dict(docs.dtypes)['doc_id']}, toxic int")
    return cut(rows.groupBy("family", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic").distinct(), "labelled")


def indicative_features(docs: DataFrame, labels: DataFrame, least: int = 5, share: float = 0.03, most: int = 4000, odds: float = 6.0, evidence: float = 25.0) -> dict[str, float]:
    """Features that toxic documents hold much more often than others: feature -> log odds. At most ``most`` reach the driver.

    A feature needs ``least`` toxic documents and that share of them (a few copies of one text mustn't make its words features), the odds, and
    ``evidence``: toxic documents times log odds. Below 2 * ``least`` toxic documents, ``least`` and ``evidence`` shrink with their number.
    If no feature passes, those with at least half of the best one's evidence are taken, with counts smoothed by 0.5.

    labels: doc_id, toxic of at most a bounded number of rows, broadcast. Documents are counted, not tokens.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[toxic].update({f for t in set((text or "").lower().split()) for f in token_features(t)})
            names = [k for k in held[1]] + [k for k in held[0] if k not in held[1]]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([held[1][k] for k in names], pa.int64()), pa.array([held[0][k] for k in names], pa.int64())], ["feature", "toxic", "clean"])

    both = docs.join(F.broadcast(labels), "doc_id")
    totals = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = both.select("text", F.col("toxic").cast("int")).mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = cut(counts.where("toxic > 0"), "features")
    few = min(1.0, n1 / (2 * least))

    def best(smooth: float, passes) -> list:
        ratio = ((F.col("toxic") + smooth) / (n1 + 2 * smooth)) / ((F.col("clean") + smooth) / (n0 + 2 * smooth))
        scored = counts.withColumn("ratio", ratio).withColumn("evidence", F.log("ratio") * F.col("toxic")).where(passes)
        return scored.orderBy(F.col("evidence").desc(), "feature").limit(most).collect()

    rows = best(0.1, (F.col("toxic") >= max(least * few, share * n1)) & (F.col("ratio") >= odds) & (F.col("evidence") >= evidence * few))
    if not rows:
        rows = best(0.5, F.col("ratio") > 1)
        rows = [r for r in rows if r["evidence"] >= rows[0]["evidence"] / 2]
    return {r["feature"]: float(np.log(r["ratio"])) for r in rows}


@dataclass
class Sequence:
    """A document for the fit: places of its tokens with features, those features (flat, and how many each place has), its length and label."""

    places: np.ndarray
    flat: np.ndarray
    width: np.ndarray
    length: int
    toxic: int
    tags: np.ndarray | None = None

    def emit(self, weights: np.ndarray) -> np.ndarray:
        out = np.zeros(self.length)
        out[self.places] = np.bincount(np.repeat(np.arange(len(self.places)), self.width), weights[self.flat], len(self.places))
        out[self.places[out[self.places] == 0]] = 1e-9  # a token with features stays in sight
        return out


def fit_chain(sequences: list[Sequence], n: int, start: np.ndarray | None = None, steps: int = 20, rate: float = 0.2, decay: float = 2e-3) -> np.ndarray:
    """Maximum likelihood of the labelled tokens by Adam on forward-backward expectations: n weights, the bias, the four transitions.

    Runs without features are steps of one matrix power here too.
    """
    theta = np.concatenate([np.full(n, 1.0), [-3.0], np.zeros(4)]) if start is None else start.copy()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        tagger = Tagger({}, theta[n], theta[n + 1 :].reshape(2, 2))
        grad = np.zeros_like(theta)
        tokens = 0
        for s in sequences:
            if not len(s.places):
                continue
            _, p, pairs = tagger.marginals(s.emit(theta[:n]), joint=True)
            diff = s.tags - p
            grad[:n] += np.bincount(s.flat, np.repeat(diff, s.width), n)
            grad[n] += diff.sum()
            tokens += len(diff)
            for i in np.flatnonzero(np.diff(s.places) == 1):  # transitions are learned where both tokens have features
                grad[n + 1 :] -= pairs[i].ravel()
                grad[n + 1 + 2 * int(s.tags[i]) + int(s.tags[i + 1])] += 1
        grad = grad / max(1, tokens) * 100 - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta[n] = np.clip(theta[n], -8, -1)
        theta[n + 1 :] = np.clip(theta[n + 1 :], -2, 2)
    return theta


def refine(sequences: list[Sequence], theta: np.ndarray, n: int) -> None:
    """Label tokens anew under their document's label: in a toxic document those with a marginal of a half or more, and at least the likeliest one; else none."""
    tagger = Tagger({}, theta[n], theta[n + 1 :].reshape(2, 2))
    for s in sequences:
        if s.toxic and len(s.places):
            p = tagger.marginals(s.emit(theta[:n]))[1]
            s.tags = (p >= min(0.5, p.max())).astype(float)


def calibrate(sums: np.ndarray, toxic: np.ndarray, weight: np.ndarray | None = None, ridge: float = 0.1, steps: int = 100) -> tuple[float, float]:
    """a, b of P(toxic) = sigmoid(a + b log(sum of marginals + 0.001)): ridge logistic regression by Newton steps, each halved until the loss falls.

    The ridge keeps a and b finite where the classes can be told apart without error. weight: of each document.
    """
    x = np.stack([np.ones(len(sums)), np.log(sums + 1e-3)], 1)
    weight = np.ones(len(sums)) if weight is None else weight
    w = np.array([0.0, 1.0])
    loss = lambda w: (weight * np.logaddexp(0, (1 - 2 * toxic) * (x @ w))).sum() + ridge / 2 * (w @ w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step, size = np.linalg.solve(h, x.T @ (weight * (toxic - p)) - ridge * w), 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
        w = w + size * step
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, labelled: int = 8000, chain: int = 800, rounds: int = 3) -> Tagger | None:
    """Fit on at most about ``labelled`` labelled rows of each class (for the features) and ``chain`` of them (for the chain), chosen by a hash of the id.

    labels: doc_id, toxic; the caller leaves out held-out rows; null labels are left out. The token labels are hidden: at first the tokens of a toxic
    document with an indicative feature are toxic, all others clean; then the chain is fitted and the tokens are labelled anew by it, ``rounds`` times (hard EM
    under the document labels). The classes are sampled apart, so that a rare one isn't lost; the calibration weighs them half way (geometrically) back to the labels' shares.
    None only if one of the classes is missing. An empty table has no classes.
    """
    docs = whole_texts(docs)
    prepare(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select("doc_id", "text")
    share = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    known = one_of_each_family(texts, sampled(known.where("toxic = 1"), labelled).union(sampled(known.where("toxic = 0"), labelled)))
    if known.select("toxic").distinct().count() < 2:
        return None
    found = indicative_features(texts, known)
    names = [*sorted(found), BEFORE, AFTER]
    place = {f: k for k, f in enumerate(names)}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tokens = (text or "").lower().split()
                own = {k: fs for k, t in enumerate(tokens) if (fs := sorted({place[f] for f in token_features(t) if f in place}))}
                at = {k: list(own.get(k, ())) for k in sorted({k + d for k in own for d in (-1, 0, 1) if 0 <= k + d < len(tokens)})}
                for k in own:
                    if k:
                        at[k - 1].append(place[BEFORE])
                    if k + 1 < len(tokens):
                        at[k + 1].append(place[AFTER])
                rows.append((list(at.values()), list(at), len(tokens), toxic))
            kinds = (pa.list_(pa.list_(pa.int32())), pa.list_(pa.int32()), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["features", "places", "tokens", "toxic"])

    # both classes, each at most ``chain``
    ids = known.where("toxic = 1").orderBy(F.xxhash64("doc_id")).limit(chain).union(known.where("toxic = 0").orderBy(F.xxhash64("doc_id")).limit(chain))
    rows = texts.join(F.broadcast(ids), "doc_id").select("text", "toxic").mapInArrow(reduce, "features array<array<int>>, places array<int>, tokens int, toxic int").collect()
    rows.sort(key=lambda r: (r["toxic"], r["tokens"], r["places"], r["features"]))  # the order in which tasks end mustn't matter
    n = len(names)
    sequences = []
    for r in rows:
        flat = np.array([f for fs in r["features"] for f in fs], np.int64)
        s = Sequence(np.array(r["places"], np.int64), flat, np.array([len(fs) for fs in r["features"]], np.int64), r["tokens"], r["toxic"])
        s.tags = np.array([float(s.toxic and any(f < n - 2 for f in fs)) for fs in r["features"]])
        sequences.append(s)
    theta = fit_chain(sequences, n)
    for _ in range(rounds):
        refine(sequences, theta, n)
        theta = fit_chain(sequences, n, theta, steps=8)
    tagger = Tagger(dict(zip(names, theta[:n].tolist())), float(theta[n]), theta[n + 1 :].reshape(2, 2))
    toxic = np.array([s.toxic for s in sequences], float)
    sums = np.array([tagger.marginals(s.emit(theta[:n]))[1].sum() for s in sequences])
    held = {k: max(1, (toxic == k).sum()) for k in (0, 1)}
    weight = np.where(toxic == 1, share[1] / held[1], share[0] / held[0])
    tagger.a, tagger.b = calibrate(sums, toxic, np.sqrt(weight) / np.sqrt(weight).sum() * len(weight))
    return tagger


def with_toxicity(docs: DataFrame, tagger: Tagger | None, threshold: float = 0.7, spans: bool = True) -> DataFrame:
    """docs with score (0 to 1), predicted (score >= threshold) and spans (begin, end, probability) of every whole text.

    Null and empty texts get the score of a text without any indicative token and no spans; without a tagger every score is 0; equal texts score
    alike; an empty table gives no rows; columns of docs with those names are replaced; labels, language, source and id don't enter.
    """
    docs = whole_texts(docs)
    prepare(docs.sparkSession)
    docs = docs.drop("score", "predicted", "spans")
    at = docs.columns.index("text")
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [tagger.document(t or "", spans) if tagger else (0.0, []) for t in batch.column(at).to_pylist()]
            score = np.array([g[0] for g in got], np.float64)
            found = pa.array([[dict(zip(("begin", "end", "probability"), x)) for x in g[1]] for g in got], span)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), found], [*batch.schema.names, "score", "predicted", "spans"])

    kind = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("probability", T.DoubleType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", kind)]))


def score_toxicity(docs: DataFrame, tagger: Tagger | None, threshold: float = 0.7, spans: bool = True) -> DataFrame:
    """doc_id, score, predicted and spans of every whole text; see with_toxicity."""
    return with_toxicity(docs.select("doc_id", "text"), tagger, threshold, spans).drop("text")
