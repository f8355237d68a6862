"""Quality classifier: positive-unlabelled learning with the non-negative risk estimator."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, whole_texts

#: Places for hashed pairs of bytes, and measures of the whole text after them.
PAIRS, MEASURES = 512, 12


def features(text: str) -> np.ndarray:
    """Of the whole text: square roots of the shares of hashed byte pairs, then measures of repetition, signs and shape."""
    out = np.zeros(PAIRS + MEASURES, np.float32)
    data = text.encode()
    if not data:
        return out
    code = np.frombuffer(data, np.uint8)
    pair = code[:-1].astype(np.uint32) << 8 | code[1:]
    out[:PAIRS] = np.sqrt(np.bincount((pair * np.uint32(2654435761)) >> np.uint32(23), minlength=PAIRS) / max(1, len(pair)))
    seen = np.bincount(code, minlength=256)
    words, lines = text.split(), text.split("\n")
    n = max(1, len(words))
    pairs = set(zip(words, words[1:]))
    share = lambda lo, hi: seen[lo:hi].sum() / len(code)
    out[PAIRS:] = (
        len(set(words)) / n, len(pairs) / n, len(set(lines)) / len(lines), np.log1p(len(words)), len(data) / n / 10, len(lines) / n,
        share(48, 58), share(65, 91), share(33, 48) + share(58, 65), share(91, 97) + share(123, 127), share(128, 256), 1.0,
    )
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        g = np.clip((rows - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def pu_risk(weights: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """(risk, direction to go against) of the linear g(x) = x . weights[:-1] + weights[-1] under logistic loss.

    The risk is prior * E_P[loss(g)] + max(0, rest), rest = E_U[loss(-g)] - prior * E_P[loss(-g)]. The direction is its gradient, or minus that of rest where rest is
    below 0, as the non-negative estimator has it.
    """
    w, bias = weights[:-1].astype(positive.dtype), weights[-1]
    gp, gu = positive @ w + bias, unlabelled @ w + bias
    rest = float(np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean())
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    grad = lambda x, c: np.append(x.T @ c.astype(x.dtype), c.sum()).astype(np.float64) / len(c)
    negative = grad(unlabelled, sig(gu)) - prior * grad(positive, sig(gp))
    risk = prior * float(np.logaddexp(0, -gp).mean()) + max(0.0, rest)
    return risk, prior * grad(positive, sig(gp) - 1) + negative if rest >= 0 else -negative


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1200, rate: float = 0.01, decay: float = 1e-3) -> Model:
    """Minimise pu_risk by Adam over all rows in every step: with few negatives among the unlabelled, the second term of a small batch is mostly noise."""
    every = np.concatenate([positive, unlabelled])
    mean, scale = every.mean(0), np.maximum(every.std(0), 1e-3)
    pos, unl = (np.clip((x - mean) / scale, -8, 8).astype(np.float32) for x in (positive, unlabelled))
    d = pos.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    for step in range(1, steps + 1):
        g = pu_risk(w, pos, unl, prior)[1]
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, w[:-1].astype(np.float32), float(w[-1]), prior)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, gamma: float = 0.01, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, by best bin estimation, from trusted positives and unlabelled rows alone.

    Every second row fits a scorer; of the others, q_p(t) and q_u(t) are the shares of positives and of unlabelled rows that score t or more. Since the unlabelled hold
    the positives, q_u / q_p is never below the prior, and equals it where no negative scores t. The t chosen has the least ratio after adding the sampling errors
    of both shares at confidence 1 - delta. Fewer than two rows of a kind: 0.5.
    """
    if min(len(positive), len(unlabelled)) < 2:
        return 0.5
    scorer = fit_pu(positive[::2], unlabelled[::2], 0.5)
    of_p, of_u = (np.sort(scorer.score(x[1::2])) for x in (positive, unlabelled))
    at = np.unique(of_p)
    q_p, q_u = (1 - np.searchsorted(x, at) / len(x) for x in (of_p, of_u))
    error = np.sqrt(np.log(4 / delta) / 2 / len(of_u)) + np.sqrt(np.log(4 / delta) / 2 / len(of_p))
    best = int(np.argmin((q_u + (1 + gamma) * error) / q_p))
    return float(np.clip(q_u[best] / q_p[best], 0.02, 0.98))


def fold(column: str, folds: int):
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def _collect_features(rows: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t or "").tobytes() for t in batch.column(0).to_pylist()], pa.binary())], ["f"])

    # sorted, since the order in which tasks end or files are listed must not change the fit
    got = [np.frombuffer(f, np.float32) for f in sorted(bytes(r["f"]) for r in rows.select("text").mapInArrow(run, "f binary").collect())]
    return np.stack(got) if got else np.zeros((0, PAIRS + MEASURES), np.float32)


def sampled(ids: DataFrame, most: int, seed: int = 11, column: str = "doc_id") -> DataFrame:
    """About ``most`` rows of ids, chosen by a hash of the id (all, if there are no more than that); never over 1.5 times as many."""
    n = ids.count()
    keep = ids if n <= most else ids.where(F.pmod(F.xxhash64(F.lit(seed), column), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return keep.limit(most + most // 2)


def train(docs: DataFrame, labels: DataFrame, positives: int = 4000, unlabelled: int = 8000) -> Model | None:
    """Fit on at most ``positives`` trusted rows (quality 1) and about ``unlabelled`` web texts, both chosen by a hash of the id.

    labels: doc_id, quality; the caller leaves out held-out rows; only those with quality 1 are used. The class prior is estimated from the two samples, see class_prior.
    Null labels are left out. Without trusted positives there is no model.
    """
    docs = whole_texts(docs)
    ids = sampled(labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct(), positives)
    trusted = _collect_features(docs.join(F.broadcast(ids), "doc_id", "left_semi"))  # at most 1.5 * positives ids
    web = _collect_features(sampled(docs.select("doc_id", "text"), unlabelled, seed=12))
    if not len(trusted) or not len(web):
        return None
    return fit_pu(trusted, web, class_prior(trusted, web))


def with_quality(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (score >= threshold) of every whole text, row by row.

    Null texts score as empty ones; without a model every score is 0.5; equal texts score alike; an empty table gives no rows; columns of docs named
    score or predicted are replaced; labels, language, source and id don't enter. The model is a few kB, sent with the task.
    """
    docs = whole_texts(docs)
    prepare(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([features(t or "") for t in batch.column(at).to_pylist()]) if batch.num_rows else np.zeros((0, PAIRS + MEASURES), np.float32)
            score = model.score(rows).astype(np.float64) if model else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def score_quality(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted of every whole text; see with_quality."""
    return with_quality(docs.select("doc_id", "text"), model, threshold).drop("text")
