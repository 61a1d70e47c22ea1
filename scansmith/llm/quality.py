"""Operator 5: a quality classifier of naive Bayes support vectors.

A text's features are indicators of n-grams in two streams: n-grams of its characters (1 to 4 bytes), and n-grams (1 to 4)
of its words' shapes - case, length class, marks around the letters, and whether the word repeats the one before. The
indicators are hashed into BUCKETS and scaled by the classes' log-count ratio; a linear hinge-loss model is fitted to them by
dual coordinate descent. Margins of rows that the fit did not see give the sigmoid that turns a margin into a score.

Defined results: an empty or null text has no n-grams and scores what the intercept gives; every row gets its own score;
with no labels, or labels of one class, every score is 1.0, so nothing is rejected; very long texts are taken in pieces that
overlap, whole; repeated rows score alike; an empty table gives no rows; other columns stay, but one of the score's name is replaced.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scansmith.llm.common import mix
from scansmith.llm.labelled import fold, platt, scored, sigmoid, trained

BUCKETS = 1 << 18
TRAINING_ROWS = 6000
THRESHOLD = 0.3
SMOOTHING, COST, PASSES = 1.0, 1.0, 12


def _shapes(text: str) -> np.ndarray:
    """A number for the shape of each word."""
    before, out = None, []
    for w in text.split():
        kind = 0 if w.islower() else 1 if w.istitle() else 2 if w.isupper() else 3 if w.isalpha() else 4 if w.isdigit() else 5
        last = w[-1]
        tail = 0 if last.isalnum() else 1 + (ord(last) & 63)
        head = 0 if w[0].isalnum() else 1
        out.append(((kind * 65 + tail) * 2 + head) * 2 + (w == before))
        before = w
    return np.array(out, np.uint64)


def ngrams(text: str) -> np.ndarray:
    """The buckets of a text's n-grams, each once, ascending."""
    seen = np.zeros(BUCKETS, bool)
    for stream, values in ((1, np.frombuffer(text.encode(), np.uint8).astype(np.uint64)), (2, _shapes(text))):
        for lo in range(0, len(values), 1 << 20):  # long texts in pieces that overlap
            part = values[lo : lo + (1 << 20) + 3]
            h = np.zeros(len(part), np.uint64)
            for n in range(1, 5):
                if len(part) < n:
                    break
                h = h[: len(part) - n + 1] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(1)
                seen[(mix(h + np.uint64(stream << 40) + np.uint64(n << 32)) >> np.uint64(46)).astype(np.int64)] = True
    return np.flatnonzero(seen).astype(np.uint32)


def fit(labels: np.ndarray, rows: list[np.ndarray], _: list[np.ndarray], totals: tuple[int, int] | None = None) -> bytes:
    """The pickled (weights, intercept, a, b) of labels 0 or 1 and rows of buckets; no weights if there is one class."""
    if len(set(labels.tolist())) < 2:
        return pickle.dumps(None)
    rng = np.random.default_rng(5)
    late = rng.random(len(rows)) < 0.2
    if len(set(labels[~late].tolist())) < 2 or len(set(labels[late].tolist())) < 2:
        late[:] = False
    train = np.flatnonzero(~late)
    counts = [np.bincount(np.concatenate([rows[i] for i in train if labels[i] == y]), minlength=BUCKETS) + SMOOTHING for y in (1, 0)]
    each = [(labels[train] == y).sum() + SMOOTHING for y in (1, 0)]
    ratio = np.log(counts[0] / each[0]) - np.log(counts[1] / each[1])
    ratio[(counts[0] + counts[1]) <= 2 * SMOOTHING + 1] = 0  # seen in one training row or none
    scale = [1 / max(1e-9, np.linalg.norm(ratio[r])) for r in rows]
    weights, intercept, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    sign = np.where(labels > 0, 1.0, -1.0)
    for _pass in range(PASSES):
        changed = 0.0
        for i in rng.permutation(train):
            x = ratio[rows[i]] * scale[i]
            margin = sign[i] * (weights[rows[i]] @ x + intercept)
            new = min(max(alpha[i] - (margin - 1) / (x @ x + 1), 0.0), COST)
            if step := (new - alpha[i]) * sign[i]:
                weights[rows[i]] += step * x
                intercept += step
                alpha[i] = new
                changed = max(changed, abs(step))
        if changed < 1e-3:
            break
    weights = weights * ratio
    norm = np.abs(ratio)
    seen = np.flatnonzero(late) if late.any() else train
    margins = np.array([weights[rows[i]].sum() * scale[i] + intercept for i in seen])
    return pickle.dumps((weights.astype(np.float32), norm.astype(np.float32), intercept, *platt(margins, labels[seen], totals)))


def scorer(model: bytes):  # noqa: ANN201
    """A function from texts to scores."""
    known = pickle.loads(model)
    if known is None:
        return lambda texts: np.ones(len(texts))
    weights, norm, intercept, a, b = known

    def score(texts: list[str]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            own = ngrams(text)
            out[i] = weights[own].sum(dtype=np.float64) / max(1e-9, np.sqrt((norm[own].astype(np.float64) ** 2).sum())) + intercept
        return sigmoid(a * out + b)

    return score


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> bytes:
    """The model, from at most rows labelled documents outside fold 0."""
    return trained(docs, labels, "quality", rows, lambda t: (ngrams(t), np.zeros(0, np.uint32)), fit)


def score_quality(docs: DataFrame, model: bytes, into: str = "score") -> DataFrame:
    """docs (text, ...) with a score: 0 to 1, higher for better texts."""
    return scored(docs, scorer(model), into)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_quality(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
