"""Operator 7: toxicity by a bag of subwords.

A lower-cased word with its boundaries is split into n-grams of MIN to MAX bytes, each hashed to one of BUCKETS embeddings.
A text is the average of its subwords' embeddings, which a linear softmax turns into classes; both are trained jointly by
mini-batches with per-coordinate step sizes in numpy. A misspelling or an ending that training never saw shares most of its
n-grams, and so its vectors, with words that it did see.

Only subwords whose frequency tells the classes apart (by SETTING.evidence standard errors) are in the bag: on few labelled rows
all others would only learn them by heart. A subword counts by the logarithm of its frequency, and a text has besides its own
subwords SETTING.prior ones of an average clean text, so that short texts need stronger signs. Every training row's margin comes
from a fit that did not see it, evidence included, and these margins set the score's sigmoid, at the labels' shares of the classes.
Few training rows are passed more often, MOST_PASSES times at most, so that fits of all sizes take about as many steps.

Defined results: an empty or null text, or one without words or telling subwords, scores as an average clean text; very long
texts are split in slices, whole; every row gets its own score, repeated ones too; with no labels, or labels of one class, every
score is 0.0; an empty table gives no rows; other columns stay, but one of the score's name is replaced.
"""

from __future__ import annotations

import pickle
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scansmith.llm.common import _IS_WORD, _LOWER, SLICE, mix
from scansmith.llm.labelled import fold, platt, scored, sigmoid, trained

BUCKETS = 1 << 18
MIN, MAX = 3, 6
DIMENSIONS, BATCH, STEP = 8, 32, 0.3
PASSES, MOST_PASSES, PASSED_ROWS = 8, 60, 48_000  # few rows are passed more often, for about as many steps
SPLITS = 4
TRAINING_ROWS = 8000
SEEN = 3  # training rows that hold a learned subword
LEAST = 200  # texts of fewer subwords count as so long
THRESHOLD = 0.5


class Setting(NamedTuple):
    """What `choice` decides, from training rows alone."""

    evidence: float  # standard errors between the classes' means of a learned subword
    prior: float  # subwords of an average clean text that every text has besides its own
    rate: int  # a subword's frequency is counted in so many subwords


CHOICES = [Setting(e, p, r) for e in (2.0, 3.0, 4.0, 5.0) for p in (5.0, 20.0, 50.0) for r in (300, 1000)]
SETTING = Setting(4.0, 50.0, 1000)  # the least loss of `choice` on the training folds of the given tables


def subwords(text: str) -> np.ndarray:
    """The bucket of every n-gram of every word of a text, in order of length, then place."""
    data = np.frombuffer(text.encode(), np.uint8)
    found, at = [], 0
    while at < len(data):
        to = min(at + SLICE, len(data))
        while to < len(data) and _IS_WORD[data[to]] and _IS_WORD[data[to - 1]]:
            to += 1
        part = np.concatenate([[np.uint8(32)], data[at:to], [np.uint8(32)]])
        inside = _IS_WORD[part]
        values = np.where(inside, _LOWER[part], np.uint64(0))
        gaps = np.concatenate([[0], np.cumsum(~inside)])
        h = values
        for n in range(2, MAX + 1):
            if len(part) < n:
                break
            h = h[: len(part) - n + 1] * np.uint64(0x100000001B3) + values[n - 1 :]
            if n >= MIN:  # no gap within, one at either end at most
                good = gaps[n - 1 : len(part)] - gaps[1 : len(part) - n + 2] == 0
                found.append(mix(h[good] + np.uint64(n << 40)) >> np.uint64(46))
        at = to
    return np.concatenate(found).astype(np.uint32) if found else np.zeros(0, np.uint32)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text's subwords and how often each occurs."""
    return np.unique(subwords(text), return_counts=True)


def _damped(counts: np.ndarray, rate: int) -> np.ndarray:
    """What subwords weigh that occur so often in a text: the logarithm of their frequency, so that no single word makes up a text."""
    return np.log1p(counts * (rate / max(int(counts.sum()), LEAST))).astype(np.float32)


def evidence(labels: np.ndarray, rows: list[np.ndarray], values: list[np.ndarray]) -> np.ndarray:
    """Standard errors by which each bucket's mean value differs between the classes; 0 for those that too few rows hold."""
    sums, squares, seen = np.zeros((2, BUCKETS)), np.zeros(BUCKETS), np.zeros(BUCKETS, np.int64)
    for y, row, value in zip(labels, rows, values, strict=True):
        sums[y][row] += value
        squares[row] += value**2
        seen[row] += 1
    n = np.bincount(labels, minlength=2)
    variance = squares / n.sum() - (sums.sum(axis=0) / n.sum()) ** 2
    out = np.abs(sums[1] / n[1] - sums[0] / n[0]) / np.sqrt(np.maximum(variance, 1e-12) * (1 / n).sum())
    return np.where(seen >= SEEN, out, 0)


def _told(place: np.ndarray, row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text's subwords that have one, and their values."""
    own = place[row]
    kept = own >= 0
    return own[kept], value[kept]


def _fitted(labels: np.ndarray, rows: list[np.ndarray], values: list[np.ndarray], seed: int, setting: Setting) -> tuple[np.ndarray, float]:
    """The value of each subword, NaN without an opinion, and the margin of an average clean text.

    For two classes the softmax needs the difference of the class weights only, so a subword's value is its embedding times
    that difference; the embeddings themselves stay behind.
    """
    rng = np.random.default_rng(seed)
    known = np.flatnonzero(evidence(labels, rows, values) >= setting.evidence)
    place = np.full(BUCKETS, -1, np.int64)
    place[known] = np.arange(len(known))
    rows, values = zip(*(_told(place, r, v) for r, v in zip(rows, values, strict=True)), strict=True)
    share = [(v / (v.sum() + setting.prior)).astype(np.float32) for v in values]
    n = max(1, len(known))
    embeddings = (rng.random((n, DIMENSIONS), np.float32) - np.float32(0.5)) / DIMENSIONS
    softmax, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    squares, squares_s, squares_b = np.full((n, DIMENSIONS), 1e-8, np.float32), np.full((DIMENSIONS, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    weight = np.where(labels > 0, (labels == 0).sum() / max(1, (labels > 0).sum()), 1.0) ** 0.5
    passes = min(max(PASSES, PASSED_ROWS // len(labels)), MOST_PASSES)
    for p in range(passes):
        order = rng.permutation(len(labels))
        rate = STEP * (1 - p / passes)
        for lo in range(0, len(order), BATCH):
            batch = order[lo : lo + BATCH]
            sizes = np.array([len(rows[i]) for i in batch])
            batch, sizes = batch[sizes > 0], sizes[sizes > 0]
            if not len(batch):
                continue
            index, value = np.concatenate([rows[i] for i in batch]), np.concatenate([share[i] for i in batch])
            starts = np.cumsum(sizes) - sizes
            hidden = np.add.reduceat(embeddings[index] * value[:, None], starts, axis=0)
            logits = hidden @ softmax + bias
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (e / e.sum(axis=1, keepdims=True)).astype(np.float32)
            error[np.arange(len(batch)), labels[batch]] -= 1
            error *= (weight[batch] / len(batch))[:, None].astype(np.float32)
            back = error @ softmax.T
            grad_s, grad_b = hidden.T @ error, error.sum(axis=0)
            uniq, at = np.unique(index, return_inverse=True)
            per = np.repeat(back, sizes, axis=0) * value[:, None]
            grad = np.stack([np.bincount(at, per[:, d], len(uniq)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
            squares[uniq] += grad**2
            embeddings[uniq] -= rate * grad / np.sqrt(squares[uniq])
            squares_s += grad_s**2
            softmax -= rate * 0.3 * grad_s / np.sqrt(squares_s)
            squares_b += grad_b**2
            bias -= rate * 0.3 * grad_b / np.sqrt(squares_b)
    told = embeddings @ (softmax[:, 1] - softmax[:, 0])
    out = np.full(BUCKETS, np.nan, np.float32)
    out[known] = told[: len(known)]
    return out, float(np.mean([told[r] @ s for r, s, y in zip(rows, share, labels, strict=True) if y == 0]))


def _margin(known: np.ndarray, clean: float, prior: float, row: np.ndarray, value: np.ndarray) -> float:
    told = known[row]
    kept = ~np.isnan(told)
    value = value[kept]
    return float((told[kept].astype(np.float64) @ value + clean * prior) / (value.sum() + prior))


def _crossed(labels: np.ndarray, rows: list[np.ndarray], values: list[np.ndarray], setting: Setting) -> np.ndarray:
    """Every row's margin from a fit that did not see it; NaN where the others are of one class."""
    rng, split, margins = np.random.default_rng(7), np.empty(len(labels), np.int64), np.full(len(labels), np.nan)
    for y in (0, 1):  # both classes in each split
        own = rng.permutation(np.flatnonzero(labels == y))
        split[own] = np.arange(len(own)) % SPLITS
    for k in range(SPLITS):
        train, late = np.flatnonzero(split != k), np.flatnonzero(split == k)
        if len(set(labels[train].tolist())) == 2:
            known, clean = _fitted(labels[train], [rows[i] for i in train], [values[i] for i in train], k, setting)
            margins[late] = [_margin(known, clean, setting.prior, rows[i], values[i]) for i in late]
    return margins


def choice(labels: np.ndarray, rows: list[np.ndarray], counts: list[np.ndarray], totals: tuple[int, int], settings: list[Setting] = CHOICES) -> list[tuple[float, Setting]]:
    """(mean logarithmic loss, setting), least first: of training rows' scores by fits that did not see them.

    SETTING was chosen by this, on training rows; the held-out fold has no part in it.
    """
    out, share = [], np.where(labels > 0, totals[1] / max(1, labels.sum()), totals[0] / max(1, (labels == 0).sum()))
    for setting in settings:
        margins = _crossed(labels, rows, [_damped(c, setting.rate) for c in counts], setting)
        a, b = platt(margins, labels, totals)
        score = np.clip(sigmoid(a * margins + b), 1e-6, 1 - 1e-6)
        out.append((float(np.average(-np.log(np.where(labels > 0, score, 1 - score)), weights=share)), setting))
    return sorted(out)


def fit(labels: np.ndarray, rows: list[np.ndarray], counts: list[np.ndarray], totals: tuple[int, int] | None = None, setting: Setting = SETTING) -> bytes:
    """The pickled (value of each subword, margin of a clean text, a, b, setting); None if there is one class."""
    if len(set(labels.tolist())) < 2:
        return pickle.dumps(None)
    values = [_damped(c, setting.rate) for c in counts]
    margins = _crossed(labels, rows, values, setting)
    known, clean = _fitted(labels, rows, values, SPLITS, setting)
    seen = ~np.isnan(margins)
    if len(set(labels[seen].tolist())) < 2:  # a single row of a class
        margins, seen = np.array([_margin(known, clean, setting.prior, r, v) for r, v in zip(rows, values, strict=True)]), np.ones(len(labels), bool)
    return pickle.dumps((known, clean, *platt(margins[seen], labels[seen], totals), tuple(setting)))


def scorer(model: bytes):  # noqa: ANN201
    """A function from texts to scores."""
    known = pickle.loads(model)
    if known is None:
        return lambda texts: np.zeros(len(texts))
    values, clean, a, b, setting = known
    _, prior, rate = setting

    def score(texts: list[str]) -> np.ndarray:
        found = [counted(text) for text in texts]
        return sigmoid(a * np.array([_margin(values, clean, prior, own, _damped(n, rate)) for own, n in found]) + b)

    return score


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> bytes:
    """The model, from at most rows labelled documents outside fold 0."""
    return trained(docs, labels, "toxic", rows, counted, fit)


def score_toxicity(docs: DataFrame, model: bytes, into: str = "score") -> DataFrame:
    """docs (text, ...) with a score: 0 to 1, higher for more toxic texts."""
    return scored(docs, scorer(model), into)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_toxicity(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
