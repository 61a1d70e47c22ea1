"""What both classifiers share: the bounded sample of labelled rows, one training task, and scoring of every row.

The fold that labels may be learned from is that where crc32(doc_id as text) mod 5 is not 0. Of it, at most `rows` rows are
drawn, half of them for each class, those of least hash of the doc_id, and of these, again by hash, as many as have
FEATURE_BYTES of features, half for each class: documented bounds, so the numbers may be broadcast, and one task may hold
their features. Everything else covers every row: the classes' shares, to which scores are fitted whatever the sample's are,
and scoring above all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scansmith.llm.common import discard, map_texts, small_batches, written

FOLDS = 5
FEATURE_BYTES = 256 << 20  # of the rows that one task learns from


def fold(doc_id: F.Column) -> F.Column:
    """crc32 of the number as text, modulo FOLDS; fold 0 is held out. A null number is in no fold that is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, label) outside fold 0; of several labels of a doc_id the greatest counts."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(label).cast("int") > 0).cast("int").alias("label")).dropna()
    return known.where(fold(F.col("doc_id")) != 0).groupBy("doc_id").agg(F.max("label").alias("label"))


def training_rows(docs: DataFrame, known: DataFrame, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most rows documents with known labels (doc_id, label). Of several texts of a doc_id the greatest counts."""
    first = lambda of: known.where(of).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
    drawn = first("label = 1").unionByName(first("label = 0"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("label").alias("label"))


Fit = Callable[[np.ndarray, list[np.ndarray], list[np.ndarray], tuple[int, int]], bytes]


def fit_in_one_task(features: DataFrame, fit: Fit, totals: tuple[int, int], most_bytes: int = FEATURE_BYTES) -> bytes:
    """The model that fit(labels, indices, counts, totals) makes, in an executor, of features (doc_id, label, indices, counts).

    totals: labelled rows of class 0 and of class 1. Beyond most_bytes the rows of greatest hash stay out.
    """
    sizes = features.select("doc_id", "label", (F.octet_length("indices") + F.octet_length("counts")).cast("long").alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id")
    left, taken = [most_bytes // 2] * 2, []
    for doc_id, label, size in sizes.collect():  # as many as were drawn
        left[label] -= size
        if left[label] >= 0:
            taken.append((doc_id,))
    if min(left) < 0:
        features = features.join(F.broadcast(features.sparkSession.createDataFrame(taken, "doc_id long")), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [x for b in batches for x in zip(*(b.column(k).to_pylist() for k in ("doc_id", "label", "indices", "counts")), strict=True)]
        rows.sort(key=lambda x: x[0])
        own = [[np.frombuffer(x[k], np.uint32) for x in rows] for k in (2, 3)]
        yield pa.record_batch([pa.array([fit(np.array([x[1] for x in rows]), *own, totals)])], ["model"])

    with small_batches(features.sparkSession):
        return features.repartition(1).mapInArrow(run, "model binary").first()["model"]


def trained(docs: DataFrame, labels: DataFrame, label: str, rows: int, extract: Callable[[str], tuple[np.ndarray, np.ndarray]], fit: Fit) -> bytes:
    """The model of at most rows labelled documents; extract gives a text's features and their counts."""

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [extract(t) for t in b.column("text").to_pylist()]
        blobs = [pa.array([x[k].astype(np.uint32).tobytes() for x in found], pa.binary()) for k in (0, 1)]
        return pa.record_batch([b.column("doc_id"), b.column("label"), *blobs], ["doc_id", "label", "indices", "counts"])

    known = known_labels(labels, label)
    ones, n = known.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    found = written(map_texts(training_rows(docs, known, rows), work, "doc_id long, label int, indices binary, counts binary"), "features")
    model = fit_in_one_task(found, fit, (n - ones, ones))
    discard(found)
    return model


def scored(docs: DataFrame, score: Callable[[list[str]], np.ndarray], into: str = "score") -> DataFrame:
    """docs with a double column of its whole texts' scores (null: empty); others stay, but one of that name is replaced."""
    docs = docs.drop(into)
    names = docs.columns
    at = names.index("text")

    def work(b: pa.RecordBatch) -> pa.RecordBatch:
        out = score([t or "" for t in b.column(at).to_pylist()])
        return pa.record_batch([*b.columns, pa.array(out, pa.float64())], [*names, into])

    return map_texts(docs, work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{into}` double")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(margins: np.ndarray, labels: np.ndarray, totals: tuple[int, int] | None = None, rounds: int = 200) -> tuple[float, float]:
    """(a, b) so that sigmoid(a * margin + b) fits the labels, by Newton steps with Platt's smoothed targets.

    totals: rows of class 0 and 1 that the margins' rows were drawn from; a class weighs as much as its share of them.
    """
    ones = labels.sum()
    goal = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    each = np.ones(len(labels))
    if totals and 0 < ones < len(labels):
        each = np.where(labels > 0, totals[1] / ones, totals[0] / (len(labels) - ones)) * len(labels) / sum(totals)
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margins + b)
        g = np.array([(each * (p - goal) * margins).sum() + 1e-3 * a, (each * (p - goal)).sum()])
        w = each * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margins**2).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)
