"""Operator 12: exact top-k inner products, a block of vectors at a time.

Components are turned into integers. Every block of queries meets every block of candidates in a cell of bounded size; no pair
is ever a row. In a cell, candidates are put in an order in which neighbours are alike (halved again and again across the
component of widest spread) and cut into ranges of BLOCK. A range knows its greatest and least value of each component, so the
sum of a query's products with them (the greatest for its positive components, the least for its negative ones) bounds every
inner product within. For each query the ranges are taken in order of this bound and scored through their forward index, the
vectors themselves, until a bound is below the k-th best score so far; a bound that equals it is still scored, as ties go to
the smaller vec_id. Everything is exact: products of usual vectors stay below 2**53, where doubles count as integers; vectors
of larger components (`wide`) have no bound and are scored in Python's integers.

Defined results: vectors that are null, empty, or hold a null or non-finite component (or one whose multiple is not finite)
take no part; zero vectors do; vectors of another length than the query's are no candidates; a row repeated as a whole counts
once, other rows of the query's own vec_id are its own; a null vec_id takes no part; a query with fewer candidates than k gets
all; an empty table gives no rows; other columns are ignored; scores beyond long are returned as the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scansmith.llm.common import blobs, written

K, SCALE = 5, 256
CANDIDATES, QUERIES = 8192, 8192  # vectors in a block of a cell, at most
CELL_BYTES = 64 << 20  # of a block's vectors, at most
BLOCK = 128  # candidates in a range
EXACT = 1 << 53

_RESULT = "query_id long, vec_id long, score decimal(38,0)"
_DECIMAL = 10**38 - 1
_LONG = (1 << 63) - 1


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, dims, vector) of the rows that take part; vector: floor(scale * x) of the components, as little-endian doubles."""
    x = F.transform(F.col("embedding"), lambda v: F.lit(float(scale)) * v.cast("double"))
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & (F.size(x) > 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, own = blobs(b.column(1), np.floor)
            yield pa.record_batch([b.column(0), dims, own], ["vec_id", "dims", "vector"])

    return rows.mapInArrow(run, "vec_id long, dims int, vector binary").distinct()


def _similar_order(x: np.ndarray, least: int) -> np.ndarray:
    """An order of the rows in which neighbours are alike."""
    parts, out = [np.arange(len(x))], []
    while parts:
        own = parts.pop()
        if len(own) <= least:
            out.append(own)
            continue
        column = x[own, np.argmax(np.ptp(x[own], axis=0))]
        half = -(-len(own) // (2 * least)) * least  # whole ranges on the left
        order = np.argpartition(column, half) if half < len(own) else np.arange(len(own))
        parts += [own[order[half:]], own[order[:half]]] if half < len(own) else []
        out += [] if half < len(own) else [own]
    return np.concatenate(out)


def _keep(heap: list[tuple[int, int]], k: int, entry: tuple[int, int]) -> None:
    if len(heap) < k:
        heapq.heappush(heap, entry)
    elif entry > heap[0]:
        heapq.heapreplace(heap, entry)


def search_cell(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, block: int = BLOCK) -> tuple[list[tuple[int, int, int]], int]:
    """((query_id, vec_id, inner product) of the k best of each query, number of ranges that were scored)."""
    limit = np.floor(np.sqrt(EXACT / queries.shape[1]))
    wide_q, wide_c = (np.abs(x).max(axis=1) >= limit for x in (queries, vectors))
    usual = np.flatnonzero(~wide_c)
    usual = usual[_similar_order(vectors[usual], block)] if len(usual) else usual
    own_ids, own = ids[usual], vectors[usual]
    starts = np.arange(0, len(own), block)
    q = np.where(wide_q[:, None], 0.0, queries)
    bounds = np.zeros((len(q), 0))
    if len(own):
        bounds = np.maximum(q, 0) @ np.maximum.reduceat(own, starts, axis=0).T + np.minimum(q, 0) @ np.minimum.reduceat(own, starts, axis=0).T
    whole = [[int(v) for v in vectors[j]] for j in np.flatnonzero(wide_c)]
    whole_ids = ids[wide_c].tolist()
    everything = [[int(v) for v in row] for row in vectors] if wide_q.any() else []
    out, scored = [], 0
    for i, query_id in enumerate(query_ids.tolist()):
        heap: list[tuple[int, int]] = []
        if wide_q[i]:
            x = [int(v) for v in queries[i]]
            for vec_id, row in zip(ids.tolist(), everything, strict=True):
                if vec_id != query_id:
                    _keep(heap, k, (sum(a * b for a, b in zip(x, row, strict=True)), -vec_id))
        else:
            if whole:
                x = [int(v) for v in queries[i]]
                for vec_id, row in zip(whole_ids, whole, strict=True):
                    if vec_id != query_id:
                        _keep(heap, k, (sum(a * b for a, b in zip(x, row, strict=True)), -vec_id))
            for j in np.argsort(-bounds[i], kind="stable").tolist():
                if len(heap) == k and bounds[i, j] < heap[0][0]:
                    break
                scored += 1
                lo = j * block
                score, at = own[lo : lo + block] @ q[i], own_ids[lo : lo + block]
                alive = np.flatnonzero((at != query_id) & (score >= (heap[0][0] if len(heap) == k else -np.inf)))
                if len(alive) > k:  # only the k best of a range can stay, and those that tie with the last of them
                    alive = alive[np.lexsort((at[alive], -score[alive]))[:k]]
                for n in alive.tolist():
                    _keep(heap, k, (int(score[n]), -int(at[n])))
        out += [(query_id, -v, s) for s, v in heap]
    return out, scored


def best(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates (vec_id, dims, vector) of greatest inner product with each query, its own vec_id excepted."""
    n, most = candidates.agg(F.count("*"), F.coalesce(F.max("dims"), F.lit(1))).first()
    room = max(1, CELL_BYTES // (8 * most))
    rows, columns = (max(1, -(-count // min(room, size))) for count, size in ((n, CANDIDATES), (queries.count(), QUERIES)))
    block = lambda m: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = queries.withColumn("column", block(columns)).withColumn("row", every(rows))
    right = candidates.withColumn("row", block(rows)).withColumn("column", every(columns))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        if len(q) and len(c):
            side = lambda df: (df["vec_id"].to_numpy(np.int64), np.frombuffer(b"".join(df["vector"]), "<f8").reshape(len(df), -1))
            found, _ = search_cell(*side(q), *side(c), k)
        clipped = [(a, b, max(-_DECIMAL, min(s, _DECIMAL))) for a, b, s in found]
        out = pd.DataFrame(clipped, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64"})
        out["score"] = pd.Series(pa.array(out["score"].tolist(), pa.decimal128(38, 0)).to_pylist(), dtype=object)
        return out

    cell = ["row", "column", "dims"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(search, _RESULT)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    score = F.greatest(F.lit(-_LONG - 1), F.least(F.lit(_LONG), F.col("score"))).cast("long")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", score.alias("score"))


def op12_inner_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of greatest integer inner product with every row whose vec_id is divisible by 50."""
    vectors = written(integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "integers")
    return best(vectors.where(F.col("vec_id") % 50 == 0), vectors)


OP12_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda a: CAST(floor(256 * a) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5
"""
