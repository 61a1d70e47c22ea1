"""Operator 1: nearest neighbours by a block matrix join with int8 tiles.

Queries and candidates are cut into blocks of bounded size; every candidate block meets every query block in a cell of its
own, and no pair of vectors is ever a row. In a cell, both sides are quantised to int8 with a scale for each vector, and
products of int8 tiles give the squared distance up to an error whose bound follows from the quantisation residues. Only
pairs whose least possible distance does not exceed a query's k-th best greatest possible distance survive; they are
recomputed in double precision from the original vectors, and a heap keeps each query's k best, ties to the smaller vec_id.
Cells' heaps are merged by query, k rows a query from each task at most. The result is exact: the bound decides what is
recomputed, never what is nearest. A cell is scaled by a power of two to the usual size of its vectors; pairs with a vector
far from that size have no bound, so they are all recomputed.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no part; vectors of another
length than the query's are no candidates; a row repeated as a whole counts once, other rows of the query's own vec_id are its
own; a row of a null vec_id takes no part; a query with fewer candidates than k gets all; no queries give no rows; other columns
are ignored. Components of any size down to the least double count, squares that
would leave the range of doubles included; a distance over the greatest double is infinite.
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

K = 10
CANDIDATES, QUERIES = 8192, 4096  # vectors in a block
TILE, QUERY_TILE = 2048, 256
EXACT_DIMENSIONS = 1024  # int8 products summed over so many dimensions are exact in float32
MOST_ORDER, LEAST_ORDER = 1020, -960  # binary orders of magnitude beyond which distances may be infinite, or rounded to few bits
USUAL = 400  # binary orders of magnitude from 1 within which squares and their sums are plain doubles

_RESULT = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, dims, vector) of the rows that take part; vector: the components as little-endian doubles."""
    x = F.col("embedding").cast("array<double>")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), *blobs(b.column(1))], ["vec_id", "dims", "vector"])

    return rows.mapInArrow(run, "vec_id long, dims int, vector binary").distinct()


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values (as float32, for the matrix product), the scale and the norm of the residue of each row."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None])
    return q.astype(np.float32), scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows, summed in double over runs of dimensions."""
    out = np.zeros((len(a), len(b)))
    for lo in range(0, a.shape[1], EXACT_DIMENSIONS):
        out += a[:, lo : lo + EXACT_DIMENSIONS] @ b[:, lo : lo + EXACT_DIMENSIONS].T
    return out


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, squares added in order of the components."""
    with np.errstate(over="ignore"):
        d = vectors - query
        out = np.sqrt(np.cumsum(d**2, axis=1)[:, -1])
    top = np.abs(d).max(axis=1)
    for i in np.flatnonzero((top > 0) & ~((top > 2.0**-USUAL) & (top < 2.0**USUAL))).tolist():
        up = 0 if np.isfinite(top[i]) else 2
        own = np.ldexp(vectors[i], -up) - np.ldexp(query, -up)
        e = int(np.frexp(np.abs(own).max())[1])
        with np.errstate(over="ignore", under="ignore"):
            out[i] = np.ldexp(np.sqrt(np.cumsum(np.ldexp(own, -e) ** 2)[-1]), e + up)
    return out


def sized(queries: np.ndarray, vectors: np.ndarray) -> tuple[int, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The exponent by which a cell is scaled down, and of both sides the scaled rows and which are far from the usual size."""
    orders = [np.frexp(np.abs(x).max(axis=1))[1].astype(np.int64) for x in (queries, vectors)]
    usual = int(np.median(np.concatenate(orders)))
    usual = 0 if abs(usual) < USUAL // 2 else usual
    sides = []
    for x, order in zip((queries, vectors), orders, strict=True):
        far = (np.abs(order - usual) >= USUAL) | (order >= MOST_ORDER) | (order <= LEAST_ORDER)
        own = x
        if usual or far.any():
            own = np.ldexp(np.where(far[:, None], 0.0, x), -usual)
            own[far] = 1.0  # of no consequence
        sides.append((own, far))
    return usual, *sides


def search_cell(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, distance): for each query the k nearest of the other vectors, by int8 bounds and exact recomputation."""
    usual, (q, q_far), (c, c_far) = sized(queries, vectors)
    qq, qs, qe = quantised(q)
    cq, cs, ce = quantised(c)
    qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    out = []
    for lo in range(0, len(queries), QUERY_TILE):
        rows = range(lo, min(lo + QUERY_TILE, len(queries)))
        heaps: list[list[tuple[float, int]]] = [[] for _ in rows]
        for at in range(0, len(vectors), TILE):
            s, t = slice(lo, rows.stop), slice(at, min(at + TILE, len(vectors)))
            dot = _products(qq[s], cq[t]) * np.outer(qs[s], cs[t])
            slack = np.outer(qe[s], cn[t]) + np.outer(qn[s] + qe[s], ce[t])
            square = qn[s, None] ** 2 + cn[None, t] ** 2 - 2 * dot
            slack = 2 * slack + 1e-9 * (qn[s, None] ** 2 + cn[None, t] ** 2)  # and what rounding may add
            own, far = query_ids[s, None] == ids[None, t], q_far[s, None] | c_far[None, t]
            high, low = np.where(own | far, np.inf, square + slack), np.where(far, -np.inf, square - slack)
            limit = np.partition(high, k - 1, axis=1)[:, k - 1] if high.shape[1] > k else np.full(len(high), np.inf)
            for i, heap in enumerate(heaps):
                most = limit[i]
                if len(heap) == k:
                    with np.errstate(over="ignore", under="ignore"):
                        most = min(most, np.ldexp(-heap[0][0], -usual) ** 2 * (1 + 1e-12))
                alive = np.flatnonzero((low[i] <= most) & ~own[i])
                if not len(alive):
                    continue
                exact = distances(vectors[at + alive], queries[lo + i])
                for j in np.lexsort((ids[at + alive], exact))[:k].tolist():
                    entry = (-float(exact[j]), -int(ids[at + alive[j]]))
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        out += [(int(query_ids[i]), -v, -d) for i, heap in zip(rows, heaps, strict=True) for d, v in heap]
    return out


def nearest(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest candidates (vec_id, dims, vector) of each query, its own vec_id excepted."""
    many = lambda df, size: max(1, -(-df.count() // size))
    rows, columns = many(candidates, CANDIDATES), many(queries, QUERIES)
    block = lambda n: F.pmod(F.xxhash64("vec_id", "vector"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("column", block(columns)).withColumn("row", every(rows))
    right = candidates.withColumn("row", block(rows)).withColumn("column", every(columns))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(c):
            side = lambda df: (df["vec_id"].to_numpy(np.int64), np.frombuffer(b"".join(df["vector"]), "<f8").reshape(len(df), -1))
            found = search_cell(*side(q), *side(c), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    cell = ["row", "column", "dims"]
    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(search, _RESULT)
    # Spark limits each query's rows to k in every task before it shuffles them
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all rows to every row whose vec_id is divisible by 100."""
    vectors = written(usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "vectors")
    return nearest(vectors.where(F.col("vec_id") % 100 == 0), vectors)


OP1_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda a: a IS NULL OR NOT isfinite(a))) = 0
    AND len(list_filter(embedding, lambda a: a <> 0)) > 0
), d AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(list_zip(q.x, c.x), lambda z: (z[2] - z[1]) * (z[2] - z[1])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS k FROM d)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""
