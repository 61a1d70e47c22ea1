"""Operator 11: ranked lexical search by an exact sparse ball tree.

A document is the sparse vector of its impacts, (10**9 * tf) div (1000 * tf + 8 * m) a term, an item the vector of its terms'
weights; a score is their inner product. Only terms of items matter to it, so one reading of the documents counts those (the
items' terms, a block of bounded size, go to every task) along with each document's length. The document frequencies, N and L
come from that table, and with them the vectors.

Each task takes its vectors in chunks and grows a ball tree over each: vectors are halved again and again along the line
between two far ones. A node has a centroid and a radius, the radius apart for each of GROUPS runs of terms, since an item
touches few of them; by Cauchy and Schwarz no document below it scores more than (item . centroid) + the sum over runs of
(norm of the item there) * radius. A parent's radius holds its children's balls. Radii and bounds are rounded up by more than
doubles may err. For each item, nodes are taken best-first; a node whose bound is below the item's k-th best score so far ends
the search, and a leaf is scored exactly, in 64-bit integers. Heaps last from chunk to chunk of a task; each task gives k rows
an item at most, which Spark ranks. Results are exact: bounds decide what is scored, never what is best.

Both sides of the product share the weights (the square root of each), which keeps radii small for what items weigh little.

Items are dealt into blocks of about BLOCK_TERMS terms; beyond one block, documents are read once a block.

Defined results: null text has no terms, and a document without terms takes no part; each row is a document, repeated ones
too; a null doc_id comes last of equal scores; texts of one item_id are one item; a null item_id is none; an item none of whose
terms occurs has no rows; empty tables give no rows; very long texts are counted in slices, whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections import Counter
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from scansmith.llm.common import _IS_WORD, SLICE, texts_of, written

K = 10
BLOCK_TERMS = 1 << 18  # (item, term) pairs in a block of items
LONGEST = 32  # bytes; a longer term is known by its SHA-256
CHUNK_ROWS, CHUNK_CELLS = 1024, 1 << 23  # documents in a tree, and numbers in their matrix
LEAF = 32
GROUPS = 512
SKETCH = 64  # numbers that stand for a vector when trees are split
SLACK = 1e-9  # relative; sums of doubles err less
_NO_ID = 1 << 63  # a null doc_id, behind all others

_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if _IS_WORD[b] else 32 for b in range(256))


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, lower-cased, in lists of about SLICE bytes."""
    at = 0
    while at < len(text):
        to = min(at + SLICE, len(text))
        while to < len(text) and _IS_WORD[text[to]] and _IS_WORD[text[to - 1]]:
            to += 1
        yield text[at:to].translate(_PLAIN).split()
        at = to


def key_of(term: bytes) -> bytes:
    return term if len(term) <= LONGEST else b"\0" + hashlib.sha256(term).digest()


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, offsets = texts_of(column)
    whole, ends = data.tobytes(), offsets.tolist()
    return (whole[a:b] for a, b in zip(ends, ends[1:], strict=False))


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of items (item_id, text), long ones as digests."""
    rows = items.where("item_id IS NOT NULL").select("item_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(_texts(b.column(1))):
                own = sorted({key_of(t) for piece in pieces(text) for t in piece})
                if own:
                    yield pa.record_batch([pa.array([b.column(0)[i].as_py()] * len(own), b.column(0).type), pa.array(own, pa.binary())], ["item_id", "term"])

    return rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, term binary").distinct()


def counted(text: bytes, known: Mapping[bytes, int], long: bool) -> tuple[int, dict[int, int]]:
    """(number of terms, occurrences of the known ones by number); long: whether a known one is a digest."""
    n, out = 0, Counter()
    for words in pieces(text):
        n += len(words)
        here = Counter(words)
        for t in here.keys() & known.keys():
            out[known[t]] += here[t]
        if long:
            for t, times in here.items():
                if len(t) > LONGEST and (k := known.get(key_of(t))) is not None:
                    out[k] += times
    return n, out


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tf) of the documents (doc_id, text) that have terms at all: numbers of the known ones, ascending, and their occurrences."""
    known = docs.sparkSession.sparkContext.broadcast({t: k for k, t in enumerate(terms)})
    long = any(t.startswith(b"\0") for t in terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, numbers, found, times, ends = [], [], [], [], [0]
            for i, text in enumerate(_texts(b.column(1))):
                n, tf = counted(text, known.value, long)
                if n:
                    kept.append(i)
                    numbers.append(n)
                    for k in sorted(tf):
                        found.append(k)
                        times.append(tf[k])
                    ends.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((found, pa.int32()), (times, pa.int64()))]
            yield pa.record_batch([b.column(0).take(pa.array(kept, pa.int32())), pa.array(numbers, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tf array<long>")


class Tree:
    """A ball tree over rows of a matrix of non-negative numbers; order: of the rows, a node being a range of it."""

    def __init__(self, rows: np.ndarray, groups: np.ndarray, leaf: int = LEAF) -> None:
        """groups: where the runs of columns begin."""
        padded = np.pad(rows, ((0, 0), (0, -rows.shape[1] % SKETCH)))
        sketch = padded.reshape(len(rows), -1, SKETCH).sum(axis=1)
        self.order = np.arange(len(rows))
        self.spans: list[tuple[int, int]] = [(0, len(rows))]
        self.children: list[tuple[int, int] | None] = []
        for lo, hi in self.spans:  # grows as it is read
            if hi - lo <= leaf:
                self.children.append(None)
                continue
            own = sketch[self.order[lo:hi]]
            far = own[np.argmax(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
            along = own @ (own[np.argmax(((own - far) ** 2).sum(axis=1))] - far)
            self.order[lo:hi] = self.order[lo:hi][np.argsort(along, kind="stable")]
            half = (lo + hi) // 2
            self.children.append((len(self.spans), len(self.spans) + 1))
            self.spans += [(lo, half), (half, hi)]
        self.centroids, self.radii = np.zeros((len(self.spans), rows.shape[1])), np.zeros((len(self.spans), len(groups)))
        length = lambda x: np.sqrt(np.add.reduceat(x * x, groups, axis=-1)) * (1 + SLACK)
        for k in range(len(self.spans) - 1, -1, -1):
            lo, hi = self.spans[k]
            if (pair := self.children[k]) is None:
                own = rows[self.order[lo:hi]]
                self.centroids[k] = own.mean(axis=0)
                self.radii[k] = length(own - self.centroids[k]).max(axis=0)
            else:
                share = [self.spans[c][1] - self.spans[c][0] for c in pair]
                self.centroids[k] = np.average(self.centroids[list(pair)], axis=0, weights=share)
                self.radii[k] = max_of([length(self.centroids[c] - self.centroids[k]) + self.radii[c] for c in pair]) * (1 + SLACK)


def max_of(rows: list[np.ndarray]) -> np.ndarray:
    return reduce(np.maximum, rows)


class Items:
    """Items of a block as vectors over its terms: numbers of terms ascending, and their integer weights."""

    def __init__(self, ids: list, terms: list[np.ndarray], weights: np.ndarray) -> None:
        self.ids, self.terms, self.weights = ids, terms, weights
        self.roots = np.sqrt(weights.astype(np.float64))
        width = max(1, len(weights))
        self.groups = np.arange(0, width, -(-width // GROUPS))

    def sides(self, used: np.ndarray, groups: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Of items lo to hi, the vectors over the used terms, and their norms in each run of them."""
        x = np.zeros((hi - lo, len(self.weights)))
        for i in range(lo, hi):
            x[i - lo, self.terms[i]] = self.roots[self.terms[i]]
        x = x[:, used]
        return x, np.sqrt(np.add.reduceat(x * x, groups, axis=1)) * (1 + SLACK)


def search_chunk(items: Items, heaps: list[list[tuple[int, int]]], doc_ids: list[int], terms: np.ndarray, rows: np.ndarray, impacts: np.ndarray, k: int, leaf: int = LEAF) -> int:
    """Put what a chunk's documents score into the items' heaps of (score, -doc_id). terms, rows, impacts: the vectors' entries. Gives the leaves scored."""
    used, column = np.unique(terms, return_inverse=True)
    if not len(used):
        return 0
    matrix = np.zeros((len(doc_ids), len(used)), np.int64)
    matrix[rows, column] = impacts
    groups = np.arange(0, len(used), -(-len(used) // GROUPS))
    tree = Tree(matrix * items.roots[used], groups, leaf)
    matrix = np.ascontiguousarray(matrix[tree.order].T)
    ordered = [doc_ids[i] for i in tree.order.tolist()]
    place = np.full(len(items.weights), -1)
    place[used] = np.arange(len(used))
    visited, step = 0, max(1, CHUNK_CELLS // len(items.weights))
    for lo in range(0, len(items.ids), step):
        hi = min(lo + step, len(items.ids))
        vectors, norms = items.sides(used, groups, lo, hi)
        bounds = (vectors @ tree.centroids.T + norms @ tree.radii.T) * (1 + SLACK) + 1
        for i in range(lo, hi):
            own = place[items.terms[i]]
            weights = items.weights[items.terms[i]][own >= 0]
            own = own[own >= 0]
            if not len(own):
                continue
            heap, bound = heaps[i], bounds[i - lo].tolist()
            open_nodes = [(-bound[0], 0)]
            while open_nodes:
                most, node = heapq.heappop(open_nodes)
                if len(heap) == k and -most < heap[0][0]:
                    break
                if (pair := tree.children[node]) is not None:
                    for c in pair:
                        heapq.heappush(open_nodes, (-bound[c], c))
                    continue
                visited += 1
                a, b = tree.spans[node]
                scores = weights @ matrix[own, a:b]
                for j in np.flatnonzero(scores >= (heap[0][0] if len(heap) == k else 1)).tolist():
                    entry = (int(scores[j]), -ordered[a + j])
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
    return visited


def _searched(counts: DataFrame, block: list[tuple], terms: list[bytes], id_type, k: int) -> DataFrame:  # noqa: ANN001
    """(item_id, doc_id, score): k rows at most an item and task. block: (item_id, numbers of its terms)."""
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    weights = np.zeros(max(1, len(terms)), np.int64)
    for term, df in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
        weights[term] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
    items = counts.sparkSession.sparkContext.broadcast(Items([i for i, _ in block], [np.array(t, np.int64) for _, t in block], weights))
    most = max(1, min(CHUNK_ROWS, CHUNK_CELLS // len(weights)))
    arrow = to_arrow_type(id_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in own.ids]
        for b in batches:
            for lo in range(0, b.num_rows, most):
                part = b.slice(lo, most)
                lists = part.column(2)
                ends = np.asarray(lists.offsets)
                row = np.repeat(np.arange(part.num_rows), np.diff(ends))
                term, tf = (np.asarray(x.values)[ends[0] : ends[-1]].astype(np.int64) for x in (lists, part.column(3)))
                m = np.array([10 + (90 * x * n) // total for x in part.column(1).to_pylist()], np.int64)
                impacts = (10**9 * tf) // (1000 * tf + 8 * m[row])
                search_chunk(own, heaps, [_NO_ID if d is None else d for d in part.column(0).to_pylist()], term, row, impacts, k)
        found = [(i, None if -d == _NO_ID else -d, s) for i, heap in zip(own.ids, heaps, strict=True) for s, d in heap]
        if found:
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (arrow, pa.int64(), pa.int64()), strict=True)], ["item_id", "doc_id", "score"])

    return counts.where(F.size("terms") > 0).mapInArrow(run, f"item_id {id_type.simpleString()}, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) of highest score above 0 for each item (item_id, text)."""
    pairs = written(item_terms(items), "item-terms")
    blocks = max(1, -(-pairs.count() // block_terms))
    dealt, id_type, found = F.pmod(F.xxhash64("item_id"), F.lit(blocks)), pairs.schema["item_id"].dataType, []
    for block in range(blocks):
        own = pairs.where(dealt == block).groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms")).orderBy("item_id").collect()  # of bounded size
        terms = sorted({bytes(t) for r in own for t in r["terms"]})
        number = {t: j for j, t in enumerate(terms)}
        counts = written(term_counts(docs, terms), "term-counts")
        found.append(_searched(counts, [(r["item_id"], [number[bytes(t)] for t in r["terms"]]) for r in own], terms, id_type, k))
    # Spark limits each item's rows to k in every task before it shuffles them
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    whole = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return whole.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest-scoring of all documents for every benchmark item."""
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL
), s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0
), tf AS (
  SELECT uid, term, count(*) AS tf FROM (SELECT uid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM b) GROUP BY uid, term
), weights AS (SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, s GROUP BY term, n
), scores AS (
  SELECT b.item_id, tf.uid, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * s.n) // s.l)))) AS BIGINT) AS score
  FROM b JOIN tf USING (term) JOIN weights USING (term) JOIN d USING (uid), s GROUP BY b.item_id, tf.uid
), r AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS k FROM scores JOIN d USING (uid) WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM r WHERE k <= 10
"""
