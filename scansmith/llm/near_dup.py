"""Operator 3: near duplicates by improved consistent weighted sampling over TF-IDF shingles.

A document is the multiset of its five-word shingles (a document of fewer words is one shingle). A shingle weighs its count
times 1 + log((1 + N) / (1 + df)) with df of N documents that hold it, as a share of the greatest such weight. Frequencies are counted over all documents in a sketch
of fixed size, which alone is broadcast; what other shingles add to a cell on average is taken off, and frequencies below
twice the sketch's own noise count as that. LANES consistent weighted samples (the sampled shingle and its level) make BANDS
bands. Copies of a large group lower the weights of what they share and not of what each changed, so a document of which a
part is well below the greatest weight also has the bands of its plain counts, and a pair may be alike by weights or by counts.

Documents with the same words are one node; nodes that share a band are a bucket. A bucket's nodes meet in chunks of bounded
size, whose exact weighted Jaccard similarities are computed against inverted lists; what leaves a chunk is a spanning forest
of its links, never its pairs. A bucket that is too large for one chunk is finished by a second pass in which every node
outside the bucket's largest component meets all chunks of the bucket, so no link between components is missed. Components
come from alternating large- and small-star steps, each written to the shared folder.

Similarity is that of the nodes' shingle numbers (32 bits) and weights, or counts if that is more; SIMILARITY or more links.
Links are found if the pair shares a band: 0.998 of pairs at 0.8, more above; 0.99 of pairs that are at 0.8 by counts where
neither has bands of counts, as then at most a tenth is of low weight.

Defined results: documents without words are copies only of documents with equal text; null text is empty; a very long text is
hashed in slices, whole, and is a set like any other (the set must fit a task); a row repeated as a whole is a copy of itself; a
class is named by its smallest doc_id (null counts as smallest); an empty table gives no rows; other columns are ignored by
`classes` and kept by `deduplicate`, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scansmith.llm.common import discard, grams, hashed_words, mix, small_batches, unused, written

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 4
LANES = BANDS * ROWS
SKETCH, SKETCH_ROWS = 1 << 18, 2
LOWERED, LOWERED_SHARE = 0.85, 0.1  # a document of which this share is shingles of lower weight has bands of its plain counts too
CHUNK_NODES, CHUNK_SHINGLES = 2048, 3_000_000

_TABLE = 1 << 16
_rng = np.random.default_rng(3)
_R = _rng.gamma(2, 1, _TABLE).astype(np.float32)
_LOG_C = np.log(_rng.gamma(2, 1, _TABLE)).astype(np.float32)
_BETA = ((np.arange(_TABLE) + 0.5) / _TABLE).astype(np.float32)
_SEEDS, _FACTORS = (_rng.integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def shingles(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of a run of documents with words between the bounds at; documents and shingles ascend."""
    sizes = np.diff(at)
    whole = grams(words, SHINGLE)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    good = np.flatnonzero(doc[: len(whole)] == doc[SHINGLE - 1 :]) if len(whole) else np.zeros(0, np.int64)
    docs, found = [doc[good]], [whole[good]]
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)).tolist():
        own = words[at[i] : at[i + 1]]
        docs.append(np.array([i]))
        found.append(grams(own, len(own)) + np.uint64(len(own)))
    d, h = np.concatenate(docs), np.concatenate(found)
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    first = np.ones(len(d), bool)
    first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    place = np.flatnonzero(first)
    return d[place], h[place], np.diff(np.append(place, len(d)))


def _short(h: np.ndarray) -> np.ndarray:
    """The 32 bits of a shingle's hash that name it in sketches and sets."""
    return (h >> np.uint64(32)).astype(np.uint32)


def _cells(short: np.ndarray) -> list[np.ndarray]:
    return [(mix(short.astype(np.uint64) + np.uint64((r + 1) << 32)) % np.uint64(SKETCH)).astype(np.int64) for r in range(SKETCH_ROWS)]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The count-min sketch of the shingles' document frequencies, and the number of documents."""
    pieces = 32  # of the sketch, so that partial sketches are added up in so many tasks

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = np.zeros((SKETCH_ROWS, SKETCH), np.int64), 0
        for b in batches:
            n += b.num_rows
            for _, _, words, at in hashed_words(b.column(0)):
                for r, cells in enumerate(_cells(_short(shingles(words, at)[1]))):
                    own[r] += np.bincount(cells, minlength=SKETCH)
        if n:
            parts = own.reshape(pieces, -1)
            yield pa.record_batch([pa.array(range(pieces), pa.int32()), pa.array([n] + [0] * (pieces - 1), pa.int64()), pa.array([zlib.compress(p.astype("<u4").tobytes(), 1) for p in parts])], ["piece", "docs", "counts"])

    def add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        n: dict[int, int] = {}
        for b in rows:
            for piece, docs_, counts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(zlib.decompress(counts), "<u4").astype(np.int64)
                n[piece] = n.get(piece, 0) + docs_
        for piece, x in sums.items():
            yield pa.record_batch([pa.array([piece], pa.int32()), pa.array([n[piece]], pa.int64()), pa.array([zlib.compress(x.tobytes(), 1)])], ["piece", "docs", "counts"])

    schema = "piece int, docs long, counts binary"
    with small_batches(docs.sparkSession):
        parts = docs.select(F.col("text").cast("string")).mapInArrow(count, schema).repartition(pieces, "piece").mapInArrow(add, schema).collect()
    out = np.zeros((pieces, SKETCH_ROWS * SKETCH // pieces), np.int64)
    for r in parts:
        out[r["piece"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return out.reshape(SKETCH_ROWS, SKETCH), sum(r["docs"] for r in parts)


def idf_table(sketch: np.ndarray, docs: int) -> np.ndarray:
    """The weight that each cell of the sketch gives a shingle, 1 at most; a shingle has the greatest of its cells' weights."""
    usual = sketch.sum(axis=1, keepdims=True) / sketch.shape[1]
    own = np.maximum(sketch - usual, np.maximum(1, 2 * np.sqrt(usual)))
    out = 1 + np.log((1 + docs) / (1 + np.minimum(own, docs)))
    return (out / out.max()).astype(np.float32)


def _idf(table: np.ndarray, short: np.ndarray) -> np.ndarray:
    out = None
    for row, cells in zip(table, _cells(short), strict=True):
        out = row[cells] if out is None else np.maximum(out, row[cells])
    return out


def samples(h: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """LANES consistent weighted samples of each run of shingles that begins at starts; 32 bits for shingle and level."""
    out = np.empty((len(starts), LANES), np.uint64)
    other = np.flatnonzero(weights != 1)  # most shingles are rare and occur once
    log_w = np.log(weights[other]).astype(np.float32)
    for k in range(LANES):
        x = (h ^ _SEEDS[k]) * _FACTORS[k]
        x ^= x >> np.uint64(31)
        i, j, b = x >> np.uint64(48), (x >> np.uint64(32)) & np.uint64(0xFFFF), (x >> np.uint64(16)) & np.uint64(0xFFFF)
        r, beta = _R[i], _BETA[b]
        low = (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
        log_a = _LOG_C[j] - r * (1 - beta)  # weight 1 has level 0
        if len(other):
            level = np.floor(log_w / r[other] + beta[other])
            log_a[other] = _LOG_C[j[other]] - r[other] * (level - beta[other] + 1)
            low[other] ^= (level.astype(np.int64).view(np.uint64) * np.uint64(0x632BE5AB)) & np.uint64(0xFFFFFFFF)
        bits = log_a.view(np.uint32)
        key = np.where(bits >> 31 == 1, ~bits, bits | np.uint32(0x80000000)).astype(np.uint64)
        out[:, k] = np.minimum.reduceat((key << np.uint64(32)) | low, starts) & np.uint64(0xFFFFFFFF)
    return out


def bands_of(lanes: np.ndarray) -> np.ndarray:
    """A hash of the ROWS samples of each band, and of the band's number."""
    out = np.zeros((len(lanes), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + lanes[:, r::ROWS])
    return out


def signatures(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """(doc_id, h, node, size, bands) of every row of docs (doc_id, h, text); node: 16 bytes that equal words share."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nodes, sizes, bands, held = [], np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, 2 * BANDS), np.uint64), np.zeros((b.num_rows, 2 * BANDS), bool)
            for lo, hi, words, at in hashed_words(b.column(2)):
                d, h, n = shingles(words, at)
                starts = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.zeros(0, np.int64)
                if len(d):
                    rows, counts, idf = lo + d[starts], n.astype(np.float32), _idf(shared.value, _short(h))
                    sizes[rows] = np.diff(np.append(starts, len(d)))
                    bands[rows, :BANDS] = bands_of(samples(h, idf * counts, starts))
                    held[rows, :BANDS] = True
                    if (low := np.add.reduceat(counts * (idf < LOWERED), starts) >= LOWERED_SHARE * np.add.reduceat(counts, starts)).any():
                        own = np.repeat(low, sizes[rows])
                        bands[rows[low], BANDS:] = bands_of(samples(h[own], counts[own], np.append(0, np.cumsum(sizes[rows[low]])[:-1])))
                        held[rows[low], BANDS:] = bands[rows[low], BANDS:] != bands[rows[low], :BANDS]
                for i in range(lo, hi):
                    own = words[at[i - lo] : at[i - lo + 1]].tobytes() or b"text:" + (b.column(2)[i].as_py() or "").encode()
                    nodes.append(hashlib.blake2b(own, digest_size=16).digest())
            ends = np.append(0, np.cumsum(held.sum(1))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands[held].view(np.int64)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(sizes), lists], ["doc_id", "h", "node", "size", "bands"])

    return docs.mapInArrow(run, "doc_id long, h long, node binary, size long, bands array<long>")


def similar(left: list[tuple[np.ndarray, ...]], right: list[tuple[np.ndarray, ...]] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among left, or of those between left and right (numbered behind left).

    A set is its shingles, their weights and, if given, their counts; either links.
    Breadth first over inverted lists: each node is held against the nodes that no component has reached yet, so a group of
    near copies costs about its size times the nodes that are not alike, not its square.
    """
    sets = [*left, *(right or [])]
    m, cross = len(sets), len(left) if right is not None else None
    measures = [1, -1] if any(len(s) > 2 for s in sets) else [1]  # places of weights and counts in a set
    totals = [np.array([s[k].sum() for s in sets]) for k in measures]
    if m == 2:
        _, i, j = np.intersect1d(sets[0][0], sets[1][0], True, True)
        shared = [np.minimum(sets[0][k][i], sets[1][k][j]).sum() for k in measures]
        return [(0, 1)] if any(both >= SIMILARITY * (total.sum() - both) - 1e-6 for both, total in zip(shared, totals, strict=True)) else []
    h, values = np.concatenate([s[0] for s in sets]), [np.concatenate([s[k] for s in sets]) for k in measures]
    doc = np.repeat(np.arange(m), [len(s[0]) for s in sets])
    _, term = np.unique(h, return_inverse=True)
    begin = np.append(0, np.cumsum([len(s[0]) for s in sets]))
    free, links = np.ones(m, bool), []

    def lists() -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        own = np.flatnonzero(free[doc])
        own = own[np.argsort(term[own], kind="stable")]
        return doc[own], [w[own] for w in values], np.searchsorted(term[own], np.arange(term.max() + 2))

    posted, weights, at = lists()
    held = m
    for seed in range(m):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [seed]
        while queue:
            q = queue.pop()
            if (n := int(free.sum())) < held // 2:
                (posted, weights, at), held = lists(), n
            own = term[begin[q] : begin[q + 1]]
            sizes = at[own + 1] - at[own]
            if n == 0 or not sizes.sum():
                continue
            index = np.repeat(at[own] - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum())
            alike, at_index = np.zeros(m, bool), posted[index]
            for w, weight, total in zip(values, weights, totals, strict=True):
                both = np.bincount(at_index, np.minimum(weight[index], np.repeat(w[begin[q] : begin[q + 1]], sizes)), m)
                alike |= both >= SIMILARITY * (total[q] + total - both) - 1e-6
            new = free & alike
            if cross is not None:
                new[:cross] &= q >= cross
                new[cross:] &= q < cross
            found = np.flatnonzero(new).tolist()
            links += [(q, x) for x in found]
            free[found] = False
            queue += found
    return links


def _blob(text_column: pa.Array) -> list[bytes]:
    """Each text's ascending 32-bit shingle numbers and, unless all are 1, their counts in 2 or 4 bytes; the bytes of a count."""
    out = [b""] * len(text_column)
    for lo, hi, words, at in hashed_words(text_column):
        d, h, n = shingles(words, at)
        if not len(d):
            continue
        bounds, short = np.searchsorted(d, np.arange(hi - lo + 1)), _short(h)
        for i in range(hi - lo):
            s = slice(bounds[i], bounds[i + 1])
            own, place = np.unique(short[s], return_inverse=True)
            counts = np.bincount(place, n[s], len(own))
            size = 0 if counts.max(initial=1) == 1 else 2 if counts.max() < 1 << 16 else 4
            out[lo + i] = own.tobytes() + (counts.astype(f"<u{size}").tobytes() if size else b"") + bytes([size])
    return out


def _set(blob: bytes, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingle numbers, weights and counts of a blob."""
    size = blob[-1]
    n = len(blob) // (4 + size)
    short = np.frombuffer(blob, np.uint32, n)
    counts = np.frombuffer(blob, f"<u{size}", n, 4 * n).astype(np.float32) if size else np.ones(n, np.float32)
    return short, _idf(table, short) * counts, counts


_LINK = "a binary, b binary"


def _grouped(rows: DataFrame, keys: list[str], links, columns: list[str]) -> DataFrame:  # noqa: ANN001
    """Links of each group of rows, read in key order; one group is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group = None, []

        def told() -> Iterator[pa.RecordBatch]:
            found = sorted(set(links(group))) if len(group) > 1 else []
            if found:
                yield pa.record_batch([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            for key, *row in zip(zip(*(b.column(k).to_pylist() for k in keys), strict=True), *(b.column(c).to_pylist() for c in columns), strict=True):
                if key != last:
                    yield from told()
                    last, group = key, []
                group.append(row)
        yield from told()

    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, _LINK)


def _alike(group: list[list], table: Broadcast) -> list[tuple[bytes, bytes]]:
    nodes = sorted({n: blob for n, blob in group}.items())
    return [(nodes[x][0], nodes[y][0]) for x, y in similar([_set(b, table.value) for _, b in nodes])]


def _alike_across(group: list[list], table: Broadcast) -> list[tuple[bytes, bytes]]:
    sides = [sorted({n: blob for n, blob, outer in group if outer is s}.items()) for s in (True, False)]
    nodes = [*sides[0], *sides[1]]
    return [(nodes[x][0], nodes[y][0]) for x, y in similar(*([_set(b, table.value) for _, b in s] for s in sides))] if all(sides) else []


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of links (a, b): root is the smallest node of its component."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small, "u")
        last, edges = edges, written(step.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(step.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(last)
        state = tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text"))


_ROW = ["_h", "_d", "_gone"]


def _keyed(rows: DataFrame, h: Column, names: list[str] = _ROW) -> DataFrame:  # noqa: B006
    """rows with keys of their doc_id and text, null doc_ids included: plain ones, so that one shuffle serves a grouping and a join by them."""
    number = F.col("doc_id").cast("long")
    return rows.withColumns(dict(zip(names, (h, F.coalesce(number, F.lit(0)), number.isNull()), strict=True)))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, h, class_id, first) of every row of docs (doc_id, text): its class, and whether it is the class's first.

    h is xxhash64 of the text. Rows that agree in doc_id and text are first together.
    """
    known = _identified(docs)
    sketch, n = document_frequencies(known)
    table = idf_table(sketch, n)
    signed = written(signatures(known, table), "signatures")
    nodes = written(signed.groupBy("node").agg(F.min(F.struct("doc_id", "h")).alias("own"), F.first("size").alias("size"), F.first("bands").alias("bands")), "nodes")
    member = nodes.where("size > 0").select("node", "size", F.explode("bands").alias("bucket"))
    load = member.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("load"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x")).where("n > 1")
    chunks = F.ceil(F.greatest(F.col("n") / CHUNK_NODES, F.col("load") / CHUNK_SHINGLES)).cast("int")
    buckets = load.groupBy("n", "s", "x").agg(F.min("bucket").alias("bucket"), F.max("load").alias("load")).select("bucket", chunks.alias("chunks"))
    wanted = member.join(buckets, "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "chunks")).alias("buckets"))
    wanted = _keyed(wanted.join(nodes.select("node", "own.*"), "node"), F.col("h")).select(*_ROW, "node", "buckets")

    shared = docs.sparkSession.sparkContext.broadcast(table)
    once = _keyed(known, F.col("h")).groupBy(*_ROW).agg(F.first("text").alias("text"))
    texts = once.join(wanted, _ROW).select("node", "buckets", "text")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), b.column(1), pa.array(_blob(b.column(2)), pa.binary())], ["node", "buckets", "blob"])

    sets = written(texts.mapInArrow(shingled, "node binary, buckets array<struct<bucket:bigint,chunks:int>>, blob binary"), "sets")
    placed = sets.select("node", "blob", F.explode("buckets").alias("x")).select("node", "blob", "x.*").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    links = written(_grouped(placed, ["bucket", "chunk"], lambda group: _alike(group, shared), ["node", "blob"]), "alike")
    roots = written(components(links), "roots")
    large = placed.where("chunks > 1")
    if not large.limit(1).isEmpty():
        own = written(large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "large")
        sizes = own.groupBy("bucket", "chunks", "root").count()
        most = sizes.groupBy("bucket").agg(F.max(F.struct("count", "root")).alias("x"), F.sum("count").alias("n")).select("bucket", F.col("x.root").alias("main"), F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("x.count")) / CHUNK_NODES)).cast("int").alias("outer_chunks"))
        sided = own.join(most, "bucket")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        outer = sided.where("root <> main").withColumn("part", F.pmod(F.xxhash64("node", F.lit(2)), F.col("outer_chunks")).cast("int")).drop("chunk").withColumn("chunk", every("chunks")).withColumn("outer", F.lit(True))
        inner = sided.withColumn("part", every("outer_chunks")).withColumn("outer", F.lit(False))
        keys, columns = ["bucket", "chunk", "part"], ["node", "blob", "outer"]
        more = written(_grouped(outer.select(*keys, *columns).unionByName(inner.select(*keys, *columns)), keys, lambda group: _alike_across(group, shared), columns), "across")
        old, roots = roots, written(components(links.union(more)), "roots")
        discard(old, own, more)
    discard(sets, links)
    rooted = nodes.select("node", "own").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.groupBy("root").agg(F.min("own").alias("first"))
    of_node = rooted.join(named, "root").select("node", F.col("first"))
    out = signed.select("doc_id", "h", "node").join(of_node, "node")
    return out.select("doc_id", "h", F.col("first.doc_id").alias("class_id"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))).alias("first"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: its first; of rows that agree in doc_id and text any one."""
    kept = _keyed(classes(docs).where("first"), F.col("h")).select(*_ROW).distinct()
    names = [unused(docs, k) for k in _ROW]
    own = _keyed(docs, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), names)
    # repeats go within each task first, so that a row which is repeated often is not brought to one
    return own.dropDuplicates(names).join(kept.toDF(*names), names, "left_semi").drop(*names)


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class: documents that links of SIMILARITY or more connect."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", F.col("first").alias("kept"))
