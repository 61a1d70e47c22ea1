"""Operator 8: benchmark decontamination by winnowing.

A window is WINDOW successive words of a benchmark item; an item of fewer words, but not none, is one window. Both sides are
winnowed: of the WINDOW - GRAM + 1 k-gram hashes that a window holds the least one is its fingerprint, so a span of WINDOW
shared words always has a shared fingerprint. A bitmap of fixed size marks the benchmark's fingerprints; it goes to every
task and lets through the few places of a document whose fingerprint may be among them. Those places join the benchmark's
fingerprints, and each hit is extended to its whole window by the window's own 64-bit hash. Benchmark rows are first brought
together by window, so the join never multiplies rows, and a passage that a third of the documents hold is only a long run
of single matches. No text is shuffled.

Items shorter than a window have their whole word sequence as fingerprint, looked up at every place of a document; at most
WINDOW - 1 lengths can occur.

Defined results: null text has no words and is clean; an item without words or with a null item_id is no window; equal item
numbers count once; repeated documents each get a row; an empty benchmark leaves all documents clean; a very
long text is hashed in pieces that end between words, whole; no documents give no rows; other columns stay out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scansmith.llm.common import grams, hashed_words, mix, written

WINDOW, GRAM = 13, 6
BITS = 1 << 24  # of the bitmap: 2 MB, whatever the benchmark
SHARE = 20  # contaminated: one word in so many is hit


def _windows(words: np.ndarray, n: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and hash of each run of n words. n is a whole short item, or WINDOW."""
    whole = grams(words, n) + np.uint64(n)
    if short or not len(whole):
        return mix(whole), whole
    g = grams(words, GRAM)
    least = g[: len(whole)].copy()
    for j in range(1, n - GRAM + 1):
        np.minimum(least, g[j : j + len(whole)], out=least)
    return least, whole


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(f, h, n, items): each distinct window's fingerprint, hash and words, and the items that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, words, at in hashed_words(b.column(1)):
                for i in range(lo, hi):
                    own = words[at[i - lo] : at[i - lo + 1]]
                    if len(own):
                        n = min(window, len(own))
                        f, h = _windows(own, n, n < window)
                        yield pa.record_batch([pa.array(f.view(np.int64)), pa.array(h.view(np.int64)), pa.array(np.full(len(h), n, np.int32)), pa.array([ids[i]] * len(h), pa.string())], ["f", "h", "n", "item"])

    rows = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, "f long, h long, n int, item string")
    return rows.groupBy("f", "h", "n").agg(F.collect_set("item").alias("items"))


def _bitmap(windows: DataFrame, bits: int) -> np.ndarray:
    """Which fingerprints occur, modulo bits; at most 8 bitmaps reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits, bool)
        for b in batches:
            own[b.column(0).to_numpy().view(np.uint64) % np.uint64(bits)] = True
        yield pa.record_batch([pa.array([zlib.compress(np.packbits(own).tobytes(), 1)])], ["bitmap"])

    out = np.zeros(bits // 8, np.uint8)
    for r in windows.select("f").coalesce(8).mapInArrow(run, "bitmap binary").collect():
        out |= np.frombuffer(zlib.decompress(r["bitmap"]), np.uint8)
    return np.unpackbits(out).astype(bool)


def hit_places(docs: DataFrame, windows: DataFrame, window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """Per document of docs (uid, ..., text): its columns but the text, n_words, and arrays f, h, n, pos of its windows whose fingerprint may occur."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(windows, bits)))
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most WINDOW of them
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.unpackbits(shared.value).astype(bool)
        for b in batches:
            if not b.num_rows:
                continue
            counts, found = np.zeros(b.num_rows, np.int64), [[np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32)]]
            for lo, hi, words, at in hashed_words(b.column(b.schema.get_field_index("text"))):
                counts[lo:hi] = np.diff(at)
                doc = np.repeat(np.arange(lo, hi), np.diff(at))
                for n in lengths:
                    f, h = _windows(words, n, n < window)
                    good = np.flatnonzero(known[f % np.uint64(bits)] & (doc[: len(f)] == doc[n - 1 :])) if len(f) else np.zeros(0, np.int64)
                    if len(good):
                        found.append([doc[good], f[good].view(np.int64), h[good].view(np.int64), np.full(len(good), n, np.int32), (good - at[doc[good] - lo]).astype(np.int32)])
            doc, *parts = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(doc, kind="stable")
            ends = np.searchsorted(doc[order], np.arange(b.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[order])) for x in parts]
            yield pa.record_batch([*(b.column(b.schema.get_field_index(c)) for c in names), pa.array(counts), *lists], [*names, "n_words", "f", "h", "n", "pos"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(run, f"{kept}, n_words long, f array<long>, h array<long>, n array<int>, pos array<int>")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, bits: int = BITS) -> DataFrame:
    """doc_id, text_hash (xxhash64), n_words, n_hit, items (sorted as text), contaminated of every row of docs (doc_id, text)."""
    windows = written(item_windows(benchmark, window), "windows")
    places = written(hit_places(docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("string").alias("text")), windows, window, bits), "places")
    flat = places.where(F.size("f") > 0).select("uid", F.explode(F.arrays_zip("f", "h", "n", "pos")).alias("x")).select("uid", "x.*")
    hits = flat.join(windows, ["f", "h", "n"]).select("uid", "pos", "n", "items")
    # words in the union of the hit windows: sorted by place, each adds what lies behind all before it
    spans = F.sort_array(F.collect_set(F.struct("pos", (F.col("pos") + F.col("n")).alias("to"))))
    union = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["to"] - F.greatest(a["to"], s["pos"].cast("long")))).alias("n"), F.greatest(a["to"], s["to"].cast("long")).alias("to")),
        lambda a: a["n"],
    )
    found = hits.groupBy("uid").agg(union.alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    out = places.select("uid", "doc_id", "text_hash", "n_words").join(found, "uid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), ((n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without its contaminated rows."""
    bad = contamination(docs, benchmark).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(docs["text"]) == bad["_hash"]), "left_anti")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's hits and verdict against the whole benchmark."""
    out = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(list_transform(range(1, greatest(len(w) - 11, 2)), lambda i: array_to_string(w[i : i + 12], ' '))) AS x
  FROM b WHERE len(w) > 0
), lengths AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT uid, n, pos, array_to_string(w[pos : pos + n - 1], ' ') AS x
  FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, lengths WHERE len(w) >= n)
), hits AS (SELECT p.uid, p.pos, p.n, v.item_id FROM places p JOIN windows v ON p.n = v.n AND p.x = v.x
), hit_words AS (SELECT uid, count(DISTINCT k) AS n_hit FROM (SELECT uid, unnest(range(pos, pos + n)) AS k FROM (SELECT DISTINCT uid, pos, n FROM hits)) GROUP BY uid
), hit_items AS (
  SELECT uid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY uid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit_words USING (uid) LEFT JOIN hit_items USING (uid)
"""
