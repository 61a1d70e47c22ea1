"""Operator 10: shards of near equal bytes by sampled splitters.

Records are ordered by (md5 of the text, doc_id, a stable row number). A size-weighted sample of keys gives quantile
boundaries; records are range-partitioned by them, and ranges that come out overfull are subdivided by a further sample of
their own keys, down to single rows, so a text that a third of all rows share is spread over many ranges. Exact range totals
and their prefix sums then give every record its global place, from which shards follow.

A text whose group of rows is over an average range, in rows or bytes, or over 1/LARGE of a shard is large: there are at most
two a range and shards * LARGE of them. Boundaries fall inside large texts and before the first row of all others, so every
group lies in one range or is large. Large groups are placed first, as wholes, largest first, into the emptiest shards, those
over 1/SPLIT of a shard row by row; all others fill the shards' remaining room in key order. So equal texts share a shard, at
every size, unless their group is over 1/SPLIT of a shard, and shards differ by about 1/LARGE of a shard, or by a record or
group that is larger than that.

Defined results: null text has size 1 and the checksum of no bytes; null doc_id sorts first; repeated rows each get a slot
of their own; an empty table gives no rows; a very long text is one row of its size, never cut;
columns other than doc_id and text are ignored, and kept by `write_shards`.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scansmith.llm.common import discard, unused, written

SHARDS = 16
LARGE, SPLIT = 64, 8
ROWS_A_RANGE, SAMPLES_A_RANGE = 20_000, 32
MOST_RANGES = 10_000  # beyond it ranges grow: what the driver adds up is one row a range
OVERFULL, ROUNDS = 2.0, 4


def _sampled(rows: DataFrame, weight: F.Column, expected: F.Column) -> list[tuple]:
    """Keys drawn with a chance of weight * expected, by a hash of the row, so a repeated run draws the same."""
    chance = F.pmod(F.xxhash64("h", "doc_id", "uid", F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return [(r["range"], (int(r["h"][:16], 16), r["d"], r["uid"])) for r in rows.where(chance < weight * expected).select("range", "h", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), "uid").collect()]


def _boundaries(keys: list[tuple], parts: int, large: frozenset[int]) -> list[tuple]:
    """Quantiles of a sample, moved to their text's first row unless it is large."""
    keys = sorted(keys)
    cuts = {keys[len(keys) * k // parts] for k in range(1, parts)} if keys else set()
    return sorted({c if c[0] in large else (c[0], -(1 << 63), -1) for c in cuts})


def _ranged(rows: DataFrame, cuts: list[tuple]) -> DataFrame:
    """rows with the number of the range between cuts in which each lies."""
    high = np.array([c[0] for c in cuts], np.uint64)
    names = [f.name for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            hs = b.column(names.index("h")).to_pylist()
            own = np.array([int(x[:16], 16) for x in hs], np.uint64)
            out = np.searchsorted(high, own, "right").astype(np.int64)
            ties = np.flatnonzero(np.searchsorted(high, own, "left") != out)
            ds, us = b.column(names.index("doc_id")), b.column(names.index("uid"))
            for i in ties.tolist():
                d = ds[i].as_py()
                out[i] = bisect.bisect_right(cuts, (int(own[i]), -(1 << 63) if d is None else d, us[i].as_py()))
            yield pa.record_batch([*(b.column(k) for k in range(len(names))), pa.array(out)], [*names, "range"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, range long")


def ranges_of(count: int, rows_a_range: int = ROWS_A_RANGE) -> int:
    """How many ranges so many rows are cut into at first."""
    return min(max(1, -(-count // rows_a_range)), MOST_RANGES)


def split_ranges(rows: DataFrame, total: int, count: int, rows_a_range: int = ROWS_A_RANGE, large_texts: list[str] = ()) -> DataFrame:  # noqa: B006
    """rows (doc_id, size, h, uid, ...) with a range number that ascends with the key; only those of large_texts lie in several, and no range is overfull."""
    parts, large = ranges_of(count, rows_a_range), frozenset(int(h[:16], 16) for h in large_texts)
    weight = (F.col("size") / F.lit(float(max(total, 1))) + F.lit(1.0 / max(count, 1))) / 2
    cuts = _boundaries([k for _, k in _sampled(rows.withColumn("range", F.lit(0)), weight, F.lit(float(parts * SAMPLES_A_RANGE)))], parts, large) if parts > 1 else []
    for _ in range(ROUNDS):
        full = _ranged(rows, cuts)
        load = (F.sum("size") / F.lit(float(max(total, 1))) + F.count("*") / F.lit(float(max(count, 1)))) / 2 * parts
        over = [(r["range"], r["load"]) for r in full.groupBy("range").agg(load.alias("load"), F.count("*").alias("n")).where((F.col("load") > OVERFULL) & (F.col("n") > 1)).collect()]
        if not over or parts == 1:
            break
        drawn = _sampled(full.where(F.col("range").isin([r for r, _ in over])), weight, F.lit(float(parts * SAMPLES_A_RANGE * 4)))
        more = {c for r, x in over for c in _boundaries([k for q, k in drawn if q == r], int(2 * x) + 1, large)}
        if more <= set(cuts):
            break
        cuts = sorted({*cuts, *more})
    return _ranged(rows, cuts)


def place_large(groups: list[tuple[str, int, int]], shards: int, target: float) -> tuple[list[tuple[str, int, int, int]], list[float]]:
    """(h, first row, row behind the last, shard) of groups (h, bytes, rows) of equal texts; the room left in each shard."""
    load = [0.0] * shards
    placed = []
    for h, size, n in sorted(groups, key=lambda g: (-(g[1] if g[1] * SPLIT <= target else g[1] / g[2]), g[0])):
        if size * SPLIT <= target or n == 1:
            s = min(range(shards), key=lambda j: (load[j], j))
            placed.append((h, 0, n, s))
            load[s] += size
            continue
        one, lo, hi = size / n, min(load), max(load) + size
        for _ in range(100):  # the level up to which n rows fill the shards
            level = (lo + hi) / 2
            lo, hi = (level, hi) if sum(max(0, int((level - x) / one)) for x in load) < n else (lo, level)
        take = [max(0, int((lo - x) / one)) for x in load]
        heap = [(load[j] + take[j] * one, j) for j in range(shards)]
        heapq.heapify(heap)
        for _ in range(n - sum(take)):
            x, j = heapq.heappop(heap)
            take[j] += 1
            heapq.heappush(heap, (x + one, j))
        at = 0
        for j, k in enumerate(take):
            if k:
                placed.append((h, at, at + k, j))
                load[j] += k * one
                at += k
    return placed, [max(0.0, target - x) for x in load]


def _keys(docs: DataFrame, uid: str) -> DataFrame:
    """(doc_id, size, text_crc32, h, uid) of docs (doc_id, text, and a row number of that name)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(F.encode(text, "UTF-8")).alias("h"), F.col(uid).alias("uid"))


def assign_shards(docs: DataFrame, shards: int = SHARDS, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of docs (doc_id, text), under law `bytes`."""
    keys = written(_keys(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid")), "uid"), "keys")
    return _assigned(keys, shards, rows_a_range).drop("uid")


def _assigned(rows: DataFrame, shards: int, rows_a_range: int) -> DataFrame:
    """The columns of assign_shards, and uid, of rows as `_keys` gives them, which are read several times."""
    spark = rows.sparkSession
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    target, parts = max(total, 1) / shards, ranges_of(count, rows_a_range)
    sums = rows.groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    wide = (F.col("bytes") * LARGE > F.lit(target)) | ((F.col("n") > 1) & ((F.col("bytes") * parts > F.lit(total)) | (F.col("n") * parts > F.lit(count))))
    placed, room = place_large([tuple(r) for r in sums.where(wide).collect()], shards, target)
    names = sorted({p[0] for p in placed})
    large = spark.createDataFrame([(h,) for h in names], "h string").withColumn("large", F.lit(True))
    full = written(split_ranges(rows, total, count, rows_a_range, names).join(F.broadcast(large), "h", "left").withColumn("large", F.coalesce("large", F.lit(False))), "ranges")

    # prefix sums over the ranges, and over the pieces of each large group: one row a range, and one a range and large group
    small = F.when(F.col("large"), 0).otherwise(F.col("size"))
    base, bases = 0, []
    for r, x in sorted(tuple(r) for r in full.groupBy("range").agg(F.sum(small)).collect()):
        bases.append((r, base))
        base += x
    before: dict[str, int] = {}
    pieces = []
    for h, r, n in sorted(tuple(r) for r in full.where("large").groupBy("h", "range").count().collect()):
        pieces.append((h, r, before.get(h, 0)))
        before[h] = before.get(h, 0) + n
    ends, at, whole = [], 0.0, sum(room) or 1.0
    for x in room:
        at += x
        ends.append(at / whole * base)

    key = ["h", F.col("doc_id").asc_nulls_first(), "uid"]
    in_range, in_text = Window.partitionBy("range").orderBy(*key), Window.partitionBy("range", "h").orderBy(*key)
    of_text = Window.partitionBy("range", "h")
    start = F.sum(small).over(in_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - small
    fine = full.withColumn("start", start).withColumn("first", F.min("start").over(of_text)).withColumn("bytes", F.sum("size").over(of_text)).withColumn("row", F.row_number().over(in_text) - 1)
    fine = fine.join(F.broadcast(spark.createDataFrame(bases, "range long, base long")), "range")
    middle = F.col("base") + F.col("first") + F.col("bytes") / 2
    by_room = sum((F.when(middle > F.lit(e), 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    easy = fine.where(~F.col("large")).withColumn("shard", by_room.cast("int"))
    parts = F.broadcast(spark.createDataFrame(pieces, "h string, range long, piece long"))
    spans = F.broadcast(spark.createDataFrame(placed, "h string, lo long, hi long, shard int"))
    at = F.col("row") + F.col("piece")
    hard = fine.where("large").join(parts, ["h", "range"]).join(spans, "h").where((at >= F.col("lo")) & (at < F.col("hi")))
    columns = ["doc_id", "size", "text_crc32", "h", "uid", "range", "shard"]
    out = written(easy.select(columns).unionByName(hard.select(columns)), "shards")
    discard(full)

    seen: dict[int, int] = {}
    firsts = []
    for r, s, n in sorted(tuple(r) for r in out.groupBy("range", "shard").count().collect()):
        firsts.append((r, s, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + n
    slot = F.row_number().over(Window.partitionBy("range", "shard").orderBy(*key)) - 1 + F.col("first")
    numbered = out.join(F.broadcast(spark.createDataFrame(firsts, "range long, shard int, first long")), ["range", "shard"]).withColumn("slot", slot.cast("long"))
    return numbered.select("uid", "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The rows of docs, all columns, in one folder a shard, in slot order; a column named shard or slot is replaced."""
    docs = docs.drop("shard", "slot")
    uid = unused(docs, "uid")
    whole = written(docs.withColumn(uid, F.monotonically_increasing_id()), "records")
    placed = _assigned(written(_keys(whole, uid), "keys"), shards, ROWS_A_RANGE).select(F.col("uid").alias(uid), "shard", "slot")
    whole.join(placed, uid).drop(uid).repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op10_sampled_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and slot."""
    return assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
