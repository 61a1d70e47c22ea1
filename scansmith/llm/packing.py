"""Operator 2: best-fit packing by a grouping genetic algorithm on islands.

Items (uid, length) are dealt by hash into blocks of about BLOCK items, whatever their documents, sources or lengths, so
each block is a packing problem of bounded size and hot keys do not matter. Every block is solved on several islands:
populations of whole packings, seeded by best-fit decreasing, whose crossover injects well-filled bins of one parent into
the other, removes the bins that then hold a document twice, and puts the displaced documents back by best fit. Between
epochs each island's elites move to the next island of the block (a shuffle of one row an island). Items of bins that stay
under-filled are dealt anew, bin by bin, and evolve once more from the packing that they have, which can only save bins.

Defined results: an empty or null text is the end ID alone; a very long text is encoded whole and makes as many pieces as it
needs; repeated rows are packed as often as they occur; no items give no sequences; other columns are ignored, whatever their
names. Items longer than the capacity are refused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scansmith.llm.common import map_texts, written
from scansmith.llm.tokens import END_ID, Encoder, crc32_u32, default_vocabulary

CAPACITY = 1024
BLOCK = 2048
ISLANDS, POPULATION, ELITES = 3, 6, 2
EPOCHS, GENERATIONS = 2, 30
INJECTED = 0.12  # of the bins of a parent
UNDER = 0.985  # bins filled less are dealt anew after the first round
_FULL_ID = 1 << 62

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: only the first may be shorter than the capacity."""
    first = n % capacity if n > capacity else n
    return [(0, first)] * (first > 0) + [(at, capacity) for at in range(first, n, capacity)]


def token_pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The pieces of every whole text of docs (doc_id, text), with their checksum and, if asked for, their IDs."""
    path = vocabulary or default_vocabulary()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder, out, own = Encoder.of(path), [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = np.append(np.frombuffer(encoder.encode(text or ""), encoder.dtype), np.array(end_id, encoder.dtype))
            for k, (at, n) in enumerate(cut(len(ids), capacity)):
                out.append((doc, k, at, n, crc32_u32(ids[at : at + n])))
                own.append(ids[at : at + n].astype(np.int64))
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        return pa.record_batch(columns + ([pa.array(own, pa.list_(pa.int64()))] if with_ids else []), names + ["ids"] * with_ids)

    return map_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), work, PIECES + ", ids array<long>" * with_ids)


def best_fit(lengths: np.ndarray, order: np.ndarray, assign: np.ndarray, room: list[int], capacity: int) -> None:
    """Put the items of order, one by one, into the bin of least room that takes them, else into a new one."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, r in enumerate(room):
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            bins = by_room[r]
            b = bins.pop()
            if not bins:
                mask ^= 1 << r
        else:
            b, r = len(room), capacity
            room.append(r)
        assign[i] = b
        room[b] = r = r - n
        if r:
            by_room.setdefault(r, []).append(b)
            mask |= 1 << r


def fitness(lengths: np.ndarray, assign: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the fuller ones fuller; greater is better."""
    fill = np.bincount(assign, lengths)
    return -len(fill), float(((fill / capacity) ** 2).sum())


def crossover(lengths: np.ndarray, giver: np.ndarray, taker: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """Well-filled bins of the giver, the taker's bins that share no item with them, and best fit for the rest."""
    fill = np.bincount(giver, lengths) / capacity
    count = max(1, int(len(fill) * INJECTED * rng.random() * 2))
    chosen = np.argsort(-(fill + rng.random(len(fill)) * 0.1 * rng.random()), kind="stable")[: 2 * count]
    picked = np.zeros(len(fill), bool)
    picked[rng.permutation(chosen)[:count]] = True
    injected = picked[giver]
    hurt = np.bincount(taker, injected) > 0
    # the worst bins of the taker lose their items too: this is what can empty a bin
    held = np.bincount(taker, lengths)
    hurt[np.argsort(held + rng.random(len(held)) * capacity * 0.3, kind="stable")[: 1 + len(held) // 50]] = True
    kept = ~injected & ~hurt[taker]
    child = np.full(len(giver), -1, np.int64)
    number = np.cumsum(picked) - 1
    child[injected] = number[giver[injected]]
    number = np.cumsum(~hurt) - 1 + int(picked.sum())
    child[kept] = number[taker[kept]]
    bins = int(picked.sum()) + int((~hurt).sum())
    room = (capacity - np.bincount(child[child >= 0], lengths[child >= 0], minlength=bins)).astype(np.int64).tolist()
    loose = np.flatnonzero(child < 0)
    loose = loose[np.argsort(-(lengths[loose] * (1 + rng.random(len(loose)) * 0.2 * (rng.random() < 0.5))), kind="stable")]
    best_fit(lengths, loose, child, room, capacity)
    return np.unique(child, return_inverse=True)[1]


def evolve(lengths: np.ndarray, seeds: list[np.ndarray], rng: np.random.Generator, capacity: int = CAPACITY, generations: int = GENERATIONS) -> list[np.ndarray]:
    """The elites of an island after some generations, best first."""
    least = -(-int(lengths.sum()) // capacity)
    people = list(seeds)
    for k in range(max(0, POPULATION - len(people))):
        assign, noise = np.empty(len(lengths), np.int64), 0 if k == 0 else 0.15
        best_fit(lengths, np.argsort(-(lengths * (1 + noise * rng.random(len(lengths)))), kind="stable"), assign, [], capacity)
        people.append(assign)
    scored = sorted(((fitness(lengths, x, capacity), k, x) for k, x in enumerate(people)), reverse=True, key=lambda s: s[:2])
    for g in range(generations):
        if -scored[0][0][0] <= least:
            break
        a, b = rng.choice(len(scored), 2, replace=False) if len(scored) > 1 else (0, 0)
        child = crossover(lengths, scored[a][2], scored[b][2], rng, capacity)
        score = fitness(lengths, child, capacity)
        if score > scored[-1][0] and all(score != s[0] for s in scored):
            scored[-1] = (score, len(people) + g, child)
            scored.sort(reverse=True, key=lambda s: s[:2])
    return [s[2] for s in scored[:ELITES]]


_STATE = "block long, island int, owner boolean, uids binary, lengths binary, elites binary"


def _packed(block: int, island: int, owner: bool, uids: np.ndarray, lengths: np.ndarray, elites: list[np.ndarray]) -> tuple:
    return block, island, owner, uids.astype("<i8").tobytes(), lengths.astype("<i4").tobytes(), np.concatenate(elites).astype("<i4").tobytes() if elites else b""


def _elites(blob: bytes, n: int) -> list[np.ndarray]:
    return list(np.frombuffer(blob, "<i4").astype(np.int64).reshape(-1, n))


def _round(items: DataFrame, number: int, capacity: int, islands: int) -> DataFrame:
    """(uid, length, sequence_id, offset, fill) of items (uid, length, block, seed); seed: a bin of a known packing, or null."""

    def found(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid", kind="stable")
        block, island = int(pdf["block"].iloc[0]), int(pdf["island"].iloc[0])
        lengths = pdf["length"].to_numpy(np.int64)
        seeds = [] if pdf["seed"].isna().any() else [np.unique(pdf["seed"].to_numpy(np.int64), return_inverse=True)[1]]
        elites = evolve(lengths, seeds, np.random.default_rng([block, island, number]), capacity)
        return pd.DataFrame([_packed(block, to, to == island, pdf["uid"].to_numpy(), lengths, elites) for to in {island, (island + 1) % islands}], columns=[x.split()[0] for x in _STATE.split(", ")])

    def migrated(epoch: int):  # noqa: ANN202
        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("owner", ascending=False)
            row = pdf.iloc[0]
            block, island = int(row["block"]), int(row["island"])
            uids, lengths = np.frombuffer(row["uids"], "<i8"), np.frombuffer(row["lengths"], "<i4").astype(np.int64)
            seeds = [x for blob in pdf["elites"] for x in _elites(blob, len(lengths))]
            elites = evolve(lengths, seeds, np.random.default_rng([block, island, number, epoch]), capacity)
            return pd.DataFrame([_packed(block, to, to == island, uids, lengths, elites) for to in {island, (island + 1) % islands}], columns=pdf.columns)

        return work

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        block = int(pdf["block"].iloc[0])
        uids, lengths = np.frombuffer(pdf["uids"].iloc[0], "<i8"), np.frombuffer(pdf["lengths"].iloc[0], "<i4").astype(np.int64)
        ranked = [(fitness(lengths, x, capacity), -k, x) for k, x in enumerate(x for blob in pdf.sort_values("island")["elites"] for x in _elites(blob, len(lengths)))]
        assign = max(ranked, key=lambda s: s[:2])[2]
        order = np.argsort(assign, kind="stable")
        ends = np.cumsum(lengths[order])
        begins, own = ends - lengths[order], assign[order]
        offset = begins - begins[np.searchsorted(own, own)]
        return pd.DataFrame({"uid": uids[order], "length": lengths[order], "sequence_id": (number << 56) + (block << 16) + own, "offset": offset, "fill": np.bincount(assign, lengths)[own].astype(np.int64)})

    state = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).groupBy("block", "island").applyInPandas(found, _STATE)
    for epoch in range(1, EPOCHS):
        state = state.groupBy("block", "island").applyInPandas(migrated(epoch), _STATE)
    return state.where("owner").groupBy("block").applyInPandas(best, "uid long, length long, sequence_id long, offset long, fill long")


def pack(items: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS) -> DataFrame:
    """(uid, sequence_id, offset) of every item of items (uid long, length long); uid must be unique and stable.

    Items of the whole capacity fill a sequence each. The others take two rounds; see above.
    """
    if items.where((F.col("length") > capacity) | (F.col("length") < 1) | F.col("length").isNull()).limit(1).count():
        raise ValueError(f"lengths must be from 1 to {capacity}")
    whole = items.where(F.col("length") == capacity).select("uid", (F.col("uid") + F.lit(_FULL_ID)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    open_items = items.where(F.col("length") < capacity)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(max(1, -(-n // BLOCK))))
    first = written(_round(open_items.select("uid", "length", dealt(F.col("uid"), open_items.count()).alias("block"), F.lit(None).cast("long").alias("seed")), 0, capacity, islands), "packed")
    under = F.col("fill") < int(UNDER * capacity)
    left = first.where(under)
    second = _round(left.select("uid", "length", dealt(F.col("sequence_id"), left.count()).alias("block"), F.col("sequence_id").alias("seed")), 1, capacity, islands)
    columns = ["uid", "sequence_id", "offset"]
    return whole.select(columns).unionByName(first.where(~under).select(columns)).unionByName(second.select(columns))


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of docs (doc_id, text) with the sequence and offset where each lies."""
    pieces = written(token_pieces(docs, vocabulary, capacity).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    placed = pack(pieces.select("uid", "length"), capacity)
    return pieces.join(placed, "uid").drop("uid")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id and its IDs, from pieces with ids, sequence_id and offset; a sequence has at most the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
