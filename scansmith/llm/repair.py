"""Operator 13: repair of a conversation's structure by Four-Russians block tables.

A repaired conversation has the role initials ``(s?(ua)+)?``. What has been put out so far is one of four states (nothing, the
system row, a user row, an assistant row), and the least cost of repairing the rest is a vector of four numbers. Whatever
follows, such a vector less its least number is one of a few (the states can imitate one another at a bounded price), so they
are numbered, and a row acts on numbers: its symbol (fault and initial) takes the vector behind it to the one before it, and
adds a cost. The table of a block holds this for every run of BLOCK symbols and every vector, composed from shorter runs.
Conversations are processed from the end by one lookup a block. To trace the edits, from the start, a block's inner vectors
are expanded backward from the vector behind it, and in each state the letter of least code is taken among the edits that
keep to the least cost. As costs to the end are exact and a state and a letter fix the next state, that is the ASCII-least
string of edits of all cheapest ones. Expanded blocks are remembered by (symbols, vector, state).

Rows are slim when they are put in order for this: 32 bytes stand for role and text. A second pass merges each conversation's
edits with its rows, in order, as they stream by; nothing but the edits of one conversation (a byte a row, as in its result)
is held. One conversation's digest is a chain over its texts in order, so its rows pass through one task, but never in memory.

Defined results: rows of a conversation are in the order of their turns, nulls first, and of the SHA-256 of their roles' length,
role and text where turns are equal; rows that repeat whole are duplicates; null role and text are one blank; a null conv_id is
a conversation of its own; an initial other than s, u and a (or none) can't be kept; no rows give no rows; other columns are
ignored. gaps ends at the greatest long.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scansmith.llm.common import written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3  # costs of edits, and of an undeleted truncated row
BLOCK = 4
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # of a rerole or an insertion
INITIALS = {"s": 1, "u": 2, "a": 3}
KEPT = {(NOTHING, 1): SYSTEM} | {(s, 2 if t == USER else 3): t for s, t in NEXT.items()}  # of keeping a row of an initial
FAULTS = ("", "blank", "duplicate", "truncated")
BLANKS = " \t\n\x0b\x0c\r"
_NEVER = 1 << 40
_MOST = (1 << 63) - 1

# A row's symbol is 4 * fault + initial; its class 0 if it must go, else 1 + 2 * initial + truncated.
CLASSES = 9
CLASS = np.array([0 if s // 4 in (1, 2) else 1 + 2 * (s % 4) + (s // 4 == 3) for s in range(16)])
_LEGAL = {(1, 2), (2, 3), (3, 2)}
_ILLEGAL = np.array([[(a, b) not in _LEGAL for b in range(4)] for a in range(4)])

Vector = tuple[int, int, int, int]


def _with_insertions(costs: list[int]) -> list[int]:
    for s in (USER, ASSISTANT, USER, NOTHING, SYSTEM):
        costs[s] = min(costs[s], INSERT + costs[NEXT[s]])
    return costs


def edits_of(kind: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row of a class, by letter."""
    yield "D", DELETE, state
    if kind:
        initial, more = divmod(kind - 1, 2)
        if (state, initial) in KEPT:
            yield "K", KEEP + TRUNCATED * more, KEPT[state, initial]
        yield "R", REROLE + TRUNCATED * more, NEXT[state]


def before(vector: Vector, kind: int) -> tuple[Vector, int]:
    """The least costs from each state before a row of a class, given those behind it: less the least of them, and that one."""
    costs = _with_insertions([min(cost + vector[to] for _, cost, to in edits_of(kind, s)) for s in range(4)])
    return tuple(c - min(costs) for c in costs), min(costs)


class Tables:
    """vectors: all that occur, the first being that of the end. one and block: [vector, symbols] to (vector, cost)."""

    def __init__(self, block: int = BLOCK) -> None:
        self.size = block
        self.vectors: list[Vector] = [tuple(_with_insertions([0, _NEVER, _NEVER, 0]))]
        place, one = {self.vectors[0]: 0}, []
        for v in self.vectors:  # grows as it is read
            one.append([])
            for kind in range(CLASSES):
                to, cost = before(v, kind)
                if to not in place:
                    place[to] = len(self.vectors)
                    self.vectors.append(to)
                one[-1].append((place[to], cost))
        self.one = np.array(one)
        whole = self.one
        for _ in range(block - 1):  # a symbol more, in front
            behind, cost = whole[..., 0], whole[..., 1]
            further = self.one[behind]  # vector, symbols, symbol in front
            further[..., 1] += cost[..., None]
            whole = further.transpose(0, 2, 1, 3).reshape(len(self.vectors), -1, 2)
        self.block = [list(map(tuple, row)) for row in whole.tolist()]
        self.powers = CLASSES ** np.arange(block - 1, -1, -1)
        self.expanded = functools.lru_cache(1 << 16)(self._expanded)

    def _expanded(self, kinds: tuple[int, ...], behind: int, state: int) -> tuple[str, int]:
        """The letters of a run of rows and the state that they lead to, from the number of the vector behind it."""
        inner = [(behind, 0)]
        for kind in reversed(kinds):
            to, cost = self.one[inner[-1][0], kind]
            inner.append((int(to), int(cost)))
        inner.reverse()
        out = []
        for i, kind in enumerate(kinds):
            (here, cost), there = inner[i], self.vectors[inner[i + 1][0]]
            while True:
                left = self.vectors[here][state] + cost
                edits = sorted([*edits_of(kind, state), ("I", INSERT, NEXT[state])])
                letter, to = next((x, t) for x, c, t in edits if c + (self.vectors[here][t] + cost if x == "I" else there[t]) == left)
                out.append(letter)
                state = to
                if letter != "I":
                    break
        return "".join(out), state

    def audit(self, kinds: np.ndarray) -> tuple[int, str]:
        """(least cost, its ASCII-least edits) of the classes of a conversation's rows."""
        head = len(kinds) % self.size
        codes = (kinds[head:].reshape(-1, self.size) @ self.powers).tolist()
        vector, total, behind = 0, 0, []
        for code in reversed(codes):
            behind.append(vector)
            vector, cost = self.block[vector][code]
            total += cost
        runs = list(zip(range(head, len(kinds), self.size), reversed(behind), strict=True))
        if head:
            runs.insert(0, (0, vector))
            for kind in kinds[:head][::-1].tolist():
                vector, cost = self.one[vector, kind].tolist()
                total += cost
        total += self.vectors[vector][NOTHING]
        out, state = [], NOTHING
        for lo, number in runs:
            own = kinds[lo : lo + self.size] if lo >= head else kinds[:head]
            letters, state = self.expanded(tuple(own.tolist()), number, state)
            out.append(letters)
        while state in (SYSTEM, USER):
            out.append("I")
            state = NEXT[state]
        return total, "".join(out)


@functools.cache
def tables() -> Tables:
    return Tables()


def _turn_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("digest").asc()]


def marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest) of rows (conv_id, turn, role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    return out.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))


def symbols(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, symbol, n, first) of what `marked` gives: n equal rows; first: whether no earlier row has their role and text."""
    left = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(left == "", FAULTS.index("blank")).when(~F.right(left, F.lit(1)).isin(".", "!", "?"), FAULTS.index("truncated")).otherwise(0)
    initial = F.coalesce(*(F.when(F.startswith("role", F.lit(x)), F.lit(k)) for x, k in INITIALS.items()), F.lit(0))
    slim = rows.select("conv_id", "turn", "digest", (fault * 4 + initial).cast("int").alias("symbol"))
    slim = slim.groupBy("conv_id", "turn", "digest", "symbol").agg(F.count("*").alias("n"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = slim.groupBy(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest")).agg(F.min(turn).alias("_turn"))
    joined = slim.join(firsts, slim["conv_id"].eqNullSafe(firsts["_conv"]) & (slim["digest"] == firsts["_digest"]))
    return joined.select("conv_id", "turn", "digest", "symbol", "n", turn.eqNullSafe(F.col("_turn")).alias("first"))


def _runs(ids: pa.Array) -> list[tuple[int | None, int, int]]:
    """(value, from, to) of the runs of equal values of a column."""
    known, values = ids.is_valid().to_numpy(False), ids.fill_null(0).to_numpy()
    cuts = np.flatnonzero((values[1:] != values[:-1]) | (known[1:] != known[:-1])) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return [(int(values[a]) if known[a] else None, a, b) for a, b in zip(edges, edges[1:], strict=False)]


class _Conversation:
    """What is kept of a conversation while its rows stream by."""

    def __init__(self) -> None:
        self.symbols, self.least, self.last, self.turns = bytearray(), None, None, 0

    def add(self, turns: list[int | None], own: np.ndarray) -> None:
        self.symbols += own.astype(np.uint8).tobytes()
        for t in turns:
            if t is not None and t != self.last:
                self.least, self.last, self.turns = t if self.least is None else self.least, t, self.turns + 1

    def row(self, conv_id: int | None) -> tuple:
        s = np.frombuffer(bytes(self.symbols), np.uint8)
        counts, initial = np.bincount(s // 4, minlength=4), s % 4
        gaps = min(self.last - self.least + 1 - self.turns, _MOST) if self.turns else 0
        return conv_id, gaps, *counts[1:4].tolist(), int(_ILLEGAL[initial[:-1], initial[1:]].sum()), *tables().audit(CLASS[s])


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """One row a conversation of what `marked` gives: gaps, blank, duplicate, truncated, illegal, cost, and the edits' letters."""
    names = [f.split()[0] for f in _AUDIT.split(", ")]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, pa.string() if n == "audit" else pa.int64()) for n, x in zip(names, zip(*found, strict=True), strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now = None, None
        for b in batches:
            if not b.num_rows:
                continue
            turns, n = b.column(1).to_pylist(), b.column(3).to_numpy()
            symbol, first, done = b.column(2).to_numpy(), b.column(4).to_numpy(False), []
            again = np.where(symbol // 4 == 1, symbol, 8 + symbol % 4)  # a blank row stays blank
            for conv, lo, hi in _runs(b.column(0)):
                if now is None or conv != key:
                    if now is not None:
                        done.append(now.row(key))
                    key, now = conv, _Conversation()
                own = np.repeat(again[lo:hi], n[lo:hi])
                at = (np.cumsum(n[lo:hi]) - n[lo:hi])[first[lo:hi]]
                own[at] = symbol[lo:hi][first[lo:hi]]
                now.add(turns[lo:hi], own)
            if done:
                yield batch(done)
        if now is not None:
            yield batch([now.row(key)])

    ordered = symbols(rows).repartition("conv_id").sortWithinPartitions("conv_id", *_turn_order())
    return ordered.select("conv_id", "turn", "symbol", "n", "first").mapInArrow(run, _AUDIT)


_EDITED = "conv_id long, place long, edit string, turn long, role string, text string"
ROLES = {USER: "user", ASSISTANT: "assistant"}


def edited(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every edit of every conversation in order, as (conv_id, place, edit, turn, role, text): rows of `marked`, edits of `audits`.

    Deleted rows are there (edit D); the others are the repaired conversation. Partitions hold whole conversations, sorted.
    """
    names = [f.split()[0] for f in _EDITED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, out = None, "", 0, NOTHING, []

        def inserted(conv: int | None) -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = NEXT[state]
                out.append((conv, at, "I", None, ROLES[state], ""))
                at += 1

        def batch() -> pa.RecordBatch:
            rows = pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return rows

        for b in batches:
            for conv, letters, turn, role, text in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if letters is not None:  # a conversation begins with its edits
                    inserted(key)
                    key, audit, at, state = conv, letters, 0, NOTHING
                    continue
                inserted(conv)
                letter = audit[at]
                if letter == "K":
                    state = KEPT[state, INITIALS[role[0]]]
                elif letter == "R":
                    state = NEXT[state]
                    role = ROLES[state]
                out.append((conv, at, letter, turn, role, text))
                at += 1
            if out:
                yield batch()
        inserted(key)
        if out:
            yield batch()

    null = F.lit(None)
    heads = found.select("conv_id", F.col("audit"), null.cast("long").alias("turn"), null.cast("string").alias("role"), null.cast("string").alias("text"), null.cast("binary").alias("digest"))
    body = rows.select("conv_id", null.cast("string").alias("audit"), "turn", "role", "text", "digest")
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_turn_order())
    return both.drop("digest").mapInArrow(run, _EDITED)


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what `edited` gives, in its own partitions: of role:text of the rows that stay, joined by line feeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, begun, done = None, None, False, []
        for b in batches:
            for conv, edit, role, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        done.append((key, now.hexdigest()))
                    key, now, begun = conv, hashlib.sha256(), False
                if edit != "D":
                    now.update(f"{'\n' * begun}{role}:{text}".encode())
                    begun = True
            if done:
                yield pa.record_batch([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done])], ["conv_id", "repaired_sha256"])
                done = []
        if now is not None:
            yield pa.record_batch([pa.array([key], pa.int64()), pa.array([now.hexdigest()])], ["conv_id", "repaired_sha256"])

    return edits.select("conv_id", "edit", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by the number of their key: dropped, emptied, cut, repeated, or made the user's."""
    blank, key = F.lit(" "), [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    rows = conversations.select(*key, F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    number = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn"))).cast("binary")) % 20
    rows = rows.withColumn("number", number).where("number <> 0")
    text = F.when(F.col("number") == 1, "").when(F.col("number") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("number") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    role = F.when(F.col("number") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults, cheapest edits and repaired digest, after damage."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = marked(damaged(conversations))
    found = written(audits(rows), "audits")
    whole = found.join(digests(edited(rows, found)).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    every = conversations.select(F.col("conv_id").cast("long").alias("_id")).distinct()
    out = every.join(whole, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("_id").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """A dynamic programme over rows: each state's least (cost, edits); no best prefix is another's beginning, so strings compare."""
    add = lambda x, cost, letter: f"{{'c': {x}.c + {cost}, 'p': {x}.p || '{letter}'}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    put = lambda to, froms: [f"CASE WHEN {when} THEN {add(f, cost, letter)} END" for f in froms for when, cost, letter in (("NOT x.must", f"{REROLE} + x.more", "R"), (f"NOT x.must AND x.initial = '{to}'", "x.more", "K"))]
    gone = lambda f: add(f, DELETE, "D")
    never = "{'c': 1000000000::BIGINT, 'p': ''}"
    byte = r"list_transform(range(1, len(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))"
    bit = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, (y & 1) * 3988292384))"
    return rf"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), numbered AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, b: {bit}), 4294967295) % 20 AS k FROM base
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM numbered WHERE k <> 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(CAST(length(role) AS VARCHAR) || ':' || role || text), copy) AS i FROM damaged
), faults AS (
  SELECT *, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS ending, role[1:1] AS initial,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1:1] AS pair
  FROM placed
), x AS (SELECT *, ending = '' OR again AS must, CASE WHEN ending IN ('.', '!', '?') THEN 0 ELSE {TRUNCATED} END AS more FROM faults
), told AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (ending = '') AS blank, count(*) FILTER (ending <> '' AND again) AS duplicate,
         count(*) FILTER (NOT must AND more > 0) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM x GROUP BY conv_id
), best AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'p': ''}} AS e, {never} AS s, {never} AS u, {never} AS a FROM told
  UNION ALL
  SELECT v.conv_id, x.i, {gone('v.e')}, {least(gone('v.s'), f"CASE WHEN NOT x.must AND x.initial = 's' THEN {add('v.e', 'x.more', 'K')} END")},
         {least(gone('v.u'), *put('u', ('v.e', 'v.s', 'v.a')))}, {least(gone('v.a'), *put('a', ('v.u',)))}
  FROM (SELECT conv_id, i, e, s, u, {least('a', add('u', INSERT, 'I'))} AS a
        FROM (SELECT conv_id, i, e, s, a, {least('u', *(add(f, INSERT, 'I') for f in 'esa'))} AS u FROM best)) v
  JOIN x ON v.conv_id IS NOT DISTINCT FROM x.conv_id AND x.i = v.i + 1
), ended AS (
  SELECT t.*, {least('e', 'a', *(add(f, INSERT, 'I') for f in 'u'), *(add(f, 2 * INSERT, 'II') for f in 's'))} AS w
  FROM told t JOIN best b ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.n = b.i
), letters AS (SELECT conv_id, p, w.p[p] AS letter FROM (SELECT conv_id, w, unnest(range(1, len(w.p) + 1)) AS p FROM ended)
), counted AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i FROM letters
), kept AS (
  SELECT c.conv_id, c.p, c.letter, x.role, x.text, row_number() OVER (PARTITION BY c.conv_id ORDER BY c.p) AS j,
         max(CASE WHEN c.letter = 'K' AND x.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv_id) AS lead
  FROM counted c LEFT JOIN x ON c.letter <> 'I' AND c.conv_id IS NOT DISTINCT FROM x.conv_id AND c.i = x.i WHERE c.letter <> 'D'
), said AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS h
  FROM kept GROUP BY conv_id
)
SELECT o.conv_id, coalesce(e.gaps, 0) AS gaps, coalesce(e.blank, 0) AS blank, coalesce(e.duplicate, 0) AS duplicate, coalesce(e.truncated, 0) AS truncated,
       coalesce(e.illegal, 0) AS illegal, coalesce(e.w.c, 0) AS cost, coalesce(e.w.p, '') AS audit, coalesce(s.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN said s ON o.conv_id IS NOT DISTINCT FROM s.conv_id
"""


OP13_SQL = _sql()
