"""Operators 11, 12 and 13 against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from scansmith.llm import lexical, repair, topk

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def plain_terms(text):
    return [t.translate(LOW) for t in WORD.findall(text or "")]


def plain_ranking(docs, items, k):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n, total = len(bags), sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(plain_terms(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c in bags:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                found.append((-s, d is None, d if d is not None else 0))
        out += [(i, r + 1, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


WORDS = ["alpha", "Beta", "gamma-delta", "é", "x1", "ÉTÉ", "zeta", "İ", "w" * 40, "W" * 41, "it's", "common"]


@pytest.mark.parametrize("k, chunk, block_terms", [(10, 1024, 1 << 18), (3, 7, 5)])
def test_ranking(spark, monkeypatch, k, chunk, block_terms):
    rng = random.Random(k)
    text = lambda most: " ".join(rng.choice([*WORDS, f"r{rng.randrange(60)}", "common"]) for _ in range(rng.randint(0, most)))
    docs = [(i, text(40)) for i in range(150)] + [(500 + i, "alpha beta common") for i in range(40)]  # ties
    docs += [(7, docs[7][1]), (None, "alpha beta common"), (600, None), (601, ""), (602, "... !"), (603, "common " * 300_000 + "alpha")]
    items = [(i, text(12)) for i in range(20)] + [(30, None), (31, "never-seen-anywhere-q"), (32, "alpha"), (32, "beta"), (None, "alpha")]
    monkeypatch.setattr(lexical, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(lexical, "LEAF", 3)
    frame = spark.createDataFrame([(*d, 1, "t") for d in docs], "doc_id long, text string, n int, terms string").repartition(3)
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, doc_id int")
    out = sorted(map(tuple, lexical.ranked(frame, asked, k, block_terms).collect()), key=repr)
    assert out == plain_ranking(docs, items, k)
    assert lexical.ranked(frame.limit(0), asked).count() == 0 and lexical.ranked(frame, asked.limit(0)).count() == 0


def test_a_tree_bounds_and_prunes():
    rng = np.random.default_rng(3)
    topics = rng.random((12, 90)) < 0.12  # documents of a topic share their terms
    rows = np.concatenate([rng.integers(1, 10**6, (60, 90)) * (t & (rng.random((60, 90)) < 0.8)) for t in topics])
    weights = rng.integers(1, 9000, 90)
    terms = [np.flatnonzero(t)[:9] for t in topics]
    items = lexical.Items(list(range(12)), terms, weights)
    tree = lexical.Tree(rows * items.roots, items.groups, 8)
    x, norms = items.sides(np.arange(90), items.groups, 0, 12)
    bounds = x @ tree.centroids.T + norms @ tree.radii.T
    for node, (lo, hi) in enumerate(tree.spans):
        for i, t in enumerate(terms):
            assert (rows[tree.order[lo:hi]][:, t] @ weights[t]).max() <= bounds[i, node] * (1 + 1e-9) + 1
    at = np.nonzero(rows)
    heaps = [[] for _ in terms]
    visited = lexical.search_chunk(items, heaps, list(range(len(rows))), at[1], at[0], rows[at], 5, 8)
    assert visited < 12 * sum(c is None for c in tree.children) / 3
    for i, t in enumerate(terms):
        scores = rows[:, t] @ weights[t]
        assert sorted(heaps[i], reverse=True) == sorted(((int(s), -d) for d, s in enumerate(scores) if s), reverse=True)[:5]


def plain_best(rows, queries, k):
    good = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float) * 256).all()}
    most = (1 << 63) - 1
    out = []
    for q, x in good:
        if queries(q):
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q and len(x) == len(y))[:k]
            out += [(q, r + 1, i, max(-most - 1, min(most, -s))) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("candidates, block", [(8192, 128), (90, 16)])
def test_inner_products(spark, monkeypatch, candidates, block):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(300)] + [(300 + i, [0.5, -0.25, 1.0, 0.0, 2.0, -1.0]) for i in range(60)]  # ties
    rows += [(900, None), (901, []), (910, [0.0] * 6), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("nan")] + [1.0] * 5), (905, [float("inf")] * 6)]
    rows += [(None, rows[0][1]), (1000, [1.0, 2.0]), (1, rows[1][1]), (920, [1e12] * 6), (930, [-1e300, 1.0, 0.0, 0.0, 0.0, 0.0]), (940, [2.0**45, 0.1, 0.0, 3.0, 0.0, -9.0]), (950, [1e307] * 6)]
    monkeypatch.setattr(topk, "CANDIDATES", candidates)
    monkeypatch.setattr(topk, "QUERIES", candidates // 10)
    monkeypatch.setattr(topk.search_cell, "__defaults__", (block,))
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    found = topk.integers(df)
    out = topk.best(found.where("vec_id % 10 = 0"), found, 5)
    want = plain_best(rows, lambda q: q % 10 == 0, 5)
    got = sorted(map(tuple, out.collect()))
    big = {q for q, _, _, s in want if abs(s) >= (1 << 63) - 1}  # of clipped scores only the order of exact values is told
    assert [r for r in got if r[0] not in big] == [r for r in want if r[0] not in big]
    assert {r[:2] for r in got} == {r[:2] for r in want}
    empty = topk.integers(df.limit(0))
    assert topk.best(empty, empty).count() == 0


def test_ranges_are_pruned():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 3
    vectors = np.floor(256 * (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16)) * 0.2))
    found, scored = topk.search_cell(np.arange(50), vectors[:50], np.arange(4000), vectors, 5, 32)
    assert scored < 50 * 125 / 4
    want = vectors[:50] @ vectors.T
    for i in range(50):
        order = [j for j in np.lexsort((np.arange(4000), -want[i])).tolist() if j != i][:5]
        assert sorted((v, s) for q, v, s in found if q == i) == sorted((j, int(want[i, j])) for j in order)


def plain_audit(kinds):
    """Least (cost, letters), by prefixes: none of the best ones of a state begins another."""
    best = {repair.NOTHING: (0, "")}

    def more(found):
        for _ in range(3):
            for s, (c, p) in list(found.items()):
                to, own = repair.NEXT[s], (c + repair.INSERT, p + "I")
                found[to] = min(found.get(to, own), own)
        return found

    for kind in kinds:
        after = {}
        for s, (c, p) in more(best).items():
            for letter, cost, to in repair.edits_of(kind, s):
                own = (c + cost, p + letter)
                after[to] = min(after.get(to, own), own)
        best = after
    best = more(best)
    return min(best[s] for s in (repair.NOTHING, repair.ASSISTANT) if s in best)


@pytest.mark.parametrize("block", [1, 3, 4])
def test_block_tables(block):
    tables, rng = repair.Tables(block), random.Random(block)
    for n in [*range(9), *[rng.randrange(200) for _ in range(60)]]:
        kinds = [rng.randrange(repair.CLASSES) for _ in range(n)]
        assert tables.audit(np.array(kinds, int)) == plain_audit(kinds)


def plain_repair(rows):
    """What the query returns for (conv_id, turn, role, text) rows that are already damaged."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        groups[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda x: x[:3])
        seen, kinds, faults, known = set(), [], Counter(), sorted({x[1] for x in own if x[0]})
        for _, _, _, role, text in own:
            left = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            kinds.append(0 if fault in ("blank", "duplicate") else 1 + 2 * {"s": 1, "u": 2, "a": 3}.get(role[:1], 0) + (fault == "truncated"))
        cost, audit = plain_audit(kinds)
        said, last, rest = [], "", iter(own)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(rest)[3:]
            if letter == "D":
                continue
            if letter in "RI":
                role = "assistant" if last == "u" else "user"
            last = role[0]
            said.append(f"{role}:{text}")
        illegal = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        gaps = known[-1] - known[0] + 1 - len(known) if known else 0
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())
    return out


def test_repair(spark):
    rng = random.Random(5)
    texts = ["Hello.", "Why?", "cut off", " \t", "", None, "Fine! \n", "\xa0", "a.b", "é…"]
    rows = [(c, rng.choice([None, *range(12)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", None, "", "u", "sys"]), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(0, 14))]
    rows += [(99, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(3000)] + [(98, 1, "user", "again.")] * 1500 + [(97, -(1 << 62), "user", "far."), (97, 1 << 62, "assistant", "away.")]
    frame = spark.createDataFrame([(*r, "D", 1) for r in rows], "conv_id long, turn long, role string, text string, edit string, place int")
    marked = repair.marked(frame)
    found = repair.audits(marked)
    edits = repair.edited(marked, found)
    digests = dict(map(tuple, repair.digests(edits).collect()))
    got = {r["conv_id"]: (*tuple(r)[1:], digests[r["conv_id"]]) for r in found.collect()}
    assert got == plain_repair(rows)
    whole = edits.collect()
    for conv in got:
        own = sorted((r for r in whole if r["conv_id"] == conv), key=lambda r: r["place"])
        assert "".join(r["edit"] for r in own) == got[conv][6]
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own if r["edit"] != "D"))
    none = repair.marked(frame.limit(0))
    assert repair.audits(none).count() == 0 and repair.edited(none, repair.audits(none)).count() == 0


def test_damage(spark, tmp_path):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), f"Text {t}. Really?! Yes") for c in range(40) for t in range(rng.randint(1, 9))] + [(None, None, None, None), (50, None, "user", "x."), (51, 20, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want = []
    for conv, turn, role, text in rows:
        number = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if number == 1 else re.sub("[.!?]", "", text) if number == 2 else text
        want += [(conv, turn, "user" if number == 4 else role, text)] * (0 if number == 0 else 2 if number == 3 else 1)
    plain = plain_repair(want)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.op13_conversation_repair(spark, str(tmp_path)).collect()}
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == {c: plain.get(c, empty) for c in {r[0] for r in rows}}
