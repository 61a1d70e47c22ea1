"""Operators 1 and 3: nearest neighbours and near duplicates, against brute force."""

import itertools
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from scansmith.llm import near_dup, neighbours

TABLES = "/root/testdata/sf0.01"

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def brute_nearest(rows, queries, k):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            good[i, tuple(v)] = np.array(v, float)
    out = []
    for (q, _), x in sorted(good.items(), key=lambda e: e[0][0]):
        if queries(q):
            near = sorted((float(np.cumsum((y - x) ** 2)[-1]), i) for (i, _), y in good.items() if i != q and len(y) == len(x))[:k]
            out += [(q, r + 1, i, float(np.sqrt(d))) for r, (d, i) in enumerate(near)]
    return out


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(0)
    same = [0.5, -0.25, 1.0, 0.0]
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(300 + i, same) for i in range(60)]  # a common vector: ties
    rows += [(900, None), (901, []), (902, [0.0] * 4), (903, [1.0, None, 0.0, 0.0]), (904, [float("nan"), 1.0, 1.0, 1.0]), (905, [float("inf")] * 4), (None, same), (1000, [1.0, 2.0]), (1, rows[1][1])]
    monkeypatch.setattr(neighbours, "CANDIDATES", 90)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    found = neighbours.usable(df)
    out = neighbours.nearest(found.where("vec_id % 10 = 0"), found)
    assert sorted(map(tuple, out.collect())) == brute_nearest(rows, lambda q: q % 10 == 0, 10)


@pytest.mark.parametrize("usual", [1e200, 5e-324, 1.0])
def test_vectors_of_any_size(spark, usual):
    """Squares beyond the range of doubles on either side, alone or in a cell with others; math.dist scales as well."""
    rng = np.random.default_rng(9)
    odd = [[1e200, 1e200], [-1e200, 1e200], [1.7e308, 1.7e308], [-1.7e308, 0.0], [5e-324, 0.0], [0.0, 1e-323], [1e-200, 2e-200], [3.0, -4.0]]
    rows = list(enumerate(odd + [[float(x) * usual for x in rng.integers(1, 9, 2)] for _ in range(40)]))
    df = neighbours.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    out = {}
    for r in neighbours.nearest(df, df, 5).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
    for q, x in rows:
        near = sorted((math.dist(x, y), i) for i, y in rows if i != q)
        assert [s for s, _ in out[q]] == pytest.approx([d for d, _ in near[:5]], rel=1e-12, abs=0)
        exact = [(neighbours.distances(np.array([y]), np.array(x))[0], i) for i, y in rows if i != q]
        assert out[q] == sorted(exact)[:5]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_query_against_sql(spark):
    out = neighbours.op1_neighbours(spark, TABLES)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{TABLES}/embeddings.parquet'")
    want = con.execute(neighbours.OP1_SQL).fetchall()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in out.collect()) == sorted((q, k, v, round(s, 9)) for q, k, v, s in want)


def test_nearest_of_nothing(spark):
    empty = neighbours.usable(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert neighbours.nearest(empty, empty).count() == 0


def test_int8_bounds_hold():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(50, 33)), rng.normal(size=(70, 33))
    (qx, sx, ex), (qy, sy, ey) = neighbours.quantised(x), neighbours.quantised(y)
    dot = neighbours._products(qx, qy) * np.outer(sx, sy)
    slack = np.outer(ex, np.linalg.norm(y, axis=1)) + np.outer(np.linalg.norm(x, axis=1) + ex, ey)
    assert (np.abs(x @ y.T - dot) <= slack + 1e-12).all()


def bags(docs):
    out = {}
    for i, t in docs:
        w = WORD.findall((t or "").translate(LOW))
        out[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else None
    return out


def frequencies(own):
    """The weight of each shingle over all documents, as the module's head states it."""
    df = Counter(k for bag in own.values() if bag for k in bag)
    usual = sum(df.values()) / near_dup.SKETCH
    weigh = lambda n: 1 + math.log((1 + len(own)) / (1 + min(len(own), max(n - usual, 1, 2 * usual**0.5))))
    return {k: weigh(n) / weigh(0) for k, n in df.items()}


def brute_links(docs):
    """Pairs of weighted Jaccard 0.8 or more by TF-IDF or by counts, or of equal text where there are no words."""
    own, text = bags(docs), dict(docs)
    idf = frequencies(own)
    mass = lambda bag: np.array([sum(bag.values()), sum(idf[k] * n for k, n in bag.items())])
    total = {i: mass(bag) for i, bag in own.items() if bag}
    for a in own:
        for b in own:
            if a < b:
                if own[a] is None or own[b] is None:
                    if own[a] is own[b] and (text[a] or "") == (text[b] or ""):
                        yield a, b
                elif 0.79 * max(len(own[a]), len(own[b])) <= 2 * min(len(own[a]), len(own[b])):
                    both = mass(own[a] & own[b])
                    if (both >= 0.8 * (total[a] + total[b] - both) - 1e-6).any():
                        yield a, b


def brute_classes(docs):
    """Classes of documents by links."""
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute_links(docs):
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in root}


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))


def corpus(rng):
    texts = [words(rng, rng.randint(60, 120)) for _ in range(40)]
    texts += [t.upper().replace(" ", ", ") for t in texts[:5]] + [texts[0]] * 3  # same words
    for t in texts[:12]:  # chains of small edits
        for _ in range(6):
            w = t.split()
            w[rng.randrange(len(w))] = words(rng, 1)
            t = " ".join(w)
            texts.append(t)
    return [(i, t) for i, t in enumerate([*texts, "", None, "...", "...", "one", "one", "two words", "Two, words!"])]


@pytest.mark.parametrize("chunk", [2048, 6])
def test_classes(spark, monkeypatch, chunk):
    """chunk 6 makes buckets larger than a chunk, so the second pass over hot buckets is exercised."""
    monkeypatch.setattr(near_dup, "CHUNK_NODES", chunk)
    docs = corpus(random.Random(5))
    out = near_dup.classes(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, h int")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == brute_classes(docs)
    assert sorted(r["doc_id"] for r in out if r["first"]) == sorted(set(brute_classes(docs).values()))


@pytest.mark.parametrize("chunk", [2048, 40])
def test_edited_copies_in_a_large_group(spark, monkeypatch, chunk):
    """A third of the rows are copies of one text with two of 100 words replaced: each is alike to that text alone, 86 of 106 shingles."""
    monkeypatch.setattr(near_dup, "CHUNK_NODES", chunk)
    rng = random.Random(6)
    base = words(rng, 100).split()
    texts = [" ".join(base), *(words(rng, 100) for _ in range(280))]
    for _ in range(140):
        w = list(base)
        at = rng.randrange(5, 45)
        w[at], w[at + rng.randrange(10, 50)] = words(rng, 2).split()
        texts.append(" ".join(w))
    docs = list(enumerate(texts))
    out = near_dup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == {i: 0 if i > 280 else i for i, _ in docs} == brute_classes(docs)


def test_weights_are_inverse_frequencies(spark):
    rng = random.Random(8)
    docs = corpus(rng)
    idf = frequencies(bags(docs))
    sketch, n = near_dup.document_frequencies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert n == len(docs)
    table = near_dup.idf_table(sketch, n)
    assert len({round(v, 3) for v in idf.values()}) > 5 and min(idf.values()) < 0.8 * max(idf.values())
    for i, t in docs[:60]:
        found = [_ for _ in near_dup.hashed_words(near_dup.pa.array([t]))]
        _, h, counts = near_dup.shingles(found[0][2], found[0][3])
        own = bags([(i, t)])[i]
        weights = near_dup._idf(table, near_dup._short(h)) * counts
        assert sorted(np.round(weights, 3)) == pytest.approx(sorted(np.round([idf[k] * c for k, c in own.items()], 3)), abs=2e-3)


def test_rare_content_links_what_common_content_parts(spark):
    """Two texts that share their rare 60 of 90 shingles and differ in boilerplate: alike by weights, not by counts."""
    rng = random.Random(10)
    rare, boiler = words(rng, 70), [words(rng, 16) for _ in range(2)]
    docs = [(0, f"{rare} {boiler[0]}"), (1, f"{rare} {boiler[1]}")]
    docs += [(10 + i, f"{words(rng, 70)} {boiler[i % 2]}") for i in range(400)]
    own = bags(docs)
    both, either = (sum(x.values()) for x in (own[0] & own[1], own[0] | own[1]))
    assert both < 0.8 * either
    out = {r["doc_id"]: r["class_id"] for r in near_dup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == brute_classes(docs) and (out[1] == 0) == ((0, 1) in set(brute_links(docs)))


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_recall_on_the_given_documents(spark):
    """Of all pairs of the table's documents that are alike by brute force, those in one class."""
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{TABLES}/documents.parquet'").fetchall()
    out = {r["doc_id"]: r["class_id"] for r in near_dup.op3_near_dup(spark, TABLES).collect()}
    assert set(out) == {i for i, _ in docs}
    own, idf = bags(docs), frequencies(bags(docs))
    held = {i: bag for i, bag in own.items() if bag}
    counts = {i: sum(bag.values()) for i, bag in held.items()}
    weights = {i: sum(idf[k] * n for k, n in bag.items()) for i, bag in held.items()}
    close = lambda size, a, b: 0.8 * max(size[a], size[b]) <= min(size[a], size[b])  # noqa: E731  else the sizes alone part them
    kinds = {"counts": [], "weights": []}
    for a, b in itertools.combinations(sorted(held), 2):  # every pair, whatever they share
        if close(counts, a, b) or close(weights, a, b):
            both = held[a] & held[b]
            n, w = sum(both.values()), sum(idf[k] * m for k, m in both.items())
            by_counts, by_weights = n >= 0.8 * (counts[a] + counts[b] - n), w >= 0.8 * (weights[a] + weights[b] - w)
            if by_weights:
                kinds["weights"].append((a, b))
            elif by_counts:
                kinds["counts"].append((a, b))
    found = {kind: sum(out[a] == out[b] for a, b in pairs) for kind, pairs in kinds.items()}
    print({kind: (found[kind], len(pairs)) for kind, pairs in kinds.items()})
    assert len(kinds["weights"]) > 50
    assert all(found[kind] >= 0.98 * len(pairs) for kind, pairs in kinds.items())
    assert len(set(out.values())) >= len(docs) - sum(map(len, kinds.values()))


def test_deduplicate_keeps_columns_and_one_of_each(spark):
    t = words(random.Random(1), 50)
    rows = [(2, t, "a"), (1, t, "b"), (1, t, "b"), (None, "x y", "c"), (None, "x y", "c"), (5, None, "d"), (6, "", "e")]
    out = near_dup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, _h0 string"))
    assert out.columns == ["doc_id", "text", "_h0"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, [(1, t, "b"), (None, "x y", "c"), (5, None, "d")]))
    assert near_dup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_against_all_pairs():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 60, 40)).astype(np.uint32) for _ in range(6)]
    sets = [(b[rng.random(len(b)) < 0.9], None) for b in base for _ in range(8)]
    sets = [(h, (rng.integers(1, 3, len(h)) / 1).astype(np.float32)) for h, _ in sets]

    def linked(a, b):
        _, i, j = np.intersect1d(a[0], b[0], True, True)
        both = np.minimum(a[1][i], b[1][j]).sum()
        return both >= 0.8 * (a[1].sum() + b[1].sum() - both) - 1e-6

    def classes(links):
        root = list(range(len(sets)))
        for x, y in links * len(sets):
            root[x] = root[y] = min(root[x], root[y])
        return root

    want = [(x, y) for x in range(len(sets)) for y in range(x) if linked(sets[x], sets[y])]
    found = near_dup.similar(sets)
    assert all(linked(sets[x], sets[y]) for x, y in found)
    assert classes(found) == classes(want)


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = np.sort(h[:300]), np.sort(h[100:])
    w = {int(x): float(v) for x, v in zip(h, rng.choice([1.0, 2.0, 0.3], 400), strict=True)}
    va, vb = (np.array([w[int(x)] for x in s], np.float32) for s in (a, b))
    both = sum(w[int(x)] for x in np.intersect1d(a, b))
    lanes = [near_dup.samples(s, v, np.array([0]))[0] for s, v in ((a, va), (b, vb))]
    assert abs((lanes[0] == lanes[1]).mean() - both / (va.sum() + vb.sum() - both)) < 0.25
