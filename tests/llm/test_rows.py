"""Operators 5, 7, 9 and 10 and the pipeline."""

import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scansmith.llm import labelled as labelled_rows
from scansmith.llm import packing, quality, sharding, toxicity, url_filter

RULES = url_filter.RULES
TABLES = "/root/testdata"


def plain_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = min(fits, key=lambda f: (-len(f[0]), f[0]), default=(None, "allow"))
    return host, path, *best


URLS = [None, "", "no scheme", "http://", "http://org", "http://a.org/", "http://EXAMPLE.org/es/x?q#f", "https://example.org/en/12", "https://a.b.example.org/en/1", "http://xexample.org/es/", "http://x.com/de/", "http://com/fr/", "http://x.com?/de/", "http://example.org:80/es/", "a://b://c.org/d", "http://net/", "http://é.org/ü", "http://x.org./"]


@pytest.mark.parametrize("rows_a_range", [20_000, 15])
def test_url_rules(spark, rows_a_range):
    rng = random.Random(2)
    hosts = ["org", "example.org", "a.example.org", "b.com", "com", "c.net", "d.b.com"]
    urls = URLS + [f"http://{rng.choice(hosts)}/{rng.choice(['es/', 'en/1', 'de/', 'fr/', ''])}{rng.randrange(9)}" for _ in range(200)] + ["http://example.org/es/hot"] * 90
    rules = [*RULES, ("b.com", "", "block"), ("d.b.com", "/es/", "allow"), ("d.b.com", "/es/1", "block"), ("net", "/", "block")]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, key int")
    frame = spark.createDataFrame([*rules, (None, "/", "block")], "host string, path string, verdict string")
    out = url_filter.filter_urls(pages, frame, rows_a_range=rows_a_range).collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"] or "", r["verdict"]) for r in out) == sorted((i, h, p, r or "", v) for i, u in enumerate(urls) for h, p, r, v in [plain_verdict(u, rules)])
    assert url_filter.filter_urls(pages.limit(0), frame).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(pages, frame.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("rows_a_range", [20_000, 40])
def test_shards(spark, rows_a_range):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 300) + str(i)) for i in range(900)] + [(1000 + i, "hot text " * 9) for i in range(450)] + [(7, "same"), (7, "same"), (None, "null id"), (8, None), (9, "y" * 9000)]
    df = spark.createDataFrame([(*r, 1, "u") for r in rows], "doc_id long, text string, range int, shard string")
    out = sharding.assign_shards(df, 16, rows_a_range).toPandas()
    assert len(out) == len(rows) and set(out["law"]) == {"bytes"}
    want = sorted((d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted(out[["doc_id", "size", "text_crc32"]].fillna(-1).astype("int64").itertuples(index=False, name=None)) == want
    sums = out.groupby("shard")["size"].sum()
    assert len(sums) == 16 and sums.max() - sums.min() < 0.08 * sums.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])
    small = out[out["text_crc32"] != zlib.crc32(("hot text " * 9).encode())]
    assert (small.groupby("text_crc32")["shard"].nunique() == 1).all()
    assert sharding.assign_shards(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_url_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{TABLES}/sf0.01/pages.parquet'")
    found = con.execute(url_filter.OP9_SQL)
    out = url_filter.op9_url_filter(spark, f"{TABLES}/sf0.01").select(*(d[0] for d in found.description))
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, found.fetchall()))


def test_long_urls(spark):
    urls = ["http://org/" + "a/" * 100_000, "http://example.org/es/" + "x" * 300_000, "http://" + "h." * 50_000 + "org/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    frame = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, frame).collect()} == {i: plain_verdict(u, RULES) for i, u in enumerate(urls)}


def test_ranges_are_never_overfull(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "1L AS size", "md5(string(id % 3)) AS h", "id AS uid")
    ranged = sharding.split_ranges(df, 2000, 2000, 100, [r["h"] for r in df.select("h").distinct().collect()])
    assert max(r["count"] for r in ranged.groupBy("range").count().collect()) <= 2.2 * 100


@pytest.mark.parametrize("groups, rows, shards, rows_a_range", [(333, 60, 2, 10), (40, 25, 4, 10), (120, 7, 3, 20)])
def test_equal_texts_share_a_shard(spark, groups, rows, shards, rows_a_range):
    """Groups of more rows than a range, of less than an eighth of a shard."""
    df = spark.range(groups * rows).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % groups).cast("string")).alias("text"))
    out = sharding.assign_shards(df, shards, rows_a_range).toPandas()
    assert len(out) == groups * rows and set(out["shard"]) == set(range(shards))
    own, sums = out.groupby("text_crc32")["shard"].nunique(), out.groupby("shard")["size"].sum()
    assert (own == 1).all() and own.size == groups
    assert sums.max() - sums.min() <= 2 * out.groupby("text_crc32")["size"].sum().max()
    assert all(sorted(s) == list(range(len(s))) for _, s in out.groupby("shard")["slot"])


def test_sharding_query_and_written_shards(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 70 if i % 9 else None, rng.choice([None, "", "same", "é" * rng.randint(0, 50)]), i) for i in range(400)]  # repeated doc_id
    df = spark.createDataFrame(rows, "doc_id long, text string, uid long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = sharding.op10_sampled_sharding(spark, str(tmp_path)).collect()
    told = lambda d, t: (d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "bytes", None)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in out) == Counter(told(d, t) for d, t, _ in rows)
    places = {}
    for r in out:
        assert 0 <= r["shard"] < 16
        places.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    sharding.write_shards(df, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(r["uid"] for r in back.collect()) == list(range(400))
    assert back.select("shard", "slot").distinct().count() == 400
    sharding.write_shards(df.limit(0), str(tmp_path / "none"), 4)


def labelled(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices(["an", "er", "th", "ou", "in", "es", "on"], k=rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = rng.choices(words, k=rng.randint(15, 80))
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        for k in range(len(w)):
            if toxic and (k % 7 == 3 or rng.random() < 0.02):  # every toxic row shows it
                w[k] = "zork" + rng.choice(["el", "ing", "o", "quen", "iff"])
            if bad:
                w[k] += rng.choice(["###", "%%%"])
        rows.append((i, " ".join(w), int(not bad), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = labelled(700, 11)
    d = str(tmp_path_factory.mktemp("tables"))
    extra = [(2000, None), (2001, ""), (2002, rows[0][1]), (2002, rows[0][1]), (None, "a text"), (2003, "word " * 40_000)]
    docs = [(i, t, "en", "s", len(t)) for i, t, _, _ in rows] + [(i, t, "en", "s", len(t or "")) for i, t in extra]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(rows[1][1].split()[:15]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


@pytest.mark.parametrize("query, place, flip", [(quality.op5_quality, 2, False), (toxicity.op7_toxicity, 3, True)])
def test_classifiers_on_held_out_rows(spark, tables, query, place, flip):
    d, rows = tables
    out = query(spark, d).toPandas()
    assert len(out) == len(rows) + 6 and out["score"].between(0, 1).all()
    held = {int(r.doc_id): r for r in out.dropna().itertuples() if r.held_out}
    assert set(held) >= {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    good = np.mean([held[r[0]].predicted == r[place] for r in rows if r[0] in held])
    assert good > 0.95
    empty = out[out["doc_id"].isin([2000, 2001])]["predicted"]
    assert len(set(empty)) == 1 and (not flip or set(empty) == {0})


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
@pytest.mark.parametrize("scale, query, label, right, recall", [("sf0.01", quality.op5_quality, "quality", 0.97, 0.98), ("sf0.01", toxicity.op7_toxicity, "toxic", 0.95, 0.8), ("sf0.1", toxicity.op7_toxicity, "toxic", 0.985, 0.93)])
def test_classifiers_on_the_given_tables(spark, scale, query, label, right, recall):
    """Held-out rows: share of right ones, and of the rows of class 1 that are found; the labels hold some noise."""
    d = f"{TABLES}/{scale}"
    known = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{d}/labels.parquet'").fetchall())
    out = {r["doc_id"]: r for r in query(spark, d).collect()}
    held = [i for i in known if i in out and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] for i in held)
    assert np.mean([out[i]["predicted"] == known[i] for i in held]) >= right
    assert np.mean([out[i]["predicted"] for i in held if known[i]]) >= recall


def test_scores_keep_to_the_shares_of_classes():
    rng = np.random.default_rng(1)
    labels = np.repeat([0, 1], 500)
    margins = labels * 1.0 + rng.normal(size=1000)
    a, b = labelled_rows.platt(margins, labels)
    c, e = labelled_rows.platt(margins, labels, (9000, 1000))
    assert labelled_rows.sigmoid(a * 0.5 + b) == pytest.approx(0.5, abs=0.05) and labelled_rows.sigmoid(c * 0.5 + e) == pytest.approx(0.1, abs=0.03)


@pytest.mark.parametrize("fit, scorer", [(quality.fit, quality.scorer), (toxicity.fit, toxicity.scorer)])
def test_models_keep_to_the_shares_of_classes(fit, scorer):
    """Of texts that tell little, as many score for class 1 as it has labels, whatever its share of the training rows is."""
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma"] + ["delta"] * (1 + i % 2), k=12)) for i in range(600)]
    labels = np.arange(600) % 2
    extract = (lambda t: (quality.ngrams(t), None)) if fit is quality.fit else toxicity.counted
    rows, counts = zip(*map(extract, texts), strict=True)
    for zeros, ones in ((9000, 1000), (1000, 9000)):
        score = scorer(fit(labels, list(rows), list(counts), (zeros, ones)))(texts)
        share = (score[labels == 0].mean() * zeros + score[labels == 1].mean() * ones) / 10_000
        assert share == pytest.approx(ones / 10_000, abs=0.05)


def test_training_features_are_bounded(spark):
    rows = [(i, i % 2, np.arange(i % 7, dtype=np.uint32).tobytes(), np.ones(i % 7, np.uint32).tobytes()) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, label int, indices binary, counts binary")
    told = lambda labels, indices, counts, totals: f"{len(labels)} {sum(x.nbytes for x in indices) + sum(x.nbytes for x in counts)} {totals}".encode()
    assert labelled_rows.fit_in_one_task(df, told, (7, 9)) == f"200 {sum(len(r[2]) + len(r[3]) for r in rows)} (7, 9)".encode()
    n, size, _ = labelled_rows.fit_in_one_task(df, told, (7, 9), 1000).split(b" ", 2)
    assert 20 < int(n) < 200 and int(size) <= 1000


@pytest.mark.parametrize("module, column, value", [(quality, "quality", 1.0), (toxicity, "toxic", 0.0)])
def test_no_labels(spark, module, column, value):
    docs = spark.createDataFrame([(1, "a b", 9), (2, None, 9)], "doc_id long, text string, score int")
    model = module.train(docs, spark.createDataFrame([], f"doc_id long, {column} int"))
    score = module.score_quality if module is quality else module.score_toxicity
    assert [r["score"] for r in score(docs, model).collect()] == [value, value]


def test_pipeline(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    schema = docs.schema
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, d), name)
        assert docs.schema.fieldNames() == schema.fieldNames() and [f.dataType for f in docs.schema] == [f.dataType for f in schema]
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
    good = {i for i, _, q, _ in rows if q}
    assert len(kept["quality"] & good) >= 0.97 * len(good) and len(kept["quality"] - good - {2000, 2001, 2002, 2003, None}) <= 3
    assert 2002 not in kept["near_duplicates"] or rows[0][0] not in kept["quality"]
    assert 1 not in kept["decontamination"] and len(kept["near_duplicates"] - kept["decontamination"]) <= 3
    packed = corpus_pipeline.run(spark, d)
    assert packed.columns[:5] == [f.split()[0] for f in packing.PIECES.split(", ")] and {r["doc_id"] for r in packed.collect()} == kept["secrets"]


def test_stages_keep_columns_of_any_name(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = "_quality _spans _h0 _h _id _hash score spans uid h first".split()
    docs = docs.select("*", *(F.lit(n).alias(n) for n in odd))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, d), "odd")
        assert docs.select(odd).distinct().collect() == [tuple(odd)]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() > 0


def test_pipeline_of_empty_tables(spark, tmp_path):
    for t, s in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], s).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
