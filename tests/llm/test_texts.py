"""Operators 2, 4, 6 and 8 and word hashing, against plain versions."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from scansmith.llm import common, decontaminate, packing, secrets, tokens

TABLES = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}
PIECES = ["a", "bc", "é", "'s", "12", "..", "<|endoftext|>", "🙂", "_", "ª", "中", "²", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\r", "\0", "\n\n", "Word", "don't"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_vocabulary())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(n)]


def test_encoder_agrees_with_the_library(library):
    e = tokens.Encoder.of(tokens.default_vocabulary())
    for t in texts(3000, 1):
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == library(t)[:-1], repr(t)


def test_added_tokens_have_their_own_id(library):
    e = tokens.Encoder.of(tokens.default_vocabulary())
    for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>", "a <|endoftext| b"):
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == library(t)[:-1]
    assert library("a <|endoftext|> b") == [64, 220, 50256, 275, 2]


def test_cache_stays_bounded_and_right(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 8)
    e = tokens.Encoder(tokens.default_vocabulary())
    for t in texts(300, 2):
        assert np.frombuffer(e.encode(t), e.dtype).tolist() == library(t)[:-1]
    assert len(e.pieces) <= 9


DOCS = [(5, "one two three"), (1, ""), (3, None), (2, "long words " * 3000), (5, "one two three"), (5, "again"), (9, "é 🙂\n\n x"), (None, "null id"), (10, "one <|endoftext|> two")]


def test_token_files_round_trip(spark, library, tmp_path):
    df = spark.createDataFrame([(*d, 7, "x") for d in DOCS], "doc_id long, text string, part int, h string")
    parts = tokens.write_token_files(df, str(tmp_path / "t"), rows_a_part=2)
    out = tokens.read_token_files(spark, str(tmp_path / "t"), parts, with_ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted([d for d, _ in DOCS], key=lambda d: (d is not None, d))
    assert sorted(tuple(r["ids"]) for r in out) == sorted(tuple(library(t)) for _, t in DOCS)
    start = 0
    for r in out:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), crc(r["ids"]))
        start += len(r["ids"])


def test_no_documents_make_no_files(spark, tmp_path):
    parts = tokens.write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"))
    assert parts == [] and tokens.read_token_files(spark, str(tmp_path / "t"), parts).count() == 0


def test_packing(spark, library):
    rows = DOCS + [(100 + i, t * 40) for i, t in enumerate(texts(150, 3))]
    df = spark.createDataFrame([(*d, 1) for d in rows], "doc_id long, text string, uid int")
    out = packing.pack_documents(df).toPandas()
    want = []
    for d, t in rows:
        ids = library(t)
        want += [(d if d is not None else -1, k, at, n, crc(ids[at : at + n])) for k, (at, n) in enumerate(packing.cut(len(ids)))]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(out[columns].fillna(-1).astype("int64").itertuples(index=False, name=None)) == sorted(want)
    by = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["length"]
    assert by.sum().max() <= 1024
    assert (by.cumsum() - out.loc[by.cumsum().index, "length"] == out.loc[by.cumsum().index, "offset"]).all()
    assert by.ngroups <= -(-out["length"].sum() // 1024) + 1
    assert packing.pack_documents(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of documents that hold what the operators of this file look for."""
    d, rng = str(tmp_path_factory.mktemp("documents")), random.Random(12)
    rows = DOCS + [(100 + i, t) for i, t in enumerate(texts(120, 13))]
    rows += [(300 + i, f"{t} {rng.choice(['password: ', 'TOKEN=', 'x'])}{'Ab9' * rng.randint(2, 9)} AKIA{'B' * rng.randint(10, 16)} {'0f' * rng.randint(5, 12)}") for i, t in enumerate(texts(60, 14))]
    spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    return d, rows


def ordered(rows):
    return sorted(rows, key=repr)


def test_packing_query(spark, library, folder):
    d, rows = folder
    out = [tuple(r) for r in packing.op2_best_fit_packing(spark, d).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    want = []
    for doc, t in rows:
        ids = library(t)
        want += [(doc, k, at, n, crc(ids[at : at + n])) for k, (at, n) in enumerate(packing.cut(len(ids)))]
    assert ordered(r[:5] for r in out) == ordered(want)
    ends = {}
    for *_, n, _, sequence, offset in sorted(out, key=lambda r: r[5:]):  # gapless from 0
        assert offset == ends.get(sequence, 0)
        ends[sequence] = offset + n
    assert max(ends.values()) <= 1024 and len(ends) <= -(-sum(r[3] for r in out) // 1024) + 1


def test_token_file_query(spark, library, folder):
    d, rows = folder
    out = tokens.op6_token_files(spark, d).orderBy("start").collect()
    assert [r["doc_id"] for r in out] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    assert ordered((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == ordered((i, len(library(t)), crc(library(t))) for i, t in rows)
    assert [r["start"] for r in out] == np.append(0, np.cumsum([r["n_tokens"] for r in out]))[:-1].tolist()


def test_secret_query(spark, folder):
    d, rows = folder
    out = [tuple(r) for r in secrets.op4_secrets(spark, d).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans").collect()]
    want = []
    for i, t in rows:
        base = base_spans(t or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        counts = [sum(k == kind for k, *_ in base) for kind in secrets.BASE]
        want.append((i, *counts, hashlib.sha256(told.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b, _ in secrets.find(t or ""))))
    assert ordered(out) == ordered(want) and sum(r[1] + r[2] + r[3] for r in out) > 50


def test_packing_is_never_worse_than_best_fit_decreasing():
    rng = np.random.default_rng(6)
    for _ in range(20):
        lengths = rng.integers(1, 1024, 200)
        assign = np.empty(200, np.int64)
        packing.best_fit(lengths, np.argsort(-lengths, kind="stable"), assign, [], 1024)
        best = packing.evolve(lengths, [], np.random.default_rng(0))[0]
        assert np.bincount(best, lengths).max() <= 1024 and len(best) == 200
        assert packing.fitness(lengths, best, 1024) >= packing.fitness(lengths, assign, 1024)


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(8)
    lengths = rng.integers(1, 700, 120)
    a, b = packing.evolve(lengths, [], rng, generations=0)[:2]
    for _ in range(50):
        child = packing.crossover(lengths, a, b, rng, 1024)
        assert (child >= 0).all() and set(child.tolist()) == set(range(child.max() + 1)) and np.bincount(child, lengths).max() <= 1024


def test_cut():
    assert packing.cut(1024) == [(0, 1024)] and packing.cut(1025) == [(0, 1), (1, 1024)] and packing.cut(2048) == [(0, 1024), (1024, 1024)] and packing.cut(5) == [(0, 5)]


def base_spans(t):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0])))


def test_secret_spans():
    rng = random.Random(1)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "ApiKey", "'", '"', " ", ":", "=", "abcdef0123456789", "AKIA", "AKIA" + "ABCDEFGH12345678", "f", "0", "é", "İ", "\u212a", "ſecret", "\n", "xyzXYZ", "-", "deadbeef", "🙂"]
    for _ in range(8000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [s[:3] for s in secrets.find(t) if s[0] in secrets.BASE] == base_spans(t), repr(t)


def test_checksums_decide():
    body = "a1B2" * 7 + "xy"
    good = "ghp_" + body + secrets.checksum(body)
    assert ("github", 2, 42, 2) in secrets.find(f"x {good} y")
    assert not [s for s in secrets.find("x ghp_" + body + "000000 y") if s[0] == "github"]


def test_scan_and_redact(spark):
    rows = [(1, 'my token = "' + "Z" * 15 + '" end', "k"), (2, None, "k"), (3, "", "k"), (4, "clean " * 50_000 + "f" * 20, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    assert out[1]["spans"][0][:3] == ("assign", 3, 27) and out[2]["spans"] == [] and out[3]["spans"] == [] and out[4]["spans"][0]["start"] == 300_000
    hidden = {r["doc_id"]: r for r in secrets.redact(df).collect()}
    assert hidden[1]["text"] == 'my token = "[secret]" end' and hidden[2]["text"] is None and hidden[4]["text"].endswith("clean [secret]") and hidden[1]["spans"] == "k"


def test_private_keys_are_hidden_whole(spark):
    lines = ["MIIEpAIBAAKCAQEA" + c * 48 for c in "aBc"] + ["x9Z="]
    begin, end = (f"-----{x} RSA PRIVATE KEY-----" for x in ("BEGIN", "END"))
    headers = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", ""]
    keys = ["\n".join([begin, *lines, end]), "\r\n".join([begin, *headers, *lines, end]), "\\n".join([begin, *lines, end]), f"{begin} {' '.join(lines)} {end}", "\n".join([begin, *lines]), "\r\n".join([begin, *headers, *lines]), "\\n".join([begin, *lines]), begin]
    tails = [" after"] * 4 + ["\n\nafter", "\n-----BEGIN other", '" after', " after some words"]
    rows = [(i, f"before {k}{t}") for i, (k, t) in enumerate(zip(keys, tails, strict=True))] + [(8, f"{begin}\n{lines[0]}\nmore {keys[0]} after")]
    out = {r["doc_id"]: r["text"] for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: f"before [secret]{t}" for i, t in enumerate(tails)} | {8: "[secret]\nmore [secret] after"}


def plain_contamination(text, items):
    w = WORD.findall((text or "").translate(LOW))
    hit, found = set(), set()
    for i, t in items:
        v = WORD.findall((t or "").translate(LOW))
        n = min(13, len(v))
        windows = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v and i is not None else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(str(i))
    return len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)


def test_contamination(spark):
    rng = random.Random(7)
    word = lambda n: " ".join(rng.choice(["al", "Be", "ga", "de", "ep", "ÉT", "7", "th", "io"]) + rng.choice(["x", "y", "z", ""]) for _ in range(n))
    items = [(i, word(rng.choice([0, 1, 3, 12, 13, 14, 40]))) for i in range(14)] + [(None, word(20)), (50, None), (3, word(15))]
    docs = []
    for i in range(60):
        t = word(rng.choice([0, 5, 12, 13, 200]))
        if rng.random() < 0.7:
            source = WORD.findall(rng.choice([x for _, x in items if x] or [""]))
            at = rng.randrange(max(1, len(source) - 12))
            t = f"{t}, {' '.join(source[at : at + rng.choice([12, 13, 25])]).upper() if rng.random() < 0.3 else ' '.join(source[at : at + 20])}; {word(4)}"
        docs.append((i, t))
    docs += [(60, None), (61, ""), docs[0]]
    df = spark.createDataFrame([(*d, "k") for d in docs], "doc_id long, text string, uid string")
    bench = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, f int")
    out = decontaminate.contamination(df, bench).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in out) == sorted((d, *plain_contamination(t, items)) for d, t in docs)
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, t in docs if not plain_contamination(t, items)[3])
    assert decontaminate.contamination(df, bench.limit(0)).where("n_hit > 0").count() == 0 and decontaminate.contamination(df.limit(0), bench).count() == 0


@pytest.mark.parametrize("size", [64, 1 << 20])
def test_word_hashes_follow_words_alone(monkeypatch, size):
    monkeypatch.setattr(common, "SLICE", size)
    rows = ["One two-three  FOUR", "four TWO", "", None, "é×é " * 100, "x" * 300, "two"]
    got = {}
    for lo, hi, words, at in common.hashed_words(pa.array(rows)):
        for i in range(lo, hi):
            got[i] = words[at[i - lo] : at[i - lo + 1]].tolist()
    seen = {}
    for i, t in enumerate(rows):
        own = WORD.findall((t or "").translate(LOW))
        assert len(own) == len(got[i])
        for w, h in zip(own, got[i], strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables here")
def test_contamination_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    found = con.execute(decontaminate.OP8_SQL)
    out = decontaminate.op8_decontaminate(spark, TABLES).select(*(d[0] for d in found.description))
    assert sorted(map(tuple, out.collect())) == sorted(found.fetchall())


def test_columns_of_the_same_names_stay(spark):
    df = spark.createDataFrame([(1, "token = " + "Z" * 20, "a", "b", "c")], "doc_id long, text string, _spans string, _id string, _hash string")
    assert secrets.redact(df).first() == (1, "token = [secret]", "a", "b", "c")
    bench = spark.createDataFrame([(1, "other words")], "item_id long, text string")
    assert decontaminate.decontaminate(df, bench).collect() == df.collect()


def test_session_keeps_its_batches_and_tables_go(spark):
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    out = common.written(spark.range(3).toDF("x"), "kept")
    assert spark.conf.get(setting) == before and out.count() == 3
    path = common._PLACES[out].removeprefix("file://")
    assert os.path.isdir(path)
    common.discard(out)
    assert not os.path.exists(path)
