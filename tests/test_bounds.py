"""Time and plans that stay bounded: many matches, many blocks, open strings, many ignore rules."""

import time

import pytest
from pyspark.sql import functions as F

from scansmith.functions import text as T
from scansmith.operators.match import matches
from scansmith.plans.scan import ScanOptions, scan
from scansmith.sources import files as S

OPEN = ["$.ajax({", "axios.create({", "getServerSideProps ", "http.get<", "new webpack.DefinePlugin({", "cors({", "query a(", "google_application_credentials:", "PRIVATE KEY-----", 'key="12345678"', "//x/api/api/", 'fetch("/api/x']


def timed(work, seconds=60):  # far below what time that grows with the square would take
    began = time.time()
    out = work()
    assert time.time() - began < seconds
    return out


def scanned(spark, texts, **options):
    return scan(spark.createDataFrame(list(texts.items()), "source string, text string").repartition(len(texts)), ScanOptions(**options))


def test_many_matches(spark):
    text = "".join(f'fetch("/api/v1/u{i}");\n' for i in range(200_000))
    found = timed(lambda: scanned(spark, {"a": text}, categories=("endpoints",)).select("value", "line").collect())
    assert {(r["value"], r["line"]) for r in found} == {(f"/api/v1/u{i}", i + 1) for i in range(200_000)}


def test_many_blocks_and_entries(spark):
    blocks = "".join(f'new webpack.DefinePlugin({{"A_{i}": "v{i}"}})\n' for i in range(22_000))
    one = "new webpack.DefinePlugin({" + ",".join(f'B_{i}: "v"' for i in range(120_000)) + "})"
    found = timed(lambda: scanned(spark, {"a": blocks, "b": one}, frameworks=True, categories=("debug",)).where("value LIKE 'DefinePlugin%'").select("source", "value", "line", "match_ord").collect())
    assert sorted((r["match_ord"], r["value"], r["line"]) for r in found if r["source"] == "a") == [(i, f"DefinePlugin: A_{i} = v{i}", i + 1) for i in range(22_000)]
    assert sorted((r["match_ord"], r["value"]) for r in found if r["source"] == "b") == [(i, f"DefinePlugin: B_{i} = v") for i in range(120_000)]


def test_open_runs(spark):
    texts = {p: p * (500_000 // len(p)) for p in OPEN}
    timed(lambda: scanned(spark, texts, entropy=True, frameworks=True).count(), 120)


def test_closings_lose_no_match(spark):
    """What stands behind the last possible end changes nothing before it."""
    text = "\n".join(
        ['$.ajax({a: 1, url: "/one"}) axios({url: "/two"}); axios.create({baseURL: "/three"})', 'getServerSideProps(); fetch("/four"); http.get<A>("/five")', 'new webpack.DefinePlugin({AB_C: "d"})']
        + ["cors({origin: true}) cors({ origin: '*' })", "query Q($a: Int) { x } mutation M {", "google_application_credentials = 'a/b.json'", 'secret = "12345678"; hmac', "postgresql://u:p@h/db mysql://u:p@h/db mongodb://u:p@h redis://:p@h/0 clickhouse://u:p@h"]
    )
    tail = "\n" + " ".join(OPEN)
    found = scanned(spark, {"a": text, "b": text + tail}, entropy=True, frameworks=True).collect()
    by = {s: {(r["category"], r["value"], r["line"]) for r in found if r["source"] == s} for s in "ab"}
    assert by["a"] <= by["b"]
    values = {v for _, v, _ in by["a"]}
    assert {"/one", "/two", "/three", "/four", "/five", "Q", "M", "DefinePlugin: AB_C = d"} <= values
    assert {"CORS Misconfiguration: CORS origin: true (all)", "CORS Misconfiguration: CORS origin: *"} <= values
    assert sum("URI with password" in v for v in values) + sum("ClickHouse" in v for v in values) >= 5
    assert any(v.startswith("GCP Credentials File") for v in values) and any(v.startswith("JWT/HMAC") for v in values)


@pytest.mark.parametrize("n", [0, 1, 2, 7, 50])
def test_lines_of_matches(spark, n):
    """Matches that hold line feeds themselves, and any number of them."""
    text = "\n\n".join(f"a\n{'x' * (i % 3)}b" for i in range(n)) + "\n"
    frame = spark.createDataFrame([(text,)], "t string").select(matches(F.col("t"), F.lit("a\n(x*)b"), F.lit(1)).alias("m"))
    found = frame.first()["m"] or []
    assert [(m["match_ord"], m["value"], m["line"]) for m in found] == [(i, "x" * (i % 3), 3 * i + 1) for i in range(n)]


def test_sums_stop_early(spark):
    text = '"a" + x;' * 60_000
    frame = spark.createDataFrame([(text,), ("'a'" + "+'b'" * 5000,)], "t string").select(T.deobfuscated(F.col("t")).alias("t"))
    assert {r["t"] for r in timed(frame.collect, 30)} == {text, '"a' + "b" * 5000 + '"'}


def test_many_ignore_rules(spark):
    rules = [f"{'!' if i % 7 == 3 else ''}dir{i}/*.js" for i in range(5000)] + ["[z-a]", "*.tmp", "!keep.tmp"]
    rows = [f"dir{i}/x.js" for i in range(0, 6000, 3)] + ["a/b.tmp", "a/keep.tmp"]
    frame = spark.createDataFrame([(r,) for r in rows], "p string")
    out = timed(lambda: {r["p"] for r in frame.where(S.ignored(F.col("p"), rules)).collect()})
    assert out == {f"dir{i}/x.js" for i in range(0, 5000, 3) if i % 7 != 3} | {"a/b.tmp"}
