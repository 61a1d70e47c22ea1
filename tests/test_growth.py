"""Scans that are made once, and corpora dealt by what they are grouped by."""

import re

import pytest
from pyspark.sql import functions as F

from scansmith import corpus as D
from scansmith.operators.match import candidates, gates, marked, matches, present
from scansmith.plans.scan import ScanOptions, patterns_of, scan
from scansmith.queries import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.range(300).withColumnRenamed("id", "o_orderkey").coalesce(1).write.parquet(f"{path}/orders.parquet")
    return path


def test_corpus_is_dealt_by_rows_and_source(spark, folder, monkeypatch):
    monkeypatch.setattr(D, "ROWS_A_TASK", 20)
    docs = D.corpus(spark, folder)
    assert docs.rdd.getNumPartitions() == 15 and docs.count() == 300
    plan = plan_of(scan(docs, ScanOptions(categories=("emails",))))
    assert plan.count("Exchange") == 1  # of keys; findings stay where they are


def test_versions_share_a_shuffle(spark, folder):
    out = QUERIES["version_suggestions"](spark, folder)
    assert out.count() == 50
    out.collect()
    assert "ReusedExchange" in plan_of(out)


def test_top_scans_once(spark, folder):
    """Tops and totals both read findings that are there."""
    plan = plan_of(QUERIES["top20_per_category_some"](spark, folder))
    assert "orders.parquet" not in plan and "Generate" not in plan


def test_gates_pass_over_patterns(spark):
    """A text meets fewer searches than there are needles, and the same patterns."""
    patterns = patterns_of(ScanOptions(entropy=True, frameworks=True))
    groups = gates(patterns)
    assert sorted(k for places in groups.values() for k in places) == list(range(len(patterns)))
    assert len(groups) < 0.6 * len(patterns)
    needles = sorted({n for p in patterns for n in p.needles})
    texts = ["", "none", "/", "://", *needles, *(n[1:] for n in needles), *(a + b for a, b in zip(needles, needles[7:]))]
    low = F.col("low")
    found = spark.createDataFrame([(t,) for t in texts], "low string").select("low", candidates(low, patterns, [present(low, p) for p in patterns]).alias("places"))
    want = {t: [k for k, p in enumerate(patterns) if not p.needles or any(n in t for n in p.needles)] for t in texts}
    assert {r["low"]: sorted(r["places"]) for r in found.collect()} == want


def test_conditions_are_compiled_apart(spark):
    """Texts of a pattern come one after the other; needles and checks are in no whole-stage method, which would be too long to be compiled."""
    docs = spark.createDataFrame([("a", "x")], "source string, text string")
    plan = plan_of(scan(docs, ScanOptions()))
    lines = [x for x in plan.splitlines() if "array_remove" in x]
    assert len(lines) == 1 and "*(" not in lines[0].split("Project")[0]
    assert any(" Filter " in x and "exists(array(value" in x and "*(" not in x.split("Filter")[0] for x in plan.splitlines())
    assert any("Sort [place" in x for x in plan.splitlines())


def test_marks_are_found_wherever_needles_are(spark):
    """Marks that overlap, at either end of a text, and of needles with characters that expressions read otherwise."""
    patterns = patterns_of(ScanOptions(entropy=True, frameworks=True))
    needles = sorted({n for p in patterns for n in p.needles if len(n) > 1})
    texts = {t for n in needles for t in (n, n + n, n[0] + n, n + n[-1])}
    rows = spark.createDataFrame([(t,) for t in sorted(texts)], "low string").select("low", marked(F.col("low"), patterns).alias("m")).collect()
    known = {m for marks in gates(patterns) for m in marks}
    assert {r["low"]: sorted(r["m"]) for r in rows} == {t: sorted(m for m in known if m in t) for t in texts}


def test_pieces_between_matches(spark):
    """As split gives them, with matches at either end, next to each other, and alternatives."""
    texts = ["", "ab", "xab", "abx", "abab", "a\nb\nab\n", "cdab", "\n", "xx", "éab🙂cd"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", matches(F.col("t"), F.lit("(?dU)ab|c(d)"), F.lit(0)).alias("m")).collect()
    for r in out:
        found = list(re.finditer("ab|cd", r["t"]))
        ends = [*(m.start() for m in found[1:]), len(r["t"])][: len(found)]
        want = [(i, m[0], r["t"][: m.start()].count("\n") + 1, r["t"][m.end() : e]) for i, (m, e) in enumerate(zip(found, ends, strict=True))]
        assert [(m["match_ord"], m["value"], m["line"], m["after"]) for m in r["m"] or []] == want


@pytest.mark.parametrize("name", ["sarif_results_some", "postman_items"])
def test_findings_that_are_read_again_are_written(spark, folder, name):
    plan = plan_of(QUERIES[name](spark, folder))
    assert "orders.parquet" not in plan and "Generate" not in plan
