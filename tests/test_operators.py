"""Operators over findings, text functions, sources, sinks and the file stream."""

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scansmith import export
from scansmith.functions import sql as Q
from scansmith.functions import text as T
from scansmith.operators import findings as R
from scansmith.operators.calls import call_strings
from scansmith.operators.detectors import cdn_summary, document_summary, frameworks
from scansmith.operators.secrets_score import high_entropy, valid_aws_secret
from scansmith.plans.folder import scan_folder
from scansmith.plans.scan import ScanOptions, scan
from scansmith.sources import files as S
from scansmith.streaming.incremental import scan_stream

COLUMNS = "category string, value string, source string, line int, pass_ord int, pat_ord int, match_ord int"


def findings(spark, rows):
    return spark.createDataFrame([(c, v, s, n, 1, 0, i) for i, (c, v, s, n) in enumerate(rows)], COLUMNS)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_deduplicate_across_files(spark):
    df = findings(spark, [("endpoints", "/admin", "a.js", 1), ("endpoints", "/admin/", "b.js", 2), ("endpoints", "/s?b=2&a=1", "a.js", 3), ("endpoints", "/s?a=1&b=2", "b.js", 4), ("urls", "/x/", "a.js", 1), ("urls", "/x", "a.js", 1)])
    out = R.deduplicate(df)
    assert sorted((r["value"], r["source"]) for r in out.collect()) == [("/admin", "a.js"), ("/s?b=2&a=1", "a.js"), ("/x", "a.js"), ("/x/", "a.js")]
    assert R.deduplicate(out).count() == out.count()
    assert ["a.js", "b.js"] in [r["sources"] for r in R.deduplicate(df, keep_sources=True).collect()]


def test_top_and_more(spark):
    df = findings(spark, [("urls", f"u{i:02}", "a.js", i) for i in range(25)])
    out = R.top_per_category(df).collect()
    assert len(out) == 20 and {r["more"] for r in out} == {5}


def test_versions_and_suggestions(spark):
    df = findings(spark, [("endpoints", "/api/v1/users", "a.js", 1), ("endpoints", "/v3/x", "a.js", 2), ("endpoints", "/none", "a.js", 3)])
    assert sorted(r["version"] for r in R.api_versions(df).collect()) == [1, 3]
    assert R.version_suggestions(df).count() == 10
    assert R.version_suggestions(df.where("value = '/none'")).count() == 0


def test_long_numbers_stop_nothing(spark):
    df = findings(spark, [("endpoints", f"/v{'9' * n}/x", "a.js", 1) for n in (1, 8, 11, 18, 19, 60)] + [("endpoints", "/v2/y", "a.js", 1)])
    assert sorted(r["version"] for r in R.api_versions(df).collect()) == [2, 9, 99999999, 99999999999, 10**18 - 1]
    out = R.version_suggestions(df).collect()
    assert [(r["template"], r["version"]) for r in out] == [("/v{VERSION}/x", k) for k in range(1, 51)] and out[2]["suggestion"] == "/v3/x"
    deps = spark.createDataFrame([("lodash", "4." + "9" * 30 + ".1"), ("lodash", "4.1." + "9" * 60), ("axios", "0.0.1")], "package string, installed string")
    assert sorted(r["installed"][:5] for r in R.vulnerable(deps, R.vulnerability_table(spark)).collect()) == ["0.0.1", "4.1.9"]


@pytest.mark.parametrize("path", ["/a/b/c/../../d", "/a/./b", "/../x", "/a/..", "/a/.", "/a//b/../c", "/x?y=/../z", "/a/b/../../../c?q#/./", "/a...b/..c", "/plain"])
def test_dot_segments(spark, path):
    from urllib.parse import urljoin

    assert R.resolved(findings(spark, [("endpoints", path, "a.js", 1)]), "https://h.io").first()["resolved_url"] == urljoin("https://h.io", path)


def test_resolved(spark):
    df = findings(spark, [("endpoints", v, "a.js", 1) for v in ("/x", "//h.io/y", "rel")])
    assert {r["value"]: r["resolved_url"] for r in R.resolved(df, "api.acme.io").collect()} == {"/x": "https://api.acme.io/x", "//h.io/y": "https://h.io/y", "rel": None}


@pytest.mark.parametrize("value, hidden", [("abcd", "****"), ("abcdefgh", "ab...gh"), ("abcdefghijklmnopqrst", "abcd...qrst")])
def test_redact(spark, value, hidden):
    assert R.redact(findings(spark, [("secrets", f"L: {value}", "a.js", 1)])).first()["value"] == f"L: {hidden}"


def test_vulnerable(spark):
    deps = spark.createDataFrame([("lodash", "^4.17.20"), ("axios", "~0.21.2"), ("minimist", "*"), ("express", "latest")], "package string, installed string")
    assert [r["package"] for r in R.vulnerable(deps, R.vulnerability_table(spark)).collect()] == ["lodash"]


def test_development_dependencies_win(spark):
    texts = spark.createDataFrame([("p", '{"name":"n","dependencies":{"tar":"1.0.0"},"devDependencies":{"tar":"7.0.0"}}'), ("q", "not json")], "path string, text string")
    rows = R.dependencies_of(S.manifests(texts)).collect()
    assert ("p", "tar", "7.0.0") in [tuple(r) for r in rows]


def test_entropy(spark):
    random.seed(0)
    for s in ["", "aaaa", "ab", *("".join(random.choices("abcdé🙂", k=n)) for n in (1, 7, 40))]:
        n = Counter(s)
        want = -sum(v / len(s) * math.log2(v / len(s)) for v in n.values()) if s else 0.0
        assert abs(one(spark, T.shannon_entropy(F.lit(s))) - want) < 1e-12


OBFUSCATED = ["\\x2f", "\\x41", "\\xe9", "\\x5cx41", "\\x5cu0041", "\\u00e9", "\\ud83d", "\\ude00", "\\ud83d\\ude00", "a", " ", "'", '"', "+", " + ", "'a' + 'b'", "'a'+\"b\" + 'c'", 'atob("L2FkbWlu")', 'atob("QQ==")', 'atob("QQ=")', 'atob("QQQ=")', 'atob("Q")', 'atob("=")', 'atob("QQ==QUJD")', 'atob("/w==")', "btoa('xyz')", 'btoa("é🙂")', "String.fromCharCode(47,97)", "String.fromCharCode( 128578 , 233)", "String.fromCharCode(55357,56832)", "String.fromCharCode(55357)", "String.fromCharCode(1114112)", "String.fromCharCode(1,,2)", f"String.fromCharCode({'9' * 50})", "é", "🙂", "\n", "\\", "x", "$1", "\u00a0"]


def test_expressions_undo_what_the_plain_function_undoes(spark):
    assert Q.plain("'a' + \"b\" + 'c'") == '"abc"' and Q.plain("\\ud83d\\ude00") == "😀" and Q.plain("\\ud83d") == "\ufffd"
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices(OBFUSCATED, k=rng.randint(1, 9)))) for i in range(2500)] + [(2500, " + ".join(f"'{i}'" for i in range(3000))), (2501, None)]
    out = spark.createDataFrame(rows, "i int, t string").select("i", T.deobfuscated(F.col("t")).alias("t"))
    assert {r["i"]: r["t"] for r in out.collect()} == {i: t if t is None else Q.plain(t) for i, t in rows}


def test_functions_for_sql(spark):
    Q.register(spark)
    assert spark.sql("SELECT deobfuscate('\\\\x2fa') AS t").first()["t"] == "/a"
    assert [round(r["e"], 9) for r in spark.sql("SELECT shannon_entropy(v) AS e FROM VALUES (''), ('aaaa'), ('abab'), ('a.b*')  AS t(v)").collect()] == [0, 0, 1, 2]
    assert spark.sql("""SELECT value, line FROM js_calls('fetch("/api/x")')""").collect() == [("/api/x", 1)]
    assert spark.sql("""SELECT value, line FROM js_strings('x = {"k": "v"}')""").collect() == [("k", 1), ("v", 1)]


def test_high_entropy_and_keys(spark):
    even, short = "GHIJKLMNOPQRSTUVWXYZghijklmnopq1", "GHIJKLMNOPQRST"
    assert one(spark, high_entropy(F.lit(even))) and not one(spark, high_entropy(F.lit(short))) and not one(spark, high_entropy(F.lit("ab" * 20)))
    assert one(spark, valid_aws_secret(F.lit("a/+=" * 10))) and not one(spark, valid_aws_secret(F.lit("a" * 39)))


@pytest.mark.parametrize("url, good", [("https://a.io/x", True), ("http://h", True), ("ftp://a.io", False), ("https://", False), ("a.io/x", False), ("", False), (None, False), ("https://[bad", False)])
def test_valid_urls(spark, url, good):
    assert one(spark, S.valid_url(F.lit(url).cast("string"))) is good


def test_introspection_answers(spark):
    texts = [("a", '{"data": {"__schema": {"types": [{"name": "Query", "kind": "OBJECT"}, {"name": "Id", "kind": "SCALAR"}]}}}'), ("b", '{"errors": []}'), ("c", "no json"), ("d", None)]
    out = S.introspected(spark.createDataFrame(texts, "source string, text string"))
    assert sorted(map(tuple, out.collect())) == [("a", "Id", "SCALAR"), ("a", "Query", "OBJECT")]


def test_providers_and_frameworks(spark):
    docs = spark.createDataFrame([("a", 'https://cdnjs.cloudflare.com/a import React from "react"')], "source string, text string")
    assert [(r["provider"], r["count"]) for r in cdn_summary(docs).collect()] == [("Cloudflare", 1)]
    assert docs.select(frameworks(F.col("text")).alias("f")).first()["f"] == ["react"]
    told = document_summary(docs.unionByName(spark.createDataFrame([("b", None), ("c", "https://d1.cloudfront.net https://D1.cloudfront.net")], docs.schema)))
    assert {tuple(r) for r in told.collect()} >= {("document", None, 3, 0), ("framework", "react", 1, 0), ("provider", "Cloudflare", 1, 1)}
    assert [(r["n"], r["domains"]) for r in told.where("kind = 'provider' AND name LIKE '%Front%'").collect()] == [(2, 1)]


def test_providers_of_a_table(spark):
    """Many endings, held against the first that fits; an ending need not begin at a dot."""
    rng = random.Random(4)
    rules = [(f".p{rng.randrange(50_000)}.net", f"P{i}", i) for i in range(20_000)] + [("x.io", "X", 30_000), ("ax.io", "AX", 29_999), ("", "none", -1), (None, "none", -1)]
    hosts = [f"a.p{rng.randrange(50_000)}.net" for _ in range(300)] + ["bax.io", "bx.io", "io", "x.io"]
    docs = spark.createDataFrame([(f"d{i % 9}", f"see http://{h} and https://{h.upper()}/y") for i, h in enumerate(hosts)] + [("n", None)], "source string, text string")
    out = cdn_summary(docs, spark.createDataFrame(rules, "ending string, provider string, ord int")).collect()
    first = {h: next((p for e, p, _ in sorted(rules[:-2], key=lambda r: r[2]) if h.endswith(e)), None) for h in set(hosts)}
    want = Counter((f"d{i % 9}", first[h]) for i, h in enumerate(hosts) if first[h])
    assert {(r["source"], r["provider"]): r["count"] for r in out} == {k: 2 * n for k, n in want.items()}
    assert {h for r in out for h in r["domains"]} == {h for h in hosts if first[h]}


def test_call_strings():
    text = 'fetch("/api/x");\n// fetch("/api/no")\nfoo(`/api/t`);\napi.get(`/api/${id}/y`); var z = "/api/z";'
    assert call_strings(text) == [("/api/x", 1), ("/api/", 4)]


def test_files_ignores_and_changes(spark, tmp_path):
    for name, data in {"a/x.js": b'x="/admin"\r\ny="\xff/login"', "a/node_modules/y.js": b"1", "a/z.ts": b"1", "a/skip/k.js": b"1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = S.script_files(spark, str(tmp_path), ["skip/", "# note"])
    docs = S.documents(found).collect()
    assert [r["source"].rsplit("/", 1)[1] for r in docs] == ["x.js"] and docs[0]["text"] == 'x="/admin"\ny="/login"'
    sums = S.with_checksum(S.script_files(spark, str(tmp_path)))
    cache = sums.select("path", F.when(F.col("path").endswith("x.js"), F.col("sha256")).otherwise(F.lit("old")).alias("sha256"))
    assert [r["path"].rsplit("/", 1)[1] for r in S.changed(sums, cache).collect()] == ["k.js"]


@pytest.mark.parametrize("rule, path, hit", [("*.min.js", "a/b.min.js", True), ("/x.js", "a/x.js", False), ("a/**/c.js", "a/b/d/c.js", True), ("lib/", "lib/q.js", True), ("[ab].js", "b.js", True)])
def test_ignore_rules(spark, rule, path, hit):
    assert one(spark, S.ignored(F.lit(path), [rule])) is hit


def test_git_metadata(spark):
    rows = [("r", "ref: refs/heads/main\n", "0123456789abcdef\n", "[remote]\n url = git@h:x.git\n"), ("d", "fedcba9876543210\n", None, None)]
    out = {r["root"]: r for r in S.git_metadata(spark.createDataFrame(rows, "root string, head string, ref_text string, config string")).collect()}
    assert out["r"]["branch"] == "main" and out["r"]["commit"] == "0123456789ab" and out["r"]["remotes"] == ["git@h:x.git"] and out["r"]["exposed_config"]
    assert out["d"]["branch"] == "detached" and not out["d"]["exposed_config"]


def test_folder_scan_remembers(spark, tmp_path):
    root, out, cache = (tmp_path / x for x in ("root", "out", "cache"))
    for name, data in {"a.js": 'x="/admin"', "b.js": 'x="/login"', "skip/c.js": 'x="/token"', ".gitignore": "# note\nskip/\n"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(data)
    run = lambda **more: sorted(r["value"] for r in scan_folder(spark, str(root), str(out), ScanOptions(categories=("endpoints",)), cache=str(cache), **more).collect())
    assert run() == ["/admin", "/login"] and run() == []
    (root / "b.js").write_text('x="/logout"')
    assert run() == ["/logout"] and run(ignore=False) == ["/token"] and run() == []
    assert sorted(p.name for p in out.iterdir() if p.name.startswith("run")) == [f"run={k}" for k in range(4)]  # a run without files leaves its number to the next


def test_git_folder(spark, tmp_path):
    assert S.git_folder(spark, str(tmp_path)).count() == 0
    for name, data in {"HEAD": "ref: refs/heads/dev/x\n", "refs/heads/dev/x": "0123456789abcdef\n", "config": "[remote]\n url = git@h:x.git\n"}.items():
        (tmp_path / ".git" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / ".git" / name).write_text(data)
    assert S.git_folder(spark, str(tmp_path)).first() == (str(tmp_path), "dev/x", "0123456789ab", True, ["git@h:x.git"])


SCANNED = 'fetch("/api/v1/users"); k="AKIA' + 'ABCDEFGHIJKLMNOP"; u="https://svc.acme.io/pa/th"; import React from "react"; c="https://d1.cloudfront.net/x.js"'


def test_exports(spark, tmp_path):
    docs = spark.createDataFrame([("a.js", SCANNED)], "source string, text string")
    df = scan(docs)
    out = export.export_report(df, str(tmp_path / "r"), "t", ("json", "html", "sarif", "postman", "md"), redact=True, zipped=True, docs=docs)
    sarif = json.loads((tmp_path / "r/findings.sarif").read_text())
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["results"]) == df.count()
    rules = sarif["runs"][0]["tool"]["driver"]["rules"]
    assert all(rules[r["ruleIndex"]]["id"] == r["ruleId"] and rules[r["ruleIndex"]]["defaultConfiguration"]["level"] == r["level"] for r in sarif["runs"][0]["results"])
    page = (tmp_path / "r/findings.html").read_text()
    assert "AKIA" + "ABCDEFGHIJKLMNOP" not in page and page.count("<tr class=finding") == df.count() and page.count("<section") == len({r["category"] for r in df.collect()}) and "id=search" in page and "react" in page
    assert {i["name"] for i in json.loads((tmp_path / "r/findings.postman").read_text())["item"]} >= {"/api/v1/users", "https://svc.acme.io/pa/th"}
    told = json.loads((tmp_path / "r/findings.json").read_text())
    assert told["meta"]["target"] == "t" and told["meta"]["file_count"] == 1 and told["meta"]["frameworks"] == ["react"] and sum(x["count"] for x in told["meta"]["cdn_summary"].values()) == 1
    assert {c: len(x) for c, x in told["findings"].items()} == {r["category"]: r["count"] for r in df.groupBy("category").count().collect()}
    assert "## [CRITICAL]" in (tmp_path / "r/findings.md").read_text() and set(out) == {"json", "html", "sarif", "postman", "md", "zip"}
    with pytest.raises(ValueError, match="encrypted"):
        export.export_report(df, str(tmp_path / "r"), "t", password="x")


def test_reports_of_no_findings(spark, tmp_path):
    out = export.export_report(findings(spark, []).withColumn("type", F.lit(None).cast("string")), str(tmp_path), "t", ("json", "html", "sarif", "postman", "md"))
    assert json.loads(open(out["json"]).read())["findings"] == {} and json.loads(open(out["sarif"]).read())["runs"][0]["results"] == [] and json.loads(open(out["postman"]).read())["item"] == []
    assert "No findings" in open(out["html"]).read()


def test_reports_hold_all_results(spark, tmp_path):
    n = 25_000
    df = spark.range(n).selectExpr("CASE id % 3 WHEN 0 THEN 'secrets' WHEN 1 THEN 'urls' ELSE 'endpoints' END AS category", "concat('http://h/', id) AS value", "concat('f', id % 50) AS source", "CAST(id AS INT) AS line", "1 AS pass_ord", "0 AS pat_ord", "CAST(id AS INT) AS match_ord")
    sarif = json.loads("".join(export.sarif(df)))["runs"][0]
    assert len(sarif["results"]) == n and len({r["message"]["text"] for r in sarif["results"]}) == n and len(sarif["tool"]["driver"]["rules"]) == 3
    assert len(json.loads("".join(export.postman(df)))["item"]) == sum(k % 3 > 0 for k in range(n))
    export.write_objects(export.sarif_objects(df), str(tmp_path / "parts"))
    assert spark.read.text(str(tmp_path / "parts")).count() == n


def test_messages_gate_and_listing(spark):
    rows = [("secrets", f"L: {'k' * 20}{i}", "a.js", i) for i in range(7)] + [("urls", "https://a.io/some/path", "b.js", 1)]
    df, clean = findings(spark, rows), findings(spark, rows[-1:])
    slack = export.notification(df, "t")["attachments"][0]
    assert slack["color"] == "#ff0000" and slack["text"].count("\n- L: kkkk...") == 5 and "Total findings: 8" in slack["text"] and "k" * 20 not in slack["text"]
    assert export.notification(clean, "t")["attachments"][0]["color"] == "#36a64f"
    teams = export.notification(df, "t", "teams")
    assert teams["themeColor"] == "FF0000" and {f["name"]: f["value"] for f in teams["sections"][0]["facts"]} == {"Target": "t", "Total findings": "8", "Secrets found": "7"}
    assert set(export.notifications(df, "t", {"slack": "https://s", "teams": ""})) == {"https://s"}
    with pytest.raises(ValueError, match="unknown"):
        export.notifications(df, "t", {"fax": "x"})
    assert R.has_secrets(df) and not R.has_secrets(clean)
    assert list(export.console(df)) == ["urls: 1", "secrets: 7", "total: 8"]
    assert list(export.console(clean, verbose=True)) == ["urls: 1", "  [b.js:1] https://a.io/some/path", "total: 1"]


def test_stream_scans_each_file_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.js").write_text('x="/admin"')
    scan_stream(spark, src, out, state).awaitTermination()
    (tmp_path / "src/b.js").write_text('x="/login"')
    scan_stream(spark, src, out, state).awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(out).where("category = 'endpoints'").collect()) == ["/admin", "/login"]
