"""Hand-derived expectations of the scan, one document a case."""

import pytest

from scansmith.plans.scan import ScanOptions, scan

AWS = "AKIA" + "ABCDEFGHIJKLMNOP"

#: name, text, findings that must be there as (category, value, line), values that must not
CASES = [
    ("fetch", 'fetch("/api/v1/users");', [("endpoints", "/api/v1/users", 1), ("debug", "Fetch URL (complements endpoints): /api/v1/users", 1)], []),
    ("short form", 'x="/api/users"', [("endpoints", "/api/users", 1)], []),
    ("no second slash", 'x="/api/users/list"', [], ["/api/users/list"]),
    ("word", 'x="/admin"', [("endpoints", "/admin", 1)], []),
    ("capital", 'x="/Admin"', [], ["/Admin"]),
    ("url", 'u="https://svc.acme.io/api/v2/things"', [("urls", "https://svc.acme.io/api/v2/things", 1)], []),
    ("no scheme", 'u="//svc.acme.io/api/v2/things"', [("endpoints", "//svc.acme.io/api/v2/things", 1)], []),
    ("localhost", 'u="https://localhost:3000/x"', [("network", "Localhost Port: localhost:3000", 1)], ["https://localhost:3000/x"]),
    ("hex escape", 'x="\\x2fadmin"', [("endpoints", "/admin", 1)], []),
    ("sum", "x=\"/adm\" + 'in'", [("endpoints", "/admin", 1)], []),
    ("base64", 'x=atob("L2FkbWlu")', [("endpoints", "/admin", 1)], []),
    ("codes", "x=String.fromCharCode(47,97,100,109,105,110)", [("endpoints", "/admin", 1)], []),
    ("aws", f'k="{AWS}"', [("secrets", f"AWS Access Key: {AWS}", 1)], []),
    ("env", "process.env.API_TOKEN;", [("debug", "Env Var Ref: API_TOKEN", 1), ("debug", "Env injection risk: process.env.API_TOKEN (no default)", 1)], []),
    ("env default", "process.env.API_TOKEN || fallback", [("debug", "Env Var Ref: API_TOKEN", 1)], ["Env injection risk: process.env.API_TOKEN (no default)"]),
    ("env digit", "process.env.KEY_1", [], ["Env Var Ref: KEY_"]),
    ("emails", "ops@acme.io noreply@acme.io a@b.example.com", [("emails", "ops@acme.io", 1)], ["noreply@acme.io", "a@b.example.com"]),
    ("files", '"data/report.csv" "package.json" "a.json"', [("files", "data/report.csv", 1)], ["package.json", "a.json"]),
    ("cors quoted", '"Access-Control-Allow-Origin": "*"', [], ["CORS Misconfiguration: Wildcard ACAO"]),
    ("cors", "Access-Control-Allow-Origin: *", [("network", "CORS Misconfiguration: Wildcard ACAO", 1)], []),
    ("ipv6", "fe80::1", [("network", "IPv6 (link-local / unique local): fe80:", 1)], []),
    ("first line wins", 'a\nb\nx="/admin"\n\n\n\nx="/admin"', [("endpoints", "/admin", 3)], []),
    ("debugger", "x;\n\ndebugger;", [("debug", "Debugger: debugger", 3)], []),
    ("empty", "", [], []),
]


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame([(n, t) for n, t, _, _ in CASES] + [("null", None)], "source string, text string")
    return [r.asDict() for r in scan(docs).collect()]


@pytest.mark.parametrize("name, text, there, absent", CASES, ids=[c[0] for c in CASES])
def test_case(found, name, text, there, absent):
    own = {(r["category"], r["value"], r["line"]) for r in found if r["source"] == name}
    assert set(there) <= own
    assert not {v for _, v, _ in own} & set(absent)
    if not text:
        assert not own


def test_null_text_has_no_findings(found):
    assert not [r for r in found if r["source"] == "null"]


def test_lines_are_within_the_text(found):
    lines = {n: t.count("\n") + 1 for n, t, _, _ in CASES}
    assert all(1 <= r["line"] <= lines[r["source"]] for r in found)


def test_entropy_and_confidence(spark):
    docs = spark.createDataFrame([("a", f'k="{AWS}"'), ("b", f'// k="{AWS}"'), ("c", 'user = "admin"\nsigning_secret = "abcdefghijk"')], "source string, text string")
    rows = {(r["source"], r["type"]): r for r in scan(docs, ScanOptions(entropy=True, categories=("secrets",))).collect()}
    assert rows["a", "AWS Access Key"]["confidence"] == "high" and rows["b", "AWS Access Key"]["confidence"] == "low"
    assert rows["a", "AWS Access Key"]["raw_len"] == 20 and rows["a", "AWS Access Key"]["entropy"] == 3.88
    assert rows["c", "Default Credential"]["confidence"] == "high" and rows["c", "JWT/HMAC Secret"]["value"] == "JWT/HMAC Secret: abcdefghijk"


def test_frameworks(spark):
    text = 'axios.get("items/1");\nprocess.env.NEXT_PUBLIC_A ?? "x";\nnew webpack.DefinePlugin({ A: JSON.stringify("b"), C: "d" });'
    rows = scan(spark.createDataFrame([("a", text)], "source string, text string"), ScanOptions(frameworks=True)).collect()
    shown = {(r["category"], r["value"], r["line"]) for r in rows}
    assert ("endpoints", "items/1", 1) in shown
    assert {("debug", "DefinePlugin: A = b", 3), ("debug", "DefinePlugin: C = d", 3)} <= shown
    env = [r for r in rows if r["value"].startswith("Next.js public env")]
    assert [r["has_default"] for r in env] == [True] and not [r for r in rows if r["value"].startswith("Environment variable: NEXT")]


def test_calls_are_the_second_pass(spark):
    text = 'load("/rest/x/y"); api.get(`/internal/${id}/z`);\nfetch("/admin/q")'
    docs = spark.createDataFrame([("a", text), ("b", None), ("c", "no calls")], "source string, text string")
    found = {r["value"]: r["pass_ord"] for r in scan(docs, ScanOptions(ast=True, categories=("endpoints",))).collect()}
    assert found == {"/rest/x/y": 1, "/admin/q": 1, "/internal/": 2}
    assert set(found) - {r["value"] for r in scan(docs, ScanOptions(categories=("endpoints",))).collect()} == {"/internal/"}


@pytest.mark.parametrize("options", [{}, {"entropy": True}, {"frameworks": True}, {"ast": True}, {"entropy": True, "frameworks": True, "ast": True}], ids=repr)
def test_text_is_read_once(spark, tmp_path_factory, options):
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    spark.createDataFrame([("a", "x")], "source string, text string").write.parquet(path)
    plan = scan(spark.read.parquet(path), ScanOptions(**options))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == (1 if options.get("ast") else 0)


def test_order_of_documents_does_not_matter(spark):
    rows = [(n, t) for n, t, _, _ in CASES]
    one = scan(spark.createDataFrame(rows, "source string, text string"))
    other = scan(spark.createDataFrame(rows[::-1], "source string, text string").repartition(3))
    assert sorted(map(tuple, one.collect()), key=repr) == sorted(map(tuple, other.collect()), key=repr)
