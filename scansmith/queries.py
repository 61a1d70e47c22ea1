"""Registered queries: each operator over the given tables, or over the corpus derived from them, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scansmith import catalog as C
from scansmith import oracle as O
from scansmith.corpus import corpus, corpus_sql, spread
from scansmith.functions import text as T
from scansmith.operators import calls, detectors, secrets_score
from scansmith.operators import findings as R
from scansmith.plans.scan import ScanOptions, checked, displayed, raw_matches, scan
from scansmith.sources import files as S
from scansmith.sources.state import shared_folder
from scansmith.streaming import incremental as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

_COLUMNS = ["category", "value", "source", "line", "type", "pass_ord", "pat_ord", "match_ord"]
_SELECT = f" SELECT {', '.join(_COLUMNS)} FROM findings"
#: Rollups with names on _some run over these categories, the others over every one.
_SOME = ("endpoints", "emails", "network", "cloud")


def _patterns(*categories: str) -> list[C.Pattern]:
    return [p for p in [*C.CORE, *C.SWAGGER, *C.WASM, *C.STORAGE, *C.CORS] if p.category in categories]


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE[name] = sql


def _found(spark: SparkSession, d: str, *categories: str, **more: bool) -> DataFrame:
    return scan(corpus(spark, d), ScanOptions(categories=categories or C.CATEGORIES, **more))


def _env_risk_sql() -> str:
    p = C.Pattern(19, 0, "debug", "Env Injection Risk", "process\\.env\\.([A-Z_]{3,})\\b", needles=("process.env.",))
    sql = O.pattern_sql(p, check=False).replace("WHERE true", "WHERE NOT regexp_matches(after, '^\\s*(?:\\|\\||&&|\\?\\?)')")
    sql = sql.replace("CAST(i - 1 AS INTEGER) AS match_ord", "CAST(row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS INTEGER) AS match_ord")
    return sql.replace("v AS value", "'Env injection risk: process.env.' || v || ' (no default)' AS value", 1)


def _findings_sql(*categories: str, docs: str | None = None) -> str:
    sql = O.findings_sql(_patterns(*categories), docs)
    return sql.replace("), findings AS", f"\nUNION ALL {_env_risk_sql()}), findings AS", 1) if "debug" in categories else sql


# ---- scans of each category, and of all ------------------------------------------------------------------------------
for _c in C.CATEGORIES:
    _add(f"{_c}_scan", lambda s, d, c=_c: _found(s, d, c).select(_COLUMNS), _findings_sql(_c) + _SELECT)
_add("findings_first_wins", lambda s, d: _found(s, d).select(_COLUMNS), _findings_sql(*C.CATEGORIES) + _SELECT)

_KV = [p for p in C.SECRETS if p.ordinal < 4 or "[\"\\s:=]+" in p.regex]
_add(
    "secret_kv_scan",
    lambda s, d: _found(s, d, "secrets").where(F.col("pat_ord").isin([p.ordinal for p in _KV])).select(_COLUMNS),
    O.findings_sql(C.SECRETS) + _SELECT + f" WHERE pat_ord IN ({', '.join(str(p.ordinal) for p in _KV)})",
)


# ---- candidates before the checks, over the tables' own texts --------------------------------------------------------
def _pages(s: SparkSession, d: str) -> DataFrame:
    return spread(s.read.parquet(f"{d}/pages.parquet").select("page_id", "html")).select(F.col("page_id").cast("string").alias("source"), F.col("html").alias("text"))


_PAGES_SQL = "SELECT CAST(page_id AS VARCHAR) AS source, html AS text FROM pages"
_add(
    "email_candidates",
    lambda s, d: displayed(raw_matches(_pages(s, d), ScanOptions(categories=("emails",)))).select("source", "value", "line", "match_ord"),
    O.findings_sql(C.EMAILS, _PAGES_SQL).split(", matches AS")[0] + f" SELECT source, value, line, match_ord FROM ({O.pattern_sql(C.EMAILS[0], check=False)})",
)
_DOCUMENTS_SQL = "SELECT CAST(doc_id AS VARCHAR) AS source, text FROM documents"


def _documents(s: SparkSession, d: str) -> DataFrame:
    return spread(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("source"), "text")


_BEFORE = "source value line type pass_ord pat_ord match_ord".split()
_ALL_ROWS = [*_patterns(*C.CATEGORIES), *C.JWT_SECRETS, *C.ADMIN_CREDENTIALS, *secrets_score.HIGH_ENTROPY]
for _name, _docs, _sql in (("documents_scan", _documents, _DOCUMENTS_SQL), ("pages_scan", _pages, _PAGES_SQL)):
    # these texts hold addresses and long strings that no check lets pass, so matches are what can be held against SQL
    _add(
        _name,
        lambda s, d, docs=_docs: displayed(raw_matches(docs(s, d), ScanOptions(entropy=True))).where("pass_ord <> 19").select(_BEFORE),
        O.findings_sql(C.EMAILS, _sql).split(", matches AS")[0] + f" SELECT {', '.join(_BEFORE)} FROM (" + "\nUNION ALL ".join(O.pattern_sql(p, check=False) for p in _ALL_ROWS) + ")",
    )
_IP = "(?:[0-9]{1,3}\\.){3}[0-9]{1,3}"
_add(
    "ip_candidates",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_IP), F.lit(0))).alias("ord", "value")),
    f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS ord, m[i] AS value FROM (SELECT doc_id, regexp_extract_all(text, '{_IP}') AS m FROM documents), unnest(range(1, len(m) + 1)) AS t(i)",
)

# ---- rollups ---------------------------------------------------------------------------------------------------------
_RISK = O.case_sql("category", C.RISKS, "Low")
_ORDER = "source, pass_ord, pat_ord, match_ord"
_NORM_BARE = "regexp_replace(value, '/+$', '')"
_NORM = f"CASE WHEN category <> 'endpoints' THEN value WHEN instr({_NORM_BARE}, '?') > 0 THEN substr({_NORM_BARE}, 1, instr({_NORM_BARE}, '?')) || array_to_string(list_sort(string_split(substr({_NORM_BARE}, instr({_NORM_BARE}, '?') + 1), '&')), '&') ELSE {_NORM_BARE} END"
_SARIF = O.case_sql(_RISK, C.SARIF_LEVELS, "note")


def _written(findings: DataFrame) -> DataFrame:
    """findings as a table of the run, for what reads them twice; they are made once."""
    spark = findings.sparkSession
    path = shared_folder(spark, "findings")
    findings.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _rollups(tail: str, categories: tuple[str, ...]) -> None:
    """The rollups of a scan for categories, each name with tail."""
    some, sql = lambda s, d: _found(s, d, *categories), _findings_sql(*categories)
    _add(f"category_totals{tail}", lambda s, d: R.category_totals(some(s, d)), sql + " SELECT coalesce(category, 'total') AS category, count(*) AS n FROM findings GROUP BY ROLLUP (category)")
    _add(
        f"risk_rollup{tail}",
        lambda s, d: R.risk_rollup(some(s, d)),
        sql + f" SELECT {_RISK} AS risk, category, count(*) AS n, {O.case_sql(_RISK, {r: i for i, r in enumerate(C.RISK_ORDER)}, 4)} AS risk_rank FROM findings GROUP BY category",
    )
    _add(
        f"findings_dedup_export{tail}",
        lambda s, d: R.deduplicate(some(s, d)).select("category", "value", "source", "line"),
        sql + f" SELECT category, value, source, line FROM (SELECT *, row_number() OVER (PARTITION BY category, {_NORM} ORDER BY {_ORDER}) AS k FROM findings) WHERE k = 1",
    )
    _add(
        f"top20_per_category{tail}",
        lambda s, d: R.top_per_category(_written(some(s, d).select("category", *R.INSERTION, "value", "line"))).select("category", "rank", "value", "source", "line", "more"),
        sql + f" SELECT category, CAST(k AS INTEGER) AS rank, value, source, line, greatest(n - 20, 0) AS more FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY {_ORDER}, value) AS k, count(*) OVER (PARTITION BY category) AS n FROM findings) WHERE k <= 20",
    )
    _add(f"per_file_counts{tail}", lambda s, d: R.per_file(some(s, d)), sql + " SELECT category, source, count(*) AS n FROM findings GROUP BY category, source")
    _add(f"files_per_category{tail}", lambda s, d: R.files_per_category(some(s, d)), sql + " SELECT category, count(DISTINCT source) AS files, count(*) AS n FROM findings GROUP BY category")
    _add(
        f"severity_order{tail}",
        lambda s, d: R.by_severity(some(s, d)),
        sql + f" SELECT category, count(*) AS n, {O.case_sql('category', C.HTML_SEVERITY, 'LOW')} AS severity, {O.case_sql('category', {c: i for i, c in enumerate(C.SEVERITY_ORDER)}, 99)} AS rank FROM findings GROUP BY category",
    )
    _add(
        f"report_search{tail}",
        lambda s, d: R.search(some(s, d), "ADMIN").select("category", "value", "source", "line"),
        sql + " SELECT category, value, source, line FROM findings WHERE contains(lower(value), 'admin') OR contains(lower(source), 'admin') OR contains(CAST(line AS VARCHAR), 'admin')",
    )
    _add(
        f"sarif_results{tail}",
        lambda s, d: R.sarif_results(_written(some(s, d).select("category", *R.INSERTION, "value", "line"))),
        sql
        + ", firsts AS (SELECT category, min({'source': source, 'pass_ord': pass_ord, 'pat_ord': pat_ord, 'match_ord': match_ord}) AS first FROM findings GROUP BY category)"
        + ", rules AS (SELECT category, CAST(row_number() OVER (ORDER BY first, category) - 1 AS INTEGER) AS rule_index FROM firsts)"
        + f" SELECT rule_index, f.category, {_SARIF.replace('CASE category', 'CASE f.category')} AS level, value AS message, source AS uri, greatest(line, 1) AS start_line FROM findings f JOIN rules r ON f.category = r.category",
    )


_rollups("", C.CATEGORIES)
_rollups("_some", _SOME)
_add("category_filter", lambda s, d: R.in_category(_found(s, d), "network"), _findings_sql(*C.CATEGORIES) + " SELECT line, value, string_split(source, '/')[-1] AS file FROM findings WHERE category = 'network'")
_add("top_secrets", lambda s, d: R.top_secrets(_found(s, d, "secrets")).select("value", "source", "line"), O.findings_sql(C.SECRETS) + f" SELECT value, source, line FROM findings ORDER BY {_ORDER}, value LIMIT 5")
_EP = lambda s, d: _found(s, d, "endpoints")
_EP_SQL = _findings_sql("endpoints")
_add(
    "resolve_urls",
    lambda s, d: R.resolved(_EP(s, d), "api.acme.io").select("source", "value", "line", "resolved_url"),
    _EP_SQL + " SELECT source, value, line, CASE WHEN starts_with(value, '//') THEN 'https:' || value WHEN starts_with(value, '/') THEN 'https://api.acme.io' || value END AS resolved_url FROM findings",
)
_V = "/v([0-9]+)(?:\\.[0-9]+)?/"
_add("api_versions", lambda s, d: R.api_versions(_EP(s, d)), _EP_SQL + f" SELECT CAST(v AS BIGINT) AS version, count(*) AS n FROM (SELECT regexp_extract(value, '{_V}', 1) AS v FROM findings) WHERE v <> '' GROUP BY v")
_add(
    "version_suggestions",
    lambda s, d: R.version_suggestions(_EP(s, d)).select("template", "version", "suggestion"),
    _EP_SQL
    + f", named AS (SELECT regexp_replace(value, '{_V}', '/v{{VERSION}}/', 'g') AS template, CAST(regexp_extract(value, '{_V}', 1) AS INTEGER) AS v FROM findings WHERE regexp_matches(value, '{_V}'))"
    + " SELECT template, CAST(version AS BIGINT) AS version, replace(template, '{VERSION}', CAST(version AS VARCHAR)) AS suggestion FROM (SELECT DISTINCT template FROM named), unnest(range(1, (SELECT max(v) FROM named) + 3)) AS t(version) ORDER BY template, version LIMIT 50",
)
_add(
    "postman_items",
    lambda s, d: R.postman_items(_written(_found(s, d, "endpoints", "urls").select("category", *R.INSERTION, "value", "line")), "https://acme.io"),
    _findings_sql("endpoints", "urls")
    + f", ends AS (SELECT * FROM (SELECT *, {_NORM} AS norm, row_number() OVER (PARTITION BY {_NORM} ORDER BY {_ORDER}) AS k FROM findings WHERE category = 'endpoints') WHERE k = 1)"
    + ", others AS (SELECT DISTINCT value FROM findings WHERE category = 'urls' AND starts_with(value, 'http') AND value NOT IN (SELECT norm FROM ends))"
    + " SELECT value AS name, CASE WHEN starts_with(value, '/') THEN 'https://acme.io' || value ELSE value END AS url, source, line FROM ends UNION ALL SELECT substr(value, 1, 60), value, NULL, NULL FROM others",
)
_RED = "CASE WHEN length(t) <= 4 THEN '****' WHEN length(t) <= 12 THEN substr(t, 1, 2) || '...' || right(t, 2) ELSE substr(t, 1, 4) || '...' || right(t, 4) END"
_add(
    "redact",
    lambda s, d: R.redact(_found(s, d, "secrets")).select("source", "value", "line", "type"),
    O.findings_sql(C.SECRETS) + f" SELECT source, substr(value, 1, instr(value, ': ') + 1) || {_RED} AS value, line, type FROM (SELECT *, substr(value, instr(value, ': ') + 2) AS t FROM findings)",
)

# ---- secrets' scores -------------------------------------------------------------------------------------------------
_ENTROPY = "CASE WHEN length({v}) = 0 THEN 0.0 ELSE list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: -(len(list_filter(string_split({v}, ''), lambda d: d = c)) / length({v})) * log2(len(list_filter(string_split({v}, ''), lambda d: d = c)) / length({v})))) END"
_add(
    "entropy_score",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.bround(T.shannon_entropy(F.concat_ws("|", "c_name", "c_mktsegment")), 6).alias("entropy")),
    f"SELECT c_custkey, round_even({_ENTROPY.format(v='v')}, 6) AS entropy FROM (SELECT c_custkey, concat_ws('|', c_name, c_mktsegment) AS v FROM customer)",
)
_SCORED = ["source", "value", "line", "type", "raw_len", "confidence", "entropy", "validated"]
_low = O._any("lower(raw)", C.LOW_CONFIDENCE) + " OR " + O._any("lower(line_text)", C.LOW_CONFIDENCE)
_high = ", ".join(O.quoted(x) for x in C.HIGH_CONFIDENCE)
_confidence_sql = f"CASE WHEN regexp_matches(trim(line_text), '^(?://|/\\*|\\*)') OR {_low} THEN 'low' WHEN type IN ({_high}) THEN 'high' ELSE 'medium' END"
_jwt_bad = "type = 'JWT Token' AND (len(string_split(raw, '.')) <> 3 OR length(string_split(raw, '.')[1]) % 4 = 1 OR length(string_split(raw, '.')[2]) % 4 = 1)"
_add(
    "confidence",
    lambda s, d: _found(s, d, "secrets", entropy=True).where("pass_ord = 4").select(_SCORED),
    O.findings_sql(C.SECRETS)
    + f", told AS (SELECT f.*, string_split(d.text, chr(10))[f.line] AS line_text FROM findings f JOIN docs d ON f.source = d.source)"
    + f" SELECT source, value, line, type, CAST(length(raw) AS INTEGER) AS raw_len, CASE WHEN {_jwt_bad} THEN 'low' ELSE {_confidence_sql} END AS confidence, round_even({_ENTROPY.format(v='raw')}, 2) AS entropy, CASE WHEN {_jwt_bad} THEN false END AS validated FROM told",
)
_add(
    "secret_validation",
    lambda s, d: checked(raw_matches(corpus(s, d), ScanOptions(categories=("secrets",)))).select("source", "type", "value", secrets_score.valid_format(F.col("value"), F.col("type")).alias("valid")).where("valid IS NOT NULL").distinct(),
    O.findings_sql(C.SECRETS)
    + f" SELECT DISTINCT source, type, raw AS value, CASE WHEN type = 'JWT Token' THEN NOT ({_jwt_bad}) WHEN type = 'AWS Access Key' THEN regexp_full_match(raw, 'AKIA[A-Z0-9]{{16}}') WHEN type = 'GitHub PAT' THEN starts_with(raw, 'ghp_') AND length(raw) = 40 ELSE regexp_full_match(raw, '[sp]k_(live|test)_[0-9a-zA-Z]{{24,}}') END AS valid FROM matches WHERE type IN ('JWT Token', 'AWS Access Key', 'GitHub PAT', 'Stripe Live Secret', 'Stripe Test Secret')",
)
for _name, _rows, _pass in (("jwt_secrets", C.JWT_SECRETS, 5), ("admin_creds", C.ADMIN_CREDENTIALS, 6)):
    _add(_name, lambda s, d, k=_pass: _found(s, d, "secrets", entropy=True).where(F.col("pass_ord") == k).select("source", "value", "line", "type", "confidence"), O.findings_sql(_rows) + " SELECT source, value, line, type, 'high' AS confidence FROM findings")
_hidden = "'High-entropy candidate (entropy=' || printf('%.2f', round_even(e, 2)) || '): ' || substr(raw, 1, 10) || '...' || right(raw, 4)"
_add(
    "high_entropy",
    lambda s, d: _found(s, d, "secrets", entropy=True).where("pass_ord = 7").select("source", "value", "line", "entropy", "raw_len"),
    O.findings_sql(secrets_score.HIGH_ENTROPY).split(", findings AS (")[0]
    + f", e AS (SELECT *, {_ENTROPY.format(v='raw')} AS e FROM matches), shown AS (SELECT source, {_hidden} AS value, line, round_even(e, 2) AS entropy, CAST(length(raw) AS INTEGER) AS raw_len, match_ord FROM e WHERE e > 4.5)"
    + " SELECT source, value, line, entropy, raw_len FROM (SELECT *, row_number() OVER (PARTITION BY source, value ORDER BY match_ord) AS k FROM shown) WHERE k = 1",
)

# ---- detectors -------------------------------------------------------------------------------------------------------
_ALL_SIGNS = {k: "|".join(f"(?:{x})" for x in v) for k, v in C.FRAMEWORKS.items()}
_add(
    "framework_detect",
    lambda s, d: corpus(s, d).select("source", F.array_join(detectors.frameworks(F.col("text")), ",").alias("frameworks")).where("frameworks <> ''"),
    f"SELECT source, f AS frameworks FROM (SELECT source, concat_ws(',', {', '.join(f'CASE WHEN regexp_matches(text, {O.quoted(v)}) THEN {O.quoted(k)} END' for k, v in _ALL_SIGNS.items())}) AS f FROM ({corpus_sql(dialect='duckdb')})) WHERE f <> ''",
)
_add(
    "framework_endpoints",
    lambda s, d: _found(s, d, "endpoints", frameworks=True).where("pass_ord = 15").select("source", "value", "line", "source_framework"),
    O.findings_sql(sorted([*_patterns("endpoints"), *C.FRAMEWORK_ENDPOINTS], key=lambda p: p.order)) + " SELECT source, value, line, type AS source_framework FROM findings WHERE pass_ord = 15",
)
_default = "regexp_matches(substr(after, 1, 50), '^\\s*(?:\\|\\||&&|\\?\\?)\\s*[\"'']')"
_env_union = "\nUNION ALL ".join(O.pattern_sql(p, extra=", after") for p in C.ENV_VARS)
_add(
    "env_vars",
    lambda s, d: _found(s, d, "debug", frameworks=True).where("pass_ord = 16").select("source", "value", "line", "has_default", "env_risk"),
    f"WITH docs AS MATERIALIZED (SELECT source, text, lower(text) AS low FROM ({corpus_sql(dialect='duckdb')})), m AS ({_env_union}), f AS (SELECT *, row_number() OVER (PARTITION BY source, raw ORDER BY pat_ord, match_ord) AS k FROM m)"
    + f" SELECT source, value || CASE WHEN {_default} THEN '' ELSE ' (no default)' END AS value, line, {_default} AS has_default, NOT {_default} AS env_risk FROM f WHERE k = 1",
)
_W = "new\\s+webpack\\.DefinePlugin\\s*\\(\\s*\\{([^}]+)\\}"
_ENTRY = "[\"'']?([A-Z_][A-Z_0-9.]*)[\"'']?\\s*:\\s*(?:JSON\\.stringify\\s*\\(\\s*)?[\"'']([^\"'']+)[\"'']"
_add(
    "webpack_defines",
    lambda s, d: _found(s, d, "debug", frameworks=True).where("pass_ord = 17").select("source", "value"),
    f"SELECT DISTINCT source, 'DefinePlugin: ' || k[i] || ' = ' || v[i] AS value FROM (SELECT source, regexp_extract_all(b, '{_ENTRY}', 1) AS k, regexp_extract_all(b, '{_ENTRY}', 2) AS v FROM (SELECT source, unnest(regexp_extract_all(text, '{_W}', 1)) AS b FROM ({corpus_sql(dialect='duckdb')}))), unnest(range(1, len(k) + 1)) AS t(i)",
)
for _name, _rows, _cat in (("swagger_refs", C.SWAGGER, "endpoints"), ("wasm", C.WASM, "debug"), ("browser_storage", C.STORAGE, "debug"), ("cors", C.CORS, "network")):
    _add(_name, lambda s, d, k=_rows[0].order, c=_cat: _found(s, d, c).where(F.col("pass_ord") == k).select("source", "value", "line", "type"), O.findings_sql(_rows) + " SELECT source, value, line, type FROM findings")
_add("env_risk", lambda s, d: _found(s, d, "debug").where("pass_ord = 19").select("source", "value", "line"), _findings_sql("debug") + " SELECT source, value, line FROM findings WHERE pass_ord = 19")
_PROVIDER = "CASE " + " ".join(f"WHEN ends_with(h, {O.quoted(e)}) THEN {O.quoted(p)}" for e, p in C.CDN_PROVIDERS) + " END"
_add(
    "cdn_summary",
    lambda s, d: detectors.cdn_summary(corpus(s, d)).select("source", "provider", "count", F.array_join("domains", ",").alias("domains")),
    f"SELECT source, provider, count(*) AS count, string_agg(DISTINCT h, ',' ORDER BY h) AS domains FROM (SELECT source, h, {_PROVIDER} AS provider FROM (SELECT source, lower(unnest(regexp_extract_all(text, 'https?://([a-zA-Z0-9.-]+)', 1))) AS h FROM ({corpus_sql(dialect='duckdb')}))) WHERE provider IS NOT NULL GROUP BY source, provider",
)
_HOSTS_SQL = f"SELECT h, {_PROVIDER} AS provider FROM (SELECT lower(unnest(regexp_extract_all(text, 'https?://([a-zA-Z0-9.-]+)', 1))) AS h FROM d)"
_add(
    "document_summary",
    lambda s, d: detectors.document_summary(corpus(s, d)),
    f"WITH d AS MATERIALIZED ({corpus_sql(dialect='duckdb')}) SELECT 'document' AS kind, CAST(NULL AS VARCHAR) AS name, count(*) AS n, 0 AS domains FROM d UNION ALL "
    + " UNION ALL ".join(f"SELECT 'framework', {O.quoted(k)}, count(*), 0 FROM d WHERE regexp_matches(text, {O.quoted(v)}) HAVING count(*) > 0" for k, v in _ALL_SIGNS.items())
    + f" UNION ALL SELECT 'provider', provider, count(*), count(DISTINCT h) FROM ({_HOSTS_SQL}) WHERE provider IS NOT NULL GROUP BY provider",
)

# ---- obfuscation -----------------------------------------------------------------------------------------------------
_add(
    "concat_collapse",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", T.collapsed_sums(F.concat(F.lit("x = \""), F.col("c_custkey").cast("string"), F.lit("\" + 'a' + \""), "c_mktsegment", F.lit("\";"))).alias("text")),
    "SELECT c_custkey, 'x = \"' || CAST(c_custkey AS VARCHAR) || 'a' || c_mktsegment || '\";' AS text FROM customer",
)
_add(
    "base64_resolve",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", T.deobfuscated(F.concat(F.lit("f(atob(\""), F.base64(F.encode("c_name", "UTF-8")), F.lit("\"), btoa('"), "c_mktsegment", F.lit("'))"))).alias("text")),
    "SELECT c_custkey, 'f(\"' || c_name || '\", \"' || to_base64(encode(c_mktsegment)) || '\")' AS text FROM customer",
)
_add(
    "unescape",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", T.deobfuscated(F.concat(F.lit("\\x2f\\u0061"), F.col("c_custkey").cast("string"))).alias("text")),
    "SELECT c_custkey, '/a' || CAST(c_custkey AS VARCHAR) AS text FROM customer",
)
_add(
    "charcode",
    lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", T.deobfuscated(F.concat(F.lit("String.fromCharCode(65,"), (F.col("c_custkey") % 26 + 97).cast("string"), F.lit(")"))).alias("text")),
    "SELECT c_custkey, '\"A' || chr(CAST(c_custkey % 26 + 97 AS INTEGER)) || '\"' AS text FROM customer",
)
_add("obfuscated_scan", lambda s, d: scan(corpus(s, d, obfuscated=True), ScanOptions(categories=("endpoints",))).select(_COLUMNS))

# ---- sources and dependencies ----------------------------------------------------------------------------------------
_CACHE = "SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN sha256('stale') ELSE sha256(c_name) END AS sha256 FROM customer WHERE c_custkey % 5 <> 0"


def _incremental(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet")
    now = c.select(F.concat(F.lit("/src/f"), F.col("c_custkey").cast("string"), F.lit(".js")).alias("path"), F.sha2("c_name", 256).alias("sha256"), "c_custkey")
    cache = now.where("c_custkey % 5 <> 0").withColumn("sha256", F.when(F.col("c_custkey") % 3 == 0, F.sha2(F.lit("stale"), 256)).otherwise(F.col("sha256")))
    return S.changed(now.drop("c_custkey"), cache)


_add(
    "incremental_changed",
    _incremental,
    f"WITH cache AS ({_CACHE}) SELECT '/src/f' || CAST(c_custkey AS VARCHAR) || '.js' AS path, sha256(c_name) AS sha256 FROM customer WHERE NOT EXISTS (SELECT 1 FROM cache WHERE k = c_custkey AND cache.sha256 = sha256(c_name))",
)
_NAMES = [v[0] for v in C.VULNERABLE]


def _vulnerable(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey").cast("int")
    name = F.element_at(F.array(*map(F.lit, _NAMES)), k % len(_NAMES) + 1)
    version = F.concat(F.lit("^"), (k % 10).cast("string"), F.lit("."), (k % 23).cast("string"), F.lit("."), (k % 7).cast("string"))
    manifest = F.to_json(F.struct(F.concat(F.lit("p"), k.cast("string")).alias("name"), F.map_from_arrays(F.array(name), F.array(version)).alias("dependencies")))
    packages = S.manifests(c.select(k.cast("string").alias("path"), manifest.alias("text")))
    return R.vulnerable(R.dependencies_of(packages), R.vulnerability_table(s))


_VERSIONS = lambda v: f"list_transform(string_split({v}, '.'), lambda p: CAST(p AS BIGINT))"
_add(
    "vulnerable_deps",
    _vulnerable,
    f"WITH t(package, below, cve, severity) AS (VALUES {', '.join(str(v) for v in C.VULNERABLE)}), d AS (SELECT CAST(c_custkey AS VARCHAR) AS path, [{', '.join(map(O.quoted, _NAMES))}][c_custkey % {len(_NAMES)} + 1] AS package, CAST(c_custkey % 10 AS VARCHAR) || '.' || CAST(c_custkey % 23 AS VARCHAR) || '.' || CAST(c_custkey % 7 AS VARCHAR) AS v FROM customer)"
    + f" SELECT path, package, '^' || v AS installed, below AS fixed_in, cve, severity FROM d JOIN t USING (package) WHERE {_VERSIONS('v')} < {_VERSIONS('below')}",
)
_add("ast_endpoints", lambda s, d: calls.call_endpoints(corpus(s, d)))
_add("ast_scan", lambda s, d: _found(s, d, "endpoints", ast=True).select(_COLUMNS))


# ---- totals that follow batches, of a corpus that comes in three --------------------------------------------------------
def _followed(s: SparkSession, d: str) -> I.KeyedState:
    state = I.running(s, shared_folder(s, "totals"))
    docs = corpus(s, d)
    for k in range(3):
        batch = docs.where(F.pmod(F.xxhash64("source"), F.lit(3)) == k)
        I.follow(state, scan(batch), k)
    return state


_add("running_findings", lambda s, d: I.running_findings(_followed(s, d)).select("category", "value", "source", "line"), ORACLE["findings_dedup_export"])
_add(
    "running_totals",
    lambda s, d: I.running_totals(_followed(s, d)),
    f"WITH a AS ({ORACLE['category_totals']}), k AS (SELECT category, COUNT(*) AS kept FROM ({ORACLE['findings_dedup_export']}) GROUP BY category) SELECT a.category, a.n, COALESCE(k.kept, (SELECT SUM(kept) FROM k)) AS kept FROM a LEFT JOIN k USING (category)",
)

# ---- free text ---------------------------------------------------------------------------------------------------------
_LIKE = T.SECRET_LIKE.replace("\\s", "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]")
_SHOWN = "CASE WHEN length(m) > 12 THEN m[:4] || '...' || m[-4:] ELSE m[:2] || '...' || m[-2:] END"
_PIECES = f"list_zip(string_split_regex(text, '{_LIKE}'), list_transform(regexp_extract_all(text, '{_LIKE}'), lambda m: {_SHOWN}))"
_add(
    "text_redaction",
    lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(T.redacted_text(F.col("text")), 256).alias("redacted_sha256")),
    f"SELECT doc_id, sha256(array_to_string(list_transform({_PIECES}, lambda p: p[1] || COALESCE(p[2], '')), '')) AS redacted_sha256 FROM documents",
)
_ESCAPED = "html"
for _bare, _escaped in T.SCRIPT_ESCAPES.items():
    _ESCAPED = f"replace({_ESCAPED}, {O.quoted(_bare) if _bare.isprintable() else f'chr({ord(_bare)})'}, {O.quoted(_escaped)})"
_add(
    "script_strings",
    lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2(T.script_string(F.col("html")), 256).alias("escaped_sha256")),
    f"SELECT page_id, sha256({_ESCAPED}) AS escaped_sha256 FROM pages",
)
