"""Relational operators over findings: deduplication, rollups, top-k, versions, resolution, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scansmith import catalog as C
from scansmith.functions.text import redacted

INSERTION = ("source", "pass_ord", "pat_ord", "match_ord")


def _case(key: Column, table: dict[str, object], default: object) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def risk(category: Column) -> Column:
    return _case(category, C.RISKS, "Low")


def risk_rank(of: Column) -> Column:
    return _case(of, {r: i for i, r in enumerate(C.RISK_ORDER)}, len(C.RISK_ORDER))


def sarif_level(of: Column) -> Column:
    return _case(of, C.SARIF_LEVELS, "note")


def severity_rank(category: Column) -> Column:
    return _case(category, {c: i for i, c in enumerate(C.SEVERITY_ORDER)}, 99)


def html_severity(category: Column) -> Column:
    return _case(category, C.HTML_SEVERITY, "LOW")


def normalized_endpoint(v: Column) -> Column:
    """An endpoint without trailing slashes, its query's parts sorted."""
    bare = F.regexp_replace(v, "/+$", "")
    at = F.instr(bare, "?")
    query = F.array_join(F.array_sort(F.split(F.substring(bare, at + 1, F.length(bare)), "&")), "&")
    return F.when(at > 0, F.concat(F.substring(bare, F.lit(1), at), query)).otherwise(bare)


def export_key() -> Column:
    """What findings of one category are told apart by: the value, normalised if it is an endpoint."""
    return F.when(F.col("category") == "endpoints", normalized_endpoint(F.col("value"))).otherwise(F.col("value"))


def deduplicate(findings: DataFrame, keep_sources: bool = False) -> DataFrame:
    """One finding of each category and normalised value over all documents: the first by insertion; all sources, if asked for."""
    rest = [c for c in findings.columns if c not in ("category", *INSERTION)]
    more = [F.sort_array(F.collect_set("source")).alias("sources")] if keep_sources else []
    best = findings.withColumn("norm", export_key()).groupBy("category", "norm").agg(F.min(F.struct(*INSERTION, *rest)).alias("x"), *more)
    return best.select("category", "norm", "x.*", *(["sources"] if keep_sources else [])).drop("norm")


def category_totals(findings: DataFrame) -> DataFrame:
    """(category, n), and the grand total under category `total`."""
    return findings.rollup("category").agg(F.count("*").alias("n")).select(F.coalesce("category", F.lit("total")).alias("category"), "n")


def risk_rollup(findings: DataFrame) -> DataFrame:
    """(risk, category, n, risk_rank) of each category with findings."""
    return findings.groupBy("category").agg(F.count("*").alias("n")).select(risk(F.col("category")).alias("risk"), "category", "n", risk_rank(risk(F.col("category"))).alias("risk_rank"))


def top_per_category(findings: DataFrame, k: int = 20) -> DataFrame:
    """The first k findings of each category by insertion, each with how many more there are.

    Local tops are found before the shuffle: Spark plans a group limit for the rank, so a category's whole rows never meet.
    """
    order = Window.partitionBy("category").orderBy(*INSERTION, "value")
    first = findings.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    counts = findings.groupBy("category").agg(F.count("*").alias("n"))
    return first.join(F.broadcast(counts), "category").withColumn("more", F.greatest(F.col("n") - k, F.lit(0)))


def top_secrets(findings: DataFrame, k: int = 5) -> DataFrame:
    """The first k secrets by insertion."""
    return findings.where("category = 'secrets'").orderBy(*INSERTION, "value").limit(k)


def per_file(findings: DataFrame) -> DataFrame:
    """(category, source, n)."""
    return findings.groupBy("category", "source").agg(F.count("*").alias("n"))


def files_per_category(findings: DataFrame) -> DataFrame:
    """(category, files, n)."""
    return findings.groupBy("category").agg(F.countDistinct("source").alias("files"), F.count("*").alias("n"))


def by_severity(findings: DataFrame) -> DataFrame:
    """(category, n, severity, rank) of categories with findings."""
    return findings.groupBy("category").agg(F.count("*").alias("n")).withColumns({"severity": html_severity(F.col("category")), "rank": severity_rank(F.col("category"))})


def search(findings: DataFrame, term: str) -> DataFrame:
    """Findings of which value, source or line holds a term, in either case."""
    holds = lambda c: F.contains(F.lower(F.col(c).cast("string")), F.lit(term.lower()))
    return findings.where(holds("value") | holds("source") | holds("line"))


def in_category(findings: DataFrame, category: str) -> DataFrame:
    """line, value and the last part of the source of one category's findings."""
    return findings.where(F.col("category") == category).select("line", "value", F.substring_index("source", "/", -1).alias("file"))


def without_dots(path: Column) -> Column:
    """A path from the root with its segments `.` and `..` followed; a `..` too many is dropped."""
    parts = F.split(path, "/", -1)
    dots = lambda p: p.isin(".", "..")
    followed = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.array().cast("array<string>"),
        lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(p == ".", a).otherwise(F.array_append(a, p)),
        lambda a: F.concat(F.lit("/"), F.array_join(F.when(dots(F.element_at(parts, -1)), F.array_append(a, F.lit(""))).otherwise(a), "/")),
    )
    return F.when(F.exists(parts, dots), followed).otherwise(path)


def resolved(endpoints: DataFrame, base: str) -> DataFrame:
    """endpoints (value, ...) with resolved_url against a base; values that do not begin with a slash have none."""
    base = base if base.startswith(("http://", "https://")) else f"https://{base}"
    scheme, _, rest = base.partition("://")
    root, v = f"{scheme}://{rest.split('/')[0]}", F.col("value")
    path = F.concat(without_dots(F.regexp_extract(v, "^[^?#]*", 0)), F.regexp_extract(v, "^[^?#]*((?s:.*))$", 1))
    return endpoints.withColumn("resolved_url", F.when(F.startswith(v, F.lit("//")), F.concat(F.lit(f"{scheme}:"), v)).when(F.startswith(v, F.lit("/")), F.concat(F.lit(root), path)))


_VERSION = "/v([0-9]+)(?:\\.[0-9]+)?/"


def _version(value: Column) -> Column:
    """The version that a value names, null for none, or one of over 18 digits."""
    return F.when(value.rlike(_VERSION), F.regexp_extract(value, _VERSION, 1)).try_cast("long")


def api_versions(endpoints: DataFrame) -> DataFrame:
    """(version, n): the versions that endpoints name, and how many do."""
    return endpoints.select(_version(F.col("value")).alias("version")).where("version IS NOT NULL").groupBy("version").agg(F.count("*").alias("n"))


def version_suggestions(endpoints: DataFrame, most: int = 50) -> DataFrame:
    """The first `most` endpoints, by template and version, of every template with every version up to two beyond the greatest."""
    named = endpoints.select(F.regexp_replace("value", _VERSION, "/v{VERSION}/").alias("template"), _version(F.col("value")).alias("version")).where("version IS NOT NULL")
    # both sides read one shuffle of the same columns, so endpoints are found once
    newest = named.groupBy("template").agg(F.max("version").alias("newest"))
    greatest = newest.agg(F.max("newest").alias("top")).where("top IS NOT NULL")
    # a template gives no more than `most`, whatever the greatest version is; the first templates are enough
    templates = newest.orderBy("template").limit(most)
    last = F.least(F.greatest("top", "newest") + 2, F.lit(most))
    each = templates.join(F.broadcast(greatest), F.lit(True)).select("template", F.explode(F.sequence(F.lit(1).cast("long"), last)).alias("version"))
    return each.select("template", "version", F.replace("template", F.lit("{VERSION}"), F.col("version").cast("string")).alias("suggestion")).orderBy("template", "version").limit(most)


def redact(findings: DataFrame, fully: bool = False) -> DataFrame:
    """findings with the values of secrets reduced to their ends, behind the label."""
    v = F.col("value")
    at = F.instr(v, ": ")
    hidden = F.when(at > 0, F.concat(F.substring(v, F.lit(1), at + 1), redacted(F.substring(v, at + 2, F.length(v)), fully))).otherwise(redacted(v, fully))
    return findings.withColumn("value", F.when(F.col("category") == "secrets", hidden).otherwise(v))


def postman_items(findings: DataFrame, base: str = "") -> DataFrame:
    """(name, url, source, line): endpoints that differ when normalised, then URLs that they do not cover."""
    ends = findings.where("category = 'endpoints'").withColumn("norm", normalized_endpoint(F.col("value")))
    first = lambda df, key: df.groupBy(key).agg(F.min(F.struct(*INSERTION, "value", "line")).alias("x")).select(key, "x.*")
    own = first(ends, "norm")
    v = F.col("value")
    url = F.when(F.startswith(v, F.lit("/")) & F.lit(bool(base)), F.concat(F.lit(base.rstrip("/")), v)).otherwise(v)
    urls = first(findings.where("category = 'urls' AND value LIKE 'http%'").withColumn("norm", v), "norm").join(own.select("norm"), "norm", "left_anti")
    return own.select(v.alias("name"), url.alias("url"), "source", "line").unionByName(urls.select(F.substring("value", 1, 60).alias("name"), v.alias("url"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("line")))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(rule_index, category, level, message, uri, start_line): rules are numbered by their first finding's insertion."""
    rules = findings.groupBy("category").agg(F.min(F.struct(*INSERTION)).alias("x"))
    # one row a category
    index = rules.withColumn("rule_index", F.row_number().over(Window.orderBy("x", "category")) - 1).select("category", "rule_index")
    return findings.join(F.broadcast(index), "category").select("rule_index", "category", sarif_level(risk(F.col("category"))).alias("level"), F.col("value").alias("message"), F.col("source").alias("uri"), F.greatest("line", F.lit(1)).alias("start_line"))


def has_secrets(findings: DataFrame) -> bool:
    """The gate of a commit hook."""
    return not findings.where("category = 'secrets'").limit(1).isEmpty()


def vulnerability_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(C.VULNERABLE, "package string, below string, cve string, severity string")


def version_numbers(v: Column) -> Column:
    """The first three numbers of a version, missing ones 0; one of over 38 digits counts as the greatest of 38."""
    number = lambda p: F.coalesce(p.try_cast("decimal(38,0)"), F.lit("9" * 38).cast("decimal(38,0)"))
    parts = F.transform(F.filter(F.split(F.regexp_replace(v, "[^0-9.]", ""), "\\."), lambda p: p != ""), number)
    return F.slice(F.concat(parts, F.array(F.lit(0), F.lit(0), F.lit(0)).cast("array<decimal(38,0)>")), 1, 3)


def vulnerable(dependencies: DataFrame, table: DataFrame) -> DataFrame:
    """(package, installed, fixed_in, cve, severity) of dependencies (package, installed) below a table's versions; Spark broadcasts a small table itself."""
    found = dependencies.join(table, "package").where((F.regexp_replace("installed", "[^0-9.]", "") != "") & (version_numbers(F.col("installed")) < version_numbers(F.col("below"))))
    return found.select(*(c for c in dependencies.columns if c != "installed"), "installed", F.col("below").alias("fixed_in"), "cve", "severity")


def dependencies_of(packages: DataFrame) -> DataFrame:
    """(path, package, installed) of packages (path, dependencies, devDependencies); those for development win."""
    rows = packages.select("path", F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.col("dependencies").alias("m")), F.struct(F.lit(1).alias("rank"), F.col("devDependencies").alias("m")))).alias("x"))
    each = rows.select("path", "x.rank", F.explode("x.m").alias("package", "installed"))
    return each.groupBy("path", "package").agg(F.max_by("installed", "rank").alias("installed"))
