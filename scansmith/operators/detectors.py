"""Detectors beside the core passes: frameworks, environment variables, bundler definitions, providers of content."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansmith import catalog as C
from scansmith.catalog import Pattern
from scansmith.functions.text import java

_OPERATOR = "\\s*(?:\\|\\||&&|\\?\\?)"
ENV_RISK = [
    Pattern(19, 0, "debug", "Env Injection Risk", f"process\\.env\\.([A-Z_]{{3,}})\\b(?!{_OPERATOR})", 1, False, False, ("process.env.",), "nonempty", "labelled", "Env injection risk")
]


def extras(found: DataFrame) -> DataFrame:
    """found with what its pass adds: framework, default of a variable, and the text that goes with it."""
    order, default = F.col("pass_ord"), F.substring(F.coalesce("after", F.lit("")), 1, 50).rlike(f"(?U)^{_OPERATOR}\\s*[\"']")
    env = order == 16
    value = F.when(env & ~default, F.concat("value", F.lit(" (no default)"))).when(order == 19, F.concat(F.lit("Env injection risk: process.env."), F.col("raw"), F.lit(" (no default)"))).otherwise(F.col("value"))
    return found.withColumns({"source_framework": F.when(order == 15, F.col("type")), "has_default": F.when(env, default), "env_risk": F.when(env, ~default), "value": value})


def frameworks(text: Column) -> Column:
    """The frameworks that a text shows signs of, in order."""
    seen = [F.when(text.rlike(java("|".join(f"(?:{r})" for r in signs))), F.lit(name)) for name, signs in C.FRAMEWORKS.items()]
    return F.filter(F.array(*seen), lambda x: x.isNotNull())


DEFINE = Pattern(17, 0, "debug", "Webpack DefinePlugin", "new\\s+webpack\\.DefinePlugin\\s*\\(\\s*\\{([^}]+)\\}", needles=("webpack.defineplugin",), closing="\\}")
_ENTRY = java("[\"']?([A-Z_][A-Z_0-9.]*)[\"']?\\s*:\\s*(?:JSON\\.stringify\\s*\\(\\s*)?[\"']([^\"']+)[\"']")


def define_entries(block: Column) -> Column:
    """What findings say of the entries of a bundler's definition block, in order."""
    pairs = F.arrays_zip(F.regexp_extract_all(block, F.lit(_ENTRY), F.lit(1)).alias("k"), F.regexp_extract_all(block, F.lit(_ENTRY), F.lit(2)).alias("v"))
    return F.transform(pairs, lambda x: F.concat(F.lit("DefinePlugin: "), x["k"], F.lit(" = "), x["v"]))


def provider(host: Column) -> Column:
    """The provider whose ending fits a host first; null for none."""
    return reduce(lambda c, e: c.when(F.endswith(host, F.lit(e[0])), e[1]), C.CDN_PROVIDERS[1:], F.when(F.endswith(host, F.lit(C.CDN_PROVIDERS[0][0])), C.CDN_PROVIDERS[0][1]))


def providers_of(hosts: DataFrame, table: DataFrame) -> DataFrame:
    """(host, provider) of hosts (host) with the provider of table (ending, provider, ord) whose ending fits first; each host once.

    A host's endings, of the lengths that the table has, meet the table in an equality join, however many rows that has.
    """
    rules = table.where("ending IS NOT NULL AND ending <> ''")
    lengths = sorted(r["n"] for r in rules.select(F.length("ending").alias("n")).distinct().collect())  # a number a length
    fits = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("host"))
    ends = hosts.select("host").distinct().select("host", F.explode(F.transform(fits, lambda n: F.right("host", n))).alias("ending"))
    return ends.join(rules, "ending").groupBy("host").agg(F.min_by("provider", F.struct("ord", "ending")).alias("provider"))


def cdn_summary(docs: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """(source, provider, count, domains): how often a document names hosts of each provider, and which; of the known ones, or of a table (ending, provider, ord)."""
    hosts = docs.select("source", F.explode(F.regexp_extract_all("text", F.lit("https?://([a-zA-Z0-9.-]+)"), F.lit(1))).alias("host")).withColumn("host", F.lower("host"))
    if table is None:
        known = hosts.withColumn("provider", provider(F.col("host"))).where("provider IS NOT NULL").withColumn("n", F.lit(1))
    else:  # hosts are counted before they are joined, so a common one is a row a document
        counted = hosts.groupBy("source", "host").agg(F.count("*").alias("n"))
        known = counted.join(providers_of(counted, table), "host")
    return known.groupBy("source", "provider").agg(F.sum("n").cast("long").alias("count"), F.sort_array(F.collect_set("host")).alias("domains"))


def document_summary(docs: DataFrame) -> DataFrame:
    """(kind, name, n, domains) over all docs (source, text), read once: their number, the documents with signs of each framework, and how often each provider is named, by how many hosts."""
    hosts = F.transform(F.regexp_extract_all("text", F.lit("https?://([a-zA-Z0-9.-]+)"), F.lit(1)), F.lower)
    row = lambda kind, name, host: F.struct(F.lit(kind).alias("kind"), name.alias("name"), host.alias("host"))
    none = F.lit(None).cast("string")
    told = F.concat(
        F.array(row("document", none, none)),
        F.coalesce(F.transform(frameworks(F.col("text")), lambda f: row("framework", f, none)), F.array()),
        F.coalesce(F.filter(F.transform(hosts, lambda h: row("provider", provider(h), h)), lambda x: x["name"].isNotNull()), F.array()),
    )
    return docs.select(F.explode(told).alias("x")).select("x.*").groupBy("kind", "name").agg(F.count("*").alias("n"), F.countDistinct("host").alias("domains"))
