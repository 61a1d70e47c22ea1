"""scan(): documents to findings, one plan.

Project (undo obfuscation) - generate (patterns that may match) - generate (their matches) - filter (checks) - first of each
(document, category, value). Text is read once, whatever the options, and never shuffled; what is shuffled are findings, after
a partial aggregation. Only the option `ast` sends texts to Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scansmith import catalog as C
from scansmith.catalog import Pattern
from scansmith.functions import text as T
from scansmith.operators import calls, detectors, secrets_score
from scansmith.operators.match import candidates, clipped, marked, matches, present
from scansmith.operators.validate import CHECKS

FINDINGS = (
    "category string, value string, source string, line int, type string, raw_len int, confidence string, entropy double, validated boolean, "
    "source_framework string, has_default boolean, env_risk boolean, pass_ord int, pat_ord int, match_ord int"
)


@dataclass(frozen=True)
class ScanOptions:
    """What a scan does besides the core passes, and which categories it looks for."""

    deobfuscate: bool = True  # without it, ast still does
    ast: bool = False  # endpoints among the arguments of calls
    entropy: bool = False
    frameworks: bool = False
    categories: tuple[str, ...] = C.CATEGORIES


CALLS = Pattern(2, 0, "endpoints", None, "", check="endpoint")  # pass 2, which has no expression
# Passes whose values are shown as they are, and those of special kinds.
AS_FOUND, ENVIRONMENT, ORIGINS = (5, 15, 16, 17, 18, 21), 16, 22


def patterns_of(options: ScanOptions) -> list[Pattern]:
    """The patterns of a scan, in the order in which they find."""
    found = [*C.CORE, *C.SWAGGER, *detectors.ENV_RISK, *C.WASM, *C.STORAGE, *C.CORS]
    found += [*C.JWT_SECRETS, *C.ADMIN_CREDENTIALS, *secrets_score.HIGH_ENTROPY] if options.entropy else []
    found += [*C.FRAMEWORK_ENDPOINTS, *C.ENV_VARS, detectors.DEFINE] if options.frameworks else []
    found += [CALLS] if options.ast else []
    return sorted((p for p in found if p.category in options.categories), key=lambda p: (p.order, p.ordinal))


def entries(blocks: Column) -> Column:
    """The entries of matched definition blocks as matches of their own, numbered through."""
    one = lambda m: F.transform(detectors.define_entries(m["value"]), lambda e: m.withField("value", e))
    return F.transform(F.flatten(F.transform(blocks, one)), lambda m, i: m.withField("match_ord", i.cast("int")))


def exploded(rows: DataFrame, many: Column, one: str, *more: Column | str) -> DataFrame:
    """A row for each element of an array. An inner explode would make Spark filter by the array's size too, and so compute it twice."""
    return rows.select(*more, F.explode_outer(many).alias(one)).where(F.col(one).isNotNull())


def raw_matches(docs: DataFrame, options: ScanOptions) -> DataFrame:
    """Every match of docs (source, text), before checks: source, category, type, check, shown, prefix, value, line, ..."""
    patterns = patterns_of(options)
    told = lambda what: F.element_at(F.array(*(F.lit(what(p)) for p in patterns)), F.col("place") + 1)
    text, place = F.coalesce(F.col("text"), F.lit("")), F.col("place")
    ready = docs.select("source", (T.deobfuscated(text) if options.deobfuscate or options.ast else text).alias("text"))
    other = [calls.call_matches(F.col("text")).alias("calls")] if CALLS in patterns else []
    ready = ready.select("source", "text", F.lower("text").alias("low"), *other)
    ready = ready.withColumn("marks", marked(F.col("low"), patterns))
    # an open run is searched in a clipped text only
    shown = lambda p: F.lit(True) if p.closing else F.col("text").rlike(T.java_of(p))
    may = [F.size("calls") > 0 if p is CALLS else present(F.col("low"), p) & shown(p) for p in patterns]
    # a lambda in the projection keeps the conditions out of whole-stage code, where they are one method that is too long to be compiled
    apart = T.let(F.col("text"), lambda t: t).alias("text")
    hit = ready.select("source", apart, candidates(F.col("low"), patterns, may, F.col("marks")).alias("places"), *["calls"] * len(other))
    hit = exploded(hit, F.col("places"), "place", "source", "text", *["calls"] * len(other))
    # texts of a pattern come one after the other, so that its expressions are compiled once a task and not for each text
    hit = hit.sortWithinPartitions("place")
    scored = [k for k, p in enumerate(patterns) if p.order == C.SECRET_PASS] if options.entropy else []
    doubts = F.when(place.isin(scored), secrets_score.doubtful_lines(F.col("text"))) if scored else F.lit(None).cast("array<boolean>")
    known = hit.withColumns({"regex": told(T.java_of), "group": told(lambda p: p.group), "closing": told(T.closing_of)})
    found = T.let(clipped(F.col("text"), F.col("closing")), lambda t: matches(t, F.col("regex"), F.col("group")))
    if CALLS in patterns:
        found = F.when(place == patterns.index(CALLS), F.col("calls")).otherwise(found)
    if detectors.DEFINE in patterns:  # an entry is a finding, on its block's line
        found = F.when(place == patterns.index(detectors.DEFINE), T.let(found, entries)).otherwise(found)
    found = exploded(known, found, "m", "source", "place", doubts.alias("doubts")).select("source", "place", "m.*", F.try_element_at("doubts", F.col("m.line")).alias("doubtful"))
    named = {"pass_ord": lambda p: p.order, "pat_ord": lambda p: p.ordinal, "category": lambda p: p.category, "type": lambda p: p.label or None, "check": lambda p: p.check, "shown": lambda p: p.shown, "prefix": lambda p: p.prefix}
    found = found.withColumns({name: told(what) for name, what in named.items()}).drop("place")
    value = F.when(F.col("pass_ord").isin(*AS_FOUND), F.col("value")).otherwise(T.strip(F.col("value")))
    # what is exploded is computed once, not again in each condition that is pushed down to it
    return found.select(*(F.explode_outer(F.array(value)).alias(c) if c == "value" else c for c in found.columns))


def checked(found: DataFrame) -> DataFrame:
    """The matches that pass the check of their pattern."""
    v, good = F.col("value"), F.lit(False)
    for name, test in CHECKS.items():
        good = F.when(F.col("check") == name, test(v)).otherwise(good)
    # here too the lambda keeps the tests out of one method that is too long to be compiled
    return found.where(good & F.exists(F.array(v), lambda x: x.isNotNull()))


def displayed(found: DataFrame) -> DataFrame:
    """value as findings show it, and raw_len of secrets."""
    v, name = F.col("value"), F.coalesce("prefix", "type")
    shown = (
        F.when(F.col("shown") == "masked", F.concat(name, F.lit(": "), T.masked(v)))
        .when(F.col("shown") == "short", F.concat(name, F.lit(": "), T.shortened(v)))
        .when(F.col("shown") == "labelled", F.concat(name, F.lit(": "), v))
        .when(F.col("shown") == "constant", F.concat(name, F.lit(": "), F.col("type")))
        .otherwise(v)
    )
    return found.withColumn("raw_len", F.when(F.col("shown") == "masked", F.length(v))).withColumn("raw", v).withColumn("value", shown)


def first_wins(found: DataFrame, keys: tuple[str, ...] = ("source", "category", "value")) -> DataFrame:
    """One row for each key: that of least (pass, pattern, match), with all that it says."""
    order = ["pass_ord", "pat_ord", "match_ord"]
    rest = [c for c in found.columns if c not in (*keys, *order)]
    best = found.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("x"))
    return best.select(*keys, "x.*")


def scan(docs: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:  # noqa: B008
    """The findings of docs (source, text): columns of FINDINGS. A source is a document; null text is empty."""
    out = displayed(checked(raw_matches(docs, options)))
    if options.entropy:
        out = secrets_score.scored(out)
    else:
        out = out.withColumns({"confidence": F.lit(None).cast("string"), "entropy": F.lit(None).cast("double"), "validated": F.lit(None).cast("boolean")})
    out = detectors.extras(out)
    names = [f.split()[0] for f in FINDINGS.split(", ")]
    out = out.withColumn("type", F.when(F.col("pass_ord") == ORIGINS, F.lit("CORS Misconfiguration")).otherwise(F.col("type")))
    if options.frameworks:  # a variable counts once, whatever pattern found it
        env = F.col("pass_ord") == ENVIRONMENT
        keyed = out.select(*names, env.alias("env"), F.when(env, F.col("raw")).otherwise(F.col("value")).alias("key"))
        out = first_wins(keyed, ("source", "category", "env", "key"))
    return first_wins(out.select(names)).select(names)
