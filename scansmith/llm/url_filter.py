"""Operator 9: URL rules by a sort-merge range join.

A host's canonical key is its labels reversed, each followed by a dot (``blog.example.org`` is ``org.example.blog.``), so a
rule's host and all its subdomains are one interval of keys: those that begin with the rule's key. URLs and rules are dealt
to key ranges whose boundaries come from a sample of the URLs' (key, path, page_id hash), so a host or a whole URL that a
third of all rows share is spread over many ranges. A rule goes to each range that its interval meets. Within a range, rules
and URLs are swept in key order with a stack of the rules' keys that enclose the current one; an entry is popped once the
sweep has left its interval. A URL asks the stack from the innermost host outwards for the longest rule path that it starts
with.

The longest rule is the one with the most characters of host and path together, ties to the smaller text. Defined results:
a null URL or one without ``://`` has empty host and path and fits no rule; rule rows with a null host, path or verdict are
left out; of repeated rules block wins; with no rule the verdict is the method's default; repeated pages each get a row; no
pages give no rows; very long URLs are keys as they are; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_A_RANGE, SAMPLES_A_RANGE = 20_000, 32
MOST_RANGES = 10_000  # beyond it ranges grow: boundaries are one row a range
DEFAULT_VERDICT = "allow"
#: The rules that the query applies.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host (A-Z lower-cased) and path of the url; both empty if it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return pages.withColumn("host", F.translate(host, _UPPER, _LOWER)).withColumn("path", path)


def host_key(host: F.Column) -> F.Column:
    """The labels of a host reversed, each followed by a dot; the empty host has the empty key."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit(".")))


def _cuts(keyed: DataFrame, parts: int, count: int) -> list[tuple[str, str, int]]:
    """Boundaries at the quantiles of a sample of (key, path, salt), drawn by a hash of the row."""
    if parts < 2:
        return []
    chance = F.pmod(F.xxhash64("page_id", "salt", F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = sorted(tuple(r) for r in keyed.where(chance < parts * SAMPLES_A_RANGE / count).select("key", "path", "salt").collect())
    return sorted({drawn[len(drawn) * k // parts] for k in range(1, parts)}) if drawn else []


def _ranges(keyed: DataFrame, cuts: list[tuple[str, str, int]]) -> DataFrame:
    """keyed with the number of each row's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in ("key", "path", "salt")), strict=True)
            ranges = pa.array([bisect.bisect_right(cuts, r) for r in rows], pa.int64())
            if b.num_rows:
                yield pa.record_batch([*b.columns, ranges], [*b.schema.names, "range"])

    return keyed.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema) + ", range long")


def _spread(rules: DataFrame, cuts: list[tuple[str, str, int]]) -> DataFrame:
    """rules once for each range that the interval of their key meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_pylist()
            # every key of the interval lies between the rule's key and the key with a greatest character behind it
            spans = [(bisect.bisect_left(cuts, (k,)), bisect.bisect_left(cuts, (k + "\U0010ffff",))) for k in keys]
            at = pa.array([i for i, (lo, hi) in enumerate(spans) for _ in range(lo, hi + 1)], pa.int64())
            ranges = pa.array([r for lo, hi in spans for r in range(lo, hi + 1)], pa.int64())
            if b.num_rows:
                yield pa.record_batch([*(c.take(at) for c in b.columns), ranges], [*b.schema.names, "range"])

    return rules.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rules.schema) + ", range long")


class _Level:
    """The rules of one key: their paths, looked up by the lengths that occur."""

    def __init__(self, key: str) -> None:
        self.key, self.paths, self.lengths = key, {}, []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if path not in self.paths:
            if len(path) not in self.lengths:
                bisect.insort(self.lengths, len(path))
            self.paths[path] = (rule, verdict)
        elif verdict == "block":
            self.paths[path] = (rule, verdict)

    def longest(self, path: str) -> tuple[str, str] | None:
        for n in reversed(self.lengths):
            if n <= len(path) and (found := self.paths.get(path[:n])):
                return found
        return None


_RESULT = "page_id long, host string, path string, rule string, verdict string"


def sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """rule and verdict of the urls, in one pass over rules and urls (range, key, url, page_id, host, path, rule, verdict) by range, key, and rules first.

    What is held are the nested rules that are active at a key, however many rows a range has.
    """
    current, stack = None, []
    for b in batches:
        out = []
        for number, key, url, page_id, host, path, rule, verdict in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if number != current:
                current, stack = number, []
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if url:
                fits = [f for level in stack if (f := level.longest(path))]
                out.append((page_id, host, path, *(min(fits, key=lambda f: (-len(f[0]), f[0])) if fits else (None, default))))
                continue
            if not stack or stack[-1].key != key:
                stack.append(_Level(key))
            stack[-1].add(path, rule, verdict)
        if out:
            kinds = [pa.int64(), *[pa.string()] * 4]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "host", "path", "rule", "verdict"])


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """page_id, host, path, rule, verdict of every page (page_id, url), under rules (host, path, verdict)."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    keyed = with_parts(narrow).select("page_id", "host", "path", host_key(F.col("host")).alias("key"), F.xxhash64("page_id", "url").alias("salt"))
    count = narrow.count()
    cuts = _cuts(keyed, min(max(1, -(-count // rows_a_range)), MOST_RANGES), max(count, 1))
    good = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict").dropna()
    named = good.select(host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"), "verdict").where("key <> ''").distinct()
    null = lambda kind: F.lit(None).cast(kind)
    urls = _ranges(keyed, cuts).select("range", "key", F.lit(True).alias("url"), "page_id", "host", "path", null("string").alias("rule"), null("string").alias("verdict"))
    active = _spread(named, cuts).select("range", "key", F.lit(False).alias("url"), null("long").alias("page_id"), null("string").alias("host"), "path", "rule", "verdict")
    both = urls.unionByName(active).repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "key", "url")
    return both.mapInArrow(lambda batches: sweep(batches, default), _RESULT)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict under RULES."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP9_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST, r.host || r.path) AS k
  FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""
