"""Sources: folders of scripts, ignore rules, checksums, package manifests, version-control metadata."""

from __future__ import annotations

import re

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scansmith.catalog import EXCLUDED_FOLDERS, MAX_FILE_BYTES
from scansmith.functions.text import strip


def decoded(content: Column) -> Column:
    """Bytes as text: invalid UTF-8 is dropped (and with it U+FFFD of such a text), and every line end is a line feed."""
    text = content.cast("string")
    valid = F.when(F.is_valid_utf8(text), text).otherwise(F.replace(F.make_valid_utf8(text), F.lit("\ufffd"), F.lit("")))
    return F.regexp_replace(valid, "\r\n?", "\n")


def _relative(path: Column, root: str) -> Column:
    bare = re.sub(r"^[a-z0-9]+:/*", "/", root).rstrip("/")
    return F.regexp_replace(F.regexp_replace(path, "^[a-z0-9]+:/*", "/"), f"^{re.escape(bare)}/", "")


def ignore_regex(rule: str) -> tuple[str, bool] | None:
    """A Java expression for one line of an ignore file, over paths below its folder, and whether it re-includes."""
    line = rule.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    again = line.startswith("!")
    line = line[1:] if again else line
    folder, line = line.endswith("/"), line.rstrip("/")
    rooted, line = "/" in line, line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            end = line.index("]", i + 1)
            out, i = out + line[i : end + 1].replace("[!", "[^"), end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return f"^{'' if rooted else '(?:.*/)?'}{out}{'/.+' if folder else '(?:/.+)?'}$", again


def _compiles(regex: str) -> bool:
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(regex)
    except IllegalArgumentException:
        return False
    return True


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether the last rule that fits a relative path ignores it; a rule that is no valid expression fits none.

    All rules are one alternation, the last one first, so that its first branch that fits decides. A branch that ignores
    takes up the path and one that re-includes looks ahead, so what was taken up tells which it was.
    """
    found = [r for r in map(ignore_regex, reversed(rules)) if r]
    branches = [f"(?={regex})" if again else regex for regex, again in found]
    if not branches:
        return F.lit(False)
    if not _compiles("|".join(branches)):
        branches = list(filter(_compiles, branches))
    return F.regexp_extract(path, "|".join(branches) or "$.", 0) != ""


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def there(spark: SparkSession, path: str) -> bool:
    files, where = _files(spark, path)
    return files.exists(where)


def small_text(spark: SparkSession, path: str) -> str | None:
    """The text of one small file, null if missing; also of hidden ones, which Spark's readers pass over."""
    files, where = _files(spark, path)
    if not files.exists(where):
        return None
    stream = files.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def ignore_rules(spark: SparkSession, root: str) -> list[str]:
    """The lines of the ignore file of a folder, none if it has none."""
    return (small_text(spark, f"{root.rstrip('/')}/.gitignore") or "").splitlines()


def listed(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """(path, length, content, ...) of scripts of any size below root, not in excluded folders or ignored; content is read if it is used."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.js").option("recursiveFileLookup", "true").load(root)
    parts = F.split(F.regexp_replace("path", "^[a-z0-9]+:/*", "/"), "/")
    kept = found.where(~F.exists(parts, lambda p: p.isin(EXCLUDED_FOLDERS)))
    return kept.where(~ignored(_relative(F.col("path"), root), rules)) if rules else kept


def script_files(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """The scripts that are listed and not too large. Only paths and lengths are tested before content is read."""
    return listed(spark, root, rules).where(F.col("length") <= MAX_FILE_BYTES)


#: What may be wrong with a script: it is left out, or scanned without the bytes that are no text.
TOO_LARGE, NO_TEXT = "too large", "bytes that are no text"


def ledger(spark: SparkSession, root: str, rules: list[str] | None = None) -> DataFrame:
    """(path, length, sha256, error) of all scripts that are listed. Those too large are not read and have no checksum."""
    bad = F.when(~F.is_valid_utf8(F.col("content").cast("string")), NO_TEXT)
    read = with_checksum(script_files(spark, root, rules)).select("path", "length", "sha256", bad.alias("error"))
    large = listed(spark, root, rules).where(F.col("length") > MAX_FILE_BYTES)
    return read.unionByName(large.select("path", "length", F.lit(None).cast("string").alias("sha256"), F.lit(TOO_LARGE).alias("error")))


def with_checksum(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", F.sha2("content", 256))


def changed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (path, sha256, ...) of which the cache (path, sha256) has another checksum or none."""
    return files.join(cache.select("path", "sha256"), ["path", "sha256"], "left_anti")


def documents(files: DataFrame) -> DataFrame:
    """(source, text) of files (path, content)."""
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("source"), decoded(F.col("content")).alias("text"))


_MANIFEST = "name string, version string, dependencies map<string,string>, devDependencies map<string,string>, scripts map<string,string>"


def _is_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def manifest_errors(texts: DataFrame) -> DataFrame:
    """(path, error, text) of texts (path, text) that manifests leaves out, or of which it takes a field of another shape for none."""
    whole = F.from_json("text", f"{_MANIFEST}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    error = F.when(~_is_object(F.col("text")), "no JSON object").when(whole["_bad"].isNotNull(), "a field of another shape")
    return texts.select("path", error.alias("error"), "text").where("error IS NOT NULL")


def manifests(texts: DataFrame) -> DataFrame:
    """(path, name, version, dependencies, devDependencies, scripts) of texts (path, text) that hold a package manifest."""
    empty = F.create_map().cast("map<string,string>")
    read = texts.where(_is_object(F.col("text"))).select("path", F.from_json("text", _MANIFEST).alias("m"))
    maps = {c: F.coalesce(f"m.{c}", empty) for c in ("dependencies", "devDependencies", "scripts")}
    return read.select("path", F.coalesce("m.name", F.lit("unknown")).alias("name"), F.coalesce("m.version", F.lit("0.0.0")).alias("version"), *(x.alias(c) for c, x in maps.items()))


def package_manifests(spark: SparkSession, root: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "package.json").load(root)
    return manifests(files.select("path", decoded(F.col("content")).alias("text")))


def git_metadata(heads: DataFrame) -> DataFrame:
    """(root, branch, commit, exposed_config, remotes) of heads (root, head, ref_text, config): the texts of a repository's files, null if missing."""
    head = strip(F.col("head"))
    on_branch = F.startswith(head, F.lit("ref: refs/heads/"))
    branch = F.when(on_branch, F.regexp_replace(head, "ref: refs/heads/", "")).when(head.isNotNull(), F.lit("detached"))
    commit = F.when(on_branch, F.substring(strip(F.col("ref_text")), 1, 12)).otherwise(F.substring(head, 1, 12))
    remotes = F.transform(F.regexp_extract_all("config", F.lit("url\\s*=\\s*(.+)"), F.lit(1)), strip)
    return heads.select("root", branch.alias("branch"), commit.alias("commit"), F.col("config").isNotNull().alias("exposed_config"), remotes.alias("remotes"))


def git_folder(spark: SparkSession, root: str) -> DataFrame:
    """git_metadata of the repository of a folder; no row if it is none."""
    git = f"{root.rstrip('/')}/.git"
    head, ref = small_text(spark, f"{git}/HEAD"), None
    if head and head.strip().startswith("ref: refs/heads/"):
        ref = small_text(spark, f"{git}/{head.strip().removeprefix('ref: ')}")
    rows = [(root, head, ref, small_text(spark, f"{git}/config"))] if there(spark, git) else []
    return git_metadata(spark.createDataFrame(rows, "root string, head string, ref_text string, config string"))


def introspected(responses: DataFrame) -> DataFrame:
    """(source, type_name, kind) of the schema in responses (source, text) to an introspection query; nothing is fetched."""
    schema = "data struct<__schema:struct<types:array<struct<name:string,kind:string>>>>"
    return responses.select("source", F.explode(F.from_json("text", schema)["data"]["__schema"]["types"]).alias("t")).select("source", F.col("t.name").alias("type_name"), "t.kind")


def valid_url(u: Column) -> Column:
    return F.coalesce(F.try_parse_url(u, F.lit("PROTOCOL")).isin("http", "https") & F.try_parse_url(u, F.lit("HOST")).isNotNull(), F.lit(False))
