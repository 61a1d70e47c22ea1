"""Scans of folders: collect scripts, leave out what an ignore file names and what has not changed, scan, and remember."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scansmith.plans.scan import ScanOptions, scan
from scansmith.sources import files as S
from scansmith.sources.state import KeyedState

_LEDGER = "path string, length bigint, sha256 string, error string"


def checksums(spark: SparkSession, cache: str) -> KeyedState:
    """The state below a folder: the checksum of the last scan of each file."""
    return KeyedState(spark, cache, "path string, sha256 string, run bigint", lambda t: t.groupBy("path").agg(F.max_by("sha256", "run").alias("sha256"), F.max("run").alias("run")))


def remembered(spark: SparkSession, cache: str) -> DataFrame:
    """(path, sha256) of the last scan of each file, from a cache folder that may not be there yet."""
    return checksums(spark, cache).read().select("path", "sha256")


def _counts(ledger: DataFrame) -> tuple[DataFrame, Observation]:
    """A ledger that counts, while it is written, what a report says of its files."""
    seen = Observation("files")
    tells = lambda error: F.count_if(F.col("error") == error)
    return ledger.observe(seen, F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), tells(S.TOO_LARGE).alias("too_large"), tells(S.NO_TEXT).alias("no_text")), seen


def ledger_of(spark: SparkSession, out: str, run: int) -> DataFrame:
    """(path, length, sha256, error) of the files that a run took up; those too large at every run."""
    return spark.read.schema(_LEDGER).parquet(f"{out.rstrip('/')}/_files/run={run}")


def rejects(spark: SparkSession, out: str, run: int) -> DataFrame:
    """(path, length, error) of a run's files that were not scanned, or not as they are."""
    return ledger_of(spark, out, run).where("error IS NOT NULL").select("path", "length", "error")


def scan_run(spark: SparkSession, root: str, out: str, options: ScanOptions = ScanOptions(), ignore: bool = True, cache: str | None = None) -> tuple[DataFrame, dict]:  # noqa: B008
    """The findings of the scripts below root, also written to a folder of this run below out, and what is to be said of the run.

    ignore: leave out what root's ignore file names. cache: a folder with the checksums of what was scanned; unchanged files
    are left out, and this run's checksums are added once its findings are written, so a run that fails is repeated whole.
    The run's number and the counts of its files (files, bytes, too_large, no_text) are those of a report's head; the files
    themselves, with what is wrong with each, are a table below out (`ledger_of`, `rejects`).
    """
    rules = S.ignore_rules(spark, root) if ignore else None
    state = checksums(spark, cache) if cache else None
    run = state.version() + 1 if state else 0
    ledger = S.ledger(spark, root, rules)
    if state:  # files without a checksum are none of the cache's
        ledger = ledger.join(state.read().select("path", "sha256"), ["path", "sha256"], "left_anti")
    counted, seen = _counts(ledger.select("path", "length", "sha256", "error"))
    counted.write.mode("overwrite").parquet(f"{out.rstrip('/')}/_files/run={run}")
    taken = ledger_of(spark, out, run).where("sha256 IS NOT NULL").select("path", "sha256")
    files = S.script_files(spark, root, rules).join(taken.select("path"), "path", "left_semi")
    path = f"{out.rstrip('/')}/run={run}"
    scan(S.documents(files), options).write.mode("overwrite").parquet(path)
    told = {"run": run, **{k: int(v) for k, v in seen.get.items()}}
    if state and told["files"] > told["too_large"]:  # a run without files leaves its number to the next
        state.add(taken.withColumn("run", F.lit(run).cast("bigint")), run)
    return spark.read.parquet(path), told


def scan_folder(spark: SparkSession, root: str, out: str, options: ScanOptions = ScanOptions(), ignore: bool = True, cache: str | None = None) -> DataFrame:  # noqa: B008
    """The findings of scan_run alone."""
    return scan_run(spark, root, out, options, ignore, cache)[0]
