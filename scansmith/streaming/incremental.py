"""Scans of what is new: a file stream whose checkpoint remembers what was read, and totals that follow each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scansmith.operators.findings import INSERTION, export_key
from scansmith.plans.scan import FINDINGS, ScanOptions, scan
from scansmith.sources.files import documents
from scansmith.sources.state import KeyedState

_FILE = "path string, modificationTime timestamp, length long, content binary"


_REST = [f.split()[0] for f in FINDINGS.split(", ") if f.split()[0] not in ("category", *INSERTION)]


def _firsts(rows: DataFrame) -> DataFrame:
    """Of each category and export key the first finding by insertion, and how many there are."""
    best = rows.groupBy("category", "norm").agg(F.min(F.struct(*INSERTION, *_REST)).alias("x"), F.sum("n").alias("n"))
    return best.select("category", "norm", "x.*", "n")


def running(spark: SparkSession, path: str) -> KeyedState:
    """The state of a stream of findings: the first one of each category and export key, and their number."""
    return KeyedState(spark, path, f"{FINDINGS}, norm string, n bigint", _firsts)


def follow(state: KeyedState, findings: DataFrame, batch: int | None = None) -> int:
    """Add a batch's findings; each document is in one batch. A batch whose number was added before is not added again."""
    return state.add(_firsts(findings.withColumns({"norm": export_key(), "n": F.lit(1).cast("bigint")})), batch)


def running_findings(state: KeyedState) -> DataFrame:
    """What `deduplicate` gives for the findings of all batches."""
    return state.read().drop("norm", "n")


def running_totals(state: KeyedState) -> DataFrame:
    """(category, n, kept): the findings of all batches, and those that `deduplicate` keeps; the grand totals under `total`."""
    sums = state.read().rollup("category").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("norm").alias("kept"))
    return sums.select(F.coalesce("category", F.lit("total")).alias("category"), "n", "kept")


def scan_stream(spark: SparkSession, root: str, out: str, checkpoint: str, options: ScanOptions = ScanOptions(), totals: str | None = None) -> StreamingQuery:  # noqa: B008
    """Findings of each script below root that was not scanned before, appended to out as Parquet.

    A batch's findings are first of their document, so batches are independent; a repeated batch overwrites its own folder.
    totals: a folder whose state (`running`) follows each batch, once, also where a batch is repeated after a restart.
    """
    files = spark.readStream.format("binaryFile").schema(_FILE).option("pathGlobFilter", "*.js").option("recursiveFileLookup", "true").load(root)

    def write(batch: DataFrame, number: int) -> None:
        place = f"{out}/batch={number}"
        scan(documents(batch), options).write.mode("overwrite").parquet(place)
        if totals:
            follow(running(spark, totals), spark.read.schema(FINDINGS).parquet(place), number)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
