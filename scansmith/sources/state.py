"""State that outlives runs: a table by key as one snapshot and a few deltas, versions of which are committed by one small file.

A run adds a delta, merged with nothing, so what it writes is as large as what is new. Once there are MOST_DELTAS of them, the
run that adds the next one merges all into a new snapshot; so any run reads one row a key and at most MOST_DELTAS deltas,
however many runs there were. A version is a file `v-<number>.json` that names its tables. It is moved into place without
replacing another, so a run that fails leaves the version before, and of two writers of one version the second one fails.
Tables of the version before stay for its readers; older ones, and what failed runs left, go.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scansmith.sources.files import _files, small_text

MOST_DELTAS = 8


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor and the driver see and which goes with the driver."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    files, where = _files(spark, path)
    files.mkdirs(where)
    files.deleteOnExit(where)
    return path


class KeyedState:
    """A table of schema below path, of which merge makes one row a key.

    merge: rows of some tables to one row a key; merging in any order and grouping must give the same, as with min and sum.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, merge: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.path, self.schema, self.merge = spark, path.rstrip("/"), schema, merge

    def _numbers(self) -> list[int]:
        files, where = _files(self.spark, self.path)
        names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
        return sorted(int(n[2:-5]) for n in names if n.startswith("v-") and n.endswith(".json"))

    def _manifest(self, number: int) -> dict:
        return json.loads(small_text(self.spark, f"{self.path}/v-{number:09d}.json") or "{}")

    def version(self) -> int:
        """The number of the last version, -1 if there is none."""
        return max(self._numbers(), default=-1)

    def _table(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{n}" for n in names))

    def read(self) -> DataFrame:
        """One row a key, of the last version."""
        last = self.version()
        tables = self._manifest(last)["tables"] if last >= 0 else []
        return self._table(tables) if len(tables) < 2 else self.merge(self._table(tables))

    def add(self, rows: DataFrame, number: int | None = None) -> int:
        """Merge rows (one a key) into the state as a version, the next one if no number is given; the version that holds now.

        A number that is already there changes nothing, so a repeated batch counts once.
        """
        last = self.version()
        number = last + 1 if number is None else number
        if number <= last:
            return last
        tables = self._manifest(last)["tables"] if last >= 0 else []
        columns = [f.split()[0] for f in self.schema.split(", ")]
        name = f"t-{number:09d}-{uuid.uuid4().hex}"
        rows = rows.select(columns)
        if len(tables) > MOST_DELTAS:
            rows, tables = self.merge(self._table(tables).unionByName(rows)).select(columns), []
        rows.write.parquet(f"{self.path}/{name}")
        self._commit(number, [*tables, name])
        return number

    def _commit(self, number: int, tables: list[str]) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        files, place = _files(self.spark, f"{self.path}/v-{number:09d}.json")
        draft = hadoop.Path(f"{self.path}/.{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(json.dumps({"tables": tables}).encode())
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        context = hadoop.FileContext.getFileContext(files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(place), options)
        except Exception:
            files.delete(draft, False)
            raise
        self._tidy(number)

    def _tidy(self, number: int) -> None:
        """Delete what neither a version nor the one before it names, up to that version; a table of a later one is being written."""
        numbers = [n for n in self._numbers() if n <= number]
        kept = {t for n in numbers[-2:] for t in self._manifest(n)["tables"]}
        files, where = _files(self.spark, self.path)
        for status in files.listStatus(where):
            name = status.getPath().getName()
            old_table = name.startswith("t-") and int(name[2:11]) <= number and name not in kept
            old_version = name.startswith("v-") and name.endswith(".json") and int(name[2:-5]) in numbers[:-2]
            if old_table or old_version:
                files.delete(status.getPath(), True)
