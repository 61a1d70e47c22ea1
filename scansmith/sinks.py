"""Whole reports as distributed files: a Spark data source that writes a document's fragments task by task.

A run has a folder of its own. Each task streams its rows into one fragment there; what is committed on the driver is an index
with the document's head, its tail and the fragments in the order of partitions, and last of all the pointer to the run, so a
reader sees a whole report or the one before. A task that fails deletes its fragment, fragments of attempts that did not count
go at the commit, and a run that fails goes whole. Nothing passes through the driver but a line a task.

Paths are what pyarrow's file systems reach from every executor: a mounted folder, or a store's address.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from scansmith import catalog as C
from scansmith import export
from scansmith.operators import findings as O

POINTER, INDEX = "report.json", "index.json"
_BLOCK = 1 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class _Fragment(WriterCommitMessage):
    partition: int
    file: str
    rows: int
    size: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, head: str, tail: str, between: str) -> None:
        self.path, self.head, self.tail, self.between, self.run = path, head, tail, between, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Fragment:
        files, root = _place(self.path)
        files.create_dir(f"{root}/{self.run}", recursive=True)
        partition, rows, size = TaskContext.get().partitionId(), 0, 0
        file = f"{partition:06d}-{uuid.uuid4().hex}"  # attempts of a task don't meet
        try:
            with files.open_output_stream(f"{root}/{self.run}/{file}") as out:
                for b in iterator:
                    for piece in b.column(0).to_pylist():
                        size += out.write(f"{self.between}{piece}".encode())
                    rows += b.num_rows
        except BaseException:
            files.delete_file(f"{root}/{self.run}/{file}")
            raise
        return _Fragment(partition, file, rows, size)

    def commit(self, messages: list[_Fragment | None]) -> None:
        files, root = _place(self.path)
        files.create_dir(f"{root}/{self.run}", recursive=True)  # there may be no task
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        counted = {m.file for m in parts if m.rows}
        for info in files.get_file_info(fs.FileSelector(f"{root}/{self.run}")):
            if info.base_name not in counted:
                files.delete_file(info.path)
        index = {"head": self.head, "tail": self.tail, "between": self.between, "parts": [{"file": m.file, "rows": m.rows, "bytes": m.size} for m in parts if m.rows]}
        for name, said in ((f"{self.run}/{INDEX}", index), (f"{POINTER}.{self.run}", {"run": self.run})):
            with files.open_output_stream(f"{root}/{name}") as out:
                out.write(json.dumps(said).encode())
        files.move(f"{root}/{POINTER}.{self.run}", f"{root}/{POINTER}")

    def abort(self, messages: list[_Fragment | None]) -> None:
        files, root = _place(self.path)
        if files.get_file_info(f"{root}/{self.run}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.run}")


class ReportParts(DataSource):
    """Format report_parts, for writing one string column; options head, tail and between."""

    @classmethod
    def name(cls) -> str:
        return "report_parts"

    def writer(self, schema, overwrite: bool) -> _Writer:  # noqa: ANN001
        if len(schema.fields) != 1:
            raise ValueError("a report has one column of pieces")
        return _Writer(*(self.options.get(k, "") for k in ("path", "head", "tail", "between")))


def write_parts(pieces: DataFrame, path: str, head: str = "", tail: str = "", between: str = "") -> None:
    """Write a document of head, the rows of pieces (one string column) in their order, with between them, and tail."""
    pieces.sparkSession.dataSource.register(ReportParts)
    pieces.write.format("report_parts").options(head=head, tail=tail, between=between).mode("append").save(path)


def index_of(path: str) -> dict:
    """The index of the report that is current below a path; files: those of its fragments, with their folder."""
    files, root = _place(path)
    read = lambda name: json.loads(files.open_input_stream(f"{root}/{name}").read())
    run = read(POINTER)["run"]
    index = read(f"{run}/{INDEX}")
    return index | {"files": [f"{root}/{run}/{p['file']}" for p in index["parts"]]}


def document(path: str) -> Iterator[bytes]:
    """The bytes of the current report as one document, block by block."""
    files, _ = _place(path)
    index = index_of(path)
    skip = len(index["between"].encode())  # the first piece has nothing before it
    yield index["head"].encode()
    for name in index["files"]:
        with files.open_input_stream(name) as source:
            source.read(skip)
            skip = 0
            while block := source.read(_BLOCK):
                yield block
    yield index["tail"].encode()


# ---- reports ---------------------------------------------------------------------------------------------------------
def write_sarif(findings: DataFrame, path: str, tool: str = "scansmith") -> None:
    """A SARIF document of all results."""
    head, tail = export.sarif_frame(findings, tool)
    write_parts(export.sarif_objects(findings, tool), path, head, tail, ",\n")


def write_postman(findings: DataFrame, path: str, base: str = "", name: str = "Discovered endpoints") -> None:
    """A Postman collection of all items."""
    head, tail = export.postman_frame(name)
    write_parts(export.postman_objects(findings, base), path, head, tail, ",\n")


def json_pieces(findings: DataFrame) -> DataFrame:
    """(json): findings in the order of a JSON report, the first of each category with its key before it."""
    order = [*O.INSERTION, "value"]
    rank = O._case(F.col("category"), {c: i for i, c in enumerate(C.CATEGORIES)}, len(C.CATEGORIES))
    ranked = findings.withColumn("rank", rank)
    firsts = ranked.groupBy("category").agg(F.min(F.struct(*order)).alias("first"), F.min("rank").alias("at"))
    least = firsts.agg(F.min(F.struct("at", "category")).alias("least"))
    marks = firsts.join(F.broadcast(least), F.lit(True)).select(F.col("category").alias("_category"), "first", (F.struct("at", "category") == F.col("least")).alias("opens"))
    fields = F.to_json(F.struct(*(c for c in export._FIELDS if c != "category" and c in findings.columns)))
    key = F.concat(F.when(F.col("opens"), "").otherwise("], "), F.lit("\n"), F.substring_index(F.to_json(F.array("category")), "]", 1).substr(F.lit(2), F.lit(1 << 20)), F.lit(": [\n"))
    piece = F.concat(F.when(F.struct(*order).eqNullSafe(F.col("first")), key).otherwise(",\n"), fields)
    told = ranked.join(F.broadcast(marks), F.col("category") == F.col("_category"))  # one row a category
    return told.orderBy("rank", "category", *order).select(piece.alias("json"))


def write_json_report(findings: DataFrame, meta: dict, path: str) -> None:
    """One JSON document: meta, and the findings of each category."""
    write_parts(json_pieces(findings), path, f'{{"meta": {json.dumps(meta)}, "findings": {{', f"{'' if findings.isEmpty() else ']'}}}}}\n")
