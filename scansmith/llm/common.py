"""What the operators share: the shared folder, Arrow batches of bounded size, and word hashing in numpy.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z. UTF-8 bytes of 0x80 and over all belong
to words, so words are found and hashed bytewise with whole-array operations; nothing here loops over words in Python.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE = 1 << 20  # bytes of text that are hashed at once
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))
_GRAM = np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint64) + np.uint64(1)
_LOWER[65:91] += np.uint64(32)
_IS_WORD = np.zeros(256, bool)
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _IS_WORD[_a:_b] = True


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below spark.checkpoint.dir, which every executor and the driver see; set it where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


_PLACES: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
BATCH_ROWS, BATCH_BYTES = 512, 64 << 20  # that a worker takes at once; a larger row comes alone
_BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def deleted_at_exit(spark: SparkSession, path: str) -> None:
    """Leave a folder that is there to be deleted when the driver ends."""
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of bounded rows and bytes for what runs within; the session's own settings hold again behind it."""
    own = {k: spark.conf.get(k) for k in _BATCH_SETTINGS}
    for k, most in _BATCH_SETTINGS.items():
        number = int("".join(filter(str.isdigit, own[k])) or 0) if own[k].rstrip("bB").lstrip("-").isdigit() else 0
        spark.conf.set(k, str(min(most, number) if number > 0 and not own[k].startswith("-") else most))
    try:
        yield
    finally:
        for k, value in own.items():
            spark.conf.set(k, value)


def written(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read again: it cuts the lineage, and is not computed twice.

    The table goes with the driver, or before with `discard`.
    """
    spark = df.sparkSession
    path = shared_folder(spark, what)
    with small_batches(spark):
        df.write.parquet(path)
    deleted_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PLACES[out] = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what `written` wrote, when nothing will read it any more."""
    for df in frames:
        files, where = _file_system(df.sparkSession, _PLACES.pop(df))
        files.delete(where, True)


def unused(df: DataFrame, name: str) -> str:
    """name, or a longer one where df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """mapInArrow with a function of at most BATCH_ROWS rows, whatever the session's batches are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                if (out := work(batch.slice(at, BATCH_ROWS))) is not None:
                    yield out

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _PRIME), np.full(n, _INVERSE)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _hash_words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of data, whose documents lie between the bounds; number of words before each bound."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    up, down = _powers(1 << max(20, (n - 1).bit_length()))
    inside = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    start = np.flatnonzero(inside & ~(before & ~edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    end = np.flatnonzero(inside & ~(after & ~edge[1:])) + 1
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(_LOWER[data] * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start]), np.searchsorted(start, bounds)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and where each text begins; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def blobs(column: pa.ListArray, change: Callable[[np.ndarray], np.ndarray] = np.asarray) -> tuple[pa.Array, pa.Array]:
    """The length of each list of numbers and its changed numbers as little-endian doubles; no nulls."""
    ends = np.asarray(column.offsets).astype(np.int64)
    values = np.asarray(column.values)[ends[0] : ends[-1]].astype("<f8")
    places = pa.array(((ends - ends[0]) * 8).astype(np.int32)).buffers()[1]
    return pa.array(np.diff(ends).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(column), [None, places, pa.py_buffer(np.ascontiguousarray(change(values), "<f8"))])


def hashed_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, word hashes, word bounds of each row) for runs of rows of about SLICE bytes.

    A text over SLICE bytes is hashed in pieces that end between words, so memory follows its words, not its bytes.
    """
    data, offsets = texts_of(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE, "right")) - 1)
        part = data[offsets[lo] : offsets[hi]]
        if hi == lo + 1 and len(part) > SLICE:
            found, at = [], 0
            while at < len(part):
                to = min(at + SLICE, len(part))
                while to < len(part) and _IS_WORD[part[to]] and _IS_WORD[part[to - 1]]:
                    to += 1
                found.append(_hash_words(part[at:to], np.array([0, to - at]))[0])
                at = to
            words = np.concatenate(found)
            yield lo, hi, words, np.array([0, len(words)])
        else:
            yield lo, hi, *_hash_words(part, offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k successive words; len(words) - k + 1 of them, none if that is negative."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for j in range(1, k):
        out *= _GRAM
        out += words[j : j + n]
    return mix(out)
