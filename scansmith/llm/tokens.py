"""Operator 6: token IDs as flat unsigned integer files with 64-bit document offsets, memory-mapped.

A file set is a folder on storage that every executor mounts (spark.checkpoint.dir or a folder of the caller's):
``p.ids`` holds the token IDs of part p back to back (uint16 if the vocabulary fits, else uint32, little-endian),
``p.offsets`` one uint64 per document and one at the end, counted from the part's first token, ``p.docs`` the int64
document numbers. Parts are ranges of doc_id, so part bases are prefix sums of the parts' token counts (one number a part).

Text is split where a run of white space begins, and around a line feed alone; the byte-level pre-tokenizer always begins a
new pre-token there, so the pieces encode alone as they do in the whole text. Pieces recur, and each worker keeps the IDs of
a bounded number of them; the library encodes each piece that is not kept. A text that holds an added token's string, such as
``<|endoftext|>``, goes to the library whole, which gives that token its own ID.

Defined results: null text is empty and has the end ID alone; very long texts are encoded whole, one at a time; repeated rows
are written as often as they occur; a null doc_id sorts first and is stored as -1 with a flag file; no rows give no files;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scansmith.llm.common import BATCH_ROWS, deleted_at_exit, shared_folder, small_batches

if TYPE_CHECKING:
    from tokenizers import Tokenizer

END_ID = 2
MOST_PARTS = 100_000  # beyond it parts grow: what the driver adds up is one row a part
CACHED_PIECES = 2_000_000
CACHED_CHARS = 48  # longer pieces are encoded each time
_ODD = re.compile(r"\s\s|[^\S \n]|\0")
_UNSURE = re.compile(r"[\x1c-\x1f]")  # white space for Python alone
_SEGMENT = re.compile(r"\s*\S+|\s+")
_MARKS = ".,;:!?#%&*$|-()\""


class _Pieces(dict):
    """IDs of pieces of text, made when first asked for; the older half goes when there are too many."""

    def __init__(self, tokenizer: Tokenizer, code: str) -> None:
        super().__init__({"": b""})
        self.pre, self.model, self.code = tokenizer.pre_tokenizer, tokenizer.model, code
        # the byte-level alphabet: printable Latin-1 stands for itself, other bytes for the characters from U+0100 on
        own = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
        self.alphabet = {b: b for b in own} | {b: 256 + k for k, b in enumerate(sorted({*range(256)} - {*own}))}

    def _word(self, mapped: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        bare = piece[1:] if piece[0] == " " else piece
        if bare.isalpha():  # one pre-token
            ids = self._word(piece.encode().decode("latin-1").translate(self.alphabet))
        elif (word := bare.rstrip(_MARKS)).isalpha():  # a pre-token of letters and one of marks
            cut = len(piece) - len(bare) + len(word)
            ids = self[piece[:cut]] + self[piece[cut:]]
        else:
            ids = b"".join(self._word(word) for word, _ in self.pre.pre_tokenize_str(piece))
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                for k in list(itertools.islice(self, CACHED_PIECES // 2)):
                    if k:
                        del self[k]
            self[piece] = ids
        return ids


class Encoder:
    """Whole texts to IDs with a vocabulary file of the tokenizers library; one for each worker and file."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t["content"] for t in json.loads(self.tokenizer.to_str()).get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces = _Pieces(self.tokenizer, "H" if self.dtype.itemsize == 2 else "I") if self._plain() else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _plain(self) -> bool:
        """Whether this file is a plain byte-level BPE, for which encoding by pieces is exact."""
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        return kind["model"]["type"] == "BPE" and not kind.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")

    def encode(self, text: str) -> bytes:
        """The IDs of a whole text as bytes of self.dtype, without an end ID."""
        if self.pieces is None or _UNSURE.search(text) or any(a in text for a in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        if _ODD.search(text):
            pieces = _SEGMENT.findall(text)
        else:
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        return b"".join(map(self.pieces.__getitem__, pieces))


def crc32_u32(ids: np.ndarray) -> int:
    """CRC-32 of IDs as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _place(folder: str) -> str:
    """The local path of a folder whose URI has the file scheme, which all executors mount."""
    if folder.startswith("file:"):
        return "/" + folder[5:].lstrip("/")
    if "://" in folder:
        raise ValueError(f"memory-mapped files need a mounted folder: {folder}")
    return folder


def _put(path: str, data: bytes) -> None:
    """Written under another name and renamed, so a lost or repeated task leaves whole files alone."""
    with open(own := f"{path}.{uuid.uuid4().hex}", "wb") as out:
        out.write(data)
    os.replace(own, path)


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = END_ID, rows_a_part: int = 4096) -> list[tuple[int, int, int, int]]:
    """Encode docs (doc_id, text) in ascending doc_id order into folder; (part, base, tokens, documents) of each part.

    Parts are ranges of (doc_id, hash of the text): rows with one doc_id may lie in several parts. Columns besides doc_id
    and text are not read. What reaches the driver is one row a part.
    """
    spark = docs.sparkSession
    folder = _place(folder or shared_folder(spark, "tokens"))
    path = vocabulary or default_vocabulary()
    os.makedirs(folder, exist_ok=True)
    parts = min(max(1, -(-docs.count() // rows_a_part)), MOST_PARTS)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    keyed = keyed.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        end = np.array([end_id], encoder.dtype).tobytes()
        part, name, total, offsets, numbers, out = None, "", 0, [0], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                part = batch.column("part")[0].as_py()
                name = f"{folder}/{part:08d}"
                out = open(own := f"{name}.{uuid.uuid4().hex}", "wb")  # noqa: SIM115
            for text in itertools.chain.from_iterable(batch.column("text").slice(at, BATCH_ROWS).to_pylist() for at in range(0, batch.num_rows, BATCH_ROWS)):
                ids = encoder.encode(text or "") + end
                out.write(ids)
                total += len(ids) // encoder.dtype.itemsize
                offsets.append(total)
            numbers.append(batch.column("doc_id"))
        if out is None:
            return
        out.close()
        os.replace(own, f"{name}.ids")
        docs_of = pa.chunked_array(numbers).combine_chunks()
        _put(f"{name}.offsets", np.array(offsets, "<u8").tobytes())
        _put(f"{name}.docs", docs_of.fill_null(-1).to_numpy().astype("<i8").tobytes())
        if docs_of.null_count:
            _put(f"{name}.null", str(docs_of.null_count).encode())
        yield pa.record_batch([pa.array([part], pa.int32()), pa.array([total], pa.int64()), pa.array([len(offsets) - 1], pa.int64())], ["part", "tokens", "docs"])

    with small_batches(spark):
        found = sorted(keyed.mapInArrow(run, "part int, tokens long, docs long").collect())
    base, out = 0, []
    for part, tokens, n in found:
        out.append((part, base, tokens, n))
        base += tokens
    return out


def read_token_files(spark: SparkSession, folder: str, parts: list[tuple[int, int, int, int]], vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, from the memory-mapped files."""
    folder, path = _place(folder), vocabulary or default_vocabulary()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not parts:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(p, b) for p, b, _, _ in parts], "part int, base long").repartition(min(len(parts), 4096))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = Encoder.of(path).dtype
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist(), strict=True):
                name = f"{folder}/{part:08d}"
                ids = np.memmap(f"{name}.ids", dtype, "r")
                offsets, numbers = np.memmap(f"{name}.offsets", "<u8", "r").astype(np.int64), np.memmap(f"{name}.docs", "<i8", "r")
                nulls = int(open(f"{name}.null").read()) if os.path.exists(f"{name}.null") else 0
                for lo in range(0, len(numbers), 1024):
                    hi = min(lo + 1024, len(numbers))
                    own = [ids[offsets[i] : offsets[i + 1]] for i in range(lo, hi)]
                    columns = [
                        pa.array(numbers[lo:hi].astype(np.int64), mask=np.arange(lo, hi) < nulls),
                        pa.array(base + offsets[lo:hi]),
                        pa.array(offsets[lo + 1 : hi + 1] - offsets[lo:hi]),
                        pa.array([crc32_u32(x) for x in own], pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.record_batch(columns, names)

    return listed.mapInArrow(run, schema)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, from the files that were written."""
    folder = shared_folder(spark, "tokens")
    parts = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    deleted_at_exit(spark, folder)
    return read_token_files(spark, folder, parts)
