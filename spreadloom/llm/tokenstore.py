"""Token ids in files of Simple-8b words, in ascending key order, and the way back.

File: the magic, blocks of words, the block table (byte offset and values of each block), the document table (key, a
null mark and the number of ids of each document) and a footer with both tables' places. A block's offset lets a reader
start at any block, and a block is decoded as whole arrays.

Texts are dealt to ranges of the key by a histogram sort. A range writes its files in turn: a file ends after the document
with which it holds ``FILE_IDS`` ids or ``FILE_DOCUMENTS`` documents, so its tables stay small however large the range
is, and so does what a task holds. A file is written under a temporary name and renamed when it is whole; the manifest,
renamed last, commits the folder, and readers take only what it names. Running a task again gives the same bytes.

Defined cases: a null or empty text has the end id alone; null keys come first; rows of one key go by the text's hash;
repeated rows are stored as often as they come; other columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.llm import simple8b
from spreadloom.llm.common import documents, file_system, rename, shared_folder
from spreadloom.llm.sharding import looked_up, ranges
from spreadloom.llm.tokens import TextIds, small_batches

MAGIC = b"S8BTOK01"
BLOCK = 1 << 16
FOOTER = struct.Struct("<QQQQ8s")  # block table, document table, documents, ids, magic
MANIFEST = "part int, number int, name string, documents long, tokens long, bytes long"
FIELDS = pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])
#: Where a file ends.
FILE_IDS, FILE_DOCUMENTS = 1 << 24, 1 << 20


class Writer:
    """One file. Memory holds a block and the tables."""

    def __init__(self, sink, block: int = BLOCK):
        self.sink, self.block, self.at = sink, block, 0
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = 0
        self.blocks: list[tuple[int, int]] = []
        self.keys, self.null, self.sizes = array("q"), bytearray(), array("q")
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.keys.append(key or 0)
        self.null.append(key is None)
        self.sizes.append(len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        self.ids += len(ids)
        if self.held >= self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        values = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        whole = len(values) if last else len(values) // self.block * self.block
        for lo in range(0, whole, self.block):
            piece = values[lo : min(lo + self.block, whole)]
            self.blocks.append((self.at, len(piece)))
            self._write(simple8b.encode(piece).astype("<u8").tobytes())
        self.waiting, self.held = [values[whole:]], len(values) - whole

    def close(self) -> None:
        self._flush(last=True)
        blocks = self.at
        self._write(np.array(self.blocks, "<u8").tobytes())
        rows = self.at
        for column, kind in ((self.keys, "<i8"), (self.null, "<u1"), (self.sizes, "<u8")):
            self._write(np.array(column, kind).tobytes())
        self._write(FOOTER.pack(blocks, rows, len(self.keys), self.ids, MAGIC))
        self.sink.close()


def read(source) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(key, ids of the file before, ids) of each document, block after block."""
    size = source.size()
    source.seek(size - FOOTER.size)
    blocks, rows, n, ids, magic = FOOTER.unpack(source.read(FOOTER.size))
    if magic != MAGIC:
        raise ValueError("not a whole token file")
    source.seek(blocks)
    places = np.frombuffer(source.read(rows - blocks), "<u8").reshape(-1, 2).astype(np.int64)
    tables = source.read(size - FOOTER.size - rows)
    keys, null, sizes = np.frombuffer(tables, "<i8", n), np.frombuffer(tables, "<u1", n, 8 * n), np.frombuffer(tables, "<u8", n, 9 * n).astype(np.int64)
    k, start, waiting, held = 0, 0, [], 0
    ends = [*places[1:, 0].tolist(), blocks]
    for (lo, count), hi in zip(places.tolist(), ends, strict=True):
        source.seek(lo)
        waiting.append(simple8b.decode(np.frombuffer(source.read(hi - lo), "<u8"), count))
        held += count
        if k < n and held >= sizes[k]:
            values, at = np.concatenate(waiting), 0
            while k < n and at + sizes[k] <= len(values):
                yield (None if null[k] else int(keys[k])), start, values[at : at + sizes[k]]
                at, start, k = at + int(sizes[k]), start + int(sizes[k]), k + 1
            waiting, held = [values[at:]], len(values) - at
    while k < n:  # documents without ids at the end
        yield (None if null[k] else int(keys[k])), start, np.zeros(0, np.uint64)
        k += 1


class Files:
    """The files of one range. ``rows`` gets a row for each whole file."""

    def __init__(self, folder: str, part: int, file_ids: int, file_documents: int):
        self.fs, self.base = file_system(folder)
        self.part, self.ids, self.documents, self.rows, self.writer = part, file_ids, file_documents, [], None

    def add(self, key: int | None, ids: np.ndarray) -> None:
        if self.writer is None:
            self.named = f"{self.base}/_{uuid.uuid4().hex}"
            self.writer = Writer(self.fs.open_output_stream(self.named))
        self.writer.add(key, ids)
        if self.writer.ids >= self.ids or len(self.writer.keys) >= self.documents:
            self.close()

    def close(self) -> None:
        if self.writer is None:
            return
        done, self.writer = self.writer, None
        done.close()
        name = f"ids-{self.part:06d}-{len(self.rows):05d}.s8b"
        self.fs.move(self.named, f"{self.base}/{name}")
        self.rows.append({"part": self.part, "number": len(self.rows), "name": name, "documents": len(done.keys), "tokens": done.ids, "bytes": done.at})


def write(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text", file_ids: int = FILE_IDS, file_documents: int = FILE_DOCUMENTS) -> str:
    """Write all documents; returns the committed folder."""
    spark = df.sparkSession
    folder = shared_folder(spark, "tokens")
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    dealt, _ = ranges(df.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", F.coalesce("text", F.lit("")), F.coalesce(F.octet_length("text"), F.lit(0)) + 1)

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, files = TextIds(path), None
        for batch in small_batches(batches, "text"):
            if batch.num_rows and files is None:
                files = Files(folder, batch.column("part")[0].as_py(), file_ids, file_documents)
            ids, offsets = encode(batch.column("text"), end_id)
            for k, lo, hi in zip(batch.column("key").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                files.add(k, ids[lo:hi])
        if files:
            files.close()
            yield pa.RecordBatch.from_pylist(files.rows, FIELDS)

    dealt.mapInArrow(store, MANIFEST).write.parquet(f"{folder}/_manifest")
    rename(spark, f"{folder}/_manifest", f"{folder}/manifest")
    return folder


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a committed folder with ``first``, the ids of all files before, in partitions by range.

    What reaches the driver is one sum for each range, of which there are at most ``sharding.EXCHANGE``.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    sums = files.groupBy("part").agg(F.sum("tokens").alias("n")).toArrow()
    parts = sums.column("part").to_numpy()
    whole = np.zeros((parts.max() if len(parts) else 0) + 1, np.int64)
    whole[parts] = sums.column("n").to_numpy()
    before = F.sum("tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("tokens")
    placed = files.repartitionById(len(whole), "part").withColumn("_before", before)
    return placed.select("part", "number", "name", (looked_up(np.cumsum(whole) - whole)("part") + F.col("_before")).alias("first"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files of a committed folder."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for name, first in zip(batch.column("name").to_pylist(), batch.column("first").to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{name}") as source:
                    found: list[tuple] = []
                    for key, at, ids in read(source):
                        found.append((key, first + at, len(ids), zlib.crc32(ids.astype("<u4"))))
                        if len(found) == 10_000:
                            yield rows_of(found)
                            found = []
                    yield rows_of(found)

    return listed(spark, folder).mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def rows_of(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark, write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), 1))
