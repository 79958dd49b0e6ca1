"""Shared plumbing of the training-data operators: the shared folder, Hadoop renames, files and tokenizers."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that are hot at most: those of more than one in HOT of all rows.
HOT = 10_000
_TOKENIZERS: dict[str, object] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is made, for a local master alone: on a cluster each machine has its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="spreadloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        base = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that ``materialise`` wrote and that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "shared_path", None)
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows of a table of two numbers up to which it is handed to all tasks whole (32 MB).
HANDED = 2_000_000


def handed(table: DataFrame, rows: int) -> DataFrame:
    """``table``, whose rows are at most ``rows``, marked for broadcast where these are few."""
    return F.broadcast(table) if rows <= HANDED else table


def join_frequent(rows: DataFrame, table: DataFrame, on: list[str], often: int) -> DataFrame:
    """``rows`` joined with ``table`` (on..., n, more), which says that n rows have an entry's key.

    Entries of more than ``often`` rows go to all tasks, so the rows of a hot key never meet in one. With ``often`` a
    share of all rows, 1 / HOT, these are fewer than HOT entries, whatever the size of the table.
    """
    hot, rest = table.where(F.col("n") > often).drop("n"), table.where(F.col("n") <= often).drop("n")
    cold = rows.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def release() -> None:
    """Give the memory that this process has freed back to the system; Arrow's pool and the C library keep it otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, which ends with ``release``: a worker's process waits for other tasks beside what the JVM needs for them."""

    @wraps(run)
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Rename through Hadoop's file system, the commit step of the writers."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(path(source), path(target)):
        raise OSError(f"cannot rename {source} to {target}")


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, for executors that write or read files of their own format."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per process, with truncation and padding off."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        _TOKENIZERS[path] = made
    return _TOKENIZERS[path]


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
