"""Histogram sort: exact byte counts below candidate keys, refined until the splitters meet a tolerance, then one exchange.

Keys are (key, hash of the payload, number of the row in the scan), so a key that holds a third of all rows is split as
any other, even among equal texts. A narrow table of keys and sizes is written once. The search alternates two passes
over it: ``drawn`` takes new candidates from the intervals in which a wanted boundary still lies, ``counted`` sums the
bytes and rows between all candidates (each task sends its sums alone). A boundary is settled when a candidate's bytes
are within the tolerance of it, or all keys of its interval have been tried; the search goes on until every one is.

Two levels keep both the driver and the tasks bounded. The splitters cut the table into parts of about ``PART_BYTES``, at
most ``EXCHANGE`` of them, which is as wide as one exchange may be; a pass brings the driver at most ``DRAWN`` keys or
sums, as Arrow columns. Within a part rows come sorted (the sort spills), and every consumer streams them: a file of
a writer ends at its own fixed size, a slot is a running number. So a table of any size takes memory of a batch and one
file's tables in each task; only the time of a task grows beyond ``EXCHANGE * PART_BYTES`` = 2 TiB (1.5 GB a part
at 100 TB).

Each shard consists of whole parts, so tasks stay small however large a shard is, and a row's slot is the rows of its
shard's parts before plus its place in its part.

Law ``bytes``: sizes of shards near equal. Equal texts are ordinary rows, they may lie in different shards.

Defined cases: a null text has size 1 and the checksum 0; null keys sort first; repeated rows each get a slot; other
columns pass through; an empty table gives an empty result. The input must be a stable scan or a written table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import discard, documents, materialise

WIDTH = 25
KEY = f"S{WIDTH}"
PART_BYTES = 32 << 20
#: Parts of one exchange.
EXCHANGE = 1 << 16
#: Keys that a pass brings to the driver.
DRAWN = 1 << 20
#: Keys drawn for a boundary in a pass, where there are few boundaries.
SAMPLES = 256


def encoded(key: np.ndarray, null: np.ndarray, mixed: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Composite keys as byte strings that sort as the keys do."""
    out = np.zeros((len(key), WIDTH), np.uint8)
    out[:, 0] = ~null
    for at, part in ((1, np.where(null, 0, key)), (9, mixed), (17, row)):
        out[:, at : at + 8] = (part.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(out).view(f"S{WIDTH}").ravel()


def keyed(df: DataFrame, key: str, payload: Column, size: Column) -> DataFrame:
    """Add the parts of the composite key and the size to the rows of a scan."""
    return df.withColumns({"_key": F.col(key).cast("long"), "_mixed": F.xxhash64(payload), "_row": F.monotonically_increasing_id(), "_size": size.cast("long")})


def columns(batch: pa.RecordBatch) -> np.ndarray:
    key = batch.column("_key")
    return encoded(key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False), batch.column("_mixed").to_numpy(), batch.column("_row").to_numpy())


@dataclass
class Splitters:
    """Boundaries of ranges, with the bytes and rows below each."""

    keys: np.ndarray
    bytes_below: np.ndarray
    rows_below: np.ndarray
    total_bytes: int
    total_rows: int
    passes: int
    parts: int


def counted(narrow: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, rows) of each interval between probes, exactly."""
    n = len(probes) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, columns(batch), side="right")
            sums += np.bincount(at, batch.column("_size").to_numpy(), n).astype(np.int64)
            rows += np.bincount(at, minlength=n)
        full = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(sums[full]), pa.array(rows[full])], ["bucket", "bytes", "n"])

    found = narrow.mapInArrow(count, "bucket int, bytes long, n long").groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).toArrow()
    sums, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = found.column("bucket").to_numpy()
    sums[at], rows[at] = found.column("bytes").to_numpy(), found.column("n").to_numpy()
    return sums, rows


def drawn(narrow: DataFrame, probes: np.ndarray, rates: np.ndarray, turn: int) -> np.ndarray:
    """Keys of the intervals between probes, sorted: each row of interval b with the chance ``rates[b]``, by its hash."""
    salt = np.uint64(turn * 0x9E3779B97F4A7C15 & (2**64 - 1))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = columns(batch)
            mixed = (batch.column("_mixed").to_numpy().view(np.uint64) + batch.column("_row").to_numpy().view(np.uint64)) ^ salt
            mixed = mixed * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            chosen = (mixed >> np.uint64(11)).astype(float) / 2**53 < rates[np.searchsorted(probes, keys, side="right")]
            yield pa.RecordBatch.from_arrays([pa.array([k.ljust(WIDTH, b"\0") for k in keys[chosen].tolist()], pa.binary())], ["key"])

    return np.unique(np.array(narrow.mapInArrow(take, "key binary").toArrow().column("key").to_pylist(), KEY))


def split(narrow: DataFrame, parts: int, tolerance: float = 0.001) -> Splitters:
    """Splitters of ``parts`` ranges of near equal bytes. ``tolerance`` is a share of a part."""
    size = narrow.agg(F.count("*").alias("n"), F.sum("_size").alias("s")).first()
    total, rows = size["s"] or 0, size["n"]
    wanted, slack = total * np.arange(1, parts) / parts, tolerance * total / parts
    probes, sums, counts = np.zeros(0, KEY), np.array([total]), np.array([rows])
    each = max(8, min(SAMPLES, DRAWN // parts))
    turn = 0
    while len(wanted) and rows:
        below = np.concatenate([[0], np.cumsum(sums)]).astype(float)  # bytes below each interval, and all
        at = np.clip(np.searchsorted(below, wanted, side="left"), 1, len(below) - 1)
        gap = np.minimum(np.abs(below[at] - wanted), np.abs(below[at - 1] - wanted))
        open_ = np.unique(at[gap > slack] - 1)
        # an interval that has no key between its ends is as fine as can be
        open_ = open_[counts[open_] > 1]
        if not len(open_):
            break
        rates = np.zeros(len(counts))
        rates[open_] = np.minimum(1, each * np.bincount(at - 1, minlength=len(counts))[open_] / counts[open_])
        fresh = np.setdiff1d(drawn(narrow, probes, rates, turn := turn + 1), probes)
        if not len(fresh):
            if (rates[open_] >= 1).all():
                break
            continue
        # of the probes so far only those next to a wanted boundary are kept
        ends = np.unique(np.concatenate([at - 1, at]))
        near = probes[ends[(ends >= 1) & (ends <= len(probes))] - 1]
        probes = np.union1d(near, fresh)
        sums, counts = counted(narrow, probes)
    below, under = np.cumsum(sums)[:-1], np.cumsum(counts)[:-1]
    if not len(probes):
        return Splitters(np.zeros(0, KEY), np.zeros(0, np.int64), np.zeros(0, np.int64), total, rows, turn, parts)
    right = np.clip(np.searchsorted(below, wanted, side="left"), 0, len(probes) - 1)
    left = np.maximum(right - 1, 0)
    best = np.where(np.abs(below[left] - wanted) <= np.abs(below[right] - wanted), left, right)
    return Splitters(probes[best], below[best], under[best], total, rows, turn, parts)


def deal(df: DataFrame, splitters: Splitters) -> DataFrame:
    """The one exchange: rows of a range meet in the partition of its number, ``part``, sorted by the composite key."""
    placed = df.withColumn("part", part_of(splitters.keys)("_key", "_mixed", "_row"))
    return placed.repartitionById(splitters.parts, "part").sortWithinPartitions(F.col("_key").asc_nulls_first(), "_mixed", "_row")


def part_of(edges: np.ndarray):
    """A vectorised function of the composite key: the number of its range."""

    def part(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for key, mixed, row in batches:
            codes = encoded(key.fill_null(0).to_numpy(), key.is_null().to_numpy(zero_copy_only=False), mixed.to_numpy(), row.to_numpy())
            yield pa.array(np.searchsorted(edges, codes, side="right") if len(edges) else np.zeros(len(codes), np.int64), pa.int32())

    part.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(part, "int")


def plan(df: DataFrame, key: str, payload: Column, size: Column, multiple: int = 1, part_bytes: int = PART_BYTES) -> Splitters:
    """Splitters of parts of about ``part_bytes``, a multiple of ``multiple``."""
    narrow = materialise(keyed(df, key, payload, size).select("_key", "_mixed", "_row", "_size"), "keys")
    total = narrow.agg(F.sum("_size")).first()[0] or 0
    found = split(narrow, multiple * max(1, min(EXCHANGE // multiple, -(-total // (multiple * part_bytes)))))
    discard(narrow)
    return found


def ranges(df: DataFrame, key: str, payload: Column, size: Column, multiple: int = 1, part_bytes: int = PART_BYTES) -> tuple[DataFrame, Splitters]:
    """(rows dealt and sorted by key, splitters)."""
    found = plan(df, key, payload, size, multiple, part_bytes)
    return deal(keyed(df, key, payload, size), found), found


def looked_up(values: np.ndarray):
    """A vectorised function of a place in ``values``, which goes to the tasks: eight bytes for each part."""

    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for at in batches:
            yield pa.array(values[at.to_numpy()], pa.int64())

    look.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(look, "long")


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Add ``shard`` and ``slot`` to all rows, by the law of bytes."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    dealt, found = ranges(df, key, F.coalesce(F.col(text), F.lit("")), size, shards, part_bytes)
    each = found.parts // shards
    starts = np.concatenate([[0], found.rows_below]).astype(np.int64)
    starts = np.concatenate([starts, np.full(found.parts - len(starts), found.total_rows)])
    offset = starts - np.repeat(starts[::each], each)
    # a partition is one part: the low 33 bits of the id count its rows
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    out = dealt.withColumn("_place", place).withColumn("_offset", looked_up(offset)("part"))
    return out.withColumns({"shard": (F.col("part") / each).cast("int"), "slot": F.col("_offset") + F.col("_place")}).drop("_key", "_mixed", "_row", "_size", "_place", "_offset", "part")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard(documents(spark, sf_dir).select("doc_id", "text"), 16)
    text = F.coalesce(F.col("text"), F.lit(""))
    return dealt.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
