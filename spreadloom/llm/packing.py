"""Packing of token ids into sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

``pieces`` cuts the ids of each document (with its end id) every ``capacity`` tokens. ``pack`` deals the pieces to
groups by a seeded hash, so that a group holds about ``group_tokens`` tokens whatever the input's order, and packs each
group on its own: pieces by falling length, each into the first sequence with room. The tournament tree holds the free
room of the sequences with maxima above, so a placement costs the logarithm of their number.

A full piece fills a sequence alone, so a document of any length spreads over its sequences; the hash takes the piece's
start and its number in the scan too, so that the pieces of one long document, copies, and all rows of one doc_id or
without one spread over the groups. Memory is bounded by a group. The input is a scan or a written table, so that a
task that runs again numbers its pieces alike.

Defined cases: a null or empty text has the end id alone; repeated rows are packed as often as they come; ties in
length go by doc_id, start and number; a null doc_id is kept and sorts first; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, released
from spreadloom.llm.tokens import ChunkTable, id_type, lists, small_batches

CAPACITY = 4096
GROUP_TOKENS = 2_000_000
PACKED = "doc_id long, start long, doc_tokens long, ids binary, length long, sequence_id long, offset long"
LISTED = PACKED.replace("ids binary", "ids array<int>")
DIGESTS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pieces(df: DataFrame, path: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, start, doc_tokens, ids) of every piece of every document; ids as ``tokens.id_type`` has them."""

    @released
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = ChunkTable(path)
        end, width = np.array([end_id], chunks.kind).tobytes(), np.dtype(chunks.kind).itemsize
        for batch in small_batches(batches, "text"):
            starts, totals, ids, row = [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                whole = chunks.ids(text) + end
                for lo in range(0, len(whole), width * capacity):
                    row.append(k)
                    starts.append(lo // width)
                    totals.append(len(whole) // width)
                    ids.append(whole[lo : lo + width * capacity])
            keys = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "doc_tokens", "ids"])

    return df.select("doc_id", "text").mapInArrow(cut, "doc_id long, start long, doc_tokens long, ids binary")


class Tournament:
    """Free room of opened sequences under a tree of maxima."""

    def __init__(self, sequences: int, capacity: int):
        self.leaves = 1 << max(0, sequences - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset from its end's free room) of the first sequence that takes ``length``."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < length:
                k += 1
        free = room[k]
        room[k] = free - length
        leaf = k
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
        return leaf - self.leaves, free


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece, given by falling length."""
    tree, out = Tournament(len(lengths), capacity), []
    for length in lengths:
        sequence, free = tree.place(length)
        out.append((sequence, capacity - free))
    return out


def pack(parts: DataFrame, groups: int, width: int, capacity: int = CAPACITY, seed: int = 20, then: Callable[[pa.Table], pa.Table] | None = None, schema: str = PACKED) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the pieces, whose ids have ``width`` bytes each.

    A sequence's id is its group's number in the upper bits and its number within the group below. ``then`` maps what a
    group gives, in the same task.
    """

    def fill(group: int, pieces: pa.Table) -> pa.Table:
        placed = np.array(first_fit_decreasing(pieces.column("length").to_pylist(), capacity), np.int64).reshape(-1, 2)
        pieces = pieces.append_column("sequence_id", pa.array((group << 32) + placed[:, 0])).append_column("offset", pa.array(placed[:, 1]))
        pieces = pieces.select(["doc_id", "start", "doc_tokens", "ids", "length", "sequence_id", "offset"])
        return then(pieces) if then else pieces

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            groups = batch.column("grp").to_numpy()
            cuts = np.flatnonzero(np.diff(groups)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(groups)], strict=True):
                if hi > lo and groups[lo] != at:
                    if held:
                        yield from fill(at, pa.Table.from_batches(held)).to_batches()
                    at, held = int(groups[lo]), []
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from fill(at, pa.Table.from_batches(held)).to_batches()

    return dealt(parts, groups, width, seed).mapInArrow(run, schema)


def dealt(parts: DataFrame, groups: int, width: int, seed: int = 20) -> DataFrame:
    """The pieces with their group, ``grp``, and ``length``, group by group, longest first."""
    numbered = parts.withColumn("_n", F.monotonically_increasing_id())
    group = F.pmod(F.xxhash64("doc_id", "start", "_n", F.lit(seed)), F.lit(groups))
    placed = numbered.withColumn("grp", group).withColumn("length", (F.octet_length("ids") / width).cast("long"))
    return placed.repartition("grp").sortWithinPartitions("grp", F.desc("length"), F.asc_nulls_first("doc_id"), "start", "_n").drop("_n")


def digest(pieces: pa.Table, kind: str) -> pa.Table:
    """The pieces with the checksum of their ids, as unsigned 32-bit integers, instead of the ids."""
    crcs = [zlib.crc32(np.frombuffer(x, kind).astype("<u4")) for x in pieces.column("ids").to_pylist()]
    return pieces.append_column("ids_crc32", pa.array(crcs, pa.int64())).select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def listed(pieces: pa.Table, kind: str) -> pa.Table:
    """The pieces with their ids as lists of integers."""
    return pieces.set_column(pieces.column_names.index("ids"), "ids", lists(pieces.column("ids").to_pylist(), kind))


def pack_documents(df: DataFrame, path: str, end_id: int = 2, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, digests: bool = False) -> DataFrame:
    """The packed pieces of a table of documents. Four bytes of text count as a token when groups are planned.

    Ids are lists of integers; with ``digests`` they are handed on as their checksums.
    """
    size = df.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 4)).first()[0] or 0
    groups, kind = max(1, -(-size // (4 * group_tokens))), id_type(path)
    then, schema = (lambda t: digest(t, kind), DIGESTS) if digests else (lambda t: listed(t, kind), LISTED)
    return pack(pieces(df, path, end_id, capacity), groups, np.dtype(kind).itemsize, capacity, then=then, schema=schema)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), digests=True)
