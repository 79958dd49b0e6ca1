"""Byte-level BPE over a distinct-word table, and decoding through an id-to-piece join.

A word here is a run of white space with the run of other characters after it. The tokenizer's own split never joins a
character with white space that follows it and looks ahead no further than the end of such a run, so the ids of a text
are the ids of its words in turn. Marks that end a word after a letter are split off, which the tokenizer does too.

1. ``word_rows``: every input block (a file's part, as the scan cuts it) gives each of its distinct words once.
2. ``encode_words``: the rows are dealt by word and sorted, so every distinct word of the corpus is encoded exactly once,
   and its ids go back to each block that has it. A frequent word has one row for each block, not for each occurrence.
   Ids travel in compressed pieces for groups of blocks, of which there are ``GROUPS`` at most, so that a piece holds many
   words however many blocks there are; a group's task sorts them into pieces for its blocks.
3. Each block's dictionary is one file in the shared folder, written under a temporary name and renamed.
4. ``encode`` reads the texts again, loads the dictionary of the block at hand and joins ids by position. Texts are never
   shuffled. A word that a dictionary lacks (a scan cut anew after a change of files) is encoded on the spot.

A table that is no scan of files is written first, so that it has blocks too. Memory holds one block's distinct words.

The words are split and the ids joined inside workers, against a block's dictionary, and not as a join of rows: a row for
each occurrence of a word (a document, a place and a word) is some 40 bytes for 6 bytes of text, which would be exchanged
twice, where this exchanges 0.85 bytes for each byte of text.

Defined cases: a null or empty text has no ids and decodes to an empty text;
the special token's own string in a text gives the special id, as the library's default does; rows are independent, so
repeated rows and ties are equal; other columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, file_system, materialise, shared_folder, tokenizer
from spreadloom.llm.tokens import flat, id_type, lists, parts, small_batches

#: The white space of Unicode, which the tokenizer's split goes by.
SPACE = "\t\n\x0b\x0c\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
DICTIONARY = pa.schema([("block", pa.int64()), ("word", pa.string()), ("ids", pa.binary())])
#: Groups of blocks, and words that a task gathers before it hands them on.
GROUPS, HELD = 1024, 1_000_000
WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


def blocks(df: DataFrame) -> DataFrame:
    """(block, doc_id, text): the block is the part of a file that a row comes from."""
    return df.select(F.xxhash64(F.input_file_name(), F.input_file_block_start()).alias("block"), "doc_id", "text")


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in small_batches(batches, "text"):
        keys = batch.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if hi > lo:
                yield int(keys[lo]), batch.slice(lo, hi - lo)


def word_rows(df: DataFrame) -> DataFrame:
    """(block, word): the distinct words of each block."""

    def emit(block: int, words: set[str]) -> Iterator[pa.RecordBatch]:
        found = list({p for w in words for p in parts(w)})
        for k in range(0, len(found), 50_000):
            piece = found[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(piece), block)), pa.array(piece, pa.string())], ["block", "word"])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words = None, set()
        for block, batch in by_block(batches):
            if block != at:
                if words:
                    yield from emit(at, words)
                at, words = block, set()
            for text in batch.column("text").to_pylist():
                if text:
                    words.update(WORD.findall(text))
        if words:
            yield from emit(at, words)

    return df.mapInArrow(distinct, "block long, word string")


def sealed(found: dict[int, tuple[list[str], list[bytes]]]) -> bytes:
    """A compressed Arrow stream of blocks, their words and the ids of these."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, DICTIONARY, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        for block, (words, ids) in sorted(found.items()):
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(np.full(len(words), block)), pa.array(words, pa.string()), pa.array(ids, pa.binary())], schema=DICTIONARY))
    return sink.getvalue().to_pybytes()


class Gathered:
    """Words and ids on their way to blocks, handed on as pieces by ``key`` of the block."""

    def __init__(self, key: Callable[[int], int], held: int):
        self.key, self.held, self.n = key, held, 0
        self.found: dict[int, dict[int, tuple[list[str], list[bytes]]]] = defaultdict(lambda: defaultdict(lambda: ([], [])))

    def add(self, block: int, word: str, ids: bytes) -> None:
        words, coded = self.found[self.key(block)][block]
        words.append(word)
        coded.append(ids)
        self.n += 1

    def flush(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.n < self.held and not last:
            return
        for to, pieces in sorted(self.found.items()):
            yield pa.RecordBatch.from_arrays([pa.array([to], pa.int64()), pa.array([sealed(pieces)], pa.binary())], ["block", "payload"])
        self.found.clear()
        self.n = 0


def unsealed(payload: bytes) -> Iterator[tuple[int, list[str], list[bytes]]]:
    for batch in pa.ipc.open_stream(payload):
        if batch.num_rows:
            yield batch.column("block")[0].as_py(), batch.column("word").to_pylist(), batch.column("ids").to_pylist()


def encode_words(rows: DataFrame, path: str, blocks: int, held: int = HELD, groups: int = GROUPS) -> DataFrame:
    """(block, payload): each distinct word is encoded once and handed to every block that has it.

    A task gathers at most ``held`` words at a time into compressed pieces, for groups of blocks first where there are
    more than ``groups`` of the ``blocks``.
    """
    many = blocks > groups
    first = (lambda block: block % groups) if many else int

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind, last, ids, gathered = tokenizer(path).encode, id_type(path), None, b"", Gathered(first, held)
        for batch in batches:
            for block, word in zip(batch.column("block").to_pylist(), batch.column("word").to_pylist(), strict=True):
                if word != last:
                    last, ids = word, np.array(encode(word, add_special_tokens=False).ids, kind).tobytes()
                gathered.add(block, word, ids)
            yield from gathered.flush()
        yield from gathered.flush(last=True)

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered = Gathered(int, held)
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                for block, words, ids in unsealed(payload):
                    for word, coded in zip(words, ids, strict=True):
                        gathered.add(block, word, coded)
                yield from gathered.flush()
        yield from gathered.flush(last=True)

    dealt = rows.repartition("word").sortWithinPartitions("word")
    pieces = dealt.mapInArrow(run, "block long, payload binary")
    return pieces.repartition("block").mapInArrow(regroup, "block long, payload binary") if many else pieces


def write_dictionaries(encoded: DataFrame, folder: str) -> int:
    """One file of compressed pieces for each block, <block>.words; returns their number. A repeated task replaces equal files."""
    spark = encoded.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        at, sink, named, done = None, None, "", 0
        for batch in batches:
            for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if block != at:
                    if sink:
                        sink.close()
                        fs.move(named, f"{base}/{at}.words")
                    at, named, done = block, f"{base}/_{uuid.uuid4().hex}", done + 1
                    sink = fs.open_output_stream(named)
                sink.write(len(payload).to_bytes(8, "little") + payload)
        if sink:
            sink.close()
            fs.move(named, f"{base}/{at}.words")
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    dealt = encoded.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


class BlockTable(dict):
    """chunk -> ids of the block at hand: looked up by its parts, once for each distinct chunk."""

    def __init__(self, folder: str, path: str, block: int):
        super().__init__()
        self.encode, self.kind = tokenizer(path).encode, id_type(path)
        self.words: dict[str, bytes] = {}
        fs, base = file_system(folder)
        with fs.open_input_stream(f"{base}/{block}.words") as source:
            while size := source.read(8):
                for _, words, ids in unsealed(source.read(int.from_bytes(size, "little"))):
                    self.words.update(zip(words, ids, strict=True))

    def __missing__(self, chunk: str) -> bytes:
        found = [self.words.get(p) for p in parts(chunk)]
        ids = self[chunk] = np.array(self.encode(chunk, add_special_tokens=False).ids, self.kind).tobytes() if None in found else b"".join(found)
        return ids


def join_words(folder: str, path: str):
    """Batches of blocks -> (doc_id, ids): each word is looked up in its block's dictionary, in place."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, table, kind = None, None, id_type(path)
        for block, batch in by_block(batches):
            texts = batch.column("text").to_pylist()
            if block != at and any(texts):
                at, table = block, None  # frees the last one first
                table = BlockTable(folder, path, block)
            ids = [b"".join(map(table.__getitem__, WORD.findall(x))) if x else b"" for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists(ids, kind)], ["doc_id", "ids"])

    return join


def prepared(df: DataFrame, path: str) -> tuple[DataFrame, str]:
    """The rows with their blocks, and the folder of the blocks' dictionaries."""
    placed = blocks(df if df.inputFiles() else materialise(df.select("doc_id", "text"), "texts"))
    folder = shared_folder(df.sparkSession, "words")
    write_dictionaries(encode_words(word_rows(placed), path, placed.select("block").distinct().count()), folder)
    return placed, folder


def encode(df: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every document."""
    placed, folder = prepared(df, path)
    return placed.mapInArrow(join_words(folder, path), "doc_id long, ids array<int>")


def piece_bytes(path: str) -> list[bytes]:
    """Bytes of each id, by the byte-level alphabet: printable Latin-1 stands for itself, the rest is moved up to 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
    tok = tokenizer(path)
    special = {k: t.content for k, t in tok.get_added_tokens_decoder().items()}
    pieces = []
    for k in range(tok.get_vocab_size(with_added_tokens=True)):
        name = special.get(k) or tok.id_to_token(k) or ""
        pieces.append(bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode())
    return pieces


def join_pieces(path: str):
    """Batches with ``ids`` -> the same with ``decoded``: each id meets its piece; the table is bounded by the vocabulary."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = piece_bytes(path).__getitem__
        for batch in batches:
            values, ends = flat(batch.column("ids"))
            ids = values.tolist()
            texts = [b"".join(map(piece, ids[a:b])).decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return join


def decode(df: DataFrame, path: str) -> DataFrame:
    """Add ``decoded`` to (doc_id, ids)."""
    return df.select("doc_id", "ids").mapInArrow(join_pieces(path), "doc_id long, ids array<int>, decoded string")


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and hashes of (doc_id, ids, decoded)."""
    names = list(map(str, range(1 << 16)))
    for batch in batches:
        values, ends = flat(batch.column("ids"))
        ids, n = values.tolist(), np.diff(ends)
        name = names.__getitem__ if not ids or max(ids) < len(names) else str
        hashes = [hashlib.sha256(",".join(map(name, ids[a:b])).encode()).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
        texts = [hashlib.sha256(x.encode()).hexdigest() for x in batch.column("decoded").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op2_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes, decodes and takes the digests in one pass of a worker, so that ids and texts need not leave it."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    placed, folder = prepared(documents(spark, sf_dir), path)
    there, back = join_words(folder, path), join_pieces(path)
    return placed.mapInArrow(lambda batches: digest(back(there(batches))), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
