"""Token ids of whole texts, with distinct words encoded once in each task.

A chunk is a run without space or newline, a word a chunk or its end marks. For a tokenizer that drops white space and
never joins across it or from a letter to a mark, the ids of a text are the ids of its words in turn, so words are looked
up in bounded tables, and only unseen ones are encoded. Tables end with their task: idle workers hold no memory.

``TextIds`` does the same for a batch of texts at once: chunks are told apart as Arrow arrays, each new chunk is cut into
its pieces, each new piece is encoded by the model in a block of them, and ids are put together by position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from itertools import chain, compress
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from spreadloom.llm.common import tokenizer

#: Chunks and words that a table holds; it starts anew beyond that. Longer ones than ``LONGEST`` characters are not kept,
#: so that a table's bytes are bounded too.
CHUNKS, WORDS = 600_000, 600_000
LONGEST = 64
#: Characters of the strings that ``Kept`` holds, before it starts anew.
KEPT = 32 << 20
MARKS = ".,;:!?"
LETTERS = frozenset(c for c in map(chr, range(256)) if c.isalpha() and c not in "\xaa\xba\xb5")


def parts(chunk: str) -> tuple[str, ...]:
    """The chunk, or the chunk without the marks that end it and these marks."""
    word = chunk.rstrip(MARKS)
    if len(word) < len(chunk) and word and word[-1] in LETTERS:
        return word, chunk[len(word) :]
    return (chunk,)


def latin(text: str) -> bool:
    """Lowering the text as a whole is the same as letter by letter, and no special token can come of it."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "<|" not in text


def id_type(path: str) -> str:
    """Two bytes hold an id of a vocabulary of up to 65,536, else four; little-endian."""
    return "<u2" if tokenizer(path).get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


#: Bytes as the byte-level alphabet shows them.
BYTES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE))}


class WordTable(dict):
    """word -> bytes of its ids.

    A word of Latin letters alone is one piece for the tokenizer, whatever stands around it: where the tokenizer lowers
    case, it is lowered first and handed to the model at once, in the byte-level alphabet.
    """

    def __init__(self, path: str):
        super().__init__()
        tok = tokenizer(path)
        self.encode, self.kind = tok.encode, id_type(path)
        self.code = "H" if self.kind == "<u2" else "I"
        self.model = tok.model.tokenize
        self.lowers = tok.normalizer is not None and tok.normalizer.normalize_str("A") == "a"

    def __missing__(self, word: str) -> bytes:
        if self.lowers and (word.isalpha() if word.isascii() else LETTERS.issuperset(word)):
            low = word.lower()
            if low != word:
                return self[low]
            found = [t.id for t in self.model(low if low.isascii() else low.encode().decode("latin-1").translate(BYTES))]
        else:
            found = self.encode(word, add_special_tokens=False).ids
        ids = pack(f"<{len(found)}{self.code}", *found)
        if len(word) <= LONGEST:
            if len(self) >= WORDS:
                self.clear()
            self[word] = ids
        return ids


class ChunkTable(dict):
    """chunk -> bytes of its ids."""

    def __init__(self, path: str):
        super().__init__()
        self.words = WordTable(path)
        self.kind = self.words.kind

    def __missing__(self, chunk: str) -> bytes:
        word = chunk.rstrip(MARKS)
        if len(word) == len(chunk) or not word or word[-1] not in LETTERS:
            ids = self.words[chunk]
        else:
            ids = self.words[word] + self.words[chunk[len(word) :]]
        if len(chunk) <= LONGEST:
            if len(self) >= CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        """All ids of a text; null and empty texts have none."""
        if not text:
            return b""
        if self.words.lowers and latin(text):
            text = text.lower()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


#: Marks of ASCII and Latin-1. Not the apostrophe, which may take letters with it, nor what counts as white space or a number.
SINGLE = "".join(c for c in map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x100)]) if not c.isalnum() and c not in "'\xaa\xba\xb5")
_LETTERS, _SINGLE = re.escape("".join(sorted(LETTERS))), re.escape(SINGLE)
#: The pieces of a plain chunk, and what makes a chunk another one than plain.
PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|[{_SINGLE}]+")
ODD = "[^" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted({*LETTERS, *"0123456789", *SINGLE})) + "]|<\\|"


def shown(piece: str) -> str:
    """The piece in the byte-level alphabet."""
    return piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES)


def cuts_plainly(path: str) -> bool:
    """The tokenizer lowers case and takes runs of letters, single digits and runs of marks, byte by byte, for its pieces."""
    tok, probe = tokenizer(path), f"a{''.join(sorted(LETTERS))}07b{SINGLE}1c"
    if tok.normalizer is None or tok.pre_tokenizer is None or tok.normalizer.normalize_str(probe) != probe.lower():
        return False
    return [x for x, _ in tok.pre_tokenizer.pre_tokenize_str(probe.lower())] == [shown(x) for x in PIECES.findall(probe.lower())]


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


@cache
def last_ids(path: str) -> np.ndarray | None:
    """Which ids end a piece, where the model marks them."""
    tok = tokenizer(path)
    suffix = getattr(tok.model, "end_of_word_suffix", None)
    if not suffix:
        return None
    vocabulary = tok.get_vocab(with_added_tokens=True)
    last = np.zeros(max(vocabulary.values()) + 1, bool)
    last[[k for x, k in vocabulary.items() if x.endswith(suffix)]] = True
    return last


def encoded_pieces(pieces: list[str], path: str, block: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many each has) of pieces, by the tokenizer's own model.

    Where the model marks the last id of a piece, a block of them is encoded at once and told apart by these ids.
    """
    tok, kind = tokenizer(path), id_type(path)
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import CharDelimiterSplit

    model, last = tok.model, last_ids(path)
    many = Tokenizer(model)
    many.pre_tokenizer = CharDelimiterSplit(" ")  # which the byte-level alphabet does not have
    ids, counts = [np.zeros(0, kind)], [np.zeros(0, np.int64)]
    for lo in range(0, len(pieces), block):
        own = [shown(x) for x in pieces[lo : lo + block]]
        if last is not None:
            found = np.array(many.encode_batch_fast([" ".join(own)], add_special_tokens=False)[0].ids, kind)
            ends = np.flatnonzero(last[found])
        if last is None or len(ends) != len(own) or ends[-1] != len(found) - 1:
            each = [[t.id for t in model.tokenize(x)] for x in own]
            found, ends = np.array([k for x in each for k in x], kind), np.cumsum([len(x) for x in each]) - 1
        ids.append(found)
        counts.append(np.diff(ends, prepend=-1))
    return np.concatenate(ids), np.concatenate(counts)


class Kept:
    """The ids of strings that were met, by their number. It starts anew beyond ``most`` strings or ``KEPT`` characters."""

    def __init__(self, kind: str, most: int):
        self.kind, self.most = kind, most
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.characters, self.ids, self.lengths = 0, [np.zeros(0, self.kind)], [np.zeros(0, np.int64)]

    def missing(self, names: list[str]) -> list[str]:
        """Those of ``names``, which are all different, that have no ids yet."""
        if len(self.numbers) >= self.most or self.characters >= KEPT:
            self.clear()
        return [x for x in names if x not in self.numbers]

    def add(self, names: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        at = len(self.numbers)
        self.numbers.update(zip(names, range(at, at + len(names)), strict=True))
        self.characters += sum(map(len, names))
        self.ids.append(ids)
        self.lengths.append(lengths)

    def of(self, names: list[str], places: pa.Array) -> pa.ListArray:
        """The ids of ``names`` at ``places``."""
        self.ids, self.lengths = [np.concatenate(self.ids)], [np.concatenate(self.lengths)]
        numbers = np.fromiter(map(self.numbers.__getitem__, names), np.int32, len(names))
        return listed(self.ids[0], self.lengths[0]).take(pa.array(numbers).take(places))


class TextIds:
    """The ids of batches of texts. Chunks and pieces are encoded once, whatever batch they are met in."""

    def __init__(self, path: str):
        self.path, self.kind, self.plainly = path, id_type(path), cuts_plainly(path)
        self.chunks, self.pieces = Kept(self.kind, CHUNKS), Kept(self.kind, WORDS)

    def _encode(self, names: list[str]) -> None:
        """Keep the ids of chunks: of plain ones put together from pieces, of any other encoded whole."""
        plain = np.zeros(len(names), bool)
        if self.plainly:
            plain = ~pc.match_substring_regex(pa.array(names, pa.string()), ODD).to_numpy(zero_copy_only=False)
        cut = [PIECES.findall(x.lower()) for x in compress(names, plain)]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        numbered = pa.array(chain.from_iterable(cut), pa.string()).dictionary_encode()
        del cut
        pieces = strings(numbered.dictionary)
        fresh = self.pieces.missing(pieces)
        self.pieces.add(fresh, *encoded_pieces(fresh, self.path))
        found = self.pieces.of(pieces, numbered.indices)
        sums = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy(zero_copy_only=False))])
        ends = np.cumsum(counts)
        self.chunks.add(list(compress(names, plain)), found.flatten().to_numpy(), sums[ends] - sums[ends - counts])
        encode, odd = tokenizer(self.path).encode, list(compress(names, ~plain))
        whole = [encode(x, add_special_tokens=False).ids for x in odd]
        self.chunks.add(odd, np.fromiter(chain.from_iterable(whole), self.kind), np.array([len(x) for x in whole], np.int64))

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of all texts, each ended by ``end_id``; null and empty texts have that alone."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        ends = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        chunks = split.flatten().dictionary_encode()
        del split
        names = strings(chunks.dictionary)
        self._encode(self.chunks.missing(names))
        found = self.chunks.of(names, pa.array(range(len(names)), pa.int32()))
        end = listed(np.array([end_id], self.kind), np.array([1]))
        places = np.insert(chunks.indices.to_numpy(), ends, len(names))
        ids = pa.concat_arrays([found, end]).take(pa.array(places))
        offsets = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))])
        return ids.flatten().to_numpy(), offsets[np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])]


def listed(ids: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids))


def lists(payloads: list[bytes], kind: str = "<u4") -> pa.Array:
    """An array of lists of int32 from the bytes of each list."""
    ends = np.zeros(len(payloads) + 1, np.int32)
    np.cumsum([len(x) // np.dtype(kind).itemsize for x in payloads], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(payloads), kind).astype(np.int32)))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list array without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1 if len(sizes) else []
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)

