"""Sum-of-squares online packing of tokenised documents into fixed windows.

A document's ids are those of the public tokenizer plus an end id. What fills whole windows is cut off first; the rest
(shorter than a window) is placed online: among the fill levels that have an open window and room, and a new window, the
one that makes the sum over levels of (open windows at that level) squared smallest; a level array holds the counts.
Moving a window from level h to h + s changes the sum by 2 (N[h + s] - N[h]) + 2 (level 0 and the full level count for
nothing), so one document costs one vector operation over the levels. Rests above half a window can't share one, so the
open windows are bounded: above ``MAX_OPEN``, and at the end of a stream, they are settled, the fullest being filled by
pieces cut from the emptiest. At most one window of a stream is padded.

Each task packs the documents of its own scan partition while it tokenises them: no shuffle, and a lost task gives the
same windows again. Memory: at most ``MAX_OPEN`` open windows and one document's pieces, and the tokenizer's bounded memo of words.

Ids are looked up by chunk: the tokenizer drops white space and no token spans it, so splitting at spaces and newlines
changes nothing (tests compare with the tokenizer over whole texts). Null text: only the end id. Very long texts become
many pieces. Repeated rows are packed like any others. Empty table: no rows. Extra columns aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
MAX_OPEN = 1_024
MEMO_CHUNKS = 400_000
MEMO_WORDS = 500_000
MEMO_CHARS = 64
CLOSING = ".,;:!?"


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter for each byte: printable bytes stand for themselves, the others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(other)}


class Encoder(dict):
    """Ids of a text as little-endian 32-bit bytes; itself the bounded memo of short chunks.

    Words of Latin letters (with closing punctuation) are one pre-token each and go to the BPE model directly; every
    other chunk goes through the whole tokenizer. Looking a text up is one pass in C over its chunks; Python runs only for
    chunks that aren't in the memo.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer
        super().__init__()
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.model = self.tok.model
        self.letters = _byte_letters()
        self.words: dict[str, bytes] = {}
        self.closing: dict[str, bytes] = {"": b""}
        self.units = [i.to_bytes(4, "little") for i in range(self.tok.get_vocab_size())]

    def _whole(self, chunk: str) -> bytes:
        return np.array(self.tok.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        stem = chunk.rstrip(CLOSING)
        ids = self.words.get(stem.lower())
        if ids is None:
            ids = self._word(stem.lower())
        if ids is None:
            ids = self._whole(chunk) if chunk else b""
        elif len(stem) < len(chunk):
            end = chunk[len(stem):]
            if end not in self.closing:
                if len(end) > 4:
                    return ids + self._whole(end)
                self.closing[end] = self._whole(end)
            ids += self.closing[end]
        if len(chunk) <= MEMO_CHARS:                               # long chunks aren't kept
            if len(self) >= MEMO_CHUNKS:
                self.clear()
            self[chunk] = ids
        return ids

    def _word(self, stem: str) -> bytes | None:
        if not stem.isalpha() or len(stem) > MEMO_CHARS or not stem.isascii() and max(stem) >= "\u0250":
            return None
        if len(self.words) >= MEMO_WORDS:
            self.words.clear()
        units = self.units
        spelt = stem if stem.isascii() else "".join([self.letters[b] for b in stem.encode()])
        ids = self.words[stem] = b"".join([units[t.id] for t in self.model.tokenize(spelt)])
        return ids

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_ENCODERS: dict[str, Encoder] = {}


class SumOfSquares:
    """Online placement into windows by the sum of squares of the level counts."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)       # open windows by fill level
        self.open: dict[int, list[list]] = {}                   # level -> windows, each a list of pieces

    def place(self, piece, length: int):
        """The window (list of pieces) if it is full now, else None."""
        room = self.window - length
        if length == self.window:
            return [piece]
        levels = np.flatnonzero(self.count[1:room + 1]) + 1
        best, change = 0, 2 * self.count[length] + 1            # a new window
        if len(levels):
            to = levels + length
            delta = np.where(to == self.window, 0, 2 * self.count[to] + 1) - 2 * self.count[levels] + 1
            i = len(delta) - 1 - int(np.argmin(delta[::-1]))    # ties: the fullest
            if delta[i] <= change:
                best = int(levels[i])
        if best:
            bin_ = self.open[best].pop()
            self.count[best] -= 1
        else:
            bin_ = []
        bin_.append(piece)
        if best + length == self.window:
            return bin_
        self.open.setdefault(best + length, []).append(bin_)
        self.count[best + length] += 1
        return None

    @property
    def n_open(self) -> int:
        return int(self.count.sum())

    def settle(self, cut_at, keep: int = 0) -> Iterator[list]:
        """Close open windows until ``keep`` are left: the emptiest are cut to fill the fullest.

        Every window closed is full, but for the last one where ``keep`` is 0. ``cut_at(piece, n)`` -> two pieces.
        """
        left = [w for level in sorted(self.open) for w in self.open[level] if w]
        fills = [sum(p[1] for p in w) for w in left]
        low, high = 0, len(left) - 1
        while low < high and high - low + 1 > keep:
            room = self.window - fills[high]
            while room and low < high:
                piece = left[low].pop()
                if piece[1] > room:
                    piece, rest = cut_at(piece, room)
                    left[low].append(rest)
                left[high].append(piece)
                fills[low] -= piece[1]
                fills[high] += piece[1]
                room -= piece[1]
                if not left[low]:
                    low += 1
            if room and keep:                                    # the only one left, not full
                break
            yield left[high]
            high -= 1
        self.open.clear()
        self.count[:] = 0
        if not keep and low == high and left[low]:
            yield left[low]
        elif keep:
            for i in range(low, high + 1):
                if left[i]:
                    self.open.setdefault(fills[i], []).append(left[i])
                    self.count[fills[i]] += 1


SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
FLUSH_ROWS = 2_000


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit)."""

    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())   # as large as the vocabulary, not as the corpus
    name = uuid.uuid4().hex

    def cut_at(piece, n):
        doc, length, start, total, ids = piece
        return (doc, n, start, total, ids[:4 * n]), (doc, length - n, start + n, total, ids[4 * n:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:                                     # one tokenizer and memo per worker
            _ENCODERS.clear()
            _ENCODERS[name] = Encoder(shared.value)
        encode, end = _ENCODERS[name], end_id.to_bytes(4, "little")
        base, serial = TaskContext.get().partitionId() << 32, 0
        packer, rows = SumOfSquares(window), []

        def emit(full):
            nonlocal serial
            offset = 0
            for doc, length, start, total, ids in full:
                rows.append((doc, start, length, total, base + serial, offset, ids))
                offset += length
            serial += 1

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
            rows.clear()
            return out

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start:4 * (start + window)]
                    length = len(piece) // 4
                    if full := packer.place((doc, length, start, total, piece), length):
                        emit(full)
                if packer.n_open > MAX_OPEN:
                    for full in packer.settle(cut_at, MAX_OPEN // 2):
                        emit(full)
                if len(rows) >= FLUSH_ROWS:
                    yield batch()
        for full in packer.settle(cut_at):
            emit(full)
            if len(rows) >= FLUSH_ROWS:
                yield batch()
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def ids_crc32(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
