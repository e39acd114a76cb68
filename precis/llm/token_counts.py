"""Token counts without tokens: count-only Viterbi over a unigram vocabulary.

The vocabulary is the (piece, score) list of a public SentencePiece file, read as a unigram model. A text is spelt as
that tokenizer does it: a space at the front, spaces as U+2581, nothing else normalised. An Aho-Corasick automaton lists
every piece that ends at each position; dynamic programming carries the best score and the number of pieces of its path.
Tie rules of the public unigram tokenizers: starts are taken in ascending order and only a strictly better score
replaces a path, so among equal scores the longest last piece stays. A character that is no piece by itself may stand as
unknown (least score of the vocabulary - 10) and counts as its UTF-8 bytes (byte fallback).

No piece has U+2581 after another character, and line breaks are in no piece, so every best path has a break there:
texts are cut into such segments, a segment's result is kept in a bounded memo, and results add up. This is checked when
the vocabulary is read (closing punctuation is cut off where no piece has the two characters side by side); for another vocabulary whole texts are segments. Scores are integers in this file, so sums in
doubles are exact and the cuts change no tie.

Null and empty texts: 0 tokens, score 0. Very long words are segments like others, only not kept. Special and byte
pieces match no text. Repeated rows count alike. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
MEMO_SEGMENTS = 600_000
MEMO_CHARS = 64
CLOSING = ".,;:!?"
UNKNOWN_PENALTY = 10.0


def read_vocabulary(model_file: str) -> list[tuple[str, float]]:
    """Ordinary pieces and their scores."""
    import sentencepiece
    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size())
            if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Counter:
    """(pieces, score) of the best path of a text."""

    def __init__(self, vocabulary: Iterable[tuple[str, float]]):
        import ahocorasick
        vocabulary = list(vocabulary)
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.cuts = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _ in vocabulary)
        self.inside = {pair for p, _ in vocabulary for pair in zip(p, p[1:])}
        self.segments = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.memo: dict[str, tuple[int, float]] = {}

    def path(self, s: str) -> tuple[int, float]:
        """Dynamic programming over one segment."""
        n, single, known = len(s), self.single, 0
        best, count = [-math.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for end, (length, score) in self.automaton.iter(s):     # ends ascending, and for one end starts ascending
            while known < end:                                  # what ends before is settled
                known += 1
                if s[known - 1] not in single:
                    self._unknown(s, known, best, count)
            start = end + 1 - length
            candidate = best[start] + score
            if candidate > best[end + 1]:
                best[end + 1], count[end + 1] = candidate, count[start] + 1
        for known in range(known + 1, n + 1):
            if s[known - 1] not in single:
                self._unknown(s, known, best, count)
        return count[n], best[n]

    def _unknown(self, s: str, end: int, best: list, count: list) -> None:
        candidate = best[end - 1] + self.unknown
        if candidate > best[end]:
            best[end] = candidate
            count[end] = count[end - 1] + len(s[end - 1].encode("utf-8", "surrogatepass"))

    def _segment(self, s: str) -> tuple[int, float]:
        found = self.memo.get(s)
        if found is None:
            stem = s.rstrip(CLOSING)
            end = s[len(stem):]
            if stem and end and len(end) <= 4 and (stem[-1], end[0]) not in self.inside:    # no piece spans them
                a, b = self._segment(stem), self._segment(end)
                found = a[0] + b[0], a[1] + b[1]
            else:
                found = self.path(s)
            if len(s) <= MEMO_CHARS:
                if len(self.memo) >= MEMO_SEGMENTS:
                    self.memo.clear()
                self.memo[s] = found
        return found

    def __call__(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        spelt = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return self.path(spelt)
        parts, memo = self.segments.findall(spelt), self.memo
        new = set(parts).difference(memo)
        if new:
            for s in new:
                self._segment(s)
            found = [memo[s] if s in memo else self._segment(s) for s in parts]
        else:
            found = [memo[s] for s in parts]
        pieces, scores = zip(*found)
        return sum(pieces), sum(scores)


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_tokens, score, n_chars."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)     # as large as the vocabulary, not as the corpus
    name = uuid.uuid4().hex

    def run(batches):
        if name not in _COUNTERS:                                     # one automaton and memo per worker
            _COUNTERS.clear()
            _COUNTERS[name] = Counter(shared.value)
        counter = _COUNTERS[name]
        for b in batches:
            texts = b.column(1)
            found = [counter(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.float64()),
                pa.array([len(t.as_py() or "") for t in texts], pa.int64())], names=["doc_id", "n_tokens", "score", "n_chars"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, score double, n_chars long")
