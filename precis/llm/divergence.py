"""Source divergence audit: how a source's use of its language's vocabulary departs from the other sources'.

Terms are runs of ASCII letters and non-ASCII characters, with A-Z lower-cased; null text, lang or source counts as ''.
Every row is a document. A language keeps the terms found in ``min_docs`` of its documents or more. Steps:

1. Distinct terms per document, summed per (lang, term) inside each Arrow batch and then by Spark: the kept terms.
2. The text is read again; every batch gives its occurrences per (lang, source, term), which Spark adds up. Kept terms
   and these term streams are dealt by ranges of (lang, term), kept terms first. A task builds, per language, the minimal
   acyclic transducer of its range from the sorted kept terms (states are merged as soon as no later term can change
   them; an edge's output is the number of terms before it), so the outputs along a term's path add up to its
   lexicographic ordinal in the range. The stream then runs through the transducer, all its terms one byte at a time,
   and occurrences are recounted by ordinal; terms that it doesn't accept aren't kept terms.
   Ranges follow the order of (lang, term), so (range, ordinal) orders a language's terms by their UTF-8 bytes.
3. Smoothed shares p and divergences f in exact integer arithmetic. ``term``: one top-k per group, ties by ordinal.
   ``pair``: tasks hold a block of sources by a block of sources and add up f over their terms; terms that neither source
   has are added by their number, so no row is made for them.

Nothing whole passes through the driver: it sees counts and one row per (lang, source) group. That table is broadcast to
the pair step; the result itself has the square of its rows. Defined cases: empty table: no rows; a group without terms
has pairs (all of the smoothing) and no term rows; V = 0: pairs of value 0; a language with one source: no pairs;
repeated rows count each; very long texts: memory of about ten bytes per byte of the longest. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import cut, sorted_groups

SCALE = 1_000_000_000
TERMS_PER_RANGE = 25_000
CHUNK_BYTES = 4 << 20
SOURCE_BLOCK = 256               # sources of one side of a pair block
TERM_BLOCK = 1_024               # terms that a pair block works on at a time
#: Which bytes belong to terms, and each byte's lower case.
TERM_BYTE = np.array([chr(b).isalpha() or b >= 0x80 for b in range(256)])
TERM_BYTE[0x80:] = True
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


# ---------------------------------------------------------------- terms of Arrow text
def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a string column without nulls."""
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def terms_of(offsets: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms in order, row of each) for rows of UTF-8 bytes."""
    inside = TERM_BYTE[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    bounds = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    terms = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(LOWER[data[inside]])])
    return terms, row


def chunks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``CHUNK_BYTES`` of text: (first row, row after the last, offsets, bytes)."""
    offsets, data = utf8(batch.column(text))
    s = 0
    while s < batch.num_rows:
        e = max(s + 1, int(np.searchsorted(offsets, offsets[s] + CHUNK_BYTES, "right")) - 1)
        yield s, e, offsets[s:e + 1] - offsets[s], data[offsets[s]:offsets[e]]
        s = e


def _codes(batch: pa.RecordBatch, columns: list[int]) -> tuple[np.ndarray, list[tuple]]:
    """Dense number per row of the values of ``columns``, and the values per number."""
    rows = list(zip(*[batch.column(c).to_pylist() for c in columns]))
    known: dict[tuple, int] = {}
    return np.array([known.setdefault(r, len(known)) for r in rows], dtype=np.int64), list(known)


def _counted(codes: np.ndarray, terms: pa.Array, row: np.ndarray, per_row: bool) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(group code, term, n): occurrences per (group, term), or with ``per_row`` the rows that hold the term."""
    d = terms.dictionary_encode()
    term = d.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(1, len(d.dictionary))
    if per_row:
        once = np.unique(row * width + term)
        row, term = once // width, once % width
    pair, n = np.unique(codes[row] * width + term, return_counts=True)
    return pair // width, d.dictionary.take(pa.array(pair % width)), n


def _term_counts(docs: DataFrame, keys: list[str], per_row: bool) -> DataFrame:
    """(keys..., term, n), added up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, values = _codes(b, list(range(len(keys))))
            for s, e, offsets, data in chunks(b, len(keys)):
                terms, row = terms_of(offsets, data)
                group, term, n = _counted(codes[s:e], terms, row, per_row)
                named = [pa.array([v[i] for v in values], pa.string()).take(pa.array(group)) for i in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*named, term.cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64())],
                                                 [*keys, "term", "n"])

    schema = ", ".join(f"{k} string" for k in keys) + ", term string, n long"
    return docs.select(*keys, "text").mapInArrow(count, schema).groupBy(*keys, "term").agg(F.sum("n").alias("n"))


# ---------------------------------------------------------------- the transducer
class Transducer:
    """Minimal acyclic transducer from sorted, distinct byte strings to their ordinals."""

    def __init__(self, terms: list[bytes]):
        register: dict[tuple, int] = {}             # (accepting, edges) -> state
        self.states: list[tuple] = []
        path: list[list] = [[False, []]]            # open states of the last term: [accepting, [(byte, state), ...]]

        def close(state: list) -> int:
            key = (state[0], tuple(state[1]))
            at = register.get(key)
            if at is None:
                at = register[key] = len(self.states)
                self.states.append(key)
            return at

        last = b""
        for term in terms:
            shared = 0
            for a, b in zip(last, term):
                if a != b:
                    break
                shared += 1
            for depth in range(len(last), shared, -1):
                path[depth - 1][1].append((last[depth - 1], close(path.pop())))
            path.extend([False, []] for _ in term[shared:])
            path[-1][0] = True
            last = term
        for depth in range(len(last), 0, -1):
            path[depth - 1][1].append((last[depth - 1], close(path.pop())))
        self.root = close(path[0])
        # states are closed after all that follows them: one pass counts the terms below each
        below = np.zeros(len(self.states), dtype=np.int64)
        keys, to, out = [], [], []
        for s, (accepting, edges) in enumerate(self.states):
            n = int(accepting)
            for byte, nxt in edges:
                keys.append(s << 8 | byte)
                to.append(nxt)
                out.append(n)
                n += int(below[nxt])
            below[s] = n
        self.accepting = np.array([a for a, _ in self.states], dtype=bool)
        self.size = len(terms)
        self._table(np.array(keys, dtype=np.int64), np.array(to, dtype=np.int64), np.array(out, dtype=np.int64))

    def _table(self, keys: np.ndarray, to: np.ndarray, out: np.ndarray) -> None:
        """Edges by (state, byte) in an open hash table, at most half full."""
        self.shift = 64 - max(4, int(2 * len(keys)).bit_length())
        slots = 1 << (64 - self.shift)
        self.keys = np.full(slots, -1, dtype=np.int64)
        self.to, self.out = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            places, firsts = np.unique(at[free], return_index=True)
            placed = np.flatnonzero(free)[firsts]
            e = left[placed]
            self.keys[places], self.to[places], self.out[places] = keys[e], to[e], out[e]
            left, at = np.delete(left, placed), (np.delete(at, placed) + 1) & (slots - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def ordinals(self, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Ordinal per byte string, -1 for those that aren't accepted. All strings advance one byte per step."""
        n = len(offsets) - 1
        length = np.diff(offsets)
        state, total = np.full(n, self.root, dtype=np.int64), np.zeros(n, dtype=np.int64)
        alive = np.arange(n)
        result = np.full(n, -1, dtype=np.int64)
        step, mask = 0, len(self.keys) - 1
        while len(alive):
            done = length[alive] == step
            if done.any():
                e = alive[done]
                e = e[self.accepting[state[e]]]
                result[e] = total[e]
                alive = alive[~done]
                if not len(alive):
                    break
            want = state[alive] << 8 | data[offsets[alive] + step]
            at = self._slot(want)
            search = np.flatnonzero((self.keys[at] != want) & (self.keys[at] >= 0))
            while len(search):
                at[search] = (at[search] + 1) & mask
                here = self.keys[at[search]]
                search = search[(here != want[search]) & (here >= 0)]
            found = self.keys[at] == want
            alive, at = alive[found], at[found]
            state[alive] = self.to[at]
            total[alive] += self.out[at]
            step += 1
        return result


# ---------------------------------------------------------------- counts by ordinal
def counted_by_ordinal(docs: DataFrame, min_docs: int = 3) -> tuple[DataFrame, DataFrame]:
    """(vocabulary (lang, range, ordinal, term), counts (lang, source, range, ordinal, n)), kept terms only."""
    vocabulary = cut(_term_counts(docs, ["lang"], per_row=True).where(F.col("n") >= min_docs).select("lang", "term"))
    ranges = 1 + vocabulary.count() // TERMS_PER_RANGE
    stream = _term_counts(docs, ["lang", "source"], per_row=False)
    rows = vocabulary.select("lang", F.lit(0).alias("kind"), "term", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n")) \
        .unionByName(stream.select("lang", F.lit(1).alias("kind"), "term", "source", "n"))

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        lang, terms, transducer = None, [], None
        for b in batches:
            langs = b.column(0).dictionary_encode()
            code, kind = langs.indices.to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, (np.diff(code) != 0) | (np.diff(kind) != 0)]) if b.num_rows else []
            for s, e in zip(starts, [*starts[1:], b.num_rows]):
                part = b.slice(s, e - s)
                now = part.column(0)[0].as_py()
                if now != lang:
                    lang, terms, transducer = now, [], None
                if kind[s] == 0:
                    first = len(terms)
                    terms += part.column(2).cast(pa.large_binary()).to_pylist()
                    ordinal = np.arange(first, len(terms))
                else:
                    if transducer is None:
                        transducer = Transducer(terms)
                    ordinal = transducer.ordinals(*utf8(part.column(2)))
                    part, ordinal = part.filter(pa.array(ordinal >= 0)), ordinal[ordinal >= 0]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array(np.full(len(ordinal), here), pa.int32()),
                     pa.array(ordinal, pa.int32()), part.column(4), part.column(2)],
                    ["lang", "kind", "source", "range", "ordinal", "n", "term"])

    dealt = rows.repartitionByRange(ranges, "lang", "term").sortWithinPartitions("lang", "kind", "term")
    out = cut(dealt.select("lang", "kind", "term", "source", "n").mapInArrow(
        recount, "lang string, kind int, source string, range int, ordinal int, n long, term string"))
    return (out.where("kind = 0").select("lang", "range", "ordinal", "term"),
            out.where("kind = 1").select("lang", "source", "range", "ordinal", "n"))


# ---------------------------------------------------------------- divergences
def _share(n, total, v):
    """1 + floor(SCALE * (n + 1) / (total + v)) without overflow."""
    whole = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", whole, (total + v).cast("decimal(20,0)"))).cast("long")


def _divergence(p, q):
    return F.call_function("div", (p - q) * (p - q), q)


def groups_of(docs: DataFrame, vocabulary: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, place, v, total, zero) of every occurring group: its number in the language, V, N, p of a count of 0."""
    v = vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = (docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")).drop("rows")
             .join(v, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "total"]))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    zero = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), F.col("total"), F.col("v")))
    return cut(every.select("lang", "source", place.alias("place"), "v", "total", zero.alias("zero")))


def top_terms(counts: DataFrame, groups: DataFrame, vocabulary: DataFrame, k: int = 200) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a group uses more than its language does."""
    whole = counts.groupBy("lang", "range", "ordinal").agg(F.sum("n").alias("lang_n"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    p = _share(F.col("n"), F.col("total"), F.col("v"))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    rows = (counts.join(groups.join(totals, "lang").drop("place", "zero"), ["lang", "source"])
            .join(whole, ["lang", "range", "ordinal"])
            .select("lang", "source", "range", "ordinal", p.alias("p"), q.alias("q")).where("p > q")
            .withColumn("value", _divergence(F.col("p"), F.col("q"))))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "range", "ordinal")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(vocabulary, ["lang", "range", "ordinal"]).select(
        "lang", "source", F.col("term").alias("item"), "value", F.col("rank").cast("int").alias("rank"))


def pair_divergences(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): every other source of the language, by the divergence from it."""
    zeros: dict[str, list[int]] = {}
    for r in groups.where("v > 0").select("lang", "place", "zero").orderBy("lang", "place").collect():
        zeros.setdefault(r.lang, []).append(r.zero)
    shared = groups.sparkSession.sparkContext.broadcast({k: np.array(z, dtype=np.int64) for k, z in zeros.items()})
    p = _share(F.col("n"), F.col("total"), F.col("v"))
    mine = F.floor(F.col("place") / SOURCE_BLOCK).cast("int")
    # one row per block of the other side; the lower block comes first
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / SOURCE_BLOCK).cast("int")))
    sizes = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    rows = (counts.join(groups.join(sizes, "lang"), ["lang", "source"])
            .select("lang", "range", "ordinal", "place", "size", p.alias("p")).withColumn("mine", mine)
            .withColumn("other", other)
            .select("lang", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "range", "ordinal", "place", "p"))
    langs = {name: i for i, name in enumerate(zeros)}

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, now, both, total = list(langs), None, None, None

        def done():
            lang, i, j = now
            a, b = np.nonzero(~np.eye(len(both), dtype=bool))
            if i != j:                              # pairs inside one block belong to the block pair (i, i)
                across = (both[a] // SOURCE_BLOCK) != (both[b] // SOURCE_BLOCK)
                a, b = a[across], b[across]
            return pa.RecordBatch.from_arrays([pa.array([names[lang]] * len(a), pa.string()), pa.array(both[a], pa.int32()),
                                               pa.array(both[b], pa.int32()), pa.array(total[a, b], pa.int64())],
                                              ["lang", "a", "b", "part"])

        for key, t in sorted_groups(batches, ["code", "i", "j", "piece"]):
            if key[:3] != now:
                if now:
                    yield done()
                now = key[:3]
                z = shared.value[names[now[0]]]
                both = np.concatenate([np.arange(k * SOURCE_BLOCK, min(len(z), (k + 1) * SOURCE_BLOCK)) for k in sorted(set(now[1:]))])
                base = _f(z[both][:, None], z[both][None, :])
                total = np.zeros((len(both), len(both)), dtype=np.int64)
            _, term = np.unique(t.column("ordinal").to_numpy(), return_inverse=True)
            m = np.tile(z[both], (int(term.max()) + 1, 1))               # terms x sources: p, that of a count of 0 by default
            m[term, np.searchsorted(both, t.column("place").to_numpy())] = t.column("p").to_numpy()
            for a in range(len(both)):
                total[a] += _f(m[:, a:a + 1], m).sum(axis=0) - base[a] * len(m)
        if now:
            yield done()

    code = F.create_map(*[F.lit(x) for kv in langs.items() for x in kv]) if langs else None
    if code is None:
        parts = groups.sparkSession.createDataFrame([], "lang string, a int, b int, part long")
    else:
        piece = F.shiftleft(F.col("range").cast("long"), 32) + F.floor(F.col("ordinal") / TERM_BLOCK)
        dealt = rows.withColumn("code", code[F.col("lang")]).withColumn("piece", piece)
        dealt = dealt.repartition("code", "i", "j", "piece").sortWithinPartitions("code", "i", "j", "piece")
        parts = dealt.select("code", "i", "j", "piece", "range", "ordinal", "place", "p").mapInArrow(
            add, "lang string, a int, b int, part long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    one = groups.select("lang", "source", F.col("place").alias("a"), "v", F.col("zero").alias("zero_a"))
    two = groups.select("lang", F.col("source").alias("item"), F.col("place").alias("b"), F.col("zero").alias("zero_b"))
    base = F.when(F.col("v") > 0, F.col("v") * _divergence(F.col("zero_a"), F.col("zero_b"))).otherwise(0)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    return (one.join(two, "lang").where("a <> b").join(sums, ["lang", "a", "b"], "left")
            .withColumn("value", base + F.coalesce("part", F.lit(0).cast("long")))
            .select("lang", "source", "item", "value", F.row_number().over(order).alias("rank")))


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def audit(docs: DataFrame, min_docs: int = 3, k: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows (all) and ``term`` rows (ranks up to ``k``) per group."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    vocabulary, counts = counted_by_ordinal(docs, min_docs)
    groups = groups_of(docs, vocabulary, counts)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pair_divergences(counts, groups).withColumn("part", F.lit("pair"))
    terms = top_terms(counts, groups, vocabulary, k).withColumn("part", F.lit("term"))
    return pairs.select(*columns).unionByName(terms.select(*columns))
