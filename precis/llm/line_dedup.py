"""Line dedup: sharded minimal perfect hashes over the distinct line hashes, probed by the documents' lines.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased; it stands as two 64-bit hashes
(128 bits). Every row is a document. Steps:

1. Count, per distinct key, the documents that hold it (distinct keys per document, partial aggregation, one shuffle).
2. Deal the distinct keys to shards of about ``KEYS_PER_SHARD`` and build, per shard, a minimal perfect hash (levels of
   bit arrays; a key sits where it is alone) that indexes two compact arrays: 32-bit fingerprints and saturated counts.
3. Send the documents' line hashes (no text) to their shard, behind the shard's arrays, and look them up; the places of
   lines found in ``min_docs`` documents or more come back and are put together per document.
4. Join these places with the documents and keep the other lines.

A key that a very large number of documents holds (``HEAVY_DOCS``, and at least 1 / ``MAX_HEAVY`` of all document lines,
so there are at most ``MAX_HEAVY`` such keys) would make its shard hot. These keys have an index of their own, with
64-bit fingerprints, which is broadcast: its size is bounded by that constant, whatever the corpus. Their lines are
decided where the document is read. Every other key brings a shard few rows, so shards stay even.

A wrong drop needs two different lines with the same 128-bit hash. Defined cases: null or empty text: one empty line,
kept; an empty key (fewer than ``min_chars`` code points) is never dropped; rows that repeat count as documents each and
lose the same lines; null ids are told apart by the text's hashes; empty table: no rows; if all lines go, the text is
empty. Very long texts: linear in their lines. Extra columns aren't read. Nothing is capped or sampled.
"""

from __future__ import annotations

import math
import pickle
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from precis.llm.common import cut, sorted_groups

STRIPPED = " \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 20_000
SHARDS_PER_TASK = 4
MAX_HEAVY = 200_000
HEAVY_DOCS = 5_000
SPREAD = 2                       # bits per key of a level
WIDE = np.uint64


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIPPED)), string.ascii_uppercase, string.ascii_lowercase)


def lines_of(text) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _mixed(h: np.ndarray, level: int, odd: int) -> np.ndarray:
    """64-bit finaliser of ``h`` plus a multiple of ``level``."""
    x = h + WIDE((level * odd) & (2 ** 64 - 1))
    x = (x ^ (x >> WIDE(33))) * WIDE(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> WIDE(33))) * WIDE(0xC4CEB9FE1A85EC53)
    return x ^ (x >> WIDE(33))


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = _mixed(h1, level + 1, 0x9E3779B97F4A7C15) ^ _mixed(h2, level + 1, 0xD1B54A32D192ED03)
    return (mixed % WIDE(size)).astype(np.int64)


class LineIndex:
    """Minimal perfect hash of distinct (h1, h2) pairs over arrays of fingerprints and saturated counts."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, fingerprint=np.uint32, count=np.uint8):
        h1, h2 = h1.view(WIDE), h2.view(WIDE)
        n = len(h1)
        self.n = n
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []    # size, words, keys before each word
        self.fingerprints = np.zeros(n, dtype=fingerprint)
        self.counts = np.zeros(n, dtype=count)
        left, before = np.arange(n), 0
        while len(left):
            size = max(64, SPREAD * len(left))
            at = _place(h1[left], h2[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size)[at] == 1
            bits = np.zeros((size + 63) // 64 * 64, dtype=np.uint8)
            bits[at[alone]] = 1
            words = np.packbits(bits, bitorder="little").view("<u8")
            ranks = before + np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]
            self.levels.append((size, words, ranks.astype(np.uint32)))
            before += int(alone.sum())
            left = left[~alone]
        slot = self.slots(h1, h2)
        self.fingerprints[slot] = h2.astype(fingerprint)
        self.counts[slot] = np.minimum(counts, np.iinfo(count).max).astype(count)

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot per key, -1 where no level has one."""
        out = np.full(len(h1), -1, dtype=np.int64)
        left = np.arange(len(h1))
        for level, (size, words, ranks) in enumerate(self.levels):
            at = _place(h1[left], h2[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(WIDE)
            hit = (word >> bit) & WIDE(1) == 1
            below = np.bitwise_count(word & ((WIDE(1) << bit) - WIDE(1)))
            out[left[hit]] = ranks[at[hit] >> 6].astype(np.int64) + below[hit]
            left = left[~hit]
            if not len(left):
                break
        return out

    def count(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Saturated document count per key; 0 for keys whose fingerprint isn't in their slot."""
        h1, h2 = h1.view(WIDE), h2.view(WIDE)
        slot = self.slots(h1, h2)
        known = slot >= 0
        known[known] = self.fingerprints[slot[known]] == h2[known].astype(self.fingerprints.dtype)
        out = np.zeros(len(h1), dtype=np.int64)
        out[known] = self.counts[slot[known]]
        return out


def _hashed(df: DataFrame, min_chars: int) -> DataFrame:
    """Rows with a column ``key`` -> the same with h1, h2 instead; too short keys go."""
    return (df.where(F.char_length("key") >= min_chars)
            .withColumns({"h1": F.xxhash64("key"), "h2": F.xxhash64(F.lit(7), "key")}).drop("key"))


def _row_key(id_col: str) -> list[Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def key_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(h1, h2, n): documents per distinct line key."""
    keys = F.array_distinct(F.transform(lines_of(F.col("text")), line_key))
    rows = docs.select(F.explode_outer(keys).alias("key"))
    return _hashed(rows, min_chars).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))


def _shard_indexes(counts: DataFrame, n_shards: int, count_type) -> DataFrame:
    """(shard, blob): the index of every shard."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (shard,), t in sorted_groups(batches, ["shard"]):
            h1, h2, n = (t.column(c).to_numpy() for c in ("h1", "h2", "n"))
            blob = pickle.dumps(LineIndex(h1.copy(), h2.copy(), n, count=count_type))
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([blob], pa.binary())], ["shard", "blob"])

    dealt = (counts.withColumn("shard", F.pmod("h1", F.lit(n_shards).cast("long")))
             .repartition(1 + n_shards // SHARDS_PER_TASK, "shard").sortWithinPartitions("shard"))
    return dealt.select("shard", "h1", "h2", "n").mapInArrow(build, "shard long, blob binary")


def common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id") -> DataFrame:
    """(id, t1, t2, dropped): per document that loses lines, the places (from 0) of these lines."""
    docs = docs.select(id_col, "text")
    counts = cut(key_counts(docs, min_chars))
    whole = counts.agg(F.count("*").alias("keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("lines")).first()
    n_shards = max(1, math.ceil(whole["keys"] / KEYS_PER_SHARD))
    heavy_n = max(HEAVY_DOCS, min_docs, math.ceil(whole["lines"] / MAX_HEAVY))
    count_type = np.uint8 if min_docs < 256 else np.uint32
    heavy = counts.where(F.col("n") >= heavy_n).toPandas()            # at most MAX_HEAVY rows
    shared = docs.sparkSession.sparkContext.broadcast(
        LineIndex(heavy.h1.to_numpy(np.int64).copy(), heavy.h2.to_numpy(np.int64).copy(), heavy.n.to_numpy(np.int64), np.uint64, count_type))

    @F.pandas_udf("boolean")
    def is_heavy(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(shared.value.count(h1.to_numpy(np.int64).copy(), h2.to_numpy(np.int64).copy()) >= min_docs)

    places = _hashed(docs.select(*_row_key(id_col), F.posexplode_outer(lines_of(F.col("text"))).alias("pos", "line"))
                     .withColumn("key", line_key(F.col("line"))).drop("line"), min_chars)
    kind = docs.schema[id_col].dataType.simpleString()
    places = places.withColumn("shard", F.when(is_heavy("h1", "h2"), -1).otherwise(F.pmod("h1", F.lit(n_shards).cast("long"))))
    nothing = F.lit(None)
    arrays = _shard_indexes(counts, n_shards, count_type).select(
        "shard", F.lit(0).alias("kind"), "blob", nothing.cast(kind).alias("id"), *(nothing.cast("long").alias(c) for c in ("t1", "t2")),
        nothing.cast("int").alias("pos"), *(nothing.cast("long").alias(c) for c in ("h1", "h2")))
    probes = places.select(F.col("shard").cast("long").alias("shard"), F.lit(1).alias("kind"), nothing.cast("binary").alias("blob"),
                           "id", "t1", "t2", "pos", "h1", "h2")
    # heavy lines (shard -1) are decided: dealt by document so that none of them makes a task long
    dealt = F.when(F.col("shard") >= 0, F.col("shard")).otherwise(-1 - F.pmod(F.col("t1"), F.lit(n_shards).cast("long")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = None, None
        for b in batches:
            shard, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            starts = np.flatnonzero(np.r_[True, (np.diff(shard) != 0) | (np.diff(kind) != 0)]) if b.num_rows else []
            for s, e in zip(starts, [*starts[1:], b.num_rows]):
                part = b.slice(s, e - s)
                if shard[s] >= 0 and kind[s] == 0:
                    index, at = pickle.loads(part.column(2)[0].as_py()), shard[s]
                    continue
                if shard[s] >= 0:
                    assert at == shard[s], "the shard's arrays come before its probes"
                    h1, h2 = (part.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (7, 8))
                    part = part.filter(pa.array(index.count(h1, h2) >= min_docs))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in (3, 4, 5, 6)], ["id", "t1", "t2", "pos"])

    routed = (arrays.unionByName(probes).withColumn("dealt", dealt)
              .repartition(1 + n_shards // SHARDS_PER_TASK, "dealt").sortWithinPartitions("shard", "kind")
              .select("shard", "kind", "blob", "id", "t1", "t2", "pos", "h1", "h2"))
    found = routed.mapInArrow(look_up, f"id {kind}, t1 long, t2 long, pos int")
    return found.groupBy("id", "t1", "t2").agg(F.collect_set("pos").alias("dropped"))


def without_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Per row: the id, n_lines, n_dropped, text (the lines that stay, joined by newlines)."""
    dropped = common_lines(docs, min_docs, min_chars, id_col)
    # the lines are split before the join: an array column there, not an expression copied into each element's lambda
    rows = docs.select(*_row_key(id_col), lines_of(F.col("text")).alias("lines"))
    d = dropped.select(F.col("id").alias("d_id"), F.col("t1").alias("d1"), F.col("t2").alias("d2"), "dropped")
    same = F.col("id").eqNullSafe(F.col("d_id")) & (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2"))
    n = F.size("lines")
    gone = F.coalesce("dropped", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), n - 1), gone)
    return rows.join(d, same, "left").select(
        F.col("id").alias(id_col), n.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"),
        F.array_join(F.transform(kept, lambda i: F.col("lines")[i]), "\n").alias("text"))
