"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions, overfull ones split.

Records are ordered by (hash of the text, doc_id): equal texts lie together, and a large group of equal texts can still
be divided. A bounded sample, weighted by size (smallest exponential arrivals of rate size, a pure function of the row),
gives the splitters; every record finds its range; a range with more than twice its share is sampled again and
subdivided. Exact running sums of bytes inside each range, on top of the exact sums of the ranges before, then cut the
order into shards: a record goes to the shard in which its middle byte falls. So the law is ``bytes``: shard sizes
differ from the mean by at most one record.

The text is read once and only (id, size, hashes) are shuffled, by range. The driver sees the sample (at most
``MAX_RANGES * OVERSAMPLE`` keys) and one row per range. The number of ranges grows with the rows.

Null text: 16 bytes, null crc. Null ids sort first. Rows that repeat both id and text are told apart by a row number
only, so any of them may get any of their places. Empty table: no rows. Extra columns aren't read.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import cut

OVERHEAD = 16
ROWS_PER_RANGE = 4_000
MAX_RANGES = 20_000
OVERSAMPLE = 8
SPLIT_ROUNDS = 4


def text_key(text):
    """First 60 bits of the text's MD5; null: -1."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(-1).cast("long"))


def _sample(rows: DataFrame, k: int, seed: int) -> list[tuple[int, int, int]]:
    """k keys, drawn with weight = size: the smallest arrival times of exponential clocks of rate size."""
    unit = (F.shiftrightunsigned(F.xxhash64("key", "id", "tie", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(2 ** 53))
    first = rows.select("key", "id", "tie", (-F.log(unit) / F.col("size")).alias("t")).orderBy("t").limit(k)
    return sorted((r.key, r.id, r.tie) for r in first.collect())


def _quantiles(sample: list, parts: int) -> list:
    picks = {sample[i * len(sample) // parts] for i in range(1, parts)} if sample else set()
    return sorted(picks)


def _with_range(rows: DataFrame, splitters: list) -> DataFrame:
    keys = np.array([s[0] for s in splitters], dtype=np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series, id_: pd.Series, tie: pd.Series) -> pd.Series:
        k = key.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        i, t = id_.to_numpy(np.int64), tie.to_numpy(np.int64)
        for j in np.flatnonzero(low != high):      # a splitter shares the text's hash: compare ids too
            low[j] = bisect.bisect_right(splitters, (int(k[j]), int(i[j]), int(t[j])), int(low[j]), int(high[j]))
        return pd.Series(low.astype(np.int32))

    return rows.withColumn("range", place("key", "id", "tie"))


def shard(docs: DataFrame, n_shards: int = 40, seed: int = 42) -> DataFrame:
    """Per row: doc_id, size, text_crc32, shard, slot (place in the shard, gapless from 0)."""
    rows = cut(docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"), text_key(F.col("text")).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-2 ** 63)).alias("id"),
        F.monotonically_increasing_id().alias("tie")))
    whole = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"),
                     F.coalesce(F.max("size"), F.lit(0)).alias("longest")).first()
    parts = int(min(MAX_RANGES, max(4 * n_shards, whole.n / ROWS_PER_RANGE)))
    splitters = _quantiles(_sample(rows, parts * OVERSAMPLE, seed), parts)
    fair = 2 * whole.bytes / parts + 2 * whole.longest
    for r in range(SPLIT_ROUNDS):
        placed = _with_range(rows, splitters)
        sums = sorted((x.range, x.bytes, x.rows) for x in placed.groupBy("range").agg(
            F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
        over = {x[0]: x[1] for x in sums if x[1] > fair}
        if not over or r == SPLIT_ROUNDS - 1:
            break
        more = _sample(placed.where(F.col("range").isin(list(over))), parts * OVERSAMPLE, seed + r + 1)
        by_range: dict[int, list] = {}
        for s in more:
            by_range.setdefault(bisect.bisect_right(splitters, s), []).append(s)
        splitters = sorted({*splitters, *(q for k, keys in by_range.items()
                                          for q in _quantiles(keys, 1 + int(2 * over.get(k, 0) / fair) + 1))})
    spark = docs.sparkSession
    starts, b, n = [], 0, 0
    for k, x, m in sums:
        starts.append((k, b, n))
        b, n = b + x, n + m
    offsets = F.broadcast(spark.createDataFrame(starts, "range int, byte0 long, row0 long"))   # one row per range
    order = Window.partitionBy("range").orderBy("key", "id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * (F.col("byte0") + F.sum("size").over(order)) - F.col("size")
    out = cut(placed.join(offsets, "range")
              .withColumn("shard", F.least(F.floor(middle * n_shards / F.lit(2 * max(1, b))), F.lit(n_shards - 1)).cast("int"))
              .withColumn("rank", F.col("row0") + F.row_number().over(order) - 1)
              .select("doc_id", "size", "text_crc32", "shard", "rank"))
    first = F.broadcast(out.groupBy("shard").agg(F.min("rank").alias("rank0")))                # one row per shard
    return out.join(first, "shard").select("doc_id", "size", "text_crc32", "shard",
                                           (F.col("rank") - F.col("rank0")).cast("long").alias("slot"))
