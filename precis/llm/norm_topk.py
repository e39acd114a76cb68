"""Exact top-k by integer inner product over norm-bucketed candidates.

Components become floor(scale * x). Candidates are grouped by length (quantile ranges of the squared length over all
rows; a range with many equal lengths is divided by a hash), longest first. A query's k-th best score over a bounded
sample of candidates is a floor under its final k-th score; it gives each bucket a local cosine threshold

    floor / (|query| * longest of the bucket)

Above 1 the bucket is left out before any shuffle. Below, the bucket's own task chooses: at small thresholds length
pruning (the bucket is sorted by length; only the prefix long enough to reach the floor is multiplied), at large ones
coordinate pruning (on the query's largest coordinates a candidate must lie in the interval that the cosine allows).
What is left is multiplied and compared exactly (integers within 2^53 in doubles). Each task returns at most k per
query and bucket; a window keeps the k best.

Queries are put into chunks by their reach (floor / |query|, the shortest length that can still matter), so a bucket is
sent only to the chunks that have a query reaching it.

Vectors that are null or hold null or non-finite components take no part; empty ones do, with score 0. Vectors of
different lengths: missing components are 0. Ties go to the smaller vec_id. Null vec_id: no part. Only a query's own row
is no candidate of it: rows that repeat a vec_id are queries of their own and each other's candidates. Empty table: no
rows. Extra columns are ignored.

Tasks hold one bucket (about ``BUCKET`` candidates, more beyond ``MAX_RANGES`` buckets) and one chunk of about ``CHUNK``
queries (more beyond ``MAX_RANGES`` chunks): the query set against all rows, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import cut, matrix, n_partitions

BUCKET = 8_192
CHUNK = 2_048
MAX_RANGES = 2_000
SEEDS = 4_096
STEEP = 0.8
FOCUS = 3


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best by (score descending, id ascending)."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= least)
    else:
        pick = np.arange(len(scores))
    return pick[np.lexsort((ids[pick], -scores[pick]))[:k]]


def _in_ranges(rows: DataFrame, value: str, name: str, size: int) -> tuple[DataFrame, list[float]]:
    """``rows`` with a column ``name`` that numbers groups of about ``size`` rows, and every group's largest value.

    Groups are quantile ranges of ``value``, largest first; a range that came out larger is divided by a hash of the row.
    """
    n = rows.count()
    size = max(size, math.ceil(n / MAX_RANGES))
    ranges = max(1, math.ceil(n / size))
    at = rows.agg(F.percentile_approx(value, [1 - i / ranges for i in range(1, ranges)], 10_000)).first()[0] if ranges > 1 else []
    at = sorted(set(at), reverse=True)
    place = F.size(F.filter(F.array(*[F.lit(float(a)) for a in at]), lambda a: a > F.col(value))) if at else F.lit(0)
    placed = rows.withColumn("range", place.cast("int"))
    found = {r["range"]: (r["n"], r["most"]) for r in
             placed.groupBy("range").agg(F.count("*").alias("n"), F.max(value).alias("most")).collect()}   # a row per range
    first, parts, most = [], [], []
    for r in range(len(at) + 1):
        rows_in, largest = found.get(r, (0, 0.0))
        first.append(len(most))
        parts.append(max(1, math.ceil(rows_in / size)))
        most += [largest] * math.ceil(rows_in / size)
    of = lambda numbers: F.array(*[F.lit(x) for x in numbers])[F.col("range")]
    number = of(first) + F.pmod(F.xxhash64("row"), of(parts)).cast("int")
    return placed.withColumn(name, number).drop("range"), most


def top_k(vectors: DataFrame, is_query, k: int = 20, scale: int = 64, seed: int = 42) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors(vec_id, embedding)`` where ``is_query`` holds."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    usable = (F.col("vec_id").isNotNull() & e.isNotNull()
              & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    ints = F.transform(e.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))).cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.coalesce(usable, F.lit(False)))
    rows = rows.select("vec_id", ints.alias("v"))
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    rows = cut(rows.withColumn("v", F.when(F.size("v") < dim, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))))
                               .otherwise(F.col("v")))
               .withColumn("len2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
               .withColumn("row", F.monotonically_increasing_id()))            # kept by the checkpoint
    placed, longest2 = _in_ranges(rows, "len2", "bucket", BUCKET)
    longest = [math.sqrt(x) for x in longest2]

    seeds = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "row").limit(SEEDS).toArrow()      # bounded
    seed_v = matrix(seeds["v"], dim) if len(seeds) else np.zeros((0, dim))
    seed_row = seeds["row"].to_numpy()

    def floors(batches):
        for b in batches:
            own, q = b.column(0).to_numpy(), matrix(b.column(2), dim)
            low = np.full(len(own), -np.inf)
            s = q @ seed_v.T
            s[own[:, None] == seed_row[None, :]] = -np.inf
            if s.shape[1] >= k:
                low = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(low)], names=["row", "vec_id", "v", "len2", "low"])

    queries = cut(rows.where(is_query(F.col("vec_id"))).select("row", "vec_id", "v", "len2")
                  .mapInArrow(floors, "row long, vec_id long, v array<double>, len2 double, low double")
                  .withColumn("reach", F.when(F.col("low") > 0, F.col("low") / F.sqrt("len2") * (1 - 1e-12)).otherwise(0.0))
                  .withColumn("near", -F.col("reach")))
    queries, nearest = _in_ranges(queries, "near", "chunk", CHUNK)
    buckets, chunks = len(longest), len(nearest)
    if not buckets or not chunks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # buckets come longest first and chunks of least reach first, so both meet a prefix of the other
    n_asked = F.size(F.filter(F.array(*[F.lit(x) for x in longest]), lambda x: x >= F.col("reach")))
    n_offered = F.array(*[F.lit(sum(-x <= long for x in nearest)) for long in longest])[F.col("bucket")]
    numbers = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = (queries.withColumn("n", n_asked).where("n > 0")
             .select(numbers(F.col("n")).alias("bucket"), "chunk", F.lit(True).alias("ask"), "row", "vec_id", "v", "len2", "low"))
    offered = (placed.withColumn("n", n_offered).where("n > 0")
               .select("bucket", numbers(F.col("n")).alias("chunk"), F.lit(False).alias("ask"), "row", "vec_id", "v", "len2",
                       F.lit(0.0).alias("low")))

    def answer(g: pa.Table) -> pa.Table:
        ask = g["ask"].to_numpy()
        ids, row, v, len2, low = g["vec_id"].to_numpy(), g["row"].to_numpy(), matrix(g["v"], dim), g["len2"].to_numpy(), g["low"].to_numpy()
        cand = np.flatnonzero(~ask)
        cand = cand[np.argsort(-len2[cand], kind="stable")]
        c_id, c_row, c_v, c_len = ids[cand], row[cand], v[cand], np.sqrt(len2[cand])
        c_unit = c_v / np.maximum(c_len, 1e-300)[:, None]
        out_q, out_row, out_id, out_s = [], [], [], []

        def keep(q, which, s):
            ok = (c_row[which] != row[q]) & (s >= low[q])
            s, found = s[ok], c_id[which][ok]
            best = _top(s, found, k)
            out_q.append(np.full(len(best), ids[q]))
            out_row.append(np.full(len(best), row[q]))
            out_id.append(found[best])
            out_s.append(s[best])

        asking = np.flatnonzero(ask) if len(cand) else []
        by_length = []
        for q in asking:
            q_len = math.sqrt(len2[q])
            local = low[q] / (q_len * c_len[0]) if q_len * c_len[0] > 0 and np.isfinite(low[q]) else -1.0
            if local < STEEP:
                by_length.append(q)
                continue
            unit = v[q] / q_len                                       # coordinate pruning
            angle = math.acos(min(1.0, local)) + 1e-9
            some = np.ones(len(cand), dtype=bool)
            for f in np.argsort(-np.abs(unit))[:FOCUS]:
                at_f = math.acos(max(-1.0, min(1.0, unit[f])))
                some &= (c_unit[:, f] >= math.cos(min(math.pi, at_f + angle)) - 1e-9) \
                    & (c_unit[:, f] <= math.cos(max(0.0, at_f - angle)) + 1e-9)
            keep(q, some, c_v[some] @ v[q])
        for s0 in range(0, len(by_length), 64):                        # length pruning
            some_q = by_length[s0:s0 + 64]
            ends = [int(np.searchsorted(-c_len, -(low[q] / math.sqrt(len2[q])) * (1 - 1e-12), side="right"))
                    if low[q] > 0 and len2[q] > 0 else len(cand) for q in some_q]
            products = v[some_q] @ c_v[:max(ends)].T
            for q, end, product in zip(some_q, ends, products):
                keep(q, slice(0, end), product[:end])
        cat = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"query_id": cat(out_q, np.int64), "row": cat(out_row, np.int64), "vec_id": cat(out_id, np.int64), "score": cat(out_s, np.int64)})

    found = (offered.unionByName(asked).repartition(max(n_partitions(spark), min(buckets * chunks, 4_000)), "bucket", "chunk")
             .groupBy("bucket", "chunk").applyInArrow(answer, "query_id long, row long, vec_id long, score long"))
    w = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
