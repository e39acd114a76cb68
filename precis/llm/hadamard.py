"""Centroid clustering (Lloyd rounds) with Walsh-Hadamard progressive search.

Vectors with exactly ``DIM`` components, none null or non-finite, become integers floor(64 * x). Vectors and centroids go
through the exact integer Walsh-Hadamard transform, coefficients ordered by sequency (sign changes), so that the first
ones are the coarse shape. Squared distances are kept by the transform up to the factor ``DIM``. A search sums squared
coefficient differences block by block, coarse to fine; the centroid that looks nearest after the first block is
finished at once, and from then on every centroid whose part sum is strictly above the smallest finished sum goes. What
is left is finished to all 64 coefficients, so the nearest centroid and its distance are exact and ties go to the
smaller number.

Each round is one scan: a task sums its vectors per cluster and component, the sums are added up by Spark, and at most
``k * DIM`` numbers reach the driver, which floors the means. Nothing but the centroids is carried between rounds, so a
lost executor only repeats its own tasks. The last assignment is cut into the checkpoint folder before it is summed up.

Defined cases: null vectors, other lengths, null or non-finite components (doubles
whose 64-fold is infinite among them): no row. Repeated rows are vectors of their
own (same id: same hash; equal hashes are taken in the order of their components). A null id hashes as an empty one.
Fewer vectors than ``k``: fewer centroids. Empty table: no rows. Finite components of any size are exact: batches beyond
``SAFE`` are computed with Python's integers; a distance or inertia above the largest long is given as that long. Extra
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import cut, matrix

DIM = 64
SCALE = 64
SAFE = 1 << 24                  # up to here sums of 64 squared coefficient differences fit a long
LARGEST = (1 << 63) - 1
LIMB = 32                       # exact sums travel as base-2^32 digits
BLOCKS = [(0, 4), (4, 8), (8, 16), (16, 32), (32, 64)]


def _sequency_order() -> np.ndarray:
    """Places of the butterfly's coefficients in the order of their sign changes."""
    rows = transform(np.eye(DIM, dtype=np.int64), ordered=False).T
    return np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")


def transform(x: np.ndarray, ordered: bool = True) -> np.ndarray:
    """Walsh-Hadamard transform of the rows of ``x`` (integers), coarse to fine."""
    n, half = len(x), 1
    while half < DIM:
        pairs = x.reshape(n, DIM // (2 * half), 2, half)
        low, high = pairs[:, :, 0], pairs[:, :, 1]
        x = np.stack([low + high, low - high], axis=2).reshape(n, DIM)
        half *= 2
    return x[:, ORDER] if ordered else x


ORDER = _sequency_order()


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, exact squared distance) per row of integer vectors; ties: the smaller number."""
    n, k = len(x), len(centroids)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, x.dtype)
    X, C = transform(x), transform(centroids)
    a, b = BLOCKS[0]
    part = np.zeros((n, k), dtype=X.dtype)
    for j in range(a, b):
        part += (X[:, j, None] - C[None, :, j]) ** 2
    guess = np.asarray([row.argmin() for row in part]) if part.dtype == object else part.argmin(axis=1)
    bound = ((X - C[guess]) ** 2).sum(axis=1)
    row, cen = np.nonzero((part <= bound[:, None]).astype(bool))
    part = part[row, cen]
    for a, b in BLOCKS[1:]:
        part = part + ((X[row, a:b] - C[cen, a:b]) ** 2).sum(axis=1)
        left = np.flatnonzero((part <= bound[row]).astype(bool))
        row, cen, part = row[left], cen[left], part[left]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])          # pairs are in order of (row, centroid)
    least = np.minimum.reduceat(part, first)
    hit = np.flatnonzero((part == np.repeat(least, np.diff(np.r_[first, len(row)]))).astype(bool))
    hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
    return cen[hit], least // DIM


def integers(scaled: np.ndarray, centroids: np.ndarray | None = None) -> np.ndarray:
    """floor(64 x) as longs, or as Python's integers if they (or the centroids) are too large for exact long sums."""
    if np.abs(scaled).max(initial=0) <= SAFE and (centroids is None or centroids.dtype != object):
        return scaled.astype(np.int64)
    return np.array([[int(v) for v in row] for row in scaled], dtype=object).reshape(scaled.shape)


def _centroids(rows: list[list[int]]) -> np.ndarray:
    wide = any(abs(v) > SAFE for r in rows for v in r)
    return np.array(rows, dtype=object if wide else np.int64).reshape(len(rows), DIM)


def _scaled(column) -> np.ndarray:
    return np.floor(matrix(column, DIM).astype(np.float64) * SCALE)


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x array<double>) of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c * SCALE) == float("inf")))
    return vectors.select(F.col(id_col).alias("id"), x.alias("x")).where((F.size("x") == DIM) & ~bad)


def _round(kept: DataFrame, rows: list[list[int]]) -> list[list[int]]:
    """The centroids after one assignment: exact floors of the means; empty clusters stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = _centroids(rows)
        total = [[0] * (DIM + 1) for _ in rows]                       # components, then the number of vectors
        for b in batches:
            x = integers(_scaled(b.column(0)), centroids)
            cluster, _ = nearest(x, centroids)
            for c in np.unique(cluster):
                mine = x[cluster == c]
                for j, v in enumerate(mine.sum(axis=0)):
                    total[c][j] += int(v)
                total[c][DIM] += len(mine)
        out = []
        for c, row in enumerate(total):
            for j, v in enumerate(row if row[DIM] else []):
                limb = 0
                while abs(v) >= 1 << 62:                              # one digit, but for huge components
                    v, low = divmod(v, 1 << LIMB)
                    out.append((c, j, limb, low))
                    limb += 1
                out.append((c, j, limb, v))
        columns = list(zip(*out)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["c", "j", "limb", "v"])

    added = (kept.select("x").mapInArrow(sums, "c int, j int, limb int, v long")
             .groupBy("c", "j", "limb").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")))
    total = [[0] * (DIM + 1) for _ in rows]
    for r in added.collect():                                         # k * (DIM + 1) numbers
        total[r.c][r.j] += int(r.v) << (LIMB * r.limb)
    return [[v // t[DIM] for v in t[:DIM]] if t[DIM] else old for t, old in zip(total, rows)]


def first_centroids(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``<seed>:<id>``, in that order."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    best = kept.withColumn("key", key).orderBy("key", "x").limit(k).collect()
    return [[int(v) for v in np.floor(np.array(r.x) * SCALE)] for r in best]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3,
            seed: int = 1) -> tuple[DataFrame, list[list[int]]]:
    """``(id, cluster, distance)`` per kept vector after ``rounds`` Lloyd rounds, and the centroids as lists of integers."""
    kept = kept_vectors(vectors, id_col, vector_col)
    rows = first_centroids(kept, k, seed)
    for _ in range(rounds):
        rows = _round(kept, rows) if rows else rows

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = _centroids(rows)
        for b in batches:
            cluster, distance = nearest(integers(_scaled(b.column(1)), centroids), centroids)
            distance = [min(int(d), LARGEST) for d in distance] if distance.dtype == object else distance
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())],
                                             ["id", "cluster", "distance"])

    kind = kept.schema["id"].dataType.simpleString()
    out = kept.mapInArrow(assign, f"id {kind}, cluster int, distance long")
    return out.withColumnRenamed("id", id_col), rows


def centroid_sha256(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256 (a table of one row per cluster joins)."""
    assigned = cut(assigned)
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = min(sum(sums.values()), LARGEST)
    table = spark.createDataFrame([(c, min(sums.get(c, 0), LARGEST), whole, centroid_sha256(x)) for c, x in enumerate(centroids)],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster")               # at most k rows
