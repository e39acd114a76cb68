"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

1. Vectors that are null, zero or hold null or non-finite components are set aside; they link with nothing. Equal vectors
   become one class (smallest vec_id) with a weight. Vectors link only with those of their own length: each length has its
   own tables; lengths of at most ``BLOCK`` classes, but for the most frequent, are compared pair by pair in one job.
2. Iterative quantisation on a bounded sample (``FIT_ROWS`` classes): centred principal directions, then alternately
   codes = signs of the rotated data and the rotation that brings the data nearest to its codes. Several starts give
   several codes; together they are the code of a vector.
3. Every code is cut into substrings, each the index of one Hamming table. The width grows with the number of classes,
   so buckets stay small; the number of tables is what pairs at exactly the threshold need to share a bucket with
   probability ``RECALL``, at the angle that they have once the mean is subtracted. Where a common direction makes that
   angle so wide that it costs more than it saves, nothing is subtracted and the rotations are random.
4. Within a bucket, pairs whose whole codes are near enough in Hamming distance mark their rows; only marked rows fetch
   their vectors and are compared by cosine in double precision. A pair counts in the first table that it shares, so
   links are counted without writing pairs: a task gives link counts per row and one tree per connected group.
5. A bucket with more than ``BLOCK`` rows is dealt as pairs of blocks, so no task holds more than two blocks, however
   many copies there are.

Links found are exact (cosine >= threshold); recall is measured in the tests. Null vec_id: takes no part, component and
kept are null. Rows that repeat a vec_id link like others. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precis.llm.common import connected_components, cut, matrix, n_partitions, sorted_groups

FIT_ROWS = 20_000
FIT_ROUNDS = 30
RECALL = 0.995
BLOCK = 2_048
BUCKET_ROWS = 64
SLACK = 4.0
MAX_TABLES = 4_096


def fit_itq(x: np.ndarray, bits: int, seed: int, centred: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) with codes = (x - mean) @ projection > 0; not centred: mean 0 and a random rotation."""
    mean = x.mean(axis=0) if centred else np.zeros(x.shape[1])
    c = x - mean
    _, _, vt = np.linalg.svd(c.T @ c / max(1, len(x)))
    pcs = vt[:bits].T
    v = c @ pcs
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
    for _ in range(FIT_ROUNDS if centred else 0):
        codes = np.where(v @ rotation >= 0, 1.0, -1.0)
        u, _, wt = np.linalg.svd(codes.T @ v)
        rotation = (u @ wt).T
    return mean, pcs @ rotation


def _agreement(cosine):
    """Share of equal signs of two vectors at this cosine."""
    return 1 - np.arccos(np.clip(cosine, -1.0, 1.0)) / math.pi


def _tables(agree: np.ndarray, width: int) -> int | None:
    """Tables that pairs with these agreements need to share a bucket with mean probability ``RECALL``, if few enough."""
    miss = 1 - np.minimum(agree, 1.0) ** width
    low, high = 1, MAX_TABLES
    if (miss ** high).mean() > 1 - RECALL:
        return None
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if (miss ** mid).mean() <= 1 - RECALL else (mid + 1, high)
    return low


def plan_tables(n: int, fit: np.ndarray, threshold: float, seed: int) -> tuple[int, int, int, bool, float]:
    """(bits of a table's index, tables, rotations, centred, share of bits that differ at the threshold) for n classes.

    Subtracting the mean makes buckets even but widens the angle of a pair where vectors share a direction: two vectors u,
    v with |u - v|^2 = 2 (1 - threshold), both at distance q^0.5 from the mean, are then at cosine 1 - (1 - threshold) / q.
    Tables are planned for that angle at each vector of the sample; without centring the angle is the threshold's. The
    plan of least cost (rows written and rows met in their buckets) is taken.
    """
    dim = fit.shape[1]
    most = max(4, min(24, dim, math.ceil(math.log2(max(2, n / BUCKET_ROWS)))))
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, len(fit), size=(2, 20_000))
    a, b = a[a != b], b[a != b]
    best = None
    for centred in (True, False):
        x = fit - fit.mean(axis=0) if centred else fit
        q = (x * x).sum(axis=1) if centred else np.ones(len(x))
        agree = _agreement(1 - (1 - threshold) / np.maximum(q, 1e-12))
        norm = np.sqrt(q)
        other = _agreement((x[a] * x[b]).sum(axis=1) / np.maximum(norm[a] * norm[b], 1e-12))
        for width in range(min(4, dim), min(most, dim) + 1):
            tables = _tables(agree, width)
            if tables:
                met = n * (other ** width).mean() if len(a) else 0.0
                cost = tables * (BUCKET_ROWS + tables + met)
                if best is None or cost < best[0]:
                    best = cost, width, tables, centred, 1 - float(np.quantile(agree, 0.001))
    _, width, tables, centred, far = best
    return width, tables, math.ceil(tables / max(1, dim // width)), centred, far


def _usable(v):
    ok = v.isNotNull() & (F.size(v) > 0)
    return F.coalesce(ok & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
                      & F.exists(v, lambda x: x != 0), F.lit(False))


def _components(adjacent: np.ndarray) -> np.ndarray:
    """Smallest index connected with each index."""
    root = np.full(len(adjacent), -1)
    for i in range(len(adjacent)):
        if root[i] < 0:
            todo = np.array([i])
            root[i] = i
            while len(todo):
                todo = np.flatnonzero(adjacent[todo].any(axis=0) & (root < 0))
                root[todo] = i
    return root


def _first_shared(subs: np.ndarray, a: np.ndarray, b: np.ndarray, table: int) -> np.ndarray:
    """For index pairs: no earlier table holds both in one bucket."""
    if not table:
        return np.ones(len(a), dtype=bool)
    return ~(subs[a, :table] == subs[b, :table]).any(axis=1)


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, seed: int = 42) -> DataFrame:
    """Per row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    usable = _usable(F.col("embedding")) & F.col("vec_id").isNotNull()
    x = F.col("embedding").cast("array<double>")
    key = [F.xxhash64(F.lit(s), x) for s in (1, 2)]
    v = v.withColumns({"h1": F.when(usable, key[0]), "h2": F.when(usable, key[1])})
    classes = cut(v.where("h1 is not null").groupBy("h1", "h2").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first(x).alias("x")).withColumn("dim", F.size("x")))
    lengths = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").collect()
    # the most frequent length and any other of more than a block's classes each by tables; the rest, pair by pair at once
    large = [r for k, r in enumerate(lengths) if not k or r["count"] > BLOCK]
    found = [_links(classes.where(F.col("dim") == r.dim).select("id", "weight", "x"), r.dim, r["count"], threshold, seed)
             .withColumn("dim", F.lit(r.dim)) for r in large]
    if len(lengths) > len(large):
        few = classes.where(~F.col("dim").isin([r.dim for r in large])).select("dim", "id", "weight", "x")
        found.append(cut(few.repartition(n_partitions(vectors.sparkSession), "dim").sortWithinPartitions("dim", "id").mapInArrow(
            _all_pairs_with(threshold), "dim int, id long, links long, mate long")))
    if not found:                                                         # no usable vector
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
                        (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    found = functools.reduce(DataFrame.unionByName, found)
    links = found.groupBy("id", "dim").agg(F.sum("links").alias("links"))
    comp = connected_components(found.select(F.col("id").alias("a"), F.col("mate").alias("b")))
    per_class = cut(classes.select("h1", "h2", "id", "dim", "weight").join(links, ["id", "dim"], "left").join(comp, "id", "left")
                    .select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n"),
                            F.coalesce("component", "id").alias("c")))
    return (v.join(per_class, ["h1", "h2"], "left")
            .select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("c", "vec_id").alias("component_id"),
                    (F.col("vec_id") == F.coalesce("c", "vec_id")).alias("kept")))


def _all_pairs_with(threshold: float):
    """All links among the classes of one length: at most ``BLOCK``, so no tables are needed."""
    def every(batches):
        for key, g in sorted_groups(batches, ["dim"]):
            u = matrix(g["x"], key[0])
            u = u / np.linalg.norm(u, axis=1, keepdims=True)
            adjacent = u @ u.T >= threshold
            np.fill_diagonal(adjacent, False)
            links = adjacent @ g["weight"].to_numpy()
            has = links > 0
            if has.any():
                ids, root = g["id"].to_numpy(), _components(adjacent)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(has.sum(), key[0], np.int32)), pa.array(ids[has]), pa.array(links[has]), pa.array(ids[root[has]])],
                    names=["dim", "id", "links", "mate"])
    return every


def _links(classes: DataFrame, dim: int, n: int, threshold: float, seed: int) -> DataFrame:
    """(id, links, mate) of ``classes(id, weight, x)``, n vectors of one length: links found per table and group, one tree."""
    sample = classes.select("x").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(FIT_ROWS).toArrow()
    fit = matrix(sample["x"], dim)
    fit = fit / np.maximum(np.linalg.norm(fit, axis=1, keepdims=True), 1e-300)
    width, tables, rotations, centred, far = plan_tables(n, fit, threshold, seed)
    models = [fit_itq(fit, dim, seed + r, centred) for r in range(rotations)]
    per_rotation = max(1, dim // width)
    bits = dim * rotations
    reach = int(math.ceil(bits * far + SLACK * math.sqrt(bits * far * (1 - far))))

    def encode(batches):
        for b in batches:
            u = matrix(b.column(2), dim)
            u = u / np.linalg.norm(u, axis=1, keepdims=True)
            signs = [(u - m) @ p > 0 for m, p in models]
            code = np.packbits(np.hstack(signs), axis=1)
            pad = -code.shape[1] % 8
            code = np.pad(code, ((0, 0), (0, pad)))
            weights = 1 << np.arange(width, dtype=np.int64)
            subs = [signs[t // per_rotation][:, (t % per_rotation) * width:(t % per_rotation + 1) * width] @ weights
                    for t in range(tables)]
            subs = np.stack(subs, axis=1).astype(np.int32)
            rows = len(u)
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1),
                pa.array([c.tobytes() for c in code], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * tables), pa.array(subs.ravel()))],
                names=["id", "weight", "code", "subs"])

    codes = cut(classes.select("id", "weight", "x").mapInArrow(
        encode, "id long, weight long, code binary, subs array<int>"))
    # rows of a bucket, dealt in blocks where it is large
    member = codes.select("id", "weight", "code", "subs", F.posexplode("subs").alias("t", "bucket"))
    counts = member.groupBy("t", "bucket").agg(F.count("*").alias("k")).where("k > 1")
    blocks = F.ceil(F.col("k") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = (member.join(counts, ["t", "bucket"]).withColumn("blocks", blocks).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("t", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                     F.col("own").alias("block"), "id", "weight", "code", "subs"))
    keys = ["t", "bucket", "i", "j"]
    parts = n_partitions(classes.sparkSession)

    def pairs(table, near):
        """Index pairs of a group for which ``near(rows a, rows b)`` holds: within one block, or between its two."""
        block = table["block"].to_numpy()
        lo, hi = block.min(), block.max()
        a_all, b_all = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
        for s in range(0, len(a_all), 256):
            a = a_all[s:s + 256]
            i, j = np.nonzero(near(a, b_all))
            i, j = a[i], b_all[j]
            keep = i < j if lo == hi else slice(None)
            yield i[keep], j[keep]

    def mark(batches):
        for key, g in sorted_groups(batches, keys):
            if key[2] != key[3] and len(set(g["block"].to_pylist())) < 2:
                continue
            code = np.frombuffer(b"".join(g["code"].to_pylist()), dtype=np.uint64).reshape(g.num_rows, -1)
            subs = matrix(g["subs"], tables)
            active = np.zeros(g.num_rows, dtype=bool)

            def near(a, b):
                d = np.zeros((len(a), len(b)), dtype=np.int32)
                for w in range(code.shape[1]):
                    d += np.bitwise_count(code[a, w][:, None] ^ code[b, w][None, :])
                return d <= reach

            for a, b in pairs(g, near):
                ok = _first_shared(subs, a, b, key[0])
                active[a[ok]] = active[b[ok]] = True
            if active.any():
                yield from g.select([*keys, "block", "id", "weight", "subs"]).filter(pa.array(active)).to_batches()

    marked = (dealt.repartition(parts, *keys).sortWithinPartitions(*keys)
              .mapInArrow(mark, "t int, bucket int, i int, j int, block int, id long, weight long, subs array<int>"))

    def verify(batches):
        for key, g in sorted_groups(batches, keys):
            u = matrix(g["x"], dim)
            u = u / np.linalg.norm(u, axis=1, keepdims=True)
            subs, w, ids = matrix(g["subs"], tables), g["weight"].to_numpy(), g["id"].to_numpy()
            links = np.zeros(len(u), dtype=np.int64)
            adjacent = np.zeros((len(u), len(u)), dtype=bool)
            for a, b in pairs(g, lambda a, b: u[a] @ u[b].T >= threshold):
                ok = _first_shared(subs, a, b, key[0])
                a, b = a[ok], b[ok]
                np.add.at(links, a, w[b])
                np.add.at(links, b, w[a])
                adjacent[a, b] = adjacent[b, a] = True
            if links.any():
                root = _components(adjacent)
                has = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[has]), pa.array(links[has]), pa.array(ids[root[has]])],
                                                 names=["id", "links", "mate"])

    return cut(marked.join(classes.select("id", "x"), "id").select(*keys, "block", "id", "weight", "subs", "x")
               .repartition(parts, *keys).sortWithinPartitions(*keys)
               .mapInArrow(verify, "id long, links long, mate long"))
