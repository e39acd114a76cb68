"""Helpers shared by the operators: lineage cuts, words, connected components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls tab to carriage return.
WORD_RE = r"[^\x20\x09-\x0D]+"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the session names; make one only for a local master that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="precis-llm-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there, so lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id on an edge ``(a, b)``; component = smallest id reachable.

    Alternating large-star and small-star rounds: each round joins the edges with the smallest neighbour of each
    vertex (a partial aggregation, so a hub with a third of all edges isn't gathered anywhere; the join's skew is split
    by AQE) and ends when a round changes nothing. Each round is cut into the checkpoint folder.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (now.n, now.h) == state or now.n == 0:
            break
        state = (now.n, now.h)
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
                        .alias("p")).select("p.u", "p.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where("v > u").join(low, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low2, "u")
                 .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("p"))
                 .select("p.u", "p.v").where("u <> v").distinct())
        e = cut(small)
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        e.select("v", "v").distinct())


def sorted_groups(batches, keys: list[str]):
    """Arrow batches sorted by integer key columns -> (key, table of its rows), one group in memory at a time."""
    import numpy as np
    import pyarrow as pa
    held, held_key = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, dtype=bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        for s, e in zip(starts, [*starts[1:], b.num_rows]):
            key = tuple(int(c[s]) for c in cols)
            if held and key != held_key:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(b.slice(s, e - s))
    if held:
        yield held_key, pa.Table.from_batches(held)


def matrix(column, width: int):
    """A list column without nulls, all lists of one width, as a two-dimensional array."""
    import pyarrow as pa
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
