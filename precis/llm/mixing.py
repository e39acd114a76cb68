"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Main path: DataFrame functions only.

* Size of a document: number of words (``WORD_RE``); null or empty text: 0.
* Sources in code-point order, null last, get the given weights in turn. The targets share the corpus' words by
  weight; a target stops at ``max_epochs`` times its source's words and the excess goes to the others by weight, until
  none is above. With sources sorted by cap per weight the stopped ones are a prefix, so one pass of running sums gives
  the level that the repeated resharing ends at.
* A source with target t and size s is taken floor(t / s) times whole. The fraction that is left is a sample: documents
  in the order of a seeded hash as long as they fit, then the one other document that brings the source nearest to its
  target, if any does. No document is taken more than ``max_epochs`` times.
* Repeated rows (same doc_id) share one draw. Empty table: no rows. A source without words: target 0, nothing taken.
  Other columns pass untouched; columns named like the added ones are replaced.

The hash order is never sorted as a whole: words are summed by (source, hash prefix) with map-side combine, the prefix
in which the fraction ends is found by a running sum, and only that prefix's documents are ranked. A source with a third
of all rows is therefore spread over all tasks. The per-source table joins by broadcast while it has at most
``MAX_BROADCAST_SOURCES`` rows, else by a shuffle join; the results are the same.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from precis.llm.common import WORD_RE, cut

SEED = 42
MAX_BROADCAST_SOURCES = 50_000
ROWS_PER_PREFIX = 20_000


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def draw(doc_id, seed: int = SEED) -> Column:
    """Seeded hash of a document id; null counts as the empty string."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def targets(sizes: DataFrame, weights=(1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """``(source, source_size)`` -> also weight, target. One row per source, so running sums over all rows are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = (sizes.withColumn("weight", w.cast("long"))
         .withColumn("cap", F.col("source_size") * max_epochs)
         .withColumn("ratio", F.col("cap").cast("double") / F.col("weight")))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = (s.withColumn("total", F.sum("source_size").over(everything))
         .withColumn("w_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
         .withColumn("t_left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("level", F.col("t_left").cast("double") / F.col("w_left")))
    s = s.withColumn("level", F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "level")))
                     .over(everything).getField("level"))
    share = F.col("level") * F.col("weight")
    target = F.when(F.col("level").isNull() | (share >= F.col("cap")), F.col("cap").cast("double")).otherwise(share)
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights=(1, 2, 3), max_epochs: int = 3, seed: int = SEED) -> DataFrame:
    """``docs`` with size, source_size, target and reps (times that the mix takes the row)."""
    added = ["size", "source_size", "target", "reps"]
    rows = docs.drop(*added).withColumns({"size": word_count(F.col("text")), "_h": draw(F.col("doc_id"), seed)})
    drawn = cut(rows.groupBy("source", "_h").agg(F.sum("size").alias("words"), F.count("*").alias("n")))
    sizes = drawn.groupBy("source").agg(F.sum("words").alias("source_size"))
    per_source = cut(targets(sizes, weights, max_epochs)
                     .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                                 .otherwise(0).cast("long"))
                     .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    n_rows = drawn.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    digits = max(1, math.ceil(math.log(max(1, n_rows / ROWS_PER_PREFIX), 16)))
    drawn = drawn.withColumn("bucket", F.substring("_h", 1, digits))

    # the prefix in which the fraction ends, per source
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    found = (drawn.groupBy("source", "bucket").agg(F.sum("words").alias("words"))
             .withColumn("upto", F.sum("words").over(upto)))
    p = per_source.select(F.col("source").alias("p_source"), "rest")
    ends = (found.join(p, F.col("source").eqNullSafe(F.col("p_source"))).where(F.col("upto") >= F.col("rest"))
            .groupBy("source", "rest").agg(F.min(F.struct("bucket", "upto", "words")).alias("e"))
            .select(F.col("source").alias("e_source"), "rest", F.col("e.bucket").alias("end_bucket"),
                    (F.col("e.upto") - F.col("e.words")).alias("before")))
    # within it, the documents that fit
    so_far = Window.partitionBy("source").orderBy("_h").rowsBetween(Window.unboundedPreceding, 0)
    fit = (drawn.join(ends, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("bucket") == F.col("end_bucket")))
           .withColumn("so_far", F.col("before") + F.sum("words").over(so_far))
           .groupBy("source", "rest", "end_bucket", "before")
           .agg(F.max(F.when(F.col("so_far") <= F.col("rest"), F.struct("so_far", "_h"))).alias("l"))
           .select(F.col("source").alias("f_source"), "end_bucket", F.col("l._h").alias("end_h"),
                   (F.col("rest") - F.coalesce(F.col("l.so_far"), F.col("before"))).alias("wanted")))
    fit = _small(cut(fit))
    # one more, if one of the others comes nearer to the target
    in_prefix = (F.col("bucket") < F.col("end_bucket")) | F.coalesce(F.col("_h") <= F.col("end_h"), F.lit(False))
    one = (drawn.join(fit, F.col("source").eqNullSafe(F.col("f_source"))).where(~in_prefix)
           .where((F.col("words") > 0) & (F.col("words") < 2 * F.col("wanted")))
           .groupBy("source").agg(F.min(F.struct(F.abs(F.col("wanted") - F.col("words")), "_h")).alias("o"))
           .select(F.col("source").alias("o_source"), F.col("o._h").alias("one_h")))
    table = _small(cut(
        per_source.join(fit, F.col("source").eqNullSafe(F.col("f_source")), "left")
        .join(one, F.col("source").eqNullSafe(F.col("o_source")), "left")
        .select(F.col("source").alias("_source"), "source_size", "target", F.col("whole").alias("_whole"),
                F.col("end_bucket").alias("_end_bucket"), F.col("end_h").alias("_end_h"), F.col("one_h").alias("_one_h"))))
    extra = F.coalesce(F.substring("_h", 1, digits) < F.col("_end_bucket"), F.lit(False)) \
        | F.coalesce(F.col("_h") <= F.col("_end_h"), F.lit(False)) | F.coalesce(F.col("_h") == F.col("_one_h"), F.lit(False))
    reps = F.least(F.col("_whole") + F.when(extra, 1).otherwise(0), F.lit(max_epochs))
    return (rows.join(table, F.col("source").eqNullSafe(F.col("_source"))).withColumn("reps", reps.cast("long"))
            .drop("_source", "_whole", "_end_bucket", "_end_h", "_one_h", "_h"))


def _small(per_source: DataFrame) -> DataFrame:
    return F.broadcast(per_source) if per_source.count() <= MAX_BROADCAST_SOURCES else per_source


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    m = mix(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_row")), **options)
    times = F.when(F.col("reps") > 0, F.sequence(F.lit(1), F.col("reps")))
    return m.select("_row", F.explode(times)).select("_row.*")
