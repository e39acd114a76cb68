"""Runtime statistics per summariser."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def efficiency_report(models: DataFrame, timings: DataFrame) -> DataFrame:
    """(model, type, files_processed, total_s, avg_s, min_s, max_s), avg ascending, nulls last.

    ``models``: (model, type) -- the requested models; ``timings``:
    (model, elapsed_s) one row per processed file. A model without timings
    gets count 0, total 0 and null statistics. Partial aggregation runs
    before the shuffle; the (tiny) model list is joined afterwards.
    """
    stats = timings.groupBy("model").agg(F.count("elapsed_s").alias("files_processed"),
                                         F.sum("elapsed_s").alias("total_s"),
                                         F.min("elapsed_s").alias("min_s"),
                                         F.max("elapsed_s").alias("max_s"))
    return (models.join(stats, "model", "left")
            .select("model", "type",
                    F.coalesce("files_processed", F.lit(0)).cast("long").alias("files_processed"),
                    F.coalesce("total_s", F.lit(0.0)).alias("total_s"),
                    F.when(F.col("files_processed") > 0, F.col("total_s") / F.col("files_processed"))
                    .alias("avg_s"),
                    "min_s", "max_s")
            .orderBy(F.col("avg_s").asc_nulls_last(), "model"))
