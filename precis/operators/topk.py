"""Top-k per group (F3) and summary assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DP = 9          # scores are rounded before ranking (engine-independent ties)


def rank_key(score_col: str = "score", descending: bool = True) -> list[Column]:
    s = F.round(F.col(score_col), SCORE_DP)
    return [s.desc() if descending else s.asc(), F.col("sent_id").asc()]


def top_k(df: DataFrame, k: int, order: list[Column], group: str = "doc_id") -> DataFrame:
    """Rows of ``df`` ranked 1..k within ``group`` by ``order`` (column ``rk``).

    Spark plans a partial limit per group below the shuffle for this filter.
    """
    return (df.withColumn("rk", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
            .where(F.col("rk") <= k))


def assemble(picked: DataFrame, group: str = "doc_id") -> DataFrame:
    """(doc_id, summary): picked sentences in document order, joined by one space."""
    return (picked.groupBy(group)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_id", "sentence"))),
                                          lambda s: s["sentence"]), " ").alias("summary")))


def with_all_documents(docs: DataFrame, summaries: DataFrame, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """Every non-empty document gets a row; no sentence -> empty summary."""
    ids = docs.where(F.length(text_col) > 0).select(F.col(id_col).alias("doc_id"))
    return (ids.join(summaries, "doc_id", "left")
            .select("doc_id", F.coalesce("summary", F.lit("")).alias("summary")))
