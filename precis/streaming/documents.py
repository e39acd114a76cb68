"""Summarising a stream of arriving documents with Structured Streaming.

Every extractive summariser works within one document, so a micro-batch of
complete documents can be summarised on its own: ``foreachBatch`` runs the
batch plan (joins, windows) and appends the result. The text expressions
(clean, sentence split, tokens) are stateless and also work directly on a
streaming DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from precis.functions.text import clean_text


def cleaned(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Stateless B1 cleaning on a streaming (or batch) frame."""
    return stream.withColumn("cleaned", clean_text(text_col))


def summarize_stream(stream: DataFrame, models: list[str], out_dir: str, checkpoint_location: str,
                     k: int = 3, available_now: bool = False):
    """Start a query writing (model, doc_id, summary) Parquet under ``out_dir``.

    ``checkpoint_location`` must be a shared folder (progress and offsets
    survive driver/executor loss); the sink is Parquet partitioned by batch
    and model, so each micro-batch is in it exactly once.
    """
    from precis.operators.summarizers import summarize

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        out = summarize(batch.select("doc_id", "text"), models, k=k)
        # one folder per batch: a batch that is replayed after a failure replaces its own output
        out.write.mode("overwrite").partitionBy("model").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location)
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.start()
