"""Structured Streaming: micro-batch summaries equal the batch result."""
import tempfile

from pyspark.sql import functions as F

from precis.operators.summarizers import summarize
from precis.streaming.documents import cleaned, summarize_stream


def test_stream_matches_batch(spark):
    from table_paths import SF_TINY
    src = tempfile.mkdtemp(prefix="precis-stream-src-")
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.mode("overwrite").parquet(src + "/in")
    stream = (spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src + "/in"))
    q = summarize_stream(stream, ["luhn", "random"], src + "/out", src + "/ckpt", k=2, available_now=True)
    q.awaitTermination(300)
    got = {(r["model"], r["doc_id"], r["summary"])
           for r in spark.read.parquet(src + "/out").select("model", "doc_id", "summary").collect()}
    want = {tuple(r) for r in summarize(docs, ["luhn", "random"], k=2).select("model", "doc_id", "summary").collect()}
    assert got == want


def test_cleaned_is_stateless(spark):
    df = spark.createDataFrame([(1, "a !! b")], "doc_id long, text string")
    assert cleaned(df).collect()[0]["cleaned"] == "a  b"
