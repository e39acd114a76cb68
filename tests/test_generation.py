"""The reference's entry flows: generate summaries (with timings), then evaluate."""
import tempfile

from pyspark.sql import functions as F

from precis.plans.generation import evaluate, generate


def test_generate_and_evaluate(spark):
    from table_paths import SF_TINY
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text", "lang")
    out = tempfile.mkdtemp(prefix="precis-gen-")
    summaries, eff = generate(docs.select("doc_id", "text"), ["luhn", "nope", "random"], out_dir=out, k=2)
    assert {r["model"] for r in eff.collect()} == {"luhn", "random"}
    assert all(r["files_processed"] == 200 for r in eff.collect())
    assert summaries.count() == 400
    for r in eff.collect():
        assert abs(r["avg_s"] * r["files_processed"] - r["total_s"]) < 1e-6 and r["min_s"] <= r["avg_s"] + 1e-9 <= r["max_s"] + 2e-9
    back = spark.read.parquet(out)
    assert back.select("model").distinct().count() == 2
    res = evaluate(summaries, docs.select("doc_id", F.col("lang").alias("category")))
    rows = res["overall"].collect()
    assert {r["model"] for r in rows} == {"luhn", "random"} and all(r["error"] is None for r in rows)
    pc = res["per_category"].collect()
    assert len(pc) == 2 * 4
    cm = res["confusion"].groupBy("model").agg(F.sum("n").alias("n")).collect()
    assert all(r["n"] == res["split"].where("fold = 'test'").count() for r in cm)
    assert set(res["pivot"].columns) == {"model", "de", "en", "es", "fr"}


def test_generate_without_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    summaries, eff = generate(none, ["luhn"])
    assert summaries.count() == 0 and [r["files_processed"] for r in eff.collect()] == [0]


def test_timings_of_the_hook_are_per_document(spark):
    import time

    import numpy as np

    from precis.operators import summarizers as S

    def slow(model, lo, hi):
        def fn(batch):
            time.sleep(0.01 * len(batch))
            return np.array(["s"] * len(batch), dtype=object)
        return fn

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(10)], "doc_id long, text string")
    S.register("slow", slow, kind="abstractive")
    try:
        _, eff = generate(docs, ["slow"])
        r = eff.collect()[0]
    finally:
        S.ABSTRACTIVE.pop("slow", None)
    assert r["files_processed"] == 10 and 0.1 <= r["total_s"] < 5 and r["min_s"] >= 0.009
