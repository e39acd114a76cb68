"""Entry flows of the reference, as Spark jobs.

* ``generate``  -- documents -> summaries per model (Parquet, partitioned by
  model), with job-level timings per model (entry 1 and the timed entry 2).
* ``evaluate``  -- summaries + labels -> split, classifier scores, per-category
  metrics, confusion matrices and the pivot behind the heatmap (entry 3).
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.operators import evaluate as E
from precis.operators import summarizers as S
from precis.operators.efficiency import efficiency_report
from precis.operators.split import check_split, stratified_split
from precis.operators.topk import with_all_documents
from precis.session import materialize


def generate(docs: DataFrame, models: list[str], out_dir: str | None = None, k: int = 3,
             **opts) -> tuple[DataFrame, DataFrame]:
    """Summaries of ``docs`` (doc_id, text) for the requested models.

    Returns (summaries, efficiency). Each model's plan runs as its own job.
    The batch hook times each document, the ranking models (``S.TIMED``) time
    theirs inside the task (0 for a document without sentences; none for the
    very large documents that joins rank). Only ``lsa`` and ``random`` are mere
    column expressions without a clock: their job time is spread evenly.
    Splitting into sentences and writing are not timed.
    """
    spark = docs.sparkSession
    chosen = [m for m in models if m in S.EXTRACTIVE or m in S.ABSTRACTIVE]
    if not chosen:
        raise ValueError(f"none of the requested models is available: {models}")
    corpus = S.Corpus.of(docs, persist=True)
    parts, timings = [], []
    for m in chosen:
        if m in S.TIMED:
            timed = materialize(S.TIMED[m](corpus, k, **opts.get(m, {})))
            part = materialize(with_all_documents(corpus.docs, timed.drop("elapsed_s")))
            times = timed.select("elapsed_s").where(F.col("elapsed_s").isNotNull()).unionByName(
                part.where(F.col("summary") == "").select(F.lit(0.0).alias("elapsed_s")))
        elif m in S.EXTRACTIVE:
            t0 = time.time()
            part = materialize(with_all_documents(corpus.docs, S.EXTRACTIVE[m](corpus, k, **opts.get(m, {}))))
            job_s = time.time() - t0
            n = part.count()
            times = part.select((F.lit(job_s) / F.lit(max(1, n))).alias("elapsed_s"))
        else:
            part = materialize(S.abstractive_timed(corpus.docs, m, S.ABSTRACTIVE[m], **opts.get(m, {})))
            times = part.where(F.col("error").isNull()).select("elapsed_s")
        timings.append(times.select(F.lit(m).alias("model"), "elapsed_s"))
        part = part.select(F.lit(m).alias("model"), "doc_id", "summary")
        if out_dir:
            part.drop("model").write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/model={m}")
        parts.append(part)
    summaries, times = parts[0], timings[0]
    for p, t in zip(parts[1:], timings[1:]):
        summaries, times = summaries.unionByName(p), times.unionByName(t)
    kinds = spark.createDataFrame([(m, S.model_type(m)) for m in chosen], "model string, type string")
    return summaries, efficiency_report(kinds, times)


def evaluate(summaries: DataFrame, labels: DataFrame) -> dict[str, DataFrame]:
    """Score every summariser: overall, per-category, confusion, pivot, predictions.

    ``summaries``: (model, doc_id, summary); ``labels``: (doc_id, category).
    """
    recs = materialize(E.label_join(summaries, labels))
    split = materialize(stratified_split(recs, "resume_id"))
    check_split(split)
    overall, preds = E.classify(recs, split)
    out = {"records": recs, "split": split, "overall": overall}
    if preds is not None:
        pc = E.per_category(preds, recs)
        ok = overall.where(F.col("error").isNull()).select("model")
        labels_sorted = sorted(r[0] for r in recs.select("category").distinct().collect())
        out.update(predictions=preds,
                   per_category=pc.join(ok, "model", "left_semi"),
                   confusion=E.confusion(preds, recs),
                   pivot=E.category_pivot(pc, labels_sorted),
                   ranked=overall.where(F.col("error").isNull()).orderBy(F.col("f1_weighted").desc()))
    return out


def run(spark: SparkSession, docs: DataFrame, labels: DataFrame, models: list[str], k: int = 3):
    """Both stages without a filesystem hand-off."""
    summaries, eff = generate(docs, models, k=k)
    res = evaluate(summaries, labels)
    res["efficiency"] = eff
    return res
