"""The pipeline's stages against brute force over each stage's own input."""

from collections import Counter

import pytest

from tests.conftest import SF, SF_TINY

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order(spark, tmp_path):
    from tests.llm.test_documents_ops import check_mix, check_packing, jaccard_classes
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        before = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            kept = {r.doc_id for r in out.collect()}
            good = [i for i, q in labels.items() if q == 1 and i in before]
            assert sum(i in kept for i in good) >= 0.99 * len(good)
        if name == "deduplicate":
            truth = jaccard_classes(before)
            assert sorted(r.doc_id for r in out.collect()) == sorted({truth[i] for i in before})
        if name == "mix":
            check_mix(docs, lambda largest: largest / 2)
            assert max(Counter(r.doc_id for r in out.collect()).values()) <= 3
        if name == "pack":
            _, covered, ids = check_packing(out.collect(), before)
            copies = Counter(r.doc_id for r in docs.collect())
            assert all(sum(n for _, n in covered[i]) == copies[i] * len(ids[i]) for i in before)
        docs = out


def test_run_and_empty_table(spark):
    assert pipeline.run(spark, SF_TINY).count() > 0
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF_TINY)
        assert docs.count() == 0


def test_entry_registers_every_operator():
    import __spark_entry__ as e
    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert any(n.startswith("op10_") for n in e.oracle_sql())
