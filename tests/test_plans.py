"""Physical-plan checks: column pruning reaches the Parquet scan; no cartesian products."""
import re

import pytest

import __spark_entry__ as entry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["summ_luhn", "summ_textrank", "sentence_graph_lexrank", "tokenize_terms",
                                  "stratified_split", "efficiency_report"])
def test_scans_are_pruned_and_no_cartesian(spark, name):
    from table_paths import SF_TINY
    plan = _plan(entry.queries()[name](spark, SF_TINY))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        cols = schema.split(",")
        assert len(cols) <= 2, schema          # documents: doc_id + one text/label column; events: 2 columns


def test_nothing_stays_in_caches(spark):
    from table_paths import SF_TINY
    for name in ("summ_textrank", "summ_kl", "tfidf_features"):
        entry.queries()[name](spark, SF_TINY).count()
        assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


@pytest.mark.parametrize("method", ["luhn", "reduction", "textrank", "lexrank", "kl"])
def test_ranking_in_rows_shuffles_nothing(spark, method):
    """The whole plan, read before anything is run or cut: one scan, one Arrow function, no exchange, no join."""
    from table_paths import SF_TINY

    from precis.operators import summarizers as S
    c = S.Corpus.of(spark.read.parquet(f"{SF_TINY}/documents.parquet"))
    plan = _plan(S.EXTRACTIVE[method](c, 3))
    assert "Exchange" not in plan and "Join" not in plan and plan.count("Scan parquet") == 1
    assert plan.count("ArrowEvalPython") == 1


def test_models_share_one_pass(spark):
    from table_paths import SF_TINY

    from precis.operators import docrank
    from precis.operators import summarizers as S
    c = S.Corpus.of(spark.read.parquet(f"{SF_TINY}/documents.parquet"), together=docrank.METHODS)
    for m in docrank.METHODS:
        assert "ArrowEvalPython" not in _plan(S.EXTRACTIVE[m](c, 3))       # reads the shared summaries
    assert len(c._shared) == 1


def test_segmentation_shuffles_nothing(spark):
    from table_paths import SF_TINY

    from precis.operators.sentences import segment
    plan = _plan(segment(spark.read.parquet(f"{SF_TINY}/documents.parquet")))
    assert "Exchange" not in plan and "Window" not in plan
