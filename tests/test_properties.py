"""Property tests (hypothesis): cleaning, sentence/summary invariants, split and metric identities."""
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from precis.functions import text as T
from precis.operators import evaluate as E
from precis.operators import summarizers as S
from precis.operators.split import stratified_split
from precis.operators.topk import with_all_documents

SETTINGS = settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
ALPHABET = st.sampled_from(list("ab cdé.!?\n\t,-@+_/()#%$¼²ß日   x"))


def py_clean(t):
    t = re.sub(r"\s+", " ", t).strip()
    return re.sub(r"[^\w\s.,\-@+_/()]", "", t)


@SETTINGS
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=20))
def test_clean_equals_python(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", T.clean_text("t").alias("c")).collect()}
    assert all(got[i] == py_clean(t) for i, t in enumerate(texts))


@SETTINGS
@given(st.lists(st.text(alphabet=ALPHABET, min_size=1, max_size=120), min_size=1, max_size=8),
       st.integers(min_value=1, max_value=4))
def test_summary_is_ordered_subset(spark, texts, k):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    c = S.Corpus.of(df)
    sents = {}
    for r in c.sents.collect():
        sents.setdefault(r["doc_id"], []).append((r["sent_id"], r["sentence"]))
    for name in ("luhn", "random", "reduction"):
        out = {r["doc_id"]: r["summary"] for r in with_all_documents(c.docs, S.EXTRACTIVE[name](c, k)).collect()}
        for d, summ in out.items():
            ss = [s for _, s in sorted(sents.get(d, []))]
            if not ss:
                assert summ == ""
                continue
            want_n = min(k, len(ss))
            # some subsequence of want_n sentences, in document order, joined by one space
            import itertools
            assert any(" ".join(comb) == summ for comb in itertools.combinations(ss, want_n))


@SETTINGS
@given(st.dictionaries(st.sampled_from(list("abcdef")), st.integers(min_value=1, max_value=30), min_size=1))
def test_split_disjoint_cover(spark, counts):
    rows = [(f"{c}{i}", c) for c, n in counts.items() for i in range(n)]
    sp = stratified_split(spark.createDataFrame(rows, "doc_id string, category string")).collect()
    assert sorted(r["doc_id"] for r in sp) == sorted(d for d, _ in rows)
    n = len(rows)
    n_test = -(-n // 4)
    assert sum(r["fold"] == "test" for r in sp) == n_test


@SETTINGS
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.sampled_from("xyz")), min_size=1, max_size=40))
def test_metric_identities(spark, pairs):
    preds = spark.createDataFrame([("m", str(i), t, p) for i, (t, p) in enumerate(pairs)],
                                  "model string, doc_id string, y_true string, y_pred string")
    recs = spark.createDataFrame([(c,) for c in "xyz"], "category string")
    cm = E.confusion(preds, recs).collect()
    assert sum(r["n"] for r in cm) == len(pairs)
    o = E.overall(E.per_category(preds, recs)).collect()[0]
    acc = sum(t == p for t, p in pairs) / len(pairs)
    assert abs(o["accuracy"] - acc) < 1e-12
    # weighted recall equals accuracy
    pc = E.per_category(preds, recs).collect()
    assert abs(sum(r["recall"] * r["support"] for r in pc) / len(pairs) - acc) < 1e-12
