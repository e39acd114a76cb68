"""Summarisers: hand graph fixture, brute-force Luhn, PageRank vs numpy, properties."""
import math
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from precis.operators import docrank
from precis.operators import graph as G
from precis.operators import summarizers as S
from precis.operators.topk import with_all_documents

GRAPH_DOC = "spark joins big tables. big tables need spark. cats sleep."


def corpus(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return S.Corpus.of(df, persist=False)


def test_textrank_edge_fixture(spark):
    c = corpus(spark, [GRAPH_DOC])
    e = G.textrank_edges(c.toks).collect()
    assert len(e) == 1
    assert e[0]["shared"] == 3 and abs(e[0]["weight"] - 3 / (2 * math.log(4))) < 1e-9
    red = {r["sent_id"]: r["score"] for r in S.reduction_scores(c).collect()}
    assert abs(red[0] - 1.082021) < 1e-6 and abs(red[1] - 1.082021) < 1e-6 and 2 not in red
    summ = S.reduction(c, 2).collect()[0]["summary"]
    assert summ == "spark joins big tables. big tables need spark."


def py_luhn(tokens_by_sent):
    from collections import Counter
    freq = Counter(w for s in tokens_by_sent for w in s)
    scores = []
    for s in tokens_by_sent:
        pos = [i for i, w in enumerate(s) if freq[w] >= 2]
        best, start, prev, cnt = 0.0, None, None, 0
        for p in pos:
            if prev is not None and p - prev - 1 <= 4:
                cnt += 1
            else:
                if start is not None:
                    best = max(best, cnt * cnt / (prev - start + 1))
                start, cnt = p, 1
            prev = p
        if start is not None:
            best = max(best, cnt * cnt / (prev - start + 1))
        scores.append(best)
    return scores


def test_luhn_matches_brute_force(spark):
    from table_paths import SF_TINY
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text")
    c = S.Corpus.of(docs, persist=False)
    got = {(r["doc_id"], r["sent_id"]): r["score"] for r in S.luhn_scores(c).collect()}
    sents = {}
    for r in c.sents.collect():
        sents.setdefault(r["doc_id"], []).append((r["sent_id"], r["sentence"]))
    for d, ss in sents.items():
        ss.sort()
        toks = [re.findall(r"[^\W]{2,}", s.lower()) for _, s in ss]
        for (sid, _), want in zip(ss, py_luhn(toks)):
            assert abs(got.get((d, sid), 0.0) - want) < 1e-9


def np_pagerank(n, edges, steps, d=0.85):
    W = np.zeros((n, n))
    for a, b, w in edges:
        if w > 0:
            W[a, b] += w
            W[b, a] += w
    out = W.sum(1)
    r = np.full(n, 1.0 / n)
    for _ in range(steps):
        c = np.zeros(n)
        for j in range(n):
            if out[j] > 0:
                c += r[j] * W[j] / out[j]
        dm = r[out == 0].sum()
        r = (1 - d) / n + d * (c + dm / n)
    return r


@pytest.mark.parametrize("steps", [1, 5, 12])
def test_power_rank_matches_numpy(spark, steps):
    texts = ["a1 b1 c1. b1 c1 d1. d1 e1. zz yy. c1 a1 e1.", "one two. two three. four."]
    c = corpus(spark, texts)
    e = G.textrank_edges(c.toks).select("doc_id", "src", "dst", F.col("weight").alias("w"))
    got = {(r["doc_id"], r["sent_id"]): r["score"] for r in
           G.power_rank(c.sents.select("doc_id", "sent_id"), e, steps).collect()}
    edges = e.collect()
    for d in (0, 1):
        ids = sorted(sid for (dd, sid) in got if dd == d)
        idx = {s: i for i, s in enumerate(ids)}
        want = np_pagerank(len(ids), [(idx[r["src"]], idx[r["dst"]], r["w"]) for r in edges if r["doc_id"] == d],
                           steps)
        for s in ids:
            assert abs(got[(d, s)] - want[idx[s]]) < 1e-9
        assert abs(sum(got[(d, s)] for s in ids) - 1.0) < 1e-9


def test_summary_properties(spark):
    from table_paths import SF_TINY
    docs = spark.read.parquet(f"{SF_TINY}/documents.parquet").select("doc_id", "text")
    c = S.Corpus.of(docs)
    sents = {}
    for r in c.sents.collect():
        sents.setdefault(r["doc_id"], []).append(r["sentence"])
    for name in ("luhn", "random", "lsa", "kl"):
        k = 3
        out = {r["doc_id"]: r["summary"] for r in with_all_documents(c.docs, S.EXTRACTIVE[name](c, k)).collect()}
        assert set(out) == {r["doc_id"] for r in docs.collect()}
        for d, summ in out.items():
            ss = sents.get(d, [])
            if not ss:
                assert summ == ""
                continue
            if len(ss) <= k:
                assert summ == " ".join(ss)


def first_words_generator():
    """A generator for tests: the first ``max_length`` words; fails on a text that holds 'boom'."""
    def make(model, min_length, max_length):
        def fn(batch):
            if any("boom" in t for t in batch):
                raise ValueError("boom")
            return np.array([" ".join(str(t).split()[:max_length]) for t in batch], dtype=object)
        return fn
    return make


def test_one_bad_document_blanks_one_row(spark):
    docs = spark.createDataFrame([(i, "boom now" if i == 3 else f"alpha beta {i}") for i in range(8)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in S.abstractive_timed(docs.coalesce(1), "m", first_words_generator(), summary_max_length=2).collect()}
    assert {i for i, r in rows.items() if r["summary"] == ""} == {3} and "boom" in rows[3]["error"]
    assert all(r["summary"] == "alpha beta" and r["elapsed_s"] >= 0 for i, r in rows.items() if i != 3)


def test_hook_loads_a_model_once_per_worker_and_batches_by_length(spark, tmp_path):
    """A worker keeps its model over its tasks; the texts of a batch have neighbouring lengths."""
    folder = str(tmp_path)

    def make(model, min_length, max_length):
        import os
        import uuid
        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def fn(batch):
            sizes = [len(t.split()) for t in batch]
            return np.array([f"{min(sizes)} {max(sizes)}"] * len(batch), dtype=object)
        return fn

    docs = spark.range(640, numPartitions=40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 16 + 1).cast("int")).alias("text"))
    out = S.abstractive_timed(docs, "m", make, batch_size=4).collect()
    loads = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(out) == 640 and len(loads) == len(set(loads)) < 40
    spans = [r["summary"].split() for r in out]
    assert all(int(b) - int(a) == 3 for a, b in spans)


def test_hook_with_too_few_results_is_an_error_per_row(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(3)], "doc_id long, text string")
    rows = S.abstractive_timed(docs, "m", lambda *_: (lambda batch: np.array([], dtype=object))).collect()
    assert len(rows) == 3 and all(r["summary"] == "" and "0 summaries" in r["error"] and r["elapsed_s"] is None for r in rows)


def test_router_and_abstractive_hook(spark):
    df = spark.createDataFrame([(1, "Alpha beta gamma. Delta epsilon. Zeta."), (2, "")], "doc_id long, text string")
    S.register("stub", first_words_generator(), kind="abstractive")
    try:
        out = S.summarize(df, ["luhn", "nope", "stub"], k=1, summary_max_length=2).collect()
    finally:
        S.ABSTRACTIVE.pop("stub", None)
    got = {(r["model"], r["doc_id"]): r["summary"] for r in out}
    assert got[("stub", 1)] == "Alpha beta"
    assert ("luhn", 1) in got and ("luhn", 2) not in got
    with pytest.raises(ValueError):
        S.summarize(df, ["nope"])


def test_lsa_rank_matches_svd_and_norm(spark):
    texts = ["a1 b1 c1 a1. b1 c1 d1. d1 e1 e1. zz yy. c1 a1 e1.", "one two. two three. four four."]
    c = corpus(spark, texts)
    rows = docrank.scored(c.docs, ("lsa_rank",), k=3, **{**S.PARAMS, "topics": 2, "steps": 200}).collect()
    got = {(r.doc_id, x.sent_id): v for r in rows for x, v in zip(r.sents, r.scored["lsa_rank"])}
    full = {(r["doc_id"], r["sent_id"]): r["score"] for r in S.lsa_rank_scores(c, topics=6, steps=2).collect()}
    norm = {(r["doc_id"], r["sent_id"]): r["score"] for r in S.lsa_scores(c).collect()}
    for key in norm:                       # all topics kept -> column norm
        assert abs(full[key] - norm[key]) < 1e-9
    rows = c.toks.collect()
    for d in (0, 1):
        sents = sorted({r["sent_id"] for r in rows if r["doc_id"] == d})
        words = sorted({r["word"] for r in rows if r["doc_id"] == d})
        a = np.zeros((len(words), len(sents)))
        for r in rows:
            if r["doc_id"] == d:
                a[words.index(r["word"]), sents.index(r["sent_id"])] += 1
        u, sig, vt = np.linalg.svd(a, full_matrices=False)
        want = np.sqrt(((vt[:2].T ** 2) * sig[:2] ** 2).sum(axis=1))
        for i, s in enumerate(sents):
            assert abs(got[(d, s)] - want[i]) < 1e-9


def test_salted_pair_join_is_exact(spark):
    texts = [". ".join(f"w{i % 3} common x{i}" for i in range(40)) + "."]
    c = corpus(spark, texts)
    plain = {(r["src"], r["dst"]): r["weight"] for r in G.textrank_edges(c.toks).collect()}
    inc = c.toks.select("doc_id", "sent_id", "word").distinct()
    salted = G._pairs(inc, [], hot_rows=3).groupBy("src", "dst").count().collect()
    unsalted = G._pairs(inc, [], hot_rows=10 ** 9).groupBy("src", "dst").count().collect()
    assert {tuple(r) for r in salted} == {tuple(r) for r in unsalted}
    assert len(plain) == len(unsalted)
