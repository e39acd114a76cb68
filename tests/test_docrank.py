"""Ranking in rows: against the join versions, a dense PageRank and brute-force cosines, and on odd documents."""
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from precis.operators import docrank as R
from precis.operators import graph as G
from precis.operators import summarizers as S
from table_paths import SF_TINY

TEXTS = ["a1 b1 c1. b1 c1 d1. d1 e1. zz yy. c1 a1 e1. b1 b1 b1 a1.", "one two. two three. four.", "single", "!!!", "a b c. d",
         "ab ab. ab ab. ab ab.", "same words here. same words here. other thing.", ". ".join(f"w{i % 7} x{i % 3} y{i}" for i in range(90))]


def corpus(spark, texts):
    return S.Corpus.of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def arrays(texts):
    import re
    sents = [[re.findall(r"[^\W]{2,}", s.lower()) for s in re.findall(r"[^.!?\n]+[.!?]*", t) if s.strip()] for t in texts]
    return pa.array(sents, pa.list_(pa.list_(pa.string())))


def by_row(c, method, **params):
    rows = R.scored(c.docs, (method,), k=3, **{**S.PARAMS, **params}).collect()
    return {(r.doc_id, s.sent_id): v for r in rows for s, v in zip(r.sents, r.scored[method])}


@pytest.mark.parametrize("method,joined", [("luhn", S.luhn_scores), ("reduction", S.reduction_scores),
                                           ("textrank", S.textrank_scores), ("lexrank", S.lexrank_scores)])
def test_row_scores_equal_join_scores(spark, method, joined):
    c = corpus(spark, TEXTS)
    want = {(r.doc_id, r.sent_id): r.score for r in joined(c).collect()}
    got = by_row(c, method)
    assert set(want) <= set(got)
    assert all(abs(v - want.get(k, 0.0)) < 1e-9 for k, v in got.items())


def test_lsa_rank_in_rows_equals_joins(spark):
    c = corpus(spark, TEXTS)
    for topics, steps in ((1, 3), (3, 4), (5, 2)):
        want = {(r.doc_id, r.sent_id): r.score for r in S.lsa_rank_scores(c, topics, steps).collect()}
        got = by_row(c, "lsa_rank", topics=topics, steps=steps)
        assert set(want) <= set(got) and max(want.values()) > 1
        assert all(abs(v - want.get(k, 0.0)) < 1e-9 for k, v in got.items())


def test_lsa_rank_picks_what_the_decomposition_picks():
    """Scores after the default steps against numpy's eigenpairs, over documents of many sentences."""
    rng = np.random.default_rng(1)
    docs = [[[f"w{int(w)}" for w in rng.zipf(1.5, size=rng.integers(4, 20)) % 300] for _ in range(40)] for _ in range(30)]
    s = R.Slice(pa.array(docs, pa.list_(pa.list_(pa.string()))))
    got = R.lsa_rank(s, {**S.PARAMS, "k": 3})
    same = 0
    for i in range(len(docs)):
        mine = s.doc == i
        a = np.zeros((s.n_keys, len(docs[i])))
        inc = mine[s.node]
        a[s.key[inc], s.node[inc] - s.first[i]] = s.tf[inc]
        lam, vec = np.linalg.eigh(a.T @ a)
        exact = np.sqrt(vec[:, -3:] ** 2 @ lam[-3:])
        same += len(set(np.argsort(-exact)[:3]) & set(np.argsort(-got[mine])[:3]))
    assert same >= 0.95 * 3 * len(docs)


def test_textrank_equals_the_rank_over_pairs(spark):
    c = S.Corpus.of(spark.read.parquet(f"{SF_TINY}/documents.parquet").where("doc_id < 60"))
    e = G.textrank_edges(c.toks).select("doc_id", "src", "dst", F.col("weight").alias("w"))
    want = {(r.doc_id, r.sent_id): r.score for r in G.power_rank(c.sents.select("doc_id", "sent_id"), e, 5).collect()}
    got = by_row(c, "textrank", iterations=5)
    joins = {(r.doc_id, r.sent_id): r.score for r in S.textrank_scores(c, 5).collect()}
    assert set(got) == set(want) == set(joins)
    assert max(abs(got[k] - v) for k, v in want.items()) < 1e-9
    assert max(abs(joins[k] - v) for k, v in want.items()) < 1e-9


def test_bounded_edges_are_all_edges_from_fewer_pairs(spark):
    c = S.Corpus.of(spark.read.parquet(f"{SF_TINY}/documents.parquet").where("doc_id < 60"))
    every = {(r.doc_id, r.src, r.dst): r.cosine for r in G.lexrank_edges(c.sents, c.toks).collect()}
    want = {k: v for k, v in every.items() if v > 0.1}
    got = {(r.doc_id, r.src, r.dst): r.cosine for r in G.lexrank_edges_above(c.sents, c.toks, 0.1).collect()}
    assert set(got) == set(want) and max(abs(got[k] - v) for k, v in want.items()) < 1e-9
    u = G.unit_vectors(c.sents, c.toks)
    pairs = lambda f: G._pairs(f, []).count()
    assert pairs(G.indexed_words(u, 0.1)) < 0.8 * pairs(u.select("doc_id", "sent_id", "word"))
    # and in rows
    s = R.Slice(arrays([r.text for r in c.docs.orderBy("doc_id").collect()]))
    src, dst, compared = R.cosine_edges(s, 0.1)
    assert len(src) == len(want) and compared < len(every)


def test_pairs_in_small_chunks_are_the_same(monkeypatch):
    s = R.Slice(arrays(TEXTS))
    want = [a.tolist() if hasattr(a, "tolist") else a for a in R.cosine_edges(s, 0.1)]
    monkeypatch.setattr(R, "PAIRS_AT_ONCE", 3)
    assert [a.tolist() if hasattr(a, "tolist") else a for a in R.cosine_edges(s, 0.1)] == want
    assert want[2] > 0


def test_kl_rounds_equal_a_full_recomputation():
    """The delta rounds against the objective worked out anew for every candidate."""
    docs = arrays(TEXTS)
    s = R.Slice(docs)
    score = R.kl(s, {"k": 4, "delta": 1.0})
    for d, sents in enumerate(docs.to_pylist()):
        words = [w for x in sents for w in x]
        vocabulary = sorted(set(words))
        p = np.array([words.count(w) / max(1, len(words)) for w in vocabulary])
        chosen = []
        for _ in range(min(4, len(sents))):
            def divergence(i):
                held = [w for j in (*chosen, i) for w in sents[j]]
                q = np.array([held.count(w) + 1.0 for w in vocabulary]) / (len(held) + len(vocabulary))
                return round(float(np.sum(p * np.log(p / q))), 9) if vocabulary else 0.0
            chosen.append(min((i for i in range(len(sents)) if i not in chosen), key=lambda i: (divergence(i), i)))
        got = score[s.first[d]:s.first[d + 1]]
        assert [int(i) for i in np.argsort(-got, kind="stable")[:len(chosen)]] == chosen


def test_small_slices_give_the_same_rows(spark, monkeypatch):
    c = corpus(spark, [*TEXTS, None, ""])
    want = {m: by_row(c, m) for m in R.METHODS}
    monkeypatch.setattr(R, "SLICE_TOKENS", 5)
    docs = arrays(TEXTS)
    assert R.slices(docs) != [(0, len(docs))]
    whole = R.Slice(docs)
    for m in R.METHODS:
        parts = [R._METHODS[m](R.Slice(docs.slice(a, b - a)), {**S.PARAMS, "k": 3}) for a, b in R.slices(docs)]
        assert np.allclose(np.concatenate(parts), R._METHODS[m](whole, {**S.PARAMS, "k": 3}), atol=1e-12)
        assert len(want[m]) == whole.n


def test_giants_are_ranked_by_joins_with_the_same_result(spark, monkeypatch):
    long = ". ".join(f"word{i % 11} thing{i % 5} name{i}" for i in range(40)) + "."
    c = corpus(spark, [*TEXTS, long])
    few = {"lsa_rank": {"steps": 3}}
    want = {m: sorted(map(tuple, S.EXTRACTIVE[m](c, 3, **few.get(m, {})).collect())) for m in R.METHODS}
    monkeypatch.setattr(R, "GIANT_SENTENCES", 30)
    c = corpus(spark, [*TEXTS, long])
    assert c.has_giants and c.giants.docs.count() == 2
    for m in R.METHODS:
        assert sorted(map(tuple, S.EXTRACTIVE[m](c, 3, **few.get(m, {})).collect())) == want[m]


def test_clocks_are_per_document(spark):
    c = corpus(spark, TEXTS)
    times = {r.doc_id: r.elapsed_s for r in S.textrank_timed(c).collect()}
    assert 0 < times[2] < times[7]


@pytest.mark.parametrize("kind,joined", [("textrank", lambda c: G.textrank_edges(c.toks)), ("lexrank", lambda c: G.lexrank_edges(c.sents, c.toks))])
def test_pairs_in_rows_equal_joined_pairs(spark, monkeypatch, kind, joined):
    rows = [*enumerate(TEXTS), (2, "single one. single two. one two"), (None, "no id. no id."), (90, None)]      # document 2 twice
    long = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((*r[:3], *(round(v, 9) for v in r[3:])) for r in joined(S.Corpus.of(long)).collect())
    assert any(r[0] == 2 for r in want) and any(r[0] == 7 for r in want)
    for sentences, at_once in ((R.GIANT_SENTENCES, R.PAIRS_AT_ONCE), (30, 5)):                                   # document 7 becomes a giant
        monkeypatch.setattr(R, "GIANT_SENTENCES", sentences)
        monkeypatch.setattr(R, "PAIRS_AT_ONCE", at_once)
        got = S.Corpus.of(long).pairs(kind, joined).collect()
        assert sorted((*r[:3], *(round(v, 9) for v in r[3:])) for r in got) == want


@pytest.mark.parametrize("kind", ["textrank", "lexrank"])
def test_pairs_in_rows_shuffle_nothing(spark, kind):
    c = S.Corpus.of(spark.read.parquet(f"{SF_TINY}/documents.parquet"))
    plan = c.pairs(kind, None)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_rounding_and_picks_are_those_of_the_jvm(spark):
    x = [0.0, 0.0009765625, 1.0000000005, 2.5, 1e-10, 5e-10, 123456.7890123455, 3.0000000015, -0.0009765625, 1 / 3, 0.1 + 0.2]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", 9)).collect()]
    assert np.allclose(R.rounded(np.array(x), 9) / 1e9, want, rtol=1e-15, atol=0)
    s = R.Slice(arrays(["aa bb. cc dd. ee ff. gg", "!!!", "aa. bb"]))
    n, at = R.best(s, np.array([1.0, 2.0, 2.0, 2.0, 0.5, 0.5]), 2, 9)
    assert n.tolist() == [2, 0, 2] and at.tolist() == [1, 2, 0, 1]


def prose(n, words, seed):
    """``n`` sentences of 2 to 12 of ``words`` words, some far more frequent than others."""
    rng = np.random.default_rng(seed)
    return [[f"w{int(w)}" for w in rng.zipf(1.4, size=rng.integers(2, 12)) % words] for _ in range(n)]


def test_long_documents_are_ranked_in_their_rows(spark):
    """Thousands of sentences are no reason for joins, of which each rank step makes many."""
    long = ". ".join(" ".join(s) for s in prose(4000, 500, 3))
    c = S.Corpus.of(spark.createDataFrame([(1, long), (2, TEXTS[0])], "doc_id long, text string"), together=("lexrank", "textrank"))
    assert not c.has_giants
    assert {(r.model, r.doc_id) for r in c.every_summary(["lexrank", "textrank"], 2).where("summary != ''").collect()} \
        == {(m, d) for m in ("lexrank", "textrank") for d in (1, 2)}


@pytest.mark.parametrize("limits", [{}, {"KEPT_EDGES": 0}, {"KEPT_EDGES": 3000}, {"CELLS_AT_ONCE": 300, "PAIRS_AT_ONCE": 50},
                                    {"FREQUENT": 1}, {"FREQUENT": 1000}, {"FEW_SENTENCES": 0}, {"KEPT_PARTS": 0, "PAIRS_AT_ONCE": 7}])
def test_graphs_in_blocks_equal_dense_graphs(monkeypatch, limits):
    """Cosine rows by frequent and other words, edges as numbers or bits, and entry pairs in parts, against dense matrices."""
    for name, value in limits.items():
        monkeypatch.setattr(R, name, value)
    docs = [prose(130, 60, 1), [["aa"]], [], prose(70, 500, 2), [["aa", "bb"], [], ["bb"]], prose(9, 8, 4)]
    s = R.Slice(pa.array(docs, pa.list_(pa.list_(pa.string()))))
    got = {m: R._METHODS[m](s, {**S.PARAMS, "k": 3}) for m in ("lexrank", "reduction", "textrank")}
    for d, sents in enumerate(docs):
        n = len(sents)
        words = sorted({w for x in sents for w in x})
        tf = np.array([[x.count(w) for w in words] for x in sents], dtype=float).reshape(n, len(words))
        v = tf * np.log(n / np.maximum((tf > 0).sum(0), 1))
        norm = np.sqrt((v * v).sum(1, keepdims=True))
        u = np.divide(v, norm, out=np.zeros(v.shape), where=norm > 0)
        ln = np.log(np.maximum([len(x) for x in sents], 1))
        den = ln[:, None] + ln[None, :]
        shared = (tf > 0).astype(float) @ (tf > 0).T
        graphs = {"lexrank": (u @ u.T > 0.1).astype(float), "textrank": np.divide(shared, den, out=np.zeros((n, n)), where=den > 0)}
        mine = slice(s.first[d], s.first[d + 1])
        for m, w in graphs.items():
            np.fill_diagonal(w, 0.0)
            out, r = w.sum(1), np.full(n, 1.0 / max(n, 1))
            for _ in range(20):
                r = 0.15 / max(n, 1) + 0.85 * (w @ np.divide(r, out, out=np.zeros(n), where=out > 0) + r[out == 0].sum() / max(n, 1))
            assert np.abs(got[m][mine] - r).max(initial=0) < 1e-12
        assert np.abs(got["reduction"][mine] - graphs["textrank"].sum(1)).max(initial=0) < 1e-9
