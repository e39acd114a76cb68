"""Transducer and source divergence against brute force, and on odd rows."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from precis.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text or "")]


def brute(rows, min_docs=3, k=200):
    """The contract with Python's integers: rows of (lang, source, text)."""
    rows = [(lang or "", source or "", terms(text)) for lang, source, text in rows]
    held = defaultdict(Counter)
    for lang, _, t in rows:
        held[lang].update(set(t))
    kept = {lang: sorted(w for w, n in c.items() if n >= min_docs) for lang, c in held.items()}
    count = defaultdict(Counter)
    for lang, source, t in rows:
        keep = set(kept[lang])
        count[lang, source].update(w for w in t if w in keep)
        count[lang].update(w for w in t if w in keep)

    def share(key, lang):
        n, v = count[key].total(), len(kept[lang])
        return {w: 1 + 10 ** 9 * (count[key][w] + 1) // (n + v) for w in kept[lang]}

    out = set()
    for lang, source in {r[:2] for r in rows}:
        p, q = share((lang, source), lang), share(lang, lang)
        pairs = []
        for other in {s for l, s, _ in rows if l == lang and s != source}:
            o = share((lang, other), lang)
            pairs.append((-sum((p[w] - o[w]) ** 2 // o[w] for w in p), other.encode()))
        own = [(-((p[w] - q[w]) ** 2 // q[w]), w.encode()) for w in p if count[lang, source][w] and p[w] > q[w]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(own)[:k])):
            out |= {(lang, source, part, w.decode(), -v, r) for r, (v, w) in enumerate(items, 1)}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_terms_of_text_buffers():
    texts = ["Ab-cD é1É漢字", "", "x", "xY", "1", "ß\nß", "a\x00b"]
    column = pa.array(["skipped", *texts])[1:]
    found, row = D.terms_of(*D.utf8(column))
    assert [(r, t.decode()) for r, t in zip(row, found.to_pylist())] == [(i, t) for i, x in enumerate(texts) for t in terms(x)]
    assert len(D.terms_of(*D.utf8(pa.array([], pa.string())))[0]) == 0


@pytest.mark.parametrize("n", [0, 1, 3, 400, 20_000])
def test_the_transducer_is_minimal_and_counts_in_order(n):
    rng = np.random.default_rng(n)
    words = sorted({"".join(rng.choice(list("abcé漢"), rng.integers(1, 9))).encode() for _ in range(n)})
    t = D.Transducer(words)

    def ordinals(strings):
        return list(t.ordinals(np.r_[0, np.cumsum([len(s) for s in strings])].astype(np.int64),
                               np.frombuffer(b"".join(strings), dtype=np.uint8)))
    assert ordinals(words) == list(range(len(words)))
    wrong = [w + b"a" for w in words if w + b"a" not in set(words)] + [w[:-1] for w in words if w[:-1] not in set(words)] + [b""]
    assert set(ordinals(wrong)) == {-1}
    # one state per distinct set of continuations
    after = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            after[w[:i]].add(w[i:])
    assert len(t.states) == max(1, len({frozenset(a) for a in after.values()}))


def corpus(n=500):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        words = [f"w{'abcdefghij'[int(c)]}{'xyz' * int(c)}" for c in rng.zipf(1.4, rng.integers(0, 40)) % 10]
        words += ["".join(rng.choice(list("éabc"), 2)) for _ in range(rng.integers(0, 30))]
        rows.append((["en", "de", None][rng.integers(0, 3)], f"s{0 if i % 3 == 0 else rng.integers(0, 9)}", " ".join(words)))
    return rows + [("xx", "lonely", "few words"), ("yy", "a", None), ("yy", "b", "words once"), ("yy", None, ""), *rows[:40]]


def test_audit_equals_brute_force(spark, monkeypatch):
    """Many ranges, blocks of few sources and few terms, groups without terms, null columns, repeated rows."""
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "lang string, source string, text string, n int, p int")
    want = brute(rows)
    assert got(D.audit(df.repartition(5))) == want
    monkeypatch.setattr(D, "TERMS_PER_RANGE", 15)
    monkeypatch.setattr(D, "CHUNK_BYTES", 300)
    monkeypatch.setattr(D, "SOURCE_BLOCK", 3)
    monkeypatch.setattr(D, "TERM_BLOCK", 4)
    assert got(D.audit(df.repartition(5))) == want
    assert got(D.audit(df, min_docs=30, k=2)) == brute(rows, 30, 2)


def test_audit_of_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in odd_docs.collect()]
    assert got(D.audit(odd_docs)) == brute(rows)
    assert got(D.audit(odd_docs, min_docs=1)) == brute(rows, 1)
    assert got(D.audit(no_docs)) == set()


def test_shares_of_large_counts_are_exact(spark):
    n, total, v = 7 * 10 ** 13, 15 * 10 ** 14, 10 ** 9
    from pyspark.sql import functions as F
    row = spark.range(1).select(D._share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first()
    assert row.p == 1 + 10 ** 9 * (n + 1) // (total + v)
