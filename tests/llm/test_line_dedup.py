"""Minimal perfect hash and line dedup against brute force, and on odd rows."""

from collections import Counter

import numpy as np
import pytest

from precis.llm import line_dedup as L


def key(line):
    return line.strip(L.STRIPPED).translate({c: c + 32 for c in range(65, 91)})


def brute(texts, min_docs=10, min_chars=1):
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if len(k) >= min_chars)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def rows(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5_000, 100_000])
def test_the_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    h1, h2 = (rng.integers(-2 ** 63, 2 ** 63, n, dtype=np.int64) for _ in range(2))
    h1[: n // 10] = h1[:1].repeat(n // 10) if n > 10 else h1[: n // 10]      # keys that share one of the hashes
    counts = rng.integers(1, 1_000, n)
    index = L.LineIndex(h1, h2, counts)
    assert sorted(index.slots(h1.view(np.uint64), h2.view(np.uint64))) == list(range(n))
    assert (index.count(h1, h2) == np.minimum(counts, 255)).all()
    other = rng.integers(-2 ** 63, 2 ** 63, 2_000, dtype=np.int64)
    assert (L.LineIndex(h1, h2, counts, np.uint64).count(other, other) == 0).all()


def test_lines_are_dropped_as_by_brute_force(spark, monkeypatch):
    """Heavy keys, many shards, copies, repeated rows, and lines that differ in case and white space only."""
    monkeypatch.setattr(L, "KEYS_PER_SHARD", 40)
    monkeypatch.setattr(L, "HEAVY_DOCS", 60)
    rng = np.random.default_rng(3)
    texts = []
    for i in range(400):
        lines = [f"line {rng.zipf(1.3) % 3_000}" for _ in range(rng.integers(0, 12))]
        lines += [" \tMenu\x0b" if i % 2 else "mENU", "É" if i % 3 else "é", " menu"][: rng.integers(0, 4)]
        texts.append("\n".join(lines))
    texts += [texts[5]] * 130 + [None, "", "\n\n", "x\r\ny", " "]
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in enumerate(texts)], "doc_id long, text string, n int, shard string")
    want = sorted((str(i), *r) for i, r in enumerate(brute(texts)))
    assert rows(L.without_common_lines(df.repartition(7))) == want
    assert any(r[2] for r in want) and want != sorted((str(i), *r) for i, r in enumerate(brute(texts, 60)))


def test_lines_of_odd_rows(spark, odd_docs, no_docs):
    texts = [r.text for r in odd_docs.collect()]
    ids = [str(r.doc_id) for r in odd_docs.collect()]
    for m in (1, 2, 10):
        want = sorted((i, *r) for i, r in zip(ids, brute(texts, m)))
        assert rows(L.without_common_lines(odd_docs, m)) == want
    assert rows(L.without_common_lines(odd_docs, 2, min_chars=4)) == sorted((i, *r) for i, r in zip(ids, brute(texts, 2, 4)))
    assert rows(L.without_common_lines(no_docs)) == []


def test_a_very_long_text(spark):
    long = "\n".join(f"l{i % 30_000}" for i in range(120_000)) + "\n" + " " * 200_000 + "x"
    df = spark.createDataFrame([(1, long), (2, long)], "doc_id long, text string")
    got = L.without_common_lines(df, 2).collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in got] == [(120_001, 120_001, "")] * 2
