"""Operators over documents against brute force, and on odd rows."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.conftest import SF

P = pytest.importorskip("public_tokenizers")


def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ------------------------------------------------------------------ token counts
def unigram(vocabulary):
    from tokenizers import Tokenizer, models
    units = [("<unk>", 0.0), *((f"<0x{b:02X}>", 0.0) for b in range(256)), *vocabulary]
    return Tokenizer(models.Unigram(units, unk_id=0, byte_fallback=True))


def test_token_counts_equal_the_unigram_tokenizer(spark):
    from precis.llm.token_counts import SPACE, read_vocabulary, token_counts
    vocabulary = read_vocabulary(P.path("piece_bpe_32k.model"))
    tok = unigram(vocabulary)
    texts = {r.doc_id: r.text for r in corpus(spark).collect()}
    got = {r.doc_id: r.n_tokens for r in token_counts(corpus(spark), vocabulary).collect()}
    assert got == {i: len(tok.encode(SPACE + t.replace(" ", SPACE)).ids) for i, t in texts.items()}


def test_token_counts_ties_and_unknowns():
    from precis.llm.token_counts import SPACE, Counter as Viterbi
    vocabulary = [(SPACE, -1.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aba", -6.0), ("bab", -5.0), (SPACE + "a", -3.0)]
    tok, ours = unigram(vocabulary), Viterbi(vocabulary)
    rng = np.random.default_rng(0)
    for n in range(300):
        text = "".join(rng.choice(list("abab é."), size=rng.integers(1, 14)))
        assert ours(text)[0] == len(tok.encode(SPACE + text.replace(" ", SPACE)).ids), text


def test_token_counts_odd_rows(spark, odd_docs, no_docs):
    from precis.llm.token_counts import read_vocabulary, token_counts
    vocabulary = read_vocabulary(P.path("piece_bpe_32k.model"))
    rows = token_counts(odd_docs, vocabulary).collect()
    assert len(rows) == odd_docs.count()
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0}
    assert token_counts(no_docs, vocabulary).count() == 0


# ------------------------------------------------------------------ sharding
def check_shards(rows, n):
    slots, size = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    mean = sum(size.values()) / n
    assert max(abs(size[s] - mean) for s in range(n)) <= max((r["size"] for r in rows), default=0)


def test_shards_are_near_equal(spark):
    from precis.llm.splitters import shard
    rows = shard(corpus(spark), 40).collect()
    texts = {r.doc_id: r.text for r in corpus(spark).collect()}
    assert len(rows) == len(texts)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    check_shards(rows, 40)


def test_overfull_ranges_are_divided(spark, monkeypatch):
    """A third of all rows with one text, and splitters drawn from few keys."""
    from precis.llm import splitters
    monkeypatch.setattr(splitters, "OVERSAMPLE", 1)
    docs = spark.range(6_000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same', concat('t', id % 700)) AS text")
    rows = splitters.shard(docs, 7).collect()
    assert len(rows) == 6_000
    check_shards(rows, 7)


def test_shards_odd_rows(spark, odd_docs, no_docs):
    from precis.llm.splitters import shard
    rows = shard(odd_docs, 3).collect()
    assert len(rows) == odd_docs.count()
    assert [(r["size"], r.text_crc32) for r in rows if r.doc_id == 0] == [(16, None)]
    check_shards(rows, 3)
    assert shard(no_docs, 3).count() == 0


# ------------------------------------------------------------------ packing
def check_packing(rows, texts, window=4096):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    fill, covered = defaultdict(list), defaultdict(list)
    for r in rows:
        piece = np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert r.length > 0 and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(piece.tobytes())
        fill[r.sequence_id].append((r.offset, r.length))
        covered[r.doc_id].append((r.start, r.length))
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return fill, covered, ids


def test_packing_covers_every_id_once(spark):
    from precis.llm.packing import ids_crc32, pack
    rows = ids_crc32(pack(corpus(spark), P.path("word_bpe_49k.json"))).collect()
    texts = {r.doc_id: r.text for r in corpus(spark).collect()}
    fill, covered, ids = check_packing(rows, texts)
    for doc, parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc])
    assert set(covered) == set(ids)
    assert sum(sum(n for _, n in p) < 4096 for p in fill.values()) <= corpus(spark).rdd.getNumPartitions()


def test_packing_small_windows_and_odd_rows(spark, odd_docs, no_docs):
    from precis.llm.packing import ids_crc32, pack
    rows = ids_crc32(pack(odd_docs, P.path("word_bpe_49k.json"), window=64)).collect()
    check_packing(rows, {r.doc_id: r.text for r in odd_docs.collect()}, 64)
    texts = [r.text for r in odd_docs.collect() if r.doc_id == 4]
    assert sum(r.length for r in rows if r.doc_id == 4) == len(texts) * next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert pack(no_docs, P.path("word_bpe_49k.json")).count() == 0


def test_placement_is_the_sum_of_squares_choice():
    from precis.llm.packing import SumOfSquares
    rng = np.random.default_rng(3)
    packer, window = SumOfSquares(40), 40
    open_ = Counter()
    for k in range(2_000):
        length = int(rng.integers(1, 41))
        before = Counter(open_)

        def after(level):
            c = Counter(before)
            if level:
                c[level] -= 1
            if level + length < window:
                c[level + length] += 1
            return sum(v * v for v in c.values())

        best = min(after(h) for h in [0, *[h for h in before if before[h] and h + length <= window]])
        packer.place((k, length), length)
        open_ = Counter({h: int(n) for h, n in enumerate(packer.count) if n})
        assert sum(v * v for v in open_.values()) == best


# ------------------------------------------------------------------ near duplicates
def jaccard_classes(texts, least=0.8):
    sets = {}
    for i, t in texts.items():
        w = (t or "").split()
        if w:
            sets[i] = frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)])
    df = Counter(s for x in sets.values() for s in x)
    rare = defaultdict(list)
    for i, x in sets.items():                     # texts as similar as this share one of their rarest shingles
        for s in sorted(x, key=lambda s: (df[s], s))[:int(len(x) * (1 - least)) + 1]:
            rare[s].append(i)
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for group in rare.values():
        for n, a in enumerate(group):
            for b in group[n + 1:]:
                both = len(sets[a] & sets[b])
                if find(a) != find(b) and both >= least * (len(sets[a]) + len(sets[b]) - both):
                    low, high = sorted((find(a), find(b)))
                    parent[high] = low
    return {i: find(i) for i in texts}


def test_near_duplicates_equal_brute_force(spark):
    from precis.llm.probminhash import near_duplicates
    texts = {r.doc_id: r.text for r in corpus(spark).collect()}
    rows = near_duplicates(corpus(spark)).collect()
    truth = jaccard_classes(texts)
    assert len(rows) == len(texts)
    assert np.mean([truth[r.doc_id] == r.class_id for r in rows]) >= 0.999
    assert all(r.kept == (r.doc_id == r.class_id) for r in rows)


def test_large_groups_of_copies_in_blocks(spark, monkeypatch):
    """A hub with many variants, dealt in blocks of 16."""
    from precis.llm import probminhash
    monkeypatch.setattr(probminhash, "BLOCK", 16)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(300):
        w = list(base)
        for at in rng.choice(120, size=int(rng.integers(0, 4)), replace=False):
            w[at] = f"v{i}x{at}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in probminhash.near_duplicates(docs).collect()}
    assert got == jaccard_classes(dict(rows))


def test_near_duplicates_odd_rows(spark, odd_docs, no_docs):
    from precis.llm.probminhash import deduplicated, near_duplicates
    rows = near_duplicates(odd_docs).collect()
    of = {r.doc_id: r.class_id for r in rows}
    assert len(rows) == odd_docs.count()
    assert of[5] == of[6] == 4 and of[8] == of[7] == 7 and [of[i] for i in (0, 1, 2, 3)] == [0, 1, 2, 3] and of[None] is None
    kept = deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([0, 1, 2, 3, 4, 7, 9, 10, 11, None])
    assert near_duplicates(no_docs).count() == 0 and deduplicated(no_docs).count() == 0


def test_signatures_estimate_probability_jaccard():
    from precis.llm.probminhash import probability_jaccard, shingles, signatures, weights
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(12)], size=60)) for _ in range(20)]
    doc, h, count = shingles(pa.array(texts), words=1)
    w = weights(count)
    sig = signatures(doc, h, w, len(texts), 4_000)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    of = [dict(zip(h[s:e].tolist(), w[s:e].tolist())) for s, e in zip(at[:-1], at[1:])]
    for a in range(6):
        for b in range(a):
            x, y = of[a], of[b]
            exact = sum(1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in {*x, *y}) for i in x if i in y)
            fast = probability_jaccard((h[at[a]:at[a + 1]], w[at[a]:at[a + 1]]), (h[at[b]:at[b + 1]], w[at[b]:at[b + 1]]))
            assert abs(exact - fast) < 1e-9 and abs((sig[a] == sig[b]).mean() - exact) < 0.04


# ------------------------------------------------------------------ classifier
def test_classifier_on_held_out_labels(spark):
    from precis.llm.weak_labels import classify
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = classify(corpus(spark)).select("doc_id", "accepted").collect()
    good = [r.accepted for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.accepted for r in rows if labels.get(r.doc_id) == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.05


def test_em_finds_the_labellers_accuracies():
    from precis.llm.weak_labels import LABELLERS, fit_labellers
    rng = np.random.default_rng(0)
    n, k = 20_000, len(LABELLERS)
    kind = rng.choice(k + 1, size=n, p=[0.8, *[0.2 / k] * k])
    says_bad = rng.random((n, k)) < np.where(np.arange(1, k + 1) == kind[:, None], 0.95, 0.002)
    votes = np.where(rng.random((n, k)) < 0.1, 0, np.where(says_bad, 2, 1))
    patterns, back, counts = np.unique(votes @ 3 ** np.arange(k), return_inverse=True, return_counts=True)
    share, p, post = fit_labellers(patterns, counts.astype(float))
    assert abs(share[0] - 0.8) < 0.02 and np.abs(p[0] - 0.002).max() < 0.02
    assert ((post[back] > 0.5) == (kind == 0)).mean() > 0.95


def test_classifier_odd_rows(spark, odd_docs, no_docs):
    from precis.llm.weak_labels import accepted, classify
    rows = classify(odd_docs).collect()
    assert len(rows) == odd_docs.count() and {r.score for r in rows if r.doc_id in (0, 1, 2)} == {0.0}
    assert len({r.score for r in rows if r.doc_id in (4, 5, 6)}) == 1
    assert accepted(odd_docs).columns == odd_docs.columns and accepted(no_docs).count() == 0


# ------------------------------------------------------------------ mixing
def resharing(sizes, weights=(1, 2, 3), cap=3):
    """Targets by repeating: share, stop those above their cap, reshare the excess."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in stopped]
        rest = total - sum(stopped.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in left) for s in left}
        over = [s for s in left if share[s] >= cap * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped.update({s: cap * sizes[s] for s in over})
        if len(stopped) == len(names):
            return stopped


def check_mix(docs, tolerance):
    import re
    from precis.llm.mixing import mix
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = mix(docs).collect()
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")) and 0 <= r.reps <= 3
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.reps
        largest[r.source] = max(largest[r.source], r["size"])
    truth = resharing({s: sizes[s] for s in {r.source for r in rows}})
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - truth[r.source]) <= 1e-6 * max(1, truth[r.source])
    for s in truth:
        assert abs(taken[s] - truth[s]) <= tolerance(largest[s])
    assert sorted(map(str, mix(docs).collect())) == sorted(map(str, rows))


def test_mix_equals_repeated_resharing(spark):
    check_mix(corpus(spark), lambda largest: largest / 2)


def test_mix_with_stopped_sources(spark):
    docs = spark.range(3_000).selectExpr(
        "id AS doc_id", "repeat('w ', CAST(1 + id % 7 AS INT)) AS text",
        "CASE WHEN id < 2900 THEN 'a' WHEN id < 2960 THEN 'b' WHEN id < 2990 THEN NULL ELSE 'c' END AS source")
    check_mix(docs, lambda largest: largest)


def test_mix_odd_rows(spark, odd_docs, no_docs):
    from precis.llm.mixing import mix, mixed_rows
    assert mix(odd_docs).count() == odd_docs.count()
    assert mixed_rows(odd_docs).columns == odd_docs.columns
    assert mix(no_docs).count() == 0 and mixed_rows(no_docs).count() == 0
    wordless = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.target, r["size"] * r.reps) for r in mix(wordless).collect()] == [(0.0, 0), (0.0, 0)]


def test_mix_runs_no_python(spark):
    from precis.llm.mixing import mixed_rows
    plan = mixed_rows(corpus(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_open_windows_are_bounded():
    """Rests above half a window never share one: settled early, every window but the last is full, no token is lost."""
    from precis.llm import packing as K
    rng = np.random.default_rng(7)
    packer, closed, most = K.SumOfSquares(100), [], 0

    def cut_at(piece, n):
        return (piece[0], n, piece[2]), (piece[0], piece[1] - n, piece[2] + n)
    lengths = [60] * 5_000 + [int(v) for v in rng.integers(51, 100, 5_000)]
    for d, n in enumerate(lengths):
        if full := packer.place((d, n, 0), n):
            closed.append(full)
        if packer.n_open > 64:
            closed.extend(packer.settle(cut_at, 32))
        most = max(most, packer.n_open)
    closed.extend(packer.settle(cut_at))
    assert most <= 65 and packer.n_open == 0
    assert [sum(p[1] for p in w) for w in closed[:-1]] == [100] * (len(closed) - 1)
    at = Counter()
    for w in closed:
        for d, n, _ in w:
            at[d] += n
    assert at == Counter(dict(enumerate(lengths)))
