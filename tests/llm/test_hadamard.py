"""Walsh-Hadamard search and clustering against brute force, and on odd rows."""

import hashlib

import numpy as np

from precis.llm import hadamard as H


def brute(x, centroids):
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centroids] for v in x]
    return [min(range(len(r)), key=lambda c: (r[c], c)) for r in d], [min(r) for r in d]


def lloyd(ids, vectors, k=16, rounds=3):
    """The contract with Python's integers, row by row."""
    x = [[int(np.floor(64 * np.float64(v))) for v in vec] for vec in vectors]
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), x[i]))
    cent = [x[i] for i in order[:k]]
    for _ in range(rounds):
        c, _ = brute(x, cent)
        for j in range(len(cent)):
            mine = [x[i] for i in range(len(x)) if c[i] == j]
            if mine:
                cent[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return (*brute(x, cent), cent)


def test_the_transform_is_exact_and_ordered_by_sign_changes():
    rng = np.random.default_rng(0)
    x = rng.integers(-1000, 1000, (20, 64))
    y = H.transform(x)
    assert (y[:, 0] == x.sum(axis=1)).all()
    assert ((y ** 2).sum(axis=1) == 64 * (x ** 2).sum(axis=1)).all()
    basis = H.transform(np.eye(64, dtype=np.int64)).T
    assert [(np.diff(r) != 0).sum() for r in basis] == list(range(64))


def test_the_search_equals_brute_force_with_ties_and_huge_numbers():
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (300, 64))
    x[:, 4:] = 0                                                       # many equal distances
    cent = x[rng.integers(0, 300, 12)]
    cent[5] = cent[2]
    for scale in (1, 1 << 70):
        xs, cs = x.astype(object) * scale, cent.astype(object) * scale
        c, d = H.nearest(x if scale == 1 else xs, cent if scale == 1 else cs)
        want_c, want_d = brute(xs, cs)
        assert list(c) == want_c and [int(v) for v in d] == want_d


def test_far_centroids_go_before_the_last_block(monkeypatch):
    """Where vectors differ in coarse shape, one centroid a vector is left after the first block."""
    seen = []
    real = np.nonzero
    monkeypatch.setattr(H.np, "nonzero", lambda m: seen.append(m.sum()) or real(m))
    x = np.repeat(np.arange(8) * 100, 50)[:, None] + np.zeros((400, 64), dtype=np.int64)
    cent = (np.arange(8) * 100)[:, None] + np.zeros((8, 64), dtype=np.int64)
    c, d = H.nearest(x, cent)
    assert (c == np.repeat(np.arange(8), 50)).all() and not d.any()
    assert seen[0] == 400


def test_clusters_on_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.normal(size=64)]) for i in range(60)]
    rows += [rows[3], rows[3], (100, rows[7][1])]
    rows += [(200, [1e30] * 32 + [-3.0] * 32), (201, [1e30] * 64)]       # finite and huge
    odd = [(300, None), (301, []), (302, [1.0] * 63), (303, [1.0] * 65), (304, [float("nan")] + [0.0] * 63),
           (305, [float("-inf")] + [0.0] * 63), (306, [None] + [0.0] * 63)]
    schema = "vec_id long, embedding array<float>, cluster string, x int, id int, distance int"
    df = spark.createDataFrame([(i, v, "c", 1, 2, 3) for i, v in rows + odd], schema)
    assigned, cent = H.cluster(df)
    got = sorted((r.vec_id, r.cluster, r.distance) for r in assigned.collect())
    as_float = [np.float32(v).astype(np.float64) for _, v in rows]
    c, d, want_cent = lloyd([i for i, _ in rows], as_float)
    assert got == sorted((i, a, min(b, H.LARGEST)) for (i, _), a, b in zip(rows, c, d))
    assert cent == want_cent
    out = H.with_inertia(*H.cluster(df)).collect()
    assert {r.centroid_sha256 for r in out} <= {H.centroid_sha256(x) for x in cent}
    assert len({r.inertia for r in out}) == 1


def test_few_vectors_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(None, [0.5] * 64), (1, [0.25] * 64)], schema)
    out = H.with_inertia(*H.cluster(df)).collect()
    assert sorted((str(r.vec_id), r.distance) for r in out) == [("1", 0), ("None", 0)]
    assert len({r.cluster for r in out}) == 2
    assert H.with_inertia(*H.cluster(spark.createDataFrame([], schema))).collect() == []
