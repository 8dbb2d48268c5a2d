import numpy as np

from clearfield.llm.embed_dedup import bucket_keys, cosines, hadamard, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, weight string"


def brute(rows, least):
    good = {}
    for k, (i, v, label, _) in enumerate(rows):
        if i is None or v is None or label is None or any(x is None for x in v):
            continue
        x = np.array(v, dtype=np.float32).astype(np.float64)
        if len(x) and np.isfinite(x).all() and x.any():
            good[k] = x
    n = [0] * len(rows)
    parent = {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                if good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= least:
                    n[a] += 1
                    n[b] += 1
                    x, y = find(rows[a][0]), find(rows[b][0])
                    parent[max(x, y)] = min(x, y)
    return sorted((r[0], n[k], find(r[0])) for k, r in enumerate(rows))


def vectors(seed=1, n=300, dims=64):
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.normal(size=(12, dims))
    for i in range(n):
        c = centres[i % 12] + rng.normal(size=dims) * rng.choice([0.02, 0.1, 0.5])
        rows.append((i, [float(x) for x in (c * rng.choice([1.0, 3.0])).astype(np.float32)], int(i % 4), "w"))
    rows += [(n + k, rows[k][1], rows[k][2], "w") for k in range(20)]  # equal vectors
    rows += [(n + 30, None, 1, "w"), (n + 31, [0.0] * dims, 1, "w"), (n + 32, [float("nan")] * dims, 1, "w"), (n + 33, [None] * dims, 1, "w")]
    rows += [(n + 34, rows[0][1], None, "w"), (n + 35, [], 1, "w"), (n + 36, [1.0], 1, "w"), (n + 37, [2.0], 1, "w"), (n + 38, [-2.0], 1, "w"), (n + 39, [float("inf")] * dims, 1, "w")]
    return rows


def test_against_brute_force(spark):
    rows = vectors()
    for block in (8, 256):
        got = near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.98, block=block).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.98)
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty_blocks_of_a_bucket(spark):
    """Forty mutual neighbours in blocks of one and two, some of which are empty."""
    rng = np.random.default_rng(5)
    centre = rng.normal(size=64)
    rows = [(i, [float(x) for x in (centre + rng.normal(size=64) * 0.01).astype(np.float32)], 1, "w") for i in range(40)]
    rows += [(100, [float(x) for x in rng.normal(size=64)], 1, "w")]
    want = brute(rows, 0.98)
    assert [n for _, n, _ in want[:40]] == [39] * 40
    for block in (1, 2):
        got = near_vectors(spark.createDataFrame(rows, SCHEMA), 0.98, block=block).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want


def test_links_at_the_bound(spark):
    """A pair exactly at the cosine is a link; one just below is none."""
    rows = [(0, [1.0, 0.0], 1, "w"), (1, [0.6, 0.8], 1, "w"), (2, [0.59, 0.81], 1, "w")]
    least = float(cosines(np.array([[1.0, 0.0]]), np.array([[0.6, 0.8]], np.float32).astype(float))[0, 0])
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, SCHEMA), least).collect()}
    assert got == {0: 1, 1: 2, 2: 1}


def test_empty_table_and_null_number(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    got = near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1, "w"), (3, [1.0, 0.0], 1, "w")], SCHEMA)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(None, 0, None, True), (3, 0, 3, True)}


def test_hadamard_keeps_lengths_and_buckets_recall():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 64))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    base = x / np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    near = 0.98 * base + np.sqrt(1 - 0.98**2) * noise
    assert np.allclose(np.diag(cosines(base, near)), 0.98)
    a, b = bucket_keys(base, np.zeros(50)), bucket_keys(near, np.zeros(50))
    assert (a[:, :, :, None] == b[:, :, None, :]).any(axis=(1, 2, 3)).mean() == 1.0
