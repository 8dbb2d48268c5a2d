"""Delta Lloyd against plain rounds over all vectors, with ties, empty clusters and odd rows."""

import hashlib
import math

import numpy as np
import pytest

from clearfield.llm.clusters import MOST, Model, cluster_vectors, distances, reassign

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA).repartition(3)


def plain(rows, k, rounds, dims, scale=256, salt=2):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            z = [scale * x for x in v]
            if all(math.isfinite(x) and abs(math.floor(x)) <= MOST for x in z):
                kept.append((i, [math.floor(x) for x in z]))
    start = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in start]
    if not c:
        return []

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c))

    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(c)):
            its = [v for (_, v), o in zip(kept, own) if o == j]
            if its:
                c[j] = [sum(x) // len(its) for x in zip(*its)]
    last = [(i, *near(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, o in last if o == j) for j in range(len(c))}
    sha = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, o, d, inertia[o], sum(inertia.values()), sha[o]) for i, d, o in last), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    made = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=8) * 0.3]) for i in range(300)]
    made += [(300 + i, [float(x) for x in rng.integers(-1, 2, 8) / 256]) for i in range(80)]  # ties and equal vectors
    made += [(i, made[0][1]) for i in (1000, 1000, None, 1001)] + [(None, [0.0] * 8)]
    made += [(2000, None), (2001, []), (2002, [1.0] * 7), (2003, [None] + [0.0] * 7), (2004, [float("nan")] * 8), (2005, [float("inf")] + [0.0] * 7), (2006, [1e300] * 8)]
    made += [(2007, [5e5] * 8), (2008, [-0.0] * 8)]
    return made


@pytest.mark.parametrize("k,rounds", [(7, 5), (40, 5), (1, 2), (500, 3), (5, 0)])
def test_against_plain_rounds(spark, rows, k, rounds):
    made = cluster_vectors(table(spark, rows), k, rounds, 8)
    assert made.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(made) == plain(rows, k, rounds, 8)


def test_equal_vectors_leave_centroids_empty(spark):
    rows = [(i, [1.0, 2.0]) for i in range(20)] + [(99, [3.0, -2.0])]
    made = got(cluster_vectors(table(spark, rows), 30, 5, 2))
    assert made == plain(rows, 30, 5, 2) and len({r[1] for r in made}) == 2


def test_no_kept_vectors(spark):
    for rows in ([], [(1, [1.0])], [(None, [1.0, 2.0])]):
        assert cluster_vectors(table(spark, rows), 3, 2, 2).collect() == []


def test_inertia_beyond_a_long_is_null(spark):
    far = MOST / 256
    rows = [(i, [far if i % 2 else -far] * 64) for i in range(6)]
    made = cluster_vectors(table(spark, rows), 1, 0, 64).collect()
    assert len(made) == 6 and {r.inertia for r in made} == {None} and max(r.distance for r in made) == 64 * (2 * MOST) ** 2


def test_distances_are_exact_beyond_double_precision():
    v = np.array([[MOST, -MOST + 1, 3]], dtype=np.int64)
    c = np.array([[-MOST + 7, MOST, 2]], dtype=np.int64)
    assert distances(v, c)[0, 0] == sum((int(a) - int(b)) ** 2 for a, b in zip(v[0], c[0]))


def test_a_round_compares_what_changed_only_and_is_exact():
    rng = np.random.default_rng(1)
    v = rng.integers(-9, 10, (2000, 4))
    c = rng.integers(-9, 10, (12, 4))
    owner, near = reassign(v, np.full(2000, -1), np.zeros(2000, np.int64), c, np.ones(12, bool))
    for _ in range(20):
        moved = rng.random(12) < 0.3
        c = np.where(moved[:, None], rng.integers(-9, 10, (12, 4)), c)
        owner, near = reassign(v, owner, near, c, moved)
        d = distances(v, c)
        assert (owner == d.argmin(axis=1)).all() and (near == d.min(axis=1)).all()


def test_model_moves_by_floors_and_keeps_empty_centroids():
    model = Model([[0, 0], [5, 5]])
    model.apply([{"cluster": 0, "n": 3, "sums": [-4, 7]}])
    assert model.move() == [True, False] and model.centroids == [[-2, 2], [5, 5]]
    model.apply([{"cluster": 0, "n": -3, "sums": [4, -7]}])
    assert model.move() == [False, False] and model.counts == [0, 0]
