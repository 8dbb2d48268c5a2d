"""Sums over balls against the points within them, and the surfaces fitted from them against fits of the neighbours one by one."""

import numpy as np
import pytest

from clearfield.operators import balls, clusters
from clearfield.operators.neighbours import fitted


def clouds():
    rng = np.random.default_rng(7)
    t = rng.uniform(0, 1, (1500, 2))
    blob = rng.normal(size=(2500, 3)) * 0.3
    return {
        "blob": (blob, 0.3), "far": (blob + [3e5, -2e5, 1e5], 0.3), "surface": (np.column_stack([t, np.sin(2 * t[:, 0]) + 0.2 * t[:, 1] ** 2]), 0.2),
        "lattice": (np.round(rng.uniform(0, 1, (1200, 3)) * 20) / 20, 0.2), "copies": (np.concatenate([np.repeat(blob[:3], 300, axis=0), blob[:400]]), 0.5),
        "line": (np.outer(rng.uniform(0, 1, 300), [1.0, 2.0, 3.0]), 0.4), "one place": (np.ones((40, 3)), 0.1),
    }


@pytest.mark.parametrize("name", clouds())
def test_fits_from_sums_against_fits_of_neighbours(name):
    x, radius = clouds()[name]
    cell = np.floor(x / radius).astype(np.int64)
    mine = np.sort(np.random.default_rng(1).permutation(len(x))[:200])
    mine = np.flatnonzero((cell[:, None] == cell[None, mine]).all(axis=2).any(axis=1))  # whole cells
    out, moved = balls.smoothed(x, mine, cell, radius, 12)
    for i in range(0, len(mine), max(1, len(mine) // 150)):
        d = x - x[mine[i]]
        near = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= radius * radius
        assert moved[i] == (near.sum() >= 12)
        want = fitted(x[mine[i]][None], x[near][None])[0] if moved[i] else x[mine[i]]
        assert np.allclose(out[i], want, rtol=0, atol=1e-9 if name != "far" else 1e-7)


def test_points_that_are_not_finite_stay_and_are_nobodys_neighbours():
    x = np.concatenate([np.random.default_rng(3).uniform(0, 0.1, (40, 3)), [[np.nan, 0.05, 0.05]]])
    out, moved = balls.smoothed(x, np.arange(41), np.zeros((41, 3)), 0.2, 12)
    whole, _ = balls.smoothed(x[:40], np.arange(40), np.zeros((40, 3)), 0.2, 12)
    assert moved[:40].all() and not moved[40] and np.isnan(out[40, 0]) and np.array_equal(out[:40], whole)


def test_dense_cells_are_summed_as_wholes(monkeypatch):
    """Of a dense cloud far fewer products are worked out than there are pairs of neighbours."""
    x = np.random.default_rng(4).uniform(0, 3, (40_000, 3))
    mine, plain, seen = np.flatnonzero((np.floor(x) == 1).all(axis=1)), balls.products, [0]

    def counted(p):
        seen[0] += p.shape[1]
        return plain(p)

    monkeypatch.setattr(balls, "products", counted)
    sums = balls.ball_sums(x, mine, np.ones(3), 1.0)
    for i in (0, 700):
        d = x - x[mine[i]]
        near = x[d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= 1] - 1.5
        assert sums[i, 0] == len(near) and np.allclose(sums[i], [np.prod(near**p, axis=1).sum() for p in np.array(balls.POWERS)])
    assert 8 * seen[0] < sums[:, 0].sum()


def test_points_are_dealt_to_blocks(spark):
    """A point serves eight blocks at most, not 27 cells, and dense blocks are many tasks."""
    x = np.random.default_rng(6).normal(size=(600, 3))
    points = spark.createDataFrame([(1, i, *map(float, p)) for i, p in enumerate(x)], "frame_id long, point_id long, x double, y double, z double")
    made = clusters.jet_smooth(points, 0.5)
    plan = made._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Generate explode") == 3 and made.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    assert made.count() == 600
