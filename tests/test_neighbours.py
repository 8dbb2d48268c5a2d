"""Nearest points against all distances, on clouds with dense spots, copies and strays; smoothing against one fit at a time."""

import numpy as np
import pytest

from clearfield.operators import neighbours


def table(spark, frames):
    rows = [(f, i, *map(float, p)) for f, x in frames.items() for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double").repartition(3)


@pytest.fixture(scope="module")
def clouds():
    rng = np.random.default_rng(2)
    dense = np.concatenate([rng.normal(size=(150, 3)) * 1e-4, rng.uniform(-50, 50, (30, 3)), [[1e3, 0, 0], [1e3, 0, 1]], np.repeat([[3.0, 3.0, 3.0]], 20, axis=0)])
    t = rng.uniform(0, 2, (200, 2))
    return {0: dense, 1: np.column_stack([t, np.sin(t[:, 0]) + 0.1 * t[:, 1] ** 2 + rng.normal(size=200) * 0.01]), 2: rng.normal(size=(4, 3)), 3: [[0.5, 0.5, 0.5]], 4: np.round(rng.uniform(0, 4, (90, 3)))}


@pytest.mark.parametrize("k", [1, 7, 30])
def test_nearest_against_all_distances(spark, clouds, k):
    got = {(r.frame_id, r.point_id): [(o.d2, o.id) for o in r.near] for r in neighbours.nearest(table(spark, clouds), k).collect()}
    assert len(got) == sum(map(len, clouds.values()))
    for f, x in clouds.items():
        x = np.asarray(x)
        for i in range(len(x)):
            d = x - x[i]
            d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
            order = sorted(range(len(x)), key=lambda j: (d2[j], j))[:k]
            assert [j for _, j in got[f, i]] == order and np.allclose([a for a, _ in got[f, i]], d2[order])


def test_spacing(spark, clouds):
    got = {r.frame_id: r for r in neighbours.spacing(table(spark, clouds), 6).collect()}
    x = np.asarray(clouds[1])
    d = np.sort(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 1:7]
    assert got[1].spacing == pytest.approx(d.mean()) and got[3].spacing is None and got[0].points == 202


def test_smoothing_against_one_fit_at_a_time(spark, clouds):
    x = np.asarray(clouds[1])
    want = x.copy()
    for i in range(len(x)):
        near = x[np.argsort(((x - x[i]) ** 2).sum(axis=1), kind="stable")[:24]]
        middle = near.mean(axis=0)
        _, _, axes = np.linalg.svd(near - middle)
        u, v, w = ((near - middle) @ axes.T).T
        fit, *_ = np.linalg.lstsq(np.stack([np.ones(24), u, v, u * u, u * v, v * v], axis=1), w, rcond=None)
        a, b, _ = axes @ (x[i] - middle)
        want[i] = middle + np.array([a, b, fit @ [1, a, b, a * a, a * b, b * b]]) @ axes
    made = {(r.frame_id, r.point_id): r for r in neighbours.jet_smooth(table(spark, {1: x, 2: clouds[2]}), 24).collect()}
    assert np.allclose([[made[1, i].x, made[1, i].y, made[1, i].z] for i in range(len(x))], want, atol=1e-9)
    assert all(made[1, i].moved for i in range(len(x))) and all(not made[2, i].moved and made[2, i].x == clouds[2][i][0] for i in range(4))
    surface = lambda p: np.sin(p[:, 0]) + 0.1 * p[:, 1] ** 2 - p[:, 2]
    twice = neighbours.jet_smooth(table(spark, {1: x}), 24, 2).toPandas()[["x", "y", "z"]].to_numpy()
    assert np.abs(surface(twice)).mean() < np.abs(surface(want)).mean() + 1e-3 < np.abs(surface(x)).mean() + 1e-3


def test_refuses_too_few(spark):
    for call in (lambda p: neighbours.nearest(p, 0), lambda p: neighbours.jet_smooth(p, 5), lambda p: neighbours.jet_smooth(p, 6, 0)):
        with pytest.raises(ValueError):
            call(table(spark, {0: [[0, 0, 0]]}))


def test_crowded_blocks_go_by_joins_and_say_the_same(spark, clouds, monkeypatch):
    few = {f: clouds[f] for f in (0, 4)}
    want = {(r.frame_id, r.point_id): [o.id for o in r.near] for r in neighbours.nearest(table(spark, few), 7).collect()}
    joined = []
    plain = neighbours._nearest_by_joins
    monkeypatch.setattr(neighbours, "_nearest_by_joins", lambda p, asked, frames, k: joined.append(asked.count()) or plain(p, asked, frames, k))
    monkeypatch.setattr(neighbours, "MOST_IN_BLOCK", 100)
    monkeypatch.setattr(neighbours, "MOST_NUMBERS", 500)
    got = neighbours.nearest(table(spark, few), 7).collect()
    assert len(got) == len(want) and {(r.frame_id, r.point_id): [o.id for o in r.near] for r in got} == want
    assert 0 < joined[0] < len(want)


def test_smoothing_within_a_radius_against_one_fit_at_a_time(spark):
    from clearfield.operators import clusters

    rng = np.random.default_rng(5)
    t = rng.uniform(0, 1, (150, 2))
    x = np.column_stack([t, np.sin(2 * t[:, 0]) + 0.2 * t[:, 1] ** 2 + rng.normal(size=150) * 0.01])
    df = clusters.jet_smooth(table(spark, {3: x}), 0.25)
    got = {r.point_id: r for r in df.collect()}
    assert len(got) == 150 and 20 < sum(r.moved for r in got.values()) < 150
    for i in range(150):
        near = x[((x - x[i]) ** 2).sum(axis=1) <= 0.25 * 0.25]
        want = x[i]
        assert got[i].moved == (len(near) >= 12)
        if len(near) >= 12:
            middle = near.mean(axis=0)
            _, _, axes = np.linalg.svd(near - middle)
            u, v, w = ((near - middle) @ axes.T).T
            fit, *_ = np.linalg.lstsq(np.stack([np.ones(len(u)), u, v, u * u, u * v, v * v], axis=1), w, rcond=None)
            a, b, _ = axes @ (x[i] - middle)
            want = middle + np.array([a, b, fit @ [1, a, b, a * a, a * b, b * b]]) @ axes
        assert np.allclose([got[i].x, got[i].y, got[i].z], want, atol=1e-8)
    assert "GroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
