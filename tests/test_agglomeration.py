"""Agglomeration of tetrahedra against a plain walk that recomputes everything, with reflex edges, ties and limits."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest

from clearfield.operators import clusters

SIX = [(0, a, a | b, 7) for a, b in ((1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2))]


def blocks(cells, scale=1.0):
    """Unit cubes at integer places as six tetrahedra each, with shared corners."""
    at = {}
    tets = []
    for c in cells:
        for t in SIX:
            tets.append([at.setdefault(tuple(c[k] + (v >> k & 1) for k in range(3)), len(at)) for v in t])
    return np.array(list(at), dtype=float) * scale, np.array(tets)


def plain(x, tets, target=0, most_cells=0, most_planes=0):
    exact = [[Fraction(float(v)) for v in p] for p in x]

    def side(a, b, c, d):
        u, v, w = ([s - t for s, t in zip(exact[p], exact[a])] for p in (b, c, d))
        s = u[0] * (v[1] * w[2] - v[2] * w[1]) + u[1] * (v[2] * w[0] - v[0] * w[2]) + u[2] * (v[0] * w[1] - v[1] * w[0])
        return (s > 0) - (s < 0)

    def outer(cells):
        count = {}
        for t in cells:
            v = tets[t].tolist()
            for k in range(4):
                count.setdefault(tuple(sorted(v[:k] + v[k + 1 :])), []).append(v[k])
        return {f: i[0] for f, i in count.items() if len(i) == 1}

    def plane(f, inner):
        a, b, c = x[list(f)]
        n = np.cross(b - a, c - a)
        n = n / np.linalg.norm(n) * -side(*f, inner)
        return (*(np.round(n, 9) + 0.0).tolist(), round(float(n @ a), 9) + 0.0)

    def convex(cells):
        used = {v for t in cells for v in tets[t].tolist()}
        return all(side(*f, v) in (0, side(*f, i)) and side(*f, i) for f, i in outer(cells).items() for v in used)

    def area(f):
        a, b, c = x[list(f)]
        return float(np.linalg.norm(np.cross(b - a, c - a)) / 2)

    held = {t: [t] for t in range(len(tets))}
    refused = set()
    while not (target and len(held) <= target):
        found = []
        for a, b in itertools.combinations(sorted(held), 2):
            shared = set(outer(held[a])) & set(outer(held[b]))
            key = (tuple(sorted(held[a])), tuple(sorted(held[b])))
            if shared and key not in refused:
                rest = outer(held[a] + held[b])
                found.append((-sum(sorted(area(f) for f in shared)), len(rest), len({plane(f, i) for f, i in rest.items()}), a, b))
        if not found:
            break
        *_, planes, a, b = min(found)
        if (most_cells and len(held[a]) + len(held[b]) > most_cells) or (most_planes and planes > most_planes) or not convex(held[a] + held[b]):
            refused.add((tuple(sorted(held[a])), tuple(sorted(held[b]))))
            continue
        held[a] += held.pop(b)
    out = np.zeros(len(tets), int)
    for i, c in enumerate(sorted(held.values(), key=min)):
        out[c] = i
    return out


L, U = [(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 0, 0), (1, 0, 0), (2, 0, 0), (0, 1, 0), (2, 1, 0)]


@pytest.mark.parametrize("cells", [[(0, 0, 0)], L, U, [(0, 0, 0), (1, 1, 0)], [(0, 0, 0), (1, 0, 0), (1, 1, 0), (1, 1, 1)]])
@pytest.mark.parametrize("limits", [{}, {"target": 3}, {"most_cells": 7}, {"most_planes": 5}])
def test_blocks_against_a_plain_walk(cells, limits):
    x, tets = blocks(cells, 0.5)
    got = clusters.agglomerate(x, tets, **limits)
    assert (got == plain(x, tets, **limits)).all()


def test_moved_corners_against_a_plain_walk():
    r = random.Random(6)
    for _ in range(4):
        x, tets = blocks(L)
        x = x + np.array([[r.choice([0, 0, 0.25, -0.125]) for _ in range(3)] for _ in x])
        assert (clusters.agglomerate(x, tets) == plain(x, tets)).all()


def test_flat_tetrahedra_stay_alone():
    x, tets = blocks([(0, 0, 0)])
    flat = np.vstack([x, [[0.5, 0.5, 0]]])
    got = clusters.agglomerate(flat, np.vstack([tets, [[0, 1, 3, len(x)]]]))
    assert (got[:6] == clusters.agglomerate(x, tets)).all() and got[6] == 3


def test_a_fan_around_an_edge_is_one():
    """Slices of a pie of a quarter turn: every union of neighbours is convex."""
    n = 9
    x = np.array([[0, 0, 0], [0, 0, 1], *[[np.cos(t), np.sin(t), 0] for t in np.linspace(0, np.pi / 2, n + 1)]])
    tets = np.array([[0, 1, 2 + i, 3 + i] for i in range(n)])
    assert set(clusters.agglomerate(x, tets)) == {0}
    assert len(set(clusters.agglomerate(x, tets, target=4))) == 4


def test_many_frames_go_through_one_kernel_in_batches(spark):
    """Equal and unequal frames: clusters as frame by frame, and no frame or cluster is a group of its own in Python."""
    from clearfield.operators import meet, meshes
    from clearfield.sources import bundles

    cube = [(float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
    six = [[0, a, a | b, 7] for a, b in ((1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2))]
    frames = {f: ([(10 + i, *(c * (1 + f % 3) for c in p)) for i, p in enumerate(cube)], [[10 + v for v in t] for t in six[: 6 - f % 2]]) for f in range(12)}
    vertices = spark.createDataFrame([(f, *p) for f, (vs, _) in frames.items() for p in vs], "frame_id long, vertex_id long, x double, y double, z double").repartition(3)
    tets = spark.createDataFrame([(f, 3 * i, t) for f, (_, ts) in frames.items() for i, t in enumerate(ts)], "frame_id long, tet_id long, v array<long>").repartition(3)
    found = clusters.agglomerate_frames(vertices, tets)
    got = {(r.frame_id, r.tet_id): r.cluster_id for r in found.collect()}
    for f, (vs, ts) in frames.items():
        want = clusters.agglomerate(np.array([p[1:] for p in vs]), np.array(ts) - 10)
        assert [got.pop((f, 3 * i)) for i in range(len(ts))] == want.tolist()
    assert not got
    faces = meshes.cluster_faces(tets, found, vertices)
    planes = meshes.support_planes(faces)
    held = {r.frame_id: r.held for r in planes.groupBy("frame_id").agg({"faces": "sum"}).withColumnRenamed("sum(faces)", "held").collect()}
    assert held == {r.frame_id: r["count"] for r in faces.groupBy("frame_id").count().collect()}
    for df in (found, planes, bundles.plane_trees(planes), meet.packed(vertices, ["x", "y", "z"])):
        assert "GroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="unknown vertices"):
        clusters.agglomerate_frames(vertices.where("vertex_id > 11"), tets).collect()
