"""Hull approximation: planes hold their voxels, budgets hold, and certificates agree with sampled points."""

import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfield.operators import hulls, meshes
from clearfield.operators.clusters import hull_planes, hull_volume
from clearfield.sources import suite


def unit_cells(keys):
    return np.array([[*k, 1, 1, 1] for k in keys])


def gaps(x, lo, hi):
    """Distance of points from the nearest box."""
    d = np.maximum(0, np.maximum(lo[None] - x[:, None], x[:, None] - hi[None]))
    return np.sqrt((d**2).sum(axis=2)).min(axis=1)


@pytest.mark.parametrize("seed,h", [(0, 1.0), (1, 0.1), (2, 0.03), (3, 1.0)])
def test_random_sets(seed, h):
    r = random.Random(seed)
    keys = np.array(sorted({(x, y, z) for x in range(6) for y in range(5) for z in range(4) if r.random() < 0.85 or x + y < 3})) - 2
    budget = hulls.Budget(inflation=0.3, distance=1.0)
    found = hulls.approximate(unit_cells(keys), budget, h)
    assert sorted(j for c in found.cells for j in c.boxes) == list(range(len(keys)))
    assert found.accepted and sum(len(c.planes) for c in found.cells) < 6 * len(keys) and sum(c.merged for c in found.cells) <= found.accepted
    assert float(sum(c.volume for c in found.cells)) <= 1.3 * len(keys) * h**3 * (1 + 1e-12)
    rng = np.random.default_rng(seed)
    for cell in found.cells:
        lo = keys[cell.boxes]
        corners = np.concatenate([lo + d for d in itertools.product((0, 1), repeat=3)])
        for *n, offset in cell.planes:
            assert all(sum(Fraction(a) * Fraction(float(x) * h) for a, x in zip(n, p)) <= Fraction(offset) for p in corners)
        n, offset = np.array([p[:3] for p in cell.planes]), np.array([p[3] for p in cell.planes])
        x = rng.uniform(corners.min(axis=0) * h, corners.max(axis=0) * h, (20_000, 3))
        inside = (x @ n.T <= offset).all(axis=1)
        box = np.prod(np.ptp(corners, axis=0)) * h**3
        assert float(cell.volume) == pytest.approx(inside.mean() * box, abs=6 * box / np.sqrt(20_000))
        assert not inside.any() or gaps(x[inside], lo * h, (lo + 1) * h).max() <= min(cell.bound, budget.distance * h) + 1e-12
        for k in range(len(cell.planes)):  # every plane makes a face: without it there is more
            rest = np.delete(np.arange(len(cell.planes)), k)
            solid = hulls.Polyhedron(*[tuple(Fraction(v) for v in e) for e in ((-9.0, -9.0, -9.0), (9.0, 9.0, 9.0))])
            for i in rest:
                solid.cut(100 + int(i), tuple(map(Fraction, cell.planes[i])))
            assert solid.volume() > cell.volume


def test_polyhedron_against_hulls_of_random_points():
    r = random.Random(5)
    for _ in range(30):
        points = [tuple(r.randrange(-4, 5) for _ in range(3)) for _ in range(r.randrange(5, 20))]
        try:
            planes = hull_planes(points)
        except ValueError:
            continue
        solid = hulls.Polyhedron(*[tuple(Fraction(f(p[k] for p in points)) for k in range(3)) for f in (min, max)])
        for i, p in enumerate(planes):
            solid.cut(10 + i, tuple(map(Fraction, p)))
        assert solid.volume() == hull_volume(points)
        assert {p for ring in solid.faces.values() for p in ring} <= set(points)
        assert len(solid.faces) == len(planes)


def test_extreme_corners_keep_the_hull():
    r = random.Random(8)
    lo = np.array([[r.randrange(9) for _ in range(3)] for _ in range(30)])
    hi = lo + np.array([[r.randrange(1, 4) for _ in range(3)] for _ in range(30)])
    every = [tuple(int(x) for x in np.where(s, hi[i], lo[i])) for i in range(30) for s in itertools.product((False, True), repeat=3)]
    few = [tuple(map(int, p)) for p in hulls.extreme_corners(lo, hi)]
    assert len(few) < len(set(every)) and hull_planes(few) == hull_planes(every)


def test_budgets_refuse_and_say_so():
    cells = unit_cells([(0, 0, 0), (1, 1, 0), (3, 3, 3)])
    assert len(hulls.approximate(cells, hulls.Budget(inflation=0.0)).cells) == 3
    tight, loose = (hulls.approximate(cells, hulls.Budget(inflation=50.0, distance=d)) for d in (0.1, 5.0))
    assert len(tight.cells) > 1 and tight.refused["distance"] and len(loose.cells) == 1 and loose.accepted == 2
    assert hulls.approximate(cells, hulls.Budget(inflation=50.0, distance=5.0, most_voxels=1)).refused["work"] == 2
    assert hulls.approximate(cells, hulls.Budget(inflation=50.0, distance=0.9, most_boxes=2)).refused["work"]


def test_a_solid_cube_of_many_cells_is_one(spark):
    cube = unit_cells(itertools.product(range(17), repeat=3))
    found = hulls.approximate(cube)
    assert len(found.cells) == 1 and found.cells[0].volume == 17**3 and len(found.cells[0].planes) == 6 and not found.refused["work"]
    v = spark.createDataFrame([(f, *k) for f in (0, 1) for k in itertools.product(range(6), repeat=3) if f == 0 or k[0] + k[1] < 8], "frame_id long, ix long, iy long, iz long")
    made = hulls.report(hulls.approximate_frames(v, hulls.Budget(most_voxels=100))).orderBy("frame_id").collect()
    assert [r.complete for r in made] == [False, False] and all(r.refused_work == 1 for r in made)
    made = hulls.report(hulls.approximate_frames(v)).orderBy("frame_id").collect()
    assert made[0].clusters == 1 and made[0].inflation == 0 and all(r.complete and r.accepted for r in made) and made[1].inflation <= 0.1 and made[1].planes < made[1].box_planes


def test_distance_certificate():
    corners = [(x, y, z) for x in (0, 4) for y in (0, 1) for z in (0, 1)]
    planes = [tuple(map(float, p)) for p in hull_planes(corners)]
    boxes = (np.array([(0, 0, 0), (3, 0, 0)]), np.array([(1, 1, 1), (4, 1, 1)]))
    assert hull_volume(corners) == 4
    for distance, most, want in ((1.01, 10_000, "near"), (0.9, 10_000, "far"), (1.01, 1, "work")):
        assert hulls.certify_distance((0, 0, 0), (4, 1, 1), planes, boxes, distance, most)[0] == want
    assert 1 <= hulls.certify_distance((0, 0, 0), (4, 1, 1), planes, boxes, 1.01, 10_000)[1] <= 1.01


@pytest.mark.parametrize("angle", [0.0, 0.3, 1.0])
def test_support_planes_hold_the_cluster(spark, angle):
    """A ball of triangles: fewer planes the wider the angle, and never a corner beyond one."""
    rows, n = [], 12
    at = [[(np.sin(np.pi * i / n) * np.cos(2 * np.pi * j / n), np.sin(np.pi * i / n) * np.sin(2 * np.pi * j / n), np.cos(np.pi * i / n)) for j in range(n)] for i in range(n + 1)]
    for i in range(n):
        for j in range(n):
            a, b, c, d = at[i][j], at[i + 1][j], at[i + 1][(j + 1) % n], at[i][(j + 1) % n]
            rows += [(0, 0, *map(float, (*p, *q, *r))) for p, q, r in ((a, b, c), (a, c, d)) if np.linalg.norm(np.cross(np.subtract(q, p), np.subtract(r, p))) > 1e-9]
    names = [f"{c}{k}" for c in "abc" for k in "xyz"]
    df = spark.createDataFrame(rows, "frame_id long, cluster_id long, " + ", ".join(f"{c} double" for c in names))
    got = meshes.support_planes(df, angle).collect()
    points = np.array(rows)[:, 2:].reshape(-1, 3)
    assert sum(r.faces for r in got) == len(rows) and all((points @ [r.nx, r.ny, r.nz]).max() <= r.offset + 1e-12 for r in got)
    assert all(np.dot([r.nx, r.ny, r.nz], [r.nx, r.ny, r.nz]) == pytest.approx(1) for r in got)
    # Trapezia of two triangles each, and the triangles at the poles.
    assert len(got) == n * n if angle == 0 else len(got) < n * n / 2
    inside = spark.createDataFrame([(0, k, *(0.98 * x for x in p)) for k, p in enumerate(points[:50].tolist())], "frame_id long, k long, x double, y double, z double")
    assert meshes.points_in_clusters(inside, df).where("q > 0").count() == 0


def test_scene_and_suite(spark):
    cases = suite.suite(spark)
    assert len(cases) == 20 and len({c.name for c in cases}) == 20 and cases[0].points.count() > 100
    s = suite.scene(spark, 50)
    assert s.count() == 300 and s.select("point_id").distinct().count() == 300 and s.where(F.isnan("x")).count() == 0
