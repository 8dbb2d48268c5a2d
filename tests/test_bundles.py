"""Bundles against brute force: texts evaluated, splits found again, damaged functions and meshes told."""

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_arrangement import NAMED, program_of

from clearfield.operators import arrangement as A
from clearfield.operators import boundary, sweep
from clearfield.sources import bundles

H = 0.5


@pytest.mark.parametrize("name", sorted(NAMED))
def test_expression(name):
    p, _, _ = program_of(NAMED[name], 1.0)
    text = A.expression(p)
    x = np.random.default_rng(3).uniform(-7, 7, (500, 3))
    got = eval(text, {"x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "least": lambda *a: np.minimum.reduce(a), "greatest": lambda *a: np.maximum.reduce(a)})  # noqa: S307
    assert np.allclose(got, A.hard_values(p, x), atol=1e-12)
    assert A.expression(p, A.expanded_nodes(p)) == text and A.expression(p, A.expanded_nodes(p) - 1) is None


def test_expression_in_spark(spark):
    p, _, _ = program_of(NAMED["stairs"], 1.0)
    x = np.random.default_rng(4).uniform(-4, 4, (50, 3))
    points = spark.createDataFrame(x.tolist(), "x double, y double, z double")
    assert np.allclose([r.q for r in points.select(F.expr(A.expression(p)).alias("q")).collect()], A.hard_values(p, x))


def grid_and_planes(keys):
    keys = set(keys)
    planes = [set(), set(), set()]
    for key, axis, side in itertools.product(keys, range(3), (-1, 1)):
        if tuple(c + side * (a == axis) for a, c in enumerate(key)) not in keys:
            planes[axis].add(key[axis] + (side > 0))
    planes = [np.array(sorted(p)) for p in planes]
    grid = np.zeros([len(p) + 1 for p in planes], bool)
    for key in keys:
        grid[tuple(np.searchsorted(planes[a], key[a], side="right") for a in range(3))] = True
    return grid, planes


@pytest.mark.parametrize("name", sorted(NAMED))
def test_splits(name):
    """Every mixed part is cut once, by the least key over all of its cuts; parts of one kind are not cut."""
    grid, planes = grid_and_planes(NAMED[name])
    log = []
    A.build(grid, planes, 1.0, log=log)
    want = []

    def go(lo, hi, parent):
        part = grid[tuple(slice(a, b) for a, b in zip(lo, hi, strict=True))]
        if part.all() or not part.any():
            return
        keys = []
        for axis in range(3):
            for cut in range(lo[axis] + 1, hi[axis]):
                two = np.split(part, [cut - lo[axis]], axis=axis)
                keys.append((sum(bool(t.any() and not t.all()) for t in two), max(t.size for t in two), axis, cut, int(two[0].sum())))
        _, _, axis, cut, left = min(keys)
        want.append((parent, axis, int(planes[axis][cut - 1]), lo, hi, int(part.sum()), left))
        at = len(want) - 1
        go(lo, tuple(cut if a == axis else c for a, c in enumerate(hi)), at)
        go(tuple(cut if a == axis else c for a, c in enumerate(lo)), hi, at)

    go((0, 0, 0), grid.shape, -1)
    assert log == want


def voxel_frames(spark, frames):
    rows = [(f, *k) for f, keys in frames.items() for k in keys]
    return spark.createDataFrame(rows, "frame_id long, ix long, iy long, iz long")


def test_direct_tables(spark):
    frames = dict(enumerate(NAMED[n] for n in sorted(NAMED)))
    v = voxel_frames(spark, frames)
    t = bundles.direct_tables(v, boundary.exposed_faces(v), H, most_nodes=20)
    report = {r["frame_id"]: r for r in t["validation"].collect()}
    assert set(report) == set(frames) and all(r["ok"] for r in report.values())
    for r in t["expressions"].collect():
        assert (r["text"] is None) == (r["expanded"] > 20)
    parents = t["splits"].groupBy("frame_id").agg(F.count_if(F.col("parent").isNull()).alias("roots")).collect()
    assert len(parents) == len(frames) and all(r["roots"] == 1 for r in parents)


def test_wrong_functions_are_told(spark):
    """Functions of frames without a voxel: wrong signs at the probes of it, planes that do not fit the registry."""
    whole, less = voxel_frames(spark, {0: NAMED["stairs"]}), voxel_frames(spark, {0: NAMED["stairs"][1:]})

    def made(v):
        planes = boundary.supports(boundary.exposed_faces(v))
        coords = boundary.coordinates(planes)
        return planes, A.build_programs(boundary.cells(v, coords), coords, H)

    planes, _ = made(whole)
    _, wrong = made(less)
    patched = boundary.number_patches(boundary.patches(boundary.exposed_faces(whole)))
    samples = bundles.samples_of(whole, patched, wrong, H)
    assert samples.where(~F.col("ok") & (F.col("kind") == "centre")).count() == 1
    far = planes.withColumn("coord", F.when(F.col("coord") == 3, 9).otherwise(F.col("coord")))
    found = A.provenance(wrong, far).first()
    assert found["unexplained"] == 2 and found["unused"] == 2
    empty = A.provenance(wrong, planes.where("false")).first()
    assert empty["unexplained"] == empty["planes"] > 0 and empty["unused"] == 0


def test_slopes(spark):
    p, _, _ = program_of(NAMED["U"], H)
    programs = spark.createDataFrame([(0, bytearray(p.pack()))], "frame_id long, program binary")
    x = np.random.default_rng(5).uniform(-1, 2, (300, 3))
    points = spark.createDataFrame([(0, *r) for r in x.tolist()], "frame_id long, x double, y double, z double").withColumn("gx", F.lit("mine"))
    for r in A.slope_errors(points, programs, 0.05).collect():
        assert np.allclose([r.gx, r.gy, r.gz], [r.dx, r.dy, r.dz], atol=1e-4)


@pytest.mark.parametrize("pruning", sorted(bundles.PRUNINGS))
def test_octree_tables(spark, pruning):
    frames = {i: NAMED[n] for i, n in enumerate(sorted(NAMED)) if n != "far"}
    v = voxel_frames(spark, frames)
    t = bundles.octree_tables(v, boundary.patches(boundary.exposed_faces(v)), H, pruning)
    rows = {r["frame_id"]: r for r in t["metrics"].collect()}
    assert set(rows) == set(frames) and all(r["ok"] for r in rows.values())
    if pruning == "none":
        assert all(rows[f]["cells"] == len(keys) for f, keys in frames.items())
    assert t["samples"].where((F.col("q") <= 0) != (F.col("exported") <= 0)).count() == 0


@pytest.mark.parametrize("most", [1, 10_000])
def test_sweep_tables(spark, most):
    """Frames within the limits are prisms, those beyond obstacles; both say what the voxels say."""
    frames = {i: NAMED[n] for i, n in enumerate(sorted(NAMED))}
    v = voxel_frames(spark, frames)
    faces = boundary.exposed_faces(v)
    t = bundles.sweep_tables(v, boundary.patches(faces), boundary.supports(faces), H, limits=sweep.Limits(cells=most))
    rows = {r["frame_id"]: r for r in t["metrics"].collect()}
    assert set(rows) == set(frames) and all(r["ok"] and r["candidates"] == 3 for r in rows.values())
    single = rows[sorted(NAMED).index("single")]
    assert single["fallback"] is False and all((r["obstacles"] > 0) == r["fallback"] for r in rows.values())
    assert any(r["fallback"] for r in rows.values()) == (most == 1)


def six(at, first):
    """A cube at a corner as six tetrahedra, vertices numbered by place."""
    name = lambda i: sum((c + (i >> a & 1)) * 10**a for a, c in enumerate(at))
    return [(0, first + k, [name(0), name(a), name(a | b), name(7)]) for k, (a, b) in enumerate([(1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2)])]


@pytest.fixture
def ell(spark):
    tets = [t for i, at in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0)]) for t in six(at, 6 * i)]
    names = sorted({v for t in tets for v in t[2]})
    v = spark.createDataFrame([(0, n, float(n % 10), float(n // 10 % 10), float(n // 100)) for n in names], "frame_id long, vertex_id long, x double, y double, z double")
    return v, spark.createDataFrame(tets, "frame_id long, tet_id long, v array<long>")


def inside_ell(x):
    return 0 < x[2] < 1 and ((0 < x[0] < 2 and 0 < x[1] < 1) or (0 < x[0] < 1 and 0 < x[1] < 2))


def test_tet_tables(spark, ell):
    v, t = ell
    probes = bundles.random_points(v, 300).unionByName(spark.createDataFrame([(0, 900, 1.0, 0.5, 0.5), (0, 901, 2.0, 0.5, 0.5), (0, 901, 2.0, 0.5, 0.5)], "frame_id long, point_id long, x double, y double, z double"))
    made = bundles.tet_tables(v, t, probes)
    m = made["metrics"].first()
    want = sum(inside_ell((r.x, r.y, r.z)) for r in probes.collect())
    assert (m["bounded"], m["boundary"], m["samples"]) == (want, 2, 303) and m["ok"]
    assert m["tets"] == 18 and m["surface_faces"] == 28 and m["surface_volume"] == pytest.approx(3) and m["mesh_volume"] == pytest.approx(3) and m["mesh_parts"] < 18
    text = json.loads(made["trees"].first()["json"])
    assert len(text["leaves"]) <= m["planes"]


def test_tet_tables_reduced(spark, ell):
    """Planes of wide angles add to clusters, never miss; a probe set over added space says so, and only then it is allowed."""
    v, t = ell
    probes = bundles.random_points(v, 300)
    m = bundles.tet_tables(v, t, probes, angle=1.2)["metrics"].first()
    assert m["added"] > 0 and m["missed"] == 0 and m["tets_differ"] == m["clusters_differ"] == 0 and m["ok"]


def test_tet_tables_empty(spark, ell):
    v, t = ell
    made = bundles.tet_tables(v.where("false"), t.where("false"), bundles.random_points(v, 5))
    assert all(x.count() == 0 for x in made.values())
