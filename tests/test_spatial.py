import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfield.functions.geometry import union_volume, wilson
from clearfield.operators import boundary, meshes, octree, sweep, robot, voxels
from clearfield.sources import points as sources
from clearfield.sources import shapes
from clearfield.streaming import frames

POINT = "frame_id long, point_id long, x double, y double, z double"


def cloud(spark, xyz, frame=0):
    return spark.createDataFrame([(frame, i, *map(float, p)) for i, p in enumerate(xyz)], POINT)


def test_index_follows_the_rounded_planes(spark):
    for h in (0.1, 0.03, 0.02):
        values = [k * h for k in range(-400, 400)] + [math.nextafter(k * h, d) for k in range(-50, 50) for d in (-9e9, 9e9)]
        got = spark.createDataFrame([(v,) for v in values], "v double").select("v", voxels.voxel_index(F.col("v"), h).alias("i")).collect()
        assert all(r.i * h <= r.v < (r.i + 1) * h for r in got)
    for bad in (float("nan"), float("inf"), 1e20):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(bad,)], "v double").select(voxels.voxel_index(F.col("v"), 0.1)).collect()


def test_strict_xyz(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# cloud\n\n1 2 3 # last\n  -4e0\t5 6.5\r\n")
    got = {(r.x, r.y, r.z, r.point_id) for r in sources.read_xyz(spark, str(tmp_path / "a.xyz")).collect()}
    assert got == {(1.0, 2.0, 3.0, 2), (-4.0, 5.0, 6.5, 3)}
    for bad in ("1 2\n", "1 2 3 4\n", "1 2 x\n", "nan 1 2\n", "inf 1 2\n"):
        lines = spark.createDataFrame([(0, 0, bad)], "frame_id long, point_id long, raw string")
        with pytest.raises(Exception, match="bad XYZ line 1"):
            sources.parse_xyz(lines).collect()


def test_convex_l_and_a_point_on_a_corner(spark):
    p = cloud(spark, [(0.005, 0.005, 0.005), (0.015, 0.005, 0.005), (0.005, 0.015, 0.005)])
    v = voxels.voxelize(p, 0.01)
    assert {(r.ix, r.iy, r.iz) for r in v.collect()} == {(0, 0, 0), (1, 0, 0), (0, 1, 0)}
    b = voxels.bounds(v).first()
    assert (b.voxels, b.depth) == (3, 1)
    probes = cloud(spark, [(0.01, 0.01, 0.0), (0.0, 0.0, 0.0), (0.011, 0.011, 0.005), (0.005, 0.005, 0.005), (0.02, 0.005, 0.01)])
    assert [r.inside for r in voxels.contains(probes, v, 0.01).orderBy("point_id").collect()] == [True, True, False, True, True]
    assert [r.sign for r in voxels.closed_sign(probes, v, 0.01).orderBy("point_id").collect()] == [0, 0, -1, 1, 0]


@pytest.mark.parametrize("seed", range(3))
def test_boundary_octree_and_prisms_of_random_sets(spark, seed):
    r = random.Random(seed)
    keys = [(i, j, k) for i in range(5) for j in range(5) for k in range(5) if r.random() < 0.6]
    v = spark.createDataFrame([(0, *k) for k in keys], "frame_id long, ix long, iy long, iz long")
    faces = boundary.exposed_faces(v)
    want = sum((a + dx, b + dy, c + dz) not in set(keys) for a, b, c in keys for dx, dy, dz in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))
    assert faces.count() == want and boundary.patches(faces).agg(F.sum("faces")).first()[0] == want
    coords = boundary.coordinates(boundary.supports(faces))
    cells = boundary.cells(v, coords)
    assert cells.where("not full").count() == 0 and cells.agg(F.sum("voxels")).first()[0] == len(keys)
    spans = [max(k[a] for k in keys) - min(k[a] for k in keys) + 1 for a in range(3)]
    for axis in range(3):
        prisms = sweep.free_prisms(boundary.patches(faces), coords, axis).collect()
        held = {(x, y, z) for p in prisms for x in range(p.lox, p.hix) for y in range(p.loy, p.hiy) for z in range(p.loz, p.hiz)}
        size = sum((p.hix - p.lox) * (p.hiy - p.loy) * (p.hiz - p.loz) for p in prisms)
        assert size == len(held) == math.prod(spans) - len(keys) and not held & set(keys)
    bad = octree.partition_violations(octree.rectangular_cells(v), v).first()
    assert (bad.uncovered, bad.overlapping, bad.outside) == (0, 0, 0)
    assert octree.rectangular_cells(v).count() <= octree.exact_cut(v).count() <= len(keys)


def test_sibling_covers_are_exact_and_small():
    covers = octree.sibling_covers()
    for mask in range(256):
        cells = [4 * i + 2 * j + k for x, y, z, a, b, c in covers[mask] for i in range(x, x + a) for j in range(y, y + b) for k in range(z, z + c)]
        assert len(cells) == len(set(cells)) and sum(1 << c for c in cells) == mask
    assert len(covers[255]) == 1 and len(covers[0b10000001]) == 2 and max(map(len, covers)) == 4


def test_kinematics_closed_form():
    model = robot.parse_urdf(
        """<robot name="r"><link name="base"><collision><geometry><sphere radius="0.1"/></geometry></collision></link>
        <link name="one"><collision><origin xyz="1 0 0"/><geometry><sphere radius="0.1"/></geometry></collision></link>
        <link name="two"><collision><origin xyz="0 0 1"/><geometry><sphere radius="0.2"/></geometry></collision></link>
        <joint name="a" type="revolute"><parent link="base"/><child link="one"/><origin xyz="0 0 1"/><axis xyz="0 0 2"/></joint>
        <joint name="b" type="prismatic"><parent link="one"/><child link="two"/><origin xyz="1 0 0"/><axis xyz="1 0 0"/></joint></robot>"""
    )
    q = np.array([[math.pi / 2, 0.25]])
    c, j = robot.kinematics(model, q)
    assert np.allclose(c[0], [[0, 0, 0], [0, 1, 1], [0, 1.25, 2]])
    assert j[0, 1, 0, 0] == pytest.approx(-1) and j[0, 2, 0, 0] == pytest.approx(-1.25) and j[0, 2, 1, 1] == pytest.approx(1) and not j[0, 0].any()
    assert [(n, s) for n, s in robot.groups(model)] == [("a", [1]), ("b", [2])]
    arm = robot.parse_urdf(robot.DEMO_URDF)
    x = np.random.default_rng(1).uniform(-1, 1, (5, 3))
    _, jac = robot.kinematics(arm, x)
    for k in range(3):
        d = np.zeros(3)
        d[k] = 1e-6
        assert np.allclose(jac[..., k], (robot.kinematics(arm, x + d)[0] - robot.kinematics(arm, x - d)[0]) / 2e-6, atol=1e-7)


@pytest.mark.parametrize(
    "change",
    [('type="revolute"', 'type="planar"'), ('<child link="column"/>', '<child link="none"/>'), ('<sphere radius="0.05"/>', '<box size="1 1 1"/>'), ('radius="0.05"', 'radius="-1"'), ('<axis xyz="0 1 0"/>', '<axis xyz="0 0 0"/>'), ('<child link="tool"/>', '<child link="plate"/>'), ('<axis xyz="0 1 0"/>', '<mimic joint="turn"/>')],
)
def test_bad_models_are_refused(change):
    with pytest.raises(ValueError):
        robot.parse_urdf(robot.DEMO_URDF.replace(*change))


def test_link_gradients_by_differences(spark):
    """The distance to a set that fills a half space, through the whole chain, against finite differences."""
    from clearfield.operators import arrangement

    h = 0.1
    keys = [(i, j, k) for i in range(3, 6) for j in range(-6, 6) for k in range(-2, 8)]
    v = spark.createDataFrame([(0, *k) for k in keys], "frame_id long, ix long, iy long, iz long")
    coords = boundary.coordinates(boundary.supports(boundary.exposed_faces(v)))
    programs = arrangement.build_programs(boundary.cells(v, coords), coords, h, certify=True).cache()
    assert programs.first().mismatches == 0
    model = robot.parse_urdf(robot.DEMO_URDF)
    step, base = 1e-5, [0.3, 0.05, -0.4]
    configs = [base] + [[b + s * step * (k == i) for i, b in enumerate(base)] for k in range(3) for s in (1, -1)]
    poses = robot.sphere_poses(spark.createDataFrame(list(enumerate(configs)), "config_id long, q array<double>"), model)
    field = robot.field_at(poses, coords, programs, 0.01)
    got = {(r.config_id, r.joint): r for r in robot.group_clearances(field, model, margin=0.01, error=0.01).collect()}
    for name, _ in robot.groups(model):
        r = got[0, name]
        assert 0 <= r.hard_min - r.distance <= r.bound + 1e-12
        for k in range(3):
            numeric = (got[1 + 2 * k, name].distance - got[2 + 2 * k, name].distance) / (2 * step)
            assert r.gradient[k] == pytest.approx(numeric, abs=1e-4)


def test_meshes(spark):
    from clearfield.plans.registry import _prism

    v, f = _prism(spark)
    one = meshes.volume(v, f).first()
    assert one.volume == pytest.approx(3) and one.area == pytest.approx(14)
    c = meshes.closed(f).first()
    assert c.open_edges == 0 and c.edges == f.count() * 3 // 2
    assert meshes.closed(f.where("face_id > 0")).first().open_edges == 3
    for bad in ("PLY\n", "OFF\n1 1 0\n0 0 0\n3 0 1 2\n"):
        with pytest.raises(ValueError):
            meshes.parse_off(spark, bad)


def test_camera_and_generators(spark):
    seen = shapes.depth_camera(spark, noise=0.0, dropout=0.0, quantum=1e-6)
    off = F.abs(F.pow(F.col("x") / 0.18, 2) + F.pow(F.col("y") / 0.13, 2) + F.pow((F.col("z") - 0.75) / 0.24, 2) - 1)
    assert seen.agg(F.max(off)).first()[0] < 1e-3 and seen.select("frame_id").distinct().count() == 10
    assert shapes.depth_camera(spark).count() < 0.95 * seen.count()
    p = shapes.torus_surface(spark, 500, 0.3, 0.1)
    moved = shapes.jitter_within_voxels(p, 0.05)
    a, b = (voxels.voxelize(x, 0.05) for x in (p, moved))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    gone = a.orderBy("ix", "iy", "iz").limit(3)
    assert voxels.voxelize(shapes.without_voxels(p, gone, 0.05), 0.05).count() == a.count() - 3
    dense, sparse = shapes.ellipsoid_surface(spark, 800, (0, 0, 0), (1, 1, 1)), shapes.ellipsoid_surface(spark, 100, (0, 0, 0), (1, 1, 1))
    assert voxels.voxelize(sparse, 0.2).exceptAll(voxels.voxelize(dense, 0.2)).count() == 0
    assert shapes.box_surface(spark, 50, (0, 0, 0), (1, 2, 3)).count() == 50 and shapes.plane_patch(spark, 10, 1, 1, 0.5).agg(F.max("z")).first()[0] == 0.5


def test_small_statistics(spark):
    low, high = wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (0, 10), (5, 10)], "k long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert (got[0].l, got[0].h) == (0.0, 1.0) and got[1].l == 0.0 and got[2].l + got[2].h == pytest.approx(1)
    assert union_volume([((0, 0, 0), (2, 2, 2)), ((1, 1, 1), (3, 3, 3))]) == pytest.approx(15)
    assert voxels.reservoir(cloud(spark, [(0.1 + i * 1e-4, 0.1, 0.1) for i in range(100)]), 1.0, 7, 1).count() == 7


def test_stream_reuses_equal_frames(spark, tmp_path):
    h = 0.1
    base = [(0.03, 0.04, 0.05), (0.17, 0.02, 0.01), (0.12, 0.11, 0.09)]
    inside = [tuple(c + 0.25 * ((math.floor(c / h) + 0.5) * h - c) for c in p) for p in base]
    listed = [base, inside, base + inside, [*base, (0.55, 0.5, 0.5)]]
    schema = "sensor_id string, frame_id long, xyz array<double>"
    for k, f in enumerate(listed):
        spark.createDataFrame([("s", k, [c for p in f for c in p])], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).json(str(tmp_path / "in"))
    query = frames.stream_frames(stream, h).writeStream.format("memory").queryName("reuse").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.sql("select * from reuse order by frame_id").collect()
    assert len(got) == 4 and [r.hit for r in got] == [False, True, True, False]
    assert all(r.certified and r.outside == 0 for r in got) and [r.voxels for r in got] == [3, 3, 3, 4]


def test_neighbours_across_faces_that_one_two_or_more_use(spark):
    from clearfield.operators import meshes

    tets = {0: [0, 1, 2, 3], 5: [1, 2, 3, 4], 7: [3, 2, 1, 9], 9: [9, 3, 2, 8], 11: [20, 20, 21, 22]}
    df = spark.createDataFrame([(t, v) for t, v in tets.items()], "tet_id long, v array<long>")
    found = meshes.tet_neighbours(df)
    want = {}
    for t, v in tets.items():
        want[t] = []
        for k in range(4):
            face = sorted(v[:k] + v[k + 1 :])
            users = [o for o, w in tets.items() for i in range(4) if sorted(w[:i] + w[i + 1 :]) == face]
            lo, hi = min(users), max(users)
            want[t].append(-1 if lo == hi else hi if t == lo else lo)
    assert {r.tet_id: r.nbr for r in found.collect()} == want and {r.tet_id: r.v for r in found.collect()} == tets
    # Tetrahedra of one file are dealt out before their faces are listed, and faces are hashed as numbers.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and "collect_list" not in plan
