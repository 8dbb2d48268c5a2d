"""Points against sides of frames: both ways of meeting, near shapes only, and clearances by plain Python."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfield.operators import arrangement, boundary, meet, meshes, octree, robot, sweep, voxels
from clearfield.sources import exports, points
from clearfield.streaming import frames


def points_of(spark, n, n_frames=3, seed=1):
    r = random.Random(seed)
    rows = [(k % n_frames, k, *(r.uniform(-1, 1) for _ in "xyz"), f"name{k}") for k in range(n)]
    return spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double, q string"), rows


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(meet, "SALT_POINTS", 100)
    monkeypatch.setattr(meet, "TOGETHER", 64)
    df, rows = points_of(spark, 1500)
    sides = spark.createDataFrame([(0, bytearray(np.array([2.0]).tobytes())), (2, bytearray(np.array([5.0]).tobytes()))], "frame_id long, side binary")
    got = meet.meet(df.repartition(3), sides, np.frombuffer, lambda p, s: {"q": p["x"].to_numpy() * s[0]}, "q double", most_broadcast=most)
    assert got.columns == ["frame_id", "point_id", "x", "y", "z", "q"]
    want = {r[1]: r[2] * (2.0 if r[0] == 0 else 5.0) for r in rows if r[0] != 1}
    assert {r.point_id: r.q for r in got.collect()} == want
    assert meet.meet(df.limit(0), sides, np.frombuffer, lambda p, s: {"q": p["x"].to_numpy()}, "q double", most_broadcast=most).count() == 0


def test_near_shapes_only():
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (700, 3))
    lo = rng.uniform(-2, 2, (900, 3))
    hi = lo + rng.uniform(0, 0.3, (900, 3))
    want = np.maximum(lo[None] - x[:, None], x[:, None] - hi[None]).max(axis=2).min(axis=1)
    assert (meet.box_values(x, lo, hi) == want).all()
    assert np.isinf(meet.box_values(x, lo[:0], hi[:0])).all() and len(meet.box_values(x[:0], lo, hi)) == 0


def test_union_values_and_distance_by_brute_force(spark):
    df, rows = points_of(spark, 300, 2)
    boxes = [(f, *lo, *w) for f in range(2) for lo in ((f, 0, -2), (-3, 1, 1), (2, 2, f)) for w in ((1 + f, 2, 1),)]
    cells = spark.createDataFrame(boxes, "frame_id long, lox long, loy long, loz long, wx long, wy long, wz long")
    got = {r.point_id: r.q for r in octree.union_values(df, cells, 0.2).collect()}
    for f, k, *p, _ in rows:
        want = min(max(max(b[1 + i] * 0.2 - p[i], p[i] - (b[1 + i] + b[4 + i]) * 0.2) for i in range(3)) for b in boxes if b[0] == f)
        assert got[k] == want


def in_tet(p, corners):
    def volume(a, b, c, d):
        return float(np.dot(np.cross(np.subtract(b, a), np.subtract(c, a)), np.subtract(d, a)))

    whole = volume(*corners)
    return all(volume(*[p if i == k else c for k, c in enumerate(corners)]) * whole >= 0 for i in range(4))


def test_points_in_tets_by_signed_volumes(spark):
    df, rows = points_of(spark, 200, 2)
    r = random.Random(4)
    corners = {(f, i): [r.uniform(-1.5, 1.5) for _ in "xyz"] for f in range(2) for i in range(6)}
    tets = [(f, t, r.sample(range(6), 4)) for f in range(2) for t in range(5)]
    v = spark.createDataFrame([(f, i, *p) for (f, i), p in corners.items()], "frame_id long, vertex_id long, x double, y double, z double")
    t = spark.createDataFrame(tets, "frame_id long, tet_id long, v array<long>")
    got = {x.point_id: x.tets for x in meshes.points_in_tets(df, v, t).collect()}
    assert got == {k: sum(in_tet(p, [corners[f, i] for i in vs]) for g, _, vs in tets if g == f) for f, k, *p, _ in rows}


# ---------------------------------------------------------------- functions and clearances, written out again


def naive(cells, lo, hi):
    """Nested tuples of the direct function: the same rules by counting cells one by one."""
    inside = [c for c in cells if all(lo[k] <= c[k] < hi[k] for k in range(3))]
    volume = math.prod(hi[k] - lo[k] for k in range(3))
    if len(inside) in (0, volume):
        return "FREE" if not inside else "FULL"
    options = []
    for axis in range(3):
        for cut in range(lo[axis] + 1, hi[axis]):
            halves = [([*lo], [*hi]), ([*lo], [*hi])]
            halves[0][1][axis] = halves[1][0][axis] = cut
            sizes = [math.prod(b[k] - a[k] for k in range(3)) for a, b in halves]
            held = [sum(all(a[k] <= c[k] < b[k] for k in range(3)) for c in inside) for a, b in halves]
            options.append((sum(0 < n < s for n, s in zip(held, sizes, strict=True)), max(sizes), axis, cut))
    _, _, axis, cut = min(options)
    middle = list(hi)
    middle[axis] = cut
    other = list(lo)
    other[axis] = cut
    return join(axis, cut - 1, naive(cells, lo, middle), naive(cells, other, hi))


def join(axis, plane, low, high):
    up, down = ("LEAF", axis, plane, 1), ("LEAF", axis, plane, -1)
    if isinstance(low, str) and isinstance(high, str):
        return up if low == "FREE" else down
    if low == "FREE":
        return ("MIN", up, high)
    if low == "FULL":
        return ("MAX", high, down)
    if high == "FREE":
        return ("MIN", low, down)
    if high == "FULL":
        return ("MAX", low, up)
    return ("MAX", ("MIN", low, high), ("MIN", low, down), ("MIN", up, high))


def smooth(tree, p, planes, h, beta):
    """Value and gradient of the smoothed function at one point."""
    if tree[0] == "LEAF":
        _, axis, plane, sign = tree
        return sign * (p[axis] - planes[axis][plane] * h), [sign * (k == axis) for k in range(3)]
    terms = [smooth(t, p, planes, h, beta) for t in tree[1:]]
    sign = 1 if tree[0] == "MAX" else -1
    top = max(sign * v for v, _ in terms)
    w = [math.exp(beta * (sign * v - top)) for v, _ in terms]
    total = sum(w)
    value = sign * (top + math.log(total if tree[0] == "MAX" else total / len(terms)) / beta)
    return value, [sum(x * g[k] for x, (_, g) in zip(w, terms, strict=True)) / total for k in range(3)]


def weight(tree):
    return 0.0 if tree[0] == "LEAF" else max(map(weight, tree[1:])) + math.log(len(tree) - 1)


def size(tree):
    return 1 if tree[0] == "LEAF" else 1 + sum(map(size, tree[1:]))


def shape(spark, keys):
    v = spark.createDataFrame([(0, *k) for k in keys], "frame_id long, ix long, iy long, iz long")
    coords = boundary.coordinates(boundary.supports(boundary.exposed_faces(v)))
    return boundary.cells(v, coords), coords


def test_clearances_by_plain_python(spark):
    """Every step again for one frame: the function, its smoothing and gradient, the arm's groups."""
    from test_arm_poses import centres

    h, error = 0.1, 1e-2
    keys = sorted({(3, 0, 1), (3, 1, 1), (4, 1, 2), (4, 2, 2), (3, 1, 3), (-3, 2, 2), (-3, 2, 3), (0, 5, 2), (1, 5, 2), (0, 5, 3)})
    cells, coords = shape(spark, keys)
    planes = [list(coords.first()[f"p{c}"]) for c in "xyz"]
    occupied = {tuple(sum(c <= k[a] for c in planes[a]) for a in range(3)) for k in keys}
    tree = naive(occupied, [0, 0, 0], [len(c) + 1 for c in planes])
    programs = arrangement.build_programs(cells, coords, h, intern=False)
    row = programs.first()
    assert row.expanded == size(tree)
    beta = weight(tree) / error
    model = robot.parse_urdf(robot.DEMO_URDF)
    configs = [[0.1 * k, 0.05 * k - 0.2, 0.3 - 0.2 * k] for k in range(6)]
    poses = robot.sphere_poses(spark.createDataFrame(list(enumerate(configs)), "config_id long, q array<double>"), model)
    got = {(r.config_id, r.joint): r for r in robot.group_clearances(robot.field_at(poses, coords, programs, error), model, margin=0.02, error=error).collect()}
    radii = [s.radius for s in model.spheres]
    alpha = math.log(3) / error
    for c, q in enumerate(configs):
        at = centres(*q)
        slopes = [(centres(*(np.add(q, d))) - centres(*(np.subtract(q, d)))) / 2e-6 for d in np.eye(3) * 1e-6]
        for joint, members in (("turn", [1, 2, 3]), ("lift", [4]), ("swing", [5, 6])):
            r, each = got[c, joint], []
            for i in members:
                value, gradient = smooth(tree, at[i], planes, h, beta)
                each.append((-value - radii[i] - 0.02, i, [-sum(gradient[a] * slopes[k][i][a] for a in range(3)) for k in range(3)]))
            low = min(each)
            w = [math.exp(-alpha * (e[0] - low[0])) for e in each]
            assert r.distance == pytest.approx(low[0] - math.log(sum(w)) / alpha, abs=1e-9)
            assert (r.hard_min, r.nearest_sphere, r.spheres) == (pytest.approx(low[0], abs=1e-9), low[1], len(members))
            assert list(r.gradient) == pytest.approx([sum(x * e[2][k] for x, e in zip(w, each, strict=True)) / sum(w) for k in range(3)], abs=1e-6)
    assert len(got) == 18
    held = robot.sphere_clearances(robot.field_at(poses, coords, programs, error), model).where("sphere_id = 0").collect()
    assert len(held) == 6 and all(r.joint is None and r.clearance is not None for r in held)


def test_program_sizes_by_plain_python(spark):
    r = random.Random(3)
    rows = [(f, *k) for f in range(8) for k in {tuple(r.randrange(4) for _ in range(3)) for _ in range(3 + 4 * f)}]
    v = spark.createDataFrame(rows, "frame_id long, ix long, iy long, iz long")
    coords = boundary.coordinates(boundary.supports(boundary.exposed_faces(v)))
    built = {p.frame_id: p for p in arrangement.build_programs(boundary.cells(v, coords), coords, 0.1, certify=True).collect()}
    for c in coords.collect():
        planes = [list(c[f"p{a}"]) for a in "xyz"]
        occupied = {tuple(sum(x <= k[a] for x in planes[a]) for a in range(3)) for f, *k in rows if f == c.frame_id}
        tree = naive(occupied, [0, 0, 0], [len(p) + 1 for p in planes])
        distinct = set()

        def walk(t):
            distinct.add(t)
            for child in t[1:] if t[0] != "LEAF" else ():
                walk(child)

        walk(tree)
        p = built[c.frame_id]
        assert (p.expanded, p.shared, p.mismatches) == (size(tree), len(distinct), 0)


# ---------------------------------------------------------------- clouds and streams


def test_clouds(spark, tmp_path):
    df, rows = points_of(spark, 50, 2)
    for kind in ("ply", "off", "xyz"):
        exports.write_clouds(df, f"file://{tmp_path}/{kind}", kind)
        back = points.read_cloud(spark, f"file://{tmp_path}/{kind}", kind).collect()
        assert sorted((r.x, r.y, r.z) for r in back) == sorted(tuple(r[2:5]) for r in rows) and len({r.frame_id for r in back}) == 2
    (tmp_path / "p.ply").write_text("ply\nformat ascii 1.0\nelement face 1\nproperty list uchar int v\nelement vertex 2\nproperty float z\nproperty float nx\nproperty float x\nproperty float y\nend_header\n3 0 0 0\n3 9 1 2\n6 9 4 5\nrest\n")
    got = sorted((r.point_id, r.x, r.y, r.z) for r in points.read_cloud(spark, f"file://{tmp_path}/p.ply", "ply").collect())
    assert got == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0)]
    (tmp_path / "o.off").write_text("# a cloud\nOFF 2 0 0\n\n1 2 3 # one\n4 5 6\n")
    assert [(r.x, r.y, r.z) for r in points.read_cloud(spark, f"file://{tmp_path}/o.off", "off").orderBy("point_id").collect()] == [(1, 2, 3), (4, 5, 6)]


@pytest.mark.parametrize(
    ("kind", "text"),
    [("ply", "plx\n"), ("ply", "ply\nformat ascii 1.0\nelement vertex 3\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n"), ("ply", "ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n"), ("off", "OFF\n"), ("off", "OFF\n2 0 0\n1 2 3\n"), ("off", "OFF\n1 0 0\n1 2 nan\n"), ("off", "OFF\n1 0 0\n1 2\n"), ("xyz", "1 2 3 4\n")],
)
def test_bad_clouds(spark, tmp_path, kind, text):
    (tmp_path / f"bad.{kind}").write_text(text)
    with pytest.raises(Exception):  # noqa: B017
        points.read_cloud(spark, f"file://{tmp_path}/bad.{kind}", kind).collect()


def test_long_files_are_numbered_across_splits(spark, tmp_path):
    n = 20_000
    (tmp_path / "long.xyz").write_text("".join(f"{i} 0.5 {-i}\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        got = points.read_xyz(spark, f"file://{tmp_path}/long.xyz").agg(F.count("*"), F.max("point_id"), F.count_if(F.col("x") == F.col("point_id"))).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert tuple(got) == (n, n - 1, n)


def test_streams_keep_the_last_sets(spark, tmp_path):
    """a a b a c b a, with room for one, two and three snapshots."""
    sets = {"a": [(0.05, 0.05, 0.05)], "b": [(0.15, 0.05, 0.05)], "c": [(0.25, 0.05, 0.05), (0.05, 0.05, 0.05)]}
    order = "aabacba"
    want = {1: [0, 1, 0, 0, 0, 0, 0], 2: [0, 1, 0, 1, 0, 0, 0], 3: [0, 1, 0, 1, 0, 1, 1]}
    rows = [("s", k, i, *p) for k, name in enumerate(order) for i, p in enumerate(sets[name])]
    df = spark.createDataFrame(rows, "sensor_id string, frame_id long, point_id long, x double, y double, z double")
    for capacity, hits in want.items():
        batch = frames.reuse_pattern(df, 0.1, capacity).orderBy("frame_id").collect()
        assert [int(r.hit) for r in batch] == hits
        stream = frames.run_recorded(df, 0.1, f"file://{tmp_path}/{capacity}", capacity).orderBy("frame_id").collect()
        assert [int(r.hit) for r in stream] == hits and all(r.certified and r.outside == 0 for r in stream)


def test_merging_stops_when_nothing_merges(spark):
    r = random.Random(9)
    keys = sorted({tuple(r.randrange(6) for _ in range(3)) for _ in range(60)})
    _, coords = shape(spark, keys)
    v = spark.createDataFrame([(0, *k) for k in keys], "frame_id long, ix long, iy long, iz long")
    patched = boundary.patches(boundary.exposed_faces(v))
    b = voxels.bounds(v).first()
    room = math.prod(b[f"max_{a}"] - b[f"min_{a}"] + 1 for a in ("ix", "iy", "iz")) - len(keys)
    for axis in range(3):
        boxes = sweep.free_prisms(patched, coords, axis)
        assert boxes.agg(F.sum(F.expr("(hix - lox) * (hiy - loy) * (hiz - loz)"))).first()[0] == room
        again = boxes
        for k in range(3):
            again = boundary.merge_boxes(again, k)
        assert again.count() == boxes.count()


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_lists_and_names_of_points_pass_by(spark, most):
    """Lists stay as Arrow has them, whatever points' columns are called; frames without a side go, points without a number stay null."""
    from clearfield.operators import meet as module

    rows = [(f, i, float(i) if i % 5 else None, [float(f), None, float(i)], f"{f}:{i}", bytes([i % 7])) for f in range(7) for i in range(40 * f)]
    points = spark.createDataFrame(rows, "frame_id long, n long, x double, jac array<double>, side string, raw binary").repartition(5)
    sides = module.packed(spark.createDataFrame([(f, float(f * k)) for f in range(6) for k in range(f)], "frame_id int, v double"), ["v"])
    df = module.meet(points, sides, module.unpacked(1), lambda p, s: {"total": p["x"].to_numpy() + s.sum(), "m": np.full(len(p), len(s))}, "total double, m int", most)
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString() and df.columns == [*points.columns, "total", "m"]
    want = {(*r[:3], tuple(r[3]), *r[4:], None if r[2] is None else r[2] + sum(r[0] * k for k in range(r[0])), r[0]) for r in rows if 0 < r[0] < 6}
    got = [(r.frame_id, r.n, r.x, tuple(r.jac), r.side, bytes(r.raw), r.total, r.m) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want


def test_poses_are_worked_out_before_they_meet_frames(spark):
    """A task of the field runs one Python worker: the poses it reads are written, not made by another worker beside it."""
    _, coords = shape(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0)])
    cells, _ = shape(spark, [(0, 0, 0), (1, 0, 0), (1, 1, 0)])
    model = robot.parse_urdf(robot.DEMO_URDF)
    poses = robot.sphere_poses(spark.range(40).select(F.col("id").alias("config_id"), F.array(F.col("id") / 10.0, F.lit(0.1), F.lit(0.2)).alias("q")), model)
    field = robot.field_at(poses, coords, arrangement.build_programs(cells, coords, 0.1))
    plan = field._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "MapInPandas" not in plan and "FlatMapGroupsInPandas" not in plan
    want = {(r.config_id, r.sphere_id): (r.x, r.y, r.z, *r.jac) for r in poses.collect()}
    assert {(r.config_id, r.sphere_id): (r.x, r.y, r.z, *r.jac) for r in field.collect()} == want and field.count() == 40 * len(model.spheres)


@pytest.mark.parametrize(("frames_", "each", "wide"), [(40, 100, 4096), (3000, 2, 8)])
def test_points_held_back_are_bounded_by_bytes(spark, monkeypatch, frames_, each, wide):
    """Wide points, and many parts of few points, are worked on before a task holds more than HELD_BYTES of them."""
    monkeypatch.setattr(meet, "HELD_BYTES", 1 << 20)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        points = spark.range(0, frames_ * each, 1, 1).select((F.col("id") % frames_).alias("frame_id"), F.col("id").alias("n"), F.repeat(F.lit("x"), wide).alias("text"))
        sides = spark.createDataFrame([(f, bytearray(b"s")) for f in range(frames_)], "frame_id long, side binary")
        got = meet.meet(points, sides, len, lambda p, s: {"together": np.full(len(p), len(p)), "twice": 2 * p["n"].to_numpy()}, "together long, twice long").select("n", "together", "twice", F.length("text").alias("wide")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {(r.n, r.twice, r.wide) for r in got} == {(n, 2 * n, wide) for n in range(frames_ * each)} and len(got) == frames_ * each
    assert max(r.together for r in got) < each  # before, all points of a frame waited for the last


def test_documents_carry_the_surface_last(spark):
    """The patches of a frame meet its documents after groups have met spheres, so no sort of configurations holds them."""
    keys = [(0, 0, 0), (1, 0, 0), (1, 1, 0)]
    cells, coords = shape(spark, keys)
    v = spark.createDataFrame([(0, *k) for k in keys], "frame_id long, ix long, iy long, iz long")
    faces = boundary.exposed_faces(v)
    model = robot.parse_urdf(robot.DEMO_URDF)
    poses = robot.sphere_poses(spark.range(30).select(F.col("id").alias("config_id"), F.array(F.col("id") / 10.0, F.lit(0.1), F.lit(0.2)).alias("q")), model)
    field = robot.field_at(poses, coords, arrangement.build_programs(cells, coords, 0.1))
    found, spheres = robot.described_groups(robot.group_clearances(field, model), model), robot.described_spheres(field, model)
    surface = exports.surface_summary(v, faces, boundary.patches(faces), 0.1)
    documents = exports.clearance_documents(found, spheres, surface, None, {"voxel_size": 0.1})
    top = next(x for x in documents._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert "frame_id" in top and "config_id" not in top
    said = surface.select(F.to_json("surface", {"ignoreNullFields": "false"})).first()[0]
    read = [json.loads(r.value) for r in documents.collect()]
    assert sorted(d["config_id"] for d in read) == list(range(30)) and all(d["surface"] == json.loads(said) for d in read)
    assert all([s["id"] for s in d["spheres"]] == list(range(len(model.spheres))) and len(d["groups"]) == 3 for d in read)
    assert list(read[0]) == ["schema", "frame_id", "config_id", "options", "surface", "groups", "spheres"]
