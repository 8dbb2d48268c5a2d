import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfield.operators import arrangement, audit, boundary, clusters, trees
from clearfield.sources import exports
from clearfield.sources import points as sources

VOXEL = "frame_id long, ix long, iy long, iz long"


def random_tree(r, level=0):
    if level > 3 or r.random() < 0.3:
        return r.randrange(6)
    return (r.choice(["MIN", "MAX"]), *(random_tree(r, level + 1) for _ in range(r.randrange(1, 4))))


PLANES = [tuple(float(x) for x in np.random.default_rng(k).normal(size=4)) for k in range(6)]


def test_simplifying_keeps_values():
    r, x = random.Random(3), np.random.default_rng(0).normal(size=(50, 3))
    for _ in range(200):
        t = random_tree(r)
        s = trees.simplify(t)
        assert (trees.values(s, PLANES, x) == trees.values(t, PLANES, x)).all()
        assert trees.simplify(s) == s and trees.leaf_references(s) <= trees.leaf_references(t) and trees.depth(s) <= trees.depth(t)
        back, planes = trees.from_json(trees.to_json(t, PLANES))
        assert trees.structural_key(back) == trees.structural_key(t) and planes == PLANES


def test_text_forms():
    t = ("MIN", 0, ("MAX", 1, 2))
    assert trees.boolean_text(t) == "(H0 | (H1 & H2))" and trees.scalar_text(t) == "min(h0(p), max(h1(p), h2(p)))"
    assert trees.dot_text(t).count("->") == 4
    assert trees.simplify(("MIN", ("MIN", 2, 1), 1, ("MIN", 2))) == ("MIN", 1, 2) and trees.simplify(("MAX", ("MAX", 3))) == 3


@pytest.mark.parametrize(
    "rows",
    [[], [(0, "LEAF", 0, []), (0, "LEAF", 1, [])], [(0, "MIN", -1, [1])], [(0, "MIN", -1, [0])], [(0, "LEAF", 0, []), (1, "LEAF", 1, [])], [(0, "XOR", -1, [0])], [(0, "MIN", -1, [])]],
)
def test_broken_trees_are_refused(rows):
    with pytest.raises(ValueError):
        trees.restore(rows)


def test_plane_dedupe_takes_the_first_match(spark):
    rows = [(0, 0, 1.0, 0.0, 0.0, 1.0), (0, 1, 1.0, 0.0, 0.0, 1.04), (0, 2, 1.0, 0.0, 0.0, 1.08), (0, 3, 0.0, 1.0, 0.0, 1.0), (0, 4, -1.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "frame_id long, plane_id long, nx double, ny double, nz double, offset double")
    assert [r.leaf_id for r in trees.dedupe_planes(df, 0.05).orderBy("plane_id").collect()] == [0, 0, 1, 2, 3]


@pytest.fixture(scope="module")
def cavity(spark):
    keys = [k for k in itertools.product(range(3), repeat=3) if k != (1, 1, 1)]
    v = spark.createDataFrame([(0, *k) for k in keys], VOXEL)
    faces = boundary.exposed_faces(v)
    coords = boundary.coordinates(boundary.supports(faces))
    return v, faces, arrangement.build_programs(boundary.cells(v, coords), coords, 0.1)


def test_outlines(cavity):
    _, faces, _ = cavity
    loops = audit.contours(faces).collect()
    assert sorted((r.corners, r.area) for r in loops) == [(4, 1.0)] * 6 + [(4, 9.0)] * 6


def test_outlines_with_holes_and_touching_corners(spark):
    cells = [(u, v) for u in range(3) for v in range(3) if (u, v) != (1, 1)] + [(3, 3)]
    df = spark.createDataFrame([(0, 2, 1, 5, u, v) for u, v in cells], "frame_id long, axis int, sign int, plane long, u long, v long")
    assert sorted((r.corners, r.area) for r in audit.contours(df).collect()) == [(4, -1.0), (4, 1.0), (4, 9.0)]


def test_zero_set_lies_on_planes(cavity):
    _, _, programs = cavity
    z = audit.zero_cells(programs, (-0.07, -0.07, -0.07), 0.05, (9, 9, 9)).collect()
    assert z and all(min(abs(r.zero - k * 0.1) for k in range(4)) < 1e-9 for r in z)


def test_hulls_are_exact():
    cube = list(itertools.product((0, 2), repeat=3))
    assert clusters.hull_planes([*cube, (1, 1, 1), (1, 0, 0)]) == sorted([(-1, 0, 0, 0), (1, 0, 0, 2), (0, -1, 0, 0), (0, 1, 0, 2), (0, 0, -1, 0), (0, 0, 1, 2)])
    r = random.Random(5)
    for _ in range(30):
        pts = [tuple(r.randrange(-6, 7) for _ in range(3)) for _ in range(25)]
        planes = clusters.hull_planes(pts)
        for n in planes:
            values = [n[0] * p[0] + n[1] * p[1] + n[2] * p[2] - n[3] for p in pts]
            assert max(values) == 0 and sum(v == 0 for v in values) >= 3
    with pytest.raises(ValueError):
        clusters.hull_planes([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)])


def test_agglomeration_keeps_clusters_convex():
    corners = np.array([[i & 1, i >> 1 & 1, i >> 2 & 1] for i in range(8)], dtype=float)
    six = np.array([[0, a, a | b, 7] for a, b in ((1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2))])
    # Fewer outer faces go before larger regions, so that the cube becomes three pyramids around its diagonal.
    assert sorted(np.bincount(clusters.agglomerate(corners, six))) == [2, 2, 2] and clusters.tet_volume(corners[six]).sum() == pytest.approx(1)
    moved = np.concatenate([corners, corners + [1, 0, 0], corners + [0, 1, 0]])
    found = clusters.agglomerate(moved, np.concatenate([six, six + 8, six + 16]))
    assert len(set(found)) == 9


def test_jets_flatten_noise(spark):
    rng = np.random.default_rng(1)
    u, v = rng.uniform(-1, 1, (2, 1500))
    rows = [(0, i, float(a), float(b), float(0.3 * a * a - 0.2 * a * b + e)) for i, (a, b, e) in enumerate(zip(u, v, rng.normal(size=1500) * 0.01, strict=True))]
    p = spark.createDataFrame(rows, "frame_id long, point_id long, x double, y double, z double")
    j = clusters.jet_smooth(p, 0.3)
    error = F.avg(F.abs(F.col("z") - 0.3 * F.col("x") * F.col("x") + 0.2 * F.col("x") * F.col("y")))
    assert j.count() == 1500 and j.agg(error).first()[0] < 0.5 * p.agg(error).first()[0]


def test_exports(spark, cavity, tmp_path):
    v, faces, programs = cavity
    patched = boundary.patches(faces)
    off = exports.patch_mesh(patched, 0.1).first()
    assert off.off.splitlines()[:2] == ["OFF", "48 12 0"]
    data = json.loads(exports.program_json(programs).first().json)
    rows = [(n["id"], n["op"], n["leaf"], n["children"]) for n in data["nodes"]]
    planes = [(*leaf["normal"], leaf["offset"]) for leaf in data["leaves"]]
    x = np.random.default_rng(1).uniform(-0.1, 0.4, (100, 3))
    p = arrangement.Program.unpack(programs.first().program)
    assert np.allclose(trees.values(trees.restore(rows), planes, x), arrangement.hard_values(p, x), atol=1e-12)
    made = exports.write_bundle(spark, f"file://{tmp_path}/b", {"voxels": v, "patches": patched}, {"h": 0.1})
    assert made["tables"]["voxels"]["rows"] == 26 and exports.read_bundle(spark, f"file://{tmp_path}/b")["patches"].count() == 12
    text = exports.xyz_lines(spark.createDataFrame([(0, 0.1, 1 / 3, -2e-17)], "frame_id long, x double, y double, z double"))
    back = sources.parse_xyz(text.select("frame_id", F.lit(0).cast("long").alias("point_id"), F.col("value").alias("raw"))).first()
    assert (back.x, back.y, back.z) == (0.1, 1 / 3, -2e-17)
