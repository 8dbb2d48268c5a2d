import json

import pytest
from pyspark.sql import functions as F

from clearfield.__main__ import parser, run
from clearfield.operators import robot, voxels
from clearfield.sources import exports, shapes
from clearfield.sources.points import parse_ply
from clearfield.streaming.manifest import parse_manifest


@pytest.fixture(scope="module")
def cloud(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("clouds")
    scene = shapes.placed(shapes.annular_bracket(spark, 600, 0.1, 0.2, 0.1, 1.0), 0, (0.5, 0.0, 0.0))
    scene = scene.unionByName(shapes.placed(shapes.bent_tube(spark, 400, 0.2, 0.05, 1.5), 0, (0.5, 0.5, 0.2)))
    path = folder / "scene.xyz"
    path.write_text("# scene\n" + "\n".join(r.value for r in exports.xyz_lines(scene).collect()))
    return str(path), voxels.voxelize(scene, 0.05).count()


@pytest.mark.parametrize("command", ["voxelize", "boundary", "octree", "sweep", "hull", "function", "diagnose", "distance", "clearance", "camera"])
def test_commands(spark, cloud, tmp_path, command):
    path, n = cloud
    (tmp_path / "r.urdf").write_text(robot.DEMO_URDF)
    out = f"file://{tmp_path}/out"
    argv = [command, "--cloud", path, "--output", out, "--voxel-size", "0.05", "--urdf", str(tmp_path / "r.urdf"), "--q", "0,0,0;1,0.1,0.2"]
    made = run(spark, parser().parse_args(argv))
    tables = exports.read_bundle(spark, out)
    assert made["command"] == command and all(t.count() or name == "obstacles" for name, t in tables.items())
    if command == "hull":
        assert tables["clusters"].agg(F.sum("voxels")).first()[0] == n and tables["clusters"].count() < tables["size"].first()["cells"]
    if command == "diagnose":
        assert tables["diagnostics"].agg(F.sum("mismatches")).first()[0] == 0
    if command == "function":
        assert {"registry", "patches", "occupancy", "splits", "programs", "json", "expressions", "samples", "validation"} == set(tables)
        assert tables["validation"].where("ok").count() == 1 and tables["occupancy"].count() == n
    if command in ("octree", "sweep"):
        assert tables["metrics"].where("ok and samples > 64").count() == 1
    if command == "octree":
        assert tables["planes"].count() == 6 * tables["cells"].count() and tables["cells"].agg(F.sum(F.col("wx") * F.col("wy") * F.col("wz"))).first()[0] == n
    if command == "voxelize":
        assert tables["voxels"].count() == n
    if command == "sweep":
        assert tables["prisms"].select("axis").distinct().count() == 1
    if command == "clearance":
        documents = [json.loads(r.value) for r in tables["documents"].collect()]
        assert len(documents) == 2 and all([g["joint"] for g in d["groups"]] == ["turn", "lift", "swing"] for d in documents)
        assert tables["distances"].where(F.col("hard_min") < F.col("distance")).count() == 0


def test_tets(spark, tmp_path):
    v = spark.createDataFrame([(0, i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)], "frame_id long, vertex_id long, x double, y double, z double")
    t = spark.createDataFrame([(0, k, [0, a, a | b, 7]) for k, (a, b) in enumerate([(1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2)])], "frame_id long, tet_id long, v array<long>")
    v.write.parquet(f"{tmp_path}/v")
    t.write.parquet(f"{tmp_path}/t")
    argv = ["tets", "--vertices", f"{tmp_path}/v", "--tets", f"{tmp_path}/t", "--output", f"file://{tmp_path}/out", "--voxel-size", "1", "--samples", "200"]
    run(spark, parser().parse_args(argv))
    m = exports.read_bundle(spark, f"file://{tmp_path}/out")["metrics"].first()
    assert m["ok"] and m["samples"] == 200 and m["surface_faces"] == 12 and m["surface_volume"] == pytest.approx(1) and m["mesh_volume"] == pytest.approx(1)
    with pytest.raises(ValueError):
        run(spark, parser().parse_args(argv[:1] + argv[3:]))


@pytest.mark.parametrize("how", ["voxel", "jet"])
def test_preprocessing(spark, cloud, tmp_path, how):
    path, n = cloud
    out = f"file://{tmp_path}/out"
    run(spark, parser().parse_args(["voxelize", "--cloud", path, "--output", out, "--voxel-size", "0.05", "--preprocess", how]))
    # Surfaces through the nearest points of a sparse scene reach beyond its shapes; centres stay in their voxels.
    assert 0 < exports.read_bundle(spark, out)["voxels"].count() <= (1.5 if how == "jet" else 1.2) * n


def test_stream(spark, tmp_path, capsys):
    """Four frames, the third equal to the second in occupancy: false, false, true, false; with room for two, true at last."""
    (tmp_path / "r.urdf").write_text(robot.DEMO_URDF)
    clouds = {"a": "0.61 0.02 0.03\n0.62 0.12 0.33\n", "b": "0.61 0.02 0.03\n", "c": "# moved in its voxel\n0.63 0.01 0.04\n0.61 0.02 0.03\n"}
    for name, text in clouds.items():
        (tmp_path / f"{name}.xyz").write_text(text)
    lines = ["# frames", "", *(f"{tmp_path}/{c}.xyz\tfile://{tmp_path}/{i}.json" + ("\t0.1,0.2,0.3\r" if i == 1 else "") for i, c in enumerate("abca"))]
    (tmp_path / "m.txt").write_text("\n".join(lines) + "\n")
    base = ["stream", "--manifest", str(tmp_path / "m.txt"), "--urdf", str(tmp_path / "r.urdf"), "--q", "0,0,0", "--voxel-size", "0.05"]
    assert run(spark, parser().parse_args(base)) == {"command": "stream", "frames": 4, "hits": 1}
    status = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert [x["cache_hit"] for x in status] == [False, False, True, False] and all(x["outside"] == 0 for x in status)
    one, two, three = (json.loads((tmp_path / f"{i}.json").read_text()) for i in (0, 1, 3))
    assert one["groups"] == three["groups"] != two["groups"] and [g["joint"] for g in one["groups"]] == ["turn", "lift", "swing"]
    assert run(spark, parser().parse_args([*base, "--reuse", "2"]))["hits"] == 2
    for limit in ("points", "voxels", "cells", "nodes", "strata"):
        with pytest.raises(Exception, match=f"more than 1 {limit}"):
            run(spark, parser().parse_args([*base, f"--most-{limit}", "1"]))


@pytest.mark.parametrize("line", ["one", "a\tb\tc\td", "\tb", "a\tb\t1,x"])
def test_bad_manifests(line):
    with pytest.raises(ValueError, match="line 2"):
        parse_manifest(f"# x\n{line}\n")


def test_bad_commands(spark, cloud, tmp_path):
    path, _ = cloud
    base = ["--cloud", path, "--output", f"file://{tmp_path}/x"]
    for argv in (["voxelize", *base, "--voxel-size", "0"], ["clearance", *base, "--voxel-size", "0.05"]):
        with pytest.raises(ValueError):
            run(spark, parser().parse_args(argv))
    assert not (tmp_path / "x" / "manifest.json").exists()


def test_ply(spark):
    text = "ply\nformat ascii 1.0\nelement vertex 2\nproperty float y\nproperty float x\nproperty float z\nelement face 1\nproperty list uchar int v\nend_header\n1 2 3\n4 5 6\n3 0 1 1\n"
    assert [(r.x, r.y, r.z) for r in parse_ply(spark, text).collect()] == [(2.0, 1.0, 3.0), (5.0, 4.0, 6.0)]
    for bad in ("", "ply\nformat binary 1.0\n", text.replace("end_header\n", ""), text.replace("vertex 2", "vertex 9"), text.replace("1 2 3", "1 2 nan"), text.replace("float z", "float w")):
        with pytest.raises(ValueError):
            parse_ply(spark, bad)
