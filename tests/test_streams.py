"""Recorded streams in many micro-batches, broken off and gone on with; folders of a manifest's frames; points in blocks."""

import os
import random
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfield.operators import arrangement, audit, boundary, meet, voxels
from clearfield.sources import staging
from clearfield.streaming import frames, manifest

SETS = {"a": [(0.05, 0.05, 0.05)], "b": [(0.15, 0.05, 0.05)], "c": [(0.25, 0.05, 0.05), (0.05, 0.05, 0.05)]}


def recorded(spark, order, sensors="st", start=0):
    rows = [(s, start + k, i, *(c + 0.001 * (k % 7) for c in p)) for s in sensors for k, name in enumerate(order) for i, p in enumerate(SETS[name])]
    return spark.createDataFrame(rows, "sensor_id string, frame_id long, point_id long, x double, y double, z double").repartition(3)


def expected(order, capacity):
    held, out = [], []
    for name in order:
        out.append(name in held)
        held = [name, *[h for h in held if h != name]][:capacity]
    return out


@pytest.mark.parametrize("capacity", [1, 2])
def test_a_stream_in_many_batches_goes_on_after_a_break(spark, tmp_path, capacity):
    r = random.Random(capacity)
    order = [r.choice("aabc") for _ in range(40)]
    folder = f"file://{tmp_path}/s"
    first = frames.run_recorded(recorded(spark, order[:23]), 0.1, folder, capacity, frames_a_file=6, files_a_batch=2)
    assert first.count() == 46
    done = frames.run_recorded(recorded(spark, order[23:], start=23), 0.1, folder, capacity, frames_a_file=6, files_a_batch=2).orderBy("sensor_id", "frame_id").collect()
    assert [(r.sensor_id, r.frame_id) for r in done] == [(s, k) for s in "st" for k in range(40)]
    assert [r.hit for r in done] == 2 * expected(order, capacity)
    assert all(r.certified and r.outside == 0 and r.voxels == len(SETS[order[r.frame_id]]) for r in done)
    batches = [f for f in os.listdir(f"{tmp_path}/s/progress/commits") if not f.startswith(".")]
    assert len(batches) >= 6


def test_recorded_files_rise_with_their_frames(spark, tmp_path):
    folder = f"file://{tmp_path}/in"
    n = sum(frames.record(frames.frames_of(recorded(spark, "abc" * 7, start=21 * k)), folder, 5) for k in range(2))
    files = sorted((os.path.getmtime(f"{tmp_path}/in/{f}"), f) for f in os.listdir(f"{tmp_path}/in") if f.startswith("part-"))
    assert len(files) == n > 8 and len({t for t, _ in files}) == n
    last = -1
    for _, f in files:
        ids = [r.frame_id for r in spark.read.parquet(f"{folder}/{f}").select("frame_id").collect()]
        assert min(ids) >= last and ids == sorted(ids)
        last = max(ids)
    assert frames.record(frames.frames_of(recorded(spark, "a")).where("false"), folder) == 0


def folders(spark):
    top = urlparse(staging.staging_folder(spark).rsplit("/", 1)[0]).path
    return len([f for f in os.listdir(top) if f.startswith("frames-")])


def test_folders_are_steady_over_hits_and_misses(spark):
    spark.createDataFrame([(0, 0, 0.05, 0.05, 0.05)], "frame_id long, point_id long, x double, y double, z double")
    held = manifest.Environments(0.1, capacity=2)
    clouds = {n: spark.createDataFrame([(0, i, *p) for i, p in enumerate(s)], "frame_id long, point_id long, x double, y double, z double") for n, s in SETS.items()}
    for n in "ab":
        held.prepare(clouds[n])
    staging.written(clouds["a"])  # so that there is a folder
    before = folders(spark)
    hits = [held.prepare(clouds[n])[1]["cache_hit"] for n in "abababcbc"]
    assert hits == [True] * 6 + [False, True, True] and folders(spark) == before
    assert held.held[0].programs.count() == 1


def test_scopes_drop_what_is_not_kept(spark):
    with staging.scope(spark):
        one, two = staging.written(spark.range(3)), staging.kept(staging.written(spark.range(4)))
        assert one.count() == 3
    assert two.count() == 4
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(one.staged_in).count()
    staging.drop(two)
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(two.staged_in).count()


def test_kernels_get_points_in_blocks(spark, monkeypatch):
    sizes = []

    def compute(frame, side):
        assert len(frame) <= 100
        return {"q": frame["x"].to_numpy() + side[0, 0]}

    points = spark.range(1000).select(F.lit(0).cast("long").alias("frame_id"), (F.col("id") / 7).alias("x"))
    sides = meet.packed(spark.createDataFrame([(0, 2.0)], "frame_id long, v double"), ["v"])
    most = meet.MOST_NUMBERS
    for broadcast in (1 << 20, 0):
        got = meet.meet(points, sides, meet.unpacked(1), compute, "q double", broadcast, weight=lambda side: most // 100)
        assert got.where("abs(q - x - 2) > 1e-12").count() == 0 and got.count() == 1000
    assert not sizes


def test_salts_are_the_same_when_dealt_again(spark):
    points = spark.range(2000).select((F.col("id") % 2).alias("frame_id"), (F.col("id") / 3).alias("x"))
    sides = meet.packed(spark.createDataFrame([(0, 1.0), (1, 2.0)], "frame_id long, v double"), ["v"])
    runs = [sorted(map(tuple, meet.meet(p, sides, meet.unpacked(1), lambda f, s: {"q": f["x"] * s[0, 0]}, "q double", 0).collect())) for p in (points, points.orderBy(F.desc("x")).repartition(5))]
    assert runs[0] == runs[1] and len(runs[0]) == 2000


def test_zeros_and_exports_in_small_blocks(spark, monkeypatch):
    keys = [(i, j, 0) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    v = spark.createDataFrame([(0, *k) for k in keys], "frame_id long, ix long, iy long, iz long")
    coords = boundary.coordinates(boundary.supports(boundary.exposed_faces(v)))
    programs = staging.written(arrangement.build_programs(boundary.cells(v, coords), coords, 1.0))
    rng = np.random.default_rng(1)
    rays = spark.createDataFrame([(0, i, *map(float, rng.uniform(-2, -1, 3)), 0.5, 0.5, 0.5) for i in range(300)], "frame_id long, ray_id long, x double, y double, z double, ix double, iy double, iz double")
    want = sorted(map(tuple, audit.zero_rays(rays, programs, 0.05).collect()))
    monkeypatch.setattr(meet, "TOGETHER", 37)
    assert sorted(map(tuple, audit.zero_rays(rays, programs, 0.05).collect())) == want and all(r[-1] for r in want)


def test_strides_by_coarse_steps(spark):
    points = spark.createDataFrame([(f, float(x)) for f in (0, 1) for x in np.random.default_rng(f).permutation(1000 + f)], "frame_id long, x double")
    got = audit.strided(points, ["x"], 7, [F.floor(F.col("x") / 64)]).collect()
    for f, n in ((0, 1000), (1, 1001)):
        want = {float(i) for i in range(n) if i == 0 or i * 7 // n > (i - 1) * 7 // n}
        assert {r.x for r in got if r.frame_id == f} == want and len(want) == 7
    assert voxels.AXES


def test_small_frames_do_not_make_micro_batches_and_state_goes_by_sensors(spark, tmp_path):
    folder = f"file://{tmp_path}/long"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    done = frames.run_recorded(recorded(spark, "aab" * 200), 0.1, folder)
    rows = done.collect()
    sensors = len({r.sensor_id for r in rows})
    assert len(rows) == 600 * sensors and all(r.certified for r in rows)
    assert len([p for p in (tmp_path / "long/progress/offsets").iterdir() if p.name.isdigit()]) == 1
    assert len([p for p in (tmp_path / "long/progress/state/0").iterdir() if p.name.isdigit()]) <= sensors
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
