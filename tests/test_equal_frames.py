"""Many small frames: those of equal sides are worked on together, and a frame's faces come with its clusters."""

import numpy as np
import pandas as pd
import pytest

from clearfield.operators import clusters, meshes
from clearfield.operators.meet import meet, packed, unpacked


@pytest.mark.parametrize("most_broadcast", [1 << 20, 0])
def test_points_of_equal_sides_are_worked_on_together(spark, most_broadcast):
    points = spark.range(0, 900, 1, 2).selectExpr("id % 180 AS frame_id", "id AS point_id", "CAST(id AS DOUBLE) AS x")
    sides = packed(spark.range(170).selectExpr("id AS frame_id", "CAST(id % 3 AS DOUBLE) AS low"), ["low"])
    found = meet(points, sides, unpacked(1), lambda pts, s: {"above": pts["x"].to_numpy() - s[0, 0], "together": np.full(len(pts), len(pts))}, "above double, together int", most_broadcast, alike=True).toPandas()
    assert sorted(found["point_id"]) == [i for i in range(900) if i % 180 < 170]
    assert (found["above"] == found["x"] - found["frame_id"] % 3).all()
    # Five points a frame; four tasks or fewer deal with three kinds of sides.
    assert found["together"].min() > 20


def test_faces_of_frames_are_those_of_cluster_faces(spark):
    rng = np.random.default_rng(3)
    six = [[0, a, a | b, 7] for a, b in ((1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2))]
    corners = [(f, 10 + v, *[float(v >> b & 1) for b in range(3)]) for f in (1, 2) for v in range(8)]
    corners += [(3, 10 + v, *map(float, np.array([v & 1, v >> 1 & 1, v >> 2]) + rng.uniform(-0.2, 0.2, 3))) for v in range(8)]
    tets = [(f, 5 * j, [10 + k for k in t]) for f in (1, 2, 3) for j, t in enumerate(six)]
    vertices, tets = spark.createDataFrame(corners, "frame_id long, vertex_id long, x double, y double, z double"), spark.createDataFrame(tets, "frame_id long, tet_id long, v array<long>")
    frames = clusters.clustered_frames(vertices, tets).cache()
    found = clusters.agglomerate_frames(vertices, tets)
    mine = {(r.frame_id, t): c for r in frames.collect() for t, c in zip(r.tets, r.clusters, strict=True)}
    assert mine == {(r.frame_id, r.tet_id): r.cluster_id for r in found.collect()} and len(mine) == 18
    one = tets.selectExpr("frame_id", "tet_id", "0L AS cluster_id")
    for column, of in (("surface", one), ("faces", found)):
        want = meshes.cluster_faces(tets, of, vertices)
        got = meshes.packed_triangles(frames, column).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    order = ["frame_id", "cluster_id", "nx", "ny", "nz", "offset", "faces", "area"]
    planes = [d.select(*order).toPandas().sort_values(order, ignore_index=True) for d in (meshes.packed_planes(frames, "faces"), meshes.support_planes(meshes.cluster_faces(tets, found, vertices)))]
    pd.testing.assert_frame_equal(*planes)
    with pytest.raises(Exception, match="unknown vertices"):
        clusters.clustered_frames(vertices.where("vertex_id > 11"), tets).collect()
