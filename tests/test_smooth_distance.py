"""Errors of the smooth proxy against the distance to the faces, by brute force over every voxel and face."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfield.operators import arrangement
from clearfield.plans import registry
from clearfield.plans.oracles import H

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not there")


def signed_distance(keys, x):
    """Distance to the nearest exposed face, a unit square each; negative in the closed union."""
    best = math.inf
    for k in keys:
        for a in range(3):
            for s in (-1, 1):
                if tuple(k[i] + s * (i == a) for i in range(3)) in keys:
                    continue
                off = [x[i] - (k[i] + (s > 0)) * H if i == a else max(k[i] * H - x[i], x[i] - (k[i] + 1) * H, 0.0) for i in range(3)]
                best = min(best, math.sqrt(sum(v * v for v in off)))
    held = any(all(k[i] * H <= x[i] <= (k[i] + 1) * H for i in range(3)) for k in keys)
    return -best if held else best


def test_errors_against_brute_force(spark):
    got = {(r.frame_id, r.what): r for r in registry.smooth_distance_error(spark, SF).collect()}
    s = registry._Surface(spark, SF)
    frame = min(f for f, _ in got)
    keys = {(r.ix, r.iy, r.iz) for r in s.voxels.where(F.col("frame_id") == frame).collect()}
    points = [(r.x, r.y, r.z) for r in s.points.where(F.col("frame_id") == frame).collect()]
    probes = points + [tuple((i + 0.5) * H for i in k) for k in keys] + list({tuple((i + (m >> a & 1)) * H for a, i in enumerate(k)) for k in keys for m in range(8)})
    for p in s.patches.where(F.col("frame_id") == frame).collect():
        for off in (-0.25, 0.25):
            at = [0.0] * 3
            at[p.axis], at[(p.axis + 1) % 3], at[(p.axis + 2) % 3] = (p.plane + off) * H, (p.u0 + p.u1) / 2 * H, (p.v0 + p.v1) / 2 * H
            probes.append(tuple(at))
    program = arrangement.Program.unpack(arrangement.build_programs(s.cells, s.coords, H).where(F.col("frame_id") == frame).first().program)
    x = np.array(probes)
    hard, upper = -arrangement.hard_values(program, x), -arrangement.smooth_values(program, x, arrangement.smoothing(program, error=1e-3)[0])[0]
    true = np.array([signed_distance(keys, p) for p in probes])
    each = {"smoothing": hard - upper, "hard": hard - true, "sdf": upper - true, "outside": (upper - true)[true > 0], "inside": (upper - true)[true < 0]}
    each |= {"boundary": upper[true == 0], "near": (upper - true)[np.abs(true) <= H]}
    for what, e in each.items():
        e, r = np.sort(np.abs(e)), got[frame, what]
        assert len(e) == r.n and r.n, what
        assert (r.max_error, r.mean_error, r.rmse, r.p95) == pytest.approx((e[-1], e.mean(), math.sqrt((e * e).mean()), e[(95 * len(e) + 99) // 100 - 1]), abs=2e-9)
    assert {w for _, w in got} == set(each)
