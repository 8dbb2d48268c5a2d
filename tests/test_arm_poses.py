"""All spheres of the arm with their Jacobians, by products of matrices written out and by differences."""

import math
import os

import numpy as np
import pytest

from clearfield.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not there")


def at(x, y, z):
    m = np.eye(4)
    m[:3, 3] = x, y, z
    return m


def about(axis, angle):
    m, (u, v) = np.eye(4), [(1, 2), (2, 0), (0, 1)][axis]
    m[u, u], m[u, v], m[v, u], m[v, v] = math.cos(angle), -math.sin(angle), math.sin(angle), math.cos(angle)
    return m


def centres(turn, lift, swing):
    column = at(0, 0, 0.2) @ about(2, turn)
    plate = column @ at(0, 0.2, 0) @ about(2, 0.5)
    carriage = column @ at(0.1, 0, 0) @ about(1, 0.1) @ at(0, 0, lift)
    tool = carriage @ at(0, 0.3, 0) @ about(1, swing)
    held = [(np.eye(4), (0, 0, 0.1)), (column, (0, 0.1, 0)), (column, (0, 0.3, 0)), (plate, (0.05, 0, 0)), (carriage, (0, 0.2, 0.1)), (tool, (0.2, 0, 0)), (tool, (0.3, 0, 0.05))]
    return np.array([(m @ [*p, 1])[:3] for m, p in held])


def test_every_sphere_and_jacobian(spark):
    suppliers = {r[0] for r in spark.read.parquet(f"{SF}/supplier.parquet").select("s_suppkey").collect()}
    got = {(r.config_id, r.sphere_id): r for r in registry.arm_poses(spark, SF).collect()}
    assert set(got) == {(c, s) for c in suppliers for s in range(7)}
    for c in suppliers:
        q = np.array([c % 13 / 4, c % 7 / 10, c % 5 / 3])
        want = centres(*q)
        slopes = [(centres(*(q + d)) - centres(*(q - d))) / 2e-6 for d in np.eye(3) * 1e-6]
        for s in range(7):
            r = got[c, s]
            assert (r.x, r.y, r.z) == pytest.approx(tuple(want[s]), abs=2e-9)
            assert [[r[f"j{a}{k}"] for a in "xyz"] for k in range(3)] == [pytest.approx(list(d[s]), abs=1e-7) for d in slopes]
