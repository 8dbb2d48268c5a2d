"""Twenty named clouds of known surfaces: box unions, a cylinder, a torus, shells, patches and ellipsoids in several states.

Each case says how many points it has and how far a point is from its surface, so that generators and the
operators behind them can be checked case by case. Random streams are our own.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shapes import annular_bracket, bent_tube, camera_cloud, depth_camera, ellipsoid_surface, gauss, placed, plane_patch, torus_surface, uniform

Box = tuple[tuple[float, float, float], tuple[float, float, float]]

#: Box unions of the suite, in metres (fixed values).
BOX_UNIONS: dict[str, list[Box]] = {
    "cube_surface": [((-0.15, -0.15, 0.50), (0.15, 0.15, 0.80))],
    "l_surface": [((-0.15, -0.15, 0.50), (0.15, -0.06, 0.65)), ((-0.15, -0.06, 0.50), (-0.06, 0.15, 0.65))],
    "u_surface": [((-0.15, -0.15, 0.50), (0.15, -0.06, 0.65)), ((-0.15, -0.06, 0.50), (-0.06, 0.15, 0.65)), ((0.06, -0.06, 0.50), (0.15, 0.15, 0.65))],
    "thin_wall_surface": [((-0.003, -0.15, 0.50), (0.003, 0.15, 0.80))],
    "staircase_surface": [((-0.18, -0.14, 0.50), (-0.06, 0.14, 0.62)), ((-0.06, -0.14, 0.50), (0.06, 0.14, 0.74)), ((0.06, -0.14, 0.50), (0.18, 0.14, 0.86))],
    "two_objects_surface": [((-0.30, -0.10, 0.52), (-0.10, 0.10, 0.72)), ((0.10, -0.10, 0.68), (0.30, 0.10, 0.88))],
    "narrow_corridor_surface": [((-0.22, -0.14, 0.52), (-0.06, 0.14, 0.88)), ((0.06, -0.14, 0.52), (0.22, 0.14, 0.88))],
}
#: The hollow box's walls, the ellipsoid, the cylinder (radius, height, middle), the torus (ring, tube, middle), the patch and the outliers (fixed values).
OUTER, INNER = ((-0.18, -0.18, 0.56), (0.18, 0.18, 0.92)), ((-0.09, -0.09, 0.65), (0.09, 0.09, 0.83))
CENTRE, RADII = (0.0, 0.0, 0.75), (0.18, 0.13, 0.24)
CYLINDER, TORUS, PATCH = (0.14, 0.32, 0.72), (0.16, 0.06, 0.74), (0.36, 0.28, 0.74)
OUTLIERS = [(0.26, 0.02, 0.74), (-0.26, 0.02, 0.74), (0.02, 0.22, 0.74), (0.02, -0.22, 0.74), (0.02, 0.02, 1.06), (0.02, 0.02, 0.42)]


@dataclass(frozen=True)
class Case:
    """A named cloud: points, how many they are (null where the draw decides), and how far one is off its surface (null: unknown)."""

    name: str
    points: DataFrame
    count: int | None
    off: Column | None


def box_union_surface(spark: SparkSession, n: int, boxes: list[Box], seed: int = 1) -> DataFrame:
    """n points on the surface of a union of boxes, drawn by area; those inside another box are drawn again.

    Eight candidates a point are made by their numbers, and the first n that stay are kept; unions whose
    surface is less than an eighth of their boxes' would come out short.
    """
    areas = []
    for lo, hi in boxes:
        s = [b - a for a, b in zip(lo, hi, strict=True)]
        areas += [s[1] * s[2], s[1] * s[2], s[0] * s[2], s[0] * s[2], s[0] * s[1], s[0] * s[1]]
    draw, at = uniform(seed, F.col("id")) * sum(areas), [F.lit(None).cast("double")] * 3
    shares = [uniform(seed + 1 + k, F.col("id")) for k in range(3)]
    for i in reversed(range(len(areas))):
        lo, hi = boxes[i // 6]
        axis, far = i % 6 // 2, i % 2
        here = [F.lit((lo, hi)[far][k]) if k == axis else lo[k] + shares[k] * (hi[k] - lo[k]) for k in range(3)]
        at = [F.when(draw < sum(areas[: i + 1]), h).otherwise(a) if i + 1 < len(areas) else h for h, a in zip(here, at, strict=True)]
    drawn = spark.range(8 * n).select(F.col("id").alias("point_id"), *[a.alias(c) for a, c in zip(at, "xyz", strict=True)])
    kept = drawn.where(~_strictly_inside(boxes)).orderBy("point_id").limit(n)
    return kept.select(F.lit(0).cast("long").alias("frame_id"), "point_id", *"xyz")


def _strictly_inside(boxes: list[Box]) -> Column:
    out = F.lit(False)
    for lo, hi in boxes:
        one = F.lit(True)
        for c, a, b in zip("xyz", lo, hi, strict=True):
            one = one & (F.col(c) > a) & (F.col(c) < b)
        out = out | one
    return out


def _off_boxes(boxes: list[Box]) -> Column:
    """Distance from the nearest face of any of the boxes; 1 for what lies inside one."""
    near = F.lit(1.0)
    for lo, hi in boxes:
        for k, c in enumerate("xyz"):
            gap = [F.greatest(F.lit(0.0), lo[i] - F.col(d), F.col(d) - hi[i]) for i, d in enumerate("xyz") if i != k]
            for plane in (lo[k], hi[k]):
                near = F.least(near, F.greatest(F.abs(F.col(c) - plane), *gap))
    return F.when(_strictly_inside(boxes), 1.0).otherwise(near)


def cylinder_surface(spark: SparkSession, n: int, radius: float, height: float, z: float, seed: int = 1) -> DataFrame:
    """n points on a closed upright cylinder, wall and caps by area."""
    u, v, w = (uniform(seed + k, F.col("id")) for k in range(3))
    wall = uniform(seed + 3, F.col("id")) < height / (height + radius)
    r = F.when(wall, radius).otherwise(radius * F.sqrt(v))
    up = F.when(wall, height * (w - 0.5)).otherwise(F.when(w < 0.5, -height / 2).otherwise(height / 2))
    at = (r * F.cos(2 * math.pi * u), r * F.sin(2 * math.pi * u), z + up)
    return spark.range(n).select(F.lit(0).cast("long").alias("frame_id"), F.col("id").alias("point_id"), *[a.alias(c) for a, c in zip(at, "xyz", strict=True)])


def suite(spark: SparkSession) -> list[Case]:
    """The twenty cases."""
    x, y, z = (F.col(c) for c in "xyz")
    ellipsoid = ellipsoid_surface(spark, 8192, CENTRE, RADII, seed=30)
    off_ellipsoid = F.abs(sum(((F.col(c) - m) * (F.col(c) - m) / (r * r) for c, m, r in zip("xyz", CENTRE, RADII, strict=True)), F.lit(-1.0)))
    clean = ellipsoid.where("point_id < 2048")
    radius, height, middle = CYLINDER
    ring, tube, level = TORUS
    axial, out = F.sqrt(x * x + y * y), F.abs(z - middle) - height / 2
    off_cylinder = F.abs(F.greatest(axial - radius, out))
    off_torus = F.abs(F.sqrt((axial - ring) * (axial - ring) + (z - level) * (z - level)) - tube)
    hollow = box_union_surface(spark, 1536, [OUTER], 22).unionByName(box_union_surface(spark, 512, [INNER], 23).withColumn("point_id", F.col("point_id") + (1 << 32)))
    cases = [Case("camera", camera_cloud(depth_camera(spark)), None, None)]
    cases += [Case(name, box_union_surface(spark, 2048, boxes, 10 + i), 2048, _off_boxes(boxes)) for i, (name, boxes) in enumerate(BOX_UNIONS.items())]
    cases += [
        Case("cylinder_surface", cylinder_surface(spark, 2048, *CYLINDER, seed=20), 2048, off_cylinder),
        Case("torus_surface", placed(torus_surface(spark, 2048, ring, tube, seed=21), 0, (0.0, 0.0, level)), 2048, off_torus),
        Case("hollow_box_surfaces", hollow, 2048, F.least(_off_boxes([OUTER]), _off_boxes([INNER]), F.when(_on([INNER]), 0.0).otherwise(1.0))),
        Case("plane_patch", plane_patch(spark, 1024, *PATCH, seed=24), 1024, F.abs(z - PATCH[2])),
        Case("ellipsoid_sparse", ellipsoid.where("point_id < 256"), 256, off_ellipsoid),
        Case("ellipsoid_surface", clean, 2048, off_ellipsoid),
        Case("ellipsoid_dense", ellipsoid, 8192, off_ellipsoid),
    ]
    for mm in (2, 8):
        noisy = clean.withColumns({c: F.col(c) + mm / 1000 * gauss(31 + 7 * k, F.col("point_id")) for k, c in enumerate("xyz")})
        cases.append(Case(f"ellipsoid_noise_{mm}mm", noisy, 2048, None))
    copies = clean.withColumn("copy", F.explode(F.array(*map(F.lit, range(3))))).withColumn("point_id", F.xxhash64("point_id", "copy", F.lit(32))).drop("copy")
    far = spark.createDataFrame([(0, (1 << 40) + i, *p) for i, p in enumerate(OUTLIERS)], clean.schema)
    cases += [
        Case("ellipsoid_partial", ellipsoid.where("x >= 0").orderBy("point_id").limit(1024), 1024, F.when(x >= 0, off_ellipsoid).otherwise(1.0)),
        Case("ellipsoid_duplicates", copies, 6144, off_ellipsoid),
        Case("ellipsoid_outliers", clean.unionByName(far), 2054, None),
    ]
    return cases


def _on(boxes: list[Box]) -> Column:
    return _off_boxes(boxes) < 1e-9


def scene(spark: SparkSession, n: int = 600, frame: int = 0) -> DataFrame:
    """Six separate objects in one frame: a bracket, a tube, a torus, a cylinder, an L of boxes and an ellipsoid."""
    parts = [
        (annular_bracket(spark, n, 0.08, 0.14, 0.1, 1.0), (0.6, 0.0, 0.2)),
        (bent_tube(spark, n, 0.2, 0.04, 1.5), (0.5, 0.5, 0.2)),
        (torus_surface(spark, n, 0.12, 0.04), (-0.5, 0.4, 0.5)),
        (cylinder_surface(spark, n, 0.06, 0.3, 0.0), (-0.6, -0.3, 0.3)),
        (box_union_surface(spark, n, BOX_UNIONS["l_surface"]), (0.0, -0.7, 0.0)),
        (ellipsoid_surface(spark, n, (0.0, 0.0, 0.0), (0.1, 0.08, 0.15)), (0.0, 0.7, 0.6)),
    ]
    out = None
    for points, shift in parts:
        one = placed(points, frame, shift)
        out = one if out is None else out.unionByName(one)
    return out
