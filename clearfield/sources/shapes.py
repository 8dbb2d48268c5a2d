"""Synthetic clouds as plans over spark.range: cameras around an ellipsoid, and surfaces of boxes, tori and planes.

Points are functions of their number and a seed, so any partitioning gives the same cloud.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform(seed: int, *key: Column) -> Column:
    """A uniform number in [0, 1) that depends on the key and the seed alone."""
    return F.shiftrightunsigned(F.xxhash64(*key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def gauss(seed: int, *key: Column) -> Column:
    """A standard normal number, from two uniform ones."""
    a, b = uniform(2 * seed + 1, *key), uniform(2 * seed + 2, *key)
    return F.sqrt(-2 * F.log(1 - a)) * F.cos(2 * math.pi * b)


def camera_axes(views: int, centre: tuple[float, float, float], distance: float) -> list[tuple[np.ndarray, ...]]:
    """Eye, right, up and forward of each view: a ring of alternating heights, then one camera above and one below."""
    found, c = [], np.array(centre)
    for view in range(views):
        turn = 2 * math.pi * view / (views - 2)
        if view < views - 2:
            eye = np.array([c[0] + distance * math.cos(turn), c[1] + distance * math.sin(turn), c[2] + (-0.12 if view % 2 else 0.15)])
        else:
            side = 1 if view == views - 2 else -1
            eye = c + np.array([0.08 * side, 0.0, distance * side])
        ahead = (c - eye) / np.linalg.norm(c - eye)
        right = np.cross(ahead, [0.0, 1.0, 0.0] if abs(ahead[2]) > 0.9 else [0.0, 0.0, 1.0])
        right /= np.linalg.norm(right)
        up = np.cross(right, ahead)
        found.append((eye, right, up / np.linalg.norm(up), ahead))
    return found


def depth_camera(
    spark: SparkSession,
    views: int = 10,
    rows: int = 72,
    columns: int = 96,
    centre: tuple[float, float, float] = (0.0, 0.0, 0.75),
    radii: tuple[float, float, float] = (0.18, 0.13, 0.24),
    distance: float = 0.85,
    vertical_fov: float = 50.0,
    noise: float = 0.0012,
    dropout: float = 0.06,
    grazing: float = 0.22,
    quantum: float = 0.0005,
    seed: int = 1,
) -> DataFrame:
    """Points that pinhole cameras see of an ellipsoid: frame_id (view), point_id (pixel), x, y, z.

    All views but two stand on a ring, at alternating heights; the last two look from above and below. Noise
    of the depth and dropout grow with the angle of incidence, depth is rounded to a quantum, and a quarter
    of the depth's noise is added across the ray in each direction of the image.
    """
    if views < 6:
        raise ValueError("six views at least")
    pixel = spark.range(views * rows * columns).withColumnRenamed("id", "n")
    pixel = pixel.select(
        F.floor(F.col("n") / (rows * columns)).cast("long").alias("frame_id"), (F.col("n") % (rows * columns)).alias("point_id"),
        (F.floor(F.col("n") / columns) % rows).alias("r"), (F.col("n") % columns).alias("c"), "n",
    )
    axes = np.array(camera_axes(views, centre, distance))  # (views, 4, 3)
    half, middle, radius = math.tan(math.radians(vertical_fov) / 2), np.array(centre), np.array(radii)

    def run(frames):
        for f in frames:
            eye, right, up, ahead = (axes[f["frame_id"].to_numpy(), k] for k in range(4))
            a = (2 * (f["c"].to_numpy() + 0.5) / columns - 1) * (columns / rows * half)
            b = (1 - 2 * (f["r"].to_numpy() + 0.5) / rows) * half
            d = ahead + a[:, None] * right + b[:, None] * up
            d /= np.linalg.norm(d, axis=1, keepdims=True)
            # Where the ray meets the ellipsoid: the near root if positive, else the far one.
            o, w = (eye - middle) / radius, d / radius
            qa, qb, qc = (w * w).sum(axis=1), 2 * (o * w).sum(axis=1), (o * o).sum(axis=1) - 1
            disc = qb * qb - 4 * qa * qc
            root = np.sqrt(np.maximum(disc, 0.0))
            t = np.where(-qb - root > 0, -qb - root, -qb + root) / (2 * qa)
            normal = (eye + t[:, None] * d - middle) / radius**2
            away = 1 - np.clip(-(d * normal).sum(axis=1) / np.linalg.norm(normal, axis=1), 0.0, 1.0)
            sigma = noise * (1 + 1.5 * away)
            depth = np.round((t + sigma * f["g1"].to_numpy()) / quantum) * quantum
            at = eye + depth[:, None] * d + (0.25 * sigma * f["g2"].to_numpy())[:, None] * right + (0.25 * sigma * f["g3"].to_numpy())[:, None] * up
            seen = (disc >= 0) & (t > 0) & (f["draw"].to_numpy() >= np.minimum(0.8, dropout + grazing * away))
            yield pd.DataFrame({"frame_id": f["frame_id"], "point_id": f["point_id"], "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]})[seen]

    drawn = pixel.select("frame_id", "point_id", "r", "c", uniform(seed, F.col("n")).alias("draw"), *[gauss(seed + k, F.col("n")).alias(f"g{k}") for k in (1, 2, 3)])
    return drawn.mapInPandas(run, "frame_id long, point_id long, x double, y double, z double")


def camera_cloud(measured: DataFrame, voxel: float = 0.018, frame: int = 0, seed: int = 1) -> DataFrame:
    """One cloud of all views of a camera: of each voxel one measurement, each as likely as another."""
    from ..operators.voxels import reservoir

    # Numbers of pixels repeat from view to view.
    one = measured.select(F.lit(frame).cast("long").alias("frame_id"), F.expr("shiftleft(frame_id, 40) + point_id").alias("point_id"), *"xyz")
    return reservoir(one, voxel, 1, seed)


def box_surface(spark: SparkSession, n: int, lo: tuple[float, float, float], hi: tuple[float, float, float], frame: int = 0, seed: int = 1) -> DataFrame:
    """n points on a box's surface, faces drawn by area."""
    side = [b - a for a, b in zip(lo, hi, strict=True)]
    areas = [side[1] * side[2], side[0] * side[2], side[0] * side[1]]
    total = 2 * sum(areas)
    draw = uniform(seed, F.col("id")) * total
    axis = F.when(draw < 2 * areas[0], 0).when(draw < 2 * (areas[0] + areas[1]), 1).otherwise(2)
    far = uniform(seed + 1, F.col("id")) < 0.5
    at = [F.when(axis == k, F.when(far, hi[k]).otherwise(lo[k])).otherwise(lo[k] + side[k] * uniform(seed + 2 + k, F.col("id"))) for k in range(3)]
    return spark.range(n).select(F.lit(frame).cast("long").alias("frame_id"), F.col("id").alias("point_id"), *[a.alias(c) for a, c in zip(at, "xyz", strict=True)])


def ellipsoid_surface(spark: SparkSession, n: int, centre: tuple[float, ...], radii: tuple[float, ...], frame: int = 0, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """n points on an ellipsoid, from normal directions, with optional radial noise."""
    g = [gauss(seed + 10 * k, F.col("id")) for k in range(3)]
    size = F.sqrt(g[0] * g[0] + g[1] * g[1] + g[2] * g[2])
    scale = 1 + (noise * gauss(seed + 50, F.col("id")) if noise else F.lit(0.0))
    at = [c + r * x / size * scale for c, r, x in zip(centre, radii, g, strict=True)]
    return spark.range(n).select(F.lit(frame).cast("long").alias("frame_id"), F.col("id").alias("point_id"), *[a.alias(c) for a, c in zip(at, "xyz", strict=True)])


def torus_surface(spark: SparkSession, n: int, ring: float, tube: float, frame: int = 0, seed: int = 1) -> DataFrame:
    """n points on a torus around z."""
    u, v = (2 * math.pi * uniform(seed + k, F.col("id")) for k in range(2))
    at = ((ring + tube * F.cos(v)) * F.cos(u), (ring + tube * F.cos(v)) * F.sin(u), tube * F.sin(v))
    return spark.range(n).select(F.lit(frame).cast("long").alias("frame_id"), F.col("id").alias("point_id"), *[a.alias(c) for a, c in zip(at, "xyz", strict=True)])


def plane_patch(spark: SparkSession, n: int, width: float, depth: float, z: float, frame: int = 0, seed: int = 1) -> DataFrame:
    """n points on a horizontal rectangle around the origin."""
    at = (width * (uniform(seed, F.col("id")) - 0.5), depth * (uniform(seed + 1, F.col("id")) - 0.5), F.lit(z))
    return spark.range(n).select(F.lit(frame).cast("long").alias("frame_id"), F.col("id").alias("point_id"), *[a.alias(c) for a, c in zip(at, "xyz", strict=True)])


def annular_bracket(spark: SparkSession, n: int, inner: float, outer: float, height: float, opening: float, frame: int = 0, seed: int = 1) -> DataFrame:
    """n points on an extruded annular sector that leaves an angle open: two caps, two walls and two ends, by area."""
    span = 2 * math.pi - opening
    cap, width = span * (outer * outer - inner * inner) / 2, outer - inner
    parts = [2 * cap, span * inner * height, span * outer * height, 2 * width * height]
    draw, total = uniform(seed, F.col("id")), sum(parts)
    u, v, w = (uniform(seed + 1 + k, F.col("id")) for k in range(3))
    edges = [sum(parts[: k + 1]) / total for k in range(4)]
    on_cap, on_inner, on_outer = draw < edges[0], draw < edges[1], draw < edges[2]
    radius = F.when(on_cap, F.sqrt(inner * inner + u * (outer * outer - inner * inner))).when(on_inner, inner).when(on_outer, outer).otherwise(inner + u * width)
    angle = opening / 2 + span * F.when(on_outer, v).otherwise(F.when(v < 0.5, 0.0).otherwise(1.0))
    z = F.when(on_cap, F.when(w < 0.5, 0.0).otherwise(height)).otherwise(w * height)
    at = (radius * F.cos(angle), radius * F.sin(angle), z)
    return spark.range(n).select(F.lit(frame).cast("long").alias("frame_id"), F.col("id").alias("point_id"), *[a.alias(c) for a, c in zip(at, "xyz", strict=True)])


def bent_tube(spark: SparkSession, n: int, bend: float, tube: float, angle: float, frame: int = 0, seed: int = 1) -> DataFrame:
    """n points on a tube along an arc of a circle in the x-z plane."""
    u, v = angle * uniform(seed, F.col("id")), 2 * math.pi * uniform(seed + 1, F.col("id"))
    r = bend + tube * F.cos(v)
    at = (r * F.cos(u), tube * F.sin(v), r * F.sin(u))
    return spark.range(n).select(F.lit(frame).cast("long").alias("frame_id"), F.col("id").alias("point_id"), *[a.alias(c) for a, c in zip(at, "xyz", strict=True)])


def placed(points: DataFrame, frame: int, shift: tuple[float, float, float]) -> DataFrame:
    """points moved into a frame; scenes are unions of these, with numbers of their own."""
    at = [(F.col(c) + s).alias(c) for c, s in zip("xyz", shift, strict=True)]
    return points.select(F.lit(frame).cast("long").alias("frame_id"), F.xxhash64("point_id", *[F.lit(s) for s in shift]).alias("point_id"), *at)


def jitter_within_voxels(points: DataFrame, h: float, share: float = 0.25) -> DataFrame:
    """points moved a share of the way to the middle of their voxel: the same occupancy, other points."""
    from ..operators.voxels import with_voxels

    moved = with_voxels(points, h)
    return moved.select("frame_id", "point_id", *[(F.col(c) + share * ((F.col(f"i{c}") + 0.5) * h - F.col(c))).alias(c) for c in "xyz"])


def without_voxels(points: DataFrame, dropped: DataFrame, h: float) -> DataFrame:
    """points that lie in none of the dropped voxels."""
    from ..operators.voxels import KEY, with_voxels

    return with_voxels(points, h).join(dropped, KEY, "left_anti").select("frame_id", "point_id", *"xyz")
