"""Conservative voxel occupancy of frames of points, as DataFrame plans.

A voxel (ix, iy, iz) of size h spans the planes double(i * h) and double((i + 1) * h). Indexing is half-open;
an occupied box is closed, so that a point on a plane belongs to the boxes on both sides of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["frame_id", "ix", "iy", "iz"]
AXES = ("ix", "iy", "iz")
#: Indices beyond this are refused: their planes would no longer be exact multiples.
INDEX_LIMIT = 1 << 50


def voxel_index(v: Column, h: float) -> Column:
    """The i with i * h <= v < (i + 1) * h for the rounded planes; null for null; fails beyond INDEX_LIMIT."""
    guess = F.floor(v / F.lit(h))
    i = F.when(v.isNull(), F.lit(None).cast("long")).when(F.abs(v / F.lit(h)) < INDEX_LIMIT, guess).otherwise(F.raise_error(F.lit("voxel index out of range or not finite")).cast("long"))
    # Within the limit, quotient and planes are rounded by less than an eighth of a step: off by one at most.
    return F.when(v < i * F.lit(h), i - 1).when(v >= (i + 1) * F.lit(h), i + 1).otherwise(i)


def with_voxels(points: DataFrame, h: float) -> DataFrame:
    """points with the voxel of each."""
    return points.withColumns({f"i{c}": voxel_index(F.col(c), h) for c in "xyz"})


def voxelize(points: DataFrame, h: float) -> DataFrame:
    """Occupied voxels, one row each; duplicates are combined before the shuffle."""
    return with_voxels(points, h).select(*KEY).distinct()


def bounds(voxels: DataFrame) -> DataFrame:
    """One row a frame: voxels, inclusive index bounds, and the depth of the cube that holds them.

    Depth is the least d with 2^d >= the largest extent, by bit length, not by a logarithm.
    """
    sides = [(f"min_{a}", F.min(a)) for a in AXES] + [(f"max_{a}", F.max(a)) for a in AXES]
    row = voxels.groupBy("frame_id").agg(F.count(F.lit(1)).alias("voxels"), *[c.alias(n) for n, c in sides])
    extent = F.greatest(*[F.col(f"max_{a}") - F.col(f"min_{a}") + 1 for a in AXES])
    depth = F.when(extent == 1, F.lit(0)).otherwise(F.length(F.bin(extent - 1)))
    return row.withColumn("depth", depth.cast("int"))


def corners(voxels: DataFrame) -> DataFrame:
    """Distinct corners (cx, cy, cz, integer grid indices) of occupied voxels."""
    grid = [F.struct(*[(F.col(a) + d).alias(f"c{a[1]}") for a, d in zip(AXES, (i, j, k), strict=True)]) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    return voxels.select("frame_id", F.explode(F.array(*grid)).alias("c")).select("frame_id", "c.cx", "c.cy", "c.cz").distinct()


def stats(points: DataFrame, voxels: DataFrame, h: float) -> DataFrame:
    """One row a frame: points, voxels, corners, occupied volume and points per voxel."""
    n = points.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"))
    v = voxels.groupBy("frame_id").agg(F.count(F.lit(1)).alias("voxels"))
    c = corners(voxels).groupBy("frame_id").agg(F.count(F.lit(1)).alias("corners"))
    joined = n.join(v, "frame_id").join(c, "frame_id")
    return joined.withColumns({"volume": F.round(F.col("voxels") * F.lit(h * h * h), 9), "points_per_voxel": F.round(F.col("points") / F.col("voxels"), 9)})


def touching(points: DataFrame, h: float) -> DataFrame:
    """points exploded to the voxels whose closed boxes hold them: one, or two along each axis where on a plane."""
    found = with_voxels(points, h)
    for c in "xyz":
        i = F.col(f"i{c}")
        on_plane = F.col(c) == i * F.lit(h)
        found = found.withColumn(f"i{c}", F.explode(F.when(on_plane, F.array(i - 1, i)).otherwise(F.array(i))))
    return found


def contains(points: DataFrame, voxels: DataFrame, h: float) -> DataFrame:
    """points with ``inside``: whether the closed union of the frame's voxels holds them.

    Asked once for each place, and joined by place: points need no number.
    """
    at = ["frame_id", *"xyz"]
    hits = touching(points.select(*at).distinct(), h).join(voxels, KEY, "left_semi").select(*at).distinct()
    return points.join(hits.withColumn("hit", F.lit(True)), at, "left").select(*points.columns, F.coalesce("hit", F.lit(False)).alias("inside"))


def count_outside(points: DataFrame, voxels: DataFrame, h: float) -> DataFrame:
    """Points and points outside the closed union, by frame."""
    flagged = contains(points, voxels, h)
    return flagged.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), F.count_if(~F.col("inside")).alias("outside"))


def closed_sign(points: DataFrame, voxels: DataFrame, h: float) -> DataFrame:
    """points with ``sign`` of the closed union: 1 inside, 0 on its boundary, -1 outside.

    Inside are points all of whose touching boxes are occupied; outside those with none.
    """
    at = ["frame_id", *"xyz"]
    boxes = touching(points.select(*at).distinct(), h)
    known = boxes.join(voxels.withColumn("o", F.lit(1)), KEY, "left").groupBy(*at).agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.coalesce("o", F.lit(0))).alias("n")
    )
    sign = F.when(F.col("n") == F.col("k"), 1).when(F.col("n") == 0, -1).otherwise(0)
    return points.join(known.select(*at, sign.alias("sign")), at).select(*points.columns, "sign")


def same_occupancy(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row a pair of frames (fa, fb) with ``differing`` voxels, 0 where the occupancy is equal.

    a, b: voxel rows with columns fa or fb in place of frame_id and pair, which names the comparison.
    """
    cols = ["pair", *AXES]
    both = a.select(*cols, F.lit(1).alias("s")).unionByName(b.select(*cols, F.lit(-1).alias("s")))
    return both.groupBy(*cols).agg(F.sum("s").alias("s")).groupBy("pair").agg(F.count_if(F.col("s") != 0).alias("differing"))


def preprocess_voxel(points: DataFrame, h: float) -> DataFrame:
    """Each voxel's centroid in place of its points, with how many there were."""
    means = [F.avg(c).alias(c) for c in "xyz"]
    return with_voxels(points, h).groupBy(*KEY).agg(*means, F.count(F.lit(1)).alias("points"))


def displacement(points: DataFrame, moved: DataFrame) -> DataFrame:
    """Mean, root mean square, maximum and nearest-rank 95th percentile of point displacements, by frame.

    moved: frame_id, point_id and mx, my, mz.
    """
    d = F.sqrt(sum(((F.col(f"m{c}") - F.col(c)) * (F.col(f"m{c}") - F.col(c)) for c in "yz"), (F.col("mx") - F.col("x")) * (F.col("mx") - F.col("x"))))
    return summarize(points.join(moved, ["frame_id", "point_id"]).select("frame_id", d.alias("e")), "frame_id", "e")


def summarize(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Count, maximum, mean, root mean square and nearest-rank 95th percentile of a column's absolute value."""
    e = rows.select(by, F.abs(F.col(value)).alias("e"))
    return e.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.max("e"), 9).alias("max_error"),
        F.round(F.avg("e"), 9).alias("mean_error"),
        F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 9).alias("rmse"),
        F.round(F.expr("percentile_disc(0.95) within group (order by e)"), 9).alias("p95"),
    )


def median_of(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Lower median of repeated measurements: by, n, median (the value of nearest rank, never a mean of two)."""
    return rows.groupBy(by).agg(F.count(value).alias("n"), F.expr(f"percentile_disc(0.5) within group (order by `{value}`)").alias("median"))


def reservoir(points: DataFrame, h: float, keep: int, seed: int) -> DataFrame:
    """A seeded uniform sample of at most ``keep`` points of each voxel: those of the smallest hashes."""
    order = Window.partitionBy(*KEY).orderBy(F.xxhash64("frame_id", "point_id", F.lit(seed)), "point_id")
    # The limit on the rank is pushed below the shuffle, so that no voxel is gathered whole.
    ranked = with_voxels(points, h).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    return ranked.select("frame_id", "point_id", *"xyz")
