"""Registered queries of the spatial operators; their SQL is in ``oracles``."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cached_property

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import cross, dot, inside_box, inside_ellipsoid, length, minus, plane_value, ray_ellipsoid, same_plane, wilson
from ..operators import arrangement, audit, boundary, clusters, hulls, meshes, neighbours, octree, robot, surfaces, sweep, trees, voxels
from ..sources import bundles, exports
from ..sources import points as sources
from ..sources import shapes, suite
from ..sources.staging import staging_folder, written
from ..streaming import frames
from . import oracles
from .oracles import FINE, H

#: Corners of an L-shaped prism of height 1 over (0,0) (2,0) (2,1) (1,1) (1,2) (0,2).
PRISM_RING = [(0, 0), (2, 0), (2, 1), (1, 1), (1, 2), (0, 2)]


def _embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.points_of_embeddings(spark, sf_dir)


def _voxels(spark: SparkSession, sf_dir: str, h: float = H) -> DataFrame:
    return voxels.voxelize(_embed(spark, sf_dir), h)


#: Work limits that some frames of the tables pass, on some axes or all.
TIGHT = sweep.Limits(oracles.TIGHT_CELLS, oracles.TIGHT_UPDATES, oracles.TIGHT_PRISMS)


class _Surface:
    """The usual chain from points to compressed cells; with keep, its tables are written once for several readers."""

    def __init__(self, spark: SparkSession, sf_dir: str, h: float = H, keep: bool = False, found: DataFrame | None = None):
        kept = written if keep else lambda df: df
        self.h = h
        self.points = _embed(spark, sf_dir)
        self.voxels = kept(voxels.voxelize(self.points, h) if found is None else found)
        self.faces = kept(boundary.exposed_faces(self.voxels))
        self.supports = boundary.supports(self.faces)
        self.coords = kept(boundary.coordinates(self.supports))
        self.cells = boundary.cells(self.voxels, self.coords)

    @property
    def patches(self) -> DataFrame:
        return boundary.patches(self.faces)

    @cached_property
    def free(self) -> DataFrame:
        """Free compressed cells, written once."""
        return written(boundary.free_cells(self.cells, self.coords))

    def programs(self, **options) -> DataFrame:
        return arrangement.build_programs(self.cells, self.coords, self.h, **options)


def _spread(df: DataFrame) -> DataFrame:
    """Rows of a table of one small file, dealt out to all cores before each of them becomes much work."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def _boxes_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of one box a nation: frames whose functions have a closed form."""
    k = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("frame_id"))
    for c, (start, size) in zip("xyz", ((k["frame_id"] % 3 - 1, k["frame_id"] % 4 + 1), (k["frame_id"] % 5 - 2, k["frame_id"] % 2 + 1), (k["frame_id"] % 2 + 1, k["frame_id"] % 3 + 2)), strict=True):
        k = k.withColumn(f"i{c}", F.explode(F.sequence(start, start + size - 1)))
    return k


def _ls_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of one L a nation: two boxes with a reflex edge, whose function has one maximum among its minima."""
    k = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("frame_id"))
    n = F.col("frame_id")
    x0, y0, z0 = n % 3 - 1, n % 5 - 2, n % 2 + 1
    x1, y1 = x0 + n % 2 + 1, y0 + n % 3 + 1
    x2, y2, z1 = x1 + n % 4 + 1, y1 + n % 2 + 1, z0 + n % 3 + 1
    for c, (start, end) in zip("xyz", ((x0, x2), (y0, y2), (z0, z1)), strict=True):
        k = k.withColumn(f"i{c}", F.explode(F.sequence(start, end - 1)))
    return k.where((F.col("ix") < x1) | (F.col("iy") < y1))


def _arm(spark: SparkSession, sf_dir: str) -> tuple[robot.Model, DataFrame]:
    """The arm and the poses of its spheres at configurations taken from the suppliers."""
    model = robot.parse_urdf(robot.DEMO_URDF)
    o = _spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"))
    q = F.array((F.col("s_suppkey") % 13) / 4.0, (F.col("s_suppkey") % 7) / 10.0, (F.col("s_suppkey") % 5) / 3.0)
    return model, robot.sphere_poses(o.select(F.col("s_suppkey").alias("config_id"), q.alias("q")), model)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By frame: voxels, exposed faces, merged patches and support planes."""
    s = _Surface(spark, sf_dir, FINE)
    each = [s.voxels.select("frame_id", F.lit("voxels").alias("what")), s.faces.select("frame_id", F.lit("faces").alias("what"))]
    each += [s.patches.select("frame_id", F.lit("patches").alias("what")), s.supports.select("frame_id", F.lit("supports").alias("what"))]
    rows = each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])
    kinds = ("voxels", "faces", "patches", "supports")
    return rows.groupBy("frame_id").agg(*[F.count_if(F.col("what") == k).alias(k) for k in kinds])


def xyz_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _embed(spark, sf_dir)
    raw = F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"], F.lit("# seen"))
    return sources.parse_xyz(p.select("frame_id", "point_id", F.concat(F.lit("\t"), raw).alias("raw")))


def voxel_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = voxels.with_voxels(sources.points_of_lines(spark, sf_dir), H)
    return p.groupBy("frame_id", "ix", "iy", "iz").agg(F.count(F.lit(1)).alias("points"))


def voxel_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(spark, sf_dir, FINE)


def voxel_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.bounds(_voxels(spark, sf_dir, FINE))


def voxel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _embed(spark, sf_dir)
    return voxels.stats(p, voxels.voxelize(p, H), H)


def voxel_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels.corners(_voxels(spark, sf_dir))


def _neighbours(p: DataFrame) -> DataFrame:
    """Points moved one voxel up in x: some stay in the union, some leave it."""
    return p.withColumn("x", F.col("x") + F.lit(H))


def contains_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _embed(spark, sf_dir)
    return voxels.contains(_neighbours(p), voxels.voxelize(p, H), H).select("frame_id", "point_id", "inside")


def outside_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _embed(spark, sf_dir)
    return voxels.count_outside(_neighbours(p), voxels.voxelize(p, H), H)


def _half_grid(found: DataFrame) -> DataFrame:
    """The 27 corners, middles and centres of each voxel, on the half grid: kx, ky, kz."""
    out = found
    for c in "xyz":
        out = out.withColumn(f"k{c}", F.explode(F.array(*[2 * F.col(f"i{c}") + d for d in range(3)])))
    return out.select("frame_id", "kx", "ky", "kz").distinct()


def _probes(found: DataFrame) -> DataFrame:
    """Half-grid points as points; an even place is the rounded plane itself."""
    grid = _half_grid(found)
    return grid.withColumns({c: F.col(f"k{c}") / 2 * F.lit(H) for c in "xyz"} | {"point_id": F.xxhash64("frame_id", "kx", "ky", "kz")})


def expected_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voxels(spark, sf_dir)
    return voxels.closed_sign(_probes(v), v, H).select("frame_id", "kx", "ky", "kz", F.col("sign").cast("int").alias("sign"))


def exposed_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.exposed_faces(_voxels(spark, sf_dir)).select("frame_id", "axis", "sign", "plane", "u", "v")


def boundary_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary.number_patches(_Surface(spark, sf_dir).patches)


def line_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = voxels.voxelize(sources.points_of_lines(spark, sf_dir), H)
    return boundary.patches(boundary.exposed_faces(v))


def patch_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = boundary.patch_corners(_Surface(spark, sf_dir).patches, H)
    return p.select("frame_id", "axis", "sign", "plane", "u0", "v0", "corner", *[F.round(c, 9).alias(c) for c in "xyz"])


def support_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Surface(spark, sf_dir).supports


def support_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each support with the numbers of its patches, joined by commas."""
    p = boundary.support_patches(boundary.number_patches(_Surface(spark, sf_dir).patches))
    return p.select("frame_id", "axis", "coord", "signs", F.array_join(F.transform("patches", lambda x: x.cast("string")), ",").alias("patches"))


def registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in a registry of supports some of which had their numbers changed."""
    s = _Surface(spark, sf_dir).supports
    return boundary.registry_violations(s.withColumn("support_id", F.when(F.col("support_id") % 5 == 2, F.col("support_id") + 1).otherwise(F.col("support_id"))))


def canonical_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Surface(spark, sf_dir).cells


def cell_box_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied cells at or below every place of each frame's grid."""
    return boundary.grid_sums(written(_Surface(spark, sf_dir).cells))


def cell_box_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupied cells in the 3x3x3 cells around each occupied cell, by eight prefix sums."""
    found = written(_Surface(spark, sf_dir).cells)
    around = found.select("frame_id", *[(F.col(f"c{c}") - 1).alias(f"lo{c}") for c in "xyz"], *[(F.col(f"c{c}") + 2).alias(f"hi{c}") for c in "xyz"])
    return boundary.box_counts(found, around)


def octree_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.levels(_voxels(spark, sf_dir))


def octree_exact_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.exact_cut(voxels.voxelize(sources.points_of_lines(spark, sf_dir), H))


def octree_rect_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = octree.rectangular_cells(_voxels(spark, sf_dir))
    return cells.groupBy("frame_id").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("wx") * F.col("wy") * F.col("wz")).alias("voxels"))


def octree_partition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found in a partition that was damaged: cells left out, doubled, and moved to where nothing is."""
    v = written(_voxels(spark, sf_dir))
    whole = written(_boxes(v))
    kept = whole.where("pmod(lox, 3) != 0")
    moved = kept.where("pmod(loz, 4) = 2").withColumn("lox", F.col("lox") - 1000)
    return octree.partition_violations(kept.unionByName(kept.where("pmod(loy, 3) = 1")).unionByName(moved), v)


def octree_rect_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangular cells, undamaged: every voxel once and no other; with their number and volume."""
    v = written(_voxels(spark, sf_dir))
    cells = written(octree.rectangular_cells(v))
    sizes = cells.groupBy("frame_id").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("wx") * F.col("wy") * F.col("wz")).alias("covered"))
    return octree.partition_violations(cells, v).join(sizes, "frame_id")


def cell_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.cell_sources(_voxels(spark, sf_dir))


def convexity_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of each cell of the exact cut, moved up a voxel in x, beyond the cell's own planes: the upper four."""
    cells = octree.number_cells(_boxes(_voxels(spark, sf_dir)))
    p = octree.box_planes(cells.drop("cell_id"), H)
    normal = [F.when(F.col("axis") == k, F.col("sign")).otherwise(0).cast("double").alias(f"n{c}") for k, c in enumerate("xyz")]
    planes = p.select("frame_id", F.col("cell_id").cast("long").alias("cluster_id"), *normal, "offset")
    corner = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    at = [((F.col(f"lo{c}") + F.shiftright("k", i).bitwiseAND(1) * F.col(f"w{c}") + (1 if c == "x" else 0)) * F.lit(H)).alias(c) for i, c in enumerate("xyz")]
    found = clusters.convexity_violations(corner.select("frame_id", F.col("cell_id").cast("long").alias("cluster_id"), *at), planes, 1e-9)
    return found.groupBy("frame_id").agg(F.count(F.lit(1)).alias("clusters"), F.sum("beyond").alias("beyond"))


def _boxes(found: DataFrame) -> DataFrame:
    """Full cubes of the exact cut as boxes."""
    return bundles.cubes(found)


def aabb_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = octree.box_planes(_boxes(_voxels(spark, sf_dir)), H)
    return p.withColumn("offset", F.round("offset", 9) + F.lit(0.0))


def shared_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.shared_leaves(octree.box_planes(_boxes(_voxels(spark, sf_dir)), H))


def tree_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return octree.tree_size(_boxes(_voxels(spark, sf_dir)))


def cluster_union_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _embed(spark, sf_dir)
    q = octree.union_values(_neighbours(p), _boxes(voxels.voxelize(p, H)), H)
    return q.select("frame_id", "point_id", F.round("q", 9).alias("q"))


def free_prisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _Surface(spark, sf_dir, keep=True)
    out = None
    patched = written(s.patches)
    for axis in range(3):
        merged = sweep.free_prisms(patched, s.coords, axis)
        size = F.sum((F.col("hix") - F.col("lox")) * (F.col("hiy") - F.col("loy")) * (F.col("hiz") - F.col("loz")))
        one = merged.groupBy("frame_id").agg(size.alias("free_voxels")).withColumn("axis", F.lit(axis))
        out = one if out is None else out.unionByName(one)
    return out.select("frame_id", "axis", "free_voxels")


def sweep_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free rectangles of every slab along each axis."""
    s = _Surface(spark, sf_dir, keep=True)
    patched = written(s.patches)
    out = None
    for axis in range(3):
        one = sweep.sweep_rectangles(patched, s.coords, axis).withColumn("axis", F.lit(axis))
        out = one if out is None else out.unionByName(one)
    return out


def sweep_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each frame and axis under work limits that some pass: the limit, rectangles and cells that events covered."""
    s = _Surface(spark, sf_dir, keep=True)
    patched = written(s.patches)
    out = None
    for axis in range(3):
        _, status = sweep.swept(patched, s.coords, axis, TIGHT)
        done = [F.when(F.col("reason").isNull(), F.col(c)).otherwise(0).alias(c) for c in ("prisms", "updates")]
        one = status.select("frame_id", F.lit(axis).alias("axis"), F.coalesce("reason", F.lit("")).alias("reason"), *done)
        out = one if out is None else out.unionByName(one)
    return out


def free_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _Surface(spark, sf_dir)
    return boundary.free_adjacency(s.free, s.coords)


def prism_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of merged prisms that share a part of a face, numbered by area."""
    s = _Surface(spark, sf_dir, keep=True)
    return boundary.prism_adjacency(sweep.free_prisms(s.patches, s.coords, 2))


def axis_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best axis of each frame under work limits that some frames pass on some axes: those fall back to their obstacles."""
    s = _Surface(spark, sf_dir, keep=True)
    patched = written(s.patches)
    return sweep.best_axis([sweep.free_space(patched, s.coords, axis, TIGHT) for axis in range(3)], s.voxels)


def strict_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether half-grid probes are strictly free by each axis' function, fallbacks included."""
    s = _Surface(spark, sf_dir, keep=True)
    patched, p = written(s.patches), written(_probes(s.voxels).drop("point_id"))
    out = None
    for axis in range(3):
        space = sweep.free_space(patched, s.coords, axis, TIGHT)
        one = sweep.strictly_free(p, space, s.coords, s.voxels, H).select("frame_id", F.lit(axis).alias("axis"), "kx", "ky", "kz", "free", "fallback")
        out = one if out is None else out.unionByName(one)
    return out


def direct_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _Surface(spark, sf_dir, keep=True)
    q = arrangement.evaluate(_probes(s.voxels), s.programs(), gradient=False)
    return q.select("frame_id", "kx", "ky", "kz", F.signum("q").cast("int").alias("sign"))


def exported_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of the functions written as JSON, read back with all checks and evaluated by the general trees."""
    s = _Surface(spark, sf_dir, keep=True)
    texts = exports.program_json(s.programs())
    return trees.evaluate_json(_probes(s.voxels), texts).select("frame_id", "kx", "ky", "kz", F.signum(F.round("q", 9)).cast("int").alias("sign"))


def direct_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Surface(spark, sf_dir, keep=True).programs(intern=False).select("frame_id", "nodes", "shared", "expanded")


def box_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the functions of single boxes, stored, shared and written out, with strata and mismatches."""
    s = _Surface(spark, sf_dir, keep=True, found=_boxes_of_nations(spark, sf_dir))
    return s.programs(intern=False, certify=True).select("frame_id", "nodes", "shared", F.col("expanded").cast("long").alias("expanded"), "strata", "mismatches")


def strata_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _Surface(spark, sf_dir, keep=True)
    return s.programs(certify=True).select("frame_id", "strata", "mismatches")


def _first_cells(found: DataFrame) -> DataFrame:
    return found.groupBy("frame_id").agg(F.min(F.struct("cx", "cy", "cz")).alias("c")).select("frame_id", "c.*")


def sign_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mismatches by dimension of functions built without the first cell of each frame, and how many witnesses there are."""
    s = _Surface(spark, sf_dir, keep=True)
    cells = written(s.cells)
    wrong = cells.join(_first_cells(cells), ["frame_id", "cx", "cy", "cz"], "left_anti")
    found = arrangement.diagnose_programs(wrong, cells, s.coords, H)
    return found.select("frame_id", "dimension", "strata", "mismatches", F.size("witnesses").cast("long").alias("witnesses"))


def sign_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The witnesses of sign_diagnostics: place on each axis, sign and right sign."""
    s = _Surface(spark, sf_dir, keep=True)
    cells = written(s.cells)
    wrong = cells.join(_first_cells(cells), ["frame_id", "cx", "cy", "cz"], "left_anti")
    w = arrangement.diagnose_programs(wrong, cells, s.coords, H).select("frame_id", F.explode("witnesses").alias("w"))
    return w.select("frame_id", *[F.get("w", F.lit(i)).alias(c) for i, c in enumerate(("i", "j", "k", "got", "right"))])


def lse_bound_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of each sign, and those that break the bound, the order, the sign or the slope of the smoothed function."""
    s = _Surface(spark, sf_dir, keep=True)
    q = arrangement.evaluate(_probes(s.voxels), s.programs())
    gap = F.col("q_upper") - F.col("q")
    steep = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz"))
    slack = 1e-12
    return q.groupBy("frame_id").agg(
        *[F.count_if(F.signum("q") == v).alias(n) for v, n in ((-1, "free"), (0, "zero"), (1, "filled"))],
        F.count_if(gap < -slack).alias("below"),
        F.count_if(gap > F.col("bound") + slack).alias("beyond_bound"),
        F.count_if((F.col("q") > 0) & (F.col("q_upper") <= 0)).alias("false_free"),
        F.count_if(steep > 1 + 1e-9).alias("too_steep"),
    )


def box_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard and smoothed values, gradients and bounds of single boxes, at points taken from the suppliers."""
    s = _Surface(spark, sf_dir, keep=True, found=_boxes_of_nations(spark, sf_dir))
    k = F.col("s_suppkey")
    at = _spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"))
    p = at.select(k.alias("point_id"), (k % 11 / 10.0 - 0.31).alias("x"), (k % 7 / 10.0 - 0.33).alias("y"), (k % 9 / 20.0 + 0.07).alias("z")).crossJoin(s.coords.select("frame_id"))
    q = arrangement.evaluate(p, s.programs(), error=0.02)
    return q.select("frame_id", "point_id", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("q", "q_upper", "gx", "gy", "gz", "bound")])


def bent_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard and smoothed values, gradients and bounds of Ls, at points taken from the suppliers."""
    s = _Surface(spark, sf_dir, keep=True, found=_ls_of_nations(spark, sf_dir))
    k = F.col("s_suppkey")
    at = _spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"))
    p = at.select(k.alias("point_id"), (k % 11 / 10.0 - 0.31).alias("x"), (k % 7 / 10.0 - 0.33).alias("y"), (k % 9 / 20.0 + 0.07).alias("z")).crossJoin(s.coords.select("frame_id"))  # the question: every point in every frame
    q = arrangement.evaluate(p, s.programs(), error=0.02)
    return q.select("frame_id", "point_id", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in ("q", "q_upper", "gx", "gy", "gz", "bound")])


def bent_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of the Ls written out as SQL, how they are cut, and how long they are."""
    s = _Surface(spark, sf_dir, keep=True, found=_ls_of_nations(spark, sf_dir))
    cells = written(s.cells)
    programs = written(arrangement.build_programs(cells, s.coords, H))
    cuts = arrangement.program_splits(cells, s.coords, H)
    cuts = cuts.groupBy("frame_id").agg(F.count(F.lit(1)).alias("splits"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "axis", "coord"))), lambda c: F.concat_ws(":", c["axis"], c["coord"])), " ").alias("cuts"))
    return arrangement.expressions(programs).join(cuts, "frame_id").select("frame_id", F.col("expanded").cast("long").alias("expanded"), "text", "splits", "cuts")


def program_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of the functions against a damaged registry: every fifth coordinate is taken out, every seventh is there once more, far off."""
    s = _Surface(spark, sf_dir, keep=True)
    known = s.supports.where("coord % 5 != 0").unionByName(s.supports.where("coord % 7 = 0").withColumn("coord", F.col("coord") + 100_000))
    return arrangement.provenance(s.programs(), known)


def slope_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradients against central differences by kind of probe; those beside patches are turned before, and must be found."""
    s = _Surface(spark, sf_dir, keep=True)
    p = audit.surface_probes(s.voxels, s.patches, H).unionByName(audit.outer_probes(s.voxels, H))
    rows = arrangement.slope_errors(_spread(p), s.programs(), error=0.02)
    turn = F.when(F.col("kind") == "flank", -1.0).otherwise(1.0)
    off = F.greatest(*[F.abs(turn * F.col(f"g{c}") - F.col(f"d{c}")) for c in "xyz"])
    return rows.groupBy("frame_id", "kind").agg(F.count(F.lit(1)).alias("probes"), F.count_if(off > 1e-3).alias("differing"))


def direct_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles of the direct functions, written and read back: sizes of their tables and what the validation found."""
    s = _Surface(spark, sf_dir, keep=True)
    folder = staging_folder(spark)
    exports.write_bundle(spark, folder, bundles.direct_tables(s.voxels, s.faces, H), {"command": "function", "voxel_size": H})
    t = exports.read_bundle(spark, folder)
    sizes = {n: t[n].groupBy("frame_id").agg(F.count(F.lit(1)).alias(n)) for n in ("registry", "patches", "occupancy", "json", "expressions")}
    out = t["validation"].join(t["splits"].where("parent is null").groupBy("frame_id").agg(F.count(F.lit(1)).alias("roots")), "frame_id")
    for size in sizes.values():
        out = out.join(size, "frame_id")
    return out.select("frame_id", *sizes, "roots", "strata", "mismatches", "planes", "unexplained", "unused", "samples", "wrong", "ok")


def octree_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octree bundles by pruning, written and read back: sizes, how well cells part the voxels, and probes against the voxels."""
    s = _Surface(spark, sf_dir, keep=True)
    patched, out = written(s.patches), None
    for pruning in bundles.PRUNINGS:
        folder = staging_folder(spark)
        exports.write_bundle(spark, folder, bundles.octree_tables(s.voxels, patched, H, pruning), {"command": "octree", "voxel_size": H, "pruning": pruning})
        t = exports.read_bundle(spark, folder)
        stored = t["planes"].groupBy("frame_id").agg(F.count(F.lit(1)).alias("stored"))
        one = t["metrics"].join(stored, "frame_id").select("frame_id", F.lit(pruning).alias("pruning"), "cells", "planes", "nodes", "stored", "samples", "wrong", "uncovered", "overlapping", "outside", "ok")
        out = one if out is None else out.unionByName(one)
    return out


def sweep_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-space bundles under limits that some frames pass, written and read back: what was selected, and probes against the voxels."""
    s = _Surface(spark, sf_dir, keep=True)
    folder = staging_folder(spark)
    exports.write_bundle(spark, folder, bundles.sweep_tables(s.voxels, written(s.patches), written(s.supports), H, limits=TIGHT), {"command": "sweep", "voxel_size": H})
    m = exports.read_bundle(spark, folder)["metrics"]
    return m.select("frame_id", "axis", "fallback", "nodes", "candidates", "stored_prisms", (F.col("obstacles") > 0).alias("obstacles"), "samples", "wrong", "ok")


def reference_sdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of moved points to the patches, and the same with the sign of the closed union: positive in free space."""
    s = _Surface(spark, sf_dir, keep=True)
    p = _spread(_neighbours(s.points))
    d = voxels.contains(arrangement.patch_distance(p, s.patches, H), s.voxels, H)
    signed = F.when(F.col("inside"), -F.col("distance")).otherwise(F.col("distance"))
    return d.select("frame_id", "point_id", F.round("distance", 9).alias("distance"), (F.round(signed, 9) + F.lit(0.0)).alias("signed"))


def clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearances of a small arm in every frame, at configurations taken from the suppliers."""
    model, poses = _arm(spark, sf_dir)
    s = _Surface(spark, sf_dir, keep=True)
    return _clearances(robot.field_at(poses, s.coords, s.programs()), model)


def box_clearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same against single boxes, whose functions have a closed form."""
    model, poses = _arm(spark, sf_dir)
    s = _Surface(spark, sf_dir, keep=True, found=_boxes_of_nations(spark, sf_dir))
    return _clearances(robot.field_at(poses, s.coords, s.programs()), model)


def _clearances(field: DataFrame, model: robot.Model) -> DataFrame:
    found = robot.group_clearances(field, model)
    rounded = [(F.round(F.get("gradient", F.lit(k)), 6) + F.lit(0.0)).alias(f"g{k}") for k in range(model.dof)]
    exact = [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("distance", "hard_min", "bound")]
    return found.select("frame_id", "config_id", "joint", "link_index", *exact, "nearest_sphere", "spheres", *rounded)


def frame_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group clearances recomputed from their spheres; every seventh configuration's results are moved before."""
    model, poses = _arm(spark, sf_dir)
    s = _Surface(spark, sf_dir, keep=True, found=_boxes_of_nations(spark, sf_dir))
    field = written(robot.field_at(poses, s.coords, s.programs()))
    found = robot.group_clearances(field, model).withColumn("distance", F.col("distance") + F.when(F.col("config_id") % 7 == 0, 0.5).otherwise(0.0))
    return audit.clearance_differences(found, robot.sphere_clearances(field, model), robot.link_alpha(model, 1e-3))


def exported_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exported functions against the programs at strided points of each frame."""
    s = _Surface(spark, sf_dir, keep=True)
    programs = written(s.programs())
    return audit.exported_differences(s.points, programs, exports.program_json(programs))


def box_spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearance and joint of every sphere against single boxes; those of the static base have no joint."""
    model, poses = _arm(spark, sf_dir)
    s = _Surface(spark, sf_dir, keep=True, found=_boxes_of_nations(spark, sf_dir))
    c = robot.sphere_clearances(robot.field_at(poses, s.coords, s.programs()), model, margin=0.01)
    return c.select("frame_id", "config_id", "sphere_id", "joint", F.round("clearance", 6).alias("clearance"))


def clearance_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clearance documents of boxes and the arm, written and read back: what they say of the surface, the spheres and the groups."""
    model, poses = _arm(spark, sf_dir)
    s = _Surface(spark, sf_dir, keep=True, found=_boxes_of_nations(spark, sf_dir))
    field = written(robot.field_at(poses, s.coords, s.programs()))
    found = robot.described_groups(robot.group_clearances(field, model, 0.01), model)
    surface = exports.surface_summary(s.voxels, s.faces, s.patches, H)
    documents = exports.clearance_documents(found, robot.described_spheres(field, model, 0.01), surface, None, {"voxel_size": H, "margin": 0.01, "joint_order": ["turn", "lift", "swing"]})
    kind = """options struct<voxel_size:double,joint_order:array<string>>, surface struct<voxels:long,shared_faces:long,exposed_faces:long,merged_away:long,patches:array<struct<corners:array<array<double>>>>>,
      groups array<struct<joint:string,link:string,source_links:array<string>,hard_min:double>>, spheres array<struct<id:int,link:string,joint:string,clearance:double,radius:double>>"""
    d = written(documents).select("frame_id", "config_id", F.from_json("value", kind).alias("d"))
    total = F.aggregate("d.spheres", F.lit(0.0), lambda a, x: a + x["clearance"])
    low = F.array_min(F.transform("d.groups", lambda g: g["hard_min"]))
    return d.select(
        "frame_id", "config_id", "d.surface.voxels", "d.surface.shared_faces", "d.surface.exposed_faces", "d.surface.merged_away", F.size("d.surface.patches").alias("patches"),
        F.size("d.spheres").alias("spheres"), F.size(F.filter("d.spheres", lambda x: x["joint"].isNull())).alias("static"), F.array_join(F.transform("d.groups", lambda g: g["link"]), ",").alias("links"),
        F.array_join(F.flatten(F.transform("d.groups", lambda g: g["source_links"])), ",").alias("sources"), F.round(total, 5).alias("clearances"), F.round(low, 6).alias("least"),
    )


def sphere_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres of all spheres of the arm, turned only, at configurations taken from the suppliers."""
    model = robot.parse_urdf(robot.DEMO_URDF)
    o = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    q = F.array((F.col("s_suppkey") % 13) / 4.0, F.lit(0.0), F.lit(0.0))
    poses = robot.sphere_poses(o.select(F.col("s_suppkey").alias("config_id"), q.alias("q")), model)
    return poses.select("config_id", "sphere_id", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in "xyz"])


def arm_poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres and Jacobians (row-major, 3 x joints) of every sphere of the arm, at all its joints' configurations taken from the suppliers."""
    model, poses = _arm(spark, sf_dir)
    jac = [(F.round(F.get("jac", F.lit(k)), 9) + F.lit(0.0)).alias(f"j{'xyz'[k // model.dof]}{k % model.dof}") for k in range(3 * model.dof)]
    return poses.select("config_id", "sphere_id", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in "xyz"], *jac)


def frame_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.reuse_pattern(_event_frames(spark, sf_dir), 0.5)


def frame_reuse_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits where the last two distinct sets of voxels are kept."""
    return frames.reuse_pattern(_event_frames(spark, sf_dir), 0.5, capacity=2)


def frame_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same frames as a stream with state, each built, certified and reused."""
    done = frames.run_recorded(_event_frames(spark, sf_dir), 0.5, staging_folder(spark))
    return done.select("sensor_id", "frame_id", "voxels", "hit", "strata", "certified", "outside")


def _event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/events.parquet")
    return t.select(
        "event_type",
        F.floor(F.col("event_id") / 40).cast("long").alias("frame_id"),
        F.col("event_id").alias("point_id"),
        (F.col("event_id") % 3 / 3.0).alias("x"), (F.col("user_id") % 2 / 2.0).alias("y"), (F.col("event_id") % 2 / 2.0).alias("z"),
    ).withColumnRenamed("event_type", "sensor_id")


def frame_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame against the one before it, at a voxel size at which some are near."""
    v = _voxels(spark, sf_dir, 0.2)
    a = v.select(F.col("frame_id").alias("pair"), *voxels.AXES)
    b = v.select((F.col("frame_id") + 1).alias("pair"), *voxels.AXES)
    return voxels.same_occupancy(a, b)


def preprocess_voxel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = voxels.preprocess_voxel(_embed(spark, sf_dir), H)
    return p.select("frame_id", "ix", "iy", "iz", "points", *[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in "xyz"])


def displacement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _embed(spark, sf_dir)
    moved = shapes.jitter_within_voxels(p, H).select("frame_id", "point_id", *[F.col(c).alias(f"m{c}") for c in "xyz"])
    return voxels.displacement(p, moved)


def error_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, maximum, mean, root mean square and 95th percentile of a column of the order lines, by flag."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    error = F.col("l_extendedprice") / 1e5 - F.col("l_discount") * 10
    return voxels.summarize(t.select(F.col("l_returnflag").alias("flag"), error.alias("e")), "flag", "e")


def smooth_distance_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the smooth proxy -q_upper lies from the signed distance to the patches, by frame and kind of error.

    At the points of every frame, and at centres, corners and either side of patches. See ``audit.distance_errors``.
    """
    s = _Surface(spark, sf_dir, keep=True)
    probes = audit.surface_probes(s.voxels, s.patches, H).unionByName(
        s.points.select("frame_id", F.lit("point").alias("kind"), *"xyz", F.xxhash64("frame_id", F.lit("point"), "point_id").alias("point_id"))
    )
    probes = written(probes)
    q = arrangement.evaluate(probes, s.programs(), gradient=False)
    errors = audit.distance_errors(probes, q, arrangement.patch_distance(probes, s.patches, H), s.voxels, H)
    return voxels.summarize(errors.withColumn("by", F.struct("frame_id", "what")), "by", "error").select("by.*", "n", "max_error", "mean_error", "rmse", "p95")


def repeat_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower median of repeated measurements, taken from the events."""
    return voxels.median_of(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "value"), "event_type", "value")


#: Unit normals of planes, and a ray's ellipsoid.
NORMALS = [(0.6, 0.8, 0.0), (0.0, 0.6, 0.8), (0.8, 0.0, 0.6)]
ELLIPSOID = ((0.5, 0.4, 0.6), (0.4, 0.3, 0.5))


def _normal(which) -> tuple:
    return tuple(F.when(which == 0, a[0]).when(which == 1, a[1]).otherwise(a[2]) for a in zip(*NORMALS, strict=True))


def plane_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as points against planes, and whether two planes of a line are one."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n, m = _normal(F.col("l_linenumber") % 3), _normal(F.col("l_orderkey") % 3)
    p = (F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_extendedprice") / 1e5)
    value = plane_value(n, F.col("l_tax"), p)
    same = same_plane(n, F.col("l_tax"), m, F.col("l_discount"), 0.015)
    return t.groupBy((F.col("l_orderkey") % 100).alias("bucket")).agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(value), 6).alias("total"), F.round(F.max(value), 9).alias("most"), F.count_if(same).alias("same"))


def ray_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rays from order lines against an ellipsoid: the distance to the near root, the far one from inside, null if missed."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    origin = (F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_extendedprice") / 1e5)
    hit = ray_ellipsoid(origin, _normal(F.col("l_linenumber") % 3), *ELLIPSOID)
    return t.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"), F.round(hit, 6).alias("distance"))


def ideal_solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in a box of each embedding frame."""
    p = _embed(spark, sf_dir)
    held = inside_box(tuple(F.col(c) for c in "xyz"), (-0.1, -0.05, 0.0), (0.2, 0.15, 0.3))
    return p.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), F.count_if(held).alias("inside"))


def cloud_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as PLY, OFF and XYZ files, one a frame, and read back by splits."""
    p = _embed(spark, sf_dir)
    folder, out = staging_folder(spark), None
    for kind in ("ply", "off", "xyz"):
        exports.write_clouds(p, f"{folder}/{kind}", kind)
        back = sources.read_cloud(spark, f"{folder}/{kind}", kind)
        # A file's points by its own name: x, y and z of the n-th point of each file.
        n = F.row_number().over(Window.partitionBy("frame_id").orderBy("point_id")) - 1
        one = back.select(F.lit(kind).alias("kind"), n.cast("long").alias("n"), *"xyz")
        out = one if out is None else out.unionByName(one)
    return out


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed membership of moved points against an ideal ellipsoid."""
    p = _embed(spark, sf_dir)
    flagged = voxels.contains(_neighbours(p), voxels.voxelize(p, H), H)
    ideal = inside_ellipsoid(tuple(F.col(c) for c in "xyz"), (0.0, 0.0, 0.0), (0.3, 0.25, 0.2))
    both = flagged.withColumn("ideal", ideal)
    return both.groupBy("frame_id").agg(
        F.count_if(F.col("inside") & F.col("ideal")).alias("tp"), F.count_if(F.col("inside") & ~F.col("ideal")).alias("fp"),
        F.count_if(~F.col("inside") & F.col("ideal")).alias("fn"), F.count_if(~F.col("inside") & ~F.col("ideal")).alias("tn"),
    )


def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _embed(spark, sf_dir)
    counted = voxels.count_outside(_neighbours(p), voxels.voxelize(p, H), H)
    low, high = wilson(F.col("outside"), F.col("points"))
    return counted.select("frame_id", "points", "outside", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


def voxel_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = voxels.reservoir(sources.points_of_lines(spark, sf_dir), 0.2, 3, 7)
    return voxels.with_voxels(p, 0.2).groupBy(*voxels.KEY).agg(F.count(F.lit(1)).alias("kept"))


def depth_camera(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of what each view measures, and as one more frame of the cloud of one point a voxel over all views."""
    views = 10
    seen = shapes.depth_camera(spark, views)
    return voxels.bounds(voxels.voxelize(seen.unionByName(shapes.camera_cloud(seen, frame=views)), 0.04))


def case_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each named cloud of known size, and those that lie off its surface."""
    out = None
    for c in suite.suite(spark):
        if c.count is not None:
            off = F.count_if(c.off > 1e-9) if c.off is not None else F.lit(0).cast("long")
            one = c.points.agg(F.count(F.lit(1)).alias("points"), off.alias("off_surface")).select(F.lit(c.name).alias("name"), "points", "off_surface")
            out = one if out is None else out.unionByName(one)
    return out


def _prism(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    n = len(PRISM_RING)
    vertices = [(i + n * k, float(x), float(y), float(k)) for k in range(2) for i, (x, y) in enumerate(PRISM_RING)]
    caps = [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 5)]
    faces = [[a, c, b] for a, b, c in caps] + [[n + a, n + b, n + c] for a, b, c in caps]
    for i in range(n):
        j = (i + 1) % n
        faces += [[i, j, n + j], [i, n + j, n + i]]
    return meshes.parse_off(spark, meshes.write_off([v[1:] for v in vertices], faces))


def mesh_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and area of a prism scaled by each nation's key."""
    v, f = _prism(spark)
    one = meshes.volume(v, f)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 1).cast("double").alias("scale"))
    return nations.crossJoin(one).select("scale", F.round(F.col("volume") * F.pow("scale", F.lit(3)), 6).alias("volume"), F.round(F.col("area") * F.pow("scale", F.lit(2)), 6).alias("area"))


def _prisms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Upright prisms over regular polygons, one a nation: tables vertex (with mesh) and face (with mesh and k, its number there)."""
    m = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("mesh")).withColumn("n", 3 + F.col("mesh") % 6)
    at = m.select("mesh", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    turn, r = 2 * math.pi * F.col("i") / F.col("n"), F.col("mesh") + 1
    v = at.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "mesh", (F.col("mesh") * 64 + F.col("level") * 32 + F.col("i")).cast("int").alias("vertex_id"), (r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"), (F.col("mesh") * 10.0 + F.col("level")).alias("z")
    )
    base, i, j = F.col("mesh") * 64, F.col("i"), (F.col("i") + 1) % F.col("n")
    inner = (i >= 1) & (i <= F.col("n") - 2)
    quads = [
        (inner, (base, base + i + 1, base + i), i - 1),
        (inner, (base + 32, base + 32 + i, base + 33 + i), F.col("n") - 3 + i),
        (F.lit(True), (base + i, base + j, base + 32 + j), 2 * F.col("n") - 4 + 2 * i),
        (F.lit(True), (base + i, base + 32 + j, base + 32 + i), 2 * F.col("n") - 3 + 2 * i),
    ]
    listed = F.filter(F.array(*[F.when(where, F.struct(k.alias("k"), F.array(*[x.cast("int") for x in ring]).alias("v"))) for where, ring, k in quads]), lambda x: x.isNotNull())
    f = at.select("mesh", F.explode(listed).alias("f")).select("mesh", "f.k", (F.col("mesh") * 100 + F.col("f.k")).cast("int").alias("face_id"), "f.v")
    return v, f


def mesh_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the prisms by kind, with their length."""
    v, f = _prisms(spark, sf_dir)
    e = meshes.edge_kinds(v, f).withColumn("mesh", F.floor(F.col("a") / 64))
    return e.groupBy("mesh", "kind").agg(F.count(F.lit(1)).alias("edges"), F.round(F.sum("length"), 6).alias("length"))


def mesh_coplanar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of the prisms with the number and area of their faces."""
    v, f = _prisms(spark, sf_dir)
    return meshes.coplanar_groups(v, f).select("faces", F.round("area", 6).alias("area"))


def mesh_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and turned edges of the prisms, some of which lack a face or have one turned inside out."""
    _, f = _prisms(spark, sf_dir)
    hurt = f.where(~((F.col("k") == 1) & (F.col("mesh") % 3 == 0)))
    turned = F.when((F.col("k") == 0) & (F.col("mesh") % 2 == 1), F.reverse("v")).otherwise(F.col("v"))
    return meshes.validity(hurt.select("mesh", "face_id", turned.alias("v")), ["mesh"])


def _rows_of_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row of one to four unit boxes along x for each part, apart, touching or overlapping, some turned inside out: triangles."""
    p = _spread(spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("mesh")))
    b = p.withColumn("box", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mesh") % 4)))
    start = F.col("box") * F.element_at(F.array(F.lit(0.5), F.lit(1.0), F.lit(2.0)), (F.col("mesh") % 3 + 1).cast("int"))
    # Corners of a box are numbered by bits x, y, z; sides as rings seen from outside.
    rings = [(0, 4, 6, 2), (1, 3, 7, 5), (0, 1, 5, 4), (2, 6, 7, 3), (0, 2, 3, 1), (4, 5, 7, 6)]
    fans = F.array(*[F.array(*[F.lit(v) for v in t]) for r in rings for t in ((r[0], r[1], r[2]), (r[0], r[2], r[3]))])
    each = b.select("mesh", "box", start.alias("start"), F.posexplode(fans).alias("side", "ring"))
    turned = F.when((F.col("mesh") % 5 == 0) & (F.col("box") % 2 == 1), F.reverse("ring")).otherwise(F.col("ring"))
    each = each.withColumn("ring", turned)
    at = [F.get("ring", F.lit(k)) for k in range(3)]
    corner = [((F.shiftright(v, i).bitwiseAND(1)) + (F.col("start") if i == 0 else 0.0)).cast("double").alias(f"{c}{k}") for c, v in zip("abc", at, strict=True) for i, k in enumerate("xyz")]
    return each.select("mesh", (12 * F.col("box") + F.col("side")).alias("face_id"), *[(8 * F.col("box") + v).alias(f"v{c}") for c, v in zip("abc", at, strict=True)], *corner)


def surface_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of boxes: their parts, those that face inward, and whether faces cross."""
    found = surfaces.surface_validity(written(_rows_of_boxes(spark, sf_dir)), ["mesh"])
    return found.select("mesh", "faces", "flat_faces", "parts", "inward_parts", (F.col("crossings") > 0).alias("crossed"))


def coplanar_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected regions of one plane in rows of boxes, whose sides share planes: how many, their planes and area."""
    r = surfaces.regions(written(_rows_of_boxes(spark, sf_dir)), ["mesh"])
    plane = F.concat_ws(",", *[F.round(F.col(c), 6) + F.lit(0.0) for c in ("nx", "ny", "nz", "offset")])
    return r.groupBy("mesh").agg(
        F.count(F.lit(1)).alias("regions"), F.sum("faces").alias("faces"), F.count_distinct(plane).alias("planes"), F.round(F.sum("area"), 6).alias("area"), F.round(F.max("slack"), 6).alias("slack")
    )


def _cubes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cubes of six tetrahedra, of side (key + 1) / 10, one a nation: tables vertex and tet."""
    corners = [(i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)]
    six = [(k, [0, a, a | b, 7]) for k, (a, b) in enumerate([(1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2)])]
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("frame_id"))
    # Under a new name of its own, so that the two can meet again by frame.
    v = n.select((F.col("frame_id") + 0).alias("frame_id")).crossJoin(F.broadcast(spark.createDataFrame(corners, "vertex_id long, x double, y double, z double")))  # eight rows
    side = (F.col("frame_id") + 1) / 10
    t = n.crossJoin(F.broadcast(spark.createDataFrame(six, "tet_id long, v array<long>")))  # six rows
    return v.select("frame_id", "vertex_id", *[(F.col(c) * side).alias(c) for c in "xyz"]), t


def points_in_tets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points against the tetrahedra of each cube."""
    v, t = _cubes(spark, sf_dir)
    k = F.col("s_suppkey")
    p = _spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")).select(k.alias("point_id"), (k % 17 / 8.0 + 0.0123).alias("x"), (k % 13 / 7.0 + 0.0231).alias("y"), (k % 7 / 5.0 + 0.0317).alias("z"))
    found = meshes.points_in_tets(p.crossJoin(t.select("frame_id").distinct()), v, t)
    return found.select("frame_id", "point_id", (F.col("tets") > 0).alias("inside"))


def mesh_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as points by side of each cube's outer mesh, and how many the tetrahedra and the planes hold, and those off the boundary where they differ."""
    v, t = (written(x) for x in _cubes(spark, sf_dir))
    m = written(meshes.cluster_faces(t, t.select("frame_id", "tet_id", F.lit(0).alias("cluster_id")), v))
    k = F.col("s_suppkey")
    p = _spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")).select(k.alias("point_id"), (k % 5 / 4.0).alias("x"), (k % 7 / 6.0).alias("y"), (k % 3 / 2.0).alias("z"))
    placed = meshes.sides(p.crossJoin(t.select("frame_id").distinct()), m, 1e-9)
    both = meshes.points_in_clusters(meshes.points_in_tets(placed, v, t), m)
    off, held = F.col("side") != "boundary", F.col("side") == "bounded"
    return both.groupBy("frame_id").agg(
        *[F.count_if(F.col("side") == s).alias(s) for s in ("bounded", "boundary", "unbounded")],
        F.count_if(F.col("tets") > 0).alias("in_tets"), F.count_if(F.col("q") <= 1e-9).alias("in_planes"),
        F.count_if(off & ((held != (F.col("tets") > 0)) | (held != (F.col("q") < 0)))).alias("differing"),
    )


def reduced_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support planes of the cubes' twelve faces: one a side, at 0 or at the side's length."""
    v, t = (written(x) for x in _cubes(spark, sf_dir))
    m = meshes.cluster_faces(t, t.select("frame_id", "tet_id", F.lit(0).alias("cluster_id")), v)
    p = meshes.support_planes(m, 0.01)
    return p.groupBy("frame_id").agg(F.count(F.lit(1)).alias("planes"), F.sum("faces").alias("faces"), F.round(F.sum("offset"), 9).alias("offsets"), F.round(F.sum("area"), 9).alias("area"))


def mesh_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prisms as JSON documents, read back: how many vertices, edges and faces, and the edges' length."""
    v, f = _prisms(spark, sf_dir)
    texts = exports.mesh_documents(v, f, lambda vertex: F.floor(vertex / 64))
    kind = "struct<vertices:array<struct<x:double>>,edges:array<struct<length:double,left:int,right:int>>,faces:array<struct<area:double>>>"
    d = texts.select("mesh", F.from_json("value", kind).alias("d"))
    total = F.aggregate("d.edges", F.lit(0.0), lambda a, e: a + e["length"])
    return d.select("mesh", F.size("d.vertices").cast("long").alias("vertices"), F.size("d.edges").cast("long").alias("edges"), F.size("d.faces").cast("long").alias("faces"), F.round(total, 6).alias("length"))


def cluster_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The convex clusters of the cubes as outward meshes: faces, planes, volume and area."""
    v, t = _cubes(spark, sf_dir)
    v, t = written(v), written(t)
    m = meshes.cluster_faces(t, clusters.agglomerate_frames(v, t), v)
    a, b, c = (tuple(F.col(f"{p}{k}") for k in "xyz") for p in "abc")
    n = cross(minus(b, a), minus(c, a))
    unit = [F.round(x / length(n), 6) + F.lit(0.0) for x in n]
    flat = F.struct(*[u.alias(f"u{k}") for k, u in enumerate(unit)], F.round(dot(tuple(unit), a), 6).alias("o"))
    sums = m.groupBy("frame_id", "cluster_id").agg(
        F.count(F.lit(1)).alias("faces"), F.count_distinct(flat).alias("planes"), F.round(F.sum(dot(a, cross(b, c)) / 6), 9).alias("volume"), F.round(F.sum(length(n) / 2), 9).alias("area")
    )
    return sums.select("frame_id", "faces", "planes", "volume", "area")


def points_in_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which order lines fall inside the prism, by ship year."""
    v, f = _prism(spark)
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    at = t.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("point_id"), F.year("l_shipdate").cast("long").alias("frame_id"),
        (F.col("l_quantity") / 25.0 + 0.0123).alias("x"), (F.col("l_discount") * 20.0 + 0.0321).alias("y"), (F.col("l_extendedprice") / 6e4).alias("z"),
    )
    return meshes.points_in_mesh(at, v, f).groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), F.count_if("inside").alias("inside"))


def tet_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tetrahedra of a strip through the parts' keys, and what lies across each of their faces."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("tet_id"))
    t = p.select("tet_id", F.array(*[F.col("tet_id") + k for k in range(4)]).alias("v"))
    n = meshes.tet_neighbours(t)
    return n.select("tet_id", *[F.get("nbr", F.lit(k)).alias(f"n{k}") for k in range(4)])


def cluster_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trees.cluster_tree(octree.box_planes(_boxes(_voxels(spark, sf_dir)), H))
    return t.select("frame_id", "cells", "leaves", "references")


def plane_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes of the cells, each with its first equal within a tolerance, by frame."""
    p = octree.box_planes(_boxes(_voxels(spark, sf_dir)), H)
    normal = [F.when(F.col("axis") == k, F.col("sign")).otherwise(0).cast("double").alias(f"n{c}") for k, c in enumerate("xyz")]
    rows = p.select("frame_id", (F.col("cell_id") * 6 + F.col("axis") * 2 + (F.col("sign") > 0).cast("int")).cast("long").alias("plane_id"), *normal, "offset")
    return trees.dedupe_planes(rows, 1e-9).groupBy("frame_id").agg(F.count(F.lit(1)).alias("planes"), (F.max("leaf_id") + 1).alias("leaves"))


def face_contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of each boundary plane: their signed areas add up to its faces."""
    loops = audit.contours(_Surface(spark, sf_dir).faces)
    return loops.groupBy("frame_id", "axis", "sign", "plane").agg(F.sum("area").cast("long").alias("faces"), F.sum("corners").alias("corners"))


def probe_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of the function by kind of probe: centres, corners, either side of patches, around the frame and at random."""
    s = _Surface(spark, sf_dir, keep=True)
    p = audit.surface_probes(s.voxels, s.patches, H).unionByName(audit.outer_probes(s.voxels, H)).unionByName(audit.random_probes(s.voxels, H, 64))
    rows = arrangement.evaluate(p, s.programs(), gradient=False)
    signs = [F.count_if(F.signum("q") == v).alias(n) for v, n in ((-1, "free"), (0, "zero"), (1, "filled"))]
    return rows.groupBy("frame_id", "kind").agg(F.count(F.lit(1)).alias("probes"), *signs)


def zero_rays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros along rays through each patch, from a quarter voxel outside to a quarter voxel inside: on the patch, half way."""
    s = _Surface(spark, sf_dir, keep=True)
    p = s.patches
    mid = {k: (F.col(f"{k}0") + F.col(f"{k}1")) / 2 for k in "uv"}

    def at(axis: int, off: float):
        grid = F.when(F.col("axis") == axis, F.col("plane") + off * F.col("sign")).when((F.col("axis") + 1) % 3 == axis, mid["u"] + 0.01).otherwise(mid["v"] + 0.01)
        return grid * H

    rays = p.select("frame_id", F.xxhash64(*p.columns).alias("ray_id"), *[at(k, 0.25).alias(c) for k, c in enumerate("xyz")], *[at(k, -0.25).alias(f"i{c}") for k, c in enumerate("xyz")])
    z = audit.zero_rays(rays, s.programs(), 1e-3)
    return z.groupBy("frame_id").agg(
        F.count_if("ok").alias("good_ends"), F.round(F.sum("t"), 6).alias("sum_t"), F.count_if(F.col("t_smooth") <= F.col("t") + 1e-9).alias("in_order")
    )


def patch_meshes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.patch_mesh(_Surface(spark, sf_dir).patches, H).select("frame_id", "vertices", "faces")


def xyz_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points as text and back: every third written with two digits only, the others in full."""
    p = _embed(spark, sf_dir)
    short = F.col("point_id") % 3 == 0
    lines = p.select("frame_id", "point_id", F.concat_ws(" ", *[F.when(short, F.round(c, 2)).otherwise(F.col(c)).cast("string") for c in "xyz"]).alias("raw"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    back = sources.parse_xyz(lines).join(p.select("frame_id", "point_id", *[F.col(c).alias(f"b{c}") for c in "xyz"]), ["frame_id", "point_id"])
    same = (F.col("x") == F.col("bx")) & (F.col("y") == F.col("by")) & (F.col("z") == F.col("bz"))
    return back.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), F.count_if(~same).alias("changed"))


def hull_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of each frame's cells: boxes whose corners lie beyond a plane of it, which none may."""
    b = _boxes(_voxels(spark, sf_dir, 0.2)).withColumn("group_id", F.lit(0).cast("long"))
    planes = clusters.box_hulls(b)
    far = sum((F.col(f"n{c}") * F.col(f"lo{c}") + F.greatest(F.lit(0), F.col(f"n{c}")) * F.col(f"w{c}") for c in "yz"), F.col("nx") * F.col("lox") + F.greatest(F.lit(0), F.col("nx")) * F.col("wx"))
    # A plane of a hull is touched by a box, and none lies beyond it.
    return b.join(planes, ["frame_id", "group_id"]).groupBy("frame_id").agg(
        F.count_distinct("lox", "loy", "loz").alias("cells"), F.count_if(far > F.col("offset")).alias("beyond"),
        F.max(F.when((F.col("nx") == 1) & (F.col("ny") == 0) & (F.col("nz") == 0), F.col("offset"))).alias("most_x"),
    )


def strided_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen patches of each frame at even strides of their numbers."""
    p = boundary.number_patches(_Surface(spark, sf_dir).patches)
    return audit.strided(p, ["patch_id"], 16, [F.floor(F.col("patch_id") / 4096)]).select("frame_id", "patch_id")


def nearest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven nearest points of every point, itself first, by number, and the distance of the last."""
    found = neighbours.nearest(sources.points_of_embeddings(spark, sf_dir), 7)
    ids = F.array_join(F.transform("near", lambda o: o["id"].cast("string")), ",")
    return found.select("frame_id", "point_id", ids.alias("near"), F.round(F.sqrt(F.element_at("near", -1)["d2"]), 9).alias("distance"))


def point_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The average distance of a point from its six nearest, by frame."""
    return neighbours.spacing(sources.points_of_embeddings(spark, sf_dir), 6).select("frame_id", "points", F.round("spacing", 9).alias("spacing"))


def jet_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of sloping planes, one a nation of the supplier, smoothed: where they are afterwards, which is where they were."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("point_id"), (F.col("s_suppkey") % 2).cast("long").alias("frame_id"))
    x, y = (F.col("point_id") * 37 % 101) / 20, (F.col("point_id") * 53 % 97) / 30
    p = s.select("frame_id", "point_id", x.alias("x"), y.alias("y"), (x * 0.25 - y * 0.5 + F.col("frame_id")).alias("z"))
    j = neighbours.jet_smooth(p, 12)
    return j.select("frame_id", "point_id", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in "xyz"], "moved")


def jet_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points moved onto local quadratic surfaces, by frame: how many were and how far at most."""
    p = sources.points_of_embeddings(spark, sf_dir)
    j = clusters.jet_smooth(p, 0.08).select("frame_id", "point_id", *[F.col(c).alias(f"m{c}") for c in "xyz"], "moved")
    return p.join(j, ["frame_id", "point_id"]).groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), F.count_if("moved").alias("moved"))


def tet_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex clusters of the six tetrahedra of a cube, once for each nation."""
    v, t = _cubes(spark, sf_dir)
    c = clusters.agglomerate_frames(v, t)
    return c.groupBy("frame_id").agg(F.count(F.lit(1)).alias("tets"), F.count_distinct("cluster_id").alias("clusters"))


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bars and Ls of cubes of six tetrahedra each, one for every eighth part: tables vertex and tet."""
    k = _spread(spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 8 = 0").select(F.col("p_partkey").cast("long").alias("frame_id")))
    n = (F.col("frame_id") / 8) % 3 + 2
    bent = F.floor(F.col("frame_id") / 8) % 2 == 1
    cube = k.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n)))).withColumn("bent", bent & (F.col("i") == F.floor(n)))
    # The last cube of an L lies beside the first.
    cube = cube.select("frame_id", "i", F.when(F.col("bent"), 0).otherwise(F.col("i")).alias("cx"), F.col("bent").cast("long").alias("cy"))
    corner = cube.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(7)))).select("frame_id", "i", "v", *[(F.col(f"c{c}") + F.shiftright("v", b).bitwiseAND(1)).alias(c) for c, b in (("x", 0), ("y", 1))], F.shiftright("v", 2).cast("long").alias("z"))
    number = (F.col("x") * 10 + F.col("y")) * 10 + F.col("z")
    corner = written(corner.withColumn("vertex_id", number))
    six = [[0, a, a | b, 7] for a, b in ((1, 2), (1, 4), (2, 1), (2, 4), (4, 1), (4, 2))]
    ring = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.array(*[F.lit(v) for v in t]).alias("t")) for j, t in enumerate(six)]))
    named = corner.groupBy("frame_id", "i").agg(F.map_from_entries(F.collect_list(F.struct("v", "vertex_id"))).alias("names")).withColumn("s", ring)
    tets = written(named.select("frame_id", (6 * F.col("i") + F.col("s.j")).alias("tet_id"), F.transform("s.t", lambda v: F.element_at("names", v)).alias("v")))
    return written(corner.select("frame_id", "vertex_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).distinct()), tets


def tet_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of bars and Ls of cubes of six tetrahedra each: fewer than tetrahedra, their volume, and no corner beyond a plane."""
    vertices, tets = _blocks(spark, sf_dir)
    found = written(clusters.agglomerate_frames(vertices, tets))
    faces = written(meshes.cluster_faces(tets, found, vertices))
    v6 = sum((F.col(f"a{a}") * (F.col(f"b{b}") * F.col(f"c{c}") - F.col(f"b{c}") * F.col(f"c{b}")) for a, b, c in ("yzx", "zxy")), F.col("ax") * (F.col("by") * F.col("cz") - F.col("bz") * F.col("cy")))
    sizes = faces.groupBy("frame_id").agg(F.count_distinct("cluster_id").alias("clusters"), F.round(F.sum(v6) / 6, 9).alias("volume"))
    planes = meshes.support_planes(faces).select("frame_id", F.col("cluster_id").cast("long").alias("cluster_id"), "nx", "ny", "nz", "offset")
    at = tets.join(found, ["frame_id", "tet_id"]).select("frame_id", "cluster_id", F.explode("v").alias("vertex_id")).distinct().join(vertices, ["frame_id", "vertex_id"])
    beyond = clusters.convexity_violations(at, planes, 1e-9).groupBy("frame_id").agg(F.sum("beyond").alias("beyond"))
    tetras = tets.groupBy("frame_id").agg(F.count(F.lit(1)).alias("tets"))
    return sizes.join(beyond, "frame_id").join(tetras, "frame_id").select("frame_id", "tets", (F.col("clusters") < F.col("tets")).alias("merged"), "volume", "beyond")


def tet_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle of the bars and Ls, written and read back: sizes, probes by side, and how far tetrahedra, clusters and tree agree."""
    vertices, tets = _blocks(spark, sf_dir)
    folder = staging_folder(spark)
    exports.write_bundle(spark, folder, bundles.tet_tables(vertices, tets, bundles.random_points(vertices, 32)), {"command": "tets"})
    found = exports.read_bundle(spark, folder)
    m = found["metrics"].join(found["trees"].select("frame_id", F.length("json").alias("text")), "frame_id")
    rounded = [F.round(c, 9).alias(c) for c in ("surface_volume", "mesh_volume")]
    return m.select("frame_id", "tets", "surface_faces", *rounded, "samples", "bounded", "boundary", "unbounded", "tets_differ", "clusters_differ", "added", "missed", (F.col("text") > 0).alias("written"), "ok")


def swept_hulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of a cube and the same moved by the nation's key on all axes: twelve planes, whose offsets are known."""
    k = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") + 1).cast("long").alias("frame_id"))
    b = k.withColumn("low", F.explode(F.array(F.lit(0).cast("long"), F.col("frame_id"))))
    boxes = b.select("frame_id", F.lit(0).cast("long").alias("group_id"), *[F.col("low").alias(f"lo{c}") for c in "xyz"], *[F.lit(1).cast("long").alias(f"w{c}") for c in "xyz"])
    p = clusters.box_hulls(boxes)
    return p.groupBy("frame_id").agg(F.count(F.lit(1)).alias("planes"), F.sum("offset").alias("offsets"), F.sum(F.abs("nx") + F.abs("ny") + F.abs("nz")).alias("normals"))


def hull_approximation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex clusters of single boxes: however the octree cuts a box, its hull is the box."""
    c = hulls.approximate_frames(_boxes_of_nations(spark, sf_dir), h=H)
    return c.select("frame_id", "voxels", F.size("planes").alias("planes"), F.round("volume", 9).alias("volume"), "bound")


def _shapes_of_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of an L, a cube with a cavity or a staircase a nation, of sizes that go by its key."""
    k = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("frame_id"))
    a, b, c, n = (F.lit(low) + F.col("frame_id") % m for low, m in ((2, 3), (2, 4), (1, 2), (2, 4)))
    k = k.withColumns({"a": a, "b": b, "c": c, "n": n})
    for axis in "xyz":
        k = k.withColumn(axis, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    bent = (F.col("z") < F.col("c")) & (((F.col("x") < F.col("a")) & (F.col("y") == 0)) | ((F.col("y") < F.col("b")) & (F.col("x") == 0)))
    hollow = (F.greatest("x", "y", "z") < 3) & ~((F.col("x") == 1) & (F.col("y") == 1) & (F.col("z") == 1))
    stair = (F.col("z") < F.col("c")) & (F.col("x") + F.col("y") < F.col("n"))
    held = F.when(F.col("frame_id") % 3 == 0, bent).when(F.col("frame_id") % 3 == 1, hollow).otherwise(stair)
    at = [(F.col(axis) + F.col("frame_id") % m - 3).alias(f"i{axis}") for axis, m in zip("xyz", (7, 5, 4), strict=True)]
    return k.where(held).select("frame_id", *at)


def hull_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether frames that are no boxes become one cell within a distance, its volume and planes, and whether its bound is right."""
    c = hulls.approximate_frames(_shapes_of_nations(spark, sf_dir), hulls.Budget(inflation=10.0, distance=oracles.FILL), H)
    r = hulls.report(c).join(c.groupBy("frame_id").agg(F.sum("voxels").alias("voxels"), F.sum("volume").alias("volume")), "frame_id")
    whole, k = F.col("clusters") == 1, F.col("frame_id")
    notch = F.when(k % 3 == 0, (1 + k % 3) * (1 + k % 4) / (2 + k % 3 + k % 4)).otherwise(0.5)  # of the farthest point of the hull
    right = ~whole | ((F.col("bound") >= notch - 1e-9) & (F.col("bound") <= oracles.FILL))
    return r.select(
        "frame_id", "voxels", whole.alias("whole"), F.when(whole, F.round("volume", 6)).otherwise(0.0).alias("volume"), F.when(whole, F.col("planes")).otherwise(0).alias("planes"),
        right.alias("bound_right"), "complete", (F.col("refused_distance") > 0).alias("too_far"),
    )


def tree_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of one to three cells in their text forms, simplified, with their sizes, after a round trip through JSON."""
    k = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("frame_id"))

    def run(batches):
        for frame in batches:
            rows = []
            for f in frame["frame_id"]:
                cells = [("MAX", *range(6 * i, 6 * i + 6)) for i in range(f % 3 + 1)]
                # As a builder would leave it: nested, with a cell twice.
                raw = ("MIN", ("MIN", *cells), cells[0])
                tree, planes = trees.from_json(trees.to_json(trees.simplify(raw), [(1.0, 0.0, 0.0, float(i)) for i in range(6 * len(cells))]))
                rows.append((f, trees.boolean_text(tree), trees.scalar_text(tree), trees.depth(tree), trees.leaf_references(tree), len(trees.serialize(tree)), trees.dot_text(tree).count("->"), len(planes)))
            yield pd.DataFrame(rows, columns=["frame_id", "boolean", "scalar", "depth", "references", "nodes", "arrows", "planes"])

    return k.mapInPandas(run, "frame_id long, boolean string, scalar string, depth int, references int, nodes int, arrows int, planes int")


def zero_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zeros of single boxes' functions on the edges of a grid."""
    s = _Surface(spark, sf_dir, keep=True, found=_boxes_of_nations(spark, sf_dir))
    z = audit.zero_cells(_spread(written(s.programs())), (-0.35, -0.45, 0.05), 0.07, (14, 12, 11))
    return z.select("frame_id", "axis", "i", "j", "k", F.round("zero", 9).alias("zero"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "surface_summary": flagship,
    "xyz_lines": xyz_lines,
    "voxel_index": voxel_index,
    "voxel_distinct": voxel_distinct,
    "voxel_bounds": voxel_bounds,
    "voxel_stats": voxel_stats,
    "voxel_corners": voxel_corners,
    "contains_closed": contains_closed,
    "outside_count": outside_count,
    "expected_sign": expected_sign,
    "exposed_faces": exposed_faces,
    "boundary_patches": boundary_patches,
    "line_patches": line_patches,
    "patch_corners": patch_corners,
    "support_planes": support_planes,
    "support_patches": support_patches,
    "registry_check": registry_check,
    "canonical_cells": canonical_cells,
    "cell_box_sums": cell_box_sums,
    "octree_levels": octree_levels,
    "octree_exact_cut": octree_exact_cut,
    "cell_box_counts": cell_box_counts,
    "octree_rect_cover": octree_rect_cover,
    "octree_partition_check": octree_partition_check,
    "octree_rect_check": octree_rect_check,
    "cell_sources": cell_sources,
    "convexity_check": convexity_check,
    "aabb_planes": aabb_planes,
    "shared_leaves": shared_leaves,
    "tree_size": tree_size,
    "cluster_union_eval": cluster_union_eval,
    "free_prisms": free_prisms,
    "sweep_rectangles": sweep_rectangles,
    "sweep_status": sweep_status,
    "free_adjacency": free_adjacency,
    "prism_adjacency": prism_adjacency,
    "axis_selection": axis_selection,
    "strict_free": strict_free,
    "direct_sign": direct_sign,
    "direct_programs": direct_programs,
    "strata_certificate": strata_certificate,
    "lse_bound_audit": lse_bound_audit,
    "reference_sdf": reference_sdf,
    "sphere_poses": sphere_poses,
    "arm_poses": arm_poses,
    "clearance": clearance,
    "box_clearance": box_clearance,
    "box_spheres": box_spheres,
    "clearance_bundle": clearance_bundle,
    "frame_audit": frame_audit,
    "exported_audit": exported_audit,
    "box_values": box_values,
    "bent_values": bent_values,
    "bent_expressions": bent_expressions,
    "program_provenance": program_provenance,
    "slope_audit": slope_audit,
    "direct_bundle": direct_bundle,
    "octree_bundle": octree_bundle,
    "sweep_bundle": sweep_bundle,
    "tet_bundle": tet_bundle,
    "box_programs": box_programs,
    "exported_sign": exported_sign,
    "sign_diagnostics": sign_diagnostics,
    "sign_witnesses": sign_witnesses,
    "frame_reuse": frame_reuse,
    "frame_reuse_of_two": frame_reuse_of_two,
    "frame_stream": frame_stream,
    "frame_equality": frame_equality,
    "preprocess_voxel": preprocess_voxel,
    "displacement_stats": displacement_stats,
    "error_summary": error_summary,
    "smooth_distance_error": smooth_distance_error,
    "repeat_median": repeat_median,
    "plane_values": plane_values,
    "ray_hits": ray_hits,
    "ideal_solids": ideal_solids,
    "cloud_round_trip": cloud_round_trip,
    "confusion": confusion,
    "wilson_ci": wilson_ci,
    "voxel_reservoir": voxel_reservoir,
    "depth_camera": depth_camera,
    "case_suite": case_suite,
    "mesh_volume": mesh_volume,
    "mesh_edges": mesh_edges,
    "mesh_coplanar": mesh_coplanar,
    "mesh_validity": mesh_validity,
    "surface_validity": surface_validity,
    "coplanar_regions": coplanar_regions,
    "points_in_tets": points_in_tets,
    "cluster_meshes": cluster_meshes,
    "mesh_sides": mesh_sides,
    "reduced_planes": reduced_planes,
    "mesh_documents": mesh_documents,
    "points_in_mesh": points_in_mesh,
    "tet_neighbours": tet_neighbours,
    "cluster_tree": cluster_tree,
    "plane_dedupe": plane_dedupe,
    "face_contours": face_contours,
    "probe_audit": probe_audit,
    "zero_rays": zero_rays,
    "patch_meshes": patch_meshes,
    "xyz_round_trip": xyz_round_trip,
    "hull_containment": hull_containment,
    "strided_patches": strided_patches,
    "nearest_points": nearest_points,
    "point_spacing": point_spacing,
    "jet_surfaces": jet_surfaces,
    "jet_smoothing": jet_smoothing,
    "tet_clusters": tet_clusters,
    "tet_blocks": tet_blocks,
    "swept_hulls": swept_hulls,
    "hull_approximation": hull_approximation,
    "hull_shapes": hull_shapes,
    "tree_texts": tree_texts,
    "zero_set": zero_set,
}
ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
