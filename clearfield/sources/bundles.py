"""Bundles of whole pipelines: every table that a reader needs to check a result without building it again."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import arrangement, audit, boundary, clusters, meshes, octree, sweep, trees, voxels
from ..operators.meet import meet
from . import exports
from .staging import written

#: Points on a mesh by so little are on its boundary, where rounding may decide.
BAND = 1e-9
#: Digits of a length in a packed side, and trees that a task remembers.
HEAD, MOST_KNOWN = 12, 1024


def samples_of(found: DataFrame, patched: DataFrame, programs: DataFrame, h: float, random: int = 64, error: float = 0.0) -> DataFrame:
    """Probes of every kind with the function's value, the right sign by the voxels, and ok: whether it has that sign.

    With error, the smoothed value and its bound too. Probes on a support are on the rounded plane itself, so that a
    zero is a zero.
    """
    probes = audit.surface_probes(found, patched, h).unionByName(audit.outer_probes(found, h)).unionByName(audit.random_probes(found, h, random))
    q = arrangement.evaluate(probes, programs, error=error or 1e-3, gradient=False)
    extra = ["q_upper", "bound"] if error else []
    rows = voxels.closed_sign(q, found, h).withColumn("expected", F.col("sign").cast("int"))
    return rows.select("frame_id", "kind", *"xyz", "q", *extra, "expected", (F.signum("q").cast("int") == F.col("expected")).alias("ok"))


def direct_tables(found: DataFrame, faces: DataFrame, h: float, most_nodes: int = 100_000, random: int = 64, error: float = 0.0) -> dict[str, DataFrame]:
    """Tables of a direct function's bundle by name, from a frame's voxels and exposed faces.

    registry: supports in order; patches; occupancy: the voxels; splits: how the function was cut; programs, json and
    expressions (null beyond most_nodes); samples; validation: one row a frame with strata, mismatches, the planes of the
    function, those that no support explains, supports without a plane, samples, wrong ones, and whether all is well.
    A frame with a wrong sign anywhere is in the bundle with ok = false; nothing is left out.
    """
    patched, planes = written(boundary.number_patches(boundary.patches(faces))), written(boundary.supports(faces))
    coords = written(boundary.coordinates(planes))
    cells = written(boundary.cells(found, coords))
    programs = written(arrangement.build_programs(cells, coords, h, certify=True))
    samples = written(samples_of(found, patched, programs, h, random, error))
    seen = samples.groupBy("frame_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(~F.col("ok")).alias("wrong"))
    report = programs.select("frame_id", "nodes", "shared", "expanded", "strata", "mismatches").join(arrangement.provenance(programs, planes), "frame_id").join(seen, "frame_id")
    well = (F.col("mismatches") == 0) & (F.col("unexplained") == 0) & (F.col("unused") == 0) & (F.col("wrong") == 0)
    return {
        "registry": planes, "patches": patched, "occupancy": found, "splits": arrangement.program_splits(cells, coords, h), "programs": programs,
        "json": exports.program_json(programs), "expressions": arrangement.expressions(programs, most_nodes), "samples": samples, "validation": report.withColumn("ok", well),
    }


def cubes(found: DataFrame) -> DataFrame:
    """The exact octree cut of voxels as boxes lo*, w* in voxels."""
    cut = octree.exact_cut(found).join(voxels.bounds(found).select("frame_id", *[f"min_{a}" for a in voxels.AXES]), "frame_id")
    width = F.expr("shiftleft(1L, level)")
    lows = [(F.expr(f"shiftleft(n{a[1]}, level)") + F.col(f"min_{a}")).alias(f"lo{a[1]}") for a in voxels.AXES]
    return cut.select("frame_id", *lows, *[width.alias(f"w{c}") for c in "xyz"])


def single_voxels(found: DataFrame) -> DataFrame:
    """Voxels as boxes lo*, w*."""
    one = F.lit(1).cast("long")
    return found.select("frame_id", *[F.col(a).alias(f"lo{a[1]}") for a in voxels.AXES], *[one.alias(f"w{c}") for c in "xyz"])


#: What cells may be made of, from the fewest to the most.
PRUNINGS = {"rect": octree.rectangular_cells, "exact": cubes, "none": single_voxels}


def octree_tables(found: DataFrame, patched: DataFrame, h: float, pruning: str = "rect", random: int = 64) -> dict[str, DataFrame]:
    """Tables of an octree's bundle by name, from a frame's voxels and merged patches.

    levels: nodes that hold voxels; cells: boxes by the pruning (rect: cubes and smallest covers of siblings, exact:
    cubes, none: voxels); planes: six a cell; leaves: those that differ; trees: MIN over cells of MAX of planes as JSON;
    samples: probes with the value of the cells (q), that of the text (exported) and ok, whether both say what the voxels say;
    metrics: one row a frame with the tree's size, voxels that no cell or several cover, covered places without a voxel,
    samples and wrong ones. A point is inside where a value is at most 0.
    """
    cells = written(octree.number_cells(PRUNINGS[pruning](found)))
    planes = written(octree.box_planes(cells, h))
    made = written(trees.cluster_tree(planes))
    probes = audit.surface_probes(found, patched, h).unionByName(audit.outer_probes(found, h)).unionByName(audit.random_probes(found, h, random))
    valued = octree.union_values(probes, cells, h).withColumnRenamed("q", "value")
    both = trees.evaluate_json(valued, made.select("frame_id", F.col("tree").alias("json"))).withColumnRenamed("q", "exported").withColumnRenamed("value", "q")
    right = F.col("sign") >= 0
    rows = voxels.closed_sign(both, found, h).withColumn("ok", ((F.col("q") <= 0) == right) & ((F.col("exported") <= 0) == right))
    samples = written(rows.select("frame_id", "kind", *"xyz", "q", "exported", F.col("sign").cast("int").alias("expected"), "ok"))
    seen = samples.groupBy("frame_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(~F.col("ok")).alias("wrong"))
    metrics = octree.tree_size(cells).join(made.select("frame_id", "leaves"), "frame_id").join(octree.partition_violations(cells, found), "frame_id").join(seen, "frame_id")
    well = F.col("uncovered") + F.col("overlapping") + F.col("outside") + F.col("wrong") == 0
    return {
        "levels": octree.levels(found), "cells": cells, "planes": planes, "leaves": octree.shared_leaves(planes), "trees": made, "samples": samples,
        "metrics": metrics.withColumn("ok", well),
    }


def sweep_tables(found: DataFrame, patched: DataFrame, planes: DataFrame, h: float, axes: tuple[int, ...] = (0, 1, 2), limits: sweep.Limits = sweep.Limits(), passes: int = 4, random: int = 64) -> dict[str, DataFrame]:
    """Tables of a free-space bundle by name, from a frame's voxels, merged patches and supports.

    candidates: what became of each frame on each axis; selection: the smallest function by frame, prisms: its
    prisms; obstacles: the boxes of frames that fell back; supports and patches; samples: probes, whether the selected
    function is strictly free there, and ok, whether the voxels say the same; metrics: the selection with how many candidates,
    prisms, obstacles, samples and wrong ones there are.
    """
    coords = written(boundary.coordinates(planes))
    spaces = [sweep.free_space(patched, coords, k, limits, passes) for k in axes]
    best = written(sweep.best_axis(spaces, found))
    status = reduce(DataFrame.unionByName, [s.status.withColumn("axis", F.lit(s.axis)) for s in spaces])
    made = reduce(DataFrame.unionByName, [s.prisms.withColumn("axis", F.lit(s.axis)) for s in spaces])
    prisms = written(made.join(best.where("not fallback").select("frame_id", "axis"), ["frame_id", "axis"], "left_semi"))
    obstacles = written(sweep.obstacle_boxes(found, best.where("fallback")))
    probes = written(audit.surface_probes(found, patched, h).unionByName(audit.outer_probes(found, h)).unionByName(audit.random_probes(found, h, random)))
    held = [probes.join(best.where(F.col("axis") == s.axis).select("frame_id"), "frame_id", "left_semi") for s in spaces]
    said = reduce(DataFrame.unionByName, [sweep.strictly_free(p, s, coords, found, h) for p, s in zip(held, spaces, strict=True)])
    signed = voxels.closed_sign(said, found, h)
    samples = written(signed.select("frame_id", "kind", *"xyz", "free", "fallback", F.col("sign").cast("int").alias("expected"), (F.col("free") == (F.col("sign") < 0)).alias("ok")))
    metrics = best.join(samples.groupBy("frame_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(~F.col("ok")).alias("wrong")), "frame_id")
    for name, table in (("candidates", status), ("stored_prisms", prisms), ("obstacles", obstacles)):
        metrics = metrics.join(table.groupBy("frame_id").agg(F.count(F.lit(1)).alias(name)), "frame_id", "left").na.fill(0, [name])
    return {
        "selection": best, "candidates": status, "prisms": prisms, "obstacles": obstacles, "supports": planes, "patches": patched, "samples": samples,
        "metrics": metrics.withColumn("ok", F.col("wrong") == 0),
    }


def plane_trees(planes: DataFrame) -> DataFrame:
    """Rows (frame_id, json): the tree of a frame's convex clusters, MIN over clusters of MAX of planes, simplified.

    planes: frame_id, cluster_id, nx, ny, nz, offset. A value of at most 0 is inside. Equal planes are one leaf.
    """

    def text(rows: np.ndarray) -> str:
        known: dict[tuple[float, ...], int] = {}
        parts: dict[float, list[int]] = {}
        for c, *p in rows.tolist():
            parts.setdefault(c, []).append(known.setdefault(tuple(p), len(known)))
        tree = trees.simplify(("MIN", *[("MAX", *leaves) for leaves in parts.values()]))
        return trees.to_json(tree, list(known))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, str] = {}
        for frame in frames:
            made = []
            for p in frame["planes"]:
                rows = np.asarray(p, dtype=np.float64).reshape(-1, 5)
                key = rows.tobytes()
                if key not in known:
                    if len(known) >= MOST_KNOWN or len(rows) > MOST_KNOWN:
                        known.clear()
                    known[key] = text(rows)
                made.append(known[key])
            yield pd.DataFrame({"frame_id": frame["frame_id"], "json": made})

    # Frames of equal planes have their tree once a task.
    row = F.array(F.col("cluster_id").cast("double"), "nx", "ny", "nz", "offset")
    return planes.groupBy("frame_id").agg(F.flatten(F.sort_array(F.collect_list(row))).alias("planes")).mapInPandas(run, "frame_id long, json string")


def random_points(vertices: DataFrame, count: int, seed: float = 0.5) -> DataFrame:
    """``count`` points of each frame spread evenly over its vertices' bounds and a quarter of their extent around: frame_id, point_id, x, y, z."""
    at = vertices.groupBy("frame_id").agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])
    at = at.withColumn("point_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(count).cast("long"))))

    def place(k: int, c: str):
        run = F.lit(seed) + F.col("point_id") * F.lit(audit.STEPS[k])
        return (F.col(f"lo_{c}") + (1.5 * (run - F.floor(run)) - 0.25) * (F.col(f"hi_{c}") - F.col(f"lo_{c}"))).alias(c)

    return at.select("frame_id", "point_id", *[place(k, c) for k, c in enumerate("xyz")])


def _judged(probes: DataFrame, frames: DataFrame, texts: DataFrame) -> DataFrame:
    """probes, all columns, with side (``meshes.sides`` of the surface), tets (how many hold them), cluster_value (``meshes.points_in_clusters``)
    and q (of their frame's tree). frames: ``clusters.clustered_frames``. All four come from one meeting of points and frames."""
    parts = ["surface", "corners", "faces", "json"]
    sides = frames.join(texts.hint("merge"), "frame_id").withColumn("json", F.encode("json", "UTF-8"))
    heads = [F.encode(F.lpad(F.length(c).cast("string"), HEAD, "0"), "UTF-8") for c in parts]
    sides = sides.select("frame_id", F.concat(*heads, *parts).alias("side"))

    def unpack(side: bytes) -> tuple:
        ends = np.cumsum([HEAD * len(parts), *(int(side[HEAD * k : HEAD * (k + 1)]) for k in range(len(parts)))])
        surface, corners, faces, text = (side[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))
        return (np.frombuffer(surface).reshape(-1, 10)[:, 1:].reshape(-1, 3, 3), np.frombuffer(corners).reshape(-1, 4, 3), np.frombuffer(faces).reshape(-1, 10), *trees.shared_json(text.decode()))

    def compute(pts: pd.DataFrame, side: tuple) -> dict[str, np.ndarray]:
        x, (surface, corners, faces, rows, planes) = pts[["x", "y", "z"]].to_numpy(dtype=np.float64), side
        return {
            "inside": meshes.in_triangles(x, surface), "on": meshes.on_triangles(x, surface, BAND), "tets": meshes.in_tets(x, corners),
            "cluster_value": meshes.cluster_values(x, faces), "q": trees.shared_values(x, rows, planes),
        }

    both = meet(probes, sides, unpack, compute, "inside boolean, on boolean, tets long, cluster_value double, q double", weight=lambda side: len(side[3]), alike=True)
    side = F.when(F.col("on"), "boundary").when(F.col("inside"), "bounded").otherwise("unbounded").alias("side")
    return both.select(*[F.col(f"`{c}`") for c in probes.columns], side, "tets", "cluster_value", "q")


def tet_tables(vertices: DataFrame, tets: DataFrame, probes: DataFrame, angle: float = 0.0, **limits: int) -> dict[str, DataFrame]:
    """Tables of the bundle of given tetrahedra by name.

    vertices: frame_id, vertex_id, x, y, z; tets: frame_id, tet_id, v; probes: frame_id, point_id, x, y, z; angle:
    faces within it share a support plane, which may add to a cluster but never cuts it; limits: those of
    ``clusters.agglomerate_frames``. surface: outer triangles; clusters; meshes: outward triangles by cluster; planes; trees;
    samples: each probe with its side of the surface and what tetrahedra, clusters and the tree say; metrics: one row a
    frame, in which added are free probes that the tree holds and missed inner ones that it doesn't. ok: tetrahedra,
    clusters and surface agree, nothing is missed, and nothing added unless angle allows it. Probes on the surface are
    counted, and not judged. A frame without tetrahedra has no rows.
    """
    frames = written(clusters.clustered_frames(vertices, tets, **limits))
    surface, made = (written(meshes.packed_triangles(frames, c)) for c in ("surface", "faces"))
    each = frames.select("frame_id", F.explode(F.arrays_zip("tets", "clusters")).alias("t"))
    found = each.select("frame_id", F.col("t.tets").alias("tet_id"), F.col("t.clusters").alias("cluster_id"))
    planes = written(meshes.packed_planes(frames, "faces", angle))
    texts = written(plane_trees(planes))
    samples = written(_judged(probes, frames, texts))
    off, held = F.col("side") != "boundary", F.col("side") == "bounded"
    in_tets, in_clusters, in_tree = F.col("tets") > 0, F.col("cluster_value") <= 0, F.col("q") <= 0
    judged = samples.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("samples"), *[F.count_if(F.col("side") == s).alias(s) for s in ("bounded", "boundary", "unbounded")],
        F.count_if(off & (in_tets != held)).alias("tets_differ"), F.count_if(off & (in_clusters != held)).alias("clusters_differ"),
        F.count_if(off & ~held & in_tree).alias("added"), F.count_if(off & held & ~in_tree).alias("missed"),
    )
    six = sum((F.col(f"a{a}") * (F.col(f"b{b}") * F.col(f"c{c}") - F.col(f"b{c}") * F.col(f"c{b}")) for a, b, c in ("yzx", "zxy")), F.col("ax") * (F.col("by") * F.col("cz") - F.col("bz") * F.col("cy")))
    sizes = tets.groupBy("frame_id").agg(F.count(F.lit(1)).alias("tets"))
    for name, mesh in (("surface", surface), ("mesh", made)):
        sizes = sizes.join(mesh.groupBy("frame_id").agg(F.count(F.lit(1)).alias(f"{name}_faces"), (F.sum(six) / 6).alias(f"{name}_volume"), F.count_distinct("cluster_id").alias(f"{name}_parts")), "frame_id")
    metrics = sizes.drop("surface_parts").join(planes.groupBy("frame_id").agg(F.count(F.lit(1)).alias("planes")), "frame_id").join(judged, "frame_id")
    well = (F.col("tets_differ") + F.col("clusters_differ") + F.col("missed") == 0) & ((F.col("added") == 0) | F.lit(angle > 0))
    return {
        "surface": surface.drop("cluster_id"), "clusters": found, "meshes": made, "planes": planes, "trees": texts, "samples": samples,
        "metrics": metrics.withColumn("ok", well),
    }


__all__ = ["PRUNINGS", "direct_tables", "octree_tables", "plane_trees", "random_points", "samples_of", "sweep_tables", "tet_tables"]
