"""Command line: python -m clearfield COMMAND --cloud FILE ... ; results go to --output as a bundle, its manifest last."""

from __future__ import annotations

import argparse
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import arrangement, audit, boundary, hulls, neighbours, octree, robot, sweep, voxels
from .operators.boundary import numbered_within
from .sources import bundles, exports, shapes
from .sources.points import read_cloud
from .sources.staging import staging_folder
from .streaming import manifest


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="clearfield", description=__doc__)
    p.add_argument("command", choices=["voxelize", "boundary", "octree", "sweep", "hull", "function", "diagnose", "distance", "clearance", "stream", "camera", "tets"])
    p.add_argument("--cloud", help="file or folder of them, one frame a file")
    p.add_argument("--format", choices=["xyz", "ply", "off"], default="xyz")
    p.add_argument("--output", help="folder of the bundle; a stream's frames name their own")
    p.add_argument("--voxel-size", type=float, required=True)
    p.add_argument("--preprocess", choices=["none", "voxel", "jet"], default="none")
    p.add_argument("--neighbors", type=int, default=24, help="jet: nearest points that a surface is fitted to")
    p.add_argument("--iterations", type=int, default=1, help="jet: how often points are smoothed")
    p.add_argument("--manifest", help="stream: lines of cloud, output and configuration, tab separated")
    p.add_argument("--reuse", type=int, default=1, help="stream: environments held")
    for name in ("points", "voxels", "cells", "nodes", "strata"):
        p.add_argument(f"--most-{name}", type=int, help="stream: work limit of a frame")
    p.add_argument("--inflation", type=float, default=0.1, help="hull: volume added, as a share")
    p.add_argument("--fill-distance", type=float, default=1.0, help="hull: distance of added points from boxes, in voxels")
    p.add_argument("--max-hull-voxels", type=int, default=hulls.Budget().most_voxels, help="hull: voxels of a region; larger ones stay as they are and are counted")
    p.add_argument("--max-hull-boxes", type=int, default=hulls.Budget().most_boxes, help="hull: parts of a distance certificate, likewise")
    p.add_argument("--views", type=int, default=10, help="camera: views")
    p.add_argument("--sweep", choices=["x", "y", "z", "best-axis"], default="best-axis")
    limits = sweep.Limits()
    p.add_argument("--max-cells", type=int, default=limits.cells, help="sweep: compressed cells of a frame beyond which it falls back to its obstacles")
    p.add_argument("--max-updates", type=int, default=limits.updates, help="sweep: cells covered by events of an axis, likewise")
    p.add_argument("--max-prisms", type=int, default=limits.prisms, help="sweep: free rectangles of an axis, likewise")
    p.add_argument("--max-passes", type=int, default=4, help="sweep: rounds of merging")
    p.add_argument("--pruning", choices=list(bundles.PRUNINGS), default="rect", help="octree: cells of cubes and sibling boxes, of cubes, or of voxels")
    p.add_argument("--samples", type=int, default=64, help="octree, sweep, function, tets: random probes of a frame")
    p.add_argument("--max-expanded-nodes", type=int, default=100_000, help="function: nodes of a function written out as an expression; longer ones have none")
    p.add_argument("--vertices", help="tets: Parquet table frame_id, vertex_id, x, y, z")
    p.add_argument("--tets", help="tets: Parquet table frame_id, tet_id, v (four vertex_ids)")
    p.add_argument("--plane-angle", type=float, default=0.0, help="tets: faces within so many radians share a support plane, which may add to a cluster")
    p.add_argument("--target-clusters", type=int, default=0, help="tets: merge no further than this; 0 for as far as it goes")
    p.add_argument("--urdf")
    p.add_argument("--q", help="joint values, comma separated; several configurations by semicolons")
    p.add_argument("--margin", type=float, default=0.0)
    p.add_argument("--environment-error", type=float, default=1e-3, help="bound of the function's smoothing")
    p.add_argument("--link-error", type=float, default=1e-3, help="bound of the links' smoothing")
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Carry out one command; returns the manifest."""
    h = a.voxel_size
    if not h > 0:
        raise ValueError("the voxel size must be positive")
    if a.command == "stream":
        return stream(spark, a)
    if not a.output or (not a.cloud and a.command not in ("camera", "tets")):
        raise ValueError("--cloud and --output are wanted")
    if a.command == "tets":
        if not a.vertices or not a.tets:
            raise ValueError("tets needs --vertices and --tets")
        v, t = (spark.read.parquet(path) for path in (a.vertices, a.tets))
        tables = bundles.tet_tables(v, t, bundles.random_points(v, a.samples), a.plane_angle, target=a.target_clusters)
        return exports.write_bundle(spark, a.output, tables, {"command": a.command, "plane_angle": a.plane_angle})
    if a.command == "camera":
        seen = shapes.depth_camera(spark, a.views)
        return exports.write_bundle(spark, a.output, {"views": seen, "cloud": shapes.camera_cloud(seen, h)}, {"command": a.command, "voxel_size": h})
    # Text is parsed once and voxels are found once; everything else reads these tables.
    folder = staging_folder(spark)

    def staged(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    points = staged("points", read_cloud(spark, a.cloud, a.format))
    if a.preprocess == "voxel":
        points = staged("centres", numbered_within(voxels.preprocess_voxel(points, h), ["frame_id"], ["ix"], ["iy", "iz"], "point_id", "long").select("frame_id", "point_id", *"xyz"))
    elif a.preprocess == "jet":
        points = staged("smoothed", neighbours.jet_smooth(points, a.neighbors, a.iterations).select("frame_id", "point_id", *"xyz"))
    v = staged("voxels", voxels.voxelize(points, h))
    faces = staged("faces", boundary.exposed_faces(v))
    planes = boundary.supports(faces)
    coords = boundary.coordinates(planes)
    cells = staged("cells", boundary.cells(v, coords))
    if a.command == "voxelize":
        tables = {"voxels": v, "corners": voxels.corners(v), "stats": voxels.stats(points, v, h)}
    elif a.command == "boundary":
        tables = {"faces": faces, "patches": boundary.number_patches(boundary.patches(faces)), "supports": planes, "cells": cells}
    elif a.command == "octree":
        tables = bundles.octree_tables(v, staged("patches", boundary.patches(faces)), h, a.pruning, a.samples)
    elif a.command == "sweep":
        axes = (0, 1, 2) if a.sweep == "best-axis" else ("xyz".index(a.sweep),)
        limits = sweep.Limits(a.max_cells, a.max_updates, a.max_prisms)
        tables = bundles.sweep_tables(v, staged("patches", boundary.patches(faces)), staged("supports", planes), h, axes, limits, a.max_passes, a.samples)
    elif a.command == "hull":
        found = staged("clusters", hulls.approximate_frames(v, hulls.Budget(a.inflation, a.fill_distance, a.max_hull_voxels, a.max_hull_boxes), h))
        tables = {"clusters": found, "report": hulls.report(found), "size": octree.tree_size(octree.rectangular_cells(v))}
    elif a.command == "function":
        tables = bundles.direct_tables(v, faces, h, a.max_expanded_nodes, a.samples)
        tables["validation"] = staged("validation", tables["validation"])
        if not tables["validation"].where("not ok").isEmpty():
            # The report is published, the function is not.
            exports.write_bundle(spark, a.output, {n: tables[n] for n in ("validation", "samples", "registry", "occupancy")}, {"command": a.command, "voxel_size": h, "failed": True})
            raise RuntimeError(f"a function failed its checks; the report is in {a.output}")
    elif a.command == "diagnose":
        tables = {"diagnostics": arrangement.diagnose_programs(cells, cells, coords, h), "supports": planes}
    else:
        programs = staged("programs", arrangement.build_programs(cells, coords, h, certify=True))
        # No result without a certificate: a mismatch stops the command.
        sure = F.when(F.col("mismatches") == 0, F.col("program")).otherwise(F.raise_error(F.lit("a function failed its certificate")).cast("binary"))
        programs = programs.withColumn("program", sure)
        tables = {"programs": programs, "json": exports.program_json(programs)}
        if a.command == "distance":
            patched = staged("patches", boundary.patches(faces))
            probes = staged("probes", audit.surface_probes(v, patched, h).unionByName(audit.outer_probes(v, h)).unionByName(audit.random_probes(v, h, 64)))
            q = staged("values", arrangement.evaluate(probes, programs, error=a.environment_error))
            errors = audit.distance_errors(probes, q, arrangement.patch_distance(probes, patched, h), v, h)
            tables |= {"samples": q, "validation": voxels.summarize(errors.withColumn("by", F.struct("frame_id", "what")), "by", "error").select("by.*", "n", "max_error", "mean_error", "rmse", "p95")}
        if a.command == "clearance":
            if not a.urdf or not a.q:
                raise ValueError("clearance needs --urdf and --q")
            with open(a.urdf, encoding="utf-8") as f:
                model = robot.parse_urdf(f.read())
            q = [[float(x) for x in c.split(",")] for c in a.q.split(";")]
            if any(len(c) != model.dof for c in q):
                raise ValueError(f"a configuration has {model.dof} values")
            poses = robot.sphere_poses(spark.createDataFrame(list(enumerate(q)), "config_id long, q array<double>"), model)
            field = robot.field_at(poses, coords, programs, a.environment_error)
            found = robot.group_clearances(field, model, a.margin, a.link_error)
            spheres = staged("spheres", robot.described_spheres(field, model, a.margin))
            surface = staged("surface", exports.surface_summary(v, faces, boundary.patches(faces), h))
            about = {"voxel_size": h, "margin": a.margin, "environment_error": a.environment_error, "link_error": a.link_error, "link_alpha": robot.link_alpha(model, a.link_error)}
            about["joint_order"] = [j.name for j in sorted(model.joints.values(), key=lambda j: j.index) if j.index >= 0]
            configurations = spark.createDataFrame(list(enumerate(q)), "config_id long, q array<double>")
            documents = exports.clearance_documents(robot.described_groups(found, model), spheres, surface, configurations, about)
            tables = {"distances": found, "spheres": spheres.select("frame_id", "config_id", "sphere.*"), "documents": documents}
    return exports.write_bundle(spark, a.output, tables, {"command": a.command, "voxel_size": h})


def stream(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Carry out the frames of a manifest in order, a status line each; returns how many there were and how many hits."""
    if not a.manifest or not a.urdf:
        raise ValueError("stream needs --manifest and --urdf")
    with open(a.urdf, encoding="utf-8") as f:
        model = robot.parse_urdf(f.read())
    with open(a.manifest, encoding="utf-8", newline="") as f:
        text = f.read()
    given = {n: getattr(a, f"most_{n}") for n in ("points", "voxels", "cells", "nodes", "strata")}
    limits = manifest.Limits(**{n: x for n, x in given.items() if x is not None})
    held = manifest.Environments(a.voxel_size, limits, a.reuse)
    q = [float(x) for x in a.q.split(",")] if a.q else None
    frames, hits = 0, 0
    for status in manifest.run_manifest(spark, text, model, held, q, a.margin, a.environment_error, a.link_error):
        print(manifest.status_line(status), flush=True)
        frames, hits = frames + 1, hits + status["cache_hit"]
    return {"command": "stream", "frames": frames, "hits": hits}


def main() -> None:
    spark = SparkSession.builder.appName("clearfield").getOrCreate()
    print(run(spark, parser().parse_args()))


if __name__ == "__main__":
    main()
