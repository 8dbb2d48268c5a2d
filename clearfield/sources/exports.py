"""Sinks: voxel and patch tables, meshes, programs, clearance documents, and bundles whose manifest comes last."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrangement, boundary, meshes
from .staging import written


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small text file, written through Spark's file systems; an existing one is replaced."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def xyz_lines(points: DataFrame) -> DataFrame:
    """Points as XYZ text lines (frame_id, value), which read_xyz reads back exactly."""
    return points.select("frame_id", F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"]).alias("value"))


def write_clouds(points: DataFrame, path: str, kind: str) -> None:
    """One PLY, OFF or XYZ text file a frame, points in order of point_id; a header line first. A frame is one task."""
    if kind not in ("ply", "off", "xyz"):
        raise ValueError("a cloud is xyz, ply or off")
    lines = points.select("frame_id", F.lit(1).alias("part"), "point_id", F.concat_ws(" ", *[F.col(c).cast("string") for c in "xyz"]).alias("value"))
    n = points.groupBy("frame_id").agg(F.count(F.lit(1)).cast("string").alias("n"))
    head = {
        "ply": F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), "n", F.lit("\nproperty double x\nproperty double y\nproperty double z\nend_header")),
        "off": F.concat(F.lit("OFF\n# points\n"), "n", F.lit(" 0 0")),
        "xyz": F.lit("# x y z"),
    }[kind]
    both = lines.unionByName(n.select("frame_id", F.lit(0).alias("part"), F.lit(-1).cast("long").alias("point_id"), head.alias("value")))
    both.repartition("frame_id").sortWithinPartitions("frame_id", "part", "point_id").select("frame_id", "value").write.partitionBy("frame_id").text(path)


def write_voxels(corners: DataFrame, voxels: DataFrame, stats: DataFrame, path: str, h: float) -> None:
    """corners as XYZ text, voxels as CSV, stats as JSON, each in a folder."""
    at = corners.select("frame_id", *[(F.col(f"c{c}") * h).alias(c) for c in "xyz"])
    xyz_lines(at).write.partitionBy("frame_id").text(f"{path}/voxel_corners")
    voxels.write.option("header", True).csv(f"{path}/occupied_voxels")
    stats.write.json(f"{path}/stats")


def patch_mesh(patches: DataFrame, h: float) -> DataFrame:
    """One row a frame with an OFF text of its patches as quadrilaterals, in order of patch_id."""
    corners = boundary.patch_corners(boundary.number_patches(patches), h)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["patch_id", "corner"])
        lines = [" ".join(map(repr, map(float, p))) for p in frame[["x", "y", "z"]].itertuples(index=False)]
        n = len(lines)
        quads = [f"4 {i} {i + 1} {i + 2} {i + 3}" for i in range(0, n, 4)]
        return pd.DataFrame({"frame_id": [frame["frame_id"].iloc[0]], "vertices": [n], "faces": [n // 4], "off": ["\n".join(["OFF", f"{n} {n // 4} 0", *lines, *quads]) + "\n"]})

    return corners.groupBy("frame_id").applyInPandas(run, "frame_id long, vertices long, faces long, off string")


def program_json(programs: DataFrame) -> DataFrame:
    """One row a frame with its program as JSON: leaves (normal, offset), nodes (op, leaf, children), root."""

    def run(frames):
        for frame in frames:
            texts = []
            for data in frame["program"]:
                p = arrangement.Program.unpack(data)
                leaves = [
                    {"id": i, "normal": [float(s) if k == a else 0.0 for k in range(3)], "offset": s * (c * p.h)} for i, (a, s, c) in enumerate(zip(p.axis, p.sign, p.coord, strict=True))
                ]
                names = {arrangement.LEAF: "LEAF", arrangement.MIN: "MIN", arrangement.MAX: "MAX"}
                nodes = [{"id": i, "op": names[op], "leaf": leaf, "children": list(c)} for i, (op, leaf, c) in enumerate(zip(p.op, p.leaf, p.children, strict=True))]
                texts.append(json.dumps({"leaves": leaves, "nodes": nodes, "root": len(nodes) - 1}))
            yield pd.DataFrame({"frame_id": frame["frame_id"], "json": texts})

    return programs.select("frame_id", "program").mapInPandas(run, "frame_id long, json string")


def mesh_documents(vertices: DataFrame, faces: DataFrame, by: Callable[[Column], Column]) -> DataFrame:
    """One JSON document a mesh: vertices, edges with length and the faces on both sides (-1 for none), faces with their plane.

    by: the mesh of a vertex number. A mesh is metadata of its points, so its lists fit a row.
    """

    def of(name: str) -> Column:
        return by(F.col(name))

    e = meshes.edges(faces)
    for c in ("a", "b"):
        e = e.join(vertices.select(F.col("vertex_id").alias(c), *[F.col(k).alias(f"{c}{k}") for k in "xyz"]), c)
    span = F.sqrt(sum(((F.col(f"b{k}") - F.col(f"a{k}")) * (F.col(f"b{k}") - F.col(f"a{k}")) for k in "yz"), (F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax"))))
    listed = [
        vertices.groupBy(of("vertex_id").alias("mesh")).agg(F.array_sort(F.collect_list(F.struct("vertex_id", "x", "y", "z"))).alias("vertices")),
        e.withColumn("length", span).groupBy(of("a").alias("mesh")).agg(F.array_sort(F.collect_list(F.struct("a", "b", "length", "left", "right"))).alias("edges")),
        meshes.face_planes(vertices, faces).join(faces.select("face_id", "v"), "face_id").withColumn("first", F.get("v", F.lit(0))).groupBy(of("first").alias("mesh")).agg(
            F.array_sort(F.collect_list(F.struct("face_id", "v", "nx", "ny", "nz", "d", "area"))).alias("faces")
        ),
    ]
    joined = listed[0].join(listed[1], "mesh").join(listed[2], "mesh")
    return joined.select("mesh", F.to_json(F.struct(F.lit(1).alias("schema"), "vertices", "edges", "faces")).alias("value"))


def clearance_documents(
    distances: DataFrame, spheres: DataFrame | None = None, surface: DataFrame | None = None, configurations: DataFrame | None = None, about: dict[str, float | str | list[str]] | None = None
) -> DataFrame:
    """One JSON document a frame and configuration with its groups in order of their joints.

    Given these, it also holds every sphere in order (spheres: ``robot.described_spheres``), the frame's surface
    (``surface_summary``), the joint values (configurations: config_id, q), and options as they are in ``about``. Lists are
    as long as the model, or the frame's merged patches; fields that are null are written as null.
    """
    key = ["frame_id", "config_id"]
    known = [c for c in ("link", "joint_index", "source_links") if c in distances.columns]
    group = F.struct("link_index", "joint", *known, "distance", "hard_min", "nearest_sphere", "spheres", "bound", "gradient")
    listed = distances.groupBy(*key).agg(F.array_sort(F.collect_list(group)).alias("groups"))
    fields = [F.lit(1).alias("schema"), *[F.col(c) for c in key]]
    if about:
        fields.append(F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in about.items()]).alias("options"))
    if configurations is not None:
        listed = listed.join(configurations.select("config_id", F.col("q").alias("configuration")), "config_id")
        fields.append(F.col("configuration"))
    if surface is not None:
        fields.append(F.col("surface"))
    fields.append(F.col("groups"))
    if spheres is not None:
        listed = listed.join(spheres.groupBy(*key).agg(F.array_sort(F.collect_list("sphere")).alias("all")), key)
        fields.append(F.col("all").alias("spheres"))
    if surface is not None:
        # Written, so that its size is known, and last, so that no sort of configurations carries the patches of their frame.
        listed = listed.join(written(surface.select("frame_id", "surface")), "frame_id")
    return listed.select(*key, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def surface_summary(voxels: DataFrame, faces: DataFrame, patched: DataFrame, h: float) -> DataFrame:
    """Rows (frame_id, surface): voxels, their faces, those that two voxels share, exposed ones, merged patches with corners."""
    counts = voxels.groupBy("frame_id").agg(F.count(F.lit(1)).alias("voxels"))
    open_ = faces.groupBy("frame_id").agg(F.count(F.lit(1)).alias("exposed_faces"))
    corners = boundary.patch_corners(patched, h).groupBy("frame_id", "axis", "sign", "plane", "v0", "u0").agg(F.transform(F.array_sort(F.collect_list(F.struct("corner", *"xyz"))), lambda c: F.array(c["x"], c["y"], c["z"])).alias("corners"))
    one = F.struct("axis", "sign", "plane", "v0", "u0", "corners")
    listed = corners.groupBy("frame_id").agg(F.transform(F.array_sort(F.collect_list(one)), lambda p: F.struct(p["axis"].alias("axis"), p["sign"].alias("sign"), p["corners"].alias("corners"))).alias("patches"))
    both = counts.join(open_, "frame_id").join(listed, "frame_id")
    return both.select(
        "frame_id",
        F.struct(
            "voxels", (6 * F.col("voxels")).alias("faces"), ((6 * F.col("voxels") - F.col("exposed_faces")) / 2).cast("long").alias("shared_faces"), "exposed_faces",
            F.size("patches").cast("long").alias("merged_patches"), (F.col("exposed_faces") - F.size("patches")).alias("merged_away"), "patches",
        ).alias("surface"),
    )


def write_bundle(spark: SparkSession, path: str, tables: dict[str, DataFrame], note: dict) -> dict:
    """Tables as Parquet under a fresh attempt folder, then a manifest that names them, last of all.

    A reader that finds the manifest finds whole tables; an attempt that failed leaves none.
    """
    attempt = uuid.uuid4().hex
    manifest = {"attempt": attempt, "tables": {}, **note}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{attempt}/{name}")
        manifest["tables"][name] = {"path": f"{attempt}/{name}", "rows": spark.read.parquet(f"{path}/{attempt}/{name}").count()}
    write_text(spark, f"{path}/manifest.json", json.dumps(manifest, indent=1, sort_keys=True))
    return manifest


def read_bundle(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a bundle by name."""
    text = "\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect())
    return {name: spark.read.parquet(f"{path}/{t['path']}") for name, t in json.loads(text)["tables"].items()}


__all__ = ["clearance_documents", "surface_summary", "mesh_documents", "patch_mesh", "program_json", "read_bundle", "write_bundle", "write_clouds", "write_text", "write_voxels", "xyz_lines"]
