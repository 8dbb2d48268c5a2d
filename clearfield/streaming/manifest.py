"""Recorded frames in order from a manifest: environments reused by exact occupancy, work limits, a status line a frame."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import arrangement, boundary, robot, voxels
from ..sources import exports
from ..sources.points import read_cloud
from ..sources.staging import drop, kept, scope, written


def parse_manifest(text: str) -> list[tuple[str, str, list[float] | None]]:
    """Frames (cloud, output, q or null) of lines ``cloud<TAB>output[<TAB>q,q,..]``; blank lines and # comments are skipped.

    Any other line is an error that names its number.
    """
    out = []
    for i, line in enumerate(text.split("\n"), 1):
        line = line.removesuffix("\r")
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        parts = line.split("\t")
        try:
            cloud, output, q = (*parts, None) if len(parts) == 2 else parts
            if not cloud or not output:
                raise ValueError("empty path")
            out.append((cloud, output, None if q is None else [float(x) for x in q.split(",")]))
        except ValueError as e:
            raise ValueError(f"bad manifest line {i}: {e}") from e
    return out


@dataclass(frozen=True)
class Limits:
    """Most work of one frame; beyond any of them it fails, and nothing is cached."""

    points: int = 10_000_000_000
    voxels: int = 1_000_000_000
    cells: int = arrangement.MOST_CELLS
    nodes: int = arrangement.MOST_NODES
    strata: int = 8 * arrangement.MOST_CELLS

    def check(self, name: str, value: int) -> int:
        if value > getattr(self, name):
            raise arrangement.WorkLimit(f"more than {getattr(self, name)} {name}")
        return value


@dataclass
class Snapshot:
    """One environment: its occupied voxels, and its certified function."""

    voxels: DataFrame
    count: int
    coords: DataFrame
    programs: DataFrame

    def drop(self) -> None:
        for table in (self.voxels, self.coords, self.programs):
            drop(table)


@dataclass
class Environments:
    """The last ``capacity`` environments, most recently used first."""

    h: float
    limits: Limits = field(default_factory=Limits)
    capacity: int = 1
    held: list[Snapshot] = field(default_factory=list)

    def prepare(self, points: DataFrame) -> tuple[Snapshot, dict]:
        """The environment of a frame's points (frame_id, point_id, x, y, z), and what is known of it.

        A held one serves if its voxels are the very same; every raw point is then still checked to lie in
        their closed union. Else it is built and certified, and held only if the certificate is right. What is not
        held any more, or is not needed beyond the frame, is deleted: the folders are those of the held ones.
        """
        with scope(points.sparkSession):
            return self._prepare(points)

    def _prepare(self, points: DataFrame) -> tuple[Snapshot, dict]:
        points = written(points.withColumn("frame_id", F.lit(0).cast("long")))
        known = {"points": self.limits.check("points", points.count())}
        v = written(voxels.voxelize(points, self.h))
        known["voxels"] = self.limits.check("voxels", v.count())
        found = next((s for s in self.held if s.count == known["voxels"] and self._same(s.voxels, v)), None)
        known["cache_hit"] = found is not None
        if found is None:
            found = self._build(v, known["voxels"])
        else:
            self.held.remove(found)
        known["outside"] = voxels.count_outside(points, found.voxels, self.h).first()["outside"]
        if known["outside"]:
            raise RuntimeError("points lie outside of their own voxels")
        self.held = [found, *self.held]
        for old in self.held[self.capacity :]:
            old.drop()
        self.held = self.held[: self.capacity]
        return found, known

    def _same(self, a: DataFrame, b: DataFrame) -> bool:
        pair = [x.withColumn("pair", F.lit(0)) for x in (a, b)]
        return voxels.same_occupancy(*pair).first()["differing"] == 0

    def _build(self, v: DataFrame, count: int) -> Snapshot:
        faces = boundary.exposed_faces(v)
        coords = written(boundary.coordinates(boundary.supports(faces)))
        sizes = coords.select(*[(F.size(f"p{c}") + 1).cast("long").alias(c) for c in "xyz"]).first()
        self.limits.check("cells", sizes["x"] * sizes["y"] * sizes["z"])
        self.limits.check("strata", (2 * sizes["x"] - 1) * (2 * sizes["y"] - 1) * (2 * sizes["z"] - 1))
        programs = written(arrangement.build_programs(boundary.cells(v, coords), coords, self.h, certify=True, most_nodes=self.limits.nodes))
        if programs.first()["mismatches"]:
            raise RuntimeError("a function failed its certificate")
        return Snapshot(kept(v), count, kept(coords), kept(programs))


def run_manifest(
    spark: SparkSession, text: str, model: robot.Model, environments: Environments, q: list[float] | None = None, margin: float = 0.0, environment_error: float = 1e-3, link_error: float = 1e-3
) -> Iterator[dict]:
    """Clearances of each frame of a manifest, written as one JSON document to its output; yields a status a frame.

    A frame without a configuration of its own takes ``q``. Frames are taken in order, as reuse asks for it;
    each of them is a set of Spark jobs.
    """
    for i, (cloud, output, own) in enumerate(parse_manifest(text)):
        at = own if own is not None else q
        if at is None or len(at) != model.dof:
            raise ValueError(f"a configuration has {model.dof} values")
        begun = time.monotonic()
        kind = cloud.rsplit(".", 1)[-1].lower()
        snapshot, known = environments.prepare(read_cloud(spark, cloud, kind if kind in ("ply", "off") else "xyz"))
        prepared = time.monotonic()
        with scope(spark):
            asked = spark.createDataFrame([(0, at)], "config_id long, q array<double>")
            field = written(robot.field_at(robot.sphere_poses(asked, model), snapshot.coords, snapshot.programs, environment_error).withColumn("frame_id", F.lit(i).cast("long")))
            found = robot.described_groups(robot.group_clearances(field, model, margin, link_error), model)
            about = {"voxel_size": environments.h, "margin": margin, "environment_error": environment_error, "link_error": link_error}
            document = exports.clearance_documents(found, robot.described_spheres(field, model, margin), None, asked, about).first()  # one configuration
        exports.write_text(spark, output, document["value"] + "\n")
        yield {"frame": i, "cloud": cloud, "output": output, **known, "prepare_seconds": prepared - begun, "query_seconds": time.monotonic() - prepared}


def status_line(status: dict) -> str:
    return json.dumps(status, sort_keys=True)
