"""Free space by an event sweep over boundary patches, with work limits and a lazy fallback to the obstacles.

Along an axis, a patch facing down opens an obstacle and one facing up closes it. Between two neighbouring planes (a
slab) the occupied cross-section is constant; it is the state of the sweep, kept as rows of edges: where, along a row,
occupied and free change places. Rows that are equal are one strip. An event toggles two edges in the strips that it
covers. State and work follow the patches; no grid of compressed cells is built.

Frames are independent, so a frame's events are one sorted stream of one task, read once and never held together; what
a task holds is the cross-section of one slab, in both orientations.

A frame that passes a limit gets no prisms on that axis. Its free space is then what is outside its obstacle boxes,
which are made for such frames alone (``strictly_free``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import written
from . import octree
from .boundary import closed_free, merge_boxes
from .voxels import contains

SPAN = [f"{e}{c}" for e in ("lo", "hi") for c in "xyz"]


@dataclass(frozen=True)
class Limits:
    """Work of a frame and an axis: compressed cells inside the outer planes, cells that events cover, rectangles of all slabs."""

    cells: int = 100_000_000
    updates: int = 200_000_000
    prisms: int = 5_000_000

    def __post_init__(self) -> None:
        if min(self.cells, self.updates, self.prisms) < 1:
            raise ValueError("work limits must be positive")


class CrossSection:
    """The occupied part of a slab as strips of rows, each with the sorted edges of its runs."""

    def __init__(self, first: int, end: int):
        self.cuts, self.edges = [first, end], [[]]

    def _cut(self, at: int) -> int:
        i = bisect_left(self.cuts, at)
        if self.cuts[i] != at:
            self.cuts.insert(i, at)
            self.edges.insert(i, list(self.edges[i - 1]))
        return i

    def toggle(self, r0: int, r1: int, c0: int, c1: int, opens: bool) -> None:
        """Rows [r0, r1) change between c0 and c1: from free to occupied if it opens, back otherwise."""
        if not self.cuts[0] <= r0 < r1 <= self.cuts[-1]:
            raise ValueError(f"a patch of rows {r0} to {r1} lies beyond the outer planes")
        a = self._cut(r0)
        b = self._cut(r1)
        for strip in self.edges[a:b]:
            p, q = bisect_right(strip, c0), bisect_left(strip, c1)
            if p != q or (p % 2 == 1) == opens:
                raise ValueError(f"a patch {'opens' if opens else 'closes'} what is not {'free' if opens else 'occupied'}: rows {r0} to {r1}, columns {c0} to {c1}")
            at = p - 1 if p and strip[p - 1] == c0 else p
            end = q + 1 if q < len(strip) and strip[q] == c1 else q
            strip[at:end] = ([] if at < p else [c0]) + ([] if end > q else [c1])

    def tidy(self) -> None:
        """Make neighbouring strips with the same edges one."""
        keep = [i for i in range(len(self.edges)) if not i or self.edges[i] != self.edges[i - 1]]
        self.cuts = [self.cuts[i] for i in keep] + self.cuts[-1:]
        self.edges = [self.edges[i] for i in keep]

    def rectangles(self, c0: int, c1: int) -> list[tuple[int, int, int, int]]:
        """Free rectangles (r0, r1, c0, c1): runs along a row, joined while the next row has the same run."""
        out, open_ = [], {}
        for i, strip in enumerate(self.edges):
            bounds = [c0, *strip, c1]
            runs = {(a, b) for a, b in zip(bounds[::2], bounds[1::2], strict=True) if a < b}
            for run in [r for r in open_ if r not in runs]:
                out.append((open_.pop(run), self.cuts[i], *run))
            for run in runs:
                open_.setdefault(run, self.cuts[i])
        return out + [(start, self.cuts[-1], *run) for run, start in open_.items()]


class Sweep:
    """A frame's sweep: fed with events in order of their planes, it gives the rectangles of each slab that ends."""

    def __init__(self, frame: int, slabs: int, us: list[int], vs: list[int], limits: Limits):
        self.frame, self.us, self.vs, self.limits = frame, us, vs, limits
        self.rows, self.columns = CrossSection(us[0], us[-1]), CrossSection(vs[0], vs[-1])
        self.plane, self.slab, self.updates, self.prisms = None, 0, 0, 0
        self.reason = "compressed_cell_limit" if slabs * (len(us) - 1) * (len(vs) - 1) > limits.cells else None

    def feed(self, plane: int, sign: int, u0: int, u1: int, v0: int, v1: int) -> list[tuple]:
        if self.reason:
            return []
        out = self.close(plane) if self.plane is not None and plane != self.plane else []
        if self.reason:
            return []
        self.plane = plane
        self.updates += (bisect_left(self.us, u1) - bisect_left(self.us, u0)) * (bisect_left(self.vs, v1) - bisect_left(self.vs, v0))
        if self.updates > self.limits.updates:
            self.reason = "event_update_limit"
            return []
        try:
            self.rows.toggle(u0, u1, v0, v1, sign < 0)
            self.columns.toggle(v0, v1, u0, u1, sign < 0)
        except ValueError as e:
            raise ValueError(f"frame {self.frame}, plane {plane}: {e}") from None
        return out

    def close(self, plane: int) -> list[tuple]:
        """Rectangles of the slab up to plane: (slab, lo along the axis, hi, u0, u1, v0, v1)."""
        self.rows.tidy(), self.columns.tidy()
        self.slab += 1
        straight = self.rows.rectangles(self.vs[0], self.vs[-1])
        across = self.columns.rectangles(self.us[0], self.us[-1])
        if len(across) < len(straight):
            straight = [(u0, u1, v0, v1) for v0, v1, u0, u1 in across]
        self.prisms += len(straight)
        if self.prisms > self.limits.prisms:
            self.reason = "free_prism_limit"
            return []
        return [(self.slab, self.plane, plane, *r) for r in straight]

    def end(self) -> None:
        if self.reason is None and (any(self.rows.edges) or any(self.columns.edges)):
            raise ValueError(f"frame {self.frame}: the sweep ends inside an obstacle")


_EVENT = ("frame_id", "plane", "sign", "u0", "u1", "v0", "v1", "slabs", "us", "vs")
_SWEPT = "frame_id long, slab int, a0 long, a1 long, u0 long, u1 long, v0 long, v1 long, reason string, prisms long, updates long"


def swept(patched: DataFrame, coords: DataFrame, axis: int, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """Free rectangles of every slab along an axis, and what became of each frame.

    The first has frame_id, slab (from 1) and bounds lo*, hi* in voxels, for frames within the limits; the second
    frame_id, reason (null, or the limit that was passed), prisms (rectangles) and updates. patched: merged or single
    patches; coords: the support coordinates of each frame. Patches that do not close what others open are an error.
    """
    s, u, v = ("xyz"[(axis + k) % 3] for k in range(3))
    none = {c: F.lit(None).cast("long") for c in ("plane", "sign", "u0", "u1", "v0", "v1")}
    heads = coords.select("frame_id", *[none[c].alias(c) for c in none], (F.size(f"p{s}") - 1).cast("long").alias("slabs"), F.col(f"p{u}").alias("us"), F.col(f"p{v}").alias("vs"))
    lists = {f.name: f.dataType.simpleString() for f in heads.schema.fields}
    events = patched.where(F.col("axis") == axis).select(
        "frame_id", *[F.col(c).cast("long").alias(c) for c in none], F.lit(None).cast("long").alias("slabs"), *[F.lit(None).cast(lists[c]).alias(c) for c in ("us", "vs")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Sweep | None = None

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 11
            kinds = [pa.int64(), pa.int32()] + [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in _SWEPT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def ended(sweep: Sweep) -> tuple:
            sweep.end()
            return (sweep.frame, None, *[None] * 6, sweep.reason, sweep.prisms, sweep.updates)

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in _EVENT), strict=True):
                if row[7] is not None:
                    if now:
                        out.append(ended(now))
                    now = Sweep(row[0], row[7], row[8], row[9], limits)
                else:
                    out += [(now.frame, *r, None, None, None) for r in now.feed(*row[1:7])]
                    if len(out) > 50_000:
                        yield table(out)
                        out = []
            yield table(out)
        if now:
            yield table([ended(now)])

    stream = heads.unionByName(events).repartition("frame_id").sortWithinPartitions("frame_id", F.col("plane").asc_nulls_first())
    found = written(stream.select(*_EVENT).mapInArrow(run, _SWEPT))
    status = found.where("slab is null").select("frame_id", "reason", "prisms", "updates")
    names = {f"lo{s}": "a0", f"hi{s}": "a1", f"lo{u}": "u0", f"hi{u}": "u1", f"lo{v}": "v0", f"hi{v}": "v1"}
    whole = found.where("slab is not null").join(status.where("reason is not null"), "frame_id", "left_anti")
    return whole.select("frame_id", "slab", *[F.col(names[c]).alias(c) for c in SPAN]), status


def sweep_rectangles(patched: DataFrame, coords: DataFrame, axis: int, limits: Limits = Limits()) -> DataFrame:
    """Free rectangles of every slab along an axis; a frame beyond a limit is an error."""
    rectangles, status = swept(patched, coords, axis, limits)
    over = status.where("reason is not null").agg(F.min(F.struct("frame_id", "reason")).alias("f"), F.count(F.lit(1)).alias("n")).first()
    if over["n"]:
        raise ValueError(f"{over['n']} frames pass a limit of the sweep, frame {over['f']['frame_id']} the {over['f']['reason']}")
    return rectangles


@dataclass(frozen=True)
class FreeSpace:
    """Merged free prisms of an axis (frame_id, lo*, hi*), and the status of each frame, with the number of rectangles before merging."""

    axis: int
    prisms: DataFrame
    status: DataFrame


def free_space(patched: DataFrame, coords: DataFrame, axis: int, limits: Limits = Limits(), passes: int = 4) -> FreeSpace:
    """Free prisms of a sweep along an axis, merged along x, y and z until nothing merges, ``passes`` rounds at most.

    Each round is written, so that its plan does not grow with the rounds and its size says whether it is the last.
    """
    if passes < 1:
        raise ValueError("work limits must be positive")
    rectangles, status = swept(patched, coords, axis, limits)
    boxes = rectangles.drop("slab")
    n = boxes.count()
    for _ in range(passes):
        for k in range(3):
            boxes = merge_boxes(boxes, k)
        boxes, before = written(boxes), n
        n = boxes.count()
        if n == before:
            break
    return FreeSpace(axis, boxes, status)


def free_prisms(patched: DataFrame, coords: DataFrame, axis: int, limits: Limits = Limits(), passes: int = 4) -> DataFrame:
    """Merged free prisms of the frames within the limits."""
    return free_space(patched, coords, axis, limits, passes).prisms


def obstacle_boxes(voxels: DataFrame, frames: DataFrame) -> DataFrame:
    """Rectangular cells lo*, w* of the frames asked for: what the fallback is made of."""
    return octree.rectangular_cells(voxels.join(frames.select("frame_id").distinct(), "frame_id", "left_semi"))


def best_axis(candidates: list[FreeSpace], voxels: DataFrame) -> DataFrame:
    """The candidate of the smallest function by frame: frame_id, axis, fallback, prisms, nodes, leaf_references.

    One without fallback goes first, then by nodes, references to leaves, prisms and the axis. A tree of n prisms and
    the six outer halfspaces has 7 n + 7 nodes and 6 n + 6 references; one of m obstacle boxes, made only for frames
    that fall back on some axis, 7 m (and one if there are several) and 6 m.
    """
    rows = None
    for c in candidates:
        counts = c.prisms.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
        one = c.status.join(counts, "frame_id", "left").select(
            "frame_id", F.lit(c.axis).alias("axis"), F.col("reason").isNotNull().alias("fallback"), F.when(F.col("reason").isNull(), F.coalesce("n", F.lit(0))).otherwise(0).alias("prisms")
        )
        rows = one if rows is None else rows.unionByName(one)
    rows = written(rows)
    boxes = obstacle_boxes(voxels, rows.where("fallback")).groupBy("frame_id").agg(F.count(F.lit(1)).alias("m"))
    sized = rows.join(boxes, "frame_id", "left").select(
        "frame_id",
        "fallback",
        F.when(F.col("fallback"), 7 * F.col("m") + F.when(F.col("m") > 1, 1).otherwise(0)).otherwise(7 * F.col("prisms") + 7).alias("nodes"),
        F.when(F.col("fallback"), 6 * F.col("m")).otherwise(6 * F.col("prisms") + 6).alias("leaf_references"),
        "prisms",
        "axis",
    )
    best = sized.groupBy("frame_id").agg(F.min(F.struct("fallback", "nodes", "leaf_references", "prisms", "axis")).alias("b"))
    return best.select("frame_id", "b.axis", "b.fallback", "b.prisms", "b.nodes", "b.leaf_references")


def strictly_free(points: DataFrame, space: FreeSpace, coords: DataFrame, voxels: DataFrame, h: float) -> DataFrame:
    """points, all columns, with ``free`` and ``fallback``.

    Within the limits: in the open free space of the prisms, or on their surface but in no occupied box. Faces between
    prisms are free though the tree is 0 there; only such points are looked up (the zero guard). In frames beyond a
    limit: outside all closed obstacle boxes. Points are rows: they need no number.
    """
    flagged = points.join(space.status.select("frame_id", F.col("reason").isNotNull().alias("fallback")), "frame_id")
    signed = closed_free(flagged.where("not fallback"), space.prisms, coords, h)
    rest = signed.where("q_sign <> 0").withColumn("free", F.col("q_sign") < 0)
    guard = contains(signed.where("q_sign = 0"), voxels, h).withColumn("free", ~F.col("inside")).drop("inside")
    lost = written(space.status.where("reason is not null").select("frame_id"))
    made = rest.unionByName(guard).drop("q_sign")
    if lost.isEmpty():
        return made
    boxes = obstacle_boxes(voxels, lost)
    far = octree.union_values(flagged.where("fallback"), boxes, h).withColumn("free", F.col("q") > 0).drop("q")
    return made.unionByName(far)
