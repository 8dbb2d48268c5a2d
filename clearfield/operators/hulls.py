"""Fewer, larger convex cells: hulls of octree regions in place of their boxes, within budgets that are certified.

Level by level up a frame's octree, the convex cells of a region give way to the hull of its boxes where that takes
fewer planes, adds no more than a share of the region's volume, and every point of the hull lies within a distance of
an occupied box. Regions are disjoint, so what all of them add is within the same share of the frame's volume.

What is exported are planes of doubles, not the ideal hull: unit normals, and offsets rounded outward so that no
corner lies beyond. Their intersection, inside the region's own box, is made in exact arithmetic by cutting that box
plane by plane. Budgets and certificate hold for this polyhedron; planes that make no face of it are dropped.

What was refused is counted by frame and reason, work limits included. A frame is a kernel of its own.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import hull_planes
from .octree import rectangular_cells

Plane = tuple[float, float, float, float]
Exact = tuple[Fraction, Fraction, Fraction]
#: Share of a sum's terms by which doubles may be off, with room to spare.
SLACK = 2.0**-46
REASONS = ("volume", "gain", "distance", "work")


@dataclass(frozen=True)
class Budget:
    """inflation: volume added as a share; distance: of added points from occupied boxes, in voxels; work limits: voxels
    of a region, parts of a certificate."""

    inflation: float = 0.1
    distance: float = 1.0
    most_voxels: int = 1 << 20
    most_boxes: int = 1 << 18


@dataclass
class Cell:
    """A convex cell: the numbers of its boxes, voxels, planes, exact volume, bound of the distance of its points from boxes."""

    boxes: list[int]
    voxels: int
    planes: list[Plane]
    volume: Fraction
    bound: float = 0.0
    merged: bool = False


@dataclass
class Hulls:
    """Cells of a frame, and what became of the regions that were tried."""

    cells: list[Cell] = field(default_factory=list)
    accepted: int = 0
    refused: dict[str, int] = field(default_factory=lambda: dict.fromkeys(REASONS, 0))


# ---------------------------------------------------------------- exact polyhedra


class Polyhedron:
    """A convex polyhedron with exact corners: by number of its plane, each face as a ring of corners."""

    def __init__(self, lo: Exact, hi: Exact):
        """A box, whose planes are numbered 2 * axis + side."""
        self.faces: dict[int, list[Exact]] = {}
        for k in range(3):
            u, v = (k + 1) % 3, (k + 2) % 3
            for side in (0, 1):
                ring = []
                for a, b in ((0, 0), (1, 0), (1, 1), (0, 1)) if side else ((0, 0), (0, 1), (1, 1), (1, 0)):
                    p = [None] * 3
                    p[k], p[u], p[v] = (hi, lo)[1 - side][k], (lo, hi)[a][u], (lo, hi)[b][v]
                    ring.append(tuple(p))
                self.faces[2 * k + side] = ring

    def cut(self, number: int, plane: tuple[Fraction, Fraction, Fraction, Fraction]) -> None:
        """Keep what is at or below a plane n . x <= offset; its face gets the number, if it makes one."""
        *n, offset = plane
        height = {p: sum(a * b for a, b in zip(n, p, strict=True)) - offset for ring in self.faces.values() for p in ring}
        if max(height.values()) <= 0:
            return
        follows: dict[Exact, Exact] = {}  # edges of the new face, turned the other way than in the faces beside it
        left: dict[int, list[Exact]] = {}
        for name, ring in self.faces.items():
            kept: list[Exact] = []
            for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
                a, b = height[p], height[q]
                if a <= 0:
                    kept.append(p)
                if a < 0 < b or b < 0 < a:
                    t = a / (a - b)
                    kept.append(tuple(x + t * (y - x) for x, y in zip(p, q, strict=True)))
            if len(kept) < 3:
                continue
            left[name] = kept
            on = {p for p in kept if height.get(p, 0) == 0}  # corners that are new lie on the plane
            for p, q in zip(kept, kept[1:] + kept[:1], strict=True):
                if p in on and q in on:
                    follows[q] = p
        self.faces = left
        if len(follows) >= 3:
            start = now = next(iter(follows))
            ring = []
            while now in follows and (not ring or now != start):
                ring.append(now)
                now = follows[now]
            if len(ring) >= 3:
                self.faces[number] = ring

    def volume(self) -> Fraction:
        total = Fraction(0)
        for ring in self.faces.values():
            a = ring[0]
            for b, c in zip(ring[1:], ring[2:]):
                total += a[0] * (b[1] * c[2] - b[2] * c[1]) + a[1] * (b[2] * c[0] - b[0] * c[2]) + a[2] * (b[0] * c[1] - b[1] * c[0])
        return total / 6


def support_plane(normal: tuple[int, int, int], corners: np.ndarray, h: float) -> Plane:
    """The plane of a normal as doubles, unit length and offset rounded outward: no corner times h lies beyond it in exact arithmetic."""
    length = math.sqrt(sum(x * x for x in normal))
    unit = [x / length for x in normal]
    exact = [[Fraction(float(c) * h) for c in p] for p in corners]
    sizes = [[Fraction(n) * x for n, x in zip(unit, p, strict=True)] for p in exact]
    most = max(sum(s) for s in sizes) + Fraction(SLACK) * max(sum(map(abs, s)) for s in sizes)
    offset = float(most)
    while Fraction(offset) < most:
        offset = math.nextafter(offset, math.inf)
    return (*unit, math.nextafter(offset, math.inf))


def extreme_corners(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Corners of integer boxes that are the first or last of all on their lines along x, y and z: hull corners are among them."""
    found = np.unique(np.concatenate([np.where(np.array(s, bool), hi, lo) for s in itertools.product((0, 1), repeat=3)]), axis=0)
    for k in range(3):
        rest = [c for c in range(3) if c != k]
        order = np.lexsort((found[:, k], found[:, rest[0]], found[:, rest[1]]))
        line = found[order][:, rest]
        change = np.flatnonzero((line[1:] != line[:-1]).any(axis=1))
        found = found[order][np.unique(np.concatenate([[0], change, change + 1, [len(order) - 1]]))]
    return found


def supported_hull(lo: np.ndarray, hi: np.ndarray, h: float) -> tuple[list[Plane], Fraction]:
    """Planes of the exported hull of integer boxes that make a face of it, and its exact volume, with voxels of size h."""
    corners = extreme_corners(lo, hi)
    a, b = corners.min(axis=0), corners.max(axis=0)
    low, high = (tuple(Fraction(float(x) * h) for x in p) for p in (a, b))
    solid = Polyhedron(low, high)
    planes: list[Plane] = []
    for k, side in itertools.product(range(3), (0, 1)):
        sign = 1.0 if side else -1.0
        planes.append((*[sign if i == k else 0.0 for i in range(3)], sign * float((a, b)[side][k] * h)))
    for *normal, _ in hull_planes([tuple(map(int, p)) for p in corners]):
        if np.count_nonzero(normal) > 1:
            planes.append(support_plane(tuple(normal), corners, h))
            solid.cut(len(planes) - 1, tuple(map(Fraction, planes[-1])))
    return [planes[i] for i in sorted(solid.faces)], solid.volume()


# ---------------------------------------------------------------- distance


def certify_distance(lo: np.ndarray, hi: np.ndarray, planes: list[Plane], boxes: tuple[np.ndarray, np.ndarray], distance: float, most_boxes: int) -> tuple[str, float]:
    """Whether all of the planes' polyhedron inside the box lo, hi lies within a distance of the boxes: (verdict, bound).

    Parts of the box are looked at together, generation by generation. A part is done when it lies beyond a plane, or
    when its farthest point is near one box; else it is halved. verdict: near, far (a point of the polyhedron is
    farther) or work (more parts than allowed). bound: the largest distance of a part that was done. Doubles decide only
    where they are sure: a part that is beyond a plane, or near, by less than rounding is halved on.
    """
    n, offset = np.array([p[:3] for p in planes]), np.array([p[3] for p in planes])
    up, down = np.maximum(n, 0).T, np.minimum(n, 0).T
    a, b = np.array([lo], dtype=float), np.array([hi], dtype=float)
    limit, most, parts = distance * distance, 0.0, 0
    first, last = (np.asarray(x, dtype=float) for x in boxes)
    room = max(1, (1 << 20) // len(first))

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Squared distance, to the nearest box, of the point of [p, q] that is farthest from it."""
        out = np.empty(len(p))
        for i in range(0, len(p), room):
            s = slice(i, i + room)
            out[s] = (np.maximum(0, np.maximum(first - p[s, None], q[s, None] - last)) ** 2).sum(axis=2).min(axis=1)
        return out

    while len(a):
        parts += len(a)
        if parts > most_boxes:
            return "work", math.inf
        slack = SLACK * (np.maximum(np.abs(a), np.abs(b)) @ np.abs(n).T + np.abs(offset))
        stays = ~(a @ up + b @ down > offset + slack).any(axis=1)
        a, b, slack = a[stays], b[stays], slack[stays]
        far = apart(a, b) * (1 + SLACK)
        near = far <= limit
        most = max(most, far[near].max(initial=0.0))
        a, b, slack = a[~near], b[~near], slack[~near]
        middle = (a + b) / 2
        if ((apart(middle, middle) > limit * (1 + SLACK)) & (middle @ n.T <= offset - slack).all(axis=1)).any():
            return "far", math.inf
        rows, axis = np.arange(len(a)), (b - a).argmax(axis=1)
        end, start = b.copy(), a.copy()
        end[rows, axis] = start[rows, axis] = middle[rows, axis]
        a, b = np.concatenate([a, start]), np.concatenate([end, b])
    return "near", min(distance, math.nextafter(math.sqrt(most), math.inf)) if most else 0.0


# ---------------------------------------------------------------- frames


def approximate(cells: np.ndarray, budget: Budget = Budget(), h: float = 1.0) -> Hulls:  # noqa: B008
    """Convex cells of one frame. cells: (m, 6) of lower corners and widths in voxels, disjoint; the octree starts at the lowest corner."""
    found = Hulls()
    low = cells[:, :3].min(axis=0)
    lo, hi = cells[:, :3], cells[:, :3] + cells[:, 3:]
    place = lo - low

    def world(x: np.ndarray) -> list[Fraction]:
        return [Fraction(float(v) * h) for v in x]

    pool: list[Cell] = []
    for i in range(len(cells)):
        sides = [y - x for x, y in zip(world(lo[i]), world(hi[i]), strict=True)]
        planes = [(*[s * float(c == k) for c in range(3)], s * float((lo, hi)[s > 0][i][k] * h)) for k in range(3) for s in (-1.0, 1.0)]
        pool.append(Cell([i], int(np.prod(cells[i, 3:])), planes, sides[0] * sides[1] * sides[2]))
    # A box belongs to the smallest node of the octree that holds it.
    level = np.array([max(int(x).bit_length() for x in p ^ (p + w - 1)) for p, w in zip(place, cells[:, 3:], strict=True)])
    active: dict[tuple[int, ...], list[int]] = {}
    for k in range(int((hi.max(axis=0) - low - 1).max()).bit_length() + 1):
        above: dict[tuple[int, ...], list[int]] = {}
        for key, held in active.items():
            above.setdefault(tuple(x >> 1 for x in key), []).extend(held)
        for i in np.flatnonzero(level == k):
            above.setdefault(tuple((place[i] >> k).tolist()), []).append(int(i))
        active = {key: _joined(held, pool, lo, hi, budget, h, found) if len(held) > 1 else held for key, held in above.items()}
    found.cells = sorted((pool[i] for held in active.values() for i in held), key=lambda c: tuple(lo[min(c.boxes, key=lambda j: tuple(lo[j]))]))
    return found


def _joined(held: list[int], pool: list[Cell], lo: np.ndarray, hi: np.ndarray, budget: Budget, h: float, found: Hulls) -> list[int]:
    """The cells of a region, or the one hull that may stand for them."""
    mine = sorted(j for i in held for j in pool[i].boxes)
    voxels = sum(pool[i].voxels for i in held)
    own = sum(Fraction(1) * np.prod([y - x for x, y in zip(*([Fraction(float(v) * h) for v in p[j]] for p in (lo, hi)), strict=True)]) for j in mine)
    if voxels > budget.most_voxels:
        found.refused["work"] += 1
        return held
    planes, volume = supported_hull(lo[mine], hi[mine], h)
    if volume - own > Fraction(budget.inflation) * own:
        found.refused["volume"] += 1
        return held
    if len(planes) >= sum(len(pool[i].planes) for i in held):
        found.refused["gain"] += 1
        return held
    bound = 0.0
    if volume != own:  # equal volume: the hull is the region
        domain = lo[mine].min(axis=0) * h, hi[mine].max(axis=0) * h
        verdict, bound = certify_distance(*domain, planes, (lo[mine] * h, hi[mine] * h), budget.distance * h, budget.most_boxes)
        if verdict != "near":
            found.refused["work" if verdict == "work" else "distance"] += 1
            return held
    pool.append(Cell(mine, voxels, planes, volume, bound, True))
    found.accepted += 1
    return [len(pool) - 1]


def approximate_frames(voxels: DataFrame, budget: Budget = Budget(), h: float = 1.0) -> DataFrame:  # noqa: B008
    """Convex cells of every frame: frame_id, cluster_id, voxels, boxes, merged, planes (unit normal and offset, for voxels of
    size h, outward), volume (in voxels), bound (of the distance of its points from boxes, in voxels), and of the frame
    how many regions were accepted and refused, by reason.

    A refusal for work means that a larger region might be one cell: ``refused_work`` says where.
    """
    refused = [f"refused_{r}" for r in REASONS]
    names = ["frame_id", "cluster_id", "voxels", "boxes", "merged", "planes", "volume", "bound", "accepted", *refused]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cells = frame.sort_values(["lox", "loy", "loz"])[["lox", "loy", "loz", "wx", "wy", "wz"]].to_numpy()
        made = approximate(cells, budget, h)
        unit = Fraction(h) ** 3
        counts = [made.accepted, *(made.refused[r] for r in REASONS)]
        rows = [
            (frame["frame_id"].iloc[0], i, c.voxels, len(c.boxes), c.merged, [list(p) for p in c.planes], float(c.volume / unit), c.bound / h, *counts) for i, c in enumerate(made.cells)
        ]
        return pd.DataFrame(rows, columns=names)

    schema = "frame_id long, cluster_id long, voxels long, boxes long, merged boolean, planes array<array<double>>, volume double, bound double, accepted long, "
    return rectangular_cells(voxels).groupBy("frame_id").applyInPandas(run, schema + ", ".join(f"{c} long" for c in refused))


def report(found: DataFrame) -> DataFrame:
    """By frame: cells, planes, and planes of the boxes they stand for, volume added as a share, the largest bound, regions
    accepted and refused by reason, and ``complete``: whether no work limit was met."""
    counts = ["accepted", *(f"refused_{r}" for r in REASONS)]
    return found.groupBy("frame_id").agg(
        F.count(F.lit(1)).alias("clusters"),
        F.sum(F.size("planes")).alias("planes"),
        (6 * F.sum("boxes")).alias("box_planes"),
        (F.sum("volume") / F.sum("voxels") - 1).alias("inflation"),
        F.max("bound").alias("bound"),
        *[F.max(c).alias(c) for c in counts],
        (F.max("refused_work") == 0).alias("complete"),
    )
