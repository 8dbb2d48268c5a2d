"""Convex clusters: agglomeration of tetrahedra, support planes, hulls of voxel boxes, and their validation.

Growing clusters is a priority queue over a frame's adjacency and a hull needs all of its points, so both are
kernels over one frame; what goes in and out are tables.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .balls import smoothed
from .surfaces import exact_side, places_of, whole_meshes

#: Frames whose result a task remembers.
MOST_KNOWN = 1024
#: Cells of a block along an axis, and points of a task, in a smoothing.
BLOCK, POINTS_A_TASK = 2, 1 << 14


def hull_planes(points: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Facet planes (nx, ny, nz, offset) of the convex hull of integer points, exact, normals outward and primitive.

    Coplanar facets come out as one plane. Points must not all be coplanar.
    """
    planes = set()
    for p, _, _, n in _facets(points):
        g = np.gcd.reduce([abs(k) for k in n])
        m = tuple(int(k // g) for k in n)
        planes.add((*m, sum(a * b for a, b in zip(m, p, strict=True))))
    return sorted(planes)


def hull_volume(points: list[tuple[int, int, int]]) -> Fraction:
    """Exact volume of the convex hull of integer points that are not all coplanar."""
    return Fraction(sum(sum(a * b for a, b in zip(n, p, strict=True)) for p, _, _, n in _facets(points)), 6)


def _facets(points: list[tuple[int, int, int]]) -> list[tuple]:
    """Triangles (p, q, r, normal) of the hull, normals outward.

    Incremental: facets that a new point sees give way to a fan over their horizon.
    """
    pts = sorted(set(points))

    def normal(a, b, c):
        u, v = [b[k] - a[k] for k in range(3)], [c[k] - a[k] for k in range(3)]
        return (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])

    def dot(n, p):
        return n[0] * p[0] + n[1] * p[1] + n[2] * p[2]

    a = pts[0]
    b = next((p for p in pts if p != a), None)
    c = next((p for p in pts if b and any(normal(a, b, p))), None)
    d = next((p for p in pts if c and dot(normal(a, b, c), p) != dot(normal(a, b, c), a)), None)
    if d is None:
        raise ValueError("the points lie in one plane")
    middle = [Fraction(a[k] + b[k] + c[k] + d[k], 4) for k in range(3)]

    def facet(p, q, r):
        n = normal(p, q, r)
        return (p, q, r, n) if dot(n, middle) < dot(n, p) else (p, r, q, tuple(-x for x in n))

    facets = [facet(*t) for t in itertools.combinations((a, b, c, d), 3)]
    for x in pts:
        above = [dot(f[3], x) > dot(f[3], f[0]) for f in facets]
        if not any(above):
            continue
        seen = [f for f, over in zip(facets, above, strict=True) if over]
        sides = {(f[i], f[(i + 1) % 3]) for f in seen for i in range(3)}
        hidden = [f for f, over in zip(facets, above, strict=True) if not over]
        fan = [(p, q, x, normal(p, q, x)) for p, q in sides if (q, p) not in sides]
        facets = hidden + [f for f in fan if any(f[3])]
    return facets


def box_hulls(cells: DataFrame) -> DataFrame:
    """Hull planes of groups of integer boxes: rows frame_id, group_id, nx, ny, nz, offset (grid units).

    cells: frame_id, group_id, lo* and w*. Planes are exact integers; every corner is on the inner side.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        corners = {
            tuple(int(r[f"lo{c}"]) + d * int(r[f"w{c}"]) for c, d in zip("xyz", s, strict=True)) for r in frame.to_dict("records") for s in itertools.product((0, 1), repeat=3)
        }
        planes = hull_planes(list(corners))
        head = frame.iloc[0]
        return pd.DataFrame([(head["frame_id"], head["group_id"], *p) for p in planes], columns=["frame_id", "group_id", "nx", "ny", "nz", "offset"])

    return cells.groupBy("frame_id", "group_id").applyInPandas(run, "frame_id long, group_id long, nx long, ny long, nz long, offset long")


def tet_volume(p: np.ndarray) -> np.ndarray:
    """Volumes of tetrahedra (n, 4, 3)."""
    return np.abs(np.einsum("ni,ni->n", p[:, 1] - p[:, 0], np.cross(p[:, 2] - p[:, 0], p[:, 3] - p[:, 0]))) / 6


@dataclass
class Cluster:
    """A convex union of tetrahedra: outer faces by their corners, each with its plane; corners; area shared with neighbours."""

    cells: list[int]
    faces: dict[tuple[int, ...], int]
    corners: np.ndarray
    near: set[int]
    version: int = 0


class Agglomeration:
    """Neighbours merge while their union stays convex, by a queue of candidates.

    Faces turned outward have planes, of which those that agree to ``digits`` are one, the first face's. A cluster is convex, so its own
    corners need no look at its own planes: a union is convex if the corners of each lie at or below the planes of the
    other that still carry a face. Sides are decided in doubles where these are sure, else exactly.
    """

    def __init__(self, vertices: np.ndarray, tets: np.ndarray, tolerance: float, digits: int = 9):
        self.x, self.tolerance = vertices, tolerance
        self.planes: list[tuple] = []  # unit normal, offset, corners of a face, exact side of the inside
        known: dict[tuple, int] = {}
        owners: dict[tuple[int, ...], list[int]] = {}
        self.area: dict[tuple[int, ...], float] = {}
        self.clusters: list[Cluster | None] = []
        self.scale = float(np.abs(vertices).max(initial=1.0)) or 1.0
        for t, v in enumerate(tets.tolist()):
            faces = {}
            for k in range(4):
                f = tuple(sorted(v[:k] + v[k + 1 :]))
                owners.setdefault(f, []).append(t)
                a, b, c = vertices[list(f)]
                n = np.cross(b - a, c - a)
                size = float(np.linalg.norm(n))
                self.area[f] = size / 2
                inner = exact_side(a, b, c, vertices[v[k]])
                if not inner or not size:
                    faces[f] = -1  # a flat tetrahedron is part of no convex union
                    continue
                n = n / size * -inner
                key = (*(np.round(n, digits) + 0.0).tolist(), round(float(n @ a), digits) + 0.0)
                faces[f] = known.setdefault(key, len(self.planes))
                if faces[f] == len(self.planes):
                    self.planes.append((n, float(n @ a), (a, b, c), inner))
            self.clusters.append(Cluster([t], faces, np.array(sorted(v)), set()))
        for ts in owners.values():
            for a, b in itertools.permutations(ts, 2):
                self.clusters[a].near.add(b)

    def candidate(self, a: int, b: int) -> tuple:
        """Order of a candidate: shared area, largest first; outer faces and planes of the union, fewest first; numbers."""
        a, b = min(a, b), max(a, b)
        p, q = self.clusters[a], self.clusters[b]
        few, many = (p, q) if len(p.faces) <= len(q.faces) else (q, p)
        shared = [f for f in few.faces if f in many.faces]
        area = sum(sorted(self.area[f] for f in shared))
        return (-area, len(p.faces) + len(q.faces) - 2 * len(shared), len(self._outer(p, q) | self._outer(q, p)), a, b, p.version, q.version)

    @staticmethod
    def _outer(p: Cluster, q: Cluster) -> set[int]:
        """Planes of p's faces that are not q's."""
        return {plane for f, plane in p.faces.items() if f not in q.faces}

    def _below(self, plane: int, corners: np.ndarray) -> bool:
        if plane < 0:
            return False
        n, offset, face, inner = self.planes[plane]
        height = self.x[corners] @ n - offset
        if (height > self.tolerance).any():
            return False
        for c in corners[height > -1e-12 * self.scale]:
            if exact_side(*face, self.x[c]) == -inner:
                return False
        return True

    def convex(self, p: Cluster, q: Cluster) -> bool:
        return all(self._below(k, q.corners) for k in self._outer(p, q)) and all(self._below(k, p.corners) for k in self._outer(q, p))

    def run(self, target: int = 0, most_cells: int = 0, most_planes: int = 0) -> list[Cluster]:
        """Merged clusters; 0 stands for no limit: of the number of clusters to stop at, of tetrahedra and planes of one."""
        queue = [self.candidate(a, b) for a, c in enumerate(self.clusters) for b in c.near if a < b]
        heapq.heapify(queue)
        left = len(self.clusters)
        while queue and not (target and left <= target):
            *_, planes, a, b, va, vb = heapq.heappop(queue)
            p, q = self.clusters[a], self.clusters[b]
            if p is None or q is None or (p.version, q.version) != (va, vb):
                continue
            if (most_cells and len(p.cells) + len(q.cells) > most_cells) or (most_planes and planes > most_planes) or not self.convex(p, q):
                continue
            near = (p.near | q.near) - {a, b}
            faces = {f: k for one, other in ((p, q), (q, p)) for f, k in one.faces.items() if f not in other.faces}
            self.clusters[a] = Cluster(p.cells + q.cells, faces, np.union1d(p.corners, q.corners), near, p.version + 1)
            self.clusters[b] = None
            left -= 1
            for c in near:
                self.clusters[c].near -= {a, b}
                self.clusters[c].near.add(a)
                heapq.heappush(queue, self.candidate(a, c))
        return [c for c in self.clusters if c is not None]


def agglomerate(vertices: np.ndarray, tets: np.ndarray, tolerance: float = 1e-9, **limits: int) -> np.ndarray:
    """Cluster number of each tetrahedron; clusters are numbered by their first tetrahedron. See ``Agglomeration``."""
    out = np.zeros(len(tets), np.int64)
    for i, c in enumerate(sorted(Agglomeration(vertices, tets, tolerance).run(**limits), key=lambda c: min(c.cells))):
        out[c.cells] = i
    return out


def _listed(vertices: DataFrame, tets: DataFrame) -> DataFrame:
    """One row a frame of tetrahedra: frame_id, tets and v (their numbers and corners), names and x (its vertices' numbers and places)."""
    order = F.sort_array(F.collect_list(F.struct("vertex_id", *"xyz")))
    placed = vertices.groupBy("frame_id").agg(order.alias("p")).select("frame_id", F.transform("p", lambda p: p["vertex_id"]).alias("names"), F.flatten(F.transform("p", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("x"))
    listed = tets.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("tet_id", "v"))).alias("t"))
    listed = listed.select("frame_id", F.transform("t", lambda t: t["tet_id"]).alias("tets"), F.flatten(F.transform("t", lambda t: t["v"])).alias("v"))
    return listed.join(placed.hint("merge"), "frame_id", "left")


def _once(frame: pd.DataFrame, known: dict, work: Callable[[np.ndarray, np.ndarray], object]) -> Iterator[tuple]:
    """Frames of ``_listed`` with what work says of their points and tetrahedra; equal ones are worked out once a task."""
    for fid, ids, names, x, v in zip(frame["frame_id"], frame["tets"], frame["names"], frame["x"], frame["v"], strict=True):
        if names is None or not np.isin(v, names).all():
            raise ValueError(f"frame {fid} has tetrahedra of unknown vertices")
        at, points = np.searchsorted(names, v).reshape(-1, 4), np.ascontiguousarray(x, dtype=np.float64).reshape(-1, 3)
        key = (points.tobytes(), at.tobytes())
        if key not in known:
            if len(known) >= MOST_KNOWN or len(at) > MOST_KNOWN:
                known.clear()
            known[key] = work(points, at)
        yield fid, ids, known[key]


def agglomerate_frames(vertices: DataFrame, tets: DataFrame, **limits: int) -> DataFrame:
    """Rows (frame_id, tet_id, cluster_id) of tables vertex (frame_id, vertex_id, x, y, z) and tet (frame_id, tet_id, v).

    limits: target, most_cells and most_planes of ``Agglomeration.run``.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[bytes, bytes], np.ndarray] = {}
        for frame in frames:
            found = [made for *_, made in _once(frame, known, lambda x, at: agglomerate(x, at, **limits))]
            if found:
                sizes = frame["tets"].map(len).to_numpy()
                yield pd.DataFrame({"frame_id": np.repeat(frame["frame_id"].to_numpy(), sizes), "tet_id": np.concatenate(list(frame["tets"])), "cluster_id": np.concatenate(found)})

    return _listed(vertices, tets).mapInPandas(run, "frame_id long, tet_id long, cluster_id long")


def clustered_frames(vertices: DataFrame, tets: DataFrame, **limits: int) -> DataFrame:
    """``agglomerate_frames`` with faces, one row a frame: frame_id, tets and clusters (arrays), and packed doubles of the corners of
    each tetrahedron (12), of the outer triangles of all (surface: 0 and 9) and of each cluster (faces: its number and 9).

    A frame's tetrahedra are in one task for their queue in any case; so their faces need neither shuffles nor joins. Triangles
    are those of ``meshes.cluster_faces``.
    """

    def work(x: np.ndarray, at: np.ndarray) -> tuple:
        found = agglomerate(x, at, **limits)
        return found, x[at].tobytes(), outer_triangles(x, at, np.zeros(len(at), np.int64)).tobytes(), outer_triangles(x, at, found).tobytes()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[bytes, bytes], tuple] = {}
        for frame in frames:
            yield pd.DataFrame([(fid, ids, *made) for fid, ids, made in _once(frame, known, work)], columns=["frame_id", "tets", "clusters", "corners", "surface", "faces"])

    return _listed(vertices, tets).mapInPandas(run, "frame_id long, tets array<long>, clusters array<long>, corners binary, surface binary, faces binary")


def outer_triangles(x: np.ndarray, at: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Outward triangles of clusters ``of`` of tetrahedra ``at`` of points x: rows of the cluster and nine coordinates, in order of cluster and corners."""
    sides = [np.sort(np.delete(at, i, axis=1), axis=1) for i in range(4)]
    rows = np.column_stack([np.tile(of, 4), np.concatenate(sides)])
    faces, first, uses = np.unique(rows, axis=0, return_index=True, return_counts=True)
    once = uses == 1
    a, b, c = (x[faces[once, k]] for k in (1, 2, 3))
    o = x[at.T.ravel()[first[once]]]
    u, v, w = b - a, c - a, o - a
    n = (u[:, 1] * v[:, 2] - u[:, 2] * v[:, 1], u[:, 2] * v[:, 0] - u[:, 0] * v[:, 2], u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    turned = (n[0] * w[:, 0] + n[1] * w[:, 1] + n[2] * w[:, 2] > 0)[:, None]
    return np.column_stack([faces[once, 0], a, np.where(turned, c, b), np.where(turned, b, c)])


def convexity_violations(points: DataFrame, planes: DataFrame, tolerance: float) -> DataFrame:
    """By frame and cluster: points of it that lie beyond one of its planes by more than the tolerance.

    points: frame_id, cluster_id, x, y, z; planes: frame_id, cluster_id, nx, ny, nz, offset.
    """
    value = F.col("nx") * F.col("x") + F.col("ny") * F.col("y") + F.col("nz") * F.col("z") - F.col("offset")
    return points.join(planes, ["frame_id", "cluster_id"]).groupBy("frame_id", "cluster_id").agg(F.count_if(value > tolerance).alias("beyond"))


def jet_smooth(points: DataFrame, radius: float, least: int = 12) -> DataFrame:
    """points moved onto a local surface: the degree-2 fit of the neighbours within a radius, along their normal.

    Neighbours come from the 27 grid cells around a point: each point is dealt to the blocks of cells that it may serve, so
    a block and its rim are one task, which works cell by cell; see ``balls``. Points with fewer than ``least`` neighbours
    stay. Rows: frame_id, point_id, x, y, z and moved.
    """
    cell, block = ["cx", "cy", "cz"], ["frame_id", "bx", "by", "bz"]
    own = points.select("frame_id", "point_id", *"xyz").withColumns({f"c{c}": F.floor(F.col(c) / radius) for c in "xyz"})
    held = own
    for c, b in zip(cell, block[1:], strict=True):
        held = held.withColumn(b, F.explode(F.array_distinct(F.array(F.floor((F.col(c) - 1) / BLOCK), F.floor((F.col(c) + 1) / BLOCK)))))
    mine = [F.floor(F.col(c) / BLOCK).eqNullSafe(F.col(b)) for c, b in zip(cell, block[1:], strict=True)]
    held = held.withColumn("mine", mine[0] & mine[1] & mine[2])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_meshes(frames, block):
            x, own, c, done = frame[["x", "y", "z"]].to_numpy(dtype=np.float64), frame["mine"].to_numpy(), frame[cell].to_numpy(), []
            ends = np.append(np.flatnonzero(np.diff(places_of(frame, block), prepend=-1)), len(frame))
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                mine = np.flatnonzero(own[a:b])
                if len(mine):
                    done.append((a + mine, *smoothed(x[a:b], mine, c[a:b], radius, least)))
            if done:
                at, out, moved = (np.concatenate(parts) for parts in zip(*done, strict=True))
                yield pd.DataFrame({"frame_id": frame["frame_id"].to_numpy()[at], "point_id": frame["point_id"].to_numpy()[at], "x": out[:, 0], "y": out[:, 1], "z": out[:, 2], "moved": moved})

    # Dense blocks are few and take most of the time, so that they are dealt to many tasks.
    tasks = max(4 * points.sparkSession.sparkContext.defaultParallelism, -(-points.count() // POINTS_A_TASK))
    dealt = held.repartition(tasks, *block).sortWithinPartitions(*block)
    return dealt.mapInPandas(run, "frame_id long, point_id long, x double, y double, z double, moved boolean")
