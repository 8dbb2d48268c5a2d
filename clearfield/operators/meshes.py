"""Triangle meshes and tetrahedra as tables: edges, planes, volume, winding, containment, adjacency.

mesh_vertex(vertex_id, x, y, z); mesh_face(face_id, v array<int>); tet(tet_id, v array<long>).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import cross, dot, length, minus
from ..sources.staging import written
from .meet import meet, packed, unpacked

#: Tetrahedra of a task that lists their faces.
TETS_A_TASK = 1 << 18
#: Clusters whose planes a task remembers.
MOST_KNOWN = 1024


def parse_off(spark: SparkSession, text: str) -> tuple[DataFrame, DataFrame]:
    """Vertices and triangulated faces of an OFF text (fans of polygons); a malformed text is an error."""
    tokens = [t for line in text.splitlines() for t in line.split("#")[0].split()]
    if not tokens or tokens[0] != "OFF":
        raise ValueError("not an OFF text")
    nv, nf = int(tokens[1]), int(tokens[2])
    numbers = [float(t) for t in tokens[4 : 4 + 3 * nv]]
    at, faces = 4 + 3 * nv, []
    for _ in range(nf):
        k = int(tokens[at])
        ring = [int(t) for t in tokens[at + 1 : at + 1 + k]]
        if k < 3 or any(not 0 <= v < nv for v in ring):
            raise ValueError("a face needs three known vertices or more")
        faces += [[ring[0], ring[i], ring[i + 1]] for i in range(1, k - 1)]
        at += k + 1
    vertices = [(i, *numbers[3 * i : 3 * i + 3]) for i in range(nv)]
    return (
        spark.createDataFrame(vertices, "vertex_id int, x double, y double, z double"),
        spark.createDataFrame(list(enumerate(faces)), "face_id int, v array<int>"),
    )


def write_off(vertices: list[tuple[float, float, float]], faces: list[list[int]]) -> str:
    """OFF text of a mesh."""
    lines = ["OFF", f"{len(vertices)} {len(faces)} 0", *(" ".join(repr(float(c)) for c in v) for v in vertices)]
    return "\n".join([*lines, *(" ".join(map(str, [len(f), *f])) for f in faces)]) + "\n"


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """faces with their corners' coordinates ax .. cz."""
    out = faces.select("face_id", *[F.get("v", F.lit(k)).alias(f"v{c}") for k, c in enumerate("abc")])
    for c in "abc":
        at = vertices.select(F.col("vertex_id").alias(f"v{c}"), *[F.col(k).alias(f"{c}{k}") for k in "xyz"])
        out = out.join(at, f"v{c}")
    return out


def _corner(c: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{c}{k}") for k in "xyz")


def face_planes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Unit normal, area and d of each face's plane, with n . x + d = 0 on it."""
    t = triangles(vertices, faces)
    n = cross(minus(_corner("b"), _corner("a")), minus(_corner("c"), _corner("a")))
    size = length(n)
    unit = [x / size for x in n]
    return t.select("face_id", *[u.alias(f"n{k}") for u, k in zip(unit, "xyz", strict=True)], (size / 2).alias("area"), (-dot(tuple(unit), _corner("a"))).alias("d"))


def volume(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Signed volume and area of a closed mesh: one row."""
    t = triangles(vertices, faces)
    n = cross(minus(_corner("b"), _corner("a")), minus(_corner("c"), _corner("a")))
    return t.agg(F.sum(dot(_corner("a"), cross(_corner("b"), _corner("c"))) / 6).alias("volume"), F.sum(length(n) / 2).alias("area"))


def edges(faces: DataFrame) -> DataFrame:
    """Each edge once: its two vertices, its faces in order (-1 for a missing second), and how often it is used."""
    v = [F.get("v", F.lit(k)) for k in range(3)]
    sides = F.array(*[F.struct(F.least(v[i], v[(i + 1) % 3]).alias("a"), F.greatest(v[i], v[(i + 1) % 3]).alias("b"), "face_id") for i in range(3)])
    each = faces.select(F.explode(sides).alias("e")).select("e.*")
    # Three faces at most are looked at; an edge of a manifold has two.
    return each.groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses"), F.min("face_id").alias("left"), F.max("face_id").alias("last")).select(
        "a", "b", "uses", "left", F.when(F.col("uses") > 1, F.col("last")).otherwise(-1).alias("right")
    )


def closed(faces: DataFrame) -> DataFrame:
    """One row: edges, and edges that are not used exactly twice (0 for a closed mesh)."""
    return edges(faces).agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("uses") != 2).alias("open_edges"))


def edge_kinds(vertices: DataFrame, faces: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """edges with their length and kind: flat, convex or reflex, by the far vertex of the second face."""
    planes = face_planes(vertices, faces).select(F.col("face_id").alias("left"), "nx", "ny", "nz", "d")
    far = faces.select(F.col("face_id").alias("right"), "v")
    e = edges(faces).where("uses = 2").join(planes, "left").join(far, "right")
    third = F.get(F.filter("v", lambda x: (x != F.col("a")) & (x != F.col("b"))), F.lit(0))
    e = e.withColumn("third", third)
    for c in ("a", "b", "third"):
        e = e.join(vertices.select(F.col("vertex_id").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in "xyz"]), c)
    side = F.col("nx") * F.col("third_x") + F.col("ny") * F.col("third_y") + F.col("nz") * F.col("third_z") + F.col("d")
    span = length(tuple(F.col(f"b_{k}") - F.col(f"a_{k}") for k in "xyz"))
    kind = F.when(F.abs(side) <= tolerance, "flat").when(side < 0, "convex").otherwise("reflex")
    return e.select("a", "b", "left", "right", span.alias("length"), kind.alias("kind"))


def coplanar_groups(vertices: DataFrame, faces: DataFrame, digits: int = 9) -> DataFrame:
    """Faces grouped by plane (normal and offset rounded to ``digits``), with number and area."""
    p = face_planes(vertices, faces)
    rounded = {c: F.round(F.col(c), digits) + F.lit(0.0) for c in ("nx", "ny", "nz", "d")}
    return p.withColumns(rounded).groupBy("nx", "ny", "nz", "d").agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum("area"), digits).alias("area"))


def points_in_mesh(points: DataFrame, vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """points, all columns, with ``inside`` of a closed mesh: parity of crossings of a ray along x.

    Edges count half-open in y and z, so a ray through an edge or vertex crosses one triangle of each side.
    Points and triangles are taken in blocks; a block of points looks at the triangles before it only.
    """
    # All points meet the one mesh, whatever frames they are of.
    columns = points.columns
    held = points.select(F.lit(0).cast("long").alias("frame_id"), *[F.col(f"`{c}`").alias("of_frame" if c == "frame_id" else c) for c in columns])
    found = points_in_triangles(held, triangles(vertices, faces).withColumn("frame_id", F.lit(0).cast("long")))
    return found.select(*[F.col("of_frame").alias(c) if c == "frame_id" else F.col(f"`{c}`") for c in columns if c != "inside"], "inside")


_CORNERS = [f"{c}{k}" for c in "abc" for k in "xyz"]


def points_in_triangles(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """points, all columns, with ``inside`` of the closed mesh of their frame, given as rows frame_id, ax .. cz."""

    def compute(pts: pd.DataFrame, t: np.ndarray) -> dict[str, np.ndarray]:
        return {"inside": in_triangles(pts[["x", "y", "z"]].to_numpy(dtype=np.float64), t.reshape(-1, 3, 3))}

    return meet(points, packed(triangles, _CORNERS), unpacked(9), compute, "inside boolean")


def in_triangles(x: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Whether points x (n, 3) are inside of the closed mesh of triangles (m, 3, 3)."""
    inside = np.zeros(len(x), bool)
    low, high = corners.min(axis=1), corners.max(axis=1)
    order = np.lexsort((x[:, 1], np.floor(x[:, 2] * 16)))
    for at in range(0, len(x), 512):
        mine = order[at : at + 512]
        p = x[mine]
        near = np.flatnonzero((low[:, 1:] <= p[:, 1:].max(axis=0)).all(axis=1) & (high[:, 1:] >= p[:, 1:].min(axis=0)).all(axis=1) & (high[:, 0] > p[:, 0].min()))
        for s in range(0, len(near), 512):
            inside[mine] ^= crossings(p, corners[near[s : s + 512]]) % 2 == 1
    return inside


def points_on_triangles(points: DataFrame, triangles: DataFrame, band: float) -> DataFrame:
    """points, all columns, with ``on``: whether a triangle of their frame (rows frame_id, ax .. cz) lies within the band.

    Within its plane by the band, and inside its edges, moved out by as much.
    """

    def compute(pts: pd.DataFrame, t: np.ndarray) -> dict[str, np.ndarray]:
        return {"on": on_triangles(pts[["x", "y", "z"]].to_numpy(dtype=np.float64), t.reshape(-1, 3, 3), band)}

    return meet(points, packed(triangles, _CORNERS), unpacked(9), compute, "on boolean")


def on_triangles(x: np.ndarray, corners: np.ndarray, band: float) -> np.ndarray:
    """Whether points x (n, 3) are within the band of one of the triangles (m, 3, 3)."""
    on = np.zeros(len(x), bool)
    for s in range(0, len(corners), 256):
        c = corners[s : s + 256]
        n = np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0])
        n /= np.linalg.norm(n, axis=1)[:, None]
        near = np.abs(np.einsum("nmi,mi->nm", x[:, None] - c[None, :, 0], n)) <= band
        for k in range(3):
            side = np.cross(n, c[:, (k + 1) % 3] - c[:, k])
            side /= np.linalg.norm(side, axis=1)[:, None]
            near &= np.einsum("nmi,mi->nm", x[:, None] - c[None, :, k], side) >= -band
        on |= near.any(axis=1)
    return on


def sides(points: DataFrame, triangles: DataFrame, band: float) -> DataFrame:
    """points, all columns, with ``side`` of their frame's closed mesh: boundary (within the band), bounded or unbounded."""
    both = points_on_triangles(points_in_triangles(points, triangles), triangles, band)
    return both.withColumn("side", F.when(F.col("on"), "boundary").when(F.col("inside"), "bounded").otherwise("unbounded")).drop("on", "inside")


def crossings(p: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """Triangles (m, 3, 3) that a ray along x from each point (n, 3) crosses."""
    y, z = p[:, 1, None], p[:, 2, None]
    odd = np.zeros((len(p), len(corners)), bool)
    with np.errstate(divide="ignore", invalid="ignore"):
        for i in range(3):
            a, b = corners[:, i], corners[:, (i + 1) % 3]
            spans = (a[None, :, 2] > z) != (b[None, :, 2] > z)
            odd ^= spans & (y < (b[:, 1] - a[:, 1]) * (z - a[:, 2]) / (b[:, 2] - a[:, 2]) + a[:, 1])
        a = corners[:, 0]
        n = np.cross(corners[:, 1] - a, corners[:, 2] - a)
        at = a[:, 0] - ((y - a[:, 1]) * n[:, 1] + (z - a[:, 2]) * n[:, 2]) / n[:, 0]
        return (odd & (n[None, :, 0] != 0) & (at > p[:, 0, None])).sum(axis=1)


def points_in_tets(points: DataFrame, vertices: DataFrame, tets: DataFrame) -> DataFrame:
    """points (frame_id, x, y, z, any other columns) with ``tets``: how many closed tetrahedra of their frame hold each.

    vertices: frame_id, vertex_id, x, y, z; tets: frame_id, tet_id, v.
    """
    t = tets.select("frame_id", *[F.get("v", F.lit(k)).alias(f"v{k}") for k in range(4)])
    for k in range(4):
        t = t.join(vertices.select("frame_id", F.col("vertex_id").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"]), ["frame_id", f"v{k}"])

    def compute(pts: pd.DataFrame, side: np.ndarray) -> dict[str, np.ndarray]:
        return {"tets": in_tets(pts[["x", "y", "z"]].to_numpy(), side.reshape(-1, 4, 3))}

    return meet(points, packed(t, [f"{c}{k}" for k in range(4) for c in "xyz"]), unpacked(12), compute, "tets long")


def in_tets(x: np.ndarray, corners: np.ndarray) -> np.ndarray:
    """How many closed tetrahedra (m, 4, 3) hold each of the points x (n, 3)."""
    count = np.zeros(len(x), np.int64)
    for s in range(0, len(corners), 256):
        c = corners[s : s + 256]
        held = np.ones((len(x), len(c)), bool)
        for k in range(4):
            a, b, d = (c[:, i] for i in range(4) if i != k)
            n = np.cross(b - a, d - a)
            inner = np.einsum("mi,mi->m", n, c[:, k] - a)
            held &= (np.einsum("nmi,mi->nm", x[:, None, :] - a[None], n) * np.sign(inner) >= 0)
        count += held.sum(axis=1)
    return count


def cluster_faces(tets: DataFrame, clusters: DataFrame, vertices: DataFrame) -> DataFrame:
    """Outward triangles of clusters of tetrahedra: frame_id, cluster_id and the corners ax .. cz.

    tets: frame_id, tet_id, v; clusters: frame_id, tet_id, cluster_id. A face that two tetrahedra of a cluster
    share is inside it. A face is turned away from the vertex opposite to it.
    """
    v = [F.get("v", F.lit(k)) for k in range(4)]
    sides = F.array(*[F.struct(F.array_sort(F.array(*[v[k] for k in range(4) if k != i])).alias("f"), v[i].alias("o")) for i in range(4)])
    each = tets.join(clusters, ["frame_id", "tet_id"]).select("frame_id", "cluster_id", F.explode(sides).alias("s")).select("frame_id", "cluster_id", "s.f", "s.o")
    outer = each.groupBy("frame_id", "cluster_id", "f").agg(F.count(F.lit(1)).alias("uses"), F.max("o").alias("vo")).where("uses = 1")
    out = outer.select("frame_id", "cluster_id", "vo", *[F.get("f", F.lit(k)).alias(f"v{c}") for k, c in enumerate("abc")])
    for c in "abco":
        out = out.join(vertices.select("frame_id", F.col("vertex_id").alias(f"v{c}"), *[F.col(k).alias(f"{c}{k}") for k in "xyz"]), ["frame_id", f"v{c}"])
    n = cross(minus(_corner("b"), _corner("a")), minus(_corner("c"), _corner("a")))
    turned = dot(n, minus(_corner("o"), _corner("a"))) > 0
    ends = [F.when(turned, F.col(f"c{k}")).otherwise(F.col(f"b{k}")).alias(f"b{k}") for k in "xyz"] + [F.when(turned, F.col(f"b{k}")).otherwise(F.col(f"c{k}")).alias(f"c{k}") for k in "xyz"]
    return out.select("frame_id", "cluster_id", *[f"a{k}" for k in "xyz"], *ends)


def points_in_clusters(points: DataFrame, triangles: DataFrame) -> DataFrame:
    """points, all columns, with q: the least over their frame's clusters of the greatest of their faces' planes.

    triangles: frame_id, cluster_id, ax .. cz, turned outward; a convex cluster holds a point iff its value is <= 0.
    """

    def compute(pts: pd.DataFrame, t: np.ndarray) -> dict[str, np.ndarray]:
        return {"q": cluster_values(pts[["x", "y", "z"]].to_numpy(dtype=np.float64), t)}

    return meet(points, packed(triangles, ["cluster_id", *_CORNERS]), unpacked(10), compute, "q double")


def cluster_values(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """``points_in_clusters`` of points x (n, 3); t: rows of a cluster's number and nine coordinates."""
    of, corners = t[:, 0], t[:, 1:].reshape(-1, 3, 3)
    n = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    n /= np.linalg.norm(n, axis=1)[:, None]
    offset = np.einsum("mi,mi->m", n, corners[:, 0])
    best = np.full(len(x), np.inf)
    for c in np.unique(of):
        mine, worst = np.flatnonzero(of == c), np.full(len(x), -np.inf)
        for s in range(0, len(mine), 256):
            at = mine[s : s + 256]
            worst = np.maximum(worst, (x @ n[at].T - offset[at]).max(axis=1))
        best = np.minimum(best, worst)
    return best


def support_planes(triangles: DataFrame, angle: float = 0.0) -> DataFrame:
    """Fewer planes of convex clusters: frame_id, cluster_id, nx, ny, nz, offset, faces, area.

    triangles: frame_id, cluster_id, ax .. cz, turned outward. Faces are taken by area, largest first, and join
    the first plane whose normal is within ``angle`` (radians) of theirs; at 0 those of one plane are one, exactly
    but for rounding. A plane's normal is that of its faces, weighted by area; its offset is the greatest of all
    corners of the cluster, so that the planes hold the whole cluster: nothing is cut off, something may be added.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, list[tuple]] = {}
        for frame in frames:
            rows = []
            for f, c, x in zip(frame["frame_id"], frame["cluster_id"], frame["x"], strict=True):
                corners = np.ascontiguousarray(x, dtype=np.float64).reshape(-1, 3, 3)
                key = corners.tobytes()
                if key not in known:
                    if len(known) >= MOST_KNOWN or len(corners) > MOST_KNOWN:
                        known.clear()
                    known[key] = _planes(corners, angle)
                rows += [(f, c, *p) for p in known[key]]
            yield pd.DataFrame(rows, columns=["frame_id", "cluster_id", "nx", "ny", "nz", "offset", "faces", "area"])

    # Clusters of equal faces are reduced once a task.
    schema = "frame_id long, cluster_id long, nx double, ny double, nz double, offset double, faces long, area double"
    listed = triangles.groupBy("frame_id", "cluster_id").agg(F.flatten(F.array_sort(F.collect_list(F.array(*_CORNERS)))).alias("x"))
    return listed.mapInPandas(run, schema)


def _planes(corners: np.ndarray, angle: float) -> list[tuple]:
    """``support_planes`` of one cluster's triangles (n, 3, 3)."""
    n = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    area = np.linalg.norm(n, axis=1) / 2
    unit, points = n / (2 * area)[:, None], corners.reshape(-1, 3)
    least, sums, firsts, members = np.cos(angle) - 1e-12, [], [], []
    for i in sorted(range(len(n)), key=lambda i: (-round(area[i], 12), *np.round(unit[i], 12))):
        k = next((k for k, first in enumerate(firsts) if unit[first] @ unit[i] >= least), None)
        if k is None:
            firsts.append(i), sums.append(n[i].copy()), members.append([i])
        else:
            sums[k] += n[i]
            members[k].append(i)
    out = []
    for total, mine in zip(sums, members, strict=True):
        normal = total / np.linalg.norm(total)
        out.append((*normal, float((points @ normal).max()), len(mine), float(area[mine].sum())))
    return out


def packed_triangles(frames: DataFrame, column: str) -> DataFrame:
    """Rows frame_id, cluster_id, ax .. cz of triangles that are packed by frame; see ``clusters.clustered_frames``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = [np.frombuffer(side).reshape(-1, 10) for side in batch["side"]]
                x = np.concatenate(rows)
                yield pd.DataFrame({"frame_id": np.repeat(batch["frame_id"].to_numpy(), [len(r) for r in rows]), "cluster_id": x[:, 0].astype(np.int64), **{c: x[:, 1 + k] for k, c in enumerate(_CORNERS)}})

    return frames.select("frame_id", F.col(column).alias("side")).mapInPandas(run, "frame_id long, cluster_id long, " + ", ".join(f"{c} double" for c in _CORNERS))


def packed_planes(frames: DataFrame, column: str, angle: float = 0.0) -> DataFrame:
    """``support_planes`` of triangles that are packed by frame; frames of equal triangles are reduced once a task."""

    def found(side: bytes) -> np.ndarray:
        t = np.frombuffer(side).reshape(-1, 10)
        t, out = t[np.lexsort(t.T[::-1])], []
        for c in np.unique(t[:, 0]):
            out += [(c, *p) for p in _planes(t[t[:, 0] == c, 1:].reshape(-1, 3, 3), angle)]
        return np.array(out, dtype=np.float64).reshape(-1, 7)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, np.ndarray] = {}
        for batch in batches:
            made = []
            for side in batch["side"]:
                if side not in known:
                    if len(known) >= MOST_KNOWN or len(side) > 80 * MOST_KNOWN:
                        known.clear()
                    known[side] = found(side)
                made.append(known[side])
            if made:
                p = np.concatenate(made)
                yield pd.DataFrame({"frame_id": np.repeat(batch["frame_id"].to_numpy(), [len(m) for m in made]), "cluster_id": p[:, 0].astype(np.int64), "nx": p[:, 1], "ny": p[:, 2], "nz": p[:, 3], "offset": p[:, 4], "faces": p[:, 5].astype(np.int64), "area": p[:, 6]})

    return frames.select("frame_id", F.col(column).alias("side")).mapInPandas(run, "frame_id long, cluster_id long, nx double, ny double, nz double, offset double, faces long, area double")


def validity(faces: DataFrame, by: list[str]) -> DataFrame:
    """By mesh: faces, edges, edges not used twice, and edges used twice in the same direction (0, 0 for a closed, oriented mesh).

    faces: the columns of by, face_id and v, with vertex numbers of the mesh.
    """
    v = [F.get("v", F.lit(k)) for k in range(3)]
    sides = F.array(*[F.struct(F.least(v[i], v[(i + 1) % 3]).alias("a"), F.greatest(v[i], v[(i + 1) % 3]).alias("b"), (v[i] < v[(i + 1) % 3]).cast("int").alias("up")) for i in range(3)])
    each = faces.select(*by, F.explode(sides).alias("e")).groupBy(*by, "e.a", "e.b").agg(F.count(F.lit(1)).alias("uses"), F.sum("e.up").alias("ups"))
    return each.groupBy(*by).agg(
        (F.sum("uses") / 3).cast("long").alias("faces"), F.count(F.lit(1)).alias("edges"), F.count_if(F.col("uses") != 2).alias("open_edges"),
        F.count_if((F.col("uses") == 2) & (F.col("ups") != 1)).alias("turned_edges"),
    )


def tet_neighbours(tets: DataFrame) -> DataFrame:
    """tets with nbr: the tetrahedron across the face opposite each vertex, -1 on the boundary."""
    spark = tets.sparkSession
    # A file of keys is one task or few, however many tetrahedra it holds.
    dealt = tets.select("tet_id", "v").repartition(max(spark.sparkContext.defaultParallelism, -(-tets.count() // TETS_A_TASK)), "tet_id")
    v = [F.get("v", F.lit(k)) for k in range(4)]
    sides = F.array(*[F.struct(F.lit(i).alias("i"), F.array_sort(F.array(*[v[k] for k in range(4) if k != i])).alias("f")) for i in range(4)])
    face = ["p", "q", "r"]
    each = dealt.select("tet_id", F.explode(sides).alias("s")).select("tet_id", "s.i", *[F.get("s.f", F.lit(k)).alias(c) for k, c in enumerate(face)])
    # Numbers only, so that faces are hashed in fixed width.
    ends = [F.min("tet_id").alias("lo"), F.max("tet_id").alias("hi"), F.min_by("i", "tet_id").alias("lo_i"), F.max_by("i", "tet_id").alias("hi_i"), F.min("i").alias("first"), F.max("i").alias("last")]
    shared = written(each.groupBy(*face).agg(F.count(F.lit(1)).alias("uses"), *ends))

    def row(tet: str, i: str | Column, other: Column) -> Column:
        return F.struct(F.col(tet).alias("tet_id"), (F.col(i) if isinstance(i, str) else i).alias("i"), other.cast("long").alias("n"))

    twice = F.col("lo") == F.col("hi")
    one = F.array(row("lo", "lo_i", F.lit(-1)))
    two = F.array(row("lo", F.when(twice, F.col("first")).otherwise(F.col("lo_i")), F.when(twice, -1).otherwise(F.col("hi"))), row("hi", F.when(twice, F.col("last")).otherwise(F.col("hi_i")), F.when(twice, -1).otherwise(F.col("lo"))))
    near = shared.where("uses <= 2").select(F.explode(F.when(F.col("uses") == 1, one).otherwise(two)).alias("s")).select("s.*")
    more = shared.where("uses > 2").select(*face, "lo", "hi")
    if not more.isEmpty():
        n = F.when(twice, -1).when(F.col("tet_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).cast("long")
        near = near.unionByName(each.join(more.hint("merge"), face).select("tet_id", "i", n.alias("n")))
    listed = near.groupBy("tet_id").agg(*[F.max(F.when(F.col("i") == k, F.col("n"))).alias(f"n{k}") for k in range(4)])
    return dealt.join(listed.hint("merge"), "tet_id").select("tet_id", "v", F.array(*[f"n{k}" for k in range(4)]).alias("nbr"))
