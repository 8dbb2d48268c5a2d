"""MIN/MAX halfspace functions of frames: build, share, evaluate hard or smoothed, and certify.

One frame's function is a program: leaves are axis-aligned planes sign * (x_axis - coord * h), nodes are MIN or
MAX of earlier nodes, the last node is the root. It is negative in free space, zero on the boundary and
positive inside the occupied set. Building is recursive within a frame, so it is a kernel over one frame's
compressed cells; frames are the parallel unit. Points meet their frame's program where they are (``meet``).
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .meet import least, meet, packed

LEAF, MIN, MAX = 0, 1, 2
#: Defaults of the limits on one frame's work; beyond them building fails, it never gives a partial function.
MOST_CELLS, MOST_NODES = 16_000_000, 2_000_000


class WorkLimit(RuntimeError):
    """A frame needs more work than its limits allow."""


@dataclass
class Program:
    """A function as flat arrays, children before parents.

    op: LEAF, MIN or MAX by node. leaf: number of a leaf's plane, else -1. children: tuples of node numbers.
    axis, sign, coord: the planes, in voxels. h: the voxel size.
    """

    op: list[int]
    leaf: list[int]
    children: list[tuple[int, ...]]
    axis: list[int]
    sign: list[int]
    coord: list[int]
    h: float

    def pack(self) -> bytes:
        return pickle.dumps(self.__dict__, protocol=5)

    @staticmethod
    def unpack(data: bytes) -> Program:
        return Program(**pickle.loads(data))


class _Builder:
    """Nodes with their identity; equal constructions are one node when ``intern`` is set."""

    FREE, FULL = -1, -2

    def __init__(self, planes: list[np.ndarray], h: float, intern: bool, most_nodes: int):
        self.planes, self.intern, self.most_nodes = planes, intern, most_nodes
        self.program = Program([], [], [], [], [], [], h)
        self.leaves: dict[tuple[int, int, int], int] = {}
        self.known: dict[tuple[int, tuple[int, ...]], int] = {}
        # Folding compares what was constructed, not what interning found to be equal.
        self.identity: list[int] = []
        self.stored: dict[int, int] = {}

    def node(self, op: int, leaf: int, children: tuple[int, ...]) -> int:
        p = self.program
        if len(p.op) >= self.most_nodes:
            raise WorkLimit(f"more than {self.most_nodes} nodes")
        p.op.append(op), p.leaf.append(leaf), p.children.append(children)
        return len(p.op) - 1

    def construct(self, stored: int) -> int:
        self.identity.append(stored)
        return len(self.identity) - 1

    def half(self, axis: int, coord: int, sign: int) -> int:
        key = (axis, coord, sign)
        if key not in self.leaves:
            p = self.program
            p.axis.append(axis), p.coord.append(coord), p.sign.append(sign)
            self.leaves[key] = self.construct(self.node(LEAF, len(p.axis) - 1, ()))
        return self.leaves[key]

    def join(self, op: int, *terms: int) -> int:
        children = tuple(self.identity[t] for t in terms)
        if self.intern and (op, children) in self.known:
            return self.construct(self.known[op, children])
        at = self.node(op, -1, children)
        self.known[op, children] = at
        return self.construct(at)

    def split(self, axis: int, coord: int, low: int, high: int) -> int:
        """The function that is ``low`` below a plane and ``high`` above it, continuous across it."""
        if low == high:
            return low
        up, down = (lambda: self.half(axis, coord, 1)), (lambda: self.half(axis, coord, -1))
        free, full = self.FREE, self.FULL
        if low == free:
            return up() if high == full else self.join(MIN, up(), high)
        if low == full:
            return down() if high == free else self.join(MAX, high, down())
        if high == free:
            return self.join(MIN, low, down())
        if high == full:
            return self.join(MAX, low, up())
        a, b = up(), down()
        return self.join(MAX, self.join(MIN, low, high), self.join(MIN, low, b), self.join(MIN, a, high))


def build(occupied: np.ndarray, planes: list[np.ndarray], h: float, intern: bool = True, most_nodes: int = MOST_NODES, log: list | None = None) -> Program:
    """The function of one frame.

    occupied: boolean grid over all compressed cells, unbounded outer ones included (which are free).
    planes: ascending support coordinates by axis. The grid is halved where the halves are least mixed:
    by the number of mixed halves, the larger half's volume, axis and cut. A list that is given as log gets
    every split, parents first: (parent's number or -1, axis, coordinate, lo, hi, occupied, occupied left of it).
    """
    sums = np.zeros([d + 1 for d in occupied.shape], np.int64)
    sums[1:, 1:, 1:] = occupied.cumsum(0).cumsum(1).cumsum(2)
    builder = _Builder(planes, h, intern, most_nodes)

    def count(lo, hi):
        (a, b, c), (d, e, f) = lo, hi
        return sums[d, e, f] - sums[a, e, f] - sums[d, b, f] - sums[d, e, c] + sums[a, b, f] + sums[a, e, c] + sums[d, b, c] - sums[a, b, c]

    def cuts(lo, hi, axis):
        """Occupied cells left of each interior cut along an axis."""
        at = np.arange(lo[axis] + 1, hi[axis])
        ends, starts = list(hi), list(lo)
        ends[axis] = at
        starts[axis] = np.full(len(at), lo[axis])
        return at, count(starts, ends)

    def go(lo: tuple[int, ...], hi: tuple[int, ...], parent: int = -1) -> int:
        size = [hi[k] - lo[k] for k in range(3)]
        volume = size[0] * size[1] * size[2]
        n = int(count(lo, hi))
        if n == 0:
            return builder.FREE
        if n == volume:
            return builder.FULL
        best = None
        for axis in range(3):
            at, left = cuts(lo, hi, axis)
            if not len(at):
                continue
            layer = volume // size[axis]
            vl = (at - lo[axis]) * layer
            vr = volume - vl
            right = n - left
            mixed = ((left > 0) & (left < vl)).astype(np.int64) + ((right > 0) & (right < vr))
            bigger = np.maximum(vl, vr)
            i = np.lexsort((at, bigger, mixed))[0]
            option = (int(mixed[i]), int(bigger[i]), axis, int(at[i]))
            if best is None or option < best:
                best = option
        _, _, axis, cut = best
        middle_hi, middle_lo = list(hi), list(lo)
        middle_hi[axis] = middle_lo[axis] = cut
        if log is not None:
            log.append((parent, axis, int(planes[axis][cut - 1]), lo, hi, n, int(count(lo, middle_hi))))
            parent = len(log) - 1
        low = go(lo, tuple(middle_hi), parent)
        high = go(tuple(middle_lo), hi, parent)
        return builder.split(axis, int(planes[axis][cut - 1]), low, high)

    root = go((0, 0, 0), occupied.shape)
    if root < 0:
        raise ValueError("a frame without boundary has no function")
    return _reachable(builder.program, builder.identity[root])


def _reachable(p: Program, root: int) -> Program:
    """Without the nodes that the root does not use; children first, in order of construction."""
    used = {root}
    for i in range(root, -1, -1):
        if i in used:
            used.update(p.children[i])
    number = {old: new for new, old in enumerate(sorted(used))}
    leaves = sorted({p.leaf[i] for i in used if p.op[i] == LEAF})
    leaf_number = {old: new for new, old in enumerate(leaves)}
    order = sorted(used)
    return Program(
        [p.op[i] for i in order],
        [leaf_number[p.leaf[i]] if p.op[i] == LEAF else -1 for i in order],
        [tuple(number[c] for c in p.children[i]) for i in order],
        [p.axis[x] for x in leaves],
        [p.sign[x] for x in leaves],
        [p.coord[x] for x in leaves],
        p.h,
    )


def share(p: Program) -> Program:
    """Equal (operation, leaf, ordered children) as one node. Order and repetition of children stay: smoothing
    weighs them."""
    seen: dict[tuple, int] = {}
    number: list[int] = []
    out = Program([], [], [], p.axis, p.sign, p.coord, p.h)
    for op, leaf, children in zip(p.op, p.leaf, p.children, strict=True):
        key = (op, leaf, tuple(number[c] for c in children))
        if key not in seen:
            seen[key] = len(out.op)
            out.op.append(op), out.leaf.append(leaf), out.children.append(key[2])
        number.append(seen[key])
    return out


def expanded_nodes(p: Program) -> int:
    """Nodes of the function written out as a tree."""
    size: list[int] = []
    for children in p.children:
        size.append(1 + sum(size[c] for c in children))
    return size[-1]


def expression(p: Program, most_nodes: int = 100_000) -> str | None:
    """The function written out as SQL over x, y, z in voxels, with least and greatest; None beyond so many nodes.

    What is shared is repeated, so a text may be exponentially longer than its program; the limit is checked first.
    """
    if expanded_nodes(p) > most_nodes:
        return None
    texts: list[str] = []
    for op, leaf, children in zip(p.op, p.leaf, p.children, strict=True):
        if op == LEAF:
            c, at = "xyz"[p.axis[leaf]], p.coord[leaf]
            at = f"({at})" if at < 0 else str(at)
            texts.append(f"{c} - {at}" if p.sign[leaf] > 0 else f"{at} - {c}")
        else:
            texts.append(f"{'least' if op == MIN else 'greatest'}({', '.join(texts[k] for k in children)})")
    return texts[-1]


def _spent(p: Program) -> list[list[int]]:
    """By node, the children that no later node uses: what is held of them goes with it."""
    last = {c: i for i, children in enumerate(p.children) for c in children}
    spent: list[list[int]] = [[] for _ in p.op]
    for c, i in last.items():
        spent[i].append(c)
    return spent


def most_held(p: Program) -> int:
    """Nodes whose values are held at once, at most, while the function is evaluated."""
    held = most = 0
    for spent in _spent(p):
        held += 1
        most = max(most, held)
        held -= len(spent)
    return most


#: Bytes of nodes' values and slopes that an evaluation holds, and points at once, at most.
VALUE_BYTES, MOST_POINTS = 1 << 24, 8192


def _block(p: Program) -> int:
    """Points to evaluate at once: a node's value and slope are four numbers a point."""
    return max(1, min(MOST_POINTS, VALUE_BYTES // (32 * most_held(p))))


def hard_values(p: Program, x: np.ndarray) -> np.ndarray:
    """The function at points x (n, 3)."""
    work: list[np.ndarray | None] = []
    for op, leaf, children, spent in zip(p.op, p.leaf, p.children, _spent(p), strict=True):
        if op == LEAF:
            work.append(p.sign[leaf] * x[:, p.axis[leaf]] - p.sign[leaf] * (p.coord[leaf] * p.h))
        else:
            f = np.minimum if op == MIN else np.maximum
            v = work[children[0]]
            for c in children[1:]:
                v = f(v, work[c])
            work.append(v)
            for c in spent:
                work[c] = None
    return work[-1]


def smoothing(p: Program, error: float = 0.0, beta: float = 0.0) -> tuple[float, float]:
    """(beta, bound): sharpness for a wanted error, or the error bound of a given sharpness; exactly one is given.

    A node's weight is the largest of its children's plus the logarithm of their number; the bound is the
    root's weight over beta.
    """
    if not (math.isfinite(error) and math.isfinite(beta)) or error < 0 or beta < 0 or (error > 0) == (beta > 0):
        raise ValueError("give a positive error or a positive beta")
    weight: list[float] = []
    for children in p.children:
        weight.append(max((weight[c] for c in children), default=0.0) + (math.log(len(children)) if children else 0.0))
    w = weight[-1]
    beta = beta or math.nextafter((w if w > 0 else 1.0) / error, math.inf)
    return beta, math.nextafter(w / beta, math.inf) if w > 0 else 0.0


def smooth_values(p: Program, x: np.ndarray, beta: float, gradient: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Upper smoothing of the function and its gradient at points x (n, 3).

    MAX is log(sum exp(beta a)) / beta, MIN is -log(mean exp(-beta a)) / beta, both shifted by the node's
    hard value, so that neither overflows and the result is never below the hard function.
    """
    n = len(x)
    values: list[np.ndarray | None] = []
    slopes: list[np.ndarray | None] = []

    def drop(spent: list[int]) -> None:
        for c in spent:
            values[c] = None
            if gradient:
                slopes[c] = None

    for op, leaf, children, spent in zip(p.op, p.leaf, p.children, _spent(p), strict=True):
        if op == LEAF:
            values.append(p.sign[leaf] * x[:, p.axis[leaf]] - p.sign[leaf] * (p.coord[leaf] * p.h))
            if gradient:
                g = np.zeros((1, 3))  # the same at every point
                g[:, p.axis[leaf]] = p.sign[leaf]
                slopes.append(g)
            continue
        if len(children) == 2:  # one exponential serves both terms
            a, b = values[children[0]], values[children[1]]
            high, low = np.maximum(a, b), np.minimum(a, b)
            with np.errstate(under="ignore", over="ignore"):
                e = np.exp(-beta * (high - low))
            total = 1.0 + e
            values.append(high + np.log1p(e) / beta if op == MAX else low + np.log1p((1.0 - e) / total) / beta)
            if gradient:
                first = (a >= b) if op == MAX else (a <= b)
                w = (np.where(first, 1.0, e) / total)[:, None]
                slopes.append(w * slopes[children[0]] + (1.0 - w) * slopes[children[1]])
            drop(spent)
            continue
        terms = np.stack([values[c] for c in children])
        anchor = terms.max(axis=0) if op == MAX else terms.min(axis=0)
        gaps = anchor - terms if op == MAX else terms - anchor
        with np.errstate(under="ignore", over="ignore"):
            e = np.exp(-beta * gaps)
        total = e.sum(axis=0)
        k = len(children)
        values.append(anchor + (np.log1p(total - 1.0) if op == MAX else np.log1p((k - total) / total)) / beta)
        if gradient:
            slopes.append(sum(e[i][:, None] * slopes[c] for i, c in enumerate(children)) / total[:, None])
        drop(spent)
    return values[-1], np.broadcast_to(slopes[-1], (n, 3)) if gradient else None


#: Bytes of sign lanes that a slab of the certificate may take.
LANE_BYTES = 1 << 28


def strata_mismatches(p: Program, occupied: np.ndarray, planes: list[np.ndarray], most_bytes: int = LANE_BYTES) -> tuple[int, int]:
    """(strata, mismatches): the sign of the function on every vertex, edge, face and volume of the planes."""
    bad = sum(int(np.bitwise_count(wrong).sum()) for _, wrong, _, _ in _strata_lanes(p, occupied, planes, most_bytes))
    return math.prod(2 * len(c) + 1 for c in planes), bad


def _lanes(bits: np.ndarray) -> np.ndarray:
    """Truth values along the last axis as words of 64, the first in the lowest bit; what is beyond the end is false."""
    n = bits.shape[-1]
    words = -(-n // 64)
    packed = np.zeros((*bits.shape[:-1], 8 * words), np.uint8)
    packed[..., : -(-n // 8)] = np.packbits(bits, axis=-1, bitorder="little")
    return packed.view("<u8")


def _strata_lanes(p: Program, occupied: np.ndarray, planes: list[np.ndarray], most_bytes: int) -> Iterator[tuple[int, np.ndarray, tuple, tuple]]:
    """(first place on x, wrong, signs, right signs) of all strata, in slabs; signs are pairs of lanes, positive and negative.

    A stratum's place on an axis is an open slab (even) or a plane (odd); 64 places along z are the bits of a word. Its
    right sign is that of the cells around it: 1 if all are occupied, -1 if none is, else 0 (neither lane). Leaves are
    signs of places, MIN and MAX are and-or of lanes, so this is exact. A node's lanes go with its last use.
    """
    sizes = [2 * len(c) + 1 for c in planes]
    words = -(-sizes[2] // 64)
    at = [{int(c): 2 * i + 1 for i, c in enumerate(cs)} for cs in planes]
    # Cells around a place: one, or the two beside a plane.
    around = [(np.arange(n) // 2, (np.arange(n) + 1) // 2) for n in sizes]
    every, none = np.uint64(2**64 - 1), np.uint64(0)
    within = _lanes(np.ones(sizes[2], bool))
    last = {c: i for i, children in enumerate(p.children) for c in children}
    # Lanes of two signs for each node, and the cells' truth values of the slab.
    step = max(1, most_bytes // (sizes[1] * (16 * words * len(p.op) + 4 * sizes[2])))
    for lo in range(0, sizes[0], step):
        xs = np.arange(lo, min(lo + step, sizes[0]))
        full = occupied[around[0][0][xs]] & occupied[around[0][1][xs]]
        some = occupied[around[0][0][xs]] | occupied[around[0][1][xs]]
        for axis in (1, 2):
            full = np.take(full, around[axis][0], axis) & np.take(full, around[axis][1], axis)
            some = np.take(some, around[axis][0], axis) | np.take(some, around[axis][1], axis)
        right = _lanes(full), _lanes(~some)
        axes = [xs, np.arange(sizes[1]), np.arange(sizes[2])]
        work: list[tuple | None] = []
        for i, (op, leaf, children) in enumerate(zip(p.op, p.leaf, p.children, strict=True)):
            if op == LEAF:
                k = p.axis[leaf]
                s = p.sign[leaf] * (axes[k] - at[k][p.coord[leaf]])
                if k == 2:
                    work.append((_lanes(s > 0)[None, None], _lanes(s < 0)[None, None]))
                else:
                    view = (len(s), 1, 1) if k == 0 else (1, len(s), 1)
                    work.append(tuple(np.where(t, every, none).reshape(view) for t in (s > 0, s < 0)))
            else:
                up, down = work[children[0]]
                for c in children[1:]:
                    a, b = work[c]
                    up, down = (up & a, down | b) if op == MIN else (up | a, down & b)
                work.append((up, down))
                for c in set(children):
                    if last[c] == i:
                        work[c] = None
        signs = tuple(np.broadcast_to(x, right[0].shape) & within for x in work[-1])
        yield lo, (signs[0] ^ right[0]) | (signs[1] ^ right[1]), signs, right


# ---------------------------------------------------------------- over frames


def grid_of(cells: pd.DataFrame, planes: list[np.ndarray], most_cells: int = MOST_CELLS) -> np.ndarray:
    """Dense grid of one frame's compressed cells."""
    shape = [len(c) + 1 for c in planes]
    if shape[0] * shape[1] * shape[2] > most_cells:
        raise WorkLimit(f"more than {most_cells} compressed cells")
    grid = np.zeros(shape, bool)
    grid[cells["cx"], cells["cy"], cells["cz"]] = True
    return grid


def build_programs(
    found: DataFrame, coords: DataFrame, h: float, certify: bool = False, intern: bool = True, most_cells: int = MOST_CELLS, most_nodes: int = MOST_NODES
) -> DataFrame:
    """One row a frame: program (binary), nodes (stored), shared (after sharing), expanded, strata, mismatches.

    found: occupied compressed cells; coords: px, py, pz. strata and mismatches are null unless certify is
    set. A frame is one kernel call over its compressed cells, which are far fewer than its points.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        planes = [np.asarray(frame[f"p{c}"].iloc[0], dtype=np.int64) for c in "xyz"]
        grid = grid_of(frame, planes, most_cells)
        p = build(grid, planes, h, intern, most_nodes)
        strata, bad = strata_mismatches(p, grid, planes) if certify else (None, None)
        return pd.DataFrame(
            {
                "frame_id": [frame["frame_id"].iloc[0]], "program": [p.pack()], "nodes": [len(p.op)], "shared": [len(share(p).op)],
                "expanded": [float(expanded_nodes(p))], "strata": pd.array([strata], dtype="Int64"), "mismatches": pd.array([bad], dtype="Int64"),
            }
        )

    rows = found.select("frame_id", "cx", "cy", "cz").join(coords, "frame_id")
    return rows.groupBy("frame_id").applyInPandas(run, "frame_id long, program binary, nodes long, shared long, expanded double, strata long, mismatches long")


def program_splits(found: DataFrame, coords: DataFrame, h: float, most_cells: int = MOST_CELLS, most_nodes: int = MOST_NODES) -> DataFrame:
    """How each frame's function is cut: frame_id, split, parent (null at the root), axis, coord, lo, hi, cells, left.

    lo and hi bound the part that is cut, in compressed cells with the outer ones; cells of it are occupied, left
    of them below the plane. A frame without occupied cells has no rows. Arguments are those of ``build_programs``.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        planes = [np.asarray(frame[f"p{c}"].iloc[0], dtype=np.int64) for c in "xyz"]
        log: list[tuple] = []
        build(grid_of(frame, planes, most_cells), planes, h, most_nodes=most_nodes, log=log)
        rows = [(frame["frame_id"].iloc[0], i, None if s[0] < 0 else s[0], *s[1:3], list(s[3]), list(s[4]), *s[5:]) for i, s in enumerate(log)]
        out = pd.DataFrame(rows, columns=["frame_id", "split", "parent", "axis", "coord", "lo", "hi", "cells", "left"])
        return out.astype({"parent": "Int64"})

    rows = found.select("frame_id", "cx", "cy", "cz").join(coords, "frame_id")
    return rows.groupBy("frame_id").applyInPandas(run, "frame_id long, split long, parent long, axis int, coord long, lo array<int>, hi array<int>, cells long, left long")


def expressions(programs: DataFrame, most_nodes: int = 100_000) -> DataFrame:
    """Rows (frame_id, expanded, text): each frame's function as SQL over x, y, z in voxels, null beyond so many nodes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [Program.unpack(data) for data in frame["program"]]
            yield pd.DataFrame({"frame_id": frame["frame_id"], "expanded": [float(expanded_nodes(p)) for p in found], "text": [expression(p, most_nodes) for p in found]})

    return programs.select("frame_id", "program").mapInPandas(run, "frame_id long, expanded double, text string")


def leaves(programs: DataFrame) -> DataFrame:
    """Rows (frame_id, axis, sign, coord): the halfspaces that each frame's function is made of."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fid, data in zip(frame["frame_id"], frame["program"], strict=True):
                p = Program.unpack(data)
                yield pd.DataFrame({"frame_id": fid, "axis": p.axis, "sign": p.sign, "coord": p.coord})

    return programs.select("frame_id", "program").mapInPandas(run, "frame_id long, axis int, sign int, coord long")


def provenance(programs: DataFrame, planes: DataFrame) -> DataFrame:
    """By frame: planes of its function, those that no support explains, and supports that it does not use.

    planes: ``boundary.supports``. A function that is made of its surface has none of either: the surface lies in every
    support, so its zeros do. A frame that only one side knows has the rows of that side.
    """
    key = ["frame_id", "axis", "coord"]
    used = leaves(programs).select(*key, F.lit(1).alias("u"), F.lit(0).alias("s"))
    both = used.unionByName(planes.select(*key, F.lit(0).alias("u"), F.lit(1).alias("s"))).groupBy(*key).agg(F.max("u").alias("u"), F.max("s").alias("s"))
    return both.groupBy("frame_id").agg(
        F.sum("u").alias("planes"), F.count_if((F.col("u") == 1) & (F.col("s") == 0)).alias("unexplained"), F.count_if((F.col("u") == 0) & (F.col("s") == 1)).alias("unused")
    )


def slope_errors(points: DataFrame, programs: DataFrame, error: float, step: float = 1e-6) -> DataFrame:
    """points, all columns, with gx, gy, gz of the smoothed function and dx, dy, dz: its central differences over 2 * step."""

    def compute(pts: pd.DataFrame, p: Program) -> dict[str, np.ndarray]:
        beta, _ = smoothing(p, error=error)
        x = pts[["x", "y", "z"]].to_numpy()
        out = {c: np.empty(len(x)) for c in ("gx", "gy", "gz", "dx", "dy", "dz")}
        block = _block(p)
        for lo in range(0, len(x), block):
            s = slice(lo, lo + block)
            out["gx"][s], out["gy"][s], out["gz"][s] = smooth_values(p, x[s], beta)[1].T
            for k, c in enumerate(("dx", "dy", "dz")):
                e = np.eye(3)[k] * step
                out[c][s] = (smooth_values(p, x[s] + e, beta, False)[0] - smooth_values(p, x[s] - e, beta, False)[0]) / (2 * step)
        return out

    sides = programs.select("frame_id", F.col("program").alias("side"))
    return meet(points, sides, Program.unpack, compute, "gx double, gy double, gz double, dx double, dy double, dz double", weight=lambda p: 4 * len(p.op))


def evaluate(points: DataFrame, programs: DataFrame, error: float = 1e-3, gradient: bool = True) -> DataFrame:
    """points, all columns, with q (hard), q_upper (smoothed), gx, gy, gz (null without gradient) and bound.

    points: frame_id, x, y, z and any other columns; see ``meet`` for how they meet their frame's program.
    """

    def compute(pts: pd.DataFrame, p: Program) -> dict[str, np.ndarray]:
        beta, bound = smoothing(p, error=error)
        x = pts[["x", "y", "z"]].to_numpy()
        out = {c: np.full(len(x), np.nan) for c in ("q", "q_upper", "gx", "gy", "gz")} | {"bound": np.full(len(x), bound)}
        block = _block(p)
        for lo in range(0, len(x), block):
            s = slice(lo, lo + block)
            out["q"][s] = hard_values(p, x[s])
            out["q_upper"][s], slope = smooth_values(p, x[s], beta, gradient)
            if gradient:
                out["gx"][s], out["gy"][s], out["gz"][s] = slope.T
        return out

    sides = programs.select("frame_id", F.col("program").alias("side"))
    return meet(points, sides, Program.unpack, compute, "q double, q_upper double, gx double, gy double, gz double, bound double")


def patch_distance(points: DataFrame, patched: DataFrame, h: float) -> DataFrame:
    """points, all columns, with the distance to the nearest patch of their frame, by blocks of near patches."""

    def unpack(side: bytes) -> tuple[np.ndarray, np.ndarray]:
        rects = np.frombuffer(side).reshape(-1, 6)
        lo, hi = np.empty((len(rects), 3)), np.empty((len(rects), 3))
        rows, axis = np.arange(len(rects)), rects[:, 0].astype(int)
        for step, (a, b) in enumerate(((1, 1), (2, 3), (4, 5))):
            lo[rows, (axis + step) % 3], hi[rows, (axis + step) % 3] = rects[:, a] * h, rects[:, b] * h
        return lo, hi

    def compute(pts: pd.DataFrame, side: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
        lo, hi = side

        def value(p: np.ndarray, at: np.ndarray) -> np.ndarray:
            total = np.zeros((len(p), len(at)))
            for k in range(3):
                gap = np.maximum(0.0, np.maximum(lo[None, at, k] - p[:, k, None], p[:, k, None] - hi[None, at, k]))
                total += gap * gap
            return np.sqrt(total)

        # A little less than the distance, so that rounding never hides the nearest patch.
        apart = lambda gap: np.sqrt((np.maximum(gap, 0.0) ** 2).sum(axis=1)) * (1 - 1e-12)
        return {"distance": least(pts[["x", "y", "z"]].to_numpy(), lo, hi, value, apart)}

    return meet(points, packed(patched, ["axis", "plane", "u0", "u1", "v0", "v1"]), unpack, compute, "distance double")


def strata_defects(p: Program, occupied: np.ndarray, planes: list[np.ndarray], witnesses: int = 24) -> tuple[list[int], list[int], list[tuple[int, ...]]]:
    """Strata and mismatches by dimension (0 vertices to 3 volumes), and the first mismatches as witnesses.

    A witness is (i, j, k, sign, right): its places on the axes, where an odd one is a plane, the function's
    sign and the right one. Witnesses are the first in the order of their places.
    """
    sizes = [2 * len(c) + 1 for c in planes]
    open_of = [[(n + 1) // 2 if d else n // 2 for d in (0, 1)] for n in sizes]  # planes, slabs of each axis
    strata = [0, 0, 0, 0]
    for mask in range(8):
        strata[bin(mask).count("1")] += math.prod(open_of[k][mask >> k & 1] for k in range(3))
    wrong, first = [0, 0, 0, 0], []
    for lo, bad, signs, right in _strata_lanes(p, occupied, planes, LANE_BYTES):
        for i, j, w in np.argwhere(bad):
            for bit in range(64):
                if bad[i, j, w] >> np.uint64(bit) & np.uint64(1):
                    k = 64 * int(w) + bit
                    wrong[sum((n + 1) % 2 for n in (lo + i, j, k))] += 1
                    if len(first) < witnesses:
                        values = [(int(up[i, j, w]) >> bit & 1) - (int(down[i, j, w]) >> bit & 1) for up, down in (signs, right)]
                        first.append((int(lo + i), int(j), k, *values))
    return strata, wrong, first


def diagnose_programs(built: DataFrame, found: DataFrame, coords: DataFrame, h: float, witnesses: int = 24) -> DataFrame:
    """Sign diagnostics of the functions of ``built`` cells against the occupied cells ``found``, by frame and dimension.

    Rows: frame_id, dimension, strata, mismatches, witnesses (array of i, j, k, sign, right: at most so many a
    frame, listed under their dimension). Both tables are compressed cells over the same coordinates.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        planes = [np.asarray(frame[f"p{c}"].iloc[0], dtype=np.int64) for c in "xyz"]
        p = build(grid_of(frame[frame["mine"]], planes), planes, h)
        strata, wrong, first = strata_defects(p, grid_of(frame[frame["right"]], planes), planes, witnesses)
        of = [[w for w in first if sum((n + 1) % 2 for n in w[:3]) == d] for d in range(4)]
        return pd.DataFrame({"frame_id": frame["frame_id"].iloc[0], "dimension": range(4), "strata": strata, "mismatches": wrong, "witnesses": [[list(w) for w in ws] for ws in of]})

    at = ["frame_id", "cx", "cy", "cz"]
    both = built.select(*at, F.lit(1).alias("m"), F.lit(0).alias("r")).unionByName(found.select(*at, F.lit(0).alias("m"), F.lit(1).alias("r")))
    flagged = both.groupBy(*at).agg((F.max("m") == 1).alias("mine"), (F.max("r") == 1).alias("right")).join(coords, "frame_id")
    return flagged.groupBy("frame_id").applyInPandas(run, "frame_id long, dimension int, strata long, mismatches long, witnesses array<array<int>>")
