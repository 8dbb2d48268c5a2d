"""Audits of smoothed functions: probes, order and bound, zero crossings along rays, and the zero set on a grid."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrangement import Program, evaluate, hard_values, smooth_values, smoothing
from .boundary import numbered_within
from .meet import meet
from .trees import evaluate_json
from .voxels import AXES, bounds, contains


def surface_probes(voxels: DataFrame, patches: DataFrame, h: float) -> DataFrame:
    """Probe points by kind: centres and corners of voxels, and points h / 4 off either side of each patch's middle."""
    centre = voxels.select("frame_id", F.lit("centre").alias("kind"), *[((F.col(a) + 0.5) * h).alias(a[1]) for a in AXES])
    corner = voxels.select("frame_id", *AXES, F.explode(F.array(*map(F.lit, range(8)))).alias("k"))
    corner = corner.select("frame_id", F.lit("corner").alias("kind"), *[((F.col(a) + F.shiftright("k", i).bitwiseAND(1)) * h).alias(a[1]) for i, a in enumerate(AXES)])
    side = patches.select("*", F.explode(F.array(F.lit(-0.25), F.lit(0.25))).alias("off"))
    mid = {"u": (F.col("u0") + F.col("u1")) / 2, "v": (F.col("v0") + F.col("v1")) / 2}

    def at(axis: int):
        grid = F.when(F.col("axis") == axis, F.col("plane") + F.col("off")).when((F.col("axis") + 1) % 3 == axis, mid["u"]).otherwise(mid["v"])
        return grid * h

    flank = side.select("frame_id", F.lit("flank").alias("kind"), *[at(k).alias(c) for k, c in enumerate("xyz")])
    both = centre.unionByName(corner.distinct()).unionByName(flank)
    return both.withColumn("point_id", F.xxhash64("frame_id", "kind", *"xyz"))


def outer_probes(voxels: DataFrame, h: float) -> DataFrame:
    """26 points around each frame's bounds and the middle of them: a voxel beyond, the middle and a voxel beyond on each axis.

    The middle is moved off the planes by h / 8. Kind outer; those outside the bounds are free.
    """
    at = bounds(voxels)
    for a in AXES:
        low, high = F.col(f"min_{a}") - 1, F.col(f"max_{a}") + 2
        at = at.withColumn(a[1], F.explode(F.array(low * F.lit(h), ((low + high) / 2 + 0.125) * F.lit(h), high * F.lit(h))))
    inside = [F.col(a[1]).between(F.col(f"min_{a}") * F.lit(h), (F.col(f"max_{a}") + 1) * F.lit(h)) for a in AXES]
    out = at.where(~(inside[0] & inside[1] & inside[2])).select("frame_id", F.lit("outer").alias("kind"), *"xyz")
    return out.withColumn("point_id", F.xxhash64("frame_id", "kind", *"xyz"))


#: Steps of the three axes of a sequence that fills a cube evenly: powers of 1 / 1.2207..., the root of x^4 = x + 1.
STEPS = (0.8191725133961645, 0.6710436067037893, 0.5497004779019703)


def random_probes(voxels: DataFrame, h: float, count: int, seed: float = 0.5) -> DataFrame:
    """``count`` points of each frame spread evenly over its bounds and a voxel around them; kind random.

    Point n lies at the fractions of seed + n * STEPS, so that it can be told without the others.
    """
    at = bounds(voxels).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(count))))

    def share(k: int) -> Column:
        run = F.lit(seed) + F.col("n") * F.lit(STEPS[k])
        return run - F.floor(run)

    places = [((F.col(f"min_{a}") - 1 + share(k) * (F.col(f"max_{a}") - F.col(f"min_{a}") + 3)) * F.lit(h)).alias(a[1]) for k, a in enumerate(AXES)]
    return at.select("frame_id", F.lit("random").alias("kind"), *places, F.xxhash64("frame_id", F.lit("random"), "n").alias("point_id"))


def distance_errors(probes: DataFrame, values: DataFrame, distances: DataFrame, voxels: DataFrame, h: float) -> DataFrame:
    """Rows (frame_id, point_id, what, error) of how values and distances differ at the same probes.

    values: q and q_upper of ``arrangement.evaluate``; distances: ``arrangement.patch_distance``, which gets
    the sign of the closed union here: positive in free space. what: smoothing (-q less -q_upper), hard (-q
    less the distance), sdf (-q_upper less the distance, at every probe), and of the last those near (within
    h of a patch), boundary (at distance 0), outside and inside.
    """
    # Joined by place, at which values, distances and sides are the same; numbers of probes may be hashes.
    key, at = ["frame_id", "point_id"], ["frame_id", *"xyz"]
    known = values.select(*at, "q", "q_upper").dropDuplicates(at).join(distances.select(*at, "distance").dropDuplicates(at), at)
    rows = contains(probes.select(*key, *"xyz"), voxels, h).join(known, at)
    rows = rows.withColumn("signed", F.when(F.col("inside"), -F.col("distance")).otherwise(F.col("distance")))
    sdf = -F.col("q_upper") - F.col("signed")
    named = [
        ("smoothing", F.lit(True), F.col("q_upper") - F.col("q")),
        ("hard", F.lit(True), -F.col("q") - F.col("signed")),
        ("sdf", F.lit(True), sdf),
        ("near", F.col("distance") <= h, sdf),
        ("boundary", F.col("distance") == 0, sdf),
        ("outside", F.col("signed") > 0, sdf),
        ("inside", F.col("signed") < 0, sdf),
    ]
    each = F.filter(F.array(*[F.when(where, F.struct(F.lit(what).alias("what"), e.alias("error"))) for what, where, e in named]), lambda x: x.isNotNull())
    return rows.select(*key, F.explode(each).alias("e")).select(*key, "e.what", "e.error")


def strided(rows: DataFrame, order: list[str], count: int, coarse: list) -> DataFrame:
    """``count`` rows of each frame at even strides of an order: those whose number i has a new floor(i * count / n).

    coarse: columns or expressions that order rows as ``order`` does, in steps, so that no task numbers a whole frame.
    """
    numbered = numbered_within(rows, ["frame_id"], coarse, order, "__i", "long")
    sized = numbered.join(rows.groupBy("frame_id").agg(F.count(F.lit(1)).alias("__n")), "frame_id")
    now, before = F.floor(F.col("__i") * count / F.col("__n")), F.floor((F.col("__i") - 1) * count / F.col("__n"))
    return sized.where((F.col("__i") == 0) | (now > before) | (F.col("__n") <= count)).drop("__i", "__n")


def exported_differences(points: DataFrame, programs: DataFrame, texts: DataFrame, count: int = 24, tolerance: float = 1e-12) -> DataFrame:
    """By frame: ``count`` strided points, and those where the exported text and the program differ by more than the tolerance."""
    some = strided(points, ["x", "y", "z"], count, [F.floor(F.col("x") * 256)])
    ours = evaluate(some, programs, gradient=False).withColumnRenamed("q", "ours")
    both = evaluate_json(ours, texts)
    return both.groupBy("frame_id").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.abs(F.col("q") - F.col("ours")) > tolerance).alias("differing"))


def clearance_differences(found: DataFrame, spheres: DataFrame, alpha: float, tolerance: float = 1e-9) -> DataFrame:
    """Group clearances against a recomputation from the spheres' rows by joins and sums: by frame, groups and those that differ.

    found: ``robot.group_clearances``; spheres: ``robot.sphere_clearances`` at the same margin. Checked are the
    number of spheres, the hard minimum and its sphere, the smooth minimum, and that it lies within its bound.
    """
    key = ["frame_id", "config_id", "link_index"]
    one = spheres.where("link_index is not null").select(*key, "sphere_id", "clearance")
    low = one.groupBy(*key).agg(F.min("clearance").alias("low"), F.count(F.lit(1)).alias("n"))
    sums = one.join(low, key).groupBy(*key).agg(
        F.first("low").alias("low"), F.first("n").alias("n"), F.sum(F.exp(-alpha * (F.col("clearance") - F.col("low")))).alias("w"),
        F.min(F.when(F.col("clearance") == F.col("low"), F.col("sphere_id"))).alias("nearest"),
    )
    both = found.join(sums, key, "full")
    smooth = F.col("low") - F.log("w") / alpha
    good = (F.col("n") == F.col("spheres")) & (F.col("nearest") == F.col("nearest_sphere")) & (F.abs(F.col("low") - F.col("hard_min")) <= tolerance)
    good = good & (F.abs(smooth - F.col("distance")) <= tolerance) & (F.col("hard_min") - F.col("distance")).between(-tolerance, F.col("bound") + tolerance)
    return both.groupBy("frame_id").agg(F.count(F.lit(1)).alias("groups"), F.count_if(~F.coalesce(good, F.lit(False))).alias("differing"))


def zero_rays(rays: DataFrame, programs: DataFrame, error: float, steps: int = 40) -> DataFrame:
    """Where the hard and the smoothed function change sign along rays from free space to the inside.

    rays: frame_id, ray_id, free point (x, y, z) and inside point (ix, iy, iz). Rows: frame_id, ray_id, t and
    t_smooth in 0..1 by bisection, distance between the two zeros, and ok: whether both ends have their signs.
    The smoothed function is never below the hard one, so its zero never lies deeper.
    """

    def compute(frame: pd.DataFrame, p: Program) -> dict[str, np.ndarray]:
        beta, _ = smoothing(p, error=error)
        a, b = frame[["x", "y", "z"]].to_numpy(), frame[["ix", "iy", "iz"]].to_numpy()

        def zero(f) -> np.ndarray:
            lo, hi = np.zeros(len(a)), np.ones(len(a))
            for _ in range(steps):
                t = (lo + hi) / 2
                inside = f(a + t[:, None] * (b - a)) >= 0
                hi, lo = np.where(inside, t, hi), np.where(inside, lo, t)
            return hi

        t, s = zero(lambda x: hard_values(p, x)), zero(lambda x: smooth_values(p, x, beta, False)[0])
        ok = (hard_values(p, a) < 0) & (hard_values(p, b) > 0)
        return {"t": t, "t_smooth": s, "gap": np.abs(t - s) * np.linalg.norm(b - a, axis=1), "ok": ok}

    sides = programs.select("frame_id", F.col("program").alias("side"))
    found = meet(rays, sides, Program.unpack, compute, "t double, t_smooth double, gap double, ok boolean", weight=lambda p: 4 * len(p.op))
    return found.select("frame_id", "ray_id", "t", "t_smooth", "gap", "ok")


def zero_cells(programs: DataFrame, lo: tuple[float, float, float], step: float, n: tuple[int, int, int], error: float = 0.0) -> DataFrame:
    """Grid edges on which a frame's function changes sign: frame_id, axis, i, j, k and the zero's coordinate.

    error 0 takes the hard function, else the smoothed one. A slab of the grid is in memory at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for fid, data in zip(frame["frame_id"], frame["program"], strict=True):
                p = Program.unpack(data)
                beta = smoothing(p, error=error)[0] if error else 0.0
                y, z = (lo[k] + step * np.arange(n[k]) for k in (1, 2))

                def value(x: np.ndarray, p=p, beta=beta) -> np.ndarray:
                    return smooth_values(p, x, beta, False)[0] if beta else hard_values(p, x)

                def slab(i: int, y=y, z=z, value=value) -> np.ndarray:
                    x = np.stack(np.meshgrid([lo[0] + step * i], y, z, indexing="ij"), axis=-1).reshape(-1, 3)
                    return value(x).reshape(n[1], n[2])

                before = None
                for i in range(n[0]):
                    now = slab(i)
                    pairs = [(1, now[:-1], now[1:], i), (2, now[:, :-1], now[:, 1:], i)]
                    if before is not None:
                        pairs.append((0, before, now, i - 1))
                    for axis, a, b, at in pairs:
                        j, k = np.nonzero((a < 0) != (b < 0))
                        if not len(j):
                            continue
                        x = np.stack([np.full(len(j), lo[0] + step * at), y[j], z[k]], axis=1)
                        near, far, free = np.zeros(len(j)), np.ones(len(j)), a[j, k] < 0
                        for _ in range(45):
                            t = (near + far) / 2
                            moved = x.copy()
                            moved[:, axis] += step * t
                            same = (value(moved) < 0) == free
                            near, far = np.where(same, t, near), np.where(same, far, t)
                        yield pd.DataFrame({"frame_id": fid, "axis": axis, "i": at, "j": j, "k": k, "zero": x[:, axis] + step * far})
                    before = now

    return programs.select("frame_id", "program").mapInPandas(run, "frame_id long, axis int, i int, j int, k int, zero double")


def contours(faces: DataFrame) -> DataFrame:
    """Boundary loops of the union of faces of each plane: rows with loop, corners and signed area in voxel faces.

    An edge of a face stays if no face of the plane lies across it; directed edges are chained with the face
    on the left, turning left where loops touch. Loop order is inherently sequential: a kernel over one plane.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cells = set(zip(frame["u"].tolist(), frame["v"].tolist(), strict=True))
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for u, v in sorted(cells):
            for (a, b), (du, dv) in ((((u, v), (u + 1, v)), (0, -1)), (((u + 1, v), (u + 1, v + 1)), (1, 0)), (((u + 1, v + 1), (u, v + 1)), (0, 1)), (((u, v + 1), (u, v)), (-1, 0))):
                if (u + du, v + dv) not in cells:
                    out.setdefault(a, []).append(b)
        loops = []
        while out:
            start = min(out)
            path, at, way = [start], start, None
            while True:
                ends = out[at]
                if way is None or len(ends) == 1:
                    nxt = ends[0]
                else:  # the leftmost turn keeps loops that touch in a corner apart
                    nxt = max(ends, key=lambda e: way[0] * (e[1] - at[1]) - way[1] * (e[0] - at[0]))  # noqa: B023
                ends.remove(nxt)
                if not ends:
                    del out[at]
                way, at = (nxt[0] - at[0], nxt[1] - at[1]), nxt
                if at == start:
                    break
                path.append(at)
            area = sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(path, path[1:] + path[:1], strict=True)) / 2
            turns = [p for p, q, r in zip(path[-1:] + path[:-1], path, path[1:] + path[:1], strict=True) if (q[0] - p[0], q[1] - p[1]) != (r[0] - q[0], r[1] - q[1])]
            loops.append((len(turns), area))
        head = frame.iloc[0]
        return pd.DataFrame([(head["frame_id"], head["axis"], head["sign"], head["plane"], i, n, a) for i, (n, a) in enumerate(loops)], columns=["frame_id", "axis", "sign", "plane", "loop", "corners", "area"])

    return faces.groupBy("frame_id", "axis", "sign", "plane").applyInPandas(run, "frame_id long, axis int, sign int, plane long, loop int, corners int, area double")
