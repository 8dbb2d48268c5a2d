"""Boundary of the occupied set: exposed faces, merged patches, support planes, compressed cells.

A face is (axis, sign, plane, u, v) with u, v the next two axes in cyclic order; its outward normal is
sign * e_axis. Patches are rectangles [u0, u1) x [v0, v1) of faces. Supports are the planes that carry faces.
Compressed cells are the boxes between neighbouring supports; index 0 and the last are unbounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .meet import box_values, meet, packed, unpacked
from .voxels import AXES, KEY


def exposed_faces(voxels: DataFrame) -> DataFrame:
    """Faces without an occupied neighbour: an anti-join on the neighbour's key."""
    sides = []
    for axis in range(3):
        for sign in (-1, 1):
            step = [sign if k == axis else 0 for k in range(3)]
            sides.append(F.struct(F.lit(axis).alias("axis"), F.lit(sign).alias("sign"), *[(F.col(a) + d).alias(f"n{a}") for a, d in zip(AXES, step, strict=True)]))
    around = voxels.select(*KEY, F.explode(F.array(*sides)).alias("s")).select(*KEY, "s.*")
    near = voxels.select(F.col("frame_id").alias("nf"), *[F.col(a).alias(f"m{a}") for a in AXES])
    on = (F.col("frame_id") == F.col("nf")) & (F.col("nix") == F.col("mix")) & (F.col("niy") == F.col("miy")) & (F.col("niz") == F.col("miz"))
    free = around.join(near, on, "left_anti")

    def along(offset: int) -> Column:
        return F.element_at(F.array(*AXES), F.pmod(F.col("axis") + offset, F.lit(3)) + 1)

    return free.select(
        *KEY, "axis", "sign", (along(0) + F.when(F.col("sign") > 0, 1).otherwise(0)).alias("plane"), along(1).alias("u"), along(2).alias("v")
    )


def patches(faces: DataFrame) -> DataFrame:
    """Maximal runs of faces in u, then of equal runs in v, with the number of faces in each.

    Both are gaps and islands: the difference of a coordinate and its rank is constant within a run.
    """
    side = ["frame_id", "axis", "sign", "plane"]
    row = Window.partitionBy(*side, "v").orderBy("u")
    runs = (
        faces.withColumn("island", F.col("u") - F.row_number().over(row))
        .groupBy(*side, "v", "island")
        .agg(F.min("u").alias("u0"), (F.max("u") + 1).alias("u1"))
    )
    stack = Window.partitionBy(*side, "u0", "u1").orderBy("v")
    return (
        runs.withColumn("island", F.col("v") - F.row_number().over(stack))
        .groupBy(*side, "u0", "u1", "island")
        .agg(F.min("v").alias("v0"), (F.max("v") + 1).alias("v1"))
        .select(*side, "u0", "u1", "v0", "v1", ((F.col("u1") - F.col("u0")) * (F.col("v1") - F.col("v0"))).alias("faces"))
    )


def numbered_within(rows: DataFrame, by: list[str], coarse: list, order: list, name: str, kind: str = "int") -> DataFrame:
    """rows with gapless numbers from 0 within ``by``, in the order of coarse and then of order.

    Counted in two steps, so that no task holds all rows of a group: rows are numbered among those of equal
    ``coarse`` columns, and begin where the counts of those before end.
    """
    keys = [f"k{i}" for i in range(len(coarse))]
    keyed = rows.withColumns({k: F.col(c) if isinstance(c, str) else c for k, c in zip(keys, coarse, strict=True)})
    counts = keyed.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("k_n"))
    before = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, *keys, F.coalesce(F.sum("k_n").over(before), F.lit(0)).alias("k_start"))
    inside = Window.partitionBy(*by, *keys).orderBy(*order)
    placed = keyed.withColumn("k_at", F.row_number().over(inside) - 1).join(starts, [*by, *keys])
    return placed.withColumn(name, (F.col("k_start") + F.col("k_at")).cast(kind)).select(*rows.columns, name)


def number_patches(patched: DataFrame) -> DataFrame:
    """patches with patch_id, from 0 in each frame, by side, plane, v0 and u0."""
    side = 2 * F.col("axis") + F.when(F.col("sign") > 0, 1).otherwise(0)
    return numbered_within(patched, ["frame_id"], [side, "plane"], ["v0", "u0"], "patch_id")


def patch_corners(patched: DataFrame, h: float) -> DataFrame:
    """Four corners of each patch in outward winding: rows with corner 0..3 and x, y, z."""
    turn = [("u0", "v0"), ("u1", "v0"), ("u1", "v1"), ("u0", "v1")]
    back = [turn[0], turn[3], turn[2], turn[1]]
    listed = [
        F.struct(F.lit(i).alias("corner"), F.when(F.col("sign") > 0, F.col(a[0])).otherwise(F.col(b[0])).alias("cu"), F.when(F.col("sign") > 0, F.col(a[1])).otherwise(F.col(b[1])).alias("cv"))
        for i, (a, b) in enumerate(zip(turn, back, strict=True))
    ]
    rows = patched.select("*", F.explode(F.array(*listed)).alias("c"))

    def world(axis: int) -> Column:
        grid = F.when(F.col("axis") == axis, F.col("plane")).when((F.col("axis") + 1) % 3 == axis, F.col("c.cu")).otherwise(F.col("c.cv"))
        return grid * F.lit(h)

    return rows.select(*patched.columns, "c.corner", *[world(k).alias(c) for k, c in enumerate("xyz")])


def supports(faces: DataFrame) -> DataFrame:
    """Distinct planes that carry faces: signs has bit 1 for normals down the axis, bit 2 for up.

    support_id numbers the planes of a frame by axis and coordinate. It needs no patches, so that a
    plan that asks for supports only never merges any.
    """
    bit = F.when(F.col("sign") < 0, 1).otherwise(2)
    found = faces.groupBy("frame_id", "axis", F.col("plane").alias("coord")).agg(F.bit_or(bit).cast("int").alias("signs"), F.count(F.lit(1)).alias("faces"))
    order = Window.partitionBy("frame_id").orderBy("axis", "coord")
    return found.withColumn("support_id", F.row_number().over(order) - 1)


def support_patches(patched: DataFrame) -> DataFrame:
    """Each support with the numbers of its patches, ascending: frame_id, axis, coord, signs, patches. patched: with patch_id."""
    bit = F.when(F.col("sign") < 0, 1).otherwise(2)
    listed = F.array_sort(F.collect_list("patch_id"))  # of one plane of one frame
    return patched.groupBy("frame_id", "axis", F.col("plane").alias("coord")).agg(F.bit_or(bit).cast("int").alias("signs"), listed.alias("patches"))


def registry_violations(planes: DataFrame) -> DataFrame:
    """By frame: supports, those whose number is not their place by axis and coordinate, and places that none or several have."""
    placed = numbered_within(planes, ["frame_id"], ["axis"], ["coord"], "at")
    used = planes.groupBy("frame_id", "support_id").agg(F.count(F.lit(1)).alias("n"))
    doubled = used.groupBy("frame_id").agg(F.count_if(F.col("n") > 1).alias("doubled"))
    wrong = placed.groupBy("frame_id").agg(F.count(F.lit(1)).alias("supports"), F.count_if(F.col("at") != F.col("support_id")).alias("misplaced"))
    return wrong.join(doubled, "frame_id")


def coordinates(planes: DataFrame) -> DataFrame:
    """One row a frame with px, py, pz: the ascending support coordinates of each axis."""
    return planes.groupBy("frame_id").agg(*[F.array_sort(F.collect_set(F.when(F.col("axis") == k, F.col("coord")))).alias(f"p{c}") for k, c in enumerate("xyz")])


def compressed(voxels: DataFrame, coords: DataFrame) -> DataFrame:
    """voxels with the compressed cell (cx, cy, cz) of each: how many supports lie at or below it."""
    found = voxels.join(coords, "frame_id")
    for c in "xyz":
        at = F.col(f"i{c}")
        found = found.withColumn(f"c{c}", F.size(F.filter(f"p{c}", lambda p: p <= at)))  # noqa: B023
    return found


def cells(voxels: DataFrame, coords: DataFrame) -> DataFrame:
    """Occupied compressed cells with their voxels, their width in each axis and whether they are full.

    Every cell that is touched must be full, else supports are missing.
    """
    at = ["frame_id", "cx", "cy", "cz"]
    # Coordinates meet the cells again, so that they do not go through the shuffle of the counts.
    counted = compressed(voxels, coords).groupBy(*at).agg(F.count(F.lit(1)).alias("voxels")).join(coords, "frame_id")
    widths = {f"w{c}": F.get(f"p{c}", F.col(f"c{c}")) - F.get(f"p{c}", F.col(f"c{c}") - 1) for c in "xyz"}
    sized = counted.withColumns(widths)
    return sized.select(*at, "voxels", "wx", "wy", "wz", (F.col("voxels") == F.col("wx") * F.col("wy") * F.col("wz")).alias("full"))


def _blocks_with(c: str, levels: int) -> Column:
    """Dyadic blocks (level, number) that hold an index, of those that prefixes are made of: the even ones."""
    every = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("l"), F.expr(f"cast({c} as long)").alias("at")))
    placed = F.transform(every, lambda s: F.struct(s["l"].alias("l"), F.call_function("shiftright", s["at"], s["l"]).alias("b")))
    return F.filter(placed, lambda s: s["b"].bitwiseAND(1) == 0)


def _blocks_of(c: str, levels: int) -> Column:
    """The dyadic blocks that the indices from 0 to c are made of: one for each bit of c + 1."""
    every = F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("l"), F.expr(f"cast({c} + 1 as long)").alias("at")))
    placed = F.transform(every, lambda s: F.struct(s["l"].alias("l"), F.call_function("shiftright", s["at"], s["l"]).alias("b")))
    return F.transform(F.filter(placed, lambda s: s["b"].bitwiseAND(1) == 1), lambda s: F.struct(s["l"].alias("l"), (s["b"] - 1).alias("b")))


def dominance_counts(found: DataFrame, corners: DataFrame) -> DataFrame:
    """corners (frame_id, cx, cy, cz), distinct, with ``prefix``: cells of the frame at or below the corner in every axis.

    An offline sweep up z over a tree of dyadic blocks in x and y: a cell is listed in the blocks that hold it, a corner
    in those that its prefix is made of, and within a block pair a running sum over z counts. That is n log^2 n rows for
    n cells and corners, wherever they lie; no grid is built. Corners with a negative index have 0.
    """
    top = found.agg(*[F.max(c).alias(c) for c in ("cx", "cy")]).first()
    asked = corners.select("frame_id", "cx", "cy", "cz").distinct()
    if top["cx"] is None:
        return asked.withColumn("prefix", F.lit(0).cast("long"))
    lx, ly = (max(1, int(top[c])).bit_length() for c in ("cx", "cy"))
    # Corners beyond all cells have the prefix of the last index.
    placed = asked.where("cx >= 0 and cy >= 0").withColumn("qx", F.least("cx", F.lit(top["cx"]))).withColumn("qy", F.least("cy", F.lit(top["cy"])))
    points = found.select("frame_id", F.explode(_blocks_with("cx", lx)).alias("x"), "cy", "cz").select("frame_id", "x", F.explode(_blocks_with("cy", ly)).alias("y"), "cz")
    points = points.groupBy("frame_id", "x", "y", "cz").agg(F.count(F.lit(1)).alias("n"))
    ask = placed.select("frame_id", "cx", "cy", "cz", F.explode(_blocks_of("qx", lx)).alias("x"), "qy").select("frame_id", "cx", "cy", "cz", "x", F.explode(_blocks_of("qy", ly)).alias("y"))
    none = F.lit(None).cast(found.schema["cx"].dataType)
    both = points.select("frame_id", "x", "y", "cz", none.alias("cx"), none.alias("cy"), "n").unionByName(ask.select("frame_id", "x", "y", "cz", "cx", "cy", F.lit(0).cast("long").alias("n")))
    upward = Window.partitionBy("frame_id", "x", "y").orderBy("cz").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.withColumn("s", F.sum("n").over(upward)).where("cx is not null").groupBy("frame_id", "cx", "cy", "cz").agg(F.sum("s").alias("s"))
    return asked.join(summed, ["frame_id", "cx", "cy", "cz"], "left").select("frame_id", "cx", "cy", "cz", F.coalesce("s", F.lit(0)).alias("prefix"))


def box_sums(found: DataFrame) -> DataFrame:
    """Each occupied cell with the number of cells at or below it in every axis: the prefix sums where they change."""
    return dominance_counts(found, found)


def grid_sums(found: DataFrame) -> DataFrame:
    """The prefix sums of occupied cells at every place of a frame's grid lines: frame_id, cx, cy, cz, prefix.

    The lines are those that hold cells, and the result has a row for every crossing of three of them. Three running
    sums, one an axis, each within a line of the grid; ``box_sums`` gives the occupied cells only.
    """
    lines = [found.select("frame_id", c).distinct() for c in ("cx", "cy", "cz")]
    held = found.select("frame_id", "cx", "cy", "cz").distinct().withColumn("s", F.lit(1).cast("long"))
    total = lines[0].join(lines[1], "frame_id").join(lines[2], "frame_id").join(held, ["frame_id", "cx", "cy", "cz"], "left").na.fill(0, ["s"])
    for a, b, c in (("cx", "cy", "cz"), ("cy", "cx", "cz"), ("cz", "cx", "cy")):
        upward = Window.partitionBy("frame_id", b, c).orderBy(a).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        total = total.withColumn("s", F.sum("s").over(upward))
    return total.withColumnRenamed("s", "prefix")


def box_counts(found: DataFrame, boxes: DataFrame) -> DataFrame:
    """boxes (frame_id, lo*, hi* in cell indices, half open), distinct, with ``cells``: the occupied cells in each, by eight prefix sums."""
    span = [f"{e}{c}" for e in ("lo", "hi") for c in "xyz"]
    asked = boxes.select("frame_id", *span).distinct()
    corners = [F.struct(*[(F.col(f"{'lh'[k >> i & 1]}{'oi'[k >> i & 1]}{c}") - 1).alias(f"c{c}") for i, c in enumerate("xyz")], F.lit((-1) ** (3 - k.bit_count())).alias("side")) for k in range(8)]
    listed = asked.withColumn("k", F.explode(F.array(*corners))).select("frame_id", *span, "k.*")
    sums = dominance_counts(found, listed)
    met = listed.join(sums, ["frame_id", "cx", "cy", "cz"])
    return met.groupBy("frame_id", *span).agg(F.sum(F.col("side") * F.col("prefix")).alias("cells"))


def free_cells(found: DataFrame, coords: DataFrame) -> DataFrame:
    """Bounded compressed cells that are not occupied, with their bounds lo*, hi* in voxels.

    As many rows as a frame's grid of cells has: for the adjacency of single cells. Free space as such is the
    sweep's (``operators.sweep``), whose size follows the patches.
    """
    grid = coords
    for c in "xyz":
        grid = grid.withColumn(f"c{c}", F.explode(F.sequence(F.lit(1), F.size(f"p{c}") - 1)))
    bounds = {f"lo{c}": F.get(f"p{c}", F.col(f"c{c}") - 1) for c in "xyz"} | {f"hi{c}": F.get(f"p{c}", F.col(f"c{c}")) for c in "xyz"}
    free = grid.join(found.select("frame_id", "cx", "cy", "cz"), ["frame_id", "cx", "cy", "cz"], "left_anti")
    return free.withColumns(bounds).drop("px", "py", "pz")


def merge_boxes(boxes: DataFrame, axis: int) -> DataFrame:
    """Boxes of one cross-section that touch along an axis become one: islands of hi == next lo."""
    a = "xyz"[axis]
    across = [f"{e}{c}" for c in "xyz" if c != a for e in ("lo", "hi")]
    w = Window.partitionBy("frame_id", *across).orderBy(f"lo{a}")
    start = F.when(F.lag(f"hi{a}").over(w) == F.col(f"lo{a}"), 0).otherwise(1)
    return (
        boxes.withColumn("start", start)
        .withColumn("island", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy("frame_id", *across, "island")
        .agg(F.min(f"lo{a}").alias(f"lo{a}"), F.max(f"hi{a}").alias(f"hi{a}"))
        .select("frame_id", *[f"{e}{c}" for e in ("lo", "hi") for c in "xyz"])
    )


def prism_adjacency(prisms: DataFrame) -> DataFrame:
    """Pairs of free prisms that touch in a face: axis, lower corners (fx .. of the one before, tx .. of the one after), the area shared, and its place.

    One prism ends on the plane on which the other begins, and their cross-sections overlap: an equi-join on
    the plane. place numbers the pairs of a frame by area, largest first, then by axis and corners.
    """
    out = None
    for k, c in enumerate("xyz"):
        u, v = (d for d in "xyz" if d != c)
        a = prisms.select("frame_id", F.col(f"hi{c}").alias("plane"), *[F.col(f"{e}{d}").alias(f"a{e}{d}") for e in ("lo", "hi") for d in "xyz"])
        b = prisms.select("frame_id", F.col(f"lo{c}").alias("plane"), *[F.col(f"{e}{d}").alias(f"b{e}{d}") for e in ("lo", "hi") for d in "xyz"])
        shared = [F.least(f"ahi{d}", f"bhi{d}") - F.greatest(f"alo{d}", f"blo{d}") for d in (u, v)]
        met = a.join(b, ["frame_id", "plane"]).where((shared[0] > 0) & (shared[1] > 0))
        one = met.select("frame_id", F.lit(k).alias("axis"), *[F.col(f"{s}lo{d}").alias(f"{n}{d}") for s, n in (("a", "f"), ("b", "t")) for d in "xyz"], (shared[0] * shared[1]).alias("area"))
        out = one if out is None else out.unionByName(one)
    return numbered_within(out, ["frame_id"], [-F.col("area")], ["axis", *[f"{n}{d}" for n in "ft" for d in "xyz"]], "place")


def closed_free(points: DataFrame, prisms: DataFrame, coords: DataFrame, h: float) -> DataFrame:
    """points with ``q_sign`` of the closure of free space: -1 inside a prism or beyond the outer planes,
    0 on their surface only, 1 elsewhere.

    The tree is the minimum over prisms (and six outer halfspaces) of the maximum of their planes; only
    its sign is asked for, so that a box decides by comparisons.
    """
    outer = coords.select("frame_id", *[f(f"p{c}").alias(f"{e}_{c}") for c in "xyz" for e, f in (("a", F.array_min), ("b", F.array_max))])
    out = F.greatest(*[F.greatest(F.col(f"a_{c}") * F.lit(h) - F.col(c), F.col(c) - F.col(f"b_{c}") * F.lit(h)) for c in "xyz"])
    rows = points.join(outer, "frame_id").withColumn("outer", -out).drop(*[f"{e}_{c}" for c in "xyz" for e in "ab"])
    # A frame without free cells inside its bounds still has a side, an empty one.
    listed = prisms.select("frame_id", *[f"{e}{c}" for e in ("lo", "hi") for c in "xyz"])
    empty = coords.select("frame_id", *[F.lit(None).cast("long").alias(f"{e}{c}") for e in ("lo", "hi") for c in "xyz"])

    def compute(pts: pd.DataFrame, boxes: np.ndarray) -> dict[str, np.ndarray]:
        boxes = boxes[~np.isnan(boxes).any(axis=1)]
        inner = box_values(pts[["x", "y", "z"]].to_numpy(), boxes[:, :3] * h, boxes[:, 3:] * h)
        return {"q_sign": np.sign(np.minimum(pts["outer"].to_numpy(), inner)).astype(np.int32)}

    sides = packed(listed.unionByName(empty), [f"{e}{c}" for e in ("lo", "hi") for c in "xyz"])
    return meet(rows, sides, unpacked(6), compute, "q_sign int").drop("outer")


def free_adjacency(free: DataFrame, coords: DataFrame) -> DataFrame:
    """Pairs of free cells that share a face, with its area in voxel faces.

    Neighbours along an axis differ by one compressed index, so this is an equi-join.
    """
    out = None
    for k, c in enumerate("xyz"):
        a = free.select("frame_id", *[F.col(f"c{d}").alias(f"a{d}") for d in "xyz"], *[F.col(f"{e}{d}") for e in ("lo", "hi") for d in "xyz" if d != c])
        b = free.select("frame_id", *[(F.col(f"c{d}") - (1 if d == c else 0)).alias(f"a{d}") for d in "xyz"])
        u, v = (d for d in "xyz" if d != c)
        pair = a.join(b, ["frame_id", "ax", "ay", "az"]).select(
            "frame_id", F.lit(k).alias("axis"), "ax", "ay", "az", ((F.col(f"hi{u}") - F.col(f"lo{u}")) * (F.col(f"hi{v}") - F.col(f"lo{v}"))).alias("area")
        )
        out = pair if out is None else out.unionByName(pair)
    return out
