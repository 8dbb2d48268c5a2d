"""Octrees over occupied voxels: levels, the exact cut into full cubes, and rectangular cells.

The cube is anchored at a frame's smallest index on each axis; a node of level L is the index offset shifted
right by L. Nodes are derived by level, without pointers.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boundary import numbered_within
from .meet import box_values, meet, packed, unpacked
from .voxels import AXES, bounds

NODE = ["frame_id", "level", "nx", "ny", "nz"]


def _leveled(voxels: DataFrame) -> DataFrame:
    frame = bounds(voxels).select("frame_id", "min_ix", "min_iy", "min_iz", "depth")
    rows = voxels.join(frame, "frame_id").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    shifted = {f"n{a[1]}": F.expr(f"shiftright({a} - min_{a}, level)") for a in AXES}
    return rows.withColumns(shifted)


def levels(voxels: DataFrame) -> DataFrame:
    """All octree nodes that hold voxels, with their number; counted in one grouped pass over all levels."""
    return _leveled(voxels).groupBy(*NODE).agg(F.count(F.lit(1)).alias("voxels"))


def full_nodes(voxels: DataFrame) -> DataFrame:
    """Nodes whose every voxel is occupied: 8^level voxels."""
    return levels(voxels).where(F.col("voxels") == F.expr("shiftleft(1L, 3 * level)"))


def exact_cut(voxels: DataFrame) -> DataFrame:
    """The full nodes without a full parent: a partition of the occupied set into cubes."""
    full = full_nodes(voxels)
    parents = full.select("frame_id", (F.col("level") - 1).alias("level"), F.col("nx").alias("px"), F.col("ny").alias("py"), F.col("nz").alias("pz"))
    on = [full["frame_id"] == parents["frame_id"], full["level"] == parents["level"]]
    on += [F.shiftright(full[f"n{c}"], 1) == parents[f"p{c}"] for c in "xyz"]
    return full.join(parents, on, "left_anti")


@lru_cache(maxsize=1)
def sibling_covers() -> list[list[tuple[int, int, int, int, int, int]]]:
    """For each mask of the eight children of a node, a smallest disjoint cover by boxes.

    Bit 4 dx + 2 dy + dz stands for a child. A box is (x, y, z, wx, wy, wz). The cover of a mask takes,
    among the boxes that hold its lowest bit, one whose rest needs fewest, the first on a tie.
    """
    spans = [(0, 1), (0, 2), (1, 1)]
    boxes = [(x, y, z, a, b, c) for x, a in spans for y, b in spans for z, c in spans]

    def bits(box: tuple[int, ...]) -> int:
        x, y, z, a, b, c = box
        return sum(1 << (4 * i + 2 * j + k) for i in range(x, x + a) for j in range(y, y + b) for k in range(z, z + c))

    masks = [bits(b) for b in boxes]
    best: list[list] = [[]]
    for mask in range(1, 256):
        low = mask & -mask
        options = [[box, *best[mask ^ m]] for box, m in zip(boxes, masks, strict=True) if m & low and m & mask == m]
        best.append(min(options, key=len))
    return best


def _cover_table(spark: SparkSession) -> DataFrame:
    rows = [(mask, [list(b) for b in cover]) for mask, cover in enumerate(sibling_covers())]
    return spark.createDataFrame(rows, "mask int, boxes array<array<int>>")


def rectangular_cells(voxels: DataFrame) -> DataFrame:
    """Cells lo*, w* in voxels: full cubes of level 1 and more, and smallest covers of the rest by parent.

    The 256-row lookup is broadcast; its size is fixed.
    """
    frame = bounds(voxels).select("frame_id", *[f"min_{a}" for a in AXES])
    cut = exact_cut(voxels)
    cubes = cut.where("level > 0").select(
        "frame_id", *[F.expr(f"shiftleft(n{c}, level)").alias(f"o{c}") for c in "xyz"], *[F.expr("shiftleft(1L, level)").alias(f"w{c}") for c in "xyz"]
    )
    bit = F.expr("shiftleft(1, cast(4 * (nx & 1) + 2 * (ny & 1) + (nz & 1) as int))")
    parents = cut.where("level = 0").groupBy("frame_id", *[F.shiftright(f"n{c}", 1).alias(f"p{c}") for c in "xyz"]).agg(F.bit_or(bit).alias("mask"))
    covered = parents.join(F.broadcast(_cover_table(voxels.sparkSession)), "mask").withColumn("b", F.explode("boxes"))
    small = covered.select(
        "frame_id", *[(2 * F.col(f"p{c}") + F.get("b", F.lit(k))).cast("long").alias(f"o{c}") for k, c in enumerate("xyz")],
        *[F.get("b", F.lit(3 + k)).cast("long").alias(f"w{c}") for k, c in enumerate("xyz")],
    )
    placed = cubes.unionByName(small).join(frame, "frame_id")
    return placed.select("frame_id", *[(F.col(f"o{c}") + F.col(f"min_i{c}")).alias(f"lo{c}") for c in "xyz"], "wx", "wy", "wz")


def number_cells(found: DataFrame) -> DataFrame:
    """cells with cell_id, from 0 in each frame, by lower corner."""
    return numbered_within(found, ["frame_id"], ["lox"], ["loy", "loz"], "cell_id")


def box_planes(found: DataFrame, h: float) -> DataFrame:
    """Six outward planes n . p - offset of each cell: axis, sign, coord (grid) and offset."""
    sides = []
    for k, c in enumerate("xyz"):
        sides.append(F.struct(F.lit(k).alias("axis"), F.lit(-1).alias("sign"), F.col(f"lo{c}").alias("coord")))
        sides.append(F.struct(F.lit(k).alias("axis"), F.lit(1).alias("sign"), (F.col(f"lo{c}") + F.col(f"w{c}")).alias("coord")))
    rows = number_cells(found).select("frame_id", "cell_id", F.explode(F.array(*sides)).alias("s")).select("frame_id", "cell_id", "s.*")
    return rows.withColumn("offset", F.col("sign") * (F.col("coord") * F.lit(h)))


def shared_leaves(planes: DataFrame) -> DataFrame:
    """Distinct planes of a frame with leaf_id, their references and the cells that use them first."""
    found = planes.groupBy("frame_id", "axis", "sign", "coord").agg(F.count(F.lit(1)).alias("references"), F.min("cell_id").alias("first_cell"))
    return numbered_within(found, ["frame_id"], [F.floor(F.col("first_cell") / 1024)], ["first_cell", "axis", "sign"], "leaf_id")


def union_values(points: DataFrame, found: DataFrame, h: float) -> DataFrame:
    """points, all columns, with q, the minimum over a frame's cells of the maximum of their planes: inside iff q <= 0.

    A cell's value is the greatest of its six planes; only cells that can be the least are looked at.
    """
    sides = [f"lo{c}" for c in "xyz"] + [f"w{c}" for c in "xyz"]

    def compute(pts: pd.DataFrame, cells: np.ndarray) -> dict[str, np.ndarray]:
        return {"q": box_values(pts[["x", "y", "z"]].to_numpy(), cells[:, :3] * h, (cells[:, :3] + cells[:, 3:]) * h)}

    return meet(points, packed(found, sides), unpacked(6), compute, "q double")


def cell_sources(voxels: DataFrame) -> DataFrame:
    """Provenance of the exact cut: voxels with the level and node of the cell that holds each."""
    cut = exact_cut(voxels).drop("voxels")
    return _leveled(voxels).join(cut, NODE).select("frame_id", *AXES, "level", "nx", "ny", "nz")


def tree_size(found: DataFrame) -> DataFrame:
    """Cells, planes and tree nodes of each frame: 7 nodes a cell and a root where there are several."""
    counted = found.groupBy("frame_id").agg(F.count(F.lit(1)).alias("cells"))
    return counted.select("frame_id", "cells", (6 * F.col("cells")).alias("planes"), (7 * F.col("cells") + (F.col("cells") > 1).cast("int")).alias("nodes"))


def partition_violations(found: DataFrame, voxels: DataFrame) -> DataFrame:
    """By frame: voxels that no cell covers or several do, and covered indices that are not occupied."""
    each = found.select("frame_id", *[F.explode(F.sequence(F.col(f"lo{c}"), F.col(f"lo{c}") + F.col(f"w{c}") - 1)).alias(f"i{c}") if c == "x" else F.struct(f"lo{c}", f"w{c}").alias(f"s{c}") for c in "xyz"])
    for c in "yz":
        each = each.withColumn(f"i{c}", F.explode(F.sequence(F.col(f"s{c}.lo{c}"), F.col(f"s{c}.lo{c}") + F.col(f"s{c}.w{c}") - 1)))
    key = ["frame_id", *AXES]
    both = each.select(*key, F.lit(1).alias("c"), F.lit(0).alias("v")).unionByName(voxels.select(*key, F.lit(0).alias("c"), F.lit(1).alias("v")))
    per = both.groupBy(*key).agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
    return per.groupBy("frame_id").agg(
        F.count_if((F.col("v") == 1) & (F.col("c") == 0)).alias("uncovered"),
        F.count_if((F.col("v") == 1) & (F.col("c") > 1)).alias("overlapping"),
        F.count_if((F.col("v") == 0) & (F.col("c") > 0)).alias("outside"),
    )
