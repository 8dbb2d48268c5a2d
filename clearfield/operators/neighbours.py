"""Nearest points by widening grid cells, average spacing, and smoothing onto local quadratic surfaces.

A point's nearest are sought in the 27 cells around it, in cells that double from round to round. It is done when its
k-th nearest is no further away than the rim of those cells, so the result is exact. Points are dealt to blocks of
cells, and to those that their cells border on, so that a round moves each point a few times and no pair is ever
shuffled; later rounds touch the blocks of open points only. Blocks that hold too many points are left to joins of
cells with points. A round is written, and its open points are the next one's.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import written
from .surfaces import places_of, whole_meshes

#: Cells of a block along an axis, points with its rim that a task holds of one, and distances that it works out at a time.
BLOCK, MOST_IN_BLOCK, MOST_NUMBERS = 4, 1 << 14, 1 << 20

PLACE = ["frame_id", "point_id", *"xyz"]


def nearest(points: DataFrame, k: int) -> DataFrame:
    """Rows (frame_id, point_id, x, y, z, near): the k nearest points of the frame, the point itself among them.

    near holds structs (d2, id, x, y, z) by squared distance and then by number; frames of fewer points give all they
    have. Points are finite and numbered within their frame; several at one place are each other's nearest.
    """
    if k < 1:
        raise ValueError("at least one neighbour")
    p = written(points.select(*PLACE))
    ends = [f(c).alias(f"{e}{c}") for e, f in (("lo", F.min), ("hi", F.max)) for c in "xyz"]
    size = F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in "xyz"])
    each = F.col("k") / F.col("n")
    # Cells of the first round hold a few points of a volume that is as wide as the frame; of a surface where joins are asked.
    steps = [F.when(size > 0, size * f / 2).otherwise(1.0).alias(n) for n, f in (("step", F.cbrt(each)), ("fine", F.sqrt(each)))]
    frames = p.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), *ends).withColumn("k", F.lit(k))
    frames = written(frames.select("frame_id", F.least("n", "k").alias("want"), *steps, *[f"{e}{c}" for e in ("lo", "hi") for c in "xyz"]))
    block = ["frame_id", *[f"b{c}" for c in "xyz"]]
    left, done, crowded, wide = p, [], [], 1.0
    while True:
        first = left is p
        cell = {c: F.floor((F.col(c) - F.col(f"lo{c}")) / (F.col("step") * wide)) for c in "xyz"}
        own = [F.floor(x / BLOCK).alias(f"b{c}") for c, x in cell.items()]
        asked = left.join(frames, "frame_id").select(*PLACE, *own, F.lit(True).alias("mine"))
        held = p.join(frames, "frame_id").select(*PLACE, *[F.array_distinct(F.array(F.floor((x - 1) / BLOCK), F.floor((x + 1) / BLOCK))).alias(f"b{c}") for c, x in cell.items()])
        for c in "xyz":
            held = held.withColumn(f"b{c}", F.explode(f"b{c}"))
        if not first:
            held = held.join(asked.select(*block).distinct(), block, "left_semi")
        full = written(held.groupBy(*block).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_IN_BLOCK).select(*block))
        both = held.select(*PLACE, *block[1:], F.lit(False).alias("mine")).unionByName(asked)
        if not full.isEmpty():
            # One row for MOST_IN_BLOCK points and more.
            crowded.append(asked.join(F.broadcast(full), block, "left_semi").select(*PLACE))
            both = both.join(F.broadcast(full), block, "left_anti")
        dealt = both.select(*block, "point_id", *"xyz", "mine").repartition(*block).sortWithinPartitions(*block, "point_id")
        kinds = {f.name: f.dataType.simpleString() for f in p.schema.fields}
        ident = kinds["point_id"]
        schema = f"frame_id {kinds['frame_id']}, point_id {ident}, x double, y double, z double, near array<struct<d2:double,id:{ident},x:double,y:double,z:double>>"
        met = dealt.mapInArrow(_nearest_of_blocks(block, k), schema)
        covers, reach = _reach(F.col("step") * wide)
        enough = (F.size("near") == F.col("want")) & (F.element_at("near", -1)["d2"] <= reach * reach)
        found = written(met.join(frames, "frame_id").select(*PLACE, "near", (covers | enough).alias("sure")))
        done.append(found.where("sure").drop("sure"))
        left = found.where("not sure").select(*PLACE)
        if left.isEmpty():
            break
        wide *= 2
    if crowded:
        done.append(_nearest_by_joins(p, written(reduce(DataFrame.unionByName, crowded)), frames.withColumn("step", F.col("fine")), k))
    return reduce(DataFrame.unionByName, done)


def _reach(step: Column) -> tuple[Column, Column]:
    """Whether the 27 cells of a step around a point hold its whole frame, and how far the point is from their rim."""
    rim, covers = [], F.lit(True)
    for c in "xyz":
        cell = F.floor((F.col(c) - F.col(f"lo{c}")) / step)
        low, high = F.col(f"lo{c}") + (cell - 1) * step, F.col(f"lo{c}") + (cell + 2) * step
        rim += [F.col(c) - low, high - F.col(c)]
        covers = covers & (low <= F.col(f"lo{c}")) & (high > F.col(f"hi{c}"))
    return covers, F.least(*rim) * (1 - 1e-9)


def _nearest_of_blocks(block: list[str], k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Points of a block that are asked for (mine) with the k nearest of the others there, which hold them too; rows in order of block and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in whole_meshes((b.to_pandas() for b in batches), block):
            x, ids, mine = frame[["x", "y", "z"]].to_numpy(), frame["point_id"].to_numpy(), frame["mine"].to_numpy()
            ends = np.append(np.flatnonzero(np.diff(places_of(frame, block), prepend=-1)), len(frame))
            rows, to, d2s = [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                own, other = a + np.flatnonzero(mine[a:b]), a + np.flatnonzero(~mine[a:b])
                width = max(1, MOST_NUMBERS // max(1, len(other)))
                for at in range(0, len(own), width):
                    some = own[at : at + width]
                    d = x[some, None] - x[None, other]
                    d *= d
                    d2 = d[:, :, 0] + d[:, :, 1] + d[:, :, 2]
                    within = d2 <= np.partition(d2, k - 1, axis=1)[:, k - 1 : k] if len(other) > k else np.ones(d2.shape, bool)
                    i, j = np.nonzero(within)
                    value = d2[i, j]
                    order = np.lexsort((value, i))  # others are in order of their numbers, and the sort is stable
                    i, j, value = i[order], j[order], value[order]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    few = rank < k
                    rows.append(some[i[few]]), to.append(other[j[few]]), d2s.append(value[few])
            if not rows:
                continue
            row, near = np.concatenate(rows), np.concatenate(to)
            asked, start = np.unique(row, return_index=True)
            columns = [pa.array(np.concatenate(d2s)), pa.array(ids[near]), *[pa.array(x[near, c]) for c in range(3)]]
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype(np.int32)), pa.StructArray.from_arrays(columns, ["d2", "id", "x", "y", "z"]))
            heads = [pa.array(frame["frame_id"].to_numpy()[asked]), pa.array(ids[asked]), *[pa.array(x[asked, c]) for c in range(3)]]
            yield pa.RecordBatch.from_arrays([*heads, lists], ["frame_id", "point_id", "x", "y", "z", "near"])

    return run


def _nearest_by_joins(p: DataFrame, asked: DataFrame, frames: DataFrame, k: int) -> DataFrame:
    """``nearest`` of some points where very many lie together: cells meet points by an equi-join, whose hot sides Spark can split."""
    offsets = F.array(*[F.struct(*[F.lit(d).alias(f"d{c}") for c, d in zip("xyz", s, strict=True)]) for s in itertools.product((-1, 0, 1), repeat=3)])
    left, done, wide = asked, None, 1.0
    while True:
        grid = [F.floor((F.col(c) - F.col(f"lo{c}")) / (F.col("step") * wide)).alias(f"g{c}") for c in "xyz"]
        asked = left.join(frames, "frame_id").select("*", *grid)
        held = p.join(frames, "frame_id").join(left.select("frame_id").distinct(), "frame_id", "left_semi").select("frame_id", *grid, F.struct(F.col("point_id").alias("id"), *"xyz").alias("o"))
        around = asked.select(*PLACE, F.explode(offsets).alias("s"), *[f"g{c}" for c in "xyz"]).select("frame_id", "point_id", *"xyz", *[(F.col(f"g{c}") + F.col(f"s.d{c}")).alias(f"g{c}") for c in "xyz"])
        d2 = sum(((F.col(c) - F.col(f"o.{c}")) * (F.col(c) - F.col(f"o.{c}")) for c in "yz"), (F.col("x") - F.col("o.x")) * (F.col("x") - F.col("o.x")))
        met = around.join(held, ["frame_id", "gx", "gy", "gz"]).groupBy(*PLACE).agg(F.slice(F.array_sort(F.collect_list(F.struct(d2.alias("d2"), "o.id", "o.x", "o.y", "o.z"))), 1, k).alias("near"))
        covers, reach = _reach(F.col("step") * wide)
        enough = (F.size("near") == F.col("want")) & (F.element_at("near", -1)["d2"] <= reach * reach)
        found = written(met.join(frames, "frame_id").select(*PLACE, "near", (covers | enough).alias("sure")))
        some = found.where("sure").drop("sure")
        done = some if done is None else done.unionByName(some)
        left = found.where("not sure").select(*PLACE)
        if left.isEmpty():
            return done
        wide *= 2


def spacing(points: DataFrame, k: int = 6) -> DataFrame:
    """By frame: points, and the average distance of a point from its k nearest, itself not counted."""
    found = nearest(points, k + 1)
    total = F.aggregate("near", F.lit(0.0), lambda a, o: a + F.sqrt(o["d2"]))
    mean = F.try_divide(total, F.size("near") - 1)
    return found.groupBy("frame_id").agg(F.count(F.lit(1)).alias("points"), F.avg(mean).alias("spacing"))


def fitted(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Points x (n, 3) moved, along the normal of their neighbours near (n, k, 3), onto the degree-2 surface that fits these best."""
    middle = near.mean(axis=1)
    local = near - middle[:, None]
    _, axes = np.linalg.eigh(np.einsum("nki,nkj->nij", local, local))
    axes = axes[:, :, ::-1]  # widest first, the normal last
    u, v, w = np.moveaxis(local @ axes, 2, 0)
    terms = np.stack([np.ones_like(u), u, v, u * u, u * v, v * v], axis=2)
    fit = np.linalg.pinv(terms) @ w[:, :, None]
    own = ((x - middle)[:, None] @ axes)[:, 0]
    a, b = own[:, 0], own[:, 1]
    own[:, 2] = (np.stack([np.ones_like(a), a, b, a * a, a * b, b * b], axis=1) * fit[:, :, 0]).sum(axis=1)
    return middle + (axes @ own[:, :, None])[:, :, 0]


def jet_smooth(points: DataFrame, k: int = 24, iterations: int = 1) -> DataFrame:
    """points on the degree-2 surfaces that fit their k nearest, themselves included: frame_id, point_id, x, y, z, moved.

    A quadratic surface has six coefficients: points of frames with fewer stay (moved false). Each further iteration
    starts from what the one before gave.
    """
    if k < 6 or iterations < 1:
        raise ValueError("six neighbours or more, and one iteration or more")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = frame[["x", "y", "z"]].to_numpy(dtype=np.float64)
            held = [np.array([[o["x"], o["y"], o["z"]] for o in near]) for near in frame["near"]]
            sizes, moved = np.array([len(h) for h in held]), np.zeros(len(x), bool)
            for n in np.unique(sizes[sizes >= 6]):
                rows = np.flatnonzero(sizes == n)
                x[rows] = fitted(x[rows], np.stack([held[i] for i in rows]))
                moved[rows] = True
            yield pd.DataFrame({"frame_id": frame["frame_id"], "point_id": frame["point_id"], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2], "moved": moved})

    now = points
    for _ in range(iterations):
        now = nearest(now, k).mapInPandas(run, "frame_id long, point_id long, x double, y double, z double, moved boolean")
    return now
