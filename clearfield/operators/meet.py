"""Points against something that each frame has once: a program, its boxes or patches, a mesh.

What a frame has is packed into one binary value, a side. Where all sides together are small, which is counted
first, they are broadcast and points stay where they are. Where not, points are dealt out by frame and as many
salts as the frame's own count of points asks for, so that neither a large frame nor many sides meet one task. Within a task, points of frames that are said to be
alike are worked on together where sides are equal, so that many small frames cost little more than their points.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import written

#: Bytes of all sides up to which they are broadcast.
MOST_BROADCAST = 64 << 20
#: Points of a frame that are worked on together, points a task holds back for that, and points of a salt.
TOGETHER, MOST_HELD, SALT_POINTS = 8192, 1 << 19, 1 << 18
#: Bytes of points that a task holds back at most, and what a part of them takes beside its columns.
HELD_BYTES, PART_BYTES = 1 << 25, 1 << 12
#: Numbers that a kernel holds for the points it works on together.
MOST_NUMBERS = 1 << 24
#: Sides that a task keeps unpacked.
MOST_UNPACKED = 64

_ARROW = {"double": pa.float64(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}

Compute = Callable[[pd.DataFrame, object], dict[str, np.ndarray]]


def meet(
    points: DataFrame, sides: DataFrame, unpack: Callable[[bytes], object], compute: Compute, added: str, most_broadcast: int = MOST_BROADCAST, weight: Callable[[object], int] | None = None, alike: bool = False
) -> DataFrame:
    """points, all columns, with the columns ``added`` (a schema) that compute gives for points of one frame, or, where frames are
    ``alike``, of frames whose sides are equal.

    points: frame_id and whatever compute reads; sides: frame_id, side (binary), one row a frame. Points of
    frames without a side do not appear. Columns of points named like an added one are replaced. compute gets at most
    TOGETHER points at a time, and fewer where ``weight``, the numbers that a point takes beside a side, says so.
    """
    spark = points.sparkSession
    names = [a.split()[0] for a in added.split(", ")]
    kept = points.drop(*names)
    plain = kept.columns
    columns = [*plain, *names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields] + [added])
    # Written, so that what made the sides is not made again for their size.
    sides = written(sides.select("frame_id", "side"))
    total = sides.agg(F.sum(F.length("side"))).first()[0] or 0

    kinds = [_ARROW[a.split()[1]] for a in added.split(", ")]

    def result(parts: list[pa.RecordBatch], side: object) -> pa.Table:
        """Points with what compute says of them. Columns that it can't read, lists above all, stay as Arrow has them."""
        rows = pa.Table.from_batches(parts).select(plain)
        read = rows.select([f.name for f in rows.schema if pa.types.is_primitive(f.type)]).to_pandas()
        step = TOGETHER if weight is None else min(TOGETHER, max(1, MOST_NUMBERS // max(1, weight(side))))
        made = [compute(read.iloc[i : i + step], side) for i in range(0, max(1, len(read)), step)]
        for name, kind in zip(names, kinds, strict=True):
            rows = rows.append_column(name, pa.chunked_array([pa.array(m[name], kind, from_pandas=True) for m in made]))
        return rows

    def gathered(tables: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        """Results of small frames in batches of TOGETHER rows."""
        waiting: list[pa.Table] = []
        for table in tables:
            waiting.append(table)
            if sum(map(len, waiting)) >= TOGETHER:
                yield from pa.concat_tables(waiting).combine_chunks().to_batches(TOGETHER)
                waiting = []
        if waiting:
            yield from pa.concat_tables(waiting).combine_chunks().to_batches(TOGETHER)

    if total <= most_broadcast:
        numbers: dict[bytes, int] = {}
        if alike:
            of = {r["frame_id"]: numbers.setdefault(bytes(r["side"]), len(numbers)) for r in sides.collect()}
            every = list(numbers)
        else:
            told = {r["frame_id"]: bytes(r["side"]) for r in sides.collect()}
            of, every = {f: i for i, f in enumerate(told)}, list(told.values())
        shared = spark.sparkContext.broadcast((of, every))

        def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
            of, every = shared.value
            unpacked: dict[int, object] = {}
            held: dict[int, list[pa.RecordBatch]] = {}
            sizes: dict[int, int] = {}
            taken = 0  # bytes of what is held

            def close(f: int) -> pa.Table:
                nonlocal taken
                if f not in unpacked:
                    if len(unpacked) >= MOST_UNPACKED:
                        unpacked.clear()
                    unpacked[f] = unpack(every[f])
                del sizes[f]
                parts = held.pop(f)
                taken -= sum(part.nbytes + PART_BYTES for part in parts)
                return result(parts, unpacked[f])

            for batch in batches:
                coded = batch.column("frame_id").dictionary_encode()
                side = np.array([*(of.get(f, -1) for f in coded.dictionary.to_pylist()), -1])  # a null frame is the last
                codes = side[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
                order = np.argsort(codes, kind="stable")
                found, starts = np.unique(codes[order], return_index=True)
                for f, at, to in zip(found.tolist(), starts, [*starts[1:], len(order)], strict=True):
                    if f >= 0:
                        part = batch.take(pa.array(order[at:to]))
                        held.setdefault(f, []).append(part)
                        sizes[f] = sizes.get(f, 0) + len(part)
                        taken += part.nbytes + PART_BYTES
                        if sizes[f] >= TOGETHER:
                            yield close(f)
                if taken > HELD_BYTES or sum(sizes.values()) > MOST_HELD:
                    for f in list(held):
                        yield close(f)
            for f in list(held):
                yield close(f)

        return kept.mapInArrow(lambda batches: gathered(closed(batches)), schema)

    counts = written(kept.groupBy("frame_id").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_POINTS)).cast("int").alias("_salts")))
    # By the point's own columns: a task that is done again deals the same.
    salted = kept.join(counts, "frame_id").withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.col("_salts")).cast("int"))
    copies = sides.join(counts, "frame_id").select("frame_id", F.col("side").alias("_side"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    # Each side comes right before its points, which go by in blocks, or wait for others of an equal side: no group is held whole.
    both = salted.select(*[F.col(f"`{c}`") for c in plain], "_salt", F.lit(None).cast("binary").alias("_side")).unionByName(copies, allowMissingColumns=True)
    dealt = both.repartition("frame_id", "_salt").sortWithinPartitions("frame_id", "_salt", F.col("_side").isNull())

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        now, side, taken = None, None, 0
        held: dict[object, list[pa.RecordBatch]] = {}  # by side or by frame and salt
        whose: dict[object, bytes] = {}
        sizes: dict[object, int] = {}

        def close(key: object) -> pa.Table:
            nonlocal taken
            del sizes[key]
            parts, told = held.pop(key), whose.pop(key)
            taken -= len(told) + sum(part.nbytes + PART_BYTES for part in parts)
            return result(parts, unpack(told))

        for batch in batches:
            frame, salt = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("frame_id", "_salt"))
            starts = np.flatnonzero(np.concatenate([[True], (frame[1:] != frame[:-1]) | (salt[1:] != salt[:-1])])) if len(frame) else []
            spots: dict[object, tuple[bytes, list[np.ndarray]]] = {}
            for at, to in zip(starts, [*starts[1:], len(frame)], strict=True):
                if (frame[at], salt[at]) != now:
                    now, side = (frame[at], salt[at]), None
                    if batch.column("_side")[at].is_valid:
                        side, at = batch.column("_side")[at].as_py(), at + 1
                if side is not None and to > at:
                    spots.setdefault(side if alike else now, (side, []))[1].append(np.arange(at, to))
            points = batch.select(plain)
            for key, (told, rows) in spots.items():
                part = points.take(pa.array(np.concatenate(rows)))
                if key not in held:
                    held[key], whose[key], sizes[key] = [], told, 0
                    taken += len(told)
                held[key].append(part)
                sizes[key] += len(part)
                taken += part.nbytes + PART_BYTES
                if sizes[key] >= TOGETHER or not alike and key != now:
                    yield close(key)
            for key in [k for k in held if k != now] if not alike else list(held) if taken > HELD_BYTES or sum(sizes.values()) > MOST_HELD else []:
                yield close(key)
        for key in list(held):
            yield close(key)

    return dealt.mapInArrow(lambda batches: gathered(passed(batches)), schema)


def packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Sides of rows (frame_id and numeric columns): each frame's rows as one array of doubles; see ``unpacked``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"frame_id": frame["frame_id"], "side": [np.ascontiguousarray(x, dtype=np.float64).tobytes() for x in frame["side"]]})

    row = F.array(*[F.col(c).cast("double") for c in columns])
    listed = rows.groupBy(F.col("frame_id").cast("long").alias("frame_id")).agg(F.flatten(F.collect_list(row)).alias("side"))
    return listed.mapInPandas(run, "frame_id long, side binary")


def unpacked(width: int) -> Callable[[bytes], np.ndarray]:
    return lambda side: np.frombuffer(side).reshape(-1, width)


def least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, value: Callable[[np.ndarray, np.ndarray], np.ndarray], apart: Callable[[np.ndarray], np.ndarray], block: int = 256) -> np.ndarray:
    """Least value over shapes for each point x (n, 3), looking at near shapes only.

    lo, hi (m, 3): boxes around the shapes. value(points, numbers of shapes) is a matrix; apart, of the gaps
    between a block of points and the shapes by axis (m, 3), is at most any value of theirs. Points are
    taken in blocks of neighbours, shapes in the order of that bound, until it exceeds all that was found.
    """
    best = np.full(len(x), np.inf)
    if not len(x) or not len(lo):
        return best
    low, size = x.min(axis=0), np.maximum(np.ptp(x, axis=0), 1e-300)
    cell = np.minimum((x - low) / size * 32, 31).astype(np.int64)
    code = np.zeros(len(x), np.int64)
    for bit in range(5):
        for k in range(3):
            code |= (cell[:, k] >> bit & 1) << (3 * bit + k)
    order = np.argsort(code, kind="stable")
    for at in range(0, len(x), block):
        mine = order[at : at + block]
        p = x[mine]
        a, b = p.min(axis=0), p.max(axis=0)
        bound = apart(np.maximum(lo - b, a - hi))
        near = np.argsort(bound, kind="stable")
        found = best[mine]
        for s in range(0, len(near), block):
            if bound[near[s]] > found.max():
                break
            found = np.minimum(found, value(p, near[s : s + block]).min(axis=1))
        best[mine] = found
    return best


def box_values(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least over boxes of the greatest of their six planes' values."""

    def value(p: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full((len(p), len(at)), -np.inf)
        for k in range(3):
            out = np.maximum(out, np.maximum(lo[None, at, k] - p[:, k, None], p[:, k, None] - hi[None, at, k]))
        return out

    return least(x, lo, hi, value, lambda gap: gap.max(axis=1))
