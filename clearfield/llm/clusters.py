"""Centroid clustering by delta Lloyd: integer vectors, exact floor means, signed transfers between clusters.

Assignments are a table, written each round; sums and counts of the clusters are kept with the driver (clusters
times components integers, whatever the data). A round looks only at what may have changed:

* a vector whose owner stayed, or came no further away, is compared with the centroids that moved;
* a vector whose owner moved away from it is compared with all.

Both give the nearest centroid exactly: an unmoved centroid that lost to the owner last time loses again. A vector
that changes hands sends its components to the new owner and their negatives to the old one; the transfers are summed
in the task, so a round shuffles one row a task and a pair of clusters, and sums are exact integers.

Distances are |v|^2 - 2 v.c + |c|^2 over integers, by matrix products in double precision where every intermediate
stays below 2^53, by 64-bit integers otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Durable

#: Integer components beyond this have no squared distance of 64 components in a signed long.
MOST = 1 << 27
#: Vectors that a kernel compares together.
BLOCK = 4096


def seed_hash(vec_id: Column, salt: int) -> Column:
    """What starting centroids are chosen by: the smallest come first."""
    return F.sha2(F.concat(F.lit(f"{salt}:"), vec_id.cast("string")), 256)


def _quantized(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a batch that are vectors of ``dims`` finite components, and floor(scale * x) of them, within MOST."""
    column = batch.column("embedding")
    rows, held = [], []
    for i, v in enumerate(column):
        if v.is_valid and len(v) == dims and not v.values.null_count:
            rows.append(i)
            held.append(v.values.to_numpy(zero_copy_only=False))
    x = np.array(held, dtype=np.float64).reshape(len(held), dims)
    with np.errstate(over="ignore"):
        x = np.floor(scale * x)
    good = (np.abs(x) <= MOST).all(axis=1)  # not true of anything that is not finite
    return np.array(rows, dtype=np.int64)[good], x[good].astype(np.int64)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel(), kind))


def _kept(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _quantized(batch, dims, scale)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").cast(pa.int64()).take(pa.array(rows)), _lists(x, pa.int32())], names=["vec_id", "vector"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vector array<int>")


def distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distance of each row of v to each row of c, exact for integers within MOST."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)), 1)
    kind = np.float64 if 4 * most * most * max(1, v.shape[1]) < 1 << 53 else np.int64
    v, c = v.astype(kind), c.astype(kind)
    d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + (c * c).sum(axis=1)[None, :]
    return d.astype(np.int64)


def reassign(v: np.ndarray, owner: np.ndarray, before: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each vector and its distance, given those of the round before (owner -1: none yet).

    moved: which centroids are not where they were. Ties go to the smaller number.
    """
    owner, now = owner.copy(), before.copy()
    fresh = owner < 0
    away = fresh.copy()
    held = np.flatnonzero(~fresh & moved[owner])
    if len(held):
        for c in np.unique(owner[held]):
            its = held[owner[held] == c]
            now[its] = distances(v[its], centroids[c : c + 1])[:, 0]
        away[held] = now[held] > before[held]
    change = np.flatnonzero(moved)
    for rows, among in ((np.flatnonzero(away), np.arange(len(centroids))), (np.flatnonzero(~away), change)):
        if not len(rows) or not len(among):
            continue
        d = distances(v[rows], centroids[among])
        best = d.argmin(axis=1)  # the first of equals, and among is ascending
        near, number = d[np.arange(len(rows)), best], among[best]
        wins = fresh[rows] | (near < now[rows]) | ((near == now[rows]) & (number < owner[rows]))
        owner[rows] = np.where(wins, number, owner[rows])
        now[rows] = np.where(wins, near, now[rows])
    return owner, now


@dataclass
class Model:
    """Centroids, with exact sums and counts of their vectors: of a size that the data do not change."""

    centroids: list[list[int]]
    sums: list[list[int]] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.sums = self.sums or [[0] * len(c) for c in self.centroids]
        self.counts = self.counts or [0] * len(self.centroids)

    def apply(self, transfers: list) -> None:
        """Add signed transfers: rows of a cluster, a count and sums of components."""
        for t in transfers:
            self.counts[t["cluster"]] += int(t["n"])
            self.sums[t["cluster"]] = [a + int(b) for a, b in zip(self.sums[t["cluster"]], t["sums"], strict=True)]

    def move(self) -> list[bool]:
        """Put centroids at the floor of their vectors' mean; empty ones stay. Which have moved."""
        new = [[s // n for s in sums] if n else c for c, sums, n in zip(self.centroids, self.sums, self.counts, strict=True)]
        moved = [a != b for a, b in zip(new, self.centroids, strict=True)]
        self.centroids = new
        return moved


_STATE = "vec_id long, vector array<int>, was int, cluster int, distance long"


def _assign(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                v = part.column("vector").flatten().to_numpy().reshape(part.num_rows, dims).astype(np.int64)
                was = part.column("cluster").to_numpy()
                owner, near = reassign(v, was, part.column("distance").to_numpy(), centroids, moved)
                columns = [part.column("vec_id"), part.column("vector"), pa.array(was, pa.int32()), pa.array(owner, pa.int32()), pa.array(near, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "vector", "was", "cluster", "distance"])

    return state.select("vec_id", "vector", "cluster", "distance").mapInArrow(run, _STATE)


def _transfers(state: DataFrame, k: int, dims: int) -> DataFrame:
    """Signed sums of the vectors that changed hands: rows (cluster, n, sums), one a cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # At most 2^35 rows of a task's components within 2^27 keep sums below 2^62.
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            v = batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, dims).astype(np.int64)
            for column, sign in (("cluster", 1), ("was", -1)):
                owner = batch.column(column).to_numpy()
                some = np.flatnonzero(owner >= 0)
                order = some[np.argsort(owner[some], kind="stable")]
                if len(order):
                    heads = np.flatnonzero(np.diff(owner[order], prepend=-1))
                    sums[owner[order][heads]] += sign * np.add.reduceat(v[order], heads, axis=0)
                    n += sign * np.bincount(owner[order], minlength=k)
        some = np.flatnonzero((n != 0) | (sums != 0).any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), _lists(sums[some], pa.int64())], names=["cluster", "n", "sums"])

    sent = state.where("cluster <> was").select("vector", "was", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    parts = sent.select("cluster", "n", F.posexplode("sums").alias("at", "x"))
    by_component = parts.groupBy("cluster", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"), F.sum("n").alias("n"))
    return by_component.groupBy("cluster").agg(F.first("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("sums"))


def starting_centroids(kept: DataFrame, k: int, salt: int) -> list[list[int]]:
    """The k vectors with the smallest hash of their number; equal numbers go by their components."""
    rows = kept.where("vec_id is not null").select(seed_hash(F.col("vec_id"), salt).alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    return [list(r["vector"]) for r in rows]


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, salt: int = 2) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    vectors needs vec_id and embedding; other columns are ignored. A component x becomes floor(scale * x). Kept are
    vectors of exactly ``dims`` components, none null or non-finite, none beyond 2^27 once scaled (distances would not
    fit a long). Centroids start as the ``k`` kept vectors with the smallest hash of their number; a vector without
    number is assigned to one but is never one at the start. Fewer than k vectors make fewer centroids, equal ones
    stay several, of which the smallest number gets the vectors. Rows that are equal or share a vec_id are vectors of their
    own. After ``rounds`` rounds of assigning and moving, vectors are assigned once more. Sums of distances that pass a
    long are null. A table without kept vectors that have a number gives an empty result.
    """
    spark = vectors.sparkSession
    store = Durable(spark)
    state = store.put("kept", _kept(vectors, dims, scale).select("vec_id", "vector", F.lit(-1).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    model = Model(starting_centroids(state, k, salt))
    k = len(model.centroids)
    if not k:
        return _described(spark, state.where("false"), model)
    moved = [True] * k
    last = "kept"
    for turn in range(rounds + 1):
        if not any(moved):
            break  # nothing that is compared has changed
        state = store.put(f"round{turn}", _assign(state, np.array(model.centroids, dtype=np.int64), np.array(moved)))
        store.drop(last)
        last = f"round{turn}"
        if turn < rounds:
            model.apply(_transfers(state, k, dims).collect())
            moved = model.move()
    return _described(spark, state, model)


def _described(spark: SparkSession, state: DataFrame, model: Model) -> DataFrame:
    """Assignments with what is known of their clusters: one row a cluster, broadcast."""
    spelled = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(model.centroids)]
    named = spark.createDataFrame(spelled, "cluster int, centroid_sha256 string")
    exact = F.col("distance").cast("decimal(38,0)")
    sums = state.groupBy("cluster").agg(F.sum(exact).alias("s"))
    total = sums.agg(F.sum("s").alias("t"))
    clusters = sums.crossJoin(F.broadcast(total)).join(named, "cluster")
    long = {name: F.col(c).try_cast("long").alias(name) for name, c in (("cluster_inertia", "s"), ("inertia", "t"))}
    by_cluster = clusters.select("cluster", long["cluster_inertia"], long["inertia"], "centroid_sha256")
    return state.join(F.broadcast(by_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
