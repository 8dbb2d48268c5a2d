"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations, multiprobe buckets, verified links.

A hash rotates a unit vector by three rounds of random signs and a Hadamard transform and names the
closest signed axis. A table's bucket is the axes of ``HASHES`` such rotations, with label and dimension.
A vector is listed in its own bucket and in those that differ in one axis, its second closest. Vectors
that meet in a bucket are compared in double precision.

Equal vectors of a label are one class with a weight. Buckets are cut into blocks of bounded size and each
pair of blocks is one small matrix product, so a hot bucket is many tasks, not one. Of a product only sums
leave: links by vector, and a spanning forest of the links in place of the pairs. A pair that meets in
several buckets counts in the first of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Durable, components, mix

TABLES, HASHES, SEED = 10, 3, 77
PROBES = HASHES + 1
#: Vectors in a block of a bucket, on average.
BLOCK = 256


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of the rows, whose length is a power of two, scaled to keep lengths."""
    n = x.shape[1]
    step = 1
    while step < n:
        pairs = x.reshape(len(x), -1, 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def bucket_keys(unit: np.ndarray, labels: np.ndarray, tables: int = TABLES, hashes: int = HASHES) -> np.ndarray:
    """Buckets of unit vectors: an array (vectors, tables, 1 + hashes) of 64-bit keys, the vector's own first."""
    n, dims = unit.shape
    size = 1 << max(1, (dims - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :dims] = unit
    signs = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (tables, hashes, 3, size)) * 2.0 - 1.0
    keys = np.empty((n, tables, hashes + 1), dtype=np.uint64)
    base = mix(labels.astype(np.int64).view(np.uint64) * np.uint64(1_000_003) + np.uint64(dims))
    rows = np.arange(n)
    for t in range(tables):
        axes = np.empty((2, hashes, n), dtype=np.uint64)
        for h in range(hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[t, h, r])
            strength = np.abs(y)
            for place in range(2):
                best = strength.argmax(axis=1)
                axes[place, h] = (2 * best + (y[rows, best] < 0)).astype(np.uint64)
                strength[rows, best] = -1
        for probe in range(hashes + 1):
            code = mix(base + np.uint64(t))
            for h in range(hashes):
                code = mix(code * np.uint64(31) + axes[int(probe == h + 1), h])
            keys[:, t, probe] = code
    return keys


def _read(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, label, digest, vector, keys); the last three are null for a vector that links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                ids, labels = part.column("vec_id").cast(pa.int64()), part.column("label").cast(pa.int64()).to_pylist()
                digests: list = [None] * len(labels)
                held: list = [None] * len(labels)
                keys: list = [None] * len(labels)
                by_dims: dict[int, list[int]] = {}
                for i, v in enumerate(part.column("embedding")):
                    if labels[i] is None or not v.is_valid or not len(v) or v.values.null_count:
                        continue
                    x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                    if np.isfinite(x).all() and x.any():
                        held[i] = x
                        digests[i] = hashlib.blake2b(x.tobytes() + labels[i].to_bytes(8, "little", signed=True), digest_size=16).digest()
                        by_dims.setdefault(len(x), []).append(i)
                for at in by_dims.values():
                    x = np.stack([held[i] for i in at])
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    found = bucket_keys(x, np.array([labels[i] for i in at])).reshape(len(at), -1).view(np.int64)
                    for i, k in zip(at, found, strict=True):
                        keys[i] = k
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(digests, pa.binary()), pa.array(held, pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64()))],
                    names=["vec_id", "digest", "vector", "keys"],
                )

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, "vec_id long, digest binary, vector array<double>, keys array<long>")


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of a with each row of b, in double precision, safe for any finite lengths."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a @ b.T) / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)[None, :]


def block_links(
    bucket: int, same: bool, ids: np.ndarray, side: np.ndarray, x: np.ndarray, keys: np.ndarray, weights: np.ndarray, least: float
) -> tuple[np.ndarray, ...]:
    """Links between two blocks of a bucket, sides 0 and 1, or within one block (same), as sums.

    One of two blocks may be empty, as places in blocks are hashes; then there is nothing to count. Returns ids, links of each counted with the partners' weights, and the smallest id that its links
    within the two blocks reach. keys: (vectors, tables, probes).
    """
    p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    q = p if same else q
    if not len(p) or not len(q):
        return ids[:0], ids[:0], ids[:0]
    i, j = np.nonzero(cosines(x[p], x[q]) >= least)
    if same:
        i, j = i[i < j], j[i < j]
    a, b = p[i], q[j]
    # A pair counts in the first table where it meets, in the smallest bucket there.
    fresh = np.ones(len(a), bool)
    for lo in range(0, len(a), 20_000):
        s = slice(lo, lo + 20_000)
        meets = keys[a[s]][:, :, :, None] == keys[b[s]][:, :, None, :]
        table = meets.any(axis=(2, 3)).argmax(axis=1)
        row = np.arange(len(table))
        shared = np.where(meets[row, table].any(axis=2), keys[a[s]][row, table], np.iinfo(np.int64).max)
        fresh[s] = shared.min(axis=1) == bucket
    a, b = a[fresh], b[fresh]
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, a, weights[b])
    np.add.at(n, b, weights[a])
    low = ids.copy()
    while len(a):
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        if (before == low).all():
            break
    some = n > 0
    return ids[some], n[some], low[some]


def _compare(blocks: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []

        def close() -> list[np.ndarray]:
            keys = np.array([r["keys"] for r in held], dtype=np.int64).reshape(len(held), TABLES, PROBES)
            return list(
                block_links(
                    held[0]["bucket"], held[0]["i"] == held[0]["j"], np.array([r["vec_id"] for r in held]), np.array([r["side"] for r in held]),
                    np.stack([r["vector"] for r in held]), keys, np.array([r["weight"] for r in held]), least,
                )
            )

        def out(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
            columns = [np.concatenate(c) if parts else np.zeros(0, np.int64) for c in (zip(*parts, strict=True) if parts else [[]] * 3)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["vec_id", "n", "low"])

        for batch in batches:
            parts = []
            names = batch.schema.names
            for row in zip(*(batch.column(c).to_pylist() if c != "vector" and c != "keys" else (v.values.to_numpy() for v in batch.column(c)) for c in names), strict=True):
                r = dict(zip(names, row, strict=True))
                if held and any(held[0][c] != r[c] for c in ("bucket", "i", "j")):
                    parts.append(close())
                    held = []
                held.append(r)
            yield out(parts)
        if held:
            yield out([close()])

    return blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(run, "vec_id long, n long, low long")


def near_vectors(vectors: DataFrame, least: float = 0.98, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable by links), kept.

    vectors needs vec_id, label and embedding; other columns are ignored. Only vectors of equal label
    and dimension are compared. A vector that is null, empty, zero or holds null or non-finite values,
    or whose label is null, has no links and is its own component; so is a row whose vec_id is null
    (its component is null, it is kept). Equal vectors of a label are linked; rows that share a vec_id
    are one node, whose n_links counts the other rows linked to each of them. An empty table gives an
    empty result; columns of other names are ignored, also those that are used inside.

    n_links counts every link, so a group of N distinct vectors that are all alike costs N * N / 2
    products, in blocks of about ``block`` vectors: quadratic in all, bounded in each task.
    """
    store = Durable(vectors.sparkSession)
    rows = store.put("vectors", _read(vectors))
    good = rows.where("digest is not null and vec_id is not null")
    classes = good.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    reps = store.put(
        "reps",
        good.join(classes, "digest")
        .where("vec_id = rep")
        .select("vec_id", "digest", "vector", "keys", "weight")
        .dropDuplicates(["digest"]),
    )
    listed = reps.select("vec_id", "digest", F.explode(F.array_distinct("keys")).alias("bucket"))
    sizes = listed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")
    met = listed.join(sizes, "bucket").withColumn("parts", parts).withColumn("own", own)
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "bucket",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
        "digest",
    )
    full = dealt.join(reps, "digest").select("bucket", "i", "j", "side", "vec_id", "vector", "keys", "weight")
    sums = store.put("sums", _compare(full, least))

    links = sums.groupBy("vec_id").agg(F.sum("n").alias("n"))
    found = components(sums.select(F.col("vec_id").alias("a"), F.col("low").alias("b")), store)
    by_class = (
        classes.join(links.withColumnRenamed("vec_id", "linked"), F.col("rep") == F.col("linked"), "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("digest")).alias("digest")).join(by_class, "digest", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
