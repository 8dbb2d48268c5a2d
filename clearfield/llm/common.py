"""Pieces that several operators share: durable intermediate tables, word kernels, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these bytes; no byte of a longer UTF-8 sequence is among them.
SPACES = b" \t\n\x0b\x0c\r"
#: The same rule for regular expressions over text.
WORD_BREAKS = r"[\x20\x09-\x0D]+"
#: Bytes of text that a kernel looks at together; bounds its memory whatever the batch size.
CHUNK_BYTES = 1 << 18


# ---------------------------------------------------------------- durable intermediates

_STAGING: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder for intermediate tables that driver and executors all see.

    Taken from ``spark.checkpoint.dir`` of the session. A folder of our own is set only where the
    setting is missing and the session runs on one machine (a local master); elsewhere it is an error.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        known = _STAGING.get("own")
        if known is None:
            known = _STAGING["own"] = "file://" + tempfile.mkdtemp(prefix="clearfield-")
    folder = _STAGING.get(known)
    if folder is None:
        folder = _STAGING[known] = f"{known.rstrip('/')}/clearfield-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have stopped already; the folder is then left to its owner
        pass


def free_prefix(columns: list[str]) -> str:
    """A prefix of underscores that no column begins with, for columns of an operator's own."""
    prefix = "__"
    while any(c.startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


#: Rows of an Arrow batch at most. Texts are long, and a batch is held a few times over on both sides.
BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small in this session; results do not depend on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


class Durable:
    """Tables written once into the shared folder, so that a lost executor costs no recomputation.

    ``put`` writes a frame and returns it as read back, with its lineage cut; ``drop`` deletes a
    table that nothing reads any more. What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
        self.at: dict[str, str] = {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = self.at[name] = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if name in self.at:
                _remove(self.spark, self.at.pop(name))


# ---------------------------------------------------------------- words and their hashes

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 3)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_BYTE_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(SPACES)] = True
_FOLDED_CODES = _BYTE_CODES.copy()
_FOLDED_CODES[65:91] = _BYTE_CODES[97:123]
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values, for arrays."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_POWERS.get("up", ()))
    if have < n:
        size = max(n, 2 * CHUNK_BYTES)
        steps = np.full(size, _MULTIPLIER, dtype=np.uint64)
        back = np.full(size, _INVERSE, dtype=np.uint64)
        steps[0] = back[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(steps), np.cumprod(back)
    return _POWERS["up"], _POWERS["down"]


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole texts of an Arrow string column in runs of about ``most`` bytes.

    Yields (first row, end row, bytes, offsets); null counts as empty. A text longer than
    that is a run of its own, never cut.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_bounds(raw: np.ndarray, offsets: np.ndarray, outside: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each document the number of its first word; outside: which bytes part words."""
    inside = ~outside[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    if len(raw):
        before[offsets[:-1][offsets[:-1] < len(raw)]] = False
        after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; with fold, A-Z count as a-z."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((_FOLDED_CODES if fold else _BYTE_CODES)[raw] * up[: len(raw)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


_PLACES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive word hashes, by its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = words[:n] * _PLACES[0]
    for i in range(1, k):
        total = total + words[i : i + n] * _PLACES[i]
    return mix(total)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row of a string column, its sorted distinct k-word shingles as 64-bit hashes.

    Words are folded to lower case over A-Z. A text of fewer than k words is one shingle, its whole
    sequence; one without words has none.
    """
    for lo, hi, raw, offsets in text_chunks(column):
        starts, ends, first = word_bounds(raw, offsets)
        words = word_hashes(raw, starts, ends, fold=True)
        grams = gram_hashes(words, k)
        for d in range(hi - lo):
            a, b = first[d], first[d + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mix((words[a:b] * _PLACES[: b - a]).sum(dtype=np.uint64, keepdims=True) + _PLACES[200 + b - a])
            else:
                yield np.zeros(0, dtype=np.uint64)


def lists_of(arrays: list[np.ndarray]) -> pa.ListArray:
    """An Arrow list<int64> column of 64-bit arrays."""
    ends = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=ends[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def n_words(text: Column) -> Column:
    """Words of a text, null counting as empty, with built-in expressions."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{WORD_BREAKS}|{WORD_BREAKS}$", "")
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_BREAKS))).cast("long")


# ---------------------------------------------------------------- connected components


def components(links: DataFrame, store: Durable, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node of an undirected link table: rows (node, component).

    Alternating star contraction: links are rewritten until every node points straight at the
    smallest node of its component. Each step is two grouped minima (combined before the shuffle)
    and two equi-joins, whose hot sides Spark can split; each result is written to the shared
    folder. Nodes without links do not appear; self links and null ends are ignored.
    """
    edges = store.put(
        "cc",
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct(),
    )
    while True:
        # Large star: every larger neighbour of a node is tied to the node's smallest neighbour.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of a node, and the node, are tied to the smallest.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        old, edges = store.at.get("cc"), store.put("cc", small)
        _remove(store.spark, old)
        # Done when the links are stars: one target for each node, and no target has one itself.
        sizes = edges.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("u").alias("nodes")).first()
        if sizes["n"] == sizes["nodes"] and edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
