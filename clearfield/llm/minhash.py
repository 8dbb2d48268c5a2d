"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star edges.

A document's set is its distinct k-word shingles over A-Z folded words; two documents are linked when
``100 * |A & B| >= percent * |A | B|``. Every link is confirmed on the full sets.

1. One pass over the texts gives each set's size, a 128-bit digest, and band keys of its one-permutation
   sketch. Equal digests are one class; the class goes on as its smallest doc_id.
2. Classes that share a band key share a bucket. In each bucket, members are tied as a star to the member
   with the widest company (in a family of copies that is the original).
3. Where a bucket still spans several components, stars go on around further members, in growing numbers. A
   member that has been a centre is done, so that in the end every pair of a bucket is either compared or
   already connected; no bucket is capped. The classes of crowded buckets meet by their rarest shingles
   there, which loses no link and holds far fewer false pairs than the bucket does.
4. Components of the confirmed links give each class, and through it each copy, its smallest doc_id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Durable, components, free_prefix, lists_of, mix, shingle_sets


@dataclass(frozen=True)
class Banding:
    """A sketch of bins = bands * rows one-permutation bins, keyed band by band."""

    bands: int
    rows: int
    seed: int

    @property
    def bins(self) -> int:
        return self.bands * self.rows


#: At similarity 0.8 a pair shares no band with odds of 5e-5, at 0.85 of 4e-7.
BANDING = Banding(bands=25, rows=5, seed=11)
#: Buckets that still hold more classes than this after their first star are dealt anew, by rare shingles.
SMALL_BUCKET = 32
#: Document numbers that are broadcast at most (8 bytes each, some 16 MB as a hash table).
MOST_BROADCAST = 500_000


class Sketcher:
    """One-permutation sketches: the hash range is cut into bins, each keeps its smallest member.

    An empty bin borrows from a non-empty one, found by probing bins in an order that depends on the
    bin's number alone (optimal densification), so equal sets of filled bins borrow alike.
    """

    PROBES = 64

    def __init__(self, banding: Banding):
        self.banding = banding
        n = banding.bins
        seed = np.array([banding.seed], dtype=np.uint64)
        self.probes = np.random.Generator(np.random.PCG64(banding.seed)).integers(0, n, (self.PROBES, n))
        self.ranks = mix(np.arange(n * n, dtype=np.uint64) + mix(seed)).reshape(n, n)
        self.places = mix(np.arange(1, n + 1, dtype=np.uint64) + mix(seed + np.uint64(1)))
        self.names = mix(np.arange(banding.bands, dtype=np.uint64) + mix(seed + np.uint64(2)))

    def keys(self, sets: list[np.ndarray]) -> np.ndarray:
        """Keys (sets, bands) of sorted sets of 64-bit hashes; an empty set's keys mean nothing."""
        n, bins = len(sets), self.banding.bins
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        doc = np.repeat(np.arange(n), [len(m) for m in sets])
        # The upper 32 bits, scaled to the number of bins; members are sorted, so the first of a bin is its smallest.
        cell = doc * bins + ((flat >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
        first = np.ones(len(cell), bool)
        first[1:] = cell[1:] != cell[:-1]
        values = np.zeros(n * bins, np.uint64)
        filled = np.zeros(n * bins, bool)
        values[cell[first]] = flat[first]
        filled[cell[first]] = True
        source = np.arange(n * bins)
        open_ = np.flatnonzero(~filled & np.repeat(np.array([len(m) > 0 for m in sets], bool), bins))
        for probe in self.probes:
            if not len(open_):
                break
            base = open_ // bins * bins
            at = base + probe[open_ - base]
            hit = filled[at]
            source[open_[hit]] = at[hit]
            open_ = open_[~hit]
        if len(open_):  # sparse sets: the filled bin that ranks first for the empty one
            for d in np.unique(open_ // bins):
                mine = open_[open_ // bins == d] - d * bins
                have = np.flatnonzero(filled[d * bins : (d + 1) * bins])
                source[d * bins + mine] = d * bins + have[self.ranks[np.ix_(mine, have)].argmin(axis=1)]
        drawn = values[source].reshape(n, bins) * self.places
        return mix(mix(drawn).reshape(n, self.banding.bands, self.banding.rows).sum(axis=2, dtype=np.uint64) + self.names)


def sketches(docs: DataFrame, words: int, banding: Banding = BANDING) -> DataFrame:
    """Rows (doc_id, n_shingles, digest, keys): the digest is null and keys are empty for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(banding)

        def out(ids: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
            keys = sketcher.keys(sets)
            digests = [hashlib.blake2b(m.tobytes(), digest_size=16).digest() if len(m) else None for m in sets]
            listed = lists_of([k if len(m) else m for k, m in zip(keys, sets, strict=True)])
            sizes = pa.array([len(m) for m in sets], pa.int64())
            return pa.RecordBatch.from_arrays([ids, sizes, pa.array(digests, pa.binary()), listed], names=["doc_id", "n_shingles", "digest", "keys"])

        for batch in batches:
            for lo, sets in _some(shingle_sets(batch.column("text"), words)):
                yield out(batch.column("doc_id").cast(pa.int64()).slice(lo, len(sets)), sets)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>")


def _some(sets: Iterator[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Sets in runs of bounded weight, with the number of the first of each run."""
    held, lo, weight = [], 0, 0
    for members in sets:
        held.append(members)
        weight += len(members) + 100
        if weight > 1 << 19:
            yield lo, held
            lo, held, weight = lo + len(held), [], 0
    if held:
        yield lo, held


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, members): whole shingle sets, as sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in _some(shingle_sets(batch.column("text"), words)):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()).slice(lo, len(sets)), lists_of(sets)], names=["doc_id", "members"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, members array<long>")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, small: int = SMALL_BUCKET) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    docs needs doc_id and text; other columns, whatever their names, are ignored. A null or empty
    text, or one of white space, has an empty set, is linked with nothing and is its own component.
    Rows that share a doc_id are one node: they get one component, by the links of any of them. A row
    whose doc_id is null is returned with a null component and kept. An empty table gives an empty result.

    Shingles are compared as 64-bit hashes, on full sets too: among 10^9 distinct shingles a collision is likely
    somewhere, and its effect is one shingle more in common in the pairs that hold both.
    """
    spark = docs.sparkSession
    store = Durable(spark)
    sigs = store.put("sigs", sketches(docs, words))

    # Equal sets are one class, represented by its smallest doc_id.
    classes = sigs.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = sigs.join(classes, (sigs["digest"] == classes["digest"]) & (sigs["doc_id"] == classes["rep"]), "left_semi")
    buckets = reps.select("doc_id", F.col("n_shingles").alias("n"), F.explode("keys").alias("bucket"))
    # Written, so that both sides of the join are plain exchanges and a hot bucket's rows can be split.
    shared = store.put("shared", buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    held = store.put("held", buckets.join(shared, "bucket").select("bucket", "doc_id", "n", "size"))
    met = store.put("met", held.select("doc_id").distinct())
    # Few enough to be sent to every task, or else both sides are dealt out.
    met = F.broadcast(met) if met.count() <= MOST_BROADCAST else met
    texts = docs.select("doc_id", "text").join(met, "doc_id", "left_semi")
    sets = store.put("sets", full_sets(texts, words))
    links = _star_links(held, sets, percent, small, store)

    found = components(links, store)
    by_set = (
        classes.join(found, classes["rep"] == found["node"], "left")
        .select("digest", F.coalesce("component", "rep").alias("component_id"))
    )
    rows = sigs.join(by_set, "digest", "left")
    # A doc_id with several texts ties their classes together.
    twice = sigs.groupBy("doc_id").agg(F.count_distinct("digest").alias("k")).where("k > 1 and doc_id is not null").select("doc_id")
    if not twice.isEmpty():
        ties = rows.join(twice, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.coalesce("component_id", "doc_id").alias("b"))
        merged = components(links.unionByName(ties), store)
        by_set = (
            classes.join(merged, classes["rep"] == merged["node"], "left")
            .select("digest", F.coalesce("component", "rep").alias("component_id"))
        )
        rows = sigs.join(by_set, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def keep_one(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """docs, all columns, with one document of each near-duplicate component: the one of smallest doc_id.

    Rows that share the doc_id of a kept document are one document; one of them, the first by text,
    stays. Rows without a doc_id stay. Null and empty texts, and those without words, are alike to nothing and stay;
    an empty table stays empty.
    """
    found = near_duplicates(docs, percent, words)
    id_ = free_prefix(docs.columns) + "id"
    kept = found.where("kept and doc_id is not null").select(F.col("doc_id").alias(id_))
    twice = kept.groupBy(id_).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(id_)
    known = docs.where("doc_id is not null")
    unique = known.join(kept.join(twice, id_, "left_anti"), F.col("doc_id") == F.col(id_), "left_semi")
    if not twice.isEmpty():
        again = known.join(twice, F.col("doc_id") == F.col(id_), "left_semi")
        row = F.struct(F.coalesce("text", F.lit("")), *[F.col(f"`{c}`") for c in docs.columns])
        unique = unique.unionByName(again.groupBy("doc_id").agg(F.min(row).alias("r")).select(*[F.col(f"r.`{c}`") for c in docs.columns]))
    return unique.unionByName(docs.where("doc_id is null"))


def _rare_shingles(crowded: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows (bucket, doc_id, n, at): each crowded class under its rarest shingles, as many as any link needs.

    A partner of at least ``percent`` similarity shares percent / 100 of a set's n members at least, so
    it shares one of any n - ceil(n * percent / 100) + 1 of them; with one order of shingles for all,
    two linked sets share one of their first so many. Rarest first, by the count among the crowded,
    a family of copies with private edits meets in few places. ``at`` is how many members stand before
    the shingle in that order; at the first one that two sets share, what is left of the smaller rest
    must make up the whole overlap.
    """
    listed = sets.join(crowded, "doc_id").select("doc_id", F.size("members").alias("n"), F.explode("members").alias("shingle"))
    often = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("times"))
    # Each row's list is its own set again, so it is no larger than the set.
    ordered = listed.join(often, "shingle").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("s"))
    first = F.slice("s", F.lit(1), F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1)
    met = ordered.select("doc_id", F.col("n").cast("long").alias("n"), F.posexplode(first).alias("at", "s")).where("s.times > 1")
    return met.select(F.col("s.shingle").alias("bucket"), "doc_id", "n", "at")


def _star_links(held: DataFrame, sets: DataFrame, percent: int, small: int, store: Durable) -> DataFrame:
    """Confirmed links (a, b) that connect whatever a complete comparison within buckets would connect.

    held: rows (bucket, doc_id, n, size). Each round compares every member of a bucket with the
    bucket's centres of that round, unless the two are connected already; the centres then leave. A
    bucket is done when the members left in it are all of one component. After the first round, the
    members of buckets that are still crowded meet by their rarest shingles instead.
    """
    # The widest company: the sum of the sizes of a document's buckets.
    width = held.groupBy("doc_id").agg(F.sum("size").alias("width"))
    state = held.join(width, "doc_id").select("bucket", "doc_id", "n", "width", F.col("doc_id").alias("part"), F.lit(0).alias("at"))
    links, parts, turn = None, None, 0
    while True:
        # Buckets whose members still span components, with the member of widest company.
        open_ = (
            state.groupBy("bucket")
            .agg(
                F.max_by("doc_id", F.struct("width", F.bitwise_not("doc_id"))).alias("hub"),
                F.count(F.lit(1)).alias("left"),
                F.min("part").alias("lo"),
                F.max("part").alias("hi"),
            )
            .where("lo != hi")
            .select("bucket", "hub", "left")
        )
        live = state.join(store.put(f"hubs{turn}", open_), "bucket")
        if turn == 1:
            live = store.put("open1", live)
            crowded = live.where(F.col("left") > small).select("doc_id").distinct()
            rare = _rare_shingles(crowded, sets, percent).join(parts, F.col("doc_id") == F.col("node"), "left")
            rare = rare.select("bucket", "doc_id", "n", F.col("n").alias("width"), F.coalesce("component", "doc_id").alias("part"), "at")
            state = store.put("state1b", live.where(F.col("left") <= small).select(*rare.columns).unionByName(rare))
            turn = 2
            continue
        centre = F.col("doc_id") == F.col("hub")
        if turn:
            draw = F.pmod(F.xxhash64("doc_id", "bucket", F.lit(turn)), F.lit(1 << 30)) / F.lit(float(1 << 30))
            centre = centre | (draw < F.lit(float(small) * 64 ** (turn - 2)) / F.col("left"))
        live = store.put(f"live{turn}", live.withColumn("centre", centre).drop("hub", "left"))
        if live.isEmpty():
            break
        c = live.where("centre").select("bucket", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("part").alias("pb"), F.col("at").alias("atb"))
        fits = (
            (F.col("part") != F.col("pb"))
            # What is left of either set must hold the overlap that a link of these sizes needs.
            & (F.least(F.col("n") - F.col("at"), F.col("nb") - F.col("atb")) * (100 + percent) >= (F.col("n") + F.col("nb")) * percent)
            & (~F.col("centre") | (F.col("doc_id") < F.col("b")))
        )
        pairs = live.join(c, "bucket").where(fits).select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()
        one = sets.select(F.col("doc_id").alias("a"), F.col("members").alias("ma"))
        two = sets.select(F.col("doc_id").alias("b"), F.col("members").alias("mb"))
        both = F.size(F.array_intersect("ma", "mb"))
        sure = pairs.join(one, "a").join(two, "b").where(both * 100 >= percent * (F.size("ma") + F.size("mb") - both)).select("a", "b")
        sure = store.put(f"links{turn}", sure)
        links = sure if links is None else links.unionByName(sure)
        parts = components(links, store)
        # A centre has met its whole bucket, so it has no more to do there.
        rest = live.where(~F.col("centre")).join(parts, F.col("doc_id") == F.col("node"), "left")
        state = store.put(f"state{turn + 1}", rest.select("bucket", "doc_id", "n", "width", F.coalesce("component", "doc_id").alias("part"), "at"))
        turn += 1
    return links if links is not None else held.sparkSession.createDataFrame([], "a long, b long")
