"""Mixing sources to target weights: a time-varying curriculum over the training positions 0 to 1.

Each source has a weight schedule, linear between knots over training time. Its integral gives the source's
share of the budget, capped at a number of repetitions of what the source has; the excess is shared again by
weight. Within a source, documents stand in a reproducible order; a document's place in it, in words, is
turned into a training position by inverting the source's cumulative demand. The mix is the documents
range-sorted by position.

Cumulative sizes come in two levels, by hash bucket and then within it, so that a source of any share of the
rows is many tasks. Everything is a built-in expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_prefix, n_words

BUCKET_ROWS, MOST_BUCKETS = 64, 1 << 14
_NEW = ("size", "source_size", "target", "taken", "copies", "position")


@dataclass(frozen=True)
class Schedule:
    """A source's weight over training time: points (time, weight), linear between them, times 0 to 1 ascending."""

    points: tuple[tuple[float, float], ...]

    def __post_init__(self):
        times = [t for t, _ in self.points]
        if times[:1] != [0.0] or times[-1:] != [1.0] or times != sorted(set(times)) or any(w < 0 for _, w in self.points) or self.integral <= 0:
            raise ValueError("a schedule runs from time 0 to 1 with weights of 0 or more, not all 0")

    @property
    def pieces(self) -> list[tuple[float, float, float, float, float]]:
        """(begin, end, weight at begin, weight at end, integral before begin) of each piece."""
        out, before = [], 0.0
        for (a, v), (b, w) in zip(self.points, self.points[1:], strict=False):
            out.append((a, b, v, w, before))
            before += (b - a) * (v + w) / 2
        return out

    @property
    def integral(self) -> float:
        return sum((b - a) * (v + w) / 2 for (a, v), (b, w) in zip(self.points, self.points[1:], strict=False))

    def when(self, share: Column) -> Column:
        """Time at which the share (0 to 1) of the whole integral is reached, as an expression."""
        want = share * self.integral
        out = F.lit(1.0)
        for a, b, v, w, before in reversed(self.pieces):
            rest = F.greatest(want - before, F.lit(0.0))
            slope = (w - v) / (b - a)
            # The positive root of slope/2 t^2 + v t = rest, in the form that holds for slope 0 too.
            root = F.sqrt(F.greatest(F.lit(v * v) + 2 * slope * rest, F.lit(0.0))) + v
            t = F.when(root > 0, 2 * rest / root).otherwise(0.0)
            area = (b - a) * (v + w) / 2
            out = F.when(want <= before + area, F.least(F.lit(b), F.lit(a) + t)).otherwise(out) if area > 0 else out
        return out


#: Weights 5, 2, 1: the first fades, the second holds, the third comes late. Their integrals are the weights.
CURRICULUM = (
    Schedule(((0.0, 6.0), (1.0, 4.0))),
    Schedule(((0.0, 2.0), (1.0, 2.0))),
    Schedule(((0.0, 0.5), (0.5, 0.75), (1.0, 2.0))),
)


def source_targets(sizes: DataFrame, schedules: tuple[Schedule, ...], budget: float, most: float) -> DataFrame:
    """Rows (source, source_size, kind, target) from rows (source, source_size), one a source.

    Sources, by code point with null last, take the schedules in turn (kind). budget: the share of all
    sizes to hand out; most: repetitions of a source at most. Filling to the caps has a closed form:
    sources in the order of size over weight reach their cap first, and a source's target is the least of
    its cap and its share of what the ones before it leave. If all caps together are below the budget,
    every source is at its cap. Windows here run over one row a source.
    """
    weights = F.array(*[F.lit(s.integral) for s in schedules])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kind = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(schedules)))
    named = sizes.withColumn("kind", kind).withColumn("weight", F.element_at(weights, F.col("kind") + 1)).withColumn("cap", F.lit(most) * F.col("source_size"))
    filled = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, rest = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        named.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("share", (budget * F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
        # The first source in this order that its share does not fill sets the level for those after it.
        .withColumn("level", F.when(F.col("share") * F.col("weight") < F.col("cap"), F.col("share")))
        .withColumn("level", F.first("level", ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    target = F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return level.select("source", "source_size", "kind", target.cast("double").alias("target"))


def mix_sources(docs: DataFrame, schedules: tuple[Schedule, ...] = CURRICULUM, budget: float = 1.5, most: float = 2.0, seed: int = 1, size: str | None = None) -> DataFrame:
    """docs with size, source_size, target, taken, copies and position, one row per document, unsorted.

    size: words of the text (null: 0). target: words its source is to give. taken: words of the document
    in the mix, repetitions counted, at most ``most`` times its size; a source's documents are gone
    through in a reproducible order, again and again, until its target is reached, so that the last one
    gives a part and the source's words are within one of its target. copies: how often the document
    begins in the mix, where its last copy counts if half of it is taken. position: training time, 0 to
    1, at which its first copy begins; null where taken is 0.

    docs needs doc_id, source and text, or in place of text a column named by ``size`` that holds the
    words already counted; null sources are one source, last in order. Rows
    equal in doc_id and size may swap places. Columns with the new names are replaced. An empty table,
    or one without words, gives zero targets. Sources are taken to be names of collections, so that one
    row for each (targets are windows over them) fits a task.
    """
    return _mix(docs, schedules, budget, most, seed, size)


def _mix(
    docs: DataFrame, schedules: tuple[Schedule, ...], budget: float, most: float, seed: int, size: str | None, keep: str | None = None
) -> DataFrame:
    """mix_sources; with keep, also the source's schedule and the document's place in it, under that prefix."""
    new = _NEW
    p = keep or free_prefix(docs.columns)
    w, src, nul, b, h, i, s, o, kind, place = (p + x for x in ("words", "src", "nul", "bucket", "hash", "inside", "sum", "offset", "kind", "at"))
    sized = docs.withColumn(w, F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else n_words(F.col("text")))
    columns = [c for c in docs.columns if c not in new]
    # A null source is told apart by a flag, so that windows and the join deal rows out alike, once.
    keys = [src, nul, b]
    base = sized.select(*[F.col(f"`{c}`") for c in columns], F.col(w).alias("size")).withColumns(
        {src: F.coalesce("source", F.lit("")), nul: F.col("source").isNull(), h: F.xxhash64("doc_id", F.col("size"), F.lit(seed))}
    )
    # Count the rows to choose how finely the order is cut; the cut changes no result.
    n, buckets = docs.count(), 1
    while buckets < MOST_BUCKETS and buckets * BUCKET_ROWS < n:
        buckets *= 2
    bits = buckets.bit_length() - 1
    base = base.withColumn(b, F.shiftrightunsigned(F.col(h), 64 - bits).cast("int") if bits else F.lit(0))
    cells = base.groupBy(*keys).agg(F.sum("size").alias(s))
    before = Window.partitionBy(src, nul).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn(o, F.coalesce(F.sum(s).over(before), F.lit(0))).drop(s)
    sizes = cells.groupBy(src, nul).agg(F.sum(s).alias("source_size"))
    named = sizes.select(F.when(~F.col(nul), F.col(src)).alias("source"), "source_size")
    targets = source_targets(named, schedules, budget, most).select(
        F.coalesce("source", F.lit("")).alias(src), F.col("source").isNull().alias(nul), "source_size", F.col("kind").alias(kind), "target"
    )
    known = offsets.join(targets, [src, nul]).select(*(F.col(k).alias(f"{k}2") for k in keys), o, "source_size", kind, "target")

    within = Window.partitionBy(*keys).orderBy(h, "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        base.withColumn(i, F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(known, [F.col(k) == F.col(f"{k}2") for k in keys])
        .withColumn(place, F.col(o) + F.col(i))
    )
    goal = F.round("target").cast("long")
    words, at, total = F.col("size"), F.col(place), F.col("source_size")
    rounds = F.when(total > 0, F.floor(goal / total)).otherwise(0).cast("long")
    part = F.greatest(F.lit(0), F.least(words, goal - rounds * total - at)).cast("long")
    taken = rounds * words + part
    begun = F.when(goal > 0, F.least(F.lit(1.0), at / goal))
    position = F.lit(None).cast("double")
    for k, schedule in enumerate(schedules):
        position = F.when(F.col(kind) == k, schedule.when(begun)).otherwise(position)
    return (
        placed.withColumn("taken", taken)
        .withColumn("copies", (rounds + (2 * part >= F.greatest(words, F.lit(1))).cast("long")).cast("int"))
        .withColumn("position", F.when(F.col("taken") > 0, position))
        .select(*[F.col(f"`{c}`") for c in columns], *new, *((kind, place) if keep else ()))
    )


def training_order(docs: DataFrame, schedules: tuple[Schedule, ...] = CURRICULUM, budget: float = 1.5, most: float = 2.0, seed: int = 1) -> DataFrame:
    """The mix itself: whole documents, repeated as often as they are taken, range-sorted by position.

    Columns of docs, then position. A document's second copy stands where its source's order comes round
    to it again. Documents that are not taken, and the rounding of the last one of each source, are the
    only rows that go. Nulls, ties, repeated rows and empty tables are as in ``mix_sources``.
    """
    p = free_prefix(docs.columns)
    mixed = _mix(docs, schedules, budget, most, seed, None, keep=p)
    columns = [c for c in docs.columns if c not in _NEW]
    again = mixed.where("copies > 0").withColumn(f"{p}k", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    begun = F.least(F.lit(1.0), (F.col(f"{p}at") + F.col(f"{p}k") * F.col("source_size")) / F.greatest(F.round("target"), F.lit(1.0)))
    position = F.lit(1.0)
    for i, s in enumerate(schedules):
        position = F.when(F.col(f"{p}kind") == i, s.when(begun)).otherwise(position)
    placed = again.withColumn("position", position).select(*[F.col(f"`{c}`") for c in columns], "position")
    return placed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
