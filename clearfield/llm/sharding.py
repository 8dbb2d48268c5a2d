"""Reproducible shuffle and sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get gapless numbers in an order of hashes that depends on the rows alone, not on how they are
partitioned; a keyed Feistel network permutes the numbers; shard and slot are then remainder and quotient.
Any row's place can be computed from its number, the row count and the seed, without the other rows.
Everything is a built-in expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_prefix

#: Rows of a numbering bucket aimed at, and the most buckets there are (their offsets meet in one task).
BUCKET_ROWS, MOST_BUCKETS = 64, 1 << 14
ROUNDS, WALKS = 6, 64


def feistel(number: Column, n: int, seed: int) -> Column:
    """A permutation of 0 .. n-1, as an expression.

    The domain is split as a * b with a, b near the root of n; each round adds a keyed hash of one half
    to the other, modulo its size. Fewer than a points of a * b lie beyond n; a number that lands there
    is permuted again until it does not (cycle walking), which ends after that many steps at most.
    WALKS steps are unrolled as a fold; a walk that were not over by then raises an error, with odds
    below n ** -30 once n exceeds WALKS ** 2.
    """
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    b = max(1, -(-n // a))

    def once(x: Column) -> Column:
        right = F.pmod(x, F.lit(b))
        left = ((x - right) / F.lit(b)).cast("long")
        for r in range(ROUNDS):
            if r % 2:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(r)), F.lit(b)), F.lit(b))
            else:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(r)), F.lit(a)), F.lit(a))
        return left * F.lit(b) + right

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), once(number), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def numbered(df: DataFrame, *identity: Column, seed: int = 0, name: str = "__n") -> tuple[DataFrame, int]:
    """df with gapless numbers from 0 in an order fixed by the hash of ``identity``, and the row count.

    Numbers are counted in hash buckets of about equal size, whose offsets come from one grouped count;
    no window spans the table. Rows equal in identity get adjacent numbers; which of them gets which
    does not matter to anything but columns outside the identity.
    """
    n = df.count()
    buckets = 1
    while buckets < MOST_BUCKETS and buckets * BUCKET_ROWS < n:
        buckets *= 2
    p = free_prefix([*df.columns, name])
    h, b, c, o = (p + x for x in ("hash", "bucket", "count", "offset"))
    hashed = df.withColumn(h, F.xxhash64(*identity, F.lit(seed)))
    bits = buckets.bit_length() - 1
    bucket = F.shiftrightunsigned(F.col(h), 64 - bits).cast("int") if bits else F.lit(0)
    hashed = hashed.withColumn(b, bucket)
    counts = hashed.groupBy(b).agg(F.count(F.lit(1)).alias(c))
    before = Window.orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(b, F.coalesce(F.sum(c).over(before), F.lit(0)).alias(o))
    inside = Window.partitionBy(b).orderBy(h, *identity)
    placed = hashed.join(F.broadcast(offsets), b)  # at most MOST_BUCKETS rows of two numbers
    return placed.withColumn(name, F.col(o) + F.row_number().over(inside) - 1).drop(h, b, o), n


def shard(df: DataFrame, shards: int, *identity: str, seed: int = 0) -> DataFrame:
    """df with shard (0 .. shards-1) and slot (gapless from 0 in each shard) of a reproducible shuffle.

    identity: the columns that tell rows apart; equal rows may swap places. Shard sizes differ by one
    row at most. Null identities count as values. An empty df gives an empty result. Columns named
    shard or slot are replaced; any other name is kept.
    """
    if shards < 1:
        raise ValueError("there is one shard or more")
    plain = df.drop("shard", "slot")
    p = free_prefix(plain.columns)
    number, place = f"{p}number", f"{p}place"
    rows, n = numbered(plain, *(F.col(f"`{c}`") for c in identity), seed=seed, name=number)
    at = feistel(F.col(number), max(n, 1), seed)
    return (
        rows.withColumn(place, at)
        .withColumn("shard", F.pmod(place, F.lit(shards)).cast("int"))
        .withColumn("slot", ((F.col(place) - F.col("shard")) / shards).cast("long"))
        .drop(place, number)
    )


def write_shards(df: DataFrame, path: str, shards: int, *identity: str, seed: int = 0) -> None:
    """Write the shuffled rows as one folder per shard, in slot order within files of a million slots at most.

    Nulls, texts of any length and repeated rows are written as they are, each row once; an empty df writes
    no shard. Columns named shard or slot are replaced. Writing again with the same rows, identity and seed
    gives the same shards and slots, so a lost executor's files are rewritten alike.
    """
    placed = shard(df, shards, *identity, seed=seed)
    placed.repartition("shard", F.floor(F.col("slot") / 1_000_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
