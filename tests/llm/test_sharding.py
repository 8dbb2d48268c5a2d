import math
import struct
import zlib
from collections import Counter

import pytest
import xxhash
from conftest_llm import make_documents
from pyspark.sql import functions as F

from clearfield.llm.sharding import feistel, numbered, shard, write_shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 999, 4096])
def test_permutation(spark, n):
    got = [r.p for r in spark.range(n).select(feistel(F.col("id"), n, 9).alias("p")).collect()]
    assert sorted(got) == list(range(n))
    if n > 100:
        assert sum(a == b for a, b in enumerate(got)) < 10


def test_numbers_do_not_depend_on_partitions(spark):
    df = spark.range(3000).withColumn("row_number", F.lit("mine"))
    one, n = numbered(df.repartition(5), F.col("id"))
    two, _ = numbered(df.repartition(2), F.col("id"))
    a, b = ({r.id: r["__n"] for r in x.collect()} for x in (one, two))
    assert a == b and sorted(a.values()) == list(range(3000)) and n == 3000


def test_shards(spark, odd_documents, odd_rows):
    got = shard(odd_documents, 3, "doc_id", "text").collect()
    assert len(got) == len(odd_rows) and {"keys", "spans"} <= set(got[0].asDict())
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    again = shard(odd_documents.repartition(1), 3, "doc_id", "text").collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def h64(*values, seed):
    """xxhash64 of longs and of ints (those marked by a tuple), each seeded by the one before."""
    out = 42
    for v in (*values, *seed):
        out = xxhash.xxh64_intdigest(struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v), out) if v is not None else out
    return out


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def permuted(x, n, seed):
    """The Feistel network with cycle walking, one number at a time."""
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for r in range(6):
            if r % 2:
                right = (right + signed(h64(left, seed=((seed,), (r,))))) % b
            else:
                left = (left + signed(h64(right, seed=((seed,), (r,))))) % a
        x = left * b + right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 7, 700])
def test_query_against_plain_python(spark, tmp_path, n):
    from clearfield.llm.queries import op5_sharding

    rows = [(i * 7 - 3, None if i % 11 == 5 else "é" * (i % 5) + "x" * (i % 13), "s") for i in range(n)]
    make_documents(spark, rows).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op5_sharding(spark, str(tmp_path)).collect()}
    keyed = []
    for i, t, _ in rows:
        raw = (t or "").encode()
        size, crc = len(raw) + 8, zlib.crc32(raw)
        keyed.append((i, crc, size, h64(i, crc, size, seed=((5,),))))
    bits = 0
    while 1 << bits < 16384 and (1 << bits) * 64 < n:
        bits += 1
    keyed.sort(key=lambda k: (k[3] >> (64 - bits) if bits else 0, signed(k[3]), k[:3]))
    assert len(got) == n
    for number, (i, crc, size, _) in enumerate(keyed):
        at = permuted(number, n, 5)
        r = got[i]
        assert (r.text_crc32, r["size"], r.law, r.shard, r.slot, r.grown_shard) == (crc, size, "rows", at % 24, at // 24, None)


def test_clashing_names(spark):
    rows = spark.range(50).withColumns({c: F.lit(c) for c in ("__h", "__b", "__o", "__n", "__p", "___number", "shard")})
    got = shard(rows, 3, "id").collect()
    assert {r["__h"] + r["___number"] for r in got} == {"__h___number"} and {r.shard for r in got} == {0, 1, 2}
    with pytest.raises(ValueError):
        shard(rows, 0, "id")


def test_more_shards_than_rows_and_empty(spark, no_documents):
    got = shard(make_documents(spark, [(1, "a", "s")]), 24, "doc_id").collect()
    assert [(r.slot, 0 <= r.shard < 24) for r in got] == [(0, True)]
    assert shard(no_documents, 24, "doc_id").count() == 0


def test_files(spark, tmp_path):
    df = spark.range(100)
    write_shards(df, str(tmp_path / "s"), 4, "id")
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4
