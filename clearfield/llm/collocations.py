"""Phrase collocations by PCY/DHP hashing: exact counts of the frequent phrases, level by level, and their scores.

Pass L over the texts counts candidate phrases of L words, and hashes those of L + 1 words into buckets:

* A phrase of L words is a candidate if its bucket reached the least count in the pass before, and both phrases of
  L - 1 words inside it are frequent (Apriori). Both tests are bitmaps, broadcast: one bit a bucket, and one bit a
  hash of a frequent phrase. A bit that is set by something else lets a phrase be counted in vain, never left out.
* Only phrases of L + 1 words whose two parts are candidates are hashed into buckets.
* Candidates are counted exactly: in the task by dictionary codes of their words, then by grouped sums over their text.

Bitmaps grow with the text up to 2^27 bits (16 MB); beyond that they prune less, and the results stay the same.
Frequent phrases are tables; cuts, containment and ranks are joins, grouped minima and windows over bounded groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Durable, gram_hashes, mix, text_chunks, word_bounds, word_hashes

LEAST, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
#: Bytes of text that a kernel looks at together.
RUN_BYTES = 1 << 21
#: Phrases hashed before their buckets are sent on; buckets of a block; most bits of a bitmap.
HELD, BLOCK, MOST_BITS = 1 << 22, 1 << 13, 27
#: Rows of a language that one task ranks.
RANKED = 40_000

_SPACE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[list(b" \t")] = True
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def language_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def phrase_hashes(words: np.ndarray, k: int, langs: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of k words; langs: hash of each word's language."""
    n = max(0, len(words) - k + 1)
    return mix(gram_hashes(words, k) ^ langs[:n]) if n else np.zeros(0, np.uint64)


class Bits:
    """A set of hashes as one bit each, by their upper or lower bits."""

    def __init__(self, bits: int, packed: np.ndarray):
        self.bits, self.packed = bits, packed

    def has(self, places: np.ndarray) -> np.ndarray:
        return (self.packed[places >> np.uint64(3)] >> (np.uint64(7) - (places & np.uint64(7))).astype(np.uint8)) & 1 == 1


def bucket_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes & np.uint64((1 << bits) - 1)


def bit_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return hashes >> np.uint64(64 - bits)


class Words:
    """Words of a run of texts: exact codes, hashes, and how many of its piece follow each, itself included."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        """langs: for each text the number of its language among ``names``, whose hashes are given apart."""
        raw = _FOLD[raw]
        ends_piece = _BREAK[raw]
        starts, ends, first = word_bounds(raw, offsets, _SPACE | _BREAK)
        n = len(starts)
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        piece = np.cumsum(ends_piece, dtype=np.int32)[starts]
        last = np.ones(n, bool)
        last[:-1] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
        stops = np.flatnonzero(last)
        self.left = np.repeat(stops, np.diff(stops, prepend=-1)) - np.arange(n) + 1 if n else np.zeros(0, np.int64)
        letters = raw[~(_SPACE | _BREAK)[raw]]
        at = np.zeros(n + 1, np.int64)
        np.cumsum(ends - starts, out=at[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(letters)])
        coded = words.dictionary_encode()
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.known: list[bytes] = coded.dictionary.to_pylist()
        known = np.frombuffer(b"".join(self.known), np.uint8)
        bounds = np.zeros(len(self.known) + 1, np.int64)
        np.cumsum([len(w) for w in self.known], out=bounds[1:])
        hashes = word_hashes(known, bounds[:-1], bounds[1:]) if n else np.zeros(0, np.uint64)
        self.hashes = hashes[self.codes]
        self.lang = langs[doc]

    def phrases(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct phrases of k words among those that begin at ``at``: a place of each, its count, and its language."""
        code = self.lang[at].astype(np.int64)
        for j in range(k):
            code = pd.factorize(code * len(self.known) + self.codes[at + j])[0]
        place = np.zeros(code.max(initial=-1) + 1, np.int64)
        place[code[::-1]] = at[::-1]
        return place, np.bincount(code, minlength=len(place)), self.lang[place]

    def texts(self, places: np.ndarray, k: int) -> list[str]:
        if k == 1:
            return [self.known[c].decode() for c in self.codes[places]]
        rows = np.stack([self.codes[places + j] for j in range(k)], axis=1).tolist()
        return [b" ".join([self.known[c] for c in row]).decode() for row in rows]


_PASS = "lang string, phrase string, n long, block int, at binary, times binary"


def _counted(lang: list[str], phrase: list[str], n: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(phrase), pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(n, pa.int64()), pa.nulls(len(phrase), pa.int32()), none, none],
        names=["lang", "phrase", "n", "block", "at", "times"],
    )


def _blocks(buckets: list[np.ndarray]) -> pa.RecordBatch:
    """Counts of buckets by block: places in the block as 16 bits each, counts as 32."""
    found, times = np.unique(np.concatenate(buckets) if buckets else np.zeros(0, np.uint32), return_counts=True)
    block = (found // BLOCK).astype(np.int32)
    heads = np.flatnonzero(np.diff(block, prepend=-1)) if len(block) else np.zeros(0, np.int64)
    bounds = [*heads.tolist(), len(block)]
    at, n = (found % BLOCK).astype(np.uint16), times.astype(np.uint32)
    parts = list(zip(bounds[:-1], bounds[1:], strict=True))
    none = pa.nulls(len(parts), pa.string())
    return pa.RecordBatch.from_arrays(
        [none, none, pa.nulls(len(parts), pa.int64()), pa.array(block[heads]), pa.array([at[a:b].tobytes() for a, b in parts], pa.binary()), pa.array([n[a:b].tobytes() for a, b in parts], pa.binary())],
        names=["lang", "phrase", "n", "block", "at", "times"],
    )


def _pass(docs: DataFrame, k: int, next_bits: int, buckets, frequent) -> DataFrame:
    """Pass k: counts of candidates, and of buckets of phrases of one word more unless next_bits is 0.

    buckets, frequent: broadcast bitmaps for phrases of k and k - 1 words, null in the first pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        weight = 0
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            names = coded.dictionary.to_pylist()
            number = coded.indices.to_numpy(zero_copy_only=False)
            of_lang = np.array([language_hash(x) for x in names], dtype=np.uint64)
            for lo, hi, raw, offsets in text_chunks(batch.column("text"), RUN_BYTES):
                words = Words(raw, offsets, number[lo:hi])
                n = len(words.codes)
                langs = of_lang[words.lang] if n else np.zeros(0, np.uint64)
                may = words.left >= k
                if k > 1:
                    at = np.flatnonzero(may)
                    shorter = phrase_hashes(words.hashes, k - 1, langs)
                    known = frequent.value.has(bit_of(shorter, frequent.value.bits))
                    at = at[known[at] & known[at + 1]]
                    at = at[buckets.value.has(bucket_of(phrase_hashes(words.hashes, k, langs)[at], buckets.value.bits))]
                    may[:] = False
                    may[at] = True
                place, times, lang = words.phrases(np.flatnonzero(may), k)
                if len(place):
                    yield _counted([names[x] for x in lang], words.texts(place, k), times)
                if next_bits:
                    longer = np.flatnonzero((words.left[:-1] > k) & may[:-1] & may[1:]) if n else np.zeros(0, np.int64)
                    if len(longer):
                        held.append(bucket_of(phrase_hashes(words.hashes, k + 1, langs)[longer], next_bits).astype(np.uint32))
                        weight += len(longer)
                if weight >= HELD:
                    yield _blocks(held)
                    held, weight = [], 0
        if held:
            yield _blocks(held)

    return docs.mapInArrow(run, _PASS)


def _reached(blocks: DataFrame, least: int, bits: int) -> Bits:
    """Which buckets hold ``least`` phrases or more: counts summed by block, a bit each to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts = -1, np.zeros(BLOCK, np.int64)

        def close() -> tuple[list[int], list[bytes]]:
            packed = np.packbits(counts >= least)
            return ([now], [packed.tobytes()]) if packed.any() else ([], [])

        for batch in batches:
            out: tuple[list[int], list[bytes]] = ([], [])
            for b, at, times in zip(*(batch.column(c).to_pylist() for c in ("block", "at", "times")), strict=True):
                if b != now:
                    for have, new in zip(out, close(), strict=True):
                        have += new
                    now = b
                    counts[:] = 0
                counts[np.frombuffer(at, np.uint16)] += np.frombuffer(times, np.uint32)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], names=["block", "bits"])
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(close(), (pa.int32(), pa.binary()), strict=True)], names=["block", "bits"])

    dealt = blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "block int, bits binary")
    return _gathered(dealt, bits)


def _gathered(rows: DataFrame, bits: int) -> Bits:
    """Rows (block, bits) as one bitmap; of 2^27 bits at most, whatever the data."""
    packed = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    for r in rows.toLocalIterator():
        part = np.frombuffer(r["bits"], np.uint8)
        packed[r["block"] * (BLOCK // 8) : r["block"] * (BLOCK // 8) + len(part)] |= part
    return Bits(bits, packed)


def _frequent_bits(phrases: DataFrame, k: int, bits: int) -> Bits:
    """A bit for the hash of each phrase of k words of a table (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column("lang").dictionary_encode()
            of_lang = np.array([language_hash(x) for x in coded.dictionary.to_pylist()], dtype=np.uint64)
            langs = of_lang[coded.indices.to_numpy(zero_copy_only=False)] if batch.num_rows else of_lang
            for lo, hi, raw, offsets in text_chunks(batch.column("phrase")):
                starts, ends, _ = word_bounds(raw, offsets)
                found = bit_of(phrase_hashes(word_hashes(raw, starts, ends), k, np.repeat(langs[lo:hi], k))[::k], bits)
                places = np.unique(found)
                block = (places // BLOCK).astype(np.int32)
                heads = np.flatnonzero(np.diff(block, prepend=-1))
                bounds = [*heads.tolist(), len(block)]
                at = (places % BLOCK).astype(np.uint16)
                parts = [at[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                ones = [np.ones(b - a, np.uint32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(block[heads]), pa.array(parts, pa.binary()), pa.array(ones, pa.binary())], names=["block", "at", "times"])

    return _reached(phrases.select("lang", "phrase").mapInArrow(run, "block int, at binary, times binary"), 1, bits)


def _bits_for(n: int) -> int:
    """Bits of a bitmap with room for n: between one block and MOST_BITS."""
    return min(MOST_BITS, max(BLOCK.bit_length() - 1, int(n).bit_length()))


def frequent_phrases(docs: DataFrame, store: Durable, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Tables (lang, phrase, words, n) of all phrases of 1 to ``longest`` words counted ``least`` times or more, and (lang, n) of all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    room = _bits_for(size // 48)  # about one bucket for eight words
    tables: list[DataFrame] = []
    totals = None
    buckets = frequent = None
    for k in range(1, longest + 1):
        next_bits = room if k < longest else 0
        name = f"pass{k}"
        found = store.put(name, _pass(texts, k, next_bits, buckets, frequent))
        exact = found.where("phrase is not null")
        if k == 1:
            totals = store.put("totals", exact.groupBy("lang").agg(F.sum("n").alias("n")))
        counts = exact.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        table = store.put(f"frequent{k}", counts.select("lang", "phrase", F.lit(k).alias("words"), "n"))
        tables.append(table)
        many = table.count() if next_bits else 0
        if next_bits and many:
            if k > 1:
                buckets.unpersist(), frequent.unpersist()
            buckets = spark.sparkContext.broadcast(_reached(found.where("block is not null").select("block", "at", "times"), least, next_bits))
            frequent = spark.sparkContext.broadcast(_frequent_bits(table, k, _bits_for(16 * many)))
        store.drop(name)
        if not many:
            break
    whole = tables[0]
    for t in tables[1:]:
        whole = whole.unionByName(t)
    return whole, totals


def _best(rows: DataFrame, top: int, store: Durable, ranked: int) -> DataFrame:
    """The first ``top`` rows of each language, with rank: in turns, no task ranks more than about ``ranked`` rows of one."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    turn = 0
    while True:
        sizes = store.put(f"sizes{turn}", rows.groupBy("lang").agg(F.count(F.lit(1)).alias("many")))
        if (sizes.agg(F.max("many")).first()[0] or 0) <= max(ranked, 4 * top):
            break
        salt = F.pmod(F.xxhash64("phrase", F.lit(turn)), F.ceil(F.col("many") / F.lit(max(ranked, 4 * top))))
        dealt = rows.join(sizes, "lang").withColumn("salt", salt).drop("many")
        place = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
        rows = store.put(f"turn{turn}", dealt.withColumn("place", place).where(F.col("place") <= top).drop("place", "salt"))
        turn += 1
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, ranked: int = RANKED) -> DataFrame:
    """Each language's ``top`` phrases by the score of their weakest cut: lang, rank, phrase, a, l, r, n, score.

    docs needs text and lang; other columns are ignored, whatever their names. A-Z are folded; texts are split at
    ``.,;:!?`` and line ends into pieces and those at spaces and tabs into words; phrases do not cross pieces. A null
    lang is ``und``; a null or empty text has no words; repeated rows count as often as they are there; a text of any
    length is worked on whole, in one task. An empty table gives an empty result, and so does one without phrases
    counted ``least`` times.

    a, l, r: occurrences of the phrase and of the two parts of its cut, n: of all words of the language; score is
    floor(1000 * a * n / (l * r)), in decimals of 38 digits. Ties of cuts go to the earliest, of phrases to the more
    frequent, then by UTF-8 bytes. Phrases inside a longer one of ``percent`` of their count or more are left out.
    """
    if least < 1 or longest < 2 or not 0 < percent <= 100:
        raise ValueError("phrases of two words or more, counted once or more, parts held to 1 to 100 percent")
    store = Durable(docs.sparkSession)
    known, totals = frequent_phrases(docs, store, least, longest)
    found = known.where("words > 1").withColumnRenamed("n", "a")

    # A phrase that holds this one reaches the share only if one with a single word more does: check those alone.
    words = F.split("phrase", " ")
    inner = F.explode(F.array(F.array_join(F.slice(words, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(words, F.lit(2), F.col("words") - 1), " ")))
    outer = found.where("words > 2").select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    alone = found.join(outer, ["lang", "phrase"], "left").where(F.col("held").isNull() | (100 * F.col("held") < percent * F.col("a"))).drop("held")

    cuts = alone.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("first", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ")).withColumn("rest", F.array_join(F.slice(words, F.col("k") + 1, F.col("words")), " "))
    left = known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "l", "r", "n")}
    priced = (
        cuts.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .join(totals, "lang")
        .select("lang", "phrase", "a", "n", "k", "l", "r", (F.lit(1000).cast("decimal(4,0)") * wide["a"] * wide["n"]).alias("up"), (wide["l"] * wide["r"]).alias("down"))
        .select("lang", "phrase", "a", "n", F.struct(F.expr("up div down").alias("score"), "k", "l", "r").alias("cut"))
    )
    weakest = priced.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    rows = store.put("scored", weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))
    return _best(rows, top, store, ranked).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
