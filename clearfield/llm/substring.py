"""Removal of repeated passages: exact counts of w-word windows by super-k-mer partitioning.

A window is ``window`` consecutive words of one document; every word covered by a window whose word
sequence also starts anywhere else (in the same document too) is removed. Windows are judged on the input.

Each window has a minimiser, the leftmost of its smallest ``gram``-word hashes. Consecutive windows that share
one, at the same place, form a super-k-mer, of at most window - gram + 1 windows and ``MASK_BITS``: longer runs
are cut at fixed distances from the minimiser, so that equal runs are cut alike. Equal windows have equal
minimisers, so a minimiser that occurs in one super-k-mer only cannot hold a repeated window:

1. One pass over the texts lists the super-k-mers as (minimiser, document, first word, windows), without text.
2. Super-k-mers whose minimiser occurs again are cut from the texts as one packed string each, with all its
   places in the document, and sent to the bucket of their minimiser; there, sorting all windows of the
   bucket counts them exactly.
3. A minimiser of more than ``hot`` super-k-mers (a passage that many documents share) would be too much for
   one task. Its packed strings are counted by grouped aggregation, combined before the shuffle; the windows
   of the distinct ones then travel singly, as 128 bits of the SHA-256 of their words, and are counted alike.
4. Repeated windows come back as bit masks over the super-k-mers of their document, and the kept words are joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Durable, free_prefix, gram_hashes, text_chunks, word_bounds, word_hashes

WINDOW, GRAM, HOT = 35, 8, 512
#: Windows of a super-k-mer at most: one bit each of a mask that is a signed long.
MASK_BITS = 63


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of each run of ``width`` values, by doubling."""

    def step(best: np.ndarray, by: int) -> np.ndarray:
        a, b = best[:-by], best[by:]
        return np.where(values[a] <= values[b], a, b)

    have, best = 1, np.arange(len(values))
    while have * 2 <= width:
        best, have = step(best, have), have * 2
    return step(best, width - have) if width > have else best


def super_kmers(raw: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Document, first word within it, windows and minimiser of each super-k-mer of a run of texts.

    A window shorter than ``gram`` is its own minimiser.
    """
    gram = min(gram, window)
    starts, ends, first = word_bounds(raw, offsets)
    none = np.zeros(0, np.int64)
    if len(starts) < window:
        return none, none, none, none
    grams = gram_hashes(word_hashes(raw, starts, ends), gram)
    place = _sliding_argmin(grams, window - gram + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))[: len(place)]
    at = np.flatnonzero(np.arange(len(place)) + window <= first[1:][doc])  # windows do not run over a document's end
    if not len(at):
        return none, none, none, none
    new = np.ones(len(at), bool)
    part = (place[at] - at) // MASK_BITS
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]]) | (part[1:] != part[:-1])
    heads = np.flatnonzero(new)
    head = at[heads]
    return doc[head], head - first[:-1][doc[head]], np.diff(np.append(heads, len(at))), grams[place[head]].view(np.int64)


def _list_super_kmers(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row")
            for lo, hi, raw, offsets in text_chunks(batch.column("text")):
                doc, start, n, low = super_kmers(raw, offsets, window, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low), ids.slice(lo, hi - lo).take(pa.array(doc)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))],
                    names=["low", "row", "start", "n"],
                )

    return docs.select("row", "text").mapInArrow(run, "low long, row struct<id:long,mark:long>, start int, n int")


_CUT = "low long, row struct<id:long,mark:long>, packed string, starts array<int>, hot boolean"


def _cut_super_kmers(docs: DataFrame, window: int) -> DataFrame:
    """docs: row, text, spans. One row for each distinct super-k-mer of a document, with all its places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, spans = (batch.column(c) for c in ("row", "text", "spans"))
            ends, flat = spans.offsets.to_numpy(), spans.values
            low, start, size, hot = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("low", "start", "n", "hot"))
            out: list[tuple] = []
            take: list[int] = []
            weight = 0
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                places: dict[tuple, list[int]] = {}
                for s in range(ends[i], ends[i + 1]):
                    a, n = int(start[s]), int(size[s])
                    key = (int(low[s]), b" ".join(words[a : a + n + window - 1]), bool(hot[s]))
                    places.setdefault(key, []).append(a)
                for (m, packed, is_hot), at in places.items():
                    out.append((m, packed.decode(), at, is_hot))
                    take.append(i)
                    weight += len(packed) + 400
                    if weight > 1 << 23:
                        yield _packed(rows, out, take)
                        out, take, weight = [], [], 0
            yield _packed(rows, out, take)

    return docs.select("row", "text", "spans").mapInArrow(run, _CUT)


def _packed(rows: pa.Array, out: list[tuple], take: list[int]) -> pa.RecordBatch:
    low, packed, starts, hot = zip(*out, strict=True) if out else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(low, pa.int64()), rows.take(pa.array(take, pa.int64())), pa.array(packed, pa.string()), pa.array(starts, pa.list_(pa.int32())), pa.array(hot, pa.bool_())],
        names=["low", "row", "packed", "starts", "hot"],
    )


def _windows(packed: str, window: int) -> list[str]:
    """The windows of a packed super-k-mer, in order."""
    ends = [i for i, c in enumerate(packed) if c == " "] + [len(packed)]
    begins = [0, *(e + 1 for e in ends[:-1])]
    return [packed[begins[k] : ends[k + window - 1]] for k in range(len(ends) - window + 1)]


def repeated_windows(times: dict[str, int], window: int) -> dict[str, int]:
    """For each packed string of a bucket, which occurs so many times, a bit mask of its windows that occur again."""
    if len(times) == 1:
        ((packed, n),) = times.items()
        if n > 1:
            return {packed: (1 << packed.count(" ") + 2 - window) - 1}
    seen = sorted((w, packed, k) for packed in times for k, w in enumerate(_windows(packed, window)))
    masks = dict.fromkeys(times, 0)
    lo = 0
    while lo < len(seen):
        hi = lo + 1
        while hi < len(seen) and seen[hi][0] == seen[lo][0]:
            hi += 1
        if hi - lo > 1 or times[seen[lo][1]] > 1:
            for _, packed, k in seen[lo:hi]:
                masks[packed] |= 1 << k
        lo = hi
    return masks


_FOUND = "id long, mark long, starts array<int>, mask long"


def _count_buckets(cold: DataFrame, window: int) -> DataFrame:
    """Rows (id, mark, starts, mask) of super-k-mers with repeated windows, dealt and sorted by minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close(out: list[tuple]) -> None:
            times: dict[str, int] = {}
            for _, _, _, packed, starts in held:
                times[packed] = times.get(packed, 0) + len(starts)
            masks = repeated_windows(times, window)
            out += [(i, m, starts, masks[packed]) for _, i, m, packed, starts in held if masks[packed]]
            held.clear()

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "mark", "starts", "mask"])

        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("low", "id", "mark", "packed", "starts")), strict=True):
                if held and held[0][0] != row[0]:
                    close(out)
                held.append(row)
            yield batch_of(out)
        if held:
            out = []
            close(out)
            yield batch_of(out)

    flat = cold.select("low", F.col("row.id").alias("id"), F.col("row.mark").alias("mark"), "packed", "starts")
    return flat.repartition("low").sortWithinPartitions("low").mapInArrow(run, _FOUND)


def _single_windows(kinds: DataFrame, window: int) -> DataFrame:
    """kinds: key, packed, times. Rows (key, k, h, times): each window of a packed string as a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ks, digests, many = [], [], [], []
            for key, packed, times in zip(*(batch.column(c).to_pylist() for c in ("key", "packed", "times")), strict=True):
                for k, w in enumerate(_windows(packed, window)):
                    keys.append(key), ks.append(k), many.append(times)
                    digests.append(hashlib.sha256(w.encode()).digest()[:16])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(ks, pa.int32()), pa.array(digests, pa.binary()), pa.array(many, pa.int64())], names=["key", "k", "h", "times"]
            )

    return kinds.select("key", "packed", "times").mapInArrow(run, "key string, k int, h binary, times long")


def _count_hot(hot: DataFrame, window: int, store: Durable) -> DataFrame:
    """Rows (id, mark, starts, mask) of super-k-mers of hot minimisers, by grouped counts alone."""
    keyed = hot.withColumn("key", F.sha2("packed", 256))
    kinds = keyed.groupBy("key", "packed").agg(F.sum(F.size("starts")).alias("times"))
    windows = store.put("windows", _single_windows(kinds, window))
    many = windows.groupBy("h").agg(F.sum("times").alias("n")).where("n > 1")
    # Written, so that its size is known: a small one is broadcast, beside a large one a hot key's rows can be split.
    masks = store.put("masks", windows.join(many, "h", "left_semi").groupBy("key").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask")))
    return keyed.join(masks, "key").select(F.col("row.id").alias("id"), F.col("row.mark").alias("mark"), "starts", "mask")


def _drop_words(docs: DataFrame, window: int, names: tuple[str, str, str], spanned: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column("text"), batch.column(spanned)
            sizes, gone, kept = [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                sizes.append(len(words))
                found = spans[i].as_py()
                if found:
                    first = np.concatenate([np.add.outer(s["starts"], [k for k in range(MASK_BITS) if s["mask"] >> k & 1]).ravel() for s in found])
                    edges = np.zeros(len(words) + 1, np.int32)
                    np.add.at(edges, first, 1)
                    np.subtract.at(edges, first + window, 1)
                    stays = np.flatnonzero(np.cumsum(edges)[:-1] == 0)
                    gone.append(len(words) - len(stays))
                    words = [words[k] for k in stays]
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode())
            rest = [batch.column(c) for c in batch.schema.names if c != spanned]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                names=[*(c for c in batch.schema.names if c != spanned), *names],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != spanned)
    return docs.mapInArrow(run, f"{fields}, {names[0]} long, {names[1]} long, {names[2]} string")


def repeated_spans(docs: DataFrame, store: Durable, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """Rows (id, mark, spans): where repeated windows of each row of docs begin.

    A span (starts, mask) stands for the words starts + k of each bit k of mask that is set.
    docs: row (struct of id and mark, which names a row) and text. Rows without any do not appear.
    Rows of one name are copies: each counts as a place, and they share one result, gathered as sets.
    """
    if window < 1 or not 1 <= gram <= 200:
        raise ValueError("a window has one word or more, a minimiser 1 to 200")
    listed = store.put("listed", _list_super_kmers(docs, window, gram))
    # Written, so that both sides of the join are plain exchanges and a hot minimiser's rows can be split.
    again = store.put("again", listed.groupBy("low").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    wanted = listed.join(again, "low").select("row", F.struct("low", "start", "n", (F.col("times") > hot).alias("hot")).alias("s"))
    spans = wanted.groupBy("row").agg(F.collect_set("s").alias("spans"))
    cut = store.put("cut", _cut_super_kmers(docs.join(spans, _same(docs["row"], spans["row"])).select(docs["row"], "text", "spans"), window))
    store.drop("listed", "again")

    found = _count_buckets(cut.where("not hot"), window).unionByName(_count_hot(cut.where("hot"), window, store))
    return found.groupBy("id", "mark").agg(F.collect_set(F.struct("starts", "mask")).alias("spans"))


def _same(a: Column, b: Column) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["mark"] == b["mark"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs with n_words, n_removed and kept_text (the kept words, joined by one space) for each row.

    docs needs doc_id and text; other columns are kept unless they have one of the new names, which
    then hold the new values. A null or empty text has no words. Texts of fewer than ``window`` words
    lose none; any window of one word or more is exact. Rows that are equal, or share a doc_id, count as
    separate places; a null doc_id is a place too. Equal texts of one doc_id lose all their windows, at a
    cost in proportion to their number. A text of any length is worked on whole, in one task. An empty
    table gives an empty result.
    """
    names = ("n_words", "n_removed", "kept_text")
    return _removed(docs.drop(*names), window, gram, hot, names)


def _removed(docs: DataFrame, window: int, gram: int, hot: int, names: tuple[str, str, str]) -> DataFrame:
    store = Durable(docs.sparkSession)
    mark = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    row = F.struct(F.col("doc_id").cast("long").alias("id"), mark.alias("mark"))
    spans = repeated_spans(docs.select(row.alias("row"), "text"), store, window, gram, hot)
    p = free_prefix(docs.columns)
    spans = spans.select(F.col("id").alias(f"{p}id"), F.col("mark").alias(f"{p}mark"), F.col("spans").alias(f"{p}spans"))
    joined = docs.join(spans, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{p}id")) & (mark == F.col(f"{p}mark")), "left")
    return _drop_words(joined.drop(f"{p}id", f"{p}mark"), window, names, f"{p}spans")


def cut_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns, with repeated passages cut from text, and n_chars, if it is there, brought up to date.

    Texts that lose nothing stay as they are, white space included; others become their kept words
    joined by one space. Every row stays, also one that loses all its words. A null text stays null; equal rows
    are each other's repeats and lose their passages; an empty table stays empty.
    """
    p = free_prefix(docs.columns)
    cut = _removed(docs, window, GRAM, HOT, (f"{p}words", f"{p}gone", f"{p}kept"))
    text = F.when(F.col(f"{p}gone") > 0, F.col(f"{p}kept")).otherwise(F.col("text"))
    columns = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    return cut.select(*[columns.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
