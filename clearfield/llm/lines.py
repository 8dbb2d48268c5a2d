"""Line dedup: lines whose normalised form is found in many documents are dropped from all of them.

1. One pass over the texts lists each document's lines as (hash, document, positions): a line is stripped of white
   space, A-Z are folded, and 128 bits of BLAKE2 stand for what is left. A document lists equal lines once.
2. Grouped counts, combined before the shuffle, find the hashes of ``least`` rows or more. Only their places are
   looked at again, to count distinct documents, so a line that half of all documents share is never one group's rows.
3. The positions of common lines go back to their documents, and the lines that stay are joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Durable, free_prefix

LEAST, MIN_CHARS = 10, 1
#: Rows of a batch of places at most.
PLACES = 1 << 16


def line_key(line: bytes) -> bytes:
    """A line as it is compared: without white space of ASCII at its ends, A-Z as a-z."""
    return line.strip().lower()


def _list_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """docs: row, text. Rows (key, row, at): a line's hash, and its positions in the text of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column("row"), batch.column("text")
            keys: list[bytes] = []
            at: list[list[int]] = []
            take: list[int] = []
            for i in range(batch.num_rows):
                places: dict[bytes, list[int]] = {}
                for k, line in enumerate((texts[i].as_py() or "").encode().split(b"\n")):
                    key = line_key(line)
                    if len(key) >= min_chars and (min_chars == 1 or len(key.decode()) >= min_chars):
                        places.setdefault(hashlib.blake2b(key, digest_size=16).digest(), []).append(k)
                for key, found in places.items():
                    keys.append(key), at.append(found), take.append(i)
                    if len(keys) >= PLACES:
                        yield _places(rows, keys, at, take)
                        keys, at, take = [], [], []
            yield _places(rows, keys, at, take)

    return docs.select("row", "text").mapInArrow(run, "key binary, row struct<id:long,mark:long>, at array<int>")


def _places(rows: pa.Array, keys: list[bytes], at: list[list[int]], take: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), rows.take(pa.array(take, pa.int64())), pa.array(at, pa.list_(pa.int32()))], names=["key", "row", "at"]
    )


def _drop_lines(docs: DataFrame, names: tuple[str, str, str], dropped: str) -> DataFrame:
    """docs with number of lines, of dropped ones, and the text of the others; dropped: lists of positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column("text"), batch.column(dropped)
            sizes, gone, kept = [], [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                out = {k for part in lists[i].as_py() or () for k in part}
                sizes.append(text.count("\n") + 1)
                gone.append(len(out))
                kept.append("\n".join(x for k, x in enumerate(text.split("\n")) if k not in out) if out else text)
            rest = [c for c in batch.schema.names if c != dropped]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*rest, *names]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != dropped)
    return docs.mapInArrow(run, f"{fields}, {names[0]} long, {names[1]} long, {names[2]} string")


def remove_common_lines(docs: DataFrame, least: int = LEAST, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with n_lines, n_dropped and kept_text: lines whose key is in ``least`` documents or more are gone.

    docs needs doc_id and text; other columns are kept unless they have one of the new names, which then hold
    the new values. A text is split at line feeds; its key is the line without white space of ASCII at its ends,
    A-Z folded. Keys of fewer than ``min_chars`` code points (1: blank lines) stay everywhere. A null or empty
    text is one empty line, which stays. Lines that stay are unchanged. Rows that share a doc_id are one document
    to the count, so repeated rows make no line common by themselves; every row without a doc_id is a document
    of its own. Equal rows lose the same lines. A text of any length is worked on whole, in one task. An empty
    table gives an empty result.
    """
    if least < 1 or min_chars < 1:
        raise ValueError("a common line is in one document or more and has one character or more")
    names = ("n_lines", "n_dropped", "kept_text")
    docs = docs.drop(*names)
    store = Durable(docs.sparkSession)
    id_, mark = F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    listed = store.put("lines", _list_lines(docs.select(F.struct(id_.alias("id"), mark.alias("mark")).alias("row"), "text"), min_chars))
    # Written, so that its size is known: a small one is broadcast, beside a large one a hot line's rows can be split.
    often = store.put("often", listed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("key"))
    places = store.put("places", listed.join(often, "key", "left_semi"))
    store.drop("lines")
    documents = F.count_distinct("row.id") + F.count_if(F.col("row.id").isNull())
    common = store.put("common", places.groupBy("key").agg(documents.alias("n")).where(F.col("n") >= least).select("key"))
    dropped = places.join(common, "key", "left_semi").groupBy("row").agg(F.collect_set("at").alias("at"))
    p = free_prefix(docs.columns)
    # Merged at every size: a broadcast of a small table of lists would move texts on large inputs only.
    dropped = dropped.select(F.col("row.id").alias(f"{p}id"), F.col("row.mark").alias(f"{p}mark"), F.col("at").alias(f"{p}at")).hint("merge")
    joined = docs.join(dropped, id_.eqNullSafe(F.col(f"{p}id")) & (mark == F.col(f"{p}mark")), "left")
    return _drop_lines(joined.drop(f"{p}id", f"{p}mark"), names, f"{p}at")
