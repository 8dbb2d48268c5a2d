"""Token counts as delta-maintained rollups: signed changes update additive totals, with idempotent commits.

A ledger is a folder of batches. Each batch is a table of signed totals by (source, lang, version): an insert
counts +1 document and +n tokens, a delete the negative of what was counted, a revised count both. Totals are
the sum over committed batches, so a batch costs as much as its changes, not as the corpus.

A batch is written to a folder of its own attempt and becomes part of the ledger when a marker file is created,
whose name holds the batch and the attempt and which has no content: it is there or it is not. Of several
markers of one batch (two drivers at once) the smallest name counts, for every reader alike. A batch that is
committed again (a driver that restarts, a queue that delivers twice) therefore changes nothing, and an attempt
that died leaves files that no marker names.

Compaction writes the totals of some batches and the list of them, then creates a marker likewise; nothing is
deleted. Readers take compactions that cover most batches first, skip those that overlap one taken, and read
the batches that none covers. Markers and files go through Spark's file systems.

Counts come from tokenizer files (``count_tokens``), each of which is a version.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

KEYS = ("source", "lang", "version")
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def inserts(counts: DataFrame) -> DataFrame:
    """Signed changes for documents counted for the first time: rows source, lang, version, n_tokens.

    A null count is 0 tokens of a document that counts; repeated rows count as often as they are there; null keys are
    keys; an empty table changes nothing.
    """
    return _signed(counts, 1)


def deletes(counts: DataFrame) -> DataFrame:
    """Signed changes that take back what was counted for documents that go; nulls and repeated rows as in ``inserts``."""
    return _signed(counts, -1)


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed changes from old counts of documents to new ones (other tokens, source, language or version).

    Both need source, lang, version and n_tokens (null: 0 tokens); other columns are ignored. They need not
    have the same rows: what is only in old goes, what is only in new comes. Repeated rows count as often
    as they are there; empty tables change nothing.
    """
    return deletes(old).unionByName(inserts(new))


def _signed(counts: DataFrame, sign: int) -> DataFrame:
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.coalesce(F.col("n_tokens"), F.lit(0))).cast("long").alias("tokens"))


def rolled_up(changes: DataFrame) -> DataFrame:
    """Signed changes summed by key; null keys are keys of their own. Sums are combined before the shuffle."""
    return changes.groupBy(*KEYS).agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))


class Ledger:
    """Totals of a folder of committed batches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _markers(self, kind: str) -> dict[str, str]:
        """Attempt of each name that has a marker, the smallest where there are several."""
        top = self._path(f"{self.folder}/{kind}")
        if not self._fs.exists(top):
            return {}
        names = sorted(status.getPath().getName() for status in self._fs.listStatus(top))
        found: dict[str, str] = {}
        for name in names:
            if name[0] not in "._":
                found.setdefault(*name.split("@", 1))
        return found

    def _mark(self, kind: str, name: str, attempt: str) -> None:
        """Create the marker of an attempt: the one step that makes it count."""
        self._fs.create(self._path(f"{self.folder}/{kind}/{name}@{attempt}"), False).close()

    def _write(self, kind: str, name: str, rows: DataFrame) -> str:
        attempt = uuid.uuid4().hex
        rows.write.parquet(self._at(kind, name, attempt))
        return attempt

    def _at(self, kind: str, name: str, attempt: str) -> str:
        return f"{self.folder}/{kind}-data/{name}-{attempt}"

    @staticmethod
    def _named(name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", name) or name[0] in "._":
            raise ValueError("a batch is named by letters, digits, and _ . - inside")
        return name

    def committed(self) -> dict[str, str]:
        """Folder of each committed batch."""
        return {name: self._at("batches", name, attempt) for name, attempt in self._markers("batches").items()}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of signed changes once; False if a batch of that name is committed already."""
        if self._named(batch) in self._markers("batches"):
            return False
        attempt = self._write("batches", batch, rolled_up(changes).where("n_docs != 0 or n_tokens != 0"))
        self._mark("batches", batch, attempt)
        return self._markers("batches")[batch] == attempt

    def current(self) -> list[str]:
        """Folders whose sum is the ledger: compactions, and the batches that none of them covers."""
        covers = []
        for name, attempt in self._markers("compacted").items():
            stream = self._fs.open(self._path(f"{self._at('compacted', name, attempt)}.covers"))
            try:
                covers.append((set(bytes(stream.readAllBytes()).decode().split()), name, attempt))
            finally:
                stream.close()
        # Batches are listed after the compactions, so that none which one of them covers is missed.
        left, folders = self.committed(), []
        for cover, name, attempt in sorted(covers, key=lambda c: (-len(c[0]), c[1])):
            if cover <= left.keys():
                folders.append(self._at("compacted", name, attempt))
                left = {b: at for b, at in left.items() if b not in cover}
        return folders + [left[b] for b in sorted(left)]

    def totals(self) -> DataFrame:
        """Rows source, lang, version, n_docs, n_tokens over all committed batches; keys without documents go."""
        return self._summed(self.current())

    def _summed(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        summed = self.spark.read.schema(SCHEMA).parquet(*folders).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs != 0 or n_tokens != 0")

    def compact(self, name: str) -> bool:
        """Sum all batches committed by now into one table, under a name of its own; False if it is taken.

        Batches keep their markers, so that none is taken twice; those that come meanwhile are not covered.
        """
        if self._named(name) in self._markers("compacted"):
            return False
        batches = self.committed()
        if not batches:
            return False
        attempt = self._write("compacted", name, self._summed([batches[b] for b in sorted(batches)]))
        out = self._fs.create(self._path(f"{self._at('compacted', name, attempt)}.covers"), False)
        try:
            out.write(bytearray("\n".join(sorted(batches)).encode()))
        finally:
            out.close()
        self._mark("compacted", name, attempt)
        return self._markers("compacted")[name] == attempt


# ---------------------------------------------------------------- counts

#: How byte-level vocabularies cut a text into pieces (a fixed value of theirs).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


#: Runs of white space, as the pieces take it, of this length and more are counted apart: the pattern looks ahead from
#: such a run with a stack as deep as the run is long.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


@lru_cache(maxsize=8)
def byte_tokenizer(ranks: bytes, pieces: str = PIECES) -> tiktoken.Encoding:
    """Tokenizer of a file of lines ``token in base 64, rank``, which cuts texts into these pieces."""
    pairs = (line.split() for line in ranks.splitlines() if line.strip())
    return tiktoken.Encoding("file", pat_str=pieces, mergeable_ranks={base64.b64decode(t): int(r) for t, r in pairs}, special_tokens={})


def n_tokens(text: str, ranks: bytes) -> int:
    """Tokens of a whole text. The white space before a word is one piece but for its last character, and so is that at the end."""
    by_pieces, total, at = byte_tokenizer(ranks), 0, 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        total += len(by_pieces.encode_ordinary(text[at : run.start()]))
        total += len(byte_tokenizer(ranks, "(?s).+").encode_ordinary(text[run.start() : end]))
        at = end
    return total + len(by_pieces.encode_ordinary(text[at:]))


def count_tokens(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """docs, without text, with a column of token counts for each version: name -> path of a tokenizer file.

    docs needs text; columns with the name of a version are replaced. A null or empty text has 0 tokens;
    special tokens in texts are ordinary text; runs of white space may be of any length. All versions are counted in one pass, whole texts at a time;
    nothing is dealt out. Repeated rows stay; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    files = []
    for path in versions.values():
        with open(path, "rb") as f:  # a fixed file of a few MB, the same for any corpus
            files.append(f.read())
    shared = spark.sparkContext.broadcast(files)
    kept = [c for c in docs.columns if c != "text" and c not in versions]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[] for _ in shared.value]
            for text in batch.column("text"):
                t = text.as_py() or ""
                for n, ranks in zip(counts, shared.value, strict=True):
                    n.append(n_tokens(t, ranks))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(n, pa.int64()) for n in counts)], names=[*kept, *versions])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in kept] + [f"`{v}` long" for v in versions])
    return docs.select(*[F.col(f"`{c}`") for c in kept], "text").mapInArrow(run, schema)
