"""From raw documents to token ids: language, near copies, repeated passages, mix of sources, encoding.

Every stage takes all columns of documents and gives them back under their names, further ones too, but for the
last, which gives ids. An empty table stays empty through all of them; texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearfield.llm.bpe import encode_documents
from clearfield.llm.common import Durable
from clearfield.llm.langid import fit_text_model, keep_known
from clearfield.llm.minhash import keep_one
from clearfield.llm.mixing import training_order
from clearfield.llm.queries import tokenizer_path
from clearfield.llm.substring import cut_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language, with the language identified.

    Null, empty and letterless texts go, and those that noise explains better than every language; a null lang
    or source is no evidence; repeated rows are kept as often as they are there. Without any labelled row
    nothing is known, and nothing stays. A tie goes to the first language by code point.
    """
    return keep_known(docs, fit_text_model(docs.select("text", "lang")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays; rows that share it are one document, the first by text. Texts
    without words are alike to nothing and stay, so do rows without a doc_id.
    """
    return keep_one(docs, percent=80, words=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 35 words and more that occur again.

    Every row stays, also one that loses all its words; a null text stays null. Repeated rows, if there are any,
    are each other's repeats.
    """
    return cut_repeats(docs, window=35)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, in training order.

    Documents without words are not taken. A null source is a source of its own, last in order; ties in
    position go by doc_id.
    """
    return training_order(docs).select(*docs.columns)


def in_written_order(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows, a selection of table's columns, with place: a long that rises in the order in which the table was written.

    Files are read packed by size, in any order, so place is the number of the file, which is that of the
    range, and of the row in it. A table that was not read from files stands in order of its partitions.
    """
    try:
        laid = table.select(*rows.columns, F.col("_metadata.file_name").alias("__name"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return rows.withColumn("place", F.monotonically_increasing_id())
    part, file = (F.regexp_extract("__name", p, 1) for p in (r"^part-(\d+)", r"-c(\d+)\."))
    number = part.cast("long") * 1024 + F.coalesce(F.when(file != "", file.cast("long")), F.lit(0))
    return laid.withColumn("place", F.shiftleft(number, 33) + F.col("__row")).drop("__name", "__row")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix, with place: its rank key in training order.

    A null or empty text has no tokens; each copy of a document is a row.
    """
    placed = in_written_order(docs.select("doc_id", "source", "lang", "text"), docs)
    return encode_documents(placed, tokenizer_path()).select("doc_id", "source", "lang", "n_tokens", "ids", "place")


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: Hashes order the mix and merges make the ids, which SQL cannot follow; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again as the next one's input."""
    store = Durable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
