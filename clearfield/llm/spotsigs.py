"""Document fingerprints by SpotSigs: chains of content words that follow common-word anchors.

Common words are anchors. The content words that follow one, ``CHAIN`` of them or as many as there are before
the next common word, form a spot signature. The set of a text's signatures is its fingerprint. Running prose
is full of anchors; an edit changes only the chains it touches.

Short texts, lists, tables and code have few common words or none. A text of fewer than ``LEAST`` distinct chains
is filled up to about as many with pairs of neighbouring words, those of the smallest hashes; a text of more has
chains only. So a text of few chains and words takes all its pairs, and an edit, which moves the bound of the
hashes by a step, adds or drops hardly any besides those it touches: a switch at no chain at all would turn the
whole fingerprint with the first common word that comes in. A text without words takes its whole.

Fingerprints are compared by Jaccard similarity. ``near_pairs`` partitions them by set length, so that only
partitions whose lengths allow the similarity meet, and within a partition lets fingerprints meet by their
rarest signatures only (pruned Jaccard). Everything is a built-in expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Durable

#: Common words of English, German, French and Spanish (fixed values).
COMMON_WORDS = (
    "the of and to in is it that for was on are with as be by this from at or an a "
    "der die das und ist in zu den von mit nicht ein eine auf sich für auch dem des "
    "le la les et de des un une du en est que qui pour dans par sur pas au "
    "el los las y de que en un una por con para se del al no lo es su"
)
CHAIN = 3
#: Chains below which a text is filled up with pairs of words.
LEAST = 64
#: Fingerprints of a block of those that meet in a signature.
BLOCK = 256
_MARK = "\x01"


def add_signatures(df: DataFrame, text: str, into: str, chain: int = CHAIN) -> DataFrame:
    """df with an array column ``into``: the sorted distinct 64-bit spot signatures of a text column.

    Null counts as empty. Texts fold to lower case; words are runs of letters and digits of any script,
    so that marks around them do not matter. A text of any length is taken whole, in one row. Rows and their
    other columns stay as they are, repeated ones too, but for a column named ``into``; df must have no other
    that begins with it and two underscores. An empty df gives an empty result.
    """
    folded = F.lower(F.coalesce(F.col(text), F.lit("")))
    words, spots = f"{into}__w", f"{into}__s"
    common = sorted(set(COMMON_WORDS.split()))
    # Anchors become marks, so that a plain split leaves the runs of content words behind each.
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(common), F.lit(_MARK)).otherwise(w)), " ")
    runs = F.split(marked, _MARK)
    heads = F.transform(F.slice(runs, F.lit(2), F.size(runs)), lambda r: F.substring_index(F.trim(r), " ", chain))
    chains = F.array_distinct(F.filter(heads, lambda h: h != ""))
    pairs = F.array_distinct(F.transform(words, lambda w, i: F.concat_ws(" ", w, F.get(F.col(words), i + 1))))
    # Hashes, as numbers in [0, 1), below the share of pairs that is wanted.
    n = F.size(f"{into}__p")
    share = F.try_divide(F.lit(LEAST) - F.size(f"{into}__c"), n)  # a text without words has no pairs to share
    sampled = F.filter(f"{into}__p", lambda p: F.shiftrightunsigned(F.xxhash64(p, F.lit(1)), 11) / F.lit(float(1 << 53)) < F.col(f"{into}__r"))
    return (
        df.withColumn(words, F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: w != ""))
        .withColumn(f"{into}__c", chains)
        .withColumn(f"{into}__p", pairs)
        .withColumn(f"{into}__r", share)
        .withColumn(spots, F.when(n > 0, F.concat(f"{into}__c", sampled)).otherwise(F.array(folded)))
        .withColumn(into, F.array_sort(F.array_distinct(F.transform(spots, lambda s: F.xxhash64(s)))))
        .drop(words, spots, f"{into}__c", f"{into}__p", f"{into}__r")
    )


def fingerprint(signature: Column) -> Column:
    """A fingerprint as text: its signatures in order, as hexadecimal numbers joined by a dot."""
    return F.array_join(F.transform(signature, lambda s: F.lower(F.hex(s))), ".")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints' signature arrays, 0 to 1; null if either is null."""
    both = F.size(F.array_intersect(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), (both / (F.size(a) + F.size(b) - both)).cast("double"))


def followed(docs: DataFrame, rows_per_range: int = 256, most_ranges: int = 4096) -> DataFrame:
    """docs (doc_id, text) with next_text: the text of the next document by doc_id; after the last, of the first.

    Rows are cut into ranges of doc_id of about equal size; each range gets one more row, the first of
    the range after it, and is sorted by itself. Texts are dealt out once. Rows that share a doc_id
    follow each other in order of text; a null doc_id comes first.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63) + 1))
    ids = docs.select(key.alias("doc_id"))
    n = ids.count()
    if not n:
        return docs.select("doc_id", "text", F.lit(None).cast("string").alias("next_text"))
    ranges = max(1, min(most_ranges, n // rows_per_range))
    known = ids.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], 100 * ranges).alias("c"), F.max("doc_id").alias("most")).first()
    cuts = sorted(set(known["c"])) if ranges > 1 else []
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    # Cuts are ascending, so the number of those below the id is the range. Each cut is an id of its range, so
    # that only the one beyond the last may be empty.
    place = F.size(F.filter(bounds, lambda c: c < key))
    last = len(cuts) if not cuts or known["most"] > cuts[-1] else len(cuts) - 1
    dealt = docs.select("doc_id", "text").withColumn("k", key).withColumn("r", place).withColumn("head", F.lit(False))
    # The first row of each range, for the end of the range before it; of the first one, for the last.
    firsts = dealt.groupBy("r").agg(F.min(F.struct("k", F.coalesce("text", F.lit("")).alias("text"))).alias("f"))
    ends = firsts.select(F.when(F.col("r") == 0, F.lit(last)).otherwise(F.col("r") - 1).alias("r"), "f.text")
    tails = ends.select(F.lit(None).cast("long").alias("doc_id"), "text", F.lit((1 << 63) - 1).alias("k"), "r", F.lit(True).alias("head"))
    by = Window.partitionBy("r").orderBy("head", "k", F.coalesce("text", F.lit("")))
    laid = dealt.select(*tails.columns).unionByName(tails).withColumn("next_text", F.lead(F.coalesce("text", F.lit(""))).over(by))
    return laid.where(~F.col("head")).select("doc_id", "text", "next_text")


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of an edited text, and how alike they are.

    The edited text has the last half of the text's code points (rounded down) replaced by the first as
    many, or all, of the next document's. Rows: doc_id, n_chars, edited (the edited text), fingerprint,
    edited_fingerprint, near_edited, near_next, n_signatures. A table of one document follows itself;
    see ``followed`` for ties and nulls.
    """
    text = F.coalesce("text", F.lit(""))
    laid = followed(docs).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half)
    edited = laid.withColumn("edited", F.concat(kept, F.substr("next_text", F.lit(1), half)))
    for column, into in (("text", "s"), ("edited", "e"), ("next_text", "x")):
        edited = add_signatures(edited, column, into)
    return edited.select(
        "doc_id",
        "n_chars",
        "edited",
        fingerprint(F.col("s")).alias("fingerprint"),
        fingerprint(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("s"), F.col("e")).alias("near_edited"),
        likeness(F.col("s"), F.col("x")).alias("near_next"),
        F.size("s").alias("n_signatures"),
    )


def near_pairs(docs: DataFrame, least: float = 0.8, chain: int = CHAIN, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b, likeness) of distinct fingerprints with Jaccard of ``least`` or more, and no others.

    docs needs doc_id and text; null doc_ids are left out. Equal fingerprints are one class, named by its
    smallest doc_id (``classes`` has the members); pairs are between classes, a < b. Lengths are cut into
    partitions whose bounds grow by 1 / least, so that a fingerprint's partners lie in its own partition or
    the one above. Fingerprints that meet in a frequent signature are dealt out in blocks, so that such a
    signature is many tasks. A doc_id of several texts stands for each of them. An empty table has no pairs. A family of N distinct near copies has N * N / 2 pairs, which are all made.
    """
    found = classes(docs, chain).where("doc_id = class_id").select("doc_id", "s", F.size("s").alias("n")).distinct()
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(1 / least))).cast("int")
    listed = found.withColumn("part", part).select("doc_id", "n", "part", F.explode("s").alias("g"))
    often = listed.groupBy("g").agg(F.count(F.lit(1)).alias("times"))
    ordered = listed.join(often, "g").groupBy("doc_id", "n", "part").agg(F.array_sort(F.collect_list(F.struct("times", "g"))).alias("o"))
    need = F.ceil(F.col("n") * least - 1e-9).cast("int")
    met = ordered.select("doc_id", "n", "part", F.posexplode(F.slice("o", F.lit(1), F.col("n") - need + 1)).alias("at", "o")).where("o.times > 1")
    # Blocks of a signature are counted by all who have it, so that both sides of a pair agree on them.
    met = met.withColumn("g", F.col("o.g")).withColumn("blocks", F.ceil(F.col("o.times") / F.lit(block)).cast("int"))
    own, other = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    one = met.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), "g", F.col("at").alias("pa"), "part", own.alias("i"), other.alias("j"))
    low = one.withColumn("part", F.explode(F.array(F.col("part"), F.col("part") + 1)))
    two = met.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), "g", F.col("at").alias("pb"), "part", own.alias("j"), other.alias("i"))
    # What is left of both sets behind the place where they meet must be enough for the similarity.
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= F.lit(least / (1 + least)) * (F.col("na") + F.col("nb")) - F.least("pa", "pb") - 1e-9
    ahead = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    pairs = low.join(two, ["g", "part", "i", "j"]).where(ahead & (F.col("na") >= F.col("nb") * least - 1e-9) & room).select("a", "b").distinct()
    sa, sb = found.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), found.select(F.col("doc_id").alias("b"), F.col("s").alias("sb"))
    sure = pairs.join(sa, "a").join(sb, "b").withColumn("likeness", likeness(F.col("sa"), F.col("sb"))).where(F.col("likeness") >= least - 1e-12)
    return sure.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness")


def classes(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """Rows (doc_id, s, class_id) of documents with a doc_id: signatures, and the smallest doc_id with the same ones."""
    # Written: signatures are long expressions, which the filters of a join on them would repeat.
    prints = Durable(docs.sparkSession).put("prints", add_signatures(docs.where("doc_id is not null").select("doc_id", "text"), "text", "s", chain).select("doc_id", "s"))
    named = prints.groupBy("s").agg(F.min("doc_id").alias("class_id"))
    return prints.join(named, "s")
