"""Language identification by Bayesian evidence fusion.

For each page or document the log posterior of a language is the sum of
  - a text likelihood: hashed byte trigrams within and at the ends of words, multinomial with a flat prior, fitted on a
    bounded sample of labelled texts, tempered because neighbouring n-grams are not independent;
  - the language the markup declares, and the language the address suggests (top-level domain, host label,
    leading path segment), each through a reliability matrix counted on the table itself;
  - a host prior, smoothed hierarchically: host towards its registered domain, domain towards the table's
    mix. Its counts are sums of text posteriors over all rows, from grouped aggregation.
A background model of letters without a language competes with the languages in the posterior: its text likelihood
is that of letters drawn alike, any claim is as likely as another under it, and ``BACKGROUND`` is its prior. So
a page of few or no letters is decided by what its markup, address and host say together, or is ``und``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Durable, small_batches, text_chunks

UNKNOWN = "und"
#: Slots of the hashed feature table, and how many independent pieces of evidence a text counts as at most.
SLOTS, MOST_EVIDENCE = 1 << 16, 64.0
#: Bound of the labelled sample: distinct texts by language. They are read where they lie; what reaches the
#: driver are sums by language and slot, so that neither copies nor long texts make it grow.
SAMPLE_TEXTS = 500
#: Weight of a text's features in the fit, in whole units, so that sums do not depend on their order.
_UNIT = 1 << 24
#: Labelled languages at most: model and plans grow with them, the table of claims with their square.
MOST_LANGUAGES = 200
#: Pseudo-counts with which a host's prior leans on its domain's, a domain's on the table's.
LEAN = 4.0
#: Prior probability that a page is in none of the languages.
BACKGROUND = 0.5

#: ISO country codes of top-level domains that suggest one of the languages (fixed values).
SUFFIX_LANGUAGE = {
    "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "fr": "fr", "de": "de", "at": "de", "es": "es",
    "mx": "es", "ar": "es", "cl": "es", "pe": "es", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl",
}


def _features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature slots in order of text, and for each text how many come before it.

    A feature is a byte trigram centred on a letter. Letters A-Z fold to lower case, white space counts as
    a space, and so does what lies beyond a text's ends; trigrams with a digit or ASCII punctuation in them
    do not count.
    """
    if not len(raw):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    folded, letter = _FOLDED[raw], _LETTER[raw]
    inner = folded != 0
    left, right = np.empty_like(folded), np.empty_like(folded)
    left[1:], right[:-1] = folded[:-1], folded[1:]
    left[0], right[-1] = 32, 32
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    left[edge], right[edge - 1] = 32, 32
    at = np.flatnonzero(letter & (left != 0) & (right != 0) & inner)
    code = (left[at] << np.uint32(16)) | (folded[at] << np.uint32(8)) | right[at]
    return (code * np.uint32(0x9E3779B1)) >> np.uint32(16), np.searchsorted(at, offsets)


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Letters as they count, white space as a space, anything else as 0.
_FOLDED = np.where(_LETTER, np.arange(256), 0).astype(np.uint32)
_FOLDED[65:91] = np.arange(97, 123)
_FOLDED[[9, 10, 11, 12, 13, 32]] = 32


@dataclass(frozen=True)
class TextModel:
    """Log likelihoods of feature slots by language; the last column is the background."""

    languages: tuple[str, ...]
    weights: np.ndarray  # (SLOTS, languages + 1)

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihood by text and language (background last), and features by text."""
        totals, counts = [], []
        for lo, hi, raw, offsets in text_chunks(column):
            slots, before = _features(raw, offsets)
            n = np.diff(before).astype(np.float64)
            sums = np.zeros((hi - lo, self.weights.shape[1]))
            some = np.flatnonzero(n)
            if len(some):
                sums[some] = np.add.reduceat(self.weights[slots], before[some], axis=0)
            scale = np.minimum(1.0, MOST_EVIDENCE / np.maximum(n, 1.0))
            totals.append(sums * scale[:, None])
            counts.append(n)
        if not totals:
            return np.zeros((0, self.weights.shape[1])), np.zeros(0)
        return np.concatenate(totals), np.concatenate(counts)


def fit_text_model(labelled: DataFrame, per_language: int = SAMPLE_TEXTS, seed: int = 3, most_languages: int = MOST_LANGUAGES) -> TextModel:
    """Fit on at most ``per_language`` distinct texts a language of rows (text, lang), those of the smallest hashes.

    Copies of a text are drawn as one, however many there are. Null or empty texts and null languages are left
    out. Every language is kept; more than ``most_languages`` are an error. Features of the drawn texts, whole
    ones, are summed by language on the executors; SLOTS numbers a language reach the driver at most.
    """
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.length("text") > 0))
    drawn = rows.select("lang", "text", F.xxhash64("text", F.lit(seed)).alias("draw"))
    known = Durable(labelled.sparkSession).put("draws", drawn.select("lang", "draw").distinct())
    totals = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(most_languages + 1).collect()}
    if len(totals) > most_languages:
        raise ValueError(f"more than {most_languages} labelled languages")
    if not totals:
        return TextModel((), np.zeros((SLOTS, 1)))
    # Draws spread evenly over all numbers, so a share of them that is four times too large holds the smallest ones;
    # only these are ranked, and no language is gathered whole. Where it held too few, the share would be doubled.
    wide, shares = 4.0, {}
    while True:
        shares = {lang: min(1.0, wide * per_language / n) for lang, n in totals.items()}
        share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
        near = known.where((F.col("draw").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64) <= share)
        least = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("r") <= per_language)
        found = {r["lang"]: r for r in least.groupBy("lang").agg(F.max("draw").alias("cut"), F.count(F.lit(1)).alias("n")).collect()}  # one row a language
        if all(shares[x] == 1.0 or (x in found and found[x]["n"] == per_language) for x in totals):
            break
        wide *= 2
    cuts = {lang: found[lang]["cut"] for lang in totals}
    bounds = F.create_map(*[F.lit(x) for pair in cuts.items() for x in pair])
    picked = drawn.where(F.col("draw") <= F.element_at(bounds, F.col("lang"))).groupBy("lang", "draw").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi, raw, offsets in text_chunks(batch.column("text")):
                slots, before = _features(raw, offsets)
                n = np.diff(before)
                # Each text counts by the square root of its features, so that a few long texts do not fill the model.
                each = np.repeat(np.round(_UNIT / np.sqrt(np.maximum(n, 1))).astype(np.int64), n)
                for lang in sorted(set(langs[lo:hi])):
                    mine = np.repeat(np.array([x == lang for x in langs[lo:hi]]), n)
                    at, inverse = np.unique(slots[mine], return_inverse=True)
                    sums = np.zeros(len(at), np.int64)
                    np.add.at(sums, inverse, each[mine])
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(sums)], names=["lang", "slot", "weight"])

    small_batches(labelled.sparkSession)
    sums = picked.mapInArrow(run, "lang string, slot int, weight long").groupBy("lang", "slot").agg(F.sum("weight").alias("weight")).toArrow()
    languages = tuple(sorted(cuts))
    numbers = {x: k for k, x in enumerate(languages)}
    counts = np.zeros((SLOTS, len(languages) + 1))
    counts[sums.column("slot").to_numpy(), [numbers[x] for x in sums.column("lang").to_pylist()]] = sums.column("weight").to_numpy()
    counts[:, :-1] /= np.maximum(counts[:, :-1].sum(axis=0), 1e-9)
    # The background has seen every slot alike; languages give a little of their mass to unseen slots.
    weights = np.log(0.9 * counts + 0.1 / SLOTS)
    weights[:, -1] = np.log(1.0 / SLOTS)
    return TextModel(languages, weights - weights[:, -1:])


# ---------------------------------------------------------------- evidence from markup and address

#: What is not text. Each ends at the page's end if not before, as browsers have it, so that every start of one
#: matches and a page is read once, however many are left open.
_TAGS = r"(?s)<(script|style)\b.*?(?:</\1\s*>|\z)|<!--.*?(?:-->|\z)|<[a-z/!?][^>]*(?:>|\z)"


def page_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags become spaces; null stays null.

    What is left open hides the rest of the page; a ``<`` before anything but a letter and the marks / ! ? is text.
    """
    bare = F.regexp_replace(html, f"(?i){_TAGS}", " ")
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(letter))
    return bare


def declared_language(html: Column) -> Column:
    """Primary subtag of the lang attribute of the first html element, lower case; null if there is none."""
    found = F.lower(F.regexp_extract(F.regexp_extract(html, r"(?i)<html\b[^>]*", 0), r"(?i)\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    """Host of an address, lower case, without port and leading www.; null if there is none."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    return F.when(found != "", found)


#: Labels under country codes below which names are registered (fixed values).
REGISTRY_LABELS = "ac co com edu go gob gouv gov gv mil ne net nom or org"
UK_LABELS = "ltd me nhs plc police sch"


def domain_of(host: Column) -> Column:
    """Registered domain of a host: its last two labels, three where the last two are a country's registry; an IP address whole."""
    registry = rf"(^|\.)(({REGISTRY_LABELS.replace(' ', '|')})\.[a-z][a-z]|({UK_LABELS.replace(' ', '|')})\.uk)$"
    address = host.rlike(r"^[0-9.]+$") | F.startswith(host, F.lit("["))
    return F.when(address, host).when(host.rlike(registry), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def address_language(url: Column, languages: tuple[str, ...]) -> Column:
    """Language that an address suggests: leading path segment or host label, else country suffix; null if none."""
    known = sorted(set(languages))
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    label = F.regexp_extract(host_of(url), r"^([a-z]{2})\.", 1)
    suffix = F.regexp_extract(host_of(url), r"\.([a-z]{2})$", 1)
    by_suffix = F.lit(None).cast("string")
    for country, lang in SUFFIX_LANGUAGE.items():
        if lang in known:
            by_suffix = F.when(suffix == country, F.lit(lang)).otherwise(by_suffix)
    return F.when(path.isin(known), path).when(label.isin(known), label).otherwise(by_suffix)


# ---------------------------------------------------------------- fusion


def text_scores(rows: DataFrame, model: TextModel, text: str = "text") -> DataFrame:
    """rows, without the text column, with ``scores`` (log likelihood by language, background last) and ``features``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # SLOTS rows of a few floats
    kept = [c for c in rows.columns if c not in (text, "scores", "features")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        width = len(model.languages) + 1
        for batch in batches:
            scores, n = model.scores(batch.column(text))
            ends = pa.array(np.arange(len(n) + 1, dtype=np.int32) * width)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.ListArray.from_arrays(ends, pa.array(scores.ravel())), pa.array(n.astype(np.int64))],
                names=[*kept, "scores", "features"],
            )

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.select(*kept, text).mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in kept) + "scores array<double>, features long")


def with_posterior(df: DataFrame, logs: Column, into: str) -> DataFrame:
    """df with an array column of probabilities from an array of logs; each step is a column, so that none is computed twice."""
    return (
        df.withColumn("__l", logs)
        .withColumn("__t", F.array_max("__l"))
        .withColumn("__e", F.transform("__l", lambda x: F.exp(x - F.col("__t"))))
        .withColumn("__z", F.aggregate("__e", F.lit(0.0), lambda a, x: a + x))
        .withColumn(into, F.transform("__e", lambda x: x / F.col("__z")))
        .drop("__l", "__t", "__e", "__z")
    )


def _counts(p: Column, size: int) -> list[Column]:
    """Sums of the first ``size`` members of an array column, as aggregates, combined before the shuffle."""
    return [F.sum(F.element_at(p, k + 1)).alias(f"c{k}") for k in range(size)]


@dataclass(frozen=True)
class Evidence:
    """What a table says about its languages: the mix, how reliable claims are, and host priors.

    mix: share of each language. claims: by column, log likelihoods (said, is). hosts: a written table
    of (__host, hc, dp): text-posterior counts of a host, and its domain's smoothed prior.
    """

    languages: tuple[str, ...]
    mix: np.ndarray
    claims: dict[str, np.ndarray]
    hosts: DataFrame | None


def _lean(counts: Column, on: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(F.arrays_zip(counts.alias("c"), on.alias("o")), lambda z: (z["c"] + LEAN * z["o"]) / (total + LEAN))


def _array(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def gather(scored: DataFrame, languages: tuple[str, ...], store: Durable) -> Evidence:
    """Evidence over all rows of a table of text_scores with columns host, declared and suggested."""
    k = len(languages)
    if not k:  # nothing was labelled, so nothing can be known
        return Evidence((), np.zeros(0), {}, None)
    rows = with_posterior(scored.where("features > 0").select("host", "declared", "suggested", "scores"), F.slice("scores", 1, k), "p")
    total = rows.agg(*_counts(F.col("p"), k)).first()
    shares = np.array([total[f"c{i}"] or 0.0 for i in range(k)]) + 1.0
    shares /= shares.sum()
    claims = {}
    for column in ("declared", "suggested"):
        seen = np.full((k, k), 0.5) + np.eye(k) * 2.0  # (said, is): a claim is taken as likelier right than wrong
        for r in rows.where(F.col(column).isin(list(languages))).groupBy(column).agg(*_counts(F.col("p"), k)).collect():  # k rows at most
            seen[languages.index(r[column])] += [r[f"c{i}"] for i in range(k)]
        claims[column] = np.log(seen / seen.sum(axis=0, keepdims=True))
    listed = F.array(*[F.col(f"c{i}") for i in range(k)])
    by_host = rows.where(F.col("host").isNotNull()).groupBy("host").agg(*_counts(F.col("p"), k)).select("host", domain_of(F.col("host")).alias("domain"), listed.alias("hc"))
    by_domain = by_host.groupBy("domain").agg(*_counts(F.col("hc"), k)).select(F.col("domain").alias("d"), listed.alias("dc"))
    priors = by_host.join(by_domain, F.col("domain") == F.col("d")).select(F.col("host").alias("__host"), "hc", _lean(F.col("dc"), _array(shares)).alias("dp"))
    # Written, so that its size is known and decides how it is joined.
    return Evidence(tuple(languages), shares, claims, store.put("hosts", priors))


def is_noise(k: int) -> Column:
    """Whether no language explains a text better than noise: the background, whose score is 0, wins."""
    return (F.col("features") == 0) | (F.array_max(F.slice("scores", 1, k)) < 0) if k else F.lit(True)


def decide(rows: DataFrame, evidence: Evidence, background: float = BACKGROUND) -> DataFrame:
    """rows with lang and confidence: the most probable language and its posterior, ``und`` where the background is.

    rows: scores and features of text_scores, and host, declared and suggested, each of which may be
    null, which is no evidence. background: its prior; at 0 it does not compete. Columns lang and
    confidence are replaced; ties go to the first language by code point, before the background.
    """
    languages, k = evidence.languages, len(evidence.languages)
    kept = [c for c in rows.columns if c not in ("lang", "confidence")]
    if not k:
        return rows.select(*kept, F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("confidence"))

    def claim(column: str) -> Column:
        said = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col(column)).cast("int")
        return F.coalesce(F.get(F.array(*[_array(x) for x in evidence.claims[column]]), said - 1), _array([0.0] * k))

    base = _array(evidence.mix)
    joined = with_posterior(rows.join(evidence.hosts, F.col("host") == F.col("__host"), "left"), F.slice("scores", 1, k), "__p")
    # A row's own text must not count twice, so its share is taken out of its host's counts.
    own = F.when(F.col("features") > 0, F.col("__p")).otherwise(_array([0.0] * k))
    rest = F.transform(F.arrays_zip(F.col("hc").alias("c"), own.alias("o")), lambda z: F.greatest(z["c"] - z["o"], F.lit(0.0)))
    joined = joined.withColumn("__rest", rest).withColumn("__sum", F.aggregate("__rest", F.lit(0.0), lambda a, x: a + x))
    leaning = F.transform(F.arrays_zip(F.col("__rest").alias("c"), F.col("dp").alias("o")), lambda z: (z["c"] + LEAN * z["o"]) / (F.col("__sum") + LEAN))
    joined = joined.withColumns({"__prior": F.coalesce(leaning, base), "__claim": claim("declared"), "__hint": claim("suggested")})
    share = math.log(1.0 - background)
    fused = F.transform(
        F.arrays_zip(F.slice("scores", 1, k).alias("s"), F.col("__prior").alias("h"), F.col("__claim").alias("d"), F.col("__hint").alias("a")),
        lambda z: z["s"] + F.ln(z["h"]) + z["d"] + z["a"] + F.lit(share),
    )
    if background:
        # Under the background a claim is any of the languages alike.
        claims = sum((F.when(F.col(c).isin(list(languages)), F.lit(-math.log(k))).otherwise(0.0) for c in ("declared", "suggested")), F.lit(math.log(background)))
        fused = F.concat(fused, F.array(claims))
    joined = with_posterior(joined, fused, "__q")
    best = F.array_position("__q", F.array_max("__q")).cast("int")
    named = F.element_at(F.array(*[F.lit(x) for x in (*languages, UNKNOWN)]), best)
    return joined.select(*kept, named.alias("lang"), F.round(F.array_max("__q"), 6).alias("confidence"))


def identify_pages(pages: DataFrame, model: TextModel) -> DataFrame:
    """One row per page: page_id, host, declared, suggested, features, lang, confidence.

    pages needs page_id, url and html; other columns are ignored. A null or empty page has no features
    and declares nothing; a null or malformed url has no host and suggests nothing. Such a page is what the
    rest of its evidence says, ``und`` where there is none. confidence is the posterior of lang, ``und``
    included. Repeated rows are rows; a page of any length is read whole, in one task; an empty table gives
    an empty result.
    """
    store = Durable(pages.sparkSession)
    rows = pages.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        declared_language(F.col("html")).alias("declared"),
        address_language(F.col("url"), model.languages).alias("suggested"),
        page_text(F.col("html")).alias("text"),
    )
    scored = store.put("scored", text_scores(rows, model))
    named = decide(scored, gather(scored, model.languages, store))
    return named.select("page_id", "host", "declared", "suggested", "features", "lang", "confidence")


def keep_known(docs: DataFrame, model: TextModel) -> DataFrame:
    """docs with lang as identified, without those in no language of the model.

    The lang column counts as declared, the source as host. What goes is ``und``: texts without a word
    of letters, null and empty ones too, and texts that noise explains better than every language: what a
    text is kept for is its own letters, whatever its source or label say. docs needs text, lang and source;
    all its columns come back under their names, repeated rows as often as they are there. Texts of any length are
    scored whole; an empty table stays empty.
    """
    store = Durable(docs.sparkSession)
    claims = {"declared": F.col("lang"), "suggested": F.lit(None).cast("string"), "host": F.col("source")}
    rows = docs.select(*[c.alias(n) for n, c in claims.items()], "text")
    evidence = gather(store.put("scored", text_scores(rows, model)), model.languages, store)
    # Columns of docs stand aside under numbers, so that none is taken for one of these.
    held = docs.select(*[c.alias(n) for n, c in claims.items()], "text", *[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)])
    # Noise goes before the decision, by scores alone: a filter on the decision would be pushed below the steps that
    # make it, and repeat them.
    named = decide(text_scores(held, model).where(~is_noise(len(model.languages))), evidence, background=0.0)
    return named.select(*[(F.col("lang") if c == "lang" else F.col(f"__{i}")).alias(c) for i, c in enumerate(docs.columns)])
