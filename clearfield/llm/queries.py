"""The registered queries of this subpackage, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_digests
from .chat import format_conversations, loss_text, read_back
from .clusters import cluster_vectors
from .collocations import collocations
from .common import Durable, n_words
from .embed_dedup import near_vectors
from .langid import fit_text_model, identify_pages
from .lines import remove_common_lines
from .minhash import near_duplicates
from .mixing import mix_sources
from .sharding import shard
from .spotsigs import compare_edited
from .substring import remove_repeats
from .token_counts import Ledger, count_tokens, deletes, inserts, revisions


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer file; imported here only, so that operators take paths."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents at weights 5, 2, 1, 150% of all words, each source twice at most, in training order."""
    sized = _table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    docs = Durable(spark).put("sizes", sized)
    mixed = mix_sources(docs.withColumnRenamed("size", "words"), budget=1.5, most=2.0, size="words")
    rows = mixed.select("doc_id", "source", "size", "source_size", "target", "taken", "copies", "position")
    return rows.orderBy("position", "doc_id")  # a range sort; documents that are not taken come first


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page from its text, markup, address and host; the text model is fitted on documents."""
    model = fit_text_model(_table(spark, sf_dir, "documents").select("text", "lang"))
    return identify_pages(_table(spark, sf_dir, "pages"), model)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    trap = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(trap).alias("text")
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = format_conversations(turns).select("conv_id", "valid", "formatted", "spans", read_back(F.col("formatted")).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    trained = made.withColumn("loss", loss_text(F.col("formatted"), F.col("spans")))
    return trained.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards whose row counts differ by one at most."""
    text = F.col("text").cast("binary")
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
    )
    rows = Durable(docs.sparkSession).put("rows", docs)
    return shard(rows, 24, "doc_id", "text_crc32", "size", seed=5).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every whole document and their decoded text, as digests."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs, tokenizer_path())


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    made = compare_edited(_table(spark, sf_dir, "documents"))
    return made.withColumn("edited_sha256", F.sha2("edited", 256)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"
    )


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removal of every repeated 35-word passage from all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, window=35).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents at 0.85 on five-word shingles."""
    return near_duplicates(_table(spark, sf_dir, "documents"), percent=85, words=5)


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors within each label at cosine 0.98."""
    return near_vectors(_table(spark, sf_dir, "embeddings"), least=0.98)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after an insert, a delete and a revision batch.

    All documents are counted by one tokenizer (version byte); toxic ones are deleted; those of low quality
    are counted anew by another (version multi). Each batch but the first is delivered twice.
    """
    store = Durable(spark)
    documents = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counted = store.put("counted", count_tokens(documents, {v: tokenizer_path(f) for v, f in TOKENIZERS.items()}))
    return _kept_up(spark, sf_dir, store, counted)


def ledger_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches as in op10_token_counts over counts that SQL has too: version byte in bytes, version multi in code points."""
    store = Durable(spark)
    text = F.coalesce("text", F.lit(""))
    sizes = {"byte": F.octet_length(text), "multi": F.length(text)}
    counted = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", *(c.cast("long").alias(v) for v, c in sizes.items()))
    return _kept_up(spark, sf_dir, store, store.put("counted", counted))


def _kept_up(spark: SparkSession, sf_dir: str, store: Durable, counted: DataFrame) -> DataFrame:
    """Totals after all batches; counted: doc_id, source, lang and a count a version."""

    def by(rows: DataFrame, version: str) -> DataFrame:
        return rows.select("source", "lang", F.lit(version).alias("version"), F.col(version).alias("n_tokens"))

    labels = _table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1").select("doc_id").distinct()
    poor = labels.where("quality = 0").select("doc_id").distinct().join(toxic, "doc_id", "left_anti")
    gone, again = counted.join(toxic, "doc_id", "left_semi"), counted.join(poor, "doc_id", "left_semi")
    ledger = Ledger(spark, f"{store.root}/ledger")
    ledger.commit("load", inserts(by(counted, "byte")))
    for _ in range(2):
        ledger.commit("toxic-out", deletes(by(gone, "byte")))
        ledger.commit("poor-anew", revisions(by(again, "byte"), by(again, "multi")))
    return ledger.totals()


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all vectors of 64 components around 40 centroids, after 5 rounds."""
    return cluster_vectors(_table(spark, sf_dir, "embeddings"), k=40, rounds=5, dims=64, scale=256, salt=2)


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that ten of them or more share."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_common_lines(docs, least=10, min_chars=1).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 strongest collocations of each language over all documents."""
    return collocations(_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000, percent=100)


#: Tokenizer versions of op10 and their files.
TOKENIZERS = {"byte": "byte_bpe_50k.tiktoken", "multi": "byte_bpe_multi_50k.tiktoken"}

#: Words as the operators take them: white space of ASCII only.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) END AS set
  FROM w),
n AS (SELECT doc_id, len(set) AS n FROM s),
e AS (SELECT doc_id, md5(unnest(set)) AS h FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM e a JOIN e b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS low FROM n UNION SELECT u.b, r.low FROM r JOIN u ON r.node = u.a WHERE r.low < u.b)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.low) AS component_id, n.doc_id = min(r.low) AS kept
FROM n JOIN r ON r.node = n.doc_id GROUP BY n.doc_id, n.n
"""

_OP7 = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(words) >= 35 THEN range(1, len(words) - 33) ELSE [] END) AS i, words FROM w),
v AS (SELECT doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM v WHERE h IN (SELECT h FROM v GROUP BY h HAVING count(*) > 1)),
p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS k FROM w),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
o AS (SELECT p.doc_id, count(c.k) AS n_removed, string_agg(p.word, ' ' ORDER BY p.k) FILTER (c.k IS NULL) AS kept
  FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.k = c.k GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN o ON w.doc_id = o.doc_id
"""

_OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
g AS (SELECT vec_id, label, x, sqrt(list_inner_product(x, x)) AS norm FROM v
  WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_inner_product(x, x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.x) = len(b.x) AND list_inner_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
r AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT l.b, r.low FROM r JOIN l ON r.node = l.a WHERE r.low < l.b)
SELECT v.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.low) AS component_id, v.vec_id = min(r.low) AS kept
FROM v JOIN r ON r.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id
"""

_OP4 = r"""
WITH c AS (
  SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (SELECT unnest(['</s>', '<s>', '[/INST]', '[/OUT]', '[/ROLE]', '[/SYS]', '[/TURN]', '[INST]', '[OUT]', '[ROLE]', '[SYS]']) AS mark),
s AS (SELECT conv_id, turn, role, text,
    length(replace(text, '\', '\\')) + (SELECT sum((length(text) - length(replace(text, mark, ''))) // length(mark)) FROM m) AS n,
    length(replace(role, '\', '\\')) + (SELECT sum((length(role) - length(replace(role, mark, ''))) // length(mark)) FROM m) AS k,
    CASE role WHEN 'system' THEN 3 + 5 + 10 WHEN 'user' THEN 3 + 6 + 11 WHEN 'assistant' THEN 3 + 5 + 10 ELSE 3 + 6 + 7 + 11 END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + marks + CASE WHEN role IN ('system', 'user', 'assistant') THEN 0 ELSE k END) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)*ua?') AS valid
FROM s GROUP BY conv_id
"""

_VECTORS = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(256 * x) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS c, v AS m FROM v WHERE vec_id IS NOT NULL QUALIFY c < 40)"""
_ASSIGNED = """,
a{0} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, min(d * 64 + c) % 64 AS cluster, min(d * 64 + c) // 64 AS distance FROM (
  SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM v, c{0}) GROUP BY vec_id)"""
_MOVED = """,
s{0} AS (SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{0}) GROUP BY ALL),
c{1} AS MATERIALIZED (SELECT c, coalesce(t.m, c{0}.m) AS m
  FROM c{0} LEFT JOIN (SELECT cluster, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{0} GROUP BY cluster) t ON c = cluster)"""
_OP11 = (
    _VECTORS
    + "".join(_ASSIGNED.format(i) + _MOVED.format(i, i + 1) for i in range(5))
    + _ASSIGNED.format(5)
    + """
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c5.m, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON c5.c = a5.cluster
"""
)

_LEDGER = """
WITH t AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
p AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0 AND doc_id NOT IN (SELECT doc_id FROM t WHERE doc_id IS NOT NULL)),
d AS (SELECT source, lang, coalesce(text, '') AS text, CASE WHEN doc_id IN (SELECT doc_id FROM p) THEN 'multi' ELSE 'byte' END AS version
  FROM documents WHERE coalesce(doc_id NOT IN (SELECT doc_id FROM t WHERE doc_id IS NOT NULL), true))
SELECT source, lang, version, count(*) AS n_docs, CAST(sum(CASE version WHEN 'byte' THEN strlen(text) ELSE length(text) END) AS BIGINT) AS n_tokens
FROM d GROUP BY ALL
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP12 = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM t),
k AS (SELECT *, trim({_LOWER.format("line")}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
f AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""

_OP13 = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?
-
]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS words FROM p),
g AS (SELECT lang, unnest(list_transform(range(1, len(words) + 2 - m), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase, m
  FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(words) >= m),
f AS MATERIALIZED (SELECT lang, phrase, m, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT lang, sum(n) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, phrase, m, n AS a, string_split(phrase, ' ') AS words FROM f WHERE m > 1 AND n >= 100),
i AS (SELECT lang, a, array_to_string(words[s:s + q - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - q + 2)) AS s
  FROM (SELECT *, unnest(range(2, m)) AS q FROM c))),
h AS (SELECT lang, phrase, max(a) AS held FROM i GROUP BY ALL),
k AS (SELECT c.*, unnest(range(1, m)) AS k FROM c LEFT JOIN h ON c.lang = h.lang AND c.phrase = h.phrase WHERE held IS NULL OR 100 * held < 100 * a),
s AS (SELECT k.lang, k.phrase, a, x.n AS l, y.n AS r, t.n AS n, k, (1000::HUGEINT * a * t.n) // (x.n::HUGEINT * y.n) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(k.words[1:k], ' ')
  JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(k.words[k + 1:k.m], ' ') JOIN t ON t.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b QUALIFY rank <= 2000
"""

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_bpe": op2_bpe,
    "op3_language_id": op3_language_id,
    "op4_chat": op4_chat,
    "op5_sharding": op5_sharding,
    "op6_fingerprint": op6_fingerprint,
    "op7_substring": op7_substring,
    "op8_minhash": op8_minhash,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_token_counts": op10_token_counts,
    "ledger_sizes": ledger_sizes,
    "op11_clusters": op11_clusters,
    "op12_line_dedup": op12_line_dedup,
    "op13_collocations": op13_collocations,
}
ORACLE_SQL = {
    "op4_chat": _OP4, "op7_substring": _OP7, "op8_minhash": _OP8, "op9_embedding_dedup": _OP9,
    "ledger_sizes": _LEDGER, "op11_clusters": _OP11, "op12_line_dedup": _OP12, "op13_collocations": _OP13,
}
