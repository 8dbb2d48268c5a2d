"""The registered queries on small odd tables: against their SQL in DuckDB, or the libraries that SQL lacks."""

import hashlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import tokenizers
from conftest_llm import make_documents, words_of

from clearfield.llm import queries

TURNS = "conv_id long, turn long, role string, text string, formatted int"


@pytest.fixture(scope="module")
def folder(spark, odd_rows, tmp_path_factory):
    """Every odd row but those without a number or with one of another row, which SQL would tell apart otherwise."""
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [r for r in odd_rows if r[0] not in (None, 18)]
    rows += [(100 + k, " ".join(words_of(60 + k, k % 3)), "abc"[k % 3]) for k in range(30)]
    rows += [(200 + k, "one common line\n  ONE common Line\t\nNew York is a city. new york was a town, " + f"and {k}\n\n", "a") for k in range(60)]
    make_documents(spark, rows).repartition(3).write.parquet(f"{at}/documents.parquet")
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 32))
    vectors = [(i, [float(x) for x in (centres[i % 5] + rng.normal(size=32) * [0.01, 0.1, 0.6][i % 3]).astype(np.float32)], i % 2) for i in range(200)]
    vectors += [(300, vectors[0][1], 0), (301, None, 0), (302, [0.0] * 32, 0), (303, vectors[0][1], None)]
    flat = rng.normal(size=(90, 64)).astype(np.float32)
    vectors += [(400 + i, [float(x) for x in flat[i % 70]], 7) for i in range(90)]
    spark.createDataFrame([(*v, "x") for v in vectors], "vec_id long, embedding array<float>, label int, weight string").write.parquet(f"{at}/embeddings.parquet")
    turns = [(c, t, ["system", "user", "assistant", "tool", None][(c + t) % 5], [None, "</s>[INST]", "\\[OUT]\\", "plain", ""][(c * t) % 5], 1) for c in range(20) for t in range(c % 6)]
    spark.createDataFrame(turns, TURNS).write.parquet(f"{at}/conversations.parquet")
    labels = [(i, i % 3 % 2, int(i % 7 == 0)) for i, _, _ in rows[::2]] + [(rows[0][0], 0, 1), (999, 0, 1), (rows[2][0], None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, folder).toPandas()
    columns = sorted(want.columns)
    assert columns == sorted(got.columns) and len(got)
    assert Counter(map(tuple, got[columns].astype(str).values.tolist())) == Counter(map(tuple, want[columns].astype(str).values.tolist()))


def documents(spark, folder):
    return {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def test_encoding_against_the_library(spark, folder):
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    library.no_truncation(), library.no_padding()
    docs = documents(spark, folder)
    got = {r.doc_id: r for r in queries.op2_bpe(spark, folder).collect()}
    assert got.keys() == docs.keys()
    for i, r in got.items():
        ids = library.encode(docs[i].text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_token_counts_against_the_library(spark, folder):
    from test_token_counts import library

    known = {v: library(f) for v, f in queries.TOKENIZERS.items()}
    toxic, poor = set(), set()
    for r in spark.read.parquet(f"{folder}/labels.parquet").collect():
        if r.toxic == 1:
            toxic.add(r.doc_id)
        if r.quality == 0:
            poor.add(r.doc_id)
    want = {}
    for i, d in documents(spark, folder).items():
        if i not in toxic:
            version = "multi" if i in poor else "byte"
            n, t = want.get((d.source, d.lang, version), (0, 0))
            want[d.source, d.lang, version] = (n + 1, t + len(known[version].encode_ordinary(d.text or "")))
    got = queries.op10_token_counts(spark, folder).collect()
    assert {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in got} == want and len({r.version for r in got}) == 2
