import re
import time
from collections import Counter

import numpy as np
import pytest
from conftest_llm import make_documents, words_of
from pyspark.sql import functions as F

from clearfield.llm.common import text_chunks
from clearfield.llm.substring import cut_repeats, remove_repeats, super_kmers


def brute(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + window]) for w in split for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return Counter(out)


def found(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in df.collect())


@pytest.mark.parametrize("hot", [0, 2, 512])
def test_against_brute_force(spark, odd_documents, odd_rows, hot):
    rows = [(i, t) for i, t, _ in odd_rows]
    assert found(remove_repeats(odd_documents, hot=hot)) == brute(rows, 35)


@pytest.mark.parametrize("hot", [1, 512])
def test_passages_copies_and_periods(spark, hot):
    passage, line = words_of(60, 1), words_of(7, 2)
    texts = [words_of(k % 50, 10 + k) + passage[k % 5 : 60 - k % 7] + words_of(k % 40, 100 + k) for k in range(40)]
    texts += [line * 30, line * 12, words_of(34, 5) + line * 6, ["same"] * 36, ["same"] * 35, words_of(35, 7), words_of(35, 7), words_of(34, 8), words_of(34, 8)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = make_documents(spark, [(i, t, "s") for i, t in rows])
    assert found(remove_repeats(docs, hot=hot)) == brute(rows, 35)


@pytest.mark.parametrize("window", [1, 2, 5, 7, 8, 9, 35, 70, 100, 150])
@pytest.mark.parametrize("hot", [1, 512])
def test_any_window(spark, window, hot):
    shared, line = words_of(260, 1, 10**6), words_of(7, 2, 10**6)
    texts = [words_of(k % 9, 50 + k, 10**6) + shared[17 * k % 40 : 260 - 13 * k % 60] + words_of(k % 5, 90 + k, 10**6) for k in range(12)]
    texts += [line * 40, line[:3] * 90, ["same"] * (window + 1), ["one"] * window, words_of(400, 3, 30), shared, []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = make_documents(spark, [(i, t, "s") for i, t in rows])
    assert found(remove_repeats(docs, window=window, hot=hot)) == brute(rows, window)


def test_bad_windows(spark, no_documents):
    for window, gram in ((0, 8), (35, 0), (35, 300)):
        with pytest.raises(ValueError):
            remove_repeats(no_documents, window=window, gram=gram)


@pytest.mark.parametrize("ids", ["one", "null"])
def test_many_equal_rows(spark, ids):
    """Rows equal in doc_id and text cost in proportion to their number."""
    text = " ".join(words_of(171, 1))
    docs = spark.range(3000).select(F.lit(7 if ids == "one" else None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    other = make_documents(spark, [(8, " ".join(words_of(20, 2) + words_of(171, 1)[10:60]), "s"), (7, " ".join(words_of(90, 5)), "s")]).select("doc_id", "text")
    t = time.monotonic()
    got = {(r.doc_id, r.n_words, r.n_removed): r.n for r in remove_repeats(docs.union(other)).groupBy("doc_id", "n_words", "n_removed").agg(F.count("*").alias("n")).collect()}
    assert got == {(7 if ids == "one" else None, 171, 171): 3000, (8, 70, 50): 1, (7, 90, 0): 1}
    assert time.monotonic() - t < 60


def test_clashing_names(spark, odd_documents, odd_rows):
    docs = odd_documents.withColumns({c: F.lit(c) for c in ("__spans", "__id", "__mark", "__kept", "__gone", "row", "low")})
    assert found(remove_repeats(docs)) == brute([(i, t) for i, t, _ in odd_rows], 35)
    assert {r["__spans"] + r["__gone"] for r in cut_repeats(docs).collect()} == {"__spans__gone"}


def test_columns_and_untouched_texts(spark, odd_documents, odd_rows):
    cut = cut_repeats(odd_documents)
    assert cut.columns == odd_documents.columns
    by = {r.doc_id: r for r in cut.collect() if r.doc_id not in (None, 18)}
    assert by[5].text is None and by[7].text == " \t\n " and by[15].text == dict((i, t) for i, t, _ in odd_rows)[15]
    assert by[10].n_chars == len(by[10].text) and len(by[10].text.split()) == 60
    assert by[12].text == ""


def test_empty_table(spark, no_documents):
    assert remove_repeats(no_documents).count() == 0


def test_super_kmers_cover_every_window():
    import pyarrow as pa

    texts = [" ".join(words_of(n, n, 50)) for n in (0, 34, 35, 36, 200, 1000)] + [None, "a " * 100]
    for lo, hi, raw, offsets in text_chunks(pa.array(texts)):
        doc, start, n, low = super_kmers(raw, offsets, 35, 8)
        assert n.max() <= 28 and len(low) == len(doc)
        for d in range(hi - lo):
            words = len((texts[lo + d] or "").split())
            covered = np.concatenate([np.arange(s, s + k) for s, k in zip(start[doc == d], n[doc == d], strict=True)]) if (doc == d).any() else np.zeros(0)
            assert covered.tolist() == list(range(max(0, words - 34)))
