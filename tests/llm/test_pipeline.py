import random
from collections import Counter, defaultdict

import public_tokenizers
from conftest_llm import DOCUMENTS
from test_minhash import brute as near_brute
from test_substring import brute as window_brute
from tokenizers import Tokenizer

import corpus_pipeline
from clearfield.llm.mixing import training_order

PROSE = {
    "en": ["the", "of", "and", "thing", "other", "whether", "ing", "ther"],
    "fr": ["le", "de", "les", "éeau", "queux", "ment", "oiseau", "que"],
}


def documents(spark):
    r = random.Random(8)

    def text(lang, n):
        return " ".join(r.choice(PROSE[lang]) + (str(r.choice("abcdefgh")) + r.choice("aeiou") + r.choice("lmnrst")) * r.randrange(3) for _ in range(n))

    rows = []
    for k in range(60):
        lang = ["en", "fr"][k % 2]
        rows.append((k, text(lang, 80 + k), lang, f"s{k % 4}"))
    shared = text("en", 50)
    rows += [(100 + k, text("en", 30) + " " + shared + " " + text("en", 45), "en", "s1") for k in range(3)]
    rows += [(200, rows[0][1], "en", "s2"), (201, rows[1][1].replace("le", "LE"), "fr", "s3"), (202, "12 34 !!", "en", "s0"), (203, None, "en", None), (204, "", None, "s0")]
    full = [(i, t, la, s, None if t is None else len(t)) for i, t, la, s in rows]
    return spark.createDataFrame(full, DOCUMENTS), rows


def test_stages_against_brute_force(spark, tmp_path):
    docs, rows = documents(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "near_dedup", "substring_dedup", "mixing", "encoding"]

    one = stages["language_id"](spark, docs, str(tmp_path)).cache()
    assert one.columns == docs.columns
    kept = {r.doc_id: r for r in one.collect()}
    assert set(kept) == {i for i, *_ in rows} - {202, 203, 204}
    assert all(kept[i].lang == la for i, _, la, _ in rows if i in kept)

    two = stages["near_dedup"](spark, one, str(tmp_path)).cache()
    want = near_brute(((i, r.text) for i, r in kept.items()), 80)
    assert two.columns == docs.columns and {r.doc_id for r in two.collect()} == {c for _, c in want.values()}

    three = stages["substring_dedup"](spark, two, str(tmp_path)).cache()
    cut = {i: (gone, text) for i, _, gone, text in window_brute([(r.doc_id, r.text) for r in two.collect()], 35)}
    assert three.columns == docs.columns
    for r in three.collect():
        gone, text = cut[r.doc_id]
        assert r.text == (text if gone else kept[r.doc_id].text) and r.n_chars == len(r.text)
    assert sum(gone > 0 for gone, _ in cut.values()) == 3

    four = stages["mixing"](spark, three, str(tmp_path)).cache()
    times, sizes, mixed = Counter(r.doc_id for r in four.collect()), defaultdict(int), defaultdict(int)
    assert four.columns == docs.columns and max(times.values()) <= 2
    for r in three.collect():
        sizes[r.source] += len(r.text.split())
        mixed[r.source] += len(r.text.split()) * times[r.doc_id]
    longest = max(len(r.text.split()) for r in three.collect())
    assert abs(sum(mixed.values()) - 1.5 * sum(sizes.values())) <= longest * len(sizes)
    assert {r.text for r in four.collect()} <= {r.text for r in three.collect()}

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    five = stages["encoding"](spark, four, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in three.collect()}
    assert Counter(r.doc_id for r in five) == times
    for r in five:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == ids and r.n_tokens == len(ids)

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in whole) == sorted((r.doc_id, tuple(r.ids)) for r in five)


def test_empty_corpus(spark, tmp_path):
    docs, _ = documents(spark)
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_result_is_in_training_order(spark, tmp_path):
    docs, rows = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    mixed = stages["mixing"](spark, docs.where("text <> ''"), str(tmp_path))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mixed.write.parquet(str(tmp_path / "mixed"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [r.doc_id for r in training_order(docs.where("text <> ''")).orderBy("position", "doc_id").collect()]
    # Packed by size, files are read in another order than they were written in.
    read = spark.read.parquet(str(tmp_path / "mixed"))
    got = stages["encoding"](spark, read, str(tmp_path))
    assert [r.doc_id for r in got.orderBy("place").collect()] == want
    assert got.select("place").distinct().count() == len(want) > 60
    assert len(list((tmp_path / "mixed").glob("*.parquet"))) > 1
