import hashlib
import math
import random
import struct

import pytest
import regex
import xxhash
from conftest_llm import make_documents, words_of
from pyspark.sql import functions as F

from clearfield.llm.spotsigs import CHAIN, COMMON_WORDS, LEAST, add_signatures, compare_edited, followed, likeness, near_pairs
from clearfield.llm.spotsigs import classes as group_of

COMMON = ["the", "of", "and", "to", "in"]


def prose(n, seed):
    r = random.Random(seed)
    return [r.choice(COMMON) if r.random() < 0.3 else w for w in words_of(n, seed, 100000)]


def test_edited_texts(spark, odd_documents, odd_rows):
    rows = sorted(odd_rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    listed = compare_edited(odd_documents).collect()
    want = []
    for k, (i, t, _) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        want.append((str(i), len(t), t[: len(t) - half] + after[:half]))
    assert sorted((str(r.doc_id), r.n_chars, r.edited) for r in listed) == sorted(want)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.fingerprint and r.edited_fingerprint for r in listed)
    got = {(r.doc_id, r.n_chars): r for r in listed}
    assert got[8, 3].fingerprint == got[9, 3].fingerprint and got[8, 3].near_next == 1.0
    assert got[5, None or 0].fingerprint == got[6, 0].fingerprint


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spots(text):
    """Signatures by their definition, in plain Python; and how many are chains."""
    folded = (text or "").lower()
    words = [w for w in regex.split(r"[^\p{L}\p{N}]+", folded) if w]
    if not words:
        return [signed(xxhash.xxh64_intdigest(folded.encode(), 42))], 0
    chains, common = [], set(COMMON_WORDS.split())
    for k, w in enumerate(words):
        if w in common:
            after = []
            for x in words[k + 1 :]:
                if x in common or len(after) == CHAIN:
                    break
                after.append(x)
            if after and " ".join(after) not in chains:
                chains.append(" ".join(after))
    pairs = list(dict.fromkeys(" ".join(words[k : k + 2]) for k in range(len(words))))
    share = (LEAST - len(chains)) / len(pairs)

    def draw(p):
        return (xxhash.xxh64_intdigest(struct.pack("<i", 1), xxhash.xxh64_intdigest(p.encode(), 42)) >> 11) / (1 << 53)

    return sorted({signed(xxhash.xxh64_intdigest(s.encode(), 42)) for s in chains + [p for p in pairs if draw(p) < share]}), len(chains)


def test_signatures_against_plain_python(spark, odd_documents, odd_rows):
    rows = [t for _, t, _ in odd_rows] + [" ".join(prose(n, n)) for n in (1, 3, 20, 150, 240, 400, 3000)] + ["The, the THE.", "und die und Das Haus", "a1 b2-c3 of_x the É é"]
    got = add_signatures(make_documents(spark, [(i, t, "s") for i, t in enumerate(rows)]), "text", "sig").collect()
    assert len(got) == len(rows)
    for r in got:
        want, chains = spots(rows[r.doc_id])
        assert r.sig == want, r.doc_id
        assert chains < LEAST or len(want) == chains  # texts of anchors enough have chains only


def test_query_against_plain_python(spark, odd_documents, tmp_path):
    from clearfield.llm.queries import op6_fingerprint

    rows = [(i, " ".join(prose(30 + 40 * (i % 9), i % 40)), "s") for i in range(0, 200, 3)] + [(300, None, "s"), (301, "", "s"), (302, "é" * 7, "t")]
    make_documents(spark, rows).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op6_fingerprint(spark, str(tmp_path)).collect()}

    def like(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b))

    def text_of(sigs):
        return ".".join(f"{s & (1 << 64) - 1:x}" for s in sigs)

    for k, (i, t, _) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        mine, other, following = (spots(x)[0] for x in (t, edited, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), text_of(mine), text_of(other))
        assert r.near_edited == pytest.approx(like(mine, other)) and r.near_next == pytest.approx(like(mine, following))
    assert len(got) == len(rows)


@pytest.mark.parametrize("size", [1, 7, 256])
def test_followers(spark, size):
    r = random.Random(size)
    ids = r.sample(range(-500, 10**6), 300)
    docs = make_documents(spark, [(i, f"t{i}", "s") for i in ids]).repartition(5)
    got = {x.doc_id: x.next_text for x in followed(docs, rows_per_range=size).collect()}
    ids.sort()
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}


def test_one_document_and_none(spark, no_documents):
    r = compare_edited(make_documents(spark, [(4, "the cat sat on the mat", "s")])).first()
    assert r.near_next == 1.0 and r.edited == "the cat sat" + "the cat sat"
    assert compare_edited(no_documents).count() == 0


def test_likeness_tells_edits_from_strangers(spark):
    rows = [(i, " ".join(prose(400, i)), "s") for i in range(30)]
    got = compare_edited(make_documents(spark, rows)).collect()
    assert min(r.near_edited for r in got) > 0.2 and max(r.near_next for r in got) < 0.05


def test_near_pairs_against_brute_force(spark):
    r = random.Random(2)
    texts = []
    for k in range(12):
        base = prose(150, k)
        for _ in range(4):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(w[: len(w) - r.randrange(30)]))
    texts += [texts[0], "", None]
    docs = make_documents(spark, [(i, t, "s") for i, t in enumerate(texts)])
    sets = {x.doc_id: tuple(x.s) for x in add_signatures(docs, "text", "s").collect()}
    classes = {}
    for i in sorted(sets):
        classes.setdefault(sets[i], i)
    named = sorted((i, frozenset(s)) for s, i in classes.items())
    want = {(a, b): len(s & t) / len(s | t) for k, (a, s) in enumerate(named) for b, t in named[k + 1 :] if len(s & t) / len(s | t) >= 0.8}
    for block in (2, 256):
        got = {(x.a, x.b): x.likeness for x in near_pairs(docs, 0.8, block=block).collect()}
        assert got == pytest.approx(want) and len(want) > 5
    members = {x.doc_id: x.class_id for x in group_of(docs).collect()}
    assert members == {i: classes[sets[i]] for i in sets}


def test_near_pairs_of_odd_documents(spark, odd_documents, no_documents):
    assert near_pairs(no_documents).count() == 0 and group_of(no_documents).count() == 0
    got = {(x.a, x.b) for x in near_pairs(odd_documents).collect()}
    assert (1, 3) in got and all(a < b for a, b in got)


def test_digest_of_query(spark, tmp_path):
    from clearfield.llm.queries import op6_fingerprint

    make_documents(spark, [(1, "ab", "s"), (2, None, "s")]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.edited_sha256 for r in op6_fingerprint(spark, str(tmp_path)).collect()}
    assert got == {1: hashlib.sha256(b"a").hexdigest(), 2: hashlib.sha256(b"").hexdigest()}


def test_one_word_apart_without_anchors(spark):
    """Texts of few common words, or none, stay alike when a word is replaced, put in (a common one too) or left out."""
    r = random.Random(11)
    rows = []
    for k in range(240):
        base = [f"v{r.randrange(10**6)}" for _ in range([40, 60, 80, 120, 300, 1000][k % 6])]
        if k % 4 == 0:
            base[r.randrange(len(base))] = "the"
        other, at = list(base), r.randrange(1, len(base) - 1)
        other[at : at + (k % 3 != 1)] = [["the"], [f"u{k}"], []][r.randrange(3)]
        rows.append((k, " ".join(base), " ".join(other)))
    pairs = spark.createDataFrame(rows, "k long, a string, b string")
    got = add_signatures(add_signatures(pairs, "a", "x"), "b", "y").select("k", likeness(F.col("x"), F.col("y")).alias("l"), F.size("x").alias("n"), F.size(F.split("a", " ")).alias("words")).collect()
    assert min(x.l for x in got) >= 0.8
    assert all(x.n >= min(x.words, LEAST) * 0.75 - 2.5 * math.sqrt(LEAST) * (x.words > LEAST) for x in got)  # a draw of about LEAST pairs


def test_signatures_do_not_rest_on_an_optimizer_rule(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "the cat sat"), (5, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {r.doc_id: r.s for r in add_signatures(df, "text", "s").collect()}
    key = "spark.sql.optimizer.excludedRules"
    spark.conf.set(key, "org.apache.spark.sql.catalyst.optimizer.CollapseProject")
    try:
        made = add_signatures(df, "text", "s")
        assert {r.doc_id: r.s for r in made.collect()} == want and all(len(s) for s in want.values())
    finally:
        spark.conf.unset(key)
