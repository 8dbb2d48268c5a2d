"""Phrase collocations against plain Python counts; bitmaps, exact products, ranks in turns."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearfield.llm import collocations as col
from clearfield.llm.collocations import Bits, collocations
from clearfield.llm.common import Durable

SCHEMA = "doc_id long, text string, lang string, phrase int, n string, k int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, "n", 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)


def plain(rows, least, longest, top, percent):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        inside = any(lang == other and len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for (other, q), b in found.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    rows = []
    for lang, its in out.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(its)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, l, r, n[lang], -score))
    return sorted(rows)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    words = ["the", "of", "New", "new", "york", "é", "É", "ç a", "10", "-", "日本", "a", "b", "c", "d", "\x1c", "\x0e"]
    weights = [9, 7, 3, 3, 4, 2, 1, 1, 1, 1, 1, 3, 3, 3, 3, 1, 1]
    made = []
    for i in range(120):
        text = []
        for _ in range(r.randrange(80)):
            text.append(" ".join(r.choices(words, weights, k=r.randrange(1, 4))) if r.random() < 0.7 else "a b c d e f")
            text.append(r.choice([" ", " ", " ", "  ", "\t", ". ", ", ", ";", "\n", "\r\n", "\x0b", "!?"]))
        made.append(("".join(text), ["en", "fr", None, "und", "en"][i % 5]))
    made += [(None, "en"), ("", "fr"), (" \t", None), ("one", "de"), (".,;", "de"), made[0], made[0], made[0]]
    made.append((" ".join(r.choices(words, weights, k=30000)), "long"))
    return made


@pytest.mark.parametrize("least,longest,top,percent", [(20, 5, 2000, 100), (5, 3, 40, 60), (1, 2, 7, 1), (60, 6, 2000, 90)])
def test_against_plain_python(spark, rows, least, longest, top, percent):
    some = rows if least > 1 else rows[:40]
    made = collocations(table(spark, some), least, longest, top, percent)
    assert made.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, made.collect())) == plain(some, least, longest, top, percent)


def test_runs_and_ranks_in_turns_change_nothing(spark, rows, monkeypatch):
    want = plain(rows, 5, 4, 10, 100)
    monkeypatch.setattr(col, "RUN_BYTES", 500)
    monkeypatch.setattr(col, "HELD", 50)
    assert sorted(map(tuple, collocations(table(spark, rows), 5, 4, 10, ranked=1).collect())) == want


def test_crowded_bitmaps_change_nothing(spark, rows, monkeypatch):
    monkeypatch.setattr(col, "_bits_for", lambda n: 13)
    monkeypatch.setattr(col, "bucket_of", lambda h, bits: h & np.uint64(7))
    assert sorted(map(tuple, collocations(table(spark, rows), 20).collect())) == plain(rows, 20, 5, 2000, 100)


def test_pruning_counts_fewer_candidates_than_there_are_phrases(spark):
    r = random.Random(3)
    rows = [(" ".join(f"w{r.randrange(3000)}" for _ in range(400)) + " hot pair of words", "en") for _ in range(150)]
    counted = {}

    class Watched(Durable):
        def put(self, name, df):
            made = super().put(name, df)
            if name.startswith("pass"):
                counted[name] = made.where("phrase is not null").select("phrase").distinct().count()
            return made

    known, _ = col.frequent_phrases(table(spark, rows), Watched(spark), 100, 4)
    assert counted["pass1"] > 2900 and counted["pass2"] <= 6 and counted["pass3"] == 2 and counted["pass4"] == 1
    assert {x.phrase for x in known.where("words = 4").collect()} == {"hot pair of words"}


def test_products_beyond_64_bits(spark):
    """The score's expression on counts that no small table has."""
    big = 3_000_000_000_000
    row = spark.range(1).select(*(F.lit(x).cast("decimal(19,0)").alias(c) for c, x in (("a", big - 1), ("n", big), ("l", big), ("r", 1_000_000_007))))
    got = row.select(F.expr("(cast(1000 as decimal(4,0)) * a * n) div (l * r)").alias("s")).first().s
    assert got == 1000 * (big - 1) * big // (big * 1_000_000_007)


def test_empty_tables_and_nothing_frequent(spark):
    assert collocations(table(spark, [])).collect() == []
    assert collocations(table(spark, [("a b c", "en")])).collect() == []
    assert collocations(table(spark, [("a. a. a", "en")]), least=2).collect() == []


def test_bits_hold_what_was_set():
    places = np.array([0, 7, 8, 8191, 4096], dtype=np.uint64)
    flags = np.zeros(8192, bool)
    flags[places.astype(int)] = True
    bits = Bits(13, np.packbits(flags))
    assert bits.has(places).all() and bits.has(np.arange(8192, dtype=np.uint64)).sum() == 5


def test_refuses_what_it_cannot_count(spark):
    for kw in ({"least": 0}, {"longest": 1}, {"percent": 0}, {"percent": 101}):
        with pytest.raises(ValueError):
            collocations(table(spark, []), **kw)
