import random
import re
import time
import uuid

import pytest
import tiktoken
from pyspark.sql import functions as F

from clearfield.llm.common import Durable, n_words
from clearfield.llm.queries import TOKENIZERS, tokenizer_path
from clearfield.llm import token_counts
from clearfield.llm.token_counts import SCHEMA, Ledger, byte_tokenizer, count_tokens, deletes, inserts, n_tokens, revisions

ROWS = "source string, lang string, version string, n_tokens long, n_docs string"


def counts(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], ROWS)


def totals(ledger):
    return {(r.source, r.lang, r.version): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}


def ledger_of(spark, tmp_path):
    return Ledger(spark, f"file://{tmp_path}/{uuid.uuid4().hex}")


def one(spark, n):
    return inserts(counts(spark, [("a", "en", "w1", n)]))


def test_against_recount(spark, tmp_path):
    r = random.Random(3)
    ledger, live, want = ledger_of(spark, tmp_path), [], {}
    for batch in range(4):
        new = [(r.choice(["a", "b", None]), r.choice(["en", None]), "w1", r.randrange(100)) for _ in range(60)]
        gone = [live.pop(r.randrange(len(live))) for _ in range(len(live) // 3)]
        moved = [live.pop(r.randrange(len(live))) for _ in range(len(live) // 4)]
        fresh = [(s, la, "w2", n + 1) for s, la, _, n in moved]
        live += new + fresh
        changes = inserts(counts(spark, new)).unionByName(deletes(counts(spark, gone))).unionByName(revisions(counts(spark, moved), counts(spark, fresh)))
        assert ledger.commit(f"b{batch}", changes) is True
        assert ledger.commit(f"b{batch}", changes) is False
        want = {}
        for s, la, v, n in live:
            d, t = want.get((s, la, v), (0, 0))
            want[s, la, v] = (d + 1, t + n)
        assert totals(ledger) == want
    assert ledger.compact("all") and totals(ledger) == want
    assert len(ledger.current()) == 1 and ledger.compact("all") is False
    assert ledger.commit("b1", one(spark, 5)) is False and totals(ledger) == want


class Crash(Exception):
    pass


@pytest.mark.parametrize("step", ["_write", "_mark"])
@pytest.mark.parametrize("after", [False, True])
def test_crash_in_a_commit(spark, tmp_path, monkeypatch, step, after):
    ledger = ledger_of(spark, tmp_path)
    ledger.commit("one", one(spark, 5))
    real = getattr(Ledger, step)

    def crash(self, *a):
        if after:
            real(self, *a)
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(Ledger, step, crash)
        with pytest.raises(Crash):
            ledger.commit("two", one(spark, 7))
    done = step == "_mark" and after
    assert totals(ledger) == {("a", "en", "w1"): (2, 12) if done else (1, 5)}
    assert Ledger(spark, ledger.folder).commit("two", one(spark, 7)) is not done
    assert totals(ledger) == {("a", "en", "w1"): (2, 12)}


@pytest.mark.parametrize("step", ["_write", "_mark"])
@pytest.mark.parametrize("after", [False, True])
def test_crash_in_a_compaction(spark, tmp_path, monkeypatch, step, after):
    ledger = ledger_of(spark, tmp_path)
    ledger.commit("one", one(spark, 5)), ledger.commit("two", one(spark, 7))
    real = getattr(Ledger, step)

    def crash(self, *a):
        if after:
            real(self, *a)
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(Ledger, step, crash)
        with pytest.raises(Crash):
            ledger.compact("c")
    assert totals(ledger) == {("a", "en", "w1"): (2, 12)} and set(ledger.committed()) == {"one", "two"}
    assert ledger.commit("two", one(spark, 7)) is False
    ledger.compact("d")
    assert totals(ledger) == {("a", "en", "w1"): (2, 12)}


def test_commits_and_compactions_at_once(spark, tmp_path, monkeypatch):
    ledger, other = ledger_of(spark, tmp_path), None
    other = Ledger(spark, ledger.folder)
    real, seen = Ledger._write, []

    def meanwhile(self, kind, name, rows):
        at = real(self, kind, name, rows)
        if not seen:
            seen.append(name)
            assert other.commit("both", one(spark, 9))  # the same batch by another driver
            assert other.commit("late", one(spark, 100))
        return at

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_write", meanwhile)
        ledger.commit("both", one(spark, 9))
    assert totals(ledger) == {("a", "en", "w1"): (2, 109)}
    seen.clear()

    def compacting(self, kind, name, rows):
        at = real(self, kind, name, rows)
        if not seen:
            seen.append(name)
            other.commit("third", one(spark, 1000))
            other.compact("second")
        return at

    with monkeypatch.context() as m:
        m.setattr(Ledger, "_write", compacting)
        ledger.compact("first")
    assert totals(ledger) == {("a", "en", "w1"): (3, 1109)} and len(ledger.current()) == 1
    ledger.commit("fourth", one(spark, 1))
    assert totals(ledger) == {("a", "en", "w1"): (4, 1110)} and len(ledger.current()) == 2


def test_a_failed_attempt_leaves_no_trace(spark, tmp_path):
    ledger = ledger_of(spark, tmp_path)
    ledger.commit("one", one(spark, 5))
    bad = counts(spark, [("a", "en", "w1", 5)]).withColumn("n_tokens", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        ledger.commit("two", inserts(bad))
    assert totals(ledger) == {("a", "en", "w1"): (1, 5)} and list(ledger.committed()) == ["one"]
    assert ledger.commit("two", one(spark, None)) and totals(ledger) == {("a", "en", "w1"): (2, 5)}


def test_empty(spark, tmp_path):
    ledger = ledger_of(spark, tmp_path)
    assert ledger.totals().count() == 0 and ledger.totals().schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    assert ledger.compact("nothing") is False
    assert ledger.commit("none", inserts(counts(spark, []))) and ledger.totals().count() == 0
    same = counts(spark, [("a", "en", "w1", 3)])
    assert ledger.commit("undo", revisions(same, same)) and ledger.totals().count() == 0
    for name in ("", "a b", "_x", "a@b", "a/b"):
        with pytest.raises(ValueError):
            ledger.commit(name, one(spark, 1))


def library(name):
    import base64

    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counters(spark, odd_documents, odd_rows):
    got = count_tokens(odd_documents, {v: tokenizer_path(f) for v, f in TOKENIZERS.items()})
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "keys", "spans", *TOKENIZERS]
    want = [(str(i), *(len(library(f).encode_ordinary(t or "")) for f in TOKENIZERS.values())) for i, t, _ in odd_rows]
    assert sorted((str(r.doc_id), *(r[v] for v in TOKENIZERS)) for r in got.collect()) == sorted(want)
    with open(tokenizer_path(TOKENIZERS["byte"]), "rb") as f:
        assert byte_tokenizer(f.read()).encode_ordinary("<|endoftext|>") == library(TOKENIZERS["byte"]).encode_ordinary("<|endoftext|>")
    texts = [None, "", "  ", "a", " a\tb\x0bc \n", "a\xa0b", "é" * 3]
    words = spark.createDataFrame([(t,) for t in texts], "t string").select(n_words(F.col("t")).alias("w")).collect()
    assert [r.w for r in words] == [0, 0, 0, 1, 3, 1, 1]


def test_durable_tables_are_cut_and_dropped(spark):
    store = Durable(spark)
    df = store.put("t", spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().toString()
    store.drop("t", "t", "unknown")


def test_white_space_is_counted_as_the_library_does(monkeypatch):
    with open(tokenizer_path(TOKENIZERS["byte"]), "rb") as f:
        ranks = f.read()
    long = token_counts.LONG_SPACE.pattern
    monkeypatch.setattr(token_counts, "LONG_SPACE", re.compile(long.replace("1000", "2")))
    r = random.Random(4)
    spaces = [" ", " ", "\n", "\t", "\r", "\x85", "\xa0", "\u2003", "\u3000", "\x0b"]
    parts = ["word", "12", "'s", "!", "\x1c", "\u200b", "é", ""]
    for _ in range(500):
        text = "".join("".join(r.choices(spaces, k=r.randrange(6))) + r.choice(parts) for _ in range(r.randrange(8)))
        assert n_tokens(text, ranks) == len(byte_tokenizer(ranks).encode_ordinary(text)), repr(text)


def test_a_million_spaces(spark):
    texts = [" " * 1_000_000, "a" + " " * 1_000_000 + "b", "\n" * 1_000_000 + "b" + "\t " * 500_000, "x" * 1_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: r.byte for r in count_tokens(docs, {"byte": tokenizer_path(TOKENIZERS["byte"])}).collect()}
    assert time.time() - began < 60
    with open(tokenizer_path(TOKENIZERS["byte"]), "rb") as f:
        ranks = f.read()
    step = len(byte_tokenizer(ranks).encode_ordinary("a" + " " * 3001 + "b")) - len(byte_tokenizer(ranks).encode_ordinary("a" + " " * 2001 + "b"))
    assert got[1] - n_tokens("a" + " " * 2000 + "b", ranks) == step * 998  # spaces merge with a period that divides 1000
