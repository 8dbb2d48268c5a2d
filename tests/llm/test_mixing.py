import re

import pytest
from conftest_llm import make_documents, words_of
from pyspark.sql import functions as F

from clearfield.llm.mixing import CURRICULUM, Schedule, mix_sources, training_order


def targets(sizes, weights, budget, most):
    """Filling to caps by trial: share what is left by weight among the sources below their cap."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    goal, out = budget * sum(sizes.values()), dict.fromkeys(names, 0.0)
    open_ = set(names)
    while open_:
        rest = goal - sum(out[s] for s in names if s not in open_)
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= most * sizes[s]}
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        out |= {s: most * sizes[s] for s in full}
        open_ -= full
    return out


def count(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(spark, docs, rows, got=None):
    got = mix_sources(docs).collect() if got is None else got
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, count(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
    want = targets(sizes, [5, 2, 1], 1.5, 2.0)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and (r.position is None) == (r.taken == 0)
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 1
    return got


def test_against_brute_force(spark, odd_documents, odd_rows):
    check(spark, odd_documents, odd_rows)


def test_query(spark, odd_documents, odd_rows, tmp_path):
    from clearfield.llm.queries import op1_mixing

    odd_documents.write.parquet(str(tmp_path / "documents.parquet"))
    got = check(spark, None, odd_rows, op1_mixing(spark, str(tmp_path)).collect())
    again = op1_mixing(spark, str(tmp_path)).collect()
    key = sorted(map(repr, got))
    assert key == sorted(map(repr, again))
    for r in got:  # copies of a document: whole rounds, and one more where half of it is taken
        assert r.copies == r.taken // max(r["size"], 1) + (r["size"] > 0 and 2 * (r.taken % r["size"]) >= r["size"]) or r["size"] == 0


def test_internal_names_of_columns(spark, odd_documents, odd_rows):
    docs = odd_documents.withColumns({c: F.lit(c) for c in ("__w", "__src", "__nul", "__b", "__h", "__i", "__at", "__k", "___kind")})
    got = check(spark, docs, odd_rows)
    assert {r["__at"] + r["___kind"] for r in got} == {"__at___kind"}
    assert {r["__k"] for r in training_order(docs).collect()} == {"__k"}


def test_many_documents_and_reruns(spark):
    rows = [(i, " ".join(words_of(i % 37, i)), ["x", "y", "z", None, "Ü", "a"][0 if i % 3 else i % 6]) for i in range(900)]
    docs = make_documents(spark, rows)
    one = check(spark, docs.repartition(7), rows)
    two = mix_sources(docs.repartition(2)).collect()
    assert sorted(one, key=lambda r: r.doc_id) == sorted(two, key=lambda r: r.doc_id)


def test_order_follows_the_schedules(spark):
    rows = [(i, "a b c d", "abc"[i % 3]) for i in range(1200)]
    docs = make_documents(spark, rows)
    mixed = training_order(docs)
    assert mixed.columns[: len(docs.columns)] == docs.columns
    placed = [r.position for r in mixed.collect()]
    assert placed == sorted(placed)
    early = {r.source: r.n for r in mixed.where("position < 0.5").groupBy("source").agg(F.count("*").alias("n")).collect()}
    late = {r.source: r.n for r in mixed.where("position >= 0.5").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert early["a"] > late["a"] and early["c"] < late["c"] and abs(early["b"] - late["b"]) <= 2


def test_empty_table_and_no_words(spark, no_documents):
    assert mix_sources(no_documents).count() == 0
    got = mix_sources(make_documents(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert {(r.size, r.target, r.taken, r.position) for r in got} == {(0, 0.0, 0, None)}


def test_clashing_columns(spark):
    docs = make_documents(spark, [(1, "a b", "s"), (2, "c", "t")]).withColumns({"kind": F.lit("k"), "size": F.lit("s"), "position": F.lit(1)})
    got = mix_sources(docs).collect()
    assert {(r.doc_id, r["kind"], r["size"]) for r in got} == {(1, "k", 2), (2, "k", 1)}


@pytest.mark.parametrize("schedule", CURRICULUM + (Schedule(((0.0, 0.0), (0.5, 1.0), (1.0, 0.0))),))
def test_inverse_of_demand(spark, schedule):
    def demand(u):
        n, total = 4000, 0.0
        for a, b, v, w, before in schedule.pieces:
            if u >= b:
                total = before + (b - a) * (v + w) / 2
            elif u > a:
                t = u - a
                total = before + v * t + (w - v) / (b - a) * t * t / 2
        del n
        return total / schedule.integral

    shares = [k / 20 for k in range(21)]
    got = spark.createDataFrame([(s,) for s in shares], "s double").select("s", schedule.when(F.col("s")).alias("u")).collect()
    for r in got:
        assert demand(r.u) == pytest.approx(r.s, abs=1e-9)


def test_schedules_are_checked():
    for points in ((), ((0.0, 1.0),), ((0.0, 1.0), (0.5, 1.0)), ((0.0, -1.0), (1.0, 2.0)), ((0.0, 0.0), (1.0, 0.0))):
        with pytest.raises(ValueError):
            Schedule(points)
