import random
import re
from collections import Counter, defaultdict

import numpy as np
from conftest_llm import make_documents, words_of

from clearfield.llm.minhash import BANDING, Sketcher, keep_one, near_duplicates


def shingles(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, both in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def family(r, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randrange(edits + 1)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_against_brute_force(spark, odd_documents, odd_rows):
    rows = [(i, t) for i, t, _ in odd_rows if i is not None]
    got = near_duplicates(odd_documents, percent=80)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    listed = got.collect()
    assert len(listed) == len(odd_rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in listed if r.doc_id is not None} == brute(dict(rows).items(), 80)
    assert [(r.component_id, r.kept) for r in listed if r.doc_id is None] == [(None, True)]


def test_crowded_family_loses_no_link(spark):
    r = random.Random(5)
    texts = family(r, words_of(150, 77, 10**6), 150, 9) + family(r, words_of(60, 78, 10**6), 60, 3)
    rows = list(enumerate(texts))
    docs = make_documents(spark, [(i, t, "s") for i, t in rows])
    assert found(near_duplicates(docs, percent=85, small=4)) == brute(rows, 85)


def test_empty_table(spark, no_documents):
    assert near_duplicates(no_documents).count() == 0
    assert keep_one(no_documents).count() == 0


def test_keep_one_keeps_columns_and_one_row(spark, odd_documents, odd_rows):
    kept = keep_one(odd_documents, percent=80)
    assert kept.columns == odd_documents.columns
    want = Counter(c for _, c in brute(((i, t) for i, t, _ in odd_rows if i is not None), 80).values())
    got = Counter(r.doc_id for r in kept.collect())
    assert got.pop(None) == 1
    assert set(got) == set(want) and set(got.values()) == {1}


def test_one_doc_id_with_two_texts(spark):
    a, b = " ".join(words_of(50, 1)), " ".join(words_of(50, 2))
    docs = make_documents(spark, [(1, a, "s"), (5, a, "s"), (5, b, "s"), (9, b, "s")])
    assert {r.component_id for r in near_duplicates(docs).collect()} == {1}


def test_densified_sketches_estimate_similarity():
    rng = np.random.default_rng(3)
    sketcher = Sketcher(BANDING)
    for size in (7, 40, 3000):
        pool = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
        sets = [np.unique(pool[:size]), np.unique(np.concatenate([pool[: int(0.95 * size)], pool[size : size + max(1, size // 20)]]))]
        one, two = sketcher.keys(sets)
        same = sketcher.keys([sets[0], sets[0].copy()])
        assert (same[0] == same[1]).all()
        assert (one == two).sum() >= 5
    other = sketcher.keys([np.unique(pool[:size]), np.unique(pool[size:])])
    assert (other[0] == other[1]).sum() == 0
