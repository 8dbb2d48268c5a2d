import hashlib
import random

import public_tokenizers
import pytest
from conftest_llm import make_documents
from tokenizers import Tokenizer

from clearfield.llm.bpe import Memory, RankTree, WordBpe, encode_digests, encode_documents, merge_word

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "  ", "a", "ΑΣΣ ΟΔΥΣΣΕΥΣ ΣΑΣ Σ", "İstanbul IİıI", "x\x1cy\x1dz \x85 \xa0 ​", "école ẞ", "it's I'LL we'Re 'S", "a<|startoftext|>b <|endoftext|>",
    "<|ENDOFTEXT|>", "日本語テキスト 12345 ½ ²", "😀😀 hi👩‍👩‍👧", "ab" * 3000, "ͅᾳ", "ﬁ ﬀ Ǆ", "\x00\x01", "Å Å", "end. (x), y; #!? *%&$|) 'tis don't.", "a'b' c''d",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as f:
        return WordBpe(f.read())


def test_like_the_library(library, bpe):
    r = random.Random(4)
    parts = ["a", "B", "é", "É", "́", " ", "\n", "'s", "'", "1", "٣", "$", "<|", "|>", "Σ", "ß", "日", "😀", "\x85", "\x1f", "ǆ", "Word", "ing,"]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(400)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False)
        n, ids, decoded = bpe.encode_all(t)
        assert (n, ids) == (len(want.ids), " ".join(map(str, want.ids))), repr(t)
        assert decoded == library.decode(want.ids, skip_special_tokens=False) == bpe.decode(bpe.encode(t))


def test_tree_and_merges_against_scanning():
    r = random.Random(1)
    for _ in range(200):
        ranks = [r.randrange(20) for _ in range(r.randrange(1, 20))]
        tree = RankTree(list(ranks))
        for _ in range(10):
            k, v = r.randrange(len(ranks)), r.randrange(20)
            ranks[k] = v
            tree.put(k, v)
            low = min(range(len(ranks)), key=lambda i: (ranks[i], i))
            assert (tree.nodes[1] >> 32, tree.nodes[1] & 0xFFFFFFFF) == (ranks[low], low)
    merges, names = {}, list(range(4))
    for rank in range(30):
        pair = (r.choice(names), r.choice(names))
        if pair not in merges:
            merges[pair] = (rank, 100 + rank)
            names.append(100 + rank)
    for _ in range(300):
        word = [r.randrange(4) for _ in range(r.randrange(30))]
        plain = list(word)
        while True:
            options = [(merges[p][0], i) for i, p in enumerate(zip(plain, plain[1:], strict=False)) if p in merges]
            if not options:
                break
            _, i = min(options)
            plain[i : i + 2] = [merges[plain[i], plain[i + 1]][1]]
        assert merge_word(word, merges) == plain


def test_memory_stays_bounded():
    memory = Memory(10)
    for k in range(1000):
        memory.put(f"k{k}", k)
        assert len(memory.young) + len(memory.old) <= 20
    assert memory.get("k999") in (None, 999) and memory.get("none") is None


def test_documents(spark, library, odd_documents, odd_rows):
    got = encode_documents(odd_documents, PATH).collect()
    assert len(got) == len(odd_rows) and {"keys", "spans", "source"} <= set(got[0].asDict())
    for r in got:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert (list(r.ids), r.n_tokens) == (want, len(want)) and r.decoded == library.decode(want, skip_special_tokens=False)


def test_digests_and_empty_table(spark, library, no_documents):
    docs = make_documents(spark, [(1, ODD[5], "s"), (2, None, "s")]).select("doc_id", "text")
    got = {r.doc_id: r for r in encode_digests(docs, PATH).collect()}
    ids = library.encode(ODD[5], add_special_tokens=False).ids
    assert got[1].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got[2].n_tokens == 0 and got[2].decoded_sha256 == hashlib.sha256(b"").hexdigest() and "text" not in got[1].asDict()
    assert encode_documents(no_documents, PATH).count() == 0


def test_other_files_are_refused():
    for name in ("byte_bpe_50k.json",):
        with open(public_tokenizers.path(name), encoding="utf-8") as f, pytest.raises((ValueError, KeyError)):
            WordBpe(f.read())
