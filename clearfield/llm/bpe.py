"""BPE encoding and decoding with a tokenizer file: merges by a segment tree over adjacent pair ranks.

The tree's leaves are the ranks of the adjacent pairs of a word's symbols, ordered by position; its root is
the leftmost pair of lowest rank. A merge rewrites two leaves' neighbourhood and climbs to the root, so a
word of n symbols takes O(n log n) steps until no mergeable pair remains.

Nothing matches across white space, so a text is its runs of other characters, each encoded by itself. Runs and
the words in them repeat, so each Python worker remembers results in two generations of bounded size. Nothing
is dealt out: a document is encoded where it is read.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import json
import threading
import time
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import small_batches

#: Bounds of a worker's memory: runs and words in a generation, and the length up to which one is kept.
CACHED_RUNS, CACHED_WORDS, CACHED_LENGTH = 200_000, 300_000, 48
#: Rank of a pair that does not merge, and a tree's node for it.
_LAST = 1 << 28
_NONE = (_LAST, -1)
_NO_RANK = _LAST << 32
#: Marks that often end a run of letters; none is a letter, a number, white space or an apostrophe.
_END_MARKS = ".,;:!?#*%&$|)"
#: Entry of a run without words.
_NOTHING = (0, "", "")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, all others take the code points from 256 on, in order.
    """
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}


class RankTree:
    """Minimum of (rank, position) over a row of pair ranks, with point updates.

    A node is rank << 32 | position, so that the smaller number is the lower rank and, of equal ranks,
    the one further left.
    """

    __slots__ = ("size", "nodes")

    def __init__(self, ranks: list[int]):
        size = 1
        while size < len(ranks):
            size *= 2
        self.size = size
        nodes = [_NO_RANK] * size + [r << 32 | i for i, r in enumerate(ranks)]
        nodes += [_NO_RANK] * (2 * size - len(nodes))
        for i in range(size - 1, 0, -1):
            a, b = nodes[2 * i], nodes[2 * i + 1]
            nodes[i] = a if a < b else b
        self.nodes = nodes

    def put(self, at: int, rank: int) -> None:
        nodes = self.nodes
        i = self.size + at
        now = rank << 32 | at
        while True:
            nodes[i] = now
            if i < 2:
                return
            other = nodes[i ^ 1]
            if other < now:
                now = other
            i >>= 1
            if nodes[i] == now:
                return


def merge_word(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Token ids of a word from its first symbols' ids; merges: pair of ids -> (rank, merged id)."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = merges.get
    ids = symbols[:]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = RankTree([get(pair, _NONE)[0] for pair in zip(ids, ids[1:])])
    nodes, put = tree.nodes, tree.put
    while True:
        best = nodes[1]
        if best >= _NO_RANK:
            return [x for x in ids if x >= 0]
        i = best & 0xFFFFFFFF
        j = after[i]
        ids[i] = merges[ids[i], ids[j]][1]
        ids[j] = -1
        k = after[i] = after[j]
        if k < n:
            put(j, _LAST)
            before[k] = i
            put(i, get((ids[i], ids[k]), _NONE)[0])
        else:
            put(i, _LAST)
        h = before[i]
        if h >= 0:
            put(h, get((ids[h], ids[i]), _NONE)[0])


class Memory:
    """Results by key in two generations: when the young one is full, it becomes the old one."""

    __slots__ = ("size", "young", "old")

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str):
        found = self.old.get(key)
        if found is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value) -> None:
        if len(key) <= CACHED_LENGTH:
            if len(self.young) >= self.size:
                self.old, self.young = self.young, {}
            self.young[key] = value


class WordBpe:
    """The tokenizer of a file of the ``tokenizers`` library: BPE over words with an end-of-word mark.

    The file's normalisers (NFC, replacing a pattern, lower case), its splitting pattern, byte-level
    letters and special tokens hold; a file that asks for anything else is refused. White space is
    not kept by such a tokenizer, so decoding gives the tokens joined by one space, as the library does
    where a file names no decoder.
    """

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models are supported")
        if spec.get("decoder") is not None or spec.get("post_processor") is not None:
            raise ValueError("only files without decoder and post-processor are supported")
        self.vocabulary: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocabulary.items()} | {i: t for t, i in self.special.items()}
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocabulary[a], self.vocabulary[b]] = (rank, self.vocabulary[a + b])
        self.steps = [self._step(s) for s in self._flat(spec["normalizer"], "normalizers")]
        split, level = self._flat(spec["pre_tokenizer"], "pretokenizers")
        if split["type"] != "Split" or not split["invert"] or level["type"] != "ByteLevel" or level["add_prefix_space"] or level["use_regex"]:
            raise ValueError("the file splits words in a way that is not supported")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letters = byte_letters()
        self.first = [self.vocabulary[letters[b]] for b in range(256)]
        self.last = [self.vocabulary[letters[b] + self.suffix] for b in range(256)]
        kinds = [(s["type"], s.get("pattern"), s.get("content")) for s in self._flat(spec["normalizer"], "normalizers")]
        usual = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
        parts = split["pattern"]["Regex"].split("|")
        # What else the pattern matches begins with an apostrophe or is a digit.
        self.simple = kinds == usual and parts[-3:] == [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"] and all(p[0] == "'" for p in parts[:-3])
        # These separate words for str.split, but are no white space for the file's patterns.
        self.other_space = regex.compile("[\x1c-\x1f]").search
        self.known_runs, self.known_words = Memory(CACHED_RUNS), Memory(CACHED_WORDS)

    @staticmethod
    def _flat(part: dict, inner: str) -> list[dict]:
        return part[inner] if part["type"] == "Sequence" else [part]

    @staticmethod
    def _step(step: dict) -> Callable[[str], str]:
        if step["type"] == "NFC":
            return lambda s: unicodedata.normalize("NFC", s)
        if step["type"] == "Lowercase":
            return lambda s: s.replace("Σ", "σ").lower()  # each letter by itself, a final sigma too
        if step["type"] == "Replace":
            swap, content = regex.compile(step["pattern"]["Regex"]), step["content"]
            return lambda s: swap.sub(content, s)
        raise ValueError(f"normaliser {step['type']} is not supported")

    def word(self, word: str) -> list[int]:
        """Token ids of one word."""
        data = word.encode()
        return merge_word([*(self.first[b] for b in data[:-1]), self.last[data[-1]]], self.merges)

    def _entry(self, word: str) -> tuple[int, str, str]:
        memory = self.known_words
        entry = memory.young.get(word) or memory.get(word)
        if entry is None:
            ids = self.word(word)
            entry = (len(ids), " ".join(map(str, ids)), " ".join([self.tokens[i] for i in ids]))
            memory.put(word, entry)
        return entry

    @staticmethod
    def _letters(run: str) -> list[str] | None:
        """Words of a run of letters, with or without marks at its end; None for any other run.

        Says at once what normalisers and patterns would find, where the file has the usual ones.
        """
        stem = run.rstrip(_END_MARKS)
        low = stem.lower()
        if not low.isalpha() or not (stem.isascii() or ("Σ" not in stem and unicodedata.is_normalized("NFC", stem) and unicodedata.is_normalized("NFC", low))):
            return None
        return [low] if len(stem) == len(run) else [low, run[len(stem) :]]

    def _run(self, run: str) -> tuple[int, str, str]:
        """Number of tokens, ids and tokens of a piece of text without special tokens."""
        words = self._letters(run) if self.simple else None
        if words is None:
            plain = run
            for step in self.steps:
                plain = step(plain)
            words = self.words(plain)
        if len(words) == 1:
            entry = self._entry(words[0])
        elif len(words) == 2:
            (n, ids, tokens), (m, more, rest) = self._entry(words[0]), self._entry(words[1])
            entry = (n + m, f"{ids} {more}", f"{tokens} {rest}")
        elif words:
            n, ids, tokens = zip(*map(self._entry, words), strict=True)
            entry = (sum(n), " ".join(ids), " ".join(tokens))
        else:
            entry = _NOTHING
        self.known_runs.put(run, entry)
        return entry

    def forget(self) -> None:
        """Drop all remembered results."""
        self.known_runs, self.known_words = Memory(CACHED_RUNS), Memory(CACHED_WORDS)

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        yield text[at:], False

    def encode_all(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, ids joined by one space, and the decoded text."""
        got: list[tuple[int, str, str]] = []
        memory, one = self.known_runs, self._run
        for piece, special in self._pieces(text):
            if special:
                got.append((1, str(self.special[piece]), piece))
            elif self.other_space(piece):
                got.append(one(piece))
            else:
                got += [memory.young.get(run) or memory.get(run) or one(run) for run in piece.split()]
        got = [e for e in got if e[0]] if _NOTHING in got else got
        if not got:
            return 0, "", ""
        n, ids, tokens = zip(*got, strict=True)
        return sum(n), " ".join(ids), " ".join(tokens)

    def encode(self, text: str) -> list[int]:
        """Token ids of a whole text."""
        return [int(x) for x in self.encode_all(text)[1].split()]

    def decode(self, ids: list[int]) -> str:
        """Text of token ids, special tokens included; raises KeyError for an id the file does not have."""
        return " ".join(self.tokens[i] for i in ids)


@lru_cache(maxsize=4)
def _loaded(definition: str) -> WordBpe:
    return WordBpe(definition)


class _Idle:
    """Gives a worker's memory of results back to the system once it has been idle for a while.

    Spark keeps Python workers for later stages, which need the memory for other things.
    """

    SECONDS = 2.0

    def __init__(self):
        self.used = 0.0
        self.thread: threading.Thread | None = None

    def touch(self, bpe: WordBpe) -> None:
        self.used = time.monotonic()
        if self.thread is None or not self.thread.is_alive():
            self.thread = threading.Thread(target=self._wait, args=(bpe,), daemon=True)
            self.thread.start()

    def _wait(self, bpe: WordBpe) -> None:
        while time.monotonic() - self.used < self.SECONDS:
            time.sleep(self.SECONDS / 4)
        bpe.forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # not every C library has it
            ctypes.CDLL(None).malloc_trim(0)


_idle = _Idle()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, ids (token ids of the whole text) and decoded (their text).

    docs needs text; other columns are kept unless they have one of the new names. A null text counts
    as empty: no tokens and an empty decoded text. A text of any length is encoded whole, by one task;
    repeated rows are rows; an empty table gives an empty result.
    """
    return _encode(docs, path, False)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256 in place of what encode_documents adds.

    The digests are of the decimal ids joined by one space and of the decoded text, in UTF-8. A null
    text counts as empty; for the rest see ``encode_documents``.
    """
    return _encode(docs, path, True)


def _encode(docs: DataFrame, path: str, digests: bool) -> DataFrame:
    with open(path, encoding="utf-8") as f:  # a fixed file of a few MB, the same for any corpus
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    small_batches(docs.sparkSession)
    new = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    plain = docs.drop(*new)
    kept = plain.columns if not digests else [c for c in plain.columns if c != "text"]
    sent = plain.select(*kept) if "text" in kept else plain.select(*kept, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Nothing here makes cycles, and the collector would walk all that is remembered again and again.
        gc.disable()
        try:
            yield from encoded(batches)
        finally:
            gc.enable()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(definition.value)
        for batch in batches:
            texts = batch.column("text")
            n, first, second = [], [], []
            lo, weight = 0, 0

            def flush(hi: int) -> pa.RecordBatch:
                rest = [batch.column(c).slice(lo, hi - lo) for c in kept]  # noqa: B023
                kind = pa.string() if digests else pa.list_(pa.int32())
                return pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64()), pa.array(first, kind), pa.array(second, pa.string())], names=[*kept, *new])  # noqa: B023

            for i in range(batch.num_rows):
                _idle.touch(bpe)
                count, ids, text = bpe.encode_all(texts[i].as_py() or "")
                n.append(count)
                if digests:
                    first.append(hashlib.sha256(ids.encode()).hexdigest())
                    second.append(hashlib.sha256(text.encode()).hexdigest())
                else:
                    first.append([int(x) for x in ids.split()])
                    second.append(text)
                    weight += count
                    if weight > 1 << 18:  # whole documents, but not too many of them at once
                        yield flush(i + 1)
                        n, first, second, lo, weight = [], [], [], i + 1, 0
            yield flush(batch.num_rows)

    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "n_tokens long, ids array<int>, decoded string"
    return sent.mapInArrow(run, "".join(f"`{c}` {kinds[c]}, " for c in kept) + added)
