"""Line dedup against plain Python, at the threshold, and on odd rows."""

import re
from collections import defaultdict

import pytest
from conftest_llm import make_documents

from clearfield.llm.lines import remove_common_lines


def plain(rows, least, min_chars=1):
    """(doc_id, text) -> (n_lines, n_dropped, kept), one for each row; rows without number are documents of their own."""
    seen = defaultdict(set)

    def key(line):
        return re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", line).translate({c: c + 32 for c in range(65, 91)})

    for k, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            seen[key(line)].add(("row", k) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(seen[key(x)]) < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    common = ["  Subscribe NOW\t", "subscribe now", "\x0b\x0cSUBSCRIBE now\r"]
    made = [(i, "\n".join([f"own {i}", common[i % 3], "", "nine" if i < 9 else "x", "ten" if i < 10 else "y", f"again {i}", common[i % 3], f"own {i}"])) for i in range(30)]
    made += [(100, None), (101, ""), (102, "\n\n"), (103, "ten"), (104, "ten\n"), (105, "É"), (106, "é"), (107, "a\x1cten"), (108, "\x1cten"), (109, "subscribe now")]
    made += [(200, "repeated\nten")] * 12 + [(None, "nobody\nten")] * 9 + [(None, "ten\nsomebody"), (None, "nine"), (None, "nobody")]
    made.append((300, "\n".join(f"line {i}" for i in range(50000)) + "\nten\n" + "z" * 300000))
    return made


@pytest.mark.parametrize("least,min_chars", [(10, 1), (9, 4), (1, 1), (2, 1), (10, 200)])
def test_against_plain_python(spark, rows, least, min_chars):
    docs = make_documents(spark, [(i, t, "s") for i, t in rows]).repartition(5)
    assert got(remove_common_lines(docs, least, min_chars)) == sorted(plain(rows, least, min_chars), key=repr)


def test_columns_stay_and_empty_tables(spark, odd_documents, no_documents):
    made = remove_common_lines(odd_documents.withColumnRenamed("keys", "key").withColumnRenamed("spans", "__at"))
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "key", "__at", "n_lines", "n_dropped", "kept_text"]
    assert made.count() == odd_documents.count()
    assert remove_common_lines(no_documents).collect() == []
    again = remove_common_lines(made)  # columns of the new names are replaced
    assert again.columns.count("kept_text") == 1 and again.count() == made.count()


def test_a_line_of_every_document_is_dropped_everywhere(spark):
    docs = make_documents(spark, [(i, f"head\nbody {i % 7} of {i}", "s") for i in range(2000)]).repartition(7)
    assert {(r.n_dropped, r.kept_text.startswith("body")) for r in remove_common_lines(docs).collect()} == {(1, True)}


def test_refuses_thresholds_of_nothing(spark, no_documents):
    for least, chars in ((0, 1), (1, 0)):
        with pytest.raises(ValueError):
            remove_common_lines(no_documents, least, chars)
