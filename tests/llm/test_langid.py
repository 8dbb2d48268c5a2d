import math
import random
import time

import pytest
from conftest_llm import make_documents
from pyspark.sql import functions as F

from clearfield.llm.langid import UNKNOWN, address_language, declared_language, domain_of, fit_text_model, host_of, identify_pages, keep_known, page_text

SOUNDS = {"en": ["th", "ing", "er", "and", "wh", "ou"], "de": ["sch", "ung", "ein", "ich", "ä", "ü"], "fr": ["eau", "qu", "é", "oi", "eux", "ment"]}


def text_of(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(text_of(lang, 60, k), lang) for lang in SOUNDS for k in range(40)] + [(None, "en"), ("x", None), ("", "de")]
    return fit_text_model(spark.createDataFrame(rows, "text string, lang string"))


def test_held_out_accuracy(spark, model):
    rows = [(k, f"http://h{k % 7}.example.com/{k}", f"<html><p>{text_of(lang, 30, 1000 + k)}</p></html>") for k, lang in enumerate(["en", "de", "fr"] * 60)]
    got = {r.page_id: r.lang for r in identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert sum(got[k] == ["en", "de", "fr"][k % 3] for k in got) >= 178


def trigrams(text):
    """Features by their definition, one byte at a time."""
    raw = [32, *text.encode(), 32]
    fold = [c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in raw]
    letter = [97 <= c <= 122 or c >= 128 for c in fold]
    good = [x or c == 32 for x, c in zip(letter, fold, strict=True)]
    out = []
    for i in range(1, len(fold) - 1):
        if letter[i] and good[i - 1] and good[i + 1]:
            code = fold[i - 1] << 16 | fold[i] << 8 | fold[i + 1]
            out.append((code * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
    return out


def scalar_posteriors(labelled, pages):
    """Every step again in plain Python: fit, text likelihoods, claims, hosts, domains, posterior."""
    langs = sorted({lang for t, lang in labelled if t and lang})
    k = len(langs)
    mass = {lang: {} for lang in langs}
    for t, lang in sorted({(t, lang) for t, lang in labelled if t and lang}):
        f = trigrams(t)
        for slot in f:
            mass[lang][slot] = mass[lang].get(slot, 0.0) + 1 / math.sqrt(len(f))
    total = {lang: sum(m.values()) for lang, m in mass.items()}
    scored = []
    for _, host, declared, suggested, text in pages:
        f = trigrams(text or "")
        scale = min(1.0, 64 / max(len(f), 1))
        scores = [scale * sum(math.log((0.9 * mass[x].get(slot, 0.0) / total[x] + 0.1 / 65536) * 65536) for slot in f) for x in langs]
        e = [math.exp(s - max(scores)) for s in scores]
        scored.append((host, declared, suggested, scores, [x / sum(e) for x in e] if f else None))
    mix = [1 + sum(p[i] for *_, p in scored if p) for i in range(k)]
    mix = [m / sum(mix) for m in mix]

    def table(which):
        seen = [[0.5 + 2.0 * (i == j) for j in range(k)] for i in range(k)]
        for row in scored:
            if row[4] and row[which] in langs:
                for j in range(k):
                    seen[langs.index(row[which])][j] += row[4][j]
        return [[math.log(seen[i][j] / sum(seen[h][j] for h in range(k))) for j in range(k)] for i in range(k)]

    said, hinted = table(1), table(2)

    def domain(host):
        return ".".join(host.split(".")[-2:])

    out = []
    for n, (host, declared, suggested, scores, p) in enumerate(scored):
        known = [r for r in scored if r[0] == host and r[4]]
        if host and known:
            wide = [sum(r[4][j] for r in scored if r[0] and r[4] and domain(r[0]) == domain(host)) for j in range(k)]
            lean = [(w + 4 * m) / (sum(wide) + 4) for w, m in zip(wide, mix, strict=True)]
            mine = [max(0.0, sum(r[4][j] for r in known) - (p[j] if p else 0.0)) for j in range(k)]
            prior = [(m + 4 * x) / (sum(mine) + 4) for m, x in zip(mine, lean, strict=True)]
        else:
            prior = mix
        logs = [scores[j] + math.log(prior[j]) + math.log(0.5) for j in range(k)] + [math.log(0.5)]
        for claim, matrix in ((declared, said), (suggested, hinted)):
            if claim in langs:
                logs = [x + y for x, y in zip(logs, [*matrix[langs.index(claim)], -math.log(k)], strict=True)]
        e = [math.exp(x - max(logs)) for x in logs]
        best = max(range(k + 1), key=lambda j: (e[j], -j))
        out.append((pages[n][0], ([*langs, UNKNOWN])[best], e[best] / sum(e)))
    return out


def test_posteriors_against_plain_python(spark):
    """Texts of one language, of two mixed, of noise, of a few letters and of none, with claims that agree or do not."""
    r = random.Random(7)
    labelled = [(text_of(lang, 40, k), lang) for lang in SOUNDS for k in range(20)]
    labelled += [labelled[0]] * 50 + [(None, "en"), ("", "de"), ("x", None)]
    rows = []
    for n in range(150):
        lang = ["en", "de", "fr"][n % 3]
        other = r.choice(["en", "de", "fr", None, "xx"])
        text = [text_of(lang, 20, n), text_of(lang, 2, n), "12 34", "", None, "zz", "qxj kvw zzq " * 9, text_of(lang, 4, n) + " " + text_of("en", 4, -n)][r.randrange(8)]
        declared = r.choice([lang, lang, other])
        host = r.choice([f"{lang}.a.net", f"b{n % 4}.{lang}x.org", "mixed.com", None])
        path = r.choice(["", "/" + lang + "/x", "/q"])
        rows.append((n, None if host is None else f"http://{host}{path}", declared, text))
    html = [(n, url, None if text is None and declared is None else (f"<html lang='{declared}'>" if declared else "<html>") + f"<p>{text or ''}</p></html>") for n, url, declared, text in rows]
    model = fit_text_model(spark.createDataFrame(labelled, "text string, lang string"))
    got = identify_pages(spark.createDataFrame(html, "page_id long, url string, html string").repartition(4), model).collect()
    read = {n: " " + " " + (text or "") + " " + " " if h is not None else None for (n, _, _, text), (_, _, h) in zip(rows, html, strict=True)}
    want = scalar_posteriors(labelled, [(g.page_id, g.host, g.declared, g.suggested, read[g.page_id]) for g in got])
    assert len(got) == 150
    for g, (n, lang, p) in zip(got, want, strict=True):
        assert (g.page_id, g.lang) == (n, lang) and g.confidence == pytest.approx(p, abs=2e-6), g
    # The rest of the evidence decides pages of no letters, one way and the other.
    bare = [g for g in got if g.features == 0]
    assert any(g.lang == UNKNOWN for g in bare) and any(g.lang != UNKNOWN for g in bare)


def test_evidence_decides_where_the_text_does_not(spark, model):
    page = "<html lang='{}'><p>{}</p></html>"
    rows = [(k, f"http://{lang}.site-{lang}.org/x", page.format(lang, text_of(lang, 40, k))) for k, lang in enumerate(["en", "de", "fr"] * 30)]
    rows += [(1000, "http://de.site-de.org/y", "<html lang=de><p>12</p>"), (1001, "http://new.net/y", "<p>12</p>"), (1002, "http://de.site-de.org/fr/z", "<html lang=fr><p>zqx</p>")]
    got = {r.page_id: r.lang for r in identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), model).collect()}
    assert got[1000] == "de" and got[1001] == UNKNOWN and got[1002] == UNKNOWN


def test_odd_pages(spark, model):
    rows = [(1, None, None), (2, "not an address", ""), (3, "http://", "<html></html>"), (4, "http://a.de/", "123 456 !!"), (5, None, f"<p>{text_of('de', 50, 3)}</p>"), (5, None, f"<p>{text_of('de', 50, 3)}</p>"), (None, "HTTP://X.FR:80/", f"<b>{text_of('fr', 900, 3) * 30}</b>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, lang string")
    got = [(r.page_id, r.lang) for r in identify_pages(pages, model).collect()]
    assert sorted(got, key=str) == sorted([(1, UNKNOWN), (2, UNKNOWN), (3, UNKNOWN), (4, "de"), (5, "de"), (5, "de"), (None, "fr")], key=str)  # 4 has no letters: its address and the table's mix decide
    assert identify_pages(pages.limit(0), model).count() == 0


def test_the_sample_is_of_distinct_texts(spark):
    """A text that fills half the table is drawn once, long texts are read where they lie, and no language goes."""
    copies = [("the and of " + text_of("en", 30, 0), "en")] * 4000
    rows = copies + [(text_of("en", 20, k), "en") for k in range(1, 700)] + [(text_of("de", 20, 0), "de")] * 500 + [(text_of("fr", 4000, 1), "fr")]
    one = fit_text_model(spark.createDataFrame(rows, "text string, lang string").repartition(5), per_language=500)
    two = fit_text_model(spark.createDataFrame(sorted(set(rows)), "text string, lang string").repartition(2), per_language=500)
    assert one.languages == ("de", "en", "fr") and (one.weights == two.weights).all()


def test_registered_domains(spark):
    hosts = {"bbc.co.uk": "bbc.co.uk", "news.bbc.co.uk": "bbc.co.uk", "a.b.com.br": "b.com.br", "co.uk": "co.uk", "x.y.example.com": "example.com", "example.de": "example.de", "a.co.de.com": "de.com", "10.1.2.3": "10.1.2.3", "school.sch.uk": "school.sch.uk", "localhost": "localhost"}
    got = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", domain_of(F.col("h")).alias("d")).collect()
    assert {r.h: r.d for r in got} == hosts


def test_markup_and_addresses(spark):
    html = "<!DOCTYPE html><HTML class=a LANG='de-AT'><script>var x='<p>no</p>';</script><!-- no --><style>p{}</style><p>a&amp;b</p></HTML>"
    df = spark.createDataFrame([(html, "https://user@www.Fr.Example.co.uk:8080/De-at/x?y#z")], "h string, u string")
    r = df.select(page_text(F.col("h")).alias("t"), declared_language(F.col("h")).alias("d"), host_of(F.col("u")).alias("o"), address_language(F.col("u"), ("de", "en")).alias("a")).first()
    assert (r.t.split(), r.d, r.o, r.a) == (["a&b"], "de", "fr.example.co.uk", "de")


def test_open_markup_hides_the_rest_of_a_page(spark):
    pages = {
        "a <b>c</b> d <!-- e": "a c d", "a <script>b</p> c": "a", "a <style >b</STYLE > c": "a c", "a < b, c <3": "a < b, c <3", "a <i b": "a", "<p>a</p": "a",
        "<!---->a<!-- -- > --> b": "a b", "<scripts>a</scripts>": "a", "": "",
    }
    got = spark.createDataFrame([(p,) for p in pages], "h string").select("h", page_text(F.col("h")).alias("t")).collect()
    assert {r.h: " ".join(r.t.split()) for r in got} == pages
    langs = {"<html lang=de><html lang=fr>": "de", "<html><p lang=fr>": None, "<HTML a=b lang = 'Fr-x'>": "fr", "<html": None}
    got = spark.createDataFrame([(p,) for p in langs], "h string").select("h", declared_language(F.col("h")).alias("d")).collect()
    assert {r.h: r.d for r in got} == langs


@pytest.mark.parametrize("part", ["<!--", "<", "<script>", "<script></script", "</script ", "<html ", "<html lang ", "<a <", "<!-->", "<style", "lang=", "&amp;", "<p>"])
def test_a_megabyte_of_hostile_markup_takes_seconds(spark, part):
    html = part * (1_000_000 // len(part))
    began = time.time()
    df = spark.createDataFrame([(html,)], "h string")
    df.select(F.length(page_text(F.col("h"))), declared_language(F.col("h"))).collect()
    assert time.time() - began < 10


def test_keep_known(spark, model, no_documents):
    rows = [(k, text_of(lang, 40, k + 500), "s") for k, lang in enumerate(["en", "de", "fr"] * 10)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "12 34 !! --", "s"), (103, "\x00\x01 ##", None)]
    docs = make_documents(spark, rows).withColumnsRenamed({"spans": "host", "keys": "scores"})
    kept = keep_known(docs, model)
    assert kept.columns == docs.columns
    got = {r.doc_id: (r.lang, r.host, r.scores) for r in kept.collect()}
    assert got == {k: (["en", "de", "fr"][k % 3], "x", 7) for k in range(30)}
    assert keep_known(no_documents, model).count() == 0


def test_every_labelled_language_is_kept(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    sounds = {f"l{k:03}": [letters[k // 26 + 3 * j] + letters[k % 26] + letters[(7 * k + 5 * j) % 26] for j in range(4)] for k in range(130)}
    texts = {lang: [" ".join(random.Random(f"{lang}{i}").choices(s, k=60)) for i in range(4)] for lang, s in sounds.items()}
    # The last ones are the rarest, which a bound on languages would drop.
    rows = [(t, lang) for n, (lang, ts) in enumerate(sorted(texts.items())) for t in ts[: 3 if n < 100 else 2]]
    table = spark.createDataFrame(rows, "text string, lang string")
    many = fit_text_model(table)
    assert many.languages == tuple(sorted(sounds))
    got = {r.doc_id: r.lang for r in keep_known(make_documents(spark, [(k, texts[lang][3], "s") for k, lang in enumerate(sorted(sounds))]).withColumn("lang", F.lit(None).cast("string")), many).collect()}
    assert sum(got.get(k) == lang for k, lang in enumerate(sorted(sounds))) >= 125
    with pytest.raises(ValueError, match="129 labelled languages"):
        fit_text_model(table, most_languages=129)
