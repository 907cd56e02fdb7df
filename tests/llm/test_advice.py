"""Cases in which an operator once did less than the whole job."""

import os
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import license_scan, merge_dropout, packing, pii, queries, site_templates

PUBLIC = os.path.exists(packing.MODEL)

# 1


@pytest.mark.skipif(not PUBLIC, reason="no public vocabularies")
def test_bins_hold_tokens(spark, tmp_path):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=packing.MODEL)
    texts = {1: "plain  words and\nmore ", 2: "中文" * 9000, 3: "x" * 50_000, 4: "", 5: "unbelievable " * 3000}
    spark.createDataFrame([*texts.items(), (6, None), (7, "a ▁ b")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    bins = queries.op1_best_fit_packing(spark, str(tmp_path)).cache()
    got = {r.doc_id: r.n for r in bins.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in texts.items() if t} | {7: 6}
    full = bins.groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("a")).agg(F.max("n"), F.max("a")).first()
    assert full[0] <= packing.MAX_TOKENS and full[1] <= packing.MAX_ATTENTION


# 2


def notices(text):
    found = license_scan.licences(text, license_scan.Compressors(license_scan.TEMPLATES))
    return [(name, text[a:b].split()[0], missing + extra) for a, b, name, _, _, missing, extra, _ in found]


def test_repeated_notices():
    line = "Licensed under CC BY 4.0."
    assert notices("\n".join([line] * 5)) == [("CC-BY-4.0", "Licensed", 0)] * 5
    assert notices(" ".join([license_scan._MIT] * 3)) == [("MIT", "Permission", 0)] * 3
    gpl = "This work is licensed under the GNU General Public License, version {}."
    assert [x[0] for x in notices(" and ".join(gpl.format(v) for v in (3, 2, 3, 2)))] == ["GPL-3.0", "GPL-2.0"] * 2
    long = " ".join([license_scan._MIT, license_scan._APACHE] * 8)
    assert [x[0] for x in notices(long)] == ["MIT", "Apache-2.0"] * 8


def test_stray_words_around_a_notice():
    mit = license_scan._MIT.replace("Permission", "Leave", 1)
    text = "prose permission " * 125 + mit + " prose of the software" * 60
    assert notices(text) == [("MIT", "is", 1)]


def layouts(paragraphs):
    """Notices wrapped at 72 columns: bare, and as comments of three kinds."""
    wrapped = [textwrap.wrap(p, 72) for p in paragraphs]
    for mark in ("", "# ", " * ", "// "):
        yield "some prose\n\n" + f"\n{mark.rstrip()}\n".join("\n".join(mark + line for line in w) for w in wrapped) + "\n\nint main() {}\n"


def test_notices_in_paragraphs():
    def cut(text, *at):
        places = [0, *(text.index(x) for x in at), len(text)]
        return [text[a:b].strip() for a, b in zip(places, places[1:])]

    usual = {
        "MIT": cut(license_scan._MIT, "The above copyright", "THE SOFTWARE IS"),
        "GPL-3.0": cut(license_scan._GPL, "This program is distributed"),
        "BSD": cut(license_scan._BSD, "Redistributions of source", "Redistributions in binary"),
        "Apache-2.0": cut(license_scan._APACHE, "You may obtain", "http:", "Unless required"),
        "MPL-2.0": cut(dict(license_scan.TEMPLATES)["MPL-2.0"], "If a copy"),
    }
    for name, paragraphs in usual.items():
        for text in layouts(paragraphs):
            assert [(n, d) for n, _, d in notices(text)] == [(name, 0)]
    two = "\n\n".join(usual["MIT"] + usual["GPL-3.0"] + usual["MIT"])
    assert [n for n, _, _ in notices(two)] == ["MIT", "GPL-3.0", "MIT"]


# 3

SAME_START = [
    "<article>The teaser of the week</article><article>Story number {0} has its own words</article>",
    "<article>A teaser</article><div><p>Story number {0} has words of its own outside of any article</p></div>",
    "<main></main><p>Story {0}</p>",
    "<article><img src=a></article><p>Story {0}</p>",
]


@pytest.mark.parametrize("body", SAME_START)
def test_pages_with_the_same_beginning_are_pages(spark, body):
    page = "<body><nav>menu of the site</nav>" + body + "<footer>imprint</footer></body>"
    pages = spark.createDataFrame([(i, "http://a.org/x", page.format(i)) for i in range(8)], "page_id long, url string, html string")
    for r in site_templates.main_text(pages).collect():
        assert "menu" not in r.text and "imprint" not in r.text and f"tory {r.page_id}" in r.text.replace("number ", "")


def test_copies_of_an_article_are_one_content():
    page = "<nav>menu {0}</nav><main><article>One story told again and again</article></main><aside>other things {0}, of which there are many more</aside>"
    assert len({site_templates.parse(page.format(i))[1] for i in range(5)}) == 1


# 4

UNSIGNED = [
    "write to jane (at) example.com",
    "jane [at] example.org",
    "juana <arroba> ejemplo.es",
    "jean { chez } exemple.fr",
    "jane at dotcom.org",
    "password = correcthorsebattery",
    "API-Key: abcdefghijkl",
    "secret = abcdefghijkl",
    "ghp_" + "abcdefghi" * 4,
    "sk-" + "abcdefghij" * 2,
    "eyJabcdefgh.abcdefgh.abcdefgh",
    "at fe:dc:ba:fe:dc:ba:fe:dc",
    "one eight oh oh five five five zero one nine nine",
    "jane at mail poınt example poınt com",
    "jane@example.ıo",
    "ring ²²³-¹²³-¹²³³ ok",
]
PLAIN = ["one two buckle my shoe", "the secret of the password", "at noon", "(at) home", "a token word", ""]


def test_prefilter_drops_nothing(spark):
    texts = UNSIGNED + PLAIN
    want = {(i, *x) for i, t in enumerate(texts) for x in pii.identifiers(t)}
    assert {x[0] for x in want} == set(range(len(UNSIGNED)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(len(texts))
    assert {tuple(r) for r in pii.find_identifiers(docs).collect()} == want
    assert {r.doc_id: r.text for r in pii.mask_identifiers(docs).collect()} == {i: pii.masked(t) for i, t in enumerate(texts)}


def test_characters_below_u0250_are_folded():
    assert pii.identifiers("jane@example.ıo") == [("email", 0, 15, "jane@example.io")]
    assert pii.identifiers("ring ²²³-¹²³-¹²³³ ok") == [("phone", 5, 17, "223-123-1233")]


def test_prefilter_over_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = {(r.doc_id, *x) for r in docs.collect() for x in pii.identifiers(r.text or "")}
    assert {tuple(r) for r in pii.find_identifiers(docs).collect()} == want


# 10


@pytest.mark.skipif(not PUBLIC, reason="no public vocabularies")
def test_each_occurrence_is_cut_by_itself(spark):
    docs = spark.createDataFrame([(i, "unbelievable") for i in range(400)] + [(400, " ".join(["unbelievable"] * 400))], "doc_id long, text string")
    rows = {r.doc_id: list(r.ids) for r in merge_dropout.encode(docs).collect()}
    assert len({tuple(rows[i]) for i in range(400)}) > 8
    v = merge_dropout.vocabulary(merge_dropout.MODEL)
    cuts, own = set(), []
    for i in rows[400]:
        if v.pieces[i].startswith(merge_dropout.MARK):
            cuts.add(tuple(own))
            own = []
        own.append(i)
    assert len(cuts) > 8
    usual = merge_dropout.encode_units(v, [" unbelievable"], 0, 0.0)[0]
    assert 0 < sum(np.array(rows[i], np.int32).tobytes() == usual for i in range(400)) < 300
