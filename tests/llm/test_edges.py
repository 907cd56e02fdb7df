"""Each operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import digest, kneser_ney, license_scan, merge_dropout, packing, pii, simhash, site_templates, telephony, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "the cat sat on the mat and " * 20_000
CLASHES = ["block", "shard", "n_tokens", "digest", "body", "f0", "lang_", "keep", "bin_id", "group_id", "perplexity", "payload", "codec", "root", "point", "high", "good", "k", "key", "template", "host", "ids", "part"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "a plain text about nothing much", "en", "s", 31),
        (1, "a plain text about nothing much", "en", "s", 31),
        (2, None, "en", "s", None),
        (3, "", "en", None, 0),
        (4, "   \n\t ", None, None, 6),
        (5, LONG, "en", "s", len(LONG)),
        (6, "x" * 50_000, "de", "s", 50_000),
        (None, "a text without a number", None, None, None),
        (None, None, None, None, None),
        (7, "%%% *** &&&", "en", "s", 11),
        (8, "%%% *** &&&", "en", "s", 11),
        (9, "mail me at jane@example.com ▁ 😀 ​", "fr", "s", 30),
        (-10, "A PLAIN  text about\nnothing much", "en", "s", 31),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 1, 0), (2, 1, 0), (3, None, None), (None, 1, 0), (9, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_digest(odd):
    got = dict(((r.doc_id, r.n_copies), r.canonical_id) for r in digest.exact_groups(odd).collect())
    assert got[1, 3] == got[-10, 3] == -10 and got[2, 1] == 2 and got[None, 1] is None
    assert got[3, 2] == got[4, 2] == 3 and got[7, 2] == got[8, 2] == 7 and got[5, 1] == 5
    assert digest.exact_groups(odd).count() == odd.count()
    assert digest.exact_groups(odd.limit(0)).count() == 0


def test_near_groups(odd):
    groups = rows_of(simhash.near_groups(odd), "doc_id", "group_id")
    assert len(groups) == odd.count()
    assert (1, -10) in groups and (2, 2) in groups and (3, 3) in groups and (4, 4) in groups and (8, 7) in groups and (None, None) in groups
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert rows_of(kept, "doc_id") == sorted([(i,) for i in (-10, 2, 3, 4, 5, 6, 7, 9, None, None)], key=repr)
    assert simhash.near_groups(odd.limit(0)).count() == simhash.drop_near_duplicates(odd.limit(0)).count() == 0
    assert simhash.near_pairs(odd.limit(0)).count() == 0


def test_identifiers(odd):
    found = pii.find_identifiers(odd).collect()
    assert [(r.doc_id, r.kind, r.value) for r in found] == [(9, "email", "jane@example.com")]
    masked = pii.mask_identifiers(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count()
    row = masked.where("doc_id = 9").first()
    assert row.text.startswith("mail me at <EMAIL>") and row.n_chars == len(row.text) and row.keep == "clash"
    assert masked.where("doc_id = 2").first().n_chars is None
    assert pii.find_identifiers(odd.limit(0)).count() == pii.mask_identifiers(odd.limit(0)).count() == 0


def test_packing(odd):
    packed = packing.pack_documents(odd)
    longest = 3547
    assert packed.agg(F.max("n_tokens")).first()[0] == longest
    total = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    got = {r.doc_id: r.n for r in total.collect()}
    assert got == {1: 12, 5: len(LONG.split()), 6: 1, None: 5, 7: 3, 8: 3, 9: 7, -10: 6}
    assert packing.pack_documents(odd.limit(0)).count() == 0


def test_licences(odd):
    assert license_scan.scan_licences(odd).count() == 0
    assert license_scan.scan_licences(odd.limit(0)).count() == 0


def test_classifier(odd, labels):
    out = kneser_ney.classify(odd, labels)
    assert out.count() == odd.count()
    assert out.where("n_bytes = 0").select("keep", "perplexity").distinct().collect() == [(False, None)]
    assert out.where("n_bytes > 0 and perplexity is null").count() == 0
    kept = kneser_ney.keep_trusted_quality(odd, labels)
    assert kept.columns == odd.columns and kept.where("doc_id is null").count() == 1
    assert kneser_ney.classify(odd.limit(0), labels).count() == 0
    # no trusted text: the base distribution, and nothing to reject by
    free = kneser_ney.classify(odd, labels.limit(0))
    assert free.where("n_bytes > 0").agg(F.min("perplexity"), F.max("perplexity"), F.min("keep")).first() == (pytest.approx(256), pytest.approx(256), True)


def test_token_counts(odd):
    got = {(r.doc_id, r.n_pre_tokens) for r in token_counts.count_tokens(odd).collect()}
    assert {(1, 6), (2, None), (3, 0), (4, 0), (6, 1), (None, 5), (None, None)} <= got
    assert token_counts.count_tokens(odd.limit(0)).count() == 0


def test_merge_dropout(odd):
    coded = merge_dropout.encode(odd).cache()
    assert coded.where("not lossless").count() == 0
    assert coded.where("ids is null and lossless is null and n_tokens is null").count() == 2
    texts = sorted((r.text for r in merge_dropout.decode(coded).collect()), key=repr)
    assert texts == sorted((r.text for r in odd.collect()), key=repr)
    assert merge_dropout.encode(odd.limit(0)).count() == merge_dropout.decode(coded.limit(0)).count() == 0


def test_telephony(odd, spark):
    out = telephony.decode_calls(telephony.media_column(odd))
    assert out.count() == odd.count()
    assert out.where("doc_id is null and (pcm is not null or n_samples is not null)").count() == 0
    assert out.where("doc_id = 2 and pcm is not null").count() == 0
    assert out.where("doc_id = 3").first().n_samples == 0
    unknown = spark.createDataFrame([(1, "opus", bytearray(b"abc")), (2, None, bytearray(b"abc")), (3, "adpcm", bytearray(b"abc"))], "doc_id long, codec string, payload binary")
    assert rows_of(telephony.decode_calls(unknown), "doc_id", "n_samples") == [(1, None), (2, None), (3, 0)]
    assert telephony.decode_calls(telephony.media_column(odd.limit(0))).count() == 0


def test_site_templates(spark):
    page = "<html><body><nav>menu</nav><p>text {}</p></body></html>"
    rows = [(i, "http://a.org/x", page.format(i)) for i in range(8)] + [(0, "http://a.org/x", page.format(0))]
    rows += [(20, None, page.format("n")), (21, "nonsense", page.format("m")), (22, "http://a.org/", None), (23, "http://a.org/", ""), (None, "http://a.org/", "<p>open <b>bold"), (24, "http://b.org", "<div>" * 3000 + "deep" + "</div>" * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("text", F.lit(2)).withColumn("block", F.lit(3))
    got = {(r.page_id, r.text) for r in site_templates.main_text(pages).collect()}
    assert {(i, f"text {i}") for i in range(8)} <= got
    assert {(20, "menu\ntext n"), (21, "menu\ntext m"), (22, None), (23, ""), (None, "open bold"), (24, "deep")} <= got
    assert site_templates.main_text(pages).count() == len(rows)
    assert site_templates.main_text(pages.limit(0)).count() == 0


def test_pipeline(spark, odd, labels, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == odd.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
