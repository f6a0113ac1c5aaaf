"""Very long texts, nulls, repeated rows, clashing columns and empty tables, for operators whose other tests have none."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomline.llm import exact_dedup, html_text, minhash, mixing, prefix_trees, pu_quality, quality_rules, simhash, suffix_levels, token_counts

LONG = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000)) + "\n" + "x" * 200_000


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, LONG), (2, LONG), (3, None), (None, ""), (None, LONG + " tail"), (4, "a b"), (4, "a b")]
    return spark.createDataFrame([(i, t, None, None, 7, 8) for i, t in rows], "doc_id long, text string, lang string, source string, n_words int, fp int").repartition(2)


def test_quality_of_long_texts(docs):
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["base_failed"]) for r in quality_rules.judge(docs).collect()))
    assert got == sorted([(1, 60_001, False), (2, 60_001, False), (2, 60_001, False), (0, 60_002, False), (3, 0, True), (0, 0, True), (4, 2, True), (4, 2, True)])
    assert quality_rules.quality_filter(docs).columns == docs.columns


def test_identities_of_long_texts(docs):
    got = exact_dedup.decisions(docs).collect()
    sha = hashlib.sha256("".join(LONG.split()).encode()).hexdigest()
    assert sum(r["text_sha256"] == sha and r["group_size"] == 3 and r["keep_id"] == 1 for r in got) == 3 and sum(r["kept"] for r in got) == 4


def test_fingerprints_and_columns_that_clash(docs):
    out = simhash.fingerprints(docs)
    assert out.columns == [*docs.columns, "fp_"] and out.filter("doc_id = 1").first()["fp_"] == simhash.fingerprint(LONG)
    assert sorted(r["doc_id"] or 0 for r in minhash.near_texts(docs).collect()) == [1, 3, 4]


def test_scores_and_lengths_of_long_texts(docs):
    model = pu_quality.fit(docs, docs.filter("doc_id = 1").select("doc_id"))
    assert all(0 <= r["score"] <= 1 for r in pu_quality.score(docs, model).collect()) and pu_quality.score(docs, model).count() == 8
    lengths = token_counts.encoded_lengths(docs.withColumn("n_tokens", F.lit("taken")))
    assert lengths.columns[-1] == "n_tokens_" and lengths.filter("doc_id = 1").first()["n_tokens_"] > 60_000


def test_repeats_in_long_texts(docs):
    words = {(r["did"], sum(s["hi"] - s["lo"] for s in r["spans"])) for r in prefix_trees.dedup(docs).collect()}
    assert (1, 0) in words and (2, 60_001) in words
    some = suffix_levels.dedup(docs).filter("did <= 2").collect()
    assert len(some) == 3 and all(len(r["kept"]) == 0 and len(r["spans"]) == 1 for r in some)


def test_mixing_of_nulls_and_empty_tables(docs):
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).filter("doc_id is null").count() >= 2
    assert mixing.mix(docs.limit(0)).count() == 0 and minhash.near_texts(docs.limit(0)).count() == 0 and simhash.near_dedup(docs.limit(0)).count() == 0


def test_long_and_repeated_pages(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article>" + "".join(f"<p>Paragraph {i} of a very long article, with some words in it.</p>" for i in range(3000)) + "</article></body></html>"
    df = spark.createDataFrame([(1, page), (1, page), (2, None), (3, "x" * 300_000)], "page_id long, html string").withColumn("url", F.lit(None).cast("string"))
    got = html_text.extract(df).collect()
    assert len(got) == 4 and sum(r["page_id"] == 1 and r["text"].startswith("Paragraph 0") and r["text"].endswith("words in it.") and r["text"].count("Paragraph") == 3000 for r in got) == 2
    assert html_text.extract(df.limit(0)).count() == 0
