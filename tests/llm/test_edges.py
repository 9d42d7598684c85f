"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from rowstream.llm import decontam, langid, mixing, neardup, order_minhash, passages, pii, quality, tokens, urlfilter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = "taken string, copies string, hits string, expected_grade string, tail_prob string, component_id string, kept string, id string, rep string, host string, pii_found string, text_hash string, score string, size string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def long_text(n=30_000, seed=7):
    out, x = [], seed
    for _ in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[x % len(WORDS)] + str(x % 997))
    return " ".join(out)


ROWS = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n ", None, "a", 4),
    (4, "one", "en", None, 3),
    (4, "one", "en", None, 3),
    (None, "no id at all here, friend", "en", "b", 25),
    (None, None, None, None, None),
    (5, long_text(), "en", "b", None),
    (6, "x" * 200_000, None, "b", None),
    (7, "same words in this text again and again", "en", "a", 39),
    (8, "same words in this text again and again", "en", "a", 39),
    (9, "\u00e9\u00e8 \U0001f600 \u4f60\u597d", "fr", "a", 7),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH.split(", "):
        df = df.withColumn(c.split()[0], F.lit("clash"))
    return df.cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((2, 1, 0), (7, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 1), (4, 1, 0))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def items(spark, rows=((1, "same words in this text again and again"), (2, None), (None, "same words in this text"), (3, ""), (1, "same words in this text again and again"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_quality(spark, docs, none):
    for model in (quality.fit(docs, quality.rating(labels(spark))), quality.fit(docs, quality.rating(labels(spark, []))), quality.fit(none, quality.rating(labels(spark)))):
        assert quality.score(docs, model).count() == len(ROWS)
        assert quality.score(none, model).count() == 0
    assert quality.fit(none, quality.rating(labels(spark))) == 2
    kept = quality.select_quality(docs, labels(spark, []))
    assert kept.count() == len(ROWS) and kept.columns == docs.columns


def test_tokens(spark, docs, none):
    got = tokens.count_tokens(docs)
    assert {r.section for r in got.where("doc_id = 1").collect()} == {0} and got.where("doc_id = 2").first().n_tokens == 0
    assert got.where("doc_id = 4").count() == 2 and got.where("doc_id is null").count() == 2
    assert tokens.count_tokens(none).count() == 0


def test_language(spark, docs, none):
    got = langid.identify_documents(docs)
    assert got.count() == len(ROWS)
    und = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert {1, 2, 3} <= und and 9 not in und
    assert langid.identify_documents(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(none)).collect()} == {"und"}


def test_fingerprints(spark, docs, none):
    got = order_minhash.fingerprint_documents(docs)
    assert got.count() == len(ROWS)
    by = {r.doc_id: r for r in got.where("doc_id is not null").collect()}
    assert by[7].fingerprint == by[8].fingerprint and by[7].near_next == 1.0 and by[1].n_chars == 0 and by[1].fingerprint == ""
    assert got.where("near_edited not between 0 and 1 or near_next not between 0 and 1").count() == 0
    assert order_minhash.fingerprint_documents(none).count() == 0


def test_near_duplicates(spark, docs, none):
    got = neardup.near_duplicates(docs)
    assert got.count() == len(ROWS)
    by = {r.doc_id: r for r in got.collect()}
    assert by[8].component_id == 7 and not by[8].kept and by[7].kept and by[1].component_id == 1 and by[2].component_id == 2 and by[4].n_shingles == 1
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.drop_near_duplicates(docs, k=5)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 6, 7, 9}


def test_urls(spark):
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://"), (None, "http://a.com/en/1"), (4, "HTTP://A.COM/en/1"), (4, "HTTP://A.COM/en/1"), (5, "x://" + "a." * 5000 + "com" + "/en/" + "y" * 100_000)], "page_id long, url string")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame([("com", "/en/", "block"), ("com", "/en/", "allow")], "host string, path string, verdict string")
    got = urlfilter.judge_urls(pages, rules)
    assert got.count() == 7 and got.where("verdict = 'block'").count() == 4
    assert urlfilter.judge_urls(pages, rules.limit(0)).where("rule is not null").count() == 0
    assert urlfilter.judge_urls(pages.limit(0), rules).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix_sources(docs)
    assert got.count() == len(ROWS) and got.where("taken > 3 * size").count() == 0
    assert mixing.mix_sources(none).count() == 0
    mixed = mixing.mixture(docs)
    assert [c for c in mixed.columns if c not in docs.columns] == [] and mixed.where("taken <= 0").count() == 0
    total = got.agg(F.sum("taken")).first()[0]
    assert mixed.agg(F.sum("taken")).first()[0] == total
    assert mixing.mixture(none).count() == 0


def test_pii(spark, docs, none):
    got = pii.pseudonymise(docs, "k", counts=True)
    assert got.count() == len(ROWS) and set(got.columns) == set(docs.columns)
    same = got.join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").where("not (text <=> old)")
    assert same.count() == 0
    assert pii.pseudonymise(none, "k").count() == 0


def test_passages(spark, docs, none):
    twin = docs.union(docs.where("doc_id = 5").withColumn("doc_id", F.lit(50).cast("long")))
    got = passages.repeated_passages(twin).collect()
    assert [(r.doc_id, r.source_doc_id, r.start_word, r.end_word) for r in got] == [(50, 5, 0, 30_000)]
    assert passages.repeated_passages(none).count() == 0


def test_contamination(spark, docs, none):
    got = decontam.contamination(docs, items(spark))
    assert got.count() == len(ROWS) and {r.doc_id: r.item_ids for r in got.where("contaminated").collect()} == {7: [1], 8: [1]}
    assert decontam.contamination(docs, items(spark, [])).where("contaminated").count() == 0
    assert decontam.contamination(none, items(spark)).count() == 0
    kept = decontam.drop_contaminated(docs, items(spark))
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
