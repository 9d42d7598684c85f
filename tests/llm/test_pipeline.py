"""The pipeline, stage by stage, against plain versions, and on odd rows."""

import collections
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rowstream.llm import decontam, pii, quality, textscan
from tests.llm.test_operators import SPACE, plain_components, plain_distance, plain_mix

KEY = "a key for tests"


@pytest.fixture(scope="module")
def keyed(spark):
    spark.conf.set(pii.KEY_SETTING, KEY)
    yield spark
    spark.conf.unset(pii.KEY_SETTING)


def read(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plain_place(kind, text):
    """The feature number of a word or a shape."""
    data = np.frombuffer(text.encode(), np.uint8)
    prefix = textscan.Prefix(textscan.LOWER[data] if kind == "word" else data)
    found = prefix.ranges(np.array([0]), np.array([len(data)]))
    return int((found if kind == "word" else textscan.mix(found + np.uint64(1)))[0] >> np.uint64(64 - quality.BITS))


def plain_tail(model, text):
    """The chance of the highest grade, feature by feature."""
    cores = {plain_place("word", w) for w in re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text)}
    words = SPACE.findall(text)
    shapes: collections.Counter = collections.Counter()
    for before, w in zip([None, *words], words, strict=False):
        form = re.sub("[0-9]+", "0", re.sub("[A-Z]+", "A", re.sub("[a-z\x80-\U0010ffff]+", "a", w)))
        shapes[plain_place("shape", re.sub(r"([^0-9A-Za-z])\1+", r"\1", form))] += 1
        shapes[0] += before == w
    latent = sum(model.weights[c] for c in cores) + sum(model.weights[s] * math.sqrt(n / len(words)) for s, n in shapes.items() if n)
    return 1 / (1 + math.exp(-(latent - model.thresholds[-1])))


def plain_reduced(text):
    return " ".join("".join(c.lower() if c.isalnum() else " " for c in text).split())


def plain_contaminated(text, items):
    """Whether a window of an item is within its budget; windows that share too few q-grams by the lemma are passed over."""
    text = plain_reduced(text)
    for item in items:
        item = plain_reduced(item)
        for c in [0] if len(item) <= 200 else [*range(0, len(item) - 200, 100), len(item) - 200]:
            piece = item[c : c + 200]
            e = int(decontam.BUDGET * len(piece))
            q = min(10, len(piece) // (e + 1))
            shared = sum(piece[i : i + q] in text for i in range(len(piece) - q + 1))
            if piece and shared >= len(piece) - q + 1 - q * e and plain_distance(piece, text) <= e:
                return True
    return False


def test_stages_against_plain_versions(keyed, sf_dir):
    spark = keyed
    docs = read(spark, sf_dir, "documents")
    labels, items = read(spark, sf_dir, "labels"), [r.text for r in read(spark, sf_dir, "benchmark").collect()]
    by_name = dict(corpus_pipeline.STAGES)
    step = lambda name, df: by_name[name](spark, df, sf_dir).cache()
    rows = lambda df: {r.doc_id: r for r in df.collect()}

    model = quality.fit(docs, quality.rating(labels))
    good = step("quality classifier", docs)
    tails = {i: plain_tail(model, r.text or "") for i, r in rows(docs).items()}
    sure = {i for i, t in tails.items() if abs(t - 0.5) > 1e-6}
    assert rows(good).keys() & sure == {i for i in sure if tails[i] >= 0.5} and 0 < good.count() < docs.count()

    one = step("MinHash near-dedup", good)
    plain = plain_components({i: r.text or "" for i, r in rows(good).items()}, 5)
    assert rows(one).keys() == {i for i, (_, c) in plain.items() if c == i} and one.count() < good.count()

    clean = step("benchmark decontamination", one)
    assert rows(clean).keys() == {i for i, r in rows(one).items() if not plain_contaminated(r.text or "", items)} and clean.count() < one.count()

    private = step("PII", clean)
    back = rows(pii.pseudonymise(private, KEY, undo=True))
    assert {i: r.text for i, r in back.items()} == {i: r.text for i, r in rows(clean).items()}
    found = {r.doc_id for r in pii.pseudonymise(clean, KEY, counts=True).where("pii_found > 0").collect()}
    assert {i for i, r in rows(private).items() if r.text != rows(clean)[i].text} == found and found
    assert all(r.n_chars == len(r.text or "") for r in rows(private).values())

    mixed = step("mixing sources to target weights", private)
    want = {i: n for (i, _), (n, _) in plain_mix(private).items() if n}
    assert {i: r.taken for i, r in rows(mixed).items()} == want

    for df in (good, one, clean, private):
        assert df.columns == docs.columns
    whole = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, whole.collect())) == sorted(map(str, mixed.collect()))


ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 4), (4, "one", "en", None, 3), (4, "one", "en", None, 3), (None, "no id at all here, friend", "en", "b", 25),
    (None, None, None, None, None), (6, "x" * 50_000, None, "b", None), (7, "call 10.0.0.1 or the same words again and again", "en", "a", 39), (8, "call 10.0.0.1 or the same words again and again", "en", "a", 39),
    (9, "a passage that the benchmark has in full, word for word, to the end", "fr", "a", 7), (4, "another text under a repeated id", "en", "a", 3),
]
CLASH = ("taken", "copies", "__x", "hits", "expected_grade", "tail_prob", "kept", "id", "h", "row", "label", "size", "n", "component_id", "pii_found", "key", "node")


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(9, "a passage that the benchmark has in full, word for word, to the end"), (1, None), (None, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(2, 1, 0), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_odd_rows_and_clashing_columns(keyed, folder):
    spark = keyed
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("clash"))
    sizes = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        kept = out.collect()
        sizes.append(len(kept))
        if len(sizes) < 5:
            assert out.columns == docs.columns and all(r[c] == "clash" for r in kept for c in CLASH)
        docs = spark.createDataFrame(kept, out.schema)
    texts = [(r.doc_id, r.text) for r in kept]
    # no rating but one grade: all stay; of copies and repeated rows one stays, rows without words all; one holds the benchmark's
    assert sizes[:4] == [12, 10, 9, 9] and (9, ODD[10][1]) not in texts
    assert {r.doc_id for r in kept if r.text and "10." in r.text} <= {7} and not any(r.text and "10.0.0.1" in r.text for r in kept)
    assert all(r.taken > 0 for r in kept) and not any(r.text is None or not r.text.strip() for r in kept)


def test_empty_tables(keyed, folder, tmp_path):
    spark = keyed
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_a_session_draws_its_own_key(spark, monkeypatch):
    monkeypatch.delenv(pii.KEY_VARIABLE, raising=False)
    spark.conf.unset(pii.KEY_SETTING)
    first = pii.session_key(spark)
    assert len(first) >= 32 and pii.session_key(spark) == first
    spark.conf.unset(pii.KEY_SETTING)
    assert pii.session_key(spark) != first
    spark.conf.unset(pii.KEY_SETTING)
    monkeypatch.setenv(pii.KEY_VARIABLE, "given")
    assert pii.session_key(spark) == "given"
