"""Each operator against a plain version, a round trip or held-out accuracy."""

import bisect
import collections
import datetime
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rowstream.llm import decontam, langid, mixing, neardup, order_minhash, passages, pii, quality, registry, textscan, tokens
from tests.comparison import assert_same, connect

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(registry.QUERIES[name](spark, sf_dir), connect(sf_dir), registry.ORACLE_SQL[name])


def test_op1_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rated = quality.rating(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = quality.fit(docs, rated.where(half == 0))
    assert np.all(np.diff(model.thresholds) > 0)
    got = quality.score(docs.where(half == 1), model).join(rated, "doc_id").toPandas()
    assert (got.tail_prob[got.grade == 2] >= 0.5).mean() > 0.97
    assert (got.tail_prob[got.grade < 2] < 0.5).mean() > 0.6
    means = got.groupby("grade").expected_grade.mean()
    assert means[2] > means[1]
    assert ((got.expected_grade >= 0) & (got.expected_grade <= 2)).all()


def test_op1_gradient_and_optimum():
    rng = np.random.default_rng(3)
    n, used, grades = 60, 5, 4
    row = np.sort(rng.integers(0, n, 150))
    place, value, grade = rng.integers(0, used, 150), rng.random(150), rng.integers(0, grades, n)
    theta = rng.normal(size=used + grades - 1) * 0.5
    loss = lambda t: quality.loss_and_gradient(t, row, place, value, grade, grades)[0]
    gradient = quality.loss_and_gradient(theta, row, place, value, grade, grades)[1]
    step = 1e-5
    for i in range(len(theta)):
        move = np.eye(len(theta))[i] * step
        assert gradient[i] == pytest.approx((loss(theta + move) - loss(theta - move)) / (2 * step), abs=1e-6)


def test_op1_fit_equals_shares():
    """With one feature a class, the best model gives each class its own share of every grade or better."""
    rng = np.random.default_rng(3)
    n = 6000
    kind = np.arange(n) % 3
    chance = np.array([[0.7, 0.2, 0.1], [0.45, 0.25, 0.3], [0.1, 0.2, 0.7]])
    grade = np.array([rng.choice(3, p=chance[k]) for k in kind])
    model = quality.fit_arrays(np.arange(n + 1), np.array([10, 11, 12])[kind], np.ones(n), grade, 3)
    assert np.all(np.diff(model.thresholds) > 0)
    tails = model.tails(model.weights[[10, 11, 12]])
    marked = model.weights[[10, 11, 12]] != 0  # a class that is better than the mean is no mark of a lower grade
    assert marked.tolist() == [True, True, False]
    for k in range(3):
        shares = [(grade[kind == k] >= j).mean() for j in (1, 2)]
        assert abs(tails[k].sum() - sum(shares)) < 0.06


def test_op2_spans_and_rules(spark):
    text = "Hello, w\u00f6rld!\n\nSecond \U0001f600 line 12345\nend"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    encoder = tokens.Encoder(open(tokens.VOCABULARY, "rb").read())
    ids = encoder.encode(text)
    assert b"".join(encoder.core.decode_single_token_bytes(int(i)) for i in ids).decode() == text
    for rule in tokens.RULES:
        rows = tokens.count_tokens(docs, rule=rule).orderBy("section").collect()
        assert [text[r.start_char : r.end_char] for r in rows] == ["Hello, w\u00f6rld!\n", "\n", "Second \U0001f600 line 12345\n", "end"]
        assert sum(r.n_tokens for r in rows) == pytest.approx(len(ids)) and rows[0].doc_tokens == len(ids)
    with pytest.raises(ValueError):
        tokens.count_tokens(docs, rule="other")


def test_op2_equals_token_loop(spark, sf_dir, texts):
    encoder = tokens.Encoder(open(tokens.VOCABULARY, "rb").read())
    got = {rule: collections.defaultdict(list) for rule in tokens.RULES}
    for rule in tokens.RULES:
        for r in tokens.count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), rule=rule).orderBy("doc_id", "section").collect():
            got[rule][r.doc_id].append((r.start_char, r.end_char, r.n_tokens, r.n_crossing, r.doc_tokens))
    for d, text in texts.items():
        lines = re.findall(r"[^\n]*\n|[^\n]+", text) or [""]
        ends = np.cumsum([len(x.encode()) for x in lines]).tolist()
        counts = {rule: [0.0] * len(lines) for rule in tokens.RULES}
        crossing, at = [0] * len(lines), 0
        ids = encoder.core.encode(text, disallowed_special=())
        for token in ids:
            size = len(encoder.core.decode_single_token_bytes(token))
            parts: collections.Counter = collections.Counter()
            for byte in range(at, at + size):
                parts[bisect.bisect_right(ends, byte)] += 1
            first, most = min(parts), max(sorted(parts), key=lambda x: parts[x])  # noqa: B023
            counts["start"][first] += 1
            counts["majority"][most] += 1
            for line, n in parts.items():
                counts["split"][line] += n / size
                crossing[line] += line != first
            at += size
        spans = np.cumsum([0, *[len(x) for x in lines]]).tolist()
        for rule in tokens.RULES:
            want = [(spans[i], spans[i + 1], counts[rule][i], crossing[i], len(ids)) for i in range(len(lines))]
            assert [(*r[:2], round(r[2], 6), *r[3:]) for r in got[rule][d]] == [(*r[:2], round(r[2], 6), *r[3:]) for r in want], d


def test_op2_crossing():
    ends, starts = np.array([2, 6, 9]), np.array([0, 3, 4])
    assert tokens.attribute(ends, starts, 9, "start")[0].tolist() == [2, 0, 1]
    assert tokens.attribute(ends, starts, 9, "majority")[0].tolist() == [1, 0, 2]
    counts, crossed = tokens.attribute(ends, starts, 9, "split")
    assert counts.tolist() == [1.25, 0.25, 1.5] and crossed.tolist() == [0, 1, 1]


def test_op2_long_blanks():
    encoder = tokens.Encoder(open(tokens.VOCABULARY, "rb").read())
    for text in ("a" + " " * 200_000 + "b", " " * 150_000, "x\n" + "\n" * 120_000):
        ids = encoder.encode(text)
        assert encoder.lengths[ids].sum() == len(text.encode())
    short = "a" + " " * 3000 + "b c" + "\n" * 2000
    assert encoder.encode(short).tolist() == encoder._around_blanks(short).tolist()


def test_op3_held_out(spark, sf_dir):
    got = registry.op3_language_filters(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    out = got[got.held_out & got.lang.notna()]
    assert len(out) > 20 and (out.lang == out.lang_pred).mean() > 0.97
    assert ((got.score >= 0) & (got.score <= 1)).all()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.itertuples())


def plain_grams(text):
    kept = " ".join("".join(c if c.isalpha() else "\0" for c in text.lower()).replace("\0", " ").split())
    kept += " " if text and kept and not text.lower()[-1].isalpha() else ""
    return [kept[i : i + n] for n in langid.SIZES for i in range(len(kept) - n + 1)]


def test_op3_equals_exact_sets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    train = [r for r in rows if r.text is not None and r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    size = collections.Counter(r.lang for r in train)
    count = {x: collections.Counter(g for r in train if r.lang == x for g in set(plain_grams(r.text))) for x in size}
    best = collections.defaultdict(float)
    for x, grams in count.items():
        for g, n in grams.items():
            best[g] = max(best[g], n / size[x])
    known = {x: {g for g, n in grams.items() if n >= min(langid.LEAST_DOCS, size[x]) and n / size[x] >= max(langid.LEAST_RATE, langid.LEAST_SHARE * best[g])} for x, grams in count.items()}
    got = {r.doc_id: r for r in langid.identify_documents(docs).collect()}
    wrong = 0
    for r in rows:
        grams = plain_grams(r.text or "")
        if not grams:
            continue
        share = {x: sum(g in s for g in grams) / len(grams) for x, s in known.items()}
        first, second = sorted(share.values())[-1:-3:-1]
        if first - second > 0.02:
            assert got[r.doc_id].lang_pred == max(share, key=share.get)
        wrong += abs(got[r.doc_id].score - share[got[r.doc_id].lang_pred]) > 0.02  # what false positives leave
    assert wrong <= 0.02 * len(rows)


def test_op3_filter_has_no_false_negatives_and_scores_alone():
    grams = [g for g, _ in langid.text_grams(["the quick brown fox"])]
    planes = np.zeros((2, 1 << langid.SLOT_BITS), np.uint64)
    for g in grams:
        for i in range(langid.HASHES):
            planes[1][langid.slots_of(g, i)] |= np.uint64(2)
    f = langid.Filter([f"l{i:02d}" for i in range(65)], planes)
    named, score = f.predict(["the quick brown fox", None, "123", "the quick brown fox"])
    assert named == ["l64", "und", "und", "l64"] and score[0] == pytest.approx(1.0) and score[0] == score[3]


def test_op4_edits_and_order(spark, sf_dir, texts):
    got = {r.doc_id: r for r in registry.op4_order_minhash(spark, sf_dir).collect()}
    ids = sorted(texts)
    for i, d in enumerate(ids):
        own, nxt = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[d].n_chars == len(own)
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9
    words = [f"w{i}" for i in range(400)]
    few, many, moved = list(words), list(words), words[200:] + words[:200]
    few[100] = "x"
    for i in range(0, 400, 8):
        many[i] = "x"
    rows = [(0, " ".join(words)), (1, " ".join(few)), (2, " ".join(many)), (3, " ".join(words[::-1])), (4, " ".join(moved)), (5, "a b " * 100), (6, "a b " * 150)]
    signed = {r.i: r.s for r in order_minhash.with_signature(spark.createDataFrame(rows, "i int, t string"), "t", "s").collect()}
    like = lambda a, b: len(set(signed[a]) & set(signed[b])) / len({e >> 32 for e in signed[a]} | {e >> 32 for e in signed[b]})
    assert like(0, 1) > like(0, 2) > like(0, 3) and like(0, 1) > like(0, 4) > 0 and like(5, 6) < 1


def test_op4_without_blanks_and_short_texts(spark):
    rng = random.Random(2)
    han = [chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)]
    data = [rng.choice("abcdefghijklmnop") for _ in range(2000)]
    words = [f"w{i}" for i in range(12)]
    rows = [(0, "".join(han)), (1, "".join(han[:290] + ["x"] + han[291:])), (2, "".join(data)), (3, "".join(data[:1000]) + "z" * 900), (4, " ".join(words)), (5, " ".join(words[6:] + words[:6]))]
    signed = {r.i: r.s for r in order_minhash.with_signature(spark.createDataFrame(rows, "i int, t string"), "t", "s").collect()}
    like = lambda a, b: len(set(signed[a]) & set(signed[b])) / len({e >> 32 for e in signed[a]} | {e >> 32 for e in signed[b]})
    assert like(0, 1) > 0.8 and 0.02 < like(2, 3) < 0.4 and 0 < like(4, 5) < 0.7


def test_op4_signature_against_plain_version(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 120)))) for i in range(40)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = {r.i: r.s for r in order_minhash.with_signature(df, "t", "s", k=2, length=2, bin_bits=3).collect()}
    pairs = {(a, b) for a in "abcdefgh" for b in [*"abcdefgh", None]}
    grams = spark.createDataFrame(list(pairs), "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.when(F.col("b").isNotNull(), F.xxhash64("b"))).alias("h")).collect()
    code = {(r.a, r.b): r.h & order_minhash._HASH for r in grams}
    numbered = spark.createDataFrame([(h, n) for h in set(code.values()) for n in range(120)], "h long, n int").select("h", "n", F.xxhash64("h", "n").alias("x")).collect()
    again = {(r.h, r.n): r.x & order_minhash._HASH for r in numbered}
    want: dict = {}
    tuples = []
    unsigned = (1 << 64) - 1
    for i, t in rows:
        w = t.split()
        ks = [(w[j], w[j + 1]) for j in range(len(w) - 1)] if len(w) > 1 else [(x, None) for x in w]
        seen: collections.Counter = collections.Counter()
        ring = []
        for j, g in enumerate(ks):
            ring.append((again[(code[g], seen[code[g]])], j))
            seen[code[g]] += 1
        ring.sort()
        bins = [(x & unsigned) >> 61 for x, _ in ring]
        want[i] = {}
        for a, b in enumerate(bins):
            if a and bins[a - 1] == b:
                continue
            least = [ring[a], ring[(a + 1) % len(ring)]]
            tup = [(x & unsigned) >> 23 for x, j in sorted(least, key=lambda z: z[1])]
            want[i][b] = tup
            tuples.append((i, int(b), [int(v) for v in tup]))
    hashed = spark.createDataFrame(tuples, "i int, b int, t array<long>").select("i", "b", F.xxhash64("t").bitwiseAND(F.lit(0xFFFFFFFF)).alias("h")).collect()
    expect = collections.defaultdict(set)
    for r in hashed:
        expect[r.i].add((r.b << 32) | r.h)
    assert all(set(got[i]) == expect[i] for i, _ in rows)


def plain_components(texts, k=4):
    sets = {}
    for d, t in texts.items():
        w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = collections.defaultdict(set)
    for d, s in sets.items():
        for g in s:
            by[g].add(d)
    for d, s in sets.items():
        for e in {e for g in s for e in by[g] if e < d}:
            i = len(s & sets[e])
            if 100 * i >= 80 * len(s | sets[e]):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize("k", [4, 5])
def test_op5_chains_and_groups(spark, k):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    texts = {}
    for i in range(60):  # a source and its copies, of which some lie beyond the limit
        words = list(base)
        for _ in range(rng.randrange(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    chain = [f"c{rng.randrange(10**6)}" for _ in range(100)]
    for i in range(100, 130):  # each step changes a little: ends are far apart
        chain[(i * 7) % 100] = f"y{i}"
        texts[i] = " ".join(chain)
    for i in range(200, 260):
        texts[i] = " ".join(f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 30)))
    texts |= {300: "A b", 301: "a  b", 302: "a b c", 303: ""}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=k).collect()}
    assert got == plain_components(texts, k)


def test_op5_texts_of_one_template_just_under_the_limit(spark):
    """Likeness of two texts is just under 0.8, of some over it: large mixed buckets with few links."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = {}
    for i in range(220):
        words = list(base)
        for j in rng.sample(range(300), 6):
            words[j] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(words)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    want = plain_components(texts)
    assert got == want and 150 < len({c for _, c in want.values()}) < 220


def test_op5_repeated_and_missing_ids(spark):
    rng = random.Random(7)
    base = {c: [f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "ABCDE"}

    def text(c, edited=False):
        words = list(base[c])
        if edited:
            words[rng.randrange(5, 55)] = f"x{rng.randrange(10**6)}"
        return " ".join(words)

    a, b, d = text("A"), text("B"), text("D")
    rows = [(1, a), (1, b), (2, text("A", True)), (None, text("B", True)), (None, text("B", True)), (3, a), (3, a), (None, text("C")), (None, text("C", True)), (4, d), (4, d), (5, text("E")), (None, ""), (None, ""), (6, None), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("h", F.lit("clash"))
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == {(1, 57, 1, True): 2, (2, 57, 1, False): 1, (None, 57, 1, False): 2, (3, 57, 1, False): 2, (None, 57, None, True): 2, (4, 57, 4, True): 2, (5, 57, 5, True): 1, (None, 0, None, True): 2, (6, 0, 6, True): 2}
    kept = neardup.drop_near_duplicates(docs, k=4)
    assert kept.columns == docs.columns and kept.where("row <> 'clash' or h <> 'clash'").count() == 0
    left = collections.Counter((r.doc_id, (r.text or "")[:1]) for r in kept.collect())
    assert left == {(1, "A"): 1, (1, "B"): 1, (None, "C"): 1, (4, "D"): 1, (5, "E"): 1, (None, ""): 2, (6, ""): 2}


def test_op5_links_in_mixed_buckets(spark):
    rng = random.Random(5)
    form = [f"f{i}" for i in range(103)]
    texts = {}
    for i in range(200):  # two texts of a form are alike to 0.68, the two of each of the first 40 pairs to 0.84
        pair = i // 2 if i < 80 else i
        own = [f"p{pair}-{j}" if i < 80 else f"p-{i}-{j}" for j in range(13)]
        texts[i] = " ".join(form + own + [f"q{rng.randrange(10**9)}" for _ in range(11)])
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(rows, bands=4, rows=1).collect()}  # few, large buckets
    assert got == {i: i // 2 * 2 if i < 80 else i for i in texts}


def test_op5_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(neardup, "COLUMNS", 16)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 60))).astype(np.uint64) for _ in range(80)]
    component, at = np.arange(80) // 3 * 3, np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for side in (np.zeros(80, bool), np.arange(80) % 3 == 1):
        expect = set()
        for i in range(80):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if (not side.any() or side[i] != side[j]) and component[i] != component[j] and 100 * common >= 30 * (len(sets[i]) + len(sets[j]) - common):
                    expect.add((component[j], component[i]))
        assert expect and {tuple(r) for r in neardup.alike(component, side, np.concatenate(sets), at, 30)} == expect


def test_op5_densified_signatures():
    rng = np.random.default_rng(2)
    match = []
    for _ in range(200):
        pool = rng.integers(0, 2**63, 30).astype(np.uint64)
        a, b = np.unique(pool[:25]), np.unique(pool[5:])
        sig = neardup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 128)
        match.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(match) - 20 / 30) < 0.04


def test_op6_filter_false_positives_go(spark):
    from rowstream.llm import urlfilter

    rules = spark.createDataFrame([(f"h{i}.org", f"/{i % 7}/", "block") for i in range(300)], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, f"https://www.h{i}.org/{i % 7}/x?y") for i in range(600)] + [(1000 + i, f"https://h{i}.org/{(i + 1) % 7}/") for i in range(300)], "page_id long, url string")
    got = urlfilter.judge_urls(pages, rules)
    assert sorted(r.page_id for r in got.where("verdict = 'block'").collect()) == list(range(300))


def plain_copies(sizes, target):
    """Copies wanted by size: at most 3, in proportion to the root of the length class, adding up to the target."""
    sizes = [n for n in sizes if n]
    appeal = {n: 2 ** (-math.floor(math.log2(n) * mixing.CLASSES) * mixing.DAMPING / mixing.CLASSES) for n in sizes}
    low, high = 0.0, 1e6
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(n * min(3, level * appeal[n]) for n in sizes) < target else (low, level)
    return {n: round(min(3, high * appeal[n]), 9) for n in sizes}


def test_op7_inclusion_frequencies(spark):
    """Documents of three lengths in one source of two: extra copies come as often as their chances say."""
    rows = [(i, "w " * (4, 25, 160)[i % 3], "a") for i in range(6000)] + [(9000 + i, "w " * 300, "b") for i in range(800)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 3)).where("source = 'a'").toPandas()
    wants = plain_copies(list(got["size"]), got.target[0])
    assert len({round(w % 1, 3) for w in wants.values()}) == 3  # unequal
    for n, part in got.groupby("size"):
        chance = wants[n] % 1
        extra = part.copies - math.floor(wants[n])
        assert set(extra) <= {0, 1}
        assert abs(extra.mean() - chance) <= 4 * (chance * (1 - chance) / len(part)) ** 0.5 + 0.005
    assert abs(got.taken.sum() - got.target[0]) <= 80


def plain_mix(docs):
    """(doc_id, text hash) to (words taken, target) for a frame of doc_id, text, source without repeated rows."""
    hashed = docs.select("doc_id", "text", "source", F.xxhash64("text").alias("h"))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(20), "doc_id", "h"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    rows = [(r.doc_id, r.h, r.source, len(SPACE.findall(r.text or "")), r.u) for r in hashed.withColumn("u", uniform).collect()]
    sizes: dict = collections.Counter()
    for _, _, s, n, _ in rows:
        sizes[s] += n
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, total = {}, sum(sizes.values())
    free = set(names)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free -= over
    target |= {s: level * weight[s] for s in free}
    odds = lambda p: p / (1 - p)
    out = {}
    for s in names:
        own = [r for r in rows if r[2] == s]
        wants = plain_copies([r[3] for r in own], target[s])
        out |= {r[:2]: (r[3] * math.floor(wants.get(r[3], 0)), target[s]) for r in own}
        rest, done = target[s] - sum(out[r[:2]][0] for r in own), 0
        for r in sorted((r for r in own if r[3] and wants[r[3]] % 1 > 0), key=lambda r: odds(r[4]) / odds(wants[r[3]] % 1)):
            out[r[:2]] = (out[r[:2]][0] + r[3] * (done + r[3] / 2 <= rest), target[s])
            done += r[3]
    return out


def test_op7_targets_and_order(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 10, 40])), rng.choice(["b", "a", "\u00e9", None, "c"])) for i in range(500)] + [(900, "w " * 5, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).toPandas()
    want = plain_mix(docs)
    assert {(r.doc_id, r.text_hash): r.taken for r in got.itertuples()} == {k: v[0] for k, v in want.items()}
    assert all(r.target == pytest.approx(want[(r.doc_id, r.text_hash)][1]) and r.taken <= 3 * r.size for r in got.itertuples())
    for _, part in got.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() / 2 + 1e-6
    again = mixing.mix_sources(docs.repartition(7)).toPandas()
    assert sorted(zip(got.doc_id, got.taken)) == sorted(zip(again.doc_id, again.taken))


def luhn(text):
    d = [int(c) for c in text if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


PRIVATE = ["4111 1111 1111 1111", "378282246310005", "+1 (212) 555-1234", "1-212-555-1234", "(212) 555-1234", "10.0.0.1", "255.255.255.255", "123-45-6789", "2021-02-28", "12/31/1999", "31.12.2050", "a.b+C9@x.example.org", "0123456789abcdef0123456789abcdef01234567", "0123456789ABCDEF0123456789ABCDEF01234567", "212 555 0199", "+1 (017) 155-1234", "(103) 555-1234"]
PUBLIC = ["112 555 0199", "212 055 0199", "010.1.1.1", "4111 111 1111 11", "4111 1111 1111 1112", "000-45-6789", "2021-02-30", "10.0.0.256", "1.2.3.4.5", "12345", "version 1.2.3", "x@y", "99/99/1999", "deadbeef"]


def test_op8_round_trip_and_format(spark):
    text = "; ".join([*PRIVATE, *PUBLIC])
    docs = spark.createDataFrame([(1, text), (2, "at the end 10.0.0.1"), (3, "10.0.0.1###")], "doc_id long, text string")
    made = pii.pseudonymise(docs, "k", counts=True).orderBy("doc_id").collect()
    parts = made[0].text.split("; ")
    assert made[0].pii_found == len(PRIVATE) and parts[len(PRIVATE) :] == PUBLIC
    for old, new in zip(PRIVATE, parts, strict=False):
        assert old != new
        shape = lambda v: re.sub(r"[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", v)))
        if len(old) != 40:
            assert shape(old) == shape(new)
    secret, loud = (v for v in parts if len(v) == 40)
    assert secret.upper() == loud and re.fullmatch("[0-9a-f]{40}", secret)
    assert luhn(parts[0]) and luhn(parts[1])
    phones = [re.sub(r"\D", "", p)[-10:] for p in parts[2:5]]
    assert len(set(phones)) == 1
    assert made[1].text.split()[-1] == made[2].text.removesuffix("###") == parts[5]
    back = pii.pseudonymise(spark.createDataFrame([(1, made[0].text)], "doc_id long, text string"), "k", undo=True).first()
    assert back.text == text
    other = pii.pseudonymise(docs, "another").first()
    assert other.text != made[0].text
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")


def plain_feistel(left, right, a, b, key, kind):
    for n in range(pii.ROUNDS):
        noise = lambda other: int(hashlib.sha256(f"{key}|{kind}|{n}|{other}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if n % 2 == 0:
            left = (left + noise(right) % a) % a
        else:
            right = (right + noise(left) % b) % b
    return left, right


def plain_pseudonym(value, key):
    """Numbers only, from the definition of their domains."""
    digits = re.sub("[^0-9]", "", value)
    if re.fullmatch(r"\d+(\.\d+){3}", value):
        o = [int(x) for x in value.split(".")]
        low = [0 if x < 10 else 10 if x < 100 else 100 for x in o]
        many = [{0: 10, 10: 90, 100: 156}[x] for x in low]
        x = [v - w for v, w in zip(o, low, strict=True)]
        l, r = plain_feistel(x[0] * many[1] + x[1], x[2] * many[3] + x[3], many[0] * many[1], many[2] * many[3], key, "address")
        return ".".join(str(v + w) for v, w in zip((l // many[1], l % many[1], r // many[3], r % many[3]), low, strict=True))
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", value):
        areas = [x for x in range(1, 900) if x != 666]
        l, r = plain_feistel(areas.index(int(value[:3])) * 99 + int(value[4:6]) - 1, int(value[7:]) - 1, 898 * 99, 9999, key, "ssn")
        return f"{areas[l // 99]:03d}-{l % 99 + 1:02d}-{r + 1:04d}"
    if re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        day = (datetime.date.fromisoformat(value) - datetime.date(1900, 1, 1)).days
        l, r = plain_feistel(day // 229, day % 229, 319, 229, key, "date")
        return str(datetime.date(1900, 1, 1) + datetime.timedelta(l * 229 + r))
    if len(digits) >= 13:
        half = (len(digits) - 1) // 2
        l, r = plain_feistel(int(digits[:half]), int(digits[half:-1]), 10**half, 10 ** (len(digits) - 1 - half), key, "card")
        body = f"{l:0{half}d}{r:0{len(digits) - 1 - half}d}"
        out = next(body + c for c in "0123456789" if luhn(body + c))
    else:
        area, exchange, line = int(digits[-10:-7]), int(digits[-7:-4]), int(digits[-4:])
        (la, na), (le, ne) = ((200, 800) if x >= 200 else (0, 200) for x in (area, exchange))
        l, r = plain_feistel((area - la) * ne + exchange - le, line, na * ne, 10_000, key, "phone")
        out = digits[:-10] + f"{l // ne + la:03d}{l % ne + le:03d}{r:04d}"
    taken = iter(out)
    return "".join(next(taken) if c.isdigit() else c for c in value)


def test_op8_equals_plain_feistel(spark):
    rng = random.Random(6)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = [f"{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(60)]
    values += [f"{rng.choice([1, 665, 667, 899]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10000):04d}" for _ in range(40)]
    values += [str(datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73048))) for _ in range(40)]
    values += [f"+1 ({d(3)}) {d(3)}-{d(4)}" for _ in range(60)] + [v for v in (f"{d(3)}-{d(3)}-{d(4)}" for _ in range(60)) if v[0] > "1" and v[4] > "1"]
    values += [next(body + c for c in "0123456789" if luhn(body + c)) for body in (d(rng.randrange(12, 19)) for _ in range(40))]
    got = pii.pseudonymise(spark.createDataFrame([(i, f"see {v}, and") for i, v in enumerate(values)], "doc_id long, text string"), "key").orderBy("doc_id").collect()
    for v, r in zip(values, got, strict=True):
        assert r.text == f"see {plain_pseudonym(v, 'key')}, and", v


def test_op8_permutes_whole_domains(spark):
    small = spark.range(6 * 5).select(pii.feistel(F.floor(F.col("id") / 5), F.col("id") % 5, 6, 5, "k", "t").alias("p")).collect()
    assert sorted((r.p.l, r.p.r) for r in small) == [(a, b) for a in range(6) for b in range(5)]
    days = spark.range(pii.DAYS[0] * pii.DAYS[1]).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("d")).where("pmod(xxhash64(d), 20) = 0")
    got = days.select(pii.pseudonym(F.col("d"), "k").alias("p"), "d").collect()
    assert len({r.p for r in got}) == len(got) and min(r.p for r in got) >= "1900-01-01" and max(r.p for r in got) <= "2099-12-31"


def test_op9_finds_planted_passages(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    rows, where = [], {}
    for i in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(80, 300))]
        if i % 4 == 0:
            own = list(passage)
            for _ in range(i // 10):
                own[rng.randrange(70)] = "changed"
            if i == 36:
                own.insert(35, "extra")
            at = rng.randrange(len(words))
            words[at:at] = own
            where[i] = (at, at + len(own))
        rows.append((i, " ".join(words)))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(where) - {0} and {r.source_doc_id for r in got} == {0}
    for r in got:
        a, b = where[r.doc_id]
        assert abs(r.start_word - a) <= 4 and abs(r.end_word - b) <= 4 and r.equal_words >= 60


def test_op9_repeats_within_both_texts(spark):
    rng = random.Random(3)
    block = [f"b{rng.randrange(10**6)}" for _ in range(25)]
    rows = [(i, " ".join([f"u{i}"] * i + block * 4)) for i in (1, 2)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    covered = {w for r in got for w in range(r.start_word, r.end_word)}
    assert covered == set(range(2, 102)) and {(r.doc_id, r.source_doc_id) for r in got} == {(2, 1)}


def test_op9_lines_that_stand_singly_before(spark):
    rng = random.Random(12)
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows, whole = [], 20
    for i in range(whole):
        lines = [own(20) for _ in range(3)]
        rows += [(i * 10 + j, " ".join(own(30) + line + own(30))) for j, line in enumerate(lines)]
        rows += [(i * 10 + j, " ".join(own(40) + sum(lines, []) + own(40))) for j in (7, 8)]
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(i * 10 + 8, i * 10 + 7) for i in range(whole)}


def test_op9_parts_of_a_chain_that_is_not_alike(spark):
    rng = random.Random(4)
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    one, two = own(60), own(60)
    rows = [(1, " ".join(one + own(22) + two)), (2, " ".join(own(5) + one + own(22) + two)), (3, " ".join(own(9) + one + own(9) + two))]
    got = sorted((r.doc_id, r.start_word, r.end_word, r.equal_words) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r for r in got if r[0] == 2] in ([(2, 5, 147, 120)], [(2, 5, 65, 60), (2, 87, 147, 60)])
    x = np.array([0, 30, 90, 120])
    u, v = np.arange(200), np.arange(200)
    v[35:90] = -1  # two runs of equal words with 55 others between
    assert sorted(p[:2] for p in passages.passages_of(x, x, u, v, 5, 30, 0.8)) == [(0, 35), (90, 200)]


def test_op9_recall_of_edited_passages(spark):
    """Shares found of passages of 60 words that brute force finds (equal words by place), by chance of a replaced word."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, due = [], {}
    for rate in (0.0, 0.05, 0.1, 0.15):
        for _ in range(60):
            n, passage = len(rows), some(60)
            copy = [f"x{rng.randrange(10**9)}" if rng.random() < rate else w for w in passage]
            rows += [(n, " ".join(some(50) + passage + some(50))), (n + 1, " ".join(some(50) + copy + some(50)))]
            if sum(a == b for a, b in zip(passage, copy, strict=True)) >= 0.8 * 60:
                due.setdefault(rate, set()).add((n + 1, n))
    got = {(r.doc_id, r.source_doc_id) for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = {rate: len(pairs & got) / len(pairs) for rate, pairs in due.items()}
    assert share[0.0] == 1 and share[0.05] >= 0.95 and share[0.1] >= 0.75 and share[0.15] >= 0.5 and got <= set().union(*due.values()) | {(i + 1, i) for i in range(0, len(rows), 2)}


def spoiled(words, places, name):
    return [f"{name}{i}" if i in places else w for i, w in enumerate(words)]


def test_op9_finds_what_is_just_within_the_limit(spark):
    """50 words with every fifth changed; and texts alike to the one before but not to the first that holds their seeds."""
    rng = random.Random(21)
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows, due = [], set()
    for i in range(0, 400, 10):
        passage = own(50)
        rows += [(i + 1, " ".join(own(40) + passage + own(40))), (i + 2, " ".join(own(40) + spoiled(passage, range(4, 50, 5), "x") + own(40)))]
        due.add((i + 2, i + 1))
    for i in range(400, 600, 10):
        passage = own(60)
        one, other = spoiled(passage, range(3, 59, 7), "x"), spoiled(passage, range(6, 59, 7), "y")
        rows += [(i + j, " ".join(own(40) + text + own(40))) for j, text in enumerate((one, passage, other))]
        due |= {(i + 1, i), (i + 2, i + 1)}
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == due
    assert all(r.equal_words >= 0.8 * max(r.end_word - r.start_word, r.source_end - r.source_start) for r in got)


def test_op9_frequent_lines_beside_what_two_share(spark):
    rng = random.Random(22)
    own = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    line, long_line = own(12), own(30)
    rows, due = [], set()
    for i in range(0, 2 * passages.FREQUENT, 2):
        common, extra = (line, 45) if i % 4 else (long_line, 25)
        passage = own(extra)
        rows += [(i, " ".join(own(60) + common + passage + own(60))), (i + 1, " ".join(own(60) + common + spoiled(passage, range(4, extra, 5), "x") + own(60)))]
        due.add((i + 1, i))
    got = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == due


def test_op9_parts_of_the_second_join_make_the_whole(spark, monkeypatch):
    rng = random.Random(6)
    own = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    lines, rows = [own(20) for _ in range(3)], []
    rows += [(i, " ".join(own(30) + line + own(30))) for i, line in enumerate(lines)]
    rows += [(3 + i, " ".join(own(30) + sum(lines, []) + own(30))) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, passages.repeated_passages(df).collect()))
    monkeypatch.setattr(passages, "MEETINGS", 200)
    assert {(a, b) for a, _, _, b, *_ in whole} >= {(i, j) for i in range(4, 15) for j in range(3, i)}
    assert sorted(map(tuple, passages.repeated_passages(df).collect())) == whole


def test_op9_words_in_common_near_a_chain():
    spans = lambda *words: pa.array([list(w) for w in words], pa.list_(pa.int32()))
    run, other = [7] * 26, list(range(100, 200))
    u, v = [run + other, run + other[:14]], [run + [n + 900 for n in other], run + other[13::-1]]
    chain = spans(*[range(24)] * 2)
    low = pa.array([0, 0], pa.int32())
    ids = pa.array([1, 2], pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, ids, low, low, chain, chain, spans(*u), spans(*v)], list("abcdefgh"))
    assert passages.worth(batch, 3, 50, 0.8).tolist() == [1]


def plain_chains(x, y, k, cost):
    n = len(x)
    score = [k] * n
    for i in range(n):
        for j in range(n):
            if x[j] < x[i] and y[j] < y[i]:
                score[i] = max(score[i], k + score[j] - cost * ((x[i] - x[j]) + (y[i] - y[j])))
    return score


def test_op9_chaining_is_optimal():
    rng = random.Random(1)
    for _ in range(50):
        n = rng.randrange(1, 30)
        pts = sorted((rng.randrange(60), rng.randrange(60)) for _ in range(n))
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        found = passages.chains(x, y, 6, 0.15)
        assert sorted(i for c in found for i in c) == list(range(n))
        best = found[0]
        assert all(x[a] < x[b] and y[a] < y[b] for a, b in zip(best, best[1:], strict=False))
        value = 6 * len(best) - 0.15 * ((x[best[-1]] - x[best[0]]) + (y[best[-1]] - y[best[0]]))
        assert value == pytest.approx(max(plain_chains(x, y, 6, 0.15)))


def plain_distance(item, text):
    prev = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        cur = [i]
        for j, d in enumerate(text, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != d)))
        prev = cur
    return min(prev)


def test_op10_equals_plain_search(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("th", "er", "on", "an", "re") for b in ("ing", "ed", "ly", "er", "est", "ion")]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randrange(12, 40))) for i in range(12)]
    docs = []
    for d in range(120):
        text = say(rng.randrange(5, 60))
        if d % 3 == 0:
            leak = list(items[d % 12][1])
            for _ in range(rng.randrange(0, 16)):
                p, r = rng.randrange(len(leak)), rng.random()
                leak[p : p + 1] = [] if r < 0.3 else [rng.choice("abcdef")] if r < 0.7 else [leak[p], rng.choice("abcdef")]
            text = f"{text} {''.join(leak)} {say(5)}"
        docs.append((d, text))
    got = {r.doc_id: set(r.item_ids) for r in decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for d, text in docs:
        want = {i for i, item in items if plain_distance(item, text) <= int(decontam.BUDGET * len(item))}
        assert got[d] == want, d


def test_scan_does_not_depend_on_the_batch():
    import pyarrow as pa

    texts = ["one two", None, "", "three", " four  five ", "six"]
    alone = [textscan.Prefix(textscan.LOWER[p.data]).ranges(*p.words()[:2]).tolist() for t in texts for p in textscan.slices(pa.array([t], pa.string()))]
    for limit in (1, 9, 1 << 20):
        out = []
        for p in textscan.slices(pa.array(texts, pa.string()), limit):
            s, e, first = p.words()
            h = textscan.Prefix(p.data).ranges(s, e)
            out += [h[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        assert out == alone


def test_tables_that_are_read_outlast_the_others(spark):
    from rowstream.llm.common import Tables

    tables = Tables(spark, "run")
    first, second = tables.write(spark.range(5), "x"), tables.write(spark.range(6), "x")
    tables.free(second)
    third = tables.write(spark.range(7), "x")
    assert (second.count(), third.count()) == (6, 7) and len(tables.made) == 2
    with pytest.raises(Exception, match="(?i)not exist"):
        first.count()
