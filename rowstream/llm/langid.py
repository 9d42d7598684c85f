"""Language identification with a bit-sliced Bloom filter of n-grams.

The filter is a table of slots; a slot holds one bit for each language. An n-gram names ``HASHES`` slots, and the AND of
them has the bit of every language that contains it, so one probe answers for all languages. A text's n-grams are
counted for each language by its bit; the count is corrected for false positives, whose rate follows from the share of
slots that have the language's bit; the language with the greatest corrected count is predicted.

Learning counts, for each n-gram, the documents of each language that have it. A language contains an n-gram if enough
of its documents do (``LEAST_DOCS`` and ``LEAST_RATE``) and if its rate is no less than ``LEAST_SHARE`` of the greatest
rate of any language: strays from mislabelled or mixed documents stay out. At most ``max_train_rows`` labelled rows are
read, drawn by a hash of the id; the table's size is fixed, so what reaches the driver and the executors is bounded.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was
learned. Ties go to the language that comes first by code point. An id that is null is not held out nor learned from.
Rows that repeat are predicted alike, and each is learned from. Only the named columns are read, so others may have any
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowstream.llm import textscan
from rowstream.llm.common import small_batches

SIZES = (2, 3, 4)
SLOT_BITS = 20
HASHES = 3
LANGS_A_PLANE = 63
LEAST_DOCS = 2
LEAST_RATE = 0.005
LEAST_SHARE = 0.25
MAX_TRAIN_ROWS = 30_000
SLICE_BYTES = 1 << 20

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, texts[at:]


def text_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: hashes of the n-grams of all texts, and the text each comes from. Letters are in lower case; what
    stands between two runs of letters is one blank."""
    data = np.frombuffer("\0".join(t.replace("\0", " ") for t in texts).lower().encode("utf-32-le"), np.uint32)
    stop = data == 0
    letter = letters()[data]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep &= ~stop
    owner = np.cumsum(stop)[keep]
    code = textscan.mix(np.where(letter, data, 32)[keep].astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(code), np.uint64)
    for n in range(1, max(SIZES) + 1):
        if len(code) < n:
            return
        total = total[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :]
        if n in SIZES:
            same = owner[: len(total)] == owner[n - 1 :]
            yield textscan.mix(total[same] + np.uint64(n)), owner[: len(total)][same]


def slots_of(grams: np.ndarray, i: int) -> np.ndarray:
    step = (grams & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return (((grams >> np.uint64(32)) + np.uint64(i) * step) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, docs): in how many texts of a language each n-gram occurs, by batch."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            for _, group in _groups([t for t, own in zip(texts, langs, strict=True) if own == lang]):
                for grams, owner in text_grams(group):
                    order = np.lexsort((owner, grams))
                    g, o = grams[order], owner[order]
                    new = np.ones(len(g), bool)
                    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
                    found, docs = np.unique(g[new], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)), pa.array(docs)], ["lang", "gram", "docs"])


class Filter:
    """The learned table: ``planes[p][slot]`` has the bits of languages 63p to 63p + 62."""

    def __init__(self, langs: list[str], planes: np.ndarray) -> None:
        self.langs, self.planes = langs, planes
        bits = [(planes[i // LANGS_A_PLANE] >> np.uint64(i % LANGS_A_PLANE)) & np.uint64(1) for i in range(len(langs))]
        self.false = np.array([(b.mean() if len(b) else 0.0) ** HASHES for b in bits])

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Corrected shares of n-grams for each text and language, and whether a text has a letter."""
        hits = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        for grams, owner in text_grams(texts):
            total += np.bincount(owner, minlength=len(texts))
            at = [slots_of(grams, i) for i in range(HASHES)]
            for p, plane in enumerate(self.planes):
                mask = plane[at[0]]
                for slot in at[1:]:
                    mask &= plane[slot]
                for i in range(p * LANGS_A_PLANE, min(len(self.langs), (p + 1) * LANGS_A_PLANE)):
                    hit = ((mask >> np.uint64(i % LANGS_A_PLANE)) & np.uint64(1)).astype(bool)
                    hits[:, i] += np.bincount(owner[hit], minlength=len(texts))
        wrong = total[:, None] * self.false[None, :]
        return np.maximum(0, hits - wrong) / np.maximum(1, total[:, None] * (1 - self.false[None, :])), total > 0

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        named, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return named, score
        for at, group in _groups([t or "" for t in texts]):
            share, some = self.scores(group)
            # a lone letter has no n-gram, but is a letter
            some |= np.array([any(map(str.isalpha, t[:64])) or any(map(str.isalpha, t)) for t in group])
            best = share.argmax(axis=1)
            for j in np.flatnonzero(some):
                named[at + j] = self.langs[best[j]]
                score[at + j] = min(1.0, float(share[j, best[j]]))
        return named, score


def learn(train: DataFrame, lang_col: str = "lang", text_col: str = "text", max_train_rows: int = MAX_TRAIN_ROWS, id_col: str = "doc_id") -> Filter:
    """Learn a filter from labelled rows; rows without a language or a text are passed over."""
    small_batches(train.sparkSession)
    rows = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.count()
    if n > max_train_rows:
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int((1 << 20) * max_train_rows / n))
    in_lang = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(in_lang)
    planes = -(-max(1, len(langs)) // LANGS_A_PLANE)
    table = np.zeros((planes, 1 << SLOT_BITS), np.uint64)
    if langs:
        counted = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(_count, "lang string, gram long, docs long")
        known = rows.sparkSession.createDataFrame([(x, i, float(in_lang[x])) for i, x in enumerate(langs)], "lang string, i int, n double")
        rates = counted.groupBy("lang", "gram").agg(F.sum("docs").alias("docs")).join(F.broadcast(known), "lang").withColumn("rate", F.col("docs") / F.col("n"))
        enough = (F.col("docs") >= F.least(F.lit(LEAST_DOCS), F.col("n"))) & (F.col("rate") >= LEAST_RATE)
        best = rates.groupBy("gram").agg(F.max("rate").alias("best"), F.collect_list(F.struct("i", "docs", "n", "rate")).alias("of"))
        kept = best.select("gram", "best", F.explode("of").alias("o")).select("gram", "best", "o.*").where(enough & (F.col("rate") >= LEAST_SHARE * F.col("best")))
        step = F.col("gram").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1))
        slots = F.array(*[(F.shiftrightunsigned("gram", 32) + i * step).bitwiseAND(F.lit((1 << SLOT_BITS) - 1)) for i in range(HASHES)])
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i") % LANGS_A_PLANE)
        made = kept.select(F.explode(slots).alias("slot"), F.floor(F.col("i") / LANGS_A_PLANE).alias("plane"), bit.alias("bit"))
        # one row for each slot at most: a bounded table
        got = made.groupBy("plane", "slot").agg(F.bit_or("bit").alias("bits")).toPandas()
        table[got["plane"].to_numpy(), got["slot"].to_numpy()] = got["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return Filter(langs, table)


def identify(docs: DataFrame, learned: Filter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(learned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            named, score = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(named, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Every fourth part by the checksum of the id's digits."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_documents(docs: DataFrame, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """Learn from the rows that aren't held out and predict every row."""
    learned = learn(docs.where(~held_out() & F.col("doc_id").isNotNull()), max_train_rows=max_train_rows)
    return identify(docs, learned).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
