"""Quality by ordinal regression: a cumulative-link model on hashed text features.

Grades 0 to G-1 share one weight vector; P(grade >= j) is the logistic of (w . x - threshold_j), with thresholds in
ascending order. From it follow the expected grade and the tail probability by which documents are selected.

Features of a text, hashed to 2^``BITS`` places: each distinct word (letters and digits, in lower case) counts 1; each
word shape (runs of small letters, capitals, digits and each other character, collapsed) counts the root of its share
of the words; so does the repetition of the word before. The whole text is read.

Before the fit, features are screened: only those that mark lower grades than the mean stay. This keeps rare words from
being learned by heart, and a text without any such mark, however short, gets the grade of the unmarked majority. The
model is fitted on at most ``max_train_rows`` rated rows, drawn by a hash of the id; that bound also bounds what
reaches the driver. Scoring reads every row.

Defined results: a null or blank text has no features and is scored by the thresholds alone. Of several ratings for an
id, the lowest counts; ratings that are null are passed over. Without any rating, or with one grade only, nothing can be
learned: every row gets that grade (the highest, if there is none) and is selected if it is the highest. Rows that
repeat are scored alike; rated rows that repeat an id count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from rowstream.llm import textscan
from rowstream.llm.common import small_batches

BITS = 18
MAX_TRAIN_ROWS = 12_000
STEPS, RATE, DECAY = 200, 0.1, 1e-5
#: A feature is used if it occurs in so many rated rows and their mean grade is so many standard errors below the overall mean.
LEAST_ROWS, LEAST_Z = 3, 4.0

_CORE = np.zeros(256, bool)
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = _CORE[128:] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 97


def features(part: textscan.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, value) of all features of a slice's texts, by row."""
    data, n = part.data, part.n
    edge = np.zeros(len(data) + 1, bool)
    edge[part.bounds] = True
    core = _CORE[data]
    begin = core.copy()
    begin[1:] &= ~core[:-1] | edge[1:-1]
    end = core.copy()
    end[:-1] &= ~core[1:] | edge[1:-1]
    start, stop = np.flatnonzero(begin), np.flatnonzero(end) + 1
    row = np.searchsorted(part.bounds, start, "right") - 1
    place = textscan.Prefix(textscan.LOWER[data]).ranges(start, stop) >> np.uint64(64 - BITS)
    words = np.unique((row.astype(np.int64) << BITS) | place.astype(np.int64))

    start, stop, first = part.words()
    row = np.repeat(np.arange(n), np.diff(first))
    shape = _SHAPE[data]
    turn = np.ones(len(data), bool)
    turn[1:] = shape[1:] != shape[:-1]
    turn[start] = True
    kept = np.concatenate([[0], np.cumsum(turn)])
    forms = textscan.mix(textscan.Prefix(shape[turn]).ranges(kept[start], kept[stop]) + np.uint64(1)) >> np.uint64(64 - BITS)
    whole = textscan.Prefix(data).ranges(start, stop)
    again = np.flatnonzero((whole[1:] == whole[:-1]) & (row[1:] == row[:-1])) + 1
    keys = np.concatenate([(row.astype(np.int64) << BITS) | forms.astype(np.int64), row[again].astype(np.int64) << BITS])
    shapes, count = np.unique(keys, return_counts=True)
    share = np.sqrt(count / np.maximum(1, np.diff(first))[shapes >> BITS])
    both = np.concatenate([words, shapes])
    order = np.argsort(both >> BITS, kind="stable")
    both = both[order]
    return both >> BITS, both & ((1 << BITS) - 1), np.concatenate([np.ones(len(words)), share])[order]


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray) -> None:
        self.weights, self.thresholds = weights, thresholds

    def tails(self, latent: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. G-1, a column each."""
        return 1 / (1 + np.exp(-np.clip(latent[:, None] - self.thresholds[None, :], -40, 40)))

    def latent(self, part: textscan.Slice) -> np.ndarray:
        row, place, value = features(part)
        return np.bincount(row, self.weights[place] * value, part.n)


def _thresholds(ends: np.ndarray) -> np.ndarray:
    """The first threshold and the logarithms of the gaps to thresholds."""
    return ends[0] + np.concatenate([[0], np.cumsum(np.exp(ends[1:]))])


def loss_and_gradient(theta: np.ndarray, row: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood plus the weights' decay, and its gradient. ``theta``: the weights, then the first
    threshold and the logarithms of the gaps."""
    n, features_used = len(grade), len(theta) - grades + 1
    w, ends = theta[:features_used], theta[features_used:]
    z = np.bincount(row, w[place] * value, n)
    tail = 1 / (1 + np.exp(-np.clip(z[:, None] - _thresholds(ends)[None, :], -40, 40)))
    full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
    p = np.maximum(full[np.arange(n), grade] - full[np.arange(n), grade + 1], 1e-9)
    slope = full * (1 - full)
    up, down = slope[np.arange(n), grade], slope[np.arange(n), grade + 1]
    dt = np.zeros((n, grades + 1))
    dt[np.arange(n), grade] += up / p / n
    dt[np.arange(n), grade + 1] -= down / p / n
    by_threshold = dt[:, 1:grades].sum(axis=0)
    after = np.cumsum(by_threshold[::-1])[::-1]
    dw = np.bincount(place, ((down - up) / p / n)[row] * value, features_used) + DECAY * w
    return float(-np.log(p).mean() + DECAY * (w @ w) / 2), np.concatenate([dw, after[:1], after[1:] * np.exp(ends[1:])])


def fit_arrays(at: np.ndarray, place: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> Model:
    """Fit by full-batch Adam. Row i has the features from at[i] to at[i + 1]."""
    n = len(grade)
    row = np.repeat(np.arange(n), np.diff(at))
    rows_with = np.bincount(place, minlength=1 << BITS)
    mean = np.bincount(place, grade[row].astype(float), 1 << BITS) / np.maximum(1, rows_with)
    z = (grade.mean() - mean) * np.sqrt(rows_with) / max(float(grade.std()), 1e-9)
    kept = ((rows_with >= LEAST_ROWS) & (z >= LEAST_Z))[place]
    row, place, value = row[kept], place[kept], value[kept]
    used, place = np.unique(place, return_inverse=True)
    share = np.array([(grade >= j).mean() for j in range(1, grades)]).clip(1 / (n + 2), 1 - 1 / (n + 2))
    base = np.log((1 - share) / share)  # ascending: tails fall
    gaps = np.log(np.maximum(np.diff(base), 1e-2))
    theta = np.concatenate([np.zeros(len(used)), base[:1], gaps])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        _, grad = loss_and_gradient(theta, row, place, value, grade, grades)
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        rate = RATE * (1 - step / (STEPS + 1)) ** 0.5
        theta = theta - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    weights = np.zeros(1 << BITS)
    weights[used] = theta[: len(used)]
    return Model(weights, _thresholds(theta[len(used) :]))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in textscan.slices(batch.column(1)):
            row, place, value = features(part)
            at = pa.array(np.searchsorted(row, np.arange(part.n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part.first, part.n), pa.ListArray.from_arrays(at, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(value.astype(np.float32)))],
                ["grade", "place", "value"],
            )


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, max_train_rows: int = MAX_TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model | int:
    """Fit on the rated rows of ``docs``; ``ratings``: doc_id, grade. Returns the only grade if there is just one."""
    small_batches(docs.sparkSession)
    rated = ratings.where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1)).groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    n = rated.count()
    if n > max_train_rows:
        rated = rated.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)) < int((1 << 20) * max_train_rows / n))
    rated = F.broadcast(rated.select(F.col("doc_id").alias("__rated"), "grade"))  # at most about max_train_rows rows
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).join(rated, F.col("__id") == F.col("__rated")).select("grade", "__text")
    found = rows.mapInArrow(_vectors, "grade int, place array<int>, value array<float>").toArrow()
    grade = np.asarray(found.column("grade").combine_chunks()).astype(np.int64)
    if len(np.unique(grade)) < 2:
        return int(grade[0]) if len(grade) else grades - 1
    places = found.column("place").combine_chunks()
    at = np.asarray(places.offsets) - places.offsets[0].as_py()
    return fit_arrays(at, np.asarray(places.flatten()), np.asarray(found.column("value").combine_chunks().flatten()).astype(float), grade, grades)


def score(docs: DataFrame, model: Model | int, grades: int = 3, text_col: str = "text", out: tuple[str, str] = ("expected_grade", "tail_prob")) -> DataFrame:
    """``docs`` with the expected grade (0 to G-1) and the chance of the highest grade; columns named ``out`` are replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in out]
    kept = docs.select(*names)
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            expected, tail = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            if isinstance(known, int):
                expected[:], tail[:] = known, float(known == grades - 1)
            else:
                for part in textscan.slices(batch.column(at)):
                    tails = known.tails(known.latent(part))
                    rows = slice(part.first, part.first + part.n)
                    expected[rows], tail[rows] = tails.sum(axis=1), tails[:, -1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(expected), pa.array(tail)], [*names, *out])

    schema = StructType(list(kept.schema.fields)).add(out[0], DoubleType()).add(out[1], DoubleType())
    return kept.mapInArrow(run, schema)


def rating(labels: DataFrame) -> DataFrame:
    """Grades from two judgements: one point for quality, one for not being toxic."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))


def select_quality(docs: DataFrame, labels: DataFrame, least_tail: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows whose chance of the highest grade is below ``least_tail``; all columns stay as they are."""
    model = fit(docs, rating(labels), text_col=text_col, **options)
    scored = score(docs, model, text_col=text_col, out=("__expected", "__tail"))
    return scored.where(F.col("__tail") >= least_tail).select(*docs.columns)
