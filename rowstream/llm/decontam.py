"""Benchmark decontamination by the q-gram lemma.

Texts and items are reduced to letters and digits in lower case with single blanks. Items longer than ``WINDOW`` reduced
characters are cut into windows of that length at steps of ``STEP`` (the last one ends with the item), so that a part of
an item is found too: any copied stretch of ``WINDOW`` + ``STEP`` - 1 characters holds a whole window.

A piece (a window or a whole shorter item) of m characters and an edit budget of e = floor(``budget`` * m) edits shares
at least m - q + 1 - q * e q-grams with any passage within its budget, and these lie on diagonals (place in the text less
place in the piece) no more than e apart. The bound says something only if it is 1 or more, so each piece takes q =
min(``Q``, floor(m / (e + 1))); an item too short for any edit thus is searched exactly. Shared q-grams are counted in
overlapping bands of diagonals, two budgets wide; a band that reaches the bound is a region, and a region is verified by
a banded alignment that must place the whole piece within its budget. Every passage within the budget of a piece has a
hit; a hit of an item joins the hits of its windows that overlap, and has the most edits of any of them.

Items of fewer than ``WHOLE_WORDS`` reduced characters are found only where they stand as whole words.

Items are processed in blocks of bounded size, each sent to the executors by broadcast, so no table is assumed small.

Defined results: null and empty texts, and texts or items without a letter or digit, have no hits; items that repeat are
found each under its own id; an item without an id is passed over. Every input row gives one output row, so rows of
documents that repeat are judged alike; a column named as the hits is replaced, and all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from rowstream.llm import textscan
from rowstream.llm.common import small_batches

Q = 10
BUDGET = 0.08
WINDOW, STEP = 200, 100
WHOLE_WORDS = 10
#: Characters of items in a block.
BLOCK_CHARS = 4 << 20
TABLE_BITS = 22
#: Characters of texts that are searched at a time.
SLICE_CHARS = 1 << 19
HIT = "array<struct<item_id:long,start:long,end:long,edits:int>>"
_HIT = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))

_lower: np.ndarray | None = None
_word: np.ndarray | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its small letter (where that is one code point), and whether it is a letter or digit."""
    global _lower, _word
    if _lower is None:
        small = (chr(i).lower() for i in range(0x110000))
        _lower = np.fromiter((ord(s) if len(s) == 1 else i for i, s in enumerate(small)), np.uint32, 0x110000)
        _word = np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)
    return _lower, _word


def reduce(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Reduced characters of all texts, the place of each in its text, and where each text begins in them."""
    lower, word = _tables()
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    is_word = word[data]
    keep = is_word.copy()
    keep[1:] |= is_word[:-1]
    first = bounds[:-1][np.diff(bounds) > 0]
    keep[first] = is_word[first]
    at = np.flatnonzero(keep)
    starts = np.searchsorted(at, bounds)
    out = np.where(is_word, lower[data], 32)[at]
    return out, at - np.repeat(bounds[:-1], np.diff(starts)), starts


def grams(chars: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, made for stretches of a slice at a time."""
    out = np.empty(max(0, len(chars) - q + 1), np.uint64)
    for i in range(0, len(out), textscan.SLICE_BYTES - q):
        part = chars[i : i + textscan.SLICE_BYTES - 1]
        p, back = textscan.powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(textscan.mix(part.astype(np.uint64) + np.uint64(1)) * p[:-1], out=sums[1:])
        n = len(part) - q + 1
        out[i : i + n] = textscan.mix((sums[q:] - sums[:-q]) * back[:n])
    return out


class Items:
    """A block of items, cut into pieces, with a q-gram table for each q that their lengths ask for."""

    def __init__(self, ids: list[int], texts: list[str], q: int, budget: float) -> None:
        chars, _, starts = reduce(texts)
        self.ids = ids
        self.pieces: list[np.ndarray] = []
        of = []
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            x = chars[a:b]
            x = x[:-1] if len(x) and x[-1] == 32 else x  # a final blank is not part of an item
            cuts = [0] if len(x) <= WINDOW else [*range(0, len(x) - WINDOW, STEP), len(x) - WINDOW]
            self.pieces += [x[c : c + WINDOW] for c in cuts if len(x)]
            of += [i] * len(cuts) * bool(len(x))
        self.of = np.array(of, np.int64)
        size = np.array([len(x) for x in self.pieces], np.int64)
        self.edits = np.floor(budget * size).astype(np.int64)
        self.q = np.minimum(q, size // (self.edits + 1))
        self.bound = size - self.q + 1 - self.q * self.edits
        self.longest = int(size.max(initial=0))
        self.tables = {int(n): self._table(int(n)) for n in np.unique(self.q)}

    def _table(self, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(filter by the first bits, code, piece, place) of the q-grams of the pieces that take this q, by code."""
        own = np.flatnonzero(self.q == q)
        found = [grams(self.pieces[i], q) for i in own]
        code = np.concatenate(found)
        count = [len(x) for x in found]
        piece, place = np.repeat(own, count), np.concatenate([np.arange(n) for n in count])
        order = np.argsort(code, kind="stable")
        known = np.zeros(1 << TABLE_BITS, bool)
        known[(code >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        return known, code[order], piece[order], place[order]

    def _regions(self, chars: np.ndarray, starts: np.ndarray, q: int) -> list[tuple[int, int, int]]:
        """(text, piece, band) of the bands that reach the bound of their piece; of a text and piece those with most
        q-grams first."""
        known, codes, pieces, places = self.tables[q]
        code = grams(chars, q)
        at = np.flatnonzero(known[(code >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        text = np.searchsorted(starts, at, "right") - 1
        at = at[at + q <= starts[text + 1]]  # else a q-gram across two texts
        left = np.searchsorted(codes, code[at])
        many = np.searchsorted(codes, code[at], "right") - left
        total = int(many.sum())
        if not total:
            return []
        within = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(left, many) + within
        at = np.repeat(at, many)
        piece, text = pieces[entry], np.searchsorted(starts, at, "right") - 1
        diagonal = at - places[entry] - starts[text] + self.longest  # never below 0
        band = diagonal // (self.edits[piece] + 1)
        # a band is two widths wide: each q-gram counts in its own and in the one before, but each of the piece's once
        place = places[entry]
        rows = np.stack([np.tile(text, 2), np.tile(piece, 2), np.concatenate([band, band - 1]), np.tile(place, 2)], 1)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
        rows = rows[np.append(True, (rows[1:] != rows[:-1]).any(axis=1))][:, :3]
        lead = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]).any(axis=1)))
        count = np.diff(np.append(lead, len(rows)))
        full = count >= self.bound[rows[lead, 1]]
        rows, count = rows[lead[full]], count[full]
        return [tuple(r) for r in rows[np.lexsort((rows[:, 2], -count, rows[:, 1], rows[:, 0]))].tolist()]

    def search(self, texts: list[str]) -> list[list[dict]]:
        """Verified hits of each text."""
        found: dict[int, dict[int, list[tuple]]] = {}
        chars, where, starts = reduce(texts)
        for q in self.tables:
            for t, i, b in self._regions(chars, starts, q):
                e, piece, own = int(self.edits[i]), self.pieces[i], chars[starts[t] : starts[t + 1]]
                low = b * (e + 1) - self.longest
                known = found.setdefault(t, {}).setdefault(i, [])
                if e and any(abs(h[0] - low) <= 3 * (e + 1) for h in known):
                    continue  # a passage here would overlap one that is found
                hit = _exact(piece, own, low, low + 2 * e + 1) or banded(piece, own, low - e, low + 2 * e + 2 + e, e)
                if hit and (len(piece) >= WHOLE_WORDS or _stands_alone(own, *hit[:2])):
                    known.append(hit)
        return [self._hits(found.get(t, {}), where[starts[t] : starts[t + 1]]) for t in range(len(texts))]

    def _hits(self, found: dict[int, list[tuple]], where: np.ndarray) -> list[dict]:
        by_item: dict[int, list[tuple]] = {}
        for i, hits in found.items():
            best: list[tuple] = []  # neighbouring bands find the same passage
            for h in sorted(hits, key=lambda h: (h[2], h[0], h[1])):
                if all(h[0] >= o[1] or h[1] <= o[0] for o in best):
                    best.append(h)
            by_item.setdefault(int(self.of[i]), []).extend(best)
        out = []
        for i, hits in by_item.items():
            whole: list[list[int]] = []
            for begin, end, edits in sorted(hits):
                if whole and begin < whole[-1][1]:
                    whole[-1] = [whole[-1][0], max(end, whole[-1][1]), max(edits, whole[-1][2])]
                else:
                    whole.append([begin, end, edits])
            out += [{"item_id": self.ids[i], "start": int(where[b]), "end": int(where[e - 1]) + 1, "edits": n} for b, e, n in whole]
        return sorted(out, key=lambda h: (h["start"], h["item_id"]))


def _exact(piece: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int] | None:
    """The first place on diagonals ``low`` to ``high`` where the text has the piece unchanged."""
    for at in range(max(0, low), min(high, len(text) - len(piece)) + 1):
        if text[at] == piece[0] and (text[at : at + len(piece)] == piece).all():
            return at, at + len(piece), 0
    return None


def _stands_alone(text: np.ndarray, begin: int, end: int) -> bool:
    return (begin == 0 or text[begin - 1] == 32) and (end == len(text) or text[end] == 32)


def banded(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Place the whole of ``item`` in ``text`` on diagonals ``low`` to ``high`` with at most ``most`` edits: (start, end,
    edits) of the best place, or None. The text's ends are free."""
    wide = high - low + 1
    lane = np.arange(wide)
    far = most + 1
    # cell (row, lane) has the text place row + low + lane; cost and the place where the path began
    place = low + lane
    inside = (place >= 0) & (place <= len(text))
    cost = np.where(inside, 0, far).astype(np.int64)
    began = np.where(inside, place, 0)
    for row, c in enumerate(item, 1):
        place = row + low + lane
        inside = (place >= 1) & (place <= len(text))
        got = text[np.clip(place - 1, 0, max(0, len(text) - 1))] if len(text) else np.zeros(wide, np.uint32)
        across = np.where(inside, cost + (got != c), far)
        skip = np.append(cost[1:], far) + 1  # the item's character is missing in the text
        skip[(place < 0) | (place > len(text))] = far
        use = skip < across
        best = np.where(use, skip, across)
        start = np.where(use, np.append(began[1:], 0), began)
        # a character too many in the text: from the lane before, any number of times
        run = np.minimum.accumulate(best - lane)
        source = np.maximum.accumulate(np.where(best - lane == run, lane, 0))
        extra = run + lane
        better = (extra < best) & inside
        start = np.where(better, start[source], start)
        cost = np.minimum(np.where(better, extra, best), far)
        began = start
        if cost.min() > most:
            return None
    lane_best = int(cost.argmin())
    if cost[lane_best] > most:
        return None
    end = len(item) + low + lane_best
    begin = int(began[lane_best])
    return (begin, end, int(cost[lane_best])) if end > begin else None


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[int], list[str]]]:
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where("i is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS)
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t").collect()
        yield [r["i"] for r in rows], [r["t"] for r in rows]


def find_items(docs: DataFrame, benchmark: DataFrame, q: int = Q, budget: float = BUDGET, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", out: str = "hits") -> DataFrame:
    """``docs`` with ``out``: the verified passages, as code point spans of the text. A column of that name is replaced."""
    if not 0 <= budget < 1 or q < 1:
        raise ValueError("the budget is a share below 1, and q is 1 or more")
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != out]
    docs = docs.select(*names)
    first = True
    for ids, texts in _blocks(benchmark, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(Items(ids, texts, q, budget))
        docs = docs.mapInArrow(_search(shared, docs.columns.index(text_col), docs.columns, out, first), _schema(docs, out, first))
        first = False
    return docs.withColumn(out, F.lit(None).cast(HIT)) if first else docs


def _schema(docs: DataFrame, out: str, first: bool) -> StructType:
    fields = list(docs.schema.fields)
    return StructType([*fields, StructField(out, DataType.fromDDL(HIT))]) if first else StructType(fields)


def _search(shared, at: int, names: list[str], out: str, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        for batch in batches:
            found: list[list[dict]] = []
            texts = [t or "" for t in batch.column(at).to_pylist()]
            i = 0
            while i < len(texts):
                j, size = i + 1, len(texts[i])
                while j < len(texts) and size + len(texts[j]) <= SLICE_CHARS:
                    size += len(texts[j])
                    j += 1
                found += items.search(texts[i:j])
                i = j
            if first:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _HIT)], [*names, out])
            else:
                k = names.index(out)
                both = [(a or []) + b for a, b in zip(batch.column(k).to_pylist(), found, strict=True)]
                yield batch.set_column(k, out, pa.array(both, _HIT))

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, contaminated, item_ids, hits."""
    found = find_items(docs.select("doc_id", "text"), benchmark, **options).drop("text")
    hits = F.coalesce("hits", F.array().cast(HIT))
    return found.select("doc_id", (F.size(hits) > 0).alias("contaminated"), F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item_id"]))).alias("item_ids"), hits.alias("hits"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a passage of ``benchmark``."""
    found = find_items(docs, benchmark, out="__hits", **options)
    return found.where(F.coalesce(F.size("__hits"), F.lit(0)) <= 0).select(*docs.columns)
