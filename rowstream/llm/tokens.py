"""Token counts by section, from one encoding of each whole document.

A byte-level vocabulary loses nothing: the bytes of a text's tokens, one after the other, are the text. The running sum
of the tokens' lengths therefore is each token's span, and sections (by default the lines, each with its line break)
are spans of the same text, so a sorted search joins the two. A token that crosses a border goes by the rule:

``start``     to the section that has its first byte (the default)
``majority``  to the section that has most of its bytes, the earlier one of equals
``split``     to all its sections, in proportion to its bytes

Counts of sections add up to the document's under each rule. Spans are given in code points.

Defined results: a null or empty text has one section, 0 to 0, without tokens. Texts may be of any length. Rows that
repeat an id or a whole row are counted each by itself. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowstream.llm.common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published splitting pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "majority", "split")
#: A vocabulary is sent to every executor, so its size is checked.
MAX_VOCABULARY_BYTES = 64 << 20
_LONG_BLANK = re.compile(r"\s{1000,}")


class Encoder:
    """Token ids of whole texts and the byte length of each id."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(t) for t in ranks]

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.core.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return self._around_blanks(text)

    def _around_blanks(self, text: str) -> np.ndarray:
        """The splitting pattern can't match very long blanks; but all of a blank except its last character is one
        piece, if something follows it, so the text may be cut there."""
        parts, at = [], 0
        for m in _LONG_BLANK.finditer(text):
            end = m.end() - (m.end() < len(text))
            parts += [self.core.encode_to_numpy(text[at : m.start()], disallowed_special=()), np.array(self.core._encode_single_piece(text[m.start() : end]), np.uint32)]
            at = end
        parts.append(self.core.encode_to_numpy(text[at:], disallowed_special=()))
        return np.concatenate(parts)


def line_starts(data: np.ndarray) -> np.ndarray:
    """Where the lines of a text begin; a final line break opens no further line."""
    starts = np.flatnonzero(data == 10) + 1
    return np.concatenate([[0], starts[starts < len(data)]])


def attribute(ends: np.ndarray, starts: np.ndarray, size: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each section, its share of the tokens and how many tokens cross its beginning. ``ends``: where tokens end."""
    n = len(starts)
    if not len(ends):
        return np.zeros(n), np.zeros(n, np.int64)
    begins = np.concatenate([[0], ends[:-1]])
    first = np.searchsorted(starts, begins, "right") - 1
    last = np.searchsorted(starts, ends - 1, "right") - 1
    crossing = np.flatnonzero(last > first)
    counts = np.bincount(first, minlength=n).astype(float)
    crossed = np.zeros(n, np.int64)
    borders = np.concatenate([starts, [size]])
    for t in crossing:  # few: a token is some bytes long
        span = np.arange(first[t], last[t] + 1)
        crossed[span[1:]] += 1
        if rule != "start":
            part = np.minimum(borders[span + 1], ends[t]) - np.maximum(borders[span], begins[t])
            counts[first[t]] -= 1
            if rule == "majority":
                counts[span[part.argmax()]] += 1
            else:
                counts[span] += part / part.sum()
    return counts, crossed


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "start", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each section: doc_id, section, start_char, end_char, n_tokens, n_crossing, doc_tokens."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    with open(vocabulary, "rb") as f:  # on the driver only; executors get the bytes
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to be sent to every executor")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                data = np.frombuffer(text.encode(), np.uint8)
                ends = np.cumsum(encoder.lengths[encoder.encode(text)]) if text else np.zeros(0, np.int64)
                starts = line_starts(data)
                counts, crossed = attribute(ends, starts, len(data), rule)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[np.concatenate([starts, [len(data)]])]
                rows.append((key, len(starts), chars[:-1], chars[1:], counts, crossed, len(ends)))
                held += len(starts)
                if held > 50_000:
                    yield _rows(rows)
                    rows, held = [], 0
            if rows:
                yield _rows(rows)

    schema = "doc_id long, section long, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    sizes = np.array([r[1] for r in rows])
    of = np.repeat(np.arange(len(rows)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keys = pa.array([r[0] for r in rows], pa.int64()).take(pa.array(of))
    joined = [np.concatenate([r[i] for r in rows]) for i in (2, 3, 4, 5)]
    arrays = [keys, pa.array(np.arange(len(of)) - first[of]), *[pa.array(x) for x in joined], pa.array(np.array([r[6] for r in rows])[of])]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])
