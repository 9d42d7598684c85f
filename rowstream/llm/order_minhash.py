"""Document fingerprints by order MinHash, in built-in expressions only.

The letters of a text are its words; a character of a script written without blanks is a word, and longer words are cut
after ``LONGEST`` characters. They form k-mers (runs of ``k`` words; a shorter text is one k-mer). Equal k-mers are
numbered by occurrence, so repeats count. A hash orders the numbered k-mers on a ring and deals it into ``bins``; each
bin that has k-mers takes its ``length`` smallest (if it has fewer, the next ones on the ring), puts them back in text
order and hashes that tuple. A signature is the list of (bin, tuple hash). Because the tuple depends on which k-mers
survive *and* on their order, likeness falls with edit distance, also when an edit only moves text.

Defined results: a null text is an empty one; a text without words has an empty signature, and two empty signatures
are alike (1.0). Places have 23 bits: in a text of more words, k-mers that are so near that their places agree are
ordered by their hash. Rows that repeat an id or a whole row are neighbours in text order. Only the named columns are
read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowstream.llm.common import SPACE

#: Scripts written without blanks between words: Thai, Lao, Burmese, Khmer, kana and ideographs.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
LONGEST = 24
LETTER = rf"[{UNSPACED}]|[^{SPACE}{UNSPACED}]{{1,{LONGEST}}}"
#: Key ranges for each partition.
RANGES = 8
POSITION_BITS = 23
_POSITION = (1 << POSITION_BITS) - 1
_HASH = -1 << POSITION_BITS
_REST = (1 << (64 - POSITION_BITS)) - 1


def _first_equal(values: Column, upto: Column, part, least: Column) -> Column:
    """Least index up to ``upto`` of an ascending array whose ``part`` is ``least``, by bisection."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        return (
            F.when(state["low"] >= state["high"], state)
            .when(part(F.get(values, middle)) < least, F.struct((middle + 1).alias("low"), state["high"].alias("high")))
            .otherwise(F.struct(state["low"].alias("low"), middle.alias("high")))
        )

    steps = F.sequence(F.lit(1), F.ceil(F.log2(upto + 2)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), upto.alias("high")), halve, lambda s: s["low"])


def with_signature(df: DataFrame, text: str, out: str, k: int = 2, length: int = 2, bin_bits: int = 6) -> DataFrame:
    """Add ``out``: array<bigint> of (bin << 32 | tuple hash), in bin order.

    Each step is a projection of its own, so that no array is computed twice.
    """
    if not 1 <= bin_bits <= 16 or k < 1 or length < 1:
        raise ValueError("k and length are 1 at least, bin_bits from 1 to 16")
    t = {x: f"__om_{x}" for x in ("words", "sorted", "numbered", "heads")}
    c = {x: F.col(name) for x, name in t.items()}
    low = lambda x: x.bitwiseAND(F.lit(_POSITION))
    high = lambda x: x.bitwiseAND(F.lit(_HASH))
    bin_of = lambda x: F.shiftrightunsigned(x, 64 - bin_bits)
    words = c["words"]
    df = df.withColumn(t["words"], F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LETTER), F.lit(0)), lambda w: F.xxhash64(w)))
    coarse = F.greatest(F.lit(0), F.ceil(F.log2(F.size(words) + 1)).cast("int") - POSITION_BITS)
    place = lambda i: F.call_function("shiftright", i.cast("long"), coarse)
    grams = F.transform(words, lambda w, i: high(F.xxhash64(w, *[F.get(words, i + j) for j in range(1, k)])).bitwiseOR(low(place(i))))
    df = df.withColumn(t["sorted"], F.sort_array(F.slice(grams, 1, F.greatest(F.size(words) - (k - 1), F.lit(1)))))

    def numbered(x: Column, i: Column) -> Column:
        nth = i - _first_equal(c["sorted"], i, high, high(x))
        for back in (4, 3, 2, 1):  # few repeats need the bisection
            nth = F.when((i < back) | (high(F.get(c["sorted"], i - back)) != high(x)), F.lit(back - 1)).otherwise(nth)
        return high(F.xxhash64(high(x), nth)).bitwiseOR(low(x))

    df = df.withColumn(t["numbered"], F.sort_array(F.transform(c["sorted"], numbered)))
    # the ring, with its first k-mers again at the end; a head is the first k-mer of its bin
    size = F.size(c["numbered"])
    indices = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    df = df.withColumn(t["heads"], F.filter(indices, lambda i: (i == 0) | (bin_of(F.get(c["numbered"], i)) != bin_of(F.get(c["numbered"], i - 1)))))

    def entry(a: Column) -> Column:
        own = F.array(*[F.get(c["numbered"], (a + j) % size) for j in range(length)])
        ordered = F.sort_array(F.transform(own, lambda x: F.shiftleft(low(x), 64 - POSITION_BITS).bitwiseOR(F.shiftrightunsigned(x, POSITION_BITS))))
        tuple_hash = F.xxhash64(F.transform(ordered, lambda x: x.bitwiseAND(F.lit(_REST)))).bitwiseAND(F.lit(0xFFFFFFFF))
        return F.shiftleft(bin_of(F.get(c["numbered"], a)), 32).bitwiseOR(tuple_hash)

    # filters don't pass a step that numbers its rows; else they would copy the steps above into themselves
    df = df.withColumns({out: F.sort_array(F.transform(c["heads"], entry)), "__om_row": F.monotonically_increasing_id()})
    return df.where("__om_row >= 0").drop(*t.values(), "__om_row")


def as_text(signature: Column) -> Column:
    """Ten hexadecimal digits for each entry: two of the bin, eight of the tuple."""
    return F.array_join(F.transform(signature, lambda e: F.lower(F.lpad(F.hex(e), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal entries among the bins that either signature fills."""
    bins = lambda s: F.transform(s, lambda e: F.shiftright(e, 32))
    union = F.size(F.array_union(bins(a), bins(b)))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def _longs(values: list[int]) -> Column:
    """An array literal; the least value can't be written as one number."""
    return F.expr(f"array({','.join(f'{v}L' if v > -(1 << 63) else f'bigint({v + 1}L - 1L)' for v in values)})")


def _bucket(key: Column, splits: list[int]) -> Column:
    """How many of the ascending ``splits`` are at most ``key``, by bisection."""
    if not splits:
        return F.lit(0)
    table = _longs(splits)

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        right = F.get(table, middle) <= key
        return (
            F.when(state["low"] >= state["high"], state)
            .when(right, F.struct((middle + 1).alias("low"), state["high"].alias("high")))
            .otherwise(F.struct(state["low"].alias("low"), middle.alias("high")))
        )

    steps = F.sequence(F.lit(1), F.lit(len(splits).bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(splits)).alias("high")), halve, lambda s: s["low"])


def range_splits(df: DataFrame, key: Column, parts: int) -> tuple[int | None, list[int]]:
    """The least key and up to ``parts`` - 1 keys that occur and cut ``df`` evenly. The number of cuts is bounded by the
    partition count, not by the rows."""
    shares = [i / parts for i in range(1, parts)] or [0.5]
    row = df.agg(F.min(key).alias("first"), F.percentile_approx(key, shares, F.lit(max(10_000, 20 * parts))).alias("cuts")).first()
    if row is None or row["first"] is None:
        return None, []
    return row["first"], sorted({x for x in row["cuts"] if x > row["first"]})


def with_neighbour(rows: DataFrame, key: str, text: str, parts: int | None = None) -> tuple[DataFrame, Window]:
    """Order all rows by ``key`` and then ``text``, in one shuffle, so that a window gives each its successor.

    Rows are dealt by ranges of the key, ``RANGES`` for each partition, so that a partition's share of the text is even.
    The first row of each range also goes to the range before it (that of the first range to the last), so a range's
    window sees every successor it needs. Returns the rows with ``__bucket`` and ``__copy``, which marks those that stand
    in as successors, and the window.
    """
    parts = parts or RANGES * max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first, splits = range_splits(rows.select(key), F.col(key), parts)
    last = len(splits)
    heads = [first, *splits] if first is not None else []
    own = F.struct(_bucket(F.col(key), splits).alias("bucket"), F.lit(False).alias("copy"))
    before = F.struct(F.when(F.col(key) == F.lit(first), F.lit(last)).otherwise(_bucket(F.col(key), splits) - 1).alias("bucket"), F.lit(True).alias("copy"))
    is_head = F.lit(False)
    if heads:
        is_head = F.col(key) == F.get(_longs(heads), _bucket(F.col(key), splits))
    dealt = rows.withColumn("__to", F.explode(F.when(is_head, F.array(own, before)).otherwise(F.array(own))))
    dealt = dealt.select(*rows.columns, F.col("__to.bucket").alias("__bucket"), F.col("__to.copy").alias("__copy"))
    return dealt, Window.partitionBy("__bucket").orderBy("__copy", key, text)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 2, length: int = 2, bin_bits: int = 6) -> DataFrame:
    """Fingerprint each text, and the text whose second half gives way to the start of the next row's.

    Rows are ordered by id, nulls first, then by text; every input row gives one output row. A text's own signature is
    made before the shuffle, the edited text's after it.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("__key"), F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    rows, window = with_neighbour(with_signature(rows, "__text", "__own", k, length, bin_bits), "__key", "__text")
    rows = rows.select("*", F.lead("__text").over(window).alias("__after"), F.lead("__own").over(window).alias("__next")).where(~F.col("__copy"))
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("__text"), F.lit(1), n - half), F.substring(F.coalesce(F.col("__after"), F.lit("")), F.lit(1), half))
    rows = rows.select("__id", "__own", "__next", n.cast("long").alias("n_chars"), edited.alias("__edited"))
    rows = with_signature(rows.withColumn("edited_sha256", F.sha2(F.col("__edited").cast("binary"), 256)), "__edited", "__changed", k, length, bin_bits)
    return rows.select(
        F.col("__id").alias("doc_id"),
        "n_chars",
        "edited_sha256",
        as_text(F.col("__own")).alias("fingerprint"),
        as_text(F.col("__changed")).alias("edited_fingerprint"),
        likeness(F.col("__own"), F.col("__changed")).alias("near_edited"),
        likeness(F.col("__own"), F.col("__next")).alias("near_next"),
    )
