"""Near-duplicates by one-permutation MinHash with optimal densification.

A text's set holds the hashes (64 bits) of its runs of ``k`` words. One permutation deals the set to bins; each bin's
least value is its entry, and an empty bin takes the entry of a bin that a hash of its own number picks, trying again
until one is filled. Bands of entries name buckets.

Texts with equal sets form a class, told by 128 bits and the size, and go on as one node. Links are looked for in two
ways, and every link is confirmed on the full sets:

* A bucket's members are each compared with its hub only, so a bucket gives as many candidate pairs as it has members.
  The first hub is the member that shares buckets with most others, which is the source of a group of edited copies.
  ``HUB_ROUNDS`` further rounds compare the members of buckets that still join several components with fresh hubs.
* Buckets that are mixed even then are compared whole: of the members whose sizes allow a link, all those that are not
  of the bucket's largest component with all of other components, in pairs of blocks of bounded size. So no two texts
  that share a bucket go without a comparison, unless other links join them already.

With 32 bands of 4, a pair at the limit of 0.8 shares no bucket once in 2 * 10^7 pairs.

Defined results: words are maximal runs without the six ASCII white-space characters, with A-Z in lower case; a text
of fewer than ``k`` words is one run; a null or blank text has the empty set and is linked with nothing. Rows that
repeat an id are judged each by its own text. A component is named by the least id of its rows, null if none has one.
Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowstream.llm import textscan
from rowstream.llm.common import BROADCAST_ROWS, WORD, Tables, semi, small_batches
from rowstream.llm.graph import components, joined

BANDS, ROWS = 32, 4
#: Rounds of hubs drawn afresh, and hubs of a bucket in each; what they leave open is compared whole.
HUB_ROUNDS, HUBS_A_ROUND = 1, 2
#: Members of a mixed bucket are compared in pairs of blocks of about so many members and set elements.
BLOCK, BLOCK_GRAMS = 512, 1 << 19
#: Columns of the incidence matrix held at a time.
COLUMNS = 4096
#: Texts whose signatures are made at a time.
SIGNED = 2048


def shingle_sets(part: textscan.Slice, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a slice's texts, ascending within each text, and where each text's begin."""
    data = textscan.LOWER[part.data]
    start, end, first = part.words()
    words = textscan.Prefix(data).ranges(start, end)
    count = np.diff(first)
    text_of = np.repeat(np.arange(part.n), count)
    grams = textscan.runs(words, k)
    whole = text_of[: len(grams)] == text_of[k - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[whole], text_of[: len(whole)][whole]
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            grams = np.concatenate([grams, textscan.runs(words, n)[first[short]]])
            owner = np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(part.n + 1))


def signatures(grams: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """Densified one-permutation signatures, a row per text; rows of empty sets mean nothing. ``bins``: a power of 2."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    # hashes are already random and ascending within a text: the top bits are the bin, the first of a bin its least
    bin_of = (grams >> np.uint64(64 - (bins.bit_length() - 1))).astype(np.int64)
    place = owner * bins + bin_of
    lead = np.ones(len(place), bool)
    lead[1:] = place[1:] != place[:-1]
    table = np.zeros(n * bins, np.uint64)
    filled = np.zeros(n * bins, bool)
    table[place[lead]], filled[place[lead]] = grams[lead], True
    out = table.copy()
    some = np.diff(at) > 0
    empty = np.flatnonzero(~filled & np.repeat(some, bins))
    attempt = 0
    while len(empty):
        attempt += 1
        own = empty % bins
        pick = (textscan.mix((own + bins * attempt).astype(np.uint64)) % np.uint64(bins)).astype(np.int64)
        source = empty - own + pick
        ok = filled[source]
        out[empty[ok]] = table[source[ok]]
        empty = empty[~ok]
    return out.reshape(n, bins)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    key = textscan.mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :] * np.ones((len(signature), 1), np.uint64)
    for r in range(rows):
        key = textscan.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key


def _lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values.view(np.int64)))


def _scan(k: int, bands: int, rows: int):
    """(id, h, text) to (id, h, n, a, b, keys): the set's size and 128 bits of it, and its buckets."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch.column(2)):
                grams, at = shingle_sets(part, k)
                size = np.diff(at)
                sums = []
                for turn in (0, 1):
                    total = np.zeros(len(grams) + 1, np.uint64)
                    np.cumsum(textscan.mix(grams + np.uint64(turn * 0x5851F42D4C957F2D)), out=total[1:])
                    sums.append(pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)))
                for i in range(0, part.n, SIGNED):
                    j = min(part.n, i + SIGNED)
                    keys = band_keys(signatures(grams[at[i] : at[j]], at[i : j + 1] - at[i], bands * rows), bands, rows)
                    some = size[i:j] > 0
                    ends = np.concatenate([[0], np.cumsum(some * bands)])
                    lists = _lists(np.ascontiguousarray(keys[some]).reshape(-1), ends)
                    own = [batch.column(c).slice(part.first + i, j - i) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(size[i:j]), *(x.slice(i, j - i) for x in sums), lists], ["id", "h", "n", "a", "b", "keys"])

    return scan


def _sets(k: int):
    """(id, h, text) to (id, h, grams)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textscan.slices(batch.column(2)):
                own = [batch.column(c).slice(part.first, part.n) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, _lists(*shingle_sets(part, k))], ["id", "h", "grams"])

    return scan


def _linked(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the edges (x, y, cx, cy) those whose nodes' sets are alike, 100 * intersection >= percent * union, as links
    (x, y) of components."""
    one = sets.select(F.col("node").alias("x"), F.col("grams").alias("gx"))
    two = sets.select(F.col("node").alias("y"), F.col("grams").alias("gy"))
    both = edges.join(one, "x").join(two, "y")
    counted = both.select("cx", "cy", F.size(F.array_intersect("gx", "gy")).alias("i"), F.size("gx").alias("nx"), F.size("gy").alias("ny"))
    near = counted.where(100 * F.col("i") >= percent * (F.col("nx") + F.col("ny") - F.col("i")))
    return near.select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct()


def _edges(members: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of a bucket's member and a hub of another component whose sizes allow a link, with components."""
    hub, own = F.col("hub"), F.struct("node", "component")
    pairs = members.join(hubs, "key").where(hub["component"] != F.col("component"))
    pairs = pairs.where(100 * F.least(hub["n"], F.col("n")) >= percent * F.greatest(hub["n"], F.col("n")))
    two = F.struct(hub["node"].alias("node"), hub["component"].alias("component"))
    ends = pairs.select(F.least(own, two).alias("p"), F.greatest(own, two).alias("q"))
    return ends.select(F.col("p.node").alias("x"), F.col("q.node").alias("y"), F.col("p.component").alias("cx"), F.col("q.component").alias("cy")).distinct()


def _mixed(tables: Tables, members: DataFrame, found: DataFrame) -> DataFrame:
    """The members of those buckets that hold several components, with the components they have by now."""
    labelled = members.select("key", "node", "n").join(found, "node", "left")
    placed = tables.write(labelled.select("key", "node", "n", F.coalesce("component", "node").alias("component")), "labelled")
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return tables.write(placed.join(tables.write(mixed, "mixed"), "key"), "placed")


def alike(component: np.ndarray, side: np.ndarray, grams: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """Rows (x, y), x < y, of components with members whose sets are alike. If both sides (booleans) occur, members of
    the one are compared with those of the other, else all with all."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n)), n)
    _, code, count = np.unique(grams, return_inverse=True, return_counts=True)
    column = (np.cumsum(count > 1) - 1)[code]
    some = count[code] > 1
    owner, column = owner[some], column[some]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    left = np.flatnonzero(~side)
    right = np.flatnonzero(side)
    if not len(left) or not len(right):
        left = right = np.arange(len(n))
    common = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        table = np.zeros((len(n), min(COLUMNS, int(column[b - 1]) - low + 1)), np.float32)
        table[owner[a:b], column[a:b] - low] = 1
        common += table[left] @ table[right].T
    common = common.astype(np.int64)
    near = 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
    i, j = np.nonzero(near & (component[left][:, None] != component[right][None, :]))
    x, y = component[left][i], component[right][j]
    return np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)


def _compare(percent: int):
    """Rows come sorted by ``pair``, two blocks of a bucket; a pair may go on in the next batch."""

    def found(rows: pa.Table) -> np.ndarray:
        lists = rows.column("grams").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        at = np.asarray(lists.offsets).astype(np.int64)
        grams = np.asarray(lists.values)[at[0] : at[-1]].view(np.uint64)
        return alike(np.asarray(rows.column("component")), np.asarray(rows.column("side")), grams, at - at[0], percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # of the pair that goes on
        for batch in batches:
            pair = np.asarray(batch.column(0))
            cuts = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if kept and kept[0].column(0)[0].as_py() != pair[a]:
                    yield from _links(found(pa.Table.from_batches(kept)))
                    kept = []
                if b > a:
                    kept.append(batch.slice(a, b - a))
        if kept:
            yield from _links(found(pa.Table.from_batches(kept)))

    return run


def _links(both: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(both):
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], ["x", "y"])


def _rest(tables: Tables, placed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (x, y) of components, from comparing the members of every bucket of ``placed``: all that are not of its
    largest component (minor) with all whose sizes allow a link."""
    marks = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"m{i}") for i in (0, 1)]
    # buckets with the same members are compared once
    buckets = placed.groupBy("key").agg(F.count("*").alias("size"), *marks).groupBy("size", "m0", "m1").agg(F.min("key").alias("key")).select("key")
    counts = tables.write(placed.join(buckets, "key").groupBy("key", "component").agg(F.count("*").alias("size")), "counts")
    largest = tables.write(counts.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("largest")), "largest")
    # linked sets differ in size by one class at most
    rank = F.floor(F.log("n") / float(np.log(100 / percent) + 1e-6)).cast("int")
    sorted_in = placed.join(largest, "key").withColumn("rank", rank).withColumn("minor", F.col("component") != F.col("largest"))
    sorted_in = tables.write(sorted_in.select("key", "rank", "minor", "node", "n", "component"), "ranked")
    cell = ["key", "rank", "minor"]
    blocks = sorted_in.groupBy(cell).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    blocks = tables.write(blocks, "blocks")
    dealt = tables.write(sorted_in.join(blocks, cell).select(*cell, F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("block"), "node", "component"), "dealt")

    l, r = blocks.alias("l"), blocks.alias("r")
    own = (F.col("l.rank") == F.col("r.rank")) & (F.col("l.minor") == F.col("r.minor"))
    meet = own | (F.col("r.rank") == F.col("l.rank") + 1) | ((F.col("l.rank") == F.col("r.rank")) & F.col("l.minor") & ~F.col("r.minor"))
    pairs = l.join(r, F.col("l.key") == F.col("r.key")).where(meet & (F.col("l.minor") | F.col("r.minor")))
    pairs = pairs.select("l.key", F.col("l.rank").alias("rank0"), F.col("l.minor").alias("minor0"), F.col("r.rank").alias("rank1"), F.col("r.minor").alias("minor1"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("l.blocks") - 1)).alias("block0"), F.col("r.blocks").alias("blocks"))
    pairs = pairs.withColumn("block1", F.explode(F.sequence(F.when(F.col("own"), F.col("block0")).otherwise(0), F.col("blocks") - 1)))
    pairs = tables.write(pairs.withColumn("pair", F.monotonically_increasing_id()), "pairs")

    sides = []
    for i in (0, 1):
        names = {f"rank{i}": "rank", f"minor{i}": "minor", f"block{i}": "block"}
        asked = pairs if i == 0 else pairs.where("not (own and block0 = block1)")
        asked = asked.select("key", "pair", *[F.col(a).alias(b) for a, b in names.items()])
        sides.append(dealt.join(asked, [*cell, "block"]).select("pair", F.lit(bool(i)).alias("side"), "component", "node"))
    whole = tables.write(sides[0].union(sides[1]), "sides").join(sets, "node").select("pair", "side", "component", "grams")
    ordered = whole.repartition("pair").sortWithinPartitions("pair")
    return tables.write(ordered.mapInArrow(_compare(percent), "x long, y long").distinct(), "links")


def _components(tables: Tables, texts: DataFrame, k: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``texts`` (id, h, text) to one row for each, as written: id, h, n, rep (the least id of its class), label (of its
    component), row (a number of its own)."""
    small_batches(texts.sparkSession)
    scanned = texts.mapInArrow(_scan(k, bands, rows), "id long, h long, n long, a long, b long, keys array<long>")
    scanned = tables.write(scanned.withColumn("row", F.monotonically_increasing_id()), "shingles")
    same = ["n", "a", "b"]
    classes = tables.write(scanned.where("n > 0").groupBy(same).agg(F.min("id").alias("rep"), F.min("row").alias("node")), "classes")

    nodes = scanned.where("n > 0").join(classes.select("node"), F.col("row") == F.col("node"), "left_semi")
    banded = nodes.select(F.col("row").alias("node"), "n", F.explode("keys").alias("key"))
    # aggregates are written before they are joined, so that both sides of a join are dealt by it and hot keys can be split
    shared = tables.write(banded.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")
    members = tables.write(banded.join(F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared, "key"), "members")
    reach = tables.write(members.groupBy("node").agg(F.sum("size").alias("reach")), "reach")
    wanted = tables.write(scanned.join(reach, F.col("row") == F.col("node")).select("node", "id", "h", *same), "wanted")
    sets = semi(texts, wanted, ["id", "h"]).mapInArrow(_sets(k), "id long, h long, grams array<long>")
    to = wanted.select("node", F.col("id").alias("__id"), F.col("h").alias("__h"))
    sets = tables.write(sets.join(to, F.col("id").eqNullSafe(F.col("__id")) & F.col("h").eqNullSafe(F.col("__h"))).select("node", "grams"), "sets")
    if sets.count() > wanted.count():  # rows that repeat id and text
        sets = tables.write(sets.dropDuplicates(["node"]), "sets")

    members = members.withColumn("component", F.col("node"))
    first = members.join(reach, "node").groupBy("key").agg(F.max_by(F.struct("node", "n", "component"), F.struct("reach", -F.col("node"))).alias("hub"))
    found = components(tables, _linked(_edges(members, tables.write(first, "hubs"), percent), sets, percent))
    left = members.where("size > 2")
    for turn in range(HUB_ROUNDS + 1):
        left = _mixed(tables, left, found)  # a bucket that joins one component only is done with
        if left.isEmpty():
            break
        if turn == HUB_ROUNDS:
            links = _rest(tables, left, sets, percent)
        else:
            who = F.struct("node", "n", "component")
            drawn = [F.max_by(who, F.xxhash64(F.lit(turn * HUBS_A_ROUND + i), "key", "node")).alias(f"h{i}") for i in range(HUBS_A_ROUND)]
            hubs = left.groupBy("key").agg(*drawn).select("key", F.explode(F.array_distinct(F.array(*[f"h{i}" for i in range(HUBS_A_ROUND)]))).alias("hub"))
            links = tables.write(_linked(_edges(left, tables.write(hubs, "hubs"), percent), sets, percent), "links")
        if not links.isEmpty():
            found = joined(tables, found, links)
    filed = scanned.select("row", "id", "h", *same).join(classes, same, "left").join(found, "node", "left")
    filed = tables.write(filed.select("row", "id", "h", "n", "rep", F.coalesce("component", "node", F.col("row")).alias("label")), "filed")
    tables.free(filed)
    return filed


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))


def near_duplicates(
    docs: DataFrame, k: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept, class_id (the least id with the same set)."""
    if bands * rows & (bands * rows - 1):
        raise ValueError("bands * rows must be a power of two")
    tables = Tables(docs.sparkSession, "near-duplicates")
    filed = _components(tables, _texts(docs, id_col, text_col), k, percent, bands, rows)
    named = tables.write(filed.groupBy("label").agg(F.min("id").alias("component_id")), "named")
    return filed.join(named, "label").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
        F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("class_id"),
    )


def drop_near_duplicates(
    docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that of the least id (null last). All columns stay as they
    are; rows without words all stay."""
    tables = Tables(docs.sparkSession, "one-of-each")
    texts = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__h", F.xxhash64(F.col(text_col)))
    filed = _components(tables, _texts(docs, id_col, text_col), k, percent, bands, rows).where("n > 0")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h")).alias("of")
    kept = tables.write(filed.groupBy("label").agg(first).select(F.col("of.id").alias("__id"), F.col("of.h").alias("__h")), "kept")
    some = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    one = semi(texts.where(some), kept, ["__id", "__h"])
    if not filed.groupBy("id", "h").count().where("count > 1").isEmpty():
        one = one.dropDuplicates(["__id", "__h"])
    return one.union(texts.where(~some)).drop("__id", "__h")
