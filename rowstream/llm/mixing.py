"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Within a source, documents want copies in proportion to their length to the power
of -``damping``, so that a few long documents don't fill a target alone, and ``most`` copies at most; the level at which
the wanted words add up to the target is found by filling up classes of length. The whole part of a document's wanted
copies is taken for certain, and the rest is its inclusion probability. Documents are ranked by their random odds over
their inclusion odds, and each source takes them in that order up to its remaining words, to the nearest document, so
the sample's size in words is fixed to within half a document.

Nothing is ranked whole: words are first summed by source and by a slice of the rank key, the slice that holds the cut
is found from those sums and sliced again, and only the last slice's documents are ordered.

Defined results: a null text has no words and is never taken; sources are told apart with null as one of them; rows
that repeat are ranked apart; a source without words has the target 0. Reruns agree: the random numbers are hashes of
the id, the text and the seed. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowstream.llm.common import Tables, n_words, written

#: Slices at each level; after all levels a slice holds a millionth of a source.
SLICES, LEVELS = 1 << 10, 2
#: Classes of length: so many for each doubling.
CLASSES = 4
#: Wanted copies fall with the root of the length.
DAMPING = 0.5


def _cuts(rows: DataFrame) -> DataFrame:
    """For each source, the slice that its remaining words end in and the words before that slice."""
    sums = rows.groupBy("__source", "__slice", "__rest", "__before").agg(F.sum("size").alias("__words"))
    reached = F.sum("__words").over(Window.partitionBy("__source").orderBy("__slice")) + F.col("__before")
    sums = sums.withColumn("__end", reached).withColumn("__reached", F.col("__end") - F.col("__words"))
    cut = sums.where((F.col("__reached") <= F.col("__rest")) & (F.col("__end") > F.col("__rest")))
    return cut.select(F.col("__source").alias("__at"), F.col("__slice").alias("__cut"), "__reached")


def source_targets(sizes: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Targets by source, from its words (``__source``, ``source_size``).

    Sources take the weights in turn, by code point, null last. With all targets below ``most`` times the size, target =
    level * weight; sources above their limit stop there and the level rises for the others. Sorted by limit over
    weight, the level is the greatest that any cut of that order gives. One row per source goes through one task.
    """
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.withColumn("__weight", F.get(pattern, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    s = s.withColumn("__limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("__limit") / F.col("__weight"), F.col("__source").asc_nulls_last())
    after = order.rowsBetween(0, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("__limit").over(before), F.lit(0.0))
    s = s.withColumn("__level", left / F.sum("__weight").over(after))
    s = s.withColumn("target", F.least("__limit", F.max("__level").over(every) * F.col("__weight")))
    return s.select("__source", "source_size", "target")


def wanted_copies(rows: DataFrame, goals: DataFrame, most: float, damping: float) -> DataFrame:
    """(__of, __class, __wanted, __rest): the copies that documents of a source and class want, and the source's words
    beyond whole copies.

    A class's appeal is its length to the power of -``damping``; it wants level * appeal copies, and ``most`` at most.
    Any choice of classes that stop at ``most`` gives a level no higher than the right one, so that is the greatest.
    """
    words = rows.where("size > 0").groupBy("__source", "__class").agg(F.sum("size").alias("__words"))
    words = words.join(goals.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of"))).where("target > 0")
    words = words.withColumn("__appeal", F.pow(F.lit(2.0), -F.col("__class") * F.lit(damping / CLASSES)))
    by = Window.partitionBy("__of").orderBy("__class")  # few rows: a class is a fraction of a doubling
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("__words").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * F.lit(float(most))
    level = (F.col("target") - full) / F.sum(F.col("__appeal") * F.col("__words")).over(by.rowsBetween(0, Window.unboundedFollowing))
    words = words.withColumn("__level", level).withColumn("__wanted", F.least(F.lit(float(most)), F.max("__level").over(every) * F.col("__appeal")))
    rest = F.col("target") - F.sum(F.floor("__wanted") * F.col("__words")).over(every)
    return words.select("__of", "__class", "__wanted", rest.alias("__rest"))


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 20, damping: float = DAMPING, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies and the hash ``text_hash`` of the text."""
    tables = Tables(docs.sparkSession, "mix")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("__source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("text_hash")
    )
    rows = tables.write(rows.withColumn("__class", F.when(F.col("size") > 0, F.floor(F.log2("size") * CLASSES)).cast("int")), "sizes")
    sizes = rows.groupBy("__source").agg(F.sum("size").alias("source_size"))
    goals = tables.write(source_targets(sizes, weights, most), "goals")
    copies = tables.write(wanted_copies(rows, goals, most, damping), "copies")

    ranked = rows.join(goals.withColumnRenamed("__source", "__of"), F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of")
    same = F.col("__source").eqNullSafe(F.col("__of")) & (F.col("__class") == F.col("__cls"))
    ranked = ranked.join(copies.withColumnRenamed("__class", "__cls"), same, "left").drop("__of", "__cls")
    ranked = ranked.withColumn("__sure", F.coalesce(F.floor("__wanted"), F.lit(0))).withColumn("__chance", F.col("__wanted") - F.col("__sure"))
    ranked = ranked.withColumn("__random", (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_hash"), 11) + F.lit(0.5)) / F.lit(float(1 << 53)))
    # ranking value: random odds over inclusion odds; scaled by the source's own odds it spreads over (0, 1)
    odds = lambda p: p / (1 - p)
    ranked = ranked.withColumn("__rank", F.when(F.col("__chance") > 0, odds(F.col("__random")) / odds(F.col("__chance"))))
    share = F.col("__rest") / F.col("source_size")
    even = F.col("__rank") * F.when((share > 0.001) & (share < 0.999), odds(share)).otherwise(1.0)
    ranked = ranked.withColumn("__place", even / (1 + even) * SLICES)
    in_play = F.col("__rank").isNotNull() & (F.col("size") > 0)
    # null: not placed yet; what stands in the slice of the cut is placed by the next, finer level
    ranked = ranked.withColumn("__more", F.when(~in_play, F.lit(0))).withColumn("__before", F.lit(0).cast("long"))
    for level in range(LEVELS):
        ranked = ranked.withColumn("__slice", F.least(F.floor("__place"), F.lit(SLICES - 1)))
        cut = tables.write(_cuts(ranked.where(F.col("__more").isNull())), "cuts")
        ranked = ranked.join(cut, F.col("__source").eqNullSafe(F.col("__at")), "left")
        # no cut: the rest takes all that is left of the source
        side = F.when(F.col("__cut").isNull() | (F.col("__slice") < F.col("__cut")), F.lit(1)).when(F.col("__slice") > F.col("__cut"), F.lit(0))
        ranked = ranked.withColumn("__more", F.coalesce("__more", side)).withColumn("__before", F.coalesce("__reached", "__before"))
        ranked = ranked.withColumn("__place", (F.col("__place") - F.col("__slice")) * SLICES).drop("__at", "__cut", "__reached", "__slice")
    in_order = Window.partitionBy("__source").orderBy("__rank", "doc_id", "text_hash", "size")
    edge = ranked.where(F.col("__more").isNull())
    done = F.col("__before") + F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    edge = edge.withColumn("__more", F.when(done + F.col("size") / 2 <= F.col("__rest"), F.lit(1)).otherwise(F.lit(0)))
    copies = F.when(F.col("size") > 0, F.col("__sure") + F.col("__more")).otherwise(F.lit(0))
    both = ranked.where(F.col("__more").isNotNull()).unionByName(edge)
    return both.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("long").alias("copies"), F.col("__source").alias("source"), "text_hash"
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, with ``copies`` and ``taken``; columns of those names are replaced.

    Rows that repeat both id and text become one, with the copies of all.
    """
    mixed = mix_sources(docs, id_col=id_col, text_col=text_col, **options)
    picked = mixed.where("copies > 0").groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    picked = written(picked.agg(F.sum("copies").alias("copies"), F.sum("taken").alias("taken"), F.count("*").alias("__rows")), "mix-picked")
    rows = docs.drop("copies", "taken").withColumn("__own", F.xxhash64(F.col(text_col)))
    if not picked.where("__rows > 1").isEmpty():
        rows = rows.dropDuplicates([id_col, "__own"])
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash"))
    return rows.join(picked, same).drop("__id", "__hash", "__own", "__rows")
