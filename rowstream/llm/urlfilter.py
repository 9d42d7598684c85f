"""URL rules behind a blocked Bloom filter, in built-in expressions only.

A rule lists a canonical host and path; it fits its host, all subdomains, and every path it begins. Each URL is turned
into the keys (host suffix + path prefix) that a rule of some listed shape could equal: shapes are the distinct pairs of
label count and path length in the list. Keys first probe a blocked Bloom filter, one 256-bit block for a key; what
passes meets the rules in an exact hash join, which removes the filter's false positives.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule. Of a rule listed twice, the
one that blocks holds. Equal URLs get equal verdicts; every input row gives one output row. Only the named columns are
read, so others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowstream.llm.common import BROADCAST_ROWS, written

BITS_A_KEY = 16
WORDS = 4
#: Most bytes of filter that are sent to every executor; a larger filter is joined by shuffle.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _mask(key: Column, word: int) -> Column:
    """Two bits of each of the block's four words."""
    h = F.xxhash64(key, F.lit(word))
    bit = lambda shift: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int"))
    return bit(0).bitwiseOR(bit(6))


def bloom_blocks(keys: DataFrame, key: str, n_keys: int) -> tuple[DataFrame, int]:
    """One row for each block that holds keys: its number and four words. Size: 16 bits a key."""
    blocks = max(1, -(-n_keys * BITS_A_KEY // 256))
    made = keys.groupBy(_block(F.col(key), blocks).alias("__block")).agg(*[F.bit_or(_mask(F.col(key), w)).alias(f"__w{w}") for w in range(WORDS)])
    return made, blocks


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Judge every row of ``pages``. ``rules``: host, path, verdict (allow or block), with host in lower case.

    The number of rule shapes is bounded by host depth times path length, not by the number of rules or pages.
    """
    listed = rules.select(
        F.concat("host", "path").alias("__key"),
        F.col("verdict").alias("__verdict"),
        F.size(F.split("host", r"\.")).alias("__labels"),
        F.length("path").alias("__length"),
        F.struct((F.length("host") + F.length("path")).alias("n"), F.length("host").alias("h")).alias("__rank"),
    )
    listed = listed.groupBy("__key", "__labels", "__length", "__rank").agg(F.max("__verdict").alias("__verdict"))
    shapes = [tuple(r) for r in listed.select("__labels", "__length").distinct().collect()]
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("__url"), host.alias("host"), path.alias("path"))
    if not shapes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.split("host", r"\.")
    keys = F.array(
        *[
            F.when((F.size(labels) >= d) & (F.length("path") >= n), F.concat(F.substring_index("host", ".", -d), F.substring("path", 1, n)))
            for d, n in sorted(shapes)
        ]
    )
    probes = rows.select("host", "path").distinct().select("host", "path", F.explode(F.array_distinct(F.array_compact(keys))).alias("__key"))
    n_keys = listed.count()
    filled, blocks = bloom_blocks(listed, "__key", n_keys)
    filled = F.broadcast(filled) if blocks * 8 * (WORDS + 1) <= BROADCAST_BYTES else filled
    possible = probes.withColumn("__block", _block(F.col("__key"), blocks)).join(filled, "__block")
    for w in range(WORDS):
        mask = _mask(F.col("__key"), w)
        possible = possible.where(F.col(f"__w{w}").bitwiseAND(mask) == mask)
    # a short list goes to every executor; beyond that AQE splits the rows of a rule that fits many
    exact = possible.select("host", "path", "__key").join(F.broadcast(listed) if n_keys <= BROADCAST_ROWS else listed.hint("merge"), "__key")
    best = exact.groupBy("host", "path").agg(F.max_by(F.struct(F.col("__key").alias("rule"), F.col("__verdict").alias("verdict")), F.col("__rank")).alias("__best"))
    # written, so that both sides of the join are dealt by it and the rows of a frequent url can be split
    return rows.join(written(best, "url-rules"), ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("__best.rule").alias("rule"), F.coalesce(F.col("__best.verdict"), F.lit(default)).alias("verdict")
    )
