"""The corpus pipeline: quality, near-duplicates, decontamination, pseudonyms, mixture.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``docs``; each works on every
row its predecessor kept, and what it drops or rewrites stays so. SQL can't express the model, the signatures or the
keyed permutations, so the stages are tested against plain versions, and ``run`` against the stages one by one.

Defined results: rows without text or words have no mark of low quality, are no duplicates, hold no benchmark passage
and no personal data, and the mixture takes none of them. Rows that repeat id and text count as one from the
near-duplicates on; rows that repeat only the id are judged each by its own text; a row without an id is a row like
others, and of a group of duplicates it stays only if none has an id. Columns of any other names go through unchanged,
but for ``copies`` and ``taken``, which the last stage sets. Empty tables give empty results; without ratings no row is
rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowstream.llm.common import written
from rowstream.llm.decontam import drop_contaminated
from rowstream.llm.mixing import mixture
from rowstream.llm.neardup import drop_near_duplicates
from rowstream.llm.pii import pseudonymise, session_key
from rowstream.llm.quality import select_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that most likely have the highest grade."""
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word runs are alike to 0.8."""
    return drop_near_duplicates(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced; the length is counted anew."""
    made = pseudonymise(docs, session_key(spark))
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, with their copies and the words taken."""
    return mixture(docs)


STAGES = [
    ("quality classifier", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pseudonyms),
    ("mixing sources to target weights", mixing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
