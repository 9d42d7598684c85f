"""What the corpus operators share: written tables, session helpers and the columns they claim."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as a Java and RE2 character class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Most rows of narrow keys that are sent to every executor; more keys are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Most bytes of an Arrow batch: texts are long, and the JVM and Python hold whole batches.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names. Only a local session that names none gets a temporary one."""
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="rowstream-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes in this session, unless it sets a bound of its own."""
    if BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


class Tables:
    """Tables of one run, as Parquet in the shared folder: they cut lineage, and outlast any executor."""

    def __init__(self, spark: SparkSession, run: str) -> None:
        self.spark, self.base = spark, f"{checkpoint_dir(spark)}/{run}-{uuid.uuid4().hex}"
        self.made: list[str] = []
        self.count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count}-{name}"
        self.made.append(path)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def free(self, *keep: DataFrame) -> None:
        """Delete all tables but those that the given frames read, and the shuffle files of finished jobs, which Spark
        lets go when the driver collects its garbage."""
        used = {tuple(f.split("/")[-3:-1]) for df in keep for f in df.inputFiles()}
        for path in list(self.made):
            if tuple(path.split("/")[-2:]) not in used:
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
                self.made.remove(path)
        gc.collect()
        self.spark._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the written copy."""
    return Tables(df.sparkSession, name).write(df, name)


def semi(df: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The rows of ``df`` whose ``names`` (nulls are equal) occur in ``keys``, a written table."""
    right = keys.select(*[F.col(n).alias(f"__semi_{n}") for n in names])
    right = F.broadcast(right) if keys.count() <= BROADCAST_ROWS else right
    same = F.lit(True)
    for n in names:
        same = same & df[n].eqNullSafe(F.col(f"__semi_{n}"))
    return df.join(right, same, "left_semi")


def n_words(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
