"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of a "word", [\x20\x09-\x0D].
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it many times in `body`.

    The value is bound to a lambda variable, so the optimizer can't inline an
    expensive expression into a higher-order function that runs per element.
    """
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters and columns read: it passes through a generator, so that the optimizer
    neither repeats its expression for each of them nor pushes a filter with a copy of it below."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Only in local mode, where all tasks run on this machine, a temporary folder serves; on a cluster without either
    setting this is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-checkpoint-")


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that a lost executor costs one recomputed task."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def sized(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """`df`, written durably, in as many partitions as its rows call for: what a shuffle left in many nearly empty
    partitions would otherwise make each later shuffle write as many files again."""
    df = durable(df)
    return df.coalesce(df.count() // rows + 1)


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "4m") -> None:
    """Session settings for Python workers: Arrow batches of at most so many rows and bytes, whatever the texts' length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: Column) -> Column:
    """Array of the maximal runs without separators; null and empty texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATOR_RUN), lambda w: w != "")


def without(text: Column, chars: str) -> Column:
    """`text` without any of `chars`; chained byte searches are far cheaper than a regular expression."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text
