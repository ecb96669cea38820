"""Month close as a stream: landed transactions rewrite the months they touch, late rows included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arrearium.functions.periods import month_no, period_of
from arrearium.operators.panel import customer_max, trailing

LOOKBACK = 12


def close_periods(spark: SparkSession, ledger: str, summary: str, periods: list[int]) -> None:
    """Recompute the trailing windows of the given months and overwrite just their partitions."""
    rows = spark.read.parquet(ledger).withColumn("month_no", month_no(F.col("period")))
    lo, hi = (p // 100 * 12 + p % 100 for p in (min(periods), max(periods)))
    window = rows.filter((F.col("month_no") >= lo - LOOKBACK + 1) & (F.col("month_no") <= hi))
    latest = window.groupBy("period", "aid").agg(F.max_by(F.struct(*[c for c in window.columns if c not in ("period", "aid")]), "arrival").alias("r")).select("period", "aid", "r.*")
    done = trailing(customer_max(latest)).filter(F.col("period").isin(periods))
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(summary)


def start(spark: SparkSession, landing: str, ledger: str, summary: str, checkpoint: str, schema) -> StreamingQuery:
    """Fold every batch of landed files into the ledger and close its months and the 11 after them."""

    def fold(batch: DataFrame, epoch: int) -> None:
        batch = batch.withColumn("arrival", F.lit(epoch)).persist()
        batch.write.mode("append").partitionBy("period").parquet(ledger)
        touched = batch.select(F.explode(F.sequence(month_no(F.col("period")), month_no(F.col("period")) + LOOKBACK - 1)).alias("m")).distinct()
        last = spark.read.parquet(ledger).agg(F.max(month_no(F.col("period")))).first()[0]
        months = [r["p"] for r in touched.filter(F.col("m") <= last).select(period_of(F.col("m")).alias("p")).collect()]  # months, not rows
        if months:
            close_periods(spark, ledger, summary, sorted(months))
        batch.unpersist()

    return spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type, for a stream or a table alike."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
