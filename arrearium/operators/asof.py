"""As-of joins: the latest row of the other side at or before a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], matched: str = "matched_time", block: int | None = None) -> DataFrame:
    """Rows of `left` with `columns` of the right row of the same keys that is the latest at or before their time.

    Both sides are united and ordered by time behind their keys, so the work is one sort and not a join of all earlier
    rows. `matched` is the right row's time, null without one. Of several right rows of a time the greatest by columns is
    taken. Times are integers. With `block`, the rows of a key are split by that much time, and each block's last right
    row carries over to the later ones: then a key with a large part of all rows is no single task.
    """
    theirs = right.groupBy(*keys, right_time).agg(F.max(F.struct(*columns)).alias("__r"))
    theirs = theirs.select(*keys, F.col(right_time).cast("bigint").alias("__t"), F.lit(0).alias("__side"), F.struct(F.col(right_time).alias("t"), F.col("__r").alias("r")).alias("__r"))
    ours = left.select(*keys, F.col(left_time).cast("bigint").alias("__t"), F.lit(1).alias("__side"), F.struct("*").alias("__l"))
    rows = theirs.unionByName(ours, allowMissingColumns=True)
    by = [*keys]
    if block:
        rows = rows.withColumn("__b", F.floor(F.col("__t") / block))
        by.append("__b")
    inside = W.partitionBy(*by).orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    found = rows.withColumn("__m", F.last("__r", ignorenulls=True).over(inside)).filter("__side = 1")
    if block:
        last = rows.filter("__side = 0").groupBy(*by).agg(F.max_by("__r", "__t").alias("__c"))
        need = rows.groupBy(*by).agg(F.max(F.lit(1)).alias("__x")).join(last, by, "left")  # a row for each key and block
        carry = need.withColumn("__c", F.last("__c", ignorenulls=True).over(W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1))).drop("__x")
        found = found.join(carry, by, "left").withColumn("__m", F.coalesce("__m", "__c"))
    return found.select("__l.*", *[F.col(f"__m.r.{c}").alias(c) for c in columns], F.col("__m.t").alias(matched))
