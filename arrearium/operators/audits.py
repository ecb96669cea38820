"""Data-quality audits as small result tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearium.functions.scalars import safe_div


def gates(df: DataFrame, bad: dict[str, Column]) -> DataFrame:
    """check_name, n_bad, n: how many rows break each rule; one scan for all."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in bad.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("n_bad")) for k in bad])
    return row.select(F.explode(pairs).alias("x"), "n").select("x.check_name", "x.n_bad", "n")


def split_summary(df: DataFrame, split: str, period: str, key: str) -> DataFrame:
    return df.groupBy(split).agg(F.min(period).alias("lo"), F.max(period).alias("hi"), F.count("*").alias("n"), F.count_distinct(key).alias("n_accounts"))


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, n, n_null, n_distinct."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(f"u_{c}") for c in columns], *[F.count_distinct(c).alias(f"d_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"u_{c}").alias("n_null"), F.col(f"d_{c}").alias("n_distinct")) for c in columns])
    return row.select(F.explode(pairs).alias("x"), "n").select("x.column_name", "n", "x.n_null", "x.n_distinct")


def null_audit(df: DataFrame, columns: list[str], allowed: list[str] = []) -> DataFrame:  # noqa: B006
    """column_name, n, n_null, allowed, ok: nulls are fine only in columns of the allow-list; one scan.

    A task counts the nulls of its rows, of whose columns it only sees whether they have a value.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, nulls = 0, np.zeros(len(columns), np.int64)
        for batch in batches:
            marks = batch.column("u").flatten().to_numpy(zero_copy_only=False)
            n, nulls = n + batch.num_rows, nulls + marks.reshape(batch.num_rows, len(columns)).sum(0)
        yield pa.RecordBatch.from_pydict({"column_name": columns, "n": np.full(len(columns), n), "n_null": nulls})

    parts = df.select(F.array(*[F.col(c).isNull() for c in columns]).alias("u")).mapInArrow(counted, "column_name string, n bigint, n_null bigint")
    rows = parts.groupBy("column_name").agg(F.sum("n").alias("n"), F.sum("n_null").alias("n_null"))
    listed = F.col("column_name").isin(*allowed) if allowed else F.lit(False)
    return rows.select("column_name", "n", "n_null", listed.alias("allowed"), ((F.col("n_null") == 0) | listed).alias("ok"))


def split_purity(df: DataFrame, split: str, period: str, key: str, first: str = "train", second: str = "oot") -> DataFrame:
    """One row: the last period of the first split, the first of the second, accounts in both, and whether time parts them."""
    at = lambda f, s: f(F.when(F.col(split) == s, F.col(period)))
    both = df.filter(F.col(split).isin(first, second)).groupBy(key).agg(F.count_distinct(split).alias("s")).agg(F.count_if(F.col("s") > 1).alias("n_shared"))
    out = df.agg(at(F.max, first).alias("last_first"), at(F.min, second).alias("first_second")).crossJoin(F.broadcast(both))  # one row each
    return out.withColumn("pure", (F.col("last_first") < F.col("first_second")) & (F.col("n_shared") == 0))


def step_report(steps: dict[str, DataFrame], groups: dict[str, list[str]] = {}, key: str = "aid") -> DataFrame:  # noqa: B006
    """step, metric, value: rows, distinct keys and columns of each table of a build, and the null share by group of columns.

    Each step is one aggregate over its own table.
    """
    out = None
    for name, df in steps.items():
        have = {g: [c for c in cs if c in df.columns] for g, cs in groups.items()}
        aggs = [F.count("*").cast("double").alias("rows"), F.count_distinct(key).cast("double").alias("accounts"), F.lit(float(len(df.columns))).alias("columns")]
        for g, cs in have.items():
            if cs:
                total = sum((F.count_if(F.col(c).isNull()) for c in cs), F.lit(0))
                aggs.append(safe_div(total.cast("double"), F.count("*") * len(cs)).alias(f"null_share_{g}"))
        one = df.agg(*aggs)
        long = one.select(F.lit(name).alias("step"), F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in one.columns]), F.array(*one.columns))).alias("metric", "value"))
        out = long if out is None else out.unionByName(long)
    return out


def top_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, value, share of each column's most frequent value (the smallest on ties), in one scan."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*")
    counted = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    by = counted.groupBy("column_name").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("t"))
    return by.select("column_name", "t.value", (-F.col("t.n") / F.col("total")).alias("share"))


def range_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, lo, hi, mean, n_negative, extreme (maximum above 100 means)."""
    row = df.agg(*[f(F.col(c)).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg), ("neg", lambda x: F.count_if(x < 0)))])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{k}_{c}").cast("double").alias(k) for k in ("lo", "hi", "mean", "neg")]) for c in columns])
    out = row.select(F.explode(pairs).alias("x")).select("x.*")
    return out.select("column_name", "lo", "hi", "mean", F.col("neg").cast("bigint").alias("n_negative"), (F.col("hi") > 100 * F.col("mean")).alias("extreme"))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_columns(df: DataFrame, pairs: list[tuple[str, str]], least: float = 0.9999) -> DataFrame:
    """a, b, equal_share, correlation, duplicate for pairs of numeric columns, in one scan."""
    row = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (F.avg((F.col(a) == F.col(b)).cast("int")).alias(f"e{i}"), F.corr(a, b).alias(f"r{i}"))])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"e{i}").alias("equal_share"), F.col(f"r{i}").alias("correlation")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")
    return out.withColumn("duplicate", (F.col("equal_share") >= least) | (F.coalesce(F.abs("correlation"), F.lit(0.0)) > least))


def target_gates(thesis: DataFrame) -> DataFrame:
    """check_name, n_bad, n: outcomes that don't agree with exposure, loss or the paid share."""
    c = F.col
    return gates(
        thesis,
        {
            "bad_without_exposure": (c("target") == 1) & c("ead").isNull(),
            "good_with_exposure": (c("target") == 0) & c("ead").isNotNull(),
            "loss_outside_0_1": (c("lgd") < 0) | (c("lgd") > 1),
            "good_not_paid": (c("target") == 0) & (c("paid_fraction") < 1),
            "paid_outside_0_1": (c("paid_fraction") < 0) | (c("paid_fraction") > 1),
        },
    )


def defaulted_economics(thesis: DataFrame, by: list[str]) -> DataFrame:
    """Exposure, loss and paid share of the defaulted accounts."""
    bad = thesis.filter(F.col("target") == 1)
    return bad.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("ead").alias("ead"), F.avg("lgd").alias("mean_lgd"), F.min("lgd").alias("min_lgd"), F.max("lgd").alias("max_lgd"),
        safe_div(F.sum("ead"), F.sum("loan_amount")).alias("ead_share"), F.avg("paid_fraction").alias("mean_paid"),
    )


def build_report(steps: dict[str, DataFrame]) -> DataFrame:
    """step, metric, value of the tables of a build."""
    out = None
    for name, df in steps.items():
        one = df.agg(F.count("*").alias("value")).select(F.lit(name).alias("step"), F.lit("rows").alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out
