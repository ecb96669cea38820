"""Modelling tables: wide history per account, targets with censoring, splits, cleaning, profits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearium.functions.periods import period_of
from arrearium.functions.scalars import ACTIVE, BAD, CLOSED, safe_div

from .wide import profiles

OBSERVED = 12
RATES = (5, 8, 10, 12, 15)


def burn_in(df: DataFrame, min_fin_period: int) -> DataFrame:
    return df.filter(F.col("fin_period") >= min_fin_period)


def burn_in_report(df: DataFrame, min_fin_period: int) -> DataFrame:
    keep = F.col("fin_period") >= min_fin_period
    return df.agg(F.count("*").alias("before"), F.count_if(keep).alias("after"), F.count_distinct("aid").alias("accounts_before"), F.count_distinct(F.when(keep, F.col("aid"))).alias("accounts_after"))


def origination(panel: DataFrame, accounts: DataFrame) -> DataFrame:
    """First month of every account with the account's columns."""
    extra = [c for c in accounts.columns if c not in panel.columns or c == "aid"]
    return panel.filter("k = 0").join(accounts.select(*extra), "aid", "left")


def eligible(panel: DataFrame) -> DataFrame:
    """Accounts with all observed months and no write-off up to the observation point."""
    full = panel.filter(F.col("k") < OBSERVED).groupBy("aid").agg(F.count_distinct("k").alias("n")).filter(F.col("n") == OBSERVED).select("aid")
    early = panel.filter((F.col("status") == BAD) & (F.col("k") <= OBSERVED)).select("aid")
    return full.join(early, "aid", "left_anti")


def split_of(fin_period: Column, boundary: int, last: int | None = None) -> Column:
    """train before the boundary, then oot, and exclude from `last` on."""
    e = F.when(fin_period < boundary, "train").otherwise("oot")
    return e if last is None else F.when(fin_period >= last, "exclude").otherwise(e)


def observation_status(target: Column, closed: Column) -> Column:
    return F.when(target == 1, "defaulted").when(closed, "closed").when(target.isNull(), "censored").otherwise("performing")


def observation_table(panel: DataFrame, boundary: int, last: int | None = None, months: int = OBSERVED) -> DataFrame:
    """aid, fin_period, obs_period (the last observed month), target with censoring, observed state and split of every account."""
    k, c = F.col("k"), F.col
    end = panel.agg(F.max("month_no").alias("__last"))
    rows = panel.groupBy("aid").agg(
        F.first("fin_period").alias("fin_period"), F.min(c("month_no") - k).alias("__fin_no"),
        F.bool_or((c("status") == BAD) & k.between(months, 2 * months - 1)).alias("__bad"), F.bool_or((c("status") == CLOSED) & (k < 2 * months)).alias("__closed"),
    ).crossJoin(F.broadcast(end))  # one row
    target = F.when(c("__bad"), 1).when(c("__fin_no") + 2 * months - 1 <= c("__last"), 0)
    rows = rows.withColumn("obs_period", period_of(c("__fin_no") + months - 1)).withColumn("target", target)
    return rows.select("aid", "fin_period", "obs_period", "target", observation_status(c("target"), c("__closed")).alias("observed"), split_of(c("fin_period"), boundary, last).alias("split"))


def thesis_table(base: DataFrame, thesis: DataFrame, boundary: int) -> DataFrame:
    """The base table's columns at origination with the account's outcome and its split."""
    outcome = thesis.select("aid", "installment", "target", "ead", "lgd", "paid_fraction")
    return base.filter(F.col("period") == F.col("fin_period")).join(outcome, "aid").withColumn("split", split_of(F.col("fin_period"), boundary))


def wide_abt(panel: DataFrame, series: list[str], boundary: int, months: int = OBSERVED) -> DataFrame:
    """One row for each eligible account: monthly series, window aggregates, target and split, in one aggregate.

    target is 1 with a write-off in months 12 to 23, 0 without one if those months are observable, else null.
    """
    k, c = F.col("k"), F.col
    seen = k < months
    last = panel.agg(F.max("month_no").alias("__last"))
    at = lambda col, m: F.max(F.when(k == m, F.col(col)))
    wide = panel.groupBy("aid").agg(
        F.first("fin_period").alias("fin_period"),
        F.min("month_no").alias("__fin_no"),
        F.count_distinct(F.when(seen, k)).alias("__n"),
        F.count_if((c("status") == BAD) & (k <= months)).alias("__early"),
        F.count_if((c("status") == BAD) & k.between(months, 2 * months - 1)).alias("__bad"),
        F.max(F.when(seen, c("due_installments"))).alias("max_due"),
        F.max(F.when(seen, c("coll_status"))).alias("max_coll_status"),
        F.count_if(seen & (c("due_installments") > 0)).alias("months_ever_due"),
        F.count_if(seen & (c("coll_status") >= 2)).alias("months_coll_2plus"),
        (at("due_installments", months - 1) - at("due_installments", 0)).alias("trend_due"),
        at("paid_installments", months - 1).alias("paid_at_obs"),
        *[at(s, m).alias(f"{s}_m{m + 1}") for s in series for m in range(months)],
    )
    wide = wide.filter((c("__n") == months) & (c("__early") == 0)).crossJoin(F.broadcast(last))
    target = F.when(c("__bad") > 0, 1).when(c("__fin_no") + 2 * months - 1 <= c("__last"), 0)
    return wide.withColumn("target", target).withColumn("split", split_of(c("fin_period"), boundary)).drop("__fin_no", "__n", "__early", "__bad", "__last")


def first_seen(wide: DataFrame, summary: DataFrame, columns: list[str]) -> DataFrame:
    """Summary columns of the account's earliest row, whatever its month; as-of joins are in `asof`."""
    first = summary.groupBy("aid").agg(F.min_by(F.struct(*columns), "period").alias("s")).select("aid", "s.*")
    return wide.join(first, "aid", "left")


def clean(df: DataFrame, numeric: list[str], train: Column, drop: list[str] | None = None) -> DataFrame:
    """Drop listed columns; cap at the train 99th percentile and fill nulls with the train median, all columns in one scan."""
    df = df.drop(*(drop or []))
    found = profiles(df.filter(train), numeric, [0.5, 0.99])
    cut = lambda c: F.when(F.col(c).isNotNull(), F.least(F.col(c).cast("double"), F.lit(found[c].quantiles[1]))).otherwise(F.lit(found[c].quantiles[0]))
    return df.withColumns({c: cut(c) for c in numeric if found[c].n})


def exclusion_reasons(df: DataFrame) -> DataFrame:
    return df.groupBy(F.when(F.col("split") == "exclude", "cohort").when(F.col("target").isNull(), "censored").otherwise("kept").alias("reason")).agg(F.count("*").alias("n"))


def thesis_abt(panel: DataFrame) -> DataFrame:
    """Origination columns with the first final state: target, exposure, loss and paid share."""
    t = F.when(F.col("status") != ACTIVE, F.struct("status", "paid_installments"))
    rows = panel.groupBy("aid").agg(*[F.first(c).alias(c) for c in ("cid", "fin_period", "n_installments", "installment", "loan_amount")], F.min_by(t, F.when(t.isNotNull(), F.col("month_no"))).alias("t"))
    bad = F.col("t.status") == BAD
    left = F.col("loan_amount") - F.col("t.paid_installments") * F.col("installment")
    return rows.select(
        "aid", "cid", "fin_period", "n_installments", "installment", "loan_amount",
        F.when(bad, 1).when(F.col("t.status") == CLOSED, 0).alias("target"), F.when(bad, left).alias("ead"), F.when(bad, safe_div(left, F.col("loan_amount"))).alias("lgd"),
        safe_div(F.col("t.paid_installments"), F.col("n_installments")).alias("paid_fraction"),
    )


def profit_columns(df: DataFrame, rates: tuple[int, ...] = RATES) -> DataFrame:
    """Profit of an account at flat rates (percent): interest on the loan, or the loss."""
    loss = -F.col("ead") * F.col("lgd")
    return df.withColumns({f"profit_r{r}": F.when(F.col("target") == 0, r / 100 * F.col("loan_amount")).when(F.col("target") == 1, loss) for r in rates})


def breakeven(df: DataFrame) -> DataFrame:
    """The rate at which interest of the good accounts covers the losses of the bad."""
    loss = F.sum(F.when(F.col("target") == 1, F.col("ead") * F.col("lgd")).otherwise(0.0))
    return df.agg(safe_div(loss, F.sum(F.when(F.col("target") == 0, F.col("loan_amount")).otherwise(0))).alias("breakeven_rate"))
