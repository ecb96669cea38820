"""Portfolio reports: migration, flow rates, vintage risk, action effectiveness, money, cohorts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arrearium.functions.scalars import ACTION_COST, ACTIVE, BAD, CLOSED, action_sum, safe_div

from .panel import previous


def migration(panel: DataFrame, state: str = "due_installments", by: list[str] | None = None) -> DataFrame:
    """from, to, n, pct: transitions between consecutive months, in percent of the row (and of `by`)."""
    by = by or []
    moved = previous(panel, state, "from", None).filter("`from` is not null").withColumn("to", F.col(state))
    counts = moved.groupBy(*by, "from", "to").agg(F.count("*").alias("n"))
    return counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(W.partitionBy(*by, "from")))


def migration_matrix(panel: DataFrame, states: list[int], state: str = "due_installments") -> DataFrame:
    return migration(panel, state).groupBy("from").pivot("to", states).agg(F.first("pct"))


def flow_rates(panel: DataFrame, state: str = "due_installments", most: int = 12) -> DataFrame:
    """period, flow (e.g. 00-01), n_from, rate: share of a bucket that rolls one up in a month."""
    moved = previous(panel, state, "from", None).filter(F.col("from").between(0, most - 1))
    rolled = F.count_if(F.col(state) == F.col("from") + 1)
    out = moved.groupBy("period", "from").agg(F.count("*").alias("n_from"), rolled.alias("n_rolled"))
    flow = F.format_string("%02d-%02d", F.col("from"), F.col("from") + 1)
    return out.select("period", flow.alias("flow"), "n_from", (F.col("n_rolled") / F.col("n_from")).alias("rate"))


def vintage_risk(flagged: DataFrame, by: list[str], horizons: tuple[int, ...] = (3, 6, 9, 12)) -> DataFrame:
    """Number and mean default flags; an indeterminate flag counts 0, a missing window isn't counted."""
    risk = [F.avg(F.when(F.col(f"default{h}_reason") == "indeterminate", 0).otherwise(F.col(f"default{h}"))).alias(f"risk{h}") for h in horizons]
    return flagged.groupBy(*by).agg(F.count("*").alias("n"), *risk)


def outstanding(df: DataFrame) -> DataFrame:
    return df.withColumn("outstanding", safe_div(F.col("loan_amount") * (F.col("n_installments") - F.col("paid_installments")), F.col("n_installments"))).withColumn("limit", F.col("loan_amount"))


def paid_flag(panel: DataFrame) -> DataFrame:
    return previous(panel, "paid_installments", "before").withColumn("paid", (F.col("paid_installments") > F.col("before")).cast("int"))


def action_effectiveness(panel: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """action, n, mean_paid: share of months with a payment after each action sequence of the month before.

    Without `actions` the panel has their column `action` already, and account-months meet in no join.
    """
    if actions is None:
        after = previous(paid_flag(panel), "action", "__taken", None).filter("__taken is not null")
        return after.groupBy(F.col("__taken").alias("action")).agg(F.count("*").alias("n"), F.avg("paid").alias("mean_paid"))
    taken = actions.select("aid", (F.col("month_no") + 1).alias("month_no"), "action")
    return paid_flag(panel).join(taken, ["aid", "month_no"]).groupBy("action").agg(F.count("*").alias("n"), F.avg("paid").alias("mean_paid"))


def default_by_action(flagged: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """Risk by action; without `actions` the flagged months have their column `action` already."""
    acted = flagged.filter("action is not null") if actions is None else flagged.join(actions.select("aid", "month_no", "action"), ["aid", "month_no"])
    return vintage_risk(acted, ["action"])


def encode_sequence(rows: DataFrame) -> DataFrame:
    """seg = sum of 10^(nr-1) * action over the numbered actions of an account-month."""
    return rows.groupBy("aid", "period").agg(F.sum(F.pow(F.lit(10), F.col("action_nr") - 1) * F.col("digit").cast("int")).cast("bigint").alias("seg"))


def revenue(panel: DataFrame) -> DataFrame:
    """period, revenue: installments newly paid in the month, in money."""
    gained = previous(panel, "paid_installments", "before")
    return gained.groupBy("period").agg(F.sum(F.col("installment") * (F.col("paid_installments") - F.col("before"))).alias("revenue"))


def cost(actions: DataFrame, prices: Mapping[str, float] = ACTION_COST) -> DataFrame:
    return actions.groupBy("period").agg(F.sum(action_sum(F.col("action"), prices)).alias("cost"))


def revenue_and_cost(panel: DataFrame, actions: DataFrame, prices: Mapping[str, float] = ACTION_COST) -> DataFrame:
    """All periods with revenue, cost, profit and the running profit."""
    both = revenue(panel).join(cost(actions, prices), "period", "full_outer").na.fill(0, ["revenue", "cost"])
    both = both.withColumn("profit", F.col("revenue") - F.col("cost"))
    return both.withColumn("cum_profit", F.sum("profit").over(W.orderBy("period")))  # one row for each month


def lifetime_collected(panel: DataFrame) -> DataFrame:
    """Totals over accounts of installments and money paid up to their last month."""
    last = panel.groupBy("aid").agg(F.max_by(F.struct("paid_installments", "installment", "loan_amount"), "month_no").alias("l"))
    return last.agg(F.count("*").alias("n"), F.sum("l.paid_installments").alias("paid"), F.sum(F.col("l.paid_installments") * F.col("l.installment")).alias("amount"), F.sum("l.loan_amount").alias("granted"))


def cohort_default_rates(panel: DataFrame) -> DataFrame:
    """Originations, write-offs and default rate by month of origination."""
    last = panel.groupBy("aid", "fin_period").agg(F.max_by("status", "month_no").alias("status"))
    return last.groupBy("fin_period").agg(F.count("*").alias("originations"), F.count_if(F.col("status") == BAD).alias("writeoffs"), (100 * F.avg((F.col("status") == BAD).cast("int"))).alias("dr_pct"))


def terminal_census(panel: DataFrame) -> DataFrame:
    last = panel.groupBy("aid").agg(F.max_by("status", "month_no").alias("status"), F.max("due_installments").alias("worst"))
    is_ = lambda s: F.count_if(F.col("status") == s)
    return last.agg(F.count("*").alias("n"), is_(ACTIVE).alias("active"), is_(BAD).alias("writeoff"), is_(CLOSED).alias("closed"), F.count_if(F.col("worst") >= 4).alias("ever_default"))


def maturity_curve(panel: DataFrame, offsets: range = range(12, 24)) -> DataFrame:
    """Share of each cohort written off within k months, for every k of `offsets`."""
    first = panel.groupBy("aid", "fin_period").agg(F.min(F.when(F.col("status") == BAD, F.col("k"))).alias("at"))
    return first.groupBy("fin_period").agg(F.count("*").alias("n_orig"), *[F.avg(F.coalesce((F.col("at") <= k).cast("int"), F.lit(0))).alias(f"dr_m{k}") for k in offsets])


def empirical_lgd(panel: DataFrame) -> DataFrame:
    """ead, lgd and paid fraction of written-off accounts."""
    bad = panel.filter(F.col("status") == BAD).groupBy("aid").agg(F.min_by(F.struct("paid_installments", "n_installments", "installment", "loan_amount"), "month_no").alias("b")).select("aid", "b.*")
    got = F.col("paid_installments") * F.col("installment")
    return bad.select("aid", (F.col("loan_amount") - got).alias("ead"), safe_div(F.col("loan_amount") - got, F.col("loan_amount")).alias("lgd"), safe_div(F.col("paid_installments"), F.col("n_installments")).alias("paid_fraction"))


def tenor_diagnostic(scored: DataFrame) -> DataFrame:
    """Rows, defaults, rates and means by tenor, and over all of them (tenor null)."""
    return scored.rollup("n_installments").agg(F.count("*").alias("n"), F.sum("y").alias("defaults"), F.avg("y").alias("dr"), F.avg("score").alias("mean_pd"), F.avg("loan_amount").alias("mean_loan"))


def counts(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"))
