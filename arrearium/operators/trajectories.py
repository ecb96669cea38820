"""Decision trajectories: histories, transitions, rewards and n-step returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arrearium.functions.scalars import ACTION_COST, ACTIVE, action_sum, safe_div


def histories(panel: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """One row for each account: its months in order with state and action, and whether it ended.

    Without `actions` the panel has their column `action` already, and account-months meet in no join.
    """
    rows = panel if actions is None else panel.join(actions.select("aid", "month_no", "action"), ["aid", "month_no"], "left")
    month = F.struct("month_no", "period", "status", "coll_status", "due_installments", "paid_installments", "action")
    return rows.groupBy("aid").agg(F.array_sort(F.collect_list(month)).alias("history"), F.bool_or(F.col("status") != ACTIVE).alias("terminated"))


def transitions(panel: DataFrame, actions: DataFrame | None = None) -> DataFrame:
    """(state, action, next state) of active months with an action whose next month is there.

    Without `actions` the panel has their column `action` already, null without one, and account-months meet in no join.
    """
    w = W.partitionBy("aid").orderBy("month_no")
    nxt = lambda c: F.lead(c).over(w)
    rows = panel.select(
        "aid", "period", "month_no", "status", "coll_status", "installment", F.col("due_installments").alias("s_due"), F.col("paid_installments").alias("s_paid"),
        nxt("due_installments").alias("next_due"), nxt("paid_installments").alias("next_paid"), nxt("month_no").alias("__next"), nxt("status").alias("next_status"),
        *([] if actions is not None else ["action"]),
    )
    rows = rows.filter((F.col("status") == ACTIVE) & (F.col("__next") == F.col("month_no") + 1)).drop("__next")
    return rows.filter("action is not null") if actions is None else rows.join(actions.select("aid", "month_no", "action"), ["aid", "month_no"])


def rewards(t: DataFrame) -> DataFrame:
    """Reward schemes: 0 installments paid less 0.75; 1 money less the cost of the action; 2 the latter standardised."""
    paid = F.col("next_paid") - F.col("s_paid")
    out = t.withColumn("reward0", paid - 0.75).withColumn("reward1", paid * F.col("installment") - action_sum(F.col("action"), ACTION_COST))
    stat = out.agg(F.avg("reward1").alias("__m"), F.stddev_samp("reward1").alias("__s"))  # one row
    return out.crossJoin(F.broadcast(stat)).withColumn("reward2", safe_div(F.col("reward1") - F.col("__m"), F.col("__s"))).drop("__m", "__s")


def n_step(df: DataFrame, reward: str, state: str, n: int, gamma: float) -> DataFrame:
    """Discounted sum of the next n rewards (missing ones count 0) and the state n months on."""
    w = W.partitionBy("aid").orderBy("month_no")
    total = F.col(reward)
    for j in range(1, n):
        total = total + gamma**j * F.coalesce(F.lead(reward, j).over(w), F.lit(0.0))
    return df.withColumn("n_step", total).withColumn("state_n", F.lead(state, n).over(w))


def split_by_stage(t: DataFrame, stages: tuple[int, ...] = (1, 7)) -> DataFrame:
    """Tag transitions from the stages without measures, and whether the reward is zero."""
    return t.withColumn("quiet_stage", F.col("coll_status").isin(list(stages))).withColumn("zero", F.col("next_paid") == F.col("s_paid"))


def state_vector(df: DataFrame, numeric: list[str], one_hot: dict[str, list[int]], method: str = "std") -> DataFrame:
    """Numeric columns normalised by their statistics and codes as indicator columns."""
    stats = df.agg(*[f(c).alias(f"__{k}_{c}") for c in numeric for k, f in (("m", F.avg), ("s", F.stddev_samp), ("lo", F.min), ("hi", F.max))])
    out = df.crossJoin(F.broadcast(stats))
    for c in numeric:
        a, b = (F.col(f"__m_{c}"), F.col(f"__s_{c}")) if method == "std" else (F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))
        out = out.withColumn(f"n_{c}", safe_div(F.col(c) - a, b))
    for c, levels in one_hot.items():
        out = out.withColumns({f"{c}_{v}": (F.col(c) == v).cast("int") for v in levels})
    return out.drop(*[c for c in out.columns if c.startswith("__")])
