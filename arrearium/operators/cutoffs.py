"""Scenario grids and profit-optimal cut-offs."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arrearium.functions.scalars import apr_tier, safe_div

from .economics import exposure, with_lifetime
from .features import cumulative, quantiles
from .prefix import best_prefixes


def grid(spark: SparkSession, **axes: list) -> DataFrame:
    """All combinations of the given values, numbered; a small table."""
    rows = [(i, *v) for i, v in enumerate(product(*axes.values()))]
    kinds = {str: "string", int: "double", float: "double"}
    rows = [tuple(float(x) if isinstance(x, int) and k else x for k, x in enumerate(r)) for r in rows]
    return spark.createDataFrame(rows, "scenario int, " + ", ".join(f"{k} {kinds[type(v[0])]}" for k, v in axes.items()))


def strategy_apr(pd_: Column, strategy: Column) -> Column:
    """APR of a pricing strategy: tiered, tiered_cap<percent>, or flat<percent>."""
    percent = F.try_to_number(F.regexp_extract(strategy, r"(\d+)$", 1), F.lit("99")).cast("double") / 100
    return F.when(strategy == "tiered", apr_tier(pd_)).when(F.startswith(strategy, F.lit("tiered_cap")), F.least(apr_tier(pd_), percent)).otherwise(percent)


def scenario_rows(accounts: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every account under every scenario: stressed PD, APR and lifetime economics. Scenarios are a small, stated table."""
    rows = accounts.crossJoin(F.broadcast(scenarios))
    rows = rows.withColumn("pd_stressed", F.least(F.col("score") * F.col("pd_mult"), F.lit(0.999)))
    return with_lifetime(rows.withColumn("apr", strategy_apr(F.col("score"), F.col("strategy"))), "pd_stressed")


def optimal_cutoffs(rows: DataFrame, by: list[str], pd_: str = "pd_stressed", profit: str = "Expected_Profit", count: str | None = None) -> DataFrame:
    """Per scenario: the acceptance (up to a PD, ties together) with the highest cumulative profit; none if none is positive.

    Accounts are summed by distinct PD before anything is ordered, and the running sums are split by ranges of the PD, so
    a scenario with as many PDs as accounts isn't one task. Rows may stand for `count` accounts each.
    """
    sums = rows.groupBy(*by, F.col(pd_).alias("p")).agg((F.sum(count) if count else F.count("*")).alias("n"), F.sum(profit).alias("profit"))
    running = cumulative(sums, "p", ["n", "profit"], by).withColumn("k", F.col("before_n") + F.col("n")).withColumn("cum", F.col("before_profit") + F.col("profit"))
    best = F.max_by(F.struct("p", "k", "cum"), F.struct("cum", -F.col("k")))
    out = running.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("profit").alias("total_profit"), best.alias("b"))
    ok = F.col("b.cum") > 0
    pct = F.when(ok, 100 * F.col("b.k") / F.col("n")).otherwise(0.0)
    category = F.when(pct >= 99, "approve_all").when(pct >= 50, "interior").otherwise("reject_most")
    return out.select(*by, "n", "total_profit", F.when(ok, F.col("b.p")).otherwise(0.0).alias("cutoff_pd"), pct.alias("approve_pct"), F.when(ok, F.col("b.cum")).otherwise(0.0).alias("max_profit"), category.alias("category"))


#: Parameters that lifetime profit is linear in; all their combinations come from the same sums.
LINEAR = ("cof", "acq", "lgd", "op")


def linear_grid(accounts: DataFrame, axes: Mapping[str, list], disc: float = 0.05, score: str = "score", fixed_cutoffs: Mapping[tuple[float, str], float] | None = None, shares: bool = True) -> DataFrame:
    """Totals and profit-optimal cut-off of every cell of pd_mult x strategy x cof x acq x lgd x op.

    Only pd_mult and strategy change an account's hazard and balance: accounts are ranged by stressed PD once for each
    pair of them, and the other axes are columns of one running sum. So rows don't grow with the cells, and continuous
    scores need no pooling. With `fixed_cutoffs` (by pd_mult and strategy) the profit and share up to these PDs are added. Without
    `shares` there is no share of profitable accounts, and accounts of one score and tenor are summed first.
    """
    pairs = list(product(axes["pd_mult"], axes["strategy"]))
    cells = list(product(*[axes[k] for k in LINEAR]))
    return _linear_cells(accounts, pairs, [cells] * len(pairs), [fixed_cutoffs[p] for p in pairs] if fixed_cutoffs else None, disc, score, shares).drop("g")


def linear_scenarios(accounts: DataFrame, scenarios: Mapping[str, tuple[float, str, float, float, float]], ops: list[float], fixed_cutoffs: Mapping[str, float], disc: float = 0.05, score: str = "score", name: str = "anchor") -> DataFrame:
    """The columns of `linear_grid` for named (pd_mult, strategy, cof, acq, lgd), each at all running costs, from one ranged pass."""
    names = list(scenarios)
    cells = [[(cof, acq, lgd, op) for op in ops] for _, _, cof, acq, lgd in scenarios.values()]
    out = _linear_cells(accounts, [(m, s) for m, s, *_ in scenarios.values()], cells, [fixed_cutoffs[k] for k in names], disc, score, True)
    return out.withColumn(name, F.get(F.array(*[F.lit(k) for k in names]), F.col("g"))).drop("g")


def _linear_cells(accounts: DataFrame, pairs: list[tuple[float, str]], cells: list[list[tuple[float, ...]]], fixed: list[float] | None, disc: float, score: str, shares: bool) -> DataFrame:
    """g and the columns of `linear_grid` for cells of LINEAR values of each pair g of stress and price, as many for each."""
    width = len(cells[0])
    values = [[column[None, :] for column in np.array(own, dtype=float).T] for own in cells]
    small = accounts.sparkSession.createDataFrame([(i, float(m), str(s)) for i, (m, s) in enumerate(pairs)], "g int, pd_mult double, strategy string")
    rows = accounts.select(F.col(score).cast("double").alias("score"), F.col("loan_amount").cast("double").alias("loan"), F.col("n_installments").alias("n"), F.lit(1.0).alias("k"))
    rows = (rows if shares else rows.groupBy("score", "n").agg(F.sum("loan").alias("loan"), F.sum("k").alias("k"))).crossJoin(F.broadcast(small))
    rows = rows.withColumn("p", F.least(F.col("score") * F.col("pd_mult"), F.lit(0.999))).withColumn("apr", strategy_apr(F.col("score"), F.col("strategy")))
    rows = rows.withColumns(exposure(F.col("p"), F.col("loan"), F.col("n"), F.col("apr"), F.lit(disc))).select("g", "p", "k", "apr", "balance", (F.col("hazard") * F.col("balance")).alias("lost"), "instalment_base")
    limits = dict(enumerate(fixed)) if fixed else {}

    def make(g: int, x: Mapping[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        cof, acq, lgd, op = values[g]
        balance, lost, base, k = x["balance"][:, None], x["lost"][:, None], x["instalment_base"][:, None], x["k"][:, None]
        profit = np.maximum(x["apr"][:, None] - cof, 0.0) / 12 * balance - op * base - lgd * lost - acq * k
        inside = (x["p"] <= limits.get(g, -1.0))[:, None]
        return np.broadcast_to(k, profit.shape), profit, [(profit > 0).sum(0).astype(float), (profit * inside).sum(0), np.full(width, float((k * inside).sum()))]

    out = []
    for g, b in best_prefixes(rows, "g", "p", make, width, 3).items():
        for k, cell in enumerate(cells[g]):
            pct = 100 * b.best_n[k] / b.n[k]
            category = "approve_all" if pct >= 99 else "interior" if pct >= 50 else "reject_most"
            more = (float(b.extras[1][k]), float(100 * b.extras[2][k] / b.n[k])) if limits else (None, None)
            out.append((g, float(pairs[g][0]), pairs[g][1], *map(float, cell), int(b.n[k]), float(b.total[k]), float(b.total[k] / b.n[k]), float(b.extras[0][k] / b.n[k]) if shares else None, float(b.best_at[k]), float(pct), float(b.best[k]), category, *more))
    schema = "g int, pd_mult double, strategy string, cof double, acq double, lgd double, op double, n bigint, total_profit double, mean_profit double, share_positive double, cutoff_pd double, approve_pct double, max_profit double, category string, profit_at_fixed double, approve_pct_fixed double"
    return accounts.sparkSession.createDataFrame(out, schema)  # one row a cell


def linear_means(accounts: DataFrame, strategies: list[str], lgds: list[float], discs: list[float], ops: list[float], score: str = "score") -> DataFrame:
    """strategy, disc, lgd, op with the mean loss, margin and profit and the share of profitable accounts of every cell.

    One row for each account, strategy and discount; losses and running costs are columns of one aggregate.
    """
    pairs = accounts.sparkSession.createDataFrame([(str(a), float(d)) for a, d in product(strategies, discs)], "strategy string, disc double")
    rows = accounts.crossJoin(F.broadcast(pairs)).withColumn("__p", F.least(F.col(score).cast("double"), F.lit(0.999))).withColumn("__apr", strategy_apr(F.col(score), F.col("strategy")))
    rows = rows.withColumns(exposure(F.col("__p"), F.col("loan_amount").cast("double"), F.col("n_installments"), F.col("__apr"), F.col("disc")))
    cells, aggs = list(product(lgds, ops)), []
    for k, (lgd, op) in enumerate(cells):
        el = F.col("hazard") * lgd * F.col("balance")
        margin = F.col("__apr") / 12 * F.col("balance") - op * F.col("instalment_base")
        aggs += [F.avg(el).alias(f"e{k}"), F.avg(margin).alias(f"m{k}"), F.avg(margin - el).alias(f"p{k}"), F.avg((margin - el > 0).cast("int")).alias(f"s{k}")]
    one = rows.groupBy("strategy", "disc").agg(*aggs)
    parts = [F.struct(F.lit(lgd).alias("lgd"), F.lit(op).alias("op"), F.col(f"e{k}").alias("mean_LT_EL"), F.col(f"m{k}").alias("mean_LT_margin"), F.col(f"p{k}").alias("mean_profit"), F.col(f"s{k}").alias("share_positive")) for k, (lgd, op) in enumerate(cells)]
    return one.select("strategy", "disc", F.explode(F.array(*parts)).alias("x")).select("strategy", "disc", "x.*")


def monotone_uplift(results: DataFrame, level: str, uplift: str, tolerance: float = 0.0) -> DataFrame:
    """One row: whether the uplift never falls, never rises, or neither, in the order of a level; results are few."""
    w = W.orderBy(level)  # as many rows as levels
    steps = results.withColumn("__d", F.col(uplift) - F.lag(uplift).over(w))
    rising, falling = F.min("__d") >= -tolerance, F.max("__d") <= tolerance
    return steps.agg(F.count("*").alias("n"), F.when(F.count("__d") == 0, "single").when(rising, "MONOTONE_UP").when(falling, "MONOTONE_DOWN").otherwise("NON_MONOTONE").alias("verdict"))


def linear_thresholds(scored: DataFrame, score: str, count: int = 200, pad: float = 1.05) -> list[float]:
    """`count` equal steps from 0 to a little over the largest score."""
    top = scored.agg(F.max(score)).first()[0]
    return [] if top is None else [float(x) for x in np.linspace(0.0, float(top) * pad, count)]


def sweep_identities(sweep: DataFrame, base_rate: float, tolerance: float = 1e-9) -> DataFrame:
    """check_name, n_bad, n: identities that hold between the columns of any sweep."""
    c = F.col
    approved_bad = c("n_approved") * c("default_rate_approved")
    rejected = c("n_all") - c("n_approved")
    w = W.orderBy("threshold")  # as many rows as thresholds
    rows = sweep.crossJoin(F.broadcast(sweep.agg(F.max(F.when(c("approval_rate") > 0, c("n_approved") / c("approval_rate"))).alias("n_all"))))  # one row
    rows = rows.withColumn("n_fall", (c("n_approved") < F.lag("n_approved").over(w)).cast("int"))
    checks = {
        "youden_is_tpr_minus_fpr": F.abs(c("youden_j") - (c("tpr") - c("fpr"))) > tolerance, "approval_rate_in_0_1": ~c("approval_rate").between(0, 1),
        "counts_never_fall": c("n_fall") == 1, "rates_reconcile": (c("n_approved") > 0) & (F.abs(approved_bad + c("tpr") * base_rate * c("n_all") - base_rate * c("n_all")) > 1e-6 * c("n_all")),
        "rejected_not_negative": rejected < -tolerance,
    }
    one = rows.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(x, F.lit(False))).alias(k) for k, x in checks.items()])
    return one.select("n", F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in checks]), F.array(*checks))).alias("check_name", "n_bad"))


def category_pivot(results: DataFrame, parameter: str, category: str = "category", values: tuple[str, ...] = ("approve_all", "interior", "reject_most")) -> DataFrame:
    """Number of cells of each category by the value of a parameter."""
    return results.groupBy(parameter).pivot(category, list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))


def adaptive_thresholds(scored: DataFrame, score: str, count: int = 200) -> list[float]:
    """At most `count` thresholds at equal steps of the score's own distribution, distinct and rounded to 1e-6."""
    q = quantiles(scored, score, [i / (count - 1) for i in range(count)]).first()["q"]  # `count` numbers
    return sorted({round(x, 6) for x in q if x is not None})


def sweep_audit(sweep: DataFrame, metric: str = "expected_profit") -> DataFrame:
    """One row: number of thresholds, the best one, whether it is at an end, and how often the approval rate falls."""
    w = W.orderBy("threshold")  # as many rows as thresholds
    steps = sweep.withColumn("__fall", (F.col("approval_rate") < F.lag("approval_rate").over(w)).cast("int"))
    out = steps.agg(F.count("*").alias("n"), F.min("threshold").alias("lo"), F.max("threshold").alias("hi"), F.max_by("threshold", F.struct(metric, -F.col("threshold"))).alias("best"), F.max(metric).alias("most"), F.sum(F.coalesce("__fall", F.lit(0))).alias("n_falls"))
    return out.select("n", "best", "most", ((F.col("best") == F.col("lo")) | (F.col("best") == F.col("hi"))).alias("at_end"), (F.col("n_falls") == 0).alias("monotone"))


def grid_means(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg("LT_EL").alias("mean_LT_EL"), F.avg("LT_margin").alias("mean_LT_margin"), F.avg("Expected_Profit").alias("mean_profit"), F.avg((F.col("Expected_Profit") > 0).cast("int")).alias("share_positive"))


def threshold_sweep(scored: DataFrame, thresholds: list[float], apr: float, lgd: float) -> DataFrame:
    """Approval, classification and profit at every threshold (approved: score below it), in one scan.

    Rows are counted by the first threshold above their score; prefix sums over the thresholds do the rest.
    """
    ts = sorted(thresholds)
    edges = F.array(*[F.lit(float(t)) for t in ts])
    bucket = F.size(F.filter(edges, lambda t: t <= F.col("score")))  # approved by thresholds after these
    loan, years = F.col("loan_amount").cast("double"), F.col("n_installments") / 12
    sums = scored.groupBy(bucket.alias("b")).agg(
        F.count("*").alias("n"), F.sum("y").alias("pos"),
        F.sum((1 - F.col("y")) * loan * years).alias("ri"), F.sum(F.col("y") * loan).alias("rl"),
        F.sum((1 - F.col("score")) * loan * years).alias("ei"), F.sum(F.col("score") * loan).alias("el"),
    )
    spark = scored.sparkSession
    base = spark.createDataFrame([(i, float(t)) for i, t in enumerate(ts)], "b int, threshold double")
    every = base.join(sums, "b", "full_outer").fillna(0, ["n", "pos", "ri", "rl", "ei", "el"])
    w, whole = W.orderBy("b"), W.partitionBy()
    cols = ["n", "pos", "ri", "rl", "ei", "el"]
    run = every.select("threshold", *[F.sum(c).over(w).alias(c) for c in cols], F.sum("n").over(whole).alias("all_n"), F.sum("pos").over(whole).alias("all_pos")).filter("threshold is not null")
    c = F.col
    tpr, fpr = safe_div(c("all_pos") - c("pos"), c("all_pos")), safe_div((c("all_n") - c("all_pos")) - (c("n") - c("pos")), c("all_n") - c("all_pos"))
    return run.select(
        "threshold", c("n").alias("n_approved"), safe_div(c("n"), c("all_n")).alias("approval_rate"), safe_div(c("pos"), c("n")).alias("default_rate_approved"),
        tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("youden_j"), (apr * c("ri") - lgd * c("rl")).alias("realized_profit"), (apr * c("ei") - lgd * c("el")).alias("expected_profit"),
    )


def best_threshold(sweep: DataFrame, metric: str) -> DataFrame:
    return sweep.agg(F.max_by("threshold", F.struct(metric, -F.col("threshold"))).alias("threshold"), F.max(metric).alias(metric))


def approve_percents(rows: DataFrame, by: list[str], percents: list[int]) -> DataFrame:
    """Profit when the best `pct` percent (ties by account) are accepted; accounts are numbered by ranges, not in one task."""
    numbered = cumulative(rows.select(*by, F.struct("pd_stressed", "aid").alias("o"), "Expected_Profit", F.lit(1).alias("one")), "o", ["one"], by)
    return numbered.groupBy(*by).agg(*[F.sum(F.when(F.col("before_one") < F.floor(F.col("total_one") * p / 100), F.col("Expected_Profit")).otherwise(0.0)).alias(f"profit_{p}") for p in percents])


def stability(coarse: DataFrame, fine: DataFrame, key: str, column: str) -> DataFrame:
    """Change of a result between two sweeps: STABLE under 2 points, SHIFTED under 10, else UNSTABLE."""
    j = coarse.select(key, F.col(column).alias("a")).join(fine.select(key, F.col(column).alias("b")), key)
    gap = F.abs(F.col("a") - F.col("b"))
    return j.withColumn("verdict", F.when(gap < 2, "STABLE").when(gap < 10, "SHIFTED").otherwise("UNSTABLE"))


def nearest(df: DataFrame, targets: dict[str, float]) -> DataFrame:
    """The row with the least summed relative distance from the targets."""
    penalty = F.lit(0.0)
    for c, t in targets.items():
        penalty = penalty + F.abs(F.col(c) - t) / (abs(t) or 1.0)
    return df.agg(F.min_by(F.struct("*"), penalty).alias("r")).select("r.*")


def one_at_a_time(results: DataFrame, centre: dict[str, object]) -> DataFrame:
    """Rows of a grid that differ from the centre in at most one parameter."""
    off = F.lit(0)
    for k, v in centre.items():
        off = off + (F.col(k) != F.lit(v)).cast("int")
    return results.filter(off <= 1)
