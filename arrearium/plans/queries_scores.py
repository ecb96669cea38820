"""Queries over scores, economics, cut-offs, scorecards and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearium.functions.scalars import apr_tier, one_period_profit
from arrearium.operators import cutoffs, economics, features, metrics, models, resample, scorecard
from arrearium.sources import derived
from arrearium.sources.derived import PANEL_SQL
from arrearium.sources.shared import durable

from .registry import query, rounded

WITH = f"WITH {PANEL_SQL}"
CUM = """g AS (SELECT n_installments, score AS v, sum(y) AS pos, count(*) - sum(y) AS neg FROM scores GROUP BY ALL),
 cum AS (SELECT *, coalesce(sum(pos) OVER b, 0) AS bp, coalesce(sum(neg) OVER b, 0) AS bn, sum(pos) OVER w AS tp, sum(neg) OVER w AS tn FROM g
   WINDOW b AS (PARTITION BY n_installments ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY n_installments))"""


@query(f"""{WITH}, {CUM}, d AS (SELECT n_installments, sum(pos + neg) AS n, round(2 * sum(pos * (bn + neg / 2)) / (max(tp) * max(tn)) - 1, 6) AS gini, round(max(abs((bp + pos) / tp - (bn + neg) / tn)), 6) AS ks FROM cum GROUP BY ALL)
  SELECT d.*, round(b.brier, 6) AS brier, round(b.base_rate, 6) AS base_rate, round(b.mean_pred, 6) AS mean_pred FROM d JOIN (SELECT n_installments, avg((y - score) ** 2) AS brier, avg(y) AS base_rate, avg(score) AS mean_pred FROM scores GROUP BY ALL) b USING (n_installments)""")
def model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    s = derived.scores(spark, sf)
    return rounded(metrics.discrimination(s, "score", "y", ["n_installments"]).join(metrics.brier(s, "score", "y", ["n_installments"]), "n_installments"))


_EDGES = "e AS (SELECT list_distinct(quantile_cont(score, [" + ", ".join(str(i / 10) for i in range(11)) + "])) AS e FROM scores), inner_e AS (SELECT list_sort(e)[2:len(e) - 1] AS e FROM e)"


@query(f"{WITH}, {_EDGES}, b AS (SELECT s.*, len(list_filter(e, lambda x: x <= score)) AS bin FROM scores s, inner_e) SELECT bin, count(*) AS n, round(avg(y), 6) AS observed, round(avg(score), 6) AS expected, round(avg(y) / avg(score), 6) AS o_to_e FROM b GROUP BY bin")
def calibration_bins(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.calibration_bins(derived.scores(spark, sf), "score", "y"))


@query(f"{WITH}, {_EDGES}, b AS (SELECT s.*, len(list_filter(e, lambda x: x <= score)) AS bin FROM scores s, inner_e), c AS (SELECT bin, count(*) AS n, avg(y) AS o, avg(score) AS p FROM b GROUP BY bin) SELECT round(sum(abs(o - p) * n) / sum(n), 6) AS ece FROM c")
def calibration_error(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.ece(metrics.calibration_bins(derived.scores(spark, sf), "score", "y")))


@query(f"{WITH}, r AS (SELECT *, row_number() OVER (ORDER BY score, aid) AS rn, count(*) OVER () AS n FROM scores) SELECT greatest(ceil((rn - 1) * 10 / greatest(n - 1, 1)) - 1, 0)::INT AS bin, count(*) AS n, round(avg(score), 6) AS mean_pred, round(avg(y), 6) AS obs_rate FROM r GROUP BY 1")
def reliability(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.reliability(derived.scores(spark, sf), "score", "y", "aid"))


@query(f"{WITH}, g AS (SELECT score AS v, sum(y) AS pos, count(*) - sum(y) AS neg FROM scores GROUP BY 1), c AS (SELECT *, coalesce(sum(pos) OVER b, 0) AS bp, coalesce(sum(neg) OVER b, 0) AS bn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM g WINDOW b AS (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT round(v, 6) AS threshold, round((tp - bp) / tp, 6) AS tpr, round((tn - bn) / tn, 6) AS fpr, round((tp - bp) / tp - (tn - bn) / tn, 6) AS youden FROM c")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.roc(derived.scores(spark, sf), "score", "y"))


_T = [round(0.01 * i, 4) for i in range(1, 100)]
_SWEEP = f"""t AS (SELECT unnest([{", ".join(map(str, _T))}])::DOUBLE AS threshold), tot AS (SELECT count(*) AS an, sum(y) AS ap FROM scores),
  sw AS (SELECT threshold, count(aid) AS n, coalesce(sum(y), 0) AS pos, coalesce(sum((1 - y) * loan_amount * n_installments / 12), 0) AS ri, coalesce(sum(y * loan_amount), 0) AS rl,
    coalesce(sum((1 - score) * loan_amount * n_installments / 12), 0) AS ei, coalesce(sum(score * loan_amount), 0) AS el FROM t LEFT JOIN scores ON score < threshold GROUP BY threshold)"""


@query(f"""{WITH}, {_SWEEP} SELECT threshold, n AS n_approved, round(n / an, 6) AS approval_rate, round(pos / nullif(n, 0), 6) AS default_rate_approved, round((ap - pos) / ap, 6) AS tpr, round(((an - ap) - (n - pos)) / (an - ap), 6) AS fpr,
  round((ap - pos) / ap - ((an - ap) - (n - pos)) / (an - ap), 6) AS youden_j, round(0.18 * ri - 0.45 * rl, 2) AS realized_profit, round(0.18 * ei - 0.45 * el, 2) AS expected_profit FROM sw, tot""")
def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    out = cutoffs.threshold_sweep(derived.scores(spark, sf), _T, 0.18, 0.45)
    return rounded(out.withColumns({c: F.round(c, 2) for c in ("realized_profit", "expected_profit")}))


@query(f"""{WITH}, {_SWEEP}, g AS (SELECT unnest([0.12, 0.18, 0.24, 0.30]) AS apr), l AS (SELECT unnest([0.35, 0.45, 0.6]) AS lgd)
  SELECT apr::DOUBLE AS apr, lgd::DOUBLE AS lgd, round(max(apr * ei - lgd * el), 2) AS expected_profit FROM sw, g, l GROUP BY apr, lgd""")
def apr_lgd_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    """Best expected profit for each rate and loss: profit is linear in both, so one sweep serves all cells."""
    s = derived.scores(spark, sf)
    base = cutoffs.threshold_sweep(s, _T, 1.0, 0.0).select("threshold", F.col("expected_profit").alias("ei"))
    loss = cutoffs.threshold_sweep(s, _T, 0.0, 1.0).select("threshold", (-F.col("expected_profit")).alias("el"))
    cells = cutoffs.grid(spark, apr=[0.12, 0.18, 0.24, 0.30], lgd=[0.35, 0.45, 0.6])
    rows = base.join(loss, "threshold").crossJoin(F.broadcast(cells))  # thresholds x cells
    return rows.groupBy("apr", "lgd").agg(F.round(F.max(F.col("apr") * F.col("ei") - F.col("lgd") * F.col("el")), 2).alias("expected_profit"))


_APR = "CASE WHEN {p} < 0.005 THEN 0.12 WHEN {p} < 0.01 THEN 0.18 WHEN {p} < 0.02 THEN 0.22 WHEN {p} < 0.05 THEN 0.26 ELSE 0.30 END"


@query(f"""{WITH}, a AS (SELECT aid, loan_amount, n_installments, 0.18 AS apr FROM accounts), m AS (SELECT *, unnest(range(1, n_installments + 1)) AS month, (1 + apr / 12) ** n_installments AS g FROM a)
  SELECT aid, month, round(loan_amount * (g - (1 + apr / 12) ** (month - 1)) / (g - 1), 4) AS balance_begin, round(loan_amount * (apr / 12) * g / (g - 1), 4) AS payment,
    round(loan_amount * (g - (1 + apr / 12) ** (month - 1)) / (g - 1) * apr / 12, 4) AS interest FROM m""")
def amortization(spark: SparkSession, sf: str) -> DataFrame:
    a = derived.accounts(spark, sf).withColumn("apr", F.lit(0.18))
    return rounded(economics.amortization(a).select("aid", "month", "balance_begin", "payment", "interest"), 4)


@query(f"{WITH}, m AS (SELECT aid, score, unnest(range(1, n_installments + 1)) AS month, 1 - (1 - score) ** (1 / 12.0) AS h FROM scores) SELECT month, round(sum((1 - h) ** (month - 1)), 4) AS survival, round(sum((1 - h) ** (month - 1) * h), 4) AS marginal FROM m GROUP BY month")
def marginal_pd(spark: SparkSession, sf: str) -> DataFrame:
    m = economics.marginal_pd(derived.scores(spark, sf).withColumn("pd", F.col("score")))
    return rounded(m.groupBy("month").agg(F.sum("survival_begin").alias("survival"), F.sum("marginal_pd").alias("marginal")), 4)


def _explicit(apr: str, where: str = "") -> str:
    """Monthly sums of the economics, as a check of the closed form."""
    return f"""lm AS (SELECT aid, loan_amount AS L, n_installments AS n, ({apr})::DOUBLE AS apr, 1 - (1 - least(score, 0.999)) ** (1 / 12.0) AS h, unnest(range(1, n_installments + 1)) AS t FROM scores {where}),
      lb AS (SELECT *, L * ((1 + apr / 12) ** n - (1 + apr / 12) ** (t - 1)) / ((1 + apr / 12) ** n - 1) AS bal, (1 - h) ** (t - 1) AS s, (1 + 0.05 / 12) ** (-t) AS d FROM lm),
      le AS (SELECT aid, sum(s * h * 0.45 * bal * d) AS LT_EL, sum((s * bal * greatest(apr - 0.03, 0) / 12 - s * L * 0.02 / 12) * d) AS LT_margin FROM lb GROUP BY aid)"""


@query(f"{WITH}, {_explicit(_APR.format(p='score'))} SELECT aid, round(LT_EL, 3) AS LT_EL, round(LT_margin, 3) AS LT_margin, round(LT_margin - LT_EL - 50, 3) AS Expected_Profit FROM le")
def lifetime_economics(spark: SparkSession, sf: str) -> DataFrame:
    """Closed form; its SQL sums the months one by one."""
    s = derived.scores(spark, sf).withColumn("pd", F.col("score")).withColumn("apr", apr_tier(F.col("score")))
    return rounded(economics.with_lifetime(s, lgd=0.45, op=0.02, disc=0.05, cof=0.03, acq=50.0).select("aid", "LT_EL", "LT_margin", "Expected_Profit"), 3)


@query(f"{WITH}, {_explicit('0.18')}, a AS (SELECT n_installments, (1 - score) * loan_amount * 0.18 - score * loan_amount * 0.45 AS asb, LT_margin - LT_EL AS p FROM scores JOIN le USING (aid)) SELECT n_installments, count(*) AS n, round(avg(p), 3) AS mean_lifetime, round(avg(asb), 3) AS mean_one_period, round(sum(p), 1) AS total_lifetime FROM a GROUP BY ROLLUP (n_installments)")
def one_period_comparison(spark: SparkSession, sf: str) -> DataFrame:
    s = derived.scores(spark, sf).withColumn("pd", F.col("score")).withColumn("apr", F.lit(0.18))
    e = economics.with_lifetime(s, lgd=0.45, op=0.02, disc=0.05, cof=0.03, acq=0.0)
    e = e.withColumn("asb", one_period_profit(F.col("score"), F.col("loan_amount"), F.lit(0.18), F.lit(0.45)))
    out = e.rollup("n_installments").agg(F.count("*").alias("n"), F.avg("Expected_Profit").alias("mean_lifetime"), F.avg("asb").alias("mean_one_period"), F.round(F.sum("Expected_Profit"), 1).alias("total_lifetime"))
    return rounded(out, 3)


_AXES = {"pd_mult": [0.8, 1.0, 1.5, 2.0], "strategy": ["tiered", "tiered_cap24", "flat18", "flat24"], "cof": [0.0, 0.03, 0.06], "acq": [0.0, 50.0, 150.0], "lgd": [0.35, 0.45, 0.6, 0.75]}
_BASE = {"op": [0.02], "disc": [0.05]}


def _geo(x: str) -> str:
    return f"(CASE WHEN abs({x} - 1) < 1e-12 THEN n ELSE (({x}) ** n - 1) / ({x} - 1) END)"


_GRID = f"""sc AS (SELECT pd_mult, strategy, cof, acq, lgd FROM (SELECT unnest({_AXES["pd_mult"]})::DOUBLE AS pd_mult) a, (SELECT unnest({_AXES["strategy"]}) AS strategy) b, (SELECT unnest({_AXES["cof"]})::DOUBLE AS cof) c, (SELECT unnest({_AXES["acq"]})::DOUBLE AS acq) d, (SELECT unnest({_AXES["lgd"]})::DOUBLE AS lgd) e),
  ac AS (SELECT s.score, s.loan_amount AS L, s.n_installments AS n, sc.*, least(score * pd_mult, 0.999) AS p,
    (CASE strategy WHEN 'tiered' THEN {_APR.format(p="score")} WHEN 'tiered_cap24' THEN least({_APR.format(p="score")}, 0.24) WHEN 'flat18' THEN 0.18 ELSE 0.24 END)::DOUBLE AS apr FROM scores s, sc),
  ah AS (SELECT *, 1 - (1 - p) ** (1 / 12.0) AS h, 1 / (1 + 0.05 / 12) AS d, (1 + apr / 12) ** n AS g FROM ac), ay AS (SELECT *, (1 - h) * d AS yy, (1 - h) * d * (1 + apr / 12) AS yr FROM ah),
  ab AS (SELECT *, L * d * (g * {_geo("yy")} - {_geo("yr")}) / (g - 1) AS bal, L * 0.02 / 12 * d * {_geo("yy")} AS opc FROM ay),
  ap AS (SELECT *, greatest(apr - cof, 0) / 12 * bal - opc - h * lgd * bal - acq AS profit FROM ab),
  gp AS (SELECT pd_mult, strategy, cof, acq, lgd, p, count(*) AS n, sum(profit) AS profit FROM ap GROUP BY ALL),
  gr AS (SELECT *, sum(n) OVER w AS k, sum(profit) OVER w AS cum FROM gp WINDOW w AS (PARTITION BY pd_mult, strategy, cof, acq, lgd ORDER BY p)),
  gb AS (SELECT pd_mult, strategy, cof, acq, lgd, sum(n) AS n, sum(profit) AS total, max(cum) AS best, arg_max(k, cum) AS k FROM gr GROUP BY ALL)"""


@query(f"{WITH}, {_GRID} SELECT pd_mult, strategy, cof, acq, lgd, n, round(total, 0) AS total_profit, round(CASE WHEN best > 0 THEN 100 * k / n ELSE 0 END, 4) AS approve_pct, CASE WHEN best <= 0 OR 100 * k / n < 50 THEN 'reject_most' WHEN 100 * k / n >= 99 THEN 'approve_all' ELSE 'interior' END AS category FROM gb")
def stress_grid(spark: SparkSession, sf: str) -> DataFrame:
    """576 scenarios with totals and the profit-optimal cut-off of each.

    Profit is linear in all parameters but the stress of the PD and the price, so accounts meet 16 scenarios, not 576.
    """
    out = cutoffs.linear_grid(derived.scores(spark, sf), {**_AXES, "op": _BASE["op"]}, _BASE["disc"][0], shares=False)
    return out.select(*_AXES, "n", F.round("total_profit", 0).alias("total_profit"), F.round("approve_pct", 4).alias("approve_pct"), "category")


_CELLS = {"strategy": ["tiered", "flat12", "flat18", "flat24", "flat30"], "lgd": [0.45, 0.55, 0.65, 0.75, 0.85], "disc": [0.0, 0.05], "op": [0.0, 0.01, 0.02]}


@query(f"""{WITH}, cells AS (SELECT strategy, lgd, disc, op FROM (SELECT unnest({_CELLS["strategy"]}) AS strategy) a, (SELECT unnest({_CELLS["lgd"]})::DOUBLE AS lgd) b, (SELECT unnest({_CELLS["disc"]})::DOUBLE AS disc) c, (SELECT unnest({_CELLS["op"]})::DOUBLE AS op) d),
  ca AS (SELECT loan_amount AS L, n_installments AS n, 1 - (1 - least(score, 0.999)) ** (1 / 12.0) AS h, (CASE strategy WHEN 'tiered' THEN {_APR.format(p="score")} ELSE right(strategy, 2)::DOUBLE / 100 END)::DOUBLE AS apr, cells.* FROM scores, cells),
  cb AS (SELECT *, 1 / (1 + disc / 12) AS d, (1 + apr / 12) ** n AS g FROM ca), cy AS (SELECT *, (1 - h) * d AS yy, (1 - h) * d * (1 + apr / 12) AS yr FROM cb),
  cc AS (SELECT *, L * d * (g * {_geo("yy")} - {_geo("yr")}) / (g - 1) AS bal, L * op / 12 * d * {_geo("yy")} AS opc FROM cy), ce AS (SELECT *, h * lgd * bal AS el, apr / 12 * bal - opc AS margin FROM cc)
  SELECT strategy, lgd, disc, op, round(avg(el), 4) AS mean_LT_EL, round(avg(margin), 4) AS mean_LT_margin, round(avg(margin - el), 4) AS mean_profit, round(avg((margin - el > 0)::INT), 4) AS share_positive FROM ce GROUP BY ALL""")
def sensitivity_grid(spark: SparkSession, sf: str) -> DataFrame:
    """150 cells of price, loss, discount and running cost: mean economics of each."""
    out = cutoffs.linear_means(derived.scores(spark, sf), _CELLS["strategy"], _CELLS["lgd"], _CELLS["disc"], _CELLS["op"])
    return rounded(out, 4)


_SHARES = [50, 60, 70, 80, 90, 100]


@query(f"""{WITH}, {_GRID}, rk AS (SELECT a.strategy, s.aid, a.profit, row_number() OVER w AS rn, count(*) OVER (PARTITION BY a.strategy) AS n FROM
    (SELECT DISTINCT score, n, L, strategy, p, profit FROM ap WHERE pd_mult = 1 AND strategy IN ('tiered', 'flat24') AND cof = 0.03 AND acq = 50 AND lgd = 0.45) a JOIN scores s ON s.score = a.score AND s.n_installments = a.n AND s.loan_amount = a.L WINDOW w AS (PARTITION BY a.strategy ORDER BY a.p, s.aid))
  SELECT strategy, {", ".join(f"round(sum(CASE WHEN rn <= floor(n * {p} / 100) THEN profit ELSE 0 END), 1) AS profit_{p}" for p in _SHARES)} FROM rk GROUP BY strategy""")
def approve_percents(spark: SparkSession, sf: str) -> DataFrame:
    axes = {"pd_mult": [1.0], "strategy": ["tiered", "flat24"], "cof": [0.03], "acq": [50.0], "lgd": [0.45]}
    rows = cutoffs.scenario_rows(derived.scores(spark, sf), cutoffs.grid(spark, **axes, **_BASE))
    return rounded(cutoffs.approve_percents(rows, ["strategy"], _SHARES), 1)


@query()
def bootstrap_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Confidence intervals of the optimal cut-off by Poisson bootstrap."""
    axes = {"pd_mult": [1.0], "strategy": ["tiered", "flat24"], "cof": [0.03], "acq": [50.0], "lgd": [0.45]}
    rows = cutoffs.scenario_rows(derived.scores(spark, sf), cutoffs.grid(spark, **axes, **_BASE))
    reps = resample.profit_cutoff(resample.weights(rows, "aid", 100), ["strategy", "replicate"], "pd_stressed", "Expected_Profit")
    return rounded(resample.ci_summary(reps, ["strategy"], ["approve_pct", "max_profit"]))


@query()
def bootstrap_default_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Exact-size bootstrap within tenor and class: rows of each replicate and its default rate."""
    s = derived.scores(spark, sf).select("aid", "n_installments", "y")
    drawn = resample.exact_sums(s, ["n_installments", "y"], ["n_installments"], "aid", 20, ["y"])
    return rounded(drawn.select("replicate", "n_installments", "n", (F.col("y") / F.col("n")).alias("dr")))


@query(f"{WITH}, h AS (SELECT least(floor(score * 60), 59)::INT AS bin, y FROM scores) SELECT bin, count(*) AS n, round(avg(y), 6) AS dr FROM h GROUP BY bin")
def score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    s = derived.scores(spark, sf)
    return rounded(s.groupBy(F.least(F.floor(F.col("score") * 60), F.lit(59)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("y").alias("dr")))


def _model_rows(spark: SparkSession, sf: str) -> DataFrame:
    # Accounts are dealt with their client before they have months, which are then read once.
    p = derived.panel(spark, sf, by="cid", with_clients=True).withColumn("m", F.col("k") + 1)
    also = {c: F.first(c) for c in ("loan_amount", "n_installments", "fin_period", "income", "job_code")} | {"y": F.max(((F.col("k") >= 6) & (F.col("due_installments") >= 4)).cast("int"))}
    rows = features.rolling(p, {"due": "due_installments", "days": "pay_days"}, (3, 6), ("cid", "aid"), also=also).withColumn("split", F.when(F.col("fin_period") < 199600, "train").otherwise("oot"))
    rows = rows.select("aid", "y", "split", "job_code", "n_installments", "fin_period", *_NUMERIC)  # statistics that none reads aren't made
    # A fit is hundreds of short scans, so rows lie in fewer parts than their months; coalescing shuffles nothing.
    parts = derived.accounts(spark, sf).count() // derived.DEALT + 1
    return durable(rows.coalesce(max(min(parts, 2 * spark.sparkContext.defaultParallelism), parts // 20)))


_NUMERIC = ["due_mean_3", "due_max_6", "days_mean_6", "days_max_3", "loan_amount", "income"]


@query()
def woe_scorecard(spark: SparkSession, sf: str) -> DataFrame:
    """Scorecard of binned features from a logit on their weights of evidence."""
    rows = _model_rows(spark, sf)
    bins = scorecard.fit_numeric(rows.filter("split = 'train'"), _NUMERIC, "y")
    bins["job_code"] = scorecard.fit_categorical(rows.filter("split = 'train'"), "job_code", "y")
    woe = scorecard.apply_woe(rows, bins)
    names = [f"{c}_woe" for c in bins]
    fitted = models.fit_logit(woe.filter("split = 'train'"), names, [], "y", reg=0.001)
    lr, scale = fitted.stages[-1], fitted.stages[-2]
    betas = {c: float(b) / (float(s) or 1.0) for c, b, s in zip(bins, lr.coefficients, scale.std)}
    intercept = float(lr.intercept) - sum(float(b) * float(m) / (float(s) or 1.0) for b, m, s in zip(lr.coefficients, scale.mean, scale.std))
    return rounded(scorecard.scorecard_table(spark, bins, betas, intercept))


@query()
def feature_screening(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf)
    return rounded(metrics.screen(rows, _NUMERIC, "y", F.col("split") == "train"))


_UNI = ["loan_amount", "n_installments", "fin_period"]


@query(
    f"{WITH}, u AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS v, y FROM scores" for c in _UNI)
    + """), g AS (SELECT feature, v, sum(y) AS pos, count(*) - sum(y) AS neg FROM u GROUP BY ALL), c AS (SELECT *, coalesce(sum(pos) OVER b, 0) AS bp, coalesce(sum(neg) OVER b, 0) AS bn, sum(pos) OVER w AS tp, sum(neg) OVER w AS tn FROM g
      WINDOW b AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), w AS (PARTITION BY feature))
      SELECT feature, sum(pos + neg) AS n, round(2 * sum(pos * (bn + neg / 2)) / (max(tp) * max(tn)) - 1, 6) AS gini, round(max(abs((bp + pos) / tp - (bn + neg) / tn)), 6) AS ks FROM c GROUP BY feature"""
)
def univariate_gini(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.univariate(derived.scores(spark, sf), _UNI, "y"))


@query()
def perturbed_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Gini before and after blurring the rank score of later arrears to half its discrimination."""
    rows = _model_rows(spark, sf).withColumn("p", (1 + F.coalesce("due_max_6", F.lit(0))) / 12.0)
    before = metrics.discrimination(rows, "p", "y").first()["gini"] or 0.0
    blurred = models.perturb_to_gini(rows.select("aid", "y", "p"), "p", "y", "aid", before / 2)
    return rounded(metrics.discrimination(blurred, "p_perturbed", "y"), 4)


@query(f"{WITH}, b AS (SELECT n_installments, count(*) AS n, sum(y) AS e FROM scores GROUP BY 1), t AS (SELECT sum(e) + 1 AS bad, sum(n) - sum(e) + 1 AS good FROM b) SELECT n_installments, n, e AS events, round(ln(((e + 0.5) / bad) / ((n - e + 0.5) / good)), 6) AS woe FROM b, t")
def woe_by_level(spark: SparkSession, sf: str) -> DataFrame:
    b = scorecard.fit_categorical(derived.scores(spark, sf), "n_installments", "y", 0.0)
    rows = [(int(g[0]), n, e, w) for g, n, e, w in zip(b.levels, b.n, b.events, b.woe)]
    return rounded(spark.createDataFrame(rows, "n_installments int, n long, events long, woe double"))
