"""Queries over the feature families at width, their catalog, audits of builds, and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearium.operators import audits, catalog, cutoffs, factory, metrics, models, whole_abt, wide
from arrearium.sources import derived
from arrearium.sources.shared import durable

from .queries_builders import _BASE_SQL, WITH, _base, _summary_sql
from .queries_scores import _model_rows
from .queries_wide import _PIVOT_SQL, _WIDE_SQL, ANCHORS, _months_rows, anchor_rows, assembled, youden_by_anchor
from .registry import query, rounded

#: The wide table without its summary.
_PLAIN_SQL = _WIDE_SQL.split(",\n  st2 AS")[0]


def _plain(spark: SparkSession, sf: str, columns: list[str] | None = None) -> DataFrame:
    return assembled(spark, sf, False, columns)


def _used(specs: list[tuple]) -> list[str]:
    """The columns that group statistics read."""
    return list(dict.fromkeys(["aid", "split", *[c for k, v, *_ in specs for c in (k, v) if c]]))


def _stat(value: str | None, stat: str, where: str) -> str:
    return {"mean": f"avg({value}) {where}", "std": f"stddev_samp({value}) {where}", "median": f"quantile_cont({value}::DOUBLE, 0.5) {where}", "count": f"count(*) {where}"}[stat]


def _groups_sql() -> str:
    train, specs = "FILTER (split = 'train')", factory.SPECS_A + factory.SPECS_B
    keys = list(dict.fromkeys(k for k, *_ in specs))
    tables = ", ".join(f"g{i} AS (SELECT {k} AS key, {', '.join(f'{_stat(v, s, "")} AS {n}' for key, v, s, n in specs if key == k)} FROM wq WHERE split = 'train' GROUP BY 1)" for i, k in enumerate(keys))
    whole = f"gw AS (SELECT {', '.join(f'{_stat(v, s, train)} AS w_{n}' for _, v, s, n in specs)} FROM wq)"
    joins = " ".join(f"LEFT JOIN g{i} ON g{i}.key = wq.{k}" for i, k in enumerate(keys))
    return f", {tables}, {whole} SELECT aid, {', '.join(f'round(coalesce({n}, w_{n}), 5) AS {n}' for _, _, _, n in specs)} FROM wq {joins}, gw"


@query(f"{WITH}, {_BASE_SQL}, {_PLAIN_SQL.replace('wq AS (', 'wq AS MATERIALIZED (')}{_groups_sql()}")
def group_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """52 statistics of application and loan columns by six keys, fitted on the training cohorts."""
    specs = factory.SPECS_A + factory.SPECS_B
    out = factory.group_statistics(durable(_plain(spark, sf, _used(specs))), specs, F.col("split") == "train")
    return rounded(out.select("aid", *[n for *_, n in specs]), 5)


def _families_sql() -> str:
    side = lambda x: x if isinstance(x, str) else f"{float(x)}"
    raw = {k: f"{side(a)}::DOUBLE / nullif({side(b)}, 0)" for k, (a, b) in factory.RATIOS.items()} | {k: f"ln(1 + greatest({c}, 0))" for k, c in factory.LOGS.items()}
    codes = [a[1:] for a, _ in factory.PRODUCTS.values() if a[0] == "#"]
    coded = ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS code_{c}" for c in codes)
    left = lambda a: f"code_{a[1:]}" if a[0] == "#" else a
    cuts = ", ".join(f"quantile_cont(r_{k}, 0.01) AS lo_{k}, quantile_cont(r_{k}, 0.99) AS hi_{k}" for k in raw)
    return f""", fr AS (SELECT *, {", ".join(f"{e} AS r_{k}" for k, e in raw.items())}, {coded} FROM wq), fq AS (SELECT {cuts} FROM fr)
      SELECT aid, {", ".join(f"round(CASE WHEN r_{k} IS NOT NULL THEN greatest(least(r_{k}, hi_{k}), lo_{k}) END, 6) AS {k}" for k in raw)}, {", ".join(f"round({left(a)}::DOUBLE * {b}, 6) AS {k}" for k, (a, b) in factory.PRODUCTS.items())} FROM fr, fq"""


_FAMILIES_USED = list(dict.fromkeys(["aid", *[x.lstrip("#") for p in [*factory.RATIOS.values(), *factory.PRODUCTS.values()] for x in p if isinstance(x, str)], *factory.LOGS.values()]))


@query(f"{WITH}, {_BASE_SQL}, {_PLAIN_SQL.replace('wq AS (', 'wq AS MATERIALIZED (')}{_families_sql()}")
def ratios_and_products(spark: SparkSession, sf: str) -> DataFrame:
    """Twelve ratios and logs cut at their percentiles, and nine products."""
    return rounded(factory.ratios_and_products(durable(_plain(spark, sf, _FAMILIES_USED))).select("aid", *factory.RATIOS, *factory.LOGS, *factory.PRODUCTS))


@query()
def feature_table_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table with all families and bureau-like noise against its catalog: checks, and features by family."""
    specs, plain = factory.SPECS_A + factory.SPECS_B, _plain(spark, sf)  # as wide as it is, it is made in the pass that checks it
    read = durable(_plain(spark, sf, list(dict.fromkeys([*_used(specs), *_FAMILIES_USED]))))
    made = factory.group_statistics(plain, specs, F.col("split") == "train", fitted=read)
    made, noise = factory.bureau_like(factory.ratios_and_products(made, read), fitted=read)
    cat = catalog.catalog(spark, plain.columns, [*factory.lines_of_families(), *noise])
    checks = catalog.checks(made, cat, read.count())
    families = catalog.family_summary(cat).select(F.concat(F.lit("eligible in "), "feature_family").alias("check_name"), F.col("n_eligible").alias("value"), (F.col("n_eligible") <= F.col("n")).alias("ok"))
    return checks.union(families)


_SERIES_PAIRS = [f"{s}_m{m}" for s in ("act_due", "act_utl", "act_dueinc", "act_days", "act_cc", "act_loaninc", "act_cus_utl", "act_cus_cc") for m in (2, 6, 12)]
_PAIRS = [(a, b) for i, a in enumerate(_SERIES_PAIRS) for b in _SERIES_PAIRS[i + 1 :]]


@query(f"{WITH}, {_BASE_SQL}, {_PIVOT_SQL.replace('wp AS (', 'wp AS MATERIALIZED (')} SELECT a, b, round(r, 5) AS corr FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 AND stddev_pop({b}) > 0 THEN corr({a}, {b}) END AS r FROM wp" for a, b in _PAIRS) + ")")
def correlation_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Correlations of all pairs of 24 monthly columns, in blocks of seven columns."""
    return rounded(wide.correlations(_months_rows(spark, sf, _SERIES_PAIRS), _SERIES_PAIRS, block=7), 5)


# Audits of builds and of sweeps

_AUDITED = [*whole_abt.COLUMNS, "summary_period"]


@query(f"{WITH}, {_BASE_SQL}, {_summary_sql()}, {_WIDE_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, {c == 'default_flag_12m'} AS allowed, {c == 'default_flag_12m'} OR count(*) FILTER ({c} IS NULL) = 0 AS ok FROM ww" for c in _AUDITED))
def null_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls of every column of the wide table, its summary included; only the target may be missing."""
    return audits.null_audit(assembled(spark, sf, True), _AUDITED, ["default_flag_12m"])


@query(f"{WITH}, {_BASE_SQL}, {_PLAIN_SQL} SELECT max(fin_period) FILTER (split = 'train') AS last_first, min(fin_period) FILTER (split = 'oot') AS first_second, 0::BIGINT AS n_shared, max(fin_period) FILTER (split = 'train') < min(fin_period) FILTER (split = 'oot') AS pure FROM wq")
def split_purity(spark: SparkSession, sf: str) -> DataFrame:
    return audits.split_purity(durable(_plain(spark, sf, ["aid", "fin_period", "split"])), "split", "fin_period", "aid")


_STEP_GROUPS = {"application": whole_abt.APPLICATION, "months": [f"act_due_m{m}" for m in whole_abt.MONTHS], "target": ["default_flag_12m"]}


def _report_sql() -> str:
    share = lambda cs: "(" + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in cs) + f") / (count(*) * {len(cs)})"
    step = lambda name, table, where, n, groups: " UNION ALL ".join([f"SELECT '{name}' AS step, 'rows' AS metric, count(*)::DOUBLE AS value FROM {table} {where}", f"SELECT '{name}', 'accounts', count(DISTINCT aid)::DOUBLE FROM {table} {where}", f"SELECT '{name}', 'columns', {n}", *[f"SELECT '{name}', 'null_share_{g}', round({share(cs)}, 6) FROM {table} {where}" for g, cs in groups.items()]])
    base = {"application": whole_abt.APPLICATION}
    n = len([c for c in whole_abt.COLUMNS if c not in whole_abt.SUMMARY])
    return " UNION ALL ".join([step("base", "base", "", 36, base), step("wide", "wq", "", n, _STEP_GROUPS), step("kept", "wq", "WHERE split <> 'exclude'", n, _STEP_GROUPS)])


@query(f"{WITH}, {_BASE_SQL}, {_PLAIN_SQL.replace('wq AS (', 'wq AS MATERIALIZED (')} {_report_sql()}")
def step_report(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, accounts, columns and nulls by group of columns after each step of the wide build."""
    plain = _plain(spark, sf)  # each step reads a few of its columns
    return rounded(audits.step_report({"base": _base(spark, sf), "wide": plain, "kept": plain.filter("split <> 'exclude'")}, _STEP_GROUPS))


@query(f"""{WITH}, t AS (SELECT (SELECT max(score) FROM scores) * 1.05 * i / 199.0 AS threshold FROM (SELECT unnest(range(0, 200)) AS i)), tot AS (SELECT count(*) AS an, sum(y) AS ap FROM scores),
  sw AS (SELECT threshold, count(aid) AS n, coalesce(sum(y), 0) AS pos, coalesce(sum((1 - y) * loan_amount * n_installments / 12), 0) AS ri, coalesce(sum(y * loan_amount), 0) AS rl FROM t LEFT JOIN scores ON score < threshold GROUP BY threshold)
  SELECT round(threshold, 6) AS threshold, n AS n_approved, round(pos / nullif(n, 0), 6) AS default_rate_approved, round((ap - pos) / ap - ((an - ap) - (n - pos)) / (an - ap), 6) AS youden_j, round(0.18 * ri - 0.45 * rl, 1) AS realized_profit FROM sw, tot""")
def linear_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """200 equal steps to a little over the largest score."""
    s = derived.scores(spark, sf)
    out = cutoffs.threshold_sweep(s, cutoffs.linear_thresholds(s, "score"), 0.18, 0.45)
    return rounded(out.select("threshold", "n_approved", "default_rate_approved", "youden_j", F.round("realized_profit", 1).alias("realized_profit")))


_IDENTITIES = {
    "youden_is_tpr_minus_fpr": "abs(youden - (tpr - fpr)) > 1e-9", "approval_rate_in_0_1": "NOT n / an BETWEEN 0 AND 1", "counts_never_fall": "n < before", "rates_reconcile": "n > 0 AND abs(n * (pos / n) + tpr * ap - ap) > 1e-6 * an", "rejected_not_negative": "an - n < 0",
}


@query(f"""{WITH}, t AS (SELECT (SELECT max(score) FROM scores) * 1.05 * i / 199.0 AS threshold FROM (SELECT unnest(range(0, 200)) AS i)), tot AS (SELECT count(*) AS an, sum(y) AS ap FROM scores),
  sw AS (SELECT threshold, count(aid) AS n, coalesce(sum(y), 0) AS pos FROM t LEFT JOIN scores ON score < threshold GROUP BY threshold),
  sx AS (SELECT *, (ap - pos) / ap AS tpr, ((an - ap) - (n - pos)) / (an - ap) AS fpr, (ap - pos) / ap - ((an - ap) - (n - pos)) / (an - ap) AS youden, lag(n) OVER (ORDER BY threshold) AS before FROM sw, tot)
  """ + " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER ({e}) AS n_bad, count(*) AS n FROM sx" for k, e in _IDENTITIES.items()))
def sweep_identities(spark: SparkSession, sf: str) -> DataFrame:
    """Identities between the columns of the sweep, all of which have to hold."""
    s = derived.scores(spark, sf)
    rate = s.agg(F.avg("y")).first()[0]
    return cutoffs.sweep_identities(cutoffs.threshold_sweep(s, cutoffs.linear_thresholds(s, "score"), 0.18, 0.45), rate)


@query()
def pd_quality_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Later arrears' score and three blurs of it, under four anchors and three running costs: 48 cells with their cut-offs."""
    rows = _model_rows(spark, sf).select("aid", "y", "loan_amount", "n_installments", ((1 + F.coalesce("due_max_6", F.lit(0))) / 40.0).alias("raw"))
    whole = metrics.discrimination(rows, "raw", "y").first()["gini"] or 0.0
    out = None
    for name, share in (("raw", 1.0), ("three_quarters", 0.75), ("half", 0.5), ("quarter", 0.25)):
        scored = rows.withColumn("score", F.col("raw")) if share == 1.0 else models.perturb_to_gini(rows, "raw", "y", "aid", share * whole).withColumn("score", F.col("raw_perturbed"))
        scored = durable(scored.select("aid", "y", "loan_amount", "n_installments", "score"))
        limits = youden_by_anchor(anchor_rows(scored))
        cells = cutoffs.linear_scenarios(scored, ANCHORS, [0.0, 0.02, 0.04], limits)
        cells = cells.select(F.lit(name).alias("variant"), "anchor", "op", "n", "mean_profit", "share_positive", "approve_pct", "approve_pct_fixed", "max_profit", (F.col("max_profit") - F.col("profit_at_fixed")).alias("profit_uplift"), "category")
        out = cells if out is None else out.union(cells)
    return rounded(out, 4)
