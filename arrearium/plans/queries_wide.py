"""Queries over the whole wide table and over many columns, cells or replicates at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearium.operators import cutoffs, metrics, resample, whole_abt, wide
from arrearium.operators.asof import as_of_join
from arrearium.sources import derived
from arrearium.sources.shared import durable

from .queries_builders import _BASE_SQL, WITH, _summary_sql
from .queries_scores import _APR, _geo
from .registry import query, rounded, scaled_rounded

FIRST, TRAIN_LAST, OOT_LAST = 199301, 199512, 199612

_MONTH = "((period // 100 - fin_period // 100) * 12 + period % 100 - fin_period % 100 + 1)"
_CELLS = ", ".join(f"max({s}) FILTER (m = {m}) AS {s}_m{m}" for s in whole_abt.SERIES for m in whole_abt.MONTHS)
_ORIGIN = ["cid", "fin_period", "act_age", *whole_abt.APPLICATION]
_WIDE_SQL = f"""bm AS (SELECT *, {_MONTH} AS m FROM base WHERE fin_period >= {FIRST}),
  wp AS (SELECT aid, {", ".join(f"max({c}) FILTER (m = 1) AS {c}" for c in _ORIGIN)}, {_CELLS} FROM bm WHERE m BETWEEN 1 AND 12 GROUP BY aid HAVING count(DISTINCT m) = 12),
  wo AS (SELECT aid, count(*) FILTER (coll_status = 8 AND k <= 12) > 0 AS early, CASE WHEN count(*) FILTER (coll_status = 8 AND k BETWEEN 12 AND 23) > 0 THEN 1 WHEN any_value(fin_no) + 23 <= (SELECT max(month_no) FROM panel) THEN 0 END AS default_flag_12m FROM panel GROUP BY aid),
  wq AS (SELECT wp.*, a.installment, a.n_installments, a.loan_amount, default_flag_12m, greatest({", ".join(f"act_due_m{m}" for m in whole_abt.MONTHS)}) AS max_due, greatest({", ".join(f"coll_status_m{m}" for m in whole_abt.MONTHS)}) AS max_coll_status,
    act_due_m12 - act_due_m1 AS trend_due, {" + ".join(f"(act_due_m{m} > 0)::INT" for m in whole_abt.MONTHS)} AS months_ever_due, {" + ".join(f"(coll_status_m{m} >= 2)::INT" for m in whole_abt.MONTHS)} AS months_coll_2plus,
    act_paid_installments_m12 / a.n_installments AS paid_fraction_at_obs, CASE default_flag_12m WHEN 1 THEN 'defaulted' WHEN 0 THEN 'closed' ELSE 'censored' END AS observation_status,
    CASE WHEN default_flag_12m IS NOT NULL AND fin_period BETWEEN {FIRST} AND {TRAIN_LAST} THEN 'train' WHEN default_flag_12m IS NOT NULL AND fin_period > {TRAIN_LAST} AND fin_period <= {OOT_LAST} THEN 'oot' ELSE 'exclude' END AS split,
    fin_period + 100 AS obs_period FROM wp JOIN wo ON wo.aid = wp.aid AND NOT early LEFT JOIN (SELECT aid, installment, n_installments, loan_amount FROM accounts) a ON a.aid = wp.aid),
  st2 AS MATERIALIZED (SELECT aid, period, {", ".join(whole_abt.SUMMARY)} FROM st),
  ww AS MATERIALIZED (SELECT wq.*, st2.period AS summary_period, {", ".join(f"st2.{c}" for c in whole_abt.SUMMARY)} FROM wq ASOF LEFT JOIN st2 ON wq.aid = st2.aid AND wq.obs_period >= st2.period)"""


def _transactions(spark: SparkSession, sf: str) -> DataFrame:
    return derived.panel(spark, sf, by="cid", with_clients=True, ordered=True)


def assembled(spark: SparkSession, sf: str, summary: bool, columns: list[str] | None = None) -> DataFrame:
    ends = derived.panel(spark, sf, by=None).agg(F.max("month_no").alias("last_no"))
    return whole_abt.assembled(_transactions(spark, sf), ends, summary, FIRST, TRAIN_LAST, OOT_LAST, columns)


_FITS = ", ".join([f"quantile_cont({c}::DOUBLE, 0.99) FILTER (split = 'train') AS cap_{c}" for c in whole_abt.CAPPED] + [f"quantile_cont({c}::DOUBLE, 0.5) FILTER (split = 'train') AS fill_{c}" for c in whole_abt.FILLED])
_OUT = {c: f"CASE WHEN {c} IS NOT NULL THEN least({c}, cap_{c}) END" for c in whole_abt.CAPPED} | {c: f"coalesce({c}::DOUBLE, fill_{c})" for c in whole_abt.FILLED}
_REAL = {"act_utl", "act_dueutl", "act_cc", "act_dueinc", "act_loaninc", "act_cus_utl", "act_cus_dueutl", "act_cus_cc"}


def _final(c: str) -> str:
    e = _OUT.get(c, c)
    return f"round({e}, 5) AS {c}" if c in _OUT or c.rpartition("_m")[0] in _REAL or c == "paid_fraction_at_obs" else e if e == c else f"{e} AS {c}"


@query(f"{WITH}, {_BASE_SQL}, {_summary_sql()}, {_WIDE_SQL}, fit AS (SELECT {_FITS} FROM ww) SELECT {', '.join(_final(c) for c in whole_abt.FINAL)} FROM ww, fit WHERE split <> 'exclude'")
def whole_wide_abt(spark: SparkSession, sf: str) -> DataFrame:
    """All 192 columns of the cleaned wide table; the summary is joined as of the observation month."""
    fits = whole_abt.fitted_cleaning(assembled(spark, sf, True, ["split", *whole_abt.CAPPED, *whole_abt.FILLED]))
    return scaled_rounded(whole_abt.cleaned(assembled(spark, sf, True), *fits), 5)  # made a second time: rows as wide are not written


_LEAKS = {
    "summary_after_observation": "summary_period > obs_period", "observation_not_12_months_on": "obs_period - fin_period <> 100", "train_cohort_after_oot": "split = 'train' AND fin_period >= (SELECT min(fin_period) FROM ww WHERE split = 'oot')",
    "labelled_without_split": "default_flag_12m IS NOT NULL AND observation_status = 'censored'", "target_among_features": "FALSE",
}


@query(f"{WITH}, {_BASE_SQL}, {_summary_sql()}, {_WIDE_SQL} " + " UNION ALL ".join(f"SELECT '{k}' AS check_name, count(*) FILTER ({e}) AS n_bad, count(*) AS n FROM ww" for k, e in _LEAKS.items()))
def abt_leak_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing known at the observation month comes from after it."""
    return whole_abt.leak_checks(assembled(spark, sf, True))


@query("SELECT o.o_orderkey, o.o_custkey, e.o_orderkey AS earlier_key, e.o_orderdate AS earlier_date FROM orders o ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) e ON o.o_custkey = e.o_custkey AND (o.o_orderdate::DATE - DATE '1970-01-01') - 180 >= (e.o_orderdate::DATE - DATE '1970-01-01')")
def orders_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """For every order the customer's latest order at least 180 days before it; keys split by years of time."""
    orders = derived.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"), "o_orderdate")
    day = F.datediff("d", F.lit("1970-01-01").cast("date"))
    left = orders.select("o_orderkey", "o_custkey", (day - 180).alias("cut"))
    right = orders.select("o_custkey", day.alias("day"), F.col("o_orderkey").alias("earlier_key"), F.col("o_orderdate").alias("earlier_date"))
    return as_of_join(left, right, ["o_custkey"], "cut", "day", ["earlier_key", "earlier_date"], block=365).select("o_orderkey", "o_custkey", "earlier_key", "earlier_date")


_RANKED = [f"{s}_m{m}" for s in whole_abt.SERIES for m in (1, 2, 3)]
_MADE = [f"{c}_{t}" for c in _RANKED for t in ("rank", "pct", "z", "log1p", "sqrt")]


def _ranks_sql() -> str:
    cols = []
    for c in _RANKED:
        rank = f"CASE WHEN {c} IS NOT NULL THEN rank() OVER (ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY {c}) - 1) / 2 END"
        cols += [f"round({rank}, 5) AS {c}_rank", f"round(({rank} - 1) / greatest(count(*) OVER () - 1, 1), 5) AS {c}_pct"]
        cols += [f"round(CASE WHEN {c} IS NULL THEN NULL WHEN stddev_samp({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () ELSE 0 END, 5) AS {c}_z"]
        cols += [f"round(ln(1 + greatest({c}, 0)), 5) AS {c}_log1p", f"round(sqrt(greatest({c}, 0)), 5) AS {c}_sqrt"]
    return ", ".join(cols)


def _months_rows(spark: SparkSession, sf: str, columns: list[str] | None = None, written: bool = True) -> DataFrame:
    """Monthly columns (all, if none are named) of the accounts active in all twelve months; written, if read more than once."""
    columns = columns or [f"{s}_m{m}" for s in whole_abt.SERIES for m in whole_abt.MONTHS]
    series = list(dict.fromkeys(c.rpartition("_m")[0] for c in columns))
    rows = whole_abt.account_rows(_transactions(spark, sf), series, FIRST)
    rows = rows.select("aid", *whole_abt.month_columns(rows, series, columns))
    return durable(rows) if written else rows


_PIVOT_SQL = _WIDE_SQL.split("\n  wo AS")[0].rstrip().rstrip(",")


@query(f"{WITH}, {_BASE_SQL}, {_PIVOT_SQL} SELECT aid, {_ranks_sql()} FROM wp")
def transform_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks, percentiles, z-scores, logs and roots of 51 monthly columns: 255 features, ranked by ranges of distinct values."""
    return wide.rank_columns(_months_rows(spark, sf, _RANKED, False), "aid", _RANKED, 5).select("aid", *_MADE)


@query()
def factory_at_width(spark: SparkSession, sf: str) -> DataFrame:
    """All 204 monthly columns ranked and transformed (1,020 features), summed up by feature."""
    columns = [f"{s}_m{m}" for s in whole_abt.SERIES for m in whole_abt.MONTHS]
    return rounded(wide.rank_summary(_months_rows(spark, sf, written=False), "aid", columns), 4)


_WINDOWED = ["act_due", "act_utl", "act_dueinc", "act_days", "act_cus_utl", "act_cus_n_loans_hist"]


def _windows_sql() -> str:
    out = []
    for s in _WINDOWED:
        for n in (3, 6, 9, 12):
            x = f"l_{s}[1:{n}]"
            out += [f"round(list_aggregate({x}, '{e}'), 5) AS {s}_{name}_{n}" for name, e in {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max", "median": "median"}.items()] + [f"round(l_{s}[{n}], 5) AS {s}_last_{n}"]
        out += [f"round(l_{s}[1], 5) AS {s}_first_value", f"round(l_{s}[12], 5) AS {s}_last_value"]
        for n in (3, 6, 12):
            x, spread, centre = f"l_{s}[1:{n}]", n * (n * n - 1) / 12, (n + 1) / 2
            slope = f"list_dot_product({x}, [{', '.join(str(m - centre) for m in range(1, n + 1))}]) / {spread}"
            total = f"(list_aggregate({x}, 'var_pop') * {n})"
            out += [f"round({slope}, 5) AS {s}_slope_{n}", f"round(list_aggregate({x}, 'avg') - {slope} * {centre}, 5) AS {s}_intercept_{n}", f"round(CASE WHEN {total} > 1e-12 THEN ({slope}) ** 2 * {spread} / {total} END, 5) AS {s}_r2_{n}"]
    return ", ".join(out)


_LISTS_SQL = f"wl AS (SELECT aid, {', '.join(f'list({s}::DOUBLE ORDER BY m) AS l_{s}' for s in _WINDOWED)} FROM bm JOIN (SELECT aid FROM wp) USING (aid) WHERE m BETWEEN 1 AND 12 GROUP BY aid)"


@query(f"{WITH}, {_BASE_SQL}, {_PIVOT_SQL}, {_LISTS_SQL} SELECT aid, {_windows_sql()} FROM wl")
def window_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling and trend statistics of six series: 210 features of every account."""
    return scaled_rounded(wide.window_columns(_months_rows(spark, sf, [f"{s}_m{m}" for s in _WINDOWED for m in whole_abt.MONTHS], False), "aid", _WINDOWED), 5)


@query()
def windows_at_width(spark: SparkSession, sf: str) -> DataFrame:
    """Rolling and trend statistics of all 17 series (595 features), summed up by feature."""
    return rounded(wide.summary(*wide.window_arrays(_months_rows(spark, sf, written=False), "aid", whole_abt.SERIES)), 4)


_BINNED = {f"{s}_m{m}": (10, 4) if s in ("act_cc", "act_loaninc", "act_days") else (10,) for s in ("act_cc", "act_loaninc", "act_days", "act_utl", "act_dueinc", "act_cus_utl", "act_cus_cc", "act_due", "coll_status") for m in (2, 6, 12)}


def _bins_sql() -> str:
    parts = []
    for c, qs in _BINNED.items():
        for q in qs:
            e = f"(SELECT list_sort(list_distinct(quantile_cont({c}::DOUBLE, [{', '.join(repr(i / q) for i in range(q + 1))}])))[2:-2] FROM wp)"
            parts.append(f"SELECT '{c}' AS name, {q} AS bins, len(list_filter(e, lambda x: x < v)) + 1 AS bin, count(*) AS n FROM (SELECT {c}::DOUBLE AS v, {e} AS e FROM wp WHERE {c} IS NOT NULL) WHERE len(e) > 0 GROUP BY ALL")
    return " UNION ALL ".join(parts)


@query(f"{WITH}, {_BASE_SQL}, {_PIVOT_SQL.replace('wp AS (', 'wp AS MATERIALIZED (')} {_bins_sql()}")
def one_hot_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Decile and quartile indicators of 27 columns, all edges from one scan, counted."""
    rows = wide.one_hot_columns(_months_rows(spark, sf, list(_BINNED)), _BINNED)
    made = [c for c in rows.columns if "_q10_" in c or "_q4_" in c]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in made])).alias("e")
    out = rows.select(cells).filter("e.x = 1").groupBy("e.feature").agg(F.count("*").alias("n"))
    part = lambda i: F.regexp_extract("feature", r"^(.*)_q(\d+)_(\d+)$", i)
    return out.select(part(1).alias("name"), part(2).cast("int").alias("bins"), part(3).cast("bigint").alias("bin"), "n")


# Anchors: stated scenarios, their cut-offs and bootstrap

#: Stress of the PD, price, funding cost, acquisition cost and loss of each anchor.
ANCHORS = {
    "optimistic_base": (1.0, "tiered", 0.0, 0.0, 0.55), "realistic_central_boundary": (2.0, "tiered_cap24", 0.03, 250.0, 0.65), "moderate_interior": (2.0, "flat24", 0.03, 150.0, 0.65), "adverse_stress": (5.0, "flat18", 0.06, 500.0, 0.85),
}
OP_COSTS = [0.0, 0.01, 0.02, 0.04]


def anchor_rows(scored: DataFrame, score: str = "score", op: float = 0.0) -> DataFrame:
    """Every account under every anchor, with its lifetime economics."""
    scenarios = scored.sparkSession.createDataFrame([(name, *map(float, (m, cof, acq, lgd)), s, op, 0.05) for name, (m, s, cof, acq, lgd) in ANCHORS.items()], "anchor string, pd_mult double, cof double, acq double, lgd double, strategy string, op double, disc double")
    return cutoffs.scenario_rows(scored.withColumn("score", F.col(score)), scenarios)


def youden_by_anchor(rows: DataFrame) -> dict[str, float]:
    """The PD of each anchor at which the rates of bad and good part most; one number for each."""
    found = metrics.youden_threshold(metrics.roc(rows, "pd_stressed", "y", ["anchor"]), ["anchor"]).collect()
    return {r["anchor"]: r["threshold"] for r in found}


def _cells_sql(cells: list[tuple]) -> str:
    return f"""cs AS (SELECT * FROM (VALUES {", ".join(str(c) for c in cells)}) AS v(anchor, mult, strategy, cof, acq, lgd, op)),
  ac AS (SELECT cs.*, s.loan_amount AS L, s.n_installments AS n, least(score * mult, 0.999)::DOUBLE AS p, (CASE strategy WHEN 'tiered' THEN {_APR.format(p="score")} WHEN 'tiered_cap24' THEN least({_APR.format(p="score")}, 0.24) WHEN 'flat18' THEN 0.18 ELSE 0.24 END)::DOUBLE AS apr FROM scores s, cs),
  ah AS (SELECT *, 1 - (1 - p) ** (1 / 12.0) AS h, 1 / (1 + 0.05 / 12) AS d, (1 + apr / 12) ** n AS g FROM ac), ay AS (SELECT *, (1 - h) * d AS yy, (1 - h) * d * (1 + apr / 12) AS yr FROM ah),
  ab AS (SELECT *, L * d * (g * {_geo("yy")} - {_geo("yr")}) / (g - 1) AS bal, L * op / 12 * d * {_geo("yy")} AS opc FROM ay),
  ap AS (SELECT *, greatest(apr - cof, 0) / 12 * bal - opc - h * lgd * bal - acq AS profit FROM ab),
  gp AS (SELECT anchor, op, p, count(*) AS n, sum(profit) AS profit, count(*) FILTER (profit > 0) AS good FROM ap GROUP BY ALL),
  gr AS (SELECT *, sum(n) OVER w AS k, sum(profit) OVER w AS cum FROM gp WINDOW w AS (PARTITION BY anchor, op ORDER BY p))"""


_OP_CELLS = [(a, *ANCHORS[a], op) for a in ("realistic_central_boundary", "adverse_stress") for op in OP_COSTS]


@query(f"{WITH}, {_cells_sql(_OP_CELLS)} SELECT anchor, op::DOUBLE AS op, sum(n)::BIGINT AS n, round(sum(profit) / sum(n), 4) AS mean_profit, round(sum(good) / sum(n), 6) AS share_positive, round(CASE WHEN max(cum) > 0 THEN 100 * arg_max(k, cum) / sum(n) ELSE 0 END, 4) AS approve_pct, round(greatest(max(cum), 0), 1) AS max_profit FROM gr GROUP BY anchor, op")
def op_cost_ablation(spark: SparkSession, sf: str) -> DataFrame:
    """Eight cells: two anchors at four running costs, all costs from the same sums."""
    s, out = durable(derived.scores(spark, sf).select("score", "loan_amount", "n_installments")), None  # ranged four times
    for name in ("realistic_central_boundary", "adverse_stress"):
        m, strategy, cof, acq, lgd = ANCHORS[name]
        cells = cutoffs.linear_grid(s, {"pd_mult": [m], "strategy": [strategy], "cof": [cof], "acq": [acq], "lgd": [lgd], "op": OP_COSTS}).withColumn("anchor", F.lit(name))
        out = cells if out is None else out.union(cells)
    return out.select("anchor", "op", "n", F.round("mean_profit", 4).alias("mean_profit"), F.round("share_positive", 6).alias("share_positive"), F.round("approve_pct", 4).alias("approve_pct"), F.round("max_profit", 1).alias("max_profit"))


def _anchored(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, float]]:
    rows = anchor_rows(durable(derived.scores(spark, sf).select("aid", "y", "loan_amount", "n_installments", "score")))  # accounts are written, not their anchors
    return rows, youden_by_anchor(rows)


@query()
def bootstrap_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 stratified replicates of four anchors: intervals of nine results of the profit-optimal and the fixed cut-off."""
    rows, fixed = _anchored(spark, sf)
    reps = durable(resample.cutoff_bootstrap(rows, list(ANCHORS), 1000, fixed))
    return rounded(resample.ci_summary(reps.filter("replicate > 0"), ["anchor"], resample.METRICS), 4)


@query()
def bootstrap_sanity(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of the bootstrap and the chances of its categories; twenty replicates are drawn a second time."""
    rows, fixed = _anchored(spark, sf)
    reps = durable(resample.cutoff_bootstrap(rows, list(ANCHORS), 1000, fixed))
    checks = resample.bootstrap_checks(reps, resample.cutoff_bootstrap(rows, list(ANCHORS), 20, fixed))
    chances = resample.cutoff_probabilities(reps)
    named = [F.struct(F.lit(c).alias("check_name"), F.col(c).alias("value"), F.lit(None).cast("boolean").alias("ok")) for c in chances.columns if c != "anchor"]
    return rounded(checks.union(chances.select("anchor", F.explode(F.array(*named)).alias("x")).select("anchor", "x.*")), 6)
