"""Domain functions, panel operators, economics, metrics, scorecards, resampling and the month close."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrearium.functions import periods, scalars
from arrearium.operators import cutoffs, economics, features, metrics, models, panel, resample, scorecard
from arrearium.sources import derived, tables


def test_periods(spark):
    df = spark.createDataFrame([(202412, 15, 202603), (202401, -1, 202312), (202406, 0, 202406)], "p int, k int, want int")
    for r in df.select("*", periods.period_add(F.col("p"), F.col("k")).alias("got"), periods.period_diff(F.col("want"), F.col("p")).alias("d")).collect():
        assert r.got == r.want and r.d == r.k
    months = periods.period_range(spark.createDataFrame([(202411, 202502)], "a int, b int"), "a", "b").select("period").collect()
    assert [r.period for r in months] == [202411, 202412, 202501, 202502]


def test_stage_machine(spark):
    dues = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12]
    df = spark.createDataFrame([(dues,), ([1, 0, 1],)], "d array<int>").select(scalars.stage_path(F.col("d")).alias("s"))
    a, b = (r.s for r in df.collect())
    assert a == [1, 2, 2, 2, 3, 4, 4, 5, 5, 5, 6, 6, 8] and b == [2, 7, 2]


def test_action_scores(spark):
    df = spark.createDataFrame([(2, "12"), (4, "333"), (1, None)], "s int, a string")
    rows = df.select(scalars.action_sum(F.col("a"), scalars.ACTION_COST).alias("c"), scalars.injustice(F.col("s"), F.col("a"), scalars.INJUSTICE).alias("i")).collect()
    assert [(r.c, round(r.i, 6)) for r in rows] == [(20.0, 0.2), (90.0, 0.6), (0.0, 0.0)]


def schedule(pd12, loan, n, apr, lgd, op, disc, cof, acq):
    h, r, el, margin = 1 - (1 - pd12) ** (1 / 12), apr / 12, 0.0, 0.0
    for t in range(1, n + 1):
        bal = loan * ((1 + r) ** n - (1 + r) ** (t - 1)) / ((1 + r) ** n - 1) if r else loan * (n - t + 1) / n
        s, d = (1 - h) ** (t - 1), (1 + disc / 12) ** -t
        el += s * h * lgd * bal * d
        margin += (s * bal * max(apr - cof, 0) / 12 - s * loan * op / 12) * d
    return el, margin, margin - el - acq


def test_closed_form_equals_monthly_sums(spark):
    cases = [(p, 5000.0, n, a, 0.45, op, d, 0.03, 50.0) for p in (0.0, 0.0005, 0.1, 0.9) for n in (1, 12, 36) for a in (0.0, 0.12, 0.3) for op in (0.0, 0.02) for d in (0.0, 0.05)]
    df = spark.createDataFrame(cases, "pd double, loan_amount double, n_installments int, apr double, lgd double, op double, disc double, cof double, acq double")
    for r in economics.with_lifetime(df).collect():
        want = schedule(*r[:9])
        assert (r.LT_EL, r.LT_margin, r.Expected_Profit) == pytest.approx(want, rel=1e-7, abs=1e-6)


def test_amortization_identities(spark):
    df = spark.createDataFrame([(1, 1200.0, 12, 0.0), (2, 9000.0, 36, 0.18)], "id int, loan_amount double, n_installments int, apr double")
    for r in economics.amortization(df).groupBy("id").agg(F.sum("principal").alias("p"), F.max("loan_amount").alias("l"), F.min("balance_end").alias("e")).collect():
        assert r.p == pytest.approx(r.l) and abs(r.e) < 1e-6


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "p double, y int")
    r = metrics.discrimination(df, "p", "y").first()
    pairs = [(a, b) for a in (0.35, 0.8, 0.4) for b in (0.1, 0.4)]
    auc = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)
    assert r.gini == pytest.approx(2 * auc - 1)
    one = spark.createDataFrame([(0.1, 0), (0.2, 0)], "p double, y int")
    assert metrics.discrimination(one, "p", "y").first().gini is None


def test_threshold_sweep(spark):
    rows = [(i / 50, int(i % 7 == 0), 100.0 * i, 12 + 12 * (i % 3)) for i in range(50)]
    out = {r.threshold: r for r in cutoffs.threshold_sweep(spark.createDataFrame(rows, "score double, y int, loan_amount double, n_installments int"), [0.1, 0.5, 0.9], 0.2, 0.5).collect()}
    for t in (0.1, 0.5, 0.9):
        ok = [r for r in rows if r[0] < t]
        assert out[t].n_approved == len(ok)
        assert out[t].expected_profit == pytest.approx(sum((1 - p) * 0.2 * a * n / 12 - p * 0.5 * a for p, _, a, n in ok))


def test_woe_bins_and_scores(spark):
    rows = [(float(i), int((i * 37) % 100 < i / 10)) for i in range(1000)] + [(None, 0)]
    df = spark.createDataFrame(rows, "x double, y int")
    bins = scorecard.fit_numeric(df, ["x"], "y")
    b = bins["x"]
    assert sum(b.n) == 1000 and b.trend in ("ascending", "descending") and min(b.n) >= 50
    bad, good = sum(b.events) + 1, sum(b.n) - sum(b.events) + 1
    assert b.woe[0] == pytest.approx(math.log(((b.events[0] + 0.5) / bad) / ((b.n[0] - b.events[0] + 0.5) / good)))
    assert scorecard.load(scorecard.dump(bins)) == bins
    woe = scorecard.apply_woe(df, bins)
    assert woe.filter("x is null").first().x_woe == 0.0
    assert {round(r.x_woe, 9) for r in woe.filter("x is not null").select("x_woe").distinct().collect()} == {round(w, 9) for w in b.woe}
    table = scorecard.scorecard_table(spark, bins, {"x": 1.0}, 0.0)
    assert table.count() == len(b.n) and scorecard.score(df, bins, table).filter("points is null").count() == 0


def test_cumulative_matches_window(spark):
    df = spark.createDataFrame([(i % 2, float(i % 17), i) for i in range(200)], "g int, v double, n int").groupBy("g", "v").agg(F.sum("n").alias("n"))
    out = features.cumulative(df, "v", ["n"], ["g"]).collect()
    for r in out:
        assert r.before_n == sum(x.n for x in out if x.g == r.g and x.v < r.v) and r.total_n == sum(x.n for x in out if x.g == r.g)


def test_rank_and_trend(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, 3.0), (4, None)], "id int, x double")
    got = {r.id: (r.x_rank, r.x_pct) for r in features.rank_features(df, "x").collect()}
    assert got == {1: (2.5, 0.75), 2: (1.0, 0.0), 3: (2.5, 0.75), 4: (None, None)}
    long = spark.createDataFrame([(1, m, 2.0 * m + 1) for m in range(1, 13)], "aid int, m int, v double")
    r = features.trend(long, {"v": "v"}).first()
    assert (r.v_slope_12, r.v_intercept_12, r.v_r2_12) == pytest.approx((2, 1, 1))


def test_bootstrap(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(300)], "id int, g int, v double")
    drawn = resample.exact_sample(df, ["g"], "id", 4)
    assert {(r.replicate, r.g): r["count"] for r in drawn.groupBy("replicate", "g").count().collect()} == {(b, g): 100 for b in range(1, 5) for g in range(3)}
    w = resample.weights(df, "id", 50).groupBy("replicate").agg(F.sum("weight").alias("n")).agg(F.avg("n").alias("m")).first().m
    assert abs(w - 300) < 15


def test_default_flags_end_early(spark):
    rows = [(1, m, 0, 1) for m in range(1, 3)] + [(1, 3, 0, 3)] + [(2, m, m, 1) for m in range(1, 6)]
    df = spark.createDataFrame(rows, "aid int, month_no int, due_installments int, status int")
    out = {(r.aid, r.month_no): (r.default3, r.default3_reason) for r in panel.default_flags(df).collect()}
    assert out[1, 1] == (0, "known") and out[2, 1] == (1, "known") and out[2, 4] == (None, "missing") and out[1, 3] == (None, "missing")


def test_platt_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(i / 100, int((i * 7) % 100 < i)) for i in range(1, 100)], "p double, y int")
    fitted = models.fit_platt(df, "p", "y")
    m = models.apply_platt(df, "p", fitted, "q").agg(F.avg("q").alias("q"), F.avg("y").alias("y")).first()
    assert m.q == pytest.approx(m.y, abs=1e-3)
    assert tables.load_table(spark, str(tmp_path / "none"), "clients", create_if_missing=True).count() == 0
    assert tables.series_columns(["act_due_m2", "act_due_m1", "x_m1"]) == {"act_due": ["act_due_m1", "act_due_m2"]}
    assert tables.detect_aliases(["app_age", "loan_amount"]) == {"age": "app_age", "loan": "loan_amount"}


def test_month_close_stream(spark, sf, tmp_path):
    """Two landings, the second late: summaries equal those of the whole panel."""
    from arrearium.streaming.month_close import start

    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    cols = ["period", "aid", "cid", "pay_days", "due_installments"]
    p = derived.panel(spark, sf).filter("aid < 40 and k < 8").select(*cols)
    land, ledger, summary, mark = (str(tmp_path / x) for x in ("land", "ledger", "summary", "mark"))
    late = F.col("period") % 5 == 0
    for part in (p.filter(~late), p.filter(late)):
        part.coalesce(1).write.mode("append").parquet(land)
        start(spark, land, ledger, summary, mark, p.schema).awaitTermination()
    want = panel.trailing(panel.customer_max(p.withColumn("month_no", periods.month_no(F.col("period"))))).select("aid", "period", "agr12_Mean_Days", "ags3_Max_Due")
    got = spark.read.parquet(summary).select("aid", "period", "agr12_Mean_Days", "ags3_Max_Due")
    assert want.exceptAll(got).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("name", ["migration", "wide_abt", "psi_categorical", "woe_by_level", "lifetime_economics"])
def test_queries_equal_sql(spark, sf, name):
    import glob

    import duckdb

    from arrearium.plans import registry
    from tools.compare import rows

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, sf)
    want = con.sql(registry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0


def test_exact_draws_need_no_join(spark, monkeypatch):
    """Draws were joined with the rows, each row as often as there are replicates; their results don't hang on partitions or blocks' tasks."""
    monkeypatch.setattr(resample, "BLOCK", 64)
    df = spark.createDataFrame([(i, i % 3, float(i % 7)) for i in range(1000)], "id int, g int, v double")
    weights = resample.exact_weights(df, ["g"], "id", 40)
    assert "hashpartitioning(g" not in weights._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    got = {r.id: r for r in weights.collect()}
    w = np.array([got[i]["__w"] for i in range(1000)])
    assert w.shape == (1000, 40) and all((w[g::3].sum(0) == len(w[g::3])).all() for g in range(3))
    assert 0.9 < w.var() < 1.1 and 0.34 < (w == 0).mean() < 0.40 and np.abs(w.mean(1) - 1).max() < 1  # as Poisson(1), nearly
    assert len({tuple(c) for c in w.T}) == 40 and not np.array_equal(w[0:64 * 3:3], w[64 * 3:128 * 3:3])
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = resample.exact_weights(df.repartition(7), ["g"], "id", 40)
        assert {r.id: r["__w"] for r in again.collect()} == {i: r["__w"] for i, r in got.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    rows = {(r.replicate, r.g): (r.n, r.v) for r in resample.exact_sample(df, ["g"], "id", 4).groupBy("replicate", "g").agg(F.count("*").alias("n"), F.sum("v").alias("v")).collect()}
    sums = {(r.replicate, r.g): (r.n, r.v) for r in resample.exact_sums(df, ["g"], ["g"], "id", 4, ["v"]).collect()}
    assert rows == sums and len(sums) == 12
