"""Table builders, quantiles from ranks, trailing windows with gaps, selection and fitted models."""

from __future__ import annotations

import glob
import random

import duckdb
import numpy as np
import pytest

from arrearium.operators import cutoffs, features, metrics, models, panel, scorecard
from arrearium.plans import queries_builders, registry
from tools.compare import rows

NAMES = [n for n, build in registry.queries().items() if build.__module__ == queries_builders.__name__ and n in registry.oracle_sql()]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {f.split('/')[-1][:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_builders_equal_sql(spark, sf, con, name):
    df = registry.queries()[name](spark, sf)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


def test_trailing_with_gaps_and_nulls(spark):
    """Lags equal frames of months, also where months or values are missing."""
    rnd = random.Random(4)
    data = [(a, m, None if rnd.random() < 0.2 else rnd.randrange(9)) for a in range(12) for m in range(100, 130) if rnd.random() < 0.7]
    df = spark.createDataFrame(data, "aid int, month_no int, Due int")
    got = {(r.aid, r.month_no): r for r in panel.trailing(df, (3, 6, 12), ("Due",)).collect()}
    for a, m, _ in data:
        for n in (3, 6, 12):
            xs = [x for b, k, x in data if b == a and m - n < k <= m and x is not None]
            r = got[a, m]
            assert (r[f"agr{n}_Max_Due"], r[f"agr{n}_Min_Due"]) == ((max(xs), min(xs)) if xs else (None, None))
            assert r[f"agr{n}_Mean_Due"] == (pytest.approx(sum(xs) / len(xs)) if xs else None)
            assert r[f"ags{n}_Max_Due"] == (max(xs) if len(xs) >= n else None)


def test_quantiles_equal_numpy(spark):
    rnd = random.Random(6)
    data = [(g, float(rnd.randrange(40))) for g in "ab" for _ in range(rnd.randrange(30, 90))] + [("c", 5.0), ("a", None)]
    df = spark.createDataFrame(data, "g string, x double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    for r in features.quantiles(df, "x", probs, ["g"]).collect():
        assert r.q == pytest.approx(np.quantile([x for g, x in data if g == r.g and x is not None], probs).tolist())
    assert features.quantiles(df, "x", [0.5]).first().q == pytest.approx([np.median([x for _, x in data if x is not None])])


def test_rolling_features(spark):
    xs = [3.0, None, 1.0, 7.0]
    df = spark.createDataFrame([(1, m + 1, x) for m, x in enumerate(xs)] + [(2, 1, None)], "aid int, m int, v double")
    got = {r.aid: r for r in features.rolling(df, {"v": "v"}, (3, 6)).collect()}
    r = got[1]
    assert (r.v_mean_3, r.v_min_3, r.v_max_3, r.v_median_3, r.v_last_3, r.v_first_value, r.v_last_value) == (2.0, 1.0, 3.0, 2.0, 1.0, 3.0, 7.0)
    assert r.v_std_3 == pytest.approx(np.std([3, 1], ddof=1)) and r.v_median_6 == 3.0 and got[2].v_mean_3 is None and got[2].v_median_6 is None


def test_monotone_bins():
    n, e = [100] * 6, [10, 8, 20, 15, 40, 60]
    cuts, m, k = scorecard.merge_bins([1, 2, 3, 4, 5], n, e, 50)
    rates = [a / b for a, b in zip(k, m)]
    assert rates == sorted(rates) and sum(m) == 600 and sum(k) == sum(e) and len(cuts) == len(m) - 1 == 3
    assert scorecard.pooled([1, 1, 1], [3, 2, 1], False) == [0, 1, 2] and scorecard.pooled([1, 1, 1], [3, 2, 1], True) == [0]


def _data(spark, n=3000):
    rnd = random.Random(12)
    out = []
    for i in range(n):
        a, b = rnd.gauss(0, 1), rnd.gauss(0, 1)
        p = 1 / (1 + np.exp(-(1.6 * a - 1.0)))
        out.append((i, a, a * 2 + 0.01 * rnd.gauss(0, 1), b, 1.0, None if i % 5 else b, 12 * (1 + i % 3), int(rnd.random() < p)))
    return spark.createDataFrame(out, "aid int, a double, twin double, noise double, same double, sparse double, tenor int, y int")


def test_selection_and_models(spark):
    df = models.durable(_data(spark))
    info = {r.feature: r for r in models.prescreen(df, ["a", "twin", "noise", "same", "sparse"], "y", "aid", min_gini=0.1).collect()}
    assert {k: r.reason for k, r in info.items()} in ({"a": None, "twin": "correlated", "noise": "weak", "same": "one_value", "sparse": "nulls"}, {"a": "correlated", "twin": None, "noise": "weak", "same": "one_value", "sparse": "nulls"})
    runs = models.lasso_runs(df, ["a", "noise"], "y", "aid", [0.05], [1, 2])
    assert {(r.run, r.feature) for r in runs.collect()} == {("reg 0.05, seed 1", "a"), ("reg 0.05, seed 2", "a")}
    assert [r.jaccard for r in metrics.jaccard(runs, "run", "feature").collect()] == [1.0]
    kept, p = models.fit_with_p_values(df, ["a", "noise"], "y")
    assert kept == ["a"] and p[0] < 1e-6
    inflation = dict(models.vif(df, ["a", "twin", "noise"]))
    assert inflation["a"] > 100 > 2 > inflation["noise"]
    refits = models.refit_by(df, ["a", "noise"], "y", "tenor", [12, 24, 36, 48]).collect()
    assert len(refits) == 6 and not any(r.flipped for r in refits if r.feature == "a")
    lost = {r.without: r.loss for r in models.ablation(df.filter("aid < 2000"), df.filter("aid >= 2000"), {"signal": ["a"], "noise": ["noise"]}, "y").collect()}
    assert lost["signal"] > 0.3 > abs(lost["noise"])


def test_boosting_and_calibration(spark):
    df = models.durable(_data(spark, 1500))
    m, tried = models.random_search(df, ["a", "noise"], "y", tries=1)
    assert dict(models.importances(m, ["a", "noise"]))["a"] > 0.5 and tried[0]["auc"] > 0.7
    s = models.durable(models.probability(models.fit_logit(models.balanced_weights(df, "y"), ["a"], [], "y", weight="weight").transform(models.balanced_weights(df, "y")), "p"))
    s = models.isotonic(models.apply_platt(s, "p", models.fit_platt(s, "p", "y"), "platt"), "p", "y", "iso")
    got = {r.source: r for r in metrics.comparison(s, ["p", "platt", "iso"], "y").collect()}
    assert got["platt"].gini == pytest.approx(got["p"].gini) and got["platt"].brier < got["p"].brier and abs(got["iso"].mean_pred - got["iso"].base_rate) < 0.02


def test_stability_and_nearest(spark):
    a = spark.createDataFrame([("x", 50.0), ("y", 50.0), ("z", 50.0)], "k string, v double")
    b = spark.createDataFrame([("x", 51.0), ("y", 55.0), ("z", 70.0)], "k string, v double")
    assert {r.k: r.verdict for r in cutoffs.stability(a, b, "k", "v").collect()} == {"x": "STABLE", "y": "SHIFTED", "z": "UNSTABLE"}
    assert cutoffs.nearest(b, {"v": 60.0}).first().k == "y"


def test_catalog(spark):
    c = features.feature_catalog(spark, ["app_income", "agr3_Mean_Due", "score", "x_noise", "due_mean_6", "loan_amount"])
    got = {r.feature_name: (r.family, r.pd_allowed) for r in c.collect()}
    assert got["agr3_Mean_Due"] == ("window", True) and got["score"] == ("score", False) and got["x_noise"] == ("synthetic", False) and got["loan_amount"] == ("loan_terms", False)
    assert {r.feature_name for r in features.eligible_features(c).collect()} == {"app_income", "agr3_Mean_Due", "due_mean_6"}
    assert sum(r.n for r in features.family_summary(c).collect()) == 6
    assert features.validate(spark.createDataFrame([(1.0,), (float("inf"),)], "x double"), ["x"]).first().n_infinite == 1
