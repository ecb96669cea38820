"""Feature families, catalog, correlations by blocks, and the stateful close."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrearium.operators import catalog, factory, wide
from arrearium.operators.catalog import Derived
from arrearium.operators.panel import customer_max, trailing
from arrearium.sources import derived
from arrearium.streaming import stateful_close


def test_lineage_and_permissions(spark):
    columns = ["aid", "split", "default_flag_12m", "app_income", "act_age", "loan_amount", "act_due_m2", "act_due_m7", "max_due", "agr6_Mean_Due"]
    made = [
        Derived("a", "F3", ("app_income", "act_age"), "a"), Derived("b", "F3", ("loan_amount", "app_income"), "b"), Derived("c", "F6A", ("b",), "rank(b)"), Derived("d", "F3", ("c", "act_due_m2"), "d"),
        Derived("e", "F1", ("act_due_m2", "act_due_m7"), "e"), Derived("noise", "F6D", (), "N(0, 1)"), Derived("f", "F6A", ("a",), "z(a)"), Derived("leak", "F3", ("f", "default_flag_12m"), "leak"),
    ]
    assert catalog.lineage(columns, made)["d"] == {"loan_amount", "app_income", "act_due_m2"}
    rows = {r.feature_name: r for r in catalog.catalog(spark, columns, made).collect()}
    assert len(rows[list(rows)[0]]) == 14 and len(rows) == len(columns) + len(made)
    assert rows["f"].allowed_for_origination_pd and rows["f"].leakage_risk == "low" and rows["noise"].source_window == "random"
    assert rows["c"].allowed_for_profit and not rows["c"].allowed_for_origination_pd
    assert not rows["d"].allowed_for_profit and not rows["d"].allowed_for_behavioral_pd and rows["d"].uses_future_behavior and rows["d"].availability_time == "post-origination"
    assert rows["e"].leakage_risk == "high" and rows["e"].source_window == "m2,m7" and rows["leak"].uses_target and rows["agr6_Mean_Due"].source_window == "m1-m6"
    cat = catalog.catalog(spark, columns, made)
    assert {r[0] for r in cat.filter(catalog.eligible()).select("feature_name").collect()} == {"app_income", "act_age", "a", "f", "noise"}
    for bad in ([Derived("x", "F3", ("y",), ""), Derived("y", "F3", ("x",), "")], [Derived("x", "F3", ("nowhere",), "")]):
        with pytest.raises(ValueError):
            catalog.lineage(columns, bad)
    with pytest.raises(ValueError):
        catalog.guard("synth", ["loan_amount"])
    clean = [d for d in made if d.name != "leak"]
    df = spark.createDataFrame([(1.0,) * (len(columns) + len(clean))] * 3, ", ".join(f"{c} double" for c in [*columns, *[d.name for d in clean]]))
    ok = {r.check_name: r.ok for r in catalog.checks(df, catalog.catalog(spark, columns, clean), 3).collect()}
    assert all(ok.values()) and len(ok) == 7
    bad = {r.check_name: r.value for r in catalog.checks(df.withColumn("a", F.lit(float("inf"))).withColumn("score", F.lit(1.0)), cat, 4).collect()}
    assert (bad["no_infinities"], bad["columns_in_catalog"], bad["catalog_in_columns"], bad["one_target"], bad["no_score_columns"], bad["row_count_unchanged"]) == (3, 1, 1, 2, 1, 3)


def _table(spark, n=400):
    draw = np.random.default_rng(1)
    rows = [(i, float(draw.integers(500, 5000)), int(draw.integers(20, 70)), float(draw.integers(100, 900)), int(draw.integers(0, 4)), *map(int, draw.integers(1, 5, 6)), float(draw.integers(1000, 9000)), int(draw.choice([12, 24])), float(draw.integers(50, 400)), int(draw.integers(0, 3)), int(draw.integers(0, 6)), int(draw.integers(0, 9)), "train" if i < 300 else "oot") for i in range(n)]
    names = "aid long, app_income double, act_age int, app_spendings double, app_number_of_children int, app_nom_job_code int, app_nom_branch int, app_nom_city int, app_nom_marital_status int, app_nom_home_status int, app_nom_gender int, loan_amount double, n_installments int, installment double, act_due_m2 int, max_due int, months_ever_due int, split string"
    return spark.createDataFrame(rows, names).withColumn("app_nom_cars", F.col("app_nom_city") % 2)


def test_group_statistics(spark):
    """All 52 statistics by pandas, an unseen key, and a key that is null."""
    df = _table(spark).withColumn("app_nom_branch", F.when((F.col("split") == "oot") & (F.col("aid") % 7 == 0), 99).when(F.col("aid") % 11 == 0, None).otherwise(F.col("app_nom_branch")))
    specs = factory.SPECS_A + factory.SPECS_B
    assert (len(factory.SPECS_A), len(factory.SPECS_B)) == (37, 15)
    got = factory.group_statistics(df, specs, F.col("split") == "train").toPandas().set_index("aid").sort_index()
    data = df.toPandas().set_index("aid").sort_index()
    train = data[data["split"] == "train"]
    for key, value, stat, name in specs:
        grouped = train.groupby(key, dropna=False)
        want = data[key].map(grouped.size() if value is None else getattr(grouped[value], stat)())
        if key == "app_nom_branch" and stat == "median":
            want = want.where(data[key].notna())  # a missing key has no median of its own: the global one stands in
        want = want.fillna(float(len(train)) if value is None else float(getattr(train[value], stat)()))
        assert got[name].to_numpy() == pytest.approx(want.to_numpy(dtype=float)), name
    rates = {r.key: r for r in factory.fallback_rates(df, ["app_nom_branch", "app_nom_city"], F.col("split") == "train").collect()}
    assert rates["app_nom_branch"].n_unseen == sum(1 for i in range(300, 400) if i % 7 == 0) and rates["app_nom_city"].rate == 0


def test_ratios_products_and_noise(spark):
    df = _table(spark)
    out = factory.ratios_and_products(df).toPandas().set_index("aid").sort_index()
    data = df.toPandas().set_index("aid").sort_index()
    x = data["loan_amount"] / data["app_income"]
    assert out["loan_amount_to_income"].to_numpy() == pytest.approx(x.clip(x.quantile(0.01), x.quantile(0.99)).to_numpy())
    assert out["marital_x_n_children"].to_numpy() == pytest.approx(((data["app_nom_marital_status"] - 1) * data["app_number_of_children"]).to_numpy())
    assert out["age_squared"].to_numpy() == pytest.approx((data["act_age"].astype(float) ** 2).to_numpy()) and len(out.columns) == len(data.columns) + 21
    made, lines = factory.bureau_like(spark.range(4000).select(F.col("id").alias("aid"), (F.col("id") % 50 * 100 + 500).cast("double").alias("app_income"), (F.col("id") % 45 + 20).alias("act_age"), F.lit(300).alias("app_spendings")))
    synth = [d.name for d in lines]
    assert len(synth) == 66 and set(synth) <= set(made.columns)
    m = made.toPandas()
    for i, (a, b) in enumerate(factory.BALANCES, 1):
        share = m[f"synth_balance_v{i}"] / m["app_income"]
        assert share.mean() == pytest.approx(a / (a + b), abs=0.015) and share.std() == pytest.approx(np.sqrt(a * b / (a + b) ** 2 / (a + b + 1)), abs=0.015) and 0 <= share.min() and share.max() <= 1
    for i, rate in enumerate(factory.DEROGATORY, 1):
        assert m[f"synth_derogatory_v{i}"].mean() == pytest.approx(rate, abs=0.05) and m[f"synth_derogatory_v{i}"].var() == pytest.approx(rate, abs=0.1)
    assert m["synth_credit_score_v1"].between(300, 850).all() and abs(np.corrcoef(m["synth_balance_v1"] / m["app_income"], m["synth_balance_v2"] / m["app_income"])[0, 1]) < 0.06
    again = factory.bureau_like(spark.range(4000).repartition(7).select(F.col("id").alias("aid"), (F.col("id") % 50 * 100 + 500).cast("double").alias("app_income"), (F.col("id") % 45 + 20).alias("act_age"), F.lit(300).alias("app_spendings")))[0].toPandas().sort_values("aid")
    assert again[synth].to_numpy() == pytest.approx(m.sort_values("aid")[synth].to_numpy())


def test_correlations_by_blocks(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((300, 7)) @ draw.standard_normal((7, 7)) + 100
    x[:, 5] = 3.0
    cells = [[None if draw.random() < 0.1 else float(v) for v in row] for row in x]
    names = [f"c{i}" for i in range(7)]
    df = spark.createDataFrame([tuple(r) for r in cells], ", ".join(f"{c} double" for c in names)).repartition(3)
    got = {(r.a, r.b): r["corr"] for r in wide.correlations(df, names, block=3).collect()}
    assert list(sorted(got)) == sorted((a, b) for i, a in enumerate(names) for b in names[i + 1 :])
    for (a, b), r in got.items():
        pairs = np.array([(row[int(a[1])], row[int(b[1])]) for row in cells if row[int(a[1])] is not None and row[int(b[1])] is not None])
        if "c5" in (a, b):
            assert r is None
        else:
            assert r == pytest.approx(np.corrcoef(pairs.T)[0, 1])


def test_stateful_close_equals_batch(spark, sf, tmp_path):
    """Months landed in order, one of them late: the newest epochs hold what a batch over all rows gives; too late rows are told."""
    p = derived.panel(spark, sf).filter("cid % 10 = 1").select("period", "month_no", "cid", "aid", "due_installments", "pay_days")
    rows = p.toPandas().sort_values(["month_no", "cid", "aid"])
    held_back = (rows["month_no"] % 5 == 0) & (rows["aid"] % 3 == 0)
    lo, hi = rows["month_no"].min(), rows["month_no"].max()
    landing, schema = tmp_path / "in", "period int, cid bigint, aid bigint, due_installments int, pay_days int"
    landing.mkdir()
    steps = list(range(lo, hi + 12, 12))
    for i, m in enumerate(steps):
        now = rows[(rows["month_no"] >= m) & (rows["month_no"] < m + 12) & ~held_back]
        after = rows[held_back & (rows["month_no"] >= m - 6) & (rows["month_no"] < m + 6)]  # some months after the others
        part = now if i == 0 else now._append(after)
        if i == 0:
            part = part._append(rows[held_back & (rows["month_no"] < m + 6)])
        part[schema.replace(" int", "").replace(" bigint", "").split(", ")].astype({"period": "int32", "due_installments": "int32", "pay_days": "int32"}).to_parquet(landing / f"{i:03d}.parquet")
    rest = rows[held_back & (rows["month_no"] >= steps[-1] + 6)]
    if len(rest):
        rest[["period", "cid", "aid", "due_installments", "pay_days"]].astype({"period": "int32", "due_installments": "int32", "pay_days": "int32"}).to_parquet(landing / "998.parquet")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stateful_close.start(spark, str(landing), out, state, schema, files_at_once=1, delay="9999 days").awaitTermination()
    late = spark.read.parquet(out).filter("late").select("aid", "month_no").distinct().count()
    want = trailing(customer_max(p)).select("aid", "month_no", *stateful_close.NAMES)
    got = stateful_close.latest(spark, out).select("aid", "month_no", *stateful_close.NAMES)
    assert late == 0 and got.count() == want.count()
    key = ["aid", "month_no"]
    a, b = (d.toPandas().sort_values(key).astype(float).to_numpy() for d in (got, want))
    np.testing.assert_allclose(a, b, rtol=1e-9, equal_nan=True)
    # A row of years ago is told as late and changes nothing; epochs written twice leave the result as it is.
    old = rows[rows["month_no"] == lo].head(1)
    newest = rows[rows["cid"] == old["cid"].iloc[0]]["month_no"].max()
    if newest - lo >= 12:
        old[["period", "cid", "aid", "due_installments", "pay_days"]].astype({"period": "int32", "due_installments": "int32", "pay_days": "int32"}).assign(due_installments=np.int32(11)).to_parquet(landing / "999.parquet")
        stateful_close.start(spark, str(landing), out, state, schema, delay="9999 days").awaitTermination()
        assert spark.read.parquet(out).filter("late").count() == 1
        assert stateful_close.latest(spark, out).exceptAll(got.select("aid", "month_no").join(stateful_close.latest(spark, out), key)).count() == 0
