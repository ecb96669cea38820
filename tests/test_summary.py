"""The base table's summary in passes over ordered account-months, against its SQL, and what it may shuffle."""

from __future__ import annotations

import glob
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_scale import plan

from arrearium.operators import base_table, panel, summary, whole_abt
from arrearium.plans import queries_builders, registry
from arrearium.sources import derived


def test_summary_equals_its_sql(spark, sf, monkeypatch):
    """Parts of a task hold a few customers, and one has more rows than a part."""
    monkeypatch.setattr(whole_abt, "CHUNK", 300)
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.sql(registry.oracle_sql()["abt_summary"])
    df = registry.queries()["abt_summary"](spark, sf)
    assert df.columns == want.columns
    a, b = ({r[:2]: r[2:] for r in rows} for rows in ((tuple(r) for r in df.collect()), want.fetchall()))
    assert a.keys() == b.keys() and len(a) > 30000
    x, y = (np.array([[np.nan if v is None else float(v) for v in rows[k]] for k in a]) for rows in (a, b))
    assert np.allclose(x, y, rtol=0, atol=2e-5, equal_nan=True)


def test_whole_summary_holds_base_columns_and_counters(spark, sf):
    rows = derived.panel(spark, sf, by="cid", with_clients=True, ordered=True)
    got = summary.abt_summary(rows)
    base = base_table.abt_base(derived.panel(spark, sf, by="cid", with_clients=True))
    assert {c: dict(got.dtypes)[c] for c in base.columns} == dict(base.dtypes)
    month = (F.floor(F.col("period") / 100) * 12 + F.col("period") % 100).cast("int")
    inputs = base.withColumns({"due_installments": F.col("act_due"), "pay_days": F.col("act_days") - 15, "month_no": month})
    want = panel.trailing_and_counters(panel.customer_max(inputs, dealt=True), ("cid", "aid"))
    names = [*base.columns, *summary.WINDOWS, *summary.COUNTERS]
    a, b = ({(r["aid"], r["period"]): r for r in x.select(names).collect()} for x in (got, want))
    assert a.keys() == b.keys()
    assert all(a[k][c] == pytest.approx(b[k][c], rel=1e-12) if b[k][c] is not None else a[k][c] is None for k in list(a)[::7] for c in names)


def test_windows_with_gaps_and_missing_values():
    """Months that are missing leave a window, missing values don't count, and accounts don't reach into each other."""
    number, account = np.array([1, 2, 5, 6, 1]), np.array([0, 0, 0, 0, 1])
    due = np.array([3.0, np.nan, 1.0, 2.0, 7.0])
    got = summary._windows({v: due for v in panel.VARIABLES}, account, number, {*summary.WINDOWS, *summary.COUNTERS})
    assert np.array_equal(got["agr3_Max_Due"], [3, 3, 1, 2, 7]) and np.array_equal(got["agr6_Mean_Due"], [3, 3, 2, 2, 7])
    assert np.isnan(got["ags3_Max_Due"]).all() and np.array_equal(got["agr6_Min_Due"], [3, 3, 1, 1, 7]) and np.array_equal(got["act12_n_arrears"], [1, 1, 2, 3, 1])


def test_moments_of_parts_add_up():
    """Also where a column doesn't vary, whose deviation is exactly none, and where a part has no values."""
    rng = np.random.default_rng(1)
    period = rng.integers(0, 3, 400)
    columns = [rng.normal(1e6, 1, 400), np.full(400, 1 / 3), np.where(np.arange(400) < 200, np.nan, 5.0)]
    parts = [summary._moments(period[a:b], [c[a:b] for c in columns]) for a, b in ((0, 150), (150, 400))]
    for p in range(3):
        n, total, mean, squares = summary._add(parts[0][p], parts[1][p])
        own = [c[period == p] for c in columns]
        assert np.array_equal(n, [np.sum(~np.isnan(v)) for v in own]) and np.allclose(total, [np.nansum(v) for v in own])
        assert np.allclose(mean, [np.nanmean(v) for v in own]) and squares[1] == squares[2] == 0 and squares[0] == pytest.approx(np.nanvar(own[0]) * n[0], rel=1e-6)


def test_summary_moves_accounts_once_and_narrow(spark, sf, monkeypatch):
    """Account-months were sorted for windows; accounts were shuffled twice a pass, with every column their keys tell."""
    monkeypatch.setattr(derived, "DEALT", 500)
    text = plan(registry.queries()["abt_summary"](spark, sf))
    assert "Window" not in text and "Sort" not in text.split("Generate explode(sequence")[0]
    exchanges = re.findall(r"Exchange hashpartitioning\(cid#\d+L, \d+\), REPARTITION_BY_NUM", text)
    assert len(exchanges) == 2 and len(re.findall(r"Exchange ", text)) == 2
    assert queries_builders._SUMMARY_COLUMNS == summary.WINDOWS
