"""The wide table's one pass over account-months, against the base table's windows, and what it may write."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_scale import plan

from arrearium.operators import base_table, whole_abt
from arrearium.plans import queries_factory, queries_wide, registry
from arrearium.sources import derived


def test_pass_equals_the_windows(spark, sf, monkeypatch):
    """Every cell of 17 series by month; parts of a task hold a few customers, and one has more rows than a part."""
    monkeypatch.setattr(whole_abt, "CHUNK", 300)
    columns = [f"{s}_m{m}" for s in whole_abt.SERIES for m in whole_abt.MONTHS]
    rows = whole_abt.account_rows(derived.panel(spark, sf, by="cid", with_clients=True, ordered=True), whole_abt.SERIES, 0)
    got = rows.select("aid", *whole_abt.month_columns(rows, whole_abt.SERIES, columns))
    base = base_table.abt_base(derived.panel(spark, sf, by="cid", with_clients=True)).withColumn("m", F.col("act_seniority")).filter("m <= 12")
    want = base.groupBy("aid").agg(F.count_distinct("m").alias("n"), *[F.max(F.when(F.col("m") == m, F.col(s))).alias(f"{s}_m{m}") for s in whole_abt.SERIES for m in whole_abt.MONTHS]).filter("n = 12").drop("n")
    assert dict(got.dtypes) == dict(want.dtypes)
    a, b = ({r.aid: r for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and len(a) > 1000
    assert all(a[k][c] == pytest.approx(b[k][c], rel=1e-12) if b[k][c] is not None else a[k][c] is None for k in a for c in columns)


def test_pass_wants_ordered_rows(spark, sf):
    rows = whole_abt.account_rows(derived.panel(spark, sf, by="cid", with_clients=True).sort(F.desc("aid")), [], 0)
    with pytest.raises(Exception, match="in the order of customer"):
        rows.collect()


def test_account_months_are_not_sorted_or_grouped_again(spark, sf):
    """Windows over account-months, then lists of them by account, made each of them pass several sorts."""
    text = plan(registry.queries()["window_columns"](spark, sf)).split("Generate explode(sequence")[0]
    assert "Window" not in text and "Aggregate" not in text and "Sort" not in text


def test_wide_rows_are_not_written(spark, sf, monkeypatch):
    """The whole wide table was written before it was cleaned or checked: 2.3 kB an account."""
    written: list[int] = []
    for module in (queries_wide, queries_factory):
        keep = module.durable
        monkeypatch.setattr(module, "durable", lambda df, keep=keep: written.append(len(df.columns)) or keep(df))
    registry.queries()["whole_wide_abt"](spark, sf)
    assert not written
    registry.queries()["feature_table_checks"](spark, sf)
    assert all(n < 40 for n in written)
