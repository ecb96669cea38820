"""The null audit reads every column of the wide table, and what is sent to Python keeps its values."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from test_scale import plan

from arrearium.operators import audits, whole_abt
from arrearium.plans import queries_wide, registry


def test_every_column_is_audited(spark, sf):
    """Only the first and the twelfth month of each series were, and no statistic of the summary."""
    got = {r.column_name for r in registry.queries()["null_audit"](spark, sf).collect()}
    assert got == set(queries_wide.assembled(spark, sf, True).columns) and {*whole_abt.COLUMNS} < got
    assert registry.oracle_sql()["null_audit"].count(" FROM ww") == len(got)


def test_nulls_are_counted_by_column(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, None, None), (None, 0.5, "b")], "x int, y double, z string").repartition(3)
    got = {tuple(r) for r in audits.null_audit(rows, ["x", "y", "z"], ["y"]).collect()}
    assert got == {("x", 3, 1, False, False), ("y", 3, 2, True, True), ("z", 3, 1, False, False)}
    none = audits.null_audit(rows.filter("x > 5"), ["x"]).collect()
    assert all((r.n, r.n_null, r.ok) == (0, 0, True) for r in none)


def test_packed_rows_keep_their_values(spark, sf):
    day = datetime.date(1969, 12, 31)
    rows = spark.createDataFrame([(2**60 + 1, -5, day, 0.5, "a"), (None, None, None, None, None), (-3, 7, None, 1.5, "b")], "k bigint, i int, d date, x double, s string")
    sent, unpacked = whole_abt.packed(rows)
    back = sent.mapInArrow(unpacked, ", ".join(f"{c} {k}" for c, k in rows.dtypes))
    assert back.dtypes == rows.dtypes and back.exceptAll(rows).isEmpty() and back.count() == 3
    assert "array(" in plan(whole_abt.account_rows(queries_wide._transactions(spark, sf), [], 0)).split("Generate explode(sequence")[0]
    assert sent.select(F.size("__n")).first()[0] == 3
