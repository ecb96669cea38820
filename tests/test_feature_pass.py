"""The feature table is made in one pass, without joins of its wide rows."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from test_scale import plan

from arrearium.operators import catalog, factory


def test_few_levels_are_looked_up_as_many_are_joined(spark, monkeypatch):
    """Also a null key, levels that training hasn't, and a statistic that a level has none of."""
    rows = [(i, None if i % 7 == 0 else i % 5, f"l{i % 3}", float(i) if i % 4 else None, "train" if i % 5 < 3 and i != 4 else "oot") for i in range(60)] + [(60, 9, None, 1.0, "train"), (61, 8, "x", 2.0, "oot")]
    df = spark.createDataFrame(rows, "aid long, k int, s string, v double, split string")
    specs = [(k, v, stat, f"{stat}_{v}_{k}") for k in ("k", "s") for stat, v in (("mean", "v"), ("std", "v"), ("median", "v"), ("count", None))]
    train = F.col("split") == "train"
    got = factory.group_statistics(df, specs, train)
    assert "Join" not in plan(got)
    found = got.collect()
    monkeypatch.setattr(factory, "FEW", 0)
    joined = factory.group_statistics(df, specs, train)
    assert "BroadcastHashJoin" in plan(joined) and joined.dtypes == got.dtypes
    assert sorted(map(repr, found)) == sorted(map(repr, joined.collect())) and len(found) == 62


def test_checks_read_the_table_once(spark):
    """Rows were counted in a second run of the whole table, and cells exploded to find infinities."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(i):
        seen.add(1)
        return math.inf if i % 10 == 0 else None if i % 10 == 1 else math.nan if i % 10 == 2 else -math.inf if i == 5 else 1.0

    df = spark.range(40).withColumn("act_age", value("id")).withColumn("n_children", F.lit(1))
    cat = catalog.catalog(spark, ["id", "act_age", "n_children"], [])
    got = {r.check_name: r for r in catalog.checks(df, cat, 40).collect()}
    assert seen.value == 40 and got["no_infinities"].value == 5 and not got["no_infinities"].ok and got["row_count_unchanged"].ok
    got = {r.check_name: r for r in catalog.checks(df.select("id", "n_children").filter("id < 0"), cat, 1).collect()}
    assert got["no_infinities"].value == 0 and got["row_count_unchanged"].value == 0 and not got["row_count_unchanged"].ok
