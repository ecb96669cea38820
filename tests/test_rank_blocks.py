"""Average ranks of many columns by blocks of rows and ranges of distinct values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from test_scale import plan

from arrearium.operators import wide
from arrearium.plans import queries_wide, registry

NAMES = list("abcdef")


def _rows() -> list[tuple]:
    draw = random.Random(3)
    one = lambda: draw.choice([None, float("nan"), math.inf, -math.inf, 0.0, -0.0, draw.gauss(0, 1)])
    return [(i, draw.gauss(0, 1), float(i // 4), 1.0 if i % 3 else draw.random(), one(), 5.0, None) for i in range(1500)]


@pytest.fixture
def small(monkeypatch):
    for name, value in {"BLOCK_ROWS": 90, "CELLS": 60, "LEVELS": 40}.items():
        monkeypatch.setattr(wide, name, value)


def test_ranks_over_many_blocks_and_ranges(spark, small):
    """Ties that stand in all blocks, values that are bounds of ranges, infinities, signed zeros, a constant, an empty column."""
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in NAMES)).repartition(4, "id")
    known = wide._known(wide._blocks(df, "id", NAMES), NAMES)
    assert len(known[0].cuts) > 10 and len(known[1].cuts) > 3 and not len(known[4].cuts) and [k.rows for k in known] == [1500] * 6
    got = {r.id: r for r in wide.rank_columns(df, "id", NAMES).collect()}
    assert len(got) == 1500
    for j, c in enumerate(NAMES, 1):
        values = {r[0]: r[j] + 0.0 for r in rows if r[j] is not None and r[j] == r[j]}
        at: dict[float, list[int]] = {}
        for p, v in enumerate(sorted(values.values()), 1):
            at.setdefault(v, []).append(p)
        assert all(r[f"{c}_rank"] == (sum(at[values[i]]) / len(at[values[i]]) if i in values else None) for i, r in got.items()), c
    x = np.array([r[1] for r in rows])
    z = (x - x.mean()) / x.std(ddof=1)
    assert all(got[i].a_z == pytest.approx(z[i], abs=1e-12) and got[i].e_z == 0.0 and got[i].f_sqrt == 0.0 for i in got)


def test_summary_adds_up_every_row(spark, small):
    df = spark.createDataFrame(_rows(), "id long, " + ", ".join(f"{c} double" for c in NAMES)).drop("d")
    names = [c for c in NAMES if c != "d"]
    rows = wide.rank_columns(df, "id", names).collect()
    got = {r.feature: r for r in wide.rank_summary(df, "id", names).collect()}
    assert len(got) == 25
    for f, r in got.items():
        own = [x[f] for x in rows if x[f] is not None]
        assert r.n == len(own) and (r.total == pytest.approx(math.fsum(own), abs=1e-8) if own else r.total is None) and r.most == max(own, default=None)


def test_rounded_ranks_and_no_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 4.0)], "id long, x double")
    assert sorted(r.x_log1p for r in wide.rank_columns(df, "id", ["x"], 3).collect()) == [0.693, 1.099, 1.609]
    assert wide.rank_columns(df.filter("id > 5"), "id", ["x"]).collect() == []


def test_cells_are_not_exploded_or_sorted(spark, sf, monkeypatch):
    """Each cell was a row: exploded, shuffled, sorted, written, ranked, and shuffled back into lists by account."""
    written = []
    keep = wide.durable
    monkeypatch.setattr(wide, "durable", lambda df: written.append(df.columns) or keep(df))
    monkeypatch.setattr(queries_wide, "durable", lambda df: written.append(df.columns) or keep(df))
    for name in ("transform_columns", "factory_at_width"):
        text = plan(registry.queries()[name](spark, sf))
        assert "collect_list" not in text and "explode" not in text and "FlatMapCoGroupsInArrow" in text and "Round" not in text.split("FlatMapCoGroupsInArrow")[0] or name == "factory_at_width"
    assert written == [["b", "n", "keys", "x"]] * 2
