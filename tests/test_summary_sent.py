"""What the summary's passes send to and from Python."""

from __future__ import annotations

import math

import numpy as np
from test_scale import plan

from arrearium.operators import summary
from arrearium.plans import registry
from arrearium.sources import derived


def test_rounded_in_the_task_as_by_expressions(spark, sf):
    rows = derived.panel(spark, sf, by="cid", with_clients=True, ordered=True).filter("cid % 7 = 0")
    names = ["aid", "period", "act_utl", "agr9_Mean_Days", "ags12_Mean_Days", "ags6_Max_Due", "act12_n_arrears", "score", "scorem"]
    want = registry.scaled_rounded(summary.abt_summary(rows, names), 5)
    got = summary.abt_summary(rows, names, digits=5)
    assert got.dtypes == want.dtypes
    a, b = (sorted(tuple(r) for r in x.collect()) for x in (got, want))
    assert len(a) > 3000 and a == b
    odd = summary._nearest(np.array([1.134375, -1.134375, -0.0, 3e300, math.inf, math.nan]), 5)
    assert list(odd[:5]) == [1.13437, -1.13437, 0.0, 3e300, math.inf] and math.isnan(odd[5]) and math.copysign(1, odd[2]) == 1


def test_summary_sends_one_array_and_rounds_no_rows(spark, sf):
    """Two dozen columns were sent, whose sizes were added up after each row, and 34 columns rounded by expressions."""
    text = plan(registry.queries()["abt_summary"](spark, sf))
    assert "floor" not in text.split("MapInArrow")[0].lower() and "array(" in text.split("Generate explode(sequence")[0]
