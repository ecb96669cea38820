"""Plans that must not grow: what is shuffled, broadcast or sent through a task, and that results stay the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from arrearium.operators import features, panel, reports, trajectories
from arrearium.plans import queries_scores, registry
from arrearium.sources import derived


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def test_action_scores_joins_nothing(spark, sf):
    """Account-months were broadcast where the orders file is small, and shuffled twice else."""
    text = plan(registry.queries()["action_scores"](spark, sf))
    assert "Join" not in text and "Exchange" not in text


def test_panel_is_dealt_before_it_has_months(spark, sf):
    for by in ("aid", "cid"):
        p = derived.panel(spark, sf, by=by, with_clients=True).groupBy(by).count()
        text = plan(p)
        assert text.index("HashAggregate") < text.index("Generate") < text.index("REPARTITION_BY_NUM") and "ENSURE_REQUIREMENTS" not in text.split("Generate")[0]
    assert derived.panel(spark, sf).exceptAll(derived.panel(spark, sf, by=None)).isEmpty()


def test_trailing_shuffles_accounts_only(spark, sf):
    """One exchange, of the accounts; rows of an account may lie in several batches."""
    df = registry.queries()["trailing_windows"](spark, sf)
    assert "ENSURE_REQUIREMENTS" not in plan(df)
    want = {tuple(r) for r in df.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {tuple(r) for r in registry.queries()["trailing_windows"](spark, sf).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_base_and_wide_tables_shuffle_no_account_months(spark, sf):
    """Accounts and clients are joined and dealt before they have months; then only a row for each month is added up."""
    for name in ("abt_base", "null_audit"):
        text = plan(registry.queries()[name](spark, sf))
        top = text[: text.index("Generate explode(sequence")]
        assert "REPARTITION" not in top and "hashpartitioning(cid" not in top and "hashpartitioning(aid" not in top, name
        assert "SortMergeJoin" not in top, name


def test_scaled_rounding_equals_duckdb(spark):
    import duckdb

    values = [1.134375, -1.134375, 2.000005, 0.5, 1 / 3, -7.0, None]
    got = [r.x for r in registry.scaled_rounded(spark.createDataFrame([(v,) for v in values], "x double"), 5).collect()]
    want = [r[0] for r in duckdb.connect().sql("SELECT round(x, 5) FROM (SELECT unnest([1.134375::DOUBLE, -1.134375, 2.000005, 0.5, 1 / 3, -7.0, NULL]) AS x)").fetchall()]
    assert got == want and got[0] == 1.13437


def test_actions_come_along_with_their_months(spark, sf):
    """Account-months were joined with the actions of the same account-months, both shuffled by account and month."""
    names = ("transitions", "transition_buffers", "default_by_action", "account_histories", "action_effectiveness")
    for name in names:
        text = plan(registry.queries()[name](spark, sf))
        assert "SortMergeJoin" not in text and "HashJoin" not in text and "hashpartitioning(aid" not in text.split("REPARTITION")[0], name
    p = derived.panel(spark, sf)
    both = derived.with_actions(p)
    for own, joined in (
        (trajectories.transitions(both), trajectories.transitions(p, derived.actions(p))), (trajectories.histories(both), trajectories.histories(p, derived.actions(p))),
        (reports.action_effectiveness(both), reports.action_effectiveness(p, derived.actions(p))), (reports.default_by_action(panel.default_flags(both)), reports.default_by_action(panel.default_flags(p), derived.actions(p))),
    ):
        assert own.exceptAll(joined.select(own.columns)).isEmpty() and own.count() == joined.count()


def test_flags_look_at_no_growing_rest(spark, sf):
    """The rest of an account's months was a frame of its own for every month."""
    assert "specifiedwindowframe(RowFrame, 1, unboundedfollowing" not in plan(panel.default_flags(derived.panel(spark, sf)))


def test_outcomes_shuffle_no_account_months(spark, sf):
    for name in ("thesis_abt", "wide_abt", "vintage_risk", "cleaned"):
        top = plan(registry.queries()[name](spark, sf)).split("Generate explode(sequence")[0]
        assert "hashpartitioning(aid" not in top and "SortMergeJoin" not in top, name


def test_model_rows_read_the_months_once(spark, sf, monkeypatch):
    """Months were made and grouped twice, joined by account, and joined with accounts and clients once more."""
    seen = []
    monkeypatch.setattr(queries_scores, "durable", lambda df: seen.append(plan(df)) or df)
    got = queries_scores._model_rows(spark, sf)
    assert seen[0].count("Generate explode(sequence") == 1
    p = derived.panel(spark, sf)
    early = features.rolling(p.filter("k < 6").withColumn("m", F.col("k") + 1), {"due": "due_installments", "days": "pay_days"}, (3, 6))
    later = p.groupBy("aid").agg(F.max(((F.col("k") >= 6) & (F.col("due_installments") >= 4)).cast("int")).alias("y"))
    a = derived.accounts(spark, sf).join(derived.clients(spark, sf).select("cid", "income", "job_code"), "cid")
    want = early.join(later, "aid").join(a, "aid").withColumn("split", F.when(F.col("fin_period") < 199600, "train").otherwise("oot")).select(got.columns)
    assert got.dtypes == want.dtypes and got.count() == want.count() and got.exceptAll(want).isEmpty()
