"""Wide tables: ranks of many columns, as-of joins, binning, prefixes, bootstrap and batched fits against plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrearium.operators import batch_fits, cutoffs, resample, scorecard, wide
from arrearium.operators.asof import as_of_join
from arrearium.operators.prefix import best_prefixes


def test_rank_columns(spark, monkeypatch):
    """Few and many levels, nulls, ties over partitions, a value on a third of the rows, a constant and an empty column."""
    draw = random.Random(1)
    rows = [(i, draw.choice([0.0, 1.5, 2.0, None]), None if draw.random() < 0.2 else 0.0 if draw.random() < 0.4 else round(draw.gauss(0, 3), 2), 7.0, None, float("nan") if i % 50 == 0 else float(i // 3)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double")
    monkeypatch.setattr(wide, "LEVELS", 10)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.id: r for r in wide.rank_columns(df, "id", list("abcde")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k, name in enumerate("abcde", 1):
        values = {r[0]: r[k] for r in rows if r[k] is not None and r[k] == r[k]}
        ordered = sorted(values.values())
        place = {}
        for p, v in enumerate(ordered, 1):
            place.setdefault(v, []).append(p)
        for i, r in got.items():
            want = sum(place[values[i]]) / len(place[values[i]]) if i in values else None
            assert r[f"{name}_rank"] == want, (name, i)
            if want is not None:
                assert r[f"{name}_pct"] == pytest.approx((want - 1) / 899)
        if len(set(ordered)) > 1:
            mean, std = np.mean(ordered), np.std(ordered, ddof=1)
            assert all(got[i][f"{name}_z"] == pytest.approx((v - mean) / std) for i, v in values.items())
    assert got[1].c_z == 0.0 and got[1].d_rank is None and all(got[r[0]].a_sqrt == (0.0 if r[1] is None else math.sqrt(r[1])) for r in rows)


def test_profiles_and_bins(spark):
    values = [3.0, 1.0, 1.0, None, 2.0, 10.0, 1.0, 4.0]
    df = spark.createDataFrame([(v, 1.0, None) for v in values], "x double, one double, none double")
    found = wide.profiles(df, ["x", "one", "none"], [0.0, 0.25, 0.5, 1.0], 3)
    own = [v for v in values if v is not None]
    assert found["x"].quantiles == pytest.approx(np.quantile(own, [0.0, 0.25, 0.5, 1.0])) and found["x"].distinct == 5 and found["x"].first == (1.0, 2.0, 3.0)
    assert found["none"].n == 0 and found["one"].quantiles == (1.0,) * 4
    made = wide.one_hot_columns(df, {"x": (4,), "one": (4,)})
    assert [c for c in made.columns if "_q4_" in c] == [f"x_q4_{i}" for i in (1, 2, 3)]  # the first two edges are equal
    assert [sum(r) for r in made.select("x_q4_1", "x_q4_2", "x_q4_3").collect()] == [0 if v is None else 1 for v in values]


@pytest.mark.parametrize("block", [None, 3])
def test_as_of_join(spark, block):
    draw = random.Random(2)
    left = [(i, draw.choice(["a", "b", "c", None]), draw.randrange(0, 30)) for i in range(80)]
    right = [(draw.choice(["a", "b", "a"]), draw.randrange(0, 30), draw.randrange(100)) for _ in range(40)]
    out = as_of_join(spark.createDataFrame(left, "id int, k string, t int"), spark.createDataFrame(right, "k string, s int, v int"), ["k"], "t", "s", ["v"], block=block)
    for r in out.collect():
        near = [(s, v) for k, s, v in right if k == r.k and s <= r.t]
        assert (r.matched_time, r.v) == (max(near) if near else (None, None))
    assert out.count() == 80


def plain_bins(values, y, max_bins=20, share=0.05):
    """Cuts by plain Python on the rows themselves: bins are counted anew after every change."""
    pairs = [(v, t) for v, t in zip(values, y) if v is not None]
    xs = sorted({v for v, _ in pairs})
    cuts = xs[:-1] if len(xs) <= max_bins else sorted({round(float(c), 9) for c in np.quantile([v for v, _ in pairs], np.linspace(0, 1, max_bins + 1)[1:-1])})

    def count():
        edges = [-math.inf, *cuts, math.inf]
        return [[t for v, t in pairs if lo < v <= hi] for lo, hi in zip(edges, edges[1:])]

    least = max(int(share * len(pairs)), 1)
    while len(cuts) > 1 and min(map(len, count())) < least:
        sizes = list(map(len, count()))
        i = sizes.index(min(sizes))
        left = i == len(cuts) or (i > 0 and sizes[i - 1] <= sizes[i + 1])
        del cuts[i - 1 if left else i]
    rates = lambda: [sum(b) / max(len(b), 1) for b in count()]
    r = rates()
    if len(r) >= 3:
        rising = sum(b > a for a, b in zip(r, r[1:])) >= sum(b < a for a, b in zip(r, r[1:]))
        while True:
            r = rates()
            wrong = [i for i in range(len(r) - 1) if (r[i + 1] < r[i] if rising else r[i + 1] > r[i])]
            if not wrong:
                break
            del cuts[wrong[0]]
    return cuts, [len(b) for b in count()], [sum(b) for b in count()]


def test_numeric_bins_replay(spark):
    draw = random.Random(3)
    columns = {
        "few": [draw.choice([1.0, 2.0, 3.0, 5.0, None]) for _ in range(600)], "rare": [draw.choice([0.0] * 40 + [1.0, 2.0, 3.0] + [4.0] * 20) for _ in range(600)],
        "many": [draw.gauss(0, 1) for _ in range(600)], "tied": [max(0.0, round(draw.gauss(-0.5, 1), 1)) for _ in range(600)], "constant": [1.0] * 600,
    }
    y = [int(draw.random() < (0.4 if (columns["many"][i] > 0.5) != (draw.random() < 0.2) else 0.1)) for i in range(600)]
    rows = list(zip(y, *columns.values()))
    df = spark.createDataFrame(rows, "y int, " + ", ".join(f"{c} double" for c in columns))
    fitted = scorecard.fit_numeric(df, list(columns), "y")
    for c, values in columns.items():
        cuts, n, e = plain_bins(values, y)
        b = fitted[c]
        assert b.cuts == pytest.approx(cuts) and (b.n, b.events) == (n, e), c
        bad, good = sum(e) + 1, sum(n) - sum(e) + 1
        assert b.woe == pytest.approx([math.log((k + 0.5) / bad / ((m - k + 0.5) / good)) for m, k in zip(n, e)])
    one = scorecard.fit_numeric(df.withColumn("y", F.lit(0)), ["many", "few"], "y")
    assert [(b.cuts, b.woe, b.iv, b.n, b.trend) for b in one.values()] == [([], [0.0], 0.0, [600], "flat"), ([], [0.0], 0.0, [sum(v is not None for v in columns["few"])], "flat")]


def test_best_prefixes(spark):
    draw = np.random.default_rng(4)
    rows = [(int(g), float(round(p, 1)), float(v)) for g, p, v in zip(draw.integers(0, 3, 500), draw.uniform(0, 5, 500), draw.normal(0.05, 1, 500))]
    df = spark.createDataFrame(rows, "g int, p double, v double").repartition(3)
    scale = np.array([1.0, -1.0, 0.5])
    found = best_prefixes(df, "g", "p", lambda g, x: (np.ones((len(x["v"]), 3)), x["v"][:, None] * scale + 0.01, [np.full(3, float(len(x["v"])))]), 3, 1)
    for g in range(3):
        own = [(p, v) for k, p, v in rows if k == g]
        for j, s in enumerate(scale):
            ways = [(sum(v * s + 0.01 for p, v in own if p <= at), at) for at in sorted({p for p, _ in own})]
            most, at = max(ways, key=lambda w: (round(w[0], 9), -w[1]))
            b = found[g]
            assert b.best[j] == pytest.approx(max(most, 0.0)) and b.n[j] == len(own) == b.extras[0][j] and b.total[j] == pytest.approx(sum(v * s + 0.01 for _, v in own))
            assert (b.best_at[j], b.best_n[j]) == ((at, sum(p <= at for p, _ in own)) if most > 0 else (0.0, 0.0))


def _accounts(n=300, seed=5):
    draw = random.Random(seed)
    return [(i, draw.random() * 0.3, draw.choice([12, 24, 36]), float(draw.randrange(1000, 9000)), int(draw.random() < 0.1)) for i in range(n)]


def test_linear_grid_is_scenario_rows(spark):
    """Cells from common sums equal those of accounts under every scenario."""
    df = spark.createDataFrame(_accounts(), "aid long, score double, n_installments int, loan_amount double, y int")
    axes = {"pd_mult": [1.0, 2.0], "strategy": ["tiered", "flat24"], "cof": [0.0, 0.3], "acq": [0.0, 150.0], "lgd": [0.45, 0.8], "op": [0.0, 0.02]}
    keys = list(axes)
    got = {tuple(r[k] for k in keys): r for r in cutoffs.linear_grid(df, axes, fixed_cutoffs={(m, s): 0.2 for m in (1.0, 2.0) for s in axes["strategy"]}).collect()}
    rows = cutoffs.scenario_rows(df, cutoffs.grid(spark, **axes, disc=[0.05]))
    want = {tuple(r[k] for k in keys): r for r in cutoffs.optimal_cutoffs(rows, keys).collect()}
    means = {tuple(r[k] for k in keys): r for r in cutoffs.grid_means(rows, keys).collect()}
    fixed = {tuple(r[k] for k in keys): r["x"] for r in rows.filter("pd_stressed <= 0.2").groupBy(*keys).agg(F.sum("Expected_Profit").alias("x")).collect()}
    assert set(got) == set(want) and len(got) == 64
    for k, w in want.items():
        g = got[k]
        assert g.total_profit == pytest.approx(w.total_profit) and g.max_profit == pytest.approx(w.max_profit) and g.approve_pct == pytest.approx(w.approve_pct) and g.category == w.category and g.cutoff_pd == pytest.approx(w.cutoff_pd)
        assert g.mean_profit == pytest.approx(means[k].mean_profit) and g.share_positive == pytest.approx(means[k].share_positive) and g.profit_at_fixed == pytest.approx(fixed[k])


def test_cutoff_bootstrap(spark):
    """The data itself as replicate 0, strata at their size, and single replicates by plain loops over the same draws."""
    base = spark.createDataFrame(_accounts(200), "aid long, score double, n_installments int, loan_amount double, y int")
    rows = base.select("aid", "n_installments", "y", F.explode(F.array(F.struct(F.lit("a").alias("anchor"), F.col("score").alias("p"), (60 - 400 * F.col("score")).alias("v")), F.struct(F.lit("b").alias("anchor"), (F.col("score") * 2).alias("p"), (F.col("loan_amount") / 100 - 500 * F.col("score")).alias("v")))).alias("x")).select("aid", "n_installments", "y", "x.*")
    args = {"pd_": "p", "profit": "v"}
    reps = resample.cutoff_bootstrap(rows, ["a", "b"], 50, {"a": 0.1, "b": 0.3}, **args)
    got = {(r.replicate, r.anchor): r for r in reps.collect()}
    assert len(got) == 102
    hashes = {r[0]: r[1] for r in base.select("aid", F.xxhash64(F.lit(42), "aid")).collect()}
    data = [tuple(r) for r in rows.collect()]
    for k in (0, 1, 17, 50):
        weight = {i: 1.0 if k == 0 else resample.draws(np.array([h]), 50)[0][k - 1] for i, h in hashes.items()}
        for s in (12, 24, 36) if k else ():
            own = [r for r in data if r[1] == s and r[3] == "a"]
            f = len(own) / sum(weight[r[0]] for r in own)
            for r in own:
                weight[r[0]] *= f
        for anchor, limit in (("a", 0.1), ("b", 0.3)):
            own = sorted((r[4], r[5], weight[r[0]], r[2]) for r in data if r[3] == anchor)
            cum = best = count = at = n = 0.0
            for p, v, w, _ in own:
                cum, n = cum + v * w, n + w
                if cum > best:
                    best, count, at = cum, n, p
            r = got[k, anchor]
            total = sum(w for _, _, w, _ in own)
            assert total == pytest.approx(200) and r.profit_at_kstar == pytest.approx(best) and r.approve_pct_kstar == pytest.approx(100 * count / total)
            assert r.profit_at_fixed == pytest.approx(sum(v * w for p, v, w, _ in own if p <= limit)) and r.default_rate == pytest.approx(sum(t * w for _, _, w, t in own) / total)
            assert r.cutoff_pd_star == pytest.approx(at)
    checks = {(r.anchor, r.check_name): r.ok for r in resample.bootstrap_checks(reps, resample.cutoff_bootstrap(rows, ["a", "b"], 5, {"a": 0.1, "b": 0.3}, **args), drift=0.02).collect()}
    assert len(checks) == 10 and all(checks[a, k] for a in "ab" for k in ("finite", "interval_ordered", "reproduced", "strata_kept"))
    chances = {r.anchor: r for r in resample.cutoff_probabilities(reps).collect()}
    assert chances["a"].p_approve_all + chances["a"].p_interior + chances["a"].p_reject_most == pytest.approx(1)


def _rows_for_fits(n=800):
    draw = np.random.default_rng(6)
    x = draw.standard_normal((n, 4)) * [1, 2, 0.5, 1] + [0, 5, -1, 0]
    z = -0.7 + 1.2 * x[:, 0] - 0.4 * (x[:, 1] - 5)
    y = (draw.uniform(size=n) < 1 / (1 + np.exp(-z))).astype(int)
    return x, y


def test_batched_fits(spark):
    """Ridge fits solve their gradient equations; lasso fits meet the optimality conditions; groups fit as if alone."""
    x, y = _rows_for_fits()
    names = list("abcd")
    df = spark.createDataFrame([(i, *map(float, r), int(t), i % 3) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, d double, y int, g int").repartition(3)
    scales = batch_fits.scales_of(df, names)
    one = F.lit(1.0)
    fits = [batch_fits.Fit("ridge", one, names, 0.0, 0.01), batch_fits.Fit("lasso", one, names, 0.03), batch_fits.Fit("group", (F.col("g") == 1).cast("double"), ["a", "b"]), batch_fits.Fit("strong", one, names, 5.0)]
    batch_fits.fit_all(df, fits, "y", scales)
    s = np.column_stack([(x[:, j] - scales[c][1]) / scales[c][2] for j, c in enumerate(names)])

    def gradient(f, rows):
        b = np.array([f.coefficients[c] for c in f.features])
        part = s[rows][:, [names.index(c) for c in f.features]]
        r = y[rows] - 1 / (1 + np.exp(-(f.intercept + part @ b)))
        return b, np.concatenate([[r.mean()], (part * r[:, None]).mean(0)])

    everyone, first = np.arange(len(y)), np.arange(len(y)) % 3 == 1
    b, g = gradient(fits[0], everyone)
    assert abs(g[0]) < 1e-7 and g[1:] == pytest.approx(0.01 * b, abs=1e-7)
    b, g = gradient(fits[1], everyone)
    assert all(abs(k - 0.03 * np.sign(c)) < 1e-6 if c else abs(k) <= 0.03 + 1e-7 for c, k in zip(b, g[1:])) and 0 < len(fits[1].selected()) < 4
    _, g = gradient(fits[2], np.flatnonzero(first))
    assert np.abs(g).max() < 1e-7 and fits[2].rows == first.sum()
    assert fits[3].selected() == []
    p = df.select("id", fits[0].score(scales).alias("p")).toPandas().sort_values("id")["p"].to_numpy()
    b = np.array([fits[0].coefficients[c] for c in names])
    assert p == pytest.approx(1 / (1 + np.exp(-(fits[0].intercept + s @ b))))
    loss, whole = batch_fits.lasso_path_cv(df, names, "y", F.col("id") % 4, 4, [0.001, 0.02, 1.0])
    assert loss[0.001] < loss[1.0] and len(whole) == 3 and {"a", "b"} <= set(whole[0].selected())


def test_window_columns_are_rolling_and_trend(spark):
    """The array form against the operators that work on terms, with months missing."""
    from arrearium.operators import features

    draw = random.Random(7)
    cells = {(i, m): None if draw.random() < 0.25 or i == 5 else round(draw.gauss(2, 3), 1) for i in range(60) for m in range(1, 13)}
    long = spark.createDataFrame([(i, m, v) for (i, m), v in cells.items()], "aid long, m int, x double")
    flat = spark.createDataFrame([(i, *[cells[i, m] for m in range(1, 13)]) for i in range(60)], "aid long, " + ", ".join(f"x_m{m} double" for m in range(1, 13)))
    got = {r.aid: r for r in wide.window_columns(flat, "aid", ["x"]).collect()}
    for made in (features.rolling(long, {"x": "x"}), features.trend(long, {"x": "x"})):
        for r in made.collect():
            for c in made.columns:
                want = r[c]
                assert got[r.aid][c] == (None if want is None else pytest.approx(want, abs=1e-9)), (c, r.aid)
    assert len(got[0]) == 36


def test_prefixes_of_one_common_key(spark):
    """Nearly all rows have the largest key, as capped scores may: they were one partition, and are spread now."""
    draw = np.random.default_rng(8)
    rows = [(int(g), float(round(min(p, 1.0), 1)), float(v), i) for i, (g, p, v) in enumerate(zip(draw.integers(0, 2, 3000), draw.uniform(0, 20, 3000), draw.normal(0.02, 1, 3000)))]
    df = spark.createDataFrame(rows, "g int, p double, v double, id long").repartition(3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seen = spark.sparkContext.accumulator(0)

        def make(g, x):
            seen.add(len(x["v"]) ** 2)
            return np.ones((len(x["v"]), 2)), x["v"][:, None] * np.array([1.0, -1.0]), []

        found = best_prefixes(df, "g", "p", make, 2)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert seen.value < 3.2e6  # squares of what a task gets of a group: four times 750 rows, not twice 1,425
    for g in range(2):
        own = [(p, v) for k, p, v, _ in rows if k == g]
        for j, s in enumerate((1.0, -1.0)):
            ways = [(sum(v * s for p, v in own if p <= at), at) for at in sorted({p for p, _ in own})]
            most, at = max(ways, key=lambda w: (round(w[0], 9), -w[1]))
            b = found[g]
            assert b.best[j] == pytest.approx(max(most, 0.0)) and b.n[j] == len(own) and (b.best_at[j], b.best_n[j]) == ((at, sum(p <= at for p, _ in own)) if most > 0 else (0.0, 0.0))


def test_draws_are_the_distribution_function(spark):
    """Looked-up draws equal a search in the distribution function for every row and replicate."""
    h = np.random.default_rng(9).integers(-(2**63), 2**63 - 1, 700)
    with np.errstate(over="ignore"):
        z = h.view(np.uint64)[:, None] + np.arange(1, 401, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    assert (resample.draws(h, 400) == np.searchsorted(resample.poisson_cdf(), ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53)).all()


def test_bins_tell_the_side_of_a_gini(spark, monkeypatch):
    """Bins decide what they can; the other groups are ordered by every score. Both as the exact Gini says."""
    from arrearium.operators import metrics, models

    draw = np.random.default_rng(10)
    rows = [(int(g), float(s + 0.3 * g * t), int(t)) for g, s, t in zip(draw.integers(0, 4, 2000), draw.normal(0, 1, 2000), draw.uniform(size=2000) < 0.3)] + [(9, 1.0, 1)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    exact = {r.g: r.gini for r in metrics.discrimination(df, "s", "y", ["g"]).collect() if r.gini is not None}
    asked = []
    plain = metrics.discrimination
    monkeypatch.setattr(metrics, "discrimination", lambda part, *a: asked.append(sorted(r[0] for r in part.select("g").distinct().collect())) or plain(part, *a))
    middle = exact[2] - 1e-7
    assert metrics.above(df, "s", "y", "g", middle) == {g: v > middle for g, v in exact.items()} and asked == [[2]]
    assert metrics.above(df, "s", "y", "g", 0.99) == dict.fromkeys(exact, False) and asked == [[2]]
    assert metrics.above(df, "s", "y", "g", exact[1], bins=2) == {g: v > exact[1] for g, v in exact.items()} and 1 in asked[-1]
    monkeypatch.undo()
    blurred = models.perturb_to_gini(df.filter("g = 3").withColumn("k", F.monotonically_increasing_id()).withColumn("p", 1 / (1 + F.exp(-F.col("s")))), "p", "y", "k", exact[3] / 2)
    assert plain(blurred, "p_perturbed", "y").first()["gini"] == pytest.approx(exact[3] / 2, abs=0.02)


def test_linear_scenarios_are_linear_grids(spark):
    """All scenarios in one ranged pass, where each was a pass of its own."""
    df = spark.createDataFrame(_accounts(), "aid long, score double, n_installments int, loan_amount double, y int")
    scenarios, ops, limits = {"a": (1.0, "tiered", 0.0, 0.0, 0.5), "b": (5.0, "flat18", 0.06, 500.0, 0.85)}, [0.0, 0.02], {"a": 0.1, "b": 0.6}
    got = {(r.anchor, r.op): r for r in cutoffs.linear_scenarios(df, scenarios, ops, limits).collect()}
    for name, (m, s, cof, acq, lgd) in scenarios.items():
        alone = cutoffs.linear_grid(df, {"pd_mult": [m], "strategy": [s], "cof": [cof], "acq": [acq], "lgd": [lgd], "op": ops}, fixed_cutoffs={(m, s): limits[name]})
        for r in alone.collect():
            assert all(got[name, r.op][c] == (pytest.approx(r[c]) if isinstance(r[c], float) else r[c]) for c in alone.columns)
    assert len(got) == 4
