"""Feature families on the wide table: ratios, interactions, group statistics and bureau-like noise, with their lineage."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearium.functions.scalars import log1p_pos, safe_div

from .catalog import Derived, guard
from .features import _normal, _uniform, label_codes, quantiles
from .wide import profiles, unpivot

#: Ratios by numerator and denominator (a number, or a column).
RATIOS = {
    "app_spendings_to_app_income": ("app_spendings", "app_income"), "app_number_of_children_to_age": ("app_number_of_children", "act_age"), "loan_amount_to_income": ("loan_amount", "app_income"),
    "installment_to_income": ("installment", "app_income"), "loan_amount_to_age": ("loan_amount", "act_age"), "tenor_in_years": ("n_installments", 12), "act_due_m2_to_loan_amount": ("act_due_m2", "loan_amount"),
    "act_due_m2_to_installment": ("act_due_m2", "installment"), "max_due_to_loan_amount": ("max_due", "loan_amount"), "months_ever_due_div_12": ("months_ever_due", 12),
}
LOGS = {"log_app_income": "app_income", "log_age": "act_age"}
#: Products of two columns, the first one of those marked # by its code; a column with itself is a square.
PRODUCTS = {
    "age_x_income": ("act_age", "app_income"), "age_squared": ("act_age", "act_age"), "app_income_squared": ("app_income", "app_income"), "age_x_n_children": ("act_age", "app_number_of_children"),
    "marital_x_n_children": ("#app_nom_marital_status", "app_number_of_children"), "job_code_x_income": ("#app_nom_job_code", "app_income"), "loan_amount_x_tenor": ("loan_amount", "n_installments"),
    "age_x_loan_amount": ("act_age", "loan_amount"), "loan_amount_x_income": ("loan_amount", "app_income"),
}
_SHORT = {"app_income": "income", "act_age": "age", "app_spendings": "spendings", "app_number_of_children": "n_children", "app_nom_cars": "cars"}
#: Keys of each statistic of each application column, then of the loan terms.
APPLICATION_GROUPS = [
    ("mean", "app_income", "job_code branch city marital_status home_status gender"), ("mean", "act_age", "marital_status city job_code home_status gender branch"), ("mean", "app_spendings", "home_status branch city job_code"),
    ("std", "app_income", "job_code branch city marital_status"), ("std", "act_age", "branch job_code"), ("median", "app_income", "job_code branch city"), ("median", "act_age", "branch"),
    ("count", None, "job_code branch city marital_status home_status gender"), ("mean", "app_number_of_children", "marital_status home_status job_code"), ("mean", "app_nom_cars", "job_code branch"),
]
LOAN_GROUPS = [(s, v, "branch job_code city") for s, v in (("mean", "loan_amount"), ("median", "loan_amount"), ("std", "loan_amount"), ("mean", "n_installments"), ("median", "installment"))]


def group_specs(groups: list[tuple[str, str | None, str]], full: bool = False) -> list[tuple[str, str | None, str, str]]:
    """(key, value, statistic, name) of every statistic; `full` names keep the columns' names."""
    out = []
    for stat, value, keys in groups:
        for k in keys.split():
            key = f"app_nom_{k}"
            out.append((key, value, stat, f"count_by_{k}" if value is None else f"{stat}_{value}_by_{key}" if full else f"{stat}_{_SHORT[value]}_by_{k}"))
    return out


SPECS_A, SPECS_B = group_specs(APPLICATION_GROUPS), group_specs(LOAN_GROUPS, True)


#: Levels of a key up to which what belongs to them is a literal; a join copies all columns of each row.
FEW = 64


def _looked_up(kind: str, key: str, rows: Mapping[Any, Sequence[float | None]]) -> Column | None:
    """The array of numbers of a row's level, null for other levels; None for too many levels, or levels of another kind."""
    if kind not in ("int", "bigint", "string") or len(rows) > FEW:
        return None
    values = lambda xs: F.array(*[F.lit(None if x is None else float(x)).cast("double") for x in xs])
    own = [x for k, v in rows.items() if k is not None for x in (F.lit(k).cast(kind), values(v))]
    found = F.try_element_at(F.create_map(*own), F.col(key)) if own else F.lit(None).cast("array<double>")
    return F.when(F.col(key).isNull(), values(rows[None])).otherwise(found) if None in rows else found


def group_statistics(df: DataFrame, specs: list[tuple[str, str | None, str, str]], train: Column, most: int = 100_000, fitted: DataFrame | None = None) -> DataFrame:
    """`df` with mean, std, median or count of a value by a key on the training rows, and the global statistic where the
    key wasn't seen in them (for count, all training rows).

    Each key is grouped once for all its statistics, medians come from ranged counts, and a key's table is a literal, or
    broadcast if it has many levels: it has at most `most`, more are an error. The statistics come from `fitted`, the same rows with fewer columns, if given.
    """
    fit = (df if fitted is None else fitted).filter(train)
    of: dict[str, list] = defaultdict(list)
    for key, value, stat, name in specs:
        of[key].append((value, stat, name))
    how = {"mean": F.avg, "std": F.stddev_samp}
    plain = {(v, s) for _, v, s, _ in specs if s in how}
    whole = fit.agg(F.count("*").alias("n"), *[how[s](v).alias(f"{s}_{v}") for v, s in plain]).first()
    middles = {v: p.quantiles[0] if p.n else None for v, p in profiles(fit, sorted({v for _, v, s, _ in specs if s == "median"}), [0.5]).items()}
    out = df
    for key, wanted in of.items():
        by = fit.groupBy(key).agg(*[F.count("*").alias(n) if s == "count" else how[s](v).alias(n) for v, s, n in wanted if s != "median"] or [F.count("*").alias("__n")])
        medians = [(v, n) for v, s, n in wanted if s == "median"]
        if medians:
            columns = sorted({v for v, _ in medians})
            q = quantiles(unpivot(fit.filter(F.col(key).isNotNull()), columns, (key,)), "value", [0.5], [key, "c"])
            rows = q.groupBy(key).agg(*[F.max(F.when(F.col("c") == columns.index(v), F.col("q")[0])).alias(n) for v, n in medians])
            by = by.join(rows.withColumnRenamed(key, "__k"), F.col(key) == F.col("__k"), "left").drop("__k")
        names = [n for _, _, n in wanted]
        levels = by.select(F.col(key).alias("__key"), *names).limit(most + 1).collect()
        if len(levels) > most:
            raise ValueError(f"{key} has more than {most} levels")
        if (found := _looked_up(dict(df.dtypes)[key], key, {r["__key"]: [r[n] for n in names] for r in levels})) is not None:
            values = {n: F.get(found, F.lit(i)) for i, n in enumerate(names)}
        else:
            small = df.sparkSession.createDataFrame(levels, by.select(F.col(key).alias("__key"), *names).schema)
            out = out.join(F.broadcast(small), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
            values = {n: F.col(n) for n in names}
        made = {}
        for v, s, n in wanted:
            fallback = whole["n"] if s == "count" else middles[v] if s == "median" else whole[f"{s}_{v}"]
            made[n] = F.coalesce(values[n].cast("double"), F.lit(fallback).cast("double"))
        out = out.withColumns(made)
    return out


def fallback_rates(df: DataFrame, keys: list[str], train: Column) -> DataFrame:
    """key, n, n_unseen, rate: how many rows out of training have a key that training doesn't."""
    long = lambda part: part.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("level")) for k in keys])).alias("x")).select("x.*").groupBy("key", "level").agg(F.count("*").alias("n"))
    seen = long(df.filter(train)).select(F.col("key").alias("k"), F.col("level").alias("l"))
    held = long(df.filter(~train)).join(seen, (F.col("key") == F.col("k")) & F.col("level").eqNullSafe(F.col("l")), "left")
    out = held.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)).alias("n_unseen"))
    return out.withColumn("rate", safe_div(F.col("n_unseen"), F.col("n")))


def ratios_and_products(df: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """`df` with 12 ratios and logs, cut at their first and last percentile, and 9 products; cuts come from one scan, and with the
    codes from `fitted`, the same rows with fewer columns, if given."""
    side = lambda x: F.col(x).cast("double") if isinstance(x, str) else F.lit(float(x))
    source = df if fitted is None else fitted
    raw = {**{k: safe_div(side(a), side(b)) for k, (a, b) in RATIOS.items()}, **{k: log1p_pos(F.col(c).cast("double")) for k, c in LOGS.items()}}
    made = df.withColumns(raw)
    found = profiles(source.withColumns(raw), [*RATIOS, *LOGS], [0.01, 0.99])
    cut = lambda k: F.when(F.col(k).isNotNull(), F.greatest(F.least(F.col(k), F.lit(found[k].quantiles[1])), F.lit(found[k].quantiles[0])))
    made = made.withColumns({k: cut(k) for k in found if found[k].n})
    coded = sorted({a[1:] for a, _ in PRODUCTS.values() if a[0] == "#"})
    for c in coded:
        levels = [r[0] for r in source.select(c).filter(F.col(c).isNotNull()).distinct().limit(FEW + 1).collect()]
        code = _looked_up(dict(df.dtypes)[c], c, {k: [i] for i, k in enumerate(sorted(levels))})
        made = label_codes(made, c, f"__code_{c}", source) if code is None else made.withColumn(f"__code_{c}", F.get(code, F.lit(0)).cast("int"))
    left = lambda a: F.col(f"__code_{a[1:]}").cast("double") if a[0] == "#" else F.col(a).cast("double")
    return made.withColumns({k: left(a) * F.col(b).cast("double") for k, (a, b) in PRODUCTS.items()}).drop(*[f"__code_{c}" for c in coded])


def beta(key: str, seed: int, a: int, b: int) -> Column:
    """A reproducible Beta(a, b) draw for whole a and b: the a-th smallest of a + b - 1 uniform numbers of the row's key."""
    return F.sort_array(F.array(*[_uniform(key, seed + i) for i in range(a + b - 1)]))[a - 1]


def poisson(key: str, seed: int, rate: float) -> Column:
    """A reproducible Poisson draw, by the inverse distribution function."""
    steps, total, term = [], 0.0, 2.718281828459045**-rate
    for k in range(int(rate + 10 * rate**0.5 + 10)):
        total += term
        steps.append(total)
        term *= rate / (k + 1)
    u = _uniform(key, seed)
    return F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s < u)).cast("double")


#: Parameters of the bureau-like columns.
CREDIT_SCORES = [(1e-4, 2.0, 0.0, 50), (5e-5, 3.0, 0.0, 40), (8e-5, 1.5, 0.0, 60), (1e-4, 0.0, -0.001, 55), (1.2e-4, 2.5, -0.0005, 45), (0.0, 4.0, 0.0, 80), (1e-4, 2.0, -0.0008, 30), (7e-5, 1.0, 0.0, 70), (9e-5, 2.5, -0.0003, 50), (1.1e-4, 1.8, 0.0, 35)]
UTILIZATION = [(2, 5), (3, 6), (1, 4), (2, 4), (4, 8), (2, 7), (3, 5), (1, 5), (2, 6), (3, 7)]
PAYMENT = [5, 10, 8, 12, 6, 7, 9, 11, 4, 13]
DEROGATORY = [0.1, 0.3, 0.5, 0.05, 0.2, 0.15, 0.4, 0.08, 0.25, 0.12]
BALANCES = [(2, 5), (1, 6), (3, 4), (2, 7), (4, 5), (1, 4), (2, 6), (3, 5), (1, 8), (2, 4)]
LIMITS = [0.3, 0.5, 0.4, 0.6, 0.2, 0.7, 0.5, 0.4, 0.3, 0.6]


def bureau_like(df: DataFrame, key: str = "aid", seed: int = 7000, fitted: DataFrame | None = None) -> tuple[DataFrame, list[Derived]]:
    """`df` with 66 bureau-like columns of application data and noise, and their lineage; a source of any other level is refused.

    Every draw depends on the row's key only. Standardising and scaling take the income's moments from one aggregate
    (of `fitted`, the same rows with fewer columns, if given).
    """
    income, age, spend = (F.col(c).cast("double") for c in ("app_income", "act_age", "app_spendings"))
    mean, std, top = (df if fitted is None else fitted).agg(F.avg(income), F.stddev_pop(income), F.max(income)).first()
    clip = lambda x, lo, hi: F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))
    made: dict[str, tuple[Column, tuple[str, ...], str]] = {}
    draw = iter(range(seed, seed + 10_000, 20))
    for i, (a, b, c, sigma) in enumerate(CREDIT_SCORES, 1):
        made[f"synth_credit_score_v{i}"] = (clip(a * income + b * age + c * spend + 500 + sigma * _normal(key, next(draw)), 300, 850), ("app_income", "act_age", "app_spendings"), f"clip({a} income + {b} age + {c} spendings + 500 + N(0, {sigma}), 300, 850)")
    for i, (a, b) in enumerate(UTILIZATION, 1):
        made[f"synth_utilization_v{i}"] = (clip(beta(key, next(draw), a, b) + 0.05 * (income - (mean or 0.0)) / ((std or 0.0) + 1e-6), 0, 1), ("app_income",), f"clip(Beta({a}, {b}) + 0.05 z(income), 0, 1)")
    for i, sigma in enumerate(PAYMENT, 1):
        base = 50 + 30 * clip((age - 25) / 40, 0, 1) + 20 * clip(income / max(top or 1.0, 1.0), 0, 1)
        made[f"synth_payment_history_v{i}"] = (clip(base + sigma * _normal(key, next(draw)), 0, 100), ("act_age", "app_income"), f"clip(50 + 30 age + 20 income + N(0, {sigma}), 0, 100)")
    for i, rate in enumerate(DEROGATORY, 1):
        made[f"synth_derogatory_v{i}"] = (poisson(key, next(draw), rate), (), f"Poisson({rate})")
    for i, (a, b) in enumerate(BALANCES, 1):
        made[f"synth_balance_v{i}"] = (income * beta(key, next(draw), a, b), ("app_income",), f"income * Beta({a}, {b})")
    for i, sigma in enumerate(LIMITS, 1):
        made[f"synth_limit_v{i}"] = (income * F.exp(sigma * _normal(key, next(draw))), ("app_income",), f"income * LogNormal(0, {sigma})")
    for name, (_, sources, _) in made.items():
        guard(name, sources)
    out = df.withColumns({name: e for name, (e, _, _) in made.items()})
    share = {
        "synth_util_to_limit": ("synth_balance_v1", "synth_limit_v1"), "synth_revolving_util_ratio": ("synth_balance_v2", "synth_limit_v2"), "synth_balance_to_income_ratio": ("synth_balance_v1", "app_income"),
        "synth_revolving_to_total_ratio": ("synth_balance_v2", "synth_balance_v1"), "synth_lim_to_income": ("synth_limit_v1", "app_income"), "synth_second_lim_to_income": ("synth_limit_v2", "app_income"),
    }
    out = out.withColumns({name: safe_div(F.col(a), F.col(b)) for name, (a, b) in share.items()})
    lines = [Derived(name, "F6E", sources, formula) for name, (_, sources, formula) in made.items()]
    return out, lines + [Derived(name, "F6E", pair, " / ".join(pair)) for name, pair in share.items()]


def lines_of_families() -> list[Derived]:
    """Lineage of the ratios, logs, products and group statistics."""
    columns = lambda *xs: tuple(x.lstrip("#") for x in xs if isinstance(x, str))
    out = [Derived(k, "F3", columns(a, b), f"{a} / {b}") for k, (a, b) in RATIOS.items()] + [Derived(k, "F3", (c,), f"log1p({c})") for k, c in LOGS.items()]
    out += [Derived(k, "F4", tuple(dict.fromkeys(columns(a, b))), f"{a} * {b}") for k, (a, b) in PRODUCTS.items()]
    return out + [Derived(n, family, columns(key, v), f"{s}({v or 1}) by {key}, training rows") for family, specs in (("F5A", SPECS_A), ("F5B", SPECS_B)) for key, v, s, n in specs]
