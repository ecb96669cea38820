"""Scalar expressions of the collections and credit domain; all are plain columns."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Collection stages.
GOOD, AMICABLE, PRE_LEGAL, LEGAL, EXECUTION, POST_EXECUTION, CURED, WRITE_OFF = range(1, 9)
#: Account states.
ACTIVE, BAD, CLOSED = 1, 2, 3
#: Due installments at which a stage begins, and the stage.
STAGE_STEPS = [(1, AMICABLE), (4, PRE_LEGAL), (5, LEGAL), (7, EXECUTION), (10, POST_EXECUTION), (12, WRITE_OFF)]
#: APR by upper bound of the default probability.
APR_TIERS = [(0.005, 0.12), (0.01, 0.18), (0.02, 0.22), (0.05, 0.26)]
APR_TOP = 0.30


def safe_div(a: Column, b: Column) -> Column:
    """Null on a zero denominator."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def log1p_pos(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def sqrt_pos(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    x = x if low is None else F.when(x < low, F.lit(low)).otherwise(x)
    return x if high is None else F.when(x > high, F.lit(high)).otherwise(x)


def logit(p: Column, eps: float = 1e-7) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def age_at(date_of_birth: Column, first_of_month: Column) -> Column:
    return F.floor(F.datediff(first_of_month, date_of_birth) / 365.25).cast("int")


def decode(df: DataFrame, column: str, labels: Mapping[int, str], out: str, default: str = "Empty") -> DataFrame:
    """Label of a code; the mapping is a literal, so nothing is joined."""
    e = F.lit(default)
    for code, label in labels.items():
        e = F.when(F.col(column) == code, label).otherwise(e)
    return df.withColumn(out, e)


#: Fixed values: (stages, due installments, coming stage).
TRANSITIONS = [((GOOD, CURED), 1, AMICABLE), ((AMICABLE,), 4, PRE_LEGAL), ((PRE_LEGAL,), 5, LEGAL), ((LEGAL,), 7, EXECUTION), ((EXECUTION,), 10, POST_EXECUTION)]


def next_stage(due: Column, stage: Column) -> Column:
    """Collection stage after a month: a step up at the stage's own number of due installments, write-off at 12,
    cured at 0 unless a good payer, else unchanged."""
    e = F.when((due == 0) & (stage != GOOD), F.lit(CURED)).otherwise(stage)
    for stages, at, coming in TRANSITIONS:
        e = F.when(stage.isin(list(stages)) & (due == at), F.lit(coming)).otherwise(e)
    return F.when(due == 12, F.lit(WRITE_OFF)).otherwise(e)


def stage_path(dues: Column) -> Column:
    """Stages of an account from the array of its dues in order of the months, starting as a good payer."""
    start = F.array(F.lit(GOOD))
    path = F.aggregate(dues, start, lambda acc, due: F.array_append(acc, next_stage(due, F.element_at(acc, -1))))
    return F.slice(path, F.lit(2), F.size(dues))


def stage_of_due(due: Column) -> Column:
    """Stage from due installments alone."""
    e = F.lit(GOOD)
    for least, s in STAGE_STEPS:
        e = F.when(due >= least, F.lit(s)).otherwise(e)
    return e


def apr_tier(pd_: Column, cap: float | None = None) -> Column:
    e = F.lit(APR_TOP)
    for bound, apr in reversed(APR_TIERS):
        e = F.when(pd_ < bound, F.lit(apr)).otherwise(e)
    return e if cap is None else F.least(e, F.lit(cap))


def apr_flat(rate: float) -> Column:
    return F.lit(rate)


def monthly_hazard(pd_12m: Column) -> Column:
    return 1 - F.pow(1 - clip(pd_12m, None, 0.999), F.lit(1 / 12))


def one_period_profit(pd_: Column, loan: Column, apr: Column, lgd: Column) -> Column:
    return (1 - pd_) * loan * apr - pd_ * loan * lgd


def digits(actions: Column) -> Column:
    """Array of the digits of an action string."""
    return F.filter(F.split(F.coalesce(actions, F.lit("")), ""), lambda c: c != "")


def _mapped(values: Mapping[str, float]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(float(v)))])


def action_sum(actions: Column, values: Mapping[str, float]) -> Column:
    """Sum over an action string's digits, unknown ones counting 0: cost or harshness, by the table given."""
    table = _mapped(values)
    return F.aggregate(digits(actions), F.lit(0.0), lambda acc, c: acc + F.coalesce(table[c], F.lit(0.0)))


def injustice(stage: Column, actions: Column, scores: Mapping[tuple[int, str], float], step: float = 0.1) -> Column:
    """Score of (stage, digit) pairs plus `step` for each neighbouring pair of ascending digits."""
    table = _mapped({f"{s}:{d}": v for (s, d), v in scores.items()})
    ds = digits(actions)
    base = F.aggregate(ds, F.lit(0.0), lambda acc, c: acc + F.coalesce(table[F.concat(stage.cast("string"), F.lit(":"), c)], F.lit(0.0)))
    nxt = F.when(F.size(ds) > 1, F.zip_with(F.slice(ds, F.lit(1), F.size(ds) - 1), F.slice(ds, F.lit(2), F.size(ds) - 1), lambda a, b: (a < b).cast("double")))
    return base + step * F.coalesce(F.aggregate(nxt, F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0))


#: Multipliers of harshness, injustice, stress and vindictiveness: a sum of 1 and these terms.
def personal_multipliers(age: Column, city: Column, marital: Column, cars: Column, children: Column, home: Column, branch: Column, job: Column) -> dict[str, Column]:
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    aged = (age - 55.0) / 55.0 * 0.3
    return {
        "harshness": 1.0 + add(job == 4, 0.4),
        "injustice": 1.0 + add(branch == 1, 0.2),
        "stress": 1.0 - aged - (city - 2.5) / 1.5 * 0.3 + add(marital == 4, 0.3) - add(cars == 2, 0.2) + children * 0.05 - add(home == 1, 0.2) - add(branch == 2, 0.2),
        "vindictiveness": 1.0 - aged - add(marital == 4, 0.3) + add(marital == 2, 0.5) - children * 0.05 - add(home == 3, 0.2) - add(job == 4, 0.1),
    }


#: Cost and harshness of an action digit; injustice of a digit in a stage; actions a stage allows.
ACTION_COST = {"0": 0.0, "1": 5.0, "2": 15.0, "3": 30.0}
ACTION_HARSHNESS = {"0": 0.0, "1": 0.1, "2": 0.3, "3": 0.5}
INJUSTICE = {(1, "1"): 0.1, (1, "2"): 0.3, (1, "3"): 0.5, (2, "2"): 0.1, (2, "3"): 0.3, (3, "2"): 0.1, (3, "3"): 0.2, (4, "3"): 0.2, (5, "3"): 0.1, (7, "1"): 0.05, (7, "2"): 0.25, (7, "3"): 0.45}
ALLOWED = {1: ["0"], 2: ["0", "1", "11", "12", "122", "333"], 3: ["0", "1", "2", "22", "222", "333"], 4: ["0", "2", "3", "22", "222", "333"], 5: ["0", "2", "3", "32", "322", "333"], 6: ["0", "2", "3", "33", "332", "333"], 7: ["0"], 8: ["0"]}


def reaction_probability(stress: Column, vindictiveness: Column, harshness: Column, injustice_: Column) -> Column:
    return clip(0.7 - 0.1 * F.abs(stress - 3) - 0.1 * vindictiveness + 0.5 * harshness - 0.2 * injustice_, 0.0, 1.0)


def action_allowed(stage: Column, action: Column, allowed: Mapping[int, list[str]]) -> Column:
    e = F.lit(False)
    for s, actions in allowed.items():
        e = F.when(stage == s, action.isin(actions)).otherwise(e)
    return e


def linear_score(weights: Mapping[str, float], intercept: float = 0.0) -> Column:
    """Weighted sum of columns, nulls counting 0."""
    e = F.lit(float(intercept))
    for c, w in weights.items():
        e = e + w * F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return e


def tier_label(x: Column, steps: list[tuple[float, str]], top: str) -> Column:
    """Label of the first bound that x stays below."""
    e = F.lit(top)
    for bound, label in reversed(steps):
        e = F.when(x < bound, label).otherwise(e)
    return e
