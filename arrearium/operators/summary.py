"""The base table's summary: 96 window statistics, arrears counters and two scores of every active account-month.

Three passes read the account-months, each task's in the order of customer, account and month: one adds up means and
deviations of each month, one those of the scores, and the last one gives the rows. A part of a pass holds whole customers,
so their months are neither sorted, windowed nor written.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearium.functions.periods import date_of_period
from arrearium.functions.scalars import ACTIVE, age_at

from .base_table import APPLICATION_WEIGHTS, BEHAVIOUR_WEIGHTS, COLUMNS, RENAMED
from .panel import LENGTHS, STATISTICS, VARIABLES
from .whole_abt import READ, _account_series, _customer_series, customers, in_order, packed
from .wide import nearest as _nearest

#: Months that a counter looks at, and the counters.
COUNTED_MONTHS = 12
COUNTERS = [f"act{COUNTED_MONTHS}_{k}" for k in ("n_arrears", "n_arrears_days", "n_good_days", "n_cus_arrears")]
WINDOWS = [f"{g}{n}_{s}_{v}" for n in LENGTHS for v in VARIABLES for s in STATISTICS for g in ("agr", "ags")]
SCORES = ["score", "scorem"]
_PLAIN = ["status", "coll_status", "fin_period", "act_seniority", "act_age"]
_RATIOS = {"act_utl", "act_dueutl", "act_cc", "act_dueinc", "act_loaninc", "act_cus_utl", "act_cus_dueutl", "act_cus_cc"}

#: month -> (counts, sums, means, sums of squared deviations) of each column. Means lie in the values' range, so columns that
#: don't vary have no deviation at all; sums of whole numbers are exact.
Moments = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _windows(values: Mapping[str, np.ndarray], account: np.ndarray, number: np.ndarray, wanted: set[str]) -> dict[str, np.ndarray]:
    """The `wanted` of WINDOWS and COUNTERS of rows in the order of account and month; missing values are NaN."""
    n = len(number)
    back = [(np.ones(n, bool), np.zeros(n))]
    for j in range(1, max(*LENGTHS, COUNTED_MONTHS)):
        same = np.zeros(n, bool)
        gap = np.zeros(n)
        same[j:], gap[j:] = account[j:] == account[:-j], number[j:] - number[:-j]
        back.append((same, gap))

    def shifted(v: np.ndarray, j: int, fill: float) -> np.ndarray:
        return v if not j else np.concatenate([np.full(min(j, n), fill), v[:-j]])

    out: dict[str, np.ndarray] = {}
    for v in VARIABLES:
        kinds = {s for s in STATISTICS for g in ("agr", "ags") for m in LENGTHS if f"{g}{m}_{s}_{v}" in wanted}
        if not kinds:
            continue
        x, known = values[v], ~np.isnan(values[v])
        count, total, most, least, done = np.zeros(n, int), np.zeros(n), np.full(n, np.nan), np.full(n, np.nan), 0
        for m in LENGTHS:
            for j in range(m):  # a row j before lies at least j months back: the shorter lengths took those that were near
                same, gap = back[j]
                inside = same & (gap >= done) & (gap < m)
                if not inside.any():
                    continue
                inside &= shifted(known, j, False).astype(bool)
                value = np.where(inside, shifted(x, j, 0.0), np.nan)
                count += inside
                if "Mean" in kinds:
                    total += np.where(inside, value, 0.0)
                if "Max" in kinds:
                    most = np.fmax(most, value)
                if "Min" in kinds:
                    least = np.fmin(least, value)
            done = m
            for s, made in (("Mean", lambda: np.divide(total, count, out=np.full(n, np.nan), where=count > 0)), ("Max", lambda: most), ("Min", lambda: least)):
                if {f"agr{m}_{s}_{v}", f"ags{m}_{s}_{v}"} & wanted:
                    found = made()
                    out[f"agr{m}_{s}_{v}"], out[f"ags{m}_{s}_{v}"] = found, np.where(count >= m, found, np.nan)
    marks = {"n_arrears": values["Due"] >= 1, "n_arrears_days": values["Days"] > 15, "n_good_days": (values["Days"] > 0) & (values["Days"] < 15), "n_cus_arrears": values["CMax_Due"] >= 1}
    for k, mark in marks.items():
        if f"act{COUNTED_MONTHS}_{k}" in wanted:
            out[f"act{COUNTED_MONTHS}_{k}"] = sum((shifted(mark, j, False).astype(bool) & same & (gap < COUNTED_MONTHS) for j, (same, gap) in enumerate(back[:COUNTED_MONTHS])), np.zeros(n))
    return out


def _active(table: pa.Table, wanted: set[str]) -> tuple[np.ndarray, dict[str, np.ndarray]] | None:
    """Places of the active rows of `table`, whole customers, and their columns: those of the base table and the `wanted`."""
    x = {c: table.column(c).cast(pa.float64(), safe=False).to_numpy() for c in table.column_names if c not in ("cid", "aid")}
    later, new = in_order(table)
    rows = np.flatnonzero(x["status"] == ACTIVE)
    if not len(rows):
        return None
    starts = np.concatenate([[0], np.flatnonzero(new) + 1])
    account, customer = np.cumsum(np.concatenate([[0], new])), np.cumsum(np.concatenate([[0], later]))
    x["m"] = x["act_seniority"] = x["month_no"] - (np.floor(x["fin_period"] / 100) * 12 + x["fin_period"] % 100) + 1
    out = {c: v[rows] for c, v in _account_series(x).items()} | _customer_series(x, starts, account, rows, customer)
    out |= {c: x[c][rows] for c in (*_PLAIN, "period")} | {c: x[v][rows] for c, v in RENAMED.items()}
    return rows, out | _windows(out, account[rows], x["month_no"][rows], wanted)


def _add(a: Moments, b: Moments) -> Moments:
    n = a[0] + b[0]
    share, gap = np.divide(b[0], n, out=np.zeros(n.shape), where=n > 0), b[2] - a[2]
    mean = np.where(a[0] == 0, b[2], np.where(b[0] == 0, a[2], a[2] + gap * share))
    return n, a[1] + b[1], mean, a[3] + b[3] + np.where((a[0] > 0) & (b[0] > 0), gap * gap * a[0] * share, 0.0)


def _moments(period: np.ndarray, columns: Sequence[np.ndarray]) -> dict[int, Moments]:
    order = np.argsort(period, kind="stable")
    heads = np.flatnonzero(np.diff(period[order], prepend=-1))
    sizes = np.diff([*heads, len(order)])
    parts = []
    for c in columns:
        v = c[order]
        known = ~np.isnan(v)
        n, total = np.add.reduceat(known.astype(float), heads), np.add.reduceat(np.where(known, v, 0.0), heads)
        least = np.nan_to_num(np.fmin.reduceat(v, heads))
        off = np.where(known, v - np.repeat(least, sizes), 0.0)
        first = np.divide(np.add.reduceat(off, heads), n, out=np.zeros(len(n)), where=n > 0)
        rest = np.where(known, off - np.repeat(first, sizes), 0.0)
        parts.append((n, total, least + first, np.add.reduceat(rest * rest, heads)))
    cells = np.stack([np.stack(p) for p in parts], axis=2)  # what, months, columns
    return {int(p): tuple(cells[:, i]) for i, p in enumerate(period[order][heads])}


def _by_month(rows: DataFrame, make, width: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and standard deviation (0 where there is none) by month of the columns that `make` gives of a part of a task.

    A task sends a row for each of its months, and the driver gets one for each month.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Moments] = {}
        for table in customers(unpacked(batches)):
            if (found := make(table)) is None:
                continue
            for p, x in _moments(*found).items():
                total[p] = _add(total[p], x) if p in total else x
        if total:
            yield pa.RecordBatch.from_pydict({"p": list(total), "x": [np.stack(x).tobytes() for x in total.values()]}, pa.schema([("p", pa.int32()), ("x", pa.binary())]))

    def added(part: pd.DataFrame) -> pd.DataFrame:
        out = None
        for b in part["x"]:
            x = tuple(np.frombuffer(b).reshape(4, width))
            out = x if out is None else _add(out, x)
        return pd.DataFrame({"p": [part["p"].iloc[0]], "x": [np.stack(out).tobytes()]})

    sent, unpacked = packed(rows)
    found = {}
    for r in sent.mapInArrow(sums, "p int, x binary").groupBy("p").applyInPandas(added, "p int, x binary").collect():
        n, total, _, squares = np.frombuffer(r["x"]).reshape(4, width)
        found[r["p"]] = np.divide(total, n, out=np.zeros(width), where=n > 0), np.sqrt(np.divide(squares, n - 1, out=np.zeros(width), where=n > 1))
    return found


def _standard(period: np.ndarray, columns: Sequence[np.ndarray], stats: Mapping[int, tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The columns standardised among the rows of their month; 0 where it doesn't vary, and for missing values."""
    months, at = np.unique(period.astype(int), return_inverse=True)
    means, spreads = (np.stack([stats[int(p)][i] for p in months]) for i in (0, 1))
    out = []
    for i, c in enumerate(columns):
        mean, spread = means[at, i], spreads[at, i]
        out.append(np.nan_to_num(np.divide(c - mean, spread, out=np.zeros(len(c)), where=spread > 0)))
    return out


def abt_summary(
    transactions: DataFrame, columns: Sequence[str] | None = None, weights: Mapping[str, float] = BEHAVIOUR_WEIGHTS, application: Mapping[str, float] = APPLICATION_WEIGHTS, digits: int | None = None,
) -> DataFrame:
    """COLUMNS of the base table, WINDOWS, COUNTERS and SCORES of every active account-month, or only `columns` of them.
    With `digits`, doubles are rounded in the task, where that takes a tenth of what expressions of each row do.

    `transactions` has the clients' columns, and each task's rows are in the order of customer, account and month.
    """
    wanted = [*COLUMNS, *WINDOWS, *COUNTERS, *SCORES] if columns is None else list(columns)
    used = sorted({*weights, *application, f"act{COUNTED_MONTHS}_n_cus_arrears"})
    age = age_at(F.col("date_of_birth"), date_of_period(F.col("period"))).alias("act_age")
    rows = transactions.filter("month_no is not null").select(*dict.fromkeys(["cid", "aid", "period", "fin_period", *READ, *RENAMED.values()]), age)
    kinds = dict(rows.dtypes)

    def scores(x: Mapping[str, np.ndarray], stats: Mapping[int, tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        z = dict(zip(used, _standard(x["period"], [x[c] for c in used], stats), strict=True))
        group = (x["app_nom_job_code"] == 4) & np.isin(x["app_nom_marital_status"], (2, 3))
        extra = np.where(group & (x["app_nom_gender"] == 1), -3.0, np.where(group & (x["app_nom_gender"] == 0), 2.0, 0.0))
        score = sum((w * z[c] for c, w in weights.items()), np.zeros(len(extra))) - z[f"act{COUNTED_MONTHS}_n_cus_arrears"] + extra + np.where(z["ags12_Max_CMax_Due"] == 0, 5.0, 0.0)
        return [score, sum((w * z[c] for c, w in application.items()), np.zeros(len(extra)))]

    needed = {*used, "ags12_Max_CMax_Due"}

    def first(table: pa.Table):
        found = _active(table, needed)
        return found and (found[1]["period"], [found[1][c] for c in used])

    stats = _by_month(rows, first, len(used)) if set(wanted) & set(SCORES) else {}

    def second(table: pa.Table):
        found = _active(table, needed)
        return found and (found[1]["period"], scores(found[1], stats))

    ends = _by_month(rows, second, 2) if stats else {}

    def kind(c: str) -> str:
        if c in SCORES or c in _RATIOS or "_Mean_" in c:
            return "double"
        return "bigint" if c in COUNTERS or c.startswith("act_cus_n_") else kinds.get(c, kinds.get(RENAMED.get(c, ""), "int"))

    schema = {c: kind(c) for c in wanted}
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    sent, unpacked = packed(rows)

    def column(c: str, x: np.ndarray) -> pa.Array:
        missing = np.isnan(x)
        if schema[c] == "double":
            return pa.array(x if digits is None else _nearest(x, digits), pa.float64(), mask=missing)
        return pa.array(np.where(missing, 0, x).astype(np.int32 if schema[c] == "int" else np.int64), arrow[schema[c]], mask=missing)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in customers(unpacked(batches)):
            if (found := _active(table, {*needed, *wanted})) is None:
                continue
            at, x = found
            if ends:
                x |= dict(zip(SCORES, _standard(x["period"], scores(x, stats), ends), strict=True))
            own = {c: table.column(c).take(pa.array(at)).combine_chunks() for c in ("cid", "aid") if c in wanted}
            yield pa.RecordBatch.from_pydict({c: own[c] if c in own else column(c, x[c]) for c in wanted})

    return sent.mapInArrow(made, ", ".join(f"`{c}` {k}" for c, k in schema.items()))
