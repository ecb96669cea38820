"""Many logistic fits at once from shared sufficient statistics.

A Newton step of a logit needs a gradient and a weighted Gram matrix, which are sums over rows. Tasks make these sums for
every fit that is still moving (folds, samples, groups, feature subsets, penalties), so a step of all fits is one scan, and
the number of scans is that of the slowest fit, not the sum over fits. Only features x features numbers for each fit reach
the driver, where ridge steps are solved and lasso steps go by coordinate descent on the quadratic model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearium.sources.shared import durable

from .wide import profiles

STEPS, TOLERANCE = 60, 1e-8


@dataclass
class Fit:
    """One fit: its rows (a weight expression, 0 leaves a row out), features, and penalties as in (1/2) l2 |b|^2 + l1 |b|.

    Penalties are per unit of weight, the intercept has none. Coefficients are those of the standardised features.
    """

    name: str
    weight: Column
    features: Sequence[str]
    l1: float = 0.0
    l2: float = 0.0
    intercept: float = 0.0
    coefficients: dict[str, float] = field(default_factory=dict)
    steps: int = 0
    rows: float = 0.0

    def selected(self, eps: float = 1e-9) -> list[str]:
        return [c for c, b in self.coefficients.items() if abs(b) > eps]

    def score(self, scales: dict[str, tuple[float, float, float]]) -> Column:
        """The fitted probability as an expression on the raw columns."""
        z = F.lit(self.intercept)
        for c, b in self.coefficients.items():
            if b:
                fill, mean, std = scales[c]
                z = z + b * (F.coalesce(F.col(c).cast("double"), F.lit(fill)) - mean) / std
        return 1 / (1 + F.exp(-z))


def scales_of(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """(median to fill nulls with, mean, standard deviation) of each feature after filling, two scans for all."""
    found = profiles(df, list(features), [0.5])
    fill = {c: found[c].quantiles[0] if found[c].n else 0.0 for c in features}
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.coalesce(F.col(c).cast("double"), F.lit(fill[c])).alias("v")) for i, c in enumerate(features)])).alias("x")
    stats = {r[0]: r for r in df.select(cells).groupBy("x.c").agg(F.avg("x.v"), F.stddev_samp("x.v")).collect()}  # a row for each feature
    return {c: (fill[c], stats[i][1], stats[i][2] or 1.0) if i in stats else (0.0, 0.0, 1.0) for i, c in enumerate(features)}


def _lasso_step(h: np.ndarray, g: np.ndarray, b: np.ndarray, l1: float, l2: float, sweeps: int = 500) -> np.ndarray:
    """argmin of the quadratic model plus penalties by coordinate descent; the first coefficient is the intercept."""
    b = b.copy()
    target = h @ b + g
    for _ in range(sweeps):
        most = 0.0
        for j in range(len(b)):
            free = target[j] - h[j] @ b + h[j, j] * b[j]
            new = free / h[j, j] if not j else np.sign(free) * max(abs(free) - l1, 0.0) / (h[j, j] + l2)
            most, b[j] = max(most, abs(new - b[j])), new
        if most < 1e-10:
            break
    return b


def fit_all(df: DataFrame, fits: list[Fit], y: str, scales: dict[str, tuple[float, float, float]] | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> list[Fit]:
    """Fits all of `fits` on the rows of `df` with a label; rows are written once, compactly, and scanned once a step."""
    features = sorted({c for f in fits for c in f.features})
    scales = scales or scales_of(df, features)
    standard = [((F.coalesce(F.col(c).cast("double"), F.lit(scales[c][0])) - scales[c][1]) / scales[c][2]) for c in features]
    rows = durable(df.filter(F.col(y).isNotNull()).select(F.array(F.lit(1.0), *standard).alias("x"), F.col(y).cast("double").alias("y"), F.array(*[F.coalesce(f.weight.cast("double"), F.lit(0.0)) for f in fits]).alias("w")))
    places = [np.array([0, *[features.index(c) + 1 for c in f.features]]) for f in fits]
    state = [np.zeros(len(p)) for p in places]
    moving = list(range(len(fits)))
    out = pa.schema([("f", pa.int32()), ("sums", pa.binary())])

    def scan(now: list[int], betas: list[np.ndarray]):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                x = batch.column("x").flatten().to_numpy().reshape(n, -1)
                w, t = batch.column("w").flatten().to_numpy().reshape(n, -1), batch.column("y").to_numpy()
                for k, b in zip(now, betas, strict=True):
                    use = w[:, k] != 0
                    if not use.any():
                        continue
                    part, weight = x[use][:, places[k]], w[use, k]
                    z = part @ b
                    p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                    g = part.T @ (weight * (t[use] - p))
                    h = (part * (weight * p * (1 - p))[:, None]).T @ part
                    loss = float((weight * (np.logaddexp(0, z) - t[use] * z)).sum())
                    total[k] = total.get(k, 0) + np.concatenate([[weight.sum(), loss], g, h.ravel()])
            if total:
                yield pa.RecordBatch.from_pydict({"f": list(total), "sums": [v.tobytes() for v in total.values()]}, out)

        def add(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"f": [part["f"].iloc[0]], "sums": [np.sum([np.frombuffer(s) for s in part["sums"]], axis=0).tobytes()]})

        made = rows.mapInArrow(sums, "f int, sums binary").groupBy("f").applyInPandas(add, "f int, sums binary")  # tasks x fits rows
        return {r["f"]: np.frombuffer(r["sums"]) for r in made.collect()}

    last: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}  # penalised loss, coefficients and step of the accepted point
    for _ in range(steps):
        found = scan(moving, [state[k] for k in moving])
        still = []
        for k in moving:
            f, size = fits[k], len(places[k])
            if k not in found:
                continue
            n, loss, g, h = found[k][0], found[k][1], found[k][2 : 2 + size], found[k][2 + size :].reshape(size, size)
            f.rows = float(n)
            b = state[k]
            value = loss / n + f.l1 * np.abs(b[1:]).sum() + f.l2 / 2 * (b[1:] ** 2).sum()
            if k in last and value > last[k][0] + 1e-12 and np.abs(last[k][2]).max() > tolerance:  # too far: half the step
                before, step = last[k][1], last[k][2] / 2
                last[k] = (last[k][0], before, step)
                state[k] = before + step
                still.append(k)
                continue
            f.steps += 1
            h, g = h / n + 1e-10 * np.eye(size), g / n
            if f.l1:
                new = _lasso_step(h, g, b, f.l1, f.l2)
            else:
                ridge = f.l2 * np.diag([0.0, *[1.0] * (size - 1)])
                new = b + np.linalg.solve(h + ridge, g - ridge @ b)
            step = new - b
            largest = np.abs(step).max()
            if largest > 5:  # separable rows run away; a bounded step keeps the loss finite
                step = step * (5 / largest)
            last[k] = (value, b, step)
            state[k] = b + step
            if np.abs(step).max() > tolerance:
                still.append(k)
        moving = still
        if not moving:
            break
    for f, b in zip(fits, state, strict=True):
        f.intercept, f.coefficients = float(b[0]), dict(zip(f.features, map(float, b[1:]), strict=True))
    return fits


def lasso_path_cv(df: DataFrame, features: Sequence[str], y: str, fold: Column, folds: int, l1s: Sequence[float], l2: float = 0.0, weight: Column | None = None) -> tuple[dict[float, float], list[Fit]]:
    """Mean held-out log loss of each penalty over the folds, and the fits on all rows; folds and penalties run together."""
    weight = F.lit(1.0) if weight is None else weight
    inside = [Fit(f"fold {i}, l1 {a}", F.when(fold != i, weight).otherwise(0.0), features, a, l2) for i in range(folds) for a in l1s]
    whole = [Fit(f"all, l1 {a}", weight, features, a, l2) for a in l1s]
    scales = scales_of(df, features)
    fit_all(df, inside + whole, y, scales)
    loss = {}
    cells = []
    for f, (i, a) in zip(inside, [(i, a) for i in range(folds) for a in l1s], strict=True):
        p = F.least(F.greatest(f.score(scales), F.lit(1e-15)), F.lit(1 - 1e-15))
        each = -F.when(F.col(y) == 1, F.log(p)).otherwise(F.log(1 - p))
        cells.append(F.struct(F.lit(float(a)).alias("a"), F.when(fold == i, weight).otherwise(0.0).alias("w"), each.alias("loss")))
    rows = df.filter(F.col(y).isNotNull()).select(F.explode(F.array(*cells)).alias("e"))
    for r in rows.groupBy("e.a").agg(F.sum(F.col("e.w") * F.col("e.loss")), F.sum("e.w")).collect():
        loss[r[0]] = r[1] / r[2] if r[2] else float("inf")
    return loss, whole
