"""Selection, default models and calibration with pyspark.ml."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression, IsotonicRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearium.functions.scalars import logit
from arrearium.sources.shared import durable

from .audits import top_values
from .batch_fits import Fit, fit_all, scales_of
from .metrics import above, correlation, discrimination, screen


def balanced_weights(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """n / (2 * n of the class) as a column."""
    n, p = df.agg(F.count("*"), F.sum(y)).first()  # two numbers
    half = lambda k: n / (2.0 * k) if k else 0.0
    return df.withColumn(out, F.when(F.col(y) == 1, half(p)).otherwise(half(n - (p or 0))))


def _stages(numeric: list[str], categorical: list[str]) -> list:
    imputed = [f"{c}__i" for c in numeric]
    stages: list = [Imputer(inputCols=numeric, outputCols=imputed, strategy="median")] if numeric else []
    stages += [StringIndexer(inputCol=c, outputCol=f"{c}__k", handleInvalid="keep") for c in categorical]
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"{c}__k" for c in categorical], outputCols=[f"{c}__h" for c in categorical]))
    stages.append(VectorAssembler(inputCols=imputed + [f"{c}__h" for c in categorical], outputCol="__raw", handleInvalid="keep"))
    return [*stages, StandardScaler(inputCol="__raw", outputCol="features", withMean=True)]


def fit_logit(df: DataFrame, numeric: list[str], categorical: list[str], y: str, l1: bool = False, reg: float = 0.0, weight: str | None = None) -> PipelineModel:
    """Median imputation, one-hot coding, scaling and a logistic regression; with l1, a selecting one."""
    lr = LogisticRegression(labelCol=y, regParam=reg, elasticNetParam=1.0 if l1 else 0.0, maxIter=50)
    return Pipeline(stages=[*_stages(numeric, categorical), lr.setWeightCol(weight) if weight else lr]).fit(df)


def fit_boosting(df: DataFrame, numeric: list[str], y: str, validation: str | None = None, trees: int = 40, depth: int = 4, seed: int = 42) -> PipelineModel:
    """Gradient boosting, stopping early on the rows flagged for validation."""
    gbt = GBTClassifier(labelCol=y, maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[*_stages(numeric, []), gbt.setValidationIndicatorCol(validation) if validation else gbt]).fit(df)


def random_search(df: DataFrame, numeric: list[str], y: str, key: str = "aid", tries: int = 5, seed: int = 42) -> tuple[PipelineModel, list[dict]]:
    """Boosting parameters drawn at random, chosen by area under the curve on a held-out share."""
    import random

    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rnd, done = random.Random(seed), []
    train, held = df.filter(hashed_share(key, seed) < 0.7), df.filter(hashed_share(key, seed) >= 0.7)
    best = None
    for _ in range(tries):
        p = {"trees": rnd.choice([10, 20, 40]), "depth": rnd.choice([2, 3, 4, 5])}
        m = fit_boosting(train, numeric, y, **p)
        area = BinaryClassificationEvaluator(labelCol=y).evaluate(m.transform(held))
        done.append(p | {"auc": area})
        if best is None or area > best[0]:
            best = (area, m)
    return best[1], done


def probability(scored: DataFrame, out: str = "pd") -> DataFrame:
    return scored.withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction", "features", "__raw")


def coefficients(model: PipelineModel, numeric: list[str]) -> list[tuple[str, float]]:
    lr = model.stages[-1]
    return sorted(zip(numeric, map(float, lr.coefficients.toArray())), key=lambda x: -abs(x[1]))


def selected(model: PipelineModel, numeric: list[str], eps: float = 1e-9) -> list[str]:
    return [c for c, b in coefficients(model, numeric) if abs(b) > eps]


def importances(model: PipelineModel, numeric: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(numeric, map(float, model.stages[-1].featureImportances.toArray())), key=lambda x: -x[1])


def fit_with_p_values(df: DataFrame, numeric: list[str], y: str, most: float = 0.05) -> tuple[list[str], list[float]]:
    """Binomial regression; features at or above the p-value leave and the rest is fitted again."""
    kept = list(numeric)
    while True:
        data = VectorAssembler(inputCols=kept, outputCol="features").transform(df.na.drop(subset=kept))
        m = GeneralizedLinearRegression(family="binomial", labelCol=y).fit(data)
        p = list(m.summary.pValues)[: len(kept)]
        out = [c for c, v in zip(kept, p) if v < most]
        if len(out) == len(kept) or not out:
            return kept, p
        kept = out


def vif(df: DataFrame, numeric: list[str]) -> list[tuple[str, float]]:
    """Variance inflation 1 / (1 - R2) of each feature on the others, from the correlation matrix; infinite for exact copies."""
    import numpy as np

    data = VectorAssembler(inputCols=numeric, outputCol="v", handleInvalid="skip").transform(df)
    m = Correlation.corr(data, "v").first()[0].toArray()
    out = []
    for j, c in enumerate(numeric):
        rest = [i for i in range(len(numeric)) if i != j]
        left = 1 - float(m[rest, j] @ np.linalg.pinv(m[np.ix_(rest, rest)]) @ m[rest, j])
        out.append((c, 1 / left if left > 1e-15 else float("inf")))
    return out


def greedy_decorrelate(pairs: list[tuple[str, str, float]], order: list[str], most: float = 0.99) -> list[str]:
    """Walk features by preference and leave out those too correlated with one kept before."""
    high = {frozenset((a, b)) for a, b, r in pairs if r is not None and abs(r) >= most}
    kept: list[str] = []
    for c in order:
        if not any(frozenset((c, k)) in high for k in kept):
            kept.append(c)
    return kept


def hashed_share(key: str, seed: int = 42) -> Column:
    """Reproducible number in [0, 1) of a row's key, for splits that don't depend on the partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) / float(1 << 52)


def stratified_sample(df: DataFrame, y: str, key: str, rows: int, seed: int = 42) -> DataFrame:
    """About `rows` rows with the classes in proportion: a stated sample for fits that take one."""
    n = df.count()
    return df if n <= rows else df.filter(hashed_share(key, seed) < rows / n)


def prescreen(df: DataFrame, features: list[str], y: str, key: str, max_null: float = 0.5, max_top: float = 0.95, min_gini: float = 0.02, max_gap: float = 0.2, most: float = 0.99, drop: tuple[str, ...] = ()) -> DataFrame:
    """Selection on the training rows: feature, null_share, top_share, gini and gini_held (70/30 by key), reason of leaving or null.

    A feature leaves by the first of: listed, nulls, one value's share, weak, unstable, correlated with a stronger one.
    """
    held = hashed_share(key) >= 0.7
    info = screen(df, features, y, ~held, max_null, min_gini, max_gap).select("feature", "null_share", F.col("gini_train").alias("gini"), F.col("gini_oot").alias("gini_held"))
    info = info.join(top_values(df, features).select(F.col("column_name").alias("feature"), F.col("share").alias("top_share")), "feature")
    reason = (
        F.when(F.col("feature").isin(*drop) if drop else F.lit(False), "listed").when(F.col("null_share") > max_null, "nulls").when(F.col("top_share") >= max_top, "one_value")
        .when(F.coalesce(F.col("gini") < min_gini, F.lit(True)), "weak").when(F.coalesce(F.abs(F.col("gini") - F.col("gini_held")) > max_gap, F.lit(True)), "unstable")
    )
    info = info.withColumn("reason", reason)
    rows = info.collect()  # a row for each feature
    order = [r["feature"] for r in sorted((r for r in rows if r["reason"] is None), key=lambda r: (-r["gini"], r["feature"]))]
    pairs = [(r["a"], r["b"], r["corr"]) for r in correlation(df, order).collect()] if len(order) > 1 else []
    kept = greedy_decorrelate(pairs, order, most)
    gone = [c for c in order if c not in kept]
    return info.withColumn("reason", F.when(F.col("feature").isin(*gone), "correlated").otherwise(F.col("reason"))) if gone else info


def lasso_runs(df: DataFrame, numeric: list[str], y: str, key: str, regs: list[float], seeds: list[int], rows: int = 100_000) -> DataFrame:
    """(run, reg, seed, feature) of the features that an L1 logit keeps, for each strength and sample; all runs share their scans."""
    n = df.count()
    drawn = lambda seed: (hashed_share(key, seed) < min(rows / max(n, 1), 1.0) * 0.8).cast("double")
    fits = [(reg, seed, Fit(f"reg {reg}, seed {seed}", drawn(seed), numeric, float(reg))) for seed in seeds for reg in regs]
    fit_all(df, [f for _, _, f in fits], y)
    found = [(f.name, float(reg), int(seed), c) for reg, seed, f in fits for c in f.selected()]
    return df.sparkSession.createDataFrame(found, "run string, reg double, seed int, feature string")


def refit_by(df: DataFrame, numeric: list[str], y: str, group: str, levels: list, l2: float = 0.001) -> DataFrame:
    """group, feature, coefficient, pooled, flipped, ratio: fits of each group against the pooled one, all in the same scans.

    Coefficients are those of features standardised over all groups; one-class groups are left out.
    """
    sizes = {r[0]: (r[1], r[2]) for r in df.filter(F.col(group).isin(levels)).groupBy(group).agg(F.count(y), F.sum(y)).collect()}
    usable = [v for v in levels if v in sizes and 0 < (sizes[v][1] or 0) < sizes[v][0]]
    fits = [Fit("pooled", F.lit(1.0), numeric, 0.0, l2), *[Fit(str(v), (F.col(group) == v).cast("double"), numeric, 0.0, l2) for v in usable]]
    fit_all(df, fits, y)
    pooled = fits[0].coefficients
    rows = [(f.name, c, b, pooled[c], pooled[c] * b < 0, abs(b / pooled[c]) if pooled[c] else None) for f in fits[1:] for c, b in f.coefficients.items()]
    return df.sparkSession.createDataFrame(rows, "group string, feature string, coefficient double, pooled double, flipped boolean, ratio double")


def ablation(train: DataFrame, held: DataFrame, families: dict[str, list[str]], y: str, l1: float = 0.002, l2: float = 0.001) -> DataFrame:
    """without, n_features, n_selected, gini_train, gini_held, loss: selection and fit again without one family after the other.

    Two batches of fits: lassos that select for every case, then the fits on what each selected. All cases are scored and
    judged in one pass of each part.
    """
    cases = {name or "nothing": [c for k, cs in families.items() if k != name for c in cs] for name in ["", *families]}
    cases = {k: v for k, v in cases.items() if v}
    scales = scales_of(train, sorted({c for v in cases.values() for c in v}))
    chosen = fit_all(train, [Fit(k, F.lit(1.0), v, l1) for k, v in cases.items()], y, scales)
    last = fit_all(train, [Fit(f.name, F.lit(1.0), f.selected() or list(cases[f.name]), 0.0, l2) for f in chosen], y, scales)
    gini: dict[tuple[str, int], float] = {}
    for i, part in enumerate((train, held)):
        scored = part.select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(f.name).alias("case"), f.score(scales).alias("p")) for f in last])).alias("e")).select("y", "e.case", "e.p")
        gini |= {(r["case"], i): r["gini"] or 0.0 for r in discrimination(scored, "p", "y", ["case"]).collect()}
    base = gini.get(("nothing", 1), 0.0)
    out = [(f.name, len(cases[f.name]), len(f.features), gini.get((f.name, 0), 0.0), gini.get((f.name, 1), 0.0), base - gini.get((f.name, 1), 0.0)) for f in last]
    return train.sparkSession.createDataFrame(out, "without string, n_features int, n_selected int, gini_train double, gini_held double, loss double")


def fit_platt(df: DataFrame, score: str, y: str, on_logit: bool = True) -> tuple[float, float]:
    """Slope and intercept of a logistic recalibration."""
    x = logit(F.col(score)) if on_logit else F.col(score)
    data = VectorAssembler(inputCols=["__x"], outputCol="features").transform(df.withColumn("__x", x))
    m = LogisticRegression(labelCol=y, regParam=0.0).fit(data)
    return float(m.coefficients[0]), float(m.intercept)


def apply_platt(df: DataFrame, score: str, fitted: tuple[float, float], out: str, on_logit: bool = True) -> DataFrame:
    x = logit(F.col(score)) if on_logit else F.col(score)
    return df.withColumn(out, 1 / (1 + F.exp(-(fitted[0] * x + fitted[1]))))


def isotonic(df: DataFrame, score: str, y: str, out: str, fit: DataFrame | None = None) -> DataFrame:
    """Monotone recalibration, fitted on `fit` or on `df` itself; scores outside get the nearest value."""
    m = IsotonicRegression(labelCol=y, featuresCol=score, predictionCol=out).fit(df if fit is None else fit)
    return m.transform(df)


def perturb_to_gini(df: DataFrame, score: str, y: str, key: str, target: float, seed: int = 42, rounds: int = 4, at_once: int = 8) -> DataFrame:
    """Scores blurred on the logit scale until their Gini falls to the target, shifted back to the mean.

    The noise column is fixed by the row's key; only scale and shift are searched, many candidates in each pass. A pass
    counts scores in bins; it orders the scores of a candidate only if its bins leave open on which side of the target it is.
    """
    u = lambda s: (F.pmod(F.xxhash64(F.lit(s), F.col(key)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    z = F.sqrt(-2 * F.log(u(seed))) * F.cos(2 * F.pi() * u(seed + 1))
    base = df.withColumn("__z", z).withColumn("__l", logit(F.col(score)))
    base = durable(base)  # read by every pass of the search
    low, high = 0.0, 8.0
    for _ in range(rounds):
        scales = [low + (high - low) * i / at_once for i in range(1, at_once)]
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), (F.col("__l") + s * F.col("__z")).alias("s")) for i, s in enumerate(scales)])).alias("e")
        found = above(base.select(F.col(y).alias("y"), cells).select("y", "e.i", "e.s"), "s", "y", "i", target)
        larger = [s for i, s in enumerate(scales) if found.get(i)]
        low, high = max(larger, default=low), min((s for s in scales if s > max(larger, default=low)), default=high)
    scale = (low + high) / 2
    p = lambda shift: 1 / (1 + F.exp(-(F.col("__l") + scale * F.col("__z") + shift)))
    mean = base.agg(F.avg(score)).first()[0]
    a, b = -10.0, 10.0
    for _ in range(rounds if mean is not None else 0):
        shifts = [a + (b - a) * i / 32 for i in range(1, 32)]
        means = base.agg(*[F.avg(p(x)) for x in shifts]).first()
        a, b = max((x for x, m in zip(shifts, means) if m < mean), default=a), min((x for x, m in zip(shifts, means) if m >= mean), default=b)
    return base.withColumn(f"{score}_perturbed", p((a + b) / 2)).drop("__z", "__l")
