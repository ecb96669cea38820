"""Queries that fit models: selection, default models, calibration and their diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearium.operators import batch_fits, metrics, models

from .queries_scores import _NUMERIC, _model_rows
from .registry import query, rounded

FAMILIES = {"due": ["due_mean_3", "due_max_6"], "days": ["days_mean_6", "days_max_3"], "application": ["loan_amount", "income"]}


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _model_rows(spark, sf).withColumns({c: F.col(c).cast("double") for c in _NUMERIC})
    return rows.filter("split = 'train'"), rows.filter("split = 'oot'")


@query()
def prescreened_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.prescreen(_parts(spark, sf)[0], _NUMERIC, "y", "aid", drop=("income",)))


@query()
def lasso_stability(spark: SparkSession, sf: str) -> DataFrame:
    """How alike the selections of an L1 logit are, over strengths and samples."""
    runs = models.lasso_runs(_parts(spark, sf)[0], _NUMERIC, "y", "aid", [0.001, 0.01, 0.03], [1, 2, 3])
    return rounded(metrics.jaccard(runs, "run", "feature"))


@query()
def lasso_cv_path(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out loss of five penalties in five folds, and what each keeps on all rows; thirty fits in common scans."""
    train, _ = _parts(spark, sf)
    fold = F.floor(models.hashed_share("aid", 7) * 5).cast("int")
    loss, whole = batch_fits.lasso_path_cv(train, _NUMERIC, "y", fold, 5, [0.001, 0.003, 0.01, 0.03, 0.1])
    return rounded(spark.createDataFrame([(f.l1, loss[f.l1], len(f.selected()), ",".join(sorted(f.selected()))) for f in whole], "l1 double, held_out_loss double, n_selected int, selected string"), 5)


@query()
def logit_inference(spark: SparkSession, sf: str) -> DataFrame:
    """p-values of the features that a binomial regression keeps, with their variance inflation."""
    train, _ = _parts(spark, sf)
    kept, p = models.fit_with_p_values(train, _NUMERIC, "y")
    inflation = dict(models.vif(train, kept))
    return rounded(spark.createDataFrame([(c, float(v), inflation[c]) for c, v in zip(kept, p)], "feature string, p_value double, vif double"))


@query()
def model_comparison_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """Logit with balanced weights, boosting chosen by random search, and both recalibrated: metrics by split."""
    train, held = _parts(spark, sf)
    rows = models.balanced_weights(train, "y").unionByName(models.balanced_weights(held, "y"))
    weighted = rows.filter("split = 'train'")
    logit = models.fit_logit(weighted, _NUMERIC, [], "y", reg=0.001, weight="weight")
    boosted, _ = models.random_search(weighted, _NUMERIC, "y", tries=2)
    keep = ["aid", "split", "y"]
    a = models.probability(logit.transform(rows), "logit").select(*keep, "logit")
    b = models.probability(boosted.transform(rows), "boosting").select("aid", "boosting")
    both = models.durable(a.join(b, "aid"))
    fit = both.filter("split = 'train'")
    both = models.apply_platt(both, "boosting", models.fit_platt(fit, "boosting", "y"), "boosting_platt")
    both = models.isotonic(both, "logit", "y", "logit_isotonic", fit=fit)
    return rounded(metrics.comparison(both, ["logit", "logit_isotonic", "boosting", "boosting_platt"], "y", ["split"]))


@query()
def tenor_refits(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients by tenor against the pooled fit, with flipped signs."""
    return rounded(models.refit_by(_parts(spark, sf)[0], _NUMERIC, "y", "n_installments", [12, 24, 36]))


@query()
def family_ablation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(models.ablation(*_parts(spark, sf), FAMILIES, "y"))
