"""Feature catalog with lineage: what a column is made of decides where it may be used.

Original columns are classified by name. A derived column names its sources, which may be derived themselves; it inherits
from all original columns that it comes from: a model may use it if it may use all of them, its risk is the highest, its
level the most restrictive. Profit is for loan terms, with or without application data. The catalog is a small table, one
row for each column; its filters and checks are DataFrame expressions on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The levels, most restrictive first, with what they stand for and what they allow
#: (origination model, behavioural model, profit), leakage risk, use of later behaviour, and reason.
LEVELS = {
    "A": ("target", False, False, False, "high", False, "target or outcome"),
    "D": ("aggregate behaviour", False, False, False, "high", True, "aggregate behavioral target-proxy"),
    "C": ("late behaviour", False, False, False, "high", True, "late behavioral source (m4-m12)"),
    "F": ("early behaviour", False, True, False, "medium", True, "early behavioral source (m1-m3)"),
    "E": ("loan terms", False, False, True, "medium", False, "loan-term artifact; profit input, not a predictor"),
    "B": ("metadata", False, False, False, "low", False, "ID/metadata column, not a predictor"),
    "G": ("application", True, True, False, "low", False, ""),
    "H": ("random", True, True, False, "low", False, ""),
}
#: Names of targets, metadata, aggregates and loan terms, and prefixes of late summaries.
TARGETS = r"^(default|writeoff|write_off|bad_flag|target|y_true$|y$|label$)"
METADATA = {"aid", "cid", "fin_period", "obs_period", "observation_id", "client_id", "account_id", "application_id", "snapshot_date", "date", "scenario", "seed", "split", "sample", "dataset_split", "partition", "observation_status"}
PROXIES = {"max_due", "max_coll_status", "trend_due", "months_ever_due", "months_coll_2plus", "paid_fraction_at_obs"}
LOAN_TERMS = {"loan_amount", "app_loan_amount", "n_installments", "app_n_installments", "installment", "principal", "term", "tenor"}
SUMMARIES = ("agr6_", "ags6_", "agr12_", "ags12_")
MONTHLY = r"^(?:(?:act|coll|due|paid)_.*)_m(\d+)$"
FIELDS = (
    "feature_name string, feature_family string, source_columns string, formula string, description string, availability_time string, source_window string, uses_target boolean, "
    "uses_future_behavior boolean, allowed_for_origination_pd boolean, allowed_for_behavioral_pd boolean, allowed_for_profit boolean, leakage_risk string, reason_if_not_allowed_for_pd string"
)
LOAN_TERM_WORDS = ("loan_amount", "n_installments", "installment", "principal", "term", "tenor")


@dataclass(frozen=True)
class Derived:
    """A derived column: its family, the columns it is made of, and how."""

    name: str
    family: str
    sources: tuple[str, ...]
    formula: str


def original(column: str) -> tuple[str, str, str]:
    """(family, level, window) of an original column by its name."""
    if re.match(TARGETS, column):
        return "ORIGINAL_TARGET", "A", "metadata"
    if column in METADATA:
        return "ORIGINAL_METADATA", "B", "metadata"
    if column in PROXIES:
        return "ORIGINAL_BEHAVIORAL", "D", "m1-m12"
    if column.startswith(SUMMARIES):
        return "ORIGINAL_BEHAVIORAL", "C", "m1-m6" if column[3:5] == "6_" else "m1-m12"
    if month := re.match(MONTHLY, column):
        return "ORIGINAL_BEHAVIORAL", "F" if int(month[1]) <= 3 else "C", f"m{int(month[1])}"
    if column in LOAN_TERMS:
        return "ORIGINAL_LOAN", "E", "static"
    if column == "act_age" or column.startswith("app_"):
        return "ORIGINAL_APP", "G", "static"
    return "ORIGINAL_OTHER", "B", "metadata"


def lineage(columns: Iterable[str], derived: Iterable[Derived]) -> dict[str, frozenset[str]]:
    """The original columns that each column comes from; unknown sources and circles are errors."""
    own, made = set(columns), {d.name: d for d in derived}
    out: dict[str, frozenset[str]] = {c: frozenset([c]) for c in own}
    for name in made:
        stack = [(name, iter(made[name].sources))]
        open_ = {name}
        roots: dict[str, set[str]] = {name: set()}
        while stack:
            at, rest = stack[-1]
            if at in out:
                stack.pop()
                open_.discard(at)
                continue
            source = next(rest, None)
            if source is None:
                out[at] = frozenset(roots[at])
                stack.pop()
                open_.discard(at)
                if stack:
                    roots[stack[-1][0]] |= out[at]
            elif source in out:
                roots[at] |= out[source]
            elif source in open_:
                raise ValueError(f"{source} is made of itself")
            elif source in made:
                stack.append((source, iter(made[source].sources)))
                open_.add(source)
                roots[source] = set()
            else:
                raise ValueError(f"{at} is made of {source}, which isn't known")
    return out


def level_of(roots: Iterable[str]) -> str:
    """The most restrictive level among original columns; H without any."""
    order = list(LEVELS)
    return min((original(c)[1] for c in roots), key=order.index, default="H")


def catalog(spark: SparkSession, columns: list[str], derived: list[Derived]) -> DataFrame:
    """FIELDS of every original and derived column."""
    roots, made = lineage(columns, derived), {d.name: d for d in derived}
    rows = []
    for name in [*columns, *made]:
        level = level_of(roots[name])
        every = sorted({original(c)[1] for c in roots[name]} or {"H"}, key=list(LEVELS).index)
        pd_, behaviour, profit = all(LEVELS[k][1] for k in every), all(LEVELS[k][2] for k in every), "E" in every and set(every) <= set("EGH")
        risk, later = max((LEVELS[k][4] for k in every), key=("low", "medium", "high").index), any(LEVELS[k][5] for k in every)
        reason = "; ".join(LEVELS[k][6] for k in every if LEVELS[k][6])
        windows = sorted({original(c)[2] for c in roots[name]} - {"static"}) or ["random" if level == "H" else "static"]
        time = "metadata" if level in "AB" else "post-origination" if later else "origination"
        if name in made:
            d = made[name]
            family, sources, formula, text = d.family, ",".join(d.sources) or "(noise only)", d.formula, f"{d.formula} (level {level}, {LEVELS[level][0]})"
        else:
            family, sources, formula, text = original(name)[0], name, "raw column", f"original column ({LEVELS[level][0]})"
        rows.append((name, family, sources, formula, text, time, ",".join(windows), "A" in every, later, pd_, behaviour, profit, risk, reason))
    return spark.createDataFrame(rows, FIELDS)


def eligible() -> Column:
    """Whether a catalog row may be used in the origination model."""
    return F.col("allowed_for_origination_pd") & (F.col("leakage_risk") != "high") & ~F.col("uses_target") & ~F.col("uses_future_behavior")


def family_summary(cat: DataFrame) -> DataFrame:
    return cat.groupBy("feature_family").agg(F.count("*").alias("n"), F.count_if(eligible()).alias("n_eligible"))


def guard(name: str, sources: Iterable[str], allowed: str = "BGH") -> None:
    """Refuse a source whose level isn't allowed for a feature that must be free of loan terms and behaviour."""
    for s in sources:
        if original(s)[1] not in allowed:
            raise ValueError(f"{name} must not be made of {s} (level {original(s)[1]})")


def checks(df: DataFrame, cat: DataFrame, expected_rows: int, synthetic: str = "synth_") -> DataFrame:
    """check_name, value, ok of a feature table against its catalog: rows, infinities, completeness, one target, sources.

    Rows and infinities are counted by the tasks in one pass, in which the feature table may be made.
    """
    spark = df.sparkSession
    numeric = [c for c, kind in df.dtypes if kind in ("double", "float")]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, 0
        for batch in batches:
            n, found = n + batch.num_rows, found + int(np.isinf(batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)).sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "found": [found]})

    cells = F.array(*[F.col(c).cast("double") for c in numeric]) if numeric else F.array().cast("array<double>")
    counts = df.select(cells.alias("x")).mapInArrow(counted, "n bigint, found bigint").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("found"), F.lit(0)))
    n, infinite = counts.first()
    names = spark.createDataFrame([(c,) for c in df.columns], "feature_name string")
    missing, extra = names.join(cat, "feature_name", "left_anti").count(), cat.join(names, "feature_name", "left_anti").count()
    terms = F.lit(False)
    for word in LOAN_TERM_WORDS:
        terms = terms | F.contains(F.lower("source_columns"), F.lit(word))
    one = cat.agg(F.count_if("uses_target"), F.count_if(eligible() & terms & ~F.startswith("feature_name", F.lit(synthetic)))).first()
    scores = sum(c.lower() in ("score", "scorem") for c in df.columns)
    rows = [
        ("row_count_unchanged", n, n == expected_rows), ("no_infinities", infinite, infinite == 0), ("columns_in_catalog", missing, missing == 0), ("catalog_in_columns", extra, extra == 0), ("one_target", one[0], one[0] == 1),
        ("no_score_columns", scores, scores == 0), ("no_loan_terms_in_pd", one[1], one[1] == 0),
    ]
    return spark.createDataFrame(rows, "check_name string, value bigint, ok boolean")


def gate_table(spark: SparkSession, values: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """name, value, low, high, ok of stated bands."""
    return spark.createDataFrame([(k, float(v), float(lo), float(hi), lo <= v <= hi) for k, (v, lo, hi) in values.items()], "name string, value double, low double, high double, ok boolean")
