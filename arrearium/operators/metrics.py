"""Discrimination, calibration and stability metrics as aggregates over distinct scores.

Scores are grouped by value first; the cumulative table (`features.cumulative`) then needs no global window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearium.functions.scalars import safe_div

from .features import cumulative, quantile_bin, quantile_edges
from .wide import correlations


def score_table(df: DataFrame, score: str, y: str, by: list[str] | None = None) -> DataFrame:
    """value, pos, neg with before_ and total_ counts, for every distinct score (of a group)."""
    known = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(y).isNotNull())
    counts = known.groupBy(*(by or []), F.col(score).alias("value")).agg(F.sum(F.col(y).cast("bigint")).alias("pos"), F.sum(1 - F.col(y).cast("bigint")).alias("neg"))
    return cumulative(counts, "value", ["pos", "neg"], by)


def discrimination(df: DataFrame, score: str, y: str, by: list[str] | None = None) -> DataFrame:
    """n, gini (tie-aware) and ks of a group; null if it has one class only."""
    t = score_table(df, score, y, by)
    c = F.col
    area = F.sum(c("pos").cast("double") * (c("before_neg") + c("neg") / 2))
    gap = F.max(F.abs(safe_div(c("before_pos") + c("pos"), c("total_pos")) - safe_div(c("before_neg") + c("neg"), c("total_neg"))))
    out = t.groupBy(*(by or [])).agg(F.sum(c("pos") + c("neg")).alias("n"), F.first("total_pos").alias("__p"), F.first("total_neg").alias("__n"), area.alias("__a"), gap.alias("ks"))
    return out.select(*(by or []), "n", (2 * safe_div(c("__a"), c("__p").cast("double") * c("__n")) - 1).alias("gini"), F.when((c("__p") > 0) & (c("__n") > 0), c("ks")).alias("ks"))


def above(scored: DataFrame, score: str, y: str, by: str, target: float, bins: int = 4096) -> dict:
    """For each group with both classes: whether its Gini is above the target, as `discrimination` would tell.

    Scores are counted in equal bins between the group's ends first. Only the order inside a bin is open then, which bounds
    the Gini from both sides; groups whose bounds hold the target between them are counted by every distinct score.
    """
    known = scored.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(y).isNotNull()).select(F.col(by).alias("g"), F.col(score).cast("double").alias("s"), F.col(y).cast("bigint").alias("y"))
    ends = known.groupBy("g").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))  # a row for each group
    bin_ = F.least(F.floor(F.col("u") * bins), F.lit(bins - 1))
    placed = known.join(F.broadcast(ends), "g").withColumn("u", F.coalesce(safe_div(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0))).groupBy("g", bin_.alias("b")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    counts: dict = {}
    for r in placed.collect():  # groups x bins
        counts.setdefault(r["g"], {})[r["b"]] = (r["pos"], r["neg"])
    out, open_ = {}, []
    for g, found in counts.items():
        before = area = unsure = 0
        p, n = (sum(x[i] for x in found.values()) for i in (0, 1))
        if not p or not n:
            continue
        for _, (pos, neg) in sorted(found.items()):
            area, unsure, before = area + 2 * pos * before, unsure + pos * neg, before + neg
        low, high = area / (p * n) - 1, (area + 2 * unsure) / (p * n) - 1
        if low <= target + 1e-9 and high > target - 1e-9:
            open_.append(g)
        else:
            out[g] = low > target
    if open_:
        rows = discrimination(scored.filter(F.col(by).isin(open_)), score, y, [by])
        out |= {r[by]: r["gini"] > target for r in rows.collect() if r["gini"] is not None}
    return out


def brier(df: DataFrame, score: str, y: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(F.avg(F.pow(F.col(y) - F.col(score), 2)).alias("brier"), F.avg(y).alias("base_rate"), F.avg(score).alias("mean_pred"))


def calibration_bins(df: DataFrame, score: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, observed, expected, o_to_e by the score's own quantiles, left-closed, repeated edges dropped."""
    known = df.filter(F.col(score).isNotNull() & F.col(y).isNotNull())
    out = quantile_bin(known, score, bins, "bin", right=False).groupBy("bin").agg(F.count("*").alias("n"), F.avg(y).alias("observed"), F.avg(score).alias("expected"))
    return out.withColumn("o_to_e", safe_div(F.col("observed"), F.col("expected")))


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg(safe_div(F.sum(F.abs(F.col("observed") - F.col("expected")) * F.col("n")), F.sum("n")).alias("ece"))


def reliability(df: DataFrame, score: str, y: str, key: str, bins: int = 10) -> DataFrame:
    """Equal-count groups of the rows ordered by (score, key)."""
    rows = df.select(F.struct(score, key).alias("o"), F.col(y).alias("y"), F.col(score).alias("p"), F.lit(1).alias("one"))
    ranked = cumulative(rows, "o", ["one"])
    number = F.greatest(F.ceil(F.col("before_one") * bins / F.greatest(F.col("total_one") - 1, F.lit(1))) - 1, F.lit(0)).cast("int")
    return ranked.groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_pred"), F.avg("y").alias("obs_rate"))


def psi_numeric(df: DataFrame, column: str, group: Column, reference: Column, bins: int = 10) -> DataFrame:
    """group, psi against the reference rows' quantile bins; shares are at least 1e-6."""
    base = quantile_edges(df.filter(reference), column, bins)  # one row
    x = F.col(column)
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = df.filter(x.isNotNull()).crossJoin(F.broadcast(base)).select(group.alias("group"), reference.alias("ref"), F.size(F.filter(inner, lambda e: e <= x)).alias("bin"))
    counts = binned.groupBy("group", "bin").agg(F.count("*").alias("n"), F.count_if("ref").alias("r"))
    return _psi(counts, "bin")


def psi_categorical(df: DataFrame, column: str, group: Column, reference: Column) -> DataFrame:
    counts = df.groupBy(group.alias("group"), F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"), F.count_if(reference).alias("r"))
    return _psi(counts, "level")


def _psi(counts: DataFrame, level: str) -> DataFrame:
    """Counts hold one row for each (group, level): few."""
    ref = counts.groupBy(level).agg(F.sum("r").alias("r"))
    total = ref.agg(F.sum("r").alias("rt"))
    groups = counts.groupBy("group").agg(F.sum("n").alias("nt"))
    grid = groups.crossJoin(F.broadcast(ref)).crossJoin(F.broadcast(total))  # groups x levels
    full = grid.join(counts.select("group", level, "n"), ["group", level], "left").fillna(0, ["n"])
    a, b = F.greatest(safe_div(F.col("n"), F.col("nt")), F.lit(1e-6)), F.greatest(safe_div(F.col("r"), F.col("rt")), F.lit(1e-6))
    return full.groupBy("group").agg(F.sum((a - b) * F.log(a / b)).alias("psi"))


def smd(df: DataFrame, columns: list[str], flag: Column) -> DataFrame:
    """column_name, smd: standardised difference of means between flagged and other rows."""
    aggs = []
    for c in columns:
        for k, cond in (("a", flag), ("b", ~flag)):
            aggs += [F.avg(F.when(cond, F.col(c))).alias(f"m{k}_{c}"), F.var_samp(F.when(cond, F.col(c))).alias(f"v{k}_{c}")]
    row = df.agg(*aggs)
    parts = [F.struct(F.lit(c).alias("column_name"), safe_div(F.col(f"ma_{c}") - F.col(f"mb_{c}"), F.sqrt((F.col(f"va_{c}") + F.col(f"vb_{c}")) / 2)).alias("smd")) for c in columns]
    return row.select(F.explode(F.array(*parts)).alias("x")).select("x.*")


def roc(df: DataFrame, score: str, y: str, by: list[str] | None = None) -> DataFrame:
    """threshold (score and above is positive), tpr, fpr, youden at every distinct score (of a group)."""
    t = score_table(df, score, y, by)
    tpr, fpr = safe_div(F.col("total_pos") - F.col("before_pos"), F.col("total_pos")), safe_div(F.col("total_neg") - F.col("before_neg"), F.col("total_neg"))
    return t.select(*(by or []), F.col("value").alias("threshold"), tpr.alias("tpr"), fpr.alias("fpr"), (tpr - fpr).alias("youden"))


def youden_threshold(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    best = F.max_by(F.struct("threshold", "tpr", "fpr", "youden"), F.struct("youden", -F.col("threshold")))
    return points.groupBy(*(by or [])).agg(best.alias("b")).select(*(by or []), "b.*")


def univariate(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """feature, n, gini, ks of each feature as a score, all in one pass over an unpivoted table."""
    long = df.select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in features])).alias("e")).select("y", "e.feature", "e.x")
    return discrimination(long, "x", "y", ["feature"])


def correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr of all pairs, by blocks of columns."""
    return correlations(df, columns)


def jaccard(sets: DataFrame, run: str, item: str) -> DataFrame:
    """a, b, jaccard of the item sets of every two runs that share an item."""
    rows = sets.select(F.col(run).alias("run"), F.col(item).alias("item")).distinct()
    size = rows.groupBy("run").agg(F.count("*").alias("n"))
    x, y = rows.select(F.col("run").alias("a"), "item"), rows.select(F.col("run").alias("b"), "item")
    both = x.join(y, "item").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = both.join(size.select(F.col("run").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("run").alias("b"), F.col("n").alias("nb")), "b")
    return out.select("a", "b", (F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("jaccard"))


def selection_frequency(sets: DataFrame, run: str, item: str) -> DataFrame:
    """item, n_runs, share: in how many of the runs an item was selected."""
    rows = sets.select(F.col(run).alias("run"), F.col(item).alias("item")).distinct()
    total = rows.agg(F.count_distinct("run").alias("__n"))
    out = rows.groupBy("item").agg(F.count("*").alias("n_runs")).crossJoin(F.broadcast(total))  # one row
    return out.select("item", "n_runs", safe_div(F.col("n_runs"), F.col("__n")).alias("share"))


def comparison(scored: DataFrame, scores: list[str], y: str, by: list[str] | None = None) -> DataFrame:
    """source, n, gini, ks, brier, base_rate, mean_pred of several probability columns, in one pass over an unpivoted table."""
    by = by or []
    long = scored.select(*by, F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).cast("double").alias("p")) for c in scores])).alias("e")).select(*by, "y", "e.source", "e.p")
    keys = ["source", *by]
    return discrimination(long, "p", "y", keys).join(brier(long, "p", "y", keys), keys)


def screen(df: DataFrame, features: list[str], y: str, train: Column, max_null: float = 0.5, min_gini: float = 0.02, max_gap: float = 0.2) -> DataFrame:
    """Stage-one selection: null share over all rows, spread and |gini| on train, and its change out of time."""
    nulls = df.agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"u_{c}") for c in features], *[F.stddev_samp(F.when(train, F.col(c))).alias(f"s_{c}") for c in features])
    info = nulls.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"u_{c}").alias("null_share"), F.col(f"s_{c}").alias("std")) for c in features])).alias("x")).select("x.*")
    g = lambda part, name: univariate(part, features, y).select("feature", F.abs("gini").alias(name))
    out = info.join(g(df.filter(train), "gini_train"), "feature", "left").join(g(df.filter(~train), "gini_oot"), "feature", "left")
    keep = (F.col("null_share") <= max_null) & (F.col("std") > 0) & (F.col("gini_train") >= min_gini) & (F.abs(F.col("gini_train") - F.col("gini_oot")) <= max_gap)
    return out.withColumn("selected", F.coalesce(keep, F.lit(False)))
