"""Feature factory on the long panel: rolling and trend statistics, ratios, group statistics, ranks, indicators, noise."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arrearium.functions.scalars import clip, log1p_pos, safe_div, sqrt_pos
from arrearium.sources.shared import durable

MONTHS = (3, 6, 9, 12)
TREND_MONTHS = (3, 6, 12)


def monthly(long: DataFrame, series: Mapping[str, str], months: int, key: str | Sequence[str] = "aid", month: str = "m", also: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each account with __<series>_<m>, its value in month m; a partial aggregate, so little is shuffled.

    With aggregates `also` of all of the account's months, which are made in the same pass.
    """
    value = lambda c, m: F.max(F.when(F.col(month) == m, F.col(c).cast("double")))
    rows = long if also else long.filter(F.col(month).between(1, months))
    cells = [value(c, m).alias(f"__{name}_{m}") for name, c in series.items() for m in range(1, months + 1)]
    return rows.groupBy(*([key] if isinstance(key, str) else key)).agg(*cells, *[e.alias(c) for c, e in (also or {}).items()])


def _total(xs: list[Column]) -> Column:
    out = F.lit(0.0)
    for x in xs:
        out = out + x
    return out


def rolling(long: DataFrame, series: Mapping[str, str], months: tuple[int, ...] = MONTHS, key: str | Sequence[str] = "aid", month: str = "m", also: Mapping[str, Column] | None = None) -> DataFrame:
    """mean, std, min, max, median and last value of months 1..L, and the first and last value of all.

    An account's months become columns in one aggregate; the statistics are arithmetic on its row. Nulls don't count.
    `also` are aggregates of all of its months, made in the same pass.
    """
    wide = monthly(long, series, max(months), key, month, also)
    out: list[Column] = []
    for name in series:
        for n in months:
            xs = [F.col(f"__{name}_{m}") for m in range(1, n + 1)]
            count = _total([F.when(x.isNotNull(), 1.0).otherwise(0.0) for x in xs])
            mean = safe_div(_total([F.coalesce(x, F.lit(0.0)) for x in xs]), count)
            spread = _total([F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in xs])
            ranked = F.sort_array(F.array_compact(F.array(*xs)))
            half = F.floor((F.size(ranked) - 1) / 2).cast("int")
            middle = (F.get(ranked, half) + F.get(ranked, F.size(ranked) - 1 - half)) / 2
            out += [
                mean.alias(f"{name}_mean_{n}"), F.when(count > 1, F.sqrt(spread / (count - 1))).alias(f"{name}_std_{n}"), F.least(*xs).alias(f"{name}_min_{n}"), F.greatest(*xs).alias(f"{name}_max_{n}"),
                middle.alias(f"{name}_median_{n}"), F.coalesce(*reversed(xs)).alias(f"{name}_last_{n}"),
            ]
        every = [F.col(f"__{name}_{m}") for m in range(1, max(months) + 1)]
        out += [F.coalesce(*every).alias(f"{name}_first_value"), F.coalesce(*reversed(every)).alias(f"{name}_last_value")]
    return wide.select(*([key] if isinstance(key, str) else key), *out, *(also or {}))


def trend(long: DataFrame, series: Mapping[str, str], months: tuple[int, ...] = TREND_MONTHS, key: str = "aid", month: str = "m") -> DataFrame:
    """slope, intercept and r2 of a straight line through months 1..L, on the row of an account's months.

    The mean and spread of the months are those of the whole window; missing values only leave the sums of values.
    r2 is null where the values don't vary.
    """
    wide = monthly(long, series, max(months), key, month)
    out: list[Column] = []
    for name in series:
        for n in months:
            centre, spread = (n + 1) / 2, n * (n * n - 1) / 12
            ys = {m: F.col(f"__{name}_{m}") for m in range(1, n + 1)}
            add = lambda f, ys=ys: _total([F.coalesce(f(m, y), F.lit(0.0)) for m, y in ys.items()])
            count = _total([F.when(y.isNotNull(), 1.0).otherwise(0.0) for y in ys.values()])
            x, y, xy = add(lambda m, y: F.when(y.isNotNull(), m - centre)), add(lambda m, y: y), add(lambda m, y: y * (m - centre))
            xx, yy = add(lambda m, y: F.when(y.isNotNull(), (m - centre) ** 2)), add(lambda m, y: y * y)
            mean = safe_div(y, count)
            slope = (xy - mean * x) / F.lit(spread)
            total = yy - mean * y
            rest = total - 2 * slope * (xy - mean * x) + slope * slope * xx
            out += [slope.alias(f"{name}_slope_{n}"), (mean - slope * centre).alias(f"{name}_intercept_{n}"), F.when(total > 1e-12, 1 - rest / total).alias(f"{name}_r2_{n}")]
    return wide.select(key, *out)


def label_codes(df: DataFrame, column: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Dense code of a category in sorted order, from 0; the categories are those of `source`, if given."""
    levels = (df if source is None else source).select(column).filter(F.col(column).isNotNull()).distinct()
    codes = levels.withColumn(out, F.dense_rank().over(W.orderBy(column)) - 1)  # as many rows as categories
    return df.join(codes, column, "left")


def interactions(df: DataFrame, products: Mapping[str, tuple[str, str]], squares: Mapping[str, str]) -> DataFrame:
    return df.withColumns({**{k: F.col(a) * F.col(b) for k, (a, b) in products.items()}, **{k: F.col(c) * F.col(c) for k, c in squares.items()}})


def group_stats(df: DataFrame, key: str, value: str, train: Column) -> DataFrame:
    """mean, std, median and count of `value` by `key` on the training rows, with the global value for unseen keys.

    Medians come from ranged counts of distinct values, of the groups and of all rows.
    """
    stats = {"mean": F.avg, "std": F.stddev_samp, "count": F.count}
    fit = df.filter(train)
    known = fit.filter(F.col(key).isNotNull())
    by = known.groupBy(key).agg(*[f(value).alias(f"{value}_{s}_by_{key}") for s, f in stats.items()])
    by = by.join(quantiles(known, value, [0.5], [key]).select(F.col(key).alias("__key"), F.col("q")[0].alias(f"{value}_median_by_{key}")), F.col(key) == F.col("__key"), "left").drop("__key")
    whole = fit.agg(*[f(value).alias(f"__{s}") for s, f in stats.items()]).crossJoin(F.broadcast(quantiles(fit, value, [0.5]).select(F.col("q")[0].alias("__median"))))  # a row each
    out = df.join(by, key, "left").crossJoin(F.broadcast(whole))
    out = out.withColumn(f"{value}_by_{key}_fallback", F.col(f"{value}_count_by_{key}").isNull())
    names = {s: f"{value}_{s}_by_{key}" for s in [*stats, "median"]}
    return out.withColumns({n: F.coalesce(n, f"__{s}" if s != "count" else F.lit(0)) for s, n in names.items()}).drop(*[f"__{s}" for s in names])


def distinct_ranks(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """value, n, before, total for each distinct value: the state from which ranks and distributions follow.

    Groups by value first; the running count is then split by range partitions, so no task gets all values.
    """
    return cumulative(df.filter(F.col(column).isNotNull()).groupBy(*(by or []), F.col(column).alias("value")).agg(F.count("*").alias("n")), "value", ["n"], by)


def cumulative(counts: DataFrame, order: str, columns: list[str], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Adds before_<c> and total_<c>: sums of a column over the rows before, and over all.

    Two steps instead of one global window: rows are ranged into partitions, sums are running inside a partition, and the
    totals of the partitions, one row each, carry over.
    """
    by = by or []
    key = F.col(order).desc() if descending else F.col(order).asc()
    ranged = counts.repartitionByRange(*[F.col(b) for b in by], key)
    # Written before it is read twice, so that both readers see the same partitions.
    parts = durable(ranged.withColumn("__p", F.spark_partition_id()))
    per = parts.groupBy(*by, "__p").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    w = W.partitionBy(*by).orderBy("__p")  # one row for each partition (and group)
    whole = W.partitionBy(*by)
    per = per.select(*by, "__p", *[F.coalesce(F.sum(f"__{c}").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(f"__b_{c}") for c in columns], *[F.sum(f"__{c}").over(whole).alias(f"total_{c}") for c in columns])
    inner = W.partitionBy(*by, "__p").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    # One row for each partition, and at most one more for each group: groups are adjacent, so few partitions hold several.
    out = parts.join(per, [*by, "__p"])
    return out.withColumns({f"before_{c}": F.col(f"__b_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in columns}).drop("__p", *[f"__b_{c}" for c in columns])


def quantiles(df: DataFrame, column: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """One row (for each group): `q`, the exact quantiles of a column, interpolated linearly between neighbours.

    Read off the counts of distinct values, which are ranged over tasks; no task gets all of them.
    """
    ranks = distinct_ranks(df, column, by)
    end = F.col("before_n") + F.col("n")
    aggs = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("total_n") - 1)
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("before_n") <= place) & (place < end), F.col("value").cast("double"))).alias(f"{name}{i}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"f{i}"))
    rows = ranks.groupBy(*(by or [])).agg(*aggs)
    value = lambda i: F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"f{i}")
    return rows.select(*(by or []), F.array(*[value(i) for i in range(len(probs))]).alias("q"))


def rank_features(df: DataFrame, column: str) -> DataFrame:
    """Average rank, percentile (rank - 1) / (n - 1), z-score, log1p and square root of a column."""
    ranks = distinct_ranks(df, column)
    rank = F.col("before_n") + (F.col("n") + 1) / 2
    ranks = ranks.select(F.col("value").alias(column), rank.alias(f"{column}_rank"), safe_div(rank - 1, F.col("total_n") - 1).alias(f"{column}_pct"))
    stat = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    out = df.join(ranks, column, "left").crossJoin(F.broadcast(stat))
    x = F.col(column).cast("double")
    z = F.when(F.col("__s") > 0, (x - F.col("__m")) / F.col("__s")).otherwise(F.lit(0.0))
    return out.withColumns({f"{column}_z": F.when(x.isNotNull(), z), f"{column}_log1p": log1p_pos(x), f"{column}_sqrt": sqrt_pos(x)}).drop("__m", "__s")


def quantile_edges(df: DataFrame, column: str, q: int) -> Column | DataFrame:
    """One row with the distinct inner quantile edges of a column as an array `edges`."""
    return quantiles(df, column, [i / q for i in range(q + 1)]).select(F.array_distinct("q").alias("edges"))


def quantile_bin(df: DataFrame, column: str, q: int, out: str = "bin", right: bool = True) -> DataFrame:
    """Bin number from 0 by the column's own quantiles, duplicate edges dropped; right-closed, or left-closed."""
    edges = quantile_edges(df, column, q)
    x = F.col(column)
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    number = F.size(F.filter(inner, lambda e: (e < x) if right else (e <= x)))
    return df.crossJoin(F.broadcast(edges)).withColumn(out, F.when(x.isNotNull(), number)).drop("edges")


def quantile_one_hot(df: DataFrame, column: str, q: int) -> DataFrame:
    binned = quantile_bin(df, column, q, "__bin")
    return binned.withColumns({f"{column}_q{i}": F.coalesce((F.col("__bin") == i).cast("int"), F.lit(0)) for i in range(q)}).drop("__bin")


def one_hot(df: DataFrame, column: str, levels: list) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels})


def _uniform(key: str, seed: int) -> Column:
    """Reproducible uniform number of a row's key, whatever the partitioning."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def _normal(key: str, seed: int) -> Column:
    return F.sqrt(-2 * F.log(_uniform(key, seed))) * F.cos(2 * F.pi() * _uniform(key, seed + 1))


def noise_feature(df: DataFrame, key: str, out: str, dist: str, seed: int, a: float = 0.0, b: float = 1.0) -> DataFrame:
    """Random control by row key: uniform(a, b), normal(a, b), lognormal(a, b), int(a, b), poisson(a), exponential(a)."""
    u, z = _uniform(key, seed), _normal(key, seed)
    if dist == "poisson":  # inverse distribution function over a fixed range
        total, term, e = 0.0, 2.718281828459045 ** -a, F.lit(float(int(a + 10 * (a**0.5) + 10)))
        steps = []
        for k in range(int(a + 10 * (a**0.5) + 10)):
            total += term
            steps.append((total, k))
            term *= a / (k + 1)
        for bound, k in reversed(steps):
            e = F.when(u <= bound, F.lit(float(k))).otherwise(e)
        return df.withColumn(out, e)
    made = {"uniform": a + (b - a) * u, "normal": a + b * z, "lognormal": F.exp(a + b * z), "int": F.floor(a + (b - a + 1) * u), "exponential": -F.log(u) / (a or 1.0)}[dist]
    return df.withColumn(out, made)


def noisy_copy(df: DataFrame, key: str, column: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Column plus normal noise of `share` of its standard deviation."""
    stat = df.agg(F.stddev_samp(column).alias("__s"))
    return df.crossJoin(F.broadcast(stat)).withColumn(f"{column}_noisy", F.col(column) + share * F.col("__s") * _normal(key, seed)).drop("__s")


#: Fixed values: (prefix or suffix pattern, family, governance level, allowed in default models).
CATALOG_RULES = [
    (r"^(score|scorem|pd_).*", "score", "H", False), (r"^(app_loan_amount|app_n_installments|installment|loan_amount|n_installments).*", "loan_terms", "F", False),
    (r".*_(noisy|noise|random)$", "synthetic", "G", False), (r"^app_.*", "application", "A", True), (r"^act_cus_.*", "customer", "C", True), (r"^(agr|ags)\d+_.*", "window", "D", True),
    (r".*_(mean|std|min|max|median|last|slope|intercept|r2)_\d+$", "derived", "E", True), (r".*_(rank|pct|z|log1p|sqrt|q\d+)$", "transform", "E", True), (r"^act_.*", "account", "B", True),
]


def feature_catalog(spark, columns: list[str]) -> DataFrame:
    """feature_name, family, level, window, pd_allowed for each column, by the first rule that fits."""
    import re

    rows = []
    for c in columns:
        family, level, ok = next(((f, lv, a) for p, f, lv, a in CATALOG_RULES if re.match(p, c)), ("other", "B", True))
        months = re.search(r"(?:_|agr|ags)(\d+)(?:_|$)", c)
        rows.append((c, family, level, int(months[1]) if months else None, ok))
    return spark.createDataFrame(rows, "feature_name string, family string, level string, window int, pd_allowed boolean")


def eligible_features(catalog: DataFrame) -> DataFrame:
    return catalog.filter("pd_allowed and level <> 'H'")


def family_summary(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("family").agg(F.count("*").alias("n"), F.count_if("pd_allowed").alias("n_allowed"))


def validate(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and infinities of the numeric columns, one row."""
    inf = [F.count_if(F.abs(F.col(c).cast("double")) == float("inf")) for c in columns]
    total = inf[0]
    for x in inf[1:]:
        total = total + x
    return df.agg(F.count("*").alias("n"), total.alias("n_infinite"))


def clip_to(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.withColumn(column, clip(F.col(column), low, high))
