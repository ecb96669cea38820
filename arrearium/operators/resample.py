"""Stratified bootstrap and its summaries."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearium.functions.scalars import safe_div
from arrearium.sources.shared import durable

from .features import cumulative
from .prefix import CELLS, best_prefixes


def _uniform(seed: int, *keys: Column) -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def poisson_weight(u: Column, most: int = 12) -> Column:
    """Poisson(1) draw of a uniform number, by the inverse distribution function."""
    total, term, steps = 0.0, 2.718281828459045**-1, []
    for k in range(most):
        total += term
        steps.append((total, k))
        term /= k + 1
    e = F.lit(most)
    for bound, k in reversed(steps):
        e = F.when(u <= bound, k).otherwise(e)
    return e


def weights(df: DataFrame, key: str, replicates: int, seed: int = 42) -> DataFrame:
    """Every row in every replicate with its Poisson(1) weight, zero weights left out; no index join, no shuffle."""
    rows = df.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    return rows.withColumn("weight", poisson_weight(_uniform(seed, F.col(key), F.col("replicate")))).filter("weight > 0")


#: Rows of a stratum whose draws are made together.
BLOCK = 1 << 13


def _numbers(seed: int, *keys: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64([x & 0xFFFFFFFFFFFFFFFF for x in (seed, *keys)]))


def exact_weights(df: DataFrame, strata: list[str], key: str, replicates: int, seed: int = 42) -> DataFrame:
    """`df` with __w, how often a row is drawn in each replicate, if every stratum is drawn with replacement at its own size.

    Rows are numbered within their stratum by `key`, in ranges of it, and numbers fall into blocks. How many of a stratum's
    draws fall into each block is multinomial, and where they fall in a block is uniform; both follow from the seed, the
    stratum, the replicate and the block. So the task that has a row makes its draws: none is joined or shuffled.
    """
    rows, names = durable(df), df.columns  # ranging reads it twice
    numbered = cumulative(rows.withColumn("__one", F.lit(1)), key, ["__one"], strata).select(*df.columns, F.col("before___one").cast("bigint").alias("__at"), F.col("total___one").cast("bigint").alias("__n"), F.xxhash64(F.lit(seed), *strata).alias("__s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[tuple[int, int], np.ndarray] = {}  # the last stratum's: replicates x blocks
        held: dict[tuple[int, int, int], np.ndarray] = {}  # the last block's: rows x replicates
        for batch in batches:
            at, n, s = (batch.column(c).to_numpy() for c in ("__at", "__n", "__s"))
            block = at // BLOCK
            out = np.zeros((len(at), replicates), np.int32)
            order = np.lexsort((at, s))
            cuts = np.flatnonzero((np.diff(s[order]) != 0) | (np.diff(block[order]) != 0)) + 1
            for part in np.split(order, cuts):
                if not len(part):
                    continue
                stratum, rows, b = int(s[part[0]]), int(n[part[0]]), int(block[part[0]])
                if (stratum, rows) not in sizes:
                    shares = np.diff([*range(0, rows, BLOCK), rows]) / rows
                    sizes = {(stratum, rows): np.stack([_numbers(seed, stratum, r).multinomial(rows, shares) for r in range(replicates)])}
                if (stratum, rows, b) not in held:
                    own = min(BLOCK, rows - b * BLOCK)
                    drawn = sizes[stratum, rows][:, b]
                    held = {(stratum, rows, b): np.stack([np.bincount(_numbers(seed, stratum, r, b).integers(0, own, drawn[r]), minlength=own) for r in range(replicates)], axis=1)}
                out[part] = held[stratum, rows, b][at[part] - b * BLOCK]
            lists = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * replicates, pa.array(out.reshape(-1), pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], lists], names=[*names, "__w"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in df.dtypes)
    return numbered.mapInArrow(run, f"{kinds}, __w array<int>")


def exact_sample(df: DataFrame, strata: list[str], key: str, replicates: int, seed: int = 42) -> DataFrame:
    """As many draws with replacement from every stratum as it has rows, for each replicate: a row for each draw."""
    rows = exact_weights(df, strata, key, replicates, seed).select(*df.columns, F.posexplode("__w").alias("__r", "__k"))
    drawn = rows.filter("__k > 0").select("*", F.explode(F.array_repeat(F.lit(1), F.col("__k"))))
    return drawn.select(*strata, (F.col("__r") + 1).alias("replicate"), *[c for c in df.columns if c not in strata])


def exact_sums(df: DataFrame, strata: list[str], by: list[str], key: str, replicates: int, columns: list[str], seed: int = 42) -> DataFrame:
    """n and the sums of `columns` over the draws of `exact_sample`, by replicate and group `by`."""
    rows = exact_weights(df, strata, key, replicates, seed)
    weight = lambda r: F.get("__w", F.lit(r)).cast("bigint")
    # A group's replicates are columns of one aggregate, so rows aren't multiplied by them.
    sums = rows.groupBy(*by).agg(*[x for r in range(replicates) for x in (F.sum(weight(r)).alias(f"__n{r}"), *[F.sum(weight(r) * F.col(c)).alias(f"__{i}_{r}") for i, c in enumerate(columns)])])
    each = [F.struct(F.lit(r + 1).alias("replicate"), F.col(f"__n{r}").alias("n"), *[F.col(f"__{i}_{r}").alias(c) for i, c in enumerate(columns)]) for r in range(replicates)]
    return sums.select(*by, F.explode(F.array(*each)).alias("e")).select("e.replicate", *by, "e.n", *[f"e.{c}" for c in columns]).filter("n > 0")


def profit_cutoff(weighted: DataFrame, by: list[str], score: str, profit: str) -> DataFrame:
    """Profit-optimal acceptance of each replicate from sums by distinct score."""
    sums = weighted.groupBy(*by, F.col(score).alias("p")).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col(profit)).alias("profit"))
    running = cumulative(sums, "p", ["n", "profit"], by).withColumn("k", F.col("before_n") + F.col("n")).withColumn("cum", F.col("before_profit") + F.col("profit"))
    best = F.max_by(F.struct("p", "k", "cum"), F.struct("cum", -F.col("k")))
    out = running.groupBy(*by).agg(F.sum("n").alias("n"), best.alias("b"))
    ok = F.col("b.cum") > 0
    return out.select(*by, F.when(ok, F.col("b.p")).otherwise(0.0).alias("cutoff"), F.when(ok, 100 * F.col("b.k") / F.col("n")).otherwise(0.0).alias("approve_pct"), F.when(ok, F.col("b.cum")).otherwise(0.0).alias("max_profit"))


def poisson_cdf(most: int = 12) -> np.ndarray:
    """Distribution function of Poisson(1) at 0, 1, ..."""
    return np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, most)]))


def _draw_table() -> np.ndarray:
    """The draw by the first 12 bits of a uniform number; -1 where the other bits decide."""
    low = np.arange(4096, dtype=np.uint64) << np.uint64(41)
    at = lambda bits: np.searchsorted(poisson_cdf(), bits * 2.0**-53)
    a, b = at(low), at(low + np.uint64((1 << 41) - 1))
    return np.where(a == b, a, -1).astype(float)


def draws(hashes: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson(1) draws, rows x replicates, that depend on nothing but a row's hash and the replicate's number.

    Some rows at a time, in place, so that what is mixed stays in the processor's cache; nearly all draws are looked up.
    """
    cdf, table = poisson_cdf(), _draw_table()
    seeds, out = hashes.astype(np.int64).view(np.uint64)[:, None], np.empty((len(hashes), replicates))
    with np.errstate(over="ignore"):
        steps = np.arange(1, replicates + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        rows = max((1 << 15) // max(replicates, 1), 1)
        for a in range(0, len(hashes), rows):
            z = seeds[a : a + rows] + steps
            t = np.empty_like(z)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
                np.right_shift(z, np.uint64(shift), out=t)
                np.bitwise_xor(z, t, out=z)
                if factor is not None:
                    np.multiply(z, np.uint64(factor), out=z)
            np.right_shift(z, np.uint64(52), out=t)
            mine = out[a : a + rows]
            np.take(table, t.view(np.int64), out=mine, mode="clip")
            open_ = np.nonzero(mine < 0)
            mine[open_] = np.searchsorted(cdf, (z[open_] >> np.uint64(11)) * 2.0**-53)
    return out


def stratum_factors(rows: DataFrame, stratum: str, replicates: int, hashes: str = "h") -> np.ndarray:
    """strata x replicates: what brings each stratum's weights in a replicate to the stratum's own size.

    Sums over all rows are made in tasks; a task sends one row of `replicates` numbers for each stratum in it.
    """
    step = max(CELLS // replicates, 1)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            s, h = batch.column("s").to_numpy(), batch.column("h").to_numpy()
            for a in range(0, len(s), step):
                w, part = draws(h[a : a + step], replicates), s[a : a + step]
                own = np.unique(part)
                in_ = (part[None, :] == own[:, None]).astype(float)
                for k, n, x in zip(own, in_.sum(1), in_ @ w, strict=True):
                    total[int(k)] = total.get(int(k), 0) + np.concatenate([[n], x])
        if total:
            yield pa.RecordBatch.from_pydict({"s": list(total), "w": [x.tobytes() for x in total.values()]}, pa.schema([("s", pa.int32()), ("w", pa.binary())]))

    found: dict[int, np.ndarray] = {}
    for r in rows.select(F.col(stratum).cast("int").alias("s"), F.col(hashes).alias("h")).mapInArrow(sums, "s int, w binary").collect():
        found[r["s"]] = found.get(r["s"], 0) + np.frombuffer(r["w"])
    out = np.ones((max(found, default=-1) + 1, replicates))
    for k, x in found.items():
        out[k] = np.where(x[1:] > 0, x[0] / np.maximum(x[1:], 1), 0.0)
    return out


METRICS = ["profit_at_kstar", "approve_pct_kstar", "cutoff_pd_star", "profit_at_fixed", "approve_pct_fixed", "cutoff_gap", "profit_uplift", "profit_uplift_pct", "default_rate"]


def cutoff_bootstrap(rows: DataFrame, anchors: list[str], replicates: int, fixed: Mapping[str, float], anchor: str = "anchor", key: str = "aid", stratum: str = "n_installments", pd_: str = "pd_stressed", profit: str = "Expected_Profit", y: str = "y", seed: int = 42) -> DataFrame:
    """METRICS of the profit-optimal and of a fixed cut-off for each anchor in each replicate of a stratified bootstrap.

    A row's weights in all replicates are an array of Poisson draws from its key, alike for every anchor, scaled to the
    size of its stratum. One sorted pass sums them: rows are not multiplied by replicates. Replicate 0 is the data itself.
    """
    levels = sorted(r[0] for r in rows.select(stratum).filter(F.col(stratum).isNotNull()).distinct().collect())  # the strata
    base = rows.select(
        (F.array_position(F.array(*[F.lit(a) for a in anchors]), F.col(anchor)) - 1).cast("int").alias("g"), (F.array_position(F.array(*[F.lit(v) for v in levels]), F.col(stratum)) - 1).cast("int").alias("s"),
        F.col(pd_).cast("double").alias("p"), F.col(profit).cast("double").alias("profit"), F.col(y).cast("double").alias("y"), F.xxhash64(F.lit(seed), F.col(key)).alias("h"),
    ).filter("g >= 0 and s >= 0")
    factors = stratum_factors(base.filter("g = 0"), "s", replicates)
    limits = [float(fixed[a]) for a in anchors]

    def make(g: int, x: Mapping[str, np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Sums over each run of equal scores. Weights are draws times a factor of the stratum, so rows are added up by stratum first."""
        w, profit, inside, n = draws(x["h"], replicates), x["profit"], (x["p"] <= limits[g]).astype(float), len(x["h"])
        columns = np.stack([np.ones(n), profit, profit * inside, inside, np.nan_to_num(x["y"])])
        strata = (x["s"][None, :] == np.arange(len(factors))[:, None]).astype(float)

        def weighed(a: int, b: int, vectors: np.ndarray) -> np.ndarray:
            by = (strata[:, None, a:b] * vectors[None, :, a:b]).reshape(-1, b - a) @ w[a:b]
            return (by.reshape(len(factors), len(vectors), -1) * factors[:, None, :]).sum(0)

        own, own_extras = np.add.reduceat(columns[:2], starts, axis=1)[:, :, None], columns[2:].sum(1)[:, None]
        if 8 * len(starts) <= n or len(starts) == 1:
            every = np.stack([weighed(a, b, columns) for a, b in zip(starts, [*starts[1:], n], strict=True)], axis=1)
            drawn, extras = every[:2], every[2:].sum(1)
        else:
            extras = weighed(0, n, columns[2:])
            w *= factors[x["s"]]
            drawn = np.stack([np.add.reduceat(v, starts, axis=0) for v in (w, w * profit[:, None])])
        count, value = np.concatenate([own, drawn], axis=2)
        return count, value, list(np.concatenate([own_extras, extras], axis=1))

    out = []
    for g, b in best_prefixes(base, "g", "p", make, replicates + 1, 3, sums=True).items():
        n = np.where(b.n > 0, b.n, 1.0)
        pct, fixed_pct, uplift = 100 * b.best_n / n, 100 * b.extras[1] / n, b.best - b.extras[0]
        share = np.divide(uplift, np.abs(b.extras[0]), out=np.full_like(uplift, np.nan), where=b.extras[0] != 0)
        columns = np.stack([b.best, pct, b.best_at, b.extras[0], fixed_pct, pct - fixed_pct, uplift, share, b.extras[2] / n])
        out += [(k, anchors[g], *[None if v != v else float(v) for v in columns[:, k]]) for k in range(replicates + 1)]
    return rows.sparkSession.createDataFrame(out, "replicate int, anchor string, " + ", ".join(f"{m} double" for m in METRICS))  # anchors x replicates


def bootstrap_checks(replicates: DataFrame, again: DataFrame | None = None, drift: float = 0.001) -> DataFrame:
    """anchor, check_name, value, ok of a `cutoff_bootstrap`: strata kept, numbers finite, intervals ordered and around the
    data's own value (replicate 0), and, with a second run of some replicates, reproduced."""
    drawn, point = replicates.filter("replicate > 0"), replicates.filter("replicate = 0")
    core = [m for m in METRICS if m != "profit_uplift_pct"]
    bad = F.count_if(~F.greatest(*[F.coalesce(F.isnan(m) | (F.abs(m) == float("inf")), F.lit(True)).cast("int") for m in core]).isin(0))
    q = lambda p: F.percentile("profit_uplift", F.lit(p))
    stats = drawn.groupBy("anchor").agg(F.avg("default_rate").alias("dr"), bad.cast("double").alias("n_bad"), q(0.025).alias("lo"), q(0.5).alias("mid"), q(0.975).alias("hi"))
    rows = stats.join(point.select("anchor", F.col("default_rate").alias("dr0"), F.col("profit_uplift").alias("at")), "anchor")
    c = F.col
    checks = [
        ("strata_kept", F.abs(c("dr") - c("dr0")), F.abs(c("dr") - c("dr0")) < drift), ("finite", c("n_bad"), c("n_bad") == 0), ("interval_ordered", c("hi") - c("lo"), (c("lo") <= c("mid")) & (c("mid") <= c("hi"))),
        ("point_inside", c("at"), c("at").between(c("lo"), c("hi"))),
    ]
    out = rows.select("anchor", F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), v.alias("value"), ok.alias("ok")) for k, v, ok in checks])).alias("x")).select("anchor", "x.*")
    if again is not None:
        both = again.filter("replicate > 0").select("anchor", "replicate", c("profit_uplift").alias("b")).join(drawn.select("anchor", "replicate", "profit_uplift"), ["anchor", "replicate"])
        gap = both.groupBy("anchor").agg(F.max(F.abs(c("b") - c("profit_uplift"))).alias("value"))
        out = out.union(gap.select("anchor", F.lit("reproduced"), "value", c("value") < 1e-8))
    return out


def cutoff_probabilities(replicates: DataFrame) -> DataFrame:
    """anchor with the shares of replicates that approve all, some or few, that accept more than the fixed cut-off, and that gain."""
    pct = F.col("approve_pct_kstar")
    share = lambda e: F.avg(e.cast("int"))
    return replicates.filter("replicate > 0").groupBy("anchor").agg(
        share(pct >= 99).alias("p_approve_all"), share((pct >= 50) & (pct < 99)).alias("p_interior"), share(pct < 50).alias("p_reject_most"), share(F.col("cutoff_gap") > 0).alias("p_more_permissive"), share(F.col("profit_uplift") > 0).alias("p_uplift"),
    )


def uplift_verdict(low: Column, high: Column) -> Column:
    """What an interval of an uplift in percent says."""
    return F.when(low > 5, "STAT_SIG_AND_MEANINGFUL").when(low > 0, "STAT_SIG_SMALL_EFFECT").when((low <= 0) & (high > 0), "NOT_SIGNIFICANT").when(high <= 0, "NEGATIVE_UPLIFT").otherwise("UNDEFINED")


def ci_summary(replicates: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """metric, mean, median, std, interval and its width over the replicates."""
    long = replicates.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics])).alias("e")).select(*by, "e.metric", "e.x")
    q = lambda p: F.percentile("x", F.lit(p))
    out = long.groupBy(*by, "metric").agg(F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_samp("x").alias("std"), q(0.025).alias("ci_lo_2_5"), q(0.25).alias("q25"), q(0.75).alias("q75"), q(0.975).alias("ci_hi_97_5"))
    return out.withColumn("width", F.col("ci_hi_97_5") - F.col("ci_lo_2_5"))


def sanity(replicates: DataFrame, point: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """metric, point, mean, bias_pct, inside: whether the estimate on the data lies in the interval of the replicates."""
    summary = ci_summary(replicates, by, metrics)
    long = point.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("point")) for m in metrics])).alias("e")).select(*by, "e.metric", "e.point")
    out = summary.join(long, [*by, "metric"])
    bias = 100 * safe_div(F.col("mean") - F.col("point"), F.abs("point"))
    return out.select(*by, "metric", "point", "mean", bias.alias("bias_pct"), F.col("point").between(F.col("ci_lo_2_5"), F.col("ci_hi_97_5")).alias("inside"))


def overlaps(summary: DataFrame, name: str) -> DataFrame:
    """Pairs of anchors whose intervals of a metric overlap."""
    rows = summary.select(F.col(name).alias("a"), "metric", F.col("ci_lo_2_5").alias("lo"), F.col("ci_hi_97_5").alias("hi"))
    other = rows.select(F.col("a").alias("b"), "metric", F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    j = rows.join(other, "metric").filter("a < b")  # one row for each anchor and metric
    return j.select("a", "b", "metric", ((F.col("lo") <= F.col("hi2")) & (F.col("lo2") <= F.col("hi"))).alias("overlap"))


def category_probabilities(replicates: DataFrame, by: list[str]) -> DataFrame:
    c = F.when(F.col("approve_pct") >= 99, "approve_all").when(F.col("approve_pct") >= 50, "interior").otherwise("reject_most")
    total = replicates.groupBy(*by).agg(F.count("*").alias("n"))
    out = replicates.groupBy(*by, c.alias("category")).agg(F.count("*").alias("k"))
    return (out.join(total, by) if by else out.crossJoin(F.broadcast(total))).select(*by, "category", safe_div(F.col("k"), F.col("n")).alias("probability"))
