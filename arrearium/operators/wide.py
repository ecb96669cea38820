"""Many columns at once: profiles, quantiles, average ranks and indicators of a whole wide table in a few jobs.

Columns are unpivoted to (column number, value), so a statistic of a thousand columns is one aggregate with one
expression, and its plan doesn't grow with the columns. What reaches the driver is a few numbers for each column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearium.functions.scalars import safe_div
from arrearium.sources.shared import durable

from .features import cumulative

#: Rows of a block; values that a block shows of each column, and blocks that do, for the cuts of ranges; cells of a range.
BLOCK_ROWS, LEVELS, SHOWN, CELLS = 10_000, 200, 200, 2_000_000


def unpivot(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, c, value) for each value of each column that is neither null nor NaN; c is the column's place in the list."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])).alias("x")
    return df.select(*keep, cells).select(*keep, "x.c", (F.col("x.value") + 0.0).alias("value")).filter("value is not null and not isnan(value)")


@dataclass(frozen=True)
class Profile:
    """What a scan knows of a column: rows with a value, distinct values (the first ones in order), quantiles, moments."""

    n: int
    distinct: int
    first: tuple[float, ...]
    quantiles: tuple[float, ...]


def profiles(df: DataFrame, columns: list[str], probs: list[float] = [], first: int = 0) -> dict[str, Profile]:  # noqa: B006
    """Exact profile of every column, quantiles interpolated linearly, from ranged counts of all columns' distinct values."""
    counts = unpivot(df, columns).groupBy("c", "value").agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    ranks = cumulative(counts, "value", ["n", "one"], ["c"])
    end, aggs = F.col("before_n") + F.col("n"), [F.max("total_n").alias("n"), F.max("total_one").alias("d"), F.sort_array(F.collect_list(F.when(F.col("before_one") < first, F.col("value")))).alias("first")]
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("total_n") - 1)
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            aggs.append(F.max(F.when((F.col("before_n") <= place) & (place < end), F.col("value"))).alias(f"{name}{i}"))
    found = {r["c"]: r for r in ranks.groupBy("c").agg(*aggs).collect()}  # one row a column

    def profile(c: int) -> Profile:
        if c not in found:
            return Profile(0, 0, (), ())
        r = found[c]
        at = [p * (r["n"] - 1) for p in probs]
        return Profile(r["n"], r["d"], tuple(r["first"]), tuple(r[f"lo{i}"] + (r[f"hi{i}"] - r[f"lo{i}"]) * (x - int(x)) for i, x in enumerate(at)))

    return {name: profile(i) for i, name in enumerate(columns)}


def moments(df: DataFrame, columns: list[str]) -> dict[str, tuple[int, int, float, float]]:
    """(values, about how many distinct, mean, standard deviation) of every column, in one aggregate."""
    rows = unpivot(df, columns).groupBy("c").agg(F.count("*"), F.approx_count_distinct("value"), F.avg("value"), F.stddev_samp("value")).collect()
    found = {r[0]: tuple(r[1:]) for r in rows}
    return {name: found.get(i, (0, 0, None, None)) for i, name in enumerate(columns)}


TRANSFORMS = ("rank", "pct", "z", "log1p", "sqrt")


def nearest(x: np.ndarray, digits: int) -> np.ndarray:
    """`registry.scaled_rounded` of an array."""
    scale = 10.0**digits
    scaled = np.abs(x) * scale
    return np.where(scaled < 2.0**52, np.sign(x) * np.floor(scaled + 0.5) / scale + 0.0, x)


@dataclass(frozen=True)
class _Known:
    """What all rows tell of a column: rows, mean and deviation, the cuts of its ranges, and its values before each range."""

    rows: int
    mean: float
    std: float
    cuts: np.ndarray
    before: np.ndarray


def _blocks(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """b, n, keys, x: BLOCK_ROWS rows or so as a list of keys and one compressed matrix, a column after the other; written."""
    rows = df.select(F.col(key).alias("k"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in columns]).alias("x"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(held: list[pa.RecordBatch], i: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            keys, n = table.column("k").combine_chunks(), table.num_rows
            x = table.column("x").combine_chunks().flatten().to_numpy().reshape(n, len(columns)).T + 0.0
            parts = [pa.array([(TaskContext.get().partitionId() << 32) + i]), pa.array([n], pa.int32()), pa.ListArray.from_arrays(np.array([0, n], np.int32), keys), pa.array([pa.compress(np.ascontiguousarray(x), "zstd", asbytes=True)], pa.binary())]
            return pa.RecordBatch.from_arrays(parts, names=["b", "n", "keys", "x"])

        held, i = [], 0
        for batch in (b.slice(at, BLOCK_ROWS) for b in batches for at in range(0, b.num_rows, BLOCK_ROWS)):
            held.append(batch)
            if sum(h.num_rows for h in held) >= BLOCK_ROWS:
                yield block(held, i)
                held, i = [], i + 1
        if sum(h.num_rows for h in held):
            yield block(held, i)

    return durable(rows.mapInArrow(packed, f"b bigint, n int, keys array<{dict(df.dtypes)[key]}>, x binary"))


def _known(blocks: DataFrame, columns: list[str]) -> list[_Known]:
    """Moments and ranges of each column: two passes over the blocks, of which some rows a column reach the driver.

    The cuts come from some values of some blocks. They only tell which task ranks a value.
    """
    stride, width = max(blocks.rdd.getNumPartitions() // SHOWN, 1), len(columns)

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for n, x in zip(batch.column("n").to_pylist(), batch.column("x").to_pylist(), strict=True):
                yield np.frombuffer(pa.decompress(x, 8 * n * width, "zstd", asbytes=True)).reshape(width, n)

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, 5))  # rows, values, mean, squared deviations, distinct values by block
        shown: list[list[np.ndarray]] = [[] for _ in columns]
        for i, x in enumerate(tables(batches)):
            for c, v in enumerate(x):
                known = v[~np.isnan(v)]
                rows, n, mean, squares, cells = total[c]
                total[c, 0] = rows + len(v)
                if not len(known):
                    continue
                own = np.unique(known)
                m = known[0] if len(own) == 1 else known.mean()
                gap, both = m - mean, n + len(known)
                total[c, 1:] = both, m if not n or m == mean else mean + gap * len(known) / both, squares + ((known - m) ** 2).sum() + gap * gap * n * len(known) / both, cells + len(own)
                if i < 4 and TaskContext.get().partitionId() % stride == 0:
                    shown[c].append(own[np.linspace(0, len(own) - 1, min(LEVELS, len(own))).astype(int)])
        yield pa.RecordBatch.from_pydict({"c": pa.array(range(width), pa.int32()), "x": [t.tobytes() for t in total], "v": [np.concatenate(v or [np.zeros(0)]).tobytes() for v in shown]})

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        t = np.stack([np.frombuffer(x) for x in part["x"]])
        t = t[np.argsort(t[:, 2], kind="stable")]
        n, have = t[:, 1].sum(), t[:, 1] > 0
        means = t[have, 2]
        mean = np.nan if not n else means[0] if means[0] == means[-1] else (t[have, 1] * means).sum() / n
        std = np.sqrt((t[have, 3] + t[have, 1] * (means - mean) ** 2).sum() / (n - 1)) if n > 1 else np.nan
        seen = np.sort(np.concatenate([np.frombuffer(v) for v in part["v"]]))
        ranges = min(int(-(-t[:, 4].sum() // CELLS)), len(seen))
        cuts = np.unique(seen[np.arange(1, ranges) * len(seen) // ranges]) if ranges > 1 else np.zeros(0)
        return pd.DataFrame({"c": [part["c"].iloc[0]], "rows": [int(t[:, 0].sum())], "mean": [mean], "std": [std], "cuts": [cuts.tobytes()]})

    found = {r["c"]: r for r in blocks.select("n", "x").mapInArrow(looked, "c int, x binary, v binary").groupBy("c").applyInPandas(joined, "c int, rows bigint, mean double, std double, cuts binary").collect()}
    cuts = [np.frombuffer(found[c]["cuts"]) if c in found else np.zeros(0) for c in range(width)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {c: np.zeros(len(k) + 1, np.int64) for c, k in enumerate(cuts) if len(k)}
        for x in tables(batches):
            for c, t in total.items():
                t += np.bincount(np.searchsorted(cuts[c], x[c][~np.isnan(x[c])], "right"), minlength=len(t))
        for c, t in total.items():
            yield pa.RecordBatch.from_pydict({"c": np.full(len(t), c, np.int32), "p": np.arange(len(t), dtype=np.int32), "n": t})

    before = [np.zeros(len(k) + 1, np.int64) for k in cuts]
    if any(len(k) for k in cuts):
        for r in blocks.select("n", "x").mapInArrow(counted, "c int, p int, n bigint").groupBy("c", "p").agg(F.sum("n").alias("n")).collect():
            before[r["c"]][r["p"]] = r["n"]
    of = lambda c, f, empty: empty if c not in found or found[c][f] is None or np.isnan(found[c][f]) else found[c][f]
    return [_Known(of(c, "rows", 0), of(c, "mean", 0.0), of(c, "std", 0.0), cuts[c], np.cumsum(before[c]) - before[c]) for c in range(width)]


def _ranked(df: DataFrame, key: str, columns: list[str], finish: Callable[[pa.Array, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """`finish` of the keys of each block of rows and their TRANSFORMS, columns x transforms x rows, NaN where missing.

    A block sends each column's distinct values with their counts to the tasks that rank ranges of values, and gets their
    average ranks back, so a common value is one cell a block and no row is sorted. What moves are arrays of cells.
    """
    width = len(columns)
    blocks = _blocks(df, key, columns)
    known = _known(blocks, columns)
    first = np.cumsum([0, *[len(k.cuts) + 1 for k in known]])
    before = np.concatenate([k.before for k in known])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, n, x in zip(*(batch.column(c).to_pylist() for c in ("b", "n", "x")), strict=True):
                out: dict[str, list] = {c: [] for c in ("g", "b", "at", "v", "k")}
                for c, v in enumerate(np.frombuffer(pa.decompress(x, 8 * n * width, "zstd", asbytes=True)).reshape(width, n)):
                    own, count = np.unique(v[~np.isnan(v)], return_counts=True)
                    ends = [0, *np.searchsorted(own, known[c].cuts), len(own)]
                    for p, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
                        if j > i:
                            for name, value in zip(out, (int(first[c]) + p, b, int(i), own[i:j].tobytes(), count[i:j].astype(np.int32).tobytes()), strict=True):
                                out[name].append(value)
                yield pa.RecordBatch.from_pydict(out, pa.schema([("g", pa.int32()), ("b", pa.int64()), ("at", pa.int32()), ("v", pa.binary()), ("k", pa.binary())]))

    def rank(part: pd.DataFrame) -> pd.DataFrame:
        g = int(part["g"].iloc[0])
        sizes = [len(v) // 8 for v in part["v"]]
        v, k = np.frombuffer(b"".join(part["v"])), np.frombuffer(b"".join(part["k"]), np.int32).astype(np.int64)
        order = np.argsort(v, kind="stable")
        new = np.diff(v[order], prepend=np.nan) != 0
        if len(v) > 1:  # two infinities have no difference
            new[1:] = v[order][1:] != v[order][:-1]
        total = np.add.reduceat(k[order], np.flatnonzero(new))
        twice = np.empty(len(v), np.int64)
        twice[order] = (2 * (before[g] + np.cumsum(total) - total) + total + 1)[np.cumsum(new) - 1]
        ends = np.cumsum([0, *sizes])
        cells = [pa.compress(np.diff(twice[i:j], prepend=0), "zstd", asbytes=True) for i, j in zip(ends, ends[1:], strict=False)]
        c = int(np.searchsorted(first, g, "right")) - 1
        return pd.DataFrame({"b": part["b"], "c": np.full(len(part), c, np.int32), "at": part["at"], "m": np.array(sizes, np.int32), "r": cells})

    total = max([k.rows for k in known], default=0)
    mean, std = (np.array([getattr(k, f) for k in known])[:, None] for f in ("mean", "std"))

    def features(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.column("n")[0].as_py()
        x = np.frombuffer(pa.decompress(left.column("x")[0].as_py(), 8 * n * width, "zstd", asbytes=True)).reshape(width, n)
        got: dict[int, list[tuple[int, np.ndarray]]] = {}
        for c, at, m, r in zip(*(right.column(c).to_pylist() for c in ("c", "at", "m", "r")), strict=True):
            got.setdefault(c, []).append((at, np.cumsum(np.frombuffer(pa.decompress(r, 8 * m, "zstd", asbytes=True), np.int64)) / 2))
        v = np.full((width, 5, n), np.nan)
        for c, ranks in got.items():
            here = ~np.isnan(x[c])
            v[c, 0, here] = np.concatenate([r for _, r in sorted(ranks, key=lambda p: p[0])])[np.unique(x[c][here], return_inverse=True)[1]]
        v[:, 1] = (v[:, 0] - 1) / max(total - 1, 1)
        v[:, 2] = np.where(std > 0, (x - mean) / np.where(std > 0, std, 1.0), np.where(np.isnan(x), np.nan, 0.0))
        above = np.where(x > 0, x, 0.0)
        v[:, 3], v[:, 4] = np.log1p(above), np.sqrt(above)
        return finish(left.column("keys").combine_chunks().flatten(), v)

    ranks = blocks.select("b", "n", "x").mapInArrow(pieces, "g int, b bigint, at int, v binary, k binary").groupBy("g").applyInPandas(rank, "b bigint, c int, at int, m int, r binary")
    return blocks.groupBy("b").cogroup(ranks.groupBy("b")).applyInArrow(features, schema)


def rank_columns(df: DataFrame, key: str, columns: list[str], digits: int | None = None) -> DataFrame:
    """key with <column>_rank, _pct, _z, _log1p and _sqrt of every column; rounded in the task, if `digits` are given.

    Average ranks, (rank - 1) / (rows - 1), z-scores (0 for a constant), logs and roots, for which negative and
    missing values count as 0.
    """
    names = [f"{c}_{t}" for c in columns for t in TRANSFORMS]

    def finish(keys: pa.Array, v: np.ndarray) -> pa.Table:
        cells = v.reshape(-1, v.shape[2]) if digits is None else nearest(v, digits).reshape(-1, v.shape[2])
        return pa.table([keys, *[pa.array(x, pa.float64(), mask=np.isnan(x)) for x in cells]], names=[key, *names])

    return _ranked(df, key, columns, finish, ", ".join([f"`{key}` {dict(df.dtypes)[key]}", *[f"`{c}` double" for c in names]]))


def rank_summary(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """feature, n, total, most of the columns of `rank_columns`, which are made for all rows and added up where they are made."""

    def finish(_: pa.Array, v: np.ndarray) -> pa.Table:
        x = v.reshape(-1, v.shape[2])
        n = (~np.isnan(x)).sum(1)
        most = np.where(n > 0, np.fmax.reduce(x, axis=1), 0.0)
        return pa.table({"i": np.arange(len(x), dtype=np.int32), "n": n, "total": pa.array(np.nansum(x, 1), mask=n == 0), "most": pa.array(most, mask=n == 0)})

    cells = _ranked(df, key, columns, finish, "i int, n bigint, total double, most double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("most").alias("most"))
    names = F.array(*[F.lit(f"{c}_{t}") for c in columns for t in TRANSFORMS])
    return cells.select(F.get(names, F.col("i")).alias("feature"), "n", "total", "most")


def summary(arrays: DataFrame, names: list[str], column: str = "features") -> DataFrame:
    """feature, n, total, most of every element of an array column."""
    cells = arrays.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.max("x").alias("most"))
    return cells.select(F.get(F.array(*[F.lit(c) for c in names]), F.col("i")).alias("feature"), "n", "total", "most")


#: Columns of a block of the correlation matrix.
BLOCK = 256


def correlations(df: DataFrame, columns: list[str], block: int = BLOCK) -> DataFrame:
    """a, b, corr of all pairs of columns in their order, over the rows where both have a value; null if one is constant.

    Sums of products are made by blocks of columns with matrix products in the tasks, and added up by block, so the plan
    is the same for six columns and for two thousand. Values are centred at their means first.
    """
    centre = [m[2] or 0.0 for m in moments(df, columns).values()]
    cuts = list(range(0, len(columns), block))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) - centre
            known = np.isfinite(x)
            z, m = np.where(known, x, 0.0), known.astype(float)
            for i, a in enumerate(cuts):
                for j, b in enumerate(cuts[i:], i):
                    za, ma, zb, mb = z[:, a : a + block], m[:, a : a + block], z[:, b : b + block], m[:, b : b + block]
                    new = np.stack([ma.T @ mb, za.T @ mb, ma.T @ zb, za.T @ zb, (za * za).T @ mb, ma.T @ (zb * zb)])
                    total[i, j] = total[i, j] + new if (i, j) in total else new
        if total:
            yield pa.RecordBatch.from_pydict({"i": [i for i, _ in total], "j": [j for _, j in total], "sums": [v.tobytes() for v in total.values()]}, pa.schema([("i", pa.int32()), ("j", pa.int32()), ("sums", pa.binary())]))

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        na, nb = len(columns[cuts[i] : cuts[i] + block]), len(columns[cuts[j] : cuts[j] + block])
        n, sa, sb, ab, aa, bb = np.sum([np.frombuffer(s) for s in part["sums"]], axis=0).reshape(6, na, nb)
        with np.errstate(all="ignore"):
            va, vb = aa - sa * sa / n, bb - sb * sb / n
            r = np.where((va > 1e-12 * aa) & (vb > 1e-12 * bb), (ab - sa * sb / n) / np.sqrt(va * vb), np.nan)
        p, q = np.nonzero(np.triu(np.ones((na, nb)), 1) if i == j else np.ones((na, nb)))
        return pd.DataFrame({"a": (cuts[i] + p).astype("int32"), "b": (cuts[j] + q).astype("int32"), "corr": r[p, q]})

    packed = df.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    out = packed.mapInArrow(sums, "i int, j int, sums binary").groupBy("i", "j").applyInPandas(finish, "a int, b int, corr double")
    names = F.array(*[F.lit(c) for c in columns])
    return out.select(F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), F.when(~F.isnan("corr"), F.col("corr")).alias("corr"))


def bins_of(df: DataFrame, specs: Mapping[str, tuple[int, ...]]) -> dict[tuple[str, int], list[float]]:
    """Inner edges of quantile bins, duplicates dropped, for every column and number of bins; one scan."""
    every = sorted({i / q for qs in specs.values() for q in qs for i in range(q + 1)})
    found = profiles(df, list(specs), every)
    out = {}
    for c, qs in specs.items():
        for q in qs:
            edges = found[c].quantiles and sorted({found[c].quantiles[every.index(i / q)] for i in range(q + 1)})
            out[c, q] = list(edges[1:-1]) if edges else []
    return out


def one_hot_columns(df: DataFrame, specs: Mapping[str, tuple[int, ...]]) -> DataFrame:
    """`df` with <column>_q<bins>_<i> from 1: indicators of right-closed quantile bins. A column with one bin gets none."""
    more: dict[str, Column] = {}

    def below(c: str, edges: list[float]) -> Column:
        x = F.col(c).cast("double")
        return F.when(x.isNotNull(), F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < x)))

    for (c, q), inner in bins_of(df, specs).items():
        if inner:
            number = below(c, inner)
            more |= {f"{c}_q{q}_{i + 1}": F.coalesce((number == i).cast("int"), F.lit(0)) for i in range(len(inner) + 1)}
    return df.withColumns(more) if more else df


def ratio_columns(df: DataFrame, pairs: Mapping[str, tuple[str, str]], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Ratios, cut at their own percentiles, all of them from one scan; null on a zero denominator."""
    out = df.withColumns({k: safe_div(F.col(a), F.col(b)) for k, (a, b) in pairs.items()})
    found = profiles(out, list(pairs), [low, high])
    cut = lambda k: F.when(F.col(k).isNotNull(), F.greatest(F.least(F.col(k), F.lit(found[k].quantiles[1])), F.lit(found[k].quantiles[0])))
    return out.withColumns({k: cut(k) for k in pairs if found[k].n})


def _window_statistics(x: np.ndarray, months: tuple[int, ...], trends: tuple[int, ...]) -> np.ndarray:
    """rows x series x statistics of the months of each series (rows x series x months, NaN where missing)."""
    out: list[np.ndarray] = []

    def at(part: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.take_along_axis(part, np.clip(place, 0, part.shape[2] - 1)[:, :, None], axis=2)[:, :, 0]

    with np.errstate(all="ignore"):
        for n in months:
            part = x[:, :, :n]
            known = ~np.isnan(part)
            count = known.sum(2)
            mean = np.where(known, part, 0.0).sum(2) / count
            spread = np.where(known, (part - mean[:, :, None]) ** 2, 0.0).sum(2)
            ordered = np.sort(part, axis=2)  # missing values last
            middle = (at(ordered, (count - 1) // 2) + at(ordered, count // 2)) / 2
            last = at(part, n - 1 - np.argmax(known[:, :, ::-1], axis=2))
            some = count > 0
            out += [mean, np.where(count > 1, np.sqrt(spread / (count - 1)), np.nan), *[np.where(some, v, np.nan) for v in (ordered[:, :, 0], at(ordered, count - 1), middle, last)]]
        known = ~np.isnan(x)
        out += [at(x, np.argmax(known, axis=2)), at(x, x.shape[2] - 1 - np.argmax(known[:, :, ::-1], axis=2))]
        for n in trends:
            part, place = x[:, :, :n], np.arange(1, n + 1) - (n + 1) / 2
            known = ~np.isnan(part)
            count = known.sum(2)
            mean = np.where(known, part, 0.0).sum(2) / count
            d = np.where(known, part - mean[:, :, None], 0.0)
            xy, xx, total = (d * place).sum(2), (known * place**2).sum(2), (d * d).sum(2)
            slope = xy / (n * (n * n - 1) / 12)
            rest = total - 2 * slope * xy + slope * slope * xx
            out += [np.where(count > 0, slope, np.nan), mean - slope * (n + 1) / 2, np.where(total > 1e-12, 1 - rest / total, np.nan)]
    return np.stack(out, axis=2)


def window_arrays(df: DataFrame, key: str, series: list[str], months: tuple[int, ...] = (3, 6, 9, 12), trends: tuple[int, ...] = (3, 6, 12), width: int = 12, out: str = "features") -> tuple[DataFrame, list[str]]:
    """key with one array of mean, std, min, max, median and last of months 1..L, first and last value, and slope,
    intercept and r2 of every series, from its columns <series>_m1 .. _m<width>; and the names of its elements.

    All statistics of a batch of accounts are array operations in the task, so the plan holds one array, not a term for
    each statistic. Missing months count as in `features.rolling` and `features.trend`.
    """
    names = [f"{m}_{n}" for n in months for m in ("mean", "std", "min", "max", "median", "last")] + ["first_value", "last_value"] + [f"{m}_{n}" for n in trends for m in ("slope", "intercept", "r2")]
    packed = df.select(key, F.array(*[F.coalesce(F.col(f"{s}_m{m}").cast("double"), F.lit(float("nan"))) for s in series for m in range(1, width + 1)]).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            made = _window_statistics(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, len(series), width), months, trends).reshape(n, len(series) * len(names))
            flat = pa.array(made.ravel(), pa.float64(), mask=np.isnan(made).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * made.shape[1], flat)], names=[key, out])

    return packed.mapInArrow(run, f"`{key}` {dict(df.dtypes)[key]}, `{out}` array<double>"), [f"{s}_{name}" for s in series for name in names]


def window_columns(df: DataFrame, key: str, series: list[str], months: tuple[int, ...] = (3, 6, 9, 12), trends: tuple[int, ...] = (3, 6, 12), width: int = 12) -> DataFrame:
    """key with a column for each element of `window_arrays`."""
    made, names = window_arrays(df, key, series, months, trends, width, "__features")
    return made.select(key, *[F.col("__features")[i].alias(c) for i, c in enumerate(names)])
