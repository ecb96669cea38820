"""Best prefixes of ranged rows for many columns at once.

A profit-optimal cut-off is the largest running sum in the order of a score. Here one sorted pass gives it for any number
of columns together (replicates of a bootstrap, cells of a grid): tasks hold a chunk of rows times the columns, and what
leaves a task is one row of sums for each group in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that a task computes at a time; they stay in the processor's cache.
CELLS = 1 << 17

#: Columns of a chunk of one group -> (counts, values, extra sums): counts and values are rows x width, extras have `width`
#: numbers each. If sums are wanted, it also gets where the runs of equal keys start, and counts and values are runs x width.
Make = Callable[..., tuple[np.ndarray, np.ndarray, list[np.ndarray]]]


@dataclass
class Best:
    """For each column: rows and value in all, the best prefix (its value, rows and last key; zeros if none is positive), extra sums."""

    n: np.ndarray
    total: np.ndarray
    best: np.ndarray
    best_n: np.ndarray
    best_at: np.ndarray
    extras: list[np.ndarray]


class _Run:
    """A group's rows in one partition, in order."""

    def __init__(self, width: int, extras: int) -> None:
        self.n, self.total = np.zeros(width), np.zeros(width)
        self.best, self.best_n, self.best_at = np.full(width, -np.inf), np.zeros(width), np.zeros(width)
        self.extras = [np.zeros(width) for _ in range(extras)]
        self.first: float | None = None
        self.last: float | None = None

    def offer(self, value: np.ndarray, n: np.ndarray, at: np.ndarray | float) -> None:
        better = value > self.best
        self.best, self.best_n, self.best_at = np.where(better, value, self.best), np.where(better, n, self.best_n), np.where(better, at, self.best_at)

    def add(self, keys: np.ndarray, counts: np.ndarray, values: np.ndarray, extras: list[np.ndarray]) -> None:
        """A prefix ends where the next row has another key; the end of these rows is left open, also that of the last ones."""
        run, many = self.total + np.cumsum(values, axis=0), self.n + np.cumsum(counts, axis=0)
        if self.last is not None and keys[0] != self.last:
            self.offer(self.total, self.n, self.last)
        ends = np.flatnonzero(keys[1:] != keys[:-1])
        if len(ends):
            first = np.argmax(run[ends], axis=0)
            column = np.arange(run.shape[1])
            self.offer(run[ends[first], column], many[ends[first], column], keys[ends[first]])
        self.total, self.n, self.last = run[-1], many[-1], float(keys[-1])
        for mine, more in zip(self.extras, extras, strict=True):
            mine += more
        if self.first is None:
            self.first = float(keys[0])


def best_prefixes(rows: DataFrame, group: str, order: str, make: Make, width: int, extras: int = 0, sums: bool = False) -> dict[int, Best]:
    """The Best of each group (a small integer) of `rows`; rows with equal keys enter a prefix together.

    Rows are ranged by (group, key, a hash of the row), so a commonest key (a capped score) spreads over tasks. Sums of
    partitions, width numbers a few times for each, are put in order on the driver, where a partition's end is the end of a
    prefix if the group goes on with another key. With `sums`, `make` adds up the rows of a key itself.
    """
    step = max(CELLS // width, 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, _Run] = {}
        for batch in batches:
            data = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
            groups = data[group]
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                for at in range(a, b, step):
                    part = {k: v[at : min(at + step, b)] for k, v in data.items()}
                    run = runs.setdefault(int(groups[at]), _Run(width, extras))
                    keys = part[order]
                    if sums:
                        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
                        run.add(keys[starts], *make(int(groups[at]), part, starts))
                    else:
                        run.add(keys, *make(int(groups[at]), part))
        out = []
        for g, run in runs.items():
            out.append({"p": TaskContext.get().partitionId(), "g": g, "first": run.first, "last": run.last, "sums": np.stack([run.n, run.total, run.best, run.best_n, run.best_at, *run.extras]).tobytes()})
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("p", pa.int32()), ("g", pa.int32()), ("first", pa.float64()), ("last", pa.float64()), ("sums", pa.binary())]))

    spread = rows.filter(rows[order].isNotNull()).withColumn("__spread", F.xxhash64(*rows.columns))
    ordered = spread.repartitionByRange(group, order, "__spread").drop("__spread").sortWithinPartitions(group, order)
    found: dict[int, Best] = {}
    ends: dict[int, float] = {}

    def offer(mine: Best, value: np.ndarray, n: np.ndarray, at: np.ndarray | float) -> None:
        better = value > mine.best
        mine.best, mine.best_n, mine.best_at = np.where(better, value, mine.best), np.where(better, n, mine.best_n), np.where(better, at, mine.best_at)

    for r in sorted(ordered.mapInArrow(scan, "p int, g int, first double, last double, sums binary").collect(), key=lambda r: r["p"]):
        n, total, best, best_n, best_at, *more = np.frombuffer(r["sums"]).reshape(-1, width)
        mine = found.setdefault(r["g"], Best(np.zeros(width), np.zeros(width), np.zeros(width), np.zeros(width), np.zeros(width), [np.zeros(width) for _ in range(extras)]))
        if r["g"] in ends and ends[r["g"]] != r["first"]:
            offer(mine, mine.total, mine.n, ends[r["g"]])
        offer(mine, mine.total + best, mine.n + best_n, best_at)
        ends[r["g"]] = r["last"]
        mine.n, mine.total = mine.n + n, mine.total + total
        mine.extras = [a + b for a, b in zip(mine.extras, more, strict=True)]
    for g, mine in found.items():
        offer(mine, mine.total, mine.n, ends[g])
    return found
