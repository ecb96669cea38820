"""Approximate nearest neighbours by randomly rotated one-bit codes, nearness being the largest inner product.

Every vector x is written as centre + norm * o, o of length one. A random rotation into CODE_BITS dimensions or more
turns o into a code of one sign bit a dimension. With the code's own inner product <code, o> kept as a correction
scalar, <code, q> / <code, o> estimates <o, q> without bias, and its error is below ERROR * |q| * sqrt(1 / <code, o>^2
- 1) / sqrt(bits - 1) but with a small probability. Of the rows that share a task, the 2 k with the best estimates give
an exact k-th best product, and all whose upper bound reaches it are ranked again by exact inner products in double
precision; nothing else is dropped.

Centres come from k-means on a sample of about FIT_ROWS rows, one for LIST_ROWS rows and MAX_LISTS at most; every row
is indexed, in the list of its nearest centre. A query looks into the lists with the largest inner products; how many
is measured: CALIBRATION queries are answered by brute force (one scan), and the fewest lists are taken that hold
RECALL of their neighbours. On clustered vectors that is a few lists, on shapeless ones nearly all, so recall
doesn't depend on the data. Long lists, and lists that many queries look into, are dealt in blocks, so a task holds
BLOCK_ROWS vectors and QUERY_ROWS queries whatever the data; of equal vectors in a block only the k + 1 smallest ids
can be among k neighbours, and the others aren't ranked.

Defined results: vectors that are null, zero or hold null or non-finite components, and rows without an id, take no
part. Vectors of unequal length are compared on the components that both have (the shorter is extended by zeros). Rows
with a repeated id are rows of their own: each is a candidate of the others and, if a query, has its own k rows. Ties
go to the smaller id. An empty table, or one with a single vector, gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import durable

K = 20
CODE_BITS = 256
#: Standard deviations that the error bound covers.
ERROR = 3.0
FIT_ROWS, LIST_ROWS, MAX_LISTS, ROUNDS = 65_536, 4096, 4096, 10
CALIBRATION, RECALL = 64, 0.99
BLOCK_ROWS, QUERY_ROWS, CHUNK = 8192, 2048, 256
SEED = 11

INDEX = "rid bigint, vec_id bigint, is_query boolean, list int, vec binary, code binary, norm double, dot double"
FOUND = "qid bigint, query_id bigint, rid bigint, vec_id bigint, score double"


@dataclass(frozen=True)
class Codes:
    """What tasks need to encode and to estimate: centres (lists x d) and the rotation (d x bits)."""

    centres: np.ndarray
    rotation: np.ndarray

    @property
    def size(self) -> int:
        return self.centres.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(list, packed code, norm, correction) of each row of `x`."""
        own = np.argmax(x @ self.centres.T - (self.centres**2).sum(1) / 2, axis=1)
        rest = x - self.centres[own]
        norm = np.sqrt((rest * rest).sum(1))
        turned = rest @ self.rotation
        bits = self.rotation.shape[1]
        dot = np.abs(turned).sum(1) / (math.sqrt(bits) * np.where(norm > 0, norm, 1.0))
        return own, np.packbits(turned > 0, axis=1), norm, np.where(norm > 0, dot, 1.0)


def rotation(size: int, bits: int = CODE_BITS, seed: int = SEED) -> np.ndarray:
    """A random orthogonal map of `size` dimensions into a multiple of 64, `bits` at least."""
    bits = -(-max(bits, size) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, size)))
    return np.ascontiguousarray((q * np.sign(np.diag(r))).T)


def k_means(x: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centres of a bounded sample; an empty list keeps its centre."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([np.argmax(part @ centres.T - (centres**2).sum(1) / 2, axis=1) for part in np.array_split(x, len(x) // 4096 + 1)])
        count = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def matrix(cells: pd.Series, size: int, dtype: str = "<f8") -> np.ndarray:
    """Rows of packed numbers as a matrix; shorter rows are extended by zeros."""
    width = np.dtype(dtype).itemsize * size
    return np.frombuffer(b"".join(c.ljust(width, b"\0") for c in cells), dtype=dtype).reshape(len(cells), size)


def padded(vectors: pd.Series, size: int) -> np.ndarray:
    """Arrays of numbers as a matrix; shorter ones are extended by zeros."""
    out = np.zeros((len(vectors), size))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision; equal rows give equal results wherever they stand."""
    return (x * q).sum(axis=-1)


def valid_rows(vectors: DataFrame, is_query: Column, id_col: str, vector_col: str) -> DataFrame:
    """(rid, vec_id, is_query, vec) of the rows that take part, `rid` being a key of the row."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists(v, lambda x: x != 0)  # NaN is above infinity
    rows = vectors.filter(F.col(f"`{id_col}`").isNotNull() & F.coalesce(fine, F.lit(False)))
    return durable(rows.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), v.alias("v")))


def build_index(rows: DataFrame, lists: int | None = None) -> tuple[DataFrame, Codes] | None:
    """The index of all rows of `valid_rows`, and its codes; None without rows."""
    n, size = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return None
    lists = lists or min(MAX_LISTS, -(-n // LIST_ROWS))
    drawn = rows.filter(F.rand(SEED) * n < FIT_ROWS) if n > FIT_ROWS else rows
    codes = Codes(k_means(padded(drawn.limit(2 * FIT_ROWS).select("v").toArrow()["v"].to_pandas(), size), lists), rotation(size))

    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = padded(part["v"], codes.size)
                own, code, norm, dot = codes.encode(x)
                part = part.drop(columns="v")
                yield part.assign(list=own.astype("int32"), vec=[row.tobytes() for row in x], code=[row.tobytes() for row in code], norm=norm, dot=dot)

    return durable(rows.mapInPandas(encode, INDEX)), codes


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, ranked; what each task has beyond k is dropped before the shuffle."""
    order = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id", "rid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def brute_force(index: DataFrame, size: int, queries: list[tuple[int, int, bytes]], k: int) -> DataFrame:
    """FOUND rows of a bounded list of queries (rid, vec_id, vector), each task's k best: one scan of the index."""
    qid = np.array([q for q, _, _ in queries])
    asked = [np.frombuffer(v, "<f8") for _, _, v in queries]

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for part in parts:
            if not len(part):
                continue
            x, rid, vec_id = matrix(part["vec"], size), part["rid"].to_numpy(), part["vec_id"].to_numpy()
            new = pd.concat([pd.DataFrame({"qid": qid[i], "query_id": queries[i][1], "rid": rid, "vec_id": vec_id, "score": exact(x, q)})[rid != qid[i]] for i, q in enumerate(asked)])
            best = new if best is None else pd.concat([best, new])
            best = best.sort_values(["qid", "score", "vec_id", "rid"], ascending=[True, False, True, True]).groupby("qid").head(k)
        if best is not None:
            yield best

    return index.select("rid", "vec_id", "vec").mapInPandas(scan, FOUND)


def measured_probes(index: DataFrame, codes: Codes, k: int, share: float = RECALL, count: int = CALIBRATION) -> int:
    """The fewest lists a query has to look into so that they hold `share` of the neighbours of `count` queries."""
    asked = index.filter("is_query").orderBy(F.xxhash64("vec_id", "vec"), "rid").limit(count).select("rid", "vec_id", "vec").collect()
    if not asked:
        return 1
    near = best_of(brute_force(index, codes.size, [(r.rid, r.vec_id, bytes(r.vec)) for r in asked], k), k).select("qid", "rid")
    held = near.join(index.select("rid", "list"), "rid").groupBy("qid", "list").count().collect()
    order = np.argsort(-(np.stack([np.frombuffer(r.vec, "<f8") for r in asked]) @ codes.centres.T), axis=1, kind="stable")
    place = {r.rid: np.argsort(o) for r, o in zip(asked, order, strict=True)}
    counts = np.zeros(len(codes.centres))
    for r in held:
        counts[place[r.qid][r.list]] += r["count"]
    if not counts.sum():
        return 1
    return int(np.searchsorted(np.cumsum(counts) / counts.sum(), share - 1e-12)) + 1


def rank_block(near: pd.DataFrame, asked: pd.DataFrame, codes: Codes, k: int, error: float = ERROR) -> pd.DataFrame:
    """FOUND rows: the k best of a block of one list for each query of a block, estimated by codes and ranked exactly."""
    if not len(near) or not len(asked):
        return pd.DataFrame({"qid": [], "query_id": [], "rid": [], "vec_id": [], "score": []})
    near = near.sort_values(["vec", "vec_id", "rid"]).groupby("vec", sort=False).head(k + 1)
    size, (_, bits) = codes.size, codes.rotation.shape
    x, rid, vec_id = matrix(near["vec"], size), near["rid"].to_numpy(), near["vec_id"].to_numpy()
    norm, dot = near["norm"].to_numpy(), near["dot"].to_numpy()
    signs = (np.unpackbits(np.frombuffer(b"".join(near["code"]), np.uint8).reshape(len(near), -1), axis=1).astype(np.float32) * 2 - 1).T
    signs *= (norm / dot / math.sqrt(bits)).astype(np.float32)
    bound = (norm * (np.sqrt(np.maximum(1 - dot * dot, 0)) / dot * error / math.sqrt(bits - 1) + 1e-5)).astype(np.float32)
    centre = codes.centres[int(near["list"].iloc[0])]
    first = min(2 * k, len(near))
    out = []
    for at in range(0, len(asked), CHUNK):
        part = asked.iloc[at : at + CHUNK]
        q, qid = matrix(part["qvec"], size), part["qid"].to_numpy()
        length = np.sqrt((q * q).sum(1))
        unit = q / length[:, None]
        guess = (unit @ codes.rotation).astype(np.float32) @ signs
        guess += (unit @ centre).astype(np.float32)[:, None]
        guess[rid[None, :] == qid[:, None]] = -np.inf
        keep, least = guess > -np.inf, np.full(len(part), -np.inf)
        if len(near) > first:
            # The k-th best exact product of those that look best is reached by k rows, so what can't reach it is out.
            best = np.argpartition(guess, len(near) - first, axis=1)[:, len(near) - first :]
            score = exact(x[best], q[:, None, :])
            score[~np.isfinite(np.take_along_axis(guess, best, axis=1))] = -np.inf
            least = np.partition(score, first - k, axis=1)[:, first - k]
            keep &= guess + bound >= ((least - 1e-6 * np.abs(least)) / length).astype(np.float32)[:, None]
        i, j = np.nonzero(keep)
        score = np.concatenate([exact(x[j[a : a + 4096]], q[i[a : a + 4096]]) for a in range(0, len(i), 4096)] or [np.zeros(0)])
        reach = score >= least[i]
        i, j, score = i[reach], j[reach], score[reach]
        order = np.lexsort((rid[j], vec_id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        top = np.arange(len(i)) - np.searchsorted(i, i) < k  # counted from where each query's rows begin
        i, j = i[top], j[top]
        out.append(pd.DataFrame({"qid": qid[i], "query_id": part["query_id"].to_numpy()[i], "rid": rid[j], "vec_id": vec_id[j], "score": score[top]}))
    return pd.concat(out)


def look_up(index: DataFrame, codes: Codes, probes: int, k: int, error: float = ERROR) -> DataFrame:
    """FOUND rows of all queries of the index against the lists that they look into, block by block."""
    spark = index.sparkSession
    probes = min(probes, len(codes.centres))

    def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                order = np.argsort(-(matrix(part["qvec"], codes.size) @ codes.centres.T), axis=1, kind="stable")[:, :probes]
                again = np.repeat(np.arange(len(part)), probes)
                yield part.iloc[again].assign(list=order.ravel().astype("int32"))

    queries = index.filter("is_query").select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"))
    asked = queries.mapInPandas(choose, "qid bigint, query_id bigint, qvec binary, list int")
    held = dict(index.groupBy("list").count().collect())
    wanted = dict(asked.groupBy("list").count().collect())
    blocks = [(i, -(-n // BLOCK_ROWS), -(-wanted[i] // QUERY_ROWS)) for i, n in held.items() if i in wanted]  # one row a list, MAX_LISTS at most
    blocks = F.broadcast(spark.createDataFrame(blocks, "list int, parts int, askers int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    near = index.join(blocks, "list").select("list", own("rid", "parts").alias("part"), every("askers").alias("asker"), "rid", "vec_id", "vec", "code", "norm", "dot")
    asked = asked.join(blocks, "list").select("list", every("parts").alias("part"), own("qid", "askers").alias("asker"), "qid", "query_id", "qvec")
    key = ["list", "part", "asker"]
    return near.groupBy(*key).cogroup(asked.groupBy(*key)).applyInPandas(lambda a, b: rank_block(a, b, codes, k, error), FOUND)


def nearest(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, lists: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row with `is_query` among all other rows."""
    built = build_index(valid_rows(vectors, is_query, id_col, vector_col), lists)
    if built is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    index, codes = built
    found = look_up(index, codes, measured_probes(index, codes, k, recall), k)
    return best_of(found, k).select("query_id", "rank", "vec_id", "score")
