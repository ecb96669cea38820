"""Compression classifier of text quality.

Two zstandard dictionaries are built from good and from bad labelled text. A text is cut into chunks and each
chunk compressed with either dictionary; the difference of the compressed sizes, normalised by the size, and
the ratio to the raw size go through a logistic function fitted on other labelled rows.

Fitting reads a bounded sample of labelled rows: at most FIT_ROWS of each class, those with the smallest hash of
their id, so that the sample doesn't depend on the partitioning. One half of them makes the dictionaries, from at
most DICT_CHUNKS chunks of each class, again those with the smallest hash, from anywhere in their whole texts; these
chunks are the only texts that reach the driver. The other half calibrates: its features are computed in tasks, of
whole texts, like those of the rows to score. Scoring is one map over Arrow batches of whole texts.

Defined results: null and empty texts have both features 0 and still get a score; a class without labelled rows
makes the score constant; without any labels it is 0.5; labels that are null, or whose document is missing, are
left out; of labelled rows that repeat an id and label one text, the smallest, is fitted; repeated rows are scored
one by one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable

FIT_ROWS = 1500
DICT_CHUNKS = 1500
DICT_BYTES = 65536
CHUNK = 4096
LEVEL = 3


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def build_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """Trained dictionary, or the raw text itself where there is too little to train on."""
    import zstandard as z

    total = sum(map(len, samples))
    if total > 16 * 1024 and len(samples) > 16:
        try:
            return z.train_dictionary(min(size, total // 8), samples).as_bytes()
        except z.ZstdError:
            pass
    return b"".join(samples)[-size:]


class Compressor:
    """Features of a text: normalised size difference and compression ratio."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as z

        self.good, self.bad = (z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(d)) if d else z.ZstdCompressor(level=LEVEL) for d in (good, bad))
        self.none = len(self.good.compress(b""))

    def features(self, text: str) -> tuple[float, float]:
        data = text.encode("utf-8", "replace")
        if not data:
            return 0.0, 0.0
        good = bad = 0
        for i in range(0, len(data), CHUNK):
            part = data[i : i + CHUNK]
            good += max(1, len(self.good.compress(part)) - self.none + 1)
            bad += max(1, len(self.bad.compress(part)) - self.none + 1)
        return 2.0 * (bad - good) / (bad + good), float(np.log(min(good, bad) / len(data)))


def _design(x: np.ndarray) -> np.ndarray:
    d, r = x[:, 0], x[:, 1]
    return np.column_stack([np.ones(len(x)), d, d * d, r, r * r])


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Coefficients of a logistic regression by Newton steps, lightly regularised."""
    a = _design(x)
    w = np.zeros(a.shape[1])
    keep = ridge * np.ones(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + keep * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _features(docs: DataFrame, good: bytes, bad: bytes, text: str, make, schema: T.StructType) -> DataFrame:
    """Arrow map that hands every batch and its rows' features to `make`."""

    def run(batches: Iterator) -> Iterator:
        of = Compressor(good, bad)
        for b in batches:
            yield make(b, np.array([of.features(t or "") for t in b.column(text).to_pylist()]).reshape(-1, 2))

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS, chunks: int = DICT_CHUNKS) -> dict:
    """Model (dictionaries and coefficients) from the given labelled rows; callers leave out what is held out."""
    import pyarrow as pa

    key = F.col(f"`{id_col}`")
    known = labels.filter(key.isNotNull() & F.col(label).isin(0, 1)).select(key.alias("__id"), F.col(label).cast("int").alias("__y")).distinct()
    order = F.xxhash64(F.col("__id").cast("string"))
    chosen = [known.filter(F.col("__y") == c).orderBy(order, "__id").limit(rows) for c in (0, 1)]
    sample = chosen[0].union(chosen[1])  # 2 * rows ids at most
    joined = docs.select(key.alias("__id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")).join(F.broadcast(sample), "__id")
    found = durable(joined.groupBy("__id", "__y").agg(F.min("t").alias("t")))
    n = found.count()
    half = F.pmod(F.xxhash64(F.lit(7), F.col("__id").cast("string")), F.lit(2)) == 0
    learn, rest = (found.filter(half), found.filter(~half)) if n >= 20 else (found, found)
    place = F.explode(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / CHUNK).cast("int")))
    pieces = learn.filter("t <> ''").select("__id", "__y", "t", place.alias("k")).select("__id", "__y", "k", F.substring(F.col("t"), F.col("k") * CHUNK + 1, F.lit(CHUNK)).alias("t"))
    made = {}
    for c, name in ((1, "good"), (0, "bad")):
        picked = pieces.filter(F.col("__y") == c).orderBy(F.xxhash64(F.col("__id").cast("string"), F.col("k")), "__id", "k").limit(chunks).collect()
        made[name] = build_dictionary([r["t"].encode("utf-8", "replace") for r in picked])
    schema = T.StructType([T.StructField("y", T.IntegerType()), T.StructField("d", T.DoubleType()), T.StructField("r", T.DoubleType())])
    make = lambda b, x: pa.RecordBatch.from_arrays([b.column("__y"), pa.array(x[:, 0], pa.float64()), pa.array(x[:, 1], pa.float64())], names=["y", "d", "r"])
    x = _features(rest, made["good"], made["bad"], "t", make, schema).orderBy("y", "d", "r").toPandas()  # three numbers for each row of the sample
    return made | {"w": calibrate(x[["d", "r"]].to_numpy(), x["y"].to_numpy()) if len(x) else [0.0] * 5}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` without the text and with the score (0 to 1) of every whole text."""
    import pyarrow as pa

    keep = [f for f in docs.schema.fields if f.name not in (text, out)]
    names = [f.name for f in keep]
    w = np.array(model["w"])

    def make(b: pa.RecordBatch, x: np.ndarray) -> pa.RecordBatch:
        p = 1 / (1 + np.exp(-np.clip(_design(x) @ w, -30, 30)))
        return pa.RecordBatch.from_arrays([*[b.column(n) for n in names], pa.array(p, pa.float64())], names=[*names, out])

    return _features(docs, model["good"], model["bad"], text, make, T.StructType([*keep, T.StructField(out, T.DoubleType())]))
