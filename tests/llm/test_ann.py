"""Nearest neighbours: recall against brute force, exact scores, defined results, and blocks of any size."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrearium.llm import ann, queries

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(rows, k=20, every=20):
    """(query row, rank, vec_id, score) by plain double arithmetic; rows with unusable vectors take no part."""
    fine = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in fine), default=0)
    x = np.array([[*map(float, np.float32(v)), *[0.0] * (width - len(v))] for _, v in fine]).reshape(len(fine), width)
    out = []
    for q, (i, _) in enumerate(fine):
        if i % every == 0:
            score = (x * x[q]).sum(axis=1)
            near = sorted((-score[j], fine[j][0], j) for j in range(len(fine)) if j != q)[:k]
            out.append((i, [(n, -s) for s, n, _ in near]))
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def recall(got, want):
    hits = sum(len({n for n, _ in got[i]} & {n for n, _ in near}) for i, near in want)
    return hits / sum(len(near) for _, near in want)


def test_recall_on_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()]
    want = brute(rows)
    got = found(queries.op11_nearest_neighbours(spark, "/root/testdata/sf0.1"))
    assert len(got) == len(want) and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.99
    exact = {i: dict(near) for i, near in want}
    assert all(s == pytest.approx(exact[i][n], rel=1e-12) for i, near in got.items() for n, s in near if n in exact[i])


def test_lists_blocks_and_bounds(spark, monkeypatch):
    """Clustered vectors in many lists, with a third of all rows the same vector: small blocks give the same rows."""
    draw = np.random.default_rng(5)
    centre = draw.standard_normal((30, 24)) * 3
    rows = [(i, (centre[i % 30] + 0.3 * draw.standard_normal(24)).astype(np.float32).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[0][1]) for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "QUERY_ROWS", 16)
    monkeypatch.setattr(ann, "CHUNK", 7)
    want = brute(rows)
    got = found(ann.nearest(df, F.pmod("vec_id", F.lit(20)) == 0, lists=30))
    assert recall(got, want) >= 0.98
    near = dict(want)[2000]
    assert [n for n, _ in got[2000]] == [n for n, _ in near]  # ties go to the smaller ids
    index, codes = ann.build_index(ann.valid_rows(df, F.pmod("vec_id", F.lit(20)) == 0, "vec_id", "embedding"), 30)
    assert ann.measured_probes(index, codes, 20) <= 6
    part = index.filter("list = 3").toPandas()
    asked = part.head(5).rename(columns={"rid": "qid", "vec_id": "query_id", "vec": "qvec"})[["qid", "query_id", "qvec"]]
    ranked = ann.rank_block(part, asked, codes, 5)
    assert len(ranked) == 25 and set(ranked["qid"]) == set(asked["qid"]) and not (ranked["qid"] == ranked["rid"]).any()


def test_error_bound_holds():
    """Estimates from the codes are unbiased, and the stated bound covers nearly all errors."""
    draw = np.random.default_rng(6)
    x, q = draw.standard_normal((500, 48)), draw.standard_normal((200, 48))
    codes = ann.Codes(x[:7].copy(), ann.rotation(48))
    own, code, norm, dot = codes.encode(x)
    bits = codes.rotation.shape[1]
    signs = np.unpackbits(code, axis=1).astype(float) * 2 - 1
    guess = (q @ codes.centres.T)[:, own] + norm * ((q @ codes.rotation) @ signs.T / np.sqrt(bits)) / dot
    error = guess - q @ x.T
    bound = norm * np.sqrt(1 - dot**2) / dot * ann.ERROR / np.sqrt(bits - 1) * np.linalg.norm(q, axis=1)[:, None]
    assert (np.abs(error) <= bound + 1e-9).mean() > 0.995 and abs(error.mean()) < 0.01


def test_edges(spark):
    rows = [
        (0, [1.0, 0.0]), (20, [1.0, 1.0, 1.0]), (1, [0.0, 0.0]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, []),
        (7, [2.0, 0.0]), (8, [2.0, 0.0]), (-20, [-1.0, 0.5]), (40, [3.0, 4.0]), (40, [3.0, 4.0]),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)).withColumn("rank", F.lit("x"))
    got = ann.nearest(df, F.pmod("vec_id", F.lit(20)) == 0, k=3).collect()
    want = brute(rows, 3)
    assert len(got) == sum(len(near) for _, near in want)
    for i in (0, 20, -20):
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == dict(want)[i]
    assert sorted((r["rank"], r.vec_id) for r in got if r.query_id == 40) == sorted((k + 1, n) for i, near in want if i == 40 for k, (n, _) in enumerate(near))
    assert ann.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(spark.createDataFrame([(0, [1.0])], SCHEMA), F.col("vec_id") == 0).count() == 0
