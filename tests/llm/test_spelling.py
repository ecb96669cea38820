"""Spelling variants against plain Python on small and adversarial tables."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from arrearium.llm import spelling_variants as op


def counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    words = counts(rows)
    out = {}
    for w, n in words.items():
        own = [v for v in words if near(w, v)]
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form = best if best is not None and words[best] >= 10 * n else None
        out[w] = [form, None, n, len(own), words[form] if form else None]
    for w, r in out.items():
        at = w
        while out[at][0]:
            at = out[at][0]
        r[1] = at
    return {w: tuple(r) for w, r in out.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(0))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in op.spelling_variants(df).collect()}
    assert got == plain(rows)
    return got


def test_variants_are_plain_python(spark):
    draw = random.Random(1)
    base = ["".join(draw.choice("abcdeé") for _ in range(draw.randint(7, 10))) for _ in range(60)]
    rows = []
    for d in range(250):
        words = []
        for _ in range(40):
            w = base[min(int(draw.expovariate(0.25)), 59)]
            if draw.random() < 0.15:
                k, c = draw.randrange(len(w)), draw.choice("abcÀ")
                w = draw.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])
            words.append(w.upper() if draw.random() < 0.1 and w.isascii() else w)
        rows.append((d, draw.choice([" ", ", ", "1", "\n"]).join(words)))
    got = check(spark, rows)
    assert sum(r[3] for r in got.values()) > 100 and any(r[0] for r in got.values())


def test_chains_ties_and_edges(spark):
    """a form of a form, equal counts, one edit at either end and within a doubled letter, short words, nulls and repeated rows."""
    text = " ".join(["abcdefgh"] * 4000 + ["abcdefgi"] * 300 + ["abcdefji"] * 25 + ["abcdefki"] * 2 + ["zbcdefgh"] * 40 + ["bcdefgh"] * 30 + ["abcdefghx"] * 30 + ["aabbccdd"] * 50 + ["aabbcdd"] * 5 + ["aabbcccdd"] * 5 + ["sixlet"] * 9 + ["ÀÉÎÕÜñß"] * 20 + ["ÀÉÎÕÜñs"] * 2)
    long = "words" * 4000 + " " + "words" * 4000
    got = check(spark, [(1, text), (2, None), (3, ""), (None, "abcdefgh Abcdefgh"), (1, "abcdefgi abcdefgi"), (4, long)])
    assert got["abcdefki"][1] == "abcdefgh" and got["abcdefji"][0] == "abcdefgi" and "sixlet" not in got
    assert op.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_signatures_hold_every_pair(spark):
    """Each pair of near words shares a key of fitting roles, for any number of classes; candidates far apart are few."""
    draw = random.Random(2)
    words = list({"".join(draw.choice("abcd") for _ in range(draw.randint(7, 8))) for _ in range(250)})
    df = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    found = {(r.a, r.b) for r in op.near_pairs(df).collect()}
    want = {tuple(sorted((a, b), key=lambda x: (len(x), x))) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}
    assert {tuple(sorted(p, key=lambda x: (len(x), x))) for p in found} == want and len(found) == len(want) > 20
