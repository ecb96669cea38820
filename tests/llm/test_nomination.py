"""Nomination by rare words: no alignment that reaches the coverage is without a nominating word, and few words nominate."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from arrearium.llm import license_scan as scan


def test_rare_words_hold_every_alignment_that_counts(spark):
    draw = random.Random(1)
    rows = [(w, t, i, float(draw.choice([0.5, 1.0, 3.0, 7.0, 9.0]))) for w, t, _, i, _ in scan.postings()]
    weighed = spark.createDataFrame(rows, "word string, t int, tpos int, idf double")
    totals = weighed.groupBy("t").agg(F.sum("idf").alias("whole"))
    rare = {(r.t, r.tpos) for r in scan.rare_postings(weighed, totals, scan.COVERAGE).collect()}
    for t in {r[1] for r in rows}:
        own = [(p, x) for _, k, p, x in rows if k == t]
        whole, rest = sum(x for _, x in own), sum(x for p, x in own if (t, p) not in rare)
        assert rest < scan.COVERAGE * whole and min(x for p, x in own if (t, p) in rare) >= max((x for p, x in own if (t, p) not in rare), default=0)
    assert len(rare) < 0.6 * len(rows)


def test_words_that_do_not_nominate_propose_nothing(spark):
    """Texts full of a notice's commoner words, and some with whole notices: labels are those of the notices."""
    notice = next(n for label, n, _ in scan.TEMPLATES if label == "gpl-2")
    rows = [(i, "license public general version " * 50) for i in range(20)] + [(100, f"x {notice} y"), (101, " ".join(n for _, n, _ in scan.TEMPLATES))]
    got = {r.doc_id: r.labels for r in scan.license_scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[i] == "" for i in range(20)) and got[100] == "gpl-2"
    assert set(got[101].split(",")) >= {label for label, _, _ in scan.TEMPLATES}
