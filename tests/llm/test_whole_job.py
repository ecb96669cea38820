"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

import hashlib
import random

from arrearium.llm import decontaminate, license_scan, near_dedup, suffix_dedup

P = "the quick brown fox jumps over the lazy dog while seven wizards brew strong potions under a pale moon and sing of old rivers that run to the sea"


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_license_several_notices(spark):
    """Every notice that stands word for word is found, in pairs and with all of them in one text."""
    t = license_scan.TEMPLATES
    texts = [([a, b], f"{a[1]} some code in between {b[1]}") for i, a in enumerate(t) for b in t[i + 1 :]] + [(t, " and then ".join(x[1] for x in t))]
    got = {r.doc_id: set(r.labels.split(",")) for r in license_scan.license_scan(docs_of(spark, [(i, x) for i, (_, x) in enumerate(texts)])).collect()}
    lost = [(i, {x[0] for x in held} - got[i]) for i, (held, _) in enumerate(texts) if {x[0] for x in held} - got[i]]
    assert not lost


def unique(n):
    return " ".join(f"u{n}w{i}" for i in range(40))


def test_near_copies_go_by_row(spark):
    """Unique rows that share an id with a near copy, or have none as it has, stay; so do all texts without words."""
    rows = [(9, P), (None, P + " again"), (None, P), (None, P), (None, unique(1)), (None, ""), (None, ""), (None, None), (3, unique(2)), (7, unique(2) + " end"), (7, unique(3)), (7, unique(3)), (8, unique(4)), (8, unique(5))]
    want = [(9, P), (None, unique(1)), (None, ""), (None, ""), (None, None), (3, unique(2)), (7, unique(3)), (8, unique(4)), (8, unique(5))]
    order = lambda x: sorted(map(repr, x))
    assert order(tuple(r) for r in near_dedup.drop_near_copies(docs_of(spark, rows)).collect()) == order(want)


def test_leaks_go_by_row(spark):
    rows = [(None, "x " + P), (None, unique(1)), (None, None), (7, P), (7, unique(2)), (1, unique(3))]
    bench = spark.createDataFrame([(1, P)], "item_id bigint, text string")
    got = sorted(repr(tuple(r)) for r in decontaminate.decontaminate(docs_of(spark, rows), bench).collect())
    assert got == sorted(map(repr, [rows[1], rows[2], rows[4], rows[5]]))


def test_suffix_hot_owner(spark):
    """A phrase between ever different neighbours: its owner's contexts don't meet in one task, and the result is exact."""
    rnd = random.Random(4)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    phrase = "THE COMMON PHRASE OF SOME SEVENTY BYTES THAT STANDS IN A THIRD OF ALL"
    sides = [noise(40) for _ in range(6)]
    rows = [(i, noise(120) + (sides[i % 6] if i % 2 else noise(40)) + phrase + (sides[i % 5] if i % 3 else noise(40)) + noise(120)) for i in range(90)]
    seen, want = set(), {}
    for i, t in rows:
        b, gone = t.encode(), bytearray(len(t))
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(b[s : s + 100])
        want[i] = (sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    d = docs_of(spark, rows)
    for hot_bytes in (1, 2000, 10**9):
        assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(d, hot_bytes=hot_bytes).collect()} == want
    assert sum(w[0] for w in want.values()) > 1000
    heads = spark.createDataFrame([(1, 100)] * 50 + [(2, 100)] * 3, "owner bigint, length int")
    assert {tuple(r) for r in suffix_dedup.mark_hot(heads, 2000).select("owner", "hot").collect()} == {(1, True), (2, False)}
