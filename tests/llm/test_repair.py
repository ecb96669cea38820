"""Conversation repair: the search against exhaustive search, the whole query against plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from arrearium.llm import conversation_repair as repair

ROWS = "suaxSUAXd"


def exhaustive(rows: str, i: int, state: int, ends: tuple, run: int = 0):
    """Every path with at most three inserts in a row, as (cost, audit)."""
    out = [(0, "")] if i == len(rows) and state in ends else []
    ways = []
    follow = 3 if state == 2 else 2
    if run < 3:
        ways.append((5, "I", i, follow, run + 1))
    if i < len(rows):
        c = rows[i]
        ways.append((2, "D", i + 1, state, 0))
        if c != "d":
            more = 5 * c.isupper()
            ways.append((1 + more, "R", i + 1, follow, 0))
            if c in "sS" and state == 0:
                ways.append((more, "K", i + 1, 1, 0))
            if c in "uU" and state != 2 or c in "aA" and state == 2:
                ways.append((more, "K", i + 1, follow, 0))
    for cost, edit, j, to, r in ways:
        rest = exhaustive(rows, j, to, ends, r)
        if rest:
            out.append((cost + rest[0], edit + rest[1]))
    return min(out, default=None)


def test_cheapest_is_exhaustive_search():
    draw = random.Random(1)
    for k in range(150):
        rows = "".join(draw.choice(ROWS) for _ in range(draw.randint(0, 4)))
        for start, ends in ((0, (0, 3)), (draw.randrange(4), (draw.randrange(4),))):
            assert repair.cheapest(rows, start, ends) == exhaustive(rows, 0, start, ends), (rows, start, ends)


def test_matrices_of_pieces_multiply():
    draw = random.Random(2)
    for _ in range(40):
        rows = "".join(draw.choice(ROWS) for _ in range(draw.randint(3, 30)))
        cuts = sorted(draw.sample(range(len(rows) + 1), 3))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        assert repair.folded([repair.matrix(p) for p in parts]) == repair.matrix(rows)
        whole = repair.folded([repair.matrix(p) for p in parts])
        assert min(x for x in (whole[0], whole[3]) if x) == repair.cheapest(rows, 0, (0, 3))


def plain(rows):
    """The contract in plain Python: conv_id -> the row of the query."""
    out = {}
    for conv in {r[0] for r in rows}:
        kept = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            say = lambda x: " " if x is None else str(x)
            role, text = say(role), say(text)
            hit = zlib.crc32(f"{say(c)}:{say(turn)}".encode()) % 20
            if hit == 1:
                text = ""
            if hit == 2:
                text = "".join(x for x in text if x not in ".!?")
            if hit == 4:
                role = "user"
            kept += [] if hit == 0 else [(turn, role, text)] * (2 if hit == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in kept:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = {t for t, _, _ in kept if t is not None}
        lattice = "".join(repair.symbol(r[1][:1], f) for r, f in zip(kept, faults, strict=True))
        best = {(0, 0): (0, "")}
        for i in range(len(lattice) + 1):  # inserts first, then the row
            for _ in range(4):
                for s in range(4):
                    if (i, s) in best:
                        c, a = best[i, s]
                        to = (i, 3 if s == 2 else 2)
                        best[to] = min(best.get(to, (9**9, "")), (c + 5, a + "I"))
            if i < len(lattice):
                for s in range(4):
                    if (i, s) in best:
                        for c, e, to in repair._edits(lattice[i], s):
                            new = (best[i, s][0] + c, best[i, s][1] + e)
                            best[i + 1, to] = min(best.get((i + 1, to), (9**9, "")), new)
        cost, audit = min(best[len(lattice), s] for s in (0, 3) if (len(lattice), s) in best)
        state, lines, at = 0, [], 0
        for e in audit:
            row = None
            if e != "I":
                row, at = kept[at], at + 1
            if e == "D":
                continue
            if e == "K":
                state = {"s": 1, "u": 2, "a": 3}[row[1][0]]
                lines.append(f"{row[1]}:{row[2]}")
            else:
                state = 3 if state == 2 else 2
                lines.append(f"{'user' if state == 2 else 'assistant'}:{row[2] if row else ''}")
        initials = [r[1][:1] for r in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r[0]: tuple(r[1:]) for r in repair.repair(df).collect()}
    want = plain(rows)
    assert len(got) == len(want)
    for k, w in want.items():
        assert got[k] == w, (k, got[k], w)


def test_repair_is_plain_python(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_edges(spark):
    draw = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "no", "", None, " \n", "What? ", "ü!", "x" * 30000]
    rows = [(c, draw.choice([None, 0, 1, 2, 3, 9]), draw.choice(roles), draw.choice(texts)) for c in [*range(40), None] for _ in range(draw.randint(1, 9))]
    check(spark, rows + rows[:20])
    got = {r.conv_id: r for r in repair.repair(spark.createDataFrame([(k, 0, "user", "Hi.") for k in range(60)], "conv_id bigint, turn bigint, role string, text string")).collect()}
    gone = [k for k in range(60) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    assert gone and all(tuple(got[k])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in gone)
    assert repair.repair(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string, fault string, n int")).count() == 0


@pytest.mark.parametrize("segment", [5, 256])
def test_long_conversation_is_cut_over_partitions(spark, monkeypatch, segment):
    """One conversation with most rows, some of them repeated: over several partitions the result is the same."""
    monkeypatch.setattr(repair, "SEGMENT", segment)
    draw = random.Random(4)
    rows = [(7, t if t % 50 else None, draw.choice(["user", "assistant", "user", "system"]), draw.choice([f"Text {t}.", f"cut {t}", "Same.", ""])) for t in range(700)]
    rows += [(c, t, "user", f"{t}.") for c in (1, 9) for t in range(5)]
    check(spark, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
        got = {r[0]: tuple(r[1:]) for r in repair.repair(df).collect()}
        assert got == plain(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
