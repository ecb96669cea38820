"""Conversation structure repair: bidirectional Dijkstra over the edit lattice.

A node of the lattice is (rows read, state), the states being: nothing out yet, after a system turn, after a user turn,
after an assistant turn. Keep costs 0, Rerole 1, Delete 2, Insert 5, and a truncated row that stays 5 more. A forward
heap from the first node and a reverse heap from the accepting nodes meet; both go on while their least costs together
don't exceed the best crossing, so every crossing of equal cost is known, and of these the least concatenated audit
is taken. Both sides keep the ASCII-least audit of the cheapest paths at each node: no audit is a proper prefix of
another of the same cost at the same node, as only inserts would follow, and those cost something.

Spark orders the rows by ranges of (conversation, turn, role, text), so a conversation of any length is split over
tasks. A piece of SEGMENT rows is summed up as a 4 x 4 matrix over states of (cost, audit), by the same search from
each state to each; matrices multiply associatively, within a task and then over the few pieces that partitions cut.
A conversation whose rows stand in one partition is finished there. The digest of the repaired text is sequential by
its nature: rows are streamed, behind their conversation's audit, in batches through one task for each conversation,
which only hashes them.

Defined results: a null conv_id is one conversation; a null role or text is one space, and so is a null conv_id or
turn in the hashed key of the damage. Rows of a turn are ordered by role, then by the text's first HEAD code points,
then by a digest. Repeated rows are duplicates. A role without a first letter can't be kept. Rows are equal if the
128-bit digests of their role and text are. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, durable

SEGMENT, HEAD = 256, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}

#: What a state may be followed by without an edit, by initial, and what an insert or a new role leads to.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}

Label = tuple[int, str]
Matrix = list[Label | None]


def symbol(initial: str, fault: str) -> str:
    """A row as the lattice sees it: its initial (x if it can't be kept), upper case if truncated, d if it must go."""
    if fault in ("blank", "duplicate"):
        return "d"
    kind = initial if initial in KEPT else "x"
    return kind.upper() if fault == "truncated" else kind


def _edits(row: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, initial, next state) of the edits that use up a row."""
    out = [(DELETE, "D", state)]
    if row != "d":
        more = TRUNCATED if row.isupper() else 0
        out.append((REROLE + more, "R", NEXT[state]))
        if state in (kept := KEPT.get(row.lower(), {})):
            out.append((KEEP + more, "K", kept[state]))
    return out


@lru_cache(maxsize=None)
def _ahead(row: str) -> list[list[tuple[int, str, int]]]:
    return [_edits(row, state) for state in range(4)]


@lru_cache(maxsize=None)
def _behind(row: str) -> list[list[tuple[int, str, int]]]:
    """(cost, initial, earlier state) for each later state."""
    return [[(c, e, s) for s in range(4) for c, e, to in _edits(row, s) if to == state] for state in range(4)]


_INSERTED_BY = [[s for s, to in NEXT.items() if to == state] for state in range(4)]


@lru_cache(maxsize=1 << 15)
def cheapest(rows: str, start: int, ends: tuple[int, ...]) -> Label | None:
    """Least cost, and the ASCII-least audit of it, from `start` over all `rows` to one of `ends`."""
    n = len(rows)
    fore: dict[tuple[int, int], Label] = {(0, start): (0, "")}
    back: dict[tuple[int, int], Label] = {(n, e): (0, "") for e in ends}
    # Free edits only lead to later rows (earlier ones in reverse), so nodes of equal cost are settled in their order.
    ahead, behind = [(0, 0, start)], [(0, -n, e) for e in sorted(ends)]
    best = None
    for node in fore.keys() & back.keys():
        best = fore[node][0] + back[node][0]

    def reach(side: dict, other: dict, heap: list, node: tuple[int, int], label: Label, order: int) -> None:
        nonlocal best
        known = side.get(node)
        if known is None or label < known:
            side[node] = label
            if known is None or label[0] < known[0]:
                heappush(heap, (label[0], order * node[0], node[1]))
                if node in other and (best is None or label[0] + other[node][0] < best):
                    best = label[0] + other[node][0]

    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best):
        if (ahead[0][0], len(ahead)) <= (behind[0][0], len(behind)):
            cost, i, state = heappop(ahead)
            if cost > fore[i, state][0]:
                continue
            audit = fore[i, state][1]
            reach(fore, back, ahead, (i, NEXT[state]), (cost + INSERT, audit + "I"), 1)
            if i < n:
                for more, edit, to in _ahead(rows[i])[state]:
                    reach(fore, back, ahead, (i + 1, to), (cost + more, audit + edit), 1)
        else:
            cost, i, state = heappop(behind)
            i = -i
            if cost > back[i, state][0]:
                continue
            audit = back[i, state][1]
            for origin in _INSERTED_BY[state]:
                reach(back, fore, behind, (i, origin), (cost + INSERT, "I" + audit), -1)
            if i:
                for more, edit, origin in _behind(rows[i - 1])[state]:
                    reach(back, fore, behind, (i - 1, origin), (cost + more, edit + audit), -1)
    if best is None:
        return None
    return min((f[0] + back[node][0], f[1] + back[node][1]) for node, f in fore.items() if node in back)


def matrix(rows: str) -> Matrix:
    """Cheapest label from each state to each, in rows of four."""
    return [cheapest(rows, s, (t,)) for s in range(4) for t in range(4)]


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for s in range(4):
        for t in range(4):
            ways = [(x[0] + y[0], x[1] + y[1]) for r in range(4) if (x := a[4 * s + r]) and (y := b[4 * r + t])]
            out.append(min(ways, default=None))
    return out


def folded(parts: list[Matrix]) -> Matrix:
    """The product of matrices in order, as a tree, so that audits are copied a few times only."""
    while len(parts) > 1:
        parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


@dataclass
class Piece:
    """What is known of consecutive rows of one conversation; `add` takes rows in order, `join` two pieces."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0
    low: int | None = None
    high: int | None = None
    first: str | None = None
    last: str | None = None
    rows: str = ""
    done: list[Matrix] = field(default_factory=list)

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        if turn is not None and turn != self.high:  # turns come in order
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if len(self.rows) == SEGMENT:
            self.done.append(matrix(self.rows))
            self.rows = ""
        self.rows += symbol(initial, fault)

    def matrix(self) -> Matrix:
        return folded([*self.done, matrix(self.rows)])

    def label(self) -> Label:
        if not self.done:
            return cheapest(self.rows, START, ENDS)
        return min(x for x in (self.matrix()[e] for e in ENDS) if x)

    def stats(self) -> list[int]:
        return [self.blank, self.duplicate, self.truncated, self.illegal]


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the stated damage, with `first` letter, `fault` but for duplicates, and keys."""
    space = F.lit(" ")
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), space)
    hit = F.crc32(F.concat(spelled("conv_id"), F.lit(":"), spelled("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), spelled("role").alias("role"), spelled("text").alias("text"), hit.alias("hit")).filter("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    end = F.rtrim("text", F.lit(SEPARATORS))
    fault = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(*".!?"), "truncated").otherwise("")
    digest = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text").cast("binary")))
    return rows.select("conv_id", "turn", "role", "text", F.substring("text", 1, HEAD).alias("head"), digest.alias("own"), fault.alias("fault"))


ORDER = ["conv_id", "turn", "role", "head", "own"]
PIECE = "conv_id bigint, part int, run int, whole boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first string, last string, costs array<bigint>, audits array<string>"
FIELDS = ["conv_id", "part", "run", "whole", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last", "costs", "audits"]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """PIECE rows of a partition of ordered rows; those at its ends may go on elsewhere and keep their matrices."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("run", pa.int32()), ("whole", pa.bool_()), *[(c, pa.int64()) for c in FIELDS[4:11]], ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
    out: list[dict] = []
    run, conv, piece = 0, None, None

    def close(whole: bool) -> None:
        labels = [piece.label()] if whole else piece.matrix()
        stats = dict(zip(FIELDS[4:13], [*piece.stats(), piece.turns, piece.low, piece.high, piece.first, piece.last], strict=True))
        out.append({"conv_id": conv, "part": part, "run": run, "whole": whole, **stats, "costs": [x and x[0] for x in labels], "audits": [x and x[1] for x in labels]})

    for batch in batches:
        for now, turn, initial, fault, n, first in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "initial", "fault", "n", "is_first")], strict=True):
            if piece is None or now != conv:
                if piece is not None:
                    close(run > 0)
                    run += 1
                conv, piece = now, Piece()
            for k in range(n):
                piece.add(turn, initial, fault if fault == "blank" or (first and not k) else "duplicate")
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if piece is not None:
        close(False)
        yield pa.RecordBatch.from_pylist(out, schema)


def _joined(pieces: pd.DataFrame) -> pd.DataFrame:
    """One PIECE row of the pieces into which partitions cut a conversation."""
    rows = pieces.sort_values(["part", "run"]).to_dict("records")
    given = lambda x: None if x is None or x != x else x
    total = dict(rows[0])
    for a, b in zip(rows, rows[1:], strict=False):
        for c in FIELDS[4:9]:
            total[c] += b[c]
        total["illegal"] += a["last"] + b["first"] not in LEGAL
        total["turns"] -= given(total["high"]) is not None and total["high"] == given(b["low"])
        total["low"] = b["low"] if given(total["low"]) is None else total["low"]
        total["high"] = total["high"] if given(b["high"]) is None else b["high"]
    whole = folded([[None if given(c) is None else (int(c), a) for c, a in zip(r["costs"], r["audits"], strict=True)] for r in rows])
    cost, audit = min(x for x in (whole[e] for e in ENDS) if x)
    return pd.DataFrame([total | {"low": given(total["low"]), "high": given(total["high"]), "costs": [cost], "audits": [audit]}])[FIELDS].astype({"low": "Int64", "high": "Int64"})


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of all conversations with rows after damage."""
    same = rows.groupBy(*ORDER, "fault").agg(F.count("*").alias("n"))  # repeated rows meet as counts
    first = same.groupBy("own").agg(F.min(F.struct(F.col("turn").isNotNull().alias("x"), "turn")).alias("least"))
    slim = same.join(first.withColumnRenamed("own", "o"), F.col("own") == F.col("o"))
    slim = durable(slim.select(*ORDER, "fault", "n", F.col("least.turn").eqNullSafe(F.col("turn")).alias("is_first")))
    ordered = slim.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    pieces = durable(ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "n", "is_first").mapInArrow(_pieces, PIECE))
    cut = pieces.filter("not whole").groupBy("conv_id").applyInPandas(_joined, PIECE)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    return pieces.filter("whole").union(cut).select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("costs")[0].alias("cost"), F.col("audits")[0].alias("audit"))


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
REPAIRED = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class _Writer:
    """Applies an audit to the rows that follow it and hashes what stays."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.digest, self.any = audit, 0, START, hashlib.sha256(), False

    def put(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
        self.any = True

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self.put(ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = NEXT[self.state]
            self.put(ROLE[self.state], text)
        elif edit == "K":
            self.state = KEPT[role[0]][self.state]
            self.put(role, text)

    def end(self) -> str:
        self.inserts()
        return self.digest.hexdigest()


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """REPAIRED rows of a partition in which every conversation's audit stands before its rows."""
    names = ["conv_id", *COUNTS, "audit"]
    schema = pa.schema([*[(c, pa.int64()) for c in names[:-1]], ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out: list[dict] = []
    head, writer = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["kind"] == 0:
                if writer:
                    out.append({c: head[c] for c in names} | {"repaired_sha256": writer.end()})
                head, writer = row, _Writer(row["audit"])
            else:
                writer.row(row["role"], row["text"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if writer:
        yield pa.RecordBatch.from_pylist([{c: head[c] for c in names} | {"repaired_sha256": writer.end()}], schema)


def repair(turns: DataFrame) -> DataFrame:
    """REPAIRED row of every conv_id of `turns` (conv_id, turn, role, text)."""
    rows = damaged(turns)
    ids = turns.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    found = audits(rows)
    heads = ids.join(found.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    heads = heads.select("conv_id", F.lit(0).alias("kind"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"))
    texts = rows.select("conv_id", F.lit(1).alias("kind"), *ORDER[1:], "text")
    both = heads.unionByName(texts, allowMissingColumns=True)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])
    return ordered.select("conv_id", "kind", "role", "text", *COUNTS, "audit").mapInArrow(_written, REPAIRED)
