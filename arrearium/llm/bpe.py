"""Byte-level BPE by monoid tree reduction.

A text is split by the pre-tokenizer pattern; each match is encoded on its own. A match's bytes are halved
recursively down to leaves, single bytes or tokens whose own bytes encode to just themselves, and neighbours are
joined by the monoid operation `join`: it re-encodes a window around the border, growing it until the tokens
outside can't change. That is decided pair by pair: a token sequence is the encoding of its bytes exactly when
every two adjacent tokens, encoded together, give just themselves. Within both halves that holds already, so it is
enough that the pairs at the two ends of the window hold. Every match takes this way, however short; only one that
is a token as a whole is that token, as in the library. Decoding maps ids to bytes and concatenates FAN neighbours
at a time, level by level up the tree.

Words repeat, and so do their halves: encodings of matches, of short halves and of token pairs are kept in caches
of a bounded number of short entries, which change the time but no result.

Nothing here depends on other rows: the table is one map over Arrow batches, without a shuffle; memory is
that of a batch, the caches and the ranks.

Defined results: a null text is encoded as an empty one (no ids, empty bytes); repeated rows and null ids are
encoded row by row; an empty table gives an empty table; input columns named like an output column are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .near_dedup import sliced

KEPT_BYTES = 24  # longer matches and halves aren't kept in caches
CACHE = 100_000  # entries of a cache
WINDOW = 256  # bytes from which a window is merged with a heap
FAN = 16  # children of a node in decoding
NEVER = 1 << 62


def keep(cache: dict, key, value):
    """Put an entry into a cache that starts anew when it is full."""
    if len(cache) >= CACHE:
        cache.clear()
    cache[key] = value
    return value


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Ranks and pattern, with `encode(text) -> ids` and `decode(ids) -> bytes`; splits and joins are counted."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.leaves = {b: (i,) for b, i in ranks.items() if len(b) == 1 or self.merge(b) == (i,)}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.halves: dict[bytes, tuple[int, ...]] = {}
        self.pairs: dict[int, tuple[int, ...]] = {}
        self.splits = self.joins = 0

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Encode a window: merge the adjacent pair whose joint bytes have the lowest rank, the leftmost on ties."""
        if len(data) > WINDOW:
            return self.merge_long(data)
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        near = [ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while near:
            low = min(near)
            if low == NEVER:
                break
            i = near.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del near[i]
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
        return tuple([ranks[p] for p in parts])

    def merge_long(self, data: bytes) -> list[int]:
        """The same with a heap and linked parts, for windows that had to grow long."""
        ranks, n = self.ranks, len(data)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts here
        live = [True] * n

        def rank(i: int) -> int:
            j = end[i]
            return ranks.get(data[i : end[j]], NEVER) if j < n else NEVER

        heap = [(r, i, i + 2) for i in range(n) if (r := rank(i)) != NEVER]
        heapify(heap)
        while heap:
            _, i, stop = heappop(heap)
            if not live[i] or end[i] >= n or end[end[i]] != stop:
                continue  # the pair has changed meanwhile
            j = end[i]
            live[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
            for k in (before[i], i):
                if k >= 0 and (r := rank(k)) != NEVER:
                    heappush(heap, (r, k, end[end[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : end[i]]])
            i = end[i]
        return tuple(out)

    def window(self, tokens: tuple[int, ...]) -> tuple[int, ...]:
        """The bytes of some adjacent tokens, encoded anew."""
        data = b"".join(map(self.bytes_of.__getitem__, tokens))
        got = self.leaves.get(data) or self.halves.get(data)
        if got is None:
            got = self.merge(data)
            if len(data) <= KEPT_BYTES:
                keep(self.halves, data, got)
        return got

    def pair(self, left: int, right: int) -> tuple[int, ...]:
        """The smallest window: two adjacent tokens encoded together."""
        key = left << 32 | right
        return self.pairs.get(key) or keep(self.pairs, key, self.window((left, right)))

    def stable(self, left: int, right: int) -> bool:
        return self.pair(left, right) == (left, right)

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of the concatenated bytes of two encodings."""
        if not left or not right:
            return left + right
        self.joins += 1
        n, m, i, j = len(left), len(right), 1, 1
        window = self.pair(left[-1], right[0])
        if window == (left[-1], right[0]):
            return left + right
        while True:
            on_left = i == n or self.stable(left[n - i - 1], window[0])
            on_right = j == m or self.stable(window[-1], right[j])
            if on_left and on_right:
                return left[: n - i] + window + right[j:]
            i, j = (i if on_left else min(n, 2 * i)), (j if on_right else min(m, 2 * j))
            window = self.window(left[n - i :] + right[:j])

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Tree reduction over halves, from single bytes up."""
        got = self.leaves.get(data) or self.halves.get(data)
        if got is None:
            size = len(data)
            if not size:
                return ()
            self.splits += 1
            half = size // 2
            got = self.join(self.encode_bytes(data[:half]), self.encode_bytes(data[half:]))
            if size <= KEPT_BYTES:
                keep(self.halves, data, got)
        return got

    def piece(self, match: str) -> tuple[int, ...]:
        data = match.encode("utf-8", "replace")
        whole = self.ranks.get(data)
        got = (whole,) if whole is not None else self.encode_bytes(data)
        if len(data) <= KEPT_BYTES:
            keep(self.pieces, match, got)
        return got

    def encode(self, text: str) -> list[int]:
        get, slow, out = self.pieces.get, self.piece, []
        extend = out.extend
        for m in self.find(text):
            extend(get(m) or slow(m))
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Concatenate the bytes of the ids up the tree."""
        level = list(map(self.bytes_of.__getitem__, ids))
        while len(level) > 1:
            level = [b"".join(level[i : i + FAN]) for i in range(0, len(level), FAN)]
        return level[0] if level else b""


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each Python worker."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return _CODECS[path, pattern]


def _schema(df: DataFrame, more: dict[str, T.DataType]) -> tuple[list[str], T.StructType]:
    keep = [f for f in df.schema.fields if f.name.lower() not in more]
    return [f.name for f in keep], T.StructType([*keep, *[T.StructField(k, v) for k, v in more.items()]])


def bpe_encode(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """`docs` with the ids of every whole text as an int array column `out`."""
    import pyarrow as pa

    names, schema = _schema(docs, {out: T.ArrayType(T.IntegerType())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in sliced(batches):
            ids = pa.array([c.encode(t or "") for t in b.column(text).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], ids], names=[*names, out])

    return docs.mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, vocabulary: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with the bytes of every id array as a binary column `out`; a null array gives empty bytes."""
    import pyarrow as pa

    names, schema = _schema(encoded, {out: T.BinaryType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in sliced(batches):
            done = pa.array([c.decode(x or []) for x in b.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], done], names=[*names, out])

    return encoded.mapInArrow(run, schema)


def bpe_digest(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` without the text, with n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256.

    Encodes and decodes in the same task, so that neither ids nor decoded texts leave it.
    """
    import pyarrow as pa

    more = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    names, schema = _schema(docs.drop(text), more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        digits = {i: str(i) for i in c.bytes_of}
        for b in sliced(batches):
            n, ids_sha, decoded_sha = [], [], []
            for t in b.column(text).to_pylist():
                ids = c.encode(t or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], names=[*names, *more])

    return docs.mapInArrow(run, schema)


def tokenize(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text") -> DataFrame:
    """`docs` without the text, with ids (int array), n_tokens, and exact: whether decoding gave the text again."""
    import pyarrow as pa

    more = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "exact": T.BooleanType()}
    names, schema = _schema(docs.drop(text), more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary, pattern)
        for b in sliced(batches):
            texts = [t or "" for t in b.column(text).to_pylist()]
            ids = [c.encode(t) for t in texts]
            exact = [c.decode(x) == t.encode("utf-8", "replace") for x, t in zip(ids, texts)]
            made = [pa.array(ids, pa.list_(pa.int32())), pa.array([len(x) for x in ids], pa.int64()), pa.array(exact, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], *made], names=[*names, *more])

    return docs.mapInArrow(run, schema)
