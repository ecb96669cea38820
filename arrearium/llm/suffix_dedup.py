"""Suffix-array deduplication of repeated byte strings, by merging shard Burrows-Wheeler transforms.

Every byte covered by a LENGTH-byte string that also starts earlier (smaller doc_id, or same document and earlier
start) is removed; matches stay within documents and are judged on the input.

1. Candidate contexts. Of the k-byte hashes in each LENGTH-byte window the smallest one (the leftmost on ties) owns
   the window, so equal windows have owners with equal hashes. The windows of one owner form one context of a few
   dozen windows; a text has a context every 35 bytes or so. Owners whose hash occurs once in the corpus can't have
   repeats: one shuffle of (owner hash, context hash, place) drops them. Equal contexts are collapsed on the way,
   first within each task, so a passage on a third of all documents is a few rows per task; all but the earliest
   of equal contexts are repeats entirely.
2. Shard transforms. The remaining distinct contexts, dealt by owner hash so that equal windows meet, are cut into
   shards of bounded size; each shard's cyclic suffixes are sorted to LENGTH bytes and give its transform, on
   four-byte symbols.
3. Merging. Two transforms are merged by refining their interleave: a stable partition of the interleaved
   preceding symbols turns an interleave that is right for j symbols into one for j + 1. The step at which two
   neighbours fall into different blocks is the length of their common prefix; after LENGTH / 4 steps the
   blocks are the repeated intervals. No suffix is sorted again.
   Contexts of an owner with over HOT_BYTES of them are not dealt by it, for they would all meet in one task: each of
   their windows is dealt by a 128-bit hash of its own bytes, and an aggregate gives its earliest place.
4. In each repeated interval all but the earliest place are repeats. Runs of places become byte spans, are
   gathered per document and cut out of its text.

Defined results: a null text is an empty one (0 bytes, nothing removed); texts shorter than LENGTH lose nothing; a null
doc_id comes last in order; rows with one doc_id and the same text are one document, each row getting its result;
with different texts they are documents of their own, ordered by start; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .common import durable
from .near_dedup import mix

LENGTH = 100  # a multiple of SYMBOL
OWNER = 32
SHARD_BYTES = 256_000
PART_BYTES = 400_000
HOT_BYTES = 400_000  # an owner with more bytes of distinct contexts is dealt by windows
COLLAPSE_BYTES = 24_000_000
BLOCK = 1 << 15
LAST = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes of any substring of one text, from prefix sums."""

    def __init__(self, size: int = 1 << 16):
        self.table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
        self.inverse = pow(_BASE, -1, 1 << 64)
        self.grow(size)

    def grow(self, size: int) -> None:
        self.up, self.down = _powers(size + 1, _BASE), _powers(size + 1, self.inverse)

    def load(self, data: np.ndarray) -> None:
        if len(data) >= len(self.up):
            self.grow(2 * len(data))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(self.table[data] * self.up[: len(data)], dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if span < w:
        x = np.minimum(x[: len(x) - (w - span)], x[w - span :])
    return x


def contexts(data: np.ndarray, hasher: Hasher, length: int, owner: int) -> tuple[np.ndarray, ...]:
    """(owner hash, context hash, start, end) of the contexts of a text: maximal runs of windows with one owner."""
    n = len(data)
    if n < length:
        empty = np.zeros(0, np.uint64)
        return empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64)
    hasher.load(data)
    at = np.arange(n - owner + 1)
    h = mix(hasher.of(at, at + owner))
    w = length - owner + 1
    # The lowest 16 bits of the compared hashes give way to the place within a block, so that a minimum names its place
    # and the leftmost one wins ties; equal windows agree on it, whatever block they stand in.
    low = np.uint64(0xFFFF)
    own = np.empty(len(h) - w + 1, np.int64)
    for at in range(0, len(own), BLOCK):
        part = h[at : at + BLOCK + w - 1]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        own[at : at + BLOCK] = at + (sliding_min(key, w) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(own) - 1]])
    start, end = first, last + length
    return h[own[first]], mix(hasher.of(start, end) + (end - start).astype(np.uint64)), start, end


def merge_runs(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Unite overlapping or touching spans of one document."""
    if not len(doc):
        return doc, tag, start, end
    o = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[o], tag[o], start[o], end[o]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    group = np.cumsum(new)
    reach = np.maximum.accumulate(end + group * (1 << 40)) - group * (1 << 40)  # within a document
    cut = np.concatenate([[True], new[1:] | (start[1:] > reach[:-1])])
    first = np.flatnonzero(cut)
    return doc[first], tag[first], start[first], np.maximum.reduceat(end, first)


_PLACES = "owner bigint, context bigint, doc bigint, loc bigint, length int, kind int"


def _tag(data: bytes) -> int:
    return zlib.crc32(data)


def places(docs: DataFrame, length: int, owner: int) -> DataFrame:
    """Contexts of all texts (kind 0), equal ones collapsed within a chunk, whose spans are given at once (kind 1).

    loc holds the start in its upper and a checksum of the text in its lower 32 bits.
    """
    import pyarrow as pa

    names = [c.split()[0] for c in _PLACES.split(", ")]

    def collapse(parts: list[tuple]) -> pa.RecordBatch:
        own, ctx, doc, tag, start, end = (np.concatenate(x) for x in zip(*parts))
        o = np.lexsort((tag, start, doc, ctx, own))
        own, ctx, doc, tag, start, end = (x[o] for x in (own, ctx, doc, tag, start, end))
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (ctx[1:] != ctx[:-1])])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = ~new & ((doc != doc[head]) | (start != start[head]) | (tag != tag[head]))
        rd, rt, rs, re = merge_runs(doc[again], tag[again], start[again], end[again])
        loc = lambda s, t: (s << 32) | t
        columns = [
            np.concatenate([own[new].view(np.int64), mix(rd.view(np.uint64) * np.uint64(31) + rs.view(np.uint64)).view(np.int64)]),
            np.concatenate([ctx[new].view(np.int64), np.zeros(len(rd), np.int64)]),
            np.concatenate([doc[new], rd]),
            np.concatenate([loc(start[new], tag[new]), loc(rs, rt)]),
            np.concatenate([end[new] - start[new], re - rs]).astype(np.int32),
            np.concatenate([np.zeros(int(new.sum()), np.int32), np.ones(len(rd), np.int32)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, size = Hasher(), [], 0
        for b in batches:
            for d, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                data = (t or "").encode("utf-8", "replace")
                own, ctx, start, end = contexts(np.frombuffer(data, np.uint8), hasher, length, owner)
                if len(own):
                    parts.append((own, ctx, np.full(len(own), d), np.full(len(own), _tag(data)), start, end))
                size += len(data)
                if size >= COLLAPSE_BYTES and parts:
                    yield collapse(parts)
                    parts, size = [], 0
        if parts:
            yield collapse(parts)

    return docs.mapInArrow(run, _PLACES)


SYMBOL = 4  # bytes of a symbol of the transforms; strings end with as many zero bytes


def symbol_order(codes: np.ndarray, most: int) -> np.ndarray:
    """Stable order of dense symbol codes, by one or two counting passes."""
    if most < 1 << 16:
        return np.argsort(codes.astype(np.uint16), kind="stable")
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((codes >> 16).astype(np.uint16)[order], kind="stable")]


class Shard:
    """Transform of a collection of strings: preceding symbol and place of every row, and blocks of rows equal to `depth` bytes."""

    def __init__(self, bwt: np.ndarray, rows: np.ndarray, block: np.ndarray):
        self.bwt, self.rows, self.block = bwt, rows, block

    @classmethod
    def build(cls, strings: list[bytes], first_row: int, depth: int) -> Shard:
        """Sort the cyclic suffixes of the strings, each ended by zero bytes, by doubling."""
        pad = b"\0" * SYMBOL
        text = np.frombuffer(b"".join(s + pad for s in strings), np.uint8)
        sizes = np.array([len(s) + SYMBOL for s in strings])
        begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
        size = np.repeat(sizes, sizes)
        inside = np.arange(len(text)) - begin
        ahead = lambda k: begin + (inside + k) % size
        pair = (text.astype(np.uint64) << np.uint64(8)) | text[ahead(1)]
        four = (pair << np.uint64(16)) | pair[ahead(2)]
        key, known = (four << np.uint64(32)) | four[ahead(4)], 8
        while True:
            order = np.argsort(key)
            key = key[order]
            new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            if known >= depth or new[-1] == len(text) - 1:
                break
            rank = np.empty(len(text), np.uint64)
            rank[order] = new
            more = min(known, depth - known)  # ends at `depth` exactly: blocks are classes of that many bytes
            key, known = (rank << np.uint64(32)) | rank[ahead(more)], known + more
        before = four[ahead(-SYMBOL)].astype(np.uint32)
        return cls(before[order], order + first_row, new)

    @classmethod
    def merge(cls, a: Shard, b: Shard, depth: int) -> Shard:
        """Interleave refinement; block numbers change where a neighbour's common prefix ends.

        A step adds one symbol; `depth` is a multiple of the symbol's bytes.
        """
        n = len(a.bwt) + len(b.bwt)
        known = np.unique(np.concatenate([a.bwt, b.bwt]))
        of_a, of_b = (np.searchsorted(known, x.bwt).astype(np.uint16 if len(known) < 1 << 16 else np.int64) for x in (a, b))
        z = np.zeros(n, bool)
        z[len(a.bwt) :] = True
        block, count = np.zeros(n, np.int32), 1
        for _ in range(depth // SYMBOL):
            symbols = np.empty(n, of_a.dtype)
            symbols[~z] = of_a
            symbols[z] = of_b
            order = symbol_order(symbols, len(known))
            z, symbols, block = z[order], symbols[order], block[order]
            ends = (symbols[1:] != symbols[:-1]) | (block[1:] != block[:-1])
            block = np.zeros(n, np.int32)
            np.cumsum(ends, out=block[1:])
            if block[-1] + 1 == count:
                break  # no block was divided: none will be
            count = int(block[-1]) + 1
        rows, bwt = np.empty(n, np.int64), np.empty(n, np.uint32)
        rows[~z], rows[z] = a.rows, b.rows
        bwt[~z], bwt[z] = a.bwt, b.bwt
        return cls(bwt, rows, block)


def repeats(groups: list[tuple[bytes, int, int]], length: int, shard_bytes: int) -> tuple[np.ndarray, ...]:
    """Spans (doc, tag, start, end) of all but the earliest place of each `length`-byte string in (bytes, doc, loc) contexts."""
    stack: list[tuple[int, Shard]] = []
    made, held, size, first = 0, [], 0, 0

    def close() -> None:
        nonlocal held, size, first
        stack.append((0, Shard.build(held, first, length)))
        first, held, size = first + size, [], 0
        while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
            (level, b), (_, a) = stack.pop(), stack.pop()
            stack.append((level + 1, Shard.merge(a, b, length)))

    for data, _, _ in groups:
        held.append(data)
        size += len(data) + SYMBOL
        made += 1
        if size >= shard_bytes:
            close()
    if held:
        close()
    if not stack:
        return (np.zeros(0, np.int64),) * 4
    while len(stack) > 1:
        (_, b), (level, a) = stack.pop(), stack.pop()
        stack.append((level + 1, Shard.merge(a, b, length)))
    whole = stack[0][1]
    sizes = np.array([len(g[0]) + SYMBOL for g in groups])
    begin = np.cumsum(sizes) - sizes
    # Rows in repeated intervals: neighbours in one block, with `length` bytes left in their string.
    same = whole.block[1:] == whole.block[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    rows, block = whole.rows[many], whole.block[many]
    string = np.searchsorted(begin, rows, "right") - 1
    offset = rows - begin[string]
    ok = offset + length <= sizes[string] - SYMBOL
    string, offset, block = string[ok], offset[ok], block[ok]
    doc = np.array([g[1] for g in groups], np.int64)[string]
    loc = np.array([g[2] for g in groups], np.int64)[string]
    start, tag = (loc >> 32) + offset, loc & 0xFFFFFFFF
    if not len(doc):
        return doc, tag, start, start
    o = np.lexsort((tag, start, doc, block))
    block, doc, start, tag = block[o], doc[o], start[o], tag[o]
    new = np.concatenate([[True], block[1:] != block[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    again = (doc != doc[head]) | (start != start[head]) | (tag != tag[head])
    doc, tag, start = doc[again], tag[again], start[again]
    return merge_runs(doc, tag, start, start + length)


_SPANS = "doc bigint, tag bigint, start bigint, `end` bigint"


def mark_hot(heads: DataFrame, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """`heads` (owner, length, ..) with `hot`: its owner's contexts are too many bytes for one task."""
    hot = heads.groupBy("owner").agg(F.sum(F.col("length") + SYMBOL).alias("n")).filter(F.col("n") > hot_bytes)
    hot = durable(hot.select("owner", F.lit(True).alias("hot")))  # at most all their bytes / hot_bytes rows
    return heads.join(F.broadcast(hot), "owner", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))


def window_spans(texts: DataFrame, length: int) -> DataFrame:
    """Spans of all but the earliest place of each window in the hot heads of `texts` (doc, tag, text, heads)."""
    import pyarrow as pa

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t, text, hs in zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), b.column("text").to_pylist(), b.column("heads").to_pylist()):
                data = text.encode("utf-8", "replace")
                at = sorted({i for h in hs if h["hot"] for i in range(h["start"], h["start"] + h["length"] - length + 1)})
                if at:
                    keys = [hashlib.blake2b(data[i : i + length], digest_size=16).digest() for i in at]
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([d] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([t] * len(at), pa.int64())], names=["key", "doc", "start", "tag"])

    rows = texts.filter(F.exists("heads", lambda h: h["hot"])).mapInArrow(windows, "key binary, doc bigint, start bigint, tag bigint")
    place = F.struct("doc", "start", "tag")
    first = rows.groupBy("key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("key", "first")
    return rows.join(first, "key").filter(place != F.col("first")).select("doc", "tag", "start", (F.col("start") + length).alias("end"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, owner: int = OWNER, shard_bytes: int = SHARD_BYTES, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Spans to remove of `keyed` (doc, tag, text): doc, tag, start, end; several spans of a document may overlap."""
    import pyarrow as pa

    rows = places(keyed.select("doc", "text"), length, owner)
    group, equal = W.partitionBy("owner"), W.partitionBy("owner", "context").orderBy("doc", "loc")
    ranked = rows.withColumn("rank", F.dense_rank().over(equal)).withColumn("lo", F.min("context").over(group)).withColumn("hi", F.max("context").over(group)).withColumn("last", F.max("rank").over(group))
    tag, start = F.col("loc").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("loc", 32)
    found = ranked.filter("kind = 1 or rank > 1 or lo <> hi or last > 1")
    found = durable(found.select("owner", "doc", "loc", "length", (F.col("kind") + F.when(F.col("rank") > 1, 1).otherwise(0)).cast("int").alias("again"), (F.col("lo") != F.col("hi")).alias("open")))
    spans = found.filter("again > 0").select("doc", tag.alias("tag"), start.alias("start"), (start + F.col("length")).alias("end"))

    heads = mark_hot(found.filter("again = 0 and open").select("owner", "doc", "loc", "length"), hot_bytes)
    any_hot = heads.filter("hot").limit(1).count() > 0
    total = heads.filter("not hot").agg(F.sum(F.col("length") + SYMBOL).alias("n")).first()["n"] or 0
    per_doc = heads.groupBy("doc", tag.alias("tag")).agg(F.collect_list(F.struct("owner", start.cast("int").alias("start"), "length", "hot")).alias("heads"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, t, text, hs in zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), b.column("text").to_pylist(), b.column("heads").to_pylist()):
                data = text.encode("utf-8", "replace")
                hs = list({(h["owner"], h["start"], h["length"]) for h in hs if not h["hot"]})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([h[0] for h in hs], pa.int64()), pa.array([data[h[1] : h[1] + h[2]] for h in hs], pa.binary()), pa.array([d] * len(hs), pa.int64()), pa.array([(h[1] << 32) | t for h in hs], pa.int64())],
                    names=["owner", "data", "doc", "loc"],
                )

    texts = keyed.join(per_doc, ["doc", "tag"]).select("doc", "tag", "text", "heads")
    dealt = texts.mapInArrow(cut, "owner bigint, data binary, doc bigint, loc bigint").repartition(int(total // PART_BYTES) + 1, "owner")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {}
        for b in batches:
            for data, d, loc in zip(b.column("data").to_pylist(), b.column("doc").to_pylist(), b.column("loc").to_pylist()):
                groups[d, loc, data] = None
        out = repeats([(data, d, loc) for d, loc, data in groups], length, shard_bytes)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc", "tag", "start", "end"])

    spans = spans.union(dealt.mapInArrow(merge, _SPANS))
    return spans.union(window_spans(texts, length)) if any_hot else spans


def suffix_dedup(
    docs: DataFrame,
    length: int = LENGTH,
    owner: int = OWNER,
    shard_bytes: int = SHARD_BYTES,
    id_col: str = "doc_id",
    text: str = "text",
    with_text: bool = False,
    hot_bytes: int = HOT_BYTES,
) -> DataFrame:
    """Per row of `docs`: id, n_bytes, n_removed, n_spans, kept_sha256, and the kept bytes if `with_text`."""
    import pyarrow as pa

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(int(LAST))).alias("doc"), F.crc32(body.cast("binary")).alias("tag"), body.alias("text"))
    spans = durable(repeated_spans(keyed, length, owner, shard_bytes, hot_bytes))
    per_doc = spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = keyed.join(per_doc, ["doc", "tag"], "left").select("doc", "text", "spans")
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    schema = T.StructType([T.StructField(id_col, T.LongType()), *[T.StructField(c, T.LongType()) for c in names[1:4]], T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept", T.BinaryType())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, t, spans in zip(b.column("doc").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist()):
                data, kept, at, n, removed = t.encode("utf-8", "replace"), [], 0, 0, 0
                end = -1
                for s in sorted((x["start"], x["end"]) for x in spans or ()):
                    if s[0] > end:
                        n += 1
                        kept.append(data[at : s[0]])
                        removed += s[1] - s[0]
                    elif s[1] > end:
                        removed += s[1] - end
                    end = at = max(end, s[1])
                kept = b"".join([*kept, data[at:]])
                out.append((None if d == LAST else d, len(data), removed, n, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64()] * 4 + [pa.string(), pa.binary()])] if out else [pa.array([], k) for k in [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_text], names=names)

    return joined.mapInArrow(run, schema)
