"""Benchmark decontamination by spaced seeds.

1. Fixed masks pick some token positions of a window and ignore the others, so a window still matches when an ignored
   token was substituted. The hashes of the benchmark's windows under all masks are a table (seed, item, place).
2. A bit filter of fixed size over those hashes goes to the tasks that read the corpus; they emit only windows whose
   bit is set, so that what is shuffled grows with the overlaps, not with the corpus.
3. The emitted seeds are joined with the benchmark's on the hash: broadcast below a checked size, else shuffled, where
   the rows of a frequent seed can be split. A hit names a diagonal of a document and an item.
4. Along each diagonal the two texts are compared token by token. With a match worth 1 and a substitution worth
   -PENALTY, every maximal segment is an overlap; it is a leak from MIN_TOKENS matched tokens, or from 80 % of a
   shorter item. Whatever has such a segment also has a window that one of the masks matches (a test enumerates all
   patterns), so no leak is lost by the seeds.

Tokens are the words of the text, lower-cased and stripped of ASCII punctuation at both ends. Items shorter than
the masks' span have to stand whole.

Defined results: null and empty texts and items match nothing; several rows with one doc_id (or item_id) give one row
for each pair, with the longest overlap; a null doc_id can leak too and stays null; with an empty benchmark or table
the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable
from .near_dedup import WORDS, _small, _Words, mix, row_key, sliced

#: The seeds; 1 is a compared token, 0 an ignored one.
MASKS = ("111011011", "11101010011", "111001111")
SPAN = 11
MIN_TOKENS = 13
SHARE = 0.8
PENALTY = 3
FILTER_BITS = 24  # of the logarithm of the filter's bits: 2 MB, however large the benchmark is
_STRIP = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Tokens(_Words):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.strip(_STRIP))
        return h


def tokens(text: str | None, words: _Tokens) -> np.ndarray:
    ws = (text or "").lower().encode("utf-8", "replace").split()
    return np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))


def seed_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash under the mask of every window of `h`."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * _STEP + (h[i : i + n] ^ (out >> np.uint64(29)))
    return mix(out)


def segments(same: np.ndarray, penalty: int = PENALTY) -> list[tuple[int, int, int]]:
    """(start, end, matches) of all maximal scoring segments: none can be extended or cut without losing score."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    found: list[tuple[int, int, int, int]] = []  # score before, score after, start, end
    score = at = 0
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        low = score - penalty * (start - at)
        score, at = low + end - start, end
        new = (low, score, start, end)
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][0] >= new[0]:
                k -= 1
            if k < 0 or found[k][1] >= new[1]:
                break
            new = (found[k][0], new[1], found[k][2], new[3])
            del found[k:]
        found.append(new)
    return [(a, b, int(same[a:b].sum())) for _, _, a, b in found]


def needed(n_item: int) -> int:
    """Matched tokens from which an overlap with an item of so many tokens is a leak."""
    return MIN_TOKENS if n_item * SHARE >= MIN_TOKENS else int(np.ceil(SHARE * n_item)) if n_item >= SPAN else n_item


def overlap(own: np.ndarray, h: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(matches, start, end) in `h` of the leak with most matches where `own` is laid at `shift`, if there is one."""
    i0, i1 = max(0, -shift), min(len(own), len(h) - shift)
    if i0 >= i1:
        return None
    found = [(n, i0 + shift + a, i0 + shift + b) for a, b, n in segments(own[i0:i1] == h[i0 + shift : i1 + shift]) if n >= needed(len(own))]
    return max(found, default=None)


def _batch(rows: list[tuple], schema: str):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.replace("`", "").split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[f for f, _ in fields])


def item_tokens(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(item, item_id, n_item, hashes) of each distinct item with tokens."""
    schema = "item bigint, item_id bigint, n_item int, hashes binary"

    def run(batches: Iterator) -> Iterator:
        words = _Tokens()
        for b in sliced(batches):
            made = zip(b.column("item").to_pylist(), b.column("item_id").to_pylist(), (tokens(t, words) for t in b.column("text").to_pylist()))
            yield _batch([(k, i, len(h), h.tobytes()) for k, i, h in made if len(h)], schema)

    items = benchmark.select(row_key(item_id, item_text).alias("item"), F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    return items.dropDuplicates(["item"]).mapInArrow(run, schema)


def item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item, place) of every window of every item under every mask."""
    schema = "seed bigint, item bigint, place int"

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for k, data in zip(b.column("item").to_pylist(), b.column("hashes").to_pylist()):
                h = np.frombuffer(data, np.uint64)
                for mask in MASKS if len(h) >= SPAN else ["1" * len(h)]:
                    s = seed_hashes(h, mask).view(np.int64)
                    yield _batch([(x, k, i) for i, x in enumerate(s.tolist())], schema)

    return items.select("item", "hashes").mapInArrow(run, schema)


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Bit filter of the seeds, at most 2^FILTER_BITS bits: what reaches the driver doesn't grow with the benchmark."""
    slot = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = seeds.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def text_seeds(texts: DataFrame, bits: np.ndarray, masks: list[str]) -> DataFrame:
    """(doc, pos, seed) of the windows of `texts` (doc, text) that the filter lets through."""
    schema = "doc bigint, pos int, seed bigint"
    shift, low = np.uint64(64 - FILTER_BITS), np.uint64(63)

    def run(batches: Iterator) -> Iterator:
        words = _Tokens()
        for b in sliced(batches):
            rows = []
            for doc, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                h = tokens(t, words)
                for mask in masks:
                    s = seed_hashes(h, mask)
                    slot = s >> shift
                    at = np.flatnonzero((bits[(slot >> np.uint64(6)).view(np.int64)] >> (slot & low)) & np.uint64(1))
                    if len(at):
                        rows += [(doc, p, x) for p, x in zip(at.tolist(), s[at].view(np.int64).tolist())]
            yield _batch(rows, schema)

    return texts.mapInArrow(run, schema)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_matched, n_item, start, end): one row for each document and item it holds a passage of."""
    items = durable(item_tokens(benchmark, item_id, item_text))
    seeds = durable(item_seeds(items))
    short = sorted(r["n_item"] for r in items.filter(F.col("n_item") < SPAN).select("n_item").distinct().collect())  # SPAN - 1 at most
    texts = docs.select(row_key(id_col, text).alias("doc"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    hits = text_seeds(texts.select("doc", "text"), seed_filter(seeds), [*MASKS, *["1" * n for n in short]])
    diagonals = hits.join(_small(seeds, seeds.count()), "seed").select("doc", "item", (F.col("pos") - F.col("place")).alias("shift"))
    diagonals = durable(diagonals.distinct())

    found = durable(diagonals.select("doc").distinct())
    bodies = texts.join(_small(found, found.count()), "doc", "left_semi").dropDuplicates(["doc"])
    whole = diagonals.join(bodies, "doc").join(_small(items, items.count()), "item").select("doc", "doc_id", "text", "item_id", "n_item", "hashes", "shift")
    schema = "doc_id bigint, item_id bigint, n_matched bigint, n_item bigint, start bigint, `end` bigint"

    def verify(batches: Iterator) -> Iterator:
        words, last, h = _Tokens(), None, None
        for b in sliced(batches):
            rows = []
            for doc, doc_id, t, item_id, n_item, data, shift in zip(*(c.to_pylist() for c in b.columns)):
                if doc != last:  # a document's diagonals mostly come one after the other
                    last, h = doc, tokens(t, words)
                if best := overlap(np.frombuffer(data, np.uint64), h, shift):
                    rows.append((doc_id, item_id, best[0], n_item, best[1], best[2]))
            yield _batch(rows, schema)

    best = whole.mapInArrow(verify, schema).groupBy("doc_id", "item_id").agg(F.max(F.struct("n_matched", "n_item", "start", "end")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_matched", "m.n_item", "m.start", "m.end")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of `docs` that hold no passage of the benchmark; each row goes by its own text, whatever rows share its id."""
    keyed = docs.withColumn("__key", row_key(id_col, text))
    bad = durable(leaks(keyed, benchmark, "__key", text, item_id, item_text).select(F.col("doc_id").alias("__leak")).distinct())
    return keyed.join(_small(bad, bad.count()), F.col("__key") == F.col("__leak"), "left_anti").drop("__key")
