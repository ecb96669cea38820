"""MinHash near-duplicate detection with min-max hashing.

1. Every text becomes the set of its distinct word shingles (64-bit hashes). Equal sets are one node from here on.
2. Min-max hashing: each multiplicative hash of the set gives two signature values, its minimum and its maximum,
   so BANDS * ROWS values need half as many hash evaluations. At similarity 0.8 all bands miss with
   probability (1 - 0.8^ROWS)^BANDS, 4e-8 for 56 bands of 6.
3. Every node is compared with the most central nodes of its buckets, those whose buckets hold most nodes: first with
   the one most of its buckets agree on, then, where a bucket still holds several components, with each of them. That
   is at most one comparison a node and band, and links most of what is alike.
4. Buckets that still hold several components are finished exactly. Small ones are compared pair by pair across
   components. The nodes of large ones go through a prefix join: shingles ordered by rarity, a pair can only be
   similar enough if it shares one among the rarest of both, within the positional bound of the overlap, and if the
   parity bitmaps of both sets differ in no more bits than the sets may in shingles. A node with too many shingles of
   its own thereby drops out without being compared with anyone. Of each shingle the component with most nodes is
   found first; only nodes of other components are compared with all that share it, so a group that is one component
   already never meets itself, and a shingle of many nodes is dealt by salts. So no pair is given up, and no group is
   expanded into all pairs.
5. Candidates are confirmed on full sets, recomputed from the texts of just the nodes concerned.

Defined results: texts without words (null, empty) have an empty set, component_id = doc_id, linked with nothing;
rows with a repeated doc_id and the same text are one document, with different texts they are one node that any of
its texts can link, each row keeping its own n_shingles; a null doc_id never links others, its component is that
of an equal set or null; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, sized
from .components import connected_components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 56, 6
SMALL_BUCKET = 16
PIVOT_SALT = 500
SHINGLE_SALT = 500  # nodes that share a shingle, in one task
BROADCAST_ROWS = 500_000
BITMAP = 8  # 64-bit words of the parity bitmap of a set
WORDS = 100_000  # word hashes kept by a task
SETS = 20_000  # sets of a partition
SLICE = 512  # rows of an Arrow batch worked on at once
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def sliced(batches: Iterator, rows: int = SLICE) -> Iterator:
    """Smaller pieces of Arrow batches, so that what is made of them at once stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, k: int, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z lower-cased, words parted by [\\x20\\x09-\\x0D]."""
    ws = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII only, in both
    if not ws:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, ws), np.uint64, len(ws))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        out = mix(out * _MIX + h[i : len(h) - n + 1 + i])
    return np.unique(out)


def multipliers(count: int) -> np.ndarray:
    return mix(np.arange(1, count + 1, dtype=np.uint64) * _MIX) | np.uint64(1)


def band_keys(s: np.ndarray, a: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of the min-max signature."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(a), np.uint64)
    for i in range(0, len(s), 1024):
        x = a[:, None] * s[None, i : i + 1024]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    sig = np.concatenate([low, high]).reshape(rows, bands)  # a band mixes minima and maxima of different hashes
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * _MIX + sig[r])
    return key.view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, id_col: str, text: str) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands): set_key is a 128-bit hash of the set, null for an empty one."""
    import pyarrow as pa

    names = ["doc_id", "n_shingles", "set_key", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, a = _Words(), multipliers(bands * rows // 2)
        for b in sliced(batches):
            n, keys, out = [], [], []
            for t in b.column("text").to_pylist():
                s = shingle_set(t, shingle, words)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out.append(band_keys(s, a, bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.int64()))], names=names)

    columns = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return columns.mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def _small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast a table of known size where it is small; a shuffled join serves beyond."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def parity(s: np.ndarray) -> list[int]:
    """Bitmap of a set: each element flips a bit, so two bitmaps differ in at most as many bits as their sets in elements."""
    bits = (np.bincount((mix(s) >> np.uint64(32)).astype(np.int64) % (64 * BITMAP), minlength=64 * BITMAP) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64).tolist()


def shingle_sets(docs: DataFrame, ids: DataFrame, shingle: int, id_col: str, text: str) -> DataFrame:
    """(node, n, members, bitmap): full sets as sorted binary, of the given nodes only."""
    import pyarrow as pa

    ids = sized(ids)
    here = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("node"), F.col(f"`{text}`").alias("text")).join(_small(ids, ids.count()), "node", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for b in sliced(batches):
            sets = [shingle_set(t, shingle, words) for t in b.column("text").to_pylist()]
            made = [pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([parity(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("node"), *made], names=["node", "n", "members", "bitmap"])

    return sized(here.mapInArrow(run, "node bigint, n int, members binary, bitmap array<bigint>"), SETS)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy 100 * intersection >= percent * union.

    A node in very many pairs as `a` is dealt over several salted copies of its set.
    """
    import pyarrow as pa

    counts = pairs.groupBy("a").agg(F.count("*").alias("c")).select("a", (F.floor(F.col("c") / PIVOT_SALT) + 1).cast("int").alias("salts"))
    counts = sized(counts)
    left = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a")).join(counts, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    right = pairs.join(counts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts").cast("bigint")).cast("int")).drop("salts")
    right = right.join(sets.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b")
    joined = right.join(left, ["a", "salt"]).select("a", "b", "set_a", "set_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum()) if len(x) else 0
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return sized(joined.mapInArrow(run, "a bigint, b bigint").distinct())


def prefix_pairs(sets: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that can reach the similarity, by prefix and positional bounds."""
    t = percent / 100
    shingles = sets.join(components, "node").select("node", "component", "n", F.explode(_unpack(F.col("members"))).alias("s"))
    df = sized(shingles.groupBy("s").agg(F.count("*").alias("df")).filter("df > 1"))
    # What stands on one node only, orders first and can't match; it just shifts the others.
    ordered = shingles.join(df, "s", "left").groupBy("node", "component", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("o"))
    prefix = (
        ordered.withColumn("o", F.slice("o", F.lit(1), F.col("n") - F.ceil(F.col("n") * F.lit(t) - 1e-9).cast("int") + 1))
        .select("node", "component", "n", F.posexplode("o").alias("pos", "x"))
        .filter("x.df > 1")
        .select("node", "component", "n", "pos", F.col("x.s").alias("s"))
    )
    prefix = sized(prefix)
    # The largest component of each shingle that several share.
    sizes = prefix.groupBy("s", "component").agg(F.count("*").alias("c"))
    top = sizes.groupBy("s").agg(F.max_by("component", F.struct("c", "component")).alias("top"), F.sum("c").alias("total"), F.count("*").alias("parts")).filter("parts > 1")
    top = sized(top.select("s", "top", (F.floor(F.col("total") / SHINGLE_SALT) + 1).cast("int").alias("salts")))
    bits = [f"b{i}" for i in range(BITMAP)]
    rows = sized(prefix.join(top, "s").join(sets.select("node", *[F.col("bitmap")[i].alias(b) for i, b in enumerate(bits)]), "node"))
    x = rows.filter("component <> top").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select(*[F.col(c).alias(f"x_{c}") for c in ("s", "salt", "node", "component", "n", "pos", "top", *bits)])
    y = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts").cast("bigint")).cast("int")).select("s", "salt", "node", "component", "n", "pos", *bits)
    n, m = F.col("x_n"), F.col("n")
    need = F.lit(t / (1 + t)) * (n + m) - 1e-6
    once = (F.col("component") == F.col("x_top")) | (F.col("x_node") < F.col("node"))
    similar = (F.least(n, m) >= F.greatest(n, m) * F.lit(t) - 1e-6) & (F.least(n - F.col("x_pos"), m - F.col("pos")) >= need)
    apart = F.lit(0)
    for b in bits:
        apart = apart + F.bit_count(F.col(f"x_{b}").bitwiseXOR(F.col(b)))
    near = apart <= n + m - 2 * F.ceil(need)
    on = (F.col("x_s") == F.col("s")) & (F.col("x_salt") == F.col("salt")) & (F.col("x_component") != F.col("component")) & once & similar & near
    return x.join(y, on).select(F.least("x_node", "node").alias("a"), F.greatest("x_node", "node").alias("b")).distinct()


def _unpack(members: F.Column) -> F.Column:
    """The 8-byte pieces of a binary column; order and sign don't matter here."""
    return F.transform(F.sequence(F.lit(0), (F.octet_length(members) / 8).cast("int") - 1), lambda i: F.substring(members, i * 8 + 1, F.lit(8)))


def central_pairs(members: DataFrame, components: DataFrame, only_first: bool) -> DataFrame:
    """(a, b): nodes b with the most central node a of their buckets, where that is of another component.

    Only the node that most buckets name, or each; at most as many pairs as a node has bands.
    """
    labelled = members.join(components, "node", "left").select("bucket", "node", "weight", F.coalesce("component", "node").alias("component"))
    head = F.max_by(F.struct("node", "component"), F.struct("weight", -F.col("node")))
    heads = labelled.groupBy("bucket").agg(head.alias("h"), F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    heads = sized(heads.select("bucket", F.col("h.node").alias("a"), F.col("h.component").alias("of_a")))
    votes = labelled.join(heads, "bucket").filter("component <> of_a").groupBy("node", "a").agg(F.count("*").alias("c"))
    if not only_first:
        return votes.select("a", F.col("node").alias("b"))
    return votes.groupBy("node").agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", F.col("node").alias("b"))


def _without(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """Pairs that aren't among `tried`, in whatever order."""
    same = (F.least("a", "b") == F.col("__lo")) & (F.greatest("a", "b") == F.col("__hi"))
    return pairs.join(tried.select(F.least("a", "b").alias("__lo"), F.greatest("a", "b").alias("__hi")).distinct(), same, "left_anti")


def near_dedup(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    percent = round(100 * similarity)
    signed = durable(signatures(docs, shingle, bands, rows, id_col, text))
    nodes = signed.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    nodes = durable(nodes)
    banded = nodes.filter("node is not null").select("node", F.col("n").cast("int").alias("n"), F.explode("bands").alias("bucket"))
    # Written before it is joined, so that the join's rows of a hot bucket can be split.
    shared = sized(banded.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
    members = sized(banded.join(shared, "bucket"))
    central = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = sized(members.join(central, "node"))

    sets_of = lambda pairs: shingle_sets(docs, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), shingle, id_col, text)
    none = members.select("node", F.col("node").alias("component")).limit(0)
    first = sized(central_pairs(members, none, only_first=True))
    links = confirm(first, sets_of(first), percent)
    components = sized(connected_components(links))
    second = sized(_without(central_pairs(members, components, only_first=False), first))
    links = sized(links.union(confirm(second, sets_of(second), percent)))
    components = sized(connected_components(links))
    tried = first.union(second)

    # What these links leave open.
    labelled = members.join(components, "node", "left").select("bucket", "size", "node", "n", F.coalesce("component", "node").alias("component"))
    labelled = sized(labelled)
    open_ = sized(labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket"))
    labelled = sized(labelled.join(open_, "bucket", "left_semi"))
    small = labelled.filter(F.col("size") <= SMALL_BUCKET)
    x, y = small.alias("x"), small.alias("y")
    ratio = F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent
    crossing = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & ratio)
    pairs = crossing.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    large = sized(labelled.filter(F.col("size") > SMALL_BUCKET).select("node", "component").distinct())
    large_sets = shingle_sets(docs, large.select("node"), shingle, id_col, text)
    pairs = sized(_without(pairs.union(prefix_pairs(large_sets, large, percent)).distinct(), tried))
    more = confirm(pairs, sets_of(pairs), percent)
    components = connected_components(links.union(more))

    of_set = nodes.join(components, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    of_set = durable(of_set)
    signed = signed.select("doc_id", "n_shingles", "set_key")
    empty = F.lit(None).cast("bigint").alias("component_id")
    # Texts without words share no key; they don't go through the join.
    out = signed.filter("set_key is not null").join(of_set, "set_key").select("doc_id", "n_shingles", "component_id").union(signed.filter("set_key is null").select("doc_id", "n_shingles", empty))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def row_key(id_col: str, text: str) -> Column:
    """64-bit key of a row's id and text; rows that repeat both share it, a null id differs from every other."""
    page = F.col(f"`{id_col}`")
    return F.xxhash64(page.isNull(), page, F.coalesce(F.col(f"`{text}`"), F.lit("")))


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` of which one document of each group of near copies stays, the one with the smallest id.

    Each distinct pair of id and text is a document of its own, so that rows which only share an id, or have none, are
    judged each by its text; a null id comes after all others. Texts without words all stay; of rows that repeat both
    id and text the one whose JSON form is smallest stays. Rows are told apart by a 64-bit hash of id and text.
    """
    keyed = docs.withColumn("__key", row_key(id_col, text))
    found = durable(near_dedup(keyed.select("__key", F.col(f"`{text}`").alias("__text")), shingle, similarity, id_col="__key", text="__text").filter("n_shingles > 0"))
    copies = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone"), "component_id")
    # Groups of two or more: the copies, and the node that names their component.
    linked = sized(copies.union(copies.select("component_id", "component_id")).distinct())
    page = F.col(f"`{id_col}`")
    ids = keyed.select("__key", page.isNull().alias("__no_id"), page.alias("__id")).join(_small(linked, linked.count()), F.col("__key") == F.col("__gone"))
    stays = ids.groupBy("component_id").agg(F.min(F.struct("__no_id", "__id", "__key")).alias("s")).select(F.col("s.__key").alias("__gone"))
    gone = linked.select("__gone").join(stays, "__gone", "left_anti")
    repeated = found.groupBy(F.col("doc_id").alias("__gone")).count().filter("count > 1").select("__gone")
    repeated = sized(repeated.join(gone, "__gone", "left_anti"))
    n = repeated.count()
    out = sized(gone.union(repeated))
    kept = keyed.join(_small(out, out.count()), F.col("__key") == F.col("__gone"), "left_anti")
    if n:
        again = keyed.join(_small(repeated, n), F.col("__key") == F.col("__gone"), "left_semi")
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        first = again.groupBy("__key").agg(F.min_by(row, F.to_json(row)).alias("r"))  # the first by content, whatever the partitions
        kept = kept.union(first.select("r.*", "__key"))
    return kept.drop("__key")
