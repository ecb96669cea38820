"""Spelling variant grouping by PartEnum signatures of letter multisets.

A word is the binary vector of its letter multiset (one dimension for each letter and count). One replaced code point
is Hamming distance two between two words of a length, one inserted or deleted code point distance one between words
of neighbouring lengths. The letters are partitioned into classes, and all ways to leave out as many classes as the
distance allows are enumerated: two words within it agree exactly in the letters of at least one remaining choice, so
an equi-join on these signatures finds every pair. PartEnum may use conditions on size beside the vector; here the
key also holds the length and an unchanged half of the word, since one edit leaves the first or the last half as it is.
Candidates are verified by edit distance, so hash collisions change nothing.

A chosen signature fits a pair in one way only, unless both letters of a replacement fall into one class; pairs are
made distinct after verification. No group is gathered: candidates are rows of a sort-merge join.

Defined results: null texts have no words; a null doc_id counts as empty in the hashed key; repeated rows count as
often as they stand there; an empty table gives an empty table; extra columns are not read. Ties among forms go to the
smaller word in code-point order.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, lower_ascii

#: Letters of a run, shortest word, fewest occurrences, deletion period, how much commoner a form is.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, PERIOD, RATIO = 7, 2, 31, 10
#: Letter classes for replacements (two are left out) and for insertions (one is left out).
CLASSES, HALVES = 4, 2


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with enough code points and occurrences, after the stated deletions.

    Runs shorter than a word can be are never taken out of the text; counts are summed before the shuffle.
    """
    runs = F.regexp_extract_all(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.lit(f"[{LETTERS}]{{{MIN_LENGTH},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", lower_ascii(F.col("run")).alias("run"))
    hashed = rows.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % PERIOD == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_COUNT)


def letter_classes(words: DataFrame, classes: int) -> list[str]:
    """The letters of all words dealt to so many classes of about the same weight; there are at most as many as LETTERS has."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''").groupBy("letter").count().collect()
    out = [""] * classes
    for i, r in enumerate(sorted(letters, key=lambda r: (-r["count"], r["letter"]))):
        lap, k = divmod(i, classes)
        out[k if lap % 2 == 0 else classes - 1 - k] += r["letter"]
    return out


def _rest(word: Column, dropped: str) -> Column:
    """The letter multiset without the dropped letters, as a sorted text."""
    return F.array_join(F.array_sort(F.split(F.translate(word, dropped, "") if dropped else word, "")), "")


def signatures(words: DataFrame, classes: list[str], halves: list[str]) -> DataFrame:
    """(key, role, word, n): role 0 for replacements, 1 and 2 for the shorter and the longer word of an insertion."""
    word, size = F.col("word"), F.length("word")
    kinds = [(k, "".join(c)) for k, c in enumerate(combinations(classes, 2))] + [(100 + k, c) for k, c in enumerate(halves)]
    sig = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _rest(word, dropped).alias("rest")) for k, dropped in kinds])).alias("s")
    rows = words.select("word", "n", sig).select("word", "n", "s.kind", "s.rest")

    def keys(role: int, base: Column) -> list[Column]:
        half = F.floor(base / 2).cast("int")
        first, last = F.substring(word, F.lit(1), half), F.substring(word, size - (base - half) + 1, base - half)
        return [F.struct(F.lit(role).alias("role"), F.xxhash64(F.lit(side), "kind", "rest", base, part).alias("key")) for side, part in enumerate((first, last))]

    own = F.when(F.col("kind") < 100, F.array(*keys(0, size))).otherwise(F.array(*keys(1, size), *keys(2, size - 1)))
    return rows.select("word", "n", F.explode(own).alias("k")).select("k.key", "k.role", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, na, b, nb), once for each unordered pair of words (word, n) that one edit parts."""
    rows = signatures(words, letter_classes(words, CLASSES), letter_classes(words, HALVES))
    left = rows.select("key", F.col("role").alias("ra"), F.col("word").alias("a"), F.col("n").alias("na"))
    right = rows.select(F.col("key").alias("kb"), F.col("role").alias("rb"), F.col("word").alias("b"), F.col("n").alias("nb"))
    fits = ((F.col("ra") == 0) & (F.col("rb") == 0) & (F.col("a") < F.col("b"))) | ((F.col("ra") == 1) & (F.col("rb") == 2))
    pairs = left.join(right, (F.col("key") == F.col("kb")) & fits & (F.levenshtein("a", "b", 1) == 1))
    return pairs.select("a", "na", "b", "nb").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the end of each chain, by doubling the steps. A form is ten times commoner than its
    word, so chains are short and have no cycles."""
    jump = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = jump.select(F.col("word").alias("w"), F.col("root").alias("r"))
        step = durable(jump.join(ahead, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("w").isNotNull().alias("moved")))
        jump = step.select("word", "root")
        if not step.filter("moved").limit(1).count():
            return jump


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = durable(word_counts(docs, id_col, text_col))
    pairs = near_pairs(words)
    links = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).union(pairs.select("b", "a", "na"))
    best = links.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "near")).alias("best"))
    rows = words.join(best, "word", "left")
    has = -F.col("best.less") >= RATIO * F.col("n")
    rows = durable(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
