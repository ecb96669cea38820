"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every metric is computed inside the row by built-in and higher-order functions, so the operator
adds no shuffle: one scan, one projection.

Defined results: a null text counts as an empty one (all metrics 0, base_failed true, kept false);
rows with equal or null doc_id are judged independently; an empty table gives an empty table; input
columns that have the name of an output column are replaced, all others are carried along. The rule on stop words
is for texts of LANGUAGES only, whose words the list has: it passes a null or other language, and every text of a
table without a language column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, let, once, without, words_of

WINDOW = 8
SYMBOLS = "#*$%&|<>"

#: Common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is it that for on with as was are be by this from at or an "
    "de la le les et des en un une du que qui dans pour par sur au "
    "der die das und ist im den von zu mit dem auf ein eine nicht sich "
    "el los las y una es se no con lo su para como"
).split()

#: Languages of the stop words.
LANGUAGES = ("en", "fr", "de", "es")

#: (rule, metric, reject if the metric is "<" or ">" the bound, bound). Metrics are those of `metrics()`.
RULES = [
    ("too_few_words", "n_words", "<", 20.0),
    ("repeated_windows", "repeat_ratio", ">", 0.3),
    ("symbol_share", "symbol_ratio", ">", 0.3),
    ("word_too_short", "mean_word_chars", "<", 1.5),
    ("word_too_long", "mean_word_chars", ">", 25.0),
    ("duplicate_lines", "dup_line_ratio", ">", 0.5),
    ("few_stop_words", "stop_ratio", "<", 0.01),
]
BY_LANGUAGE = ("few_stop_words",)
BASE_RULES = ("too_few_words", "repeated_windows")


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Number of words covered by n-word windows found at least twice in `words`, the first ones included.

    Windows are compared by their 64-bit hash. Texts without a repeated window, by far the most, stop
    at the distinct count; only the others sort (hash, start) and measure the union of repeated windows.
    """
    long = F.lit(0).cast("bigint")

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("bigint").alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            hits = F.filter(s, lambda x, i: same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x))
            return F.sort_array(F.transform(hits, lambda x: x["i"]))

        def union(at: Column) -> Column:
            gaps = F.transform(at, lambda a, i: F.when(i == 0, F.lit(n).cast("bigint")).otherwise(F.least(F.lit(n).cast("bigint"), a - F.get(at, i - 1))))
            return F.aggregate(gaps, long, lambda acc, g: acc + g)

        return let(pairs, lambda s: let(starts(s), union))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))

    # slice() would copy the whole array for each window; words are hashed once and read by position.
    return F.when(F.size(words) <= n, long).otherwise(
        let(
            let(F.transform(words, lambda w: F.xxhash64(w)), windows),
            lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), long).otherwise(covered(h)),
        )
    )


def metrics(text: Column, stop_words: list[str] | tuple[str, ...] = STOP_WORDS) -> Column:
    """One struct with all metrics of a text."""
    text = F.coalesce(text, F.lit(""))
    count = lambda c: c.cast("bigint")
    stops = sorted(set(stop_words))
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(SEPARATORS)) != "")

    def of(words: Column) -> Column:
        return F.struct(
            count(F.size(words)).alias("n_words"),
            count(F.length(without(text, SEPARATORS))).alias("word_chars"),
            count(F.length(text) - F.length(without(text, SYMBOLS))).alias("n_symbols"),
            let(lines, lambda x: F.struct(count(F.size(x)).alias("n_lines"), count(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("of_lines"),
            repeated_words(words).alias("n_repeat_words"),
            count(F.size(F.filter(words, lambda w: F.lower(w).isin(stops)))).alias("n_stop_words"),
        )

    return let(words_of(text), of)


def compile_rules(rules: list[tuple[str, str, str, float]]) -> list[tuple[str, Column]]:
    """(rule, condition under which it rejects) for each row of the table."""
    return [(name, F.col(m) < F.lit(bound) if op == "<" else F.col(m) > F.lit(bound)) for name, m, op, bound in rules]


def quality_rules(docs: DataFrame, rules: list[tuple[str, str, str, float]] = RULES, text: str = "text", lang: str = "lang") -> DataFrame:
    """`docs` with the metrics, `failed_rules` (array), `base_failed` and `kept`."""
    out = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"]
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    made = {*out, "symbol_ratio", "mean_word_chars", "dup_line_ratio", "stop_ratio", "repeat_ratio", "failed_rules", "base_failed", "kept"}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made or c == text]
    m = "__quality_metrics"
    flat = once(docs, m, metrics(F.col(f"`{text}`"))).select(
        *keep,
        *[F.col(f"{m}.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop_words")],
        *[F.col(f"{m}.of_lines.{c}").alias(c) for c in ("n_lines", "n_dup_lines")],
    )
    flat = flat.withColumns(
        {
            "symbol_ratio": ratio("n_symbols", "n_words"),
            "mean_word_chars": ratio("word_chars", "n_words"),
            "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
            "stop_ratio": ratio("n_stop_words", "n_words"),
            "repeat_ratio": ratio("n_repeat_words", "n_words"),
            "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        }
    )
    # The ratio 0.3 isn't exact in binary: the base rule is decided on integers.
    known = F.coalesce(F.col(f"`{lang}`").isin(*LANGUAGES), F.lit(False)) if lang in flat.columns else F.lit(False)
    exact = {"repeated_windows": F.when(F.col("n_words") >= 20, F.col("base_failed")).otherwise(False)}
    fails = [(name, c & known if name in BY_LANGUAGE else exact.get(name, c)) for name, c in compile_rules(rules)]
    failed = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in fails]), lambda x: x.isNotNull())
    return flat.withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
