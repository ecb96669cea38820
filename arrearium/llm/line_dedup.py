"""Line dedup by site-relative frequency.

Pages are grouped by host; the pages of a host that contain a line are divided by the host's page total, and
a line above the boilerplate ratio is dropped from the host's pages. The first page (smallest id) that holds
such a line keeps it, so that no text is lost from the corpus; a page that had words and has none left, all
of whose lines therefore stand on other pages of its host, is marked `emptied`.

Lines are compared trimmed, by their 128-bit hash; blank lines never count. Counting is a partial aggregate
per (host, line), so a line on a third of all pages costs one row for each task. A host can have at most
(lines per page) / ratio boilerplate lines, so those of a host fit in one row; that table is broadcast below a
checked size, and joined on a salted host beyond it.

Defined results: a null host is the host ""; a null text has no lines and stays null; every
row is a page of its own, also with a repeated or null id, and rows that share the smallest id all keep the
line; an empty table gives an empty table; all columns of the input stay, only the text changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, durable, let, once

RATIO = 0.1
MIN_PAGES = 3
BROADCAST_LINES = 200_000
SALTS = 64


def line_key(line: Column) -> Column:
    """Hash of a trimmed line, null for a blank one."""
    trimmed = F.btrim(line, F.lit(SEPARATORS))
    return F.when(trimmed != "", F.unhex(F.md5(trimmed)))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(host, line, n_pages, first): the lines above the ratio, and the smallest id among their pages."""
    site = F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host")
    page = F.col(f"`{id_col}`").alias("page")
    totals = pages.groupBy(site).agg(F.count("*").alias("total"))
    keys = F.array_distinct(F.transform(F.split(F.col(f"`{text}`"), "\n"), line_key))
    lines = pages.select(site, page, F.explode(keys).alias("line")).filter(F.col("line").isNotNull())
    counts = lines.groupBy("host", "line").agg(F.count("*").alias("n_pages"), F.min("page").alias("first")).filter(F.col("n_pages") >= min_pages)
    return counts.join(totals, "host").filter(F.col("n_pages") > F.lit(ratio) * F.col("total")).select("host", "line", "n_pages", "first")


def line_dedup(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES, host: str = "source", id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`pages` with the text that remains, and n_lines, n_dropped (long) and emptied (boolean)."""
    lines = durable(boilerplate(pages, ratio, min_pages, host, id_col, text))
    n = lines.count()
    by_host = lines.groupBy("host").agg(F.collect_list(F.struct("line", "first")).alias("__lines")).withColumnRenamed("host", "__host")
    made = {"n_lines", "n_dropped", "emptied"}
    kept_columns = [c for c in pages.columns if c.lower() not in made]
    docs = pages.select(*[F.col(f"`{c}`") for c in kept_columns]).withColumn("__host", F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")))
    if n <= BROADCAST_LINES:
        joined = docs.join(F.broadcast(by_host), "__host", "left")
    else:
        salted = by_host.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("__salt", F.pmod(F.xxhash64(f"`{id_col}`", f"`{text}`"), F.lit(SALTS)).cast("int")).join(salted, ["__host", "__salt"], "left")
    body, page = F.col(f"`{text}`"), F.col(f"`{id_col}`")

    def stays(line: Column) -> Column:
        return let(line_key(line), lambda k: ~F.exists(F.col("__lines"), lambda b: (b["line"] == k) & ~b["first"].eqNullSafe(page)) | k.isNull())

    n_lines = F.coalesce(F.size(F.split(body, "\n")).cast("bigint"), F.lit(0).cast("bigint"))
    result = F.when(
        F.col("__lines").isNotNull() & body.isNotNull(),
        let(F.split(body, "\n"), lambda x: let(F.filter(x, lambda line: stays(line)), lambda y: F.struct(F.array_join(y, "\n").alias("text"), (F.size(x) - F.size(y)).cast("bigint").alias("dropped")))),
    )
    out = once(joined, "__result", result)
    blank = lambda c: F.ltrim(c, F.lit(SEPARATORS)) == ""
    dropped = F.coalesce(F.col("__result.dropped"), F.lit(0).cast("bigint"))
    return out.select(
        *[(F.when(F.col("__result").isNotNull(), F.col("__result.text")).otherwise(body)).alias(c) if c == text else F.col(f"`{c}`") for c in kept_columns],
        F.when(body.isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"),
        dropped.alias("n_dropped"),
        F.coalesce((dropped > 0) & blank(F.col("__result.text")) & ~blank(body), F.lit(False)).alias("emptied"),
    )
