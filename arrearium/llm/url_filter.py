"""URL filters: longest-prefix rules, and trust propagated over the link graph for what no rule decides.

Host edges come from the links of the pages: absolute and protocol-relative ones lead to their host, relative
ones back to the page's own. Trust is the personalised PageRank from the hosts that the rules allow; distrust
is the same on reversed edges from the hosts that they block, so that a host which links to blocked hosts is
distrusted. A host whose distrust exceeds its trust by the threshold is blocked, every other is allowed.

Each iteration is one join of the rank table with the edges on the giving host and one partial aggregate on
the receiving one; parallel links are counted into one weighted edge before. Ranks are checkpointed, and iterated
until all changes of an iteration sum to less than TOLERANCE: then no rank is further than TOLERANCE * DAMPING /
(1 - DAMPING) from its limit, however many links away from a seed a host is.

Defined results: a null url, or one without "://", has an empty host and path, no rule, and the verdict of
the host "" ("allow" unless linked with blocked hosts); an empty table gives an empty table; rows are judged
one by one, so repeated and null ids stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, lower_ascii

#: Fixed values: (verdict, host, path prefix).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

DAMPING = 0.85
TOLERANCE = 1e-6
CHECK_EVERY = 3
THRESHOLD = 0.0
_PARTS = r"://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, weight): links from host to host, counted."""
    src = host_of(F.col(f"`{url}`"))
    hrefs = F.regexp_extract_all(F.coalesce(F.col(f"`{html}`"), F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    relative = lambda x: ~F.startswith(x, F.lit("//")) & ~F.contains(x, F.lit("://"))
    outside = F.transform(F.filter(hrefs, lambda x: ~relative(x)), lambda x: host_of(F.when(F.startswith(x, F.lit("//")), F.concat(F.lit(":"), x)).otherwise(x)))
    # Links back to the own host need no row each: they are counted inside the page.
    dst = F.concat(F.array(F.struct(F.lit(None).cast("string").alias("dst"), F.size(F.filter(hrefs, relative)).cast("double").alias("n"))), F.transform(outside, lambda h: F.struct(h.alias("dst"), F.lit(1.0).alias("n"))))
    links = pages.select(src.alias("src"), F.explode(dst).alias("e")).select("src", F.coalesce("e.dst", "src").alias("dst"), F.col("e.n").alias("n"))
    return links.filter(F.col("n") > 0).groupBy("src", "dst").agg(F.sum("n").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """Personalised PageRank (host, rank) of `edges` (src, dst, weight) from `seeds` (host, weight); zero ranks are left out.

    What hosts without outgoing edges hold isn't handed on, so ranks sum to at most 1.
    """
    total = seeds.agg(F.sum("weight").alias("total"))
    start = durable(seeds.crossJoin(F.broadcast(total)).select("host", (F.col("weight") / F.col("total")).alias("seed")))  # one row on the right
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    shares = durable(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    ranks = start.select("host", F.col("seed").alias("rank"))
    zero = F.lit(0.0)
    while True:
        for _ in range(CHECK_EVERY):
            given = shares.join(ranks, F.col("src") == F.col("host")).groupBy("dst").agg(F.sum(F.col("share") * F.col("rank")).alias("given"))
            parts = given.select(F.col("dst").alias("host"), (F.col("given") * damping).alias("x"), zero.alias("old"))
            parts = parts.union(start.select("host", F.col("seed") * (1 - damping), zero)).union(ranks.select("host", zero, "rank"))
            ranks = parts.groupBy("host").agg(F.sum("x").alias("rank"), F.sum("old").alias("old"))
            step, ranks = ranks, ranks.select("host", "rank")
        step = durable(step)
        ranks = step.select("host", "rank")
        # An iteration shrinks the summed change by the damping at least, so this ends.
        if (step.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0.0) < tolerance:
            return ranks.filter("rank > 0")


def host_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, url: str = "url", html: str = "html") -> DataFrame:
    """(host, trust, distrust, verdict) of every host that has pages or links."""
    edges = durable(host_edges(pages, url, html))
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    judged = pages.select(host.alias("host"), rule_of(host, path, rules)["verdict"].alias("verdict"))
    seeds = durable(judged.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").cast("double").alias("allowed"), F.count_if(F.col("verdict") == "block").cast("double").alias("blocked")))
    trust = propagate(edges, seeds.filter("allowed > 0").select("host", F.col("allowed").alias("weight")), tolerance=tolerance)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, seeds.filter("blocked > 0").select("host", F.col("blocked").alias("weight")), tolerance=tolerance)
    zero = F.lit(0.0)
    parts = (
        seeds.select("host", zero.alias("trust"), zero.alias("distrust"))
        .union(trust.select("host", "rank", zero))
        .union(distrust.select("host", zero, "rank"))
        .groupBy("host")
        .agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    )
    return parts.withColumn("verdict", F.when(F.col("distrust") > F.col("trust") + threshold, "block").otherwise("allow"))


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row of `pages`: id, host, path, rule, verdict."""
    hosts = host_verdicts(pages, rules, threshold, url=url, html=html).select("host", F.col("verdict").alias("__host_verdict"))
    hosts = durable(hosts.filter("__host_verdict = 'block'"))
    host, path = host_of(F.col(f"`{url}`")), path_of(F.col(f"`{url}`"))
    base = pages.select(F.col(f"`{id_col}`").alias(id_col), host.alias("host"), path.alias("path")).withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    # The optimizer broadcasts the blocked hosts if they are few; a hot host is split by the adaptive skew join.
    return base.join(hosts, "host", "left").select(
        id_col, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", "__host_verdict", F.lit("allow")).alias("verdict")
    )
