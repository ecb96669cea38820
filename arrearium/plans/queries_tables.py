"""Queries over the native tables: profiles, features, shifts, sets, streams run as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from arrearium.functions import periods
from arrearium.operators import audits, features, metrics, wide
from arrearium.sources.derived import table
from arrearium.streaming.month_close import event_counts

from .registry import query, rounded

_PROFILE = ["l_returnflag", "l_linestatus", "l_linenumber", "l_quantity"]
_RANGE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) FILTER ({c} IS NULL) AS n_null, count(DISTINCT {c}) AS n_distinct FROM lineitem" for c in _PROFILE))
def null_profile(spark: SparkSession, sf: str) -> DataFrame:
    return audits.null_profile(table(spark, sf, "lineitem"), _PROFILE)


@query("WITH u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value FROM lineitem" for c in _PROFILE[:3]) + "), c AS (SELECT column_name, value, count(*) AS n FROM u GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY column_name) AS t, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rn FROM c) SELECT column_name, value, round(n / t, 6) AS share FROM r WHERE rn = 1")
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(audits.top_values(table(spark, sf, "lineitem"), _PROFILE[:3]))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round(min({c}), 4) AS lo, round(max({c}), 4) AS hi, round(avg({c}), 4) AS mean, count(*) FILTER ({c} < 0) AS n_negative, max({c}) > 100 * avg({c}) AS extreme FROM lineitem" for c in _RANGE))
def range_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(audits.range_profile(table(spark, sf, "lineitem"), _RANGE), 4)


@query("SELECT o_custkey, o_orderdate, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return audits.duplicates(table(spark, sf, "orders"), ["o_custkey", "o_orderdate"])


@query("SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(avg((l_quantity = l_extendedprice)::INT), 6) AS equal_share, round(corr(l_quantity, l_extendedprice), 6) AS correlation, FALSE AS duplicate FROM lineitem UNION ALL SELECT 'l_orderkey', 'l_orderkey', 1, 1, TRUE")
def duplicate_columns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(audits.duplicate_columns(table(spark, sf, "lineitem"), [("l_quantity", "l_extendedprice"), ("l_orderkey", "l_orderkey")]))


@query("WITH f AS (SELECT l_shipmode_key AS k, v FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_key, l_extendedprice AS v, l_shipdate FROM lineitem) WHERE year(l_shipdate) < 1997) SELECT k AS flag, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, round(median(v), 3) AS median, count(v) AS count FROM f GROUP BY k")
def group_stats(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").withColumn("flag", F.concat("l_returnflag", "l_linestatus")).withColumn("v", F.col("l_extendedprice"))
    out = features.group_stats(df, "flag", "v", F.year("l_shipdate") < 1997).filter("not v_by_flag_fallback")
    one = out.groupBy("flag").agg(*[F.first(f"v_{s}_by_flag").alias(s) for s in ("mean", "std", "median", "count")])
    return rounded(one, 3)


@query("""WITH r AS (SELECT o_orderkey, o_totalprice AS x, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2 AS rk, count(*) OVER () AS n, avg(o_totalprice) OVER () AS m, stddev_samp(o_totalprice) OVER () AS s FROM orders)
  SELECT o_orderkey, round(rk, 6) AS x_rank, round((rk - 1) / (n - 1), 6) AS x_pct, round((x - m) / s, 6) AS x_z, round(ln(1 + greatest(x, 0)), 6) AS x_log1p, round(sqrt(greatest(x, 0)), 6) AS x_sqrt FROM r""")
def rank_features(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    return rounded(features.rank_features(df, "x").drop("x"))


@query("WITH e AS (SELECT list_sort(list_distinct(quantile_cont(o_totalprice, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM orders), b AS (SELECT o_orderkey, len(list_filter(e[2:len(e) - 1], lambda x: x < o_totalprice)) AS b FROM orders, e) SELECT o_orderkey, " + ", ".join(f"(b = {i})::INT AS x_q{i}" for i in range(5)) + " FROM b")
def quantile_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    return features.quantile_one_hot(df, "x", 5).drop("x")


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_quantity, 0) AS r FROM lineitem), p AS (SELECT quantile_cont(r, [0.01, 0.99]) AS p FROM r) SELECT l_orderkey, l_linenumber, round(greatest(least(r, p[2]), p[1]), 8) AS unit_price FROM r, p")
def clipped_ratios(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    return rounded(wide.ratio_columns(df, {"unit_price": ("l_extendedprice", "l_quantity")}).select("l_orderkey", "l_linenumber", "unit_price"), 8)


@query("WITH c AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code, o_totalprice FROM orders) SELECT o_orderkey, code, round(code * o_totalprice, 2) AS code_x_price, round(o_totalprice * o_totalprice, 1) AS price_squared FROM c")
def interaction_features(spark: SparkSession, sf: str) -> DataFrame:
    df = features.label_codes(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "code")
    out = features.interactions(df, {"code_x_price": ("code", "o_totalprice")}, {"price_squared": "o_totalprice"})
    return out.select("o_orderkey", "code", F.round("code_x_price", 2).alias("code_x_price"), F.round("price_squared", 1).alias("price_squared"))


@query()
def noise_controls(spark: SparkSession, sf: str) -> DataFrame:
    """Random control features, reproducible by key, and a noisy copy."""
    df = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    for i, (d, a, b) in enumerate([("uniform", 0, 1), ("normal", 0, 1), ("lognormal", 0, 0.5), ("int", 1, 6), ("poisson", 2, 0), ("exponential", 1, 0)]):
        df = features.noise_feature(df, "o_orderkey", f"{d}_noise", d, 10 * i + 1, a, b)
    return features.noisy_copy(df, "o_orderkey", "price")


_CORR = [(a, b) for i, a in enumerate(_RANGE) for b in _RANGE[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for a, b in _CORR))
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.correlation(table(spark, sf, "lineitem"), _RANGE))


@query("WITH s AS (SELECT DISTINCT year(l_shipdate) AS r, l_suppkey AS i FROM lineitem), n AS (SELECT r, count(*) AS n FROM s GROUP BY r) SELECT x.r AS a, y.r AS b, round(count(*) / (any_value(na.n) + any_value(nb.n) - count(*)), 6) AS jaccard FROM s x JOIN s y ON x.i = y.i AND x.r < y.r JOIN n na ON na.r = x.r JOIN n nb ON nb.r = y.r GROUP BY 1, 2")
def selection_overlap(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "lineitem").select(F.year("l_shipdate").alias("r"), F.col("l_suppkey").alias("i"))
    return rounded(metrics.jaccard(df, "r", "i"))


def _psi(group: str, source: str, bucket: str, ref: str) -> str:
    return f"""b AS (SELECT {group} AS grp, {bucket} AS lv, ({ref}) AS ref FROM {source}), r AS (SELECT lv, count(*) AS r FROM b WHERE ref GROUP BY lv), lv AS (SELECT DISTINCT lv FROM b), rt AS (SELECT count(*) AS rt FROM b WHERE ref),
      n AS (SELECT grp, lv, count(*) AS n FROM b GROUP BY ALL), gt AS (SELECT grp, count(*) AS nt FROM b GROUP BY grp),
      f AS (SELECT gt.grp, greatest(coalesce(n.n, 0) / nt, 1e-6) AS p, greatest(coalesce(r.r, 0) / rt, 1e-6) AS q FROM gt CROSS JOIN lv CROSS JOIN rt LEFT JOIN n ON n.grp = gt.grp AND n.lv = lv.lv LEFT JOIN r ON r.lv = lv.lv)
      SELECT grp AS "group", round(sum((p - q) * ln(p / q)), 6) AS psi FROM f GROUP BY grp"""


@query("WITH e AS (SELECT list_sort(list_distinct(quantile_cont(l_quantity, [" + ", ".join(str(i / 10) for i in range(11)) + "]))) AS e FROM lineitem WHERE year(l_shipdate) < 1997), " + _psi("year(l_shipdate)", "lineitem, e", "len(list_filter(e[2:len(e) - 1], lambda x: x <= l_quantity))", "year(l_shipdate) < 1997"))
def psi_numeric(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("l_shipdate")
    return rounded(metrics.psi_numeric(table(spark, sf, "lineitem"), "l_quantity", year, year < 1997))


@query("WITH " + _psi("year(o_orderdate)", "orders", "o_orderpriority", "year(o_orderdate) < 1997"))
def psi_categorical(spark: SparkSession, sf: str) -> DataFrame:
    year = F.year("o_orderdate")
    return rounded(metrics.psi_categorical(table(spark, sf, "orders"), "o_orderpriority", year, year < 1997))


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, round((avg({c}) FILTER (f) - avg({c}) FILTER (NOT f)) / sqrt((var_samp({c}) FILTER (f) + var_samp({c}) FILTER (NOT f)) / 2), 6) AS smd FROM (SELECT *, year(l_shipdate) < 1997 AS f FROM lineitem)" for c in _RANGE))
def mean_shift(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.smd(table(spark, sf, "lineitem"), _RANGE, F.year("l_shipdate") < 1997))


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS last_order, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, count(*) AS n FROM orders GROUP BY o_custkey")
def keep_first_last(spark: SparkSession, sf: str) -> DataFrame:
    """Deduplication to the first and the last row of a key."""
    o = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", o).alias("last_order"), F.min_by("o_orderkey", o).alias("first_order"), F.count("*").alias("n"))


@query("WITH r AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) SELECT o_orderpriority, o_orderkey, round(o_totalprice, 2) AS o_totalprice, rn FROM r WHERE rn <= 20")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 largest of each class; the rank filter is pushed into the window."""
    w = W.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return rounded(table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice").withColumn("rn", F.row_number().over(w)).filter("rn <= 20"), 2)


@query("WITH o AS (SELECT o_orderkey, year(o_orderdate) * 100 + month(o_orderdate) AS p, o_orderdate FROM orders) SELECT o_orderkey, p AS period, (((p // 100) * 12 + p % 100 + 14) // 12) * 100 + ((p // 100) * 12 + p % 100 + 14) % 12 + 1 AS plus15, 199812 // 100 * 12 + 12 - ((p // 100) * 12 + p % 100) AS to_1998_12, (p // 100)::VARCHAR || 'Q' || ((p % 100 - 1) // 3 + 1)::VARCHAR AS quarter, last_day(o_orderdate) = o_orderdate::DATE AS month_end, year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS day_int, 'ins' || strftime(o_orderdate, '%Y%m%d') || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS key FROM o")
def period_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    p = periods.period_of_date(F.col("o_orderdate"))
    return o.select(
        "o_orderkey", p.alias("period"), periods.period_add(p, 15).alias("plus15"), periods.period_diff(F.lit(199812), p).alias("to_1998_12"), periods.quarter_label(p).alias("quarter"),
        periods.is_month_end(F.col("o_orderdate")).alias("month_end"), periods.date_int(F.col("o_orderdate")).alias("day_int"), periods.account_key("ins", F.col("o_orderdate"), F.col("o_orderkey") % 10000).alias("key"),
    )


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(event_counts(table(spark, sf, "events")), 4)


@query("WITH e AS (SELECT event_id, user_id, value, lag(value) OVER w AS before, ts - lag(ts) OVER w > INTERVAL 30 MINUTE AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS n, count(*) FILTER (value > before) AS n_up, 1 + count(*) FILTER (cut) AS n_sessions FROM e GROUP BY user_id")
def user_flows(spark: SparkSession, sf: str) -> DataFrame:
    """Steps up and sessions of each user's events."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", (F.col("value") > F.lag("value").over(w)).alias("up"), (F.col("ts") - F.lag("ts").over(w) > F.expr("INTERVAL 30 MINUTES")).alias("cut"))
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("up").alias("n_up"), (1 + F.count_if("cut")).alias("n_sessions"))


@query("SELECT o_custkey FROM orders WHERE o_totalprice > 150000 INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def set_operations(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    big, urgent = o.filter("o_totalprice > 150000").select("o_custkey").distinct(), o.filter("o_orderpriority = '1-URGENT'").select("o_custkey")
    owing = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return big.join(urgent, "o_custkey", "left_semi").join(owing, "o_custkey", "left_anti")


@query("SELECT o.o_orderkey, c.c_mktsegment AS segment, c.c_custkey IS NULL AS missed FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey")
def keyed_lookup(spark: SparkSession, sf: str) -> DataFrame:
    from arrearium.operators.panel import lookup

    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    return lookup(table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k")), c, ["k"]).drop("k")
