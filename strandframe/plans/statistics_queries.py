"""Queries over histograms, running statistics and paired distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import histograms as H
from strandframe.operators.ordering import running_sums
from strandframe.plans import views as V
from strandframe.plans.registry import query

HIST_SQL = "h AS (SELECT CAST(floor(value) AS BIGINT) AS value, COUNT(*) AS n FROM events GROUP BY 1)"


def value_histogram(spark, d):
    return H.histogram(V.table(spark, d, "events"), F.floor("value"))


@query("agg13_histogram", f"WITH {HIST_SQL} SELECT value, n FROM h")
def agg13(spark, d):
    return value_histogram(spark, d)


@query("agg13_histogram_max", f"WITH {HIST_SQL} SELECT MAX(value) AS max_value FROM h")
def agg13_max(spark, d):
    return value_histogram(spark, d).agg(F.max("value").alias("max_value"))


@query("agg19_merged_histograms", "SELECT event_type, CAST(floor(value) AS BIGINT) AS value, COUNT(*) AS n FROM events GROUP BY 1, 2")
def agg19(spark, d):
    e = V.table(spark, d, "events").select("event_type", F.floor("value").alias("value"))
    return e.groupBy("event_type", "value").agg(F.count("*").alias("n"))


@query("agg14_mass_quantile", f"WITH {HIST_SQL}, r AS (SELECT value, SUM(value * n) OVER (ORDER BY value) AS run, SUM(value * n) OVER () AS total FROM h) "
       "SELECT q, (SELECT MIN(value) FROM r WHERE CAST(run AS DOUBLE) / total >= q) AS value FROM (VALUES (0.1::DOUBLE), (0.5), (0.9)) t(q)")
def agg14(spark, d):
    return H.mass_quantile(value_histogram(spark, d), 0.1, 0.5, 0.9)


MEDIAN_SQL = (HIST_SQL + ", med AS (SELECT MIN(value) AS median FROM (SELECT value, SUM(n) OVER (ORDER BY value) AS run, SUM(n) OVER () AS total FROM h) WHERE total - run <= total / 2)")
MAD_SQL = (MEDIAN_SQL + ", dev AS (SELECT abs(value - median) AS value, arg_max(n, value) AS n FROM h, med GROUP BY 1), "
           "mad AS (SELECT MIN(value) AS mad FROM (SELECT value, SUM(n) OVER (ORDER BY value) AS run, SUM(n) OVER () AS total FROM dev) WHERE total - run <= total / 2)")
CROP_SQL = (MAD_SQL + ", crop AS (SELECT value, n FROM h, med, mad WHERE abs(value - median) <= 5 * 1.4826 * mad), "
            "m1 AS (SELECT SUM(n * value) / SUM(n) AS mean, sqrt(SUM(n * value * value) / SUM(n) - (SUM(n * value) / SUM(n)) ** 2) AS sd FROM crop), "
            "kept AS (SELECT value, n FROM h, m1 WHERE abs(value - mean) <= 5 * sd)")


@query("agg15_median", f"WITH {MEDIAN_SQL} SELECT median FROM med")
def agg15(spark, d):
    return H.median(value_histogram(spark, d))


@query("agg16_median_deviation", f"WITH {MAD_SQL} SELECT median, mad FROM med, mad")
def agg16(spark, d):
    return H.median_deviation(value_histogram(spark, d))


@query("agg17_insert_size_stats", f"WITH {CROP_SQL} SELECT CAST(SUM(n) AS BIGINT) AS total, round(SUM(n * value) / SUM(n), 6) AS mean, "
       "round(sqrt(SUM(n * value * value) / SUM(n) - (SUM(n * value) / SUM(n)) ** 2), 6) AS sd FROM kept")
def agg17(spark, d):
    return H.insert_size_stats(value_histogram(spark, d)).select("total", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


@query("agg17_insert_size_percentiles", f"WITH {CROP_SQL}, r AS (SELECT value, n, SUM(n) OVER (ORDER BY value) AS run, SUM(n) OVER () AS total FROM kept), "
       "g AS (SELECT *, CAST(q AS INTEGER) AS percentile, floor(q / 100.0 * total) AS goal FROM r, range(5, 100, 5) t(q)) "
       "SELECT percentile, value FROM g WHERE run - n < goal AND run >= goal")
def agg17_percentiles(spark, d):
    return H.insert_size_percentiles(value_histogram(spark, d))


@query("agg18_normalized", f"WITH {HIST_SQL} SELECT value, round(n / SUM(n) OVER (), 9) AS share FROM h")
def agg18(spark, d):
    return H.normalized(value_histogram(spark, d)).select("value", F.round("share", 9).alias("share"))


@query("agg18_central_interval", f"WITH RECURSIVE {HIST_SQL}, p AS (SELECT value, n / SUM(n) OVER () AS share FROM h), "
       "g AS (SELECT CAST(33 AS BIGINT) AS low, CAST(35 AS BIGINT) AS high, COALESCE((SELECT share FROM p WHERE value = 34), 0) AS have, FALSE AS done UNION ALL "
       "SELECT CASE WHEN goes_left THEN low - 1 ELSE low END, CASE WHEN goes_right THEN high + 1 ELSE high END, have + CASE WHEN goes_left THEN a WHEN goes_right THEN b ELSE 0 END, "
       "NOT goes_left AND NOT goes_right FROM (SELECT *, a >= 0 AND a > b AS goes_left, b >= 0 AND NOT (a >= 0 AND a > b) AS goes_right FROM (SELECT g.*, COALESCE(l.share, -1) AS a, COALESCE(r.share, -1) AS b "
       "FROM g LEFT JOIN p l ON l.value = low LEFT JOIN p r ON r.value = high WHERE NOT done AND have < 0.5))) "
       "SELECT low, high FROM g ORDER BY done, have DESC LIMIT 1")
def agg18_interval(spark, d):
    return H.central_interval(value_histogram(spark, d), 34, 0.5)


@query("agg28_plot_summary", "SELECT MIN(value) AS min, MAX(value) AS max, round(AVG(value), 6) AS avg FROM events")
def agg28(spark, d):
    return H.summary(V.table(spark, d, "events"), "value").withColumn("avg", F.round("avg", 6))


@query("src19_number_list_summary", "SELECT MIN(p_size) AS min, MAX(p_size) AS max, COUNT(*) FILTER (p_size > 1) AS above_one FROM part")
def src19(spark, d):
    return H.above_one(V.table(spark, d, "part"), "p_size")


@query("flt4_counts_above_thresholds", "SELECT COUNT(*) FILTER (value >= 10) AS ge_10, COUNT(*) FILTER (value >= 50) AS ge_50, COUNT(*) FILTER (value >= 100) AS ge_100 FROM events")
def flt4(spark, d):
    return V.table(spark, d, "events").agg(*[F.count_if(F.col("value") >= t).alias(f"ge_{t}") for t in (10, 50, 100)])


@query("win5_running_sums", f"WITH {HIST_SQL} SELECT value, n, CAST(SUM(n) OVER (ORDER BY value) AS BIGINT) AS running FROM h")
def win5(spark, d):
    return running_sums(value_histogram(spark, d), ["value"], {"running": "n"})


@query("win6_running_minimum", "SELECT user_id, event_id, MIN(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS low FROM events")
def win6(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_id", "value")
    return H.running_minimum(e, "user_id", "event_id", "value").select("user_id", "event_id", "low")


@query("win7_median_of_three", "SELECT user_id, event_id, CASE WHEN a IS NULL OR c IS NULL THEN value ELSE list_sort([a, value, c])[2] END AS smooth FROM "
       "(SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))")
def win7(spark, d):
    return H.median_of_three(V.table(spark, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "smooth")


@query("win7_smoothed_series")
def win7_full(spark, d):
    e = V.table(spark, d, "events").select("user_id", "event_id", "value")
    return H.smoothed_series(e, "user_id", "event_id", "value")


@query("win3_first_hit", "SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def win3(spark, d):
    hits = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (-F.col("l_extendedprice")).alias("_p"))
    return H.first_hits(hits, "l_orderkey", ["_p", "l_linenumber"]).select("l_orderkey", "l_partkey")


@query("win4_top_four_hits", "SELECT l_orderkey, l_partkey, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn FROM lineitem) WHERE rn <= 4")
def win4(spark, d):
    hits = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", (-F.col("l_extendedprice")).alias("_p"))
    return H.first_hits(hits, "l_orderkey", ["_p", "l_linenumber"], 4).select("l_orderkey", "l_partkey", "rank")


@query("win8_plot_chunks", "SELECT l_suppkey, l_orderkey, l_linenumber, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1) // 10 AS plot FROM lineitem")
def win8(spark, d):
    li = V.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    return H.plot_chunks(li, "l_suppkey", ["l_orderkey", "l_linenumber"]).withColumn("plot", F.col("plot").cast("long"))


# Edges with length and coverage: one per part and supplier pair.
EDGES_SQL = ("e AS (SELECT l_partkey AS src, l_suppkey AS dst, CAST(SUM(l_quantity) AS BIGINT) AS length, COUNT(*) AS n, SUM(l_quantity) / COUNT(*) AS coverage FROM lineitem GROUP BY 1, 2)")


def supply_edges(spark, d):
    return V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(
        F.sum("l_quantity").cast("long").alias("length"), F.count("*").alias("n"), (F.sum("l_quantity") / F.count("*")).alias("coverage"))


@query("agg23_weighted_coverage", f"WITH {EDGES_SQL} SELECT round(SUM(coverage * length) FILTER (length >= 10) / SUM(length) FILTER (length >= 10), 6) AS avg_coverage FROM e")
def agg23(spark, d):
    return H.weighted_coverage(supply_edges(spark, d), 10).select(F.round("avg_coverage", 6).alias("avg_coverage"))


@query("agg24_median_coverage", f"WITH {EDGES_SQL} SELECT coverage AS median_coverage FROM (SELECT coverage, row_number() OVER (ORDER BY coverage) AS rn, COUNT(*) OVER () AS c FROM e WHERE length > 20) WHERE rn = c // 2 + 1")
def agg24(spark, d):
    return H.median_coverage(supply_edges(spark, d), 20)


SMOOTH_SQL = (HIST_SQL + ", s AS (SELECT COUNT(*) AS size, MAX(value) AS top FROM h), grid AS (SELECT unnest(range(0, top + 1)) AS value FROM s), "
              "w AS (SELECT g.value, COALESCE(SUM(h.n * least(h.value - g.value + 1, 15 - (h.value - g.value))), 0) AS weight FROM grid g LEFT JOIN h ON h.value BETWEEN g.value AND g.value + 14 "
              "AND h.value < (SELECT size FROM s) GROUP BY g.value)")


@query("agg25_smoothed_counts", f"WITH {SMOOTH_SQL} SELECT value, CAST(weight AS BIGINT) AS weight FROM w")
def agg25(spark, d):
    return H.smoothed_counts(value_histogram(spark, d), 15)


@query("agg25_rising_threshold", f"WITH {SMOOTH_SQL}, u AS (SELECT value, CASE WHEN weight > lag(weight) OVER (ORDER BY value) THEN 1 ELSE 0 END AS up FROM w), "
       "r AS (SELECT value, SUM(up) OVER (ORDER BY value ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS c FROM u) "
       "SELECT MIN(value) AS threshold FROM r, s WHERE value >= 1 AND value + 15 < top + 1 AND 2 * c >= 15")
def agg25_threshold(spark, d):
    return H.rising_threshold(value_histogram(spark, d), 15)


# Paired points: per user and event type the event values at one decimal.
POINTS_SQL = "pts AS (SELECT user_id, event_type, value AS d, CAST(COUNT(*) AS DOUBLE) AS weight FROM events GROUP BY ALL)"
CHAIN_SQL = (POINTS_SQL + ", ch AS (SELECT *, SUM(nw) OVER (PARTITION BY user_id, event_type ORDER BY d) AS chain FROM (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY user_id, event_type ORDER BY d) <= 10 THEN 0 ELSE 1 END AS nw FROM pts))")


def points(spark, d):
    return V.table(spark, d, "events").groupBy("user_id", "event_type", F.col("value").alias("d")).agg(F.count("*").cast("double").alias("weight"))


@query("agg29_clustered_points", f"WITH {CHAIN_SQL} SELECT user_id, event_type, round((MIN(d) + MAX(d)) * 0.5, 6) AS centre, SUM(weight) AS weight, round((MAX(d) - MIN(d)) * 0.5, 6) AS spread FROM ch GROUP BY user_id, event_type, chain")
def agg29(spark, d):
    c = H.cluster_points(points(spark, d), ["user_id", "event_type"], 10)
    return c.withColumns({"centre": F.round("centre", 6), "spread": F.round("spread", 6)})


@query("gr21_smoothed_points", f"WITH {CHAIN_SQL}, a AS (SELECT user_id, event_type, chain, CAST(round(d) AS BIGINT) AS p, weight FROM ch), "
       "sp AS (SELECT user_id, event_type, chain, unnest(range(lo, hi + 1)) AS d FROM (SELECT user_id, event_type, chain, MIN(p) AS lo, MAX(p) AS hi FROM a GROUP BY user_id, event_type, chain)) SELECT sp.user_id, sp.event_type, sp.chain, sp.d, "
       "round(COALESCE(SUM(weight * (1 - abs(sp.d - p) / 4)), 0), 6) AS weight FROM sp LEFT JOIN a ON a.user_id = sp.user_id AND a.event_type = sp.event_type AND a.chain = sp.chain "
       "AND abs(sp.d - p) <= 3 GROUP BY ALL")
def gr21(spark, d):
    s = H.smoothed_points(points(spark, d), ["user_id", "event_type"], 10, 3)
    return s.withColumn("weight", F.round("weight", 6))


GRAPH_DIST_SQL = "gd AS (SELECT DISTINCT event_type, CAST(round(value / 7) * 7 AS BIGINT) AS length FROM events)"


@query("gr19_estimated_distances", f"WITH pts AS (SELECT event_type, round(value) AS d, CAST(COUNT(*) AS DOUBLE) AS weight FROM events GROUP BY ALL), {GRAPH_DIST_SQL}, "
       "bd AS (SELECT event_type, MIN(d) AS lo, MAX(d) AS hi FROM pts GROUP BY ALL), "
       "pr AS (SELECT p.event_type, d, weight, length, abs(d - length) AS gap, MIN(abs(d - length)) OVER (PARTITION BY p.event_type, d) AS best FROM pts p JOIN gd ON p.event_type = gd.event_type JOIN bd ON bd.event_type = p.event_type WHERE 2 * d + lo >= hi), "
       "nn AS (SELECT *, COUNT(*) OVER (PARTITION BY event_type, d) AS ties FROM pr WHERE gap = best), "
       "gv AS (SELECT event_type, length, SUM(weight / ties) FILTER (gap <= 3) AS weight FROM nn GROUP BY ALL) "
       "SELECT gd.event_type, gd.length, COALESCE(gv.weight, 0) AS weight FROM gd JOIN bd ON gd.event_type = bd.event_type AND length BETWEEN lo - 3 AND hi + 3 LEFT JOIN gv ON gv.event_type = gd.event_type AND gv.length = gd.length")
def gr19(spark, d):
    e = V.table(spark, d, "events")
    pts = e.groupBy("event_type", F.round("value").alias("d")).agg(F.count("*").cast("double").alias("weight"))
    graph = e.select("event_type", (F.round(F.col("value") / 7) * 7).cast("long").alias("length")).distinct()
    # the longest and the shortest distance of a type stand for the lengths of its two edges
    ends = pts.groupBy("event_type").agg(F.max("d").alias("first_length"), F.min("d").alias("second_length"))
    return H.estimate_distances(pts.join(ends, "event_type"), graph, ["event_type"], 3, ("first_length", "second_length"))


@query("gr20_weighted_distances", f"WITH pts AS (SELECT event_type, round(value) AS d, SUM(1.0 / (1 + user_id)) AS weight FROM events GROUP BY ALL), {GRAPH_DIST_SQL}, "
       "pr AS (SELECT p.event_type, d, weight, length, abs(d - length) AS gap, MIN(abs(d - length)) OVER (PARTITION BY p.event_type, d) AS best FROM pts p JOIN gd ON p.event_type = gd.event_type), "
       "nn AS (SELECT *, COUNT(*) OVER (PARTITION BY event_type, d) AS ties FROM pr WHERE gap = best), "
       "gv AS (SELECT event_type, length, SUM(weight / ties) FILTER (gap <= 3) AS weight FROM nn GROUP BY ALL), "
       "bd AS (SELECT event_type, MIN(d) AS lo, MAX(d) AS hi FROM pts GROUP BY ALL) "
       "SELECT gd.event_type, gd.length, round(COALESCE(gv.weight, 0), 5) AS weight FROM gd JOIN bd ON gd.event_type = bd.event_type AND length BETWEEN lo - 3 AND hi + 3 LEFT JOIN gv ON gv.event_type = gd.event_type AND gv.length = gd.length")
def gr20(spark, d):
    e = V.table(spark, d, "events")
    pts = e.groupBy("event_type", F.round("value").alias("d")).agg(F.sum(1.0 / (1 + F.col("user_id"))).alias("weight"))
    graph = e.select("event_type", (F.round(F.col("value") / 7) * 7).cast("long").alias("length")).distinct()
    return H.estimate_distances(pts, graph, ["event_type"], 3).withColumn("weight", F.round("weight", 5))


RANGES_SQL = "rg AS (SELECT l_suppkey, l_partkey // 100 AS contig, CAST(l_orderkey AS BIGINT) AS lo, CAST(l_orderkey + l_quantity AS BIGINT) AS hi FROM lineitem)"


def ranges(spark, d):
    return V.table(spark, d, "lineitem").select("l_suppkey", F.expr("l_partkey div 100").alias("contig"), F.col("l_orderkey").alias("lo"),
                                                (F.col("l_orderkey") + F.col("l_quantity")).cast("long").alias("hi"))


@query("gr16_merged_positions", f"WITH {RANGES_SQL}, m AS (SELECT *, CASE WHEN lo > MAX(hi) OVER (PARTITION BY l_suppkey, contig ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS nw FROM rg), "
       "g AS (SELECT *, SUM(nw) OVER (PARTITION BY l_suppkey, contig ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT l_suppkey, contig, MIN(lo) AS lo, MAX(hi) AS hi FROM g GROUP BY l_suppkey, contig, k")
def gr16(spark, d):
    return H.merge_ranges(ranges(spark, d), ["l_suppkey", "contig"])


@query("fn17_range_envelope", f"WITH {RANGES_SQL} SELECT l_suppkey, contig, MIN(lo) AS lo, MAX(hi) AS hi FROM rg GROUP BY ALL")
def fn17(spark, d):
    return H.envelope(ranges(spark, d), ["l_suppkey", "contig"])


@query("snk11_repeated_values", f"WITH {HIST_SQL} SELECT value FROM (SELECT value, unnest(range(0, n)) AS i FROM h)")
def snk11(spark, d):
    return H.repeated_values(value_histogram(spark, d))


@query("it1_bag_counts", "SELECT event_type, user_id, COUNT(*) AS n FROM events GROUP BY ALL")
def it1(spark, d):
    return V.table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
