"""Queries over flows, strong components, loops and forests.

The graph: the words of each sentence of each conversation turn, an edge for each pair
of adjacent words.  An edge is as long as its second word and covered by the number of
times.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import flow, forest, loops, relative_coverage
from strandframe.operators import graph as G
from strandframe.operators.strong import strong_components
from strandframe.plans import views as V
from strandframe.plans.registry import query
from strandframe.session import settled, shuffle_partitions


def phrases(spark, d):
    turns = V.spread(V.table(spark, d, "conversations"), "conv_id", "turn")
    sentences = turns.select("conv_id", "turn", F.posexplode(F.split("text", "[.!?]")).alias("i", "s"))
    words = sentences.select(F.concat_ws(":", "conv_id", "turn", "i").alias("t"), F.transform(
        F.regexp_extract_all("s", F.lit("[A-Za-z]+"), F.lit(0)), F.lower).alias("w"))
    # a sentence goes to one task as a whole, where its pairs are counted and stay side by side
    whole = words.where("size(w) > 1").repartition(shuffle_partitions(spark), "t")
    pairs = whole.select("t", F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("p"))
    return pairs.groupBy("t", "p").agg(F.count("*").cast("double").alias("coverage")).select(
        F.concat_ws(":", "t", F.concat_ws(">", "p.a", "p.b")).alias("edge_id"), F.concat_ws(":", "t", "p.a").alias("src"),
        F.concat_ws(":", "t", "p.b").alias("dst"), F.length("p.b").cast("long").alias("length"), "coverage")


PHRASES_SQL = ("s AS (SELECT conv_id || ':' || turn AS t, string_split_regex(text, '[.!?]') AS s FROM conversations), "
               "u AS (SELECT t, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS i FROM s), "
               "w AS (SELECT t || ':' || i AS t, list_transform(regexp_extract_all(s, '[A-Za-z]+'), lambda x: lower(x)) AS w FROM u), "
               "p AS (SELECT t, unnest(w[1:-2]) AS a, unnest(w[2:]) AS b FROM w WHERE len(w) > 1), "
               "e AS MATERIALIZED (SELECT t || ':' || a || '>' || b AS edge_id, t || ':' || a AS src, t || ':' || b AS dst, t, CAST(length(b) AS BIGINT) AS length, "
               "CAST(COUNT(*) AS DOUBLE) AS coverage FROM p GROUP BY t, a, b), "
               "deg AS MATERIALIZED (SELECT v, CAST(SUM(i) AS BIGINT) AS n_in, CAST(SUM(o) AS BIGINT) AS n_out FROM (SELECT src AS v, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY v)")


@query("gr9_phrase_edges", f"WITH {PHRASES_SQL} SELECT edge_id, src, dst, length, coverage FROM e")
def phrase_edges(spark, d):
    return phrases(spark, d)


@query("gr9_unneeded_edges")
def gr9(spark, d):
    """No SQL: a maximum flow; held against augmenting paths on random graphs."""
    return flow.unneeded_edges(settled(phrases(spark, d)), max_length=5, unique_length=9, plausible_length=7)


@query("gr12_strong_components", f"WITH RECURSIVE {PHRASES_SQL}, r AS (SELECT v, v AS u FROM deg UNION SELECT r.v, e.dst FROM r JOIN e ON e.src = r.u) "
       "SELECT a.v, MIN(a.u) AS component FROM r a JOIN r b ON a.v = b.u AND a.u = b.v GROUP BY a.v")
def gr12_components(spark, d):
    e = settled(phrases(spark, d).select("src", "dst"))
    return strong_components(G.used_vertices(e), e)


LOOPS_SQL = ("l AS (SELECT l.edge_id, l.src AS v, b.edge_id AS before_id, a.edge_id AS after_id FROM e l JOIN deg ON v = l.src AND n_in = 2 AND n_out = 2 "
             "JOIN e b ON b.dst = l.src AND b.src <> b.dst JOIN e a ON a.src = l.src AND a.src <> a.dst WHERE l.src = l.dst AND abs((a.coverage + b.coverage) / 2 - l.coverage) <= 0.9 * l.coverage)")


@query("gr12_self_loops", f"WITH {PHRASES_SQL}, {LOOPS_SQL} SELECT edge_id, v, before_id, after_id FROM l")
def gr12_self_loops(spark, d):
    return G.resolvable_loops(phrases(spark, d), 0.9)


@query("gr12_resolved_loops", f"WITH {PHRASES_SQL}, {LOOPS_SQL} SELECT e.edge_id, CASE WHEN o.v IS NOT NULL THEN o.v || '+' ELSE e.src END AS src, CASE WHEN l.v IS NOT NULL THEN l.v || '+' ELSE e.dst END AS dst, "
       "e.length, e.coverage FROM e LEFT JOIN l ON l.edge_id = e.edge_id LEFT JOIN l o ON o.after_id = e.edge_id")
def gr12_resolved(spark, d):
    return loops.resolve_loops(phrases(spark, d), 0.9)


@query("gr12_loop_edges")
def gr12_loops(spark, d):
    """No SQL: shortest ways with ties by edge; held against a plain search on random graphs."""
    return loops.loop_edges(settled(phrases(spark, d)), splitting_length=7, max_vertices=20)


@query("gr8_low_coverage_parts")
def gr8(spark, d):
    """No SQL: parts grow by a rule that looks at the whole part; held against a plain search on random graphs."""
    return relative_coverage.low_coverage_parts(phrases(spark, d), gap=1.5, max_length=30, max_length_with_tips=40, max_way=20)


@query("gr25_forest_parts")
def gr25(spark, d):
    """No SQL: which tree spans is left open; tests hold the parts against their contract."""
    e = settled(phrases(spark, d).select("src", "dst"))
    return forest.forest_parts(G.used_vertices(e), e, 4)
