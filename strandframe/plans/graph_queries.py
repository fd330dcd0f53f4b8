"""Queries over graph operators.

Two graphs: the de Bruijn graph of all conversation turns (k = 11), and the graph
of parts and suppliers with one edge per pair.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import contigs as C
from strandframe.operators import graph as G
from strandframe.operators.components import components
from strandframe.operators.histograms import histogram
from strandframe.plans import views as V
from strandframe.plans.registry import query
from strandframe.plans.similarity_queries import kmers_sql

K = 11


def de_bruijn(spark, d):
    return G.de_bruijn_edges(V.turn_reads(spark, d).withColumn("read_id", F.lit(0)), K)


DB_SQL = (V.TURNS_SQL + ", " + kmers_sql(K + 1, "turns", "conv_id") +
          f", e AS MATERIALIZED (SELECT kmer AS edge_id, substr(kmer, 1, {K}) AS src, substr(kmer, 2) AS dst, CAST(1 AS BIGINT) AS length, CAST(COUNT(*) AS DOUBLE) AS coverage FROM occ GROUP BY kmer), "
          "deg AS MATERIALIZED (SELECT v, CAST(SUM(i) AS BIGINT) AS n_in, CAST(SUM(o) AS BIGINT) AS n_out FROM (SELECT src AS v, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY v)")
WD_SQL = DB_SQL + ", wd AS MATERIALIZED (SELECT e.*, a.n_in AS src_in, a.n_out AS src_out, b.n_in AS dst_in, b.n_out AS dst_out FROM e JOIN deg a ON a.v = src JOIN deg b ON b.v = dst)"


@query("gr13_de_bruijn_edges", f"WITH {DB_SQL} SELECT edge_id, src, dst, length, coverage FROM e")
def gr13(spark, d):
    return de_bruijn(spark, d)


@query("gr31_vertex_degrees", f"WITH {DB_SQL} SELECT v, n_in, n_out FROM deg")
def gr31(spark, d):
    return G.degrees(de_bruijn(spark, d))


@query("gr5_isolated_edges_removed", f"WITH {WD_SQL} SELECT edge_id FROM wd WHERE NOT (src_in + src_out = 1 AND dst_in + dst_out = 1)")
def gr5(spark, d):
    return G.drop_isolated_edges(de_bruijn(spark, d), 10, 5.0, 1).select("edge_id")


@query("gr5_isolated_vertices_removed", "WITH v AS (SELECT p_partkey AS v FROM part) SELECT v FROM v WHERE v IN (SELECT l_partkey FROM lineitem)")
def gr5_vertices(spark, d):
    v = V.table(spark, d, "part").select(F.col("p_partkey").alias("v"))
    return G.drop_isolated_vertices(v, supply(spark, d))


@query("gr4_compressed_paths", f"WITH RECURSIVE {WD_SQL}, walk AS (SELECT edge_id, src AS first, dst, coverage AS cov, 1 AS parts, dst_in = 1 AND dst_out = 1 AS more, edge_id AS low FROM wd WHERE NOT (src_in = 1 AND src_out = 1) "
       "UNION ALL SELECT w.edge_id, w.first, n.dst, w.cov + n.coverage, w.parts + 1, n.dst_in = 1 AND n.dst_out = 1, least(w.low, n.edge_id) FROM walk w JOIN wd n ON n.src = w.dst WHERE w.more) "
       "SELECT low AS edge_id, first AS src, dst, CAST(parts AS BIGINT) AS length, round(cov / parts, 6) AS coverage FROM walk WHERE NOT more")
def gr4(spark, d):
    """Closed unbranched paths do not occur among natural turns, so the check walks from branch points."""
    c = G.compress_paths(de_bruijn(spark, d))
    return c.select("edge_id", "src", "dst", "length", F.round("coverage", 6).alias("coverage"))


_RC = "reverse(translate(kmer, 'ACGT', 'TGCA'))"
CONTIG_SQL = (V.TURNS_SQL + ", " + kmers_sql(K + 1, "turns", "conv_id") + ", one AS MATERIALIZED (SELECT kmer, COUNT(*) AS n FROM occ GROUP BY kmer), "
              f"e AS MATERIALIZED (SELECT kmer AS edge, substr(kmer, 1, {K}) AS src, substr(kmer, 2) AS dst, CAST(SUM(n) AS BIGINT) AS n FROM "
              f"(SELECT kmer, n FROM one UNION ALL SELECT {_RC}, n FROM one WHERE kmer <> {_RC}) GROUP BY kmer), "
              "inner_v AS MATERIALIZED (SELECT v FROM (SELECT src AS v, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY v HAVING SUM(i) = 1 AND SUM(o) = 1), "
              "we AS MATERIALIZED (SELECT e.*, s.v IS NOT NULL AS goes_on, t.v IS NOT NULL AS more FROM e LEFT JOIN inner_v s ON s.v = src LEFT JOIN inner_v t ON t.v = dst), "
              "walk AS (SELECT edge AS contig_id, edge AS last, dst, [n] AS ns, edge AS seq, more FROM we WHERE NOT goes_on "
              "UNION ALL SELECT w.contig_id, x.edge, x.dst, list_append(w.ns, x.n), w.seq || substr(x.dst, -1), x.more FROM walk w JOIN we x ON x.src = w.dst WHERE w.more), "
              "c AS (SELECT contig_id, reverse(translate(last, 'ACGT', 'TGCA')) AS conj_id, dst, ns, seq FROM walk WHERE NOT more)")


def contigs(spark, d):
    return C.contigs(V.turn_reads(spark, d).withColumn("read_id", F.lit(0)), K)


@query("gr4_contigs", f"WITH RECURSIVE {CONTIG_SQL} SELECT contig_id, conj_id, substr(contig_id, 1, {K}) AS src, dst, CAST(len(ns) AS BIGINT) AS length, seq FROM c")
def gr4_contigs(spark, d):
    """Both strands with merged sequences; as above, the SQL walks from branch points."""
    return contigs(spark, d).select("contig_id", "conj_id", "src", "dst", "length", "seq")


@query("gr13_flanking_coverage", f"WITH RECURSIVE {CONTIG_SQL} SELECT contig_id, round(list_sum(ns) / len(ns), 6) AS coverage, "
       "round(list_avg(ns[1:10]), 6) AS start_coverage, round(list_avg(ns[-10:]), 6) AS end_coverage FROM c")
def gr13_flanks(spark, d):
    """Mean coverage of each contig, and of its first and last ten (k+1)-mers."""
    return contigs(spark, d).select("contig_id", *[F.round(c, 6).alias(c) for c in ("coverage", "start_coverage", "end_coverage")])


@query("gr6_tips", f"WITH {WD_SQL} SELECT edge_id FROM wd WHERE (dst_in + dst_out = 1 OR src_in + src_out = 1) AND src_out + dst_in > 2 AND length <= 1")
def gr6_tips(spark, d):
    return G.tips(de_bruijn(spark, d), 1).select("edge_id")


@query("gr6_competitor_coverage", f"WITH {DB_SQL}, pr AS (SELECT a.edge_id, MAX(b.coverage) AS rival FROM e a JOIN e b ON (a.src = b.src) AND a.edge_id <> b.edge_id GROUP BY a.edge_id "
       "UNION ALL SELECT a.edge_id, MAX(b.coverage) FROM e a JOIN e b ON (a.dst = b.dst) AND a.edge_id <> b.edge_id GROUP BY a.edge_id) "
       "SELECT e.edge_id, COALESCE(MAX(rival), 0) AS rival FROM e LEFT JOIN pr ON e.edge_id = pr.edge_id GROUP BY e.edge_id")
def gr6_rivals(spark, d):
    return G.competitor_coverage(de_bruijn(spark, d)).select("edge_id", "rival")


# Parts and suppliers: suppliers have negative ids, edges lead both ways in turn.
SUPPLY_SQL = ("e AS (SELECT concat_ws('-', l_partkey, l_suppkey) AS edge_id, l_partkey AS src, -l_suppkey - 1 AS dst, CAST(MIN(l_quantity) AS BIGINT) AS length, CAST(COUNT(*) AS DOUBLE) AS coverage "
              "FROM lineitem GROUP BY l_partkey, l_suppkey)")


def supply(spark, d):
    return V.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).agg(
        F.concat_ws("-", F.first("l_partkey"), F.first("l_suppkey")).alias("edge_id"), F.min("l_quantity").cast("long").alias("length"),
        F.count("*").cast("double").alias("coverage"))


TWO_WAY_SQL = SUPPLY_SQL + ", w AS (SELECT src, dst, length FROM e UNION ALL SELECT dst, src, length FROM e)"


def two_way(spark, d):
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return supply(spark, d).select(F.explode(ways).alias("w"), "length").select("w.src", "w.dst", "length")


def suppliers(spark, d):
    return V.table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("v"))


@query("gr11_shortest_distances", f"WITH RECURSIVE {TWO_WAY_SQL}, r AS (SELECT -s_suppkey - 1 AS source, -s_suppkey - 1 AS v, CAST(0 AS BIGINT) AS distance FROM supplier "
       "UNION SELECT source, dst, distance + length FROM r JOIN w ON v = src WHERE distance + length <= 4) SELECT source, v, MIN(distance) AS distance FROM r GROUP BY ALL")
def gr11(spark, d):
    return G.shortest_distances(two_way(spark, d), suppliers(spark, d), 4)


@query("gr29_backward_short_edges", f"WITH RECURSIVE {TWO_WAY_SQL}, r AS (SELECT -s_suppkey - 1 AS source, -s_suppkey - 1 AS v, CAST(0 AS BIGINT) AS distance FROM supplier "
       "UNION SELECT source, src, distance + length FROM r JOIN w ON v = dst WHERE distance + length <= 3 AND length <= 2) SELECT source, v, MIN(distance) AS distance FROM r GROUP BY ALL")
def gr29(spark, d):
    return G.shortest_distances(two_way(spark, d), suppliers(spark, d), 3, backward=True, max_edge=2)


@query("gr10_path_lengths", f"WITH RECURSIVE {TWO_WAY_SQL}, r AS (SELECT -s_suppkey - 1 AS source, -s_suppkey - 1 AS v, CAST(0 AS BIGINT) AS length FROM supplier "
       "UNION SELECT source, dst, r.length + w.length FROM r JOIN w ON v = src WHERE r.length + w.length <= 4) SELECT source, v, length FROM r WHERE length >= 2")
def gr10(spark, d):
    return G.path_lengths(two_way(spark, d), suppliers(spark, d), 2, 4)


# One edge per order, part and supplier.
ITEMS_SQL = ("i AS (SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey) AS edge_id, l_partkey AS src, l_suppkey AS dst, CAST(SUM(l_quantity) AS BIGINT) AS length, "
             "MAX(l_extendedprice) AS coverage FROM lineitem GROUP BY l_orderkey, l_partkey, l_suppkey)")


def items(spark, d):
    return V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey", "l_suppkey").agg(
        F.sum("l_quantity").cast("long").alias("length"), F.max("l_extendedprice").alias("coverage")).select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey").alias("edge_id"), F.col("l_partkey").alias("src"),
        F.col("l_suppkey").alias("dst"), "length", "coverage")


@query("jn18_parallel_edges", f"WITH {ITEMS_SQL} SELECT a.edge_id AS edge_a, b.edge_id AS edge_b FROM i a JOIN i b ON a.src = b.src AND a.dst = b.dst AND a.edge_id < b.edge_id")
def jn18(spark, d):
    return G.parallel_edges(items(spark, d))


@query("gr15_edge_multiplicity", f"WITH {ITEMS_SQL} SELECT src, dst, COUNT(*) AS n FROM i GROUP BY src, dst HAVING COUNT(*) > 1")
def gr15(spark, d):
    return G.multiplicities(items(spark, d))


@query("gr12_resolvable_loops", f"WITH {DB_SQL} SELECT l.edge_id, l.src AS v, b.edge_id AS before_id, a.edge_id AS after_id FROM e l JOIN deg ON v = l.src AND n_in = 2 AND n_out = 2 "
       "JOIN e b ON b.dst = l.src AND b.src <> b.dst JOIN e a ON a.src = l.src AND a.src <> a.dst WHERE l.src = l.dst AND abs((a.coverage + b.coverage) / 2 - l.coverage) <= 0.9 * l.coverage")
def gr12(spark, d):
    return G.resolvable_loops(de_bruijn(spark, d), 0.9)


@query("gr26_induced_edges", f"WITH {ITEMS_SQL} SELECT edge_id FROM i WHERE src IN (SELECT p_partkey FROM part WHERE p_size <= 25) AND dst IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def gr26(spark, d):
    parts = V.table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("src"))
    sup = V.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("dst"))
    return items(spark, d).join(parts, "src", "left_semi").join(sup, "dst", "left_semi").select("edge_id")


@query("gr26_component_subgraph", f"WITH {DB_SQL}, vs AS (SELECT v FROM deg WHERE n_in + n_out >= 3) SELECT edge_id FROM e WHERE src IN (SELECT v FROM vs) AND dst IN (SELECT v FROM vs)")
def gr26_subgraph(spark, d):
    e = de_bruijn(spark, d)
    return G.induced_edges(e, G.degrees(e).where("n_in + n_out >= 3").select("v")).select("edge_id")


@query("gr27_edge_lineage", f"WITH {ITEMS_SQL} SELECT MIN(edge_id) OVER (PARTITION BY src, dst) AS edge_id, edge_id AS origin FROM i")
def gr27(spark, d):
    e = items(spark, d)
    merged = e.join(e.groupBy("src", "dst").agg(F.min("edge_id").alias("new_id")), ["src", "dst"]).select("edge_id", "new_id")
    return G.edge_lineage(e.select("edge_id", F.col("edge_id").alias("origin")), merged)


@query("gr23_edges_until_condition_fails", f"WITH {ITEMS_SQL}, s AS (SELECT MIN((length, edge_id)) AS stop FROM i WHERE coverage > 90000) SELECT edge_id FROM i, s WHERE stop IS NULL OR (length, edge_id) < stop")
def gr23(spark, d):
    return G.take_while(items(spark, d), "length", F.col("coverage") <= 90000).select("edge_id")


@query("flt6_edge_predicates", f"WITH {ITEMS_SQL} SELECT edge_id FROM i WHERE coverage <= 20000 AND length <= 10")
def flt6(spark, d):
    return items(spark, d).where((F.col("coverage") <= 20000) & (F.col("length") <= 10)).select("edge_id")


@query("flt7_component_filter", "WITH o AS (SELECT o_custkey AS c, COUNT(*) AS n, MAX(CAST(floor(o_totalprice) AS BIGINT)) AS longest FROM orders GROUP BY o_custkey) "
       "SELECT c AS component, n + 1 AS vertices, longest FROM o WHERE n + 1 <= 12 AND longest >= 200000")
def flt7(spark, d):
    """Customers with their orders are star-shaped components named by the customer."""
    o = V.table(spark, d, "orders")
    base = F.lit(1 << 40)
    edges = o.select(F.col("o_custkey").alias("src"), (base + F.col("o_orderkey")).alias("dst"), F.floor("o_totalprice").alias("length"))
    vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return G.component_filter(components(vertices, edges), edges, 12, 200000)


@query("flt8_supported_pairs", f"WITH {ITEMS_SQL}, p AS (SELECT a.edge_id AS edge_a, b.edge_id AS edge_b, CAST(a.length * b.length * 10 AS DOUBLE) AS weight, a.coverage AS ca, b.coverage AS cb FROM i a JOIN i b "
       "ON a.src = b.src AND a.dst = b.dst AND a.edge_id < b.edge_id) SELECT edge_a, edge_b, weight FROM p WHERE weight >= 2000 OR weight >= 0.1 * ca OR weight >= 0.1 * cb")
def flt8(spark, d):
    e = items(spark, d)
    size = e.select("edge_id", "length")
    p = (G.parallel_edges(e).join(size.select(F.col("edge_id").alias("edge_a"), F.col("length").alias("la")), "edge_a")
         .join(size.select(F.col("edge_id").alias("edge_b"), F.col("length").alias("lb")), "edge_b")
         .select("edge_a", "edge_b", (F.col("la") * F.col("lb") * 10).cast("double").alias("weight")))
    return G.supported_pairs(p, e, least=2000.0)


@query("agg25_coverage_histogram", f"WITH {DB_SQL} SELECT CAST(floor(coverage) AS BIGINT) AS value, COUNT(*) AS n FROM e GROUP BY 1")
def agg25_histogram(spark, d):
    return histogram(de_bruijn(spark, d), F.floor("coverage"))


@query("gr6_clip_tips")
def gr6(spark, d):
    return G.clip_tips(supply(spark, d), 20, 1000.0, 1.2)
