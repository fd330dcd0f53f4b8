"""Queries over clusters, evaluation of clusterings and repertoire comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators import clusters as C
from strandframe.operators import repertoires as P
from strandframe.operators.components import components
from strandframe.operators.kmers import best_neighbours, scored_neighbours, smallest_kmer
from strandframe.plans import views as V
from strandframe.plans.registry import query
from strandframe.plans.similarity_queries import BEST_SQL, NEIGHBOURS_SQL, kmers_sql
from strandframe.session import settled


# Two clusterings of the documents: by whole sequence, and by source and smallest
# 32-mer (the sequence itself where it is shorter).  Lost clusters need a map with
# gaps: there reads below 216 bases, the least length of the strictest search, are left out.
GAP_BELOW = 216


def original_map(spark, d):
    r = settled(V.reads(spark, d).select("read_id", F.sha2("seq", 256).alias("key")))  # sequences travel as digests
    ids = r.groupBy("key").agg(F.min("read_id").alias("cluster_id"))
    return r.join(ids, "key").select("read_id", "cluster_id")


def smallest_kmers(spark, d):
    """Used several times and therefore written once."""
    r = V.reads(spark, d)
    short = r.where(F.length("seq") < 32).select("read_id", "source", F.col("seq").alias("sketch"))
    return settled(smallest_kmer(r.where(F.length("seq") >= 32), 32, ["read_id", "source"]).unionByName(short))


def constructed_map(spark, d, by=("source", "sketch"), kmers=None):
    s = smallest_kmers(spark, d) if kmers is None else kmers
    ids = s.groupBy(*by).agg(F.min("read_id").alias("cluster_id"))
    return s.join(ids, list(by)).select("read_id", "cluster_id")


def gapped_map(spark, d):
    kept = V.reads(spark, d).where(F.length("seq") >= GAP_BELOW).select("read_id")
    return constructed_map(spark, d).join(kept, "read_id", "left_semi")


MAPS_SQL = (V.READS_SQL + ", om AS (SELECT read_id, MIN(read_id) OVER (PARTITION BY seq) AS cluster_id FROM reads), " +
            kmers_sql(32, "reads", "read_id, source") +
            ", sk AS (SELECT read_id, source, MIN(kmer) AS sketch FROM occ GROUP BY ALL UNION ALL SELECT read_id, source, seq FROM reads WHERE length(seq) < 32), "
            "cm AS (SELECT read_id, MIN(read_id) OVER (PARTITION BY source, sketch) AS cluster_id FROM sk), "
            "tm AS (SELECT read_id, MIN(read_id) OVER (PARTITION BY sketch) AS cluster_id FROM sk), "
            f"gm AS (SELECT * FROM cm WHERE read_id IN (SELECT read_id FROM reads WHERE length(seq) >= {GAP_BELOW}))")


@query("agg4_cluster_sizes", f"WITH {MAPS_SQL} SELECT cluster_id, COUNT(*) AS size, COUNT(*) = 1 AS singleton FROM cm GROUP BY cluster_id")
def agg4(spark, d):
    return C.cluster_sizes(constructed_map(spark, d))


TABLE_SQL = MAPS_SQL + ", tab AS (SELECT om.cluster_id AS orig, cm.cluster_id AS constr, COUNT(*) AS n FROM om FULL JOIN cm ON om.read_id = cm.read_id GROUP BY ALL)"


@query("agg5_contingency", f"WITH {TABLE_SQL} SELECT orig, constr, n FROM tab")
def agg5(spark, d):
    return C.contingency(original_map(spark, d), constructed_map(spark, d))


@query("agg5_dominant_pairs", f"WITH {TABLE_SQL} SELECT orig, constr, n AS shared FROM (SELECT *, row_number() OVER (PARTITION BY orig ORDER BY n DESC, constr) AS rn "
       "FROM tab WHERE orig IS NOT NULL AND constr IS NOT NULL) WHERE rn = 1")
def agg5_dominant(spark, d):
    return C.dominant_pairs(agg5(spark, d))


EXACT_SQL = TABLE_SQL + (
    ", o AS (SELECT orig, CAST(SUM(n) AS BIGINT) AS o_size, COUNT(constr) AS parts FROM tab WHERE orig IS NOT NULL GROUP BY orig), "
    "c AS (SELECT constr, CAST(SUM(n) AS BIGINT) AS c_size, COUNT(orig) AS sources, MAX(orig) AS orig FROM tab WHERE constr IS NOT NULL GROUP BY constr), "
    "touch AS (SELECT tab.orig, COUNT(*) FILTER (c_size > 1) AS big_parts, MAX(c_size) FILTER (sources = 1) AS pure FROM tab JOIN c ON tab.constr = c.constr WHERE tab.orig IS NOT NULL GROUP BY tab.orig), "
    "po AS (SELECT o.*, COALESCE(big_parts, 0) AS big_parts, COALESCE(pure, 0) / o_size AS fill, o_size > 1 AND parts > 1 AS split FROM o LEFT JOIN touch ON o.orig = touch.orig), "
    "pc AS (SELECT c.*, o_size FROM c LEFT JOIN o ON c.orig = o.orig) ")
EXACT_GAPPED_SQL = EXACT_SQL.replace("FULL JOIN cm ON", "FULL JOIN gm AS cm ON")
_m = lambda name, expr, src: f"SELECT '{name}' AS metric, CAST({expr} AS DOUBLE) AS value FROM {src}"
EXACT_SELECT = " UNION ALL ".join([
    _m("original_clusters", "COUNT(*)", "po"), _m("not_merged", "COUNT(*) FILTER (split)", "po"),
    _m("not_merged_big_and_singletons", "COUNT(*) FILTER (split AND big_parts = 1)", "po"),
    _m("original_singletons", "COUNT(*) FILTER (o_size = 1)", "po"), _m("max_original_cluster", "MAX(o_size)", "po"),
    _m("constructed_clusters", "COUNT(*)", "pc"), _m("errors", "COUNT(*) FILTER (sources <> 1 OR c_size > o_size)", "pc"),
    _m("constructed_singletons", "COUNT(*) FILTER (c_size = 1)", "pc"), _m("max_constructed_cluster", "MAX(c_size)", "pc"),
    _m("avg_fill_in", "COALESCE(AVG(fill) FILTER (split), 'nan'::DOUBLE)", "po"),
    _m("max_cluster_fill_in", "(SELECT fill FROM po ORDER BY o_size DESC, orig LIMIT 1)", "(SELECT 1)"),
    _m("correct_singletons", "COUNT(*) FILTER (c_size = 1 AND o_size = 1)", "pc"),
    _m("used_reads_pct", "(SELECT SUM(c_size) FROM pc) / (SELECT SUM(o_size) FROM po) * 100", "(SELECT 1)"),
    _m("lost_clusters", "COUNT(*) FILTER (parts = 0)", "po"),
    _m("lost_clusters_size", "COALESCE(SUM(o_size) FILTER (parts = 0), 0) / SUM(o_size)", "po")])


def _rounded(df):
    return df.withColumn("value", F.round("value", 9))


@query("agg6_exact_evaluation", f"WITH {EXACT_GAPPED_SQL} SELECT metric, round(value, 9) AS value FROM ({EXACT_SELECT})")
def agg6(spark, d):
    return _rounded(C.evaluate_exact(original_map(spark, d), gapped_map(spark, d)))


def _consensus(spark, d, rcm):
    return rcm.select("cluster_id").distinct().join(
        V.reads(spark, d).select(F.col("read_id").alias("cluster_id"), "seq"), "cluster_id")


@query("agg6_cluster_identity")
def agg6_identity(spark, d):
    o, c = original_map(spark, d), constructed_map(spark, d)
    return C.cluster_identity(o, c, _consensus(spark, d, o), _consensus(spark, d, c))


@query("agg6_identity_metrics")
def agg6_identity_metrics(spark, d):
    return C.identity_metrics(agg6_identity(spark, d))


@query("snk8_metric_lines", f"WITH {EXACT_SQL}, r AS ({EXACT_SELECT}) SELECT metric || chr(9) || CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR) AS line FROM r WHERE NOT isnan(value)")
def snk8(spark, d):
    from strandframe.sources.sinks import metric_lines
    return metric_lines(C.evaluate_exact(original_map(spark, d), constructed_map(spark, d)).where("NOT isnan(value)")
                        .withColumn("value", F.round(F.col("value") * 1000).cast("long")))


@query("jn15_lost_clusters", f"WITH {MAPS_SQL} SELECT cluster_id, COUNT(*) AS size FROM om GROUP BY cluster_id HAVING COUNT(*) FILTER (read_id IN (SELECT read_id FROM gm)) = 0")
def jn15(spark, d):
    return C.lost_clusters(original_map(spark, d), gapped_map(spark, d))


CLUSTERS_SQL = V.READS_SQL + ", cl AS (SELECT source, seq, MIN(read_id) AS cluster_id, COUNT(*) AS size FROM reads GROUP BY source, seq)"


def source_clusters(spark, d):
    return V.reads(spark, d).groupBy("source", "seq").agg(F.min("read_id").alias("cluster_id"), F.count("*").alias("size"))


@query("flt3_non_trivial_clusters", f"WITH {MAPS_SQL} SELECT cluster_id, COUNT(*) AS size FROM om GROUP BY cluster_id HAVING COUNT(*) >= 2")
def flt3(spark, d):
    return C.non_trivial(C.cluster_sizes(original_map(spark, d)), 2).select("cluster_id", "size")


@query("set4_renumbered_union", f"WITH {CLUSTERS_SQL}, u AS (SELECT 0 AS file_no, * FROM cl WHERE source < 'src15' UNION ALL SELECT 1, * FROM cl WHERE source >= 'src15') "
       "SELECT row_number() OVER (ORDER BY file_no, cluster_id) - 1 AS new_id, cluster_id, size FROM u")
def set4(spark, d):
    c = source_clusters(spark, d)
    both = C.renumbered_union(c.where("source < 'src15'"), c.where("source >= 'src15'"))
    return both.select("new_id", "cluster_id", "size")


@query("agg27_clusters_in_fasta", f"WITH {CLUSTERS_SQL} SELECT COUNT(*) AS clusters FROM cl")
def agg27(spark, d):
    from strandframe.sources.sinks import cluster_fasta_lines
    lines = cluster_fasta_lines(source_clusters(spark, d)).select(F.explode(F.split("value", "\n")).alias("line"))
    return lines.agg(F.expr("count(*) div 2").alias("clusters"))


# Three clusterings of the same reads as repertoires 0, 1 and 2.

def three_maps(spark, d):
    kmers = smallest_kmers(spark, d)
    maps = [original_map(spark, d), constructed_map(spark, d, kmers=kmers), constructed_map(spark, d, by=("sketch",), kmers=kmers)]
    out = None
    for i, m in enumerate(maps):
        part = m.select(F.lit(i).alias("rep_id"), "read_id", "cluster_id")
        out = part if out is None else out.unionByName(part)
    return settled(out)


def three_clusters(spark, d, maps=None):
    """Used several times and therefore written once."""
    sizes = (three_maps(spark, d) if maps is None else maps).groupBy("rep_id", "cluster_id").agg(F.count("*").alias("size"))
    return settled(sizes.join(V.reads(spark, d).select(F.col("read_id").alias("cluster_id"), "seq"), "cluster_id"))


THREE_SQL = (MAPS_SQL.replace("occ AS", "occ32 AS").replace("FROM occ ", "FROM occ32 ") +
             ", rm AS (SELECT 0 AS rep_id, read_id, cluster_id FROM om UNION ALL SELECT 1, read_id, cluster_id FROM cm UNION ALL SELECT 2, read_id, cluster_id FROM tm), "
             "reps AS (SELECT rep_id, cluster_id, size, seq FROM (SELECT rep_id, cluster_id, COUNT(*) AS size FROM rm GROUP BY ALL) JOIN reads ON reads.read_id = cluster_id)")
SHARED_READS_SQL = ("shr AS (SELECT a.rep_id AS rep_a, a.cluster_id AS a_id, b.rep_id AS rep_b, b.cluster_id AS b_id, COUNT(*) AS shared FROM rm a JOIN rm b "
                    "ON a.read_id = b.read_id AND a.rep_id < b.rep_id GROUP BY ALL)")
CONN_SQL = (SHARED_READS_SQL + ", sim AS (SELECT rep_a, a_id, rep_b, b_id, COUNT(*) AS ways FROM (SELECT rep_id AS rep_a, cluster_id AS a_id, other_rep AS rep_b, neighbour_id AS b_id, 0 AS w FROM best WHERE rep_id < other_rep "
            "UNION SELECT other_rep, neighbour_id, rep_id, cluster_id, 1 FROM best WHERE rep_id > other_rep) GROUP BY ALL), "
            "conn AS (SELECT COALESCE(sim.rep_a, shr.rep_a) AS rep_a, COALESCE(sim.a_id, shr.a_id) AS a_id, COALESCE(sim.rep_b, shr.rep_b) AS rep_b, COALESCE(sim.b_id, shr.b_id) AS b_id, "
            "COALESCE(shared, 0) AS shared, CASE WHEN ways = 2 THEN 'close_each' WHEN ways = 1 THEN 'close' ELSE 'distant' END AS kind "
            "FROM sim FULL JOIN shr ON sim.rep_a = shr.rep_a AND sim.a_id = shr.a_id AND sim.rep_b = shr.rep_b AND sim.b_id = shr.b_id)")
ALL_SQL = f"{THREE_SQL}, {NEIGHBOURS_SQL}, {BEST_SQL}, {CONN_SQL}"


def three_hits(clusters):
    return best_neighbours(scored_neighbours(clusters))


@query("jn10_shared_reads", f"WITH {THREE_SQL}, {SHARED_READS_SQL} SELECT rep_a, a_id, rep_b, b_id, shared FROM shr")
def jn10(spark, d):
    return P.shared_reads(three_maps(spark, d))


@query("jn11_typed_connections", f"WITH {ALL_SQL} SELECT rep_a, a_id, rep_b, b_id, shared, kind FROM conn")
def jn11(spark, d):
    maps = three_maps(spark, d)
    return P.connections(three_hits(three_clusters(spark, d, maps)), maps)


def _labels_sql(edges, rounds):
    """Smallest label spread over the edges for a fixed number of rounds, enough for the diameter."""
    return (f"und AS MATERIALIZED (SELECT src, dst FROM {edges} UNION SELECT dst, src FROM {edges} UNION SELECT id, id FROM vs), "
            f"lab AS (SELECT 0 AS it, id, id AS label FROM vs UNION ALL SELECT it + 1, dst, MIN(label) FROM lab JOIN und ON src = id WHERE it < {rounds} GROUP BY it, dst)")


COMP_SQL = (ALL_SQL + ", vs AS (SELECT rep_id * 281474976710656 + cluster_id AS id FROM reps), "
            "es AS (SELECT rep_a * 281474976710656 + a_id AS src, rep_b * 281474976710656 + b_id AS dst FROM conn{0}), " + _labels_sql("es", 40) +
            ", comp AS (SELECT id // 281474976710656 AS rep_id, id % 281474976710656 AS cluster_id, label AS component FROM lab WHERE it = 40)")


@query("gr1_repertoire_components", f"WITH RECURSIVE {COMP_SQL.format('')} SELECT CAST(rep_id AS INTEGER) AS rep_id, cluster_id, component FROM comp")
def gr1(spark, d):
    maps = three_maps(spark, d)
    clusters = three_clusters(spark, d, maps)
    edges = P.connections(three_hits(clusters), maps)
    return P.repertoire_components(clusters, edges)


@query("gr1_close_components", "WITH RECURSIVE " + COMP_SQL.replace("{0}", " WHERE kind <> 'distant'") + " SELECT CAST(rep_id AS INTEGER) AS rep_id, cluster_id, component FROM comp")
def gr1_close(spark, d):
    maps = three_maps(spark, d)
    clusters = three_clusters(spark, d, maps)
    edges = P.connections(three_hits(clusters), maps)
    return P.repertoire_components(clusters, edges, close_only=True)


@query("gr1_supply_components", "WITH RECURSIVE vs AS (SELECT p_partkey AS id FROM part UNION ALL SELECT -s_suppkey - 1 FROM supplier), "
       "es AS (SELECT DISTINCT l_partkey AS src, -l_suppkey - 1 AS dst FROM lineitem), " + _labels_sql("es", 12) + " SELECT id, label AS component FROM lab WHERE it = 12")
def gr1_supply(spark, d):
    """Parts and suppliers joined by their line items; suppliers have negative ids."""
    parts = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"))
    v = parts.unionByName(V.table(spark, d, "supplier").select((-F.col("s_suppkey") - 1).alias("id")))
    e = V.table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"))
    return components(v, e)


@query("agg9_component_clusters", f"WITH RECURSIVE {COMP_SQL.format('')} SELECT component, CAST(c.rep_id AS INTEGER) AS rep_id, COUNT(*) AS clusters, MAX(size) AS max_size "
       "FROM comp c JOIN reps r ON c.rep_id = r.rep_id AND c.cluster_id = r.cluster_id GROUP BY ALL")
def agg9(spark, d):
    return P.component_sizes(gr1(spark, d), three_clusters(spark, d))


@query("agg12_non_trivial_components", f"WITH RECURSIVE {COMP_SQL.format('')} SELECT component, COUNT(*) AS clusters, MAX(size) AS max_size "
       "FROM comp c JOIN reps r ON c.rep_id = r.rep_id AND c.cluster_id = r.cluster_id GROUP BY component HAVING COUNT(*) > 2")
def agg12(spark, d):
    return P.non_trivial_components(gr1(spark, d), three_clusters(spark, d))


@query("agg11_cluster_size_metrics", f"WITH {THREE_SQL} SELECT rep_id, COUNT(*) AS clusters, COUNT(*) FILTER (size = 1) AS singletons, MIN(size) AS min_size, round(AVG(size), 9) AS avg_size, MAX(size) AS max_size FROM reps GROUP BY rep_id")
def agg11(spark, d):
    return P.size_metrics(three_clusters(spark, d)).withColumn("avg_size", F.round("avg_size", 9))


ISO_SQL = ("iso AS (SELECT r.* FROM reps r WHERE (SELECT COUNT(DISTINCT other_rep) FROM best b WHERE b.rep_id = r.rep_id AND b.cluster_id = r.cluster_id) < 2)")


@query("jn16_isolated_clusters", f"WITH {THREE_SQL}, {NEIGHBOURS_SQL}, {BEST_SQL}, seen AS (SELECT rep_id, cluster_id, COUNT(DISTINCT other_rep) AS n FROM best GROUP BY ALL) "
       "SELECT r.rep_id, r.cluster_id FROM reps r LEFT JOIN seen s ON r.rep_id = s.rep_id AND r.cluster_id = s.cluster_id WHERE COALESCE(n, 0) < 2")
def jn16(spark, d):
    clusters = three_clusters(spark, d)
    return P.isolated_clusters(clusters, three_hits(clusters), (0, 1, 2)).select("rep_id", "cluster_id")


@query("agg11_isolated_metrics", f"WITH {THREE_SQL}, {NEIGHBOURS_SQL}, {BEST_SQL}, seen AS (SELECT rep_id, cluster_id, COUNT(DISTINCT other_rep) AS n FROM best GROUP BY ALL), "
       "iso AS (SELECT r.* FROM reps r LEFT JOIN seen s ON r.rep_id = s.rep_id AND r.cluster_id = s.cluster_id WHERE COALESCE(n, 0) < 2) "
       "SELECT r.rep_id, COUNT(size) AS isolated, COUNT(*) FILTER (size > 5) AS big_isolated, COUNT(*) FILTER (size = 1) AS trivial_isolated, COUNT(*) FILTER (length(seq) < 300) AS short_isolated, "
       "COALESCE(MIN(size), 0) AS min_isolated, round(COALESCE(AVG(size), 0), 9) AS avg_isolated, COALESCE(MAX(size), 0) AS max_isolated "
       "FROM (SELECT DISTINCT rep_id FROM reps) r LEFT JOIN iso ON iso.rep_id = r.rep_id GROUP BY r.rep_id")
def agg11_isolated(spark, d):
    clusters = three_clusters(spark, d)
    m = P.isolated_metrics(clusters, three_hits(clusters), (0, 1, 2), 5)
    return m.withColumn("avg_isolated", F.round("avg_isolated", 9))


@query("agg7_inexact_evaluation")
def agg7(spark, d):
    maps = three_maps(spark, d)
    clusters = three_clusters(spark, d, maps)
    return P.evaluate_inexact(clusters, three_hits(clusters), maps, (0, 1, 2))


@query("agg8_barcode_coverage", f"WITH {MAPS_SQL}, t AS (SELECT om.cluster_id AS barcode, cm.cluster_id AS target, COUNT(*) AS n FROM om JOIN cm ON om.read_id = cm.read_id GROUP BY ALL), "
       "b AS (SELECT barcode, MAX(n) AS best FROM t GROUP BY barcode), s AS (SELECT cluster_id AS barcode, COUNT(*) AS reads FROM om GROUP BY cluster_id) "
       "SELECT COUNT(*) AS barcodes, COUNT(*) FILTER (best >= 0.9 * reads) AS covered FROM s LEFT JOIN b ON s.barcode = b.barcode")
def agg8(spark, d):
    return P.barcode_coverage(original_map(spark, d), constructed_map(spark, d))


@query("set3_common_reads", f"WITH {MAPS_SQL} SELECT om.cluster_id AS orig, COUNT(*) AS common FROM om JOIN cm ON om.read_id = cm.read_id JOIN tm ON tm.read_id = om.read_id "
       "WHERE om.cluster_id = cm.cluster_id AND cm.cluster_id = tm.cluster_id GROUP BY om.cluster_id")
def set3(spark, d):
    """Reads that the clusters named alike hold in all three repertoires."""
    sets = three_maps(spark, d).withColumnRenamed("rep_id", "set_id")
    common = P.common_members(sets, "cluster_id", "read_id", F.lit(3))
    return common.groupBy(F.col("cluster_id").alias("orig")).agg(F.count("*").alias("common"))


@query("jn12_same_top_hit", "WITH t AS (SELECT doc_id AS q, source || '-' || lang || '-' || CAST(n_chars AS VARCHAR) AS s FROM documents) SELECT a.q AS id1, b.q AS id2 FROM t a JOIN t b ON a.s = b.s AND a.q <> b.q")
def jn12(spark, d):
    """Documents of the same source, language and size stand for queries with the same first hit."""
    hits = V.table(spark, d, "documents").select(F.col("doc_id").alias("query"), F.concat_ws("-", "source", "lang", "n_chars").alias("subject"))
    return P.same_top_hit(hits)


@query("jn17_ordinal_remap", f"WITH {CLUSTERS_SQL}, o AS (SELECT row_number() OVER (ORDER BY cluster_id, source) AS ordinal, cluster_id, source FROM cl) SELECT ordinal, cluster_id, source FROM o")
def jn17(spark, d):
    from strandframe.operators.ordering import row_ordinals
    return row_ordinals(source_clusters(spark, d).select("cluster_id", "source"), ["cluster_id", "source"])
