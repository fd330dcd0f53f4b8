"""Queries that write tables in a file format and read them back.

Files go to the shared folder of the session, a new one for every run.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.operators.similarity import best_hit_lines, best_hits
from strandframe.plans import views as V
from strandframe.plans.registry import query
from strandframe.plans.cluster_queries import CLUSTERS_SQL, MAPS_SQL, EXACT_SQL, EXACT_SELECT, constructed_map, original_map, source_clusters
from strandframe.plans.read_queries import QUALITY, rc
from strandframe.plans.similarity_queries import HITS0_SQL, NEIGHBOURS_SQL, REPS_SQL, SIDES_SQL, repertoires, sides
from strandframe.operators import clusters as C
from strandframe.operators import kmers as K
from strandframe.sources import reads as IN
from strandframe.sources import sinks as OUT
from strandframe.sources import tables as TAB
from strandframe.session import scratch_path

NAMED_SQL = V.READS_SQL + ", named AS (SELECT source || '_' || read_id AS name, seq FROM reads WHERE seq <> '')"


def named(spark, d):
    return V.reads(spark, d).where("seq <> ''").select(F.concat_ws("_", "source", "read_id").alias("name"), "seq", "read_id")


def written(spark, lines, label, **options):
    path = scratch_path(spark, label)
    lines.write.options(**options).text(path)
    return path


@query("src1_fasta", f"WITH {NAMED_SQL} SELECT name, seq FROM named")
def src1(spark, d):
    """Sequences wrapped at 60 bases are joined again."""
    wrapped = named(spark, d).select("name", OUT.wrapped("seq").alias("seq"))
    return IN.read_fasta(spark, written(spark, OUT.fasta_lines(wrapped), "fasta"))


@query("src3_two_line_fasta", f"WITH {NAMED_SQL} SELECT '>' || name AS name, seq FROM named")
def src3(spark, d):
    """Records of a name line and one sequence line; the marker stays in the name."""
    return IN.read_fasta(spark, written(spark, OUT.fasta_lines(named(spark, d)), "fasta"), keep_marker=True, multiline=False)


@query("src6_gzip_fasta", f"WITH {NAMED_SQL} SELECT name, seq FROM named")
def src6(spark, d):
    return IN.read_fasta(spark, written(spark, OUT.fasta_lines(named(spark, d)), "fasta-gz", compression="gzip"))


@query("src2_paired_fasta", f"WITH {V.PAIRS_SQL} SELECT 'c' || conv_id || '.' || turn AS name, s1, s2 FROM pairs WHERE s1 <> '' AND s2 <> ''")
def src2(spark, d):
    """A pair of records per value, so mates stay together in the file."""
    p = V.turn_pairs(spark, d).where("s1 <> '' AND s2 <> ''").withColumn("name", F.concat(F.lit("c"), "conv_id", F.lit("."), "turn"))
    lines = p.select(F.concat(F.lit(">"), "name", F.lit("\n"), "s1", F.lit("\n>"), "name", F.lit("\n"), "s2").alias("value"))
    back = IN.read_paired_fasta(spark, written(spark, lines, "pairs"))
    return back.select(F.col("name1").alias("name"), "s1", "s2")


FASTQ_SQL = NAMED_SQL + f", fq AS (SELECT name, seq, translate(seq, '{QUALITY[0]}', '{QUALITY[1]}') AS quality FROM named)"


def fastq(spark, d):
    return named(spark, d).withColumn("quality", F.translate("seq", *QUALITY))


@query("src4_fastq", f"WITH {FASTQ_SQL} SELECT name, seq, quality FROM fq")
def src4(spark, d):
    return IN.read_fastq(spark, written(spark, OUT.fastq_lines(fastq(spark, d)), "fastq")).select("name", "seq", "quality")


@query("src5_paired_fastq", f"WITH {FASTQ_SQL} SELECT name AS name1, seq AS s1, name AS name2, {rc('seq')} AS s2, reverse(quality) AS q2 FROM fq")
def src5(spark, d):
    """Both mates are written in read order and joined by place."""
    r = named(spark, d).orderBy("read_id").withColumn("quality", F.translate("seq", *QUALITY))  # made after the sort
    left = written(spark, OUT.fastq_lines(r), "left")
    right = written(spark, OUT.fastq_lines(r, F.lit(True)), "right")
    return IN.read_paired_fastq(spark, left, right).select("name1", "s1", "name2", "s2", "q2")


@query("src10_files_in_order", f"WITH {NAMED_SQL} SELECT 0 AS stream_no, name, seq FROM named UNION ALL SELECT 1, name, {rc('seq')} FROM named")
def src10(spark, d):
    from strandframe.functions import sequences as S
    r = named(spark, d)
    a = written(spark, OUT.fasta_lines(r), "first")
    b = written(spark, OUT.fasta_lines(r.withColumn("seq", S.reverse_complement("seq"))), "second")
    return IN.in_order(IN.read_fasta(spark, a), IN.read_fasta(spark, b))


@query("src11_binary_cache", f"WITH {V.READS_SQL} SELECT read_id, source, seq FROM reads")
def src11(spark, d):
    """Reads cached in a columnar, partitioned copy."""
    path = scratch_path(spark, "cache")
    V.reads(spark, d).write.parquet(path)
    return spark.read.parquet(path)


@query("src12_quality_offset", f"WITH {FASTQ_SQL}, told AS (SELECT regexp_extract(quality, '[^;-J]') AS c FROM fq) "
       "SELECT COALESCE(MIN(CASE WHEN ascii(c) < 59 THEN 33 ELSE 64 END), -1) AS \"offset\" FROM told WHERE c <> ''")
def src12(spark, d):
    return IN.quality_offset(IN.read_fastq(spark, written(spark, OUT.fastq_lines(fastq(spark, d)), "fastq")))


@query("src13_cluster_map", f"WITH {MAPS_SQL} SELECT 'read' || read_id || 'x' AS read_name, cluster_id FROM cm")
def src13(spark, d):
    m = constructed_map(spark, d).select(F.concat(F.lit("read"), "read_id", F.lit("xfr=1")).alias("read_name"), "cluster_id")
    return TAB.read_cluster_map(spark, written(spark, OUT.cluster_map_lines(m), "rcm"))


@query("src14_shared_cluster_map", f"WITH {MAPS_SQL} SELECT 'read' || read_id AS read_name, cluster_id FROM cm")
def src14(spark, d):
    m = constructed_map(spark, d).select(F.concat(F.lit("read"), "read_id", F.lit(",x___size___1")).alias("read_name"), "cluster_id")
    return TAB.read_shared_cluster_map(spark, written(spark, OUT.cluster_map_lines(m), "rcm"))


@query("src15_cluster_fasta", f"WITH {CLUSTERS_SQL} SELECT cluster_id, size, seq FROM cl WHERE seq <> ''")
def src15(spark, d):
    return TAB.read_cluster_fasta(spark, written(spark, OUT.cluster_fasta_lines(source_clusters(spark, d)), "clusters"))


@query("src16_match_file", f"WITH {SIDES_SQL}, {HITS0_SQL}, o AS (SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS query FROM a) "
       "SELECT query, hit_id AS hit, CAST(0 AS BIGINT) AS score FROM best JOIN o ON q_id = seq_id WHERE side = 'a'")
def src16(spark, d):
    a, b = sides(spark, d)
    lines = best_hit_lines(best_hits(a, b, k=36, tau=0).where("side = 'a'"), a).orderBy("q_id").select(F.col("line").alias("value"))
    return TAB.read_matches(spark, written(spark, lines, "matches"))


REPORT_SQL = "lines AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem)"


def report_lines(spark, d):
    """An alignment-style report: orders are queries, their parts are hits."""
    li = V.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("h"))
    return li.select("l_orderkey", F.transform("h", lambda x: F.concat(F.lit("part"), x["l_partkey"])).alias("parts"))


@query("src17_text_report", f"WITH {REPORT_SQL} SELECT l_orderkey AS cluster_id, 'part' || l_partkey AS hit, rn AS rank FROM lines WHERE rn <= 4")
def src17(spark, d):
    lines = report_lines(spark, d).select(F.concat(
        F.lit("Query= cluster___"), "l_orderkey", F.lit("___size___1\n\nSequences producing significant alignments:  score\n\n"),
        F.array_join(F.transform("parts", lambda p: F.concat(p, F.lit("   100   1e-9"))), "\n"), F.lit("\n")).alias("value"))
    return TAB.read_report_hits(spark, written(spark, lines, "report"))


@query("src18_tabular_report", f"WITH {REPORT_SQL} SELECT 'cluster___' || l_orderkey || '___size___1' AS query, 'part' || l_partkey AS subject FROM lines WHERE rn = 1")
def src18(spark, d):
    name = F.concat(F.lit("cluster___"), "l_orderkey", F.lit("___size___1"))
    lines = report_lines(spark, d).select(F.concat(F.lit("# REPORT 1.0\n# Query: "), name, F.lit("\n"), F.array_join(F.transform(
        "parts", lambda p: F.concat(name, F.lit("\t"), p, F.lit("\t98.0"))), "\n")).alias("value"))
    return TAB.read_tabular_hits(spark, written(spark, lines, "tabular"))


@query("src19_number_list", "SELECT value FROM events")
def src19_list(spark, d):
    lines = V.table(spark, d, "events").select(F.col("value").cast("string").alias("value"))
    return TAB.read_numbers(spark, written(spark, lines, "numbers"))


@query("agg13_histogram_file", "SELECT CAST(floor(value) AS BIGINT) AS value, COUNT(*) AS n FROM events GROUP BY 1")
def agg13_file(spark, d):
    from strandframe.plans.statistics_queries import value_histogram
    lines = OUT.histogram_lines(value_histogram(spark, d))
    return TAB.read_histogram(spark, written(spark, lines, "histogram"))


@query("snk1_fasta_lines", f"WITH {NAMED_SQL} SELECT '>' || name || chr(10) || seq AS value FROM named")
def snk1(spark, d):
    return OUT.fasta_lines(named(spark, d))


@query("snk2_fastq_lines", f"WITH {FASTQ_SQL} SELECT '@' || name || chr(10) || {rc('seq')} || chr(10) || '+' || chr(10) || reverse(quality) AS value FROM fq")
def snk2(spark, d):
    return OUT.fastq_lines(fastq(spark, d), F.lit(True))


@query("snk3_wrapped_contigs", f"WITH {V.READS_SQL} SELECT '>NODE_' || read_id || '_length_' || length(seq) || chr(10) || regexp_replace(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') AS value FROM reads")
def snk3(spark, d):
    return OUT.wrapped_fasta_lines(V.reads(spark, d), "read_id")


@query("snk4_cluster_lines", f"WITH {CLUSTERS_SQL} SELECT '>cluster___' || cluster_id || '___size___' || size || chr(10) || seq AS value FROM cl")
def snk4(spark, d):
    return OUT.cluster_fasta_lines(source_clusters(spark, d))


@query("snk4_cluster_map_lines", f"WITH {MAPS_SQL} SELECT read_id || chr(9) || cluster_id AS value FROM om")
def snk4_map(spark, d):
    return OUT.cluster_map_lines(original_map(spark, d), "read_id")


@query("snk6_metis_graph", "WITH v AS (SELECT p_partkey AS id, 0 AS kind FROM part UNION ALL SELECT s_suppkey, 1 FROM supplier), n AS (SELECT *, row_number() OVER (ORDER BY kind, id) - 1 AS v FROM v), "
       "e AS (SELECT a.v AS x, b.v AS y, COUNT(*) AS w FROM lineitem JOIN n a ON a.id = l_partkey AND a.kind = 0 JOIN n b ON b.id = l_suppkey AND b.kind = 1 GROUP BY ALL), "
       "ee AS (SELECT x AS src, y AS dst, w FROM e UNION ALL SELECT y, x, w FROM e), l AS (SELECT src, string_agg((dst + 1) || ' ' || w, ' ' ORDER BY dst) AS t FROM ee GROUP BY src) "
       "SELECT CAST(0 AS BIGINT) AS place, (SELECT COUNT(*) FROM n) || ' ' || (SELECT COUNT(*) FROM e) || ' 001' AS value UNION ALL SELECT v + 1, COALESCE(t, '') FROM n LEFT JOIN l ON src = v")
def snk6(spark, d):
    from strandframe.operators.ordering import row_ordinals
    v = V.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("kind")).unionByName(
        V.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit(1).alias("kind")))
    n = row_ordinals(v, ["kind", "id"], "v").withColumn("v", F.col("v") - 1)
    part = n.where("kind = 0").select(F.col("id").alias("l_partkey"), F.col("v").alias("x"))
    supp = n.where("kind = 1").select(F.col("id").alias("l_suppkey"), F.col("v").alias("y"))
    e = V.table(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("weight")).join(part, "l_partkey").join(supp, "l_suppkey")
    both = e.select(F.col("x").alias("src"), F.col("y").alias("dst"), "weight").unionByName(e.select(F.col("y").alias("src"), F.col("x").alias("dst"), "weight"))
    return OUT.metis_lines(n.select("v"), both)


@query("snk9_metric_pivot", f"WITH {EXACT_SQL}, r AS ({EXACT_SELECT}), z AS (SELECT metric, CAST(CAST(round(value * 1000) AS BIGINT) AS VARCHAR) AS v FROM r WHERE NOT isnan(value)) "
       "SELECT metric, v AS whole, CASE WHEN metric LIKE '%cluster%' THEN v ELSE '-' END AS part FROM z")
def snk9(spark, d):
    m = C.evaluate_exact(original_map(spark, d), constructed_map(spark, d)).where("NOT isnan(value)").withColumn(
        "value", F.round(F.col("value") * 1000).cast("long")).persist()
    files = m.withColumn("file", F.lit("whole")).unionByName(m.where("metric LIKE '%cluster%'").withColumn("file", F.lit("part")))
    return OUT.metric_pivot(files, ["whole", "part"])


@query("snk10_dot_lines", f"WITH {REPS_SQL}, {NEIGHBOURS_SQL} SELECT 0 AS place, 'digraph g {{' AS value UNION ALL SELECT 0, 'labeldistance=1' UNION ALL SELECT 3, '}}' UNION ALL "
       "SELECT 1, '\"' || rep_id || '.' || cluster_id || '\" [label=\"' || cluster_id || '\\nsize ' || size || '\" fillcolor=' || ['lightblue', 'palegreen', 'khaki', 'thistle', 'gold'][rep_id % 5 + 1] || ' style=filled]' FROM reps UNION ALL "
       "SELECT 2, '\"' || rep_a || '.' || a_id || '\" -> \"' || rep_b || '.' || b_id || '\" [label=0 style=bold color=red]' FROM neigh")
def snk10(spark, d):
    reps = repertoires(spark, d)
    edges = K.scored_neighbours(reps).select("rep_a", "a_id", "rep_b", "b_id", F.lit(0).alias("shared"), F.lit("close").alias("kind"))
    return OUT.dot_lines(reps, edges)


@query("snk11_histogram_lines", "SELECT CAST(floor(value) AS BIGINT) || ' ' || COUNT(*) AS line FROM events GROUP BY floor(value)")
def snk11_lines(spark, d):
    from strandframe.plans.statistics_queries import value_histogram
    return OUT.histogram_lines(value_histogram(spark, d))


@query("snk12_plot_bins", "WITH b AS (SELECT MIN(value) AS lo, (MAX(value) - MIN(value)) / 50 AS w FROM events), p AS (SELECT CAST(least(floor((value - lo) / w), 49) AS BIGINT) AS bin, lo, w "
       "FROM events, b WHERE value IS NOT NULL) SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, COUNT(*) AS n FROM p GROUP BY bin, lo, w")
def snk12(spark, d):
    return OUT.plot_bins(V.table(spark, d, "events"), "value", 50)


@query("snk13_fastq_to_fasta", f"WITH {FASTQ_SQL} SELECT '>' || name || chr(10) || seq AS value FROM fq")
def snk13(spark, d):
    return OUT.fastq_to_fasta(IN.read_fastq(spark, written(spark, OUT.fastq_lines(fastq(spark, d)), "fastq")))


@query("src20_decoded_quality", f"WITH {FASTQ_SQL} SELECT name, COALESCE(CAST(list_sum(list_transform(string_split(quality, ''), lambda c: ascii(c) - 33)) AS BIGINT), 0) AS total FROM fq")
def decoded(spark, d):
    q = fastq(spark, d).select("name", IN.decoded_quality("quality").alias("q"))
    return q.select("name", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
