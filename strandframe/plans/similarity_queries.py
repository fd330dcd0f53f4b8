"""Queries over prefix collapse, k-mers and similarity joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import alignment as A
from strandframe.operators import collapse as C
from strandframe.operators import kmers as K
from strandframe.operators import similarity as M
from strandframe.plans import views as V
from strandframe.plans.registry import query
from strandframe.session import settled

LEAVES_SQL = (
    "d AS (SELECT seq, translate(seq, 'N', 'Z') AS key, MIN(read_id) AS first_id, COUNT(*) AS copies FROM {0} GROUP BY seq), "
    "m AS (SELECT *, NOT COALESCE(starts_with(lead(key) OVER (ORDER BY key), key), FALSE) AS is_leaf FROM d), "
    "l AS (SELECT *, MIN(CASE WHEN is_leaf THEN key END) OVER (ORDER BY key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS leaf FROM m)")
COLLAPSED_SQL = ("SELECT MIN(CASE WHEN is_leaf THEN first_id END) AS rep_id, translate(leaf, 'Z', 'N') AS seq, "
                 "CAST(SUM(copies) AS BIGINT) AS abundance FROM l GROUP BY leaf")


@query("agg3_prefix_collapse", f"WITH {V.WORDS_SQL}, {LEAVES_SQL.format('word_reads')} {COLLAPSED_SQL}")
def agg3(spark, d):
    return C.prefix_collapse(V.word_reads(spark, d))


@query("agg3_prefix_collapse_documents", f"WITH {V.READS_N_SQL}, {LEAVES_SQL.format('reads_n')} {COLLAPSED_SQL}")
def agg3_documents(spark, d):
    return C.prefix_collapse(V.reads_n(spark, d))


@query("agg3_prefix_assignment", f"WITH {V.WORDS_SQL}, {LEAVES_SQL.format('word_reads')} SELECT seq, translate(leaf, 'Z', 'N') AS leaf_seq, copies FROM l")
def agg3_assignment(spark, d):
    return C.prefix_assignment(V.word_reads(spark, d))


@query("gr3_leaf_sequences", f"WITH {V.WORDS_SQL}, {LEAVES_SQL.format('word_reads')} SELECT seq, first_id AS rep_id, copies FROM l WHERE is_leaf")
def gr3(spark, d):
    return C.leaf_sequences(V.word_reads(spark, d))


def kmers_sql(k, src="reads", ids="read_id"):
    return (f"occ AS (SELECT {ids}, CAST(i AS BIGINT) AS pos, substr(seq, CAST(i AS INTEGER) + 1, {k}) AS kmer FROM "
            f"(SELECT {ids}, seq, unnest(range(0, length(seq) - {k} + 1)) AS i FROM {src} WHERE length(seq) >= {k}))")


@query("agg21_distinct_kmers", f"WITH {V.READS_SQL}, {kmers_sql(36)} SELECT DISTINCT kmer FROM occ")
def agg21(spark, d):
    return K.distinct_kmers(V.reads(spark, d), 36)


@query("agg22_posting_counts", f"WITH {V.READS_SQL}, {kmers_sql(36)} SELECT kmer, COUNT(*) AS postings FROM occ GROUP BY kmer")
def agg22(spark, d):
    return K.posting_counts(V.reads(spark, d), 36)


@query("fn9_kmer_postings", f"WITH {V.TURNS_SQL}, {kmers_sql(12, 'turns', 'conv_id, turn')} SELECT conv_id, turn, pos, kmer FROM occ")
def fn9(spark, d):
    return K.kmer_table(V.turn_reads(spark, d), 12, ["conv_id", "turn"]).withColumn("pos", F.col("pos").cast("long"))


@query("flt10_end_kmers", f"WITH {V.READS_SQL}, {kmers_sql(36, ids='read_id, length(seq) AS len')}, ends AS (SELECT read_id, kmer FROM occ WHERE pos < 150 OR pos + 36 > len - 150) "
       "SELECT read_id, COUNT(*) AS places, COUNT(DISTINCT kmer) AS kmers FROM ends GROUP BY read_id")
def flt10(spark, d):
    """k-mers within 150 bases of either end of a read."""
    return K.end_counts(V.reads(spark, d), 36, 150)


@query("fn25_kmer_shifts", f"WITH {V.TURNS_SQL}, {kmers_sql(12, 'turns', 'conv_id, turn')} SELECT DISTINCT kmer, substr(kmer, 2) || 'A' AS shifted_left, "
       "'T' || substr(kmer, 1, 11) AS shifted_right, substr(kmer, 1, 11) AS start_part, substr(kmer, 2) AS end_part FROM occ")
def fn25(spark, d):
    from strandframe.functions import sequences as S
    kmers = K.kmer_table(V.turn_reads(spark, d), 12, ["conv_id"]).select("kmer").distinct()
    return kmers.select("kmer", S.kmer_shift_left("kmer", "A").alias("shifted_left"), S.kmer_shift_right("kmer", "T").alias("shifted_right"),
                        S.kmer_start("kmer").alias("start_part"), S.kmer_end("kmer").alias("end_part"))


@query("km1_known_kmers", f"WITH {V.READS_SQL}, {kmers_sql(36)}, b AS (SELECT item_id AS read_id, {V.sql_bases('text')} AS seq FROM benchmark), "
       f"{kmers_sql(36, 'b').replace('occ AS', 'bocc AS')} SELECT read_id, COUNT(*) AS n FROM occ WHERE kmer IN (SELECT kmer FROM bocc) GROUP BY read_id")
def km1(spark, d):
    bench = V.table(spark, d, "benchmark").select(F.col("item_id").alias("read_id"), V.to_bases(F.col("text")).alias("seq"))
    return K.known_kmers(V.reads(spark, d), bench, 36).groupBy("read_id").agg(F.count("*").alias("n"))


def repertoires(spark, d):
    """Distinct sequences per source, named by their smallest read."""
    return V.reads(spark, d).groupBy(F.substring("source", 4, 9).cast("int").alias("rep_id"), "seq").agg(
        F.min("read_id").alias("cluster_id"), F.count("*").alias("size"))


REPS_SQL = (V.READS_SQL + ", reps AS (SELECT CAST(substr(source, 4) AS INTEGER) AS rep_id, seq, MIN(read_id) AS cluster_id, COUNT(*) AS size "
            "FROM reads GROUP BY ALL)")
SHARED_SQL = (
    "sized AS (SELECT *, length(seq) AS len FROM reps), " + kmers_sql(80, "sized", "rep_id, cluster_id, len") +
    ", shared AS (SELECT DISTINCT a.rep_id AS rep_a, a.cluster_id AS a_id, b.rep_id AS rep_b, b.cluster_id AS b_id, a.pos - b.pos AS shift "
    "FROM occ a JOIN occ b ON a.kmer = b.kmer AND a.rep_id < b.rep_id "
    "WHERE least(a.len - greatest(a.pos - b.pos, 0), b.len + least(a.pos - b.pos, 0)) >= 300)")
NEIGHBOURS_SQL = (
    SHARED_SQL + ", cut AS (SELECT s.*, CAST(least(a.len - greatest(shift, 0), b.len + least(shift, 0)) AS INTEGER) AS n, a.seq AS sa, b.seq AS sb FROM shared s "
    "JOIN sized a ON a.rep_id = rep_a AND a.cluster_id = a_id JOIN sized b ON b.rep_id = rep_b AND b.cluster_id = b_id), "
    "scored AS (SELECT rep_a, a_id, rep_b, b_id, n - 6 * hamming(substr(sa, CAST(greatest(shift, 0) AS INTEGER) + 1, n), substr(sb, CAST(greatest(-shift, 0) AS INTEGER) + 1, n)) AS score FROM cut), "
    "neigh AS (SELECT rep_a, a_id, rep_b, b_id, CAST(MAX(score) AS BIGINT) AS score FROM scored WHERE score > 0 GROUP BY ALL)")
BEST_SQL = ("both_ways AS (SELECT rep_a AS rep_id, a_id AS cluster_id, rep_b AS other_rep, b_id AS neighbour_id, score FROM neigh UNION ALL "
            "SELECT rep_b, b_id, rep_a, a_id, score FROM neigh), best AS (SELECT rep_id, cluster_id, other_rep, neighbour_id, score FROM "
            "(SELECT *, rank() OVER (PARTITION BY rep_id, cluster_id, other_rep ORDER BY score DESC) AS rk FROM both_ways) WHERE rk = 1)")


@query("jn6_shared_kmers", f"WITH {REPS_SQL}, {SHARED_SQL} SELECT rep_a, a_id, rep_b, b_id, shift FROM shared")
def jn6(spark, d):
    pairs = K.shared_kmers(repertoires(spark, d))
    return pairs.withColumn("shift", F.col("shift").cast("long"))


@query("jn8_scored_neighbours", f"WITH {REPS_SQL}, {NEIGHBOURS_SQL} SELECT rep_a, a_id, rep_b, b_id, score FROM neigh")
def jn8(spark, d):
    return K.scored_neighbours(repertoires(spark, d))


@query("agg2_best_neighbours", f"WITH {REPS_SQL}, {NEIGHBOURS_SQL}, {BEST_SQL} SELECT * FROM best")
def agg2(spark, d):
    return K.best_neighbours(jn8(spark, d))


@query("snk7_neighbour_lines", f"WITH {REPS_SQL}, {NEIGHBOURS_SQL} SELECT concat(rep_a, '.', a_id, ' - ', rep_b, '.', b_id, ' (score = ', score, ')') AS line FROM neigh")
def snk7(spark, d):
    from strandframe.sources.sinks import neighbour_lines
    return neighbour_lines(jn8(spark, d))


def sides(spark, d):
    """Both sets are used many times and therefore written once."""
    r = V.reads(spark, d)
    return settled(M.sequence_sets(r.where("source < 'src15'"))), settled(M.sequence_sets(r.where("source >= 'src15'")))


SIDES_SQL = (V.READS_SQL + ", a AS (SELECT MIN(read_id) AS seq_id, seq FROM reads WHERE source < 'src15' GROUP BY seq), "
             "b AS (SELECT MIN(read_id) AS seq_id, seq FROM reads WHERE source >= 'src15' GROUP BY seq)")
HITS0_SQL = ("hits AS (SELECT a.seq_id AS a_id, b.seq_id AS b_id FROM a JOIN b ON (starts_with(a.seq, b.seq) OR starts_with(b.seq, a.seq)) "
             "WHERE a.seq <> '' AND b.seq <> ''), "
             "best AS (SELECT 'a' AS side, a_id AS q_id, b_id AS hit_id, CAST(0 AS BIGINT) AS score FROM hits UNION ALL SELECT 'b', b_id, a_id, 0 FROM hits)")

for _n, _strategy in (("jn1", "naive"), ("jn2", "single"), ("jn3", "pair"), ("jn4", "triple")):

    @query(f"{_n}_{_strategy}_exact_hits", f"WITH {SIDES_SQL}, {HITS0_SQL} SELECT * FROM best")
    def exact_hits(spark, d, strategy=_strategy):
        """No edits allowed: one read must start the other.  An empty read, which starts all, has no hits."""
        return M.best_hits(*sides(spark, d), k=36, tau=0, strategy=strategy)

    @query(f"{_n}_{_strategy}_best_hits")
    def near_hits(spark, d, strategy=_strategy):
        """Up to three edits, the default bound; checked against all pairs in the tests."""
        return M.best_hits(*sides(spark, d), k=36, tau=3, strategy=strategy)


@query("jn5_candidate_union", f"WITH {SIDES_SQL}, {HITS0_SQL} SELECT a_id, b_id FROM hits")
def jn5(spark, d):
    a, b = sides(spark, d)
    return M.score_pairs(M.candidates(a, b, 36, 0, "triple"), a, b, 0).select("a_id", "b_id")


@query("snk5_best_hit_lines", f"WITH {SIDES_SQL}, {HITS0_SQL}, lists AS (SELECT q_id, '0 ' || string_agg(CAST(hit_id AS VARCHAR), ' ' ORDER BY hit_id) AS line "
       "FROM best WHERE side = 'a' GROUP BY q_id) SELECT a.seq_id AS q_id, COALESCE(line, '') AS line FROM a LEFT JOIN lists ON q_id = a.seq_id")
def snk5(spark, d):
    a, b = sides(spark, d)
    hits = M.best_hits(a, b, k=36, tau=0).where("side = 'a'")
    return M.best_hit_lines(hits, a)


@query("fn8_anchor_choice")
def fn8(spark, d):
    a, b = sides(spark, d)
    return M.anchors(a, b, 36, 3, "triple")


@query("fn7_half_banded_tau0", f"WITH {V.PAIRS_SQL} SELECT conv_id, turn, CAST(-hamming(substr(s1, 1, n), substr(s2, 1, n)) AS BIGINT) AS score "
       "FROM (SELECT *, CAST(least(length(s1), length(s2)) AS INTEGER) AS n FROM pairs)")
def fn7_tau0(spark, d):
    return V.turn_pairs(spark, d).select("conv_id", "turn", A.half_banded_score("s1", "s2", 0).alias("score"))


def banded_sql(band):
    """Row-by-row dynamic program over the band as a recursive query."""
    w = 2 * band + 1
    cell = (f"CASE WHEN i + x - {band} < 0 OR i + x - {band} > n2 THEN -1000000 ELSE greatest("
            f"CASE WHEN i + x - {band} >= 1 THEN row[x + 1] - CASE WHEN substr(s1, i, 1) = substr(s2, i + x - {band}, 1) THEN 0 ELSE 1 END ELSE -1000000 END, "
            f"CASE WHEN x + 1 < {w} THEN row[x + 2] - 1 ELSE -1000000 END) END")
    slide = f"list_transform(range(0, {w}), lambda x: list_max(list_transform(range(0, x + 1), lambda y: raw[y + 1] - (x - y))))"
    clip = f"list_transform(range(0, {w}), lambda x: CASE WHEN i + x - {band} < 0 OR i + x - {band} > n2 THEN -1000000 ELSE full_row[x + 1] END)"
    return (
        f"RECURSIVE dp AS (SELECT conv_id, turn, s1, s2, CAST(length(s1) AS INTEGER) AS n1, CAST(length(s2) AS INTEGER) AS n2, 0 AS i, "
        f"list_transform(range(0, {w}), lambda x: CASE WHEN x >= {band} AND x - {band} <= length(s2) THEN {band} - x ELSE -1000000 END) AS row FROM pairs "
        f"UNION ALL SELECT conv_id, turn, s1, s2, n1, n2, i, {clip} AS row FROM (SELECT *, {slide} AS full_row FROM ("
        f"SELECT conv_id, turn, s1, s2, n1, n2, i, list_transform(range(0, {w}), lambda x: {cell}) AS raw FROM ("
        f"SELECT conv_id, turn, s1, s2, n1, n2, i + 1 AS i, row FROM dp WHERE i < n1))))")


@query("fn7_half_banded_tau3", f"WITH {banded_sql(3).replace('RECURSIVE dp', 'RECURSIVE ' + V.PAIRS_SQL + ', dp', 1)} "
       "SELECT conv_id, turn, CAST(MAX(CASE WHEN i = n1 THEN list_max(row) WHEN n2 - i + 3 BETWEEN 0 AND 6 THEN row[n2 - i + 4] ELSE -1000000 END) AS BIGINT) AS score FROM dp GROUP BY conv_id, turn")
def fn7_tau3(spark, d):
    return V.turn_pairs(spark, d).select("conv_id", "turn", A.half_banded_score("s1", "s2", 3).alias("score"))


@query("fn6_shift_matches")
def fn6(spark, d):
    return V.turn_pairs(spark, d).select("conv_id", "turn", A.shift_matches("s1", "s2").alias("matches"))


SHIFT_SQL = (
    "strands AS (SELECT conv_id, turn, s1, s2, TRUE AS same FROM pairs UNION ALL SELECT conv_id, turn, s1, reverse(translate(s2, 'ACGTN', 'TGCAN')), FALSE FROM pairs), "
    "long AS (SELECT * FROM strands WHERE length(s1) >= 300 AND length(s2) >= 300), "
    "ways AS (SELECT conv_id, turn, same, 0 AS way, s1 AS x, s2 AS y FROM long UNION ALL SELECT conv_id, turn, same, 1, s2, s1 FROM long), "
    "places AS (SELECT *, unnest(range(0, greatest(0, length(x) - 300))) AS shift FROM ways), "
    "cuts AS (SELECT conv_id, turn, same, way, shift, n, hamming(substr(x, CAST(shift AS INTEGER) + 1, n), substr(y, 1, n)) AS errors FROM "
    "(SELECT *, CAST(least(length(x) - shift, length(y)) AS INTEGER) AS n FROM places)), "
    "tops AS (SELECT conv_id, turn, n - 10 * errors AS score, CASE WHEN way = 0 THEN shift ELSE -shift END AS shift, errors, same, "
    "row_number() OVER (PARTITION BY conv_id, turn ORDER BY n - 10 * errors DESC, same DESC, way, abs(shift)) AS rn FROM cuts WHERE errors <= 100 AND n - 10 * errors > -100000)")


@query("fn13_shift_alignment", f"WITH {V.PAIRS_SQL}, {SHIFT_SQL} SELECT p.conv_id, p.turn, CAST(COALESCE(t.score, -100000) AS BIGINT) AS score, "
       "CAST(COALESCE(t.shift, 0) AS BIGINT) AS shift, CAST(COALESCE(t.errors, 100000) AS BIGINT) AS errors, COALESCE(t.same, TRUE) AS same_strand "
       "FROM pairs p LEFT JOIN (SELECT * FROM tops WHERE rn = 1) t ON p.conv_id = t.conv_id AND p.turn = t.turn")
def fn13(spark, d):
    p = V.turn_pairs(spark, d).select("conv_id", "turn", A.shift_align("s1", "s2").alias("a"))
    return p.select("conv_id", "turn", "a.score", "a.shift", "a.errors", "a.same_strand")


@query("fn14_affine_alignment")
def fn14(spark, d):
    p = V.turn_pairs(spark, d).select("conv_id", "turn", A.affine_align("s1", "s2").alias("a"))
    return p.select("conv_id", "turn", F.round("a.score", 6).alias("score"), "a.row1", "a.row2")


@query("fn18_banded_overlap")
def fn18(spark, d):
    return V.turn_pairs(spark, d).select("conv_id", "turn", A.banded_overlap_score("s1", "s2", 3, 20, 100000).alias("score"))


@query("fn21_edit_distance", f"WITH {V.PAIRS_SQL} SELECT conv_id, turn, CAST(levenshtein(s1, s2) AS BIGINT) AS plain FROM pairs")
def fn21(spark, d):
    return V.turn_pairs(spark, d).select("conv_id", "turn", A.edit_distance_to("s1", "s2", False).alias("plain"))


@query("fn21_edit_distance_with_swaps")
def fn21_swaps(spark, d):
    return V.turn_pairs(spark, d).select("conv_id", "turn", A.edit_distance_to("s1", "s2", True).alias("distance"))


@query("fn22_local_similarity")
def fn22(spark, d):
    p = V.turn_pairs(spark, d).select("conv_id", "turn", A.local_similarity_of("s1", "s2").alias("a"))
    return p.select("conv_id", "turn", "a.score", "a.length")
