"""Queries over read transforms, predicates and scalar sequence functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.operators import reads as R
from strandframe.plans import views as V
from strandframe.plans.registry import query

RC_SQL = "reverse(translate({0}, 'ACGTNacgtn', 'TGCANTGCAN'))"
RC_A_SQL = "reverse(translate({0}, 'ACGTNacgtn', 'TGCAATGCAA'))"
rc = RC_SQL.format
STATS = "COUNT(*) AS n, CAST(SUM(length(seq)) AS BIGINT) AS bases"


@query("prj1_reverse_complement_pairs", f"WITH {V.READS_N_SQL} SELECT read_id, FALSE AS is_rc, seq FROM reads_n "
       f"UNION ALL SELECT read_id, TRUE, {rc('seq')} FROM reads_n")
def prj1(spark, d):
    return R.with_reverse_complement(V.reads_n(spark, d).select("read_id", "seq"))


@query("prj2_forward_reads_only", f"WITH {V.READS_N_SQL} SELECT read_id, seq FROM reads_n")
def prj2(spark, d):
    return R.drop_reverse_complement(prj1(spark, d))


for _o, _a, _b in (("ff", "s1", "s2"), ("rr", rc("s1"), rc("s2")), ("fr", "s1", rc("s2")), ("rf", rc("s1"), "s2")):
    @query(f"prj3_orientation_{_o}", f"WITH {V.PAIRS_SQL} SELECT conv_id, turn, {_a} AS s1, {_b} AS s2 FROM pairs")
    def prj3(spark, d, o=_o.upper()):
        return R.change_orientation(V.turn_pairs(spark, d), o)


@query("prj4_flatten_pairs", f"WITH {V.PAIRS_SQL} SELECT conv_id, turn, CAST(1 AS BIGINT) AS mate, s1 AS seq FROM pairs "
       "UNION ALL SELECT conv_id, turn, CAST(2 AS BIGINT), s2 FROM pairs")
def prj4(spark, d):
    return R.flatten_pairs(V.turn_pairs(spark, d))


@query("prj5_valid_runs", f"WITH {V.READS_N_SQL}, runs AS (SELECT read_id, unnest(list_filter("
       "regexp_split_to_array(seq, '[^ACGTacgt]+'), lambda x: x <> '')) AS seq FROM reads_n) SELECT read_id, seq FROM runs")
def prj5(spark, d):
    return R.split_at_invalid(V.reads_n(spark, d).select("read_id", "seq")).select("read_id", "seq")


LONGEST_SQL = ("longest AS (SELECT read_id, source, seq FROM (SELECT read_id, source, run AS seq, row_number() OVER "
               "(PARTITION BY read_id ORDER BY length(run) DESC, i) AS rn FROM (SELECT read_id, source, unnest(runs) AS run, "
               "generate_subscripts(runs, 1) AS i FROM (SELECT read_id, source, list_filter(regexp_split_to_array(seq, "
               "'[^ACGTacgt]+'), lambda x: x <> '') AS runs FROM reads_n))) WHERE rn = 1)")


@query("prj6_longest_valid_run", f"WITH {V.READS_N_SQL}, {LONGEST_SQL} SELECT read_id, seq FROM longest")
def prj6(spark, d):
    return R.keep_longest_valid(V.reads_n(spark, d).select("read_id", "seq"))


def _pairs_n(spark, d):
    t = V.table(spark, d, "conversations").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), V.to_bases_with_n(F.col("text")).alias("s1"))
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("s1").alias("s2"))
    return t.join(nxt, ["conv_id", "turn"]).withColumn("insert_size", F.length("s1") + F.length("s2"))


PAIRS_N_SQL = (f"turns_n AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, {V.sql_bases_n('text')} AS seq FROM conversations), "
               "pairs_n AS (SELECT a.conv_id, a.turn, a.seq AS s1, b.seq AS s2, length(a.seq) + length(b.seq) AS insert_size "
               "FROM turns_n a JOIN turns_n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)")
_run = "list_aggregate(list_filter(regexp_split_to_array({0}, '[^ACGTacgt]+'), lambda x: length(x) = {1}), 'first')"
_len = "list_max(list_transform(regexp_split_to_array({0}, '[^ACGTacgt]+'), lambda x: length(x)))"
CUT_PAIRS_SQL = (
    f"lens AS (SELECT *, {_len.format('s1')} AS n1, {_len.format('s2')} AS n2 FROM pairs_n), "
    f"runs AS (SELECT *, {_run.format('s1', 'n1')} AS r1, {_run.format('s2', 'n2')} AS r2 FROM lens WHERE n1 > 0 AND n2 > 0), "
    "cut AS (SELECT conv_id, turn, r1 AS s1, r2 AS s2, insert_size - (instr(s1, r1) - 1) - length(s2) "
    "+ (instr(s2, r2) - 1 + n2) AS insert_size FROM runs)")


@query("prj6_longest_valid_pairs", f"WITH {PAIRS_N_SQL}, {CUT_PAIRS_SQL} SELECT conv_id, turn, s1, s2, "
       "CAST(insert_size AS BIGINT) AS insert_size FROM cut")
def prj6_pairs(spark, d):
    return R.keep_longest_valid_pairs(_pairs_n(spark, d)).withColumn("insert_size", F.col("insert_size").cast("long"))


@query("cmp2_paired_reader", f"WITH {PAIRS_N_SQL.replace('b.seq AS s2', rc('b.seq') + ' AS s2')}, {CUT_PAIRS_SQL} "
       f"SELECT conv_id, turn, s1, s2, FALSE AS is_rc FROM cut UNION ALL SELECT conv_id, turn, {rc('s2')}, {rc('s1')}, TRUE FROM cut")
def cmp2(spark, d):
    return R.standard_pairs(_pairs_n(spark, d), "FR").drop("insert_size")


@query("prj8_prefixed_names", "SELECT concat('lib1_', lang, '_', CAST(doc_id AS VARCHAR)) AS name, doc_id FROM documents")
def prj8(spark, d):
    named = V.table(spark, d, "documents").select(F.concat_ws("_", "lang", "doc_id").alias("name"), "doc_id")
    return R.prefix_names(named, "lib1_")


@query("prj9_trim_unknown_ends", f"WITH {V.READS_N_SQL} SELECT read_id, regexp_replace(regexp_replace(seq, '^N+', ''), "
       "'N+$', '') AS seq FROM reads_n")
def prj9(spark, d):
    return R.trim_unknown(V.reads_n(spark, d).select("read_id", "seq"))


QUALITY = ("ACGTN", "5I:+#")


@query("prj9_trim_low_quality", f"WITH {V.READS_N_SQL}, q AS (SELECT read_id, seq, list_filter(range(1, length(seq) + 1), "
       "lambda i: substr(seq, i, 1) NOT IN ('N', 'A', 'T')) AS good FROM reads_n) "
       "SELECT read_id, CASE WHEN len(good) = 0 THEN '' ELSE substr(seq, list_min(good), list_max(good) - list_min(good) + 1) END AS seq, "
       "CASE WHEN len(good) = 0 THEN '' ELSE translate(substr(seq, list_min(good), list_max(good) - list_min(good) + 1), "
       f"'{QUALITY[0]}', '{QUALITY[1]}') END AS quality FROM q")
def prj9_quality(spark, d):
    """Qualities derived per base: A 20, C 40, G 25, T 10, N 2; bases must exceed 20."""
    r = V.reads_n(spark, d).select("read_id", "seq").withColumn("quality", F.translate("seq", *QUALITY))
    return R.trim_unknown_and_bad(r, 20)


@query("prj10_subread_names", f"WITH {V.READS_SQL}, named AS (SELECT read_id, seq, source || CASE WHEN length(seq) % 2 = 0 "
       "THEN '_RC' ELSE '' END AS name, length(seq) // 4 AS a, length(seq) - length(seq) // 4 AS b, length(seq) AS n FROM reads) "
       "SELECT read_id, CASE WHEN b - a = n THEN name WHEN name LIKE '%_RC' THEN replace(name, '_RC', '') || '_SUBSTR(' || (n - b) || ',' || (n - a) "
       "|| ')_RC' ELSE name || '_SUBSTR(' || a || ',' || b || ')' END AS name, substr(seq, a + 1, b - a) AS seq FROM named")
def prj10(spark, d):
    n = F.length("seq")
    r = V.reads(spark, d).select("read_id", "seq", F.concat("source", F.when(n % 2 == 0, "_RC").otherwise("")).alias("name"))
    quarter = F.expr("length(seq) div 4")
    return R.subread(r, quarter, n - quarter)


@query("prj12_underscored_text", "SELECT doc_id, replace(text, ' ', '_') AS text FROM documents")
def prj12(spark, d):
    return V.table(spark, d, "documents").select("doc_id", S.underscored("text").alias("text"))


@query("flt1_valid_reads", f"WITH {V.READS_N_SQL} SELECT read_id FROM reads_n WHERE regexp_full_match(seq, '[ACGTacgt]+')")
def flt1(spark, d):
    return R.keep_valid(V.reads_n(spark, d)).select("read_id")


@query("flt2_minimum_read_length", f"WITH {V.READS_SQL} SELECT read_id, length(seq) AS n FROM reads WHERE length(seq) >= 216")
def flt2(spark, d):
    return R.keep_long_enough(V.reads(spark, d)).select("read_id", F.length("seq").cast("long").alias("n"))


@query("flt5_predicate_combinators", f"WITH {V.READS_N_SQL} SELECT read_id FROM reads_n WHERE (length(seq) >= 500 OR "
       "source = 'src1') AND NOT contains(seq, 'N')")
def flt5(spark, d):
    long_or_src1 = R.any_of(F.length("seq") >= 500, F.col("source") == "src1")
    return V.reads_n(spark, d).where(R.all_of(long_or_src1, ~F.contains("seq", F.lit("N")))).select("read_id")


@query("flt9_tolerant_comparison", "SELECT l_orderkey, l_linenumber, abs(l_extendedprice * (1 - l_discount) - (l_extendedprice - "
       "l_extendedprice * l_discount)) <= 1e-12 * greatest(abs(l_extendedprice * (1 - l_discount)), abs(l_extendedprice - "
       "l_extendedprice * l_discount), 1.0) AS same FROM lineitem")
def flt9(spark, d):
    a = F.expr("l_extendedprice * (1 - l_discount)")
    b = F.expr("l_extendedprice - l_extendedprice * l_discount")
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.nearly_equal(a, b).alias("same"))


@query("cmp1_standard_reader", f"WITH {V.READS_N_SQL}, {LONGEST_SQL} SELECT read_id, FALSE AS is_rc, seq FROM longest "
       f"UNION ALL SELECT read_id, TRUE, {rc('seq')} FROM longest")
def cmp1(spark, d):
    return R.standard_reads(V.reads_n(spark, d).select("read_id", "seq"))


@query("cmp3_single_and_paired_reader", f"WITH {V.READS_SQL}, {V.PAIRS_SQL}, s AS (SELECT seq FROM reads UNION ALL SELECT s1 FROM pairs "
       f"UNION ALL SELECT s2 FROM pairs) SELECT seq, FALSE AS is_rc FROM s UNION ALL SELECT {rc('seq')}, TRUE FROM s")
def cmp3(spark, d):
    singles = V.reads(spark, d).select("seq")
    return R.with_reverse_complement(singles.unionByName(R.flatten_pairs(V.turn_pairs(spark, d)).select("seq")))


@query("cmp4_merged_statistics", f"WITH {V.READS_SQL} SELECT COUNT(*) AS read_count, MAX(length(seq)) AS max_len, "
       "CAST(SUM(length(seq)) AS BIGINT) AS total_len FROM reads")
def cmp4(spark, d):
    return R.merge_statistics(R.read_statistics(V.reads(spark, d), "source"))


@query("agg20_read_statistics", f"WITH {V.READS_SQL} SELECT source, COUNT(*) AS read_count, MAX(length(seq)) AS max_len, "
       "CAST(SUM(length(seq)) AS BIGINT) AS total_len FROM reads GROUP BY source")
def agg20(spark, d):
    return R.read_statistics(V.reads(spark, d), "source")


@query("fn1_reverse_complement_n_to_a", f"WITH {V.READS_N_SQL} SELECT read_id, {RC_A_SQL.format('seq')} AS rc FROM reads_n")
def fn1(spark, d):
    return V.reads_n(spark, d).select("read_id", S.reverse_complement("seq", keep_n=False).alias("rc"))


@query("fn2_reverse_complement", f"WITH {V.READS_N_SQL} SELECT read_id, {rc('seq')} AS rc, translate(seq, 'ACGTN', 'TGCAN') AS comp FROM reads_n")
def fn2(spark, d):
    return V.reads_n(spark, d).select("read_id", S.reverse_complement("seq").alias("rc"), S.complement("seq").alias("comp"))


HAM = "hamming(substr(s1, 1, n), substr(s2, 1, n))"
N_SQL = "(SELECT *, CAST(least(length(s1), length(s2)) AS INTEGER) AS n FROM pairs)"


@query("fn3_hamming", f"WITH {V.PAIRS_SQL} SELECT conv_id, turn, CAST({HAM} AS BIGINT) AS dist, (SELECT COALESCE(CAST(SUM(i) AS BIGINT), 0) "
       f"FROM (SELECT unnest(range(0, n)) AS i) WHERE substr(s1, CAST(i AS INTEGER) + 1, 1) <> substr(s2, CAST(i AS INTEGER) + 1, 1)) AS pos_sum FROM {N_SQL}")
def fn3(spark, d):
    pos = F.aggregate(S.differing_positions("s1", "s2"), F.lit(0).cast("long"), lambda a, x: a + x)
    return V.turn_pairs(spark, d).select("conv_id", "turn", S.hamming_shorter("s1", "s2").cast("long").alias("dist"), pos.alias("pos_sum"))


@query("fn4_bounded_mismatches", f"WITH {V.PAIRS_SQL} SELECT conv_id, turn, CAST(CASE WHEN m > 100 THEN n ELSE m END AS BIGINT) AS m FROM "
       "(SELECT conv_id, turn, n, hamming(substr(s1, 3, n), substr(s2, 1, n)) AS m FROM (SELECT *, CAST(least(length(s1) - 2, "
       "length(s2)) AS INTEGER) AS n FROM pairs WHERE length(s1) >= 2))")
def fn4(spark, d):
    return V.turn_pairs(spark, d).where(F.length("s1") >= 2).select(
        "conv_id", "turn", S.bounded_mismatches("s1", 2, "s2", 0, 100).cast("long").alias("m"))


@query("fn5_overlap_score", f"WITH {V.PAIRS_SQL} SELECT conv_id, turn, CAST((n - m) - 5 * m AS BIGINT) AS score, CAST(CASE WHEN m > 50 OR n < 2 * m "
       f"THEN 0 ELSE n - 2 * m END AS BIGINT) AS simple FROM (SELECT *, {HAM} AS m FROM {N_SQL})")
def fn5(spark, d):
    return V.turn_pairs(spark, d).select(
        "conv_id", "turn", S.overlap_score("s1", 0, "s2", 0).cast("long").alias("score"),
        S.penalised_overlap("s1", 0, "s2", 0, 50, 2).cast("long").alias("simple"))


@query("fn11_superstring", f"WITH {V.PAIRS_SQL}, o AS (SELECT conv_id, turn, s1, s1[5:] || s2 AS t FROM pairs WHERE length(s1) >= 8) "
       "SELECT conv_id, turn, substr(s1, 1, 4) || t AS merged FROM o")
def fn11(spark, d):
    """Each turn overlaps the joined text of itself (from base 4) and the next turn."""
    p = V.turn_pairs(spark, d).where(F.length("s1") >= 8)
    t = F.concat(S.piece("s1", 4, F.length("s1")), F.col("s2"))
    return p.select("conv_id", "turn", S.superstring("s1", 4, t, 0).alias("merged"))


@query("fn11_merge_overlapping", f"WITH {V.TURNS_SQL} SELECT conv_id, string_agg(seq, '' ORDER BY turn) AS merged FROM turns GROUP BY conv_id")
def fn11_merge(spark, d):
    """Turns of a conversation, each prolonged by the next base, merged back with overlap 1."""
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = V.turn_reads(spark, d).where("seq <> ''").withColumn("nxt", F.coalesce(S.piece(F.lead("seq").over(w), 0, 1), F.lit("")))
    parts = t.select("conv_id", F.struct("turn", F.concat("seq", "nxt").alias("part")).alias("p"))
    ordered = parts.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]).alias("parts"))
    return ordered.select("conv_id", S.merge_with_overlap("parts", 1).alias("merged"))


def _stop_sql(f):
    return (f"COALESCE(list_min(list_filter(list_transform(range(1, greatest(1, CAST(floor((length(seq) - 3 - {f}) / 3.0) AS BIGINT))), "
            f"lambda i: i * 3 + {f}), lambda p: substr(seq, CAST(p AS INTEGER) + 1, 3) IN ('TAG', 'TAA', 'TGA'))), length(seq))")


@query("fn12_stop_codons", f"WITH {V.TURNS_SQL} SELECT conv_id, turn, {_stop_sql(0)} AS f0, {_stop_sql(1)} AS f1, {_stop_sql(2)} AS f2 FROM turns")
def fn12(spark, d):
    return V.turn_reads(spark, d).select("conv_id", "turn", *[S.stop_codon_position("seq", f).cast("long").alias(f"f{f}") for f in range(3)])


@query("agg26_stop_codon_clusters", f"WITH {V.READS_SQL}, c AS (SELECT MIN(read_id) AS cluster_id, COUNT(*) AS size, seq FROM reads GROUP BY seq), "
       f"p AS (SELECT size, greatest({_stop_sql(0)}, {_stop_sql(1)}, {_stop_sql(2)}) < length(seq) AS bad FROM c) SELECT COUNT(*) AS clusters, "
       "COUNT(*) FILTER (bad) AS incorrect, CAST(COALESCE(SUM(size) FILTER (bad), 0) AS BIGINT) AS incorrect_reads FROM p")
def agg26(spark, d):
    from strandframe.operators.clusters import stop_codon_summary
    c = V.reads(spark, d).groupBy("seq").agg(F.min("read_id").alias("cluster_id"), F.count("*").alias("size"))
    return stop_codon_summary(c)


SYM = ("list_transform(range(1, n + 1), lambda i: CASE WHEN substr(a, CAST(i AS INTEGER), 1) = substr(b, CAST(i AS INTEGER), 1) THEN '.' "
       "WHEN substr(a, CAST(i AS INTEGER), 1) = '-' OR substr(b, CAST(i AS INTEGER), 1) = '-' THEN '!' ELSE '_' END)")
ALIGNED_SQL = f"aligned AS (SELECT conv_id, turn, replace(s1, 'A', '-') AS a, s2 AS b, n FROM {N_SQL})"


@query("fn15_alignment_symbols", f"WITH {V.PAIRS_SQL}, {ALIGNED_SQL}, s AS (SELECT conv_id, turn, array_to_string({SYM}, '') AS symbols FROM aligned) "
       "SELECT conv_id, turn, COALESCE(symbols, '') AS symbols, NOT contains(symbols, '!') AS gap_free, "
       "length(symbols) - length(replace(symbols, '_', '')) AS mismatches FROM s")
def fn15(spark, d):
    p = V.turn_pairs(spark, d).select("conv_id", "turn", S.alignment_symbols(F.translate("s1", "A", "-"), "s2").alias("symbols"))
    return p.select("*", S.gap_free("symbols").alias("gap_free"), S.mismatch_count("symbols").cast("long").alias("mismatches"))


@query("fn16_relative_positions", f"WITH {V.PAIRS_SQL}, {ALIGNED_SQL}, s AS (SELECT conv_id, turn, n, unnest({SYM}) AS symbol, "
       "unnest(range(0, n)) AS i FROM aligned) SELECT conv_id, turn, CAST(i AS BIGINT) AS i, round(CAST(i AS DOUBLE) / n, 9) AS relative "
       "FROM s WHERE symbol = '_'")
def fn16(spark, d):
    p = fn15(spark, d).select("conv_id", "turn", "symbols", F.posexplode(S.relative_mismatch_positions("symbols")).alias("k", "r"))
    return p.select("conv_id", "turn", F.round(F.col("r") * F.length("symbols")).cast("long").alias("i"), F.round("r", 9).alias("relative"))


@query("fn23_similar_ends", f"WITH {V.PAIRS_SQL} SELECT conv_id, turn, COALESCE(list_bool_or(list_transform(range(0, length(s1) - 3), "
       "lambda i: starts_with(s2, substr(s1, CAST(i AS INTEGER) + 1)))), FALSE) AS to_right, COALESCE(list_bool_or(list_transform(range(0, length(s2) - 3), "
       "lambda i: starts_with(s1, substr(s2, CAST(i AS INTEGER) + 1)))), FALSE) AS to_left FROM pairs")
def fn23(spark, d):
    return V.turn_pairs(spark, d).select("conv_id", "turn", S.similar_to_right("s1", "s2", 4).alias("to_right"),
                                         S.similar_to_left("s1", "s2", 4).alias("to_left"))


@query("fn24_string_operations", f"WITH {V.PAIRS_SQL} SELECT conv_id, turn, substr(s1, 3, 10) AS part, left(s1, 1) AS first, right(s1, 1) AS last, "
       "instr(s1, 'ACG') - 1 AS found, s1 < s2 AS less, s1 || s2 AS joined FROM pairs")
def fn24(spark, d):
    return V.turn_pairs(spark, d).select(
        "conv_id", "turn", S.piece("s1", 2, 10).alias("part"), F.left("s1", F.lit(1)).alias("first"),
        F.right("s1", F.lit(1)).alias("last"), (F.instr("s1", "ACG") - 1).cast("long").alias("found"),
        (F.col("s1") < F.col("s2")).alias("less"), F.concat("s1", "s2").alias("joined"))


@query("fn26_split_and_cast", "SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, "
       "CAST(split_part(CAST(user_id AS VARCHAR) || '..' || CAST(event_id AS VARCHAR), '..', 1) AS BIGINT) AS lo, "
       "event_id AS hi, split_part(event_type || ':' || CAST(user_id AS VARCHAR), ':', 2) AS field FROM events")
def fn26(spark, d):
    e = V.table(spark, d, "events")
    r = S.number_range(F.concat_ws("..", "user_id", "event_id"))
    return e.select("event_id", F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"), r["lo"].alias("lo"),
                    r["hi"].alias("hi"), S.token(F.concat_ws(":", "event_type", "user_id"), ":", 1).alias("field"))


@query("fn27_file_names", "SELECT page_id, regexp_extract(path, '\\.([^./]*)$', 1) AS ext, regexp_replace(regexp_extract(path, "
       "'([^/]*)$', 1), '\\.[^.]*$', '') AS base FROM (SELECT page_id, split_part(split_part(url, '#', 1), '?', 1) AS path FROM pages)")
def fn27(spark, d):
    path = F.substring_index(F.substring_index("url", "#", 1), "?", 1)
    return V.table(spark, d, "pages").select("page_id", S.file_extension(path).alias("ext"), S.file_basename(path).alias("base"))


@query("fn28_first_valid_kmer", f"WITH {V.READS_N_SQL} SELECT read_id, CASE WHEN regexp_matches(seq, '[ACGTacgt]{{36}}') THEN instr(seq, "
       "regexp_extract(seq, '[ACGTacgt]{36}')) - 1 END AS at FROM reads_n")
def fn28(spark, d):
    return V.reads_n(spark, d).select("read_id", S.first_valid_kmer("seq", 36).cast("long").alias("at"))


@query("fn29_position_mapping", "SELECT l_orderkey, l_linenumber, CASE WHEN p * 2 + 1 >= 100 THEN (2 * p + 1) * 37 // 200 ELSE 36 - (2 * (99 - p) + 1) * 37 // 200 END "
       "AS uniform, (2 * p * 37 + 100) // 200 AS ends FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS p FROM lineitem)")
def fn29(spark, d):
    p = F.col("l_quantity").cast("long")
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.map_position_uniform(p, 100, 37).alias("uniform"),
                                                S.map_position_keeping_ends(p, 100, 37).alias("ends"))


@query("fn31_digest", f"WITH {V.READS_SQL} SELECT read_id, md5(seq) AS digest FROM reads")
def fn31(spark, d):
    return V.reads(spark, d).select("read_id", F.md5("seq").alias("digest"))


@query("fn32_tolerant_rounding", "SELECT event_id, CAST(floor(value + 1e-9) AS BIGINT) AS f, CAST(floor(value + 0.5 + 1e-9) AS BIGINT) AS r, "
       "CAST(CASE WHEN value >= 0 THEN floor(value + 1e-9) ELSE ceil(value - 1e-9) END AS BIGINT) AS z FROM events")
def fn32(spark, d):
    return V.table(spark, d, "events").select("event_id", S.tolerant_floor(F.col("value")).alias("f"), S.tolerant_round(F.col("value")).alias("r"),
                                              S.tolerant_towards_zero(F.col("value")).alias("z"))


@query("fn33_share_bucket", "SELECT l_orderkey, l_linenumber, CAST(floor((1 - l_discount) * 10.0) - 5 AS BIGINT) AS slot FROM lineitem")
def fn33(spark, d):
    return V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.share_bucket(1 - F.col("l_discount")).alias("slot"))
