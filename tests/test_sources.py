"""Readers and writers on small files."""

import gzip

import pytest
from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.operators import reads as R
from strandframe.sources import reads as IN
from strandframe.sources import sinks as OUT
from strandframe.sources import tables as TAB
from strandframe.sources.text import numbered_records
from strandframe.streaming.reads import stream_fasta

FASTA = ">one x\nACGT\nAC\n\n>empty\n>two\r\nTTTT\r\nGG\r\n>\nACGT\n>three\nA\n"


@pytest.fixture()
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    got = [tuple(r) for r in IN.read_fasta(spark, str(tmp_path / "a.fa")).collect()]
    assert got == [("one x", "ACGTAC"), ("two", "TTTTGG"), ("three", "A")]
    assert IN.read_fasta(spark, str(tmp_path / "a.fa"), keep_marker=True).first().name == ">one x"


def test_gzip_fasta(spark, tmp_path):
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write(FASTA)
    assert IN.read_fasta(spark, str(tmp_path / "a.fa.gz")).count() == 3


def test_fasta_split_over_blocks(spark, tmp_path, small_splits):
    rows = [(f"r{i}", "ACGT" * (i % 7 + 1)) for i in range(200)]
    (tmp_path / "a.fa").write_text("".join(f">{n}\n{s}\n" for n, s in rows))
    df = IN.read_fasta(spark, str(tmp_path / "a.fa"))
    assert df.rdd.getNumPartitions() > 4
    assert sorted(map(tuple, df.collect())) == sorted(rows)
    placed = IN.read_numbered_fasta(spark, str(tmp_path / "a.fa")).orderBy("ordinal").collect()
    assert [(r.name, r.seq) for r in placed] == rows and [r.ordinal for r in placed] == list(range(200))


def test_line_numbers_over_blocks(spark, tmp_path, small_splits):
    for f in "ab":
        (tmp_path / f"{f}.txt").write_text("".join(f"{f}{i}\n" for i in range(300)))
    got = numbered_records(spark, str(tmp_path)).collect()
    assert len(got) == 600 and all(r.value[1:] == str(r.ordinal) for r in got)
    across = {r.value: r.ordinal for r in numbered_records(spark, str(tmp_path), across=True).collect()}
    assert across["a0"] == 0 and across["b0"] == 300 and across["b299"] == 599


def test_fastq_over_blocks_and_pairs(spark, tmp_path, small_splits):
    rows = [(f"r{i}", "ACGT" * (i % 5 + 1), "@I+#" * (i % 5 + 1)) for i in range(120)]
    for side in ("1", "2"):
        (tmp_path / f"{side}.fq").write_text("".join(f"@{n}/{side}\n{s}\n+\n{q}\n" for n, s, q in rows))
    got = IN.read_fastq(spark, str(tmp_path / "1.fq")).orderBy("ordinal").collect()
    assert [(r.name, r.seq, r.quality) for r in got] == [(n + "/1", s, q) for n, s, q in rows]
    pairs = IN.read_paired_fastq(spark, str(tmp_path / "1.fq"), str(tmp_path / "2.fq")).orderBy("pair").collect()
    assert [(r.name1, r.name2) for r in pairs] == [(n + "/1", n + "/2") for n, _, _ in rows]
    assert IN.quality_offset(IN.read_fastq(spark, str(tmp_path / "1.fq"))).first().offset == 33


def test_fastq_of_unequal_lengths_is_an_error(spark, tmp_path):
    (tmp_path / "a.fq").write_text("@r\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="differ in length"):
        IN.read_fastq(spark, str(tmp_path / "a.fq")).collect()


@pytest.mark.parametrize("quality, offset", [("hhhh", 64), ("BBBB", -1), ("B5hh", 33)])
def test_quality_offset(spark, quality, offset):
    df = spark.createDataFrame([(0, "BBBB"), (1, quality)], "ordinal long, quality string")
    assert IN.quality_offset(df).first().offset == offset


def test_bad_cluster_names_are_errors(spark, tmp_path):
    (tmp_path / "c.fa").write_text(">cluster___1___size\nACGT\n")
    with pytest.raises(Exception, match="bad cluster name"):
        TAB.read_cluster_fasta(spark, str(tmp_path / "c.fa")).collect()


def test_reports(spark, tmp_path):
    (tmp_path / "r.txt").write_text(
        "Query= cluster___7___size___2\n\nSequences producing significant alignments:\n\nh1 9 1\nh2 8 1\nh3 7 1\nh4 6 1\nh5 5 1\n"
        "Query= cluster___8___size___1\n\nno hits\nQuery= cluster___9___size___1\nSequences producing significant alignments:\nh9 1\n")
    got = sorted((r.cluster_id, r["rank"], r.hit) for r in TAB.read_report_hits(spark, str(tmp_path / "r.txt")).collect())
    assert got == [(7, 1, "h1"), (7, 2, "h2"), (7, 3, "h3"), (7, 4, "h4"), (9, 1, "h9")]
    (tmp_path / "t.txt").write_text("# BLAST\n# Query: q___1\nq___1\ts5\t9\nq___1\ts6\t8\n# Query: q___2\n")
    assert sorted(map(tuple, TAB.read_tabular_hits(spark, str(tmp_path / "t.txt")).collect())) == [("q___1", "s5"), ("q___2", None)]


def test_match_file(spark, tmp_path):
    (tmp_path / "m.txt").write_text("-2 4 5\n\n0 1\n")
    assert sorted(map(tuple, TAB.read_matches(spark, str(tmp_path / "m.txt")).collect())) == [(0, 4, 2), (0, 5, 2), (2, 1, 0)]


def test_reference_tables(spark, tmp_path):
    (tmp_path / "d.tsv").write_text("V1*01\t1\t75\t76\t99\t100\t150\t151\t171\t172\t279\tVH\t0\n")
    row = TAB.read_domains(spark, str(tmp_path / "d.tsv")).first()
    assert (row.allele, row.bounds[1], row.bounds[9], row.chain, row.frame) == ("V1*01", 75, 279, "VH", 0)
    (tmp_path / "j.txt").write_text("# comment\n\nJ1*01        0       JH\n")
    assert tuple(TAB.read_join_frames(spark, str(tmp_path / "j.txt")).first()) == ("J1*01", 0, "JH")
    (tmp_path / "w.txt").write_text("a  b\nc d e\n")
    assert sorted(r.cells for r in TAB.read_whitespace_table(spark, str(tmp_path / "w.txt")).collect()) == [["a", "b"], ["c", "d", "e"]]


def test_graph_dump(spark, tmp_path):
    (tmp_path / "g.grp").write_text("2 1 \nVertex 1 ~ 2 .\nVertex 2 ~ 1 .\n\nEdge 5 : 1 -> 2, l = 10 ~ 6 .\n")
    (tmp_path / "g.cvr").write_text("1\n5 2.500000 .\n")
    v, e = TAB.read_graph(spark, str(tmp_path / "g.grp"), str(tmp_path / "g.cvr"))
    assert sorted(map(tuple, v.collect())) == [(1, 2), (2, 1)]
    assert e.first().asDict() == {"edge_id": 5, "src": 1, "dst": 2, "length": 10, "conj_id": 6, "coverage": 2.5}


def test_settings_and_libraries(spark):
    s = TAB.parse_settings(["; note", "read_length 100 ; bases", "flag true", "name \"x\"", "ks 21 33", "empty", "bad-key 1"])
    assert s == {"read_length": 100, "flag": True, "name": "x", "ks": [21, 33], "empty": None}
    lib = {"type": "paired-end", "orientation": "fr", "left reads": ["a"], "right reads": ["b"], "single reads": ["c"]}
    assert TAB.libraries(spark, [lib]).count() == 3
    for broken in ({**lib, "orientation": "undefined"}, {**lib, "right reads": []}, {"type": "other"}):
        with pytest.raises(ValueError):
            TAB.libraries(spark, [broken])


def test_wrapping_and_contig_names(spark):
    df = spark.createDataFrame([("A" * 120,), ("C" * 61,), ("",)], "seq string")
    assert [r[0] for r in df.select(OUT.wrapped("seq")).collect()] == ["A" * 60 + "\n" + "A" * 60, "C" * 60 + "\nC", ""]
    one = df.select(OUT.contig_name(F.lit(3), F.length("seq"), F.lit(2.5), F.lit(9))).first()[0]
    assert one == "NODE_3_length_120_cov_2.5_ID_9"


def test_read_transforms(spark):
    df = spark.createDataFrame([("x_RC", "ACGTN"), ("y", "NNACN")], "name string, seq string")
    assert [tuple(r) for r in R.subread(df, F.lit(1), F.lit(3)).collect()] == [("x_SUBSTR(2,4)_RC", "CG"), ("y_SUBSTR(1,3)", "NA")]
    assert [r.seq for r in R.trim_unknown(df).collect()] == ["ACGT", "AC"]
    assert [r.seq for r in R.keep_longest_valid(df).collect()] == ["ACGT", "AC"]
    assert [r[0] for r in df.select(S.reverse_complement("seq", keep_n=False)).collect()] == ["AACGT", "AGTAA"]


def test_valid_kmers_after_quality_trim(spark):
    df = spark.createDataFrame([("BACNTACGT", "K" * 8 + "#")], "seq string, quality string")
    runs = R.split_at_invalid(R.trim_unknown_and_bad(df, 2).select("seq"))
    assert [k for r in runs.select(S.kmers("seq", 2).alias("k")).collect() for k in r.k] == ["AC", "TA", "AC", "CG"]


def test_streamed_reads_use_the_same_transforms(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(FASTA)
    both = R.with_reverse_complement(stream_fasta(spark, str(tmp_path / "in")))
    q = both.writeStream.format("memory").queryName("streamed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("streamed").count() == 6


def test_paired_records_meet_without_another_shuffle(spark, tmp_path):
    """lines are dealt by their record number, by which the two files are joined."""
    for side in "lr":
        (tmp_path / f"{side}.fq").write_text("".join(f"@{side}{i}\n{'ACGT' * i}\n+\n{'IIII' * i}\n" for i in range(1, 30)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = IN.read_paired_fastq(spark, str(tmp_path / "l.fq"), str(tmp_path / "r.fq"))
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert plan.count("hashpartitioning(ordinal") == 2 and "hashpartitioning(file" not in plan.replace("file_block", "").split("Window")[0]
        rows = sorted((r.pair, r.name1, r.name2, r.s1, r.q2) for r in pairs.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == [(i - 1, f"l{i}", f"r{i}", "ACGT" * i, "IIII" * i) for i in range(1, 30)]
