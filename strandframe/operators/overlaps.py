"""Exact end overlaps of sequences on both strands, and clusters of overlapping reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import alignment as A
from strandframe.functions import sequences as S
from strandframe.operators.components import components
from strandframe.operators.kmers import sought_kmers
from strandframe.operators.similarity import sequence_sets
from strandframe.session import settled


def exact_overlaps(seqs: DataFrame, min_overlap: int = 200) -> DataFrame:
    """``id1, id2, reverse, start1, start2, overlap`` for ``id1 < id2``.

    ``seqs`` holds distinct ``seq_id, seq``.  Two sequences overlap when they agree
    from the start of one of them to the end of one of them over at least
    ``min_overlap`` bases.  The seed is the whole minimum overlap at such a start, so
    only true repeats of that length meet; every candidate is then compared in
    full.  The direct strand goes first, then the smallest ``start1 - start2``.
    """
    long_enough = settled(seqs.where(F.length("seq") >= min_overlap))  # used for windows, ends and both sides of the comparison
    head = S.piece("seq", 0, min_overlap)
    tail = S.piece("seq", F.length("seq") - min_overlap, min_overlap)
    # how the end of y is looked for in x: its head, the head of its reverse, its head reversed
    ends = long_enough.select(F.col("seq_id").alias("y"), F.length("seq").alias("ny"), F.explode(F.array(
        F.struct(F.lit(0).alias("how"), head.alias("kmer")),
        F.struct(F.lit(1).alias("how"), S.reverse_complement(tail).alias("kmer")),
        F.struct(F.lit(2).alias("how"), S.reverse_complement(head).alias("kmer")))).alias("e")).select("y", "ny", "e.how", "e.kmer")
    windows = sought_kmers(long_enough.withColumn("nx", F.length("seq")), min_overlap, ["seq_id", "nx"], ends).select(
        F.col("seq_id").alias("x"), "nx", F.col("pos").alias("p"), "key")
    met = windows.join(ends.withColumn("key", F.xxhash64("kmer")).drop("kmer"), "key").where("x <> y")
    x_first, p, nx, ny, how = F.col("x") < F.col("y"), F.col("p"), F.col("nx"), F.col("ny"), F.col("how")
    b = nx - min_overlap - p
    n = F.when(how == 2, F.least(ny, nx - b)).otherwise(F.least(nx - p, ny))
    zero = F.lit(0)
    start1 = (F.when((how == 0) & x_first, p).when(how == 0, zero).when((how == 1) & x_first, p).when(how == 1, ny - n)
              .when(x_first, nx - b - n).otherwise(zero))
    start2 = (F.when((how == 0) & x_first, zero).when(how == 0, p).when((how == 1) & x_first, zero).when(how == 1, nx - p - n)
              .when(x_first, ny - n).otherwise(b))
    placed = met.select(F.least("x", "y").alias("id1"), F.greatest("x", "y").alias("id2"), (how > 0).alias("reverse"),
                        start1.alias("start1"), start2.alias("start2"), n.alias("overlap")).where(
        F.col("overlap") >= min_overlap).distinct()
    one = long_enough.select(F.col("seq_id").alias("id1"), F.col("seq").alias("_s1"))
    two = long_enough.select(F.col("seq_id").alias("id2"), F.col("seq").alias("_s2"))
    # repeats give many places of one pair, for which its sequences travel once
    ways = placed.groupBy("id1", "id2").agg(F.array_sort(F.collect_list(F.struct(
        "reverse", (F.col("start1") - F.col("start2")).alias("d"), "start1", "start2", "overlap"))).alias("c"))
    at = A.first_equal("_s1", "_s2", F.col("c.reverse"), F.col("c.start1"), F.col("c.start2"), F.col("c.overlap"))
    true_ones = ways.join(one, "id1").join(two, "id2").select("id1", "id2", "c", at.alias("_at")).where("_at IS NOT NULL")
    return true_ones.groupBy("id1", "id2").agg(F.min(F.get("c", F.col("_at"))).alias("o")).select(
        "id1", "id2", "o.reverse", "o.start1", "o.start2", "o.overlap")


def overlap_superstrings(overlaps: DataFrame, seqs: DataFrame) -> DataFrame:
    """``id1, id2, merged``: union of both sequences of each overlap."""
    one = seqs.select(F.col("seq_id").alias("id1"), F.col("seq").alias("_s1"))
    two = seqs.select(F.col("seq_id").alias("id2"), F.col("seq").alias("_s2"))
    other = F.when(F.col("reverse"), S.reverse_complement("_s2")).otherwise(F.col("_s2"))
    return overlaps.join(one, "id1").join(two, "id2").select(
        "id1", "id2", S.superstring("_s1", F.col("start1"), other, F.col("start2")).alias("merged"))


def cluster_overlaps(reads: DataFrame, min_overlap: int = 200) -> DataFrame:
    """``read_id, cluster_id``: reads linked by exact overlaps, over any number of steps.

    The distinct sequences are written once; reads reach theirs over its digest.
    """
    seqs = settled(sequence_sets(reads).withColumn("digest", F.sha2("seq", 256)))
    links = exact_overlaps(seqs, min_overlap)
    found = components(seqs.select(F.col("seq_id").alias("id")), links.select(F.col("id1").alias("src"), F.col("id2").alias("dst")))
    named = seqs.select("seq_id", "digest").join(found.select(F.col("id").alias("seq_id"), F.col("component").alias("cluster_id")), "seq_id")
    return reads.select("read_id", F.sha2("seq", 256).alias("digest")).join(named.select("digest", "cluster_id"), "digest").select("read_id", "cluster_id")


def longest_members(reads: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cluster_id, size, seq``: cluster sizes with the longest member as sequence."""
    return reads.join(clusters, "read_id").groupBy("cluster_id").agg(
        F.count("*").alias("size"), F.max_by("seq", F.struct(F.length("seq"), -F.col("read_id"))).alias("seq"))
