"""Contigs: the condensed de Bruijn graph of reads, both strands, with merged sequences.

Each distinct (k+1)-mer of the reads or of their reverse complements is an edge from its
first to its last k bases, so every edge has a conjugate, its reverse complement.  A
contig is a maximal path through vertices with one way in and one way out.  Edges find
the first edge of their path and their place in it by pointer doubling, in as many rounds
as the longest contig has binary digits; no path is gathered before its places are known.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.operators.kmers import kmer_table
from strandframe.session import settled

PIECE = 4096  # bases of a contig put together in one group at first


def strand_edges(reads: DataFrame, k: int) -> DataFrame:
    """``edge, n``: (k+1)-mers of both strands and their occurrences; those with other letters than ACGT are left out."""
    known = kmer_table(reads, k + 1).where(F.translate("kmer", "ACGT", "") == "")
    one = known.groupBy(F.col("kmer").alias("edge")).agg(F.count("*").alias("n"))
    other = one.select(S.reverse_complement("edge").alias("edge"), F.when(F.col("edge") != S.reverse_complement("edge"), F.col("n")).alias("n"))
    return one.unionByName(other.where("n IS NOT NULL")).groupBy("edge").agg(F.sum("n").alias("n"))


def _previous(edges: DataFrame) -> DataFrame:
    """``edge, before``: the edge before it on its path, NULL for the first of a path."""
    ends = edges.select(S.kmer_start("edge").alias("v"), F.col("edge").alias("leaves"), F.lit(None).cast("string").alias("enters")).unionByName(
        edges.select(S.kmer_end("edge").alias("v"), F.lit(None).cast("string").alias("leaves"), F.col("edge").alias("enters")))
    inner = ends.groupBy("v").agg(F.count("leaves").alias("n_out"), F.count("enters").alias("n_in"),
                                  F.min("leaves").alias("edge"), F.min("enters").alias("before")).where("n_out = 1 AND n_in = 1")
    return edges.select("edge").join(inner.select("edge", "before"), "edge", "left")


def _ranked(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places ``edge, head, place`` of edges on open paths, and ``edge, low`` of those on closed ones.

    ``low`` is the smallest of all edges of the closed path and of their conjugates.
    """
    first = F.col("before").isNull()
    state = settled(links.select("edge", F.coalesce("before", "edge").alias("at"), F.when(first, 0).otherwise(1).cast("long").alias("place"),
                                 F.least("edge", S.reverse_complement("edge")).alias("low"), first.alias("done")))
    done, going = [state.where("done")], state.where("NOT done")
    left, ended = going.count(), False
    while left:
        # a round in which no path ends leaves closed ones only: of an open path some edge ends in every round
        jumps = reduce(DataFrame.unionByName, done).unionByName(going).select(
            F.col("edge").alias("at"), F.col("at").alias("_at"), F.col("place").alias("_place"), F.col("low").alias("_low"), F.col("done").alias("_done"))
        moved = settled(going.drop("done").join(jumps, "at").select(
            "edge", F.col("_at").alias("at"), (F.col("place") + F.col("_place")).alias("place"),
            F.least("low", "_low").alias("low"), F.col("_done").alias("done"), (F.col("_low") < F.col("low")).alias("lower")))
        done.append(moved.where("done").drop("lower"))
        going = moved.where("NOT done").drop("lower")
        now = going.count()
        if now == left and moved.where("lower").isEmpty():
            break
        left = now
    return reduce(DataFrame.unionByName, done).select("edge", F.col("at").alias("head"), "place"), going.select("edge", "low")


def placed_edges(edges: DataFrame) -> DataFrame:
    """``edge, head, place``: first edge of the contig of each edge and its place there, from 0.

    A closed path without branches is cut before its smallest edge, if that edge is not greater
    than its conjugate, and after the conjugate of the smallest on the other strand, so that both strands give the same cut.
    """
    links = settled(_previous(edges))
    open_, closed = _ranked(links)
    if closed.isEmpty():
        return open_
    ring = links.join(closed, "edge")
    cut = (F.col("edge") == F.col("low")) | (F.col("before") == S.reverse_complement("low"))
    rest, _ = _ranked(ring.select("edge", F.when(~cut, F.col("before")).alias("before")))
    return open_.unionByName(rest)


def contigs(reads: DataFrame, k: int, flank: int = 10) -> DataFrame:
    """``contig_id, conj_id, src, dst, length, coverage, start_coverage, end_coverage, seq``; ``k`` must be odd.

    A contig is named by its first (k+1)-mer; ``conj_id`` names the contig of the other strand.
    ``length`` counts (k+1)-mers, ``coverage`` is their mean number of occurrences on both strands,
    and the flanking coverages are the means over the first and last ``flank`` of them.  Reads
    below ``k + 1`` bases and NULL reads have no edge.
    """
    if k % 2 == 0:
        raise ValueError("k must be odd: a k-mer of even length can be its own reverse complement")
    edges = settled(strand_edges(reads, k))
    at = placed_edges(edges).join(edges, "edge")
    near = F.when(F.col("place") < flank, F.col("n"))
    base = F.struct("place", F.when(F.col("place") == 0, F.col("edge")).otherwise(F.substring("edge", k + 1, 1)).alias("b"))
    pieces = at.groupBy("head", F.expr(f"place div {PIECE}").alias("part")).agg(
        F.array_join(F.array_sort(F.collect_list(base))["b"], "").alias("text"), F.count("*").alias("parts"), F.sum("n").alias("n"),
        F.sum(near).alias("near"), F.count(near).alias("n_near"), F.max_by("edge", "place").alias("last"))
    whole = settled(pieces.groupBy("head").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("part", "text")))["text"], "").alias("seq"), F.sum("parts").alias("length"),
        F.sum("n").alias("n"), (F.sum("near") / F.sum("n_near")).alias("start_coverage"), F.max_by("last", "part").alias("last")))
    named = whole.select(F.col("head").alias("contig_id"), S.reverse_complement("last").alias("conj_id"), S.kmer_start("head").alias("src"),
                         S.kmer_end("last").alias("dst"), "length", (F.col("n") / F.col("length")).alias("coverage"), "start_coverage", "seq")
    ends = whole.select(F.col("head").alias("conj_id"), F.col("start_coverage").alias("end_coverage"))
    return named.join(ends, "conj_id").select("contig_id", "conj_id", "src", "dst", "length", "coverage", "start_coverage", "end_coverage", "seq")


def one_strand(found: DataFrame) -> DataFrame:
    """One contig of each conjugate pair, that with the smaller id."""
    return found.where("contig_id <= conj_id")
