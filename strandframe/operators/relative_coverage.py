"""Removal of parts whose coverage is low beside that of their surroundings.

Every edge that leaves a vertex with much better covered ways in and out is a seed.
Its part grows in rounds: a border vertex where better covered edges both come in
and go out ends the part, any other one becomes inner and brings all its edges.  All
seeds grow in one table, all border vertices of a round are judged together, and a
part that outgrows its limits leaves the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.graph import compress_paths, degrees
from strandframe.session import settled


def _incident(edges: DataFrame) -> DataFrame:
    """``v, edge_id, way, other, length, coverage``; a self-loop both goes out and comes in."""
    rest = ["edge_id", "length", "coverage"]
    return edges.select(F.col("src").alias("v"), F.lit("out").alias("way"), F.col("dst").alias("other"), *rest).unionByName(
        edges.select(F.col("dst").alias("v"), F.lit("in").alias("way"), F.col("src").alias("other"), *rest))


def coverage_seeds(edges: DataFrame, gap: float) -> DataFrame:
    """``edge_id`` whose start has ways in and out that are covered more than ``gap`` times as well."""
    out = edges.groupBy(F.col("src").alias("v")).agg(F.max("coverage").alias("_out"))
    into = edges.groupBy(F.col("dst").alias("v")).agg(F.max("coverage").alias("_in"))
    best = out.join(into, "v").withColumnRenamed("v", "src")
    return edges.join(best, "src").where((F.col("_out") > gap * F.col("coverage")) & (F.col("_in") > gap * F.col("coverage"))).select("edge_id")


def grown_parts(edges: DataFrame, gap: float, max_inner: int) -> tuple[DataFrame, DataFrame]:
    """``seed, edge_id`` and ``seed, v, inner`` of the parts that end everywhere within ``max_inner`` inner vertices."""
    around = settled(_incident(edges))
    seeds = settled(edges.join(coverage_seeds(edges, gap), "edge_id", "left_semi"))
    own = settled(seeds.select(F.col("edge_id").alias("seed"), "edge_id"))
    border = settled(seeds.select(F.col("edge_id").alias("seed"), F.explode(F.array("src", "dst")).alias("v")).distinct())
    state = settled(border.select("seed", "v", F.lit(False).alias("inner")).limit(0))
    while not border.isEmpty():
        marked = border.join(around, "v").join(own.withColumn("_own", F.lit(True)), ["seed", "edge_id"], "left")
        outside = lambda way: F.max(F.when(F.col("_own").isNull() & (F.col("way") == way), F.col("coverage")))
        judged = marked.groupBy("seed", "v").agg(F.max(F.when(F.col("_own"), F.col("coverage"))).alias("base"), outside("out").alias("o"), outside("in").alias("i"))
        judged = judged.select("seed", "v", F.coalesce((F.col("o") > gap * F.col("base")) & (F.col("i") > gap * F.col("base")), F.lit(False)).alias("ends"))
        judged = settled(judged.join(state.select("seed", "v", F.lit(True).alias("_ended")), ["seed", "v"], "left"))
        turned = judged.where("NOT ends AND _ended").select("seed")  # an end that is none any more: the part fails
        state = state.unionByName(judged.where("_ended IS NULL").select("seed", "v", (~F.col("ends")).alias("inner")))
        grown = state.where("inner").groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > max_inner).select("seed")
        failed = settled(turned.unionByName(grown).distinct())
        state = settled(state.join(failed, "seed", "left_anti"))
        opened = judged.where("NOT ends AND _ended IS NULL").select("seed", "v").join(failed, "seed", "left_anti")
        brought = settled(opened.join(around, "v").select("seed", "edge_id", "other").join(own, ["seed", "edge_id"], "left_anti").distinct())
        own = settled(own.join(failed, "seed", "left_anti").unionByName(brought.select("seed", "edge_id").distinct()))
        inner = state.where("inner").select("seed", F.col("v").alias("other"))
        border = settled(brought.select("seed", "other").distinct().join(inner, ["seed", "other"], "left_anti").withColumnRenamed("other", "v"))
    return own, state


def longest_ways(own: DataFrame, ends: DataFrame, edges: DataFrame) -> DataFrame:
    """``seed, longest``: the longest way between ends of each part; NULL where there is none or a cycle lies on the way."""
    steps = settled(own.join(edges.select("edge_id", "src", "dst", "length"), "edge_id").select("seed", "src", "dst", "length"))
    limits = steps.select("seed", F.explode(F.array("src", "dst")).alias("v")).distinct().groupBy("seed").agg(F.count("*").alias("limit"))
    ends = settled(ends.select("seed", "v"))
    known = settled(ends.select("seed", "v", F.lit(0).cast("long").alias("far")))
    fresh, cyclic, turn = known, settled(known.select("seed").limit(0)), 0
    while True:
        turn += 1
        told = fresh.withColumnRenamed("v", "src").join(steps, ["seed", "src"]).groupBy("seed", F.col("dst").alias("v")).agg(
            F.max(F.col("far") + F.col("length")).alias("far"))
        fresh = settled(told.join(known.withColumnRenamed("far", "_old"), ["seed", "v"], "left").where("_old IS NULL OR far > _old").drop("_old"))
        if fresh.isEmpty():
            break
        # a way of more edges than the part has vertices goes round
        round_ = settled(fresh.select("seed").distinct().join(limits.where(F.col("limit") <= turn), "seed", "left_semi"))
        cyclic = cyclic.unionByName(round_)
        fresh = fresh.join(round_, "seed", "left_anti")
        known = settled(known.unionByName(fresh).groupBy("seed", "v").agg(F.max("far").alias("far")))
    best = known.join(ends, ["seed", "v"], "left_semi").groupBy("seed").agg(F.max("far").alias("longest")).where("longest > 0")
    return best.join(cyclic.distinct(), "seed", "left_anti")


def low_coverage_parts(edges: DataFrame, gap: float, max_length: int, max_length_with_tips: int, max_way: int,
                       max_coverage: float = float("inf"), max_inner: int = 10) -> DataFrame:
    """``seed, edge_id`` of the parts to remove.

    A part of all edges at most ``max_coverage`` covered goes if its edges together have at most ``max_length`` bases
    (``max_length_with_tips`` where an inner vertex has no way in or out) and its longest way, if any, is below ``max_way``.
    """
    if gap <= 1 or max_length_with_tips < max_length:
        raise ValueError("gap > 1 and max_length_with_tips >= max_length must hold")
    own, state = grown_parts(edges, gap, max_inner)
    total = own.join(edges.select("edge_id", "length", "coverage"), "edge_id").groupBy("seed").agg(
        F.sum("length").alias("total"), F.max("coverage").alias("most"))
    dead = state.where("inner").join(degrees(edges).where("n_in = 0 OR n_out = 0"), "v").select("seed").distinct().withColumn("dead", F.lit(True))
    ways = longest_ways(own, state.where("NOT inner"), edges)
    fits = total.join(dead, "seed", "left").join(ways, "seed", "left").where(
        (F.col("most") <= max_coverage) & (F.col("total") <= F.when(F.col("dead"), max_length_with_tips).otherwise(max_length))
        & (F.col("longest").isNull() | (F.col("longest") < max_way)))
    return own.join(fits.select("seed"), "seed", "left_semi").select("seed", "edge_id")


def remove_low_coverage_parts(edges: DataFrame, *limits, **named) -> DataFrame:
    """The graph without ``low_coverage_parts``, paths merged."""
    gone = low_coverage_parts(edges, *limits, **named).select("edge_id").distinct()
    return compress_paths(edges.join(gone, "edge_id", "left_anti"))
