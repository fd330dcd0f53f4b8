"""Loops: parts of the graph with one way in and one way out, and self-loops on a path.

What hangs together by at most ``SMALL`` edges needs no rounds: it is searched by a
plain function in one task.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.operators.components import components, smallest_joined
from strandframe.operators.graph import compress_paths, resolvable_loops, used_vertices
from strandframe.operators.parts import solve_parts, split_parts
from strandframe.session import settled

SMALL = 10_000  # edges of a part that one task may hold at a time


def through_parts(edges: DataFrame, splitting_length: int, max_vertices: int) -> tuple[DataFrame, DataFrame]:
    """``part, start, finish`` of parts entered and left by one edge each, and their inner edges with ``part``.

    Parts hang together by edges shorter than ``splitting_length`` and have at most ``max_vertices``.
    """
    part = settled(components(used_vertices(edges).withColumnRenamed("v", "id"), edges.where(F.col("length") < splitting_length)))
    both = settled(edges.join(part.select(F.col("id").alias("src"), F.col("component").alias("part")), "src")
                       .join(part.select(F.col("id").alias("dst"), F.col("component").alias("_to")), "dst"))
    sizes = part.groupBy(F.col("component").alias("part")).agg(F.count("*").alias("n")).where(F.col("n") <= max_vertices).select("part")
    across = both.where("part <> _to")
    into = across.groupBy(F.col("_to").alias("part")).agg(F.min("dst").alias("start"), F.count("*").alias("n")).where("n = 1").drop("n")
    out = across.groupBy("part").agg(F.min("src").alias("finish"), F.count("*").alias("n")).where("n = 1").drop("n")
    parts = settled(sizes.join(into, "part").join(out, "part"))
    return parts, both.where("part = _to").drop("_to").join(parts.select("part"), "part", "left_semi")


def shortest_ways(parts: DataFrame, inner: DataFrame) -> DataFrame:
    """``part, edge_id`` of one way with the fewest edges from start to finish of each part that has one.

    Among equal ways each vertex is entered by its smallest edge.
    """
    known = settled(parts.select(F.col("start").alias("v"), F.lit(None).cast(dict(inner.dtypes)["edge_id"]).alias("via"),
                                     F.lit(None).cast(dict(inner.dtypes)["src"]).alias("before")))
    fresh = known
    while True:
        reached = fresh.select(F.col("v").alias("src")).join(inner, "src").groupBy(F.col("dst").alias("v")).agg(
            F.min(F.struct("edge_id", "src")).alias("_b")).select("v", F.col("_b.edge_id").alias("via"), F.col("_b.src").alias("before"))
        fresh = settled(reached.join(known, "v", "left_anti"))
        if fresh.isEmpty():
            break
        known = settled(known.unionByName(fresh))
    at = settled(parts.select("part", F.col("finish").alias("v")).join(known, "v"))
    way = at.select("part", F.col("via").alias("edge_id"))
    while True:
        at = settled(at.where("before IS NOT NULL").select("part", F.col("before").alias("v")).join(known, "v"))
        if at.isEmpty():
            return way.where("edge_id IS NOT NULL")
        way = way.unionByName(at.select("part", F.col("via").alias("edge_id")))


def fewest_edges(inner: list[tuple], start, finish) -> list | None:
    """Edges of the way that ``shortest_ways`` takes through ``edge_id, src, dst`` rows, None if there is none."""
    out: dict = {}
    for e, s, d in inner:
        out.setdefault(s, []).append((e is not None, e, s, d))
    via, level = {start: None}, [start]
    while level and finish not in via:
        fresh: dict = {}
        for v in level:
            for row in out.get(v, ()):
                if row[3] not in via and (row[3] not in fresh or row < fresh[row[3]]):
                    fresh[row[3]] = row
        via.update(fresh)
        level = list(fresh)
    if finish not in via:
        return None
    way, v = [], finish
    while via[v]:
        way.append(via[v][1])
        v = via[v][2]
    return way


def loops_in_part(edges: list[tuple], splitting_length: int, max_vertices: int, longest: int, total: int) -> list[tuple]:
    """``loop_edges`` of a whole graph of ``edge_id, src, dst, length``."""
    of = {v: v for e in edges for v in e[1:3] if v is not None}
    edges = [e for e in edges if e[1] is not None and e[2] is not None]
    of.update(smallest_joined((s, d) for _, s, d, n in edges if n is not None and n < splitting_length))
    count, into, out, inner = Counter(of.values()), {}, {}, {}
    for e, s, d, n in edges:
        if of[s] != of[d]:
            into.setdefault(of[d], []).append(d)
            out.setdefault(of[s], []).append(s)
        else:
            inner.setdefault(of[s], []).append((e, s, d, n))
    beside, on_way = [], set()
    for part, own in inner.items():
        if count[part] <= max_vertices and len(into.get(part, ())) == 1 and len(out.get(part, ())) == 1:
            way = fewest_edges([e[:3] for e in own], into[part][0], out[part][0])
            if way is not None:
                on_way.update(way)
                beside.append(own)
    found = []
    for own in beside:
        extra = [e for e in own if e[0] not in on_way]
        lengths = [e[3] for e in extra if e[3] is not None]
        if lengths and max(lengths) <= longest and sum(lengths) <= total:
            found += [(e[0],) for e in extra]
    return found


def loop_edges(edges: DataFrame, splitting_length: int, max_vertices: int, longest: int = 500, total: int = 3000) -> DataFrame:
    """``edge_id`` of inner edges beside the way through a part, where none of them exceeds ``longest`` nor all ``total``.

    Where start and finish are one vertex all inner edges are beside the way.
    """
    rows, large = split_parts(edges.select("edge_id", "src", "dst", "length"), SMALL)
    small = solve_parts(rows, lambda own: loops_in_part(own, splitting_length, max_vertices, longest, total),
                        f"edge_id {dict(edges.dtypes)['edge_id']}")
    return small if large is None else small.unionByName(_loops_in_rounds(large, splitting_length, max_vertices, longest, total))


def _loops_in_rounds(edges: DataFrame, splitting_length: int, max_vertices: int, longest: int, total: int) -> DataFrame:
    """The same for parts of any size."""
    parts, inner = through_parts(edges, splitting_length, max_vertices)
    inner = settled(inner)
    way = settled(shortest_ways(parts, inner))
    passable = parts.where("start = finish").select("part").unionByName(way.select("part")).distinct()
    extra = inner.join(passable, "part", "left_semi").join(way.select("edge_id"), "edge_id", "left_anti")
    small = extra.groupBy("part").agg(F.max("length").alias("m"), F.sum("length").alias("s")).where((F.col("m") <= longest) & (F.col("s") <= total))
    return extra.join(small.select("part"), "part", "left_semi").select("edge_id")


def remove_loops(edges: DataFrame, splitting_length: int, max_vertices: int, longest: int = 500, total: int = 3000) -> DataFrame:
    """The graph without ``loop_edges``, paths merged."""
    return compress_paths(edges.join(loop_edges(edges, splitting_length, max_vertices, longest, total), "edge_id", "left_anti"))


def resolve_loops(edges: DataFrame, variation: float, new_vertex: Column | None = None) -> DataFrame:
    """Self-loops that fit the coverage of their path are gone through once: in, loop, out.

    The loop leads to a new vertex (``new_vertex``, by default the name of the old one with a ``+``), where the edge out begins.
    """
    found = resolvable_loops(edges, variation)
    new = (F.concat(F.col("_at"), F.lit("+")) if new_vertex is None else new_vertex).alias("_new")
    loops = found.select("edge_id", F.col("v").alias("_at"), F.lit(True).alias("_loop"))
    after = found.select(F.col("after_id").alias("edge_id"), F.col("v").alias("_at"), F.lit(False).alias("_loop"))
    moved = edges.join(loops.unionByName(after).select("edge_id", "_loop", new), "edge_id", "left")
    return moved.withColumn("src", F.when(F.col("_loop") == F.lit(False), F.col("_new")).otherwise(F.col("src"))).withColumn(
        "dst", F.when(F.col("_loop"), F.col("_new")).otherwise(F.col("dst"))).select(*edges.columns)
