"""Strongly connected components in rounds over an edge table.

Colouring: every vertex takes the largest id from which it can be reached; the
vertex that gives a colour its name, and all of the colour that reach it, are one
component.  These are found by colouring the reversed edges of each colour.  They
leave, edges between colours leave too, and the rest is coloured anew.  A round
passes colours along edges and from the vertex a colour is named after to all that
bear it, since what reaches that vertex reaches them, so that long ways take few
rounds.  Maxima are combined map-side.

Parts of the graph that hang together by at most ``SMALL`` links need no rounds: each
is solved by a depth-first search in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.parts import solve_parts, split_parts
from strandframe.session import settled

SMALL = 10_000  # links of a part that one task may hold at a time
TRIMS = 3  # rounds that take off edges without a way in or out before each colouring


def _trimmed(links: DataFrame) -> DataFrame:
    """Links that may lie on a cycle: their start can be entered and their end can be left."""
    for _ in range(TRIMS):
        entered = links.select(F.col("dst").alias("src")).distinct()
        left = links.select(F.col("src").alias("dst")).distinct()
        links = settled(links.join(entered, "src", "left_semi").join(left, "dst", "left_semi"))
    return links


def _colours(links: DataFrame) -> DataFrame:
    """``v, colour``: the largest vertex from which each vertex of ``links`` can be reached."""
    known = settled(links.select(F.col("src").alias("v")).union(links.select("dst")).distinct().select("v", F.col("v").alias("colour")))
    none = F.lit(None).cast(dict(links.dtypes)["src"])
    while True:
        told = known.join(links, known["v"] == links["src"]).select(F.col("dst").alias("v"), F.col("colour").alias("c"), none.alias("old"))
        named = known.select(F.col("v").alias("colour"), F.col("colour").alias("c"))
        jumped = known.join(named, "colour").select("v", "c", F.col("colour").alias("old"))
        merged = settled(told.unionByName(jumped).groupBy("v").agg(F.max("c").alias("colour"), F.max("old").alias("old")))
        known = merged.select("v", "colour")
        if merged.where("colour > old").isEmpty():
            return known


def roots_of(arcs: list[tuple]) -> dict:
    """Vertex -> smallest vertex of its strong component, by one depth-first search with low points."""
    out: dict = {}
    for a, b in arcs:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    order, low, open_, root = {}, {}, [], {}
    for start in sorted(out):
        if start in order:
            continue
        order[start] = low[start] = len(order)
        open_.append(start)
        calls = [(start, iter(out[start]))]
        while calls:
            v, rest = calls[-1]
            w = next(rest, None)
            if w is None:
                calls.pop()
                if calls:
                    low[calls[-1][0]] = min(low[calls[-1][0]], low[v])
                if low[v] == order[v]:
                    own = []
                    while not own or own[-1] != v:
                        own.append(open_.pop())
                    root.update(dict.fromkeys(own, min(own)))
            elif w not in order:
                order[w] = low[w] = len(order)
                open_.append(w)
                calls.append((w, iter(out[w])))
            elif w not in root:
                low[v] = min(low[v], order[w])
    return root


def strong_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``v, component``: the smallest vertex of the strongly connected component of each vertex.

    ``vertices`` has ``v``, ``edges`` has ``src, dst`` of the same type.
    """
    kind = dict(edges.dtypes)["src"]
    rows, links = split_parts(edges.where("src <> dst").select("src", "dst"), SMALL)
    small = settled(solve_parts(rows, lambda arcs: list(roots_of(arcs).items()), f"v {kind}, component {kind}"))
    if links is not None:  # without edges that lie on no cycle, much may fall apart
        rows, links = split_parts(_trimmed(links.distinct()), SMALL)
        small = small.unionByName(settled(solve_parts(rows, lambda arcs: list(roots_of(arcs).items()), f"v {kind}, component {kind}")))
    parts = None
    while links is not None and not links.isEmpty():
        colours = _colours(links)
        inside = (links.join(colours.select(F.col("v").alias("src"), "colour"), "src")
                  .join(colours.select(F.col("v").alias("dst"), F.col("colour").alias("_to")), "dst").where("colour = _to")
                  .select("src", "dst", "colour"))
        inside = settled(inside)
        # the vertex a colour is named after is the largest of the colour: members are those that reach no larger one but it
        reach = _colours(settled(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
        own = settled(reach.join(colours.withColumnRenamed("colour", "root"), "v").where("colour = root").select("v", "root"))
        parts = own if parts is None else parts.unionByName(own)
        gone = own.select("v")
        links = _trimmed(inside.select("src", "dst").join(gone.withColumnRenamed("v", "src"), "src", "left_anti")
                         .join(gone.withColumnRenamed("v", "dst"), "dst", "left_anti"))
    named = small
    if parts is not None:
        named = named.unionByName(parts.join(parts.groupBy("root").agg(F.min("v").alias("component")), "root").select("v", "component"))
    return vertices.select("v").distinct().join(named, "v", "left").select("v", F.coalesce("component", "v").alias("component"))
