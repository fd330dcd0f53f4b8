"""Spanning forests and their division into connected parts of a wanted size.

Everything takes a number of rounds that grows with the logarithm of the graph:
Boruvka's rounds for the forest, pointer doubling along Euler tours for the subtree
sizes, pointer doubling over parents for the parts.  A tour passes from neighbour to
neighbour of a vertex in order of their ids, found over key ranges, so a hub is
spread over several tasks.

Parts of the graph that hang together by at most ``SMALL`` edges need no rounds: each
is divided by a plain function in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.operators.components import components
from strandframe.operators.ordering import keyed_previous, keyed_ranges
from strandframe.operators.parts import solve_parts, split_parts
from strandframe.session import settled

SMALL = 10_000  # edges of a part that one task may hold at a time


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tree edges ``a, b`` (``a < b``) and ``v, tree``, the smallest vertex of each vertex' tree.

    Every tree takes its smallest edge to another one in each round; edges are ordered by their ends, so no cycle can close.
    """
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    labels = settled(vertices.select("v", F.col("v").alias("tree")).distinct())
    cross = settled(pairs.select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb")))
    forest = settled(cross.select("a", "b").limit(0))
    while not cross.isEmpty():
        ends = cross.select("a", "b", "la", "lb", F.col("la").alias("own")).unionByName(cross.select("a", "b", "la", "lb", F.col("lb").alias("own")))
        chosen = settled(ends.groupBy("own").agg(F.min(F.struct("a", "b", "la", "lb")).alias("e")).select("e.*").distinct())
        forest = settled(forest.unionByName(chosen.select("a", "b")))
        old = chosen.select(F.explode(F.array("la", "lb")).alias("id")).distinct()
        renamed = settled(components(old, chosen.select(F.col("la").alias("src"), F.col("lb").alias("dst"))))
        labels = settled(labels.join(renamed.withColumnRenamed("id", "tree"), "tree", "left").select(
            "v", F.coalesce("component", "tree").alias("tree")))
        for end in ("la", "lb"):
            cross = cross.join(renamed.select(F.col("id").alias(end), F.col("component").alias("_c")), end, "left").withColumn(
                end, F.coalesce("_c", end)).drop("_c")
        left = cross.where("la <> lb").select("a", "b", F.least("la", "lb").alias("la"), F.greatest("la", "lb").alias("lb"))
        # of the edges between two trees only the smallest can be taken later
        cross = settled(left.groupBy("la", "lb").agg(F.min(F.struct("a", "b")).alias("e")).select("e.a", "e.b", "la", "lb"))
    return forest, labels


def rooted(forest: DataFrame, labels: DataFrame) -> DataFrame:
    """``v, parent, size``: the parent (NULL at the root, the smallest vertex) and the vertices of the subtree of each vertex."""
    arcs = settled(forest.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(forest.select(F.col("b").alias("x"), F.col("a").alias("y"))))
    last = arcs.groupBy("x").agg(F.max("y").alias("_last"))
    turned = keyed_previous(keyed_ranges(arcs, ["x"], ["y"]), ["x"], ["y"], "y", "_prev").select("x", "y", "_prev").join(last, "x")
    # having come from _prev (from the last neighbour before the first), the tour goes on from x to y
    follows = turned.select(F.coalesce("_prev", "_last").alias("x"), F.col("x").alias("y"), F.col("x").alias("nx"), F.col("y").alias("ny"),
                            F.col("_prev").isNull().alias("_round"))
    roots = labels.where("v = tree").select(F.col("v").alias("y"), F.lit(True).alias("_root"))
    ended = follows.join(roots, "y", "left").withColumn("_end", F.col("_round") & F.col("_root").isNotNull())
    tour = settled(ended.select("x", "y", F.when(~F.col("_end"), F.col("nx")).alias("nx"), F.when(~F.col("_end"), F.col("ny")).alias("ny"),
                                    F.when(F.col("_end"), 0).otherwise(1).cast("long").alias("rest")))
    while not tour.where("nx IS NOT NULL").isEmpty():
        ahead = tour.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("nx").alias("_nx"), F.col("ny").alias("_ny"), F.col("rest").alias("_rest"))
        tour = settled(tour.join(ahead, ["nx", "ny"], "left").select(
            "x", "y", F.col("_nx").alias("nx"), F.col("_ny").alias("ny"), (F.col("rest") + F.coalesce("_rest", F.lit(0))).alias("rest")))
    back = tour.select(F.col("x").alias("y"), F.col("y").alias("x"), F.col("rest").alias("_back"))
    down = tour.join(back, ["x", "y"]).where("rest > _back").select(
        F.col("y").alias("v"), F.col("x").alias("parent"), F.expr("(rest - _back + 1) div 2").alias("size"))
    whole = labels.groupBy("tree").agg(F.count("*").alias("_n"))
    return labels.join(down, "v", "left").join(whole, "tree").select("v", "parent", F.coalesce("size", "_n").alias("size"))


def divided(pairs: list[tuple], size: int) -> dict:
    """Vertex -> part, as ``forest_parts`` has it, of a connected graph."""
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    near: dict = {}
    for a, b in sorted({(min(p), max(p)) for p in pairs if p[0] != p[1]}):  # with ordered edges there is one smallest forest
        near.setdefault(a, [])
        near.setdefault(b, [])
        ra, rb = top(up.setdefault(a, a)), top(up.setdefault(b, b))
        if ra != rb:
            up[ra] = rb
            near[a].append(b)
            near[b].append(a)
    if not near:
        return {}
    root = min(near)
    parent, order = {root: None}, [root]
    for v in order:
        for w in near[v]:
            if w not in parent:
                parent[w] = v
                order.append(w)
    count, below, part = dict.fromkeys(order, 1), dict.fromkeys(order, 0), {}
    for v in reversed(order[1:]):
        count[parent[v]] += count[v]
        below[parent[v]] += count[v] // size
    for v in order:
        part[v] = v if v == root or count[v] // size > below[v] else part[parent[v]]
    return part


def forest_parts(vertices: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """``v, part``: connected parts of about ``size`` vertices, named by their topmost vertex in the tree.

    A vertex heads a part if its subtree holds more multiples of ``size`` than those of its children together, or if it
    is a root.  So there are at most ``n / size`` parts beside those of the roots, every vertex is in one of them, each
    is connected by tree edges, and a part has at most ``1 + c * (size - 1)`` vertices, ``c`` being the children of its head.
    """
    kind = dict(edges.dtypes)["src"]
    vertices = vertices.select("v").where("v IS NOT NULL").distinct()
    rows, large = split_parts(edges.where("src <> dst").select("src", "dst"), SMALL)
    small = settled(solve_parts(rows, lambda pairs: list(divided(pairs, size).items()), f"v {kind}, part {kind}"))
    if large is None:
        return vertices.join(small, "v", "left").select("v", F.coalesce("part", "v").alias("part"))
    rest = settled(vertices.join(small, "v", "left_anti"))
    return _parts_in_rounds(rest, large, size).unionByName(vertices.join(small, "v").select("v", "part"))


def _parts_in_rounds(vertices: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """The same for parts of any size."""
    forest, labels = spanning_forest(vertices, edges)
    trees = settled(rooted(forest, labels).withColumn("k", F.expr(f"size div {size}")))
    below = trees.where("parent IS NOT NULL").groupBy(F.col("parent").alias("v")).agg(F.sum("k").alias("_below"))
    up = settled(trees.join(below, "v", "left").select("v", F.when(F.col("parent").isNull() | (F.col("k") > F.coalesce("_below", F.lit(0))), F.col("v"))
                                                           .otherwise(F.col("parent")).alias("part")))
    while True:
        ahead = up.select(F.col("v").alias("part"), F.col("part").alias("_next"))
        merged = settled(up.join(ahead, "part").select("v", F.col("_next").alias("part"), (F.col("_next") != F.col("part")).alias("_moved")))
        up = merged.select("v", "part")
        if merged.where("_moved").isEmpty():
            return up
