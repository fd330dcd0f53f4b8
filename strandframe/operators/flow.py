"""Maximum flow in synchronous rounds, and the edges that no complete flow needs.

All networks are solved at once: vertices belong to one network each.  A vertex has
``excess`` (what its source brings) and ``room`` (what its sink still takes); arcs
carry what is left of their capacity, in both directions.  A phase finds the
distance of every vertex to the nearest room along arcs with capacity left, then
lets all excess go down these distances, one level in each pulse.  Phases end when
no excess reaches room: what has arrived then is the maximum, since the vertices
that excess still reaches form a saturated cut.

Parts of the graph that hang together by at most ``SMALL`` edges need no rounds, nor do
parts of at most ``SMALL`` arcs and units in larger ones: each is solved by shortest
augmenting paths in one task.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.components import components, smallest_joined
from strandframe.operators.graph import compress_paths, used_vertices, with_degrees
from strandframe.operators.parts import solve_parts, split_parts
from strandframe.operators.strong import roots_of, strong_components
from strandframe.session import settled

INNER_CAPACITY = 10_000
SMALL = 10_000  # rows of a part that one task may hold


def _distances(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """``v, d, pot``: fewest arcs with capacity left from ``v`` to a vertex with room, and an upper bound of the room that way."""
    usable = arcs.where("res > 0")
    known = settled(nodes.where("room > 0").select("v", F.lit(0).alias("d"), F.col("room").alias("pot")))
    fresh, d = known, 0
    while True:
        d += 1
        back = usable.join(fresh.select("v", "pot"), "v").groupBy(F.col("u").alias("v")).agg(F.sum(F.least("res", "pot")).alias("pot"))
        fresh = settled(back.join(known.select("v"), "v", "left_anti").select("v", F.lit(d).alias("d"), "pot"))
        if fresh.isEmpty():
            return known
        known = settled(known.unionByName(fresh))


def _pulse(nodes: DataFrame, arcs: DataFrame, dist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All excess goes one level down, as far as the arcs and the room behind them let it, then into room."""
    active = nodes.where("excess > 0").join(dist.select("v", F.col("d").alias("du")), "v").where("du > 0").select(F.col("v").alias("u"), "excess", "du")
    down = (arcs.where("res > 0").join(active, "u").join(dist, "v").where("d = du - 1").withColumn("most", F.least("res", "pot"))
            .withColumn("before", F.coalesce(F.sum("most").over(Window.partitionBy("u").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    moved = settled(down.select("u", "v", F.least("most", F.greatest(F.col("excess") - F.col("before"), F.lit(0))).alias("f")).where("f > 0"))
    change = moved.select("u", "v", (-F.col("f")).alias("res")).unionByName(moved.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("f").alias("res")))
    arcs = settled(arcs.unionByName(change).groupBy("u", "v").agg(F.sum("res").alias("res")))
    at = moved.select("v", "f").unionByName(moved.select(F.col("u").alias("v"), (-F.col("f")).alias("f"))).groupBy("v").agg(F.sum("f").alias("f"))
    return _absorbed(nodes.join(at, "v", "left").withColumn("excess", F.col("excess") + F.coalesce("f", F.lit(0))).drop("f")), arcs


def _absorbed(nodes: DataFrame) -> DataFrame:
    taken = F.least("excess", "room")
    return settled(nodes.select("v", (F.col("excess") - taken).alias("excess"), (F.col("room") - taken).alias("room")))


def maximum_flow(nodes: DataFrame, arcs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``nodes`` (``v, excess, room``) and ``arcs`` (``u, v, res``, each with its reverse) after a maximum flow.

    Excess that is left cannot reach room.  Where none is left, the arcs are the residual network of the flow.
    """
    forward = arcs.where("u <> v").select("u", "v", "res")
    both = forward.unionByName(forward.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).cast("long").alias("res")))
    arcs = settled(both.groupBy("u", "v").agg(F.sum("res").alias("res")))
    nodes = _absorbed(nodes)
    while True:
        dist = _distances(nodes, arcs)
        deepest = nodes.where("excess > 0").join(dist, "v").agg(F.max("d")).first()[0]
        if not deepest:
            return nodes, arcs
        for _ in range(deepest):
            nodes, arcs = _pulse(nodes, arcs, dist)


def residual_components(arcs: list[tuple]) -> dict:
    """Vertex -> strong component of the residual network, nothing where not every unit passes.

    ``arcs``: ``(u, v)`` between vertices, ``(None, v)`` a unit that comes in at ``v``, ``(u, None)`` one that leaves at ``u``.
    """
    if sum(u is None for u, _ in arcs) != sum(v is None for _, v in arcs):
        return {}
    left: dict = {}
    for u, v in arcs:
        if u != v:
            a, b = ("source",) if u is None else u, ("sink",) if v is None else v
            left.setdefault(a, {})[b] = left.setdefault(a, {}).get(b, 0) + (1 if u is None or v is None else INNER_CAPACITY)
            left.setdefault(b, {}).setdefault(a, 0)
    while True:
        came, level = {("source",): None}, [("source",)]
        while level and ("sink",) not in came:
            ahead = []
            for x in level:
                for y, c in left.get(x, {}).items():
                    if c > 0 and y not in came:
                        came[y] = x
                        ahead.append(y)
            level = ahead
        if ("sink",) not in came:
            break
        y = ("sink",)
        while came[y] is not None:  # units come and leave one by one
            left[came[y]][y] -= 1
            left[y][came[y]] += 1
            y = came[y]
    if any(left.get(("source",), {}).values()) or any(out.get(("sink",), 0) for out in left.values()):
        return {}
    ends = {("source",), ("sink",)}
    return roots_of([(x, y) for x, out in left.items() for y, c in out.items() if c > 0 and x not in ends and y not in ends] +
                    [(x, x) for x in left if x not in ends] + [(u, u) for u, v in arcs if u == v])


def _small_parts(rows: DataFrame) -> DataFrame:
    """``v, component`` of the parts of ``part, u, v`` through which all units pass."""
    kind = dict(rows.dtypes)["v"]

    def solve(own: pd.DataFrame) -> pd.DataFrame:
        # through objects: missing ends must not turn whole numbers into floats
        plain = lambda c: [None if pd.isna(x) else x for x in own[c].tolist()]
        pairs = list(zip(plain("u"), plain("v")))
        if kind in ("bigint", "int"):
            pairs = [tuple(None if x is None else int(x) for x in p) for p in pairs]
        return pd.DataFrame(list(residual_components(pairs).items()), columns=["v", "component"])

    return rows.groupBy("part").applyInPandas(solve, f"v {kind}, component {kind}")


def unneeded_in_part(edges: list[tuple], max_length: int, unique_length: int, plausible_length: int) -> list[tuple]:
    """``unneeded_edges`` of a whole graph of ``edge_id, src, dst, length``."""
    degree = Counter(v for e in edges for v in e[1:3] if v is not None)
    edges = [(*e, degree[e[1]] == 1 or degree[e[2]] == 1) for e in edges if None not in e[1:]]
    doubtful = [(e, s, d) for e, s, d, n, tip in edges if n <= max_length and not tip]
    if not doubtful:
        return []
    of = smallest_joined((s, d) for _, s, d, n, _ in edges if n < unique_length)
    pairs: dict = {of[s]: [] for _, s, _ in doubtful}
    for _, s, d, n, tip in edges:
        if n < unique_length:
            if of[s] in pairs:
                pairs[of[s]].append((s, d))
        if n >= unique_length or n >= plausible_length and not tip:
            if of.get(d) in pairs:
                pairs[of[d]].append((None, d))
            if of.get(s) in pairs:
                pairs[of[s]].append((s, None))
    found = {part: residual_components(own) for part, own in pairs.items()}
    return [(e,) for e, s, d in doubtful if s in found[of[s]] and found[of[s]][s] != found[of[s]][d]]


def unneeded_edges(edges: DataFrame, max_length: int, unique_length: int, plausible_length: int) -> DataFrame:
    """``edge_id`` of short edges that no flow through their part of the graph can use.

    Parts hang together by edges shorter than ``unique_length``.  Every long edge, and every plausible one that is no
    tip, brings one unit to its end and takes one from its start.  In parts where all units can pass, an edge of at
    most ``max_length`` that is no tip goes if its ends are in different strong components of the residual network.
    """
    if not unique_length >= plausible_length > max_length:
        raise ValueError("unique_length >= plausible_length > max_length must hold")
    rows, large = split_parts(edges.select("edge_id", "src", "dst", "length"), SMALL)
    small = solve_parts(rows, lambda own: unneeded_in_part(own, max_length, unique_length, plausible_length),
                        f"edge_id {dict(edges.dtypes)['edge_id']}")
    return small if large is None else small.unionByName(_unneeded_in_rounds(large, max_length, unique_length, plausible_length))


def _unneeded_in_rounds(edges: DataFrame, max_length: int, unique_length: int, plausible_length: int) -> DataFrame:
    """The same for parts of any size."""
    alone = lambda end: F.col(f"{end}_in") + F.col(f"{end}_out") == 1
    marked = settled(with_degrees(edges).select("edge_id", "src", "dst", "length", (alone("src") | alone("dst")).alias("tip")))
    strong = marked.where((F.col("length") >= unique_length) | ((F.col("length") >= plausible_length) & ~F.col("tip")))
    inner = marked.where(F.col("length") < unique_length)
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    ends = strong.select(F.col("dst").alias("v"), one.alias("excess"), zero.alias("room")).unionByName(
        strong.select(F.col("src").alias("v"), zero.alias("excess"), one.alias("room"))).unionByName(
        marked.select(F.explode(F.array("src", "dst")).alias("v"), zero.alias("excess"), zero.alias("room")))
    part = settled(components(used_vertices(edges).withColumnRenamed("v", "id"), inner).withColumnRenamed("id", "v"))
    none = F.lit(None).cast(dict(edges.dtypes)["src"])
    rows = inner.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("src").alias("at")).unionByName(
        strong.select(none.alias("u"), F.col("dst").alias("v"), F.col("dst").alias("at"))).unionByName(
        strong.select(F.col("src").alias("u"), none.alias("v"), F.col("src").alias("at")))
    rows = settled(rows.join(part.select(F.col("v").alias("at"), F.col("component").alias("part")), "at").drop("at"))
    large = settled(rows.groupBy("part").count().where(F.col("count") > SMALL).select("part"))
    solved = settled(_small_parts(rows.join(large, "part", "left_anti")))
    if not large.isEmpty():
        solved = solved.unionByName(_large_parts(ends, inner, part.join(large.withColumnRenamed("part", "component"), "component", "left_semi")))
    doubtful = marked.where((F.col("length") <= max_length) & ~F.col("tip"))
    return (doubtful.join(solved.select(F.col("v").alias("src"), F.col("component").alias("_a")), "src")
            .join(solved.select(F.col("v").alias("dst"), F.col("component").alias("_b")), "dst").where("_a <> _b").select("edge_id"))


def _large_parts(ends: DataFrame, inner: DataFrame, part: DataFrame) -> DataFrame:
    """The same for parts of any size, in rounds."""
    nodes = settled(ends.groupBy("v").agg(F.sum("excess").alias("excess"), F.sum("room").alias("room")).join(part, "v"))
    # with less units than an arc can carry, vertices of one strong component are one: units pass inside at will, and it stays one
    many = nodes.groupBy("component").agg(F.sum("excess").alias("n")).where(F.col("n") >= INNER_CAPACITY).select("component")
    whole = nodes.join(many, "component", "left_semi").select("v", F.col("v").alias("node"))
    free = nodes.join(many, "component", "left_anti").select("v")
    arcs = inner.select("src", "dst")
    merged = strong_components(free, arcs.join(free.withColumnRenamed("v", "src"), "src", "left_semi"))
    of = settled(merged.withColumnRenamed("component", "node").unionByName(whole))
    placed = settled(nodes.join(of, "v"))
    sums = placed.groupBy(F.col("node").alias("v")).agg(F.sum("excess").alias("excess"), F.sum("room").alias("room"))
    between = (arcs.join(of.select(F.col("v").alias("src"), F.col("node").alias("u")), "src").join(of.select(F.col("v").alias("dst"), F.col("node").alias("v")), "dst")
               .where("u <> v").groupBy("u", "v").agg((F.count("*") * INNER_CAPACITY).alias("res")))
    sums, flows = maximum_flow(sums, between)
    failed = sums.where("excess > 0 OR room > 0").select(F.col("v").alias("node")).join(placed.select("node", "component"), "node").select("component").distinct()
    complete = settled(placed.join(failed, "component", "left_anti").select("v", "node"))
    left = flows.where("res > 0").select(F.col("u").alias("src"), F.col("v").alias("dst")).join(
        complete.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    final = strong_components(complete.select(F.col("node").alias("v")), left).withColumnRenamed("v", "node")
    return complete.join(final, "node").select("v", "component")


def remove_unneeded_edges(edges: DataFrame, max_length: int, unique_length: int, plausible_length: int) -> DataFrame:
    """The graph without ``unneeded_edges``, paths merged."""
    gone = unneeded_edges(edges, max_length, unique_length, plausible_length)
    return compress_paths(edges.join(gone, "edge_id", "left_anti"))
