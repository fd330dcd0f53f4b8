"""Assembly-graph operators over an edge table.

Edges hold ``edge_id, src, dst, length, coverage`` and, when both strands are
present, ``conj_id``.  Graphs are never changed in place: each operator returns a
new edge table.  Where a one-by-one algorithm depends on the visiting order, all
edges of a round are judged together and ties go to the smaller id, so that the
result does not depend on partitioning; rounds repeat until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import sequences as S
from strandframe.operators.components import components
from strandframe.operators.kmers import kmer_table
from strandframe.session import cut_lineage, settled


def de_bruijn_edges(reads: DataFrame, k: int) -> DataFrame:
    """One edge per distinct (k+1)-mer, its coverage being the number of occurrences."""
    counted = kmer_table(reads, k + 1).groupBy("kmer").agg(F.count("*").alias("n"))
    return counted.select(F.col("kmer").alias("edge_id"), S.kmer_start("kmer").alias("src"), S.kmer_end("kmer").alias("dst"),
                          F.lit(1).cast("long").alias("length"), F.col("n").cast("double").alias("coverage"))


def degrees(edges: DataFrame) -> DataFrame:
    """``v, n_in, n_out`` of every vertex with an edge; combined map-side for hubs."""
    ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        edges.select(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("v").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def with_degrees(edges: DataFrame) -> DataFrame:
    """Edges with the in- and out-degrees of both ends."""
    d = degrees(edges)
    a = d.select(F.col("v").alias("src"), F.col("n_in").alias("src_in"), F.col("n_out").alias("src_out"))
    b = d.select(F.col("v").alias("dst"), F.col("n_in").alias("dst_in"), F.col("n_out").alias("dst_out"))
    return edges.join(a, "src").join(b, "dst")


def used_vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct()


def drop_isolated_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(used_vertices(edges), "v", "left_semi")


def drop_isolated_edges(edges: DataFrame, max_length: int, max_coverage: float, max_length_any_coverage: int) -> DataFrame:
    """Drop short edges that touch nothing else."""
    d = with_degrees(edges)
    alone = (F.col("src_in") + F.col("src_out") == 1) & (F.col("dst_in") + F.col("dst_out") == 1)
    short = ((F.col("length") <= max_length) & (F.col("coverage") <= max_coverage)) | (F.col("length") <= max_length_any_coverage)
    return d.where(~(alone & short)).select(*edges.columns)


def compress_paths(edges: DataFrame) -> DataFrame:
    """Merge every maximal unbranched path into one edge.

    Consecutive edges through a vertex with one way in and one way out belong
    together; a path is a component of that relation and takes its smallest edge
    id.  A closed path without branches starts at its smallest edge.
    """
    inner = settled(degrees(edges).where("n_in = 1 AND n_out = 1 AND v IS NOT NULL").select("v"))
    if inner.isEmpty():
        marked = edges.select("*", F.col("edge_id").alias("component"), *(F.lit(None).cast("boolean").alias(f"_{end}_inner") for end in ("src", "dst")))
        marked = marked.where("edge_id IS NOT NULL")
    else:
        into = edges.select(F.col("edge_id").alias("src_edge"), F.col("dst").alias("v"))
        out = edges.select(F.col("edge_id").alias("dst_edge"), F.col("src").alias("v"))
        links = into.join(inner, "v", "left_semi").join(out, "v").select(F.col("src_edge").alias("src"), F.col("dst_edge").alias("dst"))
        group = components(edges.select(F.col("edge_id").alias("id")), links).withColumnRenamed("id", "edge_id")
        marked = (edges.join(group, "edge_id")
                  .join(inner.select(F.col("v").alias("src"), F.lit(True).alias("_src_inner")), "src", "left")
                  .join(inner.select(F.col("v").alias("dst"), F.lit(True).alias("_dst_inner")), "dst", "left"))
    first = F.max(F.when(F.col("_src_inner").isNull(), F.col("src")))
    last = F.max(F.when(F.col("_dst_inner").isNull(), F.col("dst")))
    start = F.min_by("src", "edge_id")
    conj = [F.min("conj_id").alias("conj_id")] if "conj_id" in edges.columns else []
    return marked.groupBy("component").agg(
        F.coalesce(first, start).alias("src"), F.coalesce(last, first, start).alias("dst"),
        F.sum("length").alias("length"), (F.sum(F.col("coverage") * F.col("length")) / F.sum("length")).alias("coverage"),
        *conj, F.count("*").alias("parts")).withColumnRenamed("component", "edge_id")


def _canonical(edges: DataFrame) -> Column:
    """The same id for both strands of an edge."""
    return F.least("edge_id", "conj_id") if "conj_id" in edges.columns else F.col("edge_id")


def competitor_coverage(edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Edges (those of ``of``, if given) with ``rival``, the best coverage of another edge leaving ``src`` or entering ``dst``.

    The two best edges per vertex are kept, so an edge never counts as its own rival.
    """
    best = F.struct("coverage", "edge_id")
    def top_two(end: str) -> DataFrame:
        near = edges if of is None else edges.join(of.select(end).distinct(), end, "left_semi")
        one = near.groupBy(end).agg(F.max(best).alias("_b1"))
        two = near.join(one, end).where(F.col("edge_id") != F.col("_b1.edge_id")).groupBy(end).agg(F.max("coverage").alias("_b2"))
        return one.join(two, end, "left").select(end, F.col("_b1.edge_id").alias(f"_{end}_id"),
                                                 F.col("_b1.coverage").alias(f"_{end}_c1"), F.col("_b2").alias(f"_{end}_c2"))
    e = (edges if of is None else of).join(top_two("src"), "src").join(top_two("dst"), "dst")
    rival = lambda end: F.when(F.col("edge_id") == F.col(f"_{end}_id"), F.col(f"_{end}_c2")).otherwise(F.col(f"_{end}_c1"))
    return e.select(*edges.columns, F.coalesce(F.greatest(rival("src"), rival("dst")), F.lit(0.0)).alias("rival"))


def tips(edges: DataFrame, max_length: int, max_coverage: float | None = None,
         max_relative_coverage: float | None = None) -> DataFrame:
    """Short edges with a dead end on one side and an alternative on the other."""
    d = settled(degrees(edges))
    short = edges.where(F.col("length") <= max_length)
    if max_coverage is not None:
        short = short.where(F.col("coverage") <= max_coverage)
    # few edges end where no other begins or ends: only these meet the degrees of their ends and their rivals
    alone = d.where("n_in + n_out = 1").select("v", F.lit(True).alias("_alone"))
    of = lambda end: alone.select(F.col("v").alias(end), F.col("_alone").alias(f"_{end}_alone"))
    dead = settled(short.join(of("src"), "src", "left").join(of("dst"), "dst", "left").where("_src_alone OR _dst_alone").select(*edges.columns))
    a = d.select(F.col("v").alias("src"), F.col("n_in").alias("src_in"), F.col("n_out").alias("src_out"))
    b = d.select(F.col("v").alias("dst"), F.col("n_in").alias("dst_in"), F.col("n_out").alias("dst_out"))
    found = dead.join(a, "src").join(b, "dst").where(F.col("src_out") + F.col("dst_in") > 2)
    if max_relative_coverage is not None:
        found = settled(found)
        same_id = edges.join(found.select("edge_id").distinct(), "edge_id", "left_semi").select(*edges.columns)
        rivals = competitor_coverage(edges, settled(same_id)).select("edge_id", "rival")
        found = found.join(rivals, "edge_id").where(F.col("coverage") <= max_relative_coverage * (F.col("rival") + 1))
    return found


def clip_tips_once(edges: DataFrame, max_length: int, max_coverage: float | None = None,
                   max_relative_coverage: float | None = None) -> DataFrame:
    """Drop the tips of one round; the longest stays where all alternatives are tips."""
    found = settled(tips(edges, max_length, max_coverage, max_relative_coverage).withColumn("_canon", _canonical(edges)))
    if found.isEmpty():
        return edges
    ends_dead = F.col("dst_in") + F.col("dst_out") == 1
    placed = found.select("edge_id", "length", "_canon", F.when(ends_dead, F.col("src")).otherwise(F.col("dst")).alias("v"),
                          ends_dead.alias("forward"), F.when(ends_dead, F.col("src_out")).otherwise(F.col("dst_in")).alias("ways"))
    per_vertex = placed.groupBy("v", "forward", "ways").agg(
        F.count("*").alias("n"), F.max(F.struct("length", "_canon", "edge_id"))["edge_id"].alias("last"))
    keep = per_vertex.where("n = ways").select(F.col("last").alias("edge_id"))
    gone = placed.select("edge_id").join(keep, "edge_id", "left_anti")
    return edges.join(gone, "edge_id", "left_anti")


def _until_stable(edges: DataFrame, step) -> DataFrame:
    """Repeat ``step``, which never adds edges, until it takes none away."""
    current = settled(edges)
    n = current.count()
    while True:
        nxt = settled(step(current))
        m = nxt.count()
        if m == n:
            return nxt
        current, n = nxt, m


def clip_tips(edges: DataFrame, max_length: int, max_coverage: float | None = None,
              max_relative_coverage: float | None = None) -> DataFrame:
    """Clip tips and merge paths until nothing changes."""
    def step(e: DataFrame) -> DataFrame:
        return compress_paths(clip_tips_once(e, max_length, max_coverage, max_relative_coverage)).select(*edges.columns)
    return _until_stable(edges, step)


def alternative_paths(edges: DataFrame, candidates: DataFrame, max_delta: float, max_relative_delta: float) -> DataFrame:
    """Best covered other path of about the same length beside each candidate edge.

    ``edge_id, path, path_length, path_coverage``.  For a given length only the best
    covered way to a vertex can become the best path, so per candidate the search
    keeps one state for every vertex and length, not every path.
    """
    delta = F.floor(F.greatest(F.col("length") * max_relative_delta, F.lit(max_delta))).cast("long")
    goal = candidates.select(F.col("edge_id").alias("bulge"), F.col("src").alias("at"), F.col("dst").alias("goal"),
                             F.greatest(F.col("length") - delta, F.lit(0)).alias("lo"), (F.col("length") + delta).alias("hi"))
    ways = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("edge_id").alias("via"),
                        F.col("length").alias("step"), (F.col("coverage") * F.col("length")).alias("mass"))
    onward = edges.select(F.col("src").alias("to"), F.lit(True).alias("onward")).distinct()
    ways = ways.join(onward, "to", "left")  # a step to a dead end helps only when that is the goal
    state = goal.select("bulge", "at", "goal", "lo", "hi", F.lit(0).cast("long").alias("len"), F.lit(0.0).alias("sum"),
                        F.array().cast(f"array<{dict(edges.dtypes)['edge_id']}>").alias("path"))
    found = None
    while True:
        moved = state.join(ways, "at").where((F.col("via") != F.col("bulge")) & (F.col("len") + F.col("step") <= F.col("hi"))
                                             & (F.col("onward").isNotNull() | (F.col("to") == F.col("goal"))))
        state = cut_lineage(moved.groupBy("bulge", F.col("to").alias("at"), "goal", "lo", "hi", (F.col("len") + F.col("step")).alias("len")).agg(
            F.max(F.struct((F.col("sum") + F.col("mass")).alias("sum"), F.array_append("path", F.col("via")).alias("path"))).alias("_b"))
            .select("bulge", "at", "goal", "lo", "hi", "len", "_b.sum", "_b.path"))
        if state.isEmpty():
            break
        done = state.where((F.col("at") == F.col("goal")) & (F.col("len") >= F.col("lo")))
        found = done if found is None else found.unionByName(done)
    if found is None:
        found = state.where("false")
    best = found.groupBy("bulge").agg(F.max(F.struct((F.col("sum") / F.col("len")).alias("c"), (-F.col("len")).alias("l"), "path")).alias("_b"))
    return best.select(F.col("bulge").alias("edge_id"), F.col("_b.path").alias("path"), (-F.col("_b.l")).alias("path_length"),
                       F.col("_b.c").alias("path_coverage"))


def remove_bulges_once(edges: DataFrame, max_length: int, max_coverage: float, max_relative_coverage: float,
                       max_delta: float, max_relative_delta: float) -> DataFrame:
    """Project the bulges of one round onto their alternative paths."""
    possible = with_degrees(edges).where((F.col("length") <= max_length) & (F.col("coverage") < max_coverage)
                                         & (F.col("src_out") > 1) & (F.col("dst_in") > 1)).select(*edges.columns)
    order = F.struct(F.col("coverage").alias("c"), _canonical(edges).alias("k"))
    ranked = edges.withColumn("_order", order).select("edge_id", "_order", "coverage", "length",
                                                      *(["conj_id"] if "conj_id" in edges.columns else []))
    judged = (alternative_paths(edges, possible, max_delta, max_relative_delta).join(ranked, "edge_id")
              .where(F.col("path_coverage") * max_relative_coverage >= F.col("coverage"))
              .where(F.size(F.array_distinct("path")) == F.size("path")))
    if "conj_id" in edges.columns:
        steps = judged.select("edge_id", F.col("conj_id").alias("_self_conj"), F.explode("path").alias("p"), "path")
        bad = steps.join(edges.select(F.col("edge_id").alias("p"), F.col("conj_id").alias("_pc")), "p").where(
            F.array_contains("path", F.col("_pc")) | (F.col("p") == F.col("_self_conj"))).select("edge_id").distinct()
        judged = judged.join(bad, "edge_id", "left_anti")
    judged = cut_lineage(judged)
    # an edge yields to a better path; paths through another bulge wait a round
    through = judged.select("edge_id", "_order", F.explode("path").alias("p"))
    other = judged.select(F.col("edge_id").alias("p"), F.col("_order").alias("_po"))
    clash = through.join(other, "p")
    waits = clash.where(F.col("_po") < F.col("_order")).select("edge_id").distinct()
    first = judged.join(waits, "edge_id", "left_anti")
    kept_for_path = first.select(F.explode("path").alias("edge_id")).distinct()
    accepted = cut_lineage(first.join(kept_for_path, "edge_id", "left_anti"))
    given = _projected_mass(accepted, edges)
    rest = edges.join(accepted.select("edge_id"), "edge_id", "left_anti").join(given, "edge_id", "left")
    return rest.withColumn("coverage", F.col("coverage") + F.coalesce("_mass", F.lit(0.0)) / F.col("length")).select(*edges.columns)


def _projected_mass(accepted: DataFrame, edges: DataFrame) -> DataFrame:
    """``edge_id, _mass``: coverage mass each path edge receives from projected bulges."""
    steps = accepted.select(F.col("edge_id").alias("bulge"), F.col("coverage").alias("_bc"), F.col("length").alias("_bl"),
                            "path_length", F.posexplode("path").alias("i", "edge_id"))
    sized = steps.join(edges.select("edge_id", F.col("length").alias("_el")), "edge_id")
    # one array entry per edge of one path
    lists = sized.groupBy("bulge", "_bc", "_bl", "path_length").agg(F.array_sort(F.collect_list(F.struct("i", "edge_id", "_el"))).alias("s"))
    ends = F.transform("s", lambda x, j: F.struct(x["edge_id"].alias("edge_id"), x["_el"].alias("len"), F.aggregate(
        F.slice("s", F.lit(1), j + 1), F.lit(0).cast("long"), lambda a, y: a + y["_el"]).alias("stop")))
    cut = lists.select("_bc", "_bl", "path_length", F.explode(ends).alias("p")).select(
        "_bc", "p.edge_id", S.map_position_keeping_ends(F.col("p.stop"), F.col("path_length"), F.col("_bl")).alias("b"),
        S.map_position_keeping_ends(F.col("p.stop") - F.col("p.len"), F.col("path_length"), F.col("_bl")).alias("a"))
    return cut.groupBy("edge_id").agg(F.sum(F.col("_bc") * F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("_mass"))


def remove_bulges(edges: DataFrame, max_length: int, max_coverage: float = 1000.0, max_relative_coverage: float = 1.2,
                  max_delta: float = 3, max_relative_delta: float = 0.1) -> DataFrame:
    """Remove bulges and merge paths until nothing changes."""
    def step(e: DataFrame) -> DataFrame:
        return compress_paths(remove_bulges_once(e, max_length, max_coverage, max_relative_coverage, max_delta,
                                                 max_relative_delta)).select(*edges.columns)
    return _until_stable(edges, step)


def _ways_within(ways: DataFrame, bound: int) -> DataFrame:
    """``ways`` written once for all rounds; a step above ``bound`` leads nowhere, unless a negative one may make up for it."""
    ways = settled(ways)
    least = ways.agg(F.min("step")).first()[0]
    return ways if least is not None and least < 0 else ways.where(F.col("step") <= bound)


def shortest_distances(edges: DataFrame, sources: DataFrame, bound: int, backward: bool = False,
                       max_edge: int | None = None) -> DataFrame:
    """``source, v, distance`` of all vertices within ``bound``, along or against the edges."""
    head, tail = ("dst", "src") if backward else ("src", "dst")
    usable = edges if max_edge is None else edges.where(F.col("length") <= max_edge)
    ways = _ways_within(usable.groupBy(F.col(head).alias("v"), F.col(tail).alias("to")).agg(F.min("length").alias("step")), bound)
    known = cut_lineage(sources.select(F.col("v").alias("source"), "v", F.lit(0).cast("long").alias("distance")).distinct())
    fresh = known
    while True:
        reached = (fresh.join(ways, "v").select("source", F.col("to").alias("v"), (F.col("distance") + F.col("step")).alias("distance"))
                   .where(F.col("distance") <= bound).groupBy("source", "v").agg(F.min("distance").alias("distance")))
        old = known.withColumnRenamed("distance", "_old")
        better = cut_lineage(reached.join(old, ["source", "v"], "left").where("_old IS NULL OR distance < _old").drop("_old"))
        if better.isEmpty():
            return known
        known = cut_lineage(known.unionByName(better).groupBy("source", "v").agg(F.min("distance").alias("distance")))
        fresh = better


def path_lengths(edges: DataFrame, sources: DataFrame, low: int, high: int) -> DataFrame:
    """``source, v, length``: lengths of all paths within the bounds, each length once."""
    ways = _ways_within(edges.select(F.col("src").alias("v"), F.col("dst").alias("to"), F.col("length").alias("step")).distinct(), high)
    state = sources.select(F.col("v").alias("source"), "v", F.lit(0).cast("long").alias("length"))
    seen = None
    while True:
        moved = state.join(ways, "v").select("source", F.col("to").alias("v"), (F.col("length") + F.col("step")).alias("length")).where(
            F.col("length") <= high).distinct()
        state = cut_lineage(moved if seen is None else moved.join(seen, ["source", "v", "length"], "left_anti"))
        if state.isEmpty():
            break
        seen = state if seen is None else seen.unionByName(state)
    result = state if seen is None else seen
    return result.where(F.col("length") >= low)


def resolvable_loops(edges: DataFrame, variation: float) -> DataFrame:
    """Self-loops on a simple path whose coverage fits that of the path.

    ``edge_id, v, before_id, after_id``.
    """
    # written once: the optimizer takes edges made from k-mers for as small as their texts and would broadcast them
    edges = settled(edges.select("edge_id", "src", "dst", "coverage"))
    loops = settled(edges.where("src = dst").select("edge_id", F.col("src").alias("v"), F.col("coverage").alias("c")))
    at = loops.select("v").distinct()  # only edges that touch a loop go on
    near = lambda end, edge_id, coverage: settled(edges.select(
        F.col(end).alias("v"), F.col("edge_id").alias(edge_id), F.col("coverage").alias(coverage), (F.col("src") == F.col("dst")).alias("_loop"))
        .join(at, "v", "left_semi"))
    before, after = near("dst", "before_id", "cb"), near("src", "after_id", "ca")
    two = lambda side: side.groupBy("v").agg(F.count("*").alias("n")).where("n = 2").select("v")
    loops = loops.join(two(before), "v", "left_semi").join(two(after), "v", "left_semi")
    before, after = (side.where("NOT _loop").drop("_loop") for side in (before, after))
    fits = F.abs((F.col("ca") + F.col("cb")) / 2 - F.col("c")) <= variation * F.col("c")
    return loops.join(before, "v").join(after, "v").where(fits).select("edge_id", "v", "before_id", "after_id")


def parallel_edges(edges: DataFrame) -> DataFrame:
    """``edge_a, edge_b``: pairs of edges with the same two ends."""
    a = edges.select("src", "dst", F.col("edge_id").alias("edge_a"))
    b = edges.select("src", "dst", F.col("edge_id").alias("edge_b"))
    return a.join(b, ["src", "dst"]).where("edge_a < edge_b").select("edge_a", "edge_b")


def multiplicities(edges: DataFrame) -> DataFrame:
    """Number of edges between two vertices, where it is more than one."""
    return edges.groupBy("src", "dst").agg(F.count("*").alias("n")).where(F.col("n") > 1)


def induced_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among ``vertices``."""
    a = edges.join(vertices.select(F.col("v").alias("src")), "src", "left_semi")
    return a.join(vertices.select(F.col("v").alias("dst")), "dst", "left_semi")


def edge_lineage(lineage: DataFrame, merged: DataFrame) -> DataFrame:
    """Carry ``edge_id, origin`` over a merge given as ``edge_id, new_id``."""
    moved = lineage.join(merged, "edge_id", "left")
    return moved.select(F.coalesce("new_id", "edge_id").alias("edge_id"), "origin").distinct()


def take_while(edges: DataFrame, order: str, proceed: Column) -> DataFrame:
    """Edges before the first one, by ``order`` and id, that fails ``proceed``."""
    key = F.struct(order, "edge_id")
    stop = edges.where(~proceed).agg(F.min(key).alias("_stop"))  # one row
    return edges.join(F.broadcast(stop)).where(F.col("_stop").isNull() | (key < F.col("_stop"))).drop("_stop")


def component_filter(members: DataFrame, edges: DataFrame, max_vertices: int, min_longest: int) -> DataFrame:
    """Components of limited size that hold an edge of at least ``min_longest``."""
    sizes = members.groupBy("component").agg(F.count("*").alias("vertices")).where(F.col("vertices") <= max_vertices)
    longest = (edges.join(members.select(F.col("id").alias("src"), "component"), "src").groupBy("component")
               .agg(F.max("length").alias("longest")).where(F.col("longest") >= min_longest))
    return sizes.join(longest, "component")


def supported_pairs(pairs: DataFrame, edges: DataFrame, share: float = 0.1, least: float = float("inf")) -> DataFrame:
    """Pairs ``edge_a, edge_b, weight`` weighing at least ``least``, or a share of either edge's coverage."""
    cov = edges.select("edge_id", "coverage")
    a = cov.select(F.col("edge_id").alias("edge_a"), F.col("coverage").alias("_ca"))
    b = cov.select(F.col("edge_id").alias("edge_b"), F.col("coverage").alias("_cb"))
    joined = pairs.join(a, "edge_a").join(b, "edge_b")
    return joined.where((F.col("weight") >= least) | (F.col("weight") >= share * F.col("_ca")) | (F.col("weight") >= share * F.col("_cb"))).select(*pairs.columns)
