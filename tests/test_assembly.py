"""Strong components, flows, loops, forests and low coverage parts against plain Python on random small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import flow, forest, loops, strong
from strandframe.operators import graph as G


def random_arcs(seed, groups=200, most=16):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        n = rng.randint(2, 9)
        out += [(g * 100 + rng.randrange(n), g * 100 + rng.randrange(n)) for _ in range(rng.randint(1, most))]
    return out


def reached(arcs):
    ahead = {}
    for a, b in arcs:
        ahead.setdefault(a, set()).add(b)
        ahead.setdefault(b, set())
    out = {}
    for v in ahead:
        out[v], todo = {v}, [v]
        while todo:
            for w in ahead[todo.pop()] - out[v]:
                out[v].add(w)
                todo.append(w)
    return out


@pytest.mark.parametrize("small", [10_000, 0])
def test_strong_components(spark, monkeypatch, small):
    monkeypatch.setattr(strong, "SMALL", small)
    arcs = random_arcs(1)
    edges = spark.createDataFrame(arcs, "src long, dst long")
    far = reached(arcs)
    want = {v: min(w for w in far[v] if v in far[w]) for v in far}
    got = strong.strong_components(G.used_vertices(edges), edges).collect()
    assert {r["v"]: r["component"] for r in got} == want and len(got) == len(want)


def augmented(nodes, arcs):
    """Maximum flow by shortest augmenting paths: value and residual capacities."""
    cap = {}
    for v, excess, room in nodes:
        cap["S", v], cap[v, "T"] = excess, room
    for u, v, c in arcs:
        if u != v:
            cap[u, v] = cap.get((u, v), 0) + c
    near = {}
    for u, v in list(cap):
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    total = 0
    while True:
        before, queue = {"S": None}, ["S"]
        for x in queue:
            for y in near.get(x, ()):
                if y not in before and cap.get((x, y), 0) > 0:
                    before[y] = x
                    queue.append(y)
        if "T" not in before:
            return total, cap
        path, y = [], "T"
        while before[y] is not None:
            path.append((before[y], y))
            y = before[y]
        f = min(cap[e] for e in path)
        for a, b in path:
            cap[a, b] -= f
            cap[b, a] = cap.get((b, a), 0) + f
        total += f


def test_flow_equals_augmenting_paths(spark):
    rng = random.Random(5)
    nodes, arcs, want, brought = [], [], {}, {}
    for g in range(200):
        n = rng.randint(2, 9)
        own = [(g * 100 + i, rng.choice([0, 0, 1, 3]), rng.choice([0, 0, 1, 2])) for i in range(n)]
        links = [(g * 100 + rng.randrange(n), g * 100 + rng.randrange(n), rng.choice([1, 2, 10_000])) for _ in range(rng.randint(1, 16))]
        nodes, arcs = nodes + own, arcs + links
        want[g], brought[g] = augmented(own, links)[0], sum(e for _, e, _ in own)
    left, _ = flow.maximum_flow(spark.createDataFrame(nodes, "v long, excess long, room long"),
                                spark.createDataFrame(arcs, "u long, v long, res long"))
    stuck = {r["g"]: r["n"] for r in left.groupBy(F.expr("v div 100").alias("g")).agg(F.sum("excess").alias("n")).collect()}
    assert {g: brought[g] - stuck[g] for g in want} == want


def plain_unneeded(edges, max_length, unique, plausible):
    degree, near = {}, {}
    for _, s, d, n in edges:
        degree[s], degree[d] = degree.get(s, 0) + 1, degree.get(d, 0) + 1
    part = {v: v for v in degree}
    for _ in degree:
        for _, s, d, n in edges:
            if n < unique:
                part[s] = part[d] = min(part[s], part[d])
    tip = lambda s, d: degree[s] == 1 or degree[d] == 1
    out = set()
    for p in set(part.values()):
        own = {v for v in part if part[v] == p}
        strong_ = [(s, d) for _, s, d, n in edges if n >= unique or n >= plausible and not tip(s, d)]
        nodes = [(v, sum(d == v for _, d in strong_), sum(s == v for s, _ in strong_)) for v in own]
        arcs = [(s, d, 10_000) for _, s, d, n in edges if n < unique and s in own]
        total, cap = augmented(nodes, arcs)
        if total != sum(n[1] for n in nodes) or total != sum(n[2] for n in nodes):
            continue
        far = reached([e for e, c in cap.items() if c > 0])
        out |= {e for e, s, d, n in edges if n <= max_length and not tip(s, d) and s in own and d in own
                and not (d in far.get(s, {s}) and s in far.get(d, {d}))}
    return out


@pytest.mark.parametrize("small", [10_000, 0])
def test_unneeded_edges(spark, monkeypatch, small):
    monkeypatch.setattr(flow, "SMALL", small)
    rng = random.Random(7)
    edges = [(i, a, b, rng.choice([2, 3, 6, 9])) for i, (a, b) in enumerate(random_arcs(7, groups=150, most=14))]
    df = spark.createDataFrame([(*e, 1.0) for e in edges], "edge_id long, src long, dst long, length long, coverage double")
    want = plain_unneeded(edges, 3, 9, 6)
    got = sorted(r[0] for r in flow.unneeded_edges(df, 3, 9, 6).collect())
    assert got == sorted(want) and len(want) >= 5


def plain_loop_edges(edges, splitting, most, longest, total):
    part = {v: v for _, s, d, _ in edges for v in (s, d)}
    for _ in part:
        for _, s, d, n in edges:
            if n < splitting:
                part[s] = part[d] = min(part[s], part[d])
    out = set()
    for p in set(part.values()):
        own = {v for v in part if part[v] == p}
        into = [d for _, s, d, _ in edges if d in own and s not in own]
        leave = [s for _, s, d, _ in edges if s in own and d not in own]
        if len(own) > most or len(into) != 1 or len(leave) != 1:
            continue
        inner = [e for e in edges if e[1] in own and e[2] in own]
        via, level = {into[0]: None}, [into[0]]
        while level:
            found = {}
            for e in sorted(inner):
                if e[1] in level and e[2] not in via:
                    found.setdefault(e[2], e)
            via.update(found)
            level = list(found)
        if leave[0] not in via:
            continue
        way, v = set(), leave[0]
        while via[v]:
            way.add(via[v][0])
            v = via[v][1]
        extra = [e for e in inner if e[0] not in way]
        if extra and max(e[3] for e in extra) <= longest and sum(e[3] for e in extra) <= total:
            out |= {e[0] for e in extra}
    return out


def test_loop_edges(spark):
    rng = random.Random(9)
    edges = [(i, a, b, rng.choice([2, 3, 9])) for i, (a, b) in enumerate(random_arcs(9, groups=250, most=12))]
    df = spark.createDataFrame([(*e, 1.0) for e in edges], "edge_id long, src long, dst long, length long, coverage double")
    want = plain_loop_edges(edges, 9, 6, 5, 14)
    got = sorted(r[0] for r in loops.loop_edges(df, 9, 6, 5, 14).collect())
    assert got == sorted(want) and len(want) >= 5


def test_resolved_loop(spark):
    rows = [("in", "a", "v", 5, 4.0), ("loop", "v", "v", 3, 4.0), ("out", "v", "b", 5, 4.0), ("far", "x", "x", 3, 4.0)]
    df = spark.createDataFrame(rows, "edge_id string, src string, dst string, length long, coverage double")
    got = {r["edge_id"]: (r["src"], r["dst"]) for r in loops.resolve_loops(df, 0.1).collect()}
    assert got == {"in": ("a", "v"), "loop": ("v", "v+"), "out": ("v+", "b"), "far": ("x", "x")}


def test_forest_parts(spark):
    arcs = random_arcs(11, groups=12, most=16) + [(5000 + i, 5001 + i) for i in range(60)] + [(7000, 7001 + i) for i in range(30)]
    edges = spark.createDataFrame(arcs, "src long, dst long")
    vertices = G.used_vertices(edges)
    size = 5
    got = forest.forest_parts(vertices, edges, size).collect()
    part = {r["v"]: r["part"] for r in got}
    both = arcs + [(b, a) for a, b in arcs]
    far = reached(both)
    trees = {min(far[v]) for v in far}
    assert len(got) == len(far) and set(part) == set(far)
    groups = {}
    for v, p in part.items():
        groups.setdefault(p, set()).add(v)
    assert len(groups) <= len(far) // size + len(trees)
    inside = reached([(a, b) for a, b in both if part[a] == part[b]] + [(v, v) for v in far])
    assert all(own == inside[p] & own for p, own in groups.items())  # each part is connected in itself
    line = [len(own) for p, own in groups.items() if 5000 <= p < 6000]
    assert max(line) <= size + 1


def test_low_coverage_parts(spark):
    from strandframe.operators import relative_coverage as rc
    rows = [("m1", 1, 2, 30, 50.0), ("m2", 2, 3, 30, 50.0), ("m3", 3, 4, 30, 50.0),  # the well covered line
            ("b1", 2, 9, 4, 2.0), ("b2", 9, 3, 4, 2.0),  # a faint way beside it
            ("t1", 3, 8, 4, 2.0),  # a faint tip
            ("far", 20, 21, 4, 2.0)]
    df = spark.createDataFrame(rows, "edge_id string, src long, dst long, length long, coverage double")
    def seeds(**named):
        limits = dict(gap=5.0, max_length=10, max_length_with_tips=10, max_way=20) | named
        out = {}
        for r in rc.low_coverage_parts(df, **limits).collect():
            out.setdefault(r["seed"], set()).add(r["edge_id"])
        return out
    assert seeds() == {"b1": {"b1", "b2"}, "t1": {"t1"}}
    assert seeds(max_way=8) == {"t1": {"t1"}}  # the way beside the line has 8 bases
    assert seeds(max_inner=0) == {}


def no_rounds(*_):
    raise AssertionError("small parts need no rounds")


def test_small_parts_need_no_rounds(spark, monkeypatch):
    """Graphs of small parts are solved without rounds over all edges, and as the rounds solve them."""
    from strandframe.operators import components as C
    rng = random.Random(13)
    edges = [(i, a, b, rng.choice([2, 3, 6, 9])) for i, (a, b) in enumerate(random_arcs(13, groups=60, most=14))]
    df = spark.createDataFrame([(*e, 1.0) for e in edges], "edge_id long, src long, dst long, length long, coverage double").cache()
    run = {
        "forest": lambda: forest.forest_parts(G.used_vertices(df), df, 4),
        "flow": lambda: flow.unneeded_edges(df, 3, 9, 6),
        "loops": lambda: loops.loop_edges(df, 9, 6, 5, 14),
    }
    with monkeypatch.context() as m:
        for module, name in ((C, "_large_star"), (forest, "spanning_forest"), (flow, "with_degrees"), (loops, "shortest_ways"), (strong, "_colours")):
            m.setattr(module, name, no_rounds)
        strong.strong_components(G.used_vertices(df), df)
        got = {k: sorted(map(tuple, f().collect())) for k, f in run.items()}
    for module in (forest, flow, loops):
        monkeypatch.setattr(module, "SMALL", 0)
    assert got == {k: sorted(map(tuple, f().collect())) for k, f in run.items()} and all(got.values())


def test_parts_of_both_kinds(spark, monkeypatch):
    """Some parts in one task, some in rounds, text ids, a vertex without edges and edges with a NULL end."""
    name = lambda v: f"é{v}" if v % 2 else f"z{v}"
    arcs = [(name(a), name(b)) for a, b in random_arcs(17, groups=20, most=12)]
    df = spark.createDataFrame([(i, a, b, 2, 1.0) for i, (a, b) in enumerate(arcs)] + [(-1, None, arcs[0][1], 2, 1.0), (-2, arcs[0][0], None, 2, 1.0)],
                               "edge_id long, src string, dst string, length long, coverage double").cache()
    vertices = G.used_vertices(df).where("v IS NOT NULL").union(spark.createDataFrame([("alone",)], "v string"))
    run = [lambda: forest.forest_parts(vertices, df, 3), lambda: strong.strong_components(vertices, df),
           lambda: flow.unneeded_edges(df, 3, 9, 6), lambda: loops.loop_edges(df, 9, 6, 5, 14)]
    results = []
    for most in (0, 6, 10_000):
        for module in (forest, strong, flow, loops):
            monkeypatch.setattr(module, "SMALL", most)
        results.append([sorted(map(tuple, f().collect())) for f in run])
    assert results[0] == results[1] == results[2] and ("alone", "alone") in results[0][0]
    far = reached(arcs)
    assert dict(results[0][1]) == {"alone": "alone"} | {v: min(w for w in far[v] if v in far[w]) for v in far}


@pytest.mark.parametrize("chunk", [200_000, 7])
def test_components_over_chunks(spark, monkeypatch, chunk):
    from strandframe.operators import components as C
    monkeypatch.setattr(C, "CHUNK", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        arcs = random_arcs(19, groups=40, most=12) + [(9000 + (i * 37) % 50, 9000 + (i * 37 + 37) % 50) for i in range(50)]
        df = spark.createDataFrame([(str(a), str(b)) for a, b in arcs] + [(None, "1"), ("2", None)], "src string, dst string").repartition(5, "src")
        far = reached([(str(x), str(y)) for a, b in arcs for x, y in ((a, b), (b, a))])
        got = C.components(G.used_vertices(df).withColumnRenamed("v", "id").where("id IS NOT NULL"), df).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["id"]: r["component"] for r in got} == {v: min(own) for v, own in far.items()} | {v: v for v in ("1", "2") if v not in far}
    assert len(got) == len({r["id"] for r in got})
