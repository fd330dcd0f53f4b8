"""Graph operators on small fragments with known outcomes."""

import pytest
from pyspark.sql import functions as F

from strandframe.operators import graph as G

COLUMNS = "edge_id long, src long, dst long, length long, conj_id long, coverage double"

# Made-up fragments with both strands: the other strand of vertex v is v + 10.
TIP = [(1, 10, 11, 900, 2, 50.0), (2, 21, 20, 900, 1, 50.0), (3, 11, 12, 700, 4, 60.0), (4, 22, 21, 700, 3, 60.0),
       (5, 11, 13, 6, 6, 8.0), (6, 23, 21, 6, 5, 8.0)]
BULGE = [(1, 10, 11, 500, 2, 40.0), (2, 21, 20, 500, 1, 40.0), (3, 12, 13, 800, 4, 44.0), (4, 23, 22, 800, 3, 44.0),
         (5, 11, 12, 30, 6, 42.0), (6, 22, 21, 30, 5, 42.0), (7, 11, 12, 30, 8, 3.0), (8, 22, 21, 30, 7, 3.0)]


def vertex_count(edges):
    return G.used_vertices(edges).count()


def test_single_tip(spark):
    edges = spark.createDataFrame(TIP, COLUMNS)
    left = G.clip_tips(edges, 250, 1000.0, 1.2)
    assert vertex_count(left) == 4
    assert sorted(r.length for r in left.collect()) == [1600, 1600]


def test_single_bulge(spark):
    edges = spark.createDataFrame(BULGE, COLUMNS)
    left = G.remove_bulges(edges, 220).collect()
    assert len({v for r in left for v in (r.src, r.dst)}) == 4
    mass = (40 * 500 + 44 * 800 + 30 * (42 + 3)) / (500 + 800 + 30)
    assert [r.length for r in left] == [1330, 1330]
    assert all(r.coverage == pytest.approx(mass) for r in left)


def test_bulge_of_another_length_stays(spark):
    rows = [(e, s, d, 60 if e in (7, 8) else n, c, v) for e, s, d, n, c, v in BULGE]
    assert G.remove_bulges(spark.createDataFrame(rows, COLUMNS), 220).count() == len(rows)


def test_competing_tips_leave_the_longest(spark):
    rows = [(1, 1, 2, 100, 1.0), (2, 2, 3, 5, 1.0), (3, 2, 4, 7, 1.0), (4, 2, 5, 3, 1.0)]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, length long, coverage double")
    assert {r.edge_id for r in G.clip_tips_once(edges, 10).collect()} == {1, 3}


def test_paths_and_closed_paths_are_merged(spark):
    rows = [(1, 1, 2, 3, 2.0), (2, 2, 3, 1, 6.0), (3, 3, 4, 1, 1.0), (4, 3, 5, 1, 1.0), (7, 8, 9, 2, 1.0), (6, 9, 8, 2, 3.0)]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, length long, coverage double")
    got = {r.edge_id: (r.src, r.dst, r.length, r.coverage) for r in G.compress_paths(edges).collect()}
    assert got == {1: (1, 3, 4, 3.0), 3: (3, 4, 1, 1.0), 4: (3, 5, 1, 1.0), 6: (9, 9, 4, 2.0)}


def canonical(seqs):
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    return {min(s, rc(s)) for s in seqs}


@pytest.mark.parametrize("reads, lengths", [
    (["ACAAACCACCC", "AAACCACCCAC"], [8]), (["ACAAACCACCA", "ACAAACAACCC"], [1, 5, 5])])
def test_de_bruijn_worked_examples(spark, reads, lengths):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(reads)], "read_id long, seq string")
    got = sorted(r.length for r in G.compress_paths(G.de_bruijn_edges(df, 5)).collect())
    assert got == lengths


def test_loops_on_a_path(spark):
    rows = [(1, 1, 2, 9, 10.0), (2, 2, 2, 4, 10.0), (3, 2, 3, 9, 10.0)]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, length long, coverage double")
    assert [tuple(r) for r in G.resolvable_loops(edges, 0.1).collect()] == [(2, 2, 1, 3)]


def test_loops_of_kmers_are_cut_once(spark):
    """The k-mers are written, not cut again for each join, and never broadcast for the small size of their texts."""
    texts = [(0, "ACCAAAAG"), (1, "TGTTTTTC"), (2, None)]
    edges = G.de_bruijn_edges(spark.createDataFrame(texts, "read_id long, seq string"), 3)
    found = G.resolvable_loops(edges, 0.9)
    assert {tuple(r) for r in found.collect()} == {("AAAA", "AAA", "CAAA", "AAAG"), ("TTTT", "TTT", "GTTT", "TTTC")}
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()


def test_loops_off_a_simple_path(spark):
    rows = [(1, 1, 2, 1.0), (2, 2, 2, 1.0), (3, 2, 3, 1.0), (4, 2, 5, 1.0), (5, 6, 7, 1.0), (6, 7, 7, 1.0), (7, 7, 7, 1.0), (8, None, 9, 1.0), (9, 9, 9, 1.0), (10, 9, None, 1.0), (11, None, None, 1.0)]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, coverage double")
    assert [tuple(r) for r in G.resolvable_loops(edges, 0.9).collect()] == []  # two ways out; two loops; open ends


def test_distances_and_path_lengths(spark):
    rows = [(1, 1, 2, 3, 1.0), (2, 2, 3, 3, 1.0), (3, 1, 3, 10, 1.0), (4, 3, 1, 1, 1.0)]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, length long, coverage double")
    start = spark.createDataFrame([(1,)], "v long")
    d = {r.v: r.distance for r in G.shortest_distances(edges, start, 20).collect()}
    assert d == {1: 0, 2: 3, 3: 6}
    back = {r.v: r.distance for r in G.shortest_distances(edges, start, 5, backward=True).collect()}
    assert back == {1: 0, 3: 1, 2: 4}
    paths = {(r.v, r.length) for r in G.path_lengths(edges, start, 1, 13).collect()}
    assert paths == {(2, 3), (3, 6), (3, 10), (1, 7), (1, 11), (2, 10), (3, 13)}


def test_rivals_exclude_the_edge_itself(spark):
    rows = [(1, 1, 2, 1, 5.0), (2, 1, 3, 1, 9.0), (3, 4, 2, 1, 7.0)]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, length long, coverage double")
    assert {r.edge_id: r.rival for r in G.competitor_coverage(edges).collect()} == {1: 9.0, 2: 5.0, 3: 5.0}


def test_pairs_pass_by_weight_or_by_share(spark):
    edges = spark.createDataFrame([(1, 100.0), (2, 900.0), (3, 800.0)], "edge_id long, coverage double")
    pairs = spark.createDataFrame([(1, 2, 12.0), (2, 3, 50.0), (3, 2, 5.0)], "edge_a long, edge_b long, weight double")
    assert {(r.edge_a, r.edge_b) for r in G.supported_pairs(pairs, edges).collect()} == {(1, 2)}
    assert {(r.edge_a, r.edge_b) for r in G.supported_pairs(pairs, edges, least=40.0).collect()} == {(1, 2), (2, 3)}


def test_ways_are_written_once_and_long_steps_stay_only_beside_negative_ones(spark, monkeypatch):
    """F32, F33: rounds read one written table instead of making the edges anew."""
    calls, written = [], G.settled
    monkeypatch.setattr(G, "settled", lambda df: calls.append(df) or written(df))
    start = spark.createDataFrame([(1,)], "v long")
    rows = [("a", 1, 2, 9, 1.0), ("b", 2, 3, 1, 1.0), ("c", 1, 4, 2, 1.0), ("d", 4, 3, 2, 1.0)]
    edges = spark.createDataFrame(rows, "edge_id string, src long, dst long, length long, coverage double")
    assert {(r.v, r.distance) for r in G.shortest_distances(edges, start, 4).collect()} == {(1, 0), (4, 2), (3, 4)}
    assert {(r.v, r.length) for r in G.path_lengths(edges, start, 1, 4).collect()} == {(4, 2), (3, 4)}
    assert len(calls) == 2
    back = edges.union(spark.createDataFrame([("e", 1, 5, -8, 1.0), ("f", 5, 6, 11, 1.0)], edges.schema))
    assert {(r.v, r.distance) for r in G.shortest_distances(back, start, 4).collect()} == {(1, 0), (4, 2), (3, 4), (5, -8), (6, 3)}


def test_clipping_looks_at_few_edges(spark):
    """Without a path to merge the edges are shuffled once, and no rival is sought without a tip."""
    rows = [(f"{a}-{b}", a, b, 5 + a, 2.0 + b) for a in range(6) for b in range(10, 15)]
    edges = spark.createDataFrame(rows, "edge_id string, src long, dst long, length long, coverage double")
    plan = G.compress_paths(edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert G.clip_tips_once(edges, 100, 1000.0, 1.2) is edges
    assert sorted(map(tuple, G.clip_tips(edges, 100, 1000.0, 1.2).collect())) == sorted(rows)


def test_rivals_of_some_edges(spark):
    rows = [(i, i % 4, 10 + i % 3, 3, float(i % 5)) for i in range(20)]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long, length long, coverage double")
    some = edges.where("edge_id % 3 = 0")
    whole = {r.edge_id: r.rival for r in G.competitor_coverage(edges).collect()}
    assert {r.edge_id: r.rival for r in G.competitor_coverage(edges, some).collect()} == {i: whole[i] for i in range(0, 20, 3)}
