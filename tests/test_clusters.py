"""Clusters, components and repertoire comparison on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from strandframe.operators import clusters as C
from strandframe.operators import repertoires as P
from strandframe.operators.components import components


def groups_of(vertices, edges):
    parent = {v: v for v in vertices}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {v: find(v) for v in vertices}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(7)
    n = 300
    edges = {"random": [(rng.randrange(n), rng.randrange(n)) for _ in range(180)],
             "path": [(i, i + 1) for i in range(n - 1)],
             "star": [(150, i) for i in range(n)], "none": []}[shape]
    v = spark.range(n).select("id")
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r.id: r.component for r in components(v, e).collect()}
    assert got == groups_of(range(n), edges)


def test_exact_evaluation_by_hand(spark):
    o = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, 20), (5, 30), (6, 40), (7, 40)], "read_id long, cluster_id long")
    c = spark.createDataFrame([(1, 100), (2, 100), (3, 200), (4, 300), (5, 300), (8, 400)], "read_id long, cluster_id long")
    m = {r.metric: r.value for r in C.evaluate_exact(o, c).collect()}
    assert m["original_clusters"] == 4 and m["constructed_clusters"] == 4
    assert m["not_merged"] == 1 and m["not_merged_big_and_singletons"] == 1
    assert m["original_singletons"] == 2 and m["constructed_singletons"] == 2 and m["correct_singletons"] == 0
    assert m["max_original_cluster"] == 3 and m["max_constructed_cluster"] == 2
    assert m["avg_fill_in"] == pytest.approx(2 / 3) and m["max_cluster_fill_in"] == pytest.approx(2 / 3)
    assert m["errors"] == 2  # one mixes two originals, one holds an unknown read only
    assert m["lost_clusters"] == 1 and m["lost_clusters_size"] == pytest.approx(2 / 7)
    assert m["used_reads_pct"] == pytest.approx(6 / 7 * 100)


def test_no_split_cluster_gives_nan(spark):
    o = spark.createDataFrame([(1, 1), (2, 1)], "read_id long, cluster_id long")
    m = {r.metric: r.value for r in C.evaluate_exact(o, o).collect()}
    assert m["avg_fill_in"] != m["avg_fill_in"] and m["errors"] == 0


def test_identity_of_dominant_cluster(spark):
    o = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "read_id long, cluster_id long")
    c = spark.createDataFrame([(1, 5), (2, 5)], "read_id long, cluster_id long")
    so = spark.createDataFrame([(10, "ACGTACGT"), (20, "TTTT")], "cluster_id long, seq string")
    sc = spark.createDataFrame([(5, "ACGTACGA")], "cluster_id long, seq string")
    got = {r.orig: r.identity for r in C.cluster_identity(o, c, so, sc).collect()}
    assert got == {10: pytest.approx(7 / 8), 20: 0.0}


def rep_fixture(spark):
    seqs = {0: "A" * 310, 1: "C" * 310}
    clusters, reads = [], []
    for rep in range(3):
        for cl in range(2):
            clusters.append((rep, cl, 4, seqs[cl]))
            reads += [(rep, cl * 10 + i, cl) for i in range(4)]
    clusters.append((1, 9, 1, "G" * 200))
    reads.append((1, 99, 9))
    hits = [(r, c, o, c, 310) for r in range(3) for o in range(3) if r != o for c in range(2)]
    return (spark.createDataFrame(clusters, "rep_id int, cluster_id long, size long, seq string"),
            spark.createDataFrame(hits, "rep_id int, cluster_id long, other_rep int, neighbour_id long, score long"),
            spark.createDataFrame(reads, "rep_id int, read_id long, cluster_id long"))


def test_inexact_evaluation_of_equal_repertoires(spark):
    clusters, hits, reads = rep_fixture(spark)
    rows = P.evaluate_inexact(clusters, hits, reads, (0, 1, 2), size_cutoff=3).collect()
    value = {(r.combination, r.rep_id, r.metric): r.value for r in rows}
    assert value["0-1-2", None, "ideal"] == 2 and value["0-1-2", None, "trusted"] == 2 and value["0-1-2", None, "untrusted"] == 0
    assert value["0-1-2", None, "ideal_nt"] == 2
    assert value["0-1", 1, "isolated"] == 1 and value["0-1", 1, "short_isolated"] == 1 and value["0-1", 0, "isolated"] == 0
    assert value["0-2", 2, "max_isolated"] == 0
    assert len({r.combination for r in rows}) == 4


def test_connection_kinds(spark):
    _, _, reads = rep_fixture(spark)
    hits = spark.createDataFrame([(0, 0, 1, 0, 9), (1, 0, 0, 0, 9), (2, 1, 0, 1, 5)],
                                 "rep_id int, cluster_id long, other_rep int, neighbour_id long, score long")
    kinds = {(r.rep_a, r.a_id, r.rep_b, r.b_id): (r.kind, r.shared) for r in P.connections(hits, reads).collect()}
    assert kinds[0, 0, 1, 0] == ("close_each", 4)
    assert kinds[0, 1, 2, 1] == ("close", 4)
    assert kinds[1, 0, 2, 0] == ("distant", 4)


def test_alignment_columns_equal_pairwise_counts(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(12):
        n = rng.randrange(4, 12)
        texts = ["".join(rng.choice("ACG-") for _ in range(n)) for _ in range(rng.randrange(2, 5))]
        texts = [t if t.strip("-") else "A" * n for t in texts]
        rows += [(g, i, t) for i, t in enumerate(texts)]
        gap, bad = set(), set()
        for i, x in enumerate(texts):
            lo, hi = n - len(x.lstrip("-")), len(x.rstrip("-")) - 1
            for y in texts[i + 1:]:
                for p in range(lo, hi + 1):
                    if x[p] != y[p]:
                        (gap if "-" in (x[p], y[p]) else bad).add(p)
        want[g] = (round((n - len(gap | bad)) / n, 9), len(bad), len(gap))
    df = spark.createDataFrame(rows, "group_id int, row_id int, aligned string")
    got = {r.group_id: (round(r.identity, 9), r.mismatch_positions, r.gap_positions) for r in P.alignment_columns(df).collect()}
    assert got == want


def test_renumbering_starts_at_zero(spark):
    a = spark.createDataFrame([(5, "A", 1), (2, "C", 2)], "cluster_id long, seq string, size long")
    b = spark.createDataFrame([(2, "G", 3)], "cluster_id long, seq string, size long")
    got = sorted((r.new_id, r.seq) for r in C.renumbered_union(a, b).collect())
    assert got == [(0, "C"), (1, "A"), (2, "G")]


@pytest.mark.parametrize("k", [1, 5, 8, 9, 32])
def test_smallest_window(k):
    """the least k-mer found in one pass over numbers."""
    from strandframe.functions.alignment import smallest_window
    rng = random.Random(k)
    texts = ["A" * 50, "ACGTN" * 20, "A" * k, "T" * 33 + "A" * 40]
    texts += ["".join(rng.choice("ACGT") for _ in range(rng.randrange(k, 120))) for _ in range(60)]
    for t in texts:
        if len(t) >= k:
            assert smallest_window(t, k) == min(t[i:i + k] for i in range(len(t) - k + 1))


def test_smallest_kmer_joins_rows_of_one_id_and_leaves_short_ones_out(spark):
    from strandframe.operators.kmers import smallest_kmer
    rows = [(1, "CCGATTTT"), (1, "GGGGGACA"), (2, "ACG"), (3, None), (4, "TTTTTTTTTT")]
    got = {(r.read_id, r.sketch) for r in smallest_kmer(spark.createDataFrame(rows, "read_id int, seq string"), 4).collect()}
    assert got == {(1, "ATTT"), (4, "TTTT")}
