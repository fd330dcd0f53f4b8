"""Runs of k-mers: the same k-mers and matches as one by one, without a shuffle of single k-mers."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandframe.functions import alignment as A
from strandframe.functions.minimizers import WORDS, bin_marks, core_length, kmer_runs, marked, runs
from strandframe.operators import kmers as K
from strandframe.operators import overlaps as O
from strandframe.operators import similarity as M
from test_alignment import mutate, rand


def texts(n, seed, size=700):
    r = random.Random(seed)
    return ["".join(r.choice("ACGTN" if i % 3 else "A") for _ in range(r.randrange(0, size))) for i in range(n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_runs_hold_every_kmer_once_and_equal_kmers_share_a_bin(spark):
    own = [t + t[:90] for t in texts(30, 1)]
    for k in (5, 36, 80):
        bins, seen = {}, Counter()
        for t in own:
            if len(t) < k:
                continue
            for a, z, b in zip(*runs(t, k)):
                for i in range(a, z):
                    seen[t[i:i + k]] += 1
                    assert bins.setdefault(t[i:i + k], b) == b
        assert seen == Counter(t[i:i + k] for t in own for i in range(len(t) - k + 1))
        assert core_length(k) <= k


def test_pieces_with_the_base_before(spark):
    df = spark.createDataFrame([(7, "ACGTACGGTA"), (8, "ACG"), (9, None)], "read_id int, seq string")
    got = {(r.read_id, r.at + i, r.piece[i:i + 5]) for r in kmer_runs(df, 4, ["read_id"], before="^").collect() for i in range(len(r.piece) - 4)}
    assert got == {(7, i, ("^ACGTACGGTA")[i:i + 5]) for i in range(7)}


def test_counts_of_copies_and_no_shuffle_of_kmers(spark):
    own = texts(40, 2) * 3 + [None, "", "ACGT" * 200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "read_id int, seq string")
    counted, every = K.posting_counts(df, 36), K.distinct_kmers(df, 36)
    expected = Counter(t[i:i + 36] for t in own if t for i in range(len(t) - 35))
    assert {r.kmer: r.postings for r in counted.collect()} == dict(expected)
    assert sorted(r.kmer for r in every.collect()) == sorted(expected)
    for df in (counted, every):
        assert "hashpartitioning(kmer" not in plan(df) and "hashpartitioning(bin" in plan(df)


def sets(spark, own, first=0):
    return spark.createDataFrame([(first + i, t, 1) for i, t in enumerate(own)], "seq_id int, seq string, copies int")


def test_sought_kmers_are_the_occurrences_of_the_wanted(spark):
    own = [t for t in texts(12, 3) if len(t) >= 40] + ["ACGGT" * 80]
    wanted = [own[0][:36], own[1][4:40], "ACGGT" * 7 + "A", "T" * 36]
    found = K.sought_kmers(sets(spark, own), 36, ["seq_id"], spark.createDataFrame([(w,) for w in wanted * 2], "kmer string"))
    expected = sorted((i, p) for i, t in enumerate(own) for p in range(len(t) - 35) if t[p:p + 36] in wanted)
    assert sorted((r.seq_id, r.pos) for r in found.collect()) == expected
    assert "hashpartitioning(key" not in plan(found)


def test_anchors_count_at_their_own_place_only(spark):
    a, moved = texts(1, 4, 2)[0] + "ACGTTGCAAC" * 3 + "GATTACA" * 20, "T" * 40
    a = a[:150]
    found = M.anchored_candidates(sets(spark, [a]), sets(spark, [a + "CC", moved + a], 10), 36, 0, "single")
    assert [tuple(r) for r in found.collect()] == [(0, 10)]


def test_end_counts_shuffle_ends_only(spark):
    own = texts(25, 5) + ["", None, "ACGT" * 9]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(own)] + [(None, own[0] + "ACGT" * 30)], "read_id int, seq string")
    kept = {}
    for i, t in [(i // 2, t) for i, t in enumerate(own)] + [(None, own[0] + "ACGT" * 30)]:
        for p in range(len(t or "") - 35):
            if p < 50 or p + 36 > len(t) - 50:
                kept.setdefault(i, []).append(t[p:p + 36])
    counted = K.end_counts(df, 36, 50)
    assert {r.read_id: (r.places, r.kmers) for r in counted.collect()} == {i: (len(x), len(set(x))) for i, x in kept.items()}
    assert "hashpartitioning(read_id" in plan(counted) and ", kmer" not in "".join(x for x in plan(counted).splitlines() if "Exchange" in x)


def test_overlaps_meet_without_a_shuffle_of_windows(spark, monkeypatch):
    asked, plain = [], O.sought_kmers
    monkeypatch.setattr(O, "sought_kmers", lambda *a: asked.append(1) or plain(*a))
    r = random.Random(6)
    t = "".join(r.choice("ACGT") for _ in range(500))
    found = O.exact_overlaps(sets(spark, [t[:300], t[200:]]), 60).collect()
    assert [(x.id1, x.id2, x.reverse, x.start1, x.start2, x.overlap) for x in found] == [(0, 1, False, 200, 0, 100)] and asked


def test_prices_are_counts_of_kmers_in_the_other_set(spark):
    rng = random.Random(11)
    common = rand(90, rng)
    own = [rand(rng.randrange(20, 200), rng) + common for _ in range(30)] + ["A" * 900, "ACGT" * 100]
    other = [common * 3, "A" * 700, common[10:70], rand(400, rng)]
    counts = Counter(t[i:i + 36] for t in other for i in range(len(t) - 35))
    got = {r.q_id: r.costs for r in M._costs(sets(spark, own), sets(spark, other), 36).collect()}
    assert got == {n: [counts[s[i:i + 36]] for i in range(len(s) - 35)] for n, s in enumerate(own) if len(s) >= 36}


def test_kmers_of_a_bin_over_several_batches(spark):
    """Small batches: a bin whose rows are split keeps what was told; others are forgotten."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        own = ["A" * (700 + n) for n in range(12)] + ["ACGTTGCA" * 30]
        got = {r.q_id: r.costs for r in M._costs(sets(spark, own), sets(spark, own[:5]), 36).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    total = sum(700 + n - 35 for n in range(5))
    assert got == {n: [total if s[0:2] == "AA" else 0] * (len(s) - 35) for n, s in enumerate(own)}


@pytest.mark.parametrize("tau", [0, 1, 3])
def test_outlines_rule_out_no_pair_within_the_bound(spark, tau):
    rng = random.Random(tau)
    rows = []
    for _ in range(300):
        s = rand(rng.randrange(0, 400), rng)
        t = s
        for _ in range(rng.randrange(0, tau + 1)):
            t = mutate(t, 1, rng)
        rows.append((s, t[:rng.randrange(len(t) + 1)] if rng.random() < 0.3 else t + rand(rng.randrange(9), rng), rand(len(s) + 20, rng)))
    df = spark.createDataFrame(rows, "a string, b string, c string")
    ask = lambda x, y: A.outlines_agree(A.outline(x), A.outline(y), F.least(F.length(x), F.length(y)), tau)
    got = df.select("a", "b", ask("a", "b").alias("ab"), ask("a", "c").alias("ac")).collect()
    assert all(r.ab for r in got if A.edits_within(r.a, r.b, tau) is not None)
    assert sum(r.ac for r in got if len(r.a) > 60) < 60


def test_pairs_with_like_outlines_only_are_scored(spark):
    """A start that many reads share made every pair of them move both sequences."""
    rng = random.Random(5)
    start = rand(200, rng)
    a, b = ([start + rand(400, rng) for _ in range(12)] for _ in range(2))
    b[3] = a[4]
    pairs = spark.createDataFrame([(i, j) for i in range(12) for j in range(12)], "a_id int, b_id int")
    assert M._outlined(pairs, sets(spark, a), sets(spark, b), 3).count() < 40
    assert [(r.a_id, r.b_id, r.score) for r in M.score_pairs(pairs, sets(spark, a), sets(spark, b), 3).collect()] == [(4, 3, 0)]


def test_near_copies_travel_to_blocks_and_not_to_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = rand(300, rng)
    a, b = ([mutate(base, rng.randrange(4), rng) for _ in range(40)] for _ in range(2))
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(40)], "a_id int, b_id int")
    monkeypatch.setattr(M, "BLOCK", 16)
    blocks = M._blocks(pairs)
    assert blocks.select("g", "ca", "cb", "a_id").distinct().count() <= 3 * 40 and blocks.count() == 1600
    for tau in (0, 3):
        got = sorted(map(tuple, M.score_pairs(pairs, sets(spark, a), sets(spark, b), tau).collect()))
        assert got == sorted((i, j, -e) for i, x in enumerate(a) for j, y in enumerate(b) if (e := A.edits_within(x, y, tau)) is not None)


def test_ids_that_repeat_and_ids_that_are_missing_are_scored_as_joined(spark):
    a = spark.createDataFrame([(1, "ACGT"), (1, "ACGG"), (None, "ACGT"), (5, None)], "seq_id int, seq string")
    b = spark.createDataFrame([(2, "ACGTA"), (3, "TTTTTTTT"), (4, None)], "seq_id int, seq string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (None, 2), (7, 2), (5, 2), (1, 4)], "a_id int, b_id int")
    assert sorted(map(tuple, M.score_pairs(pairs, a, b, 1).collect())) == [(1, 2, -1), (1, 2, 0)]


def test_only_runs_with_a_wanted_bin_travel(spark):
    own = texts(40, 9, 900)
    reads = spark.createDataFrame(list(enumerate(own)), "seq_id int, seq string")
    wanted = spark.createDataFrame([(own[i][5:25],) for i in range(0, 40, 8) if len(own[i]) > 25] + [("A" * 20,), (None,), ("AC",)], "kmer string")
    asked = kmer_runs(wanted, 20, [], "kmer").select("bin")
    bins = {r.bin for r in asked.collect()}
    every = [tuple(r) for r in kmer_runs(reads, 20, ["seq_id"]).collect()]
    some = [tuple(r) for r in kmer_runs(reads, 20, ["seq_id"], marks=bin_marks(asked)).collect()]
    assert sorted(some) == sorted(r for r in every if r[1] in bins) and 0 < len(some) < len(every) / 2
    found = sorted((r.seq_id, r.pos) for r in K.sought_kmers(reads, 20, ["seq_id"], wanted).collect())
    sought = {r.kmer for r in wanted.collect()}
    assert found == [(i, p) for i, s in enumerate(own) for p in range(len(s) - 19) if s[p:p + 20] in sought]


def test_no_marks_and_marks_of_any_bin():
    none = np.zeros(WORDS, np.uint64)
    bins = np.array([0, -1, 1 << 40, -(1 << 63), 12345], np.int64)
    assert not marked(bins, none).any() and marked(bins, ~none).all()


def test_overlap_clusters_of_copies_and_missing_sequences(spark):
    rng = random.Random(8)
    base = rand(400, rng)
    rows = [(1, base), (2, base), (3, base[150:] + rand(50, rng)), (4, rand(300, rng)), (5, "ACGT"), (6, "ACGT"), (7, None), (8, None)]
    found = O.cluster_overlaps(spark.createDataFrame(rows, "read_id int, seq string"))
    assert {tuple(r) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 5)}
    assert "hashpartitioning(seq" not in plan(found)  # sequences travel once, reads meet theirs over digests


def test_places_of_a_pair_are_compared_together(spark):
    """Two repeats meet at many places of either strand; their sequences travel once."""
    unit = "ACCT" * 30
    rows = [(1, "G" + unit + "GG"), (2, unit + "TT"), (3, "TTTT" + unit), (4, unit[:60] + "C" * 20)]
    found = O.exact_overlaps(spark.createDataFrame(rows, "seq_id int, seq string"), 12)
    assert "collect_list" in plan(found)
    assert sorted(map(tuple, found.collect())) == brute_cuts(rows, 12)


def brute_cuts(rows, least):
    out = []
    for i, x in rows:
        for j, y in rows:
            if i < j:
                z, ways = y.translate(str.maketrans("ACGT", "TGCA"))[::-1], []
                for back, t in ((False, y), (True, z)):
                    for d in range(-len(t) + least, len(x) - least + 1):
                        a, b = max(d, 0), max(-d, 0)
                        n = min(len(x) - a, len(t) - b)
                        if n >= least and x[a:a + n] == t[b:b + n]:
                            ways.append((back, d, a, b, n))
                if ways:
                    back, _, a, b, n = min(ways)
                    out.append((i, j, back, a, b, n))
    return sorted(out)


@pytest.mark.parametrize("tau", [0, 3])
def test_only_what_a_score_looks_at_goes_to_a_block(spark, monkeypatch, tau):
    """Long reads meet short ones with as many bases as count; the scores are those of the whole reads."""
    rng = random.Random(12 + tau)
    long = [rand(900, rng) for _ in range(4)]
    short = [mutate(x[:rng.randrange(20, 60)], rng.randrange(tau + 1), rng) for x in long for _ in range(3)] + ["A", "ACG"]
    rows, sent = set(), M.F.substr
    monkeypatch.setattr(M.F, "substr", lambda *a: rows.add(str(a[2])) or sent(*a))
    a, b = sets(spark, long + short[:4]), sets(spark, short + long[:2])
    pairs = a.select(F.col("seq_id").alias("a_id")).crossJoin(b.select(F.col("seq_id").alias("b_id")))
    got = sorted(map(tuple, M.score_pairs(pairs, a, b, tau).collect()))
    ids = lambda df: [(r.seq_id, r.seq) for r in df.collect()]
    assert got == sorted((i, j, -e) for i, x in ids(a) for j, y in ids(b) if (e := A.edits_within(x, y, tau)) is not None)
    assert any("_cut" in r for r in rows)


def test_first_difference_in_blocks_of_any_size():
    rng = random.Random(3)
    for n in (1, 2, 63, 64, 65, 200, 700):
        a = rand(n, rng)
        for at in sorted({0, 1, n // 2, n - 1, 62, 63, 64} & set(range(n))):
            b = a[:at] + "N" + a[at + 1:]
            assert A._agreeing(a.encode(), 0, b.encode(), 0) == at
        assert A._agreeing(a.encode(), 0, (a + "C").encode(), 0) == n
