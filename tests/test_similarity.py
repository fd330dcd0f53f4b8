"""Collapse, similarity joins and overlaps against brute force."""

import random
from collections import Counter, defaultdict

import pytest

from strandframe.functions import alignment as A
from strandframe.operators import collapse as C
from strandframe.operators import kmers as K
from strandframe.operators import overlaps as O
from strandframe.operators import similarity as M
from test_alignment import mutate, rand


def trie_answer(reads):
    """Follow the lowest letter down from every read; count reads per end."""
    order = "ACGTN"
    seqs = {s for _, s in reads}
    first = {}
    for i, s in sorted(reads, reverse=True):
        first[s] = i
    prefixes = {s[:n] for s in seqs for n in range(len(s) + 1)}
    out = Counter()
    for _, s in reads:
        node = s
        while True:
            nxt = next((node + c for c in order if node + c in prefixes), None)
            if nxt is None:
                break
            node = nxt
        out[first[node], node] += 1
    return dict(out)


@pytest.mark.parametrize("seed", range(4))
def test_prefix_collapse_equals_trie(spark, seed):
    rng = random.Random(seed)
    reads = [(i, rand(rng.randrange(1, 7), rng, "ACN" if seed % 2 else "ACGTN")) for i in range(400)]
    got = C.prefix_collapse(spark.createDataFrame(reads, "read_id long, seq string")).collect()
    assert {(r.rep_id, r.seq): r.abundance for r in got} == trie_answer(reads)


def test_prefix_collapse_with_a_long_chain_over_many_ranges(spark):
    reads = [(i, "A" * (i + 1)) for i in range(200)] + [(1000, "A")]
    got = C.prefix_collapse(spark.createDataFrame(reads, "read_id long, seq string")).collect()
    assert [(r.rep_id, len(r.seq), r.abundance) for r in got] == [(199, 200, 201)]


def brute_best(a, b, tau):
    best = defaultdict(lambda: (-tau - 1, set()))
    for i, s in a:
        for j, t in b:
            e = A.edits_within(s, t, tau)
            if e is None:
                continue
            for key, hit in ((("a", i), j), (("b", j), i)):
                if -e > best[key][0]:
                    best[key] = (-e, {hit})
                elif -e == best[key][0]:
                    best[key][1].add(hit)
    return {(side, q, h, s) for (side, q), (s, hits) in best.items() for h in hits}


def family(rng, n, length, start):
    roots = [rand(length, rng) for _ in range(4)]
    rows = {}
    for i in range(n):
        s = mutate(rng.choice(roots), rng.randrange(5), rng)
        rows.setdefault(s[:len(s) - rng.randrange(6)], start + i)
    return [(i, s) for s, i in rows.items()]


@pytest.mark.parametrize("strategy", ["naive", "single", "pair", "triple"])
def test_strategies_find_all_best_hits(spark, strategy):
    rng = random.Random(11)
    a, b = family(rng, 40, 80, 0), family(rng, 40, 80, 1000)
    df = lambda rows: spark.createDataFrame(rows, "seq_id long, seq string")
    got = {tuple(r) for r in M.best_hits(df(a), df(b), k=8, tau=3, strategy=strategy).select("side", "q_id", "hit_id", "score").collect()}
    assert got == brute_best(a, b, 3)


def test_naive_covers_every_read_above_twice_tau(spark):
    rng = random.Random(12)
    a = [(i, s) for i, s in enumerate({rand(rng.randrange(5, 24), rng, "AC") for _ in range(60)})]
    b = [(1000 + i, s) for i, s in enumerate({rand(rng.randrange(5, 24), rng, "AC") for _ in range(60)})]
    df = lambda rows: spark.createDataFrame(rows, "seq_id long, seq string")
    got = {tuple(r) for r in M.best_hits(df(a), df(b), tau=2, strategy="naive").select("side", "q_id", "hit_id", "score").collect()}
    assert got == brute_best(a, b, 2)


def test_naive_covers_reads_up_to_twice_tau(spark):
    rng = random.Random(15)
    a = [(i, s) for i, s in enumerate(sorted({rand(rng.randrange(0, 12), rng, "AC") for _ in range(60)} | {"", "GTG"}))]
    b = [(1000 + i, s) for i, s in enumerate(sorted({rand(rng.randrange(0, 12), rng, "AC") for _ in range(60)} | {"GTG"}))]
    df = lambda rows: spark.createDataFrame(rows, "seq_id long, seq string")
    for tau in (2, 3):
        got = {tuple(r) for r in M.best_hits(df(a), df(b), tau=tau, strategy="naive").select("side", "q_id", "hit_id", "score").collect()}
        assert got == brute_best(a, b, tau), tau


def test_anchored_strategies_find_hits_of_short_reads(spark):
    rng = random.Random(16)
    a, b = ([(start + i, s[:rng.choice([5, 20, 39, 80])]) for i, s in family(rng, 25, 80, start)] for start in (0, 1000))
    a, b = ([(i, s) for s, i in {s: i for i, s in rows}.items()] for rows in (a, b))
    df = lambda rows: spark.createDataFrame(rows, "seq_id long, seq string")
    for strategy in ("single", "triple"):
        got = {tuple(r) for r in M.best_hits(df(a), df(b), k=8, tau=3, strategy=strategy).select("side", "q_id", "hit_id", "score").collect()}
        assert got == brute_best(a, b, 3), strategy


def test_kmers_of_short_reads_and_window_borders(spark):
    rng = random.Random(13)
    rows = [(0, "ACG"), (1, ""), (2, rand(700, rng)), (3, rand(K.WINDOW + 3, rng)), (4, "ACGTA")]
    got = {(r.read_id, r.pos, r.kmer) for r in K.kmer_table(spark.createDataFrame(rows, "read_id long, seq string"), 4).collect()}
    assert got == {(i, p, s[p:p + 4]) for i, s in rows for p in range(len(s) - 3)}


def test_shared_kmers_without_and_with_stop_words(spark):
    reps = [(0, 1, "ACGTACCA"), (1, 2, "TTACGTAC"), (1, 3, "ACGTTTTT"), (0, 4, "GGGGGGGG")]
    df = spark.createDataFrame(reps, "rep_id int, cluster_id long, seq string")
    every = {tuple(r) for r in K.shared_kmers(df, 4, 4).collect()}
    assert every == {(0, 1, 1, 2, -2), (0, 1, 1, 3, 0)}
    from pyspark.sql import functions as F
    few = {tuple(r) for r in K.shared_kmers(df, 4, 4, max_occurrences=F.lit(1)).collect()}
    assert few == {(0, 1, 1, 2, -2)}  # ACGT occurs twice in repertoire 1


def scores(spark, rows):
    df = spark.createDataFrame(rows, "rep_id int, cluster_id long, seq string")
    return {(r.a_id, r.b_id): r.score for r in K.scored_neighbours(df).collect()}


def test_neighbours_do_not_depend_on_repertoire_order(spark):
    rng = random.Random(5)
    long = "".join(rng.choices("ACGT", k=1400))
    inside = long[500:900]
    assert scores(spark, [(0, 1, long), (1, 2, inside)]) == {(1, 2): 400}
    assert scores(spark, [(1, 1, long), (0, 2, inside)]) == {(2, 1): 400}


def test_every_copy_of_a_family_is_a_neighbour(spark, monkeypatch):
    monkeypatch.setattr(K, "HOT_KMER", 16)  # occurrences are dealt to parts
    rng = random.Random(6)
    base = "".join(rng.choices("ACGT", k=400))
    swap = str.maketrans("ACGT", "CGTA")
    family = [(1, 100 + i, base[:3 * i] + base[3 * i].translate(swap) + base[3 * i + 1:]) for i in range(120)]
    got = scores(spark, [(0, 1, base), *family])
    assert got == {(1, i): 394 for _, i, _ in family}


def test_repeats_give_the_best_of_several_shifts(spark):
    rng = random.Random(7)
    unit = "".join(rng.choices("ACGT", k=200))
    a, b = unit * 3, unit * 2
    assert scores(spark, [(0, 1, a), (1, 2, b)]) == {(1, 2): 400}


def brute_overlaps(seqs, least):
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    out = {}
    for i, s in seqs:
        for j, t in seqs:
            if i >= j:
                continue
            for reverse, u in ((False, t), (True, rc(t))):
                for d in range(-(len(u) - 1), len(s)):
                    a, b = max(d, 0), max(-d, 0)
                    n = min(len(s) - a, len(u) - b)
                    if n >= least and s[a:a + n] == u[b:b + n]:
                        out[i, j] = (reverse, a, b, n)
                        break
                if (i, j) in out:
                    break
    return out


def test_exact_overlaps_equal_brute_force(spark):
    rng = random.Random(14)
    genome = rand(300, rng)
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    seqs = {}
    for i in range(40):
        at, n = rng.randrange(250), rng.randrange(15, 60)
        s = genome[at:at + n]
        seqs.setdefault(rc(s) if rng.random() < 0.5 else s, i)
    rows = [(i, s) for s, i in seqs.items()]
    got = O.exact_overlaps(spark.createDataFrame(rows, "seq_id long, seq string"), 12).collect()
    assert {(r.id1, r.id2): (r.reverse, r.start1, r.start2, r.overlap) for r in got} == brute_overlaps(rows, 12)
