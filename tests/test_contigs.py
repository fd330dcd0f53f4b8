"""Contigs against worked examples and a plain walk over the graph."""

import random
from collections import Counter

import pytest

from strandframe.operators import contigs as C


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def found(spark, reads, k, flank=3):
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    return C.contigs(df, k, flank).collect()


def walked(reads, k, flank):
    """id -> (conj, length, coverage, start, end, seq) by walking from every first edge."""
    n = Counter()
    for s in reads:
        for i in range(len(s or "") - k):
            e = s[i:i + k + 1]
            if set(e) <= set("ACGT"):
                for x in {e, rc(e)}:
                    n[x] += 1
    after, before = {}, {}
    for e in n:
        after.setdefault(e[:-1], []).append(e)
        before.setdefault(e[1:], []).append(e)
    inner = {v for v in after if len(after[v]) == 1 and len(before.get(v, [])) == 1}
    paths, seen = [], set()

    def walk(e, stops):
        path = [e]
        while path[-1][1:] in inner and (nxt := after[path[-1][1:]][0]) not in stops:
            path.append(nxt)
        paths.append(path)
        seen.update(path)
    for e in sorted(n):
        if e[:-1] not in inner:
            walk(e, ())
    for e in sorted(n):
        if e in seen:
            continue
        ring = [e]
        while (nxt := after[ring[-1][1:]][0]) != e:
            ring.append(nxt)
        low = min(min(x, rc(x)) for x in ring)
        stops = {x for x in ring if x == low or before[x[:-1]][0] == rc(low)}
        for x in stops:
            walk(x, stops)
    mean = lambda p: sum(n[e] for e in p) / len(p)
    return {p[0]: (rc(p[-1]), len(p), mean(p), mean(p[:flank]), mean(p[-flank:]), p[0] + "".join(e[-1] for e in p[1:])) for p in paths}


@pytest.mark.parametrize("reads, want", [
    (["ACAAACCACCC", "AAACCACCCAC"], {"ACAAACCACCCAC"}),
    (["ACAAACCACCA", "ACAAACAACCC"], {"ACAAAC", "CAAACCACCA", "CAAACAACCC"}),
    (["CGAAACCAC", "CGAAAACAC", "AACCACACC", "AAACACACC"], {"CGAAAACACAC", "CACACC", "CGAAACCACAC"}),
])
def test_worked_examples(spark, reads, want):
    rows = found(spark, reads, 5)
    assert {r.seq for r in rows} == want | {rc(s) for s in want}
    assert len(rows) == len({r.seq for r in rows})


def test_contigs_equal_plain_walk(spark):
    rng = random.Random(21)
    rand = lambda n: "".join(rng.choices("ACGT", k=n))
    genome, ring, small = rand(900), rand(70), rand(8)
    reads = [genome[i:i + 60] for i in rng.choices(range(840), k=120)]
    reads = [rc(s) if rng.random() < 0.5 else s for s in reads]
    reads += [(ring * 2)[i:i + 40] for i in range(0, 70, 9)] + [small * 3, "ACGTNACGTTTA", "A" * 30, "", None, "ACG"]
    want = walked(reads, 9, 3)
    rows = found(spark, reads, 9)
    assert {r.contig_id: (r.conj_id, r.length, r.coverage, r.start_coverage, r.end_coverage, r.seq) for r in rows} == want
    assert len(rows) == len(want)
    by_id = {r.contig_id: r for r in rows}
    assert all(by_id[r.conj_id].seq == rc(r.seq) for r in rows)


def test_long_contig_in_pieces_and_closed_path(spark, monkeypatch):
    monkeypatch.setattr(C, "PIECE", 16)
    rng = random.Random(22)
    ring = "".join(rng.choices("ACGT", k=200))
    rows = found(spark, [ring + ring[:15]], 15)
    assert {r.contig_id: (r.conj_id, r.length, r.coverage, r.start_coverage, r.end_coverage, r.seq) for r in rows} == walked([ring + ring[:15]], 15, 3)
    assert len(rows) == 2 and {len(r.seq) for r in rows} == {215}


def test_no_reads_and_even_k(spark):
    assert found(spark, ["AC", None], 5) == []
    with pytest.raises(ValueError):
        found(spark, ["ACGTACGT"], 4)
