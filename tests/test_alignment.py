"""Alignment kernels against direct definitions."""

import itertools
import random

import numpy as np
import pytest

from strandframe.functions import alignment as A

LOW = -10**9


def rand(n, rng, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def mutate(s, edits, rng):
    s = list(s)
    for _ in range(edits):
        kind, at = rng.choice("sid"), rng.randrange(len(s)) if s else 0
        if kind == "i" or not s:
            s.insert(at, rng.choice("ACGT"))
        elif kind == "d":
            s.pop(at)
        else:
            s[at] = rng.choice("ACGT")
    return "".join(s)


def half_banded(a, b, band):
    if band == 0:
        return -sum(x != y for x, y in zip(a, b))
    cell = {(0, 0): 0}
    best = LOW
    for i in range(len(a) + 1):
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            options = [cell[i, j]] if (i, j) in cell else []
            if i and j and (i - 1, j - 1) in cell:
                options.append(cell[i - 1, j - 1] - (a[i - 1] != b[j - 1]))
            if i and (i - 1, j) in cell:
                options.append(cell[i - 1, j] - 1)
            if j and (i, j - 1) in cell:
                options.append(cell[i, j - 1] - 1)
            if options:
                cell[i, j] = max(options)
                if i == len(a) or j == len(b):
                    best = max(best, cell[i, j])
    return best


def test_half_banded_scores_match_the_plain_program():
    rng = random.Random(1)
    pairs = [("", ""), ("", "ACGT"), ("AC", ""), ("A", "CGTACGT")]
    for _ in range(150):
        a = rand(rng.randrange(0, 30), rng)
        pairs.append((a, mutate(a, rng.randrange(4), rng) if rng.random() < 0.7 else rand(rng.randrange(0, 30), rng)))
    for band in (0, 1, 3, 5):
        got = A.half_banded_scores([p[0] for p in pairs], [p[1] for p in pairs], band)
        assert got.tolist() == [half_banded(a, b, band) for a, b in pairs]


def test_bounded_edits_agree_with_the_banded_score():
    rng = random.Random(2)
    for _ in range(400):
        a = rand(rng.randrange(0, 200), rng)
        b = mutate(a, rng.randrange(6), rng) + rand(rng.randrange(4), rng)
        for tau in (0, 1, 3):
            score = half_banded(a, b, tau)
            assert A.edits_within(a, b, tau) == (-score if score >= -tau else None)


def test_chosen_positions_are_cheapest_and_latest():
    rng = random.Random(3)
    for _ in range(200):
        k, count = rng.randrange(1, 4), rng.randrange(1, 4)
        n = k * count + rng.randrange(6) - k + 1
        costs = [rng.randrange(4) for _ in range(n)]
        chosen = A.choose_positions(np.array(costs), k, count)
        legal = [c for c in itertools.combinations(range(n), count) if all(y - x >= k for x, y in zip(c, c[1:]))]
        least = min(sum(costs[i] for i in c) for c in legal)
        assert tuple(chosen) == max((c for c in legal if sum(costs[i] for i in c) == least), key=lambda c: c[::-1])


def test_too_short_reads_have_no_anchors():
    assert A.choose_positions(np.array([1, 1]), 3, 2) == []


@pytest.mark.parametrize("swaps", [False, True])
def test_edit_distance(swaps):
    def plain(a, b):
        m = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                m[i][j] = min(m[i - 1][j] + 1, m[i][j - 1] + 1, m[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if swaps and i > 2 and j > 2:
                    m[i][j] = min(m[i][j], m[i - 2][j - 2] + 1 + (a[i - 2] != b[j - 1]) + (a[i - 1] != b[j - 2]))
        return m[-1][-1]
    rng = random.Random(4)
    for _ in range(150):
        a, b = rand(rng.randrange(12), rng), rand(rng.randrange(12), rng)
        assert A.edit_distance(a, b, swaps) == plain(a, b)


def test_local_similarity():
    assert A.local_similarity("TTACGTTT", "GGACGTGG") == (4, 4)
    assert A.local_similarity("AAAA", "CCCC") == (0, 0)


def test_affine_alignment_scores_its_own_rows():
    rng = random.Random(5)
    for _ in range(60):
        a = rand(rng.randrange(1, 40), rng)
        b = mutate(a, rng.randrange(8), rng) or "A"
        score, one, two = A.affine_global(a, b)
        assert one.replace("-", "") == a and two.replace("-", "") == b and len(one) == len(two)
        total, gap = 0.0, None
        for x, y in zip(one, two):
            side = 1 if x == "-" else 2 if y == "-" else None
            if side is None:
                total += 1 if x == y else -0.1
            else:
                total += -0.5 if gap == side else -10
            gap = side
        assert total == pytest.approx(score)


def test_banded_overlap_counts():
    assert A.banded_overlap("AACGTACGT", "CGTACGTTT", 2) == (7, 7, 0, 0)
    score, same, wrong, gaps = A.banded_overlap("ACGTACGTAC", "ACGTTACGTAC", 2)
    assert (score, same, wrong, gaps) == (0, 10, 0, 1)


def test_shift_alignment_finds_the_other_strand():
    rng = random.Random(6)
    core = rand(400, rng)
    shifted = core[20:] + rand(20, rng)
    score, shift, errors, same = A.shift_alignment(core, shifted)
    assert (score, shift, errors, same) == (380, 20, 0, True)
    flipped = shifted.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert A.shift_alignment(core, flipped)[3] is False
    assert A.shift_alignment("ACGT", core) == (-100000, 0, 100000, True)


def test_best_shift_matches():
    assert A.best_shift_matches("ACGTACGTAA", "ACGTACGTAA") == 10
    assert A.best_shift_matches("AAAACCCC", "GGGGTTTT") == 8
    assert A.best_shift_matches("ACGT", "") == 0


def mixed_pairs(rng, count=120):
    pairs = [("", ""), ("", "ACG"), ("AC", ""), ("A", "CCCC"), ("ACGTT" * 9, "A")]
    for _ in range(count):
        a = rand(rng.randrange(0, 40), rng)
        pairs.append((a, mutate(a, rng.randrange(6), rng) if rng.random() < 0.6 else rand(rng.randrange(0, 40), rng)))
    return pairs


@pytest.mark.parametrize("cells", [1, 60, 1 << 16])
def test_many_pairs_at_once_give_what_each_gives_alone(cells, monkeypatch):
    """pairs of unlike lengths share arrays; results do not depend on which ones share them."""
    monkeypatch.setattr(A, "DIAGONAL", cells)
    pairs = mixed_pairs(random.Random(8))
    one, two = [p[0] for p in pairs], [p[1] for p in pairs]
    for swaps in (True, False):
        assert A.edit_distances(one, two, swaps).tolist() == [A.edit_distance(a, b, swaps) for a, b in pairs]
    assert A.local_similarities(one, two) == [A.local_similarity(a, b) for a, b in pairs]
    assert A.affine_globals(one, two) == [A.affine_global(a, b) for a, b in pairs]


def plain_local(a, b):
    grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            grid[i][j] = max(0, grid[i - 1][j] - 1, grid[i][j - 1] - 1, grid[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1))
    top = max(max(r) for r in grid)
    i, j = next((i, j) for i, r in enumerate(grid) for j, v in enumerate(r) if v == top)
    end = i, j
    while grid[i][j]:
        if grid[i][j] == grid[i][j - 1] - 1:
            j -= 1
        elif grid[i][j] == grid[i - 1][j] - 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
    return top, min(end[0] - i, end[1] - j)


def plain_affine_score(a, b):
    best = {(0, 0): {"d": 0}}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            here = best.setdefault((i, j), {})
            if i and j and best[i - 1, j - 1]:
                here["d"] = max(best[i - 1, j - 1].values()) + (10 if a[i - 1] == b[j - 1] else -1)
            if i:
                here["v"] = max(v - (5 if g == "v" else 100) for g, v in best[i - 1, j].items())
            if j:
                here["h"] = max(v - (5 if g == "h" else 100) for g, v in best[i, j - 1].items())
    return max(best[len(a), len(b)].values()) / 10


def test_many_pairs_at_once_match_the_plain_programs():
    pairs = mixed_pairs(random.Random(9), 60)
    one, two = [p[0] for p in pairs], [p[1] for p in pairs]
    assert A.local_similarities(one, two) == [plain_local(a, b) for a, b in pairs]
    for (a, b), (score, x, y) in zip(pairs, A.affine_globals(one, two)):
        assert score == plain_affine_score(a, b)
        assert (x.replace("-", ""), y.replace("-", ""), len(x)) == (a, b, len(y))
