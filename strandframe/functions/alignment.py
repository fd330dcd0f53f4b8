"""Alignment scores that built-in functions cannot express, as Arrow UDFs.

Each UDF scores the pairs of one Arrow batch; Spark decides which pairs meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from strandframe.functions import sequences as S

LOW = -(1 << 28)
CELLS = 1 << 24  # padded bases handled at once inside one batch
DIAGONAL = 1 << 16  # cells of one diagonal handled at once, over all pairs of a group


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii"), dtype=np.uint8)


def _padded(seqs: list[str], width: int, fill: int) -> np.ndarray:
    out = np.full((len(seqs), width), fill, dtype=np.uint8)
    for row, s in enumerate(seqs):
        out[row, :len(s)] = _codes(s)
    return out


def _length_groups(lengths: np.ndarray):
    """Row groups of similar length whose padded size stays bounded."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * (lengths[order[stop]] + 1) <= CELLS:
            stop += 1
        yield order[start:stop]
        start = stop


def half_banded_scores(s1: list[str], s2: list[str], band: int) -> np.ndarray:
    """Both sequences start together, either may end freely; mismatch and indel cost 1."""
    n1 = np.array([len(s) for s in s1])
    n2 = np.array([len(s) for s in s2])
    result = np.zeros(len(s1), dtype=np.int64)
    shift = np.arange(-band, band + 1)
    for group in _length_groups(np.maximum(n1, n2)):
        a1, a2 = n1[group], n2[group]
        width = int(max(a1.max(initial=0), a2.max(initial=0))) + band + 1
        x = _padded([s1[i] for i in group], width, 1)
        y = _padded([s2[i] for i in group], width, 2)
        if band == 0:
            inside = np.arange(width) < np.minimum(a1, a2)[:, None]
            result[group] = -((x != y) & inside).sum(axis=1)
            continue
        row = np.where(shift >= 0, -shift, LOW)[None, :].repeat(len(group), axis=0)
        row[shift[None, :] > a2[:, None]] = LOW
        best = np.where(np.minimum(a1, a2) == 0, 0, LOW)
        # an empty first sequence or a second one inside the band ends in row 0
        ends = (shift[None, :] >= 0) & ((shift[None, :] == a2[:, None]) | (a1 == 0)[:, None])
        best = np.maximum(best, np.where(ends, row, LOW).max(axis=1))
        for i in range(1, int(a1.max(initial=0)) + 1):
            j = i + shift
            legal = (j[None, :] >= 0) & (j[None, :] <= a2[:, None])
            at = np.clip(j - 1, 0, width - 1)
            differs = x[:, i - 1][:, None] != y[:, at]
            step = np.where(j[None, :] >= 1, row - differs, LOW)
            step[:, :-1] = np.maximum(step[:, :-1], row[:, 1:] - 1)
            step[~legal] = LOW
            step = np.maximum.accumulate(step + shift, axis=1) - shift
            step[~legal] = LOW
            live = i <= a1
            done = live[:, None] & legal & ((j[None, :] == a2[:, None]) | (i == a1)[:, None])
            best = np.maximum(best, np.where(done, step, LOW).max(axis=1))
            row = step
        result[group] = best
    return result


def _agreeing(a: bytes, i: int, b: bytes, j: int) -> int:
    """Length of the common stretch of ``a[i:]`` and ``b[j:]``."""
    total, block = 0, 64
    limit = min(len(a) - i, len(b) - j)
    while total < limit:
        size = min(block, limit - total)
        left, right = a[i + total:i + total + size], b[j + total:j + total + size]
        if left == right:
            total += size
            block *= 2
        elif size == 1:
            break
        elif size <= 64:
            unlike = int.from_bytes(left, "little") ^ int.from_bytes(right, "little")
            return total + ((unlike & -unlike).bit_length() - 1) // 8
        else:
            block = max(64, size // 4)
    return total


def edits_within(s1: str, s2: str, tau: int) -> int | None:
    """Fewest edits of the half-banded alignment when at most ``tau``, else None.

    Per number of edits only the furthest cell of each diagonal matters, so long
    equal stretches are skipped at once.
    """
    a, b = s1.encode("ascii"), s2.encode("ascii")
    reach: dict[int, int] = {}
    for edits in range(tau + 1):
        nxt: dict[int, int] = {}
        for d in range(-edits, edits + 1):
            if edits == 0:
                i = 0
            else:
                i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2), reach.get(d + 1, -2) + 1)
            if i < 0 or i + d < 0:
                continue
            i = min(i, len(a), len(b) - d)
            if i < 0 or i + d < 0:
                continue
            i += _agreeing(a, i, b, i + d)
            if i == len(a) or i + d == len(b):
                return edits
            nxt[d] = i
        reach = nxt
    return None


def choose_positions(costs: np.ndarray, k: int, count: int) -> list[int]:
    """``count`` window starts at least ``k`` apart with the least total cost.

    Ties are decided for the latest position, from the last window backwards.
    """
    n = len(costs)
    if n + k - 1 < count * k:
        return []
    costs = np.asarray(costs, dtype=np.int64)
    far = np.iinfo(np.int64).max // 4
    taken, best = [costs], [np.minimum.accumulate(costs)]
    for _ in range(1, count):
        take = np.full(n, far)
        take[k:] = costs[k:] + best[-1][:-k]
        taken.append(take)
        best.append(np.minimum.accumulate(take))
    chosen, stop = [], n
    for level in range(count - 1, -1, -1):
        at = int(np.nonzero(taken[level][:stop] == best[level][stop - 1])[0][-1])
        chosen.append(at)
        stop = at - k + 1
    return chosen[::-1]


def smallest_window(text: str, k: int) -> str:
    """The least of all stretches of ``k`` bytes, compared as bytes; ``text`` holds at least one.

    Starts are told apart by their first eight bytes, read as numbers from each of eight offsets.
    """
    raw = text.encode("utf-8")
    starts = range(len(raw) - k + 1)
    if k >= 8:
        heads = [np.frombuffer(raw, ">u8", (len(raw) - at - k) // 8 + 1, at).astype(np.uint64) for at in range(min(8, len(starts)))]
        least = min(h.min() for h in heads)
        starts = [at + 8 * i for at, h in enumerate(heads) for i in np.flatnonzero(h == least).tolist()]
    return min(raw[p:p + k] for p in starts).decode("utf-8")


def best_shift_matches(s1: str, s2: str) -> int:
    """Most matches over all relative shifts of both strands.

    The smallest error count seen is carried from shift to shift, and the scan
    stops once no shift can improve; both are part of the definition.
    """
    x = _codes(s1)
    strands = (_codes(s2), _codes(s2.translate(str.maketrans("ACGTN", "TGCAN"))[::-1]))
    short = min(len(x), len(strands[0]))
    errors, matches = short, 0

    def fewer(a, b, current):
        size = min(len(a), len(b))
        if current == 0:
            return 0 if np.array_equal(a[:size], b[:size]) else min(size, current)
        wrong = int(np.count_nonzero(a[:size] != b[:size]))
        return min(size if wrong > current else wrong, current)

    for shift in range(short):
        left, right = min(len(x), len(strands[0]) - shift), min(len(x) - shift, len(strands[0]))
        if max(left, right) <= matches:
            break
        for y in strands:
            errors = fewer(x, y[shift:], errors)
        if errors != short:
            matches = max(matches, left - errors)
        if shift:
            for y in strands:
                errors = fewer(x[shift:], y, errors)
        if errors != short:
            matches = max(matches, right - errors)
    return matches


def _best_shift(x: np.ndarray, y: np.ndarray, max_errors: int, min_overlap: int, penalty: int):
    best, at, errs = -100000, 0, 100000
    for shift in range(len(x) - min_overlap):
        size = min(len(x) - shift, len(y))
        if size < best:
            break
        wrong = int(np.count_nonzero(x[shift:shift + size] != y[:size]))
        if wrong <= max_errors and size - penalty * wrong > best:
            best, at, errs = size - penalty * wrong, shift, wrong
    return best, at, errs


def shift_alignment(s1: str, s2: str, max_errors: int = 100, min_overlap: int = 300, penalty: int = 10):
    """Best gapless placement ``(score, shift, errors, same strand)`` over both strands."""
    if len(s1) < min_overlap or len(s2) < min_overlap:
        return -100000, 0, 100000, True
    x = _codes(s1)
    found = []
    for y in (_codes(s2), _codes(s2.translate(str.maketrans("ACGTN", "TGCAN"))[::-1])):
        one = _best_shift(x, y, max_errors, min_overlap, penalty)
        two = _best_shift(y, x, max_errors, min_overlap, penalty)
        found.append(one if one[0] >= two[0] else (two[0], -two[1], two[2]))
    return (*found[0], True) if found[0][0] >= found[1][0] else (*found[1], False)


def _pair_groups(n1: np.ndarray, n2: np.ndarray, held: int = 0):
    """Rows of pairs alike in both lengths, few enough for the cache; with ``held`` a group's grid has at most so many cells, or one pair."""
    if not len(n1):
        return
    usual = max(1, DIAGONAL // (int(n1.mean()) + 1))
    for strip in np.array_split(np.argsort(n1, kind="stable"), max(1, round((len(n1) / usual) ** 0.5))):
        strip = strip[np.argsort(n2[strip], kind="stable")]
        width, start = int(n1[strip].max()) + 1, 0
        while start < len(strip):
            count = max(1, DIAGONAL // width)
            if held:
                longest = int(n2[strip[min(start + count, len(strip)) - 1]]) + 1
                count = max(1, min(count, held // ((width + longest) * min(width, longest))))
            yield strip[start:start + count]
            start += count


def _paired(s1: list[str], s2: list[str], group: np.ndarray, w1: int, w2: int):
    """Both sides of a group, the second one backwards: along a diagonal both are then read forwards."""
    return _padded([s1[i] for i in group], w1, 1), np.ascontiguousarray(_padded([s2[i] for i in group], w2, 2)[:, ::-1])


def edit_distances(s1: list[str], s2: list[str], transpositions: bool = True) -> np.ndarray:
    """Edit distances; swaps of neighbours count 1 from the third base on.

    All pairs of a group go from diagonal to diagonal together.  A cell looks at smaller places only, so
    what pads the shorter pairs has no effect on them.
    """
    n1, n2 = np.array([len(s) for s in s1], int), np.array([len(s) for s in s2], int)
    result = np.zeros(len(n1), np.int64)
    for group in _pair_groups(n1, n2):
        a1, a2 = n1[group], n2[group]
        w1, w2 = int(a1.max()), int(a2.max())
        x, y = _paired(s1, s2, group, w1, w2)
        rows = [np.zeros((len(group), w1 + 1), np.int16 if w1 + w2 < 30_000 else np.int32) for _ in range(5)]
        for d in range(w1 + w2 + 1):
            row, one, two, four = (rows[(d - back) % 5] for back in (0, 1, 2, 4))
            p, q, r = max(d - w2, 1), min(w1, d - 1), w2 - d  # y[:, r + i] belongs to place d - i
            if p <= q:
                best = np.minimum(one[:, p - 1:q], one[:, p:q + 1])
                best += 1
                np.minimum(best, two[:, p - 1:q] + (x[:, p - 1:q] != y[:, r + p:r + q + 1]), out=best)
                u, v = max(p, 3), min(q, d - 3)
                if transpositions and u <= v:
                    swap = four[:, u - 2:v - 1] + (x[:, u - 2:v - 1] != y[:, r + u:r + v + 1])
                    swap += x[:, u - 1:v] != y[:, r + u + 1:r + v + 2]
                    swap += 1
                    np.minimum(best[:, u - p:v - p + 1], swap, out=best[:, u - p:v - p + 1])
                row[:, p:q + 1] = best
            if d <= w2:
                row[:, 0] = d
            if d <= w1:
                row[:, d] = d
            ended = np.flatnonzero(a1 + a2 == d)
            result[group[ended]] = row[ended, a1[ended]]
    return result


def edit_distance(s1: str, s2: str, transpositions: bool = True) -> int:
    return int(edit_distances([s1], [s2], transpositions)[0])


def _places(w1: int, w2: int) -> list[int]:
    """Where the cells of each diagonal begin in a grid kept by diagonals, less the smallest first index on it."""
    width = min(w1, w2) + 1
    return [d * width - max(0, d - w2) for d in range(w1 + w2 + 1)]


def local_similarities(s1: list[str], s2: list[str]) -> list[tuple[int, int]]:
    """Best local scores (+1 / -1 / -1) and the shorter sides of these alignments.

    The first of equal ends counts, and on the way back a step along the second sequence goes before one along the first.
    """
    n1, n2 = np.array([len(s) for s in s1], int), np.array([len(s) for s in s2], int)
    result: list = [(0, 0)] * len(n1)
    for group in _pair_groups(n1, n2, CELLS * 4):
        w1, w2 = int(n1[group].max()), int(n2[group].max())
        x, y = _paired(s1, s2, group, w1, w2)
        kind = np.int16 if min(w1, w2) < 30_000 else np.int32
        rows = [np.zeros((len(group), w1 + 1), kind) for _ in range(3)]
        best, best_at = np.zeros((len(group), w1 + 1), kind), np.zeros((len(group), w1 + 1), np.int32)
        ways = np.zeros((len(group), w1 + w2 + 1, min(w1, w2) + 1), np.uint8)  # 0 ends, 1 along the second, 2 along the first, 3 both
        for d in range(2, w1 + w2 + 1):
            row, one, two = (rows[(d - back) % 3] for back in (0, 1, 2))
            low, r = max(d - w2, 0), w2 - d
            p, q = max(low, 1), min(w1, d - 1)
            left, up = one[:, p:q + 1] - 1, one[:, p - 1:q] - 1
            new = two[:, p - 1:q] - 1
            new += (x[:, p - 1:q] == y[:, r + p:r + q + 1]) * kind(2)
            np.maximum(new, left, out=new)
            np.maximum(new, up, out=new)
            np.maximum(new, 0, out=new)
            not_left = new != left
            way = not_left.view(np.uint8) + (not_left & (new != up)).view(np.uint8)
            way += 1
            way *= new > 0
            ways[:, d, p - low:q - low + 1] = way
            better = new > best[:, p:q + 1]
            np.maximum(best[:, p:q + 1], new, out=best[:, p:q + 1])
            np.copyto(best_at[:, p:q + 1], d, where=better)
            row[:, p:q + 1] = new
            row[:, 0] = 0
            if d <= w1:
                row[:, d] = 0
        places, ends = _places(w1, w2), best.argmax(axis=1)
        for k, (pair, end) in enumerate(zip(group.tolist(), ends.tolist())):
            way, i, stop = ways[k].tobytes(), end, int(best_at[k, end])
            d = stop
            while step := way[places[d] + i]:
                d -= 2 if step == 3 else 1
                i -= step > 1
            result[pair] = int(best[k, end]), min(end - i, (stop - end) - (d - i))
    return result


def local_similarity(s1: str, s2: str) -> tuple[int, int]:
    """Best local score (+1 / -1 / -1) and the shorter side of that alignment."""
    return local_similarities([s1], [s2])[0]


def affine_globals(s1: list[str], s2: list[str], match=1.0, mismatch=-0.1, gap_open=-10.0, gap_extend=-0.5) -> list[tuple[float, str, str]]:
    """Global alignments with affine gaps: ``(score, row 1, row 2)``.

    Scores are kept in tenths so that comparisons are exact.  Among equal paths
    the one preferring a diagonal step from the end is taken.  A cell keeps one byte: the states
    from which its best value, a step along the first and one along the second sequence come.
    """
    m, x, o, e = (int(round(10 * v)) for v in (match, mismatch, gap_open, gap_extend))
    n1, n2 = np.array([len(s) for s in s1], int), np.array([len(s) for s in s2], int)
    result: list = [None] * len(n1)
    for group in _pair_groups(n1, n2, CELLS * 4):
        a1, a2 = n1[group], n2[group]
        w1, w2 = int(a1.max()), int(a2.max())
        one_side, other_side = _paired(s1, s2, group, w1, w2)
        narrow = 2 * abs(o) + max(abs(e), abs(x)) * (w1 + w2) < 29_000 and abs(m) * min(w1, w2) < 29_000
        kind, low_value = (np.int16, -30_000) if narrow else (np.int32, LOW)
        # best value of a cell, and by its state (both, along the first, along the second) with a gap opened behind it
        top, both, first, second = ([np.full((len(group), w1 + 1), low_value, kind) for _ in range(3)] for _ in range(4))
        ways = np.zeros((len(group), w1 + w2 + 1, min(w1, w2) + 1), np.uint8)
        score = np.zeros(len(group), np.int64)
        for d in range(w1 + w2 + 1):
            now, one, two = d % 3, (d - 1) % 3, (d - 2) % 3
            low, r = max(d - w2, 0), w2 - d
            p, q = max(low, 1), min(w1, d - 1)
            if p <= q:
                diag = (one_side[:, p - 1:q] != other_side[:, r + p:r + q + 1]) * kind(x - m)
                diag += top[two][:, p - 1:q]
                diag += m
                from_both, from_second = both[one][:, p - 1:q], second[one][:, p - 1:q]
                down = np.maximum(from_both, from_second)
                np.maximum(down, first[one][:, p - 1:q] + (e - o), out=down)
                other = from_both != down
                way = (other.view(np.uint8) + (other & (from_second == down)).view(np.uint8)) * np.uint8(4)
                from_both, from_first = both[one][:, p:q + 1], first[one][:, p:q + 1]
                right = np.maximum(from_both, from_first)
                np.maximum(right, second[one][:, p:q + 1] + (e - o), out=right)
                other = from_both != right
                way += (other.view(np.uint8) + (other & (from_first != right)).view(np.uint8)) * np.uint8(16)
                best = np.maximum(diag, down)
                np.maximum(best, right, out=best)
                other = diag != best
                way += other.view(np.uint8) + (other & (down != best)).view(np.uint8)
                ways[:, d, p - low:q - low + 1] = way
                top[now][:, p:q + 1] = best
                np.add(diag, o, out=both[now][:, p:q + 1])
                np.add(down, o, out=first[now][:, p:q + 1])
                np.add(right, o, out=second[now][:, p:q + 1])
            edge = o + e * (d - 1) if d else 0
            if d <= w2:  # nothing of the first sequence yet
                top[now][:, 0], both[now][:, 0] = edge, low_value if d else o
                first[now][:, 0], second[now][:, 0] = low_value, edge + o if d else low_value
                ways[:, d, 0] = 2 + (2 << 4 if d > 1 else 0)
            if 0 < d <= w1:  # nothing of the second one
                top[now][:, d], both[now][:, d] = edge, low_value
                first[now][:, d], second[now][:, d] = edge + o, low_value
                ways[:, d, d - low] = 1 + (1 << 2 if d > 1 else 0)
            ended = np.flatnonzero(a1 + a2 == d)
            score[ended] = top[now][ended, a1[ended]]
        places = _places(w1, w2)
        for k, pair in enumerate(group.tolist()):
            way, i, d, steps = ways[k].tobytes(), int(a1[k]), int(a1[k] + a2[k]), bytearray()
            state = way[places[d] + i] & 3
            while d:
                steps.append(state)
                if state == 0:
                    d, i = d - 2, i - 1
                    state = way[places[d] + i] & 3
                elif state == 1:
                    state = way[places[d] + i] >> 2 & 3
                    d, i = d - 1, i - 1
                else:
                    state = way[places[d] + i] >> 4
                    d -= 1
            result[pair] = int(score[k]) / 10.0, _gapped(s1[pair], steps, 2), _gapped(s2[pair], steps, 1)
    return result


def _gapped(text: str, steps: bytearray, gap: int) -> str:
    """``text`` along the steps, which are listed from the end, with ``-`` where they are ``gap``."""
    there = np.frombuffer(steps, np.uint8)[::-1] != gap
    out = np.full(len(there), ord("-"), np.uint8)
    out[there] = _codes(text)
    return out.tobytes().decode("ascii")


def affine_global(s1: str, s2: str, match=1.0, mismatch=-0.1, gap_open=-10.0, gap_extend=-0.5):
    """``affine_globals`` of one pair."""
    return affine_globals([s1], [s2], match, mismatch, gap_open, gap_extend)[0]


def banded_overlap(s1: str, s2: str, max_gaps: int, match: int = 1, mismatch: int = 5, gap: int = 10):
    """Alignment with free ends on both sides inside a diagonal band.

    Returns ``(score, matches, mismatches, gaps)``.
    """
    a, b = _codes(s1), _codes(s2)
    width = 2 * max_gaps + 1
    # per cell (score, -gaps, matches, mismatches); larger is better
    row = [(0, 0, 0, 0) if 0 <= d <= len(b) else None for d in range(-max_gaps, max_gaps + 1)]
    best = None
    for i in range(len(a) + 1):
        if i:
            new = [None] * width
            for w in range(width):
                j = i + w - max_gaps
                if j < 0 or j > len(b):
                    continue
                if j == 0:
                    new[w] = (0, 0, 0, 0)
                    continue
                options = []
                if row[w] is not None:
                    s, g, p, q = row[w]
                    same = a[i - 1] == b[j - 1]
                    options.append((s + match, g, p + 1, q) if same else (s - mismatch, g, p, q + 1))
                if w + 1 < width and row[w + 1] is not None:
                    s, g, p, q = row[w + 1]
                    options.append((s - gap, g - 1, p, q))
                if w and new[w - 1] is not None:
                    s, g, p, q = new[w - 1]
                    options.append((s - gap, g - 1, p, q))
                new[w] = max(options) if options else None
            row = new
        for w in range(width):
            j = i + w - max_gaps
            if row[w] is not None and (i == len(a) or j == len(b)) and (best is None or row[w] > best):
                best = row[w]
    if best is None:
        return 0, 0, 0, 0
    return best[0], best[2], best[3], -best[1]


# -- Arrow UDFs --------------------------------------------------------------

def half_banded_score(s1, s2, band: int):
    @F.pandas_udf("long")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(half_banded_scores(a.tolist(), b.tolist(), band))
    return score(s1, s2)


def bounded_score(s1, s2, tau: int):
    """Half-banded score when at least ``-tau``, else NULL."""
    @F.pandas_udf("long")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        found = [edits_within(x, y, tau) for x, y in zip(a, b)]
        return pd.Series([None if v is None else -v for v in found], dtype="Int64")
    return score(s1, s2)


# Places of an outline: numbers of A, C and G before each, growing by half an octave.
OUTLINE = np.unique((8 * 2 ** (np.arange(40) / 2)).astype(np.int64))


def outline_of(text: str) -> bytes:
    """Low bytes of the numbers of A, C and G before each place of ``OUTLINE`` that the sequence reaches."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = OUTLINE[OUTLINE <= len(codes)]
    if not len(at):
        return b""
    edges = np.append(0, at[:-1])
    return np.stack([np.cumsum(np.add.reduceat(codes[:at[-1]] == ord(c), edges, dtype=np.int64)) for c in "ACG"], axis=1).astype(np.uint8).tobytes()


def outline(seq):
    @F.pandas_udf("binary")
    def outlines(batch: pd.Series) -> pd.Series:
        return pd.Series([outline_of(x) for x in batch], dtype=object)
    return outlines(seq)


def outlines_agree(one, other, shorter, tau: int):
    """False only where two sequences that start together cannot be within ``tau`` edits.

    Up to a place that both reach an alignment makes ``tau`` edits and is shifted by at most ``tau``: a number differs by no more than ``2 * tau``.
    """
    width = 3 * len(OUTLINE)

    def table(batch: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in batch), np.uint8).reshape(-1, len(OUTLINE), 3)

    @F.pandas_udf("boolean")
    def agree(a: pd.Series, b: pd.Series, n: pd.Series) -> pd.Series:
        apart = np.abs((table(a) - table(b)).view(np.int8).astype(np.int16)).max(axis=2)
        return pd.Series(((apart <= 2 * tau) | (OUTLINE[None, :] > n.to_numpy()[:, None])).all(axis=1))
    return agree(one, other, shorter)


def thinned(seq, most: int):
    """Distinct strings that are left when up to ``most`` characters are taken out, anywhere; for short sequences."""
    def fewer(text: str) -> list[str]:
        every = last = {text}
        for _ in range(most):
            last = {x[:i] + x[i + 1:] for x in last for i in range(len(x))}
            every = every | last
        return list(every)

    @F.pandas_udf("array<string>")
    def thin(batch: pd.Series) -> pd.Series:
        return pd.Series([fewer(x) for x in batch], dtype=object)
    return thin(seq)


def choose_anchors(costs, k: int, count: int):
    @F.pandas_udf("array<int>")
    def choose(batch: pd.Series) -> pd.Series:
        return pd.Series([choose_positions(c, k, count) for c in batch])
    return choose(costs)


def smallest_kmer_of(seq, k: int):
    @F.pandas_udf("string")
    def least(batch: pd.Series) -> pd.Series:
        return pd.Series([smallest_window(x, k) for x in batch], dtype=object)
    return least(seq)


def best_overlap_score(s1, s2, shifts, match: int = 1, penalty: int = 5):
    """Best match and mismatch score over the given shifts of two long sequences."""
    @F.pandas_udf("long")
    def score(a: pd.Series, b: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for x, y, places in zip(a, b, at):
            u, v = _codes(x), _codes(y)
            lengths = [(d, min(len(u) - max(d, 0), len(v) - max(-d, 0))) for d in map(int, places)]
            wrong = [int(np.count_nonzero(u[max(d, 0):max(d, 0) + n] != v[max(-d, 0):max(-d, 0) + n])) for d, n in lengths]
            out.append(max((n - w) * match - w * penalty for (_, n), w in zip(lengths, wrong)))
        return pd.Series(out, dtype="int64")
    return score(s1, s2, shifts)


def first_equal(s1, s2, turned, start1, start2, length):
    """Index of the first cut that is equal in both sequences, ``s2`` being read on its other strand where ``turned``; NULL if none is."""
    strand = str.maketrans(S.FROM_BASES, S.COMPLEMENT_N_AS_N)

    def cut(x: str, y: str, cuts) -> int | None:
        back = None
        for at, (other, i, j, n) in enumerate(cuts):
            z = y
            if other:
                z = back = y.translate(strand)[::-1] if back is None else back
            end = max(n - 16, 0)
            if x[i + end:i + n] == z[j + end:j + n] and x[i:i + n] == z[j:j + n]:
                return at
        return None

    @F.pandas_udf("int")
    def first(a: pd.Series, b: pd.Series, *cuts: pd.Series) -> pd.Series:
        return pd.Series([cut(x, y, zip(*(c.tolist() for c in own))) for x, y, *own in zip(a, b, *cuts)], dtype="Int32")
    return first(s1, s2, turned, start1, start2, length)


def shift_matches(s1, s2):
    @F.pandas_udf("long")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([best_shift_matches(x, y) for x, y in zip(a, b)], dtype="int64")
    return count(s1, s2)


def shift_align(s1, s2, max_errors: int = 100, min_overlap: int = 300):
    @F.pandas_udf("score long, shift long, errors long, same_strand boolean")
    def align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [shift_alignment(x, y, max_errors, min_overlap) for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=["score", "shift", "errors", "same_strand"])
    return align(s1, s2)


def edit_distance_to(s1, s2, transpositions: bool = True):
    @F.pandas_udf("long")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(edit_distances(a.tolist(), b.tolist(), transpositions), dtype="int64")
    return distance(s1, s2)


def local_similarity_of(s1, s2):
    @F.pandas_udf("score long, length long")
    def similarity(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(local_similarities(a.tolist(), b.tolist()), columns=["score", "length"])
    return similarity(s1, s2)


def affine_align(s1, s2):
    @F.pandas_udf("score double, row1 string, row2 string")
    def align(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            yield pd.DataFrame(affine_globals(a.tolist(), b.tolist()), columns=["score", "row1", "row2"])
    return align(s1, s2)


def banded_overlap_score(s1, s2, max_gaps: int, min_overlap: int = 300, max_mismatches: int = 4):
    """Free-end banded score, 0 when the alignment breaks one of the limits."""
    @F.pandas_udf("long")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            s, p, q, g = banded_overlap(x, y, max_gaps)
            out.append(s if p + q >= min_overlap and q <= max_mismatches and g <= max_gaps else 0)
        return pd.Series(out, dtype="int64")
    return score(s1, s2)
