"""Best-fit packing of token pieces into sequences of a fixed capacity.

Linear grouping: the large pieces, sorted by length, are cut into groups of equal
cardinality and each length counts as the largest of its group.  For these few
sizes a linear programme over configurations (the ways to fill one sequence) is
solved by column generation.  The actual pieces then take the places of the
rounded ones, and the small pieces (with the shortest of each configuration) go
where they leave the least room.

All of this works on counts per length, of which there are no more than the
capacity, so the plan's size does not grow with the corpus.  Spark computes the
counts, numbers the pieces of each length and assigns places from the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.library_ids import share_tokenizer, word_encoder
from strandframe.llm.shared import map_batches, written

CAPACITY = 2048
GROUPS = 64  # rounded sizes that the configurations are made of
SAVING = 1e-4  # share of a sequence that a further configuration has to save
SMALL = 8  # pieces of up to 1/8 of the capacity are small


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id",
                 text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Cut each document's ids, closed by ``end_id``, into pieces of at most ``capacity``.

    ``key, piece, start, length, ids_crc32, part, nth`` and on demand ``ids``; ``part``
    is the task that made the piece and ``nth`` counts its pieces of that length.
    NULL and empty texts consist of the end id.
    """
    shared = share_tokenizer(docs.sparkSession, path)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long"

    def run(batches):
        encode, part, seen = word_encoder(shared.value), TaskContext.get().partitionId(), Counter()
        end = end_id.to_bytes(4, "little")
        for keys, texts in batches:
            out = [[] for _ in range(7 + keep_ids)]
            for k, t in zip(keys, texts):
                raw = encode(t or "") + end
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    own = raw[at:at + 4 * capacity]
                    n = len(own) // 4
                    row = [k, piece, at // 4, n, zlib.crc32(own), part, seen[n]]
                    seen[n] += 1
                    for column, value in zip(out, row):
                        column.append(value)
                    if keep_ids:
                        out[7].append(np.frombuffer(own, "<u4").tolist())
            yield out

    return map_batches(docs.select(key, text), run, schema + ", ids array<long>" * keep_ids)


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of the cutting-stock programme: ``(pieces of each size, sequences)``.

    Column generation: the prices of the present basis are offered to a knapsack
    over the capacity, and its best filling enters until none saves anything.
    """
    m, most = len(sizes), capacity // min(sizes)
    size = np.array(sizes)
    source = np.arange(capacity + 1)[None, :] - size[:, None]  # room left before a piece of each size
    source = np.where(source < 0, capacity + 1, source)  # the last entry stands for no room
    basis = np.diag(capacity // size).astype(float)
    for _ in range(50 * m):
        amount = np.linalg.solve(basis, np.array(demand, float))
        price = np.linalg.solve(basis.T, np.ones(m))
        worth, chosen = np.zeros(capacity + 2), []
        worth[-1] = -np.inf
        for _ in range(most):  # up to one more piece in each round
            with_piece = worth[source] + price[:, None]
            best = with_piece.max(axis=0)
            gains = best > worth[:-1] + 1e-12
            chosen.append(np.where(gains, with_piece.argmax(axis=0), -1))
            if not gains.any():
                break
            worth[:-1] = np.where(gains, best, worth[:-1])
        if worth[capacity] <= 1 + SAVING:
            break
        column, room = np.zeros(m), capacity
        for choice in reversed(chosen):
            if choice[room] >= 0:
                column[choice[room]] += 1
                room -= size[choice[room]]
        change = np.linalg.solve(basis, column)
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    return [(basis[:, j].astype(int), max(0.0, float(amount[j]))) for j in range(m)]


def _largest_first(sizes: list[int], demand: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of size indices for the demand that rounding down left over."""
    made: list[list[int]] = []
    room: list[int] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for _ in range(demand[i]):
            fits = [b for b, r in enumerate(room) if r >= sizes[i]]
            if fits:
                b = min(fits, key=lambda b: room[b])
            else:
                b = len(made)
                made.append([])
                room.append(capacity)
            made[b].append(i)
            room[b] -= sizes[i]
    return made


class _Runs:
    """Sequences with equal contents, kept once with their number."""

    def __init__(self, capacity: int):
        self.capacity, self.runs = capacity, []

    def add(self, contents: tuple, number: int) -> None:
        """``contents``: pairs of a length and how many of it lie in each of the sequences."""
        if number:
            self.runs.append((contents, number, self.capacity - sum(s * c for s, c in contents)))


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> np.ndarray:
    """Places for ``counts[length]`` pieces: rows ``length, first, behind, per, sequence, offset``.

    The pieces of a length with numbers ``first <= n < behind`` go, ``per`` to a
    sequence, to ``sequence + (n - first) // per`` from ``offset`` on.
    """
    runs = _Runs(capacity)
    if counts.get(capacity):
        runs.add(((capacity, 1),), counts[capacity])
    large = sorted((s for s in counts if capacity // SMALL < s < capacity), reverse=True)
    total = sum(counts[s] for s in large)
    rest = Counter({s: n for s, n in counts.items() if s <= capacity // SMALL})
    if total:
        rest += _place_large(runs, [(s, counts[s]) for s in large], total, capacity, groups)
    _place_rest(runs, sorted(rest.items(), reverse=True))
    used, rows, sequence = Counter(), [], 0
    for contents, number, _ in runs.runs:
        offset = 0
        for length, per in contents:
            rows.append((length, used[length], used[length] + per * number, per, sequence, offset))
            used[length] += per * number
            offset += per * length
        sequence += number
    assert all(used[s] == n for s, n in counts.items()), "every piece has one place"
    return np.array(rows, dtype=np.int64).reshape(-1, 6)


def _place_large(runs: _Runs, large: list[tuple[int, int]], total: int, capacity: int, groups: int) -> Counter:
    """Fill the configurations with actual pieces; what is returned is to be placed by best fit.

    Each configuration leaves the place of its shortest piece open:
    the actual pieces beside it are shorter than rounded, so best fit may put a
    longer piece there than the rounded one.
    """
    # few lengths need no rounding: each is a group
    share = -(-total // groups) if len(large) > groups else total
    sizes, members, demand = [], [], []
    taken = share
    for length, count in large:  # longest first: the first of a group is its rounded size
        while count:
            if taken == share or len(large) <= groups and length != sizes[-1]:
                sizes.append(length)
                members.append([])
                demand.append(0)
                taken = 0
            n = min(count, share - taken)
            members[-1].append([length, n])
            demand[-1] += n
            taken += n
            count -= n
    joined: dict[int, int] = {}  # groups with one rounded size are one size
    for i, s in enumerate(sizes):
        if s in joined:
            members[joined[s]] += members[i]
            demand[joined[s]] += demand[i]
        else:
            joined[s] = i
    keep = list(joined.values())
    sizes, members, demand = ([x[i] for i in keep] for x in (sizes, members, demand))
    left, patterns = list(demand), []
    for column, amount in sorted(configurations(sizes, demand, capacity), key=lambda x: -x[1]):
        n = min([int(amount + 1e-6), *(left[i] // c for i, c in enumerate(column) if c)])
        if n:
            patterns.append((column, n))
            left = [d - int(c) * n for d, c in zip(left, column)]
    for contents in _largest_first(sizes, left, capacity):
        column = np.bincount(contents, minlength=len(sizes))
        patterns.append((column, 1))
    for column, n in patterns:
        column = column.copy()
        column[np.flatnonzero(column)[-1]] -= 1
        while n and column.any():
            need = [(i, int(c)) for i, c in enumerate(column) if c]
            # as many sequences as can be filled with the same actual lengths
            alike = min(n, *(members[i][0][1] // c for i, c in need))
            filled, number = Counter(), max(1, alike)
            for i, c in need:
                wanted = c * number
                while wanted:
                    length, have = members[i][0]
                    took = min(have, wanted)
                    filled[length] += took
                    wanted -= took
                    members[i][0][1] -= took
                    if not members[i][0][1]:
                        members[i].pop(0)
            runs.add(tuple((s, k // number) for s, k in sorted(filled.items(), reverse=True)), number)
            n -= number
    left_over = Counter()
    for group in members:
        for length, n in group:
            left_over[length] += n
    return left_over


def _place_rest(runs: _Runs, rest: list[tuple[int, int]]) -> None:
    """Best fit, longest first; sequences with equal room are filled one after the other."""
    by_room: dict[int, list] = defaultdict(list)
    for contents, number, room in runs.runs:
        by_room[room].append((contents, number))
    rooms = sorted(by_room)

    def put(room: int, contents: tuple, number: int) -> None:
        if number:
            if not by_room[room]:
                bisect.insort(rooms, room)
            by_room[room].append((contents, number))

    for length, count in rest:
        while count:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                per = runs.capacity // length
                if count >= per:
                    put(runs.capacity - per * length, ((length, per),), count // per)
                if count % per:
                    put(runs.capacity - count % per * length, ((length, count % per),), 1)
                break
            room = rooms[k]
            contents, number = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
            per = room // length
            full = min(number, count // per)
            put(room - per * length, contents + ((length, per),), full)
            count -= full * per
            number -= full
            if number and count:
                put(room - count * length, contents + ((length, count),), 1)
                count, number = 0, number - 1
            put(room, contents, number)
    runs.runs = [(contents, number, room) for room in rooms for contents, number in by_room[room]]


def pack(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to the rows of ``token_pieces``.

    Every row gets one place; sequences are filled without gaps from 0.  No piece
    gives no sequence.  The pieces are written once, so that all counts and the
    places rest on the same rows even if an executor is lost.
    """
    pieces = written(pieces, "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # at most one row per length: bounded by the capacity
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    plan = plan_packing(histogram, capacity, groups)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    span = int(max(histogram.values(), default=0)) + 1
    starts = plan[:, 0] * span + plan[:, 1]
    placed = pieces.join(numbered.drop("_n"), ["part", "length"])
    names = [c for c in pieces.columns if c not in ("part", "nth")]
    schema = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in names) + ", sequence_id long, offset long"

    def run(batches):
        for *columns, lengths, ranks in batches:
            length, rank = np.array(lengths, np.int64), np.array(ranks, np.int64)
            row = plan[np.searchsorted(starts, length * span + rank, "right") - 1] if len(rank) else np.zeros((0, 6), np.int64)
            step = rank - row[:, 1]
            yield [*columns, row[:, 4] + step // np.maximum(row[:, 3], 1), row[:, 5] + step % np.maximum(row[:, 3], 1) * length]

    return map_batches(placed.select(*names, F.col("length").alias("_length"), (F.col("_before") + F.col("nth")).alias("_rank")),
                       run, schema)


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id",
                     text: str = "text", groups: int = GROUPS, keep_ids: bool = False) -> DataFrame:
    """Documents to placed pieces: ``key, piece, start, length, ids_crc32, sequence_id, offset`` and on demand ``ids``.

    NULL and empty texts become a piece with the end id alone; NULL and repeated
    keys are kept as they come; an empty table gives an empty result; other
    columns are ignored.
    """
    return pack(token_pieces(docs, path, capacity, end_id, key, text, keep_ids), capacity, groups)
