"""Conversation structure repair by run-length dynamic programming.

A conversation's turns are symbols: the role's initial (s, u, a or another) and the
fault of the turn.  The cheapest edits that give the roles ``(s?(ua)+)?`` are a
shortest path through four states: nothing yet, after s, after u, after a.  Equal
consecutive symbols are one run; a run's costs come from the min-plus power of its
4 x 4 transition, whose binary powers are kept for all conversations.

Turns are dealt to ranges of about ``RANGE_BYTES`` in the order of conversation and
turn, so a conversation with a third of all rows fills many ranges.  Each range
gives the transitions of its first and last conversation, which may go on next door
(at most two rows a range); the costs at the range's end follow from those behind
it, then the state at its start from those before it, and every range writes its
part of the edits.  Only the digest of a conversation over several ranges is taken
in one task, block after block, since SHA-256 is sequential by definition.

Order of the turns: by turn, NULL first; equal turns by role, then by the first 200
characters of the text, then by the text's SHA-256.  The costs of edits are stated in
``COSTS``.

Defined results: a NULL role or text is one space, as is a NULL key or turn in the
checksum that deals out damage.  A NULL conversation key is a conversation of its
own.  Equal rows are repeated turns: all but the first are duplicates.  A row with a
role of another initial, or an empty one, can only be given a new role or deleted.  A conversation of
no rows (all were dropped) has zeros, an empty audit and the digest of the empty
string.  Without rows the result is empty; other columns are not read.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.shared import map_batches
from strandframe.session import cut_lineage, shuffle_partitions

RANGE_BYTES = 32 << 20
TIE_CHARACTERS = 200  # of the text in the order of equal turns
CHUNK = 1 << 20  # characters of repaired text in one row on the way to the digest
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
FAR = 1 << 60  # no way
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # what an inserted or renamed turn becomes
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("a", USER): ASSISTANT, ("u", ASSISTANT): USER}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = ("su", "ua", "au")
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
WORD = r"[^ \t-\r]"


def min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


@lru_cache(maxsize=1)
def insertions() -> np.ndarray:
    """Cost from state to state by inserted turns alone."""
    step = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(step, 0)
    for state, then in FOLLOWS.items():
        step[state, then] = min(step[state, then], COSTS["I"])
    return min_plus(min_plus(step, step), min_plus(step, step))


@lru_cache(maxsize=None)
def transition(initial: str, fault: int, power: int) -> np.ndarray:
    """Min-plus transition of ``2 ** power`` equal turns, insertions before each of them included."""
    if power:
        half = transition(initial, fault, power - 1)
        return min_plus(half, half)
    row = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(row, COSTS["D"])
    if fault not in (BLANK, DUPLICATE):
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        for state, then in FOLLOWS.items():
            row[state, then] = min(row[state, then], COSTS["R"] + more)
        for (role, state), then in KEPT.items():
            if role == initial:
                row[state, then] = min(row[state, then], COSTS["K"] + more)
    return min_plus(insertions(), row)


def run_transition(initial: str, fault: int, length: int) -> np.ndarray | None:
    out, power = None, 0
    while length:
        if length & 1:
            step = transition(initial, fault, power)
            out = step if out is None else min_plus(out, step)
        length, power = length >> 1, power + 1
    return out


def end_costs() -> np.ndarray:
    """Cost from each state to a lawful end by insertions."""
    done = np.full(4, FAR, np.int64)
    done[[START, ASSISTANT]] = 0
    return np.minimum((insertions() + done).min(axis=1), FAR)


def behind(step: np.ndarray, after: np.ndarray) -> np.ndarray:
    return np.minimum((step + after).min(axis=1), FAR)


def runs_of(symbols: list[tuple[str, int]]) -> list[tuple[str, int, int]]:
    """``(initial, fault, length)`` of equal consecutive symbols."""
    out: list[tuple[str, int, int]] = []
    for initial, fault in symbols:
        if out and out[-1][0] == initial and out[-1][1] == fault:
            out[-1] = (initial, fault, out[-1][2] + 1)
        else:
            out.append((initial, fault, 1))
    return out


def border_costs(runs, after: np.ndarray) -> list[np.ndarray]:
    """Costs before each run, and ``after`` behind the last."""
    out = [after]
    for initial, fault, length in reversed(runs):
        out.append(behind(run_transition(initial, fault, length), out[-1]))
    return out[::-1]


def whole_transition(runs) -> np.ndarray:
    """Transition of all runs; the unit where there are none."""
    out = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(out, 0)
    for initial, fault, length in runs:
        out = min_plus(out, run_transition(initial, fault, length))
    return out


def unrolled(runs, state: int, after: np.ndarray, last: bool):
    """Choices along the runs, the cheapest and among those the least in ASCII: ``(edit, state after it)``.

    ``after``: costs behind the last run; with ``last`` also the insertions at the end.
    The costs at the run borders come from the powers, those inside a run one by one.
    """
    ends = border_costs(runs, after)
    for number, (initial, fault, length) in enumerate(runs):
        step = transition(initial, fault, 0)
        inside = [ends[number + 1].tolist()]
        own = ends[number + 1]
        for _ in range(length - 1):
            own = behind(step, own)
            inside.append(own.tolist())
        ahead = ends[number].tolist()
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        stays = fault not in (BLANK, DUPLICATE)
        while inside:
            then = inside[-1]
            best = ahead[state]
            if COSTS["D"] + then[state] == best:
                yield "D", state
            elif COSTS["I"] + ahead[FOLLOWS[state]] == best:
                state = FOLLOWS[state]
                yield "I", state
                continue
            elif stays and (initial, state) in KEPT and COSTS["K"] + more + then[KEPT[initial, state]] == best:
                state = KEPT[initial, state]
                yield "K", state
            else:
                state = FOLLOWS[state]
                yield "R", state
            ahead = inside.pop()
    while last and state not in (START, ASSISTANT):
        state = FOLLOWS[state]
        yield "I", state


def repaired(turns, runs, state: int, after: np.ndarray, last: bool):
    """Edits and the turns (role, text) that are left of ``turns`` (initial, fault, role, text), whose runs are ``runs``."""
    audit, out, at = [], [], 0
    for edit, state in unrolled(runs, state, after, last):
        audit.append(edit)
        if edit == "I":
            out.append((ROLES[state], ""))
            continue
        if edit != "D":
            out.append((ROLES[state] if edit == "R" else turns[at][2], turns[at][3]))
        at += 1
    return "".join(audit), out


def damaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies``: rows damaged by the checksum of key and turn; ``copies`` 0: dropped."""
    def shown(c):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    h = F.crc32(F.concat(shown(key), F.lit(":"), shown(turn)).cast("binary")) % 20
    own = rows.select(F.col(f"`{key}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), h.alias("h"), shown(role).alias("role"), shown(text).alias("text"))
    body = F.when(F.col("h") <= 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return own.select("conv", "turn", F.when(F.col("h") == 0, "").when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
                      body.alias("text"), F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1).cast("long").alias("copies"))


def undamaged(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows as they are, in the form of ``damaged``."""
    def shown(c):
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{key}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), shown(role).alias("role"), shown(text).alias("text"),
                       F.lit(1).cast("long").alias("copies"))


def _fault(text: Column) -> Column:
    blank = ~text.rlike(WORD)
    return F.when(blank, BLANK).when(~text.rlike(r"[.!?][ \t-\r]*\z"), TRUNCATED).otherwise(NO_FAULT)


def ordered_turns(turns: DataFrame) -> DataFrame:
    """Turns in ranges and in order: ``conv, turn, role, text, copies, fault, mark, place``.

    Equal rows of a turn are one row with their number.  Beside the turns there is a marker (``mark`` 0, no text) in
    front of the first turn of each different (role, text) of a conversation, so that repeats are known without a join.
    """
    kept = turns.groupBy("conv", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    digest = F.sha2(F.concat_ws(":", "role", "text"), 256).alias("digest")
    tie = F.substring("text", 1, TIE_CHARACTERS).alias("tie")
    known = F.col("turn").isNotNull().alias("known")
    rows = kept.select("conv", known, "turn", "role", tie, digest, F.lit(1).alias("mark"), "text", "copies",
                       F.when(F.col("copies") > 0, _fault(F.col("text"))).otherwise(NO_FAULT).alias("fault"))
    first = turns.where("copies > 0").select("conv", known, "turn", "role", tie, digest).groupBy("conv", "role", "tie", "digest").agg(
        F.min(F.struct("known", "turn")).alias("at"))
    marks = first.select("conv", "at.known", "at.turn", "role", "tie", "digest", F.lit(0).alias("mark"), F.lit("").alias("text"),
                         F.lit(0).cast("long").alias("copies"), F.lit(NO_FAULT).alias("fault"))
    held = turns.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    ranges = max(shuffle_partitions(turns.sparkSession), held // RANGE_BYTES + 1)
    keys = ["conv", "known", "turn", "role", "tie", "digest"]
    dealt = rows.unionByName(marks).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys, "mark")
    return cut_lineage(dealt.select("conv", "turn", "role", "text", "copies", "fault", "mark", F.spark_partition_id().alias("place")))


class Conversation:
    """The turns of one conversation inside one range."""

    def __init__(self, conv, place):
        self.conv, self.place, self.turns = conv, place, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.least = self.most = self.first = self.before = None

    def add(self, turn, role, text, copies, fault, is_first):
        if turn is not None:
            if turn != self.most:
                self.distinct += 1
            self.least = turn if self.least is None else self.least
            self.most = turn
        initial = role[:1]
        for i in range(copies):
            own = fault if fault == BLANK or (is_first and not i) else DUPLICATE
            self.blank += own == BLANK
            self.duplicate += own == DUPLICATE
            self.truncated += own == TRUNCATED
            if self.before is None:
                self.first = initial
            else:
                self.illegal += self.before + initial not in LEGAL
            self.before = initial
            self.turns.append((initial, own, role, text if own not in (BLANK, DUPLICATE) else ""))


def _conversations(batches):
    """Conversations of a range in order, from its ordered rows."""
    own, marked = None, False
    for columns in batches:
        for conv, turn, role, text, copies, fault, mark, place in zip(*columns):
            if own is None or conv != own.conv or place != own.place:
                if own is not None:
                    yield own
                own, marked = Conversation(conv, place), False
            if not mark:
                marked = True
                continue
            if copies:
                own.add(turn, role, text, copies, fault, marked)
            marked = False
    if own is not None:
        yield own


BORDER = ("conv {kind}, place int, ways array<long>, blank long, duplicate long, truncated long, illegal long, distinct long, least long, most long, "
          "first string, before string")


def _border_rows(ordered: DataFrame, kind: str):
    """The first and the last conversation of each range: counts and transition; at most two rows a range."""
    def run(batches):
        first = last = None
        for c in _conversations(batches):
            if first is None:
                first = c
            last = c
        for c in ([] if first is None else [first] if last is first else [first, last]):
            ways = whole_transition(runs_of([t[:2] for t in c.turns])).ravel().tolist()
            yield tuple([v] for v in (c.conv, c.place, ways, c.blank, c.duplicate, c.truncated, c.illegal, c.distinct, c.least, c.most, c.first, c.before))

    rows = map_batches(ordered, run, BORDER.format(kind=kind)).collect()  # bounded by the number of ranges
    parts: dict = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        parts.setdefault(r["conv"], []).append(r)
    return {conv: own for conv, own in parts.items() if len(own) > 1}


def _costs_behind(parts: dict) -> dict:
    """(conv, place) -> costs behind that part."""
    out = {}
    for conv, own in parts.items():
        after = end_costs()
        for r in reversed(own):
            out[conv, r["place"]] = after
            after = behind(np.array(r["ways"], np.int64).reshape(4, 4), after)
        out[conv, None] = after
    return out


def _states_at(ordered: DataFrame, kind: str, parts: dict, costs: dict) -> dict:
    """(conv, place) -> state in which the part begins: each part tells where its choices lead from any state."""
    if not parts:
        return {}

    def run(batches):
        for c in _conversations(batches):
            if (c.conv, c.place) in costs:
                runs, after = runs_of([t[:2] for t in c.turns]), costs[c.conv, c.place]
                leads = []
                for state in range(4):
                    for _, state in unrolled(runs, state, after, False):
                        pass
                    leads.append(state)
                yield [c.conv], [c.place], [leads]

    split = [c for c in parts if c is not None]
    only = F.col("conv").isin(split) if None not in parts else F.col("conv").isin(split) | F.col("conv").isNull()
    slim = ordered.where(only).withColumn("text", F.lit(""))
    leads = {(r["conv"], r["place"]): r["leads"] for r in map_batches(slim, run, f"conv {kind}, place int, leads array<int>").collect()}
    out = {}
    for conv, own in parts.items():
        state = START
        for r in own:
            out[conv, r["place"]] = state
            state = leads[conv, r["place"]][state]
    return out


def _joined_counts(own) -> dict:
    """Counts of a conversation from its parts, in order."""
    out = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "distinct": 0}
    most = before = None
    for r in own:
        for c in out:
            out[c] += r[c]
        if r["least"] is not None:
            out["distinct"] -= most == r["least"]
            most = r["most"]
        if r["first"] is not None:
            if before is not None:
                out["illegal"] += before + r["first"] not in LEGAL
            before = r["before"]
    known = [r for r in own if r["least"] is not None]
    gaps = known[-1]["most"] - known[0]["least"] + 1 - out["distinct"] if known else 0
    return {"gaps": gaps, **{c: out[c] for c in ("blank", "duplicate", "truncated", "illegal")}}


RESULT = ("conv {kind}, place int, part int, whole boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "body string, digest string")


def _pieces(out) -> list[str]:
    """Repaired turns as lines, in pieces of about ``CHUNK`` characters; at least one."""
    pieces, own, held = [], [], 0
    for role, text in out:
        own.append(f"{role}:{text}")
        held += len(own[-1])
        if held > CHUNK:
            pieces.append("\n".join(own))
            own, held = [], 0
    if own or not pieces:
        pieces.append("\n".join(own))
    return pieces


def repair(turns: DataFrame, key: str = "conv_id", texts: bool = False) -> DataFrame:
    """``key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of each conversation.

    ``turns`` comes from ``damaged`` or ``undamaged``.  With ``texts`` the lines of the repaired conversations instead:
    ``key, place, part, body`` in pieces whose order is ``place, part``.
    """
    ordered = ordered_turns(turns)
    kind = ordered.schema["conv"].dataType.simpleString()
    parts = _border_rows(ordered, kind)
    costs = _costs_behind(parts)
    states = _states_at(ordered, kind, parts, costs)
    counts = {conv: _joined_counts(own) for conv, own in parts.items()}
    ends = {conv: own[-1]["place"] for conv, own in parts.items()}
    shared = turns.sparkSession.sparkContext.broadcast((costs, states, counts, ends))  # some numbers for each range

    def run(batches):
        costs, states, counts, ends = shared.value
        lone_end = end_costs()
        rows, held = [], 0
        for c in _conversations(batches):
            whole = (c.conv, c.place) not in states
            runs = runs_of([t[:2] for t in c.turns])
            if whole:
                state, after, last = START, lone_end, True
                gaps = 0 if c.most is None else c.most - c.least + 1 - c.distinct
                numbers = (gaps, c.blank, c.duplicate, c.truncated, c.illegal)
                cost = int(border_costs(runs, after)[0][START])
            else:
                state, after, last = states[c.conv, c.place], costs[c.conv, c.place], ends[c.conv] == c.place
                n = counts[c.conv]
                numbers = (n["gaps"], n["blank"], n["duplicate"], n["truncated"], n["illegal"])
                cost = int(costs[c.conv, None][START])
            audit, out = repaired(c.turns, runs, state, after, last)
            pieces = _pieces(out)
            digest = hashlib.sha256("\n".join(pieces).encode()).hexdigest() if whole else None
            if whole and not texts:
                pieces = [None]  # the digest stands for them
            for i, piece in enumerate(pieces):
                rows.append((c.conv, c.place, i if out else -1, whole, *numbers, cost, "" if i else audit, piece, digest))
                held += len(piece or "")
            if held > CHUNK or len(rows) > 5000:
                yield tuple(zip(*rows))
                rows, held = [], 0
        if rows:
            yield tuple(zip(*rows))

    told = map_batches(ordered, run, RESULT.format(kind=kind))
    if texts:
        return told.where("part >= 0").select(F.col("conv").alias(key), "place", "part", "body")
    results = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    if not parts:
        return told.select(F.col("conv").alias(key), *results, F.col("digest").alias("repaired_sha256"))
    told = cut_lineage(told.select("conv", "place", "part", "whole", *results, "body", "digest"))
    alone = told.where("whole").select("conv", *results, F.col("digest").alias("repaired_sha256"))
    split = told.where("not whole").drop("digest", "whole").repartition("conv").sortWithinPartitions("conv", "place", "part")

    def joined(batches):
        """One pass over the pieces of each conversation; the digest goes on from piece to piece."""
        own, digest, audit, begun, numbers = (), None, [], False, None

        def done():
            return tuple([v] for v in (own[0], *numbers, "".join(audit), digest.hexdigest()))
        for columns in batches:
            for conv, _, part, *counted, edits, body in zip(*columns):
                if own != (conv,):
                    if own:
                        yield done()
                    own, digest, audit, begun, numbers = (conv,), hashlib.sha256(), [], False, counted
                audit.append(edits)
                if part >= 0:
                    digest.update((("\n" if begun else "") + body).encode())
                    begun = True
        if own:
            yield done()

    rest = map_batches(split, joined, f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
                       "repaired_sha256 string")
    return alone.unionByName(rest).withColumnRenamed("conv", key)
