"""Conversation repair against a search over all edits, and its handling of odd rows."""

import binascii
import hashlib
import heapq
import random
import re

import numpy as np
import pytest

from strandframe.llm import conversation_repair as cr


def cheapest(turns):
    """Best-first search over (cost, audit): ``turns`` are (role, text, fault). Cost, audit and lines."""
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, at, roles, lines = heapq.heappop(heap)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, list(lines)
        if cost > 200:
            raise AssertionError
        def go(more, edit, then, role, line):
            own = roles + role
            if re.fullmatch("s?(ua)*u?", own):
                own = own if len(own) <= 4 else own[:1] * own.startswith("s") + "ua" + "u" * own.endswith("u")
                heapq.heappush(heap, (cost + more, audit + edit, then, own, lines + line))
        for role in ("user", "assistant"):
            if audit.endswith("III"):
                break  # more than three in a row never pay
            go(3, "I", at, role[0], (f"{role}:",))
        if at < len(turns):
            role, text, fault = turns[at]
            go(4, "D", at + 1, "", ())
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                go(more, "K", at + 1, role[:1] or "?", (f"{role}:{text}",))
                for r in ("user", "assistant"):
                    go(3 + more, "R", at + 1, r[0], (f"{r}:{text}",))


def plain(rows):
    """Expected results of ``(conv, turn, role, text)`` rows after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            shown = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            h = binascii.crc32(shown.encode()) % 20
            if h == 0:
                continue
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            mine += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        mine.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:200], hashlib.sha256(f"{t[1]}:{t[2]}".encode()).hexdigest()))
        seen, turns, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for turn, role, text in mine:
            shown = re.sub(r"[ \t-\r]+\Z", "", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            turns.append((role, text, fault))
        known = [t[0] for t in mine if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, lines = cheapest(turns)
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "No!", "so and", "", " \t", None, "What?  ", "x", "a.b", "é漢.", "long " * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(roles), rng.choice(texts)) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(None, None, None, None), (None, 3, "user", "Hi."), (200, 5, "user", "Hi."), (200, 5, "user", "Hi."), (200, 5, "assistant", "Hi."), (200, 1 << 40, "assistant", "Ho.")]
    return rows


def found(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "'x' AS digest", "2 AS copies")
        return {r[0]: tuple(r[1:]) for r in cr.repair(cr.damaged(df)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("partitions", [3, 40])
def test_equals_a_search_over_all_edits(spark, partitions):
    rows = odd_rows()
    assert found(spark, rows, partitions) == plain(rows)


def test_a_conversation_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "no", f"At {t}."])) for t in range(3000)] + [(8, 0, "user", "Hi.")]
    assert found(spark, rows, 1)[7] == found(spark, rows, 30)[7]


def test_nothing(spark):
    assert found(spark, [], 4) == {}


def test_powers_equal_single_steps():
    for initial in "suax":
        for fault in range(4):
            step, out = cr.transition(initial, fault, 0), None
            for n in range(1, 20):
                out = step if out is None else cr.min_plus(out, step)
                assert np.array_equal(out, cr.run_transition(initial, fault, n))


def test_undamaged_texts(spark):
    df = spark.createDataFrame([(1, 0, "user", "A."), (1, 1, "user", "B."), (2, 0, "system", "C.")], "conv_id long, turn long, role string, text string")
    out = cr.repair(cr.undamaged(df), texts=True).orderBy("conv_id", "place", "part").collect()
    # a new role for the second turn costs 3; a lone system turn is deleted for 4, as a user and an assistant would cost 6
    assert {r["conv_id"] for r in out} == {1} and "\n".join(r["body"] for r in out) == "user:A.\nassistant:B."
