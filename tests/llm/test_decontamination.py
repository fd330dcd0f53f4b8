"""Benchmark n-grams in documents against plain Python."""

import hashlib
import random
import re

from strandframe.llm import decontamination as dc

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    grams = {}
    for item, text in items:
        own = words(text)
        k = min(window, len(own))
        for i in range(len(own) - k + 1 if own else 0):
            grams.setdefault(tuple(own[i:i + k]), set()).add("" if item is None else str(item))
    out = []
    for key, text in docs:
        own = words(text)
        hit, held = set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(own) - k + 1):
                if tuple(own[i:i + k]) in grams:
                    hit |= set(range(i, i + k))
                    held |= grams[tuple(own[i:i + k])]
        out.append((key, len(own), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return out


ITEMS = [(1, "One two, three four five six seven eight nine ten eleven."), (2, "ÉTÉ à la plage"), (3, None), (4, "..."), (None, "alone"), (5, "w " * 25),
         (6, "two three four five six seven eight nine ten eleven twelve"), (6, "a second text under the same id")]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def rows(documents):
    rng = random.Random(2)
    base = [(r["doc_id"], r["text"]) for r in documents.collect()]
    passage = "ONE two three/four five six-seven eight nine ten eleven twelve thirteen"
    for i in range(30):
        filler = " ".join(rng.choice("ab cd ef w é".split()) for _ in range(rng.randint(0, 30)))
        base.append((300 + i, f"{filler} {passage[:rng.randint(5, len(passage))]}; {filler} Été À la plage {'Alone' * (i % 2)}"))
    base += [(400, "w" + " w" * 4000), (401, " ".join(f"x{i}" for i in range(30_000)) + " alone")]
    return base


def test_contamination(spark, documents, nothing):
    docs = rows(documents)
    df = table(spark, docs, "doc_id long, text string").selectExpr("*", "1 AS n_hit", "'x' AS items", "2 AS _row", "3 AS at")
    items = table(spark, ITEMS, "item_id long, text string").selectExpr("*", "1 AS h", "'y' AS w")
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, dc.contamination(df, items).collect()), key=key) == sorted(plain(docs, ITEMS), key=key)
    assert dc.contamination(nothing, items).count() == 0
    none = dc.contamination(df, items.limit(0))
    assert none.count() == len(docs) and none.where("contaminated").isEmpty()
    assert dc.contamination(nothing, items.limit(0)).count() == 0


def test_blocks_equal_one_broadcast(spark, documents, monkeypatch):
    docs = table(spark, rows(documents), "doc_id long, text string")
    items = table(spark, ITEMS, "item_id long, text string")
    whole = sorted(map(str, dc.contamination(docs, items).collect()))
    monkeypatch.setattr(dc, "BROADCAST_BYTES", 700)
    assert sorted(map(str, dc.contamination(docs, items).collect())) == whole


def test_removal(spark):
    items = table(spark, [(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = table(spark, [(1, "Start: one two three four five six seven eight nine TEN, end."), (2, "Clean."), (3, None)], "doc_id long, text string")
    assert {r[0]: r[1] for r in dc.without_spans(docs, items).collect()} == {1: "Start, end.", 2: "Clean.", 3: None}
    assert sorted(r[0] for r in dc.without_documents(docs, items).collect()) == [2, 3]
    assert sorted(r[0] for r in dc.without_documents(docs, items, most=0.9).collect()) == [1, 2, 3]
    assert dc.without_spans(docs, items).columns == docs.columns
