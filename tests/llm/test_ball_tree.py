"""Ranked search against scoring every document."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from strandframe.llm import ball_tree as bt


def plain(docs, items, k=10):
    held = [(key, Counter(bt.terms(text))) for key, text in docs]
    held = [(key, c) for key, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scored = []
        for key, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m))
                        for w in set(bt.terms(text)) if w in c)
            if score > 0:
                scored.append((-score, key is not None, key or 0))
        out += [(item, i + 1, key if known else None, -s) for i, (s, known, key) in enumerate(sorted(scored)[:k])]
    return out


def rows(documents):
    rng = random.Random(4)
    base = [(r["doc_id"], r["text"]) for r in documents.collect()]
    base += [(500 + i, " ".join(rng.choice(["x1", "y2", "Z", "é", "the"]) for _ in range(rng.randint(1, 12)))) for i in range(300)]
    base += [(1000 - i, "the copy of a copy") for i in range(60)]
    return base


ITEMS = [(1, "The copy"), (2, "x1 Y2 z É"), (3, None), (4, "!?"), (5, "nowherefound"), (None, "the"), (2, "x1 Y2 z É"), (6, "of and er in an ti on es the copy")]


def order(r):
    return str(r)


@pytest.mark.parametrize("tree,leaf", [(8192, 32), (40, 3)])
def test_ranked(spark, documents, nothing, monkeypatch, tree, leaf):
    monkeypatch.setattr(bt, "TREE", tree)
    monkeypatch.setattr(bt, "LEAF", leaf)
    docs = rows(documents)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS rank", "2 AS key", "3 AS n")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS query", "'y' AS block")
    assert sorted(map(tuple, bt.ranked(df, items).collect()), key=order) == sorted(plain(docs, ITEMS), key=order)
    assert bt.ranked(nothing, items).count() == 0 and bt.ranked(df, items.limit(0)).count() == 0


def test_query_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(bt, "QUERIES", 3)
    docs = rows(documents)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(tuple, bt.ranked(df, items).collect()), key=order) == sorted(plain(docs, ITEMS), key=order)


def test_tree_leaves_out_only_what_cannot_rank():
    rng = np.random.default_rng(1)
    groups = rng.integers(0, 12, 4000)
    start, ids, values = [0], [], []
    for g in groups:  # documents of one group share most of their terms
        own = np.unique(np.concatenate([np.arange(g * 20, g * 20 + 15), rng.integers(0, 240, 3)]))
        ids.append(own)
        values.append(rng.integers(300_000, 900_000, len(own)))
        start.append(start[-1] + len(own))
    ids, values = np.concatenate(ids), np.concatenate(values)
    tree = bt.Tree(np.array(start), ids, values, 240)
    leaves = sum(x is not None for x in tree.rows)
    scored = 0
    for g in range(12):
        q_ids, q = np.arange(g * 20, g * 20 + 8), rng.integers(100, 9000, 8)
        dense = np.zeros(240, np.int64)
        dense[q_ids] = q
        exact = np.add.reduceat(values * dense[ids], start[:-1])
        best = bt.Best(1, 10)
        scored += tree.search(q_ids, q, 1, lambda row, score: best.add(0, score, [row]))
        want = sorted((-int(s), i) for i, s in enumerate(exact))[:10]
        assert [(s, key[1]) for s, key in best.lists[0]] == want
    assert scored < leaves * 12 / 2  # half of all leaves and more are never scored
