"""Ranked lexical search by exact sparse ball trees.

A document's impact on a term and the term's weight are whole numbers, so a score
is an inner product of a weight vector with a sparse document vector.  Documents
are held as vectors over the terms of the queries; vectors of one batch form a ball
tree whose nodes know a centroid and a radius.  For a query ``q`` no document of a
node scores above ``q . centroid + |q| * radius``: nodes are taken best first, a
subtree is left out once its bound is below the k-th score found, and leaves are
scored in 64-bit integers.  Bounds are computed in doubles and widened by far more
than rounding can take (``_SLACK``), so nothing is left out wrongly.

The radius is taken over the coordinates of the query only, as the distances of all
other coordinates do not enter its product: each node keeps, beside the radius over
all terms, the largest distance from the centroid in each single term, and the ball
of a query is the smaller of both.

Two passes over the documents: one writes the slim vectors and gives the counts (N,
L, df), the other builds trees of ``TREE`` different vectors inside each task and
searches them, the scores found raising the bar for the next tree.  A task returns
its k best of each query.  Queries come in blocks of about ``QUERIES`` rows.

Vectors that are equal in all of length, terms and counts share a place in the tree
with their k smallest keys, since no others of them can rank.

Defined results: NULL and empty texts have no terms, neither rank nor count; queries
without terms, or whose terms no document holds, return no rows.  Rows that repeat a
key or a whole row rank as documents of their own.  A NULL key ranks before others
of equal score.  Each row of the queries is a query, also if it repeats another.
Other columns are not read.
"""

from __future__ import annotations

import bisect
import heapq
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm.shared import map_batches, written

K = 10
QUERIES = 1000  # queries searched at once: bounds the vocabulary that the driver and the tasks hold
TREE = 8192  # different vectors in a tree
LEAF = 32
GROUPS = 64  # first of two rounds of the final ranking
_SLACK = 1e-9  # relative; sums of n doubles err by less than n * 2 ** -52, and no vector has 1,000,000 terms
_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and all other characters beyond ASCII, A-Z in lower case."""
    return _TERM.findall(text.encode("utf-8").lower()) if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: int, n_docs: int, total: int) -> int:
    return 10 + 90 * n * n_docs // total


def impacts(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


class Tree:
    """Ball tree over sparse vectors of whole numbers: ``start`` (row borders), ``ids`` and ``values``."""

    def __init__(self, start: np.ndarray, ids: np.ndarray, values: np.ndarray, width: int):
        self.start, self.ids, self.values, self.width = start, ids, values, width
        self.norm2 = self._sums(values.astype(float) ** 2, start)
        self.rows, self.children, centroids, spread, radius = [], [], [], [], []
        stack = [(np.arange(len(start) - 1), -1)]
        while stack:
            rows, parent = stack.pop()
            node = len(self.rows)
            if parent >= 0:
                self.children[parent].append(node)
            own_start, own_ids, own_values = self._take(rows)
            x = own_values.astype(float)
            centre = np.bincount(own_ids, x, width) / len(rows)
            c2 = float(centre @ centre)
            # |x - c| by the expanded square; what cancellation may cost is added under the root
            cross = self._sums(x * centre[own_ids], own_start)
            r2 = self.norm2[rows] - 2 * cross + c2 + _SLACK * (self.norm2[rows] + c2)
            radius.append(math.sqrt(max(0.0, float(r2.max()))))
            top = np.zeros(width)
            np.maximum.at(top, own_ids, x)
            spread.append(np.maximum(top - centre, 0))  # no product of a query, which has no negative weight, gains by more
            centroids.append(centre)
            self.children.append([])
            if len(rows) <= LEAF:
                self.rows.append((rows, *self._dense(own_start, own_ids, own_values)))
                continue
            self.rows.append(None)
            half = self._halves(rows, own_start, own_ids, x)
            stack += [(rows[~half], node), (rows[half], node)]
        self.centroids, self.spread, self.radius = np.array(centroids), np.array(spread), np.array(radius)

    @staticmethod
    def _sums(x: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, start[:-1])  # each row for itself, so that rounding stays within the row; no row is empty

    def _take(self, rows: np.ndarray):
        sizes = self.start[rows + 1] - self.start[rows]
        own = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(own[-1]) + np.repeat(self.start[rows] - own[:-1], sizes)
        return own, self.ids[at], self.values[at]

    def _dense(self, start, ids, values):
        """A leaf as a table terms x rows with a last row of zeros for terms that it lacks, and the places of its terms."""
        held = np.unique(ids)
        table = np.zeros((len(held) + 1, len(start) - 1), np.int64)
        table[np.searchsorted(held, ids), np.repeat(np.arange(len(start) - 1), np.diff(start))] = values
        return held, table

    def _halves(self, rows, start, ids, x):
        """Rows nearer to one of two far points, by halves: the order along their difference."""
        def point(row):
            dense = np.zeros(self.width)
            dense[ids[start[row]:start[row + 1]]] = x[start[row]:start[row + 1]]
            return dense

        def far_from(p):
            return int(np.argmax(self.norm2[rows] - 2 * self._sums(x * p[ids], start)))
        a = point(far_from(point(0)))
        b = point(far_from(a))
        along = self._sums(x * (a - b)[ids], start)
        half = np.zeros(len(rows), bool)
        half[np.argsort(along, kind="stable")[len(rows) // 2:]] = True
        return half

    def search(self, q_ids: np.ndarray, q: np.ndarray, bar: int, found) -> int:
        """Call ``found(row, score)`` for every row that reaches the bar, which it returns; at least 1. Leaves scored."""
        near = np.linalg.norm(q) * self.radius
        ball = np.minimum(near, self.spread[:, q_ids] @ q)
        bounds = (self.centroids[:, q_ids] @ q + ball) * (1 + _SLACK) + 1
        heap, scored = [(-bounds[0], 0)], 0
        while heap and -heap[0][0] >= bar:
            node = heapq.heappop(heap)[1]
            leaf = self.rows[node]
            if leaf is None:
                for child in self.children[node]:
                    if bounds[child] >= bar:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            rows, held, table = leaf
            scored += 1
            at = np.searchsorted(held, q_ids)
            at[at == len(held)] = 0
            at = np.where(held[at] == q_ids, at, len(held))
            scores = q @ table[at]
            for i in np.nonzero(scores >= bar)[0].tolist():
                bar = found(int(rows[i]), int(scores[i]))
        return scored


def _order(key):
    return (0,) if key is None else (1, key)


class Best:
    """The k best ``(score, key)`` of each query so far; ties to the smaller key."""

    def __init__(self, n: int, k: int):
        self.k, self.lists = k, [[] for _ in range(n)]

    def bar(self, query: int) -> int:
        own = self.lists[query]
        return max(1, -own[-1][0]) if len(own) == self.k else 1

    def add(self, query: int, score: int, keys) -> int:
        own = self.lists[query]
        for key in keys:
            bisect.insort(own, (-score, _order(key)))
            if len(own) > self.k:
                own.pop()
        return self.bar(query)


def _vectors(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``key, n, ids, tfs``: length and counts of the vocabulary's terms, for texts with any term."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # terms of at most about QUERIES items

    def run(batches):
        of = shared.value
        for keys, texts in batches:
            out = []
            for key, t in zip(keys, texts):
                own = terms(t)
                if own:
                    held = sorted((of[w], c) for w, c in Counter(own).items() if w in of)
                    out.append((key, len(own), [i for i, _ in held], [c for _, c in held]))
            if out:
                yield tuple(zip(*out))

    return map_batches(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), run,
                       f"key {kind}, n int, ids array<int>, tfs array<int>")


def _search_block(docs: DataFrame, queries: list[list[bytes]], k: int, key: str, text: str) -> DataFrame:
    """``query, key, score``: the k best of each task for each query."""
    vocabulary = {w: i for i, w in enumerate(sorted({w for q in queries for w in q}))}
    vectors = written(_vectors(docs, key, text, vocabulary), "term-vectors")
    n_docs, total = vectors.agg(F.count("*"), F.coalesce(F.sum(F.col("n").cast("long")), F.lit(0))).first()
    counted = vectors.select(F.explode("ids").alias("id")).groupBy("id").count().collect()  # at most the vocabulary
    weights = {r["id"]: weight(n_docs, r["count"]) for r in counted}
    plans = []
    for q in queries:
        held = [(vocabulary[w], weights.get(vocabulary[w], 0)) for w in sorted(set(q))]
        held = [(i, w) for i, w in held if w > 0]
        plans.append((np.array([i for i, _ in held], np.int64), np.array([w for _, w in held], np.int64)))
    shared = docs.sparkSession.sparkContext.broadcast(plans)
    width, kind = len(vocabulary), docs.schema[key].dataType.simpleString()

    def run(batches):
        best = Best(len(shared.value), k)
        places: dict[tuple, list] = {}

        def flush():
            if not places:
                return
            rows = list(places)
            start = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int64)
            tf = np.array([c for r in rows for c in r[2]], np.int64)
            norm = np.repeat([length_norm(r[0], n_docs, total) for r in rows], np.diff(start)).astype(np.int64)
            tree = Tree(start, np.array([i for r in rows for i in r[1]], np.int64), impacts(tf, norm), width)
            keys = list(places.values())
            for number, (q_ids, q) in enumerate(shared.value):
                if len(q_ids):
                    tree.search(q_ids, q, best.bar(number), lambda row, score: best.add(number, score, keys[row]))
            places.clear()

        for keys, n, ids, tfs in batches:
            for row in zip(keys, n, ids, tfs):
                if row[2]:
                    held = places.setdefault((row[1], tuple(row[2]), tuple(row[3])), [])
                    bisect.insort(held, row[0], key=_order)
                    del held[k:]
                    if len(places) == TREE:
                        flush()
        flush()
        out = [(number, rank[1] if len(rank) > 1 else None, -score) for number, own in enumerate(best.lists) for score, rank in own]
        if out:
            yield tuple(zip(*out))

    return map_batches(vectors, run, f"query int, key {kind}, score long")


def ranked(docs: DataFrame, queries: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", query_key: str = "item_id",
           query_text: str = "text") -> DataFrame:
    """``query_key, rank, key, score``: the k documents of highest score above 0 for each row of ``queries``."""
    spark, kind = docs.sparkSession, queries.schema[query_key].dataType.simpleString()
    rows = queries.select(F.col(f"`{query_key}`").alias("item"), F.col(f"`{query_text}`").alias("text"))
    blocks = -(-rows.count() // QUERIES) or 1
    dealt = written(rows.withColumn("block", F.pmod(F.xxhash64("item", "text", F.monotonically_increasing_id()), F.lit(blocks))), "queries")
    ranks = None
    for b in range(blocks):
        own = dealt.where(F.col("block") == b).select("item", "text").collect()  # about QUERIES rows
        found = _search_block(docs, [terms(r["text"]) for r in own], k, key, text)
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(own)], f"query int, item {kind}")
        order = [F.col("score").desc(), F.col("key").asc_nulls_first()]
        # k rows of each task for a query, in two rounds: no task ranks all of them
        some = found.withColumn("part", F.spark_partition_id() % GROUPS).withColumn(
            "rank", F.row_number().over(Window.partitionBy("query", "part").orderBy(*order))).where(F.col("rank") <= k)
        top = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
        top = top.join(F.broadcast(names), "query").select(F.col("item").alias(query_key), "rank", F.col("key").alias(key), "score")
        ranks = top if ranks is None else ranks.unionByName(top)
    return ranks
