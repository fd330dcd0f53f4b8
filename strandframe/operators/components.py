"""Connected components by alternating star contraction.

Links that lie in one task are contracted there first: each vertex points at the
smallest it hangs together with.  Every round then points vertices at the smallest
neighbour known; the number of rounds grows with the logarithm of the component size.
Minima are combined map-side and joined back, so a hub vertex is never gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.session import cut_lineage, settled

CHUNK = 200_000  # links contracted together in one task


def smallest_joined(pairs) -> dict:
    """Vertex -> smallest vertex it hangs together with, of the vertices in ``pairs``."""
    up: dict = {}

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = top(a) if a in up else up.setdefault(a, a), top(b) if b in up else up.setdefault(b, b)
        if a < b:
            up[b] = a
        elif b < a:
            up[a] = b
    return {x: top(x) for x in up}


def _least_joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of the vertices ``0 .. n - 1`` the least it hangs together with by the links ``a, b``."""
    least = np.arange(n)
    while True:
        la, lb = least[a], least[b]
        apart = la != lb
        if not apart.any():
            return least
        np.minimum.at(least, np.maximum(la, lb)[apart], np.minimum(la, lb)[apart])
        jumped = least[least]
        while (jumped != least).any():
            least, jumped = jumped, jumped[jumped]


def _contracted(links: DataFrame) -> DataFrame:
    """``u, v`` that join the same vertices as ``src, dst``; links with neighbouring starts in one task are contracted."""
    kind = dict(links.dtypes)["src"]
    if kind not in ("string", "bigint", "int") or dict(links.dtypes)["dst"] != kind:  # for these Python has Spark's order
        return links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                yield from stars(held)
                held, n = [], 0
        yield from stars(held)

    def stars(held):
        if held:
            coded = pa.concat_arrays([b.column(i) for i in (0, 1) for b in held]).dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            ends = rank[coded.indices.to_numpy()].reshape(2, -1)
            least = _least_joined(ends[0], ends[1], len(rank))
            moved = np.flatnonzero(least != np.arange(len(rank)))
            names = coded.dictionary.take(order)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(least[moved]))], names=["u", "v"])

    return links.sortWithinPartitions("src").mapInArrow(run, f"u {kind}, v {kind}")


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    best = _minima(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(best, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    best = _minima(down)
    linked = down.join(best, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(best.select("u", F.col("m").alias("v"))).distinct()


def _tangled(edges: DataFrame) -> DataFrame:
    """``x``: vertices with two parents, or with a parent and a child; none in stars."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("parents"), F.lit(0).alias("children")).unionByName(
        edges.select(F.col("v").alias("x"), F.lit(0).alias("parents"), F.lit(1).alias("children")))
    return ends.groupBy("x").agg(F.sum("parents").alias("p"), F.max("children").alias("c")).where("p > 1 OR (p = 1 AND c = 1)").select("x")


def stars(edges: DataFrame) -> DataFrame:
    """``u, v``: for each vertex of ``src, dst`` that is not the smallest of its component, the vertex and the smallest."""
    begun = cut_lineage(_contracted(edges.where("src <> dst").select("src", "dst")).distinct())
    tangled = settled(_tangled(begun))
    if tangled.isEmpty():
        return begun
    # stars without such a vertex are components; the others go on
    touched = settled(begun.join(tangled.select(F.col("x").alias("u")), "u", "left_semi").select("v").union(tangled).distinct())
    done = begun.join(touched, "v", "left_anti").select("u", "v")
    star = settled(begun.join(touched, "v", "left_semi").select("u", "v"))
    if star.count() <= CHUNK:
        star = cut_lineage(_contracted(star.select(F.col("u").alias("src"), F.col("v").alias("dst")).coalesce(1)))
    while not _tangled(star).isEmpty():
        star = cut_lineage(_small_star(_large_star(star)))
    return done.unionByName(star)


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest vertex id connected to each vertex.

    ``vertices`` has ``id``; ``edges`` has ``src, dst`` of the same type.
    """
    return vertices.select("id").distinct().join(
        stars(edges).select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left"
    ).select("id", F.coalesce("component", "id").alias("component"))
