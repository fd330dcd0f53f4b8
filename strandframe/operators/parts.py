"""Graphs that fall into many parts: a part that one task can hold is solved there as a whole.

Rounds over all edges write and shuffle the graph again and again.  Where the edges
that hang together are few, they travel to one task once and a plain function does
the work; only parts with more edges are left to the rounds.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandframe.operators.components import stars
from strandframe.session import settled, shuffle_partitions

PLAIN = ("string", "bigint", "int")  # ids of these types have one order in Spark and in Python


def split_parts(edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Edges, with ``part``, of parts with at most ``most`` edges, and the edges of all others (None if there are none).

    An edge with one NULL end belongs to the part of the other end; one with two is left out.
    """
    if dict(edges.dtypes)["src"] not in PLAIN or dict(edges.dtypes)["dst"] != dict(edges.dtypes)["src"]:
        return edges.withColumn("part", F.col("src")).limit(0), edges
    at = F.coalesce("src", "dst")
    star = stars(edges).select(F.col("u").alias("_at"), F.col("v").alias("part"))
    placed = settled(edges.withColumn("_at", at).where("_at IS NOT NULL").join(star, "_at", "left")
                     .withColumn("part", F.coalesce("part", "_at")).drop("_at"))
    large = settled(placed.groupBy("part").count().where(F.col("count") > most).select("part"))
    if large.isEmpty():
        return placed, None
    return placed.join(large, "part", "left_anti").select(*placed.columns), placed.join(large, "part", "left_semi").select(*edges.columns)


def solve_parts(rows: DataFrame, solve: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``solve`` for the rows of each ``part``, given without it as tuples; parts follow one another in a task."""
    target = to_arrow_schema(StructType.fromDDL(schema))
    names = [c for c in rows.columns if c != "part"]

    def made(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(target.types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, target.types)], schema=target)

    def run(batches):
        now, own = None, []
        for batch in batches:
            found = []
            for part, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now:
                    if own:
                        found += solve(own)
                    now, own = part, []
                own.append(tuple(row))
            yield made(found)
        if own:
            yield made(solve(own))

    # small rows make much work: tasks are not joined by their bytes
    return rows.select("part", *names).repartition(shuffle_partitions(rows.sparkSession), "part").sortWithinPartitions("part").mapInArrow(run, schema)
