"""Prefix collapse: fold every sequence into the first full-length sequence it prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.operators.ordering import RANGE, range_window, split_ranges


def distinct_sequences(reads: DataFrame, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """One row per distinct sequence: ``seq, first_id, copies`` (combined map-side)."""
    return reads.groupBy(F.col(seq_col).alias("seq")).agg(
        F.min(id_col).alias("first_id"), F.count("*").alias("copies"))


def _leaves(distinct: DataFrame) -> DataFrame:
    """Distinct sequences with ``key``, ``is_leaf`` and the ``leaf`` they reach.

    Sequences sort with N after T.  In that order all extensions of a sequence
    follow it directly, so a sequence is a leaf unless its successor extends it,
    and the leaf it reaches by always taking the lowest letter is the next leaf.
    """
    split = split_ranges(distinct.withColumn("key", F.translate("seq", "N", "Z")), "key")
    by_range = Window.orderBy(RANGE)  # one row per range
    heads = split.groupBy(RANGE).agg(F.min("key").alias("_head")).select(
        F.lag(RANGE).over(by_range).alias(RANGE), "_head")
    back = range_window("key", descending=True)
    marked = (
        split.withColumn("_next", F.lag("key").over(back))
        .withColumn("_tail", F.row_number().over(back) == 1)
        .join(F.broadcast(heads.where(F.col(RANGE).isNotNull())), RANGE, "left")
        .withColumn("_next", F.when(F.col("_tail"), F.col("_head")).otherwise(F.col("_next")))
        .withColumn("is_leaf", ~F.coalesce(F.startswith(F.col("_next"), F.col("key")), F.lit(False)))
        .drop("_next", "_tail", "_head")
        .withColumn("leaf", F.last(F.when(F.col("is_leaf"), F.col("key")), ignorenulls=True)
                    .over(back.rowsBetween(Window.unboundedPreceding, 0)))
    )
    first_leaf = marked.groupBy(RANGE).agg(F.min("leaf").alias("_leaf"))
    later = Window.orderBy(F.col(RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = first_leaf.select(RANGE, F.last("_leaf", ignorenulls=True).over(later).alias("_carry"))
    return (marked.join(F.broadcast(carry), RANGE)
            .withColumn("leaf", F.coalesce("leaf", "_carry")).drop("_carry", RANGE))


def prefix_collapse(reads: DataFrame, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """``rep_id, seq, abundance``: every read counted at the leaf it reaches."""
    leaves = _leaves(distinct_sequences(reads, id_col, seq_col))
    return (
        leaves.groupBy("leaf")
        .agg(F.sum("copies").alias("abundance"), F.min(F.when(F.col("is_leaf"), F.col("first_id"))).alias("rep_id"))
        .select("rep_id", F.translate("leaf", "Z", "N").alias("seq"), "abundance")
    )


def prefix_assignment(reads: DataFrame, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """``seq, leaf_seq, copies``: where each distinct sequence is folded to."""
    leaves = _leaves(distinct_sequences(reads, id_col, seq_col))
    return leaves.select("seq", F.translate("leaf", "Z", "N").alias("leaf_seq"), "copies")


def leaf_sequences(reads: DataFrame, id_col: str = "read_id", seq_col: str = "seq") -> DataFrame:
    """Distinct sequences that are no proper prefix of another one."""
    leaves = _leaves(distinct_sequences(reads, id_col, seq_col))
    return leaves.where("is_leaf").select("seq", F.col("first_id").alias("rep_id"), "copies")
