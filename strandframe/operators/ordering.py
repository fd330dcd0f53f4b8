"""Global order without a one-task window.

Rows are range-partitioned on the order key, so a hot key prefix is spread over
many ranges.  Running values are computed inside each range and the per-range
carries (one row per range) are combined afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.session import settled, shuffle_partitions

RANGE = "_range"


def split_ranges(df: DataFrame, *keys: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``: ordered, evenly filled key ranges.

    Range bounds come from a sample, so the result is written: every later
    use must see the same bounds, and reads only the columns it needs.
    """
    n = ranges or shuffle_partitions(df.sparkSession)
    return settled(df.repartitionByRange(n, *keys).withColumn(RANGE, F.spark_partition_id()))


def range_window(*keys: str, descending: bool = False):
    order = [F.col(k).desc() if descending else F.col(k).asc() for k in keys]
    return Window.partitionBy(RANGE).orderBy(*order)


def carried_before(split: DataFrame, value: str, out: str) -> DataFrame:
    """Per range, the sum of ``value`` over all earlier ranges."""
    totals = split.groupBy(RANGE).agg(F.sum(value).alias("_t"))
    # one row per range: bounded by the partition count
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(RANGE, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias(out))


def running_sums(df: DataFrame, keys: list[str], sums: dict[str, str]) -> DataFrame:
    """Add inclusive running sums ``{output: input}`` over the order of ``keys``."""
    split = split_ranges(df, *keys)
    result = split
    frame = range_window(*keys).rowsBetween(Window.unboundedPreceding, 0)
    for out, value in sums.items():
        carry = carried_before(split, value, "_carry")
        result = (
            result.withColumn(out, F.sum(value).over(frame))
            .join(F.broadcast(carry), RANGE)
            .withColumn(out, F.col(out) + F.col("_carry"))
            .drop("_carry")
        )
    return result.drop(RANGE)


def row_ordinals(df: DataFrame, keys: list[str], out: str = "ordinal") -> DataFrame:
    """Add a dense 1-based ordinal following the order of ``keys``."""
    numbered = running_sums(df.withColumn("_one", F.lit(1).cast("long")), keys, {out: "_one"})
    return numbered.drop("_one")


def neighbour_values(df: DataFrame, keys: list[str], previous: dict[str, str] | None = None,
                     following: dict[str, str] | None = None) -> DataFrame:
    """``lag``/``lead`` by one row across range borders, ``{output: input}``."""
    split = split_ranges(df, *keys)
    result = split
    w = range_window(*keys)
    by_range = Window.orderBy(RANGE)  # one row per range
    for out, value in (previous or {}).items():
        last = split.groupBy(RANGE).agg(F.max_by(F.struct(value), F.struct(*keys)).alias("_v"))
        edge = last.select((F.lead(RANGE).over(by_range)).alias(RANGE), F.col(f"_v.{value}").alias("_edge"))
        result = (result.withColumn(out, F.lag(value).over(w)).withColumn("_first", F.row_number().over(w) == 1)
                  .join(F.broadcast(edge.where(F.col(RANGE).isNotNull())), RANGE, "left")
                  .withColumn(out, F.when(F.col("_first"), F.col("_edge")).otherwise(F.col(out)))
                  .drop("_edge", "_first"))
    for out, value in (following or {}).items():
        first = split.groupBy(RANGE).agg(F.min_by(F.struct(value), F.struct(*keys)).alias("_v"))
        edge = first.select((F.lag(RANGE).over(by_range)).alias(RANGE), F.col(f"_v.{value}").alias("_edge"))
        back = range_window(*keys, descending=True)
        result = (result.withColumn(out, F.lag(value).over(back)).withColumn("_last", F.row_number().over(back) == 1)
                  .join(F.broadcast(edge.where(F.col(RANGE).isNotNull())), RANGE, "left")
                  .withColumn(out, F.when(F.col("_last"), F.col("_edge")).otherwise(F.col(out)))
                  .drop("_edge", "_last"))
    return result.drop(RANGE)


_JOIN_CARRY = {
    "sum": lambda here, before: here + F.coalesce(before, F.lit(0)),
    "min": lambda here, before: F.least(here, before),
    "max": lambda here, before: F.greatest(here, before),
}
_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def keyed_ranges(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Ranges over ``keys + order``: a key with very many rows is spread over several."""
    return split_ranges(df, *keys, *order)


def keyed_running(split: DataFrame, keys: list[str], order: list[str], how: str, value: str, out: str,
                  inclusive: bool = True) -> DataFrame:
    """Running ``sum``, ``min`` or ``max`` of ``value`` per key over ranges from ``keyed_ranges``."""
    agg, merge = _AGGREGATE[how], _JOIN_CARRY[how]
    frame = Window.partitionBy(RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    # a key that goes on into later ranges is the last one of its range and the first one of theirs: one row per range
    key = F.struct(*keys)
    ends = split.groupBy(RANGE).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    totals = (split.join(F.broadcast(ends), RANGE).where(key == F.col("_last"))
              .groupBy(RANGE, "_first", "_last").agg(agg(value).alias("_t")))
    told = totals.select(RANGE, F.explode(F.array(
        F.struct(F.col("_last").alias("k"), F.col("_t").alias("t"), F.lit(False).alias("asks")),
        F.struct(F.col("_first").alias("k"), F.lit(None).alias("t"), F.lit(True).alias("asks")))).alias("e")).select(RANGE, "e.*")
    earlier = Window.partitionBy("k").orderBy(RANGE).rangeBetween(Window.unboundedPreceding, -1)
    carry = told.withColumn("_carry", agg("t").over(earlier)).where("asks AND _carry IS NOT NULL").select(RANGE, "k.*", "_carry")
    joined = split.withColumn(out, agg(value).over(frame)).join(F.broadcast(carry), [RANGE, *keys], "left")
    here = F.coalesce(F.col(out), F.lit(0)) if how == "sum" else F.col(out)
    return joined.withColumn(out, merge(here, F.col("_carry"))).drop("_carry")


def keyed_previous(split: DataFrame, keys: list[str], order: list[str], value: str, out: str, step: int = 1) -> DataFrame:
    """Value of the previous (``step=1``) or next (``step=-1``) row of the key, across range borders."""
    w = Window.partitionBy(RANGE, *keys).orderBy(*order)
    pick = F.max_by if step > 0 else F.min_by
    edge = split.groupBy(RANGE, *keys).agg(pick(value, F.struct(*order)).alias("_edge"))
    along = Window.partitionBy(*keys).orderBy(RANGE)
    carry = edge.withColumn("_edge", F.lag("_edge", step).over(along) if step > 0 else F.lead("_edge", -step).over(along))
    carry = carry.where("_edge IS NOT NULL")
    here = F.lag(value).over(w) if step > 0 else F.lead(value).over(w)
    at_edge = (F.lag(F.lit(1)).over(w) if step > 0 else F.lead(F.lit(1)).over(w)).isNull()
    return split.withColumns({out: here, "_at_edge": at_edge}).join(carry, [RANGE, *keys], "left").withColumn(
        out, F.when(F.col("_at_edge"), F.col("_edge")).otherwise(F.col(out))).drop("_edge", "_at_edge")
