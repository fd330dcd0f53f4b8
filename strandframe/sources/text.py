"""Text records with their position in the file.

The text source keeps lines of a file block in order, so a line's number is its
rank inside the block plus the lines of all earlier blocks of the file.  Both
parts come from built-in functions; files stay splittable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.session import broadcast_if_small


def text_records(spark: SparkSession, paths: str | Sequence[str], separator: str | None = None) -> DataFrame:
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    return reader.text([paths] if isinstance(paths, str) else list(paths))


def numbered_records(spark: SparkSession, paths: str | Sequence[str], separator: str | None = None,
                     across: bool = False) -> DataFrame:
    """``value, file, ordinal`` with 0-based ordinals per file, or across all files by name."""
    placed = text_records(spark, paths, separator).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"))
    blocks = placed.groupBy("file", "_block").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    # one row per file block
    order = Window.orderBy("file", "_block") if across else Window.partitionBy("file").orderBy("_block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "_block", "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return placed.join(broadcast_if_small(starts), ["file", "_block"]).select(
        "value", "file", (F.col("_row") - F.col("_first") + F.col("_base")).alias("ordinal"))
