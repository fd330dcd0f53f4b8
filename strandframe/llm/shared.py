"""Helpers of the text operators: tables, Arrow mapping and the hash splits of the contracts."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandframe.session import scratch_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the rows outlive any executor."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with column lists: ``fn`` turns an iterator of lists of columns into one.

    The batches arrive in row order; their size is bounded by Spark's Arrow
    limits on rows and bytes.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        rows = ([c.to_pylist() for c in b.columns] for b in batches)
        for columns in fn(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, target.types)], schema=target)

    return df.mapInArrow(run, schema)


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of ``value``, which is computed once however often ``fn`` uses it.

    A column used inside a lambda may be merged into it by the optimizer and then
    be computed for each element; a lambda variable never is.
    """
    return F.element_at(F.transform(F.array(value), lambda x: fn(x)), 1)


def key_remainder(key: str, modulus: int, column: str | None = None) -> Column:
    """crc32 of the key as text, modulo ``modulus``; a NULL key counts as -1, so it is in no class."""
    return F.coalesce(F.crc32(F.col(column or key).cast("string").cast("binary")) % modulus, F.lit(-1))
