"""Reads as a stream of arriving files.

The row transforms of ``operators.reads`` are narrow and work on these frames
unchanged; statistics keep running totals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandframe.sources.reads import FASTA_START, _fasta_columns


def stream_fasta(spark: SparkSession, folder: str) -> DataFrame:
    """``name, seq`` of FASTA files as they appear in ``folder``."""
    records = spark.readStream.option("lineSep", FASTA_START).text(folder)
    return records.select(*_fasta_columns(keep_marker=False)).where("name <> '' AND seq <> ''")
