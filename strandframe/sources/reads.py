"""Readers for FASTA and FASTQ, plain or compressed, single or paired."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandframe.sources.text import numbered_records, text_records

FASTA_START = "\n>"


def _fasta_columns(keep_marker: bool, multiline: bool = True) -> list[Column]:
    record = F.regexp_replace("value", "^>", "")
    name = F.regexp_replace(F.substring_index(record, "\n", 1), "\r$", "")
    lines = F.substring(record, F.length(F.substring_index(record, "\n", 1)) + 2, F.length(record))
    seq = F.regexp_replace(lines, "[\r\n]", "") if multiline else F.regexp_replace(F.substring_index(lines, "\n", 1), "\r", "")
    return [F.when(name != "", F.concat(F.lit(">"), name)).otherwise(name).alias("name") if keep_marker else name.alias("name"),
            seq.alias("seq")]


def read_fasta(spark: SparkSession, paths: str | Sequence[str], keep_marker: bool = False, multiline: bool = True) -> DataFrame:
    """``name, seq``; records without a name or a sequence are dropped.

    ``multiline=False`` takes the first sequence line only.
    """
    found = text_records(spark, paths, FASTA_START).select(*_fasta_columns(keep_marker, multiline))
    return found.where("name <> '' AND seq <> ''")


def read_numbered_fasta(spark: SparkSession, paths: str | Sequence[str], keep_marker: bool = False) -> DataFrame:
    """``file, ordinal, name, seq`` with the 0-based place of each record over all files by name."""
    return numbered_records(spark, paths, FASTA_START, across=True).select("file", "ordinal", *_fasta_columns(keep_marker))


def read_paired_fasta(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``pair, name1, s1, name2, s2``: each two records in a row form a pair."""
    r = read_numbered_fasta(spark, paths).select(F.expr("ordinal div 2").alias("pair"), F.expr("ordinal % 2").alias("mate"), "name", "seq")
    pick = lambda c, m: F.max(F.when(F.col("mate") == m, F.col(c)))
    return r.groupBy("pair").agg(pick("name", 0).alias("name1"), pick("seq", 0).alias("s1"),
                                 pick("name", 1).alias("name2"), pick("seq", 1).alias("s2"))


def read_fastq(spark: SparkSession, paths: str | Sequence[str], keep_marker: bool = False, across: bool = False) -> DataFrame:
    """``file, ordinal, name, seq, quality``; sequence and quality must be equally long.

    The four lines of a record are combined before the shuffle wherever they share
    a block.  ``across`` numbers the records over all files by name, and the lines are dealt by that number, so that
    records of two such sets meet by it without another shuffle.
    """
    lines = numbered_records(spark, paths, across=across).select(
        "file", F.expr("ordinal div 4").alias("ordinal"), F.expr("ordinal % 4").alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))
    pick = lambda n: F.coalesce(F.max(F.when(F.col("line") == n, F.col("value"))), F.lit(""))
    records = (lines.repartition("ordinal").groupBy("ordinal", "file") if across else lines.groupBy("file", "ordinal")).agg(pick(0).alias("name"), pick(1).alias("seq"), pick(3).alias("quality"))
    fits = F.length("seq") == F.length("quality")
    checked = F.when(fits, F.col("quality")).otherwise(F.raise_error(F.concat(F.lit("sequence and quality differ in length: "), "name")))
    named = records.select("file", "ordinal", "name", "seq", "quality").withColumn("quality", checked).where("name <> '' AND seq <> '' AND quality <> ''")
    return named if keep_marker else named.withColumn("name", F.regexp_replace("name", "^@", ""))


def read_paired_fastq(spark: SparkSession, left: str | Sequence[str], right: str | Sequence[str]) -> DataFrame:
    """Records of two files, or two sets of files, joined by their place."""
    a = read_fastq(spark, left, across=True).select("ordinal", F.col("name").alias("name1"), F.col("seq").alias("s1"), F.col("quality").alias("q1"))
    b = read_fastq(spark, right, across=True).select("ordinal", F.col("name").alias("name2"), F.col("seq").alias("s2"), F.col("quality").alias("q2"))
    return a.join(b, "ordinal", "full_outer").select(
        F.when(F.col("name1").isNull() | F.col("name2").isNull(), F.raise_error(F.lit("paired files differ in length")).cast("long"))
        .otherwise(F.col("ordinal")).alias("pair"), "name1", "s1", "q1", "name2", "s2", "q2")


def decoded_quality(quality, offset: int = 33) -> Column:
    """Quality string as an array of numbers."""
    chars = F.split(quality if isinstance(quality, Column) else F.col(quality), "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.ascii(c) - offset)


def quality_offset(fastq: DataFrame) -> DataFrame:
    """``offset``: 33 or 64 by the first telling quality character, -1 when none tells."""
    seen = fastq.select("ordinal", F.regexp_extract("quality", "[^;-J]", 0).alias("c")).where("c <> ''")
    return seen.agg(F.coalesce(F.min_by(F.when(F.ascii("c") < 59, 33).otherwise(64), "ordinal"), F.lit(-1)).alias("offset"))


def in_order(*frames: DataFrame) -> DataFrame:
    """Several streams one after the other, with ``stream_no``."""
    out = None
    for i, f in enumerate(frames):
        part = f.withColumn("stream_no", F.lit(i))
        out = part if out is None else out.unionByName(part)
    return out
