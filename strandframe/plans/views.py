"""Views over the given tables, as DataFrames and as SQL common table expressions.

Every view covers the whole table and the whole text.  Letters become bases by
their place in the alphabet; this is a stand-in for sequencing data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASES = "ACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGTACGT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores when a small file yields fewer scan partitions than there are.

    Large tables have more partitions than cores and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *cols), "doc_id")


def to_bases(text):
    """Letters to bases; everything that is no ASCII letter is dropped."""
    return F.translate(F.regexp_replace(text, "[^A-Za-z]", ""), LETTERS, BASES)


def to_bases_with_n(text):
    """As ``to_bases``, but a non-ASCII character reads as the unknown base N."""
    marked = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z\u0080-￿]", ""), "[^A-Za-z]", "#")
    return F.translate(marked, LETTERS + "#", BASES + "N")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_id, source, seq``: one read per document, whole text."""
    return documents(spark, sf_dir, "source").select(
        F.col("doc_id").alias("read_id"), "source", to_bases(F.col("text")).alias("seq"))


def reads_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "source").select(
        F.col("doc_id").alias("read_id"), "source", to_bases_with_n(F.col("text")).alias("seq"))


def word_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``read_id, seq``: every word of every document as a short read with N bases."""
    spaced = F.regexp_replace("text", r"[\x00-\x40\x5B-\x60\x7B-\x7F]+", " ")
    bases = F.translate(F.regexp_replace(spaced, "[^A-Za-z ]", "#"), LETTERS + "#", BASES + "N")
    words = documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(bases, " ")).alias("pos", "seq"))
    return words.where("seq <> ''").select(
        (F.col("doc_id") * F.lit(4294967296) + F.col("pos")).alias("read_id"), "seq")


def turn_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, role, seq``: every conversation turn as a read."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id", "turn")
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", to_bases(F.col("text")).alias("seq"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn (``s1``) with the next turn of its conversation (``s2``)."""
    t = turn_reads(spark, sf_dir)
    nxt = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("seq").alias("s2"))
    return t.select("conv_id", "turn", F.col("seq").alias("s1")).join(nxt, ["conv_id", "turn"])


def sql_bases(expr: str) -> str:
    return f"translate(regexp_replace({expr}, '[^A-Za-z]', '', 'g'), '{LETTERS}', '{BASES}')"


def sql_bases_n(expr: str) -> str:
    marked = (f"regexp_replace(regexp_replace({expr}, '[^A-Za-z\\x{{0080}}-\\x{{FFFF}}]', '', 'g'), "
              f"'[^A-Za-z]', '#', 'g')")
    return f"translate({marked}, '{LETTERS}#', '{BASES}N')"


READS_SQL = f"reads AS (SELECT doc_id AS read_id, source, {sql_bases('text')} AS seq FROM documents)"
READS_N_SQL = f"reads_n AS (SELECT doc_id AS read_id, source, {sql_bases_n('text')} AS seq FROM documents)"
WORDS_SQL = (
    "spaced AS (SELECT doc_id, string_split(translate(regexp_replace(regexp_replace(text, "
    "'[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+', ' ', 'g'), '[^A-Za-z ]', '#', 'g'), "
    f"'{LETTERS}#', '{BASES}N'), ' ') AS parts FROM documents), "
    "word_reads AS (SELECT doc_id * 4294967296 + pos AS read_id, seq FROM (SELECT doc_id, "
    "unnest(parts) AS seq, generate_subscripts(parts, 1) - 1 AS pos FROM spaced) WHERE seq <> '')"
)
TURNS_SQL = (f"turns AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, {sql_bases('text')} AS seq "
             "FROM conversations)")
PAIRS_SQL = (TURNS_SQL + ", pairs AS (SELECT a.conv_id, a.turn, a.seq AS s1, b.seq AS s2 FROM turns a "
             "JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)")
