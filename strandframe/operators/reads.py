"""Row transforms over reads.  All are narrow: no shuffle, streaming-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.functions import sequences as S


def with_reverse_complement(reads: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Each read followed by its reverse complement, marked by ``is_rc``."""
    both = F.explode(F.array(
        F.struct(F.lit(False).alias("is_rc"), F.col(seq_col).alias("seq")),
        F.struct(F.lit(True).alias("is_rc"), S.reverse_complement(seq_col).alias("seq"))))
    rest = [c for c in reads.columns if c != seq_col]
    return reads.select(*rest, both.alias("_r")).select(*rest, "_r.is_rc", F.col("_r.seq").alias(seq_col))


def drop_reverse_complement(reads: DataFrame) -> DataFrame:
    """Undo ``with_reverse_complement``."""
    return reads.where(~F.col("is_rc")).drop("is_rc")


def change_orientation(pairs: DataFrame, orientation: str, first: str = "s1", second: str = "s2") -> DataFrame:
    """Bring pairs of library orientation FF, RR, FR or RF to forward-forward."""
    if orientation not in ("FF", "RR", "FR", "RF"):
        raise ValueError(f"unknown orientation {orientation!r}")
    turn = {first: orientation[0] == "R", second: orientation[1] == "R"}
    return pairs.withColumns({c: S.reverse_complement(c) if flip else F.col(c) for c, flip in turn.items()})


def flatten_pairs(pairs: DataFrame, first: str = "s1", second: str = "s2") -> DataFrame:
    """Two single reads per pair, with ``mate`` 1 or 2."""
    rest = [c for c in pairs.columns if c not in (first, second)]
    mates = F.explode(F.array(
        F.struct(F.lit(1).cast("long").alias("mate"), F.col(first).alias("seq")),
        F.struct(F.lit(2).cast("long").alias("mate"), F.col(second).alias("seq"))))
    return pairs.select(*rest, mates.alias("_m")).select(*rest, "_m.mate", "_m.seq")


def split_at_invalid(reads: DataFrame, seq_col: str = "seq") -> DataFrame:
    """One row per maximal run of plain bases, numbered by ``run`` from 0."""
    rest = [c for c in reads.columns if c != seq_col]
    return reads.select(*rest, F.posexplode(S.valid_runs(seq_col)).alias("run", seq_col))


def keep_longest_valid(reads: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Cut each read to its longest run of plain bases; reads without one are dropped."""
    return reads.withColumn(seq_col, S.longest_valid_run(seq_col)).where(F.col(seq_col) != "")


def keep_longest_valid_pairs(pairs: DataFrame, first: str = "s1", second: str = "s2",
                             insert: str = "insert_size") -> DataFrame:
    """Both mates cut to their longest valid run; the insert size follows the cut.

    A pair is dropped when either mate has no valid run.
    """
    run1, run2 = S.longest_valid_run(first), S.longest_valid_run(second)
    start1, start2 = F.instr(F.col(first), F.col("_r1")) - 1, F.instr(F.col(second), F.col("_r2")) - 1
    end2 = start2 + F.length("_r2")
    return (pairs.withColumns({"_r1": run1, "_r2": run2}).where("_r1 <> '' AND _r2 <> ''")
            .withColumn(insert, F.col(insert) - start1 - F.length(second) + end2)
            .withColumns({first: F.col("_r1"), second: F.col("_r2")}).drop("_r1", "_r2"))


def prefix_names(reads: DataFrame, prefix: str, name_col: str = "name") -> DataFrame:
    return reads.withColumn(name_col, F.concat(F.lit(prefix), F.col(name_col)))


def trim(reads: DataFrame, left: Column, right: Column, *cols: str) -> DataFrame:
    """Keep the 0-based closed interval ``left..right``; reads left empty are voided."""
    first = reads[cols[0]]
    void = (left >= F.length(first)) | (right < 0) | (right < left)
    cut = lambda c: F.when(void, F.lit("")).otherwise(S.piece(c, F.greatest(left, F.lit(0)), right - F.greatest(left, F.lit(0)) + 1))
    return reads.withColumns({c: cut(F.col(c)) for c in cols})


def trim_unknown_and_bad(reads: DataFrame, threshold: int, offset: int = 33,
                         seq_col: str = "seq", quality_col: str = "quality") -> DataFrame:
    """Trim N bases and bases of quality ``<= threshold`` from both ends."""
    good = reads.withColumn("_good", S.good_positions(seq_col, quality_col, threshold, offset))
    marked = good.withColumns({"_left": F.coalesce(F.array_min("_good"), F.length(seq_col)),
                               "_right": F.coalesce(F.array_max("_good"), F.lit(-1))}).drop("_good")
    return trim(marked, F.col("_left"), F.col("_right"), seq_col, quality_col).drop("_left", "_right")


def trim_unknown(reads: DataFrame, seq_col: str = "seq") -> DataFrame:
    """Trim N bases from both ends."""
    return reads.withColumn(seq_col, F.regexp_replace(seq_col, "^N+|N+$", ""))


def subread(reads: DataFrame, start: Column, stop: Column, name_col: str = "name", seq_col: str = "seq") -> DataFrame:
    """Bases ``start..stop`` with the interval in the name, mirrored for ``_RC`` names."""
    n = F.length(seq_col)
    rc = F.endswith(F.col(name_col), F.lit("_RC"))
    base = F.when(rc, F.regexp_replace(name_col, "_RC$", "")).otherwise(F.col(name_col))
    lo, hi = F.when(rc, n - stop).otherwise(start), F.when(rc, n - start).otherwise(stop)
    renamed = F.concat(base, F.lit("_SUBSTR("), lo.cast("string"), F.lit(","), hi.cast("string"), F.lit(")"),
                       F.when(rc, F.lit("_RC")).otherwise(F.lit("")))
    whole = (stop - start) == n
    return reads.withColumns({
        name_col: F.when(whole, F.col(name_col)).otherwise(renamed),
        seq_col: S.piece(seq_col, start, stop - start)})


def keep_valid(reads: DataFrame, seq_col: str = "seq", accept_empty: bool = False) -> DataFrame:
    return reads.where(S.is_valid(seq_col, accept_empty))


def minimum_read_length(k: int, tau: int, strategy: str) -> int:
    """Shortest read a seeding strategy can guarantee."""
    seeds = {"naive": 0, "single": 1, "pair": 2, "triple": 3}[strategy]
    return k * (tau + seeds) if seeds else 0


def keep_long_enough(reads: DataFrame, k: int = 36, tau: int = 3, strategy: str = "triple",
                     seq_col: str = "seq") -> DataFrame:
    return reads.where(F.length(seq_col) >= minimum_read_length(k, tau, strategy))


def all_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def any_of(*predicates: Column) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def standard_reads(reads: DataFrame, split: bool = False, with_rc: bool = True) -> DataFrame:
    """Usual preparation: valid runs (all or the longest), then both strands."""
    clean = split_at_invalid(reads) if split else keep_longest_valid(reads)
    return with_reverse_complement(clean) if with_rc else clean


def standard_pairs(pairs: DataFrame, orientation: str = "FR", with_rc: bool = True) -> DataFrame:
    """Orient, cut to valid runs and, with ``with_rc``, add the mirrored pair."""
    clean = keep_longest_valid_pairs(change_orientation(pairs, orientation))
    if not with_rc:
        return clean
    mirrored = clean.withColumns({"s1": S.reverse_complement("s2"), "s2": S.reverse_complement("s1")})
    return clean.withColumn("is_rc", F.lit(False)).unionByName(mirrored.withColumn("is_rc", F.lit(True)))


def read_statistics(reads: DataFrame, *by: str, seq_col: str = "seq") -> DataFrame:
    """Number of reads, longest read and total length."""
    return reads.groupBy(*by).agg(
        F.count("*").alias("read_count"), F.max(F.length(seq_col)).cast("long").alias("max_len"),
        F.sum(F.length(seq_col)).alias("total_len"))


def merge_statistics(parts: DataFrame) -> DataFrame:
    """Combine statistics of several streams."""
    return parts.agg(F.sum("read_count").alias("read_count"), F.max("max_len").alias("max_len"),
                     F.sum("total_len").alias("total_len"))
