"""k-mer tables, postings and positional k-mer joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandframe.functions import alignment as A
from strandframe.functions import sequences as S
from strandframe.functions.minimizers import bin_marks, kmer_runs, told_kmers
from strandframe.operators import neighbours
from strandframe.operators.neighbours import START
from strandframe.session import cut_lineage, settled, shuffle_partitions

WINDOW = 256
HOT_KMER = 4096  # occurrences of a k-mer that stay together on the probing side
FINER = 4  # partitions of k-mer runs for one shuffle partition: runs grow some twenty times when they are read


def _windows(reads: DataFrame, k: int, ids: list[str], seq_col: str) -> DataFrame:
    """Pieces that together hold every k-mer once."""
    return reads.where(F.length(seq_col) >= k).select(
        *ids, seq_col, F.explode(F.sequence(F.lit(0), F.length(seq_col) - k, F.lit(WINDOW))).alias("_at")
    ).select(*ids, "_at", S.piece(seq_col, F.col("_at"), WINDOW + k - 1).alias("_w"))


def kmer_table(reads: DataFrame, k: int, id_cols: list[str] | None = None, seq_col: str = "seq") -> DataFrame:
    """``id.., pos, kmer`` for every k-mer of every read, duplicates included.

    Sequences are first cut into overlapping windows, so that reading one k-mer
    never costs a copy of the whole sequence.
    """
    ids = id_cols or ["read_id"]
    windows = _windows(reads, k, ids, seq_col)
    return windows.select(*ids, "_at", "_w", F.explode(F.sequence(F.lit(0), F.length("_w") - k)).alias("_p")).select(
        *ids, (F.col("_at") + F.col("_p")).alias("pos"), S.piece("_w", F.col("_p"), k).alias("kmer"))


def smallest_kmer(reads: DataFrame, k: int, id_cols: list[str] | None = None, seq_col: str = "seq") -> DataFrame:
    """``id.., sketch``: the smallest k-mer of each read; rows of one id count together."""
    ids = id_cols or ["read_id"]
    found = reads.where(F.length(seq_col) >= k).select(*ids, A.smallest_kmer_of(seq_col, k).alias("_m"))
    return found.groupBy(*ids).agg(F.min("_m").alias("sketch"))


def by_bin(rows: DataFrame) -> DataFrame:
    """Rows of one ``bin`` in one task; tables dealt this way meet on ``bin`` and further columns without another shuffle."""
    return rows.repartition(FINER * shuffle_partitions(rows.sparkSession), "bin")


def run_kmers(pieces: DataFrame, k: int, *cols, skip: int = 0) -> DataFrame:
    """``cols.., _p, kmer`` of every k-mer of the pieces; ``skip``: bases of a piece before its first k-mer."""
    places = pieces.select("*", F.explode(F.sequence(F.lit(0), F.length("piece") - (k + skip))).alias("_p"))
    return places.select(*cols, "_p", S.piece("piece", F.col("_p") + skip, k).alias("kmer"))


def sought_kmers(reads: DataFrame, k: int, ids: list[str], wanted: DataFrame) -> DataFrame:
    """``id.., pos, key``: the k-mer occurrences whose 8-byte ``key`` is that of a row ``kmer`` of ``wanted``.

    The wanted k-mers go to the bins of the runs; only what is wanted leaves them, and runs of other bins do not go there.
    """
    marks = bin_marks(kmer_runs(wanted.select("kmer"), k, [], "kmer").select("bin"))
    asked = kmer_runs(wanted.select("kmer").distinct(), k, [], "kmer")
    found = told_kmers(asked, kmer_runs(reads, k, ids, marks=marks), k, FINER * shuffle_partitions(reads.sparkSession))
    return found.select(*ids, "pos", F.xxhash64("kmer").alias("key"))


def _counted(reads: DataFrame, k: int) -> DataFrame:
    """``bin, kmer, n``; copies are cut once and equal pieces are read once."""
    texts = reads.groupBy("seq").agg(F.count("*").alias("n"))
    pieces = by_bin(kmer_runs(texts, k, ["n"])).groupBy("bin", "piece").agg(F.sum("n").alias("n"))
    return run_kmers(pieces, k, "bin", "n").groupBy("bin", "kmer").agg(F.sum("n").alias("n"))


def distinct_kmers(reads: DataFrame, k: int) -> DataFrame:
    pieces = by_bin(kmer_runs(reads.select("seq").distinct(), k, [])).select("bin", "piece").distinct()
    return run_kmers(pieces, k, "bin").select("bin", "kmer").distinct().select("kmer")


def posting_counts(reads: DataFrame, k: int) -> DataFrame:
    """``kmer, postings``: occurrences, repeats inside one read included."""
    return _counted(reads, k).select("kmer", F.col("n").alias("postings"))


def postings(reads: DataFrame, k: int) -> DataFrame:
    """Distinct ``kmer, read_id`` rows: the inverted index as a table."""
    return kmer_table(reads, k).select("kmer", "read_id").distinct()


def known_kmers(reads: DataFrame, reference: DataFrame, k: int) -> DataFrame:
    """k-mer occurrences of ``reads`` that also occur in ``reference``."""
    return kmer_table(reads, k).join(distinct_kmers(reference, k), "kmer", "left_semi")


def near_ends(indent: int, k: int, length: Column) -> Column:
    """Windows within ``indent`` bases of either end."""
    return (F.col("pos") < indent) | (F.col("pos") + k > length - indent)


def end_counts(reads: DataFrame, k: int, indent: int) -> DataFrame:
    """``read_id, places, kmers``: k-mers within ``indent`` bases of either end of a read, all and distinct ones.

    The two ends travel as they are and give their k-mers where the rows of a read meet.
    """
    span, n = indent + k - 1, F.length("seq")
    cut = F.when(n <= indent + span, F.array("seq")).otherwise(F.array(S.piece("seq", 0, span), S.piece("seq", n - span, span)))
    pieces = reads.where(n >= k).select("read_id", F.explode(cut).alias("piece"))
    dealt = pieces.repartition(FINER * shuffle_partitions(reads.sparkSession), "read_id")
    each = run_kmers(dealt, k, "read_id").groupBy("read_id", "kmer").agg(F.count("*").alias("n"))
    return each.groupBy("read_id").agg(F.sum("n").alias("places"), F.count("*").alias("kmers"))


def _matches(repertoires: DataFrame, k: int, min_overlap: int, indent: int | None, max_occurrences: Column | None) -> DataFrame:
    """``rep_a, a_id, rep_b, b_id, shift`` of common k-mers; a shift may repeat.

    k-mers travel in runs to the place where they are compared, and on as two 8-byte hashes.  Where all of them count, only the first
    k-mer of a run of equal bases is reported: it is the one whose bases before
    differ, so a pair meets once per run and not once per base.  The occurrences of
    a frequent k-mer are dealt to parts on the probing side and repeated in every part on
    the indexed side.
    """
    whole = indent is None and max_occurrences is None
    keys = ["key", "check"]
    marked = repertoires.select("rep_id", "cluster_id", F.length("seq").alias("_len"), "seq")
    pieces = by_bin(kmer_runs(marked, k, ["rep_id", "cluster_id", "_len"], before=START))
    bins, same = Window.partitionBy("bin"), Window.partitionBy("bin", *keys)
    pieces = pieces.withColumns({"_lo": F.min("rep_id").over(bins), "_hi": F.max("rep_id").over(bins)}).where("_lo < _hi")
    occ = run_kmers(pieces, k, "bin", "rep_id", "cluster_id", "_len", "at", "piece", skip=1).select(
        "bin", "rep_id", "cluster_id", "_len", (F.col("at") + F.col("_p")).alias("pos"), S.piece("piece", F.col("_p"), 1).alias("before"),
        F.xxhash64("kmer").alias("key"), F.xxhash64(F.lit(1), F.col("kmer")).alias("check"))
    places = occ.withColumns({"_n": F.count("*").over(same), "_lo": F.min("rep_id").over(same), "_hi": F.max("rep_id").over(same),
                              "_b": F.min("before").over(same), "_c": F.max("before").over(same)}).where("_lo < _hi")
    if whole:  # with one base before all of them no two of a k-mer are reported
        places = places.where((F.col("_b") != F.col("_c")) | (F.col("_b") == START))
    met = settled(places.withColumn("parts", F.ceil(F.col("_n") / HOT_KMER).cast("int")).drop("bin", "_n", "_lo", "_hi", "_b", "_c"))
    index = met if indent is None else met.where(near_ends(indent, k, F.col("_len")))
    if max_occurrences is not None:
        sizes = repertoires.groupBy("rep_id").agg(F.count("*").alias("_size"))
        counts = index.groupBy(*keys, F.col("rep_id").alias("rep_b")).agg(F.count("*").alias("occurrences"))
        counts = counts.join(sizes.select(F.col("rep_id").alias("rep_b"), F.col("_size").alias("size_b")), "rep_b")
    probe = met.select(*keys, F.pmod(F.xxhash64("cluster_id", "pos"), F.col("parts")).cast("int").alias("part"), F.col("rep_id").alias("rep_a"),
                       F.col("cluster_id").alias("a_id"), F.col("pos").alias("a_pos"), F.col("_len").alias("a_len"), F.col("before").alias("a_before"))
    right = index.select(*keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("rep_id").alias("rep_b"),
                         F.col("cluster_id").alias("b_id"), F.col("pos").alias("b_pos"), F.col("_len").alias("b_len"), F.col("before").alias("b_before"))
    hits = probe.join(right, [*keys, "part"]).where("rep_a < rep_b")
    if whole:
        hits = hits.where((F.col("a_before") != F.col("b_before")) | (F.col("a_before") == START))
    if max_occurrences is not None:
        hits = hits.join(counts, [*keys, "rep_b"]).join(sizes.select(F.col("rep_id").alias("rep_a"), F.col("_size").alias("size_a")), "rep_a")
        hits = hits.where(F.col("occurrences") <= max_occurrences)
    shift = F.col("a_pos") - F.col("b_pos")
    overlap = F.least(F.col("a_len") - F.greatest(shift, F.lit(0)), F.col("b_len") + F.least(shift, F.lit(0)))
    return hits.where(overlap >= min_overlap).select("rep_a", "a_id", "rep_b", "b_id", shift.alias("shift"))


def shared_kmers(repertoires: DataFrame, k: int = 80, min_overlap: int = 300, indent: int | None = None,
                 max_occurrences: Column | None = None) -> DataFrame:
    """Sequence pairs of two repertoires with a common k-mer, and the shifts it implies.

    ``repertoires`` holds ``rep_id, cluster_id, seq``.  A pair is reported with
    ``rep_a < rep_b``, once for every shift whose overlap is long enough.  By default
    every position is indexed and every k-mer counts, so the result does not depend on
    the order of the repertoires.  ``indent`` indexes the ends of the second
    repertoire only; ``max_occurrences`` is a stop-word rule over the indexed
    repertoire, which may refer to ``size_a`` and ``size_b``, the sequence counts.
    """
    if indent is None and max_occurrences is None:
        return neighbours.pair_shifts(repertoires, k, min_overlap)
    return _matches(repertoires, k, min_overlap, indent, max_occurrences).distinct()


def stop_word_limit(floor: int = 100, ceiling: int = 2000) -> Column:
    """A tenth of the smaller repertoire, within ``floor`` and ``ceiling``."""
    tenth = F.floor(F.least(F.col("size_a"), F.col("size_b")) * 0.1)
    return F.least(F.lit(ceiling), F.greatest(F.lit(floor), tenth))


def scored_neighbours(repertoires: DataFrame, k: int = 80, min_overlap: int = 300, match: int = 1, penalty: int = 5,
                      indent: int | None = None, max_occurrences: Column | None = None) -> DataFrame:
    """Related cluster pairs of different repertoires with their best overlap score.

    Distinct sequences meet in blocks.  With a limit, or where a name stands for several sequences, the shifts of a pair
    are gathered first, so both sequences travel once per pair.
    """
    if indent is None and max_occurrences is None:
        scored = neighbours.pair_scores(repertoires, k, min_overlap, match, penalty)
        if scored is not None:
            return scored
    pair = ["rep_a", "a_id", "rep_b", "b_id"]
    shifts = _matches(repertoires, k, min_overlap, indent, max_occurrences).groupBy(*pair).agg(F.collect_set("shift").alias("shifts"))
    left = repertoires.select(F.col("rep_id").alias("rep_a"), F.col("cluster_id").alias("a_id"), F.col("seq").alias("_sa"))
    right = repertoires.select(F.col("rep_id").alias("rep_b"), F.col("cluster_id").alias("b_id"), F.col("seq").alias("_sb"))
    scored = (shifts.join(left, ["rep_a", "a_id"]).join(right, ["rep_b", "b_id"])
              .select(*pair, A.best_overlap_score("_sa", "_sb", "shifts", match, penalty).alias("score")))
    return scored.where("score > 0")


def best_neighbours(scored: DataFrame) -> DataFrame:
    """Both directions, best score per cluster and other repertoire, all ties kept.

    The scored pairs are checkpointed, since they are used from both sides.
    """
    scored = cut_lineage(scored)
    forward = scored.select(F.col("rep_a").alias("rep_id"), F.col("a_id").alias("cluster_id"),
                            F.col("rep_b").alias("other_rep"), F.col("b_id").alias("neighbour_id"), "score")
    backward = scored.select(F.col("rep_b").alias("rep_id"), F.col("b_id").alias("cluster_id"),
                             F.col("rep_a").alias("other_rep"), F.col("a_id").alias("neighbour_id"), "score")
    both = forward.unionByName(backward)
    return keep_best(both, ["rep_id", "cluster_id", "other_rep"])


def keep_best(hits: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """All hits that reach the best score of their key.

    The maximum is combined map-side and joined back, so no key is gathered in
    one task the way a ranking window would.
    """
    top = hits.groupBy(*keys).agg(F.max(score).alias(score))
    return hits.join(top, [*keys, score])
