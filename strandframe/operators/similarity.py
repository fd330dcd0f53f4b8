"""Similarity join of two read sets: candidates by shared seeds, then best hits.

Scores count edits of the half-banded alignment, where both reads start together
and either may end freely.  A hit is kept when it has at most ``tau`` edits; with
that bound every strategy returns the same best hits.

Copies are matched once: the operators take distinct sequences, and reads reach
their sequence over ``seq_id``.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from strandframe.functions import alignment as A
from strandframe.functions import sequences as S
from strandframe.functions.minimizers import kmer_runs, told_numbers
from strandframe.operators.kmers import FINER, keep_best, sought_kmers
from strandframe.operators.reads import minimum_read_length
from strandframe.session import cut_lineage, settled, shuffle_partitions

BLOCK = 64  # sequences of either side that meet at once
SEEDS = {"single": 1, "pair": 2, "triple": 3}


def sequence_sets(reads: DataFrame) -> DataFrame:
    """``seq_id, seq, copies``: distinct sequences named by their smallest read id."""
    return reads.groupBy("seq").agg(F.min("read_id").alias("seq_id"), F.count("*").alias("copies"))


def _costs(queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """``q_id, costs``: posting count of every k-mer position in the target set.

    k-mers are compared by 8 bytes where their runs meet; a collision can only add a cost.
    One array of counts goes back for each run; k-mers are counted in numpy where the runs of a bin lie side by side.
    """
    partitions = FINER * shuffle_partitions(queries.sparkSession)
    run = told_numbers(kmer_runs(targets, k, ["seq_id"]), kmer_runs(queries, k, ["seq_id"]), k, partitions)
    run = run.select("seq_id", F.struct("at", "ns").alias("r"))
    return run.groupBy(F.col("seq_id").alias("q_id")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["ns"])).alias("costs"))


def _anchored(queries: DataFrame, targets: DataFrame, k: int, tau: int, strategy: str) -> DataFrame:
    """``q_id, pos, kmer``: the cheapest set of disjoint k-mers of each query."""
    count = tau + SEEDS[strategy]
    long_enough = queries.where(F.length("seq") >= minimum_read_length(k, tau, strategy))
    chosen = _costs(long_enough, targets, k).select("q_id", A.choose_anchors("costs", k, count).alias("at"))
    placed = chosen.join(long_enough.select(F.col("seq_id").alias("q_id"), "seq"), "q_id")
    return placed.select("q_id", F.explode(F.transform("at", lambda p: F.struct(
        p.alias("pos"), S.piece("seq", p, k).alias("kmer")))).alias("a")).select("q_id", "a.pos", "a.kmer")


def anchors(queries: DataFrame, targets: DataFrame, k: int, tau: int, strategy: str) -> DataFrame:
    """``q_id, pos, key``: the cheapest set of disjoint k-mers of each query."""
    return _anchored(queries, targets, k, tau, strategy).select("q_id", "pos", F.xxhash64("kmer").alias("key"))


def anchored_candidates(queries: DataFrame, targets: DataFrame, k: int, tau: int, strategy: str) -> DataFrame:
    """``q_id, t_id``: targets sharing enough of the query's anchors, at most ``tau`` bases from their place.

    Both reads start together, so ``tau`` edits cannot displace an anchor further.
    """
    need = SEEDS[strategy]
    placed = settled(_anchored(queries, targets, k, tau, strategy))
    index = sought_kmers(targets, k, ["seq_id"], placed).select("key", F.col("seq_id").alias("t_id"), F.col("pos").alias("t_pos"))
    shared = placed.select("q_id", "pos", F.xxhash64("kmer").alias("key")).join(index, "key").where(F.abs(F.col("pos") - F.col("t_pos")) <= tau)
    if need == 1:
        return shared.select("q_id", "t_id").distinct()
    return (shared.groupBy("q_id", "t_id").agg(F.count_distinct("pos").alias("n"))
            .where(F.col("n") >= need).select("q_id", "t_id"))


def _seed_rows(seqs: DataFrame, tau: int, probing: bool) -> DataFrame:
    """Seeds ``lv, block, seed``: blocks of ``2^lv`` bases at the start of a read.

    Of a pair within ``tau`` edits all but the last ``tau`` bases of the shorter read
    are aligned.  ``tau`` edits leave one of ``tau + 1`` blocks of that stretch intact,
    displaced by at most ``tau`` in the longer read.  The shorter read offers its
    blocks at its largest level; the longer one answers at every level.
    """
    length, count = F.length("seq"), tau + 1
    stretch = length - F.lit(0 if probing else tau)
    top = F.floor(F.log2(stretch / count)).cast("int")
    usable = seqs.where(length > 2 * tau)
    level = F.explode(F.sequence(F.lit(0), top)) if probing else top
    blocks = usable.select("seq_id", "seq", level.alias("lv")).select(
        "seq_id", "seq", "lv", F.expr("shiftleft(1, lv)").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(tau))).alias("block"))
    if not probing:
        return blocks.select("seq_id", "lv", "block", F.xxhash64(S.piece("seq", F.col("block") * F.col("size"), F.col("size"))).alias("seed"))
    moved = blocks.select("*", F.explode(F.sequence(F.lit(-tau), F.lit(tau))).alias("move"))
    start = F.col("block") * F.col("size") + F.col("move")
    return (moved.where((start >= 0) & (start + F.col("size") <= length))
            .select("seq_id", "lv", "block", F.xxhash64(S.piece("seq", start, F.col("size"))).alias("seed")).distinct())


def seeded_pairs(a: DataFrame, b: DataFrame, tau: int) -> DataFrame:
    """``a_id, b_id``: every pair that can be within ``tau`` edits, found without anchors.

    The shorter read offers its blocks at its own level and the longer one
    answers with displaced windows, so both directions are tried.  Reads of at most
    ``2 * tau`` bases have no block that must stay intact; ``short_hits`` answers them.
    """
    def probe(short: DataFrame, long: DataFrame, names: tuple[str, str]) -> DataFrame:
        s = _seed_rows(short, tau, probing=False).withColumnRenamed("seq_id", names[0])
        t = _seed_rows(long, tau, probing=True).withColumnRenamed("seq_id", names[1])
        return s.join(t, ["lv", "block", "seed"]).select(*names).distinct()
    return probe(a, b, ("a_id", "b_id")).unionByName(probe(b, a, ("b_id", "a_id"))).distinct()


def _keys(whole: DataFrame, begun: DataFrame, col: str, tau: int) -> DataFrame:
    """A ``key`` for each of ``whole`` and for each start of ``begun``, without up to ``tau`` of its bases."""
    starts = F.transform(F.sequence(F.lit(0), F.length(col)), lambda n: F.substr(F.col(col), F.lit(1), n))
    texts = whole.withColumns({"text": F.col(col), "whole": F.lit(True)}).unionByName(
        begun.withColumns({"text": F.explode(starts), "whole": F.lit(False)}))
    return texts.withColumn("key", F.explode(A.thinned("text", tau))).drop("text").distinct()


def _met(few: DataFrame, starts: DataFrame, tau: int, longest: int) -> DataFrame:
    """Pairs of ``few`` (``side, _s, s_open``) and ``starts`` (``side, _t, t_open``), one of them open: a superset of those within ``tau`` edits.

    One of the two is used up and meets a start of the other.  Strings within ``tau`` edits
    become equal when each loses at most ``tau`` bases.  Closed reads meet open ones only.
    """
    low = starts.where(F.length("_t") < longest + tau)  # a longer one is not used up before a read of ``longest`` bases
    left = _keys(few, few, "_s", tau).withColumn("ask", F.when(F.col("s_open"), 0).otherwise(1))
    right = _keys(low, starts, "_t", tau).withColumn("whole", ~F.col("whole"))
    right = right.withColumn("ask", F.explode(F.when(F.col("t_open"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, ["side", "whole", "key", "ask"]).select("side", "_s", "_t", "s_open", "t_open").distinct()


def short_hits(a: DataFrame, b: DataFrame, tau: int) -> DataFrame | None:
    """``side, q_id, hit_id, score`` of the best hits in which a read of at most ``2 * tau`` bases takes part.

    Holds the best hits of these reads, and for every other read its best hits among them;
    None if there are none.  A score looks at no base of the longer read beyond the length of the
    shorter one and ``tau``, so distinct short reads meet distinct starts of ``3 * tau``
    bases, whose number has a bound whatever the input.  The bound on edits rises from 0, and
    only what has no hit yet is sought further: a read of ``tau`` bases is within ``tau``
    edits of every read, but the best hits are few.
    """
    def both(pick) -> DataFrame:
        return pick(a, b, "a").unionByName(pick(b, a, "b"))
    starts = settled(both(lambda own, other, side: other.select(
        F.lit(side).alias("side"), F.col("seq_id").alias("t_id"), F.substring("seq", 1, 3 * tau).alias("_t"))))
    few = starts.where(F.length("_t") <= 2 * tau).select(
        F.translate("side", "ab", "ba").alias("side"), F.col("t_id").alias("s_id"), F.col("_t").alias("_s"))
    if few.isEmpty():
        return None
    all_s, all_t = few.select("side", "_s").distinct(), starts.select("side", "_t").distinct()

    def marked(every: DataFrame, col: str, flag: str, hits: DataFrame | None) -> DataFrame:
        if hits is None:
            return every.withColumn(flag, F.lit(True))
        known = hits.select("side", col).distinct().withColumn("_known", F.lit(True))
        return every.join(known, ["side", col], "left").select("side", col, F.col("_known").isNull().alias(flag))
    hits = None
    for bound in range(tau + 1):
        asking, asked = marked(all_s, "_s", "s_open", hits), marked(all_t, "_t", "t_open", hits)
        if hits is not None and asking.where("s_open").isEmpty() and asked.where("t_open").isEmpty():
            break
        met = _met(asking, asked, bound, 2 * tau)
        found = settled(met.withColumn("score", A.bounded_score("_s", "_t", bound)).where("score IS NOT NULL"))
        hits = found if hits is None else hits.unionByName(found)
    ways = F.array(F.when(F.col("s_open"), F.struct("side", F.col("s_id").alias("q_id"), F.col("t_id").alias("hit_id"))),
                   F.when(F.col("t_open"), F.struct(F.translate("side", "ab", "ba").alias("side"), F.col("t_id").alias("q_id"), F.col("s_id").alias("hit_id"))))
    rows = hits.join(few, ["side", "_s"]).join(starts, ["side", "_t"])
    return rows.select(F.explode(F.array_compact(ways)).alias("w"), "score").select("w.*", "score").distinct()


def _both_ways(a: DataFrame, b: DataFrame, k: int, tau: int, strategy: str) -> DataFrame:
    ab = anchored_candidates(a, b, k, tau, strategy).select(F.col("q_id").alias("a_id"), F.col("t_id").alias("b_id"))
    ba = anchored_candidates(b, a, k, tau, strategy).select(F.col("t_id").alias("a_id"), F.col("q_id").alias("b_id"))
    return ab.unionByName(ba).distinct()


def unanchored_pairs(a: DataFrame, b: DataFrame, k: int, tau: int, strategy: str) -> DataFrame:
    """``a_id, b_id``: pairs with a read too short for the anchors of ``strategy``, by seeds."""
    short = F.length("seq") < minimum_read_length(k, tau, strategy)
    return seeded_pairs(a.where(short), b, tau).unionByName(seeded_pairs(a, b.where(short), tau)).distinct()


def _outlined(pairs: DataFrame, a: DataFrame, b: DataFrame, tau: int) -> DataFrame:
    """Of ``pairs`` those whose outlines do not rule out ``tau`` edits, with ``n``, the bases of the shorter sequence."""
    def outlines(seqs: DataFrame, end: str) -> DataFrame:
        return seqs.select(F.col("seq_id").alias(f"{end}_id"), F.length("seq").alias(f"_n{end}"), A.outline("seq").alias(f"_o{end}"))
    met = pairs.join(outlines(a, "a"), "a_id").join(outlines(b, "b"), "b_id")
    return met.where(A.outlines_agree("_oa", "_ob", F.least("_na", "_nb"), tau)).groupBy("a_id", "b_id").agg(F.max(F.least("_na", "_nb")).alias("n"))


def _blocks(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``g, ca, cb``: a block, in which about ``BLOCK`` sequences of either side meet.

    Near copies make pairs with each other; they are named by their smallest partner and dealt to blocks on both sides.
    """
    named = pairs.groupBy("a_id").agg(F.min("b_id").alias("g"))
    placed = settled(pairs.join(named, "a_id"))
    sizes = named.groupBy("g").agg(F.count("*").alias("_na")).join(placed.groupBy("g").agg(F.count_distinct("b_id").alias("_nb")), "g")
    part = lambda end: F.pmod(F.xxhash64(f"{end}_id"), F.ceil(F.col(f"_n{end}") / BLOCK)).cast("int").alias(f"c{end}")
    return settled(placed.join(sizes, "g").select("g", part("a"), part("b"), *pairs.columns))


def score_pairs(pairs: DataFrame, a: DataFrame, b: DataFrame, tau: int) -> DataFrame:
    """``a_id, b_id, score`` of the distinct ``pairs`` within ``tau`` edits.

    A sequence goes to the blocks its pairs lie in, not to each of its pairs, as far as a score looks: no base counts
    beyond the length of the shorter one and ``tau``.  NULL sequences have no hits.
    """
    a, b = a.where("seq IS NOT NULL"), b.where("seq IS NOT NULL")
    keys = ["g", "ca", "cb"]
    blocks = _blocks(settled(_outlined(pairs, a, b, tau)))
    sides = [blocks.groupBy(*keys, f"{end}_id").agg((F.max("n") + tau).alias("_cut")).join(seqs.select(F.col("seq_id").alias(f"{end}_id"), "seq"), f"{end}_id").select(
        *keys, F.lit(kind).alias("kind"), f"{end}_id", F.substr("seq", F.lit(1), F.col("_cut")).alias("seq")) for kind, (end, seqs) in enumerate((("a", a), ("b", b)))]
    rows = blocks.drop("n").withColumn("kind", F.lit(2)).unionByName(sides[0], allowMissingColumns=True).unionByName(sides[1], allowMissingColumns=True)
    dealt = rows.repartition(FINER * shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys, "kind").select(*keys, "kind", "a_id", "b_id", "seq")
    kinds = dict(rows.dtypes)
    schema = StructType.fromDDL(f"a_id {kinds['a_id']}, b_id {kinds['b_id']}, score long")
    target = to_arrow_schema(schema)

    def within(x: str, y: str) -> int | None:
        return A.edits_within(x, y, tau) if tau else 0 if x.startswith(y) or y.startswith(x) else None

    def run(batches):
        key, held = None, ({}, {})
        for batch in batches:
            out = [], [], []
            for *own, kind, i, j, seq in zip(*(c.to_pylist() for c in batch.columns)):
                if own != key:
                    key, held = own, ({}, {})
                if kind < 2:
                    held[kind].setdefault((i, j)[kind], []).append(seq)
                    continue
                for x in held[0].get(i, ()):
                    for y in held[1].get(j, ()):
                        edits = within(x, y)
                        if edits is not None:
                            for column, value in zip(out, (i, j, -edits)):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, target.types)], schema=target)

    return dealt.mapInArrow(run, schema)


def candidates(a: DataFrame, b: DataFrame, k: int, tau: int, strategy: str) -> DataFrame:
    """``a_id, b_id``: a superset of the pairs within ``tau`` edits.

    ``naive`` uses position-bound seeds instead of anchors; the anchored strategies
    use them for reads below ``minimum_read_length``.  With ``tau > 0`` the pairs of reads of
    at most ``2 * tau`` bases are left to ``short_hits``.
    """
    if strategy == "naive":
        return seeded_pairs(a, b, tau)
    return _both_ways(a, b, k, tau, strategy).unionByName(unanchored_pairs(a, b, k, tau, strategy)).distinct()


def best_hits(a: DataFrame, b: DataFrame, k: int = 36, tau: int = 3, strategy: str = "triple") -> DataFrame:
    """``side, q_id, hit_id, score``: best hits of every sequence on the other side, ties kept.

    The scored pairs are used four times and therefore written once.
    """
    def one_way(rows: DataFrame, side: str, q: str, hit: str) -> DataFrame:
        return rows.select(F.lit(side).alias("side"), F.col(q).alias("q_id"), F.col(hit).alias("hit_id"), "score")
    scored = cut_lineage(score_pairs(candidates(a, b, k, tau, strategy), a, b, tau))
    sides = one_way(scored, "a", "a_id", "b_id").unionByName(one_way(scored, "b", "b_id", "a_id"))
    if tau == 0:
        return keep_best(sides, ["side", "q_id"])
    few = short_hits(a, b, tau)
    return keep_best(cut_lineage(sides.unionByName(few)) if few else sides, ["side", "q_id"])


def best_hit_lines(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """``q_id, line``: ``score id id ...`` per query in id order, blank when there is no hit."""
    lists = hits.groupBy("q_id", "score").agg(F.array_join(F.transform(
        F.sort_array(F.collect_set("hit_id")), lambda x: x.cast("string")), " ").alias("ids"))
    return (queries.select(F.col("seq_id").alias("q_id")).join(lists, "q_id", "left")
            .select("q_id", F.coalesce(F.concat_ws(" ", F.col("score").cast("string"), "ids"), F.lit("")).alias("line")))
