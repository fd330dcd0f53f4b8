"""One of each set of near copies: shingles of five words, Jaccard similarity of 0.8 or more.

SimHash comes first: of texts whose fingerprints hang together over three bits those go that are
confirmed to be like the earliest.  A pair of 0.8 may lie about ten of 64 SimHash bits apart, where
pigeonhole blocks are too small to tell texts apart.  Candidates among what is left therefore meet in bands of
min-hashes (a pair of 0.8 meets in none of them with a chance below 1 in 10,000), and each is
confirmed on the shingles themselves.

Inside a band texts are told apart by their signatures in numpy, and no pairs are made
there: a text names the earlier ones most like it, first one, then of what is left eight,
64 and so on.  Only named pairs are confirmed, and texts found to be copies take no
further part.  A band with many texts is dealt to parts, anew in every round: its copies go part
by part, and what is left of it, if still large, is unlike enough for further min-hashes to split it.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandframe.llm import simhash
from strandframe.llm.shared import map_batches, written

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5  # 1 - (1 - 0.8 ** 5) ** 25 = 0.99995
MARGIN = 0.15  # of the signature's estimate: four standard errors at 0.8
SAME = 0.98  # estimates from which a text need not be held beside the earlier one
LARGEST_GROUP = 2048
WAYS = 4  # refined keys of a text in a large group, of two min-hashes each: 1 - (1 - 0.8 ** 2) ** 4 = 0.983 in every band
SEED = 42


def shingles(text: str, shingle: int = SHINGLE) -> set[bytes]:
    """Runs of ``shingle`` words; of fewer words one, without words none."""
    words = text.encode("utf-8").lower().split()
    return {b" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def similarity(a: set[bytes], b: set[bytes]) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, np.uint64) | np.uint64(1)


def min_hashes(text: str) -> np.ndarray:
    """``BANDS * ROWS`` least hash values; texts without words share theirs."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text)] or [0], np.uint64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    factors, offsets = _odd(BANDS * ROWS, SEED), _odd(BANDS * ROWS, SEED + 1)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at:at + 2048, None] * factors + offsets).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A signed 64-bit key for every band."""
    return [xxhash.xxh64_intdigest(band.tobytes(), i) - (1 << 63) for i, band in enumerate(least.reshape(BANDS, ROWS))]


def _marks(least: np.ndarray) -> bytes:
    """Two bytes of each min-hash, enough to compare signatures: the low bits of a minimum are spread evenly."""
    return least.astype("<u2").tobytes()


def _signed(texts: DataFrame, key: str) -> DataFrame:
    def run(batches):
        for ids, keys, bodies in batches:
            least = [min_hashes(t) for t in bodies]
            yield ids, keys, [_marks(m) for m in least], [band_keys(m) for m in least]

    kind = texts.schema[key].dataType.simpleString()
    return map_batches(texts.select("_id", key, "_body"), run, f"_id binary, _key {kind}, sig binary, keys array<bigint>")


def _together(rows: DataFrame) -> DataFrame:
    """``rows`` of groups ``bits`` with two members or more, with the size ``n`` of the group."""
    return rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bits"))).where("n > 1")


def _refined(rows: DataFrame, level: int) -> DataFrame:
    """``rows`` under finer keys: two more min-hashes each, other ones than those of the band and of earlier levels."""
    ways = rows.withColumn("way", F.explode(F.array(*[F.lit(level * WAYS + w) for w in range(WAYS)])))
    at = f"cast((band + 1 + way) % {BANDS} * {2 * ROWS} + 1 as int)"
    return _together(ways.withColumn("bits", F.expr(f"xxhash64(bits, way, substring(sig, {at}, 4))")).drop("way", "n"))


def _named(rows: DataFrame, wanted: int, least: float) -> DataFrame:
    """``_id, first, estimate, bits``: up to ``wanted`` earlier texts of its group that a text is most like.

    ``rows``: ``bits, part, _key, _id, sig, tried``; pairs of an id with one of its ``tried`` are left out.
    """
    size = BANDS * ROWS

    def run(batches):
        key, marks, ids, count = None, np.zeros((64, size), np.uint16), [], 0
        for bits, parts, own_ids, sigs, tried in batches:
            out = [], [], [], []
            for b, part, i, sig, seen in zip(bits, parts, own_ids, sigs, tried):
                if (b, part) != key:
                    key, ids, count = (b, part), [], 0
                own, hold = np.frombuffer(sig, "<u2"), True
                if count:
                    like = (marks[:count] == own).sum(axis=1) / size
                    near = np.flatnonzero(like >= least)
                    near = [j for j in near[np.argsort(-like[near], kind="stable")] if not seen or ids[j] not in seen]
                    for j in near[:wanted]:
                        for column, value in zip(out, (i, ids[j], float(like[j]), b)):
                            column.append(value)
                    hold = not near or like[near[0]] < SAME
                if hold:
                    if count == len(marks):
                        marks = np.concatenate([marks, np.zeros_like(marks)])
                    marks[count] = own
                    ids.append(i)
                    count += 1
            yield out

    dealt = rows.repartition("bits", "part").sortWithinPartitions("bits", "part", "_key", "_id")
    return map_batches(dealt.select("bits", "part", "_id", "sig", "tried"), run, "_id binary, first binary, estimate double, bits long")


def _confirmed(pairs: DataFrame, bodies: DataFrame, least: float) -> DataFrame:
    """``_id, first`` of the pairs whose texts are at least ``least`` similar.

    Each text goes to its pairs, not the pairs to a text, so a text with many pairs is spread over all tasks.
    """

    def run(batches):
        held, own = None, set()
        for ids, firsts, texts in batches:
            out = [], []
            for i, first, body in zip(ids, firsts, texts):
                if (i, first) != held:
                    held, own = (i, first), shingles(body)
                elif similarity(shingles(body), own) >= least:
                    out[0].append(i)
                    out[1].append(first)
            yield out

    sides = pairs.select("_id", "first", F.explode(F.array("_id", "first")).alias("side"))
    both = sides.join(bodies.select(F.col("_id").alias("side"), "_body"), "side").repartition("_id", "first").sortWithinPartitions("_id", "first")
    return map_batches(both.select("_id", "first", "_body"), run, "_id binary, first binary")


def copies(texts: DataFrame, key: str, least: float = SIMILARITY, largest: int = LARGEST_GROUP) -> DataFrame:
    """``_id`` of texts that hang together with an earlier one; ``texts``: ``_id, _body, key``, ids distinct.

    Earlier is the smaller key, then the smaller id.  Of two texts that meet in a band and
    are at least ``least`` similar one is returned; the earliest of all that hang together never is.
    """
    signed = written(_signed(texts, key), "signed")
    alone = signed.select("_id", F.posexplode("keys").alias("band", "bits"))
    meeting = written(_together(alone).join(signed.drop("keys"), "_id"), "bands")  # a text that is alone under all its keys takes no part
    found = texts.select("_id").limit(0)
    if meeting.isEmpty():
        return found
    bodies = written(texts.select("_id", "_body").join(meeting.select("_id").distinct(), "_id", "left_semi"), "bodies")
    rows, tried, wanted, level, turn, levels = meeting, None, 1, 0, 0, (BANDS - 1) // WAYS
    while True:
        # when all min-hashes are used, a group holds texts of which the first stands for the others
        parts = F.ceil(F.col("n") / largest) if level < levels else F.lit(1)
        given = rows.withColumn("part", F.pmod(F.xxhash64("_id", F.lit(turn)), parts))
        given = given.withColumn("tried", F.lit(None).cast("array<binary>")) if tried is None else given.join(
            tried.groupBy("_id").agg(F.collect_list("first").alias("tried")), "_id", "left")
        named, turn = written(_named(given, wanted, least - MARGIN), "named"), turn + 1
        if named.isEmpty():
            large = rows.where(F.col("n") > largest)
            if level == levels or large.isEmpty():
                return found
            rows, level = written(_refined(large, level), "refined"), level + 1
            continue
        best = Window.partitionBy("_id").orderBy(F.desc("estimate"), "first")
        pairs = written(named.select("_id", "first", "estimate").distinct().withColumn("rank", F.row_number().over(best))
                        .where(F.col("rank") <= wanted).select("_id", "first"), "pairs")
        now = written(_confirmed(pairs, bodies, least).select("_id").distinct(), "copies")
        found = found.unionByName(now)
        tried = written((pairs if tried is None else tried.unionByName(pairs)).join(now, "_id", "left_anti"), "tried")
        # a group of one part in which nothing was named has nothing more to name
        open_groups = named.select("bits").unionByName(rows.where(F.col("n") > largest).select("bits")).distinct()
        rows = written(_together(rows.join(open_groups, "bits", "left_semi").join(now, "_id", "left_anti").drop("n")), "bands")
        wanted *= 8  # a round costs more than the few pairs named too many


def print_copies(texts: DataFrame, key: str, least: float = SIMILARITY) -> DataFrame:
    """``_id`` of texts whose SimHash hangs together with that of an earlier text they are at least ``least`` similar to.

    Parts of fingerprints are those of ``simhash.near_duplicates``; the earliest text of a part stands for it.
    """
    parts = simhash.near_duplicates(texts, "_id", "_body").select("_id", "component_id").join(texts.select("_id", key), "_id")
    first = parts.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("_id", F.struct(key, "_id")).alias("first"))
    pairs = written(parts.join(first.where("n > 1"), "component_id").where(F.col("_id") != F.col("first")).select("_id", "first"), "prints")
    return written(_confirmed(pairs, texts.select("_id", "_body"), least).select("_id"), "copies")


def one_of_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY,
                   largest: int = LARGEST_GROUP) -> DataFrame:
    """``docs`` without later near copies, with all columns, whatever their names.

    Of rows with one text that with the smallest key stays; different texts under one key
    are told apart.  NULL counts as an empty text.  Rows with a NULL key all stay.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    whole = docs.where(F.col(key).isNotNull()).select(F.unhex(F.md5(body.cast("binary"))).alias("_id"), F.col(key).alias("_key"),
                                                      F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    texts = written(whole.groupBy("_id").agg(F.min("_key").alias("_key"), F.min_by("_row", "_key").alias("_row")), "texts")
    bodies = texts.select("_id", "_key", F.coalesce(F.col("_row").getField(text), F.lit("")).alias("_body"))
    alike = print_copies(bodies, "_key", least)
    found = copies(bodies.join(alike, "_id", "left_anti"), "_key", least, largest)
    kept = texts.join(alike.unionByName(found), "_id", "left_anti").select("_row.*")
    return kept.unionByName(docs.where(F.col(key).isNull()))
