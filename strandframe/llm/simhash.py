"""SimHash near-duplicates through pigeonhole blocks.

Two 64-bit fingerprints that differ in at most three bits agree on at least one
of four blocks; within the other 48 bits the same holds for four smaller blocks.
Every fingerprint therefore gets 16 keys of 28 bits, and each close pair meets
under one of them.  A key that still holds very many different fingerprints is
split again by four blocks of its remaining bits, as often as needed: after each
split a group cannot be larger than the bits that are left allow, so no group is
unbounded and no pair is lost.

A group is not expanded into pairs: the members' distances are verified in
numpy, and only links that join its parts are kept (fewer than it has members).
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.shared import map_batches, written
from strandframe.operators.components import components

BITS = 64
DISTANCE = 3
SHINGLE = 3
SEED = 42
LEAST_BITS = 15  # with so many bits left a group has at most 32,768 members and is not split again
LARGEST_GROUP = 2048  # fingerprints verified at once; larger groups are split by further blocks


def fingerprint_of(text: str, shingle: int = SHINGLE) -> int:
    """Majority of the shingles' hash bits; 0 without words."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(b" ".join(words[i:i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))], ">u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].view(np.uint8)).reshape(-1, BITS)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``key, fp`` (64 bits as a signed long) of every row; NULL and empty texts have 0."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for keys, texts in batches:
            yield keys, [signed(fingerprint_of(t or "", shingle)) for t in texts]

    return map_batches(docs.select(key, text), run, f"`{key}` {kind}, fp long")


def _blocks(mask: int, parts: int) -> list[int]:
    """``mask`` joined with each of ``parts`` even blocks of the bits outside it."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def _split(keyed: DataFrame, masks: list[int], parts: int) -> tuple[DataFrame, list[int]]:
    """Each row ``fp, mask`` once for every block that refines its mask; ``masks``: all present masks."""
    finer = [(signed(m), signed(f)) for m in masks for f in _blocks(m, parts)]
    # at most 4 rows for each of the 16 * 4 ** splits masks: 4,096 rows for the finest
    table = F.broadcast(keyed.sparkSession.createDataFrame(finer, "mask long, finer long"))
    rows = keyed.join(table, "mask").select("fp", F.col("finer").alias("mask"))
    return rows.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))), sorted({f for m in masks for f in _blocks(m, parts)})


def _joined(group: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links between distinct fingerprints of one group: a star for each part that hangs together."""
    n = len(group)
    part, plain = np.arange(n), group.view(np.uint64)  # unsigned: the bits of a negative number are not its own
    for i in range(n - 1):
        close = np.flatnonzero(np.bitwise_count(plain[i + 1:] ^ plain[i]) <= distance) + i + 1
        if len(close):
            labels = np.unique(part[np.append(close, i)])
            if len(labels) > 1:
                part[np.isin(part, labels)] = labels[0]
    return [(int(group[part[i]]), int(group[i])) for i in range(n) if part[i] != i]


def _links_within(rows: DataFrame, distance: int) -> DataFrame:
    """``src, dst`` from rows ``mask, bits, fp``: verified links inside each group of one key."""

    def run(batches):
        held_key, held = None, []

        def close(a, b):
            group = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            for x, y in _joined(group, distance):
                a.append(x)
                b.append(y)

        for masks, bits, fps in batches:
            a, b = [], []
            keys = np.stack([np.array(masks, np.int64), np.array(bits, np.int64)], axis=1)
            fps = np.array(fps, np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1 if len(keys) else []
            for chunk, at in zip(np.split(fps, cuts), [0, *cuts]):
                if not len(chunk):
                    continue
                key = tuple(keys[at])
                if key != held_key:
                    close(a, b)
                    held_key, held = key, []
                held.append(chunk)
            yield a, b
        a, b = [], []
        close(a, b)
        yield a, b

    dealt = rows.repartition("mask", "bits").sortWithinPartitions("mask", "bits")
    return map_batches(dealt.select("mask", "bits", "fp"), run, "src long, dst long")


def close_links(distinct: DataFrame, distance: int = DISTANCE, largest: int = LARGEST_GROUP) -> DataFrame:
    """``src, dst``: links that connect all fingerprints ``fp`` within ``distance`` bits of each other.

    Every returned pair is within the distance or both ends hang together through
    verified pairs of one group; every close pair is connected by returned links.
    """
    parts = distance + 1
    masks = [m for block in _blocks(0, parts) for m in _blocks(block, parts)]
    start = distinct.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    rows = start.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
    links = None
    while True:
        sizes = rows.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        left = BITS - max(bin(m).count("1") for m in masks)
        keyed = written(rows.join(sizes, ["mask", "bits"]), "blocks")
        splits = left > LEAST_BITS and not keyed.where(F.col("n") > largest).isEmpty()
        own = _links_within(keyed.where(F.col("n") <= largest) if splits else keyed, distance)
        links = own if links is None else links.unionByName(own)
        if not splits:
            return links
        rows, masks = _split(keyed.where(F.col("n") > largest), masks, parts)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE,
                    shingle: int = SHINGLE) -> DataFrame:
    """``key, fingerprint, component_id``: 16 hexadecimal digits and the smallest key that is reachable
    over fingerprints at most ``distance`` bits apart.

    NULL, empty and blank texts have fingerprint zero and link like any other.  NULL
    keys stay as rows and never name a component with another key in it; repeated
    rows are returned as they come; other columns are ignored.
    """
    prints = written(fingerprints(docs, key, text, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min(key).alias("_least"))
    links = written(close_links(distinct.select("fp"), distance).distinct(), "links")
    inside = links.select(F.col("src").alias("id")).unionByName(links.select(F.col("dst").alias("id"))).distinct()
    parts = components(inside, links)
    labelled = distinct.join(parts.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "_least", F.coalesce("component", "fp").alias("_part"))
    least = labelled.groupBy("_part").agg(F.min("_least").alias("component_id"))
    named = labelled.join(least, "_part").select("fp", "component_id")
    return prints.join(named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of its component, with all their columns.

    Of repeated rows with that key one stays.  Rows with a NULL key cannot be named
    by it and all stay.
    """
    groups = near_duplicates(docs, key, text, distance)
    kept = groups.where(F.col(key) == F.col("component_id")).select(key).distinct()
    rows = docs.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)
    return rows.unionByName(docs.where(F.col(key).isNull()))
