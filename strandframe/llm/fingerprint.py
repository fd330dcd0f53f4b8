"""Lempel-Ziv phrase fingerprints.

A text is parsed into phrases as a Lempel-Ziv coder does: each phrase is the
shortest string at its place that is not in the dictionary yet.  The hashes of
the phrase set are reduced to their smallest values; two texts that would
compress well together share phrases, and with them small hashes.
"""

import bisect
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandframe.llm.shared import map_batches

SIZE = 128  # hashes kept: the standard error of a likeness is at most 0.05
FACTOR, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93  # odd 64-bit numbers
BLOCK = 65_536  # phrases hashed at once


def parse(text: str, begin: int, known: set) -> tuple[int, list[str]]:
    """Parse ``text`` from ``begin``: where the open last phrase begins, and the new phrases, which join ``known``."""
    added, phrase = [], ""
    for c in text[begin:]:
        phrase += c
        if phrase not in known:
            known.add(phrase)
            added.append(phrase)
            phrase = ""
    return len(text) - len(phrase), added


def _powers(factor: int, n: int) -> np.ndarray:
    """``factor ** 0`` to ``factor ** (n - 1)`` modulo 2 ** 64."""
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, factor, np.uint64)]))[:n]


def _hashes(phrases: list[str]) -> np.ndarray:
    """32-bit hashes: the mixed value of each phrase as a polynomial over its code points.

    Sums over all phrases in a row give each one's value as a difference, moved back to exponent 0.
    """
    lengths = np.fromiter(map(len, phrases), np.int64, len(phrases))
    codes = np.frombuffer("".join(phrases).encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers(FACTOR, len(codes)))])
    ends = np.cumsum(lengths)
    values = (sums[ends] - sums[ends - lengths]) * _powers(pow(FACTOR, -1, 1 << 64), len(codes) + 1)[ends - lengths]
    for shift in (33, 29):
        values = (values ^ (values >> np.uint64(shift))) * np.uint64(MIX)
    return (values >> np.uint64(32)).astype(np.uint32)


def smallest_hashes(phrases, size: int = SIZE) -> np.ndarray:
    """The smallest distinct 32-bit hashes, ascending."""
    phrases, least = list(phrases), np.zeros(0, np.uint32)
    for at in range(0, len(phrases), BLOCK):
        least = np.union1d(least, _hashes(phrases[at:at + BLOCK]))[:size]
    return least


def signature(text: str, size: int = SIZE) -> np.ndarray:
    return smallest_hashes(parse(text, 0, set())[1], size)


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated Jaccard similarity of the phrase sets; two empty texts are alike (1.0)."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)[:size]
    return float(np.isin(both, a, assume_unique=True)[np.isin(both, b, assume_unique=True)].sum() / len(both))


def to_text(sig: np.ndarray) -> str:
    """Eight hexadecimal digits for each hash; the empty text has the empty string."""
    return sig.astype(">u4").tobytes().hex()


class Parsed:
    """A text with its signature and the state of the parse where its last quarter begins."""

    def __init__(self, text: str, size: int = SIZE):
        self.text, self.size = text, size
        self.kept = text[:len(text) - len(text) // 4]
        self.phrases: set = set()
        self.open_at, added = parse(self.kept, 0, self.phrases)
        self.hashes = smallest_hashes(added, size)
        self.signature = self._with(text)

    def _with(self, text: str) -> np.ndarray:
        _, added = parse(text, self.open_at, self.phrases)
        self.phrases.difference_update(added)
        return np.union1d(self.hashes, smallest_hashes(added, self.size))[:self.size]

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text with its last quarter replaced by the start of ``following``, and its signature.

        Both texts begin alike, so only the end is parsed anew.
        """
        text = self.kept + following[:len(self.text) // 4]
        return text, self._with(text)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """``key, fingerprint`` of every row: NULL and empty texts have the empty fingerprint.

    Equal texts have equal fingerprints; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for keys, texts in batches:
            yield keys, [to_text(signature(t or "", size)) for t in texts]

    return map_batches(docs.select(key, text), run, f"`{key}` {kind}, fingerprint string")


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE,
                      ranges: int | None = None) -> DataFrame:
    """Each text beside its edited form and beside the next text in ascending ``key``.

    ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.
    The last row's next is the first.  NULL texts are empty; NULL keys come first;
    rows with one key follow each other by text; a single row is its own next.
    Other columns are ignored.

    The keys are cut into ranges at quantiles.  Texts travel once, to their range,
    and the first row of each range also to the range before it.
    """
    spark = docs.sparkSession
    n = ranges or max(2 * spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions(),
                      int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = docs.schema[key].dataType.simpleString()
    # one border and one first key per range: bounded by the number of partitions
    borders = sorted(set(rows.agg(F.percentile_approx("k", [i / n for i in range(1, n)], 100 * n).alias("b")).first()["b"] or []))

    def range_of(k) -> int:
        return 0 if k is None or k != k else bisect.bisect_left(borders, k)

    @F.pandas_udf("int")
    def ranged(keys: pd.Series) -> pd.Series:
        return keys.map(range_of)

    firsts = (rows.groupBy(ranged(F.col("k")).alias("r")).agg(F.min(F.struct(F.col("k").isNotNull().alias("a"), "k")).alias("f"))
              .select("r", "f.k").orderBy("r").collect())
    before = {r["k"]: firsts[i - 1]["r"] for i, r in enumerate(firsts)}

    def ranges_of(k) -> list[int]:
        k = None if k != k else k
        return [range_of(k), before[k]] if k in before else [range_of(k)]

    @F.pandas_udf("array<int>")
    def placed(keys: pd.Series) -> pd.Series:
        return keys.map(ranges_of)

    spread = (rows.select("k", "t", F.posexplode(placed(F.col("k"))).alias("tail", "r")).repartitionById(n, "r")
              .sortWithinPartitions("r", "tail", F.col("k").asc_nulls_first(), "t"))

    def run(batches):
        where, held, held_key, closed = None, None, None, False
        for keys, texts, of_range, tails in batches:
            out = [[] for _ in range(7)]
            for k, t, r, tail in zip(keys, texts, of_range, tails):
                if r != where:
                    where, held, closed = r, None, False
                if closed:  # further rows with the key of the next range's first row
                    continue
                following = held if held is not None and held.text == t else Parsed(t, size)
                if held is not None:
                    edited, changed = held.edited(t)
                    row = (held_key, len(held.text), hashlib.sha256(edited.encode("utf-8")).hexdigest(),
                           to_text(held.signature), to_text(changed), likeness(held.signature, changed, size),
                           likeness(held.signature, following.signature, size))
                    for column, value in zip(out, row):
                        column.append(value)
                held, held_key, closed = following, k, bool(tail)
            yield out

    return map_batches(spread.select("k", "t", "r", "tail"), run, _schema(key, kind))


def _schema(key: str, kind: str) -> str:
    return (f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")
