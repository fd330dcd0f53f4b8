"""Runs of neighbouring k-mers that hold the same least m-mer, found in numpy inside the tasks.

A k-mer's least m-mer depends on its bases alone, so equal k-mers have the same one wherever they
lie.  A run travels as one string of a little more than its bases, where its k-mers one by one take ``k`` times as much.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

LONGEST = 256  # k-mers of one run
ROWS = 20_000  # rows of an output batch, about
WORDS = 1 << 20  # words of 64 marks of bins


def core_length(k: int) -> int:
    return min(k, 8 + k // 6)


def hashes(codes: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit hash of every ``m`` neighbouring codes, put together by doubling."""
    factor, out, done, part, size = 0x9E3779B97F4A7C15, None, 0, codes.astype(np.uint64) + np.uint64(1), 1
    while True:
        power = np.uint64(pow(factor, size, 1 << 64))
        if m & size:
            count = len(codes) - done - size + 1
            out = part if out is None else out[:count] * power + part[done:done + count]
            done += size
        if done == m:
            break
        part = part[:len(part) - size] * power + part[size:]
        size *= 2
    out = out[:len(codes) - m + 1]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def runs(text: str, k: int) -> tuple[list[int], list[int], np.ndarray]:
    """Starts and ends (of k-mer places) of the runs, with the least hash of each as ``int64``."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    m = core_length(k)
    least = least_of(hashes(codes, m), k - m + 1)
    starts = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    sizes = np.diff(np.append(starts, len(least)))
    if sizes.max() > LONGEST:
        starts = np.concatenate([np.arange(s, s + n, LONGEST) for s, n in zip(starts, sizes)])
    ends = np.append(starts[1:], len(least))
    return starts.tolist(), ends.tolist(), least[starts].view(np.int64)


def bin_marks(pieces: DataFrame) -> np.ndarray:
    """One bit for the bins of ``pieces``; two bins may share theirs, whose number has a bound whatever the input."""
    bit = F.shiftrightunsigned("bin", 32).bitwiseAND(F.lit(63)).cast("int")
    words = pieces.groupBy(F.col("bin").bitwiseAND(F.lit(WORDS - 1)).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).toArrow()
    marks = np.zeros(WORDS, np.uint64)
    marks[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(np.uint64)
    return marks


def marked(bins: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Which of ``bins`` have their bit set."""
    own = bins.view(np.uint64)
    return (marks[bins & (WORDS - 1)] >> ((own >> np.uint64(32)) & np.uint64(63)) & np.uint64(1)).astype(bool)


def kmer_runs(reads: DataFrame, k: int, ids: list[str], seq_col: str = "seq", before: str | None = None, marks: np.ndarray | None = None) -> DataFrame:
    """``id.., bin, at, piece``: every k-mer of every sequence once, in runs of one least m-mer.

    ``at`` is the place of the first k-mer of ``piece``.  Equal k-mers have the same ``bin``.  With
    ``before`` a piece begins with the base before its first k-mer, or with ``before`` at the start of the sequence.
    With ``marks`` only runs whose bin is marked are made.
    """
    long_enough = reads.where(F.length(seq_col) >= k).select(*ids, seq_col)
    schema = StructType(list(long_enough.schema.fields[:-1])).add("bin", LongType()).add("at", IntegerType()).add("piece", StringType())
    target = to_arrow_schema(schema)
    extra = 0 if before is None else 1

    def run(batches):
        for batch in batches:
            texts = batch.columns[-1].to_pylist()
            rows, bins, at, pieces = [], [], [], []

            def made():
                own = [c.take(pa.array(np.concatenate(rows))) for c in batch.columns[:-1]]
                columns = [*own, pa.array(np.concatenate(bins)), pa.array(at, pa.int32()), pa.array(pieces, pa.string())]
                return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, target.types)], schema=target)

            for i, text in enumerate(texts):
                starts, ends, least = runs(text, k)
                if marks is not None:
                    on = np.flatnonzero(marked(least, marks))
                    starts, ends, least = [starts[j] for j in on], [ends[j] for j in on], least[on]
                rows.append(np.full(len(starts), i))
                bins.append(least)
                at += starts
                whole = text if before is None else before + text
                pieces += [whole[a:z + k - 1 + extra] for a, z in zip(starts, ends)]
                if len(at) >= ROWS:
                    yield made()
                    rows, bins, at, pieces = [], [], [], []
            if at:
                yield made()

    return long_enough.mapInArrow(run, schema)


class _Counts:
    """Hashes of one bin after another with their numbers; what is held grows with the distinct hashes of a bin."""

    def __init__(self):
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.size += len(hashes)
        if self.size > max(len(self.hashes), 1 << 20):
            self.settle()

    def settle(self) -> None:
        if self.size:
            every = np.concatenate([self.hashes, *self.waiting])
            n = np.concatenate([self.counts, np.ones(self.size, np.int64)])
            self.hashes, place = np.unique(every, return_inverse=True)
            self.counts = np.bincount(place, n, len(self.hashes)).astype(np.int64)
            self.waiting, self.size = [], 0

    def of(self, hashes: np.ndarray) -> np.ndarray:
        self.settle()
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], 0)


def _places(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and place in its row of every k-mer of ``texts``."""
    lengths = np.array([len(t) for t in texts], np.int64)
    count = np.maximum(lengths - k + 1, 0)
    rows = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    if not len(rows):
        return np.zeros(0, np.uint64), rows, place
    every = hashes(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), k)
    return every[(np.cumsum(lengths) - lengths)[rows] + place], rows, place


def _met(dealt: DataFrame, k: int, answer, schema: StructType) -> DataFrame:
    """``answer(batch, texts, rows, place, numbers)`` for the askers of each batch, ``numbers`` being how often each of their k-mers was told in its bin.

    ``dealt``: ``.., bin, tells, piece``; the rows of a bin lie in one task, the telling ones first.  Equal k-mers have equal bins, so the
    hashes of a batch are met together and only those of its last bin are kept for the next one.
    """

    def run(batches):
        told, last = _Counts(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = np.asarray(batch.column("bin"))
            tells = batch.column("tells").to_numpy(zero_copy_only=False).astype(bool)
            if bins[0] != last:
                told = _Counts()
            texts = batch.column("piece").to_pylist()
            found, rows, place = _places(texts, k)
            telling = tells[rows]
            told.add(found[telling])
            if not tells.all():
                asking = ~telling
                yield answer(batch, texts, rows[asking], place[asking], told.of(found[asking]))
            if bins[-1] != bins[0]:  # a bin that ends here is met no more
                told = _Counts()
                told.add(found[telling & (bins[rows] == bins[-1])])
            last = bins[-1]

    return dealt.mapInArrow(run, schema)


def _dealt(telling: DataFrame, asking: DataFrame, partitions: int) -> DataFrame:
    rows = telling.withColumn("tells", F.lit(True)).unionByName(asking.withColumn("tells", F.lit(False)), allowMissingColumns=True)
    return rows.repartition(partitions, "bin").sortWithinPartitions("bin", F.desc("tells"))


def told_numbers(telling: DataFrame, asking: DataFrame, k: int, partitions: int) -> DataFrame:
    """``id.., at, ns`` of every run of ``asking``: how often each of its k-mers occurs in the runs ``telling``, both from ``kmer_runs``."""
    ids = [f for f in asking.schema.fields if f.name not in ("bin", "piece")]
    schema = StructType([*ids]).add("ns", ArrayType(IntegerType()))
    target = to_arrow_schema(schema)

    def answer(batch, texts, rows, place, numbers):
        starts = np.flatnonzero(place == 0)  # a run holds one k-mer at least
        own = batch.take(pa.array(rows[starts]))
        ns = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)), pa.int32()), pa.array(numbers, pa.int32()))
        columns = [own.column(f.name).cast(t) for f, t in zip(ids, target.types)] + [ns.cast(target.types[-1])]
        return pa.RecordBatch.from_arrays(columns, schema=target)

    return _met(_dealt(telling, asking, partitions), k, answer, schema)


def told_kmers(telling: DataFrame, asking: DataFrame, k: int, partitions: int) -> DataFrame:
    """``id.., pos, kmer`` of every k-mer of the runs ``asking`` that occurs in the runs ``telling``, both from ``kmer_runs``."""
    ids = [f for f in asking.schema.fields if f.name not in ("bin", "at", "piece")]
    schema = StructType([*ids]).add("pos", IntegerType()).add("kmer", StringType())
    target = to_arrow_schema(schema)

    def answer(batch, texts, rows, place, numbers):
        hit = numbers > 0
        rows, place = rows[hit], place[hit]
        own = batch.take(pa.array(rows))
        kmers = [texts[r][p:p + k] for r, p in zip(rows.tolist(), place.tolist())]
        columns = [own.column(f.name).cast(t) for f, t in zip(ids, target.types)]
        columns += [pa.array(np.asarray(own.column("at")) + place, pa.int32()), pa.array(kmers, pa.string())]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, target.types)], schema=target)

    return _met(_dealt(telling, asking, partitions), k, answer, schema)
