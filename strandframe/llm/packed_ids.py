"""Token ids in fixed-width bit packing.

A data set is a folder of Parquet shards in ascending order of the key.  A row is
one block of whole documents::

    shard   number of the shard; shards follow each other in key order
    block   number of the block in its shard
    first   ids of the shard before this block
    n_ids   ids in this block
    bits    width of an id: the fewest bits that hold the largest id
    keys    keys of the block's documents, in order
    starts  where each document begins, counted in ids from the block's start
    payload the ids, ``bits`` each, most significant bit first, padded to a byte

Because all ids have one width, the id at place ``i`` lies at bit ``i * bits``: any
document or range is read without unpacking what is before it.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandframe.llm.library_ids import byte_encoder, share_tokenizer
from strandframe.llm.shared import map_batches

BLOCK_IDS = 65_536  # a block is closed at the end of the document that reaches this many


def bits_for(largest: int) -> int:
    return max(1, int(largest).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """``bits`` per id, most significant first; whole-byte widths are plain big-endian integers."""
    ids = np.asarray(ids, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits than the file has")
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    flat = np.unpackbits(ids.astype(">u4").view(np.uint8)).reshape(-1, 32)[:, 32 - bits:]
    return np.packbits(flat).tobytes()


def unpack_ids(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """The ids at places ``start`` to ``start + n``; only their bytes are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f">u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    begin = start * bits // 8
    stop = -(-(start + n) * bits // 8)
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, stop - begin, begin))[start * bits - 8 * begin:][:n * bits]
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits:] = flat.reshape(n, bits)
    return np.packbits(wide).view(">u4").astype(np.uint32)


def write_packed(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, key: str = "doc_id", text: str = "text",
                 block_ids: int = BLOCK_IDS, bits: int | None = None, ranges: int | None = None) -> None:
    """Encode each text, close it with ``end_id`` and write the ids to ``path``.

    NULL and empty texts have the end id alone.  NULL keys come first; rows with
    one key are ordered by text; repeated rows are all written; other columns are
    ignored; an empty table gives a data set without blocks.  The width is that of
    the tokenizer's largest id unless ``bits`` is given.
    """
    spark = docs.sparkSession
    shared = share_tokenizer(spark, tokenizer)
    n = ranges or max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange(n, F.col("k").asc_nulls_first()).sortWithinPartitions(F.col("k").asc_nulls_first(), "t")

    def run(batches):
        encode, shard = byte_encoder(shared.value), TaskContext.get().partitionId()
        largest = max([*shared.value["tokenizer"].get_vocab().values(), end_id])
        width, end = bits or bits_for(largest), end_id.to_bytes(4, "little")
        first = block = held = 0
        keys, starts, parts = [], [], []

        def close():
            payload = pack_ids(np.frombuffer(b"".join(parts), "<u4"), width)
            return [[shard], [block], [first], [held], [width], [keys], [starts], [payload]]

        for of_batch, texts in batches:
            for k, t in zip(of_batch, texts):
                ids = encode(t) + end
                keys.append(k)
                starts.append(held)
                parts.append(ids)
                held += len(ids) // 4
                if held >= block_ids:
                    yield close()
                    first, block, held = first + held, block + 1, 0
                    keys, starts, parts = [], [], []
        if keys:
            yield close()

    schema = f"shard int, block int, first long, n_ids long, bits int, keys array<{kind}>, starts array<long>, payload binary"
    map_batches(ordered, run, schema).write.parquet(path)


def read_packed(spark: SparkSession, path: str, as_ids: bool = True, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens`` and ``ids`` (or their ``ids_crc32``) of each document in ``path``.

    ``start`` counts the ids of all documents before it in the data set.
    """
    import zlib

    blocks = spark.read.parquet(path)
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("_n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    base = totals.select("shard", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))

    def run(batches):
        for shards, firsts, sizes, widths, keys, starts, payloads in batches:
            out = [[] for _ in range(5)]
            for shard, first, size, width, ks, ss, payload in zip(shards, firsts, sizes, widths, keys, starts, payloads):
                ids = unpack_ids(payload, width, 0, size).astype("<u4")
                for k, s, e in zip(ks, ss, [*ss[1:], size]):
                    own = ids[s:e]
                    for column, value in zip(out, (shard, k, first + s, e - s, own.tolist() if as_ids else zlib.crc32(own.tobytes()))):
                        column.append(value)
            yield out

    last = "ids array<long>" if as_ids else "ids_crc32 long"
    read = map_batches(blocks.select("shard", "first", "n_ids", "bits", "keys", "starts", "payload"), run,
                       f"shard int, `{key}` {kind}, _local long, n_tokens long, {last}")
    return read.join(base, "shard").select(key, (F.col("_base") + F.col("_local")).alias("start"), "n_tokens", last.split()[0])


def read_document(spark: SparkSession, path: str, value, key_type: str = "bigint") -> list[np.ndarray]:
    """Ids of the documents with one key, unpacked without touching the rest of their blocks.

    The scan is filtered to the blocks that hold the key; no block gives an empty list.
    """
    blocks = spark.read.parquet(path).where(F.array_contains("keys", F.lit(value).cast(key_type)))
    found = []
    for row in blocks.orderBy("shard", "block").toLocalIterator():
        ends = [*row["starts"][1:], row["n_ids"]]
        for k, s, e in zip(row["keys"], row["starts"], ends):
            if k == value:
                found.append(unpack_ids(bytes(row["payload"]), row["bits"], s, e - s))
    return found
