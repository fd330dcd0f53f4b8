"""Benchmark decontamination with a broadcast hash set of n-grams, in DataFrame functions only.

The windows of the benchmark items (ten consecutive words, or the whole item if it
is shorter) are hashed into a broadcast table of checked size.  Every window of a
document is hashed and looked up there; a hit is verified on the words.  One pass
over the documents does it: beside its windows each row sends one marker through
the same lookup, which carries its columns, so rows without a hit need no second
scan and no join.  What is shuffled is one slim row for each document and its hits.

A benchmark above ``BROADCAST_BYTES`` is met in blocks of that size.

Defined results: a NULL text has no words, as has an empty one; rows are told apart
by place, so rows that repeat a key or a whole row are judged one by one; a NULL
key stays NULL.  Items that share an id are one item, a NULL id is an item that is
written as an empty string, and items without words have no window.  Without items
nothing is hit; without documents the result is empty.  Columns of the documents
that bear the name of a result give way to it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.shared import let, written

WINDOW = 10
BROADCAST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # between words, once A-Z are lower-case
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # a word with the gap before it
RESULTS = ["n_words", "n_hit", "n_items", "items", "hit_words"]


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else; ``lower`` does the same where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _windows(own: Column, length: int) -> Column:
    """(place from 1, length, hash) of all windows of ``length`` words of ``own``, a lambda variable."""
    at = F.when(F.size(own) >= length, F.sequence(F.lit(1), F.size(own) - (length - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(length).alias("k"), F.xxhash64(F.slice(own, i, length)).alias("h")))


def item_windows(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``h, k, gram, items``: each different window of the items once, with the ids (as text) of the items that hold it."""
    own = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where("size(w) > 0")
    k = F.least(F.lit(window), F.size("w"))
    grams = own.select("item", k.alias("k"), F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.slice("w", i, k))).alias("s"))
    return grams.groupBy(F.xxhash64("s").alias("h"), "k", F.concat_ws(" ", "s").alias("gram")).agg(F.collect_set("item").alias("items"))


def _blocks(windows: DataFrame) -> list[DataFrame]:
    """The windows in parts of at most about ``BROADCAST_BYTES``."""
    held = windows.agg(F.sum(F.octet_length("gram") + 64 + F.aggregate("items", F.lit(0), lambda a, i: a + F.octet_length(i) + 16))).first()[0] or 0
    n = -(-held // BROADCAST_BYTES) or 1
    return [windows.where(F.pmod("h", F.lit(n)) == b) for b in range(n)] if n > 1 else [windows]


def marked(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
           window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (its columns ``keep``, all by default) with

    ``n_words``; ``n_hit``: words inside any window of an item; ``n_items``: items that have such a window; ``items``:
    their ids as text, sorted; ``hit_words``: the hit stretches as (first, last) places of words, from 1.
    """
    windows = written(item_windows(items, item_key, item_text, window), "item-windows")
    lengths = sorted(r[0] for r in windows.select("k").distinct().collect())  # at most ``window`` values
    kept = docs.columns if keep is None else keep
    marker = F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("h")))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_kept") if kept else
                       F.lit(None).alias("_kept"), let(words(F.col(f"`{text}`")), lambda own: F.struct(
                           own.alias("words"), F.concat(marker, *[_windows(own, k) for k in lengths]).alias("windows"))).alias("_own"))
    placed = rows.select("_row", "_kept", F.col("_own.words").alias("_words"), F.explode("_own.windows").alias("_w"))
    found = []
    for i, block in enumerate(_blocks(windows)):
        block = block.select("h", "gram", "items")
        if i == 0:  # the marker is in the first block only
            block = block.unionByName(block.sparkSession.range(1).selectExpr("0L AS h", "CAST(NULL AS string) AS gram", "array('') AS items"))
        block = block.select(F.col("h").alias("_h"), F.col("gram").alias("_gram"), F.col("items").alias("_items"))
        met = placed.join(F.broadcast(block), F.col("_w.h") == F.col("_h"))
        same = (F.col("_w.at") == 0) & F.col("_gram").isNull() | (F.col("_w.at") > 0) & (
            F.concat_ws(" ", F.slice("_words", F.greatest(F.col("_w.at"), F.lit(1)), F.col("_w.k"))) == F.col("_gram"))
        first = F.col("_w.at") == 0
        found.append(met.where(same).select("_row", F.when(first, F.col("_kept")).alias("_kept"), F.when(first, F.size("_words")).alias("_n"),
                                            F.when(~first, F.struct(F.col("_w.at"), (F.col("_w.at") + F.col("_w.k") - 1).alias("to"))).alias("_span"),
                                            F.when(~first, F.col("_items")).alias("_items")))
    by_row = reduce(DataFrame.unionByName, found).groupBy("_row").agg(
        F.first("_kept", ignorenulls=True).alias("_kept"), F.max("_n").alias("_n"), F.collect_list("_span").alias("_spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("_items")))).alias("items"))
    joined = by_row.select("*", stretches(F.col("_spans")).alias("hit_words"))
    carried = [F.col(f"_kept.`{c}`").alias(c) for c in kept if c not in RESULTS]
    hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["at"] + 1)
    return joined.select(*carried, F.col("_n").cast("long").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                         "items", "hit_words")


def stretches(spans: Column) -> Column:
    """Spans that overlap or touch, joined, in order."""
    def step(done, s):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["at"].alias("at"), F.greatest(last["to"], s["to"]).alias("to"))))
        return F.when(F.size(done) == 0, F.array(s)).when(s["at"] <= last["to"] + 1, grown).otherwise(F.concat(done, F.array(s)))
    return F.aggregate(F.sort_array(spans), F.array().cast("array<struct<at:int,to:int>>"), step)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, a row for each document."""
    out = marked(docs, items, text, item_key, item_text, window, keep=[key])
    return out.select(key, "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))


def without_spans(docs: DataFrame, items: DataFrame, text: str = "text", **named) -> DataFrame:
    """The documents without their hit words and the gaps before them; other texts stay as they are."""
    out = marked(docs, items, text, **named)
    body = F.col(f"`{text}`")

    def left(pieces):
        stays = F.filter(pieces, lambda p, i: ~F.exists("hit_words", lambda s: (s["at"] <= i + 1) & (i + 1 <= s["to"])))
        return F.concat(F.concat_ws("", stays), F.regexp_extract(body, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*\z", 0))
    cleaned = let(F.regexp_extract_all(body, F.lit(PIECE), F.lit(0)), left)
    return out.select(*[F.when(F.col("n_hit") > 0, cleaned).otherwise(body).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns
                        if c not in RESULTS])


def without_documents(docs: DataFrame, items: DataFrame, most: float = 0.0, **named) -> DataFrame:
    """The documents of whose words at most the share ``most`` is hit."""
    out = marked(docs, items, **named).where(F.col("n_hit") <= F.lit(most) * F.col("n_words"))
    return out.select(*[f"`{c}`" for c in docs.columns if c not in RESULTS])
