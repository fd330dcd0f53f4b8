"""Token counts and ids of a word-level BPE tokenizer with a whole-token shortcut.

The tables are read from a tokenizer file once, on the driver.  There every
vocabulary string that ends a word is put through the merges: those that come
out as a single token are proven, and a pre-token equal to one needs no merging.
Only the remaining pre-tokens are merged on the executors.

Text is split at white space first.  No pre-token reaches over white space, so
the tokens of a text are those of its words, and a word met before is looked up.
"""

import functools
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the tokenizer's regular expressions.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Fixed value: the contractions that the tokenizer files split off.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

MEMO_WORDS = 700_000  # words remembered by a worker; beyond that it starts afresh
MEMO_LENGTH = 64  # longer words are not remembered


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes for themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(printable))
    letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


def merged(ids: list[int], pairs: dict[int, tuple[int, int]], width: int) -> list[int]:
    """Apply the merges: the lowest rank first, the leftmost among equals.

    ``pairs`` maps ``left * width + right`` to ``(rank, id)``.
    """
    if len(ids) > 40:
        return _merged_long(ids, pairs, width)
    while len(ids) > 1:
        best = None
        for i in range(len(ids) - 1):
            found = pairs.get(ids[i] * width + ids[i + 1])
            if found and (best is None or found[0] < best[0]):
                best, at = found, i
        if best is None:
            break
        ids[at:at + 2] = [best[1]]
    return ids


def _merged_long(ids: list[int], pairs: dict, width: int) -> list[int]:
    """The same with a heap and linked neighbours: n log n steps for text without a break."""
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ids = list(ids)
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            key = ids[i] * width + ids[after[i]]
            if key in pairs:
                heapq.heappush(heap, (pairs[key][0], i, key))

    for i in range(n):
        offer(i)
    while heap:
        _, i, key = heapq.heappop(heap)
        j = after[i]
        if ids[i] < 0 or j >= n or ids[i] * width + ids[j] != key:
            continue
        ids[i], ids[j] = pairs[key][1], -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [x for x in ids if x >= 0]


@functools.lru_cache(maxsize=4)
def word_tables(path: str) -> dict:
    """Plain tables of a word BPE file; their size is that of its vocabulary."""
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    vocab, end = content["model"]["vocab"], content["model"]["end_of_word_suffix"]
    letters = byte_letters()
    width = 1 << max(vocab.values()).bit_length()
    pairs = {}
    for rank, (a, b) in enumerate(content["model"]["merges"]):
        pairs.setdefault(vocab[a] * width + vocab[b], (rank, vocab[a + b]))
    tables = {
        "inner": [vocab[c] for c in letters], "last": [vocab[c + end] for c in letters], "pairs": pairs, "width": width,
        "special": {x["content"]: x["id"] for x in content["added_tokens"]},
    }
    back = {c: b for b, c in enumerate(letters)}
    whole = {}
    for token, number in vocab.items():
        if token.endswith(end) and token != end:
            raw = bytes(back[c] for c in token.removesuffix(end))
            try:
                text = raw.decode()
            except UnicodeDecodeError:
                continue
            if merged(_start(raw, tables), pairs, width) == [number]:
                whole[text] = number
    return tables | {"whole": whole}


def _start(raw: bytes, tables: dict) -> list[int]:
    inner = tables["inner"]
    return [*(inner[b] for b in raw[:-1]), tables["last"][raw[-1]]]


def word_patterns(tables: dict):
    """Words, special strings and pre-tokens as compiled patterns."""
    special = regex.compile("(" + "|".join(regex.escape(s) for s in tables["special"]) + ")") if tables["special"] else None
    pieces = regex.compile(rf"{CONTRACTIONS}|\p{{L}}+|\p{{N}}|[^{WHITE}\p{{L}}\p{{N}}]+")
    return re.compile(f"[^{WHITE}]+"), special, pieces


def word_ids(word: str, tables: dict, patterns) -> list[int]:
    """Token ids of a word without white space."""
    _, special, pieces = patterns
    parts = special.split(word) if special and "<" in word else [word]
    whole, out = tables["whole"], []
    for k, part in enumerate(parts):
        if k % 2:
            out.append(tables["special"][part])
            continue
        plain = part.lower() if part.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", part))
        for piece in pieces.findall(plain):
            number = whole.get(piece)
            if number is not None:
                out.append(number)
            else:
                out.extend(merged(_start(piece.encode(), tables), tables["pairs"], tables["width"]))
    return out


class Memo(dict):
    """Values of words met before; a bounded number is kept."""

    make = None

    def __missing__(self, word):
        value = self.make(word)
        if len(word) <= MEMO_LENGTH:
            if len(self) >= MEMO_WORDS:
                self.clear()
            self[word] = value
        return value


def sendable(tables: dict) -> dict:
    """The tables without the memos of their process: what a broadcast may hold."""
    return {k: v for k, v in tables.items() if not k.startswith("memo")}


def remembered(tables: dict, name: str, make):
    """``make`` of a word, through a memo that stays in the worker's ``tables`` from task to task."""
    memo = tables.get(name)
    if memo is None:
        memo = tables[name] = Memo()
    memo.make = make
    return memo.__getitem__


def id_encoder(tables: dict):
    """A function from text to its ids as little-endian 32-bit integers."""
    patterns = word_patterns(tables)
    words = patterns[0].findall
    of_word = remembered(tables, "memo_ids", lambda w: array("I", word_ids(w, tables, patterns)).tobytes())
    return lambda text: b"".join(map(of_word, words(text)))


def count_column(spark: SparkSession, text: Column, path: str) -> Column:
    """Number of tokens of ``text``; 0 for NULL and for empty text."""
    shared = spark.sparkContext.broadcast(sendable(word_tables(path)))

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = shared.value
        patterns = word_patterns(tables)
        words = patterns[0].findall
        of_word = remembered(tables, "memo_counts", lambda w: len(word_ids(w, tables, patterns)))
        for texts in batches:
            yield texts.map(lambda t: sum(map(of_word, words(t))) if t else 0)

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` per row of ``docs``.

    NULL and empty texts have 0 bytes and 0 tokens.  Each row stands for itself:
    repeated rows and NULL keys are returned as they come; other columns are ignored.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    counted = docs.select(F.col(key).alias(key), F.octet_length(body).cast("long").alias("n_bytes"),
                          count_column(docs.sparkSession, body, path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
