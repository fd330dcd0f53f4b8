"""Token ids by the tokenizers library, word by word through a bounded memo.

Pre-tokens never reach over the end of a run of non-space characters, so each
such run (with the white space before it, where the tokenizer keeps that) is
encoded once by the library's model and looked up when it comes again.
"""

from __future__ import annotations

import functools
from array import array

from pyspark import Broadcast
from pyspark.sql import SparkSession
from tokenizers import Tokenizer

from strandframe.llm.bpe import byte_patterns, text_encoder
from strandframe.llm.token_counts import byte_letters, remembered, word_patterns


@functools.lru_cache(maxsize=4)
def _content(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def share_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file's text for the executors; its size is that of the vocabulary."""
    return spark.sparkContext.broadcast({"json": _content(path)})


def _open(shared: dict) -> Tokenizer:
    """The worker's tokenizer, made at first use."""
    if "tokenizer" not in shared:
        tokenizer = Tokenizer.from_str(shared["json"])
        shared["tokenizer"] = tokenizer
        shared["special"] = {t.content: n for n, t in tokenizer.get_added_tokens_decoder().items()}
    return shared["tokenizer"]


def word_encoder(shared: dict):
    """Text to little-endian 32-bit ids for a tokenizer that drops white space."""
    tokenizer = _open(shared)
    words, special, pieces = word_patterns(shared)
    model = tokenizer.model
    letters = dict(enumerate(byte_letters()))

    def make(word: str) -> bytes:
        if special and special.search(word):
            return array("I", tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if word.isascii() and word.isprintable():  # printable ASCII stands for itself
            return array("I", [t.id for p in pieces.findall(word.lower()) for t in model.tokenize(p)]).tobytes()
        plain = tokenizer.normalizer.normalize_str(word)
        return array("I", [t.id for p in pieces.findall(plain) for t in model.tokenize(p.encode().decode("latin-1").translate(letters))]).tobytes()

    of_word = remembered(shared, "memo", make)
    return lambda text: b"".join(map(of_word, words.findall(text)))


def byte_encoder(shared: dict):
    """Text to little-endian 32-bit ids for a byte-level tokenizer."""
    tokenizer = _open(shared)
    model, letters = tokenizer.model, dict(enumerate(byte_letters()))
    pieces = byte_patterns(shared)[2]

    def ids(chunk: str) -> list[int]:
        return [t.id for p in pieces.findall(chunk) for t in model.tokenize(p.encode().decode("latin-1").translate(letters))]

    return text_encoder(shared, ids)
