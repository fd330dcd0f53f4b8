"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a text there is one token that its encoding ends with.  The
automaton of the vocabulary lists the tokens that end at a byte, longest first;
a token is the last one of a prefix if it can stand next to the last token of
the prefix before it, that is if no merge reaches over the border between the
two.  Following the last tokens back from the end gives the exact ids in time
linear in the text, without a merge queue.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from array import array

import regex
from pyspark.sql import DataFrame

from strandframe.llm.shared import map_batches
from strandframe.llm.token_counts import CONTRACTIONS, WHITE, byte_letters, merged, remembered, sendable

PAIR_MEMO = 1_000_000  # pair tests remembered by a worker
BASE = -1  # the rank of a single byte: it is there before any merge


@functools.lru_cache(maxsize=4)
def byte_tables(path: str) -> dict:
    """Plain tables of a byte-level BPE file; their size is that of its vocabulary.

    ``rank``, ``left`` and ``right`` describe how a token is made; ``step`` is the
    automaton ``state * 256 + byte -> state``, ``back`` its failure links, ``ends``
    the longest token ending at a state and ``shorter`` the next shorter one.
    """
    with open(path, encoding="utf-8") as f:
        content = json.load(f)
    vocab = content["model"]["vocab"]
    of_letter = {c: b for b, c in enumerate(byte_letters())}
    size = max(vocab.values()) + 1
    width = 1 << size.bit_length()
    raw = {number: bytes(of_letter[c] for c in token) for token, number in vocab.items()}
    first = [0] * 256
    for number, b in raw.items():
        if len(b) == 1:
            first[b[0]] = number
    rank, left, right, pairs = [BASE] * size, [0] * size, [0] * size, {}
    for r, (a, b) in enumerate(content["model"]["merges"]):
        a, b, made = vocab[a], vocab[b], vocab[a + b]
        pairs.setdefault(a * width + b, (r, made))
        if len(raw[made]) > 1 and rank[made] == BASE:
            rank[made], left[made], right[made] = r, a, b
    # a vocabulary string that its own merges do not yield never occurs
    usable = [n for n, b in raw.items() if merged([first[x] for x in b], pairs, width) == [n]]
    step, ends, lengths = {}, [-1], {n: len(b) for n, b in raw.items()}
    for n in usable:
        state = 0
        for b in raw[n]:
            key = state * 256 + b
            if key not in step:
                step[key] = len(ends)
                ends.append(-1)
            state = step[key]
        ends[state] = n
    back, shorter = [0] * len(ends), [-1] * size
    level = [(0, 0, b, s) for key, s in step.items() for b in [key % 256] if key < 256]
    children: dict[int, list] = {}
    for key, s in step.items():
        children.setdefault(key // 256, []).append((key % 256, s))
    while level:
        following = []
        for parent, _, b, state in level:
            link = back[parent]
            while parent and link and link * 256 + b not in step:
                link = back[link]
            back[state] = step.get(link * 256 + b, 0) if parent else 0
            inherited = ends[back[state]]
            if ends[state] >= 0:
                shorter[ends[state]] = inherited
            else:
                ends[state] = inherited
            following.extend((state, 0, c, s) for c, s in children.get(state, ()))
        level = following
    added = {x["content"]: x["id"] for x in content["added_tokens"]}
    bytes_of = [raw.get(n, b"") for n in range(size)] + [b""] * (max([size - 1, *added.values()]) + 1 - size)
    for text, n in added.items():
        bytes_of[n] = text.encode()
    return {"rank": rank, "left": left, "right": right, "merge": {k: v[0] for k, v in pairs.items()}, "width": width,
            "step": step, "back": back, "ends": ends, "shorter": shorter, "length": [lengths.get(n, 0) for n in range(size)],
            "special": added, "bytes": bytes_of}


def stands_next_to(a: int, b: int, tables: dict) -> bool:
    """True if no merge ever joins the end of token ``a`` with the start of token ``b``.

    The two borders are unmade from the latest merge to the first.  While the
    right edge ``a`` and the left edge ``b`` lie side by side, their own merge
    would happen if it came before the merge that ended this state; among equal
    ranks the one further left comes first.
    """
    rank, left, right, merge, width = (tables[k] for k in ("rank", "left", "right", "merge", "width"))
    until = len(merge) + 1
    while True:
        across = merge.get(a * width + b)
        if across is not None and across < until:
            return False
        if rank[a] == BASE and rank[b] == BASE:
            return True
        if rank[a] > rank[b]:
            until, a = rank[a], right[a]
        else:
            until, b = rank[b] + 1, left[b]


def encode_bytes(raw: bytes, tables: dict) -> list[int]:
    """Ids of one pre-token."""
    step, back, ends, shorter, length = (tables[k] for k in ("step", "back", "ends", "shorter", "length"))
    known, width = tables.setdefault("memo_pairs", {}), tables["width"]
    last = [0] * (len(raw) + 1)
    state = 0
    for i, b in enumerate(raw, 1):
        following = step.get(state * 256 + b)
        while following is None:
            state = back[state]
            following = step.get(state * 256 + b)
        state = following
        token = ends[state]
        while True:
            start = i - length[token]
            if not start:
                break
            key = last[start] * width + token
            fits = known.get(key)
            if fits is None:
                if len(known) > PAIR_MEMO:
                    known.clear()
                fits = known[key] = stands_next_to(last[start], token, tables)
            if fits:
                break
            token = shorter[token]
        last[i] = token
    out, i = [], len(raw)
    while i:
        out.append(last[i])
        i -= length[last[i]]
    out.reverse()
    return out


def byte_patterns(tables: dict):
    """Special strings, chunks (white space and the run after it) and the pre-tokens of a chunk."""
    special = regex.compile("(" + "|".join(regex.escape(s) for s in tables["special"]) + ")") if tables["special"] else None
    chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
    pieces = regex.compile(rf"{CONTRACTIONS}| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
    return special, chunks, pieces


def text_encoder(tables: dict, make_ids=None):
    """A function from text to its ids as little-endian 32-bit integers.

    ``make_ids`` encodes one chunk; by default the dynamic programme does, piece by piece.
    """
    special, chunks, pieces = byte_patterns(tables)
    split = chunks.findall
    if make_ids is None:
        make_ids = lambda chunk: [n for p in pieces.findall(chunk) for n in encode_bytes(p.encode(), tables)]
    of_chunk = remembered(tables, "memo_ids", lambda chunk: array("I", make_ids(chunk)).tobytes())

    def encode(text: str) -> bytes:
        if special is None or not special.search(text):
            return b"".join(map(of_chunk, split(text)))
        out = []
        for k, part in enumerate(special.split(text)):
            out.append(array("I", [tables["special"][part]]).tobytes() if k % 2 else b"".join(map(of_chunk, split(part))))
        return b"".join(out)

    return encode


def decode_ids(ids, tables: dict) -> str:
    """The text of token ids; bytes that are no UTF-8 become replacement characters."""
    return b"".join(map(tables["bytes"].__getitem__, ids)).decode("utf-8", "replace")


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids, decoded``: token ids of each text and the text decoded from them.

    NULL and empty texts have no ids and decode to the empty text.  Each row
    stands for itself; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(sendable(byte_tables(path)))

    def run(batches):
        encode, tables = text_encoder(shared.value), shared.value
        for keys, texts in batches:
            ids = [array("I", encode(t or "")).tolist() for t in texts]
            yield keys, ids, [decode_ids(x, tables) for x in ids]

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), run, f"`{key}` {kind}, ids array<int>, decoded string")


def encoding_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of ``encode_decode``, hashed where they are made."""
    shared = docs.sparkSession.sparkContext.broadcast(sendable(byte_tables(path)))

    def run(batches):
        tables = shared.value
        encode, digits = text_encoder(tables), [str(n) for n in range(len(tables["bytes"]))]
        sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        for keys, texts in batches:
            sizes, of_ids, of_text = [], [], []
            for t in texts:
                ids = array("I", encode(t or "")).tolist()
                sizes.append(len(ids))
                of_ids.append(sha(",".join(map(digits.__getitem__, ids))))
                of_text.append(sha(decode_ids(ids, tables)))
            yield keys, sizes, of_ids, of_text

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), run,
                       f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
