"""Hashed character n-grams of words, for the linear text classifiers.

A classifier of this kind is linear in a text's words, so executors need one
number (or a few) per n-gram bucket, and a word met before is looked up.
"""

from __future__ import annotations

import zlib

import numpy as np

EDGE = ".,;:!?\"'()[]{}<>#*$%&|-_=/\\"  # stripped from both ends of a word
MEMO_WORDS = 400_000
MEMO_LENGTH = 64


def words_of(text: str | None) -> list[str]:
    return text.split() if text else []


def buckets(word: str, sizes: tuple[int, ...], mask: int) -> list[int]:
    """Buckets of the byte n-grams of a lower-case word between its border marks; [] without a letter or digit."""
    core = word.lower().strip(EDGE)
    if not core:
        return []
    marked = b"<" + core.encode("utf-8") + b">"
    crc = zlib.crc32
    return [crc(marked[i:i + n]) & mask for n in sizes for i in range(len(marked) - n + 1)] or [crc(marked) & mask]


class WordTable:
    """The distinct words of a training sample and their n-gram buckets in rows."""

    def __init__(self, texts: list[str], sizes: tuple[int, ...], mask: int):
        number: dict[str, int] = {}
        lists: list[list[int]] = []
        self.texts = []
        for t in texts:
            row = []
            for w in words_of(t):
                k = number.get(w)
                if k is None:
                    found = buckets(w, sizes, mask)
                    k = number[w] = len(lists) if found else -1
                    if found:
                        lists.append(found)
                if k >= 0:
                    row.append(k)
            self.texts.append(np.array(row, np.int64))
        self.counts = np.array([len(x) for x in lists], np.int64)
        self.flat = np.fromiter((b for x in lists for b in x), np.int32, int(self.counts.sum()))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64) if lists else np.zeros(0, np.int64)


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of consecutive non-empty segments of rows."""
    return np.add.reduceat(values, starts, axis=0) if len(starts) else values[:0]


class WordScores:
    """Mean bucket values of words; ``held`` keeps the words met so far, a bounded number, between tasks."""

    def __init__(self, values: np.ndarray, sizes: tuple[int, ...], mask: int, held: dict):
        self.values = values if values.ndim == 2 else values[:, None]
        self.sizes, self.mask, self.held = sizes, mask, held
        if "memo" not in held:
            self._reset()

    def _reset(self) -> None:
        # row 0 is for words without n-grams
        self.held.update(memo={}, rows=np.zeros((1024, self.values.shape[1]), np.float32), used=1)

    def of(self, words: list[str]) -> np.ndarray:
        """One row of means for each word that has n-grams."""
        memo = self.held["memo"]
        try:
            at = list(map(memo.__getitem__, words))
        except KeyError:
            at = self._with_new(words)
        at = np.array(at, np.int64)
        return self.held["rows"][at[at > 0]]

    def _with_new(self, words: list[str]) -> list[int]:
        if self.held["used"] > MEMO_WORDS:
            self._reset()
        memo, used = self.held["memo"], self.held["used"]
        fresh = [w for w in set(words) if w not in memo]
        lists = [buckets(w, self.sizes, self.mask) for w in fresh]
        full = [x for x in lists if x]
        if full:
            counts = np.array([len(x) for x in full])
            flat = np.fromiter((b for x in full for b in x), np.int64, int(counts.sum()))
            means = segment_sums(self.values[flat], np.concatenate([[0], np.cumsum(counts)[:-1]])) / counts[:, None]
            rows = self.held["rows"]
            if used + len(full) > len(rows):
                rows = np.concatenate([rows, np.zeros((max(len(rows), len(full)), rows.shape[1]), np.float32)])
                self.held["rows"] = rows
            rows[used:used + len(full)] = means
            self.held["used"] = used + len(full)
        row, long = used, {}
        for w, x in zip(fresh, lists):
            (memo if len(w) <= MEMO_LENGTH else long)[w] = row if x else 0
            row += bool(x)
        return [memo[w] if w in memo else long[w] for w in words] if long else list(map(memo.__getitem__, words))
