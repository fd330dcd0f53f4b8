"""Language identification in two steps.

First a linear support vector machine per family tells which family of languages
a text belongs to; then one-versus-one machines separate the languages within
that family by majority of votes.  All machines are linear in hashed character
n-grams averaged over the words of a text, so scoring looks words up.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.shared import key_remainder
from strandframe.llm.subwords import WordScores, WordTable, segment_sums, words_of

# Families of language codes; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "uralic": ["fi", "et", "hu"],
    "indo-aryan": ["hi", "bn", "ur", "mr", "ne", "pa", "gu"],
    "semitic": ["ar", "he", "mt", "am"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "cy", "gd", "br"],
}
UNDETERMINED = "und"
SIZES = (2, 3, 4)
BUCKETS = 1 << 16
# The machines are fitted on a bounded sample: about so many texts of each
# language, chosen by a hash of the key, none above this many characters.
SAMPLE_TEXTS, SAMPLE_CHARS = 600, 20_000
STEPS, PENALTY = 60, 1e-3
LETTER = regex.compile(r"\p{L}")


def family_of(language: str) -> str:
    return next((f for f, codes in FAMILIES.items() if language in codes), language)


def training_sample(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", modulus: int = 4,
                    fold: int = 2) -> tuple[list[str], list[str]]:
    """Texts with a language outside the held-out fold (crc32 of the key modulo ``modulus`` = ``fold``)."""
    rest = key_remainder(key, modulus)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(label).cast("string").alias("_l"), rest.alias("_r")).where(
        f"_l IS NOT NULL AND _t IS NOT NULL AND _r >= 0 AND _r <> {fold} AND length(_t) <= {SAMPLE_CHARS}")
    sizes = {r["_l"]: r["n"] for r in rows.groupBy("_l").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per language
    if not sizes:
        return [], []
    place = F.pmod(F.xxhash64(F.lit("language"), "_k", "_t"), F.lit(1_000_000))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1_000_000, SAMPLE_TEXTS * 1_000_000 // n + 1)))])
    chosen = rows.where(place < F.element_at(share, F.col("_l"))).orderBy(place, "_k").limit(2 * SAMPLE_TEXTS * len(sizes)).collect()
    return [r["_t"] for r in chosen], [r["_l"] for r in chosen]


def machine(flat: np.ndarray, starts: np.ndarray, weights: np.ndarray, owner: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a linear machine with squared hinge loss; the last one is the bias.

    ``flat`` lists buckets, ``weights`` their parts in a text, ``owner`` the text of each entry; ``y`` is +1 or -1.
    """
    w, b = np.zeros(BUCKETS), 0.0
    ahead_w, ahead_b, last = w.copy(), b, 1.0
    cost = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
    squares = np.bincount(owner, weights ** 2, len(y)) + 1
    rate = 1 / (2 * (cost * squares).sum() + PENALTY)
    for _ in range(STEPS):
        margin = 1 - y * (segment_sums(ahead_w[flat] * weights, starts) + ahead_b)
        pull = 2 * cost * y * np.maximum(margin, 0)
        new_w = ahead_w + rate * (np.bincount(flat, pull[owner] * weights, BUCKETS) - PENALTY * ahead_w)
        new_b = ahead_b + rate * pull.sum()
        following = (1 + np.sqrt(1 + 4 * last * last)) / 2
        step = (last - 1) / following
        ahead_w, ahead_b, last = new_w + step * (new_w - w), new_b + step * (new_b - b), following
        w, b = new_w, new_b
    return np.append(w, b)


def train(texts: list[str], labels: list[str]) -> dict | None:
    """``machines``: bucket values of all machines side by side, with what each separates. None without texts."""
    table = WordTable(texts, SIZES, BUCKETS - 1)
    used = [i for i, row in enumerate(table.texts) if len(row)]
    if not used:
        return None
    languages = sorted({labels[i] for i in used})
    families = sorted({family_of(x) for x in languages})
    entries, parts, owner = [], [], []
    for n, i in enumerate(used):
        words, times = np.unique(table.texts[i], return_counts=True)
        counts = table.counts[words]
        at = np.repeat(table.starts[words] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        found, where = np.unique(table.flat[at], return_inverse=True)
        entries.append(found)
        parts.append(np.bincount(where, np.repeat(times / counts, counts)) / times.sum())
        owner.append(np.full(len(found), n))
    # evened out: a text's vector has about unit length
    scale = 1 / np.mean([np.sqrt((p ** 2).sum()) for p in parts])
    own = np.array([labels[i] for i in used])
    own_family = np.array([family_of(x) for x in own])

    def fit(rows: np.ndarray, y: np.ndarray) -> np.ndarray:
        lengths = np.array([len(entries[r]) for r in rows])
        return machine(np.concatenate([entries[r] for r in rows]), np.concatenate([[0], np.cumsum(lengths)[:-1]]),
                       np.concatenate([parts[r] for r in rows]) * scale, np.repeat(np.arange(len(rows)), lengths), y)

    columns, family_columns, pairs = [], {}, []
    for f in families:
        if len(families) > 1:
            family_columns[f] = len(columns)
            columns.append(fit(np.arange(len(used)), np.where(own_family == f, 1.0, -1.0)))
    for f in families:
        for a, b in itertools.combinations([x for x in languages if family_of(x) == f], 2):
            rows = np.flatnonzero((own == a) | (own == b))
            pairs.append((f, a, b, len(columns)))
            columns.append(fit(rows, np.where(own[rows] == a, 1.0, -1.0)))
    table_of = np.stack(columns, axis=1) if columns else np.zeros((BUCKETS + 1, 1))
    return {"values": (table_of[:-1] * scale).astype(np.float32), "bias": table_of[-1].tolist(), "families": families,
            "family_columns": family_columns, "pairs": pairs,
            "languages": {f: [x for x in languages if family_of(x) == f] for f in families}}


def predict(text: str | None, scores: WordScores, model: dict) -> tuple[str, float]:
    """Language and confidence; undetermined with confidence 0 for a text without a letter."""
    if text is None or not LETTER.search(text):
        return UNDETERMINED, 0.0
    known = scores.of(words_of(text))
    margins = np.array(model["bias"]) + (known.mean(axis=0) if len(known) else 0.0)
    certain = 1.0
    family = model["families"][0]
    if model["family_columns"]:
        family = max(model["family_columns"], key=lambda f: margins[model["family_columns"][f]])
        certain = _probability(margins[model["family_columns"][family]])
    votes = {x: [0, 0.0] for x in model["languages"][family]}
    for f, a, b, column in model["pairs"]:
        if f == family:
            winner = a if margins[column] >= 0 else b
            votes[winner][0] += 1
            votes[a][1] += margins[column]
            votes[b][1] -= margins[column]
    best = max(votes, key=lambda x: (*votes[x], x))
    rivals = len(votes) - 1
    return best, float(certain * (_probability(votes[best][1] / rivals) if rivals else 1.0))


def _probability(margin: float) -> float:
    return 1 / (1 + np.exp(-np.clip(2 * margin, -30, 30)))


def language_column(docs: DataFrame, model: dict | None, text: str = "text") -> Column:
    """Struct ``lang_pred, score`` of a text column; undetermined for every text if there is no model."""
    if model is None:
        return F.struct(F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one row per bucket, one column per machine

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        held = shared.value
        scores = WordScores(held["values"], SIZES, BUCKETS - 1, held)
        for texts in batches:
            yield pd.DataFrame([predict(t, scores, held) for t in texts], columns=["lang_pred", "score"])

    return language(F.col(text))


def languages(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang", modulus: int = 4,
              fold: int = 2) -> DataFrame:
    """``key, held_out, lang_pred, score`` of every row.

    Rows whose crc32(key as text) leaves ``fold`` modulo ``modulus`` are held out of
    training; rows with a NULL key or language are not learnt from.  NULL texts and
    texts without a letter are ``und`` with score 0.  Repeated rows are predicted one
    by one; other columns are ignored.  Without a text to learn from all rows are ``und``.
    """
    model = train(*training_sample(docs, key, text, label, modulus, fold))
    found = docs.select(key, (key_remainder(key, modulus) == fold).alias("held_out"), language_column(docs, model, text).alias("_l"))
    return found.select(key, "held_out", "_l.lang_pred", "_l.score")
