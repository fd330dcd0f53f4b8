"""Toxicity by a bag of subword embeddings and a linear softmax.

A word is the mean of the embeddings of its character n-grams, a passage of a few
words the mean of its words, and a linear softmax over that mean gives the
passage's class.  Embeddings and softmax are trained jointly, in numpy, from
document labels: a document is as toxic as its worst passage, which is learnt
with a soft maximum that sharpens from pass to pass.  A misspelt insult shares
most n-grams with the words seen in training.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.shared import key_remainder
from strandframe.llm.subwords import WordScores, WordTable, segment_sums, words_of

SIZES = (4, 5)
BUCKETS = 1 << 17
DIMENSION = 4
PASSAGE = 4  # words
# The model is fitted on a bounded sample of labelled rows: so many of either
# label, in the order of a hash of the key, none above this many characters.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 800, 1600, 20_000
PASSES = 8
PRIOR = 3.0  # documents of either kind that an n-gram is taken to have been seen in beforehand
DECAY = 0.02


def training_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
                    modulus: int = 5) -> tuple[list[str], np.ndarray]:
    """Labelled texts outside the held-out fold (crc32 of the key modulo ``modulus`` = 0)."""
    known = labels.where(F.col(label).isNotNull()).groupBy(key).agg(F.max(label).alias("_label"))
    # keys are chosen first: no text is moved for a row outside the sample
    rows = (docs.select(F.col(key).alias("_key"), F.length(text).alias("_n")).where((key_remainder(key, modulus, "_key") > 0) & (F.col("_n") <= SAMPLE_CHARS))
            .join(known.withColumnRenamed(key, "_key"), "_key").withColumn("_order", F.xxhash64(F.lit("toxicity"), F.col("_key"))))
    chosen = []
    for value, most in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN)):
        chosen += [(r["_key"], value) for r in rows.where(F.col("_label") == value).select("_key", "_order").distinct().orderBy("_order", "_key").limit(most).collect()]
    if not chosen:
        return [], np.zeros(0, np.float32)
    kind = docs.schema[key].dataType.simpleString()
    sample = docs.sparkSession.createDataFrame(chosen, f"_key {kind}, _label int")  # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows
    texts = (docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") <= SAMPLE_CHARS)
             .join(F.broadcast(sample), "_key").groupBy("_key", "_label").agg(F.min("_text").alias("_text")).orderBy("_key").collect())
    return [r["_text"] for r in texts], np.array([r["_label"] for r in texts], np.float32)


def train(texts: list[str], labels: np.ndarray, passes: int = PASSES, seed: int = 3) -> dict | None:
    """``values`` per bucket, and ``scale, shift`` that turn the worst passage's value into a logit.

    None if one of the labels is missing.
    """
    table = WordTable(texts, SIZES, BUCKETS - 1)
    used = [i for i, row in enumerate(table.texts) if len(row)]
    y = labels[used]
    if not (y == 1).any() or not (y == 0).any():
        return None
    rows = [table.texts[i] for i in used]
    words = np.concatenate(rows)
    sizes = np.array([len(r) for r in rows])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    per_text = -(-sizes // PASSAGE)
    first = np.concatenate([[0], np.cumsum(per_text)[:-1]])
    passage = np.concatenate([b + PASSAGE * np.arange(k) for b, k in zip(begin, per_text)])
    length = np.diff(np.append(passage, len(words)))
    of_text = np.repeat(np.arange(len(rows)), per_text)
    of_passage = np.repeat(np.arange(len(passage)), length)
    by_word = np.argsort(words, kind="stable")
    word_starts = np.concatenate([[0], np.cumsum(np.bincount(words, minlength=len(table.counts)))[:-1]])
    by_bucket = np.argsort(table.flat, kind="stable")
    present, bucket_starts = np.unique(table.flat[by_bucket], return_index=True)
    word_of = np.repeat(np.arange(len(table.counts)), table.counts)[by_bucket]

    rng = np.random.default_rng(seed)
    # start from the log odds of the documents an n-gram is seen in, so that rare n-grams start near 0
    holding = np.zeros((2, len(table.counts)))
    for row, kind in zip(rows, y.astype(int)):
        holding[kind, np.unique(row)] += 1
    holding /= np.array([[(y == 0).sum()], [(y == 1).sum()]])
    seen = np.zeros((2, BUCKETS))
    seen[:, present] = np.stack([segment_sums(h[word_of], bucket_starts) for h in holding])
    prior = PRIOR / min((y == 0).sum(), (y == 1).sum())
    embedding = rng.normal(0, 0.01, (BUCKETS, DIMENSION)).astype(np.float32)
    embedding[:, 0] = np.log((seen[1] + prior) / (seen[0] + prior))
    softmax = rng.normal(0, 0.1, (DIMENSION, 2)).astype(np.float32)
    softmax[0] = -0.5, 0.5
    bias = np.zeros(2, np.float32)
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()).astype(np.float32)
    params, moments = [embedding, softmax, bias], [[0.0, 0.0] for _ in range(3)]
    for step in range(1, passes + 1):
        sharp = 2 + 6 * step / passes
        vectors = segment_sums(embedding[table.flat], table.starts) / table.counts[:, None]
        mean = segment_sums(vectors[words], passage) / length[:, None]
        odds = mean @ softmax + bias
        value = odds[:, 1] - odds[:, 0]
        top = np.maximum.reduceat(value, first)
        share = np.exp(sharp * (value - top[of_text]))
        share /= segment_sums(share, first)[of_text]
        text_value = segment_sums(share * value, first)
        error = weight * (1 / (1 + np.exp(-np.clip(text_value, -30, 30))) - y)
        d_value = (error[of_text] * share * (1 + sharp * (value - text_value[of_text]))).astype(np.float32)
        d_odds = np.stack([-d_value, d_value], axis=1)
        d_mean = d_odds @ softmax.T / length[:, None]
        d_word = segment_sums(d_mean[of_passage[by_word]], word_starts) / table.counts[:, None]
        d_embedding = np.zeros_like(embedding)
        d_embedding[present] = segment_sums(d_word[word_of].astype(np.float32), bucket_starts)
        d_embedding += DECAY * weight.mean() * embedding
        for p, g, m in zip(params, (d_embedding, mean.T @ d_odds, d_odds.sum(axis=0)), moments):
            m[0] = 0.9 * m[0] + 0.1 * g
            m[1] = 0.99 * m[1] + 0.01 * g * g
            p -= (0.03 * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    values = embedding @ (softmax[:, 1] - softmax[:, 0])
    # the worst passage as scoring sees it, and the logistic curve over it
    seen = (segment_sums(values[table.flat], table.starts) / table.counts)
    worst = np.maximum.reduceat(segment_sums(seen[words], passage) / length, first)
    spread = worst.std() + 1e-6
    scale, shift = 1.0 / spread, -worst.mean() / spread
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(scale * worst + shift, -30, 30)))
        err, curve = weight * (p - y), weight * p * (1 - p) + 1e-9
        gradient = np.array([(err * worst).sum() + 1e-3 * scale, err.sum()])
        hessian = np.array([[(curve * worst * worst).sum() + 1e-3, (curve * worst).sum()], [(curve * worst).sum(), curve.sum() + 1e-6]])
        move = np.linalg.solve(hessian, gradient)
        scale, shift = scale - np.clip(move[0], -1, 1), shift - np.clip(move[1], -1, 1)
        if abs(move).max() < 1e-6:
            break
    return {"values": values.astype(np.float32), "scale": float(scale), "shift": float(shift)}


def score_text(text: str | None, scores: WordScores, model: dict) -> float:
    """Probability of the worst passage; a text without words counts as one empty passage."""
    known = scores.of(words_of(text))[:, 0]
    if not len(known):
        worst = 0.0
    else:
        at = np.arange(0, len(known), PASSAGE)
        worst = float((np.add.reduceat(known, at) / np.diff(np.append(at, len(known)))).max())
    return float(1 / (1 + np.exp(-np.clip(model["scale"] * worst + model["shift"], -30, 30))))


def score_column(docs: DataFrame, model: dict | None, text: str = "text") -> Column:
    """Score of a text column, 0 to 1; 0 for every text if there is no model."""
    if model is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = shared.value
        scores = WordScores(held["values"], SIZES, BUCKETS - 1, held)
        for texts in batches:
            yield pd.Series([score_text(t, scores, held) for t in texts], dtype="float64")

    return score(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 5) -> DataFrame:
    """``key, held_out, score, predicted`` of every row.

    Rows whose crc32(key as text) is divisible by ``modulus`` are held out of
    training; rows with a NULL key are neither held out nor learnt from.  NULL,
    empty and blank texts have the score of an empty passage.  Repeated rows are
    scored one by one; other columns are ignored.  Without labels of both kinds
    every score is 0.
    """
    model = train(*training_sample(docs, labels, key, text, modulus=modulus))
    scored = docs.select(key, (key_remainder(key, modulus) == 0).alias("held_out"), score_column(docs, model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", modulus: int = 5) -> DataFrame:
    """The rows of ``docs`` scored below 0.5, with all their columns."""
    model = train(*training_sample(docs, labels, key, text, modulus=modulus))
    return docs.where(score_column(docs, model, text) < 0.5)
