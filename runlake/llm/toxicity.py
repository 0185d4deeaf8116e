"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features are the presence of word unigrams, bigrams and skip-grams (one word
left out), hashed to 2^20 coordinates.  FTRL-proximal keeps a learning rate
per coordinate, and its L1 term holds rarely useful coordinates at exactly
zero, so the model is a short list of (coordinate, weight): at most 2^20
entries of 12 bytes are sent to the tasks.

Fitting uses a bounded sample: the ``SAMPLE_ROWS`` labelled rows with the
smallest id hash; their features are made in parallel and the online learner
reads them as a stream, one row after another.  Later passes replay the first
``REPLAY`` features, which bounds its memory.  Scores use only the text, and
all of it.

Null and empty texts get the score of no features; labels without a value or
without a document are ignored; ids labelled more than once count as toxic if
any label says so; without any usable label every score is 0.  Only doc_id and
text (and doc_id and toxic of labels) are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import apart

BITS = 20
SAMPLE_ROWS = 16_000
REPLAY = 30_000_000
PASSES = 4
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.0
CACHED, LONGEST = 100_000, 64          # words a task remembers, and up to which length: bounds their bytes
WORD = re.compile(r"\w+")


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < CACHED and len(word) <= LONGEST:
            self[word] = h
        return h


def _positions(text: str | None, known: _WordHashes) -> np.ndarray:
    """Coordinates of all word, bigram and skip-gram occurrences of a text."""
    words = WORD.findall((text or "").lower())
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
    follow = h * np.uint64(0x9E3779B97F4A7C15)
    grams = np.concatenate([h, follow[:-1] ^ (h[1:] + np.uint64(1)), follow[:-2] ^ (h[2:] + np.uint64(2))])
    grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return (grams >> np.uint64(64 - BITS)).astype(np.int32)


def ftrl(rows: Iterator[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Fit on (coordinates, label) rows; returns non-zero coordinates, weights, bias and rows seen."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias, bias_n = 0.0, 0.0
    held: list[tuple[np.ndarray, int]] = []
    size, seen = 0, 0

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    def learn(i: np.ndarray, y: int) -> None:
        nonlocal bias, bias_n
        w = weights(i)
        g = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
        root = np.sqrt(n[i])
        z[i] += g - (np.sqrt(n[i] + g * g) - root) / ALPHA * w
        n[i] += g * g
        bias_n += g * g
        bias -= ALPHA / (BETA + np.sqrt(bias_n)) * g

    for i, y in rows:
        seen += 1
        learn(i, y)
        if size + len(i) <= REPLAY:
            held.append((i, y))
            size += len(i)
    for _ in range(PASSES - 1):
        for i, y in held:
            learn(i, y)
    at = np.flatnonzero(np.abs(z) > L1)
    return at, weights(at), bias, seen


def fit(docs: DataFrame, labels: DataFrame, usable) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The model, from rows of ``labels`` for which ``usable`` (a condition on doc_id) holds."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(usable & F.col("toxic").isNotNull())
    marks = marks.where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)

    @F.pandas_udf("array<int>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _WordHashes()
        for texts in batches:
            yield pd.Series([np.unique(_positions(t, known)) for t in texts])

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = ((np.asarray(i, dtype=np.int32), int(y)) for b in batches for i, y in zip(b["features"], b["toxic"]))
        at, w, bias, seen = ftrl(stream)
        yield pd.DataFrame({"at": [at.astype("<i4").tobytes()], "w": [w.astype("<f8").tobytes()], "bias": [bias],
                            "seen": [seen]})

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")       # at most SAMPLE_ROWS ids
    rows = rows.select(F.xxhash64("doc_id").alias("h"), "doc_id", "toxic", features("text").alias("features"))
    model = rows.repartition(1).sortWithinPartitions("h", "doc_id").select("toxic", "features") \
        .mapInPandas(learn, "at binary, w binary, bias double, seen long").collect()
    if not model:
        return np.empty(0, "<i4"), np.empty(0), 0.0, 0
    m = model[0]
    return np.frombuffer(m["at"], "<i4"), np.frombuffer(m["w"], "<f8"), m["bias"], m["seen"]


def scorer(spark, model):
    """A column function text -> score in [0, 1]."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w, bias, seen = shared.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        known = _WordHashes()
        for texts in batches:
            out = np.zeros(len(texts))
            for k, text in enumerate(texts if seen else ()):
                i = _positions(text, known)
                i = i[dense[i] != 0]
                out[k] = 1.0 / (1.0 + np.exp(-np.clip(bias + dense[np.unique(i)].sum(), -35, 35)))
            yield pd.Series(out)

    return score


def toxicity_scores(docs: DataFrame, labels: DataFrame, usable) -> DataFrame:
    """doc_id, score for every row of ``docs``."""
    score = scorer(docs.sparkSession, fit(docs, labels, usable))
    return docs.select("doc_id", score("text").alias("score"))


def clean_documents(docs: DataFrame, labels: DataFrame, usable, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``limit``, unchanged."""
    score = scorer(docs.sparkSession, fit(docs, labels, usable))
    return apart(docs, "_toxicity", ["doc_id", "text"], lambda d: d.withColumn("_toxicity", score("text")).where(
        F.col("_toxicity") < limit).select(*d.columns))
