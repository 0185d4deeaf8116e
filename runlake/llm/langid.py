"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character 1- to 3-grams, hashed to 2^16
coordinates: text is lower-cased, runs of non-letters become one space, counts
are damped by log(1 + n) and rows have unit length.  The weights are learned
by follow-the-regularised-leader with an elastic net (L1 keeps them sparse, L2
small) and the class scores are then divided by one temperature, chosen to
minimise the log loss on sample rows left out of the fit.

The fit uses a bounded sample of rows with a language: at most
``PER_LANGUAGE`` per language, ``SAMPLE_ROWS`` and ``SAMPLE_ENTRIES`` feature
values in all, taken by id hash.  Predictions read the whole text and nothing
else.  A model takes at most 512 KiB per language.

Null texts and texts without a letter are ``und`` with score 0; with no
learned language every text is.  Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_ENTRIES = 1_500, 16_000, 20_000_000
PASSES = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.01
HELD = 5                               # every fifth sample row sets the temperature


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x10000)), dtype=bool, count=0x10000)


def _counts(text: str | None, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and occurrence counts of a text's character n-grams; empty without a letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = np.minimum(code, 0xFFFF)
    is_letter = letters[low] & (code < 0x10000)
    for i in np.flatnonzero(code >= 0x10000):
        is_letter[i] = chr(code[i]).isalpha()
    if not is_letter.any():
        return np.empty(0, np.intp), np.empty(0)
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]                     # one space after each run of letters
    c = np.where(is_letter, code, 32)[keep].astype(np.uint64)
    c = np.concatenate([[32], c]).astype(np.uint64)
    two = c[:-1] * np.uint64(0x9E3779B97F4A7C15) + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    three = two[:-1] + c[2:] * np.uint64(0x165667B19E3779F9) + np.uint64(3)
    grams = np.concatenate([c * np.uint64(0xD6E8FEB86659FD93), two, three])
    grams = (grams ^ (grams >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    n = np.bincount((grams >> np.uint64(64 - BITS)).astype(np.intp), minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at].astype(np.float64)


def _unit(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(n) * idf
    return x / max(np.sqrt(x @ x), 1e-12)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl_multinomial(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int):
    """Weights (coordinates x classes), idf and bias, divided by the fitted temperature."""
    seen = np.zeros(1 << BITS)
    for at, _, _ in rows:
        seen[at] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    x = [(at, _unit(n, idf[at]), y) for at, n, y in rows]
    fit = [r for i, r in enumerate(x) if i % HELD] or x
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    bias, bias_n = np.zeros(classes), np.zeros(classes)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(PASSES):
        for at, v, y in fit:
            w = weights(at)
            p = _softmax(bias + v @ w)
            p[y] -= 1
            g = v[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
            bias_n += p * p
            bias -= ALPHA / (BETA + np.sqrt(bias_n)) * p
    w = weights(np.arange(1 << BITS))
    held = [r for i, r in enumerate(x) if i % HELD == 0]
    scores = np.array([bias + v @ w[at] for at, v, _ in held])
    truth = np.array([y for _, _, y in held])

    def loss(t: float) -> float:
        return -np.log(np.maximum(_softmax(scores / t)[np.arange(len(truth)), truth], 1e-12)).mean()

    t = min(np.geomspace(0.02, 20, 121), key=loss) if len(held) else 1.0
    return w / t, idf, bias / t


def fit(docs: DataFrame, usable) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, weights, idf and bias, from documents for which ``usable`` (a condition on doc_id) holds."""
    ids = docs.select("doc_id", "lang").where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    ids = ids.withColumn("h", F.xxhash64("doc_id"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    sample = ids.withColumn("_n", nth).where(F.col("_n") <= PER_LANGUAGE).orderBy("_n", "h", "lang").limit(SAMPLE_ROWS)
    sample = F.broadcast(sample.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), "h"))

    @F.pandas_udf("at array<int>, n array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters = _letter_table()
        for texts in batches:
            rows = [_counts(t, letters) for t in texts]
            yield pd.DataFrame({"at": [r[0].astype(np.int32) for r in rows], "n": [r[1] for r in rows]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, size = [], 0
        for b in batches:
            for at, n, lang in zip(b["at"], b["n"], b["lang"]):
                if len(at) and size + len(at) <= SAMPLE_ENTRIES:
                    rows.append((np.asarray(at, dtype=np.intp), np.asarray(n), lang))
                    size += len(at)
        langs = sorted({r[2] for r in rows})
        if langs:
            w, idf, bias = ftrl_multinomial([(a, n, langs.index(y)) for a, n, y in rows], len(langs))
            blobs = [None, *langs], [idf, *w.T]
            yield pd.DataFrame({"lang": blobs[0], "w": [v.astype("<f8").tobytes() for v in blobs[1]],
                                "bias": [0.0, *bias]})

    rows = docs.select("doc_id", "text", "lang").join(
        sample, (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    rows = rows.select("h", "doc_id", "lang", features("text").alias("f")).select("h", "doc_id", "lang", "f.*")
    model = rows.repartition(1).sortWithinPartitions("h", "doc_id").select("lang", "at", "n") \
        .mapInPandas(learn, "lang string, w binary, bias double").collect()
    langs = sorted(r["lang"] for r in model if r["lang"] is not None)
    by = {r["lang"]: r for r in model}
    vec = {k: np.frombuffer(r["w"], "<f8").astype(np.float32) for k, r in by.items()}
    if not langs:
        return [], np.empty((1 << BITS, 0), np.float32), np.ones(1 << BITS, np.float32), np.empty(0)
    return langs, np.stack([vec[k] for k in langs], axis=1), vec[None], np.array([by[k]["bias"] for k in langs])


def predictions(docs: DataFrame, usable) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, usable))

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, w, idf, bias = shared.value
        letters = _letter_table()
        for texts in batches:
            best, score = [], []
            for text in texts:
                at, n = _counts(text, letters) if langs else ((), ())
                if not len(at):
                    best.append("und")
                    score.append(0.0)
                    continue
                p = _softmax(bias + _unit(n, idf[at]) @ w[at])
                best.append(langs[int(p.argmax())])
                score.append(float(p.max()))
            yield pd.DataFrame({"lang_pred": best, "score": score})

    return docs.select("doc_id", predict("text").alias("p")).select("doc_id", "p.*")
