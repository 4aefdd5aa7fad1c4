"""Language identification: sparse multinomial logistic regression on character n-grams.

Texts become TF-IDF vectors of hashed character n-grams (log term counts, unit length). The
inverse document frequencies count every training document. The weights are learnt with
follow-the-regularised-leader (per-coordinate steps, elastic-net penalty, so most stay zero) on
a bounded sample of at most about `PER_LANGUAGE` rows a language, and a temperature fitted on
rows left out of the learning makes the probabilities honest.

Defined cases: a null text, or one without a letter, is `und` with score 0; so is every text
when there is nothing to learn from; rows with a null language are scored but not learnt from;
long texts are read whole; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import bounded_sample, free_name, prepare

BUCKETS = 1 << 14
ORDERS = (2, 3)
PER_LANGUAGE = 1200
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
UNDETERMINED = "und"

_PIECE = 1 << 20


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    idf: np.ndarray  # a weight for each bucket
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text's n-grams, and how often each occurs."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    seen = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(points), _PIECE):
        piece = points[at : at + _PIECE + max(ORDERS) - 1]
        for order in ORDERS:
            n = min(len(piece) - order + 1, _PIECE)
            if n <= 0:
                continue
            key = np.full(n, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for i in range(order):
                key = (key ^ piece[i : i + n]) * np.uint32(0x85EBCA6B)
                key ^= key >> np.uint32(13)
            seen += np.bincount(key >> np.uint32(18), minlength=BUCKETS)
    buckets = np.flatnonzero(seen)
    return buckets, seen[buckets]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def vector(buckets: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[buckets]
    return x / max(np.sqrt(x @ x), 1e-12)


# --- learning -------------------------------------------------------------------------------


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts (column `text`) each bucket occurs, and how many texts there are."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = np.zeros(BUCKETS + 1, np.int64)
        for part in parts:
            for text in part["text"]:
                found[gram_counts(text)[0]] += 1
            found[BUCKETS] += len(part)
        hit = np.flatnonzero(found)
        yield pd.DataFrame({"bucket": hit, "n": found[hit]})

    totals = texts.mapInPandas(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in totals.collect():  # one row a bucket
        found[bucket] = n
    return found[:BUCKETS], int(found[BUCKETS])


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases after `EPOCHS` passes over (buckets, values, class) examples."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def leader(z, n, l1):
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for e in rng.permutation(len(examples)):
            at, x, y = examples[e]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = leader(z[at], n[at], L1)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    w = leader(z, n, L1)
    return w[:BUCKETS], w[BUCKETS]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest (golden-section search)."""
    if not len(y):
        return 1.0

    def loss(log_t):
        p = _softmax(logits / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()

    low, high, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of the languages in `docs`; rows without a language or a letter teach nothing."""
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    df, texts = document_frequencies(rows.select("text"))
    idf = np.log((1 + texts) / (1 + df)) + 1

    def vectors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            grams = [gram_counts(t) for t in part["text"]]
            at, n = ([g[i].astype(np.int32).tobytes() for g in grams] for i in (0, 1))
            yield pd.DataFrame({"lang": part["lang"], "key": part["key"], "at": at, "n": n})

    key = F.xxhash64("text")
    sample = bounded_sample(rows.withColumn("key", key), "lang", PER_LANGUAGE, F.col("key"))
    schema = "lang string, key long, at binary, n binary"  # arrays as bytes: small on the driver
    found = sorted(sample.mapInPandas(vectors, schema).collect(), key=lambda r: (r.key, r.lang))
    languages = tuple(sorted({r.lang for r in found}))
    examples, left_out = [], []
    for r in found:
        at, n = (np.frombuffer(b, np.int32).astype(np.int64) for b in (r.at, r.n))
        part = left_out if r.key % 5 == 0 else examples
        part.append((at, vector(at, n, idf), languages.index(r.lang)))
    if not examples:
        examples, left_out = left_out, []
    weights, bias = ftrl(examples, len(languages))
    logits = np.array([x @ weights[at] + bias for at, x, _ in left_out]).reshape(len(left_out), len(languages))
    t = temperature(logits, np.array([y for _, _, y in left_out], np.int64))
    return Model(languages, idf.astype(np.float32), weights.astype(np.float32), bias, t)


# --- predicting -----------------------------------------------------------------------------


def predict_one(text: str | None, model: Model) -> tuple[str, float]:
    if not model.languages or not has_letter(text):
        return UNDETERMINED, 0.0
    at, n = gram_counts(text)
    p = _softmax((vector(at, n, model.idf) @ model.weights[at] + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def predict(text: Column, model: Model) -> Column:
    """A struct (lang, score) for each text."""

    @F.pandas_udf("lang string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict_one(t, model) for t in texts], columns=["lang", "score"])

    return run.asNondeterministic()(text)  # so that a filter on it does not compute it twice


def identify(docs: DataFrame, model: Model, text_col: str = "text", into: str = "language") -> DataFrame:
    """`docs` with a struct column `into` (lang, score)."""
    prepare(docs.sparkSession)
    return docs.withColumn(into, predict(F.col(f"`{text_col}`"), model))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The documents in a known language, with the columns they came with."""
    name = free_name(docs, "language")
    known = (F.col(f"{name}.lang") != UNDETERMINED) & (F.col(f"{name}.score") >= min_score)
    return identify(docs, model, text_col, name).filter(known).drop(name)
