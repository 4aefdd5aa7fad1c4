"""Quality classifier: document evidence and the record of its site, by hierarchical empirical Bayes.

A logistic regression over the measures of the quality rules gives each document a probability.
Hosts and paths get Beta posteriors of being good from the soft counts of all their documents:
a path is shrunk toward its host, a host toward the whole corpus. How strongly is estimated from
the corpus itself, by the method of moments: the less sites differ beyond chance, the more they
are shrunk. A document's score adds the log-odds of its path, without the document itself and
relative to the corpus, to its own evidence.

The regression is fitted on a bounded sample (`PER_CLASS` labelled documents a class); sites are
counted over all documents, by grouped aggregation that combines before its shuffles.

Defined cases: null and empty texts are scored by their (zero) measures; a document without a
host belongs to one nameless host, likewise for paths; with labels of one class only the
evidence is that class's rate; repeated rows count each; ids may be null; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwatch.llm.common import bounded_sample, prepare, written
from parcelwatch.llm.quality_rules import measure

PER_CLASS = 2000
STEPS, L2 = 60, 1.0
WEIGHT = 0.5  # of a site's record against a document's own evidence
PRIORS = (1.0, 1e6)  # bounds of the estimated prior strengths, in documents
BOUND = 8.0  # log-odds of the evidence are cut here, so that no document outweighs its site


def features(m: Column) -> list[Column]:
    """Numbers for the regression, out of the measures of a text."""
    words, chars, lines = (F.greatest(m[c], F.lit(1).cast("long")) for c in ("n_words", "word_chars", "n_lines"))
    letters = F.greatest(m["n_letters"], F.lit(1).cast("long"))
    size = F.log1p(m["n_words"])
    return [
        size,
        size * size,
        m["word_chars"] / words,
        F.least(m["n_symbols"] / words, F.lit(3.0)),
        m["n_dup_lines"] / lines,
        m["n_repeat_words"] / words,
        F.least(m["n_stop_words"] / words, F.lit(0.2)),
        m["n_capitals"] / letters,
        m["n_letters"] / chars,
        (m["n_words"] < 50).cast("double"),
    ]


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Logistic regression by Newton's method with a ridge."""
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.full(x.shape[1], L2), 1e-3]
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The regression on a bounded sample of labelled documents (`labels`: doc_id, quality)."""
    known = labels.filter("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = bounded_sample(known, "quality", PER_CLASS, F.col("doc_id"))
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    some = measure(texts.join(F.broadcast(sample), "doc_id"), "text", "m")
    rows = some.select("quality", F.array(*(f.cast("double") for f in features(F.col("m")))).alias("x")).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.x, r.quality))  # any order of tasks gives the same model
    return fit(np.array([r.x for r in rows]), np.array([r.quality for r in rows], float))


def evidence(m: Column, model: Model | None) -> Column:
    """Log-odds that a document is good, from its measures."""
    total = F.lit(model.bias if model else 0.0)
    if model:
        for f, mean, scale, w in zip(features(m), model.mean, model.scale, model.weights, strict=True):
            total = total + (f - F.lit(float(mean))) * F.lit(float(w / scale))
    return F.greatest(F.least(total, F.lit(BOUND)), F.lit(-BOUND))


# --- sites ----------------------------------------------------------------------------------


def sites_of_pages(pages: DataFrame) -> DataFrame:
    """doc_id, host and path of web pages whose address ends in the number of a document.

    A document with several pages takes its smallest address; addresses without a number none.
    """
    number = F.regexp_extract("url", r"/([0-9]{1,18})(?:\.[a-z]+)?/?(?:[?#].*)?$", 1)
    found = pages.select(F.when(number != "", number).cast("long").alias("doc_id"), "url")
    first = found.filter("doc_id is not null").groupBy("doc_id").agg(F.min("url").alias("url"))
    return first.select(
        "doc_id",
        F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"),
        F.regexp_extract("url", r"^[a-z]+://[^/?#]+/([^/?#]*)/", 1).alias("path"),
    )


def _logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.log(p / (1 - p))


def strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength, in documents, by the method of moments.

    `groups` has n and good (soft count) of each site; `mean` is what a site is shrunk toward.
    The spread of site rates beyond what chance explains gives the variance of the prior.
    """
    rate = F.col("good") / F.col("n")
    chance = mean * (1 - mean) / F.col("n")
    row = (
        groups.filter("n > 1")
        .agg(
            F.sum((rate - mean) * (rate - mean) * F.col("n")).alias("spread"),
            F.sum(chance * F.col("n")).alias("chance"),
            F.sum(mean * (1 - mean) * F.col("n")).alias("whole"),
            F.sum("n").alias("n"),
        )
        .first()
    )
    if not row.n or not row.whole:
        return PRIORS[1]
    between = max(0.0, (row.spread - row.chance) / row.n)
    if between == 0.0:
        return PRIORS[1]
    return float(np.clip(row.whole / row.n / between - 1, *PRIORS))


def combine(scored: DataFrame) -> DataFrame:
    """`scored` (key columns, host, path, evidence) with host and path posteriors and `score`."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    scored = scored.withColumn("good", p)
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("decimal(20,12)")).cast("double").alias("good"))
    paths = written(paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum(F.col("good").cast("decimal(38,9)")).cast("double").alias("good"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum(F.col("good").cast("decimal(38,9)")).cast("double").alias("good")).first()
    corpus = total.good / total.n if total.n else 0.5
    k_host = strength(hosts, F.lit(corpus))
    host_mean = (F.col("host_good") + k_host * corpus) / (F.col("host_n") + k_host)
    renamed = hosts.select(F.col("host").alias("host_"), F.col("n").alias("host_n"), F.col("good").alias("host_good"))
    nested = paths.join(renamed, paths["host"].eqNullSafe(renamed["host_"])).drop("host_")
    k_path = strength(nested.withColumn("host_mean", host_mean), F.col("host_mean"))
    sites = nested.select(
        F.col("host").alias("host_"), F.col("path").alias("path_"), "host_n", "host_good",
        F.col("n").alias("path_n"), F.col("good").alias("path_good"),
    )
    met = scored.join(sites, scored["host"].eqNullSafe(sites["host_"]) & scored["path"].eqNullSafe(sites["path_"]))
    others_host = (F.col("host_good") - F.col("good") + k_host * corpus) / (F.col("host_n") - 1 + k_host)
    others_path = (F.col("path_good") - F.col("good") + k_path * F.col("host_posterior")) / (F.col("path_n") - 1 + k_path)
    return (
        met.withColumn("host_posterior", others_host)
        .withColumn("path_posterior", others_path)
        .withColumn("log_odds", F.col("evidence") + WEIGHT * (_logit(F.col("path_posterior")) - _logit(F.lit(corpus))))
        .withColumn("score", 1 / (1 + F.exp(-F.col("log_odds"))))
        .drop("host_", "path_", "host_n", "host_good", "path_n", "path_good", "good")
    )


def classify(
    docs: DataFrame,
    sites: DataFrame,
    model: Model | None,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
) -> DataFrame:
    """A row per document: doc_id, host, path, evidence, posteriors and score.

    `sites` (doc_id, host, path) says where documents were found; for others the two columns
    of `docs` stand in for host and path.
    """
    prepare(docs.sparkSession)
    measured = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{host_col}`").alias("own_host"),
        F.col(f"`{path_col}`").alias("own_path"),
        F.col(f"`{text_col}`").alias("text"),
    )
    measured = measure(measured, "text", "m")
    # small rows from here on: texts are measured once and left behind
    known = written(measured.select("doc_id", "own_host", "own_path", evidence(F.col("m"), model).alias("evidence")), "evidence")
    found = known.join(sites, "doc_id", "left")
    on_page = F.col("host").isNotNull()
    scored = found.select(
        "doc_id",
        F.when(on_page, F.col("host")).otherwise(F.col("own_host")).alias("host"),
        F.when(on_page, F.col("path")).otherwise(F.col("own_path")).alias("path"),
        "evidence",
    )
    return combine(written(scored, "sites"))
