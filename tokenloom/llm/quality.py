"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives are the labelled good documents of the training folds; unlabelled text is a sample
of all training documents, labels unseen. The class prior comes from the best bin of a first
positive-against-unlabelled model: the share of unlabelled text where positives are thickest. The
model is logistic over byte frequencies and shape statistics of the whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table

#: Documents of each kind (positive, unlabelled) that the model is fitted on, at most.
FITTED = 6000
FOLDS, THRESHOLD = 5, 0.3
EXTRA = 14


def features(text: str | None) -> np.ndarray:
    """Byte frequencies (square roots) and shape of one whole text; all zero if it is empty."""
    out = np.zeros(256 + EXTRA, dtype=np.float32)
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    if not words:
        return out
    out[:256] = np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / len(raw))
    n = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = raw.split(b"\n")
    length = np.fromiter(map(len, words), np.int64, n)
    same = sum(a == b for a, b in zip(words, words[1:]))
    odd = sum(w[-1:] in b"*#%&$!|" for w in words)
    out[256:] = (
        min(np.log1p(n) / 8, 1.5),
        len(counts) / n,
        max(counts.values()) / n,
        same / n,
        odd / n,
        length.mean() / 10,
        length.std() / 10,
        (length == 1).mean(),
        (length > 20).mean(),
        sum(w.isupper() for w in words) / n,
        len(set(lines)) / len(lines),
        min(len(raw) / len(lines) / 500, 4),
        sum(not x.strip() for x in lines) / len(lines),
        1.0,
    )
    return out


class Model:
    """Standardised logistic score; without any positives every text scores 0.5."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x.astype(np.float64) - self.mean) / self.scale, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(p: np.ndarray, u: np.ndarray, prior: float, decay: float = 2e-3, steps: int = 500, rate: float = 0.05) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk: prior * l(p, +1) + max(0, l(u, -1) - prior * l(p, -1)), l logistic."""
    w = np.zeros(p.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    wide = lambda x, g: np.append(x.T @ g, g.sum()) / len(x)
    for t in range(1, steps + 1):
        zp, zu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        as_negative = wide(u, sig(zu)) - prior * wide(p, sig(zp))
        # a negative part below zero is overfitting: step back out of it
        g = prior * wide(p, sig(zp) - 1) + as_negative if negative >= 0 else -as_negative
        g = g + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives in unlabelled text: the ratio of the upper tails of the two scores, at the
    threshold where its confidence bound is least.

    Positives are split, so that the tail of positives is measured on texts the model has not seen.
    """
    half = np.arange(len(p)) % 2 == 0
    half_u = np.arange(len(u)) % 2 == 0
    w, b = descend(p[half], u[half_u], 0.5)
    sp, su = np.sort(p[~half] @ w + b), np.sort(u[~half_u] @ w + b)
    best, ratio = np.inf, 1.0
    for q in np.linspace(0, 0.9, 91):
        c = sp[int(q * len(sp))]
        in_p = 1 - np.searchsorted(sp, c) / len(sp)
        in_u = 1 - np.searchsorted(su, c) / len(su)
        slack = np.sqrt(np.log(20) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
        if (bound := (in_u + slack) / in_p) < best:
            best, ratio = bound, in_u / in_p
    return float(np.clip(ratio, 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    width = 256 + EXTRA
    if len(positive) < 4 or len(unlabelled) < 4:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), np.maximum(both.std(0), 0.01)
    p, u = (np.clip((x.astype(np.float64) - mean) / scale, -8, 8) for x in (positive, unlabelled))
    prior = class_prior(p, u) if prior is None else prior
    return Model(mean, scale, *descend(p, u, prior), prior)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def sampled_features(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features of the documents that ids (_id, good, drawn) names, in order of doc_id: those that are good,
    and those that are drawn. One scan; ids are at most twice FITTED rows."""

    @F.pandas_udf("binary")
    def packed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([features(t).tobytes() for t in texts], dtype=object)

    some = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select("doc_id", "good", "drawn", packed(F.col("text")).alias("f"))
    some = some.groupBy("doc_id", "good", "drawn").agg(F.min("f").alias("f"))  # a repeated doc_id counts once
    got = sorted((r["doc_id"], bytes(r["f"]), r["good"], r["drawn"]) for r in some.collect())
    wide = lambda rows: np.array([np.frombuffer(f, np.float32) for f in rows]).reshape(-1, 256 + EXTRA)
    return wide([f for _, f, good, _ in got if good]), wide([f for _, f, _, drawn in got if drawn])


def train(docs: DataFrame, labels: DataFrame, fitted: int = FITTED) -> Model:
    """Fit on documents outside the held-out fold; which ones is a function of doc_id alone.

    A document labelled twice counts as good only if all its labels say so. Null ids and null labels
    take no part; without positives the model gives 0.5 to all.
    """
    in_fold = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    few = lambda df: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fitted)
    good = labels.filter(in_fold & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    good = few(good.join(docs.select("doc_id").filter(in_fold), "doc_id", "left_semi")).select("doc_id", F.lit(True).alias("good"))
    drawn = few(docs.select("doc_id").filter(in_fold).distinct()).select("doc_id", F.lit(True).alias("drawn"))
    ids = good.join(drawn, "doc_id", "full").select(F.col("doc_id").alias("_id"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("drawn", F.lit(False)).alias("drawn"))
    return fit(*sampled_features(docs, ids))


def score_quality(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Adds score (0 to 1, higher: better) and predicted (1 if score >= threshold) from text alone.

    Null texts score like empty ones. Rows and other columns stay, repeated rows too; columns named
    score and predicted are replaced.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score(np.array([features(t) for t in texts]).reshape(-1, 256 + EXTRA)))

    return docs.withColumn("score", score(F.col("text"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def fold_of(doc_id) -> int:
    """The driver-side form of the fold rule."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return score_quality(docs, train(docs, labels)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
