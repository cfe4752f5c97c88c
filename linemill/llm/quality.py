"""Quality classifier by positive-unlabelled learning with the non-negative risk.

Trusted positives are documents labelled of quality 1; the rest of what the model learns from is web text without a
label. The class prior is the share of quality 1 among all labelled rows outside the held-out fold; if no row there is
labelled 0, it is estimated from the two samples (the least ratio of unlabelled to positive mass over regions of high
score, which is the prior where a region holds no negatives). The model is logistic over shares of byte and
word classes of the whole text (see ``_features``); it minimises

    prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)])

and steps back where the second term turns negative, which is what keeps it from fitting the unlabelled positives.

Labels of rows whose crc32(doc_id as text) mod 4 is 2 are held out; neither labels, lang, source nor doc_id are inputs of
a score. The fit reads at most ``positives`` + ``unlabelled`` documents (least hashes of the id: the same sample on each
run), whose features, a few MB, are all that comes to the driver. Scoring is one pass without a shuffle.

Defined results: null and empty texts have all features zero and get the score that belongs to that; repeated rows score
alike; ids with contradicting labels count as unlabelled; without any positive or unlabelled text every score is the
prior, 0.5; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linemill.llm._common import plain, renamed
from linemill.llm._features import HELD_OUT, Adam, Scale, bounded, dense, fold, sigmoid
from linemill.llm._tokens import slices

POSITIVES, UNLABELLED, ACCEPT_AT = 20_000, 20_000, 0.7
STEPS, RATE, DECAY = 600, 0.05, 1e-4


@dataclass
class Model:
    scale: Scale | None
    weights: np.ndarray | None
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.scale is None or self.weights is None:
            return np.full(len(features), self.prior)
        return sigmoid(self.scale(features) @ self.weights)


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.3) -> float:
    """From scores of both samples: the least U(score > t) / P(score > t) where at least a share of the positives is."""
    p, u = np.sort(positive), np.sort(unlabelled)
    cuts = np.quantile(p, np.linspace(0, 1 - least_share, 64))
    over = lambda s: 1 - np.searchsorted(s, cuts, side="left") / len(s)
    return float(np.clip(np.min(over(u) / np.maximum(over(p), 1e-9)), 0.05, 0.99))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 300) -> np.ndarray:
    w, adam = np.zeros(x.shape[1]), Adam(x.shape[1], RATE)
    share = np.where(y, 0.5 / max(1, y.sum()), 0.5 / max(1, (~y).sum()))
    for _ in range(steps):
        w -= adam.step(x.T @ ((sigmoid(x @ w) - y) * share) + DECAY * w)
    return w


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None) -> Model:
    """Fit on the features of positives and of unlabelled texts; the prior is estimated unless given."""
    if not len(positive) or not len(unlabelled):
        return Model(None, None, 0.5)
    scale = Scale(np.concatenate((positive, unlabelled)).astype(np.float64))
    p, u = scale(positive), scale(unlabelled)
    if prior is None:
        w = fit_logistic(np.concatenate((p, u)), np.arange(len(p) + len(u)) < len(p))
        prior = estimated_prior(p @ w, u @ w)
    w, adam = np.zeros(p.shape[1]), Adam(p.shape[1], RATE)
    for _ in range(STEPS):
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        negative_part = np.mean(-np.log1p(-np.minimum(su, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.minimum(sp, 1 - 1e-12)))
        of_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        of_positive = prior * (p.T @ (sp - 1)) / len(p)
        w -= adam.step((of_positive + of_negative if negative_part >= 0 else -of_negative) + DECAY * w)
    return Model(scale, w, prior)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = dense(part["text"])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.record_batch([part["positive"], lists], names=["positive", "features"])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    label = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").where(fold(F.col("doc_id")) != HELD_OUT).distinct()
    known = ids.join(label, F.col("doc_id") == F.col("_id"), "left")
    share = known.agg(F.count_if(F.expr("low = 1 and high = 1")).alias("good"), F.count_if(F.expr("low = 0 and high = 0")).alias("bad")).first()
    prior = min(0.99, max(0.05, share["good"] / (share["good"] + share["bad"]))) if share["bad"] else None
    good = bounded(known.where("low = 1 and high = 1").select("doc_id"), positives, 1, "doc_id").select("doc_id", F.lit(True).alias("positive"))
    rest = bounded(known.where("low is null or low <> high").select("doc_id"), unlabelled, 2, "doc_id").select("doc_id", F.lit(False).alias("positive"))
    # Bounded by the two parameters, so broadcasting the ids is safe.
    chosen = F.broadcast(good.unionByName(rest).withColumnRenamed("doc_id", "_id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("_id")).select("positive", "text")
    sample = texts.mapInArrow(_featured, "positive boolean, features array<float>").toArrow()
    x = sample["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(sample.num_rows, -1) if sample.num_rows else np.zeros((0, 1), np.float32)
    order = np.lexsort(x.T) if len(x) else np.zeros(0, int)  # the sums of a fit don't depend on the order of arrival
    y = np.asarray(sample["positive"].to_pylist(), bool)[order] if sample.num_rows else np.zeros(0, bool)
    x = x[order]
    return fit_non_negative(x[y], x[~y], prior)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with column ``_lm_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("_lm_score", T.DoubleType())])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = shared.value.score(dense(part["text"]).astype(np.float64))
                yield pa.record_batch([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, "_lm_score"])

    return docs.mapInArrow(scored, schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_texts(docs.select("doc_id", F.col("text").cast("string").alias("text")), train(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), F.col("_lm_score").alias("score"), F.when(F.col("_lm_score") >= ACCEPT_AT, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts."""
    rows, names = plain(docs, "doc_id", "text")
    accepted = score_texts(rows, train(docs.select("doc_id", "text"), labels)).where(F.col("_lm_score") >= ACCEPT_AT)
    return accepted.select(*renamed(accepted, names, docs.columns))
