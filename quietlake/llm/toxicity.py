"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Training takes at most ``per_class`` labelled rows of either class (the documented bound of
the fit). A first pass counts, per hashed n-gram, in how many rows of either class it stands;
the log of the ratio of the smoothed shares is its scale. The ``n_features`` n-grams whose
counts differ most clearly (by the likelihood ratio statistic) carry on to a logistic
regression over presence times scale, in which either class weighs one half. Scoring is one
pass over the documents without any shuffle; the model is a table of at most ``n_features``
numbers, which is broadcast.

Edge cases: null text counts as empty and scores the model's bias; a null doc_id is scored
and is never learnt from; repeated rows are scored each; with labels of one class only, or
none, every score is that class's share (0 without labels); texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, training_rows, written

BITS = 22
ORDERS = (4, 5, 6)


def ngram_buckets(texts: list[str]):
    """For each order: (document number, bucket) of every n-gram of the lower-cased texts."""
    lowered = [f" {t.lower()} " for t in texts]
    lengths = np.array([len(t) for t in lowered])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    mixed = codes * np.uint32(0x9E3779B1)
    rolled = mixed
    for n in range(2, max(ORDERS) + 1):
        if len(rolled) < 2:
            return
        rolled = rolled[:-1] * np.uint32(0x01000193) + mixed[n - 1 :]
        if n in ORDERS:
            whole = doc[: len(rolled)] == doc[n - 1 :]
            buckets = ((rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            yield doc[: len(rolled)][whole], buckets[whole]


def _presence(texts: list[str], column: np.ndarray | None = None):
    """Distinct (document number, feature); with ``column``, of the buckets that it maps to a feature."""
    keys = []
    for doc, bucket in ngram_buckets(texts):
        feature = bucket if column is None else column[bucket]
        if column is not None:
            kept = feature >= 0
            doc, feature = doc[kept], feature[kept]
        keys.append((doc.astype(np.int64) << 32) | feature.astype(np.int64))
    both = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return both >> 32, both & 0xFFFFFFFF


def _counts(batches):
    pos, neg = np.zeros(1 << BITS, np.int32), np.zeros(1 << BITS, np.int32)
    for batch in small_batches(batches, 1 << 20):
        labels = np.array(batch.column(0).to_pylist())
        doc, bucket = _presence([t or "" for t in batch.column(1).to_pylist()])
        is_pos = labels[doc] == 1
        pos += np.bincount(bucket[is_pos], minlength=1 << BITS).astype(np.int32)
        neg += np.bincount(bucket[~is_pos], minlength=1 << BITS).astype(np.int32)
    seen = np.flatnonzero(pos + neg)
    for start in range(0, len(seen), 100_000):
        b = seen[start : start + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(pos[b]), pa.array(neg[b])], names=["bucket", "pos", "neg"])


def _column(buckets) -> np.ndarray:
    column = np.full(1 << BITS, -1, np.int32)
    column[np.asarray(buckets, np.int64)] = np.arange(len(buckets))
    return column


def _rows(buckets):
    def run(batches):
        column = _column(buckets.value)
        for batch in small_batches(batches, 1 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            doc, feature = _presence(texts, column)
            ends = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(feature.astype(np.int32)))], names=["label", "features"])

    return run


def fit_logistic(indptr, indices, scale, y, l2: float = 1e-3, steps: int = 200, rate: float = 0.1):
    """Weights over presence times ``scale``, by Adam on the mean logistic loss with a ridge; either class weighs one half."""
    row = np.repeat(np.arange(len(y)), np.diff(indptr))
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    x = scale[indices]
    w, bias = np.zeros(len(scale)), 0.0
    m, v = np.zeros(len(scale) + 1), np.zeros(len(scale) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[indices] * x, len(y)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.append(np.bincount(indices, d[row] * x, len(scale)) + l2 * w, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 3000, n_features: int = 4096) -> dict:
    """{'buckets', 'weights', 'bias'}: what score() needs."""
    sample = written(training_rows(docs, labels, label, per_class).select("label", "text"), "toxic-sample")
    sizes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        share = n_pos / max(1, n_pos + n_neg)
        return {"buckets": [], "weights": np.zeros(0), "bias": 30.0 * (2 * share - 1)}
    counted = sample.coalesce(8).mapInArrow(_counts, "bucket int, pos int, neg int").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    p, q = (F.col("pos") + 1.0) / (n_pos + 2.0), (F.col("neg") + 1.0) / (n_neg + 2.0)
    both = (F.col("pos") + F.col("neg") + 2.0) / (n_pos + n_neg + 4.0)
    clear = F.col("pos") * F.log(p / both) + F.col("neg") * F.log(q / both) + (n_pos - F.col("pos")) * F.log((1 - p) / (1 - both)) + (n_neg - F.col("neg")) * F.log((1 - q) / (1 - both))
    top = counted.filter(F.col("pos") + F.col("neg") >= 3).select("bucket", F.log(p / q).alias("ratio"), clear.alias("clear")).orderBy(F.desc("clear"), "bucket").limit(n_features).toPandas()
    buckets = sample.sparkSession.sparkContext.broadcast(top["bucket"].tolist())
    rows = sample.mapInArrow(_rows(buckets), "label int, features array<int>").toArrow().combine_chunks()
    features = rows.column("features").combine_chunks()
    indptr = np.append(0, np.cumsum(features.value_lengths().to_numpy(zero_copy_only=False)))
    y = rows.column("label").to_numpy().astype(float)
    ratio = top["ratio"].to_numpy()
    w, bias = fit_logistic(indptr, features.flatten().to_numpy(), ratio, y)
    return {"buckets": top["bucket"].tolist(), "weights": w * ratio, "bias": float(bias)}


def _scores(model):
    def run(batches):
        m = model.value
        column, weights = _column(m["buckets"]), m["weights"]
        for batch in small_batches(batches, 2 << 20):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            doc, feature = _presence(texts, column)
            z = np.bincount(doc, weights[feature], len(texts)) + m["bias"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -700, 700))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row; score is between 0 and 1, higher for the likelier label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scores(shared), "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = score(docs, train(docs, labels, **fit))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
