"""Quality: histogram gradient-boosted trees over document statistics.

The statistics (lengths, shares of character classes, repetition) are computed with numpy
over whole texts in one pass. The trees are grown on at most ``per_class`` labelled rows of
either class (the documented bound of the fit), with each statistic cut into quantile bins,
and are flattened into arrays, so that scoring walks all rows of a batch down one level at
a time. Scoring needs no shuffle; the broadcast model has a fixed size.

Edge cases: null text counts as empty and has statistics of zero; a null doc_id is scored
and is never learnt from; repeated rows are scored each; with labels of one class only
every score is that class (0.5 without any label); texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, training_rows

STATS = ["chars", "words", "word_chars", "line_chars", "upper", "lower", "other_letters", "digits", "blanks", "newlines", "stops", "marks", "symbols", "bars", "top_symbol", "distinct_words", "distinct_lines", "upper_starts", "short_words", "long_words"]
_UPPER, _LOWER, _OTHER, _DIGIT, _BLANK, _NEWLINE, _STOP, _MARK, _SYMBOL, _BAR = range(10)


def _classes() -> np.ndarray:
    table = np.full(129, _SYMBOL, np.uint8)
    table[128] = _OTHER
    for chars, kind in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("abcdefghijklmnopqrstuvwxyz", _LOWER), ("0123456789", _DIGIT), (" \t\r", _BLANK), ("\n", _NEWLINE), (".,;:'\"-()", _STOP), ("!?", _MARK), ("|", _BAR)):
        table[[ord(c) for c in chars]] = kind
    return table


_CLASS = _classes()


def statistics(texts: list[str]) -> np.ndarray:
    """One row of STATS per text."""
    out = np.zeros((len(texts), len(STATS)), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds = np.bincount(_CLASS[np.minimum(codes, 128)], minlength=10)
        words, lines = text.split(), text.split("\n")
        n, w = len(codes), max(1, len(words))
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        most = max(text.count(c) for c in "#$%&*@~^") if kinds[_SYMBOL] else 0
        starts = np.count_nonzero(_CLASS[np.minimum(codes[np.flatnonzero(np.r_[True, (codes[:-1] == 32) | (codes[:-1] == 10)])], 128)] == _UPPER)
        out[i] = [n, len(words), sizes.sum() / w, n / len(lines), *(kinds / n), most / n, len(set(words)) / w, len(set(lines)) / len(lines), starts / w, np.count_nonzero(sizes <= 3) / w, np.count_nonzero(sizes >= 12) / w]
    return out


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.2, l2: float = 1.0, least: float = 2.0) -> dict:
    """Boosted trees for the logistic loss, as arrays: feature, cut and the value at each leaf.

    Every tree is complete: node i has the children 2i+1 and 2i+2; a node that isn't split sends all rows left.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((n_trees, inner), np.int32), np.full((n_trees, inner), np.inf, np.float32), np.zeros((n_trees, inner + 1))
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    bias = float(np.log(share / (1 - share)))
    z = np.full(len(y), bias)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            local = node - base
            best = np.zeros(width)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                k = len(c) + 1
                at = local * k + binned[:, j]
                gs = np.bincount(at, g, width * k).reshape(width, k).cumsum(1)
                hs = np.bincount(at, h, width * k).reshape(width, k).cumsum(1)
                left_g, left_h, all_g, all_h = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
                gain[(left_h < least) | (all_h - left_h < least)] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best + 1e-9
                best[better] = value[better]
                feature[t, base : base + width][better] = j
                cut[t, base : base + width][better] = c[top[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        z += leaf[t][at]
    return {"feature": feature, "cut": cut, "leaf": leaf, "bias": bias, "depth": depth}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    z, rows = np.full(len(x), model["bias"]), np.arange(len(x))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        z += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-z))


def _stats(batches):
    for batch in small_batches(batches):
        x = statistics([t or "" for t in batch.column(1).to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["label", *STATS])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 6000, **trees) -> dict:
    sample = training_rows(docs, labels, label, per_class).select("label", "text")  # 2 * per_class rows at most come to the driver
    got = sample.mapInArrow(_stats, "label int, " + ", ".join(f"{s} float" for s in STATS)).toPandas()
    got = got.sort_values(["label", *STATS], kind="stable")  # the same trees however the rows arrive
    x, y = got[STATS].to_numpy(np.float32), got["label"].to_numpy(float)
    if len(set(y)) < 2:
        return {"feature": [], "cut": [], "leaf": [], "bias": 30.0 * (2 * y[0] - 1) if len(y) else 0.0, "depth": 0}
    return fit_trees(x, y, **trees)


def _scores(model):
    def run(batches):
        for batch in small_batches(batches):
            p = predict(model.value, statistics([t or "" for t in batch.column(1).to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every row; score is between 0 and 1, higher for the likelier label 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scores(shared), "doc_id long, score double")


def _accepted(model, text_at: int, threshold: float):
    def run(batches):
        for batch in small_batches(batches):
            p = predict(model.value, statistics([t or "" for t in batch.column(text_at).to_pylist()]))
            yield batch.filter(pa.array(p >= threshold))

    return run


def accepted(docs: DataFrame, model: dict, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_accepted(shared, docs.columns.index(text_col), threshold), docs.schema)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = score(docs, train(docs, labels, **fit))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
