"""Operator 2: Naive Bayes support vectors (Wang and Manning, 2012) for quality.

Indicators of hashed word 1- and 2-grams and character 3-grams are scaled by the
class log-count ratio; a linear hinge-loss model over them is fitted by dual
coordinate descent (Hsieh et al., 2008).  A fifth of the training rows is kept
from the fit and sets the slope and intercept that turn margins into scores.

The fit uses at most TRAIN_ROWS labelled rows; scoring reads every whole text.
Defined results: null or empty text has no indicators and gets the score of the
bias alone; several labels of a document each count; without labels of both
classes every score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TRAIN_ROWS = 12_000
BITS = 16
WIDTH = 3 << BITS  # word 1-grams, word 2-grams, character 3-grams
CHUNK = 1 << 20
#: Rows of indicators held at a time.
ROWS = 256
#: Share of the sample that label 1 may take.  Chosen, like the ratio, by accuracy on
#: rows of the fitting folds that the fit left out.
POSITIVE = 0.65


def indicators(raw: pa.Array) -> np.ndarray:
    """A row a text, a column a feature: does the text have it?"""
    n = len(raw)
    has = np.zeros((n, WIDTH), bool)
    at = has.reshape(-1)
    w = C.Words(raw, lower=True)
    shift = np.uint64(64 - BITS)
    row = w.row_of()
    at[row * WIDTH + (w.hash >> shift).astype(np.int64)] = True
    if len(w.hash) > 1:
        pair = C.sequence_hash(w.hash, 2)
        same = row[1:] == row[:-1]
        at[row[:-1][same] * WIDTH + (1 << BITS) + (pair[same] >> shift).astype(np.int64)] = True
    data = w.data
    if len(data) > 2:
        x = data.astype(np.uint64)
        gram = C.mix(x[:-2] | x[1:-1] << np.uint64(8) | x[2:] << np.uint64(16))
        of = np.repeat(np.arange(n), np.diff(w.rows))
        same = of[2:] == of[:-2]
        at[of[:-2][same] * WIDTH + (2 << BITS) + (gram[same] >> shift).astype(np.int64)] = True
    return has


def sliced(raw: pa.Array) -> Iterator[np.ndarray]:
    """Indicators of at most ROWS texts at a time."""
    for at in range(0, len(raw), ROWS):
        yield indicators(raw.slice(at, ROWS))


def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, y, f): the feature columns of labelled texts."""
    for rows, raw in C.chunks(batches, limit=CHUNK):
        found = [np.flatnonzero(h).astype(np.int32) for has in sliced(raw) for h in has]
        yield pa.record_batch({"doc_id": rows.column(0), "y": rows.column(2), "f": pa.array(found, pa.list_(pa.int32()))})


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of (p / |p|) / (q / |q|), where p and q count the texts of either class that
    have a feature, smoothed by alpha, and |.| is their sum over all features."""
    p, q = np.full(WIDTH, alpha), np.full(WIDTH, alpha)
    for f, label in zip(rows, y, strict=True):
        (p if label else q)[f] += 1
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, y: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + cost * sum hinge, over rows of indicator
    columns scaled by the ratio and to unit length."""
    sign = np.where(y == 1, 1.0, -1.0)
    values = [(v := ratio[f]) / max(1e-12, np.sqrt((v * v).sum() + 1)) for f in rows]
    bias_value = [1 / max(1e-12, np.sqrt((ratio[f] ** 2).sum() + 1)) for f in rows]
    square = np.array([(v * v).sum() + b * b for v, b in zip(values, bias_value, strict=True)])
    share = y.mean()
    cap = cost * np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    a, w, bias = np.zeros(len(rows)), np.zeros(WIDTH), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            g = sign[i] * (w[rows[i]] @ values[i] + bias * bias_value[i]) - 1
            new = min(max(a[i] - g / square[i], 0.0), cap[i])
            if new != a[i]:
                step = (new - a[i]) * sign[i]
                w[rows[i]] += step * values[i]
                bias += step * bias_value[i]
                worst = max(worst, abs(step))
                a[i] = new
        if worst < 1e-3:
            break
    return w, bias


def margins(has: np.ndarray, weight: np.ndarray, ratio: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(has))
    for i in range(len(has)):
        f = np.flatnonzero(has[i])
        v = ratio[f]
        out[i] = (v @ weight[f] + bias) / np.sqrt((v * v).sum() + 1)
    return out


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 4, held: int = 2, most: int = TRAIN_ROWS) -> dict:
    sample = C.labelled_sample(docs, labels, label, modulus, held, most, POSITIVE).mapInArrow(featurise, "doc_id long, y int, f array<int>").toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    y = sample["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return {"share": float(y.mean()) if len(y) else 0.5}
    rows = [np.asarray(f.values) for f in sample["f"]]
    check = np.arange(len(y)) % 5 == 4
    if len(set(y[check])) < 2 or len(set(y[~check])) < 2:
        check[:] = False
    train = [r for r, c in zip(rows, check, strict=True) if not c]
    ratio = log_count_ratio(train, y[~check])
    weight, bias = dual_coordinate_descent(train, ratio, y[~check])
    on = check if check.any() else ~check
    m = np.array([(ratio[f] @ weight[f] + bias) / np.sqrt((ratio[f] ** 2).sum() + 1) for f, c in zip(rows, on, strict=True) if c])
    a, b = C.platt(m, y[on], C.class_weights(labels, label, modulus, held, y)[on])
    return {"weight": weight.astype(np.float32), "ratio": ratio.astype(np.float32), "bias": bias, "a": a, "b": b}


def score(docs: DataFrame, model: dict, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for rows, raw in C.chunks(batches, limit=CHUNK):
            if "share" in m:
                s = np.full(len(raw), m["share"])
            else:
                parts = [margins(has, m["weight"], m["ratio"], m["bias"]) for has in sliced(raw)]
                s = C.logistic(m["a"] * np.concatenate(parts) + m["b"])
            yield pa.record_batch({"doc_id": rows.column(0), "score": s, "predicted": (s >= threshold).astype(np.int32)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (C.fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
