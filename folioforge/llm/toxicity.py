"""Operator 1: toxicity by a bidirectional gated recurrent network.

Each word enters as a learned word vector beside the mean of learned vectors of
its character 4-grams.  Two gated recurrent layers read windows of WINDOW words
in either direction, attention pools their states, and a logistic unit scores
the window.  Windows overlap by half and cover every whole text; a document's
score comes from its highest window.  Everything is numpy, training included:
each epoch scores all windows of the training documents, and learns from the
highest of each document (multiple-instance learning) by backpropagation.  A
fifth of the training rows is kept from it and sets the slope and intercept that
turn logits into scores.

The fit uses at most TRAIN_ROWS labelled rows.  Defined results: null or empty
text is one window without words; several labels of a document each count;
without labels of both classes every score is the share of label 1 (0.5 without
labels).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

TRAIN_ROWS = 4_000
WINDOW, STRIDE = 32, 16
WORDS, GRAMS = 1 << 12, 1 << 13
WORD_DIM, CHAR_DIM, HIDDEN, ATTEND = 12, 8, 8, 8
EPOCHS = 8
DECAY = 0.002  # of word and character vectors, a step
BATCH = 128
BLOCK = 4096


class Windows:
    """The words of a chunk of texts, distinct ones once, and the windows over them."""

    def __init__(self, raw: pa.Array):
        w = C.Words(raw, lower=True, gaps=C.PUNCTUATION)
        values, first, code = np.unique(w.hash, return_index=True, return_inverse=True)
        self.word = (values >> np.uint64(64 - 12)).astype(np.int64)
        self.gram, self.gram_at = self._grams(w, first)
        many = np.maximum(1, -(-(w.count - (WINDOW - STRIDE)) // STRIDE))
        self.doc = np.repeat(np.arange(len(w.count)), many)
        begin = (np.arange(len(self.doc)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
        self.at = w.first[self.doc] + begin
        self.length = np.minimum(WINDOW, w.count[self.doc] - begin)
        self.code = code.reshape(-1)
        self.docs = len(w.count)

    @staticmethod
    def _grams(w: C.Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed character 4-grams of the distinct words, edges marked."""
        a, n = w.starts[first], w.ends[first] - w.starts[first]
        at = np.concatenate([[0], np.cumsum(n)])
        k = np.arange(at[-1]) - np.repeat(at[:-1], n)
        data = w.data | np.where((w.data >= 65) & (w.data <= 90), 32, 0).astype(np.uint8)
        p = np.repeat(a, n) + k
        here = data[p].astype(np.uint64) if len(p) else np.zeros(0, np.uint64)
        edge = np.repeat(n, n) - 1
        left = np.where(k > 0, data[np.maximum(p - 1, 0)], 1).astype(np.uint64) if len(p) else here
        right = np.where(k < edge, data[np.minimum(p + 1, len(data) - 1)], 2).astype(np.uint64) if len(p) else here
        after = np.where(k + 1 < edge, data[np.minimum(p + 2, len(data) - 1)], 2).astype(np.uint64) if len(p) else here
        return (C.mix(left | here << np.uint64(8) | right << np.uint64(16) | after << np.uint64(24)) >> np.uint64(64 - 13)).astype(np.int64), at

    def index(self, rows: np.ndarray) -> np.ndarray:
        """Word codes of the windows; beyond a window's end, the code after the last."""
        k = np.arange(WINDOW)
        got = self.at[rows, None] + k
        inside = k < self.length[rows, None]
        pad = len(self.word)
        return np.where(inside, self.code[np.minimum(got, max(0, len(self.code) - 1))] if len(self.code) else pad, pad)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def new_model(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    draw = lambda *s, k=0.3: (rng.normal(0, k, s)).astype(np.float32)
    m = {"word": draw(WORDS, WORD_DIM, k=0.1), "gram": draw(GRAMS, CHAR_DIM, k=0.1), "attend": draw(2 * h, ATTEND), "query": draw(ATTEND), "out": draw(2 * h), "bias": np.zeros(1, np.float32)}
    for side in "fb":
        m |= {f"W{side}": draw(d, 3 * h), f"U{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
    return m


def word_inputs(m: dict, win: Windows) -> np.ndarray:
    """Input vectors of the distinct words, and a zero row for padding."""
    n = len(win.word)
    x = np.zeros((n + 1, WORD_DIM + CHAR_DIM), np.float32)
    if n:
        x[:n, :WORD_DIM] = m["word"][win.word]
        x[:n, WORD_DIM:] = np.add.reduceat(m["gram"][win.gram], win.gram_at[:-1]) / np.diff(win.gram_at)[:, None]
    return x


def _read(projected: np.ndarray, index: np.ndarray, keep: np.ndarray, u: np.ndarray, order: range, trace: list | None = None) -> np.ndarray:
    """States of one direction, (step, window, hidden)."""
    h3, h = u.shape[1], u.shape[0]
    state = np.zeros((len(index), h), np.float32)
    out = np.empty((WINDOW, len(index), h), np.float32)
    for t in order:
        x = projected[index[:, t]]
        s = state @ u
        gates = _sigmoid(x[:, : 2 * h] + s[:, : 2 * h])
        z, r = gates[:, :h], gates[:, h:]
        cand = np.tanh(x[:, 2 * h : h3] + r * s[:, 2 * h :])
        k = keep[:, t, None]
        new = state + k * z * (cand - state)
        if trace is not None:
            trace.append((t, state, s, z, r, cand, k))
        out[t] = state = new
    return out


def forward(m: dict, inputs: np.ndarray, index: np.ndarray, traces: tuple[list, list] | None = None):
    """Logits of the windows; with traces also what backpropagation needs."""
    keep = (index < len(inputs) - 1).astype(np.float32)
    f = _read(inputs @ m["Wf"] + m["cf"], index, keep, m["Uf"], range(WINDOW), traces and traces[0])
    b = _read(inputs @ m["Wb"] + m["cb"], index, keep, m["Ub"], range(WINDOW - 1, -1, -1), traces and traces[1])
    state = np.concatenate([f, b], axis=2)
    t = np.tanh(state.reshape(-1, 2 * HIDDEN) @ m["attend"]).reshape(WINDOW, len(index), ATTEND)
    e = t @ m["query"] + np.where(keep.T > 0, 0, -1e9).astype(np.float32)
    e = np.exp(e - e.max(axis=0))
    a = e / e.sum(axis=0)
    pooled = np.einsum("tn,tnh->nh", a, state)
    logit = pooled @ m["out"] + m["bias"][0]
    return logit if traces is None else (logit, state, t, a, pooled, keep)


def _back(d_state: np.ndarray, trace: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients by the projected inputs (step, window, 3h) and by u."""
    h = u.shape[0]
    dx = np.zeros((WINDOW, d_state.shape[1], 3 * h), np.float32)
    du, carry = np.zeros_like(u), np.zeros(d_state.shape[1:], np.float32)
    for t, state, s, z, r, cand, k in reversed(trace):
        d = (d_state[t] + carry) * 1
        dz = d * k * (cand - state) * z * (1 - z)
        dc = d * k * z * (1 - cand * cand)
        dr = dc * s[:, 2 * h :] * r * (1 - r)
        ds = np.concatenate([dz, dr, dc * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dc], axis=1)
        du += state.T @ ds
        carry = d * (1 - k * z) + ds @ u.T
    return dx, du


def gradients(m: dict, win: Windows, index: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted logistic loss."""
    inputs = word_inputs(m, win)
    traces: tuple[list, list] = ([], [])
    logit, state, t, a, pooled, keep = forward(m, inputs, index, traces)
    d_logit = ((C.logistic(logit) - y) * weight / len(y)).astype(np.float32)
    g = {"out": pooled.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
    d_pool = d_logit[:, None] * m["out"]
    d_a = np.einsum("nh,tnh->tn", d_pool, state)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    g["query"] = np.einsum("tn,tnk->k", d_e, t)
    d_t = d_e[:, :, None] * m["query"] * (1 - t * t)
    g["attend"] = state.reshape(-1, 2 * HIDDEN).T @ d_t.reshape(-1, ATTEND)
    d_state = a[:, :, None] * d_pool + (d_t.reshape(-1, ATTEND) @ m["attend"].T).reshape(state.shape)
    d_input = np.zeros_like(inputs)
    flat = index.T.reshape(-1)
    for side, part, trace in (("f", slice(None, HIDDEN), traces[0]), ("b", slice(HIDDEN, None), traces[1])):
        dx, g[f"U{side}"] = _back(d_state[:, :, part], trace, m[f"U{side}"])
        dx = dx.reshape(-1, 3 * HIDDEN)
        g[f"W{side}"], g[f"c{side}"] = inputs[flat].T @ dx, (dx * keep.T.reshape(-1, 1)).sum(axis=0)
        np.add.at(d_input, flat, dx @ m[f"W{side}"].T)
    used = np.unique(flat)
    used = used[used < len(win.word)]
    g["word"], g["gram"] = np.zeros_like(m["word"]), np.zeros_like(m["gram"])
    np.add.at(g["word"], win.word[used], d_input[used, :WORD_DIM])
    n = np.diff(win.gram_at)[used]
    which = np.repeat(win.gram_at[used], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    np.add.at(g["gram"], win.gram[which], np.repeat(d_input[used, WORD_DIM:] / n[:, None], n, axis=0))
    return g


def window_logits(m: dict, win: Windows) -> np.ndarray:
    inputs = word_inputs(m, win)
    return np.concatenate([forward(m, inputs, win.index(np.arange(at, min(at + BLOCK, len(win.doc))))) for at in range(0, len(win.doc), BLOCK)])


def highest(win: Windows, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's highest logit and its window."""
    order = np.lexsort((-logit, win.doc))
    first = order[np.searchsorted(win.doc[order], np.arange(win.docs))]
    return logit[first], first


def train(raw: pa.Array, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> dict:
    """Parameters of the network; y: the documents' labels."""
    m, win, rng = new_model(seed), Windows(raw), np.random.default_rng(seed)
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    begin = np.searchsorted(win.doc, np.arange(win.docs))
    many = np.bincount(win.doc, minlength=win.docs)
    step = 0
    for epoch in range(epochs):
        top = highest(win, window_logits(m, win))[1] if epoch else begin + rng.integers(0, many)
        # beside the highest window of each, a random one of the negatives
        rows = np.concatenate([top, (begin + rng.integers(0, many))[y == 0]])
        rng.shuffle(rows)
        for at in range(0, len(rows), BATCH):
            use = rows[at : at + BATCH]
            step += 1
            g = gradients(m, win, win.index(use), y[win.doc[use]], weight[win.doc[use]])
            rate = 0.01 * min(1, step / 20) * (0.3 if epoch >= epochs - 3 else 1)
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                if k in ("word", "gram"):
                    m[k] *= np.float32(1 - DECAY)
                m[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return m


def calibrate(m: dict, raw: pa.Array, y: np.ndarray, weight: np.ndarray) -> dict:
    win = Windows(raw)
    a, b = C.platt(highest(win, window_logits(m, win))[0].astype(float), y, weight)
    return m | {"a": a, "b": b}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0, most: int = TRAIN_ROWS) -> dict:
    sample = C.labelled_sample(docs, labels, label, modulus, held, most).toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending"), ("text", "ascending")])
    y = sample["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return {"share": float(y.mean()) if len(y) else 0.5}
    raw, weight = C.text_bytes(sample["text"]), C.class_weights(labels, label, modulus, held, y)
    check = np.arange(len(y)) % 5 == 4
    if min(np.bincount(y[check], minlength=2).min(), np.bincount(y[~check], minlength=2).min()) == 0:
        return calibrate(train(raw, y), raw, y, weight)
    m = train(raw.filter(pa.array(~check)), y[~check])
    return calibrate(m, raw.filter(pa.array(check)), y[check], weight[check])


def score(docs: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted, n_windows) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for rows, raw in C.chunks(batches):
            if "share" in m:
                s, n = np.full(len(raw), m["share"]), np.zeros(len(raw), np.int64)
            else:
                win = Windows(raw)
                s = C.logistic(m["a"] * highest(win, window_logits(m, win))[0].astype(float) + m["b"])
                n = np.bincount(win.doc, minlength=win.docs)
            yield pa.record_batch({"doc_id": rows.column(0), "score": s, "predicted": (s >= threshold).astype(np.int32), "n_windows": n})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int, n_windows long")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, C.table(spark, sf_dir, "labels")))
    return out.select("doc_id", (C.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_windows")
