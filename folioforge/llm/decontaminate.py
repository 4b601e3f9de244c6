"""Operator 10: benchmark decontamination by n-gram seeds and local alignment.

Words are runs of letters and digits, ASCII case left out.  Every n-gram of a test
item is a seed, so an edited or partial copy is found by whichever of them it still
holds.  Each passage around a seed with enough of the item's words to reach the
threshold is aligned with the item by Smith-Waterman over words (match 2, mismatch
-1, gap -1).  The score is the best alignment's over that of the whole item with
itself; pairs of THRESHOLD or more are reported.  A copy that shares no N successive
words with its item is no candidate.

Items come to the tasks by broadcast in blocks of BLOCK_BYTES text at most, each
block against all documents.  Defined results: null or empty texts and items, and
items without an id, match nothing; items of fewer than N words are one gram; an
item that repeats an id counts with its best score; rows that repeat a doc_id are
looked at each, and reported once with the best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

N = 3
THRESHOLD = 0.5
BLOCK_BYTES = 16 << 20
LIMIT = 2 << 20
MATCH, MISMATCH, GAP = 2, 1, 1
_FILTER = 20
_HITS = 1_000_000
_CELLS = 4_000_000


def grams(w: C.Words, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the n-grams within rows."""
    if len(w.hash) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, row = C.sequence_hash(w.hash, n), w.row_of()
    at = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])
    return at, h[at]


class Items:
    """Test items: words, and their grams in order of hash."""

    def __init__(self, ids: list, texts: pa.Array):
        w = C.Words(texts, lower=True, gaps=C.PUNCTUATION)
        self.ids, self.count, self.first, self.hash = ids, w.count, w.first, w.hash
        at, value = grams(w)
        row = w.row_of()
        # shorter items: all their words as a gram of another length
        self.short = {n: {} for n in range(1, N)}
        for i in np.flatnonzero((w.count > 0) & (w.count < N)):
            n = int(w.count[i])
            self.short[n].setdefault(int(grams_of(w.hash[w.first[i] : w.first[i + 1]], n)[0]), []).append(int(i))
        order = np.argsort(value, kind="stable")
        at, self.gram = at[order], value[order]
        self.item = row[at]
        self.offset = at - w.first[self.item]
        self.values = np.unique(value)
        self.table = np.zeros(1 << _FILTER, bool)
        self.table[(self.values >> np.uint64(64 - _FILTER)).astype(np.int64)] = True
        # the (item, word) pairs, with some false hits
        self.bits = max(16, (8 * len(w.hash)).bit_length())
        self.known = np.zeros(1 << self.bits, bool)
        self.known[self.cell(row, w.hash)] = True

    def cell(self, item: np.ndarray, word: np.ndarray) -> np.ndarray:
        return (C.mix(word + C.mix(item.astype(np.uint64))) >> np.uint64(64 - self.bits)).astype(np.int64)

    def enough(self, w: C.Words, item: np.ndarray, lo: np.ndarray, hi: np.ndarray, threshold: float) -> np.ndarray:
        """Whether so many words of the passages are the item's that the score can
        be the threshold: it is at most their share of the item's length."""
        out, size = np.zeros(len(item), bool), hi - lo
        end = np.cumsum(size)
        at = 0
        while at < len(item):
            done = end[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(end, done + _CELLS, side="right")))
            many, start = size[at:to], end[at:to] - size[at:to] - done
            where = np.repeat(lo[at:to] - start, many) + np.arange(many.sum())
            there = self.known[self.cell(np.repeat(item[at:to], many), w.hash[where])]
            out[at:to] = np.add.reduceat(there, start, dtype=np.int64) >= threshold * self.count[item[at:to]] - 1e-9
            at = to
        return out

    def hits(self, h: np.ndarray) -> np.ndarray:
        """Places of the grams that are among the values."""
        at = np.flatnonzero(self.table[(h >> np.uint64(64 - _FILTER)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.values, h[at]), max(0, len(self.values) - 1))
        return at[self.values[k] == h[at]] if len(self.values) else at[:0]


def grams_of(h: np.ndarray, n: int) -> np.ndarray:
    return C.sequence_hash(h, n) if n > 1 else C.mix(h)


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row pair of word codes, and its last word in
    the passage; item codes 0 and passage codes 1 are padding and match nothing."""
    n, width = passage.shape
    ramp = np.arange(width, dtype=np.int32) * GAP
    before = np.zeros((n, width), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for i in range(item.shape[1]):
        step = np.where(item[:, i, None] == passage, MATCH, -MISMATCH).astype(np.int32)
        now = step
        now[:, 1:] += before[:, :-1]
        now = np.maximum(np.maximum(now, before - GAP), 0)
        # gaps in the item's row: the best earlier cell less its distance
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        top = now.argmax(axis=1)
        value = now[np.arange(n), top]
        better = value > best
        best[better], end[better] = value[better], top[better]
        before = now
    return best, end


def _around(w: C.Words, items: Items, at: np.ndarray, first: np.ndarray, many: np.ndarray, threshold: float) -> np.ndarray:
    """Rows (row, item, from word, to word) of the seeds at these words; first, many:
    where the gram stands among the items' grams."""
    seed = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
    at = np.repeat(at, many)
    item = items.item[seed]
    row = np.searchsorted(w.first, at, side="right") - 1
    size = items.count[item]
    slack = size // 4 + 8
    # passages that begin within a stretch of 8 words are one
    begin = (at - items.offset[seed]) // 8 * 8
    lo, hi = np.maximum(w.first[row], begin - slack), np.minimum(w.first[row + 1], begin + 8 + size + slack)
    found = np.unique(np.stack([row, item, lo, hi], axis=1), axis=0)
    return found[items.enough(w, *found[:, 1:].T, threshold)]


def _candidates(w: C.Words, items: Items, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, from word, to word) of the passages around seeds that can reach
    the threshold."""
    at, h = grams(w)
    hit = items.hits(h)
    at, h = at[hit], h[hit]
    a, b = np.searchsorted(items.gram, h), np.searchsorted(items.gram, h, side="right")
    end = np.cumsum(b - a)
    parts, done = [np.zeros((0, 4), np.int64)], 0
    while done < len(at):
        # of common grams only so many pairs at a time
        to = max(done + 1, int(np.searchsorted(end, (end[done - 1] if done else 0) + _HITS, side="right")))
        parts.append(_around(w, items, at[done:to], a[done:to], (b - a)[done:to], threshold))
        done = to
    row, item, lo, hi = np.concatenate(parts).T
    for n, known in items.short.items():
        if known and len(w.hash) >= n:
            value, rows = grams_of(w.hash, n), w.row_of()
            inside = rows[n - 1 :] == rows[: len(rows) - n + 1]
            some = np.flatnonzero(inside & np.isin(value, np.array(list(known), np.uint64)))
            pairs = [(rows[p], i, p, p + n) for p in some.tolist() for i in known[int(value[p])]]
            if pairs:
                x = np.array(pairs, np.int64)
                row, item, lo, hi = (np.concatenate(c) for c in zip((row, item, lo, hi), x.T, strict=True))
    found = np.unique(np.stack([row, item, lo, hi], axis=1), axis=0)
    return found[:, 0], found[:, 1], found[:, 2], found[:, 3]


def align(w: C.Words, items: Items, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, score, last word) of the passages around seeds that can reach the
    threshold."""
    row, item, lo, hi = _candidates(w, items, threshold)
    score, last = np.zeros(len(row)), np.zeros(len(row), np.int64)
    order = np.argsort(items.count[item], kind="stable")  # like sizes together
    at = 0
    while at < len(order):
        use = order[at : at + 512]
        longest = int(items.count[item[order[min(at + 511, len(order) - 1)]]])
        use = use[: max(1, 4_000_000 // max(1, longest * longest))]
        at += len(use)
        span = np.arange((hi - lo)[use].max())
        where = lo[use, None] + span
        passage = np.where(where < hi[use, None], w.hash[np.minimum(where, len(w.hash) - 1)] | np.uint64(2), np.uint64(1))
        span = np.arange(items.count[item[use]].max())
        where = items.first[item[use], None] + span
        test = np.where(span < items.count[item[use], None], items.hash[np.minimum(where, len(items.hash) - 1)] | np.uint64(2), np.uint64(0))
        best, end = smith_waterman(test, passage)
        score[use] = best / (MATCH * items.count[item[use]])
        last[use] = lo[use] + end
    return row, item, score, last


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, k, item_id, score, last_word) of the documents that hold a copy of
    an item; k as in repeats.keyed."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = tests.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // block_bytes)
    keyed, out = R.keyed(docs), None
    for b in range(blocks):
        got = tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        items = Items(got["item_id"].to_pylist(), C.text_bytes(got["text"]))
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for rows, raw in C.chunks(batches, limit=LIMIT):
                w = C.Words(raw, lower=True, gaps=C.PUNCTUATION)
                row, item, score, last = align(w, sent.value, threshold)
                keep = score >= threshold
                row = row[keep]
                ids = np.array(sent.value.ids, np.int64)
                yield pa.record_batch({"doc_id": rows.column("doc_id").take(pa.array(row)), "k": rows.column("k").take(pa.array(row)), "item_id": pa.array(ids[item[keep]]), "score": pa.array(score[keep]), "last_word": pa.array(last[keep] - w.first[row])})

        part = keyed.mapInArrow(run, "doc_id long, k long, item_id long, score double, last_word long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "doc_id long, k long, item_id long, score double, last_word long")
    best = F.max(F.struct("score", F.col("last_word").alias("last_word"))).alias("best")
    return out.groupBy("doc_id", "k", "item_id").agg(best).select("doc_id", "k", "item_id", "best.score", "best.last_word")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))
