"""Operator 6: repeated windows of words, behind a count-min prefilter.

First pass: every partition sketches the anchors of its windows, the sketches are
merged.  Second pass: windows whose anchor is estimated to occur at least twice go,
a unit a row, to the task of their anchor, where windows are grouped exactly (by
96-bit hashes of their words).  Equal units of a partition travel once, with their
occurrences.  Anchors estimated to occur HOT times or more are dealt by single
windows instead, which gather to a row a partition each.

Defined results: null or empty text has no words, removes nothing and keeps the
hash of nothing; rows that repeat a doc_id are texts of their own, and equal rows
repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R

WIDTH, GRAM = 35, 16
LIMIT = 2 << 20
_SECOND = 0xC2B2AE3D27D4EB4F | 1
_FINGER = np.dtype([("x", "<u8"), ("y", "<u4")])


def _chunk(raw: pa.Array, width: int, gram: int) -> tuple[C.Words, R.Rolling, R.Units]:
    words = C.Words(raw)
    rolling = R.Rolling(words.hash)
    return words, rolling, R.units(rolling, words.first, width, gram)


def repeated_windows(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, bits: int | None = None, hot: int = R.HOT) -> DataFrame:
    """(k, a, b): spans of words of text k (see repeats.keyed) that lie under
    repeated windows."""
    spark = docs.sparkSession
    bits = bits or R.sketch_bits(docs, 6 * (width - gram + 2) / 2)
    seen = spark.sparkContext.broadcast(R.sketch(docs, lambda raw: _chunk(raw, width, gram)[2], LIMIT, bits, hot))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in C.chunks(batches, limit=LIMIT):
            words, rolling, unit = _chunk(raw, width, gram)
            unit = unit.take(seen.value.repeated(unit.anchor))
            if not len(unit.start):
                continue
            alone = seen.value.crowded(unit.anchor)
            if alone.any():
                unit = unit.take(~alone).plus(unit.take(alone).singly(rolling, width))
            second = R.Rolling(words.hash, _SECOND)
            at = unit.windows()
            finger = np.empty(len(at), _FINGER)
            finger["x"], finger["y"] = rolling.spans(at, width), second.spans(at, width) >> np.uint64(32)
            # equal units of the chunk travel once
            _, first, group = np.unique(unit.whole, return_index=True, return_inverse=True)
            order = np.argsort(group, kind="stable")
            k = rows.column("k").to_numpy()[unit.row[order]]
            place = unit.start[order] - words.first[unit.row[order]]
            occ = R.occurrences(k, place, group[order], len(first))
            edge = np.concatenate([[0], np.cumsum(unit.count)]) * _FINGER.itemsize
            data = finger.tobytes()
            yield pa.record_batch({"anchor": pa.array(unit.anchor[first].view(np.int64)), "finger": pa.array([data[edge[i] : edge[i + 1]] for i in first.tolist()], pa.binary()), "occ": pa.array(occ, pa.binary())})

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        finger, occ = rows["finger"].to_pylist(), rows["occ"].to_pylist()
        size = np.fromiter((len(f) // _FINGER.itemsize for f in finger), np.int64, len(finger))
        times = np.repeat(np.fromiter((len(o) // 12 for o in occ), np.int64, len(occ)), size)
        _, group = np.unique(np.frombuffer(b"".join(finger), _FINGER), return_inverse=True)
        flag = np.bincount(group, times)[group] >= 2
        edge = np.concatenate([[0], np.cumsum(size)])
        use = np.flatnonzero(np.add.reduceat(flag, edge[:-1]) > 0)
        if len(use):
            first, last = R.runs_of(flag, edge)
            yield R.spread([occ[i] for i in use], [first[i] for i in use], [last[i] for i in use], width)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 20_000:
                continue
            rows = pa.Table.from_batches(held)
            anchor = rows["anchor"].to_numpy()
            n = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
            if n:
                yield from settle(rows.slice(0, n))
            held = rows.slice(n).combine_chunks().to_batches()
            size = rows.num_rows - n
        if held:
            yield from settle(pa.Table.from_batches(held))

    dealt = R.keyed(docs).select("k", "text").mapInArrow(emit, "anchor long, finger binary, occ binary").repartition(C.partitions(spark), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(group, "k long, a int, b int")


def remove_windows(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every document; kept is
    the remaining words joined by spaces."""
    spans = R.covered(repeated_windows(docs, width, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in C.chunks(batches):
            words = C.Words(raw)
            data = words.data.tobytes()
            out: list[list] = [[], [], [], []]
            lost = R.union(rows.column("spans"), 0, words.first)
            for i in range(rows.num_rows):
                a, b = words.first[i], words.first[i + 1]
                gone = lost[a:b]
                keep = np.flatnonzero(~gone) + a
                kept = b" ".join([data[x:y] for x, y in zip(words.starts[keep].tolist(), words.ends[keep].tolist(), strict=True)])
                for column, value in zip(out, (b - a, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                    column.append(value)
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "n_words": pa.array(out[0], pa.int64()), "n_removed": pa.array(out[1], pa.int64()), "kept_sha256": out[2], "kept": pa.array(out[3], pa.string())})

    joined = R.keyed(docs).join(spans, "k", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_windows(C.table(spark, sf_dir, "documents")).drop("kept")
