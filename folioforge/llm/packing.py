"""Operator 7: packing documents into sequences by a configuration linear program.

Only the histogram of piece lengths reaches the driver (at most `capacity` bins,
whatever the input).  There the configuration LP  min sum x_p  s.t. the patterns
cover every length's count  is solved by multiplicative weights: each round a
knapsack dynamic program prices patterns under the current weights (its table gives
the best one, and others of nearly its value), and lengths that they serve lose
weight.  The averaged solution is rounded, patterns of the largest values first,
within the counts that are there; what is left over goes through the program again
with its own histogram, until nothing is left or a pass no longer fills a sequence.
The last of the passes whose patterns, with the rest placed best-fit decreasing, make
the fewest sequences is where rounding stops: so LP patterns carry all that they
can carry at no more sequences than best fit alone.
Patterns with multiplicities are then matched with
ranked pieces by an interval table.

Defined results: null or empty text is the end id alone, one piece; longer
documents are cut into capacity-sized pieces, the last may be shorter; equal
lengths are taken in (doc_id, piece) order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .tokens import END_ID, encoder, vocabulary_path

CAPACITY = 4096
#: Pricing rounds a program; the part of a length's count, and of all tokens, that
#: the patterns of a round may take; the part of the best value that they must reach.
ROUNDS = 8
SHARE = 0.25
NEAR = 0.998
EPSILON = 1.4


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, end_id)
        for rows, raw in C.chunks(batches):
            ids, offsets = enc.encode(raw)
            size = np.diff(offsets)
            many = -(-size // capacity)
            doc = np.repeat(np.arange(len(size)), many)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            start = piece * capacity
            length = np.minimum(capacity, size[doc] - start)
            at = offsets[doc] + start
            crc = np.fromiter((C.ids_crc32(ids[a : a + n]) for a, n in zip(at, length, strict=True)), np.int64, len(doc))
            yield pa.record_batch({"doc_id": rows.column(0).take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": crc})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _values(value: np.ndarray, count: np.ndarray, capacity: int) -> np.ndarray:
    """Most value within each room up to the capacity: a knapsack that takes a length
    as often as it is there (or up to the next 2**k - 1)."""
    best = np.zeros(capacity + 1)
    for l in np.flatnonzero(value > 0).tolist():
        most, times = min(int(count[l]), capacity // l), 1
        while most > 0 and times * l <= capacity:
            np.maximum(best[times * l :], best[: capacity + 1 - times * l] + times * value[l], out=best[times * l :])
            most -= times
            times *= 2
    return best


def _price(value: np.ndarray, count: np.ndarray, capacity: int, volume: float) -> list[tuple[dict[int, int], int]]:
    """Patterns with copies, longest pieces first, of NEAR the best value or more, within the
    counts and (but for the first) a volume; value[0] unused."""
    best = _values(value, count, capacity)
    same = np.maximum.accumulate(np.where(np.diff(best, prepend=-1) > 0, np.arange(capacity + 1), 0))  # least room of a value
    left = count.copy()
    lengths = np.flatnonzero((value > 0) & (left > 0))[::-1]
    out: list[tuple[dict[int, int], int]] = []
    while volume > 0 and len(lengths):
        room, total, slack, pattern = int(same[capacity]), 0.0, (1 - NEAR) * best[capacity], {}
        while room > 0:
            fit = lengths[np.searchsorted(-lengths, -room) :]
            fit = fit[left[fit] > np.fromiter((pattern.get(l, 0) for l in fit.tolist()), np.int64, len(fit))] if pattern else fit
            if not len(fit):
                break
            loss = best[room] - best[room - fit] - value[fit]
            l = int(fit[np.argmax(loss <= slack)] if (loss <= slack).any() else fit[np.argmin(loss)])
            slack -= best[room] - best[room - l] - value[l]
            pattern[l] = pattern.get(l, 0) + 1
            total += value[l]
            room = int(same[room - l])
        if not pattern or out and total < NEAR * best[capacity]:
            break
        copies = min(int(left[l]) // k for l, k in pattern.items())
        out.append((pattern, copies))
        for l, k in pattern.items():
            left[l] -= k * copies
            volume -= k * copies * l
        lengths = lengths[left[lengths] > 0]
    return out


def solve_configuration_lp(count: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """Fractional patterns that cover no more than count[l] pieces of each length l,
    found by multiplicative weights over the lengths."""
    need = count.astype(float)
    there = need > 0
    share = np.where(there, np.arange(len(count)) * need, 0)
    weight = share / max(share.sum(), 1)
    covered = np.zeros(len(count))
    found: dict[tuple, float] = {}
    for _ in range(rounds):
        value = np.where(there, weight / np.maximum(need, 1), 0)
        for pattern, times in _price(value, np.ceil(need * SHARE).astype(np.int64), capacity, SHARE * share.sum()):
            key = tuple(sorted(pattern.items()))
            found[key] = found.get(key, 0) + times
            for l, k in pattern.items():
                gain = k * times / need[l]
                covered[l] += gain
                weight[l] *= np.exp(-EPSILON * gain)
        weight /= max(weight.sum(), 1e-300)
    most = max(covered.max(), 1e-9)
    return [(dict(p), x / most) for p, x in found.items()]


def passes(count: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], list[tuple[dict[int, int], int]]]:
    """Whole patterns (lengths with multiplicity, copies) that use every piece of the
    histogram exactly once: those of the programs, and those of the remainder."""
    left = count.astype(np.int64).copy()
    out: list[tuple[dict[int, int], int]] = []
    size = np.arange(len(left))
    ends = [(0, best_fit(left, capacity))]
    while left.any():
        solved = solve_configuration_lp(left, capacity)
        fill = [sum(l * k for l, k in p.items()) for p, _ in solved]
        before, most = int((left * size).sum()), max(fill)
        for f, (pattern, x) in sorted(zip(fill, solved, strict=True), key=lambda s: (-s[1][1], -s[0])):
            copies = min(max(1, int(x)), min(int(left[l]) // k for l, k in pattern.items()))
            if copies > 0 and f >= NEAR * most:
                out.append((pattern, copies))
                for l, k in pattern.items():
                    left[l] -= k * copies
        ends.append((len(out), best_fit(left, capacity)))
        if before - int((left * size).sum()) < capacity / 2:
            break
    total = np.concatenate([[0], np.cumsum([c for _, c in out])])
    at, rest = min(ends, key=lambda e: (int(total[e[0]]) + sum(c for _, c in e[1]), -e[0]))
    return out[:at], rest


def plan(count: np.ndarray, capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """passes(), put together."""
    solved, rest = passes(count, capacity)
    return solved + rest


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram: equal bins are held together with
    their multiplicity, so the work follows the number of lengths, not pieces."""
    bins: dict[int, list[list]] = {}  # room -> [pattern, copies]
    rooms = np.zeros(capacity + 1, bool)

    def put(room: int, pattern: dict[int, int], copies: int) -> None:
        bins.setdefault(room, []).append([pattern, copies])
        rooms[room] = True

    for l in np.flatnonzero(count)[::-1]:
        l, n = int(l), int(count[l])
        while n:
            fits = np.flatnonzero(rooms[l:])
            if len(fits):
                room = l + int(fits[0])
                pattern, copies = bins[room].pop()
                if not bins[room]:
                    rooms[room] = False
            else:
                each = min(capacity // l, n)
                room, pattern, copies = capacity, {}, n // each
            each = min(room // l, max(1, n // copies))
            take = min(copies, n // each)
            if take < copies:
                put(room, pattern, copies - take)
            put(room - each * l, pattern | {l: pattern.get(l, 0) + each}, take)
            n -= each * take
    return [(p, c) for many in bins.values() for p, c in many if c]


def intervals(patterns: list[tuple[dict[int, int], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each slot of each pattern: pieces of `length` ranked rank .. go to
    sequences sequence .. at `offset`."""
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for pattern, copies in patterns:
        offset = 0
        for l, k in sorted(pattern.items(), reverse=True):
            for _ in range(k):
                rows.append((l, rank[l], sequence, offset))
                rank[l] += copies
                offset += l
        sequence += copies
    got = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": got[:, 0], "rank": got[:, 1], "sequence": got[:, 2], "offset": got[:, 3]}


def pack(pieces_df: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to (doc_id, piece, start, length, ...).

    Ranks within a length come from a range sort by (length, doc_id, piece), so a
    length that a third of all pieces share spreads over many partitions; the
    driver gets a count per partition and length, at most capacity + partitions.
    """
    spark = pieces_df.sparkSession
    keys = ["length", "doc_id", "piece"]
    pieces_df = C.stored(pieces_df, "cut")  # the range sort reads it twice
    ordered = C.stored(pieces_df.repartitionByRange(C.partitions(spark), *keys, "ids_crc32").sortWithinPartitions(*keys, "ids_crc32").withColumn("part", F.spark_partition_id()), "pieces")
    C.forget(pieces_df)
    per = ordered.groupBy("part", "length").count().collect()
    count = np.zeros(capacity + 1, np.int64)
    base: dict[int, dict[int, int]] = {}
    for r in sorted(per, key=lambda r: r["part"]):
        base.setdefault(r["part"], {})[r["length"]] = int(count[r["length"]])
        count[r["length"]] += r["count"]
    where = spark.sparkContext.broadcast((intervals(plan(count, capacity), capacity), base, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, base, capacity = where.value
        scale = np.int64(1) << 44
        key = slots["length"] * scale + slots["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy()
            at = length * scale + batch.column("rank").to_numpy() + np.fromiter((base[p][n] for p, n in zip(batch.column("part").to_pylist(), length.tolist(), strict=True)), np.int64, len(length))
            k = np.searchsorted(key, at, side="right") - 1
            sequence = slots["sequence"][k] + at - key[k]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch([*(batch.column(n) for n in names), pa.array(sequence), pa.array(slots["offset"][k])], names=[*names, "sequence_id", "offset"])

    from pyspark.sql import Window

    local = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = ordered.withColumn("rank", F.row_number().over(local).cast("long") - 1)
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(C.table(spark, sf_dir, "documents"), vocabulary_path()))
