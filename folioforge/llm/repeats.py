"""What the two repeated-passage operators share: which windows can repeat.

A window is `width` consecutive symbols (bytes or words) of one text.  Each has an
anchor: among its grams of `gram` symbols the one of smallest hash, the rightmost
of equals.  Equal windows have equal anchors at equal places, so a window can only
repeat if its anchor does.  Consecutive windows with one anchor are a unit; about
one symbol in (width - gram + 2) / 2 begins one.

A count-min sketch over the anchors (two rows of saturating counters, summed from
sketches of the partitions) then tells the anchors that may occur twice; it
overestimates, so none is lost.  Its size follows the counted bytes of the input,
eight counters or more an anchor in either row, from 2**LEAST_BITS to 2**MOST_BITS:
up to 7e7 anchors (11 GB of text for op3, 4 GB for op6) one unique anchor in seventy
passes for nothing, at 2e8 anchors one in twelve; beyond that results stay exact, but
less and less is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

LEAST_BITS, MOST_BITS = 20, 29
BLOCK_BITS = 16
#: Estimated number of different units of an anchor (counted by partition) from which
#: each of its windows is a unit of its own.
HOT = 50_000


@dataclass
class Units:
    """Units of a chunk: first window, number of windows, row, place and hash of
    the anchor, hash of all the unit's symbols."""

    start: np.ndarray
    count: np.ndarray
    row: np.ndarray
    place: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray

    def take(self, keep: np.ndarray) -> Units:
        return Units(**{f: v[keep] for f, v in vars(self).items()})

    def windows(self) -> np.ndarray:
        """The windows of all units, in turn."""
        return np.repeat(self.start - np.cumsum(self.count) + self.count, self.count) + np.arange(self.count.sum())

    def singly(self, rolling: Rolling, width: int) -> Units:
        """Each window as a unit of its own, under its own hash."""
        start = self.windows()
        value = rolling.spans(start, width)
        return Units(start, np.ones(len(start), np.int64), np.repeat(self.row, self.count), np.repeat(self.place, self.count), value, value)

    def plus(self, other: Units) -> Units:
        return Units(**{f: np.concatenate([v, getattr(other, f)]) for f, v in vars(self).items()})


class Rolling:
    """Hashes of spans of a symbol sequence, from its prefix sums."""

    def __init__(self, symbols: np.ndarray, base: int = C._BASE):
        self.inverse = pow(base, -1, 1 << 64)
        self.total = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * C.powers(base, len(symbols)), out=self.total[1:])

    def spans(self, start: np.ndarray | slice, width: int) -> np.ndarray:
        if isinstance(start, slice):
            n = len(self.total) - width
            return C.mix((self.total[width:] - self.total[:n]) * C.powers(self.inverse, n))
        return C.mix((self.total[start + width] - self.total[start]) * C.powers(self.inverse, len(self.total))[start])


def units(rolling: Rolling, rows: np.ndarray, width: int, gram: int) -> Units:
    """rows: the n+1 offsets of the texts in the symbols."""
    n = len(rolling.total) - 1
    none = np.zeros(0, np.int64)
    if n < width:
        return Units(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    bits = np.uint64(int(n).bit_length())
    grams = rolling.spans(slice(None), gram)
    last = np.uint64(len(grams) - 1)
    # the place makes keys unique: the low one of a window tells its anchor
    low = grams >> bits << bits
    low |= last - np.arange(len(grams), dtype=np.uint64)
    step, span = 1, width - gram + 1
    while step * 2 <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    windows = n - width + 1
    low = np.minimum(low[:windows], low[span - step : span - step + windows])
    full = np.flatnonzero(np.diff(rows) >= width)
    edge = np.zeros(windows + 1, np.int8)
    edge[rows[full]] += 1
    np.add.at(edge, rows[full + 1] - width + 1, -1)
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    opens = inside.copy()
    opens[1:] &= low[1:] != low[:-1]
    opens[rows[full]] = True
    start = np.flatnonzero(opens)
    place = (last - (low[start] & ((np.uint64(1) << bits) - np.uint64(1)))).astype(np.int64)
    del low
    count = np.add.reduceat(inside, start, dtype=np.int64) if len(start) else none
    end = start + count + width - 1
    whole = C.mix((rolling.total[end] - rolling.total[start]) * C.powers(rolling.inverse, len(rolling.total))[start] + count.astype(np.uint64))
    return Units(start, count, np.searchsorted(rows, start, side="right") - 1, place, grams[place], whole)


def _cells(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(C.mix(anchor + np.uint64(salt)) >> np.uint64(64 - bits)).astype(np.int64) for salt in (0x51ED270B, 0x2545F491)]


class Sketch:
    """The merged counters, a row each: a bitmap of those of two occurrences or
    more, and the few of HOT different units or more."""

    def __init__(self, bits: int):
        self.bits = bits
        self.two = [np.zeros((1 << bits) // 8, np.uint8) for _ in range(2)]
        self.hot = [np.zeros(0, np.int64) for _ in range(2)]

    def repeated(self, anchor: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchor), bool)
        for table, cell in zip(self.two, _cells(anchor, self.bits), strict=True):
            out &= (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return out

    def crowded(self, anchor: np.ndarray) -> np.ndarray:
        out = np.ones(len(anchor), bool)
        if not all(map(len, self.hot)):
            return ~out
        for hot, cell in zip(self.hot, _cells(anchor, self.bits), strict=True):
            out &= hot[np.minimum(np.searchsorted(hot, cell), len(hot) - 1)] == cell
        return out


def sketch_bits(docs: DataFrame, step: float) -> int:
    """Counters for one anchor in `step` bytes: eight to sixteen for each of them."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(np.clip(np.ceil(np.log2(max(1, 8 * total / step))), LEAST_BITS, MOST_BITS))


def sketch(docs: DataFrame, chunk_units: Callable, limit: int, bits: int, hot: int = HOT) -> Sketch:
    """chunk_units: Units of a chunk's raw texts.  The driver receives the merged
    bitmaps, 2 ** (bits - 1) bytes at most."""
    block = min(bits, BLOCK_BITS)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            anchor = np.concatenate([a for a, _ in held])
            _, different = np.unique(np.concatenate([w for _, w in held]), return_index=True)
            held.clear()
            for r, cell in enumerate(_cells(anchor, bits)):
                some, n = np.unique(cell[different], return_counts=True)
                cell, total = np.unique(cell, return_counts=True)
                edge = np.flatnonzero(np.diff(cell >> block, prepend=-1))
                low = (cell & ((1 << block) - 1)).astype(np.uint16)
                cut = [*edge.tolist(), len(cell)]
                data = [b"".join(np.minimum(x[a:b], 65_535).astype(np.uint16).tobytes() for x in (low, total, n)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.record_batch({"line": pa.array(np.full(len(data), r), pa.int32()), "block": pa.array(cell[edge] >> block, pa.int32()), "data": pa.array(data, pa.binary())})

        for _, raw in C.chunks(batches, limit=limit):
            unit = chunk_units(raw)
            held.append((unit.anchor, unit.whole))
            size += len(unit.anchor)
            if size > 1_000_000:
                yield from out()
                size = 0
        if size:
            yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, different = None, np.zeros(1 << block, np.int64), np.zeros(1 << block, np.int64)

        def out() -> pa.RecordBatch:
            return pa.record_batch({"line": pa.array([at[0]], pa.int32()), "block": pa.array([at[1]], pa.int32()), "two": [np.packbits(total >= 2).tobytes()], "hot": [np.flatnonzero(different >= hot).astype(np.int32).tobytes()]})

        for batch in batches:
            for line, number, data in zip(*(batch.column(c).to_pylist() for c in ("line", "block", "data")), strict=True):
                if (line, number) != at:
                    if at:
                        yield out()
                    at = (line, number)
                    total[:] = different[:] = 0
                cell, n, m = np.frombuffer(data, np.uint16).reshape(3, -1)
                total[cell] += n
                different[cell] += m
        if at:
            yield out()

    merged = docs.select("text").mapInArrow(part, "line int, block int, data binary").repartition(C.partitions(docs.sparkSession), "line", "block").sortWithinPartitions("line", "block").mapInArrow(merge, "line int, block int, two binary, hot binary")
    got, step = Sketch(bits), (1 << block) // 8
    for r in merged.toArrow().to_pylist():
        got.two[r["line"]][r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["two"], np.uint8)
        got.hot[r["line"]] = np.append(got.hot[r["line"]], (r["block"] << block) + np.frombuffer(r["hot"], np.int32).astype(np.int64))
    got.hot = [np.sort(h) for h in got.hot]
    return got


def keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """documents' (doc_id, text) and further columns beside k, which tells rows
    apart unless id and text are equal; those have equal repeats."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *carry).withColumn("k", F.xxhash64("doc_id", "text"))


def occurrences(k: np.ndarray, at: np.ndarray, group: np.ndarray, groups: int) -> list[bytes]:
    """For each group its (k, at) occurrences, packed as 12 bytes each; group is
    sorted."""
    packed = np.empty(len(k), np.dtype([("k", "<i8"), ("at", "<i4")]))
    packed["k"], packed["at"] = k, at
    data, edge = packed.tobytes(), np.searchsorted(group, np.arange(groups + 1)) * 12
    return [data[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def spread(occ: list[bytes], first: list[np.ndarray], last: list[np.ndarray], width: int) -> pa.RecordBatch:
    """(k, a, b): for each occurrence of each unit, the covered spans of symbols,
    from its repeated runs of windows first[i]..last[i]."""
    size = np.fromiter((len(o) // 12 for o in occ), np.int64, len(occ))
    runs = np.fromiter((len(f) for f in first), np.int64, len(occ))
    got = np.frombuffer(b"".join(occ), np.dtype([("k", "<i8"), ("at", "<i4")]))
    unit = np.repeat(np.arange(len(occ)), size)
    times = runs[unit]
    which = np.repeat(np.arange(len(got)), times)
    begin = np.cumsum(runs) - runs
    run = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[unit], times)
    flat_first = np.concatenate(first) if len(first) else np.zeros(0, np.int64)
    flat_last = np.concatenate(last) if len(last) else np.zeros(0, np.int64)
    at = got["at"][which].astype(np.int64)
    return pa.record_batch({"k": pa.array(got["k"][which]), "a": pa.array((at + flat_first[run]).astype(np.int32)), "b": pa.array((at + flat_last[run] + width).astype(np.int32))})


def runs_of(flag: np.ndarray, edge: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Maximal runs of set flags within each piece edge[i]..edge[i+1], as first
    and last places in the piece."""
    first, last = [], []
    padded = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if flag[a:b].all():
            first.append(np.array([0]))
            last.append(np.array([b - a - 1]))
            continue
        d = padded[a : b + 1].copy()
        d[0], d[-1] = int(flag[a]), -int(flag[b - 1])
        first.append(np.flatnonzero(d == 1))
        last.append(np.flatnonzero(d == -1) - 1)
    return first, last


def covered(*rows: DataFrame) -> DataFrame:
    """(k, spans): all (kind, a, b) of a text, gathered; a text's own, so bounded by
    it.  kind: which of the tables `rows` a span is from."""
    tagged = [r.select("k", F.lit(i).alias("kind"), "a", "b") for i, r in enumerate(rows)]
    both = tagged[0]
    for more in tagged[1:]:
        both = both.unionByName(more)
    return both.groupBy("k").agg(F.collect_list(F.struct("kind", "a", "b")).alias("spans"))


def union(spans: pa.ListArray, kind: int, first: np.ndarray) -> np.ndarray:
    """Which symbols of a chunk of texts do the spans of a kind cover?  first: the
    n+1 offsets of the texts in the symbols."""
    many = pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False)
    flat = spans.flatten()
    of, a, b = (flat.field(f).to_numpy(zero_copy_only=False) for f in ("kind", "a", "b"))
    begin = np.repeat(first[:-1], many)
    use = of == kind
    step = np.zeros(first[-1] + 1, np.int32)
    np.add.at(step, begin[use] + a[use], 1)
    np.add.at(step, begin[use] + b[use], -1)
    return np.cumsum(step[:-1]) > 0
