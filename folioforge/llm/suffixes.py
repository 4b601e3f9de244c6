"""Operator 3: repeated strings by a logarithmic family of suffix arrays.

Strings are WIDTH consecutive symbols: bytes, or words (as 40-bit hashes, WORD
bytes a symbol).  A string can only repeat if its anchor does (see repeats).  Texts
around anchors that may occur twice go to the task of their anchor; equal ones of
a chunk travel once.  In a task they arrive in batches.  The suffixes that begin at
a batch's anchors are sorted into a suffix array; it is scanned, merging, against
itself and against each existing level; where suffixes share an anchor, their
common length to the right and that of the symbols before the anchor tell which
strings they share.  Then the array becomes a level; equal-sized
levels merge geometrically.  Anchors arrive in order, so levels keep only the
anchor that is not finished; a task never holds more than the different texts
around one anchor.  Anchors with repeats.HOT different texts or more are dealt by
single strings instead, matched by 128-bit fingerprints.

Defined results: null or empty text has no bytes, removes nothing and keeps the
hash of nothing; rows that repeat a doc_id are texts of their own, and equal rows
repeat each other.  Words are `[^\\x20\\x09-\\x0D]+`, unchanged; a removed word goes
with the space behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common as C
from . import repeats as R

WIDTH, GRAM = 400, 64
#: Passages of over 50 words.
PASSAGE, PASSAGE_GRAM = 51, 8
WORD = 5
LIMIT = 1 << 20
BATCH = 8_192
#: Units of an anchor from which classes take the place of pairs.
CROWD = 48
_SECOND = 0xC2B2AE3D27D4EB4F | 1
_FINGER = np.dtype([("x", "<u8"), ("y", "<u8")])


class Unit:
    """A text around an anchor, with the strings that begin in it."""

    __slots__ = ("count", "flag", "lead", "left", "n_left", "n_right", "occ", "right", "suffix", "times")

    def __init__(self, text: bytes, lead: int, width: int, occ: bytes, size: int = 1):
        self.lead, self.count = lead, max(1, len(text) // size - width + 1)
        self.times, self.occ = len(occ) // 12, occ
        self.flag = np.zeros(self.count, bool)
        # lead symbols before the anchor, and up to width symbols from it, as numbers
        self.suffix = right = text[lead * size : (lead + width) * size] if lead >= 0 else b""
        self.n_left, self.n_right = max(lead, 0), len(right) // size
        self.left = int.from_bytes(text[: self.n_left * size], "big")
        self.right = int.from_bytes(right.ljust(width * size, b"\0"), "big")


class IndexFamily:
    """Levels of suffix arrays over units; an entry is (suffix, unit).  size: bytes
    a symbol."""

    def __init__(self, width: int, gram: int, size: int = 1, crowd: int = CROWD):
        self.width, self.gram, self.size, self.most = width, gram, size, crowd
        self.levels: list[list[tuple[bytes, Unit]]] = []

    def match(self, x: Unit, y: Unit) -> None:
        """Flag the strings that two units share around their anchors."""
        if x.flag.all() and y.flag.all():
            return
        bits = 8 * self.size
        d = x.right ^ y.right
        right = min(x.n_right, y.n_right, self.width - -(-d.bit_length() // bits))
        d = x.left ^ y.left
        left = min(x.n_left, y.n_left, ((d & -d).bit_length() - 1) // bits if d else x.n_left)
        if left + right < self.width:
            return
        for u in (x, y):
            u.flag[max(0, u.lead - left) : max(0, u.lead + right - self.width + 1)] = True

    def crowd(self, units: list[Unit]) -> None:
        """match() for many units of one anchor, already in suffix order, without
        pairs: at each distance of a string's start from the anchor, units fall into
        classes of equal bytes to the right (runs of the suffix array) and to the
        left (runs of the array of reversed left parts); strings are equal where
        both are."""
        m, size = len(units), self.size

        def common(x: list[int], n: list[int], width: int, low: bool) -> np.ndarray:
            out = np.zeros(len(x), np.int64)
            for i in range(1, len(x)):
                d = x[i] ^ x[i - 1]
                same = ((d & -d).bit_length() - 1) // (8 * size) if low and d else width - -(-d.bit_length() // (8 * size))
                out[i] = min(n[i], n[i - 1], same)
            return out

        right = common([u.right for u in units], [u.n_right for u in units], self.width, False)
        most = max(u.n_left for u in units)
        order = sorted(range(m), key=lambda i: units[i].left.to_bytes(units[i].n_left * size, "big")[::-1])
        left = common([units[i].left for i in order], [units[i].n_left for i in order], most, True)
        lead, count, times = (np.array([getattr(u, f) for u in units]) for f in ("lead", "count", "times"))
        flags = np.zeros((m, int(count.max())), bool)
        turn = np.array(order)
        left_class = np.empty(m, np.int64)
        for o in range(int(lead.max()) + 1):
            at = np.flatnonzero((lead >= o) & (lead - o < count))
            if len(at) < 2:
                continue
            right_class = np.cumsum(right < self.width - o)
            left_class[turn] = np.cumsum(left < o)
            _, where = np.unique(right_class[at] * (m + 1) + left_class[at], return_inverse=True)
            again = np.bincount(where, times[at])[where] > 1
            flags[at[again], lead[at[again]] - o] = True
        for u, f in zip(units, flags, strict=True):
            u.flag |= f[: u.count]

    def scan(self, new: list[Unit], old: list[Unit]) -> None:
        """Units of one anchor that came with a batch, against each other and those
        of the levels."""
        if len(new) + len(old) > self.most:
            self.crowd([u for _, u in sorted(((u.suffix, u) for u in new + old), key=lambda e: e[0])])
            return
        for d in range(1, len(new)):  # nearest suffixes share most: they come first
            for a, b in zip(new, new[d:], strict=False):
                self.match(a, b)
        for x in new:
            for y in old:
                self.match(x, y)

    def matches(self, array: list[tuple[bytes, Unit]]) -> None:
        """Merging scan of the batch's array with the levels."""
        gram = self.gram * self.size
        levels = [iter(groupby(level, lambda e: e[0][:gram])) for level in self.levels if level]
        heads = [(key, [u for _, u in run]) for key, run in (next(level) for level in levels)]
        for key, run in groupby(array, lambda e: e[0][:gram]):
            old: list[Unit] = []
            for i, level in enumerate(levels):
                while heads[i] and heads[i][0] < key:
                    step = next(level, None)
                    heads[i] = step and (step[0], [u for _, u in step[1]])
                if heads[i] and heads[i][0] == key:
                    old += heads[i][1]
            self.scan([u for _, u in run], old)

    def add(self, batch: list[tuple[bytes, Unit]]) -> None:
        array = sorted(batch, key=lambda e: e[0])
        self.matches(array)
        at = 0
        while at < len(self.levels) and self.levels[at]:
            array = sorted(self.levels[at] + array, key=lambda e: e[0])  # two sorted runs: one merge
            self.levels[at] = []
            at += 1
        if at == len(self.levels):
            self.levels.append([])
        self.levels[at] = array


class Task:
    """Takes units in anchor order, gives the spans that they cover."""

    def __init__(self, width: int, gram: int, size: int = 1, crowd: int = CROWD):
        self.width, self.size = width, size
        self.family = IndexFamily(width, gram, size, crowd)
        self.anchor = None
        self.units: dict[bytes, Unit] = {}  # of the unfinished anchor
        self.fresh: list[tuple[bytes, Unit]] = []  # not indexed yet
        self.done: list[Unit] = []  # of finished anchors, some not indexed yet
        self.out: list[tuple[bytes, np.ndarray, np.ndarray]] = []

    def take(self, anchor: int, text: bytes, lead: int, occ: bytes) -> None:
        if anchor != self.anchor:
            self.done.extend(self.units.values())
            self.units, self.anchor = {}, anchor
        unit = self.units.get(text)
        if unit is None:
            self.units[text] = unit = Unit(text, lead, self.width, occ, self.size)
            if lead >= 0:
                self.fresh.append((unit.suffix, unit))
        else:
            unit.times += len(occ) // 12
            unit.occ += occ
        if unit.times > 1:
            unit.flag[:] = True
            # settled: need not wait for the rest of its anchor
            self.out.append((unit.occ, np.array([0]), np.array([unit.count - 1])))
            unit.occ = b""
        if len(self.fresh) >= BATCH:
            self.index()

    def index(self) -> None:
        self.family.add(self.fresh)
        self.fresh = []
        for unit in self.done:
            if unit.occ and unit.flag.any():
                first, last = R.runs_of(unit.flag, np.array([0, unit.count]))
                self.out.append((unit.occ, first[0], last[0]))
        self.done = []
        open_ = {id(u) for u in self.units.values()}
        kept = [e for level in self.family.levels for e in level if id(e[1]) in open_]
        if len(kept) < sum(map(len, self.family.levels)):
            self.family.levels = [[e for e in level if id(e[1]) in open_] for level in self.family.levels]

    def finish(self) -> None:
        self.done.extend(self.units.values())
        self.units = {}
        self.index()

    def spans(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        return R.spread([o for o, _, _ in out], [f for _, f, _ in out], [l for _, _, l in out], self.width)


class Chunk:
    """Symbols of a chunk of texts: `symbols` numbers, `text` their bytes, `size`
    bytes a symbol, `rows` the n+1 offsets of the texts in the symbols."""

    def __init__(self, raw: pa.Array, width: int, gram: int, words: bool):
        if words:
            found = C.Words(raw)
            self.symbols, self.rows, self.size = found.hash, found.first, WORD
            data = np.ascontiguousarray(found.hash.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :WORD])
        else:
            data, self.rows = C.flat(raw)
            self.symbols, self.size = C._CODES[data], 1
        self.rolling = R.Rolling(self.symbols)
        self.units = R.units(self.rolling, self.rows, width, gram)
        self.text = memoryview(data.reshape(-1)).cast("B")


def repeated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, words: bool = False, bits: int | None = None, hot: int = R.HOT, crowd: int = CROWD) -> DataFrame:
    """(k, a, b): spans of symbols of text k (see repeats.keyed) under strings of
    `width` symbols that begin anywhere else too."""
    spark = docs.sparkSession
    bits = bits or R.sketch_bits(docs, (width - gram + 2) / 2 * (6 if words else 1))
    seen = spark.sparkContext.broadcast(R.sketch(docs, lambda raw: Chunk(raw, width, gram, words).units, LIMIT, bits, hot))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in C.chunks(batches, limit=LIMIT):
            chunk = Chunk(raw, width, gram, words)
            size, text, rolling = chunk.size, chunk.text, chunk.rolling
            unit = chunk.units.take(seen.value.repeated(chunk.units.anchor))
            if not len(unit.start):
                continue
            alone = seen.value.crowded(unit.anchor)
            n_whole = int((~alone).sum())
            if alone.any():
                unit = unit.take(~alone).plus(unit.take(alone).singly(rolling, width))
            _, first, group = np.unique(unit.whole, return_index=True, return_inverse=True)
            order = np.argsort(group, kind="stable")
            occ = R.occurrences(rows.column("k").to_numpy()[unit.row[order]], unit.start[order] - chunk.rows[unit.row[order]], group[order], len(first))
            lead = np.where(first < n_whole, unit.place[first] - unit.start[first], -1)
            end = unit.start + unit.count + width - 1
            parts = [bytes(text[a * size : b * size]) for a, b in zip(unit.start[first].tolist(), end[first].tolist(), strict=True)]
            if n_whole < len(unit.start):
                where = np.flatnonzero(lead < 0)
                finger = np.empty(len(where), _FINGER)
                at = unit.start[first[where]]
                finger["x"], finger["y"] = rolling.spans(at, width), R.Rolling(chunk.symbols, _SECOND).spans(at, width)
                for i, f in zip(where.tolist(), finger, strict=True):
                    parts[i] = f.tobytes()
            yield pa.record_batch({"anchor": pa.array(unit.anchor[first].view(np.int64)), "lead": pa.array(lead, pa.int32()), "part": pa.array(parts, pa.binary()), "occ": pa.array(occ, pa.binary())})

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Task(width, gram, WORD if words else 1, crowd)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "lead", "occ")), strict=True):
                task.take(*row)
            yield task.spans()
        task.finish()
        yield task.spans()

    dealt = R.keyed(docs).select("k", "text").mapInArrow(emit, "anchor long, lead int, part binary, occ binary").repartition(C.partitions(spark), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(group, "k long, a int, b int")


def remove_repeats(docs: DataFrame, width: int = WIDTH, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept, passage_words) of
    every document; kept is the remaining bytes, of which those that no longer make
    whole characters are left out.  passage_words, for which nothing is removed
    here, counts the words under repeated passages of PASSAGE words."""
    spans = R.covered(repeated(docs, width, **options), repeated(docs, PASSAGE, PASSAGE_GRAM, True, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in C.chunks(batches):
            data, offsets = C.flat(raw)
            gone = R.union(rows.column("spans"), 0, offsets)
            first = C.Words(raw).first
            passages = np.concatenate([[0], np.cumsum(R.union(rows.column("spans"), 1, first))])
            removed = np.concatenate([[0], np.cumsum(gone)])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            edge = offsets[:-1][np.diff(offsets) > 0]
            opens[edge] = gone[edge]
            opens = np.concatenate([[0], np.cumsum(opens)])
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.record_batch({
                "doc_id": rows.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(np.diff(removed[offsets])), "n_spans": pa.array(np.diff(opens[offsets])),
                "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept], "kept": pa.array([x.decode(errors="ignore") for x in kept], pa.string()), "passage_words": pa.array(np.diff(passages[first])),
            })

    joined = R.keyed(docs).join(spans, "k", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, passage_words long")


def remove_passages(docs: DataFrame, carry: tuple[str, ...] = (), width: int = PASSAGE, gram: int = PASSAGE_GRAM, **options) -> DataFrame:
    """(doc_id, *carry, kept) of every document, without the words under strings of
    `width` words that begin anywhere else too."""
    keyed = R.keyed(docs, carry)
    spans = R.covered(repeated(docs, width, gram, True, **options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in C.chunks(batches):
            words = C.Words(raw)
            gone = R.union(rows.column("spans"), 0, words.first)
            # a word takes the bytes up to the next one of its text with it
            step = np.zeros(len(words.data) + 1, np.int8)
            end = np.append(words.starts[1:], len(words.data))
            last = words.first[1:][words.count > 0] - 1
            end[last] = words.rows[1:][words.count > 0]
            step[words.starts[gone]] += 1
            np.add.at(step, end[gone], -1)
            drop = np.cumsum(step[:-1], dtype=np.int8) > 0
            kept = [words.data[a:b][~drop[a:b]].tobytes().decode() for a, b in zip(words.rows[:-1].tolist(), words.rows[1:].tolist(), strict=True)]
            yield pa.record_batch([*(rows.column(c) for c in ("doc_id", *carry)), pa.array(kept, pa.string())], names=["doc_id", *carry, "kept"])

    joined = keyed.join(spans, "k", "left").select("doc_id", *carry, "text", "spans")
    carried = "".join(f"{c} {keyed.schema[c].dataType.simpleString()}, " for c in carry)
    return joined.mapInArrow(run, f"doc_id long, {carried}kept string")


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(C.table(spark, sf_dir, "documents")).drop("kept")
