"""Operator 5: n-gram Jaccard join by grouped prefixes.

A text's set is its distinct k-word shingles (hashes of words in ASCII lower case).
Sets are ordered by one global order: rare shingles by hash, then those in FEW texts
or more by hash, then those in 1/COMMON of all texts or more by frequency.  (The
second kind is counted exactly over all texts, but only in the low part of the
hashes, where prefixes lie, and kept as a Bloom filter of fixed size: a false hit
only moves a shingle in the order.)  Sets of size n that reach similarity t share one
of the first n - ceil(t n) + 1 shingles.

1. Equal sets collapse to a class, classes of equal prefix and size to a group.
2. Groups meet in the runs of their prefix shingles, sorted by size.  A run pairs
   each group with its NEAR next ones only; pairs pass the size filter and the
   position filter.  Within a group its classes pair with its first one.
3. Pairs of classes are filtered by their whole prefixes (too many shingles apart
   already), then verified on the whole sets; links join components.
4. Runs that step 2 could not pair wholly (longer than NEAR, or holding groups of
   several classes) are met again class by class, now only across components.  Runs
   within one component are left out; those of over RUN rows are cut into cells.  Rows
   bring their whole sets, and the links are found where the run is (see runs): what
   leaves it is at most a few links a class, never pairs to look at.  Sets of over LONG
   shingles would weigh too much beside each row; pairs with one are listed, filtered
   and verified as before.  So no link that joins two components is lost.

Sets are never gathered by shingle: only classes in pairs that passed the prefix
filter have theirs built again from their text, found by a Bloom filter of fixed
size.

Defined results: null text, or text without words, has the empty set and links with
nothing; fewer than k words make one shingle; rows that repeat a doc_id count as
documents of their own under one id; null ids are never the smallest unless alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import repeats as R
from . import runs
from .components import components

COMMON = 1_000
FEW = 8
NEAR = 8
BLOOM_BITS = 26
LIMIT = 2 << 20
WORK = 500_000
RUN = 20_000  # rows of a side of a run
MEAN = 100  # shingles a row that RUN is meant for; a side of larger sets has fewer rows
LONG = 4_096
_TOP = 1 << 62
_SOME = 1 << 61


@dataclass
class Rule:
    """Two sets link when den * |intersection| >= num * |union|; k words a shingle."""

    k: int
    num: int
    den: int

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return np.where(n > 0, n - (self.num * n + self.den - 1) // self.den + 1, 0)

    def apart(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Most shingles by which linked sets of these sizes can differ; negative:
        they cannot link."""
        both = n + m
        least = (self.num * both + self.num + self.den - 1) // (self.num + self.den)
        return np.where(self.den * np.minimum(n, m) >= self.num * np.maximum(n, m), both - 2 * least, -1)


def shingle_sets(raw: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shingle) of all distinct shingles, shingles below 2**61."""
    w = C.Words(raw, lower=True)
    row = w.row_of()
    parts_row, parts = [], []
    if len(w.hash) >= k:
        h = C.sequence_hash(w.hash, k)
        same = row[k - 1 :] == row[: len(row) - k + 1]
        parts.append(h[same])
        parts_row.append(row[: len(row) - k + 1][same])
    short = np.flatnonzero((w.count > 0) & (w.count < k))
    if len(short):
        at = w.first[short]
        many = w.count[short]
        which = np.repeat(at - np.cumsum(many) + many, many) + np.arange(many.sum())
        step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        value = w.hash[which] * C.powers(C._BASE, k + 1)[step]
        parts.append(C.mix(np.add.reduceat(value, np.cumsum(many) - many) + many.astype(np.uint64)))
        parts_row.append(short)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, row = (np.concatenate(parts) >> np.uint64(3)).astype(np.int64), np.concatenate(parts_row)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def frequencies(docs: DataFrame, rule: Rule, one_in: int = COMMON, few: int = FEW, bits: int = BLOOM_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in at least 1/one_in of the texts (as counted where a partition has
    enough of them), rarest first: at most one_in times the mean size of a set; and
    the Bloom filter of those in `few` texts or more in the low part of the hashes,
    half as wide again as prefixes are."""
    spark = docs.sparkSession
    blocks = 4 * C.partitions(spark)
    low = min(_SOME, int(_SOME * 1.5 * (rule.den - rule.num) / rule.den))
    step = low // blocks + 1
    pair = np.dtype([("h", "<i8"), ("n", "<i4")])

    def packed(h: np.ndarray, n: np.ndarray) -> bytes:
        out = np.empty(len(h), pair)
        out["h"], out["n"] = h, n
        return out.tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts, size = [], 0, 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(seen), return_counts=True)
            often = n >= max(8, texts // one_in)
            part = np.searchsorted(h, np.minimum(np.arange(blocks + 1) * step, low))
            data = [packed(h[x:y], n[x:y]) for x, y in zip(part[:-1], part[1:], strict=True)]
            return pa.record_batch({"block": pa.array(np.arange(-1, blocks), pa.int32()), "data": pa.array([packed(h[often], n[often]), *data], pa.binary()), "texts": pa.array([texts, *[0] * blocks], pa.int64())})

        for _, raw in C.chunks(batches, limit=LIMIT):
            h = shingle_sets(raw, rule.k)[1]
            seen.append(h)
            texts, size = texts + len(raw), size + len(h)
            if size > 2_000_000:
                yield out()
                seen, texts, size = [], 0, 0
        if seen:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, texts = None, [], 0

        def out() -> pa.RecordBatch:
            got = np.frombuffer(b"".join(held), pair)
            h, where = np.unique(got["h"], return_inverse=True)
            n = np.bincount(where, got["n"], minlength=len(h)).astype(np.int64)
            keep = n * one_in >= texts if at < 0 else n >= few
            return pa.record_batch({"kind": pa.array(np.full(int(keep.sum()), int(at < 0)), pa.int32()), "h": h[keep], "n": n[keep]})

        for batch in batches:
            for block, data, t in zip(*(batch.column(c).to_pylist() for c in ("block", "data", "texts")), strict=True):
                if block != at:
                    if held:
                        yield out()
                    at, held, texts = block, [], 0
                held.append(data)
                texts += t
        if held:
            yield out()

    parts = docs.select("text").mapInArrow(count, "block int, data binary, texts long").repartition(C.partitions(spark), "block").sortWithinPartitions("block")
    found = C.stored(parts.mapInArrow(merge, "kind int, h long, n long"), "frequent")
    got = found.filter("kind = 1").select("h", "n").toArrow()
    h, n = got["h"].to_numpy(), got["n"].to_numpy()
    some = bloom(found.filter("kind = 0").select("h"), bits)
    C.forget(found)
    return h[np.lexsort((h, n))], some


def in_order(row: np.ndarray, h: np.ndarray, order: tuple[np.ndarray, np.ndarray, np.ndarray, int]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles as keys that sort by the global order: those of the filter get
    2**61 on top, common ones are 2**62 + rank."""
    value, rank, table, bits = order
    key = h + np.where(in_bloom(table, h.view(np.uint64), bits), _SOME, 0)
    if len(value):
        at = np.minimum(np.searchsorted(value, h), len(value) - 1)
        hit = value[at] == h
        key = np.where(hit, _TOP + rank[at], key)
    by = np.lexsort((key, row))
    return row[by], key[by]


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values))


def signed(docs: DataFrame, rule: Rule, common: np.ndarray, some: np.ndarray, bits: int = BLOOM_BITS) -> DataFrame:
    """(doc_id, k, n, c, prefix) of every text: size, class and prefix of its set.
    c, 0 for the empty set, is a hash of the whole set."""
    order = np.argsort(common, kind="stable")
    sent = docs.sparkSession.sparkContext.broadcast((common[order], order, some, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw in C.chunks(batches, limit=LIMIT):
            row, h = in_order(*shingle_sets(raw, rule.k), sent.value)
            size = np.bincount(row, minlength=len(raw))
            begin = np.cumsum(size) - size
            c = np.zeros(len(raw), np.uint64)
            full = np.flatnonzero(size)
            if len(full):
                c[full] = C.mix(np.add.reduceat(C.mix(h.astype(np.uint64) + np.uint64(0x632BE5AB)), begin[full]) + size[full].astype(np.uint64)) | np.uint64(1)
            long = rule.prefix(size)
            take = np.arange(len(h)) - begin[row] < long[row]
            yield pa.record_batch({"doc_id": rows.column("doc_id"), "k": rows.column("k"), "n": pa.array(size, pa.int64()), "c": pa.array(c.view(np.int64)), "prefix": _lists(h[take], long)})

    return R.keyed(docs).mapInArrow(run, "doc_id long, k long, n long, c long, prefix array<long>")


def close_pairs(pairs: DataFrame, sets: DataFrame, rule: Rule, whole: bool) -> DataFrame:
    """The pairs (a, b) whose sets (c, n, members) can link, by their prefixes, or
    do link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # bounded work: pairs of WORK members in all at a time, one pair at least
            size = np.cumsum([pa.compute.list_value_length(batch.column(c)).to_numpy() for c in ("x", "y")], axis=1).sum(axis=0)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + WORK, side="right")))
                part, at = batch.slice(at, to - at), to
                x, y = part.column("x"), part.column("y")
                n, m = part.column("n").to_numpy(), part.column("m").to_numpy()
                a, b = (np.asarray(s.flatten(), np.int64) for s in (x, y))
                na, nb = (pa.compute.list_value_length(s).to_numpy() for s in (x, y))
                ra, rb = np.repeat(np.arange(len(n)), na), np.repeat(np.arange(len(n)), nb)
                row, value = np.concatenate([ra, rb]), np.concatenate([a, b])
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                twin = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                shared = np.bincount(row[1:][twin], minlength=len(n))
                if whole:
                    ok = rule.den * shared >= rule.num * (n + m - shared)
                else:
                    end = np.minimum(a[np.cumsum(na) - 1], b[np.cumsum(nb) - 1])
                    seen = np.bincount(ra[a <= end[ra]], minlength=len(n)) + np.bincount(rb[b <= end[rb]], minlength=len(n))
                    ok = seen - 2 * shared <= rule.apart(n, m)
                keep = pa.array(ok)
                yield pa.record_batch({"a": part.column("a").filter(keep), "b": part.column("b").filter(keep)})

    left = sets.select(F.col("c").alias("a"), "n", F.col("members").alias("x"))
    right = sets.select(F.col("c").alias("b"), F.col("n").alias("m"), F.col("members").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def bloom(keys: DataFrame, bits: int = BLOOM_BITS) -> np.ndarray:
    """Bitmap of two hashes a key; its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column(0).to_numpy().view(np.uint64)
            for cell in R._cells(k, bits):
                yield pa.record_batch({"word": pa.array(cell >> 5), "bit": pa.array(np.int64(1) << (cell & 31))})

    words = keys.mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def in_bloom(table: np.ndarray, k: np.ndarray, bits: int = BLOOM_BITS) -> np.ndarray:
    out = np.ones(len(k), bool)
    for cell in R._cells(k, bits):
        out &= table[cell >> 5] >> (cell & 31).astype(np.uint32) & np.uint32(1) == 1
    return out


def whole_sets(docs: DataFrame, classes: DataFrame, rule: Rule, wanted: DataFrame, bits: int = BLOOM_BITS) -> DataFrame:
    """(c, n, members) of the wanted(c) classes, from the text of one document each,
    stored."""
    keys = classes.join(wanted, "c", "left_semi").select("c", "k", "n")
    keys = C.stored(keys, "wanted")
    sent = docs.sparkSession.sparkContext.broadcast(bloom(keys.select("k"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.column("k").to_numpy().view(np.uint64)
            keep = in_bloom(sent.value, k, bits)
            for rows, raw in C.chunks([batch.filter(pa.array(keep))], limit=LIMIT):
                row, h = shingle_sets(raw, rule.k)
                yield pa.record_batch({"k": rows.column("k"), "members": _lists(h, np.bincount(row, minlength=len(raw)))})

    built = R.keyed(docs).select("k", "text").mapInArrow(run, "k long, members array<long>")
    sets = C.stored(built.join(keys, "k").groupBy("c").agg(F.first("n").alias("n"), F.first("members").alias("members")), "sets")
    C.forget(keys)
    return sets


def near_runs(postings: DataFrame, rule: Rule) -> DataFrame:
    """Step 2 over (token, n, pos, c, many): rows (token, a, b): a pair, or with b
    null a token whose run is not wholly paired."""

    def settle(rows: pa.Table) -> pa.RecordBatch:
        token, n, pos, c = (rows[x].to_numpy() for x in ("token", "n", "pos", "c"))
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(token))))
        size = np.bincount(run)
        out_a, out_b = [], []
        for d in range(1, NEAR + 1):
            i = np.flatnonzero(run[d:] == run[:-d])
            far = rule.apart(n[i], n[i + d])
            i = i[pos[i] + pos[i + d] <= far]
            out_a.append(np.minimum(c[i], c[i + d]))
            out_b.append(np.maximum(c[i], c[i + d]))
        a, b = np.concatenate(out_a), np.concatenate(out_b)
        if len(a):
            pair = np.unique(np.stack([a, b], axis=1), axis=0)
            a, b = pair[:, 0], pair[:, 1]
        many = np.bincount(run, rows["many"].to_numpy(zero_copy_only=False).astype(float))
        open_ = token[start][(size > NEAR + 1) | ((many > 0) & (size > 1))]
        return pa.record_batch({"token": pa.array(np.concatenate([np.zeros(len(a), np.int64), open_])), "a": pa.array([*a.tolist(), *[None] * len(open_)], pa.int64()), "b": pa.array([*b.tolist(), *[None] * len(open_)], pa.int64())})

    # a part of a run is longer than NEAR + 1, so its token is open
    return by_token(postings, settle, ["token", "n", "c"], "token long, a long, b long", overlap=NEAR)


def in_cells(postings: DataFrame, run: int | None = None) -> DataFrame:
    """Step 4's rows (token, n, pos, c, root) with (side, cell), without the tokens of
    one root.  Runs of over `run` rows are cut by a hash of c into sides of about that
    many, and each two sides meet in a cell, so any two rows still meet, in one cell
    at least; shorter runs are one cell."""
    postings = C.stored(postings, "postings")
    tokens = postings.groupBy("token").agg(F.greatest(F.count("*"), F.sum(F.least("n", F.lit(LONG))) / MEAN).alias("_m"), F.min("root").alias("_low"), F.max("root").alias("_high"))
    sides = tokens.filter("_low <> _high").select("token", F.ceil(F.col("_m") / (run or RUN)).cast("long").alias("_sides"))
    rows = postings.join(sides, "token").withColumn("side", F.pmod(F.xxhash64("c"), F.col("_sides")))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_sides") - 1)))
    cell = F.least("side", "_other") * F.col("_sides") + F.greatest("side", "_other")
    out = C.stored(rows.select("token", "n", "pos", "c", "root", "side", cell.alias("cell")), "cells")
    C.forget(postings)
    return out


def links_of_runs(cells: DataFrame, rule: Rule) -> DataFrame:
    """Step 4 over in_cells() with members: links (a, b) that connect the classes which
    the links of the runs connect, found where the run is."""

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        token, cell, n, c, root, side = (rows[x].to_numpy() for x in ("token", "cell", "n", "c", "root", "side"))
        members = np.asarray(pa.compute.list_flatten(rows["members"].combine_chunks()), np.int64)
        at = np.concatenate([[0], np.cumsum(n)])
        start = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]))
        end = np.append(start[1:], len(token))
        two = np.minimum.reduceat(side, start) != np.maximum.reduceat(side, start)
        open_ = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
        for s, e, halves in zip(start[open_].tolist(), end[open_].tolist(), two[open_].tolist(), strict=True):
            link = runs.Run(rule, n[s:e], root[s:e], members[at[s] : at[e]], side[s:e] if halves else None).links()
            if len(link):
                yield pa.record_batch({"a": c[s:e][link].min(axis=1), "b": c[s:e][link].max(axis=1)})

    return by_token(cells, settle, ["token", "cell"], "a long, b long", ("token", "cell"))


def across_runs(cells: DataFrame, rule: Rule, over: int = 0) -> DataFrame:
    """Step 4 over in_cells(): pairs of classes of unlike root, the larger of over
    `over` shingles."""

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        token, cell, n, pos, c, root, side = (rows[x].to_numpy() for x in ("token", "cell", "n", "pos", "c", "root", "side"))
        start = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (cell[1:] != cell[:-1])]))
        end = np.append(start[1:], len(token))
        two = np.minimum.reduceat(side, start) != np.maximum.reduceat(side, start)
        low, high = np.minimum.reduceat(root, start), np.maximum.reduceat(root, start)
        found, many = [], 0

        def out() -> pa.RecordBatch:
            pair = np.unique(np.concatenate(found), axis=0)
            return pa.record_batch({"a": pair[:, 0].copy(), "b": pair[:, 1].copy()})

        for s, e, halves in zip(start[low != high].tolist(), end[low != high].tolist(), two[low != high].tolist(), strict=True):
            for i in range(s, e - 1):
                # sizes ascend: only as far as the size filter reaches
                to = s + int(np.searchsorted(n[s:e], n[i] * rule.den // rule.num, side="right"))
                j = np.arange(i + 1, to)
                j = j[(root[j] != root[i]) & (n[j] > over)]
                if halves:  # rows of one side meet in a cell of their own
                    j = j[side[j] != side[i]]
                j = j[pos[i] + pos[j] <= rule.apart(n[j], n[i])]
                if len(j):
                    found.append(np.stack([np.minimum(c[i], c[j]), np.maximum(c[i], c[j])], axis=1))
                    many += len(j)
                if many >= WORK:
                    yield out()
                    found, many = [], 0
        if found:
            yield out()

    return by_token(cells, settle, ["token", "cell", "n", "c"], "a long, b long", ("token", "cell"))


def by_token(postings: DataFrame, settle, order: list[str], schema: str, key: tuple[str, ...] = ("token",), overlap: int = 0) -> DataFrame:
    """Runs `settle` over tables of complete runs of equal token, or of another key
    that `order` begins with, some 50,000 rows or
    16 MB each.  With an overlap, longer runs come
    in parts, the last `overlap` rows of one again in the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def out(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            got = settle(rows)
            yield from ([got] if isinstance(got, pa.RecordBatch) else got)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 50_000 and sum(b.nbytes for b in held) < 8 * LIMIT:
                continue
            rows = pa.Table.from_batches(held)
            last = np.ones(len(rows), bool)
            for name in key:
                value = rows[name].to_numpy()
                last &= value == value[-1]
            n = int(np.argmax(last))  # the open run's first row
            if overlap and not n:
                yield from out(rows)
                n = len(rows) - overlap
            elif n:
                yield from out(rows.slice(0, n))
            held = rows.slice(n).combine_chunks().to_batches()
            size -= n
        if size:
            yield from out(pa.Table.from_batches(held))

    # dealt by a hash of the token: by the token itself, the planner leaves the deal of a
    # join on it below in its place, and adaptive execution may split a run there
    return postings.repartition(C.partitions(postings.sparkSession), F.xxhash64(*key)).sortWithinPartitions(*order).mapInArrow(run, schema)


def similar(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, k, n_shingles, component_id, root): component_id is the smallest
    doc_id reachable by links.  Where ids are null or repeat, components can share it;
    root, the smallest class, is a component's own (0 for all empty sets)."""
    rule = Rule(k, num, den)
    base = C.stored(signed(docs, rule, *frequencies(docs, rule)), "signed")
    classes = base.filter("n > 0").groupBy("c").agg(F.min("k").alias("k"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    classes = C.stored(classes.withColumn("g", F.xxhash64("prefix", "n")), "classes")
    heads = classes.groupBy("g").agg(F.min("c").alias("head"), (F.count("*") > 1).alias("many"))
    grouped = classes.select("c", "n", "g").join(heads, "g")
    first = classes.join(heads, "g").filter("c = head").select("c", "n", "many", F.posexplode("prefix").alias("pos", "token"))
    met = C.stored(near_runs(first.withColumn("pos", F.col("pos").cast("long")), rule), "met")
    prefixes = classes.select("c", "n", F.col("prefix").alias("members"))

    def linked(pairs: DataFrame) -> DataFrame:
        near = C.stored(close_pairs(pairs.distinct(), prefixes, rule, False), "near")
        wanted = near.select(F.col("a").alias("c")).unionByName(near.select(F.col("b").alias("c"))).distinct()
        sets = whole_sets(docs, classes, rule, wanted)
        links = C.stored(close_pairs(near, sets, rule, True), "links")
        C.forget(near, sets)
        return links

    star = grouped.filter("c <> head").select(F.least("c", "head").alias("a"), F.greatest("c", "head").alias("b"))
    links = linked(met.filter("b is not null").select("a", "b").unionByName(star))
    roots = C.stored(components(links), "roots")

    # step 4: tokens not wholly paired, and groups of three classes or more as runs
    rooted = classes.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    rooted = C.stored(rooted.select("c", "n", "g", "root", "prefix"), "rooted")
    tokens = rooted.select("c", "n", "root", F.posexplode("prefix").alias("pos", "token")).join(met.filter("b is null").select("token").distinct(), "token", "left_semi")
    crowded = rooted.groupBy("g").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).filter("m > 2 and low <> high").select("g")
    inner = rooted.join(crowded, "g", "left_semi").select("c", "n", "root", F.lit(0).alias("pos"), F.col("g").alias("token"))
    cells = in_cells(tokens.unionByName(inner).withColumn("pos", F.col("pos").cast("long")))
    short = cells.filter(F.col("n") <= LONG)
    sets = whole_sets(docs, classes, rule, short.select("c").distinct())
    more = C.stored(links_of_runs(short.drop("n", "pos").join(sets, "c"), rule).distinct(), "more")
    C.forget(met, sets)
    if not cells.filter(F.col("n") > LONG).isEmpty():
        again = C.stored(across_runs(cells.filter(F.col("n") * rule.den >= F.lit(LONG * rule.num)), rule, LONG), "again")
        some, long = more, linked(again)
        more = C.stored(some.unionByName(long), "more")
        C.forget(again, some, long)
    C.forget(cells, classes, rooted)
    if not more.isEmpty():
        old, roots = roots, components(links.unionByName(more))
        C.forget(old)
    C.forget(links, more)
    named = base.select("doc_id", "k", "n", "c").join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    named = C.stored(named, "named")
    C.forget(base)
    least = named.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "root", "left")
    return out.select("doc_id", "k", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), "root")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar(C.table(spark, sf_dir, "documents"), 4, 85, 100).drop("k", "root")
