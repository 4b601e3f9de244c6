"""Operator 8: near-duplicate vectors by cross-polytope hashing.

Equal vectors of a label are one class first.  Each class vector goes through
TABLES x HASHES pseudo-random rotations (three rounds of sign flips and fast
Hadamard transforms; Andoni et al., 2015); the hash is the signed axis nearest to
the rotated vector, and HASHES of them make a bucket key.  A vector is kept in
its own bucket of each table and looked up in PROBES buckets: its own and those
that the next nearest axes give.  Pairs that meet are verified by their cosine in
double precision.  A pair counts in the first table and smallest bucket where it
meets, so links are counted without a list of all pairs.

Buckets over BLOCK rows are dealt into blocks, every two blocks meet in a task of
their own.  Measured recall against brute force on the test tables: 1.0.

Defined results: rows whose label is null, or whose vector is null, empty, zero or
holds a null or non-finite component, link with nothing; vectors of unequal length
do not link; rows that repeat a vec_id are vectors of their own under one id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .components import components, local_roots

COSINE = 0.98
TABLES, HASHES, PROBES = 6, 2, 4
BLOCK = 1024
SEED = 5


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES) -> np.ndarray:
    """(row, table, probe) bucket keys of unit vectors; probe 0 is the own bucket.
    The others exchange one axis for the next nearest, the least loss first; -1
    where vectors are too short for as many."""
    d = 1 << max(1, int(x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), d))
    padded[:, : x.shape[1]] = x
    out = np.full((len(x), tables, probes), -1, np.int64)
    rng = np.random.default_rng(SEED)
    for t in range(tables):
        first, options = np.zeros(len(x), np.int64), []
        for k in range(hashes):
            y = padded
            for _ in range(3):
                y = _hadamard(y * rng.choice([-1.0, 1.0], d)) / np.sqrt(d)
            size = np.abs(y)
            near = np.argsort(-size, axis=1, kind="stable")[:, : probes]
            rows = np.arange(len(x))[:, None]
            axis = near * 2 + (y[rows, near] < 0)
            scale = (2 * d) ** k
            first += axis[:, 0] * scale
            for p in range(1, near.shape[1]):
                options.append((size[rows[:, 0], near[:, 0]] - size[rows[:, 0], near[:, p]], (axis[:, p] - axis[:, 0]) * scale))
        loss = np.stack([o[0] for o in options], axis=1)
        change = np.stack([o[1] for o in options], axis=1)
        best = np.argsort(loss, axis=1, kind="stable")[:, : probes - 1]
        out[:, t, 0] = first
        out[:, t, 1 : 1 + best.shape[1]] = first[:, None] + np.take_along_axis(change, best, axis=1)
    return out


def _meets(keys_i: np.ndarray, keys_j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first table, and there the smallest bucket, where pairs meet."""
    none = np.iinfo(np.int64).max
    one = np.where((keys_i == keys_j[:, :, :1]).any(axis=2), keys_j[:, :, 0], none)
    two = np.where((keys_j == keys_i[:, :, :1]).any(axis=2), keys_i[:, :, 0], none)
    low = np.minimum(one, two)
    t = (low < none).argmax(axis=1)
    return t, low[np.arange(len(low)), t]


def _runs(same: np.ndarray, blocks: tuple[np.ndarray, ...]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within runs of equal keys (same[i]: row i has the key of row
    i-1), a distance at a time: all rows of short runs at once."""
    start = np.flatnonzero(~same)
    length = np.diff(np.append(start, len(same)))
    end = np.repeat(start + length, length)
    at = np.arange(len(same))
    d = 1
    while len(at := at[at + d < end[at]]):
        yield at, at + d
        d += 1


def near_pairs(rows: pa.Table, cosine: float) -> list[tuple[np.ndarray, ...]]:
    """Verified pairs of complete buckets, each counted where it first meets."""
    vec = np.asarray(rows["vector"].combine_chunks().flatten(), np.float32).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 1), np.float32)
    x = unit(vec)
    cols = {c: rows[c].to_numpy() for c in ("label", "tab", "bucket", "own", "block", "low", "high", "rep", "copies")}
    key = np.stack([cols[c] for c in ("label", "tab", "bucket", "low", "high")])
    same = np.concatenate([[False], (key[:, 1:] == key[:, :-1]).all(axis=0)])
    found = []
    for i, j in _runs(same, ()):
        use = (cols["own"][i] | cols["own"][j]) & ((cols["block"][i] != cols["block"][j]) == (cols["low"][i] != cols["high"][i]))
        i, j = i[use], j[use]
        for at in range(0, len(i), 1 << 16):
            a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            near = np.einsum("nd,nd->n", x[a], x[b]) >= cosine
            if near.any():
                found.append((a[near], b[near]))
    if not found:
        return []
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    used, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    keys = bucket_keys(x[used])
    out = []
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        t, low = _meets(keys[where[at : at + len(a)]], keys[where[len(i) + at : len(i) + at + len(a)]])
        here = (t == cols["tab"][a]) & (low == cols["bucket"][a])
        out.append((cols["rep"][a[here]], cols["rep"][b[here]], cols["copies"][a[here]], cols["copies"][b[here]]))
    return out


def link_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of vectors(vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vector"), F.col("label").cast("long").alias("label"))
    sound = F.col("label").isNotNull() & F.col("vector").isNotNull() & F.exists("vector", lambda v: v != 0) & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    classes = C.stored(rows.filter("sound").groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("class", F.monotonically_increasing_id()), "classes")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column("vector")
            size = np.asarray(pa.compute.list_value_length(vec))
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                keys = bucket_keys(unit(np.asarray(part.column("vector").flatten(), np.float32).reshape(-1, d)))
                for t in range(keys.shape[1]):
                    for p in range(keys.shape[2]):
                        n = len(keys)
                        if keys[0, t, p] < 0:
                            continue
                        # the length goes with the table, so unequal lengths never meet
                        yield pa.record_batch({"label": part.column("label"), "tab": pa.array(np.full(n, t), pa.int32()), "size": pa.array(np.full(n, d), pa.int32()), "bucket": keys[:, t, p], "own": pa.array(np.full(n, p == 0)), "class": part.column("class"), "rep": part.column("rep"), "copies": part.column("copies"), "vector": part.column("vector")})

    place = ["label", "size", "tab", "bucket"]
    keyed = classes.mapInArrow(hashed, "label long, tab int, size int, bucket long, own boolean, class long, rep long, copies long, vector array<float>")
    crowded = keyed.groupBy(*place).count().filter(F.col("count") > block)
    parts = F.ceil(F.coalesce(F.col("count"), F.lit(1)) / block).cast("int")
    dealt = (
        keyed.join(crowded, place, "left")
        .withColumn("parts", parts)
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("other", "parts", "count")
        .repartition(C.partitions(spark), *place, "low", "high")
        .sortWithinPartitions(*place, "low", "high", "block", "class")
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            for d in rows["size"].unique().to_pylist():
                got = near_pairs(rows.filter(pa.compute.equal(rows["size"], d)), cosine)
                if not got:
                    continue
                a, b, m, n = (np.concatenate(c) for c in zip(*got, strict=True))
                if not len(a):
                    continue
                ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
                links = np.bincount(where, np.concatenate([n, m])).astype(np.int64)
                root = ids[local_roots(where[: len(a)], where[len(a) :], len(ids))]
                yield pa.record_batch({"rep": ids, "root": root, "links": links})

        held: list[pa.RecordBatch] = []
        names = ["label", "size", "tab", "bucket", "low", "high"]
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            # keep back the last, perhaps unfinished, bucket
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in names]
            rows = pa.Table.from_batches(held)
            if rows.num_rows < 20_000:
                continue
            end = np.logical_and.reduce([rows[c].to_numpy() == v for c, v in zip(names, last, strict=True)])
            n = int(rows.num_rows - end.sum())
            yield from settle(rows.slice(0, n))
            held = rows.slice(n).combine_chunks().to_batches()
        if held:
            yield from settle(pa.Table.from_batches(held))

    met = C.stored(dealt.mapInArrow(meet, "rep long, root long, links long"), "met")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    roots = components(met.filter("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_class = (
        classes.select("label", F.col("vector").alias("class_vector"), "rep", "copies")
        .join(links, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select(F.xxhash64("label", "class_vector").alias("class_h"), F.col("label").alias("class_label"), "class_vector", "rep", (F.col("copies") - 1 + F.coalesce(F.col("links"), F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root"))
    )
    # most vectors have no copy and no link; those are sound rows with a class all the same
    key = F.when(F.col("sound"), F.xxhash64("label", "vector"))
    out = rows.withColumn("h", key).join(by_class, (F.col("h") == F.col("class_h")) & (F.col("vector") == F.col("class_vector")) & (F.col("label") == F.col("class_label")), "left")
    component = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(C.table(spark, sf_dir, "embeddings"))
