"""Shared pieces of the training-data operators: shared-folder tables, Arrow
chunks of bounded size, and vectorised word hashing.

Nulls: a null text is an empty text everywhere in this subpackage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local master may do
    without: then it is a temporary one."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="folioforge-")
        spark.sparkContext.setCheckpointDir(place)
        place = spark.sparkContext.getCheckpointDir()
    return place.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/folioforge/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{_own(spark)}/{kind}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored.  For the end of a job: results
    of the operators that have not been written yet read from it."""
    _delete(spark, _own(spark))


def stored(df: DataFrame, kind: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage at files
    that outlive any executor.  forget() deletes them, or clear()."""
    spark = df.sparkSession
    path = fresh_path(spark, kind)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that stored() returned, after their last reader."""
    for df in tables:
        _delete(df.sparkSession, df._stored_at)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """UTF-8 bytes of a text column, null as empty, 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with at most `limit` text bytes each (one row at
    least), beside their text as bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        raw = text_bytes(batch.column(batch.schema.get_field_index(text)))
        end = np.cumsum(pc.binary_length(raw).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            done = end[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(end, done + limit, side="right")))
            yield batch.slice(at, to - at), raw.slice(at, to - at)
            at = to


def flat(raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte buffer and the n+1 row offsets in it."""
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    values = raw.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (public-domain murmur3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


mix = _mix
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = _CODES.copy()
_LOWER[65:91] = _CODES[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = -(-n // (1 << 16)) << 16
        out = np.ones(size, np.uint64)
        done = 1
        while done < size:
            more = min(done, size - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        _powers[base] = have = out
    return have[:n]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


#: Bytes that end a word where punctuation does too: all of ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


class Words:
    """Words of a chunk of texts, as positions and 64-bit hashes: maximal runs of
    bytes outside `gaps`, by default `[^\\x20\\x09-\\x0D]+`.  Words never cross rows."""

    def __init__(self, raw: pa.Array, lower: bool = False, gaps: np.ndarray = _SPACE):
        self.raw = raw
        self.data, self.rows = flat(raw)
        data, rows = self.data, self.rows
        n = len(data)
        word = ~gaps[data]
        first = word.copy()
        first[1:] &= ~word[:-1]
        last = word.copy()
        last[:-1] &= ~word[1:]
        edge = rows[(rows > 0) & (rows < n)]
        first[edge] = word[edge]
        last[edge - 1] = word[edge - 1]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.count = np.diff(np.searchsorted(self.starts, rows))
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        code = (_LOWER if lower else _CODES)[data] * powers(_BASE, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(code, out=total[1:])
        self.total = total
        self.hash = self.spans(self.starts, self.ends)

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from start to end, the same wherever they stand."""
        value = (self.total[end] - self.total[start]) * powers(_INVERSE, len(self.total))[start]
        return _mix(value + (end - start).astype(np.uint64))

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def sequence_hash(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values (len - k + 1 of them), by doubling."""
    out, width, step = values, 1, {1: values}
    while width * 2 <= k:
        step[2 * width] = _mix(step[width][:-width] * np.uint64(_BASE) + step[width][width:])
        width *= 2
    out, left = step[width], k - width
    at = width
    while left:
        part = 1 << (left.bit_length() - 1)
        n = len(values) - at - part + 1
        out = _mix(out[:n] * np.uint64(_INVERSE) + step[part][at : at + n])
        at += part
        left -= part
    return out


def fold(doc_id, modulus: int):
    """Spark column: crc32 of the id as text, modulo."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, most: int, ones: float = 0.5) -> DataFrame:
    """At most `most` labelled rows (doc_id, text, y) outside the held-out fold,
    the share `ones` of them for label 1, those of the smallest id hash.  Rows without an id, or with a label other
    than 0 or 1, are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter(F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held))
    one, zero = (known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for y, k in ((1, int(most * ones)), (0, most - int(most * ones))))
    wanted = one.unionByName(zero)
    # most rows of two numbers: a size that the parameter bounds
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(wanted), "doc_id")


def class_weights(labels: DataFrame, label: str, modulus: int, held: int, y: np.ndarray) -> np.ndarray:
    """Weights that give the labels of a balanced sample their shares among all
    labelled rows outside the held-out fold."""
    got = labels.filter(F.col("doc_id").isNotNull() & (fold("doc_id", modulus) != held)).groupBy(F.col(label).cast("int").alias("y")).count().filter(F.col("y").isin(0, 1)).collect()
    there = {r["y"]: r["count"] for r in got}
    per = np.array([there.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)])
    return (per / max(per.max(), 1e-12))[y]


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit of y on the margins, with
    the smoothed targets of Platt (1999), by damped Newton steps."""
    pos, neg = float(weight[y == 1].sum()), float(weight[y == 0].sum())
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log((pos + 1) / (neg + 1)))

    def loss(a: float, b: float) -> float:
        z = a * margin + b
        return float((weight * (np.logaddexp(0, z) - target * z)).sum())

    for _ in range(50):
        p = logistic(a * margin + b)
        d, w = weight * (p - target), weight * p * (1 - p) + 1e-9
        g = np.array([(d * margin).sum(), d.sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-6, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step, t = np.linalg.solve(h, g), 1.0
        while t > 1e-6 and loss(a - t * step[0], b - t * step[1]) > loss(a, b):
            t /= 2
        a, b = a - t * step[0], b - t * step[1]
        if np.abs(g).max() < 1e-6 or t <= 1e-6:
            break
    return float(a), float(b)
