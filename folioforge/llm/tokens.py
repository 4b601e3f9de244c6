"""Operator 4: token ids in Arrow files of fixed-size lists.

`write_token_files` encodes every document, appends the end id and writes the id
stream, cut into rows of `length` ids, as Arrow IPC files: two columns,
`ids fixed_size_list<uint16|uint32>` and `mask fixed_size_list<bool>`, in batches
of a fixed number of rows, uncompressed, so any row of any batch is a zero-copy
slice of the mapped file.  Beside each file lies `<part>.docs.arrow` with
(doc_id, start, n_tokens).  `read_token_files` maps them back.

Defined results: null or empty text gives the end id alone; an empty table gives
no files and no rows; repeated doc_ids stay separate rows, ties in the order of
a hash of the text; null ids come first; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

END_ID = 1
SEQUENCE = 2048
ROWS_A_BATCH = 64
CACHED_WORDS = 1_200_000
VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts word by word with a memory of words already seen.

    Exact for vocabularies whose pre-tokenizer drops white space, never matches
    across it and parts letters from stops, and whose normalizer lowers case: the
    ids of a text are those of its words in turn, and a word that ends in stops
    after an ASCII letter is its head and its stops.  Words are known by 64-bit
    hashes that leave out ASCII case, but for words with `<`, which may hold a
    special token.  The memory holds CACHED_WORDS words at most (some 30 bytes
    each) and then starts anew.
    """

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.end_id = end_id
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted
        self.begin = np.zeros(0, np.int64)
        self.width = np.zeros(0, np.int64)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _learn(self, value: np.ndarray, words: list[str]) -> None:
        """value: their hashes, sorted and new."""
        begin, width = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for at in range(0, len(words), 20_000):
            for k, got in enumerate(self.tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False), at):
                ids = got.ids
                while self.used + len(ids) > len(self.ids):
                    self.ids = np.resize(self.ids, 2 * len(self.ids))
                self.ids[self.used : self.used + len(ids)] = ids
                begin[k], width[k] = self.used, len(ids)
                self.used += len(ids)
        where = np.searchsorted(self.known, value)
        self.known, self.begin, self.width = (np.insert(old, where, new) for old, new in ((self.known, value), (self.begin, begin), (self.width, width)))

    def _parts(self, w: C.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of heads and tails of all words, in turn."""
        head = w.ends.copy()
        stop = (w.data == 46) | (w.data == 44)
        while (more := (head - 1 > w.starts) & stop[head - 1]).any():
            head[more] -= 1
        letter = ((w.data | 32) >= 97) & ((w.data | 32) <= 122)
        opens = np.concatenate([[0], np.cumsum(w.data == 60)])
        special = opens[w.ends] > opens[w.starts]
        whole = special | ~letter[head - 1]
        head[whole] = w.ends[whole]
        start, end = np.stack([w.starts, head], axis=1).reshape(-1), np.stack([head, w.ends], axis=1).reshape(-1)
        value = w.spans(start, end)
        if special.any():
            exact = np.flatnonzero(special)
            value[2 * exact] = C.mix(C.Words(w.raw).hash[exact] ^ np.uint64(0x5851F42D4C957F2D))
        return start, end, value

    def encode(self, raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk, each text's closed by the end id, and the n+1
        offsets of the texts in them."""
        w = C.Words(raw, lower=True)
        rows = 2 * w.first
        start, end, value = self._parts(w)
        full = np.flatnonzero(end > start)
        some, first, code = np.unique(value[full], return_index=True, return_inverse=True)
        if len(self.known) + len(some) > CACHED_WORDS and len(self.known):
            self._forget()
        at = np.minimum(np.searchsorted(self.known, some), max(0, len(self.known) - 1))
        new = self.known[at] != some if len(self.known) else np.ones(len(some), bool)
        if new.any():
            data, show = w.data.tobytes(), full[first[new]]
            self._learn(some[new], [data[a:b].decode() for a, b in zip(start[show].tolist(), end[show].tolist(), strict=True)])
        at = np.searchsorted(self.known, some)
        width, begin = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        width[full], begin[full] = self.width[at][code], self.begin[at][code]
        total = np.concatenate([[0], np.cumsum(width)])
        ends = total[rows[1:]] + np.arange(1, len(rows))
        out = np.empty(ends[-1] if len(ends) else 0, np.uint32)
        where = np.arange(total[-1]) + np.repeat(np.repeat(np.arange(len(rows) - 1), np.diff(rows)), width)
        out[where] = self.ids[np.arange(total[-1]) + np.repeat(begin - total[:-1], width)]
        out[ends - 1] = self.end_id
        return out, np.concatenate([[0], ends])


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int = END_ID) -> WordEncoder:
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


class SequenceWriter:
    """Cuts an id stream into fixed-size rows and appends them to an IPC file;
    the last row is padded with id 0 under a false mask."""

    def __init__(self, sink, dtype, length: int, rows: int = ROWS_A_BATCH):
        self.dtype, self.length, self.rows = np.dtype(dtype), length, rows
        kind = pa.from_numpy_dtype(self.dtype)
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(sink, self.schema)
        self.rest, self.total = [], 0
        self.waiting = 0

    def add(self, ids: np.ndarray) -> None:
        self.rest.append(ids.astype(self.dtype))
        self.waiting += len(ids)
        self.total += len(ids)
        if self.waiting >= self.length * self.rows:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, self.dtype)
        step = self.length * self.rows
        full = len(ids) if last else len(ids) // step * step
        for at in range(0, full, step):
            part = ids[at : at + step]
            pad = -len(part) % self.length
            mask = np.ones(len(part) + pad, bool)
            if pad:
                mask[len(part) :] = False
                part = np.concatenate([part, np.zeros(pad, self.dtype)])
            self.file.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(part), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))
        self.rest = [ids[full:]]
        self.waiting = len(ids) - full

    def close(self) -> None:
        self._flush(True)
        self.file.close()


class SequenceFile:
    """Random access to a written file: `row(i)` is a zero-copy view of the ids
    and the mask of sequence i; `ids(a, b)` the ids of a span of the stream."""

    def __init__(self, source):
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self._at, self._batch = -1, None

    def batch(self, i: int) -> pa.RecordBatch:
        if i != self._at:
            self._at, self._batch = i, self.file.get_batch(i)
        return self._batch

    def row(self, i: int, rows: int = ROWS_A_BATCH) -> tuple[np.ndarray, pa.Array]:
        b, r = self.batch(i // rows), i % rows
        return b.column(0).flatten().to_numpy(zero_copy_only=True)[r * self.length : (r + 1) * self.length], b.column(1)[r].values

    def ids(self, start: int, stop: int, rows: int = ROWS_A_BATCH) -> np.ndarray:
        step, parts = self.length * rows, []
        while start < stop:
            k = start // step
            values = self.batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            to = min(stop, (k + 1) * step)
            parts.append(values[start - k * step : to - k * step])
            start = to
        return np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def _open_out(path: str):
    fs, place = pafs.FileSystem.from_uri(path)
    fs.create_dir(place.rpartition("/")[0], recursive=True)
    return fs, place


def write_token_files(docs: DataFrame, folder: str, path: str, length: int = SEQUENCE, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Write the files and return the manifest (part, file, n_docs, n_tokens), a
    row a file.  Files are named by attempt and only those in the manifest count,
    so a task that is lost or runs twice does no harm."""
    spark = docs.sparkSession
    parts = parts or C.partitions(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path, end_id), TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer = sink = None
        ids, starts, sizes, at = [], [], [], 0
        for rows, raw in C.chunks(batches):
            if writer is None:
                fs, place = _open_out(f"{folder}/{name}.arrow")
                sink = fs.open_output_stream(place)
                writer = SequenceWriter(sink, np.uint16 if enc.size <= 1 << 16 else np.uint32, length)
            got, offsets = enc.encode(raw)
            writer.add(got)
            ids.append(rows.column(0))
            starts.append(at + offsets[:-1])
            sizes.append(np.diff(offsets))
            at += offsets[-1]
        if writer is None:
            return
        writer.close()
        sink.close()
        index = pa.table({"doc_id": pa.chunked_array(ids), "start": np.concatenate(starts), "n_tokens": np.concatenate(sizes)})
        fs, place = _open_out(f"{folder}/{name}.docs.arrow")
        with fs.open_output_stream(place) as out, pa.ipc.new_file(out, index.schema) as file:
            file.write_table(index)
        yield pa.record_batch({"part": pa.array([task.partitionId()], pa.int32()), "file": [name], "n_docs": pa.array([index.num_rows], pa.int64()), "n_tokens": pa.array([int(at)], pa.int64())})

    # the range sort samples its keys to the driver: a hash there, not the text
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.mapInArrow(write, "part int, file string, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.
    manifest: the collected rows, one a file, so as many as partitions."""
    base, rows = 0, []
    for m in sorted(manifest, key=lambda m: m["part"]):
        rows.append((m["file"], base))
        base += m["n_tokens"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = pafs.FileSystem.from_uri(f"{folder}/{name}.arrow")
                opened = pa.memory_map(place) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(place)
                ids = SequenceFile(opened)
                with fs.open_input_file(place.removesuffix(".arrow") + ".docs.arrow") as source:
                    index = pa.ipc.open_file(source).read_all()
                start, size = index["start"].to_numpy(), index["n_tokens"].to_numpy()
                crc = np.fromiter((C.ids_crc32(ids.ids(a, a + n)) for a, n in zip(start, size, strict=True)), np.int64, len(start))
                yield from pa.table({"doc_id": index["doc_id"], "start": start + base, "n_tokens": size, "ids_crc32": crc}).combine_chunks().to_batches()

    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.createDataFrame(rows, "file string, base long").repartition(len(rows))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = C.fresh_path(spark, "tokens")
    docs = C.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    manifest = write_token_files(docs, folder, vocabulary_path()).collect()
    return read_token_files(spark, folder, manifest)
