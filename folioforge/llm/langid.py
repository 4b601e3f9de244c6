"""Operator 9: language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A
word's likelihood is the sum over all its segmentations into pieces, by the
forward algorithm; a text's is the product over its words.  The probabilities
are fitted by expectation-maximisation (forward-backward expected counts) on a
sample of at most SAMPLE_DOCS documents of each language outside the held-out
fold.  A character that no piece covers has the floor probability of a piece.

Words are maximal runs of letters, lowered, opened by the vocabulary's word mark, and
are never cut: sums are kept in proportion to those of the prefixes just before, so
words of any length neither underflow nor need more than their arcs and sums.

Defined results: null, empty or letterless text gives `und` and score 0; equal
likelihoods go to the alphabetically first language; null languages and null ids
are not learnt from; without any learnable row every text gives `und`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

VOCABULARY = "piece_bpe_32k.model"
SAMPLE_DOCS = 400
ROUNDS = 3
FLOOR = 1e-7
UNDETERMINED = "und"
CACHED_WORDS = 400_000
BLOCK = 240_000  # characters of words of one length worked on at a time, one word at least
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes: (n, length + 1)."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for j in range(codes.shape[1]):
        out[:, j + 1] = out[:, j] * _STEP + C.mix(codes[:, j].astype(np.uint64) + np.uint64(1))
    return out


class Pieces:
    """The vocabulary's lower-case letter pieces, found by the hash of a span."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # the word mark U+2581 stands for the opening of a word
        kept = sorted({p for p in (model.id_to_piece(i) for i in range(model.get_piece_size())) if p and p == p.lower() and all(c.isalpha() for c in p.removeprefix("▁")) and p != "▁"})
        by_hash = sorted((int(_hash(np.array([[ord(c) for c in p]], np.uint32))[0, -1]), k) for k, p in enumerate(kept))
        self.hash = np.array([h for h, _ in by_hash], np.uint64)
        self.index = np.array([k for _, k in by_hash], np.int32)
        self.length = np.array([len(p) for p in kept])
        self.size = len(kept)
        self.longest = int(self.length.max())
        # a direct table of the top bits narrows the search
        self.top = np.uint64(64 - 16)
        self.slot = np.searchsorted(self.hash >> self.top, np.arange((1 << 16) + 1, dtype=np.uint64))
        self.depth = int(np.diff(self.slot).max())

    def find(self, value: np.ndarray) -> np.ndarray:
        """Piece of each hash, or -1."""
        at = self.slot[(value >> self.top).astype(np.int64)]
        out = np.full(value.shape, -1, np.int32)
        for d in range(self.depth):
            k = np.minimum(at + d, self.size - 1)
            hit = self.hash[k] == value
            out[hit] = self.index[k[hit]]
        return out

    def arcs(self, codes: np.ndarray) -> list[np.ndarray]:
        """For words of equal length: arcs[e][l-1] is the piece that ends at e
        with l characters, for each word; size = unknown single character,
        size + 1 = no arc."""
        h, n = _hash(codes), codes.shape[1]
        power = C.powers(int(_STEP), self.longest + 1)
        out = [np.zeros((0, len(codes)), np.int32)]
        for e in range(1, n + 1):
            l = np.arange(1, min(e, self.longest) + 1)
            got = self.find(h[:, e] - h[:, e - l].T * power[l][:, None])
            unknown = np.where(l == 1, self.size, self.size + 1)[:, None]
            out.append(np.where(got >= 0, got, unknown).astype(np.int32))
        return out


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def letter_words(raw: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row offsets, distinct words and the code of each word, of a chunk."""
    text = pc.replace_substring_regex(pc.utf8_lower(raw.cast(pa.large_string())), r"[^\pL]+", " ")
    split = pc.ascii_split_whitespace(text)
    rows = np.asarray(split.offsets, np.int64)
    flat = split.values.slice(rows[0], rows[-1] - rows[0])
    rows = rows - rows[0]
    keep = np.asarray(pc.not_equal(flat, ""), bool)
    rows = np.concatenate([[0], np.cumsum(keep)])[rows]
    words = flat.filter(pa.array(keep)).dictionary_encode()
    return rows, words.dictionary, np.asarray(words.indices, np.int64)


def marked(words: list[str]) -> list[str]:
    return ["▁" + w for w in words]


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of words of equal length: their places and character codes."""
    size = np.fromiter((len(w) for w in words), np.int64, len(words))
    for n in np.unique(size):
        where = np.flatnonzero(size == n)
        step = max(1, BLOCK // int(n))
        for at in range(0, len(where), step):
            part = where[at : at + step]
            yield part, np.array([words[i] for i in part], f"<U{n}").view(np.uint32).reshape(len(part), n)


def forward(arcs: list[np.ndarray], p: np.ndarray) -> np.ndarray:
    """(length + 1, word, language) logs of the sums over all segmentations of the
    prefixes.  p: (size + 2, language), the last row zero."""
    n = len(arcs) - 1
    shape = (arcs[0].shape[1], p.shape[1])
    out = np.zeros((n + 1, *shape))
    before = np.ones((1, *shape))  # sums of the prefixes before, over that of the last one
    for e in range(1, n + 1):
        grown = (before * p[arcs[e]]).sum(axis=0)
        out[e] = out[e - 1] + np.log(grown)
        before = np.concatenate([np.ones((1, *shape)), before / grown])[: len(arcs[min(e + 1, n)])]
    return out


def expected_counts(pc_: Pieces, words: list[str], weight: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected piece counts by language, of words weighted by language."""
    total = np.zeros_like(p)
    for where, codes in by_length(words):
        arcs = pc_.arcs(codes)
        n = len(arcs) - 1
        log = forward(arcs, p)
        # how often a segmentation has a boundary at each place; a piece that ends there
        # has the share of the sum that ends in it
        ends = np.zeros_like(log)
        ends[n] = weight[where]
        for e in range(n, 0, -1):
            m = len(arcs[e])
            back = e - 1 - np.arange(m)
            got = ends[e] * np.exp(log[back] - log[e]) * p[arcs[e]]
            ends[back] += got
            hit = arcs[e] <= pc_.size
            for k in range(p.shape[1]):
                total[:, k] += np.bincount(arcs[e][hit], got[..., k][hit], minlength=len(p))
    return total


def probabilities(count: np.ndarray) -> np.ndarray:
    """Counts to probabilities, every piece at the floor at least."""
    p = count / np.maximum(count.sum(axis=0), 1e-300)
    p = np.maximum(p, FLOOR)
    p[-1] = 0
    return p


def train(langs: list[str], raw: pa.Array, of: np.ndarray, path: str, rounds: int = ROUNDS) -> dict:
    """of: the language index of each text."""
    vocabulary = pieces(path)
    rows, words, code = letter_words(raw)
    lang = np.repeat(of, np.diff(rows))
    weight = np.zeros((len(words), len(langs)))
    np.add.at(weight, (code, lang), 1)
    parts = marked(words.to_pylist())
    p = np.zeros((vocabulary.size + 2, len(langs)))
    # start: pieces as likely as characters of English-like entropy would make them
    p[: vocabulary.size] = np.exp(-1.5 * vocabulary.length)[:, None]
    p = probabilities(p)
    for _ in range(rounds if parts else 0):
        p = probabilities(expected_counts(vocabulary, parts, weight, p) + 1e-3)
    return {"langs": langs, "p": p, "path": path}


def sample(docs: DataFrame, modulus: int, held: int, most: int) -> pa.Table:
    """About `most` documents of each language outside the held-out fold, those
    of the smallest id hash: (doc_id, text, lang)."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (C.fold("doc_id", modulus) != held))
    there = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not there:
        return pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "lang": pa.array([], pa.string())})
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*[F.lit(x) for k, n in there.items() for x in (k, min(1.0, most / n))])
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & (C.fold("doc_id", modulus) != held) & (spread < share[F.col("lang")]))
    return wanted.toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")])


def fit(docs: DataFrame, path: str, modulus: int = 4, held: int = 2, most: int = SAMPLE_DOCS) -> dict:
    got = sample(docs, modulus, held, most)
    langs = sorted(set(got["lang"].to_pylist()))
    place = {k: i for i, k in enumerate(langs)}
    of = np.fromiter((place[k] for k in got["lang"].to_pylist()), np.int64, got.num_rows)
    return train(langs, C.text_bytes(got["text"]), of, path) if langs else {"langs": []}


class Scorer:
    """Log-likelihoods of words under each language, remembered by word."""

    def __init__(self, model: dict):
        self.model, self.place = model, {}
        self.value = np.zeros((1 << 14, len(model["langs"])))

    def learn(self, words: list[str]) -> None:
        vocabulary, p = pieces(self.model["path"]), self.model["p"]
        got = np.empty((len(words), len(self.model["langs"])))
        for where, codes in by_length(marked(words)):
            got[where] = forward(vocabulary.arcs(codes), p)[-1]
        base = len(self.place)
        while base + len(words) > len(self.value):
            self.value = np.concatenate([self.value, np.zeros_like(self.value)])
        self.value[base : base + len(words)] = got
        self.place.update(zip(words, range(base, base + len(words)), strict=True))

    def texts(self, raw: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihoods (row, language) and the number of words of each row."""
        rows, words, code = letter_words(raw)
        known = words.to_pylist()
        if self.place and len(self.place) + len(known) > CACHED_WORDS:
            self.place = {}
        self.learn([w for w in known if w not in self.place])
        where = np.fromiter((self.place[w] for w in known), np.int64, len(known))
        n = np.diff(rows)
        out = np.zeros((len(n), self.value.shape[1]))
        if len(code):
            full = np.flatnonzero(n)
            out[full] = np.add.reduceat(self.value[where[code]], rows[:-1][full])
        return out, n


def annotate(docs: DataFrame, model: dict) -> DataFrame:
    """docs with lang_pred and lang_score, the posterior of the language under
    equal priors; docs must not have columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scorer = Scorer(m) if m["langs"] else None
        for rows, raw in C.chunks(batches):
            if scorer is None:
                best, score = [UNDETERMINED] * len(raw), np.zeros(len(raw))
            else:
                like, n = scorer.texts(raw)
                k = like.argmax(axis=1)
                score = 1 / np.exp(like - like.max(axis=1, keepdims=True)).sum(axis=1)
                score[n == 0] = 0
                best = [m["langs"][i] if c else UNDETERMINED for i, c in zip(k, n, strict=True)]
            yield pa.record_batch([*rows.columns, pa.array(best, pa.string()), pa.array(score)], names=names)

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, lang_pred, score) of every document."""
    out = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", "lang_pred", F.col("lang_score").alias("score"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs, vocabulary_path()))
    return out.select("doc_id", (C.fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
