"""Trained operators, alignment, vectors."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioforge.llm import common, components, decontaminate, langid, quality, toxicity, vectors


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))] + [(i, i + 1) for i in range(300, 340)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {n: find(n) for n in root if find(n) != n} == got
    assert components.components(df.limit(0)).count() == 0
    a, b = np.array(edges).T
    local = components.local_roots(a, b, 341)
    assert all(local[n] == find(n) for n in root)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, None if i == 3 else (i or 0) % 2, (i or 0) % 2) for i in (*range(1, 19), 4, None)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scores_awkward_rows(op, docs, none, labels, pairs):
    label = "quality" if op is quality else "toxic"
    got = op.score(docs, op.fit(docs, labels, label)).collect()
    assert len(got) == len(pairs)
    assert all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert op.score(none, op.fit(none, labels.limit(0), label)).count() == 0
    bare = op.score(docs, op.fit(docs, labels.filter(f"{label} = 1"), label)).collect()
    assert {r["score"] for r in bare} == {1.0}
    assert {r["score"] for r in op.score(docs, op.fit(docs, labels.limit(0), label)).collect()} == {0.5}


def test_toxicity_held_out(spark, sf):
    docs, labels = common.table(spark, sf.replace("0.01", "0.1"), "documents"), common.table(spark, sf.replace("0.01", "0.1"), "labels")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").filter(common.fold("doc_id", 5) == 0).toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93
    assert got[got.toxic == 0].predicted.mean() < 0.03


def test_quality_held_out(spark, sf):
    docs, labels = common.table(spark, sf.replace("0.01", "0.1"), "documents"), common.table(spark, sf.replace("0.01", "0.1"), "labels")
    got = quality.score(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter(common.fold("doc_id", 4) == 2).toPandas()
    assert (got.predicted == got.quality).mean() > 0.95


def test_network_gradients():
    """Backpropagation against finite differences."""
    import pyarrow as pa

    raw = pa.array([b"good day to you idiot friend", b"fine words only", b""], pa.large_binary())
    win, m = toxicity.Windows(raw), {k: v.astype(np.float64) for k, v in toxicity.new_model(3).items()}
    y, weight, index = np.array([1, 0, 0]), np.array([1.0, 2.0, 0.5]), win.index(np.arange(3))

    def loss(m):
        z = toxicity.forward(m, toxicity.word_inputs(m, win).astype(np.float64), index)
        return float((weight * (np.logaddexp(0, z) - y * z)).mean())

    g = toxicity.gradients({k: v.astype(np.float32) for k, v in m.items()}, win, index, y, weight)
    rng = np.random.default_rng(0)
    for name in ("out", "query", "attend", "Wf", "Ub", "cb", "word", "gram"):
        flat = np.flatnonzero(np.abs(g[name]).reshape(-1) > 1e-4)
        for i in rng.choice(flat, min(3, len(flat)), replace=False):
            keep, e = m[name].reshape(-1)[i], 1e-3
            m[name].reshape(-1)[i] = keep + e
            up = loss(m)
            m[name].reshape(-1)[i] = keep - e
            down = loss(m)
            m[name].reshape(-1)[i] = keep
            assert g[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * e), rel=0.05, abs=2e-4), name


def test_windows_cover_whole_texts():
    import pyarrow as pa

    raw = pa.array([" ".join(["w"] * n).encode() for n in (0, 1, 31, 32, 33, 48, 49, 1000)], pa.large_binary())
    win = toxicity.Windows(raw)
    for d, n in enumerate((0, 1, 31, 32, 33, 48, 49, 1000)):
        at = win.at[win.doc == d] - sum((0, 1, 31, 32, 33, 48, 49, 1000)[:d])
        size = win.length[win.doc == d]
        assert set().union(*[range(a, a + s) for a, s in zip(at, size, strict=True)]) == set(range(n))


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(2)
    y = np.arange(60) % 2
    rows = [np.unique(np.concatenate([rng.integers(10, 400, 12), [1 if v else 2]])) for v in y]
    ratio = quality.log_count_ratio(rows, y)
    w, b = quality.dual_coordinate_descent(rows, ratio, y)
    margin = np.array([ratio[f] @ w[f] + b for f in rows])
    assert ((margin > 0) == (y == 1)).all() and ratio[1] > 0 > ratio[2]


def test_dual_coordinate_descent_finds_the_optimum():
    """Against the dual's projected gradient, run to convergence."""
    rng = np.random.default_rng(6)
    y = (rng.random(50) < 0.4).astype(int)
    rows = [np.unique(rng.integers(0, 40, 9) + 20 * v) for v in y]
    ratio = quality.log_count_ratio(rows, y)
    w, b = quality.dual_coordinate_descent(rows, ratio, y, epochs=3000)
    x = np.zeros((50, 61))
    for i, f in enumerate(rows):
        size = np.sqrt((ratio[f] ** 2).sum() + 1)
        x[i, f], x[i, 60] = ratio[f] / size, 1 / size
    sign, cap = np.where(y == 1, 1.0, -1.0), np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    q = (x * sign[:, None]) @ (x * sign[:, None]).T
    a, step = np.zeros(50), 1 / np.linalg.eigvalsh(q).max()
    for _ in range(60_000):
        a = np.clip(a - step * (q @ a - 1), 0, cap)
    best = (a * sign) @ x
    loss = lambda v: (v @ v) / 2 + (cap * np.maximum(0, 1 - sign * (x @ v))).sum()
    got = np.append(w[:60], b)
    assert loss(got) <= loss(best) * 1.01 and np.abs(x @ got - x @ best).max() < 0.05
    # the ratio by its definition
    p = [1 + sum(f in r for r, v in zip(rows, y, strict=True) if v) for f in range(60)]
    n = [1 + sum(f in r for r, v in zip(rows, y, strict=True) if not v) for f in range(60)]
    rest = quality.WIDTH - 60
    want = np.log(np.array(p) / (sum(p) + rest)) - np.log(np.array(n) / (sum(n) + rest))
    assert ratio[:60] == pytest.approx(want)


def test_many_short_texts_in_little_memory():
    import tracemalloc

    batch = pa.record_batch({"doc_id": pa.array(range(10_000)), "text": pa.array([f"short text {i}" for i in range(10_000)]), "y": pa.array([i % 2 for i in range(10_000)], pa.int32())})
    tracemalloc.start()
    n = sum(b.num_rows for b in quality.featurise([batch]))
    assert n == 10_000 and tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_language_awkward_rows(docs, none, pairs):
    model = langid.fit(docs, langid.vocabulary_path())
    got = {(r["doc_id"], r["lang_pred"]): r["score"] for r in langid.predict(docs, model).collect()}
    for doc_id in (5, 6, 7, 11):
        assert got[doc_id, "und"] == 0
    assert all(0 <= s <= 1 for s in got.values())
    assert langid.predict(none, model).count() == 0
    blank = langid.fit(none, langid.vocabulary_path())
    assert {r["lang_pred"] for r in langid.predict(docs, blank).collect()} == {"und"}


def test_language_held_out(spark, sf):
    docs = common.table(spark, sf, "documents")
    got = langid.predict(docs, langid.fit(docs, langid.vocabulary_path())).join(docs.select("doc_id", "lang"), "doc_id").filter(common.fold("doc_id", 4) == 2).toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.98


@pytest.mark.parametrize("word", ["▁these", "▁organisation", "▁q" + "the" * 12])
def test_forward_sums_all_segmentations(word):
    """Log-likelihoods, expected counts and held pieces against plain dictionaries."""
    import sentencepiece

    vocabulary = langid.pieces(langid.vocabulary_path())
    model = sentencepiece.SentencePieceProcessor(model_file=langid.vocabulary_path())
    held = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    p = np.random.default_rng(0).random((vocabulary.size + 2, 2))
    p[-1] = 0
    arcs = vocabulary.arcs(np.array([[ord(c) for c in word]], np.uint32))
    n, known = len(word), {}
    for e in range(1, n + 1):
        for l, piece in enumerate(arcs[e][:, 0], 1):
            span = word[e - l : e]
            assert (piece < vocabulary.size) == (span in held and span != "▁")
            known[e - l, e] = p[piece], piece
    assert max(e - s for (s, e), (_, piece) in known.items() if piece < vocabulary.size) >= 3
    ahead, behind = [np.zeros(2) for _ in range(n + 1)], [np.zeros(2) for _ in range(n + 1)]
    ahead[0], behind[n] = np.ones(2), np.ones(2)
    for e in range(1, n + 1):
        ahead[e] = sum(ahead[s] * q for (s, x), (q, _) in known.items() if x == e)
    for s in range(n - 1, -1, -1):
        behind[s] = sum(behind[e] * q for (x, e), (q, _) in known.items() if x == s)
    assert langid.forward(arcs, p)[-1][0] == pytest.approx(np.log(ahead[n]))
    want = np.zeros_like(p)
    for (s, e), (q, piece) in known.items():
        want[piece] += 3 * ahead[s] * q * behind[e] / ahead[n]
    assert langid.expected_counts(vocabulary, [word], np.full((1, 2), 3.0), p) == pytest.approx(want)


def test_forward_of_a_very_long_word():
    vocabulary = langid.pieces(langid.vocabulary_path())
    p = langid.probabilities(np.random.default_rng(0).random((vocabulary.size + 2, 2)))
    got = langid.forward(vocabulary.arcs(np.array([[ord(c) for c in "▁" + "these" * 4000]], np.uint32)), p)[-1]
    assert np.isfinite(got).all() and (got < -1000).all()


def brute_smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_smith_waterman():
    rng = np.random.default_rng(5)
    a, b = rng.integers(2, 6, (40, 9)).astype(np.uint64), rng.integers(2, 6, (40, 17)).astype(np.uint64)
    got, _ = decontaminate.smith_waterman(a, b)
    assert got.tolist() == [brute_smith_waterman(x, y) for x, y in zip(a, b, strict=True)]


def test_decontaminate(spark, docs, none):
    item = [f"q{i}" for i in range(30)]
    edited = [w if i % 6 else "zz" for i, w in enumerate(item)]
    dropped = [w for i, w in enumerate(item) if i % 7 != 3]
    tests = spark.createDataFrame([(1, " ".join(item)), (2, "tiny pair"), (3, None), (None, "x y z"), (4, ""), (4, "...")], "item_id long, text string")
    more = spark.createDataFrame(
        [(100, "pre " * 50 + " ".join(item).upper() + ". post"), (101, "a b c " + ", ".join(edited) + " d"), (102, " ".join(dropped)), (103, "q1 q2 q3 only"), (104, "a Tiny, pair b"), (105, "tiny x pair"), (100, " ".join(item))],
        "doc_id long, text string",
    )
    for block in (1 << 24, 40):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(more.unionByName(docs.select("doc_id", "text")), tests, block_bytes=block).collect()}
        assert got == {(100, 1), (101, 1), (102, 1), (104, 2)}
    assert decontaminate.contaminated(none, tests).count() == 0
    assert decontaminate.contaminated(docs, tests.limit(0)).count() == 0


def test_decontaminate_only_copy_is_edited(spark):
    """Copies without many of the item's grams, one corpus each."""
    item = [f"q{i}" for i in range(50)]
    copies = {
        "every fifth word": [w if i % 5 else f"z{i}" for i, w in enumerate(item)],
        "every fourth word": [w if i % 4 else f"z{i}" for i, w in enumerate(item)],
        "30 % of the words": [w if (i * 7) % 10 > 2 or i < 4 else f"z{i}" for i, w in enumerate(item)],
        "first part": item[:27],
        "last part": item[-26:],
        "words put in": [x for i, w in enumerate(item) for x in ([w, f"z{i}"] if i % 4 == 3 else [w])],
    }
    tests = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for name, words in copies.items():
        alone = spark.createDataFrame([(1, " ".join(["pre"] * 20 + words + ["post"] * 20)), (2, " ".join(item[:20])), (3, "q1 q2 q3")], "doc_id long, text string")
        score = brute_smith_waterman(item, words) / 100
        got = [(r["doc_id"], r["score"]) for r in decontaminate.contaminated(alone, tests).collect()]
        assert score >= decontaminate.THRESHOLD and got == [(1, score)], name


def test_decontaminate_equals_all_alignments(spark, sf):
    """Every item with every whole text."""
    tables = [common.table(spark, sf, t) for t in ("documents", "benchmark")]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontaminate.contaminated(*tables).collect()}
    docs, tests = (t.orderBy(t.columns[0]).collect() for t in tables)
    items = common.Words(common.text_bytes(pa.array([r["text"] for r in tests])), lower=True, gaps=common.PUNCTUATION)
    longest = int(items.count.max())
    codes = np.zeros((len(tests), longest), np.uint64)
    for i in range(len(tests)):
        codes[i, : items.count[i]] = items.hash[items.first[i] : items.first[i + 1]] | np.uint64(2)
    want = {}
    for r in docs:
        w = common.Words(common.text_bytes(pa.array([r["text"]])), lower=True, gaps=common.PUNCTUATION)
        there = np.flatnonzero([len(set(c.tolist()) & set((w.hash | np.uint64(2)).tolist())) >= decontaminate.THRESHOLD * n for c, n in zip(codes, items.count, strict=True)])
        if len(there) and len(w.hash):
            best, _ = decontaminate.smith_waterman(codes[there], np.repeat(w.hash[None] | np.uint64(2), len(there), axis=0))
            for i, score in zip(there, best / (2 * items.count[there]), strict=True):
                if score >= decontaminate.THRESHOLD and items.count[i]:
                    want[r["doc_id"], tests[i]["item_id"]] = float(score)
    assert len(want) > 10 and got == want


def test_every_alignment_that_reaches_the_threshold_counts(monkeypatch):
    """Random texts of few words, so that grams are common: as without the filter of
    passages, and with a few hits at a time."""
    rng = np.random.default_rng(9)
    words = [f"v{i}" for i in range(12)]
    texts = [" ".join(rng.choice(words, int(n)).tolist()) for n in rng.integers(0, 60, 60)]
    items = decontaminate.Items(list(range(20)), common.text_bytes(pa.array([" ".join(rng.choice(words, int(n)).tolist()) for n in rng.integers(0, 25, 20)])))
    w = common.Words(common.text_bytes(pa.array(texts)), lower=True, gaps=common.PUNCTUATION)

    def found(threshold):
        row, item, score, _ = decontaminate.align(w, items, threshold)
        return {(int(r), int(i), float(s)) for r, i, s in zip(row, item, score, strict=True) if s >= 0.5}

    whole = found(0.0)
    assert len(whole) > 20 and found(0.5) == whole
    monkeypatch.setattr(decontaminate, "_HITS", 3)
    monkeypatch.setattr(decontaminate, "_CELLS", 50)
    assert found(0.5) == whole


def test_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 24))
    rows = []
    for i, v in enumerate(base):
        for copy in range(int(rng.integers(1, 7))):
            rows.append((len(rows), [float(x) for x in v + rng.normal(size=24) * 0.03 * copy], int(i % 3)))
        rows.append((len(rows), [float(x) for x in v], int(i % 3)))
    awkward = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 24, 1), (1003, [None] * 24, 1), (1004, [float("nan")] * 24, 1), (1005, [float("inf")] * 24, 1), (1006, rows[0][1], None), (1007, [1.0, 2.0], 1), (1008, [1.0, 2.0], 1), (1009, [5.0], 2), (None, [9.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame([(*r, 0) for r in rows + awkward], "vec_id long, embedding array<float>, label int, links int")
    for block in (1024, 3):
        got = {r["vec_id"]: r for r in vectors.link_vectors(df, block=block).collect()}
        assert len(got) == len(rows) + len(awkward)
        x = vectors.unit(np.array([r[1] for r in rows], np.float32))
        label = np.array([r[2] for r in rows])
        near = (x @ x.T >= 0.98) & (label[:, None] == label)
        assert all(got[i]["n_links"] == near[i].sum() - 1 for i in range(len(rows)))
        root = components.local_roots(*np.nonzero(near), len(rows))
        assert all(got[i]["component_id"] == root[i] and got[i]["kept"] == (root[i] == i) for i in range(len(rows)))
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (*range(1000, 1007), 1009))
        assert got[1008]["component_id"] == 1007 and not got[1008]["kept"]
    assert vectors.link_vectors(df.limit(0)).count() == 0


def test_folds(spark):
    import zlib

    got = spark.range(200).select("id", common.fold("id", 5).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)


def test_vector_recall(spark, sf):
    df = common.table(spark, sf.replace("0.01", "0.1"), "embeddings")
    got = vectors.link_vectors(df).agg(F.sum("n_links")).first()[0]
    pdf = df.toPandas()
    true = 0
    for _, g in pdf.groupby("label"):
        x = vectors.unit(np.stack(g.embedding.to_numpy()))
        true += int((x @ x.T >= 0.98).sum()) - len(x)
    assert got <= true and got >= 0.9 * true
