"""Exact operators against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioforge.llm import components, packing, repeats, runs, shingles, substrings, suffixes, tokens

WORD = r"[^\x20\x09-\x0D]+"


def key(rows):
    return sorted(rows, key=repr)


def test_token_files(spark, docs, none, pairs, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokens.vocabulary_path())
    folder = f"file://{tmp_path}/t"
    manifest = tokens.write_token_files(docs, folder, tokens.vocabulary_path(), length=64).collect()
    got = tokens.read_token_files(spark, folder, manifest).collect()
    want, start = [], 0
    for doc_id, text in sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0)):
        want.append((doc_id, [*plain.encode(text, add_special_tokens=False).ids, 1]))
    by_start = sorted(got, key=lambda r: r["start"])
    for r in by_start:
        assert r["start"] == start
        start += r["n_tokens"]
    # equal ids may stand in either order; all else is fixed
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    assert key((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == key((d, len(i), crc(i)) for d, i in want)
    assert [r["doc_id"] for r in by_start] == [d for d, _ in want]
    files = tokens.SequenceFile(f"{tmp_path}/t/{manifest[0]['file']}.arrow")
    ids, mask = files.row(0)
    assert len(ids) == 64 and not ids.flags.owndata and len(mask) == 64
    empty = tokens.write_token_files(none, folder, tokens.vocabulary_path()).collect()
    assert empty == [] and tokens.read_token_files(spark, folder, empty).count() == 0


def test_encoder_forgets(pairs, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "CACHED_WORDS", 5)
    enc = tokens.WordEncoder(tokens.vocabulary_path())
    raw = pa.array([t.encode() for _, t in pairs], pa.large_binary())
    first, offsets = enc.encode(raw)
    again, _ = tokens.WordEncoder(tokens.vocabulary_path()).encode(raw)
    assert (first == again).all() and offsets[-1] == len(first)


def test_packing(docs, none, pairs):
    got = packing.pack(packing.pieces(docs, tokens.vocabulary_path(), 256), 256).toPandas()
    enc = tokens.WordEncoder(tokens.vocabulary_path())
    import pyarrow as pa

    ids, offsets = enc.encode(pa.array([t.encode() for _, t in pairs], pa.large_binary()))
    assert got.length.sum() == len(ids) and len(got) == (-(-np.diff(offsets) // 256)).sum()
    got = got.sort_values(["sequence_id", "offset"])
    run = got.groupby("sequence_id").length.cumsum()
    assert (run - got.length == got.offset).all() and run.max() <= 256
    assert got.sequence_id.nunique() <= np.ceil(len(ids) / 256) + 1
    assert packing.pack(packing.pieces(none, tokens.vocabulary_path())).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    cap = int(rng.integers(10, 400))
    count = np.zeros(cap + 1, np.int64)
    lengths = rng.integers(1, cap + 1, int(rng.integers(1, 3000)))
    np.add.at(count, lengths, 1)
    used, sequences = np.zeros_like(count), 0
    patterns = packing.plan(count, cap)
    for pattern, copies in patterns:
        assert 0 < sum(l * k for l, k in pattern.items()) <= cap
        sequences += copies
        for l, k in pattern.items():
            used[l] += k * copies
    assert (used == count).all()
    assert sequences <= sum(c for _, c in packing.best_fit(count, cap))
    slots = packing.intervals(patterns, cap)
    assert len(set(zip(slots["length"], slots["rank"], strict=True))) == len(slots["rank"])


def fewest(sizes, cap):
    """Bins of an optimal packing, by search."""
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def put(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for room in sorted({r for r in rooms if r >= sizes[i]}):
            at = rooms.index(room)
            put(i + 1, [*rooms[:at], room - sizes[i], *rooms[at + 1 :]])
        put(i + 1, [*rooms, cap - sizes[i]])

    put(0, [])
    return best


def test_small_instances_are_optimal():
    rng = np.random.default_rng(5)
    over = 0
    for _ in range(60):
        cap = int(rng.integers(8, 60))
        sizes = rng.integers(1, cap + 1, int(rng.integers(1, 11))).tolist()
        count = np.bincount(sizes, minlength=cap + 1)
        got, least = sum(c for _, c in packing.plan(count, cap)), fewest(sizes, cap)
        assert least <= got <= min(least + 1, sum(c for _, c in packing.best_fit(count, cap)))
        over += got - least
    assert over <= 1


def test_programs_carry_the_packing(spark, sf):
    """Of the test documents, and of lengths on which best fit is poor."""
    size = packing.pieces(spark.read.parquet(f"{sf}/documents.parquet"), tokens.vocabulary_path()).groupBy("length").count().collect()
    real = np.zeros(packing.CAPACITY + 1, np.int64)
    for r in size:
        real[r["length"]] = r["count"]
    dealt = np.bincount(np.random.default_rng(0).integers(600, 1600, 6000), minlength=packing.CAPACITY + 1)
    for count, less in ((real, 0), (dealt, 10)):
        solved, rest = packing.passes(count)
        carried, left = (sum(c for _, c in p) for p in (solved, rest))
        assert carried >= 0.9 * (carried + left)
        assert carried + left <= sum(c for _, c in packing.best_fit(count, packing.CAPACITY)) - less


def brute_windows(items, width):
    seen = Counter(tuple(w[i : i + width]) for w in items for i in range(len(w) - width + 1))
    out = []
    for w in items:
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("hot", "bits"), [(50_000, 18), (2, 14)])
def test_word_windows(docs, pairs, hot, bits):
    items = [re.findall(WORD, t) for _, t in pairs]
    gone = brute_windows(items, 35)
    want = [(d, len(w), int(g.sum()), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for (d, _), w, g in zip(pairs, items, gone, strict=True)]
    got = substrings.remove_windows(docs, hot=hot, bits=bits).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert key(tuple(r) for r in got) == key(want)


@pytest.mark.parametrize(("hot", "bits", "crowd"), [(50_000, 18, 48), (2, 14, 48), (50_000, 18, 1)])
def test_byte_strings(spark, docs, pairs, hot, bits, crowd):
    short = [(d, t[:6000]) for d, t in pairs]
    few = spark.createDataFrame([(d, t, "x") for d, t in short], "doc_id long, text string, k string")
    items = [t.encode() for _, t in short]
    seen = Counter(w[i : i + 400] for w in items for i in range(len(w) - 399))
    want = []
    for (d, _), w in zip(short, items, strict=True):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 399):
            if seen[w[i : i + 400]] > 1:
                gone[i : i + 400] = True
        opens = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((d, len(w), int(gone.sum()), opens, hashlib.sha256(np.frombuffer(w, np.uint8)[~gone].tobytes()).hexdigest()))
    passages = [int(g.sum()) for g in brute_windows([re.findall(WORD, t) for _, t in short], 51)]
    got = suffixes.remove_repeats(few, hot=hot, bits=bits, crowd=crowd).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words").collect()
    assert key(tuple(r) for r in got) == key((*w, p) for w, p in zip(want, passages, strict=True))


def without_words(text, gone):
    """The text without some words, each with the space behind it."""
    found = list(re.finditer(WORD, text))
    if not found:
        return text
    ends = [m.start() for m in found[1:]] + [len(text)]
    return text[: found[0].start()] + "".join(text[m.start() : e] for m, e, g in zip(found, ends, gone, strict=True) if not g)


@pytest.mark.parametrize(("hot", "crowd"), [(50_000, 48), (2, 48), (50_000, 1)])
def test_passages(spark, docs, pairs, hot, crowd):
    """Repeated passages of 51 words under 400 bytes and of 50, at either end, twice
    in a text, across a text's other words, beside all the awkward texts."""
    rng = np.random.default_rng(11)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 500, n))
    just, less, ends = word(51), word(50), word(60)
    assert len(just) < 250
    rows = [(100, f"{word(9)}\n{just} {word(30)}"), (101, f"{word(20)} {just.replace(' ', '  ')}"), (102, just), (103, f"{word(5)} {less} {word(5)}"), (104, less), (105, f"{ends} {word(80)} {ends}\t"), (106, f"x {ends[: len(ends) // 2]}")]
    rows += [(200 + i, f"{word(i % 7 + 1)} {just} {word(70)}") for i in range(60)]
    rows += pairs
    df = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, spans string")
    gone = brute_windows([re.findall(WORD, t) for _, t in rows], 51)
    assert gone[0].sum() >= 51 and gone[2].sum() == 51 and not gone[3].any() and gone[5].sum() == 120
    want = [(d, without_words(t, g)) for (d, t), g in zip(rows, gone, strict=True)]
    got = suffixes.remove_passages(df, hot=hot, crowd=crowd).select("doc_id", "kept").collect()
    assert key(tuple(r) for r in got) == key(want)


def test_suffix_family_crowd_equals_pairs():
    """Random texts over two letters around one anchor, in several batches."""
    rng = np.random.default_rng(3)
    gram, width = 4, 12
    texts = {}
    while len(texts) < 90:
        lead = int(rng.integers(0, width - gram + 1))
        left = bytes(rng.choice([97, 98], lead).tolist())
        right = bytes(rng.choice([97, 98], int(rng.integers(width - lead - gram, width - gram + 1))).tolist())
        texts.setdefault(left + b"ANCH" + right, lead)
    results = []
    for crowd, batch in ((10**6, 200), (1, 200), (1, 7), (10**6, 7)):
        family, units = suffixes.IndexFamily(width, gram, crowd=crowd), [suffixes.Unit(t, l, width, b"x" * 12) for t, l in texts.items()]
        for at in range(0, len(units), batch):
            family.add([(u.suffix, u) for u in units[at : at + batch]])
        assert sum(map(len, family.levels)) == len(units)
        results.append([u.flag.tolist() for u in units])
    assert results[0] == results[1] == results[2] == results[3]
    windows = Counter(t[i : i + width] for t in texts for i in range(max(0, len(t) - width + 1)))
    for flags, t in zip(results[0], texts, strict=True):
        for i in range(len(t) - width + 1):
            # only strings that hold the anchor are this task's to settle
            if i <= texts[t] <= i + width - gram:
                assert flags[i] == (windows[t[i : i + width]] > 1)


def test_repeats_of_nothing(none, spark):
    for op in (substrings.remove_windows, suffixes.remove_repeats, suffixes.remove_passages, shingles.similar):
        assert op(none).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert substrings.remove_windows(one).first()["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert tuple(shingles.similar(one).select("n_shingles", "component_id").first()) == (0, 1)


def shingle_set(text, k):
    w = re.findall(WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), text))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_similar(pairs, k, num, den):
    sets = [shingle_set(t, k) for _, t in pairs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(pairs):
        ids.setdefault(find(i), []).append(d)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(pairs, sets, strict=True))]


@pytest.mark.parametrize(("k", "num", "den"), [(4, 85, 100), (5, 4, 5)])
def test_similar(docs, pairs, k, num, den):
    got = shingles.similar(docs, k, num, den).select("doc_id", "n_shingles", "component_id").collect()
    assert key(tuple(r) for r in got) == key(brute_similar(pairs, k, num, den))


@pytest.mark.parametrize(("near", "run"), [(1, 3), (1, 20_000), (8, 20_000)])
def test_similar_clusters(spark, near, run, monkeypatch):
    """Groups of near-copies, each with its own edits, and passages in common."""
    monkeypatch.setattr(shingles, "NEAR", near)
    monkeypatch.setattr(shingles, "RUN", run)
    rng = np.random.default_rng(near)
    vocabulary = [f"v{i}" for i in range(60)]
    rows = []
    shared = rng.choice(vocabulary, 30).tolist()
    for group in range(6):
        base = rng.choice(vocabulary, 80).tolist() + shared
        for _ in range(int(rng.integers(1, 30))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 6))):
                copy[int(rng.integers(0, len(copy)))] = f"e{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(shared)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingles.similar(df, 4, 85, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert key(tuple(r) for r in got) == key(brute_similar(rows, 4, 85, 100))


def near_copies(rng, groups, most, edits):
    """Distinct sets around a base for each group, and all links at 0.85."""
    sets = {}
    for _ in range(groups):
        base = rng.choice(1_000, int(rng.integers(20, 120)), replace=False).tolist()
        for _ in range(int(rng.integers(1, most))):
            own = set(base) - set(rng.choice(base, int(rng.integers(0, edits)), replace=False).tolist())
            sets[tuple(sorted(own | set(rng.integers(0, 9_000, int(rng.integers(0, edits))).tolist()) or {1}))] = None
    sets = list(sets)
    link = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * (both := len(set(sets[i]) & set(sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - both)}
    return sets, link


def classes_by(links, root):
    """Which rows are one component, by links and equal roots."""
    at = {v: v for v in range(len(root))}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, j in [*links, *((i, root.index(r)) for i, r in enumerate(root))]:
        at[find(i)] = find(j)
    lead = [find(x) for x in range(len(root))]
    return [lead.index(x) for x in lead]


@pytest.mark.parametrize("seed", range(40))
def test_links_of_a_run(seed, monkeypatch):
    """All links that join components, none that is not one, and few of them."""
    rng = np.random.default_rng(seed)
    monkeypatch.setattr(runs, "SMALL", [0, 10, 200][seed % 3])
    monkeypatch.setattr(runs, "REFERENCES", [1, 3, 16][seed // 3 % 3])
    monkeypatch.setattr(runs, "WORK", [1, 60, 500_000][seed // 9 % 3])
    sets, link = near_copies(rng, int(rng.integers(1, 5)), 25, 9)
    root = rng.integers(0, len(sets), len(sets)).tolist()
    n = np.array([len(s) for s in sets])
    got = [tuple(sorted(p)) for p in runs.Run(shingles.Rule(4, 85, 100), n, np.array(root), np.concatenate([np.array(s) for s in sets])).links().tolist()]
    assert set(got) <= link and classes_by(got, root) == classes_by(link, root)


def test_near_copies_leave_their_run_as_few_rows(spark):
    """600 near-copies, most pairs of them too far apart: what comes out does not grow
    with the pairs."""
    rng = np.random.default_rng(3)
    base, sets = list(range(147)), []
    for i in range(600):
        own = set(base)
        for at in rng.integers(0, 143, int(rng.integers(2, 6))):
            own = own - set(range(at, at + 4)) | {10_000 + 50 * i + int(at) % 50 + x for x in range(4)}
        sets.append(sorted(own))
    link = {(i, j) for j in range(600) for i in range(j) if 100 * (both := len(set(sets[i]) & set(sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - both)}
    rows = spark.createDataFrame([(1, len(s), i, i, 0, 0, s) for i, s in enumerate(sets)], "token long, n long, c long, root long, side long, cell long, members array<long>")
    got = [tuple(r) for r in shingles.links_of_runs(rows, shingles.Rule(4, 85, 100)).collect()]
    assert set(got) <= link and 0 < len(got) < 1_200
    assert classes_by(got, list(range(600))) == classes_by(link, list(range(600)))


def test_similar_long_sets(spark, monkeypatch):
    """Sets of over LONG shingles are paired beside the shorter ones of a run."""
    monkeypatch.setattr(shingles, "NEAR", 1)
    monkeypatch.setattr(shingles, "LONG", 95)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(3):
        base = [f"v{i}" for i in rng.integers(0, 900, 90)]
        for _ in range(25):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = f"e{rng.integers(0, 9)}"
            copy += [f"t{i}" for i in range(int(rng.integers(0, 16)))]
            rows.append((len(rows), " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingles.similar(df, 4, 85, 100).select("doc_id", "n_shingles", "component_id").collect()
    assert key(tuple(r) for r in got) == key(brute_similar(rows, 4, 85, 100))


def test_local_roots_keep_what_is_joined():
    """Random graphs, against labels spread edge by edge."""
    rng = np.random.default_rng(0)
    graphs = [(13, np.array([9, 8, 5, 5, 7, 7, 5, 5, 12, 12, 4, 3, 4]), np.array([8, 12, 10, 6, 12, 6, 3, 9, 6, 1, 12, 2, 0]))]  # a join was lost here
    graphs += [(n, *rng.integers(0, n, (2, int(rng.integers(1, 70))))) for n in rng.integers(2, 60, 300).tolist()]
    for n, a, b in graphs:
        low = np.arange(n)
        for _ in range(n):
            np.minimum.at(low, a, low[b])
            np.minimum.at(low, b, low[a])
        assert components.local_roots(a, b, n).tolist() == low.tolist()


def test_long_runs_meet_in_cells(spark):
    """Every two rows of a run meet, runs within one root are left out."""
    rows = spark.range(300).select((F.col("id") % 3).alias("token"), F.lit(90).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"), F.col("id").alias("c"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("root"))
    cells = shingles.in_cells(rows, 13)
    assert cells.select("token").distinct().count() == 2
    assert cells.groupBy("token", "cell").count().agg(F.max("count")).first()[0] < 60
    got = {tuple(r) for r in shingles.across_runs(cells, shingles.Rule(4, 85, 100)).collect()}
    assert got == {(i, j) for i in range(300) for j in range(i + 3, 300, 3) if i % 3}


def test_runs_in_parts(spark):
    """A run of over 50,000 rows is paired as one of fewer is, and is open."""
    rows = spark.range(120_000).select(F.lit(5).cast("long").alias("token"), F.lit(90).cast("long").alias("n"), F.lit(0).cast("long").alias("pos"), F.col("id").alias("c"), F.lit(False).alias("many"))
    got = shingles.near_runs(rows, shingles.Rule(4, 85, 100)).distinct()
    assert [r["token"] for r in got.filter("b is null").collect()] == [5]
    pairs = got.filter("b is not null")
    assert pairs.count() == sum(120_000 - d for d in range(1, shingles.NEAR + 1)) and pairs.agg(F.max(F.col("b") - F.col("a"))).first()[0] == shingles.NEAR


def test_token_runs_have_a_deal_of_their_own(spark):
    """Adaptive execution may split what a join on the token below has dealt, so the
    planner must not take that deal for the one of the runs."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).select(*(F.col("id").alias(c) for c in ("c", "n", "pos", "token")), F.lit(True).alias("many"))
        joined = rows.join(rows.select("token").distinct(), "token", "left_semi")
        plan = shingles.near_runs(joined, shingles.Rule(4, 85, 100))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "REPARTITION_BY_NUM" in plan


def test_units_anchor_equal_windows_alike():
    rng = np.random.default_rng(0)
    symbols = rng.integers(0, 4, 4000).astype(np.uint64)
    symbols[3000:3500] = symbols[100:600]
    rolling = repeats.Rolling(symbols * np.uint64(0x9E3779B97F4A7C15))
    u = repeats.units(rolling, np.array([0, 2000, 4000]), 50, 10)
    starts = u.windows()
    assert starts.tolist() == [*range(1951), *range(2000, 3951)]
    anchor = np.repeat(u.anchor, u.count)
    by = {}
    for s, a in zip(starts.tolist(), anchor.tolist(), strict=True):
        assert by.setdefault(symbols[s : s + 50].tobytes(), a) == a
