"""The stages, each against a brute-force version on its own input."""

import re

import numpy as np
import pytest
from test_texts import WORD, brute_similar, brute_windows, without_words

import corpus_pipeline as P
from folioforge.llm import common


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    words = [f"p{i}" for i in range(90)]
    item = " ".join(f"q{i}" for i in range(30))
    passage = " ".join(f"t{i}" for i in range(51))  # 193 bytes
    rng = np.random.default_rng(0)
    rows = []
    for i in range(40):
        own = " ".join(rng.choice(words, 120).tolist())
        if i % 10 == 3:
            own = own + " " + passage + " " + " ".join(rng.choice(words, 20).tolist())
        if i in (7, 8):
            own += " " + item
        rows.append((i, own, "en", "s", len(own)))
    rows += [(50, rows[0][1], "en", "s", 1), (51, rows[1][1] + " more", "en", "s", 1), (52, None, None, None, None), (53, "123 ...", "en", "s", 1), (54, "", None, "s", 0), (None, rows[2][1], "en", "s", 1), (50, rows[0][1], "en", "s", 1)]
    rows = [(*r, "clash", i) for i, r in enumerate(rows)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, k string, spans int").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs = common.table(spark, folder, "documents")
    got = {}
    for name, stage in P.STAGES:
        before = [tuple(r)[:5] for r in docs.collect()]
        docs = common.stored(stage(spark, docs, folder), name)
        got[name] = before, [tuple(r) for r in docs.collect()]
        if name != "packed":
            assert tuple(docs.columns) == P.COLUMNS
    before, after = got["language_id"]
    assert sorted(after, key=repr) == sorted((r for r in before if re.search("[a-z]", r[1] or "")), key=repr)
    before, after = got["near_duplicates"]
    groups = brute_similar([r[:2] for r in before], 5, 4, 5)
    assert sorted((r[0] for r in after), key=repr) == sorted({g[2] for g in groups}, key=repr)
    before, after = got["repeated_passages"]
    assert sorted(r[0] for r in after) == sorted(r[0] for r in before)
    gone = brute_windows([re.findall(WORD, r[1]) for r in before], 51)
    assert sum("t7 t8" in r[1] for r in before) >= 3 and any(g.any() for g in gone) and not any("t7 t8" in r[1] for r in after)
    assert sorted((r[0], r[1]) for r in after) == sorted((r[0], without_words(r[1], g)) for r, g in zip(before, gone, strict=True))
    assert all(r[4] == len(r[1]) for r in after)
    before, after = got["benchmark_free"]
    assert {r[0] for r in before} - {r[0] for r in after} == {7, 8}
    before, after = got["packed"]
    assert {r[0] for r in after} == {r[0] for r in before}
    assert sorted(tuple(r)[:3] for r in P.run(spark, folder).collect()) == sorted(r[:3] for r in after)


def test_near_duplicates_without_own_ids(spark):
    """Unlike texts whose ids are null or equal all stay; their near copies go."""
    text = {name: " ".join(f"{name}{i}" for i in range(60)) for name in "abcdefg"}
    rows = [(None, text["a"]), (None, text["b"]), (None, text["b"] + " more"), (7, text["c"]), (7, text["d"]), (7, text["d"]), (8, text["e"]), (None, text["e"]), (7, text["f"]), (3, text["f"] + " more"), (3, text["g"])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"][0]) for r in P.near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(None, "a"), (None, "b"), (7, "c"), (7, "d"), (8, "e"), (3, "f"), (3, "g")], key=repr)


def test_empty(spark, folder):
    docs = common.table(spark, folder, "documents").limit(0)
    for name, stage in P.STAGES:
        docs = common.stored(stage(spark, docs, folder), name)
        assert docs.count() == 0, name
