import json

import pytest
from pyspark.sql import functions as F

from folioforge.operators import entities, facets, ingest, integrity, search, sections
from folioforge.sources import readers, sinks


@pytest.fixture(scope="module")
def notes(spark):
    rows = [
        ("notes", "a", {"tags": ["x", "y"], "level": ["3"]}, "alpha beta"),
        ("notes", "b", {"tags": ["x"], "level": ["ten"]}, "beta"),
        ("books", "c", {}, None),
        ("archive", "d", {"tags": ["z"]}, "old"),
        ("books", "e", None, ""),
    ]
    return spark.createDataFrame(rows, "collection string, path string, meta map<string,array<string>>, body string")


def paths(df):
    return sorted(r["path"] for r in df.collect())


def test_predicates(notes):
    cases = {
        ("tags", "exists"): ["a", "b"],
        ("tags", "missing"): ["c", "e"],
        ("tags", "equals", "y"): ["a"],
        ("tags", "contains", "x"): ["a", "b"],
        ("level", "contains", "e"): ["b"],
        ("level", "matches", "^t"): ["b"],
        ("level", "gte", 3): ["a"],
        ("level", "lte", 2): [],
    }
    for p, want in cases.items():
        assert paths(facets.find(notes, p)) == want, p
    assert paths(facets.find(notes, ("tags", "exists"), scope=("archive",))) == ["d"]
    with pytest.raises(ValueError, match="predicate"):
        facets.predicate("tags", "near")


def test_fields_and_values(notes):
    assert {tuple(r) for r in facets.fields(notes).collect()} == {("tags", 3), ("level", 2)}
    assert {tuple(r) for r in facets.values(notes, "tags").collect()} == {("x", 2), ("y", 1), ("z", 1)}
    assert facets.values(notes, "none").count() == 0


@pytest.fixture(scope="module")
def tables(spark):
    creatures = [("Goblin", "A", 0.25, "humanoid", ["small"], "neutral", ["hill", "cave"], "2014"), ("goblin", "B", 0.5, "fey", ["small"], None, ["hill"], "2024"), ("Ogre", "A", 2.0, "giant", ["large"], "chaotic", None, "2014")]
    spells = [("Web", "A", 2, "conjuration", ["wizard"], True, False, "2014"), ("Alarm", "A", 1, "abjuration", ["wizard", "ranger"], False, True, None)]
    items = [("Rope", "A", "common", "gear", False, "2014"), ("Ring", "A", "rare", "ring", True, None)]
    return {"creature": spark.createDataFrame(creatures, readers.CREATURE), "spell": spark.createDataFrame(spells, readers.SPELL), "item": spark.createDataFrame(items, readers.ITEM)}


def names(df):
    return sorted(r["name"] for r in df.collect())


def test_lookup(tables):
    assert names(entities.lookup(tables, "creature", name="GOBLIN")) == ["Goblin", "goblin"]
    assert names(entities.lookup(tables, "creature", ruleset="either", name="goblin")) == ["goblin"]
    assert names(entities.lookup(tables, "creature", ruleset="2014")) == ["Goblin", "Ogre"]
    assert names(entities.lookup(tables, "creature", cr=(0.3, None))) == ["Ogre", "goblin"]
    assert names(entities.lookup(tables, "creature", environment=["cave", "sea"])) == ["Goblin"]
    assert names(entities.lookup(tables, "spell", level=(1, 1), ritual=True)) == ["Alarm"]
    assert names(entities.lookup(tables, "item", attunement=True, rarity="rare")) == ["Ring"]
    assert names(entities.lookup(tables, "item", partial="op")) == ["Rope"]
    for bad in (lambda: entities.lookup(tables, "vehicle"), lambda: entities.lookup(tables, "item", level=1), lambda: entities.lookup(tables, "item", ruleset="1e")):
        with pytest.raises(ValueError):
            bad()


def test_canonical_else(spark):
    a, b = spark.createDataFrame([(1,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    assert [tuple(r) for r in entities.canonical_else(a, b).collect()] == [(1, "canonical")]
    assert sorted(tuple(r) for r in entities.canonical_else(a.filter("id > 5"), b).collect()) == [(2, "fallback"), (3, "fallback")]


def test_bm25_index_and_scan_agree(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "")], "doc_id long, text string")
    scan = {r["doc_id"]: r["score"] for r in search.bm25(docs, ["A", "c"]).collect()}
    index = {r["doc_id"]: r["score"] for r in search.bm25_indexed(search.postings(docs), search.lengths(docs), ["a", "c"]).collect()}
    assert scan.keys() == index.keys() == {1, 2}
    for k in scan:
        assert scan[k] == pytest.approx(index[k])
    assert search.bm25(docs.limit(0), ["a"]).count() == 0


def test_fusion_and_top(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "doc_id long, rank int")
    b = spark.createDataFrame([(2, 1)], "doc_id long, rank int")
    got = [r["doc_id"] for r in search.top(search.fuse([a, b], "doc_id"), 5, "doc_id").collect()]
    assert got == [2, 1]
    ties = spark.createDataFrame([(5, 1.0), (3, 1.0), (4, None)], "doc_id long, score double")
    assert [r["doc_id"] for r in search.ranked(ties, 2, "doc_id").orderBy("rank").collect()] == [3, 5]


def test_markdown_sections(spark):
    docs = spark.createDataFrame([("p", "intro\n# One\nbody\n## Two\nx\n"), ("q", "# Only\n"), ("r", "plain"), ("s", None), ("t", "")], "path string, body string")
    got = sorted(tuple(r) for r in sections.markdown_sections(docs).collect())
    assert got == [("p", 0, 0, None, "intro\n"), ("p", 1, 1, "One", "body\n"), ("p", 2, 2, "Two", "x\n"), ("q", 1, 1, "Only", ""), ("r", 0, 0, None, "plain")]


def test_plan_spans_overview_faults(spark):
    toc = spark.createDataFrame([("a", 1, "A1"), ("a", 2, "A2")], "slug string, ord int, heading string")
    heads = spark.createDataFrame([("a", 1, "x"), ("b", 1, "B1")], "slug string, ord int, heading string")
    plan = sections.planned(toc, heads, "slug")
    assert sorted((r["slug"], r["heading"], r["origin"]) for r in plan.collect()) == [("a", "A1", "toc"), ("a", "A2", "toc"), ("b", "B1", "heading")]
    spans = sections.page_spans(plan.withColumn("n_pages", F.lit(3)), "slug")
    assert sorted((r["slug"], r["ord"], r["page_from"], r["page_to"]) for r in spans.collect()) == [("a", 1, 1, 3), ("a", 2, 4, 6), ("b", 1, 1, 3)]
    over = {r["slug"]: (r["n_sections"], r["page_to"], r["contents"]) for r in sections.overview(spans).collect()}
    assert over == {"a": (2, 6, ["A1", "A2"]), "b": (1, 3, ["B1"])}
    assert sections.faults(plan, "slug").count() == 0
    broken = spark.createDataFrame([("a", 2, "x"), ("b", 1, " ")], "slug string, ord int, heading string")
    assert sorted(tuple(r) for r in sections.faults(broken, "slug").collect()) == [("a", "ordinals"), ("b", "heading")]
    books = spark.createDataFrame([("a", "h"), ("b", None), ("c", "h")], "slug string, source_hash string")
    assert sorted(tuple(r) for r in ingest.validated(books, broken).collect()) == [("a", "ordinals"), ("b", "hash"), ("b", "heading"), ("c", "sections")]


def test_ingest(spark):
    docs = spark.createDataFrame([(1, "a", "s1"), (2, "b", "s2"), (3, None, "s3"), (4, None, None)], "doc_id long, text string, slug string")
    h = ingest.hashed(docs)
    seen = h.filter("doc_id in (1, 4)")
    assert sorted(r["doc_id"] for r in ingest.changed(h, seen).collect()) == [2, 3]
    manual = spark.createDataFrame([(1, "hand")], "doc_id long, slug string")
    assert [r["slug"] for r in ingest.overridden(docs.select("doc_id", "slug"), manual, "doc_id", "slug").orderBy("doc_id").collect()] == ["hand", "s2", "s3", None]
    steps = ingest.next_steps(spark.createDataFrame([("x",)], "slug string"), F.lit(False)).orderBy("step").collect()
    assert [(r["step"], r["command"]) for r in steps] == [(1, "index-update"), (2, "index-embed")]


def test_index_update_reads_only_changes(spark):
    old = spark.createDataFrame([(1, "a a"), (2, "b"), (3, "c")], "doc_id long, text string")
    now = spark.createDataFrame([(1, "a a"), (2, "bb"), (4, "d")], "doc_id long, text string")
    state = ingest.hashed(old).select("doc_id", "source_hash")
    built = []

    def build(df):
        built.extend(r["doc_id"] for r in df.collect())
        return search.postings(df)

    got = ingest.refreshed_index(search.postings(old), now, state, build)
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in search.postings(now).collect())
    assert sorted(built) == [2, 4]


def test_integrity(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2"), ("n", None)], "k string, v string")
    b = spark.createDataFrame([("y", "3"), ("z", "4"), ("n", None)], "k string, v string")
    assert sorted(tuple(r) for r in integrity.drift(a, b, "k", "v").collect()) == [("x", "extra"), ("y", "changed"), ("z", "missing")]
    files = spark.createDataFrame([(".cache/xdg/m", 5), ("vault/a", 1), ("vault/b", 2)], "path string, bytes long")
    assert [tuple(r) for r in integrity.inventory(files, F.lit("all"), F.col("bytes")).collect()] == [("all", 2, 3)]


def test_sources_and_sinks(spark, tmp_path):
    notes = tmp_path / "vault/notes/sub"
    notes.mkdir(parents=True)
    (notes / "goblin.md").write_text("---\ntags: [npc]\n---\n# Goblin Boss\nSee [[Ogre|o]].\n")
    (notes / "ogre.md").write_text("Ogre text without a header")
    archive = tmp_path / "imports/source-vault"
    archive.mkdir(parents=True)
    (archive / "old.md").write_text("old")
    docs = readers.markdown(spark, f"file://{tmp_path}")
    got = {r["title"]: r for r in docs.collect()}
    assert set(got) == {"Goblin Boss", "ogre"}
    assert got["Goblin Boss"]["links"] == ["Ogre"]
    assert readers.markdown(spark, f"file://{tmp_path}", ("archive",)).count() == 1
    links = integrity.resolved(integrity.wikilink_edges(docs), docs).collect()
    assert len(links) == 1 and links[0]["dst"].endswith("ogre.md")
    import zipfile

    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("a.json", '{"k": 1}')
    (tmp_path / "b.txt").write_text("plain")
    assert sorted((r["member"] or "", r["value"]) for r in readers.exports(spark, str(tmp_path)).collect()) == [("", "plain"), ("a.json", '{"k": 1}')]
    plan = spark.createDataFrame([("book", 1, "One", "t")], "slug string, ord int, heading string, content string")
    for _ in range(2):
        sinks.write_book(plan, plan.select("slug", "heading"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/chapters")).count() == 1
    with pytest.raises(ValueError, match="two books"):
        sinks.write_book(plan, plan.unionByName(plan).select("slug", "heading"), str(tmp_path / "out"))
    sinks.copy_one(spark, str(notes / "goblin.md"), str(tmp_path / "copy.md"))
    assert (tmp_path / "copy.md").read_bytes() == (notes / "goblin.md").read_bytes()
    with pytest.raises(FileExistsError):
        sinks.copy_one(spark, str(notes / "ogre.md"), str(tmp_path / "copy.md"))
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    assert readers.binaries(spark, str(tmp_path)).first()["slug"] == "x"


def test_assets_canvas_mirror(spark):
    assets = spark.createDataFrame([("A b", "vault/notes/images", "p", {"n": "1"}, {"model": "m", "key": "secret"}, "c"), ("B", "vault/notes/../x", "p", {}, {}, "c")], "title string, folder string, prompt string, params map<string,string>, response map<string,string>, content string")
    got = sinks.asset_rows(assets, "vault/notes").collect()
    assert len(got) == 1 and got[0]["file"].startswith("vault/notes/images/a-b-") and got[0]["response"] == {"model": "m"}
    nodes = spark.createDataFrame([("q", "1", "x"), ("q", "2", "y"), ("r", "1", "z")], "board string, id string, text string")
    edges = spark.createDataFrame([("q", "e", "1", "2"), ("q", "f", "1", "9")], "board string, id string, src string, dst string")
    boards = sinks.canvas(nodes, edges)
    assert json.loads(boards.filter("board = 'r'").first()["json"])["edges"] == []
    assert [tuple(r) for r in sinks.canvas_faults(boards).collect()] == [("q", "f")]
    with pytest.raises(ValueError, match="output"):
        sinks.render(nodes, "xml")


def test_streaming_matches_batch(spark, sf, tmp_path):
    from folioforge.session import table
    from folioforge.streaming import events as stream

    batch = table(spark, sf, "events").repartition(3)
    batch.write.parquet(str(tmp_path / "in"))
    live = stream.tumbling(stream.read(spark, str(tmp_path / "in"), batch.schema), late="1 day")
    q = live.writeStream.format("memory").queryName("tumbling").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(r["start"], r["event_type"]): r["n"] for r in stream.tumbling(batch).collect()}
    assert {(r["start"], r["event_type"]): r["n"] for r in spark.table("tumbling").collect()} == want
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    for _ in range(2):
        stream.ingest_stream(stream.read(spark, str(tmp_path / "docs"), docs.schema), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    assert stream.sessions(batch).agg(F.sum("n")).first()[0] == batch.count()


def test_titles_in_any_script(spark):
    docs = spark.createDataFrame([("a", "東京"), ("b", "Été"), ("c", "Goblin  Boss"), ("d", "goblin boss")], "path string, title string")
    edges = spark.createDataFrame([("x", "京都"), ("x", "大阪"), ("x", "東京"), ("x", "àt"), ("x", "été"), ("x", " goblin BOSS ")], "src string, target string")
    got = {r["target"]: r["dst"] for r in integrity.resolved(edges, docs).collect()}
    assert got == {"京都": None, "大阪": None, "東京": "a", "àt": None, "été": "b", " goblin BOSS ": "c"}


def test_book_markdown(spark):
    parts = spark.createDataFrame([("my-book", 2, "Two Ways", None), ("my-book", 1, "One", "text")], "slug string, ord int, heading string, body string")
    got = {r["file"]: r["text"] for r in sinks.book_markdown(parts).collect()}
    assert got == {"__my-book.md": "# my-book\n\n1. One\n2. Two Ways\n", "001-one.md": "# One\n\ntext\n", "002-two-ways.md": "# Two Ways\n\n\n"}


def test_ingest_as_a_whole(spark):
    docs = spark.createDataFrame([("a", "the and\nmore licensed"), ("b", "der die"), ("c", None)], "slug string, text string")
    seen = ingest.hashed(docs.filter("slug = 'b'")).select("slug", "source_hash")
    plan = lambda books: books.select("slug", F.lit(1).alias("ord"), F.lit("Whole").alias("heading"))
    run = ingest.ingest(docs, seen, plan)
    assert sorted(r["slug"] for r in run["books"].collect()) == ["a", "c"] and run["sections"].count() == 2
    assert [r["command"] for r in run["next_steps"].filter("slug = 'a'").orderBy("step").collect()] == list(ingest.STEPS)
    again = ingest.ingest(docs, run["state"], plan)
    assert all(t.count() == 0 for k, t in again.items() if k != "state")
    full = ingest.ingest(docs, seen, plan, "all", {"en": ["the"], "de": ["der"]}, {"legal": ["licensed"]})
    book = full["books"].filter("slug = 'a'").first()
    assert (book["system"], book["summary"], book["tags"]) == ("en", "the and", ["legal"])
    assert [r["command"] for r in full["next_steps"].filter("slug = 'a'").orderBy("step").collect()] == ["index-update", "index-embed"]
    with pytest.raises(ValueError, match="mode"):
        ingest.ingest(docs, seen, plan, "some")


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the fox, the den"), (2, "a fox"), (3, ""), (4, None), (5, "licensed den")], "doc_id long, text string")
    for _ in range(2):
        search.write_index(docs, str(tmp_path / "index"))
    for terms in (["fox", "The"], ["den"], ["absent"], []):
        got = search.bm25_stored(spark, str(tmp_path / "index"), terms)
        want = {r["doc_id"]: round(r["score"], 9) for r in search.bm25(docs, terms).collect()} if terms else {}
        assert {r["doc_id"]: round(r["score"], 9) for r in got.collect()} == want
    scan = search.bm25_stored(spark, str(tmp_path / "index"), ["fox"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan and "EqualTo(term,fox)" in scan


def test_adapters_regenerate(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one"), ("b", None), ("c", "x")], "name string, body string")
    targets = {"left": (F.concat(F.lit("l/"), "name"), F.col("body")), "right": (F.when(F.col("name") != "c", F.concat(F.lit("r/"), "name")), F.upper("body"))}
    wanted = sinks.adapters(rows, targets)
    assert sorted((r["target"], r["path"], r["content"]) for r in wanted.collect()) == [("left", "l/a", "one"), ("left", "l/b", None), ("left", "l/c", "x"), ("right", "r/a", "ONE"), ("right", "r/b", None)]
    out = str(tmp_path / "out")
    for _ in range(2):
        sinks.sync(wanted, out)
        assert integrity.drift(spark.read.parquet(out), wanted, "path", "hash").count() == 0
    fewer = sinks.adapters(rows.filter("name = 'a'"), {"left": targets["left"]})
    sinks.sync(fewer, out)
    assert [r["path"] for r in spark.read.parquet(out).collect()] == ["l/a"]


def test_stream_remembers_hashes(spark, tmp_path):
    from folioforge.streaming import events as stream

    schema = "doc_id long, text string"
    for rows in ([(1, "a"), (2, None)], [(3, "a"), (4, "b"), (5, None)], [(6, "b")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.ingest_stream(stream.read(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted((r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())) == [1, 2, 4]
