import json

from pyspark.sql import functions as F

from folioforge import session
from folioforge.functions import text
from folioforge.operators import ingest, integrity, sections
from folioforge.sources import readers, sinks


def test_views_are_lazy(spark, sf):
    session.register_views(spark, sf, ("region", "nation"))
    assert spark.sql("SELECT count(*) FROM nation JOIN region ON n_regionkey = r_regionkey").first()[0] == 25


def test_records(spark, tmp_path):
    (tmp_path / "items.json").write_text('{"name": "Rope", "attunement": false, "other": 1}\n{"name": null}\n')
    got = readers.records(spark, str(tmp_path / "items.json"), "item").orderBy(F.col("name").asc_nulls_first()).collect()
    assert [r["name"] for r in got] == [None, "Rope"] and "other" not in got[0].asDict()
    raw = readers.raw_records(spark, str(tmp_path / "items.json")).select(F.try_variant_get("record", "$.other", "int").alias("x")).collect()
    assert sorted((r["x"] for r in raw), key=repr) == [1, None]
    try:
        readers.records(spark, "x", "vehicle")
    except ValueError as e:
        assert "vehicle" in str(e)
    else:
        raise AssertionError
    report = spark.createDataFrame([('{"a": {"b": 2}}',)], "j string")
    assert report.select(readers.json_field("j", "$.a.b").alias("x")).first()["x"] == "2"


def test_one_file_and_sidecars(spark, tmp_path):
    (tmp_path / "old.md").write_text("---\npages: 3-9\n---\n# Old\n")
    doc = readers.one_file(spark, str(tmp_path / "old.md"))
    assert doc.first()["title"] == "Old"
    p = spark.createDataFrame([("s", "h")], "slug string, source_hash string")
    for _ in range(2):
        sinks.write_sidecars(p, p, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/report")).count() == 1
    assert json.loads(sinks.machine(p).first()["json"]) == {"slug": "s", "source_hash": "h"}


def test_headings_before_title(spark):
    rows = [(1, "<title>T</title><h1>A</h1><h1>B</h1>"), (2, "<title>T</title>"), (3, '<ul><li><a href="/x">X</a></li></ul><h1>A</h1>'), (4, ""), (5, None)]
    got = sections.html_plan(spark.createDataFrame(rows, "page_id long, html string")).orderBy("page_id", "ord").collect()
    assert [(r["page_id"], r["ord"], r["heading"], r["origin"]) for r in got] == [(1, 1, "A", "heading"), (1, 2, "B", "heading"), (2, 1, "T", "title"), (3, 1, "X", "toc")]


def test_boundaries_and_ranges(spark):
    heads = spark.createDataFrame([("a", 1, 5, 90), ("a", 2, 40, 90)], "path string, ord int, at int, size int")
    assert [r["stop"] for r in sections.boundaries(heads, "path", "at", "size").orderBy("ord").collect()] == [39, 90]
    got = spark.createDataFrame([(3, 3), (3, 9)], "lo int, hi int").select(text.format_range(F.col("lo"), F.col("hi")).alias("x")).collect()
    assert [r["x"] for r in got] == ["3", "3-9"]


def test_mirror_pins_doctor_status(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "path string, hash string")
    b = spark.createDataFrame([("y", "3"), ("z", "4")], "path string, hash string")
    assert sorted(tuple(r) for r in sinks.mirror_changes(a, b).collect()) == [("x", "add"), ("y", "replace"), ("z", "remove")]
    w = spark.createDataFrame([("m", "1"), ("n", "2"), ("o", "3")], "name string, pin string")
    c = spark.createDataFrame([("m", "1"), ("n", "1")], "name string, pin string")
    assert {r["name"]: r["state"] for r in integrity.pins(w, c).collect()} == {"m": "current", "n": "behind", "o": "absent"}
    assert {r["name"]: (r["ok"], r["n"]) for r in integrity.doctor({"p": (w, F.col("pin") > "1"), "q": (w, F.col("pin").isNotNull())}).collect()} == {"p": (False, 1), "q": (True, 0)}
    docs = spark.createDataFrame([("n", 4), ("n", 9)], "collection string, at int")
    assert tuple(integrity.status(docs, F.col("at")).first()) == ("n", 2, 9)


def test_classify_ties_and_nulls(spark):
    df = spark.createDataFrame([("a b",), ("b b a",), ("zz",), (None,), ("",)], "t string")
    votes = {"first": ["a"], "second": ["b"]}
    assert [r[0] for r in df.select(ingest.classify(F.col("t"), votes)).collect()] == ["first", "second", "unknown", "unknown", "unknown"]
    assert [r[0] for r in df.select(ingest.tag(F.col("t"), {"y": ["b"], "x": ["a"]})).collect()][:3] == [["x", "y"], ["x", "y"], []]
