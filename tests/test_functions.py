import pytest
from pyspark.sql import functions as F

from folioforge.functions import headers, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "want"), [("The Red  Dragon!", "the-red-dragon"), ("--A--", "a"), ("", ""), (None, None), ("É", "")])
def test_slug(spark, given, want):
    assert one(spark, given, text.slug(F.col("v"))) == want


def test_wikilinks_and_headings(spark):
    body = "# One\ntext [[A]] and [[B|alias]] [[C#part]]\n## Two \nrest"
    assert one(spark, body, text.wikilinks(F.col("v"))) == ["A", "B", "C"]
    assert [tuple(h) for h in one(spark, body, text.headings(F.col("v")))] == [(1, "One"), (2, "Two")]


@pytest.mark.parametrize(("given", "want"), [("12-15", (12, 15)), (" 7 ", (7, 7)), ("7-", None), ("x", None), (None, None)])
def test_page_range(spark, given, want):
    got = one(spark, given, text.page_range(F.col("v")))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(("given", "want"), [("vault/notes/images/a", True), ("vault/notes/images/../x", False), ("vault/notes/imagesx/a", False), ("vault//notes/./images/a", True)])
def test_inside(spark, given, want):
    assert one(spark, given, text.inside(F.col("v"), "vault/notes/images")) is want


def test_one_of(spark):
    assert one(spark, "png", text.one_of(F.col("v"), ("png", "webp"))) == "png"
    assert one(spark, None, text.one_of(F.col("v"), ("png", "webp"))) is None
    with pytest.raises(Exception, match="not among png, webp"):
        one(spark, "gif", text.one_of(F.col("v"), ("png", "webp")))


def test_header(spark):
    doc = "---\ntitle: X\ntags: [a, b]\nlevel: 3\ndone: true\nempty:\n---\nBody\n---\nmore"
    assert one(spark, doc, headers.parse_header(headers.header_text(F.col("v")))) == {"title": ["X"], "tags": ["a", "b"], "level": ["3"], "done": ["true"], "empty": [None]}
    assert one(spark, doc, headers.body_text(F.col("v"))) == "Body\n---\nmore"
    for bad in ("no header", "---\n[unclosed\n---\n", None):
        assert one(spark, bad, headers.parse_header(headers.header_text(F.col("v")))) is None


def test_cosine(spark):
    got = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>").select(text.cosine(F.col("a"), F.col("b")).alias("x")).collect()
    assert got[0]["x"] == pytest.approx(0.5**0.5)
    assert got[1]["x"] is None
