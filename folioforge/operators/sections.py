"""Section plans: a table of contents first, headings where there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text

TOC = r'<li><a href="([^"]*)">([^<]*)</a></li>'
H1 = r"<h1[^>]*>([^<]*)</h1>"
TITLE = r"<title>([^<]*)</title>"
BLOCK = r"<(h1|p)[^>]*>([^<]*)<"


def html_plan(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ord, heading, origin): entries of the page's own contents list, else
    its headings, else its title; ord from 1."""
    toc, heads, title = (F.regexp_extract_all("html", F.lit(p), F.lit(g)) for p, g in ((TOC, 2), (H1, 1), (TITLE, 1)))
    named = lambda names, origin: F.struct(names.alias("names"), F.lit(origin).alias("origin"))
    found = F.when(F.size(toc) > 0, named(toc, "toc")).when(F.size(heads) > 0, named(heads, "heading")).otherwise(named(title, "title"))
    plan = pages.select(key, found.alias("s")).select(key, "s.origin", F.posexplode("s.names").alias("ord", "heading"))
    return plan.select(key, (F.col("ord") + 1).cast("long").alias("ord"), "heading", "origin")


def html_blocks(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ord, kind, text, heading): headings and paragraphs in order, each
    under the last heading before it."""
    blocks = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(BLOCK), F.lit(0))).alias("ord", "block"))
    blocks = blocks.select(key, (F.col("ord") + 1).cast("long").alias("ord"), F.regexp_extract("block", "^<(h1|p)", 1).alias("kind"), F.regexp_extract("block", ">([^<]*)<", 1).alias("text"))
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("heading", F.last(F.when(F.col("kind") == "h1", F.col("text")), ignorenulls=True).over(before))


def markdown_sections(docs: DataFrame, key: str = "path", body: str = "body") -> DataFrame:
    """(key, ord, level, heading, content): text cut at Markdown headings; what
    stands before the first one is section 0 without a heading.  Text without
    headings is section 0 alone; null text has none."""
    parts = F.split(F.col(body), r"(?m)^(?=#{1,6}[ \t])")
    cut = docs.select(key, F.posexplode(parts).alias("ord", "part")).filter((F.col("ord") > 0) | (F.trim("part") != "") | F.col("part").startswith("#"))
    head = F.regexp_extract("part", r"^(#{1,6})[ \t]+([^\n]*)", 2)
    level = F.length(F.regexp_extract("part", r"^(#{1,6})[ \t]", 1))
    order = Window.partitionBy(key).orderBy("ord")
    turn = F.row_number().over(order) - F.when(F.max(F.when(F.col("ord") == 0, level)).over(Window.partitionBy(key)) == 0, 1).otherwise(0)
    return cut.select(key, turn.cast("int").alias("ord"), level.alias("level"), F.nullif(F.trim(head), F.lit("")).alias("heading"), F.when(level > 0, F.regexp_replace("part", r"^#{1,6}[ \t]+[^\n]*\n?", "")).otherwise(F.col("part")).alias("content"))


def planned(toc: DataFrame, headings: DataFrame, key: str) -> DataFrame:
    """Sections of the contents list; headings for documents that have no list."""
    return toc.withColumn("origin", F.lit("toc")).unionByName(headings.join(toc.select(key).distinct(), key, "left_anti").withColumn("origin", F.lit("heading")))


def page_spans(sections: DataFrame, key: str, pages: str = "n_pages") -> DataFrame:
    """Adds page_from and page_to from each section's number of pages, in order; a
    section of no pages stands on the page where the next begins."""
    before = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(pages).over(before), F.lit(0)) + 1
    return sections.withColumn("page_from", start.cast("long")).withColumn("page_to", F.greatest(start, start + F.col(pages) - 1).cast("long"))


def boundaries(headings: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Adds where each section ends: before the next one starts, or at `end`."""
    nxt = F.lead(start).over(Window.partitionBy(key).orderBy("ord"))
    return headings.withColumn("stop", F.coalesce(nxt - 1, F.col(end)))


def overview(sections: DataFrame, slug: str = "slug") -> DataFrame:
    """One row a book: sections, pages, and its table of contents in order."""
    titles = F.transform(F.array_sort(F.collect_list(F.struct("ord", "heading"))), lambda s: s["heading"])
    return sections.groupBy(slug).agg(F.count("*").alias("n_sections"), F.min("page_from").alias("page_from"), F.max("page_to").alias("page_to"), titles.alias("contents"))


def faults(sections: DataFrame, key: str) -> DataFrame:
    """(key, fault): ordinals that do not run from 1 without gaps, sections without
    a heading."""
    by = sections.groupBy(key).agg(F.count("*").alias("n"), F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.countDistinct("ord").alias("d"), F.sum(F.when(F.coalesce(F.trim("heading"), F.lit("")) == "", 1).otherwise(0)).alias("bare"))
    gap = F.when((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n")), F.lit("ordinals"))
    bare = F.when(F.col("bare") > 0, F.lit("heading"))
    return by.select(key, F.explode(F.array_compact(F.array(gap, bare))).alias("fault"))


def slugged(df: DataFrame, title: str) -> DataFrame:
    return df.withColumn("slug", text.slug(F.col(title)))
