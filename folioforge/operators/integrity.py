"""Drift, pins, links, inventories, boundaries, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.sources.readers import READ_ONLY

#: Places that are expensive to rebuild: cleanup refuses them.
KEPT = (".cache/xdg", ".cache/vendor")


def drift(generated: DataFrame, canonical: DataFrame, key: str, value: str) -> DataFrame:
    """(key, state): missing, extra or changed; equal rows are left out."""
    g, c = generated.select(key, F.col(value).alias("_g")), canonical.select(key, F.col(value).alias("_c"))
    g, c = g.withColumn("_in_g", F.lit(True)), c.withColumn("_in_c", F.lit(True))
    state = F.when(F.col("_in_g").isNull(), "missing").when(F.col("_in_c").isNull(), "extra").when(~F.col("_g").eqNullSafe(F.col("_c")), "changed")
    return g.join(c, key, "full").select(key, state.alias("state")).filter("state is not null")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with multiplicity, and which side."""
    return a.exceptAll(b).withColumn("side", F.lit("generated")).unionByName(b.exceptAll(a).withColumn("side", F.lit("canonical")))


def pins(wanted: DataFrame, actual: DataFrame) -> DataFrame:
    """(name, wanted, actual, state): current, behind or absent."""
    state = F.when(F.col("actual").isNull(), "absent").when(F.col("wanted") == F.col("actual"), "current").otherwise("behind")
    return wanted.select("name", F.col("pin").alias("wanted")).join(actual.select("name", F.col("pin").alias("actual")), "name", "left").withColumn("state", state)


def wikilink_edges(docs: DataFrame) -> DataFrame:
    """(src, target): links of the bodies, a row for each distinct one."""
    return docs.select(F.col("path").alias("src"), F.explode(text.wikilinks(F.col("body"))).alias("target")).distinct()


def resolved(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """(src, target, dst): dst is the document with that title, any case and spacing;
    null: a stub is wanted.  Of several with a title the first path counts."""
    by_title = docs.groupBy(text.title_key(F.col("title")).alias("_s")).agg(F.min("path").alias("dst"))
    return edges.withColumn("_s", text.title_key(F.col("target"))).join(by_title, "_s", "left").select("src", "target", "dst")


def href_edges(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, target, n) links of HTML pages."""
    links = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.explode(links).alias("target")).groupBy(key, "target").agg(F.count("*").alias("n"))


def inventory(files: DataFrame, scope: Column, size: Column) -> DataFrame:
    """(scope, n, bytes) of what a cleanup would delete; KEPT places are refused.
    Nothing is deleted here."""
    out = files
    if "path" in files.columns:
        for place in KEPT:
            out = out.filter(~F.col("path").startswith(place))
    return out.groupBy(scope.alias("scope")).agg(F.count("*").alias("n"), F.sum(size).cast("long").alias("bytes"))


def forbidden_writes(planned: DataFrame) -> DataFrame:
    """Planned (collection, path) writes into read-only collections."""
    return planned.filter(F.col("collection").isin(*READ_ONLY))


def status(docs: DataFrame, key: Column) -> DataFrame:
    """(collection, n, latest) of an index."""
    return docs.groupBy("collection").agg(F.count("*").alias("n"), F.max(key).alias("latest"))


def doctor(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(name, ok, n): n rows of each table that break its condition."""
    out = None
    for name, (df, good) in checks.items():
        bad = F.sum(F.when(good, 0).otherwise(1))
        part = df.agg(F.coalesce(bad, F.lit(0)).cast("long").alias("n")).select(F.lit(name).alias("name"), (F.col("n") == 0).alias("ok"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def unsupported(claims: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Claims that no fact supports."""
    return claims.join(facts.select(*keys).distinct(), keys, "left_anti")
