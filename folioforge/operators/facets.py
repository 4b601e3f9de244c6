"""Metadata facets and predicates over documents with meta: field -> values.

Missing metadata says nothing about content: `find` filters on metadata alone, and
`with_meta` keeps documents that have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text

PREDICATES = ("exists", "missing", "equals", "contains", "matches", "gte", "lte")


def scoped(docs: DataFrame, scope: tuple[str, ...] | None = None, opt_in: tuple[str, ...] = ("archive",)) -> DataFrame:
    """Documents of the named collections; without names, all but the opt-in ones."""
    return docs.filter(F.col("collection").isin(*scope)) if scope else docs.filter(~F.col("collection").isin(*opt_in))


def fields(docs: DataFrame) -> DataFrame:
    """(field, n): metadata fields and the number of documents that have them."""
    return docs.select(F.explode(F.map_keys("meta")).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


def values(docs: DataFrame, field: str) -> DataFrame:
    """(value, n) of one field; a value counts once for each place it stands."""
    return docs.select(F.explode(F.try_element_at("meta", F.lit(field))).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def ranked(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds rank, from 1: values of the largest count first, then in order, within
    the columns `by` (all values of one field where there are none)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "value"))
    return counts.withColumn("rank", rank.cast("long"))


def all_values(docs: DataFrame) -> DataFrame:
    """(field, value, n) of every field, in one pass."""
    each = docs.select(F.explode("meta").alias("field", "list")).select("field", F.explode("list").alias("value"))
    return each.groupBy("field", "value").agg(F.count("*").alias("n"))


def from_columns(df: DataFrame, columns: list[str]) -> Column:
    """A meta map made of ordinary columns; nulls are missing fields."""
    pairs = F.array(*[F.struct(F.lit(c), F.array(F.col(c).cast("string"))) for c in columns])
    return F.map_filter(F.map_from_entries(pairs), lambda _, v: v[0].isNotNull())


def predicate(field: str, op: str, value=None, meta: str = "meta") -> Column:
    """exists, missing; equals, contains, matches: by any value of the field;
    gte, lte: by any value that is a number.  contains looks for a part of a single
    value and for a member of a list.  A missing field satisfies `missing` alone."""
    got = F.try_element_at(F.col(meta), F.lit(field))
    there = F.coalesce(F.map_contains_key(F.col(meta), field), F.lit(False))
    tests = {
        "equals": lambda: F.array_contains(got, F.lit(str(value))),
        "contains": lambda: F.when(F.size(got) == 1, F.contains(got[0], F.lit(str(value)))).otherwise(F.array_contains(got, F.lit(str(value)))),
        "matches": lambda: F.exists(got, lambda v: F.regexp_like(v, F.lit(value))),
        "gte": lambda: F.exists(got, lambda v: v.try_cast("double") >= F.lit(float(value))),
        "lte": lambda: F.exists(got, lambda v: v.try_cast("double") <= F.lit(float(value))),
    }
    if op == "exists":
        return there
    if op == "missing":
        return ~there
    if op not in tests:
        raise ValueError(f"predicate not among {', '.join(PREDICATES)}: {op}")
    return F.coalesce(tests[op](), F.lit(False))


def find(docs: DataFrame, *predicates: tuple, scope: tuple[str, ...] | None = None) -> DataFrame:
    """Documents that satisfy all (field, op[, value]) predicates."""
    out = scoped(docs, scope) if "collection" in docs.columns else docs
    for p in predicates:
        out = out.filter(predicate(*p))
    return out


def inspect(docs: DataFrame, path: str | None = None, chars: int = 80) -> DataFrame:
    """Header, title, index URI, page range and preview of one document, or of all."""
    out = docs.filter(F.col("path") == path) if path else docs
    pages = text.page_range(F.try_element_at("meta", F.lit("pages"))[0]) if "meta" in docs.columns else F.lit(None)
    return out.select("collection", "path", "title", "meta", text.index_uri(F.col("collection"), F.col("path")).alias("uri"), pages.alias("pages"), text.preview(F.col("body"), chars).alias("preview"))


def with_meta(docs: DataFrame, meta: DataFrame, key: str) -> DataFrame:
    """Documents beside their metadata; those without any stay."""
    return docs.join(meta, key, "left")
