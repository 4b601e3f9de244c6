"""Column functions over text.  All are built-in expressions, so they stay inside
code generation and are pushed where Catalyst can push them.

Regular expressions keep to what Java and RE2 read alike: no `\\b`, no `\\W`, case
by lower() on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}]+"
WIKILINK = r"\[\[([^\]|#]+)"
HEADING = r"(?m)^(#{1,6})[ \t]+(.*)$"
URI_SCHEME = "idx"


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one dash, none at
    the ends; null stays null."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def title_key(c: Column) -> Column:
    """Titles that name one document: lower case, runs of space as one, none at the
    ends.  Other letters than a-z count as they are."""
    return F.trim(F.regexp_replace(F.lower(c), r"[\x20\x09-\x0D]+", " "))


def content_hash(c: Column) -> Column:
    """SHA-256 in lower-case hex of the UTF-8 text."""
    return F.sha2(c.cast("binary"), 256)


def asset_name(title: Column, content: Column, n: int = 12, suffix: str = "") -> Column:
    """`<slug>-<hash>` with the first n hex digits of the content's hash."""
    return F.concat(slug(title), F.lit("-"), F.substring(content_hash(content), 1, n), F.lit(suffix))


def tokens(c: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def wikilinks(c: Column) -> Column:
    """Targets of [[target]], [[target|alias]] and [[target#part]], trimmed."""
    return F.transform(F.regexp_extract_all(c, F.lit(WIKILINK), F.lit(1)), F.trim)


def headings(c: Column) -> Column:
    """Markdown headings as an array of (level, title)."""
    lines = F.regexp_extract_all(c, F.lit(HEADING), F.lit(0))
    return F.transform(lines, lambda h: F.struct(F.length(F.regexp_extract(h, "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract(h, r"^#+[ \t]+(.*)$", 1)).alias("title")))


def index_uri(collection: Column, path: Column) -> Column:
    return F.concat(F.lit(f"{URI_SCHEME}://"), collection, F.lit("/"), path)


def preview(c: Column, n: int = 80) -> Column:
    return F.left(F.regexp_replace(c, r"\s+", " "), F.lit(n))


def page_range(c: Column) -> Column:
    """`12-15`, `12` as struct(lo, hi); what is not a range is null."""
    parts = F.split(F.regexp_replace(c, r"[ \t]", ""), "-")
    lo = F.expr("null").cast("int")
    return F.when(
        F.regexp_like(c, F.lit(r"^[ \t]*\d+[ \t]*(-[ \t]*\d+[ \t]*)?$")),
        F.struct(F.try_element_at(parts, F.lit(1)).cast("int").alias("lo"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(1))).cast("int").alias("hi")),
    ).otherwise(F.when(F.lit(False), F.struct(lo.alias("lo"), lo.alias("hi"))))


def format_range(lo: Column, hi: Column) -> Column:
    return F.when(lo == hi, lo.cast("string")).otherwise(F.concat_ws("-", lo.cast("string"), hi.cast("string")))


def one_of(c: Column, allowed: tuple[str, ...], what: str = "value") -> Column:
    """The value where it is null or allowed; any other fails the query."""
    return F.when(c.isNull() | c.isin(*allowed), c).otherwise(F.raise_error(F.concat(F.lit(f"{what} not among {', '.join(allowed)}: "), c)))


def with_default(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def inside(path: Column, root: str) -> Column:
    """Does a normalised path stay under root?  `..` never does."""
    clean = F.regexp_replace(F.regexp_replace(path, "/\\./", "/"), "/+", "/")
    return ~F.regexp_like(clean, F.lit(r"(^|/)\.\.(/|$)")) & clean.startswith(root.rstrip("/") + "/")


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for zero vectors."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)
