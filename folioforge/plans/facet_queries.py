"""Facet, predicate and lookup queries on the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators import entities, facets, search
from folioforge.session import table
from folioforge.sources import sinks


def _event_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as documents: their JSON properties are the metadata."""
    props = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").withColumn("meta", F.transform_values(props, lambda _, v: F.array(v)))


def _part_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.withColumn("meta", facets.from_columns(parts, ["p_brand", "p_type", "p_size"]))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as canonical items: brand as source, type as kind, size as a rating."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("source"), F.col("p_type").alias("kind"), F.col("p_size").alias("rating"), F.col("p_retailprice").alias("price"))


def facet_fields(spark, sf_dir):
    return facets.fields(_part_docs(spark, sf_dir).unionByName(_event_docs(spark, sf_dir), allowMissingColumns=True))


def facet_values(spark, sf_dir):
    return facets.values(_event_docs(spark, sf_dir), "k")


def facet_values_ranked(spark, sf_dir):
    return facets.ranked(facets.all_values(_part_docs(spark, sf_dir)), ("field",))


def facet_values_eav(spark, sf_dir):
    return facets.all_values(_part_docs(spark, sf_dir))


def find_exists_missing(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", facets.from_columns(table(spark, sf_dir, "labels"), ["quality", "toxic"]).alias("meta"))
    docs = facets.with_meta(table(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id")
    return docs.select("doc_id", facets.predicate("quality", "exists").alias("has_quality"), facets.predicate("quality", "missing").alias("lacks_quality"))


def find_equals_contains(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    docs = parts.withColumn("meta", facets.from_columns(parts, ["p_brand", "p_name"]))
    return facets.find(docs, ("p_brand", "equals", "Brand#12"), ("p_name", "contains", "re")).select("p_partkey", "p_name")


def find_matches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return facets.find(docs.withColumn("meta", facets.from_columns(docs, ["text"])), ("text", "matches", r"(^|[^\p{L}])[Éé]")).select("doc_id")


def find_gte(spark, sf_dir):
    return facets.find(_event_docs(spark, sf_dir), ("k", "gte", 90)).select("event_id")


def find_lte(spark, sf_dir):
    return facets.find(_event_docs(spark, sf_dir), ("k", "lte", 9)).select("event_id")


def inspect_preview(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("collection"), F.col("doc_id").cast("string").alias("path"), F.col("source").alias("title"), F.col("text").alias("body"))
    docs = docs.withColumn("meta", F.create_map(F.lit("pages"), F.array(F.concat_ws("-", F.lit("1"), "path"))))
    got = facets.inspect(docs)
    return got.select("path", "title", "uri", F.col("pages.lo").cast("long").alias("page_from"), F.col("pages.hi").cast("long").alias("page_to"), "preview")


def default_exclude_optin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("collection", F.when(F.col("source").isin("src0", "src1"), "archive").when(F.col("source") < "src2", "books").otherwise("notes"))
    default = facets.scoped(docs).groupBy("collection").agg(F.count("*").alias("n")).withColumn("asked", F.lit("default"))
    named = facets.scoped(docs, ("archive", "books")).groupBy("collection").agg(F.count("*").alias("n")).withColumn("asked", F.lit("named"))
    return default.unionByName(named)


def entity_item(spark, sf_dir):
    got = _items(spark, sf_dir).filter(entities.condition("source", "equals", "Brand#3") & entities.condition("kind", "equals", "ECONOMY"))
    return got.select("id", "name", "rating")


def entity_range(spark, sf_dir):
    got = _items(spark, sf_dir).filter(entities.condition("rating", "range", (10, 20)) & entities.condition("price", "range", (None, 1000.0)) & F.contains(F.lower("name"), F.lit("ring")))
    return got.select("id", "name", "rating", "price")


def ruleset_preference(spark, sf_dir):
    records = _items(spark, sf_dir).select("name", F.concat_ws("/", "source", F.lpad(F.col("id").cast("string"), 9, "0")).alias("source"), F.when(F.col("rating") % 3 == 0, "2024").otherwise("2014").alias("ruleset"))
    return entities.prefer(records, "either")


def _fallback(spark, sf_dir, name):
    items = _items(spark, sf_dir).select("id", "name")
    return entities.canonical_else(items.filter(F.lower("name") == name), items.filter(F.contains("name", F.lit(name.split()[-1]))))


def canonical_then_fallback(spark, sf_dir):
    return _fallback(spark, sf_dir, "small ring")


def fallback_when_empty(spark, sf_dir):
    return _fallback(spark, sf_dir, "no such ring")


def entity_render(spark, sf_dir):
    items = _items(spark, sf_dir).select("name", "kind", "rating")
    return sinks.render(items, "summary").withColumn("output", F.lit("summary")).unionByName(sinks.render(items, "markdown").withColumn("output", F.lit("markdown")))


def importer_contract(spark, sf_dir):
    items = _items(spark, sf_dir)
    plain = sinks.importer_text(F.col("name"), [F.concat(F.lit("Type "), "kind"), F.concat(F.lit("Rating "), F.col("rating").cast("string"))])
    prose = sinks.enriched_prose(F.col("name"), F.concat(F.lit("1d"), F.col("rating").cast("string")))
    both = items.select("id", plain.alias("text")).unionByName(items.select("id", prose.alias("text")))
    return both.select("id", "text", sinks.importer_contract(F.col("text")).alias("importable"))


def topk_per_group(spark, sf_dir):
    return search.top_per_group(table(spark, sf_dir, "part"), "p_type", "p_retailprice", "p_partkey", 3).select("p_type", "p_partkey", F.col("rank").cast("long").alias("rank"))


def slug_hash_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.asset_name(F.concat_ws(" ", "p_name", "p_brand"), F.col("p_name"), 12, ".png").alias("file"))


QUERIES = {f.__name__: f for f in (facet_fields, facet_values, facet_values_eav, facet_values_ranked, find_exists_missing, find_equals_contains, find_matches, find_gte, find_lte, inspect_preview, default_exclude_optin, entity_item, entity_range, ruleset_preference, canonical_then_fallback, fallback_when_empty, entity_render, importer_contract, topk_per_group, slug_hash_name)}

_ITEMS = "(SELECT p_partkey AS id, p_name AS name, p_brand AS source, p_type AS kind, p_size AS rating, p_retailprice AS price FROM part)"


def _fallback_sql(name: str) -> str:
    last = name.split()[-1]
    return f"""WITH c AS (SELECT id, name FROM {_ITEMS} WHERE lower(name) = '{name}')
SELECT id, name, 'canonical' AS tier FROM c
UNION ALL SELECT id, name, 'fallback' AS tier FROM {_ITEMS} WHERE contains(name, '{last}') AND NOT EXISTS (SELECT 1 FROM c)"""


ORACLE_SQL = {
    "facet_fields": """SELECT field, count(*) AS n FROM (
  SELECT unnest(json_keys(props)) AS field FROM events
  UNION ALL SELECT 'p_brand' FROM part WHERE p_brand IS NOT NULL
  UNION ALL SELECT 'p_type' FROM part WHERE p_type IS NOT NULL
  UNION ALL SELECT 'p_size' FROM part WHERE p_size IS NOT NULL) GROUP BY field""",
    "facet_values": "SELECT json_extract_string(props, '$.k') AS value, count(*) AS n FROM events WHERE json_exists(props, '$.k') GROUP BY 1",
    "facet_values_eav": """SELECT field, value, count(*) AS n FROM (
  SELECT 'p_brand' AS field, p_brand AS value FROM part
  UNION ALL SELECT 'p_type', p_type FROM part
  UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part) WHERE value IS NOT NULL GROUP BY field, value""",
    "facet_values_ranked": """SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, value) AS rank FROM (SELECT field, value, count(*) AS n FROM (
  SELECT 'p_brand' AS field, p_brand AS value FROM part
  UNION ALL SELECT 'p_type', p_type FROM part
  UNION ALL SELECT 'p_size', CAST(p_size AS VARCHAR) FROM part) WHERE value IS NOT NULL GROUP BY field, value)""",
    "find_exists_missing": "SELECT d.doc_id, l.quality IS NOT NULL AS has_quality, l.quality IS NULL AS lacks_quality FROM documents d LEFT JOIN labels l USING (doc_id)",
    "find_equals_contains": "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#12' AND contains(p_name, 're')",
    "find_matches": r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\p{L}])[Éé]')",
    "find_gte": "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 90",
    "find_lte": "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 9",
    "inspect_preview": r"""SELECT CAST(doc_id AS VARCHAR) AS path, source AS title, 'idx://documents/' || doc_id AS uri,
  CAST(1 AS BIGINT) AS page_from, doc_id AS page_to, left(regexp_replace(text, '\s+', ' ', 'g'), 80) AS preview FROM documents""",
    "default_exclude_optin": """WITH d AS (SELECT CASE WHEN source IN ('src0', 'src1') THEN 'archive' WHEN source < 'src2' THEN 'books' ELSE 'notes' END AS collection FROM documents)
SELECT collection, count(*) AS n, 'default' AS asked FROM d WHERE collection <> 'archive' GROUP BY 1
UNION ALL SELECT collection, count(*), 'named' FROM d WHERE collection IN ('archive', 'books') GROUP BY 1""",
    "entity_item": f"SELECT id, name, rating FROM {_ITEMS} WHERE source = 'Brand#3' AND kind = 'ECONOMY'",
    "entity_range": f"SELECT id, name, rating, price FROM {_ITEMS} WHERE rating BETWEEN 10 AND 20 AND price <= 1000 AND contains(lower(name), 'ring')",
    "ruleset_preference": f"""WITH r AS (SELECT name, source || '/' || lpad(CAST(id AS VARCHAR), 9, '0') AS source, CASE WHEN rating % 3 = 0 THEN '2024' ELSE '2014' END AS ruleset FROM {_ITEMS})
SELECT name, source, ruleset FROM r QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY CASE ruleset WHEN '2024' THEN 1 ELSE 2 END, source NULLS LAST) = 1""",
    "canonical_then_fallback": _fallback_sql("small ring"),
    "fallback_when_empty": _fallback_sql("no such ring"),
    "entity_render": f"""SELECT name || ' | kind: ' || kind || ' | rating: ' || rating AS text, 'summary' AS output FROM {_ITEMS}
UNION ALL SELECT '## ' || name || chr(10) || '- **kind**: ' || kind || chr(10) || '- **rating**: ' || rating, 'markdown' FROM {_ITEMS}""",
    "importer_contract": f"""SELECT id, name || chr(10) || 'Type ' || kind || chr(10) || 'Rating ' || rating AS text, true AS importable FROM {_ITEMS}
UNION ALL SELECT id, '**' || name || '** strikes for [[/r 1d' || rating || ']].', false FROM {_ITEMS}""",
    "topk_per_group": "SELECT p_type, p_partkey, rank FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC NULLS LAST, p_partkey) AS rank FROM part) WHERE rank <= 3",
    "slug_hash_name": """SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') || '-' || left(sha256(p_name), 12) || '.png' AS file FROM part""",
}
