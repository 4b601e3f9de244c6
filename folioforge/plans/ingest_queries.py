"""Section, ingest and integrity queries on the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import headers, text
from folioforge.operators import ingest, integrity, search, sections
from folioforge.session import table
from folioforge.sources import sinks
from folioforge.streaming import events as stream

VOTES = {"first": ["the", "and"], "second": ["der", "die", "und"], "third": ["los", "que", "las"]}
TAGS = {"legal": ["licensed", "rights"], "contact": ["example", "mail"]}


def hash_dedupe(spark, sf_dir):
    return ingest.deduplicated(table(spark, sf_dir, "documents"))


def ingest_skip_unchanged(spark, sf_dir):
    docs = ingest.hashed(table(spark, sf_dir, "documents")).withColumn("slug", F.col("doc_id").cast("string"))
    seen = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
    return ingest.changed(docs, seen).select("doc_id", "source_hash")


def tag_override(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    auto = docs.select("doc_id", F.concat(F.lit("auto-"), "lang").alias("tag"))
    manual = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id", F.lit("manual").alias("tag"))
    return ingest.overridden(auto, manual, "doc_id", "tag")


def classify_and_tag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", ingest.classify(F.col("text"), VOTES).alias("system"), F.array_join(ingest.tag(F.col("text"), TAGS), ",").alias("tags"), ingest.summarise(F.col("text"), 60).alias("summary"))


def next_steps(spark, sf_dir):
    books = table(spark, sf_dir, "documents").select(F.concat(F.lit("book-"), F.col("doc_id").cast("string")).alias("slug"), (F.col("lang") == "en").alias("has_key"))
    return ingest.next_steps(books.select("slug", "has_key").withColumn("slug", F.concat("slug", F.when(F.col("has_key"), "-k").otherwise("-n"))), F.col("slug").endswith("-k"))


def section_plan(spark, sf_dir):
    return sections.html_plan(table(spark, sf_dir, "pages"))


def section_blocks(spark, sf_dir):
    return sections.html_blocks(table(spark, sf_dir, "pages")).select("page_id", "ord", "kind", F.length("text").cast("long").alias("chars"), "heading")


def _spanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = sections.html_plan(table(spark, sf_dir, "pages")).withColumn("n_pages", F.length("heading") % 4)
    return sections.page_spans(plan, "page_id")


def section_spans(spark, sf_dir):
    return _spanned(spark, sf_dir).select("page_id", "ord", "page_from", "page_to")


def book_overview(spark, sf_dir):
    got = sections.overview(_spanned(spark, sf_dir), "page_id")
    return got.select("page_id", "n_sections", "page_from", "page_to", F.array_join("contents", "/").alias("contents"))


def validate_sections(spark, sf_dir):
    plan = sections.html_plan(table(spark, sf_dir, "pages"))
    lost = plan.filter(~F.contains("heading", F.lit("and")))
    return sections.faults(lost, "page_id")


def link_edges(spark, sf_dir):
    return integrity.href_edges(table(spark, sf_dir, "pages"))


def link_resolution(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    docs = pages.select(F.col("url").alias("path"), F.regexp_extract("html", "<title>([^<., ]*)", 1).alias("title"))
    edges = pages.select(F.col("url").alias("src"), F.explode(F.regexp_extract_all("html", F.lit('<a href="/?([^"]*)"'), F.lit(1))).alias("target")).distinct()
    return integrity.resolved(edges, docs)


def drift_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    canonical = docs.filter("lang <> 'fr'").select("doc_id", text.content_hash(F.col("text")).alias("hash"))
    generated = docs.filter("lang <> 'es'").select("doc_id", text.content_hash(F.when(F.col("lang") == "de", F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("hash"))
    return integrity.drift(generated, canonical, "doc_id", "hash")


def drift_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return integrity.symmetric_difference(docs.filter("lang <> 'fr'").select("lang", "source"), docs.filter("source <> 'src3'").select("lang", "source")).groupBy("lang", "source", "side").agg(F.count("*").alias("n"))


def mirror_changes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("path"), text.content_hash(F.col("text")).alias("hash"))
    target = docs.filter("lang <> 'fr'").withColumn("hash", F.when(F.col("lang") == "de", "old").otherwise(F.col("hash")))
    return sinks.mirror_changes(docs.filter("lang <> 'es'").drop("lang"), target.drop("lang"))


def adapter_drift(spark, sf_dir):
    """Adapters of two targets as they were generated, against what is canonical now."""
    now = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.col("n_regionkey").alias("tier"))
    old = now.filter("tier <> 4").withColumn("tier", F.when(F.col("tier") == 1, 0).otherwise(F.col("tier")))
    prompt = F.concat(F.lit("prompts/"), "name", F.lit(".md")), F.concat(F.lit("# "), "name", F.lit("\n\ntier "), F.col("tier").cast("string"))
    tool = F.when(F.col("tier") < 3, F.concat(F.lit("tools/"), "name", F.lit(".json"))), F.to_json(F.struct("name", "tier"))
    targets = {"prompts": prompt, "tools": tool}
    return integrity.drift(sinks.adapters(old, targets), sinks.adapters(now, targets), "path", "hash")


def pin_status(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    wanted = nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("pin"))
    actual = nation.filter("n_regionkey <> 4").select(F.col("n_name").alias("name"), F.when(F.col("n_regionkey") == 3, "0").otherwise(F.col("n_regionkey").cast("string")).alias("pin"))
    return integrity.pins(wanted, actual)


def cleanup_inventory(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("path", F.when(F.col("source") == "src7", ".cache/xdg/x").otherwise(F.concat(F.lit("vault/"), "source")))
    return integrity.inventory(docs, F.col("source"), F.octet_length("text"))


def write_boundary(spark, sf_dir):
    planned = table(spark, sf_dir, "documents").select(F.when(F.col("lang") == "fr", "archive").when(F.col("lang") == "de", "rules").otherwise("notes").alias("collection"), F.concat(F.lit("vault/"), F.when(F.col("lang") == "es", "../").otherwise(""), "source").alias("path"), "doc_id")
    refused = integrity.forbidden_writes(planned).withColumn("why", F.lit("read-only"))
    return refused.unionByName(planned.filter(~text.inside(F.col("path"), "vault")).withColumn("why", F.lit("outside"))).select("doc_id", "why")


def index_status(spark, sf_dir):
    parts = search.collections({"documents": (table(spark, sf_dir, "documents"), "doc_id", "text"), "benchmark": (table(spark, sf_dir, "benchmark"), "item_id", "text")})
    return integrity.status(parts, F.col("id").cast("long"))


def index_update(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("not contains(text, ' with ')").withColumn("text", F.when(F.contains("text", F.lit(" that ")), F.lit("stale words")).otherwise(F.col("text")))
    now = docs.filter("not contains(text, ' from ')")
    state = ingest.hashed(old).select("doc_id", "source_hash")
    return ingest.refreshed_index(search.postings(old), now, state, search.postings)


def embed_pending(spark, sf_dir):
    return ingest.missing_vectors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings"), "doc_id", "vec_id").select("doc_id")


def doctor_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return integrity.doctor({"text": (docs, F.col("text").isNotNull()), "length": (docs, F.length("text") == F.col("n_chars")), "quality": (table(spark, sf_dir, "labels"), F.col("quality") == 1)})


def claims_unsupported(spark, sf_dir):
    claims = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).distinct()
    facts = table(spark, sf_dir, "customer").filter("c_acctbal > 8000").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return integrity.unsupported(claims, facts, ["nation", "segment"])


def canvas_boards(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    nodes = nation.select(F.col("n_regionkey").alias("board"), F.format_string("n%03d", "n_nationkey").alias("id"), F.col("n_name").alias("text"))
    edges = nation.select(F.col("n_regionkey").alias("board"), F.format_string("e%03d", "n_nationkey").alias("id"), F.format_string("n%03d", "n_nationkey").alias("src"), F.format_string("n%03d", (F.col("n_nationkey") + 5) % 25).alias("dst"))
    boards = sinks.canvas(nodes, edges)
    faults = sinks.canvas_faults(boards).groupBy("board").agg(F.count("*").alias("faults"))
    sizes = boards.select("board", F.size(F.from_json("json", "nodes array<struct<id:string>>").getField("nodes")).cast("long").alias("nodes"))
    return sizes.join(faults, "board", "left").select("board", "nodes", F.coalesce("faults", F.lit(0)).cast("long").alias("faults"))


def events_tumbling(spark, sf_dir):
    return stream.tumbling(table(spark, sf_dir, "events")).select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def yaml_header_parse(spark, sf_dir):
    made = table(spark, sf_dir, "part").select("p_partkey", F.format_string("---\nname: %s\ntags: [%s, part]\nsize: %d\n---\nBody", "p_name", "p_type", "p_size").alias("value"))
    meta = headers.parse_header(headers.header_text(F.col("value")))
    return made.select("p_partkey", meta.alias("meta"), headers.body_text(F.col("value")).alias("body")).select("p_partkey", F.col("meta")["name"][0].alias("name"), F.array_join(F.col("meta")["tags"], ",").alias("tags"), F.col("meta")["size"][0].alias("size"), "body")


def ingest_run(spark, sf_dir):
    """Pages as books, those under an address with parameters ingested before."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("slug"), F.col("html").alias("text"), "url")
    seen = ingest.hashed(pages.filter(F.col("url").contains("?"))).select("slug", "source_hash")
    run = ingest.ingest(pages, seen, lambda books: sections.html_plan(books.withColumnRenamed("text", "html"), "slug"))
    n = run["sections"].groupBy("slug").agg(F.count("*").alias("n_sections"))
    steps = run["next_steps"].groupBy("slug").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "command"))), lambda s: s["command"]), ",").alias("steps"))
    return run["books"].select("slug", "source_hash").join(n, "slug", "left").join(steps, "slug").select("slug", "source_hash", F.coalesce("n_sections", F.lit(0)).alias("n_sections"), "steps")


QUERIES = {f.__name__: f for f in (ingest_run, hash_dedupe, ingest_skip_unchanged, tag_override, classify_and_tag, next_steps, section_plan, section_blocks, section_spans, book_overview, validate_sections, link_edges, link_resolution, drift_report, drift_rows, mirror_changes, adapter_drift, pin_status, cleanup_inventory, write_boundary, index_status, index_update, embed_pending, doctor_report, claims_unsupported, canvas_boards, events_tumbling, yaml_header_parse)}

_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _count(words: list[str]) -> str:
    return f"len(list_filter(t, lambda x: x IN ({', '.join(repr(w) for w in words)})))"


_PLAN = r"""pl AS (SELECT page_id, CASE WHEN len(a) > 0 THEN a WHEN len(h) > 0 THEN h ELSE t END AS names, CASE WHEN len(a) > 0 THEN 'toc' WHEN len(h) > 0 THEN 'heading' ELSE 'title' END AS origin
  FROM (SELECT page_id, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS a, regexp_extract_all(html, '<h1[^>]*>([^<]*)</h1>', 1) AS h, regexp_extract_all(html, '<title>([^<]*)</title>', 1) AS t FROM pages)),
plan AS (SELECT page_id, unnest(generate_series(1, len(names))) AS ord, unnest(names) AS heading, origin FROM pl)"""
_SPAN = f"""{_PLAN}, np AS (SELECT *, length(heading) % 4 AS n_pages FROM plan),
sp AS (SELECT *, coalesce(sum(n_pages) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS s FROM np),
span AS (SELECT page_id, ord, heading, CAST(s AS BIGINT) AS page_from, CAST(greatest(s, s + n_pages - 1) AS BIGINT) AS page_to FROM sp)"""

ORACLE_SQL = {
    "hash_dedupe": "SELECT sha256(text) AS source_hash, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1",
    "ingest_skip_unchanged": "SELECT doc_id, sha256(text) AS source_hash FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "tag_override": "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'auto-' || d.lang ELSE 'manual' END AS tag FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) l USING (doc_id)",
    "classify_and_tag": f"""WITH w AS (SELECT doc_id, text, {_TOK} AS t FROM documents),
v AS (SELECT *, {_count(VOTES['first'])} AS a, {_count(VOTES['second'])} AS b, {_count(VOTES['third'])} AS c FROM w)
SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'unknown' WHEN a = greatest(a, b, c) THEN 'first' WHEN b = greatest(a, b, c) THEN 'second' ELSE 'third' END AS system,
array_to_string(list_filter([CASE WHEN {_count(TAGS['contact'])} > 0 THEN 'contact' END, CASE WHEN {_count(TAGS['legal'])} > 0 THEN 'legal' END], lambda x: x IS NOT NULL), ',') AS tags,
left(trim(split_part(text, chr(10), 1)), 60) AS summary FROM v""",
    "next_steps": """WITH b AS (SELECT 'book-' || doc_id || CASE WHEN lang = 'en' THEN '-k' ELSE '-n' END AS slug, lang = 'en' AS k FROM documents),
s AS (SELECT slug, CASE WHEN k THEN ['classify-system', 'summarize', 'tag', 'index-update', 'index-embed'] ELSE ['index-update', 'index-embed'] END AS steps FROM b)
SELECT slug, unnest(generate_series(1, len(steps))) AS step, unnest(steps) AS command FROM s""",
    "section_plan": f"WITH {_PLAN} SELECT page_id, ord, heading, origin FROM plan",
    "section_blocks": """WITH b AS (SELECT page_id, regexp_extract_all(html, '<(h1|p)[^>]*>([^<]*)<') AS x FROM pages),
u AS (SELECT page_id, unnest(generate_series(1, len(x))) AS ord, unnest(x) AS block FROM b),
k AS (SELECT page_id, ord, regexp_extract(block, '^<(h1|p)', 1) AS kind, regexp_extract(block, '>([^<]*)<', 1) AS text FROM u)
SELECT page_id, ord, kind, length(text) AS chars, last_value(CASE WHEN kind = 'h1' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM k""",
    "section_spans": f"WITH {_SPAN} SELECT page_id, ord, page_from, page_to FROM span",
    "book_overview": f"WITH {_SPAN} SELECT page_id, count(*) AS n_sections, min(page_from) AS page_from, max(page_to) AS page_to, string_agg(heading, '/' ORDER BY ord) AS contents FROM span GROUP BY page_id",
    "validate_sections": f"""WITH {_PLAN}, br AS (SELECT * FROM plan WHERE NOT contains(heading, 'and')),
g AS (SELECT page_id, count(*) AS n, min(ord) AS lo, max(ord) AS hi, count(DISTINCT ord) AS d, count(*) FILTER (coalesce(trim(heading), '') = '') AS bare FROM br GROUP BY 1)
SELECT page_id, 'ordinals' AS fault FROM g WHERE lo <> 1 OR hi <> n OR d <> n UNION ALL SELECT page_id, 'heading' FROM g WHERE bare > 0""",
    "link_edges": """SELECT page_id, target, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS target FROM pages) GROUP BY 1, 2""",
    "ingest_run": f"""WITH {_PLAN} SELECT page_id AS slug, sha256(html) AS source_hash, coalesce(n, 0) AS n_sections, 'classify-system,summarize,tag,index-update,index-embed' AS steps
FROM pages LEFT JOIN (SELECT page_id, count(*) AS n FROM plan GROUP BY 1) USING (page_id) WHERE NOT contains(url, '?')""",
    "link_resolution": r"""WITH e AS (SELECT DISTINCT url AS src, unnest(regexp_extract_all(html, '<a href="/?([^"]*)"', 1)) AS target FROM pages),
t AS (SELECT trim(regexp_replace(lower(regexp_extract(html, '<title>([^<., ]*)', 1)), '[\x20\x09-\x0D]+', ' ', 'g')) AS s, min(url) AS dst FROM pages GROUP BY 1)
SELECT src, target, dst FROM e LEFT JOIN t ON trim(regexp_replace(lower(target), '[\x20\x09-\x0D]+', ' ', 'g')) = t.s""",
    "drift_report": """WITH c AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE lang <> 'fr'), g AS (SELECT doc_id, sha256(CASE WHEN lang = 'de' THEN text || ' ' ELSE text END) AS h FROM documents WHERE lang <> 'es')
SELECT doc_id, CASE WHEN g.doc_id IS NULL THEN 'missing' WHEN c.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS state FROM g FULL JOIN c USING (doc_id) WHERE g.h IS DISTINCT FROM c.h""",
    "drift_rows": """WITH a AS (SELECT lang, source FROM documents WHERE lang <> 'fr'), b AS (SELECT lang, source FROM documents WHERE source <> 'src3')
SELECT lang, source, side, count(*) AS n FROM (SELECT *, 'generated' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'canonical' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL""",
    "mirror_changes": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, lang, sha256(text) AS h FROM documents), s AS (SELECT path, h FROM d WHERE lang <> 'es'), t AS (SELECT path, CASE WHEN lang = 'de' THEN 'old' ELSE h END AS h FROM d WHERE lang <> 'fr')
SELECT path, CASE WHEN t.path IS NULL THEN 'add' WHEN s.path IS NULL THEN 'remove' ELSE 'replace' END AS change FROM s FULL JOIN t USING (path) WHERE s.h IS DISTINCT FROM t.h""",
    "adapter_drift": r"""WITH now AS (SELECT lower(n_name) AS name, n_regionkey AS tier FROM nation), old AS (SELECT name, CASE WHEN tier = 1 THEN 0 ELSE tier END AS tier FROM now WHERE tier <> 4),
c AS (SELECT 'prompts/' || name || '.md' AS path, tier FROM now UNION ALL SELECT 'tools/' || name || '.json', tier FROM now WHERE tier < 3),
g AS (SELECT 'prompts/' || name || '.md' AS path, tier FROM old UNION ALL SELECT 'tools/' || name || '.json', tier FROM old WHERE tier < 3)
SELECT path, CASE WHEN g.path IS NULL THEN 'missing' WHEN c.path IS NULL THEN 'extra' ELSE 'changed' END AS state FROM g FULL JOIN c USING (path) WHERE g.tier IS DISTINCT FROM c.tier""",
    "pin_status": """SELECT n.n_name AS name, CAST(n.n_regionkey AS VARCHAR) AS wanted, a.pin AS actual, CASE WHEN a.pin IS NULL THEN 'absent' WHEN a.pin = CAST(n.n_regionkey AS VARCHAR) THEN 'current' ELSE 'behind' END AS state
FROM nation n LEFT JOIN (SELECT n_name, CASE WHEN n_regionkey = 3 THEN '0' ELSE CAST(n_regionkey AS VARCHAR) END AS pin FROM nation WHERE n_regionkey <> 4) a USING (n_name)""",
    "cleanup_inventory": "SELECT source AS scope, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents WHERE source <> 'src7' GROUP BY 1",
    "write_boundary": "SELECT doc_id, CASE WHEN lang = 'es' THEN 'outside' ELSE 'read-only' END AS why FROM documents WHERE lang IN ('fr', 'de', 'es')",
    "index_status": "SELECT 'documents' AS collection, count(*) AS n, max(doc_id) AS latest FROM documents UNION ALL SELECT 'benchmark', count(*), max(item_id) FROM benchmark",
    "index_update": r"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents WHERE NOT contains(text, ' from ')) GROUP BY 1, 2""",
    "embed_pending": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "doctor_report": """SELECT 'text' AS name, count(*) FILTER (text IS NULL) = 0 AS ok, count(*) FILTER (text IS NULL) AS n FROM documents
UNION ALL SELECT 'length', count(*) FILTER (length(text) <> n_chars) = 0, count(*) FILTER (length(text) <> n_chars) FROM documents
UNION ALL SELECT 'quality', count(*) FILTER (quality <> 1) = 0, count(*) FILTER (quality <> 1) FROM labels""",
    "claims_unsupported": "SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer EXCEPT SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 8000",
    "canvas_boards": """SELECT n.n_regionkey AS board, count(*) AS nodes, count(*) FILTER (d.n_regionkey <> n.n_regionkey) AS faults FROM nation n JOIN nation d ON d.n_nationkey = (n.n_nationkey + 5) % 25 GROUP BY 1""",
    "events_tumbling": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "yaml_header_parse": "SELECT p_partkey, p_name AS name, p_type || ',part' AS tags, CAST(p_size AS VARCHAR) AS size, 'Body' AS body FROM part",
}
