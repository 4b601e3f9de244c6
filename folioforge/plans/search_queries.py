"""Search queries on the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators import facets, search
from folioforge.session import table

TERMS = ["the", "that", "licensed"]


def bm25_scores(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), TERMS).select("doc_id", F.round("score", 6).alias("score"))


def bm25_topk(spark, sf_dir):
    """Flagship: ranked lexical search, joined to the facets of what it finds."""
    docs = table(spark, sf_dir, "documents")
    scored = search.bm25(docs, TERMS).withColumn("score", F.round("score", 6))
    hits = search.top(scored, 10, "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return facets.with_meta(search.citations(hits, docs), labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id")


def bm25_from_index(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.bm25_indexed(search.postings(docs), search.lengths(docs), TERMS).select("doc_id", F.round("score", 6).alias("score"))


def index_postings(spark, sf_dir):
    index = search.postings(table(spark, sf_dir, "documents"))
    return index.join(index.groupBy("term").agg(F.count("*").alias("df")), "term").select("doc_id", "term", "tf", "df")


def _query_vector(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select(F.col("embedding").alias("q"))


def cosine_scores(spark, sf_dir):
    return search.cosine(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).select("vec_id", F.round("score", 6).alias("score"))


def cosine_topk(spark, sf_dir):
    scored = search.cosine(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).withColumn("score", F.round("score", 6))
    return search.top(scored, 10, "vec_id")


def hybrid_rrf_topk(spark, sf_dir):
    lexical = search.bm25(table(spark, sf_dir, "documents"), TERMS).withColumn("score", F.round("score", 6))
    vector = search.cosine(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir)).select(F.col("vec_id").alias("doc_id"), F.round("score", 6).alias("score"))
    fused = search.fuse([search.ranked(lexical, 100, "doc_id"), search.ranked(vector, 100, "doc_id")], "doc_id")
    return search.top(fused.withColumn("score", F.round("score", 9)), 10, "doc_id")


def _everything(spark, sf_dir):
    talks = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws(":", "conv_id", "turn"))
    return search.collections({"documents": (table(spark, sf_dir, "documents"), "doc_id", "text"), "benchmark": (table(spark, sf_dir, "benchmark"), "item_id", "text"), "conversations": (talks, "id", "text")})


def search_multi_collection(spark, sf_dir):
    return search.containing(_everything(spark, sf_dir), "the").select("collection", "id")


def search_cited(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return search.citations(search.containing(docs, "licensed").select("doc_id"), docs)


def lens_fanout_curate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = F.size(text.tokens(F.col("text"))).cast("double")
    lenses = {
        "lexical": search.top(search.bm25(docs, TERMS).withColumn("score", F.round("score", 6)), 50, "doc_id"),
        "long": search.top(docs.select("doc_id", words.alias("score")), 50, "doc_id"),
        "licensed": search.top(search.containing(docs, "licensed").select("doc_id", words.alias("score")), 50, "doc_id"),
        "recent": search.top(docs.select("doc_id", F.col("doc_id").cast("double").alias("score")), 50, "doc_id"),
    }
    return search.curate(search.fan_out(lenses))


QUERIES = {f.__name__: f for f in (bm25_topk, bm25_scores, bm25_from_index, index_postings, cosine_scores, cosine_topk, hybrid_rrf_topk, search_multi_collection, search_cited, lens_fanout_curate)}

_TERMS = ", ".join(f"'{t}'" for t in TERMS)
_BM25 = rf"""tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents),
len AS (SELECT doc_id, len(t) AS len FROM tok),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) WHERE term IN ({_TERMS}) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len) AS avg_len FROM len),
bm AS (SELECT tf.doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
  FROM tf JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY tf.doc_id)"""
_COS = "cs AS (SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
_HAS = r"list_contains(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), '{0}')"

ORACLE_SQL = {
    "bm25_scores": f"WITH {_BM25} SELECT doc_id, score FROM bm",
    "bm25_from_index": f"WITH {_BM25} SELECT doc_id, score FROM bm",
    "bm25_topk": f"WITH {_BM25}, top AS (SELECT * FROM bm ORDER BY score DESC NULLS LAST, doc_id LIMIT 10) SELECT top.doc_id, top.score, d.source, l.quality, d.lang FROM top JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)",
    "index_postings": r"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM documents) GROUP BY 1, 2)
SELECT doc_id, term, tf, count(*) OVER (PARTITION BY term) AS df FROM p""",
    "cosine_scores": f"WITH {_COS} SELECT vec_id, score FROM cs",
    "cosine_topk": f"WITH {_COS} SELECT vec_id, score FROM cs ORDER BY score DESC NULLS LAST, vec_id LIMIT 10",
    "hybrid_rrf_topk": f"""WITH {_BM25}, {_COS},
a AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC NULLS LAST, doc_id) AS rank FROM bm QUALIFY rank <= 100),
b AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY score DESC NULLS LAST, vec_id) AS rank FROM cs QUALIFY rank <= 100)
SELECT doc_id, round(sum(1::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY score DESC NULLS LAST, doc_id LIMIT 10""",
    "search_multi_collection": f"""SELECT 'documents' AS collection, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE {_HAS.format('the')}
UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR) FROM benchmark WHERE {_HAS.format('the')}
UNION ALL SELECT 'conversations', conv_id || ':' || turn FROM conversations WHERE {_HAS.format('the')}""",
    "search_cited": f"SELECT doc_id, source FROM documents WHERE {_HAS.format('licensed')}",
    "lens_fanout_curate": rf"""WITH {_BM25}, l AS (SELECT doc_id, CAST(len AS DOUBLE) AS score FROM len), c AS (
SELECT * FROM (SELECT 'lexical' AS lens, doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'long', doc_id, score FROM l ORDER BY score DESC, doc_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'licensed', doc_id, score FROM l WHERE doc_id IN (SELECT doc_id FROM tok WHERE list_contains(t, 'licensed')) ORDER BY score DESC, doc_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'recent', doc_id, CAST(doc_id AS DOUBLE) AS score FROM len ORDER BY score DESC, doc_id LIMIT 50))
SELECT doc_id, count(DISTINCT lens) AS votes, max(score) AS best, string_agg(DISTINCT lens, ',' ORDER BY lens) AS lenses FROM c GROUP BY doc_id""",
}
