"""Lexical, vector and fused ranking.

Constants are our own choice (the usual published ones): BM25 k1 = 1.2, b = 0.75;
reciprocal rank fusion k = 60.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions import text

K1, B = 1.2, 0.75
RRF_K = 60
BUCKETS = 256


def postings(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """The inverted index: (key, term, tf)."""
    return docs.select(key, F.explode(text.tokens(F.col(body))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, len): tokens a document, empty ones too."""
    return docs.select(key, F.coalesce(F.size(text.tokens(F.col(body))), F.lit(0)).cast("long").alias("len"))


def statistics(index: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(term, df) and the one-row (n, avg_len)."""
    return index.groupBy("term").agg(F.count("*").alias("df")), sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def _weight(tf: Column, df: Column, n: Column, size: Column, mean: Column) -> Column:
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))


def bm25(docs: DataFrame, terms: list[str], key: str = "doc_id", body: str = "text") -> DataFrame:
    """(key, score) of the documents that hold a term, without an index: one scan
    for the statistics, a row of them broadcast, one scan for the scores.  Only
    partial sums and the query terms' own hits are shuffled.  (The generator keeps
    Catalyst from copying the tokenizer into pushed filters.)"""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    words = docs.select(key, text.tokens(F.col(body)).alias("_t"))
    found = words.select(key, F.coalesce(F.size("_t"), F.lit(0)).cast("double").alias("_len"), F.filter("_t", lambda w: w.isin(*terms)).alias("_hits"))
    df = F.map_from_arrays(F.array(*[F.lit(t) for t in terms]), F.array(*[F.sum(F.coalesce(F.array_contains("_hits", t), F.lit(False)).cast("double")) for t in terms]))
    stats = found.agg(F.count("*").cast("double").alias("_n"), F.avg("_len").alias("_avg"), df.alias("_df"))
    hits = found.select(key, "_len", F.explode("_hits").alias("_term")).groupBy(key, "_len", "_term").agg(F.count("*").cast("double").alias("_tf"))
    weight = _weight(F.col("_tf"), F.col("_df")[F.col("_term")], F.col("_n"), F.col("_len"), F.col("_avg"))
    return hits.join(F.broadcast(stats), how="cross").groupBy(key).agg(F.sum(weight).alias("score"))


def bm25_indexed(index: DataFrame, sizes: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """The same from a stored index: the terms' postings only, pruned by the filter
    on term."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    hits = index.filter(F.col("term").isin(*terms))
    df, total = statistics(hits, sizes)
    scored = hits.join(F.broadcast(df), "term").join(sizes, key).join(F.broadcast(total), how="cross")  # df has a row a query term
    return scored.groupBy(key).agg(F.sum(_weight(F.col("tf").cast("double"), F.col("df"), F.col("n"), F.col("len"), F.col("avg_len"))).alias("score"))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def write_index(docs: DataFrame, out: str, key: str = "doc_id", body: str = "text") -> None:
    """Stores the index under `out`: postings in a folder a bucket of terms, sorted by
    term within files, and lengths.  What was there goes.  Adaptive execution splits
    the bucket of a frequent term over several files."""
    index = postings(docs, key, body).withColumn("bucket", _bucket(F.col("term")))
    index.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/postings")
    lengths(docs, key, body).write.mode("overwrite").parquet(f"{out}/lengths")


def bm25_stored(spark: SparkSession, out: str, terms: list[str], key: str = "doc_id") -> DataFrame:
    """bm25() from a stored index: no text is read, and only the folders of the query's
    terms, within them the row groups that can hold a term."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    wanted = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).collect()}) if terms else []
    index = spark.read.parquet(f"{out}/postings").filter(F.col("bucket").isin(*wanted)).drop("bucket")
    return bm25_indexed(index, spark.read.parquet(f"{out}/lengths"), terms, key)


def cosine(vectors: DataFrame, query: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score) against a one-row query(q), exact and in double precision."""
    one = F.broadcast(query.limit(1))
    return vectors.join(one, how="cross").select(key, text.cosine(F.col(vector), F.col("q")).alias("score"))


def top(scored: DataFrame, k: int, key: str) -> DataFrame:
    """The k best, ties by key: a top-k report."""
    return scored.orderBy(F.col("score").desc_nulls_last(), F.col(key).asc_nulls_last()).limit(k)


def ranked(scored: DataFrame, k: int, key: str) -> DataFrame:
    """top() with its rank from 1; the window sees k rows."""
    order = Window.orderBy(F.col("score").desc_nulls_last(), F.col(key).asc_nulls_last())
    return top(scored, k, key).withColumn("rank", F.row_number().over(order))


def fuse(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (key, rank) lists: (key, score)."""
    out = lists[0].select(key, "rank")
    for other in lists[1:]:
        out = out.unionByName(other.select(key, "rank"))
    return out.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def collections(parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """(collection, id, text) over several tables, given as name -> (table, id, text)."""
    out = None
    for name, (df, key, body) in parts.items():
        part = df.select(F.lit(name).alias("collection"), F.col(key).cast("string").alias("id"), F.col(body).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def containing(docs: DataFrame, term: str) -> DataFrame:
    """Documents with the term as a whole token."""
    return docs.filter(F.array_contains(text.tokens(F.col("text")), F.lit(term.lower())))


def citations(hits: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits beside the source that each must cite."""
    return hits.join(docs.select(key, "source"), key, "left")


def fan_out(lenses: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """Candidates of independent lenses: (lens, key, score)."""
    out = None
    for name, df in lenses.items():
        part = df.select(F.lit(name).alias("lens"), key, "score")
        out = part if out is None else out.unionByName(part)
    return out


def curate(candidates: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a candidate: how many lenses name it, its best score, which ones."""
    return candidates.groupBy(key).agg(F.countDistinct("lens").alias("votes"), F.max("score").alias("best"), F.array_join(F.array_sort(F.collect_set("lens")), ",").alias("lenses"))


def top_per_group(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    order = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(tie).asc_nulls_last())
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
