"""A training corpus in five stages: language ID, near-duplicates, repeated
passages, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of `documents`.  Null texts count as empty; ids may be null or
repeat; further columns of the input are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import common as C
from folioforge.llm import decontaminate, langid, packing, repeats, shingles, suffixes, tokens

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: documents without a letter, or of no language with a posterior
    of LEAST_SCORE, go."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs, langid.vocabulary_path())
    return langid.annotate(docs, model).filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("lang_score") >= LEAST_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 with five words and 0.8: of each group the document of smallest
    id stays (of equal ids that of smallest row key); documents without words stay."""
    docs = docs.select(*COLUMNS)
    found = C.stored(shingles.similar(docs, 5, 4, 5), "groups")
    first = found.filter("n_shingles > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k")).alias("first")).select(F.col("first.k").alias("k"))
    rows = repeats.keyed(docs, COLUMNS[2:])
    kept = rows.join(first.distinct(), "k", "left_semi").dropDuplicates(["k"])
    empty = found.filter("n_shingles = 0").select("k").distinct()
    return kept.unionByName(rows.join(empty, "k", "left_semi")).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3 over words: passages of over 50 words that occur anywhere else too
    go, each word with the space behind it."""
    out = suffixes.remove_passages(docs, COLUMNS[2:4])
    return out.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.length("kept").cast("long").alias("n_chars"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a copy of a benchmark item go."""
    found = decontaminate.contaminated(docs, C.table(spark, sf_dir, "benchmark"))
    return repeats.keyed(docs, COLUMNS[2:]).join(found.select("k").distinct(), "k", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces with their sequence and offset."""
    return packing.pack(packing.pieces(docs, tokens.vocabulary_path()))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("packed", packed),
]

#: SQL cannot express the trained, aligned and packed stages; tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = C.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = C.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            C.forget(before)
        before = docs
    return docs
