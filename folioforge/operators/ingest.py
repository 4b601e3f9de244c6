"""Incremental ingest: skip by hash, classify, summarise, tag, next steps, checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text

LLM_MODES = ("no", "images-only", "text-only", "all")
STEPS = ("classify-system", "summarize", "tag", "index-update", "index-embed")


def hashed(docs: DataFrame, body: str = "text") -> DataFrame:
    return docs.withColumn("source_hash", text.content_hash(F.col(body)))


def changed(incoming: DataFrame, seen: DataFrame, keys: tuple[str, ...] = ("slug", "source_hash")) -> DataFrame:
    """Incoming rows whose keys have not been ingested; null-safe."""
    a, b = incoming.alias("a"), seen.select(*keys).distinct().alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left_anti")


def deduplicated(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(source_hash, first, n): one row a distinct text."""
    return hashed(docs).groupBy("source_hash").agg(F.min(key).alias("first"), F.count("*").alias("n"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _votes(words: Column, keywords: list[str]) -> Column:
    return F.size(F.filter(words, lambda w: w.isin(*keywords)))


def classify(c: Column, votes: dict[str, list[str]], default: str = "unknown") -> Column:
    """The class whose keywords occur most often as tokens; ties go to the class
    named first, no votes to the default.  Any column function may take its place."""
    names = F.array(*[F.lit(n) for n in votes])

    def first(counts: Column) -> Column:
        best = F.array_max(counts)
        return F.when(best > 0, F.element_at(names, F.array_position(counts, best).cast("int"))).otherwise(default)

    counted = _once(text.tokens(c), lambda words: F.array(*[_votes(words, k) for k in votes.values()]))
    return F.when(c.isNull(), default).otherwise(_once(counted, first))


def summarise(c: Column, n: int = 120) -> Column:
    """Extractive: the first line, at most n characters."""
    return F.left(F.trim(F.split(c, "\n", 2)[0]), F.lit(n))


def tag(c: Column, rules: dict[str, list[str]]) -> Column:
    """Tags of which a keyword occurs, in alphabetical order."""
    return _once(text.tokens(c), lambda words: F.array_compact(F.array(*[F.when(F.arrays_overlap(words, F.array(*[F.lit(k) for k in rules[t]])), F.lit(t)) for t in sorted(rules)])))


def overridden(auto: DataFrame, manual: DataFrame, key: str, column: str) -> DataFrame:
    """Manual values where there are any, else the automatic ones."""
    by_hand = manual.select(key, F.col(column).alias("_manual"))
    return auto.join(by_hand, key, "left").withColumn(column, F.coalesce("_manual", column)).drop("_manual")


def next_steps(books: DataFrame, has_key: Column) -> DataFrame:
    """(slug, step, command): steps that need a key are left out without one; the
    rest stay in order and are numbered from 1."""
    needs = set(STEPS[:3])
    steps = F.array_compact(F.array(*[F.when(has_key | F.lit(s not in needs), F.lit(s)) for s in STEPS]))
    return books.select("slug", F.posexplode(steps).alias("step", "command")).select("slug", (F.col("step") + 1).cast("long").alias("step"), "command")


def ingest(docs: DataFrame, seen: DataFrame, plan: Callable[[DataFrame], DataFrame], mode: str = "no", votes: dict[str, list[str]] | None = None, rules: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """One run over (slug, text, ...): hash, skip what `seen` (slug, source_hash) has,
    plan sections, enrich, next steps.  plan(books) gives (slug, ord, heading, ...).

    Only the modes text-only and all classify, summarise and tag here (books get
    system, summary, tags); in the others these stay among the next steps.  Steps
    that index follow in any mode.  Tables: books, sections, next_steps, state (what
    the next run is to skip)."""
    if mode not in LLM_MODES:
        raise ValueError(f"mode not among {', '.join(LLM_MODES)}: {mode}")
    books = changed(hashed(docs), seen)
    enriched = mode in ("text-only", "all")
    if enriched:
        body = F.col("text")
        books = books.withColumns({"system": classify(body, votes or {}), "summary": summarise(body), "tags": tag(body, rules or {})}) if votes and rules else books.withColumn("summary", summarise(body))
    state = seen.select("slug", "source_hash").unionByName(books.select("slug", "source_hash")).distinct()
    return {"books": books, "sections": plan(books), "next_steps": next_steps(books, F.lit(not enriched)), "state": state}


def missing_vectors(docs: DataFrame, vectors: DataFrame, key: str, vector_key: str) -> DataFrame:
    """Documents that have no vector yet."""
    return docs.join(vectors.select(F.col(vector_key).alias(key)), key, "left_anti")


def refreshed_index(index: DataFrame, docs: DataFrame, state: DataFrame, build: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> DataFrame:
    """The index after an update: postings of texts that are gone or changed leave,
    those of new or changed texts enter; unchanged texts are not read again."""
    now = hashed(docs)
    fresh = changed(now, state, (key, "source_hash"))
    kept = state.join(now.select(key, "source_hash"), [key, "source_hash"], "left_semi").select(key)
    return index.join(kept, key, "left_semi").unionByName(build(fresh))


def validated(books: DataFrame, sections: DataFrame) -> DataFrame:
    """(slug, fault) over hashes and section ordinals."""
    from folioforge.operators import sections as S

    bare = books.filter("source_hash is null").select("slug", F.lit("hash").alias("fault"))
    empty = books.join(sections.select("slug").distinct(), "slug", "left_anti").select("slug", F.lit("sections").alias("fault"))
    return bare.unionByName(empty).unionByName(S.faults(sections, "slug"))
