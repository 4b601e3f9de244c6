"""Typed lookup of canonical records, with search as the fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULESETS = ("2014", "2024", "either")

#: What each entity type can be filtered by: field -> how.
FILTERS = {
    "creature": {"name": "name", "source": "equals", "cr": "range", "type": "equals", "size": "any", "alignment": "equals", "environment": "any"},
    "spell": {"name": "name", "source": "equals", "level": "range", "school": "equals", "class": "any", "concentration": "flag", "ritual": "flag"},
    "item": {"name": "name", "source": "equals", "rarity": "equals", "kind": "equals", "attunement": "flag"},
}


def condition(field: str, how: str, wanted) -> Column:
    """range takes (lo, hi), either end may be None, or a single value."""
    c = F.col(field)
    if how == "name":
        return F.lower(c) == str(wanted).lower()
    if how == "range":
        lo, hi = wanted if isinstance(wanted, (tuple, list)) else (wanted, wanted)
        return (F.lit(True) if lo is None else c >= lo) & (F.lit(True) if hi is None else c <= hi)
    if how == "any":
        return F.arrays_overlap(c, F.array(*[F.lit(w) for w in (wanted if isinstance(wanted, (tuple, list)) else [wanted])]))
    if how == "flag":
        return c == F.lit(bool(wanted))
    return c == F.lit(wanted)


def prefer(records: DataFrame, ruleset: str, key: str = "name", order: tuple[str, ...] = ("2024", "2014")) -> DataFrame:
    """A named ruleset filters; `either` keeps one record a name, the first in
    `order`, ties by source."""
    if ruleset not in RULESETS:
        raise ValueError(f"ruleset not among {', '.join(RULESETS)}: {ruleset}")
    if ruleset != "either":
        return records.filter(F.col("ruleset") == ruleset)
    rank = F.coalesce(F.array_position(F.array(*[F.lit(o) for o in order]), F.col("ruleset")), F.lit(0))
    place = F.when(rank == 0, len(order) + 1).otherwise(rank)
    turn = F.row_number().over(Window.partitionBy(F.lower(key)).orderBy(place, F.col("source").asc_nulls_last()))
    return records.withColumn("_turn", turn).filter("_turn = 1").drop("_turn")


def lookup(tables: dict[str, DataFrame], entity: str, ruleset: str | None = None, partial: str | None = None, **filters) -> DataFrame:
    """Records of an entity type under its documented filters; partial: a part of
    the name, any case.  An unknown type or filter is an error."""
    if entity not in FILTERS:
        raise ValueError(f"unsupported entity type: {entity}")
    out = tables[entity]
    for field, wanted in filters.items():
        if field not in FILTERS[entity]:
            raise ValueError(f"{entity} has no filter {field}")
        out = out.filter(condition(field, FILTERS[entity][field], wanted))
    if partial is not None:
        out = out.filter(F.contains(F.lower("name"), F.lit(partial.lower())))
    return prefer(out, ruleset) if ruleset else out


def canonical_else(canonical: DataFrame, fallback: DataFrame) -> DataFrame:
    """All canonical rows; the fallback's only where there are none.  The guard is a
    one-row aggregate that the fallback joins, so nothing is collected."""
    none = canonical.agg((F.count("*") == 0).alias("_empty")).filter("_empty")
    return canonical.withColumn("tier", F.lit("canonical")).unionByName(fallback.join(F.broadcast(none), how="cross").drop("_empty").withColumn("tier", F.lit("fallback")))
