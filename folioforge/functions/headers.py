"""Document headers: a block of YAML between two `---` lines at the top."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"
META = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def header_text(text: Column) -> Column:
    """The block without its fences; null if there is none."""
    return F.when(F.regexp_like(text, F.lit(HEADER)), F.regexp_extract(text, HEADER, 1))


def body_text(text: Column) -> Column:
    return F.regexp_replace(text, HEADER, "")


def _plain(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def _field_values(text: str | None) -> dict | None:
    import yaml

    if text is None:
        return None
    try:
        got = yaml.load(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        return None
    if not isinstance(got, dict):
        return {}
    return {str(k): [_plain(x) for x in (v if isinstance(v, list) else [v])] for k, v in got.items()}


@F.pandas_udf(META)
def parse_header(text: pd.Series) -> pd.Series:
    """Full YAML to field -> values.  Spark has no YAML expression, so Arrow batches
    go through Python.  Null or broken headers give null, headers that are not a
    mapping an empty map; scalars become one value, booleans true/false."""
    known = {t: _field_values(t) for t in text.dropna().unique()}  # each distinct header of a batch once
    return text.map(lambda t: known.get(t))
