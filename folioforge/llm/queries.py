"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import sql
from .decontaminate import op10_decontaminate
from .langid import op9_langid
from .packing import op7_packing
from .quality import op2_quality
from .shingles import op5_jaccard
from .substrings import op6_substrings
from .suffixes import op3_suffixes
from .tokens import op4_token_files
from .toxicity import op1_toxicity
from .vectors import op8_vectors

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_suffixes": op3_suffixes,
    "op4_token_files": op4_token_files,
    "op5_jaccard": op5_jaccard,
    "op6_substrings": op6_substrings,
    "op7_packing": op7_packing,
    "op8_vectors": op8_vectors,
    "op9_langid": op9_langid,
    "op10_decontaminate": op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op3_suffixes": sql.STRINGS,
    "op5_jaccard": sql.JACCARD,
    "op6_substrings": sql.WINDOWS,
    "op8_vectors": sql.VECTORS,
}
