"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 4 THEN list_transform(generate_series(1, len(t) - 3), lambda i: array_to_string(t[i : i + 3], ' ')) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY 1) c USING (doc_id)"""

_COVERED = """w AS (SELECT doc_id, {words} AS t FROM documents),
e AS (SELECT doc_id, unnest(generate_series(1, len(t))) AS i, unnest(t) AS word, t FROM w),
k AS (SELECT doc_id, i, word, CASE WHEN i + {more} <= len(t) THEN array_to_string(t[i : i + {more}], ' ') END AS win FROM e),
f AS (SELECT doc_id, i, word, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM k),
g AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {more} PRECEDING AND CURRENT ROW) AS gone FROM f)"""


def _covered(width: int) -> str:
    """g(doc_id, i, word, gone): words, and whether a repeated window covers them."""
    return _COVERED.format(words=_WORDS.format("coalesce(text, '')"), more=width - 1)


WINDOWS = f"""WITH {_covered(35)},
a AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN a USING (doc_id)"""

VECTORS = """WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.98),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)"""

#: Bytes as hex digits; strings of 400 bytes by their md5.
STRINGS = f"""WITH p AS (WITH {_covered(51)} SELECT doc_id, count(*) FILTER (gone) AS passage_words FROM g GROUP BY 1),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
e AS (SELECT doc_id, unnest(generate_series(0, len(x) // 2 - 1)) AS i, x FROM d),
k AS (SELECT doc_id, i, substr(x, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 800 <= len(x) THEN md5(substr(x, 2 * i + 1, 800)) END AS win FROM e),
f AS (SELECT doc_id, i, byte, win IS NOT NULL AND count(*) OVER (PARTITION BY win) > 1 AS again FROM k),
g AS (SELECT doc_id, i, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 399 PRECEDING AND CURRENT ROW) AS gone FROM f),
h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM g),
a AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM h GROUP BY 1)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256, coalesce(passage_words, 0) AS passage_words FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN p USING (doc_id)"""
