"""SQL that must give the rows of operators it can express (op5's stands beside its code)."""

from __future__ import annotations


def _windows(join: str) -> str:
    """CTEs from t1 (doc_id, i, x), the tokens of documents, to m: which tokens a window of 50 that a smaller doc_id holds covers.

    s50 is a token and the 49 after it, joined; it is put together from those of 2, 4, ... tokens.
    """
    own = "OVER (PARTITION BY doc_id ORDER BY i)"
    parts = []
    for k in (1, 2, 4, 8, 16):
        one = "x" if k == 1 else f"s{k}"
        parts.append(f"t{2 * k} AS (SELECT *, {one} || {join}lead({one}, {k}) {own} AS s{2 * k} FROM t{k})")
    parts.append(f"w AS (SELECT doc_id, i, s32 || {join}lead(s16, 32) {own} || {join}lead(s2, 48) {own} AS s50 FROM t32)")
    parts.append("f AS (SELECT s50, min(doc_id) AS first FROM w WHERE s50 IS NOT NULL GROUP BY s50)")
    parts.append("g AS (SELECT doc_id, i AS start FROM w JOIN f USING (s50) WHERE first < doc_id)")
    parts.append(
        "m AS (SELECT t1.doc_id, t1.i, t1.x, coalesce(max(start) OVER (PARTITION BY t1.doc_id ORDER BY t1.i) + 50 > t1.i, false) AS gone "
        "FROM t1 LEFT JOIN g ON t1.doc_id = g.doc_id AND t1.i = g.start)"
    )
    return ",\n".join(parts)


OP4_SQL = f"""
WITH t1 AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents)),
{_windows("")},
r AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM m)
SELECT d.doc_id, count(i)::BIGINT AS n_bytes, count(*) FILTER (WHERE gone)::BIGINT AS n_removed, count(*) FILTER (WHERE opens)::BIGINT AS n_spans,
       sha256(unhex(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id GROUP BY d.doc_id
"""

_BLANK = "' ' || "
OP8_SQL = f"""
WITH t1 AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS l FROM documents)),
{_windows(_BLANK)}
SELECT d.doc_id, count(x)::BIGINT AS n_words, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""

OP7_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
a AS (SELECT vec_id, label, v FROM e WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(v) > 0
      AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT x.vec_id AS i, y.vec_id AS j FROM a x JOIN a y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
      WHERE list_cosine_similarity(x.v, y.v) >= 0.98),
r(i, j) AS (SELECT i, j FROM p UNION SELECT r.i, p.j FROM r JOIN p ON r.j = p.i),
c AS (SELECT i, min(j) AS least FROM r GROUP BY i),
n AS (SELECT i, count(*) AS links FROM p GROUP BY i)
SELECT e.vec_id, coalesce(n.links, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id))::BIGINT AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.least, e.vec_id)) AS kept
FROM e LEFT JOIN c ON e.vec_id = c.i LEFT JOIN n ON e.vec_id = n.i
"""
