"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .near_dup import WORDS
from .secret_scan import BASE, RULES
from .substring_dedup import WINDOW

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_dup(percent: int) -> str:
    """Links by all common shingles, components by closure."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[s:s + {WORDS - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - {WORDS - 2}, 2))) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {percent} * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id, d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id"""


def substring_dedup() -> str:
    """Windows as strings, counted over the corpus."""
    return f"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
h AS (SELECT doc_id, s, array_to_string(ws[s:s + {WINDOW - 1}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS s FROM w WHERE len(ws) >= {WINDOW})),
d AS (SELECT k FROM h GROUP BY k HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, s + j AS p FROM (SELECT doc_id, s, unnest(range(0, {WINDOW})) AS j FROM h JOIN d USING (k))),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.p) AS kept, count(*) AS n FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p WHERE c.p IS NULL GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secret_scan() -> str:
    """Spans from the lengths of what lies between matches."""
    each = []
    for rank, rule in enumerate(RULES):
        p = _quoted(rule.pattern)
        each.append(
            f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, a AS start_, a + length(m[i]) AS end_ FROM (SELECT doc_id, m, v, i, CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
 FROM (SELECT doc_id, regexp_extract_all(t, {p}, 0) AS m, regexp_extract_all(t, {p}, {rule.group}) AS v, regexp_split_to_array(t, {p}) AS g, unnest(range(1, len(regexp_extract_all(t, {p}, 0)) + 1)) AS i FROM d)) WHERE length(v[i]) >= {rule.least}"""
        )
    spans = " UNION ALL ".join(each)
    joined = lambda cond: f"string_agg(kind || ':' || start_ || ':' || end_, ',' ORDER BY start_, rank) FILTER ({cond})"
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    sums = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS ({spans}),
f AS (SELECT doc_id, {sums}, {joined(f'rank < {len(BASE)}')} AS base, {joined('TRUE')} AS all_ FROM s GROUP BY doc_id)
SELECT d.doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(all_, '') AS spans FROM d LEFT JOIN f USING (doc_id)"""
