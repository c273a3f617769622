"""DuckDB SQL for the queries whose results SQL can say, over the whole tables.

Suffix deduplication compares the digests of all 100-byte strings; the Jaccard join counts shared shingles of all
pairs that share any, and follows the links; the secret scan cuts texts at the matches and adds up the lengths.
"""

from __future__ import annotations

import string

from pairloom.llm.secret_links import BASE, KINDS, SCOPE
from pairloom.llm.suffix_dedup import LENGTH

ORACLES: dict[str, str] = {}

ORACLES["op3_suffix_dedup"] = f"""
WITH texts AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(len(d))) AS pos, unnest(d) AS digest FROM (
    SELECT doc_id, [md5(substr(h, 2 * p + 1, {2 * LENGTH})) FOR p IN range(len(h) // 2 - {LENGTH} + 1)] AS d FROM texts WHERE len(h) >= {2 * LENGTH})),
strings AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY digest ORDER BY doc_id, pos) AS place FROM starts),
gone AS (SELECT doc_id, pos, max(pos + {LENGTH}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
         FROM strings WHERE place > 1),
numbered AS (SELECT doc_id, pos, count(*) FILTER (reach IS NULL OR pos > reach) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM gone),
spans AS (SELECT doc_id, span, min(pos) AS a, max(pos) + {LENGTH} AS b FROM numbered GROUP BY doc_id, span),
kept AS (
    SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY span)
    UNION ALL SELECT doc_id, max(b), 1000000000::BIGINT FROM spans GROUP BY doc_id),
rest AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h FROM kept JOIN texts USING (doc_id) GROUP BY doc_id),
counted AS (SELECT doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed FROM spans GROUP BY doc_id)
SELECT t.doc_id, (len(t.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(r.h, t.h))) AS kept_sha256
FROM texts t LEFT JOIN rest r USING (doc_id) LEFT JOIN counted USING (doc_id)"""

WORD = r"[^\x20\x09-\x0D]+"

ORACLES["op7_jaccard_join"] = f"""
WITH RECURSIVE found AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] END) AS s FROM found),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM shingles a JOIN shingles b USING (s) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * o >= 90 * (p.n + q.n - o)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT y, root FROM reach JOIN edges ON x = node)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node)
LEFT JOIN sizes USING (doc_id)"""


def _matches(number: int) -> str:
    """Spans of one kind."""
    kind = KINDS[number]
    pattern = "'" + kind.pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {number} AS kind, upto + before AS a, upto + before + len(m) AS b FROM (
        SELECT doc_id, m, g, len(s) AS before,
               coalesce(sum(len(s) + len(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS upto
        FROM (SELECT doc_id, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(gs) AS g, unnest(segs[1:len(ms)]) AS s FROM (
            SELECT doc_id, regexp_extract_all(text, {pattern}, 0) AS ms, regexp_extract_all(text, {pattern}, {kind.group}) AS gs,
                   string_split_regex(text, {pattern}) AS segs FROM documents WHERE regexp_matches(text, {pattern}))))
        WHERE len(g) >= {kind.least}"""


def _near(role: str) -> str:
    own = f"FILTER (kind IN ({', '.join(str(k) for k, kind in enumerate(KINDS) if kind.role == role)}))"
    return f"""(coalesce(max(b) {own} OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a - {SCOPE}, false)
        OR coalesce(min(a) {own} OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) <= b + {SCOPE}, false)) AS {role}"""


ORACLES["op10_secret_links"] = f"""
WITH spans AS ({" UNION ALL ".join(_matches(k) for k in range(len(KINDS)))}),
scoped AS (SELECT *, {", ".join(_near(role) for role in ("identifier", "secret", "endpoint"))}
           FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a, kind)),
told AS (SELECT *, [{", ".join(f"'{kind.name}'" for kind in KINDS)}][kind + 1] || ':' || a || ':' || b AS shown FROM scoped
         WHERE kind < {BASE} OR (kind = 3 AND identifier) OR (kind = 4 AND secret AND endpoint) OR (kind = 5 AND identifier AND secret)),
listed AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{KINDS[k].name}" for k in range(BASE))},
    string_agg(shown, ',' ORDER BY a, kind) FILTER (kind < {BASE}) AS base, string_agg(shown, ',' ORDER BY a, kind) AS spans,
    count(*) FILTER (kind >= {BASE}) AS n_linked FROM told GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{KINDS[k].name}, 0) AS n_{KINDS[k].name}" for k in range(BASE))},
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM documents LEFT JOIN listed USING (doc_id)"""
