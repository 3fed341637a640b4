"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP9 = f"""
WITH l AS (SELECT doc_id, g.i AS i, lines[g.i] AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
                LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i) g),
k AS (SELECT doc_id, i, line, {_LOWER.format(f"trim(line, {_WS})")} AS key FROM l),
d AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, d.last IS NOT NULL AND d.last <> k.doc_id AS gone FROM k LEFT JOIN d USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

#: n-grams as texts, whose words hold no space; s1, s2, s3: what other documents have of the ones that end at a word.
_OP4 = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[ ' || chr(9) || '-' || chr(13) || ']+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, ws, len(ws) AS n, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT doc_id, n, i, ws[i] AS g1,
             CASE WHEN i >= 2 THEN ws[i - 1] || ' ' || ws[i] END AS g2,
             CASE WHEN i >= 3 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS g3 FROM w),
s AS (SELECT doc_id, i, greatest((SELECT sum(len(ws)) FROM d) - n, 1) AS others,
             count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY doc_id, g1) AS s1,
             CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY doc_id, g2) END AS s2,
             CASE WHEN i >= 3 THEN count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY doc_id, g3) END AS s3 FROM g),
c AS (SELECT *, lag(s1) OVER (PARTITION BY doc_id ORDER BY i) AS c2, lag(s2) OVER (PARTITION BY doc_id ORDER BY i) AS c3 FROM s),
o AS (SELECT doc_id, CASE WHEN s1 > 0 THEN ln(s1) ELSE ln(0.4) END - ln(others) AS o1, s2, s3, c2, c3 FROM c),
p AS (SELECT doc_id, s3, c3, CASE WHEN s2 IS NULL THEN o1 WHEN s2 > 0 THEN ln(s2) - ln(greatest(c2, 1)) ELSE o1 + ln(0.4) END AS o2 FROM o),
q AS (SELECT doc_id, sum(CASE WHEN s3 IS NULL THEN o2 WHEN s3 > 0 THEN ln(s3) - ln(greatest(c3, 1)) ELSE o2 + ln(0.4) END) AS total FROM p GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(total, 0.0), 4) AS log_score, round(coalesce(total, 0.0) / greatest(len(ws), 1), 6) AS mean_log_score
FROM d LEFT JOIN q ON d.doc_id = q.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op4_lm_scoring": _OP4,
    "op9_line_dedup": _OP9,
}
