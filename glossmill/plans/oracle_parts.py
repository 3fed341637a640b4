"""Common table expressions of the DuckDB oracles."""

from __future__ import annotations

from ..functions.text import CJK, LATIN, TOKEN
from .views import MIXED_FROM, MIXED_TO, THAI_FROM, THAI_TO, VARIANT_FROM, VARIANT_TO

LANG = f"CASE WHEN regexp_matches({{0}}, '^[{CJK}]') THEN 'zh' WHEN regexp_matches({{0}}, '^[{LATIN}]') THEN 'en' WHEN regexp_matches({{0}}, '^\\p{{{{Nd}}}}') THEN 'num' ELSE 'other' END"
LANG = LANG.replace("{{", "{").replace("}}", "}").replace("{0}", "%s")

PAIRS = f"""
s0 AS (SELECT conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '[.!?\\n]+') AS us FROM conversations),
s1 AS (SELECT conv_id, turn, role, unnest(us) AS u, generate_subscripts(us, 1) - 1 AS kk FROM s0),
s2 AS (SELECT conv_id, turn, role, kk, translate(lower(trim(u, ' ')), '{MIXED_FROM}', '{MIXED_TO}') AS ref FROM s1),
s3 AS (SELECT conv_id, role, ref, row_number() OVER (PARTITION BY conv_id ORDER BY turn, kk) - 1 AS "index" FROM s2 WHERE ref <> ''),
s4 AS (SELECT conv_id * 1000000 + "index" AS id, conv_id, role, "index", ref, "index" % 8 AS k,
              lead(ref) OVER (PARTITION BY conv_id ORDER BY "index") AS nx, lag(ref) OVER (PARTITION BY conv_id ORDER BY "index") AS pv FROM s3),
pairs AS (SELECT id, conv_id, role, "index", k, ref, CASE k WHEN 0 THEN ref
   WHEN 1 THEN regexp_replace(ref, '[A-Za-z\\x{{c0}}-\\x{{24f}}]+', '', 'g') WHEN 2 THEN regexp_replace(ref, '[\\x{{4e00}}-\\x{{9fff}}]', '', 'g')
   WHEN 3 THEN ref || ' ' || ref || ' ' || ref WHEN 4 THEN translate(regexp_replace(ref, 'th[a-z]*', '會議', 'g'), '{VARIANT_FROM}', '{VARIANT_TO}')
   WHEN 5 THEN CASE WHEN "index" % 16 = 13 THEN coalesce(pv, '') ELSE translate(ref, '{THAI_FROM}', '{THAI_TO}') END WHEN 6 THEN coalesce(nx, '') ELSE coalesce(pv, '') END AS hyp FROM s4)"""

TOKENS = (
    PAIRS
    + f""",
t0 AS (SELECT *, regexp_extract_all(ref, '{TOKEN.replace("'", "''")}', 1) AS r, regexp_extract_all(hyp, '{TOKEN.replace("'", "''")}', 1) AS h FROM pairs),
t1 AS (SELECT *, list_transform(r, lambda x: {LANG % ("x", "x", "x")}) AS rl, list_transform(h, lambda x: {LANG % ("x", "x", "x")}) AS hl FROM t0),
t2 AS (SELECT *, [i for i in range(1, len(r) + 1) if rl[i] = 'zh' or rl[i] = 'en'] AS rc, [i for i in range(1, len(h) + 1) if hl[i] = 'zh' or hl[i] = 'en'] AS hc FROM t1),
t3 AS (SELECT *, [rc[j] - 1 for j in range(2, len(rc) + 1) if rl[rc[j]] <> rl[rc[j - 1]]] AS rs, [hc[j] - 1 for j in range(2, len(hc) + 1) if hl[hc[j]] <> hl[hc[j - 1]]] AS hs FROM t2),
tok AS (SELECT *, list_sort(list_distinct(flatten([[p for p in range(b - 1, b + 1) if p >= 0 and p < len(r)] for b in rs]))) AS poi,
   len(list_filter(rl, lambda x: x = 'zh')) AS zh, len(list_filter(rl, lambda x: x = 'en')) AS en FROM t3)"""
)

#: Distances over anti-diagonals; cells hold the distance and the path so far.
ALIGNED = (
    TOKENS
    + """,
dp AS (
 SELECT id, r, h, len(r) n, len(h) m, 0 kd, [CASE WHEN i = 0 THEN {'d': 0, 'p': ''} ELSE NULL END for i in range(0, len(r) + 1)] p1,
   [CAST(NULL AS STRUCT(d INT, p VARCHAR)) for i in range(0, len(r) + 1)] p2 FROM tok
 UNION ALL
 SELECT id, r, h, n, m, kd + 1,
  [CASE WHEN kd + 1 - i < 0 OR kd + 1 - i > m THEN NULL WHEN i = 0 THEN {'d': kd + 1, 'p': repeat('I', kd + 1)} WHEN i = kd + 1 THEN {'d': kd + 1, 'p': repeat('D', kd + 1)}
        WHEN p2[i].d + (CASE WHEN r[i] = h[kd + 1 - i] THEN 0 ELSE 1 END) <= least(p1[i].d + 1, p1[i + 1].d + 1)
          THEN {'d': p2[i].d + (CASE WHEN r[i] = h[kd + 1 - i] THEN 0 ELSE 1 END), 'p': p2[i].p || (CASE WHEN r[i] = h[kd + 1 - i] THEN 'E' ELSE 'S' END)}
        WHEN p1[i].d <= p1[i + 1].d THEN {'d': p1[i].d + 1, 'p': p1[i].p || 'D'} ELSE {'d': p1[i + 1].d + 1, 'p': p1[i + 1].p || 'I'} END for i in range(0, n + 1)], p1
 FROM dp WHERE kd < n + m),
ops AS (SELECT id, p1[n + 1].p AS ops FROM dp WHERE kd = n + m),
al AS (SELECT tok.*, ops.ops FROM tok JOIN ops USING (id)),
o0 AS (SELECT id, unnest(range(1, len(ops) + 1)) AS t, ops FROM al),
o1 AS (SELECT id, t, ops[t] AS op FROM o0),
o2 AS (SELECT *, count(*) FILTER (WHERE op <> 'I') OVER w - (op <> 'I')::INT AS ri, count(*) FILTER (WHERE op <> 'D') OVER w - (op <> 'D')::INT AS hi
       FROM o1 WINDOW w AS (PARTITION BY id ORDER BY t ROWS UNBOUNDED PRECEDING)),
oo AS (SELECT o2.*, al.r[ri + 1] AS rt, al.h[hi + 1] AS ht, al.rl[ri + 1] AS rtl, al.hl[hi + 1] AS htl,
   CASE WHEN op = 'I' THEN list_contains(al.poi, ri) OR list_contains(al.poi, ri - 1) ELSE list_contains(al.poi, ri) END AS inpoi FROM o2 JOIN al USING (id))"""
)

_PER_LANG = ", ".join(
    f"count(*) FILTER (WHERE op = 'S' AND rtl = '{x}') AS sub_{x}, count(*) FILTER (WHERE op = 'D' AND rtl = '{x}') AS del_{x}, count(*) FILTER (WHERE op = 'I' AND htl = '{x}') AS ins_{x}"
    for x in ("zh", "en", "num", "other")
)
SCORED = (
    ALIGNED
    + f""",
c0 AS (SELECT id, count(*) FILTER (WHERE op = 'E') AS hits, count(*) FILTER (WHERE op = 'S') AS subs, count(*) FILTER (WHERE op = 'D') AS dels, count(*) FILTER (WHERE op = 'I') AS ins,
   {_PER_LANG}, count(*) FILTER (WHERE op <> 'E' AND inpoi) AS poi_err, count(*) FILTER (WHERE op = 'S' AND rtl = 'en' AND htl = 'zh') AS en_sub_by_zh,
   count(*) FILTER (WHERE op IN ('S', 'D') AND rtl = 'en') AS en_lost FROM oo GROUP BY id),
sc0 AS (SELECT al.*, len(r) AS n_ref, len(h) AS n_hyp, {', '.join(f'coalesce(c0.{c}, 0) AS {c}' for c in ['hits', 'subs', 'dels', 'ins', 'poi_err', 'en_sub_by_zh', 'en_lost'] + [f'{k}_{x}' for k in ('sub', 'del', 'ins') for x in ('zh', 'en', 'num', 'other')])},
   {', '.join(f"len(list_filter({c}, lambda x: x = '{x}')) AS {n}_{x}" for c, n in (('rl', 'ref'), ('hl', 'hyp')) for x in ('zh', 'en', 'num', 'other'))},
   len(poi) AS n_poi, len(rs) AS n_switch_ref, len(hs) AS n_switch_hyp FROM al LEFT JOIN c0 USING (id)),
sc AS (SELECT *, ref_en > 0 AND hyp_en = 0 AS en_omitted, ref_zh > 0 AND hyp_zh = 0 AS zh_omitted,
   CASE WHEN n_ref > 0 THEN n_hyp / n_ref WHEN n_hyp > 0 THEN 'inf'::DOUBLE ELSE 1.0 END AS length_ratio,
   n_hyp >= 5 AND hyp_other / n_hyp > 0.30 AS foreign_script, (subs + dels + ins) / nullif(n_ref, 0) AS mer,
   CASE WHEN ref_zh + ref_en > 0 THEN least(ref_zh, ref_en) / (ref_zh + ref_en) ELSE 0.0 END AS cmi_ref FROM sc0)"""
)

SPANS = (
    ALIGNED
    + """,
e0 AS (SELECT *, t - row_number() OVER (PARTITION BY id ORDER BY t) AS isl FROM oo WHERE op <> 'E'),
e1 AS (SELECT *, lag(rtl) OVER (PARTITION BY id, isl, op = 'I' ORDER BY t) AS prl, lag(htl) OVER (PARTITION BY id, isl, op = 'D' ORDER BY t) AS phl,
   row_number() OVER (PARTITION BY id, isl ORDER BY t) AS nth FROM e0),
sp AS (SELECT id, isl, min(t) AS t0,
   string_agg(CASE WHEN prl IS NULL OR (prl = 'zh' AND rtl = 'zh') THEN '' ELSE ' ' END || rt, '' ORDER BY t) FILTER (WHERE op <> 'I') AS ref,
   string_agg(CASE WHEN phl IS NULL OR (phl = 'zh' AND htl = 'zh') THEN '' ELSE ' ' END || ht, '' ORDER BY t) FILTER (WHERE op <> 'D') AS hyp,
   CASE count(DISTINCT rtl) FILTER (WHERE op <> 'I') WHEN 0 THEN NULL WHEN 1 THEN any_value(rtl) FILTER (WHERE op <> 'I') ELSE 'mixed' END AS ref_lang,
   CASE count(DISTINCT htl) FILTER (WHERE op <> 'D') WHEN 0 THEN NULL WHEN 1 THEN any_value(htl) FILTER (WHERE op <> 'D') ELSE 'mixed' END AS hyp_lang,
   bool_or(CASE WHEN op <> 'I' THEN list_contains(poi, ri) WHEN nth = 1 THEN list_contains(poi, ri) ELSE false END) AS is_poi
   FROM e1 JOIN (SELECT id, poi FROM al) USING (id) GROUP BY id, isl),
spn AS (SELECT id, t0, coalesce(ref, '') AS ref, coalesce(hyp, '') AS hyp, coalesce(ref_lang, '-') AS ref_lang, coalesce(hyp_lang, '-') AS hyp_lang, is_poi,
   CASE WHEN ref IS NOT NULL AND hyp IS NOT NULL THEN 'sub' WHEN ref IS NOT NULL THEN 'del' ELSE 'ins' END AS kind FROM sp)"""
)
