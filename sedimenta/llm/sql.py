"""SQL (DuckDB) that gives the same rows as the queries which SQL can express."""

from __future__ import annotations

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACED = r"[^\x20\x09-\x0D]+"

OP3 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents),
 b AS (SELECT item_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
 bw AS (SELECT item_id, least(8, len(w)) AS k, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS s, w FROM b WHERE len(w) > 0),
 win AS (SELECT DISTINCT item_id, k, array_to_string(w[s : s + k - 1], ' ') AS win FROM bw),
 dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS s, w FROM d, (SELECT DISTINCT k FROM win)),
 hits AS (SELECT DISTINCT doc_id, s, dw.k, item_id FROM dw JOIN win ON dw.k = win.k AND array_to_string(dw.w[dw.s : dw.s + dw.k - 1], ' ') = win.win),
 spots AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hits) GROUP BY doc_id),
 own AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(spots.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items, sha256(coalesce(own.ids, '')) AS items_sha256,
 coalesce(own.n, 0) >= 2 AS contaminated FROM d LEFT JOIN spots ON d.doc_id = spots.doc_id LEFT JOIN own ON d.doc_id = own.doc_id"""

OP9 = """WITH t AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
 final AS (SELECT pair_id, turn AS last_turn, text AS reply FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC NULLS LAST) AS r FROM t
  WHERE role = 'assistant' AND turn IS NOT NULL) WHERE r = 1),
 upto AS (SELECT t.*, last_turn FROM t JOIN final USING (pair_id) WHERE turn < last_turn OR turn IS NULL OR (turn = last_turn AND role = 'assistant')),
 other AS (SELECT pair_id - 1 AS pair_id, reply FROM final),
 swapped AS (SELECT u.pair_id, u.turn, u.role, CASE WHEN u.turn = u.last_turn AND u.role = 'assistant' THEN o.reply ELSE u.text END AS text FROM upto u JOIN other o USING (pair_id)),
 a AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM upto),
 b AS (SELECT pair_id, role, text, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos FROM swapped),
 two AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.pos, b.pos) AS pos, a.role AS ra, a.text AS ta, b.role AS rb, b.text AS tb,
  a.pair_id IS NOT NULL AS ia, b.pair_id IS NOT NULL AS ib FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.pos = b.pos),
 marked AS (SELECT *, min(CASE WHEN ia AND ib AND ra IS NOT DISTINCT FROM rb AND ta IS NOT DISTINCT FROM tb THEN 1 ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY pos) = 1 AS common FROM two),
 parts AS (SELECT pair_id, pos, 'prompt' AS part, ra AS role, ta AS text FROM marked WHERE common
  UNION ALL SELECT pair_id, pos, 'chosen', ra, ta FROM marked WHERE NOT common AND ia
  UNION ALL SELECT pair_id, pos, 'rejected', rb, tb FROM marked WHERE NOT common AND ib),
 seg AS (SELECT *, '<|turn|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS segment FROM parts)
SELECT pair_id, part, pos, role, segment, part <> 'prompt' AND role IS NOT DISTINCT FROM 'assistant' AS trained,
 CAST(coalesce(sum(length(segment)) OVER (PARTITION BY pair_id, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "start" FROM seg"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_SPACED}') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
 two AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
 reach AS (SELECT doc_id AS id, doc_id AS r FROM d UNION SELECT reach.id, two.v FROM reach JOIN two ON reach.r = two.u),
 c AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.id = d.doc_id"""

ORACLE_SQL = {"op3_winnowing_decontamination": OP3, "op9_preference_segments": OP9, "op10_superminhash": OP10}
