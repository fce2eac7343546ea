"""DuckDB SQL for the corpus queries that SQL can express, written from the contracts alone."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UP}', '{_LOW}'), '{pattern}')"


SUFFIX_DEDUP = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n
           FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g FROM b, unnest(range(0, greatest(n - 49, 0))) AS t(p)),
f AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g),
r AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -100) + 50 AS fresh
      FROM w JOIN f USING (g) WHERE low < doc_id),
i AS (SELECT doc_id, p, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM r),
s AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, k),
kept AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM s
         UNION ALL SELECT b.doc_id, coalesce(max(z), 0), any_value(b.n) FROM b LEFT JOIN s USING (doc_id) GROUP BY b.doc_id),
text AS (SELECT kept.doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' ORDER BY x) AS rest
         FROM kept JOIN b USING (doc_id) GROUP BY kept.doc_id),
total AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT b.doc_id, b.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(rest)) AS kept_sha256
FROM b JOIN text USING (doc_id) LEFT JOIN total USING (doc_id)
"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words('text', _WORD)} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_words('text', _WORD)} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g
       FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(p) WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS g
       FROM d CROSS JOIN ns, unnest(range(1, greatest(len(w) - n + 2, 1))) AS t(p)),
m AS (SELECT DISTINCT doc_id, p, n, item_id FROM dw JOIN bw USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit
        FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
       FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_BLANK_WORD = r"[^\x20\x09-\x0D]+"

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _BLANK_WORD)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS g
      FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 80 * (nx.n + ny.n - o)),
both_ways AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other),
low AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)
"""

REPAIR = """
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
c AS (SELECT *, xor(list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)),
                 lambda crc, x: list_reduce(range(8), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)), xor(crc, x)), 4294967295),
                 4294967295) % 20 AS kind FROM k),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM c, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS t(copy) WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             count(*) OVER (PARTITION BY conv_id) AS m, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS tail FROM d),
r AS (SELECT *, substr(role, 1, 1) AS y, CASE WHEN tail = '' THEN 'blank'
             WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
             WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
forced(q, f) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
fits(y, q, f) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ins AS (SELECT q, q AS e, 0 AS cost, '' AS audit FROM forced
        UNION ALL SELECT ins.q, f, cost + 2, audit || 'I' FROM ins JOIN forced ON ins.e = forced.q WHERE cost < 6),
v AS (SELECT conv_id, m + 1 AS i, q, CASE q WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost,
             CASE q WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit FROM (SELECT DISTINCT conv_id, m FROM o), forced
      UNION ALL
      SELECT conv_id, i, q, best.cost, best.audit FROM (
        SELECT r.conv_id, r.i, ins.q, min({'cost': ins.cost + e.cost + v.cost, 'audit': ins.audit || e.edit || v.audit}) AS best
        FROM v JOIN r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.i = v.i - 1
        JOIN (SELECT 'D' AS edit, '' AS y, q, q AS f, 3 AS cost FROM forced
              UNION ALL SELECT 'R', '', q, f, 2 FROM forced UNION ALL SELECT 'K', y, q, f, 0 FROM fits) AS w
          ON w.f = v.q AND (w.edit = 'D' OR r.fault NOT IN ('blank', 'duplicate') AND (w.edit = 'R' OR w.y = r.y))
        JOIN (SELECT 0 AS t, 0 AS add UNION ALL SELECT 1, 1) AS p ON p.t = CAST(r.fault = 'truncated' AND w.edit <> 'D' AS INTEGER)
        JOIN ins ON ins.e = w.q, LATERAL (SELECT w.edit AS edit, w.cost + p.add AS cost) AS e
        GROUP BY ALL)),
audit AS (SELECT conv_id, cost, audit FROM v WHERE i = 1 AND q = 0),
step AS (SELECT conv_id, 0 AS pos, 0 AS i, 0 AS q, audit, '' AS edit FROM audit
         UNION ALL SELECT step.conv_id, pos + 1, i + CAST(left(audit, 1) <> 'I' AS INTEGER),
                CASE left(audit, 1) WHEN 'D' THEN step.q WHEN 'K' THEN (SELECT f FROM fits JOIN r ON r.y = fits.y
                       WHERE r.conv_id IS NOT DISTINCT FROM step.conv_id AND r.i = step.i + 1 AND fits.q = step.q) ELSE f END,
                substr(audit, 2), left(audit, 1) FROM step JOIN forced ON forced.q = step.q WHERE audit <> ''),
fixed AS (SELECT step.conv_id, string_agg(CASE edit WHEN 'K' THEN r.role ELSE CASE step.q WHEN 2 THEN 'user' ELSE 'assistant' END END || ':'
                 || CASE edit WHEN 'I' THEN '' ELSE r.text END, chr(10) ORDER BY pos) AS lines
          FROM step LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM step.conv_id AND r.i = step.i WHERE edit IN ('K', 'R', 'I') GROUP BY step.conv_id),
sums AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (before IS NOT NULL AND before || y NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT ids.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
       coalesce(audit.audit, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS ids
LEFT JOIN audit ON audit.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ids.conv_id
"""

# for pages whose main text is one <article> of <h1> and <p>, as all given pages have it
MAIN_TEXT = """
WITH parts AS (SELECT page_id, url, list_filter(list_transform(
                   string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>'),
                   lambda x: trim(regexp_replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '[\\s]+', ' ', 'g'))),
                   lambda x: x <> '') AS blocks FROM pages),
text AS (SELECT page_id, url, replace(replace(replace(replace(replace(replace(array_to_string(blocks, chr(10)),
                '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&#x27;', chr(39)), '&amp;', '&') AS text FROM parts)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM text
"""

COLLOCATIONS = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '""" + _UP + "', '" + _LOW + """'),
                  '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size, count(*) AS f
      FROM w, unnest(range(1, len(w) + 1)) AS t(i), unnest(range(1, 6)) AS s(size) WHERE i + size - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM g WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, phrase, string_split(phrase, ' ') AS w, size, f AS a FROM g WHERE size > 1 AND f >= 100),
inner_ AS (SELECT DISTINCT q.lang, array_to_string(q.w[i:i + m - 1], ' ') AS phrase, q.a AS f
           FROM c AS q, unnest(range(1, 5)) AS t(i), unnest(range(2, 5)) AS s(m) WHERE m < q.size AND i + m - 1 <= q.size),
cuts AS (SELECT c.*, k, array_to_string(c.w[1:k], ' ') AS head, array_to_string(c.w[k + 1:], ' ') AS tail
         FROM c, unnest(range(1, 5)) AS t(k) WHERE k < size
         AND NOT EXISTS (SELECT 1 FROM inner_ WHERE inner_.lang = c.lang AND inner_.phrase = c.phrase AND inner_.f >= c.a)),
scored AS (SELECT cuts.lang, cuts.phrase, a, gl.f AS l, gr.f AS r, CAST(n AS HUGEINT) AS n, k,
                  (CAST(1000 AS HUGEINT) * a * CAST(n AS HUGEINT)) // (CAST(gl.f AS HUGEINT) * gr.f) AS score
           FROM cuts JOIN n USING (lang) JOIN g AS gl ON gl.lang = cuts.lang AND gl.phrase = cuts.head
           JOIN g AS gr ON gr.lang = cuts.lang AND gr.phrase = cuts.tail),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best QUALIFY rank <= 2000
"""
