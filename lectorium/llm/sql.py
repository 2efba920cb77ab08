"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), keyed AS (
  SELECT doc_id, source, pos, raw, trim(raw, ' ' || chr(9) || chr(13)) AS line FROM lines
), spread AS (
  SELECT line, min((doc_id, pos)) AS first FROM keyed WHERE line <> '' GROUP BY line HAVING count(DISTINCT source) >= 10
), marked AS (
  SELECT k.doc_id, k.pos, k.raw, s.first IS NOT NULL AND s.first <> (k.doc_id, k.pos) AS gone
  FROM keyed k LEFT JOIN spread s ON k.line = s.line
)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(m.text, '') END AS text,
       coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN (
  SELECT doc_id, string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
  FROM marked GROUP BY doc_id
) m ON d.doc_id = m.doc_id
"""

OP4 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), w AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""

OP8 = r"""
WITH asked AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
         nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)', 1), '.'), '') AS host
  FROM pages
), names AS (
  SELECT DISTINCT host AS name FROM asked WHERE host IS NOT NULL
), digits AS (
  SELECT name, list_transform(range(1, 7), lambda k: instr('0123456789abcdef', substr(md5(name), CAST(k AS INTEGER), 1)) - 1) AS d FROM names
), parents AS (
  SELECT DISTINCT regexp_replace(name, '^[^.]*\.', '') AS name FROM names WHERE len(string_split(name, '.')) > 2
), pdigits AS (
  SELECT name, list_transform(range(1, 7), lambda k: instr('0123456789abcdef', substr(md5(name), CAST(k AS INTEGER), 1)) - 1) AS d FROM parents
), dated AS (
  SELECT name, d, DATE '2024-01-01' + CAST(d[2] * 16 + d[3] AS INTEGER) AS day, CASE WHEN d[4] < 8 THEN 'spam' ELSE 'malware' END AS category FROM digits WHERE d[1] < 4
), entries AS (
  SELECT name AS domain, category, day AS effective_on, 'add' AS action FROM dated
  UNION ALL SELECT name, category, day + 60, 'remove' FROM dated WHERE d[5] < 8
  UNION ALL SELECT name, category, day + 90, 'add' FROM dated WHERE d[5] < 8 AND d[6] < 8
  UNION ALL SELECT name, 'parent', DATE '2024-01-01' + CAST(d[2] * 16 + d[3] AS INTEGER), 'add' FROM pdigits WHERE d[1] = 4
), spans AS (
  SELECT domain, category, action, effective_on AS valid_from,
         coalesce(lead(effective_on) OVER (PARTITION BY domain, category ORDER BY effective_on), DATE '9999-12-31') AS valid_to
  FROM entries
), labels_of AS (
  SELECT page_id, url, fetched_on, host, string_split(host, '.') AS l FROM asked WHERE host IS NOT NULL
), candidates AS (
  SELECT page_id, url, fetched_on, k - 1 AS depth, array_to_string(l[k:], '.') AS domain
  FROM (SELECT *, unnest(CASE WHEN host[1] = '[' OR regexp_matches(host, '(^|\.)[0-9]+$') THEN [1] ELSE range(1, greatest(len(l), 2)) END) AS k FROM labels_of)
), hits AS (
  SELECT c.page_id, c.url, c.fetched_on, c.depth, s.category, c.domain, s.valid_from,
         row_number() OVER (PARTITION BY c.page_id, c.url, c.fetched_on ORDER BY c.depth, s.category) AS rn
  FROM candidates c JOIN spans s ON c.domain = s.domain AND s.action = 'add' AND c.fetched_on >= s.valid_from AND c.fetched_on < s.valid_to
)
SELECT a.page_id, a.url, a.fetched_on, a.host, h.domain IS NOT NULL AS blocked, h.domain AS matched_domain, h.category, h.valid_from AS listed_on
FROM asked a LEFT JOIN hits h ON h.rn = 1 AND a.page_id = h.page_id AND a.url = h.url AND a.fetched_on = h.fetched_on
"""

OP9 = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)
), n AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT x, y FROM pairs p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id WHERE 100 * c >= 75 * (a.n + b.n - c)
), both_ways AS MATERIALIZED (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT x AS doc_id, x AS other FROM both_ways
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN both_ways l ON r.other = l.x
), comp AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN comp c ON d.doc_id = c.doc_id
"""

ORACLES = {"op1_line_dedup": OP1, "op4_exact_dedup": OP4, "op8_url_filter": OP8, "op9_near_dedup": OP9}
