"""DuckDB SQL for those registered queries that SQL can express on whole tables."""

_RULES = "(VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')) r(verdict, rhost, rpath)"

OP1 = rf"""
WITH RECURSIVE parsed AS (
  SELECT page_id, url, coalesce(html, '') AS html,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
rows AS (
  SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM parsed),
targets AS (
  SELECT host || tail AS a, host, path, tail, replace(unnest(list_concat(
    regexp_extract_all(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract_all(html, '(?i)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract_all(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*''?([^"''\s>]+)', 1))), '&amp;', '&') AS target
  FROM rows WHERE host <> ''),
resolved AS (
  SELECT a, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN substr(target, instr(target, '://') + 3) WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:|^#') THEN NULL
    WHEN starts_with(target, '//') THEN substr(target, 3) WHEN starts_with(target, '/') THEN host || target WHEN starts_with(target, '?') THEN host || path || target
    ELSE host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || target END AS rest FROM targets WHERE target <> ''),
edges AS (
  SELECT DISTINCT a, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS b
  FROM resolved WHERE rest IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
nodes AS (SELECT DISTINCT b AS node, regexp_extract(b, '^([^/?]*)', 1) AS host, regexp_extract(b, '^[^/?]*([^?]*)', 1) AS path FROM reach),
node_rule AS (
  SELECT node, arg_max(verdict, length(rhost || rpath)) AS verdict FROM nodes JOIN {_RULES}
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY node),
inherited AS (
  SELECT a AS node, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' ELSE 'allow' END AS verdict
  FROM reach LEFT JOIN node_rule ON node = b GROUP BY a),
ruled AS (
  SELECT DISTINCT url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT url, host, path FROM rows) JOIN {_RULES} ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY url)
SELECT page_id, host, path, rule, coalesce(ruled.verdict, inherited.verdict, 'allow') AS verdict
FROM rows LEFT JOIN ruled ON rows.url = ruled.url LEFT JOIN inherited ON host <> '' AND node = host || tail
"""

OP3 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
sized AS (
  SELECT *, length(text) + list_sum(list_transform(['\', '<|', '|>', '<s>', '</s>', '[INST]', '[/INST]'],
    lambda m: (length(text) - length(replace(text, m, ''))) // length(m))) AS escaped FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(17 + length(role) + escaped) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP5 = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE c.n >= 0.8 * (x.n + y.n - c.n)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT doc_id, CAST(coalesce(least(doc_id, min(b)), doc_id) AS BIGINT) AS class_id FROM documents LEFT JOIN reach ON doc_id = a GROUP BY doc_id
"""

OP8 = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 12], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS first FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, i + k AS at FROM windows JOIN firsts USING (s), range(0, 13) t(k) WHERE first < doc_id),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM words),
kept AS (
  SELECT p.doc_id, count(g.at) AS n_removed, string_agg(word, ' ' ORDER BY p.at) FILTER (g.at IS NULL) AS text
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.at = g.at GROUP BY p.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

ORACLE: dict[str, str] = {"op1_url_filter": OP1, "op3_chat_format": OP3, "op5_minhash_near_dedup": OP5, "op8_substring_dedup": OP8}
