"""The corpus queries as DuckDB SQL. Language ID and BPE have none: they are tested against held-out labels and the tiktoken library."""

from __future__ import annotations

from .quality_rules import LEAST_LEFT, MIN_DOCUMENTS, OWN, SHARE
from .url_filters import RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RULES = ", ".join(f"('{action}', '{rule}')" for action, rule in RULES)

OP2 = rf"""
WITH RECURSIVE rules(action, rule) AS (VALUES {_RULES}),
told AS (SELECT action, rule, split_part(rule, '/', 1) AS h, substr(rule, length(split_part(rule, '/', 1)) + 1) AS p FROM rules),
pages0 AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM pages0),
own AS (SELECT page_id, arg_max(rule, k) AS rule, arg_max(action, k) AS action FROM (
          SELECT page_id, rule, action, (length(rule), length(h), (action = 'allow')::INT, rule) AS k
          FROM parts JOIN told ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)) GROUP BY page_id),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag
         FROM pages WHERE regexp_matches(html, '(?i)<link[^>]+canonical|<meta[^>]+refresh')),
links AS (SELECT url, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?\s*canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1)
                           WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1) END AS target FROM tags),
sides AS (SELECT url AS u, replace(target, '&amp;', '&') AS v FROM links WHERE target <> ''),
edges AS (SELECT u, v FROM sides UNION SELECT v, u FROM sides),
reach(u, v) AS (SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u),
seen AS (SELECT u, lower(regexp_extract(v, '://([^/?#]*)', 1)) AS host, regexp_extract(v, '://[^/?#]*([^?#]*)', 1) AS path, v FROM reach),
acts AS (SELECT u, v, arg_max(action, (length(rule), length(h))) AS action FROM seen JOIN told ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY u, v),
handed AS (SELECT u FROM acts GROUP BY u HAVING bool_or(action = 'block') AND NOT bool_or(action = 'allow'))
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN url IN (SELECT u FROM handed) THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN own USING (page_id)
"""

OP3 = rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
wins AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY win ORDER BY doc_id, s) AS rn FROM wins) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM later),
ws AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM ws ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS host, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM again) GROUP BY doc_id),
lines AS (SELECT doc_id, host, line FROM (SELECT doc_id, host, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
base AS (SELECT d.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
         FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
norm AS (SELECT doc_id, host, lower(array_to_string(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), ' ')) AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM lines),
own AS (SELECT DISTINCT doc_id, host, line, words FROM norm),
lim AS (SELECT host, greatest({MIN_DOCUMENTS}::DOUBLE, count(*) * {SHARE}::DOUBLE) AS most FROM d GROUP BY host),
maybe AS (SELECT host, line, most FROM (SELECT host, line, count(*) AS n FROM own GROUP BY ALL) JOIN lim USING (host) WHERE n > most),
sets AS (SELECT doc_id, host, list_sort(list(line)) AS ls, sum(words) AS total FROM own GROUP BY ALL),
held AS (SELECT doc_id, list_sort(list(line)) AS found, sum(words) AS shared FROM own SEMI JOIN maybe USING (host, line) GROUP BY doc_id),
names AS (SELECT doc_id, CASE WHEN total - shared <= total * {OWN}::DOUBLE THEN {{'near': true, 'ls': found}} ELSE {{'near': false, 'ls': ls}} END AS name FROM held JOIN sets USING (doc_id)),
freq AS (SELECT host, line FROM own JOIN names USING (doc_id) JOIN maybe USING (host, line) GROUP BY host, line HAVING count(DISTINCT name) > any_value(most)),
gone AS (SELECT doc_id, sum(words)::BIGINT AS gone FROM norm SEMI JOIN freq USING (host, line) GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (n_words - coalesce(gone, 0) < {LEAST_LEFT}::DOUBLE * n_words) AS kept, coalesce(gone, 0)::BIGINT AS n_removed_words
FROM base LEFT JOIN gone USING (doc_id)
"""

_SIZE = f"len({_WORDS})"

OP6 = rf"""
WITH d AS (SELECT doc_id, source, {_SIZE}::BIGINT AS size, 1.0::DOUBLE / (1.0::DOUBLE + 10.0::DOUBLE * len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) / greatest({_SIZE}, 1)) AS quality,
           (('0x' || substr(md5(doc_id::VARCHAR), 1, 12))::UBIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u FROM documents),
k AS (SELECT *, -ln(u) / quality AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS weight FROM d GROUP BY source),
l AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS level FROM s),
sh AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS shared FROM l),
g AS (SELECT source, source_size, least(cap, weight * first_value(shared) OVER (ORDER BY (shared > level)::INT, level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS target FROM sh),
p AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
        coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source),
r AS (SELECT *, target - epochs * source_size AS rest FROM p)
SELECT doc_id, size, source_size, target,
  (size * least(3, epochs + CASE WHEN rest > 0 AND (start + size <= rest OR (start < rest AND 2 * (rest - start) >= size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP7 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(replace(replace(replace(text, '\', '\0'), '<', '\1'), '>', '\2')) + length(replace(replace(replace(replace(role, '\', '\0'), '<', '\1'), '>', '\2'), chr(10), '\3')) + 17)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP8 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]] ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM w),
n AS (SELECT doc_id, s, len(s)::BIGINT AS n FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS item FROM n),
pairs AS (SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, any_value(a.n + b.n) AS total, count(*) AS n_both FROM items a JOIN items b ON a.item = b.item AND a.doc_id < b.doc_id
  AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id) WHERE 100 * n_both >= 80 * (total - n_both)),
edges AS (SELECT u, v FROM pairs UNION SELECT v, u FROM pairs),
reach(u, v) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u)
SELECT doc_id, n AS n_shingles, c AS component_id, c = doc_id AS kept FROM n JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) ON u = doc_id
"""

OP9 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
k AS (SELECT doc_id, t, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM k
"""

OP10 = r"""
WITH c AS (SELECT page_id, html, md5(html) AS tag, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^#]*)', 1) AS rest FROM pages),
q AS (SELECT *, regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.|:(?:80|443)$', '', 'g') AS host, regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid)='))) AS ps FROM c),
u AS (SELECT *, host || path || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS curl, 'day ' || (page_id // 24)::VARCHAR AS day FROM q),
resp AS (SELECT curl, page_id, page_id * 3600 AS t, '"' || tag || '"' AS etag, day, octet_length(encode(html)) AS size FROM u WHERE page_id % 5 <> 0),
rev AS (SELECT curl, page_id, page_id * 3600 + 43200 AS t, CASE page_id % 4 WHEN 0 THEN '"' || tag || '"' WHEN 1 THEN 'W/"' || tag || '"' WHEN 2 THEN '"old"' END AS etag, CASE WHEN page_id % 4 = 3 THEN day END AS day FROM u),
j AS (SELECT rev.page_id, rev.curl, rev.etag AS e, rev.day AS d, resp.page_id AS rid, resp.etag AS re, resp.day AS rd, resp.size FROM rev ASOF LEFT JOIN resp ON rev.curl = resp.curl AND rev.t >= resp.t),
o AS (SELECT *, CASE WHEN rid IS NULL THEN 'unresolved' WHEN e IS NOT NULL THEN CASE WHEN replace(e, 'W/', '') = re THEN 'resolved' ELSE 'mismatch' END WHEN d = rd THEN 'resolved' ELSE 'mismatch' END AS result FROM j)
SELECT page_id, curl AS canonical_url, CASE WHEN result = 'resolved' THEN rid END AS response_page_id, result,
  CASE WHEN result = 'resolved' THEN 'cache-control=max-age=600;content-length=' || size || ';content-type=text/html;etag=' || coalesce(e, re) || ';last-modified=' || coalesce(d, rd) END AS headers
FROM o
"""

ORACLES = {
    "op2_url_filters": OP2, "op3_substring_dedup": OP3, "op5_quality_rules": OP5, "op6_mixing": OP6, "op7_chat_formatting": OP7,
    "op8_minhash_near_dedup": OP8, "op9_exact_dedup": OP9, "op10_warc_revisits": OP10,
}
