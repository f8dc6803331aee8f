"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH sized AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|42'), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS total FROM sized GROUP BY source),
weighted AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM totals),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY total / weight, source NULLS LAST) AS k,
    sum(total) OVER ()::BIGINT AS everything, sum(weight) OVER () AS all_weight
  FROM weighted),
levels AS (
  SELECT *, coalesce(sum(total) OVER w, 0)::BIGINT AS clamped, all_weight - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM ordered WINDOW w AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((everything - clamped * 3.0::DOUBLE) / open_weight, k) AS l FROM levels
  WHERE (everything - clamped * 3.0::DOUBLE) / open_weight * weight <= 3.0::DOUBLE * total),
targets AS (
  SELECT source, total, least(weight * l, 3.0::DOUBLE * total) AS target FROM weighted, level),
plan AS (
  SELECT *, CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END::BIGINT AS whole,
    target - (CASE WHEN total > 0 THEN floor(target / total) ELSE 0 END)::BIGINT * total AS rest
  FROM targets),
units AS (
  SELECT s.source, h, doc_id, s.size, sum(s.size)::BIGINT AS words
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
  WHERE s.size > 0 AND rest > 0 GROUP BY ALL),
running AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM units),
fitted AS (
  SELECT r.*, rest, upto <= rest AS fits,
    coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY r.source), 0) AS used
  FROM running r JOIN plan p ON r.source IS NOT DISTINCT FROM p.source),
extra AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY abs(rest - used - words), h, doc_id, size) AS n
  FROM fitted WHERE NOT fits AND abs(rest - used - words) < rest - used),
chosen AS (
  SELECT source, h, doc_id, size FROM fitted WHERE fits
  UNION ALL SELECT source, h, doc_id, size FROM extra WHERE n = 1)
SELECT s.doc_id, s.size, p.total AS source_size, p.target,
  (CASE WHEN s.size > 0 THEN (p.whole + (c.h IS NOT NULL)::BIGINT) * s.size ELSE 0 END)::BIGINT AS taken
FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source
LEFT JOIN chosen c ON s.source IS NOT DISTINCT FROM c.source AND s.h = c.h AND s.size = c.size
  AND s.doc_id IS NOT DISTINCT FROM c.doc_id
"""

OP8 = r"""
WITH norm AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL),
item_starts AS (
  SELECT item_id, words, least(len(words), 10) AS n, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS p
  FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[p:p + n - 1], ' ') AS w FROM item_starts),
sizes AS (SELECT DISTINCT n FROM windows),
doc_starts AS (
  SELECT doc_id, n, words, unnest(range(1, len(words) - n + 2)) AS p FROM norm, sizes WHERE len(words) >= n),
hits AS (
  SELECT d.doc_id, d.p, d.n, w.item_id FROM doc_starts d JOIN windows w
    ON d.n = w.n AND array_to_string(d.words[d.p:d.p + d.n - 1], ' ') = w.w),
covered AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT n.doc_id, coalesce(len(n.words), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM norm n LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP1_START = r"""
WITH RECURSIVE parsed AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)),
shaped AS (
  SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''),
    lambda s: regexp_replace(s, '[0-9]+', '#', 'g')) AS shape FROM parsed),
known AS (
  SELECT page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM parsed JOIN labels ON try_cast(regexp_extract(path, '([0-9]+)[^0-9]*$', 1) AS BIGINT) = doc_id GROUP BY page_id),
t0 AS MATERIALIZED (
  SELECT host, shape, shape AS template, count(*) AS n, count(bad) AS labels, coalesce(sum(bad), 0)::BIGINT AS bad
  FROM shaped LEFT JOIN known USING (page_id) GROUP BY host, shape)"""

# The levels of the tree one after the other, down for kinds and up again for branches.
_OP1_LEVELS = r""",
deep AS (SELECT max(len(shape)) AS deepest FROM t0),
levels AS (
  SELECT 0 AS step, host, shape, template, n, labels, bad FROM t0
  UNION ALL
  SELECT step + 1, host, shape, CASE WHEN len(template) > depth AND (CASE
      WHEN step < deepest THEN kinds >= 12 AND kinds > all_n * 0.1::DOUBLE
      WHEN branches = 1 THEN false
      WHEN l = 0 OR others = 0 THEN true
      WHEN spread = 0 THEN true
      ELSE gap < sqrt(spread) * 1.96::DOUBLE END) THEN shared ELSE template END, n, labels, bad
  FROM (
    SELECT *, all_l - l AS others, (all_b / all_l) * (1 - all_b / all_l) * (1 / l + 1 / (all_l - l)) AS spread,
      abs(b / l - (all_b - b) / (all_l - l)) AS gap
    FROM (
      SELECT *, count(DISTINCT template[depth + 1]) OVER node AS kinds, (sum(n) OVER node)::BIGINT AS all_n,
        count(DISTINCT template) OVER sibling AS branches, (sum(labels) OVER sibling)::BIGINT AS all_l,
        (sum(bad) OVER sibling)::BIGINT AS all_b, (sum(labels) OVER own)::BIGINT AS l, (sum(bad) OVER own)::BIGINT AS b
      FROM (
        SELECT *, list_concat(list_append(template[1:depth], '*'), template[depth + 2:]) AS shared
        FROM (SELECT *, CASE WHEN step < deepest THEN step ELSE 2 * deepest - 1 - step END AS depth
          FROM levels, deep WHERE step < 2 * deepest))
      WINDOW node AS (PARTITION BY host, len(template) > depth, template[1:depth]),
        sibling AS (PARTITION BY host, len(template) > depth, shared), own AS (PARTITION BY host, template)))),
last_level AS MATERIALIZED (SELECT host, shape, template, n, labels, bad FROM levels, deep WHERE step = 2 * deepest)"""

_OP1_END = r""",
every AS (SELECT (sum(bad) + 1) / (sum(labels) + 2) AS share FROM last_level),
hosts AS (SELECT host, sum(labels) AS l, sum(bad) AS b FROM last_level GROUP BY host),
rated AS (
  SELECT f.host, f.template, (f.b + (h.b + share * 5.0::DOUBLE) / (h.l + 5.0::DOUBLE) * 5.0::DOUBLE) / (f.l + 5.0::DOUBLE) AS bad_share
  FROM (SELECT host, template, sum(labels) AS l, sum(bad) AS b FROM last_level GROUP BY host, template) f
  JOIN hosts h ON f.host = h.host, every),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fitting AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parsed), rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT page_id, s.host, s.path, f.rule,
  coalesce(f.verdict, CASE WHEN bad_share > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
  array_to_string(t.template, '/') AS template, bad_share
FROM shaped s JOIN last_level t ON s.host = t.host AND s.shape = t.shape
JOIN rated r ON t.host = r.host AND t.template = r.template
LEFT JOIN fitting f ON s.host = f.host AND s.path = f.path
"""


OP1 = _OP1_START + _OP1_LEVELS + _OP1_END


OP5 = r"""
WITH split AS (
  SELECT page_id, row_number() OVER () AS r,
    translate(regexp_extract(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '^[^/?#]*', 0),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    string_split(coalesce(regexp_replace(html,
      '(</(?:p|div|li|ul|nav|article|head|title|style|script|h[1-6])>|<br>)', '\1' || chr(10), 'g'), ''), chr(10)) AS lines
  FROM pages),
placed AS (
  SELECT r, host, i, lines[i] AS line, trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS plain
  FROM (SELECT r, host, lines, unnest(range(1, len(lines) + 1)) AS i FROM split)),
totals AS (SELECT host, count(*) AS pages FROM split GROUP BY host),
counts AS (SELECT host, plain, count(DISTINCT r) AS n FROM placed WHERE plain <> '' GROUP BY host, plain),
frequent AS (
  SELECT c.host, c.plain FROM counts c JOIN totals t ON c.host IS NOT DISTINCT FROM t.host WHERE n > pages * 0.1::DOUBLE),
kept AS (
  SELECT r, count(*) AS n, count(*) FILTER (f.plain IS NOT NULL) AS dropped,
    string_agg(line, chr(10) ORDER BY i) FILTER (f.plain IS NULL) AS text
  FROM placed p LEFT JOIN frequent f ON p.host IS NOT DISTINCT FROM f.host AND p.plain = f.plain GROUP BY r)
SELECT page_id, host, n::BIGINT AS n_lines, dropped::BIGINT AS n_dropped, coalesce(text, '') AS text
FROM split JOIN kept USING (r)
"""

OP9 = r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [text] ELSE list_sort(list_distinct(list_transform(
      range(1, greatest(len(w) - 5, 0) + 2), lambda p: array_to_string(w[p:p + 4], ' ')))) END AS shingles, len(w) > 0 AS filled
  FROM words),
classes AS MATERIALIZED (
  SELECT filled, shingles, min(doc_id) AS class_id, count(*) AS n_docs, min(r) AS node FROM sets GROUP BY filled, shingles),
spread AS MATERIALIZED (SELECT node, len(shingles) AS size, unnest(shingles) AS s FROM classes WHERE filled),
pairs AS MATERIALIZED (
  SELECT a.node AS a, b.node AS b FROM spread a JOIN spread b ON a.s = b.s AND a.node <> b.node
  GROUP BY a.node, b.node, a.size, b.size HAVING count(*) >= 0.8 * (a.size + b.size - count(*)) - 1e-9),
reach(node, top) AS (
  SELECT node, node FROM classes UNION SELECT p.b, reach.top FROM reach JOIN pairs p ON p.a = reach.node),
groups AS (
  SELECT node, min(c.class_id) AS group_id FROM reach JOIN (SELECT node AS n, class_id FROM classes) c ON c.n = top GROUP BY node),
links AS (SELECT a AS node, sum(n_docs) AS n FROM pairs JOIN (SELECT node AS n, n_docs FROM classes) c ON c.n = b GROUP BY a)
SELECT s.doc_id, c.class_id, g.group_id, (c.n_docs - 1 + coalesce(l.n, 0))::BIGINT AS n_links
FROM sets s JOIN classes c ON s.filled = c.filled AND s.shingles = c.shingles
JOIN groups g ON g.node = c.node LEFT JOIN links l ON l.node = c.node
"""

# DuckDB has no CRC-32: its table of 256 follows from the polynomial, 0xEDB88320.
OP11 = r"""
WITH RECURSIVE polynomial AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
rows_ AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
      lambda c, d: xor(c // 256, t[xor(c % 256, d) + 1])), 4294967295) % 7 = 0 AS changed
  FROM documents, polynomial),
fields AS (
  SELECT doc_id, lang,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') AS before,
    n_chars::HUGEINT AS n, n_chars::HUGEINT + (coalesce(changed, false))::INT AS m,
    coalesce(strlen(text) || ':' || text, '-') AS after
  FROM rows_),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n_leaves
  FROM (SELECT doc_id, lang, sha256(before || coalesce(strlen(n::VARCHAR) || ':' || n, '-') || after) AS leaf,
      sha256(before || coalesce(strlen(m::VARCHAR) || ':' || m, '-') || after) AS claimed FROM fields)),
nodes(level, lang, pos, digest, n) AS (
  SELECT 0, lang, pos, leaf, n_leaves FROM leaves
  UNION ALL
  SELECT level + 1, lang, pos // 2, string_agg(digest, '' ORDER BY pos).sha256(), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY level, lang, pos // 2, n),
subroots AS MATERIALIZED (
  SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, pos, digest, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, string_agg(digest, '' ORDER BY pos).sha256(), (n + 1) // 2
  FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
every AS MATERIALIZED (
  SELECT n.lang, true AS inner_, level, n.pos, digest, n.n FROM nodes n
  UNION ALL SELECT NULL, false, level, pos, digest, n FROM tops),
walk(r, lang, inner_, level, pos, digest, path) AS (
  SELECT r, lang, true, 0, pos, claimed, '' FROM leaves
  UNION ALL
  SELECT w.r, w.lang, CASE WHEN e.n > 1 THEN w.inner_ ELSE false END, CASE WHEN e.n > 1 THEN w.level + 1 ELSE 0 END,
    CASE WHEN e.n > 1 THEN w.pos // 2 ELSE s.pos END,
    CASE WHEN e.n = 1 THEN w.digest WHEN w.pos % 2 = 1 THEN sha256(b.digest || w.digest) ELSE sha256(w.digest || coalesce(b.digest, '')) END,
    CASE WHEN e.n = 1 THEN w.path ELSE w.path || coalesce(b.digest, '') END
  FROM walk w
  JOIN every e ON e.inner_ = w.inner_ AND (NOT w.inner_ OR e.lang IS NOT DISTINCT FROM w.lang) AND e.level = w.level AND e.pos = w.pos
  JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang
  LEFT JOIN every b ON b.inner_ = w.inner_ AND (NOT w.inner_ OR b.lang IS NOT DISTINCT FROM w.lang) AND b.level = w.level
    AND b.pos = w.pos + 1 - 2 * (w.pos % 2)
  WHERE w.inner_ OR e.n > 1),
ends AS (SELECT r, digest AS folded_root, path FROM walk w, (SELECT max(level) AS last FROM tops) WHERE NOT w.inner_ AND level = last)
SELECT doc_id, leaf, subroot, root, sha256(path) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves l JOIN ends USING (r)
JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang, (SELECT digest AS root FROM tops WHERE n = 1)
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM documents),
counts AS MATERIALIZED (
  SELECT lang, w[p:p + k - 1] AS g, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k))
  GROUP BY ALL HAVING count(*) >= 30),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
candidates AS MATERIALIZED (SELECT * FROM counts WHERE len(g) > 1),
inside AS (
  SELECT lang, g[p:p + k - 1] AS g, max(a) AS longer
  FROM (SELECT *, unnest(range(1, len(g) - k + 2)) AS p FROM candidates, (SELECT unnest([2, 3]) AS k) WHERE len(g) > k) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.g, c.a, k, f.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (f.a::HUGEINT + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM candidates) c
  JOIN counts f ON f.lang = c.lang AND f.g = c.g[1:k] JOIN counts r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM (SELECT o.lang, array_to_string(o.g, ' ') AS phrase, o.a, l, r, score FROM lowest o
  LEFT JOIN inside i ON o.lang = i.lang AND o.g = i.g WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * o.a)
JOIN totals USING (lang) QUALIFY rank <= 2000
"""

SQL = {"op1_url_templates": OP1, "op2_mix_sources": OP2, "op5_site_lines": OP5, "op8_decontaminate": OP8, "op9_near_duplicates": OP9, "op11_merkle_manifest": OP11, "op13_collocations": OP13}
