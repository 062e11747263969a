"""DuckDB SQL for the queries that SQL can express."""

# Each turn is one event, and all links run from a turn to the one before it.
OP1_SQL = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role, text, max(role = 'system') OVER (PARTITION BY conv_id) AS reverse,
    len(string_split(text, chr(10))) AS lines,
    CASE WHEN turn > 0 THEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS words,
    lag(role) OVER w AS before, lag(role, 2) OVER w AS before2, lead(role) OVER w AS after
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), events AS (
  SELECT *, CASE WHEN reverse THEN -turn ELSE turn END AS position,
    CASE WHEN role = 'user' THEN 'call' ELSE 'result' END AS kind,
    'call-' || CASE WHEN role = 'user' THEN turn ELSE turn - 1 END AS call_id,
    CASE WHEN role = 'user' THEN CASE WHEN lines > 1 THEN 'summarise' ELSE 'search' END END AS name,
    CASE WHEN role = 'user' THEN CASE WHEN after = 'assistant' THEN 'linked' ELSE 'unanswered' END
         ELSE CASE WHEN before = 'user' THEN 'linked' ELSE 'orphan' END END AS status,
    CASE WHEN role = 'user' THEN coalesce(before = 'assistant' AND before2 = 'user', false)
         ELSE coalesce(before = 'user', false) END AS needs
  FROM turns WHERE role IN ('user', 'assistant')
), layers AS (
  SELECT conv_id, turn, 0 AS layer FROM events WHERE NOT needs
  UNION ALL
  SELECT e.conv_id, e.turn, l.layer + 1 FROM layers l JOIN events e ON e.conv_id = l.conv_id AND e.turn = l.turn + 1 AND e.needs
), given AS (
  SELECT e.*, CASE WHEN reverse THEN l.layer ELSE 0 END AS layer,
    CASE WHEN kind = 'result' THEN NULL
      WHEN name = 'search' AND words IS NULL THEN json_object('query', text)
      WHEN name = 'search' THEN json_object('limit', words, 'query', text)
      WHEN words IS NULL THEN json_object('lines', CAST(lines AS VARCHAR), 'query', text)
      ELSE json_object('limit', words, 'lines', CAST(lines AS VARCHAR), 'query', text) END AS arguments
  FROM events e JOIN layers l USING (conv_id, turn)
)
SELECT conv_id, position, kind, call_id, name,
  row_number() OVER (PARTITION BY conv_id ORDER BY layer, position, kind, call_id, text) AS ordinal, status,
  CASE WHEN kind = 'result' THEN NULL WHEN name = 'summarise' THEN 'type:lines' WHEN words IS NULL THEN 'missing:limit' ELSE '' END AS problems,
  CASE WHEN kind = 'call' THEN CAST(json_object('arguments', arguments, 'id', call_id, 'kind', kind, 'name', name, 'status', status) AS VARCHAR)
    ELSE CAST(json_object('content', text, 'id', call_id, 'kind', kind, 'status', status) AS VARCHAR) END AS json
FROM given
"""

# Outcomes by host, shrunk to domain, suffix and all in turn; "k" is the strength of the prior of a level.
OP5_SQL = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), judged AS (
  SELECT *, CASE
    WHEN concat('.', host) LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
    WHEN concat('.', host) LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
    WHEN concat('.', host) LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
    WHEN concat('.', host) LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
    WHEN concat('.', host) LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule
  FROM parts
), ruled AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS spoken FROM judged
), hosts AS (
  SELECT host, CAST(count(rule) AS DOUBLE) AS n, CAST(sum(CASE WHEN spoken = 'allow' THEN 1 ELSE 0 END) AS DOUBLE) AS good,
    CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain
  FROM ruled GROUP BY host
), named AS (
  SELECT *, CASE WHEN regexp_matches(domain, '^[0-9.]*$') THEN '' ELSE regexp_extract(domain, '^[^.]*\.(.*)$', 1) END AS suffix FROM hosts
), suffix_counts AS (
  SELECT suffix, sum(n) AS n, sum(good) AS good, (SELECT (sum(good) + 1) / (sum(n) + 2) FROM named) AS parent FROM named GROUP BY suffix
), suffix_k AS (
  SELECT CASE WHEN rho IS NULL OR rho <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, 1 / rho - 1)) END AS k FROM (
    SELECT sum(n * ((good / n - parent) * (good / n - parent) / (parent * (1 - parent)) - 1 / n)) / nullif(sum(n - 1), 0) AS rho
    FROM suffix_counts WHERE n > 0)
), suffixes AS (
  SELECT s.*, k, (good + k * parent) / (n + k) AS mean FROM suffix_counts s, suffix_k
), domain_counts AS (
  SELECT domain, d.suffix, sum(d.n) AS n, sum(d.good) AS good, any_value(s.mean) AS parent
  FROM named d JOIN suffixes s USING (suffix) GROUP BY domain, d.suffix
), domain_k AS (
  SELECT CASE WHEN rho IS NULL OR rho <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, 1 / rho - 1)) END AS k FROM (
    SELECT sum(n * ((good / n - parent) * (good / n - parent) / (parent * (1 - parent)) - 1 / n)) / nullif(sum(n - 1), 0) AS rho
    FROM domain_counts WHERE n > 0)
), domains AS (
  SELECT s.*, k, (good + k * parent) / (n + k) AS mean FROM domain_counts s, domain_k
), host_counts AS (
  SELECT h.host, h.n, h.good, d.mean AS parent FROM named h JOIN domains d USING (domain)
), host_k AS (
  SELECT CASE WHEN rho IS NULL OR rho <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, 1 / rho - 1)) END AS k FROM (
    SELECT sum(n * ((good / n - parent) * (good / n - parent) / (parent * (1 - parent)) - 1 / n)) / nullif(sum(n - 1), 0) AS rho
    FROM host_counts WHERE n > 0)
), known AS (
  SELECT s.*, k, (good + k * parent) / (n + k) AS mean FROM host_counts s, host_k
)
SELECT page_id, host, path, rule,
  coalesce(spoken, CASE WHEN mean + 1.645 * sqrt(mean * (1 - mean) / (n + k + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN known USING (host)
"""

# CRC-32 of the decimal digits of a column, bit by bit.
CRC32 = """xor(list_reduce(list_transform(range(1, len(CAST({c} AS VARCHAR)) + 1), lambda i: CAST(ord(CAST({c} AS VARCHAR)[i]) AS BIGINT)),
      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)), xor(c, b)), 4294967295), 4294967295)"""

# Turns are digested by role and text; a prefix is the list of its digests.
OP11_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') AS said
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list({'t': sha256(said), 'b': strlen(text)} ORDER BY turn NULLS FIRST, sha256(said)) AS turns FROM given GROUP BY conv_id
), heads AS (
  SELECT conv_id, turns, {CRC} % 9 AS h, conv_id - conv_id % 5 AS base FROM own
), rebuilt AS (
  SELECT c.conv_id, coalesce(b.turns[:c.h], []) || c.turns[c.h + 1:] AS turns FROM heads c LEFT JOIN own b ON b.conv_id = c.base
), prefixes AS (
  SELECT conv_id, d, d = len(turns) AS ended, sha256(array_to_string(list_transform(turns[:d], lambda x: x.t), '')) AS k,
    sha256(array_to_string(list_transform(turns[:d - 1], lambda x: x.t), '')) AS p, CASE WHEN d > 0 THEN turns[d].b ELSE 0 END AS bytes
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, any_value(p) AS p, count(*) AS n_convs, any_value(bytes) AS bytes,
    coalesce(string_agg(CASE WHEN ended THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '') AS ends
  FROM prefixes GROUP BY d, k
), children AS (
  SELECT d - 1 AS d, p AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY d, p
), below AS (
  SELECT DISTINCT a.d, a.k, b.d AS bd, b.k AS bk FROM prefixes a JOIN prefixes b ON a.conv_id = b.conv_id AND b.d >= a.d
), sums AS (
  SELECT b.d, b.k, sum((n.n_convs - 1) * n.bytes) AS saved, count(*) FILTER (c.k IS NULL) AS n_leaves
  FROM below b JOIN nodes n ON n.d = b.bd AND n.k = b.bk LEFT JOIN children c ON c.d = b.bd AND c.k = b.bk GROUP BY b.d, b.k
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s USING (d, k) LEFT JOIN children c USING (d, k) LEFT JOIN nodes u ON u.d = n.d - 1 AND u.k = n.p
""".replace("{CRC}", CRC32.format(c="conv_id"))

OP12_SQL = r"""
WITH lines AS (
  SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), hot AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) >= 3
), marked AS (
  SELECT keyed.*, hot.k IS NOT NULL AND keyed.doc_id IS DISTINCT FROM hot.last AS dropped FROM keyed LEFT JOIN hot USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN NOT dropped THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY r
"""

# Levels are built upwards by grouping; each leaf then climbs from parent to parent.
OP13_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, *,
    CASE WHEN {CRC} % 5 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS claimed_text
  FROM documents
), heads AS (
  SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM docs
), hashed AS (
  SELECT r, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(claimed_text) || ':' || claimed_text, '-')) AS claimed
  FROM heads
), leaves AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), built(tree, level, idx, n, digest, kids) AS (
  SELECT tree, 0, idx, n, leaf, CAST([] AS VARCHAR[]) FROM leaves
  UNION ALL
  SELECT tree, level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)), list(digest ORDER BY idx)
  FROM built WHERE n > 1 GROUP BY tree, level, n, idx // 16
), above(level, idx, n, digest, kids) AS (
  SELECT 0, tree, (SELECT max(tree) + 1 FROM leaves), digest, CAST([] AS VARCHAR[]) FROM built WHERE n = 1
  UNION ALL
  SELECT level + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)), list(digest ORDER BY idx)
  FROM above WHERE n > 1 GROUP BY level, n, idx // 16
), parents AS (
  SELECT tree, level, idx, kids FROM built WHERE level > 0
  UNION ALL SELECT -1, level, idx, kids FROM above WHERE level > 0
), climb(r, home, tree, level, idx, n, fold, siblings) AS (
  SELECT r, tree, tree, 0, idx, n, claimed, '' FROM leaves
  UNION ALL
  SELECT c.r, c.home, p.tree, p.level, p.idx, CASE WHEN p.tree = c.tree THEN (c.n + 15) // 16 ELSE ((SELECT max(tree) + 1 FROM leaves) + 15) // 16 END,
    sha256(array_to_string(p.kids[:c.at] || [c.fold] || p.kids[c.at + 2:], '')),
    c.siblings || array_to_string(p.kids[:c.at] || p.kids[c.at + 2:], '')
  FROM (SELECT *, CASE WHEN n > 1 THEN tree ELSE -1 END AS up_tree, CASE WHEN n > 1 OR tree = -1 THEN level + 1 ELSE 1 END AS up_level,
      CASE WHEN n > 1 THEN idx ELSE tree END // 16 AS up_idx, CASE WHEN n > 1 THEN idx ELSE tree END % 16 AS at
    FROM climb WHERE n > 1 OR tree >= 0) c
  JOIN parents p ON p.tree = c.up_tree AND p.level = c.up_level AND p.idx = c.up_idx
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, root.digest AS root, sha256(c.siblings) AS proof_sha256, c.fold AS folded_root,
  c.fold = root.digest AS verified
FROM (SELECT r, arg_max(fold, CASE WHEN tree = -1 THEN 1000 ELSE 0 END + level) AS fold,
  arg_max(siblings, CASE WHEN tree = -1 THEN 1000 ELSE 0 END + level) AS siblings FROM climb GROUP BY r) c
JOIN leaves l USING (r) JOIN built s ON s.tree = l.tree AND s.n = 1 CROSS JOIN (SELECT digest FROM above WHERE n = 1) AS root
""".replace("{CRC}", CRC32.format(c="doc_id"))
