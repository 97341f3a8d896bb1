"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from riskloom.llm import decontaminate as seeds
from riskloom.llm import secret_scan as secrets
from riskloom.llm import url_filter

_HOST = url_filter.HOST
_PATH = url_filter.PATH

URL_FILTER = rf"""
WITH parts AS (
  SELECT page_id, url, CAST(DATE '2020-01-01' + CAST((page_id * 7919) % 1461 AS INTEGER) AS DATE) AS fetched_on,
    CAST(DATE '2020-01-01' + CAST((page_id * 104729) % 1461 AS INTEGER) AS DATE) AS effective,
    rtrim(lower(regexp_extract(url, '{_HOST}', 1)), '.') AS host, regexp_extract(url, '{_PATH}', 1) AS path
  FROM pages),
split AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS steps FROM parts),
entries AS (
  SELECT CASE page_id % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'domain' ELSE 'prefix' END AS kind,
    CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN array_to_string(labels[greatest(len(labels) - 2, 1):], '.')
      ELSE host || regexp_extract(path, '^(/[^/]*/?)', 1) END AS pattern,
    'c' || ((page_id // 3) % 4) AS category, (page_id // 7) % 3 <> 0 AS adds, effective FROM split),
daily AS (SELECT kind, pattern, category, effective, bool_or(adds) AS listed FROM entries
  WHERE pattern IS NOT NULL AND effective IS NOT NULL GROUP BY ALL),
spans AS (SELECT *, lead(effective) OVER (PARTITION BY kind, pattern, category ORDER BY effective) AS until FROM daily),
probes AS (
  SELECT page_id, fetched_on, 'host' AS kind, host AS pattern FROM split
  UNION SELECT page_id, fetched_on, 'domain', unnest([array_to_string(labels[i:], '.') FOR i IN range(1, len(labels) + 1)]) FROM split
  UNION SELECT page_id, fetched_on, 'prefix', unnest([host || array_to_string(steps[1:i], '/') || CASE WHEN i < len(steps) THEN '/' ELSE '' END
    FOR i IN range(1, len(steps) + 1)]) FROM split),
met AS (SELECT page_id, count(*) AS n_entries, string_agg(DISTINCT category, ',' ORDER BY category) AS categories
  FROM probes JOIN spans USING (kind, pattern)
  WHERE listed AND effective <= fetched_on AND (until IS NULL OR fetched_on < until) GROUP BY page_id)
SELECT page_id, fetched_on, n_entries IS NOT NULL AS blocked, coalesce(n_entries, 0) AS n_entries,
  coalesce(categories, '') AS categories
FROM split LEFT JOIN met USING (page_id)
"""

_SEEDS = " UNION ALL ".join(
    f"SELECT {{id}}, words, p, {k} AS mask, concat_ws(' ', {', '.join(f'words[p + {i}]' for i in mask)}) AS seed FROM {{of}}"
    for k, mask in enumerate(seeds.MASKS))
_AT = "(SELECT *, unnest(range(1, len(words) - 6)) AS p FROM {of} WHERE len(words) >= 8)"
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN]+') AS words"

_SHORT = """SELECT {id}, words, w, k, p, array_to_string([words[p + i] FOR i IN range(w) IF i % 3 <> k], ' ') AS seed
  FROM (SELECT *, unnest(CASE WHEN w < 8 THEN [3] ELSE [0, 1, 2] END) AS k FROM ({of}))"""

DECONTAMINATION = rf"""
WITH docs AS MATERIALIZED (SELECT doc_id, {_WORDS} FROM documents),
items AS MATERIALIZED (SELECT min(item_id) AS item_id, count(*) AS n_items, {_WORDS} FROM benchmark GROUP BY text),
long AS (SELECT * FROM items WHERE len(words) >= 13),
short AS (SELECT *, len(words) AS w, 1 AS p FROM items WHERE len(words) BETWEEN 1 AND 12),
doc_seeds AS ({_SEEDS.format(id='doc_id', of=_AT.format(of='docs'))}),
item_seeds AS ({_SEEDS.format(id='item_id, n_items', of=_AT.format(of='long'))}),
doc_short AS ({_SHORT.format(id='doc_id', of="""SELECT doc_id, words, w, unnest(range(1, len(words) - w + 2)) AS p
    FROM docs JOIN (SELECT DISTINCT w FROM short) ON len(words) >= w""")}),
item_short AS ({_SHORT.format(id='item_id, n_items', of='SELECT * FROM short')}),
lines AS (SELECT DISTINCT d.doc_id, i.item_id, i.n_items, d.p - i.p AS diagonal, d.words AS dw, i.words AS iw
    FROM doc_seeds d JOIN item_seeds i ON d.mask = i.mask AND d.seed = i.seed
  UNION SELECT DISTINCT d.doc_id, i.item_id, i.n_items, d.p - i.p, d.words, i.words
    FROM doc_short d JOIN item_short i ON d.w = i.w AND d.k = i.k AND d.seed = i.seed),
starts AS (SELECT doc_id, item_id, n_items, diagonal, least(13, len(iw)) AS w, dw, iw, unnest(range(1, len(iw) - least(13, len(iw)) + 2)) AS s FROM lines),
scored AS (SELECT doc_id, item_id, n_items, diagonal, w, s,
  list_sum([CASE WHEN dw[s + j + diagonal] = iw[s + j] THEN 1 ELSE 0 END FOR j IN range(w)]) AS matches
  FROM starts WHERE s + diagonal >= 1 AND s + diagonal + w - 1 <= len(dw)),
found AS (SELECT doc_id, item_id, diagonal, max(n_items) AS n_items, max(s + w) - min(s) AS tokens, max(matches) AS matches FROM scored
  WHERE matches >= w - CASE WHEN w = 13 THEN 2 WHEN w >= 8 THEN 1 ELSE 0 END GROUP BY doc_id, item_id, diagonal)
SELECT doc_id, item_id, max(n_items) AS n_items, CAST(max(tokens) AS BIGINT) AS overlap_tokens, CAST(max(matches) AS BIGINT) AS matches
FROM found GROUP BY doc_id, item_id
"""

_ESCAPE = r"replace(replace(replace({x}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"

CHAT = rf"""
WITH every AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPE.format(x='text')}) + length(replace({_ESCAPE.format(x='role')}, ':', '\:')) + 15) AS BIGINT) AS formatted_chars
FROM every GROUP BY conv_id
"""

_PATTERNS = {"assign": secrets.ASSIGN, "access": secrets.ACCESS, "hex": secrets.HEX,
             "markov": rf"[A-Za-z0-9+/_=]{{{secrets.SHORTEST},}}"}
_QUOTED = {k: p.replace("'", "''") for k, p in _PATTERNS.items()}
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS gaps FROM docs"
    for n, p in enumerate(_QUOTED.values(), 1))
_PAIRS = f"[strpos('{secrets.CHARS}', {{x}}[i]) * {secrets.BASE} + strpos('{secrets.CHARS}', {{x}}[i + 1]) FOR i IN range(1, length({{x}}))]"
_BASE_36 = "ltrim(array_to_string([substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + CAST((n // p) % 36 AS INTEGER), 1) FOR p IN [" + ", ".join(
    str(36**k) for k in range(11, -1, -1)) + "]], ''), '0')"

SECRETS = f"""
WITH docs AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS (SELECT doc_id, kind, m, gaps, unnest(range(1, len(m) + 1)) AS i FROM ({_FOUND}) WHERE len(m) > 0),
placed AS (SELECT doc_id, kind, m[i] AS match, coalesce(list_sum([length(g) FOR g IN gaps[1:i]]), 0)
    + coalesce(list_sum([length(x) FOR x IN m[1:i - 1]]), 0) AS start FROM found),
valued AS MATERIALIZED (SELECT doc_id, kind, CAST(start AS BIGINT) AS start, CAST(start + length(match) AS BIGINT) AS stop,
    CASE WHEN kind = 1 THEN regexp_extract(match, '{_QUOTED["assign"]}', 2) ELSE match END AS value FROM placed),
spans AS MATERIALIZED (SELECT * FROM valued WHERE kind <> 1 OR length(value) >= 12),
digests AS (SELECT sha256(CAST(doc_id AS VARCHAR)) AS d FROM documents),
numbers AS (SELECT CAST('0x' || d[1:15] AS BIGINT) AS n FROM digests),
samples AS (
  SELECT value AS s, true AS random FROM spans WHERE kind <> 4
  UNION ALL SELECT base64(unhex(d)), true FROM digests UNION ALL SELECT d[1:40], true FROM digests
  UNION ALL SELECT {_BASE_36}, true FROM numbers
  UNION ALL SELECT unnest(regexp_extract_all(t, '[A-Za-z][a-z]{{9,}}')), false FROM docs),
pairs AS (SELECT random, pair, count(*) AS n FROM (SELECT random, unnest({_PAIRS.format(x='s')}) AS pair FROM samples) GROUP BY ALL),
counts AS (SELECT pair, coalesce(sum(n) FILTER (random), 0) AS r, coalesce(sum(n) FILTER (NOT random), 0) AS o FROM pairs GROUP BY pair),
totals AS (SELECT pair // {secrets.BASE} AS a, sum(r) AS r, sum(o) AS o FROM counts GROUP BY a),
runs AS (SELECT *, {_PAIRS.format(x='value')} AS ps FROM spans WHERE kind = 4),
steps AS (SELECT doc_id, start, stop, unnest(ps) AS pair FROM runs),
scored AS (SELECT s.doc_id, s.start, s.stop, avg(round(
    ln((coalesce(c.r, 0) + 1) / (coalesce(t.r, 0) + {secrets.BASE})) - ln((coalesce(c.o, 0) + 1) / (coalesce(t.o, 0) + {secrets.BASE})), 4)) AS ratio
  FROM steps s LEFT JOIN counts c USING (pair) LEFT JOIN totals t ON t.a = s.pair // {secrets.BASE} GROUP BY ALL),
kept AS (SELECT doc_id, kind, start, stop FROM spans WHERE kind <> 4
  UNION ALL SELECT doc_id, 4, start, stop FROM scored m WHERE ratio > 0 AND NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.doc_id = m.doc_id AND b.kind <> 4 AND b.start < m.stop AND m.start < b.stop)),
named AS (SELECT *, {list(_PATTERNS)}[kind] || ':' || start || ':' || stop AS span FROM kept)
SELECT d.doc_id, count(*) FILTER (kind = 1) AS n_assign, count(*) FILTER (kind = 2) AS n_access, count(*) FILTER (kind = 3) AS n_hex,
  count(*) FILTER (kind = 4) AS n_markov,
  sha256(coalesce(string_agg(span, ',' ORDER BY start, kind, stop) FILTER (kind < 4), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY start, kind, stop), '') AS spans
FROM docs d LEFT JOIN named USING (doc_id) GROUP BY d.doc_id
"""

NGRAMS = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN w[i:i + 4] ELSE w END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes na ON na.doc_id = a.doc_id JOIN sizes nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM docs d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS y FROM reach GROUP BY x) m USING (doc_id)
"""

SUBSTRINGS = """
WITH docs AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
strings AS MATERIALIZED (SELECT doc_id, q, b[q + 1:q + 50] AS w
  FROM (SELECT doc_id, b, unnest(range(0, greatest(octet_length(b) - 49, 0))) AS q FROM docs)),
earliest AS (SELECT w, min(doc_id) AS d FROM strings GROUP BY w HAVING count(DISTINCT doc_id) > 1),
hits AS (SELECT doc_id, q, q > lag(q) OVER (PARTITION BY doc_id ORDER BY q) + 50 AS apart
  FROM strings JOIN earliest USING (w) WHERE d < doc_id),
runs AS MATERIALIZED (SELECT doc_id, min(q) AS s, max(q) + 50 AS e FROM (
  SELECT *, sum(CAST(coalesce(apart, false) AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY q) AS run FROM hits) GROUP BY doc_id, run),
cuts AS (SELECT doc_id, s, e FROM runs UNION ALL SELECT doc_id, octet_length(b), NULL FROM docs),
pieces AS (SELECT doc_id, s, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, e NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM cuts),
kept AS (SELECT doc_id, sha256(unhex(string_agg(CASE WHEN s > a THEN hex(b[a + 1:s]) ELSE '' END, '' ORDER BY s, a))) AS kept_sha256
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id),
removed AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM docs JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""


PREFIX_TRIE = r"""
WITH RECURSIVE turns AS (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS t,
  -- crc32 of the decimal digits, bit by bit
  xor(list_reduce([ascii(c) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')], lambda a, b:
    list_reduce(range(8), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)), xor(a, CAST(b AS BIGINT))), 4294967295), 4294967295) % 6 AS h
  FROM turns GROUP BY conv_id),
rebuilt AS MATERIALIZED (SELECT o.conv_id, coalesce(b.t[:o.h], []) || o.t[o.h + 1:] AS t
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 100),
prefixes AS (SELECT conv_id, len(t) AS n, t, unnest(range(0, len(t) + 1)) AS depth FROM rebuilt),
nodes AS MATERIALIZED (SELECT depth, CASE WHEN depth = 0 THEN [] ELSE t[:depth] END AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY ALL),
keyed AS MATERIALIZED (SELECT *, md5(CAST(to_json(p) AS VARCHAR)) AS k, CASE WHEN depth > 0 THEN md5(CAST(to_json(p[:depth - 1]) AS VARCHAR)) END AS above,
  CASE WHEN depth > 0 THEN (n_convs - 1) * coalesce(length(p[depth].x), 0) ELSE 0 END AS own FROM nodes),
counts AS (SELECT above AS k, count(*) AS n FROM keyed WHERE depth > 0 GROUP BY 1),
full_nodes AS MATERIALIZED (SELECT a.*, coalesce(c.n, 0) AS n_children FROM keyed a LEFT JOIN counts c USING (k)),
up AS (SELECT k AS top, k AS at, above, own, n_children FROM full_nodes
  UNION ALL SELECT f.k, u.at, f.above, u.own, u.n_children FROM up u JOIN full_nodes f ON f.k = u.above),
sums AS (SELECT top AS k, sum(own) AS saved, count_if(n_children = 0) AS leaves FROM up GROUP BY top)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(s.leaves AS BIGINT) AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM full_nodes a JOIN sums s USING (k) LEFT JOIN full_nodes b ON b.k = a.above
"""


def all_sql() -> dict[str, str]:
    return {"op3_suffix_dedup": SUBSTRINGS, "op4_chat": CHAT, "op8_ngram_join": NGRAMS, "op9_secret_scan": SECRETS, "op1_decontamination": DECONTAMINATION, "op2_url_filter": URL_FILTER,
            "op13_prefix_trie": PREFIX_TRIE}
