"""SQL for the queries that it can express: plain definitions, all pairs and recursion."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]"
TEXTS = "t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = f"""
WITH {TEXTS}, w AS (SELECT *, regexp_extract_all(text, '{WORD}+') AS ws FROM t),
g AS (SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS k FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM t)
      WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(l.n - l.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
             coalesce(l.n, 0) AS n_lines, length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) AS capitals,
             length(regexp_replace(text, '[^!]', '', 'g')) AS exclaims
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN l ON w.doc_id = l.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
            OR 10 * capitals > 4 * word_chars OR 2 * exclaims > n_words) AS kept
FROM b
"""

NEAR = f"""
WITH RECURSIVE {TEXTS}, w AS (SELECT doc_id, regexp_extract_all({LOWER}, '{WORD}+') AS ws FROM t),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws ELSE [ws[i], ws[i + 1]] END AS k
      FROM w, unnest(range(1, greatest(len(ws), least(len(ws), 1) + 1))) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, other) AS (SELECT doc_id, doc_id FROM t UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, t.doc_id = component_id AS kept
FROM t JOIN c ON t.doc_id = c.id LEFT JOIN n ON t.doc_id = n.doc_id
"""

SUFFIXES = """
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS k FROM h, unnest(range(0, n - 99)) AS u(p)),
f AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
d AS (SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM f),
i AS (SELECT *, sum(CASE WHEN q IS NULL OR p - q > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM d),
s AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, g),
o AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT h.doc_id, any_value(h.h) AS h, any_value(h.n) AS n, coalesce(sum(b - a), 0) AS gone, count(a) AS spans, coalesce(max(b), 0) AS stop,
             coalesce(string_agg(substr(h.h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a), '') AS head
      FROM h LEFT JOIN o ON h.doc_id = o.doc_id GROUP BY h.doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, spans AS n_spans,
       sha256(unhex(head || substr(h, CAST(2 * stop + 1 AS BIGINT)))) AS kept_sha256 FROM k
"""

LINES = f"""
WITH RECURSIVE {TEXTS},
a AS (SELECT doc_id, i - 1 AS no, string_split(text, chr(10))[i] AS line FROM t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)),
v AS (SELECT *, regexp_matches(line, '{WORD}') AS worded FROM a),
d AS (SELECT line, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM v WHERE worded)),
s AS (SELECT DISTINCT id, substr(line, i, 10) AS k FROM d, unnest(range(1, greatest(length(line) - 9, 1) + 1)) AS u(i)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS x FROM s x JOIN s y ON x.k = y.k AND x.id < y.id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * x >= 80 * (na.n + nb.n - x)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(id, other) AS (SELECT id, id FROM d UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
c AS (SELECT id, min(other) AS component FROM reach GROUP BY id),
z AS (SELECT doc_id, no, row_number() OVER (PARTITION BY component ORDER BY doc_id, no) > 1 AS gone
      FROM v JOIN d ON v.line = d.line JOIN c ON c.id = d.id),
j AS (SELECT v.doc_id, v.no, v.line, v.worded, coalesce(z.gone, FALSE) AS gone FROM v LEFT JOIN z ON v.doc_id = z.doc_id AND v.no = z.no)
SELECT doc_id, count(*) FILTER (worded) AS lines, count(*) FILTER (gone) AS dropped_lines,
       md5(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone), '')) AS kept_md5
FROM j GROUP BY doc_id
"""

TRIE = """
WITH RECURSIVE turns AS (
    SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), bits AS (
    -- CRC-32 of the decimal id: each byte, then eight steps (-1)
    SELECT conv, own, list_reduce(
               list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv::VARCHAR, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda a, t: CASE WHEN t >= 0 THEN xor(a, t) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END
           ) AS crc
    FROM (SELECT conv, max(pos) AS own FROM turns GROUP BY conv)
), convs AS (
    SELECT b.conv, b.own, b.conv - b.conv % 5 AS base, xor(b.crc, 4294967295) % 9 AS h, least(xor(b.crc, 4294967295) % 9, coalesce(s.own, 0)) AS lead
    FROM bits b LEFT JOIN bits s ON s.conv = b.conv - b.conv % 5
), rebuilt AS (
    SELECT c.conv, t.pos AS at, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.base AND t.pos <= c.lead
    UNION ALL
    SELECT c.conv, c.lead + t.pos - c.h AS at, t.role, t.text FROM convs c JOIN turns t ON t.conv = c.conv AND t.pos > c.h
), path AS (
    SELECT conv, 0::BIGINT AS depth, sha256('') AS name, NULL::VARCHAR AS parent, 0::BIGINT AS bytes FROM convs
    UNION ALL
    SELECT r.conv, r.at, sha256(p.name || sha256(r.role) || sha256(r.text)), p.name, strlen(r.text)
    FROM path p JOIN rebuilt r ON r.conv = p.conv AND r.at = p.depth + 1
), ends AS (
    SELECT name, string_agg(conv::VARCHAR, ',' ORDER BY conv) AS ids
    FROM path p WHERE depth = (SELECT max(depth) FROM path q WHERE q.conv = p.conv) GROUP BY name
), nodes AS (
    SELECT name, any_value(parent) AS parent, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv) AS conv, count(*) AS n
    FROM path GROUP BY name
), children AS (
    SELECT parent AS name, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
    SELECT a.name, sum((c.name IS NULL)::INT) AS n_leaves, sum((d.n - 1) * d.bytes) AS saved
    FROM nodes d JOIN path a ON a.conv = d.conv AND a.depth <= d.depth LEFT JOIN children c ON c.name = d.name
    GROUP BY a.name
)
SELECT n.conv AS conv_id, n.depth::BIGINT AS depth, p.conv AS parent_conv_id, n.n AS n_convs, coalesce(c.n_children, 0) AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.name = n.parent LEFT JOIN children c ON c.name = n.name
JOIN subtrees s ON s.name = n.name LEFT JOIN ends e ON e.name = n.name
"""

ORACLES = {
    "op2_line_dedup": LINES,
    "op5_suffix_dedup": SUFFIXES,
    "op7_quality": QUALITY,
    "op10_near_duplicates": NEAR,
    "op11_prefix_trie": TRIE,
}
