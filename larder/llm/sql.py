"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

NGRAM_JOIN = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS w
  FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g, CASE WHEN len(w) < 5 THEN len(w) ELSE 5 END AS k FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
m AS (SELECT node, min(seen) AS c FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id"""

HOST_QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5),
h AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS s FROM p),
twice AS (SELECT r, s FROM h GROUP BY r, s HAVING count(*) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT h.r AS r, h.i AS i, unnest([0, 1, 2, 3, 4]) AS k FROM h JOIN twice ON h.r = twice.r AND h.s = twice.s) q GROUP BY r),
m AS (SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.r = cov.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
hosts AS (SELECT host, count(*) AS k, CAST(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS DOUBLE) AS b FROM f GROUP BY host),
t AS (SELECT sum(b) / sum(k) AS mean, greatest(sum(k * (b / k) * (b / k)) / sum(k) - (sum(b) / sum(k)) * (sum(b) / sum(k)), 0) AS var FROM hosts),
prior AS (SELECT mean, CASE WHEN var > 1e-9 THEN least(greatest(mean * (1 - mean) / var - 1, 1), 1e6) ELSE 1e6 END AS weight FROM t),
u AS (SELECT host, k, mean, weight, (b + mean * weight) / (k + weight) AS host_rate FROM hosts, prior),
v AS (SELECT host, host_rate, host_rate - 3 * sqrt(host_rate * (1 - host_rate) / (k + weight + 1)) > 1.5 * mean AS host_rejected FROM u)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (host_rejected AND (20 * n_symbols > word_chars OR n_dup_lines >= 3 OR 100 * n_repeat_words > 10 * n_words)) AS kept,
       f.host, round(host_rate, 6) AS host_rate, host_rejected
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host"""

QUOTATION = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r?\n') AS lines FROM conversations),
l AS (SELECT r, conv_id, turn, unnest(lines) AS line FROM m),
k AS (SELECT *, line LIKE '>%' AS quoted, length(replace(regexp_extract(line, '^(?:>[ ]?)+'), ' ', '')) AS level,
             lower(trim(regexp_replace(regexp_replace(line, '^(?:>[ ]?)+', ''), '\s+', ' ', 'g'))) AS q FROM l),
origin AS (SELECT conv_id, q, min(turn) AS t FROM k WHERE NOT quoted AND q <> '' GROUP BY conv_id, q),
hit AS (SELECT DISTINCT k.r, k.conv_id, k.turn, k.level, k.q, o.t FROM k JOIN origin o ON k.conv_id = o.conv_id AND k.q = o.q AND o.t < k.turn WHERE k.quoted AND k.q <> ''),
hits AS (SELECT conv_id, turn, count(*) AS n, min(level) AS level FROM hit GROUP BY conv_id, turn),
best AS (SELECT h.conv_id, h.turn, max(h.t) AS t FROM hit h JOIN hits s ON h.conv_id = s.conv_id AND h.turn = s.turn AND h.level = s.level GROUP BY h.conv_id, h.turn),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM m) q),
reply AS (SELECT t.conv_id, t.turn, t.before, coalesce(b.t, t.before) AS reply_to, coalesce(s.n, 0) AS n_quotes FROM turns t
          LEFT JOIN best b ON b.conv_id = t.conv_id AND b.turn = t.turn LEFT JOIN hits s ON s.conv_id = t.conv_id AND s.turn = t.turn),
path AS (SELECT conv_id, turn, reply_to, n_quotes, [turn] AS key FROM reply WHERE reply_to IS NULL
         UNION ALL SELECT y.conv_id, y.turn, y.reply_to, y.n_quotes, CASE WHEN y.reply_to = y.before THEN list_append(p.key[1:len(p.key) - 1], y.turn) ELSE list_append(list_append(p.key, y.turn), y.turn) END
         FROM path p JOIN reply y ON y.conv_id = p.conv_id AND y.reply_to = p.turn),
bodies AS (SELECT r, m.conv_id, m.turn, role, trim(regexp_replace(array_to_string(list_filter(lines, lambda x: NOT x LIKE '>%'), chr(10)), '^\n+|\n+$', '', 'g')) AS body FROM m)
SELECT b.conv_id, row_number() OVER (PARTITION BY b.conv_id ORDER BY p.key, b.role, b.body) - 1 AS position, b.turn, b.role, b.body, p.reply_to, p.n_quotes
FROM bodies b JOIN path p ON p.conv_id = b.conv_id AND p.turn = b.turn"""

# crc32 by the nibbles of its bytes, from the table of the 16 remainders of the reversed polynomial.
_CRC_TABLE = r"""tab AS (
  SELECT list(r ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS r
    FROM (SELECT CAST(unnest(range(16)) AS BIGINT) AS i) n) q)"""


def _nibbles(text: str) -> str:
    return f"""list_transform(string_split(hex(encode({text})), ''), lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT))"""


def _crc(x: str) -> str:
    """Of a list of nibbles, high before low; the table is column ``t``."""
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(len({x})), lambda i: {x}[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END])),"
            " lambda c, n: xor(c >> 4, t[(xor(c, n) & 15) + 1])), 4294967295)")


SPELLING = "WITH RECURSIVE " + _CRC_TABLE + r""",
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
counted AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k FROM runs GROUP BY 1, 2),
hashed AS (SELECT doc_id, run, k, """ + _crc("x") + """ AS h FROM (SELECT *, """ + _nibbles("concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':', run)") + r""" AS x FROM counted) c, tab),
spelt AS (SELECT CASE WHEN h % 97 = 0 THEN concat(substr(run, 1, CAST(h % length(run) AS BIGINT)), substr(run, CAST(h % length(run) AS BIGINT) + 2)) ELSE run END AS word, k FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
less AS (SELECT word, n, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS z FROM cut),
near AS (
  SELECT a.word AS a, b.word AS b, b.n AS n FROM less a JOIN less b ON a.z = b.z AND a.i = b.i AND a.word <> b.word
  UNION SELECT l.word, v.word, v.n FROM less l JOIN v ON l.z = v.word
  UNION SELECT v.word, l.word, l.n FROM less l JOIN v ON l.z = v.word),
best AS (SELECT a, count(*) AS n_near, max(n) AS top FROM near GROUP BY a),
pick AS (SELECT near.a, min(b) AS b FROM near JOIN best ON near.a = best.a AND near.n = top GROUP BY near.a),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * v.n THEN pick.b END AS form, CASE WHEN top >= 2 * v.n THEN top END AS form_n
      FROM v LEFT JOIN best ON best.a = v.word LEFT JOIN pick ON pick.a = v.word),
chain AS (SELECT word, word AS here, 0 AS steps FROM f UNION ALL SELECT chain.word, f.form, steps + 1 FROM chain JOIN f ON f.word = chain.here WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(here, steps) AS root FROM chain GROUP BY word)
SELECT f.word, n, CAST(n_near AS BIGINT) AS n_near, form, CAST(form_n AS BIGINT) AS form_n, root FROM f JOIN ends ON ends.word = f.word"""

PERIODIC_RUNS = "WITH " + _CRC_TABLE + r""",
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             """ + _nibbles("coalesce(CAST(doc_id AS VARCHAR), '')") + """ AS x FROM documents),
h AS (SELECT r, doc_id, w, len(w) AS n, CASE WHEN len(x) > 0 THEN """ + _crc("x") + r""" ELSE 0 END AS h FROM d, tab),
a AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
ws AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p),
t AS (SELECT r, n, unnest(range(n)) AS i, unnest(w) AS x FROM ws),
eq AS (SELECT a.r, b.i - a.i AS q, a.i FROM t a JOIN t b ON a.r = b.r AND a.x = b.x AND b.i > a.i WHERE b.i - a.i <= a.n // 4),
land AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM eq),
st AS (SELECT r, q, min(i) AS s, max(i) + 1 + q AS e FROM land GROUP BY r, q, k HAVING max(i) + 1 + q - min(i) >= greatest(6, 4 * q)),
runs AS (SELECT * FROM st WHERE NOT EXISTS (SELECT 1 FROM st o WHERE o.r = st.r AND o.q < st.q AND st.q % o.q = 0 AND o.s <= st.s AND o.e >= st.e)),
listed AS (SELECT r, count(*) AS n_runs, string_agg(concat(CAST(s AS VARCHAR), ',', CAST(e - s AS VARCHAR), ',', CAST(q AS VARCHAR), chr(10)), '' ORDER BY s, q) AS l FROM runs GROUP BY r),
best AS (SELECT r, s, e - s AS k, q FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY CAST(e - s AS DOUBLE) / q DESC, s, q) = 1),
gone AS (SELECT DISTINCT r, unnest(range(s + q, e)) AS i FROM runs),
kept AS (SELECT t.r, string_agg(x, ' ' ORDER BY t.i) AS l FROM t LEFT JOIN gone ON gone.r = t.r AND gone.i = t.i WHERE gone.i IS NULL GROUP BY t.r)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(s AS BIGINT) AS start, CAST(k AS BIGINT) AS length, CAST(q AS BIGINT) AS period,
       CAST(1000 * k // q AS BIGINT) AS exponent_milli, sha256(coalesce(listed.l, '')) AS runs_sha256, sha256(coalesce(kept.l, '')) AS collapsed_sha256, CAST(n AS INT) AS n_words
FROM ws LEFT JOIN listed ON listed.r = ws.r LEFT JOIN best ON best.r = ws.r LEFT JOIN kept ON kept.r = ws.r"""
