"""SQL twins of the named queries that SQL can express."""

from __future__ import annotations

PHRASES = r"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
runs AS (SELECT row_number() OVER () AS piece, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, piece, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM runs),
four AS (
  SELECT lang, a, lead(a, 1) OVER line AS b, lead(a, 2) OVER line AS c, lead(a, 3) OVER line AS d
  FROM words WINDOW line AS (PARTITION BY piece ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, a AS p FROM four UNION ALL SELECT lang, 2, a || ' ' || b FROM four WHERE b IS NOT NULL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM four WHERE c IS NOT NULL
  UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM four WHERE d IS NOT NULL),
f AS (SELECT lang, k, p, string_split(p, ' ') AS w, count(*) AS n FROM grams GROUP BY lang, k, p HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM runs GROUP BY lang),
cuts AS (
  SELECT c.lang, c.k, c.p, c.n AS a, x.k AS cut, x.n AS l, y.n AS r, (2000000::HUGEINT * c.n) // (x.n + y.n) AS score
  FROM f AS c, range(1, 4) AS s(j), f AS x, f AS y
  WHERE c.k > 1 AND s.j < c.k AND x.lang = c.lang AND y.lang = c.lang
    AND x.p = array_to_string(list_slice(c.w, 1, s.j), ' ') AND y.p = array_to_string(list_slice(c.w, s.j + 1, c.k), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inner_ AS (
  SELECT c.lang, array_to_string(list_slice(c.w, i, i + k2 - 1), ' ') AS p, max(c.n) AS longest
  FROM f AS c, range(2, 4) AS s(k2), range(1, 4) AS t(i)
  WHERE k2 < c.k AND i + k2 - 1 <= c.k GROUP BY ALL),
free AS (
  SELECT b.lang, b.p AS phrase, b.a, b.l, b.r, b.score
  FROM best AS b LEFT JOIN inner_ AS i ON i.lang = b.lang AND i.p = b.p
  WHERE coalesce(100::HUGEINT * i.longest < 80::HUGEINT * b.a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score::BIGINT AS score
FROM free JOIN total AS t USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

TRIE = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS place, id,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM given),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM given)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.place, t.id, t.words FROM convs AS c JOIN turns AS t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.id, t.words FROM convs AS c JOIN turns AS t ON t.conv_id = c.conv_id AND t.place > c.h),
ordered AS (SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, place) AS depth FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, words, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM ordered
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
members AS (
  SELECT conv_id AS member, depth, words, min(conv_id) OVER (PARTITION BY depth, prefix) AS node,
         max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM prefixes),
nodes AS (
  SELECT node, depth, count(*) AS n, any_value(words) AS words,
         sha256(coalesce(string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (ends), '')) AS ends FROM members GROUP BY node, depth),
linked AS (
  SELECT n.*, m.node AS parent FROM nodes AS n LEFT JOIN members AS m ON m.member = n.node AND m.depth = n.depth - 1),
children AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS kids FROM linked WHERE parent IS NOT NULL GROUP BY ALL),
full_ AS (SELECT l.*, coalesce(c.kids, 0) AS kids FROM linked AS l LEFT JOIN children AS c ON c.node = l.node AND c.depth = l.depth),
below AS (
  SELECT m.node, m.depth, count(*) FILTER (f.kids = 0) AS leaves, sum((f.n - 1) * f.words) AS saved
  FROM full_ AS f JOIN members AS m ON m.member = f.node AND m.depth <= f.depth GROUP BY ALL)
SELECT f.node AS conv_id, f.depth::BIGINT AS depth, f.parent AS parent_conv_id, f.n::BIGINT AS n_convs, f.kids::BIGINT AS n_children,
       b.leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, f.ends AS ends_sha256
FROM full_ AS f JOIN below AS b ON b.node = f.node AND b.depth = f.depth
"""
