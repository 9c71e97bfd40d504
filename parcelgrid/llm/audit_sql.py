"""SQL that checks sharding, the divergence audit and phrase mining in plainer ways."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The capacity comes from dynamic programming over all cuts here; CRC-32 is worked out byte by byte.
SHARDS = r"""
WITH RECURSIVE
d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, ''))::BIGINT + 1 AS size, sha256(coalesce(text, '')) AS digest,
             md5(coalesce(doc_id::VARCHAR, '')) AS mark FROM documents),
g AS (SELECT digest, sum(size)::BIGINT AS size FROM d GROUP BY digest),
ranked AS (SELECT digest, size, row_number() OVER big AS k, sum(size) OVER () - coalesce(sum(size) OVER (big ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining
           FROM g WINDOW big AS (ORDER BY size DESC, digest)),
own AS (SELECT digest, k FROM (SELECT digest, k, bool_and(size * (17 - k) > remaining) OVER (ORDER BY k) AS takes FROM ranked WHERE k < 16) WHERE takes),
p AS (SELECT digest, row_number() OVER (ORDER BY digest) AS i, sum(size) OVER (ORDER BY digest)::BIGINT AS p FROM g WHERE digest NOT IN (SELECT digest FROM own)),
ends AS (SELECT i, p FROM p UNION ALL SELECT 0, 0),
f AS (SELECT 1 AS k, i, p AS c FROM ends
      UNION ALL SELECT f.k + 1, b.i, min(greatest(f.c, b.p - a.p)) FROM f JOIN ends a ON a.i = f.i JOIN ends b ON b.i >= a.i WHERE f.k < 16 GROUP BY f.k, b.i),
best AS (SELECT c FROM f WHERE k = 16 - (SELECT count(*) FROM own) AND i = (SELECT max(i) FROM ends)),
cuts AS (SELECT 0 AS k, 0::BIGINT AS p
         UNION ALL SELECT cuts.k + 1, max(ends.p) FROM cuts, best, ends WHERE ends.p <= cuts.p + best.c AND cuts.p < (SELECT max(p) FROM ends) GROUP BY cuts.k),
home AS (SELECT digest, k - 1 AS shard FROM own
         UNION ALL SELECT digest, (SELECT count(*) FROM own) + (SELECT count(*) FROM cuts WHERE cuts.k > 0 AND cuts.p < p.p) FROM p),
table_ AS (SELECT list(c ORDER BY n) AS crc FROM (
  SELECT n, list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(n))),
crc AS (SELECT t, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(t) + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT)),
                 lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
        FROM (SELECT DISTINCT t, hex(encode(t)) AS h FROM d), table_)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard::INT AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY mark, doc_id NULLS FIRST, digest) - 1 AS slot, NULL::INT AS grown_shard
FROM d JOIN home USING (digest) JOIN crc USING (t)"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(""" + _LOWER + r""", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
groups AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
counts AS (SELECT lang, source, term, count(*) AS c FROM o GROUP BY ALL),
langs AS (SELECT lang, sum(c)::HUGEINT + 2 * count(*) AS total FROM kept GROUP BY lang),
dense AS (SELECT g.lang, g.source, k.term, k.c AS lang_c, coalesce(c.c, 0) AS c
          FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT s.lang, source, term, c, (1 + 1000000000::HUGEINT * (c + 2) // (sum(c) OVER g + 2 * count(*) OVER g))::BIGINT AS p,
                  (1 + 1000000000::HUGEINT * (lang_c + 2) // total)::BIGINT AS q
           FROM dense s JOIN langs ON langs.lang = s.lang WINDOW g AS (PARTITION BY s.lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM shares WHERE c > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
               FROM (FROM pairs UNION ALL FROM terms)) WHERE part = 'pair' OR rank <= 10"""

PHRASES = r"""
WITH p AS (SELECT row_number() OVER () AS r, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(""" + _LOWER + r""", '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT row_number() OVER () AS r, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
o AS (SELECT lang, w[i] AS w1, w[i + 1] AS w2, w[i + 2] AS w3 FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM q)),
one AS (SELECT lang, w1, count(*) AS c FROM o GROUP BY ALL),
two AS (SELECT lang, w1, w2, count(*) AS c FROM o WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, w1, w2, w3, count(*) AS c FROM o WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
cut AS (SELECT two.lang, w1 || ' ' || w2 AS phrase, two.c AS a, x.c AS l, y.c AS r, 1 AS k
        FROM two JOIN one x USING (lang, w1) JOIN one y ON y.lang = two.lang AND y.w1 = two.w2
        UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.c, x.c, y.c, 1
        FROM three t JOIN one x USING (lang, w1) JOIN two y ON y.lang = t.lang AND y.w1 = t.w2 AND y.w2 = t.w3
        UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.c, x.c, y.c, 2
        FROM three t JOIN two x ON x.lang = t.lang AND x.w1 = t.w1 AND x.w2 = t.w2 JOIN one y ON y.lang = t.lang AND y.w1 = t.w3),
scored AS (SELECT *, (1000000::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM cut),
worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
held AS (SELECT lang, phrase, max(c) AS longer FROM (SELECT lang, w1 || ' ' || w2 AS phrase, c FROM three
                                                     UNION ALL SELECT lang, w2 || ' ' || w3, c FROM three) GROUP BY ALL),
free AS (SELECT w.* FROM worst w LEFT JOIN held h ON h.lang = w.lang AND h.phrase = w.phrase WHERE h.longer IS NULL OR 100 * h.longer < 50 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
