"""SQL (DuckDB) that must give the rows of the operators that SQL can express."""

#: Words of a text with A-Z lower-cased.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

SHARDING = """
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
r AS (
  SELECT doc_id, coalesce(text, '') AS body, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h1,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h2
  FROM documents),
c AS (
  SELECT r.*, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(range(size - 1), lambda i: ('0x' || substr(hex(encode(body)), 2 * i + 1, 2))::BIGINT)),
           lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) AS crc
  FROM r, crc),
p AS (
  SELECT *, sum(size) OVER (ORDER BY h1, h2, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before,
         row_number() OVER (ORDER BY h1, h2, doc_id, size) AS nr, sum(size) OVER () AS total FROM c),
g AS (SELECT h1, min(before) AS lo, max(before + size) AS hi, any_value(total) AS total FROM p GROUP BY h1),
w AS (SELECT j, (total * j) // 8 AS w FROM range(1, 8) t(j), (SELECT any_value(total) AS total FROM p)),
e AS (
  SELECT CASE WHEN hi - lo > 0.01 * total / 8 THEN w WHEN w - lo <= hi - w THEN lo ELSE hi END AS ends
  FROM w JOIN g ON lo <= w AND w < hi),
s AS (SELECT p.*, (SELECT count(*) FROM e WHERE before >= ends) AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       (row_number() OVER (PARTITION BY shard ORDER BY nr) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM s
"""

MIXING = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR, md5(text))), 1, 15))::BIGINT AS h
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
named AS (
  SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place, source_size * 2.0::DOUBLE AS cap FROM sums),
weighed AS (SELECT *, ([5, 2, 1])[place % 3 + 1] AS weight FROM named),
filled AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS full_,
         sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_,
         sum(source_size) OVER () AS whole
  FROM weighed),
levels AS (SELECT *, (whole * 1.5::DOUBLE - full_) / open_ AS level FROM filled),
level AS (SELECT arg_min(level, (cap / weight, place)) AS level FROM levels WHERE level * weight <= cap),
plan AS (
  SELECT source, place, source_size, least(cap, weight * level.level) AS target,
         greatest(ceil(source_size / 256), least(source_size, 512))::BIGINT AS blocks
  FROM filled, level),
quotas AS (SELECT *, CASE WHEN source_size > 0 THEN round(target * blocks / source_size) ELSE 0 END::BIGINT AS quota FROM plan),
ends AS (SELECT place, sum(quota) OVER (ORDER BY place) AS upto FROM quotas WHERE quota > 0),
n AS (SELECT sum(quota)::BIGINT AS slots FROM quotas),
points AS (SELECT i, ((i % 2147483648) * 1327217885 % 2147483648) / 2147483648.0::DOUBLE * slots AS point FROM n, range(slots) t(i)),
dealt AS (SELECT i, (SELECT min(place) FROM ends WHERE upto > point) AS place FROM points),
ranked AS (SELECT place, row_number() OVER (PARTITION BY place ORDER BY i) - 1 AS rank FROM dealt),
used AS (
  SELECT place, rank % blocks AS block, count(*) AS uses FROM ranked JOIN quotas USING (place) WHERE rank < 2 * blocks GROUP BY ALL),
starts AS (
  SELECT d.*, place, source_size, target, blocks, sum(size) OVER (PARTITION BY place ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS start
  FROM d JOIN quotas ON d.source IS NOT DISTINCT FROM quotas.source),
edges AS (
  SELECT place, block, uses, floor(block * (source_size / blocks) + 1e-9) AS lo, floor((block + 1) * (source_size / blocks) + 1e-9) AS hi
  FROM used JOIN quotas USING (place)),
got AS (
  SELECT s.place, s.start, sum((least(s.start + size, hi) - greatest(s.start, lo)) * uses) AS got
  FROM starts s JOIN edges e ON s.place = e.place AND s.start < hi AND lo < s.start + size WHERE size > 0 GROUP BY ALL)
SELECT doc_id, source, size, source_size, target, CASE WHEN size > 0 THEN coalesce(got, 0) ELSE 0 END::BIGINT AS taken
FROM starts LEFT JOIN got USING (place, start)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS nr, doc_id, {_WORDS} AS ws FROM documents),
s AS (
  SELECT DISTINCT nr, array_to_string(ws[i:i + 4], ' ') AS shingle FROM d, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) t(i) WHERE len(ws) > 0),
n AS (SELECT nr, count(*) AS n FROM s GROUP BY nr),
c AS (SELECT a.nr AS a, b.nr AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.nr <> b.nr GROUP BY ALL),
links AS (SELECT a, b FROM c JOIN n x ON x.nr = a JOIN n y ON y.nr = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (SELECT nr AS a, nr AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least_ AS (SELECT reach.a AS nr, min(doc_id) AS component_id FROM reach JOIN d ON d.nr = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN least_ USING (nr) LEFT JOIN n USING (nr)
"""
