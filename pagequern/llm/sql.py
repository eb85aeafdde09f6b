"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH t AS (SELECT doc_id, {ASCII_LOWER.format("coalesce(text, '')")} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)"""

WARC_FIXITY = r"""
WITH named AS (
  SELECT page_id, coalesce(page_id::VARCHAR, '') AS id, coalesce(url, '') AS url, coalesce(html, '') AS html,
    md5(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '')) AS m, md5(coalesce(page_id::VARCHAR, '')) AS spot FROM pages),
recs AS (
  SELECT page_id, spot, concat_ws(chr(13) || chr(10), 'WARC/1.1', 'WARC-Type: resource',
    'WARC-Record-ID: <urn:uuid:' || concat_ws('-', substr(m, 1, 8), substr(m, 9, 4), substr(m, 13, 4), substr(m, 17, 4), substr(m, 21, 12)) || '>',
    'WARC-Target-URI: ' || url, 'WARC-Date: 2024-01-01T00:00:00Z', 'Content-Type: text/html; charset=utf-8',
    'Content-Length: ' || strlen(html), '', html, '', '') AS rec FROM named),
hashed AS (
  SELECT page_id, spot, strlen(rec)::BIGINT AS n, sha256(rec) AS sha256,
    sha256(CASE WHEN ('0x' || substr(spot, 9, 8))::BIGINT % 97 = 0 THEN replace(rec, 'e', 'E') ELSE rec END) AS replica_sha256,
    ('0x' || substr(spot, 1, 8))::BIGINT % (SELECT greatest(1, (sum(strlen(rec)) + 67108863) // 67108864) FROM recs)::BIGINT AS shard FROM recs)
SELECT page_id, shard, (sum(n) OVER w - n)::BIGINT AS "start", (sum(n) OVER w)::BIGINT AS "end", sha256, replica_sha256,
  sha256 <> replica_sha256 AS damaged
FROM hashed WINDOW w AS (PARTITION BY shard ORDER BY spot, sha256 ROWS UNBOUNDED PRECEDING)"""

SECRET_SCAN = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, source, coalesce(text, '') AS text FROM documents),
hits AS (
  SELECT row, doc_id, source, 0 AS kind, regexp_extract_all(text, '(?s)(.*?)((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 1) AS gaps,
    regexp_extract_all(text, '(?s)(.*?)((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 2) AS found,
    regexp_extract_all(text, '(?s)(.*?)((?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 3) AS vals FROM docs
  UNION ALL SELECT row, doc_id, source, 1, regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 1), regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 2), regexp_extract_all(text, '(?s)(.*?)(AKIA[A-Z0-9]+)', 2) FROM docs
  UNION ALL SELECT row, doc_id, source, 2, regexp_extract_all(text, '(?s)(.*?)([0-9a-f]+)', 1), regexp_extract_all(text, '(?s)(.*?)([0-9a-f]+)', 2), regexp_extract_all(text, '(?s)(.*?)([0-9a-f]+)', 2) FROM docs),
parts AS (
  SELECT row, doc_id, source, kind, unnest(range(1, len(found) + 1)) AS i, unnest(gaps) AS gap, unnest(found) AS found, unnest(vals) AS val FROM hits),
placed AS (
  SELECT *, sum(length(gap) + length(found)) OVER (PARTITION BY row, kind ORDER BY i) AS stop FROM parts),
base AS (
  SELECT row, doc_id, source, kind, (stop - length(found))::BIGINT AS start, stop::BIGINT AS stop, val, (stop - length(val))::BIGINT AS val_start
  FROM placed WHERE CASE kind WHEN 0 THEN length(val) >= 12 WHEN 1 THEN length(found) >= 18 ELSE length(found) >= 16 END),
owners AS (
  SELECT val, CASE WHEN count(DISTINCT coalesce('0' || source, '1')) >= 2 OR count(DISTINCT (coalesce('0' || source, '1'), coalesce('0' || doc_id, '1'))) >= 5 THEN 4
    WHEN len(list_distinct(string_split(val, ''))) >= 8 THEN 3 END AS verdict
  FROM base GROUP BY val),
added AS (
  SELECT DISTINCT row, doc_id, verdict AS kind, val_start AS start, stop FROM base JOIN owners USING (val) WHERE verdict IS NOT NULL),
spans AS (
  SELECT row, kind, start, stop FROM base UNION ALL SELECT row, kind, start, stop FROM added),
lists AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    count(*) FILTER (kind = 3) AS n_live, count(*) FILTER (kind = 4) AS n_copied,
    string_agg(['assign', 'access', 'hex', 'live', 'copied'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) FILTER (kind < 3) AS base,
    string_agg(['assign', 'access', 'hex', 'live', 'copied'][kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind, stop) AS spans
  FROM spans GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM docs LEFT JOIN lists USING (row)"""

SOURCE_MIX = r"""
WITH sized AS (
  SELECT doc_id, coalesce('0' || source, '1') AS skey, md5('mix-1|' || coalesce(doc_id::VARCHAR, '')) AS spot,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
whole AS (
  SELECT w.*, ((2 * words + block) // (2 * block))::BIGINT AS blocks FROM (
    SELECT coalesce(sum(size), 0)::BIGINT AS words,
      greatest(1, least(2048, coalesce(sum(size), 0)::BIGINT // 65536)) AS block,
      greatest(1, (count(*) + coalesce(sum(size), 0) + 1048575)::BIGINT // 1048576) AS shards
    FROM sized) w),
src AS (
  SELECT skey, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY skey) AS place,
    (row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY skey),
ratios AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM src),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM ratios WINDOW b AS (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(level, place) AS level FROM levels
  WHERE level <= ratio AND ratio = (SELECT min(ratio) FROM levels WHERE level <= ratio)),
wanted AS (SELECT skey, place, source_size, least(cap::DOUBLE, level.level * weight) AS target FROM ratios, level),
-- every quotient that can win, the highest of all kept
dealt AS (
  SELECT skey, count(*) AS of_source FROM (
    SELECT skey, row_number() OVER (ORDER BY target / (2 * a + 1) DESC, place) AS rank FROM (
      SELECT wanted.*, unnest(range(0, (target / block)::BIGINT + 64)) AS a FROM wanted, whole WHERE target > 0)), whole
  WHERE rank <= blocks GROUP BY skey),
cells AS (
  SELECT skey, ('0x' || substr(spot, 1, 8))::BIGINT % shards AS shard, sum(size)::BIGINT AS words
  FROM sized, whole GROUP BY ALL),
filled AS (
  SELECT skey, shard, count(*) AS quota FROM (
    SELECT skey, shard, of_source, row_number() OVER (PARTITION BY skey ORDER BY words / (2 * a + 1) DESC, shard) AS rank FROM (
      SELECT cells.*, of_source, unnest(range(0, of_source)) AS a FROM cells JOIN dealt USING (skey) WHERE words > 0))
  WHERE rank <= of_source GROUP BY ALL),
takes AS (
  SELECT skey, shard, cells.words, least(coalesce(quota, 0) * block, 3 * cells.words) AS take
  FROM cells LEFT JOIN filled USING (skey, shard), whole),
laid AS (
  SELECT s.*, words, take, coalesce(sum(size) OVER (PARTITION BY s.skey, s.shard ORDER BY spot, doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM (SELECT sized.*, ('0x' || substr(spot, 1, 8))::BIGINT % shards AS shard FROM sized, whole) s JOIN takes USING (skey, shard))
SELECT doc_id, size, source_size, target,
  (CASE WHEN words > 0 THEN take // words ELSE 0 END * size
   + least(greatest(take - CASE WHEN words > 0 THEN take // words ELSE 0 END * words - start, 0), size))::BIGINT AS taken
FROM laid JOIN wanted USING (skey)"""

JACCARD_JOIN = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT row, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])) END AS s FROM docs),
each AS (SELECT row, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.row AS a, b.row AS b FROM each a JOIN each b ON a.x = b.x AND a.row <> b.row
  GROUP BY a.row, b.row, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT row AS a, row AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, (SELECT min(o.doc_id) FROM reach JOIN sets o ON o.row = reach.b WHERE reach.a = sets.row) AS component_id
FROM sets"""

SUFFIX_DEDUP = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM (
    SELECT doc_id, base + j AS i, md5(substr(part, 2 * j + 1, 200)) AS k FROM (
      SELECT doc_id, base, part, unnest(range(least(512, n - 99 - base))) AS j FROM (
        SELECT doc_id, n, base, substr(h, 2 * base + 1, 1222) AS part FROM (
          SELECT doc_id, n, h, unnest(range(0, n - 99, 512)) AS base FROM d WHERE n >= 100))))),
spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM (
      SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 1 ELSE 0 END AS fresh FROM windows WHERE again))
  GROUP BY doc_id, span),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL SELECT doc_id, coalesce(max(b), 0), any_value(n) FROM d LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS h, count(*) - 1 AS n_spans FROM pieces JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, d.n::BIGINT AS n_bytes, (d.n - length(kept.h) // 2)::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id)
"""

ORACLE_SQL = {
    "op9_jaccard_join": JACCARD_JOIN,
    "op2_secret_scan": SECRET_SCAN,
    "op3_warc_fixity": WARC_FIXITY,
    "op4_suffix_dedup": SUFFIX_DEDUP,
    "op5_source_mix": SOURCE_MIX,
    "op8_exact_dedup": EXACT_DEDUP,
}
