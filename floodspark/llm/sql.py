"""DuckDB SQL that the queries must agree with, written from the contracts."""

SQL: dict[str, str] = {}

SQL["op2_quality_rules"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
wins AS (
  SELECT rid, p, list_slice(w, p, p + 7) AS win
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS p FROM d)),
twice AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1),
rep AS (
  SELECT rid, count(DISTINCT p + o) AS n_repeat_words FROM twice, range(0, 8) AS r(o) GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, len(w) AS n_words, length(t) - length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
         length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
         len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_stutters
  FROM d LEFT JOIN rep USING (rid) LEFT JOIN lines USING (rid)),
b AS (
  SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
            + 4 * (10 * n_symbols > 2 * n_words)::BIGINT + 8 * (10 * n_upper > 4 * n_letters)::BIGINT
            + 16 * (n_lines > 3 AND 10 * n_dup_lines > 3 * n_lines)::BIGINT
            + 32 * (word_chars > 15 * n_words OR word_chars < 2 * n_words)::BIGINT
            + 64 * (10 * n_stutters > 3 * n_words)::BIGINT AS failed_bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       failed_bits % 4 > 0 AS base_failed, failed_bits = 0 AS kept, failed_bits
FROM b"""

SQL["op1_secret_scans"] = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
kinds(k, kind, p) AS (VALUES
  (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'),
  (3, 'entropy_hex', '[0-9A-Fa-f]{20,}'), (4, 'entropy_base64', '[A-Za-z0-9+/_=-]{20,}')),
raw AS (
  SELECT rid, k, kind, p, unnest(m) AS x, unnest(list_slice(g, 1, len(m))) AS gap, unnest(range(len(m))) AS i
  FROM (SELECT rid, k, kind, p, regexp_extract_all(t, p) AS m, string_split_regex(t, p) AS g FROM d, kinds)),
spot AS (
  SELECT rid, k, kind, p, x, i, (sum(length(gap) + length(x)) OVER (PARTITION BY rid, k ORDER BY i))::BIGINT AS e
  FROM raw),
span AS (SELECT rid, k, kind, p, x, e - length(x) AS s, e FROM spot),
base AS (
  SELECT rid, k, kind, s, e FROM span
  WHERE (k = 0 AND length(regexp_extract(x, p, 2)) >= 6) OR (k = 1 AND length(x) >= 20) OR (k = 2 AND length(x) >= 24)),
runs AS (
  SELECT r.* FROM span r
  WHERE k > 2 AND regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')
    AND NOT regexp_matches(x, '(?i)example|sample|dummy|placeholder|changeme|xxxx|1234567|abcdefg')
    AND NOT regexp_matches(x, '^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$')
    AND NOT regexp_matches(x, '^[a-z0-9]+([-_/][a-z0-9]+)+$')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.s <= r.s AND r.e <= b.e)),
wins AS (SELECT rid, k, kind, s, x, unnest(range(length(x) - 19)) AS w0 FROM runs),
chars AS (SELECT rid, k, kind, s, w0, substr(x, w0 + o + 1, 1) AS c FROM wins, range(20) AS r(o)),
ent AS (
  SELECT rid, k, kind, s, w0, log2(20) - sum(n * log2(n)) / 20 AS h
  FROM (SELECT rid, k, kind, s, w0, c, count(*) AS n FROM chars GROUP BY ALL) GROUP BY ALL),
added AS (
  SELECT rid, k, kind, s + min(w0) AS s, s + max(w0) + 20 AS e FROM ent
  WHERE h >= CASE k WHEN 3 THEN 3.0 ELSE 3.7 END - 1e-9 GROUP BY rid, k, kind, ent.s),
every AS (SELECT * FROM base UNION ALL SELECT * FROM added),
per AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (k < 3), '') AS b,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans
  FROM every GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (rid)"""

# every window that shares a shingle with an item of its length
SQL["op6_benchmark_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM documents),
bw AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w FROM benchmark),
b AS (SELECT item_id, w, len(w) AS size, least(len(w), 5) AS k, len(w) - least(len(w), 5) + 1 AS m FROM bw WHERE len(w) > 0),
bs AS (SELECT item_id, size, k, m, list_slice(w, i, i + k - 1) AS s FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM b)),
ds AS (SELECT rid, n, k, p, list_slice(w, p + 1, p + k) AS s FROM (
         SELECT rid, len(w) AS n, w, k, unnest(range(len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM b) WHERE len(w) >= k)),
hits AS (SELECT rid, item_id, n, size, k, m, p, s FROM ds JOIN (SELECT DISTINCT item_id, size, k, m, s FROM bs) USING (k, s)),
wins AS (SELECT DISTINCT rid, item_id, n, size, k, m, unnest(range(greatest(p - m + 1, 0), least(p, greatest(n - size, 0)) + 1)) AS start FROM hits),
ws AS (SELECT w.rid, w.item_id, w.start, w.n, w.size, w.k, w.m, h.s, count(*) AS c FROM wins w JOIN hits h
       ON h.rid = w.rid AND h.item_id = w.item_id AND h.p >= w.start AND h.p < w.start + w.m GROUP BY ALL),
it AS (SELECT item_id, s, count(*) AS c FROM bs GROUP BY ALL),
sh AS (SELECT rid, ws.item_id, start, n, size, k, m, sum(least(ws.c, it.c)) AS shared FROM ws JOIN it USING (item_id, s) GROUP BY ALL),
sim AS (SELECT *, shared / (m + least(m, n - k + 1) - shared) AS similarity FROM sh)
SELECT doc_id, item_id, start::BIGINT AS start, size::BIGINT AS n_words, round(similarity, 9) AS similarity
FROM sim JOIN d USING (rid) WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY rid, item_id ORDER BY similarity DESC, start) = 1"""

SQL["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS x FROM documents),
h AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2,
         ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

SQL["op13_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)"""
