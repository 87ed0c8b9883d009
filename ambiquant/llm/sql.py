"""DuckDB SQL for the rows of those queries that SQL can express."""

#: 5-word windows are compared as joined strings here and as hashes in the operator.
QUALITY_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce('=' || source, '') AS host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
h AS (
  SELECT *, list_transform(ls, lambda x: md5(trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '))) AS hs,
         list_transform(ls, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))) AS cs
  FROM w),
g AS (
  SELECT r, i, array_to_string(ws[i:i+4], chr(1)) AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i)),
twice AS (
  SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, unnest(range(0, 5)) AS u(k) GROUP BY r),
base AS (
  SELECT h.r, doc_id, host, hs, cs, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM h LEFT JOIN rep USING (r)),
lines AS (SELECT DISTINCT host, t, unnest(hs) AS x FROM h),
hosts AS (SELECT host, count(DISTINCT t) AS n FROM w GROUP BY host),
hot AS (
  SELECT host, x FROM lines JOIN hosts USING (host) GROUP BY host, x, n
  HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > 0.02::DOUBLE * n),
gone AS (
  SELECT r, count(*) AS n_gone, sum(c) AS words_gone
  FROM (SELECT r, host, unnest(hs) AS x, unnest(cs) AS c FROM h) SEMI JOIN hot USING (host, x) GROUP BY r),
m AS (
  SELECT base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         coalesce(n_gone, 0) AS n_lines_removed, coalesce(words_gone, 0) AS words_removed
  FROM base LEFT JOIN gone USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * (n_words - words_removed) >= 30 * n_words AS kept,
       CAST(len(hs) AS BIGINT) AS n_lines, CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(words_removed AS BIGINT) AS words_removed
FROM m
"""

MIX_SQL = r"""
WITH w0 AS (
  SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
d AS (
  SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS size, CAST(greatest(1, len(ws)) AS DOUBLE) AS n,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS symbols,
         CASE WHEN len(ls) > 0 THEN len(list_distinct(ls)) / CAST(len(ls) AS DOUBLE) ELSE 1.0::DOUBLE END AS fresh,
         greatest(1, length(array_to_string(ws, ''))) / CAST(greatest(1, len(ws)) AS DOUBLE) AS mean,
         md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(t)) AS h
  FROM w0),
k AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(h, 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
           / greatest(0.05::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - symbols / n) * fresh * least(1.0::DOUBLE, mean / 3.0::DOUBLE, 12.0::DOUBLE / mean)) AS key
  FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
w AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
         CAST(source_size * 3 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS budget FROM s),
l AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, cap / weight) FROM l WHERE cap / weight > level)), cap) AS target FROM l),
e AS (
  SELECT *, least(3, CAST(floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS BIGINT)) AS epochs FROM t),
r AS (SELECT *, greatest(0, CAST(round(target - epochs * source_size) AS BIGINT)) AS rest FROM e),
o AS (
  SELECT k.*, source_size, target, epochs, rest,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - prior)) AS BIGINT) AS taken FROM o
"""

CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (
  SELECT *, '<turn:' || replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'), chr(10), '\n') || '>' || chr(10)
              || replace(replace(text, '\', '\b'), '<', '\l') || '</turn>' || chr(10) AS out FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(length(out)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

#: Texts as hex digits, two a byte; removed runs are windows whose starts are at most 50 bytes apart.
SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- windows are cut from pieces, as cutting from long strings is slow
piece AS (SELECT doc_id, o, substr(h, 2 * o + 1, 598) AS h FROM d, unnest(range(0, greatest(0, len(h) // 2 - 49), 250)) AS u(o)),
w AS (SELECT doc_id, o + q AS p, substr(h, 2 * q + 1, 100) AS s FROM piece, unnest(range(0, least(250, greatest(0, len(h) // 2 - 49)))) AS v(q)),
m AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING max(doc_id) > min(doc_id)),
hit AS (SELECT DISTINCT doc_id, p FROM w JOIN m USING (s) WHERE doc_id > first),
g AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true)::INT AS fresh FROM hit),
r AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS rest, max(b) AS last, count(*) AS n_spans, sum(b - a) AS n_removed
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(rest, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: All pairs that share a shingle are counted, and components are walked from every document.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, ws[i:i+4] AS g FROM w, unnest(range(1, len(ws) - 3)) AS u(i) WHERE len(ws) >= 5
  UNION ALL SELECT doc_id, ws FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x AS doc_id, min(y) AS low FROM r GROUP BY x),
k AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, low) AS component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def license_sql(templates: dict[str, str]) -> str:
    """Containment of each template in each window, without bands; the operator's recall is 0.999 by design."""
    text = lambda t: t.replace("'", "''")
    rows = ", ".join(f"('{text(name)}', '{text(t)}')" for name, t in templates.items())
    return rf"""
WITH t0 AS (SELECT name, regexp_extract_all(lower(t), '[a-z0-9]+') AS ws FROM (VALUES {rows}) v(name, t)),
t AS (
  SELECT DISTINCT name, greatest(8, CAST(2 ** ceil(log2(len(ws))) AS INT)) AS span, ws[i:i+4] AS g FROM t0, unnest(range(1, len(ws) - 3)) AS u(i)),
n AS (SELECT name, count(*) AS n FROM t GROUP BY name),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents),
h AS (SELECT r, doc_id, i - 1 AS i, ws[i:i+4] AS g FROM d, unnest(range(1, len(ws) - 3)) AS u(i)),
hit AS (SELECT r, doc_id, name, span, i // span AS block, g FROM h JOIN t USING (g)),
w AS (SELECT * FROM hit UNION ALL SELECT r, doc_id, name, span, block - 1, g FROM hit WHERE block > 0),
c AS (SELECT r, doc_id, name, block, count(DISTINCT g) / CAST(any_value(n) AS DOUBLE) AS share FROM w JOIN n USING (name) GROUP BY r, doc_id, name, block)
SELECT doc_id, name AS license, max(share) AS containment, count(*) AS n_windows FROM c WHERE share >= 0.75 GROUP BY r, doc_id, name
"""

WINDOWS_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, doc_id, i, ws[i] AS w FROM d, unnest(range(1, len(ws) + 1)) AS u(i)),
g AS (
  SELECT r, doc_id, i, w, CASE WHEN doc_id IS NOT NULL AND count(*) OVER s = 20 THEN string_agg(w, ' ') OVER s END AS g
  FROM w WINDOW s AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
later AS (SELECT r, i, w, g IS NOT NULL AND rank() OVER (PARTITION BY g ORDER BY doc_id, i) > 1 AS gone FROM g),
kept AS (SELECT r, i, w, bool_or(gone) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM later),
n AS (SELECT r, count_if(gone) AS n_removed, string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM kept GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r)
"""

#: A run of period q repeats its words at distance q over half of its length, so over 6 words or more.
RUNS_SQL = r"""
WITH h0 AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
         list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))) AS bytes
  FROM documents),
h1 AS (
  SELECT r, doc_id, ws, CAST(len(ws) AS BIGINT) AS n,
         xor(4294967295, list_reduce(bytes, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
           lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) AS h
  FROM h0),
h2 AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h1),
d AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM h2),
w AS (SELECT r, i, ws[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS w FROM d, unnest(range(n)) AS u(i)),
g AS (
  SELECT r, i, CASE WHEN count(*) OVER s = 6 THEN string_agg(w, ' ') OVER s END AS g
  FROM w WINDOW s AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
pairs AS (SELECT x.r, x.i, y.i - x.i AS q FROM g AS x JOIN g AS y ON x.r = y.r AND x.g = y.g AND x.i < y.i),
islands AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM pairs),
stretches AS (SELECT r, q, min(i) AS s, count(*) + 5 + q AS n FROM islands GROUP BY r, q, k HAVING count(*) + 5 + q >= greatest(12, 2 * q)),
runs AS (SELECT r, s, n, min(q) AS q FROM stretches GROUP BY r, s, n),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY r),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n DESC, s, q) AS k FROM runs) WHERE k = 1),
gone AS (SELECT DISTINCT r, i FROM runs, unnest(range(s + q, s + n)) AS u(i)),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, d.n AS n_words, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.n AS BIGINT) AS length,
       CAST(best.q AS BIGINT) AS period, CAST(1000 * best.n // best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""
