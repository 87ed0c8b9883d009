"""DuckDB SQL for the results of the queries in proxy."""

import math
from itertools import accumulate

A = """a AS (
  SELECT l_orderkey AS read, p_brand AS transcript, p_type AS gene, l_partkey, l_suppkey, l_linenumber, l_extendedprice, CAST(l_quantity AS INT) AS isize,
         CAST(round(l_discount * 100) AS INT) AS nm, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey % 1000 AS ordinal
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
R = A + ", r AS (SELECT read, list_sort(list(DISTINCT transcript)) AS ts FROM a GROUP BY read)"
C = R + ", c AS (SELECT ts, count(*) AS k FROM r GROUP BY ts), i AS (SELECT ts, unnest(ts) AS transcript, k, len(ts) AS size FROM c)"
L = C + ", l AS (SELECT p_brand AS transcript, round(avg(p_retailprice)) / 1000 AS l FROM part GROUP BY 1), m0 AS (SELECT transcript, any_value(l) AS l, sum(k / size) / any_value(l) AS mu FROM i JOIN l USING (transcript) GROUP BY 1)"
STRATUM = "s1 AS (SELECT * FROM a QUALIFY nm = min(nm) OVER (PARTITION BY read))"
ONE = "{0} AS (SELECT * FROM {1} QUALIFY row_number() OVER (PARTITION BY read, transcript ORDER BY abs(isize - 25), ordinal) = 1)"
NEAR = "{0} AS (SELECT * FROM {1} QUALIFY min(abs(isize - 25)) OVER (PARTITION BY read) > 20 OR abs(isize - 25) <= 20)"
COLS = "read, transcript, isize, nm, ordinal"
Z = """z AS (SELECT l_orderkey AS read, min(CAST(l_quantity AS INT)) AS isize FROM lineitem WHERE CAST(l_quantity AS INT) > 0 GROUP BY 1
  HAVING min(CAST(l_quantity AS INT)) = max(CAST(l_quantity AS INT)))"""
T = """e AS (SELECT user_id AS feature, user_id % 10 AS gene, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS iter, abs(value) + 0.5 AS value FROM events),
t AS (SELECT feature, gene, iter, value FROM e)"""
X = A + """, x AS (SELECT transcript AS feature, o_orderpriority AS sample, round(ln(sum(l_extendedprice)), 6) AS y,
  round(stddev_samp(l_extendedprice) / avg(l_extendedprice) / 10, 6) AS e, count(*) FILTER (nm = 0) AS uh FROM a JOIN orders ON read = o_orderkey GROUP BY 1, 2)"""


def em(steps: int) -> str:
    out = "WITH " + L
    for n in range(1, steps + 1):
        out += f""", r{n} AS (SELECT ts, sum(mu) AS rate FROM i JOIN m{n - 1} USING (transcript) GROUP BY 1),
m{n} AS (SELECT transcript, any_value(l) AS l, sum(mu * k / rate) / any_value(l) AS mu FROM i JOIN m{n - 1} USING (transcript) JOIN r{n} USING (ts) GROUP BY 1)"""
    return out


#: Whole numbers up to the last divisions, as in the operator.
PAIRS = """f AS (SELECT l_partkey AS feature, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) - 1 AS iter, CAST(l_quantity AS BIGINT) AS v FROM lineitem),
u AS (SELECT feature, iter, v, {0} AS sample FROM f),
h AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS f FROM lineitem), pr AS (SELECT DISTINCT x.f AS a, y.f AS b FROM h x JOIN h y ON x.r = y.r AND x.f < y.f),
sm AS (SELECT x.sample, a, b, count(*) AS n, sum(x.v) AS sx, sum(y.v) AS sy, sum(x.v * y.v) AS sxy, sum(x.v * x.v) AS sxx, sum(y.v * y.v) AS syy
  FROM pr JOIN u x ON x.feature = a JOIN u y ON y.feature = b AND y.sample = x.sample AND y.iter = x.iter GROUP BY 1, 2, 3),
met AS (SELECT DISTINCT x.sample, a, b FROM pr JOIN (SELECT DISTINCT sample, feature FROM u) x ON x.feature = a JOIN (SELECT DISTINCT sample, feature FROM u) y ON y.feature = b AND y.sample = x.sample),
tp AS (SELECT met.*, n, CAST(n * sxy - sx * sy AS DOUBLE) AS top, CAST(n * sxx - sx * sx AS DOUBLE) AS tx, CAST(n * syy - sy * sy AS DOUBLE) AS ty FROM met LEFT JOIN sm USING (sample, a, b)),
p AS (SELECT sample, a, b, CASE WHEN n > 1 THEN top / CAST(n * (n - 1) AS DOUBLE) END AS cov, CASE WHEN n > 1 AND tx * ty > 0 THEN top / sqrt(tx * ty) END AS corr FROM tp)"""
MEAN = "WITH " + PAIRS.format("CASE WHEN iter % 2 = 0 THEN 'a' ELSE 'b' END") + """,
mc AS (SELECT a, b, avg(coalesce(corr, 0)) AS corr, coalesce(stddev_samp(coalesce(corr, 0)), 0) AS sd, count(*) AS n FROM p GROUP BY 1, 2)"""
DEV = X + ", ok AS (SELECT feature FROM x GROUP BY 1 HAVING avg((uh > 0)::INT) >= {0}), dv AS (SELECT x.*, y - avg(y) OVER (PARTITION BY feature) AS d FROM x SEMI JOIN ok USING (feature))"

#: Prefix sums of Phi((f + 0.5 - 180) / 25) for f = 1.. up to where it is 1 in doubles; beyond, each f adds 1.
_A0 = 0.5 * math.erfc(-((0.5 - 180) / 25) / math.sqrt(2))
_SUMS = list(accumulate(0.5 * math.erfc(-((f + 0.5 - 180) / 25) / math.sqrt(2)) for f in range(1, 421)))
PHI = "phi AS (SELECT * FROM (VALUES " + ", ".join(f"({f}, {x!r}::DOUBLE)" for f, x in enumerate(_SUMS, 1)) + ") v(f, s))"
SETS = """p AS (SELECT p_brand AS set_id, p_partkey, p_retailprice / 1000 AS l, p_size, substr(p_brand, 8, 1) <> '1' AS seen FROM part),
g AS (SELECT set_id, sum(seen::INT) AS observed, count(*) AS n, avg(p_size) / 10 AS lm, sum(l * exp(p_size / 20.0::DOUBLE)) / sum(exp(p_size / 20.0::DOUBLE)) AS wl,
  arg_min(l, CAST(p_partkey AS VARCHAR)) AS fl, arg_min(p_size * 10, CAST(p_partkey AS VARCHAR)) AS tl FROM p GROUP BY 1)"""

SQL = {
    "positional_length": """WITH c AS (SELECT row_number() OVER () AS r, conv_id, turn, translate(coalesce(text, ''), 'eariotnslcudpmhg', 'ACGTACGTACGTACGT') AS s FROM conversations),
        p AS (SELECT r, length(s) AS n, i, strpos('ACGT', substr(s, i + 1, 1)) - 1 AS b FROM c, unnest(range(length(s))) AS u(i)),
        w AS (SELECT r, i - k AS w, sum(CASE WHEN b >= 0 THEN ((7 * k + 3 * b) % 11 - 5) / 100.0::DOUBLE ELSE 0 END) AS t FROM p, unnest(range(41)) AS v(k) WHERE i - k BETWEEN 1 AND n - 41 GROUP BY 1, 2),
        e AS (SELECT r, sum(exp(t + 0.1::DOUBLE)) AS e FROM w GROUP BY 1)
        SELECT conv_id, turn, round(CASE WHEN length(s) < 41 THEN length(s) ELSE greatest(0.1::DOUBLE, 40 + coalesce(e, 0) - 4) END, 4) AS effective_length FROM c LEFT JOIN e USING (r)""",
    "eff_length": f"""WITH {PHI} SELECT doc_id, CAST(n_chars AS INT) AS true_length,
        round(greatest(0.1::DOUBLE, coalesce((SELECT s FROM phi WHERE f = least(n_chars, 420)), 0) + greatest(0, n_chars - 420) - n_chars * {_A0!r}::DOUBLE), 6) AS effective_length FROM documents""",
    "permuted_samples": f"""WITH {X}, n1 AS (SELECT feature, sample, uh, row_number() OVER (PARTITION BY feature ORDER BY sample) AS i FROM x),
        n2 AS (SELECT feature, y, e, row_number() OVER (PARTITION BY feature ORDER BY md5('7|' || feature || '|' || sample), sample) AS i FROM x) SELECT feature, sample, uh, y, e FROM n1 JOIN n2 USING (feature, i)""",
    "overlap_dedupe": """WITH RECURSIVE v AS (SELECT p_brand AS chrom, CAST(p_partkey AS INT) AS pos, p_size AS n, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part),
        w AS (SELECT chrom, pos, i, true AS keep, pos + n - 1 AS last FROM v WHERE i = 1
          UNION ALL SELECT v.chrom, v.pos, v.i, v.pos > w.last, CASE WHEN v.pos > w.last THEN v.pos + v.n - 1 ELSE w.last END FROM w JOIN v ON v.chrom = w.chrom AND v.i = w.i + 1)
        SELECT chrom, pos FROM w WHERE keep""",
    "coverage_ranking": """WITH n AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1),
        c AS (SELECT p_partkey, p_brand AS gene, coalesce(n, 0) / CAST(p_size + 10 AS DOUBLE) AS coverage FROM part LEFT JOIN n ON l_partkey = p_partkey),
        b AS (SELECT coalesce((SELECT coverage FROM c ORDER BY coverage DESC LIMIT 1 OFFSET 50), 0) AS bound)
        SELECT CAST(min(p_partkey) AS VARCHAR) AS transcript, gene, round(arg_min(coverage, p_partkey), 8) AS coverage FROM c, b WHERE coverage >= bound GROUP BY gene""",
    "common_set": f"""WITH {X}, n AS (SELECT regexp_replace(p_brand, '1$', 'x') AS name, row_number() OVER (ORDER BY p_brand) AS ordinal FROM (SELECT DISTINCT p_brand FROM part))
        SELECT CAST(ordinal AS INT) AS ordinal, name AS feature, uh FROM n LEFT JOIN (SELECT feature, uh FROM x WHERE sample LIKE '1%') ON name = feature""",
    "bound_factors": f"""WITH {X}, w AS (SELECT feature, max(e * 10) FILTER (sample LIKE '1%') AS b1, max(e * 10) FILTER (sample LIKE '2%') AS b2, max(e * 10) FILTER (sample LIKE '3%') AS b3 FROM x GROUP BY 1),
        z AS (SELECT *, 0.4::DOUBLE + 0.2::DOUBLE * b1 + 0.2::DOUBLE * b2 + 0.2::DOUBLE * b3 AS t FROM w WHERE b1 + b2 + b3 IS NOT NULL)
        SELECT feature, round(0.4::DOUBLE / t, 8) AS p0, round(0.2::DOUBLE * b1 / t, 8) AS p1, round(0.2::DOUBLE * b2 / t, 8) AS p2, round(0.2::DOUBLE * b3 / t, 8) AS p3 FROM z""",
    "duplicate_rows": """WITH r AS (SELECT CAST(o_orderkey AS VARCHAR) AS t, list_sort([o_custkey || ':' || o_orderpriority, o_custkey || ':' || year(o_orderdate)]) AS cs FROM orders),
        m AS (SELECT t, unnest(cs) AS c FROM r), k AS (SELECT c, string_agg(t, ',' ORDER BY t) AS members FROM m GROUP BY 1),
        f AS (SELECT t, list_sort(list(DISTINCT members)) AS cs FROM m JOIN k USING (c) GROUP BY 1),
        g AS (SELECT cs, min(t) AS first FROM f GROUP BY 1) SELECT first, t AS transcript FROM f JOIN g USING (cs) WHERE t > first""",
    "gene_table": f"""WITH {SETS} SELECT set_id AS feature_id, round(lm, 8) AS log_mu, 0.5::DOUBLE AS sd, round(CASE WHEN observed = 0 THEN 0.5::DOUBLE / 32 ELSE 0.01 END, 8) AS mcse,
        CASE WHEN observed = 0 THEN 1.0::DOUBLE ELSE 1.5 END AS iact, round(wl, 8) AS effective_length, CAST(NULL AS INT) AS true_length, n AS unique_hits, CAST(observed AS BIGINT) AS observed, n AS ntranscripts, 1.0::DOUBLE AS p FROM g""",
    "identical_table": f"""WITH {SETS} SELECT set_id AS feature_id, round(CASE WHEN observed = 0 THEN ln(n) - 10.423754940411076::DOUBLE - ln(0.1::DOUBLE + fl * 0.001::DOUBLE) ELSE lm END, 8) AS log_mu,
        round(CASE WHEN observed = 0 THEN sqrt(101.43329915079276::DOUBLE) ELSE 0.5 END, 8) AS sd, CASE WHEN observed = 0 THEN 0.0::DOUBLE ELSE 0.01 END AS mcse,
        CASE WHEN observed > 0 THEN 1.5::DOUBLE END AS iact, round(fl, 8) AS effective_length, tl AS true_length, n AS unique_hits, CAST(observed AS BIGINT) AS observed, n AS ntranscripts,
        CASE WHEN observed > 0 THEN 1.0::DOUBLE END AS p FROM g""",
    "read_sets": f"WITH {R} SELECT read, array_to_string(ts, ',') AS transcripts FROM r",
    "eq_classes": f"WITH {C} SELECT array_to_string(ts, ',') AS members, k FROM c",
    "class_size_hist": f"WITH {C} SELECT CAST(len(ts) AS INT) AS size, CAST(sum(k) AS BIGINT) AS reads, count(*) AS classes FROM c GROUP BY 1",
    "flag_filter": f"WITH {A} SELECT transcript, count(*) AS n FROM a WHERE (l_linenumber * 3) & 12 = 0 GROUP BY 1",
    "best_stratum": f"WITH {A}, {STRATUM} SELECT {COLS} FROM s1",
    "repetitive_filter": f"WITH {A}, {ONE.format('s2', 'a')} SELECT {COLS} FROM s2",
    "deviation_filter": f"WITH {A}, {NEAR.format('s3', 'a')} SELECT {COLS} FROM s3",
    "filter_pipeline": f"WITH {A}, {STRATUM}, {ONE.format('s2', 's1')}, {NEAR.format('s3', 's2')} SELECT read, array_to_string(list_sort(list(DISTINCT transcript)), ',') AS transcripts FROM s3 GROUP BY 1",
    "stage_counts": f"""WITH {A}, {STRATUM}, {ONE.format('s2', 's1')}, {NEAR.format('s3', 's2')}
        SELECT 'input' AS stage, count(*) AS n FROM a UNION ALL SELECT 'stratum', count(*) FROM s1 UNION ALL SELECT 'feature', count(*) FROM s2 UNION ALL SELECT 'deviation', count(*) FROM s3""",
    "mate_pairing": f"""WITH {A}, n AS (SELECT read, transcript, l_suppkey % 7 AS pos, l_partkey % 7 AS mpos, nm, isize,
          row_number() OVER (PARTITION BY read, transcript, l_suppkey % 7, l_partkey % 7 ORDER BY ordinal) AS i FROM a),
        x AS (SELECT f.read, f.transcript, f.pos, f.mpos, f.nm, f.isize, r.nm AS nm2, r.isize AS isize2 FROM (SELECT * FROM n WHERE pos < mpos) f
          LEFT JOIN n r ON r.read = f.read AND r.transcript = f.transcript AND r.pos = f.mpos AND r.mpos = f.pos AND r.i = f.i
        UNION ALL SELECT f.read, f.transcript, f.pos, f.mpos, f.nm, f.isize, NULL, NULL FROM n f WHERE pos > mpos
          AND NOT EXISTS (SELECT 1 FROM n r WHERE r.read = f.read AND r.transcript = f.transcript AND r.pos = f.mpos AND r.mpos = f.pos AND r.i = f.i)
        UNION ALL SELECT f.read, f.transcript, f.pos, f.mpos, f.nm, f.isize, r.nm, r.isize FROM (SELECT * FROM n WHERE pos = mpos AND i % 2 = 1) f
          LEFT JOIN n r ON r.read = f.read AND r.transcript = f.transcript AND r.pos = f.pos AND r.mpos = f.mpos AND r.i = f.i + 1)
        SELECT read, transcript, least(pos, mpos) AS "left", greatest(pos, mpos) AS "right", CAST(nm + coalesce(nm2, 0) AS BIGINT) AS nm,
          greatest(isize, isize2) AS isize, CAST(1 + (nm2 IS NOT NULL)::INT AS BIGINT) AS n_mates FROM x""",
    "isize_sample": f"WITH {Z} SELECT read, isize FROM z",
    "isize_model": f"""WITH {Z}, k AS (SELECT isize, count(*) AS n FROM z GROUP BY 1), u AS (SELECT *, sum(n) OVER (ORDER BY isize) AS upto, sum(n) OVER () AS total FROM k),
        b AS (SELECT min(isize) FILTER (upto > floor(total * 0.975)) AS hi, min(isize) AS lo FROM u), g AS (SELECT unnest(range(lo, hi + 1)) AS isize, lo, hi FROM b),
        f AS (SELECT g.isize, lo, hi, coalesce(n, 0) AS n FROM g LEFT JOIN k USING (isize)),
        s AS (SELECT *, sum(n) OVER (ORDER BY isize ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM f),
        o AS (SELECT * FROM s WHERE isize > lo AND isize <= hi - 2 ORDER BY s DESC, isize LIMIT 1)
        SELECT CAST(isize AS INT) AS mode, CAST(hi - isize AS INT) AS threshold, CAST(floor((hi - isize) / 1.96) AS INT) AS sd FROM o""",
    "isize_histogram": f"""WITH {Z}, h AS (SELECT CAST(floor(isize / 5.0) * 5 AS INT) AS bin, count(*) AS n FROM z GROUP BY 1)
        SELECT bin, n, repeat('*', CAST(floor(n * 40 / max(n) OVER ()) AS INT)) AS bar FROM h""",
    "duplicate_hits": f"WITH {A}, k AS (SELECT read, transcript, count(*) - 1 AS d FROM a GROUP BY 1, 2) SELECT transcript, CAST(sum(d) AS BIGINT) AS n FROM k GROUP BY 1",
    "shared_counts": f"WITH {C} SELECT transcript, CAST(least(size, 100) - 1 AS INT) AS bin, CAST(sum(k) AS BIGINT) AS k FROM i GROUP BY 1, 2",
    "unique_hits_feature": f"WITH {C} SELECT transcript, CAST(sum(CASE WHEN size = 1 THEN k ELSE 0 END) AS BIGINT) AS unique_hits FROM i GROUP BY 1",
    "unique_hits_set": f"""WITH {C}, s AS (SELECT DISTINCT substr(p_brand, 1, 7) AS set_id, p_brand AS transcript FROM part),
        m AS (SELECT set_id, ts, count(*) AS n, max(size) AS size, max(k) AS k FROM i JOIN s USING (transcript) GROUP BY 1, 2),
        g AS (SELECT set_id, sum(k) AS k FROM m WHERE n = size GROUP BY 1)
        SELECT d.set_id, CAST(coalesce(k, 0) AS BIGINT) AS k FROM (SELECT DISTINCT set_id FROM s) d LEFT JOIN g USING (set_id)""",
    "identical_sets": "SELECT array_to_string(list_sort(list(CAST(doc_id AS VARCHAR))), ',') AS members FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "gene_isoforms": "SELECT p_type AS gene, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS transcripts FROM part GROUP BY 1",
    "regroup_to_gene": f"WITH {A} SELECT read, array_to_string(list_sort(list(DISTINCT substr(transcript, 1, 7))), ',') AS genes FROM a GROUP BY 1",
    "init_mu": f"WITH {L} SELECT transcript, round(mu, 6) AS mu FROM m0",
    "em_fixed3": em(3) + " SELECT transcript, round(mu, 6) AS mu FROM m3",
    "em_converged": f"""WITH RECURSIVE {L}, x AS MATERIALIZED (SELECT array_to_string(ts, ',') AS c, transcript, k FROM i JOIN m0 USING (transcript)),
        q0 AS (SELECT c, sum(mu) AS rate, any_value(k) AS k FROM x JOIN m0 USING (transcript) GROUP BY 1),
        e AS (SELECT 0 AS it, transcript, l, mu, (SELECT sum(k * ln(rate)) FROM q0) - (SELECT sum(mu * l) FROM m0) AS ll, 1e9::DOUBLE AS gain FROM m0
          UNION ALL (
          WITH r AS (SELECT c, sum(mu) AS rate FROM x JOIN e USING (transcript) GROUP BY 1),
          n AS (SELECT transcript, any_value(l) AS l, sum(mu * k / rate) / any_value(l) AS mu FROM x JOIN e USING (transcript) JOIN r USING (c) GROUP BY 1),
          q AS (SELECT c, sum(mu) AS rate, any_value(k) AS k FROM x JOIN n USING (transcript) GROUP BY 1),
          g AS (SELECT (SELECT sum(k * ln(rate)) FROM q) - (SELECT sum(mu * l) FROM n) AS ll),
          o AS (SELECT any_value(it) AS it, any_value(ll) AS ll, any_value(gain) AS gain FROM e)
          SELECT o.it + 1, n.transcript, n.l, n.mu, g.ll, g.ll - o.ll FROM n, g, o WHERE o.gain > 0.1))
        SELECT transcript, round(mu, 4) AS mu FROM e WHERE it = (SELECT max(it) FROM e)""",
    "em_loglik": f"""WITH {L}, q AS (SELECT ts, sum(mu) AS rate, any_value(k) AS k FROM i JOIN m0 USING (transcript) GROUP BY 1)
        SELECT round((SELECT sum(k * ln(rate)) FROM q) - (SELECT sum(mu * l) FROM m0), 3) AS loglik""",
    "unseen_features": """SELECT CAST(p_partkey AS VARCHAR) AS transcript FROM part
        WHERE p_partkey NOT IN (SELECT min(l_partkey) FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) = 1)""",
    "semi_filter": "SELECT o_custkey, o_orderkey FROM orders SEMI JOIN (SELECT c_custkey AS o_custkey FROM customer WHERE c_acctbal > 5000) USING (o_custkey)",
    "anti_filter": "SELECT c_custkey, c_nationkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "prior_for_unseen": """WITH o AS (SELECT min(l_partkey) AS k FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) = 1), s AS (SELECT k, count(*) AS n FROM o GROUP BY 1)
        SELECT CAST(p_partkey AS VARCHAR) AS feature, CAST(n IS NOT NULL AS INT) AS observed, round(coalesce(ln(n), -10.423754940411076 - ln(0.1 + p_retailprice / 1000 * 0.001)), 6) AS log_mu,
          round(coalesce(1 / sqrt(n), sqrt(101.43329915079276)), 6) AS sd, round(CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE 0.01 END, 6) AS mcse, 1.0::DOUBLE AS iact FROM part LEFT JOIN s ON k = p_partkey""",
    "trace_proportions": f"WITH {T} SELECT feature, gene, CAST(iter AS INT) AS iter, round(value / sum(value) OVER (PARTITION BY gene, iter), 8) AS value FROM t",
    "quantile_nearest": f"""WITH {T}, s AS (SELECT feature, list_sort(list(value)) AS v FROM t GROUP BY 1)
        SELECT feature, {', '.join(f'v[1 + CAST(floor({p} / 100.0 * (len(v) - 1) + 0.5) AS INT)] AS p{p}' for p in (5, 50, 95))} FROM s""",
    "log_mean": f"WITH {T} SELECT feature, round(avg(ln(value)), 8) AS log_mu, round(stddev_samp(ln(value)), 8) AS sd FROM t GROUP BY 1",
    "sokal_iact": f"""WITH {T}, d AS (SELECT feature, iter, count(*) OVER (PARTITION BY feature) AS n, value - avg(value) OVER (PARTITION BY feature) AS v FROM t),
        ac AS (SELECT x.feature, x.n, (y.iter - x.iter + x.n) % x.n AS lag, sum(x.v * y.v) AS c FROM d x JOIN d y ON x.feature = y.feature GROUP BY 1, 2, 3),
        rho AS (SELECT feature, n, lag, c, c / first_value(c) OVER (PARTITION BY feature ORDER BY lag) AS rho FROM ac),
        run AS (SELECT *, -1 / 3.0::DOUBLE + sum(rho - 1 / 6.0::DOUBLE) OVER (PARTITION BY feature ORDER BY lag) AS s FROM rho),
        st AS (SELECT feature, n, min(lag) FILTER (s < 0 AND lag < n - 1) AS i FROM run GROUP BY 1, 2)
        SELECT feature, round((SELECT c / (n - 1) FROM run r WHERE r.feature = st.feature AND lag = 0), 4) AS var,
          round(2 * ((SELECT s FROM run r WHERE r.feature = st.feature AND lag = coalesce(i, st.n - 2)) + (coalesce(i + 1, n) - 1) / 6.0::DOUBLE), 6) AS tau, CAST(coalesce(i + 1, n) AS INT) AS m FROM st""",
    "set_traces": f"WITH {T} SELECT gene AS set_id, CAST(iter AS INT) AS iter, round(sum(value), 6) AS value FROM t GROUP BY 1, 2",
    "weighted_length": """WITH q AS (SELECT p_type AS gene, p_brand, avg(p_retailprice) AS l, exp(count(*) / 10.0::DOUBLE) AS w FROM part GROUP BY 1, 2)
        SELECT gene, round(sum(l * w) / sum(w), 4) AS effective_length FROM q GROUP BY 1""",
    "normalise_upper_median": f"""WITH {DEV.format('0.2')}, md AS (SELECT sample, CASE WHEN count(*) >= 10 THEN list_sort(list(d))[1 + count(*) // 2] ELSE 0 END AS s FROM dv GROUP BY 1)
        SELECT feature, sample, round(y - s, 8) AS y FROM x JOIN md USING (sample)""",
    "normalise_median": f"WITH {DEV.format('1.0')}, md AS (SELECT sample, median(d) AS s FROM dv GROUP BY 1) SELECT feature, sample, round(y - coalesce(s, 0), 8) AS y FROM x LEFT JOIN md USING (sample)",
    "est_counts": f"WITH {X} SELECT feature, sample, round(exp(y - 10) * 5000000 * 1000 / 1e9, 4) AS count FROM x",
    "pair_corr": "WITH " + PAIRS.format("'a'") + " SELECT sample, a, b, cov, corr FROM p",
    "mean_corr": MEAN + " SELECT a, b, round(corr, 9) AS corr, round(sd, 9) AS sd, n FROM mc",
    "corr_threshold": MEAN + """, w AS (SELECT a, corr FROM mc UNION ALL SELECT b, corr FROM mc), t AS (SELECT list_sort(list(m)) AS ms FROM (SELECT max(corr) AS m FROM w GROUP BY a))
        SELECT round(-ms[1 + least(CAST(floor(len(ms) * 10 / 100.0) AS INT), len(ms) - 1)], 9) AS threshold FROM t""",
    "candidate_sets": f"""WITH {X}, k AS (SELECT feature, substr(sample, 1, 1) AS p, e AS sd, uh % 3 AS u, feature LIKE '%1' AS st, uh % 5 <> 0 AS ob FROM x WHERE substr(sample, 1, 1) IN ('1', '2')),
        b AS (SELECT p, max(sd) FILTER (u = 1 AND NOT st) AS b FROM k GROUP BY 1),
        c AS (SELECT DISTINCT feature FROM k JOIN b USING (p) WHERE (st OR u = 0) AND (b IS NULL OR NOT ob OR sd >= b)),
        z AS (SELECT feature FROM k WHERE NOT ob AND p = '1' INTERSECT SELECT feature FROM k WHERE NOT ob AND p = '2') SELECT feature FROM c EXCEPT SELECT feature FROM z""",
    "bayes_posterior": f"""WITH {X}, g AS (SELECT feature, sample, (uh + 1) / (uh + 400.0::DOUBLE) AS g FROM x), b AS (SELECT *, g / (1 - g) AS bf FROM g)
        SELECT feature, sample, round(bf, 8) AS bf, round(1 / (1 + exp(-(ln(bf) + ln(0.1::DOUBLE) - ln(0.9::DOUBLE)))), 8) AS pp FROM b""",
    "polyclass": f"""WITH {X}, l AS (SELECT feature, list(e * 10 ORDER BY sample) AS b FROM x GROUP BY 1), w AS (SELECT feature, 0.5 + 0.1 * list_sum(b) AS t, b FROM l)
        SELECT feature, round(0.5 / t, 8) AS p0, {', '.join(f'round(0.1 * b[{i}] / t, 8) AS p{i}' for i in range(1, 6))} FROM w""",
    "expressed_calls": f"WITH {X}, m AS (SELECT min(y) AS low FROM x WHERE uh % 4 >= 3) SELECT feature AS gene, bool_or(coalesce(y > low, false)) AS expressed FROM x, m GROUP BY 1",
    "feature_range": f"WITH {X} SELECT feature, sample, uh FROM x QUALIFY dense_rank() OVER (ORDER BY feature) BETWEEN 4 AND 10",
    "split_by_suffix": f"WITH {X} SELECT regexp_replace(feature, '[12]$', '') AS feature, sample || '.' || right(feature, 1) AS sample, uh FROM x WHERE right(feature, 1) IN ('1', '2')",
    "asof_offset": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS chrom, epoch_us(ts) AS pos, event_type AS k, event_id % 7 - 3 AS delta FROM events)
        SELECT DISTINCT p.chrom, p.pos, CAST(coalesce((SELECT sum(delta) FROM e q WHERE q.k = 'click' AND q.chrom = p.chrom AND q.pos < p.pos), 0) AS BIGINT) AS "offset" FROM e p WHERE p.k = 'purchase'""",
    "interval_join": """WITH p AS (SELECT DISTINCT l_suppkey % 50 AS k, CAST(l_partkey * 3 AS INT) AS pos FROM lineitem),
        i AS (SELECT p_partkey % 50 AS k, CAST(p_partkey * 2 AS INT) AS s, CAST(p_partkey * 2 + p_size AS INT) AS e FROM part) SELECT k, pos, s AS "start", e AS "end" FROM p JOIN i USING (k) WHERE pos BETWEEN s AND e""",
    "exon_offsets": """SELECT p_brand AS transcript_id, CAST(p_partkey AS INT) AS "start", CAST(p_partkey + p_size AS INT) AS "end",
        CAST(coalesce(sum(p_size + 1) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM part""",
    "span_levels": """SELECT 'transcript' AS level, p_type || '-' || p_brand AS id, 'c' AS chrom, min(p_partkey) AS "start", max(p_partkey + p_size) AS "end" FROM part GROUP BY 2
        UNION ALL SELECT 'gene', p_type, 'c', min(p_partkey), max(p_partkey + p_size) FROM part GROUP BY 2""",
    "reverse_complements": "SELECT p_partkey, reverse(translate(regexp_replace(translate(upper(p_name), 'BDEFHIJKLMNOPQRSUVWXYZ ', 'ACGTACGTACGTACGTACGTACN'), '[^ACGT]', '', 'g'), 'ACGT', 'TGCA')) AS seq FROM part",
    "wrapped_lines": "SELECT doc_id, md5(rtrim(regexp_replace(regexp_replace(text, '[^A-Za-z]', '', 'g'), '(.{60})', '\\1' || chr(10), 'g'), chr(10))) AS wrapped FROM documents",
    "header_regex": "SELECT 't' || p_partkey AS transcript, replace(p_brand, '#', '_') AS gene FROM part",
    "suffix_strip": "SELECT p_partkey, p_brand || CASE WHEN p_partkey % 3 = 2 THEN '_C' ELSE '' END AS name FROM part",
    "tokenised": "SELECT p_partkey, array_to_string(w, '|') AS words, CAST(len(w) AS INT) AS n FROM (SELECT p_partkey, regexp_extract_all(p_name, '[^ \\t]+') AS w FROM part)",
    "member_names": f"WITH {C} SELECT array_to_string(ts, '*') AS name, CAST(len(ts) AS INT) AS n FROM c",
}
