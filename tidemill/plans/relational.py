"""Relational queries: one text each, or a Spark and a DuckDB spelling where dialects differ."""

from __future__ import annotations

#: texts that both engines run as they are
SAME = {
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'R'",
    "select_without_from": "SELECT 1 AS one, 'a' AS a, CAST(NULL AS INT) AS n",
    "subquery_alias": "SELECT t.k, t.n FROM (SELECT o_orderstatus AS k, COUNT(*) AS n FROM orders GROUP BY o_orderstatus) t WHERE t.n > 10",
    "star_expansion": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "agg_global": "SELECT COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS q, MIN(l_tax) AS lo, MAX(l_tax) AS hi FROM lineitem",
    "agg_count_sum_avg": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, ROUND(AVG(l_quantity), 6) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_empty_input": "SELECT COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem WHERE l_quantity < 0",
    "agg_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "agg_count_distinct": "SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS s, COUNT(DISTINCT l_partkey) AS p FROM lineitem GROUP BY l_returnflag",
    "agg_sum_distinct": "SELECT l_returnflag, SUM(DISTINCT l_linenumber) AS s FROM lineitem GROUP BY l_returnflag",
    "agg_min_max": "SELECT o_orderpriority, MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders GROUP BY o_orderpriority",
    "agg_stats": "SELECT l_returnflag, ROUND(STDDEV_SAMP(l_quantity), 6) AS ss, ROUND(STDDEV_POP(l_quantity), 6) AS sp, ROUND(VAR_SAMP(l_quantity), 6) AS vs, ROUND(VAR_POP(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag",
    "agg_covar_corr": "SELECT ROUND(COVAR_POP(l_quantity, l_extendedprice), 2) AS cp, ROUND(COVAR_SAMP(l_quantity, l_extendedprice), 2) AS cs, ROUND(CORR(l_quantity, l_extendedprice), 8) AS c FROM lineitem",
    "agg_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12",
    "agg_null_inputs": "SELECT event_type, COUNT(NULLIF(value, 0)) AS n, ROUND(SUM(CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END), 4) AS s FROM events GROUP BY event_type",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "join_comma": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_left": "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey",
    "join_right": "SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON c_custkey = o_custkey",
    "join_full": "SELECT s_suppkey, n_name FROM supplier FULL OUTER JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_cartesian": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_self": "SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey < b.o_orderkey AND a.o_orderpriority = b.o_orderpriority",
    "join_semi": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "join_anti": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "join_three": "SELECT n_name, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "union_all": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "set_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "set_except": "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier",
    "sort_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "sort_nulls": "SELECT k, v FROM (SELECT c_custkey AS k, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer) t ORDER BY v ASC NULLS FIRST, k LIMIT 40",
    "limit_tiebreak": "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 10",
    "fn_string": "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_mktsegment) AS l, LENGTH(c_name) AS n, SUBSTRING(c_name, 2, 4) AS s, CONCAT(c_name, '-', c_mktsegment) AS c, TRIM(CONCAT('  ', c_name, ' ')) AS t, REVERSE(c_name) AS r, REPEAT('ab', 3) AS rep, LPAD(c_mktsegment, 12, '*') AS lp, RPAD(c_mktsegment, 12, '*') AS rp, REPLACE(c_name, '#', '_') AS rc, ASCII(c_mktsegment) AS asc0, TRANSLATE(c_mktsegment, 'AEI', '123') AS tr FROM customer",
    "fn_math": "SELECT p_partkey, ABS(p_size - 25) AS a, ROUND(SQRT(p_retailprice), 6) AS sq, ROUND(LN(p_retailprice), 6) AS ln, ROUND(EXP(p_size / 50.0), 6) AS ex, ROUND(POWER(p_size, 2), 2) AS pw, FLOOR(p_retailprice) AS fl, CEIL(p_retailprice) AS ce, p_size % 7 AS m, ROUND(SIN(p_size), 6) AS si, ROUND(ATAN(p_size), 6) AS at, ROUND(DEGREES(p_size), 6) AS dg, SIGN(p_size - 25) AS sg, GREATEST(p_size, 10) AS gr, LEAST(p_size, 10) AS le FROM part",
    "fn_conditional": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, COALESCE(NULLIF(o_orderstatus, 'O'), 'open') AS st, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS f FROM orders",
    "fn_predicates": "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 50000 AND 150000 AND NOT o_orderpriority LIKE '1-%' AND o_custkey IS NOT NULL",
    "fn_like": "SELECT p_partkey FROM part WHERE p_name LIKE '%1%' OR p_brand LIKE 'Brand#_2'",
    "bench_query1": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000",
    "bench_query2": "SELECT SUBSTRING(c_name, 1, 12) AS prefix, ROUND(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY SUBSTRING(c_name, 1, 12)",
    "bench_query3": "SELECT c_mktsegment, ROUND(SUM(l_extendedprice), 2) AS revenue, ROUND(AVG(o_totalprice), 4) AS price FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1997-01-01 00:00:00' GROUP BY c_mktsegment ORDER BY revenue DESC LIMIT 3",
    "window_rank": "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders",
}

#: name -> (Spark text, DuckDB text)
PAIRS = {
    "agg_collect_set": ("SELECT o_orderpriority, concat_ws(',', sort_array(collect_set(o_orderstatus))) AS s FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS s FROM orders GROUP BY o_orderpriority"),
    "agg_rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)",) * 2,
    "lateral_view_explode": ("SELECT doc_id, pos, w FROM documents LATERAL VIEW posexplode(split(text, ' ')) t AS pos, w", "SELECT doc_id, (i - 1)::INT AS pos, ws[i] AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws, unnest(range(1, len(string_split(text, ' ')) + 1)) AS i FROM documents)"),
    "lateral_view_outer": ("SELECT c_custkey, x FROM customer LATERAL VIEW OUTER explode(CASE WHEN c_custkey % 2 = 0 THEN array(c_nationkey, 1) END) t AS x", "SELECT c_custkey, unnest(CASE WHEN c_custkey % 2 = 0 THEN [c_nationkey, 1] ELSE [NULL] END) AS x FROM customer"),
    "explode_embedding": ("SELECT pos, round(avg(v), 5) AS mean, count(*) AS n FROM embeddings LATERAL VIEW posexplode(embedding) t AS pos, v GROUP BY pos", "SELECT (i - 1)::INT AS pos, round(avg(embedding[i]::DOUBLE), 5) AS mean, count(*) AS n FROM (SELECT embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY i"),
    "fn_string_more": ("SELECT c_custkey, initcap(lower(c_mktsegment)) AS i, instr(c_name, '#') AS p, split(c_name, '#')[0] AS s0, regexp_extract(c_name, '([0-9]+)', 1) AS d, regexp_replace(c_name, '0+', '0') AS z, hex(c_nationkey) AS h, bin(c_nationkey) AS b, find_in_set(c_mktsegment, 'BUILDING,MACHINERY') AS f, concat_ws('|', c_name, c_mktsegment) AS w FROM customer", "SELECT c_custkey, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS i, instr(c_name, '#')::INT AS p, string_split(c_name, '#')[1] AS s0, regexp_extract(c_name, '([0-9]+)', 1) AS d, regexp_replace(c_name, '0+', '0', 'g') AS z, to_hex(c_nationkey) AS h, to_binary(c_nationkey) AS b, coalesce(list_position(['BUILDING', 'MACHINERY'], c_mktsegment), 0)::INT AS f, concat_ws('|', c_name, c_mktsegment) AS w FROM customer"),
    "fn_integer_division": ("SELECT o_orderkey, o_orderkey div 7 AS q, o_orderkey % 7 AS r, pmod(-o_orderkey, 7) AS p, o_orderkey & 12 AS a, o_orderkey | 3 AS o, o_orderkey ^ 5 AS x FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, ((-o_orderkey % 7) + 7) % 7 AS p, o_orderkey & 12 AS a, o_orderkey | 3 AS o, xor(o_orderkey, 5) AS x FROM orders"),
    "fn_safe_division": ("SELECT p_partkey, try_divide(p_size, p_size - 5) AS d FROM part", "SELECT p_partkey, p_size::DOUBLE / nullif(p_size - 5, 0) AS d FROM part"),
    "fn_date": ("SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, weekofyear(o_orderdate) AS w, datediff(o_orderdate, date '1995-01-01') AS n, date_format(date_add(o_orderdate, 30), 'yyyy-MM-dd') AS plus, date_format(date_sub(o_orderdate, 7), 'yyyy-MM-dd') AS minus, date_format(last_day(o_orderdate), 'yyyy-MM-dd') AS e FROM orders", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, weekofyear(o_orderdate)::INT AS w, date_diff('day', date '1995-01-01', o_orderdate::DATE)::INT AS n, strftime(o_orderdate::DATE + 30, '%Y-%m-%d') AS plus, strftime(o_orderdate::DATE - 7, '%Y-%m-%d') AS minus, strftime(last_day(o_orderdate), '%Y-%m-%d') AS e FROM orders"),
    "fn_time": ("SELECT event_id, hour(ts) AS h, minute(ts) AS m, second(ts) AS s, unix_timestamp(cast(ts AS timestamp)) AS u FROM events", "SELECT event_id, hour(ts)::INT AS h, minute(ts)::INT AS m, second(ts)::INT AS s, floor(epoch(ts))::BIGINT AS u FROM events"),
    "fn_array_map": ("SELECT n_nationkey, size(array(n_name, 'x')) AS n, array_contains(array(n_regionkey, 9), 2) AS c, element_at(map('k', n_name), 'k') AS v, map('k', n_name)['q'] AS miss, get(array(n_name), 3) AS beyond, named_struct('a', n_regionkey).a AS f FROM nation", "SELECT n_nationkey, 2 AS n, list_contains([n_regionkey, 9], 2) AS c, n_name AS v, NULL::VARCHAR AS miss, NULL::VARCHAR AS beyond, {'a': n_regionkey}.a AS f FROM nation"),
    "fn_json": ("SELECT event_id, cast(get_json_object(props, '$.k') AS int) AS k FROM events", "SELECT event_id, cast(json_extract_string(props, '$.k') AS INT) AS k FROM events"),
    "fn_cast": ("SELECT o_orderkey, cast(o_totalprice AS bigint) AS b, cast(o_orderkey AS string) AS s, cast(o_orderkey AS double) AS d, try_cast(o_orderstatus AS int) AS bad, cast(o_orderkey AS boolean) AS t, cast('12' AS int) AS i, cast(cast(o_totalprice AS decimal(20, 4)) AS string) AS dec FROM orders", "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS b, o_orderkey::VARCHAR AS s, o_orderkey::DOUBLE AS d, try_cast(o_orderstatus AS INT) AS bad, o_orderkey::BOOLEAN AS t, 12 AS i, (o_totalprice::DECIMAL(20, 4))::VARCHAR AS dec FROM orders"),
    "fn_rlike": ("SELECT p_partkey FROM part WHERE p_name RLIKE '[0-9]{2}$'", "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '[0-9]{2}$')"),
    "fn_xpath": ("SELECT n_nationkey, xpath_string(concat('<a><b>', n_name, '</b></a>'), 'a/b') AS s, xpath_int('<a><b>3</b><b>4</b></a>', 'sum(a/b)') AS t FROM nation", "SELECT n_nationkey, n_name AS s, 7 AS t FROM nation"),
    "flagship": ("SELECT c_mktsegment, o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY c_mktsegment, o_orderkey ORDER BY revenue DESC, o_orderkey LIMIT 20",) * 2,
}
#: results that depend on the engine's own random numbers or hashes
ROWS_ONLY = {
    "agg_histogram_numeric": "SELECT size(histogram_numeric(l_quantity, 8)) AS n FROM lineitem",
    "fn_rand": "SELECT count(*) AS n FROM orders WHERE rand(7) < 0.5",
    "fn_hash": "SELECT n_nationkey, hash(n_name) AS h FROM nation",
    "agg_first": "SELECT o_orderstatus, first(o_orderpriority, true) AS p FROM orders GROUP BY o_orderstatus",
}

#: properties of results that have no value of their own to compare: order, placement, bounds, membership
PROPERTIES = {
    "tablesample_rows": ("SELECT count(*) AS n FROM (SELECT * FROM orders TABLESAMPLE (7 ROWS)) t", "SELECT 7::BIGINT AS n"),
    "tablesample_percent": ("SELECT count(*) BETWEEN 0.2 * a AND 0.4 * a AS near, count(DISTINCT o_orderkey) = count(*) AS once, count(k) = count(*) AS members FROM (SELECT o_orderkey FROM orders TABLESAMPLE (30 PERCENT) REPEATABLE (3)) t LEFT JOIN (SELECT o_orderkey AS k FROM orders) o ON o.k = t.o_orderkey CROSS JOIN (SELECT count(*) AS a FROM orders) c GROUP BY a", "SELECT true AS near, true AS once, true AS members"),
    "agg_histogram_numeric": ("SELECT size(h) AS bins, cast(aggregate(h, 0D, (s, b) -> s + b.y) AS bigint) AS n, h[0].x >= lo AND h[7].x <= hi AND h[0].x < h[7].x AS inside FROM (SELECT histogram_numeric(l_quantity, 8) AS h, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) t", "SELECT 8::INT AS bins, count(*) AS n, true AS inside FROM lineitem"),
    "fn_rand": ("SELECT count(*) AS n, min(r) >= 0 AND max(r) < 1 AS inside, abs(avg(r) - 0.5) < 0.1 AS even, count(DISTINCT r) > 0.99 * count(*) AS different FROM (SELECT rand(7) AS r FROM orders) t", "SELECT count(*) AS n, true AS inside, true AS even, true AS different FROM orders"),
    "fn_hash": ("SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s, hash(n_name) = hash(concat(n_name, '')) AS same, hash(n_name, 1) <> hash(n_name, 2) AS apart FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, true AS same, true AS apart FROM nation"),
    "agg_first": ("SELECT o_orderstatus, array_contains(collect_set(o_orderpriority), first(o_orderpriority, true)) AS member, first(nullif(o_orderstatus, o_orderstatus), true) IS NULL AS none FROM orders GROUP BY o_orderstatus", "SELECT DISTINCT o_orderstatus, true AS member, true AS none FROM orders"),
    "fn_sentences": ("SELECT n_nationkey, concat_ws('|', transform(sentences(concat('Hi you, from ', lower(substring(n_name, 1, 2)), '! How are things?')), s -> concat_ws(' ', s))) AS s FROM nation", "SELECT n_nationkey, 'Hi you from ' || lower(substring(n_name, 1, 2)) || '|How are things' AS s FROM nation"),
    "fn_xpath_types": ("SELECT n_nationkey, xpath(x, 'a/b/text()')[1] AS l, xpath_boolean(x, 'a/c') AS t, xpath_double(x, 'sum(a/b)') AS d, xpath_float(x, 'a/b[1]') AS f, xpath_long(x, 'count(a/b)') AS n, xpath_short(x, 'a/b[2]') AS s, xpath_number(x, 'a/c') IS NULL OR isnan(xpath_number(x, 'a/c')) AS nan FROM (SELECT n_nationkey, concat('<a><b>', n_nationkey, '</b><b>4</b></a>') AS x FROM nation) t", "SELECT n_nationkey, '4' AS l, false AS t, n_nationkey + 4.0::DOUBLE AS d, n_nationkey::FLOAT AS f, 2::BIGINT AS n, 4::SMALLINT AS s, true AS nan FROM nation"),
    "fn_reflect": ("SELECT n_nationkey, java_method('java.lang.Math', 'max', n_nationkey, 7) AS m, reflect('java.lang.String', 'valueOf', n_regionkey) AS s FROM nation", "SELECT n_nationkey, greatest(n_nationkey, 7)::VARCHAR AS m, n_regionkey::VARCHAR AS s FROM nation"),
    "fn_bitmap": ("SELECT r, bitmap_count(b) AS n, bitmap_count(bitmap_or_agg(b) OVER ()) AS either, bitmap_count(bitmap_and_agg(b) OVER ()) AS common FROM (SELECT c_nationkey % 3 AS r, bitmap_construct_agg(bitmap_bit_position(c_custkey % 100 + 1)) AS b FROM customer GROUP BY c_nationkey % 3) t", "WITH s AS (SELECT DISTINCT c_nationkey % 3 AS r, c_custkey % 100 AS k FROM customer), b AS (SELECT k, count(*) AS c FROM s GROUP BY k) SELECT r, count(*) AS n, (SELECT count(*) FROM b) AS either, (SELECT count(*) FROM b WHERE c = (SELECT count(DISTINCT r) FROM s)) AS common FROM s GROUP BY r"),
    "fn_nan": ("SELECT n_nationkey, cast('NaN' AS double) = cast('NaN' AS double) AS same, isnan(x) AS n, nanvl(x, -1D) AS v, x > 1e308D AS greatest FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN cast('NaN' AS double) ELSE cast(n_nationkey AS double) END AS x FROM nation) t", "SELECT n_nationkey, true AS same, n_nationkey % 2 = 0 AS n, CASE WHEN n_nationkey % 2 = 0 THEN -1 ELSE n_nationkey END::DOUBLE AS v, n_nationkey % 2 = 0 AS greatest FROM nation"),
    "fn_coercion": ("SELECT n_nationkey, '10' + n_nationkey AS a, cast(n_nationkey AS string) = n_nationkey AS e, n_nationkey > '7' AS g, cast(1 AS tinyint) + cast(2 AS smallint) AS t, 1 + 2.5 AS d, n_nationkey / 2 AS h, cast(n_nationkey % 2 AS boolean) AS b, concat(n_nationkey, 'x') AS c FROM nation", "SELECT n_nationkey, (10 + n_nationkey)::BIGINT AS a, true AS e, n_nationkey > 7 AS g, 3::SMALLINT AS t, 3.5::DECIMAL(12,1) AS d, n_nationkey / 2.0::DOUBLE AS h, (n_nationkey % 2)::BOOLEAN AS b, n_nationkey || 'x' AS c FROM nation"),
    "fn_casts": ("SELECT n_nationkey, cast(n_nationkey AS tinyint) AS t, cast(n_nationkey AS smallint) AS s, cast(cast(n_nationkey AS float) AS double) AS f, cast('2024-02-29' AS date) AS d, cast(true AS int) AS i, cast(3.99D AS int) AS tr, try_cast('abc' AS double) AS bad, cast(' 7 ' AS int) AS sp, cast(cast('2024-01-02 03:04:05' AS timestamp) AS string) AS ts, cast(binary('ab') AS string) AS bi FROM nation", "SELECT n_nationkey, n_nationkey::TINYINT AS t, n_nationkey::SMALLINT AS s, n_nationkey::DOUBLE AS f, DATE '2024-02-29' AS d, 1 AS i, 3 AS tr, NULL::DOUBLE AS bad, 7 AS sp, '2024-01-02 03:04:05' AS ts, 'ab' AS bi FROM nation"),
    "fn_literals": ("SELECT 1Y AS b, 2S AS s, 3 AS i, 4L AS l, 1.5F AS f, 2.5D AS d, 3.25BD AS n, 'x' AS t, true AS y, NULL AS z, TIMESTAMP_NTZ '2024-01-02 03:04:05' AS ts, hex(X'1F') AS h", "SELECT 1::TINYINT AS b, 2::SMALLINT AS s, 3 AS i, 4::BIGINT AS l, 1.5::FLOAT AS f, 2.5::DOUBLE AS d, 3.25::DECIMAL(3,2) AS n, 'x' AS t, true AS y, NULL AS z, TIMESTAMP '2024-01-02 03:04:05' AS ts, '1F' AS h"),
    "fn_if": ("SELECT o_orderkey, if(o_totalprice > 100000, 'a', 'b') AS i, nvl(nullif(o_orderstatus, 'F'), '-') AS n, isnull(nullif(o_orderstatus, 'F')) AS z, isnotnull(o_orderkey) AS k, nvl2(nullif(o_orderstatus, 'F'), 1, 0) AS v FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'a' ELSE 'b' END AS i, coalesce(nullif(o_orderstatus, 'F'), '-') AS n, o_orderstatus = 'F' AS z, true AS k, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS v FROM orders"),
    "fn_text_rest": ("SELECT n_nationkey, cast(array_position(array('FRANCE', n_name), n_name) AS int) AS f, format_number(n_nationkey * 1000.5, 1) AS m, lcase(n_name) AS lc, ucase(n_name) AS uc, ltrim('  a ') AS lt, rtrim(' a  ') AS rt, concat('[', space(3), ']') AS sp, parse_url('http://h.org/p?q=1#f', 'HOST') AS u, elt(2, 'x', n_name) AS e, locate('a', 'banana', 3) AS lo, substring_index('a.b.c', '.', 2) AS si, soundex('Robert') AS so, levenshtein('kitten', 'sitting') AS le, unhex('41') = binary('A') AS uh, base64(binary('ab')) AS b64 FROM (SELECT n_nationkey, n_name FROM nation) t", "SELECT n_nationkey, CASE WHEN n_name = 'FRANCE' THEN 1 ELSE 2 END AS f, format('{:,.1f}', (n_nationkey * 1000.5)::DOUBLE) AS m, lower(n_name) AS lc, upper(n_name) AS uc, 'a ' AS lt, ' a' AS rt, '[   ]' AS sp, 'h.org' AS u, n_name AS e, 4 AS lo, 'a.b' AS si, 'R163' AS so, 3 AS le, true AS uh, 'YWI=' AS b64 FROM nation"),
    "fn_math_rest": ("SELECT p_partkey, round(acos(p_size / 100.0D), 6) AS ac, round(asin(p_size / 100.0D), 6) AS asn, conv(p_size, 10, 16) AS cv, round(cos(p_size), 6) AS co, round(tan(p_size), 6) AS ta, round(log(p_size), 6) AS lg, round(log10(p_size), 6) AS l10, round(log2(p_size), 6) AS l2, negative(p_size) AS ne, positive(p_size) AS po, round(radians(p_size), 6) AS ra, round(pi(), 6) AS pi, round(e(), 6) AS e, ~p_size AS nt, shiftleft(p_size, 2) AS sl, pmod(-p_size, 7) AS pm, round(2.5D) AS r0, bround(2.5D) AS br, factorial(5) AS fa, cbrt(27.0D) AS cb, hypot(3.0D, 4.0D) AS hy FROM part", "SELECT p_partkey, round(acos(p_size / 100.0), 6) AS ac, round(asin(p_size / 100.0), 6) AS asn, to_hex(p_size) AS cv, round(cos(p_size), 6) AS co, round(tan(p_size), 6) AS ta, round(ln(p_size), 6) AS lg, round(log10(p_size), 6) AS l10, round(log2(p_size), 6) AS l2, -p_size AS ne, p_size AS po, round(radians(p_size), 6) AS ra, round(pi(), 6) AS pi, round(exp(1), 6) AS e, ~p_size AS nt, p_size * 4 AS sl, ((-p_size % 7) + 7) % 7 AS pm, 3.0::DOUBLE AS r0, 2.0::DOUBLE AS br, 120::BIGINT AS fa, 3.0::DOUBLE AS cb, 5.0::DOUBLE AS hy FROM part"),
    "fn_date_rest": ("SELECT o_orderkey, dayofmonth(o_orderdate) AS dm, date_format(to_date(o_orderdate), 'yyyy-MM-dd') AS td, trim(LEADING '+' FROM from_unixtime(o_orderkey * 86400, 'yyyy-MM-dd')) AS fu, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS dy, date_format(add_months(o_orderdate, 1), 'yyyy-MM') AS am, date_format(trunc(o_orderdate, 'MM'), 'yyyy-MM-dd') AS tm, dayofweek(o_orderdate) AS dw FROM orders", "SELECT o_orderkey, day(o_orderdate)::INT AS dm, strftime(o_orderdate, '%Y-%m-%d') AS td, strftime(epoch_ms(o_orderkey * 86400000), '%Y-%m-%d') AS fu, quarter(o_orderdate)::INT AS q, dayofyear(o_orderdate)::INT AS dy, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m') AS am, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS tm, (dayofweek(o_orderdate) + 1)::INT AS dw FROM orders"),
    "agg_count_distinct_columns": ("SELECT o_orderstatus, count(DISTINCT o_custkey, o_orderpriority) AS n FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count(DISTINCT (o_custkey, o_orderpriority)) AS n FROM orders GROUP BY o_orderstatus"),
    "agg_percentile": ("SELECT l_returnflag, round(percentile(l_quantity, 0.5), 6) AS p, abs(percentile_approx(l_quantity, 0.5, 10000) - percentile(l_quantity, 0.5)) <= 1 AS near FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS p, true AS near FROM lineitem GROUP BY l_returnflag"),
    "agg_sum_distinct_empty": ("SELECT sum(DISTINCT l_linenumber) AS s, count(DISTINCT l_linenumber) AS n, avg(l_tax) AS a FROM lineitem WHERE l_quantity < 0", "SELECT sum(DISTINCT l_linenumber)::BIGINT AS s, count(DISTINCT l_linenumber) AS n, avg(l_tax) AS a FROM lineitem WHERE l_quantity < 0"),
    "agg_cube": ("SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id() AS g FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS g FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)"),
    "lateral_view_map": ("SELECT n_nationkey, k, v FROM nation LATERAL VIEW explode(map('name', n_name, 'region', cast(n_regionkey AS string))) t AS k, v", "SELECT n_nationkey, unnest(['name', 'region']) AS k, unnest([n_name, n_regionkey::VARCHAR]) AS v FROM nation"),
    "join_nested_loop": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey + b.n_regionkey < b.n_nationkey", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey + b.n_regionkey < b.n_nationkey"),
    "join_nested_loop_outer": ("SELECT r_regionkey, n_nationkey FROM region LEFT JOIN nation ON r_regionkey * 10 < n_nationkey AND n_nationkey < 15", "SELECT r_regionkey, n_nationkey FROM region LEFT JOIN nation ON r_regionkey * 10 < n_nationkey AND n_nationkey < 15"),
    "set_except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "window_frames": ("SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean, ntile(3) OVER w AS third, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean, ntile(3) OVER w::INT AS third, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)::INT AS r, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority)::INT AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"),
}
PAIRS |= PROPERTIES
ROWS_ONLY = {k: v for k, v in ROWS_ONLY.items() if k not in PAIRS}
