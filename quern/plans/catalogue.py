"""Queries of the engine's own operators, each with SQL another engine can check.

SHARED queries are the same text for both engines, read here through our dialect.  OWN queries
pair our dialect or a DataFrame plan with the other engine's SQL.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import session
from quern.dialect import Engine
from quern.operators import geoip, tables
from quern.plans import security, values
from quern.sources import files
from quern.streaming import ingest

_REV = "l_extendedprice * (1 - l_discount)"

SHARED = {
    "tpch_q1": f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
        round(sum({_REV}), 2) AS sum_disc_price, round(sum({_REV} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty,
        round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q3": f"""SELECT l_orderkey, round(sum({_REV}), 2) AS revenue, o_orderdate FROM customer, orders, lineitem
        WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00'
        AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q4": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1993-07-01 00:00:00' AND o_orderdate < TIMESTAMP '1995-10-01 00:00:00'
        AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""",
    "tpch_q2": """WITH partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, round(min(l_extendedprice / l_quantity), 2) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey),
        offers AS (SELECT ps_partkey, ps_supplycost, s_name, s_acctbal, n_name FROM partsupp, supplier, nation, region WHERE s_suppkey = ps_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE')
        SELECT s_acctbal, s_name, n_name, p_partkey, ps_supplycost FROM part, offers WHERE p_partkey = ps_partkey AND p_size < 10
        AND ps_supplycost = (SELECT min(o.ps_supplycost) FROM offers o WHERE o.ps_partkey = p_partkey)""",
    "tpch_q5": f"""SELECT n_name, round(sum({_REV}), 2) AS revenue
        FROM (SELECT s_suppkey, s_nationkey, n_name FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA') s, lineitem, orders, customer
        WHERE l_suppkey = s_suppkey AND l_orderkey = o_orderkey AND c_custkey = o_custkey AND c_nationkey = s_nationkey GROUP BY n_name""",
    "tpch_q6": """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01 00:00:00'
        AND l_shipdate < TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24""",
    "tpch_q7": f"""SELECT supp_nation, cust_nation, CAST(extract(year FROM l_shipdate) AS INT) AS l_year, round(sum({_REV}), 0) AS revenue
        FROM (SELECT s_suppkey, n_name AS supp_nation FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 1) s, lineitem, orders,
        (SELECT c_custkey, n_name AS cust_nation FROM customer, nation WHERE c_nationkey = n_nationkey AND n_regionkey = 2) c
        WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey GROUP BY 1, 2, 3""",
    "tpch_q8": f"""SELECT CAST(extract(year FROM o_orderdate) AS INT) AS o_year, round(sum(CASE WHEN supp_nation = 'BRAZIL' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS mkt_share
        FROM (SELECT c_custkey FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'AMERICA') c, orders, lineitem, part,
        (SELECT s_suppkey, n_name AS supp_nation FROM supplier, nation WHERE s_nationkey = n_nationkey) s
        WHERE o_custkey = c_custkey AND l_orderkey = o_orderkey AND p_partkey = l_partkey AND s_suppkey = l_suppkey GROUP BY 1""",
    "tpch_q9": f"""WITH partsupp AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, min(l_extendedprice / l_quantity) * 0.5 AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)
        SELECT n_name, CAST(extract(year FROM o_orderdate) AS INT) AS o_year, round(sum({_REV} - ps_supplycost * l_quantity), 0) AS sum_profit FROM part, lineitem, partsupp, orders,
        (SELECT s_suppkey, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey) s
        WHERE p_partkey = l_partkey AND p_size < 25 AND ps_partkey = l_partkey AND ps_suppkey = l_suppkey AND o_orderkey = l_orderkey AND s_suppkey = l_suppkey GROUP BY 1, 2""",
    "tpch_q10": f"""SELECT c_custkey, c_name, round(sum({_REV}), 2) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
        WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name
        ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": """WITH ps AS (SELECT l_partkey, sum(l_extendedprice) AS v FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 7) GROUP BY l_partkey)
        SELECT l_partkey, round(v, 2) AS value FROM ps WHERE v > (SELECT sum(v) * 0.0005 FROM ps)""",
    "tpch_q12": """SELECT l_linestatus, sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) * 1.0 AS high_line_count,
        count(*) AS line_count FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= TIMESTAMP '1994-01-01 00:00:00' GROUP BY l_linestatus""",
    "tpch_q13": """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders
        ON c_custkey = o_custkey AND o_orderstatus <> 'P' GROUP BY c_custkey) t GROUP BY c_count""",
    "tpch_q14": f"""SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {_REV} ELSE 0 END) / sum({_REV}), 6) AS promo_revenue FROM lineitem, part
        WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1995-09-01 00:00:00'""",
    "tpch_q15": f"""WITH r AS (SELECT l_suppkey, round(sum({_REV}), 2) AS total FROM lineitem GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total FROM supplier, r WHERE s_suppkey = l_suppkey AND total = (SELECT max(total) FROM r)""",
    "tpch_q16": """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45'
        AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "tpch_q17": """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 10
        AND l_quantity < (SELECT 0.5 * avg(l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)""",
    "tpch_q18": """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer, orders, lineitem
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
        GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "tpch_q19": f"""SELECT round(sum({_REV}), 2) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND ((p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11)
        OR (p_size BETWEEN 1 AND 10 AND l_quantity BETWEEN 10 AND 20))""",
    "tpch_q20": """SELECT s_name, s_suppkey FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey = 3 AND s_suppkey IN (SELECT l_suppkey FROM lineitem
        WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 15) GROUP BY l_suppkey HAVING sum(l_quantity) > 1000)""",
    "tpch_q22": """SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
        AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY c_mktsegment""",
    "filter_predicates": """SELECT o_orderkey FROM orders WHERE (o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 90000) OR (o_orderpriority LIKE '1%' AND NOT o_orderstatus = 'P')
        OR o_orderkey IS NULL""",
    "null_safe_compare": """SELECT count(*) AS n FROM customer c LEFT JOIN orders o ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o.o_orderstatus IS DISTINCT FROM 'F'""",
    "ilike_case": """SELECT p_partkey, CASE WHEN p_type ILIKE '%steel%' THEN 'steel' WHEN p_size > 25 THEN 'big' ELSE 'other' END AS class FROM part""",
    "tuple_in": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('R', 'F'), ('N', 'O')) AND l_quantity > 49",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_right": "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey",
    "join_full": "SELECT a.n_nationkey AS a, b.s_nationkey AS b FROM nation a FULL JOIN (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 5000) b ON a.n_nationkey = b.s_nationkey",
    "join_cross": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "join_using": "SELECT n_nationkey, r_name FROM (SELECT n_nationkey, n_regionkey AS k FROM nation) JOIN (SELECT r_regionkey AS k, r_name FROM region) USING (k)",
    "not_in_null": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN s_acctbal > 0 THEN s_nationkey END FROM supplier WHERE s_acctbal > 7000)",
    "scalar_subquery": "SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS d FROM orders",
    "correlated_scalar": "SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer",
    "lateral": "SELECT r_name, t.n FROM region, LATERAL (SELECT count(*) AS n FROM nation WHERE n_regionkey = r_regionkey) t",
    "recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 300) SELECT n FROM t",
    "values_table": "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (3, NULL)) AS t(a, b)",
    "cte_twice": "WITH t AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT count(*) AS n FROM t a JOIN t b ON a.k = b.k AND a.s = b.s",
    "union_all": "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "except_distinct": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'",
    "distinct_rows": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "agg_basic": """SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS d, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_orderdate) AS lo,
        max(o_orderpriority) AS hi, bool_and(o_totalprice > 0) AS every_, bool_or(o_totalprice > 400000) AS any_ FROM orders GROUP BY o_orderstatus""",
    "agg_stats": """SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sp, round(var_samp(l_quantity), 4) AS vs, round(var_pop(l_quantity), 4) AS vp,
        round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_extendedprice), 1) AS cs, round(covar_pop(l_quantity, l_extendedprice), 1) AS cp FROM lineitem GROUP BY l_returnflag""",
    "agg_percentiles": """SELECT o_orderstatus, round(median(o_totalprice), 4) AS med, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90,
        percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS p25 FROM orders GROUP BY o_orderstatus""",
    "agg_minmax_by": "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS top, min_by(o_orderkey, o_totalprice) AS low FROM orders GROUP BY o_custkey",
    "agg_filter": "SELECT count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_returnflag = 'R'), 4) AS tax, count(*) FILTER (WHERE l_quantity > 1000) AS none FROM lineitem",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) - min(o_totalprice) > 1000",
    "grouping_sets": """SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    "rollup": "SELECT n_regionkey, n_nationkey, count(*) AS n FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)",
    "cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "window_ranks": """SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, round(percent_rank() OVER w, 8) AS pr, round(cume_dist() OVER w, 8) AS cd, ntile(4) OVER w AS nt
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "window_offsets": """SELECT o_orderkey, lag(o_totalprice) OVER w AS pv, lead(o_totalprice, 2, -1.0) OVER w AS nx, first_value(o_orderkey) OVER w AS fv, nth_value(o_orderkey, 2) OVER w AS nv
        FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "window_frames": """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3,
        last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_,
        count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders""",
    "sort_offset": "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 10",
    "date_parts": """SELECT event_id, CAST(extract(year FROM ts) AS INT) AS y, CAST(extract(month FROM ts) AS INT) AS m, CAST(extract(day FROM ts) AS INT) AS d, CAST(extract(hour FROM ts) AS INT) AS h,
        date_trunc('month', ts) AS mon, CAST(extract(doy FROM ts) AS INT) AS doy FROM events""",
    "date_interval": "SELECT event_id, ts + INTERVAL '1' DAY AS t1, ts - INTERVAL '2' HOUR AS t2 FROM events",
    "string_functions": """SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, concat(p_brand, '-', p_type) AS c, replace(p_name, 'e', 'E') AS r, reverse(p_brand) AS rv, left(p_name, 3) AS lf, right(p_name, 2) AS rt,
        lpad(p_brand, 12, '*') AS lp, translate(p_type, 'AE', 'ae') AS tr, ascii(p_name) AS a, length(p_name) AS n, md5(p_name) AS h FROM part""",
    "math_functions": """SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity), 6) AS sq, round(ln(l_quantity), 6) AS ln_, round(power(l_discount, 2), 8) AS p, round(exp(l_tax), 8) AS e, sign(l_discount - 0.05) * 1.0 AS sg,
        ceil(l_extendedprice) * 1.0 AS c, floor(l_extendedprice) * 1.0 AS f, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS le, round(sin(l_quantity), 8) AS si, round(atan2(l_tax, l_quantity), 8) AS at FROM lineitem""",
    "conditional_functions": "SELECT event_id, coalesce(nullif(event_type, 'click'), 'none') AS c, CASE event_type WHEN 'view' THEN 1 ELSE 0 END AS v FROM events",
}

#: name -> (our dialect, the other engine's SQL).
OWN = {
    "dialect_qualify": ("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",) * 2,
    "dialect_fetch_first": ("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey FETCH FIRST 7 ROWS ONLY", "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 7"),
    "dialect_any_all": (
        "SELECT n_nationkey FROM nation WHERE n_regionkey = ANY (1, 3) OR n_nationkey > ALL (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)",
        "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3) OR n_nationkey > ALL (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)",
    ),
    "dialect_similar_to": ("SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)%'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).*')"),
    "dialect_null_order": (
        "SELECT x FROM (SELECT CASE WHEN n_nationkey > 3 THEN n_nationkey END AS x FROM nation) ORDER BY x DESC",
        "SELECT x FROM (SELECT CASE WHEN n_nationkey > 3 THEN n_nationkey END AS x FROM nation) ORDER BY x DESC NULLS FIRST",
    ),
    "dialect_int_division": ("SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r FROM orders",) * 2,
    "dialect_json_arrows": ("SELECT event_id, props ->> 'k' AS k FROM events", "SELECT event_id, props ->> '$.k' AS k FROM events"),
    "dialect_subscript": ("SELECT vec_id, embedding[1] AS a, embedding[999] AS b FROM embeddings",) * 2,
    "bytes_length": ("SELECT doc_id, length(text) AS n, char_length(text) AS c FROM documents", "SELECT doc_id, strlen(text) AS n, length(text) AS c FROM documents"),
    "vector_functions": (
        "SELECT a.vec_id, round(cosine_similarity(a.embedding, b.embedding), 5) AS c, round(l2_distance(a.embedding, b.embedding), 4) AS d, round(dot_product(a.embedding, b.embedding), 4) AS p, round(vector_norm(a.embedding), 4) AS n FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 5) AS c, round(list_distance(a.e, b.e), 4) AS d, round(list_inner_product(a.e, b.e), 4) AS p, round(sqrt(list_inner_product(a.e, a.e)), 4) AS n FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1",
    ),
    "network_ip": (
        "SELECT event_id, int_to_ip(167772160 + user_id) AS ip, ip_to_int(int_to_ip(167772160 + user_id)) AS n, cidr_contains('10.0.0.0/25', int_to_ip(167772160 + user_id)) AS inside, mask_ip(int_to_ip(167772160 + user_id), 1) AS masked FROM events",
        "SELECT event_id, concat('10.', (user_id >> 16) & 255, '.', (user_id >> 8) & 255, '.', user_id & 255) AS ip, 167772160 + user_id AS n, user_id < 128 AS inside, concat('10.', (user_id >> 16) & 255, '.', (user_id >> 8) & 255, '.0') AS masked FROM events",
    ),
    "network_ports": (
        "SELECT event_id, port_class(CAST(event_id * 7 % 65536 AS INT)) AS c, tcp_flags_to_string(CAST(event_id % 4 AS INT)) AS f FROM events",
        "SELECT event_id, CASE WHEN event_id * 7 % 65536 < 1024 THEN 'well-known' WHEN event_id * 7 % 65536 < 49152 THEN 'registered' ELSE 'ephemeral' END AS c, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'FIN' WHEN 2 THEN 'SYN' ELSE 'FIN,SYN' END AS f FROM events",
    ),
    "url_functions": ("SELECT page_id, url_extract_host(url) AS h, url_extract_protocol(url) AS p FROM pages", "SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS h, regexp_extract(url, '^([a-z]+):', 1) AS p FROM pages"),
    "hash_encode": ("SELECT p_partkey, sha256(p_name) AS h, to_base64(p_name) AS b, to_hex(p_partkey) AS x FROM part", "SELECT p_partkey, sha256(p_name) AS h, base64(encode(p_name)) AS b, lower(to_hex(p_partkey)) AS x FROM part"),
    "regexp_functions": (
        "SELECT p_partkey, regexp_like(p_type, 'BRASS$') AS m, regexp_count(p_name, '[aeiou]') AS n, regexp_replace(p_name, '[aeiou]', '.') AS r FROM part",
        "SELECT p_partkey, regexp_matches(p_type, 'BRASS$') AS m, len(regexp_extract_all(p_name, '[aeiou]')) AS n, regexp_replace(p_name, '[aeiou]', '.', 'g') AS r FROM part",
    ),
    "bit_functions": ("SELECT o_orderkey, bitwise_and(o_orderkey, 12) AS a, bitwise_or(o_orderkey, 5) AS o, bitwise_xor(o_orderkey, 7) AS x, bit_count(o_orderkey) AS c FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS o, xor(o_orderkey, 7) AS x, bit_count(o_orderkey) AS c FROM orders"),
    "string_agg": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_mode": ("SELECT l_returnflag, mode(l_linenumber, true) AS m, approx_distinct(l_linenumber) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, (SELECT l_linenumber FROM lineitem b WHERE b.l_returnflag = a.l_returnflag GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS m, count(DISTINCT l_linenumber) AS d FROM lineitem a GROUP BY l_returnflag"),
    "unnest_array": ("SELECT vec_id, i, round(x, 5) AS x FROM embeddings, unnest(embedding) WITH ORDINALITY AS u(x, i)", "SELECT vec_id, unnest(generate_series(1, len(embedding))) AS i, round(unnest(embedding), 5) AS x FROM embeddings"),
    "unnest_list": ("SELECT v, o FROM unnest('a', 'b', 'c') WITH ORDINALITY AS u(v, o)", "SELECT * FROM (VALUES ('a', 1), ('b', 2), ('c', 3)) t(v, o)"),
    "tpch_q21": (
        """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders,
        (SELECT l_orderkey AS k, min(l_suppkey) AS lo, max(l_suppkey) AS hi, min(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS late_lo, max(CASE WHEN l_returnflag = 'R' THEN l_suppkey END) AS late_hi FROM lineitem GROUP BY l_orderkey) o
        WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND k = l1.l_orderkey AND o_orderstatus = 'F' AND lo <> hi AND coalesce(late_lo, l1.l_suppkey) = l1.l_suppkey AND coalesce(late_hi, l1.l_suppkey) = l1.l_suppkey GROUP BY s_name""",
        """SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
        AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
        GROUP BY s_name""",
    ),
    "dialect_types": (
        "SELECT o_orderkey, o_orderkey / 7 AS q, CAST(o_totalprice AS BIGINT) AS whole, round(o_totalprice / 2, 4) AS half, CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS days FROM orders",
        "SELECT o_orderkey, o_orderkey // 7 AS q, CAST(round(o_totalprice) AS BIGINT) AS whole, round(o_totalprice / 2, 4) AS half, CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS days FROM orders",
    ),
    "dialect_string_agg": ("SELECT n_regionkey, string_agg(n_name) WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "dialect_set_order": (
        "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 5",
        "SELECT * FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer) INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 5",
    ),
    "dialect_percentiles": (
        "SELECT o_orderstatus, round(percentile_cont(0.9, o_totalprice), 4) AS a, round(quantile_cont(o_totalprice, 0.5), 4) AS b, percentile_disc(0.25, o_totalprice) AS c, quantile_disc(o_totalprice, 0.75) AS d FROM orders GROUP BY o_orderstatus",
        "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.9), 4) AS a, round(quantile_cont(o_totalprice, 0.5), 4) AS b, quantile_disc(o_totalprice, 0.25) AS c, quantile_disc(o_totalprice, 0.75) AS d FROM orders GROUP BY o_orderstatus",
    ),
    "table_read_parquet": ("SELECT r_name, count(*) AS n FROM read_parquet('{dir}/nation.parquet') JOIN read_parquet('{dir}/region.parquet') ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "table_generate_series": ("SELECT g.generate_series AS k FROM generate_series(1, 1000, 3) g UNION ALL SELECT generate_series FROM generate_series(3, 1)", "SELECT unnest(generate_series(1, 1000, 3)) AS k UNION ALL SELECT unnest([3, 2, 1])"),
    "window_null_order": (
        "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, 'click') DESC, event_id) AS rn, row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, 'click') NULLS FIRST, event_id) AS rf FROM events",
        "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, 'click') DESC NULLS FIRST, event_id) AS rn, row_number() OVER (PARTITION BY user_id ORDER BY nullif(event_type, 'click') NULLS FIRST, event_id) AS rf FROM events",
    ),
    "union_widening": ("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT s_acctbal, s_name FROM supplier ORDER BY k DESC, v LIMIT 40", "SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT s_acctbal, s_name FROM supplier ORDER BY k DESC NULLS FIRST, v LIMIT 40"),
    "metadata_counts": ("SELECT count(*) AS n, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM lineitem",) * 2,
}


def _frame_queries() -> dict:
    """name -> (DataFrame plan, the other engine's SQL)."""
    read = lambda s, d, t: session.configure(s).read.parquet(f"{d}/{t}.parquet")
    return {
        "generate_series": (lambda s, d: files.generate_series(s, 10, -10, 5), "SELECT unnest([10, 5, 0, -5, -10])::BIGINT AS generate_series"),
        "dml_update_delete": (
            lambda s, d: tables.updated(read(s, d, "customer"), {"c_acctbal": "c_acctbal + 100"}, "c_mktsegment = 'BUILDING'").filter("not coalesce(c_acctbal < 0, false)").select("c_custkey", F.round("c_acctbal", 2).alias("bal")),
            "SELECT c_custkey, round(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END, 2) AS bal FROM customer WHERE CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END >= 0",
        ),
        "dml_merge": (
            lambda s, d: tables.merged(
                read(s, d, "nation").select("n_nationkey", "n_name"), read(s, d, "nation").filter("n_nationkey > 20").select((F.col("n_nationkey") + 2).alias("n_nationkey"), F.lower("n_name").alias("n_name")),
                ["n_nationkey"], update={"n_name": "s.n_name"}, delete_when="t.n_nationkey = 23",
            ),
            "WITH s AS (SELECT n_nationkey + 2 AS k, lower(n_name) AS v FROM nation WHERE n_nationkey > 20) SELECT coalesce(n_nationkey, k) AS n_nationkey, coalesce(v, n_name) AS n_name FROM nation FULL JOIN s ON n_nationkey = k WHERE NOT (n_nationkey IS NOT NULL AND k IS NOT NULL AND n_nationkey = 23)",
        ),
        "policy_view": (
            lambda s, d: tables.secured(read(s, d, "customer"), row_filter="c_nationkey < 10", masks={"c_name": "concat(left(c_name, 3), '***')"}, deny=["c_acctbal"]),
            "SELECT c_custkey, concat(left(c_name, 3), '***') AS c_name, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey < 10",
        ),
        "cidr_join": (
            lambda s, d: tables.cidr_join(
                read(s, d, "events").select("event_id", F.expr("concat('10.', user_id div 65536, '.', user_id div 256 % 256, '.', user_id % 256)").alias("ip")),  # beyond 2 ** 24 users there is no address
                s.range(8).select(F.expr("concat('10.0.0.', id * 32, '/27')").alias("cidr")), "ip", "cidr",
            ).select("event_id", "cidr"),
            "SELECT event_id, concat('10.0.0.', user_id // 32 * 32, '/27') AS cidr FROM events WHERE user_id < 256",
        ),
        "window_tumbling": (
            lambda s, d: ingest.tumbling(read(s, d, "events")),
            "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
        ),
        "window_sliding": (
            lambda s, d: ingest.sliding(read(s, d, "events")),
            "SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS w FROM events) GROUP BY 1, 2",
        ),
        "window_sessions": (
            lambda s, d: ingest.sessions(read(s, d, "events")),
            """WITH a AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events),
            b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM b GROUP BY user_id, g""",
        ),
    }


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT, UPDATE, DELETE and MERGE as statements over a table of its own."""
    engine = _engine(spark, sf_dir, "customer nation")
    spark.sql("DROP TABLE IF EXISTS q_accounts")
    spark.sql(f"CREATE TABLE q_accounts USING parquet LOCATION '{session.work_dir(spark)}/{uuid.uuid4().hex}' AS SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer")
    engine.sql("INSERT INTO q_accounts VALUES (-1, 3, 10.0), (-2, NULL, -5.0)")
    engine.sql("UPDATE q_accounts SET balance = balance + 100, nation = coalesce(nation, 0) WHERE balance < 0")
    engine.sql("DELETE FROM q_accounts WHERE nation = 7 AND balance > 0")
    engine.sql("""MERGE INTO q_accounts AS a USING (SELECT n_nationkey - 2 AS id, n_regionkey AS region FROM nation) AS b ON a.id = b.id
        WHEN MATCHED AND a.balance > 5000 THEN DELETE WHEN MATCHED THEN UPDATE SET nation = b.region, balance = a.balance * 2
        WHEN NOT MATCHED AND b.id < 0 THEN INSERT (id, nation, balance) VALUES (b.id, b.region, 0) WHEN NOT MATCHED THEN INSERT (id, nation, balance) VALUES (b.id, b.region, 1)""".replace("WHEN NOT MATCHED AND b.id < 0 THEN INSERT (id, nation, balance) VALUES (b.id, b.region, 0) ", ""))
    return engine.sql("SELECT id, nation, round(balance, 2) AS balance FROM q_accounts")


_STATEMENTS_SQL = """WITH a AS (SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT * FROM (VALUES (-1, 3, 10.0), (-2, NULL, -5.0))),
    u AS (SELECT id, CASE WHEN balance < 0 THEN coalesce(nation, 0) ELSE nation END AS nation, CASE WHEN balance < 0 THEN balance + 100 ELSE balance END AS balance FROM a),
    d AS (SELECT * FROM u WHERE NOT coalesce(nation = 7 AND balance > 0, false)),
    s AS (SELECT n_nationkey - 2 AS k, n_regionkey AS region FROM nation)
    SELECT coalesce(id, k) AS id, coalesce(region, nation) AS nation, round(CASE WHEN id IS NULL THEN 1 WHEN k IS NULL THEN balance ELSE balance * 2 END, 2) AS balance FROM d FULL JOIN s ON id = k
    WHERE NOT coalesce(id IS NOT NULL AND k IS NOT NULL AND balance > 5000, false)"""


def _geoip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of users with the places that a small table of ranges gives."""
    engine = _engine(spark, sf_dir, "events")
    rows = [("10.0.0.0/8", "AA", "Aland", "Port", "North", "1000", 60.5, 19.5, "Europe/Mariehamn", "EU", 64500, "Wide"), ("10.0.0.128/25", "BB", "Bland", None, None, None, 1.0, 2.0, "UTC", "AF", 64501, "Narrow")]
    geoip.load(spark, spark.createDataFrame(rows, "cidr string, " + ", ".join(f"{c} {k}" for c, k in geoip.COLUMNS.items())))
    ip = "int_to_ip(167772160 + user_id)"
    return engine.sql(f"SELECT event_id, {', '.join(f'geoip_{c}({ip}) AS {c}' for c in geoip.COLUMNS)}, geoip_asn('8.8.8.8') AS none FROM events")


_GEOIP_SQL = """SELECT event_id, CASE WHEN n THEN 'BB' ELSE 'AA' END AS country, CASE WHEN n THEN 'Bland' ELSE 'Aland' END AS country_name, CASE WHEN NOT n THEN 'Port' END AS city, CASE WHEN NOT n THEN 'North' END AS subdivision,
    CASE WHEN NOT n THEN '1000' END AS postal_code, CASE WHEN n THEN 1.0 ELSE 60.5 END::DOUBLE AS latitude, CASE WHEN n THEN 2.0 ELSE 19.5 END::DOUBLE AS longitude, CASE WHEN n THEN 'UTC' ELSE 'Europe/Mariehamn' END AS timezone,
    CASE WHEN n THEN 'AF' ELSE 'EU' END AS continent, CASE WHEN n THEN 64501 ELSE 64500 END AS asn, CASE WHEN n THEN 'Narrow' ELSE 'Wide' END AS org, NULL::BIGINT AS none FROM (SELECT event_id, user_id BETWEEN 128 AND 255 AS n FROM events)"""


def _named(text: str) -> list[str]:
    """The tables a text names; only these become views."""
    return [t for t in session.TABLES if re.search(rf"\b{t}\b", text)]


def _engine(spark: SparkSession, sf_dir: str, text: str) -> Engine:
    """One engine a session; its views follow the folder asked for."""
    session.load(spark, sf_dir, _named(text))
    made = getattr(spark, "_quern_engine", None)
    if made is None:
        made = spark._quern_engine = Engine(spark)
    return made


def _own(text: str):
    return lambda spark, sf_dir: _engine(spark, sf_dir, text).sql(text.replace("{dir}", sf_dir))


def _values(family: str):
    return lambda spark, sf_dir: _engine(spark, sf_dir, "").sql(values.query(family))


def queries() -> dict:
    """Every query; all but the DataFrame plans go through the engine's dialect."""
    out = {n: _own(t) for n, t in SHARED.items()} | {n: _own(t) for n, (t, _) in OWN.items()} | {n: f for n, (f, _) in _frame_queries().items()}
    out |= {f"security_{n}": _own(security.text(n, True)) for n in security.QUERIES}
    return out | {f"values_{f}": _values(f) for f in values.CASES} | {"dml_statements": _statements, "geoip": _geoip}


def oracle_sql() -> dict[str, str]:
    out = dict(SHARED) | {n: t for n, (_, t) in OWN.items()} | {n: t for n, (_, t) in _frame_queries().items()}
    out |= {f"security_{n}": security.text(n, False) for n in security.QUERIES}
    return out | {f"values_{f}": values.oracle(f) for f in values.CASES} | {"dml_statements": _STATEMENTS_SQL, "geoip": _GEOIP_SQL}
