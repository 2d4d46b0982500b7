"""The queries of the engine over the driver's tables, in the dialect, each with
the same question in DuckDB's SQL. Sums of doubles are rounded on both sides."""

from __future__ import annotations

import os
import uuid

from .storage import shared_dir

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations"]
#: The columns that give a table's order of insertion.
ORDER = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_linenumber"], "events": ["event_id"], "documents": ["doc_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}

FLAGSHIP = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 0 ORDER BY 1, 2
"""
FLAGSHIP_SQL = """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2
"""

# name -> (dialect, DuckDB or None where it is the dialect's own text)
QUERIES: dict[str, tuple[str, str | None]] = {
    "flagship": (FLAGSHIP, FLAGSHIP_SQL),
    # --- scans, expressions, predicates
    "scan_project": ("SELECT l_orderkey, l_linenumber, l_quantity * 2 AS q2 FROM lineitem WHERE l_quantity > 45", None),
    "filter_truthy": ("SELECT doc_id, quality FROM labels WHERE toxic", "SELECT doc_id, quality FROM labels WHERE toxic <> 0"),
    "arith_div_mod": (
        "SELECT o_orderkey, o_custkey / 7 AS d, -o_custkey / 7 AS nd, o_custkey % 7 AS m, o_custkey / 0 AS z, o_custkey % 0 AS mz, o_totalprice / 2 AS h FROM orders",
        "SELECT o_orderkey, o_custkey // 7 AS d, -(o_custkey // 7) AS nd, o_custkey % 7 AS m, CAST(NULL AS BIGINT) AS z, CAST(NULL AS BIGINT) AS mz, o_totalprice / 2 AS h FROM orders"),
    "bitwise_shift": (
        "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 1 AS o, o_orderkey << 3 AS l, o_orderkey >> 2 AS r, o_orderkey << 64 AS z, ~o_orderkey AS n FROM orders",
        "SELECT o_orderkey, o_orderkey & 255 AS a, o_orderkey | 1 AS o, o_orderkey * 8 AS l, o_orderkey // 4 AS r, CAST(0 AS BIGINT) AS z, -o_orderkey - 1 AS n FROM orders"),
    "concat_cast": (
        "SELECT c_custkey, c_name || '/' || c_custkey AS tag, CAST(c_acctbal AS INTEGER) AS whole, CAST(c_custkey AS TEXT) AS t, CAST(c_custkey AS REAL) AS r FROM customer",
        "SELECT c_custkey, c_name || '/' || c_custkey AS tag, CAST(trunc(c_acctbal) AS BIGINT) AS whole, CAST(c_custkey AS VARCHAR) AS t, CAST(c_custkey AS DOUBLE) AS r FROM customer"),
    "cast_affinity": (
        "SELECT p_partkey, CAST(substr(p_brand, 7) AS INTEGER) AS b, CAST(p_name AS INTEGER) AS zero, CAST(p_size || 'abc' AS INTEGER) AS s, CAST('1.5x' AS REAL) AS r FROM part",
        "SELECT p_partkey, coalesce(try_cast(regexp_extract(substr(p_brand, 7), '^\\s*([+-]?[0-9]+)', 1) AS BIGINT), 0) AS b, coalesce(try_cast(nullif(regexp_extract(p_name, '^\\s*([+-]?[0-9]+)', 1), '') AS BIGINT), 0) AS zero, CAST(p_size AS BIGINT) AS s, CAST(1.5 AS DOUBLE) AS r FROM part"),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS k FROM orders", None),
    "case_searched": ("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' END AS k FROM customer", None),
    "between_in": ("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (1, 2, 3)", None),
    "in_list_null": (
        "SELECT n_nationkey, n_regionkey IN (1, NULL) AS x, n_regionkey NOT IN (1, 2) AS y, n_regionkey IN () AS z FROM nation",
        "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 1 END AS x, CAST(n_regionkey NOT IN (1, 2) AS INTEGER) AS y, 0 AS z FROM nation"),
    "is_distinct": (
        "SELECT d.doc_id, l.quality IS NULL AS a, l.quality IS DISTINCT FROM 1 AS b, l.quality IS NOT 1 AS c, l.toxic IS NOT DISTINCT FROM 0 AS e FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "SELECT d.doc_id, CAST(l.quality IS NULL AS INTEGER) AS a, CAST(l.quality IS DISTINCT FROM 1 AS INTEGER) AS b, CAST(l.quality IS DISTINCT FROM 1 AS INTEGER) AS c, CAST(l.toxic IS NOT DISTINCT FROM 0 AS INTEGER) AS e FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "is_true": (
        "SELECT d.doc_id, l.quality IS TRUE AS a, l.quality IS NOT TRUE AS b, l.toxic IS FALSE AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "SELECT d.doc_id, CAST(coalesce(l.quality <> 0, false) AS INTEGER) AS a, CAST(NOT coalesce(l.quality <> 0, false) AS INTEGER) AS b, CAST(coalesce(l.toxic = 0, false) AS INTEGER) AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "three_valued": (
        "SELECT d.doc_id, (l.quality AND l.toxic) AS a, (l.quality OR NULL) AS b, NOT l.toxic AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
        "SELECT d.doc_id, CAST((l.quality <> 0 AND l.toxic <> 0) AS INTEGER) AS a, CAST((l.quality <> 0 OR NULL) AS INTEGER) AS b, CAST(NOT (l.toxic <> 0) AS INTEGER) AS c FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "cross_class": (
        "SELECT n_nationkey, n_nationkey = '1' AS a, n_nationkey < 'a' AS b, n_name > 5 AS c, n_name IN (1, 'x') AS d FROM nation",
        "SELECT n_nationkey, 0 AS a, 1 AS b, 1 AS c, CAST(n_name = 'x' AS INTEGER) AS d FROM nation"),
    "like_ci": ("SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%BRASS%' OR p_name LIKE '_a%'", "SELECT p_partkey, p_type FROM part WHERE lower(p_type) LIKE '%brass%' OR lower(p_name) LIKE '_a%'"),
    "like_escape": ("SELECT page_id FROM pages WHERE url LIKE '%utm\\_source%' ESCAPE '\\'", "SELECT page_id FROM pages WHERE lower(url) LIKE '%utm\\_source%' ESCAPE '\\'"),
    "like_escape_column": (
        "SELECT p_partkey, p_name LIKE '!' || substr(p_name, 1, 1) || '%' ESCAPE '!' AS a, 'a_b' LIKE 'A' || CASE p_size % 2 WHEN 0 THEN '!' ELSE '?' END || '_B' ESCAPE CASE p_size % 2 WHEN 0 THEN '!' ELSE '?' END AS b, 'axb' LIKE 'a' || p_size || '_b' ESCAPE substr(p_size, -1) AS c FROM part",
        "SELECT p_partkey, 1 AS a, 1 AS b, 0 AS c FROM part"),
    "glob_class": ("SELECT c_custkey FROM customer WHERE c_name GLOB '*[0-4][^5]' AND c_mktsegment GLOB '[A-M]*'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^.*[0-4][^5]$') AND regexp_matches(c_mktsegment, '^[A-M].*$')"),
    "fn_like_glob": ("SELECT p_partkey, like('%brass', p_type) AS a, glob('*BRASS', p_type) AS b, like('a!%b', 'A%B', '!') AS c, p_name GLOB substr(p_name, 1, 1) || '*' AS d FROM part",
                     "SELECT p_partkey, CAST(lower(p_type) LIKE '%brass' AS INTEGER) AS a, CAST(p_type LIKE '%BRASS' AS INTEGER) AS b, 1 AS c, 1 AS d FROM part"),
    "literals": ("SELECT n_nationkey, 0xFF + n_nationkey AS a, +n_nationkey AS b, 9223372036854775808 AS c, -9223372036854775808 AS d, 1e3 AS e, .5 AS f, 'it''s' AS g, typeof(+n_name) AS h FROM nation",
                 "SELECT n_nationkey, 255 + n_nationkey AS a, n_nationkey AS b, CAST(9223372036854775808 AS DOUBLE) AS c, CAST(-9223372036854775808 AS BIGINT) AS d, CAST(1000 AS DOUBLE) AS e, CAST(0.5 AS DOUBLE) AS f, 'it''s' AS g, 'text' AS h FROM nation"),
    "cast_numeric": ("SELECT p_partkey, CAST(p_size AS NUMERIC) AS a, CAST(p_size || '.50' AS NUMERIC) AS b, CAST('12.0' AS NUMERIC) AS c, CAST(p_retailprice AS DECIMAL) AS d FROM part",
                     "SELECT p_partkey, p_size AS a, p_size + 0.5::DOUBLE AS b, 12 AS c, p_retailprice AS d FROM part"),
    "values_top": ("VALUES (1, 'a', 2.5), (2, NULL, 3), (3, 'c', NULL)", "SELECT * FROM (VALUES (1, 'a', 2.5::DOUBLE), (2, NULL, 3), (3, 'c', NULL)) t(column1, column2, column3)"),
    "values_mixed": ("SELECT column1 AS v FROM (VALUES (2.5), ('x'), (7), (NULL), (1e15))", "SELECT v FROM (VALUES ('2.5'), ('x'), ('7'), (NULL), ('1.0e+15')) t(v)"),
    "substr_far": ("SELECT n_nationkey, substr(n_name, 9999999999) AS a, substr(n_name, -9999999999) AS b, substr(n_name, 2, 9999999999) AS c, substr(n_name, 9999999999, -9999999999) AS d FROM nation",
                   "SELECT n_nationkey, '' AS a, n_name AS b, substr(n_name, 2) AS c, n_name AS d FROM nation"),
    "star_qualified": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "values_source": ("SELECT column1 AS a, column2 AS b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) WHERE column1 > 1", "SELECT a, b FROM (VALUES (1, 'x'), (2, NULL), (3, 'z')) t(a, b) WHERE a > 1"),
    "from_less": ("SELECT 1 + 2 AS a, 'x' || 'y' AS b, NULL IS NULL AS c WHERE 1", "SELECT 3 AS a, 'xy' AS b, 1 AS c"),
    # --- joins
    "join_inner": ("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000", None),
    "join_comma_where": ("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", None),
    "join_left_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_theta": ("SELECT a.s_suppkey AS x, count(*) AS n FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal GROUP BY a.s_suppkey", None),
    "join_self": ("SELECT a.conv_id, a.turn, b.role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1", None),
    "join_derived": ("SELECT c_name, t.n FROM customer JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) t ON c_custkey = t.k", None),
    "join_chain": (
        "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None),
    "semi_exists": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)", None),
    "anti_not_exists": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    "in_sub": ("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')", None),
    "anti_not_in_null": ("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", None),
    # --- aggregates
    "agg_implicit_empty": ("SELECT count(*) AS n, sum(o_totalprice) AS s, total(o_totalprice) AS t, avg(o_totalprice) AS a, max(o_orderkey) AS m FROM orders WHERE o_orderkey < 0",
                           "SELECT 0 AS n, CAST(NULL AS DOUBLE) AS s, CAST(0 AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS a, CAST(NULL AS BIGINT) AS m"),
    "agg_group_having": ("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 12", None),
    "agg_group_position": ("SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, p", "SELECT o_orderstatus, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2"),
    "agg_total_avg": ("SELECT event_type, round(total(value), 4) AS t, round(avg(value), 6) AS a, count(value) AS n FROM events GROUP BY event_type", "SELECT event_type, round(coalesce(sum(value), 0), 4) AS t, round(avg(value), 6) AS a, count(value) AS n FROM events GROUP BY event_type"),
    "agg_minmax": ("SELECT c_mktsegment, min(c_name) AS a, max(c_name) AS b, min(c_acctbal) AS c, max(c_acctbal) AS d FROM customer GROUP BY c_mktsegment", None),
    "agg_distinct": ("SELECT event_type, count(DISTINCT user_id) AS u, sum(DISTINCT user_id % 10) AS s FROM events GROUP BY event_type", "SELECT event_type, count(DISTINCT user_id) AS u, CAST(sum(DISTINCT user_id % 10) AS BIGINT) AS s FROM events GROUP BY event_type"),
    "agg_group_concat": ("SELECT conv_id, group_concat(role, '>') AS roles, string_agg(turn, ',') AS turns FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) AS turns FROM conversations GROUP BY conv_id"),
    "agg_concat_row_sep": ("SELECT conv_id, group_concat(turn, role) AS t FROM conversations GROUP BY conv_id", "SELECT conv_id, string_agg(CASE WHEN k = 1 THEN '' ELSE role END || CAST(turn AS VARCHAR), '' ORDER BY turn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id"),
    "agg_bare_first": ("SELECT o_custkey, o_orderkey, o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey", "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, count(*) AS n FROM orders GROUP BY o_custkey"),
    "agg_order_by_agg": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 20", None),
    "agg_nocase_group": ("SELECT lower(p_brand) COLLATE NOCASE AS b, count(*) AS n, max(p_type COLLATE NOCASE) AS t FROM part GROUP BY 1", "SELECT lower(p_brand) AS b, count(*) AS n, arg_max(p_type, lower(p_type)) AS t FROM part GROUP BY 1"),
    "agg_expression": ("SELECT o_orderstatus, count(*) * 2 + max(o_orderkey) AS x, CASE WHEN count(*) > 100 THEN 'many' ELSE 'few' END AS k FROM orders GROUP BY o_orderstatus", None),
    "agg_int_sum": ("SELECT l_returnflag, sum(l_linenumber) AS s, sum(l_linenumber) / count(*) AS d FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, CAST(sum(l_linenumber) // count(*) AS BIGINT) AS d FROM lineitem GROUP BY l_returnflag"),
    # --- order, limit, distinct
    "order_nulls": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality, d.doc_id", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality NULLS FIRST, d.doc_id"),
    "order_nulls_last": ("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY l.quality ASC NULLS LAST, d.doc_id DESC", None),
    "order_position_alias": ("SELECT c_custkey AS k, c_acctbal AS b FROM customer ORDER BY 2 DESC, k", None),
    "order_stable": ("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderkey"),
    "order_expression": ("SELECT p_partkey FROM part ORDER BY p_size % 7, length(p_name), p_partkey", None),
    "topk": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10", None),
    "limit_comma": ("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 5, 7", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7 OFFSET 5"),
    "limit_negative": ("SELECT n_nationkey FROM nation ORDER BY 1 LIMIT -1 OFFSET 3", "SELECT n_nationkey FROM nation ORDER BY 1 OFFSET 3"),
    "limit_expression": ("SELECT c_custkey FROM customer ORDER BY 1 LIMIT (SELECT count(*) FROM region) + '2'", "SELECT c_custkey FROM customer ORDER BY 1 LIMIT 7"),
    "distinct_rows": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "distinct_order_other": (
        "SELECT DISTINCT o_custkey, o_orderstatus FROM orders ORDER BY o_totalprice % 1000 DESC, o_custkey LIMIT 100",
        "SELECT o_custkey, o_orderstatus FROM orders GROUP BY 1, 2 ORDER BY arg_min(CAST(trunc(o_totalprice) % 1000 AS DOUBLE), o_orderkey) DESC, o_custkey LIMIT 100"),
    "distinct_nocase": ("SELECT DISTINCT upper(event_type) COLLATE NOCASE AS e FROM events", "SELECT DISTINCT upper(event_type) AS e FROM events"),
    "collate_compare": ("SELECT c_custkey FROM customer WHERE c_mktsegment = 'building' COLLATE NOCASE AND c_name || '  ' = c_name COLLATE RTRIM", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'"),
    # --- set operations
    "union_all": ("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier", None),
    "union_distinct": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000", None),
    "setop_left_assoc": ("SELECT n_nationkey AS k FROM nation UNION SELECT 99 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT 3 ORDER BY k LIMIT 10", "SELECT * FROM (((SELECT n_nationkey AS k FROM nation UNION SELECT 99) INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT 3) ORDER BY k LIMIT 10"),
    "setop_collation": ("SELECT upper(event_type) COLLATE NOCASE AS e FROM events UNION SELECT event_type FROM events", "SELECT DISTINCT upper(event_type) AS e FROM events"),
    "setop_except_collation": ("SELECT n_name COLLATE NOCASE AS e FROM nation EXCEPT SELECT lower(n_name) FROM nation WHERE n_nationkey > 5", "SELECT n_name AS e FROM nation WHERE n_nationkey <= 5"),
    # --- subqueries and CTEs
    "scalar_sub": ("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)", None),
    "scalar_sub_correlated": ("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS m FROM customer", None),
    "scalar_sub_first": ("SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS r FROM nation", None),
    "in_sub_projection": ("SELECT n_nationkey, n_nationkey IN (SELECT s_nationkey FROM supplier) AS i, n_nationkey NOT IN (SELECT quality FROM labels UNION ALL SELECT NULL) AS j FROM nation",
                          "SELECT n_nationkey, CAST(n_nationkey IN (SELECT s_nationkey FROM supplier) AS INTEGER) AS i, CASE WHEN n_nationkey IN (SELECT quality FROM labels) THEN 0 END AS j FROM nation"),
    "exists_projection": ("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS e FROM customer", "SELECT c_custkey, CAST(EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS INTEGER) AS e FROM customer"),
    "derived_nested": ("SELECT k, n FROM (SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) WHERE n > 10) WHERE n % 2 = 0", None),
    "cte_chain": ("WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS s FROM orders GROUP BY 1), b AS (SELECT k FROM a WHERE s > 500000) SELECT c_name FROM customer JOIN b ON c_custkey = k", None),
    "cte_values_rename": ("WITH v(a, b) AS (VALUES (1, 'one'), (2, 'two')) SELECT b, r_name FROM v JOIN region ON r_regionkey = a", None),
    "cte_recursive_all": ("WITH RECURSIVE c(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM c WHERE n < 60) SELECT n, n * n AS s FROM c", None),
    "cte_recursive_distinct": ("WITH RECURSIVE c(n) AS (SELECT 1 UNION SELECT (n * 3) % 25 FROM c) SELECT n FROM c", None),
    "cte_once": ("WITH x AS (SELECT random() AS r) SELECT a.r = b.r AS same FROM x a, x b", "SELECT 1 AS same"),
    "cte_thrice": (
        "WITH g AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) SELECT a.k, a.n FROM g a JOIN g b ON a.k = b.k WHERE a.n = (SELECT max(n) FROM g)", None),
    "cte_in_from": ("SELECT t.k FROM (WITH a AS (SELECT n_regionkey AS k FROM nation) SELECT k, count(*) AS n FROM a GROUP BY k) t WHERE t.n = 5", "SELECT n_regionkey AS k FROM nation GROUP BY 1 HAVING count(*) = 5"),
    # --- functions
    "fn_text": (
        "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, octet_length(p_name) AS o, replace(p_type, 'A', '--') AS r, instr(p_name, 'a') AS i, trim(p_brand, 'Band#') AS t FROM part",
        "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, strlen(p_name) AS o, replace(p_type, 'A', '--') AS r, instr(p_name, 'a') AS i, trim(p_brand, 'Band#') AS t FROM part"),
    "fn_substr": (
        "SELECT p_partkey, substr(p_name, 3, 4) AS a, substr(p_name, 0, 3) AS b, substr(p_name, -4, 2) AS c, substr(p_name, 4, -2) AS d, substr(p_name, 5) AS e FROM part",
        "SELECT p_partkey, substr(p_name, 3, 4) AS a, substr(p_name, 1, 2) AS b, substr(p_name, length(p_name) - 3, 2) AS c, substr(p_name, 2, 2) AS d, substr(p_name, 5) AS e FROM part"),
    "fn_long_text": ("SELECT doc_id, length(text) AS n, octet_length(text) AS o, instr(text, 'License') AS i, unicode(text) AS u FROM documents", "SELECT doc_id, length(text) AS n, strlen(text) AS o, instr(text, 'License') AS i, unicode(text) AS u FROM documents"),
    "fn_hex": ("SELECT c_custkey, hex(c_mktsegment) AS h, hex(c_custkey) AS k, unhex(hex(c_mktsegment)) = c_mktsegment AS eq, quote(c_name) AS q FROM customer",
               "SELECT c_custkey, hex(c_mktsegment) AS h, hex(CAST(c_custkey AS VARCHAR)) AS k, 0 AS eq, '''' || c_name || '''' AS q FROM customer"),
    "fn_concat": ("SELECT d.doc_id, concat(lang, l.quality, source) AS c, concat_ws('-', l.quality, lang, NULL, source) AS w FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
                  "SELECT d.doc_id, concat(lang, l.quality, source) AS c, concat_ws('-', l.quality, lang, NULL, source) AS w FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "fn_nulls": ("SELECT d.doc_id, coalesce(l.quality, -1) AS a, ifnull(l.toxic, 9) AS b, nullif(l.quality, 1) AS c, iif(l.quality, 'good', 'bad') AS e, typeof(l.quality) AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
                 "SELECT d.doc_id, coalesce(l.quality, -1) AS a, ifnull(l.toxic, 9) AS b, nullif(l.quality, 1) AS c, CASE WHEN l.quality <> 0 THEN 'good' ELSE 'bad' END AS e, CASE WHEN l.quality IS NULL THEN 'null' ELSE 'integer' END AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "fn_scalar_minmax": ("SELECT d.doc_id, min(d.doc_id, 50, n_chars) AS a, max(l.quality, 0) AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
                         "SELECT d.doc_id, least(d.doc_id, 50, n_chars) AS a, CASE WHEN l.quality IS NOT NULL THEN greatest(l.quality, 0) END AS b FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "fn_char": ("SELECT n_nationkey, char(n_nationkey + 65, 233, 128512) AS c, unicode(n_name) AS u FROM nation", "SELECT n_nationkey, chr(n_nationkey + 65) || chr(233) || chr(128512) AS c, unicode(n_name) AS u FROM nation"),
    "fn_math_domain": (
        "SELECT c_custkey, round(sqrt(c_acctbal), 6) AS s, round(ln(c_acctbal), 6) AS l, round(log(c_acctbal), 6) AS g, round(log(2, c_custkey), 6) AS b, acos(c_custkey) AS a FROM customer",
        "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) END AS s, CASE WHEN c_acctbal > 0 THEN round(ln(c_acctbal), 6) END AS l, CASE WHEN c_acctbal > 0 THEN round(log10(c_acctbal), 6) END AS g, CASE WHEN c_custkey > 0 THEN round(ln(c_custkey) / ln(2), 6) END AS b, CASE WHEN c_custkey BETWEEN -1 AND 1 THEN acos(c_custkey) END AS a FROM customer"),
    "fn_trig": ("SELECT s_suppkey, round(sin(s_suppkey), 9) AS a, round(cos(s_suppkey), 9) AS b, round(atan2(s_suppkey, 3), 9) AS c, round(degrees(1.5), 9) AS d, round(tanh(0.5), 9) AS e, round(asinh(s_suppkey), 9) AS f, round(exp(0.5), 9) AS g, round(pow(s_suppkey, 2), 3) AS h, pi() AS p FROM supplier",
                "SELECT s_suppkey, round(sin(s_suppkey), 9) AS a, round(cos(s_suppkey), 9) AS b, round(atan2(s_suppkey, 3), 9) AS c, round(degrees(1.5::DOUBLE), 9) AS d, round(tanh(0.5::DOUBLE), 9) AS e, round(asinh(s_suppkey), 9) AS f, round(exp(0.5::DOUBLE), 9) AS g, round(pow(s_suppkey, 2), 3) AS h, pi() AS p FROM supplier"),
    "fn_math_more": (
        "SELECT s_suppkey, round(log10(s_suppkey), 9) AS a, round(log2(s_suppkey), 9) AS b, round(tan(s_suppkey), 6) AS c, round(asin(1.0 / s_suppkey), 9) AS d, round(atan(s_suppkey), 9) AS e, round(sinh(1.0 / s_suppkey), 9) AS f, round(cosh(1.0 / s_suppkey), 9) AS g, "
        "round(acosh(s_suppkey), 9) AS h, round(atanh(0.9 / s_suppkey), 9) AS i, round(radians(s_suppkey), 9) AS j, asin(s_suppkey + 1) AS k, acosh(0) AS l, atanh(2) AS m, log2(-s_suppkey) AS n, tan('4x') AS o, sin('0') AS p FROM (SELECT s_suppkey + 1 AS s_suppkey FROM supplier) s",
        "SELECT s_suppkey, round(log10(s_suppkey), 9) AS a, round(log2(s_suppkey), 9) AS b, round(tan(s_suppkey), 6) AS c, round(asin(1.0::DOUBLE / s_suppkey), 9) AS d, round(atan(s_suppkey), 9) AS e, round(sinh(1.0::DOUBLE / s_suppkey), 9) AS f, round(cosh(1.0::DOUBLE / s_suppkey), 9) AS g, "
        "round(acosh(s_suppkey), 9) AS h, round(atanh(0.9::DOUBLE / s_suppkey), 9) AS i, round(radians(s_suppkey), 9) AS j, CAST(NULL AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS l, CAST(NULL AS DOUBLE) AS m, CAST(NULL AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS o, CAST(0 AS DOUBLE) AS p FROM (SELECT s_suppkey + 1 AS s_suppkey FROM supplier) s"),
    "fn_rounding": ("SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, trunc(c_acctbal) AS t, sign(c_acctbal) AS s, mod(c_custkey, 7) AS m, abs(c_acctbal) AS a, round(c_acctbal) AS r, floor(c_custkey) AS i FROM customer",
                    "SELECT c_custkey, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, trunc(c_acctbal) AS t, CAST(sign(c_acctbal) AS BIGINT) AS s, CAST(c_custkey % 7 AS DOUBLE) AS m, abs(c_acctbal) AS a, round(c_acctbal) AS r, c_custkey AS i FROM customer"),
    # the decimal expansion of a double is finite, so its third digit after the point decides exactly
    "fn_round_exact": (
        "SELECT l_orderkey, l_linenumber, round(l_extendedprice * l_discount, 2) AS r FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(CAST(substr(x, 1, strpos(x, '.') + 2) AS DECIMAL(30, 2)) + CASE WHEN substr(x, strpos(x, '.') + 3, 1) >= '5' THEN 0.01 ELSE 0 END AS DOUBLE) AS r "
        "FROM (SELECT l_orderkey, l_linenumber, printf('%.70f', l_extendedprice * l_discount) AS x FROM lineitem)"),
    "fn_round_far": ("SELECT event_id, round(value * 1e13, 4) AS a, round(value, 20) AS b, round(-value, 1) AS c FROM events",
                     "SELECT event_id, value * 1e13::DOUBLE AS a, value AS b, -CAST(CAST(substr(x, 1, strpos(x, '.') + 1) AS DECIMAL(30, 1)) + CASE WHEN substr(x, strpos(x, '.') + 2, 1) >= '5' THEN 0.1 ELSE 0 END AS DOUBLE) AS c "
                     "FROM (SELECT event_id, value, printf('%.70f', value) AS x FROM events)"),
    "fn_date_format": (
        "SELECT o_orderkey, date(o_orderdate) AS d, datetime(o_orderdate) AS t, strftime('%Y/%m/%d %H:%M %j', o_orderdate) AS f, strftime('%w', o_orderdate) AS w, unixepoch(o_orderdate) AS u FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS t, strftime(o_orderdate, '%Y/%m/%d %H:%M %j') AS f, CAST(dayofweek(o_orderdate) AS VARCHAR) AS w, CAST(epoch(o_orderdate) AS BIGINT) AS u FROM orders"),
    "fn_date_modifiers": (
        "SELECT o_orderkey, date(o_orderdate, '+10 days') AS a, date(o_orderdate, 'start of month', '-1 day') AS b, date(o_orderdate, 'start of year', '+1 year') AS c, datetime(o_orderdate, '-90 minutes') AS d FROM orders",
        "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%Y-%m-%d') AS a, strftime(date_trunc('month', o_orderdate) - INTERVAL 1 DAY, '%Y-%m-%d') AS b, strftime(date_trunc('year', o_orderdate) + INTERVAL 1 YEAR, '%Y-%m-%d') AS c, strftime(o_orderdate - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS d FROM orders"),
    "fn_month_overflow": ("SELECT o_orderkey, date(o_orderdate, '+1 month') AS a FROM orders", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH + to_days(CAST(day(o_orderdate) - 1 AS INTEGER)), '%Y-%m-%d') AS a FROM orders"),
    "fn_weekday": ("SELECT o_orderkey, date(o_orderdate, 'weekday 3') AS a FROM orders", "SELECT o_orderkey, strftime(o_orderdate + to_days(CAST((3 - dayofweek(o_orderdate) + 7) % 7 AS INTEGER)), '%Y-%m-%d') AS a FROM orders"),
    "fn_julianday": ("SELECT o_orderkey, round(julianday(o_orderdate), 5) AS j FROM orders", "SELECT o_orderkey, round(epoch(o_orderdate) / 86400.0::DOUBLE + 2440587.5::DOUBLE, 5) AS j FROM orders"),
    "fn_iso_week": ("SELECT o_orderkey, strftime('%G-W%V-%u', o_orderdate) AS w FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V-%u') AS w FROM orders"),
    "fn_epoch": ("SELECT event_id, datetime(event_id * 1000, 'unixepoch') AS t, strftime('%H:%M:%f', ts) AS f FROM events", "SELECT event_id, strftime(make_timestamp(event_id * 1000 * 1000000), '%Y-%m-%d %H:%M:%S') AS t, strftime(ts, '%H:%M:') || lpad(CAST(second(ts) AS VARCHAR), 2, '0') || '.' || lpad(CAST(millisecond(ts) % 1000 AS VARCHAR), 3, '0') AS f FROM events"),
    # from the first of a year on, what is added is what the date's parts count
    "fn_timediff": ("SELECT o_orderkey, timediff(o_orderdate, '1990-01-01') AS d FROM orders",
                    "SELECT o_orderkey, printf('+%04d-%02d-%02d ', year(o_orderdate) - 1990, month(o_orderdate) - 1, day(o_orderdate) - 1) || strftime(o_orderdate, '%H:%M:%S') || '.000' AS d FROM orders"),
    "fn_time": ("SELECT event_id, time(ts) AS a, time(ts, '-90 minutes') AS b, date(ts, 'start of month', 'weekday 1') AS c, datetime(ts, 'start of day', '+36 hours') AS d FROM events",
                "SELECT event_id, strftime(ts, '%H:%M:%S') AS a, strftime(date_trunc('millisecond', ts) - INTERVAL 90 MINUTE, '%H:%M:%S') AS b, strftime(date_trunc('month', ts) + to_days(CAST((8 - dayofweek(date_trunc('month', ts))) % 7 AS INTEGER)), '%Y-%m-%d') AS c, strftime(date_trunc('day', ts) + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS d FROM events"),
    "fn_time_parse": (
        "SELECT o_orderkey, datetime(date(o_orderdate) || 'T01:02+03:00') AS a, datetime(date(o_orderdate) || ' 23:59:59.5Z', 'subsec') AS b, time('12:34', 'noon') AS c, unixepoch(date(o_orderdate), 'subsecond') AS d, date(date(o_orderdate) || 'x') AS e FROM orders",
        "SELECT o_orderkey, strftime(date_trunc('day', o_orderdate) - INTERVAL 118 MINUTE, '%Y-%m-%d %H:%M:%S') AS a, strftime(o_orderdate, '%Y-%m-%d') || ' 23:59:59.500' AS b, CAST(NULL AS VARCHAR) AS c, CAST(epoch(date_trunc('day', o_orderdate)) AS DOUBLE) AS d, CAST(NULL AS VARCHAR) AS e FROM orders"),
    "fn_time_numbers": (
        "SELECT event_id, datetime(event_id + 1000000000, 'auto') AS a, date(2450000.5 + event_id % 1000, 'auto') AS b, date(2450000.5 + event_id % 1000) AS c, date('2450000.5', 'julianday') AS d, date('2024-01-31', '+1 month', 'floor') AS e, date('2024-01-31', '+1 month', 'ceiling') AS f FROM events",
        "SELECT event_id, strftime(make_timestamp((event_id + 1000000000) * 1000000), '%Y-%m-%d %H:%M:%S') AS a, strftime(DATE '1995-10-10' + CAST(event_id % 1000 AS INTEGER), '%Y-%m-%d') AS b, strftime(DATE '1995-10-10' + CAST(event_id % 1000 AS INTEGER), '%Y-%m-%d') AS c, '1995-10-10' AS d, '2024-03-02' AS e, '2024-03-02' AS f FROM events"),
    "fn_weeks": ("SELECT o_orderkey, strftime('%U|%W|%u|%w|%j|%e|%I|%p|%s', o_orderdate) AS w FROM orders",
                 "SELECT o_orderkey, strftime(o_orderdate, '%U|%W|%u|%w|%j|') || lpad(CAST(day(o_orderdate) AS VARCHAR), 2, ' ') || strftime(o_orderdate, '|%I|%p|') || CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS w FROM orders"),
    "fn_printf": ("SELECT c_custkey, printf('%05d|%-12s|%8.2f|%x', c_custkey, c_mktsegment, c_acctbal, c_custkey) AS p FROM customer",
                  "SELECT c_custkey, format('{:05d}|{:<12s}|{:8.2f}|{:x}', c_custkey, c_mktsegment, c_acctbal, c_custkey) AS p FROM customer"),
    "fn_printf_text": (
        "SELECT c_custkey, printf('%q|%Q|%w|%c|%%|%z|%.3s|%-6c|', c_name || '''', c_name || '''', c_name || '\"', c_mktsegment, c_name, c_mktsegment, c_name) AS p, printf('%Q %s', NULL, NULL) AS n FROM customer",
        "SELECT c_custkey, c_name || '''''|''' || c_name || '''''''|' || c_name || '\"\"|' || substr(c_mktsegment, 1, 1) || '|%|' || c_name || '|' || substr(c_mktsegment, 1, 3) || '|' || substr(c_name, 1, 1) || '     |' AS p, 'NULL ' AS n FROM customer"),
    "fn_printf_number": (
        "SELECT c_custkey, printf('%r|%e|%.3E|%g|%p|%#x|%o|%+d|%u', c_custkey, c_acctbal, c_acctbal, c_custkey, c_custkey, c_custkey + 1, c_custkey, c_custkey, c_custkey) AS p FROM customer",
        "SELECT c_custkey, c_custkey || CASE WHEN c_custkey % 100 BETWEEN 11 AND 13 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END || '|' || format('{:.6e}|{:.3E}|{:g}|{:X}|{:#x}|{:o}|{:+d}|{}', c_acctbal, c_acctbal, CAST(c_custkey AS DOUBLE), c_custkey, c_custkey + 1, c_custkey, c_custkey, c_custkey) AS p FROM customer"),
    # columns of reals that hold nulls
    "real_nulls": (
        "SELECT c_custkey, quote(r) AS q, hex(r) AS h, coalesce(r, 'none') AS c, ifnull(r, 'x') AS i, json_array(r, 1) AS j, json_object('v', r) AS o, r || '!' AS t, concat(r, '/', c_custkey) AS n, concat_ws('-', r, 'z') AS w, printf('%s', r) AS p, trim(r) AS m, max(r, 'a') AS g, length(r) AS l "
        "FROM customer LEFT JOIN (SELECT s_suppkey AS k, s_acctbal AS r FROM supplier) s ON c_custkey = k",
        "SELECT c_custkey, coalesce(v, 'NULL') AS q, coalesce(hex(v), '') AS h, coalesce(v, 'none') AS c, coalesce(v, 'x') AS i, '[' || coalesce(v, 'null') || ',1]' AS j, '{\"v\":' || coalesce(v, 'null') || '}' AS o, v || '!' AS t, concat(v, '/', c_custkey) AS n, concat_ws('-', v, 'z') AS w, v AS p, v AS m, CASE WHEN v IS NOT NULL THEN 'a' END AS g, length(v) AS l "
        "FROM (SELECT c_custkey, CAST(s_acctbal AS VARCHAR) AS v FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey)"),
    "real_nulls_concat": (
        "SELECT c_nationkey, group_concat(r, ';') AS g, count(r) AS n FROM (SELECT c_custkey, c_nationkey, s_acctbal AS r FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey ORDER BY c_custkey) GROUP BY c_nationkey HAVING count(r) < 2",
        "SELECT c_nationkey, string_agg(CAST(s_acctbal AS VARCHAR), ';') AS g, count(s_acctbal) AS n FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey GROUP BY c_nationkey HAVING count(s_acctbal) < 2"),
    "fn_json": ("SELECT c_custkey, json_array(c_custkey, c_mktsegment, NULL) AS a, json_object('k', c_custkey, 's', c_mktsegment) AS o, json_quote(c_name) AS q FROM customer",
                "SELECT c_custkey, '[' || c_custkey || ',\"' || c_mktsegment || '\",null]' AS a, '{\"k\":' || c_custkey || ',\"s\":\"' || c_mktsegment || '\"}' AS o, '\"' || c_name || '\"' AS q FROM customer"),
    "fn_real_text": ("SELECT c_custkey, c_acctbal || '' AS t, (c_custkey * 1.0) || '' AS u FROM customer", "SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS t, CAST(c_custkey * 1.0::DOUBLE AS VARCHAR) AS u FROM customer"),
    "fn_blob": ("SELECT n_nationkey, length(zeroblob(n_nationkey)) AS z, hex(substr(x'0102030405', 2, 3)) AS s, typeof(x'00') AS t, length(randomblob(4)) AS r FROM nation", "SELECT n_nationkey, n_nationkey AS z, '020304' AS s, 'blob' AS t, 4 AS r FROM nation"),
    "fn_session": ("SELECT sqlite_compileoption_used('X') AS u, sqlite_compileoption_get(0) AS g, changes() AS c, total_changes() AS t, last_insert_rowid() AS l", "SELECT 0 AS u, CAST(NULL AS VARCHAR) AS g, 0 AS c, 0 AS t, 0 AS l"),
}

# name -> (script whose last statement is the result, DuckDB)
SCRIPTS: dict[str, tuple[str, str | None]] = {
    "dml_insert_select": (
        "CREATE TABLE t(k INTEGER PRIMARY KEY, name TEXT, bal REAL); INSERT INTO t SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0; SELECT k, name, bal FROM t",
        "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal FROM customer WHERE c_acctbal > 0"),
    "dml_update": (
        "CREATE TABLE t(k INTEGER PRIMARY KEY, seg TEXT, bal REAL); INSERT INTO t SELECT c_custkey, c_mktsegment, c_acctbal FROM customer; UPDATE t SET bal = bal * 2, seg = upper(seg) || '!' WHERE bal > 5000; SELECT * FROM t",
        "SELECT c_custkey AS k, CASE WHEN c_acctbal > 5000 THEN upper(c_mktsegment) || '!' ELSE c_mktsegment END AS seg, CASE WHEN c_acctbal > 5000 THEN c_acctbal * 2 ELSE c_acctbal END AS bal FROM customer"),
    "dml_delete": (
        "CREATE TABLE t(k INTEGER PRIMARY KEY, bal REAL); INSERT INTO t SELECT c_custkey, c_acctbal FROM customer; DELETE FROM t WHERE bal < 0 OR k IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000); SELECT * FROM t",
        "SELECT c_custkey AS k, c_acctbal AS bal FROM customer WHERE NOT (c_acctbal < 0 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000))"),
    "dml_or_ignore": (
        "CREATE TABLE t(k INTEGER PRIMARY KEY, s TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10; INSERT OR IGNORE INTO t SELECT n_nationkey, 'new' FROM nation; SELECT * FROM t",
        "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 10 THEN n_name ELSE 'new' END AS s FROM nation"),
    "dml_or_replace": (
        "CREATE TABLE t(k INTEGER PRIMARY KEY, s TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation; INSERT OR REPLACE INTO t SELECT n_nationkey, 'new' FROM nation WHERE n_nationkey < 10; SELECT * FROM t",
        "SELECT n_nationkey AS k, CASE WHEN n_nationkey < 10 THEN 'new' ELSE n_name END AS s FROM nation"),
    "dml_returning": (
        "CREATE TABLE t(k INTEGER PRIMARY KEY, s TEXT); INSERT INTO t SELECT n_nationkey, n_name FROM nation; DELETE FROM t WHERE k % 2 = 0 RETURNING k * 10 AS x, s",
        "SELECT n_nationkey * 10 AS x, n_name AS s FROM nation WHERE n_nationkey % 2 = 0"),
    "dml_check_not_null": (
        "CREATE TABLE t(k INTEGER NOT NULL, b REAL CHECK(b > 1000)); INSERT OR IGNORE INTO t SELECT c_custkey, c_acctbal FROM customer; SELECT * FROM t",
        "SELECT c_custkey AS k, c_acctbal AS b FROM customer WHERE c_acctbal > 1000"),
    "tx_rollback": (
        "CREATE TABLE t(k INTEGER PRIMARY KEY); INSERT INTO t SELECT n_nationkey FROM nation; BEGIN; DELETE FROM t; ROLLBACK; SAVEPOINT a; DELETE FROM t WHERE k > 5; ROLLBACK TO a; SELECT count(*) AS n FROM t",
        "SELECT count(*) AS n FROM nation"),
    "session_counters": (
        "CREATE TABLE t(k INTEGER PRIMARY KEY, s TEXT); INSERT INTO t SELECT n_nationkey + 1, n_name FROM nation; INSERT INTO t(s) VALUES ('one'), ('two'); UPDATE t SET s = lower(s) WHERE k <= 10; SELECT changes() AS c, total_changes() AS t, last_insert_rowid() AS l, (SELECT count(*) FROM t) AS n",
        "SELECT 10 AS c, count(*) + 12 AS t, max(n_nationkey) + 3 AS l, count(*) + 2 AS n FROM nation"),
    "dml_columns": (
        "CREATE TABLE t(a INTEGER PRIMARY KEY, b TEXT, c REAL); INSERT INTO t(c, b) SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey; SELECT a, b, c FROM t",
        "SELECT row_number() OVER (ORDER BY n_nationkey) AS a, n_name AS b, CAST(n_nationkey AS DOUBLE) AS c FROM nation"),
    "dml_update_in": (
        "CREATE TABLE t(k INTEGER PRIMARY KEY, s TEXT); INSERT INTO t SELECT c_custkey, c_name FROM customer; UPDATE t SET s = 'ordered' WHERE k IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000); SELECT * FROM t",
        "SELECT c_custkey AS k, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) THEN 'ordered' ELSE c_name END AS s FROM customer"),
    "pragma_user_version": ("PRAGMA user_version = 42; PRAGMA user_version", "SELECT 42 AS user_version"),
    "catalog_tables": ("CREATE TABLE zz(a); SELECT name, tbl_name FROM sqlite_schema WHERE name = 'zz'", "SELECT 'zz' AS name, 'zz' AS tbl_name"),
    "with_dml": (
        "CREATE TABLE t(k INTEGER PRIMARY KEY, n INTEGER); WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) INSERT INTO t SELECT k, n FROM a; SELECT * FROM t WHERE n > 12",
        "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
}


# name -> (script that makes tables, script on the file that they are written to, DuckDB)
FILES: dict[str, tuple[str, str, str]] = {
    "file_scan": (
        "CREATE TABLE c(k INTEGER PRIMARY KEY, name TEXT, bal REAL, note TEXT); INSERT INTO c SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 50 = 0 THEN replace(printf('%5000d', c_custkey), ' ', 'long') END FROM customer",
        "SELECT k, name, bal, length(note) AS n, substr(note, -3) AS e FROM c",
        "SELECT c_custkey AS k, c_name AS name, c_acctbal AS bal, CASE WHEN c_custkey % 50 = 0 THEN 4 * 5000 - 3 * length(CAST(c_custkey AS VARCHAR)) END AS n, CASE WHEN c_custkey % 50 = 0 THEN right(repeat('long', 5) || c_custkey, 3) END AS e FROM customer"),
    "file_catalog": ("CREATE TABLE b(x TEXT); CREATE TABLE a(y INTEGER)", "SELECT name, sql FROM sqlite_schema WHERE type = 'table'", "SELECT * FROM (VALUES ('a', 'CREATE TABLE a(y INTEGER)'), ('b', 'CREATE TABLE b(x TEXT)')) t(name, sql)"),
    "file_dml": (
        "CREATE TABLE n(k INTEGER PRIMARY KEY, s TEXT); INSERT INTO n SELECT n_nationkey, n_name FROM nation",
        "BEGIN; INSERT INTO n(s) VALUES ('ATLANTIS'); UPDATE n SET s = lower(s) WHERE k < 5; COMMIT; DELETE FROM n WHERE k BETWEEN 10 AND 12; CREATE TABLE m(a TEXT); INSERT INTO m SELECT s FROM n WHERE k > 20; SELECT k, s FROM n UNION ALL SELECT 1000, a FROM m",
        "WITH n AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey < 5 THEN lower(n_name) ELSE n_name END AS s FROM nation WHERE n_nationkey NOT BETWEEN 10 AND 12 UNION ALL SELECT max(n_nationkey) + 1, 'ATLANTIS' FROM nation) SELECT k, s FROM n UNION ALL SELECT 1000, s FROM n WHERE k > 20"),
}


def open_session(spark, sf_dir: str):
    from .session import Session

    return Session(spark).load(sf_dir, TABLES, ORDER)


def queries() -> dict:
    def one(text):
        return lambda spark, sf_dir: open_session(spark, sf_dir).sql(text)

    def many(text):
        return lambda spark, sf_dir: open_session(spark, sf_dir).script(text)[-1]

    def in_file(name, before, after):
        def run(spark, sf_dir):
            from .session import Session

            path = f"{shared_dir(spark)}/files/{name}-{uuid.uuid4().hex}.db".removeprefix("file:").replace("///", "/")
            os.makedirs(os.path.dirname(path), exist_ok=True)
            first = open_session(spark, sf_dir)
            first.script(before)
            first.save(path)
            return Session(spark).attach(path, write=name == "file_dml").script(after)[-1]

        return run

    return {k: one(q) for k, (q, _) in QUERIES.items()} | {k: many(q) for k, (q, _) in SCRIPTS.items()} | {k: in_file(k, a, b) for k, (a, b, _) in FILES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB's text, or the dialect's where both agree on it."""
    texts = QUERIES | SCRIPTS | {k: (b, sql) for k, (_, b, sql) in FILES.items()}
    return {k: (q if sql is None else sql) for k, (q, sql) in texts.items()}
