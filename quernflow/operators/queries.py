"""Queries over the star schema, one or more for each operator of the engine, with their oracle SQL.

Each entry names its tables and mode and gives the engine's SQL; where the oracle's dialect or semantics differ, its SQL
spells them out."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..jobs import Job, Task, Validation, run_job
from ..plans.engine import execute
from ..session import dialect_session, shared_path
from ..sources.inputs import InputFile, read_csv, read_input
from ..sources.sinks import OutputFile, write_output
from ..temporal import TemporalVariables

S, N = "strict", "native"
#: Name: (tables, mode, SQL, the oracle's SQL where it is another).
SQL: dict[str, tuple[str, str, str, str | None]] = {
    "scan_parquet_project": ("nation", S, "SELECT n_nationkey, n_name FROM nation", None),
    "select_star": ("region", S, "SELECT * FROM region", None),
    "select_table_star": ("nation region", S, "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "count_star": ("lineitem", S, "SELECT COUNT(*) AS n FROM lineitem", None),
    # filters
    "filter_cmp_and_or_not": ("lineitem", S, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 45 AND l_discount >= 0.05) OR NOT (l_tax < 0.08)", None),
    "filter_between": ("lineitem", S, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_discount NOT BETWEEN 0.02 AND 0.08", None),
    "filter_in": ("customer", S, "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')", None),
    "filter_not_in": ("part", S, "SELECT p_partkey, p_size FROM part WHERE p_size NOT IN (1, 5, 10, 15)", None),
    "filter_like": ("part", S, "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%E%' AND p_brand NOT LIKE 'Brand#1_'", None),
    "filter_is_null": ("lineitem", S, "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NULLIF(l_linenumber, 3) IS NULL AND l_shipdate IS NOT NULL", None),
    "filter_three_valued": (
        "lineitem", S,
        "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (NULLIF(l_linenumber, 2) > 3 AND l_quantity > 25) OR NULLIF(l_linenumber, 1) IN (4, NULL)", None,
    ),
    # expressions
    "arith_promotion": (
        "lineitem", S,
        "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS i, l_orderkey * 2 AS l, l_quantity - 0.5 AS d, -l_linenumber AS neg FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_linenumber + 1 AS i, l_orderkey * 2 AS l, l_quantity - 0.5::DOUBLE AS d, -l_linenumber AS neg FROM lineitem",
    ),
    "int_division": (
        "lineitem", S,
        "SELECT l_orderkey, l_linenumber, l_orderkey / 3 AS q, -l_linenumber / 2 AS h, l_linenumber / (l_linenumber - 1) AS z, l_quantity / 4 AS d, (l_quantity + 1) / (l_linenumber - l_linenumber) AS inf FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_orderkey // 3 AS q, CAST(trunc(-l_linenumber / 2) AS INTEGER) AS h, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_linenumber // (l_linenumber - 1) END AS z, l_quantity / 4 AS d, 'Infinity'::DOUBLE AS inf FROM lineitem",
    ),
    "modulo": (
        "lineitem", S,
        "SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS a, MOD(-l_linenumber, 3) AS b, l_linenumber % (l_linenumber - 2) AS z FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_orderkey % 7 AS a, (-l_linenumber) % 3 AS b, CASE WHEN l_linenumber = 2 THEN NULL ELSE l_linenumber % (l_linenumber - 2) END AS z FROM lineitem",
    ),
    "concat_op": ("nation", S, "SELECT n_name || '-' || n_regionkey AS tag, n_name || NULL AS nothing FROM nation", "SELECT n_name || '-' || n_regionkey AS tag, CAST(NULL AS VARCHAR) AS nothing FROM nation"),
    "case_searched": ("orders", S, "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'big' END AS size FROM orders", None),
    "case_simple": ("orders", S, "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders", None),
    "cast_types": (
        "lineitem", S,
        "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS i, CAST(l_linenumber AS BIGINT) AS b, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_orderkey AS STRING) AS s, CAST(l_shipdate AS DATE) AS day, CAST('True' AS BOOLEAN) AS t FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity) AS INTEGER) AS i, CAST(l_linenumber AS BIGINT) AS b, CAST(l_linenumber AS DOUBLE) AS d, CAST(l_orderkey AS VARCHAR) AS s, CAST(l_shipdate AS DATE) AS day, TRUE AS t FROM lineitem",
    ),
    "literals": ("region", S, "SELECT r_regionkey, 1 AS i, 3000000000 AS l, 1.5 AS d, 'it''s' AS s, TRUE AS t, {d '2026-01-02'} AS day FROM region", "SELECT r_regionkey, 1 AS i, 3000000000 AS l, 1.5::DOUBLE AS d, 'it''s' AS s, TRUE AS t, DATE '2026-01-02' AS day FROM region"),
    "compare_mixed_types": ("part", S, "SELECT p_partkey, p_size FROM part WHERE p_size < '9'", "SELECT p_partkey, p_size FROM part WHERE CAST(p_size AS VARCHAR) < '9'"),
    # joins
    "join_inner": ("orders customer", S, "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_left": ("customer orders", S, "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'", None),
    "join_right": ("orders customer", S, "SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT OUTER JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000", None),
    "join_full": ("supplier customer", S, "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey", None),
    "join_cross": ("nation region", S, "SELECT n.n_name, r.r_name FROM nation n CROSS JOIN region r", None),
    "join_comma": ("nation region", S, "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey", None),
    "join_multi_key": ("lineitem", S, "SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber", None),
    "join_computed_key": ("nation region", S, "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_nationkey % 5 = r.r_regionkey", None),
    "join_residual": ("orders customer", S, "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > c.c_acctbal * 30", None),
    "join_theta_small": ("nation region", S, "SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_nationkey < r.r_regionkey", None),
    "join_self": ("nation", S, "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_anti_pattern": ("customer orders", S, "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL", None),
    "join_three_way": ("customer nation region", S, "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_null_keys": ("nation region", S, "SELECT n.n_name, r.r_name FROM nation n LEFT JOIN region r ON NULLIF(n.n_regionkey, 2) = NULLIF(r.r_regionkey, 3)", None),
    # aggregates
    "agg_count_sum_avg_min_max": (
        "lineitem", S,
        "SELECT l_returnflag, COUNT(*) AS n, COUNT(NULLIF(l_linenumber, 3)) AS n3, SUM(l_linenumber) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_discount) AS lo, MAX(l_tax) AS hi FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, COUNT(*) AS n, COUNT(NULLIF(l_linenumber, 3)) AS n3, CAST(SUM(l_linenumber) AS BIGINT) AS s, ROUND(AVG(l_quantity), 6) AS a, MIN(l_discount) AS lo, MAX(l_tax) AS hi FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_count_distinct": ("lineitem", S, "SELECT l_linestatus, COUNT(DISTINCT l_quantity) AS n FROM lineitem GROUP BY l_linestatus", None),
    "agg_count_if": ("lineitem", S, "SELECT l_returnflag, COUNT_IF(NULLIF(l_linenumber, 3) > 2) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(count_if(NULLIF(l_linenumber, 3) > 2) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag"),
    "agg_stddev_var": (
        "lineitem", S,
        "SELECT l_linestatus, ROUND(STDDEV(l_quantity), 6) AS a, ROUND(STDEVP(l_quantity), 6) AS b, ROUND(VAR(l_quantity), 5) AS c, ROUND(VAR_POP(l_quantity), 5) AS d FROM lineitem GROUP BY l_linestatus",
        "SELECT l_linestatus, ROUND(stddev_samp(l_quantity), 6) AS a, ROUND(stddev_pop(l_quantity), 6) AS b, ROUND(var_samp(l_quantity), 5) AS c, ROUND(var_pop(l_quantity), 5) AS d FROM lineitem GROUP BY l_linestatus",
    ),
    "agg_covar_corr": (
        "lineitem", S,
        "SELECT l_returnflag, ROUND(COVAR_SAMP(l_quantity, l_linenumber), 5) AS a, ROUND(COVAR_POP(l_quantity, l_linenumber), 5) AS b, ROUND(CORR(l_quantity, l_extendedprice), 6) AS c, CORR(l_quantity, 1) AS none FROM lineitem GROUP BY l_returnflag",
        "SELECT l_returnflag, ROUND(covar_samp(l_quantity, l_linenumber), 5) AS a, ROUND(covar_pop(l_quantity, l_linenumber), 5) AS b, ROUND(corr(l_quantity, l_extendedprice), 6) AS c, CAST(NULL AS DOUBLE) AS none FROM lineitem GROUP BY l_returnflag",
    ),
    "agg_moment_aliases": (
        "lineitem", S,
        "SELECT l_linestatus, ROUND(STDDEV_SAMP(l_quantity), 6) AS a, ROUND(STDDEV_POP(l_quantity), 6) AS b, ROUND(VARIANCE(l_quantity), 5) AS c, ROUND(VAR_SAMP(l_quantity), 5) AS d, ROUND(VARP(l_quantity), 5) AS e FROM lineitem GROUP BY l_linestatus",
        "SELECT l_linestatus, ROUND(stddev_samp(l_quantity), 6) AS a, ROUND(stddev_pop(l_quantity), 6) AS b, ROUND(var_samp(l_quantity), 5) AS c, ROUND(var_samp(l_quantity), 5) AS d, ROUND(var_pop(l_quantity), 5) AS e FROM lineitem GROUP BY l_linestatus",
    ),
    "agg_global_empty": ("orders", S, "SELECT COUNT(*) AS n, SUM(o_custkey) AS s, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0", "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0"),
    "agg_group_expr": ("orders", S, "SELECT o_custkey % 10 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10", None),
    "agg_group_ordinal": ("customer", S, "SELECT c_mktsegment, c_nationkey, COUNT(*) AS n FROM customer GROUP BY 1, 2", None),
    "agg_having": ("orders", S, "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 100000", None),
    "agg_expr_over_agg": ("lineitem", S, "SELECT l_linenumber, SUM(l_orderkey) / COUNT(*) AS mean, COUNT(*) > 5000 AS many FROM lineitem GROUP BY l_linenumber", "SELECT l_linenumber, CAST(SUM(l_orderkey) // COUNT(*) AS BIGINT) AS mean, COUNT(*) > 5000 AS many FROM lineitem GROUP BY l_linenumber"),
    "agg_of_expr": ("lineitem", S, "SELECT l_returnflag, SUM(CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(SUM(CASE WHEN l_quantity > 30 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag"),
    "agg_null_group": ("lineitem", S, "SELECT NULLIF(l_linenumber, 3) AS k, COUNT(*) AS n FROM lineitem GROUP BY NULLIF(l_linenumber, 3)", None),
    # windows
    "win_row_number": ("orders", S, "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders", None),
    "win_rank_dense_rank": ("events", S, "SELECT event_id, RANK() OVER (PARTITION BY event_type ORDER BY user_id) AS r, DENSE_RANK() OVER (PARTITION BY event_type ORDER BY user_id) AS d FROM events", None),
    "win_lag_lead": (
        "orders", S,
        "SELECT o_orderkey, LAG(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a, LEAD(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b, LAG(o_orderkey, 1, o_custkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS c FROM orders",
        None,
    ),
    "win_running_sum": (
        "orders", S,
        "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders",
        "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM orders",
    ),
    "win_partition_aggs": (
        "customer", S,
        "SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_nationkey) AS n, MIN(c_acctbal) OVER (PARTITION BY c_nationkey) AS lo, MAX(c_acctbal) OVER (PARTITION BY c_nationkey) AS hi, ROUND(AVG(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS a, COUNT_IF(c_acctbal > 0) OVER (PARTITION BY c_nationkey) AS p FROM customer",
        "SELECT c_custkey, COUNT(*) OVER (PARTITION BY c_nationkey) AS n, MIN(c_acctbal) OVER (PARTITION BY c_nationkey) AS lo, MAX(c_acctbal) OVER (PARTITION BY c_nationkey) AS hi, ROUND(AVG(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS a, CAST(SUM(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY c_nationkey) AS BIGINT) AS p FROM customer",
    ),
    "win_sliding_rows": (
        "orders", S,
        "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM orders",
        "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM orders",
    ),
    "win_range_as_rows": (
        "orders", S,
        "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders",
        "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM orders",
    ),
    "win_single_bound": (
        "orders", S,
        "SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING) AS s, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM orders",
        "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS 2 PRECEDING) AS BIGINT) AS s, COUNT(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS n FROM orders",
    ),
    "win_running_count_distinct": (
        "events", S,
        "SELECT event_id, COUNT(DISTINCT NULLIF(event_type, 'click')) OVER (PARTITION BY user_id ORDER BY event_id) AS n, COUNT(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS w FROM events",
        "SELECT event_id, COUNT(DISTINCT NULLIF(event_type, 'click')) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n, COUNT(DISTINCT event_type) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS w FROM events",
    ),
    "win_global": ("nation", S, "SELECT n_nationkey, ROW_NUMBER() OVER (ORDER BY n_name) AS r, COUNT(*) OVER () AS n FROM nation", None),
    "win_after_group": ("orders", S, "SELECT o_custkey, COUNT(*) AS n, RANK() OVER (ORDER BY COUNT(*) DESC) AS r FROM orders GROUP BY o_custkey", None),
    "win_in_expr": ("orders", S, "SELECT o_orderkey, 2 * ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1 AS odd FROM orders", None),
    "win_count_distinct": (
        "events", S,
        "SELECT event_id, COUNT(DISTINCT event_type) OVER (PARTITION BY user_id) AS n FROM events",
        "SELECT e.event_id, d.n FROM events e JOIN (SELECT user_id, COUNT(DISTINCT event_type) AS n FROM events GROUP BY user_id) d ON e.user_id = d.user_id",
    ),
    "win_stddev": ("customer", S, "SELECT c_custkey, ROUND(STDDEV(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS s, ROUND(VARP(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS v FROM customer", "SELECT c_custkey, ROUND(stddev_samp(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS s, ROUND(var_pop(c_acctbal) OVER (PARTITION BY c_nationkey), 2) AS v FROM customer"),
    # order, limit, sets
    "sort_multi_nulls": ("customer", S, "SELECT c_custkey, NULLIF(c_nationkey, 5) AS k FROM customer ORDER BY NULLIF(c_nationkey, 5) DESC, c_custkey", None),
    "sort_unselected_key": ("customer", S, "SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20", None),
    "topk": ("orders", S, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "limit_sorted": ("customer", S, "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 7", None),
    "union_all": ("nation supplier", S, "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier", None),
    "union_distinct": ("nation supplier", S, "SELECT n_nationkey AS k FROM nation UNION SELECT s_nationkey FROM supplier", None),
    "union_chain": ("region", S, "SELECT r_regionkey AS k FROM region UNION ALL SELECT r_regionkey + 10 FROM region UNION ALL SELECT r_regionkey + 20 FROM region", None),
    "union_order_limit": ("nation supplier", S, "SELECT n_nationkey AS k FROM nation UNION ALL SELECT s_nationkey FROM supplier ORDER BY k DESC LIMIT 9", None),
    "union_arm_limit": ("nation", S, "(SELECT n_nationkey AS k FROM nation ORDER BY n_nationkey LIMIT 2) UNION ALL (SELECT n_nationkey FROM nation ORDER BY n_nationkey DESC LIMIT 3)", None),
    "distinct_rows": ("customer", S, "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", None),
    # functions
    "fn_string": (
        "part", S,
        "SELECT p_partkey, LENGTH(p_name) AS n, UPPER(p_name) AS u, LOWER(p_brand) AS l, TRIM('  ' || p_brand || ' ') AS t, SUBSTRING(p_name, -3, 4) AS a, SUBSTRING(p_name, 3) AS b, CONCAT(p_brand, NULL) AS c FROM part",
        "SELECT p_partkey, CAST(length(p_name) AS INTEGER) AS n, upper(p_name) AS u, lower(p_brand) AS l, p_brand AS t, substring(p_name, 1, 4) AS a, substring(p_name, 3) AS b, CAST(NULL AS VARCHAR) AS c FROM part",
    ),
    "fn_conditional": (
        "lineitem", S,
        "SELECT l_orderkey, l_linenumber, COALESCE(NULLIF(l_linenumber, 2), 99) AS c, IF(l_quantity > 25, 1, 0) AS i, NULLIF(l_linenumber, 3) AS n FROM lineitem",
        "SELECT l_orderkey, l_linenumber, COALESCE(NULLIF(l_linenumber, 2), 99) AS c, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS i, NULLIF(l_linenumber, 3) AS n FROM lineitem",
    ),
    "fn_rounding": (
        "customer", S,
        "SELECT c_custkey, ROUND(c_acctbal) AS r, FLOOR(c_acctbal) AS f, CEIL(c_acctbal) AS c, TRUNC(c_acctbal) AS t, SIGN(c_acctbal) AS s, ABS(c_acctbal) AS a, ROUND(-2.5) AS h FROM customer",
        "SELECT c_custkey, floor(c_acctbal + 0.5::DOUBLE) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS c, trunc(c_acctbal) + 0.0::DOUBLE AS t, CAST(sign(c_acctbal) AS INTEGER) AS s, abs(c_acctbal) AS a, -2.0::DOUBLE AS h FROM customer",
    ),
    "fn_power_log": (
        "lineitem", S,
        "SELECT l_orderkey, l_linenumber, POW(l_linenumber, 2) AS p, SQRT(l_quantity * l_quantity) AS q, ROUND(LN(l_quantity), 9) AS l, ROUND(LOG(2, l_quantity), 9) AS g, ROUND(LOG10(l_quantity), 9) AS t, LN(l_linenumber - l_linenumber) AS z, ROUND(EXP(l_discount), 9) AS e FROM lineitem",
        "SELECT l_orderkey, l_linenumber, pow(l_linenumber, 2) AS p, sqrt(l_quantity * l_quantity) AS q, floor(ln(l_quantity) * 1e9 + 0.5) / 1e9 AS l, floor(ln(l_quantity) / ln(2::DOUBLE) * 1e9 + 0.5) / 1e9 AS g, floor(log10(l_quantity) * 1e9 + 0.5) / 1e9 AS t, '-Infinity'::DOUBLE AS z, floor(exp(l_discount) * 1e9 + 0.5) / 1e9 AS e FROM lineitem",
    ),
    "fn_trig": (
        "lineitem", S,
        "SELECT l_orderkey, l_linenumber, ROUND(SIN(l_discount), 9) AS s, ROUND(COS(l_discount), 9) AS c, ROUND(TAN(l_discount), 9) AS t, ROUND(ASIN(l_discount), 9) AS a, ROUND(ATAN2(l_discount, 1), 9) AS b, ROUND(TANH(l_discount), 9) AS h, ROUND(DEGREES(l_discount), 7) AS d FROM lineitem",
        "SELECT l_orderkey, l_linenumber, floor(sin(l_discount) * 1e9 + 0.5) / 1e9 AS s, floor(cos(l_discount) * 1e9 + 0.5) / 1e9 AS c, floor(tan(l_discount) * 1e9 + 0.5) / 1e9 AS t, floor(asin(l_discount) * 1e9 + 0.5) / 1e9 AS a, floor(atan2(l_discount, 1) * 1e9 + 0.5) / 1e9 AS b, floor(tanh(l_discount) * 1e9 + 0.5) / 1e9 AS h, floor(degrees(l_discount) * 1e7 + 0.5) / 1e7 AS d FROM lineitem",
    ),
    "fn_more_math": (
        "lineitem", S,
        "SELECT l_orderkey, l_linenumber, ROUND(CBRT(l_quantity), 9) AS c, ROUND(LOG2(l_quantity), 9) AS l, ROUND(ACOS(l_discount), 9) AS a, ROUND(ATAN(l_tax), 9) AS t, ROUND(SINH(l_discount), 9) AS s, ROUND(COSH(l_discount), 9) AS h, ROUND(RADIANS(l_quantity), 9) AS r, PI() AS p, E() AS e FROM lineitem",
        "SELECT l_orderkey, l_linenumber, floor(cbrt(l_quantity) * 1e9 + 0.5) / 1e9 AS c, floor(log2(l_quantity) * 1e9 + 0.5) / 1e9 AS l, floor(acos(l_discount) * 1e9 + 0.5) / 1e9 AS a, floor(atan(l_tax) * 1e9 + 0.5) / 1e9 AS t, floor((exp(l_discount) - exp(-l_discount)) / 2 * 1e9 + 0.5) / 1e9 AS s, floor((exp(l_discount) + exp(-l_discount)) / 2 * 1e9 + 0.5) / 1e9 AS h, floor(radians(l_quantity) * 1e9 + 0.5) / 1e9 AS r, pi() AS p, exp(1::DOUBLE) AS e FROM lineitem",
    ),
    "fn_aliases": (
        "customer", S,
        "SELECT c_custkey, LEN(c_name) AS n, CEILING(c_acctbal) AS c, POWER(c_nationkey, 2) AS p, TRUNCATE(c_acctbal, 1) AS t FROM customer",
        "SELECT c_custkey, CAST(length(c_name) AS INTEGER) AS n, ceil(c_acctbal) AS c, pow(c_nationkey, 2) AS p, trunc(c_acctbal * 10) / 10 AS t FROM customer",
    ),
    "fn_clock": ("region", S, "SELECT r_regionkey, CURRENT_DATE IS NULL AS d, CURRENT_TIMESTAMP > CAST('2020-01-01T00:00:00' AS TIMESTAMP) AS t, RAND() < 1 AS r FROM region", "SELECT r_regionkey, FALSE AS d, TRUE AS t, TRUE AS r FROM region"),
    "fn_greatest_least": ("lineitem", S, "SELECT l_orderkey, l_linenumber, GREATEST(l_linenumber, NULLIF(4, l_linenumber), 3) AS g, LEAST(l_linenumber, NULL, 3) AS l FROM lineitem", "SELECT l_orderkey, l_linenumber, greatest(l_linenumber, NULLIF(4, l_linenumber), 3) AS g, least(l_linenumber, 3) AS l FROM lineitem"),
    "fn_null_propagation": ("part", S, "SELECT p_partkey, ABS(NULLIF(p_size, 1)) AS a, UPPER(NULLIF(p_brand, 'Brand#11')) AS u, NULLIF(p_size, 1) + 1 AS s FROM part", None),
    # native superset
    "native_cte_subquery": ("orders customer", N, "WITH big AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, n FROM customer JOIN big ON c_custkey = o_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", None),
    "native_intersect_except": ("nation supplier", N, "(SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT 3", None),
    # composites
    "q1_pricing": (
        "lineitem", N,
        "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(AVG(l_quantity), 6) AS avg_qty, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
        None,
    ),
    "q3_shipping": (
        "customer orders lineitem", N,
        "SELECT l_orderkey, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(o_orderdate AS DATE) AS day FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
        None,
    ),
    "q5_regional": (
        "customer orders lineitem supplier nation region", N,
        "SELECT n_name, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
        None,
    ),
    "q6_revenue": (
        "lineitem", N,
        "SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
        None,
    ),
    "pipeline_enrich_spend": (
        "orders customer", S,
        "SELECT '20260101' AS day, c.c_mktsegment AS tier, COUNT(*) AS n_orders, ROUND(SUM(o.o_totalprice), 2) AS spend FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_mktsegment",
        "SELECT '20260101' AS day, c.c_mktsegment AS tier, COUNT(*) AS n_orders, round(SUM(o.o_totalprice), 2) AS spend FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'F' GROUP BY c.c_mktsegment",
    ),
    "validation_zero_rows": ("lineitem", S, "SELECT l_orderkey FROM lineitem WHERE l_quantity < 0 OR l_orderkey IS NULL", None),
}


def _tables(spark: SparkSession, sf_dir: str, names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names.split()}


def _sql_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    tables, mode, sql, _ = SQL[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = dialect_session(spark)
        return execute(session, sql, _tables(session, sf_dir, tables), mode)

    return run


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation through the CSV sink and back."""
    df = spark.read.parquet(f"{sf_dir}/nation.parquet")
    out = shared_path(spark, "csv")
    files = write_output(df, OutputFile(out, "csv"))
    return read_csv(spark, [f"{out}/{f}" for f in files], schema=df.schema)


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    out = shared_path(spark, "parquet")
    write_output(df, OutputFile(out, "parquet", max_partitions=2))
    return spark.read.parquet(out)


def csv_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as CSV in partitions with another separator, read back by a glob with sampled types."""
    session = dialect_session(spark)
    out = shared_path(session, "csv-typed")
    orders = session.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice", "o_orderstatus", F.col("o_orderdate").cast("date").alias("day"), F.lit(True).alias("seen"))
    write_output(orders, OutputFile(out, "csv", {"delimiter": "|", "nullValue": "-"}, max_partitions=3))
    return read_input(session, InputFile("orders", f"{out}/part-*.csv", options={"delimiter": "|", "nullValue": "-"}), strict=True)


def job_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job with a validation that fails, a task that fails, and tasks that are skipped for them: names and statuses."""
    job = Job(
        inputs=(InputFile("nation", f"{sf_dir}/nation.parquet"), InputFile("gone", f"{sf_dir}/no-such-table.parquet")),
        tasks=(
            Task("fine", "SELECT n_nationkey, n_regionkey FROM nation"),
            Task("invalid", "SELECT n_nationkey FROM fine", validations=(Validation("none", "SELECT n_nationkey FROM invalid WHERE n_nationkey > 3"),)),
            Task("after_invalid", "SELECT COUNT(*) AS n FROM invalid"),
            Task("fails", "SELECT CAST(n_name AS INT) AS k FROM nation"),
            Task("after_failed", "SELECT k FROM fails"),
            Task("no_input", "SELECT * FROM gone"),
            Task("also_fine", "SELECT COUNT(*) AS n FROM fine"),
        ),
        mode="strict",
    )
    result = run_job(spark, job)
    return spark.createDataFrame([(t.name, t.status, t.rows if t.status == "Succeeded" else None) for t in result.tasks], "task string, status string, n bigint")


def templated_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template in a query over events, rendered for a fixed moment."""
    at = TemporalVariables(datetime(2026, 1, 1, 5, 30, 21, tzinfo=UTC))
    sql = at.render("SELECT event_id, '{{ today - 30 }}' AS a, '{{ iso_datetime - 1 }}' AS b, '{{ current_hour - 13 }}' AS c FROM events")
    return execute(spark, sql, _tables(spark, sf_dir, "events"), "strict")


def pipeline_dag_marts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job of staging and mart tasks with a validation; the last mart is read back from the job's output."""
    out = shared_path(spark, "job")
    job = Job(
        inputs=tuple(InputFile(t, f"{sf_dir}/{t}.parquet") for t in ("orders", "customer")),
        tasks=(
            Task("segments", "SELECT c_mktsegment, COUNT(*) AS n_customers, SUM(n_orders) AS n_orders, MAX(largest) AS largest FROM customers GROUP BY c_mktsegment", output=OutputFile(f"{out}/segments", "parquet")),
            Task(
                "customers",
                "SELECT c.c_custkey, c.c_mktsegment, COUNT(*) AS n_orders, MAX(o.o_totalprice) AS largest FROM stg_orders o JOIN stg_customers c ON o.o_custkey = c.c_custkey GROUP BY 1, 2",
                validations=(Validation("has_orders", "SELECT c_custkey FROM customers WHERE n_orders < 1"),),
            ),
            Task("stg_orders", "SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus <> 'P'"),
            Task("stg_customers", "SELECT c_custkey, c_mktsegment FROM customer"),
        ),
        mode="strict",
    )
    result = run_job(spark, job)
    if not result.succeeded:
        raise RuntimeError(result.error or "; ".join(f"{t.name}: {t.status} {t.error}" for t in result.tasks if t.error))
    return spark.read.parquet(f"{out}/segments")


def api_group_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operators by the DataFrame API: the largest order of each customer."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return orders.withColumn("r", F.row_number().over(w)).where("r = 1").select("o_custkey", "o_orderkey", "o_totalprice")


_MORE = {
    "csv_roundtrip": (csv_roundtrip, "SELECT * FROM nation"),
    "csv_inferred": (csv_inferred, "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_totalprice, o_orderstatus, CAST(o_orderdate AS DATE) AS day, TRUE AS seen FROM orders"),
    "job_statuses": (
        job_statuses,
        "SELECT * FROM (VALUES ('fine', 'Succeeded', (SELECT COUNT(*) FROM nation)), ('invalid', 'ValidationFailed', NULL), ('after_invalid', 'Skipped', NULL), ('fails', 'Failed', NULL), "
        "('after_failed', 'Skipped', NULL), ('no_input', 'Skipped', NULL), ('also_fine', 'Succeeded', 1)) AS t(task, status, n)",
    ),
    "parquet_roundtrip": (parquet_roundtrip, "SELECT * FROM supplier"),
    "templated_dates": (templated_dates, "SELECT event_id, '20251202' AS a, '2026-01-01T05:30:20' AS b, '16' AS c FROM events"),
    "pipeline_dag_marts": (
        pipeline_dag_marts,
        "WITH customers AS (SELECT c_custkey, c_mktsegment, COUNT(*) AS n_orders, MAX(o_totalprice) AS largest FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY 1, 2) "
        "SELECT c_mktsegment, COUNT(*) AS n_customers, CAST(SUM(n_orders) AS BIGINT) AS n_orders, MAX(largest) AS largest FROM customers GROUP BY c_mktsegment",
    ),
    "api_group_window": (api_group_window, "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _sql_query(n) for n in SQL} | {n: f for n, (f, _) in _MORE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: o or s for n, (_, _, s, o) in SQL.items()} | {n: o for n, (_, o) in _MORE.items()}
