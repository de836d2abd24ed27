"""The query catalogue: statements of each operator over the sample tables, and DuckDB SQL for
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators import dml, partition, window
from shardloom.plans import govern
from shardloom.plans.engine import Engine
from shardloom.session import TABLES, load
from shardloom.sources import endpoints, layout, rules
from shardloom.sources.rules import Level, ShardingRule, shard_column

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}

ORDERS_TABLE = ShardingRule("orders", ("ds0",), tables=Level("o_orderkey", 4))
ORDERS_DATABASE = ShardingRule("orders", ("ds0", "ds1"), database=Level("o_custkey", 2))
ORDERS_BOTH = ShardingRule("orders", ("ds0", "ds1"), Level("o_custkey", 2), Level("o_orderkey", 4))
LINES_TABLE = ShardingRule("lineitem", ("ds0",), tables=Level("l_orderkey", 4))
#: Both dealt by the order's key, to the same number of buckets.
ORDERS_BUCKETS = ShardingRule("orders", ("ds0",), tables=Level("o_orderkey", 2), buckets=4)
LINES_BUCKETS = ShardingRule("lineitem", ("ds0",), tables=Level("l_orderkey", 2), buckets=4)


def _named(sql: str) -> list[str]:
    return [t for t in TABLES if re.search(rf"\b{t}\b", sql)]


def _sql(key: str, statement: str, oracle: str | None = "", rules: dict | None = None, args: list | None = None) -> None:
    """A statement in the engine's dialect; without an oracle of its own, it is its own."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for name in _named(statement):
            engine.add(name, load(spark, sf_dir, name), (rules or {}).get(name))
        return engine.query(statement, args)

    _QUERIES[key] = run
    if oracle is not None:
        _ORACLES[key] = oracle or statement


def _frame(key: str, oracle: str | None = None):
    """A query built with the DataFrame API."""

    def add(make: Callable) -> Callable:
        _QUERIES[key] = make
        if oracle:
            _ORACLES[key] = oracle
        return make

    return add


# -- the flagship: H7, J1, A1, A9, A12, A13, A21, A27, O1, O2, M1-M6

_FLAGSHIP = """
SELECT c_mktsegment, COUNT(*) AS n_orders, ROUND(SUM(o_totalprice), 2) AS revenue, ROUND(AVG(o_totalprice), 4) AS avg_price,
  MIN(o_totalprice) AS least, MAX(o_totalprice) AS most
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'
GROUP BY c_mktsegment HAVING COUNT(*) > 5 ORDER BY revenue DESC LIMIT 10"""
_sql("sharded_revenue_by_segment", _FLAGSHIP, rules={"orders": ORDERS_BOTH})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["sharded_revenue_by_segment"](spark, sf_dir)


# -- scans and projection: S1-S13, P1-P5

_sql("scan_sharded", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders", rules={"orders": ORDERS_BOTH})
_sql("scan_alias", "SELECT o.o_orderkey, o.o_orderstatus FROM orders AS o USE INDEX (PRIMARY) WHERE o.o_orderstatus = 'F'", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
_sql("scan_partition", "SELECT o_orderkey FROM orders PARTITION (orders_00001, orders_00003)", "SELECT o_orderkey FROM orders WHERE o_orderkey % 4 IN (1, 3)", rules={"orders": ORDERS_TABLE})
_sql("select_dual", "SELECT 1 + 2 AS three, 'a' 'b' AS ab, 0x1F AS hex_, b'101' AS bits FROM DUAL", "SELECT 3 AS three, 'ab' AS ab, 31 AS hex_, 5 AS bits")
_sql("derived_table", "SELECT d.k, d.n FROM (SELECT o_custkey, COUNT(*) FROM orders GROUP BY o_custkey) AS d(k, n) WHERE d.n > 12")
_sql("explicit_table", "TABLE region ORDER BY r_regionkey LIMIT 3", "SELECT * FROM region ORDER BY r_regionkey LIMIT 3")
_sql("values_ctor", "VALUES ROW(1, 'a'), ROW(2, 'b')", "SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(column_0, column_1)")
_sql(
    "json_table",
    """SELECT e.event_id, j.pos, j.k, j.has_k, j.miss FROM events e,
       JSON_TABLE(e.props, '$' COLUMNS (pos FOR ORDINALITY, k INT PATH '$.k', has_k INT EXISTS PATH '$.k', miss VARCHAR(9) PATH '$.none' DEFAULT 'none' ON EMPTY)) AS j""",
    "SELECT event_id, 1 AS pos, CAST(json_extract_string(props, '$.k') AS INT) AS k, 1 AS has_k, 'none' AS miss FROM events",
)
_sql(
    "json_table_array",
    """SELECT n.n_nationkey, j.pos, j.x, j.y FROM nation n, JSON_TABLE(CONCAT('[{"a":', n.n_nationkey, ',"b":[1,2]},{"a":7,"b":[3]}]'), '$[*]'
       COLUMNS (pos FOR ORDINALITY, x INT PATH '$.a', NESTED PATH '$.b[*]' COLUMNS (y INT PATH '$'))) AS j""",
    """SELECT n_nationkey, pos, CASE WHEN pos = 1 THEN n_nationkey ELSE 7 END AS x, y FROM nation, (VALUES (1, 1), (1, 2), (2, 3)) AS v(pos, y)""",
)
_sql("project_alias", "SELECT o_orderkey AS id, o_totalprice * 2 AS 'twice' FROM orders", "SELECT o_orderkey AS id, o_totalprice * 2 AS twice FROM orders")
_sql("project_star", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
_sql("distinct_rows", "SELECT DISTINCTROW o_orderstatus, o_orderpriority FROM orders", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", rules={"orders": ORDERS_TABLE})
_sql("select_modifiers", "SELECT HIGH_PRIORITY SQL_NO_CACHE COUNT(*) AS n FROM orders FOR UPDATE", "SELECT COUNT(*) AS n FROM orders")

# -- filters: F1-F31

_sql("filter_basic", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O' || o_orderkey < 5", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'O') OR o_orderkey < 5")
_sql("filter_xor", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000 XOR o_orderstatus = 'F'", "SELECT o_orderkey FROM orders WHERE (o_totalprice > 200000) <> (o_orderstatus = 'F')")
_sql("filter_is_truth", "SELECT o_orderkey, (NULLIF(o_orderstatus, 'F') = 'O') IS UNKNOWN AS u FROM orders WHERE (NULLIF(o_orderstatus, 'F') = 'O') IS NOT TRUE", "SELECT o_orderkey, (NULLIF(o_orderstatus, 'F') = 'O') IS NULL AS u FROM orders WHERE (NULLIF(o_orderstatus, 'F') = 'O') IS DISTINCT FROM TRUE")
_sql("filter_null", "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NULL")
_sql("filter_compare", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000.5 && o_totalprice <= 90000 AND o_orderstatus != 'P' AND NOT o_orderkey = 7", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000.5 AND o_totalprice <= 90000 AND o_orderstatus <> 'P' AND o_orderkey <> 7")
_sql("null_safe_eq", "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') <=> NULLIF('F', 'F')", "SELECT o_orderkey FROM orders WHERE NULLIF(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL")
_sql("quantified_all", "SELECT o_orderkey FROM orders WHERE o_totalprice > ALL (SELECT c_acctbal * 30 FROM customer)", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT max(c_acctbal * 30) FROM customer)")
_sql("quantified_any", "SELECT o_orderkey FROM orders WHERE o_custkey = ANY (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_totalprice < SOME (SELECT c_acctbal * 9 FROM customer)", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_totalprice < (SELECT max(c_acctbal * 9) FROM customer)")
_sql("quantified_empty", "SELECT n_name, n_nationkey > ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 99) AS a, n_nationkey > ANY (SELECT NULLIF(r_regionkey, 1) FROM region) AS b FROM nation", "SELECT n_name, true AS a, CASE WHEN n_nationkey > 0 THEN true END AS b FROM nation")
_sql("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
_sql("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
_sql("filter_in_list", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_custkey NOT IN (1, 2, 3)")
_sql("row_in", "SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '5-LOW'), ('O', '1-URGENT')) AND ROW(o_orderkey, 1) <> ROW(5, 1)", "SELECT o_orderkey FROM orders WHERE ((o_orderstatus = 'F' AND o_orderpriority = '5-LOW') OR (o_orderstatus = 'O' AND o_orderpriority = '1-URGENT')) AND o_orderkey <> 5")
_sql("json_member_of", "SELECT n_nationkey FROM nation WHERE n_nationkey MEMBER OF('[1, 3, 5, 99]')", "SELECT n_nationkey FROM nation WHERE n_nationkey IN (1, 3, 5)")
_sql("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_discount NOT BETWEEN 0.02 AND 0.08")
_sql("sounds_like", "SELECT p_partkey FROM part WHERE p_name SOUNDS LIKE 'smal ring'", None)
_sql("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_type NOT LIKE 'E|_%' ESCAPE '|'")
_sql("filter_regexp", "SELECT p_partkey FROM part WHERE p_brand REGEXP '^Brand#1[0-9]$' AND p_name NOT REGEXP 'widget'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '^Brand#1[0-9]$') AND NOT regexp_matches(p_name, 'widget')")
_sql("exists_corr", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
_sql("scalar_subquery", "SELECT o_orderkey, ROUND(o_totalprice - (SELECT AVG(o_totalprice) FROM orders), 2) AS above FROM orders WHERE o_orderkey < 100")
_sql("scalar_subquery_all", "SELECT o_orderkey, ROUND(o_totalprice - (SELECT AVG(o_totalprice) FROM orders), 2) AS above FROM orders")
_sql("bit_ops", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, o_orderkey ^ 5 AS c, o_orderkey << 2 AS d, o_orderkey >> 1 AS e, ~o_orderkey AS f FROM orders", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 3 AS b, xor(o_orderkey, 5) AS c, o_orderkey << 2 AS d, o_orderkey >> 1 AS e, -o_orderkey - 1 AS f FROM orders")
_sql("arith_ops", "SELECT l_orderkey, l_linenumber, l_quantity / (l_linenumber - 1) AS q, l_orderkey DIV 7 AS d, l_orderkey MOD 7 AS m, l_orderkey % (l_linenumber - 1) AS z, -l_linenumber AS neg FROM lineitem", "SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_linenumber - 1, 0) AS q, l_orderkey // 7 AS d, l_orderkey % 7 AS m, l_orderkey % nullif(l_linenumber - 1, 0) AS z, -l_linenumber AS neg FROM lineitem")
_sql("date_interval", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b, INTERVAL '1 2' DAY_HOUR + o_orderdate AS c FROM orders", "SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS a, o_orderdate - INTERVAL 2 MONTH AS b, o_orderdate + INTERVAL 26 HOUR AS c FROM orders")
_sql("collate_ci", "SELECT c_custkey FROM customer WHERE c_mktsegment COLLATE utf8mb4_general_ci = 'machinery'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'machinery'")
_sql("case_when", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'part' END AS s, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS big FROM orders")
_sql("fulltext_match", "SELECT doc_id, MATCH(text) AGAINST('the license version') AS score FROM documents WHERE MATCH(text) AGAINST('license') > 0", "SELECT doc_id, CAST(len(list_intersect(w, ['the', 'license', 'version'])) AS DOUBLE) AS score FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+') AS w FROM documents) WHERE list_contains(w, 'license')")
_sql("fulltext_boolean", "SELECT doc_id FROM documents WHERE MATCH(text) AGAINST('+license -version' IN BOOLEAN MODE) > 0", "SELECT doc_id FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+') AS w FROM documents) WHERE list_contains(w, 'license') AND NOT list_contains(w, 'version')")
_sql("prepared_query", "SELECT o_orderkey FROM orders WHERE o_custkey = ? AND o_orderstatus <> ?", "SELECT o_orderkey FROM orders WHERE o_custkey = 42 AND o_orderstatus <> 'F'", rules={"orders": ORDERS_BOTH}, args=[42, "F"])
_sql("json_arrow_text", "SELECT n_nationkey, d->'$.a' AS quoted, d->>'$.a' AS plain, d->'$.b' AS n FROM (SELECT n_nationkey, CONCAT('{\"a\":\"', n_name, '\",\"b\":[', n_regionkey, ']}') AS d FROM nation) t", "SELECT n_nationkey, '\"' || n_name || '\"' AS quoted, n_name AS plain, '[' || n_regionkey || ']' AS n FROM nation")
_sql(
    "fn_json_objects",
    """SELECT n_nationkey, JSON_LENGTH(d) AS n, JSON_CONTAINS(d, '{"k":3}') AS has, JSON_TYPE(JSON_EXTRACT(d, '$.name')) AS ty, JSON_UNQUOTE(JSON_EXTRACT(d, '$.name')) AS u, JSON_VALUE(JSON_SET(d, '$.k', n_regionkey), '$.k') AS s, JSON_REMOVE(d, '$.name') AS r,
       JSON_MERGE_PATCH(d, '{"name":null}') AS p, JSON_CONTAINS_PATH(d, 'all', '$.k', '$.none') AS c FROM (SELECT n_nationkey, n_regionkey, CONCAT('{"k":', n_nationkey, ',"name":"', n_name, '"}') AS d FROM nation) t""",
    """SELECT n_nationkey, 2 AS n, n_nationkey = 3 AS has, 'STRING' AS ty, n_name AS u, CAST(n_regionkey AS VARCHAR) AS s, '{"k":' || n_nationkey || '}' AS r, '{"k":' || n_nationkey || '}' AS p, false AS c FROM nation""",
)
_sql("filter_xor_numbers", "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 XOR o_custkey % 3 AND o_totalprice > 100000", "SELECT o_orderkey FROM orders WHERE (o_orderkey % 2 <> 0) <> (o_custkey % 3 <> 0 AND o_totalprice > 100000)")
_sql("cast_exact", "SELECT o_orderkey, CAST(o_orderkey + 9007199254740992 AS SIGNED) AS big, CAST(CONCAT(o_orderkey, 'abc') AS SIGNED) AS lead, CAST(-o_orderkey AS UNSIGNED) AS u FROM orders", "SELECT o_orderkey, o_orderkey + 9007199254740992 AS big, o_orderkey AS lead, CAST(18446744073709551616 - CAST(o_orderkey AS HUGEINT) AS DECIMAL(20,0)) AS u FROM orders WHERE o_orderkey > 0 UNION ALL SELECT o_orderkey, 9007199254740992, 0, 0 FROM orders WHERE o_orderkey = 0")
_sql(
    "win_exclude_peers_sql",
    "SELECT o_orderkey, SUM(o_custkey) OVER (ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS g, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS t FROM orders",
    "SELECT o_orderkey, CAST(SUM(o_custkey) OVER (ORDER BY o_orderpriority RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS BIGINT) AS g, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE TIES) AS t FROM orders",
)
_sql("win_nth_from_last_sql", "SELECT o_orderkey, NTH_VALUE(o_totalprice, 2) FROM LAST OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders", "SELECT o_orderkey, NTH_VALUE(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 FOLLOWING) AS v FROM orders")
_sql("json_arrow", "SELECT event_id, props->'$.k' AS a, props->>'$.k' AS b FROM events WHERE CAST(props->>'$.k' AS SIGNED) > 50", "SELECT event_id, json_extract_string(props, '$.k') AS a, json_extract_string(props, '$.k') AS b FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50")

# -- joins: J1-J15

_sql("join_inner_equi", "SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey")
_sql("join_theta", "SELECT a.n_name AS x, b.r_name AS y FROM nation a JOIN region b ON a.n_regionkey < b.r_regionkey")
_sql("join_using", "SELECT k, c_name, n FROM (SELECT c_custkey AS k, c_name FROM customer) a JOIN (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) b USING (k)")
_sql("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000")
_sql("join_right", "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'")
_sql("join_left_using", "SELECT k, n_name, s FROM (SELECT n_nationkey AS k, n_name FROM nation) a LEFT JOIN (SELECT s_nationkey AS k, COUNT(*) AS s FROM supplier GROUP BY s_nationkey) b USING (k)")
_sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_nationkey < 7")
_sql("join_cross_all", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_sql("join_natural", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) y")
_sql("join_straight", "SELECT STRAIGHT_JOIN n_name, r_name FROM nation STRAIGHT_JOIN region ON n_regionkey = r_regionkey", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
_sql("join_comma", "SELECT s_name, n_name FROM supplier, nation WHERE s_nationkey = n_nationkey")
_sql("join_nested", "SELECT c_name, n_name, r_name FROM customer JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON c_nationkey = n_nationkey WHERE c_acctbal > 5000")
_sql("join_odbc", "SELECT n_name, r_name FROM {OJ nation LEFT JOIN region ON n_regionkey = r_regionkey} WHERE {d '2024-01-01'} < {ts '2024-01-02 00:00:00'}", "SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
_sql("join_lateral", "SELECT c.c_custkey, t.most FROM customer c, LATERAL (SELECT MAX(o.o_totalprice) AS most FROM orders o WHERE o.o_custkey = c.c_custkey) AS t WHERE c.c_custkey < 300", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer WHERE c_custkey < 300")
_sql("join_lateral_all", "SELECT c.c_custkey, t.most FROM customer c, LATERAL (SELECT MAX(o.o_totalprice) AS most FROM orders o WHERE o.o_custkey = c.c_custkey) AS t", "SELECT c_custkey, (SELECT MAX(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS most FROM customer")
_sql("semi_join", "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49)")
_sql("anti_join", "SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p.p_partkey AND l_quantity > 45)")
_sql("join_self", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_sql("join_range", "SELECT p_partkey, r_name FROM part JOIN region ON p_size BETWEEN r_regionkey * 10 AND r_regionkey * 10 + 4")
_sql("join_colocated", "SELECT o_orderkey, COUNT(*) AS n, ROUND(SUM(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey", rules={"orders": ORDERS_BUCKETS, "lineitem": LINES_BUCKETS})

# -- aggregation: A1-A31, M1-M6, M11

_R = {"lineitem": LINES_TABLE, "orders": ORDERS_BOTH}
_sql("agg_count", "SELECT COUNT(*) AS n, COUNT(NULLIF(o_orderstatus, 'F')) AS m FROM orders", rules=_R)
_sql("agg_sum", "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS q, SUM(l_linenumber) AS n FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(SUM(l_quantity), 2) AS q, CAST(SUM(l_linenumber) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag", rules=_R)
_sql("agg_min", "SELECT o_orderstatus, MIN(o_totalprice) AS a, MIN(o_orderdate) AS b, MIN(o_orderpriority) AS c FROM orders GROUP BY o_orderstatus", rules=_R)
_sql("agg_max", "SELECT o_orderstatus, MAX(o_totalprice) AS a, MAX(o_orderdate) AS b, MAX(DISTINCT o_orderpriority) AS c FROM orders GROUP BY o_orderstatus", rules=_R)
_sql("agg_avg", "SELECT l_returnflag, ROUND(AVG(l_extendedprice), 4) AS a, ROUND(AVG(l_discount), 4) AS b FROM lineitem GROUP BY l_returnflag", rules=_R)
_sql("agg_avg_distinct", "SELECT l_returnflag, ROUND(AVG(DISTINCT l_quantity), 4) AS a FROM lineitem GROUP BY l_returnflag", rules=_R)
_sql("agg_sum_distinct", "SELECT l_linestatus, SUM(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, CAST(SUM(DISTINCT l_linenumber) AS BIGINT) AS a FROM lineitem GROUP BY l_linestatus", rules=_R)
_sql("agg_count_distinct", "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", rules=_R)
_sql("agg_count_distinct_multi", "SELECT COUNT(DISTINCT o_custkey, NULLIF(o_orderstatus, 'F')) AS n FROM orders", "SELECT COUNT(DISTINCT (o_custkey, o_orderstatus)) AS n FROM orders WHERE o_orderstatus <> 'F'", rules=_R)
_sql("agg_bit", "SELECT o_orderstatus, BIT_AND(o_orderkey | 8) AS a, BIT_OR(o_custkey) AS o, BIT_XOR(o_orderkey) AS x FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, BIT_AND(o_orderkey | 8) AS a, BIT_OR(o_custkey) AS o, BIT_XOR(o_orderkey) AS x FROM orders GROUP BY o_orderstatus")
_sql("agg_bit_empty", "SELECT BIT_OR(o_orderkey) AS o, BIT_XOR(o_orderkey) AS x FROM orders WHERE o_orderkey < 0", "SELECT CAST(0 AS BIGINT) AS o, CAST(0 AS BIGINT) AS x")
_sql("agg_json_array", "SELECT n_regionkey, JSON_ARRAYAGG(n_nationkey) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS j FROM nation GROUP BY n_regionkey")
_sql("agg_json_object", "SELECT n_regionkey, JSON_OBJECTAGG(n_name, n_nationkey) AS j FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' ORDER BY n_name) || '}' AS j FROM nation GROUP BY n_regionkey")
_sql("agg_variance", "SELECT l_returnflag, ROUND(VARIANCE(l_quantity), 4) AS a, ROUND(VAR_POP(l_quantity), 4) AS b, ROUND(VAR_SAMP(l_quantity), 4) AS c FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(VAR_POP(l_quantity), 4) AS a, ROUND(VAR_POP(l_quantity), 4) AS b, ROUND(VAR_SAMP(l_quantity), 4) AS c FROM lineitem GROUP BY l_returnflag")
_sql("agg_stddev", "SELECT l_returnflag, ROUND(STD(l_quantity), 4) AS a, ROUND(STDDEV(l_quantity), 4) AS b, ROUND(STDDEV_SAMP(l_quantity), 4) AS c FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(STDDEV_POP(l_quantity), 4) AS a, ROUND(STDDEV_POP(l_quantity), 4) AS b, ROUND(STDDEV_SAMP(l_quantity), 4) AS c FROM lineitem GROUP BY l_returnflag")
_sql("agg_group_concat", "SELECT o_orderstatus, GROUP_CONCAT(DISTINCT o_orderpriority ORDER BY o_orderpriority SEPARATOR '; ') AS g FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS g FROM orders GROUP BY o_orderstatus", rules=_R)
_sql("agg_st_collect", "SELECT n_regionkey, CARDINALITY(ST_COLLECT(POINT(n_nationkey, 1))) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, CAST(COUNT(*) AS INT) AS n FROM nation GROUP BY n_regionkey")
_sql("agg_any_value", "SELECT n_regionkey, ANY_VALUE(r_name) AS r FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey", "SELECT r_regionkey AS n_regionkey, r_name AS r FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
_sql("group_by_single", "SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY o_orderpriority", rules=_R)
_sql("group_by_multi", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS net FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", rules=_R)
_sql("group_by_expr", "SELECT YEAR(o_orderdate) AS y, o_custkey % 5 AS b, COUNT(*) AS n FROM orders GROUP BY YEAR(o_orderdate), o_custkey % 5", "SELECT CAST(YEAR(o_orderdate) AS INT) AS y, o_custkey % 5 AS b, COUNT(*) AS n FROM orders GROUP BY ALL")
_sql("group_by_having", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING n > 10 AND SUM(o_totalprice) > 1000000", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING COUNT(*) > 10 AND SUM(o_totalprice) > 1000000", rules=_R)
_sql("group_by_unselected", "SELECT COUNT(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus", rules=_R)
_sql("group_rollup", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", rules=_R)
_sql("group_rollup_grouping", "SELECT l_returnflag, GROUPING(l_returnflag) AS g, ROUND(AVG(l_tax), 4) AS a FROM lineitem GROUP BY l_returnflag WITH ROLLUP", "SELECT l_returnflag, CAST(GROUPING(l_returnflag) AS TINYINT) AS g, ROUND(AVG(l_tax), 4) AS a FROM lineitem GROUP BY ROLLUP (l_returnflag)", rules=_R)

_sql("group_rollup_bitmask", "SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag, l_linestatus) AS g, COUNT(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus WITH ROLLUP", "SELECT l_returnflag, l_linestatus, CAST(GROUPING(l_returnflag, l_linestatus) AS BIGINT) AS g, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", rules=_R)

# -- windows: W1-W18

_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
for _key, _call in {
    "win_row_number": "CAST(ROW_NUMBER() {w} AS SIGNED)", "win_rank": "CAST(RANK() {w} AS SIGNED)", "win_dense_rank": "CAST(DENSE_RANK() {w} AS SIGNED)", "win_cume_dist": "ROUND(CUME_DIST() {w}, 6)", "win_percent_rank": "ROUND(PERCENT_RANK() {w}, 6)",
    "win_ntile": "CAST(NTILE(3) {w} AS SIGNED)", "win_lead": "LEAD(o_totalprice, 1, -1.0) {w}", "win_lag": "LAG(o_totalprice, 2) {w}", "win_first_value": "FIRST_VALUE(o_totalprice) {w}",
    "win_agg_running": "ROUND(SUM(o_totalprice) {w}, 2)",
}.items():
    _text = f"SELECT o_orderkey, {_call.format(w=_W)} AS v FROM orders"
    _sql(_key, _text, _text.replace("AS SIGNED", "AS BIGINT"), rules={"orders": ORDERS_DATABASE})
_sql("win_last_value", "SELECT o_orderkey, LAST_VALUE(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders")
_sql("win_nth_value", "SELECT o_orderkey, NTH_VALUE(o_totalprice, 2) FROM FIRST OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders", "SELECT o_orderkey, NTH_VALUE(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders")
_sql("win_ignore_nulls", "SELECT o_orderkey, LAG(NULLIF(o_orderstatus, 'F'), 1) IGNORE NULLS OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders", "SELECT o_orderkey, LAG(NULLIF(o_orderstatus, 'F'), 1 IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS v FROM orders")
_sql("win_agg_partition", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_custkey) AS n, AVG(o_orderkey) OVER (PARTITION BY o_custkey) AS a, o_totalprice - MAX(o_totalprice) OVER (PARTITION BY o_custkey) AS d FROM orders")
_sql("win_named", "SELECT o_orderkey, SUM(o_orderkey) OVER w - o_orderkey AS s, COUNT(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER w - o_orderkey AS BIGINT) AS s, COUNT(*) OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_sql("win_rows_frame", "SELECT o_orderkey, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS v FROM orders")
_sql("win_range_frame", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey RANGE BETWEEN 3 PRECEDING AND CURRENT ROW) AS v FROM orders")
_sql("win_range_interval", "SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS v FROM events")


_sql(
    "win_groups_sql",
    "SELECT o.o_orderkey, COUNT(*) OVER (PARTITION BY o.o_orderstatus ORDER BY o.o_custkey GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS v FROM orders o WHERE o.o_totalprice > 50000",
    "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS v FROM orders WHERE o_totalprice > 50000",
    rules={"orders": ORDERS_BOTH},
)
_E = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)"
_sql(
    "win_exclude_sql",
    f"SELECT o_orderkey, SUM(o_custkey + o_orderkey) {_E} AS s, COUNT(*) {_E} AS n, MIN(o_totalprice) {_E} AS lo, MAX(o_totalprice) {_E} AS hi, AVG(o_orderkey) {_E} AS a FROM orders",
    f"SELECT o_orderkey, CAST(SUM(o_custkey + o_orderkey) {_E} AS BIGINT) AS s, COUNT(*) {_E} AS n, MIN(o_totalprice) {_E} AS lo, MAX(o_totalprice) {_E} AS hi, AVG(o_orderkey) {_E} AS a FROM orders",
)


@_frame("win_groups_frame", "SELECT o_orderkey, CAST(SUM(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_custkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS v FROM orders")
def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "orders")
    return window.groups_frame(df, ["o_orderstatus"], [F.col("o_custkey")], -1, 0, v=F.sum("o_orderkey")).select("o_orderkey", "v")


_EXCLUDE = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING EXCLUDE CURRENT ROW)"


@_frame("win_exclude_current", f"SELECT o_orderkey, CAST(SUM(o_orderkey) {_EXCLUDE} AS BIGINT) AS sum_, COUNT(o_orderkey) {_EXCLUDE} AS count_, MIN(o_orderkey) {_EXCLUDE} AS min_, MAX(o_orderkey) {_EXCLUDE} AS max_ FROM orders")
def _exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = window.exclude_current(load(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], -2, 2, "o_orderkey")
    return found.select("o_orderkey", "sum_", "count_", "min_", "max_")


_PEERS = "OVER (PARTITION BY o_orderstatus ORDER BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE {})"


@_frame("win_exclude_peers", f"SELECT o_orderkey, COUNT(o_orderkey) {_PEERS.format('GROUP')} AS g, COUNT(o_orderkey) {_PEERS.format('TIES')} AS t FROM orders")
def _exclude_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, order, low, high = load(spark, sf_dir, "orders"), [F.col("o_custkey")], window.PRECEDING, window.FOLLOWING
    g = window.exclude_current(df, ["o_orderstatus"], order, low, high, "o_orderkey", "group").select("o_orderkey", F.col("count_").alias("g"))
    t = window.exclude_current(df, ["o_orderstatus"], order, low, high, "o_orderkey", "ties").select("o_orderkey", F.col("count_").alias("t"))
    return g.join(t, "o_orderkey")


@_frame("win_nth_from_last", "SELECT o_orderkey, NTH_VALUE(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS v FROM orders")
def _from_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", window.nth_from_last(F.col("o_totalprice"), 2, ["o_custkey"], [F.desc("o_orderkey")]).alias("v"))


# -- sorting and limits: O1-O8, M7, M11

_sql("order_by_single", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey", rules=_R)
_sql("order_by_multi", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_orderkey ASC", rules=_R)
_sql("order_by_expr", "SELECT o_orderkey FROM orders ORDER BY o_orderkey % 10, -o_orderkey LIMIT 50", rules=_R)
_sql("order_by_unselected", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 25", rules=_R)
_sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", rules=_R)
_sql("limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 10", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 20", rules=_R)
_sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 10 OFFSET 5", rules=_R)
_sql("topk_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2", rules=_R)

# -- set operations, CTEs, subqueries: U1-U9

_sql("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
_sql("union_all", "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
_sql("union_order_limit", "(SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) UNION ALL (SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 3) ORDER BY o_orderkey", rules=_R)
_sql("cte_basic", "WITH big(k, p) AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000) SELECT k, COUNT(*) AS n FROM big GROUP BY k")
_sql("cte_multi", "WITH a AS (SELECT n_nationkey, n_regionkey FROM nation), b AS (SELECT n_regionkey, COUNT(*) AS n FROM a GROUP BY n_regionkey) SELECT r_name, n FROM b JOIN region ON n_regionkey = r_regionkey")
_sql("cte_recursive", "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 8) SELECT n, f FROM t")
_sql("correlated_scalar", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * AVG(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
_sql("nested_subquery", "SELECT c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 10)))", rules=_R)

# -- functions: SF1-SF16, DF1-DF16, MF1-MF3, CF1-CF2, IF1, JF1, XF1-XF3, UF1

_sql(
    "fn_string",
    """SELECT p_partkey, CHAR(77, 121) AS c, INSERT(p_name, 2, 3, 'XY') AS i, LEFT(p_name, 4) AS l, RIGHT(p_name, 3) AS r, TRIM(LEADING 'sm' FROM p_name) AS t1, TRIM(BOTH 'g' FROM p_name) AS t2,
       SUBSTRING(p_name, -3) AS s1, SUBSTRING(p_name FROM 2 FOR 4) AS s2, SUBSTRING(p_name, 0) AS s0, REPEAT('ab', 3) AS rep, REPLACE(p_name, 'ring', 'RING') AS rp, REVERSE(p_name) AS rv,
       LCASE(p_brand) AS lo, UCASE(p_name) AS up, LPAD(p_name, 12, '*') AS lp, RPAD(p_name, 12, '-') AS rpd, CONCAT(p_name, '/', p_brand) AS cc, CONCAT_WS('-', p_name, NULL, p_brand) AS cw, SPACE(2) AS sp FROM part""",
    """SELECT p_partkey, 'My' AS c, p_name[1:1] || 'XY' || p_name[5:] AS i, LEFT(p_name, 4) AS l, RIGHT(p_name, 3) AS r, regexp_replace(p_name, '^(sm)+', '') AS t1, trim(p_name, 'g') AS t2,
       right(p_name, 3) AS s1, substring(p_name, 2, 4) AS s2, '' AS s0, 'ababab' AS rep, REPLACE(p_name, 'ring', 'RING') AS rp, REVERSE(p_name) AS rv,
       lower(p_brand) AS lo, upper(p_name) AS up, lpad(p_name, 12, '*') AS lp, rpad(p_name, 12, '-') AS rpd, p_name || '/' || p_brand AS cc, p_name || '-' || p_brand AS cw, '  ' AS sp FROM part""",
)
_sql(
    "fn_string_search",
    """SELECT p_partkey, POSITION('i' IN p_name) AS p, LOCATE('e', p_name) AS lc, INSTR(p_name, 'r') AS ins, ASCII(p_name) AS a, LENGTH(p_name) AS n, CHAR_LENGTH(p_name) AS cn, STRCMP(p_name, 'm') AS sc,
       FIELD(p_type, 'ECONOMY', 'PROMO') AS f, FIND_IN_SET('b', 'a,b,c') AS fs, ELT(2, 'x', 'y') AS e, SUBSTRING_INDEX(p_brand, '#', 1) AS si, REGEXP_LIKE(p_name, '^s') AS rl, REGEXP_REPLACE(p_name, '[aeiou]', '_') AS rr FROM part""",
    """SELECT p_partkey, CAST(instr(p_name, 'i') AS INT) AS p, CAST(instr(p_name, 'e') AS INT) AS lc, CAST(instr(p_name, 'r') AS INT) AS ins, ascii(p_name) AS a, CAST(strlen(p_name) AS INT) AS n, CAST(length(p_name) AS INT) AS cn,
       CASE WHEN p_name = 'm' THEN 0 WHEN p_name < 'm' THEN -1 ELSE 1 END AS sc, CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'PROMO' THEN 2 ELSE 0 END AS f, 2 AS fs, 'y' AS e,
       split_part(p_brand, '#', 1) AS si, regexp_matches(p_name, '^s') AS rl, regexp_replace(p_name, '[aeiou]', '_', 'g') AS rr FROM part""",
)
_sql(
    "fn_string_encode",
    "SELECT p_partkey, HEX(p_name) AS h, MD5(p_name) AS m, SHA2(p_name, 256) AS s2, TO_BASE64(p_name) AS b, FROM_BASE64(TO_BASE64(p_name)) AS fb, BIN(p_size) AS bn, OCT(p_size) AS oc, FORMAT(p_retailprice, 2) AS f FROM part",
    "SELECT p_partkey, hex(p_name) AS h, md5(p_name) AS m, sha256(p_name) AS s2, to_base64(encode(p_name)) AS b, p_name AS fb, bin(p_size) AS bn, printf('%o', p_size) AS oc, format('{:,.2f}', p_retailprice) AS f FROM part",
)
_sql("fn_string_hash", "SELECT p_partkey, SHA1(p_name) AS s, CRC32(p_name) AS c, PASSWORD(p_name) AS p, CHARSET(p_name) AS cs, SOUNDEX(p_name) AS sx FROM part", None)
_sql("fn_weight_string", "SELECT n_nationkey, HEX(WEIGHT_STRING(n_name)) AS w, ORD(n_name) AS o FROM nation", "SELECT n_nationkey, hex(n_name) AS w, CAST(ord(n_name) AS BIGINT) AS o FROM nation")
_sql("fn_hash", "SELECT p_partkey, SHA1(p_name) AS s, PASSWORD(p_name) AS p, MD5(p_name) AS m, SHA2(p_name, 256) AS t, CHARSET(p_name) AS cs FROM part", "SELECT p_partkey, sha1(p_name) AS s, '*' || upper(sha1(unhex(sha1(p_name)))) AS p, md5(p_name) AS m, sha256(p_name) AS t, 'utf8mb4' AS cs FROM part")
_sql(
    "fn_week_modes",
    "SELECT o_orderkey, WEEK(o_orderdate, 0) AS w0, WEEK(o_orderdate, 1) AS w1, WEEK(o_orderdate, 2) AS w2, WEEK(o_orderdate, 3) AS w3, WEEK(o_orderdate, 5) AS w5, WEEK(o_orderdate, 7) AS w7, YEARWEEK(o_orderdate, 3) AS yw, DATE_FORMAT(o_orderdate, '%U-%u-%V-%v %X %x %w') AS f FROM orders",
    """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, make_date(CAST(year(o_orderdate) - 1 AS INT), 12, 31) AS e FROM orders),
       w AS (SELECT o_orderkey, d, CAST(strftime(d, '%U') AS INT) AS w0, CASE WHEN isoyear(d) < year(d) THEN 0 WHEN isoyear(d) > year(d) THEN week(d - 7) + 1 ELSE week(d) END AS w1,
         CASE WHEN strftime(d, '%U') = '00' THEN CAST(strftime(e, '%U') AS INT) ELSE CAST(strftime(d, '%U') AS INT) END AS w2, week(d) AS w3, CAST(strftime(d, '%W') AS INT) AS w5,
         CASE WHEN strftime(d, '%W') = '00' THEN CAST(strftime(e, '%W') AS INT) ELSE CAST(strftime(d, '%W') AS INT) END AS w7, CASE WHEN strftime(d, '%U') = '00' THEN year(d) - 1 ELSE year(d) END AS x FROM o)
       SELECT o_orderkey, w0, CAST(w1 AS INT) AS w1, w2, CAST(w3 AS INT) AS w3, w5, w7, CAST(isoyear(d) * 100 + week(d) AS INT) AS yw,
         printf('%02d-%02d-%02d-%02d %04d %04d %d', w0, w1, w2, w3, x, isoyear(d), dayofweek(d)) AS f FROM w""",
)
_sql(
    "fn_time_of_day",
    "SELECT o_orderkey, SEC_TO_TIME(o_orderkey % 86400) AS t, TIME_TO_SEC(SEC_TO_TIME(o_orderkey % 86400)) AS s, MAKETIME(o_orderkey % 24, o_orderkey % 60, 7) AS m, TIMEDIFF(DATE_ADD(o_orderdate, INTERVAL 90 MINUTE), o_orderdate) AS d, ADDTIME(SEC_TO_TIME(o_orderkey % 3600), '01:00:00') AS a, PERIOD_ADD(199811, o_orderkey % 30) AS p, PERIOD_DIFF(200002, 199811) AS q, INET_NTOA(o_orderkey) AS ip, INET_ATON(INET_NTOA(o_orderkey)) AS n FROM orders",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 86400 AS s, o_orderkey % 3600 + 3600 AS a FROM orders)
       SELECT k AS o_orderkey, printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS t, s, printf('%02d:%02d:07', k % 24, k % 60) AS m, '01:30:00' AS d, printf('%02d:%02d:%02d', a // 3600, a // 60 % 60, a % 60) AS a,
         (1998 * 12 + 10 + k % 30) // 12 * 100 + (1998 * 12 + 10 + k % 30) % 12 + 1 AS p, 15 AS q, printf('%d.%d.%d.%d', k // 16777216, k // 65536 % 256, k // 256 % 256, k % 256) AS ip, k AS n FROM o""",
)
_sql(
    "fn_date_part",
    """SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m, DAY(o_orderdate) AS d, HOUR(o_orderdate) AS h, MINUTE(o_orderdate) AS mi, SECOND(o_orderdate) AS s, QUARTER(o_orderdate) AS q,
       WEEK(o_orderdate) AS w0, WEEK(o_orderdate, 3) AS w3, DAYOFWEEK(o_orderdate) AS dw, WEEKDAY(o_orderdate) AS wd, DAYOFYEAR(o_orderdate) AS dy, EXTRACT(YEAR_MONTH FROM o_orderdate) AS ym, DATE(o_orderdate) AS dt FROM orders""",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(hour(o_orderdate) AS INT) AS h, CAST(minute(o_orderdate) AS INT) AS mi, CAST(second(o_orderdate) AS INT) AS s,
       CAST(quarter(o_orderdate) AS INT) AS q, CAST(strftime(o_orderdate, '%U') AS INT) AS w0, CAST(week(o_orderdate) AS INT) AS w3, CAST(dayofweek(o_orderdate) + 1 AS INT) AS dw, CAST(isodow(o_orderdate) - 1 AS INT) AS wd,
       CAST(dayofyear(o_orderdate) AS INT) AS dy, CAST(strftime(o_orderdate, '%Y%m') AS BIGINT) AS ym, CAST(o_orderdate AS DATE) AS dt FROM orders""",
)
_sql(
    "fn_date_arith",
    """SELECT event_id, DATE_ADD(ts, INTERVAL 5 MINUTE) AS a, DATE_SUB(ts, INTERVAL '1:30' HOUR_MINUTE) AS b, ADDDATE(DATE(ts), 10) AS c, SUBDATE(DATE(ts), INTERVAL 1 MONTH) AS d, TIMESTAMPADD(HOUR, 3, ts) AS e,
       TIMESTAMPDIFF(MINUTE, '2024-01-01 00:00:00', ts) AS f, DATEDIFF(ts, '2023-12-25') AS g, LAST_DAY(ts) AS h, MICROSECOND(ts) AS i, DATE_ADD('2024-01-31', INTERVAL 1 MONTH) AS j, TO_DAYS(ts) AS k, MAKEDATE(2024, 60) AS l FROM events""",
    """SELECT event_id, ts + INTERVAL 5 MINUTE AS a, ts - INTERVAL 90 MINUTE AS b, CAST(ts AS DATE) + 10 AS c, CAST(CAST(ts AS DATE) - INTERVAL 1 MONTH AS DATE) AS d, ts + INTERVAL 3 HOUR AS e,
       date_sub('minute', TIMESTAMP '2024-01-01 00:00:00', ts) AS f, CAST(date_diff('day', DATE '2023-12-25', CAST(ts AS DATE)) AS INT) AS g, last_day(ts) AS h, CAST(microsecond(ts) % 1000000 AS INT) AS i, DATE '2024-02-29' AS j,
       CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) + 719528 AS INT) AS k, DATE '2024-02-29' AS l FROM events""",
)
_sql(
    "fn_date_format",
    """SELECT event_id, DATE_FORMAT(ts, '%Y-%m-%d %H:%i:%s') AS a, DATE_FORMAT(ts, '%W %M %e') AS b, DAYNAME(ts) AS c, MONTHNAME(ts) AS d, TIME(ts) AS e, STR_TO_DATE('03/02/2024', '%d/%m/%Y') AS f,
       DATE_FORMAT(ts, GET_FORMAT(DATE, 'EUR')) AS g, UNIX_TIMESTAMP(ts) AS h FROM events""",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%A %B %-d') AS b, strftime(ts, '%A') AS c, strftime(ts, '%B') AS d, strftime(ts, '%H:%M:%S') AS e, TIMESTAMP '2024-02-03 00:00:00' AS f,
       strftime(ts, '%d.%m.%Y') AS g, CAST(floor(epoch(ts)) AS BIGINT) AS h FROM events""",
)
_sql("fn_now", "SELECT NOW() >= TIMESTAMP '2020-01-01 00:00:00' AS a, CURDATE() > DATE '2020-01-01' AS b, CHAR_LENGTH(CURTIME()) AS c, UTC_TIMESTAMP() = UTC_TIMESTAMP AS d", "SELECT true AS a, true AS b, 8 AS c, true AS d")
_sql(
    "fn_math",
    """SELECT l_orderkey, l_linenumber, ABS(-l_tax) AS a, CEILING(l_extendedprice) AS c, FLOOR(l_extendedprice) AS f, ROUND(l_extendedprice, 1) AS r, MOD(l_orderkey, 7) AS m, MOD(l_orderkey, l_linenumber - 1) AS m0, SIGN(l_discount) AS s,
       GREATEST(l_linenumber, 3) AS g, LEAST(l_linenumber, NULLIF(l_linenumber, 2), 3) AS le, CONV('ff', 16, 10) AS cv, ROUND(SQRT(l_quantity), 6) AS sq, ROUND(POW(l_quantity, 2), 6) AS pw FROM lineitem""",
    """SELECT l_orderkey, l_linenumber, ABS(l_tax) AS a, CAST(CEIL(l_extendedprice) AS BIGINT) AS c, CAST(FLOOR(l_extendedprice) AS BIGINT) AS f, ROUND(l_extendedprice, 1) AS r, l_orderkey % 7 AS m, l_orderkey % nullif(l_linenumber - 1, 0) AS m0,
       CAST(SIGN(l_discount) AS DOUBLE) AS s, GREATEST(l_linenumber, 3) AS g, CASE WHEN l_linenumber = 2 THEN NULL ELSE LEAST(l_linenumber, 3) END AS le, '255' AS cv, ROUND(SQRT(l_quantity), 6) AS sq, ROUND(POW(l_quantity, 2), 6) AS pw FROM lineitem""",
)
_sql(
    "fn_math_trig",
    """SELECT n_nationkey, ROUND(SIN(n_nationkey), 9) AS a, ROUND(COS(n_nationkey), 9) AS b, ROUND(TAN(n_nationkey), 6) AS c, ROUND(ATAN(n_nationkey, 2), 9) AS d, ROUND(DEGREES(n_nationkey), 6) AS e, ROUND(RADIANS(n_nationkey), 9) AS f,
       ROUND(EXP(n_nationkey / 10), 6) AS g, ROUND(LN(n_nationkey + 1), 9) AS h, ROUND(LOG2(n_nationkey + 1), 9) AS i, ROUND(LOG10(n_nationkey + 1), 9) AS j, ROUND(PI(), 6) AS k, ROUND(LOG(n_nationkey + 2), 9) AS l FROM nation""",
    """SELECT n_nationkey, ROUND(SIN(n_nationkey), 9) AS a, ROUND(COS(n_nationkey), 9) AS b, ROUND(TAN(n_nationkey), 6) AS c, ROUND(ATAN2(n_nationkey, 2), 9) AS d, ROUND(DEGREES(n_nationkey), 6) AS e, ROUND(RADIANS(n_nationkey), 9) AS f,
       ROUND(EXP(n_nationkey / 10.0), 6) AS g, ROUND(LN(n_nationkey + 1), 9) AS h, ROUND(LOG2(n_nationkey + 1), 9) AS i, ROUND(LOG10(n_nationkey + 1), 9) AS j, ROUND(PI(), 6) AS k, ROUND(LN(n_nationkey + 2), 9) AS l FROM nation""",
)
_sql(
    "fn_truncate_interval",
    "SELECT o_orderkey, ROUND(TRUNCATE(o_totalprice, 1), 1) AS t, ROUND(TRUNCATE(-o_totalprice, 0), 0) AS u, INTERVAL(o_orderkey, 10, 100, 1000) AS i FROM orders",
    "SELECT o_orderkey, ROUND(floor(o_totalprice * 10) / 10, 1) AS t, -floor(o_totalprice) AS u, CASE WHEN o_orderkey < 10 THEN 0 WHEN o_orderkey < 100 THEN 1 WHEN o_orderkey < 1000 THEN 2 ELSE 3 END AS i FROM orders",
)
_sql(
    "fn_flow",
    "SELECT o_orderkey, IF(o_totalprice > 200000, 'big', 'small') AS a, IFNULL(NULLIF(o_orderstatus, 'F'), '-') AS b, COALESCE(NULL, NULLIF(o_orderstatus, 'O'), 'none') AS c, ISNULL(NULLIF(o_orderstatus, 'F')) AS d FROM orders",
    "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS a, coalesce(NULLIF(o_orderstatus, 'F'), '-') AS b, coalesce(NULLIF(o_orderstatus, 'O'), 'none') AS c, o_orderstatus = 'F' AS d FROM orders",
)
_sql(
    "fn_json",
    """SELECT event_id, JSON_VALUE(props, '$.k' RETURNING SIGNED) AS a, JSON_VALUE(props, '$.none' DEFAULT 'x' ON EMPTY) AS b, JSON_EXTRACT(props, '$.k') AS c, JSON_UNQUOTE('"q"') AS d, JSON_LENGTH('[1,2,3]') AS e, JSON_CONTAINS('[1,2]', 2) AS f,
       JSON_OBJECT('id', event_id) AS g, JSON_ARRAY(event_id, 1) AS h, JSON_VALID(props) AS i, JSON_KEYS(props) AS j FROM events""",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS a, 'x' AS b, json_extract_string(props, '$.k') AS c, 'q' AS d, 3 AS e, true AS f, '{"id":' || event_id || '}' AS g, '[' || event_id || ',1]' AS h, true AS i, '["k"]' AS j FROM events""",
)
_sql(
    "fn_cast",
    "SELECT o_orderkey, CAST(o_totalprice AS SIGNED) AS a, CAST(o_totalprice AS UNSIGNED) AS b, CAST(o_orderdate AS CHAR(10)) AS c, CAST('x' AS SIGNED) AS d, CONVERT(o_orderkey, CHAR) AS e, CONVERT(o_orderstatus USING utf8mb4) AS f, CAST(o_orderdate AS DATE) AS g, CAST('12.345' AS DECIMAL(8, 2)) AS h FROM orders",
    "SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS a, CAST(round(o_totalprice) AS DECIMAL(20,0)) AS b, strftime(o_orderdate, '%Y-%m-%d') AS c, CAST(NULL AS BIGINT) AS d, CAST(o_orderkey AS VARCHAR) AS e, o_orderstatus AS f, CAST(o_orderdate AS DATE) AS g, CAST(12.35 AS DECIMAL(8, 2)) AS h FROM orders",
)
_sql("fn_cast_zone", "SELECT event_id, CAST(ts AT TIME ZONE '+02:00' AS DATETIME) AS a, BINARY event_type AS b FROM events", "SELECT event_id, ts + INTERVAL 2 HOUR AS a, encode(event_type) AS b FROM events")
_sql("fn_geometry", "SELECT n_nationkey, POINT(n_nationkey, 2).x AS x, CARDINALITY(LINESTRING(POINT(0, 0), POINT(1, n_nationkey))) AS n FROM nation", "SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS x, 2 AS n FROM nation")
_sql("fn_session", "SELECT CHAR_LENGTH(CURRENT_USER()) > 0 AS a, DATABASE() AS b", "SELECT true AS a, 'default' AS b")

# -- sharding: H1-H20


@_frame("shard_mod", "SELECT o_orderkey, CAST(((o_orderkey % 4) + 4) % 4 AS INT) AS shard, CAST(round(o_totalprice) % 3 AS INT) AS by_price FROM orders")
def _shard_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", shard_column(F.col("o_orderkey"), 4).alias("shard"), shard_column(F.col("o_totalprice"), 3).alias("by_price"))


#: The checksum of the key as eight bytes, bit by bit.
_CRC32 = """SELECT o_orderkey, CAST(xor(c, 4294967295) % 4 AS INT) AS shard FROM (SELECT o_orderkey, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(64), lambda i: CAST(i AS BIGINT))), lambda c, i: xor(CASE WHEN (xor(c, CASE WHEN i % 8 = 0 THEN (o_orderkey >> CAST(56 - 8 * (i // 8) AS INT)) & 255 ELSE 0 END) & 1) = 1 THEN 3988292384 ELSE 0 END, xor(c, CASE WHEN i % 8 = 0 THEN (o_orderkey >> CAST(56 - 8 * (i // 8) AS INT)) & 255 ELSE 0 END) >> 1)) AS c FROM orders)"""


@_frame("shard_crc32mod", _CRC32)
def _shard_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", shard_column(F.col("o_orderkey"), 4, "crc32mod").alias("shard"))


_AGG = "SELECT o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS s, ROUND(AVG(o_totalprice), 4) AS a, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders GROUP BY o_orderstatus"
_sql("sharded_table_agg", _AGG, rules={"orders": ORDERS_TABLE})
_sql("sharded_database_agg", _AGG, rules={"orders": ORDERS_DATABASE})
_sql("sharded_db_table_agg", _AGG, rules={"orders": ORDERS_BOTH})


def _stored(key: str, statement: str, oracle: str = "") -> None:
    """Over orders dealt to one folder for each shard; pruned shards are not read."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        engine.add("orders", load(spark, sf_dir, "orders"), ORDERS_BOTH, stored=True)
        return engine.query(statement)

    _QUERIES[key], _ORACLES[key] = run, oracle or statement


_stored("shard_prune_point", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 42 AND o_orderkey IN (1, 2, 3, 77, 4003)")
_stored("shard_prune_rows", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey IN (1, 2, 3, 77, 403)")
_stored("shard_prune_db_only", "SELECT o_orderkey FROM orders WHERE 7 = o_custkey")
_stored("shard_prune_tbl_only", "SELECT o_orderkey, o_custkey FROM orders o WHERE o.o_orderkey <=> 9", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 9")
_stored("shard_prune_none", "SELECT COUNT(*) AS n FROM orders WHERE o_orderkey = 9 OR o_custkey = 7")


@_frame("insert_routing", "SELECT CAST(o_custkey % 2 AS INT) AS _db, CAST(o_orderkey % 4 AS INT) AS _tbl, COUNT(*) AS n_rows FROM orders GROUP BY ALL")
def _routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.route_counts(load(spark, sf_dir, "orders"), ORDERS_BOTH)


# -- writes and definitions: D1-D17


def _writes(key: str, statements: str, result: str, oracle: str, rule: ShardingRule | None = None) -> None:
    """Statements that change tables, and a query over what they leave."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = Engine(spark)
        for name in _named(statements + result):
            engine.add(name, load(spark, sf_dir, name), rule if rule and rule.table == name else None)
        engine.execute(statements)
        return engine.query(result)

    _QUERIES[key], _ORACLES[key] = run, oracle


_writes(
    "insert_values",
    "INSERT INTO region (r_regionkey, r_name) VALUES (50, 'X'), (51, DEFAULT); INSERT INTO region SET r_regionkey = 52, r_name = 'Z'",
    "SELECT * FROM region",
    "SELECT * FROM region UNION ALL SELECT * FROM (VALUES (50, 'X'), (51, NULL), (52, 'Z'))",
)
_writes(
    "insert_select",
    "INSERT INTO orders SELECT o_orderkey + 1000000, o_custkey, 'N', o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderstatus = 'P'",
    "SELECT o_orderkey, o_orderstatus FROM orders",
    "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey + 1000000, 'N' FROM orders WHERE o_orderstatus = 'P'",
    ORDERS_BOTH,
)
_writes(
    "upsert_emulation",
    "INSERT INTO supplier (s_suppkey, s_name, s_nationkey, s_acctbal) VALUES (1, 'a', 2, 10.5), (990001, 'b', 3, 1.0) ON DUPLICATE KEY UPDATE s_acctbal = s_acctbal + VALUES(s_acctbal)",
    "SELECT s_suppkey, s_name, ROUND(s_acctbal, 2) AS b FROM supplier",
    "SELECT s_suppkey, s_name, ROUND(s_acctbal + CASE WHEN s_suppkey = 1 THEN 10.5 ELSE 0 END, 2) AS b FROM supplier UNION ALL SELECT 990001, 'b', 1.0",
)
_writes(
    "update_cow",
    "UPDATE orders SET o_totalprice = o_totalprice * 2, o_orderstatus = 'X' WHERE o_orderstatus = 'F' AND o_orderkey > 10",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders",
    "SELECT o_orderkey, CASE WHEN h THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN h THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM (SELECT *, o_orderstatus = 'F' AND o_orderkey > 10 AS h FROM orders)",
    ORDERS_TABLE,
)
_writes(
    "update_join",
    "UPDATE supplier JOIN nation ON s_nationkey = n_nationkey SET s_name = n_name WHERE n_regionkey = 1",
    "SELECT s_suppkey, s_name FROM supplier",
    "SELECT s_suppkey, CASE WHEN n_regionkey = 1 THEN n_name ELSE s_name END AS s_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey",
)
_writes(
    "delete_cow",
    "DELETE FROM orders WHERE NULLIF(o_orderstatus, 'P') = 'F'",
    "SELECT o_orderkey FROM orders",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'",
    ORDERS_BOTH,
)
_writes(
    "delete_limit",
    "DELETE FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5",
    "SELECT o_orderkey FROM orders",
    "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5)",
)
_writes(
    "delete_using",
    "DELETE s FROM supplier s JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2",
    "SELECT s_suppkey FROM supplier",
    "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
)
_writes(
    "cte_delete",
    "WITH poor AS (SELECT c_custkey FROM customer WHERE c_acctbal < 0) DELETE FROM orders WHERE o_custkey IN (SELECT c_custkey FROM poor)",
    "SELECT o_orderkey FROM orders",
    "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    ORDERS_BOTH,
)
_writes(
    "create_table_definition",
    "CREATE TABLE book (id BIGINT NOT NULL AUTO_INCREMENT, name VARCHAR(25) DEFAULT 'none', size INT GENERATED ALWAYS AS (CHAR_LENGTH(name)) STORED, PRIMARY KEY (id)) PARTITION BY HASH(id) PARTITIONS 3; CREATE INDEX by_name ON book (name); INSERT INTO book (name) SELECT n_name FROM nation; INSERT INTO book (id) VALUES (900)",
    "SELECT name, size FROM book",
    "SELECT n_name AS name, CAST(length(n_name) AS INT) AS size FROM nation UNION ALL SELECT 'none', 4",
)
_writes(
    "delete_join_composite",
    "DELETE l FROM lineitem l JOIN part ON l_partkey = p_partkey WHERE p_size > 40 AND l_linenumber <> 1",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem",
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem LEFT JOIN part ON l_partkey = p_partkey WHERE NOT (coalesce(p_size, 0) > 40 AND l_linenumber <> 1)",
)
_writes(
    "update_join_composite",
    "UPDATE lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey SET l.l_quantity = l.l_quantity + 100, o.o_orderstatus = 'U' WHERE l.l_linenumber = 2 AND o.o_orderstatus = 'F'",
    "SELECT l_orderkey, l_linenumber, l_quantity, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "WITH u AS (SELECT DISTINCT o_orderkey AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 2 AND o_orderstatus = 'F') SELECT l_orderkey, l_linenumber, l_quantity + CASE WHEN l_linenumber = 2 AND o_orderstatus = 'F' THEN 100 ELSE 0 END AS l_quantity, CASE WHEN k IS NOT NULL THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN u ON k = o_orderkey",
)
_writes(
    "upsert_composite",
    "CREATE TABLE stock (k BIGINT, part INT, n INT DEFAULT 7, twice INT AS (n * 2), PRIMARY KEY (k, part)); INSERT INTO stock (k, part, n) SELECT s_suppkey, s_nationkey % 3, 1 FROM supplier; INSERT INTO stock (k, part) VALUES (1, 99), (2, 99); INSERT INTO stock (k, part, n) SELECT s_suppkey, 1, 10 FROM supplier ON DUPLICATE KEY UPDATE n = n + VALUES(n); INSERT INTO stock (k, part, n) VALUES (1, 99, 5), (1, 99, 6), (3, 98, 1), (3, 98, 2) ON DUPLICATE KEY UPDATE n = n + VALUES(n)",
    "SELECT k, part, n, twice FROM stock",
    "SELECT k, part, n, n * 2 AS twice FROM (SELECT s_suppkey AS k, CAST(s_nationkey % 3 AS INT) AS part, CAST(CASE WHEN s_nationkey % 3 = 1 THEN 11 ELSE 1 END AS INT) AS n FROM supplier UNION ALL SELECT s_suppkey, 1, 10 FROM supplier WHERE s_nationkey % 3 <> 1 UNION ALL SELECT * FROM (VALUES (1, 99, 18), (2, 99, 7), (3, 98, 3)))",
)
_writes(
    "rollback_restores",
    "BEGIN; DELETE FROM nation WHERE n_regionkey = 1; SAVEPOINT one; UPDATE nation SET n_name = 'x'; ROLLBACK TO one; COMMIT; START TRANSACTION; DELETE FROM nation; INSERT INTO nation VALUES (99, 'y', 0); ROLLBACK",
    "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1",
)
_writes(
    "update_limit",
    "UPDATE lineitem SET l_quantity = 0 WHERE l_linenumber = 3 ORDER BY l_extendedprice DESC, l_orderkey LIMIT 7",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 3 AND r <= 7 THEN 0 ELSE l_quantity END AS l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY l_extendedprice DESC, l_orderkey) AS r FROM lineitem)",
)
_writes(
    "multi_statement",
    "SET @r = 2; CREATE TABLE mine AS SELECT * FROM nation WHERE n_regionkey = @r; CREATE VIEW v AS SELECT n_name FROM mine; PREPARE p FROM 'SELECT COUNT(*) FROM region WHERE r_regionkey < ?'; EXECUTE p USING @r",
    "SELECT n_name FROM v",
    "SELECT n_name FROM nation WHERE n_regionkey = 2",
)


def _session(key: str, statement: str, oracle: str | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine(spark).use(sf_dir, "nation", "region").query(statement)

    _QUERIES[key] = run
    if oracle:
        _ORACLES[key] = oracle


_session("show_tables", "SHOW TABLES", "SELECT * FROM (VALUES ('nation'), ('region')) AS v(name)")
_session("show_columns", "SHOW COLUMNS FROM region", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) AS v(field, type)")


@_frame("into_outfile", "SELECT CAST(n_nationkey AS VARCHAR) AS _c0, n_name AS _c1 FROM nation WHERE n_regionkey = 1")
def _outfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark).use(sf_dir, "nation")
    path = f"{engine.folder}/outfile-{uuid.uuid4().hex}"
    engine.execute(f"SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 INTO OUTFILE '{path}' FIELDS TERMINATED BY ',' ENCLOSED BY '\"' LINES TERMINATED BY '\\n'")
    return spark.read.csv(path, schema="_c0 string, _c1 string")


@_frame("into_dumpfile", "SELECT '3' || n_name AS value FROM nation WHERE n_nationkey = 3")
def _dumpfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark).use(sf_dir, "nation")
    path = f"{engine.folder}/dumpfile-{uuid.uuid4().hex}"
    engine.execute(f"SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 3 INTO DUMPFILE '{path}'")
    return spark.read.text(path, wholetext=True).select(F.rtrim(F.col("value"), F.lit("\u0000")).alias("value"))


@_frame("physical_names", "SELECT o_orderkey, printf('ds%d.orders_%05d', o_custkey % 2, o_orderkey % 4) AS name FROM orders")
def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", ORDERS_BOTH.name_column().alias("name"))


_CONFIG = """
[[sharding]]
table = "orders"
nodes = ["ds0", "ds1"]
database = { column = "o_custkey", count = 2 }
tables = { column = "o_orderkey", count = 4, strategy = "crc32mod" }
"""


@_frame("config_shards", "SELECT printf('ds%d.orders_%05d', d, t) AS name, 'crc32mod' AS strategy FROM (SELECT unnest(range(2)) AS d), (SELECT unnest(range(4)) AS t)")
def _config(spark: SparkSession, sf_dir: str) -> DataFrame:
    [rule] = rules.from_toml(_CONFIG).rules
    return spark.createDataFrame([(rule.physical_name(d, t), rule.tables.strategy) for d, t in rule.shards()], "name string, strategy string")


@_frame("into_variables", "SELECT count(*) AS n, max(n_name) AS m FROM nation")
def _variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark).use(sf_dir, "nation")
    engine.execute("SELECT COUNT(*), MAX(n_name) INTO @n, @m FROM nation")
    return engine.query("SELECT CAST(@n AS SIGNED) AS n, @m AS m")


@_frame("read_shards", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 2 = 1")
def _read_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")

    def read(_, url: str, table: str) -> DataFrame:  # stands for a database's physical table
        db, tbl = int(url[-1]), int(table[-5:])
        return orders.where((F.col("o_custkey") % 2 == db) & (F.col("o_orderkey") % 4 == tbl))

    return endpoints.read_shards(spark, ["db0", "db1"], ORDERS_BOTH, read).where("_db = 1").select("o_orderkey", "o_custkey")


@_frame("range_partition_assign", "SELECT o_orderkey, CASE WHEN y < 1996 THEN 0 WHEN y < 1998 THEN 1 WHEN y < 2000 THEN 2 ELSE 3 END AS p FROM (SELECT o_orderkey, year(o_orderdate) AS y FROM orders)")
def _range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select("o_orderkey", partition.range_partition(F.year("o_orderdate"), [1996, 1998, 2000, None]).alias("p"))


@_frame("list_partition_assign", "SELECT n_nationkey, CASE WHEN n_regionkey IN (0, 3) THEN 0 WHEN n_regionkey IN (1, 2) THEN 1 END AS p FROM nation")
def _list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "nation").select("n_nationkey", partition.list_partition(F.col("n_regionkey"), [[0, 3], [1, 2, None]]).alias("p"))


@_frame("hash_partition_assign", "SELECT o_orderkey, CAST(year(o_orderdate) % 4 AS INT) AS p, CAST(CASE WHEN (year(o_orderdate) & 7) >= 6 THEN year(o_orderdate) & 3 ELSE year(o_orderdate) & 7 END AS INT) AS l FROM orders")
def _hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = F.year("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", partition.hash_partition(year, 4).alias("p"), partition.linear_hash_partition(year, 6).alias("l"))


@_frame("upsert_frames", "SELECT n_nationkey, CASE WHEN n_nationkey < 5 THEN 'new' ELSE n_name END AS n_name FROM nation UNION ALL SELECT 100, 'new'")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    fresh = nation.where("n_nationkey < 5").select("n_nationkey", F.lit("new").alias("n_name")).unionByName(spark.createDataFrame([(100, "new")], "n_nationkey int, n_name string"))
    return dml.upsert(nation, fresh, "n_nationkey", {"n_name": "_new.n_name"})


# -- governance: V1-V11

_STATEMENTS = {"view": "select * from t", "click": "SELECT a FROM t FOR UPDATE", "purchase": "insert into t values (1)", "signup": "set names utf8", "error": "delete from t"}
_LOG = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATEMENTS.items()) + " END"


@_frame("route_regex", f"SELECT event_id, CASE WHEN regexp_matches(s, '(?i)for update$') THEN 'readwrite' WHEN regexp_matches(s, '^select') THEN 'read' ELSE 'readwrite' END AS target FROM (SELECT event_id, {_LOG} AS s FROM events)")
def _route_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    router = govern.Router([govern.Node("primary"), govern.Node("replica", role=govern.READ)], [govern.Rule(["(?i)for update$"], govern.READWRITE), govern.Rule(["^select"], govern.READ)], generic=False)
    log = load(spark, sf_dir, "events").select("event_id", F.expr(_LOG).alias("s"))
    return log.select("event_id", router.column(F.col("s")).alias("target"))


@_frame("route_generic", f"SELECT event_id, CASE WHEN upper(split_part(s, ' ', 1)) = 'SELECT' THEN 'read' ELSE 'readwrite' END AS target FROM (SELECT event_id, {_LOG} AS s FROM events)")
def _route_generic(spark: SparkSession, sf_dir: str) -> DataFrame:
    router = govern.Router([govern.Node("primary")])
    return load(spark, sf_dir, "events").select("event_id", router.column(F.expr(_LOG)).alias("target"))


@_frame("monitor_latest_state", "SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id")
def _monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return govern.latest_states(load(spark, sf_dir, "events"), "user_id", "ts", "event_type")


@_frame("circuit_break", f"SELECT event_id, regexp_matches(s, '(?i)^(delete|update)|for update$') AS rejected FROM (SELECT event_id, {_LOG} AS s FROM events)")
def _circuit(spark: SparkSession, sf_dir: str) -> DataFrame:
    guard = govern.CircuitBreak(["^(delete|update)", "FOR UPDATE$"], ignore_case=True)
    return load(spark, sf_dir, "events").select("event_id", guard.column(F.expr(_LOG)).alias("rejected"))


@_frame("monitor_endpoints", "SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'readwrite' ELSE 'read' END AS role FROM (SELECT user_id, arg_max(event_type, (ts, event_type)) AS event_type FROM events GROUP BY user_id) WHERE event_type <> 'error'")
def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = govern.latest_states(load(spark, sf_dir, "events"), "user_id", "ts", "event_type")
    role = F.when(F.col("event_type") == "purchase", govern.READWRITE).otherwise(govern.READ)
    return govern.endpoints(states, "user_id", role, F.col("event_type") != "error")


@_frame("load_balance", "SELECT i, CASE WHEN i % 4 = 2 THEN 'b' ELSE 'a' END AS node FROM (SELECT unnest(range(12)) AS i)")
def _balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = govern.RoundRobin([govern.Node("a", 3), govern.Node("b", 1)])
    return spark.createDataFrame([(i, even.next().name) for i in range(12)], "i long, node string")


@_frame("statement_metrics", "SELECT event_type, COUNT(*) AS total, ROUND(SUM(value), 2) AS duration, MAX(value) AS slowest FROM events GROUP BY event_type")
def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.round(F.sum("value"), 2).alias("duration"), F.max("value").alias("slowest"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


