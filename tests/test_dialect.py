import pytest

from shardloom.plans.dialect import Normaliser
from shardloom.plans.engine import Engine
from shardloom.plans.govern import CircuitBreak, QueryRejected
from shardloom.plans.tokens import SqlError, scan, tree, unquote


def text(sql, **variables):
    return Normaliser(variables).text(tree(scan(sql)))


@pytest.mark.parametrize(
    "sql, want",
    [
        ("SELECT 1 -- tail\n + /* x */ 2 # y", "SELECT 1 + 2"),
        ("SELECT /*!50000 STRAIGHT_JOIN */ a FROM t", "SELECT a FROM t"),
        ("SELECT a || b && c", "SELECT a OR b AND c"),
        ("SELECT a FROM DUAL", "SELECT a"),
        ("SELECT a FROM t LIMIT 5, 10", "SELECT a FROM t LIMIT 10 OFFSET 5"),
        ("SELECT a FROM t FORCE INDEX FOR ORDER BY (x) WHERE b LOCK IN SHARE MODE", "SELECT a FROM t WHERE b"),
        ("SELECT a FROM t FOR UPDATE OF t SKIP LOCKED", "SELECT a FROM t"),
        ("SELECT CAST(a AS CHAR(3))", "SELECT left(try_cast(a AS STRING), 3)"),
        ("SELECT STD(a), VARIANCE(b)", "SELECT stddev_pop(a) , var_pop(b)"),
        ("SELECT a / b, c / 2", "SELECT a / nullif(b, 0) , c / 2"),
        ("SELECT `a b`.c FROM `a b`", "SELECT `a b`.c FROM `a b`"),
        ("SELECT N'x' 'y', _utf8'z'", "SELECT 'xy' , 'z'"),
        ("SELECT x'4D', 0x10, 0b11, b'10'", "SELECT X'4D' , 16 , 3 , 2"),
        ("SELECT @v + 1", "SELECT 7 + 1"),
        ("SELECT x = ANY (SELECT y FROM t)", "SELECT (x IN (SELECT y FROM t))"),
        ("SELECT GROUP_CONCAT(a, b SEPARATOR '-') FROM t", "SELECT listagg(concat(CAST(a AS STRING), CAST(b AS STRING)), '-') FROM t"),
        ("SELECT DATE_ADD(d, INTERVAL 2 WEEK)", "SELECT (d + make_interval(0, 0, CAST((2) AS INT), 0, 0, 0, 0))"),
    ],
)
def test_rewrites(sql, want):
    assert text(sql, v=7) == want


def test_escapes_and_errors():
    assert unquote(r"'it''s \n \\ \% x'") == "it's \n \\ \\% x"
    for bad in ("SELECT (1", "SELECT 1)", "SELECT CAST(a AS NOTHING)", "SELECT NTH_VALUE(a, 2) FROM LAST OVER w"):
        with pytest.raises((SqlError, KeyError)):
            text(bad)


#: Statements of many shapes that have to be read; those with names run over small tables.
READ = """
SELECT 1
SELECT 1 AS a UNION SELECT 2 UNION ALL SELECT 3
SELECT a.k FROM t AS a JOIN u AS b ON a.k = b.k LEFT JOIN t c USING (k)
SELECT k, COUNT(*) AS n FROM t GROUP BY k HAVING n >= 1 ORDER BY n DESC, k LIMIT 1, 2
SELECT * FROM t WHERE k IN (SELECT k FROM u WHERE k IN (SELECT MAX(k) FROM t GROUP BY s ORDER BY 1 LIMIT 3))
SELECT t.*, 1 FROM t, u WHERE t.k <=> u.k
SELECT IF(k > 1, 'x', NULL) AS a FROM t WHERE s LIKE 'a%' OR s RLIKE '^b' ORDER BY -k
WITH c AS (SELECT k FROM t), d(x) AS (SELECT k + 1 FROM c) SELECT * FROM d
SELECT AVG(k) OVER (PARTITION BY s ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS a FROM t
SELECT k FROM t WHERE (k, s) IN ((1, 'a'), (2, 'b')) AND NOT EXISTS (SELECT 1 FROM u WHERE u.k = t.k + 9)
(SELECT k FROM t) UNION (SELECT k FROM u) ORDER BY k
TABLE t
VALUES ROW(1, 2), ROW(3, 4)
SELECT k XOR 0 AS a, k DIV 2 AS b, ~k AS c, k ^ 1 AS d FROM t
SELECT EXTRACT(DAY_HOUR FROM NOW()) > 0 AS a, QUARTER(CURDATE()) > 0 AS b
SELECT CASE k WHEN 1 THEN 'one' ELSE 'more' END AS a FROM t FOR SHARE
"""


@pytest.fixture()
def engine(spark):
    e = Engine(spark)
    e.add("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, s string"))
    e.add("u", spark.createDataFrame([(1, 1.5), (3, 2.5)], "k int, v double"))
    return e


@pytest.mark.parametrize("sql", READ.strip().splitlines())
def test_reads(engine, sql):
    assert engine.query(sql).collect() is not None


def one(engine, sql):
    return engine.query(f"SELECT {sql} AS v").first().v


@pytest.mark.parametrize(
    "sql, want",
    [
        ("TRIM(LEADING 'ab' FROM 'ababb')", "b"), ("TRIM(BOTH 'x' FROM 'xaxx')", "a"), ("SUBSTRING('abc', 0)", ""), ("INSERT('abc', 9, 1, 'Z')", "abc"), ("INSERT('abcd', 2, 2, 'Z')", "aZd"),
        ("GREATEST(1, NULL)", None), ("1 / 0", None), ("5 % 0", None), ("7 DIV 2", 3), ("CAST('-12.6' AS SIGNED)", -13), ("WEEK(DATE '2024-01-07')", 1), ("WEEK(DATE '2024-01-07', 3)", 1),
        ("TRUNCATE(-1.99, 1)", -1.9), ("INTERVAL(5, 1, 5, 9)", 2), ("INTERVAL(NULL, 1)", -1), ("FIELD('b', 'a', 'b')", 2), ("FIELD('z', 'a')", 0), ("STRCMP('a', 'b')", -1),
        ("DAYNAME('2024-01-01')", "Monday"), ("DATE_FORMAT('2024-02-03', '%d.%m.%y at %%')", "03.02.24 at %"), ("TIMESTAMPDIFF(DAY, '2024-01-01', '2024-02-01')", 31), ("JSON_VALUE('{\"a\": \"x\"}', '$.a' RETURNING SIGNED DEFAULT 0 ON ERROR)", 0),
        ("JSON_VALUE('{}', '$.a' DEFAULT 'e' ON EMPTY)", "e"), ("3 MEMBER OF('[1,3]')", True), ("NULL = ALL (SELECT k FROM t WHERE k > 9)", True), ("2 <> ANY (SELECT k FROM t)", True), ("3 >= ALL (SELECT k FROM t)", True),
        ("'A' COLLATE utf8mb4_0900_ai_ci = 'a'", True), ("MAKEDATE(2023, 365)", __import__("datetime").date(2023, 12, 31)), ("CRC32('a')", 3904355907), ("EXTRACT(MICROSECOND FROM TIMESTAMP '2024-01-01 00:00:01.5')", 500000),
    ],
)
def test_values(engine, sql, want):
    assert one(engine, sql) == want or abs(one(engine, sql) - want) < 1e-9


def test_writes(engine):
    assert engine.execute("INSERT IGNORE INTO t VALUES (1, 'zz'), (4, 'd')").first().affected_rows == 2
    assert sorted(map(tuple, engine.query("SELECT * FROM t WHERE k <> 3").collect())) == [(1, "a"), (2, "b"), (4, "d")]
    engine.execute("INSERT INTO t (s, k) VALUES ('q', 1) AS new ON DUPLICATE KEY UPDATE s = CONCAT(s, new.s)")
    assert engine.query("SELECT s FROM t WHERE k = 1").first().s == "aq"
    assert engine.execute("UPDATE t SET s = 'u' WHERE s IS NULL OR k = 4 ORDER BY k DESC LIMIT 1").first().affected_rows == 1
    assert engine.query("SELECT k FROM t WHERE s = 'u'").first().k == 4
    assert engine.execute("WITH c AS (SELECT 2 AS x) DELETE FROM t WHERE k IN (SELECT x FROM c)").first().affected_rows == 1
    assert engine.execute("DELETE FROM t USING t JOIN u ON t.k = u.k").first().affected_rows == 2
    assert [r.k for r in engine.query("SELECT k FROM t").collect()] == [4]
    engine.execute("CREATE TABLE w (a BIGINT UNSIGNED NOT NULL, b ENUM('x', 'y'), c MEDIUMINT, PRIMARY KEY (a)); INSERT INTO w VALUES (1, 'x', 2); CREATE TABLE w2 LIKE w")
    assert engine.query("SELECT COUNT(*) AS n FROM w").first().n == 1 and engine.query("SELECT COUNT(*) AS n FROM w2").first().n == 0
    assert {r.field for r in engine.query("SHOW COLUMNS FROM w").collect()} == {"a", "b", "c"}


def test_session_statements(engine):
    engine.execute("SET NAMES utf8mb4; SET @a = 1 + 1, @b = 'x'; BEGIN; COMMIT; CREATE INDEX i ON t (k)")
    assert engine.variables["a"] == 2 and engine.variables["b"] == "x"
    engine.execute("PREPARE p FROM 'SELECT k FROM t WHERE k = ? AND s <> ?'")
    assert [r.k for r in engine.execute("EXECUTE p USING @a, @b").collect()] == [2]
    engine.execute("DEALLOCATE PREPARE p")
    with pytest.raises(KeyError):
        engine.execute("EXECUTE p USING @a, @b")
    engine.query("SELECT SQL_CALC_FOUND_ROWS k FROM t ORDER BY k LIMIT 1")
    assert engine.found_rows == 3
    with pytest.raises(SqlError):
        engine.query("SELECT ?", [])
    with pytest.raises(SqlError):
        engine.execute("LOAD DATA INFILE 'x' INTO TABLE t")
    engine.guards.append(CircuitBreak(["(?i)select .* for update"]))
    with pytest.raises(QueryRejected):
        engine.query("select k from t FOR UPDATE")


def test_frames(engine):
    rows = engine.query("SELECT k, SUM(k) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS s, COUNT(k) OVER (ORDER BY k GROUPS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS n FROM t ORDER BY k").collect()
    assert [tuple(r) for r in rows] == [(1, 5, 2), (2, 4, 2), (3, 3, 1)]
    assert [r.m for r in engine.query("SELECT MIN(k) OVER (ORDER BY k ROWS CURRENT ROW EXCLUDE CURRENT ROW) AS m FROM t").collect()] == [None] * 3
    assert engine.query("SELECT SUM(k) OVER (ORDER BY k EXCLUDE NO OTHERS) AS m FROM t").count() == 3
    for bad in ("SELECT MIN(k) OVER (ORDER BY k EXCLUDE TIES) FROM t", "SELECT SUM(k) OVER (ORDER BY k ROWS 1 PRECEDING EXCLUDE GROUP) FROM t", "SELECT *, SUM(k) OVER (ORDER BY k GROUPS 1 PRECEDING) FROM t"):
        with pytest.raises(SqlError):
            engine.query(bad)


@pytest.mark.parametrize(
    "sql, want",
    [
        ("1 XOR 1 AND 0", True), ("1 XOR 2", False), ("CAST('12abc' AS SIGNED)", 12), ("CAST(9007199254740993 + 0 AS SIGNED)", 9007199254740993), ("CAST('abc' AS SIGNED)", None), ("CAST(NULL AS SIGNED)", None), ("CAST(-1 AS UNSIGNED)", 18446744073709551615),
        ("JSON_EXTRACT('{\"a\": \"x\", \"b\": [1, 2]}', '$.a')", '"x"'), ("JSON_UNQUOTE('\"a\\\\nb\"')", "a\nb"), ("JSON_LENGTH('{\"a\": 1, \"b\": 2}')", 2), ("JSON_LENGTH('[1,2,3]')", 3), ("JSON_LENGTH('5')", 1),
        ("JSON_CONTAINS('{\"a\": 1, \"b\": \"x\"}', '{\"b\": \"x\"}')", True), ("JSON_CONTAINS('{\"a\": 1}', '{\"a\": 2}')", False), ("JSON_CONTAINS('[1, 2]', '[2]')", True), ("JSON_TYPE('[1]')", "ARRAY"),
        ("JSON_CONTAINS_PATH('{\"a\": 1}', 'one', '$.x', '$.a')", True), ("JSON_VALUE(JSON_SET('{\"a\": 1}', '$.b', 'z'), '$.b')", "z"), ("JSON_REMOVE('{\"a\": 1, \"b\": 2}', '$.a')", '{"b":2}'), ("JSON_REPLACE('{\"a\":1}', '$.b', 2)", '{"a":1}'),
        ("JSON_MERGE_PATCH('{\"a\":1,\"b\":2}', '{\"b\":null,\"c\":3}')", '{"a":1,"c":3}'),
        ("DATE_FORMAT('2024-01-05', '%D %w %U %u %V %v %X %x')", "5th 5 00 01 53 01 2023 2024"), ("DATE_FORMAT('2023-01-01', '%U|%u|%V|%v|%X|%x')", "01|00|01|52|2023|2022"), ("DATE_FORMAT('2024-12-30', '%v %x')", "01 2025"),
        *[(f"WEEK('2024-01-01', {m})", w) for m, w in enumerate((0, 1, 53, 1, 1, 1, 1, 1))], *[(f"WEEK('2021-12-31', {m})", w) for m, w in enumerate((52, 52, 52, 52, 52, 52, 52, 52))], ("YEARWEEK('2023-01-01', 1)", 202252),
        ("TIMEDIFF('10:00:00', '12:30:15')", "-02:30:15"), ("TIMEDIFF('2024-01-02 00:00:00', '2024-01-01 22:00:00')", "02:00:00"), ("ADDTIME('01:00:00', '00:30:30')", "01:30:30"), ("ADDTIME('2024-01-01 23:00:00', '02:00:00')", "2024-01-02 01:00:00"),
        ("SEC_TO_TIME(3661)", "01:01:01"), ("TIME_TO_SEC('01:01:01')", 3661), ("MAKETIME(1, 2, 3)", "01:02:03"), ("PERIOD_ADD(202311, 3)", 202402), ("PERIOD_DIFF(202402, 202311)", 3), ("INET_ATON('10.0.5.9')", 167773449), ("INET_NTOA(167773449)", "10.0.5.9"),
        ("ORD('é')", 50089), ("UNIX_TIMESTAMP('2024-01-05')", 1704412800), ("DATE_FORMAT(CONVERT_TZ('2024-01-01 12:00:00', '+00:00', '+05:30'), '%H:%i')", "17:30"), ("@@version", "8.0.0-shardloom"),
    ],
)
def test_more_values(engine, sql, want):
    assert one(engine, sql) == want


def test_variables_of_a_select_and_counts_of_rows(engine):
    assert engine.query("SELECT @x := 5, @y := k AS y FROM t WHERE k = 2").first().y == 2
    assert engine.variables["x"] == 5 and engine.variables["y"] == 2
    engine.execute("DELETE FROM t WHERE k < 3")
    assert engine.query("SELECT ROW_COUNT() AS n").first().n == 2


def test_from_the_last_row_of_a_frame(engine):
    got = engine.query("SELECT k, NTH_VALUE(k, 2) FROM LAST OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a, NTH_VALUE(k, 2) FROM LAST OVER (ORDER BY k) AS b FROM t ORDER BY k").collect()
    assert [tuple(r) for r in got] == [(1, 2, None), (2, 2, 1), (3, 2, 2)]
