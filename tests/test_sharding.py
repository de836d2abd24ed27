import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shardloom.plans.engine import Engine
from shardloom.plans.prune import key_values
from shardloom.plans.tokens import scan, tree
from shardloom.sources import endpoints, layout
from shardloom.sources.rules import Level, ShardingRule, from_toml, shard_column, shard_of

BOTH = ShardingRule("tshard", ("db0", "db1"), Level("didx", 2), Level("idx", 4))
DATABASE = ShardingRule("tshard", ("db0", "db1"), database=Level("idx", 2))
TABLE = ShardingRule("tshard", ("db",), tables=Level("idx", 4))


def shards(rule, where, alone=True, qualifier="tshard"):
    """The (db, tbl) pairs that a condition leaves."""
    at = rule.implied(key_values(tree(scan(where)), qualifier, alone))
    return [(d, t) for d, t in rule.shards() if d in at.get("_db", [d]) and t in at.get("_tbl", [t])]


def test_shard_function_values():
    assert [shard_of(k, 4) for k in (3, 4, 22, 57, 37)] == [3, 0, 2, 1, 1]
    assert [shard_of(k, 2) for k in (5, 6, 12, 13, 19)] == [1, 0, 0, 1, 1]
    assert zlib.crc32(struct.pack(">q", 12345)) == 3848364434 and shard_of(12345, 7, "crc32mod") == 3848364434 % 7
    assert shard_of(-3, 4) == 1 and shard_of(None, 4) == 0 and shard_of(2.6, 4) == 3


@pytest.mark.parametrize("strategy", ["mod", "crc32mod"])
def test_columns_agree_with_literals(spark, strategy):
    keys = [0, 1, -1, 5, 2**40, -(2**50), 12345, None]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    got = frame.select("k", shard_column(F.col("k"), 5, strategy).alias("s")).collect()
    assert all(r.s == shard_of(r.k, 5, strategy) for r in got)


def test_pruning_decisions():
    assert len(shards(BOTH, "idx > 3")) == 8
    assert shards(BOTH, "idx = 3") == [(0, 3), (1, 3)]
    assert shards(BOTH, "didx = 5") == [(1, 0), (1, 1), (1, 2), (1, 3)]
    assert shards(BOTH, "didx = 6 AND idx = 3") == [(0, 3)]
    assert shards(DATABASE, "idx = 3") == [(1, 0)]
    assert shards(TABLE, "4 = idx") == [(0, 0)]
    assert shards(TABLE, "idx IN (1, 2, 5)") == [(0, 1), (0, 2)]
    assert shards(TABLE, "idx <=> 6 AND (a > 1 AND tshard.idx = 6)") == [(0, 2)]
    assert shards(TABLE, "t.idx = 6", qualifier="t") == [(0, 2)]
    assert shards(TABLE, "idx = 1 AND idx = 2") == []
    for none in ("idx = 3 OR a = 1", "NOT idx = 3", "idx = 3 XOR a = 1", "idx = 2.5", "idx = '3'", "x.idx = 3", "idx BETWEEN 3 AND 3", "idx = idx + 1"):
        assert len(shards(TABLE, none)) == 4, none
    assert len(shards(TABLE, "idx = 3", alone=False)) == 4


def test_row_routing():
    rows = [{"didx": a, "idx": b} for a, b in ((12, 22), (13, 57), (19, 37))]
    assert [BOTH.route(r) for r in rows] == [(0, 2), (1, 1), (1, 1)]
    assert [DATABASE.route({"idx": k})[0] for k in (12, 13, 16)] == [0, 1, 0]
    assert BOTH.physical_name(1, 2) == "db1.tshard_00002" and DATABASE.physical_name(0) == "db0.tshard"


def test_configuration():
    config = from_toml(
        """
        [[sharding]]
        table = "t_order"
        nodes = ["ds0", "ds1"]
        database = {column = "user_id"}
        tables = {column = "order_id", count = 4, strategy = "crc32mod"}
        """
    )
    assert config.rules == [ShardingRule("t_order", ("ds0", "ds1"), Level("user_id", 2), Level("order_id", 4, "crc32mod"))]
    with pytest.raises(ValueError):
        Level("a", 2, "other")
    with pytest.raises(ValueError):
        ShardingRule("t")


def rows(spark):
    return spark.range(200).selectExpr("id AS idx", "id * 7 % 31 AS didx", "CAST(id % 13 AS DOUBLE) AS price", "CAST(id % 5 AS STRING) AS name")


def test_pruned_reads_only_its_shards(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.add("tshard", rows(spark), BOTH, stored=True)
    got = engine.query("SELECT * FROM tshard WHERE didx = 6 AND idx = 23")
    assert got.columns == ["idx", "didx", "price", "name"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]
    assert "_db" in filters and "_tbl" in filters and len(got.inputFiles()) <= len(engine.tables["tshard"].df.inputFiles())
    files = {f.split("/_db=")[1].rsplit("/", 1)[0] for f in spark.table(f"{engine.prefix}_tshard").where("_db = 0 AND _tbl = 3").inputFiles()}
    assert files and all(f.startswith("") for f in files)


CONDITIONS = st.lists(
    st.one_of(
        st.tuples(st.sampled_from(["idx", "didx"]), st.sampled_from(["=", "<=>"]), st.integers(-3, 40)).map(lambda x: f"{x[0]} {x[1]} {x[2]}"),
        st.tuples(st.sampled_from(["idx", "didx"]), st.lists(st.integers(0, 40), min_size=1, max_size=4)).map(lambda x: f"{x[0]} IN ({', '.join(map(str, x[1]))})"),
        st.sampled_from(["price > 3", "(idx = 4 OR didx = 2)", "NOT idx = 3", "name BETWEEN '1' AND '3'"]),
    ),
    min_size=1, max_size=3,
)


@settings(max_examples=25, deadline=None)
@given(CONDITIONS)
def test_sharded_answers_like_unsharded(spark, parts):
    where = " AND ".join(parts)
    answers = []
    for rule in (None, BOTH, DATABASE, TABLE):
        engine = Engine(spark)
        engine.add("tshard", rows(spark), rule)
        answers.append(sorted(map(tuple, engine.query(f"SELECT idx, name FROM tshard t WHERE {where}").collect())))
    assert all(a == answers[0] for a in answers)


def test_route_counts_and_sinks(spark, tmp_path):
    counts = {(r["_db"], r["_tbl"]): r.n_rows for r in layout.route_counts(rows(spark), BOTH).collect()}
    assert sum(counts.values()) == 200 and set(counts) == set(BOTH.shards())
    engine = Engine(spark)
    engine.add("tshard", rows(spark))
    engine.execute(f"SELECT idx, NULLIF(name, '1') FROM tshard WHERE idx < 3 ORDER BY idx INTO OUTFILE '{tmp_path}/out' FIELDS TERMINATED BY ';'")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["0;0", "1;\\N", "2;2"]
    engine.execute(f"SELECT 'a', 1 INTO DUMPFILE '{tmp_path}/dump'")
    engine.execute("SELECT COUNT(*), MAX(name) INTO @n, @m FROM tshard")
    assert (engine.variables["n"], engine.variables["m"]) == (200, "4")
    assert [r.idx for r in engine.query("SELECT idx FROM tshard WHERE idx = @n - 1").collect()] == [199]


def test_shards_in_databases_by_jdbc(spark):
    """The shards of a rule as tables of two databases (Derby, in memory), read as one table."""
    rule = ShardingRule("orders", ("ds0", "ds1"), Level("c", 2), Level("k", 2))
    rows = [(k, k % 5, f"n{k}") for k in range(40)]
    frame = spark.createDataFrame(rows, "k long, c long, n string")
    driver = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    urls = [f"jdbc:derby:memory:shards{i};create=true" for i in range(2)]
    for db, tbl in rule.shards():
        part = frame.where((F.pmod("c", F.lit(2)) == db) & (F.pmod("k", F.lit(2)) == tbl))
        part.write.format("jdbc").options(url=urls[db], dbtable=f"orders_{tbl:05d}", driver=driver).mode("overwrite").save()
    got = endpoints.read_shards(spark, urls, rule, driver=driver)
    assert sorted((r.k, r.c, r.n) for r in got.collect()) == rows
    one = got.where("_db = 1 AND _tbl = 0 AND k > 10")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("JDBCRelation") == 1 and "PushedFilters: [" in plan
    assert sorted(r.k for r in one.collect()) == [k for k, c, _ in rows if c % 2 == 1 and k % 2 == 0 and k > 10]
