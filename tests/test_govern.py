import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shardloom.operators import partition, window
from shardloom.plans import govern
from shardloom.plans.engine import Engine
from shardloom.plans.govern import READ, READWRITE, Node
from shardloom.plans.tokens import SqlError
from shardloom.sources import endpoints
from shardloom.sources.rules import Level, ShardingRule
from shardloom.streaming import monitors


def test_balancing():
    even = govern.RoundRobin([Node("a"), Node("b")])
    assert [even.next().name for _ in range(4)] == ["a", "b", "a", "b"]
    heavy = govern.RoundRobin([Node("a", 3), Node("b", 1)])
    assert Counter(heavy.next().name for _ in range(8)) == {"a": 6, "b": 2}
    rand = govern.RandomWeighted([Node("a", 9), Node("b", 1)], seed=1)
    assert Counter(rand.next().name for _ in range(500))["a"] > 400
    with pytest.raises(ValueError):
        govern.RoundRobin([])


def test_routing():
    nodes = [Node("rw"), Node("r1", role=READ), Node("r2", role=READ)]
    router = govern.Router(nodes, [govern.Rule(["^select"], READ), govern.Rule(["^insert"], READWRITE)], generic=False)
    assert router.target("insert into t values (1)") == READWRITE and router.target("set names x") == READWRITE and router.target(None) == READWRITE
    assert router.target("select 1") == READ and router.target("select 1", in_transaction=True) == READWRITE
    assert [router.route("select 1").name for _ in range(3)] == ["r1", "r2", "r1"]
    generic = govern.Router(nodes)
    assert [generic.target(s) for s in ("SELECT 1", "update t set a = 1", "start transaction", "")] == [READ, READWRITE, READWRITE, READWRITE]


def test_router_column_agrees(spark):
    router = govern.Router([Node("rw")], [govern.Rule(["for update$"], READWRITE)])
    log = ["select 1", "select 1 for update", "delete from t", None]
    got = spark.createDataFrame([(s,) for s in log], "s string").select("s", router.column(F.col("s")).alias("t")).collect()
    assert all(r.t == router.target(r.s) for r in got)


def test_guards():
    govern.CircuitBreak(["^SELECT .* FOR UPDATE"])("select a for update")
    with pytest.raises(govern.QueryRejected):
        govern.CircuitBreak(["^SELECT .* FOR UPDATE"], ignore_case=True)("select a for update")
    control = govern.ConcurrencyControl(["^select"], most=3)
    gate, passed = threading.Barrier(5), []

    def run():
        gate.wait()
        try:
            passed.append(control.enter("SELECT 1"))
        except govern.QueryRejected:
            pass

    threads = [threading.Thread(target=run) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert passed == [True] * 3 and control.enter("insert") is False
    control.leave()
    with control.slot("select 2"), pytest.raises(govern.QueryRejected):
        control.enter("select 3")
    short = govern.ConcurrencyControl(["x"], most=1, duration=0.0)
    assert short.enter("x") and short.enter("x")


def test_chain_and_metrics():
    double = lambda nxt: lambda x: nxt(x) * 2
    add = lambda nxt: lambda x: nxt(x) + 1
    assert govern.chain([double, add], lambda x: x)(3) == 8
    metrics = govern.Metrics()
    with metrics.timed("d", "query", "s"):
        assert metrics.flight["d", "query", "s"] == 1
    text = metrics.exposition()
    assert 'sql_processed_total{domain="d",type="query",server="s"} 1' in text and 'le="+Inf"} 1' in text


def test_stream_of_monitor_reports(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1, "up"), ("a", 3, "down"), ("b", 2, "up")], "node string, at long, state string").withColumn("at", F.timestamp_seconds("at"))
    frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in")
    seen = []
    query = monitors.watch(stream, "node", "at", "state").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(r.node, r.state) for r in seen} == {("a", "down"), ("b", "up")}


def test_partitions_and_frames(spark):
    df = spark.createDataFrame([(i, i % 3, None if i == 4 else i * 10) for i in range(9)], "i int, g int, v int")
    p = df.select(partition.range_partition(F.col("v"), [20, 60]).alias("r"), partition.list_partition(F.col("g"), [[0, None], [2]]).alias("l"), partition.linear_hash_partition(F.col("i"), 6).alias("h"), "i").orderBy("i").collect()
    assert [x.r for x in p] == [0, 0, 1, 1, 0, 1, None, None, None] and [x.l for x in p][:3] == [0, None, 1]
    assert [x.h for x in p] == [0, 1, 2, 3, 4, 5, 2, 3, 0]
    got = {r.i: r for r in window.exclude_current(df, ["g"], [F.col("i")], -1, 1, "v").collect()}
    assert (got[4].sum_, got[4].count_, got[4].min_, got[4].max_) == (80, 2, 10, 70) and got[0].sum_ == 30
    with pytest.raises(ValueError):
        window.exclude_current(df, ["g"], [F.col("i")], -1, 1, "v", "others")


@pytest.mark.parametrize("what", ["group", "ties"])
@pytest.mark.parametrize("low, high", [(-2, 2), (window.PRECEDING, 0), (0, window.FOLLOWING), (window.PRECEDING, window.FOLLOWING), (-3, -1)])
def test_frames_without_peers_against_loops(spark, what, low, high):
    rows = [(i, i % 2, (i * 7) % 5, None if i == 6 else (i * 37) % 23) for i in range(24)]
    df = spark.createDataFrame(rows, "i int, g int, k int, v int")
    got = window.exclude_current(df.repartition(1).sortWithinPartitions("i"), ["g"], [F.col("k")], low, high, "v", what)
    for g in (0, 1):
        have = got.where(F.col("g") == g).collect()
        for at, r in enumerate(have):
            frame = range(max(0, at + low), min(len(have) - 1, at + high) + 1)
            left = [have[j].v for j in frame if (have[j].k != r.k or what == "ties" and j == at) and have[j].v is not None]
            assert (r.count_, r.sum_, r.min_, r.max_) == (len(left), sum(left) if left else None, min(left, default=None), max(left, default=None))


def test_governance_of_an_engine(spark):
    metrics = govern.Metrics()
    router = govern.Router([Node("primary"), Node("replica", role=READ)])
    control, seen = govern.ConcurrencyControl(["(?i)^select"], most=1), []
    outer = lambda service: lambda sql: (seen.append(sql), service(sql))[1]
    engine = Engine(spark, guards=[govern.CircuitBreak(["a=1 and b='x'"]), control], layers=[outer], router=router, metrics=metrics, domain="d")
    engine.add("t", spark.createDataFrame([(1, "a")], "a int, b string"))
    assert engine.query("SELECT a FROM t").first().a == 1 and engine.server == "replica"
    with pytest.raises(govern.QueryRejected):
        engine.query("SELECT a FROM t WHERE a=1 and b='x'")
    with control.slot("select"), pytest.raises(govern.QueryRejected):
        engine.query("SELECT a FROM t")
    engine.execute("BEGIN; SELECT a FROM t; DELETE FROM t; ROLLBACK")
    assert engine.server == "primary" and not engine.in_transaction and engine.query("SELECT COUNT(*) AS n FROM t").first().n == 1
    assert seen[:2] == ["SELECT a FROM t", "SELECT a FROM t WHERE a=1 and b='x'"] and "DELETE FROM t" in seen
    assert metrics.total["d", "SELECT", "replica"] == 2 and metrics.total["d", "DELETE", "primary"] == 1


def test_groups_of_endpoints_behind_shards(spark):
    rule = ShardingRule("t", ("g0", "g1"), Level("k", 2))
    groups = {g: govern.Router([Node(f"{g}-rw"), Node(f"{g}-r", role=READ)]) for g in rule.nodes}
    urls = {n: f"jdbc:{n}" for g in rule.nodes for n in (f"{g}-rw", f"{g}-r")}
    asked = []

    def read(_, url, table):
        asked.append((url, table))
        return spark.createDataFrame([(len(asked),)], "k long")

    assert endpoints.read_groups(spark, groups, urls, rule, read=read).count() == 2
    endpoints.read_groups(spark, groups, urls, rule, "SELECT 1", True, read)
    assert asked == [("jdbc:g0-r", "t"), ("jdbc:g1-r", "t"), ("jdbc:g0-rw", "t"), ("jdbc:g1-rw", "t")]


def test_transactions(spark):
    engine = Engine(spark)
    engine.add("t", spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "k int, n int"))
    count = lambda: engine.query("SELECT COUNT(*) AS n FROM t").first().n
    engine.execute("SET autocommit = 0; DELETE FROM t WHERE n = 2")
    assert engine.in_transaction and count() == 2
    engine.execute("ROLLBACK; SET autocommit = 1")
    assert count() == 3
    engine.execute("BEGIN; SAVEPOINT s; INSERT INTO t VALUES (3, 3); ROLLBACK TO SAVEPOINT s; RELEASE SAVEPOINT s; DELETE FROM t WHERE k = 2; COMMIT; ROLLBACK")
    assert count() == 2
    with pytest.raises(SqlError):
        engine.execute("ROLLBACK TO s")


def test_tables_as_they_are_defined(spark):
    engine = Engine(spark)
    engine.execute("CREATE TABLE w (id BIGINT NOT NULL AUTO_INCREMENT, a INT NOT NULL, b VARCHAR(9) DEFAULT 'none', c INT GENERATED ALWAYS AS (a * 2) STORED, PRIMARY KEY (id), UNIQUE KEY u (a)) PARTITION BY HASH(a) PARTITIONS 3")
    engine.execute("INSERT INTO w (a, b) VALUES (5, 'x'), (6, DEFAULT); INSERT INTO w (a) VALUES (7)")
    assert sorted(map(tuple, engine.query("SELECT id, a, b, c FROM w").collect())) == [(1, 5, "x", 10), (2, 6, "none", 12), (3, 7, "none", 14)]
    engine.execute("UPDATE w SET a = a + 1 WHERE id = 3")
    assert engine.query("SELECT c FROM w WHERE a = 8").first().c == 16
    with pytest.raises(SqlError):
        engine.execute("INSERT INTO w (b) VALUES ('y')")
    assert [r.column for r in engine.query("SHOW KEYS FROM w").collect()] == ["id"]
    engine.execute("DROP TABLE w; DROP TABLE IF EXISTS w")
    for form in ("PROCESSLIST", "GRANTS", "ENGINES", "PRIVILEGES", "FUNCTION STATUS"):
        assert engine.query(f"SHOW {form}").columns
