"""What the plans of catalogue queries read, push down and exchange."""

import os
import re

import pytest

from shardloom.plans import catalog
from shardloom.plans.engine import Engine
from shardloom.sources.rules import Level, ShardingRule

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


def plan(spark, name):
    return catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_scans_read_what_is_asked_for(spark):
    text = plan(spark, "filter_basic")
    assert "PushedFilters: [" in text and "GreaterThan(o_totalprice" in text
    assert set(re.findall(r"\w+(?=:)", re.search(r"ReadSchema: struct<([^>]*)>", text)[1])) == {"o_orderkey", "o_orderstatus", "o_totalprice"}
    assert "Exchange" not in text


def test_pruned_shards_are_partition_filters(spark):
    for name, columns in (("shard_prune_point", ("_db", "_tbl")), ("shard_prune_db_only", ("_db",)), ("shard_prune_tbl_only", ("_tbl",))):
        filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan(spark, name))[1]
        assert all(c in filters for c in columns), name
    assert "PartitionFilters: []" in plan(spark, "shard_prune_none")


def test_aggregates_combine_before_their_exchange(spark):
    for name in ("sharded_db_table_agg", "agg_avg", "group_by_multi", "agg_count_distinct"):
        text = plan(spark, name)
        assert "partial_" in text and text.count("Exchange") <= 2, name


def test_topk_does_not_sort_everything(spark):
    assert "TakeOrderedAndProject" in plan(spark, "topk")


def test_no_python_and_no_cartesian_products(spark):
    for name in catalog.queries():
        text = plan(spark, name)
        assert "Python" not in text and "Pandas" not in text and "Arrow" not in text, name
        if name not in ("join_cross", "join_theta", "join_range", "json_table", "json_table_array", "cte_recursive"):
            assert "CartesianProduct" not in text, name


def test_sharded_tables_are_read_by_shard(spark):
    for name in ("sharded_table_agg", "scan_sharded", "sharded_revenue_by_segment", "sharded_db_table_agg", "agg_avg"):
        df = catalog.queries()[name](spark, FOLDER)
        assert any("/_tbl=" in f for f in df.inputFiles()), name


def test_tables_of_equal_rules_join_where_they_are(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark, "join_colocated")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange" not in text and "SortMergeJoin" in text and "Bucketed: true" in text


def files_of(engine, name):
    return {r[0] for r in engine.table(name).rows(identity=True).select("_file").distinct().collect()}


def test_writes_touch_only_what_they_change(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    rule = ShardingRule("orders", ("ds0", "ds1"), Level("o_custkey", 2), Level("o_orderkey", 4))
    engine.add("orders", orders, rule)
    first, shard = files_of(engine, "orders"), lambda f: re.findall("_(?:db|tbl)=[0-9]+", f)
    engine.execute("INSERT INTO orders SELECT o_orderkey + 8000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey = 1")
    second = files_of(engine, "orders")
    assert first < second and len(second - first) == 1
    assert engine.execute("UPDATE orders SET o_totalprice = -1 WHERE o_orderkey IN (3, 7) AND o_totalprice > 0").first().affected_rows == 2
    third = files_of(engine, "orders")
    assert second - third and all(shard(f)[-1] == "_tbl=3" for f in (second - third) | (third - second))
    assert engine.execute("DELETE FROM orders WHERE o_custkey = -5").first().affected_rows == 0 and files_of(engine, "orders") == third
    engine.execute("UPDATE orders SET o_orderkey = 4000001 WHERE o_orderkey = 3")
    assert engine.query("SELECT o_totalprice FROM orders WHERE o_orderkey = 4000001").first().o_totalprice == -1
    assert engine.query("SELECT COUNT(*) AS n FROM orders").first().n == orders.count() + 1
    gone = engine.vacuum()
    assert gone > 0 and engine.query("SELECT COUNT(*) AS n FROM orders WHERE o_totalprice = -1").first().n == 2
