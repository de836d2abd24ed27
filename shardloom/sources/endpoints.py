"""Physical tables in databases, by JDBC: the shards of a rule read as one logical table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.plans.govern import route_shards
from shardloom.sources.rules import ShardingRule


def read_endpoint(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """One physical table; Spark pushes filters and columns to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_groups(spark: SparkSession, groups: dict, urls: dict[str, str], rule: ShardingRule, sql: str = "SELECT", in_transaction: bool = False, read=read_endpoint, **options: str) -> DataFrame:
    """``read_shards`` where each of the rule's nodes is a group of endpoints: the router of a
    group (``groups``, by node) says which endpoint answers, ``urls`` has each one's address."""
    nodes = [rule.nodes[db % len(rule.nodes)] for db in range(rule.database.count if rule.database else 1)]
    chosen = route_shards([(node, db) for db, node in enumerate(nodes)], groups, sql, in_transaction)
    return read_shards(spark, [urls[chosen[node, db].name] for db, node in enumerate(nodes)], rule, read, **options)


def read_shards(spark: SparkSession, urls: list[str], rule: ShardingRule, read=read_endpoint, **options: str) -> DataFrame:
    """All shards of a rule: the union of its physical tables with their shard columns, so a
    partition predicate leaves out the tables it excludes before they are asked.

    ``urls`` has the endpoint of each database; ``read`` opens one physical table.
    """
    parts = []
    for db, tbl in rule.shards():
        at = {"_db": db, "_tbl": tbl}
        name = rule.physical_name(db, tbl).split(".", 1)[1]
        parts.append(read(spark, urls[db], name, **options).withColumns({c: F.lit(at[c]) for c in rule.levels}))
    return reduce(DataFrame.unionByName, parts)
