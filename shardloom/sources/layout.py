"""Sharded tables as partitioned Parquet, and sinks for query results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.session import forget_at_exit
from shardloom.sources.rules import ShardingRule


def with_shards(df: DataFrame, rule: ShardingRule) -> DataFrame:
    """``df`` with the shard columns of its rule."""
    return df.withColumns(rule.columns())


def write_sharded(df: DataFrame, rule: ShardingRule, path: str, mode: str = "errorifexists") -> None:
    """Deal rows to one folder for each shard. Rows of a shard are salted over tasks, so a
    shard that has most rows is not written by one task."""
    names = list(rule.levels)
    dealt = with_shards(df, rule)
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]), F.lit(4))
    dealt.repartition(*names, salt).write.mode(mode).partitionBy(*names).parquet(path)


def read_sharded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def store(df: DataFrame, rule: ShardingRule, path: str) -> DataFrame:
    """Write a table by its rule and read it back: a folder for each shard, and in it a file or
    more for each bucket if the rule has some."""
    spark = df.sparkSession
    if not rule.buckets:
        write_sharded(df, rule, path)
        return spark.read.parquet(path)
    names, name = list(rule.levels), f"stored_{uuid.uuid4().hex}"
    dealt = with_shards(df, rule)
    dealt = dealt.repartition(*names, F.pmod(F.hash(rule.inner_key), F.lit(rule.buckets)))
    dealt.write.partitionBy(*names).bucketBy(rule.buckets, rule.inner_key).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


_stored: list[tuple] = []


def _source(df: DataFrame) -> tuple | None:
    """What tells a scan's files apart from what they were before; None if there are too many."""
    spark, files = df.sparkSession, df.inputFiles()
    if not 0 < len(files) <= 64:
        return None
    out = [spark.sparkContext.applicationId]
    for f in sorted(files):
        place = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))
        status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
        out.append((f, status.getLen(), status.getModificationTime()))
    return tuple(out)


def stored(df: DataFrame, rule: ShardingRule, folder: str) -> DataFrame:
    """``store``, or what it wrote for the same rows and rule before in this application."""
    source = _source(df)
    for known, by, have, out in _stored:
        if source is not None and known == source and by == rule and out.sparkSession is df.sparkSession and df.sameSemantics(have):
            return out
    path = f"{folder}/{rule.table}-stored-{uuid.uuid4().hex}"
    out = store(df, rule, path)
    forget_at_exit(df.sparkSession, path)
    if source is not None:
        _stored.append((source, rule, df, out))
    return out


def route_counts(df: DataFrame, rule: ShardingRule) -> DataFrame:
    """Rows to insert by physical shard: _db, _tbl, n_rows."""
    dealt = with_shards(df, rule)
    cols = [F.col(c) if c in rule.levels else F.lit(0).alias(c) for c in ("_db", "_tbl")]
    return dealt.select(*cols).groupBy("_db", "_tbl").agg(F.count(F.lit(1)).alias("n_rows"))


def into_outfile(df: DataFrame, path: str, separator: str = "\t", quote: str | None = None, escape: str = "\\", line: str = "\n") -> None:
    """SELECT .. INTO OUTFILE: delimited text; nulls are written as ``\\N``."""
    writer = df.write.option("sep", separator).option("escape", escape).option("lineSep", line).option("nullValue", "\\N").option("emptyValue", "")
    writer = writer.option("quote", quote) if quote else writer.option("quote", "\u0000")
    writer.csv(path)


def into_dumpfile(df: DataFrame, path: str) -> None:
    """SELECT .. INTO DUMPFILE: one row's values, one after the other, without separators."""
    rows = df.limit(2)
    if rows.count() > 1:
        raise ValueError("INTO DUMPFILE asks for one row at most")
    rows.select(F.concat(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns)).alias("value")).coalesce(1).write.option("lineSep", "\u0000").text(path)
