"""Session settings of the engine."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Settings that the engine's semantics rely on; a session may set others freely.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName("shardloom")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Used only by local sessions (tests, notebooks) that name no shared folder.
LOCAL_FOLDER = "/tmp/checkpoints/shardloom"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``). Only a
    session without executors of their own may do without the setting."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(LOCAL_FOLDER)
    return LOCAL_FOLDER


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have a working table deleted when the application ends."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def load(spark: SparkSession, folder: str, name: str):
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
