"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as
Parquet and read again as the docs of the next. All but the last return the columns of
their docs. Rows are told apart by hashes of their contents, so repeated and null ids do no
harm; rows that are equal in all that counts are interchangeable.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm import huffman, langid, mixing, simhash, winnow
from shardloom.llm._common import materialise, table

#: A document without a letter, or whose leading language has a smaller share, is rejected.
LEAST_SHARE = 0.4

#: No SQL states the mixture inference or the cube method; tests hold each stage against
#: brute force.
ORACLE_SQL = None


def _keyed(docs: DataFrame, key: Column) -> DataFrame:
    """``docs`` as a key and a row of all its columns, whatever their names."""
    return docs.select(key.alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of one leading language."""
    whole = _keyed(docs, F.lit(0)).select("doc", F.col("doc.text").alias("text"))
    found = langid.identify(whole, langid.fold_model(docs))
    kept = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SHARE)
    return found.where(kept).select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group that pairs of near copies connect (a similarity of 0.8
    or more on shingles of five words): that of the smallest doc_id (a hash of the text stands
    for a null one), and of the smallest hash of doc_id and text where ids repeat."""
    keyed = _keyed(docs, F.xxhash64("doc_id", "text"))
    groups = simhash.near_copies(keyed.select(F.col("key").alias("doc_id"), F.col("doc.text").alias("text")))
    groups = groups.select(F.col("doc_id").alias("key"), "component_id").distinct()
    named = keyed.select("key", F.coalesce(F.col("doc.doc_id").cast("long"), F.xxhash64("doc.text")).alias("id"))
    first = named.join(groups, "key").groupBy("component_id").agg(F.min(F.struct("id", "key")).alias("first"))
    return keyed.join(first.select("first.key"), "key", "left_semi").dropDuplicates(["key"]).select("doc.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    keyed = _keyed(docs, F.xxhash64("doc_id", "text"))
    found = winnow.decontaminate(keyed.select(F.col("key").alias("doc_id"), F.col("doc.text").alias("text")), table(spark, sf_dir, "benchmark"))
    leaks = found.where("contaminated").select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(leaks, "key", "left_anti").select("doc.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as the mix to target weights takes it."""
    taken = mixing.mix(docs).groupBy(F.col("order").alias("key")).agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    some = _keyed(docs, F.xxhash64("doc_id", "source", "text")).join(taken, "key").dropDuplicates(["key"])
    return some.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the mix as token files and report doc_id, start, n_tokens, ids_crc32 from them."""
    return huffman.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix_sources),
    ("token files", token_files),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
