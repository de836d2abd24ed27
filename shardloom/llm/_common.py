"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.session import forget_at_exit, shared_folder

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a re-read and not a recomputation,
    and makes what follows see one fixed set of rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch that an operator works on at once; one row may be larger.
BATCH_ROWS = 2000
BATCH_BYTES = 8 << 20
#: What workers keep between tasks; only the operator that ran last keeps anything.
_kept: list[dict] = []
_last = ""


def kept() -> dict:
    """A dict for what a worker keeps between the tasks of one operator."""
    _kept.append({})
    return _kept[-1]


def _enter(name: str) -> None:
    global _last
    if _last != name:
        for cache in _kept:
            cache.clear()
        _last = name


def trim() -> None:
    """Give freed memory back to the system, where the allocators can."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)


def bounded(batches: Iterator) -> Iterator:
    """Arrow batches in slices of bounded rows and bytes; anything else as it comes."""
    for batch in batches:
        if not isinstance(batch, pa.RecordBatch):
            yield batch
            continue
        each = max(1, batch.nbytes // max(1, batch.num_rows))
        rows = max(1, min(BATCH_ROWS, BATCH_BYTES // each))
        at = 0
        while at < batch.num_rows:
            some = batch.slice(at, rows)
            while some.num_rows > 1 and some.nbytes > 2 * BATCH_BYTES:
                some = some.slice(0, some.num_rows // 2)
            yield some
            at += some.num_rows


def own(name: str, run: Callable) -> Callable:
    """``run`` as a task of an operator: Python workers serve many operators in turn, and
    what one leaves in them would count against the next. Batches are bounded here, so no
    setting of the session has to be changed."""

    def task(batches: Iterator) -> Iterator:
        _enter(name)
        try:
            yield from run(bounded(batches))
        finally:
            trim()

    return task


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column's UTF-8 bytes, without decoding them."""
    column = batch.column(name)
    if pa.types.is_string(column.type):
        column = column.view(pa.binary())
    elif pa.types.is_large_string(column.type):
        column = column.view(pa.large_binary())
    return column.to_pylist()


def text_batches(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of column text, so that temporaries stay bounded."""
    lengths = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    at, ends = 0, np.cumsum(lengths, dtype=np.int64)
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most)))
        yield batch.slice(at, to - at)
        at = to


def long_of_hex(column):
    """Sixteen lowercase hex digits of a long, as for an unsigned number."""
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def _quantiles(df: DataFrame, column: str, n: int) -> list[int]:
    at = [i / n for i in range(1, n)]
    return (df.agg(F.percentile_approx(column, at, max(10_000, 10 * n)).alias("p")).first().p or []) if at else []


def range_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 ascending values that cut a long ``column`` into ranges of about equal
    row counts (a sketch: every row counts, no row is dropped)."""
    return sorted(set(_quantiles(df, column, n)))


def range_part(df: DataFrame, column: str, tie: str, n: int) -> Callable:
    """A function (column, tie) of names to the number of a row's range, n about in all, in
    ascending order of ``column`` and then of ``tie`` (a hash of 31 bits): a value that fills
    several ranges is cut by its ties, so no value has to fit in one range."""
    found = _quantiles(df, column, n)
    bounds = sorted(set(found))
    times = {v: found.count(v) for v in bounds if found.count(v) > 1}
    wide = max(times.values(), default=1) + 1

    def part(column: str, tie: str):
        inside = F.lit(0) if not times else F.lit(wide - 1)
        for v, k in times.items():
            inside = F.when(F.col(column) == v, F.shiftright(F.col(tie) * k, 31).cast("int")).otherwise(inside)
        return range_bucket(column, bounds) * wide + inside

    return part


def range_bucket(column: str, bounds: list[int]):
    """The number of ``bounds`` up to the value of ``column``, 0 for null: an ascending range
    of values for each bucket. Looked up in two steps, so a row costs about 2 sqrt(n)."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    value = F.col(column)
    count = lambda values: F.size(F.filter(values, lambda x: x <= value))
    coarse = F.array(*(F.lit(g[0]).cast("long") for g in groups))
    fine = F.array(*(F.array(*(F.lit(x).cast("long") for x in g)) for g in groups))
    group = F.greatest(count(coarse), F.lit(1))
    return (group - 1) * step + count(F.element_at(fine, group))
