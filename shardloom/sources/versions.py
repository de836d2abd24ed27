"""Logical tables as sets of files that never change: a write adds files, and replaces only
those that hold rows it changed.

A table is what was registered (``base``, without the files that were replaced since) and
files of its own below ``home``. Rows have an identity, the file and their place in it, as
Parquet's readers tell it; what was registered as anything but Parquet files is written once
before rows of it change. A state is a small immutable value, so a snapshot costs nothing.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.sources import layout
from shardloom.sources.rules import ShardingRule

FILE, ROW = "_file", "_row"


@dataclass(frozen=True)
class State:
    """The files of a table: those of the base that were replaced, and its own. Files have the
    names that ``_metadata.file_path`` gives them."""

    base: DataFrame | None
    replaced: frozenset[str] = frozenset()
    own: tuple[str, ...] = ()
    dropped: bool = False


@dataclass(frozen=True)
class Definition:
    """What CREATE TABLE says of columns: the key (PRIMARY, else the first UNIQUE), defaults,
    columns that take no null, generated columns; texts are Spark SQL."""

    key: tuple[str, ...] = ()
    defaults: tuple[tuple[str, str], ...] = ()
    required: tuple[str, ...] = ()
    generated: tuple[tuple[str, str], ...] = ()
    increments: str | None = None


class Table:
    def __init__(self, spark: SparkSession, name: str, base: DataFrame, rule: ShardingRule | None, folder: str, definition: Definition = Definition()):
        self.spark, self.name, self.rule, self.definition = spark, name, rule, definition
        self.levels = list(rule.levels) if rule else []
        self.columns = [c for c in base.columns if c not in ("_db", "_tbl")]
        self.schema = base.select(*(F.col(f"`{c}`") for c in self.columns)).schema
        self.home = f"{folder}/{name}-{uuid.uuid4().hex}"
        self.state = State(base)
        self.version = 0

    @property
    def key(self) -> tuple[str, ...]:
        """The declared key; the first column stands for one where none is declared."""
        return self.definition.key or (self.columns[0],)

    @property
    def df(self) -> DataFrame:
        return self.rows()

    def _frames(self, state: State, identity: bool) -> list[DataFrame]:
        names = [F.col(f"`{c}`") for c in [*self.columns, *self.levels]]
        marks = [F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW)] if identity else []
        out = []
        if state.base is not None:
            base = state.base
            if state.replaced:
                base = base.where(~F.col("_metadata.file_path").isin(*sorted(state.replaced)))
            out.append(base.select(*names, *marks))
        if state.own:
            out.append(self._read(list(state.own)).select(*names, *marks))
        return out

    def _read(self, paths: list[str]) -> DataFrame:
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema] + [f"`{c}` int" for c in self.levels]
        return self.spark.read.schema(", ".join(kinds)).option("basePath", self.home).parquet(*map(unquote, paths))

    def rows(self, identity: bool = False, state: State | None = None) -> DataFrame:
        """The rows, with their shard columns; with ``_file`` and ``_row`` for ``identity``."""
        if identity:
            self._own_files()
        frames = self._frames(state or self.state, identity)
        if not frames:
            empty = self.spark.createDataFrame([], self.schema).withColumns({c: F.lit(0) for c in self.levels})
            return empty.withColumns({FILE: F.lit(""), ROW: F.lit(0).cast("long")}) if identity else empty
        out = frames[0]
        for more in frames[1:]:
            out = out.unionByName(more)
        return out

    def _own_files(self) -> None:
        """Rows of anything but Parquet files are written, so that they have an identity."""
        if self.state.base is None:
            return
        try:
            self.state.base.select("_metadata.row_index")
        except AnalysisException:
            self.state = replace(self.state, base=None, own=(*self.state.own, *self.write(self.state.base)))

    def write(self, rows: DataFrame) -> tuple[str, ...]:
        """``rows`` as new files, to the shards their keys say; the files are not yet part of
        the table."""
        kinds = {f.name: f.dataType for f in self.schema}
        rows = rows.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in self.columns))
        self.version += 1
        path = f"{self.home}/_v={uuid.uuid4().hex}"
        if self.rule is not None:
            layout.write_sharded(rows, self.rule, path)
        else:
            rows.write.parquet(path)
        return tuple(re.sub("^file:/+", "file:/", f) for f in self._read([path]).inputFiles())

    def append(self, rows: DataFrame) -> int:
        """Add rows: no file that is there is read or written. Gives their number."""
        files = self.write(rows)
        self.state = replace(self.state, own=(*self.state.own, *files))
        return self._read(list(files)).count() if files else 0

    def of_files(self, files: set[str]) -> DataFrame:
        """Rows, with their identity, of some files only."""
        own = tuple(f for f in self.state.own if f in files)
        rest = files - set(own)
        state = State(self.state.base if rest else None, self.state.replaced, own)
        rows = self.rows(True, state)
        return rows.where(F.col(FILE).isin(*sorted(files))) if rest else rows

    def swap(self, files: set[str], rows: DataFrame, more: tuple[str, ...] = ()) -> None:
        """Replace ``files`` by new ones that hold ``rows``."""
        fresh = self.write(rows) if files else ()
        own = set(self.state.own)
        gone = frozenset(f for f in files if f not in own)
        kept = tuple(f for f in self.state.own if f not in files)
        self.state = replace(self.state, replaced=self.state.replaced | gone, own=(*kept, *fresh, *more))


def touched(hits: DataFrame) -> set[str]:
    """The files of some rows (one name for each file)."""
    return {r[0] for r in hits.select(FILE).distinct().collect()}


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return (left[FILE] == right[FILE]) & (left[ROW] == right[ROW])
