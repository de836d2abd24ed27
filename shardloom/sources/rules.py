"""Sharding rules: how a logical table is dealt to databases and tables."""

from __future__ import annotations

import json
import struct
import tomllib
import urllib.request
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

STRATEGIES = ("mod", "crc32mod")


def shard_of(value: int | float | None, n: int, strategy: str = "mod") -> int:
    """The shard of a literal key, in [0, n). A null key is in shard 0; a fraction is rounded."""
    if value is None:
        return 0
    key = round(value)
    if strategy == "crc32mod":
        return zlib.crc32(struct.pack(">q", key)) % n
    return key % n


def shard_column(key: Column, n: int, strategy: str = "mod") -> Column:
    """The shard of a key column; agrees with ``shard_of``."""
    whole = F.round(key).cast("bigint")
    if strategy == "crc32mod":
        number = F.crc32(F.unhex(F.lpad(F.hex(whole), 16, "0")))
        return F.coalesce(F.pmod(number, F.lit(n)).cast("int"), F.lit(0))
    return F.coalesce(F.pmod(whole, F.lit(n)).cast("int"), F.lit(0))


@dataclass(frozen=True)
class Level:
    """One level of a rule: the key column, the function and the number of shards."""

    column: str
    count: int
    strategy: str = "mod"

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES or self.count < 1:
            raise ValueError(f"bad sharding level {self}")


@dataclass(frozen=True)
class ShardingRule:
    """A logical table with a database level, a table level, or both. With ``buckets``, the rows
    of each shard are also dealt by a hash of the innermost key, so that tables of the same
    number of buckets join on these keys without being shuffled."""

    table: str
    nodes: tuple[str, ...] = ("ds0",)
    database: Level | None = None
    tables: Level | None = None
    buckets: int = 0

    def __post_init__(self) -> None:
        if self.database is None and self.tables is None:
            raise ValueError("a rule asks for a database or a table level")

    @property
    def levels(self) -> dict[str, Level]:
        """The partition column of each level."""
        return {k: v for k, v in (("_db", self.database), ("_tbl", self.tables)) if v is not None}

    @property
    def inner_key(self) -> str:
        return (self.tables or self.database).column

    def physical_name(self, db: int, tbl: int | None = None) -> str:
        """``<node>.<table>_<NNNNN>``; a rule without a table level keeps the table's name."""
        name = self.table if self.tables is None else f"{self.table}_{tbl or 0:05d}"
        return f"{self.nodes[db % len(self.nodes)]}.{name}"

    def name_column(self) -> Column:
        """``physical_name`` of the shard of each row."""
        at = self.columns()
        node = F.element_at(F.array(*(F.lit(n) for n in self.nodes)), F.pmod(at.get("_db", F.lit(0)), F.lit(len(self.nodes))) + 1)
        name = F.lit(self.table) if self.tables is None else F.concat(F.lit(f"{self.table}_"), F.lpad(at["_tbl"].cast("string"), 5, "0"))
        return F.concat(node, F.lit("."), name)

    def shards(self) -> list[tuple[int, int]]:
        """All (db, tbl) pairs of the rule."""
        return [(d, t) for d in range(self.database.count if self.database else 1) for t in range(self.tables.count if self.tables else 1)]

    def columns(self) -> dict[str, Column]:
        return {name: shard_column(F.col(level.column), level.count, level.strategy) for name, level in self.levels.items()}

    def implied(self, values: dict[str, list]) -> dict[str, list[int]]:
        """Shards by partition column for key values that a condition allows (column in lower
        case to values); levels without a condition are left out."""
        return {
            name: sorted({shard_of(v, level.count, level.strategy) for v in values[level.column.lower()]})
            for name, level in self.levels.items()
            if level.column.lower() in values
        }

    def route(self, row: dict) -> tuple[int, int]:
        """The (db, tbl) of a row to insert."""
        at = {name: shard_of(row.get(level.column), level.count, level.strategy) for name, level in self.levels.items()}
        return at.get("_db", 0), at.get("_tbl", 0)


@dataclass
class Config:
    """What a TOML file says: sharding rules, node groups and guards."""

    rules: list[ShardingRule] = field(default_factory=list)
    guards: dict = field(default_factory=dict)
    nodes: list[dict] = field(default_factory=list)


def _level(part: dict | None, count: int | None = None) -> Level | None:
    return Level(part["column"], int(part.get("count", count or 1)), part.get("strategy", "mod")) if part else None


def from_mapping(data: dict) -> Config:
    """A configuration from a mapping, such as parsed TOML or JSON."""
    rules = []
    for r in data.get("sharding", []):
        nodes = tuple(r.get("nodes", ["ds0"]))
        rules.append(ShardingRule(r["table"], nodes, _level(r.get("database"), len(nodes)), _level(r.get("tables")), int(r.get("buckets", 0))))
    return Config(rules, data.get("guards", {}), data.get("node", []))


def from_toml(text: str) -> Config:
    return from_mapping(tomllib.loads(text))


def from_file(path: str) -> Config:
    """A configuration from a TOML file."""
    with open(path, encoding="utf-8") as source:
        return from_toml(source.read())


def from_url(url: str, timeout: float = 10.0) -> Config:
    """A configuration that a server gives as JSON."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return from_mapping(json.loads(answer.read()))
