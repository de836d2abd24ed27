"""Governance around statements: routing, balancing, guards and metrics."""

from __future__ import annotations

import random
import re
import threading
import time
from collections import defaultdict
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

READ, READWRITE = "read", "readwrite"
#: Where a statement's first word sends it; others go to the primary.
READ_WORDS = ("SELECT",)


class QueryRejected(RuntimeError):
    """A guard turned a statement away."""


@dataclass(frozen=True)
class Node:
    name: str
    weight: int = 1
    role: str = READWRITE


class RoundRobin:
    """Weighted round robin: in each cycle every node is chosen as often as its weight says,
    the heavier first and evenly among the others."""

    def __init__(self, nodes: list[Node]):
        if not nodes:
            raise ValueError("no nodes")
        self.nodes, self.credit, self.lock = nodes, [0] * len(nodes), threading.Lock()

    def next(self) -> Node:
        with self.lock:
            total = sum(n.weight for n in self.nodes)
            self.credit = [c + n.weight for c, n in zip(self.credit, self.nodes)]
            best = max(range(len(self.nodes)), key=lambda i: self.credit[i])
            self.credit[best] -= total
            return self.nodes[best]


class RandomWeighted:
    def __init__(self, nodes: list[Node], seed: int | None = None):
        if not nodes:
            raise ValueError("no nodes")
        self.nodes, self.random = nodes, random.Random(seed)

    def next(self) -> Node:
        return self.random.choices(self.nodes, [n.weight for n in self.nodes])[0]


@dataclass
class Rule:
    """Regular expressions and where they send a statement."""

    patterns: list[str]
    target: str

    def matches(self, sql: str) -> bool:
        return any(re.search(p, sql) for p in self.patterns)


class Router:
    """Read/write splitting: inside a transaction the primary; else the first regex rule that
    matches; else the statement's first word; else ``default``."""

    def __init__(self, nodes: list[Node], rules: list[Rule] = (), generic: bool = True, default: str = READWRITE, balance: Callable = RoundRobin):
        self.rules, self.generic, self.default = list(rules), generic, default
        reads, writes = [n for n in nodes if n.role == READ], [n for n in nodes if n.role == READWRITE]
        self.groups = {READWRITE: balance(writes), READ: balance(reads or writes)}

    def target(self, sql: str | None, in_transaction: bool = False) -> str:
        if in_transaction:
            return READWRITE
        if sql is not None:
            for rule in self.rules:
                if rule.matches(sql):
                    return rule.target
            if self.generic and sql.split():
                return READ if sql.split()[0].upper() in READ_WORDS else READWRITE
        return self.default

    def route(self, sql: str | None, in_transaction: bool = False) -> Node:
        return self.groups[self.target(sql, in_transaction)].next()

    def column(self, sql: Column) -> Column:
        """The target as a column of a statement log (regexes have to be Java's as well)."""
        out = None
        for rule in self.rules:
            test = F.lit(False)
            for p in rule.patterns:
                test = test | sql.rlike(p)
            out = F.when(test, rule.target) if out is None else out.when(test, rule.target)
        if self.generic:
            first = F.upper(F.split(F.trim(sql), r"\s+")[0])
            test = first.isin(*READ_WORDS)
            out = F.when(test, READ) if out is None else out.when(test, READ)
            return out.when(sql.isNotNull(), READWRITE).otherwise(self.default)
        return F.lit(self.default) if out is None else out.otherwise(self.default)


@dataclass
class CircuitBreak:
    """Rejects statements that match a pattern."""

    patterns: list[str]
    ignore_case: bool = False

    def __call__(self, sql: str) -> None:
        flags = re.IGNORECASE if self.ignore_case else 0
        for p in self.patterns:
            if re.search(p, sql, flags):
                raise QueryRejected(f"circuit break: {p}")

    def layer(self, service: Callable) -> Callable:
        def run(sql: str):
            self(sql)
            return service(sql)

        return run


    def column(self, sql: Column) -> Column:
        """Whether a statement of a log would be rejected (regexes have to be Java's as well)."""
        test = F.lit(False)
        for p in self.patterns:
            test = test | sql.rlike(f"(?i){p}" if self.ignore_case else p)
        return test


@dataclass
class ConcurrencyControl:
    """At most ``most`` statements that match run at a time; a slot that was not given back
    frees itself after ``duration`` seconds."""

    patterns: list[str]
    most: int
    duration: float = 60.0
    ignore_case: bool = True
    _begun: list[float] = field(default_factory=list)
    _lock: threading.Lock = field(default_factory=threading.Lock)

    def applies(self, sql: str) -> bool:
        return any(re.search(p, sql, re.IGNORECASE if self.ignore_case else 0) for p in self.patterns)

    def enter(self, sql: str) -> bool:
        """Whether a slot was taken; QueryRejected if there is none."""
        if not self.applies(sql):
            return False
        with self._lock:
            now = time.monotonic()
            self._begun = [t for t in self._begun if now - t < self.duration]
            if len(self._begun) >= self.most:
                raise QueryRejected("too many statements at a time")
            self._begun.append(now)
            return True

    def layer(self, service: Callable) -> Callable:
        """A service of statements behind this control, for ``chain`` and the engine."""

        def run(sql: str):
            with self.slot(sql):
                return service(sql)

        return run

    def leave(self) -> None:
        with self._lock:
            if self._begun:
                self._begun.pop(0)

    @contextmanager
    def slot(self, sql: str):
        taken = self.enter(sql)
        try:
            yield
        finally:
            if taken:
                self.leave()


def route_shards(shards: list[tuple[str, int]], groups: dict[str, Router], sql: str, in_transaction: bool = False) -> dict[tuple[str, int], Node]:
    """The endpoint of each (node group, shard): read/write splitting inside each group."""
    return {s: groups[s[0]].route(sql, in_transaction) for s in shards}


def chain(layers: list[Callable], service: Callable) -> Callable:
    """A service behind layers: each takes the next service and gives one."""
    for layer in reversed(layers):
        service = layer(service)
    return service


class Metrics:
    """Statements run, their durations, and those in flight, by labels."""

    BUCKETS = (0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0)

    def __init__(self) -> None:
        self.total: dict[tuple, int] = defaultdict(int)
        self.flight: dict[tuple, int] = defaultdict(int)
        self.seconds: dict[tuple, list[float]] = defaultdict(list)
        self.lock = threading.Lock()

    @contextmanager
    def timed(self, domain: str, kind: str, server: str):
        key, began = (domain, kind, server), time.perf_counter()
        with self.lock:
            self.flight[key] += 1
        try:
            yield
        finally:
            with self.lock:
                self.flight[key] -= 1
                self.total[key] += 1
                self.seconds[key].append(time.perf_counter() - began)

    def layer(self, domain: str, server: Callable[[str], str] = lambda sql: "spark") -> Callable:
        """A layer that counts and times the statements of a service by their first word."""

        def of(service: Callable) -> Callable:
            def run(sql: str):
                with self.timed(domain, (sql.split() or [""])[0].upper(), server(sql)):
                    return service(sql)

            return run

        return of

    def exposition(self) -> str:
        """Prometheus text."""
        lines = []
        for name, kind, values in (("sql_processed_total", "counter", self.total), ("sql_under_processing", "gauge", self.flight)):
            lines.append(f"# TYPE {name} {kind}")
            lines += [f'{name}{{domain="{d}",type="{t}",server="{s}"}} {v}' for (d, t, s), v in sorted(values.items())]
        lines.append("# TYPE sql_processed_duration histogram")
        for (d, t, s), times in sorted(self.seconds.items()):
            labels = f'domain="{d}",type="{t}",server="{s}"'
            lines += [f'sql_processed_duration_bucket{{{labels},le="{b}"}} {sum(x <= b for x in times)}' for b in self.BUCKETS]
            lines += [f'sql_processed_duration_bucket{{{labels},le="+Inf"}} {len(times)}', f"sql_processed_duration_sum{{{labels}}} {sum(times):.6f}", f"sql_processed_duration_count{{{labels}}} {len(times)}"]
        return "\n".join(lines) + "\n"


def endpoints(states: DataFrame, node: str, role: Column, alive: Column) -> DataFrame:
    """The endpoint set that the latest states give: (node, role) of the nodes that are alive."""
    return states.where(alive).select(node, role.alias("role"))


def latest_states(reports: DataFrame, node: str, at: str, *states: str) -> DataFrame:
    """The last reported state of each node of a monitor's log; ``states`` break ties."""
    newest = F.max(F.struct(at, *states)).alias("s")
    return reports.groupBy(node).agg(newest).select(node, F.col(f"s.{at}").alias(at), *(F.col(f"s.{c}").alias(c) for c in states))
