"""The engine: MySQL-flavoured statements over logical tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import ExitStack, contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators import dml
from shardloom.plans.dialect import Normaliser
from shardloom.plans.govern import chain
from shardloom.plans.prune import key_values, predicate
from shardloom.plans.tokens import Group, Node, SqlError, Token, pieces, scan, split, tree
from shardloom.session import forget_at_exit, shared_folder
from shardloom.sources import layout
from shardloom.sources.rules import Level, ShardingRule
from shardloom.sources.versions import FILE, ROW, Definition, State, Table

@lru_cache(maxsize=512)
def _scanned(sql: str) -> tuple[tuple[str, tuple[Token, ...]], ...]:
    """The statements of a text, as they stand in it and as tokens."""
    return tuple((p, tuple(scan(p))) for p in pieces(sql))


class Engine:
    """Runs statements. Reads are Spark queries over temp views; writes add files to a table
    below ``folder``, which executors and driver share, and replace those they change.

    ``guards`` see the text of each statement and may reject it; those that have a ``slot``
    (concurrency control) hold it while the statement runs. ``layers`` wrap the whole
    (``govern.chain``). A ``router`` says which endpoint a statement would go to, inside a
    transaction the primary; ``metrics`` count and time statements by it. A query's time is
    that of planning, since its rows are computed when they are asked for.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, guards: list | None = None, layers: list[Callable] | None = None, router=None, metrics=None, domain: str = "default"):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/tables"
        self.guards, self.layers = guards or [], layers or []
        self.router, self.metrics, self.domain = router, metrics, domain
        self.prefix = f"t{uuid.uuid4().hex[:8]}"
        self.tables: dict[str, Table] = {}
        self.variables: dict[str, object] = {"version": "8.0.0-shardloom", "autocommit": 1}
        self.prepared: dict[str, str] = {}
        self.found_rows: int | None = None
        self.row_count = -1
        self.server: str | None = None
        self.began: dict[str, tuple[Table, State]] | None = None
        self.savepoints: dict[str, dict[str, tuple[Table, State]]] = {}

    # -- tables

    def add(self, name: str, df: DataFrame, rule: ShardingRule | None = None, stored: bool = True, definition: Definition = Definition(), key: list[str] | None = None) -> None:
        """Register ``df`` under a name, with its ``key`` if it has one. With a rule, rows are
        dealt to a folder for each shard, so that pruned shards are not read; without
        ``stored`` the shard columns are only computed."""
        if rule is not None and not set(rule.levels) <= set(df.columns):
            df = layout.stored(df, rule, self.folder) if stored else layout.with_shards(df, rule)
        if key:
            definition = Definition(tuple(key))
        table = Table(self.spark, name, df, rule, self.folder, definition)
        self.tables[name.lower()] = table
        self._show_rows(table)

    def table(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise SqlError(f"there is no table {name}")
        return self.tables[name.lower()]

    def _show_rows(self, table: Table, identity: bool = False) -> None:
        df = table.rows(identity)
        names = [*table.columns, *((FILE, ROW) if identity else ())]
        if table.rule is not None:
            df.createOrReplaceTempView(f"{self.prefix}_{table.name.lower()}")
        df.select(*(F.col(f"`{c}`") for c in names)).createOrReplaceTempView(table.name)

    @contextmanager
    def identified(self, table: Table):
        """Inside, the table's view has the identity of its rows as well."""
        columns = table.columns
        self._show_rows(table, True)
        table.columns = [*columns, FILE, ROW]
        try:
            yield
        finally:
            table.columns = columns
            self._show_rows(table)

    def source(self, table: Table, alias: str, where: list[Node]) -> str:
        """A table in a FROM clause, pruned by its conditions."""
        return self._from_table(table.name, alias, where, None, 1)

    def kept(self, df: DataFrame) -> DataFrame:
        """``df`` as written, so that all that follows sees the same rows."""
        path = f"{self.folder}/kept-{uuid.uuid4().hex}"
        df.write.parquet(path)
        forget_at_exit(self.spark, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def use(self, folder: str, *names: str) -> Engine:
        """Register unsharded tables of a folder of Parquet tables."""
        for name in names:
            self.add(name, self.spark.read.parquet(f"{folder}/{name}.parquet"))
        return self

    def function(self, name: str, call: Callable, returns: str) -> None:
        """Make a Python function known to SQL; built-in functions are the faster way."""
        self.spark.udf.register(name, call, returns)

    # -- reads

    def _from_table(self, name: str, alias: str | None, where: list[Node], parts: list[str] | None, n_tables: int) -> str:
        table = self.tables.get(name.lower())
        shown = f"`{name}`" + (f" AS `{alias}`" if alias else "")
        if table is None or table.rule is None:
            return shown
        shards = table.rule.implied(key_values(where, (alias or name).lower(), n_tables == 1))
        if parts is not None:
            shards["_tbl"] = sorted(set(shards.get("_tbl", range(1 << 16))) & {int("".join(c for c in p if c.isdigit())[-5:] or 0) for p in parts})
        if not shards:
            return shown
        columns = ", ".join(f"`{c}`" for c in table.columns)
        return f"(SELECT {columns} FROM {self.prefix}_{table.name.lower()} WHERE {predicate(shards)}) AS `{alias or name}`"

    def normalise(self, sql: str) -> str:
        """The Spark SQL text of one statement."""
        [(_, tokens)] = _scanned(sql)
        return self._text(tree(list(tokens)))

    def _text(self, nodes: list[Node]) -> str:
        return Normaliser(self.variables, self._from_table).text(self._known(nodes))

    def _known(self, nodes: list[Node]) -> list[Node]:
        """Calls that ask for the session's own values become these."""
        values = {"ROW_COUNT": self.row_count, "FOUND_ROWS": self.found_rows or 0, "LAST_INSERT_ID": self.variables.get("last_insert_id", 0), "CONNECTION_ID": 1}
        out: list[Node] = []
        skip = False
        for i, n in enumerate(nodes):
            follow = nodes[i + 1] if i + 1 < len(nodes) else None
            if skip:
                skip = False
            elif n.upper in values and isinstance(follow, Group) and not follow.nodes:
                out.append(Token("raw", f"CAST({values[n.upper]} AS BIGINT)"))
                skip = True
            else:
                out.append(Group(self._known(n.nodes)) if isinstance(n, Group) else n)
        return out

    def query(self, sql: str, args: list | None = None) -> DataFrame:
        """One statement that returns rows. Parameters are bound before pruning."""
        [(text, tokens)] = _scanned(sql)
        return self._through(text, list(tokens), args or [])

    @staticmethod
    def _bind(tokens: list[Token], args: list) -> list[Token]:
        wanted = sum(t.kind == "param" for t in tokens)
        if wanted != len(args):
            raise SqlError(f"{wanted} parameters are asked for, {len(args)} are given")
        values = iter(args)
        out: list[Token] = []
        for t in tokens:
            if t.kind != "param":
                out.append(t)
                continue
            v = next(values)
            if v is None:
                out.append(Token("word", "NULL"))
            elif isinstance(v, bool):
                out.append(Token("word", str(v).upper()))
            elif isinstance(v, int | float):
                out += [Token("op", "-")] * (v < 0) + [Token("number", repr(abs(v)))]
            else:
                out.append(Token("text", str(v)))
        return out

    def execute(self, sql: str, args: list | None = None) -> DataFrame | None:
        """Run statements in order; gives the rows of the last one that has any."""
        out = None
        for text, tokens in _scanned(sql):
            got = self._through(text, list(tokens), args or [])
            out = got if got is not None else out
        return out

    def _through(self, text: str, tokens: list[Token], args: list) -> DataFrame | None:
        """A statement through layers, guards, the router and metrics."""

        def service(text: str) -> DataFrame | None:
            with ExitStack() as held:
                for guard in self.guards:
                    if hasattr(guard, "slot"):
                        held.enter_context(guard.slot(text))
                    else:
                        guard(text)
                if self.router is not None:
                    self.server = self.router.route(text, self.in_transaction).name
                if self.metrics is not None:
                    held.enter_context(self.metrics.timed(self.domain, (text.split() or [""])[0].upper(), self.server or "spark"))
                return self._run(self._bind(tokens, args))

        return chain(self.layers, service)(text)

    # -- transactions

    @property
    def in_transaction(self) -> bool:
        return self.began is not None

    def _snapshot(self) -> dict[str, tuple[Table, State]]:
        return {n: (t, t.state) for n, t in self.tables.items()}

    def _restore(self, saved: dict[str, tuple[Table, State]]) -> None:
        for name in set(self.tables) - set(saved):
            self.spark.catalog.dropTempView(self.tables[name].name)
        self.tables = {n: t for n, (t, _) in saved.items()}
        for table, state in saved.values():
            table.state = state
            self._show_rows(table)

    def _transaction(self, words: list[str], nodes: list[Node]) -> None:
        """BEGIN, COMMIT, ROLLBACK, SAVEPOINT. Files never change, so a snapshot of the tables'
        states is all that a transaction keeps. One session at a time may write a table."""
        if words[0] in ("BEGIN", "START"):
            self.began, self.savepoints = self._snapshot(), {}
        elif words[0] == "SAVEPOINT":
            self.savepoints[nodes[1].text.lower()] = self._snapshot()
        elif words[0] == "RELEASE":
            if self.savepoints.pop(nodes[-1].text.lower(), None) is None:
                raise SqlError(f"there is no savepoint {nodes[-1].text}")
        elif words[0] == "ROLLBACK" and "TO" in words:
            if nodes[-1].text.lower() not in self.savepoints:
                raise SqlError(f"there is no savepoint {nodes[-1].text}")
            self._restore(self.savepoints[nodes[-1].text.lower()])
        else:
            if words[0] == "ROLLBACK" and self.began is not None:
                self._restore(self.began)
            again = "CHAIN" in words and "NO" not in words or str(self.variables.get("autocommit")) in ("0", "OFF", "False")
            self.began, self.savepoints = (self._snapshot() if again else None), {}

    def _run(self, tokens: list[Token]) -> DataFrame | None:
        nodes = tree(tokens)
        first, second = nodes[0].upper, nodes[1].upper if len(nodes) > 1 else ""
        if first == "SELECT" or first in ("WITH", "VALUES", "TABLE") or isinstance(nodes[0], Group):
            if first == "WITH" and (at := next((i for i, n in enumerate(nodes) if n.upper in ("UPDATE", "DELETE")), -1)) > 0:
                return self._write(nodes[at:], self._text(nodes[:at]))
            return self._select(nodes)
        if first in ("INSERT", "UPDATE", "DELETE"):
            return self._write(nodes, "")
        if first == "PREPARE":
            source = nodes[3]
            self.prepared[nodes[1].text.lower()] = source.text if source.kind == "text" else str(self.variables[source.text.lstrip("@").lower()])
            return None
        if first == "EXECUTE":
            names = [n.text for n in nodes[3:] if n.kind == "var"]
            return self.query(self.prepared[nodes[1].text.lower()], [self.variables.get(v.lstrip("@").lower()) for v in names])
        if first in ("DEALLOCATE", "DROP") and second == "PREPARE":
            self.prepared.pop(nodes[2].text.lower(), None)
            return None
        if first == "SET":
            return self._set(nodes[1:])
        if first in ("BEGIN", "COMMIT", "ROLLBACK", "START", "SAVEPOINT", "RELEASE"):
            return self._transaction([n.upper for n in nodes], nodes)
        if first == "CREATE":
            self.began = None  # definitions commit
            return self._create(nodes)
        if first == "DROP" and second in ("TABLE", "VIEW"):
            self.began = None
            return self._drop(nodes)
        if first == "SHOW":
            return self._show(nodes)
        raise SqlError(f"{first or nodes[0]} is no statement of this engine")

    def _select(self, nodes: list[Node]) -> DataFrame | None:
        stop = next((i for i, n in enumerate(nodes) if n.upper == "FROM"), len(nodes))
        if any(n.kind == "op" and n.text == ":=" for n in nodes[:stop]):
            return self._assigned(nodes, stop)
        at = next((i for i, n in enumerate(nodes) if n.upper == "INTO"), -1)
        if any(n.upper == "SQL_CALC_FOUND_ROWS" for n in nodes):
            stop = next((i for i, n in enumerate(nodes) if n.upper == "LIMIT"), len(nodes))
            self.found_rows = self.spark.sql(self._text(nodes[:stop])).count()
        if at < 0:
            return self.spark.sql(self._text(nodes))
        stop = next((i for i in range(at + 1, len(nodes)) if nodes[i].upper in ("FROM", "FOR", "LOCK", "WHERE", "ORDER", "LIMIT")), len(nodes))
        into = nodes[at + 1 : stop]
        df = self.spark.sql(self._text(nodes[:at] + nodes[stop:]))
        if into[0].upper == "OUTFILE":
            options = {}
            for i, n in enumerate(into):
                name = {"TERMINATED": "separator", "ENCLOSED": "quote", "ESCAPED": "escape"}.get(n.upper)
                if name:
                    lines = any(x.upper == "LINES" for x in into[:i])
                    options["line" if lines else name] = into[i + 2].text
            layout.into_outfile(df, into[1].text, **options)
        elif into[0].upper == "DUMPFILE":
            layout.into_dumpfile(df, into[1].text)
        else:
            rows = df.limit(2).collect()
            if len(rows) > 1:
                raise SqlError("INTO a variable asks for one row at most")
            for name, value in zip([n.text for n in into if n.kind == "var"], rows[0] if rows else []):
                self.variables[name.lstrip("@").lower()] = value
        return None

    def _assigned(self, nodes: list[Node], stop: int) -> DataFrame:
        """SELECT @a := e, ..: the rows, and in each variable its value in the last of them."""
        names: dict[int, str] = {}
        items: list[Node] = []
        for i, item in enumerate(split(nodes[1:stop])):
            if len(item) > 2 and item[0].kind == "var" and item[1].text == ":=":
                names[i], item = item[0].text, item[2:]
                if not any(n.upper == "AS" for n in item):
                    item = [*item, Token("word", "AS"), Token("name", names[i])]
            items += [Token("op", ","), *item] if i else item
        df = self.kept(self.spark.sql(self._text([nodes[0], *items, *nodes[stop:]])))
        for row in df.tail(1):
            for i, name in names.items():
                self.variables[name.lstrip("@").lower()] = row[i]
        return df

    # -- writes

    def _write(self, nodes: list[Node], with_: str) -> DataFrame:
        maker = {"INSERT": dml.insert, "UPDATE": dml.update, "DELETE": dml.delete}[nodes[0].upper]
        if self.began is None and str(self.variables.get("autocommit")) in ("0", "OFF", "False"):
            self.began = self._snapshot()
        before = self._snapshot()
        try:
            self.row_count = maker(self, nodes[1:], with_)
        except BaseException:
            self._restore(before)  # a statement counts as a whole or not at all
            raise
        for table, state in before.values():
            if table.state is not state:
                self._show_rows(table)
        return self.spark.createDataFrame([(self.row_count,)], "affected_rows long")

    def vacuum(self) -> int:
        """Delete files below the tables' own folders that no table's state or open transaction
        has. Gives their number. Queries that were planned before may still need them."""
        held = {f for saved in (self._snapshot(), self.began or {}, *self.savepoints.values()) for _, state in saved.values() for f in state.own}
        n = 0
        for table, _ in self._snapshot().values():
            home = self.spark._jvm.org.apache.hadoop.fs.Path(table.home)
            fs = home.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if not fs.exists(home):
                continue
            files = fs.listFiles(home, True)
            while files.hasNext():
                place = files.next().getPath()
                if place.getName().endswith(".parquet") and not any(f.endswith(place.toUri().getRawPath()) for f in held):
                    fs.delete(place, False)
                    n += 1
        return n

    # -- session and definitions

    def _set(self, nodes: list[Node]) -> None:
        if nodes and nodes[0].upper in ("NAMES", "CHARACTER", "CHARSET", "TRANSACTION"):
            self.variables[nodes[0].text.lower()] = " ".join(n.text for n in nodes[1:])
            return None
        for part in split(nodes):
            part = [n for n in part if n.upper not in ("GLOBAL", "SESSION", "LOCAL")]
            value = part[2:]
            if len(value) == 1 and value[0].kind in ("word", "text") and value[0].upper not in ("NULL", "TRUE", "FALSE"):
                found: object = value[0].text
            else:
                found = self.spark.sql(f"SELECT {self._text(value)} AS v").first().v
            self.variables[part[0].text.lstrip("@").lower()] = found
        return None

    def _create(self, nodes: list[Node]) -> None:
        kind = next((n.upper for n in nodes[1:] if n.upper in ("TABLE", "VIEW", "DATABASE", "SCHEMA", "INDEX")), "")
        if kind == "INDEX":
            return None  # Parquet has statistics and no indexes
        if kind in ("DATABASE", "SCHEMA"):
            self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{nodes[-1].text}`")
            return None
        at = next((i for i, n in enumerate(nodes) if n.upper == "AS" or n.upper == "SELECT"), -1)
        begin = next(i for i, n in enumerate(nodes) if n.upper == kind) + 1
        while nodes[begin].upper in ("IF", "NOT", "EXISTS"):
            begin += 1
        name = nodes[begin].text
        if kind == "VIEW":
            self.spark.sql(self._text(nodes[at + (nodes[at].upper == "AS") :])).createOrReplaceTempView(name)
            return None
        like = next((i for i, n in enumerate(nodes) if n.upper == "LIKE"), -1)
        if like > 0:
            source = self.table(nodes[like + 1].text)
            self.add(name, source.rows().limit(0), source.rule, definition=source.definition)
        elif at > 0 and not any(isinstance(n, Group) for n in nodes[:at]):
            self.add(name, self.kept(self.spark.sql(self._text(nodes[at + (nodes[at].upper == "AS") :]))))
        else:
            at = next(i for i, n in enumerate(nodes) if isinstance(n, Group))
            columns, definition = self._definition(nodes[at].nodes)
            self.add(name, self.spark.createDataFrame([], columns), self._partitions(name, nodes[at + 1 :]), stored=False, definition=definition)
        return None

    def _definition(self, body: list[Node]) -> tuple[str, Definition]:
        """Columns of CREATE TABLE as a schema, and what else is said of them."""
        own, columns = Normaliser(), []
        primary: list[str] = []
        unique: list[str] = []
        defaults, required, generated, increments = [], [], [], None
        for c in split(body):
            words = [n.upper for n in c]
            groups = [n for n in c if isinstance(n, Group)]
            if words[0] in ("PRIMARY", "KEY", "INDEX", "UNIQUE", "CONSTRAINT", "FOREIGN", "FULLTEXT", "SPATIAL", "CHECK"):
                if groups and ("PRIMARY" in words or "UNIQUE" in words):
                    names = [x[0].text for x in split(groups[0].nodes)]
                    primary, unique = (names, unique) if "PRIMARY" in words else (primary, unique or names)
                continue
            column = c[0].text
            kind = "DECIMAL(20,0)" if "UNSIGNED" in words and words[1] == "BIGINT" else _column_type(own, c[1:])
            columns.append(f"`{column}` {kind}")
            if "PRIMARY" in words:
                primary = [column]
            elif "UNIQUE" in words:
                unique = unique or [column]
            if "NOT" in words and words[words.index("NOT") + 1 : words.index("NOT") + 2] == ["NULL"]:
                required.append(column)
            if "DEFAULT" in words:
                begin = words.index("DEFAULT") + 1
                end = next((i for i in range(begin + 1, len(c)) if words[i] in ("NOT", "NULL", "COMMENT", "PRIMARY", "UNIQUE", "KEY", "ON", "AUTO_INCREMENT", "COLLATE", "CHECK")), len(c))
                defaults.append((column, self._text(c[begin:end])))
            if "AS" in words:
                generated.append((column, self._text(c[words.index("AS") + 1].nodes)))
            if "AUTO_INCREMENT" in words or words[1] == "SERIAL":
                increments = column
        required = [c for c in dict.fromkeys([*primary, *required]) if c != increments]
        key = tuple(primary or unique)
        return ", ".join(columns), Definition(key, tuple(defaults), tuple(required), tuple(generated), increments)

    @staticmethod
    def _partitions(name: str, rest: list[Node]) -> ShardingRule | None:
        """PARTITION BY HASH or KEY of one column deals rows to folders; other kinds of
        partitions leave the layout as it is."""
        words = [n.upper for n in rest]
        if "PARTITION" not in words or "PARTITIONS" not in words or not ("HASH" in words or "KEY" in words):
            return None
        of = rest[words.index("HASH" if "HASH" in words else "KEY") + 1]
        count = int(rest[words.index("PARTITIONS") + 1].text)
        if isinstance(of, Group) and len(of.nodes) == 1 and of.nodes[0].kind in ("word", "name"):
            return ShardingRule(name, tables=Level(of.nodes[0].text, count))
        return None

    def _drop(self, nodes: list[Node]) -> None:
        rest = [n for n in nodes[2:] if n.upper not in ("IF", "EXISTS", "RESTRICT", "CASCADE")]
        quiet = any(n.upper == "EXISTS" for n in nodes)
        for part in split(rest):
            name = part[0].text
            if self.tables.pop(name.lower(), None) is None and nodes[1].upper == "TABLE" and not quiet:
                raise SqlError(f"there is no table {name}")
            self.spark.catalog.dropTempView(name)

    def _show(self, nodes: list[Node]) -> DataFrame:
        words = [n.upper for n in nodes]
        if "PROCESSLIST" in words:
            tracker = self.spark.sparkContext.statusTracker()
            rows = [(i, "job", f"{len(tracker.getJobInfo(i).stageIds)} stages") for i in tracker.getActiveJobsIds() if tracker.getJobInfo(i)]
            return self.spark.createDataFrame(rows, "id int, command string, info string")
        if "GRANTS" in words:
            user = self.spark.sql("SELECT current_user() AS u").first().u
            return self.spark.createDataFrame([(f"GRANT ALL PRIVILEGES ON *.* TO '{user}'",)], "grants string")
        if "ENGINES" in words:
            return self.spark.createDataFrame([("parquet", "DEFAULT", "files that never change", "YES", "NO")], "engine string, support string, comment string, transactions string, xa string")
        if "PRIVILEGES" in words:
            rows = [(p, "Tables") for p in ("Select", "Insert", "Update", "Delete", "Create", "Drop")]
            return self.spark.createDataFrame(rows, "privilege string, context string")
        if "PLUGINS" in words or "EVENTS" in words or "TRIGGERS" in words or "FUNCTION" in words or "PROCEDURE" in words:
            if "FUNCTION" in words:
                return self.spark.sql("SHOW USER FUNCTIONS").selectExpr("function AS name")
            return self.spark.createDataFrame([], "name string")
        if "TABLES" in words:
            rows = [(t.name,) for _, t in sorted(self.tables.items())]
            return self.spark.createDataFrame(rows, "name string")
        if "DATABASES" in words or "SCHEMAS" in words:
            return self.spark.sql("SHOW DATABASES").selectExpr("namespace AS name")
        if "COLUMNS" in words or "FIELDS" in words:
            table = self.table(nodes[next(i for i, w in enumerate(words) if w in ("FROM", "IN")) + 1].text)
            return self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in table.schema], "field string, type string")
        if "VARIABLES" in words:
            return self.spark.createDataFrame([(k, str(v)) for k, v in sorted(self.variables.items())], "variable_name string, value string")
        if "STATUS" in words:
            rows = [(t.name, "parquet", ",".join(t.rule.levels) if t.rule else None) for _, t in sorted(self.tables.items())]
            return self.spark.createDataFrame(rows, "name string, engine string, sharded_by string")
        if "INDEX" in words or "INDEXES" in words or "KEYS" in words:
            table = self.table(nodes[next(i for i, w in enumerate(words) if w in ("FROM", "IN")) + 1].text)
            rows = [(table.name, "PRIMARY", i + 1, c) for i, c in enumerate(table.definition.key)]
            return self.spark.createDataFrame(rows, "table string, key_name string, seq int, column string")
        if "CHARSET" in words or "COLLATION" in words:
            return self.spark.createDataFrame([("utf8mb4", "utf8mb4_bin")], "charset string, collation string")
        if "WARNINGS" in words or "ERRORS" in words:
            return self.spark.createDataFrame([], "level string, code int, message string")
        if "CREATE" in words:
            table = self.table(nodes[-1].text)
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema)
            return self.spark.createDataFrame([(table.name, f"CREATE TABLE `{table.name}` ({ddl})")], "name string, ddl string")
        raise SqlError(f"SHOW {' '.join(words[1:])} is not supported")


def _column_type(own: Normaliser, nodes: list[Node]) -> str:
    name = nodes[0].upper
    if name in ("ENUM", "SET", "TIME") or name.endswith("TEXT"):
        return "STRING"
    if name.endswith("BLOB") or name == "VARBINARY":
        return "BINARY"
    if name in ("MEDIUMINT", "BIT", "SERIAL", "BOOL", "NVARCHAR"):
        return {"MEDIUMINT": "INT", "BIT": "BIGINT", "SERIAL": "BIGINT", "BOOL": "BOOLEAN", "NVARCHAR": "STRING"}[name]
    return own._type(nodes)


