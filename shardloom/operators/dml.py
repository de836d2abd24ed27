"""INSERT, UPDATE and DELETE (copy on write, file by file).

INSERT adds files. UPDATE and DELETE first fix the identities of the rows they mean, then
write only the files that hold such rows anew. Each gives the number of rows affected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.plans.tokens import Group, Node, SqlError, Token, render, split
from shardloom.sources.versions import FILE, ROW, touched


def _find(nodes: list[Node], *words: str) -> int:
    return next((i for i, n in enumerate(nodes) if n.upper in words), -1)


def _skip(nodes: list[Node], *words: str) -> list[Node]:
    while nodes and nodes[0].upper in words:
        nodes = nodes[1:]
    return nodes


def _assignments(nodes: list[Node]) -> dict[str, list[Node]]:
    out = {}
    for part in split(nodes):
        at = next(i for i, n in enumerate(part) if n.kind == "op" and n.text in ("=", ":="))
        out[part[at - 1].text.lower()] = part[at + 1 :]
    return out


def _fresh(engine, table, nodes: list[Node]) -> tuple[DataFrame, list[str]]:
    """Rows to insert, in the order in which they are given (``_ord``), and their columns."""
    columns = [c for c in table.columns if c.lower() not in {g.lower() for g, _ in table.definition.generated}]
    if nodes and isinstance(nodes[0], Group) and not any(n.upper == "SELECT" for n in nodes[0].nodes):
        columns, nodes = [c[0].text for c in split(nodes[0].nodes)], nodes[1:]
    defaults = {c.lower(): e for c, e in table.definition.defaults}
    value = lambda c, v: defaults.get(c.lower(), "NULL") if len(v) in (1, 2) and v[0].upper == "DEFAULT" and all(isinstance(x, Group) for x in v[1:]) else engine._text(v)
    if nodes[0].upper in ("VALUES", "VALUE"):
        texts = []
        for i, r in enumerate(n for n in nodes[1:] if isinstance(n, Group)):
            values = split(r.nodes)
            if len(values) != len(columns):
                raise SqlError(f"{len(columns)} columns, {len(values)} values")
            texts.append("(" + ", ".join([*(value(c, v) for c, v in zip(columns, values)), f"{i}L"]) + ")")
        names = ", ".join([*(f"`{c}`" for c in columns), "_ord"])
        return engine.spark.sql(f"SELECT * FROM VALUES {', '.join(texts)} AS _v({names})"), columns
    if nodes[0].upper == "SET":
        given = _assignments(nodes[1:])
        return engine.spark.sql("SELECT " + ", ".join([*(f"{value(c, v)} AS `{c}`" for c, v in given.items()), "0L AS _ord"])), list(given)
    return engine.spark.sql(engine._text(nodes)).toDF(*columns).withColumn("_ord", F.monotonically_increasing_id()), columns


def insert(engine, nodes: list[Node], with_: str) -> int:
    """INSERT [IGNORE] [INTO] t [(cols)] {VALUES .. | SET .. | SELECT ..} [AS new]
    [ON DUPLICATE KEY UPDATE ..]. Without these clauses files are added and none is read."""
    ignore = any(n.upper == "IGNORE" for n in nodes[:3])
    nodes = _skip(nodes, "LOW_PRIORITY", "DELAYED", "HIGH_PRIORITY", "IGNORE", "INTO")
    table, nodes = engine.table(nodes[0].text), nodes[1:]
    at = _find(nodes, "ON")
    update = None
    if at >= 0 and nodes[at + 1].upper == "DUPLICATE":
        update, nodes = _assignments(nodes[at + 4 :]), nodes[:at]
    alias = "new"
    if (at := _find(nodes, "AS")) >= 0 and _find(nodes, "SELECT") < 0:
        alias, nodes = nodes[at + 1].text, nodes[:at]
    fresh, _ = _fresh(engine, table, nodes)
    kinds = {f.name.lower(): f.dataType for f in table.schema}
    have = {c.lower(): c for c in fresh.columns}
    defaults = {c.lower(): e for c, e in table.definition.defaults}

    def column(c: str):
        if c.lower() in have:
            return F.col(f"`{have[c.lower()]}`").cast(kinds[c.lower()]).alias(c)
        return F.expr(defaults.get(c.lower(), "NULL")).cast(kinds[c.lower()]).alias(c)

    fresh = _generated(table, fresh.select(*(column(c) for c in table.columns), "_ord"))
    plain = update is None and not ignore
    if not plain or table.definition.increments or table.definition.required:
        fresh = engine.kept(fresh)  # looked at more than once
    if table.definition.increments:
        fresh = _numbered(table, fresh, table.definition.increments)
    _required(table, fresh)
    if plain:
        return table.append(fresh)
    merge(table, fresh, {} if update is None else {c: _update_text(engine, v, table.columns, alias) for c, v in update.items()})
    return fresh.count()


def _numbered(table, fresh: DataFrame, counter: str) -> DataFrame:
    """``fresh`` with consecutive numbers where ``counter`` is null, from the largest there is:
    each part of the rows goes on where the part before it ends (``_ord`` has the part in its
    upper bits), so no task sees all rows."""
    most = table.rows().agg(F.max(counter)).first()[0] or 0
    part, inside = F.shiftright("_ord", 33), F.col("_ord").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r.p, r.n) for r in fresh.groupBy(part.alias("p")).agg((F.max(inside) + 1).alias("n")).collect())  # one for each part
    before, ends = 0, []
    for p, n in sizes:
        ends.append((p, before))
        before += n
    begins = table.spark.createDataFrame(ends, "_p long, _begin long")
    number = F.col("_begin") + inside + F.lit(most + 1)
    kind = fresh.schema[counter].dataType
    numbered = fresh.join(F.broadcast(begins), part == F.col("_p"))
    return numbered.withColumn(counter, F.coalesce(F.col(counter), number.cast(kind))).drop("_p", "_begin")


def _generated(table, rows: DataFrame) -> DataFrame:
    kinds = {f.name: f.dataType for f in table.schema}
    for c, e in table.definition.generated:
        rows = rows.withColumn(c, F.expr(e).cast(kinds[c]))
    return rows


def _required(table, rows: DataFrame) -> None:
    """NOT NULL columns, and those of the key, take no null."""
    names = table.definition.required
    if names:
        found = rows.agg(*(F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(names))).first()
        if bad := [c for c, n in zip(names, found) if n]:
            raise SqlError(f"column {bad[0]} takes no null")


def _folded(fresh: DataFrame, key: list[str], columns: list[str], update: dict[str, str]) -> DataFrame:
    """One row for each key of ``fresh`` (``_ord`` orders its rows): ``_first`` is what is
    inserted where the key is new, ``_rows`` what then meets the row that is there."""
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    one = F.struct("_ord", row.alias("r"))
    if not update:  # IGNORE: the first row counts
        return fresh.groupBy(*key).agg(F.min_by(row, "_ord").alias("_first"), F.array().alias("_rows"))
    if not any("_old." in e for e in update.values()):  # the last row's values stand at the end
        last = F.max_by(row, "_ord")
        more = F.when(F.count(F.lit(1)) > 1, F.array(last))
        return fresh.groupBy(*key).agg(F.min_by(row, "_ord").alias("_first"), more.alias("_more"), F.array(last).alias("_rows"))
    rows = F.transform(F.sort_array(F.collect_list(one)), lambda x: x["r"])
    return fresh.groupBy(*key).agg(F.min_by(row, "_ord").alias("_first"), rows.alias("_rows"))


def _applied(start: str, rows: str, columns: list[str], kinds: dict, update: dict[str, str]):
    """The row ``start`` after ``rows`` have met it one after the other."""
    values = ", ".join(f"'{c}', CAST({update[c.lower()] if c.lower() in update else f'_old.`{c}`'} AS {kinds[c].simpleString()})" for c in columns)
    return F.expr(f"aggregate({rows}, {start}, (_old, _new) -> named_struct({values}))")


def _merged(current: DataFrame, fresh: DataFrame, key: list[str], columns: list[str], update: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``current`` (whatever other columns it has) as they are after ``fresh`` has met
    them, and the rows of new keys. Keys that hold a null are always new."""
    kinds = {c: current.schema[c].dataType for c in columns}
    whole = F.lit(True)
    for c in key:
        whole = whole & F.col(f"`{c}`").isNotNull()
    folded = _folded(fresh.where(whole), key, columns, update)
    names = {c: f"_key{i}" for i, c in enumerate(key)}
    met = folded.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), *(c for c in folded.columns if c.startswith("_") and c not in names.values() and c not in key))
    same = F.lit(True)
    for c, n in names.items():
        same = same & (current[f"`{c}`"] == met[n])
    both = current.join(met, same, "left")
    old = "named_struct(" + ", ".join(f"'{c}', `{c}`" for c in columns) + ")"
    changed = both.withColumn("_now", F.when(F.col("_first").isNotNull() if update else F.lit(False), _applied(old, "_rows", columns, kinds, update)) if update else F.lit(None).cast(current.select(*(F.col(f"`{c}`") for c in columns)).schema))
    now = [F.when(F.col("_now").isNotNull(), F.col(f"_now.`{c}`")).otherwise(F.col(f"`{c}`")).alias(c) for c in columns]
    new = met.join(current.select(*(F.col(f"`{c}`") for c in key)), same, "left_anti")
    if update:
        rest = "coalesce(_more, array())" if "_more" in met.columns else "slice(_rows, 2, greatest(size(_rows) - 1, 0))"
        start = "named_struct(" + ", ".join(f"'{c}', CAST(_first.`{c}` AS {kinds[c].simpleString()})" for c in columns) + ")"
        new = new.select(_applied(start, rest, columns, kinds, update).alias("_first"))
    new = new.select(*(F.col(f"_first.`{c}`").alias(c) for c in columns))
    return changed.select(*now), new.unionByName(fresh.where(~whole).select(*(F.col(f"`{c}`") for c in columns)))


def merge(table, fresh: DataFrame, update: dict[str, str]) -> None:
    """INSERT IGNORE, or with ``update`` ON DUPLICATE KEY: only files with rows of a key of
    ``fresh`` are written anew, and not even those for IGNORE."""
    key, current = list(table.key), table.rows(identity=True)
    keys = fresh.select(*(F.col(f"`{c}`").alias(f"_key{i}") for i, c in enumerate(key))).distinct()
    same = F.lit(True)
    for i, c in enumerate(key):
        same = same & (current[f"`{c}`"] == keys[f"_key{i}"])
    files = touched(current.join(keys, same, "left_semi"))
    rows = table.of_files(files) if files else table.rows(identity=True).limit(0)
    changed, new = _merged(rows.select(*(F.col(f"`{c}`") for c in table.columns)), fresh, key, table.columns, update)
    added = table.write(_generated(table, new))
    table.swap(files if update else set(), _generated(table, changed), added)


def _update_text(engine, nodes: list[Node], columns: list[str], alias: str) -> str:
    """An ON DUPLICATE KEY expression: VALUES(c) and new.c are the row that came, c alone is
    the row that is there."""
    known = {c.lower() for c in columns}

    def owned(nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(nodes):
            n, follow = nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None
            if n.upper == "VALUES" and isinstance(follow, Group):
                out.append(Token("raw", f"_new.`{follow.nodes[0].text}`"))
                i += 2
            elif isinstance(n, Group):
                out.append(Group(owned(n.nodes)))
                i += 1
            elif n.kind in ("word", "name") and n.text.lower() == alias.lower() and isinstance(follow, Token) and follow.text == ".":
                out.append(Token("raw", f"_new.`{nodes[i + 2].text}`"))
                i += 3
            elif n.kind in ("word", "name") and n.text.lower() in known and not isinstance(follow, Group):
                out.append(Token("raw", f"_old.`{n.text}`"))
                i += 1
            else:
                out.append(n)
                i += 1
        return out

    return engine._text(owned(nodes))


def upsert(current: DataFrame, fresh: DataFrame, key: str | list[str], update: dict[str, str]) -> DataFrame:
    """Rows of ``fresh`` whose key is new are added; for others, the columns of ``update``
    (SQL over _old and _new) change. Rows of one key of ``fresh`` count one after the other,
    in the order of a column ``_ord`` if it has one; else of their values."""
    key = [key] if isinstance(key, str) else list(key)
    if "_ord" not in fresh.columns:
        fresh = fresh.withColumn("_ord", F.struct(*(F.col(f"`{c}`") for c in current.columns)))
    changed, new = _merged(current, fresh, key, current.columns, update)
    return changed.unionByName(new)


def _tail(nodes: list[Node]) -> tuple[list[Node], list[Node], list[Node], list[Node]]:
    """The parts before WHERE, of WHERE, of ORDER BY, and of LIMIT."""
    cuts = {w: _find(nodes, w) for w in ("WHERE", "ORDER", "LIMIT")}
    at = [cuts[w] if cuts[w] >= 0 else None for w in cuts]
    end = len(nodes)
    limit = nodes[at[2] + 1 :] if at[2] is not None else []
    end = at[2] if at[2] is not None else end
    order = nodes[at[1] + 2 : end] if at[1] is not None else []
    end = at[1] if at[1] is not None else end
    where = nodes[at[0] + 1 : end] if at[0] is not None else []
    end = at[0] if at[0] is not None else end
    return nodes[:end], where, order, limit


def _condition(engine, where: list[Node]) -> str:
    return f"coalesce(({engine._text(where)}), false)" if where else "true"


def _hits(engine, table, where: list[Node], order: list[Node], limit: list[Node], alias: str, with_: str = "") -> DataFrame:
    """Identities of the rows that are meant, fixed before anything is written. Conditions on
    shard keys and pushed filters keep the scan to the files that may hold such rows."""
    with engine.identified(table):
        rows = engine.spark.sql(f"{with_} SELECT `{alias}`.* FROM {engine.source(table, alias, where)} WHERE {_condition(engine, where)}")
        if limit:
            keys = [F.expr(engine._text([x for x in o if x.upper not in ("ASC", "DESC")])).desc() if any(x.upper == "DESC" for x in o) else F.expr(engine._text([x for x in o if x.upper != "ASC"])).asc() for o in split(order)]
            rows = rows.alias(alias).orderBy(*keys, FILE, ROW).limit(int(render(limit)))  # a top-k, not a sort of the table
        return engine.kept(rows.select(FILE, ROW))


def _aliased(nodes: list[Node], name: str) -> str:
    return next((n.text for n in nodes if n.upper != "AS"), name)


def _sources(engine, target: list[Node]) -> dict[str, str]:
    """Alias to table name of the tables of a join."""
    out: dict[str, str] = {}
    words = ("JOIN", "INNER", "LEFT", "RIGHT", "OUTER", "CROSS", "STRAIGHT_JOIN", "NATURAL", "ON", "USING", "AS")
    begin = True
    for i, n in enumerate(target):
        if isinstance(n, Group):
            if begin:
                out |= _sources(engine, n.nodes)
            begin = False
        elif n.upper in ("JOIN", "STRAIGHT_JOIN") or n.kind == "op" and n.text == ",":
            begin = True
        elif begin and n.kind in ("word", "name") and n.upper not in words:
            rest = [x for x in target[i + 1 : i + 3] if x.upper != "AS"]
            alias = rest[0].text if rest and not isinstance(rest[0], Group) and rest[0].kind in ("word", "name") and rest[0].upper not in (*words, "WHERE", "SET") else n.text
            out[alias.lower()] = n.text
            begin = False
    return out


def _met(engine, table, alias: str, target: list[Node], where: list[Node], values: dict[str, str], with_: str) -> DataFrame:
    """Identities of rows of one table that a join meets, and the values for each (the least
    of them where a row is met more than once)."""
    with engine.identified(table):
        columns = ", ".join([f"`{alias}`.{FILE} AS {FILE}", f"`{alias}`.{ROW} AS {ROW}", *(f"({v}) AS `_{c}`" for c, v in values.items())])
        condition = f" WHERE {engine._text(where)}" if where else ""
        rows = engine.spark.sql(f"{with_} SELECT {columns} FROM {engine._text(target)}{condition}").where(f"{FILE} IS NOT NULL")
        if values:
            rows = rows.groupBy(FILE, ROW).agg(F.min(F.struct(*(F.col(f"`_{c}`") for c in values))).alias("_v")).select(FILE, ROW, "_v.*")
        else:
            rows = rows.distinct()
        return engine.kept(rows)


def _rewrite(table, hits: DataFrame, given: dict[str, str] | None, alias: str) -> int:
    """Write the files that hold ``hits`` anew: without them if ``given`` is None, else with
    the values of ``given`` (SQL text by column) in them. Other files stay."""
    files = touched(hits)
    if not files:
        return 0
    rows = table.of_files(files)
    told = hits.withColumnsRenamed({FILE: "_hit_file", ROW: "_hit_row"})
    same = (rows[FILE] == told["_hit_file"]) & (rows[ROW] == told["_hit_row"])
    if given is None:
        table.swap(files, rows.join(told, same, "left_anti"))
    else:
        kinds = {f.name: f.dataType for f in table.schema}
        both = rows.join(told, same, "left").alias(alias)
        hit = F.col("_hit_file").isNotNull()
        out = [F.when(hit, F.expr(given[c.lower()]).cast(kinds[c])).otherwise(F.col(f"`{alias}`.`{c}`")).alias(c) if c.lower() in given else F.col(f"`{alias}`.`{c}`").alias(c) for c in table.columns]
        table.swap(files, _generated(table, both.select(*out)))
    return hits.count()


def update(engine, nodes: list[Node], with_: str) -> int:
    """UPDATE t [alias] SET c = e, .. [WHERE] [ORDER BY] [LIMIT], or UPDATE t JOIN u ON .. SET ..
    of columns of one or several of the tables."""
    nodes = _skip(nodes, "LOW_PRIORITY", "IGNORE")
    at = _find(nodes, "SET")
    target, rest = nodes[:at], nodes[at + 1 :]
    body, where, order, limit = _tail(rest)
    if _find(target, "JOIN", "STRAIGHT_JOIN") >= 0 or any(n.kind == "op" and n.text == "," for n in target):
        sources = _sources(engine, target)
        by_table: dict[str, dict[str, str]] = {}
        for part in split(body):
            eq = next(i for i, n in enumerate(part) if n.kind == "op" and n.text in ("=", ":="))
            column = part[eq - 1].text.lower()
            named = part[0].text.lower() if eq == 3 else None
            owner = named or next((a for a, t in sources.items() if t.lower() in engine.tables and column in {c.lower() for c in engine.table(t).columns}), None)
            if owner not in sources:
                raise SqlError(f"no table has a column {column}")
            by_table.setdefault(owner, {})[column] = engine._text(part[eq + 1 :])
        met = [(a, engine.table(sources[a]), v, _met(engine, engine.table(sources[a]), a, target, where, v, with_)) for a, v in by_table.items()]
        return sum(_rewrite(table, hits, {c: f"`_{c}`" for c in v}, "_t") for _, table, v, hits in met)
    table = engine.table(target[0].text)
    alias = _aliased(target[1:], target[0].text)
    given = {c: engine._text(v) for c, v in _assignments(body).items()}
    return _rewrite(table, _hits(engine, table, where, order, limit, alias, with_), given, alias)


def delete(engine, nodes: list[Node], with_: str) -> int:
    """DELETE FROM t [WHERE] [ORDER BY] [LIMIT], DELETE t, .. FROM t JOIN .., DELETE FROM t, .. USING .."""
    nodes = _skip(nodes, "LOW_PRIORITY", "QUICK", "IGNORE")
    at, using = _find(nodes, "FROM"), _find(nodes, "USING")
    if at > 0 or using > 0:
        named = nodes[:at] if at > 0 else nodes[1:using]
        target, where, _, _ = _tail(nodes[(at if at > 0 else using) + 1 :])
        sources = _sources(engine, target)
        met = []
        for part in split(named):
            alias = part[0].text.lower()
            alias = alias if alias in sources else next((a for a, t in sources.items() if t.lower() == alias), alias)
            if alias not in sources:
                raise SqlError(f"{alias} is no table of the join")
            table = engine.table(sources[alias])
            met.append((table, _met(engine, table, alias, target, where, {}, with_)))
        return sum(_rewrite(table, hits, None, "_t") for table, hits in met)
    target, where, order, limit = _tail(nodes[1:])
    table = engine.table(target[0].text)
    return _rewrite(table, _hits(engine, table, where, order, limit, _aliased(target[1:], target[0].text), with_), None, "_t")
