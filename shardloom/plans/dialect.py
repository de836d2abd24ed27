"""From MySQL-flavoured SQL to Spark SQL text.

What both dialects read alike passes through. The rest is rewritten on tokens: operators
whose meaning differs, functions of another name, clauses that only a MySQL server needs,
and constructs that Spark has no syntax for.
"""

from __future__ import annotations

from collections.abc import Callable

from shardloom.functions.mysql import FUNCTIONS, GET_FORMATS, json_extract
from shardloom.plans.tokens import Group, Node, SqlError, Token, quote, render, split

_NOT_FUNCTIONS = set(
    "IN EXISTS ANY SOME ALL AND OR NOT XOR ON USING VALUES VALUE AS FROM JOIN WHERE SELECT BY LATERAL UNION THEN WHEN ELSE CASE "
    "BETWEEN LIKE INTO TABLE OVER OF WITH DISTINCT PARTITION COLUMNS INDEX KEY DIV IS HAVING LIMIT OFFSET SET RETURNING END REGEXP RLIKE".split()
)
_MODIFIERS = set(
    "ALL HIGH_PRIORITY LOW_PRIORITY DELAYED STRAIGHT_JOIN SQL_SMALL_RESULT SQL_BIG_RESULT SQL_BUFFER_RESULT SQL_CACHE SQL_NO_CACHE SQL_CALC_FOUND_ROWS".split()
)
_BOUNDARIES = set(
    "SELECT FROM WHERE ON HAVING GROUP ORDER LIMIT UNION WINDOW WHEN THEN ELSE END CASE AS ASC DESC BY JOIN LEFT RIGHT INNER CROSS NATURAL OR SET VALUES USING DISTINCT OFFSET INTERSECT EXCEPT".split()
)
_UNITS = {
    "YEAR": (0, 1), "QUARTER": (1, 3), "MONTH": (1, 1), "WEEK": (2, 1), "DAY": (3, 1), "HOUR": (4, 1), "MINUTE": (5, 1), "SECOND": (6, 1),
}
#: Composite units: the parts of their text, from the left, as places of make_interval.
_COMPOSITE = {
    "YEAR_MONTH": (0, 1), "DAY_HOUR": (3, 4), "DAY_MINUTE": (3, 4, 5), "DAY_SECOND": (3, 4, 5, 6), "DAY_MICROSECOND": (3, 4, 5, 6, 7),
    "HOUR_MINUTE": (4, 5), "HOUR_SECOND": (4, 5, 6), "HOUR_MICROSECOND": (4, 5, 6, 7), "MINUTE_SECOND": (5, 6), "MINUTE_MICROSECOND": (5, 6, 7), "SECOND_MICROSECOND": (6, 7),
}
_CASTS = {
    "SIGNED": "BIGINT", "UNSIGNED": "DECIMAL(20,0)", "CHAR": "STRING", "NCHAR": "STRING", "CHARACTER": "STRING", "VARCHAR": "STRING", "TEXT": "STRING", "BINARY": "BINARY",
    "DATETIME": "TIMESTAMP", "TIMESTAMP": "TIMESTAMP", "DATE": "DATE", "YEAR": "SMALLINT", "JSON": "STRING", "REAL": "DOUBLE", "DOUBLE": "DOUBLE", "FLOAT": "FLOAT",
    "INT": "INT", "INTEGER": "INT", "BIGINT": "BIGINT", "SMALLINT": "SMALLINT", "TINYINT": "TINYINT", "BOOLEAN": "BOOLEAN",
}


def _raw(text: str) -> Token:
    return Token("raw", text)


def _is(n: Node | None, *words: str) -> bool:
    return n is not None and n.upper in words


def _op(n: Node | None, *texts: str) -> bool:
    return n is not None and n.kind == "op" and n.text in texts


def _find(nodes: list[Node], *words: str, start: int = 0) -> int:
    return next((i for i in range(start, len(nodes)) if _is(nodes[i], *words)), -1)


class Normaliser:
    """Rewrites statements. ``variables`` are the values of @names; ``from_table`` may
    replace a table of a query block (see ``prune``)."""

    def __init__(self, variables: dict | None = None, from_table: Callable | None = None):
        self.variables = variables or {}
        self.from_table = from_table

    def text(self, nodes: list[Node]) -> str:
        return render(self.rewrite(nodes))

    def rewrite(self, nodes: list[Node]) -> list[Node]:
        nodes = self._peers(self._clauses(list(nodes)))
        if self.from_table:
            nodes = self._tables(nodes)
        nodes = self._calls(nodes)
        return self._operators(nodes)

    # -- clauses of a query block

    def _clauses(self, nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        i = 0
        if _is(nodes[0] if nodes else None, "VALUES") and len(nodes) > 1 and _is(nodes[1], "ROW"):
            rows, j = [], 1
            while j + 1 < len(nodes) and _is(nodes[j], "ROW"):
                rows.append(nodes[j + 1])
                j += 3 if j + 2 < len(nodes) and _op(nodes[j + 2], ",") else 2
            names = ", ".join(f"column_{k}" for k in range(len(split(rows[0].nodes))))
            values = ", ".join(f"({self.text(r.nodes)})" for r in rows)
            return [_raw(f"SELECT * FROM VALUES {values} AS _values({names})"), *self._clauses(nodes[j:])]
        while i < len(nodes):
            n, follow = nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None
            if _is(n, "SELECT"):
                out.append(n)
                i += 1
                while _is(nodes[i] if i < len(nodes) else None, *_MODIFIERS):
                    i += 1
                if _is(nodes[i] if i < len(nodes) else None, "DISTINCTROW"):
                    out.append(Token("word", "DISTINCT"))
                    i += 1
            elif _is(n, "FROM") and _is(follow, "DUAL"):
                i += 2
            elif _is(n, "STRAIGHT_JOIN"):
                out += [Token("word", "INNER"), Token("word", "JOIN")]
                i += 1
            elif _is(n, "FOR") and _is(follow, "UPDATE", "SHARE"):
                i += 2
                while i < len(nodes) and not _is(nodes[i], "UNION", "FOR", "INTO"):
                    i += 1
            elif _is(n, "LOCK") and _is(follow, "IN"):
                i += 4
            elif _is(n, "USE", "FORCE", "IGNORE") and _is(follow, "INDEX", "KEY"):
                i += 2
                while i < len(nodes) and not isinstance(nodes[i], Group):
                    i += 1
                i += 1
            elif _is(n, "LIMIT") and i + 2 < len(nodes) and _op(nodes[i + 2], ","):
                out += [n, nodes[i + 3], Token("word", "OFFSET"), nodes[i + 1]]
                i += 4
            elif _is(n, "AS") and follow is not None and follow.kind == "text":
                out += [n, Token("name", follow.text)]
                i += 2
            elif n.kind == "op" and n.text == "{" and i + 1 < len(nodes):
                end = next(j for j in range(i, len(nodes)) if _op(nodes[j], "}"))
                mark = nodes[i + 1].upper
                word = {"D": "DATE", "T": "TIME", "TS": "TIMESTAMP"}.get(mark)
                out += [Token("word", word)] if word else []
                out += self._clauses(nodes[i + 2 : end])
                i = end + 1
            else:
                out.append(n)
                i += 1
        return out

    def _tables(self, nodes: list[Node]) -> list[Node]:
        """Let ``from_table`` replace tables of each block of this list."""
        out: list[Node] = []
        begins = [i for i, n in enumerate(nodes) if _is(n, "SELECT")]
        if not begins:
            return nodes
        out += nodes[: begins[0]]
        for a, b in zip(begins, [*begins[1:], len(nodes)]):
            out += self._block(nodes[a:b])
        return out

    def _block(self, nodes: list[Node]) -> list[Node]:
        start = next((i for i, n in enumerate(nodes) if _is(n, "FROM") and not (_is(nodes[i + 1], "FIRST", "LAST") and isinstance(nodes[i - 1], Group))), -1)
        if start < 0:
            return nodes
        end = next((i for i in range(start + 1, len(nodes)) if _is(nodes[i], "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "WINDOW", "FOR")), len(nodes))
        where: list[Node] = []
        if end < len(nodes) and _is(nodes[end], "WHERE"):
            stop = next((i for i in range(end + 1, len(nodes)) if _is(nodes[i], "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "WINDOW", "FOR")), len(nodes))
            where = nodes[end + 1 : stop]
        out, i, fresh, tables = nodes[: start + 1], start + 1, True, 0
        tables = sum(_op(n, ",") or _is(n, "JOIN") for n in nodes[start:end]) + 1
        while i < end:
            n = nodes[i]
            if fresh and n.kind in ("word", "name") and not _is(n, "LATERAL", "SELECT", "JSON_TABLE"):
                name, i = n.text, i + 1
                if i + 1 < end and _op(nodes[i], "."):
                    name, i = nodes[i + 1].text, i + 2
                parts = None
                if i + 1 < end and _is(nodes[i], "PARTITION") and isinstance(nodes[i + 1], Group):
                    parts, i = [p[0].text for p in split(nodes[i + 1].nodes)], i + 2
                alias = None
                if i < end and _is(nodes[i], "AS"):
                    alias, i = nodes[i + 1].text, i + 2
                elif i < end and (nodes[i].kind == "name" or nodes[i].kind == "word" and nodes[i].upper not in _BOUNDARIES | {"STRAIGHT_JOIN", "LATERAL", "USE", "FORCE", "IGNORE"}):
                    alias, i = nodes[i].text, i + 1
                out.append(_raw(self.from_table(name, alias, where, parts, tables)))
                fresh = False
            else:
                fresh = _op(n, ",") or _is(n, "JOIN", "STRAIGHT_JOIN")
                out.append(n)
                i += 1
        return out + nodes[end:]

    # -- window frames

    @staticmethod
    def _peers(nodes: list[Node]) -> list[Node]:
        """GROUPS frames of a block over one table: a peer group's number is its dense rank,
        found in a derived table, and the frame is a RANGE over it."""

        def has_groups(n: Node) -> bool:
            return isinstance(n, Group) and any(_is(x, "GROUPS") and _is(n.nodes[i + 1], "BETWEEN", "UNBOUNDED", "CURRENT") | (n.nodes[i + 1].kind == "number") for i, x in enumerate(n.nodes[:-1]))

        if not any(has_groups(n) for n in nodes):
            return nodes
        select, start = _find(nodes, "SELECT"), _find(nodes, "FROM")
        ends = ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "UNION", "WINDOW")
        end = next((i for i in range(start + 1, len(nodes)) if _is(nodes[i], *ends)), len(nodes))
        source = nodes[start + 1 : end]
        stop = end
        if end < len(nodes) and _is(nodes[end], "WHERE"):
            stop = next((i for i in range(end + 1, len(nodes)) if _is(nodes[i], *ends)), len(nodes))
        if select < 0 or any(_op(n, ",") or _is(n, "JOIN") for n in source) or any(_is(n, "GROUP", "UNION", "WINDOW") for n in nodes) or any(_op(n, "*") for n in nodes[select + 1 : start]):
            raise SqlError("GROUPS frames ask for one table, a list of columns, and no GROUP BY, UNION or WINDOW")
        source = [n for n in source if not _is(n, "AS")]
        alias = source[-1] if len(source) > 1 and not _op(source[-2], ".") else source[-1]
        inner: list[Node] = [Token("word", "SELECT"), Token("op", "*")]
        out: list[Node] = []
        for n in nodes[:start]:
            if not has_groups(n):
                out.append(n)
                continue
            at = next(i for i, x in enumerate(n.nodes) if _is(x, "GROUPS"))
            order = _find(n.nodes, "ORDER")
            peer = Token("word", f"_peer{len(inner)}")
            inner += [Token("op", ","), Token("word", "DENSE_RANK"), Group([]), Token("word", "OVER"), Group(n.nodes[:at]), Token("word", "AS"), peer]
            out.append(Group([*n.nodes[:order], Token("word", "ORDER"), Token("word", "BY"), peer, Token("word", "RANGE"), *n.nodes[at + 1 :]]))
        inner += [Token("word", "FROM"), *nodes[start + 1 : end], *nodes[end:stop]]
        return [*out, nodes[start], Group(inner), Token("word", "AS"), alias, *nodes[stop:]]

    @staticmethod
    def _mirrored(spec: list[Node]) -> list[Node]:
        """The same frame of a window, walked from its other end."""
        order = _find(spec, "ORDER")
        if order < 0:
            raise SqlError("FROM LAST asks for an order")
        kind = next((i for i, n in enumerate(spec) if _is(n, "ROWS", "RANGE")), len(spec))
        items = []
        for item in split(spec[order + 2 : kind]):
            down = _is(item[-1], "DESC")
            items.append([*(item[:-1] if _is(item[-1], "ASC", "DESC") else item), Token("word", "ASC" if down else "DESC")])
        flip = {"PRECEDING": "FOLLOWING", "FOLLOWING": "PRECEDING"}
        turned = lambda bound: [Token("word", flip.get(n.upper, n.text)) if n.kind == "word" else n for n in bound]
        frame = spec[kind:] or [Token("word", w) for w in ("RANGE", "UNBOUNDED", "PRECEDING")]
        between = _is(frame[1], "BETWEEN")
        cut = next((i for i, n in enumerate(frame) if _is(n, "AND")), len(frame))
        low, high = frame[2 if between else 1 : cut], frame[cut + 1 :] or [Token("word", "CURRENT"), Token("word", "ROW")]
        out = [*spec[:order], Token("word", "ORDER"), Token("word", "BY")]
        for i, item in enumerate(items):
            out += [Token("op", ","), *item] if i else item
        return [*out, frame[0], Token("word", "BETWEEN"), *turned(high), Token("word", "AND"), *turned(low)]

    def _excluded(self, name: str, argument: str, spec: list[Node]) -> str:
        """An aggregate over a frame without the current row."""
        at = _find(spec, "EXCLUDE")
        what, spec = [n.upper for n in spec[at + 1 :]], spec[:at]
        call = f"{name.lower()}({argument})"
        over = lambda f, w: f"({f} OVER ({self.text(w)}))"
        if what == ["NO", "OTHERS"]:
            return over(call, spec)
        if what in (["GROUP"], ["TIES"]) and name in ("SUM", "COUNT", "AVG"):
            return self._without_peers(name, argument, spec, what == ["TIES"])
        if what != ["CURRENT", "ROW"] or name not in ("SUM", "COUNT", "AVG", "MIN", "MAX"):
            raise SqlError(f"EXCLUDE {' '.join(what)} of {name} has a DataFrame function and no SQL text")
        kind = next((i for i, n in enumerate(spec) if _is(n, "ROWS", "RANGE")), len(spec))
        frame, head = spec[kind:], spec[:kind]
        between = len(frame) > 1 and _is(frame[1], "BETWEEN")
        cut = next((i for i, n in enumerate(frame) if _is(n, "AND")), len(frame))
        low, high = frame[2 if between else 1 : cut], frame[cut + 1 :] or [Token("word", "CURRENT"), Token("word", "ROW")]
        if _is(low[-1] if low else None, "FOLLOWING") or _is(high[-1], "PRECEDING"):
            return over(call, spec)  # the current row is outside
        if name in ("MIN", "MAX"):
            if not frame or not _is(frame[0], "ROWS"):
                raise SqlError("EXCLUDE CURRENT ROW of MIN and MAX asks for a ROWS frame")
            rows, one = [Token("word", "ROWS"), Token("word", "BETWEEN")], Token("number", "1")
            sides = []
            if not _is(low[-1], "ROW"):
                sides.append(over(call, [*head, *rows, *low, Token("word", "AND"), one, Token("word", "PRECEDING")]))
            if not _is(high[-1], "ROW"):
                sides.append(over(call, [*head, *rows, one, Token("word", "FOLLOWING"), Token("word", "AND"), *high]))
            return f"{'least' if name == 'MIN' else 'greatest'}({', '.join(sides)})" if len(sides) > 1 else sides[0] if sides else "NULL"
        own = "1" if argument == "*" else f"CASE WHEN ({argument}) IS NULL THEN 0 ELSE 1 END"
        count = f"({over(f'count({argument})', spec)} - {own})"
        if name == "COUNT":
            return count
        total = f"({over(f'sum({argument})', spec)} - coalesce({argument}, 0))"
        return f"(CASE WHEN {count} > 0 THEN {total}{' / ' + count if name == 'AVG' else ''} END)"

    def _without_peers(self, name: str, argument: str, spec: list[Node], own_stays: bool) -> str:
        """An aggregate over a RANGE frame (or a whole partition) that holds all peers of the
        current row, without these, or without them but the row itself."""
        kind = next((i for i, n in enumerate(spec) if _is(n, "ROWS", "RANGE")), len(spec))
        words = [n.upper for n in spec[kind:]]
        whole = words[1:] == ["BETWEEN", "UNBOUNDED", "PRECEDING", "AND", "UNBOUNDED", "FOLLOWING"]
        if words[:1] == ["ROWS"] and not whole or not whole and ("FOLLOWING" in words[:4] or words[-1:] == ["PRECEDING"] and "BETWEEN" in words):
            raise SqlError("EXCLUDE GROUP and TIES have SQL text for RANGE frames that hold the current row; others are DataFrame functions")
        peers = [*spec[:kind], *(Token("word", w) for w in ("RANGE", "BETWEEN", "CURRENT", "ROW", "AND", "CURRENT", "ROW"))]
        own = ("1" if argument == "*" else f"CASE WHEN ({argument}) IS NULL THEN 0 ELSE 1 END") if own_stays else "0"
        over = lambda call, w: f"({call} OVER ({self.text(w)}))"
        count = f"({over(f'count({argument})', spec)} - {over(f'count({argument})', peers)} + {own})"
        if name == "COUNT":
            return count
        left = f"coalesce({argument}, 0)" if own_stays else "0"
        total = f"({over(f'sum({argument})', spec)} - coalesce({over(f'sum({argument})', peers)}, 0) + {left})"
        return f"(CASE WHEN {count} > 0 THEN {total}{' / ' + count if name == 'AVG' else ''} END)"

    # -- calls

    def _args(self, group: Group) -> list[str]:
        return [self.text(a) for a in split(group.nodes)]

    def _calls(self, nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(nodes):
            n = nodes[i]
            group = nodes[i + 1] if i + 1 < len(nodes) and isinstance(nodes[i + 1], Group) else None
            operand = bool(out) and (out[-1].kind in ("number", "text", "raw", "name", "group", "param") or out[-1].kind == "word" and out[-1].upper not in _BOUNDARIES | _NOT_FUNCTIONS)
            if isinstance(n, Group):
                out.append(Group(self.rewrite(n.nodes)))
                i += 1
            elif group is not None and n.kind in ("word", "name") and n.upper not in _NOT_FUNCTIONS and not (n.upper == "MOD" and operand) and not (n.upper == "INTERVAL" and len(split(group.nodes)) < 2):
                if n.upper == "ROW":
                    out.append(Group(self.rewrite(group.nodes)))
                    i += 2
                    continue
                if n.upper == "MATCH":
                    out.append(_raw(self._match(group, nodes[i + 3])))
                    i += 4
                    continue
                if n.upper == "JSON_TABLE":
                    i += 2
                    if _is(nodes[i], "AS"):
                        i += 1
                    out.append(_raw(self._json_table(group, nodes[i].text)))
                    i += 1
                    continue
                over = i + 2
                while over < len(nodes) and _is(nodes[over], "IGNORE", "RESPECT", "NULLS", "FROM", "FIRST", "LAST") and not (_is(nodes[over], "FROM") and not _is(nodes[over + 1] if over + 1 < len(nodes) else None, "FIRST", "LAST")):
                    over += 1
                windowed = over < len(nodes) and _is(nodes[over], "OVER")
                if windowed and isinstance(nodes[over + 1], Group) and _find(nodes[over + 1].nodes, "EXCLUDE") >= 0:
                    out.append(_raw(self._excluded(n.upper, self.text(group.nodes), nodes[over + 1].nodes)))
                    i = over + 2
                    continue
                text = self._call(n, group, windowed)
                if windowed:
                    between = [x for x in nodes[i + 2 : over]]
                    ignore = " IGNORE NULLS" if any(_is(x, "IGNORE") for x in between) else ""
                    window = nodes[over + 1]
                    if any(_is(x, "LAST") for x in between):
                        if not isinstance(window, Group):
                            raise SqlError("FROM LAST asks for a window of its own")
                        window = Group(self._mirrored(window.nodes))
                    spec = f"({self.text(window.nodes)})" if isinstance(window, Group) else window.text
                    out.append(_raw(f"({text}{ignore} OVER {spec})"))
                    i = over + 2
                else:
                    out.append(_raw(text))
                    i += 2
            elif _is(n, "SYSDATE", "CURDATE", "UTC_DATE", "UTC_TIME", "UTC_TIMESTAMP"):
                out.append(_raw(FUNCTIONS[n.upper]()))
                i += 1
            else:
                out.append(n)
                i += 1
        return out

    def _call(self, n: Node, group: Group, windowed: bool) -> str:
        name, nodes = n.upper, group.nodes
        special = getattr(self, f"_call_{name.lower()}", None) if name else None
        if special:
            return special(nodes)
        if windowed and name in ("BIT_OR", "BIT_AND", "BIT_XOR"):
            return f"{name.lower()}({self.text(nodes)})"
        if name in FUNCTIONS:
            args = self._args(group)
            try:
                return FUNCTIONS[name](*args)
            except TypeError:
                raise SqlError(f"{name} doesn't take {len(args)} arguments") from None
        head = n.text if n.kind == "word" else f"`{n.text}`"
        return f"{head}({self.text(nodes)})"

    def _call_cast(self, nodes: list[Node]) -> str:
        at = max(i for i, x in enumerate(nodes) if _is(x, "AS"))
        zone = _find(nodes, "AT")
        kind = self._type(nodes[at + 1 :])
        if zone >= 0:
            where = nodes[at - 1]
            if _is(where, "LOCAL"):
                return f"CAST({self.text(nodes[:zone])} AS {kind})"
            return f"CAST(from_utc_timestamp({self.text(nodes[:zone])}, {self.text([where])}) AS {kind})"
        return self._cast(self.text(nodes[:at]), kind, nodes[at + 1 :])

    def _cast(self, value: str, kind: str, nodes: list[Node]) -> str:
        text = f"try_cast({value} AS {kind})"
        if kind == "STRING" and len(nodes) > 1 and isinstance(nodes[1], Group):
            return f"left({text}, {self.text(nodes[1].nodes)})"
        if kind in ("BIGINT", "DECIMAL(20,0)"):
            if value.isdigit():
                return text
            # numbers round, exactly; texts give the integer they begin with, or null
            number = f"try_cast(round(try_cast({value} AS DECIMAL(38,9))) AS DECIMAL(38,0))"
            leading = f"try_cast(nullif(regexp_extract(CAST({value} AS STRING), '^[ ]*([-+]?[0-9]+)', 1), '') AS DECIMAL(38,0))"
            whole = f"coalesce({number}, {leading})"
            if kind == "BIGINT":
                return f"try_cast({whole} AS BIGINT)"
            return f"try_cast(CASE WHEN {whole} < 0 THEN {whole} + 18446744073709551616 ELSE {whole} END AS {kind})"
        return text

    def _type(self, nodes: list[Node]) -> str:
        name = nodes[0].upper
        if name in ("DECIMAL", "NUMERIC", "DEC", "FIXED"):
            return f"DECIMAL({self.text(nodes[1].nodes)})" if len(nodes) > 1 else "DECIMAL(10,0)"
        if name not in _CASTS:
            raise SqlError(f"no cast to {render(nodes)}")
        kind = _CASTS[name]
        return f"ARRAY<{kind}>" if _is(nodes[-1], "ARRAY") else kind

    def _call_convert(self, nodes: list[Node]) -> str:
        at = _find(nodes, "USING")
        if at >= 0:
            return f"CAST({self.text(nodes[:at])} AS STRING)"
        value, kind = split(nodes)
        return self._cast(self.text(value), self._type(kind), kind)

    def _call_group_concat(self, nodes: list[Node]) -> str:
        distinct = _is(nodes[0], "DISTINCT")
        nodes = nodes[distinct:]
        sep, at = ",", _find(nodes, "SEPARATOR")
        if at >= 0:
            sep, nodes = nodes[at + 1].text, nodes[:at]
        order, at = "", _find(nodes, "ORDER")
        if at >= 0:
            order, nodes = f" WITHIN GROUP (ORDER BY {self.text(nodes[at + 2 :])})", nodes[:at]
        parts = [f"CAST({self.text(a)} AS STRING)" for a in split(nodes)]
        value = parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"
        if len(parts) == 1 and distinct and order:
            value = self.text(nodes)  # the order of DISTINCT has to be that of the value itself
        return f"listagg({'DISTINCT ' if distinct else ''}{value}, {quote(sep)}){order}"

    def _call_trim(self, nodes: list[Node]) -> str:
        side = nodes[0].upper if _is(nodes[0], "LEADING", "TRAILING", "BOTH") else "BOTH"
        rest = nodes[1:] if _is(nodes[0], "LEADING", "TRAILING", "BOTH") else nodes
        at = _find(rest, "FROM")
        if at < 0:
            return f"trim({self.text(rest)})"
        what, value = rest[:at], self.text(rest[at + 1 :])
        if not what:
            return f"trim({side} FROM {value})"
        if what[0].kind == "text" and len(what[0].text) == 1:
            return f"trim({side} {self.text(what)} FROM {value})"
        # a longer text is taken off as a whole, again and again
        safe = f"concat('(\\\\Q', {self.text(what)}, '\\\\E)+')"
        patterns = {"LEADING": [f"concat('^', {safe})"], "TRAILING": [f"concat({safe}, '$')"]}
        for p in patterns.get(side) or [f"concat('^', {safe})", f"concat({safe}, '$')"]:
            value = f"regexp_replace({value}, {p}, '')"
        return value

    def _call_substring(self, nodes: list[Node]) -> str:
        at = _find(nodes, "FROM")
        if at < 0:
            return FUNCTIONS["SUBSTRING"](*[self.text(a) for a in split(nodes)])
        n = _find(nodes, "FOR")
        args = [nodes[:at], nodes[at + 1 : n if n >= 0 else None]] + ([nodes[n + 1 :]] if n >= 0 else [])
        return FUNCTIONS["SUBSTRING"](*[self.text(a) for a in args])

    _call_substr = _call_mid = _call_substring

    def _call_char(self, nodes: list[Node]) -> str:
        at = _find(nodes, "USING")
        return FUNCTIONS["CHAR"](*[self.text(a) for a in split(nodes[:at] if at >= 0 else nodes)])

    def _call_weight_string(self, nodes: list[Node]) -> str:
        at = _find(nodes, "AS")
        return FUNCTIONS["WEIGHT_STRING"](self.text(nodes[:at] if at >= 0 else nodes))

    def _call_position(self, nodes: list[Node]) -> str:
        at = _find(nodes, "IN")
        return f"position({self.text(nodes[:at])} IN {self.text(nodes[at + 1 :])})"

    def _call_extract(self, nodes: list[Node]) -> str:
        unit, value = nodes[0].upper, self.text(nodes[2:])
        if unit == "MICROSECOND":
            return FUNCTIONS["MICROSECOND"](value)
        if unit == "WEEK":
            return FUNCTIONS["WEEK"](value)
        if unit in _COMPOSITE:
            pattern = {0: "yyyy", 1: "MM", 3: "dd", 4: "HH", 5: "mm", 6: "ss", 7: "SSSSSS"}
            return f"CAST(date_format({value}, '{''.join(pattern[p] for p in _COMPOSITE[unit])}') AS BIGINT)"
        return f"CAST(extract({unit} FROM {value}) AS INT)"

    def _call_get_format(self, nodes: list[Node]) -> str:
        kind, region = split(nodes)
        return quote(GET_FORMATS[kind[0].upper.replace("TIMESTAMP", "DATETIME"), region[0].text.upper()])

    def _call_date_format(self, nodes: list[Node]) -> str:
        value, fmt = split(nodes)
        fmt = self.text(fmt)
        return FUNCTIONS["DATE_FORMAT"](self._moment(value), fmt)

    def _moment(self, nodes: list[Node], time: bool = False) -> str:
        """A date or timestamp; a text literal becomes one."""
        text = self.text(nodes)
        if len(nodes) == 1 and nodes[0].kind == "text":
            return f"TIMESTAMP{text}" if time or len(nodes[0].text) > 10 else f"DATE{text}"
        return f"CAST({text} AS TIMESTAMP)" if time else text

    def _date_arith(self, nodes: list[Node], sign: str) -> str:
        value, step = split(nodes)
        if not _is(step[0], "INTERVAL"):
            return f"date_add({self._moment(value)}, {'-' if sign == '-' else ''}({self.text(step)}))"
        unit = step[-1].upper
        time = unit in ("HOUR", "MINUTE", "SECOND", "MICROSECOND") or unit in _COMPOSITE and unit != "YEAR_MONTH"
        return f"({self._moment(value, time)} {sign} {self._interval(step[1:-1], unit)})"

    def _call_date_add(self, nodes: list[Node]) -> str:
        return self._date_arith(nodes, "+")

    def _call_date_sub(self, nodes: list[Node]) -> str:
        return self._date_arith(nodes, "-")

    _call_adddate, _call_subdate = _call_date_add, _call_date_sub

    def _interval(self, nodes: list[Node], unit: str) -> str:
        if unit in _COMPOSITE:
            if len(nodes) != 1 or nodes[0].kind != "text":
                raise SqlError(f"{unit} asks for a text literal")
            negative = nodes[0].text.strip().startswith("-")
            numbers = [x for x in "".join(c if c.isdigit() else " " for c in nodes[0].text).split()]
            places = _COMPOSITE[unit]
            values = dict.fromkeys(range(8), 0)
            for place, x in zip(places[len(places) - len(numbers) :], numbers):
                values[place] = int(x.ljust(6, "0")[:6]) if place == 7 else int(x)
            sign = -1 if negative else 1
            parts = [str(sign * values[p]) for p in range(6)]
            return f"make_interval({', '.join(parts)}, {sign * values[6]} + {sign * values[7]} / 1000000.0)"
        value = f"({self.text(nodes)})"
        if unit == "MICROSECOND":
            return f"make_interval(0, 0, 0, 0, 0, 0, {value} / 1000000.0)"
        place, times = _UNITS[unit]
        parts = ["0"] * 7
        parts[place] = value if times == 1 else f"{times} * {value}"
        if place < 6:
            parts[place] = f"CAST({parts[place]} AS INT)"
        return f"make_interval({', '.join(parts)})"

    def _call_timestampadd(self, nodes: list[Node]) -> str:
        unit, n, value = split(nodes)
        return f"timestampadd({unit[0].upper}, {self.text(n)}, {self._moment(value, True)})"

    def _call_timestampdiff(self, nodes: list[Node]) -> str:
        unit, a, b = split(nodes)
        return f"timestampdiff({unit[0].upper}, {self._moment(a, True)}, {self._moment(b, True)})"

    def _call_grouping(self, nodes: list[Node]) -> str:
        name = "grouping_id" if len(split(nodes)) > 1 else "grouping"
        return f"{name}({self.text(nodes)})"

    def _call_json_value(self, nodes: list[Node]) -> str:
        doc, rest = split(nodes)[0], [x for part in split(nodes)[1:] for x in part]
        path, at = rest[0], _find(rest, "RETURNING")
        kind = "STRING"
        if at >= 0:
            stop = next((i for i in range(at + 1, len(rest)) if _is(rest[i], "DEFAULT", "NULL", "ERROR")), len(rest))
            kind = self._type(rest[at + 1 : stop])
        return self._json_value(self.text(doc), path.text, kind, rest)

    def _json_value(self, doc: str, path: str, kind: str, rest: list[Node]) -> str:
        """A value of a JSON path with its ON EMPTY and ON ERROR rules."""
        found = f"get_json_object({doc}, {quote(path)})"
        value = found if kind == "STRING" else f"try_cast({found} AS {kind})"
        empty = error = None
        for i, x in enumerate(rest):
            if _is(x, "ON") and i + 1 < len(rest):
                before = rest[i - 1]
                if _is(before, "ERROR"):
                    rule = "raise_error('no value at a JSON path')"
                elif _is(before, "NULL"):
                    rule = "NULL"
                else:
                    rule = f"CAST({self.text([before])} AS {kind})"
                if _is(rest[i + 1], "EMPTY"):
                    empty = rule
                else:
                    error = rule
        if error not in (None, "NULL"):
            value = f"CASE WHEN {found} IS NOT NULL AND {value} IS NULL THEN {error} ELSE {value} END"
        if empty not in (None, "NULL"):
            value = f"CASE WHEN {found} IS NULL THEN {empty} ELSE {value} END"
        return value

    def _json_table(self, group: Group, alias: str) -> str:
        doc, rest = split(group.nodes)[0], split(group.nodes)[1:]
        rest = [x for k, part in enumerate(rest) for x in (part if k == 0 else [Token("op", ","), *part])]
        columns = next(x for x in rest if isinstance(x, Group))
        select, joins = self._json_columns(split(columns.nodes), "_j0")
        return f"LATERAL (SELECT {', '.join(select)} FROM {self._json_rows(self.text(doc), rest[0].text)} AS _j0(_p, _e){joins}) AS {alias}"

    def _json_rows(self, doc: str, path: str) -> str:
        if path.endswith("[*]"):
            inner = path[:-3]
            source = doc if inner == "$" else f"get_json_object({doc}, {quote(inner)})"
            return f"posexplode(from_json({source}, 'array<string>'))"
        source = doc if path == "$" else f"get_json_object({doc}, {quote(path)})"
        return f"posexplode(array({source}))"

    def _json_columns(self, columns: list[list[Node]], own: str) -> tuple[list[str], str]:
        select, joins = [], ""
        for c in columns:
            if _is(c[0], "NESTED"):
                path = next(x for x in c if x.kind == "text").text
                inner = next(x for x in c if isinstance(x, Group))
                below = f"{own}n"
                more, deeper = self._json_columns(split(inner.nodes), below)
                select += more
                joins += f" LEFT JOIN LATERAL {self._json_rows(own + '._e', path)} AS {below}(_p, _e){deeper}"
            elif _is(c[1], "FOR"):
                select.append(f"{own}._p + 1 AS {c[0].text}")
            else:
                at = _find(c, "PATH")
                exists = _is(c[at - 1], "EXISTS")
                kind = self._type(c[1 : at - exists])
                path = c[at + 1].text
                if exists:
                    value = f"CAST(get_json_object({own}._e, {quote(path)}) IS NOT NULL AS {kind})"
                elif path == "$":
                    value = f"try_cast({own}._e AS {kind})"
                else:
                    value = self._json_value(f"{own}._e", path, kind, c[at + 2 :])
                select.append(f"{value} AS {c[0].text}")
        return select, joins

    def _match(self, columns: Group, against: Group) -> str:
        words = against.nodes[0]
        if words.kind != "text":
            raise SqlError("AGAINST asks for a text literal")
        boolean = _find(against.nodes, "BOOLEAN") >= 0
        wanted = [w.strip("+-*\"()~<>").lower() for w in words.text.split()]
        need = [w.strip("+*\"").lower() for w in words.text.split() if w.startswith("+")]
        avoid = [w.strip("-*\"").lower() for w in words.text.split() if w.startswith("-")]
        have = f"split(lower(concat_ws(' ', {self.text(columns.nodes)})), '[^\\\\p{{L}}\\\\p{{N}}_]+')"
        listed = lambda ws: "array(" + ", ".join(map(quote, ws)) + ")"
        score = f"CAST(size(array_intersect({have}, {listed([w for w in wanted if w not in avoid])})) AS DOUBLE)"
        if boolean and (need or avoid):
            tests = [f"array_contains({have}, {quote(w)})" for w in need] + [f"NOT array_contains({have}, {quote(w)})" for w in avoid]
            return f"CASE WHEN {' AND '.join(tests)} THEN {score} ELSE 0.0D END"
        return score

    # -- operators

    @staticmethod
    def _take(nodes: list[Node], i: int) -> tuple[list[Node], int]:
        """The operand that begins at i."""
        out: list[Node] = []
        while i < len(nodes) and (_op(nodes[i], "-", "+", "~", "!") or _is(nodes[i], "BINARY")):
            out.append(nodes[i])
            i += 1
        if i < len(nodes):
            first = nodes[i]
            out.append(first)
            i += 1
            while i + 1 < len(nodes) and _op(nodes[i], "."):
                out += nodes[i : i + 2]
                i += 2
            if first.kind == "word" and i < len(nodes) and (isinstance(nodes[i], Group) or first.upper in ("DATE", "TIMESTAMP") and nodes[i].kind == "text"):
                out.append(nodes[i])
                i += 1
        return out, i

    @staticmethod
    def _pop(out: list[Node]) -> list[Node]:
        """Take the operand that ends ``out``."""
        taken = [out.pop()]
        if isinstance(taken[0], Group) and out and out[-1].kind == "word" and out[-1].upper not in _NOT_FUNCTIONS | _BOUNDARIES:
            taken.insert(0, out.pop())
        while len(out) > 1 and _op(out[-1], "."):
            taken = [out[-2], out[-1], *taken]
            del out[-2:]
        return taken

    def _operators(self, nodes: list[Node]) -> list[Node]:
        out: list[Node] = []
        i = 0
        while i < len(nodes):
            n, follow = nodes[i], nodes[i + 1] if i + 1 < len(nodes) else None
            if _op(n, "||"):
                out.append(Token("word", "OR"))
            elif _op(n, "&&"):
                out.append(Token("word", "AND"))
            elif n.kind == "var":
                out.append(_raw(self._variable(n.text)))
            elif _op(n, "/", "%") or _is(n, "DIV") or _is(n, "MOD") and out:
                operand, i = self._take(nodes, i + 1)
                text = render(self._operators(operand))
                sign = {"MOD": "%", "DIV": "DIV"}.get(n.upper) or n.text
                if not (len(operand) == 1 and operand[0].kind == "number" and float(operand[0].text)):
                    text = f"nullif({text}, 0)"
                out += [Token("op", sign), _raw(text)]
                continue
            elif _op(n, "->", "->>"):
                left = self._pop(out)
                find = json_extract if n.text == "->" else "get_json_object({}, {})".format
                out.append(_raw(find(render(left), quote(follow.text))))
                i += 2
                continue
            elif n.kind == "op" and n.text in ("=", "<>", "!=", ">", ">=", "<", "<=") and _is(follow, "ANY", "SOME", "ALL") and i + 2 < len(nodes) and isinstance(nodes[i + 2], Group):
                left = self._pop(out)
                out.append(_raw(self._quantified(render(left), n.text, follow.upper, render(nodes[i + 2].nodes))))
                i += 3
                continue
            elif n.kind == "op" and n.text in ("=", "<>", "!=", "<=>") and isinstance(follow, Group) and out and isinstance(out[-1], Group) and len(split(out[-1].nodes)) > 1 and len(split(out[-1].nodes)) == len(split(follow.nodes)):
                pairs = list(zip(split(out.pop().nodes), split(follow.nodes)))
                sign, join = ("<=>" if n.text == "<=>" else "="), " AND "
                text = join.join(f"({render(a)}) {sign} ({render(b)})" for a, b in pairs)
                out.append(_raw(f"({text})" if n.text in ("=", "<=>") else f"(NOT ({text}))"))
                i += 2
                continue
            elif _is(n, "SOUNDS") and _is(follow, "LIKE"):
                left = self._pop(out)
                right, i = self._take(nodes, i + 2)
                out.append(_raw(f"(soundex({render(left)}) = soundex({render(right)}))"))
                continue
            elif _is(n, "MEMBER"):
                left = self._pop(out)
                at = i + 2 if _is(follow, "OF") else i + 1
                out.append(_raw(f"array_contains(from_json({render(nodes[at].nodes)}, 'array<string>'), CAST({render(left)} AS STRING))"))
                i = at + 1
                continue
            elif _is(n, "BINARY") and follow is not None and not _op(follow, ",", ")"):
                operand, i = self._take(nodes, i + 1)
                out.append(_raw(f"CAST({render(operand)} AS BINARY)"))
                continue
            elif _is(n, "COLLATE") and follow is not None:
                lower = follow.text.lower()
                out += [n, Token("word", "UTF8_LCASE" if lower.endswith("_ci") else "UTF8_BINARY" if lower.endswith("_bin") else follow.text)]
                i += 2
                continue
            elif _is(n, "INTERVAL") and follow is not None:
                operand, at = self._take(nodes, i + 1)
                unit = nodes[at].upper if at < len(nodes) else ""
                if at + 1 < len(nodes) and _is(nodes[at + 1], "PRECEDING", "FOLLOWING"):
                    out += [n, *operand, nodes[at]]  # frame bounds are literals
                    i = at + 1
                    continue
                if unit in _UNITS or unit in _COMPOSITE or unit == "MICROSECOND":
                    out.append(_raw(self._interval(operand, unit)))
                    i = at + 1
                    continue
                out.append(n)
            else:
                out.append(n)
            i += 1
        return self._xor(out)

    def _variable(self, name: str) -> str:
        value = self.variables.get(name.lstrip("@").lower())
        if value is None:
            return "NULL"
        if isinstance(value, bool):
            return str(value).lower()
        return str(value) if isinstance(value, int | float) else quote(str(value))

    @staticmethod
    def _quantified(left: str, op: str, how: str, query: str) -> str:
        source = f"FROM ({query}) AS _q(_c)"
        how = "ANY" if how == "SOME" else how
        op = "<>" if op == "!=" else op
        if (op, how) == ("=", "ANY"):
            return f"({left} IN ({query}))"
        if (op, how) == ("<>", "ALL"):
            return f"({left} NOT IN ({query}))"
        if op in ("=", "<>"):
            join = "AND" if op == "=" else "OR"
            test = f"({left} {op} (SELECT min(_c) {source}) {join} {left} {op} (SELECT max(_c) {source}))"
        else:
            end = "max" if (op in (">", ">=")) == (how == "ALL") else "min"
            test = f"({left} {op} (SELECT {end}(_c) {source}))"
        empty, settles = ("true", f"NOT {test} THEN false") if how == "ALL" else ("false", f"{test} THEN true")
        nulls = f"(SELECT count(*) - count(_c) {source}) > 0"
        return f"(CASE WHEN (SELECT count(*) {source}) = 0 THEN {empty} WHEN {settles} WHEN {nulls} THEN NULL ELSE {test} END)"

    @staticmethod
    def _truth(nodes: list[Node]) -> str:
        """A conjunction as a truth value; numbers count as true unless they are 0."""
        parts, between = [[]], False
        for n in nodes:
            if n.upper == "AND" and not between:
                parts.append([])
                continue
            between = n.upper == "BETWEEN" or between and n.upper != "AND"
            parts[-1].append(n)
        return "(" + " AND ".join(f"CAST(({render(p)}) AS BOOLEAN)" for p in parts) + ")"

    @staticmethod
    def _xor(nodes: list[Node]) -> list[Node]:
        at = _find(nodes, "XOR")
        while at >= 0:
            a = at
            while a > 0 and not (nodes[a - 1].upper in _BOUNDARIES or _op(nodes[a - 1], ",", "=")):
                a -= 1
            b = at + 1
            while b < len(nodes) and not (nodes[b].upper in _BOUNDARIES | {"XOR"} or _op(nodes[b], ",")):
                b += 1
            text = f"({Normaliser._truth(nodes[a:at])} <> {Normaliser._truth(nodes[at + 1 : b])})"
            nodes = [*nodes[:a], _raw(text), *nodes[b:]]
            at = _find(nodes, "XOR")
        return nodes
