"""MySQL functions whose name or meaning differs from Spark's: from argument texts to Spark
SQL text. Functions that agree are not listed and pass through."""

from __future__ import annotations

import re
from collections.abc import Callable

#: Format specifiers of DATE_FORMAT and STR_TO_DATE and their patterns here (fixed values).
DATE_PATTERNS = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%c": "M", "%d": "dd", "%e": "d", "%H": "HH", "%k": "H",
    "%h": "hh", "%I": "hh", "%l": "h", "%i": "mm", "%s": "ss", "%S": "ss", "%f": "SSSSSS", "%p": "a",
    "%M": "MMMM", "%b": "MMM", "%W": "EEEE", "%a": "EEE", "%j": "DDD", "%T": "HH:mm:ss", "%r": "hh:mm:ss a",
    "%%": "%",
}

#: GET_FORMAT results (fixed values).
GET_FORMATS = {
    ("DATE", "USA"): "%m.%d.%Y", ("DATE", "JIS"): "%Y-%m-%d", ("DATE", "ISO"): "%Y-%m-%d",
    ("DATE", "EUR"): "%d.%m.%Y", ("DATE", "INTERNAL"): "%Y%m%d",
    ("DATETIME", "USA"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "JIS"): "%Y-%m-%d %H:%i:%s",
    ("DATETIME", "ISO"): "%Y-%m-%d %H:%i:%s", ("DATETIME", "EUR"): "%Y-%m-%d %H.%i.%s", ("DATETIME", "INTERNAL"): "%Y%m%d%H%i%s",
    ("TIME", "USA"): "%h:%i:%s %p", ("TIME", "JIS"): "%H:%i:%s", ("TIME", "ISO"): "%H:%i:%s",
    ("TIME", "EUR"): "%H.%i.%s", ("TIME", "INTERNAL"): "%H%i%s",
}


def date_pattern(fmt: str) -> str:
    """A MySQL date format as a pattern of Spark's date_format."""
    out, i, plain = [], 0, ""

    def flush() -> None:
        nonlocal plain
        if plain:
            out.append("'" + plain.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in plain) else plain)
            plain = ""

    while i < len(fmt):
        two = fmt[i : i + 2]
        if two in DATE_PATTERNS:
            flush()
            out.append(DATE_PATTERNS[two])
            i += 2
        else:
            plain += two[1:] if two[0] == "%" and len(two) == 2 else two[0]
            i += 2 if two[0] == "%" and len(two) == 2 else 1
    flush()
    return "".join(out)


def _literal(arg: str) -> str | None:
    if len(arg) > 1 and arg[0] == arg[-1] == "'":
        return arg[1:-1].replace("\\'", "'").replace("\\\\", "\\")
    return None


def _formatted(arg: str) -> str:
    text = _literal(arg)
    if text is None:
        raise ValueError("date formats have to be text literals")
    return "'" + date_pattern(text).replace("\\", "\\\\").replace("'", "\\'") + "'"


def _all_known(name: str) -> Callable:
    """GREATEST and LEAST are null if any argument is."""
    return lambda *a: f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in a)} THEN NULL ELSE {name}({', '.join(a)}) END"


def _interval(n: str, *bounds: str) -> str:
    cases = " ".join(f"WHEN ({n}) < ({b}) THEN {i}" for i, b in enumerate(bounds))
    return f"CASE WHEN ({n}) IS NULL THEN -1 {cases} ELSE {len(bounds)} END"


def _substring(s: str, at: str, n: str | None = None) -> str:
    body = f"substring({s}, {at}, {n})" if n is not None else f"substring({s}, {at})"
    return f"CASE WHEN ({at}) = 0 THEN '' ELSE {body} END"


def _week_parts(d: str, mode: int) -> tuple[str, str]:
    """The week and its year. Odd bits of the mode as MySQL has them: weeks begin on Monday (1),
    counted from 1 and not from 0 (2), and week 1 is the first with its first day in the year
    (4) or with four days, which bit 1 turns round."""
    if not 0 <= mode <= 7:
        raise ValueError(f"there is no WEEK mode {mode}")
    day = f"CAST({d} AS DATE)"
    monday, from_one = mode & 1, mode & 2
    first_full = bool(mode & 4) == bool(monday)  # modes 0, 2, 5, 7
    at, year = f"(dayofyear({day}) - 1)", f"year({day})"
    weekday = f"weekday({day})" if monday else f"(dayofweek({day}) - 1)"
    begin = f"pmod({weekday} - {at}, 7)"  # the weekday of January 1
    whole = lambda w: f"CASE WHEN {w} = 0 THEN 1 ELSE 0 END" if first_full else f"CASE WHEN {w} <= 3 THEN 1 ELSE 0 END"
    week = f"(CAST(floor(({at} + {begin}) / 7) AS INT) + {whole(begin)})"
    if not from_one:
        return week, year
    before = f"(datediff(make_date({year}, 1, 1), make_date({year} - 1, 1, 1)))"
    begin_before = f"pmod({begin} - {before}, 7)"
    last = f"(CAST(floor(({at} + {before} + {begin_before}) / 7) AS INT) + {whole(begin_before)})"
    length = f"(datediff(make_date({year} + 1, 1, 1), make_date({year}, 1, 1)))"
    after = "false" if first_full else f"(floor(({at} + {begin}) / 7) = floor(({length} + {begin}) / 7) AND pmod({begin} + {length}, 7) BETWEEN 1 AND 3)"
    return (f"(CASE WHEN {week} = 0 THEN {last} WHEN {after} THEN 1 ELSE {week} END)", f"(CASE WHEN {week} = 0 THEN {year} - 1 WHEN {after} THEN {year} + 1 ELSE {year} END)")


def _week(d: str, mode: str = "0") -> str:
    return _week_parts(d, int(mode))[0]


def _year_week(d: str, mode: str = "0") -> str:
    week, year = _week_parts(d, int(mode) | 2)
    return f"({year} * 100 + {week})"


#: Specifiers that no date pattern has.
_SPECIAL = {
    "%D": lambda d: f"concat(day({d}), CASE WHEN day({d}) BETWEEN 11 AND 13 THEN 'th' WHEN day({d}) % 10 = 1 THEN 'st' WHEN day({d}) % 10 = 2 THEN 'nd' WHEN day({d}) % 10 = 3 THEN 'rd' ELSE 'th' END)",
    "%w": lambda d: f"CAST(dayofweek({d}) - 1 AS STRING)",
    "%U": lambda d: f"lpad({_week(d, '0')}, 2, '0')",
    "%u": lambda d: f"lpad({_week(d, '1')}, 2, '0')",
    "%V": lambda d: f"lpad({_week(d, '2')}, 2, '0')",
    "%v": lambda d: f"lpad({_week(d, '3')}, 2, '0')",
    "%X": lambda d: f"lpad({_week_parts(d, 2)[1]}, 4, '0')",
    "%x": lambda d: f"lpad({_week_parts(d, 3)[1]}, 4, '0')",
}


def _date_format(d: str, f: str) -> str:
    fmt = _literal(f)
    if fmt is None:
        raise ValueError("date formats have to be text literals")
    parts, plain, i = [], "", 0
    while i < len(fmt):
        two = fmt[i : i + 2]
        if two in _SPECIAL:
            parts += [plain, two]
            plain = ""
        else:
            plain += two if two[0] == "%" else two[0]
        i += 2 if two[0] == "%" else 1
    parts.append(plain)
    quoted = lambda x: "'" + date_pattern(x).replace("\\", "\\\\").replace("'", "\\'") + "'"
    texts = [_SPECIAL[x](d) if x in _SPECIAL else f"date_format({d}, {quoted(x)})" for x in parts if x]
    return texts[0] if len(texts) == 1 else f"concat({', '.join(texts)})"


def _seconds(t: str) -> str:
    """The seconds of a time of day or span, a text such as -12:34:56."""
    part = lambda i: f"coalesce(try_cast(try_element_at(split(ltrim('-', CAST({t} AS STRING)), ':'), {i}) AS DOUBLE), 0)"
    return f"(CASE WHEN startswith(CAST({t} AS STRING), '-') THEN -1 ELSE 1 END * CAST({part(1)} * 3600 + {part(2)} * 60 + {part(3)} AS BIGINT))"


def _span(n: str) -> str:
    return f"format_string('%s%02d:%02d:%02d', CASE WHEN {n} < 0 THEN '-' ELSE '' END, CAST(abs({n}) DIV 3600 AS INT), CAST(abs({n}) DIV 60 % 60 AS INT), CAST(abs({n}) % 60 AS INT))"


def _is_span(t: str) -> str:
    return f"CAST({t} AS STRING) RLIKE '^-?[0-9]+:[0-9:.]+$'"


def _time_difference(a: str, b: str) -> str:
    moment = lambda x: f"unix_timestamp(try_cast(CAST({x} AS STRING) AS TIMESTAMP))"
    return f"(CASE WHEN {_is_span(a)} THEN {_span(f'({_seconds(a)} - {_seconds(b)})')} ELSE {_span(f'({moment(a)} - {moment(b)})')} END)"


def _add_time(t: str, more: str, sign: str) -> str:
    moment = f"date_format(try_cast(CAST({t} AS STRING) AS TIMESTAMP) {sign} make_interval(0, 0, 0, 0, 0, 0, {_seconds(more)}), 'yyyy-MM-dd HH:mm:ss')"
    return f"(CASE WHEN {_is_span(t)} THEN {_span(f'({_seconds(t)} {sign} {_seconds(more)})')} ELSE {moment} END)"


def _months(p: str) -> str:
    return f"(({p}) DIV 100 * 12 + ({p}) % 100 - 1)"


def _inet_aton(a: str) -> str:
    part = lambda i: f"CAST(split({a}, '[.]')[{i}] AS BIGINT)"
    return f"CASE WHEN {a} RLIKE '^[0-9]+([.][0-9]+){{3}}$' THEN {part(0)} * 16777216 + {part(1)} * 65536 + {part(2)} * 256 + {part(3)} END"


def _inet_ntoa(n: str) -> str:
    return f"concat_ws('.', ({n}) DIV 16777216, ({n}) DIV 65536 % 256, ({n}) DIV 256 % 256, ({n}) % 256)"


def _truncate(x: str, d: str) -> str:
    return f"(sign({x}) * floor(abs({x}) * pow(10, {d})) / pow(10, {d}))"


def _variant(doc: str, path: str) -> str:
    return f"try_variant_get(try_parse_json(CAST({doc} AS STRING)), {path}, 'variant')"


def json_extract(doc: str, path: str, *more: str) -> str:
    """The JSON text at a path: texts keep their quotes. Wildcards give what Spark's own
    function finds, and several paths an array."""
    if more:
        found = ", ".join(_variant(doc, p) for p in (path, *more))
        return f"to_json(filter(array({found}), x -> x IS NOT NULL))"
    return f"get_json_object({doc}, {path})" if "*" in path else f"to_json({_variant(doc, path)})"


def _json_unquote(d: str) -> str:
    quoted = f"startswith({d}, '\"') AND endswith({d}, '\"') AND length({d}) > 1"
    return f"CASE WHEN {quoted} THEN coalesce(get_json_object(concat('[', {d}, ']'), '$[0]'), {d}) ELSE {d} END"


def _json_length(d: str, path: str | None = None) -> str:
    at = d if path is None else json_extract(d, path)
    return f"coalesce(json_array_length({at}), size(json_object_keys({at})), CASE WHEN try_parse_json({at}) IS NOT NULL THEN 1 END)"


def _json_contains(doc: str, item: str, path: str | None = None) -> str:
    at = doc if path is None else json_extract(doc, path)
    text = f"CAST({item} AS STRING)"
    pairs = f"from_json({at}, 'map<string,string>')"
    objects = f"coalesce(forall(map_entries(from_json({text}, 'map<string,string>')), _e -> try_element_at({pairs}, _e.key) = _e.value), false)"
    listed = f"from_json({at}, 'array<string>')"
    arrays = f"forall(from_json({text}, 'array<string>'), _x -> array_contains({listed}, _x))"
    one = f"CASE WHEN json_array_length({at}) IS NOT NULL THEN array_contains({listed}, {_json_unquote(text)}) ELSE trim({at}) = trim({text}) END"
    return f"(CASE WHEN json_object_keys({text}) IS NOT NULL THEN json_object_keys({at}) IS NOT NULL AND {objects} WHEN json_array_length({text}) IS NOT NULL THEN {arrays} ELSE {one} END)"


def _json_type(d: str) -> str:
    first = f"left(trim({d}), 1)"
    return f"""CASE WHEN try_parse_json({d}) IS NULL THEN NULL WHEN {first} = '{{' THEN 'OBJECT' WHEN {first} = '[' THEN 'ARRAY' WHEN {first} = '"' THEN 'STRING' WHEN {first} IN ('t', 'f') THEN 'BOOLEAN' WHEN {first} = 'n' THEN 'NULL' WHEN {d} RLIKE '[.eE]' THEN 'DOUBLE' ELSE 'INTEGER' END"""


def _json_contains_path(d: str, how: str, *paths: str) -> str:
    join = " OR " if _literal(how).lower() == "one" else " AND "
    return f"({join.join(f'{_variant(d, p)} IS NOT NULL' for p in paths)})"


def _json_key(path: str) -> str:
    key = (_literal(path) or "")[2:]
    if not re.fullmatch(r"\w+", key):
        raise ValueError("JSON documents change by paths of one key ($.key)")
    return key


def _json_pairs_of(d: str) -> str:
    return f"from_json({d}, 'map<string,variant>')"


def _json_change(keep: str) -> Callable:
    """JSON_SET, JSON_INSERT and JSON_REPLACE of keys of an object: ``keep`` says for a key
    whether what is there stays (new keys: whether they come)."""

    def change(d: str, *pairs: str) -> str:
        for path, value in zip(pairs[::2], pairs[1::2]):
            key, have = _json_key(path), _json_pairs_of(d)
            there = f"map_contains_key({have}, '{key}')"
            new = f"to_json(map_concat(map_filter({have}, (_k, _v) -> _k <> '{key}'), map('{key}', parse_json(substring(to_json(array({value})), 2, length(to_json(array({value}))) - 2)))))"
            d = {"set": new, "insert": f"CASE WHEN {there} THEN {d} ELSE {new} END", "replace": f"CASE WHEN {there} THEN {new} ELSE {d} END"}[keep]
        return d

    return change


def _json_remove(d: str, *paths: str) -> str:
    for path in paths:
        d = f"to_json(map_filter({_json_pairs_of(d)}, (_k, _v) -> _k <> '{_json_key(path)}'))"
    return d


def _json_merge_patch(a: str, b: str) -> str:
    theirs = _json_pairs_of(b)
    return f"to_json(map_concat(map_filter({_json_pairs_of(a)}, (_k, _v) -> NOT map_contains_key({theirs}, _k)), map_filter({theirs}, (_k, _v) -> NOT is_variant_null(_v))))"


def _json_pairs(*a: str) -> str:
    return f"to_json(named_struct({', '.join(a)}))"


#: Name in upper case to a maker of Spark SQL text.
FUNCTIONS: dict[str, Callable[..., str]] = {
    # strings
    "CHAR": lambda *a: f"concat({', '.join(f'char({x})' for x in a)})",
    "INSERT": lambda s, p, n, new: f"CASE WHEN ({p}) < 1 OR ({p}) > char_length({s}) THEN {s} WHEN ({n}) < 0 THEN concat(left({s}, ({p}) - 1), {new}) ELSE overlay({s} PLACING {new} FROM {p} FOR {n}) END",
    "SUBSTRING": _substring,
    "SUBSTR": _substring,
    "MID": _substring,
    "LENGTH": lambda s: f"octet_length({s})",
    "CHARACTER_LENGTH": lambda s: f"char_length({s})",
    "LCASE": lambda s: f"lower({s})",
    "UCASE": lambda s: f"upper({s})",
    "STRCMP": lambda a, b: f"CASE WHEN ({a}) = ({b}) THEN 0 WHEN ({a}) < ({b}) THEN -1 WHEN ({a}) > ({b}) THEN 1 END",
    "FIELD": lambda x, *a: f"CAST(coalesce(array_position(array({', '.join(a)}), {x}), 0) AS INT)",
    "CRC32": lambda s: f"crc32(CAST({s} AS BINARY))",
    "TO_BASE64": lambda s: f"base64(CAST({s} AS BINARY))",
    "FROM_BASE64": lambda s: f"CAST(unbase64({s}) AS STRING)",
    "OCT": lambda n: f"conv({n}, 10, 8)",
    "FORMAT": lambda x, d, *_: f"format_number({x}, {d})",
    "PASSWORD": lambda s: f"concat('*', upper(sha1(unhex(sha1({s})))))",
    "WEIGHT_STRING": lambda s: f"CAST({s} AS BINARY)",
    "CHARSET": lambda s: "'utf8mb4'",
    "REGEXP_LIKE": lambda s, p, *_: f"regexp_like({s}, {p})",
    "REGEXP_SUBSTR": lambda s, p: f"regexp_substr({s}, {p})",
    "SPACE": lambda n: f"space({n})",
    "ORD": lambda s: f"coalesce(CAST(conv(nullif(hex(left({s}, 1)), ''), 16, 10) AS BIGINT), 0)",
    "INET_ATON": _inet_aton,
    "INET_NTOA": _inet_ntoa,
    # dates
    "DATE": lambda d: f"to_date({d})",
    "TIME": lambda t: f"date_format({t}, 'HH:mm:ss')",
    "TIMESTAMP": lambda t, more=None: f"to_timestamp({t})" if more is None else f"(to_timestamp({t}) + (to_timestamp(concat('1970-01-01 ', {more})) - TIMESTAMP'1970-01-01 00:00:00'))",
    "MICROSECOND": lambda t: f"CAST(date_format({t}, 'SSSSSS') AS INT)",
    "WEEK": _week,
    "YEARWEEK": _year_week,
    "TIMEDIFF": _time_difference,
    "ADDTIME": lambda t, x: _add_time(t, x, "+"),
    "SUBTIME": lambda t, x: _add_time(t, x, "-"),
    "TIME_TO_SEC": _seconds,
    "SEC_TO_TIME": lambda n: _span(f"({n})"),
    "MAKETIME": lambda h, m, x: _span(f"(CAST(({h}) AS BIGINT) * 3600 + ({m}) * 60 + CAST(({x}) AS BIGINT))"),
    "PERIOD_ADD": lambda p, n: f"(({_months(p)} + ({n})) DIV 12 * 100 + ({_months(p)} + ({n})) % 12 + 1)",
    "PERIOD_DIFF": lambda a, b: f"({_months(a)} - {_months(b)})",
    "CONVERT_TZ": lambda t, a, b: f"convert_timezone({a}, {b}, CAST({t} AS TIMESTAMP_NTZ))",
    "UNIX_TIMESTAMP": lambda t=None: "unix_timestamp()" if t is None else f"unix_timestamp(CAST({t} AS TIMESTAMP))",
    "DAYNAME": lambda d: f"date_format({d}, 'EEEE')",
    "MONTHNAME": lambda d: f"date_format({d}, 'MMMM')",
    "DATE_FORMAT": _date_format,
    "STR_TO_DATE": lambda s, f: f"to_timestamp({s}, {_formatted(f)})",
    "TO_DAYS": lambda d: f"(datediff({d}, DATE'1970-01-01') + 719528)",
    "FROM_DAYS": lambda n: f"date_add(DATE'1970-01-01', CAST({n} AS INT) - 719528)",
    "MAKEDATE": lambda y, n: f"date_add(make_date({y}, 1, 1), CAST({n} AS INT) - 1)",
    "CURTIME": lambda *_: "date_format(now(), 'HH:mm:ss')",
    "CURDATE": lambda: "current_date()",
    "SYSDATE": lambda *_: "now()",
    "UTC_DATE": lambda: "to_date(now())",
    "UTC_TIME": lambda *_: "date_format(now(), 'HH:mm:ss')",
    "UTC_TIMESTAMP": lambda *_: "now()",
    "DATABASE": lambda: "current_database()",
    "USER": lambda: "current_user()",
    "ROW_COUNT": lambda: "-1",
    # numbers
    "MOD": lambda a, b: f"(({a}) % nullif({b}, 0))",
    "TRUNCATE": _truncate,
    "INTERVAL": _interval,
    "GREATEST": _all_known("greatest"),
    "LEAST": _all_known("least"),
    "LOG": lambda a, b=None: f"ln({a})" if b is None else f"log({a}, {b})",
    "ATAN": lambda a, b=None: f"atan({a})" if b is None else f"atan2({a}, {b})",
    # conditions and JSON
    "ISNULL": lambda x: f"(({x}) IS NULL)",
    "JSON_EXTRACT": json_extract,
    "JSON_UNQUOTE": _json_unquote,
    "JSON_LENGTH": _json_length,
    "JSON_TYPE": _json_type,
    "JSON_CONTAINS_PATH": _json_contains_path,
    "JSON_SET": _json_change("set"),
    "JSON_INSERT": _json_change("insert"),
    "JSON_REPLACE": _json_change("replace"),
    "JSON_REMOVE": _json_remove,
    "JSON_MERGE_PATCH": _json_merge_patch,
    "JSON_KEYS": lambda d: f"to_json(json_object_keys({d}))",
    "JSON_CONTAINS": _json_contains,
    "JSON_OBJECT": _json_pairs,
    "JSON_ARRAY": lambda *a: f"to_json(array({', '.join(a)}))",
    "JSON_VALID": lambda d: f"(try_parse_json({d}) IS NOT NULL)",
    # aggregates
    "STD": lambda x: f"stddev_pop({x})",
    "STDDEV": lambda x: f"stddev_pop({x})",
    "VARIANCE": lambda x: f"var_pop({x})",
    "BIT_OR": lambda x: f"coalesce(bit_or({x}), 0)",
    "BIT_XOR": lambda x: f"coalesce(bit_xor({x}), 0)",
    "BIT_AND": lambda x: f"coalesce(bit_and({x}), -1)",
    "JSON_ARRAYAGG": lambda x: f"to_json(sort_array(collect_list({x})))",
    "JSON_OBJECTAGG": lambda k, v: f"to_json(map_from_entries(sort_array(collect_list(struct({k}, {v})))))",
    "ST_COLLECT": lambda g: f"collect_list({g})",
    # shapes are structs and arrays
    "POINT": lambda x, y: f"named_struct('x', CAST({x} AS DOUBLE), 'y', CAST({y} AS DOUBLE))",
    **{n: (lambda *a: f"array({', '.join(a)})") for n in ("LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON", "GEOMETRYCOLLECTION", "GEOMCOLLECTION")},
}

#: Names that change and nothing else.
ALIASES = {"CEILING": "ceil", "CHARACTER_LENGTH": "char_length", "POWER": "power", "LOCATE": "locate"}
