"""Tokens of MySQL-flavoured SQL, and the tree that parentheses make of them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class SqlError(ValueError):
    """Text that this front end can't read."""


@dataclass(frozen=True)
class Token:
    kind: str  # word, name (quoted), text, number, binary, op, var, param
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


@dataclass
class Group:
    """A parenthesised list of nodes."""

    nodes: list = field(default_factory=list)
    upper: str = ""
    kind: str = "group"


Node = Token | Group

_RULES = re.compile(
    r"""
    (?P<space>\s+|--[ \t][^\n]*|--$|\#[^\n]*|/\*(?!!).*?\*/)
  | (?P<hint>/\*!\d*(?P<inner>.*?)\*/)
  | (?P<hex>[xX]'[0-9A-Fa-f]*'|0[xX][0-9A-Fa-f]+)
  | (?P<bits>[bB]'[01]*'|0[bB][01]+)
  | (?P<text>(?:[nN]|_[A-Za-z0-9]+\s*)?(?:'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"))
  | (?P<name>`(?:[^`]|``)+`)
  | (?P<number>\d+\.\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?(?![A-Za-z_$]))
  | (?P<var>@@?[A-Za-z0-9_.$]+)
  | (?P<word>[A-Za-z_$\u0080-￿][A-Za-z0-9_$\u0080-￿]*|\d+[A-Za-z_$][A-Za-z0-9_$]*)
  | (?P<param>\?)
  | (?P<op><=>|->>|->|:=|\|\||&&|<<|>>|<=|>=|<>|!=|[-+*/%=<>!&|^~.,;(){}:])
    """,
    re.VERBOSE | re.DOTALL,
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def unquote(text: str) -> str:
    """The value of a text literal with MySQL's escapes."""
    mark = text[0]
    out, i, body = [], 0, text[1:-1]
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            follow = body[i + 1]
            out.append(_ESCAPES.get(follow, "\\" + follow if follow in "%_" else follow))
            i += 2
        elif c == mark:
            out.append(mark)
            i += 2
        else:
            out.append(c)
            i += 1
    return "".join(out)


def quote(value: str) -> str:
    """A text literal for Spark."""
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"), ("\0", "\\0")):
        value = value.replace(a, b)
    return f"'{value}'"


def scan(sql: str) -> list[Token]:
    out: list[Token] = []
    at = 0
    while at < len(sql):
        m = _RULES.match(sql, at)
        if not m:
            raise SqlError(f"can't read {sql[at : at + 20]!r}")
        at = m.end()
        kind = m.lastgroup if m.lastgroup != "inner" else "hint"
        text = m.group(0)
        if kind == "space":
            continue
        if kind == "hint":
            out += scan(m["inner"])
        elif kind == "hex":
            digits = text[2:-1] if text[-1] == "'" else text[2:]
            out.append(Token("binary", f"X'{digits}'") if text[-1] == "'" else Token("number", str(int(digits, 16))))
        elif kind == "bits":
            digits = text[2:-1] if text[-1] == "'" else text[2:]
            out.append(Token("number", str(int(digits or "0", 2))))
        elif kind == "text":
            value = unquote(text[re.search("['\"]", text).start() :])
            if out and out[-1].kind == "text":  # adjacent literals are one
                out[-1] = Token("text", out[-1].text + value)
            else:
                out.append(Token("text", value))
        elif kind == "name":
            out.append(Token("name", text[1:-1].replace("``", "`")))
        else:
            out.append(Token(kind, text))
    return out


def tree(tokens: list[Token]) -> list[Node]:
    """Nest what stands in parentheses."""
    stack: list[list[Node]] = [[]]
    for t in tokens:
        if t.kind == "op" and t.text == "(":
            stack.append([])
        elif t.kind == "op" and t.text == ")":
            if len(stack) == 1:
                raise SqlError("a parenthesis too many")
            inner = stack.pop()
            stack[-1].append(Group(inner))
        else:
            stack[-1].append(t)
    if len(stack) > 1:
        raise SqlError("a parenthesis is missing")
    return stack[0]


def split(nodes: list[Node], mark: str = ",") -> list[list[Node]]:
    """Cut a list at an operator."""
    out: list[list[Node]] = [[]]
    for n in nodes:
        if n.kind == "op" and n.text == mark:
            out.append([])
        else:
            out[-1].append(n)
    return out if len(out) > 1 or out[0] else []


def pieces(sql: str) -> list[str]:
    """The statements of a text as they stand in it, cut at semicolons."""
    out, begin, at = [], 0, 0
    while at < len(sql):
        m = _RULES.match(sql, at)
        if not m:
            raise SqlError(f"can't read {sql[at : at + 20]!r}")
        if m.lastgroup == "op" and m.group(0) == ";":
            out.append(sql[begin:at])
            begin = m.end()
        at = m.end()
    out.append(sql[begin:])
    return [p.strip() for p in out if scan(p)]


def render(nodes: list[Node]) -> str:
    """Spark SQL text of tokens."""
    out: list[str] = []
    tight = False
    for n in nodes:
        if isinstance(n, Group):
            text = f"({render(n.nodes)})"
        elif n.kind == "text":
            text = quote(n.text)
        elif n.kind == "name":
            text = "`" + n.text.replace("`", "``") + "`"
        else:
            text = n.text
        dot = n.kind == "op" and n.text == "."
        if out and (tight or dot):
            out[-1] += text
        else:
            out.append(text)
        tight = dot
    return " ".join(out)
