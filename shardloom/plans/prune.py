"""Shard pruning: partition predicates that conditions on shard keys imply.

Catalyst doesn't know that ``_tbl`` is a function of a key column, so ``key = 5`` alone reads
all shards. Each query block is pruned by its own top-level conjuncts: ``key = n``,
``n = key``, ``key <=> n`` and ``key IN (n, ..)`` with whole numbers. A condition under OR,
XOR or NOT prunes nothing. The conditions themselves stay.
"""

from __future__ import annotations

from shardloom.plans.tokens import Group, Node, split


def _op(n: Node, *texts: str) -> bool:
    return n.kind == "op" and n.text in texts


def conjuncts(where: list[Node]) -> list[list[Node]]:
    """Top-level conjuncts; none if an OR or XOR stands beside them."""
    if any(n.upper in ("OR", "XOR") or _op(n, "||") for n in where):
        return []
    out: list[list[Node]] = [[]]
    between = False
    for n in where:
        if n.upper == "BETWEEN":
            between = True
        if (n.upper == "AND" or _op(n, "&&")) and not between:
            out.append([])
            continue
        if n.upper == "AND":
            between = False
        out[-1].append(n)
    flat: list[list[Node]] = []
    for c in out:
        inner = c[0] if len(c) == 1 and isinstance(c[0], Group) else None
        flat += conjuncts(inner.nodes) if inner and not any(n.upper == "SELECT" for n in inner.nodes) else [c] if c else []
    return flat


def _number(nodes: list[Node]) -> int | None:
    sign = 1
    if len(nodes) == 2 and _op(nodes[0], "-"):
        sign, nodes = -1, nodes[1:]
    if len(nodes) != 1 or nodes[0].kind != "number":
        return None
    value = float(nodes[0].text) if not nodes[0].text.isdigit() else int(nodes[0].text)
    return sign * int(value) if value == int(value) else None


def _column(nodes: list[Node]) -> tuple[str | None, str] | None:
    if len(nodes) == 1 and nodes[0].kind in ("word", "name"):
        return None, nodes[0].text.lower()
    if len(nodes) == 3 and _op(nodes[1], ".") and all(n.kind in ("word", "name") for n in (nodes[0], nodes[2])):
        return nodes[0].text.lower(), nodes[2].text.lower()
    return None


def key_values(where: list[Node], qualifier: str, alone: bool) -> dict[str, list[int]]:
    """The values that conjuncts allow for columns of the relation called ``qualifier``.
    Columns without a qualifier count where the block has this relation ``alone``."""
    found: dict[str, set[int]] = {}
    for c in conjuncts(where):
        at = next((i for i, n in enumerate(c) if _op(n, "=", "<=>") or n.upper == "IN"), None)
        if at is None:
            continue
        left, right = c[:at], c[at + 1 :]
        if c[at].upper == "IN":
            column = _column(left)
            values = [_number(v) for v in split(right[0].nodes)] if len(right) == 1 and isinstance(right[0], Group) else [None]
        else:
            column = _column(left) or _column(right)
            values = [_number(right if _column(left) else left)]
        if column is None or None in values or not values:
            continue
        if column[0] == qualifier or column[0] is None and alone:
            own = found.setdefault(column[1], set(values))
            own &= set(values)
    return {k: sorted(v) for k, v in found.items()}


def predicate(shards: dict[str, list[int]]) -> str:
    """SQL text for shards by partition column; an empty list reads nothing."""
    parts = [f"{name} IN ({', '.join(map(str, v))})" if v else "false" for name, v in shards.items()]
    return " AND ".join(parts)
