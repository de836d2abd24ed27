import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import lines, mph

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def slow(rows):
    holders = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            holders.setdefault(key(x), set()).add(d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        keep = []
        for x in parts:
            own = holders[key(x)]
            last = max((i for i in own if i is not None), default=None)
            if len(key(x)) < 20 or len(own) < 3 or d == last:
                keep.append(x)
        out.append((d, len(parts), len(parts) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def rows_of():
    r = random.Random(4)
    pool = ["".join(r.choice("abC éß\x85\t") for _ in range(r.randint(15, 60))) for _ in range(25)]
    pool += ["x" * 19, "y" * 20, "É" * 20, "é" * 19 + "  "]
    rows = [(i, "\n".join(r.choice(["", " ", "\t", "\r"]) + (x.upper() if r.random() < 0.1 and x.isascii() else x) for x in r.choices(pool, k=r.randint(0, 9)))) for i in range(70)]
    return [*rows, (500, None), (501, ""), (502, "\n\n"), (None, rows[5][1]), (None, rows[6][1]), (7, rows[7][1]), (7, pool[0])]


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_against_brute_force(docs, monkeypatch, bound):
    monkeypatch.setattr(lines, "PROBE_ROWS", 20)
    rows = rows_of()
    got = lines.dedup_lines(docs(rows).withColumn("hi", F.lit("x")), broadcast_bytes=bound, shard_keys=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow(rows)


def test_empty_table(docs):
    assert lines.dedup_lines(docs([])).count() == 0


def test_minimal_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000, dtype=np.uint64)
    table = mph.MinimalHash.from_bytes(mph.MinimalHash.build(keys).to_bytes())
    assert sorted(table(keys).tolist()) == list(range(5000))
    assert len(mph.MinimalHash.build(keys[:0])(keys)) == 5000
