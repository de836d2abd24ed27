import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import mixing


def rows_of(n=600, seed=2):
    r = random.Random(seed)
    sources = ["src0"] * 8 + ["b", "c", "é", None, "tiny"]
    rows = [(i, " \x0b".join(["w"] * r.choice([0, 1, 3, 20, 200])), s if s != "tiny" or i < 50 else "b") for i in range(n) for s in [r.choice(sources)]]
    return [*rows, (9000, None, "src0"), (9001, "", None), (None, "a b c", "c"), (5, rows[5][1], rows[5][2]), (9002, None, "void")]


def test_targets_against_plain_water_filling():
    sizes = {"a": 10, "b": 1000, "c": 5, None: 100}
    found = mixing.targets(sizes)
    assert all(found[s] <= 2 * sizes[s] for s in sizes)
    assert sum(found.values()) == pytest.approx(1.5 * sum(sizes.values()))
    assert found["a"] == 20 and found["c"] == 10
    # 1672.5 by 5:2:1:5 is over twice the size of a, c and null; b has all that is left
    assert found[None] == 200 and found["b"] == pytest.approx(1672.5 - 20 - 10 - 200)
    even = mixing.targets({"x": 100, "y": 100, "z": 100, "zz": 100}, share=0.5)
    assert even == pytest.approx({"x": 200 * 5 / 13, "y": 200 * 2 / 13, "z": 200 / 13, "zz": 200 * 5 / 13})
    assert mixing.targets({}) == {}


@pytest.mark.parametrize("block", [16, 4096])
def test_mix(docs, block):
    rows = rows_of()
    got = mixing.mix(docs(rows), block=block).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode().split())
    assert sorted((repr(r.doc_id), r.source or "", r["size"]) for r in got) == sorted((repr(d), s or "", size(t)) for d, t, s in rows)
    by = {}
    for r in got:
        assert r.taken == r.copies * r["size"] <= 2 * r["size"] and r.copies in (0, 1, 2)
        by.setdefault(r.source, []).append(r)
    want = mixing.targets({s: sum(r["size"] for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert x[0].target == pytest.approx(want[s]) and x[0].source_size == sum(r["size"] for r in x)
        assert abs(sum(r.taken for r in x) - want[s]) <= 200
        if x[0].source_size:
            assert abs(sum(r.copies for r in x) - len(x) * want[s] / x[0].source_size) <= 2
    again = mixing.mix(docs(rows).repartition(3), block=block).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_flight_keeps_both_totals():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 50, 400):
        size, p = r.integers(0, 40, n).astype(float), r.random(n)
        out = mixing.fly(p, size)
        assert out.sum() == pytest.approx(p.sum()) and out @ size == pytest.approx(p @ size)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert set(mixing.land(out, size)) <= {0.0, 1.0}
        low = [x for x in (p @ size - out @ size, mixing.land(out, size) @ size - p @ size)]
        assert abs(low[0]) < 1e-6 and abs(low[1]) <= size.max(initial=0)


def test_copies_of_a_row_meet_in_no_single_block(docs, monkeypatch):
    """A row that is nearly all of its source: blocks stay small and totals near."""
    rows = [(1, "a b c", "s", None)] * 900 + [(i, "w " * (i % 7), "t", None) for i in range(300)]
    sizes, fly = [], mixing.fly
    ranks = mixing.ranked(mixing.sizes(docs(rows)).withColumn("row", F.monotonically_increasing_id())).groupBy("order").agg(F.count_distinct("rank").alias("n"), F.max("rank").alias("m"), F.count("*").alias("all")).collect()
    assert all(r.n == r["all"] == r.m + 1 for r in ranks) and max(r.n for r in ranks) == 900
    monkeypatch.setattr(mixing, "fly", lambda p, x: (sizes.append(len(p)), fly(p, x))[1])
    got = mixing.mix(docs(rows), block=32).collect()
    taken = sum(r.taken for r in got if r.doc_id == 1 and r["size"] == 3 and r.source == "s")
    assert abs(taken - next(r.target for r in got if r.source == "s")) <= 6
    again = mixing.mix(docs(rows).repartition(7), block=32).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_empty(docs):
    assert mixing.mix(docs([])).count() == 0
