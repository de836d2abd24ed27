import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardloom.llm import suffixes
from shardloom.llm.induced import SYMBOLS, InductionQueue, Level, Scratch, repeated_starts


def slow(rows, length):
    places = {}
    for i, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for j in range(len(b) - length + 1):
            places.setdefault(b[j : j + length], []).append((i, j))
    gone = [set() for _ in rows]
    for found in places.values():
        if len(found) > 1:
            for i, j in found:
                gone[i] |= set(range(j, j + length))
    out = []
    for (d, t), g in zip(rows, gone):
        b = (t or "").encode()
        out.append((d, len(b), len(g), sum(x - 1 not in g for x in g), bytes(x for i, x in enumerate(b) if i not in g)))
    return sorted(out, key=repr)


def rows_of(seed):
    r = random.Random(seed)
    text = lambda n, letters="abcdé\n": "".join(r.choice(letters) for _ in range(n))
    passages = [text(r.randint(30, 90)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            parts += [text(r.randint(0, 40)), p[a:] if r.random() < 0.5 else p]
        rows.append((i, "".join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(3)]
    rows += [(200, "a" * 150), (201, "ab" * 60), (202, "a" * 39), (203, "a" * 40), (204, None), (205, ""), (None, rows[5][1][:60]), (7, rows[7][1])]
    near = text(300)
    for i in range(20):
        at = r.randrange(280)
        rows.append((300 + i, near[:at] + text(5) + near[at + 5 :]))
    return rows


@pytest.mark.parametrize("seed, shard, spill", [(1, 1 << 20, 1 << 20), (2, 500, 64)])
def test_against_brute_force(docs, seed, shard, spill):
    rows = rows_of(seed)
    frame = docs(rows).withColumn("h", F.lit(1)).withColumn("k", F.lit(2))
    got = suffixes.dedup_spans(frame, length=40, gram=8, shard_bytes=shard, spill_bytes=spill).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got), key=repr) == slow(rows, 40)


def test_parts_of_long_texts(monkeypatch):
    r = random.Random(4)
    data = bytes(r.choice(b"abc") for _ in range(3000))
    whole = suffixes.segments(data, 40, 8)
    monkeypatch.setattr(suffixes, "_PART", 700)
    cut = suffixes.segments(data, 40, 8)

    def groups(found):
        return [g for _, n, g in zip(*(x.tolist() for x in found)) for _ in range(n)]

    assert groups(whole) == groups(cut) and sum(cut[1]) == len(data) - 39


def sorted_suffixes(text, cap):
    symbols = text.tolist()
    order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    common = [0] * len(order)
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        while symbols[a + common[k]] == symbols[b + common[k]]:
            common[k] += 1
    return order, [min(c, cap) for c in common]


@pytest.mark.parametrize("memory, chunk", [(64, 1), (64, 5), (1000, 16), (1 << 20, 1 << 18)])
def test_suffixes_and_prefixes_against_sorting(memory, chunk):
    r = np.random.default_rng(chunk)
    for trial in range(120):
        n, few = int(r.integers(1, 120)), r.integers(1, 5, 6)
        words = r.integers(1, 5, (4, 7))
        kinds = (r.integers(1, 4, n), np.tile(few, n)[:n], np.full(n, 257), r.integers(1, 258, n), np.repeat(r.integers(1, 4, n), r.integers(1, 6, n))[:n], words[r.integers(0, 4, n // 7 + 1)].ravel())
        text, cap = np.append(kinds[trial % 6], 0).astype(np.uint16), int(r.choice([3, 10, 60_000]))
        level = Level(text, 9, np.arange(SYMBOLS + 1), cap, Scratch(memory), chunk)
        order, common = level.sort()
        assert (order.tolist(), common.tolist()) == sorted_suffixes(text, cap)


def test_a_shard_far_larger_than_its_memory():
    """Two megabytes of text, sorted with 128 KB for arrays and queues, and with plenty."""
    r = np.random.default_rng(3)
    text = np.append(r.integers(2, 12, 1 << 20), 0).astype(np.uint16)
    for a, b in ((1000, 500_000), (77_777, 900_000), (910_000, 300_000)):
        text[b : b + 3000] = text[a : a + 3000]
    text[600_000:600_900] = 5
    tracemalloc.start()
    small = repeated_starts(text, 400, 1 << 17, 1 << 12)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert isinstance(small, np.memmap) and held < text.nbytes
    assert np.array_equal(small, repeated_starts(text, 400))
    windows = np.flatnonzero(small)
    assert {1000, 3600, 500_000, 502_600, 77_777, 900_000, 910_000, 600_000, 600_500} <= set(windows.tolist())
    assert len(windows) == 6 * 2601 + 501


def test_a_queue_that_spills_keeps_the_order():
    queue, r = InductionQueue(3, np.int32, 200), random.Random(2)
    wanted = [[], [], []]
    for i in range(60):
        at, n = r.randrange(3), r.randint(1, 9)
        items = np.arange(n, dtype=np.int32) + 100 * i
        queue.push(at, items, items.astype(np.uint64), items.astype(np.uint16))
        wanted[at] += items.tolist()
        if i % 7 == 0 and (got := queue.pop(at, 4)):
            assert got[0].tolist() == wanted[at][:4] and got[1].tolist() == wanted[at][:4]
            del wanted[at][:4]
    assert queue.spills > 3
    for at in range(3):
        got = queue.pop(at, 1000)
        assert got[0].tolist() == wanted[at] and queue.pop(at, 1) is None
    queue.close()


def test_empty(docs):
    assert suffixes.dedup_spans(docs([])).count() == 0


def test_a_passage_of_many_documents_is_not_one_shard(docs, monkeypatch):
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    notice = text(34)
    rows = [(i, text(60) + notice + text(60)) for i in range(120)]
    rows += [(200 + i, text(9) + rows[i][1][40:100] + text(9)) for i in range(30)]
    rows += [(300, rows[50][1]), (50, rows[50][1]), (301, notice * 3)]
    sort, shard = suffixes._sort_shards, 500

    def bounded(length, spill_bytes):
        inner = sort(length, spill_bytes)

        def run(batches):
            batches, sizes = list(batches), {}
            for batch in batches:
                for h, data in zip(batch.column("h").to_pylist(), batch.column("data").to_pylist()):
                    sizes[h] = sizes.get(h, 0) + len(data)
            assert max(sizes.values(), default=0) <= suffixes.HOT * shard
            yield from inner(iter(batches))

        return run

    monkeypatch.setattr(suffixes, "_sort_shards", bounded)
    got = suffixes.dedup_spans(docs(rows), length=40, gram=8, shard_bytes=shard, spill_bytes=64).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got), key=repr) == slow(rows, 40)


def test_what_windows_share_by_chance_is_not_sorted(docs, monkeypatch):
    """Documents that share less than a core send nothing to a shard; near copies send what is
    beside their cores."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    phrase, near = text(24), text(200)
    rows = [(i, text(60) + phrase + text(60)) for i in range(80)]
    rows += [(100, near), (101, near[:90] + "zzzz" + near[94:])]
    sort = suffixes._sort_shards

    def bounded(length, spill_bytes):
        inner = sort(length, spill_bytes)

        def run(batches):
            batches = list(batches)
            assert sum(len(x) for batch in batches for x in batch.column("data").to_pylist()) <= 2 * 200
            yield from inner(iter(batches))

        return run

    monkeypatch.setattr(suffixes, "_sort_shards", bounded)
    got = suffixes.dedup_spans(docs(rows), length=40, gram=8).collect()
    assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got), key=repr) == slow(rows, 40)
    assert sum(x.n_removed for x in got) == 2 * 196
    assert sum(x.n_spans for x in got) == 4


@pytest.mark.parametrize("seed, length, gram", [(11, 40, 32), (12, 32, 32), (13, 33, 1), (14, 41, 16), (15, 2, 2)])
def test_classes_of_any_length(docs, seed, length, gram):
    rows = rows_of(seed)
    for shard in (1 << 20, 60):
        got = suffixes.dedup_spans(docs(rows), length=length, gram=gram, shard_bytes=shard, spill_bytes=64).collect()
        assert sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, bytes(x.kept)) for x in got), key=repr) == slow(rows, length)
