import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from shardloom.llm import simhash


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    fp = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 3:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{fp[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def rows_of(seed=1):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeXYé") for _ in range(r.randint(1, 5)))
    rows = []
    for i in range(60):
        words = [word() for _ in range(r.choice([0, 1, 2, 3, 40, 200]))]
        rows.append((len(rows), " \t\n"[i % 3].join(words)))
        for _ in range(i % 4):
            copy = list(words)
            if copy:
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (1000, None), (1001, ""), (1002, " "), (None, "a b c"), (3, rows[3][1])]


def test_against_brute_force(docs):
    rows = rows_of()
    got = simhash.near_duplicates(docs(rows), block=4).collect()
    assert sorted((tuple(r) for r in got), key=repr) == slow_components(rows)


def test_links_find_all_planted_distances(spark):
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 150, dtype=np.uint64)
    values = set(base.tolist())
    for x in base.tolist():
        for n in (1, 2, 3, 4):
            for k in r.choice(64, n, replace=False):
                x ^= 1 << int(k)
            values.add(x)
    values = np.array(sorted(values), dtype=np.uint64)
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    from shardloom.llm.components import connected_components

    got = {r.node: r.root for r in connected_components(simhash.links(frame, block=8)).collect()}
    root = {int(v): int(v) for v in values.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3):
            a, b = find(int(values.view(np.int64)[i])), find(int(values.view(np.int64)[j]))
            root[max(a, b)] = min(a, b)
    for v in values.view(np.int64).tolist():
        assert got.get(v, v) == find(v)


def test_empty_table_and_clashing_columns(docs):
    assert simhash.near_duplicates(docs([])).count() == 0
    frame = docs([(1, "a b c d"), (2, "a b c d")]).withColumn("fp", F.lit("x")).withColumn("root", F.lit(1))
    assert {r.component_id for r in simhash.near_duplicates(frame).collect()} == {1}


def test_near_copies_of_high_similarity(docs):
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    rows, groups = [], []
    for g in range(60):
        words = [word() for _ in range(r.choice([150, 400]))]
        own = []
        for _ in range(3):
            copy = list(words)
            for _ in range(len(copy) // 100):
                copy[r.randrange(len(copy))] = word()
            own.append(len(rows))
            rows.append((len(rows), " ".join(copy)))
        groups.append(own)
    rows += [(1000, None), (1001, ""), (1002, rows[0][1]), (0, rows[0][1]), (None, rows[3][1])]
    got = {}
    for x in simhash.near_copies(docs(rows), block=8).collect():
        got.setdefault(x.doc_id, set()).add(x.component_id)
    caught = sum(got[d] == {own[0]} for own in groups for d in own)
    assert caught >= 0.95 * 180
    assert got[1000] == got[1001] == {1000} and got[1002] == got[0] == {0} and got[None] == {3}
    assert all(got[d] <= set(own) for own in groups for d in own)
    assert simhash.near_copies(docs([])).count() == 0


def passages(r, words, similarity, kind):
    """A copy of ``words`` that differs in one passage, of about that similarity of shingles."""
    n, word = len(words), lambda: f"w{r.randrange(10**6)}"
    if kind == "appended":
        return [*words, *(word() for _ in range(int((n - 4) / similarity - (n - 4))))]
    size = int((n - 4) * (1 - similarity)) if kind == "removed" else int((n - 4) * (1 - similarity) / (1 + similarity)) - 4
    at = r.randrange(1, n - size)
    return [*words[:at], *(word() for _ in range(size if kind == "replaced" else 0)), *words[at + size :]]


def test_near_copies_with_other_passages_against_all_pairs(docs):
    r = random.Random(21)
    rows = []
    for similarity in (0.7, 0.76, 0.81, 0.85, 0.9, 0.95):
        for kind in ("appended", "removed", "replaced"):
            for _ in range(12):
                words = [f"w{r.randrange(10**6)}" for _ in range(300)]
                rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(passages(r, words, similarity, kind)))]
    # one fingerprint, hardly a shingle in common
    rows += [(len(rows), "a " * 500), (len(rows) + 1, "a " * 500 + "b c d e f g h")]
    got = {x.doc_id: x.component_id for x in simhash.near_copies(docs(rows), block=16).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for _, t in rows)]
    near = [i for i in range(0, len(rows), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert 140 > len(near) > 130
    linked = [i for i in range(0, len(rows), 2) if got[i] == got[i + 1]]
    assert set(linked) <= set(near) and len(linked) >= 0.97 * len(near)
    assert all(got[i] == i for i in range(0, len(rows), 2))


def test_large_groups_against_all_pairs(docs, monkeypatch):
    """Groups of more texts than a block: most near a pivot, some only near some of those."""
    r = random.Random(33)
    word = lambda: f"w{r.randrange(10**6)}"
    rows = []
    for _ in range(3):
        base = [word() for _ in range(150)]
        for _ in range(40):
            copy = list(base)
            for _ in range(r.randrange(5)):
                copy[r.randrange(len(copy))] = word()
            if r.random() < 0.3:  # drifts away, step by step
                copy = [word() for _ in range(r.choice([6, 10, 14, 20]))] + copy[10:]
            rows.append((len(rows), " ".join(copy)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    root = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    assert len(set(root)) > 6
    for block, sent in ((4, 0), (16, 1000)):
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", sent)
        assert {x.doc_id: x.component_id for x in simhash.near_copies(docs(rows), block=block).collect()} == dict(enumerate(root))


def test_pairs_of_each_similarity_become_candidates():
    """The share of pairs that have a cell in common and few differing bits: measured on sets of
    300 shingles at 0.8 and above, and of pairs that share a passage only."""
    r = np.random.default_rng(7)
    found, limit = simhash.tables(250_000), int(simhash.MEET_SHARE * 64 * simhash.CHECKED)
    for similarity, least, most in ((0.8, 0.97, 1), (0.85, 0.99, 1), (0.9, 0.995, 1), (0.2, 0, 0.01)):
        hits, n, common = 0, 400, int(300 * 2 * similarity / (1 + similarity))
        for _ in range(n):
            shared, a, b = (r.integers(0, 2**63, k).astype(np.uint64) for k in (common, 300 - common, 300 - common))
            x, y = np.r_[shared, a], np.r_[shared, b]
            fx, fy = simhash._majority(x, simhash.MEET_FAMILIES), simhash._majority(y, simhash.MEET_FAMILIES)
            mx, my = simhash.least_hashes(x), simhash.least_hashes(y)
            near = np.bitwise_count(fx ^ fy)[: simhash.CHECKED].sum() <= limit
            hits += near and any(mx[i] == my[i] and mx[j] == my[j] and not int(fx[f] ^ fy[f]) & m & 2**64 - 1 for i, j, f, m in found)
        assert least <= hits / n <= most, similarity


def test_more_texts_have_larger_cells_and_more_tables():
    for n in (10, 10**6, 10**9, 10**11):
        found = simhash.tables(n)
        bits = {(t[3] & (1 << 64) - 1).bit_count() for t in found}
        assert len(bits) == 1 and n / 2 ** min(bits) <= 2**15
        assert 1 - (1 - simhash.SIMILARITY**2 * simhash.AGREE ** min(bits)) ** len(found) >= simhash.RECALL


def test_similar_sets_against_all_pairs():
    r = random.Random(4)
    sets = []
    for _ in range(40):
        own = r.sample(range(10_000), r.choice([0, 1, 5, 40]))
        sets += [np.array(sorted({*own[r.randrange(3) :], *r.sample(range(10_000), r.randrange(4))}), dtype=np.uint64) for _ in range(4)]

    def roots(links):
        root = list(range(len(sets)))
        for i, j in links:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    close = lambda x, y: 10 * len(x & y) >= 8 * len(x | y)
    plain = [set(x.tolist()) for x in sets]
    assert roots(zip(*simhash.similar(sets))) == roots((i, j) for i, j in combinations(range(len(sets)), 2) if close(plain[i], plain[j]))
