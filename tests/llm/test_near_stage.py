"""The near-dedup stage of the pipeline against all pairs."""

import random

import corpus_pipeline as cp

from .test_simhash import passages


def near_stage(rows):
    """What the stage keeps, by the Jaccard similarity of all pairs of rows of distinct (id, text)."""
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    kept = {}
    for at, row in enumerate(rows):
        kept[root[at]] = min(row, kept.get(root[at], row), key=lambda r: r[0])
    return sorted(kept.values())


def texts(seed, n, length=200):
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(10**6)}" for _ in range(length)) for _ in range(n)]


def test_passages_against_all_pairs(spark, docs):
    r = random.Random(8)
    rows = []
    for text in texts(8, 30):
        rows.append((len(rows), text))
        for similarity in (0.75, 0.84, 0.9):
            rows.append((len(rows), " ".join(passages(r, text.split(), similarity, r.choice(["appended", "removed", "replaced"])))))
    got = cp.near_dedup(spark, docs(rows), "").collect()
    assert sorted((x.doc_id, x.text) for x in got) == near_stage(rows)


def test_repeated_ids_with_different_texts(spark, docs):
    a, b, c, d = texts(9, 4)
    rows = [(1, c), (1, d), (5, a), (5, b), (2, b + " more"), (7, a + " more"), (7, a)]
    frame = docs(rows)
    got = sorted((x.doc_id, x.text) for x in cp.near_dedup(spark, frame.unionAll(frame), "").collect())
    assert got == sorted([(1, c), (1, d), (5, a), (2, b + " more")])
