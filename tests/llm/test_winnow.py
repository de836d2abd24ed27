import random
import re

import pytest

from shardloom.llm import winnow

WORD = re.compile(b"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def slow(rows, bench):
    out = []
    items = [(i, words(t)) for i, t in bench if i is not None and words(t)]
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, x in items:
            m = min(10, len(x))
            windows = {tuple(x[j : j + m]) for j in range(len(x) - m + 1)}
            for j in range(len(w) - m + 1):
                if tuple(w[j : j + m]) in windows:
                    hit |= set(range(j, j + m))
                    found.add(str(i))
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def data():
    r = random.Random(9)
    vocabulary = ["a", "b", "Cé", "d1", "e", "漢", "x\u00a0y\u3000"]
    phrase = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    bench = [(i, phrase(r.choice([1, 4, 6, 9, 10, 11, 14, 30]))) for i in range(25)]
    bench = [b for b in bench if len(b[1].split()) > 3] + [(100, None), (101, "..."), (None, "a b"), (7, phrase(12)), (102, bench[0][1])]
    rows = []
    for i in range(90):
        parts = [phrase(r.choice([0, 3, 20, 80]))]
        for _ in range(r.choice([0, 1, 2])):
            x = (r.choice(bench)[1] or "").split(" ")
            a = r.randrange(len(x))
            parts += ["-,".join(x[a : a + r.randint(5, 30)]), phrase(3)]
        rows.append((i, "; ".join(parts).upper() if i % 5 == 0 else " ".join(parts)))
    return [*rows, (200, None), (201, ""), (None, rows[3][1]), (4, rows[4][1])], bench


@pytest.mark.parametrize("bound", [1 << 20, 0])
def test_against_brute_force(spark, docs, bound):
    rows, bench = data()
    frame = spark.createDataFrame(bench, "item_id long, text string")
    got = winnow.decontaminate(docs(rows), frame, broadcast_rows=bound).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == slow(rows, bench)
    for r in got:
        assert r.contaminated == (r.n_hit > 0) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.decontaminate(docs([]), none).count() == 0
    row = winnow.decontaminate(docs([(1, "a b")]), none).first()
    assert (row.n_words, row.n_hit, row["items"]) == (2, 0, [])


def test_a_phrase_that_repeats_sends_its_text_once(spark, docs, monkeypatch):
    """Thousands of shifts, one row: the text of a document is not copied for each."""
    extend = winnow._extend

    def counted(window):
        inner = extend(window)

        def run(batches):
            batches = list(batches)
            assert sum(b.num_rows for b in batches) <= 3
            yield from inner(iter(batches))

        return run

    monkeypatch.setattr(winnow, "_extend", counted)
    bench = [(1, "a a a a a a a a a a a a"), (2, "b a a a a a a a a a a"), (3, "a b " * 8)]
    rows = [(1, "a " * 3000), (2, "a b " * 1500), (3, "b " + "a " * 12 + "c")]
    got = winnow.decontaminate(docs(rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=repr) == slow(rows, bench)
