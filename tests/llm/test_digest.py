import hashlib
import random
import re
import unicodedata

from pyspark.sql import functions as F

from shardloom.llm import digest


def form(text):
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return re.sub("[ \t\n\x0b\f\r\x85   ]+", " ", text).strip(" ")


def rows_of():
    r = random.Random(6)
    texts = ["".join(r.choice("aB \t\nÅÅﬁ　é́ßΣ漢🙂 ") for _ in range(r.randint(0, 12))) for _ in range(60)]
    rows = [(i * 3 - 20, r.choice(texts)) for i in range(150)]
    return [*rows, (10_000, None), (10_001, ""), (10_002, "HELLO  World"), (10_003, " hello world\n"), (-20, "zz"), (-20, "zz")]


def test_against_brute_force(docs):
    rows = sorted(rows_of(), key=lambda x: (x[0], x[1] or ""))
    got = digest.fingerprints(docs(rows).withColumn("k", F.lit("x")), range_rows=7).collect()
    got.sort(key=lambda x: x.doc_id)
    assert len(got) == len(rows)
    count = {}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        same = [x for x, y in rows if form(y or "") == form(t)]
        want = (d, len(t), hashlib.sha256(edited.encode()).hexdigest(), float(form(edited) == form(t)), float(form(nxt) == form(t)), min(same), len(same))
        count[want] = count.get(want, 0) + 1
    for g in got:
        have = (g.doc_id, g.n_chars, g.edited_sha256, g.near_edited, g.near_next, g.class_id, g.n_copies)
        count[have] = count.get(have, 0) - 1
    assert not any(count.values())
    prints = {}
    for g, (_, t) in zip(got, rows):
        if g.doc_id != -20:
            assert prints.setdefault(g.fingerprint, form(t or "")) == form(t or "")


def test_small_tables(docs):
    assert digest.fingerprints(docs([])).count() == 0
    one = digest.fingerprints(docs([(None, "ab")])).first()
    assert (one.doc_id, one.near_next, one.edited_sha256) == (None, 1.0, hashlib.sha256(b"aa").hexdigest())


def test_no_python_in_the_plan(docs):
    plan = digest.fingerprints(docs([(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
