import random
import re

from pyspark.sql import functions as F

from shardloom.llm import licenses

WORD = re.compile(b"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base(text):
    words = WORD.findall((text or "").encode().lower())
    at, labels = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.encode().split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places_against_brute_force(docs):
    r = random.Random(3)
    pieces = ["gnu general public license", "GNU General,\nPublic", "license", "apache", "Apache-License", "cc", "by", "cc by cc by", "MIT License.", "é", "x1", "mit"]
    rows = [(i, " ".join(r.choice(pieces) for _ in range(r.choice([0, 2, 9, 40])))) for i in range(120)]
    rows += [(500, None), (501, ""), (None, "mit license"), (7, rows[7][1]), (502, "word " * 30_000 + "cc by")]
    got = licenses.summary(licenses.scan(docs(rows).withColumn("h", F.lit(1)))).collect()
    have = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got), key=repr)
    assert have == sorted(((d, *base(t)) for d, t in rows), key=repr)
    for row in got:
        assert set(row.base_labels.split(",")) <= {*row.labels.split(","), ""} and 0 <= row.score <= 1


def test_templates_with_changed_words(docs):
    mit = licenses.TEMPLATES[0][0].split()
    changed = mit[:9] + ["new"] + mit[9:]
    half = mit[:9]
    filler = ("lorem ipsum " * 40).split()
    rows = [(1, " ".join(filler + changed + filler)), (2, " ".join(half + filler)), (3, "Copyright. All rights reserved."), (4, "of this software " * 50)]
    got = {r.doc_id: r for r in licenses.scan(docs(rows)).collect()}
    [span] = got[1].spans
    assert (span.label, span.first) == ("mit", 80) and span.end == 101 and 0.8 <= span.score < 1
    assert got[2].spans == [] and got[4].spans == []
    assert [(s.label, s.first, s.end, s.score) for s in got[3].spans] == [("all-rights-reserved", 1, 4, 1.0)]


def test_empty(docs):
    assert licenses.scan(docs([])).count() == 0


def test_a_changed_dropped_or_new_word_at_every_place(docs):
    rows, want = [], {}
    for text, label in licenses.TEMPLATES:
        words = text.split()
        if len(words) < licenses.LONG:
            continue
        for i in range(len(words)):
            two = [w if j not in (i, (i + 4) % len(words)) else "new" for j, w in enumerate(words)]
            for changed in ([*words[:i], "new", *words[i + 1 :]], [*words[:i], *words[i + 1 :]], [*words[:i], "new", *words[i:]], two):
                want[len(rows)] = label
                rows.append((len(rows), " ".join(["lorem", "ipsum"] * 9 + changed + ["dolor"] * 9)))
        many = [w if j % 3 else "new" for j, w in enumerate(words)]
        want[len(rows)] = None
        rows.append((len(rows), " ".join(many)))
    got = {r.doc_id: {s.label for s in r.spans if s.score >= 0.8 and 0 <= s.first < s.end} for r in licenses.scan(docs(rows)).collect()}
    assert [d for d, label in want.items() if (label in got[d] if label else not got[d]) is False] == []
