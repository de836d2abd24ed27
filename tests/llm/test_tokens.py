import random
import re

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardloom.llm import tokens

PATH = P.path("byte_bpe_50k.tiktoken")


def slow(text, rule):
    """Byte by byte: (start, end, n_tokens) of each line."""
    encoder, length = tokens.encoding(PATH, P.PATTERN)
    data = (text or "").encode()
    owner = []
    for i, t in enumerate(encoder.encode_ordinary(text) if text else []):
        owner += [i] * len(encoder.decode_single_token_bytes(t))
    assert len(owner) == len(data)
    line, of = 0, []
    for b in data:
        of.append(line)
        line += b == 10
    n = max(of, default=0) + 1
    counts = [0.0] * n
    for i in range(max(owner, default=-1) + 1):
        lines = [of[j] for j in range(len(data)) if owner[j] == i]
        if rule == "first":
            counts[lines[0]] += 1
        elif rule == "largest":
            counts[max(sorted(set(lines)), key=lines.count)] += 1
        else:
            for x in lines:
                counts[x] += 1 / len(lines)
    parts = re.findall("[^\n]*\n|[^\n]+", text or "") or [""]
    return counts, parts


@pytest.mark.parametrize("rule", tokens.RULES)
def test_against_bytes(docs, rule):
    r = random.Random(8)
    rows = [(i, "".join(r.choice(["\n", "\n\n\n", " ", "the", "é", "漢字", "🙂", "x1", "  ", "don't"]) for _ in range(r.randint(0, 30)))) for i in range(50)]
    rows += [(100, None), (101, ""), (102, "\n"), (None, "a\nb")]
    found = {}
    for x in tokens.count_tokens(docs(rows), PATH, P.PATTERN, rule).collect():
        found.setdefault(x.doc_id, []).append(x)
    for d, t in rows:
        got = sorted(found[d], key=lambda x: x.section)
        counts, parts = slow(t, rule)
        assert np.allclose([x.n_tokens for x in got], counts)
        assert [(t or "")[x.start : x.end] for x in got] == parts


def test_fields_and_empty(docs):
    frame = docs([(1, "a b", "c d e")])
    got = tokens.count_tokens(frame, PATH, P.PATTERN, fields={"body": "text", "from": "source", "none": "lang"}).collect()
    assert {(x.field, x.n_tokens) for x in got} == {("body", 2.0), ("from", 3.0), ("none", 0.0)}
    assert tokens.count_tokens(docs([]), PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(frame, PATH, P.PATTERN, "last")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=30), st.data())
def test_every_token_is_given_once(lengths, data):
    total = sum(lengths)
    cuts = sorted(data.draw(st.sets(st.integers(1, total), max_size=8)) | {total})
    for rule in tokens.RULES:
        counts, _ = tokens.attribute(np.cumsum(lengths), np.array(cuts), rule)
        assert counts.sum() == pytest.approx(len(lengths))
