import math
import random

import numpy as np
import pytest

from shardloom.llm import langid

WORDS = {"xx": "tha ing ere ous and", "yy": "que ció los ñas del", "zz": "sch ung ich über der"}


def text(r, lang, n):
    return " ".join("".join(r.choice(WORDS[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(n))


def data(n=240):
    r = random.Random(11)
    return [(i, text(r, lang := r.choice(list(WORDS)), r.randint(20, 60)), "s", lang) for i in range(n)]


def test_held_out_accuracy_and_undefined(docs):
    rows = [*data(), (900, None, "s", "xx"), (901, "123 ...", "s", "yy"), (902, "", "s", None), (None, "tha ing", "s", None), (903, "漢", "s", None)]
    frame = docs(rows)
    got = {r.doc_id: r for r in langid.identify(frame, langid.fold_model(frame)).collect()}
    assert all(got[d].lang_pred == lang and 0.5 < got[d].score <= 1 for d, _, _, lang in data())
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[900].score == 0.0
    assert got[None].lang_pred == "xx" and got[903].lang_pred in WORDS


def test_mixtures(docs):
    r = random.Random(1)
    model = langid.fold_model(docs(data()))
    mixed = text(r, "xx", 120) + " " + text(r, "yy", 60)
    row = langid.identify(docs([(1, mixed), (2, text(r, "zz", 200))]), model).orderBy("doc_id").collect()
    assert set(row[0].lang_shares) == {"xx", "yy"} and row[0].lang_pred == "xx" and 0.5 < row[0].score < 0.85
    assert set(row[1].lang_shares) == {"zz"} and row[1].score == 1.0


def test_em_raises_the_likelihood_as_brute_force():
    r = np.random.default_rng(0)
    model = langid.Model(["a", "b", "c"], np.log(r.dirichlet(np.ones(langid.CELLS), 3).T).astype(np.float32))
    texts = [b"abc def ghi" * 20, b"zzz", b"q w e r t y" * 9]
    like, n = model.units(texts)
    at = 0
    for t, k in zip(texts, n):
        cells = langid._cells(np.frombuffer(langid._shaped(t), np.uint8))
        want = [model.logp[cells[i : i + langid.UNIT]].sum(axis=0) for i in range(0, len(cells), langid.UNIT)]
        assert np.allclose(like[at : at + k], want, atol=1e-2)
        at += k


def plain_prediction(model, text):
    """Mixture inference of one text by loops: the same units, EM rounds and penalty."""
    cells = langid._cells(np.frombuffer(langid._shaped(text), np.uint8))
    units = [model.logp[cells[i : i + langid.UNIT]].astype(float).sum(axis=0) for i in range(0, max(1, len(cells)), langid.UNIT)]
    k = len(model.langs)

    def fit(chosen):
        share = {j: 1 / len(chosen) for j in chosen}
        for _ in range(langid.ROUNDS):
            total = dict.fromkeys(chosen, 0.0)
            for u in units:
                p = {j: math.exp(u[j] - max(u)) * share[j] for j in chosen}
                for j in chosen:
                    total[j] += p[j] / sum(p.values()) if sum(p.values()) else 0.0
            share = {j: total[j] / len(units) for j in chosen}
        like = sum(max(u) + math.log(sum(math.exp(u[j] - max(u)) * share[j] for j in chosen) + 1e-300) for u in units)
        return share, like

    full, _ = fit(range(k))
    order = sorted(range(k), key=lambda j: (-full[j], j))
    best, value = None, -math.inf
    for size in range(1, k + 1):
        share, like = fit(order[:size])
        like -= langid.PENALTY * size * math.log(len(units) + 1.0) / 2
        if like <= value:
            break
        best, value = share, like
    lead = min(best, key=lambda j: (-best[j], j))
    return lead, best[lead], {j for j in best if best[j] > 1e-3}


def test_shares_and_sets_against_plain_inference():
    """Texts of one to five languages: the set, the shares and the score."""
    r, n = np.random.default_rng(5), 5
    logp = np.log(r.dirichlet(np.full(langid.CELLS, 0.02), n).T + 1e-9).astype(np.float32)
    model = langid.Model([f"l{i}" for i in range(n)], logp)
    likely = [np.argsort(-logp[:, j])[:40] for j in range(n)]
    grams = {}
    for x in range(97, 123):
        for y in range(97, 123):
            for z in range(97, 123):
                grams.setdefault(int(langid._cells(np.array([x, y, z], np.uint8))[0]), bytes([x, y, z]))
    letters = [[grams[int(c)] for c in cells if int(c) in grams] for cells in likely]
    texts = []
    for count in (1, 2, 3, 4, 5, 5):
        parts = [b"".join(letters[j][int(i)] for i in r.integers(0, len(letters[j]), 160)) for j in range(count)]
        texts.append(b" ".join(parts))
    texts += [b"abc", b"a", b"zzzz yyyy " * 300]
    lead, score, best = model.predict(texts)
    sizes = []
    for t, a, s, row in zip(texts, lead, score, best):
        want = plain_prediction(model, t)
        assert a == want[0] and abs(s - want[1]) < 1e-3 and set(np.flatnonzero(row > 1e-3).tolist()) == want[2]
        sizes.append(len(want[2]))
    assert max(sizes) > 3


def test_more_languages_than_a_model_may_have(docs, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.fold_model(docs(data(40)))


def test_no_training_rows(docs):
    frame = docs([(1, "tha"), (2, None)])
    assert {r.lang_pred for r in langid.identify(frame, langid.fold_model(frame)).collect()} == {"und"}
    assert langid.identify(docs([]), langid.fold_model(docs([]))).count() == 0
