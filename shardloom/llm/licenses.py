"""License scans by diagonal voting.

Templates are word sequences. Hashes of all runs of ``k`` words of a document are met with
the positions of the same runs in the templates; a run at document word i and template
word j votes for the diagonal i - j of that template. A phrase is a short template that has
to stand word for word: all runs on one diagonal.

Longer templates may differ, and a changed word takes the votes of all its runs. So each
voted diagonal is a place to look at: the template is aligned with the words there (words
may be changed, put in or left out), and the span that reaches ``threshold`` counts. Runs
are short enough that one is left wherever so few words differ.

Templates are few and given by the caller, so documents drop hashes that no template has
before Spark joins the rest with the template positions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_column, materialise, own, text_batches
from .words import grams, hashed_words, normal

#: The base phrases and their labels (fixed values).
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Sentences by which licenses are known, and their labels.
TEMPLATES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
)
THRESHOLD = 0.8
#: Words before and after a voted diagonal in which its span may lie, at least.
GAP = 4
#: Templates of fewer words have runs of two words; others of four, or less where the words
#: that may differ could break them all.
LONG = 8
MOST_TEMPLATE_RUNS = 1_000_000


_SLICES = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.string())]))


def align(template: list[str], words: list[str], threshold: float) -> tuple[int, int, float] | None:
    """(first, end, score) of the best span of ``words``: score is the number of template words
    matched in order, over those of the template and the words put in. None below ``threshold``."""
    least = threshold * len(template) - 1e-9
    have, want = Counter(words), Counter(template)
    if sum(min(n, have[w]) for w, n in want.items()) < least:
        return None
    # value (matched less threshold * put in), matched, put in, first (negated), all up to a word
    best = (-1.0, 0, 0, 0, 0)
    before = [(0.0, 0, 0, 1)] * (len(template) + 1)
    for j, word in enumerate(words):
        now = [(0.0, 0, 0, 1)]
        for i, t in enumerate(template):
            value, matched, extra, first = before[i]
            at = max((value, matched, extra, first), now[i])
            if t == word:
                at = max(at, (value + 1, matched + 1, extra, -j if first > 0 else first))
                if at[1] == matched + 1 and at[0] > best[0]:
                    best = (*at, j + 1)
            value, matched, extra, first = before[i + 1]
            if matched:
                at = max(at, (value - threshold, matched, extra + 1, first))
            now.append(at)
        before = now
    value, matched, extra, first, end = best
    return (-first, end, matched / (len(template) + extra)) if value >= least else None


def _spans(templates: list[list[str]], threshold: float, gap: int):
    def found(slices: list[dict], asked: list[dict]) -> list[dict]:
        parts, out = [(x["at"], x["words"].split()) for x in slices], []
        for ask in asked:
            template, spans = templates[ask["template"]], []
            reach = max(gap, len(template) // 4 + 1)
            for diagonal in sorted(ask["diagonals"]):
                for at, words in parts:
                    low = max(0, diagonal - reach - at)
                    window = words[low : max(0, diagonal + len(template) + reach - at)]
                    one = align(template, window, threshold)
                    if one:
                        spans.append((-one[2], at + low + one[0], at + low + one[1]))
            taken: list[tuple] = []
            for score, first, end in sorted(set(spans)):
                if all(end <= a or b <= first for a, b in taken):
                    taken.append((first, end))
                    out.append({"first": first, "end": end, "label": ask["label"], "score": -score})
        return sorted(out, key=lambda x: tuple(x.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("score", pa.float64())]))
        for batch in batches:
            spans = [found(x, y) for x, y in zip(batch.column("slices").to_pylist(), batch.column("asked").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, kind)], ["row", "spans"])

    return run


def _runs(texts: list[bytes], ks: list[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each k: the text, first word and hash of each run of k words."""
    words, counts, _ = hashed_words(texts)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    out = []
    for k in ks:
        hashes = grams(words, k)
        at = np.flatnonzero(np.arange(len(hashes)) + k <= ends[owner[: len(hashes)]])
        out.append((owner[at], at - (ends - counts)[owner[at]], hashes[at] ^ np.uint64(k)))
    return out


def _slices(words: list[bytes], at: list[int], reach: int) -> list[dict]:
    """The words within ``reach`` of the places ``at``, with the number of the first."""
    out: list[list[int]] = []
    for i in sorted(at):
        if out and i - reach <= out[-1][1]:
            out[-1][1] = i + reach
        else:
            out.append([max(0, i - reach), i + reach])
    return [{"at": a, "words": b" ".join(words[a:b]).decode()} for a, b in out]


def _scan(known: np.ndarray, ks: list[int], loose: set[int], reach: int):
    bits = np.zeros(1 << 20, dtype=bool)
    bits[(known >> np.uint64(44)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole):
                texts = [normal(t) for t in binary_column(batch, "text")]
                n_words = [len(t.split()) for t in texts]
                hits: list[list[dict]] = [[] for _ in texts]
                places: list[list[int]] = [[] for _ in texts]
                for k, (owner, at, hashes) in zip(ks, _runs(texts, ks)):
                    near = np.flatnonzero(bits[(hashes >> np.uint64(44)).astype(np.int64)])
                    near = near[np.isin(hashes[near], known)] if len(near) else near
                    last, words = -1, []
                    for o, i, h in zip(owner[near].tolist(), at[near].tolist(), hashes[near].view(np.int64).tolist()):
                        if o != last:
                            last, words = o, texts[o].split()
                        hits[o].append({"h": h, "at": i, "run": b" ".join(words[i : i + k]).decode()})
                        if h in loose:
                            places[o].append(i)
                slices = [_slices(t.split(), at, reach) if at else [] for t, at in zip(texts, places)]
                kind = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int32()), ("run", pa.string())]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(hits, kind), pa.array(slices, _SLICES)], ["doc_id", "n_words", "hits", "slices"])

    return run


def template_runs(templates, threshold: float = THRESHOLD) -> list[tuple]:
    """(h, run, template, label, exact, runs, t_at, k) of each run of each (text, label, exact)."""
    out = []
    for number, (text, label, exact) in enumerate(templates):
        words = normal(text.encode()).split()
        if not words:
            continue
        differ = int((1 - threshold) * len(words) + 1e-9)
        k = min(2 if len(words) < LONG else max(2, min(4, len(words) // (differ + 1))), len(words))
        [(_, at, hashes)] = _runs([b" ".join(words)], [k])
        for i, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
            out.append((h, b" ".join(words[i : i + k]).decode(), number, label, exact, len(at), i, k))
    return out


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, gap: int = GAP) -> DataFrame:
    """(row, doc_id, n_words, places, spans) for each row of ``docs`` (doc_id, text).

    places: (label, first) of each place where a phrase's words stand one after the other;
    spans: (label, first, end, score) of each span of a template that reaches
    ``threshold``, in words counted from 0; for score see ``align``. Null and
    empty texts have no words. Rows of equal doc_id each get a row, told apart by ``row``. Of
    spans of one label that overlap the best stays, of equal ones the first. Texts count as a
    whole, however long. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    all_templates = [(t, label, True) for t, label in phrases] + [(t, label, False) for t, label in templates]
    rows = template_runs(all_templates, threshold)
    if len(rows) > MOST_TEMPLATE_RUNS:
        raise ValueError(f"templates have {len(rows)} runs; at most {MOST_TEMPLATE_RUNS} are sent to all executors")
    ks = sorted({r[-1] for r in rows})
    known = np.unique(np.array([r[0] for r in rows], dtype=np.int64).view(np.uint64))
    schema = "doc_id long, n_words long, hits array<struct<h: bigint, at: int, run: string>>, slices array<struct<at: int, words: string>>"
    words = [normal(t.encode()).decode().split() for t, _, _ in all_templates]
    reach = 2 * max(map(len, words), default=0) + gap
    loose = {r[0] for r in rows if not r[4]}
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(own("licenses", _scan(known, ks, loose, reach)), schema)
    found = materialise(found.withColumn("row", F.monotonically_increasing_id()), "license-hits")
    table = spark.createDataFrame(rows, "h long, t_run string, template int, label string, exact boolean, runs int, t_at int, k int")
    hits = found.where(F.size("hits") > 0).select("row", F.explode("hits").alias("hit")).select("row", "hit.h", "hit.at", "hit.run")
    votes = hits.join(F.broadcast(table), "h").where("run = t_run").withColumn("diagonal", F.col("at") - F.col("t_at"))
    key = ("row", "template", "label", "exact", "runs")
    lines = votes.where("exact").groupBy(*key, "diagonal").agg(F.collect_set("t_at").alias("seen"), F.min("at").alias("first"))
    lines = lines.where(F.size("seen") == F.col("runs"))
    places = lines.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("first").cast("long").alias("first"), "label"))).alias("places"))
    asked = votes.where("NOT exact").groupBy("row", "template", "label").agg(F.collect_set("diagonal").alias("diagonals"))
    asked = asked.groupBy("row").agg(F.collect_list(F.struct("template", "label", "diagonals")).alias("asked"))
    kind = "row long, spans array<struct<first: bigint, end: bigint, label: string, score: double>>"
    spans = found.select("row", "slices").join(asked, "row").mapInArrow(own("licenses", _spans(words, threshold, gap)), kind)
    out = found.select("row", "doc_id", "n_words").join(places, "row", "left").join(spans, "row", "left")
    none = F.array()
    return out.select(
        "row", "doc_id", "n_words",
        F.coalesce("places", none.cast("array<struct<first: bigint, label: string>>")).alias("places"),
        F.coalesce("spans", none.cast("array<struct<first: bigint, end: bigint, label: string, score: double>>")).alias("spans"),
    )


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of a scan."""
    at = F.transform("places", lambda p: p["first"])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"])))
    more = F.array_sort(F.array_distinct(F.concat(base, F.transform("spans", lambda p: p["label"]))))
    best = F.array_max(F.transform("spans", lambda p: p["score"]))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(more, ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
