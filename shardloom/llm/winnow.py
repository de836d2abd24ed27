"""Benchmark decontamination by winnowing.

Of the hashes of all runs of K words, the smallest in each window of W consecutive ones is
kept (all of equal smallest ones), for training documents and benchmark items alike. With
K + W - 1 = 10, two texts that share 10 words share a kept fingerprint. Items of fewer than
10 words are one window each and have the hash of all their words; documents are probed
for each such length that occurs. Spark joins the fingerprints, and each pair of an item
and an offset is then extended by comparing the words themselves along the offset.

Where the benchmark's fingerprints are few (``broadcast_rows``), documents drop those of
theirs that are not among them before the join; else all are joined by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_column, materialise, own, text_batches
from .words import grams, hashed_words, normal

WINDOW = 10
K = 4
#: Fingerprints of the benchmark that are sent to all executors, at most (8 bytes each).
BROADCAST_ROWS = 2_000_000


def selected(words: np.ndarray, counts: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the winnowed runs of ``k`` words of texts with ``counts``
    words each; texts of fewer than ``window`` words may have none."""
    w = window - k + 1
    hashes = grams(words, k)
    if not len(hashes):
        return np.zeros(0, dtype=np.int64), hashes
    least = np.concatenate([np.full(w - 1, 2**64 - 1, dtype=np.uint64), hashes, np.full(w - 1, 2**64 - 1, dtype=np.uint64)])
    least = np.lib.stride_tricks.sliding_window_view(least, w).min(axis=1)  # one for each window, cut ones at the ends too
    most = np.lib.stride_tricks.sliding_window_view(least, w).max(axis=1)  # of the windows that hold a run
    ends = np.cumsum(counts)
    inside = np.arange(len(hashes)) + k <= np.repeat(ends, counts)[: len(hashes)]
    at = np.flatnonzero((hashes == most) & inside)
    return at, hashes[at]


def _fingerprints(words: np.ndarray, counts: np.ndarray, lengths: list[int], k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    at, hashes = selected(words, counts, k, window)
    ends = np.repeat(np.cumsum(counts), counts)
    places, found = [at], [hashes]
    for m in lengths:
        short = grams(words, m)
        own = np.flatnonzero(np.arange(len(short)) + m <= ends[: len(short)])
        places.append(own)
        found.append(short[own] ^ np.uint64(m))
    return np.concatenate(places), np.concatenate(found)


def _documents(known: np.ndarray | None, lengths: list[int], k: int, window: int):
    if known is not None:
        bits = np.zeros(1 << 22, dtype=bool)
        bits[(known >> np.uint64(42)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole):
                texts = [normal(t) for t in binary_column(batch, "text")]
                words, counts, _ = hashed_words(texts)
                at, hashes = _fingerprints(words, counts, lengths, k, window)
                if known is not None:
                    near = np.flatnonzero(bits[(hashes >> np.uint64(42)).astype(np.int64)])
                    near = near[np.isin(hashes[near], known)] if len(near) else near
                    at, hashes = at[near], hashes[near]
                order = np.argsort(at, kind="stable")
                at, hashes = at[order], hashes[order]
                ends = np.cumsum(counts)
                owner = np.searchsorted(ends, at, side="right")
                offsets = pa.array(np.r_[0, np.searchsorted(owner, np.arange(len(texts)), side="right")], pa.int32())
                places = pa.array((at - (ends - counts)[owner]).astype(np.int32)) if len(at) else pa.array([], pa.int32())
                hits = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(hashes.view(np.int64), pa.int64()), places], ["h", "at"]))
                hit = np.diff(np.asarray(offsets)) > 0
                kept = pa.array([b" ".join(t.split()).decode() if h else None for t, h in zip(texts, hit.tolist())], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), hits, kept], ["doc_id", "n_words", "hits", "words"])

    return run


def _extend(window: int):
    """Runs of equal words of each document and the items that it may hold, along the shifts
    at which they met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for uid, words, met in zip(batch.column("uid").to_pylist(), batch.column("words").to_pylist(), batch.column("met").to_pylist()):
                doc = words.split(" ")
                number: dict[str, int] = {}
                text = np.fromiter((number.setdefault(w, len(number)) for w in doc), dtype=np.int64, count=len(doc))
                for m in met:
                    item = np.fromiter((number.get(w, -1) for w in m["item_words"].split(" ")), dtype=np.int64)
                    need = min(window, len(item))
                    for shift in m["shifts"]:
                        low, high = max(0, -shift), min(len(item), len(text) - shift)
                        if high - low < need:
                            continue
                        edge = np.flatnonzero(np.diff(np.r_[False, item[low:high] == text[low + shift : high + shift], False].astype(np.int8)))
                        for a, b in zip((edge[0::2] + low).tolist(), (edge[1::2] + low).tolist()):
                            if b - a >= need:
                                for have, x in zip(out, (uid, m["item_id"], a + shift, b + shift)):
                                    have.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 1 else pa.int64()) for i, x in enumerate(out)], ["uid", "item_id", "start", "end"])

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(row, doc_id, n_words, n_hit, items, spans, contaminated) for each row of ``docs``
    (doc_id, text) against ``benchmark`` (item_id, text).

    items: the ids, as strings in ascending order, of items with a window in the document;
    spans: disjoint [start, end) ranges of hit words, in order. Null texts have no words;
    benchmark rows without words or item_id match nothing. Rows of an equal doc_id each get
    a row; rows of an equal item_id count as one item with the windows of all. ``row`` tells
    rows apart. Other columns are ignored. Texts count as a whole, however long they are or
    often they repeat a phrase. Empty tables give an empty result or no hits.
    """
    if not 1 <= k <= window:
        raise ValueError("k must be from 1 to the window")

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join(normal(t).split()).decode() for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.string())], ["item_id", "text"])

    named = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text")
    items = named.mapInArrow(own("winnow", normalise), "item_id string, text string").where("text <> ''").distinct()
    items = materialise(items.select("item_id", "text", F.size(F.split("text", " ")).alias("n")), "benchmark-items")
    lengths = sorted(r.n for r in items.where(F.col("n") < window).select("n").distinct().collect())  # fewer than the window

    def item_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch, "text")
            out: list[list] = [[], [], [], []]
            for item_id, text, n in zip(batch.column("item_id").to_pylist(), texts, batch.column("n").to_pylist()):
                words, counts, _ = hashed_words([text])
                if n < window:
                    at, hashes = np.zeros(1, dtype=np.int64), grams(words, n) ^ np.uint64(n)
                else:
                    at, hashes = selected(words, counts, k, window)
                for have, x in zip(out, ([item_id] * len(at), [text.decode()] * len(at), hashes.view(np.int64).tolist(), at.tolist())):
                    have += x
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["item_id", "item_words", "h", "item_at"])

    prints = materialise(items.mapInArrow(own("winnow", item_prints), "item_id string, item_words string, h long, item_at int"), "benchmark-prints")
    few = prints.count() <= broadcast_rows
    known = np.sort(prints.select("h").distinct().toArrow()["h"].to_numpy().view(np.uint64)) if few else None
    schema = "doc_id long, n_words long, hits array<struct<h: bigint, at: int>>, words string"
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(own("winnow", _documents(known, lengths, k, window)), schema)
    found = materialise(found.withColumn("uid", F.monotonically_increasing_id()), "document-prints")
    probes = found.where(F.size("hits") > 0).select("uid", F.explode("hits").alias("hit")).select("uid", "hit.h", "hit.at")
    offsets = probes.join(prints.select("h", "item_id", "item_words", "item_at"), "h")
    # items that repeat a text share their comparison only if their id is equal too
    offsets = offsets.select("uid", "item_id", (F.col("at") - F.col("item_at")).cast("long").alias("shift"), "item_words")
    # a text is sent once, with the shifts of each item: as many as it has words, at most
    met = offsets.groupBy("uid", "item_id", "item_words").agg(F.collect_set("shift").alias("shifts"))
    met = met.groupBy("uid").agg(F.collect_list(F.struct("item_id", "item_words", "shifts")).alias("met"))
    pairs = met.join(found.select("uid", "words"), "uid").select("uid", "words", "met")
    hits = pairs.mapInArrow(own("winnow", _extend(window)), "uid long, item_id string, start long, end long")
    by_doc = hits.groupBy("uid").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.sort_array(F.collect_set(F.struct("start", "end"))).alias("ranges"))
    empty = F.array().cast("array<struct<start: bigint, end: bigint>>")

    def merge(done, x):
        last = F.element_at(done, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when((F.size(done) == 0) | (F.try_element_at(done, F.lit(-1))["end"] < x["start"]), F.concat(done, F.array(x))).otherwise(
            F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))
        )

    spans = F.aggregate("ranges", empty, merge)
    out = found.select("uid", "doc_id", "n_words").join(by_doc.select("uid", "items", spans.alias("spans")), "uid", "left")
    out = out.select(
        F.col("uid").alias("row"), "doc_id", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", empty).alias("spans")
    )
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("row", "doc_id", "n_words", n_hit.alias("n_hit"), "items", "spans", (n_hit > 0).alias("contaminated"))
