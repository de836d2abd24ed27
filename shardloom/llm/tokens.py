"""Token counts by offset-mapped attribution.

Each whole text is encoded once. The tokens' byte lengths give their spans, byte spans are
mapped to character spans, and the ascending spans are met with the ascending sections of
the text by an interval join of two sorted lists. A token that crosses a boundary between
sections is given by an explicit rule: ``largest`` (the section that holds most of its
bytes, the earlier of equal ones), ``first`` (that of its first byte) or ``shares`` (to each
section the share of its bytes there).

A character split between tokens belongs to the token of its first byte.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import kept, own, text_batches

RULES = ("largest", "first", "shares")
_encodings: dict[str, tuple] = kept()


def encoding(path: str, pattern: str):
    """The encoding of a rank file, and the byte length of each token."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        length = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length
    return _encodings[path]


def _encode(encoder, text: str) -> np.ndarray:
    return np.array(encoder.encode_ordinary(text), dtype=np.int64)


def line_sections(data: bytes) -> np.ndarray:
    """Ends, in bytes, of the lines of a text, each with its line feed; one for no text."""
    at = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x0A) + 1
    return at if len(at) and at[-1] == len(data) else np.append(at, len(data))


def attribute(ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens given to each section, and how many tokens cross out of it or into it.

    ``ends``: ascending ends of tokens that cover a text; ``sections``: ascending ends of
    sections that cover it as well.
    """
    counts, crossing = np.zeros(len(sections)), np.zeros(len(sections), dtype=np.int64)
    if not len(ends):
        return counts, crossing
    begins = np.r_[0, ends[:-1]]
    first = np.searchsorted(sections, begins, side="right")
    last = np.searchsorted(sections, ends, side="left")
    whole = first == last
    counts += np.bincount(first[whole], minlength=len(sections))
    for i in np.flatnonzero(~whole).tolist():
        own = np.arange(first[i], last[i] + 1)
        parts = np.minimum(sections[own], ends[i]) - np.maximum(np.r_[0, sections][own], begins[i])
        crossing[own[parts > 0]] += 1
        if rule == "first":
            counts[first[i]] += 1
        elif rule == "largest":
            counts[own[parts.argmax()]] += 1
        else:
            counts[own] += parts / parts.sum()
    return counts, crossing


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "largest", fields: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, field, section, start, end, n_tokens, n_crossing) for each section of each
    row of ``docs``: the lines of column text, or of each column in ``fields`` (name to
    column). start and end are in characters; each line has its line feed.

    A null or empty text has one empty section without tokens. n_tokens is a double: whole
    but for the rule ``shares``; its sum over a text is the text's number of tokens. Rows of
    equal or null doc_id each have rows. Under ``largest`` a token of two equal parts goes to
    the first. Texts count as a whole, however long. Other columns are ignored. An empty table
    gives an empty result.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, length = encoding(path, pattern)
        for whole in batches:
            for batch in text_batches(whole):
                columns: list[list] = [[] for _ in range(5)]
                sizes = []
                for text in batch.column("text").to_pylist():
                    data = (text or "").encode()
                    ends = np.cumsum(length[_encode(encoder, text)]) if text else np.zeros(0, dtype=np.int64)
                    sections = line_sections(data)
                    counts, crossing = attribute(ends, sections, rule)
                    chars = sections
                    if len(data) != len(text or ""):
                        firsts = (np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80
                        chars = np.r_[0, np.cumsum(firsts)][sections]
                    sizes.append(len(sections))
                    for have, x in zip(columns, (np.arange(len(sections)), np.r_[0, chars[:-1]], chars, counts, crossing)):
                        have.append(x)
                ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                field = batch.column("field").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                parts = [np.concatenate(x) if x else np.zeros(0) for x in columns]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [ids, field, *(pa.array(x.astype(k.to_pandas_dtype())) for x, k in zip(parts, kinds))],
                    ["doc_id", "field", "section", "start", "end", "n_tokens", "n_crossing"],
                )

    named = fields or {"text": "text"}
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    rows = docs.select(doc_id, F.explode(F.array(*(F.struct(F.lit(a).alias("field"), F.col(c).alias("text")) for a, c in named.items()))).alias("_"))
    if len(named) == 1:
        [(a, c)] = named.items()
        rows = docs.select(doc_id, F.lit(a).alias("field"), F.col(c).alias("text"))
    else:
        rows = rows.select("doc_id", "_.field", "_.text")
    return rows.mapInArrow(own("tokens", run), "doc_id long, field string, section long, start long, end long, n_tokens double, n_crossing long")
