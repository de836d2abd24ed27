"""Token ids in a compact binary file: canonical, length-limited Huffman codes.

Three passes over the corpus. (1) Each whole text is encoded once with the tokenizer.
(2) Ids are counted over all documents (one small row per id and task, summed by Spark;
the driver sees one count per id of the vocabulary) and code lengths of at most ``limit``
bits are found by package-merge. (3) Documents are coded, dealt into ascending ranges of
doc_id and written as blocks.

File format: a folder of Parquet files, so that writing commits atomically and any store
that Spark reaches will do. A row is an independent block of whole documents in ascending
doc_id order: ``part`` and ``block`` (its place), ``start`` (ids before it in its part),
``doc_id``, ``n_tokens`` and ``n_bytes`` of each document, ``payload`` (each document's
codes, most significant bit first, padded to a byte) and ``checkpoints`` (little-endian
unsigned 64-bit bit offsets of every 256th token from its document's first bit, the first
left out). The folder ``<path>-codes`` has the code length of each id; canonical codes
follow from it. Decoding is driven by one table of ``limit`` bits, and runs through all
checkpoints of a block side by side.
"""

from __future__ import annotations

import gc
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.session import forget_at_exit, shared_folder

from ._common import kept, materialise, own, range_part, text_batches, trim

END_ID = 1
LIMIT = 16
CHECKPOINT = 256
#: Ranges of doc_id, at most: their bounds are part of the plan.
MOST_PARTS = 8192
#: Payload bytes after which a block is closed; a block has at least one whole document.
BLOCK_BYTES = 1 << 20
#: Words and other pieces kept by a worker in each of two generations.
CACHE = 200_000
_LONG_PIECE = 64


#: Punctuation after a word that no rule of the tokenizer joins to letters or to a special token.
_AFTER = ".,;:!?*#$%&()-\"/@+=_~^{}[]\\`"
#: Letters beside A-Z that keep their form under NFC.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_WORD = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"


def _is_word(text: str) -> bool:
    return text.isalpha() and (text.isascii() or _LETTERS.fullmatch(text) is not None)


class _Generations:
    """A dict of bounded size: what was not asked for in the last generation goes."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys) -> list:
        """The keys to find; others of the old generation move to the new one."""
        unknown = set(filterfalse(self.new.__contains__, keys))
        again = list(filter(self.old.__contains__, unknown))
        self.new.update(zip(again, map(self.old.__getitem__, again)))
        return list(unknown.difference(again))

    def turn(self) -> None:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}


#: What a tokenizer has to do before its merges for ``PieceEncoder`` to be right (fixed values).
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def splits_at_spaces(path: str) -> bool:
    """Whether a tokenizer's file says that it folds case and white space, cuts words from all
    else, marks the ends of words, and has no special token but of the form ``<|..|>``."""
    with open(path, encoding="utf-8") as source:
        said = json.load(source)
    special = all(re.fullmatch(r"<\|\w+\|>", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in said["added_tokens"])
    model = said["model"]
    plain = model["type"] == "BPE" and model["end_of_word_suffix"] == "</w>" and not model["dropout"] and not model["continuing_subword_prefix"] and not model.get("ignore_merges")
    return special and plain and said["normalizer"] == _NORMALIZER and said["pre_tokenizer"] == _PRE_TOKENIZER


class WholeEncoder:
    """Encodes whole texts, with any tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")

    def __call__(self, texts: pa.StringArray, end: int) -> pa.BinaryArray:
        out: list[bytes] = []
        for at in range(0, len(texts), 64):
            some = [t or "" for t in texts[at : at + 64].to_pylist()]
            out += [np.array([*e.ids, end], dtype=self.dtype).tobytes() for e in self._batch(some, add_special_tokens=False)]
        return pa.array(out, pa.binary())


class PieceEncoder:
    """Encodes texts with a tokenizer that never joins characters across a space or line
    feed (``splits_at_spaces``), so each distinct piece between them is encoded once and
    looked up after that: the same ids as ``WholeEncoder`` gives in less time. A word with
    punctuation after it is put together from the two; many new words are encoded in one
    call and cut where the tokenizer marks a word's end.
    """

    def __init__(self, path: str, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        if resize := getattr(self.tokenizer.model, "_resize_cache", None):
            resize(0)  # each word comes once
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.cache, self.tails = _Generations(cache), {"": b""}

    def _encode(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self._batch(pieces, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            ids = np.array(self._batch([" ".join(some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
            if len(cuts) != len(some):  # not a tokenizer that marks each word's end
                out += self._encode(some)
                continue
            data = ids.tobytes()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _find(self, pieces: pa.StringArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Id lists, and for each of the distinct ``pieces`` the places of its word's list
        (or its own) and of its tail's."""
        cores = pc.utf8_rtrim(pieces, _AFTER)
        core_size, size = (pc.binary_length(x).to_numpy().astype(np.int64) for x in (cores, pieces))
        tail_size = size - core_size
        word = pc.match_substring_regex(cores, _WORD).to_numpy(zero_copy_only=False) & (tail_size <= 7)
        # up to seven bytes of punctuation, packed into one number
        offsets = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset :][: len(pieces)].astype(np.int64)
        data = np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8)
        packed = np.zeros(len(pieces), dtype=np.uint64)
        for i in range(int(tail_size[word].max(initial=0))):
            rows = np.flatnonzero(word & (tail_size > i))
            packed[rows] = packed[rows] << np.uint64(8) | data[offsets[rows] + core_size[rows] + i]
        tails, tail_at = np.unique(packed, return_inverse=True)
        tails = [int(t).to_bytes(8).lstrip(b"\0").decode() for t in tails.tolist()]
        some = [t for t in tails if t not in self.tails]
        self.tails.update(zip(some, self._encode(some)))
        tail_ids = [self.tails[t] for t in tails]
        if len(self.tails) > 10_000:
            self.tails = {"": b""}
        keyed = pc.if_else(pa.array(word), pc.utf8_lower(cores), pieces).dictionary_encode()
        keys = keyed.dictionary.to_pylist()
        known, fresh = self.cache.new, self.cache.missing(keys)
        words = list(filter(_is_word, fresh))
        known.update(zip(words, self._encode_words(words)))
        other = list(set(fresh).difference(words))
        known.update(zip(other, self._encode(other)))
        found = list(map(known.__getitem__, keys))
        for k in [k for k in fresh if len(k) > _LONG_PIECE]:
            del known[k]
        self.cache.turn()
        return found + tail_ids, keyed.indices.to_numpy(), tail_at.reshape(-1) + len(found)

    def __call__(self, texts: pa.StringArray, end: int) -> pa.BinaryArray:
        """The ids of each text and ``end``. Arrow splits the texts and numbers the distinct
        pieces of the batch and their words; only words are looked up one by one."""
        gc.disable()  # millions of strings, and no cycle among them
        split = pc.split_pattern(pc.replace_substring(texts.fill_null(""), "\n", " "), " ")
        numbered = split.flatten().dictionary_encode()
        found, word_at, tail_at = self._find(numbered.dictionary)
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.dtype.itemsize
        offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(found), dtype=self.dtype)))
        piece = numbered.indices.to_numpy()
        both = np.empty(2 * len(piece), dtype=np.int32)
        both[0::2], both[1::2] = word_at[piece], tail_at[piece]
        taken = lists.take(pa.array(both))
        at = (np.asarray(split.offsets) - split.offsets[0].as_py()) * 2
        ends = np.asarray(taken.offsets)[at].astype(np.int64)
        ids = np.insert(taken.flatten().to_numpy(), ends[1:] - ends[0], end)
        gc.enable()
        cuts = (ends - ends[0] + np.arange(len(ends))) * self.dtype.itemsize
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids)])


_encoders: dict[str, PieceEncoder | WholeEncoder] = kept()


def encoder(path: str) -> PieceEncoder | WholeEncoder:
    """Whole texts are encoded, unless the tokenizer's file shows that pieces will do."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path) if splits_at_spaces(path) else WholeEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> tuple[DataFrame, np.dtype]:
    """(doc_id, ids): little-endian ids of each whole text and the end id."""
    dtype = encoder(tokenizer).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder_ = encoder(tokenizer)
        for whole in batches:
            for batch in text_batches(whole, 6 << 20):
                ids = encoder_(batch.column("text").cast(pa.string()), end_id)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])
                del ids
                trim()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(own("huffman-encode", run), "doc_id long, ids binary"), dtype


def counts(tokens: DataFrame, dtype: np.dtype) -> dict[int, int]:
    """How often each id occurs in all documents; as long as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            for at in range(0, len(ids), 500):
                own = np.bincount(np.frombuffer(b"".join(ids[at : at + 500]), dtype=dtype))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), dtype=np.int64)])
                total[: len(own)] += own
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(own("huffman", run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    return {r.id: r.n for r in rows}


def code_lengths(freq: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package-merge.

    Raises ValueError where ``limit`` bits can't tell the ids apart.
    """
    if not freq:
        return {}
    if len(freq) > 1 << limit:
        raise ValueError(f"{len(freq)} ids need more than {limit} bits")
    ids = sorted(freq, key=lambda i: (freq[i], i))
    weight = np.array([freq[i] for i in ids], dtype=np.float64)
    n = len(ids)
    if n == 1:
        return {ids[0]: 1}
    leaves, current = [np.ones(n, dtype=bool)], weight
    for _ in range(limit - 1):
        packages = current[: len(current) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate([weight, packages])
        order = np.argsort(merged, kind="stable")
        current = merged[order]
        leaves.append(order < n)
    lengths, take = np.zeros(n, dtype=np.int64), 2 * n - 2
    for leaf in reversed(leaves):
        k = int(leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    return dict(zip(ids, lengths.tolist()))


class Codec:
    """Canonical codes of given lengths, and the table that decodes them."""

    def __init__(self, lengths: dict[int, int]):
        order = sorted(lengths, key=lambda i: (lengths[i], i))
        self.bits = max(lengths.values(), default=1)
        size = np.array([lengths[i] for i in order], dtype=np.int64)
        span = np.left_shift(1, self.bits - size)
        first = np.concatenate([[0], np.cumsum(span)[:-1]]).astype(np.int64) if len(order) else size
        symbols = np.array(order, dtype=np.int64)
        most = int(symbols.max(initial=0)) + 1
        # codes stand at the upper end of 64 bits, so a shift to their place drops what goes over
        self.code, self.length = np.zeros(most, dtype=np.uint64), np.zeros(most, dtype=np.uint8)
        self.code[symbols] = first.astype(np.uint64) << np.uint64(64 - self.bits)
        self.length[symbols] = size
        self.symbol_of = np.zeros(1 << self.bits, dtype=np.uint32)
        self.length_of = np.ones(1 << self.bits, dtype=np.uint8)
        used = int(span.sum())
        self.symbol_of[:used] = np.repeat(symbols, span)
        self.length_of[:used] = np.repeat(size, span)

    def encode(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of documents of ``sizes`` ids each (none empty), bytes of each document,
        and the bit at which each id begins."""
        length = self.length[ids]
        starts = np.cumsum(sizes) - sizes
        bits = np.add.reduceat(length, starts, dtype=np.int64)
        n_bytes = (bits + 7) // 8
        step = length.astype(np.int64)
        step[starts[1:]] += (n_bytes * 8 - bits)[:-1]  # each document begins at a byte
        at = np.cumsum(step) - length
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        code = self.code[ids]
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        words = np.zeros(int(word[-1]) + 2, dtype=np.uint64)
        words[word[first]] = np.add.reduceat(code >> inside, first)
        last = np.append(first[1:], len(ids)) - 1  # only the last id of a word goes over
        last = last[inside[last] + length[last] > 64]
        words[word[last] + 1] |= code[last] << (np.uint64(64) - inside[last])
        return words.astype(">u8").view(np.uint8)[: int(n_bytes.sum())], n_bytes, at

    def decode(self, payload: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All ids of runs of ``sizes`` ids that begin at bits ``at``, run after run."""
        out = np.zeros(int(sizes.sum()), dtype=np.uint32)
        if not len(out):
            return out
        padded = np.concatenate([payload, np.zeros(8, dtype=np.uint8)]).astype(np.uint32)
        window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        order = np.argsort(-sizes, kind="stable")
        place = (np.cumsum(sizes) - sizes)[order]
        bit, left = at[order].astype(np.int64), sizes[order]
        mask, shift = (1 << self.bits) - 1, 32 - self.bits
        active = np.searchsorted(-left, -np.arange(int(left[0])), side="left")  # runs with more than k ids
        for k, n in enumerate(active.tolist()):
            now = bit[:n]
            peek = (window[now >> 3] >> (shift - (now & 7)).astype(np.uint32)) & mask
            out[place[:n] + k] = self.symbol_of[peek]
            now += self.length_of[peek]
        return out


def _code_batches(lengths: dict[int, int], dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for whole in batches:
            column = whole.column("ids").to_pylist()
            at = 0
            while at < len(column):
                to, total = at, 0
                while to < len(column) and total < 1 << 18:
                    total += len(column[to])
                    to += 1
                ids = np.frombuffer(b"".join(column[at:to]), dtype=dtype)
                sizes = np.array([len(x) for x in column[at:to]], dtype=np.int64) // dtype.itemsize
                data, n_bytes, bit = codec.encode(ids, sizes)
                ends, first = np.cumsum(n_bytes).tolist(), (np.cumsum(sizes) - sizes).tolist()
                payload = [data[e - n : e].tobytes() for e, n in zip(ends, n_bytes.tolist())]
                marks = [(bit[f + CHECKPOINT : f + n : CHECKPOINT] - bit[f]).astype("<u8").tobytes() for f, n in zip(first, sizes.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [*(whole.column(c).slice(at, to - at) for c in ("part", "doc_id", "h")), pa.array(sizes, pa.int32()), pa.array(payload, pa.binary()), pa.array(marks, pa.binary())],
                    ["part", "doc_id", "h", "n_tokens", "payload", "checkpoints"],
                )
                at = to

    return run


_BLOCKS = "part int, block int, start long, doc_id array<long>, n_tokens array<int>, n_bytes array<int>, checkpoints binary, payload binary"


def _blocks(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, start = -1, 0, 0
        held: list[list] = [[], [], [], []]
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal held, block, start, size
            ids, sizes, payload, marks = held
            row = [[part], [block], [start], [ids], [sizes], [[len(p) for p in payload]], [b"".join(marks)], [b"".join(payload)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            names = [x.strip().split(" ")[0] for x in _BLOCKS.split(",")]
            block, start, size, held = block + 1, start + sum(sizes), 0, [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names)

        for batch in batches:
            for at, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if at != part:
                    if held[0]:
                        yield close()
                    part, block, start = at, 0, 0
                for have, x in zip(held, row):
                    have.append(x)
                size += len(row[2])
                if size >= most:
                    yield close()
        if held[0]:
            yield close()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES) -> None:
    """Encode all rows of ``docs`` (doc_id, text) and write the file format at ``path``, in
    several ranges of doc_id for each shuffle partition."""
    parts = min(MOST_PARTS, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tokens, dtype = encode(docs, tokenizer, end_id)
    tokens = materialise(tokens, "token-ids")
    lengths = code_lengths(counts(tokens, dtype), limit)
    # a doc_id that fills several ranges is cut by a hash of its ids, which then orders its rows
    places = tokens.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc_id"), (F.xxhash64("ids").bitwiseAND(F.lit(0x7FFFFFFF))).alias("h"))
    part = range_part(places, "doc_id", "h", parts)
    parted = tokens.select("doc_id", "ids", F.xxhash64("ids").bitwiseAND(F.lit(0x7FFFFFFF)).alias("h"))
    parted = parted.withColumn("k", F.coalesce("doc_id", F.lit(-(2**63)))).select(part("k", "h").alias("part"), "doc_id", "ids", "h")
    coded = parted.mapInArrow(own("huffman", _code_batches(lengths, dtype)), "part int, doc_id long, h long, n_tokens int, payload binary, checkpoints binary")
    ordered = coded.repartition("part").sortWithinPartitions("part", "doc_id", "h", "n_tokens", "payload").drop("h")
    ordered.mapInArrow(own("huffman", _blocks(block_bytes)), _BLOCKS).write.option("compression", "none").parquet(path)
    codes = docs.sparkSession.createDataFrame(sorted(lengths.items()), "id long, length int")
    codes.coalesce(1).write.parquet(f"{path}-codes")


def read(spark, path: str, with_ids: bool = False) -> DataFrame:
    """Decode the files at ``path``: doc_id, start, n_tokens, ids_crc32 (and ids, as
    little-endian unsigned 32-bit integers) of each document."""
    lengths = {r.id: r.length for r in spark.read.parquet(f"{path}-codes").collect()}  # as long as the vocabulary at most
    files = spark.read.schema(_BLOCKS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                sizes, n_bytes = np.array(row["n_tokens"], dtype=np.int64), np.array(row["n_bytes"], dtype=np.int64)
                begin = (np.cumsum(n_bytes) - n_bytes) * 8
                runs = -(-sizes // CHECKPOINT)
                first = np.cumsum(runs) - runs
                at = np.repeat(begin, runs)
                later = np.ones(int(runs.sum()), dtype=bool)
                later[first] = False
                at[later] += np.frombuffer(row["checkpoints"], dtype="<u8").astype(np.int64)
                each = np.full(len(at), CHECKPOINT, dtype=np.int64)
                each[first + runs - 1] = sizes - (runs - 1) * CHECKPOINT
                ids = codec.decode(np.frombuffer(row["payload"], dtype=np.uint8), at, each).astype("<u4")
                ends = np.cumsum(sizes)
                parts = [ids[e - n : e].tobytes() for e, n in zip(ends.tolist(), sizes.tolist())]
                columns = [
                    pa.array([row["part"]] * len(parts), pa.int32()), pa.array(row["doc_id"], pa.int64()), pa.array(row["start"] + ends - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64()),
                ]
                names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    # one row per part, of the files' small columns only
    ends = files.select("part", (F.col("start") + F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("end"))
    totals = sorted((r.part, r.n) for r in ends.groupBy("part").agg(F.max("end").alias("n")).collect())
    base, total = [], 0
    for part, n in totals:
        base.append((part, total))
        total += n
    bases = spark.createDataFrame(base, "part int, base long")
    rows = files.mapInArrow(own("huffman", run), schema).join(F.broadcast(bases), "part")
    return rows.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, limit: int = LIMIT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write ``docs`` in the shared folder and read back doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone. A null doc_id comes first; rows of equal
    doc_id each get a row, in an order that a hash of their ids fixes. Texts count as a whole,
    however long. Other columns are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id, limit, block_bytes)
    forget_at_exit(spark, path)
    forget_at_exit(spark, f"{path}-codes")
    return read(spark, path)
