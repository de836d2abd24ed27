"""Suffix-array dedup: cut every byte that a repeated string of ``length`` bytes covers.

Every window of ``length`` bytes is dealt to a group by the content of the window alone:
by its smallest hash of 32 bytes, the leftmost of equal ones. Consecutive windows whose
smallest hash stands at the same place form a segment, so equal windows always meet in one
group while text is sent about three times at most, and only where it has to be: segments
are first counted by group and by content, and copies of a segment combine before the
shuffle. A segment that occurs twice is repeated throughout. A group of one different
segment is settled. Only groups with different segments, one of them met once, are dealt
further: equal windows hold the least hash at the same place, by which they are of one of
``CLASSES`` classes, and all windows of a class in a segment cover one core, most of a window
(308 bytes of 400). They go to the group of this core as a piece; a group of one piece, or of
none met once, is settled. The pieces of the others go to a shard without the core, for which
a mark stands that no other group of the shard has, so only what may differ is sorted: the
suffixes, by induction over queues that spill to disk (``induced``). Windows that are
neighbours there and have all their symbols in common, by the prefixes carried along, are
repeated. A shard may be far larger than memory: its text, ranks and queues lie in scratch
files of the task. So that no single task sorts what a third of all documents share, a group
of more than ``HOT`` shards' bytes goes to no shard: each of its windows is dealt by a 128-bit
hash of its bytes, and windows that meet are repeated.

What was found goes back to the segments' places, and each document is cut once.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import binary_column, materialise, own, text_batches
from .induced import BYTES, MEMORY, SYMBOLS, repeated_starts
from .mph import mix

LENGTH = 400
GRAM = 32
#: Classes of windows by the place of the least hash in them.
CLASSES = 4
#: Bytes of text that a shard's suffix array holds, about.
SHARD_BYTES = 3 << 20
#: Groups of more bytes than so many shards are dealt out by window.
HOT = 4
#: Texts are read in parts of this size at most, one gram and window over the cut.
_PART = 8 << 20
_PLACE = 24
_NO_ID = -(2**63)
#: Pieces in a batch, about.
_BATCH = 1 << 13
#: Symbols that stand for a core: its group's number in the shard, in digits no byte has.
_MARK = 4
_DIGITS = SYMBOLS - BYTES
_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64), 5)
_BASE = 0x9E3779B97F4A7C15 | 1


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of ``gram`` (a power of two) bytes, by doubling."""
    out, size, base = _BYTE_HASH[data], 1, _BASE
    while size < gram:
        out = out[:-size] * np.uint64(base) + out[size:]
        base = base * base & (1 << 64) - 1
        size *= 2
    return mix(out, gram)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def anchored(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, group, anchor) of the segments of ``data``: window numbers are
    consecutive; the smallest hash stands ``anchor`` bytes after the start."""
    out: list[tuple] = []
    for base in range(0, max(1, len(data) - length + 1), _PART):
        part = np.frombuffer(data, dtype=np.uint8)[base : base + _PART + length - 1]
        if len(part) < length:
            continue
        hashes = _gram_hashes(part, gram)
        mark = hashes >> np.uint64(_PLACE) << np.uint64(_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        least = _sliding_min(mark, length - gram + 1)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        place = (least[first] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        out.append((first + base, np.diff(np.r_[first, len(least)]), hashes[place], place - first))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64), none
    return tuple(np.concatenate(x) for x in zip(*out))


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, windows, group) of the segments of ``data``, as ``anchored`` gives them."""
    return anchored(data, length, gram)[:3]


def _class_width(length: int, gram: int) -> int:
    """Places of the least hash in one class; windows of a class share all but so many bytes and one."""
    return -(-(length - gram + 1) // CLASSES)


def _scan(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "th", "start", "n", "h", "c", "anchor"]
        for whole in batches:
            for batch in text_batches(whole):
                owner, columns = [], [[] for _ in range(5)]
                for row, text in enumerate(binary_column(batch, "text")):
                    if text is None or len(text) < length:
                        continue
                    start, n, group, anchor = anchored(text, length, gram)
                    view, hashed = memoryview(text), xxhash.xxh3_64_intdigest
                    content = [hashed(view[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist())]
                    owner.append(np.full(len(start), row))
                    for have, x in zip(columns, (start, n, group, np.array(content, dtype=np.uint64), anchor)):
                        have.append(x)
                if not owner:
                    continue
                at = pa.array(np.concatenate(owner))
                parts = [np.concatenate(x) for x in columns]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("k").take(at), batch.column("th").take(at), pa.array(parts[0], pa.int64()), pa.array(parts[1], pa.int32()), pa.array(parts[2].view(np.int64)), pa.array(parts[3].view(np.int64)), pa.array(parts[4], pa.int32())],
                    names,
                )

    return run


_PIECES = "h long, of long, c long, n int, copies long, first int, m int, split int, data binary"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]


def _tuples(columns: list[np.ndarray]) -> Iterator[tuple]:
    for a in range(0, len(columns[0]), _BATCH):
        yield from zip(*(x[a : a + _BATCH].tolist() for x in columns))


def _pieces(length: int, gram: int):
    """The windows of each class in the segments listed with each document: the group of their
    core, the segment (of, c, n), the number of the first and how many, and the bytes before
    and after the core, which begins at ``split``."""
    width = _class_width(length, gram)
    core = length - width + 1
    names = [x.strip().split(" ")[0] for x in _PIECES.split(",")]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), _KINDS)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed, signed = xxhash.xxh3_64_intdigest, lambda x: x - (x >> 63 << 64)
        out: list[tuple] = []
        for batch in batches:
            for text, rows in zip(binary_column(batch, "text"), batch.column("rows")):
                columns = [x.to_numpy(zero_copy_only=False) for x in rows.values.flatten()]
                for h, c, n, copies, start, anchor in _tuples(columns):
                    for kind in range((anchor - n + 1) // width, anchor // width + 1):
                        first, end = max(0, anchor - kind * width - width + 1), min(n, anchor - kind * width + 1)
                        begin = start + anchor - kind * width
                        body = text[begin : begin + core]
                        data = text[start + first : begin] + text[begin + core : start + end - 1 + length]
                        out.append((signed(hashed(body, kind)), h, c, n, copies, first, end - first, begin - start - first, data))
                    if len(out) >= _BATCH:
                        yield batch_of(out)
                        out = []
        if out:
            yield batch_of(out)

    return run


class _Shard:
    """The pieces of one shard, in the order of their groups: their symbols in a scratch file,
    and for each piece its segment, its copies, its windows and where it begins."""

    def __init__(self, number: int):
        self.number, self.file, self.size = number, tempfile.TemporaryFile(), 0
        self.columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        self.group, self.groups = None, -1

    def add(self, batch: pa.RecordBatch) -> None:
        h, of = (batch.column(x).to_numpy() for x in ("h", "of"))
        fresh = np.r_[(h[0], of[0]) != self.group, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]
        group = self.groups + np.cumsum(fresh)
        self.group, self.groups = (h[-1], of[-1]), int(group[-1])
        if self.groups >= _DIGITS**_MARK:
            raise ValueError(f"a shard of more than {_DIGITS**_MARK} groups: lower shard_bytes")
        # each piece is its bytes before the core, the mark, its bytes after it and a separator
        pieces = batch.column("data").to_pylist()
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)) + _MARK + 1
        ends = np.cumsum(sizes)
        marks = (ends - sizes + batch.column("split").to_numpy())[:, None] + np.arange(_MARK)
        symbols = np.zeros(int(ends[-1]), dtype=np.uint16)
        symbols[marks] = BYTES + group[:, None] // _DIGITS ** np.arange(_MARK) % _DIGITS
        symbols[ends - 1] = 1
        symbols[symbols == 0] = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.uint16) + np.uint16(2)
        self.file.write(symbols.data)
        for have, x in zip(self.columns, (*(batch.column(c).to_numpy() for c in ("of", "c", "n", "copies", "first", "m")), self.size + ends - sizes)):
            have.append(x)
        self.size += len(symbols)

    def settle(self, length: int, memory: int) -> Iterator[pa.RecordBatch]:
        """Runs of repeated windows (``length`` symbols) of the pieces that occur once."""
        self.file.write(np.zeros(1, dtype=np.uint16).data)
        self.file.flush()
        if 2 * self.size > memory // 8:
            text = np.memmap(self.file, dtype=np.uint16, mode="r", shape=(self.size + 1,))
        else:
            self.file.seek(0)
            text = np.frombuffer(self.file.read(), dtype=np.uint16)
        self.file.close()
        found = repeated_starts(text, length, memory)
        h, c, n, copies, first, m, begin = (np.concatenate(x) for x in self.columns)
        at = 0
        while at < len(h):
            to = max(at + 1, int(np.searchsorted(begin, begin[at] + _PART // 8)))
            some, base = slice(at, to), int(begin[at])
            end = int(begin[to]) if to < len(h) else self.size
            sizes = np.diff(np.append(begin[some], end))
            once = np.where(copies[some] == 1, m[some], 0)
            window = np.arange(end - base) - np.repeat(begin[some] - base, sizes) < np.repeat(once, sizes)  # not over a piece's end
            edge = np.flatnonzero(np.diff(np.r_[False, found[base:end] & window, False].astype(np.int8)))
            a, b = edge[0::2] + base, edge[1::2] + base
            piece = np.searchsorted(begin[some], a, "right") - 1
            moved = first[some][piece] - begin[some][piece]
            a, b = a + moved, b + moved
            offsets = np.r_[0, np.cumsum(np.bincount(piece, minlength=to - at))]
            runs = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["a", "b"])
            ranges = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs)
            out = pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(c[some]), pa.array(n[some]), ranges], ["h", "c", "n", "ranges"])
            yield out.filter(pa.array(np.diff(offsets) > 0))
            at = to


def _ranges(mask: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return [{"a": a, "b": b} for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist())]


def _sort_shards(length: int, spill_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _Shard | None = None
        for batch in batches:
            number = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]).tolist() if len(number) else []
            for a, b in zip(cuts, cuts[1:]):
                if shard is None or shard.number != number[a]:
                    if shard is not None:
                        yield from shard.settle(length, spill_bytes)
                    shard = _Shard(int(number[a]))
                shard.add(batch.slice(a, b - a))
        if shard is not None:
            yield from shard.settle(length, spill_bytes)

    return run


_WINDOWS = "w long, v long, of long, c long, n int, copies long, at int"


def _deal_windows(span: int):
    """A hash of each window of pieces, with its number in the segment: of its group, of where
    the core stands and of its ``span`` bytes beside the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_128_digest
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                m, split = (batch.column(x).to_numpy() for x in ("m", "split"))
                at = np.arange(m.sum()) - np.repeat(np.cumsum(m, dtype=np.int64) - m, m)
                keys = (np.repeat(batch.column(x).to_numpy(), m) for x in ("h", "of"))
                head = np.column_stack([*keys, np.repeat(split, m) - at]).astype(np.int64).tobytes()
                w, i = [], 0
                for data, k in zip(batch.column("data").to_pylist(), m.tolist()):
                    for x in range(k):
                        w.append(hashed(head[i : i + 24] + data[x : x + span]))
                        i += 24
                w = np.frombuffer(b"".join(w), dtype=np.int64).reshape(-1, 2)
                own_row = pa.array(np.repeat(np.arange(len(m)), m))
                at = at + np.repeat(batch.column("first").to_numpy(), m)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), *(batch.column(x).take(own_row) for x in ("of", "c", "n", "copies")), pa.array(at, pa.int32())], ["w", "v", "of", "c", "n", "copies", "at"])

    return run


def _join_windows():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = []
            for n, places in zip(batch.column("n").to_pylist(), batch.column("places").to_pylist()):
                mask = np.zeros(n, dtype=bool)
                mask[places] = True
                ranges.append(_ranges(mask))
            kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("of", "c", "n")), pa.array(ranges, kind)], ["h", "c", "n", "ranges"])

    return run


_FOUND = "h long, c long, n int, ranges array<struct<a: int, b: int>>"


def _repeated_by_window(pieces: DataFrame, span: int) -> DataFrame:
    """(h, c, n, ranges) as shards give them, of pieces dealt by window."""
    windows = materialise(pieces.mapInArrow(own("suffixes", _deal_windows(span)), _WINDOWS), "segments-windows")
    twice = windows.groupBy("w", "v").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("w", "v")
    met = windows.where("copies = 1").join(twice, ["w", "v"]).groupBy("of", "c", "n").agg(F.collect_list("at").alias("places"))
    return met.mapInArrow(own("suffixes", _join_windows()), _FOUND)


def _cut():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, ranges in zip(binary_column(batch, "text"), batch.column("ranges").to_pylist()):
                text, spans = text or b"", []
                for r in sorted(ranges or (), key=lambda r: (r["a"], r["b"])):
                    if spans and r["a"] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], r["b"])
                    else:
                        spans.append([r["a"], r["b"]])
                edges = [0, *(x for s in spans for x in s), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[0::2], edges[1::2]))
                spans = [{"start": a, "end": b} for a, b in spans]
                for have, x in zip(out, (len(text), len(text) - len(kept), len(spans), spans, kept)):
                    have.append(x)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), span, pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, k) for x, k in zip(out, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    return run


def dedup_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, spill_bytes: int = MEMORY) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) for each row of ``docs`` (doc_id,
    text): the UTF-8 bytes that no string of ``length`` bytes which starts anywhere else
    covers, and the maximal [start, end) runs of those that were cut.

    Strings don't cross documents; those that overlap in one document count. Null texts are
    empty. Rows of equal doc_id are documents of their own; a null doc_id stays null. Texts
    count as a whole, however long. Other columns are ignored. An empty table gives an empty
    result.
    """
    if gram & (gram - 1) or gram > length:
        raise ValueError("gram must be a power of two up to the length")
    k = F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))
    rows = docs.select(F.col("doc_id").cast("long"), k.alias("k"), F.xxhash64("text").alias("th"), "text")
    places = rows.select("k", "th", "text").mapInArrow(own("suffixes", _scan(length, gram)), "k long, th long, start long, n int, h long, c long, anchor int")
    places = materialise(places, "segments")
    key = ["h", "c", "n"]
    first = [F.first(x).alias(x) for x in ("k", "th", "start", "anchor")]
    distinct = places.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), *first)
    mixed = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("different"), F.min("copies").alias("least")).where("different > 1 AND least = 1")
    open_ = distinct.join(mixed.select("h", F.lit(True).alias("open")), "h", "left").where("copies > 1 OR open")
    open_ = materialise(open_, "segments-repeated")
    asked = open_.where("open").groupBy("k", "th").agg(F.collect_list(F.struct("h", "c", "n", "copies", "start", "anchor")).alias("rows"))
    pieces = rows.select("k", "th", "text").dropna(subset=["text"]).join(asked, ["k", "th"]).select("text", "rows")
    pieces = materialise(pieces.mapInArrow(own("suffixes", _pieces(length, gram)), _PIECES), "segments-pieces")
    span = _class_width(length, gram) - 1
    size, crowded = F.col("m") + (span + _MARK), F.col("bytes") > HOT * shard_bytes
    groups = pieces.groupBy("h", "of").agg(F.count(F.lit(1)).alias("met"), F.min("copies").alias("least"), F.sum(size).alias("bytes"))
    groups = materialise(groups.where(F.col("met") > 1).where((F.col("least") == 1) | crowded), "segments-groups")
    total, some_hot = groups.agg(F.sum(F.when(~crowded, F.col("bytes"))), F.max(crowded)).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    hot = groups.where(crowded)
    cool = pieces.join(hot.select("h", "of"), ["h", "of"], "left_anti") if some_hot else pieces
    # settled groups of pieces go no further than the shuffle: the order of the shard shows them
    alike = Window.partitionBy("shard", "h", "of")
    dealt = cool.withColumn("shard", F.pmod(F.xxhash64("h", "of"), F.lit(shards))).repartition("shard")
    dealt = dealt.withColumns({"met": F.count(F.lit(1)).over(alike), "least": F.min("copies").over(alike)}).where("met > 1 AND least = 1").drop("met", "least")
    ordered = dealt.sortWithinPartitions("shard", "h", "of")
    found = ordered.mapInArrow(own("suffixes", _sort_shards(span + _MARK, spill_bytes)), _FOUND)
    if some_hot:
        found = found.unionByName(_repeated_by_window(pieces.join(hot.where("least = 1").select("h", "of"), ["h", "of"], "left_semi"), span))
    whole = open_.where("copies > 1").select(*key, F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b"))).alias("ranges"))
    found = materialise(whole.unionByName(found), "segments-found")
    cut = places.join(found, key).select("k", "th", "start", F.explode("ranges").alias("r"))
    cut = cut.groupBy("k", "th").agg(F.collect_list(F.struct((F.col("start") + F.col("r.a")).alias("a"), (F.col("start") + F.col("r.b") + (length - 1)).alias("b"))).alias("ranges"))
    joined = rows.join(cut.withColumnsRenamed({"k": "k2", "th": "th2"}), (F.col("k") == F.col("k2")) & (F.col("th") == F.col("th2")), "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return joined.select("doc_id", "text", "ranges").mapInArrow(own("suffixes", _cut()), schema)
