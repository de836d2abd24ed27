"""SimHash near-dedup by a segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits, and each segment is mapped to
its number of set bits. The Manhattan distance of two such vectors is at most the Hamming
distance of the fingerprints, so links at ``distance`` bits or fewer are found by a range
join in the grid of these vectors: the 32 axes are dealt into 6 groups, and since at most
three of the six can differ for linked fingerprints, each link shares all cells of at
least one choice of three groups (20 choices, one grid of 16 axes each). Inside a cell the
Hamming distance is verified exactly.

``near_copies`` looks further than three bits: documents are near copies if their sets of
shingles of five words have a Jaccard similarity of 0.8 or more. Each has a fingerprint of
several hash families; candidates share a cell in any of several tables, and differ in few
bits. Bits alone would need tables in proportion to the number of documents to the power of
0.23, so a cell has two least hashes of shingles as well as sampled bits: texts meet that
share shingles, and others do not meet by chance. The shingles themselves decide.

Only distinct fingerprints enter the grid. A cell that holds many is cut into blocks by a
hash and its pairs of blocks are verified as separate units of bounded size; a unit gives
a spanning forest of its links, never all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import binary_column, long_of_hex, materialise, own
from .components import connected_components
from .mph import mix

SEED = 42
SHINGLE = 3
DISTANCE = 3
#: Fingerprints of a cell that one unit compares with as many others at most.
BLOCK = 512
#: Shingles of one document whose bits are counted at once.
_CHUNK = 255 * 16


def _grams(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of UTF-8 ``text``, repeats included; a shorter text is one."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else iter([words])
    count = max(1, len(words) - shingle + 1)
    return np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(SEED)), dtype=np.uint64, count=count)


def _majority(hashes: np.ndarray, families: int = 1) -> np.ndarray:
    """The bits set in over half the ``hashes``, for each family of hashes made of them."""
    ones = np.zeros(64 * families, dtype=np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        words = np.stack([part if not family else mix(part, family) for family in range(families)], axis=1)
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
        for a in range(0, len(bits), 255):  # a byte holds as many
            ones += np.add.reduce(bits[a : a + 255], axis=0, dtype=np.uint8)
    return np.packbits(ones.reshape(families, 64) * 2 > len(hashes), axis=1, bitorder="little").view(np.uint64)[:, 0]


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of UTF-8 ``text``; 0 where it has no word or is null."""
    return int(_majority(_grams(text, shingle))[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's whole text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in binary_column(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(own("simhash", run), "doc_id long, fp long")


def _group_masks() -> list[int]:
    """A 64-bit mask for each choice of three of the six groups of segments."""
    cuts = [0, 5, 10, 15, 20, 26, 32]
    groups = [sum(3 << (2 * s) for s in range(cuts[g], cuts[g + 1])) for g in range(6)]
    masks = [sum(c) for c in combinations(groups, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


_EVEN = np.uint64(0x5555555555555555)


def embed(fp: np.ndarray) -> np.ndarray:
    """Each two-bit segment's count of set bits, in unary (0, 1 or 3), so that the Manhattan
    distance of two vectors of counts is the number of bits in which these words differ."""
    upper = fp >> np.uint64(1)
    return (fp | upper) & _EVEN | (fp & upper & _EVEN) << np.uint64(1)


def forest(values: np.ndarray, distance: int) -> tuple[list[int], list[int]]:
    """Links that connect what is linked among ``values``: what is near in the grid's metric
    (a lower bound) is verified on the bits."""
    grid = embed(values)
    todo = np.ones(len(values), dtype=bool)
    a: list[int] = []
    b: list[int] = []
    for start in range(len(values)):
        if not todo[start]:
            continue
        todo[start] = False
        front = [start]
        while front:
            at = front.pop()
            x = values[at]
            near = np.flatnonzero(todo & (np.bitwise_count(grid ^ grid[at]) <= distance))
            near = near[np.bitwise_count(values[near] ^ x) <= distance]
            if len(near):
                todo[near] = False
                front += near.tolist()
                a += [int(x)] * len(near)
                b += values[near].tolist()
    return a, b


def _verify(distance: int):
    def whole(cells: pd.DataFrame) -> tuple[list, list]:
        """Links of complete units, sorted by unit."""
        if not len(cells):
            return [], []
        unit, fp = cells["unit"].to_numpy(), cells["fp"].to_numpy().view(np.uint64)
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        size = np.diff(np.r_[first, len(unit)])
        two = first[size == 2]
        grid = embed(fp)
        two = two[np.bitwise_count(grid[two] ^ grid[two + 1]) <= distance]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= distance]
        a, b = fp[two].view(np.int64).tolist(), fp[two + 1].view(np.int64).tolist()
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            x, y = forest(np.unique(fp[at : at + n]), distance)
            a += np.array(x, dtype=np.uint64).view(np.int64).tolist()
            b += np.array(y, dtype=np.uint64).view(np.int64).tolist()
        return a, b

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            unit = frame["unit"].to_numpy()
            if not len(unit):
                continue
            changes = np.flatnonzero(unit[1:] != unit[:-1])
            cut = int(changes[-1]) + 1 if len(changes) else 0  # the last unit may go on
            a, b = whole(frame.iloc[:cut])
            rest = frame.iloc[cut:]
            yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})
        if rest is not None:
            a, b = whole(rest)
            yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return run


def _embedding(column: str) -> Column:
    """``embed`` as an expression."""
    even, upper = F.lit(int(_EVEN)), F.shiftrightunsigned(column, 1)
    some = F.col(column).bitwiseOR(upper).bitwiseAND(even)
    both = F.shiftleft(F.col(column).bitwiseAND(upper).bitwiseAND(even), 1)
    return some.bitwiseOR(both)


def links(fps: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints of column ``fp`` that connect just what
    links at ``distance`` bits or fewer (3 at most) connect; not every link is listed."""
    if not 0 <= distance <= 3:
        raise ValueError("the grids find links of at most 3 bits")
    grids = F.array(*(F.struct(F.lit(g).alias("g"), F.col("e").bitwiseAND(F.lit(m)).alias("cell")) for g, m in enumerate(_group_masks())))
    points = fps.select("fp", _embedding("fp").alias("e")).select("fp", F.explode(grids).alias("c")).select("fp", F.xxhash64("c.g", "c.cell").alias("cell"))
    crowded = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = points.join(crowded, "cell").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    shared = shared.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    units = shared.select("fp", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    units = units.select(F.xxhash64("cell", F.least("block", "other"), F.greatest("block", "other")).alias("unit"), "fp")
    return units.repartition("unit").sortWithinPartitions("unit", "fp").mapInPandas(own("simhash", _verify(distance)), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of ``docs`` (doc_id, text; other
    columns are ignored).

    component_id is the smallest doc_id reached by links of ``distance`` bits or fewer.
    Null texts and texts without words have fingerprint 0 and link like any other. Rows
    with equal doc_id each get a row. A null doc_id stays null and never is the smallest;
    component_id is null only where all of a component's ids are. Texts count as a whole,
    however long. An empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, shingle), "simhash")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = materialise(connected_components(links(nodes.select("fp"), distance, block)), "simhash-roots")
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "simhash-nodes")
    # written first, so that both sides of the join are dealt anew and AQE can split a hot root
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", long_of_hex(F.col("fp")).alias("fingerprint"), "component_id")


def _near(values: np.ndarray, others: np.ndarray, limit: int) -> np.ndarray:
    return np.bitwise_count(values ^ others).sum(axis=1) <= limit


#: Rows of a unit up to which its pairs are compared row by row for the whole batch at once.
_SMALL = 16


def _verify_wide(limit: int, families: int):
    columns = [f"f{j}" for j in range(families)]

    def whole(cells: pd.DataFrame) -> tuple[list, list]:
        unit, node = cells["unit"].to_numpy(), cells["node"].to_numpy()
        values = cells[columns].to_numpy().view(np.uint64)
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]]) if len(unit) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.r_[first, len(unit)])
        small = np.repeat(size <= _SMALL, size)
        a: list[int] = []
        b: list[int] = []
        for lag in range(1, min(_SMALL, int(size.max(initial=0)))):
            i = np.flatnonzero(small[lag:] & (unit[lag:] == unit[:-lag]))
            i = i[_near(values[i], values[i + lag], limit)]
            a += node[i].tolist()
            b += node[i + lag].tolist()
        for at, n in zip(first[size > _SMALL].tolist(), size[size > _SMALL].tolist()):
            own, todo = values[at : at + n], np.ones(n, dtype=bool)
            for start in range(n):
                front = [start] if todo[start] else []
                todo[start] = False
                while front:
                    x = front.pop()
                    left = np.flatnonzero(todo)
                    near = left[_near(own[left], own[x], limit)]
                    todo[near] = False
                    front += near.tolist()
                    a += [int(node[at + x])] * len(near)
                    b += node[at + near].tolist()
        return a, b

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
            unit = frame["unit"].to_numpy()
            if not len(unit):
                continue
            changes = np.flatnonzero(unit[1:] != unit[:-1])
            cut = int(changes[-1]) + 1 if len(changes) else 0
            a, b = whole(frame.iloc[:cut])
            rest = frame.iloc[cut:]
            yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})
        if rest is not None:
            a, b = whole(rest)
            yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return run


#: ``near_copies``: words of a shingle, and least similarity of their sets.
WORDS = 5
SIMILARITY = 0.8
#: Families of 64 fingerprint bits; those whose bits are compared in a cell, and the share of
#: them in which candidates may differ (about 15 % do at a similarity of 0.8, with a deviation
#: of 2.6 %; half at none); families of least hashes.
MEET_FAMILIES = 4
CHECKED = 3
MEET_SHARE = 0.255
LEAST_FAMILIES = 12
#: The share of pairs of the least similarity that become candidates, were tables independent
#: (as they share families, it is 0.985 on sets of 300 shingles, and 0.996 at a similarity of
#: 0.85), and the share of bits in which such a pair agrees: 1 - arccos(2 s / (1 + s)) / pi.
RECALL = 0.998
AGREE = 0.8485
#: Fingerprint bits of a cell, at least; they grow with the logarithm of the number of texts.
_LEAST_BITS = 6
_FREE_BITS = 14
#: Shingles of a unit of texts, about.
_UNIT_SHINGLES = 1 << 20
#: Texts of a large group that all others are compared with.
PIVOTS = 4
#: Hashes of texts that are sent to all executors, at most (8 bytes each).
BROADCAST_ROWS = 1_000_000


def shingle_set(text: bytes | None, shingle: int = WORDS) -> np.ndarray:
    """Ascending hashes of the different shingles of UTF-8 ``text``; a shorter text is one."""
    return np.unique(_grams(text, shingle))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each of several families; of no hashes, the largest number."""
    if not len(hashes):
        return np.full(LEAST_FAMILIES, 2**64 - 1, dtype=np.uint64)
    return np.array([mix(hashes, 100 + j).min() for j in range(LEAST_FAMILIES)], dtype=np.uint64)


def similar(sets: list[np.ndarray], least: float = SIMILARITY) -> tuple[list[int], list[int]]:
    """Links (numbers of ``sets``) that connect just what pairs of a Jaccard similarity of
    ``least`` or more connect. Empty sets are copies of each other."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    empty = np.flatnonzero(sizes == 0).tolist()
    a, b = empty[:1] * (len(empty) - 1), empty[1:]
    names, flat = np.unique(np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]), return_inverse=True)
    before = np.r_[0, np.cumsum(sizes)]
    mark, todo = np.zeros(len(names) + 1, dtype=bool), sizes > 0
    for start in range(len(sets)):
        front = [start] if todo[start] else []
        todo[start] = False
        while front:
            x = front.pop()
            # only sets of a fitting size can reach the similarity
            left = np.flatnonzero(todo & (sizes >= least * sizes[x] * (1 - 1e-9)) & (sizes[x] >= least * sizes * (1 - 1e-9)))
            if not len(left):
                continue
            own_ids = flat[before[x] : before[x + 1]]
            mark[own_ids] = True
            hits = np.r_[0, np.cumsum(mark[flat])] if len(left) * 4 > len(sets) else None
            both = hits[before[left + 1]] - hits[before[left]] if hits is not None else np.array([np.count_nonzero(mark[flat[before[i] : before[i + 1]]]) for i in left])
            mark[own_ids] = False
            near = left[both >= least * (sizes[left] + sizes[x] - both) * (1 - 1e-9)]
            todo[near] = False
            front += near.tolist()
            a += [x] * len(near)
            b += near.tolist()
    return a, b


def _verify_texts(least: float, shingle: int):
    def whole(rows: list[tuple]) -> tuple[list, list]:
        a, b = similar([shingle_set(text, shingle) for _, text in rows], least)
        return [rows[i][0] for i in a], [rows[i][0] for i in b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for at, node, text in zip(batch.column("unit").to_pylist(), batch.column("node").to_pylist(), binary_column(batch, "text")):
                if at != unit:
                    x, y = whole(rows)
                    a, b, unit, rows = a + x, b + y, at, []
                rows.append((node, text))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        a, b = whole(rows)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def tables(n: int, families: int = MEET_FAMILIES, recall: float = RECALL) -> list[tuple[int, int, int, int]]:
    """The tables for ``n`` texts: two families of least hashes, a family of fingerprint bits,
    and a mask of the bits that are sampled. Texts of a similarity s have a family's least
    hash in common with probability s, so a cell holds texts that share shingles, and its bits
    part those that share few; there are so many tables that a pair of the least similarity
    has a cell in common with probability ``recall``."""
    bits = max(_LEAST_BITS, min(64, math.ceil(math.log2(max(n, 2))) - _FREE_BITS))
    count = math.ceil(math.log(1 - recall) / math.log(1 - SIMILARITY**2 * AGREE**bits))
    rng, pairs = np.random.default_rng(SEED), list(combinations(range(LEAST_FAMILIES), 2))
    order = rng.permutation(len(pairs)).tolist()
    out = []
    for t in range(count):
        mask = np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, bits, replace=False).astype(np.uint64))
        out.append((*pairs[order[t % len(pairs)]], t % families, int(mask.view(np.int64))))
    return out


def _candidates(nodes: DataFrame, names: list[str], share: float, block: int) -> DataFrame:
    """(node, root): groups of candidates. Texts of a cell are linked if they differ in few
    bits; those of a cell of more than ``block`` are all linked to the least of them, which
    is more than their bits say, and is left to the texts to decide."""
    cells = [F.xxhash64(F.lit(t), f"m{a}", f"m{b}", F.col(names[f]).bitwiseAND(F.lit(x))) for t, (a, b, f, x) in enumerate(tables(nodes.count(), len(names)))]
    points = nodes.select("node", F.explode(F.array(*cells)).alias("cell"))
    shared = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1")
    shared = materialise(points.join(shared, "cell"), "wide-simhash-shared")
    stars = shared.where(F.col("n") > block).where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    checked = names[:CHECKED]
    units = shared.where(F.col("n") <= block).select("node", F.col("cell").alias("unit")).join(nodes.select("node", *checked), "node")
    limit = int(share * 64 * len(checked))
    near = units.select("unit", "node", *checked).repartition("unit").sortWithinPartitions("unit", "node").mapInPandas(own("simhash", _verify_wide(limit, len(checked))), "a long, b long")
    return materialise(connected_components(near.unionByName(stars)), "wide-simhash-met")


def _pivot_links(shingle: int):
    """Similarities of each member's text to the pivots of its group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            out = []
            for text, pivot, other in zip(binary_column(batch, "text"), batch.column("pivot").to_pylist(), binary_column(batch, "pivot_text")):
                if pivot not in kept:
                    if len(kept) >= 4 * PIVOTS:
                        kept.clear()
                    kept[pivot] = shingle_set(other, shingle)
                x, y = shingle_set(text, shingle), kept[pivot]
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / max(1, len(x) + len(y) - both) if len(x) or len(y) else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("node", "root", "pivot")] + [pa.array(out, pa.float64())], ["node", "root", "pivot", "s"])

    return run


def _units(asked: DataFrame, block: int) -> DataFrame:
    """(unit, node) of ``asked`` (node, size, root, and ``inner``: whether the node has to meet
    only those that are not inner), so that all pairs of a root but inner ones meet in a unit:
    each set is cut into blocks of about ``block`` texts, and pairs of blocks are units."""
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("size") / _UNIT_SHINGLES)).cast("int")
    cut = materialise(asked.groupBy("root", "inner").agg(blocks.alias("blocks")), "wide-simhash-blocks")
    outer = cut.where("not inner").select("root", F.col("blocks").alias("outer"))
    inner = cut.where("inner").select(F.col("root").alias("r"), F.col("blocks").alias("inside"))
    counts = outer.join(inner, outer.root == inner.r, "left").select("root", "outer", F.coalesce("inside", F.lit(0)).alias("inside"))
    own_block = F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("inside")).otherwise(F.col("outer"))).cast("int")
    met = asked.join(counts, "root").withColumn("block", own_block)
    # an outer block meets the outer ones and the inner ones (counted from -1 down), an inner block the outer ones
    low = F.when(F.col("inner"), F.lit(0)).otherwise(-F.col("inside"))
    met = met.withColumn("other", F.explode(F.sequence(low, F.col("outer") - 1)))
    mine = F.when(F.col("inner"), -F.col("block") - 1).otherwise(F.col("block"))
    return met.select("node", F.xxhash64("root", F.least(mine, "other"), F.greatest(mine, "other")).alias("unit"))


def near_copies(docs: DataFrame, families: int = MEET_FAMILIES, share: float = MEET_SHARE, shingle: int = WORDS, block: int = BLOCK, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs`` (doc_id, text): groups of documents that
    pairs of a similarity of ``least`` or more connect, which is the Jaccard similarity of
    their sets of shingles of ``shingle`` words.

    Fingerprints only make candidates; the shingles of each group of candidates decide, so no
    link has a lesser similarity, and inside a group of candidates none is lost. A pair of
    the least similarity becomes a candidate with a probability of 0.985, a closer one with a
    higher one, and copies always do. In a group of more than ``block`` texts all are first
    compared with a few pivots; the texts that the best pivot has links to are not compared
    with each other, and with the others only where the triangle inequality of the Jaccard
    distance leaves a link possible. Nulls, empty texts, repeated rows and ids are treated as
    in ``near_duplicates``; other columns are ignored, texts of any length count as a whole.
    """
    names, mins = [f"f{j}" for j in range(families)], [f"m{j}" for j in range(LEAST_FAMILIES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size, values = [], [], []
            for text in binary_column(batch, "text"):
                found = shingle_set(text, shingle)
                node.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                size.append(len(found))
                values.append(np.concatenate([_majority(found, families), least_hashes(found)]).view(np.int64))
            values = np.array(values, dtype=np.int64).reshape(-1, len(names) + len(mins))
            columns = [batch.column("doc_id"), batch.column("place"), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(x)) for x in values.T)], ["doc_id", "place", "node", "size", *names, *mins])

    schema = "doc_id long, place long, node long, size long, " + ", ".join(f"{n} long" for n in names + mins)
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("place"), "text")
    fps = materialise(rows.mapInArrow(own("simhash", run), schema), "wide-simhash")
    nodes = fps.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("place").alias("place"), F.first("size").alias("size"), *(F.first(n).alias(n) for n in names + mins))
    nodes = materialise(nodes, "wide-simhash-nodes")
    met = _candidates(nodes, names, share, block)
    asked = nodes.select("node", "place", "size").join(met, "node")
    crowds = materialise(asked.groupBy("root").agg(F.count(F.lit(1)).alias("n")), "wide-simhash-crowds")
    asked = materialise(asked.join(crowds, "root").select("node", "place", "size", "root", (F.col("n") > block).alias("large")), "wide-simhash-asked")
    # the texts that are asked for, read once; few enough are picked out before any is sent
    source, places = rows.select("place", "text"), asked.select("place").distinct()
    if places.count() <= BROADCAST_ROWS:
        source = source.join(F.broadcast(places), "place", "left_semi")
    texts = source.join(asked.select("node", "place"), "place").dropDuplicates(["node"]).select("node", "text")
    texts = materialise(texts, "wide-simhash-texts")
    small = asked.where("not large").select("node", "size", "root", F.lit(False).alias("inner"))
    links_ = []
    if crowds.where(F.col("n") > block).isEmpty():
        units = _units(small, block)
    else:
        large = asked.where("large")
        pivots = large.groupBy("root", F.pmod(F.xxhash64("node"), F.lit(PIVOTS)).alias("i")).agg(F.min("node").alias("node"))
        pivots = pivots.join(texts, "node").select(F.col("root").alias("r"), F.col("node").alias("pivot"), F.col("text").alias("pivot_text"))
        pivots = materialise(pivots, "wide-simhash-pivots")
        members = large.select("node", "root").join(texts, "node")
        told = members.join(pivots, members.root == pivots.r).select("node", "root", "text", "pivot", "pivot_text").mapInArrow(own("simhash", _pivot_links(shingle)), "node long, root long, pivot long, s double")
        told = materialise(told, "wide-simhash-told")
        near = F.col("s") >= least * (1 - 1e-9)
        links_.append(told.where(near & (F.col("node") != F.col("pivot"))).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        count = told.groupBy("root", "pivot").agg(F.sum(near.cast("long")).alias("links"), F.max(F.when(~near, F.col("s"))).alias("next"))
        best = count.groupBy("root").agg(F.max(F.struct("links", "pivot", "next")).alias("best")).select(F.col("root").alias("r"), F.col("best.pivot").alias("p"), F.col("best.next").alias("next"))
        best = materialise(best, "wide-simhash-best")
        seen = told.join(best, (told.root == best.r) & (told.pivot == best.p)).where("next IS NOT NULL")
        # d(x, p) >= d(y, p) - (1 - least) for the nearest y without a link to p
        seen = seen.where(~near | (F.col("s") <= F.col("next") + (1 - least) + 1e-9)).select("node", "root", near.alias("inner"))
        rest = seen.join(nodes.select("node", "size"), "node").select("node", "size", "root", "inner")
        units = _units(small.unionByName(rest), block)
    found = units.join(texts, "node").select("unit", "node", "text").repartition("unit").sortWithinPartitions("unit", "node").mapInArrow(own("simhash", _verify_texts(least, shingle)), "a long, b long")
    for more in links_:
        found = found.unionByName(more)
    roots = materialise(connected_components(found), "wide-simhash-roots").withColumnRenamed("node", "member")
    rooted = nodes.join(roots, nodes.node == roots.member, "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = materialise(rooted, "wide-simhash-rooted")
    ids = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "wide-simhash-least")
    return fps.select("doc_id", "node").join(rooted.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "component_id")
