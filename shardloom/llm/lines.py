"""Line dedup with a sharded minimal perfect hash.

A line's key is hashed to 128 bits: the upper half names its shard, the lower half is what
the shard's minimal perfect hash maps to a place in compact arrays: a 64-bit fingerprint,
the number of documents, and the largest doc_id that holds the line. Counting combines
before each shuffle, so a line that very many documents hold is one row per task. A key of
one document can't drop and is left out of the index, in which a probe for it meets another
fingerprint or none; for all other keys the count says whether they drop.

Documents probe the arrays and are not joined with lines. The arrays go to all executors
only while they are at most ``broadcast_bytes``; beyond that, each shard's arrays go to
the distinct keys of that shard, in as many salted copies as the shard's rows ask for, and
each document gets back the keys that it drops.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import binary_column, kept, materialise, own
from .mph import MinimalHash

MIN_CHARS = 20
MIN_DOCS = 3
#: Keys of a shard, about.
SHARD_KEYS = 1 << 16
#: Arrays up to this size are sent to all executors.
BROADCAST_BYTES = 64 << 20
#: Keys that one task probes at once where the arrays are not sent to all.
PROBE_ROWS = 200_000
_SPACE = b" \t\n\x0b\x0c\r"
_INDEX = "shard long, n long, hash binary, fps binary, docs binary, last binary"


def _key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(_SPACE)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), dtype=">u8").reshape(-1, 2)
    return both[:, 0].astype(np.uint64), both[:, 1].astype(np.uint64)


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(hi, lo, doc_id): each key of each document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, sizes = [], []
            for text in binary_column(batch, "text"):
                keys = {_key(x, min_chars) for x in text.split(b"\n")} if text else set()
                keys.discard(None)
                found += keys
                sizes.append(len(keys))
            hi, lo = _halves(found)
            ids = batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), ids], ["hi", "lo", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(own("lines", run), "hi long, lo long, doc_id long")
    return rows.groupBy("hi", "lo", "doc_id").agg(F.count(F.lit(1)).alias("n_rows")).drop("n_rows")


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    lo = shard["lo"].to_numpy().view(np.uint64)
    lo, first = np.unique(lo, return_index=True)  # equal halves of two keys: one in 2**64
    table = MinimalHash.build(lo)
    place = table(lo)
    fps, docs, last = np.zeros(len(lo), np.uint64), np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
    fps[place], docs[place], last[place] = shard["hi"].to_numpy().view(np.uint64)[first], shard["n"].to_numpy()[first], shard["last"].to_numpy()[first]
    row = [shard["shard"].iloc[0], len(lo), table.to_bytes(), fps.tobytes(), docs.tobytes(), last.tobytes()]
    return pd.DataFrame([row], columns=[x.strip().split(" ")[0] for x in _INDEX.split(",")])


class Index:
    """Shards of a line index; ``drops`` tells which (key, document) pairs lose their lines."""

    def __init__(self, rows: list, shards: int, min_docs: int):
        self.shards, self.min_docs = shards, min_docs
        self.tables = {
            r["shard"]: (MinimalHash.from_bytes(r["hash"]), np.frombuffer(r["fps"], np.uint64), np.frombuffer(r["docs"], np.int64), np.frombuffer(r["last"], np.int64))
            for r in rows
        }

    def drops(self, hi: np.ndarray, lo: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hi), dtype=bool)
        shard = (hi >> np.uint64(1)).astype(np.int64) % self.shards
        for s in np.unique(shard).tolist():
            if s not in self.tables:
                continue
            table, fps, docs, last = self.tables[s]
            rows = np.flatnonzero(shard == s)
            place = table(lo[rows])
            known = place >= 0
            rows, place = rows[known], place[known]
            same = (fps[place] == hi[rows]) & (docs[place] >= self.min_docs)
            out[rows[same]] = last[place[same]] != doc_id[rows[same]]
        return out


#: Stands for a null doc_id, which is never the largest holder of a line.
_NO_ID = np.iinfo(np.int64).min
_indexes: dict[str, Index] = kept()


def _index_of(token: str, sent) -> Index:
    """A worker keeps the index of the last broadcast that it has seen."""
    if token not in _indexes:
        _indexes.clear()
        _indexes[token] = Index(*sent.value)
    return _indexes[token]


def _rewrite(decide, min_chars: int):
    """Rows of doc_id, n_lines, n_dropped, kept; ``decide(digests, owners, batch)`` tells which keyed lines go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split, keyed, owners, digests = [], [], [], []
            for row, text in enumerate(binary_column(batch, "text")):
                lines = text.split(b"\n") if text else [b""]
                split.append(lines)
                for at, line in enumerate(lines):
                    if key := _key(line, min_chars):
                        keyed.append(at)
                        owners.append(row)
                        digests.append(key)
            drop: list[set] = [set() for _ in split]
            if digests:
                out = decide(digests, np.array(owners), batch)
                for i in np.flatnonzero(out).tolist():
                    drop[owners[i]].add(keyed[i])
            kept = [b"\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else b"\n".join(lines) for lines, gone in zip(split, drop)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in split], pa.int64()), pa.array([len(x) for x in drop], pa.int64()), pa.array(kept, pa.binary()).view(pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept"],
            )

    return run


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) for each row of ``docs`` (doc_id, text).

    Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold
    lose all their lines but in the largest doc_id that holds them. Null and empty texts
    have one empty line. Rows of equal doc_id count as one document and are all returned;
    rows of null doc_id count as one that is smaller than all others. Texts count as a whole,
    however long or of however many lines. Other columns are ignored. An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    keys = line_keys(rows, min_chars)
    repeated = keys.groupBy("hi", "lo").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min(2, min_docs))
    repeated = materialise(repeated.withColumn("last", F.coalesce("last", F.lit(_NO_ID))), "lines-repeated")
    shards = max(1, -(-repeated.count() // shard_keys))
    sharded = F.pmod(F.shiftrightunsigned("hi", 1), F.lit(shards))
    index = materialise(repeated.withColumn("shard", sharded).groupBy("shard").applyInPandas(_build, _INDEX), "lines-index")
    size = index.agg(F.sum(sum(F.octet_length(c) for c in ("hash", "fps", "docs", "last")))).first()[0] or 0
    schema = "doc_id long, n_lines long, n_dropped long, kept string"
    if size <= broadcast_bytes:
        token = uuid.uuid4().hex
        sent = spark.sparkContext.broadcast(([r.asDict() for r in index.collect()], shards, min_docs))

        def decide(digests, owners, batch):
            hi, lo = _halves(digests)
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            return _index_of(token, sent).drops(hi, lo, ids[owners])

        return rows.mapInArrow(own("lines", _rewrite(decide, min_chars)), schema)

    keys = materialise(keys, "lines-keys")
    rows_of = keys.groupBy(sharded.alias("shard")).agg(F.count(F.lit(1)).alias("rows"))
    salted = rows_of.join(index.select("shard"), "shard").select("shard", F.ceil(F.col("rows") / PROBE_ROWS).cast("int").alias("salts"))
    probes = keys.withColumn("shard", sharded).join(salted, "shard")
    probes = probes.withColumn("salt", F.pmod(F.xxhash64("hi", "lo", "doc_id"), F.col("salts")).cast("int"))
    copies = index.join(salted, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def probe(lines: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(own):
            return lines[["doc_id", "hi", "lo"]].iloc[:0]
        hi, lo = lines["hi"].to_numpy(np.int64).view(np.uint64), lines["lo"].to_numpy(np.int64).view(np.uint64)
        ids = lines["doc_id"].fillna(_NO_ID).to_numpy(np.int64) if lines["doc_id"].isna().any() else lines["doc_id"].to_numpy(np.int64)
        return lines.loc[Index(own.to_dict("records"), shards, min_docs).drops(hi, lo, ids), ["doc_id", "hi", "lo"]]

    some = probes.select("shard", "salt", "doc_id", "hi", "lo").groupBy("shard", "salt").cogroup(copies.drop("salts").groupBy("shard", "salt"))
    gone = some.applyInPandas(probe, "doc_id long, hi long, lo long").groupBy("doc_id").agg(F.collect_list(F.struct("hi", "lo")).alias("gone"))
    gone = gone.withColumnRenamed("doc_id", "gone_id")

    def listed(digests, owners, batch):
        found = [{(k["hi"], k["lo"]) for k in row or ()} for row in batch.column("gone").to_pylist()]
        hi, lo = (x.view(np.int64).tolist() for x in _halves(digests))
        return np.array([(a, b) in found[row] for a, b, row in zip(hi, lo, owners.tolist())])

    joined = rows.join(gone, rows.doc_id.eqNullSafe(gone.gone_id), "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(own("lines", _rewrite(listed, min_chars)), schema)
