import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shardloom.llm import huffman

PATH = public_tokenizers.path("word_bpe_49k.json")


def texts(seed=5):
    r = random.Random(seed)
    alphabet = "abcdefghij éßñ\n\t\x0b \x1c.,!?0123'ΣςÅÅ漢字🙂"
    out = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 60, 900]))) for _ in range(80)]
    return out + ["don't <|endoftext|>x we'll", "x" * 3000, " á ́b", None, ""]


def expected(rows):
    tok = Tokenizer.from_file(PATH)
    out, start = [], 0
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_round_trip(docs, block):
    rows = [(i * 7 % 85, t) for i, t in enumerate(texts())]
    got = huffman.round_trip(docs(rows), PATH, block_bytes=block).collect()
    assert sorted(tuple(r) for r in got) == expected(rows)


def test_empty_null_and_repeated(docs):
    assert huffman.round_trip(docs([]), PATH).count() == 0
    rows = [(None, "a b"), (2, "c"), (2, "c"), (1, None)]
    assert sorted((tuple(r) for r in huffman.round_trip(docs(rows), PATH).collect()), key=repr) == sorted(expected(rows), key=repr)


def test_codes_are_limited_and_optimal():
    r = random.Random(2)
    for limit in (5, 8, 16):
        freq = {i: int(1.9**i) + r.randrange(3) for i in range(28)}
        lengths = huffman.code_lengths(freq, limit)
        assert max(lengths.values()) <= limit
        assert sum(2.0 ** -n for n in lengths.values()) == 1
    import heapq

    heap = [(f, (i,)) for i, f in freq.items()]
    plain = dict.fromkeys(freq, 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for i in a[1] + b[1]:
            plain[i] += 1
        heapq.heappush(heap, (a[0] + b[0], a[1] + b[1]))
    wide = huffman.code_lengths(freq, 40)
    assert sum(freq[i] * wide[i] for i in freq) == sum(freq[i] * plain[i] for i in freq)


def test_cache_generations():
    small = huffman.PieceEncoder(PATH, cache=5)
    large = huffman.PieceEncoder(PATH)
    for t in texts(8):
        one = pa.array([t], pa.string())
        assert small(one, 1) == large(one, 1)
    with pytest.raises(ValueError):
        huffman.code_lengths(dict.fromkeys(range(5), 1), 2)


def test_pieces_give_what_whole_texts_give():
    pieces, whole = huffman.PieceEncoder(PATH, cache=50), huffman.WholeEncoder(PATH)
    some = pa.array(texts(11), pa.string())
    assert pieces(some, 1).to_pylist() == whole(some, 1).to_pylist()


def test_other_tokenizers_encode_whole_texts(docs, tmp_path):
    other = public_tokenizers.path("byte_bpe_50k.json")
    assert huffman.splits_at_spaces(PATH) and not huffman.splits_at_spaces(other)
    assert isinstance(huffman.encoder(other), huffman.WholeEncoder)
    tok = Tokenizer.from_file(other)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in huffman.round_trip(docs([(1, "two  words here"), (2, None)]), other, end_id=50256).collect()}
    ids = np.array([*tok.encode("two  words here", add_special_tokens=False).ids, 50256], dtype="<u4")
    assert got == {1: (len(ids), zlib.crc32(ids.tobytes())), 2: (1, zlib.crc32(np.array([50256], dtype="<u4").tobytes()))}
    said = open(PATH, encoding="utf-8").read()
    changed = tmp_path / "t.json"
    changed.write_text(said.replace('"Lowercase"', '"NFKC"', 1), encoding="utf-8")
    assert not huffman.splits_at_spaces(str(changed))


def test_an_id_that_very_many_rows_have_is_in_several_parts(spark, docs, tmp_path):
    r = random.Random(3)
    rows = [(5, " ".join(r.choice("abcdefg") for _ in range(r.randint(1, 9)))) for _ in range(600)] + [(i, "x") for i in range(100)]
    path = f"{tmp_path}/hot"
    huffman.write(docs(rows), path, PATH)
    parts = spark.read.parquet(path).selectExpr("part", "explode(doc_id) AS d").where("d = 5").groupBy("part").count().collect()
    assert len(parts) > 5 and max(p["count"] for p in parts) < 200
    got = huffman.read(spark, path).collect()
    got.sort(key=lambda x: x.start)
    assert [g.doc_id for g in got] == sorted(d for d, _ in rows)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))
    want = sorted((d, zlib.crc32(np.array([*Tokenizer.from_file(PATH).encode(t, add_special_tokens=False).ids, 1], dtype="<u4").tobytes())) for d, t in rows)
    assert sorted((g.doc_id, g.ids_crc32) for g in got) == want
