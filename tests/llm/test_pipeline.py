import random
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from shardloom.llm import mixing

from .test_langid import text
from .test_near_stage import near_stage
from .test_winnow import slow


def tables(spark, docs, folder, rows=None):
    r = random.Random(5)
    if rows is None:
        rows = []
        for i in range(160):
            lang = r.choice(["xx", "yy", "zz"])
            rows.append((i, text(r, lang, r.randint(15, 80)), f"s{i % 4}", lang))
        bench = [(i, text(r, "xx", 14)) for i in range(6)]
        rows += [(200 + i, rows[i][1], "s0", None) for i in range(20)]
        rows += [(300 + i, rows[30 + i][1] + " " + bench[i % 6][1], "s1", "xx") for i in range(9)]
        rows += [(400, None, None, None), (401, "1 2 3", "s1", "xx"), (402, "", "s2", None), (None, rows[50][1], None, "yy"), (7, *rows[7][1:])]
    else:
        bench = []
    frame = docs(rows).withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(1) for c in ("order", "score", "key", "doc", "copies", "row")})
    frame.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.mode("overwrite").parquet(f"{folder}/benchmark.parquet")
    return rows, bench


def test_each_stage_against_brute_force(spark, docs, tmp_path):
    d = str(tmp_path)
    rows, bench = tables(spark, docs, d)
    start = frame = spark.read.parquet(f"{d}/documents.parquet")

    def step(k, frame):
        out = cp.STAGES[k][1](spark, frame, d)
        out.write.parquet(f"{d}/{k}")
        return spark.read.parquet(f"{d}/{k}")

    kept = step(0, frame)
    assert kept.columns == start.columns
    gone = {r.doc_id for r in start.collect()} - {r.doc_id for r in kept.collect()}
    assert gone == {400, 401, 402}
    one = step(1, kept)
    have = [(r.doc_id, r.text) for r in kept.collect()]
    groups = {d for d, _ in near_stage([(d if d is not None else 10**9, t) for d, t in have])}
    left = [(r.doc_id, r.text) for r in one.collect()]
    assert len(left) == len(groups) and {d for d, _ in left if d is not None} <= groups
    clean = step(2, one)
    assert {r.doc_id for r in clean.collect()} == {x[0] for x in slow(left, bench) if not x[2]}
    mixed = step(3, clean).collect()
    assert spark.read.parquet(f"{d}/3").columns == start.columns
    size = lambda t: len((t or "").split())
    total, taken = {}, {}
    for r in clean.collect():
        total[r.source] = total.get(r.source, 0) + size(r.text)
    for r in mixed:
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    for s, t in mixing.targets(total).items():
        assert abs(taken.get(s, 0) - t) <= 90
    files = step(4, spark.read.parquet(f"{d}/3")).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
    want = sorted((r.doc_id or -1, len(ids(r.text)), zlib.crc32(ids(r.text).tobytes())) for r in mixed)
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in files) == want
    at = 0
    for r in sorted(files, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    whole = cp.run(spark, d).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, files))


def test_empty_tables(spark, docs, tmp_path):
    tables(spark, docs, str(tmp_path), [])
    assert cp.run(spark, str(tmp_path)).count() == 0
