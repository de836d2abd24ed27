"""Cases that every operator has to take: nulls, empty and very long texts, ties, repeated rows,
empty tables, and extra columns whose names clash with those an operator uses inside."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom.llm import _common, digest, huffman, langid, licenses, lines, mixing, simhash, suffixes, tokens, winnow

CLASHES = (
    "a b c d e1 e2 h h1 h2 k n p s v w fp id at key row rows unit node cell root place places part parts order rank copies size bucket rn head previous "
    "next hits words uid item_id ids payload hi lo docs last shard salt gone start end spans ranges found order_ _row _order _p _source _file label "
    "score_ diagonal template inner outer blocks block other member least pivot large crowd form class_id n_copies fingerprint component_id f0 f1 band"
).split()


def bench(spark):
    return spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (2, "short one"), (None, "x"), (3, None)], "item_id long, text string")


OPERATORS = {
    "op1": lambda f: simhash.near_duplicates(f),
    "near_copies": lambda f: simhash.near_copies(f),
    "op2": lambda f: langid.identify(f.select("doc_id", "text"), langid.fold_model(f)).withColumn("lang_shares", F.to_json("lang_shares")),
    "op3": lambda f: licenses.summary(licenses.scan(f)),
    "op4": lambda f: mixing.mix(f),
    "op5": lambda f: tokens.count_tokens(f, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
    "op6": lambda f: digest.fingerprints(f),
    "op7": lambda f: huffman.round_trip(f, public_tokenizers.path("word_bpe_49k.json")),
    "op8": lambda f: winnow.decontaminate(f, bench(f.sparkSession)).drop("row"),
    "op9": lambda f: lines.dedup_lines(f),
    "op10": lambda f: suffixes.dedup_spans(f),
}


def rows_of():
    r = random.Random(17)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7)))
    long = "\n".join(" ".join(word() for _ in range(12)) for _ in range(4000))
    rows = [(i, " ".join(word() for _ in range(30)), f"s{i % 3}", "xx") for i in range(20)]
    rows += [(50, long, "s0", "yy"), (51, "same words " * 20_000, "s1", "yy"), (52, "x" * 200_000, None, None), (53, "alpha beta gamma delta epsilon zeta eta theta iota kappa " * 300, "s1", "xx")]
    rows += [(60, None, None, None), (61, "", "s0", "xx"), (62, " \n\t ", "s0", None), (63, "\n" * 50, None, "zz"), (None, "null id", "s2", None), (None, None, None, None)]
    return [*rows, *rows[:3], (0, "one id, another text", "s0", "xx"), *[(70, "tie", "s1", "yy")] * 4]


@pytest.mark.parametrize("name", list(OPERATORS))
def test_edges(docs, name):
    run, rows = OPERATORS[name], rows_of()
    plain = docs(rows)
    got = sorted(map(repr, (tuple(r) for r in run(plain).collect())))
    assert len(got) == len(rows) or name == "op5"
    clashing = plain.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)
    again = sorted(map(repr, (tuple(r) for r in run(clashing).collect())))
    assert got == again
    assert run(docs([])).count() == 0


def test_batches_are_bounded_by_rows_and_bytes():
    big = pa.RecordBatch.from_arrays([pa.array(["x" * (1 << 20)] * 40 + ["y"] * 5000)], ["text"])
    parts = list(_common.bounded(iter([big, big.slice(0, 0), "frame"])))
    assert parts[-1] == "frame" and sum(p.num_rows for p in parts[:-1]) == big.num_rows
    assert all(p.num_rows <= _common.BATCH_ROWS and (p.num_rows == 1 or p.nbytes <= 2 * _common.BATCH_BYTES) for p in parts[:-1])
    one = pa.RecordBatch.from_arrays([pa.array(["z" * (3 * _common.BATCH_BYTES)])], ["text"])
    assert [p.num_rows for p in _common.bounded(iter([one]))] == [1]


def test_no_setting_of_the_session_changes(spark, docs):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    lines.dedup_lines(docs([(1, "a")])).collect()
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
