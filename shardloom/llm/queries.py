"""The registered queries ``opN_<name>`` of this subpackage, with their production
parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import digest, huffman, langid, licenses, lines, mixing, simhash, suffixes, tokens, winnow
from ._common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``: doc_id, fingerprint, component_id."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_huffman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of ``documents`` from their files: doc_id, start, n_tokens, ids_crc32."""
    return huffman.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without repeated lines: doc_id, n_lines, n_dropped, kept_sha256."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


_OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, $$$$), chr(10)) AS ls FROM documents),
k AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
n AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        $$ABCDEFGHIJKLMNOPQRSTUVWXYZ$$, $$abcdefghijklmnopqrstuvwxyz$$) AS key FROM k),
f AS (SELECT key, max(doc_id) AS last FROM n WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT n.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL AND n.doc_id <> f.last) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL OR n.doc_id = f.last), $$$$)) AS kept_sha256
FROM n LEFT JOIN f ON n.key = f.key GROUP BY n.doc_id
"""


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` against ``benchmark``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


_OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, $$$$), $$ABCDEFGHIJKLMNOPQRSTUVWXYZ$$, $$abcdefghijklmnopqrstuvwxyz$$),
        $$[^\x00-\x2F\x3A-\x60\x7B-\x7F]+$$) AS ws FROM documents),
b AS (SELECT item_id, ws, least(10, len(ws)) AS m FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, $$$$),
        $$ABCDEFGHIJKLMNOPQRSTUVWXYZ$$, $$abcdefghijklmnopqrstuvwxyz$$), $$[^\x00-\x2F\x3A-\x60\x7B-\x7F]+$$) AS ws FROM benchmark)
      WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, m, array_to_string(ws[j:j + m - 1], chr(32)) AS gram
      FROM (SELECT item_id, m, ws, unnest(range(1, len(ws) - m + 2)) AS j FROM b)),
p AS (SELECT doc_id, m, j, array_to_string(ws[j:j + m - 1], chr(32)) AS gram FROM
      (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS j FROM w, (SELECT DISTINCT m FROM b) ms)),
h AS (SELECT p.doc_id, g.item_id, p.m, p.j FROM p JOIN g ON p.gram = g.gram AND p.m = g.m),
hit AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(j, j + m)) AS i FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, $$,$$ ORDER BY s) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, $$$$)) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op6_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical exact digests of ``documents`` and of their edited texts."""
    return digest.fingerprints(table(spark, sf_dir, "documents"))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each of ``documents``: doc_id, held_out, lang_pred, score, lang_shares."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fold_model(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "lang_shares")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` mixed to target weights: doc_id, size, source_size, target, taken, copies."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in ``documents``: doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score."""
    return licenses.summary(licenses.scan(table(spark, sf_dir, "documents")))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of ``documents``: doc_id, section, start, end, n_tokens, n_crossing."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = tokens.count_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return found.select("doc_id", "section", "start", "end", F.col("n_tokens").cast("long").alias("n_tokens"), "n_crossing")


def op10_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without repeated strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = suffixes.dedup_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_simhash": op1_simhash, "op7_huffman": op7_huffman, "op9_lines": op9_lines, "op8_decontaminate": op8_decontaminate, "op6_digest": op6_digest, "op2_langid": op2_langid, "op4_mix": op4_mix, "op3_license": op3_license, "op5_tokens": op5_tokens, "op10_suffix": op10_suffix}


def oracle_sql() -> dict[str, str]:
    return {"op8_decontaminate": _OP8_SQL, "op9_lines": _OP9_SQL}
