"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

A text's canonical form is NFKC, full case folding, NFKC again, and runs of white space
folded to one space with none at the ends. Its fingerprint is two 64-bit xxhashes of that
form. Rows of an equal fingerprint are a bucket; inside buckets of several rows the canonical
bytes themselves are compared. Copies combine before the shuffle, so a text that a third of
all rows hold is one row per task, and a text that occurs once is not sent at all.

The document that follows another in ascending doc_id is found inside ranges of doc_id of
about equal size, and for the last of a range from a table of the first of each range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import long_of_hex, materialise, range_bounds, range_bucket

#: Rows of a range of doc_id, about, and the most ranges.
RANGE_ROWS = 2000
MOST_RANGES = 4096
#: Digests of several rows that are sent to all executors, at most (16 bytes each).
BROADCAST_ROWS = 1_000_000
_LEAST = -(2**63)


def canonical(text: Column) -> Column:
    """The canonical form of a text without nulls. White space is what Java's ``\\s`` and
    ``\\p{Z}`` match, and U+0085."""

    def icu(name: str, of: Column) -> Column:
        kind, method = name.split(".")
        package = {"Normalizer": "com.ibm.icu.text.Normalizer", "UCharacter": "com.ibm.icu.lang.UCharacter"}[kind]
        return F.reflect(F.lit(package), F.lit(method), of, F.lit(True))

    folded = icu("Normalizer.compose", icu("UCharacter.foldCase", icu("Normalizer.compose", text)))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(ascii_only, F.lower(text)).otherwise(folded), r"[\s\p{Z}\x85]+", " "))


def _digest(form: Column) -> list[Column]:
    return [F.xxhash64(form), F.xxhash64(F.lit("wide"), form)]


def _hex(upper: str, lower: str) -> Column:
    return F.concat(long_of_hex(F.col(upper)), long_of_hex(F.col(lower)))


def copies(docs: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """(h1, h2, class_id, n_copies, n_forms): for each digest of ``docs`` (doc_id, text), the
    smallest doc_id, the number of rows, and the number of different canonical texts, which
    is 1 unless two texts collide. A null text counts as an empty one.

    Digests are grouped alone (``digests``: doc_id, h1, h2, if the caller has them); only the
    canonical texts of digests that occur more than once are compared, and copies of one
    combine before the shuffle.
    """
    form = docs.select(canonical(F.coalesce("text", F.lit(""))).alias("form"))
    first, second = _digest(F.col("form"))
    if digests is None:
        digests = docs.select(F.col("doc_id").cast("long"), canonical(F.coalesce("text", F.lit(""))).alias("form")).select("doc_id", first.alias("h1"), second.alias("h2"))
    classes = materialise(digests.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n_copies")), "digest-classes")
    several = classes.where("n_copies > 1").select("h1", "h2")
    if several.count() <= BROADCAST_ROWS:
        several = F.broadcast(several)
    met = form.select(first.alias("h1"), second.alias("h2"), "form").join(several, ["h1", "h2"], "left_semi")
    forms = met.groupBy("h1", "h2", "form").agg(F.count(F.lit(1)).alias("n")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_forms"))
    return classes.join(forms, ["h1", "h2"], "left").withColumn("n_forms", F.coalesce("n_forms", F.lit(1)))


def _buckets(rows: DataFrame, range_rows: int) -> tuple[Column, list[int]]:
    n = rows.count()
    bounds = range_bounds(rows, "k", max(1, min(MOST_RANGES, -(-n // range_rows))))
    bucket = range_bucket("k", bounds)
    return bucket, sorted(r.b for r in rows.select(bucket.alias("b")).distinct().collect())  # MOST_RANGES at most


def fingerprints(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, class_id, n_copies.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document's; the first follows the last. Likeness of exact
    digests is 1.0 where they are equal and else 0.0. Null texts count as empty. Rows are
    ordered by doc_id (null as the least long), then text; equal rows each get a row. Other
    columns are ignored; texts count as a whole, however long. An empty table gives an empty
    result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.coalesce("doc_id", F.lit(_LEAST)))
    bucket, present = _buckets(rows.select("k"), range_rows)
    before = spark.createDataFrame([(b, present[i - 1]) for i, b in enumerate(present)], "bucket int, previous int")
    rows = rows.withColumn("bucket", bucket)
    # the first row of each range, for the last of the range before
    least = F.broadcast(rows.groupBy("bucket").agg(F.min("k").alias("k")))
    heads = rows.select("bucket", "k", "text").join(least, ["bucket", "k"]).groupBy("bucket").agg(F.min("text").alias("head"))
    heads = heads.join(F.broadcast(before), "bucket").select(F.col("previous").alias("bucket"), "head")
    order = Window.partitionBy("bucket").orderBy("k", "text")
    follow = rows.select("bucket", "doc_id", "text", F.lead("text").over(order).alias("next"), F.row_number().over(order).alias("rn"))
    follow = follow.join(heads, "bucket").withColumn("next", F.coalesce("next", "head"))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    follow = follow.select("bucket", "rn", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    forms = follow.select(
        "bucket", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), canonical(F.col("text")).alias("form"), canonical(F.col("edited")).alias("edited_form")
    )
    names = ("h1", "h2", "e1", "e2")
    digests = [c.alias(a) for a, c in zip(names, _digest(F.col("form")) + _digest(F.col("edited_form")))]
    slim = materialise(forms.select("bucket", "rn", "doc_id", "n_chars", "edited_sha256", *digests), "digests")
    order = Window.partitionBy("bucket").orderBy("rn")
    near = slim.select("*", F.lead("h1").over(order).alias("n1"), F.lead("h2").over(order).alias("n2"))
    first = slim.where("rn = 1").join(F.broadcast(before), "bucket").select(F.col("previous").alias("bucket"), F.col("h1").alias("f1"), F.col("h2").alias("f2"))
    near = near.join(F.broadcast(first), "bucket").join(materialise(copies(docs, slim.select("doc_id", "h1", "h2")), "digest-copies"), ["h1", "h2"])
    # 128 bits that agree for different texts would make them copies: stop rather than say so
    differ = F.raise_error(F.lit("two canonical texts have one digest")).cast("long")
    near = near.withColumn("n_copies", F.when(F.col("n_forms") > 1, differ).otherwise(F.col("n_copies")))
    same_next = (F.coalesce("n1", "f1") == F.col("h1")) & (F.coalesce("n2", "f2") == F.col("h2"))
    same_edited = (F.col("e1") == F.col("h1")) & (F.col("e2") == F.col("h2"))
    return near.select(
        "doc_id", "n_chars", "edited_sha256", _hex("h1", "h2").alias("fingerprint"), _hex("e1", "e2").alias("edited_fingerprint"),
        same_edited.cast("double").alias("near_edited"), same_next.cast("double").alias("near_next"), "class_id", "n_copies",
    )
