"""Language identification by multilingual mixture inference.

A model holds, for each language, smoothed log probabilities of byte n-grams hashed into a
fixed number of cells. A document is cut into units of consecutive n-grams; each unit comes
from one language. Expectation-maximisation estimates the document's language proportions
from the units' likelihoods. The set of languages is selected by penalised likelihood: of
the leading one, two, ... languages of the full estimate, the set grows as long as its log
likelihood, less ``PENALTY`` times half the log of the number of units for each language,
rises. Equal shares go to the language that comes first by code point.

N-grams of the training rows are counted on the executors (one row per language, cell and
task) and summed by Spark; the driver sees languages x cells counts, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import binary_column, own, text_batches

N = 3
CELLS = 1 << 15
#: n-grams of a unit.
UNIT = 24
#: Training rows of each language, about: a documented bound for a classifier's sample.
SAMPLE = 4000
#: Languages that a model may have: its table (cells x languages) is sent to all executors.
#: More than these are refused, none is left out.
MOST_LANGUAGES = 200
PENALTY = 2.0
ROUNDS = 12
UNKNOWN = "und"

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: ASCII letters, and bytes of characters beyond ASCII, stand for themselves; others for a space.
_CLASS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_SHAPE = _LOWER.translate(_CLASS)


def _cells(data: np.ndarray) -> np.ndarray:
    """The cell of each n-gram of shaped bytes; runs of spaces were folded before."""
    x = data.astype(np.uint32)
    return ((x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(17)


def _shaped(text: bytes) -> bytes:
    return b" ".join([b"", *text.translate(_SHAPE).split(), b""])


def has_letter(text: bytes | None) -> bool:
    """Whether any character is a letter."""
    if not text:
        return False
    if text.translate(None, _NOT_ASCII_LETTERS):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


_NOT_ASCII_LETTERS = bytes(b for b in range(256) if not (0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))


class Model:
    """``langs`` and a table of log probabilities, cells x languages."""

    def __init__(self, langs: list[str], logp: np.ndarray):
        self.langs, self.logp = langs, logp

    def units(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods, units x languages, and the number of units of each text (1 at
        least)."""
        shaped = [_shaped(t) for t in texts]
        lengths = np.fromiter(map(len, shaped), np.int64, len(shaped))
        counts = np.maximum(lengths - 2, 0)
        cells = _cells(np.frombuffer(b"".join(shaped) + b"  ", np.uint8))
        n_units = np.maximum(-(-counts // UNIT), 1)
        begin = np.cumsum(lengths) - lengths
        first = np.repeat(begin, n_units) + (np.arange(int(n_units.sum())) - np.repeat(np.cumsum(n_units) - n_units, n_units)) * UNIT
        # n-grams that reach over a text's end count for nothing
        rows = self.logp[cells]
        ends = begin + counts
        rows[ends] = 0
        rows[ends + 1] = 0
        return np.add.reduceat(rows, np.minimum(first, len(rows) - 1), axis=0), n_units

    def predict(self, texts: list[bytes]) -> tuple[list[int], list[float], np.ndarray]:
        """The leading language, its proportion, and all proportions of each text."""
        like, n_units = self.units(texts)
        top = like.max(axis=1)
        prob = np.exp(like - top[:, None])
        begin = np.cumsum(n_units) - n_units
        base = np.add.reduceat(top, begin)

        def fit(mask: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Shares and log likelihoods of some texts over the languages of their masks."""
            sizes = n_units[rows]
            own_prob = prob if len(rows) == len(texts) else prob[np.repeat(begin[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]
            first = np.cumsum(sizes) - sizes
            share = mask / mask.sum(axis=1, keepdims=True)
            for _ in range(ROUNDS):
                own = own_prob * np.repeat(share, sizes, axis=0)
                total = own.sum(axis=1, keepdims=True) + 1e-300
                share = np.add.reduceat(own / total, first, axis=0) / sizes[:, None]
            total = (own_prob * np.repeat(share, sizes, axis=0)).sum(axis=1) + 1e-300
            return share, base[rows] + np.add.reduceat(np.log(total), first)

        k, rows = len(self.langs), np.arange(len(texts))
        best, _ = fit(np.ones((len(texts), k)), rows)
        rank = np.argsort(np.argsort(-best, axis=1, kind="stable"), axis=1)
        score = np.full(len(texts), -np.inf)
        for size in range(1, k + 1):
            share, found = fit((rank[rows] < size).astype(np.float64), rows)
            found = found - PENALTY * size * np.log(n_units[rows] + 1.0) / 2
            better = found > score[rows]
            rows, share = rows[better], share[better]
            if not len(rows):
                break
            best[rows], score[rows] = share, found[better]
        lead = best.argmax(axis=1)
        return lead.tolist(), np.clip(best[np.arange(len(texts)), lead], 0, 1).tolist(), best


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``rows`` (text, lang, key); nulls are left out. Of each language about
    ``sample`` rows are used, those of the smallest hashes of ``key`` and text."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text", F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)).alias("at"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros((CELLS, 0)))
    langs = sorted(sizes)
    some = F.lit(False)
    for lang in langs:
        some = some | ((F.col("lang") == lang) & (F.col("at") < F.lit(-(-sample * (1 << 20) // sizes[lang]))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {lang: np.zeros(CELLS, dtype=np.int64) for lang in langs}
        for whole in batches:
            for batch in text_batches(whole):
                for lang, text in zip(batch.column("lang").to_pylist(), binary_column(batch, "text")):
                    cells = _cells(np.frombuffer(_shaped(text), np.uint8)) if len(text) > 0 else []
                    if len(cells):
                        total[lang] += np.bincount(cells, minlength=CELLS)
        for i, lang in enumerate(langs):
            used = np.flatnonzero(total[lang])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), i), pa.int32()), pa.array(used, pa.int32()), pa.array(total[lang][used], pa.int64())], ["l", "cell", "n"])

    counts = np.zeros((CELLS, len(langs)))
    found = rows.where(some).select("lang", "text").mapInArrow(own("langid", count), "l int, cell int, n long").groupBy("l", "cell").agg(F.sum("n").alias("n"))
    got = found.toPandas()  # languages x cells at most
    counts[got["cell"], got["l"]] = got["n"]
    logp = np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * CELLS))
    return Model(langs, logp.astype(np.float32))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (with a column text) and lang_pred, score, lang_shares: the leading language
    of each row's whole text, its proportion (0 to 1), and the proportions of all languages
    of the selected set. A null text, or one without a letter, has ``und``, 0.0 and none; so
    has every text if the model knows no language. Columns of these names are replaced, other
    columns pass through. Repeated rows each get a row. A text counts as a whole, however
    long it is. An empty table gives an empty result.
    """
    langs, logp = model.langs, model.logp
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "lang_shares")]
    sent = docs.sparkSession.sparkContext.broadcast(logp)  # languages x cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(langs, sent.value)
        for whole in batches:
            for batch in text_batches(whole, 1 << 19):
                texts = binary_column(batch, "text")
                pred, score, shares = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
                rows = [i for i, t in enumerate(texts) if has_letter(t)] if langs else []
                if rows:
                    lead, top, best = own.predict([texts[i] for i in rows])
                    for i, x, s, b in zip(rows, lead, top, best):
                        pred[i], score[i] = langs[x], s
                        shares[i] = [(langs[j], float(b[j])) for j in np.flatnonzero(b > 1e-3).tolist()]
                kinds = pa.map_(pa.string(), pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(pred), pa.array(score), pa.array(shares, kinds)], [*kept, "lang_pred", "score", "lang_shares"])

    schema = T.StructType(list(docs.select(*kept).schema))
    schema = schema.add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("lang_shares", T.MapType(T.StringType(), T.DoubleType()))
    return docs.select(*kept).mapInArrow(own("langid", run), schema)


def held_out(doc_id="doc_id"):
    """Whether a document takes no part in training: crc32 of its id as text is 0 modulo 5."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def fold_model(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from the documents that are not held out (a null doc_id is not)."""
    return train(docs.where(~held_out()).select("text", "lang", F.col("doc_id").alias("key")), sample)
