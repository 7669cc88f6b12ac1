"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters of the whole text are hashed. Document frequencies count every learnable document; the
weights are fitted by FTRL-proximal on a bounded sample of labelled rows, and a temperature on a part of the sample that
the weights have not seen.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import bounded_batches, count_table, cut, drawn, held_out, within
from strandloom.llm.ftrl import Ftrl, softmax, temperature
from strandloom.session import materialize, scratch

BITS = 18
#: The training sample: rows per language, rows in all, and distinct n-grams in all; whole texts of any length.
PER_LANGUAGE, SAMPLE_ROWS, SAMPLE_CELLS = 1000, 8000, 16_000_000
#: One in so many texts of the sample (by a hash of its n-grams, so that copies stay together) is kept for the temperature.
CALIBRATE = 5
SCALE, EPOCHS = 100.0, 3
#: A text is in no learned language if its share of familiar n-grams is below this part of what the least familiar hundredth of
#: the sample has.
FLOOR, LEAST = 0.5, 0.01
UNKNOWN = "und"

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """By code point: the lower-case letter, or a blank for what isn't a letter."""
    if not _LETTERS:
        table = np.full(0x110000, 32, np.uint32)
        for k in range(0x110000):
            c = chr(k)
            if c.isalpha():
                low = c.lower()
                table[k] = ord(low) if len(low) == 1 else k
        _LETTERS.append(table)
    return _LETTERS[0]


def has_letters(text: Column) -> Column:
    """Whether a text has a letter, as ``grams`` sees it; false for null."""
    return F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False))


def grams(text: str | None) -> np.ndarray | None:
    """Hashed n-grams of a whole text, one for each position and length (a number of ``BITS`` bits); None if it has no letter."""
    if not text:
        return None
    u = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = u == 32
    if blank.all():
        return None
    keep = np.ones(len(u), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    u = u[keep] * np.uint32(0x9E3779B1)
    two = (u[:-1] ^ np.uint32(0x5BD1E995)) * np.uint32(0x85EBCA6B) + u[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE35) + u[2:]
    g = np.concatenate([u, two * np.uint32(0x27D4EB2F), three * np.uint32(0x165667B1)])
    return (g ^ (g >> np.uint32(16))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)


class LanguageModel:
    """Languages, weights of the hashed n-grams that have any (idf folded in), biases and temperature; and ``floor``, the
    share of familiar n-grams below which a text is in none of the languages."""

    def __init__(self, languages: list[str], at: np.ndarray, weights: np.ndarray, bias: np.ndarray, t: float, floor: float = 0.0):
        self.languages, self.bias, self.t, self.floor = languages, bias, t, floor
        self.place = np.zeros(1 << BITS, np.int32)  # row 0 is for n-grams without a weight
        self.place[at] = np.arange(1, len(at) + 1)
        self.weights = np.vstack([np.zeros((1, len(bias))), weights]).astype(np.float32)

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """The language, its probability, and the share of the text's n-grams that have a weight."""
        g = grams(text)
        if g is None or not self.languages:
            return UNKNOWN, 0.0, 0.0
        place = self.place[g]
        p = softmax((self.weights[place].sum(axis=0, dtype=np.float64) / len(g) + self.bias) / self.t)
        k = int(p.argmax())
        return self.languages[k], float(p[k]), float(np.count_nonzero(place) / len(g))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Number of documents (column ``text``) with each hashed n-gram, and as the last entry the number with any."""

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for b in cut(batches):
            for text in b.column(0).to_pylist():
                g = grams(text)
                if g is not None:
                    g.sort()
                    total[g[np.flatnonzero(np.diff(g, prepend=np.uint32(0xFFFFFFFF)))]] += 1
                    total[-1] += 1
        return total

    return count_table(docs.select("text"), counts, (1 << BITS) + 1)


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, sample_rows: int = SAMPLE_ROWS, sample_cells: int = SAMPLE_CELLS, alpha: float = 0.5, l1: float = 0.02, l2: float = 1e-3) -> LanguageModel:
    """Learn from (doc_id, text, lang): all rows for the document frequencies, a bounded sample for the weights.

    Every language that a text with letters is labelled with is learned. The sample has ``per_language`` rows for each (fewer
    if that is over ``sample_rows`` in all, one at least), those with the smallest hashes of id, text and label: whole texts,
    whatever their length. The fit holds 16 bytes for each language and n-gram that occurs in the sample (of 2^18 hashes), so 4 MB a language at
    most, whatever the table's size. Of a language whose sample has more than its part of ``sample_cells`` distinct n-grams, the first
    rows by that hash are taken, one at least. A language that all of whose texts fall to the calibration is learned from
    them as well.
    """
    bounded_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return _fitted(docs, per_language, sample_rows, sample_cells, alpha, l1, l2)


def _fitted(docs: DataFrame, per_language: int, sample_rows: int, sample_cells: int, alpha: float, l1: float, l2: float) -> LanguageModel:
    labelled = docs.where("lang is not null").where(has_letters(F.col("text")))
    found = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(found)
    if not languages:
        return LanguageModel([], np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros(1), 1.0)
    df = document_frequencies(labelled)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    want = max(1, min(per_language, sample_rows // len(languages)))
    rows = labelled.select("lang", F.xxhash64("doc_id", "text", "lang").alias("draw"), "text")
    chosen = drawn(rows.select("lang", "draw"), "lang", dict.fromkeys(languages, want), found)
    rows = rows.join(F.broadcast(chosen), ["lang", "draw"]).dropDuplicates(["lang", "draw"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches, 100):
            out = []
            for text in b.column(2).to_pylist():
                g = grams(text)
                at, n = np.unique(g, return_counts=True) if g is not None else (np.zeros(0), np.zeros(0))
                out.append((len(at), at.astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes()))
            cols = [b.column(0), b.column(1), *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.binary(), pa.binary())))]
            yield pa.RecordBatch.from_arrays(cols, names=["lang", "draw", "cells", "at", "n"])

    sample = materialize(rows.mapInArrow(features, "lang string, draw long, cells long, at binary, n binary").where("cells > 0"), "language-sample")
    chosen = within(sample.select("lang", "draw", "cells"), "lang", sample_cells // len(languages)).select("lang", "draw")
    x, told = [], []
    for r in sample.join(chosen, ["lang", "draw"]).coalesce(4).toLocalIterator():  # the driver holds one form of a row at a time
        at, n = np.frombuffer(r["at"], np.uint32).astype(np.int32), np.frombuffer(r["n"], np.uint32)
        x.append((at, (SCALE * n / n.sum() * idf[at]).astype(np.float32)))
        told.append((r["draw"], r["lang"], zlib.crc32(r["at"]) % CALIBRATE == 0))
    order = sorted(range(len(x)), key=told.__getitem__)
    x, number = [x[k] for k in order], {v: k for k, v in enumerate(languages)}
    y, kept = np.array([number[told[k][1]] for k in order], np.int64), np.array([told[k][2] for k in order], bool)
    kept &= np.isin(y, y[~kept])  # a language's only rows are learned from
    model = Ftrl(1 << BITS, max(2, len(languages)), alpha=alpha, l1=l1, l2=l2)
    model.fit([f for f, k in zip(x, kept, strict=True) if not k], y[~kept], EPOCHS)
    t = temperature(model.scores([f for f, k in zip(x, kept, strict=True) if k]), y[kept]) if kept.any() else 1.0
    at, w, bias = model.sparse()
    known, k = np.zeros(1 << BITS, bool), len(languages)
    known[at] = True
    shares = [float((v / idf[a])[known[a]].sum() / SCALE) for a, v in x]
    return LanguageModel(languages, at, (SCALE * idf[at, None] * w)[:, :k], bias[:k], t, FLOOR * float(np.quantile(shares, LEAST)))


def predict(docs: DataFrame, model: LanguageModel, carry: tuple[str, ...] = ()) -> DataFrame:
    """``lang_pred``, ``score`` and ``familiar`` (the share of n-grams with a weight) of each row's whole text, beside the columns named in ``carry``, in one narrow pass."""
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = carry.index("text") if "text" in carry else len(carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in cut(batches):
            told = [sent.value.predict(t) for t in b.column(at).to_pylist()]
            cols = [*b.columns[: len(carry)], pa.array([x[0] for x in told], pa.string()), *(pa.array([x[i] for x in told], pa.float64()) for i in (1, 2))]
            yield pa.RecordBatch.from_arrays(cols, names=[*carry, "lang_pred", "score", "familiar"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "lang_pred string, score double, familiar double"])
    return docs.select(*carry, *([] if "text" in carry else ["text"])).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, familiar) of every row of (doc_id, text, lang).

    Rows with ``crc32(doc_id) mod 3 = 1`` are held out; only the others' text and non-null lang are learned from. A null
    text, or one without letters, is ``und`` with score 0, and so is every text if there is nothing to learn from. Repeated
    rows are predicted alike; an empty table gives an empty result; other columns are of no account.
    """
    rows = docs.selectExpr("cast(doc_id as long) as doc_id", "text", "lang").withColumn("held_out", held_out())
    return predict(rows, fit(rows.where("not held_out")), ("doc_id", "held_out"))
