"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of the lower-cased letters of the whole text (everything else is one separator).
Document frequencies are counted over all training documents.  The weights are fitted by follow-the-regularised-leader
with L1 and L2 penalties on a bounded sample of labelled rows, and a temperature is fitted on rows held back from it.
Scoring is linear in the n-gram occurrences, so a text of any length takes one pass.

Cases: a null text, or one without a letter, is ``und`` with score 0; a text whose n-grams the model never saw gets the
prior; texts of any length are read whole; rows are scored one by one, so repeated rows and ids agree and null ids are
scored like others (they are never held out); equal probabilities go to the language first by name; without training
rows everything is ``und``; an empty table gives an empty table; ``predict`` replaces clashing columns ``lang_pred`` and
``score``, ``keep_known`` leaves all columns alone.  The driver holds one row per language and the bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import bound_batches, free_names

BITS = 16
ORDERS = (1, 2, 3)
UND = "und"
#: Labelled rows the fit may use, over all languages; their sparse vectors are what the driver holds.
FIT_ROWS = 3000
FIT = {"alpha": 0.5, "beta": 1.0, "l1": 0.02, "l2": 0.02, "epochs": 3, "scale": 30.0}


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # features x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float
    scale: float


_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Lower-case code of every letter of the basic plane, 0 for all else."""
    if not _letters:
        t = np.zeros(1 << 16, dtype=np.uint32)
        for i in range(1 << 16):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low) if len(low) == 1 else i
        _letters.append(t)
    return _letters[0]


def _letters_of(data, off):
    """(lower-cased letters or 0 per character, character offsets of the documents)."""
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    table = _letter_table()
    out = np.where(chars < (1 << 16), table[np.minimum(chars, (1 << 16) - 1)], chars)
    for c in np.unique(chars[chars >= (1 << 16)]):
        if not chr(c).isalpha():
            out[chars == c] = 0
    return out, heads[off]


def _features(codes, off):
    """For each order: (feature of the n-gram at each position, which positions count)."""
    room = np.repeat(off[1:], np.diff(off)) - np.arange(len(codes))
    h = np.zeros(len(codes) + max(ORDERS), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        shifted = np.zeros_like(h)
        shifted[: len(codes) - n + 1] = codes[n - 1 :] if n <= len(codes) else 0
        h = (h * np.uint32(0x85EBCA6B)) ^ (shifted + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF))
        if n in ORDERS:
            g = h[: len(codes)]
            yield ((g ^ (g >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS), room >= n


def _per_document(codes, off):
    """All features of each document: (document number, features with repeats)."""
    parts = [f[ok] for f, ok in _features(codes, off)]
    docs = [np.repeat(np.arange(len(off) - 1), np.diff(off))[ok] for f, ok in _features(codes, off)]
    d, f = np.concatenate(docs), np.concatenate(parts)
    o = np.argsort(d, kind="stable")
    at = np.searchsorted(d[o], np.arange(len(off)), "left")
    f = f[o]
    for i in range(len(off) - 1):
        yield i, f[at[i] : at[i + 1]]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Number of documents with each feature, over all of ``docs``; a vector of fixed length per task is summed."""

    def work(batches):
        df, seen, n = np.zeros(1 << BITS, dtype=np.int64), np.zeros(1 << BITS, dtype=bool), 0
        for _, _, data, off in K.text_batches(batches):
            codes, at = _letters_of(data, off)
            for _, f in _per_document(codes, at):
                seen[f] = True
                df += seen
                seen[f] = False
                n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["f", "c"])

    rows = docs.select("text").mapInArrow(work, "f long, c long").groupBy("f").agg(F.sum("c").alias("c")).toPandas()
    out = np.zeros(1 << BITS, dtype=np.int64)
    real = rows.f >= 0
    out[rows.f[real].to_numpy()] = rows.c[real].to_numpy()
    return out, int(rows.c[~real].sum())


def _sample(docs: DataFrame, rows: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, features, counts) of about ``rows`` labelled documents, as many of each language as there are."""
    counts = {r[0]: r[1] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return []
    each = max(1, rows // len(counts))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, each / n)).otherwise(share)
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), F.lit(1 << 30)) / float(1 << 30)

    def work(batches):
        for batch, part, data, off in K.text_batches(batches):
            codes, at = _letters_of(data, off)
            feats = [np.unique(f, return_counts=True) for _, f in _per_document(codes, at)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang").slice(part[0], len(part)),
                    pa.array([f.astype(np.int32).tobytes() for f, _ in feats], pa.binary()),
                    pa.array([c.astype(np.int32).tobytes() for _, c in feats], pa.binary()),
                    batch.column("o").slice(part[0], len(part)),
                ],
                ["lang", "f", "c", "o"],
            )

    picked = docs.where(u < share).select("lang", "text", F.xxhash64("doc_id", F.lit(9)).alias("o"))
    got = picked.mapInArrow(work, "lang string, f binary, c binary, o long").toArrow().to_pylist()
    got.sort(key=lambda r: (r["o"], r["lang"]))
    return [(r["lang"], np.frombuffer(r["f"], np.int32), np.frombuffer(r["c"], np.int32).astype(np.float64)) for r in got if r["f"]]


def _softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(rows, idf: np.ndarray, alpha, beta, l1, l2, epochs, scale) -> Model:
    """Follow-the-regularised-leader with per-coordinate rates, then temperature on every fifth row."""
    langs = sorted({r[0] for r in rows})
    index = {x: i for i, x in enumerate(langs)}
    k = len(langs)
    z, n = np.zeros((len(idf) + 1, k)), np.zeros((len(idf) + 1, k))  # the last row is the bias

    def weights(f):
        zf, nf = z[f], n[f]
        w = -(zf - np.sign(zf) * l1) / ((beta + np.sqrt(nf)) / alpha + l2)
        w[np.abs(zf) <= l1] = 0.0
        return w

    def vector(f, c):
        x = c * idf[f]
        return np.append(f, len(idf)), np.append(x * (scale / max(x.sum(), 1e-9)), 1.0)

    vectors = [(index[lang], *vector(f, c)) for lang, f, c in rows]
    train = [v for i, v in enumerate(vectors) if i % 5] or vectors
    held = vectors[::5]
    for _ in range(epochs):
        for y, f, x in train:
            w = weights(f)
            g = _softmax(x @ w)
            g[y] -= 1.0
            g = np.outer(x, g)
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - sigma * w
            n[f] += g * g
    w = weights(np.arange(len(idf) + 1))
    logits = [(y, x @ w[f]) for y, f, x in held]

    def loss(t):
        return -sum(np.log(max(_softmax(v / t)[y], 1e-12)) for y, v in logits)

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 61))
    best = min(grid, key=loss)
    return Model(langs, w[:-1], w[-1], idf, float(best), scale)


def train(labelled: DataFrame, rows: int = FIT_ROWS, **options) -> Model | None:
    """A model from (doc_id, text, lang); all rows count for the document frequencies, a bounded sample for the fit."""
    bound_batches(labelled.sparkSession)
    labelled = labelled.where("lang is not null and text is not null")
    picked = _sample(labelled, rows)
    if not picked:
        return None
    df, n = document_frequencies(labelled)
    idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
    return fit(picked, idf, **{**FIT, **options})


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language and the score under the names ``into``; the text is the only input."""
    bound_batches(docs.sparkSession)
    docs = docs.drop(*into)
    if model is None:
        return docs.withColumns({into[0]: F.lit(UND), into[1]: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(
        ((model.weights * model.idf[:, None]).astype(np.float32).T.copy(), model.idf, model.bias, model.temperature, model.scale, model.langs)
    )

    def work(batches):
        table, idf, bias, temperature, scale, langs = shared.value
        names = np.array([*langs, UND], dtype=object)
        for batch, rows, data, off in K.text_batches(batches, text_col):
            codes, at = _letters_of(data, off)
            sums, mass = np.zeros((len(langs), len(rows))), np.zeros(len(rows))

            def add(values, to):
                c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
                to += c[at[1:]] - c[at[:-1]]

            for f, ok in _features(codes, at):
                add(idf[f] * ok, mass)
                for i in range(len(langs)):
                    add(table[i][f] * ok, sums[i])
            logits = (sums * (scale / np.maximum(mass, 1e-9)) + bias[:, None]) / temperature
            p = np.exp(logits - logits.max(axis=0))
            p /= p.sum(axis=0)
            best = p.argmax(axis=0)
            score = p[best, np.arange(len(rows))]
            c = np.concatenate([[0], np.cumsum(codes > 0)])
            none = c[at[1:]] == c[at[:-1]]
            best[none], score[none] = len(langs), 0.0
            part = batch.slice(rows[0], len(rows))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[best], pa.string()), pa.array(score)], [*part.schema.names, *into])

    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.StringType()), T.StructField(into[1], T.DoubleType())])
    return docs.mapInArrow(work, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that the fit never sees: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on the documents outside the held-out fold and label all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **options)
    slim = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return predict(slim, model).drop("text")


#: A document is rejected below this calibrated score.
LEAST_SCORE = 0.5


def keep_known(docs: DataFrame, least: float = LEAST_SCORE, **options) -> DataFrame:
    """``docs`` without those that no learned language fits: no letters, a null text, or a score below ``least``.

    All columns stay as they are, whatever their names; repeated rows stay or go together; without training rows, or
    with an empty table, nothing stays.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), **options)
    columns = docs.columns
    lang, score = free_names(docs, "lang_pred", "score")
    scored = predict(docs, model, "text", (lang, score))
    return scored.where((F.col(lang) != UND) & (F.col(score) >= least)).select(*columns)
