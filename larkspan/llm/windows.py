"""What the two substring operators share: anchors of repeated windows, their contexts and the final cut.

A window is a run of W units (bytes or words).  Its anchor is the least-hash gram of half its length, so equal windows
have equal anchors at equal offsets, and about four in W units are anchors.  The windows of one anchor, which follow
one another, form its context; anchors with equal grams and equal contexts form a class and share one verdict.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import bound_batches, ids_filter

#: What names a class: the gram's fingerprint and the digest of its context.
CLASS = ("fp", "c1", "c2")
PLACES = ("fp", "c1", "c2", "n", "q", "p1", "p2")


def digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _two(digests: list[bytes]) -> list[np.ndarray]:
    d = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
    return [d[:, 0].copy(), d[:, 1].copy()]


def anchor_rows(docs: DataFrame, window: int, words: bool) -> DataFrame:
    """Anchors of all windows of all rows (doc_id, text, row): gram fingerprint, 128-bit digest of the context, and places
    in the text.  Units are bytes or words."""

    def work(batches):
        for batch, rows, data, off in K.text_batches(batches):
            if words:
                start, end, at = K.words(data, off)
                rolling = K.Rolling(K.word_hashes(data, start, end))
                raw, begin, finish = K.joined_words(data, start, end)
            else:
                at, rolling, raw = off, K.Rolling.of_bytes(data), data.tobytes()
            d, fp, q, p1, p2 = K.anchors(rolling, at, window, window // 2)
            if not len(d):
                continue
            lo, hi = p1 + at[d], p2 + at[d] + window
            if words:
                lo, hi = begin[lo], finish[hi - 1]
            c1, c2 = _two([digest(raw[x:y]) for x, y in zip(lo.tolist(), hi.tolist())])
            part = batch.slice(rows[0], len(rows))
            who = [part.column(c).take(pa.array(d)) for c in ("doc_id", "row")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(fp.view(np.int64)), pa.array(c1), pa.array(c2), *who, *[pa.array(x.astype(np.int32)) for x in (q, p1, p2)]],
                ["fp", "c1", "c2", "doc_id", "row", "q", "p1", "p2"],
            )

    return docs.select("doc_id", "row", "text").mapInArrow(work, "fp long, c1 long, c2 long, doc_id long, row long, q int, p1 int, p2 int")


def at_texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(row, text, reps): the text of each representative with the list of its places; other texts stay put."""
    listed = reps.groupBy("row").agg(F.collect_list(F.struct(*PLACES)).alias("reps"))
    texts = ids_filter(docs.select("row", F.coalesce("text", F.lit("")).alias("text")), listed.select("row"), "row", "left_semi")
    return texts.join(listed, "row")


def _places(batch, i):
    r = batch.column("reps").slice(i, 1).flatten()
    return [r.field(c).to_numpy(zero_copy_only=False) for c in PLACES]


def contexts(docs: DataFrame, reps: DataFrame, window: int) -> DataFrame:
    """The bytes of each class's context: (fp, c1, c2, n, a, p1, nwin, ctx); a is the anchor's place in ctx."""

    def work(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py().encode()
                out += [(f, c, d, n, q - p1, p1, p2 - p1 + 1, raw[p1 : p2 + window]) for f, c, d, n, q, p1, p2 in zip(*(x.tolist() for x in _places(batch, i)))]
            if out:
                types = (*[pa.int64()] * 4, *[pa.int32()] * 3, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["fp", "c1", "c2", "n", "a", "p1", "nwin", "ctx"])

    return at_texts(docs, reps).mapInArrow(work, "fp long, c1 long, c2 long, n long, a int, p1 int, nwin int, ctx binary")


def window_digests(docs: DataFrame, reps: DataFrame, window: int, words: bool) -> DataFrame:
    """128-bit digests of every window of each class: (d1, d2, fp, c1, c2, p, n); p is the window's place in the text."""

    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, off = K.buffers(batch.column("text").slice(i, 1))
                if words:
                    start, end, _ = K.words(data, off)
                    raw, begin, finish = K.joined_words(data, start, end)
                else:
                    raw = data.tobytes()
                fp, c1, c2, n, q, p1, p2 = _places(batch, i)
                count = p2 - p1 + 1
                row = np.repeat(np.arange(len(fp)), count)
                p = p1[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                lo, hi = (begin[p], finish[p + window - 1]) if words else (p, p + window)
                d1, d2 = _two([digest(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist())])
                columns = [d1, d2, fp[row], c1[row], c2[row], p.astype(np.int32), n[row]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["d1", "d2", "fp", "c1", "c2", "p", "n"])

    return at_texts(docs, reps).mapInArrow(work, "d1 long, d2 long, fp long, c1 long, c2 long, p int, n long")


def range_digests(docs: DataFrame, reps: DataFrame, window: int, width: int) -> DataFrame:
    """Per class and range of ``width`` anchor offsets: the digest of the bytes that all windows of the range share and
    of the bytes that any of the class's windows there touches.

    (fp, c1, c2, n, g, i1, i2, u1, u2, whole): the range is g * width .. (g + 1) * width - 1, ``whole`` says that the
    class has all its windows.
    """
    names = ["fp", "c1", "c2", "n", "g", "i1", "i2", "u1", "u2", "whole"]

    def work(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw = batch.column("text")[i].as_py().encode()
                for f, c, d, n, q, p1, p2 in zip(*(x.tolist() for x in _places(batch, i))):
                    for g in range((q - p2) // width, (q - p1) // width + 1):
                        low, high = g * width, g * width + width - 1
                        first, last = max(p1, q - high), min(p2, q - low)  # the class's windows in the range
                        both = digest(raw[q - low : q - high + window]) + digest(raw[first : last + window])
                        out.append((f, c, d, n, g, *np.frombuffer(both, dtype=np.int64).tolist(), last - first == high - low))
            if out:
                types = (*[pa.int64()] * 4, pa.int32(), *[pa.int64()] * 4, pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)

    return at_texts(docs, reps).mapInArrow(work, "fp long, c1 long, c2 long, n long, g int, i1 long, i2 long, u1 long, u2 long, whole boolean")


def cut_report(docs: DataFrame, spans: DataFrame, words: bool, keep_text: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, row): doc_id, n_units, n_removed, n_spans, kept_sha256 and, if asked for,
    the kept text.

    ``spans`` has (row, s, e), half open, in units.  Kept bytes are concatenated, kept words joined by one space.
    """
    bound_batches(docs.sparkSession)
    listed = spans.groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    joined = docs.select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text")).join(listed, "row", "left")
    names = ["doc_id", "n_units", "n_removed", "n_spans", "kept_sha256"] + ["text"] * keep_text

    def work(batches):
        for batch, rows, data, off in K.text_batches(batches):
            start, end, at = K.words(data, off) if words else (None, None, off)
            raw = data.tobytes()
            part = batch.slice(rows[0], len(rows))
            lists = part.column("spans")
            total, removed, runs, shas, kept = [], [], [], [], []
            for i in range(len(rows)):
                n = int(at[i + 1] - at[i])
                gone_s, gone_e = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if lists[i].is_valid:
                    f = lists.slice(i, 1).flatten()
                    gone_s, gone_e = K.merge_spans(*[f.field(c).to_numpy().astype(np.int64) for c in ("s", "e")])
                left = zip(np.concatenate([[0], gone_e]).tolist(), np.concatenate([gone_s, [n]]).tolist())
                base = int(at[i])
                if words:
                    rest = b" ".join(raw[x:y] for lo, hi in left for x, y in zip(start[base + lo : base + hi].tolist(), end[base + lo : base + hi].tolist()))
                else:
                    rest = b"".join(raw[base + lo : base + hi] for lo, hi in left)
                total.append(n)
                removed.append(int((gone_e - gone_s).sum()))
                runs.append(len(gone_s))
                shas.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore") if keep_text else None)
            arrays = [part.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.string())] * keep_text, names)

    return joined.mapInArrow(work, "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string" + ", text string" * keep_text)
