"""Best-fit packing into sequences of several permitted lengths.

A document longer than the largest length is cut into pieces of that length and a rest.  Pieces are dealt to groups
by a hash, groups of a bounded number of pieces, and packed longest first.  A piece goes into the open bin with the
least room that still holds it.  If none does, a bin is opened: for every permitted length the rest of the group's
pieces tell how full such a bin could get, and the length with the least cost per word wins.  At the end every bin is
cut down to the smallest permitted length that holds its contents.

Cases: a null or blank text gives one row without a bin; a document of any length is cut whole; rows that share an id,
equal or not, and rows with a null id are packed one by one, their pieces under that id; of pieces of one length the
smaller id comes first, null last, then the piece, the text's hash and the copy, so that reruns agree; a document that
fills bins exactly leaves no rest; a table smaller than a group is one group; an empty table gives an empty table; only
id and text are read, so other columns' names may clash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, settle

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: Fixed cost of a sequence in words, besides its length.
OVERHEAD = 16
GROUP = 20_000


def _filled(first: int, room: int, left: np.ndarray, mask: int) -> int:
    """Words a bin opened with ``first`` words and ``room`` more could get from the pieces that are left, greedily."""
    got = first
    while room > 0:
        low = mask & ((1 << (room + 1)) - 1)
        if not low:
            break
        size = low.bit_length() - 1
        n = min(int(left[size]), room // size)
        got, room = got + n * size, room - n * size
        mask = low & ~(1 << size)
    return got


def pack(sizes: np.ndarray, lengths=LENGTHS, costs=None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin, offset) of each piece and the final length of each bin."""
    lengths = sorted(lengths)
    costs = costs or {c: c + OVERHEAD for c in lengths}
    most = lengths[-1]
    order = np.argsort(-sizes, kind="stable")
    left = np.bincount(sizes, minlength=most + 1)
    mask = 0
    for s in np.flatnonzero(left):
        mask |= 1 << int(s)
    rooms: list[list[int]] = [[] for _ in range(most + 1)]
    open_mask = 0
    bins, offsets, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    for i in order:
        size = int(sizes[i])
        left[size] -= 1
        if not left[size]:
            mask &= ~(1 << size)
        fit = open_mask >> size
        if fit:
            room = (fit & -fit).bit_length() - 1 + size
            b = rooms[room].pop()
            if not rooms[room]:
                open_mask &= ~(1 << room)
        else:
            able = [c for c in lengths if c >= size]
            room = min(able, key=lambda c: (costs[c] / _filled(size, c - size, left, mask), c))
            b = len(used)
            used.append(0)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        room -= size
        if room:
            rooms[room].append(b)
            open_mask |= 1 << room
    return bins, offsets, [next(c for c in lengths if c >= u) for u in used]


def pack_documents(docs: DataFrame, lengths=LENGTHS, group: int = GROUP, costs=None) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, seq_id, seq_offset, seq_length, seq_used.

    ``seq_id`` is unique; a sequence's pieces stand at their offsets without gaps and fill ``seq_used`` words.
    """
    most = max(lengths)
    # rows equal in id and text are counted and numbered, so every piece has a key that is the same in every run
    read = docs.select("doc_id", n_words(F.col("text")).alias("n"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    slim = settle(read.groupBy("doc_id", "h", "n").agg(F.count("*").alias("c")), "lengths")
    rows = slim.select("doc_id", "h", "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("c"))).alias("copy"))
    pieces = rows.select(
        "doc_id", "h", "copy", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("n") / most) - 1).cast("int"))).alias("piece")
    )
    first = F.col("piece").cast("long") * most
    pieces = pieces.select("doc_id", "h", "copy", "piece", first.alias("first_word"), F.least(F.lit(most), F.col("n") - first).cast("int").alias("n_words"))
    total = slim.agg(F.sum(F.col("c") * F.greatest(F.lit(1), F.ceil(F.col("n") / most)))).first()[0] or 0
    groups = max(1, -(-total // group))
    # copies differ by their number, so that they do not gather in one group
    dealt = pieces.where("n_words > 0").withColumn("g", F.pmod(F.xxhash64("doc_id", "h", "copy", "piece"), F.lit(groups)))

    def work(key, pdf):
        pdf = pdf.sort_values(["n_words", "doc_id", "piece", "h", "copy"], ascending=[False, True, True, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, final = pack(pdf["n_words"].to_numpy(), lengths, costs)
        used = np.bincount(bins, weights=pdf["n_words"]).astype(np.int64)
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"], "piece": pdf["piece"], "first_word": pdf["first_word"], "n_words": pdf["n_words"],
                "seq_id": (int(key[0]) << 32) + bins, "seq_offset": offsets, "seq_length": np.array(final)[bins], "seq_used": used[bins],
            }
        )

    schema = "doc_id long, piece int, first_word long, n_words int, seq_id long, seq_offset long, seq_length long, seq_used long"
    packed = dealt.groupBy("g").applyInPandas(work, schema)
    none = pieces.where("n_words <= 0").select(
        "doc_id", "piece", "first_word", "n_words", *[F.lit(None).cast("long").alias(c) for c in ("seq_id", "seq_offset", "seq_length", "seq_used")]
    )
    return packed.unionByName(none)
