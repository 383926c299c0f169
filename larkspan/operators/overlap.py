"""Pairs of users that share several items, without a row for each pair of users or items in a shuffle.

The users of each item travel as packed lists to ranges of users; in a range every pair is counted by one sort of numbers,
and only what the pairs with two items or more add to their pairs of items goes on, summed.  Ranges are dealt to passes,
each of which is written before the next begins, so that the disk holds the lists of one pass.  Lists beyond PIECE entries
are cut; a range is counted in steps of STEP pairs.  A range holds one user at least, with all lists above that user.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Entries of a list that travel in one row.
PIECE = 512
#: Pairs of users that a range is meant to hold, and that a worker counts at once.
RANGE_PAIRS = 1 << 22
STEP = 1 << 22
#: Pairs of users that travel in a pass: so many, or so many for each entry of the lists.
PASS_PAIRS = 1 << 24
PASS_SHARE = 4
#: Sums that a worker holds before it gives them away.
HELD = 1 << 21


def lists(pairs: DataFrame) -> DataFrame:
    """(item, piece, users): the different users of each item in order, in pieces; settled."""

    def cut(item, user):
        """Rows of (item, piece, users) of sorted, different entries."""
        first = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        at = np.flatnonzero(place % PIECE == 0)
        users = pa.ListArray.from_arrays(pa.array(np.append(at, len(user)).astype(np.int32)), pa.array(user))
        return item[at], (place[at] // PIECE).astype(np.int32), users

    def work(batches):
        item = user = np.zeros(0, np.int64)
        open_at = 0  # pieces of the open item that are out
        for b in batches:
            item = np.concatenate([item, b.column(0).to_numpy()])
            user = np.concatenate([user, b.column(1).to_numpy()])
            new = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (user[1:] != user[:-1])])) if len(item) else []
            item, user = item[new], user[new]
            if not len(item):
                continue
            done = int(np.searchsorted(item, item[-1], "left"))
            # the last entry stays, as the next batch may repeat it; of a long item whole pieces go
            whole = (len(item) - 1 - done) // PIECE
            go = done + whole * PIECE
            if go:
                i, p, u = cut(item[:go], user[:go])
                p[i == item[0]] += open_at
                open_at = whole + (open_at if item[0] == item[-1] else 0)
                item, user = item[go:], user[go:]
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(p), u], ["item", "piece", "users"])
        if len(item):
            i, p, u = cut(item, user)
            p[i == item[0]] += open_at
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(p), u], ["item", "piece", "users"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pairs.where("item is not null and user is not null").select(F.col("item").cast("long"), F.col("user").cast("long"))
    rows = rows.repartition(parts, "item").sortWithinPartitions("item", "user")
    return blocks.settled(rows.mapInArrow(work, "item long, piece int, users array<long>"), "lists")


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of sum(count) places its row, and its number within the row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _travelling(met: DataFrame, bounds: np.ndarray, first: int, last: int) -> DataFrame:
    """(range, item, own, ids): for the ranges first to last - 1, the ``own`` users of a list in the range, then those they
    meet: in one piece what stands above each, in two pieces (own < 0) all of the second."""

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                item = b.column(0).to_numpy()
                users, more = b.column(1), b.column(2)
                a, count = users.flatten().to_numpy(), users.value_lengths().to_numpy().astype(np.int64)
                other, oc = more.flatten().to_numpy(), more.value_lengths().to_numpy().astype(np.int64)
                row, _ = _spread(count)
                r = np.searchsorted(bounds, a, "right")
                begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (r[1:] != r[:-1])]))
                own = np.diff(np.append(begin, len(a)))
                end = np.cumsum(count)[row[begin]]
                two = oc[row[begin]] > 0
                take = (r[begin] >= first) & (r[begin] < last) & (two | (end - begin > 1))
                begin, own, end, two = begin[take], own[take], end[take], two[take]
                if not len(begin):
                    continue
                at_row = row[begin]
                head = np.where(two, own, end - begin)  # from the list itself
                tail = np.where(two, oc[at_row], 0)  # from the second piece
                all_ = np.concatenate([a, other])
                obegin = (np.cumsum(oc) - oc)[at_row] + len(a)
                src, k = _spread(head + tail)
                ids = all_[np.where(k < head[src], begin[src] + k, obegin[src] + k - head[src])]
                small = int(ids.min()) >= 0 and int(ids.max()) < 1 << 31
                data = ids.astype("<i4" if small else "<i8")
                off = np.concatenate([[0], np.cumsum(head + tail)]).astype(np.int32) * np.int32(data.itemsize)
                packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(off), pa.py_buffer(data)])
                own = np.where(two, -own, own).astype(np.int32)
                columns = [pa.array(r[begin].astype(np.int32)), pa.array(item[at_row]), pa.array(own), pa.array(np.full(len(begin), data.itemsize, np.int8)), packed]
                yield pa.RecordBatch.from_arrays(columns, ["range", "item", "own", "width", "ids"])

    return met.mapInArrow(work, "range int, item long, own int, width byte, ids binary")


def _received(b) -> tuple[np.ndarray, ...]:
    """(range, item, own, how many ids, ids) of a batch of ``_travelling``."""
    col = b.column(4)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data, width = np.frombuffer(col.buffers()[2], np.uint8), b.column(3).to_numpy().astype(np.int64)
    count = np.diff(off) // width
    if (width == width[0]).all():
        ids = data[off[0] : off[-1]].view(f"<i{width[0]}").astype(np.int64)
    else:
        ids = np.concatenate([data[s:e].view(f"<i{w}").astype(np.int64) for s, e, w in zip(off[:-1], off[1:], width)])
    return b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64), count, ids


def _sums(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, ...]:
    """w summed over equal (a, b)."""
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    at = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[at], b[at], np.add.reduceat(w, at) if len(at) else w


def _pairs_of_range(item, own, count, ids):
    """(row, size): rows of ``item`` in order of the pair of users that meets there, and how many each pair has, for pairs
    with two or more; step by step."""
    base = np.cumsum(count) - count
    two = own < 0
    own = np.abs(own)
    src, i = _spread(own)
    left = base[src] + i
    begin = np.where(two[src], base[src] + own[src], left + 1)  # the first that the user meets in this list
    end = (base + count)[src]
    names, number = np.unique(ids, return_inverse=True)
    u = number[left]
    # users one by one until a step is full; a pair never leaves its user
    order = np.argsort(u, kind="stable")
    src, u, begin, end = src[order], u[order], begin[order], end[order]
    total = np.cumsum(end - begin)
    users = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    until = np.append(users[1:], len(u))
    at = 0
    while at < len(users):
        before = total[users[at]] - (end - begin)[users[at]]
        to = max(at + 1, int(np.searchsorted(total[until - 1], before + STEP, "right")))
        s, e = users[at], until[to - 1]
        at = to
        # one user that fills several steps is cut by the users met
        cuts = -(-int((end[s:e] - begin[s:e]).sum()) // (2 * STEP)) or 1
        for c in range(cuts):
            low, high = len(names) * c // cuts, len(names) * (c + 1) // cuts
            from_, to_ = begin[s:e], end[s:e]
            if cuts > 1:
                from_ = np.array([x + np.searchsorted(number[x:y], low) for x, y in zip(begin[s:e], end[s:e])])
                to_ = np.array([x + np.searchsorted(number[x:y], high) for x, y in zip(begin[s:e], end[s:e])])
            row, k = _spread(to_ - from_)
            v = number[from_[row] + k]
            pair, where = (u[s:e] - u[s])[row] * len(names) + v, src[s:e][row]
            bits = max(1, int(len(item) - 1).bit_length())
            if len(pair) and int(pair.max()).bit_length() + bits < 63:
                x = np.sort((pair << bits) | where)
                pair, where = x >> bits, x & ((1 << bits) - 1)
            else:
                o = np.argsort(pair, kind="stable")
                pair, where = pair[o], where[o]
            first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
            size = np.diff(np.append(first, len(pair)))
            keep = size > 1
            first, size = first[keep], size[keep]
            if len(first):
                row, k = _spread(size)
                yield where[first[row] + k], size


def _added(item, where, size, alpha):
    """(item, other, w) that the pairs of users add, item < other, in steps."""
    made = size * (size - 1) // 2
    total, ends = np.cumsum(made), np.cumsum(size)
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, total[at] - made[at] + STEP, "right")))
        n = size[at:to]
        row, k = _spread(n)
        mine = item[where[ends[at] - size[at] : ends[to - 1]]]
        left, j = _spread(n[row] - 1 - k)
        a, b = mine[left], mine[left + 1 + j]
        yield _sums(np.minimum(a, b), np.maximum(a, b), 1.0 / (alpha + n[row][left]))
        at = to


def swing(lists_: DataFrame, alpha: float) -> DataFrame:
    """(item, other, w), item < other, to be summed: for each pair of users with n > 1 common items, 1 / (alpha + n)."""
    spark = lists_.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(10_000, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) or 10_000)))
    none = F.array().cast("array<long>")
    met = lists_.select("item", F.col("users").alias("a"), none.alias("b"))
    many = lists_.where("piece > 0").select("item").distinct()
    if not many.isEmpty():
        cut = lists_.join(many, "item", "left_semi")
        above = cut.select("item", F.col("piece").alias("p2"), F.col("users").alias("b"))
        met = met.unionByName(cut.join(above, "item").where("piece < p2").select("item", F.col("users").alias("a"), "b"))
    size = F.size("users").cast("long")
    per_item = lists_.groupBy("item").agg(F.sum(size).alias("n"))
    entries, pairs = per_item.agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long")).first()
    entries, pairs = entries or 0, pairs or 0
    ranges = max(1, -(-pairs // RANGE_PAIRS))
    bounds = []
    if ranges > 1:
        users = lists_.select(F.explode("users").alias("u"))
        bounds = users.approxQuantile("u", [i / ranges for i in range(1, ranges)], 1 / (8 * ranges))
    bounds = np.unique(np.array(bounds).astype(np.int64))
    ranges = len(bounds) + 1
    passes = min(ranges, max(1, -(-pairs // max(PASS_PAIRS, PASS_SHARE * entries))))

    def work(batches):
        held, held_rows = [], 0
        now, got = None, []

        def solve():
            item, own, count, ids = (np.concatenate(x) for x in zip(*got))
            for where, size in _pairs_of_range(item, own, count, ids):
                yield from _added(item, where, size, alpha)

        def give(sums):
            for i in range(0, len(sums[0]), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 500_000]) for x in sums], ["item", "other", "w"])

        def take(sums):
            nonlocal held, held_rows
            held.append(sums)
            held_rows += len(sums[0])
            if held_rows > 2 * HELD:
                one = _sums(*(np.concatenate(x) for x in zip(*held)))
                held, held_rows = [one], len(one[0])
                if held_rows > HELD:
                    held, held_rows = [], 0
                    yield from give(one)

        for b in batches:
            if not b.num_rows:
                continue
            of, item, own, count, ids = _received(b)
            at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            ends = np.concatenate([[0], np.cumsum(count)])
            for s, e in zip(at, np.append(at[1:], len(of))):
                if got and of[s] != now:
                    for sums in solve():
                        yield from take(sums)
                    got = []
                now = of[s]
                got.append((item[s:e], own[s:e], count[s:e], ids[ends[s] : ends[e]]))
        if got:
            for sums in solve():
                yield from take(sums)
        if held:
            yield from give(_sums(*(np.concatenate(x) for x in zip(*held))))

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = None
    for i in range(passes):
        first, last = ranges * i // passes, ranges * (i + 1) // passes
        mine = _travelling(met, bounds, first, last).repartition(max(parts, last - first), "range").sortWithinPartitions("range")
        one = blocks.settled(mine.mapInArrow(work, "item long, other long, w double"), "added")
        out = one if out is None else out.unionByName(one)
    return out
