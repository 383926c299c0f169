"""Suffix-array dedup: bytes covered by long strings that start twice anywhere in the corpus.

Only suffixes that can matter are sorted.  Every 400-byte window has an anchor gram of 200 bytes; windows whose gram
occurs once cannot repeat.  What is left meets by gram.  Within a group the suffixes are put in order by deep-shallow
sorting: multikey quicksort to SHALLOW bytes, then a blind trie for each set that is still tied; suffixes whose common
prefix is long enough stand next to each other.  A window may begin up to 200 bytes before its anchor, so suffixes are
sorted from several starts: for a range of starts, those that agree on what all its windows share go on, those that
agree on everything the windows touch are settled, and the rest is halved, down to single starts.

Equal contexts (128-bit digests) are one class with a count, so copies are never sorted against each other.  A group of
more than CAP classes is first dealt out by radix: for ranges of RANGE starts, by the bytes their windows share; parts of
up to CAP classes are sorted, larger ones are dealt out by single starts, where the key is the whole window.

Cases: a null text is empty; matches never cross rows; a text shorter than the window keeps everything, one of any length
is read whole; overlaps of a string with itself count; rows are documents, so equal rows are two places and long ones
go entirely, and rows that share an id or have none are each searched and cut as themselves; an empty table gives an
empty table; columns besides id and text are not read, so their names may clash.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import identified, settle, shuffle_parts
from .windows import CLASS, anchor_rows, contexts, cut_report, range_digests, window_digests

WINDOW = 400
#: Depth of the multikey quicksort before blind tries take over.
SHALLOW = 16
#: Classes that a task gathers and sorts; larger groups are dealt out by radix first.
CAP = 400
#: Starts that are dealt out as one range before single ones are.
RANGE = 16


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], items: list[int]) -> list[int]:
    """``items`` in the order of their strings.

    An inner node holds a position and its children by the byte there (-1: the string ends).  A string goes down by
    single bytes, is compared once with the leaf it reaches, and is hung in where they part.
    """
    root: list = [None, [items[0]]]  # leaf: [None, equal items]; inner node: [position, {byte: child}]
    for i in items[1:]:
        s = strings[i]
        node = root
        while node[0] is not None:
            p = node[0]
            node = node[1].get(s[p] if p < len(s) else -1) or next(iter(node[1].values()))
        t = strings[node[1][0]]
        n = common_prefix(s, t)
        if n == len(s) == len(t):
            node[1].append(i)
            continue
        at, key, node = None, None, root
        while node[0] is not None and node[0] < n:
            at, key = node, s[node[0]]
            node = node[1][key]
        mine = s[n] if n < len(s) else -1
        if node[0] == n:
            node[1][mine] = [None, [i]]
            continue
        new = [n, {mine: [None, [i]], (t[n] if n < len(t) else -1): node}]
        if at is None:
            root = new
        else:
            at[1][key] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of ``strings`` in sorted order."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        items, depth = stack.pop()
        if len(items) < 2:
            out += items
        elif depth >= shallow:
            out += blind_trie(strings, items)
        else:
            byte = [strings[i][depth] if depth < len(strings[i]) else -1 for i in items]
            pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
            same = [i for i, b in zip(items, byte) if b == pivot]
            if pivot < 0:
                stack.append(([i for i, b in zip(items, byte) if b > pivot], depth))
                stack.append((same, shallow))
                continue
            stack.append(([i for i, b in zip(items, byte) if b > pivot], depth))
            stack.append((same, depth + 1))
            stack.append(([i for i, b in zip(items, byte) if b < pivot], depth))
    return out


def tied(strings: list[bytes], items: list[int]) -> list[list[int]]:
    """Groups of two or more items with equal strings, by the sorted order's common prefixes."""
    order = deep_shallow(strings)
    groups, run = [], [order[0]]
    for a, b in zip(order, order[1:]):
        if len(strings[a]) == len(strings[b]) and common_prefix(strings[a], strings[b]) == len(strings[a]):
            run.append(b)
        else:
            if len(run) > 1:
                groups.append([items[i] for i in run])
            run = [b]
    if len(run) > 1:
        groups.append([items[i] for i in run])
    return groups


def repeated_offsets(ctx: list[bytes], a: list[int], nwin: list[int], settled: list[bool], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each context, ranges of offsets o (anchor minus window start) whose window also stands in another context.

    Contexts already ``settled`` only serve as the others.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in ctx]
    first = [x - n + 1 for x, n in zip(a, nwin)]
    if len(ctx) == 2:
        right = common_prefix(ctx[0][a[0] :], ctx[1][a[1] :])
        left = common_prefix(ctx[0][: a[0]][::-1], ctx[1][: a[1]][::-1])
        for i in (0, 1):
            low, high = max(window - right, first[i]), min(left, a[i])
            if low <= high:
                out[i].append((low, high))
        return out
    stack = [(list(range(len(ctx))), {i for i, s in enumerate(settled) if not s}, 0, window - window // 2)]
    while stack:
        items, todo, low, high = stack.pop()
        items = [i for i in items if first[i] <= high and a[i] >= low]
        todo = {i for i in items if i in todo}
        if len(items) < 2 or not todo:
            continue
        for group in tied([ctx[i][a[i] - low : a[i] - high + window] for i in items], items):
            mine = {i for i in group if i in todo}
            if not mine:
                continue
            if low == high:
                for i in mine:
                    out[i].append((low, low))
                continue
            whole = [i for i in group if first[i] <= low and a[i] >= high]
            if len(whole) > 1:
                for same in tied([ctx[i][a[i] - high : a[i] - low + window] for i in whole], whole):
                    for i in same:
                        if i in mine:
                            out[i].append((low, high))
                            mine.discard(i)
            if mine:
                middle = (low + high) // 2
                stack += [(group, mine, low, middle), (group, mine, middle + 1, high)]
    return out


def _sorted_groups(rows: DataFrame, window: int) -> DataFrame:
    """(fp, c1, c2, w1, w2): windows w1..w2 of a class, places in its text, that another class of its group has too.

    ``rows`` has the contexts with their group (k1, k2); a task holds one group.
    """
    parts = shuffle_parts(rows.sparkSession)
    columns = ("k1", "k2", "ctx", "a", "nwin", "n", "p1", "fp", "c1", "c2")
    types = (*[pa.int64()] * 3, pa.int32(), pa.int32())

    def work(batches):
        held, key = [], None

        def solve():
            ctx, a, nwin, n, p1, *of = [list(x) for x in zip(*held)]
            found = repeated_offsets(ctx, a, nwin, [x > 1 for x in n], window)
            at = lambda i, o: p1[i] + a[i] - o
            return [(*(x[i] for x in of), at(i, hi), at(i, lo)) for i in range(len(ctx)) if n[i] == 1 for lo, hi in found[i]]

        def emit(out):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], ["fp", "c1", "c2", "w1", "w2"])

        out = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                if row[:2] != key:
                    if len(held) > 1:
                        out += solve()
                    held, key = [], row[:2]
                held.append(row[2:])
            if len(out) > 20_000:
                yield emit(out)
                out = []
        if len(held) > 1:
            out += solve()
        if out:
            yield emit(out)

    return rows.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2").mapInArrow(work, "fp long, c1 long, c2 long, w1 int, w2 int")


def _radix_groups(docs: DataFrame, classes: DataFrame, window: int, cap: int, width: int = RANGE) -> DataFrame:
    """(fp, c1, c2, w1, w2) for the classes of large groups, dealt out by the bytes that their suffixes share.

    For each range of starts the group is split by what all windows of the range share: what is alone there repeats
    nothing, what agrees on all that is touched is settled, and a part of up to ``cap`` classes is sorted like any
    group.  A part beyond that is split once more, by single starts: there the key is the whole window, and equal keys
    are what the sorted order would put side by side.
    """
    ranges = settle(range_digests(docs, classes, window, width), "ranges")
    shared = ranges.groupBy("i1", "i2").agg(F.sum("n").alias("c")).where("c > 1").select("i1", "i2")
    alive = ranges.join(shared, ["i1", "i2"])
    name = F.struct(*CLASS)
    touched = alive.where("whole").groupBy("u1", "u2").agg(F.sum("n").alias("c"), F.min(name).alias("one")).where("c > 1")
    alive = settle(alive.join(touched, ["u1", "u2"], "left").withColumn("done", F.col("c").isNotNull() & F.col("whole")), "alive")
    place = classes.select(*CLASS, "row", "q", "p1", "p2")
    low, high = F.col("g") * width, F.col("g") * width + width - 1
    at = alive.join(place, list(CLASS))
    first, last = F.greatest(F.col("p1"), F.col("q") - high), F.least(F.col("p2"), F.col("q") - low)
    whole = at.where("n = 1 and done").select(*CLASS, first.alias("w1"), last.alias("w2"))
    # one class stands for each text that the second rule settled; it counts for all of its copies
    left = alive.where(~F.col("done") | (F.col("one") == name))
    size = left.groupBy("i1", "i2").agg(F.count("*").alias("k"), F.max((F.col("n") == 1) & ~F.col("done")).alias("todo")).where("todo and k > 1")
    times = F.when(F.col("done") | (F.col("n") > 1), 2).otherwise(1).cast("long")
    part = at.where(~F.col("done") | (F.col("one") == name)).join(size, ["i1", "i2"])
    part = settle(part.select(*CLASS, times.alias("n"), "row", "q", first.alias("p1"), last.alias("p2"), "i1", "i2", "k"), "part")
    few = part.where(F.col("k") <= cap)
    keyed = contexts(docs, few, window).join(few.select(*CLASS, "p1", F.col("i1").alias("k1"), F.col("i2").alias("k2")), [*CLASS, "p1"])
    sorted_ = _sorted_groups(keyed, window)
    digests = settle(window_digests(docs, part.where(F.col("k") > cap), window, False), "digests")
    twice = digests.groupBy("d1", "d2").agg(F.sum("n").alias("c")).where("c > 1").select("d1", "d2")
    one = digests.where("n = 1").join(twice, ["d1", "d2"]).select(*CLASS, F.col("p").alias("w1"), F.col("p").alias("w2"))
    return whole.unionByName(sorted_).unionByName(one)


def repeated_spans(docs: DataFrame, window: int = WINDOW, cap: int = CAP) -> DataFrame:
    """(row, s, e) for rows (doc_id, text, row): bytes covered by windows that start at two places or more."""
    anchors = settle(anchor_rows(docs.where("text is not null"), window, False).drop("doc_id"), "anchors")
    # settled, so that the join below has an exchange on both sides and Spark can split a gram with very many anchors
    grams = settle(anchors.groupBy("fp").agg(F.count("*").alias("total")).where("total > 1").select("fp"), "grams")
    met = settle(anchors.join(grams, "fp"), "met")
    first = F.min(F.struct("row", "q", "p1", "p2")).alias("f")
    classes = settle(met.groupBy(*CLASS).agg(F.count("*").alias("n"), first).select(*CLASS, "n", "f.*"), "classes")
    # a class that is alone under its gram has no other to be compared with
    groups = settle(classes.groupBy("fp").agg(F.count("*").alias("k")).where("k > 1"), "groups")
    open_ = settle(classes.join(groups, "fp"), "open")
    small = contexts(docs, open_.where(F.col("k") <= cap), window).withColumns({"k1": F.col("fp"), "k2": F.lit(0).cast("long")})
    found = _sorted_groups(small, window).unionByName(_radix_groups(docs, open_.where(F.col("k") > cap), window, cap))
    # of a class, windows are counted from its first; all of its members have them at the same places
    found = found.join(classes.select(*CLASS, F.col("p1").alias("base")), list(CLASS))
    found = found.select(*CLASS, (F.col("w1") - F.col("base")).alias("w1"), (F.col("w2") - F.col("base")).alias("w2"))
    whole = classes.where("n > 1").select(*CLASS, F.lit(0).alias("w1"), (F.col("p2") - F.col("p1")).alias("w2"))
    found = settle(whole.unionByName(found), "found")
    hit = met.select(*CLASS, "row", "p1").join(found, list(CLASS))
    return hit.select("row", (F.col("p1") + F.col("w1")).alias("s"), (F.col("p1") + F.col("w2") + window).alias("e"))


def suffix_dedup(docs: DataFrame, window: int = WINDOW, keep_text: bool = False, **options) -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept text."""
    docs = identified(docs)
    spans = settle(repeated_spans(docs, window, **options), "spans")
    return cut_report(docs, spans, False, keep_text=keep_text).withColumnRenamed("n_units", "n_bytes")
