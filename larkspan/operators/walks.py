"""One step of walks from many starts, without a row for each path in a shuffle.

Starts are dealt to row blocks and targets to column blocks.  An entry (start, node) goes to the cells whose columns the
node leads to, an edge (node, target) to the cells whose rows have the node; a cell is one product of matrices in a worker,
so that a path is a multiplication only.  An entry or edge is never sent more often than it has paths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import _ends
from .overlap import _spread

#: Paths of a cell at most, if hashing deals them evenly; and what a cell has if there are fewer cells than partitions.
CELL_PATHS = 1 << 26
SMALL_CELL = 1 << 20
#: Entries, and edges, that a cell is meant to hold.
CELL_ROWS = 1 << 20
#: Numbers of a matrix that a worker holds, and paths that it takes at once where matrices would be mostly empty.
STEP = 1 << 21
#: Multiplications of a full product for each path, beyond which paths are summed one by one.
FULL = 50


def _matrix(row: np.ndarray, col: np.ndarray, v: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    return np.bincount(row * shape[1] + col, weights=v, minlength=shape[0] * shape[1]).reshape(shape)


def _cell(state, edge, direct, keep: float):
    """(start, target, value) of a cell from (node, start, v), (node, target, v) and (start, target, v), in steps."""
    (sn, ss, sv), (en, ed, ev), (ds, dd, dv) = state, edge, direct
    nodes = np.intersect1d(sn, en)
    a, b = np.isin(sn, nodes), np.isin(en, nodes)
    sn, ss, sv, en, ed, ev = sn[a], ss[a], sv[a], en[b], ed[b], ev[b]
    starts, targets = np.unique(np.concatenate([ss, ds])), np.unique(np.concatenate([ed, dd]))
    sn, en = np.searchsorted(nodes, sn), np.searchsorted(nodes, en)
    ss, ds, ed, dd = np.searchsorted(starts, ss), np.searchsorted(starts, ds), np.searchsorted(targets, ed), np.searchsorted(targets, dd)
    per_node = np.bincount(en, minlength=len(nodes))
    paths = int(per_node[sn].sum())
    size = len(starts), len(nodes), len(targets)
    positive = len(sv) and len(ev) and float(sv.min()) > 0 and float(ev.min()) > 0 and float(sv.min()) * float(ev.min()) * keep > 1e-290
    if positive and size[0] * size[1] <= 2 * STEP and float(size[0]) * size[1] * size[2] <= FULL * paths:
        left = _matrix(ss, sn, sv, size[:2])
        order, dorder = np.argsort(ed, kind="stable"), np.argsort(dd, kind="stable")
        en, ed, ev, ds, dd, dv = en[order], ed[order], ev[order], ds[dorder], dd[dorder], dv[dorder]
        wide = max(1, STEP // max(size[0], size[1]))
        for at in range(0, size[2], wide):
            n = min(wide, size[2] - at)
            s, e = np.searchsorted(ed, [at, at + n])
            got = left @ _matrix(en[s:e], ed[s:e] - at, ev[s:e], (size[1], n)) * keep
            there = got > 0
            s, e = np.searchsorted(dd, [at, at + n])
            np.add.at(got, (ds[s:e], dd[s:e] - at), dv[s:e])
            there[ds[s:e], dd[s:e] - at] = True
            row, col = np.nonzero(there)
            yield starts[row], targets[at + col], got[row, col]
        return
    order = np.argsort(en, kind="stable")
    ed, ev = ed[order], ev[order]
    first = np.cumsum(per_node) - per_node
    order, dorder = np.argsort(ss, kind="stable"), np.argsort(ds, kind="stable")
    sn, ss, sv, ds, dd, dv = sn[order], ss[order], sv[order], ds[dorder], dd[dorder], dv[dorder]
    # whole starts, as many as fit into a step
    total = np.cumsum(np.bincount(ss, weights=per_node[sn], minlength=size[0]).astype(np.int64) + np.bincount(ds, minlength=size[0]))
    at = 0
    while at < size[0]:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + STEP, "right")))
        s, e = np.searchsorted(ss, [at, to])
        row, k = _spread(per_node[sn[s:e]])
        by = first[sn[s:e]][row] + k
        o, p = np.searchsorted(ds, [at, to])
        start = np.concatenate([ss[s:e][row], ds[o:p]])
        target = np.concatenate([ed[by], dd[o:p]])
        v = np.concatenate([sv[s:e][row] * ev[by] * keep, dv[o:p]])
        at = to
        if len(v):
            order = np.lexsort((target, start))
            start, target, v = start[order], target[order], v[order]
            one = _ends(start * size[2] + target)
            yield starts[start[one]], targets[target[one]], np.add.reduceat(v, one)


def step(state: DataFrame, moves: DataFrame, lost: DataFrame, keep: float) -> DataFrame:
    """(seed, id, score): the sum over paths of score * p * keep of ``state`` (seed, id, score) and ``moves`` (src, dst, p),
    and of ``lost`` (seed, score), which goes to the seed itself.  Ids are integers and not null."""
    spark = state.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    f = state.groupBy(F.col("id").alias("src")).agg(F.count("*").alias("f"))
    g = moves.groupBy("src").agg(F.count("*").alias("g"))
    nf, ng, paths = (x or 0 for x in f.join(g, "src").agg(F.sum("f"), F.sum("g"), F.sum(F.col("f").cast("double") * F.col("g"))).first())
    cells = max(-(-int(paths) // CELL_PATHS), min(parts, -(-int(paths) // SMALL_CELL)), 1)
    columns = max(1, min(cells, round((cells * ng / max(1, nf)) ** 0.5)), -(-ng // CELL_ROWS))
    rows = max(1, -(-cells // columns), -(-nf // CELL_ROWS))
    row_of = lambda c: F.pmod(F.xxhash64(F.lit(1), F.col(c)), F.lit(rows))
    column_of = lambda c: F.pmod(F.xxhash64(F.lit(2), F.col(c)), F.lit(columns))
    leads = moves.groupBy("src").agg(F.collect_set(column_of("dst")).alias("c"))
    held = state.groupBy(F.col("id").alias("src")).agg(F.collect_set(row_of("seed")).alias("r"))
    out = lambda df, r, c, kind, a, b, v: df.select((r * columns + c).alias("cell"), F.lit(kind).cast("byte").alias("kind"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"), F.col(v).alias("v"))
    entries = state.withColumnRenamed("id", "src").join(leads, "src").withColumn("c", F.explode("c"))
    edges = moves.join(held, "src").withColumn("r", F.explode("r"))
    all_ = out(entries, row_of("seed"), F.col("c"), 0, "src", "seed", "score").unionByName(out(edges, F.col("r"), column_of("dst"), 1, "src", "dst", "p"))
    all_ = all_.unionByName(out(lost, row_of("seed"), column_of("seed"), 2, "seed", "seed", "score"))

    def work(batches):
        now, got = None, []

        def solve():
            kind, a, b, v = (np.concatenate(x) for x in zip(*got))
            for x in _cell(*((a[kind == n], b[kind == n], v[kind == n]) for n in range(3)), keep):
                for i in range(0, len(x[0]), 500_000):
                    yield pa.RecordBatch.from_arrays([pa.array(y[i : i + 500_000]) for y in x], ["seed", "id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, kind, a, b, v = (batch.column(n).to_numpy() for n in range(5))
            at = _ends(cell)
            for s, e in zip(at, np.append(at[1:], len(cell))):
                if got and cell[s] != now:
                    yield from solve()
                    got = []
                now = cell[s]
                got.append((kind[s:e], a[s:e], b[s:e], v[s:e]))
        if got:
            yield from solve()

    dealt = all_.repartition(max(parts, min(rows * columns, 4 * parts)), "cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(work, "seed long, id long, score double")
