"""Mixing sources to target weights.

Each source is one stream of words, its documents in a pseudorandom order, cut into blocks of fixed length (the last
is shorter).  The mix is a row of slots; output shards draw how many slots each source gets, multinomially out of what
the sources have left, so that the totals are exact.  A source's slots run through pseudorandom permutations of its
block numbers, one permutation per pass, and slots and blocks are joined by block number.  A source's last slot is cut
so that the words taken equal its rounded target, and every block is taken at most once per pass.

Targets: sources by code point, null last, get the weights in turn; they share ``volume`` times all words; no target
exceeds ``repeats`` times its source, and the excess is shared out again by weight.

Every input row is a document: it gets a settled key of its own, so rows that share an id, and rows whose id is null,
are sized, mixed and kept one by one.

Cases: a null or blank text has size 0 and gives and takes nothing; a text of any length is counted and cut whole; a null
source is a source; a source without words has target 0; a null id is an id like any other; repeated rows are documents
of their own, interchangeable when all their columns agree; other columns are kept as they are, whatever their names; an
empty table gives an empty table; reruns agree.  The driver holds one row per source, and a plan of a row per output
shard, source and PLAN_ROW slots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernel as K
from .common import n_words, settle

WEIGHTS = (5, 2, 1)
VOLUME = 1.5
REPEATS = 2
BLOCK = 512
OUTPUT_SHARDS = 64
#: Documents whose positions are summed in one task, and slots in one row of the plan.
STREAM_PART = 4_000
PLAN_ROW = 65_536
_MASK = (1 << 64) - 1


def targets(sizes: dict, weights=WEIGHTS, volume: float = VOLUME, repeats: float = REPEATS) -> dict:
    """Target words of each source; ``sizes`` maps the source, possibly None, to its words."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out: dict = {}
    left, open_ = volume * sum(sizes.values()), list(names)
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > repeats * sizes[s]]
        if not over:
            out.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            out[s] = float(repeats * sizes[s])
        left -= sum(out[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    return out


def _round_keys(seed: int, source: int, turn: int) -> list[int]:
    return [int(K.mix(np.array([(seed * 1_000_003 + source * 7919 + turn * 104_729 + r * 31 + 1) & _MASK], dtype=K.U))[0]) for r in range(4)]


def permute(x: np.ndarray, n: int, keys: list[int], back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: a four-round Feistel network on the next even power of two, walked until
    the value falls below n.  ``back`` inverts it."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = K.U((1 << half) - 1)
    out = x.astype(K.U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> K.U(half), out[todo] & low
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (K.mix(left + K.U(key)) & low), left
            else:
                left, right = right, left ^ (K.mix(right + K.U(key)) & low)
        out[todo] = (left << K.U(half)) | right
        todo = todo[out[todo] >= K.U(n)]
    return out.astype(np.int64)


def _slots(size: int, target: float, block: int, seed: int, source: int) -> tuple[int, int, int]:
    """(slots, words of the last slot, blocks): full passes, then as many slots as the rest needs."""
    blocks = -(-size // block)
    want = int(target + 0.5)
    turns, rest = divmod(want, size)
    slots, last = turns * blocks, block
    if turns and permute(np.array([blocks - 1]), blocks, _round_keys(seed, source, turns - 1))[0] == blocks - 1:
        last = size - (blocks - 1) * block
    if rest:
        short_at = int(permute(np.array([blocks - 1]), blocks, _round_keys(seed, source, turns), back=True)[0])
        short = size - (blocks - 1) * block
        if rest <= short_at * block:
            n = -(-rest // block)
            last = rest - (n - 1) * block
        elif rest <= short_at * block + short:
            n, last = short_at + 1, rest - short_at * block
        else:
            after = rest - short_at * block - short
            n = short_at + 1 + -(-after // block)
            last = after - (n - short_at - 2) * block
        slots += n
    return slots, last, blocks


def draw(slots: list[int], shards: int, seed: int) -> np.ndarray:
    """Slots of each source in each output shard: multinomial draws out of what is left, with exact totals."""
    left, out = np.array(slots, dtype=np.int64), np.zeros((shards, len(slots)), dtype=np.int64)
    rng = np.random.default_rng(seed)
    for i in range(shards):
        need = int(left.sum()) // (shards - i)
        while need > 0:
            got = np.minimum(rng.multinomial(need, left / left.sum()), left)
            out[i] += got
            left -= got
            need -= int(got.sum())
    return out


def _keys(docs: DataFrame) -> list:
    """``_row``, a number of the row that is fixed only once it is settled, and ``_hash`` of all columns, which orders rows
    the same way in every run.  A null is told from a missing value by a flag."""
    flagged = [x for c in docs.columns for x in (docs[c], docs[c].isNull())]
    return [F.monotonically_increasing_id().alias("_row"), F.xxhash64(*flagged).alias("_hash")]


def streams(sizes: DataFrame) -> DataFrame:
    """(_row, source, size, start): where each document's words stand in its source's stream.

    Documents are dealt to parts by a hash; positions are a sum within the part plus the words of the parts before,
    so a source with most of the documents is no single task's work.
    """
    parts = max(1, -(-sizes.count() // STREAM_PART))
    tagged = sizes.withColumn("_p", F.pmod(F.xxhash64("_hash", F.lit(3)), F.lit(parts)))
    own = W.partitionBy("source", "_p").orderBy(F.xxhash64("_hash", F.lit(11)), "doc_id", "_row").rowsBetween(W.unboundedPreceding, -1)
    placed = tagged.withColumn("_own", F.coalesce(F.sum("size").over(own), F.lit(0)))
    before = W.partitionBy("source").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    base = tagged.groupBy("source", "_p").agg(F.sum("size").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    base = base.select(F.col("source").alias("_source"), F.col("_p").alias("_q"), "_before")
    joined = placed.join(base, (placed["_p"] == base["_q"]) & placed["source"].eqNullSafe(base["_source"]))
    return joined.select("_row", "source", "size", (F.col("_own") + F.col("_before")).alias("start"))


def mix(docs: DataFrame, weights=WEIGHTS, volume: float = VOLUME, repeats: float = REPEATS, block: int = BLOCK, shards: int = OUTPUT_SHARDS, seed: int = 1):
    """(sizes, pieces): sizes has _row, doc_id, source, size, source_size, target; pieces has one row per document and
    slot part: _row, turn, first (word of the document), words, shard, slot."""
    return _mix(docs.select(*_keys(docs), "doc_id", "source", n_words(docs["text"]).alias("size")), weights, volume, repeats, block, shards, seed)


def _mix(rows, weights=WEIGHTS, volume=VOLUME, repeats=REPEATS, block=BLOCK, shards=OUTPUT_SHARDS, seed=1):
    spark = rows.sparkSession
    slim = settle(rows, "sizes")
    total = {r["source"]: r["size"] for r in slim.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    goal = targets(total, weights, volume, repeats)
    names = list(goal)
    facts = [(s, i, total[s], goal[s]) for i, s in enumerate(names)]
    facts_df = F.broadcast(spark.createDataFrame(facts, "source_name string, source_no int, source_size long, target double"))
    sizes = slim.join(facts_df, F.col("source").eqNullSafe(F.col("source_name")))
    cut = {i: _slots(total[s], goal[s], block, seed, i) for i, s in enumerate(names) if total[s] and int(goal[s] + 0.5)}
    numbers = list(cut)
    drawn = draw([cut[i][0] for i in numbers], shards, seed) if numbers else np.zeros((0, 0), int)
    rows, at = [], dict.fromkeys(numbers, 0)
    for shard in range(len(drawn)):
        for j, i in enumerate(numbers):
            end = at[i] + int(drawn[shard, j])
            rows += [(shard, i, a, min(a + PLAN_ROW, end)) for a in range(at[i], end, PLAN_ROW)]
            at[i] = end
    plan = spark.createDataFrame(rows, "shard int, source_no int, a long, b long").repartition(max(1, len(rows) // 16))
    slots = plan.where("b > a").select("shard", "source_no", F.explode(F.sequence("a", F.col("b") - 1)).alias("slot"))

    def to_blocks(batches):
        for batch in batches:
            source, slot = batch.column("source_no").to_numpy(), batch.column("slot").to_numpy()
            number, turn, words = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64), np.full(len(slot), block, np.int64)
            for i in np.unique(source):
                n_slots, last, blocks = cut[int(i)]
                of = source == i
                turn[of] = slot[of] // blocks
                for t in np.unique(turn[of]):
                    now = of & (turn == t)
                    number[now] = permute(slot[now] % blocks, blocks, _round_keys(seed, int(i), int(t)))
                words[of & (slot == n_slots - 1)] = last
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(turn), pa.array(words)], [*batch.schema.names, "block", "turn", "take"])

    # the slots grow with the corpus: never broadcast, and the rows of the plan do not tell their number
    slots = slots.mapInArrow(to_blocks, "shard int, source_no int, slot long, block long, turn long, take long").hint("merge")
    at_ = streams(slim.where("size > 0")).join(facts_df, F.col("source").eqNullSafe(F.col("source_name")))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = at_.select("_row", "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    parts = parts.select(
        "_row", "source_no", "block", (low - F.col("start")).alias("first"), (low - F.col("block") * block).alias("inside"),
        (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - low).alias("have"),
    )
    pieces = parts.join(slots, ["source_no", "block"]).where(F.col("take") > F.col("inside"))
    pieces = pieces.select("_row", "turn", "first", F.least("have", F.col("take") - F.col("inside")).alias("words"), "shard", "slot")
    return sizes.select("_row", "doc_id", "source", "size", "source_size", "target"), pieces


def _rows(docs: DataFrame, **options) -> DataFrame:
    sizes, pieces = mix(docs, **options)
    taken = pieces.groupBy("_row").agg(F.sum("words").alias("taken"))
    return sizes.join(taken, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("_row")


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken."""
    return _rows(docs, **options).drop("source")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """``mix_rows`` summed over the rows that share an id, null included, and a source."""
    by_id = _rows(docs, **options).groupBy("doc_id", "source", "source_size", "target")
    out = by_id.agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row per document and pass with the words taken in that pass, the other columns kept.

    A document taken whole keeps its text as it is; of one taken in part the words stand joined by one space.
    Documents whose source gets less than one pass may be missing, those of sources with more appear twice.
    ``n_chars``, where there is one, is counted anew.  The documents are settled once with their keys, so that the rows
    that are sized are the rows that are cut.  The order of a source's words is a hash of the rows, so reruns agree.
    """
    columns = docs.columns
    # the document's own columns stand in a struct, so none of their names can clash
    held = settle(docs.select(*_keys(docs), F.struct(*[docs[c] for c in columns]).alias("_doc")), "keyed")
    _, pieces = _mix(held.select("_row", "_hash", "_doc.doc_id", "_doc.source", n_words(F.col("_doc.text")).alias("size")), **options)
    taken = pieces.groupBy("_row", "turn").agg(F.sort_array(F.collect_list(F.struct("first", "words"))).alias("_taken"))
    taken = settle(taken.drop("turn"), "taken")
    joined = held.drop("_hash").join(taken.hint("merge"), "_row").select("_doc", "_taken")

    def cut(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = batch.column("_doc").flatten()
            out = []
            for text, spans in zip(arrays[columns.index("text")].to_pylist(), batch.column("_taken").to_pylist()):
                raw = text.encode()
                start, end, _ = K.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                if sum(s["words"] for s in spans) >= len(start):
                    out.append(text)
                    continue
                keep = [w for s in spans for w in range(s["first"], s["first"] + s["words"])]
                out.append(b" ".join(raw[start[w] : end[w]] for w in keep).decode())
            arrays[columns.index("text")] = pa.array(out, pa.string())
            if "n_chars" in columns:
                at = columns.index("n_chars")
                arrays[at] = pa.array([len(t) for t in out], arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, columns)

    return joined.mapInArrow(cut, docs.schema)
