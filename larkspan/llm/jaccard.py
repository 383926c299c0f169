"""N-gram Jaccard join with token-combination prefixes.

A document is its set of distinct k-word shingles, its tokens.  Tokens have one global order, rare ones first (by hash),
frequent ones last; two sets with Jaccard similarity t or more share a token in their prefixes of n - ceil(t * n) + 1
tokens, and at least two in prefixes longer by one.  So in the extended prefix

* each rare token is a key of its own;
* frequent tokens are keys in pairs.  Tokens that occur together make a class, named by the document with the least
  hash among those that index the token, and the keys are the pairs of classes: two sets that share two frequent tokens
  share the pair of their classes, and a document that indexes hundreds of tokens has a handful of classes.

Documents that meet under a key are candidates, and every link is decided on the shingles of the two whole texts.
Buckets of rare tokens with up to SMALL members give all their pairs, which are counted: the shared rare tokens and what
the sets have left after their prefixes must reach the overlap that is needed.  A rare token with more members belongs to
the class of its member with the least hash, and that class alone is a key.

In the buckets of classes every member is compared with two pivots, and links make components.  Only what stands outside
a bucket's largest component is then compared with the bucket, block by block and never within a component; a block
reports no more links than it needs to join components.  Texts, and blocks, travel in passes once they are many, and a
settled table goes as soon as no step reads it.  So a group of near copies never becomes all its pairs, nothing
unbounded is gathered in a task, and no component is missed.  Documents with equal sets are one vertex from the start.

The frequent tokens are found by counts over all documents, kept per batch of tokens when at least two; being an
order only, they decide the cost and never the result.

Cases: null and empty texts have no shingles and stay alone; a text with fewer than k words is one shingle; texts of any
length are read whole; the id is the vertex, so rows that repeat an id, with whatever texts, are one vertex with all
their links; a row with a null id is a vertex of its own together with rows of an equal set, its component is the
smallest id that it reaches, or null; ids from 2**62 on are kept for such rows and not supported; ties do not arise, a
component being named by its smallest id; an empty table gives an empty table; other columns are not read, so their
names may clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from . import kernel as K
from .common import forget, ids_filter, settle, shuffle_parts
from .components import components

SHINGLE = 5
#: Similarity in hundredths.
SIMILAR = 80
#: A token counted this often is frequent; at most FREQUENT_MAX tokens are (16 bytes each, broadcast).
FREQUENT = 48
FREQUENT_MAX = 400_000
#: Buckets of a rare token up to this size give all their pairs at once.
SMALL = 8
#: Classes of rare tokens up to this size are looked through by their tokens before whole sets are.
PRUNED = 512
#: Tokens of the documents in one block of a large bucket.
BLOCK_TOKENS = 1 << 18
#: Tokens, and rows of the index, gathered in a worker before they are worked on.
COUNT_BATCH = 3_000_000
GATHER = 200_000
#: The index is shuffled in this many passes, by token; tables of few tokens take one.
PASSES = 3
PASS_TOKENS = 4_000_000
#: Pairs whose texts travel at once, and bytes of token sets that travel to blocks at once; more take passes.
PASS_PAIRS = 1_000_000
PASS_BYTES = 1 << 30
#: Vertices of rows without an id lie from here on.
NO_ID = 1 << 62


def _sets(data, off, k):
    """Distinct lower-case shingles of each document of a chunk: (values sorted by document and hash, starts)."""
    data = K.LOWER[data]
    start, end, first = K.words(data, off)
    return K.distinct(*K.shingles(K.word_hashes(data, start, end), first, k))


def _digests(values, at):
    """128 bits of each set, order-free: two sums of scrambled tokens."""
    out = []
    for salt in (0x1234567, 0xABCDEF987):
        c = np.zeros(len(values) + 1, dtype=K.U)
        np.cumsum(K.mix(values ^ K.U(salt)), out=c[1:])
        out.append((c[at[1:]] - c[at[:-1]]).view(np.int64))
    return out


def _vertex():
    return F.coalesce("doc_id", F.lit(NO_ID) + F.col("h1").bitwiseAND(F.lit((1 << 61) - 1)))


def scan(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """One pass over the texts.  (doc_id, n, h1, h2): size and digest of each row's set; and (token, c), with n null:
    how often a token was seen in a batch, twice at least."""
    names = ["doc_id", "n", "h1", "h2", "token", "c"]

    def work(batches):
        held, size = [], 0

        def flush():
            v = np.sort(np.concatenate(held))
            at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
            c = np.diff(np.concatenate([at, [len(v)]]))
            twice = c > 1
            none = pa.nulls(int(twice.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(v[at][twice].view(np.int64)), pa.array(c[twice])], names)

        for batch, rows, data, off in K.text_batches(batches):
            values, at = _sets(data, off, k)
            h1, h2 = _digests(values, at)
            none = pa.nulls(len(rows), pa.int64())
            ids = batch.column("doc_id").slice(rows[0], len(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), pa.array(h1), pa.array(h2), none, none], names)
            held.append(values)
            size += len(values)
            if size >= COUNT_BATCH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(work, "doc_id long, n long, h1 long, h2 long, token long, c long")


def frequent_tokens(scanned: DataFrame, least: int = FREQUENT, most: int = FREQUENT_MAX) -> np.ndarray:
    """The most frequent shingles, sorted; at most ``most`` of them."""
    counts = scanned.where("token is not null").groupBy("token").agg(F.sum("c").alias("c"))
    top = counts.where(F.col("c") >= least).orderBy(F.desc("c"), "token").limit(most)
    return np.sort(top.toPandas()["token"].to_numpy(dtype=np.int64).view(np.uint64))


def _with_vertices(docs: DataFrame, k: int) -> DataFrame:
    """``docs`` with the vertex as doc_id; rows without an id come once for each set."""
    known = docs.where("doc_id is not null")
    rest = docs.where("doc_id is null")
    if rest.isEmpty():
        return known

    def work(batches):
        for batch, rows, data, off in K.text_batches(batches):
            h1, _ = _digests(*_sets(data, off, k))
            vertex = NO_ID + (h1 & ((1 << 61) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(vertex), batch.column("text").slice(rows[0], len(rows))], ["doc_id", "text"])

    named = rest.mapInArrow(work, "doc_id long, text string").groupBy("doc_id").agg(F.min("text").alias("text"))
    return known.unionByName(settle(named, "unnamed"))


def _needed(n: np.ndarray, similar: int) -> np.ndarray:
    """Least overlap that a set of size n has with any similar set: ceil(similar * n / 100)."""
    return -(-similar * n // 100)


def index_rows(docs: DataFrame, frequent: np.ndarray, k: int = SHINGLE, similar: int = SIMILAR, at_pass: int = 0, passes: int = 1) -> DataFrame:
    """(key, doc_id, n, rare, often): the tokens of each extended prefix; ``rare`` is how many of them are rare.  Of
    several passes each gives the tokens of its own."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)
    names = ["key", "doc_id", "n", "rare", "often"]

    def work(batches):
        known = shared.value
        for batch, rows, data, off in K.text_batches(batches):
            values, at = _sets(data, off, k)
            n = np.diff(at)
            doc = np.repeat(np.arange(len(n)), n)
            often = np.zeros(len(values), dtype=bool)
            if len(known):
                often = known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
            # values are in the order of their hashes already: the frequent ones move to each document's end
            o = np.argsort((doc << 1) + often, kind="stable")
            pos = np.arange(len(values)) - at[doc]
            reach = n - _needed(n, similar) + 2  # one more than the plain prefix
            take = o[pos < reach[doc]]
            d, f = doc[take], often[take]
            rare = np.bincount(d[~f], minlength=len(n))
            if passes > 1:
                own = K.mix(values[take]) % K.U(passes) == at_pass
                take, d, f = take[own], d[own], f[own]
            ids = batch.column("doc_id").slice(rows[0], len(rows)).to_numpy(zero_copy_only=False)
            for i in range(0, len(take), GATHER):
                s = slice(i, i + GATHER)
                columns = [values[take[s]].view(np.int64), ids[d[s]], n[d[s]].astype(np.int32), rare[d[s]].astype(np.int32), f[s]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names)

    return docs.select("doc_id", "text").mapInArrow(work, "key long, doc_id long, n int, rare int, often boolean")


def meet(rows: DataFrame, similar: int = SIMILAR, small: int = SMALL) -> DataFrame:
    """(a, b, na, nb, rest, c, key, class, often).

    Small buckets of rare tokens give pairs of fitting sizes, c times for c shared keys; ``rest`` is the most that two
    sets can share beyond the rare tokens of both prefixes: past the prefix that ends first, only the rest of that set
    is left.  The rows of frequent tokens, and of large buckets with their class, come back with b null and what is left
    of the one set as ``rest``.  A worker holds GATHER rows.
    """
    parts = shuffle_parts(rows.sparkSession)
    names = ["a", "b", "na", "nb", "rest", "c", "key", "class", "often"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]

    def batch_of(columns):
        return pa.RecordBatch.from_arrays([(x if isinstance(x, pa.Array) else pa.array(x)).cast(t) for x, t in zip(columns, types)], names)

    def pairs(key, doc, n, left):
        found = []
        for step in range(1, small):
            i = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else np.zeros(0, int)
            if not len(i):
                break
            j = i + step
            ok = (np.minimum(n[i], n[j]) * 100 >= similar * np.maximum(n[i], n[j])) & (doc[i] != doc[j])
            i, j = i[ok], j[ok]
            i, j = np.where(doc[i] < doc[j], i, j), np.where(doc[i] < doc[j], j, i)
            found.append(np.stack([doc[i], doc[j], n[i], n[j], np.maximum(left[i], left[j])], axis=1))
        if not found:
            return
        p = np.concatenate(found)
        if not len(p):
            return
        p = p[np.lexsort(p[:, :4].T[::-1])]
        new = np.flatnonzero(np.concatenate([[True], (p[1:, :4] != p[:-1, :4]).any(axis=1)]))
        c = np.diff(np.concatenate([new, [len(p)]]))
        zero = np.zeros(len(new), np.int64)
        yield batch_of([*p[new, :4].T, np.maximum.reduceat(p[:, 4], new), c, zero, zero, zero.astype(bool)])

    def work(batches):
        columns = ("key", "doc_id", "n", "rare", "often")
        held: list = []
        flowing, leader = None, None  # the key and the class of a large bucket whose rows go on

        def solve(last):
            nonlocal held, flowing, leader
            t = pa.Table.from_batches(held)
            key, doc, n, rare, often = (t.column(c).to_numpy() for c in columns)
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.concatenate([at, [len(key)]]))
            large = size > small
            large[0] |= key[0] == flowing
            # a class is the member with the least hash; of a bucket that goes on, the one that was named at first
            names_ = np.lexsort((K.mix(doc.view(np.uint64)), key))[at]
            classes = doc[names_]
            if key[0] == flowing:
                classes[0] = leader
            held = []
            if not last:
                if large[-1]:
                    flowing, leader = key[-1], classes[-1]
                else:
                    held = t.slice(int(at[-1])).combine_chunks().to_batches()
                    cut, size[-1] = int(at[-1]), 0
                    key, doc, n, rare, often = key[:cut], doc[:cut], n[:cut], rare[:cut], often[:cut]
            big = np.repeat(large, size) | often
            classes = np.repeat(classes, size)
            lone = np.repeat(size < 2, size) & ~big
            n, rare = n.astype(np.int64), rare.astype(np.int64)
            x = ~big & ~lone
            yield from pairs(key[x], doc[x], n[x], (n - rare)[x])
            if big.any():
                none = pa.nulls(int(big.sum()), pa.int64())
                yield batch_of([doc[big], none, n[big], none, (n - rare)[big], none, key[big], classes[big], often[big]])

        count = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count >= GATHER:
                yield from solve(False)
                count = sum(x.num_rows for x in held)
        if held:
            yield from solve(True)

    schema = "a long, b long, na int, nb int, rest int, c long, key long, class long, often boolean"
    # rows of frequent tokens only pass through, so they are dealt by document too
    spread = F.when(F.col("often"), F.col("doc_id")).otherwise(F.lit(0))
    return rows.repartition(parts, "key", spread).sortWithinPartitions("key").mapInArrow(work, schema)


def _fits(a, b, similar: int):
    return F.least(a, b).cast("long") * 100 >= similar * F.greatest(a, b).cast("long")


def _room(a, b, rest, similar: int):
    """Whether ``rest`` shared tokens make sets of sizes a and b similar."""
    return rest >= F.ceil(similar * (a.cast("long") + b.cast("long")) / F.lit(100.0 + similar) - 1e-9)


def counted_pairs(met: DataFrame, loads: DataFrame, similar: int) -> DataFrame:
    """(a, b, first): the pairs whose shared rare tokens and what is left after them reach the overlap that is needed, the
    tokens that both have in large buckets (``loads``) counted as shared; ``first`` marks each document's pair with most
    shared tokens."""
    # an id may have several texts: what was met of all of them, against the smallest
    c = met.where("b is not null").groupBy("a", "b").agg(*[f(x).alias(x) for f, x in ((F.sum, "c"), (F.max, "rest"), (F.min, "na"), (F.min, "nb"))])
    side = lambda x: loads.select(F.col("doc_id").alias(x), F.col("total").alias(f"t{x}"))
    c = c.join(side("a"), "a", "left").join(side("b"), "b", "left")
    shared = F.col("c") + F.least(F.coalesce("ta", F.lit(0)), F.coalesce("tb", F.lit(0)))
    kept = settle(c.where(_room(F.col("na"), F.col("nb"), shared + F.col("rest"), similar)).select("a", "b", "c"), "near")
    ends = kept.select(F.col("a").alias("x"), "a", "b", "c").unionByName(kept.select(F.col("b").alias("x"), "a", "b", "c"))
    best = ends.groupBy("x").agg(F.max_by(F.struct("a", "b"), F.struct("c", F.xxhash64("a", "b"))).alias("p")).select("p.*").distinct()
    return settle(kept.join(best.withColumn("first", F.lit(True)), ["a", "b"], "left").select("a", "b", F.coalesce("first", F.lit(False)).alias("first")), "near")


def class_keys(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, loads).

    keys has key, doc_id, n, rest, m: pairs of classes of frequent tokens, and single classes of rare tokens with large
    buckets; m is the number of members.  For the latter it has the document's tokens in the class (``tokens``) and how
    many it has in all such classes (``total``).  loads has doc_id and total.
    """
    rows = met.where("b is null").select("key", F.col("a").alias("doc_id"), F.col("na").alias("n"), "rest", "often", "class")
    often = rows.where("often").drop("class")
    named = often.groupBy("key").agg(F.min_by("doc_id", F.xxhash64("doc_id", F.lit(5))).alias("class"), F.count("*").alias("m"))
    named = settle(named.where("m > 1").drop("m"), "classes")
    own = often.join(named, "key").groupBy("doc_id", "n", "rest", "class").agg(F.count("*").alias("t"))
    lists = own.groupBy("doc_id", "n", "rest").agg(F.sort_array(F.collect_list(F.struct("class", "t"))).alias("cs"))
    one = lists.select("doc_id", "n", "rest", "cs", F.posexplode("cs").alias("p", "x"))
    two = one.select("doc_id", "n", "rest", "x", F.explode(F.slice("cs", F.col("p") + 1, F.size("cs"))).alias("y"))
    # the pair of a class with itself takes two tokens of it
    two = two.where((F.col("x.class") != F.col("y.class")) | (F.col("x.t") > 1))
    pairs = two.select(F.xxhash64("x.class", "y.class").alias("key"), "doc_id", "n", "rest", F.lit(None).cast("array<bigint>").alias("tokens"), F.lit(None).cast("long").alias("total"))
    listed = settle(rows.where("not often").groupBy("doc_id", "n", "rest", "class").agg(F.collect_list("key").alias("tokens")), "alone")
    loads = settle(listed.groupBy("doc_id").agg(F.sum(F.size("tokens")).alias("total")), "loads")
    alone = listed.join(loads, "doc_id").select(F.xxhash64("class").alias("key"), "doc_id", "n", "rest", "tokens", "total")
    every = settle(pairs.unionByName(alone), "keys")
    forget(listed)
    # buckets with the same members are one
    same = every.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("doc_id", "n")).alias("x1"), F.bit_xor(F.xxhash64("n", "doc_id", F.lit(1))).alias("x2"))
    chosen = settle(same.where("m > 1").groupBy("m", "x1", "x2").agg(F.min("key").alias("key")).select("key", "m"), "chosen")
    keys = settle(every.join(chosen, "key"), "keys")
    forget(every)
    return keys, loads


def pivot_pairs(keys: DataFrame, similar: int) -> DataFrame:
    """(a, b): every member a of a bucket with its two pivots b, of the sizes that fit and with enough shared tokens.

    This only chooses what is tried first: a pair that is left out here meets again in ``cross_links``.
    """
    keys = keys.select("key", "doc_id", "n", F.size("tokens").alias("t"), F.col("tokens").isNull().alias("often"), "rest")
    row = F.struct("doc_id", "n", "t", "rest")
    ends = keys.groupBy("key").agg(*[F.min_by(row, F.xxhash64("doc_id", F.lit(s))).alias(f"p{s}") for s in (5, 6)])
    met = keys.join(ends, "key")
    out = None
    for s in (5, 6):
        shared = F.least("t", F.col(f"p{s}.t")) + F.greatest("rest", F.col(f"p{s}.rest"))
        one = met.where((F.col(f"p{s}.doc_id") != F.col("doc_id")) & _fits(F.col("n"), F.col(f"p{s}.n"), similar))
        one = one.where(F.col("often") | _room(F.col("n"), F.col(f"p{s}.n"), shared, similar))
        one = one.select(F.col("doc_id").alias("a"), F.col(f"p{s}.doc_id").alias("b"))
        out = one if out is None else out.unionByName(one)
    return out


def verify(pairs: DataFrame, docs: DataFrame, k: int = SHINGLE, similar: int = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose sets are similar, decided on the shingles of the whole texts; of an id with several texts
    one is enough.  The texts of b travel to those of a, so b should be what many pairs share.

    Many pairs are dealt to passes by b, so that the ids of a pass can be broadcast and only texts that are needed travel;
    their shuffle files go with the pass."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    pairs = pairs.groupBy(lo.alias("lo"), hi.alias("hi")).agg(F.max("b").alias("b"))
    pairs = settle(pairs.select(F.when(F.col("b") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("a"), "b"), "pairs")
    ids = settle(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    return _verified_in_passes(pairs, ids, docs, k, similar)


def _verified_in_passes(pairs: DataFrame, ids: DataFrame, docs: DataFrame, k: int, similar: int, by: str = "b") -> DataFrame:
    n, m = ids.count(), pairs.count()
    # a document is in two pairs or so, hence in the ids of two passes
    passes = -(-2 * n // common.BROADCAST_IDS) if n > common.BROADCAST_IDS else 1
    passes = max(passes, -(-m // PASS_PAIRS) if by == "b" else m // (2 * PASS_PAIRS))
    if passes < 2:
        return _verified(pairs, ids, docs, k, similar)
    out = None
    for i in range(passes):
        own = pairs.where(F.pmod(F.xxhash64(by, F.lit(7)), F.lit(passes)) == i)
        met = settle(own.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
        # a pass that has more than its share, as when very many meet one pivot, is dealt once more, by a
        one = _verified_in_passes(own, met, docs, k, similar, "a") if by == "b" else _verified(own, met, docs, k, similar)
        one = settle(one, "verified")
        out = one if out is None else out.unionByName(one)
    return out


def _verified(pairs: DataFrame, ids: DataFrame, docs: DataFrame, k: int, similar: int) -> DataFrame:
    texts = ids_filter(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ids, "doc_id", "left_semi")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    lower = bytes(K.LOWER)

    def shingles(text):
        w = text.as_buffer().to_pybytes().translate(lower).split()
        return set(zip(*(w[i:] for i in range(k)))) if len(w) >= k else {tuple(w)} if w else set()

    def work(batches):
        last, held = None, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = np.zeros(batch.num_rows, dtype=bool)
            ta, tb = batch.column("ta"), batch.column("tb")
            for i in range(batch.num_rows):
                mine = ta[i]
                if last is None or not last.equals(mine):
                    held, last = shingles(mine), mine
                other = shingles(tb[i])
                same = len(held & other)
                keep[i] = same > 0 and 100 * same >= similar * (len(held) + len(other) - same)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    both = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    return both.select("a", "b", "ta", "tb").mapInArrow(work, "a long, b long").distinct()


def token_sets(docs: DataFrame, ids: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, n, tokens) of the documents ``ids``: the upper half of each token's hash, which never hides an overlap."""

    def work(batches):
        for batch, rows, data, off in K.text_batches(batches):
            values, at = _sets(data, off, k)
            half = (values >> K.U(32)).astype(np.uint32)
            out = [half[at[i] : at[i + 1]].tobytes() for i in range(len(rows))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(rows[0], len(rows)), pa.array(np.diff(at).astype(np.int32)), pa.array(out, pa.binary())], ["doc_id", "n", "tokens"])

    # more ids than can be broadcast take passes by id, so that no text is shuffled to find those that are needed
    n = ids.count()
    passes = 1 if n <= common.BROADCAST_IDS else -(-5 * n // (4 * common.BROADCAST_IDS))
    out = None
    for i in range(passes):
        own = lambda df: df if passes < 2 else df.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(passes)) == i)  # noqa: B023, E731
        kept = ids_filter(own(docs.select("doc_id", "text")), own(ids), "doc_id", "left_semi")
        one = settle(kept.mapInArrow(work, "doc_id long, n int, tokens binary").distinct(), "sets")
        out = one if out is None else out.unionByName(one)
    return out


def partners(keys: DataFrame, labels: DataFrame, similar: int, most: int = PRUNED) -> DataFrame:
    """(key, doc_id, n, c): members of the buckets that hold several components, c being the component.

    In classes of rare tokens with up to ``most`` members, those stay that could have a link to another component: the
    tokens that two members share in the class, those that both have in other classes, and what is left after the
    prefixes, reach the overlap that is needed.  Only the tokens of the class are looked at here.  A pair that shares
    tokens of small buckets besides is one of ``counted_pairs``.
    """
    named = keys.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    settled = settle(named.withColumn("c", F.coalesce("component_id", "doc_id")).drop("component_id"), "named")
    split = settle(settled.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key"), "split")
    named = settled.join(split, "key")
    few = F.col("tokens").isNotNull() & (F.col("m") <= most)

    def work(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        n, rest, total, c, doc = (t.column(x).to_numpy().astype(np.int64) for x in ("n", "rest", "total", "c", "doc_id"))
        lists = t.column("tokens").chunk(0)
        size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        _, token = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        has = np.zeros((len(n), int(token.max()) + 1), dtype=np.float32)
        has[np.repeat(np.arange(len(n)), size), token] = 1
        other = total - size
        reach = has @ has.T + np.minimum.outer(other, other) + np.maximum.outer(rest, rest)
        need = -(-similar * np.add.outer(n, n) // (100 + similar))
        fits = np.minimum.outer(n, n) * 100 >= similar * np.maximum.outer(n, n)
        apart = (c[:, None] != c[None, :]) & (doc[:, None] != doc[None, :])
        return t.select(["key", "doc_id", "n", "c"]).filter(pa.array((fits & apart & (reach >= need)).any(axis=1)))

    pruned = named.where(few).groupBy("key").applyInArrow(work, "key long, doc_id long, n int, c long")
    out = settle(pruned.unionByName(named.where(~few).select("key", "doc_id", "n", "c")), "partners")
    forget(settled)
    return out


def _joining_links(ids, n, comp, outside, inside, flat, start, similar, all_links):
    """Pairs (outside, inside) of similar sets that join different components."""
    _, flat = np.unique(flat, return_inverse=True)
    count = np.bincount(flat)
    end = np.append(start[1:], len(flat))
    common = np.array([int((count[flat[s:e]] > 1).sum()) for s, e in zip(start, end)])
    _, label = np.unique(comp, return_inverse=True)
    order = inside[np.argsort(n[inside], kind="stable")]
    size = n[order]
    begin = np.concatenate([[0], np.cumsum(size)])
    tokens = np.concatenate([flat[start[i] : end[i]] for i in order]) if len(order) else flat[:0]
    seen = np.zeros(len(count), dtype=bool)
    out = []
    for x in outside[np.argsort(n[outside], kind="stable")]:
        lo = int(np.searchsorted(size, -(-similar * n[x] // 100), "left"))
        hi = int(np.searchsorted(size, 100 * n[x] // similar, "right"))
        if lo >= hi:
            continue
        near = order[lo:hi]
        need = -(-similar * (n[x] + size[lo:hi]) // (100 + similar))
        able = (label[near] != label[x]) & (ids[near] != ids[x]) & (np.minimum(common[near], common[x]) >= need)
        if not able.any():
            continue
        seen[flat[start[x] : end[x]]] = True
        same = np.add.reduceat(seen[tokens[begin[lo] : begin[hi]]], begin[lo:hi] - begin[lo], dtype=np.int64)
        seen[flat[start[x] : end[x]]] = False
        for y in near[able & (same >= need)]:
            if all_links:
                out.append((ids[x], ids[y]))
            elif label[y] != label[x]:
                out.append((ids[x], ids[y]))
                label[label == label[y]] = label[x]
    return out


def cross_links(named: DataFrame, docs: DataFrame, k: int, similar: int, block: int = BLOCK_TOKENS, all_links: bool = False) -> DataFrame:
    """(a, b): within the buckets of ``partners``, links that join components, by the halves of the tokens.

    What is outside a bucket's largest component meets the whole bucket, in blocks of about ``block`` tokens.  Buckets are
    dealt to passes, so that about PASS_BYTES of token sets travel at once.
    """
    parts = named.groupBy("key", "c").agg(F.sum("n").alias("tokens"))
    most = F.max(F.struct("tokens", "c"))
    split = parts.groupBy("key").agg(F.count("*").alias("k"), F.sum("tokens").alias("all"), most.alias("most")).where("k > 1")
    blocks = lambda x: F.greatest(F.lit(1), F.ceil(x / block)).cast("int")
    outer = F.col("all") - F.col("most.tokens")
    split = split.select("key", F.col("most.c").alias("main"), blocks(F.col("all")).alias("nb"), blocks(outer).alias("sb"), "all", outer.alias("outer"))
    split = settle(split, "split")
    sent = split.agg(F.sum(4 * (F.col("all") * F.col("sb") + F.col("outer") * F.col("nb")))).first()[0]
    if sent is None:
        return named.select(F.col("doc_id").alias("a"), F.col("c").alias("b")).limit(0)
    passes = -(-sent // PASS_BYTES)
    rows = settle(named.join(split.drop("all", "outer"), "key").withColumn("outside", F.col("c") != F.col("main")), "rows")
    sets = token_sets(docs, settle(rows.select("doc_id").distinct(), "ids"), k)
    at = lambda salt, of: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(of)).cast("int")
    alone = (F.col("nb") == 1) & (F.col("sb") == 1)
    whole = rows.select("key", "doc_id", "c", F.explode(F.sequence(F.lit(0), F.col("sb") - 1)).alias("i"), at(1, "nb").alias("j"), F.when(alone & F.col("outside"), 2).otherwise(0).alias("role"))
    apart = rows.where(~alone & F.col("outside")).select("key", "doc_id", "c", at(2, "sb").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("j"), F.lit(1).alias("role"))
    tasks = whole.unionByName(apart)

    def work(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        ids, n, comp, role = (t.column(x).to_numpy() for x in ("doc_id", "n", "c", "role"))
        data, off = K.buffers(t.column("tokens").chunk(0))
        out = _joining_links(ids, n.astype(np.int64), comp, np.flatnonzero(role > 0), np.flatnonzero(role != 1), data.view(np.uint32), off[:-1] // 4, similar, all_links)
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    out = None
    for i in range(passes):
        own = tasks.where(F.pmod(F.xxhash64("key", F.lit(7)), F.lit(passes)) == i) if passes > 1 else tasks
        own = own.join(sets, "doc_id").select("key", "i", "j", "doc_id", "n", "c", "role", "tokens")
        one = settle(own.groupBy("key", "i", "j").applyInArrow(work, "a long, b long").distinct(), "joining")
        out = one if out is None else out.unionByName(one)
    forget(sets)
    return out.distinct() if passes > 1 else out


def met_in_passes(docs: DataFrame, common: np.ndarray, k: int, similar: int, small: int, passes: int) -> DataFrame:
    """``meet`` over the whole index: all rows of a token are in one pass, and the shuffle files of a pass go with it."""
    out = None
    for i in range(passes):
        one = settle(meet(index_rows(docs, common, k, similar, i, passes), similar, small), "met")
        out = one if out is None else out.unionByName(one)
    return out


def _classes(docs: DataFrame, k: int, similar: int, frequent: int, small: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has doc_id, n, h1, h2 and the vertex; classes has h1, h2, n, class_id and component_id, both vertices."""
    docs = docs.select("doc_id", "text")
    scanned = settle(scan(docs, k), "scan")
    often = frequent_tokens(scanned, frequent)
    slim = settle(scanned.where("n is not null").select("doc_id", "n", "h1", "h2", _vertex().alias("vertex")), "slim")
    forget(scanned)
    classes = settle(slim.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("vertex").alias("class_id"), F.count("*").alias("c")), "classes")
    # copies that stand for no class leave; documents without shingles have no index rows anyway
    members = slim.join(classes.where("c > 1"), ["h1", "h2", "n"]).where(F.col("vertex") != F.col("class_id"))
    copies = members.select(F.col("vertex").alias("doc_id")).distinct().join(classes.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_anti")
    docs = _with_vertices(docs, k)
    singles = ids_filter(docs, settle(copies, "copies"), "doc_id", "left_anti")
    passes = PASSES if (classes.agg(F.sum("n")).first()[0] or 0) > PASS_TOKENS else 1
    met = met_in_passes(singles, often, k, similar, small, passes)
    keys, loads = class_keys(met)
    near = counted_pairs(met, loads, similar)
    forget(met)
    links = settle(verify(near.where("first").select("a", "b").unionByName(pivot_pairs(keys, similar)), docs, k, similar), "links")
    # classes that share an id are one vertex already; rows of one id with equal sets need no link
    labels = settle(components(links), "labels")
    side = lambda x: labels.select(F.col("id").alias(x), F.col("component_id").alias(f"{x}c"))
    rest = near.where("not first").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = rest.where(F.coalesce("ac", "a") != F.coalesce("bc", "b")).select("a", "b")
    open_ = partners(keys, labels, similar)
    forget(keys)
    across = cross_links(open_, docs, k, similar, block)
    more = settle(verify(rest.unionByName(across), docs, k, similar), "more")
    pair = F.struct(F.least("a", "b"), F.greatest("a", "b")).alias("p")
    if not across.select(pair).join(more.select(pair), "p", "left_anti").isEmpty():
        # halves of tokens made a link that the texts refute, and it may have hidden another: all are tried
        every = cross_links(open_, docs, k, similar, block, all_links=True)
        more = more.unionByName(settle(verify(every, docs, k, similar), "more"))
    if not more.isEmpty():
        known = labels.select(F.col("id").alias("a"), F.col("component_id").alias("b"))
        labels = settle(components(known.unionByName(more)), "labels")
    named = classes.drop("c").join(labels.withColumnRenamed("id", "class_id"), "class_id", "left")
    return slim, settle(named.withColumn("component_id", F.coalesce("component_id", "class_id")), "named")


def similar_components(docs: DataFrame, k: int = SHINGLE, similar: int = SIMILAR, frequent: int = FREQUENT, small: int = SMALL, block: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id of equal sets), component_id."""
    slim, classes = _classes(docs, k, similar, frequent, small, block)
    # an id that stands with several sets is one vertex: all its rows have the component of them all
    by_id = slim.groupBy("doc_id").agg(F.count_distinct("h1", "h2").alias("s")).where("s > 1 and doc_id is not null").select("doc_id")
    out = slim.join(classes, ["h1", "h2", "n"], "left")
    out = out.withColumns({"class_id": F.coalesce("class_id", "vertex"), "component_id": F.coalesce("component_id", "vertex")})
    several = settle(out.join(by_id, "doc_id", "left_semi").select("doc_id", "component_id").distinct(), "several")
    if not several.isEmpty():
        joined = several.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        final = settle(components(joined), "labels").select(F.col("id").alias("component_id"), F.col("component_id").alias("_root"))
        out = out.join(final, "component_id", "left").withColumn("component_id", F.coalesce("_root", "component_id")).drop("_root")
    real = lambda c: F.when(F.col(c) < NO_ID, F.col(c)).alias(c)
    return out.select("doc_id", F.col("n").alias("n_shingles"), real("class_id"), real("component_id"))


def keep_one(docs: DataFrame, k: int = SHINGLE, similar: int = SIMILAR, frequent: int = FREQUENT, small: int = SMALL, block: int = BLOCK_TOKENS) -> DataFrame:
    """``docs`` without the rows that are similar, through any chain of links, to one with a smaller id.

    Rows that repeat the smallest id of their component stay; of rows without an id that reach no id, one of each
    component stays; rows without shingles stay.
    """
    slim, classes = _classes(docs, k, similar, frequent, small, block)
    out = slim.where("n > 0").join(classes, ["h1", "h2", "n"])
    gone = settle(out.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct(), "gone")
    known = docs.where("doc_id is not null")
    kept = ids_filter(known, gone, "doc_id", "left_anti")
    rest = docs.where("doc_id is null")
    if rest.isEmpty():
        return kept
    first = settle(out.where("doc_id is null and vertex = component_id").select("vertex").distinct(), "first")
    columns = rest.columns

    def work(batches):
        for batch, rows, data, off in K.text_batches(batches):
            values, at = _sets(data, off, k)
            h1, _ = _digests(values, at)
            part = batch.slice(rows[0], len(rows))
            empty = pa.array(np.diff(at) == 0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(NO_ID + (h1 & ((1 << 61) - 1))), empty], [*part.schema.names, "_vertex", "_blank"])

    from pyspark.sql import types as T

    schema = T.StructType([*rest.schema.fields, T.StructField("_vertex", T.LongType()), T.StructField("_blank", T.BooleanType())])
    rest = settle(rest.mapInArrow(work, schema), "unnamed")
    one = rest.where("not _blank").join(first.withColumnRenamed("vertex", "_vertex"), "_vertex", "left_semi")
    order = F.struct("text", F.xxhash64(*columns))
    one = one.groupBy("_vertex").agg(F.min_by(F.struct(*columns), order).alias("_one")).select("_one.*")
    return kept.unionByName(one).unionByName(rest.where("_blank").select(*columns))
