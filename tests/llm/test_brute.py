"""Sharding, packing, mixing and the language model, replayed step by step in plain Python."""

import itertools
import math
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from larkspan.llm import langid, mixing, packing, sharding
from larkspan.session import table

from . import brute
from .test_operators import corpus, frame


def spark_hash(raw: bytes) -> int:
    h = xxhash.xxh64(raw, seed=42).intdigest()
    return h - (1 << 64) if h >> 63 else h


def test_sharding_places(spark):
    """Order by (text hash, id), lay the bytes end to end: a record's shard is where its middle falls."""
    rows = corpus(3, 200) + [(5000 + i, "same text") for i in range(300)]
    ordered = sorted(rows, key=lambda r: (spark_hash((r[1] or "").encode()), r[0]))
    total, at, want, slots = sum(len((t or "").encode()) + 1 for _, t in rows), 0, {}, [0] * 8
    for i, t in ordered:
        n = len((t or "").encode()) + 1
        s = min(7, math.floor((at + n / 2) * 8 / total))
        want[i] = (s, slots[s])
        slots[s] += 1
        at += n
    for ranges in (1, 16):
        placed = sharding.place(sharding.settle(sharding.slim_rows(frame(spark, rows)), "sizes"), 8, sample=300, ranges_per_shard=ranges)
        assert {r.doc_id: (r.shard, r.slot) for r in placed.collect()} == want


def plain_pack(sizes, lengths, cost):
    """Best fit as described, with linear searches: the open bin with the least room, else the cheapest length per word."""
    left, bins = sorted(sizes, reverse=True), []
    while left:
        size = left.pop(0)
        fits = [b for b in bins if b["room"] >= size]
        if fits:
            b = min(fits, key=lambda b: b["room"])
        else:

            def filled(length):
                got, room = size, length - size
                for s in left:  # longest first
                    if s <= room:
                        got, room = got + s, room - s
                return got

            length = min((c for c in lengths if c >= size), key=lambda c: (cost(c) / filled(c), c))
            b = {"room": length, "used": 0}
            bins.append(b)
        b["room"] -= size
        b["used"] += size
    return sorted(min(c for c in lengths if c >= b["used"]) for b in bins)


def cheapest(sizes, lengths, cost):
    """The least cost of any assignment of pieces to bins."""
    best = math.inf
    for to in itertools.product(range(len(sizes)), repeat=len(sizes)):
        if any(to[i] > max(to[:i], default=-1) + 1 for i in range(len(to))):
            continue
        used = [sum(s for s, t in zip(sizes, to) if t == b) for b in range(max(to) + 1)]
        if max(used) <= lengths[-1]:
            best = min(best, sum(cost(min(c for c in lengths if c >= u)) for u in used))
    return best


def test_pack_is_best_fit():
    rng = random.Random(1)
    lengths, cost = (16, 32, 64), lambda c: c + packing.OVERHEAD
    for _ in range(300):
        sizes = [rng.choice([1, 2, 3, 7, 15, 16, 17, 30, 33, 60, 64, rng.randint(1, 64)]) for _ in range(rng.randint(1, 40))]
        bins, offsets, final = packing.pack(np.array(sizes), lengths)
        assert sorted(final) == plain_pack(sizes, lengths, cost)
        for b in range(len(final)):
            inside = sorted((o, s) for o, s, x in zip(offsets, sizes, bins) if x == b)
            assert [o for o, _ in inside] == list(np.cumsum([0] + [s for _, s in inside])[:-1])


def test_pack_is_near_the_cheapest():
    rng = random.Random(2)
    lengths, cost, ratios = (16, 32, 64), lambda c: c + packing.OVERHEAD, []
    for _ in range(40):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(2, 6))]
        _, _, final = packing.pack(np.array(sizes), lengths)
        ratios.append(sum(cost(c) for c in final) / cheapest(sizes, lengths, cost))
    assert max(ratios) <= 1.5 and sum(ratios) / len(ratios) <= 1.06


MASK = (1 << 64) - 1


def scramble(x):
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * m) & MASK
    return x ^ (x >> 33)


def slow_permute(x, n, keys):
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = (1 << half) - 1
    while True:
        left, right = x >> half, x & low
        for key in keys:
            left, right = right, left ^ (scramble((right + key) & MASK) & low)
        x = (left << half) | right
        if x < n:
            return x


def test_mix_replayed(spark):
    """Every slot takes the block that its source's permutation names; the last slot ends at the rounded target."""
    rows = corpus(7, 50)
    docs = frame(spark, rows)
    block, shards = 16, 5
    slim = mixing.settle(docs.select(*mixing._keys(docs), "doc_id", "source", mixing.n_words(docs["text"]).alias("size")), "sizes")
    sizes, pieces = mixing._mix(slim, block=block, shards=shards)
    found = {r["_row"]: r for r in sizes.collect()}
    at = {r["_row"]: r.start for r in mixing.streams(slim.where("size > 0")).collect()}
    taken = pieces.collect()
    goal = mixing.targets({s: sum(r["size"] for r in found.values() if r.source == s) for s in {r.source for r in found.values()}})
    numbers = {s: i for i, s in enumerate(goal)}
    for s in goal:
        stream = [k for k in sorted((k for k, r in found.items() if r.source == s and r["size"]), key=at.get) for _ in range(found[k]["size"])]
        assert [at[k] for k in dict.fromkeys(stream)] == [stream.index(k) for k in dict.fromkeys(stream)]
        blocks, want, left, slot = -(-len(stream) // block), [], int(goal[s] + 0.5), 0
        while left > 0:
            turn, b = slot // blocks, slow_permute(slot % blocks, blocks, mixing._round_keys(1, numbers[s], slot // blocks))
            part = stream[b * block : (b + 1) * block][:left]
            for k in dict.fromkeys(part):
                want.append((k, turn, b * block + part.index(k) - at[k], part.count(k), slot))
            left -= len(part)
            slot += 1
        mine = [r for r in taken if found[r["_row"]].source == s]
        assert sorted((r["_row"], r.turn, r["first"], r.words, r.slot) for r in mine) == sorted(want)
        # a source's slots go to the output shards in order
        of = {}
        for r in mine:
            of.setdefault(r.slot, set()).add(r.shard)
        assert all(len(x) == 1 for x in of.values())
        assert [min(of[k]) for k in sorted(of)] == sorted(min(x) for x in of.values())


def slow_features(text):
    """Hashed 1- to 3-grams of the lower-cased letters, everything else being one separator."""
    codes = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for c in text]
    out = []
    for n in (1, 2, 3):
        for i in range(len(codes) - n + 1):
            h = 0
            for k in range(1, n + 1):
                h = ((h * 0x85EBCA6B) & 0xFFFFFFFF) ^ ((codes[i + k - 1] + (k * 0x9E3779B1 & 0xFFFFFFFF)) & 0xFFFFFFFF)
            out.append((((h ^ (h >> 15)) * 0x2C1B3C6D) & 0xFFFFFFFF) >> (32 - langid.BITS))
    return out


def test_language_scores(spark, small):
    """Scores of the arrays against dense vectors, one text after the other."""
    docs = table(spark, small, "documents")
    model = langid.train(docs.select("doc_id", "text", "lang"))
    odd = spark.createDataFrame([(9001, "Ünïcödé ÄÖ ß 日本 x"), (9002, "a"), (9003, "1 2 3"), (9004, None)], "doc_id long, text string")
    some = docs.where("doc_id % 7 = 0 and length(text) < 3000").select("doc_id", "text").unionByName(odd)
    for r in langid.predict(some.withColumn("text", F.coalesce("text", F.lit(""))), model).collect():
        if not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.score) == (langid.UND, 0.0)
            continue
        x = np.zeros(1 << langid.BITS)
        for f in slow_features(r.text):
            x[f] += 1
        x *= model.idf
        x *= model.scale / x.sum()
        z = (x @ model.weights + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r.lang_pred == model.langs[int(p.argmax())] and abs(r.score - p.max()) < 1e-4


def test_document_frequencies(spark, small):
    docs = table(spark, small, "documents").where("doc_id < 20").select("text")
    df, n = langid.document_frequencies(docs)
    texts = [r.text for r in docs.collect()]
    want = np.zeros(1 << langid.BITS, dtype=np.int64)
    for t in texts:
        want[sorted(set(slow_features(t)))] += 1
    assert n == len(texts) and (df == want).all()
    assert brute.words("a b") == [b"a", b"b"]
