"""Array kernels over Arrow string buffers: words, hashes and content-defined anchors.

A chunk is a run of documents held as one byte array with offsets, so that every step is one numpy pass over many
documents.  Hashes of words are multilinear (a random coefficient for each place in the word), rolling hashes are
polynomials modulo the prime 2**61 - 1; neither has strings of a regular build that collide, as polynomials modulo
2**64 do.  They choose candidates; equality is then decided by a cryptographic digest or by the text itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once; a longer single document is its own chunk.
CHUNK = 1 << 19
U = np.uint64
PRIME = (1 << 61) - 1
P = U(PRIME)


def _word(seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(seed.to_bytes(8, "big"), digest_size=8).digest(), "big")


BYTE_CODE = np.array([_word(i) for i in range(256)], dtype=U)
BASE = _word(1000) % (PRIME - 2) + 2
BASE_INV = pow(BASE, -1, PRIME)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}
_places: list[np.ndarray] = []


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, for values below it."""
    low = U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> U(31), a & low, b >> U(31), b & low
    mid = a1 * b0 + a0 * b1
    out = ((a1 * b1) << U(1)) + (mid >> U(30)) + ((mid & U((1 << 30) - 1)) << U(31)) + a0 * b0
    return _fold(out)


def _fold(x: np.ndarray) -> np.ndarray:
    """Any 64-bit values modulo 2**61 - 1."""
    x = (x & P) + (x >> U(61))
    return np.where(x >= P, x - P, x)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**61 - 1."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        size = max(n, CHUNK + 4096)
        held = np.ones(size, dtype=U)
        have = 1
        while have < size:
            more = min(have, size - have)
            held[have : have + more] = times(held[:more], np.full(more, pow(base, have, PRIME), dtype=U))
            have += more
        _powers[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def place_codes(n: int) -> np.ndarray:
    """A pseudorandom odd coefficient for each of the places 0 .. n-1."""
    if not _places or len(_places[0]) < n:
        _places[:] = [mix(np.arange(max(n, 4096), dtype=U) * U(0x9E3779B97F4A7C15) + U(_word(3000))) | U(1)]
    return _places[0][:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; nulls are empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    column = column.cast(kind).fill_null(b"")
    _, off, data = column.buffers()
    width = np.int64 if kind == pa.large_binary() else np.int32
    off = np.frombuffer(off, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch_ids: np.ndarray, column: pa.Array, size: int = CHUNK):
    """Split a batch into runs of documents of about ``size`` bytes: (row numbers, bytes, offsets)."""
    data, off = buffers(column)
    n, first = len(off) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + size, "right")) - 1)
        last = min(last, n)
        yield batch_ids[first:last], data[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word and, per document, the number of the first word (one more entry than documents)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~IS_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off, "left")


def joined_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words joined by single spaces, and where each begins and ends there."""
    size = end - start
    begin = np.cumsum(size + 1) - size - 1
    out = np.full(int((size + 1).sum()), 32, dtype=np.uint8)
    solid = data[~IS_SPACE[data]]
    out[np.arange(len(solid)) + np.repeat(np.arange(len(size)), size)] = solid
    return out.tobytes(), begin, begin + size


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; ``data`` has the words' bytes in order and nothing but separators besides."""
    if not len(start):
        return np.zeros(0, dtype=U)
    size = end - start
    first = np.cumsum(size) - size
    solid = data[~IS_SPACE[data]]
    place = np.arange(len(solid)) - np.repeat(first, size)
    sums = np.add.reduceat(BYTE_CODE[solid] * place_codes(int(size.max()))[place], first)
    return mix(sums + size.astype(U) * U(0x9E3779B97F4A7C15))


class Rolling:
    """Hashes of any run of ``codes``, the same wherever the run stands."""

    def __init__(self, codes: np.ndarray):
        terms = times(powers(BASE, len(codes)), _fold(codes))
        self._sums(terms & U(0xFFFFFFFF), terms >> U(32))

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Rolling:
        out = cls.__new__(cls)
        terms, code = powers(BASE, len(data)), data.astype(U) + U(1)
        out._sums(code * (terms & U(0xFFFFFFFF)), code * (terms >> U(32)))
        return out

    def _sums(self, low: np.ndarray, high: np.ndarray) -> None:
        self.low, self.high = np.zeros(len(low) + 1, dtype=U), np.zeros(len(low) + 1, dtype=U)
        np.cumsum(low, out=self.low[1:])
        np.cumsum(high, out=self.high[1:])

    def every(self, k: int) -> np.ndarray:
        """Hash of every k consecutive codes; len - k + 1 values."""
        n = len(self.low) - k
        if n <= 0:
            return np.zeros(0, dtype=U)
        # sums that have run over 2**64 differ by the right amount all the same
        low, high = self.low[k:] - self.low[:-k], self.high[k:] - self.high[:-k]
        value = (low & P) + (low >> U(61)) + (high >> U(29)) + ((high & U((1 << 29) - 1)) << U(32))
        return mix(times(_fold(value), powers(BASE_INV, n)))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values: block-wise running minima from both sides."""
    n = len(x) - w + 1
    pad = (-len(x)) % w
    full = np.concatenate([x, np.full(pad, np.iinfo(np.uint64).max, dtype=U)]) if pad else x
    rows = full.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def anchors(rolling: Rolling, off: np.ndarray, window: int, gram: int):
    """Winnowed anchors of every window of ``window`` codes that lies within one document.

    A window's anchor is the leftmost of its grams with the least hash, so equal windows have equal anchors at equal
    offsets.  Returns (document, fingerprint, anchor, first window, last window), positions within the document; the
    windows of one anchor are consecutive.
    """
    empty = np.zeros(0, dtype=np.int64)
    if off[-1] < window:
        return empty, np.zeros(0, dtype=U), empty, empty, empty
    grams = rolling.every(gram)
    n = len(grams)
    low = U((1 << max(20, int(n).bit_length())) - 1)
    keys = (grams & ~low) | np.arange(n, dtype=U)
    best = (sliding_min(keys, window - gram + 1) & low).astype(np.int64)
    at = np.arange(len(best), dtype=np.int64)
    doc = np.searchsorted(off, at, "right") - 1
    inside = at + window <= off[doc + 1]
    at, doc, best = at[inside], doc[inside], best[inside]
    if not len(at):
        return empty, np.zeros(0, dtype=U), empty, empty, empty
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:], [len(at)]]) - 1
    d = doc[new]
    return d, grams[best[new]], best[new] - off[d], at[new] - off[d], at[last] - off[d]


def shingles(codes: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each document, and per document the number of its first.

    A document with 1 to k-1 words has one shingle, its whole sequence; the length is part of the hash.
    """
    sizes = np.diff(first)
    count = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(sizes)), count)
    at = np.arange(start[-1]) - start[doc] + first[doc]
    length = np.minimum(sizes, k)[doc]
    out = length.astype(U) * U(0x9E3779B97F4A7C15)
    step = U(_word(2000) | 1)
    padded = np.concatenate([codes, np.zeros(k, dtype=U)])
    for i in range(k):
        out = out * step + np.where(i < length, padded[at + i], U(0))
    return mix(out), start


def distinct(values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, with new starts."""
    n = len(start) - 1
    doc = np.repeat(np.arange(n), np.diff(start))
    order = np.lexsort((values, doc))
    v, d = values[order], doc[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[keep], d[keep]
    return v, np.searchsorted(d, np.arange(n + 1), "left")


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by half-open spans."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], s[1:] > e[:-1]]) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return s[at], e[np.concatenate([at[1:], [len(s)]]) - 1] if len(s) else e


def text_batches(batches, text: str = "text"):
    """(record batch, chunk rows, bytes, offsets) for each chunk of each Arrow batch."""
    for batch in batches:
        if batch.num_rows:
            rows = np.arange(batch.num_rows)
            for part, data, off in chunks(rows, batch.column(batch.schema.get_field_index(text))):
                yield batch, part, data, off
