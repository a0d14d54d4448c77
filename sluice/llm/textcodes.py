"""Words and word shingles of whole Arrow batches as 64-bit codes, computed with numpy inside tasks.

Texts are read in place as UTF-8 bytes; a chunk holds whole texts of about CHUNK bytes (one text may be longer), so memory
follows the longest text and not the batch. A word is a run of bytes other than space and \\t-\\r. A word's
code is the sum of its bytes, each times a coefficient drawn for its place in the word, modulo 2**64: two given words share
a code with a probability of 2**-57 at most over the draw, whatever their pattern (a polynomial in one base has texts of
1,024 letters that share a code for every base).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C55
STEPS = np.random.default_rng(20).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_blank = np.zeros(256, bool)
_blank[[9, 10, 11, 12, 13, 32]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_drawn = {"places": np.zeros(0, np.uint64)}
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i up to n."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, CHUNK + 1)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def places(n: int) -> np.ndarray:
    """The coefficients of the first n places of a word."""
    if len(_drawn["places"]) < n:
        size = max(n, 2 * len(_drawn["places"]), 1024)
        _drawn["places"] = mix(mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(BASE)) ^ STEPS[63])
    return _drawn["places"]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the texts in them); null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, blank: np.ndarray = _blank) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, starts and ends of all words, and the index of each text's first word (one more entry than texts)."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), np.int64)
    blank = blank[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, blank[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, blank[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    if not len(starts):
        return starts.astype(np.uint64), starts, ends, np.zeros(len(offsets), np.int64)
    sizes, letters = ends - starts, data[~blank]
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(letters)) - np.repeat(first, sizes)
    terms = ((_lower[letters] if lower else letters).astype(np.uint64) + np.uint64(1)) * places(int(sizes.max()))[place]
    return np.add.reduceat(terms, first), starts, ends, np.searchsorted(starts, offsets)


def shingles(codes: np.ndarray, size: int = 5) -> np.ndarray:
    """A code for each run of size words, at its first word; runs that leave a text are the caller's to ignore."""
    n = max(0, len(codes) - size + 1)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += mix(codes[k : k + n]) * STEPS[k]
    return mix(total)


def short_shingle(codes: np.ndarray) -> np.ndarray:
    """The whole of a text with fewer words than a shingle has, as one code."""
    return mix((mix(codes) * STEPS[: len(codes)]).sum(keepdims=True, dtype=np.uint64) + STEPS[40 + len(codes)])


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, its distinct shingles in increasing order) for every text."""
    for first, last, data, offsets in chunks(texts):
        codes, _, _, begin = words(data, offsets)
        every = shingles(codes, size)
        for k in range(last - first):
            n = begin[k + 1] - begin[k]
            if n >= size:
                yield first + k, np.unique(every[begin[k] : begin[k + 1] - size + 1])
            elif n:
                yield first + k, short_shingle(codes[begin[k] : begin[k + 1]])
            else:
                yield first + k, codes[:0]
