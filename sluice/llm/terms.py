"""Words of many texts by one regular expression pass over their concatenation.

A word is a run of digits, letters and characters beyond ASCII, A-Z lower-cased; a zero byte, which no word has, separates
the texts, so that no word crosses them and the place of a word tells its text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SENTINEL = b"\0"
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BETWEEN = re.compile(rb"[^0-9a-z\x80-\xff]")
TOGETHER = 1 << 20
_is_word = np.array([WORD.match(bytes([b])) is not None for b in range(256)])


def pieces(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of so many texts at a time that they have TOGETHER bytes or are one; a null text is empty."""
    first, size, own = 0, 0, []
    for row, text in enumerate(texts.cast(pa.large_binary())):
        text = text.as_py() or b""
        if own and size + len(text) > TOGETHER:
            yield first, own
            first, size, own = row, 0, []
        own.append(text)
        size += len(text)
    if own:
        yield first, own


def words(texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(number of its text, word) of all words in order, as columns of the words of about TOGETHER bytes."""
    joined = SENTINEL.join(texts).translate(LOWER)
    data, begins = np.frombuffer(joined, np.uint8), np.zeros(len(texts), np.int64)
    np.cumsum([len(t) + len(SENTINEL) for t in texts[:-1]], out=begins[1:])
    start = 0
    while start < len(joined):
        gap = BETWEEN.search(joined, start + TOGETHER)  # a block ends after a byte of no word
        end = gap.end() if gap else len(joined)
        inside = _is_word[data[start:end]]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        found = WORD.findall(joined, start, end)
        if found:
            yield np.searchsorted(begins, np.flatnonzero(first) + start, "right") - 1, found
        start = end
